import hashlib
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tidemark.llm import audio as A


def test_stored_sounds_and_features(spark, tmp_path):
    rows = [(1, "hello"), (2, None), (3, "é" * 500), (4, "hello"), (4, "hello"), (None, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS sound", "1 AS pcm", "2 AS peak").repartition(3)
    A.store_texts(df, str(tmp_path / "a"))
    A.write_pcm(spark, str(tmp_path / "a"), str(tmp_path / "p"))
    got = A.read_features(spark, str(tmp_path / "p")).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        pay = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = A.riff(pay, A.MU_LAW)
        for r in (r for r in got if r.doc_id == i):
            assert r[:7] == (i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]), len(media), hashlib.sha256(media).hexdigest())
            pcm = brute_resample(A.MU[list(pay)].tolist(), 16000, 8000)
            assert r.feature.startswith(f"samples={len(pcm)};energy={sum(x * x for x in pcm)};moves={sum(abs(a - b) for a, b in zip(pcm, pcm[1:], strict=False))};")
            assert f";a_law={sum(int(x) ** 2 for x in A.A[list(pay)])};" in r.feature
    stored = {r.doc_id: A.decode(r.pcm) for r in spark.read.parquet(str(tmp_path / "p")).collect()}
    assert all(rate == 8000 for _, rate in stored.values())
    empty = spark.createDataFrame([], "doc_id long, text string")
    A.store_texts(empty, str(tmp_path / "e"))
    A.write_pcm(spark, str(tmp_path / "e"), str(tmp_path / "f"))
    assert A.read_features(spark, str(tmp_path / "f")).collect() == []


def brute_resample(x, rate, target):
    n = len(x) * target // rate
    if target >= rate:
        out = []
        for k in range(n):
            t = Fraction(k * rate, target)
            i = int(t)
            out.append((x[i] * (1 - (t - i)) + x[min(i + 1, len(x) - 1)] * (t - i)).__floor__())
        return out
    area = lambda t: sum(x[: int(t)]) + (x[int(t)] * (t - int(t)) if int(t) < len(x) else 0)
    return [((area(Fraction((k + 1) * rate, target)) - area(Fraction(k * rate, target))) * Fraction(target, rate)).__floor__() for k in range(n)]


@pytest.mark.parametrize(("rate", "target"), [(8000, 16000), (16000, 8000), (8000, 8000), (11025, 8000), (8000, 11025), (48000, 7)])
def test_resample(rate, target):
    r = np.random.default_rng(rate + target)
    for n in (0, 1, 2, 97):
        x = r.integers(-32768, 32768, n).astype(np.int16)
        assert A.resample(x, rate, target).tolist() == brute_resample(x.tolist(), rate, target)


def scalar_ima(block):
    """One block, nibble by nibble, by the format's own rule."""
    value, index = struct.unpack_from("<hB", block)
    out, index = [value], min(index, 88)
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(A.IMA_STEPS[index])
            move = step >> 3
            for bit, part in ((1, step >> 2), (2, step >> 1), (4, step)):
                move += part if nibble & bit else 0
            value = max(-32768, min(32767, value - move if nibble & 8 else value + move))
            index = max(0, min(88, index + int(A.IMA_INDEX[nibble & 7])))
            out.append(value)
    return out


def test_ima_blocks():
    b = np.random.default_rng(2).integers(0, 256, (40, 64)).astype(np.uint8)
    assert A.ima_blocks(b).tolist() == [scalar_ima(x.tobytes()) for x in b]


def test_companding_tables():
    """Sign, segment and step of every code, as G.711 states them."""
    for code in range(256):
        c = ~code & 255
        mu = ((2 * (c & 15) + 33) << (c >> 4 & 7)) - 33
        assert A.MU[code] == (-4 * mu if c & 128 else 4 * mu)
        c = code ^ 0x55
        seg, step = c >> 4 & 7, c & 15
        size = 2 * step + 1 if seg == 0 else (2 * step + 33) << (seg - 1)
        assert A.A[code] == (8 * size if c & 128 else -8 * size)


def test_to_pcm(spark):
    raw = np.random.default_rng(3).integers(0, 256, 384).astype(np.uint8).tobytes()
    good = {k: A.riff(raw, kind, 8000) for k, kind in (("mu", A.MU_LAW), ("a", A.A_LAW), ("ima", A.IMA), ("pcm", A.PCM))}
    bad = {"null": None, "empty": b"", "cut": good["mu"][:20], "head": b"RIFF\0\0\0\0WAVE", "odd": good["mu"].replace(b"data", b"none"), "kind": good["mu"][:20] + b"\x63\0" + good["mu"][22:], "zero": good["ima"][:32] + b"\0\0" + good["ima"][34:]}
    rows = [*good.items(), *bad.items(), ("mu", good["mu"]), ("short", good["mu"][:-100]), ("none", A.riff(b"", A.A_LAW))]
    df = spark.createDataFrame(rows, "key string, sound binary").selectExpr("*", "1 AS pcm", "2 AS rate").repartition(2)
    got = A.to_pcm(df, 16000)
    assert got.columns == ["key", "sound", "rate", "pcm"]
    got = sorted(((r.key, r.pcm) for r in got.collect()), key=lambda x: x[0])
    want = {"mu": A.MU[list(raw)], "a": A.A[list(raw)], "ima": np.concatenate([scalar_ima(raw[:192]), scalar_ima(raw[192:])]), "pcm": np.frombuffer(raw, "<i2"), "short": A.MU[list(raw[:-100])], "none": np.empty(0, np.int16)}
    assert [k for k, _ in got] == sorted(k for k, _ in rows)
    for k, pcm in got:
        if k in bad:
            assert pcm is None
        else:
            samples, rate = A.decode(bytes(pcm))
            assert rate == 16000 and samples.tolist() == brute_resample(want[k].tolist(), 8000, 16000)
    assert A.to_pcm(spark.createDataFrame([], "key string, sound binary")).collect() == []
