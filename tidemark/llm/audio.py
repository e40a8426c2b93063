"""Telephony audio columns: mu-law and A-law by lookup table, IMA ADPCM by blocks, resampled to PCM.

Sound is kept as RIFF files in a binary column. Decoding works on the samples of a whole batch at once: companded samples
are one table lookup, ADPCM steps through the nibbles of all blocks together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import textops as X

MU_LAW, A_LAW, IMA, PCM = 7, 6, 17, 1
#: Samples a second of stored sounds, and of the PCM made of them.
RATE, TARGET = 16000, 8000
LEVEL = "parquet.compression.codec.zstd.level"
BLOCK = 192
SAMPLES = 1 + 2 * (BLOCK - 4)


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, part = (code & 15) << 4, code >> 4 & 7
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MU, A = mu_law_table(), a_law_table()
#: Fixed values of the IMA format: how the step index moves with a nibble, and the 89 step sizes.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])


def ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks (n, size) as samples (n, 1 + 2 * (size - 4)); all blocks take each step together."""
    n, size = blocks.shape
    b = blocks.astype(np.int32)
    value = (b[:, 0] | b[:, 1] << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(b[:, 2], 88)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = value
    turned = np.ascontiguousarray(b[:, 4:].T)
    for k in range(2 * (size - 4)):
        nibble = turned[k >> 1] >> (4 * (k & 1)) & 15
        step = IMA_STEPS[index].astype(np.int32)
        move = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
        value = np.clip(np.where(nibble & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + IMA_INDEX[nibble & 7], 0, 88)
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """One signal at another rate, in whole numbers, rounded down: more samples lie on the lines between the given ones, of fewer each is
    the mean of the time that it stands for. There are len(pcm) * target // rate of them."""
    n, last = len(pcm) * target // rate, len(pcm) - 1
    if rate == target or not n:
        return pcm[:n].astype(np.int16)
    a = pcm.astype(np.int64)
    if target > rate:
        i, part = np.divmod(np.arange(n, dtype=np.int64) * rate, target)
        return ((a[i] * (target - part) + a[np.minimum(i + 1, last)] * part) // target).astype(np.int16)
    i, part = np.divmod(np.arange(n + 1, dtype=np.int64) * rate, target)
    area = np.concatenate(([0], np.cumsum(a)))[i] * target + a[np.minimum(i, last)] * part
    return (np.diff(area) // rate).astype(np.int16)


def riff(payload: bytes, kind: int, rate: int = RATE) -> bytes:
    """A mono RIFF file around a payload of the given format."""
    width = 2 if kind == PCM else 1
    align = BLOCK if kind == IMA else width
    second = rate * BLOCK // SAMPLES if kind == IMA else rate * width
    fmt = struct.pack("<HHIIHH", kind, 1, rate, second, align, 4 if kind == IMA else 8 * width)
    fmt += struct.pack("<HH", 2, SAMPLES) if kind == IMA else b"" if kind == PCM else struct.pack("<H", 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_riff(raw: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, block size and payload of a mono RIFF file; anything else raises ValueError."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no RIFF file")
    at, kind, rate, align = 12, 0, 0, 0
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 8 + 16 > len(raw):
                raise ValueError("the format chunk is cut short")
            kind, channels, rate, _, align = struct.unpack_from("<HHIIH", raw, at + 8)
            if channels != 1 or not rate or kind == IMA and align < 5:
                raise ValueError("no mono sound")
        elif name == b"data":
            if not rate:
                raise ValueError("no format before the data")
            return kind, rate, align, raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a mu-law, A-law, IMA ADPCM or PCM file; an ADPCM payload's last partial block is filled with zeros."""
    kind, rate, align, payload = parse_riff(raw)
    data = np.frombuffer(payload, np.uint8)
    if kind == MU_LAW:
        return MU[data], rate
    if kind == A_LAW:
        return A[data], rate
    if kind == IMA:
        data = np.concatenate((data, np.zeros(-len(data) % align, np.uint8)))
        return ima_blocks(data.reshape(-1, align)).reshape(-1), rate
    if kind == PCM:
        return data[: len(data) // 2 * 2].view("<i2"), rate
    raise ValueError(f"format {kind}")


def to_pcm(media: DataFrame, target: int = TARGET) -> DataFrame:
    """media, whose column sound holds RIFF files, with pcm: RIFF files of 16-bit PCM at target samples a second.

    Null sound, and sound that is no mono file of mu-law, A-law, IMA ADPCM or PCM, gives null. A payload that ends early is taken as far
    as it goes; a sound without samples gives a file without samples. Other columns stay as they are; a column pcm is replaced.
    Repeated rows are decoded each; an empty table gives an empty one.
    """
    media = media.drop("pcm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in X.blocks(batches, "sound"):
            out = []
            for raw in t["sound"]:
                try:
                    pcm, rate = decode(raw.as_py() or b"")
                    out.append(riff(resample(pcm, rate, target).astype("<i2").tobytes(), PCM, target))
                except ValueError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*[t[c].combine_chunks() for c in t.column_names], pa.array(out, pa.binary())], names=[*t.column_names, "pcm"])

    return media.mapInArrow(X.task(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields) + ", pcm binary")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in X.blocks(batches, "text"):
        sizes, sounds = [], []
        for text in t["text"]:
            raw = (text.as_py() or "").encode()
            sizes.append(len(raw))
            sounds.append(riff(raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), MU_LAW))
        yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(sizes, pa.int64()), pa.array(sounds, pa.binary())], names=["doc_id", "n_bytes", "sound"])


def store_texts(documents: DataFrame, path: str) -> None:
    """Each text's bytes (null: none), filled with spaces to a positive multiple of BLOCK, as a mu-law file in a column at path.

    Repeated rows are stored each; null doc_ids stay null; further columns are ignored; an empty table gives an empty one.
    """
    documents.select("doc_id", "text").mapInArrow(X.task(_store), "doc_id long, n_bytes long, sound binary").write.mode("overwrite").option("compression", "zstd").option(LEVEL, 7).parquet(path)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, a_law long, adpcm long, peak long, sound binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the stored bytes, and whole-number features of the same bytes read as A-law and as IMA ADPCM."""
    kinds = (pa.int64(),) * 3 + (pa.string(), pa.int64(), pa.int64(), pa.string()) + (pa.int64(),) * 3 + (pa.binary(),)
    names = [x.split(" ")[0] for x in READ.split(", ")]
    for t in X.blocks(batches, "sound"):
        rows = t.to_pylist()
        payloads = [parse_riff(r["sound"])[3] for r in rows]
        data = np.frombuffer(b"".join(payloads), np.uint8)
        size = np.array([len(p) for p in payloads])
        at = np.cumsum(size) - size
        a, ima = A[data].astype(np.int64), ima_blocks(data.reshape(-1, BLOCK)).astype(np.int64)
        a_law = np.add.reduceat(a * a, at)
        blocks, peak = np.add.reduceat(np.abs(ima).sum(1), at // BLOCK), np.maximum.reduceat(np.abs(ima).max(1), at // BLOCK)
        out = [
            (r["doc_id"], r["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(r["sound"]), hashlib.sha256(r["sound"]).hexdigest(), x, y, z, r["sound"])
            for r, p, x, y, z in zip(rows, payloads, a_law.tolist(), blocks.tolist(), peak.tolist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def write_pcm(spark: SparkSession, path: str, to: str) -> None:
    """The sounds at path, as store_texts writes them, read back and written to a table at to as PCM at TARGET samples a second, with
    digests of what was stored. Nulls, repeated rows and empty tables go through row by row."""
    read = spark.read.parquet(path).select("doc_id", "n_bytes", "sound").mapInArrow(X.task(_read), READ)
    to_pcm(read).drop("sound").write.mode("overwrite").option("compression", "zstd").option(LEVEL, 7).parquet(to)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in X.blocks(batches, "pcm"):
        data = [decode(x.as_py())[0] for x in t["pcm"]]
        size = np.array([len(x) for x in data])
        at, x = np.cumsum(size) - size, np.concatenate(data).astype(np.int64)
        moves, cross = np.abs(np.diff(x, prepend=0)), np.append((x[:-1] < 0) != (x[1:] < 0), False)
        moves[at] = 0
        cross[at + size - 1] = False
        sums = [np.add.reduceat(y.astype(np.int64), at).tolist() for y in (x * x, moves, cross)]
        mine = [t[c].to_pylist() for c in ("a_law", "adpcm", "peak")]
        feature = [f"samples={n};energy={e};moves={m};crossings={c};a_law={u};adpcm={v};peak={w}" for n, e, m, c, u, v, w in zip(size.tolist(), *sums, *mine, strict=True)]
        keep = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
        yield pa.RecordBatch.from_arrays([*[t[c].combine_chunks() for c in keep], pa.array(feature, pa.string())], names=[*keep, "feature"])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Digests of the stored sounds, and whole-number features: of the PCM that write_pcm stored at path, and of the same bytes read as
    A-law and IMA ADPCM. One row each, null doc_ids and repeated rows too; an empty table gives an empty result."""
    return spark.read.parquet(path).mapInArrow(X.task(_features), FEATURES)
