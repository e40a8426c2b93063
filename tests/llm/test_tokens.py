import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tidemark.llm import tokens as K
from tokenizers import Tokenizer

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2**32 - 1])
def test_codes(top):
    ids = np.random.default_rng(1).integers(0, top, 3000, endpoint=True).astype(np.uint32)
    r = K.DacReader(K.dac_encode(ids))
    assert [r[i] for i in range(len(r))] == ids.tolist()
    assert r.slice(700, 2100).tolist() == ids[700:2100].tolist()


def test_documents(spark, tmp_path):
    r = random.Random(2)
    odd = ["it's.", "<|endoftext|>", "<|ENDOFTEXT|> It's!", "É...", "a.b,c", "…", "ISTANBUL İ", "x" * 4000, "don't stop.'s", "1,2.", "é.", "日本語。text", "'S.'ll"]
    rows = [(None, "null id"), (3, None), (4, ""), (4, "twice"), (4, "twice")] + [(10 + i, " ".join(r.choice([*odd, "The", "cat,"]) for _ in range(r.randrange(30)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part").repartition(5)
    K.write_tokens(df, str(tmp_path / "t"), FILE, shard_tokens=50)
    got = sorted(map(tuple, K.read_tokens(spark, str(tmp_path / "t")).collect()), key=lambda x: x[1])
    t, at, want = Tokenizer.from_file(FILE), 0, []
    for doc, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    one = K.token_at(spark, str(tmp_path / "t"), [(0, 0, 0)]).collect()
    assert len(one) == 1


LETTERS = ["\u09b8\u09ae\u09df", "\u0958\u0930", "\u0a36\u0a39", "\ufb2a\u05dc\u05d5\u05dd", "\ufb4e", "\u09dc", "\u212bngstr", "\u0130stanbul", "\u00e9t\u00e9"]


@pytest.mark.parametrize("checked", [True, False])
def test_letters_of_several_pieces(monkeypatch, checked):
    if not checked:  # the number of pieces alone has to tell
        monkeypatch.setattr(K.unicodedata, "is_normalized", lambda form, w: True)
    words = [x for w in LETTERS for x in (w, "hello", "ends")] * 3
    t = Tokenizer.from_file(FILE)
    assert K.Vocabulary(FILE).encode(words) == [t.encode(w, add_special_tokens=False).ids for w in words]


def test_documents_of_such_letters(spark, tmp_path):
    rows = [(i, f"{w} hello {LETTERS[i - 1]} world ends") for i, w in enumerate(LETTERS)] + [(50, "hello world ends")]
    K.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "t"), FILE)
    t = Tokenizer.from_file(FILE)
    want = {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in rows}
    assert {r.doc_id: r.ids_crc32 for r in K.read_tokens(spark, str(tmp_path / "t")).collect()} == want


def test_words_that_the_model_takes_at_once():
    """Every letter by itself, between others and before its neighbour, as the whole tokenizer encodes it."""
    letters = [chr(c) for c in range(128, 0x20000) if K._is_one_piece(chr(c))]
    assert len(letters) > 40_000
    words = letters + [a + b for a, b in zip(letters, letters[1:])] + ["a" + x + "b" for x in letters]
    want = Tokenizer.from_file(FILE).encode_batch(words, add_special_tokens=False)
    assert K.Vocabulary(FILE).encode(words) == [e.ids for e in want]


def test_rows_of_one_doc_id_are_parted(spark, tmp_path):
    rows = [(None, f"text {i:03d} {'w ' * 50}") for i in range(200)]
    K.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), str(tmp_path / "t"), FILE)
    assert spark.read.parquet(str(tmp_path / "t")).select("part").distinct().count() > 1
    got = sorted((r.start, r.n_tokens) for r in K.read_tokens(spark, str(tmp_path / "t")).collect())
    assert [s for s, _ in got] == [sum(n for _, n in got[:i]) for i in range(200)]
