"""Registered queries of the operators, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import audio, decontaminate, jaccard, lattice, merkle, mixing, phrases, pii, repeats, sets, tokens, toxicity, warc
from tidemark.llm import textops as X

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.substring_dedup(_read(spark, sf_dir, "documents"), 35, keep_text=False)
    return out.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", "kept_sha256")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = X.new_path(spark, "warc")
    warc.write_warc(_read(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_warc(spark, path))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.link_documents(_read(spark, sf_dir, "documents"), sets.Similarity(3, 9, 10))
    return out.select("doc_id", "n_shingles", "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("text_key"))
    spans = pii.find_pii(_read(spark, sf_dir, "documents"))
    s = docs.join(spans, X.same_row(docs, spans), "left").select(docs["doc_id"], F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,stop:bigint>>")).alias("s"))
    base = F.filter("s", lambda x: x["kind"] < 4)
    counts = [pii.counted(F.col("s"), k).alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    counts += [pii.counted(F.col("s"), 4).alias("n_id"), F.size("s").cast("long").alias("n_spans")]
    return s.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("s")).alias("spans"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = X.new_path(spark, "tokens")
    tokens.write_tokens(_read(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return tokens.read_tokens(spark, path)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_contamination(docs, _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    sounds, pcm = X.new_path(spark, "audio"), X.new_path(spark, "pcm")
    audio.store_texts(_read(spark, sf_dir, "documents"), sounds)
    audio.write_pcm(spark, sounds, pcm)
    return audio.read_features(spark, pcm)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.suffix_dedup(_read(spark, sf_dir, "documents"), 400, keep_text=False)
    return out.select("doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    values = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]
    out = merkle.merkle_manifest(_read(spark, sf_dir, "documents"), F.when(hit & F.col("n_chars").isNotNull(), merkle.leaf_digest(values)))
    proof = F.sha2(F.array_join("siblings", "").cast("binary"), 256).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op13_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice.lattice_scores(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_warc, op3_ngram_jaccard, op4_pii, op5_token_ids, op6_toxicity, op7_mixing, op8_decontaminate, op9_audio, op10_suffix_dedup, op11_merkle, op12_phrases, op13_lattice)
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) t(i)),
        hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
        tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM tok ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op2_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS f FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
          CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM q""",
    "op8_decontaminate": r"""
        WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
               FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
        ks AS (SELECT DISTINCT k FROM bw),
        hits AS (SELECT d.doc_id, t.i, bw.item_id, ks.k FROM d CROSS JOIN ks, unnest(range(1, len(d.w) - ks.k + 2)) t(i)
                 JOIN bw ON bw.k = ks.k AND bw.s = array_to_string(d.w[t.i:t.i + ks.k - 1], ' ')),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
        it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hits GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
          sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_merkle": r"""
        WITH RECURSIVE bit AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bit WHERE k < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
        dig AS (SELECT doc_id, text, lang, source, n_chars, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS b FROM documents),
        crc(id, t, b, j, c) AS (SELECT DISTINCT doc_id, t, b, 1, 4294967295 FROM dig, tab UNION ALL SELECT id, t, b, j + 1, xor(c // 256, t[(xor(c, b[j]) % 256) + 1]) FROM crc WHERE j <= len(b)),
        hit AS (SELECT id FROM crc WHERE j = len(b) + 1 AND xor(c, 4294967295) % 7 = 0),
        f AS (SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a, coalesce(strlen(text) || ':' || text, '-') AS z FROM documents),
        leaf AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS h,
          sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || z) AS h1 FROM f),
        pos AS (SELECT doc_id, tree, h, CASE WHEN doc_id IN (SELECT id FROM hit) THEN h1 ELSE h END AS changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
        lv(tree, l, p, h, n) AS (SELECT tree, 0, p, h, n FROM pos UNION ALL SELECT tree, l + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY tree, l, p // 2, n),
        sub AS (SELECT tree, h, l AS top, row_number() OVER (ORDER BY encode(tree)) - 1 AS p, count(*) OVER () AS n FROM lv WHERE n = 1),
        up(l, p, h, n) AS (SELECT 0, p, h, n FROM sub UNION ALL SELECT l + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY l, p // 2, n),
        every AS (SELECT tree, l, p, h FROM lv UNION ALL SELECT '', l, p, h FROM up),
        top AS (SELECT h AS root, l AS height FROM up WHERE n = 1),
        step AS (SELECT pos.tree, pos.p AS j, s.l AS k, pos.p // (1::BIGINT << s.l) AS q, pos.tree AS t, s.l FROM pos JOIN sub USING (tree), unnest(range(0, sub.top)) s(l)
          UNION ALL SELECT pos.tree, pos.p, sub.top + s.l, sub.p // (1::BIGINT << s.l), '', s.l FROM pos JOIN sub USING (tree), top, unnest(range(0, top.height)) s(l)),
        sib AS (SELECT step.tree, j, k, q % 2 AS side, coalesce(e.h, '') AS h FROM step LEFT JOIN every e ON e.tree = step.t AND e.l = step.l AND e.p = xor(step.q, 1)),
        path AS (SELECT tree, j, list(h ORDER BY k) AS s, list(side ORDER BY k) AS d FROM sib GROUP BY tree, j),
        fold(tree, j, k, h, s, d) AS (SELECT pos.tree, pos.p, 0, changed, coalesce(s, []), coalesce(d, []) FROM pos LEFT JOIN path ON path.tree = pos.tree AND path.j = pos.p
          UNION ALL SELECT tree, j, k + 1, sha256(CASE WHEN d[k + 1] = 1 THEN s[k + 1] || h ELSE h || s[k + 1] END), s, d FROM fold WHERE k < len(s))
        SELECT pos.doc_id, pos.h AS leaf, sub.h AS subroot, root, sha256(array_to_string(fold.s, '')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
        FROM pos JOIN sub ON sub.tree = pos.tree JOIN fold ON fold.tree = pos.tree AND fold.j = pos.p AND fold.k = len(fold.s), top""",
    "op12_phrases": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM d),
        f AS MATERIALIZED (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM w, unnest([1, 2, 3, 4]) t(m), unnest(range(1, greatest(len(w) - m + 2, 1))) u(i) GROUP BY ALL),
        h AS MATERIALIZED (SELECT * FROM f WHERE a >= 30),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM h WHERE m > 1),
        cut AS (SELECT c.lang, c.m, c.phrase, c.a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, unnest(range(1, c.m)) t(k)),
        s AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * cut.a) // (x.a + y.a))::BIGINT AS score FROM cut JOIN h x ON x.lang = cut.lang AND x.phrase = cut.x JOIN h y ON y.lang = cut.lang AND y.phrase = cut.y),
        b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        part AS (SELECT c.lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(c.a) AS most FROM c, unnest(range(2, c.m)) t(j), unnest(range(1, c.m - j + 2)) u(i) GROUP BY ALL),
        v AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN part ON part.lang = b.lang AND part.phrase = b.phrase WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
        SELECT v.lang, rank, phrase, a, l, r, n, score FROM v JOIN n USING (lang) WHERE rank <= 2000""",
}
