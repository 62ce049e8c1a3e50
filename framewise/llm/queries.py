"""The operators as named queries over the whole shared tables, with their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import (
    alignment, bbit_minhash, curve_ann, exact_index, license_scan, line_spread, lm_scoring, merkle, mixing, packing, passage_dedup, preference, quality_fm,
)
from framewise.llm.shared import Scratch, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(documents(spark, sf_dir), Scratch(spark, "mixing")))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary(), with_ids=False).drop("ids")


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = documents(spark, sf_dir), remainder(7)
    return lm_scoring.score(docs, Scratch(spark, "lm"), held_out=rest == 2, tuning=rest == 5)


@query("op5_exact_index", """
WITH rows AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM rows JOIN groups USING (text_sha256)
""")
def op5_exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = exact_index.DigestIndex(spark)
    index.admit(docs)
    rows = exact_index.group_rows(docs, index)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op8_line_spread", r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS body FROM lines),
wide AS (SELECT body FROM keyed WHERE body <> '' GROUP BY body HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 5),
marked AS (SELECT k.*, w.body IS NOT NULL AS drop_it FROM keyed k LEFT JOIN wide w ON k.body = w.body AND k.body <> '')
SELECT m.doc_id, CASE WHEN any_value(length(d.text)) > 0 THEN count(*) ELSE 0 END AS n_lines,
       CAST(count(*) FILTER (WHERE drop_it) AS BIGINT) AS n_removed,
       CASE WHEN any_value(d.text) IS NULL THEN NULL
            ELSE coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it), '') END AS text
FROM marked m JOIN documents d USING (doc_id) GROUP BY m.doc_id
""")
def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_lines(documents(spark, sf_dir), Scratch(spark, "spread")).select("doc_id", "n_lines", "n_removed", "text")


@query("op10_bbit_minhash")
def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.document_components(documents(spark, sf_dir), Scratch(spark, "near"), k=4, percent=80)


@query("op9_quality_fm")
def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = remainder(5) == 0
    model = quality_fm.train(docs, labels.where(~held_out), usable=~held_out)
    rows = quality_fm.score(docs, model, carry=["doc_id"])
    rows = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("quality_score").alias("score"))
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_passage_dedup")
def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeats(documents(spark, sf_dir), Scratch(spark, "passages")).drop("key")


@query("op6_curve_ann")
def op6_curve_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return curve_ann.nearest(table, F.col("vec_id") % 50 == 0, Scratch(spark, "curves"))


@query("op4_preference", r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
openings AS (SELECT *, min(conv_id) OVER (PARTITION BY role, text) AS leader FROM turns WHERE pos = 0),
pairs AS (
  SELECT leader AS chosen_id, conv_id AS rejected_id FROM openings WHERE conv_id <> leader
  UNION
  SELECT a.conv_id, b.conv_id FROM openings a JOIN openings b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
places AS (
  SELECT chosen_id, rejected_id, pos FROM pairs JOIN turns ON conv_id = chosen_id
  UNION
  SELECT chosen_id, rejected_id, pos FROM pairs JOIN turns ON conv_id = rejected_id),
prefixes AS (
  SELECT p.chosen_id, p.rejected_id,
         coalesce(min(p.pos) FILTER (WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text), max(p.pos) + 1) AS n
  FROM places p LEFT JOIN turns c ON c.conv_id = p.chosen_id AND c.pos = p.pos
  LEFT JOIN turns r ON r.conv_id = p.rejected_id AND r.pos = p.pos GROUP BY 1, 2),
sides AS (
  SELECT chosen_id, rejected_id, n, 'c' AS side, chosen_id AS conv_id FROM prefixes
  UNION ALL SELECT chosen_id, rejected_id, n, 'r', rejected_id FROM prefixes),
parts AS (
  SELECT s.*, t.pos, t.role, t.text, t.head, t.head || t.text || '<|end|>' || chr(10) AS body, t.pos >= s.n AS own,
         coalesce(sum(length(t.head || t.text) + 8) FILTER (WHERE t.pos >= s.n) OVER
           (PARTITION BY s.chosen_id, s.rejected_id, side ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM sides s JOIN turns t ON t.conv_id = s.conv_id),
spans AS (
  SELECT *, CAST(base + length(head) AS BIGINT) || '-' || CAST(base + length(head) + length(text) + 8 AS BIGINT) AS span FROM parts)
SELECT chosen_id, rejected_id, CAST(n AS BIGINT) AS prefix_turns,
       coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE side = 'c' AND NOT own), '') AS prompt,
       coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE side = 'c' AND own), '') AS chosen,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE side = 'c' AND own AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE side = 'r' AND own), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE side = 'r' AND own AND role = 'assistant'), '') AS rejected_spans
FROM spans GROUP BY chosen_id, rejected_id, n
""")
def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = Scratch(spark, "preference").keep(preference.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "threads")
    rows = preference.format_pairs(threads, preference.pairs_by_opening(threads))
    plain = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return rows.withColumns({"chosen_spans": plain("chosen_spans"), "rejected_spans": plain("rejected_spans")})


@query("op11_merkle_manifest", r"""
WITH RECURSIVE
parts AS (
  SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
         || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
         coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS chars,
         coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') AS more,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
         list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
  FROM documents),
summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, b:
    list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z:
      CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS crc
  FROM parts),
leaves AS (
  SELECT doc_id, lang, sha256(head || chars || tail) AS leaf,
         CASE WHEN crc % 7 = 0 THEN sha256(head || more || tail) ELSE sha256(head || chars || tail) END AS claimed FROM summed),
numbered AS (
  SELECT row_number() OVER () AS row_no, *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, idx, n, leaf AS h FROM numbered
  UNION ALL
  SELECT a.lang, a.level + 1, a.idx // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
  FROM nodes a LEFT JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND b.idx = a.idx + 1 WHERE a.n > 1 AND a.idx % 2 = 0),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT a.level + 1, a.idx // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
  FROM tops a LEFT JOIN tops b ON b.idx = a.idx + 1 WHERE a.n > 1 AND a.idx % 2 = 0),
climb AS (
  SELECT row_no, lang, 0 AS level, idx, n, claimed AS h, '' AS siblings FROM numbered
  UNION ALL
  SELECT c.row_no, c.lang, c.level + 1, c.idx // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.idx % 2 = 0 THEN c.h || coalesce(s.h, '') ELSE s.h || c.h END), c.siblings || coalesce(s.h, '')
  FROM climb c LEFT JOIN (SELECT * FROM nodes) s
    ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.idx = c.idx + 1 - 2 * (c.idx % 2) WHERE c.n > 1),
ascent AS (
  SELECT c.row_no, 0 AS level, s.idx, s.n, c.h, c.siblings FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.row_no, c.level + 1, c.idx // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.idx % 2 = 0 THEN c.h || coalesce(s.h, '') ELSE s.h || c.h END), c.siblings || coalesce(s.h, '')
  FROM ascent c LEFT JOIN (SELECT * FROM tops) s ON s.level = c.level AND s.idx = c.idx + 1 - 2 * (c.idx % 2) WHERE c.n > 1)
SELECT d.doc_id, d.leaf, s.subroot, t.h AS root, sha256(a.siblings) AS proof_sha256, a.h AS folded_root, a.h = t.h AS verified
FROM numbered d JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang JOIN ascent a ON a.row_no = d.row_no AND a.n = 1, (SELECT h FROM tops WHERE n = 1) t
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = F.when(remainder(7) == 0, merkle.leaf(n_chars=merkle.more_chars()))
    found = merkle.manifest(documents(spark, sf_dir), Scratch(spark, "merkle"), carry={"claimed": claimed})
    folded = merkle.fold_path(F.coalesce(F.lower(F.hex("claimed")), "leaf"))
    rows = found.select("doc_id", "leaf", "subroot", "root", merkle.path_digest().alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_license_scan")
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.detect(documents(spark, sf_dir))
    labels = F.array_distinct(F.concat("base_labels", F.transform("detections", lambda d: d["label"])))
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"), joined(labels).alias("labels"), "score")


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), Scratch(spark, "alignment"), vocabulary(), vocabulary("piece_bpe_32k.model"))
