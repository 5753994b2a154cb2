"""Registered queries of the corpus operators: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, class_lm, decontaminate, html_crf, jaccard, merkle, packing, quality, secret_scan, simhash, token_store, toxicity, url_tree
from .work import crc32_mod, stash, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids: one row per piece."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows inside every document: hit words, items and the verdict."""
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op2_decontaminate"] = rf"""
  WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  k AS (SELECT DISTINCT item, list_slice(w, i, i + least(13, len(w)) - 1) AS k FROM b, unnest(range(1, greatest(2, len(w) - 11))) t(i) WHERE len(w) > 0),
  l AS (SELECT DISTINCT len(k) AS l FROM k),
  x AS (SELECT doc_id, i, l, list_slice(w, i, i + l - 1) AS k FROM d, l, unnest(range(1, len(w) - l + 2)) t(i)),
  h AS (SELECT doc_id, i, l, item FROM x JOIN k USING (k)),
  n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, l FROM h), unnest(range(i, i + l)) t(p) GROUP BY 1),
  m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
         coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base rule and certified cutoffs on every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed patterns and tokens that pass the randomness battery."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secret_scan.KINDS], F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.written(F.col("spans")).alias("spans"))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL, by rules and by the tree of path templates."""
    return url_tree.judge(table(spark, sf_dir, "pages"))


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their 5-word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op8_ngram_jaccard"] = rf"""
  WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s FROM d, unnest(range(1, greatest(2, len(w) - 3))) t(i) WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
  r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
  SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of the labelled documents that are not held out."""
    docs, fold = table(spark, sf_dir, "documents"), crc32_mod("doc_id", 5)
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0))
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to shards, found by the index and read back."""
    return token_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under the class model of the documents that are not held out."""
    fold = crc32_mod("doc_id", 7)
    scored = class_lm.score_corpus(table(spark, sf_dir, "documents"), fold != 2)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the trained random field."""
    pages = table(spark, sf_dir, "pages")
    found = html_crf.extract(pages.select(F.struct("page_id", "url").alias("page"), "html"), html_crf.trained(), key="page")
    return found.select("page.page_id", "page.url", "text", F.length("text").cast("bigint").alias("n_chars"))


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; the text of every third one is altered and must be found out."""
    altered = F.when(crc32_mod("doc_id", 3) == 0, F.translate("text", _UPPER, _SMALL)).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, sf_dir, "documents"), {"text": altered})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def _written(text: str) -> str:
    columns = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"


# crc32 of the decimal id, bit by bit: eight shifts for each digit
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda s, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384), xor(s, b)), 4294967295))"""


def _tree(name: str, start: str) -> str:
    """Recursive tables of a tree: name (part, lvl, idx, n, node), and name_s with the siblings left and right of each node."""
    return f"""{name} AS ({start} UNION ALL
      SELECT part, lvl + 1, idx // 8, any_value((n + 7) // 8), sha256(string_agg(node, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY part, lvl, idx // 8),
  {name}_s AS (SELECT a.part, a.lvl, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
                      coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
               FROM {name} a LEFT JOIN {name} b ON a.part = b.part AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 AND a.idx <> b.idx WHERE a.n > 1 GROUP BY 1, 2, 3)"""


def _folds(name: str, tree: str, start: str) -> str:
    return f"""{name} AS ({start} UNION ALL
      SELECT place, f.part, f.lvl + 1, f.idx // 8, sha256(l || h || r), proof || l || r FROM {name} f JOIN {tree}_s s ON s.part = f.part AND s.lvl = f.lvl AND s.idx = f.idx)"""


SQL["op13_merkle_manifest"] = f"""
  WITH RECURSIVE c AS (SELECT doc_id, coalesce('1' || lang, '0') AS part, {_written('text')} AS leaf,
                              {_written(f"CASE WHEN {_CRC} % 3 = 0 THEN translate(text, '{_UPPER}', '{_SMALL}') ELSE text END")} AS new FROM documents),
  d AS (SELECT *, row_number() OVER (ORDER BY part, doc_id NULLS FIRST, leaf) AS place, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
               count(*) OVER (PARTITION BY part) AS n FROM c),
  {_tree("t", "SELECT part, 0 AS lvl, idx, n, leaf AS node FROM d")},
  e AS (SELECT part, lvl, node, row_number() OVER (ORDER BY encode(part)) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
  {_tree("u", "SELECT 0 AS part, 0 AS lvl, idx, n, node FROM e")},
  {_folds("f", "t", "SELECT place, part, 0 AS lvl, idx, new AS h, '' AS proof FROM d")},
  {_folds("g", "u", "SELECT place, 0 AS part, 0 AS lvl, e.idx, h, proof FROM f JOIN e ON e.part = f.part AND e.lvl = f.lvl")},
  x AS (SELECT node AS root, lvl FROM u WHERE n = 1)
  SELECT doc_id, leaf, e.node AS subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
  FROM d JOIN e ON e.part = d.part JOIN x ON true JOIN g ON g.place = d.place AND g.lvl = x.lvl"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' ids of every document aligned by common byte ends, with the counts of linked pairs over all documents."""
    aligned = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))
    aligned = stash(aligned.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256").withColumn("row", F.monotonically_increasing_id()), "aligned")
    return alignment.score(aligned, alignment.pair_counts(aligned), "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of those that differ in at most two bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
