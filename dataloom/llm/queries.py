"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataloom.llm import decontamination, filter_audit, html_text, language_id, license_scan, mixing, passages, prefix_trie, quality, simhash, sketches, token_counts, warc
from dataloom.llm.common import shared_folder, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = token_counts.prefix_token_steps(table(spark, sf_dir, "documents"), "doc_id", "text")
    n = F.col("n_tokens")
    return steps.select("doc_id", "n_bytes", n, token_counts.over_limit(n, 512).alias("over_limit"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.n_hit_words()
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
grams AS (
  SELECT d.doc_id, s.n, i, array_to_string(d.w[i : i + s.n - 1], ' ') AS gram
  FROM (SELECT d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM doc_words d, (SELECT DISTINCT n FROM windows) s) d
  JOIN (SELECT DISTINCT n FROM windows) s ON d.n = s.n),
hits AS (SELECT g.doc_id, g.n, g.i, w.item_id FROM grams g JOIN windows w ON g.n = w.n AND g.gram = w.gram),
positions AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN positions p USING (doc_id) LEFT JOIN items t USING (doc_id)
"""


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_pairs(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archives")
    warc.write_arc(table(spark, sf_dir, "pages"), f"{folder}/arc")
    warc.arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc")
    records = warc.resolved_revisits(warc.read_warc(spark, f"{folder}/warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH sized AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM ranked
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    codes = language_id.fit(docs.where(~language_id.held_out("doc_id")), key=F.col("doc_id"))
    found = language_id.identify(docs, codes)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorers = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs.select("doc_id", "text"), scorers).select("doc_id", "quality", "toxicity", "keep")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), [*license_scan.PHRASES, *license_scan.NOTICES])
    matches, places = F.col("matches"), license_scan.places_of(F.col("matches"))
    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        license_scan.labels_of(license_scan.phrase_matches(matches)).alias("base_labels"), license_scan.labels_of(matches).alias("labels"),
        license_scan.best_containment(matches).alias("score"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    turns = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    rebuilt = prefix_trie.with_borrowed_beginnings(turns, conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8)
    return prefix_trie.prefix_trie(rebuilt).withColumnRenamed("saved_bytes", "saved_tokens")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_quality_classifier, op3_substring_dedup, op4_decontamination, op5_warc, op6_language_id,
        op7_simhash_near_dedup, op8_html_extraction, op9_mixing, op10_document_fingerprints, op11_license_scan, op12_filter_audit, op13_conversation_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": OP4_SQL, "op5_warc": OP5_SQL, "op9_mixing": mixing.ORACLE_SQL, "op11_license_scan": license_scan.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL,
        "op13_conversation_trie": prefix_trie.ORACLE_SQL,
    }
