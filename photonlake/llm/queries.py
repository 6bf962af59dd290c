"""The registered queries of the corpus operators: each reads its whole tables and returns its operator's full result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm import context_mixing, decontamination, langid, license_scan, line_dedup, mixing, quality_bands, simhash_dedup, suffix_dedup, toxicity
from photonlake.session import ship, table


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.duplicate_lines(table(spark, sf_dir, "documents"), **line_dedup.WHOLE)
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "kept_doc_id", F.col("kept_line_no").cast("long").alias("kept_line_no"), "kept")


def op2_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_bands.judge(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.filter(fold(5) != 0))
    return langid.predict(docs.select("doc_id", (fold(5) == 0).alias("held_out"), "text"), profiles).drop("text")


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scored = context_mixing.score(table(spark, sf_dir, "documents"), fold(7) != 2)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs.filter(fold(5) != 0), labels.filter(fold(5) != 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return license_scan.find_licenses(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", F.col("n_shingles"), "containment")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), mixing.TARGET_WEIGHTS)
    return mixed.select("doc_id", "source", "mix_block", "mix_position")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_bands, op3_langid, op4_context_mixing, op5_toxicity, op6_license_scan, op7_simhash_dedup, op8_decontamination, op9_suffix_dedup, op10_mixing)}

#: Operators that are more than SQL can express are tested against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": """WITH items AS (SELECT item_id, md5(coalesce(text, '')) ik, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        sized AS (SELECT *, least(len(w), 5) l FROM items WHERE len(w) > 0),
        wanted AS (SELECT DISTINCT item_id, ik, l, array_to_string(w[i:i + l - 1], ' ') s FROM sized, unnest(range(1, len(w) - l + 2)) t(i)),
        sizes AS (SELECT item_id, ik, count(*) n_shingles FROM wanted GROUP BY ALL),
        docs AS (SELECT DISTINCT doc_id, md5(text) th, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM documents WHERE text IS NOT NULL),
        runs AS (SELECT DISTINCT doc_id, th, l, array_to_string(w[i:i + l - 1], ' ') s FROM docs, (SELECT DISTINCT l FROM sized), unnest(range(1, len(w) - l + 2)) t(i)),
        met AS (SELECT doc_id, th, item_id, ik, count(*) n_shared FROM runs JOIN wanted USING (l, s) GROUP BY ALL)
      SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles containment FROM met JOIN sizes USING (item_id, ik) WHERE n_shared >= 0.8 * n_shingles""",
}
