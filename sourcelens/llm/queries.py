"""The queries of this folder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_filters, exact_dedup, katz, langid, mixing, ngram_join, packing, periodic, quality, substring_dedup, suffix_cover, token_count, whitening

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op4_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.near_passages(table(spark, sf_dir, "documents"))


def op8_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def made_periodic(ident: Column, text: Column) -> Column:
    """The text, for a tenth of identifiers with a tail that repeats; a null identifier keeps its text."""
    h = F.crc32(ident.cast("string"))
    g = F.floor(h / 10)

    def turned(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.sequence(F.lit(0).cast("bigint"), n - 1)
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(at, lambda i: F.get(words, place(i).cast("int"))), " ")

    # The array around the words makes them a lambda's variable, so they are found once.
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.when((h % 10 == 0) & text.rlike(WORD), F.get(F.transform(words, turned), F.lit(0))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs)
    higher = lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), higher))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op13_suffix_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_cover.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_katz_backoff, op3_language_id, op4_quality_pu, op5_cap_filters, op6_mix_sources, op7_token_counts, op9_near_passages, op8_pack_windows, op10_exact_dedup, op11_periodic_runs, op12_jacobi_whitening, op13_suffix_cover)}

ORACLE_SQL = {
    "op6_mix_sources": rf"""
WITH own AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(sha256('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
named AS (
  SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) AS i FROM own GROUP BY source)),
ordered AS (
  SELECT *, sum(source_size) OVER () AS words, CAST(cap AS DOUBLE) / weight AS ratio,
         sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy
  FROM named),
filled AS (SELECT *, left_over / heavy AS own_level FROM ordered),
level AS (SELECT own_level AS level FROM filled WHERE own_level * weight <= cap ORDER BY ratio, i LIMIT 1),
aimed AS (
  SELECT i, source, source_size, words, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM level) * weight, CAST(cap AS DOUBLE))) AS target FROM filled),
edges AS (
  SELECT *, sum(target) OVER () AS total, coalesce(sum(target) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM aimed),
ranges AS (
  SELECT *, CAST(round(cum / total * {mixing.POINTS}) AS BIGINT) AS lo, CAST(round((cum + target) / total * {mixing.POINTS}) AS BIGINT) AS hi,
         greatest({mixing.LEAST}, least({mixing.MOST}, words // {mixing.BLOCKS})) AS block_size FROM edges),
slots AS (
  SELECT i, count(*) AS m FROM ranges, (SELECT unnest(range(CAST(ceil(CAST(floor(1.5 * words) AS DOUBLE) / block_size) AS BIGINT))) AS slot FROM (SELECT max(words) AS words, max(block_size) AS block_size FROM ranges))
  WHERE lo <= slot % {mixing.POINTS} * {mixing.STEP} % {mixing.POINTS} AND slot % {mixing.POINTS} * {mixing.STEP} % {mixing.POINTS} < hi GROUP BY i),
placed AS (
  SELECT o.doc_id, o.size, r.source_size, r.target, r.block_size, coalesce(m, 0) AS m, ceil(CAST(r.source_size AS DOUBLE) / r.block_size) AS n,
         coalesce(sum(o.size) OVER (PARTITION BY r.i ORDER BY o.h, o.doc_id, o.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM own o JOIN ranges r ON o.source IS NOT DISTINCT FROM r.source LEFT JOIN slots s ON s.i = r.i)
SELECT doc_id, size, source_size, target, CAST(
  CASE WHEN size = 0 THEN 0 ELSE
    greatest(0, least(place + size, least(m, n) * block_size) - place) + greatest(0, least(place + size, greatest(0, least(m - n, n)) * block_size) - place) END AS BIGINT) AS taken
FROM placed
""",
    "op10_exact_dedup": f"""
WITH own AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM own
""",
}
