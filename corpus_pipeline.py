"""Five stages from raw documents to packed training windows; part of the operators for training text.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns rows with the columns of documents,
the last one pieces of windows. Within a stage a row is known by a hash of all its columns, so rows without an
identifier, or with one that others have too, are judged by themselves; rows that are equal in all columns share their
fate. An empty table gives an empty result, and further columns are dropped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import exact_dedup, mixing, ngram_join, packing, quality
from sourcelens.llm.common import LOWER, UPPER, word_spans, blocks, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express a fitted classifier.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and row_key, a hash of them all. Spark's hash passes over nulls, so where they stand goes in too."""
    return docs.select(*COLUMNS).withColumn("row_key", F.xxhash64(*COLUMNS, *[F.isnull(c) for c in COLUMNS]))


def few_or_shuffled(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= ngram_join.FEW else df


def once(docs: DataFrame) -> DataFrame:
    """keyed rows without repeats; texts are shuffled only for keys that occur again."""
    again = written(docs.groupBy("row_key").count().where("count > 1").select("row_key"))
    if again.isEmpty():
        return docs
    again = few_or_shuffled(again)
    alone = docs.join(again, "row_key", "left_anti").select(*docs.columns)
    return alone.union(docs.join(again, "row_key", "left_semi").dropDuplicates(["row_key", *COLUMNS]).select(*docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject."""
    own = keyed(docs)
    scores = quality.quality_scores(own, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col="row_key")
    rejected = written(scores.where("predicted = 0").select("row_key").distinct())
    return own.join(few_or_shuffled(rejected), "row_key", "left_anti").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier; of several such rows the one with the smallest key."""
    own = keyed(docs).withColumn("sha", F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), 256))
    found = exact_dedup.exact_dedup(docs).select("doc_id", F.col("text_sha256").alias("sha"), "kept").distinct()
    dropped = few_or_shuffled(written(found.where("not kept")).withColumnRenamed("doc_id", "d_id").withColumnRenamed("sha", "d_sha"))
    rest = own.join(dropped, (F.col("sha") == F.col("d_sha")) & F.col("doc_id").eqNullSafe(F.col("d_id")), "left_anti")
    marks = own.select("doc_id", "sha", "row_key")
    repeated = marks.groupBy("doc_id", "sha").agg(F.count("*").alias("n"), F.min("row_key").alias("first")).where("n > 1")
    repeated = written(repeated.select(F.col("doc_id").alias("r_id"), F.col("sha").alias("r_sha"), "first"))
    if not repeated.isEmpty():
        same = (F.col("sha") == F.col("r_sha")) & F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("row_key") != F.col("first"))
        rest = once(rest.join(few_or_shuffled(repeated), same, "left_anti"))
    return rest.select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that links connect the one with the smallest identifier, null last."""
    own = keyed(docs)
    groups = written(ngram_join.ngram_jaccard_join(own, id_col="row_key").select("row_key", "component_id").distinct())
    several = groups.groupBy("component_id").count().where("count > 1").select("component_id")
    members = groups.join(several, "component_id").join(own.select("row_key", "doc_id").distinct(), "row_key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = members.groupBy("component_id").agg(F.min_by("row_key", order).alias("row_key"))
    dropped = written(members.select("row_key").join(kept.select("row_key"), "row_key", "left_anti").distinct())
    return own.join(few_or_shuffled(dropped), "row_key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and pass that takes it, with the words that are taken, in the schedule's order."""
    own = keyed(docs)
    parts = mixing.plan(own, id_col="row_key")
    mine = parts["documents"].select("i", "bucket", "ordinal", F.col("id").alias("row_key"), "size")
    spans = parts["takes"].groupBy("i", "bucket", "ordinal", "epoch").agg(F.min("slot").alias("slot"), F.min("start").alias("start"), F.sum("words").alias("words"))
    spans = written(spans.join(mine, ["i", "bucket", "ordinal"]).select("row_key", "size", "slot", "start", "words"))
    mixed = once(own).join(few_or_shuffled(spans), "row_key").withColumn("whole", F.col("words") == F.col("size"))
    slots = (spans.agg(F.max("slot")).first()[0] or 0) + 1
    tasks = max(1, min(slots, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Slots are spread evenly over sources, and so over ranges of slots: no range needs to be sampled.
    dealt = mixed.withColumn("task", F.floor(F.col("slot") * tasks / slots).cast("int")).repartitionById(tasks, "task")
    ordered = dealt.sortWithinPartitions("slot", "row_key").select(*COLUMNS, "slot", "start", "words", "whole")
    cut = ordered.mapInArrow(_cut, "doc_id bigint, text string, lang string, source string, n_chars bigint, whole boolean")
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("whole"), F.col("n_chars")).otherwise(F.length("text")).cast("bigint").alias("n_chars"))


def _cut(batches):
    """The texts' words from start on, with what stands between them."""
    names = [*COLUMNS, "whole"]
    for batch in batches:
        for lo, hi, data, offs in blocks(batch.column(1)):  # a piece of about 1 MB goes before the next is cut
            start, words, whole = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in (6, 7, 8))
            at, first = word_spans(data, offs)
            out = []
            for k in range(hi - lo):
                a, b = offs[k], offs[k + 1]
                if not whole[k]:
                    i, j = first[k] + start[k], first[k] + start[k] + words[k]
                    a, b = at[i], at[j] if j < first[k + 1] else b
                out.append(data[a:b].tobytes().decode())
            rest = (batch.column(k).slice(lo, hi - lo) for k in (2, 3, 4, 8))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.string()), *rest], names=names)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
