"""Playbooks on files: saves, renames and deletes in the order of their requests, each batch one version of the store.

Layout: manifests/part=<id> lists all playbooks as a batch of requests left them, steps/part=<id> holds the steps that the
batch saved, and commits/version=<n> names the batch that is version n. It is written last, so readers see a version
whole or not at all; of two writers that began at the same version the second one fails, and what it has
written is named by no version. Steps are never written again: renames and overwrites only change the list.

Requests that name the same playbooks, directly or over renames, are judged one after another with the names they touch
as state; others are independent of them and judged elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sourcelens.functions import text as T
from sourcelens.operators.runs import Fold, fold_runs

MANIFEST = "slug string, name string, source_url string, summary string, step_count long, part string, key long"
STEPS = "key long, ordinal int, sequence long, trigger string, diff_score double, start_s double, end_s double, caption_text string, keyframe binary"
REQUESTS = "request long, op string, name string, new_name string, overwrite boolean, source_url string, summary string"
JUDGED = StructType([StructField("request", LongType()), StructField("status", StringType()), StructField("slug", StringType()), StructField("name", StringType()), StructField("old_slug", StringType()), StructField("saved", LongType())])


class Requests(Fold):
    """The names that requests touch, and which stored playbook (by its slug) or save (by its request) each has become."""

    def __init__(self):
        self.there: dict[str, tuple] = {}

    def feed(self, stored, request, op, name, slug, new_name, new_slug, overwrite, steps) -> list[tuple]:
        if stored:
            self.there[slug] = (name, slug, None)
            return []
        return [(request, self.judge(request, op, name, slug, new_name, new_slug, overwrite, steps), None, None, None, None)]

    def judge(self, request, op, name, slug, new_name, new_slug, overwrite, steps) -> str:
        if not name or op == "rename" and not new_name:
            return "required"
        if op == "save":
            if not steps:
                return "no_steps"
            if slug in self.there and not overwrite:
                return "exists"
            self.there[slug] = (name, None, request)
            return "saved"
        if op == "rename" and name == new_name:
            return "identical"
        if slug not in self.there:
            return "not_found"
        if op == "delete":
            del self.there[slug]
            return "deleted"
        if op != "rename":
            return "unknown"
        if slug == new_slug:
            return "same_slug"
        if new_slug in self.there and not overwrite:
            return "exists"
        self.there[new_slug] = (new_name, *self.there.pop(slug)[1:])
        return "renamed"

    def end(self) -> list[tuple]:
        return [(None, None, slug, *found) for slug, found in self.there.items()]


def linked(pairs: DataFrame, cut) -> DataFrame:
    """(slug, own): the least slug that renames connect with each slug of pairs(a, b). cut writes a frame and reads it again.

    Each round hands the least name on to names two renames away and further, so a chain of n renames takes about log n rounds.
    """
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = cut(both)
    own = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("own")).withColumnRenamed("a", "slug"))
    while True:
        near = edges.join(own, F.col("b") == F.col("slug")).select(F.col("a").alias("slug"), F.col("own").alias("to"))
        jump = own.select("slug", F.col("own").alias("via")).join(own.select(F.col("slug").alias("via"), F.col("own").alias("to")), "via").select("slug", "to")
        low = near.union(jump).groupBy("slug").agg(F.min("to").alias("to"))
        new = cut(own.join(low, "slug", "left").select("slug", F.least("own", F.coalesce("to", "own")).alias("own"), (F.col("to") < F.col("own")).alias("moved")))
        own = new.select("slug", "own")
        if new.where("moved").isEmpty():
            return own


class PlaybookStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._cuts = spark, path.rstrip("/"), 0
        spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{self.path}/manifests/part=none")
        spark.createDataFrame([], STEPS).write.mode("ignore").parquet(f"{self.path}/steps/part=none")
        spark.createDataFrame([("none",)], "part string").write.mode("ignore").parquet(f"{self.path}/commits/version=0")

    def current(self) -> tuple[int, str]:
        """The last version, and the batch that made it."""
        return tuple(self.spark.read.schema("part string, version long").parquet(f"{self.path}/commits").orderBy(F.desc("version")).select("version", "part").first())

    def listed(self, part: str | None = None) -> DataFrame:
        """All playbooks of the current version."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/part={part or self.current()[1]}")

    def steps(self, playbooks: DataFrame | None = None) -> DataFrame:
        """The steps of listed playbooks, or of some of them."""
        own = (self.listed() if playbooks is None else playbooks).select("slug", "name", "part", "key")
        every = self.spark.read.schema(f"{STEPS}, part string").parquet(f"{self.path}/steps")
        return own.join(every, ["part", "key"]).drop("part", "key")

    def read(self, name: str, keyframes: int | None = None) -> DataFrame:
        """A playbook's steps, by its name or slug; empty if there is none. keyframes: how many of the last steps show theirs, none means all."""
        found = self.steps(self.listed().where(F.col("slug") == T.slugify(F.lit(name.strip()))))
        if keyframes is None:
            return found
        last = F.max("ordinal").over(Window.partitionBy("slug"))
        return found.withColumn("keyframe", F.when(F.col("ordinal") > last - max(0, keyframes), F.col("keyframe")))

    def _cut(self, part: str):
        def cut(df: DataFrame) -> DataFrame:
            self._cuts += 1
            path = f"{self.path}/work/part={part}/{self._cuts}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        return cut

    def apply(self, requests: DataFrame, steps: DataFrame, max_steps: int | None = None) -> DataFrame:
        """Carries out REQUESTS rows in their order as the next version; gives (request, status) of each.

        steps: request, sequence and the other columns of STEPS but key and ordinal; a save keeps the last max_steps of
        its steps by sequence, numbered from 1. Other requests have none.
        """
        version, before = self.current()
        new, listed = f"{version + 1}-{uuid.uuid4().hex}", self.listed(before)
        cut = self._cut(new)
        blank = F.lit("")
        r = requests.select("request", "op", F.trim(F.coalesce("name", blank)).alias("name"), F.trim(F.coalesce("new_name", blank)).alias("new_name"), F.coalesce("overwrite", F.lit(False)).alias("overwrite"), "source_url", "summary")
        r = r.withColumns({"slug": T.slugify(F.col("name")), "new_slug": F.when(F.col("op") == "rename", T.slugify(F.col("new_name")))})
        counts = steps.groupBy("request").agg(F.count("*").alias("n_steps"))
        r = cut(r.join(counts, "request", "left").withColumn("n_steps", F.coalesce("n_steps", F.lit(0))))
        own = linked(r.where("new_slug is not null").select(F.col("slug").alias("a"), F.col("new_slug").alias("b")), cut)
        touched = r.select("slug").union(r.where("new_slug is not null").select("new_slug")).distinct()
        stored = listed.join(touched, "slug", "left_semi")
        state = stored.select(F.lit(True).alias("stored"), F.lit(-1).cast("long").alias("request"), F.lit("").alias("op"), "name", "slug", F.lit("").alias("new_name"), F.lit("").alias("new_slug"), F.lit(False).alias("overwrite"), F.lit(0).cast("long").alias("n_steps"))
        asked = r.select(F.lit(False).alias("stored"), "request", "op", "name", "slug", "new_name", "new_slug", "overwrite", F.col("n_steps").cast("long").alias("n_steps"))
        keyed = state.union(asked).join(own, "slug", "left").withColumn("own", F.coalesce("own", "slug")).withColumn("_rank", F.when(F.col("stored"), 0).otherwise(1))
        values = ["stored", "request", "op", "name", "slug", "new_name", "new_slug", "overwrite", "n_steps"]
        judged = cut(fold_runs(keyed, "own", ["_rank", "request"], values, Requests, JUDGED))

        entries = judged.where("request is null").select("slug", "name", "old_slug", "saved")
        kept = entries.where("saved is null").select("slug", "name", "old_slug").join(listed.drop("name").withColumnRenamed("slug", "old_slug"), "old_slug").select("slug", "name", "source_url", "summary", "step_count", "part", "key")
        most = F.lit(max_steps if max_steps is not None else 1 << 62)
        saved = entries.where("saved is not null").join(r.select(F.col("request").alias("saved"), "source_url", "summary", "n_steps"), "saved")
        saved = saved.select("slug", "name", "source_url", F.nullif(F.trim(F.coalesce("summary", blank)), blank).alias("summary"), F.least("n_steps", most).alias("step_count"), F.lit(new).alias("part"), F.col("saved").alias("key"))
        saved = cut(saved)
        order = Window.partitionBy("key").orderBy("sequence")
        written = steps.withColumnRenamed("request", "key").join(saved.select("key", "step_count"), "key")
        written = written.withColumn("_n", F.count("*").over(Window.partitionBy("key"))).withColumn("ordinal", (F.row_number().over(order) - F.col("_n") + F.col("step_count")).cast("int")).where("ordinal > 0")
        written.select(*[c.split()[0] for c in STEPS.split(", ")]).write.parquet(f"{self.path}/steps/part={new}")
        untouched = listed.join(touched, "slug", "left_anti")
        untouched.unionByName(kept).unionByName(saved).write.parquet(f"{self.path}/manifests/part={new}")
        self.spark.createDataFrame([(new,)], "part string").write.parquet(f"{self.path}/commits/version={version + 1}")  # fails if another has committed it
        return judged.where("request is not null").select("request", "status")
