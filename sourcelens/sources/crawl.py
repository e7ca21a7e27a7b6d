"""A crawl over a table of fetched pages: first in, first out, level by level.

A page's place in the queue is the list of link numbers on the way to it. Within a level, lists in order are the queue's
order, so a level is one join with the pages, one with what has been visited, and no row needs a number over all. Links are
followed only from pages that have sections; a page that is not in the table is a failed fetch. Each level is a
written table, so a lost executor repeats no level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.functions import urls as U
from sourcelens.sources import parsers as P
from sourcelens.sources.scratch import shared_folder

VISITED = "url string, name string, way array<int>, status string, links array<string>"


def fetched(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, n_sections, links): links of the whole page in document order, sections of its main content."""
    p = pages.select("url", P.parse_page("url", "html").alias("p"))
    return p.select("url", F.size("p.sections").alias("n_sections"), F.col("p.links").alias("links"))


def crawl(pages: DataFrame, seed: str, most: int | None = None, same_origin: bool = True, pattern: str | None = None, depth: int | None = None) -> DataFrame:
    """pages(url, n_sections, links) -> (url, depth, way, status) of what the crawl visits.

    url: without fragment and trailing slash, by which pages are known; status: captured, empty (no sections) or failed (no
    such page); (depth, way) is the queue's order. The crawl ends when the queue is empty, or after the level in which
    most pages are captured; first() then cuts at the page that was the last. pattern is searched for in links.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    known = pages.withColumn("name", U.normalize_url(F.col("url"))).groupBy("name").agg(F.min_by(F.struct("n_sections", "links"), "url").alias("page"))
    # Written, so that pages are parsed once and not for each level anew.
    table = shared_folder(spark)
    known.write.parquet(table)
    known = spark.read.schema(known.schema).parquet(table)
    queue = spark.createDataFrame([(seed, [])], "url string, way array<int>").withColumn("name", U.normalize_url(F.col("url")))
    origin, step, captured = U.origin(F.lit(seed)), 0, 0
    while True:
        status = F.when(F.col("page").isNull(), "failed").when(F.col("page.n_sections") > 0, "captured").otherwise("empty")
        met = queue.join(known, "name", "left").select("url", "name", "way", status.alias("status"), F.when(F.col("page.n_sections") > 0, F.col("page.links")).alias("links"))
        met.write.parquet(f"{folder}/depth={step}")
        level = spark.read.schema(VISITED).parquet(f"{folder}/depth={step}")
        captured += level.where("status = 'captured'").count() if most is not None else 0
        if (most is not None and captured >= most) or step == depth:
            break
        visited = _visited(spark, folder)
        new = level.select("way", F.posexplode("links").alias("k", "url"))
        new = new.where(U.origin(F.col("url")) == origin) if same_origin else new
        new = new.where(F.regexp_like("url", F.lit(pattern))) if pattern else new
        new = new.select(F.array_append("way", F.col("k")).alias("way"), "url", U.normalize_url(F.col("url")).alias("name"))
        new = new.groupBy("name").agg(F.min(F.struct("way", "url")).alias("f")).select("f.url", "f.way", "name")
        queue = new.join(visited.select("name"), "name", "left_anti")
        if queue.isEmpty():
            break
        step += 1
    return _visited(spark, folder).select(F.col("name").alias("url"), "depth", "way", "status")


def _visited(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{VISITED}, depth int").parquet(folder)


def first(visited: DataFrame, most: int) -> DataFrame:
    """What a crawl that stops at its most-th captured page has seen: (url, ordinal, depth, status), ordinal null but for captured pages."""
    head = visited.where("status = 'captured'").orderBy("depth", "way").limit(most)
    kept = head.withColumn("ordinal", F.row_number().over(_all_in_order()))  # most rows at the utmost
    last = kept.where(F.col("ordinal") == most).first()
    if last is not None:
        way = F.array(*map(F.lit, last.way)) if last.way else F.array().cast("array<int>")
        visited = visited.where((F.col("depth") < last.depth) | ((F.col("depth") == last.depth) & (F.col("way") <= way)))
    return visited.join(F.broadcast(kept.select("url", "ordinal")), "url", "left").select("url", "ordinal", "depth", "status")


def _all_in_order():
    from pyspark.sql import Window

    return Window.orderBy("depth", "way")
