"""Keywords of playbooks, by counts of tokens and neighbouring pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from sourcelens.functions import text as T

MOST, CONSIDERED = 5, 20


def section_parts(sections: DataFrame) -> DataFrame:
    """sections(playbook_id, ordinal, text, source_kind) -> (playbook_id, pass, ordinal, text): headings twice, then bodies.

    Videos have no headings. A body is the first sentence of what follows heading and address, up to 25 words, without URLs.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    own = sections.withColumn("text", text).where("text <> ''").withColumn("video", F.col("source_kind").eqNullSafe(F.lit("youtube_video")))
    after = F.element_at(F.split("text", " / ", 3), -1)
    body = T.first_sentence(T.strip_urls(F.when(F.col("video"), F.col("text")).otherwise(after)))
    heading = F.when(~F.col("video"), T.doc_heading(F.col("text")))
    parts = own.select("playbook_id", "ordinal", F.posexplode(F.array(heading, heading, body)).alias("pass", "text"))
    return parts.where("text <> ''").select("playbook_id", "pass", "ordinal", "text")


def counts(parts: DataFrame, width: int = 4096) -> DataFrame:
    """parts(playbook_id, pass, ordinal, text) -> (playbook_id, phrase, words, n, first) over a playbook's whole stream.

    Single tokens and pairs inside a part are counted by plain aggregation. A pair across parts is made of a part's last
    token and the next one's first: by a window inside buckets of width ordinals, and by one over the buckets.
    """
    rows = parts.withColumn("t", T.keyword_tokens(F.col("text"))).where(F.size("t") > 0).select("playbook_id", "pass", "ordinal", "t")
    n = F.size("t")
    at = lambda k: F.struct("pass", "ordinal", k.cast("int").alias("k"))
    pair = F.transform(F.when(n > 1, F.slice("t", F.lit(1), n - 1)).otherwise(F.array().cast("array<string>")), lambda x, i: F.concat(x, F.lit(" "), F.get(F.col("t"), i + 1)))
    single = rows.select("playbook_id", F.posexplode("t").alias("k", "phrase"), F.lit(1).alias("words"), "pass", "ordinal")
    inside = rows.select("playbook_id", F.posexplode(pair).alias("k", "phrase"), F.lit(2).alias("words"), "pass", "ordinal")
    ends = rows.select("playbook_id", "pass", "ordinal", F.floor(F.col("ordinal") / width).alias("bucket"), F.get("t", F.lit(0)).alias("head"), F.element_at("t", -1).alias("tail"), (n - 1).alias("k"))
    ends = ends.withColumn("next", F.lead("head").over(Window.partitionBy("playbook_id", "pass", "bucket").orderBy("ordinal")))
    heads = ends.groupBy("playbook_id", "pass", "bucket").agg(F.min_by("head", "ordinal").alias("head"))
    heads = heads.select(F.col("playbook_id").alias("p"), F.col("pass").alias("q"), F.col("bucket").alias("b"), F.lead("head").over(Window.partitionBy("playbook_id").orderBy("pass", "bucket")).alias("over"))
    same = F.col("playbook_id").eqNullSafe(F.col("p")) & (F.col("pass") == F.col("q")) & (F.col("bucket") == F.col("b"))
    seams = ends.where("next is not null").select("playbook_id", "k", "tail", "next", "pass", "ordinal").union(ends.where("next is null").join(heads, same).select("playbook_id", "k", "tail", "over", "pass", "ordinal"))
    seams = seams.where("next is not null").select("playbook_id", "k", F.concat_ws(" ", "tail", "next").alias("phrase"), F.lit(2).alias("words"), "pass", "ordinal")
    return single.union(inside).union(seams).groupBy("playbook_id", "phrase", "words").agg(F.count("*").alias("n"), F.min(at(F.col("k"))).alias("first"))


def candidates(counted: DataFrame, considered: int = CONSIDERED) -> DataFrame:
    """Of each length the most frequent phrases, earlier ones first among equals; pairs must occur twice."""
    w = Window.partitionBy("playbook_id", "words").orderBy(F.desc("n"), "first")
    return counted.where("words = 1 or n >= 2").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= considered)


def accept(phrases, most: int = MOST) -> list[str]:
    """Phrases in order without a word that an accepted one has, and no pair of equal words."""
    out: list[str] = []
    used: set[str] = set()
    for p in phrases:
        words = p.split()
        if len(out) < most and not used.intersection(words) and len(set(words)) == len(words):
            out.append(p)
            used.update(words)
    return out


@pandas_udf(ArrayType(StringType()))
def accepted(phrases: pd.Series) -> pd.Series:
    return phrases.map(accept)


def keywords(sections: DataFrame) -> DataFrame:
    """sections(playbook_id, ordinal, text, source_kind) -> (playbook_id, keywords)."""
    c = candidates(counts(section_parts(sections)))
    ordered = c.groupBy("playbook_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("w"), "rank", "phrase"))).alias("p"))
    return ordered.select("playbook_id", accepted(F.transform("p", lambda x: x["phrase"])).alias("keywords"))
