"""The store of playbooks as a table with a row each, keyed by slug: renaming and deleting by requests, with their refusals.

Requests are judged against one state of the store, and each slug may be asked for once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelens.functions import text as T


def with_first_heading(text: Column, old: Column, new: Column) -> Column:
    """text with old replaced once in its first line, if that is a heading of the first level that holds it."""
    line = F.substring_index(text, "\n", 1)
    at = F.instr(line, old)
    changed = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))
    return F.when(F.startswith(line, F.lit("# ")) & (old != "") & (at > 0), changed).otherwise(text)


def renamed(playbooks: DataFrame, requests: DataFrame) -> DataFrame:
    """playbooks(name, slug, text), requests(request, old_name, new_name, overwrite) -> request, status, slug, name, text.

    status: renamed, or why not: required, identical, not_found, same_slug or exists.
    """
    r = requests.withColumns({"old": F.trim(F.coalesce("old_name", F.lit(""))), "new": F.trim(F.coalesce("new_name", F.lit("")))})
    r = r.withColumns({"old_slug": T.slugify(F.col("old")), "new_slug": T.slugify(F.col("new"))})
    there = playbooks.select(F.col("slug").alias("old_slug"), "text", F.lit(True).alias("found"))
    taken = playbooks.select(F.col("slug").alias("new_slug"), F.lit(True).alias("taken"))
    r = r.join(there, "old_slug", "left").join(taken, "new_slug", "left")
    status = (
        F.when((F.col("old") == "") | (F.col("new") == ""), "required").when(F.col("old") == F.col("new"), "identical").when(F.col("found").isNull(), "not_found")
        .when(F.col("old_slug") == F.col("new_slug"), "same_slug").when(F.col("taken").isNotNull() & ~F.coalesce("overwrite", F.lit(False)), "exists").otherwise("renamed")
    )
    r = r.withColumn("status", status)
    done = F.col("status") == "renamed"
    return r.select("request", "status", F.when(done, F.col("new_slug")).alias("slug"), F.when(done, F.col("new")).alias("name"), F.when(done, with_first_heading(F.col("text"), F.col("old"), F.col("new"))).alias("text"))


def deleted(playbooks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The playbooks that stay, and requests(request, name) with whether each found its playbook."""
    r = requests.withColumn("slug", T.slugify(F.col("name")))
    found = r.join(playbooks.select("slug", F.lit(True).alias("found")).distinct(), "slug", "left")
    return playbooks.join(r.select("slug").distinct(), "slug", "left_anti"), found.select("request", F.coalesce("found", F.lit(False)).alias("deleted"))
