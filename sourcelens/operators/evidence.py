"""Evidence graph, capability IR, validators, certification, ledger and registry."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sourcelens import rules
from sourcelens.functions import canonical
from sourcelens.functions import text as T
from sourcelens.operators.runs import Fold, fold_runs

VIDEO = ("youtube_video", "local_video")


def evidence_nodes(sections: DataFrame, steps: DataFrame) -> DataFrame:
    """A node per section: hashes of its text and of its steps in order, keyframes, actions.

    sections(playbook_id, ordinal, text, step_ordinals, anchor_path); steps(playbook_id, ordinal, canonical, keyframe_path, action).
    """
    refs = sections.select("playbook_id", F.col("ordinal").alias("section"), F.posexplode("step_ordinals").alias("k", "ref"))
    s = steps.select("playbook_id", F.col("ordinal").alias("ref"), F.sha2("canonical", 256).alias("h"), F.col("keyframe_path").alias("path"), "action")
    bound = refs.join(s, ["playbook_id", "ref"]).groupBy("playbook_id", "section").agg(F.array_sort(F.collect_list(F.struct("k", "h", "path", "action"))).alias("s"))
    out = sections.join(bound.withColumnRenamed("section", "ordinal"), ["playbook_id", "ordinal"], "left")
    own = F.transform(F.filter(F.coalesce("s", F.array()), lambda x: x["path"].isNotNull()), lambda x: x["path"])
    paths = F.when(F.col("anchor_path").isNotNull() & ~F.array_contains(own, F.col("anchor_path")), F.concat(F.array("anchor_path"), own)).otherwise(own)
    actions = F.filter(F.coalesce("s", F.array()), lambda x: x["action"].isNotNull())
    return out.select(
        F.concat_ws(":", F.lit("evidence"), "playbook_id", "ordinal").alias("evidence_id"), "playbook_id", F.col("ordinal").alias("section"), T.word_count(F.col("text")).alias("word_count"), F.sha2("text", 256).alias("text_hash"),
        F.transform(F.coalesce("s", F.array()), lambda x: x["h"]).alias("step_hashes"), F.size(paths).alias("keyframes"), F.slice(paths, 1, 5).alias("keyframe_paths"), F.size(actions).alias("actions"), "anchor_path", "text",
    )


def evidence_edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("evidence_id").alias("src"), F.concat(F.lit("capability:"), T.slugify(F.col("playbook_id").cast("string"))).alias("dst"), F.lit("supports").alias("relationship"))


def section_bindings(nodes: DataFrame) -> DataFrame:
    return nodes.select("playbook_id", F.col("section").alias("ordinal"), "evidence_id", "word_count", T.truncate_words(F.col("text"), 32).alias("summary"))


def retained_artifacts(nodes: DataFrame) -> DataFrame:
    """Distinct relative keyframe paths of a playbook, in first-seen order; absolute and escaping ones are refused."""
    p = nodes.select("playbook_id", "section", "evidence_id", F.posexplode("keyframe_paths").alias("k", "path"))
    safe = p.where(~F.regexp_like("path", F.lit(r"^([/\\]|[A-Za-z]:)")) & ~F.regexp_like("path", F.lit(r"(^|[/\\])\.\.([/\\]|$)")))
    return safe.groupBy("playbook_id", "path").agg(F.min(F.struct("section", "k")).alias("first"), F.array_sort(F.collect_set("evidence_id")).alias("nodes")).select("playbook_id", "path", F.concat(F.lit("evidence_artifacts/"), "path").alias("retained"), "nodes", F.col("first.section").alias("first_section"))


def validator_rows(context: DataFrame) -> DataFrame:
    """A row per playbook and validator.

    context: playbook_id, source_kind, words, sections, nodes, nodes_with_actions, codified, exported, captured, validated (null: not run),
    passed, failed, inputs, outputs, basis, export_allowed, scanned, blocked, risk_level, blob.
    """
    c = F.col
    ran = c("validated").isNotNull()
    total = c("passed") + c("failed")
    rate = F.when(total > 0, c("passed") / total).otherwise(c("validated").cast("double"))
    video = c("source_kind").isin(*VIDEO)
    contract = c("inputs") & c("outputs")
    known = (c("basis") != "unknown") & (c("export_allowed") != "blocked")

    def row(name: str, severity: str, category: str, passed: Column, score: Column | None = None, skipped: Column | None = None) -> Column:
        score = passed.cast("double") if score is None else score
        return F.struct(F.lit(name).alias("id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), passed.alias("passed"), F.coalesce(skipped, F.lit(False)).alias("skipped") if skipped is not None else F.lit(False).alias("skipped"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))

    made = [
        row("source_text_present", "critical", "source_fidelity", c("words") > 0),
        row("evidence_bindings_present", "critical", "source_fidelity", (c("sections") > 0) & (c("nodes") >= c("sections")), F.coalesce(F.try_divide(c("nodes"), c("sections")), F.lit(0.0))),
        row("codified_asset_present", "critical", "codification", c("codified")),
        row("execution_validation_passed", "critical", "execution_validation", F.coalesce(c("validated"), F.lit(False)), F.coalesce(rate, F.lit(0.0)), ~ran),
        row("export_recorded", "high", "governance", c("exported")),
        row("capture_distill_recorded", "high", "governance", c("captured")),
        row("capability_contract_present", "high", "capability_ir", contract),
        row("visual_actions_present", "high", "visual_grounding", ~video | (c("nodes_with_actions") > 0), F.when(video, F.coalesce(F.try_divide(c("nodes_with_actions"), c("nodes")), F.lit(0.0))).otherwise(1.0), ~video),
        row("rights_assessment_present", "critical", "governance_rights", known, F.when(known, 1.0).when(c("export_allowed").isin("allowed", "private_only"), 0.4).otherwise(0.0)),
        row("source_prompt_injection_guard_passed", "critical", "governance_security", c("scanned") & ~c("blocked"), F.when(c("scanned") & ~c("blocked"), F.when(c("risk_level") == "low", 1.0).otherwise(0.75)).otherwise(0.0)),
    ]
    for name, words in rules.DOMAINS.items():
        relevant = F.regexp_like(F.lower("blob"), F.lit(rf"\b(?:{'|'.join(words)})\b"))
        made.append(row(f"{name}_domain_contract", "medium", f"domain_{name}", ~relevant | contract, F.when(~relevant | contract, 1.0).otherwise(0.0), ~relevant))
    return context.select("playbook_id", F.posexplode(F.array(*made)).alias("n", "v")).select("playbook_id", "n", "v.*")


def category_score(prefix: str) -> Column:
    """Mean score of a category's validators; 1 if all are skipped, 0 if there is none. Over a group of validator rows."""
    mine = F.startswith("category", F.lit(prefix))
    mean = F.avg(F.when(mine & ~F.col("skipped"), F.col("score")))
    return F.coalesce(F.round(mean, 3), F.when(F.count_if(mine & F.col("skipped")) > 0, 1.0).otherwise(0.0))


def coverage() -> Column:
    return F.coalesce(F.round(F.avg(F.when(~F.col("skipped"), F.col("passed").cast("double"))), 3), F.lit(0.0))


def certification(context: DataFrame, results: DataFrame, strict: bool = False) -> DataFrame:
    """A row per playbook: dimensions, confidence, status and the critical failures."""
    scores = results.groupBy("playbook_id").agg(
        coverage().alias("validatorCoverage"), category_score("domain_").alias("domainCoverage"), category_score("capability_ir").alias("capabilityIr"), category_score("governance_rights").alias("rightsGovernance"),
        category_score("governance_security").alias("sourceSecurity"), F.array_sort(F.collect_list(F.when((F.col("severity") == "critical") & ~F.col("passed"), F.col("id")))).alias("critical_failures"),
    )
    c = F.col
    total = c("passed") + c("failed")
    video = c("source_kind").isin(*VIDEO)
    own = context.select(
        "playbook_id", F.when((c("sections") > 0) & (c("nodes") > 0), F.round(c("bound_sections") / c("sections") * 0.5 + c("textful_sections") / c("sections") * 0.5, 3)).otherwise(0.0).alias("sourceFidelity"), c("codified").cast("double").alias("codification"),
        F.when(total > 0, c("passed") / total).otherwise(F.coalesce(c("validated").cast("double"), F.lit(0.0))).alias("executionValidation"), F.when(c("nodes") > 0, 1.0).otherwise(0.5).alias("governance"),
        F.when(~video, 1.0).otherwise(F.coalesce(F.round(F.try_divide(c("nodes_with_keyframes"), c("nodes")) * 0.45 + F.try_divide(c("nodes_with_actions"), c("nodes")) * 0.55, 3), F.lit(0.0))).alias("visualGrounding"),
    )
    both = own.join(scores, "playbook_id")
    confidence = F.round(reduce(lambda a, b: a + b, [c(k) * F.lit(w) for k, w in rules.WEIGHTS.items()]), 3)
    out = both.withColumn("confidence", confidence)
    good = (c("confidence") >= rules.CERTIFIED_AT) & (F.size("critical_failures") == 0)
    dims = F.create_map(*[x for k in rules.WEIGHTS for x in (F.lit(k), c(k))])
    return out.select("playbook_id", F.when(good, "certified").otherwise("rejected" if strict else "draft").alias("status"), "confidence", dims.alias("dimensions"), "critical_failures")


def signature(certified: DataFrame) -> DataFrame:
    """A hash over the canonical JSON of a certification, that is of all of the row but a signature."""
    names = [c for c in certified.columns if c != "signature"]
    return certified.select(*names, F.sha2(canonical.of(certified, *names), 256).alias("signature"))


def artifact_hashes(artifacts: DataFrame, key: str, **columns: str) -> DataFrame:
    """For each row its key and the hash of each artifact's canonical JSON (text as it is), null where there is none.

    columns: name of the hash = column of the artifact.
    """
    def hashed(name: str) -> Column:
        kind = artifacts.schema[name].dataType
        body = F.col(name) if isinstance(kind, StringType) else canonical.json(F.col(name), kind)
        return F.when(F.col(name).isNotNull(), F.sha2(body, 256))

    return artifacts.select(key, *[hashed(c).alias(name) for name, c in columns.items()])


LINKS = StructType([StructField("seq", LongType()), StructField("payload", StringType()), StructField("prev_hash", StringType()), StructField("event_hash", StringType())])


class ChainFold(Fold):
    """The hash of the entry before, which the next one's hash takes in."""

    def __init__(self, previous: str):
        self.previous, self.begun = previous, False

    def feed(self, seq, payload, head) -> list[tuple]:
        before = self.previous if self.begun or head is None else head
        parts = [before, *(str(x) for x in (seq, payload) if x is not None)]
        self.begun, self.previous = True, hashlib.sha256("|".join(parts).encode()).hexdigest()
        return [(seq, payload, before, self.previous)]


def ledger(events: DataFrame, previous: str = "", heads: DataFrame | None = None) -> DataFrame:
    """events(chain, seq, payload) -> with prev_hash and event_hash, each chain folded in order; chains are independent.

    heads(chain, event_hash) are the last hashes of chains that are stored already, so that an append goes on there;
    other chains begin at previous. Only the last hash of a chain is in memory.
    """
    own = events.select("chain", F.col("seq").cast("bigint").alias("seq"), F.col("payload").cast("string").alias("payload"))
    if heads is not None:
        h = heads.select(F.col("chain").alias("_chain"), F.col("event_hash").alias("head"))
        own = own.join(h, F.col("chain").eqNullSafe(F.col("_chain")), "left").drop("_chain")
    else:
        own = own.withColumn("head", F.lit(None).cast("string"))
    return fold_runs(own, "chain", ["seq", "payload"], ["seq", "payload", "head"], lambda: ChainFold(previous), LINKS)


def ledger_heads(entries: DataFrame) -> DataFrame:
    """The last hash of each stored chain."""
    return entries.groupBy("chain").agg(F.max_by("event_hash", "seq").alias("event_hash"))


def verify_ledger(entries: DataFrame, previous: str = "") -> DataFrame:
    """Whether each entry's hash follows from its content and its predecessor's hash: one window, no fold."""
    w = Window.partitionBy("chain").orderBy("seq")
    before = F.coalesce(F.lag("event_hash").over(w), F.lit(previous))
    right = F.sha2(F.concat_ws("|", "prev_hash", F.col("seq").cast("string"), "payload"), 256)
    return entries.select("chain", "seq", ((F.col("prev_hash") == before) & (F.col("event_hash") == right)).alias("valid"))


def registry(entries: DataFrame) -> DataFrame:
    """The latest row of each slug by updated_at, then by seq."""
    rest = [c for c in entries.columns if c != "slug"]
    latest = entries.groupBy("slug").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "seq")).alias("r"))
    return latest.select("slug", "r.*")
