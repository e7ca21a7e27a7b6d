"""Evidence graphs and capability documents as nested structs, built from sections, their steps and a manifest.

A node joins a section with its steps by their ordinals; what it holds is fixed in number (five paths, twenty actions),
so nodes stay small however many steps a section has. Documents are structs, and their text is canonical JSON, so the
same input has the same hash. Field names are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelens.functions import canonical
from sourcelens.functions import text as T
from sourcelens.operators import evidence as E

#: Paths and actions that a node shows, words of a summary.
MOST_PATHS, MOST_ACTIONS, SUMMARY = 5, 20, 32
REGION = "struct<x: int, y: int, width: int, height: int>"
#: What frame analysis gives for a step; text recognition and pixels are inputs.
ACTION = f"struct<actionType: string, confidence: double, changedRatio: double, changedRegion: {REGION}, changedZones: array<string>, visibleTextSample: string, observations: array<string>>"


def shown_action(ordinal: Column, action: Column) -> Column:
    """A step's action as a section shows it, with defaults for what is missing."""
    none = F.array().cast("array<string>")
    return F.struct(
        ordinal.cast("int").alias("stepOrdinal"), F.coalesce(T.filled(action["actionType"]), F.lit("unknown")).alias("actionType"), action["confidence"].alias("confidence"), action["changedRatio"].alias("changedRatio"),
        action["changedRegion"].alias("changedRegion"), F.coalesce(action["changedZones"], none).alias("changedZones"), F.coalesce(action["visibleTextSample"], F.lit("")).alias("visibleTextSample"), F.coalesce(action["observations"], none).alias("observations"),
    )


def bound_steps(sections: DataFrame, steps: DataFrame) -> DataFrame:
    """(playbook_id, section, s): each section's steps that exist, in the order of its list, each with the hash of its canonical JSON."""
    hashed = F.sha2(canonical.of(steps, *sorted(steps.columns)), 256)
    own = steps.select("playbook_id", F.col("ordinal").alias("ref"), F.struct(hashed.alias("hash"), F.nullif("keyframe_path", F.lit("")).alias("path"), F.nullif("ocr_text", F.lit("")).alias("seen"), F.col("visual_action").cast(ACTION).alias("action")).alias("_s"))
    refs = sections.select("playbook_id", F.col("ordinal").alias("section"), F.posexplode("step_ordinals").alias("k", "ref"))
    met = refs.join(own, ["playbook_id", "ref"])
    return met.groupBy("playbook_id", "section").agg(F.array_sort(F.collect_list(F.struct("k", "ref", "_s"))).alias("s"))


def evidence_nodes(sections: DataFrame, steps: DataFrame, manifests: DataFrame) -> DataFrame:
    """(playbook_id, section, node): a node of the evidence graph for each section.

    sections: playbook_id, ordinal, title, text, step_ordinals, anchor_path, start_s, end_s, page; steps: playbook_id, ordinal,
    keyframe_path, ocr_text, visual_action, and whatever else they carry; manifests: playbook_id, source_kind, source_url.
    """
    bound = bound_steps(sections, steps).withColumnRenamed("section", "ordinal")
    m = manifests.select("playbook_id", "source_kind", "source_url")
    x = sections.join(bound, ["playbook_id", "ordinal"], "left").join(m, "playbook_id", "left").withColumn("s", F.coalesce("s", F.filter("s", lambda _: F.lit(False)), F.array().cast(bound.schema["s"].dataType)))
    each = lambda name: F.array_compact(F.transform("s", lambda e: e["_s"][name]))
    own, seen = each("path"), each("seen")
    anchor = F.nullif("anchor_path", F.lit(""))
    paths = F.when(anchor.isNotNull() & ~F.array_contains(own, anchor), F.concat(F.array(anchor), own)).otherwise(own)
    acted = F.transform(F.filter("s", lambda e: e["_s"]["action"].isNotNull()), lambda e: shown_action(e["ref"], e["_s"]["action"]))
    x = x.withColumns({"_paths": paths, "_seen": seen, "_acted": F.slice(acted, 1, MOST_ACTIONS), "_hashes": each("hash")})
    some = F.size("_seen") > 0
    words = F.size(F.filter(F.split(F.array_join("_seen", " "), r"\s+"), lambda w: w != ""))
    visual = F.struct(
        F.size("_paths").alias("keyframeCount"), F.slice("_paths", 1, MOST_PATHS).alias("keyframePaths"), F.when(some, F.sha2(F.array_join("_seen", "\n"), 256)).alias("ocrTextHash"),
        F.when(some, words).otherwise(0).alias("ocrWordCount"), F.size("_acted").alias("visualActionCount"),
    )
    node = F.struct(
        F.concat_ws(":", F.lit("evidence"), F.col("playbook_id").cast("string"), F.col("ordinal").cast("string")).alias("id"), F.lit("source_section").alias("type"), F.col("source_kind").alias("sourceKind"), F.col("source_url").alias("sourceUrl"),
        F.col("ordinal").alias("sectionOrdinal"), "title", T.word_count(F.coalesce("text", F.lit(""))).alias("wordCount"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("textHash"), F.col("start_s").alias("videoStartSeconds"), F.col("end_s").alias("videoEndSeconds"),
        F.col("anchor_path").alias("anchorKeyframePath"), F.col("page").alias("pageNumber"), F.col("step_ordinals").alias("stepOrdinals"), visual.alias("visualEvidence"), F.col("_acted").alias("visualActions"), F.col("_hashes").alias("stepHashes"),
    )
    summary = F.struct(F.col("ordinal").alias("sectionOrdinal"), node["id"].alias("evidenceId"), node["wordCount"].alias("wordCount"), T.truncate_words(F.coalesce("text", F.lit("")), SUMMARY).alias("summary"))
    return x.select("playbook_id", F.col("ordinal").alias("section"), node.alias("node"), summary.alias("binding"))


def evidence_graphs(nodes: DataFrame, manifests: DataFrame) -> DataFrame:
    """(playbook_id, graph): all nodes of a playbook in order, and an edge from each to the playbook's capability."""
    g = nodes.groupBy("playbook_id").agg(F.array_sort(F.collect_list(F.struct("section", "node", "binding"))).alias("n"))
    x = g.join(manifests.select("playbook_id", "source_kind", "source_url"), "playbook_id", "left").withColumn("nodes", F.transform("n", lambda e: e["node"]))
    to = F.concat(F.lit("capability:"), T.slugify(F.col("playbook_id").cast("string")))
    x = x.withColumn("edges", F.transform("nodes", lambda e: F.struct(e["id"].alias("from"), to.alias("to"), F.lit("supports").alias("relationship"))))
    graph = F.struct(F.col("playbook_id").cast("string").alias("playbookName"), F.col("source_kind").alias("sourceKind"), F.col("source_url").alias("sourceUrl"), "nodes", "edges")
    return x.select("playbook_id", graph.alias("graph"), F.transform("n", lambda e: e["binding"]).alias("bindings"))


def capabilities(graphs: DataFrame, manifests: DataFrame, retained: DataFrame, product: str = "sourcelens") -> DataFrame:
    """(playbook_id, capability) for each graph.

    manifests: playbook_id, skill_name, shape, source_kind, source_url, asset_path, target_path, rights (struct with
    fairUseRisk, or null), security (struct with riskLevel, or null); retained: rows of retained_artifacts.
    """
    files = retained.groupBy("playbook_id").agg(F.array_sort(F.collect_list(F.struct("path", "retained", F.col("nodes").alias("evidenceIds")))).alias("files"))
    x = graphs.select("playbook_id", "bindings").join(manifests, "playbook_id").join(files, "playbook_id", "left")
    word = lambda **fields: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])
    fixtures = word(
        schema=f"{product}.execution_fixtures.v1", sampleInputs=word(request="Apply the captured source-backed capability.", source_context="Use only the sandbox and cite source sections."),
        expectedOutputs=word(status="completed | partial | failed", citations="non-empty list for source-backed claims"), minimumEvidenceSections=F.least(F.lit(1), F.size("bindings")),
        rollbackRequiredForSideEffects=F.col("shape").isin("skill", "workflow"),
    )
    capability = word(
        schema=f"{product}.capability.v1", capabilityId=F.concat(F.lit("capability:"), T.slugify(F.col("skill_name"))), skillName=F.col("skill_name"), shape=F.col("shape"), sourceKind=F.col("source_kind"),
        sourceBinding=word(playbookName=F.col("playbook_id").cast("string"), sourceUrl=F.col("source_url"), sectionBindings=F.col("bindings"), retainedArtifacts=word(artifactRoot="evidence_artifacts", files=F.coalesce("files", F.array().cast(files.schema["files"].dataType)))),
        contract=word(inputs=word(request="string", source_context="string | null"), outputs=word(status="'completed' | 'partial' | 'failed'", citations="list[string]", artifact_paths="list[string]")),
        execution=word(assetPath=F.col("asset_path"), targetOutputPath=F.col("target_path"), runtime="agent-markdown", requiresSourceCitations=True, fixtures=fixtures),
        canonical=word(isCanonical=True, renderedTargetsAreDerived=True),
        risk=word(sideEffects="unknown", requiresHumanConfirmationForDestructiveActions=True, stalenessRisk="unknown", rightsRisk=F.col("rights")["fairUseRisk"], sourceSecurityRisk=F.col("security")["riskLevel"]),
        rights=F.col("rights"), security=word(promptInjection=F.col("security")),
    )
    return x.select("playbook_id", capability.alias("capability"))


def retained_artifacts(nodes: DataFrame) -> DataFrame:
    """Distinct keyframe paths of a playbook's nodes that are relative and stay inside; see operators.evidence."""
    flat = nodes.select("playbook_id", "section", F.col("node.id").alias("evidence_id"), F.col("node.visualEvidence.keyframePaths").alias("keyframe_paths"))
    return E.retained_artifacts(flat)
