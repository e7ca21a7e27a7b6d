"""Injection scan and rights assessment, for many playbooks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelens import rules
from sourcelens.functions import text as T


def budgeted(segments: DataFrame, budget: int = rules.SCAN_CHARS) -> DataFrame:
    """segments(playbook_id, seg_idx, location, text): blank ones go, then texts up to the playbook's character budget."""
    order = Window.partitionBy("playbook_id").orderBy("seg_idx")
    kept = segments.where(F.regexp_like("text", F.lit(r"\S"))).withColumn("_before", F.sum(F.length("text")).over(order) - F.length("text"))
    return kept.where(F.col("_before") < budget).withColumn("text", F.col("text").substr(F.lit(1), (F.lit(budget) - F.col("_before")).cast("int"))).drop("_before")


def matches(segments: DataFrame, own_names: tuple[str, ...] = ()) -> DataFrame:
    """The first match of each rule in each segment; all rules in one pass over the text."""
    def found(rule_id: str, severity: str, dots: bool, pattern: str) -> Column:
        p = F.lit(("(?isu)" if dots else "(?iu)") + pattern)
        return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.regexp_instr("text", p).alias("at"), F.length(F.regexp_substr("text", p)).alias("n"))

    every = F.filter(F.array(*[found(*r) for r in rules.injection_rules(own_names)]), lambda m: m["at"] > 0)
    m = segments.select("playbook_id", "seg_idx", "location", "text", F.posexplode(every).alias("rule_no", "m"))
    start, end = F.col("m.at") - 1, F.col("m.at") - 1 + F.col("m.n")
    return m.select("playbook_id", "seg_idx", "location", "rule_no", "m.rule_id", "m.severity", start.alias("start"), end.alias("end"), T.snippet(F.col("text"), start, end).alias("snippet"))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("playbook_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.count("*").alias("matches"))


def risk_score(critical: Column, high: Column, total: Column) -> Column:
    return F.round(F.least(F.lit(1.0), critical * F.lit(0.55) + high * F.lit(0.22) + F.greatest(total - critical - high, F.lit(0)) * F.lit(0.08)), 3)


def verdict(critical: Column, high: Column) -> tuple[Column, Column]:
    """Blocked, and the risk level."""
    return (critical > 0) | (high >= 2), F.when(critical > 0, "critical").when(high >= 2, "high").when(high > 0, "medium").otherwise("low")


def injection_scan(segments: DataFrame, own_names: tuple[str, ...] = ()) -> DataFrame:
    """An assessment per playbook; those without text are judged too."""
    kept = budgeted(segments)
    sizes = kept.groupBy("playbook_id").agg(F.count("*").alias("segments_scanned"), F.sum(F.length("text")).alias("chars_scanned"))
    found = matches(kept, own_names)
    ids = F.array_join(F.array_sort(F.collect_set("rule_id")), ",")
    counts = severity_counts(found).join(found.groupBy("playbook_id").agg(ids.alias("rule_ids")), "playbook_id")
    out = segments.select("playbook_id").distinct().join(sizes, "playbook_id", "left").join(counts, "playbook_id", "left").na.fill(0).na.fill("", ["rule_ids"])
    c, h, n = F.col("critical"), F.col("high"), F.col("matches")
    blocked, level = verdict(c, h)
    return out.select("playbook_id", blocked.alias("blocked"), level.alias("risk_level"), risk_score(c, h, n).alias("risk_score"), "segments_scanned", "chars_scanned", "matches", "critical", "high", "rule_ids", ((n > rules.MATCH_LIMIT) | (F.col("chars_scanned") >= rules.SCAN_CHARS)).alias("truncated"))


def block_message(found: DataFrame) -> DataFrame:
    """A message per blocked playbook that names its first three matches."""
    counts = severity_counts(found).where(verdict(F.col("critical"), F.col("high"))[0])
    line = F.concat("rule_id", F.lit(" at "), "location", F.lit(": "), "snippet")
    lines = found.groupBy("playbook_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "rule_no", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("source content appears to target the compiler or agent runtime. Matches: "), F.array_join(F.transform(F.slice("l", 1, 3), lambda x: x["line"]), " | "))
    return counts.join(lines, "playbook_id").select("playbook_id", text.alias("message"))


def commercial_allowed(basis: Column, explicit: Column, licence: Column) -> Column:
    own = F.when(basis.isin("owned", "licensed", "public_domain"), True).when(basis == "creative_commons", F.coalesce((licence != "") & ~F.contains(F.lower(licence), F.lit("-nc")), F.lit(False))).otherwise(False)
    return F.coalesce(explicit, own)


def redistribution_allowed(basis: Column, explicit: Column, licence: Column) -> Column:
    own = F.when(basis.isin("owned", "licensed", "public_domain"), True).when(basis == "creative_commons", F.coalesce(licence != "", F.lit(False))).otherwise(False)
    return F.coalesce(explicit, own)


def risk_points(kind: Column, basis: Column, intent: Column, commercial: Column, redistribution: Column, verbatim: Column, transcript: Column, words: Column) -> tuple[Column, Column]:
    """(points, reasons in order)."""
    low = basis.isin(*rules.LOW_RISK)
    terms = [
        (4, basis == "unknown", F.lit("rights basis is unknown")), (2, basis.isin(*rules.MEDIUM_RISK), F.concat(F.lit("rights basis requires review: "), basis)),
        (2, (kind == "youtube_video") & ~low, F.lit("YouTube/public video sources require explicit rights for reuse")), (4, (intent == "commercial") & ~commercial, F.lit("commercial use is not allowed by the assessment")),
        (3, (intent == "public") & ~redistribution, F.lit("redistribution is not allowed by the assessment")), (2, verbatim, F.concat(F.lit("generated asset may contain source expression ("), words.cast("string"), F.lit(" estimated words)"))),
        (1, transcript & ~low, F.lit("full transcript retention should be minimized or licensed")),
    ]
    return sum((F.when(c, n).otherwise(0) for n, c, _ in terms), F.lit(0)), F.array_compact(F.array(*[F.when(c, r) for _, c, r in terms]))


def export_verdict(intent: Column, risk: Column, basis: Column, commercial: Column, redistribution: Column) -> Column:
    yes = lambda c: F.when(c, "allowed").otherwise("blocked")
    return (
        F.when(intent.isin("private", "internal"), F.when(risk != "high", "allowed").otherwise("private_only")).when(intent == "commercial", yes(commercial & redistribution & (risk == "low")))
        .when(intent == "public", yes(redistribution & risk.isin("low", "medium") & (basis != "fair_use"))).otherwise("private_only")
    )


def export_gate(allowed: Column, intent: Column) -> Column:
    return (allowed == "allowed") | ((allowed == "private_only") & intent.isin("private", "internal"))


def assess_rights(sources: DataFrame) -> DataFrame:
    """sources(playbook_id, source_kind, rights_basis, export_intent, license, commercial, redistribution, verbatim_words, verbatim, transcript) -> an assessment per row."""
    basis, intent = T.normalize_alias(F.col("rights_basis"), rules.BASIS_ALIASES, "unknown"), T.normalize_alias(F.col("export_intent"), rules.INTENT_ALIASES, "private")
    s = sources.withColumns({"basis": basis, "intent": intent, "is_verbatim": F.coalesce("verbatim", F.coalesce("verbatim_words", F.lit(0)) > 0), "stored": F.coalesce("transcript", F.col("source_kind").isin("youtube_video", "local_video"))})
    s = s.withColumns({"commercial_ok": commercial_allowed(F.col("basis"), F.col("commercial"), F.col("license")), "redistribution_ok": redistribution_allowed(F.col("basis"), F.col("redistribution"), F.col("license"))})
    points, reasons = risk_points(*map(F.col, ("source_kind", "basis", "intent", "commercial_ok", "redistribution_ok", "is_verbatim", "stored")), F.coalesce("verbatim_words", F.lit(0)))
    s = s.withColumns({"points": points, "reasons": reasons}).withColumn("risk", F.when(F.col("points") >= 6, "high").when(F.col("points") >= 3, "medium").otherwise("low"))
    s = s.withColumn("export_allowed", export_verdict(*map(F.col, ("intent", "risk", "basis", "commercial_ok", "redistribution_ok"))))
    review = F.col("risk").isin("medium", "high") | F.col("basis").isin("unknown", "fair_use") | F.col("intent").isin("public", "commercial")
    return s.select("playbook_id", "basis", "intent", "commercial_ok", "redistribution_ok", "points", "risk", "export_allowed", review.alias("review_required"), "is_verbatim", "stored", "reasons", export_gate(F.col("export_allowed"), F.col("intent")).alias("gate"))


def verbatim_words(sources: DataFrame, assets: DataFrame) -> DataFrame:
    """sources(id, text) and assets(asset_id, text) -> (id, asset_id, words) of the sources' long phrases that an asset holds.

    A phrase is looked for as a substring, as the exact rule has it. Its inner ten words stand between single blanks
    wherever it occurs, so phrases and assets meet on hashes of ten blank-separated tokens: the join has an equality and
    loses nothing; the substring test follows.
    """
    inner = 10
    phrases = sources.select("id", F.explode(T.long_phrases(F.col("text"))).alias("p")).withColumn("p", F.lower("p")).groupBy("id", "p").agg(F.count("*").alias("k"))
    probe = phrases.withColumn("g", F.xxhash64(F.slice(F.split("p", " "), 2, inner)))
    low = assets.select("asset_id", F.lower("text").alias("t")).withColumn("w", F.split("t", " "))
    places = F.sequence(F.lit(1), F.size("w") - inner + 1)
    grams = low.where(F.size("w") >= inner).select("asset_id", F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.slice("w", i, F.lit(inner)))))).alias("g"))
    met = probe.join(grams, "g").join(low.select("asset_id", "t"), "asset_id").where(F.contains("t", F.col("p")))
    return met.groupBy("id", "asset_id").agg(F.sum(T.word_count(F.col("p")) * F.col("k")).alias("words"))
