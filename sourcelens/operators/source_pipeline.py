"""From pages to registry in stages, with a table for each stage's results, so that a run that was cut off goes on.

A stage takes the sources that the stage before it has passed and that it has not judged yet, all at once, and appends
its rows as one written table: whole or not at all. A later run therefore does for each source only what is left: a stage
that has judged a source is not run for it again, and sources that have come since begin at the first stage. A source
whose capture failed is captured again when its page is another one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sourcelens.functions import canonical
from sourcelens.functions import text as T
from sourcelens.operators import evidence as E
from sourcelens.operators import package as A
from sourcelens.operators import assets, policy, render
from sourcelens.operators import steps as S
from sourcelens.operators.runs import Fold, fold_runs
from sourcelens.sources import parsers as P

KEY = "playbook_id string"
STAGES = {
    "capture": f"{KEY}, status string, page string, title string, steps array<struct<ordinal: int, heading: string, caption_text: string>>",
    "distill": f"{KEY}, status string, sections array<struct<ordinal: int, step_ordinals: array<int>, text: string>>, words bigint",
    "scan": f"{KEY}, status string, risk_level string",
    "rights": f"{KEY}, status string, basis string, export_allowed string, fair_use_risk string",
    "codify": f"{KEY}, status string, asset string, failed int",
    "package": f"{KEY}, status string, nodes int, capability string",
    "certify": f"{KEY}, status string, confidence double, signature string",
    "ledger": f"{KEY}, status string, chain string, seq bigint, payload string, prev_hash string, event_hash string",
    "registry": f"{KEY}, status string, certification string, confidence double, signature string, updated_at bigint",
}
#: A source goes on to the next stage with one of these.
PASSED = ("ok",)


NUMBERED = StructType([StructField("seq", LongType()), StructField("playbook_id", StringType()), StructField("signature", StringType())])


class Number(Fold):
    """Numbers a chain's new entries by their sources' names, behind those that are stored."""

    def __init__(self):
        self.n = 0

    def feed(self, playbook_id, signature, last) -> list[tuple]:
        self.n += 1
        return [((last or 0) + self.n, playbook_id, signature)]


class SourcePipeline:
    """Sources: url (each once), html, source_kind, rights_basis, export_intent, license. Results stand below path, which all executors share."""

    def __init__(self, spark: SparkSession, path: str, shape: str = "skill"):
        self.spark, self.path, self.shape = spark, path.rstrip("/"), shape
        for name, kind in STAGES.items():
            spark.createDataFrame([], kind).write.mode("ignore").parquet(f"{self.path}/{name}/run=-1")

    def rows(self, stage: str) -> DataFrame:
        """A stage's rows over all runs, with the run that made them."""
        kind = f"{STAGES[stage]}, run int"
        return self.spark.read.schema(kind).parquet(f"{self.path}/{stage}")

    def judged(self, stage: str) -> DataFrame:
        """The last row of each source."""
        rest = [c for c in self.rows(stage).columns if c != "playbook_id"]
        return self.rows(stage).groupBy("playbook_id").agg(F.max_by(F.struct(*rest), "run").alias("r")).select("playbook_id", "r.*")

    def passed(self, stage: str) -> DataFrame:
        return self.judged(stage).where(F.col("status").isin(*PASSED)).drop("status", "run")

    def run(self, sources: DataFrame, before: Callable[[str], None] | None = None) -> None:
        """All stages for what each has to do. before is called with a stage's name before its rows are written."""
        number = 1 + max(self.rows(name).agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0] for name in STAGES)
        previous = None
        for name in STAGES:
            todo = self._changed(sources) if previous is None else self._left(previous, name)
            made = getattr(self, f"_{name}")(sources, todo.select("playbook_id"))
            if before:
                before(name)
            columns = self.spark.createDataFrame([], STAGES[name]).columns
            made.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/run={number}")
            previous = name

    def _changed(self, sources: DataFrame) -> DataFrame:
        """Sources that are new, or whose capture failed with another page than now."""
        now = sources.select(F.col("url").alias("playbook_id"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("page"))
        done = self.judged("capture").select("playbook_id", "status", F.col("page").alias("old"))
        return now.join(done, "playbook_id", "left").where(F.col("status").isNull() | (~F.col("status").isin(*PASSED) & (F.col("page") != F.col("old"))))

    def _left(self, previous: str, name: str) -> DataFrame:
        """What the stage before has passed and this one has not judged since."""
        there = self.judged(previous).where(F.col("status").isin(*PASSED)).select("playbook_id", F.col("run").alias("came"))
        done = self.judged(name).select("playbook_id", F.col("run").alias("went"))
        return there.join(done, "playbook_id", "left").where(F.col("went").isNull() | (F.col("went") < F.col("came")))

    def _capture(self, sources: DataFrame, todo: DataFrame) -> DataFrame:
        own = sources.join(todo.withColumnRenamed("playbook_id", "url"), "url")
        steps = P.page_steps(own.select("url", "html")).groupBy("url").agg(F.max("title").alias("title"), F.array_sort(F.collect_list(F.struct("ordinal", "heading", "caption_text"))).alias("steps"))
        met = own.select("url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("page")).join(steps, "url", "left")
        return met.select(F.col("url").alias("playbook_id"), F.when(F.col("steps").isNull(), "no_sections").otherwise("ok").alias("status"), "page", "title", "steps")

    def _steps(self, todo: DataFrame) -> DataFrame:
        one = self.passed("capture").join(todo, "playbook_id").select("playbook_id", F.explode("steps").alias("s")).select("playbook_id", "s.*")
        return one.withColumns({"trigger": F.lit("document_section"), "diff_score": F.lit(100.0)})

    def _distill(self, sources: DataFrame, todo: DataFrame) -> DataFrame:
        parts = S.sections(self._steps(todo)).groupBy("playbook_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "step_ordinals", "text"))).alias("sections"), F.sum("word_count").alias("words"))
        return parts.withColumn("status", F.when(F.col("words") > 0, "ok").otherwise("no_text"))

    def _sections(self, todo: DataFrame) -> DataFrame:
        return self.passed("distill").join(todo, "playbook_id").select("playbook_id", F.explode("sections").alias("s")).select("playbook_id", "s.*")

    def _scan(self, sources: DataFrame, todo: DataFrame) -> DataFrame:
        where = F.concat(F.lit("sections["), F.col("ordinal").cast("string"), F.lit("].text"))
        found = policy.injection_scan(self._sections(todo).select("playbook_id", F.col("ordinal").alias("seg_idx"), where.alias("location"), "text"))
        return found.select("playbook_id", F.when(F.col("blocked"), "injection").otherwise("ok").alias("status"), "risk_level")

    def _rights(self, sources: DataFrame, todo: DataFrame) -> DataFrame:
        unknown = F.lit(None).cast("boolean")
        asked = sources.withColumnRenamed("url", "playbook_id").join(todo, "playbook_id")
        asked = asked.select("playbook_id", "source_kind", "rights_basis", "export_intent", "license", unknown.alias("commercial"), unknown.alias("redistribution"), F.lit(0).alias("verbatim_words"), unknown.alias("verbatim"), unknown.alias("transcript"))
        found = policy.assess_rights(asked)
        return found.select("playbook_id", F.when(F.col("gate"), "ok").otherwise("rights").alias("status"), "basis", "export_allowed", F.col("risk").alias("fair_use_risk"))

    def _codify(self, sources: DataFrame, todo: DataFrame) -> DataFrame:
        s = self._sections(todo).groupBy("playbook_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("s")).withColumn("texts", F.transform("s", lambda x: x["text"]))
        about = render.description(F.lit(self.shape), T.topic_from_seed_url(F.col("playbook_id")), F.lit("web_page"), F.array().cast("array<string>"))
        url = F.col("playbook_id")
        made = assets.finished(assets.playbook(s, F.col("s"), name=T.slugify(url), shape=F.lit(self.shape), kind=F.lit("web_page"), about=about, url=url), "asset")
        # A section fails if nothing of its first words is in the asset.
        head = lambda t: F.array_join(F.slice(T.words(t), 1, 8), " ")
        failed = F.size(F.filter("texts", lambda t: ~F.contains(F.array_join(T.words(F.col("asset")), " "), head(t))))
        return made.select("playbook_id", F.lit("ok").alias("status"), "asset", failed.cast("int").alias("failed"))

    def _package(self, sources: DataFrame, todo: DataFrame) -> DataFrame:
        nothing = F.lit(None)
        sections = self._sections(todo).select("playbook_id", "ordinal", nothing.cast("string").alias("title"), "text", "step_ordinals", nothing.cast("string").alias("anchor_path"), nothing.cast("double").alias("start_s"), nothing.cast("double").alias("end_s"), nothing.cast("int").alias("page"))
        steps = self._steps(todo).withColumns({"keyframe_path": nothing.cast("string"), "ocr_text": nothing.cast("string"), "visual_action": nothing.cast(A.ACTION)})
        rights, scan = self.passed("rights").select("playbook_id", F.struct("basis", "export_allowed", F.col("fair_use_risk").alias("fairUseRisk")).alias("rights")), self.passed("scan").select("playbook_id", F.struct(F.col("risk_level").alias("riskLevel")).alias("security"))
        own = sources.withColumnRenamed("url", "playbook_id").join(todo, "playbook_id").join(rights, "playbook_id").join(scan, "playbook_id")
        slug = T.slugify(F.col("playbook_id"))
        about = own.select("playbook_id", F.col("playbook_id").alias("skill_name"), F.lit(self.shape).alias("shape"), "source_kind", F.col("playbook_id").alias("source_url"), F.concat(F.lit("assets/"), slug, F.lit(".md")).alias("asset_path"), F.concat(F.lit("exports/"), slug, F.lit(".md")).alias("target_path"), "rights", "security")
        nodes = A.evidence_nodes(sections, steps, about)
        made = A.capabilities(A.evidence_graphs(nodes, about), about, A.retained_artifacts(nodes))
        text = canonical.json(F.col("capability"), made.schema["capability"].dataType)
        return made.select("playbook_id", F.lit("ok").alias("status"), F.size("capability.sourceBinding.sectionBindings").alias("nodes"), text.alias("capability"))

    def _certify(self, sources: DataFrame, todo: DataFrame) -> DataFrame:
        own = sources.select(F.col("url").alias("playbook_id"), "source_kind").join(todo, "playbook_id")
        for name in ("distill", "scan", "rights", "codify", "package"):
            own = own.join(self.passed(name), "playbook_id")
        n, yes = F.size("sections"), F.lit(True)
        context = own.select(
            "playbook_id", "source_kind", F.col("words").cast("int").alias("words"), n.alias("sections"), "nodes", F.lit(0).alias("nodes_with_actions"), F.lit(0).alias("nodes_with_keyframes"), F.col("nodes").alias("bound_sections"),
            F.size(F.filter("sections", lambda s: s["text"] != "")).alias("textful_sections"), (F.col("asset") != "").alias("codified"), yes.alias("exported"), yes.alias("captured"), (F.col("failed") == 0).alias("validated"), (n - F.col("failed")).alias("passed"), "failed",
            yes.alias("inputs"), yes.alias("outputs"), "basis", "export_allowed", yes.alias("scanned"), F.lit(False).alias("blocked"), "risk_level", F.col("asset").alias("blob"),
        )
        done = E.signature(E.certification(context, E.validator_rows(context)))
        return done.select("playbook_id", F.lit("ok").alias("status"), "confidence", F.concat_ws(":", "status", "signature").alias("signature"))

    def _ledger(self, sources: DataFrame, todo: DataFrame) -> DataFrame:
        """An entry for each source in the chain of its kind, behind those that stand there."""
        own = self.passed("certify").join(todo, "playbook_id").join(sources.select(F.col("url").alias("playbook_id"), F.col("source_kind").alias("chain")), "playbook_id")
        stored = self.rows("ledger")
        last = stored.groupBy("chain").agg(F.max("seq").alias("last"))
        counted = fold_runs(own.join(last, "chain", "left"), "chain", ["playbook_id"], ["playbook_id", "signature", "last"], Number, NUMBERED)
        events = counted.select("chain", "seq", F.concat_ws("|", "playbook_id", "signature").alias("payload"))
        entries = E.ledger(events, heads=E.ledger_heads(stored))
        return entries.join(counted.select("chain", "seq", "playbook_id"), ["chain", "seq"]).withColumn("status", F.lit("ok"))

    def _registry(self, sources: DataFrame, todo: DataFrame) -> DataFrame:
        own = self.passed("ledger").select("playbook_id", F.col("seq").alias("updated_at")).join(todo, "playbook_id").join(self.passed("certify"), "playbook_id")
        return own.withColumns({"status": F.lit("ok"), "certification": F.substring_index("signature", ":", 1), "signature": F.substring_index("signature", ":", -1)})

    def outcome(self) -> DataFrame:
        """(playbook_id, stage, status): how far each source has come, and what stopped it."""
        every = None
        for k, name in enumerate(STAGES):
            one = self.judged(name).select("playbook_id", F.lit(k).alias("k"), F.lit(name).alias("stage"), "status")
            every = one if every is None else every.union(one)
        return every.groupBy("playbook_id").agg(F.max_by(F.struct("stage", "status"), "k").alias("x")).select("playbook_id", "x.*")
