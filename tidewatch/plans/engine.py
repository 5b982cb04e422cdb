"""The tables of one deployment and the verbs on them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import quoted
from tidewatch.operators import explain as ex
from tidewatch.operators import routing, sampling, scoring
from tidewatch.operators.bundle import Bundle, as_table, current_version, from_row
from tidewatch.plans import adapt as ad
from tidewatch.schemas import FEEDBACK, MODELS
from tidewatch.session import prepare, stage_table, staging_area
from tidewatch.sources.tables import AppendTable, Buffer

PROMOTIONS = T.StructType(
    [
        T.StructField("model_version", T.StringType()),
        T.StructField("action", T.StringType()),  # accept | reject
        T.StructField("promoted_at", T.TimestampType()),
    ]
)

SCOPE_COLUMN = "confidence_scope"  # of stored rows: the column their confidence is relative to


def _now() -> datetime:
    return datetime.now(timezone.utc)


class Engine:
    """Models, scored flows, buffers and feedback under one root folder."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        default_version: str = "default",
        buffer_max: int | None = None,
        attack_conf: float = routing.ATTACK_CONFIDENCE,
        replay_max: int | None = None,
    ):
        self.spark, self.root = prepare(spark), root
        self.default_version, self.attack_conf = default_version, attack_conf
        self.models = AppendTable(spark, f"{root}/models", MODELS)
        self.promotions = AppendTable(spark, f"{root}/promotions", PROMOTIONS)
        self.feedback_log = AppendTable(spark, f"{root}/feedback", FEEDBACK)
        self.scored = AppendTable(spark, f"{root}/scored")
        self.scope_events = AppendTable(spark, f"{root}/scope_events", T.StructType([
            T.StructField("scope", T.StringType()), T.StructField("action", T.StringType()),
            T.StructField("at", T.TimestampType()), T.StructField("token", T.StringType()),
        ]))
        self.explanations = AppendTable(spark, f"{root}/explanations")
        self.quarantine = AppendTable(
            spark, f"{root}/quarantine", T.StructType([T.StructField("source", T.StringType()), T.StructField("reason", T.StringType())])
        )
        self.benign = Buffer(spark, f"{root}/benign", buffer_max)
        self.attack = Buffer(spark, f"{root}/attack", buffer_max)
        self.replay = Buffer(spark, f"{root}/replay", replay_max)

    # ---- models

    def save(self, bundle: Bundle) -> str:
        self.models.append(as_table(self.spark, [bundle]).coalesce(1), token=bundle.version)
        return bundle.version

    def load(self, version: str) -> Bundle:
        row = self.models.read().filter(F.col("model_version") == version).first()
        if row is None:
            raise KeyError(version)
        return from_row(row)

    def current_version(self) -> str:
        return current_version(self.promotions.read(), self.models.read(), self.default_version).first()[0]

    def current(self) -> Bundle:
        return self.load(self.current_version())

    def _promote(self, version: str, action: str) -> None:
        row = self.spark.createDataFrame([(version, action, _now())], PROMOTIONS)
        self.promotions.append(row.coalesce(1))

    # ---- scoring and routing

    def predict(
        self, flows: DataFrame, scope: str = "all", bundle: Bundle | None = None, token: str | None = None,
        scope_column: str | None = None, **options,
    ) -> DataFrame:
        """Score, store under ``scope``, route to the buffers; returns the stored rows.

        Confidence is relative to these rows, or to those sharing ``scope_column``.
        ``token`` names the append: a retried micro-batch replaces its own rows.
        """
        bundle = bundle or self.current()
        keep = [c for c in ("flow_uid", "source_file", "capture_time") if c in flows.columns]
        with staging_area(self.spark):
            rows = scoring.predict(flows, bundle, scope_column, keep=options.pop("keep", keep), **options)
            rows = rows.withColumns(
                {"scope": F.lit(scope), "scored_at": F.current_timestamp(), SCOPE_COLUMN: F.lit(scope_column).cast("string")}
            )
            token = self.scored.append(rows, token)
        self._note_scope(scope, "add", token)
        stored = self.scored.read(token)
        self.route(stored, token)
        return stored

    def route(self, scored: DataFrame, token: str | None = None) -> None:
        self.benign.add(routing.benign_rows(scored), token)
        self.attack.add(routing.attack_rows(scored, self.attack_conf), token)

    def results(self, scope: str = "all") -> DataFrame | None:
        """All rows of a scope since it was last cleared or replaced; None when there are none.

        Scopes may differ in column types, so only the scope's own appends are read.
        """
        events = self.scope_events.read().filter(F.col("scope") == scope)
        ended = events.filter("action <> 'add'").agg(F.max("at")).first()[0]
        adds = events.filter("token IS NOT NULL")
        if ended is not None:
            # What replaces a scope counts itself.
            adds = adds.filter((F.col("at") > F.lit(ended)) | ((F.col("at") == F.lit(ended)) & (F.col("action") == "replace")))
        tokens = [r["token"] for r in adds.select("token", "at").orderBy("at").collect()]
        return self.scored.read_all(tokens) if tokens else None

    def _replace(self, scope: str, rows: DataFrame) -> DataFrame:
        """Put new rows in place of a scope's: stored first, then one event ends the old ones."""
        token = self.scored.append(rows)
        self._note_scope(scope, "replace", token)
        return self.scored.read(token)

    def clear(self, scope: str = "all") -> None:
        self._note_scope(scope, "clear", None)

    def _note_scope(self, scope: str, action: str, token: str | None) -> None:
        line = self.spark.createDataFrame([(scope, action, _now(), token)], self.scope_events.schema)
        self.scope_events.append(line.coalesce(1), token=token)

    # ---- feedback

    def feedback(self, labelled: DataFrame) -> dict[str, int]:
        """Log human labels (rows with ``flow_uid, human_label`` and the scored columns)
        and route each row by the human label."""
        rows = labelled.withColumn("feedback_ts", F.lit(_now()))
        model = F.col("prediction") if "prediction" in labelled.columns else F.lit(None).cast("string")
        token = self.feedback_log.append(
            rows.select("flow_uid", "human_label", model.alias("model_prediction"), "feedback_ts", F.lit("set").alias("action"))
        )
        buffer = routing.feedback_route(F.col("human_label"))
        return {
            "benign": self.benign.add(rows.filter(buffer == "benign"), f"feedback-{token}"),
            "attack": self.attack.add(rows.filter(buffer == "attack"), f"feedback-{token}"),
        }

    def clear_feedback(self, flows: DataFrame) -> None:
        """Reset the displayed label; log and buffers keep what happened."""
        nothing = F.lit(None).cast("string")
        self.feedback_log.append(
            flows.select("flow_uid", nothing.alias("human_label"), nothing.alias("model_prediction"),
                         F.lit(_now()).alias("feedback_ts"), F.lit("clear").alias("action"))
        )

    @property
    def feedback_count(self) -> int:
        return self.feedback_log.read().filter("action = 'set'").count()

    def labelled(self, scope: str = "all") -> DataFrame | None:
        rows = self.results(scope)
        return None if rows is None else routing.with_feedback(rows, self.feedback_log.read())

    def buffer_stats(self) -> dict:
        return {
            "replay_count": self.replay.count,
            "replay_max": self.replay.cap,
            "benign_count": self.benign.count,
            "attack_count": self.attack.count,
            "buffer_max": self.benign.cap,
            "attack_conf_threshold": self.attack_conf,
        }

    # ---- explanations

    def explain(self, flows: DataFrame, background: DataFrame | None = None, level: str = "both", **options) -> DataFrame:
        """Explain flows with the current model and keep the result for later."""
        bundle = self.current()
        start = ex.background_sample(background if background is not None else flows, bundle)
        token = self.explanations.append(ex.explain(flows, bundle, start, level, **options))
        return self.explanations.read(token)

    def cached(self, flows: DataFrame) -> DataFrame | None:
        """Stored explanations under the current version; other versions do not count."""
        if not self.explanations.exists():
            return None
        return ex.cached_explanations(flows, self.explanations.read(), self.current_version())

    # ---- adaptation

    def replay_rows(self, bundle: Bundle) -> DataFrame | None:
        """Replay rows scaled by this bundle's scaler."""
        rows = self.replay.load()
        return None if rows is None else rows.filter(F.col("scaler_id") == ad.scaler_id(bundle))

    def adapt(self, flows: DataFrame, mode: str | None = None, include_feedback: bool = False, **options) -> ad.Candidate:
        """Train a candidate on flows taken as normal and store it beside the live model."""
        live = self.current()
        if include_feedback:
            confirmed = self.benign.load()
            if confirmed is not None and "human_label" in confirmed.columns:
                names = ["flow_uid", *live.feature_names]
                extra = confirmed.filter("human_label = 'Normal'").select(*[quoted(c) for c in names])
                flows = flows.select(*[quoted(c) for c in names]).unionByName(extra).dropDuplicates(["flow_uid"])
        candidate = ad.adapt(flows, mode, live, self.replay_rows(live), **options)
        self.save(candidate.bundle)
        return candidate

    def accept(
        self, candidate: ad.Candidate, flows: DataFrame, scope: str | None = None, replay_cap: int | None = None
    ) -> DataFrame | None:
        """Make the candidate current, seed the replay buffer, score a scope again."""
        bundle = candidate.bundle.with_(status="accepted")
        self.save(bundle)
        rows = stage_table(ad.scaled_rows(flows, bundle))
        rows = sampling.sample_rows(rows, sampling.replay_seed_size(rows.count(), replay_cap))
        if candidate.mode == ad.INITIAL:
            self.replay.clear()
        self.replay.add(
            rows.withColumns({"model_version": F.lit(bundle.version), "scaler_id": F.lit(ad.scaler_id(bundle))}),
            token=f"accept-{bundle.version}",
        )
        self._promote(bundle.version, "accept")
        held = self.results(scope) if scope else None
        if held is None:
            return None
        return self._replace(scope, scoring.rescore(held, bundle, self._relative_to(held)))

    def reject(self, candidate: ad.Candidate) -> None:
        """Leave the live model as it is; the candidate stays on record."""
        self._promote(candidate.bundle.version, "reject")

    def set_threshold(self, threshold: float, scope: str = "all") -> DataFrame | None:
        """A new version with another threshold; stored rows are labelled again, not scored again."""
        live = self.current()
        child = live.with_(version=f"{live.version}-t{threshold:.6g}", parent=live.version, threshold=float(threshold), status="accepted")
        self.save(child)
        self._promote(child.version, "accept")
        held = self.results(scope)
        if held is None:
            return None
        again = scoring.relabel(held, threshold, self._relative_to(held), child.confidence_scale)
        return self._replace(scope, again.withColumn("model_version", F.lit(child.version)))

    @staticmethod
    def _relative_to(held: DataFrame) -> str | None:
        """The column the stored confidences were relative to, if not all rows."""
        names = [r[0] for r in held.select(SCOPE_COLUMN).distinct().limit(2).collect()] if SCOPE_COLUMN in held.columns else []
        return names[0] if len(names) == 1 else None
