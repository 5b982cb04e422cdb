"""Where scored rows and feedback go, and what label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ranks import join_small
from tidewatch.operators.scoring import ATTACK, NORMAL

# Fixed value.
ATTACK_CONFIDENCE = 0.60


def benign_rows(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("prediction") == NORMAL)


def attack_rows(scored: DataFrame, confidence: float = ATTACK_CONFIDENCE) -> DataFrame:
    """Attacks the model is sure of; other attacks go nowhere."""
    return scored.filter((F.col("prediction") == ATTACK) & (F.col("confidence") >= confidence))


def feedback_route(human_label: Column) -> Column:
    """The buffer a human label sends its row to."""
    return F.when(human_label == NORMAL, "benign").otherwise("attack")


def effective_feedback(feedback: DataFrame) -> DataFrame:
    """Latest event per flow; a ``clear`` event leaves no label."""
    latest = feedback.groupBy("flow_uid").agg(
        F.max_by(F.struct("action", "human_label"), F.struct("feedback_ts", "action", "human_label")).alias("e")
    )
    return latest.select("flow_uid", F.when(F.col("e.action") == "set", F.col("e.human_label")).alias("human_label"))


def with_feedback(scored: DataFrame, feedback: DataFrame) -> DataFrame:
    """Scored rows with the human label in force, NULL if none."""
    return join_small(scored.drop("human_label"), effective_feedback(feedback), ["flow_uid"], "left")


def effective_class(scored: DataFrame) -> DataFrame:
    """Human label before prediction, and whether a human gave it."""
    return scored.withColumns(
        {
            "effective_label": F.coalesce("human_label", "prediction"),
            "human_confirmed": F.col("human_label").isNotNull(),
        }
    )


def agreement(scored: DataFrame) -> DataFrame:
    """Counts of confirmed and corrected predictions per label pair."""
    given = scored.filter(F.col("human_label").isNotNull())
    verdict = F.when(F.col("human_label") == F.col("prediction"), "confirmed").otherwise("corrected")
    return given.groupBy("prediction", "human_label", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
