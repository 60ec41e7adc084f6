"""Confidence tuning: a bandit with a few arms for each matching method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import constants as K
from kindred.sources.io import latest

ARM_SCHEMA = "method string, arm int, target double, reward double, trials long"
FEATURES = 31
EPSILON = 0.1


def default_arms(spark: SparkSession) -> DataFrame:
    rows = [(m, i, t, 0.0, 0) for m, arms in K.ARMS.items() for i, t in enumerate(arms)]
    return spark.createDataFrame(rows, ARM_SCHEMA)


def average_reward(reward: Column, trials: Column) -> Column:
    return F.when(trials > 0, reward / trials).otherwise(0.0)


def ucb(reward: Column, trials: Column, total: Column) -> Column:
    """Upper bound of an arm's reward; arms never tried come first."""
    return F.when(trials == 0, F.lit(float("inf"))).otherwise(average_reward(reward, trials) + F.sqrt(2 * F.log(F.greatest(total, F.lit(1))) / trials))


def choices(arms: DataFrame) -> DataFrame:
    """For each method the arm of the largest bound (of equals, the last) and all its targets in order."""
    total = arms.groupBy("method").agg(F.sum("trials").alias("total"))
    scored = arms.join(total, "method").withColumn("ucb", ucb(F.col("reward"), F.col("trials"), F.col("total")))
    return scored.groupBy("method").agg(F.max_by("target", F.struct("ucb", "arm")).alias("chosen"), F.transform(F.array_sort(F.collect_list(F.struct("arm", "target"))), lambda a: a["target"]).alias("targets"))


def tune(pairs: DataFrame, arms: DataFrame, epsilon: float = 0.0, run: str = "") -> DataFrame:
    """Replace the confidence of pairs by the target of their method's arm.

    With ``epsilon`` that share of pairs, chosen by a hash of the pair and the
    run, gets an arm by the same hash. A method without arms of its own has the
    default ones, and the fallback confidence if there are none either.
    """
    picks = choices(arms)
    mine = F.broadcast(picks.withColumnRenamed("method", "method_type"))  # one row a method
    rest = F.broadcast(picks.where("method = 'default'").select(F.col("chosen").alias("_d"), F.col("targets").alias("_t")))
    h = F.pmod(F.xxhash64("entity_id_1", "entity_id_2", F.lit(run)), F.lit(1 << 30))
    out = pairs.join(mine, "method_type", "left").join(rest, F.lit(True), "left")
    targets = F.coalesce("targets", "_t")
    explored = F.when(F.size(targets) > 0, F.try_element_at(targets, (F.pmod(F.xxhash64(h, F.lit(1)), F.size(targets)) + 1).cast("int")))
    chosen = F.coalesce("chosen", "_d", F.lit(K.FALLBACK_CONFIDENCE))
    return out.withColumn("confidence_score", F.when(h < int(epsilon * (1 << 30)), F.coalesce(explored, chosen)).otherwise(chosen)).select(pairs.columns)


def update_arms(arms: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Arms after outcomes (method, tuned, reward); outcomes that meet no arm change nothing."""
    gains = arms.select("method", "arm", "target").join(outcomes.where(F.col("tuned").isNotNull()), "method").where(F.abs(F.col("target") - F.col("tuned")) < 1e-9).groupBy("method", "arm").agg(F.sum("reward").alias("_r"), F.count("*").alias("_n"))
    return arms.join(gains, ["method", "arm"], "left").select("method", "arm", "target", (F.col("reward") + F.coalesce("_r", F.lit(0.0))).alias("reward"), (F.col("trials") + F.coalesce("_n", F.lit(0))).alias("trials"))


def arm_stats(arms: DataFrame) -> DataFrame:
    return arms.select("method", "arm", "target", "trials", average_reward(F.col("reward"), F.col("trials")).alias("average_reward"))


def pending_feedback(feedback: DataFrame, n: int = 1000) -> DataFrame:
    """The oldest feedback that no update has used."""
    return feedback.where("processed_for_tuner_update_at is null").orderBy("feedback_timestamp", "id").limit(n)


def feedback_outcomes(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcomes of feedback: method, tuned, reward 1 for confirmed and 0 for rejected pairs.

    Each pair's latest decision counts; feedback without one, or with features
    that are no list of numbers, has no outcome.
    """
    last = latest(decisions, ["entity_group_id"], [F.col("created_at").desc(), F.col("pipeline_run_id").desc()])
    joined = feedback.join(last, "entity_group_id").withColumn("f", F.from_json("snapshotted_features", "array<double>")).where(F.size("f") > 0)
    return joined.select(F.col("method_type_at_decision").alias("method"), F.col("tuned_confidence").alias("tuned"), F.col("is_match_correct").cast("double").alias("reward"))


def process_feedback(arms: DataFrame, feedback: DataFrame, decisions: DataFrame, now: Column, n: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Arms after the next ``n`` feedback rows, and the feedback table with these rows marked."""
    taken = pending_feedback(feedback, n)
    marked = feedback.join(taken.select("id", F.lit(True).alias("_taken")), "id", "left")
    return update_arms(arms, feedback_outcomes(taken, decisions)), marked.withColumn("processed_for_tuner_update_at", F.when(F.col("_taken"), now).otherwise(F.col("processed_for_tuner_update_at"))).select(feedback.columns)


def decision_details(pairs: DataFrame, contexts: DataFrame, run: str, version: int, now: Column) -> DataFrame:
    """Snapshots of what the tuner saw: one row a stored pair (entity_group id) with its 31 features as JSON."""
    joined = pairs.join(contexts, ["entity_id_1", "entity_id_2"])
    return joined.select(
        F.col("id").alias("entity_group_id"), F.lit(run).alias("pipeline_run_id"), F.to_json("features").alias("snapshotted_features"), F.col("method_type").alias("method_type_at_decision"),
        F.col("pre_rl_confidence_score").alias("pre_rl_confidence"), F.col("confidence_score").alias("tuned_confidence"), F.lit(version).alias("confidence_tuner_version"), now.alias("created_at"),
    )


def reviewer_weight(feedback: DataFrame) -> DataFrame:
    """How much tuned confidences count against plain ones: 0.4 and 0.4 more at full accuracy; 0.6 unknown.

    Feedback that the system itself gave is left out.
    """
    human = feedback.where("reviewer_id != 'ml_system'").agg(F.count("*").alias("n"), F.count(F.when(F.col("was_correct"), 1)).alias("right"))
    return human.select(F.when(F.col("n") > 0, 0.4 + 0.4 * F.col("right") / F.col("n")).otherwise(0.6).alias("rl_weight"))


def confidence_class(score: Column) -> Column:
    return F.when(score >= 0.95, "VeryHigh").when(score >= 0.85, "High").when(score >= 0.75, "Medium").when(score >= 0.65, "Low").otherwise("VeryLow")
