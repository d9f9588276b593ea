"""From evidence of usable models to a recommendation for each kind of task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.usage import family, family_rank

#: Tasks and their rules; confidence of each strength; days that count as recent (fixed values).
ROUTES = (
    ("planner", "best"), ("orchestrator", "best"), ("root_cause_analysis", "best"), ("code_review", "sonnet-or-best"),
    ("explore_search", "haiku"), ("mechanical_edit", "haiku"), ("summarize", "haiku"),
)
CONFIDENCE = (("explicit", "high"), ("recent", "medium"), ("stale", "low"))
WINDOW_DAYS, RECENT_DAYS = 30, 7


def log_evidence(logs: DataFrame) -> DataFrame:
    """``model, family, strength``: the youngest model id of each family seen in logs (model, age_days) of the last 30 days."""
    known = logs.withColumn("family", family(F.col("model"))).filter((F.col("age_days") <= WINDOW_DAYS) & F.col("family").isNotNull())
    young = known.groupBy("family").agg(F.min_by("model", F.struct("age_days", "model")).alias("model"), F.min("age_days").alias("age"))
    return young.select("model", "family", F.when(F.col("age") <= RECENT_DAYS, "recent").otherwise("stale").alias("strength"))


def best_evidence(evidence: DataFrame) -> DataFrame:
    """The most capable family in evidence (the first of equals by ``seq``) with its confidence; no row without evidence."""
    e = evidence.withColumn("family", family(F.col("model"))).filter("family is not null")
    first = F.row_number().over(Window.orderBy(F.desc("rank"), "seq"))
    conf = F.coalesce(*[F.when(F.col("x.strength") == s, F.lit(c)) for s, c in CONFIDENCE])
    per = e.groupBy("family").agg(F.min_by(F.struct("model", "strength"), "seq").alias("x"), F.min("seq").alias("seq")).withColumn("rank", family_rank(F.col("family")))  # at most four rows
    return per.withColumn("r", first).filter("r = 1").select("family", "x.model", "rank", conf.alias("confidence"))


def routing(best: DataFrame) -> DataFrame:
    """``task, target`` for every task; 'inherit' where there is no evidence."""
    spark = best.sparkSession
    rules = spark.createDataFrame(list(ROUTES), "task string, rule string")
    b = rules.join(F.broadcast(best), F.lit(True), "left")
    sonnet = F.when(F.col("rank") >= 2, "sonnet").otherwise(F.col("family"))
    return b.select("task", F.when(F.col("family").isNull(), "inherit").when(F.col("rule") == "best", F.col("family")).when(F.col("rule") == "sonnet-or-best", sonnet).otherwise(F.col("rule")).alias("target"))
