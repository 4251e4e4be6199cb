"""Choosing among services: eligibility with all reasons, scores, quotas, telemetry, spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.select import reasons
from evidra.operators.stats import nearest_ranks


def eligible(candidates: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """candidates with every reason that speaks against each, and whether there is none."""
    marked = candidates.withColumn("reasons", reasons(checks))
    return marked.withColumn("eligible", F.size("reasons") == 0)


def ranked(candidates: DataFrame, task: str, weights: dict[str, float], tie: str) -> DataFrame:
    """score (weighted sum, 6 digits) and place of each candidate of a task; ties by `tie`."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    scored = candidates.withColumn("score", F.round(total, 6))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(task).orderBy(F.desc("score"), tie)).cast("long"))


def usage(log: DataFrame, keys: list[str], ok: Column, latency: str, cost: str) -> DataFrame:
    """keys, calls, success (share, 4 digits), p50 and p95 latency of good calls by nearest rank, cost."""
    totals = log.groupBy(*keys).agg(F.count("*").alias("calls"), F.round(F.avg(ok.cast("double")), 4).alias("success"), F.round(F.sum(cost), 4).alias("cost"))
    ranks = nearest_ranks(log.where(ok), keys, latency, {"p50": 0.5, "p95": 0.95})
    return totals.join(ranks, keys, "left").select(*keys, "calls", "success", "p50", "p95", "cost")


def recent_median(log: DataFrame, key: str, order: str, value: str, ok: Column, last: int = 50, least: int = 3) -> DataFrame:
    """key, p50: median of the last so many good values; null with too few."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    some = log.where(ok).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    return some.groupBy(key).agg(F.when(F.count("*") >= least, F.percentile(value, F.lit(0.5))).alias("p50"))


def used(log: DataFrame, keys: list[str], order: str, cost: str) -> DataFrame:
    """keys, cost, calls. Costs are added one after the other by `order`, so a sum at a limit doesn't depend on how rows were dealt to tasks."""
    w = Window.partitionBy(*keys).orderBy(order, cost)
    running = log.withColumns({"_sum": F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w)})
    return running.groupBy(*keys).agg(F.max_by("_sum", "_n").alias("cost"), F.count("*").alias("calls"))


def quota_check(used: DataFrame, limits: dict[str, float], reserve: float = 0.1) -> DataFrame:
    """pressure (largest share of a limit used) and the first limit that is over; the daily one keeps a reserve."""
    cap = {c: limit * (1 - reserve) if c == "day" else limit for c, limit in limits.items()}
    pressure = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) / v for c, v in cap.items()]) if len(cap) > 1 else F.col(next(iter(cap))) / next(iter(cap.values()))
    over = F.coalesce(*[F.when(F.col(c) > v, F.lit(c)) for c, v in cap.items()])
    return used.withColumns({"pressure": F.round(pressure, 6), "over": over})


#: Seconds, measure and whether a reserve is kept, of each limit.
LIMITS = {
    "rpm": (60, "requests", False), "tpm": (60, "tokens", False), "otpm": (60, "tokens_out", False), "rpd": (86400, "requests", True), "tpd": (86400, "tokens", True),
    "monthly_calls": (30 * 86400, "requests", True), "monthly_credit_usd": (30 * 86400, "cost", True),
}


def quota(log: DataFrame, models: DataFrame, at: Column, reserve: float = 0.1) -> DataFrame:
    """model_id, reason (first limit that the next call would break, else null), pressure of every model.

    log: model_id, ts (seconds), est_tokens, tokens, est_out, tokens_out, cost, status; rejected rows don't count, and a reserved row counts by its
    estimate until it is reconciled. models: model_id, est_tokens, est_out of the next call, cap (cost in all, or null) and a column a limit (null or 0: none)."""
    named = [k for k in LIMITS if k in models.columns]
    counted = log.where("status <> 'rejected'")
    measure = {"requests": F.lit(1), "tokens": F.coalesce("tokens", "est_tokens"), "tokens_out": F.coalesce("tokens_out", "est_out"), "cost": F.col("cost")}
    used = counted.groupBy("model_id").agg(*[F.coalesce(F.sum(F.when(F.col("ts") > at - LIMITS[k][0], measure[LIMITS[k][1]])), F.lit(0)).cast("double").alias(f"_{k}") for k in named])
    spent = log.groupBy("model_id").agg(F.sum("cost").alias("_spent"))
    rows = models.join(used, "model_id", "left").join(spent, "model_id", "left").fillna(0.0, [*[f"_{k}" for k in named], "_spent"])
    add = {"requests": F.lit(1.0), "tokens": F.col("est_tokens"), "tokens_out": F.col("est_out"), "cost": F.lit(0.0)}
    over, shares = [], [F.lit(0.0)]
    for k in named:
        limit, (_, what, kept) = F.when(F.col(k) > 0, F.col(k).cast("double")), LIMITS[k]
        over.append(F.when(F.col(f"_{k}") + add[what] > limit * (1 - reserve if kept else 1), F.lit(k)))
        shares.append(F.when(limit.isNotNull(), F.least(F.lit(1.0), F.col(f"_{k}") / limit)))
    capped = F.when(F.col("_spent") >= F.col("cap"), F.lit("cap"))
    shares.append(F.when(F.col("cap") > 0, F.least(F.lit(1.0), F.col("_spent") / F.col("cap"))).when(F.col("cap") == 0, 1.0))
    return rows.select("model_id", F.coalesce(*over, capped).alias("reason"), F.round(F.greatest(*shares), 6).alias("pressure"))


def spend(log: DataFrame, keys: list[str], order: str, cost: str, cap: float, stop: float = 0.8) -> DataFrame:
    """Running cost of each key and whether it is at the stop line or over the cap."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = log.withColumn("spent", F.sum(cost).over(w))
    return total.withColumn("state", F.when(F.col("spent") > cap, "capped").when(F.col("spent") >= stop * cap, "stopping").otherwise("open"))
