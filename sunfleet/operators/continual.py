"""Continual learning: the replay buffer's contents, the quality gate, replay losses and hops of the online loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, BATCH = 1000, 32


def replay_buffer(df: DataFrame, seq: str = "seq", capacity: int = CAPACITY) -> DataFrame:
    """What a ring buffer holds after all rows in the order of `seq` (0, 1, ...): the last row of each slot seq mod capacity."""
    rest = [c for c in df.columns if c != seq]
    last = df.groupBy((F.col(seq) % capacity).alias("slot")).agg(F.max_by(F.struct(seq, *rest), seq).alias("row"))
    return last.select("slot", "row.*")


def replay_sample(buffer: DataFrame, n: int = BATCH, seed: int = 0) -> DataFrame:
    """min(n, all) rows without replacement."""
    return buffer.orderBy(F.rand(seed)).limit(n)


def gate(df: DataFrame, threshold: float | None, qs: str = "qs_mean") -> DataFrame:
    """df with updated: without a threshold always, else if the mean score is over it."""
    return df.withColumn("updated", F.lit(True) if threshold is None else F.coalesce(F.col(qs) > threshold, F.lit(False)))


def replay_loss(df: DataFrame, alpha: float = 0.2, beta: float = 1.0, least: int = BATCH) -> DataFrame:
    """One row: task loss of new rows, and with `least` replayed rows alpha * MSE(pred, old) + beta * MSE(pred, y) of these.
    df has replayed (boolean), pred, old_pred, y."""
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    old = F.col("replayed")
    one = df.agg(
        F.count_if(old).alias("n_replayed"), F.avg(F.when(~old, sq("pred", "y"))).alias("task"),
        F.avg(F.when(old, sq("pred", "old_pred"))).alias("mse_old"), F.avg(F.when(old, sq("pred", "y"))).alias("mse_y"),
    )
    extra = F.when(F.col("n_replayed") >= least, alpha * F.col("mse_old") + beta * F.col("mse_y")).otherwise(0.0)
    return one.withColumn("loss", F.col("task") + extra)


def hops(df: DataFrame, window: int = 720, stride: int = 168, order: str = "t_idx") -> DataFrame:
    """df with t for each hop t = window, window + stride, ... that has the row in [t - window, t); t is under the number of
    rows of the grid. A row is in at most ceil(window / stride) hops, which are reckoned, not joined."""
    total = df.agg((F.max(order) + 1).alias("__rows"))
    first = F.greatest(F.lit(0), F.ceil((F.col(order) + 1 - window) / stride)).cast("int")
    last = F.floor(F.col(order) / stride).cast("int")
    spans = df.withColumn("__k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array())))
    placed = spans.withColumn("t", F.col("__k") * stride + window)
    return placed.crossJoin(F.broadcast(total)).where((F.col("t") < F.col("__rows")) & (F.col(order) >= F.col("t") - window)).drop("__k", "__rows")


def window_quality(df: DataFrame) -> DataFrame:
    """plant, qs_last: the composite of clamped components at the last step (0 where it is missing), and per fleet the mean of
    positive ones, 0 without any, as qs_mean."""
    product = F.lit(1.0)
    for m in ("m1", "m2", "m3", "m4", "m5"):
        product = product * F.least(F.lit(1.0), F.greatest(F.coalesce(m, F.lit(0.0)), F.lit(0.0)))
    last = df.groupBy("plant").agg(F.max_by(F.pow(product, 0.2), "t_idx").alias("qs_last"))
    mean = last.agg(F.coalesce(F.avg(F.when(F.col("qs_last") > 0, F.col("qs_last"))), F.lit(0.0)).alias("qs_mean"))
    return last.crossJoin(F.broadcast(mean))
