"""Streams of readings: hourly medians, outages, drift per plant and the online step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunfleet.operators.diagnose import HALF, P_DRIFT, ks_drifts
from sunfleet.operators.quality import quality


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(path)


def hourly_medians(stream: DataFrame, key: str = "plant", time: str = "ts", value: str = "value", late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """key, time, value, n: tumbling medians; duplicates collapse in them, readings later than `late` are dropped. Works on
    batches and streams alike."""
    rows = stream.withColumn("__t", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        rows = rows.withWatermark("__t", late)
    out = rows.groupBy(F.window("__t", width).alias("w"), key).agg(F.median(value).alias("value"), F.count(value).alias("n"))
    return out.select(key, F.col("w.start").alias("time"), "value", "n")


def sliding_means(df: DataFrame, key: str, time: str, value: str, width: str, step: str, late: str = "2 hours") -> DataFrame:
    rows = df.withColumn("__t", F.col(time).cast("timestamp"))
    if df.isStreaming:
        rows = rows.withWatermark("__t", late)
    return rows.groupBy(F.window("__t", width, step).alias("w"), key).agg(F.avg(value).alias("value"), F.count(value).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "n")


def sessions(df: DataFrame, key: str = "plant", time: str = "ts", gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """key, start, end, n: runs of readings with no gap of `gap` or more."""
    rows = df.withColumn("__t", F.col(time).cast("timestamp"))
    if df.isStreaming:
        rows = rows.withWatermark("__t", late)
    return rows.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drift_stream(stream: DataFrame, key: str = "plant", order: str = "ts", value: str = "value", half: int = HALF, p: float = P_DRIFT) -> DataFrame:
    """key, n, drift, after each batch in which a plant has rows. The state is a plant's last 2 * half values, of bounded size."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = (np.array(state.get[0], float), state.get[1]) if state.exists else (np.zeros(0), 0)
        rows = pd.concat(list(frames)).sort_values(order)[value].to_numpy(float)
        rows = rows[~np.isnan(rows)]
        # the test after each value is of the 2 * half values up to it
        every = np.concatenate([held, rows])
        found = any(ks_drifts(every[max(0, end - 2 * half) : end], half, p) for end in range(len(held) + 1, len(every) + 1))
        state.update((every[-2 * half :].tolist(), n + len(rows)))
        n += len(rows)
        yield pd.DataFrame({key: [k[0]], "n": [n], "drift": [found]})

    rows = stream.select(key, order, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, drift boolean", "held array<double>, n long", "update", GroupStateTimeout.NoTimeout)


def score_stream(stream: DataFrame, scales: DataFrame, path: str, checkpoint: str, window: int = 720, least: int | None = None) -> None:
    """Scores all that is there of a stream of cube rows (plant, t_idx, time, energia, poa, temp; each plant's in order), batch by
    batch, into <path>/scores; equal to quality() over the whole cube with these scales.

    What a window reaches back to, the last window - 1 rows of each plant, is kept beside the scores, one folder for each
    batch: a batch that runs again reads the rows of the one before it and writes its own folders anew.
    """
    columns = ["plant", "t_idx", "time", "energia", "poa", "temp"]

    def each(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*columns, F.lit(True).alias("new"))
        rows = new if k == 0 else new.unionByName(spark.read.parquet(f"{path}/history/{k - 1}").select(*columns, F.lit(False).alias("new")))
        scored = quality(rows.select(*columns), window, least, scales=scales)
        scored.join(new.select("plant", "t_idx"), ["plant", "t_idx"], "left_semi").write.mode("overwrite").parquet(f"{path}/scores/batch={k}")
        last = F.row_number().over(Window.partitionBy("plant").orderBy(F.desc("t_idx")))
        rows.withColumn("k", last).where(F.col("k") < window).select(*columns).write.mode("overwrite").parquet(f"{path}/history/{k}")

    run_available(stream, checkpoint, each)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Handles all that is there, batch by batch, and ends; progress is kept in `checkpoint`."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def run_online(cube: DataFrame, agent: Callable[[DataFrame, int], dict], window: int = 720, stride: int = 168, retrain: Callable[[DataFrame, int], tuple[float, float]] | None = None) -> list[dict]:
    """The online loop over hops of a cube: agent(window, t) reports; where its action is retrain_triggered, retrain gives the
    losses before and after. The driver handles one small report for each hop."""
    total = cube.agg(F.max("t_idx")).first()[0]
    history = []
    for t in range(window, (total if total is not None else -1) + 1, stride):
        part = cube.where(F.col("t_idx").between(t - window, t - 1))
        entry = agent(part, t) | {"t": t}
        if retrain is not None and entry.get("action") == "retrain_triggered":
            before, after = retrain(part, t)
            pct = (before - after) / (abs(before) + 1e-9) * 100
            entry |= {"loss_before": before, "loss_after": after, "improvement_pct": round(pct, 2), "verdict": "improved" if pct > 5 else "degraded" if pct < -5 else "stable"}
        history.append(entry)
    return history
