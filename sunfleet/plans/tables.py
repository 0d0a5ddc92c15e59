"""The tables' roles: a fleet's daily telemetry, weather, plants and forecasts, as DataFrames and as SQL.

Suppliers are plants and line items their readings, several a day; weather and places are integer arithmetic on keys, so that
both engines have the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfleet.operators.align import densify, median_readings

#: Rows of a rolling window and the valid ones that it needs, for daily data with gaps.
WINDOW, LEAST = 240, 40


_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries over the same files read several times, kept until other files are read or release() is
    called. It also cuts plans, which would hold its own for each time it is read."""
    key = (spark.sparkContext.applicationId, id(spark), d, name)
    if key not in _KEPT:
        release(but=key[:3])
        _KEPT[key] = make().persist()
    return _KEPT[key]


def release(but: tuple = ()) -> None:
    """Frees what kept() keeps, but for the tables of an application, session and folder."""
    for key in [k for k in _KEPT if k[:3] != but]:
        df = _KEPT.pop(key)
        if df.sparkSession.sparkContext._jsc is not None and key[0] == df.sparkSession.sparkContext.applicationId:
            df.unpersist()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def readings(spark: SparkSession, d: str) -> DataFrame:
    """plant, time, energia: medians of a day's line items. They are dealt by plant, as all that follows is."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("plant"), F.col("l_shipdate").alias("time"), F.col("l_quantity").cast("double").alias("energia"))
    return median_readings(rows.repartition("plant"), ["plant", "time"], "energia")


def cube(spark: SparkSession, d: str) -> DataFrame:
    """plant, time, t_idx, energia, poa, temp, wind on the dense grid; a fifth of the cells is dark."""
    grid = densify(readings(spark, d))
    p, t = F.col("plant"), F.col("t_idx")
    poa = F.when((p * 7 + t) % 5 == 0, 0.0).otherwise(((p * 37 + t * 53) % 1000).cast("double"))
    return grid.withColumns({"poa": poa, "temp": ((p * 13 + t * 7) % 350) / 10.0, "wind": ((p + t * 3) % 80) / 10.0})


CUBE = """
readings AS (SELECT l_suppkey::INT AS plant, l_shipdate AS time, median(l_quantity::DOUBLE) AS energia FROM lineitem GROUP BY 1, 2),
times AS (SELECT time, (row_number() OVER (ORDER BY time) - 1)::INT AS t_idx FROM (SELECT DISTINCT time FROM readings)),
grid AS (SELECT plant, time, t_idx FROM (SELECT DISTINCT plant FROM readings) CROSS JOIN times),
cube AS (
  SELECT g.plant, g.time, g.t_idx, r.energia,
    CASE WHEN (g.plant * 7 + g.t_idx) % 5 = 0 THEN 0.0::DOUBLE ELSE ((g.plant * 37 + g.t_idx * 53) % 1000)::DOUBLE END AS poa,
    ((g.plant * 13 + g.t_idx * 7) % 350) / 10.0::DOUBLE AS temp, ((g.plant + g.t_idx * 3) % 80) / 10.0::DOUBLE AS wind
  FROM grid g LEFT JOIN readings r ON r.plant = g.plant AND r.time = g.time
)"""

SCALES = (
    CUBE
    + """,
dayrows AS (SELECT plant, energia, poa / 1000.0::DOUBLE AS ref FROM cube WHERE poa / 1000.0::DOUBLE > 0.05),
cap AS (
  SELECT plant, CASE WHEN count(*) FILTER (energia > 0) > 10 AND quantile_cont(ref, 0.99) FILTER (energia > 0) > 1e-6 AND quantile_cont(energia, 0.99) FILTER (energia > 0) > 1e-6
    THEN quantile_cont(energia, 0.99) FILTER (energia > 0) / quantile_cont(ref, 0.99) FILTER (energia > 0) ELSE 1.0 END AS capacity_scale, quantile_cont(energia, 0.99) AS day_peak
  FROM dayrows GROUP BY plant
),
eta AS (SELECT d.plant, median(energia / (ref * capacity_scale + 1e-6)) AS eta, count(*) AS n FROM dayrows d JOIN cap USING (plant) WHERE energia IS NOT NULL GROUP BY 1),
scales AS (
  SELECT p.plant, coalesce(capacity_scale, 1.0) AS capacity_scale, least(2.0, greatest(0.1, coalesce(CASE WHEN n > 10 THEN eta END, 0.15))) AS eta_base,
    CASE WHEN capacity_scale IS NULL THEN 1.0 ELSE day_peak END AS day_peak
  FROM (SELECT DISTINCT plant FROM cube) p LEFT JOIN cap USING (plant) LEFT JOIN eta USING (plant)
)"""
)

QUALITY = (
    SCALES
    + f""",
q0 AS (SELECT c.*, s.capacity_scale, s.day_peak, s.eta_base, coalesce(poa / 1000.0::DOUBLE > 0.05, false) AS day, coalesce(poa / 1000.0::DOUBLE < 1e-6, false) AS dark, poa / 1000.0::DOUBLE * s.capacity_scale AS ref FROM cube c JOIN scales s USING (plant)),
q1 AS (SELECT *, CASE WHEN day THEN energia END AS r, CASE WHEN day THEN ref END AS v, energia IS NULL AS gap FROM q0),
q2 AS (SELECT *, CASE WHEN r IS NOT NULL AND v IS NOT NULL THEN r END AS rp, CASE WHEN r IS NOT NULL AND v IS NOT NULL THEN v END AS vp,
  CASE WHEN r IS NOT NULL THEN greatest(0.0, 1.0 - r / (ref + 1e-6) / (eta_base * (1.0 - 0.004 * (temp - 25.0)) + 1e-6)) END AS short FROM q1),
q3 AS (
  SELECT *, CASE WHEN count(rp) OVER w >= {LEAST} AND min(rp) OVER w < max(rp) OVER w AND min(vp) OVER w < max(vp) OVER w
      THEN least(1.0, greatest(0.0, covar_pop(rp, vp) OVER w / (stddev_pop(rp) OVER w * stddev_pop(vp) OVER w))) END AS m1,
    CASE WHEN count(rp) OVER w >= {LEAST} AND count(v) OVER w >= {LEAST} THEN least(1.0, greatest(0.0, 1.0 - abs(avg(rp - vp) OVER w) / (abs(avg(v) OVER w) + 1e-6))) END AS m2,
    1.0 - avg(gap::INT) OVER w AS m3,
    CASE WHEN count(r) OVER w >= {LEAST} AND count(v) OVER w >= {LEAST} THEN least(1.0, greatest(0.0, stddev_samp(r) OVER w / (stddev_samp(v) OVER w + 1e-6))) END AS m4,
    CASE WHEN count(short) OVER w >= {LEAST} THEN least(1.0, greatest(0.0, 1.0 - avg(short) OVER w)) END AS m5
  FROM q2 WINDOW w AS (PARTITION BY plant ORDER BY t_idx ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)
),
quality AS (
  SELECT plant, t_idx, time, energia, poa, temp, CASE WHEN day THEN m1 END AS m1, CASE WHEN day THEN m2 END AS m2, m3, CASE WHEN day THEN m4 END AS m4, CASE WHEN day THEN m5 END AS m5, capacity_scale,
    CASE WHEN day THEN CASE WHEN m1 * m2 * m3 * m4 * m5 IS NOT NULL THEN least(1.0, greatest(0.0, pow(m1 * m2 * m3 * m4 * m5, 0.2))) END
         WHEN dark AND energia IS NOT NULL THEN CASE WHEN energia <= 0.01 * (day_peak + 1e-6) THEN 1.0 ELSE 0.0 END END AS qs
  FROM q3
)"""
)


def plants(spark: SparkSession, d: str) -> DataFrame:
    """plant, lat, lon, nation."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.cast("int").alias("plant"), (44 + (k * 37 % 150) / 100.0).alias("lat"), (7.7 + (k * 53 % 130) / 100.0).alias("lon"), F.col("s_nationkey").cast("int").alias("nation"))


PLANTS = "plants AS (SELECT s_suppkey::INT AS plant, 44 + (s_suppkey * 37 % 150) / 100.0::DOUBLE AS lat, 7.7::DOUBLE + (s_suppkey * 53 % 130) / 100.0::DOUBLE AS lon, s_nationkey::INT AS nation FROM supplier)"


def sites(spark: SparkSession, d: str) -> DataFrame:
    """location, lat, lon: a weather grid made of the nations' keys."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.cast("int").alias("location"), (44 + (k * 29 % 150) / 100.0).alias("lat"), (7.7 + (k * 31 % 130) / 100.0).alias("lon"))


SITES = "sites AS (SELECT n_nationkey::INT AS location, 44 + (n_nationkey * 29 % 150) / 100.0::DOUBLE AS lat, 7.7::DOUBLE + (n_nationkey * 31 % 130) / 100.0::DOUBLE AS lon FROM nation)"


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """plant, time, true_pv, pred_pv, true_ghi, pred_ghi, eta, qs (with gaps): one row per line item."""
    k, n = F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long")
    q = F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("plant"), F.col("l_shipdate").alias("time"), (q / 50).alias("true_pv"),
        (q / 50 + ((k * 17 + n * 5) % 41 - 20) / 200.0).alias("pred_pv"), ((k + n) % 100 / 100.0).alias("true_ghi"),
        ((k * 3 + n) % 97 / 97.0).alias("pred_ghi"), (F.lit(0.5) + (k % 5) / 10.0).alias("eta"),
        F.when(k % 19 != 0, (k * 7 + n * 13) % 1000 / 1000.0).alias("qs"),
    )


FORECASTS = """forecasts AS (
  SELECT l_suppkey::INT AS plant, l_shipdate AS time, l_quantity::DOUBLE / 50 AS true_pv,
    l_quantity::DOUBLE / 50 + ((l_orderkey * 17 + l_linenumber * 5) % 41 - 20) / 200.0::DOUBLE AS pred_pv,
    (l_orderkey + l_linenumber) % 100 / 100.0::DOUBLE AS true_ghi, (l_orderkey * 3 + l_linenumber) % 97 / 97.0::DOUBLE AS pred_ghi,
    0.5::DOUBLE + (l_orderkey % 5) / 10.0::DOUBLE AS eta, CASE WHEN l_orderkey % 19 <> 0 THEN (l_orderkey * 7 + l_linenumber * 13) % 1000 / 1000.0::DOUBLE END AS qs
  FROM lineitem)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that sum in another order agree; there is no negative zero."""
    return df.withColumns({f.name: F.round(f.name, digits) + F.lit(0.0) for f in df.schema.fields if f.dataType.typeName() == "double"})
