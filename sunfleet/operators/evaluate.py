"""Evaluation of forecasts and its reports. An evaluation table has plant, time, pred_pv, true_pv, pred_ghi, true_ghi, qs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunfleet.functions.scalar import bucket, clip, digitize
from sunfleet.operators import quantiles

KPIS = ("rmse", "mae", "both", "none")
NAMES = ("low", "mid-low", "mid", "mid-high", "high")


def _correlation(x: Column, y: Column) -> Column:
    """corr() that is NULL, not an error, where a side is constant or a pair is missing."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def error_measures(pred: Column | str, true: Column | str) -> dict[str, Column]:
    """n, mae, rmse, bias, r and negatives over complete pairs; NULL without any."""
    p, t = (F.col(x) if isinstance(x, str) else x for x in (pred, true))
    e = p - t
    return {
        "n": F.count(e),
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "bias": F.avg(e),
        "r": _correlation(p, t),
        "negatives": F.count_if((p < 0) & t.isNotNull()),
    }


def measured(df: DataFrame, pred: str, true: str, by: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    m = error_measures(pred, true)
    return df.groupBy(*(by or [])).agg(*[c.alias(k) for k, c in m.items() if only is None or k in only])


def finite(df: DataFrame, *names: str) -> DataFrame:
    """Rows whose named numbers are all there and finite."""
    for n in names:
        df = df.where(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")))
    return df


def quantile_edges(df: DataFrame, value: str = "qs", at: tuple[float, ...] = (0.05, 0.25, 0.75, 0.95)) -> list[float]:
    """Percentiles of `value`; none without a value."""
    found = quantiles.overall(df, value, list(at))
    return [] if found[0] is None else found


def by_bins(df: DataFrame, edges: list[float], value: str = "qs", pred: str = "pred_pv", true: str = "true_pv", labels: tuple[str, ...] = NAMES) -> DataFrame:
    """Error measures, means and share of all rows for each bin [edge, next edge) of `value`; open at both ends."""
    rows = finite(df, value, pred, true).withColumn("bin", bucket(value, edges, labels))
    m = error_measures(pred, true)
    grouped = rows.groupBy("bin").agg(m["n"].alias("n"), F.avg(value).alias("q_mean"), m["mae"].alias("mae"), m["rmse"].alias("rmse"), m["bias"].alias("bias"), F.avg(true).alias("true_mean"), F.avg(pred).alias("pred_mean"))
    return grouped.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)  # a row for each bin


def by_quantile_bins(df: DataFrame, value: str = "qs") -> DataFrame:
    return by_bins(df, quantile_edges(finite(df, value, "pred_pv", "true_pv"), value), value)


def bin_correlation(bins: DataFrame) -> DataFrame:
    """Correlation of mean score and error over bins; NULL with fewer than two."""
    return bins.agg(F.when(F.count("*") >= 2, _correlation(F.col("q_mean"), F.col("mae"))).alias("corr_qs_mae"))


def strata(df: DataFrame, pv_edges: list[float], qs_edges: list[float], least: int = 100) -> DataFrame:
    """pv_bin, qs_bin, n, mae, bias; without the lowest energy bin and the highest score bin, and with `least` rows."""
    rows = finite(df, "qs", "pred_pv", "true_pv").withColumns({"pv_bin": digitize("true_pv", pv_edges), "qs_bin": digitize("qs", qs_edges)})
    kept = rows.where((F.col("pv_bin") > 0) & (F.col("qs_bin") < len(qs_edges)))
    return measured(kept, "pred_pv", "true_pv", ["pv_bin", "qs_bin"], ["n", "mae", "bias"]).where(F.col("n") >= least)


def summary(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, std (population) and the 10th, 25th, 50th, 75th and 90th percentile."""
    names = (10, 25, 50, 75, 90)
    found = quantiles.overall(df, value, [x / 100 for x in names])
    one = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return one.select("n", "mean", "std", *[F.lit(p).cast("double").alias(f"p{x}") for p, x in zip(found, names, strict=True)])


def level_counts(df: DataFrame, value: str = "qs") -> DataFrame:
    c = F.col(value)
    return df.agg(F.count_if(c > 0.7).alias("good"), F.count_if((c >= 0.5) & (c <= 0.7)).alias("fair"), F.count_if(c < 0.5).alias("poor"), F.count_if(c.isNull()).alias("missing"))


def top(df: DataFrame, by: str, k: int, key: str = "plant", lowest: bool = False) -> DataFrame:
    """The k rows with the largest (or smallest) `by`, equal ones by key; missing values are left out."""
    order = F.col(by).asc() if lowest else F.col(by).desc()
    return df.where(F.col(by).isNotNull()).orderBy(order, key).limit(k)


def gather(df: DataFrame, wanted: DataFrame, value: str = "qs") -> DataFrame:
    """wanted (plant, t_idx and whatever else) with df's value at those places, NULL where there is none."""
    return wanted.join(df.select("plant", "t_idx", value), ["plant", "t_idx"], "left")


def month_labels(time: Column | str) -> tuple[Column, Column]:
    """A time's month as "Jan" and as "Jan 2024"."""
    return F.date_format(time, "MMM"), F.date_format(time, "MMM yyyy")


def months(df: DataFrame, time: str = "time") -> DataFrame:
    """month, rows, coverage: rows in percent of those that hourly data of the whole month would have."""
    first = F.date_trunc("month", F.col(time))
    grouped = df.groupBy(first.cast("date").alias("month")).agg(F.count("*").alias("rows"))
    return grouped.withColumn("coverage", F.col("rows") / (F.dayofmonth(F.last_day("month")) * 24) * 100)


def calibrate(df: DataFrame, kpi: str = "none", threshold: float = 0.01, floor: float = 0.0, least: int = 100) -> DataFrame:
    """One row: a line from predicted to true energy over daytime rows, errors before and after it, and whether it is used.

    The line is least squares, 1 and 0 where there is none; with fewer than `least` rows it is not used. kpi says what must
    improve; ValueError for an unknown one.
    """
    if kpi not in KPIS:
        raise ValueError(f"kpi must be one of {', '.join(KPIS)}")
    day = finite(df.where(F.col("true_ghi") > threshold), "pred_pv", "true_pv").select(F.col("pred_pv").alias("p"), F.col("true_pv").alias("t"))
    enough = F.count("*") >= least
    flat = F.min("p") >= F.max("p")
    line = day.agg(
        F.count("*").alias("n_samples"),
        F.when(enough & ~flat, F.regr_slope("t", "p")).alias("slope"),
        F.when(enough & ~flat, F.regr_intercept("t", "p")).alias("intercept"),
    ).select("n_samples", F.coalesce("slope", F.lit(1.0)).alias("slope"), F.when(F.col("slope").isNull(), 0.0).otherwise(F.col("intercept")).alias("intercept"))
    raw = F.col("slope") * F.col("p") + F.col("intercept")
    after = F.greatest(raw, F.lit(floor))
    e, g = F.col("p") - F.col("t"), after - F.col("t")
    both = day.crossJoin(F.broadcast(line)).agg(
        F.avg(F.abs(e)).alias("mae_before"), F.avg(F.abs(g)).alias("mae_after"), F.sqrt(F.avg(e * e)).alias("rmse_before"), F.sqrt(F.avg(g * g)).alias("rmse_after"),
        F.count_if(raw < 0).alias("negative_before_floor"), F.count_if(after < 0).alias("negative_after_floor"),
    )
    mae, rmse = F.col("mae_after") < F.col("mae_before"), F.col("rmse_after") < F.col("rmse_before")
    better = {"none": F.lit(False), "mae": mae, "rmse": rmse, "both": mae & rmse}[kpi]
    few = F.col("n_samples") < least
    on = F.coalesce(better & ~few, F.lit(False))
    what = {"none": None, "mae": "mae", "rmse": "rmse", "both": "mae_and_rmse"}[kpi]
    reason = F.lit("disabled_by_config") if what is None else F.when(on, f"{what}_improved").otherwise("mae_or_rmse_not_improved" if kpi == "both" else f"{what}_not_improved")
    named = F.when(F.col("n_samples") == 0, "no_daytime_samples").when(few, "too_few_samples").otherwise(reason)
    return line.crossJoin(both).select(on.alias("enabled"), named.alias("reason"), F.lit(kpi).alias("kpi"), *line.columns, *both.columns)


def calibrated(pred: Column | str, slope: float = 1.0, intercept: float = 0.0, enabled: bool = False, floor: float = 0.0) -> Column:
    """A prediction with the line applied if it is enabled, never under the floor."""
    p = F.col(pred) if isinstance(pred, str) else pred
    return clip(slope * p + intercept if enabled else p, floor)


def naive_baseline(df: DataFrame, least: int = 10) -> DataFrame:
    """df (plant, energia, poa) with base_ghi = max(poa / 1000, 0) and base_pv = base_ghi times the ratio of the 99th percentiles
    of energy and base_ghi; 0 with `least` valid rows or fewer."""
    ghi = F.greatest(F.col("poa") / 1000.0, F.lit(0.0))
    good = F.col("energia").isNotNull() & F.col("poa").isNotNull() & (F.col("energia") > 0) & (ghi > 0)
    scale = df.groupBy("plant").agg(F.count_if(good).alias("n"), F.percentile(F.when(good, F.col("energia")), F.lit(0.99)).alias("e"), F.percentile(F.when(good, ghi), F.lit(0.99)).alias("g"))
    factor = scale.select("plant", F.when(F.col("n") > least, F.col("e") / F.nullif(F.col("g"), F.lit(0.0))).otherwise(0.0).alias("__factor"))
    return df.join(factor, "plant").withColumns({"base_ghi": F.coalesce(ghi, F.lit(0.0)), "base_pv": F.coalesce(ghi, F.lit(0.0)) * F.coalesce("__factor", F.lit(0.0))}).drop("__factor")


def losses(df: DataFrame, lam: float = 0.1, alpha: float = 0.25, gamma: float = 2.0, under: float = 2.0) -> DataFrame:
    """One row: l_ghi, l_pv, l_physics (energy against efficiency times irradiance), total, and l_peak, the energy loss with
    peaks weighted 1 + alpha * y**gamma and under-prediction `under` times."""
    sq = lambda c: c * c
    pv, y = F.col("pred_pv") - F.col("true_pv"), F.col("true_pv")
    weight = (1 + alpha * F.pow(F.greatest(y, F.lit(0.0)), gamma)) * F.when(pv < 0, under).otherwise(1.0)
    one = df.agg(F.avg(sq(F.col("pred_ghi") - F.col("true_ghi"))).alias("l_ghi"), F.avg(sq(pv)).alias("l_pv"), F.avg(sq(F.col("pred_pv") - F.col("eta") * F.col("pred_ghi"))).alias("l_physics"), F.avg(weight * sq(pv)).alias("l_peak"))
    return one.withColumn("total", F.col("l_ghi") + F.col("l_pv") + lam * F.col("l_physics"))


class Ablation:
    """Results of models, reported from the smallest energy error."""

    FIELDS = "model_name string, mae_ghi double, mae_pv double, rmse_ghi double, rmse_pv double, detection_rate double, extra map<string,string>"

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, model_name: str, mae_ghi: float, mae_pv: float, rmse_ghi: float, rmse_pv: float, detection_rate: float, **extra: str) -> None:
        self.rows.append((model_name, *map(float, (mae_ghi, mae_pv, rmse_ghi, rmse_pv, detection_rate)), {k: str(v) for k, v in extra.items()}))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, self.FIELDS).orderBy("mae_pv", "model_name")

    def report(self, spark) -> str:
        if not self.rows:
            return "no results"
        return "\n".join(f"{r.model_name:<20} pv {r.mae_pv:.4f} / {r.rmse_pv:.4f}  ghi {r.mae_ghi:.4f} / {r.rmse_ghi:.4f}" for r in self.table(spark).collect())
