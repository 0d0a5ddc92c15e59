"""Queries on forecasts: reports, calibration, intervals, continual learning and streams."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from sunfleet.operators import conformal, continual, evaluate, forecast
from sunfleet.plans.catalog import query
from sunfleet.plans.tables import CUBE, FORECASTS, cube, forecasts, rounded, table

MEASURES = "count(pred_pv - true_pv) AS n, round(avg(abs(pred_pv - true_pv)), 6) AS mae, round(sqrt(avg((pred_pv - true_pv) ** 2)), 6) AS rmse, round(avg(pred_pv - true_pv), 6) + 0.0::DOUBLE AS bias"


@query("error_measures", f"WITH {FORECASTS} SELECT plant, {MEASURES}, round(corr(pred_pv, true_pv), 5) AS r, count(*) FILTER (pred_pv < 0) AS negatives FROM forecasts WHERE true_ghi > 0.01 GROUP BY plant")
def error_measures(spark, d):
    m = evaluate.measured(forecasts(spark, d).where("true_ghi > 0.01"), "pred_pv", "true_pv", ["plant"])
    return rounded(m.withColumn("r", F.round("r", 5)))


@query("ghi_measures", f"WITH {FORECASTS} SELECT {MEASURES.replace('pv', 'ghi')} FROM forecasts WHERE true_ghi > 0.01")
def ghi_measures(spark, d):
    return rounded(evaluate.measured(forecasts(spark, d).where("true_ghi > 0.01"), "pred_ghi", "true_ghi", None, ["n", "mae", "rmse", "bias"]))


BINNED = f"""WITH {FORECASTS}, ok AS (SELECT * FROM forecasts WHERE qs IS NOT NULL), e AS (SELECT quantile_cont(qs, 0.05) AS a, quantile_cont(qs, 0.25) AS b, quantile_cont(qs, 0.75) AS c, quantile_cont(qs, 0.95) AS d FROM ok),
  bins AS (SELECT CASE WHEN qs < a THEN 'low' WHEN qs < b THEN 'mid-low' WHEN qs < c THEN 'mid' WHEN qs < d THEN 'mid-high' ELSE 'high' END AS bin, count(*) AS n, avg(qs) AS q_mean, avg(abs(pred_pv - true_pv)) AS mae, sqrt(avg((pred_pv - true_pv) ** 2)) AS rmse, avg(pred_pv - true_pv) AS bias, avg(true_pv) AS true_mean, avg(pred_pv) AS pred_mean FROM ok, e GROUP BY 1)"""
ROUND = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in ("q_mean", "mae", "rmse", "bias", "true_mean", "pred_mean"))


@query("quantile_bin_errors", f"{BINNED} SELECT bin, n, {ROUND}, round(n / sum(n) OVER () * 100, 6) AS share FROM bins")
def quantile_bin_errors(spark, d):
    return rounded(evaluate.by_quantile_bins(forecasts(spark, d)))


@query("bin_correlation", f"{BINNED} SELECT round(corr(q_mean, mae), 5) AS corr_qs_mae FROM bins")
def bin_correlation(spark, d):
    return rounded(evaluate.bin_correlation(evaluate.by_quantile_bins(forecasts(spark, d))), 5)


@query("fixed_bin_errors", f"WITH {FORECASTS} SELECT CASE WHEN qs < 0.3 THEN 'a' WHEN qs < 0.5 THEN 'b' WHEN qs < 0.7 THEN 'c' WHEN qs < 0.85 THEN 'd' ELSE 'e' END AS bin, {MEASURES} FROM forecasts WHERE qs IS NOT NULL GROUP BY 1")
def fixed_bin_errors(spark, d):
    return rounded(evaluate.by_bins(forecasts(spark, d), [0.3, 0.5, 0.7, 0.85], labels=tuple("abcde")).select("bin", "n", "mae", "rmse", "bias"))


READ = "r AS (SELECT ts AS time, value AS true_pv, value + (event_id * 17 % 41 - 20) / 10.0::DOUBLE AS pred_pv FROM events)"


@query("errors_by_month_and_hour", f"WITH {READ} SELECT month(time) AS month, hour(time) AS hour, {MEASURES} FROM r GROUP BY 1, 2")
def errors_by_month_and_hour(spark, d):
    """Events are readings with a time of day; their forecasts are off by something of their keys."""
    r = table(spark, d, "events").select(F.month("ts").alias("month"), F.hour("ts").alias("hour"), F.col("value").alias("true_pv"), (F.col("value") + (F.col("event_id") * 17 % 41 - 20) / 10.0).alias("pred_pv"))
    m = rounded(evaluate.measured(r, "pred_pv", "true_pv", ["month", "hour"], ["n", "mae", "rmse", "bias"]))
    return m.withColumns({c: F.col(c).cast("bigint") for c in ("month", "hour")})


@query("month_labels", "SELECT strftime(ts, '%b') AS name, strftime(ts, '%b %Y') AS label, count(*) AS n FROM events GROUP BY 1, 2")
def month_labels(spark, d):
    name, label = evaluate.month_labels("ts")
    return table(spark, d, "events").groupBy(name.alias("name"), label.alias("label")).agg(F.count("*").alias("n"))


@query("gathered_values", f"WITH {CUBE} SELECT o_orderkey, energia FROM (SELECT o_orderkey, (o_custkey % 120)::INT AS plant, (o_orderkey % 2600)::INT AS t_idx FROM orders) LEFT JOIN cube USING (plant, t_idx)")
def gathered_values(spark, d):
    wanted = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 120).cast("int").alias("plant"), (F.col("o_orderkey") % 2600).cast("int").alias("t_idx"))
    return evaluate.gather(cube(spark, d), wanted, "energia").select("o_orderkey", "energia")


@query("scalar_functions", "SELECT vec_id, round(ln(1 + exp(embedding[1]::DOUBLE)), 6) AS softplus, repeat('#', floor(abs(embedding[2]) * 50)::INT) AS bar, round(list_sum(list_transform(range(0, 5), lambda i: (i / 4.0::DOUBLE) * embedding[i + 1]::DOUBLE)), 5) AS ramp FROM embeddings")
def scalar_functions(spark, d):
    from sunfleet.functions.scalar import bar, linspace, softplus

    x = F.transform("embedding", lambda v: v.cast("double"))
    ramp = F.aggregate(F.zip_with(linspace(0, 1, 5), F.slice(x, 1, 5), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return table(spark, d, "embeddings").select("vec_id", F.round(softplus(F.get(x, F.lit(0))), 6).alias("softplus"), bar(F.abs(F.get("embedding", F.lit(1)))).alias("bar"), F.round(ramp, 5).alias("ramp"))


@query("padded_series", "SELECT vec_id, 80 AS n, round((SELECT avg(x) FROM unnest(embedding::DOUBLE[]) t(x)), 5) AS first, round(embedding[64]::DOUBLE, 5) AS last, round(list_sum(embedding[45:64]::DOUBLE[]), 4) AS newest FROM embeddings")
def padded_series(spark, d):
    from sunfleet.functions.scalar import pad_left

    x = F.transform("embedding", lambda v: v.cast("double"))
    long, short = pad_left(x, 80), pad_left(x, 20)
    newest = F.aggregate(short, F.lit(0.0), lambda a, v: a + v)
    return table(spark, d, "embeddings").select("vec_id", F.size(long).alias("n"), F.round(F.get(long, F.lit(0)), 5).alias("first"), F.round(F.get(long, F.lit(79)), 5).alias("last"), F.round(newest, 4).alias("newest"))


@query("strict_times", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%d/%m/%y %H:%M'), '%d/%m/%y %H:%M') AS time FROM orders")
def strict_times(spark, d):
    from sunfleet.sources.files import strict_time

    return table(spark, d, "orders").select("o_orderkey", strict_time(F.date_format("o_orderdate", "dd/MM/yy HH:mm")).cast("timestamp_ntz").alias("time"))


@query("joined_files", "SELECT n_nationkey, n_name, r_regionkey, r_name FROM (SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region)")
def joined_files(spark, d):
    from sunfleet.sources.files import read_weather

    return read_weather(spark, f"{d}/nation.parquet", f"{d}/region.parquet").select("n_nationkey", "n_name", "r_regionkey", "r_name")


@query("normalised_columns", "SELECT l_suppkey AS plant, count(*) AS n, round(sum(l_quantity::DOUBLE), 4) AS energia, round(avg(l_extendedprice::DOUBLE / 100), 4) AS poa, 3.0::DOUBLE AS wind FROM lineitem GROUP BY 1")
def normalised_columns(spark, d):
    from sunfleet.operators.features import normalised

    raw = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("plant"), F.col("l_quantity").cast("double").alias("ENERGIA"), (F.col("l_extendedprice").cast("double") / 100).alias("solar_irradiance_poa"))
    g = normalised(raw).groupBy("plant").agg(F.count("*").alias("n"), F.sum("energia").alias("energia"), F.avg("poa").alias("poa"), F.max("wind").alias("wind"))
    return rounded(g, 4)


@query("stratified_errors", f"WITH {FORECASTS}, s AS (SELECT *, (true_pv >= 0.2)::INT + (true_pv >= 0.4)::INT + (true_pv >= 0.6)::INT + (true_pv >= 0.8)::INT AS pv_bin, (qs >= 0.3)::INT + (qs >= 0.6)::INT + (qs >= 0.9)::INT AS qs_bin FROM forecasts WHERE qs IS NOT NULL) SELECT pv_bin, qs_bin, count(*) AS n, round(avg(abs(pred_pv - true_pv)), 6) AS mae, round(avg(pred_pv - true_pv), 6) AS bias FROM s WHERE pv_bin > 0 AND qs_bin < 3 GROUP BY 1, 2 HAVING count(*) >= 100")
def stratified_errors(spark, d):
    return rounded(evaluate.strata(forecasts(spark, d), [0.2, 0.4, 0.6, 0.8], [0.3, 0.6, 0.9]))


@query("score_summary", f"WITH {FORECASTS} SELECT count(qs) AS n, round(avg(qs), 6) AS mean, round(stddev_pop(qs), 6) AS std, " + ", ".join(f"round(quantile_cont(qs, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM forecasts")
def score_summary(spark, d):
    return rounded(evaluate.summary(forecasts(spark, d), "qs"))


@query("score_levels", f"WITH {FORECASTS} SELECT count(*) FILTER (qs > 0.7) AS good, count(*) FILTER (qs BETWEEN 0.5 AND 0.7) AS fair, count(*) FILTER (qs < 0.5) AS poor, count(*) FILTER (qs IS NULL) AS missing FROM forecasts")
def score_levels(spark, d):
    return evaluate.level_counts(forecasts(spark, d))


PLANT_MEANS = f"WITH {FORECASTS}, p AS (SELECT plant, round(avg(qs) FILTER (true_ghi > 0.05), 6) AS mean_qs, count(*) AS n FROM forecasts GROUP BY 1)"


def plant_means(spark, d):
    return rounded(forecasts(spark, d).groupBy("plant").agg(F.avg(F.when(F.col("true_ghi") > 0.05, F.col("qs"))).alias("mean_qs"), F.count("*").alias("n")))


@query("busiest_plants", f"{PLANT_MEANS} SELECT plant, n FROM p ORDER BY n DESC, plant LIMIT 20")
def busiest_plants(spark, d):
    return evaluate.top(plant_means(spark, d).select("plant", "n"), "n", 20)


@query("best_and_worst_plants", f"{PLANT_MEANS} (SELECT plant, mean_qs, 'top' AS side FROM p WHERE mean_qs IS NOT NULL ORDER BY mean_qs DESC, plant LIMIT 5) UNION ALL (SELECT plant, mean_qs, 'bottom' AS side FROM p WHERE mean_qs IS NOT NULL ORDER BY mean_qs, plant LIMIT 5)")
def best_and_worst_plants(spark, d):
    p = plant_means(spark, d).select("plant", "mean_qs")
    return evaluate.top(p, "mean_qs", 5).withColumn("side", F.lit("top")).unionByName(evaluate.top(p, "mean_qs", 5, lowest=True).withColumn("side", F.lit("bottom")))


@query("plant_order", f"{PLANT_MEANS} SELECT plant, round(coalesce(mean_qs, -1), 6) AS mean_qs FROM p")
def plant_order(spark, d):
    return plant_means(spark, d).select("plant", F.coalesce("mean_qs", F.lit(-1.0)).alias("mean_qs")).orderBy(F.desc("mean_qs"), "plant")


@query("month_coverage", "SELECT date_trunc('month', ts)::DATE AS month, count(*) AS rows, round(count(*) / (day(last_day(date_trunc('month', ts)::DATE)) * 24) * 100, 6) AS coverage FROM events GROUP BY 1")
def month_coverage(spark, d):
    return rounded(evaluate.months(table(spark, d, "events"), "ts"))


@query("daily_fleet", "SELECT date_trunc('day', hour)::DATE AS day, round(avg(m), 6) AS fleet, count(*) AS hours FROM (SELECT date_trunc('hour', ts) AS hour, avg(value) AS m FROM events GROUP BY 1) GROUP BY 1")
def daily_fleet(spark, d):
    by_hour = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("m"))
    return rounded(by_hour.groupBy(F.col("hour").cast("date").alias("day")).agg(F.avg("m").alias("fleet"), F.count("*").alias("hours")))


@query("event_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share FROM events GROUP BY 1")
def event_counts(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100))


HISTORY = "h AS (SELECT l_linenumber + 7 * (l_suppkey % 5) AS epoch, avg(l_discount::DOUBLE) + 1.0::DOUBLE / (1 + l_linenumber + 7 * (l_suppkey % 5)) AS val_loss FROM lineitem GROUP BY 1, l_linenumber, l_suppkey % 5)"


def history(spark, d):
    e = (F.col("l_linenumber") + 7 * (F.col("l_suppkey") % 5)).cast("bigint")
    return table(spark, d, "lineitem").select(e.alias("epoch"), F.col("l_discount").cast("double").alias("x")).groupBy("epoch").agg((F.avg("x") + 1.0 / (1 + F.col("epoch"))).alias("val_loss"))


@query("loss_curve", f"WITH {HISTORY} SELECT epoch::BIGINT AS epoch, round(val_loss, 8) AS val_loss, round((lag(val_loss) OVER (ORDER BY epoch) - val_loss) / lag(val_loss) OVER (ORDER BY epoch) * 100, 5) AS change_pct FROM h")
def loss_curve(spark, d):
    before = F.lag("val_loss").over(Window.orderBy("epoch"))  # a row for each epoch
    return history(spark, d).select("epoch", F.round("val_loss", 8).alias("val_loss"), F.round((before - F.col("val_loss")) / before * 100, 5).alias("change_pct"))


@query("best_epoch", f"WITH {HISTORY} SELECT arg_min(epoch, val_loss)::BIGINT AS epoch, round(min(val_loss), 8) AS val_loss FROM h")
def best_epoch(spark, d):
    return history(spark, d).agg(F.min_by("epoch", "val_loss").alias("epoch"), F.round(F.min("val_loss"), 8).alias("val_loss"))


@query("early_stopping", f"WITH {HISTORY}, b AS (SELECT epoch::BIGINT AS epoch, val_loss, min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM h), i AS (SELECT *, coalesce(val_loss < best - 0.0001::DOUBLE, true) AS improved FROM b), w AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch) AS waited FROM i) SELECT epoch, improved, waited, waited >= 3 AS stop FROM w")
def early_stopping(spark, d):
    return forecast.early_stop(history(spark, d), 3, 0.0001).select("epoch", "improved", "waited", "stop")


@query("amplitude_ratio", f"WITH {FORECASTS} SELECT plant, round(max(pred_pv) / nullif(max(true_pv), 0), 6) AS ratio FROM forecasts GROUP BY plant")
def amplitude_ratio(spark, d):
    return rounded(forecasts(spark, d).groupBy("plant").agg((F.max("pred_pv") / F.nullif(F.max("true_pv"), F.lit(0.0))).alias("ratio")))


CALIBRATION = f"""WITH {FORECASTS}, y AS (SELECT pred_pv AS p, true_pv AS t FROM forecasts WHERE true_ghi > 0.01), l AS (SELECT count(*) AS n, regr_slope(t, p) AS s, regr_intercept(t, p) AS i FROM y),
  m AS (SELECT n, s, i, avg(abs(p - t)) AS a, avg(abs(greatest(s * p + i, 0) - t)) AS b, sqrt(avg((p - t) ** 2)) AS c, sqrt(avg((greatest(s * p + i, 0) - t) ** 2)) AS e, count(*) FILTER (s * p + i < 0) AS neg FROM y, l GROUP BY n, s, i)"""


def calibration_sql(kpi: str) -> str:
    better = {"rmse": "e < c", "mae": "b < a", "both": "b < a AND e < c", "none": "false"}[kpi]
    yes, no = {"rmse": ("rmse_improved", "rmse_not_improved"), "mae": ("mae_improved", "mae_not_improved"), "both": ("mae_and_rmse_improved", "mae_or_rmse_not_improved"), "none": ("", "disabled_by_config")}[kpi]
    return f"{CALIBRATION} SELECT {better} AS enabled, CASE WHEN {better} THEN '{yes}' ELSE '{no}' END AS reason, '{kpi}' AS kpi, n AS n_samples, round(s, 5) AS slope, round(i, 5) AS intercept, round(a, 6) AS mae_before, round(b, 6) AS mae_after, round(c, 6) AS rmse_before, round(e, 6) AS rmse_after, neg AS negative_before_floor, 0::BIGINT AS negative_after_floor FROM m"


def _calibration(kpi):
    def run(spark, d):
        c = rounded(evaluate.calibrate(forecasts(spark, d), kpi))
        return c.withColumns({"slope": F.round("slope", 5), "intercept": F.round("intercept", 5)})

    return run


for _kpi in evaluate.KPIS:
    query(f"calibration_{_kpi}", calibration_sql(_kpi))(_calibration(_kpi))


@query("calibrated_forecasts", f"WITH {FORECASTS} SELECT plant, round(avg(greatest(0.97::DOUBLE * pred_pv - 0.05::DOUBLE, 0)), 6) AS applied, round(avg(greatest(pred_pv, 0)), 6) AS floored FROM forecasts GROUP BY plant")
def calibrated_forecasts(spark, d):
    f = forecasts(spark, d)
    return rounded(f.groupBy("plant").agg(F.avg(evaluate.calibrated("pred_pv", 0.97, -0.05, True)).alias("applied"), F.avg(evaluate.calibrated("pred_pv")).alias("floored")))


@query("naive_baseline", f"WITH {CUBE}, g AS (SELECT plant, energia, poa, greatest(poa / 1000.0::DOUBLE, 0) AS ghi FROM cube), s AS (SELECT plant, CASE WHEN count(*) FILTER (energia > 0 AND ghi > 0) > 10 THEN quantile_cont(energia, 0.99) FILTER (energia > 0 AND ghi > 0) / quantile_cont(ghi, 0.99) FILTER (energia > 0 AND ghi > 0) ELSE 0 END AS k FROM g GROUP BY 1) SELECT plant, count(energia) AS n, round(avg(abs(ghi * k - energia)), 5) AS mae, round(sqrt(avg((ghi * k - energia) ** 2)), 5) AS rmse FROM g JOIN s USING (plant) GROUP BY plant")
def naive_baseline(spark, d):
    b = evaluate.naive_baseline(cube(spark, d))
    return rounded(evaluate.measured(b, "base_pv", "energia", ["plant"], ["n", "mae", "rmse"]), 5)


@query("losses", f"WITH {FORECASTS} SELECT round(avg((pred_ghi - true_ghi) ** 2), 6) AS l_ghi, round(avg((pred_pv - true_pv) ** 2), 6) AS l_pv, round(avg((pred_pv - eta * pred_ghi) ** 2), 6) AS l_physics, round(avg((1 + 0.25 * greatest(true_pv, 0) ** 2) * CASE WHEN pred_pv < true_pv THEN 2 ELSE 1 END * (pred_pv - true_pv) ** 2), 6) AS l_peak, round(avg((pred_ghi - true_ghi) ** 2) + avg((pred_pv - true_pv) ** 2) + 0.1 * avg((pred_pv - eta * pred_ghi) ** 2), 6) AS total FROM forecasts")
def losses(spark, d):
    return rounded(evaluate.losses(forecasts(spark, d)))


@query("ablation", f"WITH {FORECASTS} SELECT 'plant' || plant % 7 AS model_name, round(avg(abs(pred_pv - true_pv)), 6) AS mae_pv, round(avg(abs(pred_ghi - true_ghi)), 6) AS mae_ghi FROM forecasts GROUP BY 1")
def ablation(spark, d):
    f = forecasts(spark, d).withColumn("model_name", F.concat(F.lit("plant"), F.col("plant") % 7))
    return rounded(f.groupBy("model_name").agg(F.avg(F.abs(F.col("pred_pv") - F.col("true_pv"))).alias("mae_pv"), F.avg(F.abs(F.col("pred_ghi") - F.col("true_ghi"))).alias("mae_ghi"))).orderBy("mae_pv", "model_name")


BANDS = f"""WITH {FORECASTS}, b AS (SELECT *, abs(true_pv - pred_pv) AS score, (qs >= 0.3333333336666667::DOUBLE)::INT + (qs >= 0.6666666673333334::DOUBLE)::INT AS band FROM forecasts WHERE qs IS NOT NULL),
  k AS (SELECT band, score, row_number() OVER (PARTITION BY band ORDER BY score) - 1 AS k, count(*) OVER (PARTITION BY band) AS n FROM b),
  w AS (SELECT band, n, least(0.9::DOUBLE * (n + 1) / n, 1.0) * (n - 1) AS place, score, k FROM k), q AS (SELECT band, n AS n_cal, sum(greatest(0, 1 - abs(k - place)) * score) / sum(greatest(0, 1 - abs(k - place))) AS quantile FROM w GROUP BY 1, 2)"""


@query("conformal_bands", f"{BANDS} SELECT band, n_cal, round(quantile, 6) AS quantile, round(band / 3.0::DOUBLE, 6) AS qs_lo, round((band + 1) / 3.0::DOUBLE, 6) AS qs_hi FROM q")
def conformal_bands(spark, d):
    return rounded(conformal.BandedConformal(3, 0.9).calibrate(forecasts(spark, d)).coverage_report())


@query("conformal_coverage", f"{BANDS} SELECT band, count(*) AS n, round(avg((true_pv BETWEEN pred_pv - quantile - 1e-9 AND pred_pv + quantile + 1e-9)::INT), 3) AS covered, round(avg(2 * quantile), 6) AS width FROM b JOIN q USING (band) GROUP BY band")
def conformal_coverage(spark, d):
    f = forecasts(spark, d)
    out = conformal.BandedConformal(3, 0.9).calibrate(f).predict_interval(f.where("qs IS NOT NULL"))
    inside = F.col("true_pv").between(F.col("lower") - 1e-9, F.col("upper") + 1e-9).cast("int")
    return out.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg(inside), 3).alias("covered"), F.round(F.avg(F.col("upper") - F.col("lower")), 6).alias("width"))


@query("score_intervals", f"""WITH {FORECASTS}, s AS (SELECT qs AS t, least(1.0, greatest(0.0, qs + (plant % 9 - 4) / 100.0::DOUBLE)) AS p FROM forecasts WHERE qs IS NOT NULL), e AS (SELECT quantile_cont(t, 1.0 / 3) AS a, quantile_cont(t, 2.0 / 3) AS b FROM s),
  r AS (SELECT (t >= a)::INT + (t >= b)::INT AS bin, abs(t - p) AS score FROM s, e), k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY score) AS k, count(*) OVER (PARTITION BY bin) AS n FROM r)
  SELECT bin, n, round(2 * score, 6) AS width FROM k WHERE k = least(ceil((n + 1) * (1 - 0.1::DOUBLE)), n)""")
def score_intervals(spark, d):
    f = forecasts(spark, d).where("qs IS NOT NULL").select(F.col("qs").alias("true"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("qs") + (F.col("plant") % 9 - 4) / 100.0)).alias("pred"))
    c = conformal.ScoreConformal().fit(f)
    return rounded(c.widths.select("bin", "n", (2 * F.col("half_width")).alias("width")))


@query("replay_slots", "WITH s AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, o_totalprice::DOUBLE AS y FROM orders) SELECT seq % 1000 AS slot, max(seq) AS seq, arg_max(y, seq) AS y FROM s GROUP BY 1")
def replay_slots(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("y"))
    return continual.replay_buffer(numbered(o, "o_orderkey", "seq")).select("slot", "seq", "y")


def numbered(df, key, name):
    """df with ranks from 0 by a unique key: counts of range buckets are summed up first, then rows are numbered in each."""
    span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    placed = df.crossJoin(F.broadcast(span)).withColumn("__b", F.floor((F.col(key) - F.col("lo")) * 256 / (F.col("hi") - F.col("lo") + 1))).drop("lo", "hi")
    sizes = placed.groupBy("__b").agg(F.count("*").alias("__n"))
    starts = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__s"))  # at most 256 rows
    return placed.join(F.broadcast(starts), "__b").withColumn(name, F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1 + F.col("__s")).drop("__b", "__s")


@query("quality_gate", f"WITH {FORECASTS}, g AS (SELECT plant, avg(qs) FILTER (qs > 0) AS m FROM forecasts GROUP BY 1) SELECT plant, round(m, 6) AS qs_mean, coalesce(m > 0.5, false) AS updated FROM g")
def quality_gate(spark, d):
    g = forecasts(spark, d).groupBy("plant").agg(F.avg(F.when(F.col("qs") > 0, F.col("qs"))).alias("qs_mean"))
    return rounded(continual.gate(g, 0.5))


@query("replay_losses", f"WITH {FORECASTS}, r AS (SELECT plant % 3 = 0 AS replayed, pred_pv AS p, pred_ghi AS o, true_pv AS y FROM forecasts), m AS (SELECT count(*) FILTER (replayed) AS n_replayed, avg((p - y) ** 2) FILTER (NOT replayed) AS task, avg((p - o) ** 2) FILTER (replayed) AS mse_old, avg((p - y) ** 2) FILTER (replayed) AS mse_y FROM r) SELECT n_replayed, round(task, 6) AS task, round(mse_old, 6) AS mse_old, round(mse_y, 6) AS mse_y, round(task + CASE WHEN n_replayed >= 32 THEN 0.2 * mse_old + mse_y ELSE 0 END, 6) AS loss FROM m")
def replay_losses(spark, d):
    f = forecasts(spark, d).select((F.col("plant") % 3 == 0).alias("replayed"), F.col("pred_pv").alias("pred"), F.col("pred_ghi").alias("old_pred"), F.col("true_pv").alias("y"))
    return rounded(continual.replay_loss(f))


def last_time(spark, d):
    """The largest index of the grid, which all plants have; -1 without a row."""
    from sunfleet.plans.quality import scored

    last = scored(spark, d).agg(F.max("t_idx")).first()[0]
    return -1 if last is None else last


@query("lag_regression")
def lag_regression(spark, d):
    """A distributed regression on lag windows stands for the trained forecaster; its errors by plant."""
    from sunfleet.operators import features
    from sunfleet.plans.quality import feature_cube

    rows, last = features.feature_rows(feature_cube(spark, d)), last_time(spark, d)
    scored = forecast.LagRegression(features.CHANNELS).fit(rows, last).transform(rows, last)
    return evaluate.measured(scored, "pred", "y_pv", ["plant"], ["n", "mae", "rmse", "bias"])


@query("graph_forecast")
def graph_forecast(spark, d):
    """The graph network's forecasts for all times of a fleet; its heads are trained on a bounded sample of four fifths of the
    times, and stop by the rest."""
    from sunfleet.operators import features, graph
    from sunfleet.plans.quality import feature_cube
    from sunfleet.plans.tables import kept, plants

    model, edges = forecast.Forecaster(), kept(spark, d, "edges", lambda: graph.distance_graph(plants(spark, d), 10.0))

    def encoded():
        made = model.encoded(features.feature_rows(feature_cube(spark, d)), last_time(spark, d), features.CHANNELS)
        return made.persist(StorageLevel.DISK_ONLY)  # 256 bytes a row at least

    samples = kept(spark, d, "encoded", encoded)  # heads are trained on it, and forecast from it
    model.train(samples.where("t_idx % 5 < 4"), samples.where("t_idx % 5 = 4"), edges)
    return model.score(samples, edges)


@query("hourly_medians", "SELECT user_id AS plant, date_trunc('hour', ts) AS time, median(value) AS value, count(value) AS n FROM events GROUP BY 1, 2")
def hourly_medians(spark, d):
    from sunfleet.streaming.monitor import hourly_medians as medians

    e = table(spark, d, "events").select(F.col("user_id").alias("plant"), "ts", "value")
    return medians(e).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("outage_sessions", "WITH g AS (SELECT user_id AS plant, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY plant ORDER BY ts) AS k FROM g) SELECT plant, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY plant, k")
def outage_sessions(spark, d):
    from sunfleet.streaming.monitor import sessions

    e = table(spark, d, "events").select(F.col("user_id").alias("plant"), "ts", "value")
    return sessions(e).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("weekly_sliding_means", "WITH e AS (SELECT user_id AS plant, ts, value FROM events), w AS (SELECT plant, value, unnest([time_bucket(INTERVAL 1 DAY, ts) - to_days(i::INT) FOR i IN range(7)]) AS start FROM e) SELECT plant, start, round(avg(value), 6) AS value, count(value) AS n FROM w GROUP BY 1, 2")
def weekly_sliding_means(spark, d):
    from sunfleet.streaming.monitor import sliding_means

    e = table(spark, d, "events").select(F.col("user_id").alias("plant"), "ts", "value")
    return rounded(sliding_means(e, "plant", "ts", "value", "7 days", "1 day").select("plant", F.col("start").cast("timestamp_ntz").alias("start"), "value", "n"))


@query("event_properties", "SELECT (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def event_properties(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))
