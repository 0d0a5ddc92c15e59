"""Queries on alignment, quality scores and fleet diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunfleet.functions.scalar import bucket, clip, haversine_km, week_ending
from sunfleet.functions.solar import clear_sky_kw, elevation_sine
from sunfleet.operators import align, continual, diagnose, features, graph, learn, quality
from sunfleet.plans.catalog import query
from sunfleet.plans.tables import CUBE, LEAST, PLANTS, QUALITY, SCALES, SITES, WINDOW, cube, kept, plants, readings, rounded, sites, table


def scored(spark, d):
    return kept(spark, d, "scores", lambda: quality.quality(cube(spark, d), WINDOW, LEAST))


def counted(spark, d):
    return quality.valid_count(scored(spark, d), WINDOW)


COUNTED = QUALITY + f", counted AS (SELECT *, (count(*) FILTER (energia > 0) OVER (PARTITION BY plant ORDER BY t_idx ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW))::BIGINT AS valid_count FROM quality)"


@query("fleet_quality_monthly", f"WITH {QUALITY} SELECT date_trunc('month', time)::DATE AS month, round(avg(f), 6) AS fleet_qs, count(*) AS n FROM (SELECT time, avg(qs) AS f FROM quality WHERE poa > 50 GROUP BY time HAVING avg(qs) IS NOT NULL) GROUP BY 1")
def fleet_quality_monthly(spark, d):
    """The flagship: daytime fleet means by month, means of the times' means."""
    by_time = scored(spark, d).where("poa > 50").groupBy("time").agg(F.avg("qs").alias("f")).where("f IS NOT NULL")
    return rounded(by_time.groupBy(F.date_trunc("month", "time").cast("date").alias("month")).agg(F.avg("f").alias("fleet_qs"), F.count("*").alias("n")))


@query("median_readings", "SELECT user_id::INT AS plant, date_trunc('hour', ts) AS hour, median(value) AS energia, count(value) AS n FROM events GROUP BY 1, 2")
def median_readings(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("int").alias("plant"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value")
    return rows.groupBy("plant", "hour").agg(F.median("value").alias("energia"), F.count("value").alias("n"))


@query("densified_grid", f"WITH {CUBE} SELECT plant, count(*) AS cells, count(energia) AS filled, min(t_idx) AS first_t, max(t_idx) AS last_t, round(sum(t_idx * coalesce(energia, 0)), 4) AS moment FROM cube GROUP BY plant")
def densified_grid(spark, d):
    c = cube(spark, d)
    return c.groupBy("plant").agg(F.count("*").alias("cells"), F.count("energia").alias("filled"), F.min("t_idx").alias("first_t"), F.max("t_idx").alias("last_t"), F.round(F.sum(F.col("t_idx") * F.coalesce("energia", F.lit(0.0))), 4).alias("moment"))


@query("dataset_metadata", f"WITH {CUBE} SELECT 'lineitem' AS source, count(DISTINCT plant) AS n_plants, count(*) AS n_rows, min(time) AS period_start, max(time) AS period_end FROM cube")
def dataset_metadata(spark, d):
    from sunfleet.sources.files import metadata

    return metadata(cube(spark, d), "lineitem")


@query("day_masks", f"WITH {CUBE} SELECT plant, count(*) FILTER (poa / 1000.0::DOUBLE > 0.05) AS day, count(*) FILTER (poa / 1000.0::DOUBLE < 1e-6) AS dark, count(*) FILTER (poa > 50) AS report_day, count(*) FILTER (poa / 1000.0::DOUBLE > 0.03) AS lit, round(max(greatest(poa / 1000.0::DOUBLE, 0)), 6) AS peak_kw FROM cube GROUP BY plant")
def day_masks(spark, d):
    kw = F.col("poa") / 1000.0
    return rounded(cube(spark, d).groupBy("plant").agg(F.count_if(kw > quality.DAY_KW).alias("day"), F.count_if(kw < 1e-6).alias("dark"), F.count_if(F.col("poa") > 50).alias("report_day"), F.count_if(kw > 0.03).alias("lit"), F.max(clip(kw, 0.0)).alias("peak_kw")))


@query("plant_scales", f"WITH {SCALES} SELECT plant, round(capacity_scale, 6) AS capacity_scale, round(eta_base, 6) AS eta_base, round(day_peak, 6) AS day_peak FROM scales")
def plant_scales(spark, d):
    return rounded(quality.plant_scales(cube(spark, d)))


@query("temperature_efficiency", f"WITH {SCALES} SELECT c.plant, round(avg(least(2.0, greatest(0.1, eta_base)) * (1 - 0.004 * (temp - 25))), 6) AS eta_t FROM cube c JOIN scales USING (plant) GROUP BY 1")
def temperature_efficiency(spark, d):
    c = cube(spark, d)
    eta = F.col("eta_base") * (1 - quality.GAMMA * (F.col("temp") - 25))
    return rounded(c.join(quality.plant_scales(c), "plant").groupBy("plant").agg(F.avg(eta).alias("eta_t")))


@query(
    "quality_components",
    f"WITH {QUALITY} SELECT plant, " + ", ".join(f"round(avg(m{i}), 5) AS m{i}, count(m{i}) AS n{i}" for i in range(1, 6)) + ", round(avg(qs), 5) AS qs, count(qs) AS n FROM quality GROUP BY plant",
)
def quality_components(spark, d):
    aggs = [a for i in range(1, 6) for a in (F.avg(f"m{i}").alias(f"m{i}"), F.count(f"m{i}").alias(f"n{i}"))]
    return rounded(scored(spark, d).groupBy("plant").agg(*aggs, F.avg("qs").alias("qs"), F.count("qs").alias("n")), 5)


@query("quality_scores", f"WITH {QUALITY} SELECT plant, t_idx, round(qs, 4) AS qs FROM quality WHERE qs IS NOT NULL AND poa > 0")
def quality_scores(spark, d):
    return rounded(scored(spark, d).where("qs IS NOT NULL AND poa > 0").select("plant", "t_idx", "qs"), 4)


@query("night_rule", f"WITH {QUALITY} SELECT plant, count(*) FILTER (qs = 1) AS quiet, count(*) FILTER (qs = 0) AS spurious, count(*) FILTER (qs IS NULL) AS unknown FROM quality WHERE poa <= 50 GROUP BY plant")
def night_rule(spark, d):
    return scored(spark, d).where("poa <= 50").groupBy("plant").agg(F.count_if(F.col("qs") == 1).alias("quiet"), F.count_if(F.col("qs") == 0).alias("spurious"), F.count_if(F.col("qs").isNull()).alias("unknown"))


@query("valid_counts", f"WITH {COUNTED} SELECT plant, max(valid_count) AS most, round(avg(valid_count), 6) AS mean, sum(valid_count)::BIGINT AS total FROM counted GROUP BY plant")
def valid_counts(spark, d):
    return rounded(counted(spark, d).groupBy("plant").agg(F.max("valid_count").alias("most"), F.avg("valid_count").alias("mean"), F.sum("valid_count").alias("total")))


DAY_COUNTED = COUNTED + ", dc AS (SELECT valid_count, qs FROM counted WHERE poa / 1000.0::DOUBLE > 0.05 AND qs IS NOT NULL), top AS (SELECT quantile_cont(valid_count, 0.99) AS top, quantile_cont(valid_count, 0.9) AS p90, count(*) AS n FROM dc)"


@query("reliability_bins", f"WITH {DAY_COUNTED}, b AS (SELECT floor(valid_count / (top / 24))::INT AS bin, top, count(*) AS n, stddev_pop(qs) AS std FROM dc, top WHERE top > 0 GROUP BY 1, 2) SELECT bin, round((bin + 0.5) * top / 24, 5) AS centre, n, round(std, 5) AS std, round(1 - std / max(std) OVER (), 5) AS reliability FROM b WHERE bin BETWEEN 0 AND 23 AND n >= 200")
def reliability_bins(spark, d):
    return rounded(quality.reliability_bins(counted(spark, d)), 5)


@query("score_prior", f"WITH {DAY_COUNTED} SELECT round(p90, 6) AS threshold, count(*) AS n, round(CASE WHEN n_day >= 100 AND count(*) >= 100 THEN median(qs) ELSE 0.5 END, 5) AS prior FROM (SELECT p90, n AS n_day, qs FROM dc, top WHERE valid_count >= p90 AND qs > 0 AND qs < 1) GROUP BY p90, n_day")
def score_prior(spark, d):
    p = quality.prior(counted(spark, d))
    return p.select(F.round("threshold", 6).alias("threshold"), "n", F.round("prior", 5).alias("prior"))


SHRINK = "1 / (1 + exp(-(valid_count - 30.0::DOUBLE) / 8.0::DOUBLE))"


@query("shrunk_scores", f"WITH {COUNTED}, s AS (SELECT plant, valid_count, coalesce(qs, 0.6::DOUBLE) AS q, {SHRINK} AS c FROM counted) SELECT plant, round(avg(c), 5) AS confidence, round(avg(CASE WHEN q >= 0.6 THEN q ELSE c * q + (1 - c) * 0.6::DOUBLE END), 5) AS shrunk, count(*) AS n FROM s GROUP BY plant")
def shrunk_scores(spark, d):
    s = quality.shrink(counted(spark, d), 30, 8, 0.6)
    return rounded(s.groupBy("plant").agg(F.avg("confidence").alias("confidence"), F.avg("shrunk").alias("shrunk"), F.count("*").alias("n")), 5)


@query("shrunk_scores_symmetric", f"WITH {COUNTED}, s AS (SELECT plant, coalesce(qs, 0.6::DOUBLE) AS q, {SHRINK} AS c FROM counted) SELECT plant, round(avg(c * q + (1 - c) * 0.6::DOUBLE), 5) AS shrunk FROM s GROUP BY plant")
def shrunk_scores_symmetric(spark, d):
    return rounded(quality.shrink(counted(spark, d), 30, 8, 0.6, False).groupBy("plant").agg(F.avg("shrunk").alias("shrunk")), 5)


@query("shrunk_scores_fitted")
def shrunk_scores_fitted(spark, d):
    """With the sigmoid fitted to the reliability bins and the prior from the data."""
    c = counted(spark, d)
    n0, scale = quality.fit_confidence(c)
    centre = quality.prior(c).select("prior").first()
    return quality.shrink(c, n0, scale, centre[0] if centre else 0.5).groupBy("plant").agg(F.avg("shrunk").alias("shrunk"), F.avg("confidence").alias("confidence"))


@query("temporal_scores", f"WITH {QUALITY}, t AS (SELECT plant, CASE WHEN count(qs) OVER w >= 20 THEN avg(qs) OVER w END AS v FROM quality WINDOW w AS (PARTITION BY plant ORDER BY t_idx ROWS BETWEEN 120 PRECEDING AND 119 FOLLOWING)) SELECT plant, round(avg(v), 5) AS temporal_qs, count(v) AS n FROM t GROUP BY plant")
def temporal_scores(spark, d):
    return rounded(quality.temporal(scored(spark, d), 240, 20).groupBy("plant").agg(F.avg("temporal_qs").alias("temporal_qs"), F.count("temporal_qs").alias("n")), 5)


@query("score_slopes", f"WITH {QUALITY} SELECT plant, round(CASE WHEN count(qs) >= 10 THEN regr_slope(qs, t_idx) ELSE 0.0 END, 8) AS slope FROM quality GROUP BY plant")
def score_slopes(spark, d):
    return rounded(quality.slopes(scored(spark, d)), 8)


@query("spatial_z", f"WITH {QUALITY}, f AS (SELECT t_idx, avg(qs) AS m, stddev_pop(qs) AS s FROM quality GROUP BY 1) SELECT plant, round(avg((qs - m) / (s + 1e-6)), 4) AS z_mean, count(qs) AS n FROM quality JOIN f USING (t_idx) GROUP BY plant")
def spatial_z(spark, d):
    return rounded(quality.spatial_z(scored(spark, d)).groupBy("plant").agg(F.avg("z").alias("z_mean"), F.count("z").alias("n")), 4)


@query("fleet_mean", f"WITH {QUALITY} SELECT t_idx, round(avg(qs), 5) AS fleet_qs FROM quality GROUP BY t_idx")
def fleet_mean(spark, d):
    return rounded(quality.fleet_mean(scored(spark, d)).select("t_idx", "fleet_qs"), 5)


@query("isolated_faults", f"WITH {QUALITY}, f AS (SELECT t_idx, avg(qs) AS m, stddev_pop(qs) AS s FROM quality GROUP BY 1) SELECT plant, count(*) AS n FROM quality JOIN f USING (t_idx) WHERE (qs - m) / (s + 1e-6) < -1 GROUP BY plant")
def isolated_faults(spark, d):
    return quality.spatial_z(scored(spark, d)).where("z < -1").groupBy("plant").agg(F.count("*").alias("n"))


COMPACT = QUALITY + ", compact AS (SELECT plant, (row_number() OVER (PARTITION BY plant ORDER BY t_idx) - 1)::INT AS k, qs AS v FROM quality WHERE qs IS NOT NULL)"
AUTO = "SELECT plant, count(*) AS n, CASE WHEN count(*) > 60 THEN CASE WHEN min(CASE WHEN w IS NOT NULL THEN v END) < max(CASE WHEN w IS NOT NULL THEN v END) AND min(w) < max(w) THEN corr(v, w) END ELSE 0.0 END AS autocorr FROM (SELECT plant, v, lag(v, 60) OVER (PARTITION BY plant ORDER BY k) AS w FROM compact) GROUP BY plant"


@query("autocorrelation", f"WITH {COMPACT} SELECT plant, round(autocorr, 4) AS autocorr FROM ({AUTO})")
def autocorrelation(spark, d):
    return rounded(quality.autocorrelation(quality.compacted(scored(spark, d)), 60), 4)


@query("rolling_deviation", f"WITH {COMPACT}, s AS (SELECT plant, CASE WHEN count(*) OVER w >= 20 THEN stddev_samp(v) OVER w END AS s FROM compact WINDOW w AS (PARTITION BY plant ORDER BY k ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) SELECT plant, round(avg(s), 5) AS rolling_std FROM s GROUP BY plant")
def rolling_deviation(spark, d):
    return rounded(quality.rolling_std_mean(quality.compacted(scored(spark, d)), 120, 20), 5)


@query(
    "fault_scenarios",
    f"""WITH {COMPACT}, f AS (SELECT t_idx, avg(qs) AS m, stddev_pop(qs) AS s FROM quality GROUP BY 1), z AS (SELECT plant, t_idx, (qs - m) / (s + 1e-6) AS z FROM quality JOIN f USING (t_idx)),
    a AS (SELECT avg(z) FILTER (plant = 2 AND t_idx BETWEEN 800 AND 1199) AS z_pre, avg(z) FILTER (plant = 2 AND t_idx BETWEEN 1200 AND 1599) AS z_post, stddev_pop(z) FILTER (plant BETWEEN 3 AND 6 AND t_idx BETWEEN 1700 AND 1899) AS z_spread FROM z),
    b AS (SELECT avg(m) FILTER (t_idx BETWEEN 1500 AND 1699) AS fleet_pre, avg(m) FILTER (t_idx BETWEEN 1700 AND 1899) AS fleet_evt FROM f),
    c AS (SELECT CASE WHEN count(qs) >= 10 THEN regr_slope(qs, t_idx) ELSE 0 END AS slope FROM quality WHERE plant = 1),
    e AS (SELECT CASE WHEN count(*) > 160 THEN corr(v, w) ELSE 0 END AS autocorr FROM (SELECT v, lag(v, 60) OVER (ORDER BY k) AS w FROM compact WHERE plant = 7)),
    g AS (SELECT avg(s) AS rolling_std FROM (SELECT CASE WHEN count(*) OVER w >= 20 THEN stddev_samp(v) OVER w END AS s FROM compact WHERE plant = 7 WINDOW w AS (ORDER BY k ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)))
    SELECT round(slope, 8) AS slope, slope < -1e-7 AS degrading, round(z_pre, 4) AS z_pre, round(z_post, 4) AS z_post, coalesce(z_post < -1, false) AS failing, round(fleet_pre, 5) AS fleet_pre, round(fleet_evt, 5) AS fleet_evt, round(z_spread, 4) AS z_spread,
      coalesce(fleet_evt < 0.88 * fleet_pre AND z_spread < 0.3, false) AS cloud, round(autocorr, 4) AS autocorr, round(rolling_std, 5) AS rolling_std, coalesce(autocorr > 0.25, false) OR coalesce(rolling_std > 0.02, false) AS soiling FROM a, b, c, e, g""",
)
def fault_scenarios(spark, d):
    roles = {"degrading": 1, "failing": 2, "cloud_from": 3, "cloud_to": 6, "soiling": 7}
    spans = {"fail_pre": (800, 1200), "fail_post": (1200, 1600), "cloud_pre": (1500, 1700), "cloud_evt": (1700, 1900)}
    s = quality.scenarios(scored(spark, d), roles, spans, 60, 120, 20)
    digits = {"slope": 8, "z_pre": 4, "z_post": 4, "z_spread": 4, "autocorr": 4, "fleet_pre": 5, "fleet_evt": 5, "rolling_std": 5}
    return s.withColumns({k: F.round(k, v) for k, v in digits.items()})


CAUSES = f"""{COMPACT}, n AS (SELECT *, count(*) OVER (PARTITION BY plant) AS n FROM compact),
  e AS (SELECT plant, max(n) AS n_valid, avg(v) FILTER (k < 50) AS head, avg(v) FILTER (k >= n - 50) AS tail, CASE WHEN count(*) > 1 THEN regr_slope(v, k) END AS slope FROM n GROUP BY 1), a AS ({AUTO}),
  j AS (SELECT p.plant, coalesce(n_valid, 0) AS n_valid, head, tail, slope, autocorr FROM (SELECT DISTINCT plant FROM quality) p LEFT JOIN e USING (plant) LEFT JOIN a USING (plant)),
  causes AS (SELECT plant, n_valid, head, tail, CASE WHEN n_valid < 10 THEN 'normal' WHEN n_valid > 50 AND tail < 0.3 AND head > 0.5 THEN 'sensor_failure' WHEN slope < -3e-4 THEN 'gradual_degradation' WHEN n_valid > 60 AND autocorr > 0.3 THEN 'soiling_cycle' ELSE 'normal' END AS cause FROM j)"""


@query("causes", f"WITH {CAUSES} SELECT plant, n_valid, round(head, 5) AS head, round(tail, 5) AS tail, cause FROM causes")
def causes(spark, d):
    return rounded(diagnose.cause_by_rule(scored(spark, d), 60, 50).select("plant", "n_valid", "head", "tail", "cause"), 5)


@query("weekly_matrix", f"""WITH {QUALITY}, w AS (SELECT plant, date_trunc('week', time)::DATE + 6 AS week, avg(qs) AS qs FROM quality GROUP BY 1, 2) SELECT plant, week, round(qs, 5) AS qs, round(coalesce(qs, avg(qs) OVER (PARTITION BY week), avg(qs) OVER (PARTITION BY plant), 0.5), 5) AS imputed FROM w""")
def weekly_matrix(spark, d):
    return rounded(diagnose.weekly_matrix(scored(spark, d)), 5)


@query("ks_distance", """WITH h AS (SELECT user_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
  s AS (SELECT user_id AS plant, value AS v, sum((k <= n // 2)::INT) AS a, sum((k > n // 2)::INT) AS b FROM h GROUP BY 1, 2),
  c AS (SELECT plant, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS n1, sum(b) OVER p AS n2 FROM s WINDOW w AS (PARTITION BY plant ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY plant))
  SELECT plant, round(max(abs(ca::DOUBLE / nullif(n1, 0) - cb::DOUBLE / nullif(n2, 0))), 6) AS d, n1::BIGINT AS n1, n2::BIGINT AS n2 FROM c GROUP BY plant, n1, n2""")
def ks_distance(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").where("value IS NOT NULL").select(F.col("user_id").alias("plant"), "value", F.row_number().over(w.orderBy("ts", "event_id")).alias("k"), F.count("*").over(w).alias("n"))
    return rounded(diagnose.ks_statistic(e, "plant", "value", F.col("k") > F.floor(F.col("n") / 2)))


@query("drift_flags")
def drift_flags(spark, d):
    """Two-sample tests of the halves of each plant's last scores, on the scale of daily data."""
    return diagnose.drift(scored(spark, d), half=100)


@query("plant_report")
def plant_report(spark, d):
    return diagnose.report(scored(spark, d), half=100)[0]


@query(
    "plant_figures",
    f"""WITH {CAUSES}, f AS (SELECT t_idx, avg(qs) AS m, stddev_pop(qs) AS s FROM quality GROUP BY 1), z AS (SELECT plant, avg((qs - m) / (s + 1e-6)) AS z_mean FROM quality JOIN f USING (t_idx) GROUP BY 1),
    s AS (SELECT plant, CASE WHEN count(qs) >= 10 THEN regr_slope(qs, t_idx) ELSE 0.0 END AS slope FROM quality GROUP BY 1)
    SELECT plant, round(slope, 7) AS slope, round(z_mean, 4) AS z_mean, cause, 1.0::DOUBLE AS confidence FROM s JOIN z USING (plant) JOIN causes USING (plant)""",
)
def plant_figures(spark, d):
    f = diagnose.figures(scored(spark, d), 60, 50)
    return f.withColumns({"slope": F.round("slope", 7) + F.lit(0.0), "z_mean": F.round("z_mean", 4) + F.lit(0.0)})


@query("decisions", f"""WITH {CAUSES} SELECT plant, cause, cause NOT IN ('sensor_failure', 'regional_cloud_event') AS update, cause <> 'sensor_failure' AS replay, cause IN ('sensor_failure', 'soiling_cycle') AS alert FROM causes""")
def decisions(spark, d):
    return diagnose.decide(diagnose.cause_by_rule(scored(spark, d), 60, 50).select("plant", "cause"))


ACT = f"WITH {SCALES} SELECT CASE WHEN count(*) FILTER (plant % 3 = 0 AND cause NOT IN ('sensor_failure', 'regional_cloud_event')) > 0 THEN 'retrain_triggered' ELSE 'no_action' END AS action, array_to_string(list_sort(list(plant) FILTER (plant % 3 = 0 AND cause NOT IN ('sensor_failure', 'regional_cloud_event'))), ',') AS action_plants FROM (SELECT plant, CASE plant % 4 WHEN 0 THEN 'sensor_failure' WHEN 1 THEN 'regional_cloud_event' ELSE 'normal' END AS cause FROM scales)"


@query("agent_action", ACT)
def agent_action(spark, d):
    p = quality.plant_scales(cube(spark, d)).select("plant", (F.col("plant") % 3 == 0).alias("drift"), F.when(F.col("plant") % 4 == 0, "sensor_failure").when(F.col("plant") % 4 == 1, "regional_cloud_event").otherwise("normal").alias("cause"))
    return diagnose.act(p).select("action", F.array_join("action_plants", ",").alias("action_plants"))


@query("reflection", "SELECT o_orderkey, round_even((b - a) / (abs(b) + 1e-9) * 100, 2) + 0.0::DOUBLE AS improvement_pct, CASE WHEN (b - a) / (abs(b) + 1e-9) * 100 > 5 THEN 'improved' WHEN (b - a) / (abs(b) + 1e-9) * 100 < -5 THEN 'degraded' ELSE 'stable' END AS verdict FROM (SELECT o_orderkey, o_totalprice::DOUBLE / 1000 AS b, o_totalprice::DOUBLE / 1000 * (90 + o_orderkey % 20) / 100 AS a FROM orders)")
def reflection(spark, d):
    b = F.col("o_totalprice").cast("double") / 1000
    o = table(spark, d, "orders").select("o_orderkey", b.alias("loss_before"), (b * (90 + F.col("o_orderkey") % 20) / 100).alias("loss_after"))
    return diagnose.reflect(o).select("o_orderkey", "improvement_pct", "verdict")


@query("nearest_site", f"WITH {PLANTS}, {SITES}, x AS (SELECT plant, location, sqrt((p.lat - s.lat) ** 2 + (p.lon - s.lon) ** 2) AS dist FROM plants p, sites s) SELECT plant, location, round(dist, 6) AS dist_deg FROM (SELECT *, row_number() OVER (PARTITION BY plant ORDER BY dist, location) AS k FROM x) WHERE k = 1")
def nearest_site(spark, d):
    return rounded(align.nearest_site(plants(spark, d), sites(spark, d)))


@query(
    "nearest_in_time",
    """WITH l AS (SELECT o_custkey % 100 AS key, o_orderdate AS time, o_orderkey FROM orders), r AS (SELECT key, time, max(v) AS v FROM (SELECT l_suppkey % 100 AS key, l_shipdate AS time, l_extendedprice::DOUBLE AS v FROM lineitem ) GROUP BY 1, 2),
    b AS (SELECT l.*, r.time AS t0, r.v AS v0 FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.time >= r.time), n AS (SELECT l.o_orderkey, r.time AS t1, r.v AS v1 FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.time < r.time)
    SELECT o_orderkey, CASE WHEN t0 IS NULL OR (t1 IS NOT NULL AND t1 - time <= time - t0) THEN t1 ELSE t0 END AS matched, CASE WHEN t0 IS NULL OR (t1 IS NOT NULL AND t1 - time <= time - t0) THEN v1 ELSE v0 END AS v FROM b JOIN n USING (o_orderkey)""",
)
def nearest_in_time(spark, d):
    left = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("key"), F.col("o_orderdate").alias("time"), "o_orderkey")
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 100).cast("bigint").alias("key"), F.col("l_shipdate").alias("time"), F.col("l_extendedprice").cast("double").alias("v"))
    right = rows.groupBy("key", "time").agg(F.max("v").alias("v"))
    return align.nearest_in_time(left, right, "key", "time", ["v"]).select("o_orderkey", "matched", "v")


@query("rounded_site_join", f"WITH {PLANTS}, {SITES} SELECT p.plant, coalesce(s.location, -1) AS location FROM plants p LEFT JOIN sites s ON round_even(p.lat, 1) = round_even(s.lat, 1) AND round_even(p.lon, 1) = round_even(s.lon, 1)")
def rounded_site_join(spark, d):
    return align.same_place(plants(spark, d), sites(spark, d), 1).select("plant", F.coalesce("location", F.lit(-1)).alias("location"))


@query("exact_site_join", f"WITH {PLANTS}, {SITES} SELECT p.plant, s.location FROM plants p LEFT JOIN sites s ON p.lat = s.lat AND p.lon = s.lon")
def exact_site_join(spark, d):
    return align.same_place(plants(spark, d), sites(spark, d)).select("plant", "location")


@query("unplaced_customers", "SELECT c_custkey FROM customer ANTI JOIN (SELECT s_suppkey AS c_custkey FROM supplier WHERE s_suppkey % 3 <> 0) USING (c_custkey)")
def unplaced_customers(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("c_custkey"))
    return align.without_match(table(spark, d, "customer").select("c_custkey"), s, ["c_custkey"])


@query("missing_coordinates", "SELECT count(*) AS n, count(*) FILTER (s_suppkey IS NULL) AS missing FROM customer LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0) ON c_custkey = s_suppkey")
def missing_coordinates(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select("s_suppkey").distinct()
    return table(spark, d, "customer").join(s, F.col("c_custkey") == F.col("s_suppkey"), "left").agg(F.count("*").alias("n"), F.count_if(F.col("s_suppkey").isNull()).alias("missing"))


@query("first_per_plant_join", "WITH f AS (SELECT * FROM (SELECT ps.l_suppkey, ps.l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem ps) WHERE k = 1) SELECT s_suppkey, l_partkey AS first_part FROM supplier LEFT JOIN f ON s_suppkey = l_suppkey")
def first_per_plant_join(spark, d):
    first = align.first_per_key(table(spark, d, "lineitem"), "l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey")).select("l_suppkey", F.col("l_partkey").alias("first_part"))
    return table(spark, d, "supplier").join(first, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "first_part")


@query("coordinates", """WITH m AS (SELECT 'U' || (p_partkey % 150) AS upn, p_partkey AS line, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 10.0::DOUBLE END AS lat, p_size / 7.0::DOUBLE AS lon FROM part),
  e AS (SELECT 'U' || (c_custkey % 170) AS upn, c_custkey AS line, c_nationkey / 3.0::DOUBLE AS lat, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey / 2.0::DOUBLE END AS lon FROM customer),
  lm AS (SELECT upn, arg_max(struct_pack(a := lat, b := lon), line) AS x FROM m GROUP BY 1), fe AS (SELECT upn, arg_min(struct_pack(a := lat, b := lon), line) AS x FROM e WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1),
  p AS (SELECT 'U' || s_suppkey AS upn FROM supplier)
  SELECT p.upn, round(CASE WHEN lm.x.a IS NOT NULL AND lm.x.b IS NOT NULL THEN lm.x.a ELSE fe.x.a END, 6) AS lat, round(CASE WHEN lm.x.a IS NOT NULL AND lm.x.b IS NOT NULL THEN lm.x.b ELSE fe.x.b END, 6) AS lon, 0.15::DOUBLE AS eta_base, (row_number() OVER (ORDER BY p.upn) - 1)::INT AS plant_id
  FROM p LEFT JOIN lm USING (upn) LEFT JOIN fe USING (upn)""")
def coordinates(spark, d):
    part, c = table(spark, d, "part"), table(spark, d, "customer")
    k, n = F.col("p_partkey"), F.col("c_custkey")
    m = part.select(F.concat(F.lit("U"), k % 150).alias("upn"), k.alias("line"), F.when(k % 4 != 0, F.col("p_size") / 10.0).alias("lat"), (F.col("p_size") / 7.0).alias("lon"), F.lit(None).cast("double").alias("eta_base"), F.lit(None).cast("int").alias("plant_id"))
    e = c.select(F.concat(F.lit("U"), n % 170).alias("upn"), n.alias("line"), (F.col("c_nationkey") / 3.0).alias("lat"), F.when(n % 5 != 0, F.col("c_nationkey") / 2.0).alias("lon"))
    p = table(spark, d, "supplier").select(F.concat(F.lit("U"), F.col("s_suppkey")).alias("upn"))
    return rounded(align.coordinates(p, m, e))


@query("kwp_registry", """WITH j AS (SELECT s_suppkey % 120 AS plant_id, s_suppkey AS line, c_acctbal::DOUBLE AS kwp FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 3)
  SELECT r.range AS plant_id, x.kwp FROM range(80) r LEFT JOIN (SELECT plant_id, arg_max(kwp, line) AS kwp FROM j WHERE plant_id BETWEEN 0 AND 79 AND kwp IS NOT NULL GROUP BY 1) x ON x.plant_id = r.range""")
def kwp_registry(spark, d):
    m = table(spark, d, "supplier").select((F.col("s_suppkey") % 120).alias("plant_id"), F.col("s_suppkey").alias("line"), (F.col("s_suppkey") * 3).alias("code"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_acctbal").cast("double").alias("kwp"))
    return align.kwp_by_plant(m, c, 80)


HAVERSINE = "2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)))"


@query("distance_graph", f"WITH {PLANTS}, e AS (SELECT a.plant AS src, b.plant AS dst, {HAVERSINE} AS dist_km FROM plants a JOIN plants b ON a.plant <> b.plant) SELECT src, dst, round(dist_km, 4) AS dist_km, round(1 / (dist_km + 1e-6), 4) AS weight FROM e WHERE dist_km < 60 AND dist_km > 0.001")
def distance_graph(spark, d):
    p = plants(spark, d)
    return graph.between_plants(p, rounded(graph.place_edges(p, 60.0).where("dist_km > 0.001"), 4))


@query("nearest_neighbour_graph", f"WITH {PLANTS}, far AS (SELECT plant, lat * 10 - 400 AS lat, lon FROM plants), e AS (SELECT a.plant AS src, b.plant AS dst, {HAVERSINE} AS dist_km FROM far a JOIN far b ON a.plant <> b.plant), n AS (SELECT src, arg_min(dst, (dist_km, dst)) AS dst, min(dist_km) AS dist_km FROM e GROUP BY src), u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, round(dist_km, 4) AS dist_km FROM n) SELECT * FROM u UNION ALL SELECT dst, src, dist_km FROM u")
def nearest_neighbour_graph(spark, d):
    far = plants(spark, d).withColumn("lat", F.col("lat") * 10 - 400)
    return rounded(graph.nearest_graph(far).select("src", "dst", "dist_km"), 4)


@query("edge_attention", f"WITH {PLANTS}, e AS (SELECT a.plant AS src, b.plant AS dst, {HAVERSINE} AS dist_km FROM plants a JOIN plants b ON a.plant <> b.plant), s AS (SELECT *, (src % 7 - 3) * ln(1 + 1 / (dist_km + 1e-6)) AS x FROM e WHERE dist_km < 60 AND dist_km > 0.001), m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY dst)) AS w FROM s) SELECT dst, round(sum(w * (src % 11)) / (sum(w) + 1e-12), 5) AS message FROM m GROUP BY dst")
def edge_attention(spark, d):
    p = plants(spark, d).withColumns({"score": (F.col("plant") % 7 - 3).cast("double"), "value": (F.col("plant") % 11).cast("double")})
    heard = graph.place_attention(p, graph.place_edges(p, 60.0).where("dist_km > 0.001"), "score", "value")
    return rounded(heard.withColumnRenamed("plant", "dst"), 5)


def feature_cube(spark, d):
    q = scored(spark, d).drop("capacity_scale", "qs")
    return q.withColumn("wind", (F.col("plant") + F.col("t_idx") * 3) % 80 / 10.0).join(plants(spark, d).select("plant", "lat", "lon"), "plant")


@query("standardised", f"WITH {CUBE}, g AS (SELECT avg(temp) AS mt, stddev_pop(temp) AS st, avg(energia) AS me, stddev_pop(energia) AS se FROM cube) SELECT plant, round(avg((temp - mt) / (st + 1e-6)), 5) AS temp_z, round(avg((coalesce(energia, me) - me) / (se + 1e-6)), 5) AS energia_z FROM cube, g GROUP BY plant")
def standardised(spark, d):
    return rounded(features.standardised(cube(spark, d), "temp", "energia").groupBy("plant").agg(F.avg("temp_z").alias("temp_z"), F.avg("energia_z").alias("energia_z")), 5)


ETA = f"""{CUBE}, f AS (SELECT plant, coalesce(energia, 0) AS e, greatest(coalesce(poa / 1000.0::DOUBLE, 0), 0) AS s, coalesce(poa / 1000.0::DOUBLE > 0.03, false) AS day FROM cube),
  sc AS (SELECT plant, CASE WHEN count(*) FILTER (day AND e > 0) > 10 THEN quantile_cont(e, 0.99) FILTER (day AND e > 0) + 1e-6 ELSE 1.0 END AS pv_scale, CASE WHEN count(*) FILTER (day AND s > 0) > 10 THEN quantile_cont(s, 0.99) FILTER (day AND s > 0) + 1e-6 ELSE 1.0 END AS solar_p99 FROM f GROUP BY 1),
  g AS (SELECT plant, pv_scale, solar_p99, count(*) FILTER (day AND s > 0 AND e > 0) AS n_valid, sum((s / solar_p99) ** 2 * least(1.5, e / pv_scale)) FILTER (day AND s > 0 AND e > 0) AS a, sum((s / solar_p99) ** 3) FILTER (day AND s > 0 AND e > 0) AS b FROM f JOIN sc USING (plant) GROUP BY 1, 2, 3),
  h AS (SELECT *, CASE WHEN n_valid > 10 THEN a / (b + 1e-12) ELSE 1.0 END AS eta FROM g), m AS (SELECT coalesce(median(eta) FILTER (n_valid >= 50), 0.8) AS fleet FROM h)"""


@query("target_scales", f"WITH {ETA} SELECT plant, round(pv_scale, 6) AS pv_scale, round(solar_p99, 6) AS solar_p99, round(least(0.98, greatest(0.1, CASE WHEN n_valid < 50 THEN fleet ELSE eta END)), 6) AS eta_adjusted, n_valid FROM h, m")
def target_scales(spark, d):
    day = F.coalesce(F.col("poa") / 1000.0 > 0.03, F.lit(False))
    return rounded(features.target_scales(cube(spark, d).withColumn("day", day)))


@query("peak_power_estimate", f"WITH {ETA} SELECT plant, round(pv_scale / solar_p99, 5) AS kwp FROM sc")
def peak_power_estimate(spark, d):
    day = F.coalesce(F.col("poa") / 1000.0 > 0.03, F.lit(False))
    s = features.target_scales(cube(spark, d).withColumn("day", day))
    return rounded(s.select("plant", (F.col("pv_scale") / F.col("solar_p99")).alias("kwp")), 5)


@query("lag_windows", f"WITH {CUBE}, l AS (SELECT plant, t_idx, list(coalesce(energia, 0)) OVER w AS x, max(t_idx) OVER () AS last FROM cube WINDOW w AS (PARTITION BY plant ORDER BY t_idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) SELECT plant, count(*) AS n, min(t_idx) AS first_t, max(t_idx) AS last_t, round(sum(x[1]), 4) AS oldest, round(sum(x[24]), 4) AS newest FROM l WHERE len(x) = 24 AND t_idx < last GROUP BY plant")
def lag_windows(spark, d):
    c = cube(spark, d).withColumns({"e": F.coalesce("energia", F.lit(0.0)), **{k: F.lit(0.0) for k in ("y_ghi", "y_pv", "eta", "ghi_cs")}})
    w = features.lag_windows(c, 24, ("e",))
    at = lambda i: F.round(F.sum(F.get(F.get("x", F.lit(i)), F.lit(0))), 4)
    return w.groupBy("plant").agg(F.count("*").alias("n"), F.min("t_idx").alias("first_t"), F.max("t_idx").alias("last_t"), at(0).alias("oldest"), at(23).alias("newest"))


SUN = """sin_elev AS (SELECT *, greatest(0, least(1, sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(radians((h * 60 + off) / 4.0::DOUBLE - 180)))) AS sine FROM (
    SELECT *, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec,
      229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) + 4 * lon AS off
    FROM (SELECT *, 2 * pi() / 365 * (dayofyear(time) - 1 + (hour(time) - 12) / 24.0::DOUBLE) AS g, hour(time)::DOUBLE AS h FROM placed))),
  lit AS (SELECT *, CASE WHEN sine > 1e-3 THEN 1.098::DOUBLE * sine * exp(-0.057::DOUBLE / sine) ELSE 0 END AS ghi_cs FROM sin_elev)"""


@query(
    "feature_rows",
    f"""WITH {QUALITY}, {PLANTS}, placed AS (SELECT q.*, ((q.plant + t_idx * 3) % 80) / 10.0::DOUBLE AS wind, p.lat, p.lon FROM quality q JOIN plants p USING (plant)), {SUN},
    f AS (SELECT *, coalesce(energia, 0) AS e, greatest(coalesce(poa / 1000.0::DOUBLE, 0), 0) AS s, sine > 0.05 AND coalesce(poa / 1000.0::DOUBLE, 0) > 0.03 AS day FROM lit),
    sc AS (SELECT plant, CASE WHEN count(*) FILTER (day AND e > 0) > 10 THEN quantile_cont(e, 0.99) FILTER (day AND e > 0) + 1e-6 ELSE 1.0 END AS pv_scale, CASE WHEN count(*) FILTER (day AND s > 0) > 10 THEN quantile_cont(s, 0.99) FILTER (day AND s > 0) + 1e-6 ELSE 1.0 END AS solar_p99 FROM f GROUP BY 1),
    g AS (SELECT plant, pv_scale, count(*) FILTER (day AND s > 0 AND e > 0) AS n_valid, sum((s / solar_p99) ** 2 * least(1.5, e / pv_scale)) FILTER (day AND s > 0 AND e > 0) AS a, sum((s / solar_p99) ** 3) FILTER (day AND s > 0 AND e > 0) AS b FROM f JOIN sc USING (plant) GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN n_valid > 10 THEN a / (b + 1e-12) ELSE 1.0 END AS eta FROM g), m AS (SELECT coalesce(median(eta) FILTER (n_valid >= 50), 0.8) AS fleet FROM k),
    z AS (SELECT avg(temp) AS mt, stddev_pop(temp) AS st, avg(poa) AS mp, stddev_pop(poa) AS sp, avg(wind) AS mw, stddev_pop(wind) AS sw FROM f)
    SELECT plant, round(avg(coalesce((temp - mt) / (st + 1e-6), 0)), 5) + 0.0::DOUBLE AS temp_z, round(avg(coalesce((poa - mp) / (sp + 1e-6), 0)), 5) + 0.0::DOUBLE AS poa_z, round(avg(coalesce((wind - mw) / (sw + 1e-6), 0)), 5) + 0.0::DOUBLE AS wind_z,
      round(avg(sine), 5) AS sin_elev, round(avg(sqrt(1 - sine * sine)), 5) AS cos_elev, {", ".join(f"round(avg(coalesce(m{i}, 0)), 5) AS m{i}" for i in range(1, 6))},
      round(avg(least(1.5, e / pv_scale)), 5) AS pv_lag, round(avg(s), 5) AS y_ghi, round(avg(least(1.5, e / pv_scale)), 5) AS y_pv,
      round(avg(least(0.98, greatest(0.1, CASE WHEN n_valid < 50 THEN fleet ELSE eta END))), 5) AS eta, round(avg(ghi_cs), 5) AS ghi_cs
    FROM f JOIN k USING (plant), m, z GROUP BY plant""",
)
def feature_rows(spark, d):
    """All channels of the forecaster, averaged by plant."""
    f = features.feature_rows(feature_cube(spark, d))
    return rounded(f.groupBy("plant").agg(*[F.avg(c).alias(c) for c in (*features.CHANNELS, "y_ghi", "y_pv", "eta", "ghi_cs")]), 5)


@query("fallback_weather", f"WITH {PLANTS}, placed AS (SELECT plant, time, lat, lon FROM plants, (SELECT DISTINCT date_trunc('hour', ts) AS time FROM events)), {SUN} SELECT plant, time, round(ghi_cs * 1000, 3) AS poa, round(10 + 12 * sin(pi() * (dayofyear(time) - 80) / 180), 5) AS temp, 3.0::DOUBLE AS wind FROM lit")
def fallback_weather(spark, d):
    from sunfleet.sources.files import fallback_weather as weather

    t = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("time")).distinct()
    w = weather(plants(spark, d).select("plant", "lat", "lon").crossJoin(F.broadcast(t)).select("plant", "time", "lat", "lon"))
    return w.select("plant", F.col("time").cast("timestamp_ntz").alias("time"), F.round("poa", 3).alias("poa"), F.round("temp", 5).alias("temp"), "wind")


LABEL = "CASE WHEN plant % 5 = 0 THEN 'sensor_failure' WHEN plant % 7 = 0 AND t_idx > 1000 THEN 'soiling_cycle' ELSE 'normal' END"
WINDOWS = f"{QUALITY}, s AS (SELECT max(t_idx) + 1 AS n FROM quality), h AS (SELECT unnest(range(240, n, 120)) AS t FROM s), w AS (SELECT plant, t::INT AS t, arg_max({LABEL}, t_idx) AS label, sum(coalesce(qs, 0.5)) AS total, count(qs) AS filled FROM h JOIN quality ON t_idx >= t - 240 AND t_idx < t GROUP BY 1, 2 HAVING count(*) = 240 AND count(qs) >= 0.3 * 240)"


def windows(spark, d):
    return learn.labelled_windows(scored(spark, d).withColumn("label", F.expr(LABEL)), "label", 240, 120)


@query("labelled_windows", f"WITH {WINDOWS} SELECT plant, t, label, round(total, 3) AS total FROM w")
def labelled_windows(spark, d):
    total = F.aggregate("series", F.lit(0.0), lambda a, v: a + v)
    return windows(spark, d).select("plant", F.col("t").cast("int").alias("t"), "label", F.round(total, 3).alias("total"))


@query("training_classes", f"WITH {WINDOWS}, n AS (SELECT count(*) FILTER (label <> 'normal') AS faults FROM w) SELECT label, CASE WHEN label = 'normal' THEN least(count(*), greatest(2 * max(faults), 20)) ELSE count(*) END AS n FROM w, n GROUP BY label")
def training_classes(spark, d):
    return learn.undersampled(windows(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


@query("hop_windows", f"WITH {CUBE}, s AS (SELECT max(t_idx) + 1 AS n FROM cube), h AS (SELECT unnest(range(240, n, 56)) AS t FROM s) SELECT t::INT AS t, count(*) AS n, count(energia) AS filled, round(avg(energia), 5) AS mean FROM h JOIN cube ON t_idx >= t - 240 AND t_idx < t GROUP BY t")
def hop_windows(spark, d):
    h = continual.hops(cube(spark, d), 240, 56)
    return rounded(h.groupBy("t").agg(F.count("*").alias("n"), F.count("energia").alias("filled"), F.avg("energia").alias("mean")), 5)


@query("month_split", f"WITH {CUBE}, k AS (SELECT time, month(time) AS m, row_number() OVER (PARTITION BY month(time) ORDER BY time) AS k, count(*) OVER (PARTITION BY month(time)) AS n FROM times) SELECT time, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS part FROM k")
def month_split(spark, d):
    return features.month_split(align.time_index(readings(spark, d))).select("time", "part")


@query("outlier_plants", f"WITH {QUALITY}, o AS (SELECT plant, coalesce(avg(qs) FILTER (poa > 50), 0) AS mean_qs, count(*) FILTER (poa > 50 AND energia > 0) AS n_valid FROM quality GROUP BY 1) SELECT plant, round(mean_qs, 5) AS mean_qs, n_valid, mean_qs >= 0.3 AND n_valid >= 200 AS keep FROM o")
def outlier_plants(spark, d):
    return rounded(features.outlier_plants(scored(spark, d)), 5)


@query("kept_rows", f"WITH {QUALITY}, o AS (SELECT plant FROM quality GROUP BY 1 HAVING coalesce(avg(qs) FILTER (poa > 50), 0) >= 0.3 AND count(*) FILTER (poa > 50 AND energia > 0) >= 200) SELECT plant, count(*) AS n FROM quality SEMI JOIN o USING (plant) GROUP BY plant")
def kept_rows(spark, d):
    return features.without_outliers(scored(spark, d)).groupBy("plant").agg(F.count("*").alias("n"))


@query("patches", "SELECT vec_id, (s // 2)::INT AS k, round(embedding[s + 1]::DOUBLE, 6) AS a, round(embedding[s + 4]::DOUBLE, 6) AS d FROM embeddings, range(0, 21, 2) t(s)")
def patches(spark, d):
    from sunfleet.functions.scalar import patches as cut

    x = F.transform("embedding", lambda v: F.round(v.cast("double"), 6))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(cut(x)).alias("k", "p")).select("vec_id", "k", F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(3)).alias("d"))


@query("array_features", "SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 5) AS mean, round(list_max(embedding)::DOUBLE, 5) AS max, round(list_stddev_pop(embedding::DOUBLE[]), 5) AS std, round(len(list_filter(embedding, lambda v: v > 0)) / len(embedding), 5) AS positive FROM embeddings")
def array_features(spark, d):
    from sunfleet.functions.scalar import array_stats

    return rounded(table(spark, d, "embeddings").select("vec_id", array_stats("embedding").alias("s")).select("vec_id", "s.*"), 5)


@query("softmax_class", "SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS class, round(1 / list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)))), 6) AS confidence FROM embeddings")
def softmax_class(spark, d):
    from sunfleet.functions.scalar import softmax_top

    x = F.transform("embedding", lambda v: v.cast("double"))
    return rounded(table(spark, d, "embeddings").select("vec_id", softmax_top(x).alias("s")).select("vec_id", "s.*"))


@query("trajectory_clusters")
def trajectory_clusters(spark, d):
    series = table(spark, d, "embeddings").select(F.col("vec_id").alias("plant"), F.col("embedding").cast("array<double>").alias("series"))
    return learn.TrajectoryClusters().fit_rows(series)


@query("classified_series")
def classified_series(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("plant"), F.col("embedding").cast("array<double>").alias("series"), F.col("label").cast("string").alias("label"))
    model = learn.CauseClassifier(64, least_confidence=0.05).fit(rows.orderBy(F.xxhash64("plant"), "plant").limit(400))
    return model.predict(rows)


@query("sun_geometry", f"""WITH {PLANTS}, t AS (SELECT DISTINCT date_trunc('hour', ts) AS time FROM events), x AS (SELECT plant, time, lat, lon, dayofyear(time) - 1 AS dy, hour(time)::DOUBLE AS h FROM plants, t),
  g AS (SELECT *, 2 * pi() / 365 * (dy + (h - 12) / 24.0::DOUBLE) AS g FROM x),
  s AS (SELECT *, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) + 4 * lon AS off FROM g),
  e AS (SELECT *, greatest(0, least(1, sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(radians((h * 60 + off) / 4.0::DOUBLE - 180)))) AS sine FROM s)
  SELECT plant, time, round(sine, 5) AS sine, round(CASE WHEN sine > 1e-3 THEN 1.098::DOUBLE * sine * exp(-0.057::DOUBLE / sine) ELSE 0 END, 5) AS ghi_cs FROM e""")
def sun_geometry(spark, d):
    t = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("time")).distinct()
    p = plants(spark, d).crossJoin(F.broadcast(t))
    sine = elevation_sine(F.col("time"), F.col("lat"), F.col("lon"))
    return rounded(p.select("plant", F.col("time").cast("timestamp_ntz").alias("time"), sine.alias("sine")).withColumn("ghi_cs", clear_sky_kw(F.col("sine"))), 5)


@query("site_distances", f"WITH {PLANTS}, {SITES} SELECT plant, location, round({HAVERSINE.replace('b.', 's.').replace('a.', 'p.')}, 4) AS km FROM plants p JOIN sites s ON p.nation = s.location")
def site_distances(spark, d):
    s = sites(spark, d).select("location", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    return rounded(plants(spark, d).join(s, F.col("nation") == F.col("location")).select("plant", "location", haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")).alias("km")), 4)


@query("parsed_files", "SELECT p_partkey, 'UPN_' || split_part(regexp_replace(f, '\\.[^.]*$', ''), '_', 3) || '_01' AS upn, nullif(regexp_extract(f, '(UPN_\\d+_\\d+)', 1), '') AS found FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '2019_UPM_' ELSE '2019_UPN_' END || p_partkey || '_0' || p_size % 10 || '.csv' AS f FROM part)")
def parsed_files(spark, d):
    from sunfleet.sources.files import upn_in, upn_of

    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "2019_UPM_").otherwise("2019_UPN_"), k, F.lit("_0"), F.col("p_size") % 10, F.lit(".csv"))
    return table(spark, d, "part").select("p_partkey", upn_of(name).alias("upn"), upn_in(name).alias("found"))


@query("parsed_times", "SELECT o_orderkey, try_strptime(s, '%d/%m/%y %H:%M') AS time FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%d/%m/%y %H:%M') END AS s FROM orders)")
def parsed_times(spark, d):
    from sunfleet.sources.files import lenient_time

    text = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "dd/MM/yy HH:mm"))
    return table(spark, d, "orders").select("o_orderkey", lenient_time(text).cast("timestamp_ntz").alias("time"))


@query("week_endings", "SELECT date_trunc('week', o_orderdate)::DATE + 6 AS week, count(*) AS n FROM orders GROUP BY 1")
def week_endings(spark, d):
    return table(spark, d, "orders").groupBy(week_ending("o_orderdate").alias("week")).agg(F.count("*").alias("n"))


@query("digitised", "SELECT CASE WHEN q < 0.2 THEN 'a' WHEN q < 0.4 THEN 'b' WHEN q < 0.6 THEN 'c' WHEN q < 0.8 THEN 'd' ELSE 'e' END AS label, count(*) AS n, min(q) AS low FROM (SELECT l_quantity::DOUBLE / 50 AS q FROM lineitem) GROUP BY 1")
def digitised(spark, d):
    q = table(spark, d, "lineitem").select((F.col("l_quantity").cast("double") / 50).alias("q"))
    return q.groupBy(bucket("q", (0.2, 0.4, 0.6, 0.8), "abcde").alias("label")).agg(F.count("*").alias("n"), F.min("q").alias("low"))


@query("exploded_weather", "SELECT vec_id, i::INT AS i, round(embedding[i]::DOUBLE, 6) AS temperature_2m, NULL::DOUBLE AS cloud_cover FROM embeddings, range(1, 25) t(i)")
def exploded_weather(spark, d):
    from sunfleet.sources.files import explode_weather

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("location"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.sequence(F.lit(1), F.lit(24)).alias("time"), F.slice("embedding", 1, 24).cast("array<double>").alias("temperature_2m"))
    return rounded(explode_weather(e).select(F.col("location").alias("vec_id"), F.col("time").alias("i"), "temperature_2m", "cloud_cover"))


@query("window_quality", f"WITH {QUALITY}, l AS (SELECT plant, arg_max(pow(coalesce(m1, 0) * coalesce(m2, 0) * coalesce(m3, 0) * coalesce(m4, 0) * coalesce(m5, 0), 0.2), t_idx) AS q FROM quality GROUP BY 1) SELECT plant, round(q, 5) AS qs_last, round(coalesce((SELECT avg(q) FROM l WHERE q > 0), 0), 5) AS qs_mean FROM l")
def window_quality(spark, d):
    return rounded(continual.window_quality(scored(spark, d)), 5)


