"""The quality score: per-plant scales, five rolling components and their geometric mean, shrinkage, fleet views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunfleet.functions.rolling import Rolling
from sunfleet.functions.scalar import EPS, clip, sigmoid, true
from sunfleet.operators import quantiles

#: Irradiance (kW/m2) over which it is day, and the temperature coefficient of efficiency per kelvin.
DAY_KW, GAMMA = 0.05, 0.004
COMPONENTS = ("m1", "m2", "m3", "m4", "m5")


def with_scales(cube: DataFrame, eps: float = EPS) -> DataFrame:
    """cube (plant, energia, poa in W/m2 and, if given, eta_seed) with the scales of plant_scales() in each row.

    All are windows over a plant's rows, so that the cube is read once and shuffled by plant at most once.
    """
    plant = Window.partitionBy("plant")
    ref = F.col("poa") / 1000.0
    df = cube.withColumns({"__ref": ref, "__day": true(ref > DAY_KW)})
    made = F.col("__day") & (F.col("energia") > 0)
    p99 = lambda x: F.percentile(x, F.lit(0.99)).over(plant)
    df = df.withColumns(
        {
            "__n_made": F.count_if(made).over(plant), "__p_real": p99(F.when(made, F.col("energia"))), "__p_ref": p99(F.when(made, F.col("__ref"))),
            "__peak": p99(F.when(F.col("__day"), F.col("energia"))), "__day_rows": F.count_if("__day").over(plant),
        }
    )
    good = (F.col("__n_made") > 10) & (F.col("__p_real") > eps) & (F.col("__p_ref") > eps)
    # a plant without any day row has a peak of 1; one whose day rows are all missing has none
    df = df.withColumns({"capacity_scale": F.when(good, F.col("__p_real") / F.col("__p_ref")).otherwise(1.0), "day_peak": F.when(F.col("__day_rows") == 0, F.lit(1.0)).otherwise(F.col("__peak"))})
    of = F.when(F.col("__day") & F.col("energia").isNotNull(), F.col("energia") / (F.col("__ref") * F.col("capacity_scale") + eps))
    seed = F.first("eta_seed", ignorenulls=True).over(plant) if "eta_seed" in cube.columns else F.lit(0.15)
    df = df.withColumns({"__eta": F.median(of).over(plant), "__n": F.count(of).over(plant), "__seed": seed})
    df = df.withColumn("eta_base", clip(F.coalesce(F.when(F.col("__n") > 10, F.col("__eta")), F.col("__seed")), 0.1, 2.0))
    return df.drop("__ref", "__day", "__n_made", "__p_real", "__p_ref", "__peak", "__day_rows", "__eta", "__n", "__seed")


def plant_scales(cube: DataFrame, eps: float = EPS) -> DataFrame:
    """plant, capacity_scale, eta_base, day_peak from daytime rows of plant, energia, poa (W/m2) and, if given, eta_seed.

    capacity_scale: ratio of the 99th percentiles of energy and irradiance over rows with energy, 1 where there are 10 or
    fewer; eta_base: median of energy over scaled irradiance, the seed where there are 10 or fewer; within [0.1, 2].
    """
    columns = ["plant", "energia", "poa", *[c for c in ("eta_seed",) if c in cube.columns]]
    scales = ("capacity_scale", "eta_base", "day_peak")
    return with_scales(cube.select(*columns), eps).groupBy("plant").agg(*[F.first(c).alias(c) for c in scales])


def quality(cube: DataFrame, window: int = 720, least: int | None = None, eps: float = EPS, scales: DataFrame | None = None) -> DataFrame:
    """cube (plant, t_idx, time, energia, poa, temp on the dense grid) with m1 to m5, capacity_scale and qs. The scales are the
    cube's own, or those given as by plant_scales(), a row for each plant.

    Windows are of rows; a component needs `least` valid rows (a quarter of the window, at least 10), completeness one. All
    five share one shuffle by plant. m1, m2, m4 and m5 are shown by day only.
    """
    least = max(window // 4, 10) if least is None else least
    # one shuffle and one sort, whose order all windows use
    sorted_ = cube.select("plant", "t_idx", "time", "energia", "poa", "temp", *[c for c in ("eta_seed",) if c in cube.columns]).repartition("plant").sortWithinPartitions("plant", "t_idx")
    df = with_scales(sorted_, eps) if scales is None else sorted_.join(scales, "plant")
    raw = F.col("poa") / 1000.0
    df = df.withColumns({"day": true(raw > DAY_KW), "dark": true(raw < eps), "ref": raw * F.col("capacity_scale")})
    df = df.withColumns({"r": F.when(F.col("day"), F.col("energia")), "v": F.when(F.col("day"), F.col("ref"))})
    eta = F.col("eta_base") * (1.0 - GAMMA * (F.col("temp") - 25.0))
    short = 1.0 - F.col("r") / (F.col("ref") + eps) / (eta + eps)
    df = df.withColumns({"short": clip(short, 0.0), "gap": F.col("energia").isNull().cast("double")})
    df = df.select("plant", "t_idx", "time", "energia", "poa", "temp", "capacity_scale", "day_peak", "day", "dark", "ref", "r", "v", "short", "gap")
    roll = Rolling("plant", "t_idx", window)
    r, v = F.col("r"), F.col("v")
    day = F.col("day")
    df = roll.apply(
        df,
        m1=clip(roll.corr(r, v, least), 0.0, 1.0),
        m2=clip(1.0 - F.abs(roll.mean(r - v, least)) / (F.abs(roll.mean(v, least)) + eps), 0.0, 1.0),
        m3=clip(1.0 - roll.mean(F.col("gap"), 1), 0.0, 1.0),
        m4=clip(roll.std(r, least) / (roll.std(v, least) + eps), 0.0, 1.0),
        m5=clip(1.0 - roll.mean(F.col("short"), least), 0.0, 1.0),
    )
    product = F.col("m1") * F.col("m2") * F.col("m3") * F.col("m4") * F.col("m5")
    night = F.when(F.col("dark") & F.col("energia").isNotNull(), true(F.col("energia") <= 0.01 * (F.col("day_peak") + eps)).cast("double"))
    df = df.withColumn("qs", F.when(day, clip(F.pow(product, 0.2), 0.0, 1.0)).otherwise(night))
    shown = {m: F.when(day, F.col(m)) for m in COMPONENTS if m != "m3"}
    return df.withColumns(shown).select("plant", "t_idx", "time", "energia", "poa", "temp", *COMPONENTS, "capacity_scale", "qs")


def valid_count(df: DataFrame, window: int = 720) -> DataFrame:
    """df with valid_count: rows with energy above 0 among the last `window`."""
    roll = Rolling("plant", "t_idx", window)
    return roll.apply(df, valid_count=roll.sum((F.col("energia") > 0).cast("long")).cast("long"))


def reliability_bins(df: DataFrame, bins: int = 24, least: int = 200) -> DataFrame:
    """bin, centre, n, std, reliability: spread of daytime scores by valid count, in equal bins over [0, p99 of the count].
    Values on the last edge belong to no bin. One row per bin with `least` rows or more."""
    rows = df.where((F.col("poa") / 1000.0 > DAY_KW) & F.col("qs").isNotNull()).select("valid_count", "qs")
    top = F.lit(quantiles.overall(rows, "valid_count", [0.99])[0]).cast("double")
    placed = rows.withColumn("top", top).where("top > 0").withColumn("bin", F.floor(F.col("valid_count") / (F.col("top") / bins)).cast("int"))
    grouped = placed.where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin", "top").agg(F.count("*").alias("n"), F.stddev_pop("qs").alias("std")).where(F.col("n") >= least)
    best = F.max("std").over(Window.partitionBy())  # at most `bins` rows
    return grouped.select("bin", ((F.col("bin") + 0.5) * F.col("top") / bins).alias("centre"), "n", "std", (1 - F.col("std") / F.nullif(best, F.lit(0.0))).alias("reliability"))


def fit_confidence(df: DataFrame, bins: int = 24) -> tuple[float, float]:
    """(n0, scale) of a sigmoid through the reliability bins, by bounded Gauss-Newton steps on at most `bins` points; half and
    an eighth of the largest count where the data say too little."""
    rows = df.where((F.col("poa") / 1000.0 > DAY_KW) & F.col("qs").isNotNull()).agg(F.count("*"), F.max("valid_count")).first()
    top = float(rows[1] or 0)
    if rows[0] < 1000:
        return top / 2, max(top / 8, 1.0)
    found = reliability_bins(df, bins).select("centre", "reliability").where("reliability IS NOT NULL").orderBy("centre").collect()
    x, y = (np.array([r[i] for r in found], float) for i in (0, 1))
    if len(x) < 5 or np.ptp(y) < 1e-9:
        return top / 2, max(top / 8, 1.0)
    low, high = np.array([0.0, 1.0]), np.array([top, top])
    p, damp = np.clip([top / 2, top / 8], low, high), 1e-3
    model = lambda q: 1.0 / (1.0 + np.exp(-np.clip((x - q[0]) / q[1], -60, 60)))
    cost = np.sum((model(p) - y) ** 2)
    for _ in range(200):
        s = model(p)
        g = s * (1 - s)
        jac = np.stack([-g / p[1], -g * (x - p[0]) / p[1] ** 2], axis=1)
        left = jac.T @ jac
        step = np.linalg.lstsq(left + damp * np.diag(np.diag(left) + 1e-12), -jac.T @ (s - y), rcond=None)[0]
        new = np.clip(p + step, low, high)
        now = np.sum((model(new) - y) ** 2)
        if now < cost:
            done = cost - now < 1e-12
            p, cost, damp = new, now, max(damp / 3, 1e-9)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e9:
                break
    return float(p[0]), float(p[1])


def prior(df: DataFrame, least: int = 100) -> DataFrame:
    """One row: threshold (90th percentile of the daytime valid count) and prior (median of scores within (0, 1) above it);
    0.5 where fewer than `least` rows are left at either step."""
    day = df.where((F.col("poa") / 1000.0 > DAY_KW) & F.col("qs").isNotNull())
    found = quantiles.by_group(day, F.lit(0), "valid_count", lambda n: [0.9])
    n_day, threshold = (found[0][0], found[0][1][0]) if found else (0, None)
    inside = day.where((F.col("valid_count") >= F.lit(threshold)) & (F.col("qs") > 0) & (F.col("qs") < 1)) if found else day.where("false")
    middle = quantiles.by_group(inside, F.lit(0), "qs", lambda n: [0.5])
    n, centre = (middle[0][0], middle[0][1][0]) if middle else (0, 0.5)
    row = (threshold if n else None, n, centre if n_day >= least and n >= least else 0.5)
    return df.sparkSession.createDataFrame([row], "threshold double, n long, prior double")


def shrink(df: DataFrame, n0: float, scale: float, centre: float, asymmetric: bool = True):
    """df with confidence and shrunk: qs pulled to `centre` where the valid count is small; a missing qs is the centre. With
    `asymmetric` a score at or over the centre stays."""
    confidence = sigmoid((F.col("valid_count") - F.lit(float(n0))) / F.lit(float(scale)))
    q = F.coalesce("qs", F.lit(float(centre)))
    blended = confidence * q + (1 - confidence) * F.lit(float(centre))
    kept = F.when(q >= centre, q).otherwise(blended) if asymmetric else blended
    return df.withColumns({"confidence": confidence, "shrunk": clip(kept, 0.0, 1.0)})


def temporal(df: DataFrame, window: int = 720, least: int = 180) -> DataFrame:
    """df with temporal_qs, the mean over window / 2 rows before and window / 2 - 1 after the row."""
    w = Window.partitionBy("plant").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("plant").orderBy("t_idx")
    half = window // 2
    df = df.withColumns({"__s": F.sum(F.coalesce("qs", F.lit(0.0))).over(w), "__n": F.count("qs").over(w)})
    whole = Window.partitionBy("plant")
    high = lambda c: F.coalesce(F.lead(c, half - 1).over(order), F.max_by(c, "t_idx").over(whole))
    low = lambda c: F.coalesce(F.lag(c, half + 1).over(order), F.lit(0))
    df = df.withColumns({"__hs": high("__s"), "__hn": high("__n"), "__ls": low("__s"), "__ln": low("__n")})
    n = F.col("__hn") - F.col("__ln")
    return df.withColumn("temporal_qs", F.when(n >= least, (F.col("__hs") - F.col("__ls")) / F.nullif(n, F.lit(0)))).drop("__s", "__n", "__hs", "__hn", "__ls", "__ln")


def slopes(df: DataFrame, least: int = 10) -> DataFrame:
    """plant, slope of qs over t_idx, 0 with fewer than `least` points."""
    fit = df.groupBy("plant").agg(F.regr_slope("qs", F.col("t_idx").cast("double")).alias("s"), F.count("qs").alias("n"))
    return fit.select("plant", F.when(F.col("n") >= least, F.col("s")).otherwise(0.0).alias("slope"))


def spatial_z(df: DataFrame) -> DataFrame:
    """df with z: how far a score is from the fleet's at its time, in population deviations. The fleet's figures are partial
    aggregates joined back, so that no time is gathered in one task."""
    fleet = df.groupBy("t_idx").agg(F.avg("qs").alias("__m"), F.stddev_pop("qs").alias("__s"))
    return df.join(fleet, "t_idx").withColumn("z", (F.col("qs") - F.col("__m")) / (F.col("__s") + 1e-6)).drop("__m", "__s")


def fleet_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("t_idx", "time").agg(F.avg("qs").alias("fleet_qs"))


def compacted(df: DataFrame, value: str = "qs") -> DataFrame:
    """plant, k, v: the values that are there, numbered anew from 0 in time order."""
    w = Window.partitionBy("plant").orderBy("t_idx")
    return df.where(F.col(value).isNotNull()).select("plant", (F.row_number().over(w) - 1).alias("k"), F.col(value).alias("v"))


def autocorrelation(series: DataFrame, lag: int = 720, least: int | None = None) -> DataFrame:
    """plant, autocorr of a compacted series with itself `lag` values later; 0 with `least` values or fewer, NULL where one
    side is constant."""
    w = Window.partitionBy("plant").orderBy("k")
    pairs = series.withColumn("w", F.lag("v", lag).over(w))
    both = F.when(F.col("w").isNotNull(), F.col("v"))
    # moments around the plant's mean, as corr() raises on a constant series
    agg = pairs.withColumn("__m", F.avg("v").over(Window.partitionBy("plant"))).withColumns({"x": both - F.col("__m"), "y": F.col("w") - F.col("__m")})
    sums = agg.groupBy("plant").agg(F.count("*").alias("n"), F.count("y").alias("c"), *[F.sum(e).alias(a) for a, e in {"sx": F.col("x"), "sy": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}.items()])
    c = F.nullif(F.col("c"), F.lit(0))
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / c, F.col("yy") - F.col("sy") * F.col("sy") / c
    ok = (vx > 1e-12 * F.col("xx")) & (vy > 1e-12 * F.col("yy"))
    r = F.when(ok, (F.col("xy") - F.col("sx") * F.col("sy") / c) / F.sqrt(F.nullif(F.when(ok, vx * vy), F.lit(0.0))))
    return sums.select("plant", F.when(F.col("n") > (lag if least is None else least), r).otherwise(0.0).alias("autocorr"))


def rolling_std_mean(series: DataFrame, window: int = 720, least: int = 100) -> DataFrame:
    """plant, rolling_std: mean over a compacted series of the sample deviation of the last `window` values."""
    roll = Rolling("plant", "k", window)
    return roll.apply(series, s=roll.std(F.col("v"), least)).groupBy("plant").agg(F.avg("s").alias("rolling_std"))


def scenarios(df: DataFrame, roles: dict[str, int], spans: dict[str, tuple[int, int]], lag: int = 720, window: int = 720, least: int = 100) -> DataFrame:
    """One row with the figures and outcomes of four fault rules.

    roles: the plants degrading, failing, cloud_from, cloud_to (inclusive), soiling; spans: t_idx ranges [a, b) fail_pre,
    fail_post, cloud_pre, cloud_evt.
    """
    within = lambda name: F.col("t_idx").between(spans[name][0], spans[name][1] - 1)
    z = spatial_z(df)
    failing = F.col("plant") == roles["failing"]
    region = F.col("plant").between(roles["cloud_from"], roles["cloud_to"])
    a = z.agg(
        F.avg(F.when(failing & within("fail_pre"), F.col("z"))).alias("z_pre"),
        F.avg(F.when(failing & within("fail_post"), F.col("z"))).alias("z_post"),
        F.stddev_pop(F.when(region & within("cloud_evt"), F.col("z"))).alias("z_spread"),
    )
    fleet = fleet_mean(df)
    b = fleet.agg(F.avg(F.when(within("cloud_pre"), F.col("fleet_qs"))).alias("fleet_pre"), F.avg(F.when(within("cloud_evt"), F.col("fleet_qs"))).alias("fleet_evt"))
    own = slopes(df).where(F.col("plant") == roles["degrading"]).agg(F.max("slope").alias("slope"))
    series = compacted(df.where(F.col("plant") == roles["soiling"]))
    c = autocorrelation(series, lag, lag + 100).agg(F.max("autocorr").alias("autocorr"))
    d = rolling_std_mean(series, window, least).agg(F.max("rolling_std").alias("rolling_std"))
    one = a.crossJoin(b).crossJoin(own).crossJoin(c).crossJoin(d)  # each is one row
    return one.select(
        "slope", true(F.col("slope") < -1e-7).alias("degrading"), "z_pre", "z_post", true(F.col("z_post") < -1).alias("failing"),
        "fleet_pre", "fleet_evt", "z_spread", true((F.col("fleet_evt") < 0.88 * F.col("fleet_pre")) & (F.col("z_spread") < 0.3)).alias("cloud"),
        "autocorr", "rolling_std", (true(F.col("autocorr") > 0.25) | true(F.col("rolling_std") > 0.02)).alias("soiling"),
    )
