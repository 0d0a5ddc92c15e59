"""Alignment: duplicate readings, the common time grid, spatial and temporal nearest joins, plant registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunfleet.functions.scalar import degrees_apart


def median_readings(df: DataFrame, keys: list[str], value: str, out: str | None = None) -> DataFrame:
    """One row per key with the median of its readings; missing readings are not counted."""
    return df.groupBy(*keys).agg(F.median(value).alias(out or value))


def time_index(df: DataFrame, time: str = "time") -> DataFrame:
    """time, t_idx: all distinct times in order, from 0. Only the distinct times are in the one sorted partition."""
    times = df.select(time).where(F.col(time).isNotNull()).distinct()
    return times.withColumn("t_idx", (F.row_number().over(Window.orderBy(time)) - 1).cast("int"))


def densify(obs: DataFrame, key: str = "plant", time: str = "time") -> DataFrame:
    """Each key on the grid of all keys' times; cells without a reading are NULL. Readings without a time are in no cell.

    The number of times is the length of the series, so they are broadcast. A reading brings the empty cells up to the key's
    next one with it, so that the grid is made where the key's readings are: it isn't shuffled or joined, and all that
    goes on by key works where it stands.
    """
    values = [c for c in obs.columns if c not in (key, time)]
    times = time_index(obs, time)
    size = F.broadcast(times.agg(F.count("*").cast("int").alias("__size")))
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("__at"))
    placed = obs.join(F.broadcast(times.withColumnRenamed("t_idx", "__at")), time, "left").select(key, "__at", *values).crossJoin(size)
    ends = placed.withColumns({"__n": F.row_number().over(order), "__next": F.lead("__at").over(order)})
    # a key none of whose readings has a time still has its cells
    kept = ends.where((F.col("__n") == 1) | F.col("__at").isNotNull())
    begin = F.when(F.col("__n") == 1, F.lit(0)).otherwise(F.col("__at"))
    last = F.greatest(F.coalesce("__next", F.col("__size")) - 1, F.coalesce("__at", F.lit(0)))
    cells = kept.where("__size > 0").select(key, "__at", *values, F.explode(F.sequence(begin, last)).alias("t_idx"))
    here = F.col("t_idx") == F.col("__at")
    return cells.join(F.broadcast(times), "t_idx").select(key, time, "t_idx", *[F.when(here, F.col(v)).alias(v) for v in values])


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], parts: int = 32) -> DataFrame:
    """For each row of left the row of right of the same key that is nearest in time; of two equally near the later one.

    One union and two running windows: the last and the next right-hand row are carried over the ordered times. A key's rows
    are cut at `parts` times, and what comes before and after a part is carried over from its neighbours, so that a
    key with many rows is not one task. Rows without a time match nothing.
    """
    own = [c for c in left.columns if c not in (key, time)]
    a = left.select(key, time, F.lit(1).alias("__side"), F.struct(*own, F.lit(0)).alias("__own"), F.lit(None).cast(right.schema[time].dataType).alias("__t"), *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    b = right.select(key, time, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__own"].dataType).alias("__own"), F.col(time).alias("__t"), *values).where(F.col(time).isNotNull())
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    span = b.agg(F.min(micros(F.col(time))).alias("__lo"), F.max(micros(F.col(time))).alias("__hi"))
    share = (micros(F.col(time)) - F.col("__lo")).cast("double") / (F.col("__hi") - F.col("__lo") + 1).cast("double")
    hit = F.when(F.col("__side") == 0, F.struct(F.col("__t").alias("t"), *values))
    rows = a.unionByName(b).crossJoin(F.broadcast(span)).withColumn("__part", F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts).cast("int")))).drop("__lo", "__hi").withColumn("__hit", hit)
    order = Window.partitionBy(key, "__part")
    # rows of equal time stand before their left rows, so "at or before" has them; the next one is strictly later
    before = F.last("__hit", ignorenulls=True).over(order.orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__hit", ignorenulls=True).over(order.orderBy(F.desc(time), F.desc("__side")).rowsBetween(Window.unboundedPreceding, -1))
    edges = rows.where("__side = 0").groupBy(key, "__part").agg(F.min_by("__hit", time).alias("__first"), F.max_by("__hit", time).alias("__last"))
    every = edges.select(key).distinct().crossJoin(F.broadcast(left.sparkSession.range(parts).select(F.col("id").cast("int").alias("__part")))).join(edges, [key, "__part"], "left")
    by_part = Window.partitionBy(key).orderBy("__part")
    carried = every.select(
        key, "__part", F.last("__last", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"),
        F.last("__first", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)).alias("__later"),
    )
    both = rows.withColumns({"__before": before, "__after": after}).where("__side = 1").join(carried, [key, "__part"], "left")
    timed = F.col(time).isNotNull()
    both = both.withColumns({"__before": F.when(timed, F.coalesce("__before", "__earlier")), "__after": F.when(timed, F.coalesce("__after", "__later"))})
    now = micros(F.col(time))
    later = F.col("__before").isNull() | (F.col("__after").isNotNull() & (micros(F.col("__after.t")) - now <= now - micros(F.col("__before.t"))))
    out = both.withColumn("__found", F.when(later, F.col("__after")).otherwise(F.col("__before")))
    return out.select(key, time, *[F.col(f"__own.{c}").alias(c) for c in own], F.col("__found.t").alias("matched"), *[F.col(f"__found.{v}").alias(v) for v in values])


def nearest_site(points: DataFrame, sites: DataFrame, point: str = "plant", site: str = "location", cell: float = 0.25) -> DataFrame:
    """point, site, dist_deg: the site of the smallest Euclidean distance in degrees, of equally near ones the lowest id.

    Sites are looked up in square cells around the point, in rings that grow fourfold until the best one found is nearer than
    anything outside the ring can be; points with a NULL coordinate have no match.
    """
    place = lambda c: F.floor(F.col(c) / cell)
    sites = sites.where("lat IS NOT NULL AND lon IS NOT NULL").select(site, F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), place("lat").alias("cx"), place("lon").alias("cy")).persist()
    left = points.select(point, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), place("lat").alias("px"), place("lon").alias("py"))
    out = left.where("p_lat IS NULL OR p_lon IS NULL").select(point, F.lit(None).cast(sites.schema[site].dataType).alias(site), F.lit(None).cast("double").alias("dist_deg"))
    left = left.where("p_lat IS NOT NULL AND p_lon IS NOT NULL")
    span = sites.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy"), F.count("*")).first()
    if not span[4]:
        return out.unionByName(left.select(point, F.lit(None).cast(sites.schema[site].dataType).alias(site), F.lit(None).cast("double").alias("dist_deg")))
    ring = 1
    while True:
        # coarser cells of the ring's width: the point's own and the eight around it hold all within the ring
        wide = sites.withColumns({"gx": F.floor(F.col("cx") / ring), "gy": F.floor(F.col("cy") / ring)})
        around = F.sequence(F.lit(-1), F.lit(1))
        probes = left.withColumn("gx", F.explode(F.transform(around, lambda d: F.floor(F.col("px") / ring) + d))).withColumn("gy", F.explode(F.transform(around, lambda d: F.floor(F.col("py") / ring) + d)))
        apart = degrees_apart(F.col("p_lat"), F.col("p_lon"), F.col("s_lat"), F.col("s_lon"))
        best = probes.join(wide, ["gx", "gy"]).groupBy(point).agg(F.min(F.struct(apart.alias("d"), F.col(site).alias("s"))).alias("b")).persist()
        extent = left.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
        everything = extent[0] is None or max(abs(extent[1] - span[0]), abs(span[1] - extent[0]), abs(extent[3] - span[2]), abs(span[3] - extent[2])) < ring
        sure = best if everything else best.where(F.col("b.d") <= ring * cell)
        out = out.unionByName(sure.select(point, F.col("b.s").alias(site), F.col("b.d").alias("dist_deg")))
        if everything:
            return out
        # kept, as the next round reads it several times: plans would double with each round
        left = left.join(sure.select(point), point, "left_anti").persist()
        ring *= 4


def same_place(points: DataFrame, sites: DataFrame, digits: int | None = None) -> DataFrame:
    """points with the columns of the sites at the very same lat and lon, or at the same ones rounded half-even to `digits`
    places; NULLs where there is none, several rows where there are several. Rounded is the binary product with the power of ten,
    as by pandas and DuckDB's round_even: bround() takes a number's shortest digits, which can be a tie that the product isn't."""
    near = lambda c: c if digits is None else F.rint(c.cast("double") * 10.0**digits) / 10.0**digits
    own = sites.withColumnsRenamed({"lat": "__lat", "lon": "__lon"})
    return points.join(own, (near(F.col("lat")) == near(F.col("__lat"))) & (near(F.col("lon")) == near(F.col("__lon"))), "left").drop("__lat", "__lon")


def without_match(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df that have none in other."""
    return df.join(other.select(*on), on, "left_anti")


def first_per_key(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """One row per key, the first by `order`."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def coordinates(plants: DataFrame, mapping: DataFrame, energy: DataFrame, key: str = "upn", order: str = "line") -> DataFrame:
    """plants with lat, lon, eta_base and plant_id: of the mapping file the last row of a key counts, of the energy file the
    first complete one, and only for keys without mapped coordinates; lat and lon come from one file. eta_base is 0.15 and
    plant_id the load order where nothing is stated."""
    last = first_per_key(mapping.where(F.col(key).isNotNull()), key, F.col(order).desc()).select(key, F.col("lat").alias("m_lat"), F.col("lon").alias("m_lon"), F.col("eta_base").alias("m_eta"), F.col("plant_id").alias("m_id"))
    known = energy.where(F.col(key).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    first = first_per_key(known, key, F.col(order).asc()).select(key, F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon"))
    joined = plants.join(last, key, "left").join(first, key, "left")
    mapped = F.col("m_lat").isNotNull() & F.col("m_lon").isNotNull()
    numbered = F.row_number().over(Window.orderBy(key)) - 1
    return joined.select(
        *plants.columns,
        F.when(mapped, F.col("m_lat")).otherwise(F.col("e_lat")).alias("lat"),
        F.when(mapped, F.col("m_lon")).otherwise(F.col("e_lon")).alias("lon"),
        F.coalesce("m_eta", F.lit(0.15)).alias("eta_base"),
        F.coalesce(F.col("m_id").cast("int"), numbered.cast("int")).alias("plant_id"),
    )


def kwp_by_plant(mapping: DataFrame, coords: DataFrame, n: int, order: str = "line") -> DataFrame:
    """plant_id 0 to n - 1 with kwp: mapping joined with the registry code's peak power; ids outside of the range and missing
    powers are dropped, of several the last counts, NULL where none is left."""
    joined = mapping.join(coords.select("code", "kwp"), "code", "left").where(F.col("plant_id").between(0, n - 1) & F.col("kwp").isNotNull())
    last = joined.groupBy(F.col("plant_id").cast("long").alias("plant_id")).agg(F.max_by("kwp", F.struct(order, "kwp")).alias("kwp"))
    return mapping.sparkSession.range(n).withColumnRenamed("id", "plant_id").join(last, "plant_id", "left")
