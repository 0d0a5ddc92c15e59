"""File sources and sinks: plant readings, registries, weather, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfleet.functions.scalar import nan_to_null

READING = "date STRING, ENERGIA DOUBLE"
TIME_FORMAT = "dd/MM/yy HH:mm"


def _exists(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found) if found else []


def upn_of(name: Column | str) -> Column:
    """UPN_<third token>_01 of a name like 2019_UPN_0123_01.csv."""
    name = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lit("UPN_"), F.split_part(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.lit(3)), F.lit("_01"))


def upn_in(name: Column | str) -> Column:
    """The first UPN_<digits>_<digits> in a name, NULL without one."""
    name = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.regexp_extract(name, r"(UPN_\d+_\d+)", 1), F.lit(""))


def _century(t: Column) -> Column:
    """Two-digit years from 69 on are of the last century."""
    return F.when(F.year(t) >= 2069, F.add_months(t.cast("date"), -1200).cast("timestamp") + F.make_interval(hours=F.hour(t), mins=F.minute(t))).otherwise(t)


def strict_time(c: Column | str) -> Column:
    """dd/MM/yy HH:mm; a value of another form is an error."""
    return _century(F.to_timestamp(c, TIME_FORMAT))


def lenient_time(c: Column | str) -> Column:
    """dd/MM/yy HH:mm; NULL for a value of another form."""
    return _century(F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(TIME_FORMAT)))


def read_readings(spark: SparkSession, folder: str, year: int, upns: list[str] | None = None, most_files: int | None = None, strict: bool = False) -> DataFrame:
    """upn, time, energia of all files <year>_UPN_*.csv; FileNotFoundError without any.

    A file with a time of another form is left out whole (an error with strict), as are unreadable files; ValueError if
    nothing is left. most_files takes the first so many names.
    """
    paths = _exists(spark, f"{folder}/{year}_UPN_*.csv")
    if not paths:
        raise FileNotFoundError(f"{folder}: no {year}_UPN_*.csv")
    paths = paths[:most_files]
    raw = spark.read.schema(READING).option("header", True).option("ignoreCorruptFiles", True).csv(paths)
    rows = raw.select(F.col("_metadata.file_name").alias("file"), "date", F.col("ENERGIA").alias("energia"))
    if strict:
        rows = rows.withColumn("time", strict_time("date"))
    else:
        rows = rows.withColumn("time", lenient_time("date"))
        bad = rows.where("time IS NULL").select("file").distinct()
        rows = rows.join(bad, "file", "left_anti")
    out = nan_to_null(rows.select(upn_of("file").alias("upn"), "time", "energia"))
    out = out.where(F.col("upn").isin(upns)) if upns is not None else out
    if out.isEmpty():
        raise ValueError(f"{folder}: no readable file")
    return out


def skipped_files(spark: SparkSession, folder: str, year: int) -> DataFrame:
    """file, n_rows, n_bad: the files that read_readings() leaves out, with their rows and those with a time of another form."""
    paths = _exists(spark, f"{folder}/{year}_UPN_*.csv")
    if not paths:
        raise FileNotFoundError(f"{folder}: no {year}_UPN_*.csv")
    raw = spark.read.schema(READING).option("header", True).option("ignoreCorruptFiles", True).csv(paths).select(F.col("_metadata.file_name").alias("file"), lenient_time("date").alias("time"))
    return raw.groupBy("file").agg(F.count("*").alias("n_rows"), F.count_if(F.col("time").isNull()).alias("n_bad")).where("n_bad > 0")


def read_table(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV registry with a header; only `columns` are parsed."""
    df = nan_to_null(spark.read.schema(schema).option("header", True).csv(path))
    return df.select(*columns) if columns else df


def explode_weather(df: DataFrame, optional: tuple[str, ...] = ("cloud_cover", "shortwave_radiation")) -> DataFrame:
    """location, lat, lon, time, variables: one row for each time of rows that hold arrays; optional variables that are not
    there are NULL."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    out = df.select("location", "lat", "lon", F.explode(F.arrays_zip(*arrays)).alias("r")).select("location", "lat", "lon", *[F.col(f"r.{a}").alias(a) for a in arrays])
    return nan_to_null(out.withColumns({o: F.lit(None).cast("double") for o in optional if o not in arrays}))


def read_weather(spark: SparkSession, *paths: str) -> DataFrame:
    """Weather as Parquet, of several years together; columns that a file lacks are NULL."""
    out = None
    for path in paths:
        df = nan_to_null(spark.read.parquet(path))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_cube(df: DataFrame, path: str, by: str = "plant", buckets: int = 64) -> None:
    """Parquet in bounded numbers of folders: a cube's plants are dealt to `buckets`."""
    df.withColumn("bucket", F.pmod(F.hash(by), F.lit(buckets))).repartition("bucket").sortWithinPartitions(by, "time").write.mode("overwrite").partitionBy("bucket").parquet(path)


def metadata(df: DataFrame, source: str = "files", key: str = "plant", time: str = "time") -> DataFrame:
    """One row: source, number of plants and readings, first and last time."""
    return df.agg(F.lit(source).alias("source"), F.count_distinct(key).alias("n_plants"), F.count("*").alias("n_rows"), F.min(time).alias("period_start"), F.max(time).alias("period_end"))


def fallback_weather(df: DataFrame) -> DataFrame:
    """df (plant, time, lat, lon) with poa (clear sky, W/m2), temp and wind of a plain year."""
    import math

    from sunfleet.operators.features import with_geometry

    placed = with_geometry(df)
    temp = 10 + 12 * F.sin(math.pi * (F.dayofyear("time") - 80) / 180)
    return placed.select(*df.columns, (F.col("ghi_cs") * 1000).alias("poa"), temp.alias("temp"), F.lit(3.0).alias("wind"))
