"""Null-aware scalar building blocks. A missing number is NULL everywhere; NaN is turned into NULL when data come in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6
EARTH_KM = 6371.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """All NaN in float and double columns as NULL."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names}) if names else df


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """x within [low, high]; NULL stays NULL, unlike in greatest() and least()."""
    x = col(x)
    y = x if low is None else F.greatest(x, F.lit(float(low)))
    y = y if high is None else F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def fill(x: Column | str, value: float) -> Column:
    return F.coalesce(col(x), F.lit(float(value)))


def true(x: Column) -> Column:
    """A condition with NULL as false."""
    return F.coalesce(x, F.lit(False))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def degrees_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Euclidean distance in degrees."""
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2))


def digitize(x: Column | str, edges: Sequence[float]) -> Column:
    """How many ascending edges are not over x (a value on an edge belongs to the bin above it)."""
    x = col(x)
    return F.when(x.isNotNull(), sum(((x >= F.lit(float(e))).cast("int") for e in edges), F.lit(0)))


def bucket(x: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of x's bin; one label more than edges."""
    return F.element_at(F.array(*[F.lit(v) for v in labels]), digitize(x, edges) + 1)


def linspace(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * F.lit((high - low) / (n - 1)))


def softmax_top(scores: Column | str) -> Column:
    """struct<class (from 0), confidence> of the largest softmax share of an array of scores."""
    scores = col(scores)
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("class"), (1.0 / total).alias("confidence"))


def array_mean(x: Column | str) -> Column:
    x = col(x)
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.nullif(F.size(x), F.lit(0))


def array_stats(x: Column | str) -> Column:
    """struct<mean, max, std (population), positive (share above 0)> of an array of numbers."""
    x = F.transform(col(x), lambda v: v.cast("double"))
    n = F.nullif(F.size(x), F.lit(0))
    mean = array_mean(x)
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / n
    return F.struct(
        mean.alias("mean"),
        F.array_max(x).alias("max"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"),
        (F.size(F.filter(x, lambda v: v > 0)) / n).alias("positive"),
    )


def pad_left(x: Column | str, n: int) -> Column:
    """The last n values, with the mean of x put before them where they are fewer; 0.5 for missing values."""
    x = F.transform(col(x), lambda v: v.cast("double"))
    mean = F.coalesce(array_mean(F.filter(x, lambda v: v.isNotNull())), F.lit(0.5))
    last = F.when(F.size(x) > n, F.slice(x, -n, n)).otherwise(x)
    return F.transform(F.concat(F.array_repeat(mean, F.greatest(F.lit(n) - F.size(x), F.lit(0))), last), lambda v: F.coalesce(v, F.lit(0.5)))


def patches(x: Column | str, size: int = 4, stride: int = 2, length: int = 24) -> Column:
    """Overlapping pieces of an array of `length` values."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - size), F.lit(stride)), lambda i: F.slice(col(x), i + 1, F.lit(size)))


def week_ending(t: Column | str) -> Column:
    """The Sunday that ends t's week (Monday to Sunday), as a date."""
    return F.date_add(F.date_trunc("week", col(t)).cast("date"), 6)


def bar(x: Column | str, scale: int = 50) -> Column:
    """A bar of # for a share."""
    return F.repeat(F.lit("#"), F.floor(col(x) * scale).cast("int"))


def dilation(length: Column | str, kernel: Column | str, draw: Column | str) -> Column:
    """2**floor(draw * log2((length - 1) / (kernel - 1))): a kernel's step for a uniform draw."""
    return F.pow(F.lit(2.0), F.floor(col(draw) * F.log2((col(length) - 1) / (col(kernel) - 1)))).cast("int")
