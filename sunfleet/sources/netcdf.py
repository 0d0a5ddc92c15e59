"""Classic NetCDF files (versions 1 and 2): grids read slice by slice on executors, cubes written as one file.

The header is read on the driver; each task then reads the slices of its own places from the file, which all executors must
reach. Files of version 4 are HDF5 and are not read.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfleet.functions.scalar import nan_to_null

# Tags of the header's lists, and the numbers of types with their big-endian forms.
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


@dataclass
class Variable:
    dims: list[str]
    kind: str
    begin: int
    shape: tuple[int, ...]
    attributes: dict = field(default_factory=dict)

    def part(self, source, first: int, n: int) -> np.ndarray:
        """Rows `first` to first + n - 1 along the first dimension."""
        row = int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.kind).itemsize
        source.seek(self.begin + first * row)
        return np.frombuffer(source.read(n * row), self.kind).reshape(n, *self.shape[1:])

    def all(self, source) -> np.ndarray:
        return self.part(source, 0, self.shape[0]) if self.shape else self.part(source, 0, 1)


def _open(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def header(path: str) -> dict[str, Variable]:
    """The variables of a file; ValueError for another format and for variables along an unlimited dimension."""
    with _open(path) as source:
        magic = source.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError(f"{path}: not a classic NetCDF file")
        wide = magic[3] == 2
        number = lambda: struct.unpack(">i", source.read(4))[0]
        padded = lambda n: source.read(-(-n // 4) * 4)[:n]
        name = lambda: padded(number()).decode()
        number()  # of records

        def listed(tag: int, each) -> list:
            found, n = number(), number()
            if found not in (tag, 0):
                raise ValueError(f"{path}: a broken header")
            return [each() for _ in range(n)]

        def attribute():
            key, kind, n = name(), number(), number()
            raw = padded(n * np.dtype(_TYPES[kind]).itemsize)
            return key, raw.decode() if kind == 2 else np.frombuffer(raw, _TYPES[kind]).tolist()

        dims = listed(_DIMENSIONS, lambda: (name(), number()))
        listed(_ATTRIBUTES, attribute)

        def variable():
            key = name()
            own = [dims[number()] for _ in range(number())]
            attributes = dict(listed(_ATTRIBUTES, attribute))
            kind, _ = number(), number()
            begin = struct.unpack(">q", source.read(8))[0] if wide else number()
            if any(size == 0 for _, size in own):
                raise ValueError(f"{path}: {key} has an unlimited dimension")
            return key, Variable([d for d, _ in own], _TYPES[kind], begin, tuple(size for _, size in own), attributes)

        return dict(listed(_VARIABLES, variable))


def times_of(variable: Variable, values: np.ndarray) -> list[dt.datetime]:
    """Times of values in "<unit> since <time>"."""
    unit, _, start = str(variable.attributes["units"]).partition(" since ")
    base = dt.datetime.fromisoformat(start.strip().replace("Z", ""))
    return [base + dt.timedelta(seconds=float(v) * _UNITS[unit.strip()]) for v in values.tolist()]


def read_grid(spark: SparkSession, path: str, place: str = "location", time: str = "time", places_a_task: int = 64) -> DataFrame:
    """place (its number), time, one column for each variable over (place), as lat and lon, and over (place, time). Missing
    values (_FillValue, NaN) are NULL."""
    found = header(path)
    with _open(path) as source:
        at = times_of(found[time], found[time].all(source))
    grids = {k: v for k, v in found.items() if v.dims == [place, time]}
    fixed = {k: v for k, v in found.items() if v.dims == [place] and k != place}
    n = next(v.shape[0] for v in [*grids.values(), *fixed.values()])
    columns = [*fixed, *grids]
    schema = f"`{place}` int, __at int, " + ", ".join(f"`{c}` double" for c in columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def clean(v: Variable, x: np.ndarray) -> np.ndarray:
            x = x.astype(float)
            for missing in (v.attributes.get("_FillValue") or [])[:1]:
                x[x == missing] = np.nan
            return x

        with _open(path) as source:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    size = len(at)
                    values = [np.repeat(clean(v, v.part(source, i, 1)), size) for v in fixed.values()] + [clean(v, v.part(source, i, 1))[0] for v in grids.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, i, np.int32)), pa.array(np.arange(size, dtype=np.int32)), *[pa.array(v) for v in values]], [place, "__at", *columns])

    rows = spark.range(0, n, 1, max(1, -(-n // places_a_task))).mapInArrow(read, schema)
    numbered = spark.createDataFrame(list(enumerate(at)), f"__at int, `{time}` timestamp")
    return nan_to_null(rows.join(F.broadcast(numbered), "__at").select(place, time, *columns))


def write_cube(df: DataFrame, path: str, variables: list[str], fixed: tuple[str, ...] = ("lat", "lon"), key: str = "plant", time: str = "time") -> None:
    """One local file with dimensions (key, time), for tools that want one: df must have each key at each time. The driver
    streams the values, a variable after the other, and holds one batch of rows; NULLs are NaN."""
    keys = [r[0] for r in df.select(key).distinct().orderBy(key).toLocalIterator()]
    at = [r[0] for r in df.select(time).distinct().orderBy(time).toLocalIterator()]
    if df.count() != len(keys) * len(at):
        raise ValueError("each key must be there once at each time")
    hours = np.array([(t - at[0]).total_seconds() / 3600 for t in at], ">f8") if at else np.zeros(0, ">f8")
    text = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    units = f"hours since {at[0].isoformat(' ')}" if at else "hours since 2000-01-01"
    shapes = {key: ([0], 4, len(keys)), time: ([1], 6, len(at)), **{f: ([0], 6, len(keys)) for f in fixed}, **{v: ([0, 1], 6, len(keys) * len(at)) for v in variables}}

    def head(begins: dict[str, int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">iii", 0, _DIMENSIONS, 2) + text(key) + struct.pack(">i", len(keys)) + text(time) + struct.pack(">i", len(at))
        out += struct.pack(">iiii", 0, 0, _VARIABLES, len(shapes))
        for name, (dims, kind, n) in shapes.items():
            out += text(name) + struct.pack(f">i{len(dims)}i", len(dims), *dims)
            out += struct.pack(">ii", _ATTRIBUTES, 1) + text("units") + struct.pack(">i", 2) + text(units) if name == time else struct.pack(">ii", 0, 0)
            out += struct.pack(">iiq", kind, min(n * (4 if kind == 4 else 8), 2**31 - 4), begins[name])
        return out

    begins, offset = {}, len(head(dict.fromkeys(shapes, 0)))
    for name, (_, kind, n) in shapes.items():
        begins[name] = offset
        offset += -(-n * (4 if kind == 4 else 8) // 8) * 8
    with open(path, "wb") as out:
        out.write(head(begins))

        def put(name: str, chunks) -> None:
            out.seek(begins[name])
            for chunk in chunks:
                out.write(chunk.tobytes())

        def streamed(rows: DataFrame):
            held = []
            for row in rows.toLocalIterator():
                held.append(np.nan if row[0] is None else row[0])
                if len(held) == 65536:
                    yield np.array(held, ">f8")
                    held = []
            yield np.array(held, ">f8")

        put(key, [np.array(keys, ">i4")])
        put(time, [hours])
        for name in fixed:
            put(name, streamed(df.groupBy(key).agg(F.max(name).alias("v")).orderBy(key).select("v")))
        for name in variables:
            put(name, streamed(df.orderBy(key, time).select(F.col(name).cast("double"))))
        out.truncate(offset)
