"""Streams: scores over batches, restarts and late rows."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sunfleet.operators import quality
from sunfleet.streaming import monitor

SCHEMA = "plant int, t_idx int, time timestamp, energia double, poa double, temp double"


def test_scores_of_a_stream_are_those_of_the_cube(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = dt.datetime(2023, 1, 1)
    rows = [(p, t, base + dt.timedelta(hours=t), None if rng.random() < 0.1 else float(rng.random() * 5), float(rng.integers(0, 900)) if t % 5 else 0.0, 20.0) for p in range(3) for t in range(160)]
    cube = spark.createDataFrame(rows, SCHEMA)
    scales = quality.plant_scales(cube).cache()
    stream = lambda: monitor.read_stream(spark, str(tmp_path / "in"), SCHEMA)
    done = []
    for lo, hi in ((0, 70), (70, 75), (75, 160)):  # each run goes on where the one before it ended
        cube.where(F.col("t_idx").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        monitor.score_stream(stream(), scales, str(tmp_path / "out"), str(tmp_path / "check"), 48, 10)
        done.append(spark.read.parquet(str(tmp_path / "out/scores")).count())
    assert done == [210, 225, 480]
    expect = {(r.plant, r.t_idx): (r.m1, r.m3, r.qs) for r in quality.quality(cube, 48, 10, scales=scales).collect()}
    found = {(r.plant, r.t_idx): (r.m1, r.m3, r.qs) for r in spark.read.parquet(str(tmp_path / "out/scores")).collect()}
    assert set(found) == set(expect) and any(x[2] is not None for x in found.values())
    for key, values in expect.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-6) for a, b in zip(values, found[key], strict=True)), key
    own = {(r.plant, r.t_idx): r.qs for r in quality.quality(cube, 48, 10).collect()}
    assert all((own[k] is None) == (v[2] is None) and (own[k] is None or abs(own[k] - v[2]) < 1e-9) for k, v in expect.items())


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda h: dt.datetime(2023, 1, 1, h)
    for k, rows in enumerate([[(1, at(1), 1.0), (1, at(12), 2.0)], [(1, at(2), 9.0), (1, at(13), 3.0)], [(1, at(20), 4.0)]]):
        spark.createDataFrame(rows, "plant int, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        medians = monitor.hourly_medians(monitor.read_stream(spark, str(tmp_path / "in"), "plant int, ts timestamp, value double"))
        monitor.run_available(medians, str(tmp_path / "check"), lambda batch, k: batch.write.mode("append").parquet(str(tmp_path / "out")))
    found = {r.time.hour: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found[1] == 1.0 and 2 not in found and found[12] == 2.0
