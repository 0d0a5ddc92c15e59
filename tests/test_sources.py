"""Workbooks and NetCDF files: round trips and files made by hand."""

import datetime as dt
import struct
import zipfile

import pytest

from sunfleet.sources import netcdf, workbooks


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("UPN_1_01", 45.25, None, 3), ("a <b> & é ", None, 7.5, 4), (None, 1e-7, -2.0, None)], "`Codice UP` string, Latitude double, Longitude double, n int")
    workbooks.write_workbook(df, str(tmp_path / "one.xlsx"))
    schema = "`Codice UP` string, Longitude double, Latitude double, n int, missing string"
    found = workbooks.read_workbooks(spark, str(tmp_path / "*.xlsx"), schema)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("UPN_1_01", None, 45.25, 3, None), ("a <b> & é ", 7.5, None, 4, None), (None, -2.0, 1e-7, None, None)], key=str)
    workbooks.write_workbook(df.limit(0), str(tmp_path / "none.xlsx"))
    assert workbooks.read_workbooks(spark, str(tmp_path / "none.xlsx"), schema).count() == 0
    assert [workbooks.column_number(workbooks.column_name(n) + "9") for n in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


def test_workbook_with_shared_strings(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>code</t></si><si><r><t>A</t></r><r><t>1</t></r></si><si><t>kwp</t></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>12.5</v></c></row><row><c r="C3"><v>n/a</v></c></row></sheetData></worksheet>')
    found = workbooks.read_workbooks(spark, str(tmp_path / "s.xlsx"), "code string, kwp double")
    assert [tuple(r) for r in found.collect()] == [("A1", 12.5), (None, None)]


def test_netcdf_round_trip(spark, tmp_path):
    t = [dt.datetime(2019, 3, 1, h) for h in range(5)]
    rows = [(p, t[i], 44.0 + p, 7.5, None if (p + i) % 4 == 0 else p * 10.0 + i, float(i)) for p in (2, 5, 9) for i in range(5)]
    df = spark.createDataFrame(rows, "plant int, time timestamp, lat double, lon double, energia double, temp double").repartition(4)
    path = str(tmp_path / "cube.nc")
    netcdf.write_cube(df, path, ["energia", "temp"])
    found = netcdf.read_grid(spark, path, place="plant", places_a_task=2)
    place = {0: 2, 1: 5, 2: 9}
    assert sorted(((place[r.plant], r.time, r.lat, r.lon, r.energia, r.temp) for r in found.collect()), key=str) == sorted(rows, key=str)
    with pytest.raises(ValueError):
        netcdf.write_cube(df.limit(7), path, ["energia"])


def test_netcdf_made_by_hand(spark, tmp_path):
    text = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    units = "days since 2019-01-01"
    head = lambda a, b: (
        b"CDF\x01" + struct.pack(">iii", 0, 10, 2) + text("location") + struct.pack(">i", 2) + text("time") + struct.pack(">i", 3)
        + struct.pack(">ii", 12, 1) + text("title") + struct.pack(">i", 2) + text("weather") + struct.pack(">ii", 11, 2)
        + text("time") + struct.pack(">ii", 1, 1) + struct.pack(">ii", 12, 1) + text("units") + struct.pack(">i", 2) + text(units) + struct.pack(">iii", 4, 12, a)
        + text("temperature_2m") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 12, 1) + text("_FillValue") + struct.pack(">iif", 5, 1, -999.0) + struct.pack(">iii", 5, 24, b)
    )
    n = len(head(0, 0))
    (tmp_path / "w.nc").write_bytes(head(n, n + 12) + struct.pack(">3i", 0, 1, 2) + struct.pack(">6f", 1, 2, -999, 4, 5, 6))
    found = netcdf.read_grid(spark, str(tmp_path / "w.nc"))
    day = lambda d: dt.datetime(2019, 1, 1 + d)
    assert sorted((r.location, r.time, r.temperature_2m or 0.0) for r in found.collect()) == [(0, day(0), 1.0), (0, day(1), 2.0), (0, day(2), 0.0), (1, day(0), 4.0), (1, day(1), 5.0), (1, day(2), 6.0)]
    (tmp_path / "x.nc").write_bytes(b"\x89HDF....")
    with pytest.raises(ValueError):
        netcdf.read_grid(spark, str(tmp_path / "x.nc"))
