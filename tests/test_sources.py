import datetime
import json
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from territoria.operators import quality
from territoria.sources import readers, sinks
from territoria.streaming import refresh


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_csv_dialects(spark, folder):
    with open(f"{folder}/a.csv", "w") as f:
        f.write("code,geom,n\n01,'LINESTRING(1 2, 3 4)',5\n")
    a = readers.read_csv(spark, f"{folder}/a.csv", "code STRING, geom STRING, n INT", ["code", "geom"], quote="'")
    assert [tuple(r) for r in a.collect()] == [("01", "LINESTRING(1 2, 3 4)")]
    with open(f"{folder}/b.tsv", "wb") as f:
        f.write("nom\tx\nBesançon\t1.5\n".encode("latin-1"))
    b = readers.read_csv(spark, f"{folder}/b.tsv", "nom STRING, x DOUBLE", sep="\t", encoding="ISO-8859-1")
    assert b.head()["nom"] == "Besançon"


def test_pages_union_and_harmonise(spark, folder):
    for i in range(2):
        with open(f"{folder}/p{i}.json", "w") as f:
            json.dump({"data": [{"code": f"0{i}", "v": i}, {"code": "09", "v": None}], "next": None}, f, indent=1)
    p = readers.read_pages(spark, f"{folder}/p*.json", "STRUCT<code: STRING, v: DOUBLE>")
    assert p.count() == 4 and p.where("v IS NULL").count() == 2
    a = spark.createDataFrame([(1, "x")], "ID int, Name string")
    u = readers.union_lower([a, spark.createDataFrame([(2,)], "id int")])
    assert sorted(map(tuple, u.collect())) == [(1, "x"), (2, None)]
    h = readers.harmonise(spark.createDataFrame([(1, 2.0, float("nan"), 9)], "valid_time int, latitude double, TP double, number int"), ["time", "lat", "tp"])
    assert tuple(h.head()) == (1, 2.0, None)


def test_cache_and_fallback(spark, folder):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert readers.cached(spark, f"{folder}/c", build).count() == 3
    assert readers.cached(spark, f"{folder}/c", build).count() == 3 and len(calls) == 1
    spark.range(0).write.parquet(f"{folder}/empty")
    assert readers.first_available(spark, [f"{folder}/none", f"{folder}/empty", f"{folder}/c"]).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.first_available(spark, [f"{folder}/none"])


def test_polygon_source_keeps_one_row_per_id(spark):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in ((0, 0), (2, 0), (2, 1))])
    df = spark.createDataFrame([(1, "FRA"), (1, "FRA"), (2, "ESP")], "gid int, gid_0 string").withColumn("ring", ring)
    p = readers.polygons(df, "gid", F.col("gid_0") == "FRA").collect()
    assert len(p) == 1 and (p[0]["west"], p[0]["north"], p[0]["area"]) == (0.0, 1.0, 1.0)


def test_sinks(spark, folder):
    df = spark.createDataFrame([(2, 0, 1.5, None), (1, 1, None, 2.5)], "ix int, iy int, v double, w double").withColumn("month", F.lit("2022-07-01").cast("date"))
    sinks.write_csv(df, f"{folder}/csv", ["iy", "ix"], ["ix"])
    back = spark.read.option("header", True).csv(f"{folder}/csv")
    assert back.columns == ["iy", "ix"] and back.count() == 2
    sinks.write_cube(df, f"{folder}/cube", "5km", "month", ["v", "w"])
    cube = spark.read.parquet(f"{folder}/cube")
    assert cube.where("grid = '5km' AND year = 2022 AND v = -9999").count() == 1 and dict(cube.dtypes)["v"] == "float"
    sinks.write_geojson(df, f"{folder}/geo", "v", "w", ["ix"])
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{folder}/geo").collect()]
    assert {ln["properties"]["ix"] for ln in lines} == {1, 2} and lines[0]["geometry"]["type"] == "Point"
    checks = quality.expect(df, [quality.Rule("rows", F.count(F.lit(1)), lambda v: v == 2, 2.0, "rows")])
    sinks.write_report(checks, f"{folder}/report")
    text = [r["value"] for r in spark.read.text(f"{folder}/report").collect()]
    assert text[-1] == "1/1 checks passed" and text[0].startswith("[PASS] rows")


def test_stream_equals_batch_and_ignores_replays(spark, folder):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "value")
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, value DOUBLE"
    for part in (ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1").unionByName(ev.limit(50)), ev.where("event_id % 5 = 0")):
        part.write.mode("append").parquet(f"{folder}/landed")
        for _ in range(2):
            refresh.refresh(refresh.landed(spark, f"{folder}/landed", schema), f"{folder}/readings", f"{folder}/ck").awaitTermination()
    stored = refresh.readings_of(spark, f"{folder}/readings", "user_id", "event_id")
    assert stored.count() == ev.count()
    got = refresh.monthly_batch(stored, "user_id", "event_id", "ts", "value")
    want = refresh.monthly_batch(ev, "user_id", "event_id", "ts", "value")
    a = {(r["user_id"], r["month"]): (round(r["mean"], 9), r["n"]) for r in got.collect()}
    assert a == {(r["user_id"], r["month"]): (round(r["mean"], 9), r["n"]) for r in want.collect()}


def test_means_grow_by_keys(spark, folder):
    """Replays of any age, within a batch and across batches, null values, ids and dates; a batch that runs again changes nothing."""
    schema = "station long, rid long, ts timestamp_ntz, value double"
    day = lambda m, d: datetime.datetime(2001, m, d, 5)
    parts = [
        [(1, 1, day(1, 3), 2.0), (1, 2, day(1, 9), 4.0), (1, 2, day(1, 9), 4.0), (2, 1, day(1, 1), None), (None, None, day(2, 1), 7.0)],
        [(1, 2, day(1, 9), 4.0), (1, 3, day(1, 30), 9.0), (1, 4, day(2, 1), 1.0), (None, None, day(2, 1), 7.0), (3, 1, None, 5.0)],
        [(1, 1, day(1, 3), 2.0), (2, 2, day(1, 2), 3.0)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        refresh.refresh_means(refresh.landed(spark, f"{folder}/in", schema), f"{folder}/out", f"{folder}/ck", "station", "rid", "ts", "value").awaitTermination()
        refresh.refresh_means(refresh.landed(spark, f"{folder}/in", schema), f"{folder}/out", f"{folder}/ck", "station", "rid", "ts", "value").awaitTermination()
    got = {(r["station"], r["month"].month): (r["mean"], r["n"]) for r in refresh.monthly_means(spark, f"{folder}/out").collect()}
    want = {(1, 1): (5.0, 3), (1, 2): (1.0, 1), (2, 1): (3.0, 1), (None, 2): (7.0, 1)}
    assert got == want
    # As after a failure between the writes of batch 2 and its commit.
    shutil.copytree(f"{folder}/ck", f"{folder}/ck2", ignore=lambda where, names: {"2", ".2.crc"} & set(names) if where.endswith("commits") else set())
    refresh.refresh_means(refresh.landed(spark, f"{folder}/in", schema), f"{folder}/out", f"{folder}/ck2", "station", "rid", "ts", "value").awaitTermination()
    assert {(r["station"], r["month"].month): (r["mean"], r["n"]) for r in refresh.monthly_means(spark, f"{folder}/out").collect()} == want
