import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, norm

FOLDER = "/root/testdata/sf0.001"
QUICK = ["nation_drought_bands", "site_index", "stress_maps", "rolling_windows", "station_anomalies", "nearest_station", "radius_neighbours",
         "point_in_polygon", "bilinear_resample", "idw_sites", "plant_dispatch", "graph_filter", "fact_sales", "validation_report", "component_ablation"]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("FULL") else QUICK


def test_entry_and_keys(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = contract.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    cur = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_dates_outside_the_calendar_are_orphans(spark):
    """The calendar of the check ends before the data does, else no date could be missing from it."""
    n = {r["check_name"]: r["n"] for r in contract.queries()["referential_integrity"](spark, FOLDER).collect()}
    want = duckdb.connect().execute(f"SELECT count(*) FROM '{FOLDER}/lineitem.parquet' WHERE year(l_shipdate) <> 1998").fetchall()
    assert n["dates"] == want[0][0] > 0


def test_monthly_series_round_as_sql_does(spark, tmp_path):
    """A mean of 20.275 is a little less as a double: SQL shows 20.27."""
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"COPY (SELECT * FROM '{FOLDER}/{t}.parquet' LIMIT 1) TO '{tmp_path}/{t}.parquet'")
    con.execute(f"""COPY (SELECT * REPLACE((SELECT min(s_suppkey) FROM '{tmp_path}/supplier.parquet') AS l_suppkey, 20e0 + (i < 11)::INT AS l_quantity)
        FROM (SELECT * FROM '{FOLDER}/lineitem.parquet' LIMIT 1), range(40) x(i)) TO '{tmp_path}/lineitem.parquet'""")
    con.execute(f"""COPY (SELECT * REPLACE((SELECT min(s_suppkey) FROM '{tmp_path}/supplier.parquet') AS c_custkey) FROM '{tmp_path}/customer.parquet') TO '{tmp_path}/c.parquet'""")
    con.execute(f"COPY (SELECT * FROM '{tmp_path}/c.parquet') TO '{tmp_path}/customer.parquet'")
    for t in ("customer", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(contract.oracle_sql()["point_monthly_series"]).fetchall()
    assert [tuple(r) for r in contract.queries()["point_monthly_series"](spark, str(tmp_path)).collect()] == want and want[0][-1] == "20.27"
