"""Steps whose cost or result hung on how many rows a window, a group or an instant has."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestream.operators import quantiles, relational, timeseries
from lodestream.session import Session

CALLS = {"a": "AVG", "n": "COUNT", "s": "SUM", "lo": "MIN", "hi": "MAX", "sd": "STDEV", "h": "HEIGHT"}


@pytest.fixture(scope="module")
def ticks(spark):
    """Times before and after 0, peers, a gap, nulls, two keys."""
    rows = [(k, None if k % 17 == 0 else (k * k * 31) % 900 - 300 + (5000 if k % 50 == 0 else 0), None if k % 11 == 0 else float(k * 7 % 23), "xy"[k % 2]) for k in range(1, 400)]
    return spark.createDataFrame(rows, "id long, _time long, v double, k string").repartition(5, "id")


@pytest.mark.parametrize("width", [1, 7, 100, 100_000])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rolling_merges_cells(ticks, width, keys):
    made = timeseries.rolling(ticks, width, {name: (call, "v") for name, call in CALLS.items()}, partition_by=keys)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, _time BIGINT, v DOUBLE, k VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [tuple(r) for r in ticks.collect()])
    over = f"OVER ({'PARTITION BY k' if keys else ''} ORDER BY _time RANGE BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    wanted = con.execute(f"SELECT id, avg(v) {over}, count(v) {over}, sum(v) {over}, min(v) {over}, max(v) {over}, stddev_samp(v) {over}, max(v) {over} - min(v) {over} FROM t").fetchall()
    tidy = lambda rows: sorted(tuple(None if x is None else round(float(x), 9) for x in r) for r in rows)
    assert tidy(made.select("id", *CALLS).collect()) == tidy(wanted)


def test_rolling_frames_only_grow(spark, ticks):
    s = Session(spark)
    s.register("ticks", ticks)
    df = s.query("SELECT id, round(AVG(v) + SUM(v) / COUNT(*), 3) AS a, STDEV(v) AS sd, FIRST(v) AS f, LAST(v) AS l, DELTA(v) AS d, GRADIENT(v) AS g FROM ticks ROLLING BY 100ms")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "-99" not in text and "unboundedpreceding" in text.lower()
    rows = {r["id"]: r for r in ticks.collect() if r["_time"] is not None}
    got = {r["id"]: r for r in df.collect()}
    assert len(got) == 399
    for k, r in rows.items():
        window = sorted((x for x in rows.values() if r["_time"] - 99 <= x["_time"] <= r["_time"]), key=lambda x: x["_time"])
        firsts, lasts = ({x["v"] for x in window if x["_time"] == window[i]["_time"]} for i in (0, -1))
        assert got[k]["f"] in firsts and got[k]["l"] in lasts
        values = [x["v"] for x in window if x["v"] is not None]
        a = sum(values) / len(values) + sum(values) / len(window) if values else None
        assert got[k]["a"] == (None if a is None else pytest.approx(a, abs=1e-3))


def test_rolling_types(spark):
    df = spark.sql("SELECT id AS _time, cast(id AS DECIMAL(10, 2)) AS d, cast(id AS INT) AS i, cast(id AS STRING) AS s FROM range(50)")
    pairs = {"ad": ("AVG", "d"), "sd": ("SUM", "d"), "ai": ("AVG", "i"), "si": ("SUM", "i"), "ms": ("MAX", "s")}
    plain = {"ad": F.avg("d"), "sd": F.sum("d"), "ai": F.avg("i"), "si": F.sum("i"), "ms": F.max("s")}
    a, b = (timeseries.rolling(df, 7, x).orderBy("_time") for x in (pairs, plain))
    assert [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
    assert a.collect() == b.collect()


def test_rows_of_one_time_come_by_their_place(spark, tmp_path):
    """As in SQL over the file: of rows of one time, arg_min and arg_max take the first."""
    path = str(tmp_path / "ties.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"COPY (SELECT (i * 7919) % 4001 AS id, i // 2000 * 50 AS _time, 'e' || i AS e, CAST((i * 31) % 97 AS DOUBLE) AS v, 1 AS k FROM range(4000) t(i)) TO '{path}'")
    s = Session(spark)
    s.register("ties", spark.read.parquet(path).repartition(1))
    s.register("scanned", spark.read.parquet(path))
    wanted = con.execute(f"SELECT arg_min(e, _time), arg_min(v, _time), arg_max(v, _time), arg_max(v, _time) - arg_min(v, _time) FROM '{path}'").fetchone()
    assert tuple(s.query("SELECT e, FIRST(v) AS f, LAST(v) AS l, DELTA(v) AS d FROM scanned BY 1h").select("e", "f", "l", "d").first()) == wanted
    assert tuple(s.query("SELECT FIRST(e) AS e, FIRST(v) AS f, LAST(v) AS l, DELTA(v) AS d FROM scanned AS x GROUP BY k").select("e", "f", "l", "d").first()) == wanted
    assert {tuple(r) for r in s.query("SELECT FIRST(e) AS e, LAST(v) AS l FROM scanned WHERE _time < 50 ROLLING BY 1h").collect()} == {("e0", 0.0)}
    assert s.query("SELECT *, FIRST(v) AS f FROM scanned ROLLING BY 1h").columns == ["id", "_time", "e", "v", "k", "f"]
    assert tuple(s.query("WITH j AS (SELECT a.v AS v, a._time AS _time FROM scanned AS a JOIN ties AS b ON a.id = b.id) SELECT FIRST(_time) AS n FROM j BY 1h").select("n").first()) == (0,)


@pytest.mark.parametrize("groups", [0, 100])
@pytest.mark.parametrize("order", [" ORDER BY v * 2 DESC, id", ""])
def test_numbers_of_a_large_group_come_by_ranges(spark, monkeypatch, groups, order):
    rows = [(k, None if k % 13 == 0 else "a" if k % 5 else f"g{k % 70}", None if k % 7 == 0 else float(k * 37 % 101)) for k in range(2000)]
    s = Session(spark)
    s.register("t", spark.createDataFrame(rows, "id long, g string, v double").repartition(3))
    monkeypatch.setattr(relational, "STRETCH_ROWS", 50)
    monkeypatch.setattr(relational, "BROADCAST_GROUPS", groups)
    df = s.query(f"SELECT id, g, ROW_NUMBER() OVER (PARTITION BY g{order}) AS rn FROM t")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in text  # no window over the group
    got = sorted((r["g"] or "", r["rn"], r["id"]) for r in df.collect())
    by = {}
    for k, g, v in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
        by.setdefault(g or "", []).append(k)
    wanted = sorted((g, n, k) for g, ids in by.items() for n, k in enumerate(ids, 1))
    assert got == wanted if order else [x[:2] for x in got] == [x[:2] for x in wanted]


def test_quantiles_of_even_ranges(spark):
    """Odd groups: outliers, equal values, infinities, NaN, a null key; counts come by range before any value is dealt out."""
    groups = {"wide": [float(k * k) for k in range(300)] + [1e300, -1e300], "same": [2.5] * 40, "ends": [float("inf"), 1.0, 2.0, float("-inf")], "nan": [float("nan"), 3.0, 1.0], "one": [7.0], None: [float(k % 7) for k in range(50)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    order = lambda v: (v != v, v)
    for percent in (0, 10, 50, 75, 100):
        made = quantiles.grouped_quantile(df, ["g"], "v", percent, "q")
        wanted = {g: sorted(vs, key=order)[int(percent / 100 * (len(vs) - 1) + 0.5)] for g, vs in groups.items()}
        assert {r["g"]: str(r["q"]) for r in made.collect()} == {g: str(v) for g, v in wanted.items()}
    assert "__b" in made._jdf.queryExecution().optimizedPlan().toString().split("percentile_approx")[1]
