"""Golden tests of the dialect on small hand-made tables."""

import pytest

from lodestream.operators import graph, relational, slices, vectors
from lodestream.session import Session
from lodestream.sources import schemas
from lodestream.sources.keyvalue import KeyValueStore
from lodestream.sources.storage import ConstraintError
from lodestream.sql.lexer import SqlError, tokenize


@pytest.fixture()
def session(spark, tmp_path):
    s = Session(spark, str(tmp_path / "store"))
    s.register("v5", spark.createDataFrame([(1000 * k, float(k)) for k in range(1, 6)], "_time long, v double"))
    s.register("a", spark.createDataFrame([(1, 10), (2, 20)], "id int, aval int"))
    s.register("b", spark.createDataFrame([(2, 200), (3, 300)], "id int, bval int"))
    return s


def values(df, *columns):
    return [tuple(r) for r in df.select(*(columns or df.columns)).collect()]


def test_rolling(session):
    assert values(session.query("SELECT AVG(v) AS a FROM v5 ROLLING BY 3s ORDER BY _time")) == [(1.0,), (1.5,), (2.0,), (3.0,), (4.0,)]


def test_by_window_clauses_in_any_order(session):
    assert values(session.query("SELECT SUM(v) AS s FROM v5 BY 2s WHERE v > 1")) and session.query("SELECT SUM(v) AS s FROM v5 BY 2s").agg({"s": "sum"}).first()[0] == 15.0


def test_previous(session):
    assert values(session.query("SELECT v - PREVIOUS.v AS d FROM v5 ORDER BY _time LIMIT 2")) == [(None,), (1.0,)]


def test_outer_joins(session):
    assert sorted(values(session.query("SELECT a.aval, b.bval FROM a LEFT JOIN b ON a.id = b.id"))) == [(10, None), (20, 200)]
    full = values(session.query("SELECT a.id AS x, b.id AS y FROM a FULL JOIN b ON a.id = b.id"))
    assert set(full) == {(1, None), (2, 2), (None, 3)}


def test_union_by_name(session):
    assert set(values(session.query("SELECT 1 AS a UNION ALL SELECT 2 AS b"))) == {(1, None), (None, 2)}
    assert len(values(session.query("SELECT 1 AS a UNION SELECT 1 AS a"))) == 1


def test_string_slices(session):
    q = session.query("SELECT 'abcdefg'[1:4] AS a, 'abcdefg'[:3] AS b, 'foo_bar_baz'[0:10:2] AS c, 'abc'[::-1] AS d, f'{1.0} x' AS e")
    assert values(q) == [("bcd", "abc", "fobrb", "cba", "1 x")]


def test_errors_are_raised(session):
    for bad in ("SELECT v FROM v5 WHERE", "SELECT v FROM v5 WHERE v >", "SELECT nope(v) FROM v5", "SELECT v FROM v5 GROUP BY v BY 1s", "SELECT v FROM v5 HAVING v > 1"):
        with pytest.raises((SqlError, ValueError)):
            session.query(bad)


def test_comments():
    assert [t.text for t in tokenize("SELECT /* a /* b */ c */ 1 -- x\n, '--'")] == ["SELECT", "1", ",", "'--'", ""]


def test_slices_against_sets(spark):
    import random

    rng = random.Random(3)

    def made():
        return [(a := rng.randrange(60), a + rng.randrange(1, 12)) for _ in range(8)]

    for _ in range(3):
        x, y = made(), made()
        points = lambda rows: {p for a, b in rows for p in range(2 * a, 2 * b + 1)}
        fx, fy = slices.merge(slices.manual(spark, x), 7), slices.merge(slices.manual(spark, y), 7)
        assert points(values(slices.union(fx, fy, 7))) == points(x) | points(y)
        assert points(values(slices.intersect(fx, fy, 7))) == points(x) & points(y)
        ends = sorted(values(slices.union(fx, fy, 7)))
        assert all(p[1] < q[0] for p, q in zip(ends, ends[1:]))


def test_slice_labels(session):
    out = session.execute("SLICE USING LABELS(m, k) (0, 10, 'A', 'B') INTERSECT (5, 20, 'C', '')")
    assert values(out) == [(5, 10, "C", "B")]


def test_vectors_in_three_encodings(spark):
    for rows, kind in (([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "array<double>"), ([(1, "[1,0]"), (2, "0.0, 1.0")], "string")):
        df = spark.createDataFrame(rows, f"id long, e {kind}")
        assert values(vectors.nearest(df, "e", [0.0, 0.9], 1, "l2", "id"), "row_id") == [(2,)]
        assert values(vectors.nearest(df, "e", [1.0, 0.1], 1, "ip", "id"), "row_id") == [(1,)]


def test_graph(spark):
    edges = spark.createDataFrame([("p", "a", 1.0, 5), ("a", "x", 2.0, 9), ("p", "x", 10.0, 9)], "src string, dst string, cost double, t long")
    assert set(values(graph.neighbors(edges, "p", 2))) == {("a", "p", 1), ("x", "p", 1)}
    assert set(values(graph.neighbors(edges, "p", 2, "t", 0, 6))) == {("a", "p", 1)}
    assert [r[1] for r in values(graph.path(edges, "p", "x", 3, "cost"))] == ["p", "a", "x"]
    assert [r[1] for r in values(graph.path(edges, "p", "x", 3))] == ["p", "x"]
    assert values(graph.path(edges, "x", "p", 3)) == []


def test_quantified(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    some, none = spark.createDataFrame([(2,), (4,)], "v int"), spark.createDataFrame([], "v int")
    assert values(relational.any_of(df, "x", ">", some, "v")) == [(5,)]
    assert values(relational.all_of(df, "x", "<", some, "v")) == [(1,)]
    assert len(values(relational.all_of(df, "x", "=", none, "v"))) == 3
    assert values(relational.any_of(df, "x", "=", none, "v")) == []


def test_storage(session):
    session.execute("CREATE TABLE t (a INT, b TEXT, PRIMARY KEY (a, b))")
    session.execute("INSERT INTO t (a, b) VALUES (1, 'x'), (1, 'y')")
    with pytest.raises(ConstraintError):
        session.execute("INSERT INTO t (a, b) VALUES (1, 'x')")
    session.execute("ALTER TABLE t RENAME COLUMN b TO c")
    session.execute("UPDATE t SET c = 'z' WHERE c = 'y'")
    assert sorted(values(session.query("SELECT a, c FROM t"))) == [(1, "x"), (1, "z")]
    session.execute("DELETE FROM t WHERE c = 'x'")
    assert values(session.query("SELECT count(*) AS n FROM t")) == [(1,)]


def test_widening():
    assert schemas.infer([{"a": 1}, {"a": 2.5}, {"b": "x"}, {"b": "7"}]) == {"a": "double", "b": "string"}
    assert schemas.infer([{"a": "x"}], {"a": "bigint"}, ["a"]) == {"a": "bigint"}
    assert schemas.widen("array<bigint>", "array<double>") == "string" and schemas.widen("array<bigint>", "double") == "array<bigint>"


def test_key_value():
    now = [0.0]
    kv = KeyValueStore(lambda: now[0])
    kv.put("k", 1, ttl=10, reset_on_access=True)
    now[0] = 8
    assert kv.get("k") == 1
    now[0] = 17
    assert kv.get("k") == 1
    now[0] = 28
    assert kv.get("k") is None and kv.keys() == []
