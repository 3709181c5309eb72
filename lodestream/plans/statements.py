"""Queries that show statements, joins and forms which the catalogue's others don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from .registry import EV, dialect, query, session, stored, table

# relations
dialect("star_of_table", "SELECT n.*, r.r_name FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey")
dialect("join_theta_right", "SELECT n.n_nationkey, r.r_regionkey FROM nation AS n RIGHT JOIN region AS r ON n.n_nationkey < r.r_regionkey")
dialect("join_theta_full", "SELECT n.n_nationkey, r.r_regionkey FROM nation AS n FULL OUTER JOIN region AS r ON n.n_nationkey < r.r_regionkey - 1")
dialect("bare_boolean", "SELECT c_custkey FROM customer WHERE (c_acctbal > 0) = true AND starts_with(c_name, 'C') -- a comment")
dialect("two_windows", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS b FROM orders")
dialect("order_by_expression", "SELECT o_orderkey FROM orders ORDER BY o_totalprice * 2 DESC, o_orderkey LIMIT 7")
dialect("order_by_hidden", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 7")
dialect("not_in_nulls", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT quality FROM labels)")
dialect("not_in_no_rows", "SELECT quality FROM labels WHERE quality NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 0)")
dialect("any_inequality", "SELECT o_orderkey FROM orders WHERE o_totalprice > ANY (SELECT c_acctbal * 20 AS v FROM customer)")
dialect("all_inequality", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT c_acctbal * 20 AS v FROM customer)")
dialect("all_distinct", "SELECT n_nationkey FROM nation WHERE n_nationkey <> ALL (SELECT r_regionkey FROM region)")
dialect("pattern_slice", "SELECT p_partkey, p_brand['#':] AS a, p_brand[:'#'] AS b FROM part", "SELECT p_partkey, substr(p_brand, strpos(p_brand, '#')) AS a, left(p_brand, strpos(p_brand, '#') - 1) AS b FROM part")
dialect("iso_literals", "SELECT event_id FROM events WHERE _time BETWEEN '2024-01-05' AND '2024-01-06T12:00:00Z'", f"SELECT event_id FROM {EV} WHERE _time BETWEEN 1704412800000 AND 1704542400000")

dialect("join_row_number", "SELECT o.o_orderkey, c.c_name, ROW_NUMBER() OVER (ORDER BY c.c_acctbal DESC, o_orderkey) AS rn FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000", "SELECT o.o_orderkey, c.c_name, row_number() OVER (ORDER BY c.c_acctbal DESC NULLS LAST, o_orderkey) AS rn FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000")
dialect("join_quantile", "SELECT n.n_name, QUANTILE(c.c_acctbal, 75) AS q, count(*) AS n FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "SELECT n.n_name, list_sort(list(c.c_acctbal))[1 + CAST(floor(0.75 * (count(c.c_acctbal) - 1) + 0.5) AS INT)] AS q, count(*) AS n FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")

# catalogues
dialect("pg_namespace", "SELECT oid, nspname FROM pg_catalog.pg_namespace", "SELECT * FROM (VALUES (11, 'pg_catalog'), (2200, 'public'), (13211, 'information_schema')) AS t(oid, nspname)")
dialect("pg_type", "SELECT t.typname, t.oid, t.typarray, n.nspname FROM pg_type AS t JOIN pg_namespace AS n ON t.typnamespace = n.oid WHERE t.typname IN ('text', 'int8', 'float8')", "SELECT * FROM (VALUES ('text', 25, 1009, 'pg_catalog'), ('int8', 20, 1016, 'pg_catalog'), ('float8', 701, 1022, 'pg_catalog')) AS t(typname, oid, typarray, nspname)")
dialect("pg_class", "SELECT pg_catalog.pg_class.relname, relkind FROM pg_catalog.pg_class WHERE relname IN ('nation', 'region')", "SELECT * FROM (VALUES ('nation', 'r'), ('region', 'r')) AS t(relname, relkind)")
dialect("pg_attribute", "SELECT a.attname, a.attnum FROM pg_attribute AS a JOIN pg_class AS c ON a.attrelid = c.oid WHERE c.relname = 'region'", "SELECT * FROM (VALUES ('r_regionkey', 1), ('r_name', 2)) AS t(attname, attnum)")
dialect("information_tables", "SELECT table_schema, table_name, table_type FROM information_schema.tables WHERE table_name = 'nation'", "SELECT 'public' AS table_schema, 'nation' AS table_name, 'BASE TABLE' AS table_type")


# intervals
@query("SELECT * FROM (VALUES (5::BIGINT, 10::BIGINT, 'b'), (20, 25, 'a')) AS t(_start_date, _end_date, who)")
def slice_labelled_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).execute("SLICE USING LABELS(who) ((0, 10, 'a'), (20, 30, 'a')) INTERSECT ((5, 12, 'b'), (20, 25, ''))")


@query("SELECT * FROM (VALUES (5::BIGINT, 10::BIGINT), (40, 50)) AS t(_start_date, _end_date)")
def slice_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).execute("SLICE USING SLICE(USING ((0, 10), (20, 30)) INTERSECT ((5, 12))) UNION ((40, 50))")


# vectors
_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"SELECT vec_id AS row_id, round(list_distance(CAST(embedding AS DOUBLE[]), {_Q}), 5) AS score FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_Q}), vec_id LIMIT 10")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.execute("CREATE VECTOR INDEX near ON embeddings (embedding) USING hnsw WITH (metric = 'l2')")
    s.execute("ALTER VECTOR INDEX near SET MODE IMMEDIATE")
    s.execute("BUILD VECTOR INDEX near")
    first = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]
    return s.query(f"SELECT row_id, score FROM vector_search('near', '[{', '.join(repr(float(x)) for x in first)}]', 10) AS t").withColumn("score", F.round("score", 5))


_NEAR = "list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


@query(f"SELECT query_id, row_id, round(d, 5) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS row_id, {_NEAR} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_NEAR}, e.vec_id) AS rank FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0) WHERE rank <= 10")
def vec_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 as a query against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    made = vectors.nearest_many(rows, rows.where("vec_id % 100 = 0"), "embedding", "vec_id", 10, "l2")
    return made.withColumn("score", F.round("score", 5))


# definitions and changes
@query("SELECT n_nationkey::BIGINT AS id, n_name AS label FROM nation WHERE n_regionkey < 2")
def partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.execute("CREATE TABLE t (id BIGINT, label TEXT, part BIGINT) PARTITION BY (part)")
    s.execute("INSERT INTO t (id, label, part) SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return s.query("SELECT id, label FROM t WHERE part < 2")


@query("SELECT r_regionkey::BIGINT AS id, r_name AS title, NULL::DOUBLE AS extra FROM region")
def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.execute("CREATE TABLE t (id BIGINT, name TEXT)")
    s.execute("INSERT INTO t (id, name) SELECT r_regionkey, r_name FROM region")
    s.execute("ALTER TABLE t ADD COLUMN extra DOUBLE PRECISION")
    s.execute("ALTER TABLE t RENAME COLUMN name TO title")
    return s.query("SELECT id, title, extra FROM t")


@query("SELECT r_regionkey::BIGINT AS id FROM region")
def rename_drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.execute("SELECT r_regionkey AS id FROM region INTO t")
    s.execute("SELECT n_nationkey AS id FROM nation INTO gone")
    s.execute("RENAME TABLE t TO u")
    s.execute("DROP TABLE gone")
    s.execute("DROP TABLE IF EXISTS gone")
    return s.query("SELECT id FROM u")


@query("SELECT * FROM (VALUES ('id', 'bigint'), ('name', 'string')) AS t(name, type)")
def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.execute("CREATE TABLE t (id BIGINT, name TEXT)")
    return s.execute("DESCRIBE t").select("name", "type")


@query("SELECT * FROM (VALUES ('far', 'SELECT n_name FROM nation')) AS t(name, definition)")
def show_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.execute("CREATE VIEW far AS SELECT n_name FROM nation")
    return s.execute("SHOW VIEWS")


@query("SELECT 'vector.search.ef_search' AS name, '96' AS value")
def set_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.execute("SET vector.search.ef_search = 96")
    return s.execute("SHOW ALL").where("name = 'vector.search.ef_search'")


@query("SELECT * FROM (VALUES ('shop')) AS t(name)")
def show_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalogue import shop

    return shop(spark, sf_dir).execute("SHOW GRAPHS")


# user functions and time tables
@query("SELECT event_type, max(value) - min(user_id) AS r FROM events WHERE value IS NOT NULL GROUP BY event_type")
def udaf_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.create_function("apart", lambda v, u: float(max(v) - min(u)), "double", "aggregate")
    return s.query("SELECT event_type, apart(value, user_id) AS r FROM events WHERE value IS NOT NULL GROUP BY event_type")


@query("SELECT event_type, sum(value * 2) AS r FROM events GROUP BY event_type")
def aggregate_of_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.create_function("dbl", lambda v: None if v is None else v * 2, "double")
    return s.query("SELECT event_type, SUM(dbl(value)) AS r FROM events GROUP BY event_type").withColumn("r", F.round("r", 6))


@query(f"SELECT user_id, min(_time) AS _start_time, max(_time) AS _end_time, count(*) AS n FROM {EV} GROUP BY user_id")
def group_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).query("SELECT user_id, _start_time, _end_time, COUNT(*) AS n FROM events GROUP BY user_id")


@query("SELECT * FROM (VALUES (1::BIGINT, 5.0::DOUBLE)) AS t(id, v)")
def constraint_on_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.storage import ConstraintError

    s = stored(spark, sf_dir)
    s.create_function("positive", lambda v: v is not None and v > 0, "boolean")
    s.execute("CREATE TABLE t (id BIGINT, v DOUBLE PRECISION)")
    s.execute("ALTER TABLE t ADD CONSTRAINT above USING positive")
    s.execute("INSERT INTO t (id, v) VALUES (1, 5.0)")
    for bad in ("(2, -1.0)", "(3, NULL)"):
        try:
            s.execute(f"INSERT INTO t (id, v) VALUES {bad}")
        except ConstraintError:
            continue
        raise AssertionError(f"a row that breaks the constraint was taken: {bad}")
    return s.query("SELECT * FROM t")


@query("SELECT * FROM (VALUES (1::BIGINT, 10.0::DOUBLE, NULL::DOUBLE), (2, 20.0, NULL), (1, NULL, 21.0), (2, NULL, 31.0)) AS t(_time, v, more)")
def calculate_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.store.ingest("m.time", [{"_time": 1, "v": 10.0}, {"_time": 2, "v": 20.0}])
    s.execute("CALCULATE more AS WITH a AS (SELECT _time, v + (SELECT max(n_nationkey) FROM nation) - 13 AS x FROM m.time) SELECT _time, x FROM a")
    return s.query("SELECT * FROM m.time")


# graphs that are written node by node
def _known(spark: SparkSession, sf_dir: str):
    s = stored(spark, sf_dir)
    s.execute("CREATE GRAPH know NODES(Tool KEY(name)) EDGES(Calls FROM Tool TO Tool) USING GRAPHSTORE")
    s.execute("BEGIN GRAPH know")
    for k, name in enumerate(("planner", "tool", "executor")):
        s.execute(f"INSERT NODE Tool KEY '{name}' AS {k}")
    s.execute("INSERT EDGE 0 -> 1 ETYPE 2")
    s.execute("COMMIT")
    s.execute("BEGIN GRAPH know")
    s.execute("INSERT EDGE 1 -> 2")
    s.execute("INSERT EDGE 1 -> 2 GRAPH know")
    s.execute("COMMIT")
    s.execute("BEGIN GRAPH know")
    s.execute("INSERT EDGE 2 -> 0")
    s.execute("ABORT")
    s.execute("GC GRAPH know")
    return s


@query("SELECT * FROM (VALUES ('tool', 'planner', 1), ('executor', 'tool', 2)) AS t(node_id, prev_id, hop)")
def graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).query("SELECT node_id, prev_id, hop FROM graph_neighbors('know', 'Tool:planner', 'Calls', 2) AS g")


@query("SELECT 'know' AS name, 3::BIGINT AS nodes, 2::BIGINT AS edges")
def graph_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).execute("SHOW GRAPH STATUS know")


@query("SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name}) AS value FROM nation")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import json_rows

    return json_rows(session(spark, sf_dir).query("SELECT n_nationkey, n_name FROM nation"))


@query(f"SELECT event_id, value FROM {EV} WHERE _time BETWEEN 1704412800000 AND 1704542400000")
def ranged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and a range of time of a stored time table: both reach the scan."""
    s = stored(spark, sf_dir)
    s.store.into("ev.time", table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("_time"), "event_id", "value"))
    return s.query("SELECT event_id, value FROM ev.time WHERE _time BETWEEN '2024-01-05' AND '2024-01-06T12:00:00Z'")
