"""One query for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, graph, quantiles, relational, slices, timeseries, vectors
from ..operators.shared import epoch_ms, shared_folder
from ..session import TABLES
from .registry import EV, ORACLES, QUERIES, dialect, query, session, stored, table

QUANT = "list_sort(list({0}))[1 + CAST(floor({1} * (count({0}) - 1) + 0.5) AS INT)]"

# filters and predicates
dialect("filter_compare", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000 AND NOT l_discount >= 0.05 OR l_quantity = 1")
dialect("filter_count", "SELECT count(*) AS n FROM lineitem WHERE l_extendedprice > 30000")
dialect("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08")
dialect("filter_in", "SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
dialect("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE 'a_%'")
dialect("filter_null", "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL AND NOT toxic IS NULL")
dialect("filter_iso_time", "SELECT event_id, _time FROM events WHERE _time >= '2024-01-01T00:00:00Z' AND _time < '2024-01-15'", f"SELECT event_id, _time FROM {EV} WHERE _time >= 1704067200000 AND _time < 1705276800000")
dialect("filter_arith", "SELECT o_orderkey FROM orders WHERE o_totalprice / 2 + 1 > 100000 AND -o_custkey < -10")
dialect("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
dialect("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
dialect("exists_corr", "SELECT c.c_custkey FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
dialect("not_exists_corr", "SELECT c.c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
dialect("any_subquery", "SELECT p_partkey FROM part WHERE p_size = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
dialect("all_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier)")
dialect("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > ANY (SELECT c_acctbal * 20 FROM customer)")
def any_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "customer").select((F.col("c_acctbal") * 20).alias("v"))
    return relational.any_of(table(spark, sf_dir, "orders"), "o_totalprice", ">", values, "v").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT c_acctbal * 20 FROM customer)")
def all_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "customer").select((F.col("c_acctbal") * 20).alias("v"))
    return relational.all_of(table(spark, sf_dir, "orders"), "o_totalprice", ">", values, "v").select("o_orderkey")


# joins
dialect("join_inner", "SELECT c.c_custkey, n.n_name FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey")
dialect("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey")
dialect("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders AS o RIGHT JOIN customer AS c ON c.c_custkey = o.o_custkey")
dialect("join_full", "SELECT d.doc_id, l.quality FROM documents AS d FULL OUTER JOIN labels AS l ON d.doc_id = l.doc_id")
dialect("join_remainder", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000")
dialect("join_theta_inner", "SELECT r.r_regionkey, n.n_nationkey FROM region AS r JOIN nation AS n ON n.n_regionkey < r.r_regionkey")
dialect("join_theta_left", "SELECT n.n_nationkey, r.r_regionkey FROM nation AS n LEFT JOIN region AS r ON r.r_regionkey > n.n_nationkey")
dialect("join_three_way", "SELECT r.r_name, count(*) AS n, sum(c.c_acctbal) AS bal FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", "SELECT r.r_name, count(*) AS n, sum(c.c_acctbal) AS bal FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
dialect("derived_table", "SELECT d.k, d.s FROM (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) AS d WHERE d.s > 500000")
dialect("join_derived", "SELECT c.c_name, d.s FROM customer AS c JOIN (SELECT o_custkey AS k, max(o_totalprice) AS s FROM orders GROUP BY o_custkey) AS d ON d.k = c.c_custkey")


@query("SELECT s.s_name, v.n_name FROM supplier AS s JOIN (SELECT * FROM nation WHERE n_regionkey > 1) AS v ON s.s_nationkey = v.n_nationkey")
def join_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.execute("CREATE VIEW far AS SELECT * FROM nation WHERE n_regionkey > 1")
    return s.query("SELECT s.s_name, v.n_name FROM supplier AS s JOIN far AS v ON s.s_nationkey = v.n_nationkey")


# aggregates
dialect("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS p, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem")
dialect("agg_group", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
dialect("agg_notnull", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type NOTNULL", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
dialect("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
dialect("agg_first_last", "SELECT user_id, FIRST(value) AS f, LAST(value) AS l FROM events GROUP BY user_id", f"SELECT user_id, arg_min(value, _time) AS f, arg_max(value, _time) AS l FROM {EV} GROUP BY user_id")
dialect("agg_stdev", "SELECT l_returnflag, round(STDEV(l_quantity), 6) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, floor(stddev_samp(l_quantity) * 1000000 + 0.5) / 1000000 AS s FROM lineitem GROUP BY l_returnflag")
dialect("agg_delta", "SELECT user_id, DELTA(value) AS d FROM events GROUP BY user_id", f"SELECT user_id, arg_max(value, _time) - arg_min(value, _time) AS d FROM {EV} GROUP BY user_id")
dialect("agg_height", "SELECT event_type, HEIGHT(value) AS h FROM events GROUP BY event_type", "SELECT event_type, max(value) - min(value) AS h FROM events GROUP BY event_type")
dialect("agg_gradient", "SELECT user_id, round(GRADIENT(value) * 1000000, 6) AS g FROM events GROUP BY user_id", f"SELECT user_id, floor((arg_max(value, _time) - arg_min(value, _time)) / nullif(max(_time) - min(_time), 0) * 1000000 * 1000000 + 0.5) / 1000000 AS g FROM {EV} GROUP BY user_id")
dialect("agg_quantile", "SELECT event_type, QUANTILE(value, 90) AS q90, QUANTILE(value) AS q50 FROM events GROUP BY event_type", f"SELECT event_type, {QUANT.format('value', '0.9')} AS q90, {QUANT.format('value', '0.5')} AS q50 FROM events GROUP BY event_type")
dialect("agg_array", "SELECT n_regionkey, array_to_string(ARRAY_AGG(n_name), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
dialect("agg_expr", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, floor(sum(l_extendedprice * (1 - l_discount)) * 100 + 0.5) / 100 AS revenue FROM lineitem GROUP BY l_returnflag")
dialect("group_by_expression", "SELECT l_quantity > 25 AS many, count(*) AS n FROM lineitem GROUP BY l_quantity > 25")


@query(f"SELECT l_returnflag, {QUANT.format('l_extendedprice', '0.75')} AS q FROM lineitem GROUP BY l_returnflag")
def quantile_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.grouped_quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 75, "q")


# time series
dialect("by_window", "SELECT COUNT(*) AS n, round(AVG(value), 6) AS a, DELTA(value) AS d FROM events BY 1h", f"SELECT (_time // 3600000) * 3600000 AS _time, count(*) AS n, floor(avg(value) * 1000000 + 0.5) / 1000000 AS a, arg_max(value, _time) - arg_min(value, _time) AS d FROM {EV} GROUP BY 1")
dialect("by_window_5m", "SELECT COUNT(value) AS n, round(SUM(value), 4) AS s FROM events BY 5m WHERE event_type <> 'zzz'", f"SELECT (_time // 300000) * 300000 AS _time, count(value) AS n, floor(sum(value) * 10000 + 0.5) / 10000 AS s FROM {EV} GROUP BY 1")
dialect("by_window_first", "SELECT event_type AS e, MAX(value) AS m FROM events BY 1h", f"SELECT (_time // 3600000) * 3600000 AS _time, arg_min(event_type, _time) AS e, max(value) AS m FROM {EV} GROUP BY 1")
dialect("by_window_having", "SELECT COUNT(*) AS n FROM events BY 1d HAVING n > 10", f"SELECT (_time // 86400000) * 86400000 AS _time, count(*) AS n FROM {EV} GROUP BY 1 HAVING count(*) > 10")


@query(f"SELECT (_time // 86400000) * 86400000 AS _time, floor(avg(event_id) * 1000 + 0.5) / 1000 AS e, floor(avg(user_id) * 1000 + 0.5) / 1000 AS u, floor(avg(value) * 1000 + 0.5) / 1000 AS v FROM {EV} GROUP BY 1")
def by_default_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = session(spark, sf_dir).query("SELECT * FROM events BY 1d")
    third = lambda c: (F.floor(F.col(f"`AVG({c})`") * 1000 + 0.5) / 1000)
    return made.select("_time", third("event_id").alias("e"), third("user_id").alias("u"), third("value").alias("v"))


_ROLL = "OVER (ORDER BY _time RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW)"
dialect("rolling_avg", "SELECT event_id, AVG(value) AS a FROM events ROLLING BY 1h", f"SELECT event_id, avg(value) {_ROLL} AS a FROM {EV}")
QUERIES["rolling_avg"] = lambda spark, sf_dir: session(spark, sf_dir).query("SELECT event_id, AVG(value) AS a FROM events ROLLING BY 1h").withColumn("a", F.round("a", 6))
ORACLES["rolling_avg"] = f"SELECT event_id, round(avg(value) {_ROLL}, 6) AS a FROM {EV}"
QUERIES["rolling_sum_count"] = lambda spark, sf_dir: session(spark, sf_dir).query("SELECT event_id, SUM(value) AS s, COUNT(value) AS n, MAX(value) AS m FROM events ROLLING BY 1h").withColumn("s", F.round("s", 4))
ORACLES["rolling_sum_count"] = f"SELECT event_id, round(sum(value) {_ROLL}, 4) AS s, count(value) {_ROLL} AS n, max(value) {_ROLL} AS m FROM {EV}"
QUERIES["rolling_stdev"] = lambda spark, sf_dir: session(spark, sf_dir).query("SELECT event_id, STDEV(value) AS s FROM events ROLLING BY 1d").withColumn("s", F.round("s", 4))
ORACLES["rolling_stdev"] = f"SELECT event_id, round(stddev_samp(value) OVER (ORDER BY _time RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW), 4) AS s FROM {EV}"


@query(f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY _time RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW), 4) AS s FROM {EV}")
def rolling_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = timeseries.rolling(session(spark, sf_dir).table("events"), "1d", {"s": ("SUM", "value")}, partition_by=["user_id"])
    return made.select("event_id", F.round("s", 4).alias("s"))


# intervals: a user's busy spells are events less than an hour apart
def busy(spark: SparkSession, sf_dir: str, users: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where(users).select(epoch_ms("ts").alias("_start_date"), F.col("user_id").cast("string").alias("who"))
    return slices.merge(ev.withColumn("_end_date", F.col("_start_date") + 3_600_000).drop("who"))


def _islands_sql(source: str) -> str:
    return f"""SELECT min(s) AS _start_date, max(e) AS _end_date FROM (
        SELECT s, e, sum(new) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT s, e, CASE WHEN s <= max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ({source})))
        GROUP BY island"""


def _busy_sql(users: str) -> str:
    return _islands_sql(f"SELECT (epoch_us(ts) // 1000) AS s, (epoch_us(ts) // 1000) + 3600000 AS e FROM events WHERE {users}")


@query("SELECT * FROM (VALUES (0::BIGINT, 20::BIGINT), (30, 40)) AS t(_start_date, _end_date)")
def slice_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).execute("SLICE USING ((0, 10), (5, 12), (12, 20), (30, 40))")


@query(_busy_sql("event_type = 'purchase'"))
def slice_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.register("spells", s.table("events").select(F.col("_time").alias("_start_date"), (F.col("_time") + 3_600_000).alias("_end_date"), "event_type"))
    return s.execute("SLICE USING spells WHERE event_type = 'purchase'")


@query(_islands_sql(f"SELECT greatest(a._start_date, b._start_date) AS s, least(a._end_date, b._end_date) AS e FROM ({_busy_sql('user_id % 2 = 0')}) a JOIN ({_busy_sql('user_id % 2 = 1')}) b ON greatest(a._start_date, b._start_date) <= least(a._end_date, b._end_date)"))
def slice_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.intersect(busy(spark, sf_dir, "user_id % 2 = 0"), busy(spark, sf_dir, "user_id % 2 = 1"))


@query(_busy_sql("user_id IS NOT NULL"))
def slice_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.union(busy(spark, sf_dir, "user_id % 2 = 0"), busy(spark, sf_dir, "user_id % 2 <> 0"))


@query("SELECT * FROM (VALUES (0::BIGINT, 15000::BIGINT, 'LHS')) AS t(_start_date, _end_date, l1)")
def slice_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).execute("SLICE USING (0, 10000, l1:='LHS') UNION (5000, 15000, l1:='RHS')")


@query(f"SELECT s._start_date AS _time, count(e.value) AS n, coalesce(max(e.value), -1) AS m FROM ({_busy_sql('true')}) s LEFT JOIN {EV} e ON e._time >= s._start_date AND e._time < s._end_date GROUP BY 1")
def by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.register("spells", busy(spark, sf_dir, "true"))
    return s.query("SELECT COUNT(value) AS n, COALESCE(MAX(value), -1) AS m FROM events BY SLICE(USING spells)")


# windows, order, sets
dialect("row_number", "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
dialect("row_number_partition", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
dialect("row_number_expr", "SELECT l_orderkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_quantity * l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem")
dialect("previous", "SELECT event_id, value - PREVIOUS.value AS step FROM events", f"SELECT event_id, value - lag(value) OVER (ORDER BY _time) AS step FROM {EV}")
ORACLES["previous_stretches"] = f"SELECT event_id, lag(value) OVER (ORDER BY _time, event_id) AS before FROM {EV}"
QUERIES["previous_stretches"] = lambda spark, sf_dir: timeseries.previous(session(spark, sf_dir).table("events"), "value", ["_time", "event_id"], "before").select("event_id", "before")
dialect("order_nulls_last", "SELECT c.c_custkey AS k, o.o_totalprice AS p FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey ORDER BY p DESC, k", "SELECT c.c_custkey AS k, o.o_totalprice AS p FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey ORDER BY p DESC NULLS LAST, k NULLS LAST")
dialect("limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
dialect("limit_negative", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT -10", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
dialect("limit_zero", "SELECT r_name FROM region LIMIT 0")
dialect("union_by_name", "SELECT r_regionkey AS k, r_name AS name FROM region UNION SELECT n_name AS name, n_regionkey AS k FROM nation", "SELECT r_regionkey AS k, r_name AS name FROM region UNION BY NAME SELECT n_name AS name, n_regionkey AS k FROM nation")
dialect("union_all", "SELECT r_regionkey AS a FROM region UNION ALL SELECT n_nationkey AS b FROM nation", "SELECT r_regionkey AS a FROM region UNION ALL BY NAME SELECT n_nationkey AS b FROM nation")
dialect("cte_chain", "WITH big AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 100000), top AS (SELECT k, sum(p) AS s FROM big GROUP BY k) SELECT c.c_name, t.s FROM top AS t JOIN customer AS c ON c.c_custkey = t.k")

# expressions
dialect("arith", "SELECT p_partkey, p_size * 2 + 1 AS a, p_retailprice / p_size AS d, -p_size AS m FROM part", "SELECT p_partkey, p_size * 2 + 1 AS a, p_retailprice / nullif(p_size, 0) AS d, -p_size AS m FROM part")
dialect("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size FROM part")
dialect("cast_pg", "SELECT p_partkey, p_retailprice::bigint AS b, p_size::text AS t, '12.5'::numeric AS n, 'x'::int AS bad FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS b, CAST(p_size AS VARCHAR) AS t, 12.5::DOUBLE AS n, CAST(NULL AS BIGINT) AS bad FROM part")
dialect("fstring", "SELECT p_partkey, f'{p_brand}: {p_size} in {{x}}' AS s FROM part", "SELECT p_partkey, p_brand || ': ' || p_size || ' in {x}' AS s FROM part")
dialect("str_slice", "SELECT p_partkey, p_name[1:4] AS a, p_name[:3] AS b, p_name[2:] AS c, p_name[0:10:2] AS d, p_name[-3:] AS e FROM part", "SELECT p_partkey, p_name[2:4] AS a, p_name[1:3] AS b, p_name[3:] AS c, array_to_string(list_transform(range(0, least(10, length(p_name)), 2), lambda i: p_name[i + 1]), '') AS d, right(p_name, 3) AS e FROM part")
dialect("array_ops", "SELECT n_nationkey, array_length(ARRAY[1, 2, 3]) AS n, array_to_string(ARRAY[1, 2] || ARRAY[n_nationkey], '-') AS j, ARRAY[7, 8][-1] AS l FROM nation", "SELECT n_nationkey, 3 AS n, '1-2-' || n_nationkey AS j, 8 AS l FROM nation")
dialect("datepart", "SELECT event_id, DATEPART(YEAR, _time) AS y, DATEPART(HOUR, _time) AS h FROM events", f"SELECT event_id, year(ts)::DOUBLE AS y, hour(ts)::DOUBLE AS h FROM {EV}")
dialect("dateadd", "SELECT event_id, DATEADD(HOUR, 2, _time) AS t FROM events", f"SELECT event_id, _time + 7200000 AS t FROM {EV}")
dialect("datediff", "SELECT event_id, DATEDIFF(DAY, _time, 1700000000000) AS d FROM events", f"SELECT event_id, (_time - 1700000000000) // 86400000 AS d FROM {EV}")
dialect("extract", "SELECT event_id, EXTRACT(dow FROM _time / 1000) AS d FROM events", f"SELECT event_id, dayofweek(ts)::DOUBLE AS d FROM {EV}")
dialect("sourceless", "SELECT 1 AS one, 'a' LIKE 'a%' AS ok, NULL IS NULL AS none")
dialect("fn_math", "SELECT p_partkey, gcd(p_size, 12) AS g, lcm(p_size, 4) AS l, mod(-p_size, 7) AS m, round(-2.5) AS r, trunc(-1.5) AS t, sign(p_size - 25) AS s, width_bucket(p_size, 0, 50, 5) AS w, round(sqrt(p_size), 6) AS q, div(p_size, 7) AS d FROM part", "SELECT p_partkey, gcd(p_size, 12) AS g, lcm(p_size, 4) AS l, (-p_size - floor(-p_size / 7.0) * 7)::DOUBLE AS m, -2.0::DOUBLE AS r, -1::BIGINT AS t, sign(p_size - 25)::DOUBLE AS s, CASE WHEN p_size < 0 THEN 0 WHEN p_size >= 50 THEN 6 ELSE floor(p_size / 10.0) + 1 END::BIGINT AS w, floor(sqrt(p_size) * 1000000 + 0.5) / 1000000 AS q, (p_size // 7)::BIGINT AS d FROM part")
dialect("fn_string", "SELECT p_partkey, upper(p_name) AS u, left(p_name, 3) AS l, right(p_name, 2) AS r, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '.') AS rp, split_part(p_name, ' ', 1) AS sp, strpos(p_name, 'a') AS st, replace(p_name, 'a', 'A') AS rep, reverse(p_brand) AS rev, repeat('x', 3) AS xs, overlay(p_brand, 'Z', 1, 2) AS o, starts_with(p_name, 'a') AS sw, initcap('ab cd') AS ic, quote_ident('a\"b') AS qi, concat_ws('-', p_brand, NULL, 'z') AS cw, octet_length(p_name) AS ol FROM part", "SELECT p_partkey, upper(p_name) AS u, left(p_name, 3) AS l, right(p_name, 2) AS r, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '.') AS rp, split_part(p_name, ' ', 1) AS sp, strpos(p_name, 'a') AS st, replace(p_name, 'a', 'A') AS rep, reverse(p_brand) AS rev, 'xxx' AS xs, 'Z' || substr(p_brand, 3) AS o, starts_with(p_name, 'a') AS sw, 'Ab Cd' AS ic, '\"a\"\"b\"' AS qi, p_brand || '-z' AS cw, strlen(p_name) AS ol FROM part")
dialect("fn_regexp", "SELECT p_partkey, regexp_match(p_brand, '[0-9]+') AS m, regexp_replace(p_brand, '[0-9]', 'n') AS r1, regexp_replace(p_brand, '[0-9]', 'n', 'g') AS r2 FROM part", "SELECT p_partkey, nullif(regexp_extract(p_brand, '[0-9]+'), '') AS m, regexp_replace(p_brand, '[0-9]', 'n') AS r1, regexp_replace(p_brand, '[0-9]', 'n', 'g') AS r2 FROM part")
dialect("fn_date", "SELECT event_id, date_trunc('hour', _time / 1000) AS h, to_char(_time / 1000, 'YYYY-MM-DD HH24:MI:SS') AS c, date_part('doy', _time / 1000) AS y FROM events", f"SELECT event_id, epoch(date_trunc('hour', ts))::BIGINT AS h, strftime(ts, '%Y-%m-%d %H:%M:%S') AS c, dayofyear(ts)::DOUBLE AS y FROM {EV}")
dialect("fn_conditional", "SELECT c_custkey, coalesce(NULL, c_name) AS a, nullif(c_nationkey, 3) AS b, greatest(c_nationkey, 5, NULL) AS g, least(c_acctbal, 0) AS l FROM customer", "SELECT c_custkey, c_name AS a, nullif(c_nationkey, 3) AS b, greatest(c_nationkey, 5) AS g, least(c_acctbal, 0) AS l FROM customer")
dialect("fn_encoding", "SELECT p_partkey, md5(p_name) AS m, encode(p_brand, 'hex') AS h, to_hex(p_size) AS x, get_byte(p_brand, 0) AS g, get_bit(p_brand, 1) AS b, ascii(p_brand) AS a, chr(65) AS c FROM part", "SELECT p_partkey, md5(p_name) AS m, lower(hex(p_brand)) AS h, lower(hex(p_size)) AS x, ascii(p_brand) AS g, (ascii(p_brand) >> 6) & 1 AS b, ascii(p_brand) AS a, 'A' AS c FROM part")
dialect("unnest", "SELECT u.unnest AS v FROM unnest(ARRAY[1, 2, 3]) AS u", "SELECT CAST(v AS VARCHAR) AS v FROM (VALUES (1), (2), (3)) AS t(v)")


@query("SELECT 'main' AS d, 'public' AS s, 'main' AS u, 'lodestream 0.1' AS v, 'double precision' AS t, 23 AS r, 'text' AS f")
def fn_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).query("SELECT current_database() AS d, current_schema() AS s, current_user() AS u, version() AS v, pg_typeof(1.5) AS t, to_regtype('int4') AS r, format_type(25, NULL) AS f")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in sorted(TABLES)) + ") AS t(name)")
def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).query("SELECT name FROM show_tables() AS t ORDER BY name")


@query("SELECT 'nation' AS table_name, * FROM (VALUES ('n_nationkey', 1), ('n_name', 2), ('n_regionkey', 3)) AS t(column_name, ordinal_position)")
def info_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).query("SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name = 'nation'")


@query("SELECT * FROM (VALUES (1::BIGINT, 'x', NULL::DOUBLE), (2, NULL, 2.5)) AS t(a, b, c)")
def kv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.execute("WRITE KEY k1 IN main.store.s1 = [{\"a\": 1, \"b\": \"x\"}, {\"a\": 2, \"c\": 2.5}] TTL 1h")
    return s.query("SELECT * FROM main.store.s1.k1")


# vectors
def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0])


_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"


def _distance(kind: str) -> str:
    return {"l2": f"list_distance(CAST(embedding AS DOUBLE[]), {_Q})", "ip": f"list_inner_product(CAST(embedding AS DOUBLE[]), {_Q})", "cosine": f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q})"}[kind]


def _top(kind: str, k: int) -> str:
    return f"SELECT vec_id AS row_id, round({_distance(kind)}, 5) AS score FROM embeddings ORDER BY {_distance(kind)} {'ASC' if kind == 'l2' else 'DESC'}, vec_id LIMIT {k}"


for _kind in vectors.METRICS:

    def _topk(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        made = vectors.nearest(table(spark, sf_dir, "embeddings"), "embedding", _first_vector(spark, sf_dir), 100, kind, "vec_id")
        return made.withColumn("score", F.round("score", 5))

    QUERIES[f"topk_{_kind}"] = _topk
    ORACLES[f"topk_{_kind}"] = _top(_kind, 100)


@query(f"SELECT vec_id, round({_distance('l2')}, 5) AS l2, round({_distance('ip')}, 5) AS ip, round({_distance('cosine')}, 5) AS cs FROM embeddings")
def vec_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors.literal(_first_vector(spark, sf_dir))
    v = vectors.as_vector("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.l2(v, q), 5).alias("l2"), F.round(vectors.dot(v, q), 5).alias("ip"), F.round(vectors.cosine(v, q), 5).alias("cs"))


@query(f"SELECT e.vec_id, e.label FROM ({_top('l2', 10)}) nn JOIN embeddings e ON nn.row_id = e.vec_id")
def vec_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ", ".join(repr(float(x)) for x in _first_vector(spark, sf_dir))
    return session(spark, sf_dir).query(f"SELECT d.vec_id, d.label FROM nearest_neighbors('embeddings', 'embedding', '[{q}]', 10, 'l2') AS nn JOIN embeddings AS d ON nn.row_id = d.vec_id")


@query(f"SELECT vec_id FROM embeddings ORDER BY {_distance('cosine')} DESC, vec_id LIMIT 10")
def vec_order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ", ".join(repr(float(x)) for x in _first_vector(spark, sf_dir))
    return session(spark, sf_dir).query(f"SELECT vec_id FROM embeddings ORDER BY cosine_sim(embedding, '[{q}]') USING ANN, vec_id LIMIT 10")


# graphs: customers buy parts, suppliers make them
def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    bought = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), (F.round(F.col("l_discount") * 100) + 1).alias("cost"), epoch_ms("l_shipdate").alias("t"))
    made = li.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit(2.0).alias("cost"), epoch_ms("l_shipdate").alias("t"))
    return bought.unionByName(made)


_EDGES = """(SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, round(l_discount * 100) + 1 AS cost, (epoch_us(l_shipdate) // 1000) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 2.0, (epoch_us(l_shipdate) // 1000) FROM lineitem)"""


def _reach(condition: str = "true") -> str:
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES} WHERE {condition}), r AS (
        SELECT 'c1' AS node, 0 AS hop UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON r.node = e.src WHERE r.hop < 3),
        f AS (SELECT node AS node_id, min(hop) AS hop FROM r GROUP BY node)
        SELECT f.node_id, (SELECT min(e.src) FROM e JOIN f g ON g.node_id = e.src WHERE e.dst = f.node_id AND g.hop = f.hop - 1) AS prev_id, f.hop FROM f WHERE f.hop > 0"""


@query(_reach())
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(trade(spark, sf_dir), "c1", 3)


@query(_reach("t BETWEEN 800000000000 AND 900000000000"))
def graph_neighbors_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(trade(spark, sf_dir), "c1", 3, "t", 800_000_000_000, 900_000_000_000)


_PATHS = f"""WITH RECURSIVE e AS (SELECT src, dst, min(cost) AS w FROM {_EDGES} GROUP BY src, dst), r AS (
    SELECT 'c1' AS node, 0.0::DOUBLE AS d, ['c1'] AS nodes, 0 AS h UNION ALL SELECT e.dst, r.d + {{w}}, list_append(r.nodes, e.dst), r.h + 1 FROM r JOIN e ON r.node = e.src WHERE r.h < 3),
    b AS (SELECT nodes FROM r WHERE node = (SELECT max(dst) FROM e WHERE dst LIKE 's%') ORDER BY d, h, nodes LIMIT 1)
    SELECT unnest(nodes) AS node_id, unnest(range(len(nodes))) AS ord FROM b"""


def _last_supplier(edges: DataFrame) -> str:
    return edges.where("dst LIKE 's%'").agg(F.max("dst")).first()[0] or "s0"


@query(_PATHS.format(w="1.0"))
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade(spark, sf_dir)
    return graph.path(edges, "c1", _last_supplier(edges), 3).select("node_id", "ord")


@query(_PATHS.format(w="e.w"))
def graph_paths_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade(spark, sf_dir)
    return graph.path(edges, "c1", _last_supplier(edges), 3, "cost").select("node_id", "ord")


def shop(spark: SparkSession, sf_dir: str):
    """A session with the graph of customers, parts and suppliers."""
    s = session(spark, sf_dir)
    s.register("trade", trade(spark, sf_dir))
    s.execute("CREATE GRAPH shop NODES(Any KEY(id)) EDGES(Trades FROM Any TO Any) USING TABLES(nodes=trade, edges=trade, time=t)")
    s.execute("USE GRAPH shop")
    return s


@query(f"SELECT node_id, hop FROM ({_reach()}) WHERE hop < 3")
def match_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop(spark, sf_dir).execute("MATCH (s:Any { key: 'c1' })-[:Trades*1..2]->(t:Any) RETURN t.key AS node_id, g.hop AS hop")


@query(_PATHS.format(w="e.w"))
def match_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _last_supplier(trade(spark, sf_dir))
    return shop(spark, sf_dir).execute(f"MATCH SHORTEST (s:Any {{ key: 'c1' }})-[:Trades*1..3]->(t:Any {{ key: '{last}' }}) RETURN t.key AS node_id, g.ord AS ord")


# sinks and changes
@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey IN (0, 1)")
def into_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.execute("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 0 INTO far")
    s.execute("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1 INTO far APPEND")
    return s.query("SELECT k, name FROM far")


@query("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1")
def into_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.execute("SELECT n_nationkey AS k FROM nation INTO far")
    s.execute("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 INTO far REPLACE")
    return s.query("SELECT k FROM far")


@query("SELECT * FROM (VALUES (1::BIGINT, 'a', 1.5::DOUBLE), (2, 'b', NULL)) AS t(id, name, v)")
def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, name TEXT, v DOUBLE PRECISION)")
    s.execute("INSERT INTO t (id, name, v) VALUES (1, 'a', 1.5), (2, 'b', NULL)")
    return s.query("SELECT * FROM t")


@query("SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.execute("CREATE TABLE t (id INT, name TEXT)")
    s.execute("INSERT INTO t (id, name) SELECT r_regionkey, r_name FROM region")
    return s.query("SELECT * FROM t")


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN 'x' ELSE n_name END AS name FROM nation")
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.execute("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation INTO t")
    s.execute("UPDATE t SET name = 'x' WHERE r = 2")
    return s.query("SELECT k, name FROM t")


@query("SELECT n_nationkey AS k FROM nation WHERE NOT n_regionkey = 2")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.execute("SELECT n_nationkey AS k, n_regionkey AS r FROM nation INTO t")
    s.execute("DELETE FROM t WHERE r = 2")
    return s.query("SELECT k FROM t")


@query("SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey <> 2 THEN n_name END AS name FROM nation")
def delete_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.execute("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation INTO t")
    s.execute("DELETE COLUMNS (name) FROM t WHERE r = 2")
    s.execute("DELETE COLUMNS (r) FROM t")
    return s.query("SELECT * FROM t")


@query("SELECT * FROM (VALUES (1000::BIGINT, '1', NULL::DOUBLE), (2000, 'x', 2.0), (3000, '2.5', 3.5)) AS t(_time, a, b)")
def schema_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.store.ingest("m.time", [{"_time": 1000, "a": 1}])
    s.store.ingest("m.time", [{"_time": 2000, "a": "x", "b": 2}, {"_time": 3000, "a": 2.5, "b": 3.5}])
    return s.query("SELECT * FROM m.time")


@query("SELECT 1::BIGINT AS id, 'a' AS name")
def pk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.storage import ConstraintError

    s = stored(spark, sf_dir)
    s.execute("CREATE TABLE t (id BIGINT, name TEXT, PRIMARY KEY (id))")
    s.execute("INSERT INTO t (id, name) VALUES (1, 'a')")
    for bad in ("(1, 'b')", "(2, 'c'), (2, 'd')", "(NULL, 'e')"):
        try:
            s.execute(f"INSERT INTO t (id, name) VALUES {bad}")
        except ConstraintError:
            continue
        raise AssertionError(f"a bad key was taken: {bad}")
    return s.query("SELECT * FROM t")


@query("SELECT * FROM (VALUES (1::BIGINT, 10.0::DOUBLE, NULL::DOUBLE), (2, 20.0, NULL), (1, NULL, 20.0), (2, NULL, 40.0)) AS t(_time, v, double_v)")
def calculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    s.store.ingest("m.time", [{"_time": 1, "v": 10.0}, {"_time": 2, "v": 20.0}])
    s.execute("CALCULATE double_v AS SELECT _time, v * 2 AS x FROM m.time")
    return s.query("SELECT * FROM m.time")


# user functions
@query("SELECT event_id, value * 2 AS d FROM events WHERE value * 2 > 100")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.create_function("dbl", lambda v: v * 2, "double")
    return s.query("SELECT event_id, dbl(value) AS d FROM events WHERE dbl(value) > 100")


@query("SELECT event_id, value AS p_0, value + 1 AS p_1 FROM events")
def udf_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.create_function("pair", lambda v: (v, v + 1), ["double", "double"])
    return s.query("SELECT event_id, pair(value) AS p FROM events")


@query("SELECT event_type, max(value) - min(value) + 1 AS r FROM events GROUP BY event_type")
def udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.create_function("reach", lambda v: float(max(v) - min(v) + 1), "double", "aggregate")
    return s.query("SELECT event_type, reach(value) AS r FROM events GROUP BY event_type")


@query("SELECT k * k AS square FROM range(1, 6) AS t(k)")
def udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.create_function("squares", lambda n: spark.range(1, n + 1).select((F.col("id") * F.col("id")).alias("square")), kind="tvf")
    return s.query("SELECT t.square FROM squares(5) AS t")


@query(f"SELECT (_time // 3600000) * 3600000 AS _time, count(*) AS n FROM {EV} GROUP BY 1")
def stream_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form, run to its end over the events' file: closed windows are appended to a table in the shared folder, a last batch closes the rest."""
    import uuid

    from ..streaming.windows import run_by_window

    path = f"{sf_dir}/events.parquet"
    rows = spark.read.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}*")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stamped = [df.withColumn("at", F.col("ts").cast("timestamp")) for df in (stream, rows)]
    return run_by_window(*stamped, "at", "1h", "10 minutes", folder, F.count(F.lit(1)).alias("n"))


from . import functions, statements  # noqa: E402  (they enter their queries)

__all__ = ["ORACLES", "QUERIES", "aggregates", "functions", "session", "statements"]
