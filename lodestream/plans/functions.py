"""Queries that call every scalar function, and their SQL."""

from __future__ import annotations

from .registry import EV, dialect


def _r(x: str, digits: int = 6) -> str:
    """The dialect's round() in plain SQL: half up."""
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def _items(pairs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in pairs.items())


_X = "p_size / 100.0"
_TRIG = {n: f"{n}({_X})" for n in "acos asin asinh atan atanh cos cosh cot sin sinh tan tanh".split()}
dialect(
    "fn_trigonometry",
    "SELECT p_partkey, " + _items({n: f"round({e}, 6)" for n, e in (_TRIG | {"at2": "atan2(p_size, 3)", "ah": f"acosh(1 + {_X})", "ac": f"acot({_X})", "ach": f"acoth(1 + {_X})", "deg": f"degrees({_X})", "rad": "radians(p_size)"}).items()}) + " FROM part",
    "SELECT p_partkey, " + _items({n: _r(e) for n, e in (_TRIG | {"at2": "atan2(p_size, 3)", "ah": f"acosh(1 + {_X})", "ac": f"atan(1 / ({_X}))", "ach": f"0.5 * ln((2 + {_X}) / ({_X}))", "deg": f"degrees({_X})", "rad": "radians(p_size)"}).items()}) + " FROM part",
)
dialect(
    "fn_numbers",
    "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice) AS c, ceiling(-0.5) AS c2, floor(p_retailprice) AS f, round(exp(p_size / 10), 3) AS e, round(ln(p_size), 6) AS l, round(log(p_size), 6) AS l10, round(log(2, p_size), 6) AS l2, power(p_size, 2) AS p, pow(2, 3) AS p2, round(pi(), 6) AS pi, isfinite(p_retailprice) AS fin, isfinite(NULL) AS nofin, truncate(-p_retailprice) AS t, (random() >= 0 AND random() < 1) AS r, setseed(0.5) IS NULL AS seed FROM part",
    f"SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice)::BIGINT AS c, 0::BIGINT AS c2, floor(p_retailprice)::BIGINT AS f, {_r('exp(p_size / 10.0)', 3)} AS e, {_r('ln(p_size)')} AS l, {_r('log10(p_size)')} AS l10, {_r('ln(p_size) / ln(2)')} AS l2, power(p_size, 2)::DOUBLE AS p, 8.0::DOUBLE AS p2, 3.141593::DOUBLE AS pi, true AS fin, false AS nofin, -floor(p_retailprice)::BIGINT AS t, true AS r, true AS seed FROM part",
)
dialect(
    "fn_text",
    "SELECT p_partkey, bit_length(p_name) AS bl, btrim('  x ') AS b1, btrim(p_name, 'a') AS b2, char_length(p_name) AS cl, character_length('été') AS cl2, concat(p_brand, NULL, 'x') AS c, length(p_brand) AS n, lower(p_brand) AS lo, ltrim('  x ') AS l1, ltrim(p_name, 'a') AS l2, rtrim('  x ') AS r1, rtrim(p_name, 'e') AS r2, trim('  x ') AS t, position('a', p_name) AS po, substring(p_name, 2, 3) AS s1, substr(p_name, 3) AS s2, translate(p_brand, 'Brd', 'b') AS tr, to_ascii('été à Ü') AS ta, replicate('ab', 2) AS rp, repeat('x', -1) AS rn FROM part",
    "SELECT p_partkey, bit_length(p_name) AS bl, 'x' AS b1, trim(p_name, 'a') AS b2, length(p_name) AS cl, 3 AS cl2, p_brand || 'x' AS c, length(p_brand) AS n, lower(p_brand) AS lo, 'x ' AS l1, ltrim(p_name, 'a') AS l2, '  x' AS r1, rtrim(p_name, 'e') AS r2, 'x' AS t, strpos(p_name, 'a') AS po, substr(p_name, 2, 3) AS s1, substr(p_name, 3) AS s2, translate(p_brand, 'Brd', 'b') AS tr, 'ete a U' AS ta, 'abab' AS rp, NULL::VARCHAR AS rn FROM part",
)
dialect(
    "fn_quoting",
    "SELECT p_partkey, quote_literal(p_brand) AS q1, quote_literal('it''s') AS q2, quote_nullable(NULL) AS q3, quote_nullable(p_brand) AS q4, format('%s has %s and %I, %L', p_brand, p_size, p_name, 'x') AS f FROM part",
    "SELECT p_partkey, '''' || p_brand || '''' AS q1, '''it''''s''' AS q2, 'NULL' AS q3, '''' || p_brand || '''' AS q4, p_brand || ' has ' || p_size || ' and \"' || p_name || '\", ''x''' AS f FROM part",
)
dialect(
    "fn_patterns",
    "SELECT p_partkey, regexp_matches(p_brand, '[0-9]') AS m, regexp_split_to_array(p_name, ' +') AS s, string_to_array(p_brand, '#') AS a FROM part",
    "SELECT p_partkey, array_to_string(regexp_extract_all(p_brand, '[0-9]'), ',') AS m, array_to_string(regexp_split_to_array(p_name, ' +'), ',') AS s, replace(p_brand, '#', ',') AS a FROM part",
)
dialect(
    "fn_bytes",
    "SELECT p_partkey, convert(p_brand, 'latin1', 'utf8') AS c1, convert_to('été', 'ascii') AS c2, convert_to('été', 'LATIN1') AS c3, convert_from(p_brand, 'utf8') AS c4, decode('616263', 'hex') AS d1, decode('YWJj', 'base64') AS d2, encode('abc', 'base64') AS e1, chr(8364) AS e2, chr(233) AS e3, chr(65) AS e4, set_byte('abc', 1, 90) AS sb, set_bit('abc', 7, 0) AS st, set_bit('abc', 6, 1) AS s6 FROM part",
    "SELECT p_partkey, p_brand AS c1, NULL::VARCHAR AS c2, 'été' AS c3, p_brand AS c4, 'abc' AS d1, 'abc' AS d2, 'YWJj' AS e1, '€' AS e2, 'é' AS e3, 'A' AS e4, 'aZc' AS sb, '`bc' AS st, 'cbc' AS s6 FROM part",
)
dialect(
    "fn_dates",
    "SELECT event_id, to_date('2024-02-03') AS d1, to_date('02/03/2024') AS d2, to_date('x') AS d3, to_timestamp('2024-02-03 04:05:06') AS t1, to_timestamp('03.02.2024', 'DD.MM.YYYY') AS t2, to_number('$1,234.50') AS n1, to_number('x') AS n2, age(0, 93784) AS a, to_char(_time / 1000, 'DD.MM.YYYY') AS c, date_part('month', _time / 1000) AS m FROM events",
    f"SELECT event_id, DATE '2024-02-03' AS d1, DATE '2024-02-03' AS d2, NULL::DATE AS d3, 1706933106::BIGINT AS t1, 1706918400::BIGINT AS t2, 1234.5::DOUBLE AS n1, NULL::DOUBLE AS n2, '1 days 02:03:04' AS a, strftime(ts, '%d.%m.%Y') AS c, month(ts)::DOUBLE AS m FROM {EV}",
)
dialect(
    "fn_now",
    "SELECT now() > 1700000000 AS a, clock_timestamp() >= now() - 60 AS b, current_timestamp() >= now() - 60 AS c, statement_timestamp() >= now() - 60 AS d, transaction_timestamp() >= now() - 60 AS e, char_length(current_date()) AS f, char_length(curdate()) AS g, char_length(current_time()) AS h, char_length(curtime()) AS i",
    "SELECT true AS a, true AS b, true AS c, true AS d, true AS e, 10 AS f, 10 AS g, 8 AS h, 8 AS i",
)
dialect(
    "fn_vectors",
    "SELECT vec_id, round(vec_ip(embedding, embedding), 4) AS ip, round(vec_l2(embedding, '[0]'), 4) IS NULL AS short, round(cosine_sim(embedding, embedding), 4) AS cs, array_length(to_vec(embedding)) AS dim, vec_l2('[1, 2]', '(4 6)') AS five, vec_ip('1,2', '3,4') AS eleven FROM embeddings",
    f"SELECT vec_id, {_r('list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))', 4)} AS ip, true AS short, 1.0::DOUBLE AS cs, len(embedding)::INT AS dim, 5.0::DOUBLE AS five, 11.0::DOUBLE AS eleven FROM embeddings",
)
dialect(
    "fn_catalogue",
    "SELECT pg_client_encoding() AS e, pg_get_expr('x', 1) AS x, pg_get_partkeydef(1) AS k, pg_get_viewdef(1) AS v, pg_total_relation_size('t') AS z, session_user() AS s, current_user() AS u, pg_catalog.version() AS ver, pg_typeof('a') AS ty, 'int8'::regtype AS rt, 'pg_class'::regclass AS rc, 'pg_catalog.pg_type'::regclass AS rp, 'demo.public.my_tbl'::regclass = 'demo.public.my_tbl'::regclass AS same",
    "SELECT 'UTF8' AS e, 'x' AS x, NULL::VARCHAR AS k, NULL::VARCHAR AS v, 0::BIGINT AS z, 'main' AS s, 'main' AS u, 'lodestream 0.1' AS ver, 'text' AS ty, 20 AS rt, 1259 AS rc, 1247 AS rp, true AS same",
)
dialect(
    "casts",
    "SELECT p_partkey, '{1,2}'::int[] AS a, '7'::int::text AS t, ('2024-01-05'::date)::text AS d, 'P1DT2S'::interval::text AS i, 'PT3H4M5S'::interval::text AS j, '90'::interval::text AS s, 'x'::bytea::text AS b, 'true'::boolean AS o, '3.14'::double precision AS f FROM part",
    "SELECT p_partkey, [1, 2]::BIGINT[] AS a, '7' AS t, '2024-01-05 00:00:00' AS d, 'INTERVAL ''1 00:00:02'' DAY TO SECOND' AS i, 'INTERVAL ''0 03:04:05'' DAY TO SECOND' AS j, 'INTERVAL ''0 00:01:30'' DAY TO SECOND' AS s, 'x' AS b, true AS o, 3.14::DOUBLE AS f FROM part",
)
dialect(
    "array_joins",
    "SELECT n_nationkey, array_to_string(ARRAY[1] || 5, '-') AS a, array_to_string(5 || ARRAY[1, 2], '-') AS b, array_to_string(ARRAY[1, 2] || NULL, '-') AS c, array_to_string('{a,b}', '+') AS d, array_length('{a,b,c}') AS e, array_length(ARRAY[1], 2) AS f, 'x' + 'y' AS g, n_name || '!' AS h, array_to_string('{a,b}' || ARRAY['c'], '') AS i FROM nation",
    "SELECT n_nationkey, '1-5' AS a, '5-1-2' AS b, '1-2' AS c, 'a+b' AS d, 3 AS e, NULL::INT AS f, 'xy' AS g, n_name || '!' AS h, 'abc' AS i FROM nation",
)
