"""Statements of the dialect, lowered to Spark SQL over temporary views, or to the operators where SQL has no form."""

from __future__ import annotations

import itertools
import re
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, quantiles, relational, slices, timeseries, vectors
from .expressions import AGGREGATES, STOP, Expr, ExpressionParser, order_of_rows, render_aggregate
from .lexer import SqlError, tokenize, unquote

_SERIAL = itertools.count()
#: Aggregates that hang on the order of rows, and a row's place in its file, by which rows of one time are ordered.
POSITIONAL, PLACE = ("FIRST", "LAST", "DELTA", "GRADIENT"), "__place"
TVFS = "nearest_neighbors vector_search graph_neighbors graph_paths unnest show_tables show_objects show_schemas show_schema show_scripts".split()


class Compiler:
    """Reads from the tokens of ``source``, an expression parser that it shares with its caller."""

    def __init__(self, source: ExpressionParser):
        self.p = source
        self.session = source.session
        #: Names of the relations that the SELECT which is being read joins.
        self.aliases: list[str] = []

    def view(self, df: DataFrame) -> str:
        """A temporary view of ``df``."""
        name = f"__lode_{next(_SERIAL)}"
        df.createOrReplaceTempView(name)
        return name

    # queries
    def query(self) -> str:
        """[WITH ...] SELECT ... [UNION [ALL] SELECT ...]... as Spark SQL."""
        saved, tables = dict(self.session.ctes), dict(self.session.cte_tables)
        try:
            if self.p.take_word("WITH"):
                while True:
                    name = self.p.name()
                    self.p.need_word("AS")
                    self.p.need_op("(")
                    sql = Compiler(self.p).query()
                    self.p.need_op(")")
                    self.session.ctes[name.lower()] = self.view(self.session.spark.sql(sql))
                    self.session.cte_tables[name.lower()] = self.p.base_table or name
                    if not self.p.take_op(","):
                        break
            sql = self.select()
            while self.p.take_word("UNION"):
                keep = self.p.take_word("ALL")
                right = self.select()
                spark = self.session.spark
                sql = f"SELECT * FROM {self.view(relational.union_by_name(spark.sql(sql), spark.sql(right), distinct=not keep))}"
            return sql
        finally:
            self.session.ctes, self.session.cte_tables = saved, tables

    def select(self) -> str:
        p = self.p
        if p.is_op("("):
            p.next()
            sql = self.query()
            p.need_op(")")
            return sql
        outer, p.lifted = p.lifted, []
        aliases, self.aliases = self.aliases, []
        try:
            return self.selected()
        finally:
            p.lifted, self.aliases = outer, aliases

    def selected(self) -> str:
        p = self.p
        p.need_word("SELECT")
        items = self.items()
        source, where, having, limit = None, None, None, None
        group: list[Expr] | None = None
        not_null = False
        by = rolling = slice_plan = None
        order: list[str] = []
        if p.take_word("FROM"):
            source = self.source()
        while True:
            if p.take_word("WHERE"):
                where = p.expression().sql
            elif p.take_word("GROUP", "BY"):
                group = [p.expression()]
                while p.take_op(","):
                    group.append(p.expression())
                not_null = p.take_word("NOTNULL")
            elif p.take_word("ROLLING", "BY"):
                rolling = timeseries.width_ms(p.next().text)
            elif p.is_word("BY") and p.is_word("SLICE", ahead=1):
                p.k += 2
                p.need_op("(")
                slice_plan = self.slice_plan()
                p.need_op(")")
            elif p.take_word("BY"):
                by = timeseries.width_ms(p.next().text)
            elif p.take_word("HAVING"):
                having = p.expression().sql
            elif p.take_word("ORDER", "BY"):
                order = p.order_keys()
            elif p.take_word("LIMIT"):
                negative = p.take_op("-")
                limit = int(p.next().text) * (-1 if negative else 1)
            elif p.take_word("INTO"):
                self.session.into = (self.table_name(), "append" if not p.take_word("REPLACE") else "replace")
                p.take_word("APPEND")
            else:
                break
        if group and (by or slice_plan):
            raise SqlError("BY and GROUP BY exclude each other")
        outputs = self.outputs(items)
        base = source or "(SELECT 1 AS `__one`)"
        if where:
            base = f"(SELECT * FROM {base} WHERE {where})" if by or rolling or slice_plan else base
        condition = f" WHERE {where}" if where and not (by or rolling or slice_plan) else ""
        base, condition, outputs, having = self.placed(base, condition, outputs, having, by, rolling)
        base, condition, outputs, having, order = self.lowered(base, condition, outputs, having, order, group, by, rolling is not None or slice_plan is not None)
        if slice_plan is not None:
            sql = self.by_slice(base, slice_plan, outputs)
        elif by:
            sql = self.by_window(base, by, outputs)
        elif rolling:
            sql = self.rolling(base, rolling, outputs)
        else:
            if limit is not None and limit < 0:
                # Sort keys ride along, so that the last rows can be put in order again.
                hidden = [(Expr(k.rsplit(" ", 3)[0]), f"__s{i}") for i, k in enumerate(order)]
                sql = self.plain(base, condition, [*outputs, *hidden], group, not_null, having)
                keys = [f"`__s{i}` {' '.join(k.rsplit(' ', 3)[1:])}" for i, k in enumerate(order)]
                return self.finish(sql, keys, limit, drop=[name for _, name in hidden])
            return self.finish(self.plain(base, condition, outputs, group, not_null, having), order, limit)
        if having:
            sql = f"SELECT * FROM ({sql}) WHERE {having}"
        return self.finish(sql, order, limit)

    def placed(self, base: str, condition: str, outputs: list, having: str | None, by: int | None, rolling: int | None) -> tuple:
        """A column for the places of a relation's rows, and aggregates that hang on the order of rows with it; joins have no places."""
        spark, time = self.session.spark, self.session.order
        texts = [e.sql for e, _ in outputs] + [having or ""]
        calls = {sql: render_aggregate(name, arguments, time, place=PLACE) for sql, name, arguments in self.p.aggregated if name in POSITIONAL and any(sql in x for x in texts)}
        bare = by and any(not e.aggregate and alias is not None and e.column != "_time" for e, alias in outputs)
        if len(self.aliases) != 1 or not (calls or bare):
            return base, condition, outputs, having
        kinds = {f.name: f.dataType.typeName() for f in spark.sql(f"SELECT * FROM {base}").schema.fields}
        if kinds.get(time) not in ("long", "integer", "short", "byte", "double", "float", "decimal"):
            return base, condition, outputs, having
        alias = re.search(r" AS `[^`]+`$", base)
        wrapped = lambda file: f"(SELECT *, struct({file} AS f, monotonically_increasing_id() AS r) AS `{PLACE}` FROM {base}{condition}){alias[0] if alias else ''}"
        try:
            made = wrapped("input_file_name()")
            spark.sql(f"SELECT * FROM {made}")
        except AnalysisException:  # of several files' joins there is no name
            made = wrapped("''")
        if rolling:
            return made, "", outputs, having  # it orders its parts itself
        pattern = re.compile("|".join(map(re.escape, sorted(calls, key=len, reverse=True))) or "(?!)")
        swap = lambda text: pattern.sub(lambda m: calls[m[0]], text)
        return made, "", [(replace(e, sql=swap(e.sql)), alias) for e, alias in outputs], having and swap(having)

    def lowered(self, base: str, condition: str, outputs: list, having: str | None, order: list[str], group: list[Expr] | None, by: int | None, other: bool) -> tuple:
        """Row numbers, previous values and quantiles as columns that operators add to a single relation; as plain SQL elsewhere."""
        wanted = self.p.lifted
        if not wanted:
            return base, condition, outputs, having, order
        aggregated = bool(group or by) or any(e.aggregate for e, _ in outputs)
        one = re.search(r" AS `([^`]+)`$", base)
        joined = len(self.aliases) > 1
        single = (joined or one is not None) and not other and not (joined and any(e.sql == "*" for e, _ in outputs))
        inside = {}
        for kind, name, arguments, sql in wanted:
            if single and (kind == "quantile") == aggregated:
                inside[name] = (kind, arguments)
            else:
                # any_value of a quantile goes with the column that stands for it.
                swap = lambda text, name=name, sql=sql: text.replace(f"any_value({name})", sql).replace(name, sql)
                outputs = [(replace(e, sql=swap(e.sql)), alias) for e, alias in outputs]
                having, order = having and swap(having), [swap(k) for k in order]
        if not inside:
            return base, condition, outputs, having, order
        spark, time = self.session.spark, self.session.order
        name_of = "__joined" if joined else one[1]
        if joined:
            base, condition = self.as_structs(base, condition), ""
        keys = [g.sql for g in group or []]
        shown = "".join(f", {k} AS `__key{i}`" for i, k in enumerate(keys))
        shown += "".join(f", {arguments[0]} AS `__value{i}`" for i, (kind, arguments) in enumerate(inside.values()) if kind == "quantile")
        df = spark.sql(f"SELECT *{shown} FROM {base}{condition}")
        names = [f"__key{i}" for i in range(len(keys))]
        if by:
            df, names = df.withColumn("__key0", timeseries.bucket(by)), ["__key0"]
        for i, (name, (kind, arguments)) in enumerate(inside.items()):
            plain = name.strip("`")
            if kind == "number":
                # What nothing names later isn't written down.
                later = " ".join([*(e.sql for e, _ in outputs), having or "", *order, *(str(a) for _, a in list(inside.values())[i + 1 :]), time]).lower()
                everything = joined or any(e.sql.endswith("*") for e, _ in outputs)
                keep = [c for c in df.columns if everything or c.startswith("__") or "`" in c or c.lower() in later]
                df = relational.numbered_globally(df, list(arguments[0]), plain, list(arguments[1]), keep)
            elif kind == "previous":
                df = timeseries.previous(df, arguments[0], [time], plain)
            else:
                df = quantiles.with_quantile(df, names, f"__value{i}", arguments[1], plain)
        added = [c for c in df.columns if c.startswith("__key") or c.startswith("__value")]
        return f"{self.view(df.drop(*added))} AS `{name_of}`", "", outputs, having, order

    def as_structs(self, base: str, condition: str) -> str:
        """A join as one relation: a struct for each side under its name, and the columns whose names are no other's."""
        spark = self.session.spark
        names = [n for a in self.aliases for n in spark.sql(f"SELECT `{a}`.* FROM {base}").columns]
        alone = [f"`{n}`" for n in names if names.count(n) == 1 and n not in self.aliases]
        sides = [f"struct(`{a}`.*) AS `{a}`" for a in self.aliases]
        return f"{self.view(spark.sql(f'SELECT {", ".join([*sides, *alone])} FROM {base}{condition}'))} AS `__joined`"

    def finish(self, sql: str, order: list[str], limit: int | None, drop: list[str] | None = None) -> str:
        if limit is not None and limit < 0:
            if not order:
                raise SqlError("a negative LIMIT needs ORDER BY")
            last = self.session.spark.sql(f"SELECT * FROM ({sql}){self._order_text(self._flipped(order))}").limit(-limit)
            again = self.session.spark.sql(f"SELECT * FROM {self.view(last)}{self._order_text(order)}")
            return f"SELECT * FROM {self.view(again.drop(*(drop or [])))}"
        sql += self._order_text(order)
        return sql if limit is None else f"{sql} LIMIT {limit}"

    @staticmethod
    def _order_text(order: list[str]) -> str:
        return f" ORDER BY {', '.join(order)}" if order else ""

    @staticmethod
    def _flipped(order: list[str]) -> list[str]:
        return [k[: -len(" ASC NULLS LAST")] + " DESC NULLS FIRST" if k.endswith(" ASC NULLS LAST") else k[: -len(" DESC NULLS LAST")] + " ASC NULLS FIRST" for k in order]

    def items(self) -> list[tuple[Expr, str | None]]:
        out = []
        while True:
            if self.p.take_op("*"):
                out.append((Expr("*"), None))
            elif self.p.peek().kind in ("word", "quoted") and self.p.is_op(".", ahead=1) and self.p.is_op("*", ahead=2):
                table = self.p.name()
                self.p.k += 2
                out.append((Expr(f"`{table}`.*"), None))
            else:
                e = self.p.expression()
                alias = None
                if self.p.take_word("AS") or self.p.peek().kind == "quoted" or self.p.peek().kind == "word" and self.p.peek().upper not in STOP:
                    alias = self.p.name()
                out.append((e, alias))
            if not self.p.take_op(","):
                return out

    def outputs(self, items: list[tuple[Expr, str | None]]) -> list[tuple[Expr, str | None]]:
        """Items with their output names: an alias, else the column's own name, qualified where that isn't unique."""
        plain = [e.column for e, alias in items if e.column and not alias]
        out, unnamed = [], 0
        for e, alias in items:
            if e.sql.endswith("*"):
                out.append((e, None))
                continue
            if alias is None:
                if e.column:
                    alias = e.column if plain.count(e.column) == 1 else e.name
                elif e.name:
                    alias = e.name
                else:
                    unnamed += 1
                    alias = f"Unnamed_{unnamed}"
            if e.parts > 1:
                out += [(replace(e, sql=f"{e.sql}.c{k}", parts=1), f"{alias}_{k}") for k in range(e.parts)]
            else:
                out.append((e, alias))
        return out

    @staticmethod
    def _list(outputs: list[tuple[Expr, str | None]]) -> str:
        return ", ".join(e.sql if alias is None else f"{e.sql} AS `{alias}`" for e, alias in outputs)

    def plain(self, base: str, condition: str, outputs: list, group: list[Expr] | None, not_null: bool, having: str | None) -> str:
        if group and not_null:
            extra = " AND ".join(f"{g.sql} IS NOT NULL" for g in group)
            condition = f"{condition} AND {extra}" if condition else f" WHERE {extra}"
        if group:
            outputs = self.with_span(base, outputs)
            # Group keys show in the output where the list doesn't name them.
            named = {e.sql for e, _ in outputs} | {f"`{e.column}`" for e, _ in outputs if e.column}
            keys = [(g, g.column or g.sql) for g in group if g.sql not in named and f"`{g.column}`" not in named]
            outputs = [*keys, *outputs]
        sql = f"SELECT {self._list(outputs)} FROM {base}{condition}"
        if group:
            sql += " GROUP BY " + ", ".join(g.sql for g in group)
        if having:
            if not group and not any(e.aggregate for e, _ in outputs):
                raise SqlError("HAVING needs an aggregate")
            sql += f" HAVING {having}"
        return sql

    def with_span(self, base: str, outputs: list) -> list:
        """In groups of a time table `_start_time` and `_end_time` are the group's first and last time."""
        spans = {"_start_time": "min(`_time`)", "_end_time": "max(`_time`)"}
        if not any(e.column in spans for e, _ in outputs):
            return outputs
        columns = self.session.spark.sql(f"SELECT * FROM {base}").columns
        if "_time" not in columns:
            return outputs
        return [(Expr(spans[e.column], aggregate=True), alias) if e.column in spans and e.column not in columns else (e, alias) for e, alias in outputs]

    def by_window(self, base: str, width: int, outputs: list) -> str:
        df = self.session.spark.sql(f"SELECT * FROM {base}")
        if not any(e.aggregate for e, _ in outputs):
            columns = [e for e, _ in outputs if e.column and e.column != "_time"]
            if not columns:
                return f"SELECT * FROM {self.view(timeseries.by_window(df, width))}"
        aggregates = []
        for e, alias in outputs:
            if e.column == "_time" or alias is None:
                continue
            first = order_of_rows(self.session.order, PLACE) if PLACE in df.columns else self.session.order
            aggregates.append(F.expr(e.sql if e.aggregate else f"min_by({e.sql}, {first})").alias(alias))
        return f"SELECT * FROM {self.view(timeseries.by_window(df, width, *aggregates))}"

    def rolling(self, base: str, width: int, outputs: list) -> str:
        df = self.session.spark.sql(f"SELECT * FROM {base}")
        calls = {sql: (name, arguments) for sql, name, arguments in self.p.aggregated if any(sql in e.sql for e, _ in outputs)}
        calls |= {e.sql: ("", []) for e, _ in outputs if e.aggregate and not any(sql in e.sql for sql in calls)}
        names = {sql: f"__r{k}" for k, sql in enumerate(calls)}
        pattern = re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True))) or "(?!)")
        made = {names[sql]: (name, arguments[0]) if name in timeseries.MERGED else F.expr(sql) for sql, (name, arguments) in calls.items()}
        order = (order_of_rows(self.session.order, PLACE), order_of_rows(self.session.order, PLACE, last=True)) if PLACE in df.columns else None
        hidden = [*made, *[PLACE] * (PLACE in df.columns)]
        view = self.view(timeseries.rolling(df, width, made, order=order))
        swapped = [(replace(e, sql=pattern.sub(lambda m: f"`{names[m[0]]}`", e.sql)) if e.aggregate else e, alias) for e, alias in outputs]
        shown = ", ".join(f"* EXCEPT ({', '.join(hidden)})" if e.sql == "*" and hidden else self._list([(e, alias)]) for e, alias in swapped)
        return f"SELECT {shown} FROM {view}"

    def by_slice(self, base: str, plan: DataFrame, outputs: list) -> str:
        df = self.session.spark.sql(f"SELECT * FROM {base}")
        aggregates = [F.expr(e.sql).alias(alias) for e, alias in sorted(outputs, key=lambda o: o[1] or "") if e.aggregate]
        return f"SELECT * FROM {self.view(slices.by_slice(df, plan, *aggregates))}"

    # sources
    def source(self) -> str:
        """FROM with its joins; views' columns keep their names, aliases qualify them."""
        sql = self.relation()
        first = self.p.base_table
        while True:
            p = self.p
            p.base_table = first
            if p.take_word("INNER", "JOIN") or p.take_word("JOIN"):
                kind = "INNER"
            elif p.take_word("LEFT", "OUTER", "JOIN") or p.take_word("LEFT", "JOIN"):
                kind = "LEFT"
            elif p.take_word("RIGHT", "OUTER", "JOIN") or p.take_word("RIGHT", "JOIN"):
                kind = "RIGHT"
            elif p.take_word("FULL", "OUTER", "JOIN") or p.take_word("FULL", "JOIN") or p.take_word("OUTER", "JOIN"):
                kind = "FULL"
            else:
                return sql
            right = self.relation()
            p.need_word("ON")
            sql = f"{sql} {kind} JOIN {right} ON {p.expression().sql}"

    def table_name(self) -> str:
        parts = [self.p.name()]
        while self.p.is_op(".", "/") and self.p.peek(1).kind in ("word", "quoted"):
            self.p.next()
            parts.append(self.p.name())
        return ".".join(parts)

    def relation(self) -> str:
        p = self.p
        if p.is_op("("):
            p.next()
            inner = self.query()
            p.need_op(")")
            p.take_word("AS")
            self.aliases.append(p.name())
            return f"({inner}) AS `{self.aliases[-1]}`"
        if p.peek().kind == "word" and p.is_op("(", ahead=1):
            name = p.next().text.lower()
            view, shown = self.view(self.table_function(name)), name
        else:
            shown = self.table_name()
            view = self.session.resolve(shown)
            p.base_table = self.session.cte_tables.get(shown.lower(), shown)
        alias = shown.split(".")[-1]
        if shown.endswith(".time"):
            alias = shown.split(".")[-2]
        if p.take_word("AS"):
            alias = p.name()
        elif p.peek().kind in ("word", "quoted") and p.peek().upper not in STOP:
            alias = p.name()
        self.aliases.append(alias)
        return f"{view} AS `{alias}`"

    def arguments(self) -> list:
        """Literal arguments of a table function."""
        out = []
        self.p.need_op("(")
        while not self.p.take_op(")"):
            t = self.p.peek()
            if t.kind in ("string", "quoted"):
                self.p.next()
                out.append(unquote(t))
            elif self.p.is_op("[") or self.p.is_word("ARRAY"):
                self.p.take_word("ARRAY")
                self.p.need_op("[")
                items = []
                while not self.p.take_op("]"):
                    items.append(self._literal())
                    self.p.take_op(",")
                out.append(items)
            elif t.kind == "word" and t.upper not in ("NULL", "TRUE", "FALSE"):
                out.append(self.table_name())
            else:
                out.append(self._literal())
            self.p.take_op(",")
        return out

    def _literal(self):
        sign = -1 if self.p.take_op("-") else 1
        t = self.p.next()
        if t.kind == "number":
            return sign * (float(t.text) if re.search(r"[.eE]", t.text) else int(t.text))
        if t.kind == "string":
            return unquote(t)
        if t.kind == "time":
            return t.text
        return {"NULL": None, "TRUE": True, "FALSE": False}[t.upper]

    def table_function(self, name: str) -> DataFrame:
        session, args = self.session, self.arguments()
        if name == "nearest_neighbors":
            table, column, query, k, metric, _, with_ord = (args + [None] * 7)[:7]
            return vectors.nearest(session.table(table), column, _floats(query), int(k), metric or "l2", session.key_of(table), bool(with_ord))
        if name == "vector_search":
            index = session.vector_indexes[args[0].lower()]
            return vectors.nearest(session.table(index.table), index.column, _floats(args[1]), int(args[2]), index.metric, session.key_of(index.table))
        if name == "graph_neighbors":
            g, start, kind, hops, t0, t1 = (args + [None] * 6)[:6]
            edges, time = session.edges(g, kind)
            if "store" in session.graphs[session.short(g)]:
                start = start.rsplit(":", 1)[-1]  # a label may stand before the key
            return graph.neighbors(edges, start, int(hops), time, _ms(t0), _ms(t1))
        if name == "graph_paths":
            g, src, dst, hops, kind, t0, t1 = (args + [None] * 7)[:7]
            edges, time = session.edges(g, kind)
            return graph.path(edges, src, dst, int(hops), "cost" if "cost" in edges.columns else None, time, _ms(t0), _ms(t1))
        if name == "unnest":
            values = args[0] if isinstance(args[0], list) else [x for x in args[0].strip("{}").split(",") if x]
            return session.spark.createDataFrame([(None if v is None else str(v),) for v in values], "unnest string")
        if name.startswith("show_"):
            return session.show(name.removeprefix("show_"))
        if name in session.table_functions:
            return session.table_functions[name](*args)
        raise SqlError(f"unknown table function {name}")

    # intervals
    def slice_plan(self) -> DataFrame:
        """USING [LABELS(...)] source ((INTERSECT|UNION) source)..., applied from left to right."""
        p = self.p
        p.need_word("USING")
        labels: list[str] = []
        if p.take_word("LABELS"):
            p.need_op("(")
            labels = [p.name()]
            while p.take_op(","):
                labels.append(p.name())
            p.need_op(")")
        out = slices.merge(self.slice_source(labels))
        while p.is_word("INTERSECT", "UNION"):
            combine = slices.intersect if p.next().upper == "INTERSECT" else slices.union
            out = combine(out, slices.merge(self.slice_source(labels)))
        return out

    def slice_source(self, labels: list[str]) -> DataFrame:
        p = self.p
        if p.is_op("("):
            p.next()
            if p.is_op("("):
                rows = []
                while not p.take_op(")"):
                    p.need_op("(")
                    rows.append(self.slice_row())
                    p.take_op(",")
            else:
                rows = [self.slice_row()]
            return slices.manual(self.session.spark, rows, labels)
        if p.take_word("SLICE"):
            p.need_op("(")
            out = self.slice_plan()
            p.need_op(")")
            return out
        df = self.session.table(self.table_name())
        start, end, where, columns = slices.START, slices.END, None, {}
        while True:
            if p.take_word("ON"):
                start, end = p.name(), p.name()
            elif p.take_word("WHERE") or p.take_word("FILTER"):
                where = p.expression().sql
            elif p.take_word("LABEL"):
                p.need_op("(")
                found = []
                while not p.take_op(")"):
                    found.append(p.expression().sql)
                    p.take_op(",")
                names = labels or [f"label_{k + 1}" for k in range(len(found))]
                columns = {n: F.expr(e) for n, e in zip(names, found, strict=False)}
            else:
                return slices.from_table(df, start, end, where, columns)

    def slice_row(self) -> tuple:
        p, plain, named = self.p, [], {}
        while not p.take_op(")"):
            if p.peek().kind == "word" and p.is_op(":=", ahead=1):
                name = p.name()
                p.next()
                named[name] = self._literal()
            else:
                plain.append(self._literal())
            p.take_op(",")
        return (*plain, named) if named else tuple(plain)


def _floats(query) -> list[float]:
    if isinstance(query, list):
        return [float(x) for x in query]
    return [float(x) for x in re.split(r"[\s,]+", re.sub(r"[\[\]()]", " ", query).strip()) if x]


def _ms(x) -> int | None:
    return None if x is None else slices.to_ms(x)


def compile_query(session, text: str) -> str:
    """The Spark SQL of one query."""
    parser = ExpressionParser(tokenize(text), session, text)
    sql = Compiler(parser).query()
    parser.take_op(";")
    if parser.peek().kind != "end":
        parser.fail("the end")
    return sql


__all__ = ["AGGREGATES", "Compiler", "compile_query"]
