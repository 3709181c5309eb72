"""Expressions: a recursive descent parser that gives Spark SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions import scalars
from .lexer import SqlError, Token, sql_string, tokenize, unquote

AGGREGATES = "AVG MAX MIN SUM COUNT FIRST LAST STDEV DELTA HEIGHT GRADIENT QUANTILE ARRAY_AGG".split()
_COMPARE = {"=": "=", "!=": "<>", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?")
#: Words that end an expression.
STOP = set("FROM WHERE BY GROUP ROLLING HAVING ORDER LIMIT INTO UNION AS AND OR NOT THEN ELSE END WHEN ASC DESC USING ON INNER LEFT RIGHT FULL OUTER JOIN IS IN LIKE BETWEEN APPEND REPLACE NOTNULL LABEL INTERSECT FILTER".split())


@dataclass
class Expr:
    sql: str
    name: str | None = None  # the output name without an alias
    aggregate: bool = False
    column: str | None = None  # the last part of a column's name
    literal: str | None = None  # of a string
    is_text: bool = False
    is_array: bool = False
    is_null: bool = False
    parts: int = 1  # the results of a function that has several


def order_of_rows(order: str, place: str, last: bool = False) -> str:
    """What is least for the first row in ``order``, or for the last one; of rows that are equal there, the one with the least place."""
    return f"IF({order} IS NULL, NULL, struct({'-' * last}{order} AS o, {place} AS p))"


def render_aggregate(name: str, args: list[str], order: str = "_time", time: str = "_time", place: str | None = None) -> str:
    """SQL of an aggregate. With ``place``, a column, FIRST and LAST take the row of least place among those of one time."""
    e = args[0]
    first = f"min_by(struct({e} AS v), {order_of_rows(order, place) if place else order}).v"
    last = f"min_by(struct({e} AS v), {order_of_rows(order, place, last=True)}).v" if place else f"max_by(struct({e} AS v), {order}).v"
    forms = {
        "AVG": f"avg({e})", "MAX": f"max({e})", "MIN": f"min({e})", "SUM": f"sum({e})", "COUNT": f"count({e})", "FIRST": first, "LAST": last,
        "STDEV": f"stddev_samp({e})", "DELTA": f"({last} - {first})", "HEIGHT": f"(max({e}) - min({e}))",
        "GRADIENT": f"try_divide(cast({last} - {first} AS DOUBLE), cast(max({time}) - min({time}) AS DOUBLE))",
        "ARRAY_AGG": f"sort_array(collect_list(cast({e} AS STRING)))",
    }
    if name == "QUANTILE":
        share = float(args[1] if len(args) > 1 else "50") / 100
        values = f"sort_array(collect_list({e}))"
        return f"get({values}, cast(floor({share}D * (size({values}) - 1) + 0.5D) AS INT))"
    return forms[name]


def cast(x: str, kind: str) -> str:
    """A cast of the dialect: null where the value doesn't fit."""
    k = kind.lower().strip()
    if k.endswith("[]"):
        items = f"split(regexp_replace(cast({x} AS STRING), '[{{}}\\\\[\\\\]]', ''), '\\\\s*,\\\\s*')"
        return f"transform({items}, v -> {cast('v', k[:-2])})"
    base = re.sub(r"\(.*\)", "", k).strip()
    if base in ("bool", "boolean"):
        return f"try_cast({x} AS BOOLEAN)"
    if base in ("int", "int2", "int4", "int8", "integer", "bigint", "smallint"):
        return f"try_cast({x} AS BIGINT)"
    if base in ("float4", "float8", "real", "double precision", "double", "float", "numeric", "decimal"):
        return f"try_cast({x} AS DOUBLE)"
    if base == "regtype":
        return scalars.render("to_regtype", [x])
    if base in ("text", "varchar", "char", "uuid", "json", "jsonb", "timetz", "time", "string"):
        return f"regexp_replace(cast({x} AS STRING), '^(-?[0-9]+)\\\\.0$', '$1')"
    if base == "bytea":
        return f"cast({x} AS BINARY)"
    if base == "interval":
        part = lambda pattern, kind: f"coalesce(try_cast(nullif(regexp_extract({x}, '{pattern}', 1), '') AS {kind}), 0)"
        iso = f"make_dt_interval({part('P([0-9]+)D', 'INT')}, {part('T([0-9]+)H', 'INT')}, {part('T(?:[0-9]+H)?([0-9]+)M', 'INT')}, {part('T(?:[0-9]+[HM])*([0-9.]+)S', 'DECIMAL(18, 6)')})"
        return f"IF(cast({x} AS STRING) RLIKE '^P(?=[0-9T])', {iso}, make_dt_interval(0, 0, 0, try_cast({x} AS DECIMAL(18, 6))))".replace(f"({x}, '", f"(cast({x} AS STRING), '")
    if base in ("date", "timestamp", "timestamptz"):
        return f"coalesce(timestamp_millis(try_cast({x} AS BIGINT)), try_to_timestamp(cast({x} AS STRING)))"
    raise SqlError(f"unknown type {kind}")


def braced(text: str) -> str:
    """An array from text in braces."""
    items = [x.strip().strip('"') for x in text[1:-1].split(",")] if text[1:-1].strip() else []
    return f"array({', '.join(map(sql_string, items))})"


class ExpressionParser:
    """``compile_query(text)`` is what turns a nested SELECT into Spark SQL."""

    def __init__(self, tokens: list[Token], session, text: str):
        self.tokens, self.k, self.session, self.text = tokens, 0, session, text
        #: What the SELECT that is being read needs from an operator: kind, column that stands for it, arguments, and SQL where no operator can serve.
        self.lifted: list[tuple[str, str, tuple, str]] = []
        #: The aggregates that were read: SQL, name, arguments.
        self.aggregated: list[tuple[str, str, list[str]]] = []
        #: The table that the query before reads first.
        self.base_table: str | None = None

    def lift(self, kind: str, arguments: tuple, sql: str) -> str:
        name = f"`__lift{len(self.lifted)}`"
        self.lifted.append((kind, name, arguments, sql))
        return name

    # tokens
    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.k + ahead, len(self.tokens) - 1)]

    def next(self) -> Token:
        token = self.peek()
        self.k += 1
        return token

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        return self.peek(ahead).upper in words

    def is_op(self, *ops: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "op" and t.text in ops

    def take_word(self, *words: str) -> bool:
        """Take the words, in this order, if they come next."""
        if all(self.peek(i).upper == w for i, w in enumerate(words)):
            self.k += len(words)
            return True
        return False

    def take_op(self, op: str) -> bool:
        if self.is_op(op):
            self.k += 1
            return True
        return False

    def need_op(self, op: str) -> None:
        if not self.take_op(op):
            self.fail(f"{op!r}")

    def need_word(self, *words: str) -> None:
        if not self.take_word(*words):
            self.fail(" ".join(words))

    def fail(self, wanted: str) -> None:
        t = self.peek()
        raise SqlError(f"expected {wanted} at {t.at}, found {t.text or 'the end'!r}: {self.text[max(0, t.at - 20) : t.at + 20]!r}")

    def name(self) -> str:
        t = self.next()
        if t.kind == "quoted":
            return unquote(t)
        if t.kind != "word":
            self.k -= 1
            self.fail("a name")
        return t.text

    # expressions
    def expression(self) -> Expr:
        left = self.conjunction()
        while self.take_word("OR"):
            right = self.conjunction()
            left = Expr(f"({left.sql} OR {right.sql})", aggregate=left.aggregate or right.aggregate)
        return left

    def conjunction(self) -> Expr:
        left = self.negation()
        while self.take_word("AND"):
            right = self.negation()
            left = Expr(f"({left.sql} AND {right.sql})", aggregate=left.aggregate or right.aggregate)
        return left

    def negation(self) -> Expr:
        if self.is_word("NOT") and not self.is_word("EXISTS", ahead=1):
            self.next()
            inner = self.negation()
            return Expr(f"(NOT {inner.sql})", aggregate=inner.aggregate)
        return self.predicate()

    def predicate(self) -> Expr:
        if self.is_word("EXISTS") or self.is_word("NOT") and self.is_word("EXISTS", ahead=1):
            negated = self.take_word("NOT")
            self.need_word("EXISTS")
            return Expr(f"({'NOT ' if negated else ''}EXISTS ({self.subquery()}))")
        left = self.sum()
        while True:
            t = self.peek()
            if t.kind == "op" and t.text in _COMPARE:
                op = _COMPARE[self.next().text]
                if self.is_word("ANY", "SOME", "ALL") and self.is_op("(", ahead=1):
                    left = self.quantified(left, op, self.next().upper != "ALL")
                    continue
                right = self.sum()
                a, b = self.times(left, right)
                left = Expr(f"({a} {op} {b})", aggregate=left.aggregate or right.aggregate)
                continue
            negated = self.is_word("NOT") and self.is_word("LIKE", "BETWEEN", "IN", ahead=1)
            if negated:
                self.next()
            no = "NOT " if negated else ""
            if self.take_word("LIKE"):
                right = self.sum()
                left = Expr(f"({left.sql} {no}LIKE {right.sql})", aggregate=left.aggregate)
            elif self.take_word("BETWEEN"):
                low = self.sum()
                self.need_word("AND")
                high = self.sum()
                (_, a), (_, b) = self.times(left, low), self.times(left, high)
                left = Expr(f"({left.sql} {no}BETWEEN {a} AND {b})", aggregate=left.aggregate)
            elif self.take_word("IN"):
                if self.is_op("(") and self.is_word("SELECT", "WITH", ahead=1):
                    query = self.subquery()
                    left = Expr(self.none_of(left.sql, self.values_of(query)) if negated else f"({left.sql} IN ({query}))")
                else:
                    self.need_op("(")
                    items = [self.times(left, self.sum())[1]]
                    while self.take_op(","):
                        items.append(self.times(left, self.sum())[1])
                    self.need_op(")")
                    left = Expr(f"({left.sql} {no}IN ({', '.join(items)}))", aggregate=left.aggregate)
            elif self.is_word("IS"):
                self.next()
                no = "NOT " if self.take_word("NOT") else ""
                self.need_word("NULL")
                left = Expr(f"({left.sql} IS {no}NULL)", aggregate=left.aggregate)
            else:
                return left

    def times(self, a: Expr, b: Expr) -> tuple[str, str]:
        """ISO text beside a time column is epoch milliseconds."""

        def side(x: Expr, other: Expr) -> str:
            if x.literal and other.column and other.column.startswith("_") and _ISO.fullmatch(x.literal):
                return f"unix_millis(to_timestamp({x.sql}))"
            return x.sql

        return side(a, b), side(b, a)

    def values_of(self, query: str) -> str:
        """A subquery's value as `__v`, a name that no outer column has."""
        columns = self.session.spark.sql(query).columns
        value = next((c for c in columns if c != "_time"), columns[0])
        return f"(SELECT `{value}` AS `__v` FROM ({query}) AS `__s`) AS `__q`"

    def quantified(self, left: Expr, op: str, some: bool) -> Expr:
        """Inequalities need the least and greatest value alone; equality is a semi-join."""
        values, x = self.values_of(self.subquery()), left.sql
        least, most = (f"(SELECT {f}(`__v`) FROM {values})" for f in ("min", "max"))
        same = f"EXISTS (SELECT 1 FROM {values} WHERE `__v` = {x})"
        if some:
            if op == "=":
                return Expr(f"({same})")
            rules = {"<": f"{x} < {most}", "<=": f"{x} <= {most}", ">": f"{x} > {least}", ">=": f"{x} >= {least}", "<>": f"{x} <> {least} OR {x} <> {most}"}
            return Expr(f"coalesce({rules[op]}, false)")
        if op == "<>":
            return Expr(self.none_of(x, values))
        rules = {"<": f"{x} < {least}", "<=": f"{x} <= {least}", ">": f"{x} > {most}", ">=": f"{x} >= {most}", "=": f"{x} = {least} AND {x} = {most}"}
        # True over no values at all, never where one is null.
        return Expr(f"((SELECT count(1) FROM {values}) = 0 OR (SELECT count_if(`__v` IS NULL) FROM {values}) = 0 AND coalesce({rules[op]}, false))")

    @staticmethod
    def none_of(x: str, values: str) -> str:
        """NOT IN: an anti-join, and counts that a null in the values or on the left decides by."""
        absent = f"NOT EXISTS (SELECT 1 FROM {values} WHERE `__v` = {x})"
        return f"({absent} AND (SELECT count_if(`__v` IS NULL) FROM {values}) = 0 AND ({x} IS NOT NULL OR (SELECT count(1) FROM {values}) = 0))"

    def subquery(self) -> str:
        """SQL of a parenthesised query."""
        self.need_op("(")
        table = self.base_table
        sql = self.session.compiler(self).query()
        self.base_table = table
        self.need_op(")")
        return sql

    def sum(self) -> Expr:
        left = self.product()
        while self.is_op("+", "-", "||"):
            op = self.next().text
            right = self.product()
            both = left.aggregate or right.aggregate
            if op == "||" and (left.is_null or right.is_null):  # nothing is added
                left = left if right.is_null else right
            elif op == "||" and (left.is_array or right.is_array):
                in_braces = lambda x: x.literal is not None and re.fullmatch(r"\{.*\}", x.literal)
                sides = [x.sql if x.is_array or x.column else braced(x.literal) if in_braces(x) else f"array({x.sql})" for x in (left, right)]
                left = Expr(f"concat({', '.join(sides)})", aggregate=both, is_array=True)
            elif op == "||" or op == "+" and (left.is_text or right.is_text):
                left = Expr(f"concat({left.sql}, {right.sql})", aggregate=both, is_text=True)
            else:
                left = Expr(f"({left.sql} {op} {right.sql})", aggregate=left.aggregate or right.aggregate)
        return left

    def product(self) -> Expr:
        left = self.unary()
        while self.is_op("*", "/", "%"):
            op = self.next().text
            right = self.unary()
            both = left.aggregate or right.aggregate
            if op == "/":
                left = Expr(f"try_divide(cast({left.sql} AS DOUBLE), cast({right.sql} AS DOUBLE))", aggregate=both)
            else:
                left = Expr(f"({left.sql} {op} {right.sql})", aggregate=both)
        return left

    def unary(self) -> Expr:
        if self.take_op("-"):
            inner = self.unary()
            return Expr(f"(-{inner.sql})", aggregate=inner.aggregate)
        self.take_op("+")
        return self.postfix()

    def postfix(self) -> Expr:
        e = self.primary()
        while True:
            if self.take_op("::"):
                kind = self.type_name()
                if kind.lower() == "regclass" and e.literal is not None:
                    e = Expr(str(self.session.relation_oid(e.literal)), e.name)
                else:
                    e = Expr(cast(e.sql, kind), e.name, e.aggregate, is_array=kind.endswith("[]"), is_text=kind.lower() in ("text", "varchar"))
            elif self.is_op("["):
                e = self.slice(e)
            else:
                return e

    def type_name(self) -> str:
        words = [self.name()]
        if words[0].lower() == "double" and self.is_word("PRECISION"):
            words.append(self.next().text)
        text = " ".join(words)
        if self.take_op("("):
            while not self.take_op(")"):
                self.next()
        if self.is_op("[") and self.is_op("]", ahead=1):
            self.k += 2
            text += "[]"
        return text

    def slice(self, e: Expr) -> Expr:
        self.need_op("[")
        parts: list[str | None] = [None]
        colons = 0
        while not self.is_op("]"):
            if self.take_op(":"):
                colons += 1
                parts.append(None)
            elif self.is_op("::"):
                self.next()
                colons += 2
                parts += [None, None]
            else:
                inner = self.sum()
                if inner.literal is not None and parts[-1] is None:  # a pattern bound: where it stands
                    place = f"nullif(instr({e.sql}, {inner.sql}), 0) - 1"
                    parts[-1] = place if colons == 0 else f"coalesce({place}, length({e.sql}))"
                else:
                    parts[-1] = inner.sql
        self.need_op("]")
        if not colons:
            return Expr(scalars.render("array_at", [e.sql, parts[0] or "0"]), aggregate=e.aggregate)
        start, stop, step = (parts + [None, None])[:3]
        step = step.strip("()") if step else None
        return Expr(scalars.string_slice(e.sql, start, stop, step), aggregate=e.aggregate, is_text=True)

    def primary(self) -> Expr:
        t = self.peek()
        if t.kind == "number":
            self.next()
            return Expr(t.text + ("D" if "." in t.text or "e" in t.text.lower() else ""))
        if t.kind == "time":
            self.next()
            return Expr(f"unix_millis(to_timestamp('{t.text}'))")
        if t.kind == "string":
            self.next()
            text = unquote(t)
            return Expr(sql_string(text), literal=text, is_text=True)
        if t.kind == "fstring":
            self.next()
            return self.fstring(t.text[2:-1].replace("''", "'"))
        if self.is_op("("):
            if self.is_word("SELECT", "WITH", ahead=1):
                return Expr(f"({self.subquery()})")
            self.next()
            inner = self.expression()
            self.need_op(")")
            return Expr(f"({inner.sql})", aggregate=inner.aggregate, is_text=inner.is_text)
        if t.kind == "quoted":
            return self.reference()
        if t.kind != "word":
            self.fail("an expression")
        if t.upper in ("NULL", "TRUE", "FALSE"):
            self.next()
            return Expr(t.upper, is_null=t.upper == "NULL")
        if t.upper == "CASE":
            return self.case()
        if t.upper == "ARRAY" and self.is_op("[", ahead=1):
            self.k += 2
            items = []
            while not self.take_op("]"):
                items.append(self.expression().sql)
                self.take_op(",")
            return Expr(f"array({', '.join(items)})", is_array=True)
        if t.upper == "CAST" and self.is_op("(", ahead=1):
            self.k += 2
            inner = self.expression()
            self.need_word("AS")
            kind = self.type_name()
            self.need_op(")")
            return Expr(cast(inner.sql, kind), aggregate=inner.aggregate)
        if t.upper == "PG_CATALOG" and self.is_op(".", ahead=1) and self.is_op("(", ahead=3):
            self.k += 2
        if self.is_op("(", ahead=1):
            return self.call()
        if t.upper == "PREVIOUS" and self.is_op(".", ahead=1):
            self.k += 2
            column = self.name()
            return Expr(self.lift("previous", (column,), f"lag(`{column}`) OVER (ORDER BY {self.session.order})"), name=f"PREVIOUS.{column}")
        return self.reference()

    def reference(self) -> Expr:
        parts = [self.name()]
        while self.is_op(".") and self.peek(1).kind in ("word", "quoted"):
            self.next()
            parts.append(self.name())
        sql = ".".join(f"`{p}`" for p in parts[-2:])
        return Expr(sql, ".".join(parts[-2:]), column=parts[-1])

    def case(self) -> Expr:
        self.next()
        out, aggregate = "CASE", False
        while self.take_word("WHEN"):
            condition = self.expression()
            self.need_word("THEN")
            value = self.expression()
            out += f" WHEN {condition.sql} THEN {value.sql}"
            aggregate |= condition.aggregate or value.aggregate
        if self.take_word("ELSE"):
            value = self.expression()
            out += f" ELSE {value.sql}"
            aggregate |= value.aggregate
        self.need_word("END")
        return Expr(out + " END", aggregate=aggregate)

    def fstring(self, body: str) -> Expr:
        parts, at = [], 0
        for m in re.finditer(r"\{\{|\}\}|\{([^{}]*)\}", body):
            parts.append(sql_string(body[at : m.start()]))
            at = m.end()
            if m[1] is None:
                parts.append(sql_string(m[0][0]))
                continue
            inner = ExpressionParser(tokenize(m[1]), self.session, m[1]).expression()
            parts.append(f"regexp_replace(cast({inner.sql} AS STRING), '^(-?[0-9]+)\\\\.0$', '$1')")
        parts.append(sql_string(body[at:]))
        return Expr(f"concat({', '.join(p for p in parts if p != repr(''))})", is_text=True)

    def call(self) -> Expr:
        name = self.next().text
        upper = name.upper()
        self.need_op("(")
        if upper in ("DATEPART", "DATEADD", "DATEDIFF"):
            part = self.next().text.strip("'")
            args = []
            while self.take_op(","):
                args.append(self.expression().sql)
            self.need_op(")")
            return Expr(getattr(scalars, upper.lower())(part, *args), name=upper)
        if upper == "EXTRACT":
            field = self.next().text.strip("'")
            self.need_word("FROM")
            inner = self.expression()
            self.need_op(")")
            return Expr(scalars.render("extract", [field, inner.sql]), aggregate=inner.aggregate)
        if upper == "ROW_NUMBER":
            self.need_op(")")
            return self.row_number()
        if upper == "COUNT" and self.take_op("*"):
            self.need_op(")")
            self.aggregated.append(("count(1)", "COUNT", ["1"]))
            return Expr("count(1)", "COUNT(*)", True)
        args: list[Expr] = []
        start = self.peek().at
        while not self.is_op(")"):
            args.append(self.expression())
            if not self.take_op(","):
                break
        end = self.peek().at
        self.need_op(")")
        sqls = [a.sql for a in args]
        shown = self.text[start:end].strip()
        if upper in AGGREGATES:
            label = f"_{sqls[1] if len(sqls) > 1 else 50}_QUANTILE({args[0].name or shown})" if upper == "QUANTILE" else f"{upper}({shown})"
            sql = render_aggregate(upper, sqls, self.session.order)
            self.aggregated.append((sql, upper, sqls))
            if upper == "QUANTILE":
                sql = f"any_value({self.lift('quantile', (sqls[0], float(sqls[1] if len(sqls) > 1 else '50')), sql)})"
            return Expr(sql, label, True)
        inside = any(a.aggregate for a in args)
        udf = self.session.udfs.get(name.lower())
        if udf is not None:
            if udf.kind == "aggregate":
                self.aggregated.append((f"{udf.registered}({', '.join(sqls)})", name, sqls))
            return Expr(f"{udf.registered}({', '.join(sqls)})", aggregate=inside or udf.kind == "aggregate", parts=len(udf.returns))
        if upper in ("ARRAY_TO_STRING", "ARRAY_LENGTH", "ARRAY_AT", "ARRAY_CAT"):
            sqls = [braced(a.literal) if a.literal and re.fullmatch(r"\{.*\}", a.literal) else a.sql for a in args]
        sql = scalars.render(name, sqls, self.session.settings)
        if sql is None:
            raise SqlError(f"unknown function {name}")
        return Expr(sql, aggregate=inside)

    def row_number(self) -> Expr:
        self.need_word("OVER")
        self.need_op("(")
        partition, keys = "", []
        if self.take_word("PARTITION", "BY"):
            keys = [self.expression().sql]
            while self.take_op(","):
                keys.append(self.expression().sql)
            partition = f"PARTITION BY {', '.join(keys)} "
        order = self.order_keys() if self.take_word("ORDER", "BY") else []
        self.need_op(")")
        sql = f"cast(row_number() OVER ({partition}ORDER BY {', '.join(order) or '1'}) AS BIGINT)"
        return Expr(self.lift("number", (tuple(order), tuple(keys)), sql), "rn")

    def order_keys(self) -> list[str]:
        """Sort keys, nulls last either way; similarity functions come greatest first."""
        keys = []
        while True:
            text = self.peek().text.lower()
            e = self.expression()
            down = text in ("cosine_sim", "vec_ip")
            if self.take_word("USING"):
                self.next()  # ANN or EXACT: every search here is exact
            if self.take_word("ASC"):
                down = False
            elif self.take_word("DESC"):
                down = True
            keys.append(f"{e.sql} {'DESC' if down else 'ASC'} NULLS LAST")
            if not self.take_op(","):
                return keys
