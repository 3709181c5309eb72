"""Statements other than queries: definitions, changes, settings, key/value and graph commands."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timeseries, vectors
from ..sources import graphstore
from ..sources.keyvalue import KeyValueStore
from .compiler import Compiler, compile_query
from .expressions import ExpressionParser
from .lexer import SqlError, tokenize, unquote

#: Stored types by the words of a column's declared type.
_TYPES = [("[]", None), ("vector", "array<double>"), ("bool", "boolean"), ("timestamp", "timestamp"), ("date", "date"), ("int", "bigint"), ("serial", "bigint"), ("double", "double"), ("real", "double"), ("float", "double"), ("numeric", "double"), ("decimal", "double")]


def stored_type(words: str) -> str:
    w = words.lower()
    if w.endswith("[]"):
        return f"array<{stored_type(w[:-2])}>"
    return next((kind for key, kind in _TYPES if kind and key in w), "string")


class Statements:
    def __init__(self, session, text: str):
        self.session, self.text = session, text
        self.p = ExpressionParser(tokenize(text), session, text)
        self.c = Compiler(self.p)

    def store(self):
        if self.session.store is None:
            raise SqlError("this session has no storage root")
        return self.session.store

    def condition(self) -> str | None:
        return self.p.expression().sql if self.p.take_word("WHERE") else None

    def if_not_exists(self) -> bool:
        return self.p.take_word("IF", "NOT", "EXISTS")

    def names(self) -> list[str]:
        self.p.need_op("(")
        out = [self.p.name()]
        while self.p.take_op(","):
            out.append(self.p.name())
        self.p.need_op(")")
        return out

    def run(self) -> DataFrame | None:
        p, s = self.p, self.session
        first = p.peek().upper
        if first in ("SELECT", "WITH") or p.is_op("("):
            s.into = None
            df = s.spark.sql(self.c.query())
            if s.into:
                table, mode = s.into
                s.into = None
                if table.endswith(".time"):
                    twice = df.groupBy("_time").count().where("count > 1 OR _time IS NULL").limit(1).count()
                    if twice:
                        raise SqlError("a time table needs one row for each _time")
                self.store().into(s.short(table), df, mode)
                return None
            return df
        handler = getattr(self, f"do_{first.lower()}", None)
        if handler is None:
            p.fail("a statement")
        p.next()
        return handler()

    # queries that aren't SELECT
    def do_slice(self) -> DataFrame:
        return self.c.slice_plan()

    def do_explain(self) -> DataFrame:
        sql = self.c.query()
        return self.session.spark.sql(f"EXPLAIN FORMATTED {sql}")

    def do_calculate(self) -> None:
        sensor = self.p.name()
        self.p.need_word("AS")
        df = self.session.spark.sql(self.c.query())
        if not self.p.base_table:
            raise SqlError("CALCULATE needs a table to read and to write")
        value = next(c for c in df.columns if c != "_time")
        self.store().append(self.session.short(self.p.base_table), timeseries.calculate(df, sensor, value))

    def do_match(self) -> DataFrame:
        return self.session.spark.sql(compile_query(self.session, match_select(self.session, self.text)))

    # definitions
    def do_create(self) -> None:
        p, s = self.p, self.session
        if p.take_word("TIME", "TABLE"):
            self.if_not_exists()
            name = self.c.table_name()
            if not name.endswith(".time"):
                raise SqlError("a time table's name ends with .time")
            self.store().create(s.short(name))
        elif p.take_word("TABLE"):
            quiet = self.if_not_exists()
            name = s.short(self.c.table_name())
            if self.store().exists(name):
                if quiet:
                    return
                raise SqlError(f"{name} is there already")
            columns, key, parts = {}, [], []
            if p.take_op("("):
                while not p.take_op(")"):
                    if p.take_word("PRIMARY", "KEY"):
                        key = self.names()
                    else:
                        column, words = p.name(), ""
                        while not p.is_op(",", ")") and not p.is_word("PRIMARY", "NOT"):
                            if p.take_op("("):
                                while not p.take_op(")"):
                                    p.next()
                                continue
                            words += p.next().text
                        if p.take_word("PRIMARY", "KEY"):
                            key = [column]
                        if p.take_word("NOT"):
                            p.need_word("NULL")
                        columns[column] = stored_type(words)
                    p.take_op(",")
            while True:
                if p.take_word("PRIMARY", "KEY"):
                    key = self.names()
                elif p.take_word("PARTITION", "BY"):
                    parts = self.names()
                else:
                    break
            self.store().create(name, columns, primary_key=key, partitions=parts)
        elif p.take_word("MATCH", "VIEW"):
            name = p.name()
            p.need_word("AS")
            s.view_texts[s.short(name)] = match_select(s, self.text[p.peek().at :])
        elif p.take_word("VIEW") or p.take_word("OR", "ALTER", "VIEW"):
            name = s.short(self.c.table_name())
            p.need_word("AS")
            s.view_texts[name] = self.text[p.peek().at :].rstrip().rstrip(";")
        elif p.take_word("VECTOR", "INDEX"):
            name = p.name()
            p.need_word("ON")
            table = self.c.table_name()
            column = self.names()[0]
            if p.take_word("USING"):
                if p.name().lower() != "hnsw":
                    raise SqlError("only hnsw indexes")
            options = self.options() if p.take_word("WITH") else {}
            index = vectors.VectorIndex(name, s.short(table), column, str(options.pop("metric", "l2")), options.pop("dim", None), str(options.pop("mode", "rebuild_only")).upper(), options)
            s.vector_indexes[name.lower()] = index
        elif p.take_word("GRAPH"):
            self.create_graph()
        elif p.take_word("STORE"):
            s.kv[s.short(self.c.table_name())] = KeyValueStore()
        elif p.is_word("DATABASE", "SCHEMA"):
            kind = p.next().text.lower()
            self.if_not_exists()
            s.settings.setdefault(f"{kind}s", "")
            s.settings[f"{kind}s"] = ",".join(x for x in [*s.settings[f"{kind}s"].split(","), p.name()] if x)
        else:
            p.fail("what to create")

    def options(self) -> dict:
        out = {}
        self.p.need_op("(")
        while not self.p.take_op(")"):
            key = self.p.name().lower()
            self.p.need_op("=")
            out[key] = self.c._literal()
            self.p.take_op(",")
        return out

    def create_graph(self) -> None:
        """GRAPH name NODES(Label KEY(c), ...) EDGES(T FROM A TO B, ...) USING TABLES(nodes=..., edges=...[, src=, dst=, cost=, time=])."""
        p, s = self.p, self.session
        name, kinds = self.c.table_name(), ["edge"]
        while p.peek().kind != "end" and not p.is_op(";"):
            if p.take_word("EDGES"):
                p.need_op("(")
                kinds, fresh = [], True
                while not p.take_op(")"):
                    t = p.next()
                    if fresh:
                        kinds.append(t.text)
                    fresh = t.text == ","
            elif p.take_word("GRAPHSTORE"):
                s.graphs[s.short(name)] = {"edges": {}, "store": s.short(name)}
                graphstore.create(self.store(), s.short(name))
            elif p.take_word("TABLES"):
                p.need_op("(")
                options = {}
                while not p.take_op(")"):
                    key = p.name().lower()
                    p.need_op("=")
                    options[key] = unquote(p.next()) if p.peek().kind == "string" else self.c.table_name()
                    p.take_op(",")
                for kind in kinds:
                    s.create_graph(name, options["edges"], options.get("src", "src"), options.get("dst", "dst"), options.get("cost", "cost"), options.get("time", "_time"), kind)
            else:
                p.next()

    def do_drop(self) -> None:
        p, s = self.p, self.session
        if p.take_word("VIEW"):
            s.view_texts.pop(s.short(self.c.table_name()), None)
        elif p.take_word("VECTOR", "INDEX"):
            s.vector_indexes.pop(p.name().lower(), None)
        elif p.take_word("GRAPH"):
            s.graphs.pop(s.short(self.c.table_name()), None)
        elif p.take_word("STORE"):
            s.kv.pop(s.short(self.c.table_name()), None)
        elif p.take_word("KEY"):
            key = self.key()
            self.kv().drop(key)
        elif p.take_word("TIME", "TABLE") or p.take_word("TABLE"):
            quiet = p.take_word("IF", "EXISTS")
            name = s.short(self.c.table_name())
            if not quiet and not self.store().exists(name):
                raise SqlError(f"unknown table {name}")
            self.store().drop(name)
        elif p.take_word("SCRIPT"):
            s.udfs.pop(p.name().lower(), None)
        else:
            p.fail("what to drop")

    def do_rename(self) -> None:
        p, s = self.p, self.session
        if p.take_word("KEY"):
            old = self.key_name()
            p.need_word("TO")
            new = self.key_name()
            self.kv().rename(old, new)
            return
        p.take_word("TIME")
        p.need_word("TABLE")
        old = s.short(self.c.table_name())
        p.need_word("TO")
        self.store().rename(old, s.short(self.c.table_name()))

    def do_alter(self) -> None:
        p, s = self.p, self.session
        if p.take_word("VECTOR", "INDEX"):
            index = s.vector_indexes[p.name().lower()]
            p.need_word("SET", "MODE")
            index.mode = p.name().upper()
            return
        p.need_word("TABLE")
        name = s.short(self.c.table_name())
        store = self.store()
        if p.take_word("ADD", "PRIMARY", "KEY"):
            store.alter(name, "primary_key", *self.names())
        elif p.take_word("DROP", "PRIMARY", "KEY"):
            store.alter(name, "primary_key")
        elif p.take_word("ADD", "CONSTRAINT"):
            constraint = p.name()
            p.need_word("USING")
            store.alter(name, "constraint", constraint, p.name())
        elif p.take_word("DROP", "CONSTRAINT"):
            store.alter(name, "drop_constraint", p.name())
        elif p.take_word("ADD"):
            p.take_word("COLUMN")
            store.alter(name, "add", p.name(), stored_type(p.type_name()))
        elif p.take_word("RENAME"):
            p.take_word("COLUMN")
            old = p.name()
            p.need_word("TO")
            store.alter(name, "rename", old, p.name())
        elif p.take_word("ALTER"):
            p.take_word("COLUMN")
            column = p.name()
            p.need_word("TYPE")
            store.alter(name, "type", column, stored_type(p.type_name()))
        else:
            p.fail("what to alter")

    def do_schema(self) -> DataFrame | None:
        p, s = self.p, self.session
        if p.take_word("SHOW"):
            return self.describe(s.short(self.c.table_name()))
        p.need_word("ADD")
        column, kind = p.name(), p.type_name()
        p.need_word("TO")
        self.store().alter(s.short(self.c.table_name()), "lock", column, stored_type(kind))
        return None

    # changes
    def do_insert(self) -> None:
        p, s = self.p, self.session
        if p.take_word("NODE"):
            return self.do_insert_node()
        if p.take_word("EDGE"):
            return self.do_insert_edge()
        p.need_word("INTO")
        name = s.short(self.c.table_name())
        columns = self.names() if p.is_op("(") and not p.is_word("SELECT", ahead=1) else None
        store = self.store()
        if p.take_word("VALUES"):
            rows = []
            while True:
                p.need_op("(")
                values = [p.expression().sql]
                while p.take_op(","):
                    values.append(p.expression().sql)
                p.need_op(")")
                rows.append(f"({', '.join(values)})")
                if not p.take_op(","):
                    break
            df = s.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)}")
        else:
            df = s.spark.sql(self.c.query())
        columns = columns or list(store.meta(name).columns)
        if name.endswith(".time"):
            columns = ["_time" if c.upper() == "ID" else c for c in columns]
        store.append(name, df.toDF(*columns))

    def do_update(self) -> None:
        p = self.p
        name = self.session.short(self.c.table_name())
        p.need_word("SET")
        values = {}
        while True:
            column = p.name()
            p.need_op("=")
            values[column] = p.sum().sql
            if not p.take_op(","):
                break
        self.store().update(name, values, self.condition())

    def do_delete(self) -> None:
        p = self.p
        columns = None
        if p.take_word("COLUMNS"):
            columns = self.names()
        p.need_word("FROM")
        name = self.session.short(self.c.table_name())
        if columns:
            self.store().delete_columns(name, columns, self.condition())
        else:
            self.store().delete(name, self.condition())

    # settings and listings
    def do_use(self) -> None:
        p, s = self.p, self.session
        if p.take_word("GRAPH"):
            s.current_graph = self.c.table_name()
        else:
            kind = p.next().text.lower()
            s.settings[kind] = p.name()

    def do_unset(self) -> None:
        self.p.need_word("GRAPH")
        self.session.current_graph = None

    def do_set(self) -> None:
        parts = [self.p.name()]
        while self.p.take_op("."):
            parts.append(self.p.name())
        if not self.p.take_op("="):
            self.p.need_word("TO")
        self.session.settings[".".join(parts).lower()] = str(self.p.next().text).strip("'")

    def do_show(self) -> DataFrame:
        p, s = self.p, self.session
        if p.take_word("CURRENT", "GRAPH"):
            return s.spark.createDataFrame([(s.current_graph,)], "name string")
        if p.take_word("GRAPH", "STATUS"):
            name = self.c.table_name() if p.peek().kind in ("word", "quoted") else s.current_graph
            return graphstore.status(self.store(), s.graphs[s.short(name or "")]["store"])
        if p.take_word("VIEW"):
            name = s.short(self.c.table_name())
            return s.spark.createDataFrame([(name, s.view_texts[name])], "name string, definition string")
        if p.take_word("VECTOR"):
            return s.show("vector")
        words = [p.next().text]
        while p.take_op("."):
            words.append(p.name())
        return s.show(".".join(words).lower())

    def do_describe(self) -> DataFrame:
        if self.p.take_word("KEY"):
            key = self.key()
            value = self.kv().get(key)
            return self.session.spark.createDataFrame([(key, type(value).__name__)], "name string, kind string")
        return self.describe(self.session.short(self.c.table_name()))

    def describe(self, name: str) -> DataFrame:
        rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in self.session.table(name).schema.fields]
        return self.session.spark.createDataFrame(rows, "name string, type string, nullable boolean")

    def do_build(self) -> None:
        self.p.need_word("VECTOR", "INDEX")
        index = self.session.vector_indexes[self.p.name().lower()]
        df = self.session.table(index.table)
        facts = df.agg(F.count(index.column).alias("n"), F.max(F.size(vectors.of(df, index.column))).alias("d")).first()
        index.rows, index.state = int(facts["n"]), "built"
        index.dim = index.dim or (int(facts["d"]) if facts["d"] is not None else None)

    def do_reindex(self) -> None:
        self.do_build()

    def do_begin(self) -> None:
        """Statements take effect one by one, but for nodes and edges, which wait for COMMIT."""
        name = self.c.table_name() if self.p.take_word("GRAPH") else self.session.current_graph
        self.session.transaction = graphstore.Transaction(self.session.short(name) if name else None)

    def do_commit(self) -> None:
        done, self.session.transaction = self.session.transaction, None
        if done and (done.nodes or done.edges):
            graphstore.commit(self.store(), done)

    def do_rollback(self) -> None:
        self.session.transaction = None

    do_abort = do_rollback

    def open_transaction(self, name: str | None) -> graphstore.Transaction:
        now = self.session.transaction
        if now is None:
            raise SqlError("BEGIN GRAPH comes before INSERT NODE and INSERT EDGE")
        now.graph = now.graph or (self.session.short(name) if name else None)
        if now.graph is None or name and self.session.short(name) != now.graph:
            raise SqlError(f"the transaction is of graph {now.graph}")
        if "store" not in self.session.graphs.get(now.graph, {}):
            raise SqlError(f"{now.graph} is no graph that is written node by node")
        return now

    def do_insert_node(self) -> None:
        p = self.p
        label = p.name()
        p.need_word("KEY")
        key, number, graph = unquote(p.next()), None, None
        while p.is_word("AS", "GRAPH"):
            if p.next().upper == "AS":
                number = int(p.next().text)
            else:
                graph = self.c.table_name()
        self.open_transaction(graph).nodes.append((number, label, key))

    def do_insert_edge(self) -> None:
        p = self.p
        src = int(p.next().text)
        while p.is_op("-", ">", "->"):
            p.next()
        dst, kind, graph = int(p.next().text), 0, None
        while p.is_word("ETYPE", "PART", "GRAPH"):
            word = p.next().upper
            if word == "GRAPH":
                graph = self.c.table_name()
            elif word == "ETYPE":
                kind = int(p.next().text)
            else:
                p.next()
        self.open_transaction(graph).edges.append((src, dst, kind))

    def do_gc(self) -> None:
        self.p.need_word("GRAPH")
        name = self.c.table_name() if self.p.peek().kind in ("word", "quoted") else self.session.current_graph
        graphstore.compact(self.store(), self.session.graphs[self.session.short(name or "")]["store"])

    # key/value
    def key_name(self) -> str:
        t = self.p.next()
        return unquote(t) if t.kind in ("string", "quoted") else t.text

    def key(self) -> str:
        return self.key_name()

    def kv(self) -> KeyValueStore:
        self.p.need_word("IN")
        return self.session.kv.setdefault(self.session.short(self.c.table_name()), KeyValueStore())

    def do_write(self) -> None:
        p = self.p
        p.need_word("KEY")
        key = self.key()
        kv = self.kv()
        p.need_op("=")
        rest = self.text[p.peek().at :]
        m = re.fullmatch(r"(?s)(.*?)(?:\s+TTL\s+(\d+(?:ms|[smhd])))?(\s+RESET\s+ON\s+ACCESS|\s+NO\s+RESET)?\s*;?\s*", rest, re.I)
        raw = m[1].strip()
        value: object = raw
        if raw.startswith("'"):
            value = raw[1:-1].replace("''", "'")
        else:
            try:
                value = json.loads(raw)
            except ValueError:
                pass
        ttl = timeseries.width_ms(m[2]) / 1000 if m[2] else None
        kv.put(key, value, ttl, bool(m[3] and "ON" in m[3].upper()))

    def do_read(self) -> DataFrame:
        self.p.need_word("KEY")
        key = self.key()
        value = self.kv().get(key)
        if isinstance(value, DataFrame):
            return value
        shown = None if value is None else value if isinstance(value, str) else json.dumps(value)
        return self.session.spark.createDataFrame([(key, shown)], "key string, value string")

    def do_list(self) -> DataFrame:
        if self.p.take_word("STORES"):
            return self.session.spark.createDataFrame([(k,) for k in sorted(self.session.kv)], "name string")
        self.p.need_word("KEYS")
        return self.session.spark.createDataFrame([(k,) for k in self.kv().keys()], "name string")


_MATCH = re.compile(
    r"(?is)^\s*MATCH\s+(?P<short>SHORTEST\s+)?(?:USING\s+GRAPH\s+'(?P<graph>[^']+)'\s+)?"
    r"\(\s*(?P<s>\w+)(?:\s*:\s*\w+)?\s*\{\s*\w+\s*:\s*'(?P<from>[^']*)'\s*\}\s*\)\s*-\s*\[\s*:\s*(?P<kind>\w+)\s*(?:\*\s*(?:\d+\s*\.\.\s*)?(?P<hops>\d+))?\s*\]\s*->\s*"
    r"\(\s*(?P<t>\w+)(?:\s*:\s*\w+)?\s*(?:\{\s*\w+\s*:\s*'(?P<to>[^']*)'\s*\})?\s*\)\s*"
    r"(?:WHERE\s+(?P<where>.*?)\s+)?RETURN\s+(?P<list>.*?)(?P<tail>\s+ORDER\s+BY\s.*|\s+LIMIT\s.*)?\s*;?\s*$"
)


def match_select(session, text: str) -> str:
    """A MATCH statement as a SELECT over graph_neighbors, or graph_paths where it asks for the shortest path."""
    m = _MATCH.match(text)
    if not m:
        raise SqlError(f"not a MATCH statement: {text[:60]!r}")
    name = m["graph"] or session.current_graph
    if not name:
        raise SqlError("no graph: name one or USE GRAPH")
    hops = m["hops"] or "1"
    if m["short"]:
        call = f"graph_paths('{name}', '{m['from']}', '{m['to']}', {hops}, '{m['kind']}')"
    else:
        call = f"graph_neighbors('{name}', '{m['from']}', '{m['kind']}', {hops})"

    def replaced(part: str) -> str:
        part = re.sub(rf"\b{m['t']}\.\w+", "g.node_id", part)
        part = re.sub(r"\bprev\.\w+", "g.prev_id", part)
        return re.sub(rf"\b{m['s']}\.\w+", f"'{m['from']}'", part)

    where = f" WHERE {replaced(m['where'])}" if m["where"] else ""
    if m["to"] is not None and not m["short"]:
        where = f"{where} AND g.node_id = '{m['to']}'" if where else f" WHERE g.node_id = '{m['to']}'"
    return f"SELECT {replaced(m['list'])} FROM {call} AS g{where}{replaced(m['tail'] or '')}"


def execute(session, text: str) -> DataFrame | None:
    return Statements(session, text).run()
