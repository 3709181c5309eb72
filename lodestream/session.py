"""A session of the dialect: names, settings, and the execution of statements."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.udf import UserFunction, register
from .operators.vectors import VectorIndex
from .sources import graphstore
from .sources.catalogs import CATALOGS, catalog, oid_of
from .sources.keyvalue import KeyValueStore
from .sources.storage import Store

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Session:
    """Tables are found as CTE, registered frame, view, key/value entry, stored table, in this order."""

    def __init__(self, spark: SparkSession, root: str | None = None, order: str = "_time"):
        self.spark, self.order = spark, order
        self.kv: dict[str, KeyValueStore] = {}
        self.frames: dict[str, str] = {}
        self.loaders: dict[str, Callable[[], DataFrame]] = {}
        self.keys: dict[str, str] = {}
        self.view_texts: dict[str, str] = {}
        self.ctes: dict[str, str] = {}
        self.cte_tables: dict[str, str] = {}
        self.udfs: dict[str, UserFunction] = {}
        self.store = Store(spark, root, self.udfs) if root else None
        self.table_functions: dict[str, Callable[..., DataFrame]] = {}
        self.vector_indexes: dict[str, VectorIndex] = {}
        self.graphs: dict[str, dict] = {}
        self.current_graph: str | None = None
        self.transaction: graphstore.Transaction | None = None
        self.settings = {"database": "main", "schema": "public", "user": "main", "strict.projection": "true"}
        self.into: tuple[str, str] | None = None
        self._id = uuid.uuid4().hex[:8]

    # names
    def short(self, name: str) -> str:
        name = name.lower().replace("/", ".")
        for prefix in (f"{self.settings['database']}.{self.settings['schema']}.", f"{self.settings['schema']}."):
            name = name.removeprefix(prefix)
        return name

    def register(self, name: str, df: DataFrame, key: str | None = None) -> None:
        view = f"__t_{self._id}_{re.sub(r'[^0-9a-z_]', '_', self.short(name))}"
        df.createOrReplaceTempView(view)
        self.frames[self.short(name)] = view
        if key:
            self.keys[self.short(name)] = key

    def register_dir(self, sf_dir: str, tables: list[str] = TABLES) -> None:
        """The driver's tables, each opened when it is first named; ``events`` also has ``_time``."""
        from .operators.shared import with_time

        def load(t: str) -> DataFrame:
            df = self.spark.read.parquet(f"{sf_dir}/{t}.parquet")
            return with_time(df, "ts") if t == "events" else df

        for t in tables:
            self.loaders[self.short(t)] = lambda t=t: load(t)
        if "embeddings" in tables:
            self.keys["embeddings"] = "vec_id"

    def relation_oid(self, name: str) -> int:
        """The number of a table, as text that is cast to regclass gives it."""
        return oid_of(name if name.startswith('"') else name.lower(), self.settings["database"], self.settings["schema"])

    def resolve(self, name: str) -> str:
        """The temporary view behind a name."""
        short = self.short(name)
        if short in self.ctes:
            return self.ctes[short]
        if short in self.loaders and short not in self.frames:
            self.register(short, self.loaders[short]())
        if short in self.frames:
            return self.frames[short]
        if short in self.view_texts:
            from .sql.compiler import compile_query

            self.register(short, self.spark.sql(compile_query(self, self.view_texts[short])))
            return self.frames.pop(short)
        parts = short.split(".")
        if len(parts) >= 3 and "store" in parts:
            at = parts.index("store")
            kv = self.kv.get(".".join(parts[: at + 2])) or self.kv.get(".".join(parts[at : at + 2]))
            if kv:
                self.register(short, kv.frame(self.spark, ".".join(parts[at + 2 :])))
                return self.frames.pop(short)
        if short in ("information_schema.tables", "information_schema.columns", "information_schema.schemata", "information_schema.views"):
            self.register(short, self.information(parts[-1]))
            return self.frames.pop(short)
        if short.removeprefix("pg_catalog.") in CATALOGS:
            self.register(short, catalog(self, short.removeprefix("pg_catalog.")))
            return self.frames.pop(short)
        if self.store and self.store.exists(short):
            self.register(short, self.store.read(short))
            return self.frames.pop(short)
        raise ValueError(f"unknown table {name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.resolve(name))

    def key_of(self, name: str) -> str:
        return self.keys.get(self.short(name)) or self.table(name).columns[0]

    def compiler(self, source):
        from .sql.compiler import Compiler

        return Compiler(source)

    def edges(self, name: str | None, kind: str | None) -> tuple[DataFrame, str | None]:
        g = self.graphs[self.short(name or self.current_graph or "")]
        if "store" in g:
            return graphstore.edges(self.store, g["store"]), None
        mapping = g["edges"].get((kind or "").lower()) or next(iter(g["edges"].values()))
        df = self.table(mapping["table"])
        columns = [F.col(mapping.get("src", "src")).alias("src"), F.col(mapping.get("dst", "dst")).alias("dst")]
        if mapping.get("cost") in df.columns:
            columns.append(F.col(mapping["cost"]).alias("cost"))
        time = mapping.get("time") if mapping.get("time") in df.columns else None
        if time:
            columns.append(F.col(time).alias("_t"))
        return df.select(*columns), "_t" if time else None

    def create_graph(self, name: str, table: str, src: str = "src", dst: str = "dst", cost: str | None = "cost", time: str | None = "_time", kind: str = "edge") -> None:
        g = self.graphs.setdefault(self.short(name), {"edges": {}})
        g["edges"][kind.lower()] = {"table": table, "src": src, "dst": dst, "cost": cost, "time": time}

    # catalogue
    def _names(self) -> list[tuple[str, str]]:
        stored = [(t, "BASE TABLE") for t in (self.store.list() if self.store else [])]
        return sorted([*((t, "BASE TABLE") for t in {*self.frames, *self.loaders}), *((v, "VIEW") for v in self.view_texts), *stored])

    def information(self, what: str) -> DataFrame:
        db, schema = self.settings["database"], self.settings["schema"]
        make = self.spark.createDataFrame
        if what == "tables":
            return make([(db, schema, t, k) for t, k in self._names()], "table_catalog string, table_schema string, table_name string, table_type string")
        if what == "columns":
            rows = [(db, schema, t, f.name, k + 1, f.dataType.simpleString()) for t, _ in self._names() for k, f in enumerate(self.table(t).schema.fields)]
            return make(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string")
        if what == "schemata":
            return make([(db, schema)], "catalog_name string, schema_name string")
        return make([(db, schema, v, q) for v, q in sorted(self.view_texts.items())], "table_catalog string, table_schema string, table_name string, view_definition string")

    def show(self, what: str) -> DataFrame:
        make = self.spark.createDataFrame
        if what in ("tables", "objects"):
            rows = [(t, k) for t, k in self._names() if what == "objects" or k == "BASE TABLE"]
            return make(rows, "name string, type string")
        if what in ("schemas", "schema"):
            return make([(self.settings["schema"],)], "name string")
        if what == "views":
            return make(sorted(self.view_texts.items()), "name string, definition string")
        if what == "scripts":
            return make([(u.name, u.kind) for u in self.udfs.values()], "name string, kind string")
        if what == "graphs":
            return make([(g,) for g in sorted(self.graphs)], "name string")
        if what.startswith("vector"):
            return make([i.status() for i in self.vector_indexes.values()], "name string, table_name string, column_name string, metric string, dim int, mode string, state string, n_rows int")
        rows = sorted(self.settings.items()) if what == "all" else [(what, self.settings.get(what, ""))]
        return make(rows, "name string, value string")

    # functions
    def create_function(self, name: str, fn: Callable, returns: str | list[str] = "double", kind: str = "scalar", null_on_error: bool = True) -> None:
        if kind == "tvf":
            self.table_functions[name.lower()] = fn
        else:
            register(self.spark, self.udfs, name, fn, returns, kind, null_on_error)

    # statements
    def query(self, text: str) -> DataFrame:
        """A SELECT (or UNION, WITH) as a lazy DataFrame."""
        from .sql.compiler import compile_query

        self.into = None
        return self.spark.sql(compile_query(self, text))

    def execute(self, text: str) -> DataFrame | None:
        """Any statement; the rows of those that have some."""
        from .sql.statements import execute

        return execute(self, text)
