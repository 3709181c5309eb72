"""Tables as folders of Parquet files with a ``schema.json`` beside them.

Appends add files; rewrites go to a new version folder which the metadata then names, so readers never see half a
table and a failed write leaves the old one. Paths go through Hadoop's file system, so any store that Spark reads
will do.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


class ConstraintError(ValueError):
    """Rows that break a table's key or constraint."""


@dataclass
class Meta:
    columns: dict[str, str] = field(default_factory=dict)
    locks: list[str] = field(default_factory=list)
    time: bool = False
    primary_key: list[str] = field(default_factory=list)
    partitions: list[str] = field(default_factory=list)
    constraints: dict[str, str] = field(default_factory=dict)
    version: str = ""
    #: Folders from before a column's type was widened; each has one schema.
    older: list[str] = field(default_factory=list)
    #: Folders that the last replacement left to the readers of then; the next one deletes them.
    retired: list[str] = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, root: str, functions: dict | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.functions = {} if functions is None else functions

    # files
    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, table: str) -> str:
        return table.replace(".", "/") if not table.endswith(".time") else table[:-5].replace(".", "/") + ".time"

    def exists(self, table: str) -> bool:
        path, fs = self._path(self._folder(table), "schema.json")
        return fs.exists(path)

    def meta(self, table: str) -> Meta:
        path, fs = self._path(self._folder(table), "schema.json")
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Meta(**json.loads(text))

    def save_meta(self, table: str, meta: Meta) -> None:
        path, fs = self._path(self._folder(table), "schema.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(asdict(meta), indent=1).encode()))
        out.close()

    def data(self, table: str, meta: Meta) -> str:
        return f"{self.root}/{self._folder(table)}/{meta.version}"

    # tables
    def create(self, table: str, columns: dict[str, str] | None = None, **options) -> Meta:
        meta = Meta(columns=dict(columns or {}), version="v-" + uuid.uuid4().hex, time=table.endswith(".time"), **options)
        if meta.time:
            meta.columns = {"_time": "bigint"} | meta.columns
        self.save_meta(table, meta)
        return meta

    def drop(self, table: str) -> None:
        path, fs = self._path(self._folder(table))
        fs.delete(path, True)

    def rename(self, old: str, new: str) -> None:
        (a, fs), (b, _) = self._path(self._folder(old)), self._path(self._folder(new))
        fs.mkdirs(b.getParent())
        fs.rename(a, b)

    def list(self) -> list[str]:
        found = []

        def walk(parts: list[str]) -> None:
            path, fs = self._path(*parts) if parts else self._path()
            if not fs.exists(path):
                return
            for status in fs.listStatus(path):
                name = status.getPath().getName()
                if status.isDirectory() and not name.startswith("v-"):
                    inner, fs2 = self._path(*parts, name, "schema.json")
                    if fs2.exists(inner):
                        found.append(".".join([*parts, name]))
                    walk([*parts, name])

        walk([])
        return sorted(found)

    def read(self, table: str) -> DataFrame:
        """The declared columns; files from before a column was declared have null there."""
        meta = self.meta(table)
        schema = ", ".join(f"`{c}` {k}" for c, k in meta.columns.items())
        parts = []
        for version in [*meta.older, meta.version]:
            data, fs = self._path(self._folder(table), version)
            if not fs.exists(data) or not meta.columns:
                continue
            found = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{self._folder(table)}/{version}")
            parts.append(found.select(*[self._declared(found, c, k).alias(c) for c, k in meta.columns.items()]))
        if not parts:
            return self.spark.createDataFrame([], schema or "_empty int")
        return functools.reduce(DataFrame.unionAll, parts)

    @staticmethod
    def _declared(found: DataFrame, name: str, kind: str) -> Column:
        """The column as it is where its type is the declared one, so that filters reach the scan."""
        kinds = dict(found.dtypes)
        if name not in kinds:
            return F.lit(None).cast(kind)
        return F.col(f"`{name}`") if kinds[name] == kind else F.col(f"`{name}`").try_cast(kind)

    # writes
    def _fit(self, df: DataFrame, meta: Meta) -> DataFrame:
        kinds = dict(df.dtypes)
        for c in df.columns:
            kind = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double", "void": "string"}.get(kinds[c], kinds[c])
            if c not in meta.columns:
                meta.columns[c] = kind
            elif c not in meta.locks and kind != meta.columns[c] and {kind, meta.columns[c]} <= set(schemas.ORDER):
                meta.columns[c] = schemas.widen(meta.columns[c], kind)
        return df.select(*[F.col(f"`{c}`").try_cast(meta.columns[c]).alias(c) for c in df.columns])

    def _check(self, table: str, rows: DataFrame, meta: Meta, against: DataFrame | None) -> None:
        """One pass over the new rows, and one anti-join with what is there."""
        for name, function in meta.constraints.items():
            self._hold(table, rows, name, function)
        keys = meta.primary_key or (["_time"] if meta.time else [])
        if not keys:
            return
        if not set(keys) <= set(rows.columns):
            raise ConstraintError(f"{table}: rows without {', '.join(keys)}")
        null = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0))
        if rows.where(null == 1).limit(1).count():
            raise ConstraintError(f"{table}: null in the key {', '.join(keys)}")
        if meta.primary_key:
            if rows.groupBy(*keys).count().where("count > 1").limit(1).count():
                raise ConstraintError(f"{table}: the key {', '.join(keys)} twice")
            if against is not None and against.join(rows, keys, "left_semi").limit(1).count():
                raise ConstraintError(f"{table}: the key {', '.join(keys)} is there already")

    def _hold(self, table: str, rows: DataFrame, name: str, function: str) -> None:
        """Every row has to make the constraint's function true: a function of the columns that its parameters name."""
        udf = self.functions.get(function.lower())
        if udf is None:
            raise ConstraintError(f"{table}: constraint {name} uses {function}, which isn't registered")
        given = [f"`{c}`" if c in rows.columns else "NULL" for c in udf.parameters]
        if rows.where(~F.coalesce(F.expr(f"{udf.registered}({', '.join(given)})").cast("boolean"), F.lit(False))).limit(1).count():
            raise ConstraintError(f"{table}: rows break {name}")

    def append(self, table: str, df: DataFrame) -> None:
        meta = self.meta(table)
        before = self.read(table) if meta.primary_key else None
        kinds = dict(meta.columns)
        rows = self._fit(df, meta)
        if any(meta.columns[c] != k for c, k in kinds.items()):
            self._new_version(meta)
        self._check(table, rows, meta, before)
        self._write(rows, table, meta, "append")
        self.save_meta(table, meta)

    @staticmethod
    def _new_version(meta: Meta) -> None:
        meta.older.append(meta.version)
        meta.version = "v-" + uuid.uuid4().hex

    def _write(self, rows: DataFrame, table: str, meta: Meta, mode: str) -> None:
        if meta.time and "_time" in rows.columns:
            rows = rows.sortWithinPartitions("_time")
        writer = rows.write.mode(mode)
        if meta.partitions:
            writer = writer.partitionBy(*meta.partitions)
        writer.parquet(self.data(table, meta))

    def replace(self, table: str, df: DataFrame, columns: dict[str, str] | None = None) -> None:
        """New content: written beside the old, then named by the metadata. The old stays for its readers until the next replacement."""
        meta = self.meta(table)
        gone, meta.retired = meta.retired, [*meta.older, meta.version]
        if columns is not None:
            meta.columns = columns
        rows = self._fit(df, meta)
        self._check(table, rows, meta, None)
        meta.version, meta.older = "v-" + uuid.uuid4().hex, []
        self._write(rows, table, meta, "errorifexists")
        self.save_meta(table, meta)
        for version in gone:
            path, fs = self._path(self._folder(table), version)
            fs.delete(path, True)

    def into(self, table: str, df: DataFrame, mode: str = "append") -> None:
        if not self.exists(table):
            self.create(table)
        if mode == "replace":
            meta = self.meta(table)
            self.replace(table, df, {"_time": "bigint"} if meta.time else {})
        else:
            self.append(table, df)

    def ingest(self, table: str, records: list[dict]) -> None:
        """JSON records: types inferred and widened, locked columns kept."""
        if not self.exists(table):
            self.create(table)
        meta = self.meta(table)
        flat = [schemas.flatten(r) for r in records]
        kinds = schemas.infer(flat, meta.columns, meta.locks)
        names = list(dict.fromkeys(n for r in flat for n in r))
        if any(kinds[c] != k for c, k in meta.columns.items()):
            self._new_version(meta)
        meta.columns = kinds
        self.save_meta(table, meta)
        rows = [tuple(schemas.converted(r.get(n), kinds[n]) for n in names) for r in flat]
        self.append(table, self.spark.createDataFrame(rows, ", ".join(f"`{n}` {kinds[n]}" for n in names)))

    def update(self, table: str, values: dict[str, str], where: str | None) -> None:
        df = self.read(table)
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        self.replace(table, df.select(*[F.when(hit, F.expr(values[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns]))

    def delete(self, table: str, where: str | None) -> None:
        df = self.read(table)
        self.replace(table, df.where(~F.coalesce(F.expr(where), F.lit(False))) if where else df.limit(0))

    def delete_columns(self, table: str, columns: list[str], where: str | None) -> None:
        df, meta = self.read(table), self.meta(table)
        if where:
            hit = F.coalesce(F.expr(where), F.lit(False))
            self.replace(table, df.select(*[F.when(~hit, F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]))
        else:
            self.replace(table, df.drop(*columns), {c: k for c, k in meta.columns.items() if c not in columns})

    def alter(self, table: str, action: str, *args: str) -> None:
        meta = self.meta(table)
        if action == "add":
            meta.columns[args[0]] = args[1]
        elif action == "rename":
            df = self.read(table).withColumnRenamed(*args)
            kinds = {args[1] if c == args[0] else c: k for c, k in meta.columns.items()}
            meta.primary_key = [args[1] if c == args[0] else c for c in meta.primary_key]
            self.save_meta(table, meta)
            self.replace(table, df, kinds)
            return
        elif action == "type":
            self._new_version(meta)
            meta.columns[args[0]] = args[1]
        elif action == "primary_key":
            rows = self.read(table)
            meta.primary_key = list(args)
            self._check(table, rows, meta, None)
        elif action == "constraint":
            meta.constraints[args[0]] = args[1]
        elif action == "drop_constraint":
            meta.constraints.pop(args[0], None)
        elif action == "lock":
            meta.columns[args[0]] = args[1]
            meta.locks = sorted({*meta.locks, args[0]})
        self.save_meta(table, meta)
