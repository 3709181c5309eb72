"""Compatibility catalogues (pg_catalog), built from what a session knows: small tables of names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import FUNCTIONS, TYPES

#: Numbers of schemas and of the catalogues that clients ask for by number.
NAMESPACES = {"pg_catalog": 11, "public": 2200, "information_schema": 13211}
SYSTEM = {"pg_class": 1259, "pg_type": 1247, "pg_namespace": 2615}
#: The array type of a type.
ARRAYS = {"bool": 1000, "bytea": 1001, "int8": 1016, "int2": 1005, "int4": 1007, "text": 1009, "json": 199, "float4": 1021, "float8": 1022, "varchar": 1015, "date": 1182, "time": 1183, "timestamp": 1115, "timestamptz": 1185, "interval": 1187, "numeric": 1231, "uuid": 2951}
#: Spark's type names and those of the catalogues.
_SPARK = {"bigint": "int8", "int": "int4", "smallint": "int2", "double": "float8", "float": "float4", "string": "text", "boolean": "bool", "binary": "bytea", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp"}

#: Columns of the catalogues.
CATALOGS = {
    "pg_namespace": "oid int, nspname string, nspowner int",
    "pg_type": "oid int, typname string, typnamespace int, typarray int, typtype string, typrelid int, typelem int, typbasetype int",
    "pg_class": "oid int, relname string, nspname string, relkind string, relnamespace int, relispartition boolean, relpersistence string",
    "pg_attribute": "attrelid int, attname string, atttypid int, attnum int, attnotnull boolean, attisdropped boolean",
    "pg_database": "oid int, datname string",
    "pg_views": "schemaname string, viewname string, definition string",
    "pg_proc": "oid int, proname string, pronamespace int",
    "pg_constraint": "oid int, conname string, conrelid int, contype string",
    "pg_constraint_columns": "conname string, conrelid int, attnum int",
    "pg_roles": "oid int, rolname string, rolsuper boolean",
    "pg_authid": "oid int, rolname string, rolsuper boolean",
    "pg_auth_members": "roleid int, member int",
    "pg_attrdef": "oid int, adrelid int, adnum int, adbin string",
    "pg_aggregate": "aggfnoid int, aggkind string",
}


def oid_of(name: str, database: str = "main", schema: str = "public") -> int:
    """A positive number for a relation: fixed for the system's, else a hash (FNV-1a) of the full name."""
    name = name.strip().strip('"').removeprefix("pg_catalog.")
    if name in SYSTEM:
        return SYSTEM[name]
    parts = name.removesuffix(".time").replace("/", ".").split(".")
    full = "/".join([database, schema][: max(0, 3 - len(parts))] + parts)
    found = 0x811C9DC5
    for byte in full.encode():
        found = (found ^ byte) * 0x01000193 % 2**32
    return max(1, abs(found - 2**32 if found >= 2**31 else found))


def catalog(session, name: str) -> DataFrame:
    """One catalogue as a table."""
    database, schema = session.settings["database"], session.settings["schema"]
    number = lambda relation: oid_of(relation, database, schema)
    rows: list[tuple] = []
    if name == "pg_namespace":
        rows = [(oid, n, 10) for n, oid in NAMESPACES.items()]
    elif name == "pg_type":
        rows = [(TYPES[n], n, NAMESPACES["pg_catalog"], array, "b", 0, 0, 0) for n, array in ARRAYS.items()]
    elif name == "pg_class":
        kinds = {"BASE TABLE": "r", "VIEW": "v"}
        rows = [(number(t), t, schema, kinds[k], NAMESPACES["public"], False, "p") for t, k in session._names()]
        rows += [(number(i), i, schema, "i", NAMESPACES["public"], False, "p") for i in sorted(session.vector_indexes)]
        rows += [(number(g), g, schema, "v", NAMESPACES["public"], False, "p") for g in sorted(session.graphs)]
    elif name == "pg_attribute":
        for t, _ in session._names():
            fields = session.table(t).schema.fields
            rows += [(number(t), f.name, TYPES.get(_SPARK.get(f.dataType.simpleString(), "text"), 25), k + 1, not f.nullable, False) for k, f in enumerate(fields)]
    elif name == "pg_database":
        rows = [(number(database), database)]
    elif name == "pg_views":
        rows = [(schema, v, text) for v, text in sorted(session.view_texts.items())]
    elif name == "pg_proc":
        rows = [(number(f), f, NAMESPACES["pg_catalog"]) for f in sorted(FUNCTIONS)]
        rows += [(number(f), f, NAMESPACES["public"]) for f in sorted(session.udfs)]
    elif name in ("pg_roles", "pg_authid"):
        rows = [(10, session.settings["user"], True)]
    elif name == "pg_constraint" and session.store:
        rows = [(number(f"{t}_pkey"), f"{t}_pkey", number(t), "p") for t in session.store.list() if session.store.meta(t).primary_key]
    return session.spark.createDataFrame(rows, CATALOGS[name])
