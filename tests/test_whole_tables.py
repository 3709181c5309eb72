"""Graph and interval queries against brute force."""

import os

import duckdb
import pytest

from lodestream.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def rows(text):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con.execute(text).fetchall()


def test_graph_of_all_edges(spark):
    next_of = {}
    for c, p, s in rows("SELECT 'c' || o_custkey, 'p' || l_partkey, 's' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"):
        next_of.setdefault(c, set()).add(p)
        next_of.setdefault(p, set()).add(s)
    wanted, frontier = {"c1": (None, 0)}, {"c1"}
    for hop in (1, 2, 3):
        found = {}
        for n in sorted(frontier, reverse=True):
            found |= {m: (n, hop) for m in next_of.get(n, ()) if m not in wanted}
        wanted |= found
        frontier = set(found)
    del wanted["c1"]
    assert {r["node_id"]: (r["prev_id"], r["hop"]) for r in QUERIES["graph_neighbors"](spark, DATA).collect()} == wanted
    assert {r["node_id"]: r["hop"] for r in QUERIES["match_rewrite"](spark, DATA).collect()} == {n: h for n, (_, h) in wanted.items() if h < 3}


def merged(spells):
    out = []
    for a, b in sorted(spells):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_slices_of_all_users(spark):
    events = rows("SELECT epoch_us(ts) // 1000, event_type, value FROM events WHERE user_id IS NOT NULL")
    spells = merged((t, t + 3_600_000) for t, *_ in events)
    pairs = lambda name: sorted((r["_start_date"], r["_end_date"]) for r in QUERIES[name](spark, DATA).collect())
    assert pairs("slice_union") == spells
    assert pairs("slice_table") == merged((t, t + 3_600_000) for t, kind, _ in events if kind == "purchase")
    got = {r["_time"]: r["n"] for r in QUERIES["by_slice"](spark, DATA).collect()}
    assert got == {a: sum(a <= t < b and v is not None for t, _, v in events) for a, b in spells}
