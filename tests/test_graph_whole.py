"""Matches on the whole trade graph, against brute force on a small one."""

from __future__ import annotations

import datetime
import random
from collections import Counter

from stratafold import catalogue


def test_whole_trade_graph(spark, tmp_path):
    rng = random.Random(8)
    customers, suppliers = range(1, 31), range(1, 13)
    # Customers 1 to 20 deal with suppliers 1 to 8, the rest of those that deal with the others; supplier 1 is a hub.
    orders = [(o, rng.randint(1, 28), datetime.date(1992, 1, 1) + datetime.timedelta(days=30 * o)) for o in range(1, 80)]
    lines = [(o, n, rng.choice((1, rng.randint(1, 8))) if c <= 20 else rng.randint(9, 11)) for o, c, _ in orders for n in range(1, rng.randint(2, 5))]
    for name, rows, schema in (
        ("customer", [(c, f"C{c}", rng.choice(("BUILDING", "MACHINERY"))) for c in customers], "c_custkey bigint, c_name string, c_mktsegment string"),
        ("supplier", [(s, f"S{s}") for s in suppliers], "s_suppkey bigint, s_name string"),
        ("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderdate date"),
        ("lineitem", lines, "l_orderkey bigint, l_linenumber int, l_suppkey bigint"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    buyer = {o: c for o, c, _ in orders}
    edges = {(buyer[o], s) for o, _, s in lines}
    assert len(edges) > len({(buyer[o], s) for o, n, s in lines if n == 1})

    def got(name):
        return Counter(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))

    assert got("graph_edges_whole") == Counter((f"C{c}", f"S{s}") for c, s in edges)
    assert got("graph_two_hop_whole") == Counter((c, d, s) for c, s in edges for d, t in edges if s == t)
    near: dict[str, set[str]] = {}
    for c, s in edges:
        near.setdefault(f"C{c}", set()).add(f"S{s}")
        near.setdefault(f"S{s}", set()).add(f"C{c}")
    hops, front, level = {}, {"C1"}, 0
    while front:
        level += 1
        front = {y for x in front for y in near.get(x, ())} - hops.keys()
        hops |= dict.fromkeys(front, level)
    assert hops and got("graph_any_shortest_whole") == Counter(hops.items())
