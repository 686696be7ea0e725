"""Approximate aggregates beside exact ones: results as plain loops give, and no more sketches than groups."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.parquet as pq
from stratafold import catalogue


def test_agg_approx_distinct_keeps_sketches_by_group(spark, tmp_path):
    # Groups of 1200, 1200 and 600 rows, the last without a flag; parts and quantities are missing in places, and each part comes several times.
    lines = [(("A", "N", None, "A", "N")[i % 5], None if i % 31 == 0 else i * 7 % 211, None if i % 37 == 0 else float(i * i % 50 + 1)) for i in range(3000)]
    columns = zip(*lines, strict=True)
    pq.write_table(pa.table(dict(zip(("l_returnflag", "l_partkey", "l_quantity"), map(list, columns), strict=True))), tmp_path / "lineitem.parquet")
    found = catalogue.QUERIES["agg_approx_distinct"](spark, str(tmp_path))
    wanted = set()
    for flag in ("A", "N", None):
        held = sorted(q for f, _, q in lines if f == flag and q is not None)
        wanted.add((flag, True, held[(len(held) + 1) // 2 - 1]))
    assert found.columns == ["l_returnflag", "near", "middle"] and found.count() == 3 and set(map(tuple, found.collect())) == wanted
    sketches = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if re.search("approx_count_distinct|percentile_approx", line)]
    assert sketches and all(re.search(r"\(keys=\[l_returnflag#\d+\], ", line) for line in sketches)
