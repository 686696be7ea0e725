"""Small parts: the lexer, dialect, tokens and joins."""

from __future__ import annotations

import random

import pytest
from stratafold import capability
from stratafold.errors import AccessDenied, InvalidStatement
from stratafold.operators.joins import asof_join, range_join
from stratafold.plans.dialect import from_first, to_spark
from stratafold.plans.lexer import split_script
from stratafold.sources.rowstore import affinity, convert


def test_scripts_are_split_outside_of_strings():
    assert split_script("SELECT ';' ; -- x;y\n SELECT \"a;b\"; /* ; */ ;") == ["SELECT ';'", "-- x;y\n SELECT \"a;b\""]


def test_dialect():
    assert to_spark("SELECT [1, x[0]]::FLOAT[2], unnest(range(3))") == "SELECT array(1, x[0])::array<float>, explode(sequence(0, (3) - 1))"
    assert to_spark("SELECT a // 2, strpos(s, 'x') FROM t") == "SELECT a  div 2, instr(s, 'x') FROM t"
    want = "SELECT * EXCEPT (_met) FROM (SELECT a, b, (rank() OVER (ORDER BY b) = 1) AS _met FROM t WHERE a > 0) AS _q WHERE _met ORDER BY a"
    assert to_spark("SELECT a, b FROM t WHERE a > 0 QUALIFY rank() OVER (ORDER BY b) = 1 ORDER BY a") == want
    assert from_first("FROM t WHERE a") == "SELECT * FROM t WHERE a" and from_first("FROM t SELECT a") == "FROM t SELECT a"


def test_affinity():
    kinds = {"BOOLEAN": "boolean", "INTEGER": "bigint", "bigint unsigned": "bigint", "VARCHAR(9)": "string", "CLOB": "string", "DATETIME": "string", "": "binary", "BLOB": "binary", "DECIMAL(10,2)": "double", "REAL": "double"}
    assert {k: affinity(k) for k in kinds} == kinds
    assert (convert("7", "bigint"), convert(3, "double"), convert(2.5, "string"), convert("a", "binary"), convert(2, "boolean")) == (7, 3.0, "2.5", b"a", True)
    with pytest.raises(Exception, match="does not fit"):
        convert("x", "bigint")


def test_tokens():
    a, b, c = (capability.Identity(k * 32) for k in (b"a", b"b", b"c"))
    keys = {i.did: i.key for i in (a, b, c)}
    first = capability.issue(a, b.did, [("space/read", "*")], 100, now=1000)
    second = capability.issue(b, c.did, [("space/query", "x")], 50, proof=first, now=1000)
    assert capability.verify(second, c.did, keys, now=1010)["root"] == a.did
    for token, audience, now, revoked in ((first, c.did, 1000, ()), (first, b.did, 1200, ()), (first, b.did, 900, ()), (second, c.did, 1010, (capability.token_id(first),)), (second[:-1] + "0", c.did, 1010, ())):
        with pytest.raises(AccessDenied):
            capability.verify(token, audience, keys, set(revoked), now=now)
    wide = capability.issue(b, c.did, [("space/*", "*")], 50, proof=first, now=1000)
    with pytest.raises(AccessDenied):
        capability.verify(wide, c.did, keys, now=1010)
    assert [capability.duration(x) for x in ("30", "15m", "2 hours", "1d")] == [30, 900, 7200, 86400]
    for bad in ("0", "400d", "3 moons", ""):
        with pytest.raises(InvalidStatement):
            capability.duration(bad)


@pytest.mark.parametrize("parts", [1, 4])
def test_asof_join(spark, parts):
    rng = random.Random(parts)
    left = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(60)]), i) for i in range(150)]
    right = [(k, t, f"{k}{t}") for k in ("a", "b", None) for t in rng.sample(range(60), 12)] + [("b", None, "never")]
    a, b = spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, t int, v string")

    def last(t, keys):
        found = [(x, v) for k, x, v in right if x is not None and x <= t and k in keys] if t is not None else []
        return max(found)[1] if found else None

    got = {r.id: r.r_v for r in asof_join(a, b, ["k"], "t", parts=parts).collect()}
    assert got == {i: last(t, (k,)) if k is not None else None for k, t, i in left}
    alone = spark.createDataFrame([(t, v) for k, t, v in right if k == "a"], "t int, v string")
    got = {r.id: r.r_v for r in asof_join(a, alone, [], "t", parts=parts).collect()}
    assert got == {i: last(t, ("a",)) for _, t, i in left}
    assert asof_join(a, b.limit(0), ["k"], "t", parts=parts).filter("r_v is not null").isEmpty()


def test_range_join(spark):
    points = spark.createDataFrame([(i * 7,) for i in range(-300, 300)], "p int")
    limits = [(0, 3), (5, 4), (-2, 15), (-2000, 2000), (100, 10**9), (-(10**9), -1999)]
    spans = spark.createDataFrame(limits, "lo int, hi int")
    joined = range_join(points, spans, "p", "lo", "hi", 4)
    assert joined.columns == ["p", "lo", "hi"]
    assert sorted((r.p, r.lo) for r in joined.collect()) == sorted((p * 7, lo) for p in range(-300, 300) for lo, hi in limits if lo <= p * 7 <= hi)
    assert range_join(points, spans.limit(0), "p", "lo", "hi", 4).isEmpty()
