"""Property-graph queries: definitions, the MATCH patterns of GRAPH_TABLE, and their plans.

A pattern is a vertex, or vertices and edges in a row (`(a:L WHERE ..)-[k:E]->(b:L)`, also `<-[..]-`), each edge a join; or
`p = ANY SHORTEST (a)-[k:E]->+(b)`, found by levels from all sources at once until a level finds nothing new; with `->*`, a vertex reaches
itself over no edge.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidStatement, NotFound
from ..model import EdgeTable, Graph, VertexTable
from ..plans.lexer import Cursor, split_top

def parse_create(text: str) -> tuple[str | None, Graph, bool, bool]:
    """Space, graph, whether to replace, whether to keep one that exists."""
    c = Cursor(text, "CREATE PROPERTY GRAPH")
    c.expect("CREATE")
    replace = c.eat("OR", "REPLACE")
    c.expect("PROPERTY", "GRAPH")
    keep = c.eat("IF", "NOT", "EXISTS")
    parts = c.parts()
    c.expect("VERTEX", "TABLES")
    vertices = [_vertex(x) for x in split_top(c.bracket())]
    edges = [_edge(x) for x in split_top(c.bracket())] if c.eat("EDGE", "TABLES") else []
    c.done()
    if not vertices or len(parts) > 2:
        raise c.fail("<space>.<graph> and vertex tables")
    return (parts[0] if len(parts) == 2 else None), Graph(parts[0] if len(parts) == 2 else "", parts[-1], vertices, edges), replace, keep


def _table(c: Cursor) -> str:
    return ".".join(c.parts())


def _label(c: Cursor, table: str) -> str:
    if c.eat("PROPERTIES"):
        c.bracket()
    elif c.eat("NO", "PROPERTIES"):
        pass
    return c.name() if c.eat("LABEL") else table.split(".")[-1]


def _vertex(text: str) -> VertexTable:
    c = Cursor(text, "VERTEX TABLES")
    table = _table(c)
    key = c.bracket().strip() if c.eat("KEY") else None
    label = _label(c, table)
    c.done()
    return VertexTable(table, label, key)


def _edge(text: str) -> EdgeTable:
    c = Cursor(text, "EDGE TABLES")
    table, ends = _table(c), []
    for word in ("SOURCE", "DESTINATION"):
        c.expect(word, "KEY")
        column = c.bracket().strip()
        c.expect("REFERENCES")
        ends += [column, _table(c), c.bracket().strip()]
    label = _label(c, table)
    c.done()
    return EdgeTable(table, label, *ends)


@dataclass
class Element:
    variable: str
    label: str | None
    where: str | None
    edge: bool = False
    backward: bool = False
    repeated: bool = False
    zero: bool = False  #: repeated no time, too


@dataclass
class Match:
    space: str | None
    graph: str
    path: str | None
    elements: list[Element]
    columns: list[tuple[str, str]]  #: expression and name


def parse_match(text: str) -> Match:
    """What stands within the brackets of GRAPH_TABLE."""
    c = Cursor(text, "GRAPH_TABLE")
    parts = c.parts()
    c.expect("MATCH")
    path = None
    if c.at + 1 < len(c.items) and c.items[c.at + 1].text == "=":
        path = c.name()
        c.expect("=")
    shortest = c.eat("ANY", "SHORTEST")
    elements = [_element(c.bracket(), "v0")]
    while c.more and not c.sees("COLUMNS"):
        backward = c.eat("<")
        c.expect("-")
        c.expect("[")
        start, depth = c.items[c.at].start if c.more else 0, 1
        while depth:
            t = c.take()
            depth += (t.text == "[") - (t.text == "]")
        inner = text[start : t.start]
        if backward:
            c.expect("-")
        else:
            c.expect("->")
        e = _element(inner, f"e{len(elements)}")
        e.edge, e.backward, e.zero = True, backward, c.eat("*")
        e.repeated = e.zero or c.eat("+")
        elements += [e, _element(c.bracket(), f"v{len(elements) + 1}")]
    c.expect("COLUMNS")
    columns = []
    for i, item in enumerate(split_top(c.bracket())):
        m = re.fullmatch(r"(.*?)\s+AS\s+[`\"]?(\w+)[`\"]?", item, re.S | re.I)
        last = re.search(r"(\w+)\W*$", item)
        columns.append((m[1], m[2]) if m else (item, last[1] if last else f"c{i}"))
    c.done()
    if any(e.repeated for e in elements) != shortest or (shortest and len(elements) != 3):
        raise InvalidStatement("GRAPH_TABLE: a repeated edge needs ANY SHORTEST, between two vertices")
    return Match(parts[0] if len(parts) == 2 else None, parts[-1], path, elements, columns)


def _element(text: str, default: str) -> Element:
    c = Cursor(text, "GRAPH_TABLE")
    variable = c.name() if c.more and not c.sees(":") and not c.sees("WHERE") else default
    label = c.name() if c.eat(":") else None
    where = c.rest() if c.eat("WHERE") else None
    c.done()
    return Element(variable, label, where)


class GraphPlan:
    """A match's plan over the graph's tables."""

    def __init__(self, graph: Graph, table: Callable[[str], DataFrame]) -> None:
        self.graph, self.table = graph, table

    def _vertices(self, e: Element, only: str | None = None) -> tuple[DataFrame, str]:
        found = [v for v in self.graph.vertices if (e.label is None or v.label.lower() == e.label.lower()) and (only is None or v.table == only)]
        if len(found) != 1:
            raise NotFound("Vertex label", e.label or "(any)")
        v = found[0]
        keys = {x.source_ref for x in self.graph.edges if x.source_table == v.table} | {x.target_ref for x in self.graph.edges if x.target_table == v.table}
        frame = self.table(v.table)
        key = v.key or (sorted(keys)[0] if keys else frame.columns[0])
        frame = frame.select(*(F.col(c).alias(f"{e.variable}__{c}") for c in frame.columns))
        return (frame.filter(_renamed(e.where, [e.variable])) if e.where else frame), f"{e.variable}__{key}"

    def _edge(self, e: Element) -> EdgeTable:
        found = [x for x in self.graph.edges if e.label is None or x.label.lower() == e.label.lower()]
        if len(found) != 1:
            raise NotFound("Edge label", e.label or "(any)")
        return found[0]

    def frame(self, m: Match) -> DataFrame:
        if any(e.repeated for e in m.elements):
            rows = self._shortest(m)
        else:
            rows, _ = self._vertices(m.elements[0])
            for k in range(1, len(m.elements), 2):
                rows = self._step(rows, m.elements[k - 1], m.elements[k], m.elements[k + 1])
        variables = [e.variable for e in m.elements]
        return rows.select(*(F.expr(_renamed(x, variables, m.path)).alias(n) for x, n in m.columns))

    def _step(self, rows: DataFrame, a: Element, e: Element, b: Element) -> DataFrame:
        x = self._edge(e)
        ends = (x.source_key, x.source_ref), (x.target_key, x.target_ref)
        (from_key, from_ref), (to_key, to_ref) = reversed(ends) if e.backward else ends
        edges = self.table(x.table)
        edges = edges.select(*(F.col(c).alias(f"{e.variable}__{c}") for c in edges.columns))
        if e.where:
            edges = edges.filter(_renamed(e.where, [e.variable]))
        rows = rows.join(edges, F.col(f"{a.variable}__{from_ref}") == F.col(f"{e.variable}__{from_key}"))
        if b.variable in (a.variable,) or f"{b.variable}__{to_ref}" in rows.columns:
            return rows.filter(F.col(f"{b.variable}__{to_ref}") == F.col(f"{e.variable}__{to_key}"))
        vertices, _ = self._vertices(b)
        return rows.join(vertices, F.col(f"{e.variable}__{to_key}") == F.col(f"{b.variable}__{to_ref}"))

    def _shortest(self, m: Match) -> DataFrame:
        """Pairs of vertices with the number of edges of a shortest path between them: one or more, or none where the pattern says so."""
        a, e, b = m.elements
        x = self._edge(e)
        sources, source_key = self._vertices(a)
        targets, target_key = self._vertices(b)
        edges = self.table(x.table)
        keys = (x.target_key, x.source_key) if e.backward else (x.source_key, x.target_key)
        if e.where:
            edges = edges.select(*(F.col(c).alias(f"{e.variable}__{c}") for c in edges.columns)).filter(_renamed(e.where, [e.variable]))
            keys = tuple(f"{e.variable}__{k}" for k in keys)
        steps = edges.select(F.col(keys[0]).alias("_u"), F.col(keys[1]).alias("_v")).distinct().checkpoint()
        front = sources.select(F.col(source_key).alias("_s")).distinct().withColumn("_u", F.col("_s"))
        # A level is written once, and read by those after it.
        levels = [front.select("_s", F.col("_u").alias("_t"), F.lit(0).alias("_hops"))] if e.zero else []
        hops = 0
        while True:
            hops += 1
            front = front.join(steps, "_u").select("_s", F.col("_v").alias("_u")).distinct()
            if levels:
                seen = reduce(DataFrame.unionAll, levels).select("_s", F.col("_t").alias("_u"))
                front = front.join(seen, ["_s", "_u"], "left_anti")
            front = front.checkpoint()
            levels.append(front.select("_s", F.col("_u").alias("_t"), F.lit(hops).alias("_hops")))
            if front.isEmpty():
                break
        found = reduce(DataFrame.unionAll, levels)
        return found.join(sources, F.col("_s") == F.col(source_key)).join(targets, F.col("_t") == F.col(target_key))


def _renamed(text: str, variables: list[str], path: str | None = None) -> str:
    """variable.column as the frame's column, and path_length(p) as the number of edges."""
    if path:
        text = re.sub(rf"\bpath_length\s*\(\s*{path}\s*\)", "`_hops`", text, flags=re.I)
    for v in variables:
        text = re.sub(rf"(?<![\w.]){v}\.[`\"]?(\w+)[`\"]?", rf"`{v}__\1`", text)
    return text
