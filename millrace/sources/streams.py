"""A piping line as streams between its ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.graphs import owners
from millrace.scratch import written

#: Steps inside one loop of a line before it is an error; lines have few and small loops.
MOST_STEPS = 1_000_000


def _loops(after: dict) -> dict:
    """Node to its strongly connected component, numbered so that a component comes after all it leads to."""
    number, low, open_, of, count = {}, {}, [], {}, 0
    for root in after:
        if root in number:
            continue
        stack = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        open_.append(root)
        while stack:
            node, rest = stack[-1]
            for x in rest:
                if x not in number:
                    number[x] = low[x] = len(number)
                    open_.append(x)
                    stack.append((x, iter(after[x])))
                    break
                if x not in of:
                    low[node] = min(low[node], number[x])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == number[node]:
                    while True:
                        x = open_.pop()
                        of[x] = count
                        if x == node:
                            break
                    count += 1
    return of


def _inside(start, after: dict, of: dict) -> tuple[dict, dict]:
    """Simple paths from ``start`` within its loop: the smallest to each node, and the smallest to each node where no way is left."""
    reached, stuck, steps = {}, {}, 0
    stack = [(start,)]
    while stack:
        path = stack.pop()
        at, steps = path[-1], steps + 1
        if steps > MOST_STEPS:
            raise RuntimeError(f"a loop of a line has more than {MOST_STEPS} paths")
        reached[at] = min(path, reached.get(at, path))
        ahead = [x for x in after[at] if x not in path]
        if not ahead:
            stuck[at] = min(path, stuck.get(at, path))
        stack += [(*path, x) for x in ahead if of[x] == of[start]]
    return reached, stuck


def line_paths(edges: list[tuple]) -> list[tuple]:
    """``(start, end, path)``: every end of a line that a simple path from one of its entries comes to, with the smallest such path.

    An entry has no edge into it; a line without one is entered at its
    smallest node. A path ends where all nodes ahead are on it. Ends are found
    component by component, from the last to the first, so the work grows with
    edges and ends and not with the number of paths.
    """
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    after = {a: sorted(bs) for a, bs in after.items()}
    into = {b for bs in after.values() for b in bs}
    entries = sorted(set(after) - into) or [min(after)]
    of = _loops(after)
    members: dict = {}
    for node, c in of.items():
        members.setdefault(c, []).append(node)
    met = {x for a, bs in after.items() for x in bs if of[a] != of[x]} | set(entries)
    onward: dict = {}  # node: end -> nodes up to the next component, and the node there
    for c in sorted(members):
        for x in members[c]:
            if x not in met:
                continue
            reached, stuck = ({x: (x,)}, {} if after[x] else {x: (x,)}) if len(members[c]) == 1 else _inside(x, after, of)
            if len(members[c]) == 1 and after[x] == [x]:
                stuck = {x: (x,)}
            best = {end: (path, None) for end, path in stuck.items()}
            for y, path in reached.items():
                for s in after[y]:
                    if of[s] != c:
                        for end in onward[s]:
                            if end not in best or (*path, s) < (*best[end][0], *((best[end][1],) if best[end][1] is not None else ())):
                                best[end] = (path, s)
            onward[x] = best
    out = []
    for start in entries:
        for end in sorted(onward[start]):
            path, at = [], start
            while at is not None:
                own, at = onward[at][end]
                path += own
            out.append((start, end, path))
    return out


def streams(edges: DataFrame, terminals: DataFrame | None = None) -> DataFrame:
    """A stream for each pair of ends of each line: ``(file, line, stream, start, end, path, from_kind, from_of, to_kind, to_of, same_line_as)``.

    ``edges(file, line, a, b)`` are cut line by line, a piping line at a time.
    ``terminals(file, id, kind, of)`` are nodes where the sheet's piping ends:
    ``unit`` (of names it), ``battery limit`` or ``broken``; an end that is none
    takes the nearest one before it (behind it), by steps and id, through all
    lines of the file, else it is ``closed``. Streams with a closed end count
    only where a line has no other: then its first pair. They are numbered by
    start and end in their line, and each but the first names the first.
    Repeated edges have no effect; an edge from a node to itself is an end
    there if nothing else follows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    own = edges.select("file", "line", "a", "b").where("a is not null and b is not null").distinct()

    def of_line(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = line_paths(list(rows[["a", "b"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"file": [key[0]] * len(found), "line": [key[1]] * len(found), "start": [x[0] for x in found], "end": [x[1] for x in found], "path": [x[2] for x in found]})

    pairs = own.groupBy("file", "line").applyInPandas(of_line, f"file {kinds['file']}, line {kinds['line']}, start {kinds['a']}, end {kinds['a']}, path array<{kinds['a']}>")
    if terminals is None:
        terminals = own.select("file", F.col("a").alias("id"), F.lit("").alias("kind"), F.lit("").alias("of")).limit(0)
    pairs = written(pairs, "pairs")
    named = terminals.select("file", "id", "kind", "of").dropDuplicates(["file", "id"])
    node = F.struct("file", "id")
    links = own.select(F.struct("file", F.col("a").alias("id")).alias("a"), F.struct("file", F.col("b").alias("id")).alias("b"))
    starts = named.select(node.alias("id"))
    found = pairs
    for end, way in (("from", links), ("to", links.select(F.col("b").alias("a"), F.col("a").alias("b")))):
        near = owners(starts, way).select(F.col("id.file").alias("_file"), F.col("id.id").alias("_id"), F.col("owner.id").alias("_owner"))
        at = near.join(named, (F.col("_file") == F.col("file")) & (F.col("_owner") == F.col("id"))).select("_file", "_id", F.col("kind").alias(f"{end}_kind"), F.col("of").alias(f"{end}_of"))
        side = F.col("start" if end == "from" else "end")
        found = found.join(at, (F.col("file") == F.col("_file")) & (side == F.col("_id")), "left").drop("_file", "_id").withColumn(f"{end}_kind", F.coalesce(f"{end}_kind", F.lit("closed")))
    line = Window.partitionBy("file", "line")
    shut = (F.col("from_kind") == "closed") | (F.col("to_kind") == "closed")
    placed = found.withColumn("_shut", shut.cast("int")).withColumns({"_open": F.min("_shut").over(line), "_k": F.row_number().over(line.orderBy("_shut", "start", "end"))})
    kept = placed.where("_shut = 0 or (_open = 1 and _k = 1)")
    first = F.when(F.col("_k") > 1, F.lit(1))
    return kept.select("file", "line", F.col("_k").alias("stream"), "start", "end", "path", "from_kind", "from_of", "to_kind", "to_of", first.alias("same_line_as"))
