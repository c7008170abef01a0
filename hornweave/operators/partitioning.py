"""Partitioning strategies for an edge table, and how much structure parts retain.

Every strategy returns (part_id, h, r, t). Orders are md5 of the triple and a seed, so
results are reproducible in any engine. Numbering is done by range partitions and one
offset for each of them, never by a window over all rows. Strategies whose published
form assigns nodes one after another run here as synchronous rounds. Nodes are names, or
numbers of graph.numbered().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..storage import discard, written
from . import rounds
from .graph import numbered_nodes, ranked

TRIPLE = ["h", "r", "t"]


def shuffled(seed: int) -> Column:
    return F.md5(F.concat_ws("|", "h", "r", "t", F.lit(str(seed))))


def random_nonoverlap(edges: DataFrame, max_edges: int, seed: int = 2025) -> DataFrame:
    """Consecutive pieces of ``max_edges`` of a shuffled edge list."""
    # the order of the 16 bytes is that of their digits
    rows = ranked(edges.select(*TRIPLE, F.unhex(shuffled(seed)).alias("key")), [F.col("key")], "n", TRIPLE)
    return rows.select(F.floor(F.col("n") / max_edges).cast("long").alias("part_id"), *TRIPLE)


def random_multi(edges: DataFrame, max_edges: int, k: int, seed: int = 2025) -> DataFrame:
    """``k`` independent shufflings; their parts are numbered one after another."""
    per = math.ceil(edges.count() / max_edges)
    out = None
    for i in range(k):
        one = random_nonoverlap(edges, max_edges, seed + i).withColumn("part_id", F.col("part_id") + i * per)
        out = one if out is None else out.unionAll(one)
    return out


def pack_groups(groups: DataFrame, key: str, max_edges: int) -> list[tuple]:
    """Next-fit packing on the driver of a few named groups (name, n), largest first: [(name, first part, parts)]."""
    out, part, load = [], 0, 0
    for name, n in sorted(((r[key], r["n"]) for r in groups.select(key, "n").collect()), key=lambda x: (-x[1], x[0])):
        if n > max_edges:
            part += load > 0
            pieces = -(-n // max_edges)
            out.append((name, part, pieces))
            part, load = part + pieces, 0
        else:
            if load + n > max_edges:
                part, load = part + 1, 0
            out.append((name, part, 1))
            load += n
    return out


def relation_centric(edges: DataFrame, max_edges: int, seed: int = 2025) -> DataFrame:
    """Relations stay together where they fit; a larger one is split into shuffled pieces. Relations are few: packed on the driver."""
    packed = pack_groups(edges.groupBy("r").agg(F.count("*").alias("n")), "r", max_edges)
    plan = F.broadcast(edges.sparkSession.createDataFrame(packed, f"r {edges.schema['r'].dataType.simpleString()}, first long, pieces long"))
    rows = edges.select(*TRIPLE).join(plan, "r")
    whole = rows.where("pieces = 1").select(F.col("first").alias("part_id"), *TRIPLE)
    split = ranked(rows.where("pieces > 1").withColumn("key", F.unhex(shuffled(seed))), [F.col("r"), F.col("key")], "n", [*TRIPLE, "first"])
    starts = split.groupBy("r").agg(F.min("n").alias("n0"))
    split = split.join(F.broadcast(starts), "r").select((F.col("first") + F.floor((F.col("n") - F.col("n0")) / max_edges)).cast("long").alias("part_id"), *TRIPLE)
    return whole.unionAll(split)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("h", "t")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def hub_replication(edges: DataFrame, max_edges: int, threshold: float = 50, seed: int = 2025, tries: int = 20) -> DataFrame:
    """Edges at hubs go to every part, the others into shuffled pieces.

    The degree threshold grows by a fifth and one until hub edges leave room; after ``tries`` the parts are random. An
    edge is at a hub if the larger degree of its ends reaches the threshold, so one pass counts for all thresholds.
    """
    hubs = written(degrees(edges).where(F.col("degree") >= threshold), "hubs")
    marked = edges.select(*TRIPLE)
    for end in "ht":
        marked = marked.join(hubs.select(F.col("node").alias(end), F.col("degree").alias(f"d{end}")), end, "left")
    marked = marked.select(*TRIPLE, F.coalesce(F.greatest("dh", "dt"), F.lit(0)).alias("degree"))
    thresholds = [float(threshold)]
    while len(thresholds) < tries:
        thresholds.append(thresholds[-1] * 1.2 + 1)
    total, *hubs = marked.agg(F.count("*"), *[F.count_if(F.col("degree") >= x) for x in thresholds]).first()
    for limit, n_hub in zip(thresholds, hubs, strict=True):
        if n_hub < max_edges:
            parts = max(1, math.ceil((total - n_hub) / (max_edges - n_hub)))
            rest = random_nonoverlap(marked.where(F.col("degree") < limit), max_edges - n_hub, seed)
            copies = marked.where(F.col("degree") >= limit).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part_id"), *TRIPLE)
            return rest.unionAll(copies)
    return random_nonoverlap(edges, max_edges, seed)


def edge_cut(edges: DataFrame, parts: int, rounds: int = 3) -> DataFrame:
    """Nodes move to the part with most neighbours, less a tenth of its relative load; an edge follows its head.

    In each round one half of the nodes (by hash) moves, which keeps neighbours from swapping places.
    """
    near, nodes = _neighbours(edges, distinct=False)
    # a value is twice the part, and one for the second half
    near.set_values(nodes.select(F.col("id").alias("node"), (F.pmod(F.xxhash64("node"), F.lit(parts)) * 2 + F.pmod(F.xxhash64("node", F.lit(7)), F.lit(2))).alias("value")))
    for i in range(rounds):
        loads = dict(near.values().groupBy(F.shiftright("value", 1)).agg(F.count("*")).collect())  # a row for each part
        near.round(_mover(i % 2, loads, parts))
    place = written(_by_name(near.values().withColumn("value", F.shiftright("value", 1)), nodes), "edge_cut")
    near.done()
    return edges.select(*TRIPLE).join(place.withColumnRenamed("node", "h"), "h").select(F.col("value").alias("part_id"), *TRIPLE)


def _mover(half: int, loads: dict[int, int], parts: int) -> rounds.Update:
    cost = np.zeros(parts)
    mean = sum(loads.values()) / len(loads) if loads else 1
    for part, load in loads.items():
        cost[part] = 0.1 * load / mean

    def update(row: np.ndarray, heard: np.ndarray, values: np.ndarray) -> np.ndarray:
        row, part, votes = rounds.counted(row, heard >> 1)
        new = rounds.best(row, part, votes - cost[part])
        return np.where(values & 1 == half, new * 2 + (values & 1), values)

    return update


def _neighbours(edges: DataFrame, distinct: bool) -> tuple[rounds.Neighbours, DataFrame]:
    """The neighbours of numbered nodes, and (id, node)."""
    if isinstance(edges.schema["h"].dataType, LongType):
        near = rounds.Neighbours(edges, distinct)
        return near, near.values().select(F.col("node").alias("id"), "node")
    numbers, nodes = numbered_nodes(edges.select(*TRIPLE))
    near = rounds.Neighbours(numbers, distinct)
    discard(numbers)
    return near, nodes


def _by_name(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, value) with the nodes' names; numbers are their own."""
    if isinstance(nodes.schema["node"].dataType, LongType):
        return values
    return values.withColumnRenamed("node", "id").join(nodes, "id").select("node", "value")


def vertex_cut(edges: DataFrame, rows: int, columns: int) -> DataFrame:
    """A two-dimensional hash grid: a node is in at most rows + columns - 1 parts, and one pass balances the load."""
    part = F.pmod(F.xxhash64("h"), F.lit(rows)) * columns + F.pmod(F.xxhash64("t"), F.lit(columns))
    return edges.select(part.alias("part_id"), *TRIPLE)


def propagate_labels(edges: DataFrame, sweeps: int = 5) -> DataFrame:
    """(node, label) after synchronous majority sweeps over neighbours; ties go to the least label, and a node votes for itself."""
    near, nodes = _neighbours(edges, distinct=True)
    for _ in range(sweeps):
        near.round(_majority)
    label = _by_name(near.values(), nodes)
    if not isinstance(nodes.schema["node"].dataType, LongType):
        label = label.join(nodes.select(F.col("id").alias("value"), F.col("node").alias("label")), "value")
    else:
        label = label.withColumnRenamed("value", "label")
    label = written(label.select("node", "label"), "labels")
    near.done()
    return label


def _majority(row: np.ndarray, heard: np.ndarray, values: np.ndarray) -> np.ndarray:
    row, label, votes = rounds.counted(np.r_[row, np.arange(len(values))], np.r_[heard, values])
    return rounds.best(row, label, votes)


def communities(edges: DataFrame, max_edges: int, sweeps: int = 5) -> DataFrame:
    """Label propagation, then communities (an edge follows its head) laid one after another, largest first, and cut into parts."""
    heads = edges.groupBy(F.col("h").alias("node")).agg(F.count("*").alias("n")).join(propagate_labels(edges, sweeps), "node")
    heads = written(heads, "heads")
    size = heads.groupBy("label").agg(F.sum("n").alias("size"))
    rows = edges.select(*TRIPLE).join(heads.join(size, "label").select(F.col("node").alias("h"), "label", "size"), "h")
    laid = ranked(rows, [F.desc("size"), F.col("label"), *map(F.col, TRIPLE)], "place", TRIPLE)
    return laid.select(F.floor(F.col("place") / max_edges).cast("long").alias("part_id"), *TRIPLE)


def bfs_expansion(edges: DataFrame, max_edges: int, radius: int = 2, seed: int = 2025, coverage: float = 0.95, replication: float = 3.0) -> DataFrame:
    """Overlapping balls: all edges at the nodes within ``radius`` steps of a seed, so that paths near it stay together.

    Seeds are nodes not covered yet, in a hashed order, one, two, four and so on at a time, until ``coverage`` of all
    nodes are covered or the balls hold ``replication`` times all edges. Balls are laid one after another and cut into
    parts (an edge is once in a part), and edges that no ball has make further parts.
    """
    edges = edges.select(*TRIPLE)
    both = written(edges.select(F.explode(F.array(F.struct(F.col("h").alias("a"), F.col("t").alias("b")), F.struct(F.col("t").alias("a"), F.col("h").alias("b")))).alias("x")).select("x.*").distinct(), "bfs_neighbours")
    nodes = written(both.select(F.col("a").alias("node")).distinct().select("node", F.md5(F.concat_ws("|", "node", F.lit(str(seed)))).alias("place")), "bfs_nodes")
    total, all_nodes = edges.count(), nodes.count()
    covered = nodes.select("node").limit(0)
    balls, laid, turn = None, 0, 0
    while total:
        seeds = nodes.join(covered, "node", "left_anti").orderBy("place", "node").limit(1 << turn)
        # a turn's balls are numbered from their number on: one row for each
        number = F.row_number().over(Window.orderBy(F.md5(F.col("node").cast("string")), "node")) + F.lit((1 << turn) - 1).cast("long")
        ball = border = written(seeds.select("node", number.alias("ball")), "bfs_seeds")
        for _ in range(radius):
            reached = border.select(F.col("node").alias("a"), "ball").join(both, "a").select(F.col("b").alias("node"), "ball").distinct()
            border = written(reached.join(ball, ["node", "ball"], "left_anti"), "bfs_border")
            ball = ball.unionAll(border)
        ends = edges.join(ball.withColumnRenamed("node", "h"), "h").select("ball", *TRIPLE).unionAll(edges.join(ball.withColumnRenamed("node", "t"), "t").select("ball", *TRIPLE))
        # a turn's balls come after those before it
        rows = ranked(ends, [F.col("ball"), *map(F.col, TRIPLE)], "n", TRIPLE, distinct=True).withColumn("place", F.col("n") + laid).select("place", *TRIPLE)
        balls = rows if balls is None else balls.unionAll(rows)
        covered = written(covered.unionAll(ball.select("node")).distinct(), "bfs_covered")
        laid, turn = laid + rows.count(), turn + 1
        if covered.count() >= coverage * all_nodes or laid >= replication * total:
            break
    if balls is None:
        return edges.select(F.lit(0).cast("long").alias("part_id"), *TRIPLE)
    inside = balls.select(F.floor(F.col("place") / max_edges).cast("long").alias("part_id"), *TRIPLE).distinct()
    used = -(-laid // max_edges)
    rest = random_nonoverlap(edges.join(balls.select(*TRIPLE).distinct(), TRIPLE, "left_anti"), max_edges, seed).withColumn("part_id", F.col("part_id") + used)
    return inside.unionAll(rest)


def run_strategy(edges: DataFrame, name: str, max_edges: int, seed: int = 2025) -> DataFrame:
    """The parts of a named strategy."""
    parts = max(1, math.ceil(edges.count() / max_edges))
    return {
        "random_nonoverlap": lambda: random_nonoverlap(edges, max_edges, seed),
        "random_multi": lambda: random_multi(edges, max_edges, 2, seed),
        "edge_cut": lambda: edge_cut(edges, parts),
        "vertex_cut": lambda: vertex_cut(edges, math.isqrt(parts) or 1, -(-parts // (math.isqrt(parts) or 1))),
        "louvain": lambda: communities(edges, max_edges),
        "hub_replication": lambda: hub_replication(edges, max_edges, seed=seed),
        "bfs_expansion": lambda: bfs_expansion(edges, max_edges, seed=seed),
        "relation_centric": lambda: relation_centric(edges, max_edges, seed),
    }[name]()


def strategy_metrics(parts: DataFrame, name: str, cycles: bool = True) -> DataFrame:
    """One row: parts, replication and the retention of two-step paths and two-cycles (with ``cycles``, of triangles too)."""
    parts = written(parts, f"parts_{name}")
    out = replication(parts).withColumn("strategy", F.lit(name))
    kinds = {"pt": retention_paths, "c2": retention_cycles2} | ({"c3": retention_cycles3} if cycles else {})
    shares = [f(parts).select(F.col("total").alias(f"{k}_total"), F.col("kept").alias(f"{k}_kept"), F.col("retention").alias(f"{k}_retention")) for k, f in kinds.items()]
    for share in shares:
        out = out.crossJoin(share)  # single rows
    total, kept = (sum((F.col(f"{k}_{x}") for k in kinds), F.lit(0)) for x in ("total", "kept"))
    return out.withColumn("overall_retention", F.when(total > 0, kept / total))


def placements(parts: DataFrame) -> DataFrame:
    """One row: placed edges, those that differ in a part, different edges, edges of the largest part.

    Nodes and relations are numbers; edges are dealt to blocks by their ends and compared there in numpy.
    """
    n = max(1, -(-4 * parts.count() // rounds.BLOCK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, r, t in rounds._held(batches):
            for block, *x in rounds._dealt((h * 31 + t) % n, part, h, r, t):
                yield rounds._row(schema, block=block, **dict(zip(("part", "h", "r", "t"), x, strict=True)))

    def count(table: pa.Table) -> pa.Table:
        part, h, r, t = (np.concatenate([rounds._read(x, "int64") for x in table[c]]) for c in ("part", "h", "r", "t"))
        order = np.lexsort((part, t, r, h))
        part, h, r, t = part[order], h[order], r[order], t[order]
        new = (h[1:] != h[:-1]) | (r[1:] != r[:-1]) | (t[1:] != t[:-1])
        edges = 1 + int(np.count_nonzero(new))
        return pa.table({"placed": [len(part)], "different": [1 + int(np.count_nonzero(new | (part[1:] != part[:-1])))], "edges": [edges]})

    schema = "block int, part binary, h binary, r binary, t binary"
    longs = parts.select(*[F.col(c).cast("long").alias(c) for c in ("part_id", *TRIPLE)])
    counts = longs.mapInArrow(pack, schema).repartition(n, "block").groupBy("block").applyInArrow(count, "placed long, different long, edges long")
    counts = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("placed", "different", "edges")])
    return counts.crossJoin(parts.groupBy("part_id").agg(F.count("*").alias("m")).agg(F.max("m").alias("largest")))  # single rows


# --- statistics and retention ----------------------------------------------------


def part_stats(parts: DataFrame) -> DataFrame:
    """Edges and distinct nodes of every part, in one pass: an edge is counted at its head."""
    ends = F.array(F.struct(F.col("h").alias("node"), F.lit(1).cast("long").alias("n")), F.struct(F.col("t").alias("node"), F.lit(0).cast("long").alias("n")))
    nodes = parts.select("part_id", F.inline(ends)).groupBy("part_id", "node").agg(F.sum("n").alias("n"))
    return nodes.groupBy("part_id").agg(F.sum("n").alias("edges"), F.count("*").alias("nodes"))


def replication(parts: DataFrame) -> DataFrame:
    """Parts, edges kept and distinct, their ratio, distinct nodes."""
    placed = parts.agg(F.count("*").alias("edges_total"), F.count_distinct("part_id").alias("parts"))
    distinct = parts.select(*TRIPLE).distinct().agg(F.count("*").alias("edges"))
    nodes = parts.select(F.explode(F.array("h", "t")).alias("node")).distinct().agg(F.count("*").alias("nodes_unique"))
    return placed.crossJoin(distinct).crossJoin(nodes).withColumn("replication_factor", F.col("edges_total") / F.col("edges"))  # single rows


def parts_of_edges(parts: DataFrame) -> DataFrame:
    """(h, r, t, parts): the (few) parts that hold each edge."""
    return parts.groupBy(*TRIPLE).agg(F.collect_set("part_id").alias("parts"))


def _share(*columns: str) -> Column:
    common = F.col(columns[0])
    for c in columns[1:]:
        common = F.array_intersect(common, F.col(c))
    return F.size(common) > 0


def _kept(rows: DataFrame, kept: Column, anchors: int = 1) -> DataFrame:
    s = rows.agg((F.count("*") * anchors).alias("total"), (F.count_if(kept) * anchors).alias("kept"))
    return s.withColumn("retention", F.when(F.col("total") > 0, F.col("kept") / F.col("total")))


def _named(edges: DataFrame, a: str, b: str, i: int) -> DataFrame:
    return edges.select(F.col("h").alias(a), F.col("r").alias(f"r{i}"), F.col("t").alias(b), F.col("parts").alias(f"p{i}"))


def _capped(edges: DataFrame, cap: int | None) -> DataFrame:
    """Without edges from nodes of more than ``cap`` outgoing edges."""
    if cap is None:
        return edges
    return edges.join(edges.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("h"), "h", "left_semi")


def _weighed(e: DataFrame) -> DataFrame:
    """Edges that can be in a cycle, with the numbers of two-step paths through their ends: (h, r, t, parts, w_h, w_t)."""
    e = written(e.where("h <> t"), "edge_parts")
    ends = e.select(F.inline(F.array(F.struct(F.col("h").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("t").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    weight = ends.groupBy("node").agg((F.sum("o") * F.sum("i")).alias("w")).where("w > 0")
    for end in "ht":
        e = e.join(weight.select(F.col("node").alias(end), F.col("w").alias(f"w_{end}")), end)
    return written(e, "weighed_edges")


def retention_paths(parts: DataFrame) -> DataFrame:
    """Two-step paths whose edges share a part. Counted from the parts at each middle node, never listing the paths of a hub.

    Exact when every edge is in one part; replicated edges are joined pair by pair.
    """
    e = parts_of_edges(parts)
    if parts.groupBy(*TRIPLE).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        into = e.groupBy(F.col("t").alias("m"), F.col("parts")[0].alias("p")).agg(F.count("*").alias("a"))
        out = e.groupBy(F.col("h").alias("m"), F.col("parts")[0].alias("p")).agg(F.count("*").alias("b"))
        kept = into.join(out, ["m", "p"]).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("kept"))
        total = into.groupBy("m").agg(F.sum("a").alias("a")).join(out.groupBy("m").agg(F.sum("b").alias("b")), "m").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("total"))
        return total.crossJoin(kept).withColumn("retention", F.when(F.col("total") > 0, F.col("kept") / F.col("total")))
    return _kept(_named(e, "n0", "n1", 0).join(_named(e, "n1", "n2", 1), "n1"), _share("p0", "p1"))


def retention_cycles2(parts: DataFrame) -> DataFrame:
    """Ordered pairs of edges (h, r1, t), (t, r2, h)."""
    e = parts_of_edges(parts)
    return _kept(_named(e, "n0", "n1", 0).join(_named(e, "n1", "n0", 1), ["n0", "n1"]), _share("p0", "p1"))


def retention_cycles3(parts: DataFrame, cap: int | None = None) -> DataFrame:
    """Triangles of three different nodes, one for each anchor.

    Without ``cap`` each is found once, from its node with the fewest two-step paths, and counted for its three anchors.
    """
    e = parts_of_edges(parts)
    if cap is None:
        e = _weighed(e)
        wedges = _named(e.where("w_h > w_t or w_h = w_t and h > t"), "n0", "n1", 0).join(_named(e.where("w_t > w_h or w_h = w_t and t > h"), "n1", "n2", 1), "n1").where("n0 <> n2")
        return _kept(wedges.join(_named(e, "n2", "n0", 2), ["n2", "n0"]), _share("p0", "p1", "p2"), 3)
    rows = _named(e, "n0", "n1", 0).join(_named(_capped(e, cap), "n1", "n2", 1), "n1").where("n0 <> n1 and n1 <> n2 and n0 <> n2")
    return _kept(rows.join(_named(e, "n2", "n0", 2), ["n2", "n0"]), _share("p0", "p1", "p2"))


def retention_cycles4(parts: DataFrame, cap: int | None = None) -> DataFrame:
    """Squares of four different nodes, one for each anchor.

    Without ``cap`` each is found once, as two paths that meet at its node with most two-step paths, and counted for its four anchors.
    """
    e = parts_of_edges(parts)
    if cap is None:
        e = _weighed(e)
        last = [F.col("w_t").alias("w2"), F.col("h").alias("n1"), F.col("t").alias("n2"), F.col("parts").alias("p1")]
        first = [F.col("w_h").alias("w2"), F.col("h").alias("n2"), F.col("t").alias("n3"), F.col("parts").alias("p2")]
        down = e.where("w_h > w_t or w_h = w_t and h > t").select(F.col("w_h").alias("w0"), F.col("h").alias("n0"), F.col("t").alias("n1"), F.col("parts").alias("p0"))
        up = e.where("w_t > w_h or w_h = w_t and t > h").select(F.col("w_t").alias("w0"), F.col("h").alias("n3"), F.col("t").alias("n0"), F.col("parts").alias("p3"))
        out = down.join(e.select(*last), "n1").where("w0 > w2 or w0 = w2 and n0 > n2").select("n0", "n1", "n2", "p0", "p1")
        back = up.join(e.select(*first), "n3").where("w0 > w2 or w0 = w2 and n0 > n2").select("n0", "n2", "n3", "p2", "p3")
        return _kept(out.join(back, ["n0", "n2"]).where("n1 <> n3"), _share("p0", "p1", "p2", "p3"), 4)
    c = _capped(e, cap)
    rows = _named(e, "n0", "n1", 0).join(_named(c, "n1", "n2", 1), "n1").where("n0 <> n1 and n1 <> n2 and n0 <> n2")
    rows = rows.join(_named(c, "n2", "n3", 2), "n2").where("n3 <> n0 and n3 <> n1 and n3 <> n2")
    return _kept(rows.join(_named(e, "n3", "n0", 3), ["n3", "n0"]), _share("p0", "p1", "p2", "p3"))


def overall_retention(*tables: DataFrame) -> DataFrame:
    """Kept over total, over all structures."""
    rows = tables[0].select("total", "kept")
    for t in tables[1:]:
        rows = rows.unionAll(t.select("total", "kept"))
    return rows.agg(F.sum("total").alias("total"), F.sum("kept").alias("kept")).withColumn("retention", F.when(F.col("total") > 0, F.col("kept") / F.col("total")))
