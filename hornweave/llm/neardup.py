"""Near-duplicate detection: min-max hashing, banding, and links confirmed on full shingle sets.

Both the minimum and the maximum of a set are kept under every permutation, so a
signature takes half as many hash evaluations. Minima and maxima are banded apart.

1. Texts with equal sets (a 128-bit key) become one node, named by its least id.
2. Nodes that share a band are candidates. In every bucket each node is compared with
   the bucket's least node on full sets; confirmed links give components.
3. A bucket whose nodes are then in several components still has pairs that were not
   compared. Its nodes outside its largest component are compared with all others whose
   sets are of a similar size (sizes fall into classes; a link needs equal or
   neighbouring ones), in blocks of bounded size that return a spanning forest of the
   links they find. So the links of a bucket are never lost, pairs are never listed, and
   a group of near copies that hangs together costs a comparison for each member.
4. Components over both kinds of links.

Buckets of very many nodes are joined apart from the others, see join_large().

Defined cases: a text without words (or null) has an empty set, no links and its own id;
a text of fewer words than a shingle is one shingle; rows that share an id are one node;
a row with a null id takes part in links and gets the least id it reaches, null (and
kept) if none; an empty table gives an empty result; further columns of the input,
whatever their names, are ignored here and kept by deduplicate().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_prefix, text_chunks, written
from .components import components
from .hashing import mix, shingle_sets


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    #: Links need a Jaccard similarity of at least this many hundredths.
    percent: int = 75
    #: Permutations; each gives two signature values.
    permutations: int = 80
    #: Values in a band. With 40 bands a pair at similarity 0.75 shares no band with probability 3e-7.
    rows: int = 4
    #: Nodes in a block of step 3: two blocks of sets are in a worker's memory at once.
    block: int = 256
    #: Buckets of more nodes are large, see join_large().
    large: int = 1_000
    #: Large buckets that are broadcast at most; of more, the plain join is left to adaptive splitting of skewed partitions.
    most_large: int = 200_000


#: Ids of nodes without a document id start here.
NAMELESS = 1 << 62


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def band_keys(offsets: np.ndarray, hashes: np.ndarray, p: NearDupParams) -> np.ndarray:
    """(sets, bands) for sets that all have members: bands of minima, then bands of maxima."""
    starts = offsets[:-1]
    low = np.zeros((len(starts), 0), np.uint64)
    keys_low, keys_high = [], []
    for i, a in enumerate(_multipliers(p.permutations)):
        h = hashes * a
        h ^= h >> np.uint64(31)
        if i % p.rows == 0:
            low = high = np.full(len(starts), i + 1, np.uint64)
        low = mix(low + np.minimum.reduceat(h, starts))
        high = mix(high + np.maximum.reduceat(h, starts) + np.uint64(1 << 32))
        if i % p.rows == p.rows - 1:
            keys_low.append(low)
            keys_high.append(high)
    return np.stack([*keys_low, *keys_high], axis=1)


def set_keys(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each (non-empty) set."""
    return np.add.reduceat(mix(hashes + np.uint64(1)), offsets[:-1]), np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1])


def signatures(docs: DataFrame, doc_id: str, text: str, p: NearDupParams) -> DataFrame:
    """(doc_id, text_key, n_shingles, k1, k2, bands) of every row; keys and bands are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                offsets, hashes = shingle_sets(part.column("text").to_pylist(), p.shingle)
                counts = np.diff(offsets)
                full = np.flatnonzero(counts)
                k1, k2 = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
                lists: list = [None] * len(counts)
                if len(full):
                    bounds = np.append(offsets[full], len(hashes))
                    k1[full], k2[full] = (k.view(np.int64) for k in set_keys(bounds, hashes))
                    for i, row in zip(full.tolist(), band_keys(bounds, hashes, p).view(np.int64), strict=True):
                        lists[i] = row
                none = counts == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(counts.astype(np.int64)), pa.array(k1, mask=none), pa.array(k2, mask=none), pa.array(lists, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_shingles", "k1", "k2", "bands"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, k1 long, k2 long, bands array<long>")


def shingle_rows(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, p: NearDupParams) -> DataFrame:
    """(node, members) of the documents that are nodes: the full sets."""
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    named = rows.where("node is not null").join(nodes, "node", "left_semi").unionAll(rows.where("node is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                offsets, hashes = shingle_sets(part.column("text").to_pylist(), p.shingle)
                full = np.flatnonzero(np.diff(offsets))
                if not len(full):
                    continue
                k1, _ = set_keys(np.append(offsets[full], len(hashes)), hashes)
                node = [part.column("node")[i].as_py() for i in full.tolist()]
                node = [nameless(k) if x is None else x for x, k in zip(node, k1.tolist(), strict=True)]
                signed = hashes.view(np.int64)
                sets = pa.ListArray.from_arrays(pa.array(np.append(offsets[full], len(hashes)).astype(np.int32)), pa.array(signed))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), sets], names=["node", "members"])

    return named.mapInArrow(run, "node long, members array<long>").dropDuplicates(["node", "members"])


def nameless(k1: int) -> int:
    return NAMELESS + k1 % (1 << 61)


def _group_nodes(sigs: DataFrame) -> DataFrame:
    """(k1, k2, node, n_shingles, bands) of every distinct set."""
    named = F.coalesce(F.min("doc_id"), F.lit(NAMELESS) + F.pmod(F.col("k1"), F.lit(1 << 61)))
    return sigs.where("n_shingles > 0").groupBy("k1", "k2").agg(named.alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))


def join_large(rows: DataFrame, table: DataFrame, on: list[str], size: str, p: NearDupParams) -> DataFrame:
    """rows.join(table, on), where ``table`` (of written()) has one row for each key and the number of its ``rows`` in ``size``.

    The rows of large keys are joined where they are, by a broadcast of those keys' rows of ``table``, so none of
    them gathers in one task. The number of such keys is looked at before.
    """
    large = table.where(F.col(size) > p.large)
    n = large.count()
    if not 0 < n <= p.most_large:
        return rows.join(table, on)
    rest = rows.join(F.broadcast(large.select(*on)), on, "left_anti").join(table.where(F.col(size) <= p.large), on)
    return rows.join(F.broadcast(large), on).unionByName(rest)


def _candidates(groups: DataFrame, p: NearDupParams) -> DataFrame:
    """(key, node, n_shingles, hub, size) of every node in a bucket of two nodes or more; a node of several sets has a row, and counts, for each.

    Only rows of such buckets, a small share of all, are freed of repetitions.
    """
    keys = groups.select("node", "n_shingles", F.explode(F.array_distinct("bands")).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("size")).where("hub <> last").drop("last")
    return join_large(keys, written(shared, "neardup_buckets"), ["key"], "size", p).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(100 * common >= p.percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _open_blocks(members: DataFrame, labels: DataFrame, p: NearDupParams) -> DataFrame:
    """(key, i, j, node, rest, label) for step 3: each row of a task (key, i, j) compares the ``rest`` nodes of two blocks with all nodes of both.

    A block holds nodes of one bucket and one class of set sizes, either of the bucket's largest component or of its
    other, ``rest``, nodes. The sizes of linked sets differ by the factor of the least similarity at most, which is
    a class's width, so nodes of classes that are neither equal nor neighbours have no link.
    """
    width = -math.log(p.percent / 100) * (1 + 1e-9)
    size_class = F.floor(F.ln("n_shingles") / width).cast("int")
    rows = members.where("size > 2").select("key", "node", "n_shingles").join(labels, "node", "left")
    rows = rows.select("key", "node", F.coalesce("component", "node").alias("label"), size_class.alias("class")).distinct()
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    by_key = by_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("n_all")).where("labels > 1")
    rows = join_large(rows, written(by_key.drop("labels"), "neardup_open"), ["key"], "n_all", p)
    rows = written(rows.select("key", "node", "label", "class", (F.col("label") != F.col("main")).alias("rest")), "neardup_open_rows")
    blocks = rows.groupBy("key", "class").agg(F.count("*").alias("n"), F.ceil(F.count_if(~F.col("rest")) / p.block).cast("int").alias("main"), F.ceil(F.count_if("rest") / p.block).cast("int").alias("rest"))
    # for every class of a bucket, the blocks of its neighbours too
    near = blocks.select("key", F.explode(F.array(*[(F.col("class") + F.lit(d)).alias("c") for d in (-1, 0, 1)])).alias("class"), F.struct(F.col("class").alias("of"), "main", "rest").alias("b"))
    near = near.groupBy("key", "class").agg(F.collect_list("b").alias("near"))
    sides = blocks.select("key", "class", "n", F.col("main").alias("own_main"), F.col("rest").alias("own_rest")).join(near, ["key", "class"])
    rows = join_large(rows, written(sides, "neardup_sides"), ["key", "class"], "n", p)
    block = lambda c, rest, k: (c.cast("long") * 2 + rest.cast("long")) * F.lit(1 << 32) + k.cast("long")
    own = F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("rest"), F.col("own_rest")).otherwise(F.col("own_main")), F.lit(1)))
    rows = rows.withColumn("own", block(F.col("class"), F.col("rest"), own))
    ids = lambda b, rest, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: block(b["of"], F.lit(rest), k))
    some = lambda b, rest, n: F.when(n > 0, ids(b, rest, n)).otherwise(F.array().cast("array<long>"))
    others = F.flatten(F.transform("near", lambda b: F.concat(some(b, True, b["rest"]), F.when(F.col("rest"), some(b, False, b["main"])).otherwise(F.array().cast("array<long>")))))
    rows = rows.select("key", "node", "rest", "label", "own", F.explode(others).alias("other"))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "rest", "label")


def spanning_links(nodes: np.ndarray, rest: np.ndarray, labels: np.ndarray, offsets: np.ndarray, values: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between ``rest`` nodes and all nodes of one task, as a forest over the labels given."""
    n = len(nodes)
    sizes = np.diff(offsets)
    _, column = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    by_column = np.argsort(column, kind="stable")
    first = np.searchsorted(column[by_column], np.arange(column.max() + 2 if len(column) else 1))
    holders = owner[by_column]
    links = []
    for k in np.flatnonzero(rest).tolist():
        mine = column[offsets[k] : offsets[k + 1]]
        common = np.bincount(np.concatenate([holders[first[c] : first[c + 1]] for c in mine.tolist()]), minlength=n)
        for m in np.flatnonzero(100 * common >= percent * (sizes[k] + sizes - common)).tolist():
            a, b = root(int(labels[k])), root(int(labels[m]))
            if a != b:
                parent[a] = b
                links.append((int(nodes[k]), int(nodes[m])))
    return links


def _block_links(blocks: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """Runs spanning_links() for every task; a task's rows stand together after sorting."""
    rows = blocks.join(sets, "node").select("key", "i", "j", "node", "rest", "label", "members")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    percent = p.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key = None

        def solve(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
            t = pa.Table.from_batches(parts).combine_chunks()
            member = t.column("members").combine_chunks()
            offsets = np.concatenate([[0], np.cumsum(member.value_lengths().to_numpy())]).astype(np.int64)
            get = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            return spanning_links(get("node"), get("rest"), get("label"), offsets, member.flatten().to_numpy(), percent)

        def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j")], strict=True))
            links, start = [], 0
            for at in range(1, len(keys) + 1):
                if at < len(keys) and keys[at] == keys[start]:
                    continue
                if held and held_key != keys[start]:
                    links += solve(held)
                    held = []
                held.append(batch.slice(start, at - start))
                held_key, start = keys[at - 1], at
            yield emit(links)
        if held:
            yield emit(solve(held))

    return rows.mapInArrow(run, "a long, b long")


def _rooted(docs: DataFrame, doc_id: str, text: str, p: NearDupParams) -> DataFrame:
    """(doc_id, text_key, n_shingles, root, component_id, kept) for every row.

    ``root`` is the least node of the row's component, which a component without any id has too; null for an empty set.
    """
    sigs = written(signatures(docs, doc_id, text, p), "neardup_signatures")
    groups = written(_group_nodes(sigs), "neardup_groups")
    members = written(_candidates(groups, p), "neardup_members")
    sets = written(shingle_rows(docs, members.select("node").distinct(), doc_id, text, p), "neardup_sets")
    pairs = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = written(_confirm(pairs, sets, p), "neardup_links")
    more = written(_block_links(_open_blocks(members, components(links), p), sets, p), "neardup_more")
    discard(members, sets)
    labels = components(links.unionAll(more))
    discard(links, more)
    named = groups.select("k1", "k2", "node").join(labels, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("root"))
    out = sigs.select("doc_id", "text_key", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).when(F.col("root") < NAMELESS, F.col("root"))
    return out.select("doc_id", "text_key", "n_shingles", "root", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: NearDupParams = NearDupParams()) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every row."""
    return _rooted(docs, doc_id, text, p).drop("root")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of ``docs`` with one row left of each component; rows with empty sets all stay."""
    found = _rooted(docs, doc_id, text, p)
    stay = found.where("kept and n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("row")).select("row.*")
    own = fresh_prefix(docs.columns)
    number, key = F.col(doc_id).cast("long"), F.xxhash64(text)
    rows = docs.withColumn(own + "id", number).withColumn(own + "key", key)
    s = stay.select(F.col("doc_id").alias(own + "id2"), F.col("text_key").alias(own + "key2"))
    one = rows.join(s, F.col(own + "id").eqNullSafe(F.col(own + "id2")) & (F.col(own + "key") == F.col(own + "key2")), "left_semi")
    one = one.dropDuplicates([own + "id", own + "key"])
    empty = rows.where(F.coalesce(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0)
    return one.unionAll(empty).drop(own + "id", own + "key")
