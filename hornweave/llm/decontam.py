"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

The alphabet is words. A pattern is 13 consecutive words of a benchmark item, or a
whole shorter item. Patterns of one length share a table: blocks of two words give
the shift, a hash bucket of the pattern's last block (and its first one, the prefix)
gives the candidates, and a direct comparison of all words confirms an occurrence.

Defined cases: null text (or text without words) has no words, no hits, no items; an
item without words gives no pattern; an item without an id gives hits like any other,
but no id to the list of items; repeated rows get equal results; repeated items count
once by id; an empty benchmark hits nothing; columns of the input that are named as the
added ones (in any case) are replaced, unless a ``prefix`` keeps them apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh_prefix, text_chunks, written

WINDOW = 13
BLOCK = 2
#: Benchmark text that is compiled and broadcast at once; a larger benchmark is searched for in blocks of this size.
#: The tables take about 110 times that in a Python worker (880 MB measured for 8 MB of distinct words).
MAX_BENCHMARK_BYTES = 4 << 20

_FOLD = bytes(32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b < 0x5B else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class PatternTable:
    """Wu-Manber tables for patterns of one length."""

    length: int
    shift: dict = field(default_factory=dict)  # block -> safe shift; a block in no pattern shifts the most
    buckets: dict = field(default_factory=dict)  # hash of the last and the first block -> patterns

    def add(self, words: list[bytes], at: int, ids: tuple[str, ...]) -> None:
        """The pattern words[at : at + length]; one that is there already gets the ids too."""
        size, end_of = min(BLOCK, self.length), at + self.length
        for end in range(at + size, end_of + 1):
            block = tuple(words[end - size : end])
            step = end_of - end
            if self.shift.get(block, self.length) > step:
                self.shift[block] = step
        bucket = self.buckets.setdefault(hash((*words[end_of - size : end_of], *words[at : at + size])), [])
        pattern = words[at:end_of]
        for k, (other, start, known) in enumerate(bucket):
            if other[start : start + self.length] == pattern:
                if not set(ids) <= set(known):
                    bucket[k] = (other, start, tuple(sorted({*known, *ids})))
                return
        bucket.append((words, at, ids))

    def search(self, words: list[bytes]) -> list[tuple[int, tuple[str, ...]]]:
        """(start, items) of every occurrence."""
        m, size, n = self.length, min(BLOCK, self.length), len(words)
        shift, buckets, most = self.shift.get, self.buckets, self.length - min(BLOCK, self.length) + 1
        found, end = [], m
        while end <= n:
            block = tuple(words[end - size : end])
            step = shift(block, most)
            if step:
                end += step
                continue
            start = end - m
            window = words[start:end]
            for other, at, items in buckets.get(hash((*block, *window[:size])), ()):
                if other[at : at + m] == window:
                    found.append((start, items))
            end += 1
        return found


class Matcher:
    def __init__(self, items: list[tuple], window: int = WINDOW):
        """items: (id or None, text); a word's bytes are held once, a pattern is a place in its item's words."""
        tables: dict[int, PatternTable] = {}
        one: dict[bytes, bytes] = {}
        for item_id, text in items:
            words = [one.setdefault(w, w) for w in words_of(text)]
            length = min(len(words), window)
            table = tables.setdefault(length, PatternTable(length)) if words else None
            for i in range(len(words) - length + 1 if words else 0):
                table.add(words, i, () if item_id is None else (str(item_id),))
        self.tables = list(tables.values())

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans (start, end) that lie in an occurrence, and the ids of the items met."""
        spans, ids = [], set()
        for t in self.tables:
            for start, items in t.search(words):
                spans.append((start, start + t.length))
                ids.update(items)
        return merge_spans(spans), ids


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [tuple(x) for x in merged]


#: Columns that find_contamination() adds.
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),  # start, end, start, end ... in words
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def _columns(found: Iterator[tuple[int, list[tuple[int, int]], set[str]]]) -> list[list]:
    """FIELDS from (number of words, merged spans, ids) of every text."""
    rows = [(n, sum(b - a for a, b in spans), [x for span in spans for x in span], sorted(ids)) for n, spans, ids in found]
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    max_benchmark_bytes: int = MAX_BENCHMARK_BYTES, prefix: str = "",
) -> DataFrame:
    """Adds to every row its word count, the merged hit spans and the sorted ids of the items found.

    The benchmark is measured first. Up to ``max_benchmark_bytes`` it is one broadcast. A
    larger one is dealt into blocks by a hash of the item; each block's pass over the texts
    gives the hits of the (distinct) texts that have any, and all of them are joined to the
    rows once, by two hashes of the text.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // max_benchmark_bytes) or 1
    fields = [T.StructField(prefix + f.name, f.dataType) for f in FIELDS]
    if blocks == 1:
        shared, key = sc.broadcast([tuple(r) for r in items.collect()]), uuid.uuid4().hex

        def search(texts):
            matcher = _matcher(key, shared)
            return _columns((len(w), *matcher.search(w)) for w in map(words_of, texts))

        return append_columns(docs, text, fields, search)

    hits = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        one = _block_hits(docs, text, sc.broadcast([tuple(r) for r in part.collect()]))
        hits = one if hits is None else hits.unionAll(one)
    hits = written(hits.distinct(), "decontam_hits").groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("ids")).alias("ids"))
    own = fresh_prefix(docs.columns)
    keys = [F.xxhash64(text).alias(own + "k1"), F.xxhash64(F.lit(1), text).alias(own + "k2")]
    hits = hits.select(*[F.col(c).alias(own + c) for c in hits.columns])
    rows = docs.select("*", *keys).join(hits, [own + "k1", own + "k2"], "left").drop(own + "k1", own + "k2")

    def finish(texts, spans, ids):
        return _columns((len(words_of(t)), merge_spans(list(zip((s or [])[::2], (s or [])[1::2], strict=True))), set(i or ())) for t, s, i in zip(texts, spans, ids, strict=True))

    return append_columns(rows, text, fields, finish, inputs=[own + "spans", own + "ids"]).drop(own + "spans", own + "ids")


def _block_hits(docs: DataFrame, text: str, shared) -> DataFrame:
    """(k1, k2, spans, ids) of the texts that hold a pattern of one block of the benchmark."""
    rows = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.col(text).alias("text"))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                matcher = _matcher(key, shared)
                found = [matcher.search(words_of(t)) for t in part.column("text").to_pylist()]
                some = [k for k, (spans, _) in enumerate(found) if spans]
                spans = [[x for span in found[k][0] for x in span] for k in some]
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1").take(pa.array(some, pa.int64())), part.column("k2").take(pa.array(some, pa.int64())), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(found[k][1]) for k in some], pa.list_(pa.string()))],
                    names=["k1", "k2", "spans", "ids"],
                )

    return rows.mapInArrow(run, "k1 long, k2 long, spans array<long>, ids array<string>")


_CACHE: dict[str, Matcher] = {}


def _matcher(key: str, shared) -> Matcher:
    """Tables are compiled once in each Python worker (block keys are hashed within one process)."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Matcher(shared.value)
    return _CACHE[key]


def contaminated(prefix: str = "") -> Column:
    """Whether at least a twentieth of a document's words are hit, over what find_contamination() added."""
    hit, words = F.col(prefix + "n_hit"), F.col(prefix + "n_words")
    return (hit > 0) & (20 * hit >= words)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what find_contamination() added."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", contaminated())
