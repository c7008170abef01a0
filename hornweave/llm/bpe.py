"""Byte-level BPE encoding and decoding over a minimal acyclic transducer lexicon.

Frequent words of the corpus are compiled, with the token ids they encode to, into an
automaton that shares prefixes and suffixes (incremental minimisation of a sorted word
list). States are flat arrays in one file, shipped with ``SparkContext.addFile`` and
memory-mapped by all Python workers of an executor. A word's rank among the accepted
words (the sum of the counts passed on its way) addresses its ids. Words that the
automaton doesn't accept are merged exactly, by rank. The file is in the shared folder.

Defined cases: null text is empty and has no tokens; a special token's string inside a
text becomes its id, as the tokenizers library does; repeated rows get equal results; a
column of the input named ``ids`` or ``decoded`` (in any case) is replaced.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import put_file, text_chunks, written

#: Fixed value: the published pre-tokenisation pattern of byte-level BPE vocabularies.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words compiled into the lexicon at most; all others are merged when met, so this bounds memory only.
LEXICON_WORDS = 50_000
#: Longer words are left to merging.
MAX_WORD_BYTES = 48
#: Distinct words that a task counts before it hands its counts on.
COUNTED_WORDS = 300_000
#: Bytes of text that are encoded together.
ENCODE_BYTES = 2 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


NO_MERGE = np.int32(2**31 - 1)
#: Words up to this many bytes are merged together, by numpy; longer ones one by one.
TOGETHER_BYTES = 48


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[start[0]:start[0] + size[0]]``, then the next slice, and so on."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)]


class Vocabulary:
    """Tokens and merges of a byte-level vocabulary, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in raw["added_tokens"]}
        as_bytes = lambda s: bytes(byte_of[c] for c in s)
        id_of = {as_bytes(k): v for k, v in raw["model"]["vocab"].items() if k not in self.special}
        bytes_of = [b""] * (max([*id_of.values(), *self.special.values()]) + 1)
        for k, v in [*id_of.items(), *((k.encode(), v) for k, v in self.special.items())]:
            bytes_of[v] = k
        self.token_bytes = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)
        self.token_size = np.array([len(x) for x in bytes_of], dtype=np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.byte_id = np.array([id_of[bytes((b,))] for b in range(256)], dtype=np.int32)
        merges = [[as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m)] for m in raw["model"]["merges"]]
        key = np.array([(id_of[a] << 32) | id_of[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order.astype(np.int32)
        self.merged_id = np.array([id_of[a + b] for a, b in merges], dtype=np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids; NO_MERGE if there is none or an id is negative."""
        want = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pair_key, want), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == want) & (left >= 0) & (right >= 0), self.pair_rank[at], NO_MERGE)

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of all words: the lowest-ranked adjacent pair, leftmost first, is merged until none is left."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out_size = np.zeros(len(words), dtype=np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []  # (words, their ids one after another)
        for low, high in ((0, 8), (8, 16), (16, TOGETHER_BYTES)):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(some):
                rows, ids = self._merge_matrix([words[i] for i in some.tolist()], sizes[some], high)
                out_size[some] = np.bincount(rows, minlength=len(some))
                out.append((some[rows], ids))
        for i in np.flatnonzero(sizes > TOGETHER_BYTES).tolist():
            ids = np.array(self._merge_long(words[i]), dtype=np.int32)
            out_size[i] = len(ids)
            out.append((np.full(len(ids), i), ids))
        if not out:
            return np.zeros(0, np.int32), out_size
        owner, ids = (np.concatenate(x) for x in zip(*out, strict=True))
        return ids[np.argsort(owner, kind="stable")], out_size

    def _merge_matrix(self, words: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of the tokens of words of at most ``width`` bytes, in order."""
        n, cols = len(words), np.arange(width)
        ids = np.full((n, width + 1), -1, dtype=np.int32)
        ids[:, :width][cols < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        done_rows, done_ids = [], []
        while len(live):
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            best = ranks[row, at]
            more = best < NO_MERGE
            if not more.all():
                r, c = np.nonzero(ids[~more] >= 0)
                done_rows.append(live[~more][r])
                done_ids.append(ids[~more][r, c])
                live, ids, ranks, at, best = live[more], ids[more], ranks[more], at[more], best[more]
                row = np.arange(len(live))
                if not len(live):
                    break
            moved = cols + (cols > at[:, None])  # the place right of the merged one goes
            ids[:, :width] = np.take_along_axis(ids, moved, axis=1)
            ids[row, at] = self.merged_id[best]
            ranks = np.take_along_axis(ranks, np.minimum(moved, width - 1), axis=1)
            ranks[row, at] = self.ranks(ids[row, at], ids[row, at + 1])
            inner = at > 0
            ranks[row[inner], at[inner] - 1] = self.ranks(ids[row[inner], at[inner] - 1], ids[row[inner], at[inner]])
        rows, found = np.concatenate(done_rows), np.concatenate(done_ids)
        order = np.argsort(rows, kind="stable")
        return rows[order], found[order]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap over a linked list: n log n for very long words."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)]
        first = self.ranks(ids[:-1], ids[1:]).tolist()
        ids = ids.tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < NO_MERGE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := int(self.ranks(np.array([ids[i]]), np.array([ids[j]]))[0])) < NO_MERGE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = int(self.merged_id[rank]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]


# --- the lexicon -----------------------------------------------------------------


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words, as arrays.

    State s owns edges ``first[s]`` to ``first[s + 1]``, sorted by label; ``skip`` of an
    edge is the number of accepted words that sort before those through it.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    labels: list[int] = []
    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) - 1 > common:
            child = freeze(path.pop())
            path[-1][1].append((labels.pop(), child))
        for b in word[common:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        child = freeze(path.pop())
        path[-1][1].append((labels.pop(), child))
    root = freeze(path[0])
    count = [0] * len(states)
    first, label, target, skip = [0], [], [], []
    for s, (final, edges) in enumerate(states):  # children come before parents
        n = int(final)
        for b, t in edges:
            label.append(b)
            target.append(t)
            skip.append(n)
            n += count[t]
        count[s] = n
        first.append(len(label))
    as_int = lambda x: np.array(x, dtype=np.int32)
    return {"first": as_int(first), "label": as_int(label), "target": as_int(target), "skip": as_int(skip), "final": as_int([f for f, _ in states]), "root": as_int([root])}


def lexicon_file(words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """The file of an automaton. ``words``: sorted and distinct; ``ids``: the tokens of each, ``sizes`` of them."""
    arrays = build_automaton(words)
    owner = np.repeat(np.arange(len(arrays["first"]) - 1), np.diff(arrays["first"]))
    arrays["edge"] = owner * 256 + arrays.pop("label")  # state and label: one sorted list to search in
    arrays |= {"start": np.cumsum(sizes) - sizes, "size": sizes, "ids": ids}
    header = json.dumps({k: len(v) for k, v in arrays.items()}).encode()
    return b"".join([len(header).to_bytes(8, "little"), header, b" " * (-len(header) % 8), *[v.astype(np.int64).tobytes() for v in arrays.values()]])


class Lexicon:
    """A memory-mapped automaton; many words are looked up together."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            sizes = json.loads(f.read(size))
        data, at = np.memmap(path, dtype=np.int64, mode="r"), (size + 7) // 8 + 1
        for name, n in sizes.items():
            setattr(self, name, np.asarray(data[at : at + n]))
            at += n

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word among those accepted, -1 if it isn't."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.edge):
            return out
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        live = np.flatnonzero(sizes <= MAX_WORD_BYTES)
        state, rank, at = np.full(len(live), self.root[0]), np.zeros(len(live), dtype=np.int64), 0
        while len(live):
            done = sizes[live] == at
            ends = done & (self.final[state] == 1)
            out[live[ends]] = rank[ends]
            live, state, rank = live[~done], state[~done], rank[~done]
            if not len(live):
                break
            want = state * 256 + text[starts[live] + at]
            edge = np.minimum(np.searchsorted(self.edge, want), len(self.edge) - 1)
            hit = self.edge[edge] == want
            live, edge = live[hit], edge[hit]
            state, rank, at = self.target[edge], rank[hit] + self.skip[edge], at + 1
        return out


# --- encoding --------------------------------------------------------------------


def pieces(text: str, special: regex.Pattern | None) -> list[str]:
    """Words of a text; a special token's string stands as a piece of its own."""
    if special is None or not special.search(text):
        return SPLIT.findall(text)
    out, at = [], 0
    for m in special.finditer(text):
        out += [*SPLIT.findall(text[at : m.start()]), m[0]]
        at = m.end()
    return out + SPLIT.findall(text[at:])


class Codec:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). The distinct words of the texts are looked up or merged together."""
        index: dict[str, int] = {}
        number = index.setdefault
        words_in, where = [], []
        for t in texts:
            split = pieces(t or "", self.special)
            words_in.append(len(split))
            where += [number(w, len(index)) for w in split]
        distinct = [w.encode("utf-8", "surrogatepass") for w in index]
        rank = self.lexicon.ranks(distinct)
        for word, i in self.vocabulary.special.items():
            if word in index:
                rank[index[word]] = -2 - i
        known, unseen, special = np.flatnonzero(rank >= 0), np.flatnonzero(rank == -1), np.flatnonzero(rank < -1)
        merged, merged_size = self.vocabulary.merge_many([distinct[i] for i in unseen.tolist()])
        size = np.ones(len(distinct), dtype=np.int64)
        start = np.zeros(len(distinct), dtype=np.int64)
        n_lexicon = len(self.lexicon.ids)
        size[known], start[known] = self.lexicon.size[rank[known]], self.lexicon.start[rank[known]]
        size[unseen], start[unseen] = merged_size, n_lexicon + np.cumsum(merged_size) - merged_size
        start[special] = n_lexicon + len(merged) + np.arange(len(special))
        flat = np.concatenate([self.lexicon.ids, merged, -2 - rank[special]]).astype(np.int32)
        at = np.array(where, dtype=np.int64)
        ids = ragged(flat, start[at], size[at])
        ends = np.concatenate([[0], np.cumsum(size[at])])[np.cumsum([0, *words_in])]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of lists of ids that stand one after another."""
        v = self.vocabulary
        size = v.token_size[ids]
        data = ragged(v.token_bytes, v.token_start[ids], size).tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *counts])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


_CACHE: dict[str, Codec] = {}


def _codec(name: str, vocabulary) -> Codec:
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = Codec(vocabulary.value, Lexicon(SparkFiles.get(name)))
    return _CACHE[name]


def frequent_words(docs: DataFrame, text: str, limit: int = LEXICON_WORDS) -> list[str]:
    """The pieces of the most frequent words, split at white space, of all texts: at most ``limit`` words, equally frequent ones together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in text_chunks(batch, text):
                for t in part.column(text).to_pylist():
                    seen.update((t or "").split())
                if len(seen) > COUNTED_WORDS:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    rows = docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(rows.where((F.octet_length("word") < MAX_WORD_BYTES) & (F.col("n") > 1)), "bpe_words")
    least, words = None, 0
    # words by count, the most frequent first, until the next count would exceed the limit: no more words than that are collected
    for n, k in counted.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(limit).collect():
        words += k
        if words > limit:
            break
        least = n
    top = [] if least is None else counted.where(F.col("n") >= least).select("word").collect()
    return sorted({piece for r in top for piece in SPLIT.findall(" " + r[0])})


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


@dataclass
class SharedCodec:
    """Handle to a vocabulary (broadcast: its size is the file's) and a lexicon file on every executor."""

    name: str
    vocabulary: object

    def on_worker(self) -> Codec:
        return _codec(self.name, self.vocabulary)


def prepare(docs: DataFrame, vocabulary_path: str, text: str = "text", lexicon_words: int = LEXICON_WORDS) -> SharedCodec:
    """Compiles the frequent words of ``docs`` and ships the lexicon."""
    vocabulary = Vocabulary(vocabulary_path)
    words = sorted(w.encode("utf-8", "surrogatepass") for w in frequent_words(docs, text, lexicon_words))
    spark = docs.sparkSession
    name = f"lexicon-{uuid.uuid4().hex}"
    spark.sparkContext.addFile(put_file(spark, name, lexicon_file(words, *vocabulary.merge_many(words))))
    return SharedCodec(name, spark.sparkContext.broadcast(vocabulary))


def _list_array(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))


def _appended(df: DataFrame, chunk_column: str | None, fields: list[T.StructField], fn, drop: tuple[str, ...] = ()) -> DataFrame:
    """Appends the Arrow arrays that ``fn`` makes of each chunk."""
    df = df.drop(*[f.name for f in fields])
    kept = [c for c in df.columns if c not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, chunk_column, ENCODE_BYTES) if chunk_column else (batch,):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *fn(part)], names=[*kept, *[f.name for f in fields]])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], *fields]))


IDS, DECODED = T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())


def encode(docs: DataFrame, codec: SharedCodec, text: str = "text") -> DataFrame:
    """Appends ``ids``, the tokens of every whole text."""
    return _appended(docs, text, [IDS], lambda part: [_list_array(*codec.on_worker().encode(part.column(text).to_pylist()))])


def decode(encoded: DataFrame, codec: SharedCodec) -> DataFrame:
    """Appends ``decoded``, the text of ``ids``."""

    def run(part: pa.RecordBatch) -> list:
        ids = part.column("ids")
        counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return [pa.array(codec.on_worker().decode(ids.flatten().to_numpy(), counts), pa.string())]

    return _appended(encoded, None, [DECODED], run)


def round_trip(docs: DataFrame, codec: SharedCodec, text: str = "text") -> DataFrame:
    """encode() and decode() in one pass, with ``text`` dropped: one Python worker for each task instead of two."""

    def run(part: pa.RecordBatch) -> list:
        worker = codec.on_worker()
        ids, counts = worker.encode(part.column(text).to_pylist())
        stored = _list_array(ids, counts)
        return [stored, pa.array(worker.decode(stored.values.to_numpy(), counts), pa.string())]

    return _appended(docs, text, [IDS, DECODED], run, drop=(text,))


def digest(decoded: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
    return decoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(text).cast("binary"), 256).alias("decoded_sha256"),
    )
