"""Language-model scoring: a Katz back-off model of any order (three by default) over the whole corpus.

P(w | u v) is the Good-Turing discounted relative frequency where the sequence was seen,
else alpha(u v) P(w | v), and so on down to the unigram, which is discounted too; all
unseen words share what that leaves. alpha(x) is what x's seen successors leave, over
what the lower order leaves them, so every context's distribution sums to one exactly.
A text's first word has the context "begin", its second one "begin" and the first word:
a history ends where the text begins.

Texts become chunks of token arrays once. Counts live in tables partitioned by context,
one level for each order. At a level a chunk sends each of its distinct sequences once to
the partition of the context; the partition answers with counts, with what the context's
successors add up to, and with a number by which the next level names the sequence. A
sequence that only one chunk has is marked so: that chunk knows all its continuations
and sends none of them. No table is broadcast or collected, a frequent sequence costs a
row for each chunk, and the successors of a very frequent context are dealt over several
partitions, whose sums its first partition adds up. All payloads are packed numpy arrays;
a text's score is then summed token by token inside its chunk, from the highest order
down.

What a chunk sends is proportional to its distinct sequences. It goes in one message for
each partition it has something for, so with a fixed size of chunks and partitions a very
large input has many small messages, at most one for each sequence: raise ``chunk_bytes``
and ``partition_tokens`` together with the executors' memory.

Defined cases: null text is empty, its only token is the end; without training rows
every token has probability one; rows that repeat are scored (and counted) each; a null
document id is never trained on; an empty table gives an empty result; other columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release_memory, text_chunks, written
from .hashing import mix, word_hashes


@dataclass(frozen=True)
class KatzParams:
    #: Length of the longest sequences counted.
    order: int = 3
    #: Counts above this aren't discounted.
    k: int = 5
    chunk_bytes: int = 8 << 20
    #: Tokens for each partition of the count tables.
    partition_tokens: int = 2_000_000
    #: A context seen more often is dealt over several partitions, one for about this many tokens.
    context_tokens: int = 500_000
    #: Rounds in which chunks, and partitions of the tables, are gone through: what is shuffled at once is a share of all.
    rounds: int = 2

    def __post_init__(self) -> None:
        if self.order < 2:
            raise ValueError("the order must be two or more")


#: Hashes that stand for the place before the first word, and for the end.
BEGIN, END = np.uint64(0x0B5E5D1F3C6A9E01), np.uint64(0x0E4D7A2B8C1F6E03)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed payload; equal bytes of numbers stand together."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        out.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        out.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(payload: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", data, at)
        dtype = np.dtype(kind.decode())
        at += 10
        planes = np.frombuffer(data, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size * dtype.itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    """Integers in the narrowest type that holds them."""
    low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
    return a.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first from zero; np.cumsum() undoes it."""
    return small(np.diff(a, prepend=a.dtype.type(0)))


# --- discounts -------------------------------------------------------------------


def discounts(counts_of_counts: list[int], k: int) -> np.ndarray:
    """Good-Turing discounts d[0..k] (d[0] unused) from n_1 .. n_{k+1}.

    One that isn't proper (between 0 and 1 and no less than the one before, as few large
    counts or many copies of texts can make it) is (r - 0.5) / r, or the one before if larger.
    """
    n = [0, *counts_of_counts]
    d = np.zeros(k + 1)
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        value = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = value if max(0.0, d[r - 1]) < value < 1 else max((r - 0.5) / r, d[r - 1])
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What is left of the counts."""
    k = len(d) - 1
    return np.where(c > k, 1.0, d[np.minimum(c, k)]) * c


class Unigrams:
    def __init__(self, total: int, types: int, counts_of_counts: list[int], k: int):
        self.total, self.types, self.k = total, types, k
        self.d = discounts(counts_of_counts, k)
        left = sum(r * n * (1 - self.d[r]) for r, n in enumerate(counts_of_counts[:k], 1)) / total if total else 1.0
        self.unseen = max(left, 0.5 / (total + 1)) if total else 1.0
        self.scale = (1 - self.unseen) / (1 - left) if left < 1 else 0.0

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of words counted c times; 0 stands for all unseen words together."""
        return np.where(c > 0, self.scale * discounted(c, self.d) / max(self.total, 1), self.unseen)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.types + 1)))


def weights(total: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, factor) of contexts seen ``total`` times, whose seen successors have the discounted count ``mass`` and the lower-order probability ``lower``.

    factor * mass / total + alpha * (1 - lower) is one. A context whose discounts leave
    (almost) nothing keeps half a count for other words.
    """
    seen = total > 0
    share = np.where(seen, mass / np.maximum(total, 1), 0.0)
    left = np.maximum(1 - share, 0.5 / (total + 1))
    rest = 1 - lower
    alpha = np.where(seen, left / np.maximum(rest, 1e-300), 1.0)
    factor = np.where(seen & (share > 0), (1 - left) / np.maximum(share, 1e-300), 1.0)
    return alpha, factor


# --- chunks ----------------------------------------------------------------------


def chunks_of(docs: DataFrame, p: KatzParams) -> DataFrame:
    """docs (doc_id, text, held_out, trains) as rows of token arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            texts = t.column("text").to_pylist()
            offsets, words = word_hashes(texts)
            distinct, tokens, n = np.unique(words, return_inverse=True, return_counts=True)
            # frequent words first: their places are small numbers, which compress better
            by_count = np.argsort(-n, kind="stable")
            place = np.empty(len(n), np.int32)
            place[by_count] = np.arange(len(n), dtype=np.int32)
            distinct, tokens = distinct[by_count], place[tokens]
            row = {
                "chunk": [number], "n_tokens": [len(words) + len(texts)], "doc_id": [t.column("doc_id").to_pylist()], "held_out": [t.column("held_out").to_pylist()],
                "trains": [t.column("trains").to_pylist()], "arrays": [pack(np.diff(offsets).astype(np.int32), np.diff(distinct, prepend=np.uint64(0)), tokens.astype(np.int32))],
            }
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            for part in text_chunks(batch, "text"):
                held.append(part)
                size += part.column("text").nbytes
                if size >= p.chunk_bytes:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    schema = pa.schema([
        ("chunk", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
        ("trains", pa.list_(pa.bool_())), ("arrays", pa.binary()),
    ])
    return docs.select("doc_id", "text", "held_out", "trains").mapInArrow(
        run, "chunk long, n_tokens long, doc_id array<long>, held_out array<boolean>, trains array<boolean>, arrays binary"
    )


@dataclass
class Level:
    """The distinct sequences of one length in a chunk."""

    context: np.ndarray  # each one without its last word: a place in the level below
    word: np.ndarray  # its last word: a place among the chunk's words
    shorter: np.ndarray  # each one without its first word: a place in the level below
    trained: np.ndarray  # how often the chunk's training texts have it
    of_token: np.ndarray  # the sequence that ends in each token; -1 too near the text's begin


@dataclass
class Known:
    """What the tables tell about the sequences of one level; arrays by place in the level."""

    count: np.ndarray
    #: Names in the tables; defined where a sequence isn't sole and was seen.
    number: np.ndarray
    #: Whether no other chunk has the sequence.
    sole: np.ndarray
    log_p: np.ndarray
    #: factor / count of each sequence of the level below as a context.
    scale: np.ndarray


class Chunk:
    """Token arrays of a chunk. Its local words are the distinct ones, then BEGIN and END."""

    def __init__(self, trains: list[bool], arrays: bytes):
        self.n_words, distinct, self.tokens = unpack(arrays)
        self.words = np.concatenate([np.cumsum(distinct, dtype=np.uint64), [BEGIN, END]]).astype(np.uint64)
        self.trains = np.array(trains, dtype=bool)

    def word_counts(self) -> np.ndarray:
        """Training counts of the local words; BEGIN's are contexts, not tokens."""
        use = np.repeat(self.trains, self.n_words)
        counts = np.bincount(self.tokens[use], minlength=len(self.words))
        counts[-2:] = self.trains.sum()
        return counts.astype(np.int64)

    def word_order(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Local words in the order in which they are sent: (places, partitions that get some, where each begins)."""
        dest = ((self.words >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
        return _grouped(np.lexsort((self.words, dest)), dest)

    def levels(self, order: int) -> list[Level]:
        """Sequences of two words, three words and so on."""
        per_doc = self.n_words.astype(np.int64) + 1
        ends = np.cumsum(per_doc)
        total = int(ends[-1]) if len(ends) else 0
        n = len(self.words)
        self.starts = ends - per_doc
        word = np.full(total, n - 1, dtype=np.int64)
        inner = np.ones(total, dtype=bool)
        inner[ends - 1] = False
        word[inner] = self.tokens
        self.word_of_token = word
        trained = np.repeat(self.trains, per_doc)
        begins = np.zeros(total, dtype=bool)
        begins[self.starts] = True
        lower, out = word, []
        for length in range(2, order + 1):
            context = np.concatenate([[-1], lower[:-1]]).astype(np.int64) if total else lower
            context[begins] = n - 1 - 1 if length == 2 else -1
            at = np.flatnonzero(context >= 0)
            key, place = np.unique(context[at] * n + word[at], return_inverse=True)
            # places within a chunk: 32 bits do
            of_token = np.full(total, -1, dtype=np.int32)
            of_token[at] = place
            shorter = np.zeros(len(key), dtype=np.int32)
            shorter[place] = lower[at]
            uses = np.bincount(place[trained[at]], minlength=len(key)).astype(np.int32)
            out.append(Level((key // n).astype(np.int32), (key % n).astype(np.int32), shorter, uses, of_token))
            lower = of_token
        return out


def _grouped(order: np.ndarray, dest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    there = dest[order]
    begins = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]])) if len(there) else np.zeros(0, np.int64)
    return order, there[begins], begins


def _slices(begins: np.ndarray, n: int) -> Iterator[slice]:
    for a, b in zip(begins.tolist(), [*begins.tolist()[1:], n], strict=False):
        yield slice(a, b)


def _runs(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


def _ranks(a: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), dtype=np.int64)
    out[np.argsort(a, kind="stable")] = np.arange(len(a))
    return out


def _sorted_by(dest: np.ndarray, parts: int, numbers: np.ndarray, context: np.ndarray, word_numbers: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by partition, the context's number and the word's number."""
    contexts, words = len(numbers), len(word_numbers)
    if parts * contexts * words >= 1 << 62:
        return np.lexsort((word_numbers[word], numbers[context], dest))
    return np.argsort((dest * contexts + _ranks(numbers)[context]) * words + _ranks(word_numbers)[word])


class Sending:
    """Which sequences of a level a chunk sends where: those whose context others have too and training texts have."""

    def __init__(self, level: Level, words: Known, below: Known, parts: int, p: KatzParams):
        mine = np.flatnonzero((below.count[level.context] > 0) & ~below.sole[level.context])
        context, word = level.context[mine], level.word[mine]
        spread = -(-below.count[context] // p.context_tokens)
        home = (mix(below.number.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)[context]
        slot = (mix(words.number.astype(np.uint64))[word] % np.maximum(spread, 1).astype(np.uint64)).astype(np.int64)
        dest = (home + slot) % parts
        order = _sorted_by(dest, parts, below.number, context, words.number, word)
        self.rows, self.dests, self.begins = mine[order], *_grouped(np.arange(len(mine)), dest[order])[1:]
        #: Contexts dealt over several partitions, in the order in which their own partitions are asked for the sums.
        wide = np.unique(context[spread > 1])
        at = (mix(below.number[wide].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        by_home = np.lexsort((below.number[wide], at))
        self.wide, self.wide_dests, self.wide_begins = wide[by_home], *_grouped(np.arange(len(wide)), at[by_home])[1:]


def _answers(rows: pa.Table, kind: str) -> list[list[np.ndarray]]:
    """Payloads of one kind that came back to a chunk, in the order of their partitions."""
    mine = [(d, x) for k, d, x in zip(rows.column("kind").to_pylist(), rows.column("dest").to_pylist(), rows.column("payload").to_pylist(), strict=True) if k == kind]
    return [unpack(x) for _, x in sorted(mine, key=lambda y: y[0])]


MESSAGE = "kind string, chunk long, dest long, payload binary, stats array<long>"
_MESSAGE = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("dest", pa.int64()), ("payload", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _messages(rows: list[tuple]) -> pa.Table:
    release_memory()
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_MESSAGE.types)], schema=_MESSAGE)


def _counts_of_counts(c: np.ndarray, k: int) -> list[int]:
    return np.bincount(c[(c > 0) & (c <= k + 1)], minlength=k + 2)[1:].tolist()


def _successor_sums(owner: np.ndarray, c: np.ndarray, contexts: int, k: int) -> list[np.ndarray]:
    """For every context, how many successors have the count 1 .. k, and the sum of larger counts."""
    sums = [np.bincount(owner[c == r], minlength=contexts).astype(np.int64) for r in range(1, k + 1)]
    return [*sums, np.bincount(owner[c > k], weights=c[c > k], minlength=contexts).astype(np.int64)]


# --- the exchanges ---------------------------------------------------------------


def _send_words(chunks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r["trains"], r["arrays"])
                order, dests, begins = c.word_order(parts)
                words, counts = c.words[order], c.word_counts()[order]
                rows = [("1", r["chunk"], d, pack(np.diff(words[s], prepend=np.uint64(0)), small(counts[s])), None) for d, s in zip(dests.tolist(), _slices(begins, len(order)), strict=True)]
                yield from _messages(rows).to_batches()

    return chunks.select("chunk", "trains", "arrays").mapInArrow(run, MESSAGE)


def _count_words(sent: DataFrame, parts: int, k: int) -> DataFrame:
    """Answers (number, count, sole) of every word sent, and the partition's part of the totals."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        dest = rows.column("dest")[0].as_py()
        got = [unpack(x) for x in rows.column("payload").to_pylist()]
        words, place = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([g[1] for g in got]), minlength=len(words)).astype(np.int64)
        sole = np.bincount(place, minlength=len(words)) == 1
        out, at = [], 0
        for chunk, g in zip(rows.column("chunk").to_pylist(), got, strict=True):
            mine = place[at : at + len(g[0])]
            out.append(("1", chunk, dest, pack(steps(mine), small(counts[mine]), sole[mine].astype(np.int8)), None))
            at += len(mine)
        real = counts[words != BEGIN]
        out.append(("stats", None, dest, None, [int(real.sum()), int((real > 0).sum()), *_counts_of_counts(real, k)]))
        return _messages(out)

    return sent.groupBy("dest").applyInArrow(run, MESSAGE)


def _totals(messages: DataFrame, n: int) -> list[int]:
    row = messages.where("kind = 'stats'").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(n)]).first()
    return [int(x or 0) for x in row]


@dataclass
class Model:
    """What the driver knows: bounded by the order and k."""

    unigrams: Unigrams
    #: Discounts of each length from two on.
    d: list[np.ndarray]


def _known_words(c: Chunk, rows: pa.Table, parts: int, unigrams: Unigrams) -> Known:
    order, dests, _ = c.word_order(parts)
    got = _answers(rows, "1")
    number, count, sole = np.empty(len(c.words), np.int64), np.empty(len(c.words), np.int64), np.empty(len(c.words), bool)
    number[order] = np.concatenate([np.cumsum(g[0], dtype=np.int64) * parts + d for g, d in zip(got, dests.tolist(), strict=True)])
    count[order], sole[order] = (np.concatenate([g[i] for g in got]) for i in (1, 2))
    return Known(count, number, sole, np.log10(unigrams.p(count)), np.zeros(0))


def _lower(count: np.ndarray, length: int, model: Model) -> np.ndarray:
    """Probability of a seen sequence's last word without its first one, but for the scale of that shorter sequence's context, from the shorter sequence's count.

    All successors of a context share that scale, so sums don't need it before they are used.
    """
    return model.unigrams.p(count) if length == 2 else discounted(count, model.d[length - 3])


def _known(levels: list[Level], length: int, words: Known, below: Known, rows: pa.Table, parts: int, model: Model, p: KatzParams) -> Known:
    """A level from the answers, and from the chunk itself for contexts that no other one has."""
    level = levels[length - 2]
    d, k, n = model.d[length - 2], p.k, len(level.context)
    send = Sending(level, words, below, parts, p)
    count, number, sole = level.trained.astype(np.int64), np.full(n, -1, dtype=np.int64), np.ones(n, dtype=bool)
    contexts = len(below.count)
    own = below.sole[level.context] & (below.count[level.context] > 0)
    seen = own & (count > 0)
    mass = np.bincount(level.context[seen], weights=discounted(count[seen], d), minlength=contexts)
    of_sums = lambda g: sum(d[r] * r * g[r - 1] for r in range(1, k + 1)) + g[k]
    lower = np.bincount(level.context[seen], weights=_lower(below.count[level.shorter[seen]], length, model), minlength=contexts)
    for dest, s, g in zip(send.dests.tolist(), _slices(send.begins, len(send.rows)), _answers(rows, str(length)), strict=True):
        at = send.rows[s]
        count[at] += g[0]
        if length < p.order:
            sole[at] = g[1]
            number[at[g[1] == 0]] = np.cumsum(g[2], dtype=np.int64) * parts + dest
        v = level.context[at]
        v = v[_runs(v)]
        mass[v] = of_sums(g[3:])
        lower[v[g[4 + k].astype(np.int64)]] = g[5 + k]
    for s, g in zip(_slices(send.wide_begins, len(send.wide)), _answers(rows, f"{length}s"), strict=True):
        mass[send.wide[s]] = of_sums(g)
        lower[send.wide[s]] = g[k + 1]
    if length > 2:
        lower = lower * below.scale[levels[length - 3].shorter]
    total = below.count.astype(float)
    alpha, factor = weights(total, mass, lower)
    scale = factor / np.maximum(total, 1)
    with np.errstate(divide="ignore"):
        high = np.log10(discounted(count, d) * scale[level.context])
    log_p = np.where(count > 0, high, np.log10(alpha)[level.context] + below.log_p[level.shorter])
    return Known(count, number, sole, log_p, scale)


def _all_known(c: Chunk, levels: list[Level], rows: pa.Table, parts: int, model: Model, p: KatzParams) -> list[Known]:
    """Words, then each level up to the last one whose discounts the model has."""
    out = [_known_words(c, rows, parts, model.unigrams)]
    for length in range(2, len(model.d) + 2):
        out.append(_known(levels, length, out[0], out[-1], rows, parts, model, p))
    return out


def _send(chunks: DataFrame, answers: DataFrame, length: int, parts: int, model: Model, p: KatzParams) -> DataFrame:
    """Sequences of one length on their way to their contexts' partitions, and the counts of those that needn't go."""

    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _messages([])
        c = Chunk(own.column("trains")[0].as_py(), own.column("arrays")[0].as_py())
        chunk = own.column("chunk")[0].as_py()
        levels = c.levels(length)
        known = _all_known(c, levels, rows, parts, model, p)
        level, words, below = levels[-1], known[0], known[-1]
        send = Sending(level, words, below, parts, p)
        low = below.count[level.shorter]
        out = []
        for dest, s in zip(send.dests.tolist(), _slices(send.begins, len(send.rows)), strict=True):
            at = send.rows[s]
            v, w, trained = level.context[at], level.word[at], level.trained[at]
            first = _runs(v)
            # a sum of lower-order probabilities is of use only where the chunk has a sequence that may be unseen
            asks = np.maximum.reduceat(trained == 0, first)
            distinct, place = np.unique(words.number[w], return_inverse=True)
            info = small(low[at])
            if length == 2:  # the count of a word: once for each word
                info = np.zeros(len(distinct), info.dtype)
                info[place] = low[at]
            payload = pack(
                steps(below.number[v[first]]), small(np.diff(np.append(first, len(v)))), asks.astype(np.int8), steps(distinct), small(place),
                small(trained), info, (below.count[v[first]] > p.context_tokens).astype(np.int8),
            )
            out.append((str(length), chunk, dest, payload, None))
        for dest, s in zip(send.wide_dests.tolist(), _slices(send.wide_begins, len(send.wide)), strict=True):
            out.append((f"{length}q", chunk, dest, pack(steps(below.number[send.wide[s]])), None))
        kept = below.sole[level.context] & (below.count[level.context] > 0)
        out.append(("stats", None, 0, None, _counts_of_counts(level.trained[kept], p.k)))
        return _messages(out)

    return chunks.select("chunk", "trains", "arrays").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, MESSAGE)


def _count(sent: DataFrame, length: int, parts: int, model: Model, p: KatzParams) -> DataFrame:
    """Answers how much more often others have every sequence sent; sends the sums of contexts dealt over several partitions to the contexts' own partitions."""
    k, last = p.k, length == p.order

    def run(rows: pa.Table) -> pa.Table:
        dest = rows.column("dest")[0].as_py()
        of = lambda kind: rows.filter(pc.equal(rows.column("kind"), kind))
        out = [tuple(r.values()) for r in of(f"{length}q").to_pylist()]  # answered by _add_up()
        stats = np.array([r for r in of("stats").column("stats").to_pylist()], dtype=np.int64).reshape(-1, k + 1).sum(axis=0)
        rows = of(str(length)).sort_by("chunk")
        if not rows.num_rows:
            return _messages([*out, ("stats", None, dest, None, stats.tolist())])
        got = [unpack(x) for x in rows.column("payload").to_pylist()]
        heads = [np.cumsum(g[0], dtype=np.int64) for g in got]
        numbers = [np.cumsum(g[3], dtype=np.int64)[g[4]] for g in got]
        context, run_place = np.unique(np.concatenate(heads), return_inverse=True)
        of_context = np.concatenate([np.repeat(x, g[1]) for x, g in zip(np.split(run_place, np.cumsum([len(h) for h in heads])[:-1]), got, strict=True)])
        key, place = np.unique((of_context << 40) | np.concatenate(numbers), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([g[5] for g in got]), minlength=len(key)).astype(np.int64)
        sole = np.bincount(place, minlength=len(key)) == 1
        low = np.zeros(len(key), dtype=np.int64)
        low[place] = np.concatenate([g[6][g[4]] if length == 2 else g[6] for g in got])
        info = _lower(low, length, model)
        seen = counts > 0
        owner = (key >> 40)[seen]
        sums = _successor_sums(owner, counts[seen], len(context), k)
        lower = np.bincount(owner, weights=info[seen], minlength=len(context))
        at = run_at = 0
        for chunk, g in zip(rows.column("chunk").to_pylist(), got, strict=True):
            mine, v = place[at : at + len(g[4])], run_place[run_at : run_at + len(g[0])]
            asks = np.flatnonzero(g[2])
            more = (np.zeros(0, np.int8), np.zeros(0, np.int8)) if last else (sole[mine].astype(np.int8), steps(mine[~sole[mine]]))
            out.append((str(length), chunk, dest, pack(small(counts[mine] - g[5]), *more, *[small(x[v]) for x in sums], small(asks), lower[v[asks]]), None))
            at, run_at = at + len(mine), run_at + len(v)
        wide = np.unique(run_place[np.concatenate([g[7] for g in got]).astype(bool)])
        home = (mix(context[wide].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order, dests, begins = _grouped(np.argsort(home, kind="stable"), home)
        for d, s in zip(dests.tolist(), _slices(begins, len(order)), strict=True):
            i = wide[order[s]]
            out.append((f"{length}c", dest, d, pack(context[i], *[x[i] for x in sums], lower[i]), None))
        out.append(("stats", None, dest, None, (stats + _counts_of_counts(counts, k)).tolist()))
        return _messages(out)

    return sent.groupBy("dest").applyInArrow(run, MESSAGE)


def _add_up(counted: DataFrame, length: int, k: int) -> DataFrame:
    """Answers the whole sums of contexts dealt over several partitions."""

    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _messages([])
        parts = [unpack(x) for x in told.sort_by("chunk").column("payload").to_pylist()]
        context, place = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        sums = [np.bincount(place, weights=np.concatenate([x[i] for x in parts]), minlength=len(context)) for i in range(1, k + 3)]
        dest, out = asked.column("dest")[0].as_py(), []
        for chunk, x in zip(asked.column("chunk").to_pylist(), asked.column("payload").to_pylist(), strict=True):
            at = np.searchsorted(context, np.cumsum(unpack(x)[0], dtype=np.int64))
            out.append((f"{length}s", chunk, dest, pack(*[s[at].astype(np.int64) for s in sums[:-1]], sums[-1][at]), None))
        return _messages(out)

    # columns of their own: the two sides of a cogroup mustn't share attributes
    of = lambda kind: counted.where(F.col("kind") == kind).select(*[F.col(c).alias(c) for c in ("chunk", "dest", "payload")])
    asked, told = of(f"{length}q"), of(f"{length}c")
    return asked.groupBy("dest").cogroup(told.groupBy("dest")).applyInArrow(run, MESSAGE)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(chunks: DataFrame, answers: DataFrame, parts: int, model: Model, p: KatzParams) -> DataFrame:
    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        names = RESULT.replace(",", "").split()[::2]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not own.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        c = Chunk(own.column("trains")[0].as_py(), own.column("arrays")[0].as_py())
        levels = c.levels(p.order)
        known = _all_known(c, levels, rows, parts, model, p)
        word, count = c.word_of_token, known[0].count
        log_p = known[0].log_p[word]
        for level, k in zip(levels, known[1:], strict=True):
            log_p = np.where(level.of_token >= 0, k.log_p[level.of_token], log_p) if len(k.log_p) else log_p
        sums = lambda x: np.add.reduceat(x, c.starts)
        n_docs = len(c.n_words)
        columns = [
            own.column("doc_id")[0].as_py(), own.column("held_out")[0].as_py(), c.n_words.astype(np.int64) + 1, sums((count[word] > 0).astype(np.int64)),
            np.full(n_docs, model.unigrams.total), sums(model.unigrams.base(count)[word]), sums(log_p),
        ]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, RESULT)


def _share(rows: DataFrame, key: str, i: int, p: KatzParams) -> DataFrame:
    """The rows of one round: all of a chunk or partition are in the same."""
    return rows.where(F.pmod(F.xxhash64(key), F.lit(p.rounds)) == i)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for other in tables[1:]:
        out = out.unionAll(other)
    return out


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", p: KatzParams = KatzParams()) -> DataFrame:
    """The RESULT columns of every row; rows with an id for which ``held_out`` doesn't hold train the model."""
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"), (~held & F.col(doc_id).isNotNull()).alias("trains"))
    chunks = written(chunks_of(rows, p), "katz_chunks")
    tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = int(-(-tokens // p.partition_tokens) or 1)
    words = written(_count_words(_send_words(chunks, parts), parts, p.k), "katz_words")
    total, types, *counts = _totals(words, p.k + 3)
    model = Model(Unigrams(total, types, counts, p.k), [])
    for_chunk = ("kind", "chunk", "dest", "payload")
    answers = words.where("kind = '1'").select(*for_chunk)
    for length in range(2, p.order + 1):
        sent = [written(_send(_share(chunks, "chunk", i, p), _share(answers, "chunk", i, p), length, parts, model, p), f"katz_sent_{length}") for i in range(p.rounds)]
        counted = _all([written(_count(_share(_all(sent), "dest", i, p), length, parts, model, p), f"katz_level_{length}") for i in range(p.rounds)])
        discard(*sent)
        model = Model(model.unigrams, [*model.d, discounts(_totals(counted, p.k + 1), p.k)])
        answers = answers.unionAll(counted.where(F.col("kind") == str(length)).select(*for_chunk)).unionAll(_add_up(counted, length, p.k).select(*for_chunk))
    return _all([written(_score(_share(chunks, "chunk", i, p), _share(answers, "chunk", i, p), parts, model, p), "katz_scores") for i in range(p.rounds)])
