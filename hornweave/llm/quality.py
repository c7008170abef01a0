"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled bad (0) or good (1) from features of itself and of its two
neighbours. A document's score is the mean of the forward-backward marginals of
``good``, weighted by line length.

Only documents are labelled; the labels of lines are latent. Weights are fitted on the
driver by the likelihood of the documents' labels given their scores. The gradient of a
mean of marginals is a covariance with the features, which two more forward-backward
passes give: with the lines' scores tilted a little to either side by what the likelihood
asks of them, expected features differ by it.

Defined cases: null text is empty; an empty text is one empty line and gets a score
like any other; without labelled rows, or with one label only, every score is the share
of label 1 (0.5 without rows); repeated rows get equal results; a document with several
label rows takes the smallest label, and for the fit one with several texts takes one of
them, by a hash; a column of the input named as the score (in any case) is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, text_chunks
from .hashing import word_hashes

FEATURES = (
    "empty", "log_chars", "log_words", "upper", "digit", "symbol", "space", "bar", "exclaim", "doubled_symbol",
    "word_length", "repeated_word", "distinct_words", "short_words", "ends_sentence", "starts_upper", "symbol_per_word",
)


@dataclass(frozen=True)
class QualityParams:
    #: Labelled documents to fit on, chosen by a hash of the id: the bound of the sample (about this many, one row each).
    max_documents: int = 3_000
    #: Consecutive lines that a document gives to the fit at most, from a place given by a hash of its text (scores take all lines).
    fit_lines: int = 500
    steps: int = 150
    rate: float = 0.08
    decay: float = 1e-3
    #: Size of the tilt.
    tilt: float = 1e-3


@dataclass
class CrfModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # over previous, own and next line's features, and 1: score of good against bad
    transition: np.ndarray  # (2, 2)
    prior: float | None = None  # set if nothing could be fitted


OTHER, SPACE, UPPER, LETTER, DIGIT = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = np.zeros(0x30000, dtype=np.uint8)
    for i in range(len(kind)):
        c = chr(i)
        kind[i] = SPACE if c.isspace() else UPPER if c.isupper() else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    return kind


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, characters of every line, lines of every text)."""
    texts = [t or "" for t in texts]
    joined = "\n".join(texts)
    n_lines = np.array([t.count("\n") + 1 for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = int(n_lines.sum())
    feed = codes == 10
    line = np.cumsum(feed)
    kind = _classes()[np.minimum(codes, 0x2FFFF)]
    inside = ~feed
    per_line = lambda mask: np.bincount(line[mask], minlength=total).astype(float)
    chars = per_line(inside)
    symbol = (kind == OTHER) & inside
    doubled = np.zeros(len(codes), dtype=bool)
    doubled[1:] = symbol[1:] & (codes[1:] == codes[:-1])
    ends = np.append(np.flatnonzero(feed), len(codes))
    begins = np.concatenate([[0], ends[:-1] + 1])
    filled = ends > begins
    last, first = np.zeros(total, dtype=np.uint32), np.zeros(total, dtype=np.uint8)
    last[filled], first[filled] = codes[ends[filled] - 1], kind[begins[filled]]
    offsets, words = word_hashes(joined.split("\n"))
    n_words = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(total), np.diff(offsets))
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((words, owner))
    fresh = np.ones(len(words), dtype=bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    space = (kind == SPACE) & inside
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space | feed, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    short = np.bincount(line[start[end - start <= 3]], minlength=total).astype(float) if len(start) else np.zeros(total)
    letters = per_line((kind == UPPER) | (kind == LETTER))
    some, word = np.maximum(chars, 1), np.maximum(n_words, 1)
    out = np.stack([
        chars == 0, np.log1p(chars), np.log1p(n_words), per_line(kind == UPPER) / np.maximum(letters, 1), per_line(kind == DIGIT) / some,
        per_line(symbol) / some, per_line(space) / some, per_line(codes == 124) / word, per_line(codes == 33) / word, per_line(doubled) / word,
        np.minimum(letters / word, 30), np.bincount(owner[again], minlength=total) / word, np.bincount(owner[order][fresh], minlength=total) / word,
        short / word, np.isin(last, [46, 33, 63]), first == UPPER, per_line(symbol) / word,
    ], axis=1)
    return out, chars, n_lines


def with_neighbours(x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Features of the previous, own and next line (0 beyond a text's ends) and a constant."""
    start = np.cumsum(n_lines) - n_lines
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[start], after[start + n_lines - 1] = 0, 0
    return np.concatenate([before, x, after, np.ones((len(x), 1))], axis=1)


def emissions(z: np.ndarray, n_lines: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """with_neighbours(z, n_lines) @ weights, without the wide table: what a line adds to the next, its own and the previous line's score."""
    added = z @ weights[:-1].reshape(3, -1).T
    start = np.cumsum(n_lines) - n_lines
    before, after = np.roll(added[:, 0], 1), np.roll(added[:, 2], -1)
    before[start], after[start + n_lines - 1] = 0, 0
    return before + added[:, 1] + after + weights[-1]


def forward_backward(good: np.ndarray, transition: np.ndarray, n_lines: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(P(good) of every line, log partition of every text, summed pair marginals); all texts step together."""
    start = np.cumsum(n_lines) - n_lines
    order = np.argsort(-n_lines, kind="stable")
    start, length = start[order], n_lines[order]
    longest = int(length[0]) if len(length) else 0
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(longest)]  # texts longer than t
    emit = np.stack([np.zeros(len(good)), good], axis=1)
    ahead, back = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    for t in range(longest):
        at = start[: live[t]] + t
        if t == 0:
            ahead[at] = emit[at]
        else:
            prev = ahead[at - 1]
            ahead[at] = emit[at] + np.logaddexp(prev[:, :1] + transition[0], prev[:, 1:] + transition[1])
    for t in range(longest - 2, -1, -1):
        at = start[: live[t + 1]] + t
        nxt = emit[at + 1] + back[at + 1]
        back[at] = np.logaddexp(nxt[:, :1] + transition[:, 0], nxt[:, 1:] + transition[:, 1])
    joint = ahead + back
    marginal = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -700, 700)))
    log_z = np.empty(len(length))
    log_z[order] = np.logaddexp(joint[start, 0], joint[start, 1])
    if not pairs:
        return marginal, log_z, None
    here = np.ones(len(good), dtype=bool)
    here[start + length - 1] = False
    at = np.flatnonzero(here)
    z = np.logaddexp(joint[at, 0], joint[at, 1])[:, None, None]
    both = ahead[at][:, :, None] + transition + (emit[at + 1] + back[at + 1])[:, None, :] - z
    return marginal, log_z, np.exp(both).sum(axis=0)


def fit_weights(x: np.ndarray, chars: np.ndarray, n_lines: np.ndarray, y: np.ndarray, p: QualityParams) -> CrfModel:
    """Maximum likelihood of the documents' labels, by full-batch gradient steps (Adam)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = with_neighbours((x - mean) / scale, n_lines)
    starts = np.cumsum(n_lines) - n_lines
    weight = np.maximum(chars, 1.0)
    weight /= np.repeat(np.add.reduceat(weight, starts), n_lines)
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, p.steps + 1):
        good, transition = z @ theta[:-4], theta[-4:].reshape(2, 2)
        marginal, _, _ = forward_backward(good, transition, n_lines)
        score = np.clip(np.add.reduceat(weight * marginal, starts), 1e-3, 1 - 1e-3)
        asked = np.repeat(np.where(y == 1, 1 / score, -1 / (1 - score)), n_lines) * weight
        up, _, pairs_up = forward_backward(good + p.tilt * asked, transition, n_lines, pairs=True)
        down, _, pairs_down = forward_backward(good - p.tilt * asked, transition, n_lines, pairs=True)
        gradient = np.concatenate([z.T @ (up - down), (pairs_up - pairs_down).reshape(-1)]) / (2 * p.tilt * len(y)) - p.decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return CrfModel(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def line_marginals(texts: list[str | None], model: CrfModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of every line, its weight, lines of every text)."""
    x, chars, n_lines = line_features(texts)
    good, _, _ = forward_backward(emissions((x - model.mean) / model.scale, n_lines, model.weights), model.transition, n_lines)
    return good, np.maximum(chars, 1), n_lines


def score_texts(texts: list[str | None], model: CrfModel) -> list[float]:
    if model.prior is not None:
        return [model.prior] * len(texts)
    good, weight, n_lines = line_marginals(texts, model)
    starts = np.cumsum(n_lines) - n_lines
    return (np.add.reduceat(weight * good, starts) / np.add.reduceat(weight, starts)).clip(0, 1).tolist()


def fit(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", p: QualityParams = QualityParams()) -> CrfModel:
    """Fits on documents whose label is known and for which ``usable`` (over ``labels``) holds."""
    known = labels.where(usable & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("y"))
    n = known.count()
    share = min(1.0, p.max_documents / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # about max_documents ids: the bound of the broadcast, and of the rows after it
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text", F.lit(1))).alias("text")).select("text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                texts = part.column("text").to_pylist()
                x, chars, n_lines = line_features(texts)
                begins, blobs = np.cumsum(n_lines) - n_lines, []
                for t, at, n in zip(texts, begins.tolist(), n_lines.tolist(), strict=True):
                    more = max(n - p.fit_lines, 0)
                    at += zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % (more + 1)
                    rows_of = slice(at, at + n - more)
                    blobs.append(np.column_stack([chars[rows_of], x[rows_of]]).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(blobs, pa.binary())], names=["y", "x"])

    got = rows.mapInArrow(features, "y int, x binary").toArrow()
    y = np.array(got.column("y").to_pylist(), dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return CrfModel(*[np.zeros(0)] * 4, prior=float(y.mean()) if len(y) else 0.5)
    parts = [np.frombuffer(b, dtype=np.float32).reshape(-1, len(FEATURES) + 1) for b in got.column("x").to_pylist()]
    order = sorted(range(len(parts)), key=lambda i: (len(parts[i]), y[i], parts[i].tobytes()))  # the same sums whatever order rows arrive in
    x = np.concatenate([parts[i] for i in order]).astype(float)
    return fit_weights(x[:, 1:], x[:, 0], np.array([len(parts[i]) for i in order]), y[order], p)


def score(docs: DataFrame, model: CrfModel, text: str = "text", column: str = "score") -> DataFrame:
    """Appends the quality score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, text, [T.StructField(column, T.DoubleType())], lambda texts: [score_texts(texts, shared.value)])
