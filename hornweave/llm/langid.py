"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is distributed; the log-probability matrix (``2**bits`` rows, one column
for each language) has a fixed size for a given language set, is broadcast, and
batches are scored sparsely in numpy.

Defined cases: null text or text without a letter gives ``und`` with score 0; an
empty table, or one without training rows, gives ``und`` everywhere; repeated rows
get equal results; ties go to the language that sorts first; a column of the input
named as an output column is replaced; more languages than the matrix is allowed to hold
(``max_langs``) raise ValueError before anything is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, text_chunks

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangIdParams:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    alpha: float = 0.5
    #: Training uses about this many rows of each language at most: whole texts, chosen by a hash of the row's text.
    max_rows_per_lang: int = 5_000
    #: Bound of the languages, and so of the matrix, which is 256 kB for each with the default ``bits``.
    max_langs: int = 512


@dataclass
class LangIdModel:
    langs: list[str]
    log_prob: np.ndarray  # (2**bits, languages)
    log_prior: np.ndarray
    params: LangIdParams


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


def ngram_features(texts: list[str | None], params: LangIdParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each n-gram, its bucket, letters of each row): lower case, runs of other characters than letters as one space."""
    joined = "\x00".join((t or "").replace("\x00", " ") for t in texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    gap = codes == 0
    letter = _letters()[codes]
    rows = np.cumsum(gap)
    n_letters = np.bincount(rows[letter], minlength=len(texts)).astype(np.int64)
    codes = np.where(letter, codes, np.where(gap, 0, 32)).astype(np.uint64)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes, rows = codes[keep], rows[keep]
    shift = np.uint64(64 - params.bits)
    out_rows, out_buckets = [], []
    for n in params.orders:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, dtype=np.uint64)
        whole = np.ones(size, dtype=bool)
        for k in range(n):
            part = codes[k : k + size]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            whole &= part != 0
        if n == 1:
            whole &= codes != 32
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out_rows.append(rows[:size][whole])
        out_buckets.append((h[whole] >> shift).astype(np.int64))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *out_rows]), np.concatenate([none, *out_buckets]), n_letters


def fit(docs: DataFrame, text: str, lang: str, usable: Column, params: LangIdParams = LangIdParams()) -> LangIdModel:
    """Learns from the rows where ``usable`` holds and ``lang`` is not null."""
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    totals = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(params.max_langs + 1).collect()}
    if len(totals) > params.max_langs:
        raise ValueError(f"more than {params.max_langs} languages; {lang!r} may not hold language codes")
    langs = sorted(totals)
    dim = 1 << params.bits
    prior = np.array([totals[x] for x in langs], dtype=float)
    counts = np.zeros((len(langs), dim))
    if langs:
        share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, params.max_rows_per_lang / totals[k]))])
        chosen = F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 30)) < share[F.col(lang)] * (1 << 30)
        code = {k: i for i, k in enumerate(langs)}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(code) * dim, dtype=np.int64)
            for batch in batches:
                for part in text_chunks(batch, text):
                    row, bucket, _ = ngram_features(part.column(text).to_pylist(), params)
                    of = np.array([code[x] for x in part.column(lang).to_pylist()], dtype=np.int64)
                    total += np.bincount(of[row] * dim + bucket, minlength=len(total))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["cell", "n"])

        # at most languages x 2**bits rows reach the driver, whatever the size of the input
        cells = rows.where(chosen).select(text, lang).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts.reshape(-1)[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    smooth = counts + params.alpha
    log_prob = (np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))).T if langs else np.zeros((dim, 0))
    return LangIdModel(langs, np.ascontiguousarray(log_prob), np.log(prior / prior.sum()) if langs else prior, params)


def score_texts(texts: list[str | None], model: LangIdModel) -> tuple[list[str], list[float]]:
    """The best language and its posterior probability, for each text."""
    n, k = len(texts), len(model.langs)
    row, bucket, letters = ngram_features(texts, model.params)
    if not k:
        return [UNDETERMINED] * n, [0.0] * n
    logit = np.empty((n, k))
    for j in range(k):
        logit[:, j] = np.bincount(row, weights=model.log_prob[:, j][bucket], minlength=n) + model.log_prior[j]
    best = logit.argmax(axis=1)
    posterior = 1.0 / np.exp(logit - logit[np.arange(n), best][:, None]).sum(axis=1)
    return (
        [model.langs[b] if m else UNDETERMINED for b, m in zip(best, letters, strict=True)],
        [float(p) if m else 0.0 for p, m in zip(posterior, letters, strict=True)],
    )


def identify(docs: DataFrame, model: LangIdModel, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Appends the predicted language and its score to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    return append_columns(docs, text, fields, lambda texts: list(score_texts(texts, shared.value)))
