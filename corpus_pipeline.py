"""A corpus pipeline over ``documents``: five stages, each applying one operator to all its predecessor kept.

Every stage but the last returns the columns of its input, whatever their names, with their own values (but for
texts that it cuts, and ``n_chars`` of those); the last returns token ids.

Defined cases: a document with null text, or without a letter, is rejected by the first stage; repeated rows are
equal to each other in the first two stages and the fourth and one document to the third, which leaves one; a null
document id takes part in everything, and is last in the order of first occurrences; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornweave.llm import bpe, decontam, langid, linededup, neardup
from hornweave.llm.common import fresh_prefix, table, written

#: A document whose best language has a smaller posterior probability is rejected, as is one without a letter.
MIN_LANGUAGE_SCORE = 0.5


def _as(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``, in their order."""
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    model = langid.fit(docs, "text", "lang", F.lit(True))
    own = fresh_prefix(docs.columns)
    found = langid.identify(docs, model, lang_col=own + "lang", score_col=own + "score")
    return _as(docs, found.where((F.col(own + "lang") != langid.UNDETERMINED) & (F.col(own + "score") >= MIN_LANGUAGE_SCORE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of repeated three-line windows; a document of which nothing is left goes."""
    own = fresh_prefix(docs.columns)
    out = linededup.dedup_lines(docs, prefix=own)
    out = out.where((F.col(own + "n_removed") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        length = F.when(F.col(own + "n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return _as(docs, out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near duplicates."""
    return neardup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words at least a twentieth lie in benchmark windows."""
    own = fresh_prefix(docs.columns)
    return _as(docs, decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), prefix=own).where(~decontam.contaminated(own)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the contract's digests of them."""
    codec = bpe.prepare(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.digest(bpe.round_trip(docs.select("doc_id", "text"), codec))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification by a fitted model and token ids can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None
