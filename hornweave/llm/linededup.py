"""Line deduplication over overlapping windows of three lines.

Every three consecutive lines are a window, known by two 64-bit hashes. A window that
occurs more than once in the corpus stays where it comes first (by document id, null
last, then position); every later occurrence covers its lines, covered positions are
merged, and the covered lines go.

Defined cases: null text stays null, with no lines; documents of fewer than three lines
have no window and stay; windows of blank lines only don't count; a later occurrence in
the document of the first one leaves the first one's own lines; rows that repeat both id
and text are one document and get equal results; rows that share an id only are separate
texts at the same place in the order, so the same window at the same position is first
in each of them; a column of the input named as an added one (in any case) is replaced,
unless a ``prefix`` keeps them apart; other columns, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_prefix

WINDOW = 3
_OWN = ("id", "text_key")


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key of the text, position, two hashes) of every window that isn't blank."""
    lines = F.split(F.col(text), "\n", -1)
    at = F.transform(
        F.sequence(F.lit(0), F.size("lines") - WINDOW),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[F.get("lines", i + k) for k in range(WINDOW)]).alias("h1"),
            F.xxhash64(F.lit(WINDOW), *[F.get("lines", i + k) for k in reversed(range(WINDOW))]).alias("h2"),
            (F.length(F.trim(F.concat(*[F.get("lines", i + k) for k in range(WINDOW)]))) == 0).alias("blank"),
        ),
    )
    rows = docs.select(F.col(doc_id).alias(_OWN[0]), F.xxhash64(text).alias(_OWN[1]), lines.alias("lines")).where(F.size("lines") >= WINDOW)
    return rows.select(*_OWN, F.inline(at)).where(~F.col("blank")).drop("blank")


def _place(row: DataFrame):
    return F.struct(F.col(_OWN[0]).isNull().alias("none"), F.col(_OWN[0]).alias("id"), F.col("pos").alias("pos"))


def later_spans(found: DataFrame) -> DataFrame:
    """For each document with later occurrences, the spans (from, to) of lines that they cover."""
    # counted with partial aggregation before the shuffle, so a very frequent window costs a row for each task
    repeated = found.groupBy("h1", "h2").agg(F.min(_place(found)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a plain equi-join: adaptive execution splits the partition of a hot window
    later = found.join(repeated, ["h1", "h2"]).where(_place(found) > F.col("first"))
    own = (F.col(_OWN[0]).eqNullSafe(F.col("first.id"))) & (F.col("pos") < F.col("first.pos") + WINDOW)
    start = F.when(own, F.col("first.pos") + WINDOW).otherwise(F.col("pos"))
    return later.groupBy(*_OWN).agg(F.collect_set(F.struct(start.alias("from"), (F.col("pos") + WINDOW - 1).alias("to"))).alias("spans"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """Rows with ``text`` freed of repeated windows, and with ``n_lines`` and ``n_removed`` (after ``prefix``) added."""
    added = {(prefix + c).lower() for c in ("n_lines", "n_removed")}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    names = docs.columns
    own = fresh_prefix(names)
    key, lines_, covered_, kept_ = (own + c for c in ("key", "lines", "covered", "kept"))
    spans = later_spans(windows(docs, doc_id, text))
    rows = docs.withColumn(key, F.xxhash64(text)).alias("d").join(
        spans.alias("s"), F.col(f"d.{doc_id}").eqNullSafe(F.col(f"s.{_OWN[0]}")) & (F.col(f"d.{key}") == F.col(f"s.{_OWN[1]}")), "left"
    )
    covered = F.array_distinct(F.flatten(F.transform(F.col("s.spans"), lambda s: F.sequence(s["from"], s["to"]))))
    rows = rows.select(*[F.col(f"d.`{c}`") for c in names], covered.alias(covered_), F.split(F.col(f"d.{text}"), "\n", -1).alias(lines_))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(covered_))
    rows = rows.withColumn(kept_, F.when(F.size(covered_) > 0, kept))
    new_text = F.when(F.col(kept_).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept_, lambda i: F.get(lines_, i)), "\n"))
    return rows.select(
        *[new_text.alias(c) if c == text else F.col(f"`{c}`") for c in names],
        F.coalesce(F.size(lines_), F.lit(0)).cast("long").alias(prefix + "n_lines"),
        F.coalesce(F.size(lines_) - F.size(kept_), F.lit(0)).cast("long").alias(prefix + "n_removed"),
    )
