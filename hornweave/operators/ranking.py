"""Candidates of link-prediction queries: filtering, aggregation over rules, ranking, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

QUERY = ["query", "direction"]


def ordered_rules(rules: DataFrame, min_correct: int = 0, min_confidence: float = 0.0) -> DataFrame:
    """Rules of each target relation with their position by falling applied confidence."""
    order = Window.partitionBy("relation").orderBy(F.desc("applied"), "rule")
    return rules.where((F.col("correct") >= min_correct) & (F.col("confidence") >= min_confidence)).withColumn("position", F.row_number().over(order))


def drop_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Leaves out candidates that make a known triple, other than the target itself.

    candidates: query, direction, candidate, target; known: query, direction, candidate.
    """
    other = known.select(*QUERY, "candidate").distinct()
    kept = candidates.where("candidate <> target").join(other, [*QUERY, "candidate"], "left_anti")
    return candidates.where("candidate = target").unionByName(kept)


def zero_candidates(queries: DataFrame, key: str | list[str], zero: DataFrame, other: DataFrame, depth: int, by: list[str] | None = None) -> DataFrame:
    """(key, rule, candidate, applied) of those zero rules that can matter within the first ``depth`` positions of each query.

    Every rule of ``zero`` (rule, candidate, applied and the columns ``by``) fires for every query of equal ``by``. A candidate of
    ``other`` (key, candidate), which further rules give or which is known, gets its own rule; of the rest only the
    best can be reached: as many as ``depth`` and ``other`` have together, in the order of max_plus() and in that of noisy_or().
    """
    key, by = [key] if isinstance(key, str) else list(key), by or []
    own = [*key, *[c for c in by if c not in key]]
    n = other.groupBy(*key).agg(F.count("*").alias("n"))
    places = queries.join(n, key, "left").select(*own, F.explode(F.sequence(F.lit(1), F.coalesce(F.col("n"), F.lit(0)).cast("int") + depth)).alias("place"))
    found = other.join(queries, key).join(zero, [*by, "candidate"]).select(*own, "rule", "candidate", "applied")
    score = F.round(-F.ln(1 - F.least("applied", F.lit(1 - 1e-12))), 9)
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    for order in (F.desc("applied"), F.desc(score)):
        placed = zero.withColumn("place", F.row_number().over(window.orderBy(order, "candidate")))  # a row for each constant of one relation
        found = found.unionByName(places.join(placed, [*by, "place"]).select(*own, "rule", "candidate", "applied"))
    return found.distinct()


def confidence_lists(fired: DataFrame) -> DataFrame:
    """The falling list of applied confidences of the rules that give each candidate."""
    return fired.groupBy(*QUERY, "candidate").agg(F.sort_array(F.collect_list("applied"), asc=False).alias("confs"), F.sort_array(F.collect_list("rule")).alias("rules"))


def max_plus(fired: DataFrame, k: int) -> DataFrame:
    """Top ``k`` of each query by confidence lists, compared from the front (a longer list wins a tie); then by name."""
    return max_plus_lists(confidence_lists(fired), k)


def max_plus_lists(lists: DataFrame, k: int) -> DataFrame:
    """max_plus() of confidence_lists()."""
    order = Window.partitionBy(*QUERY).orderBy(F.desc("confs"), "candidate")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def refined_score(confs: Column, epsilon: float = 1e-4) -> Column:
    """One number for a confidence list: each further level counts ``epsilon`` times less."""
    steps = F.transform(confs, lambda c, i: c * F.pow(F.lit(epsilon), i))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def noisy_score(confs: Column) -> Column:
    return F.round(F.aggregate(F.transform(confs, lambda c: -F.ln(1 - F.least(c, F.lit(1 - 1e-12)))), F.lit(0.0), lambda a, x: a + x), 9)


def shared_top(fired: DataFrame, known: DataFrame, asked: DataFrame, by: Column, k: int) -> DataFrame:
    """(query, direction, candidate, by, rank): the top ``k`` by falling ``by`` (of ``confs``), then by name, known answers other than the target left out.

    fired: h, candidate, applied; known: h, candidate (all targets are known); asked: query, direction, target, h. Triples of one h share its
    candidates: these go once into one shuffle, and only the first ``k`` unknown ones and the known ones are joined to queries.
    """
    marked = fired.withColumn("known", F.lit(False)).unionByName(known.select("h", "candidate", F.lit(None).cast("double").alias("applied"), F.lit(True).alias("known")))
    lists = marked.repartition("h").groupBy("h", "candidate").agg(F.sort_array(F.collect_list("applied"), asc=False).alias("confs"), F.max("known").alias("known"))
    lists = lists.where(F.size("confs") > 0).select("h", "candidate", by.alias("by"), "known")
    place = F.row_number().over(Window.partitionBy("h").orderBy("known", F.desc("by"), "candidate"))
    kept = written(lists.withColumn("place", place).where(F.col("known") | (F.col("place") <= k)).select("h", "candidate", "by", "known"), "first_places")
    rows = asked.join(kept.hint("merge"), "h").where("not known or candidate = target")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*QUERY).orderBy(F.desc("by"), "candidate"))).where(F.col("rank") <= k).select(*QUERY, "candidate", "by", "rank")


def noisy_or(fired: DataFrame, k: int, top: int | None = None) -> DataFrame:
    """Top ``k`` by the sum of -ln(1 - confidence) over all (or the ``top`` best) rules."""
    lists = confidence_lists(fired)
    used = F.col("confs") if top is None else F.slice("confs", 1, top)
    lists = lists.withColumn("score", noisy_score(used))
    order = Window.partitionBy(*QUERY).orderBy(F.desc("score"), "candidate")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*QUERY, "candidate", "score", "rank")


def filtered_rank(ranked: DataFrame, known: DataFrame, depth: int = 100) -> DataFrame:
    """(query, direction, raw_rank, filtered_rank) of each query's target within the first ``depth`` positions.

    The filtered rank doesn't count known answers, other than the target, above it.
    """
    marks = known.select(*QUERY, "candidate").distinct().withColumn("known", F.lit(1))
    rows = ranked.where(F.col("rank") <= depth).join(marks, [*QUERY, "candidate"], "left")
    other = F.when((F.col("candidate") != F.col("target")) & F.col("known").isNotNull(), 1).otherwise(0)
    above = F.sum(other).over(Window.partitionBy(*QUERY).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("above", F.coalesce(above, F.lit(0)))
    return rows.where("candidate = target").select(*QUERY, F.col("rank").cast("long").alias("raw_rank"), (F.col("rank") - F.col("above")).cast("long").alias("filtered_rank"))


def shared_ranks(fired: DataFrame, scores: DataFrame, zero: DataFrame, known: DataFrame, targets: DataFrame, depth: int = 100) -> DataFrame:
    """(entity, candidate, rank) of every target within the first ``depth`` positions by max_plus(), known answers other than itself left out.

    fired: entity, rule, candidates (a list; one candidate may be in several); scores: rule, applied; zero: candidate, applied of rules that
    fire for every entity, one for a candidate; known, targets: entity, candidate. Targets of one entity share its candidates, which are
    listed once; candidates that only a zero rule gives are counted from their places and never listed.
    """
    rule = F.struct("rule", "applied")
    rows = fired.join(F.broadcast(scores), "rule").select("entity", rule.alias("by"), "candidates", F.lit(False).alias("known"), F.lit(False).alias("target"))  # a row for each rule
    none = F.lit(None).cast(rows.schema["by"].dataType).alias("by")
    for more, mark in ((known, "known"), (targets, "target")):
        rows = rows.unionByName(more.select("entity", none, F.array("candidate").alias("candidates"), *[F.lit(c == mark).alias(c) for c in ("known", "target")]))
    rows = rows.repartition("entity").select("entity", "by", "known", "target", F.explode("candidates").alias("candidate"))
    rows = rows.groupBy("entity", "candidate").agg(F.collect_set("by").alias("by"), F.max("known").alias("known"), F.max("target").alias("target"))
    rows = rows.join(zero.select("candidate", F.col("applied").alias("zero")), "candidate", "left")
    own = F.when(F.col("zero").isNull(), F.array().cast("array<double>")).otherwise(F.array("zero"))
    confs = F.sort_array(F.concat(F.transform("by", lambda x: x["applied"]), own), asc=False)
    lists = rows.groupBy("entity").agg(F.collect_list(F.struct("candidate", confs.alias("confs"), "zero", "known", "target")).alias("all"))
    asked = lists.select("entity", "all", F.explode(F.filter("all", lambda x: x["target"] & (F.size(x["confs"]) > 0))).alias("own"))
    first = lambda confs, x: (confs > F.col("own.confs")) | ((confs == F.col("own.confs")) & (x["candidate"] < F.col("own.candidate")))
    listed = F.size(F.filter("all", lambda x: ~x["known"] & first(x["confs"], x)))
    twice = F.size(F.filter("all", lambda x: x["zero"].isNotNull() & first(F.array(x["zero"]), x)))
    place = [F.col("own.confs")[0].alias("applied"), (F.size("own.confs") == 1).alias("single"), (listed - twice).alias("listed")]
    found = written(asked.select("entity", F.col("own.candidate").alias("candidate"), *place), "shared_ranks")
    total = Window.rowsBetween(Window.unboundedPreceding, -1)
    levels = zero.select("applied", F.lit(1).alias("n")).unionByName(scores.select("applied", F.lit(0).alias("n"))).groupBy("applied").agg(F.sum("n").alias("n"))
    levels = levels.select("applied", F.coalesce(F.sum("n").over(total.orderBy(F.desc("applied"))), F.lit(0)).alias("higher"))  # a row for each different confidence
    names = zero.select("applied", "candidate", F.lit(1).alias("n")).unionByName(found.where("single").select("applied", "candidate", F.lit(0).alias("n")))
    names = names.groupBy("applied", "candidate").agg(F.max("n").alias("n"))  # a row for each constant of one relation
    names = names.select("applied", "candidate", F.coalesce(F.sum("n").over(total.partitionBy("applied").orderBy("candidate")), F.lit(0)).alias("level"))
    ranks = found.join(levels, "applied").join(names, ["applied", "candidate"], "left")
    rank = 1 + F.col("listed") + F.col("higher") + F.when(F.col("single"), F.col("level")).otherwise(F.lit(0))
    return ranks.select("entity", "candidate", rank.cast("long").alias("rank")).where(F.col("rank") <= depth)


def hits_and_mrr(queries: DataFrame, ranks: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Hits@k (raw and filtered) and mean reciprocal rank; a query without its target counts as a miss."""
    rows = queries.join(ranks, QUERY, "left")
    hit = lambda c, k: F.avg(F.when(F.col(c) <= k, 1.0).otherwise(0.0))
    aggs = [hit("filtered_rank", k).alias(f"hits_{k}") for k in ks] + [hit("raw_rank", k).alias(f"raw_hits_{k}") for k in ks]
    mrr = F.avg(F.when(F.col("filtered_rank").isNotNull(), 1.0 / F.col("filtered_rank")).otherwise(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("queries"), F.count("filtered_rank").alias("found"), *aggs, F.round(mrr, 9).alias("mrr"))


def reorder(mine: DataFrame, other: DataFrame) -> DataFrame:
    """This list in the order of another; candidates that it lacks follow in their own order. Scores fall evenly from 1 to 0.5."""
    theirs = other.select(*QUERY, "candidate", F.col("rank").alias("their_rank"))
    rows = mine.select(*QUERY, "candidate", "rank").join(theirs, [*QUERY, "candidate"], "left")
    order = Window.partitionBy(*QUERY).orderBy(F.asc_nulls_last("their_rank"), "rank")
    rows = rows.withColumn("new_rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*QUERY)))
    return rows.select(*QUERY, "candidate", "new_rank", (1 - (F.col("new_rank") - 1) * 0.5 / F.col("n")).alias("score"))


def reorder_weighted(mine: DataFrame, other: DataFrame, alpha: float, beta: float) -> DataFrame:
    """beta * conf * (1 + alpha) / (p + alpha) + (1 - beta) / p, with the position p in the other list (one more than its length if absent)."""
    theirs = other.select(*QUERY, "candidate", F.col("rank").alias("their_rank"))
    sizes = other.groupBy(*QUERY).agg(F.max("rank").alias("their_size"))
    rows = mine.select(*QUERY, "candidate", "rank", "score").join(theirs, [*QUERY, "candidate"], "left").join(sizes, QUERY, "left")
    p = F.coalesce(F.col("their_rank"), F.col("their_size") + 1, F.lit(1))
    score = F.round(beta * F.col("score") * (1 + alpha) / (p + alpha) + (1 - beta) / p, 9)
    rows = rows.withColumn("new_score", score)
    order = Window.partitionBy(*QUERY).orderBy(F.desc("new_score"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).select(*QUERY, "candidate", "new_score", "new_rank")


def adjust(results: DataFrame) -> DataFrame:
    """Lists put into the order of their scores, equal ones as they stood: (query, direction, candidate, score, rank)."""
    order = Window.partitionBy(*QUERY).orderBy(F.desc("score"), "rank", "candidate")
    return results.select(*QUERY, "candidate", "score", F.row_number().over(order).alias("rank"))


def extend(mine: DataFrame, other: DataFrame, k: int, factor: float) -> DataFrame:
    """Both lists together: each candidate's larger of its score and ``factor`` times the other's; top ``k``."""
    scaled = other.select(*QUERY, "candidate", (F.col("score") * factor).alias("score"))
    best = mine.select(*QUERY, "candidate", "score").unionAll(scaled).groupBy(*QUERY, "candidate").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*QUERY).orderBy(F.desc("score"), "candidate")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
