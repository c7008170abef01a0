"""Exact scores and predictions of cyclic (C), acyclic (AC1, AC2) and zero (Z) rules given by relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.relations import SEPARATOR, flip


def step(edges: DataFrame, relation: str, a: str, b: str) -> DataFrame:
    return edges.where(F.col("r") == relation).select(F.col("h").alias(a), F.col("t").alias(b))


def grounding_chain(edges: DataFrame, path: tuple[str, ...], branching: int | None = None, first: DataFrame | None = None, last: DataFrame | None = None) -> DataFrame:
    """(n0, n1, ... nk) of a path, all nodes different (object identity).

    ``branching`` drops inner nodes with that many continuations or more; ``first`` (n0) and ``last`` (nk) restrict the ends before anything is joined.
    """
    rows = step(edges, path[0], "n0", "n1").where("n0 <> n1")
    if first is not None:
        rows = rows.join(first, "n0", "left_semi")
    if last is not None and len(path) == 1:
        rows = rows.join(last, "n1", "left_semi")
    for i, relation in enumerate(path[1:], 1):
        new = f"n{i + 1}"
        nxt = step(edges, relation, f"n{i}", new)
        if last is not None and i == len(path) - 1:
            nxt = nxt.join(last, new, "left_semi")
        if branching is not None:
            small = nxt.groupBy(f"n{i}").agg(F.count("*").alias("n")).where(F.col("n") < branching).select(f"n{i}")
            nxt = nxt.join(small, f"n{i}", "left_semi")
        rows = rows.join(nxt, f"n{i}")
        for j in range(i + 1):
            rows = rows.where(F.col(f"n{j}") != F.col(new))
    return rows.select(*[f"n{i}" for i in range(len(path) + 1)])


def cyclic_predictions(edges: DataFrame, path: tuple[str, ...], branching: int | None = None) -> DataFrame:
    """Distinct (h, t) that the body of a cyclic rule grounds."""
    return grounding_chain(edges, path, branching).select(F.col("n0").alias("h"), F.col(f"n{len(path)}").alias("t")).distinct()


def suppress_large(predictions: DataFrame, key: str, bound: int) -> DataFrame:
    """Queries with ``bound`` candidates or more give none."""
    few = predictions.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") < bound).select(key)
    return predictions.join(few, key, "left_semi")


def split_valid(predictions: DataFrame, kg: DataFrame, relation: str) -> DataFrame:
    """Predictions (h, t) with whether they are triples of the relation."""
    truth = kg.where(F.col("r") == relation).select("h", "t").distinct().withColumn("valid", F.lit(True))
    return predictions.join(truth.hint("merge"), ["h", "t"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def score_predictions(valid: DataFrame) -> DataFrame:
    """predicted, correct, confidence (0 if nothing is predicted)."""
    s = valid.agg(F.count("*").alias("predicted"), F.count_if("valid").alias("correct"))
    return s.withColumn("confidence", F.when(F.col("predicted") > 0, F.col("correct") / F.col("predicted")).otherwise(F.lit(0.0)))


def acyclic_x(edges: DataFrame, path: tuple[str, ...], constant: str | None, head_constant: str) -> DataFrame:
    """Distinct x <> head constant for which the body holds: AC1 with an end constant, AC2 with an open end.

    No variable may be the head's constant; the end constant may.
    """
    rows = grounding_chain(edges, path)
    k = len(path)
    if constant is not None:
        rows = rows.where(F.col(f"n{k}") == constant)
    for i in range(k + (constant is None)):
        rows = rows.where(F.col(f"n{i}") != head_constant)
    return rows.select(F.col("n0").alias("x")).distinct()


def score_acyclic_all(edges: DataFrame, head: str, path: tuple[str, ...], open_end: bool, min_correct: int) -> DataFrame:
    """All rules head(X,c) <- path(X,c2) (or with an open end) at once, over every c and c2.

    (c, c2, predicted, correct, confidence); c2 is empty for an open end. An x is left out
    for a constant c if each of its groundings uses c as a variable.
    """
    k = len(path)
    chain = grounding_chain(edges, path)
    nodes = [f"n{i}" for i in range(k + 1 if open_end else k)]
    end = F.lit("") if open_end else F.col(f"n{k}")
    body = chain.select(F.col("n0").alias("x"), end.alias("c2"), F.array(*nodes).alias("used"))
    truth = step(edges, head, "x", "c").where("x <> c")
    sizes = body.select("x", "c2").distinct().groupBy("c2").agg(F.count("*").alias("all"))
    hit = truth.join(body.hint("merge"), "x")  # a row for each x and more: not for a broadcast
    hit = hit.where(~F.array_contains("used", F.col("c"))).select("x", "c", "c2").distinct()
    correct = hit.groupBy("c", "c2").agg(F.count("*").alias("correct")).where(F.col("correct") >= min_correct)
    using = body.select("x", "c2", F.explode("used").alias("c")).join(truth.select("c").distinct(), "c", "left_semi")
    using = using.groupBy("x", "c2", "c").agg(F.count("*").alias("with_c"))
    total = body.groupBy("x", "c2").agg(F.count("*").alias("n"))
    lost = using.join(total.hint("merge"), ["x", "c2"]).where("with_c = n").groupBy("c", "c2").agg(F.count("*").alias("lost"))
    rows = correct.join(sizes, "c2").join(lost, ["c", "c2"], "left")
    predicted = F.col("all") - F.coalesce("lost", F.lit(0))
    return rows.select("c", "c2", predicted.alias("predicted"), "correct", (F.col("correct") / predicted).alias("confidence"))


def zero_score(edges: DataFrame, head: str) -> DataFrame:
    """head(X,c) <- nothing, for every c: predicted = triples of the relation, correct = those with c."""
    rows = step(edges, head, "x", "c")
    total = rows.agg(F.count("*").alias("predicted"))
    return rows.groupBy("c").agg(F.count("*").alias("correct")).crossJoin(total).select("c", "predicted", "correct", (F.col("correct") / F.col("predicted")).alias("confidence"))


def applied_confidence(predicted: Column, correct: Column, kind: Column, length: Column, config: Config = Config()) -> Column:
    """Laplace-smoothed confidence with the weights of the rule's class."""
    base = correct / (predicted + config.unseen_negative_examples)
    return (
        F.when(kind == "Z", base * config.rule_zero_weight).when(kind == "AC2", base * config.rule_ac2_weight)
        .when(kind == "C", base * F.pow(F.lit(config.rule_length_degrade), length - 1)).otherwise(base)
    )


def keep_rules(rules: DataFrame, config: Config = Config()) -> DataFrame:
    """The thresholds on confidence and correct predictions; zero rules need more of those."""
    return rules.where(
        (F.col("confidence") >= config.threshold_confidence) & (F.col("correct") >= config.threshold_correct_predictions)
        & ((F.col("rule_type") != "Z") | (F.col("correct") > config.threshold_correct_predictions_zero))
    )


def singletons(edges: DataFrame, paths: list[tuple[str, ...]]) -> DataFrame:
    """(path, ends, singleton): whether a body's open end has one value at most."""
    out = None
    for path in paths:
        one = grounding_chain(edges, path).agg(F.count_distinct(F.col(f"n{len(path)}")).alias("ends")).withColumn("path", F.lit(SEPARATOR.join(path)))
        out = one if out is None else out.unionByName(one)
    return out.select("path", "ends", (F.col("ends") <= 1).alias("singleton"))


def last_groundings(edges: DataFrame, path: tuple[str, ...], constant: str | None, least: int) -> DataFrame:
    """(ends): the values of the last atom's variable in the groundings of an acyclic body, if there are ``least`` or more.

    With a constant at the end the variable is the one before it.
    """
    k = len(path)
    rows = grounding_chain(edges, path)
    if constant is not None:
        rows = rows.where(F.col(f"n{k}") == constant)
    found = rows.agg(F.count_distinct(F.col(f"n{k if constant is None else k - 1}")).alias("ends"))
    return found.where(F.col("ends") >= least)


def predicted_without(edges: DataFrame, path: tuple[str, ...], constant: str | None, head: str, head_constant: str) -> DataFrame:
    """(x): true triples head(x, head_constant) whose acyclic body holds without the triple itself."""
    truth = step(edges, head, "x", "c").where(F.col("c") == head_constant)
    k = len(path)
    chain = grounding_chain(edges, path)
    if constant is not None:
        chain = chain.where(F.col(f"n{k}") == constant)
    for i in range(k + (constant is None)):
        chain = chain.where(F.col(f"n{i}") != head_constant)
    rows = chain.withColumnRenamed("n0", "x").join(truth, "x")
    name = lambda i: "x" if i == 0 else f"n{i}"
    for i, relation in enumerate(path):
        a, b = F.col(name(i)), F.col(name(i + 1))
        if relation == head:
            rows = rows.where((a != F.col("x")) | (b != F.col("c")))
        elif relation == flip(head):
            rows = rows.where((b != F.col("x")) | (a != F.col("c")))
    return rows.select("x").distinct()


def joint_score(first: DataFrame, second: DataFrame, kg: DataFrame, relation: str) -> DataFrame:
    """Score of what two rules predict together."""
    return score_predictions(split_valid(first.join(second, ["h", "t"], "left_semi"), kg, relation))


def explanations(edges: DataFrame, path: tuple[str, ...], triples: DataFrame) -> DataFrame:
    """For every (h, t) asked for, the least grounding of the path as a list of nodes. Both ends restrict the search."""
    end = f"n{len(path)}"
    asked = triples.select(F.col("h").alias("n0"), F.col("t").alias(end)).distinct()
    # first steps from an asked h, last steps to an asked t; those in between are found from the first ones
    rows = grounding_chain(edges, path, first=asked.select("n0").distinct(), last=asked.select(end).distinct()).join(asked, ["n0", end])
    nodes = F.array(*[f"n{i}" for i in range(len(path) + 1)])
    return rows.groupBy(F.col("n0").alias("h"), F.col(f"n{len(path)}").alias("t")).agg(F.min(nodes).alias("nodes"), F.count("*").alias("groundings"))


def chao1(sampled: DataFrame, key: str) -> DataFrame:
    """Estimated number of distinct values from repeated draws: d + f1^2 / (2 f2), d if no value came twice."""
    seen = sampled.groupBy(key).agg(F.count("*").alias("n"))
    s = seen.agg(F.count("*").alias("d"), F.count_if(F.col("n") == 1).alias("f1"), F.count_if(F.col("n") == 2).alias("f2"))
    return s.withColumn("estimate", F.when(F.col("f2") > 0, F.col("d") + F.col("f1") * F.col("f1") / (2 * F.col("f2"))).otherwise(F.col("d").cast("double")))
