"""The anytime miner's parts: sampled paths, their generalisations, the choice of rule types."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relations import inverse, is_inverse
from .graph import with_inverse


def sample_paths(edges: DataFrame, steps: int, cyclic: bool, per_relation: int, seed: int = 0) -> DataFrame:
    """(nodes, rels): for each head relation in both directions up to ``per_relation`` starting edges (in a hashed order), each continued by every fitting edge.

    No relation is followed by its inverse along the same edge; nodes differ, but for the
    last of a cyclic path, which is the first.
    """
    both = with_inverse(edges)
    order = Window.partitionBy("r").orderBy(F.md5(F.concat_ws("|", "h", "t", F.lit(str(seed)))), "h", "t")
    rows = both.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_relation)
    rows = rows.select(F.array("h", "t").alias("nodes"), F.array("r").alias("rels"))
    nxt = both.select(F.col("h").alias("at"), F.col("r").alias("new_r"), F.col("t").alias("new"))
    for i in range(1, steps):
        rows = rows.withColumn("at", F.element_at("nodes", -1)).join(nxt, "at")
        rows = rows.where(F.col("new_r") != inverse(F.element_at("rels", -1))) if not (cyclic and i == steps - 1) else rows
        last = i == steps - 1
        fits = F.col("new") == F.col("nodes")[0] if cyclic and last else ~F.array_contains("nodes", F.col("new"))
        rows = rows.where(fits).select(F.concat("nodes", F.array("new")).alias("nodes"), F.concat("rels", F.array("new_r")).alias("rels"))
    return rows


def generalisations(paths: DataFrame) -> DataFrame:
    """Distinct rules (rule_type, rule) that a path stands for; the first step is the head, with X its forward subject and Y its object.

    A cyclic path gives C, and two AC1 rules: with Y's node constant in the head and the chain's end (an X-rule, the
    chain walked from X), and with X's node (a Y-rule). Another path, whose steps after the head leave its second
    node, gives the AC1 rule with the last node constant, AC2 with it open, and Z. A head walked backwards has X and
    Y exchanged. Inverse relations are written forward.
    """
    n = F.size("rels")
    cyclic = F.col("nodes")[0] == F.element_at("nodes", -1)

    def atom(r, a, b):
        return F.when(is_inverse(r), F.concat(inverse(r), F.lit("("), b, F.lit(","), a, F.lit(")"))).otherwise(F.concat(r, F.lit("("), a, F.lit(","), b, F.lit(")")))

    def body(start, end, back=False):
        """Steps after the head's, from its second node; ``back`` walks them from the last one, from the head's first node."""
        def one(k):
            i = n - k if back else k
            r = inverse(F.get("rels", i)) if back else F.get("rels", i)
            a = F.when(k == 1, start).otherwise(F.char(F.lit(64) + k - 1))
            b = F.when(k == n - 1, end).otherwise(F.char(F.lit(64) + k))
            return atom(r, a, b)
        return F.when(n > 1, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), one), ", ")).otherwise("")

    r0, first, second, last = F.col("rels")[0], F.col("nodes")[0], F.col("nodes")[1], F.element_at("nodes", -1)
    turned = is_inverse(r0)
    # the names of the head's nodes in the order walked
    name1, name2 = F.when(turned, "Y").otherwise("X"), F.when(turned, "X").otherwise("Y")
    rule = lambda kind, head, b: F.struct(F.lit(kind).alias("rule_type"), F.concat(head, F.lit(" <= "), b).alias("rule"))
    open_end = F.char(F.lit(64) + n - 1)
    options = F.array(
        # the chain from X to Y, whichever way the head was walked
        F.when(cyclic, rule("C", atom(r0, name1, name2), F.when(turned, body(F.lit("X"), F.lit("Y"))).otherwise(body(F.lit("X"), F.lit("Y"), back=True)))),
        F.when(cyclic, rule("AC1", atom(r0, name1, second), body(name1, second, back=True))),
        F.when(cyclic, rule("AC1", atom(r0, first, name2), body(name2, first))),
        F.when(~cyclic & (n > 1), rule("AC1", atom(r0, first, name2), body(name2, last))),
        F.when(~cyclic & (n > 1), rule("AC2", atom(r0, first, name2), body(name2, open_end))),
        F.when(~cyclic, rule("Z", atom(r0, first, name2), F.lit(""))),
        F.when(n == 1, rule("Z", atom(r0, name1, second), F.lit(""))),
    )
    return paths.where("nodes[0] <> nodes[1]").select(F.inline(F.filter(options, lambda x: x.isNotNull()))).distinct()


def gain(kind: int) -> Column:
    """What a rule earns, from its correct predictions, confidence, applied confidence and length (correct, confidence, applied, body_size).

    1 correct; 2 correct x confidence; 3 correct x applied; 4 correct x applied squared; 5 correct x applied, halved for each step after the first.
    """
    c, p, a, n = F.col("correct").cast("double"), F.col("confidence"), F.col("applied"), F.col("body_size")
    return {1: c, 2: c * p, 3: c * a, 4: c * a * a, 5: c * a * F.pow(F.lit(0.5), n - 1)}[kind]


def reward(scored: DataFrame, kind: int = 5) -> DataFrame:
    """Total gain of each rule type."""
    return scored.groupBy("rule_type").agg(F.round(F.sum(gain(kind)), 9).alias("gain"), F.count("*").alias("rules"))


@dataclass
class Dice:
    """Chooses a rule type by running mean rewards: now and then at random, less so over time."""

    kinds: list[str]
    epsilon: float = 0.1
    annealing: float = 5.0
    greedy: bool = False
    seed: int = 0
    scores: dict = field(default_factory=dict)
    #: (time, scores then) of every record().
    trace: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self._random = random.Random(self.seed)

    def add(self, kind: str, gain: float) -> None:
        total, n = self.scores.get(kind, (0.0, 0))
        self.scores[kind] = total + gain, n + 1

    def record(self, at: float) -> None:
        self.trace.append((at, dict(self.scores)))

    def mean(self, kind: str) -> float:
        total, n = self.scores.get(kind, (0.0, 0))
        return total / n if n else 1e-4

    def ask(self, batch: int) -> str:
        """The kind for a batch (counted from 0). A random one with a chance that falls from 1 to ``epsilon`` over the first ``annealing`` batches."""
        if self._random.random() < max(self.epsilon, 1 - batch / self.annealing):
            return self._random.choice(self.kinds)
        weights = [self.mean(k) for k in self.kinds]
        if self.greedy:
            return self.kinds[max(range(len(weights)), key=lambda i: (weights[i], -i))]
        return self._random.choices(self.kinds, weights)[0]
