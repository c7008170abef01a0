"""Rule strings as queries: a rule is parsed into path atoms, and each becomes a plan over the edge table.

Full form ``r(X,Y) <= a(X,A), b(Y,A)``; simplified form ``r <= a·INVERSE_b``, with
``r(c)`` for a constant, ``r(·)`` for an open end and ``r(X)`` for a loop.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.relations import SEPARATOR, flip
from ..operators.graph import with_inverse
from ..operators.mining import metric_columns
from ..operators.paths import path_pairs

ATOM = re.compile(r"\s*([^\s(),]+)\(([^()]*)\)\s*,?")


def is_variable(term: str) -> bool:
    return len(term) == 1 and "A" <= term <= "Z"


@dataclass(frozen=True)
class PathAtom:
    """A relation path with both ends variable (end None), a constant, ``·`` or ``X``."""

    path: tuple[str, ...]
    end: str | None = None

    def __str__(self) -> str:
        return SEPARATOR.join(self.path) + ("" if self.end is None else f"({self.end})")

    @staticmethod
    def parse(text: str) -> PathAtom:
        m = re.fullmatch(r"\s*([^()]+?)\s*(?:\((.*)\))?\s*", text)
        if not m:
            raise ValueError(f"not an atom: {text!r}")
        return PathAtom(tuple(x.strip() for x in m[1].split(SEPARATOR)), m[2])


@dataclass(frozen=True)
class RuleQuery:
    head: PathAtom
    body: PathAtom

    def __str__(self) -> str:
        return f"{self.head} <= {self.body}"


def _atoms(text: str) -> list[tuple[str, str, str]]:
    out = []
    for name, inner in ATOM.findall(text):
        left, right = (inner[0], inner[2:]) if re.match(r"[A-Z],.", inner) else inner.rsplit(",", 1)
        out.append((name, left.strip(), right.strip()))
    return out


def _walk(atoms: list[tuple[str, str, str]], start: str, goal: str | None) -> PathAtom:
    """Follows shared variables from ``start``; ``goal`` is the variable to end at, None for whatever the chain ends in."""
    at, left, path = start, list(atoms), []
    while left:
        found = next((a for a in left if at in a[1:]), None)
        if found is None:
            raise ValueError("the body is not a chain")
        left.remove(found)
        name, a, b = found
        if a == b == at:
            if left or path:
                raise ValueError("a loop must stand alone")
            return PathAtom((name,), "X")
        path.append(name if a == at else flip(name))
        at = b if a == at else a
        if not is_variable(at) and left:
            raise ValueError("a constant inside the chain")
    if goal is not None:
        if at != goal:
            raise ValueError("the body doesn't connect the head's variables")
        return PathAtom(tuple(path))
    return PathAtom(tuple(path), SEPARATOR if is_variable(at) else at)


def parse(rule: str) -> RuleQuery:
    """Either form; raises ValueError for what isn't a chain rule."""
    head, arrow, body = rule.partition("<=")
    if not arrow:
        raise ValueError("no <= in the rule")
    if "," not in head:
        return RuleQuery(PathAtom.parse(head), PathAtom.parse(body))
    heads, bodies = _atoms(head), _atoms(body)
    name, a, b = heads[0]
    if a == b:
        return RuleQuery(PathAtom((name,), "X"), _walk(bodies, a, None))
    if is_variable(a) and is_variable(b):
        return RuleQuery(PathAtom((name,)), _walk(bodies, a, b))
    if is_variable(a):
        return RuleQuery(PathAtom((name,), b), _walk(bodies, a, None))
    return RuleQuery(PathAtom((flip(name),), a), _walk(bodies, b, None))


def elements(kg: DataFrame, atom: PathAtom) -> DataFrame:
    """Distinct elements of an atom: (x, y), or (x) for an atom with an end."""
    if atom.end == "X":
        return kg.where((F.col("r") == atom.path[0]) & (F.col("h") == F.col("t"))).select(F.col("h").alias("x")).distinct()
    needed = {*atom.path, *map(flip, atom.path)}
    edges = with_inverse(kg.where(F.col("r").isin(*needed)).where("h <> t").distinct())
    pairs = path_pairs(edges, atom.path)
    if atom.end is None:
        return pairs.select(F.col("h").alias("x"), F.col("t").alias("y"))
    if atom.end != SEPARATOR:
        pairs = pairs.where(F.col("t") == atom.end)
    return pairs.select(F.col("h").alias("x")).distinct()


def evaluate(kg: DataFrame, rule: str | RuleQuery) -> DataFrame:
    """support, body_size, head_size and derived metrics of one rule, exactly."""
    q = parse(rule) if isinstance(rule, str) else rule
    head, body = elements(kg, q.head), elements(kg, q.body)
    both = head.join(body, head.columns, "left_semi")
    counts = both.agg(F.count("*").alias("support")).crossJoin(body.agg(F.count("*").alias("body_size"))).crossJoin(head.agg(F.count("*").alias("head_size")))  # single rows
    return metric_columns(counts).withColumn("rule", F.lit(str(q)))
