"""Column functions on relation names, relation paths and rule strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.triples import INVERSE

SEPARATOR = "·"


def is_inverse(r: Column) -> Column:
    return F.startswith(r, F.lit(INVERSE))


def inverse(r: Column) -> Column:
    """The other direction's name; its own inverse's inverse."""
    return F.when(is_inverse(r), F.substr(r, F.lit(len(INVERSE) + 1))).otherwise(F.concat(F.lit(INVERSE), r))


def flip(relation: str) -> str:
    """inverse() of a name."""
    return relation.removeprefix(INVERSE) if relation.startswith(INVERSE) else INVERSE + relation


def path_inverse(path: Column) -> Column:
    """array<string>: reversed, every relation inverted."""
    return F.transform(F.reverse(path), inverse)


def path_canonical(path: Column) -> Column:
    """The lesser of a path and its inverse."""
    return F.least(path, path_inverse(path))


def path_string(path: Column) -> Column:
    return F.array_join(path, SEPARATOR)


def path_split(text: Column) -> Column:
    return F.split(text, SEPARATOR)


def has_inverse_step(path: Column) -> Column:
    """Whether a relation is followed by its own inverse."""
    steps = F.sequence(F.lit(1), F.greatest(F.size(path) - 1, F.lit(1)))
    return F.exists(steps, lambda i: F.coalesce(inverse(F.get(path, i - 1)) == F.get(path, i), F.lit(False)))


def path_length(text: Column) -> Column:
    """Relations in a path string."""
    return F.length(text) - F.length(F.replace(text, F.lit(SEPARATOR), F.lit(""))) + 1


def path_first(path: Column) -> Column:
    return F.get(path, F.lit(0))


def path_last(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))


def path_rest(path: Column) -> Column:
    """Without the first relation."""
    return F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))


def path_connect(head: Column, tail: Column) -> Column:
    return F.concat(head, tail)


BITS = 15


def pack_path(ids: Column) -> Column:
    """Relation ids of 15 bits each in one long, the first lowest."""
    return F.aggregate(F.reverse(ids), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.cast("long")))


def unpack_path(code: Column) -> Column:
    """The ids of a packed path (ids start at 1, so a zero ends it)."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.call_function("shiftright", code, i * BITS).bitwiseAND((1 << BITS) - 1))
    return F.filter(ids, lambda x: x != 0)


def variable(i: Column) -> Column:
    """A, B, ... for the inner nodes of a path."""
    return F.char(F.lit(65) + i)


def atom_string(path: Column, end: Column) -> Column:
    """``r1(X,A), r2(A,end)``: the forward name of an inverse relation with its arguments swapped; ``·`` leaves a fresh variable."""
    last = F.size(path) - 1

    def atom(r: Column, i: Column) -> Column:
        left = F.when(i == 0, F.lit("X")).otherwise(variable(i - 1))
        right = F.when(i < last, variable(i)).when(end == SEPARATOR, variable(last)).otherwise(end)
        forward = F.concat(r, F.lit("("), left, F.lit(","), right, F.lit(")"))
        backward = F.concat(inverse(r), F.lit("("), right, F.lit(","), left, F.lit(")"))
        return F.when(is_inverse(r), backward).otherwise(forward)

    return F.array_join(F.transform(path, atom), ", ")


def beautify(rule: Column) -> Column:
    """One space on each side of every path separator."""
    return F.regexp_replace(rule, rf"\s*{SEPARATOR}\s*", f" {SEPARATOR} ")


def split_atoms(body: Column) -> Column:
    """Body atoms, split at commas outside parentheses."""
    return F.filter(F.transform(F.split(body, r",(?![^(]*\))"), F.trim), lambda x: x != "")


def head_kind(head: Column) -> Column:
    """binary, constant, existence or loop, of a simplified head or body atom."""
    term = F.regexp_extract(head, r"\(([^()]*)\)$", 1)
    return (
        F.when(~F.rlike(head, F.lit(r"\(")) | F.rlike(head, F.lit(r"\([A-Z],[A-Z]\)$")) & ~F.rlike(head, F.lit(r"\(X,X\)$")), "binary")
        .when(term == SEPARATOR, "existence").when(term.isin("X", "X,X"), "loop").otherwise("constant")
    )


def rule_level(body: Column) -> Column:
    """L0 for no body, else L and the longest path length of its atoms."""
    longest = F.array_max(F.transform(split_atoms(body), lambda a: path_length(F.regexp_replace(a, r"\(.*$", ""))))
    return F.when(F.size(split_atoms(body)) == 0, "L0").otherwise(F.concat(F.lit("L"), longest.cast("string")))
