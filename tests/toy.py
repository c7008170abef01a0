"""A small graph: a chain and triangle, a loop, a functional relation, a rule of confidence one, a repeated row."""

TRIPLES = [
    ("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "a"), ("a", "knows", "a"), ("a", "knows", "b"),
    ("a", "livesIn", "x"), ("b", "livesIn", "x"), ("c", "livesIn", "y"), ("x", "cityOf", "z"), ("y", "cityOf", "z"),
    ("a", "nationality", "z"), ("b", "nationality", "z"), ("c", "nationality", "z"), ("d", "knows", "e"), ("e", "knows", "d"),
    ("p", "next", "q"), ("q", "next", "r"), ("r", "next", "s"), ("s", "next", "p"),
]


def toy(spark):
    return spark.createDataFrame(TRIPLES, "h string, r string, t string")


def both():
    e = {x for x in TRIPLES if x[0] != x[2]}
    return e | {(t, "INVERSE_" + r, h) for h, r, t in e}
