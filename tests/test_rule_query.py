import pytest
from hornweave.plans import rule_query as rq

from .toy import TRIPLES, toy


def brute_force(triples: set[tuple[str, str, str]], q: rq.RuleQuery) -> tuple[int, int, int]:
    """(support, body size, head size) by nested loops."""

    def pairs(path: tuple[str, ...]) -> set:
        if len(path) == 1:
            r = path[0]
            base = {(h, t) for h, x, t in triples if h != t and x == r.removeprefix("INVERSE_")}
            return {(t, h) for h, t in base} if r.startswith("INVERSE_") else base
        out = None
        for i in range(1, len(path)):
            a, b = pairs(path[:i]), pairs(path[i:])
            joined = {(h, t) for h, m in a for m2, t in b if m == m2 and h != t}
            out = joined if out is None else out & joined
        return out or set()

    def of(atom: rq.PathAtom) -> set:
        if atom.end == "X":
            return {h for h, r, t in triples if h == t and r == atom.path[0]}
        p = pairs(atom.path)
        return p if atom.end is None else {h for h, t in p if atom.end in (rq.SEPARATOR, t)}

    head, body = of(q.head), of(q.body)
    return len(head & body), len(body), len(head)


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("languages(X,/m/02h) <= tv(A,X)", "languages(/m/02h) <= INVERSE_tv(·)"),
        ("r(X,Y) <= p(X,Y)", "r <= p"),
        ("r(X,Y) <= a(X,A), b(Y,A)", "r <= a·INVERSE_b"),
        ("r(X,Y) <= a(A,X), b(A,Y)", "r <= INVERSE_a·b"),
        ("r(X,Y) <= b(A,Y), a(X,A)", "r <= a·b"),
        ("r(c,Y) <= w(Y,A)", "INVERSE_r(c) <= w(·)"),
        ("r(X,c) <= w(A,X)", "r(c) <= INVERSE_w(·)"),
        ("r(X,c) <= rel1(A,X), rel2(A,d)", "r(c) <= INVERSE_rel1·rel2(d)"),
        ("r(X,c) <= rel1(X,A), rel2(d,A)", "r(c) <= rel1·INVERSE_rel2(d)"),
        ("r(X,c) <= rel1(A,X), rel2(d,A)", "r(c) <= INVERSE_rel1·INVERSE_rel2(d)"),
        ("r(X,c) <= rel1(X,A), rel2(A,d)", "r(c) <= rel1·rel2(d)"),
        ("r(X,X) <= p(X,c)", "r(X) <= p(c)"),
        ("r <= a · INVERSE_b", "r <= a·INVERSE_b"),
        ("r(c) <= p(·)", "r(c) <= p(·)"),
    ],
)
def test_simplified_form(rule, want):
    q = rq.parse(rule)
    assert str(q) == want and str(rq.parse(want)) == want


@pytest.mark.parametrize("bad", ["r(X,Y)", "r(X,Y) <= a(X,A), b(B,Y)", "r(X,Y) <= a(X,A)", "r(X,c) <= a(X,d), b(d,A)"])
def test_what_is_no_chain(bad):
    with pytest.raises(ValueError):
        rq.parse(bad)


@pytest.mark.parametrize(
    "rule",
    ["nationality <= livesIn·cityOf", "knows <= INVERSE_knows", "nationality(z) <= livesIn(x)", "nationality(z) <= livesIn(·)", "knows(X) <= livesIn(x)", "livesIn(x) <= knows·livesIn(x)", "next <= next·next·next", "knows <= INVERSE_knows·INVERSE_knows"],
)
def test_scores_equal_brute_force(spark, rule):
    q = rq.parse(rule)
    got = rq.evaluate(toy(spark), q).first()
    assert (got.support, got.body_size, got.head_size) == brute_force(set(TRIPLES), q)
    again = rq.evaluate(toy(spark), rule).first()
    assert again == got
