import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hornweave.llm import katz
from hornweave.llm.common import remainder
from pyspark.sql import functions as F

from .helpers import documents, frame, rest


def words(text):
    return (text or "").encode().lower().split()


def good_turing(counts, k):
    """Discount factors of the counts 1 .. k by Katz's formula, rising."""
    n = Counter(counts)
    cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, k + 1):
        if n[r] and cut < 1:
            star = (r + 1) * n[r + 1] / n[r]
            out[r] = (star / r - cut) / (1 - cut)
        before = out.get(r - 1, 0)
        if not before < out.get(r, 0) < 1:
            out[r] = max((r - 0.5) / r, before)
    return out


class Brute:
    """The model from its definition, with dictionaries of tuples."""

    def __init__(self, rows, order=3, k=5):
        train = [words(t) for i, t in rows if i is not None and rest(i, 5) != 1]
        self.order, self.k = order, k
        self.seen = [Counter() for _ in range(order + 1)]
        for d in train:
            line = ["begin", *d, "end"]
            for m in range(1, order + 1):
                self.seen[m].update(tuple(line[i - m + 1 : i + 1]) for i in range(max(1, m - 1), len(line)))
        self.begins = len(train)
        self.uni = Counter({x[0]: c for x, c in self.seen[1].items()})
        self.n = sum(self.uni.values())
        self.d = [good_turing(c.values(), k) for c in self.seen]
        self.after = defaultdict(dict)
        for m in range(2, order + 1):
            for x, c in self.seen[m].items():
                self.after[x[:-1]][x[-1]] = c
        kept = sum(self.keep(1, c) for c in self.uni.values())
        left = 1 - kept / self.n if self.n else 1.0
        self.unseen = max(left, 0.5 / (self.n + 1)) if self.n else 1.0
        self.scale = (1 - self.unseen) / (1 - left) if left < 1 else 0.0
        self.weight = {}

    def keep(self, m, c):
        return c if c > self.k else self.d[m][c] * c

    def count(self, context):
        return self.begins if context == ("begin",) else self.seen[len(context)][context]

    def p(self, w, context=()):
        if not context:
            return self.scale * self.keep(1, self.uni[w]) / self.n if self.uni[w] else self.unseen
        n = self.count(context)
        if not n:
            return self.p(w, context[1:])
        after, m = self.after[context], len(context) + 1
        share = sum(self.keep(m, c) for c in after.values()) / n
        left = max(1 - share, 0.5 / (n + 1))
        if w in after:
            return self.keep(m, after[w]) / n * (1 - left) / share
        if context not in self.weight:
            self.weight[context] = left / (1 - sum(self.p(x, context[1:]) for x in after))
        return self.weight[context] * self.p(w, context[1:])

    def score(self, text):
        line = ["begin", *words(text), "end"]
        return sum(math.log10(self.p(line[i], tuple(line[max(0, i - self.order + 1) : i]))) for i in range(1, len(line)))

    def base(self, text):
        return sum(math.log10((self.uni[w] + 0.5) / (self.n + 0.5 * (len(self.uni) + 1))) for w in [*words(text), "end"])


def corpus():
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("the of and in Zoo a b c d e f g".split()) + rng.choice(["", "", "x", str(rng.randrange(40))]) for _ in range(rng.randrange(40)))) for i in range(80)]
    return rows + [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t, *_ in documents()]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, small, order):
    rows = corpus()
    p = katz.KatzParams(order, chunk_bytes=2000, partition_tokens=300, context_tokens=20) if small else katz.KatzParams(order)
    docs = frame(spark, rows, "doc_id long, text string").repartition(3 if small else 1)
    got = katz.score(docs.withColumn("held_out", F.lit("mine")).withColumn("trains", F.lit(1)), remainder("doc_id", 5) == 1, p=p).collect()
    b = Brute(rows, order)
    want = [(str(i), rest(i, 5) == 1 if i is not None else False, len(words(t)) + 1, sum(b.uni[w] > 0 for w in [*words(t), "end"]), b.n, round(b.base(t), 6), round(b.score(t), 6)) for i, t in rows]
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


def test_every_context_sums_to_one():
    b = Brute(corpus())
    contexts = [("begin",), ("never", "seen"), ("never seen",), *[x for m in (1, 2) for x in list(b.seen[m])[:60] if x[-1] != "end"]]
    for context in contexts:
        assert abs(sum(b.p(w, context) for w in [*b.uni, "never seen"]) - 1) < 1e-9


def test_texts_that_occur_twice_score_higher(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(60))
    rows = [(i, text()) for i in range(300)]
    twice = [i for i in range(300) if rest(i, 5) != 1][:20]
    rows += [(1000 + i, rows[i][1]) for i in twice if rest(1000 + i, 5) != 1]
    got = {r.doc_id: r.score / r.n_tokens for r in katz.score(frame(spark, rows, "doc_id long, text string"), remainder("doc_id", 5) == 1).collect()}
    once = [v for i, v in got.items() if i < 1000 and i not in twice and rest(i, 5) != 1]
    assert min(got[i - 1000] for i in got if i >= 1000) > max(once)


def test_weights_when_discounts_leave_nothing():
    alpha, factor = katz.weights(np.array([10.0, 0.0]), np.array([10.0, 0.0]), np.array([0.4, 0.0]))
    assert abs(factor[0] + alpha[0] * 0.6 - 1) < 1e-12 and alpha[0] > 0 and (alpha[1], factor[1]) == (1, 1)


def test_pack_round_trip():
    arrays = [np.arange(5), np.zeros(0, np.int32), np.array([1.5, -2]), np.array([2**63], np.uint64)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True))


def test_empty_and_untrained(spark):
    assert katz.score(frame(spark, [], "doc_id long, text string"), remainder("doc_id", 5) == 1).count() == 0
    one = katz.score(frame(spark, [(None, "a b")], "doc_id long, text string"), remainder("doc_id", 5) == 1).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.score, one.held_out) == (3, 0, 0, 0.0, False)
