import itertools
import random

import numpy as np
from hornweave.llm import quality
from pyspark.sql import functions as F

from .helpers import WORDS, documents, frame, rest


def corpus():
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice(WORDS["en"]) for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    for i in range(200):
        good = i % 3 > 0
        lines = [line(rng.randint(4, 12)) for _ in range(rng.randint(1, 8))]
        if not good:
            lines[len(lines) // 2 :] = [x.upper().replace(" ", "!! ") for x in lines[len(lines) // 2 :]]
        rows.append((i, "\n".join(lines), "en", "s", 1))
        labels.append((i, int(good), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_separates_held_out_documents(spark):
    rows, labels = corpus()
    docs = frame(spark, rows + [(500 + k, *r[1:]) for k, r in enumerate(documents())])
    model = quality.fit(docs, frame(spark, [*labels, (3, 1, 0), (999, None, 0), (None, 1, 0)], LABELS), F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(got[i], y) for i, y, _ in labels if i % 4 == 2]
    assert sum((s >= 0.7) == bool(y) for s, y in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows) + len(documents())


def test_bad_lines_of_mixed_documents_get_low_marginals(spark):
    rows, labels = corpus()
    model = quality.fit(frame(spark, rows), frame(spark, labels, LABELS), F.lit(True))
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(WORDS["en"]) for _ in range(8)).capitalize() + "."
    for _ in range(20):
        good, bad = [line() for _ in range(5)], [line().upper().replace(" ", "!! ") for _ in range(5)]
        marginal, _, _ = quality.line_marginals(["\n".join(good + bad), "\n".join(bad + good)], model)
        assert marginal[:4].min() > marginal[6:10].max() + 0.3 and marginal[16:].min() > marginal[10:14].max() + 0.3


def brute_score(text, model):
    """Score by enumeration of the labels of all lines."""
    lines = (text or "").split("\n")
    x = np.stack([quality.line_features([t])[0][0] for t in lines])
    z = (x - model.mean) / model.scale
    none = np.zeros(z.shape[1])
    emit = [np.concatenate([z[i - 1] if i else none, z[i], z[i + 1] if i + 1 < len(z) else none, [1]]) @ model.weights for i in range(len(z))]
    total, good = 0.0, np.zeros(len(lines))
    for labels in itertools.product((0, 1), repeat=len(lines)):
        w = np.exp(sum(e for e, k in zip(emit, labels, strict=True) if k) + sum(model.transition[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        total += w
        good += w * np.array(labels)
    size = np.array([max(len(t), 1) for t in lines])
    return float((size * good / total).sum() / size.sum())


def test_scores_equal_enumeration(spark):
    rows, labels = corpus()
    model = quality.fit(frame(spark, rows), frame(spark, labels, LABELS), F.lit(True))
    few = [r for r in rows[:60] + documents() if (r[1] or "").count("\n") < 8 and len(r[1] or "") < 9000]
    got = quality.score(frame(spark, few).withColumn("Score", F.lit("mine")), model).collect()
    want = sorted((str(r[0]), round(brute_score(r[1], model), 6)) for r in few)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want


def test_gradient_is_that_of_the_likelihood():
    """One step from zero with plain numbers: the likelihood rises along the fitted weights."""
    rows, labels = corpus()
    x, chars, n = quality.line_features([r[1] for r in rows])
    y = np.array([b for _, b, _ in labels])

    def likelihood(model):
        s = np.array(quality.score_texts([r[1] for r in rows], model)).clip(1e-9, 1 - 1e-9)
        return np.where(y == 1, np.log(s), np.log(1 - s)).mean()

    one, more = (quality.fit_weights(x, chars, n, y, quality.QualityParams(steps=k)) for k in (1, 60))
    zero = quality.CrfModel(one.mean, one.scale, 0 * one.weights, 0 * one.transition)
    assert likelihood(zero) < likelihood(one) < likelihood(more) > -0.1


def test_fit_takes_a_block_of_long_texts_and_one_of_repeated_ids(spark):
    rows, labels = corpus()
    long_rows = [(900, "\n".join(["A good line of some words."] * 3000), "en", "s", 1), (901, "BAD!!\n" * 3000, "en", "s", 1)] + [(3, f"again {k}", "en", "s", 1) for k in range(50)]
    p = quality.QualityParams(steps=20)
    a, b = (quality.fit(frame(spark, order).repartition(3), frame(spark, [*labels, (900, 1, 0), (901, 0, 0)], LABELS), F.lit(True), p=p) for order in (rows + long_rows, (rows + long_rows)[::-1]))
    assert np.array_equal(a.weights, b.weights) and a.prior is None


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    n_lines, transition = np.array([3, 1, 5]), rng.normal(size=(2, 2))
    good = rng.normal(size=9)
    marginal, log_z, pair = quality.forward_backward(good, transition, n_lines, pairs=True)
    at, want_pair = 0, np.zeros((2, 2))
    for k, n in enumerate(n_lines):
        total, ones = 0.0, np.zeros(n)
        pairs = np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(good[at + i] * y[i] for i in range(n)) + sum(transition[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            ones += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += w
        assert np.allclose(marginal[at : at + n], ones / total) and np.isclose(log_z[k], np.log(total))
        want_pair += pairs / total
        at += n
    assert np.allclose(pair, want_pair)


def test_degenerate_labels_and_empty_tables(spark):
    docs = frame(spark, documents()[:5])
    none = quality.fit(docs, frame(spark, [], LABELS), F.lit(True))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    ones = quality.fit(docs, frame(spark, [(0, 1, 0), (1, 1, 0)], LABELS), F.lit(True))
    assert {r.score for r in quality.score(docs, ones).collect()} == {1.0}
    assert quality.score(frame(spark, []), none).count() == 0


def test_features_do_not_depend_on_neighbours_in_the_batch():
    texts = [r[1] for r in documents()]
    x, chars, n = quality.line_features(texts)
    at = 0
    for t, k in zip(texts, n, strict=True):
        alone, size, _ = quality.line_features([t])
        assert np.allclose(alone, x[at : at + k]) and (size == chars[at : at + k]).all()
        at += k


def test_remainder_helper(spark):
    from hornweave.llm.common import remainder

    got = spark.range(50).select("id", remainder("id", 4).alias("r")).collect()
    assert all(r.r == rest(r.id, 4) for r in got)
