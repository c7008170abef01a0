import random

import numpy as np
import pytest
from hornweave.llm import components, hashing, neardup
from pyspark.sql import functions as F

from .helpers import frame

SCHEMA = "doc_id long, text string"


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Component of each row over all pairs; rows that share an id are one node."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    keys = [("id", i) if i is not None else ("row", k) for k, (i, _) in enumerate(rows)]
    sets = [sets_of(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[root(keys[a])] = root(keys[b])
    least = {}
    for k, (i, _) in zip(keys, rows, strict=True):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(s), least.get(root(k)) if s else i) for k, s, (i, _) in zip(keys, sets, rows, strict=True)]


def cases(seed=4, crowd=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []

    def edited(words, n):
        out = list(words)
        for _ in range(n):
            out[rng.randrange(len(out))] = word()
        return out

    for i in range(crowd):
        rows.append((i, " ".join(edited(base, rng.randint(0, 7)))))
    for g in range(12):
        own = [word() for _ in range(rng.randint(6, 60))]
        for k in range(4):
            rows.append((1000 + 10 * g + k, "  ".join(edited(own, k % 3)).upper() if k == 3 else " ".join(edited(own, k % 2))))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "One\ttwo"), (2005, "one two three"), (5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1])]
    rows += [(None, "quite alone here " * 3), (2010, "w " * 20_000), (2011, "w " * 30_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, large, most", [(256, 1000, 1000), (8, 3, 100_000), (8, 3, 0)])
def test_matches_brute_force(spark, block, large, most):
    rows = cases()
    out = neardup.near_duplicates(frame(spark, rows, SCHEMA), p=neardup.NearDupParams(block=block, large=large, most_large=most)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == sorted(brute(rows), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_deduplicate_keeps_one_of_each(spark):
    rows = cases()
    kept = neardup.deduplicate(frame(spark, rows, SCHEMA).withColumn("node", F.lit("mine")))
    assert kept.columns == ["doc_id", "text", "node"]
    want = {c for i, n, c in brute(rows) if n}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None and x not in (2000, 2001, 2002)) == sorted(x for x in want if x is not None)
    assert {2000, 2001, 2002} <= set(got)


def test_buckets_of_unlike_sizes(spark):
    """Texts that start alike share bands though their sizes differ; rows that share an id bring sets of several sizes into a bucket."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for i in range(120):
        words = base + [f"x{i % 9}y{k}" for k in range(rng.choice([0, 3, 6, 9, 12, 15, 25, 60]))]
        rows.append((rng.choice([i, 7, None]), " ".join(words)))
    out = neardup.near_duplicates(frame(spark, rows, SCHEMA), p=neardup.NearDupParams(block=4, rows=1, large=5)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == sorted(brute(rows), key=str)


def test_clashing_columns_stay(spark):
    rows = [(1, "a b c d e f g", "x", "y", 5), (2, "a b c d e f g", "x", "y", 6), (None, "other words", "x", "z", 7), (3, None, "q", None, None)]
    docs = frame(spark, rows, "doc_id long, text string, __id string, __key string, component_id int")
    assert neardup.near_duplicates(docs).columns == ["doc_id", "text_key", "n_shingles", "component_id", "kept"]
    out = neardup.deduplicate(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)


def test_deduplicate_keeps_every_lone_text_without_id(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(6)]
    rows = [(None, t) for t in texts] + [(None, texts[0]), (None, texts[1] + " more"), (None, "ab"), (None, ""), (None, None), (7, texts[2]), (8, "another text of some words here")]
    kept = [(r.doc_id, r.text) for r in neardup.deduplicate(frame(spark, rows, SCHEMA)).collect()]
    near = {texts[1], texts[1] + " more"}
    assert sum(t in near for _, t in kept) == 1
    want = [(None, texts[0]), *[(None, t) for t in texts[3:]], (None, "ab"), (None, ""), (None, None), (7, texts[2]), (8, rows[-1][1])]
    assert sorted([x for x in kept if x[1] not in near], key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, [], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(90)] + [(3, 3)]
    got = {r.node: r.component for r in components.components(frame(spark, edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if k != 3}


def test_hashes_do_not_depend_on_the_chunk(monkeypatch):
    texts = ["The quick  brown\tfox", "", None, "ÉÀ the QUICK", "x" * 300 + " quick"]
    alone = [hashing.word_hashes([t])[1].tolist() for t in texts]
    offsets, words = hashing.word_hashes(texts)
    assert [words[offsets[k] : offsets[k + 1]].tolist() for k in range(5)] == alone
    monkeypatch.setattr(hashing, "_BLOCK", 16)
    assert (hashing.word_hashes(texts)[1] == words).all()
    assert alone[0][1] == alone[3][2] == alone[4][1] and len(np.unique(words)) == 6


def test_min_max_estimates_similarity():
    p = neardup.NearDupParams(permutations=400, rows=1)
    rng = np.random.default_rng(0)
    pool = hashing.mix(rng.integers(0, 2**63, 500).astype(np.uint64))
    a, b = np.sort(pool[:400]), np.sort(pool[100:])
    keys = neardup.band_keys(np.array([0, 400, 800]), np.concatenate([a, b]), p)
    assert abs((keys[0] == keys[1]).mean() - 0.6) < 0.06
