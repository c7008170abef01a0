import hashlib
import random
import re

import pytest
from hornweave.llm import decontam

from .helpers import frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(13, len(v))
        for s in range(len(v) - m + 1 if v else 0):
            for k in range(len(w) - m + 1):
                if w[k : k + m] == v[s : s + m]:
                    hit.update(range(k, k + m))
                    ids |= set() if item is None else {str(item)}
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def cases():
    rng = random.Random(5)
    vocab = ["the", "of", "Ünd", "x1", "q", "zz", "and"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, "--"), (52, "solo"), (1, "a second text of item one"), (None, "words of an item without id")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(200 + k, f"{text(20)}, {t}! {text(4)}") for k, (_, t) in enumerate(items) if t]
    docs += [(400, "some words of an item without id here"), (401, f"words of an item without id, {items[3][1]}")]
    docs += [(300, None), (301, ""), (302, "solo"), (303, "SOLO. solo"), (302, "solo"), (None, "solo x"), (304, text(4000) + " " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_matches_brute_force(spark, block):
    docs, items = cases()
    d = frame(spark, docs, "doc_id long, text string")
    b = frame(spark, items, "item_id long, text string")
    out = decontam.digest(decontam.find_contamination(d, b, max_benchmark_bytes=block)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out)
    assert got == sorted((str(i), *brute(t, items)) for i, t in docs)


def test_empty_tables(spark):
    d, b = frame(spark, [], "doc_id long, text string"), frame(spark, [], "item_id long, text string")
    assert decontam.find_contamination(d, b).count() == 0
    one = decontam.find_contamination(frame(spark, [(1, "a b")], "doc_id long, text string"), b).first()
    assert (one.n_words, one.hit_spans, one.hit_items) == (2, [], [])


def test_shift_skips_positions():
    t = decontam.PatternTable(4)
    t.add([b"a", b"b", b"c", b"d"], 0, ("1",))
    t.add([b"z", b"a", b"b", b"c", b"d"], 1, ("2",))
    assert t.shift == {(b"a", b"b"): 2, (b"b", b"c"): 1, (b"c", b"d"): 0}
    assert t.search([b"x"] * 5 + [b"a", b"b", b"c", b"d"] * 2) == [(5, ("1", "2")), (9, ("1", "2"))]


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_clashing_columns(spark, block):
    d = frame(spark, [(1, "a b solo", 7, "x", "y"), (2, None, 8, "x", "y")], "doc_id long, text string, N_HIT int, __k1 string, __spans string")
    b = frame(spark, [(5, "solo"), (6, "b solo extra words " * 5)], "item_id long, text string")
    out = decontam.find_contamination(d, b, max_benchmark_bytes=block, prefix="p_")
    assert out.columns == [*d.columns, "p_n_words", "p_n_hit", "p_hit_spans", "p_hit_items"]
    assert sorted((r.doc_id, r.N_HIT, r["__k1"], r.p_n_words, r.p_n_hit, r.p_hit_items) for r in out.collect()) == [(1, 7, "x", 3, 1, ["5"]), (2, 8, "x", 0, 0, [])]
    replaced = decontam.find_contamination(d, b, max_benchmark_bytes=block)
    assert replaced.columns == ["doc_id", "text", "__k1", "__spans", "n_words", "n_hit", "hit_spans", "hit_items"]
