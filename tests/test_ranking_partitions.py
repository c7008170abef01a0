import glob
import itertools
import random
from collections import Counter

import pytest
from hornweave import storage
from hornweave.operators import graph, merging, partitioning, ranking, rounds
from hornweave.plans import catalogue
from pyspark.sql import functions as F

from .toy import TRIPLES, toy

FIRED = "query string, direction string, candidate string, target string, rule string, applied double"


def fired(spark):
    steps = [
        (0.9, "a b c d d1 d2"), (0.8999, "aaa bbb"), (0.891, "a b"), (0.88, "a b e1 e2 e3 e4"), (0.6, "a e1 e4"), (0.5, "xa xb xe1 xe2 xe3 xe4"),
        (0.41, "xa xb ye1 ye2 ye3 ye4"), (0.39, "xe2 xa xxx"), (0.22, "xe1 xe2"), (0.21, "xe4"), (0.21, "e1 e2"), (0.19, "u1 u2"),
    ]
    rows = [("q", "tail", c, "b", f"r{i}", s) for i, (s, names) in enumerate(steps) for c in names.split()]
    return spark.createDataFrame(rows, FIRED)


def test_max_plus_compares_lists(spark):
    got = ranking.max_plus(fired(spark), 10).orderBy("rank").collect()
    assert [r.candidate for r in got] == ["a", "b", "c", "d", "d1", "d2", "aaa", "bbb", "e1", "e4"]
    score = spark.range(1).select(ranking.refined_score(F.array(F.lit(0.9), F.lit(0.5))).alias("s")).first().s
    assert abs(score - 0.90005) < 1e-12


def test_known_answers_go_but_not_the_target(spark):
    known = spark.createDataFrame([("q", "tail", "a"), ("q", "tail", "b"), ("other", "tail", "c")], "query string, direction string, candidate string")
    left = {r.candidate for r in ranking.drop_known(fired(spark), known).collect()}
    assert "a" not in left and {"b", "c"} <= left
    ranked = ranking.max_plus(fired(spark), 100).withColumn("target", F.lit("b"))
    r = ranking.filtered_rank(ranked, known).first()
    assert (r.raw_rank, r.filtered_rank) == (2, 1)
    queries = spark.createDataFrame([("q", "tail"), ("missed", "tail")], "query string, direction string")
    e = ranking.hits_and_mrr(queries, ranking.filtered_rank(ranked, known), ["direction"]).first()
    assert (e.queries, e.found, e.hits_1, e.raw_hits_1, e.raw_hits_3, e.mrr) == (2, 1, 0.5, 0.0, 0.5, 0.5)
    assert e.hits_1 <= e.mrr <= 1 and e.hits_1 <= e.hits_3 <= e.hits_10


def test_noisy_or(spark):
    rows = [("q", "tail", "x", "t", "r1", 0.5), ("q", "tail", "x", "t", "r2", 0.5), ("q", "tail", "y", "t", "r3", 0.7)]
    df = spark.createDataFrame(rows, FIRED)
    assert [r.candidate for r in ranking.noisy_or(df, 5).orderBy("rank").collect()] == ["x", "y"]
    assert [r.candidate for r in ranking.noisy_or(df, 5, top=1).orderBy("rank").collect()] == ["y", "x"]


def lists(spark, text):
    rows = [("q", "tail", c, 1.0 / i, i) for i, c in enumerate(text.split(), 1)]
    return spark.createDataFrame(rows, "query string, direction string, candidate string, score double, rank int")


def test_reordering(spark):
    mine, other = lists(spark, "a b c d"), lists(spark, "c x a")
    got = ranking.reorder(mine, other).orderBy("new_rank").collect()
    assert [r.candidate for r in got] == ["c", "a", "b", "d"] and [r.score for r in got] == [1.0, 0.875, 0.75, 0.625]
    w = {r.candidate: r.new_score for r in ranking.reorder_weighted(mine, other, 1.0, 0.5).collect()}
    assert abs(w["c"] - (0.5 / 3 * 2 / 2 + 0.5)) < 1e-8 and abs(w["b"] - (0.5 / 2 * 2 / 5 + 0.5 / 4)) < 1e-8
    e = ranking.extend(mine, other, 3, 0.9).orderBy("rank").collect()
    assert [r.candidate for r in e] == ["a", "c", "b"]


def test_merging(spark):
    r = spark.createDataFrame([("h", "b", 4, 8, 10, 0.2), ("h", "b", 6, 8, 10, 0.4), ("h", "c", 1, 2, 2, 0.5)], "head string, body string, support int, head_size int, body_size int, jaccard double")
    m = {x.body: x for x in merging.merge_metrics(r).collect()}
    assert (m["b"].support, m["b"].body_size, m["b"].size, m["b"].confidence) == (10, 20, 2, 0.5) and abs(m["b"].jaccard - 0.3) < 1e-12
    assert {x.body: x.support for x in merging.merge_distinct(r).collect()} == {"b": 6, "c": 1}
    c = merging.compare(r, r.where("body = 'c'")).first()
    assert (c.common, c.only_first, c.only_second, c.coverage) == (1, 1, 0, 1.0)
    h = {x.bin: x.n for x in merging.histogram(r, "jaccard", 2, 0.0, 0.5).collect()}
    assert h == {0: 1, 1: 2}


STRATEGIES = {
    "random": lambda e: partitioning.random_nonoverlap(e, 4), "hub": lambda e: partitioning.hub_replication(e, 9, 3), "relation": lambda e: partitioning.relation_centric(e, 4),
    "edge_cut": lambda e: partitioning.edge_cut(e, 3), "vertex_cut": lambda e: partitioning.vertex_cut(e, 2, 2), "communities": lambda e: partitioning.communities(e, 6), "bfs": lambda e: partitioning.bfs_expansion(e, 6, 1),
}


@pytest.mark.parametrize("name", STRATEGIES)
def test_every_edge_is_placed(spark, name):
    e = graph.edges(toy(spark))
    parts = [tuple(r) for r in STRATEGIES[name](e).collect()]
    want = {x for x in TRIPLES if x[0] != x[2]}
    assert {x[1:] for x in parts} == want
    counts = Counter(x[1:] for x in parts)
    if name == "bfs":  # balls overlap, but a part has an edge once
        assert len(set(parts)) == len(parts) and sum(counts.values()) < 3 * len(want) + len(want)
    elif name != "hub":
        assert set(counts.values()) == {1}
    else:
        assert len(set(counts.values())) <= 2
    if name in ("random", "relation", "communities", "bfs"):
        limit = 4 if name in ("random", "relation") else 6
        assert max(Counter(x[0] for x in parts).values()) <= limit


def test_a_turns_seeds_are_chosen_once_and_its_balls_laid_in_order(spark, monkeypatch):
    made, real = [], partitioning.written
    monkeypatch.setattr(partitioning, "written", lambda df, name, *more: made.append((name, real(df, name, *more))) or made[-1][1])
    e = graph.edges(toy(spark))
    parts = partitioning.bfs_expansion(e, 6, 1)
    seeds = [{tuple(r) for r in df.collect()} for name, df in made if name == "bfs_seeds"]
    assert seeds and all(sorted(b for _, b in x) == list(range(1 << i, (1 << i) + len(x))) for i, x in enumerate(seeds))
    want, links = [], [x for x in set(TRIPLES) if x[0] != x[2]]
    for node, ball in sorted((x for y in seeds for x in y), key=lambda x: x[1]):
        near = {node} | {t for h, _, t in links if h == node} | {h for h, _, t in links if t == node}
        want += sorted(x for x in links if near & {x[0], x[2]})
    inside = {(i // 6, *x) for i, x in enumerate(want)}
    got = {tuple(r) for r in parts.collect()}
    assert {x for x in got if x[0] <= (len(want) - 1) // 6} == inside
    stats = {(r.part_id, r.edges, r.nodes) for r in partitioning.part_stats(parts).collect()}
    assert stats == {(p, sum(x[0] == p for x in got), len({n for x in got if x[0] == p for n in (x[1], x[3])})) for p in {x[0] for x in got}}


def test_random_multi_and_stats(spark):
    e = graph.edges(toy(spark))
    parts = partitioning.random_multi(e, 5, 3)
    r = partitioning.replication(parts).first()
    assert (r.edges_total, r.replication_factor) == (3 * e.count(), 3.0)
    assert sum(x.edges for x in partitioning.part_stats(parts).collect()) == r.edges_total


def structures(parts):
    of = {}
    for p, *e in parts:
        of.setdefault(tuple(e), set()).add(p)
    edges = list(of)

    def count(chains):
        chains = list(chains)
        return len(chains), sum(bool(set.intersection(*(of[e] for e in c))) for c in chains)

    pt = [(a, b) for a, b in itertools.product(edges, edges) if a[2] == b[0]]
    c2 = [(a, b) for a, b in pt if b[2] == a[0]]
    c3 = [(a, b, c) for a, b in pt for c in edges if b[2] == c[0] and c[2] == a[0] and len({a[0], b[0], c[0]}) == 3]
    c4 = [(a, b, c, d) for a, b in pt for c in edges if b[2] == c[0] for d in edges if c[2] == d[0] and d[2] == a[0] and len({a[0], b[0], c[0], d[0]}) == 4]
    return [count(x) for x in (pt, c2, c3, c4)]


@pytest.mark.parametrize("replicated", [False, True])
def test_retention_equals_brute_force(spark, replicated):
    e = graph.edges(toy(spark))
    parts = partitioning.random_multi(e, 9, 2) if replicated else partitioning.random_nonoverlap(e, 9)
    tables = [f(parts) for f in (partitioning.retention_paths, partitioning.retention_cycles2, partitioning.retention_cycles3, partitioning.retention_cycles4)]
    got = [(t.first().total, t.first().kept) for t in tables]
    assert got == structures([tuple(r) for r in parts.collect()])
    o = partitioning.overall_retention(*tables).first()
    assert (o.total, o.kept) == (sum(x for x, _ in got), sum(x for _, x in got))


def test_zero_candidates_give_the_same_first_places_as_every_rule_for_every_query(spark):
    zero = spark.createDataFrame([(f"zero {i}", f"s{i:02}", (40 - i // 3) / 10_000) for i in range(40)], "rule string, candidate string, applied double")
    other = spark.createDataFrame([("a", f"s{i:02}") for i in (0, 3, 31, 39)] + [("c", "s01")], "h string, candidate string")
    queries = spark.createDataFrame([("a",), ("b",)], "h string")
    fired = other.where("h = 'a'").select("h", F.lit("path").alias("rule"), "candidate", F.lit(0.5).alias("applied"))
    few = ranking.zero_candidates(queries, "h", zero, other, 4)
    assert few.count() == 4 + 8 + 2 and few.where("h = 'c'").count() == 0
    assert few.where("h = 'a' and candidate in ('s31', 's39')").count() == 2
    as_query = lambda df: df.unionByName(fired).select(F.col("h").alias("query"), F.lit("tail").alias("direction"), "rule", "candidate", "applied")
    for rank in (ranking.max_plus, ranking.noisy_or):
        got, want = (sorted(map(tuple, rank(as_query(z), 4).collect())) for z in (few, queries.crossJoin(zero)))
        assert got == want and len(got) == 8


def test_cycles_at_a_hub(spark):
    """Edges that no cycle can have go before any join, and paths through a hub aren't listed where its neighbours have fewer."""
    rows = [("hub", "r", f"o{i}") for i in range(300)] + [(f"i{i}", "r", "hub") for i in range(300)]
    rows += [("o1", "r", "i1"), ("o2", "r", "x"), ("x", "r", "i2"), ("o2", "s", "x")]
    parts = spark.createDataFrame([(n % 2, *x) for n, x in enumerate(rows)], "part_id long, h string, r string, t string")
    kept = {(r.h, r.r, r.t) for r in partitioning._weighed(partitioning.parts_of_edges(parts)).collect()}
    assert kept == {x for x in rows if x[0] in ("o1", "o2", "x", "i1", "i2") or x[2] in ("o1", "o2", "i1", "i2")}
    got = [f(parts).first() for f in (partitioning.retention_cycles3, partitioning.retention_cycles4)]
    want = structures([tuple(r) for r in parts.collect() if (r.h, r.r, r.t) in kept])[2:]
    assert [(x.total, x.kept) for x in got] == want and want[0][0] == 3 and want[1][0] == 8


def test_rule_order_has_rules_that_fire_for_no_asked_order(spark, tmp_path):
    """Only orders that nobody asks about were fulfilled, so the inverse rule has a score and no candidate."""
    rows = [(o, o % 3, o % 2, "O" if o == 10 else "F", "N") for o in range(1, 11)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.rule: r.position for r in catalogue.rule_order(spark, str(tmp_path)).collect()}
    assert set(got) == {"path", "inverse", "zero S0", "zero S1"} and got["inverse"] == 1


def test_ranks_of_one_entitys_targets_come_from_one_list_of_its_candidates(spark):
    rnd = random.Random(3)
    names = [f"c{i}" for i in range(12)]
    scores = {"r1": 0.5, "r2": 0.25}
    zero = {c: rnd.choice([0.125, 0.25, 0.5, 0.75]) for c in names[:9]}
    fired = {(h, r, c) for h in "abcd" for r in scores for c in names if rnd.random() < 0.4}
    known = {(h, c) for h in "abcd" for c in names if rnd.random() < 0.4}
    targets = {x for x in known if rnd.random() < 0.7}
    rows = [(f"{h}|{t}", "tail", c, t, r, scores[r]) for h, t in targets for g, r, c in fired if g == h]
    rows += [(f"{h}|{t}", "tail", c, t, "zero " + c, x) for h, t in targets for c, x in zero.items()]
    marks = spark.createDataFrame([(f"{h}|{t}", "tail", c) for h, t in targets for g, c in known if g == h], "query string, direction string, candidate string")
    want = ranking.max_plus(ranking.drop_known(spark.createDataFrame(rows, FIRED), marks), 6)
    want = {(r.query, r.rank) for r in want.collect() if r.query.endswith("|" + r.candidate)}
    lists = [(h, r, [c for g, q, c in sorted(fired) if (g, q) == (h, r)]) for h in "abcd" for r in scores]
    lists += [(h, r, cs[:2]) for h, r, cs in lists]  # a rule may give a candidate twice
    pairs = [spark.createDataFrame(sorted(x), "entity string, candidate string") for x in (known, targets)]
    got = ranking.shared_ranks(
        spark.createDataFrame(lists, "entity string, rule string, candidates array<string>"), spark.createDataFrame(list(scores.items()), "rule string, applied double"),
        spark.createDataFrame(list(zero.items()), "candidate string, applied double"), *pairs, 6,
    ).collect()
    assert len(want) > 5 and {(f"{r.entity}|{r.candidate}", r.rank) for r in got} == want


def test_the_ranking_query_lists_no_candidates_for_each_triple(spark, monkeypatch):
    monkeypatch.setattr(ranking, "drop_known", None)
    monkeypatch.setattr(ranking, "zero_candidates", None)
    assert catalogue.QUERIES["rank_filtered"](spark, "/root/testdata/sf0.001").count() > 0


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(rounds, "BLOCK", 60)
    monkeypatch.setattr(rounds, "PACKED", 32)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_labels_and_moves_equal_brute_force_in_many_blocks(spark, small_blocks, kind):
    rnd = random.Random(5)
    name = (lambda i: f"n{i:02}") if kind == "string" else (lambda i: i)
    rows = sorted({(rnd.randrange(40), rnd.choice("xy"), rnd.randrange(40)) for _ in range(120)} | {(0, "x", i) for i in range(1, 30)})
    rows = [(name(h), r, name(t)) for h, r, t in rows if h != t]
    e = spark.createDataFrame(rows, f"h {kind}, r string, t {kind}")
    ends = [(h, t) for h, _, t in rows] + [(t, h) for h, _, t in rows]
    label = {a: a for a, _ in ends}
    for _ in range(5):
        votes = {v: Counter([label[b] for a, b in set(ends) if a == v] + [label[v]]) for v in label}
        label = {v: min(c, key=lambda x: (-c[x], x)) for v, c in votes.items()}
    assert dict(partitioning.propagate_labels(e).collect()) == label
    hashes = spark.createDataFrame([(v,) for v in label], f"node {kind}").select("node", F.pmod(F.xxhash64("node"), F.lit(3)), F.pmod(F.xxhash64("node", F.lit(7)), F.lit(2))).collect()
    place, half = {v: p for v, p, _ in hashes}, {v: x for v, _, x in hashes}
    for i in range(3):
        load = Counter(place.values())
        cost = {p: 0.1 * n / (len(place) / len(load)) for p, n in load.items()}
        votes = {v: Counter(place[b] for a, b in ends if a == v) for v in place}
        place = {v: min(votes[v], key=lambda p: (cost[p] - votes[v][p], p)) if half[v] == i % 2 else p for v, p in place.items()}
    assert {tuple(x) for x in partitioning.edge_cut(e, 3).collect()} == {(place[h], h, r, t) for h, r, t in rows}


def test_placements_count_repetitions(spark, small_blocks):
    rows = [(i % 3, i, 1, i + 1) for i in range(100)]
    rows += [(0, 0, 1, 1), (1, 0, 1, 1), (2, 0, 2, 1), (1, 1, 1, 2)]  # again, in another part, another edge, again
    got = partitioning.placements(spark.createDataFrame(rows, "part_id long, h long, r long, t long")).first()
    assert (got.placed, got.different, got.edges, got.largest) == (104, 102, 101, 35)


def test_part_invariants_leave_no_tables_of_parts(spark):
    before = set(glob.glob(f"{storage.application_dir(spark)}/parts_*"))
    assert all(r.no_repetition and r.within_bound is not False and r.each_once is not False for r in catalogue.part_invariants(spark, "/root/testdata/sf0.001").collect())
    assert set(glob.glob(f"{storage.application_dir(spark)}/parts_*")) <= before


def test_triples_of_one_entity_share_their_first_places(spark):
    """As ranking each triple's own candidates, but these go once into one shuffle."""
    fired = [(h, f"c{c}", a) for h in ("x", "y") for c in range(8) for a in ((0.5, 0.25) if c % 3 else (0.5,))] + [("x", "c9", 0.75)]
    known = [("x", "c1"), ("x", "c2"), ("x", "c9"), ("x", "unseen"), ("y", "c0")]
    rows = spark.createDataFrame(fired, "h string, candidate string, applied double")
    answers = spark.createDataFrame(known, "h string, candidate string")
    asked = spark.createDataFrame([(f"{h}|{t}", "tail", t, h) for h, t in known], "query string, direction string, target string, h string")
    got = ranking.shared_top(rows, answers, asked, F.col("confs"), 3)
    single = asked.join(rows, "h").select("query", "direction", "candidate", "target", F.lit("r").alias("rule"), "applied")
    want = ranking.max_plus(ranking.drop_known(single, asked.join(answers, "h").select("query", "direction", "candidate")), 3)
    assert {(r.query, r["rank"]): (r.candidate, r.by) for r in got.collect()} == {(r.query, r["rank"]): (r.candidate, r.confs) for r in want.collect()}
    assert got.count() == 15
