import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hornweave.config import Config
from hornweave.operators import graph, merging, mining, paths, scoring, threesteps
from hornweave.operators import pairs as cells
from hornweave.plans import catalogue
from pyspark.sql import functions as F

from .toy import TRIPLES, both, toy


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_loops_inverse(spark):
    kg = toy(spark)
    e = graph.edges(kg)
    assert rows(e) == sorted({x for x in TRIPLES if x[0] != x[2]})
    assert rows(graph.loops(kg)) == [("knows", "a")]
    assert set(rows(graph.with_inverse(e))) == both()
    assert set(rows(graph.with_inverse(graph.with_inverse(e)).distinct())) == both()


def test_relation_stats_and_functional(spark):
    e = graph.add_triples(toy(spark), toy(spark))
    got = {r.r: r for r in graph.relation_stats(e).collect()}
    assert (got["knows"].triples, got["knows"].heads, got["knows"].tails, got["knows"].loops) == (5, 5, 5, 1)
    assert {r.r for r in graph.functional_relations(e).collect()} == {"knows", "livesIn", "cityOf", "nationality", "next"}


def test_dictionaries(spark):
    names = sorted({x for h, _, t in TRIPLES for x in (h, t)})
    assert rows(graph.entity_dictionary(toy(spark))) == list(enumerate(names, 1))
    got = graph.relation_dictionary(toy(spark)).collect()
    back = {r.relation_id: r for r in got}
    assert len(got) == 10 and all(back[r.inverse_id].inverse_id == r.relation_id for r in got)


def test_lookups_and_sets(spark):
    kg = graph.edges(toy(spark))
    ask = spark.createDataFrame([("a", "knows", "b"), ("b", "knows", "a")], "h string, r string, t string")
    assert rows(graph.is_true(ask, kg)) == [("a", "knows", "b")]
    assert rows(graph.is_false(ask, kg)) == [("b", "knows", "a")]
    assert {r.t for r in graph.tails(kg, ask.select("h", "r")).collect()} == {"b", "c"}
    c = graph.compare(kg, ask).first()
    assert (c.common, c.only_first, c.only_second) == (1, kg.count() - 1, 1)
    assert rows(graph.by_entity(kg, "z")) == sorted(x for x in both() if x[0] == "z")


def test_sampling_is_bounded_and_real(spark):
    kg = graph.edges(toy(spark))
    drawn = graph.random_entities(kg, 7).collect()
    assert Counter((r.r, r.side) for r in drawn) == Counter({(r, s): 7 for r in ("knows", "livesIn", "cityOf", "nationality", "next") for s in ("head", "tail")})
    assert graph.random_triples(kg, 1).count() == 5
    assert graph.sample_fanout(kg, 0, 1).count() == len({(h, r) for h, r, t in TRIPLES if h != t})


def pairs(path):
    e = both()
    if len(path) == 1:
        return {(h, t) for h, r, t in e if r == path[0]}
    out = None
    for i in range(1, len(path)):
        j = {(h, t) for (h, m), (m2, t) in itertools.product(pairs(path[:i]), pairs(path[i:])) if m == m2 and h != t}
        out = j if out is None else out & j
    return out


def test_paths_equal_brute_force(spark):
    e = graph.with_inverse(graph.edges(toy(spark)))
    for p in [("knows", "knows"), ("knows", "knows", "knows"), ("livesIn", "cityOf"), ("next", "next", "next"), ("livesIn", "INVERSE_livesIn", "knows")]:
        assert set(rows(paths.path_pairs(e, p))) == pairs(p), p


def test_functional_relation_has_no_inverse_round_trip(spark):
    e = graph.with_inverse(graph.edges(toy(spark)))
    assert paths.path_pairs(e, ("INVERSE_livesIn", "livesIn")).count() == 0


def test_estimate_equals_groundings(spark):
    e = graph.with_inverse(graph.edges(toy(spark)))
    got = {(r.r1, r.r2): r.groundings for r in paths.estimate(e).collect()}
    want = Counter((a[1], b[1]) for a in both() for b in both() if a[2] == b[0])
    assert got == dict(want)
    assert {(r.r1, r.r2) for r in paths.within_budget(e, 2).collect()} == {k for k, v in want.items() if v <= 2}


def test_instance_stats(spark):
    e = graph.edges(toy(spark))
    got = {(r.r1, r.r2): (r.pairs, r.entity_support) for r in paths.instance_stats(paths.groundings(e, e)).collect()}
    assert got["livesIn", "cityOf"] == (3, 1) and got["knows", "knows"] == (3, 3)


def test_rules_are_symmetric_under_inverse(spark):
    e = graph.edges(toy(spark))
    found = mining.binary_rules(e, 1)
    for r in found.collect():
        assert r.support <= min(r.body_size, r.head_size) and 0 < r.confidence <= 1
    body = paths.instances(paths.groundings(e, e))
    rules = {(r.head, r.body): r for r in mining.path_rules(e, body, 1).collect()}
    assert (rules["nationality", "livesIn·cityOf"].support, rules["nationality", "livesIn·cityOf"].confidence) == (3, 1.0)


def test_zero_and_unary_rules(spark):
    kg = toy(spark)
    e = graph.edges(kg)
    zero = {r.head: r for r in mining.zero_rules(e, 2).collect()}
    assert (zero["nationality(X,z)"].support, zero["nationality(X,z)"].confidence) == (3, 1.0)
    atoms = mining.unary_atoms(e, graph.loops(kg), 1)
    got = {(r.head, r.body): r.support for r in mining.unary_rules(atoms, 2).collect()}
    sets = {}
    for r in atoms.collect():
        sets.setdefault(r.atom, set()).add(r.x)
    for (h, b), s in got.items():
        assert s == len(sets[h] & sets[b]) and "(·)" not in h
    assert got["nationality(z)", "livesIn(x)"] == 2


def test_path_unary_rules_leave_self_proofs_out(spark):
    rows_ = [(f"o{i}", "by", f"c{i % 2}") for i in range(8)] + [("c0", "in", "n"), ("c1", "in", "n")] + [(f"o{i}", "likes", f"c{i % 2}") for i in range(8)]
    e = spark.createDataFrame(rows_, "h string, r string, t string")
    got = {(r.head_relation, r.c): (r.support, r.body_size) for r in mining.path_unary_rules(e, "by", "in", 0).collect()}
    assert got["likes", "c0"] == (0, 4)


def test_minhash_is_complete_and_finds_equal_sets(spark):
    kg = toy(spark)
    atoms = mining.unary_atoms(graph.edges(kg), graph.loops(kg), 2)
    sig = mining.minhash_signatures(atoms, 16)
    assert {r["count"] for r in sig.groupBy("atom").count().collect()} == {16}
    exact = {(r.head, r.body) for r in mining.unary_rules(atoms, 2).where("jaccard = 1").collect()}
    found = {(r.head, r.body): r.collisions for r in mining.lsh_candidates(atoms, 2, 16).collect()}
    assert all(found[k] == 16 for k in exact)


def test_scores(spark):
    e = graph.edges(toy(spark))
    p = scoring.cyclic_predictions(e, ("livesIn", "cityOf"))
    s = scoring.score_predictions(scoring.split_valid(p, e, "nationality")).first()
    assert (s.predicted, s.correct, s.confidence) == (3, 3, 1.0)
    empty = scoring.score_predictions(scoring.split_valid(p.where("false"), e, "nationality")).first()
    assert (empty.predicted, empty.confidence) == (0, 0.0)
    assert scoring.grounding_chain(e, ("next", "next", "next")).count() == 4
    assert scoring.grounding_chain(e, ("next",) * 4).count() == 0  # all nodes must differ
    assert scoring.grounding_chain(e, ("knows", "knows"), branching=1).count() == 0
    assert scoring.suppress_large(p, "t", 3).count() == 0 and scoring.suppress_large(p, "t", 4).count() == 3
    why = {(r.h, r.t): r.nodes for r in scoring.explanations(e, ("livesIn", "cityOf"), p).collect()}
    assert why["a", "z"] == ["a", "x", "z"]


def test_acyclic_scores_equal_one_by_one(spark):
    e = graph.edges(toy(spark)).unionAll(spark.createDataFrame([("z", "livesIn", "x"), ("x", "knows", "y"), ("a", "likes", "x"), ("b", "likes", "y"), ("b", "likes", "x")], "h string, r string, t string"))
    for open_end in (False, True):
        for r in scoring.score_acyclic_all(e, "likes", ("livesIn", "cityOf"), open_end, 1).collect():
            x = scoring.acyclic_x(e, ("livesIn", "cityOf"), None if open_end else r.c2, r.c)
            truth = {t.h for t in e.where(F.col("r") == "likes").where(F.col("t") == r.c).collect()}
            got = {t.x for t in x.collect()}
            assert (r.predicted, r.correct) == (len(got), len(got & truth))


def test_applied_confidence(spark):
    f = scoring.applied_confidence
    row = spark.range(1).select(*[f(F.lit(95), F.lit(50), F.lit(k), F.lit(2)).alias(k) for k in ("C", "AC1", "AC2", "Z")]).first()
    assert (row.C, row.AC1) == (0.5, 0.5) and abs(row.AC2 - 0.05) < 1e-12 and abs(row.Z - 0.005) < 1e-12


def test_chao(spark):
    s = scoring.chao1(spark.createDataFrame([(x,) for x in "aabbcdef"], "v string"), "v").first()
    assert (s.d, s.f1, s.f2, s.estimate) == (6, 4, 2, 10.0)


def test_two_step_rules_and_paths_of_all_relations_in_both_directions(spark):
    rng = random.Random(2)
    rows = {(f"o{i}", "status", f"z{i % 2}") for i in range(12)} | {(f"o{i}", "by", f"c{i % 5}") for i in range(12)} | {(f"c{i}", "seg", f"z{i % 2}") for i in range(5)}
    rows |= {(f"o{rng.randrange(12)}", "part", f"p{rng.randrange(6)}") for _ in range(40)} | {(f"p{rng.randrange(6)}", "like", f"p{rng.randrange(6)}") for _ in range(12)}
    rows = {x for x in rows if x[0] != x[2]}
    steps = rows | {(t, "INVERSE_" + r, h) for h, r, t in rows}
    ground = {(r1, r2, h, m, t) for h, r1, m in steps for m2, r2, t in steps if m == m2 and h != t}
    pairs, want = {}, {}
    for r1, r2, h, _, t in ground:
        pairs.setdefault((r1, r2), set()).add((h, t))
    heads = {r: {(h, t) for h, q, t in rows if q == r} for _, r, _ in rows}
    for (r1, r2), body in pairs.items():
        for r, head in heads.items():
            if len(head & body) >= 2:
                want[r, f"{r1}·{r2}"] = (len(head & body), len(body), len(head))
    e = spark.createDataFrame(sorted(rows), "h string, r string, t string")
    got = {(x.head, x.body): (x.support, x.body_size, x.head_size) for x in mining.two_step_rules(e, 2).collect()}
    assert got == want and any("INVERSE_" in b for _, b in got)
    both = graph.with_inverse(e)
    assert {(x.r1, x.r2): x.pairs for x in paths.pair_counts(both).collect()} == {k: len(v) for k, v in pairs.items()}
    support = {k: min(len({g[i] for g in ground if g[:2] == k}) for i in (2, 3, 4)) for k in pairs}
    assert {(x.r1, x.r2): x.entity_support for x in paths.entity_supports(both).collect()} == support


@pytest.mark.parametrize(("listed", "places"), [(1 << 15, 1 << 20), (7, 1 << 20), (40, 200), (1 << 15, 30)])
def test_ends_of_one_cell_are_counted_once_sorted_marked_or_piece_by_piece(monkeypatch, listed, places):
    monkeypatch.setattr(cells, "LISTED", listed)
    monkeypatch.setattr(cells, "PLACES", places)
    rng = np.random.default_rng(3)
    for dense in (False, True):
        first = sorted({(int(a), int(m)) for a, m in rng.integers(0, 30, (40, 2))} | ({(7, m) for m in range(30)} if dense else set()))
        second = sorted({(int(m), 3 * int(t) + 1) for m, t in rng.integers(0, 30, (900 if dense else 60, 2))})
        lists = lambda rows: (np.array(sorted({a for a, _ in rows})), np.array([sum(a == x for x, _ in rows) for a in sorted({a for a, _ in rows})]), np.array([b for _, b in rows]))
        want = {(a, t) for a, m in first for k, t in second if m == k and a != t}
        assert list(cells._pairs_into(lists(second), [lists(first)], 3, ["x"])) == [("x", len(want))]
        row, size = np.repeat(np.arange(50), 50), np.full(2500, 45)  # many rows, all marked
        assert cells._count(row, size, np.tile(np.arange(50), 50), np.r_[np.zeros(25, int), np.full(25, -1)], np.arange(100) % 60, 60) == 50 * 60 - 25


def test_pairs_of_paths_are_counted_in_cells_of_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 20)
    rng = random.Random(4)
    rows = {(f"o{rng.randrange(12)}", "part", f"p{rng.randrange(6)}") for _ in range(40)} | {(f"p{rng.randrange(6)}", "like", f"p{rng.randrange(6)}") for _ in range(12)}
    rows = {x for x in rows if x[0] != x[2]}
    steps = rows | {(t, "INVERSE_" + r, h) for h, r, t in rows}
    ground = {(r1, r2, h, m, t) for h, r1, m in steps for m2, r2, t in steps if m == m2 and h != t}
    want = Counter((r1, r2) for r1, r2, _, _ in {(r1, r2, h, t) for r1, r2, h, _, t in ground})
    support = {k: min(len({g[i] for g in ground if g[:2] == k}) for i in (2, 3, 4)) for k in want}
    e = spark.createDataFrame(sorted(rows), "h string, r string, t string")
    for both in (graph.with_inverse(e), graph.with_inverse(graph.numbered(e))):
        assert {(x.r1, x.r2): x.pairs for x in cells.distinct_pairs(both, sorted(want)).collect()} == want
        for both_ways in (False, True):
            assert {(x.r1, x.r2): x.pairs for x in paths.pair_counts(both, both_ways=both_ways).collect()} == want
            assert {(x.r1, x.r2): x.entity_support for x in paths.entity_supports(both, both_ways).collect()} == support


def test_minhash_queries_use_the_default_number_of_bins(spark):
    d = "/root/testdata/sf0.001"
    assert {r.bins for r in catalogue.minhash_signature(spark, d).select("bins").distinct().collect()} == {256}
    assert max(r.buckets for r in catalogue.lsh_bucket_stats(spark, d).collect()) > 64


def test_either_way(spark):
    kg = toy(spark)
    asked = spark.createDataFrame([("b", "INVERSE_knows", "a"), ("a", "knows", "b"), ("a", "INVERSE_knows", "b"), ("x", "INVERSE_livesIn", "a")], "h string, r string, t string")
    assert rows(graph.is_true_either_way(asked, kg)) == [("a", "knows", "b"), ("b", "INVERSE_knows", "a"), ("x", "INVERSE_livesIn", "a")]


def test_random_entities_are_drawn_from_the_ends(spark):
    got = graph.random_entities(toy(spark), 30).collect()
    ends = {(r, "head", h) for h, r, _ in TRIPLES} | {(r, "tail", t) for _, r, t in TRIPLES}
    assert len(got) == 30 * len({x[:2] for x in ends}) and {(r.r, r.side, r.entity) for r in got} <= ends


def test_singletons_and_last_groundings(spark):
    e = graph.with_inverse(graph.edges(toy(spark)))
    got = {r.path: (r.ends, r.singleton) for r in scoring.singletons(e, [("livesIn", "cityOf"), ("livesIn",)]).collect()}
    assert got == {"livesIn·cityOf": (1, True), "livesIn": (2, False)}
    assert [r.ends for r in scoring.last_groundings(e, ("livesIn",), None, 2).collect()] == [2] and scoring.last_groundings(e, ("livesIn",), None, 3).count() == 0
    assert [r.ends for r in scoring.last_groundings(e, ("livesIn", "cityOf"), "z", 1).collect()] == [2]


def test_prediction_without_the_triple_itself(spark):
    e = graph.with_inverse(graph.edges(toy(spark)))
    # knows(X,c) <= knows(X,A): a triple doesn't prove itself
    assert rows(scoring.predicted_without(e, ("knows",), None, "knows", "b")) == []
    assert rows(scoring.predicted_without(e, ("livesIn",), "x", "nationality", "z")) == [("a",), ("b",)]
    assert rows(scoring.predicted_without(e, ("INVERSE_knows",), None, "knows", "b")) == [("a",)]


def test_explanations_are_restricted_at_both_ends(spark):
    e = graph.with_inverse(graph.edges(toy(spark)))
    asked = spark.createDataFrame([("a", "z"), ("c", "z")], "h string, t string")
    got = scoring.explanations(e, ("knows", "livesIn", "cityOf"), asked)
    assert {r.h: r.nodes for r in got.collect()} == {"a": ["a", "b", "x", "z"], "c": ["c", "a", "x", "z"]}


def test_rules_to_show(spark):
    made = [(f"h{i}", f"b{i}", f"L{1 + i % 3}", "binary", 1 - i / 100, 5) for i in range(30)] + [(f"u{i}", "b", "L1", "unary", 0.5, i) for i in range(15)]
    df = spark.createDataFrame(made, "head string, body string, level string, arity string, confidence double, support int")
    got = merging.sample_rules(df).collect()
    levels = Counter(r.level for r in got if r.arity == "binary")
    assert len([r for r in got if r.arity == "unary"]) == 10 and sum(levels.values()) == 10 and levels["L1"] >= 3 and levels["L2"] >= 3
    assert {(r.level, r.arity): r.rules for r in merging.level_counts(df).collect()}["L1", "unary"] == 15


def test_path_supports_in_pieces_equal_listed_paths(spark, monkeypatch):
    """Sets of tails, made in pieces, and paths followed from the heads' triples give what listing all groundings gives."""
    steps = graph.with_inverse(graph.edges(toy(spark))).cache()
    heads = graph.edges(toy(spark))
    rows = paths.groundings(steps, steps).select("r1", "r2", "h", "t").distinct().cache()
    want = {(r.r1, r.r2): r["count"] for r in rows.groupBy("r1", "r2").count().collect()}
    closed = {(r.head, r.r1, r.r2): r["count"] for r in rows.join(heads.withColumnRenamed("r", "head"), ["h", "t"]).groupBy("head", "r1", "r2").count().collect()}
    monkeypatch.setattr(paths, "PIECE", 7)
    pairs, supports = paths.path_supports(heads, steps)
    assert {(r.r1, r.r2): r.pairs for r in pairs.collect()} == want and len(want) > 10
    assert {(r.head, r.r1, r.r2): r.support for r in supports.collect()} == closed and len(closed) > 5


def test_rules_of_one_step_equal_joined_relations_for_many_relations_and_ranges(spark):
    rnd = random.Random(5)
    ends = [("a", "a"), ("a", "b"), ("b", "a"), ("c", "d"), ("e", "f")]
    # 40 relations need two words of bits; those of c and d meet each other only, the one of e and f none
    rows = {(f"{x}{rnd.randrange(5)}", f"r{i}", f"{y}{rnd.randrange(5)}") for i in range(40) for x, y in [ends[4] if i == 39 else rnd.choice(ends[:4])] for _ in range(9)}
    e = graph.edges(spark.createDataFrame(sorted(rows), "h string, r string, t string"))
    want = {(x.head, x.body, x.support) for x in mining.binary_rules(e, 3).collect()}
    got = {tuple(x) for x in mining.shared_pairs(e, 3).select("head", "body", "support").collect()}
    assert len(want) > 50 and any(b.startswith("INVERSE_") for _, b, _ in want) and got == want


def test_mining_writes_no_table_of_all_steps(spark, monkeypatch):
    sizes = []

    def recorded(df, name, *more):
        out = kept(df, name, *more)
        sizes.append(out.count())
        return out

    kept = paths.written
    monkeypatch.setattr(paths, "written", recorded)
    monkeypatch.setattr(mining, "written", recorded)
    e = spark.createDataFrame([(f"a{i}", r, f"b{i % 50}") for i in range(400) for r in ("r", "s")] + [("b0", "u", "c0")], "h string, r string, t string")
    got = {(x.head, x.body, x.support) for x in mining.mine(e, Config(min_supp=1, min_entity_supp=1), 8).collect()}
    assert {("r", "s", 400), ("s", "r", 400)} <= got and max(sizes) < e.count() / 2


def test_rules_of_two_and_three_steps_are_found_whatever_their_joins_are(spark, monkeypatch):
    """A graph of hubs, loops of steps and nodes met twice, in blocks of last nodes, against all bindings; no join is left out for its size."""
    rng = random.Random(5)
    kinds = {"ab": ("a", "b"), "bc": ("b", "c"), "ac": ("a", "c"), "aa": ("a", "a"), "ca": ("c", "a"), "bb": ("b", "b")}
    rows = {(f"{x}{rng.randrange(90)}", r, f"{y}{rng.choice((0, 1, rng.randrange(90)))}") for r, (x, y) in kinds.items() for _ in range(150)}
    rows = {x for x in rows if x[0] != x[2]}
    monkeypatch.setattr(threesteps, "TABLE", 900)
    monkeypatch.setattr(threesteps, "JOINED", 200)
    e = spark.createDataFrame(sorted(rows), "h string, r string, t string")
    steps = {}
    for h, r, t in rows:
        steps.setdefault(r, set()).add((h, t))
        steps.setdefault("INVERSE_" + r, set()).add((t, h))
    out = {r: {} for r in steps}
    for r, pairs in steps.items():
        for h, t in pairs:
            out[r].setdefault(h, set()).add(t)
    join = lambda left, right: {(h, t) for h, m in left for t in right.get(m, ()) if h != t}
    two = {(x, y): join(steps[x], out[y]) for x in steps for y in steps}
    ends = {k: {} for k in two}
    for k, pairs in two.items():
        for h, t in pairs:
            ends[k].setdefault(h, set()).add(t)
    want = {}
    for (x, y), pairs in two.items():
        for head in kinds:
            if len(pairs & steps[head]) >= 10:
                want[head, None, x, y] = len(pairs & steps[head]), len(pairs)
        for z in steps:
            body = join(pairs, out[z]) & join(steps[x], ends[y, z])
            for head in kinds:
                n = len(body & steps[head])
                if n >= 10:
                    want[head, x, y, z] = n, len(body)
    got = {(r.head, r.r1, r.r2, r.r3): (r.support, r.body_size) for r in threesteps.three_step_supports(e, 10).collect()}
    assert got == want and len(want) > 50 and any(k[1] is None for k in want)
    mined = {r.body for r in mining.mine_all(e, 10).collect()}
    assert {"·".join(x for x in k[1:] if x) for k in want} <= mined
