import os

import pytest
from hornweave import config, storage
from hornweave.functions import relations as fn
from hornweave.operators import walking
from hornweave.sources import results, rules, sinks, triples
from hornweave.streaming import incremental
from pyspark.sql import functions as F

from .toy import TRIPLES, toy


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_read_triples(spark, tmp_path):
    p = put(tmp_path / "t.txt", "a\tr\tb\n\nx y z\na\tr\tb\t.\nq\tr\tu\tv\nh\tr\tlong\tname\there\n#\na\tb\n")
    assert rows(triples.read_triples(spark, p)) == [("a", "r", "b"), ("a", "r", "b"), ("h", "r", "long"), ("q", "r", "u"), ("x", "y", "z")]
    assert rows(triples.read_triples(spark, p, ignore4plus=False)) == [("a", "r", "b"), ("a", "r", "b"), ("h", "r", "long_name_here"), ("x", "y", "z")]
    assert rows(triples.read_dataset(spark, p)) == [("a", "r", "b")]
    put(tmp_path / "train.txt", "a\tr\tb\na b\nc  r d\n1\t2\t3\t4\n")
    assert rows(triples.read_split(spark, str(tmp_path))) == [("a", "r", "b"), ("c", "r", "d")]


def test_parse_rules(spark):
    text = [
        "100\t50\t0.5\tr(X,Y) <= a(X,A), b(A,Y)", "9\t8\t0.9\tr(X,c) <= p(X,d)", "9\t8\t0.9\tr(X,c,d) <= p(X,A)", "200\t150\t0.75\tr(X,c) <= ",
        "# comment", "", "broken line", "5\t1\t0.2\tr(X,Y) <= a(Y,X)",
    ]
    lines = spark.createDataFrame([(x,) for x in text], "value string")
    got = {r.rule: r for r in rules.parse_rules(lines).collect()}
    assert {k: (v.rule_type, v.body_size) for k, v in got.items()} == {
        "r(X,Y) <= a(X,A), b(A,Y)": ("C", 2), "r(X,c) <= p(X,d)": ("AC1", 1), "r(X,c,d) <= p(X,A)": ("AC2", 1), "r(X,c) <=": ("Z", 0), "r(X,Y) <= a(Y,X)": ("C", 1),
    }
    assert got["r(X,c,d) <= p(X,A)"].head.asDict() == {"r": "r", "a": "X", "b": "c,d"}
    parsed = rules.parse_rules(lines)
    assert rules.refinable(parsed).count() == 2 and rules.with_target(parsed, "r").count() == 5 and rules.prefilter(parsed, 50, 0.6).count() == 1


def test_read_rules_thresholds(spark, tmp_path):
    p = put(tmp_path / "rules", "100\t50\t0.5\tr(X,Y) <= a(X,Y)\n100\t1\t0.01\tr(X,Y) <= b(X,Y)\n9\t8\t0.9\tr(X,c) <= p(X,d)\n")
    assert rules.read_rules(spark, p).count() == 2
    assert rules.read_rules(spark, p, kinds=("C",)).count() == 1


def test_atom_splits_at_the_last_comma_unless_a_variable_leads(spark):
    got = spark.createDataFrame([("r(X,a,b),",), ("r(a,b,X)",), ("r(X,Y)",)], "v string").select(rules.parse_atom(F.col("v")).alias("x")).select("x.*")
    assert rows(got) == [("r", "X", "Y"), ("r", "X", "a,b"), ("r", "a,b", "X")]


def test_predictions_round_trip(spark, tmp_path):
    ranked = spark.createDataFrame([("h", "r", "t", "tail", "c1", 0.5, 1), ("h", "r", "t", "tail", "c2", 0.25, 2), ("h", "r", "t", "head", "d", 0.125, 1), ("h", "r", "u", "tail", "z", 0.5, 1)], "h string, r string, t string, direction string, candidate string, score double, rank int")
    text = sinks.prediction_records(ranked)
    put(tmp_path / "p.txt", "\n".join(r.value for r in text.collect()) + "\nx r y\nTails: k\t0.5\nHeads: \n")
    back = results.read_predictions(spark, str(tmp_path / "p.txt"))
    assert rows(back) == rows(ranked.select("h", "r", "t", "direction", "candidate", "score", "rank").unionAll(spark.createDataFrame([("x", "r", "y", "tail", "k", 0.5, 1)], ranked.schema)))
    assert results.read_predictions(spark, str(tmp_path / "p.txt"), k=1).count() == 4 and results.read_predictions(spark, str(tmp_path / "p.txt"), min_score=0.3).count() == 3


def test_rule_and_metric_files(spark, tmp_path):
    r = spark.createDataFrame([("h1", "b1", 5, 10, 8, 0.5, 0.25), ("h1", "b2", 9, 10, 8, 0.9, 0.5), ("h2", "b1", 1, 2, 3, 0.1, 0.2)], "head string, body string, support int, body_size int, head_size int, confidence double, jaccard double")
    sinks.write_rules(r, str(tmp_path / "rules"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "rules")).collect()) == ["10\t5\t0.5\th1 <= b1", "10\t9\t0.9\th1 <= b2", "2\t1\t0.1\th2 <= b1"]
    sinks.write_json(r, str(tmp_path / "json"))
    import glob

    parts = []
    for i, line in enumerate(x.value for x in spark.read.text(str(tmp_path / "json")).collect()):
        parts.append(put(tmp_path / f"part_{i}.json", line))
    back = rules.read_metrics(spark, parts)
    assert rows(back.select("head", "body", "confidence")) == [("h1", "b1", 0.5), ("h1", "b2", 0.9), ("h2", "b1", 0.1)]
    assert glob.glob(str(tmp_path / "json" / "part-*"))


def test_other_sinks(spark, tmp_path):
    kg = toy(spark).distinct()
    sinks.write_triples(kg, str(tmp_path / "t"))
    assert rows(spark.read.option("sep", "\t").csv(str(tmp_path / "t"))) == sorted(set(TRIPLES))
    sinks.write_partitions(kg.withColumn("part_id", F.length("r")), str(tmp_path / "p"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "p")).count() == len(set(TRIPLES))


def test_json_names_are_escaped(spark, tmp_path):
    import json

    r = spark.createDataFrame([('h"\\\\', "b\\n", 5, 10, 8, 0.5, 0.25)], "head string, body string, support int, body_size int, head_size int, confidence double, jaccard double")
    sinks.write_json(r, str(tmp_path / "json"))
    (line,) = [x.value for x in spark.read.text(str(tmp_path / "json")).collect()]
    assert json.loads(line) == {'h"\\\\': {"b\\n": {"jaccard": 0.25, "support": 5, "headSize": 8, "bodySize": 10, "confidence": 0.5}}}


def test_traces_tables_and_pictures(spark, tmp_path):
    dice = walking.Dice(["a", "b"])
    dice.add("a", 2.0)
    dice.record(1)
    dice.add("a", 4.0)
    dice.record(2)
    assert sinks.trace_lines(dice.kinds, dice.trace) == ["1\t2.0\t0.0\t1\t0", "2\t3.0\t0.0\t2\t0"]
    table = spark.createDataFrame([("x<", "p", 1.0), ("x<", "q", 2.0), ("y", "p", None)], "a string, b string, n double")
    sinks.write_table(table, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["a", "b", "n"]
    picture = sinks.heatmap_svg(table, "a", "b", "n")
    assert picture.count("<rect") == 3 and "x&lt;" in picture and 'fill-opacity="1.000"' in picture
    explained = spark.createDataFrame([("h", "t", ["h", "m", "t"], 2)], "h string, t string, nodes array<string>, groundings long")
    assert rows(sinks.explanation_lines(explained)) == [("h\tt\t2\th m t",)]


def test_logs(spark):
    lines = spark.createDataFrame([("INFO MRR: 0.25, hits@1: 0.125 hits@10 = 0.5",), ("Total rules: 499,023",)], "value string")
    assert rows(rules.scrape_log(lines)) == [("MRR", 0.25), ("Total rules", 499023.0), ("hits@1", 0.125), ("hits@10", 0.5)]


def test_config():
    c = config.load("DATASET: wn\nMIN_SUPP: 20\nUNKNOWN: 1\n# x\nPATH_TEST: 'd/{DATASET}.txt'", {"MIN_SUPP": "30", "AGGREGATION_TYPE": "noisyor"})
    assert (c.min_supp, c.path_test, c.path_training, c.aggregation_id) == (30, "d/wn.txt", "data/wn/train.txt", 3)
    assert config.expand_runs("rules-|10,50|.txt") == ["rules-10.txt", "rules-50.txt"] and config.expand_runs("plain") == ["plain"]


def test_relation_functions(spark):
    p = spark.createDataFrame([(["a", "INVERSE_b", "c"],)], "p array<string>")
    row = p.select(
        fn.path_string(fn.path_inverse(F.col("p"))).alias("inv"), fn.atom_string(F.col("p"), F.lit("k")).alias("text"), fn.atom_string(F.col("p"), F.lit("·")).alias("open"),
        fn.has_inverse_step(F.array(F.lit("a"), F.lit("INVERSE_a"))).alias("back"), fn.has_inverse_step(F.col("p")).alias("no"), fn.path_length(F.lit("a·b·c")).alias("n"),
        fn.unpack_path(fn.pack_path(F.array(F.lit(5), F.lit(32767), F.lit(1)))).alias("ids"), fn.beautify(F.lit("r <= a·b ·c")).alias("pretty"), fn.rule_level(F.lit("")).alias("none"), fn.rule_level(F.lit("a·b(c)")).alias("two"),
    ).first()
    assert row.inv == "INVERSE_c·b·INVERSE_a" and row.text == "a(X,A), b(B,A), c(B,k)" and row.open.endswith("c(B,C)")
    assert (row.back, row.no, row.n, row.ids, row.pretty, row.none, row.two) == (True, False, 3, [5, 32767, 1], "r <= a · b · c", "L0", "L2")


def test_generalisations(spark):
    paths = [(["a", "b", "c"], ["r", "s"]), (["a", "b", "c", "a"], ["r", "INVERSE_s", "t"]), (["q", "p", "c"], ["INVERSE_u", "s"]), (["b", "a", "b"], ["INVERSE_v", "w"]), (["a", "b"], ["z"]), (["a", "a", "b"], ["r", "s"])]
    got = {(r.rule_type, r.rule) for r in walking.generalisations(spark.createDataFrame(paths, "nodes array<string>, rels array<string>")).collect()}
    assert got == {
        ("AC1", "r(a,Y) <= s(Y,c)"), ("AC2", "r(a,Y) <= s(Y,A)"), ("Z", "r(a,Y) <= "),
        ("C", "r(X,Y) <= t(A,X), s(A,Y)"), ("AC1", "r(X,b) <= t(A,X), s(A,b)"), ("AC1", "r(a,Y) <= s(A,Y), t(A,a)"),
        ("AC1", "u(X,q) <= s(X,c)"), ("AC2", "u(X,q) <= s(X,A)"), ("Z", "u(X,q) <= "),
        ("C", "v(X,Y) <= w(X,Y)"), ("AC1", "v(a,Y) <= w(a,Y)"), ("AC1", "v(X,b) <= w(X,b)"),
        ("Z", "z(a,Y) <= "), ("Z", "z(X,b) <= "),
    }


def test_gain_kinds(spark):
    one = spark.createDataFrame([("C", 10, 0.5, 0.4, 3)], "rule_type string, correct int, confidence double, applied double, body_size int")
    assert [walking.reward(one, k).first().gain for k in range(1, 6)] == [10.0, 5.0, 4.0, 1.6, 1.0]


def test_ablations(spark):
    rows = [("C", 1), ("C", 2), ("AC1", 1), ("AC2", 2), ("Z", 0)]
    df = spark.createDataFrame(rows, "rule_type string, body_size int")
    of = lambda name: sorted(map(tuple, rules.ablation(df, name).collect()))
    assert of("ALL") == sorted(rows) and of("C-2") == [("C", 2)] and of("N-AC1-1") == sorted(set(rows) - {("AC1", 1)})
    for bad in ("C-9", "N-ALL", ""):
        with pytest.raises(ValueError):
            rules.ablation(df, bad)


def test_metric_files_of_several_runs(spark, tmp_path):
    one = spark.createDataFrame([("h", "b", 3, 4, 5, 0.25, 0.6, 2)], "head string, body string, support int, head_size long, body_size long, jaccard double, confidence double, size long")
    sinks.write_json(one, str(tmp_path / "x"))
    sinks.write_json(one.withColumn("head", F.lit("r(c)")).drop("size"), str(tmp_path / "y"))
    got = {r.head: r for r in rules.by_arity(rules.read_metrics(spark, [f"{tmp_path}/x+y"])).collect()}
    assert (got["h"].size, got["h"].arity, got["r(c)"].size, got["r(c)"].arity) == (2, "binary", None, "unary")
    m = spark.createDataFrame([("s", 3)], "strategy string, parts int")
    sinks.write_partition_metrics(m, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().parts == 3
    w = spark.createDataFrame([("a", "r", "b", "tail", "c", 0.5), ("a", "r", "b", "head", "d", 0.25)], "h string, r string, t string, direction string, candidate string, score double")
    assert rows(sinks.weighted_triples(w)) == [("a", "r", "c", 0.5), ("d", "r", "b", 0.25)]


def test_storage(spark, tmp_path):
    one = storage.written(spark.range(5), "one")
    assert one.count() == 5 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    files = one.inputFiles()
    storage.discard(one)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    path = storage.put_file(spark, "some-bytes", b"abc")
    with open(path, "rb") as f:
        assert f.read() == b"abc"


def test_sampled_paths_are_walks(spark):
    e = toy(spark).where("h <> t").distinct()
    for cyclic in (False, True):
        for r in walking.sample_paths(e, 3, cyclic, 5).collect():
            assert len(r.nodes) == 4 and (r.nodes[0] == r.nodes[3]) == cyclic and len(set(r.nodes)) == 4 - cyclic


def test_dice_prefers_what_paid():
    dice = walking.Dice(["C", "Z"], greedy=True, epsilon=0.0)
    dice.add("C", 1.0)
    dice.add("Z", 5.0)
    assert {dice.ask(9) for _ in range(20)} == {"Z"} and {dice.ask(0) for _ in range(40)} == {"C", "Z"}
    assert set(walking.Dice(["C", "Z"], epsilon=1.0).ask(99) for _ in range(3)) <= {"C", "Z"}


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.tsv", "a\tr\tb\na\tr\ta\n")
    put(folder / "b.tsv", "c\tr\td\nc\ts\td\n")
    incremental.to_memory(incremental.relation_counts(incremental.triple_stream(spark, str(folder))), "counts", str(tmp_path / "cp")).awaitTermination(60)
    assert rows(spark.table("counts")) == [("r", 2, 1), ("s", 1, 0)]
    rules_in = tmp_path / "rules"
    rules_in.mkdir()
    line = '{"head":"h","body":"b","support":%d,"head_size":5,"body_size":10,"jaccard":0.5}'
    put(rules_in / "a.json", line % 4 + "\n" + line % 6 + "\n")
    incremental.to_memory(incremental.merged_metrics(incremental.rule_stream(spark, str(rules_in))), "merged", str(tmp_path / "cp2")).awaitTermination(60)
    m = spark.table("merged").first()
    assert (m.support, m.body_size, m.size, m.confidence) == (10, 20, 2, 0.5)
