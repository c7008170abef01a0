import random

from hornweave.llm import linededup
from pyspark.sql import functions as F

from .helpers import frame

SCHEMA = "doc_id long, text string"


def brute(rows):
    first, keyed = {}, []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        wins = [(p, tuple(lines[p : p + 3])) for p in range(len(lines) - 2) if "".join(lines[p : p + 3]).strip(" ")]
        keyed.append((i, t, lines, wins))
        for p, w in wins:
            place = (i is None, i or 0, p)
            first[w] = min(first.get(w, place), place)
    out = []
    for i, t, lines, wins in keyed:
        gone = set()
        for p, w in wins:
            f = first[w]
            if (i is None, i or 0, p) > f:
                start = f[2] + 3 if f[:2] == (i is None, i or 0) and p < f[2] + 3 else p
                gone |= set(range(start, p + 3))
        out.append((i, len(lines), len(gone), t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=str)


def check(spark, rows):
    got = linededup.dedup_lines(frame(spark, rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got), key=str) == brute(rows)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n\n\n"), (53, "x\nx\nx\nx\nx\nx\nx"), (54, "q\nr\ns\nt\nq\nr\ns"), (55, "1\nq\nr\ns\n2"), (None, "9\nq\nr\ns\n8")]
    rows += [(60, "u\nv\nw"), (60, "u\nv\nw"), (61, "u\nv\nw"), (62, "a\n\n\nb"), (63, "a\n\n\nb"), (60, "other\ntext\nhere\nu\nv\nw")]
    check(spark, rows)


def test_hot_window_and_long_text(spark):
    hot = "one common line\nanother common line\na third"
    rows = [(i, f"own {i}\n{hot}\nend {i}") for i in range(300)] + [(1000, "\n".join(f"line {k % 5000}" for k in range(12_000)))]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert linededup.dedup_lines(frame(spark, [], SCHEMA)).count() == 0
    out = linededup.dedup_lines(frame(spark, [(1, "a\nb\nc")], SCHEMA).withColumn("n_lines", F.lit("mine")).withColumn("h1", F.lit(2)).withColumn("pos", F.lit(3)))
    assert out.columns == ["doc_id", "text", "h1", "pos", "n_lines", "n_removed"] and out.first().n_lines == 3
