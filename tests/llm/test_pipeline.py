import hashlib
import os

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from .helpers import frame, sentence
from .test_decontam import brute as contamination
from .test_linededup import brute as deduped_lines
from .test_neardup import brute as components


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def write(spark, folder, docs, items):
    frame(spark, docs).coalesce(2).write.parquet(os.path.join(folder, "documents.parquet"))
    frame(spark, items, "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))


def test_equals_brute_force(spark, tmp_path):
    shared = "common line one\ncommon line two of it\nand the third of them"
    item = "secret benchmark words " + sentence("de", 3, 25)
    rows = [(i, "\n".join(sentence("en" if i % 3 else "de", i * 5 + k, 12) + f" {i} {k}" for k in range(4)), "en" if i % 3 else "de", "s", 9) for i in range(40)]
    rows += [(100, None, None, "s", None), (101, "!!! 123", "en", "s", 7), (102, rows[4][1], "en", "s", 9), (103, shared + "\nits own end of the text", "en", "s", 9), (104, "before\n" + shared, "en", "s", 9)]
    near = "the quick and the slow of that for it was in an old " * 4
    rows += [(105, near + "x", "en", "s", 9), (106, near + "y", "en", "s", 9), (107, "and for it " + item, "de", "s", 9), (108, shared, "en", "s", 9)]
    write(spark, str(tmp_path), rows, [(7, item), (8, None)])
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    docs = [(i, t) for i, _, gone, t in deduped_lines(docs) if not gone or t.strip()]
    docs = [(i, t) for (i, t), (_, _, c) in zip(docs, components(docs), strict=True) if i == c]
    docs = [(i, t) for i, t in docs if not contamination(t, [(7, item)])[4]]
    assert set(out) == {i for i, _ in docs}
    assert not {100, 101, 102, 106, 107, 108} & set(out) and {103, 104, 105} <= set(out)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert out[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_stages_keep_clashing_columns(spark, tmp_path):
    item = "secret benchmark words " + sentence("de", 3, 25)
    write(spark, str(tmp_path), [], [(7, item)])
    names = ["n_lines", "n_removed", "N_WORDS", "n_hit", "hit_spans", "lang_pred", "score", "__lang", "__id", "__key", "component_id", "kept", "__k1"]
    rows = [(i, sentence("en" if i % 2 else "de", i, 30) + f"\nline {i}\nend {i}", "en" if i % 2 else "de", *[f"{n} {i}" for n in names]) for i in range(12)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, rows)), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 12


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
