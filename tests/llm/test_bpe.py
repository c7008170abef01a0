import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hornweave.llm import bpe
from tokenizers import Tokenizer

from .helpers import documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("lexicon_words", [0, 50_000])
def test_equals_the_library(spark, reference, lexicon_words):
    rows = [(i, t) for i, t, *_ in documents()]
    docs = frame(spark, rows, "doc_id long, text string")
    codec = bpe.prepare(docs, PATH, lexicon_words=lexicon_words)
    apart = bpe.decode(bpe.encode(docs, codec), codec).select("doc_id", "ids", "decoded")
    together = bpe.round_trip(docs, codec)
    assert sorted(map(str, apart.collect())) == sorted(map(str, together.collect()))
    got = bpe.digest(together).collect()
    want = []
    for i, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_merging_equals_the_library_on_odd_words(reference):
    v = bpe.Vocabulary(PATH)
    rng = random.Random(1)
    words = ["".join(rng.choice("aethnrü ☃") for _ in range(rng.randint(1, 90))).replace(" ", "s") for _ in range(300)]
    split = [w.encode() for t in words for w in bpe.SPLIT.findall(t)]
    ids, sizes = v.merge_many(split)
    assert ids.tolist() == [i for t in words for i in reference.encode(t, add_special_tokens=False).ids]
    assert sizes.sum() == len(ids) and len(sizes) == len(split)


def test_long_and_short_merging_agree():
    v = bpe.Vocabulary(PATH)
    word = b"internationalisation" * 2
    assert v.merge_many([word])[0].tolist() == v._merge_long(word)


def test_automaton_is_minimal_and_exact(tmp_path):
    words = sorted({a + b for a in (b"re", b"un", b"", b"over") for b in (b"act", b"acts", b"play", b"plays", b"x")})
    path = str(tmp_path / "lexicon")
    with open(path, "wb") as f:
        f.write(bpe.lexicon_file(words, np.arange(2 * len(words)), np.full(len(words), 2)))
    lexicon = bpe.Lexicon(path)
    assert lexicon.ranks([*words, b"reac", b"xx", b"", b"zzz", b"acts" * 40]).tolist() == [*range(len(words)), -1, -1, -1, -1, -1]
    assert lexicon.start[3] == 6 and lexicon.size[3] == 2
    trie = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(lexicon.first) - 1 < len(trie) / 2  # suffixes are shared


def test_clashing_columns_are_replaced(spark):
    docs = frame(spark, [(1, "a b", "x", "y", 3)], "doc_id long, text string, IDS string, decoded string, other int")
    codec = bpe.prepare(docs, PATH)
    assert bpe.round_trip(docs, codec).columns == ["doc_id", "other", "ids", "decoded"]
    out = bpe.decode(bpe.encode(docs, codec), codec).first()
    assert (out.text, out.decoded, out.other) == ("a b", "a b", 3)


def test_empty_table(spark):
    docs = frame(spark, [], "doc_id long, text string")
    codec = bpe.prepare(docs, PATH)
    assert bpe.decode(bpe.encode(docs, codec), codec).count() == 0
