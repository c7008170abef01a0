import math
from collections import Counter

import pytest
from hornweave.llm import langid
from hornweave.llm.common import remainder
from pyspark.sql import functions as F

from .helpers import documents, frame, rest


def run(spark, rows):
    docs = frame(spark, rows)
    model = langid.fit(docs, "text", "lang", remainder("doc_id", 5) != 0)
    return langid.identify(docs, model).collect()


def test_predicts_language_and_edge_cases(spark):
    got = run(spark, documents())
    assert len(got) == len(documents())
    plain = [r for r in got if r.doc_id is not None and r.doc_id < 60]
    assert all(r.lang_pred == r.lang for r in plain) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    for i in (100, 101, 102):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[104].lang_pred == by_id[103 + 1].lang_pred == "en"
    assert by_id[None].lang_pred == "en"
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    docs = frame(spark, documents()[:9]).withColumn("SCORE", F.lit("mine")).withColumn("extra", F.lit(1))
    out = langid.identify(docs, langid.fit(docs, "text", "lang", F.lit(True)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "lang_pred", "score"]
    assert out.count() == 9


def test_without_training_rows(spark):
    docs = frame(spark, documents()[:5])
    out = langid.identify(docs, langid.fit(docs, "text", "lang", F.lit(False))).collect()
    assert {r.lang_pred for r in out} == {"und"}


def grams(text, p):
    """Buckets of the n-grams of a text, by the definition, in integers."""
    clean, mask = [], (1 << 64) - 1
    for c in (text or "").replace("\x00", " ").lower():
        if c.isalpha():
            clean.append(ord(c))
        elif not clean or clean[-1] != 32:
            clean.append(32)
    out = []
    for n in p.orders:
        for i in range(len(clean) - n + 1):
            if n == 1 and clean[i] == 32:
                continue
            h = n
            for code in clean[i : i + n]:
                h = ((h ^ code) * 0x9E3779B97F4A7C15) & mask
                h ^= h >> 29
            out.append((h * 0xBF58476D1CE4E5B9 & mask) >> (64 - p.bits))
    return out


def test_equals_brute_force(spark):
    rows = [r for r in documents() if len(r[1] or "") < 5000] + [(200 + k, t, lang, "s", 1) for k, (t, lang) in enumerate([("été là-bas", "fr"), ("l'été", "fr"), ("ДА нет", "ru"), ("  a  ", None), ("ΣΑΣ", "el"), ("日本 語", "ja")])]
    p = langid.LangIdParams()
    train = [(t, x) for i, t, x, *_ in rows if i is not None and rest(i, 5) != 0 and x is not None and t is not None]
    langs = sorted({x for _, x in train})
    counts = {x: Counter() for x in langs}
    for t, x in train:
        counts[x].update(grams(t, p))
    total = {x: sum(c.values()) + p.alpha * (1 << p.bits) for x, c in counts.items()}
    prior = Counter(x for _, x in train)

    def predict(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        logit = {x: math.log(prior[x] / len(train)) + sum(math.log((counts[x][g] + p.alpha) / total[x]) for g in grams(text, p)) for x in langs}
        best = min(langs, key=lambda x: (-round(logit[x], 9), x))
        return best, 1 / sum(math.exp(v - logit[best]) for v in logit.values())

    got = run(spark, rows)
    assert len(langs) > 4 and sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in got) == sorted((str(r[0]), predict(r[1])[0], round(predict(r[1])[1], 6)) for r in rows)


def test_too_many_languages_are_refused(spark):
    docs = frame(spark, [(i, "some text", f"x{i}", "s", 1) for i in range(5)])
    with pytest.raises(ValueError, match="more than 4 languages"):
        langid.fit(docs, "text", "lang", F.lit(True), langid.LangIdParams(max_langs=4))


def test_ngrams_stay_inside_a_text():
    p = langid.LangIdParams()
    alone = [sorted(langid.ngram_features([t], p)[1].tolist()) for t in ("abc", "", "de f")]
    rows, buckets, letters = langid.ngram_features(["abc", "", "de f"], p)
    for k in range(3):
        assert sorted(buckets[rows == k].tolist()) == alone[k]
    assert letters.tolist() == [3, 0, 3]
