"""Small tables with the awkward cases every operator must define."""

import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = {
    "en": "the of and to in that it is was for on with as he at by from this be are".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
}


def sentence(lang, seed, n):
    words = WORDS[lang]
    return " ".join(words[(seed * 7 + k * (seed % 5 + 1) + k * k) % len(words)] for k in range(n))


def documents():
    rows = [(i, sentence("en" if i % 3 else "de", i, 20 + i % 7), "en" if i % 3 else "de", "src0", 1) for i in range(60)]
    rows += [
        (100, None, None, None, None), (101, "", "en", "src1", 0), (102, "12 34 !?", "en", "src1", 8), (103, "x", None, "src1", 1),
        (104, "the of and " * 9000, "en", "src1", 1), (None, "the of and in that", "en", "src2", 3),
        (105, "a<|endoftext|>b  c\n\n\tüñ 漢字 🙂 don't x\x00y", "en", "src2", 3), (1, rows[1][1], "en", "src0", 1), (1, rows[1][1], "en", "src0", 1),
    ]
    return rows


def rest(doc_id, m):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)
