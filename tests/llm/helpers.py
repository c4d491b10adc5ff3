"""Small tables with the awkward rows that every operator has to take."""

import re

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def odd_documents(spark, texts=()):
    """Null ids, null, empty, blank and very long texts, repeated rows, and columns that clash with the operators' own."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(200_000))
    rows = [(None, "a null id", None, None), (1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n ", None, "s"), (4, long, "en", None), (4, long, "en", None), (5, "ΑΒΓ é x 😀", "fr", "s")]
    rows += [(10 + i, t, "en", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame([(*r, 7, "clash", 1.5) for r in rows], "doc_id long, text string, lang string, source string, fp int, key string, part double")


def empty(df):
    return df.where("false")
