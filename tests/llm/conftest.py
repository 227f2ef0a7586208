import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that stages and operators use for their results or within.
CLASHING = ("n_words", "n_hit", "items", "hits", "size", "target", "copies", "taken", "score", "lang_pred", "n_tokens", "ids", "rid", "rare", "known", "kept", "component_id", "__text", "labels", "start")


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and very long texts, ties, repeats and odd white space."""
    rng = random.Random(7)
    vocabulary = ["the", "of", "And", "there", "straße", "über", "né", "ñandú", "river.", "Tree,", "42", "x", "日本", "a\tb", "don't"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), len(t)) for i, t in enumerate(base)]
    long = " ".join(rng.choice(vocabulary) + str(i % 97) for i in range(40_000))
    out += [(100, None, "en", "s1", None), (101, "", "en", "s2", 0), (102, " \n\t ", None, None, 4), (103, long, "de", "s1", len(long)), (104, long, "de", "s2", len(long)), (105, "...!!! 123 ---", "en", "s1", 14)]
    out += [(106, base[0], "en", "s1", 1), (106, base[0], "en", "s1", 1), (None, base[1], "en", "s1", None), (None, "alone " * 9, "en", "s1", None), (107, "\x00odd\x1cbytes <|endoftext|> here\x85", "en", "s2", 3)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
