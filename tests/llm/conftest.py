import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; documents may have columns of these names too.
CLASHES = ["size", "place", "shard", "slot", "bucket", "key", "fp", "id", "host", "blob", "spans", "k1", "k2", "kept", "lang_pred", "component_id", "taken", "bytes", "doc", "chunk", "count", "l", "n", "known", "below", "held_out", "score", "__plan", "__place", "__copy", "__hot", "__salt", "__cold", "__side", "row", "rows", "copies", "gone", "text_key", "path", "digest", "total", "s", "w", "cap", "level", "nth", "left", "threshold", "times", "d", "repeats", "windows", "line", "removed_words", "cut", "deal", "own", "u", "v", "node", "component", "least", "shingles", "position", "__p", "__n"]


def words(text):
    return WORD.findall(text or "")


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, odd characters."""
    long = " ".join(f"wort{i % 977} und{i % 13}" for i in range(20_000))
    twelve = " ".join(f"w{i}" for i in range(12))
    near = [f"t{i}" for i in range(60)]
    rows = [
        (1, "The thing and the other thing with it. " * 8, "en", "b", 1),
        (2, "The thing and the other thing with it. " * 8, "en", "b", 1),
        (2, "The thing and the other thing with it. " * 8, "en", "b", 1),
        (2, "Another text under the same number, of twelve words or some more than that.", "en", None, 1),
        (None, "The thing and the other thing with it. " * 8, None, None, None),
        (None, None, None, None, None),
        (3, None, "de", "a", 0),
        (4, "", "de", "a", 0),
        (5, " \t\n\x0b\x0c\r ", "de", "a", 7),
        (6, long, "de", "a", len(long)),
        (7, long + " ende", "de", "c", len(long)),
        (8, twelve, "fr", "c", 40),
        (9, "x " + twelve + " y", "fr", "c", 40),
        (10, twelve + " y", "fr", "c", 40),
        (11, " ".join(near), "es", "c", 1),
        (12, " ".join([*near[:30], "anders", *near[31:]]), "es", "c", 1),
        (13, "1234 5678 !!! ###", None, "d", 17),
        (14, "ÄÖ ü é \u0085 \x1c\x1d ñ", "de", "d", 9),
        (15, "a", "en", "d", 1),
        (16, "Zeile eins\nZeile eins\n \nzeile eins\n<b>&", "de", "d", 1),
        (-17, "negative number of a document " * 5, "en", "d", 1),
        (18, "\U0001f600 emoji \U0001f600 und 漢字仮名 кириллица", "xx", "", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def odd_clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit("other").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


def multiset(found):
    return sorted(found, key=repr)
