import zlib

import numpy as np

from marlstone.llm import lang_id
from marlstone.llm.lang_id import DIM, N, Profiler, _vector, identify_languages, keep_identified

from .conftest import multiset, rows


def brute_bundle(text):
    """The definition, letter by letter."""
    chars, out = " ", np.zeros(DIM, np.int64)
    for c in text.lower():
        chars += c if c.isalpha() else "" if chars[-1] == " " else " "
    chars += "" if chars[-1] == " " else " "
    for i in range(len(chars) - N + 1):
        bound = np.ones(DIM, np.int64)
        for place, c in enumerate(chars[i : i + N]):
            bound *= np.roll(_vector(0 if c == " " else ord(c) + 1), N - 1 - place).astype(np.int64)
        out += bound
    return out


def test_bundles_follow_the_definition():
    profiler = Profiler()
    for text in ["a", "Ab  cd, éß!", "x" * 50, "漢字 abc", "".join(chr(0x4E00 + i) for i in range(90)), "again Ab cd"]:
        assert (profiler.bundle(text.encode()) == brute_bundle(text)).all(), text
    assert profiler.bundle(b"") is None and profiler.bundle(b"12 !?") is None and profiler.bundle(None) is None


def test_bundles_survive_a_full_table(monkeypatch):
    monkeypatch.setattr(Profiler, "most", 40)
    profiler = Profiler()
    for text in ["the quick brown fox", "jumps over the lazy dog", "the quick brown fox"]:
        assert (profiler.bundle(text.encode()) == brute_bundle(text)).all()


def test_vectors_are_nearly_orthogonal():
    v = np.array([_vector(c) for c in range(97, 123)], np.int64)
    cosines = v @ v.T / DIM - np.eye(26)
    assert np.abs(cosines).max() < 0.2


def test_held_out_accuracy(documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    found = identify_languages(documents).collect()
    assert {r["doc_id"] for r in found} == set(truth)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert sum(held) / len(held) > 0.95


def test_held_out_labels_do_not_matter(documents):
    from pyspark.sql import functions as F

    other = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "??").otherwise(F.col("lang")))
    assert multiset(rows(identify_languages(documents))) == multiset(rows(identify_languages(other.repartition(5))))


def test_odd_documents(odd, odd_clashing, empty):
    found = multiset(rows(identify_languages(odd_clashing)))
    given = rows(odd)
    assert multiset(r[0] for r in found) == multiset(r[0] for r in given)
    no_letter = {r[0] for r in given if not any(c.isalpha() for c in r[1] or "")} - {None}
    assert {r[0] for r in found if r[2] == "und"} - {None} == no_letter == {3, 4, 5, 13}
    assert rows(identify_languages(empty)) == [] and rows(keep_identified(empty)) == []
    kept = keep_identified(odd_clashing)
    assert kept.columns == odd_clashing.columns
    assert multiset(r[:5] for r in rows(kept)) == multiset(r for r in given if any(c.isalpha() for c in r[1] or ""))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert rows(identify_languages(docs))[0][2] == "und"


def brute_predictions(docs):
    """Prototypes and predictions by the definition, over all rows that may be learned from."""
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    sums, bundles = {}, {}
    for i, text, lang in docs:
        if text not in bundles:
            bundles[text] = brute_bundle(text) if any(c.isalpha() for c in text or "") else None
        learns = i is None or zlib.crc32(str(i).encode()) % 3 != 1
        if lang is not None and learns and bundles[text] is not None:
            sums[lang] = sums.get(lang, 0) + bundles[text]
    out = []
    for i, text, _ in docs:
        v = bundles[text]
        best = max(((round(float(unit(v) @ unit(sums[x])), 9), x) for x in sorted(sums)), key=lambda p: p[0]) if v is not None and sums else (0.0, "und")
        out.append((i, best[1], best[0]))
    return out


def test_predictions_equal_brute_force(spark, documents, odd_clashing):
    few = documents.where("n_chars < 700").limit(120).select("doc_id", "text", "lang")
    for docs in (spark.createDataFrame(few.collect(), few.schema), odd_clashing.where("doc_id is null or doc_id not in (6, 7)")):
        expected = brute_predictions(rows(docs.select("doc_id", "text", "lang")))
        found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in identify_languages(docs).collect()]
        for x, y in zip(multiset(found), multiset(expected), strict=True):
            assert x[:2] == y[:2] and abs(x[2] - max(0, y[2])) < 1e-6


def test_the_sample_is_bounded(documents):
    """A share of each language's rows is learned from, by a hash of doc_id; prototypes change with it."""
    given = documents.unionByName(documents.withColumn("doc_id", documents.doc_id + 10_000)).unionByName(documents.withColumn("doc_id", documents.doc_id + 20_000))
    langs, every = lang_id.train_prototypes(given)
    some_langs, some = lang_id.train_prototypes(given, per_lang=20)
    assert set(some_langs) <= set(langs) and "en" in some_langs
    assert np.allclose(np.linalg.norm(some, axis=1), 1)
    assert not np.allclose(every[langs.index("en")], some[some_langs.index("en")])
    assert np.allclose(some, lang_id.train_prototypes(given.repartition(3), per_lang=20)[1])


def test_the_pipeline_rejects_by_the_prediction(spark, documents):
    """What is in no learned language goes; short texts and those of a learned language stay."""
    foreign = "".join(chr(0x430 + i % 32) + " " * (i % 6 == 0) for i in range(300))
    given = rows(documents.select("doc_id", "text", "lang"))
    more = [(10_000, foreign, None), (10_001, foreign[:20], None), (10_002, "漢字仮名" * 30, None), (10_003, "abc " * 3, None), (10_004, None, "en")]
    kept = {r["doc_id"] for r in keep_identified(spark.createDataFrame(given + more, "doc_id long, text string, lang string")).collect()}
    assert kept >= {10_001, 10_003} and not kept & {10_000, 10_002, 10_004}
    score = {r["doc_id"]: r["score"] for r in identify_languages(documents).collect()}
    letters = {i: sum(c.isalpha() for c in t or "") for i, t, _ in given}
    assert {i for i, *_ in given} - kept == {i for i in score if not letters[i] or letters[i] >= lang_id.LEAST_LETTERS and score[i] < lang_id.LEAST_SCORE}


def test_too_many_labels_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(lang_id, "MOST_LANGS", 2)
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        identify_languages(docs)
