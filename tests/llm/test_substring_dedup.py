import hashlib

import numpy as np
import pytest

from marlstone.llm import substring_dedup
from marlstone.llm.substring_dedup import doubling, remove_repeats

from .conftest import multiset, rows, words


def brute(docs, window):
    first, out = {}, []
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            if doc_id is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    for doc_id, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return multiset(out)


@pytest.mark.parametrize("window", [2, 5, 13])
def test_odd_documents(odd_clashing, window):
    docs = rows(odd_clashing.select("doc_id", "text"))
    assert multiset(rows(remove_repeats(odd_clashing, window))) == brute(docs, window)


@pytest.mark.parametrize(("window", "start", "levels"), [(13, 3, [3, 6, 12, 13]), (13, 1, [1, 2, 4, 8, 13]), (50, 7, [7, 14, 28, 50])])
def test_levels(documents, window, start, levels):
    assert doubling(start, window) == levels
    assert multiset(rows(remove_repeats(documents, window, start))) == brute(rows(documents.select("doc_id", "text")), window)


def test_documents(documents):
    assert multiset(rows(remove_repeats(documents))) == brute(rows(documents.select("doc_id", "text")), 13)


def test_many_questions_from_one_task(documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GATHER", 500)
    assert multiset(rows(remove_repeats(documents.coalesce(1)))) == brute(rows(documents.select("doc_id", "text")), 13)


def test_ids_that_are_multiples_of_the_buckets(documents, monkeypatch):
    """Answers are dealt evenly however the ids are spaced."""
    from pyspark.sql import functions as F

    spaced = documents.withColumn("doc_id", F.col("doc_id") * 1000)
    assert multiset(rows(remove_repeats(spaced))) == brute(rows(spaced.select("doc_id", "text")), 13)
    rows_ = substring_dedup._answers(np.arange(10_000, dtype=np.int64) * 400, np.arange(10_000, dtype=np.uint64), 400)
    sizes = [len(r[1]) // 8 for r in rows_]
    assert len(sizes) == 400 and max(sizes) < 60


def test_equal_hashes_of_different_windows_cut_nothing():
    """Two windows of one 64-bit hash in one bucket: the further bits tell them apart."""
    ask = substring_dedup.Questions(4, earlier=True)
    h, by = np.array([7, 9], np.uint64), np.array([1, 1], np.uint64)
    ask.add(5, h, np.array([1, 1], np.uint32), by)
    ask.add(3, h, np.array([2, 1], np.uint32), by)
    sent = [b for b in ask.flush()]
    other = substring_dedup.Questions(4, earlier=True)
    other.add(2, h[:1], np.array([2], np.uint32), by[:1])
    answers = [b for b in substring_dedup._reply(4, True)(iter([*sent, *other.flush()]))]
    found = {}
    for b in answers:
        own, _, doc, _ = substring_dedup._unpacked(b.to_pylist())
        for x, d in zip(own.tolist(), doc.tolist(), strict=True):
            found.setdefault(d, set()).add(x)
    assert found == {5: {9}, 3: {7}}


def test_kept_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(5, f"a {passage} b"), (3, passage)], "doc_id long, text string")
    assert dict(r[::3] for r in rows(remove_repeats(docs, keep_text=True))) == {5: "a b", 3: passage}


def test_empty(empty):
    assert rows(remove_repeats(empty)) == []
