import random
from collections import Counter

import numpy as np

from marlstone.llm import decontaminate
from marlstone.llm.decontaminate import EDITS, SHORT, _signatures, drop_contaminated, edit_distances, find_contamination, plain

from .conftest import multiset, rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, items):
    split = lambda t: [w for w in map(plain, (t or "").encode().split()) if w]
    out = {}
    for d, t in docs:
        w = split(t)
        for i, text in items:
            own = split(text)
            n = len(own)
            if not n:
                continue
            k, found = int(n * EDITS + 1e-9) if n >= SHORT else 0, None
            for s in range(len(w)):
                window = w[s : s + n]
                if len(window) < n - k or len(set(window) & set(own)) < min(3, len(set(own))):
                    continue
                best = distance(own, window)
                if best <= k and (found is None or best < found[2]):
                    found = (s, len(window), best)
            if found:
                out[d, i] = found
    return out


def test_edit_distances():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 4, (20, 7)), rng.integers(0, 4, (20, 7))
        b[np.arange(7) >= rng.integers(4, 8, 20)[:, None]] = -1
        assert edit_distances(a, b).tolist() == [distance(x, [v for v in y if v >= 0]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_planted_passages_and_brute_force(spark, sf):
    random.seed(5)
    items = rows(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text"))[:12] + [(900, None), (902, "")]
    docs = rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))[:40]
    for n, (i, t) in enumerate(items[:12] * 3):
        w = t.split()
        for _ in range(int(len(w) * 0.15 * (n % 3) / 2)):
            p, kind = random.randrange(len(w)), random.randrange(3)
            w[p : p + 1] = [["changed"], [], ["put", w[p]]][kind]
        before, after = docs[n][1].split()[:30], docs[n + 1][1].split()[:20]
        docs.append((10_000 + n, " ".join(before + [x.upper() if n % 2 else f"({x})," for x in w] + after * (n % 4 > 0))))
    docs += [(20_000, None), (20_001, ""), (20_002, items[0][1]), (None, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r[0], r[1]): r[2:] for r in rows(find_contamination(df, bench))}
    expected = brute(docs, items)
    assert set(found) <= set(expected)
    assert len(found) >= 0.97 * len(expected) and len(expected) >= 36
    assert sum(found[k][2] == expected[k][2] for k in found) >= 0.9 * len(found)
    clean = drop_contaminated(df, bench)
    assert multiset(rows(clean)) == multiset(d for d in docs if d[0] not in {k[0] for k in found})


def test_short_items_match_word_for_word(spark, sf):
    docs = rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))[:60]
    items = [(1, "seven words that stand there verbatim now"), (2, "The"), (3, "(to) ING;"), (4, "seven words that"), (4, "seven words that"), (None, "ends here."), (6, "!!!"), (7, "seven words changed stand there verbatim now")]
    docs += [(9000, "a Seven, words that stand there -- verbatim now"), (9001, "words that stand there verbatim now seven"), (9002, "so it ends"), (9003, "here it ends here"), (9004, "ends"), (None, "seven words that"), (9004, "ends here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter()
    for d, t in docs:
        for (_, i), hit in brute([(0, t)], list(enumerate_items(items))).items():
            expected[d, items[i][0], *hit] += 1
    assert Counter(rows(find_contamination(df, bench))) == expected and len(expected) > 20
    assert {r[0] for r in expected if r[1] == 1} == {9000}


def enumerate_items(items):
    return ((n, t) for n, (_, t) in enumerate(items))


def test_long_items(spark):
    """Items of 5,000 words, within bounded memory: verbatim, edited in part, and another text."""
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(n))) for i, n in ((1, 5000), (2, 300))]
    edited = []
    for _, t in items:
        w = t.split()
        for _ in range(len(w) // 50):
            p, kind = rng.randrange(len(w)), rng.randrange(3)
            w[p : p + 1] = [["changed"], [], ["put", w[p]]][kind]
        edited.append("before " + " ".join(w))
    docs = [(10, "x y " + items[0][1] + " z"), (11, edited[0]), (12, edited[1]), (13, " ".join(f"v{i}" for i in range(6000))), (14, items[0][1][:9000])]
    found = rows(find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    hits = {r[:2]: r[2:] for r in found}
    assert set(hits) == {(10, 1), (11, 1), (12, 2)}
    assert hits[10, 1] == (2, 5000, 0) and 0 < hits[11, 1][2] <= 110 and 0 < hits[12, 2][2] <= 8


def test_closest_windows_of_long_items_equal_brute_force(monkeypatch):
    """Repetitive words, so that many windows are near: the guided search gives what all distances give."""
    rng = np.random.default_rng(6)
    item = rng.integers(1, 6, 40)
    for _ in range(12):
        doc = rng.integers(1, 6, 150)
        own = [x for x in item.tolist() if rng.random() > 0.08]
        doc[30 : 30 + len(own)] = own
        text = " ".join(f"w{x}" for x in doc).encode()
        index = decontaminate.Index([(1, " ".join(f"w{x}" for x in item).encode())])
        found = []
        for dense in (0, 1000):
            monkeypatch.setattr(decontaminate, "DENSE", dense)
            found.append(decontaminate._batch_hits(index, decontaminate._Ids(index.vocabulary), [text]))
        assert found[0] == found[1]


def test_memory_is_bounded_whatever_the_item(monkeypatch):
    sizes = []
    embed = decontaminate.embed
    monkeypatch.setattr(decontaminate, "embed", lambda *given: sizes.append((out := embed(*given)).size) or out)
    monkeypatch.setattr(decontaminate, "CELLS", 1 << 18)
    ids = np.arange(1, 4000)
    n = np.array([10] * 50 + [1000] * 4 + [300] * 9)
    _signatures(ids, np.zeros(len(n), np.int64), n, n)
    assert max(sizes) <= max(1 << 18, 3 * 1000 * decontaminate.WALKS) and len(sizes) > 5


def test_recall_by_size():
    """A single window with all the edits that an item allows shares a key with it, at nine in ten sizes and more."""
    rng = np.random.default_rng(3)
    for n, trials in ((8, 60), (16, 60), (38, 60), (59, 60), (64, 40), (100, 40), (160, 20), (250, 20), (400, 10)):
        found = 0
        for _ in range(trials):
            item = rng.integers(1, 100_000, n)
            w = item.tolist()
            for _ in range(int(n * EDITS + 1e-9)):
                p = int(rng.integers(len(w)))
                w[p : p + 1] = [[200_000], [], [200_000, w[p]]][int(rng.integers(3))]
            doc = np.array([*w, *rng.integers(1, 100_000, n)])
            at, size = np.array([0]), np.array([n])
            found += (_signatures(item, at, size, size) == _signatures(doc, at, size, size)).any()
        assert found >= 0.9 * trials, n


def test_odd_documents(spark, odd_clashing, empty):
    bench = spark.createDataFrame([(1, "The thing and the other thing with it. The thing and"), (2, None), (1, "The thing and the other thing with it. The thing and")], "item_id long, text string")
    found = rows(find_contamination(odd_clashing, bench))
    assert multiset(r[:2] for r in found) == multiset([(1, 1)] * 2 + [(2, 1)] * 4 + [(None, 1)] * 2)
    nothing = bench.limit(0)
    assert rows(find_contamination(odd_clashing, nothing)) == [] and rows(find_contamination(empty, bench)) == []
    assert drop_contaminated(odd_clashing, nothing).count() == odd_clashing.count()
    assert drop_contaminated(odd_clashing, bench).columns == odd_clashing.columns


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, at = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    before = set(rows(docs))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == columns, name
        now = set(rows(at))
        assert now <= before and len(now) > 0.6 * len(before), name
        before = now
    end = corpus_pipeline.run(spark, sf)
    assert multiset(r[0] for r in rows(end.select("doc_id"))) == multiset(r[0] for r in rows(at.select("doc_id")))


def test_pipeline_over_an_empty_table(spark, sf, empty):
    import corpus_pipeline

    at = empty
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        assert rows(at) == []
