"""Benchmark decontamination: CGK embedding, bit sampling and exact edit distances.

A document is contaminated by an item if one of its windows of the item's size (cut short at
the end of the document) is within the item's edit distance, counted in words. Three steps
find these windows. A q-gram bound, which no such window can miss, leaves the windows with
enough word triples of one item. They and the items are embedded by random walks (CGK: read
the word under the pointer, move on by a random bit that depends on step and word), which turn edit
distance into Hamming distance; sampled places of the embeddings are the keys of repeated hash
tables. Windows and items with an equal key are compared exactly. Items of fewer than ``SHORT`` words have
no room for edits and are looked up as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, column_bytes, grams, mix, portions

#: Edits per word of an item; items of fewer words than ``SHORT`` match exactly or not at all.
EDITS, SHORT = 0.2, 8
#: Random walks and hash tables.
WALKS, TABLES = 16, 64
#: Items up to so many words -> sampled places of a key, and the steps of a walk, in item sizes, that they come
#: from (a walk leaves an item after about two). A walk loses its way after some edits, so longer items, with
#: more edits, take fewer places; the q-gram bound keeps their candidates few. Measured recall of a single
#: window at the full 20 % of edits: see README.
PLACES = ((64, 6, 3.0), (160, 3, 1.8), (400, 2, 1.8), (1 << 62, 1, 1.8))
#: Items that one pass takes (about 1 KB each in every task), and bytes of their texts; a larger benchmark
#: takes several passes.
BLOCK, BLOCK_BYTES = 20_000, 32 << 20
#: Windows embedded at once, numbers that their embeddings and edit distances may take, and words (of whole
#: texts) looked through at once.
CHUNK, CELLS, RUN = 2048, 16 << 20, 200_000
#: Windows of items above this size are compared one at a time, guided by the distances known so far.
DENSE = 128
_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
HITS = "doc_id long, item_id long, start_word int, n_words int, distance int"
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA24BAED4963EE407)]


def plain(word: bytes) -> bytes:
    """A-Z in lower case, without punctuation at the ends; may be empty, and then is no word."""
    return word.lower().strip(_PUNCTUATION)


class _Ids(dict):
    """Raw word -> number in the benchmark's vocabulary, 0 if it has none, -1 if it is no word."""

    most = 400_000

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        own = plain(word)
        out = self[word] = self.vocabulary.get(own, 0) if own else -1
        return out


def embed(ids: np.ndarray, at: np.ndarray, size: np.ndarray, steps: int) -> np.ndarray:
    """CGK embeddings (steps, WALKS, windows) of the windows ids[at : at + size]; -1 after a window's end."""
    out = np.empty((steps, WALKS, len(at)), np.int32)
    pointer = np.zeros((WALKS, len(at)), np.int64)
    walk = np.arange(1, WALKS + 1, dtype=np.uint64)[:, None] * _C[0]
    with np.errstate(over="ignore"):
        for j in range(steps):
            read = np.where(pointer < size, ids[np.minimum(at + pointer, len(ids) - 1)], -1)
            out[j] = read
            pointer += (mix((read + 2).astype(np.uint64) * _C[1] + walk + np.uint64(j) * _C[2]) >> np.uint64(63)).astype(np.int64)
    return out


_SAMPLED = np.random.default_rng(11).random((TABLES, PLACES[0][1]))


def _bounded(n: np.ndarray, cells_of):
    """Cuts of windows, sorted by size ``n``, that hold ``CHUNK`` windows and ``CELLS`` cells at most."""
    a = 0
    while a < len(n):
        b = min(a + CHUNK, len(n))
        while b - a > 1 and cells_of(int(n[b - 1])) * (b - a) > CELLS:
            b = a + max(1, min((b - a) // 2, CELLS // cells_of(int(n[b - 1]))))
        yield slice(a, b)
        a = b


def _signatures(ids: np.ndarray, at: np.ndarray, size: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Keys (TABLES, windows). ``classes``: the item size of each window, which scales the sampled places."""
    out = np.empty((TABLES, len(at)), np.uint64)
    order = np.argsort(classes, kind="stable")
    for cut in _bounded(classes[order], lambda n: 3 * n * WALKS):
        own = order[cut]
        n = classes[own]
        kind = np.searchsorted([m for m, _, _ in PLACES], n)
        places, span = np.array([k for _, k, _ in PLACES])[kind], np.array([x for _, _, x in PLACES])[kind] * n
        embedded = embed(ids, at[own], size[own], int(np.ceil(span.max())))
        windows = np.arange(len(n))
        with np.errstate(over="ignore"):
            for t in range(TABLES):
                key = n.astype(np.uint64)
                for p in range(int(places.max())):
                    read = embedded[(_SAMPLED[t, p] * span).astype(np.int64), t % WALKS, windows]
                    key = np.where(p < places, mix(key * _C[0] + (read + 2).astype(np.uint64)), key)
                out[t, own] = key
    return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distances of the rows of ``a`` (pairs, n) and ``b`` (pairs, m); -1 pads the end of b's rows."""
    steps = np.arange(b.shape[1] + 1, dtype=np.int32)
    row = np.broadcast_to(steps, (len(a), len(steps))).copy()
    for i in range(a.shape[1]):
        new = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]))
        new = np.concatenate([np.full((len(a), 1), i + 1), new], axis=1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[np.arange(len(a)), (b >= 0).sum(1)]


def _member(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in the sorted ``known``, and whether it does."""
    at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
    return at, known[at] == values if len(known) else np.zeros(len(values), bool)


class Index:
    """The items of one block, as arrays."""

    def __init__(self, items: list[tuple[int, bytes | None]], edits: float = EDITS):
        self.vocabulary: dict[bytes, int] = {}
        words, self.item_ids = [], []
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or b"")):
            own = [w for w in map(plain, (text or b"").split()) if w]
            if own:
                words.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own])
                self.item_ids.append(item_id)
        self.edits = edits
        self.size = np.array([len(w) for w in words], np.int64)
        self.most = np.floor(self.size * edits + 1e-9).astype(np.int64)
        self.ids = np.array([x for w in words for x in w] + [0], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.base = len(self.vocabulary) + 1
        long = [(i, w) for i, w in enumerate(words) if len(w) >= SHORT]
        self.numbers = np.array([i for i, _ in long], np.int64)
        #: size -> hashes of the short items of that size, sorted, and their numbers
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in sorted({len(w) for w in words if len(w) < SHORT}):
            own = np.flatnonzero(self.size == m)
            keys = grams(self.ids[self.at[own][:, None] + np.arange(m)].reshape(-1).astype(np.uint64), m)[::m]
            order = np.argsort(keys, kind="stable")
            self.short[m] = keys[order], own[order]
        pairs = [x * self.base + y for _, w in long for x, y in zip(w, w[1:], strict=False)]
        self.pairs = np.unique(np.array(pairs, np.int64))
        triples = sorted({(x * self.base + y, z, i) for i, w in long for x, y, z in zip(w, w[1:], w[2:], strict=False)})
        pair, last, self.item_of = np.array(triples, np.int64).reshape(-1, 3).T
        self.triples, self.first_of = np.unique(np.searchsorted(self.pairs, pair) * self.base + last, return_index=True)
        self.end_of = np.append(self.first_of[1:], len(triples))
        own = self.numbers
        keys = _signatures(self.ids, self.at[own], self.size[own], self.size[own]) if len(own) else np.empty((TABLES, 0), np.uint64)
        order = np.argsort(keys, axis=1, kind="stable")
        self.keys, self.order = np.take_along_axis(keys, order, axis=1), own[order]

    def verbatim(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, best: dict) -> None:
        """Update ``best`` by the short items that stand in the documents word for word."""
        doc = np.repeat(np.arange(len(starts)), ends - starts)
        for m, (keys, items) in self.short.items():
            g = grams(ids.astype(np.uint64), m)
            at = np.flatnonzero(np.isin(g, keys) & (doc[: len(g)] == doc[m - 1 : m - 1 + len(g)]))
            left, right = np.searchsorted(keys, g[at]), np.searchsorted(keys, g[at], "right")
            for place, a, b in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
                for item in items[a:b].tolist():
                    if (ids[place : place + m] == self.ids[self.at[item] : self.at[item] + m]).all():
                        d = int(doc[place])
                        found = (0, place - int(starts[d]), m)
                        best[d, item] = min(best.get((d, item), found), found)

    def candidates(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows that pass the q-gram bound: place, size, item size, document number.

        Within k edits of an item of n words, a window has n - 2 - 3 k places of word triples of that item."""
        doc = np.repeat(np.arange(len(starts)), ends - starts)
        may = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0) & (doc[:-2] == doc[2:]))
        pair, known = _member(self.pairs, ids[may] * self.base + ids[may + 1])
        may, pair = may[known], pair[known]
        triple, known = _member(self.triples, pair * self.base + ids[may + 2])
        may, triple = may[known], triple[known]
        times = self.end_of[triple] - self.first_of[triple]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item, place = self.item_of[np.repeat(self.first_of[triple], times) + inner], np.repeat(may, times)
        group = doc[place] * len(self.size) + item
        order = np.lexsort((place, group))
        group, place, item = group[order], place[order], item[order]
        n = self.size[item]
        last = np.arange(len(place)) + np.maximum(n - 2 - 3 * self.most[item], 1) - 1
        inside = np.minimum(last, len(place) - 1)
        dense = np.flatnonzero((last < len(place)) & (group[inside] == group) & (place[inside] - place <= n - 3))
        low = np.maximum(place[inside[dense]] - (n[dense] - 3), starts[doc[place[dense]]])
        high, n = place[dense], n[dense]
        places, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m in np.unique(n).tolist():
            own = n == m
            edge = np.bincount(low[own], minlength=len(ids) + 1) - np.bincount(high[own] + 1, minlength=len(ids) + 1)
            found = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            places.append(found)
            sizes.append(np.full(len(found), m))
        at, n = np.concatenate(places), np.concatenate(sizes)
        size = np.minimum(n, ends[doc[at]] - at)
        keep = size >= n - np.floor(n * self.edits + 1e-9)
        return at[keep], size[keep], n[keep], doc[at[keep]]

    def hits(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document number, item number, start, words, distance) of the closest window, the first if there
        are several, of each pair."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.verbatim(ids, starts, ends, best)
        windows = self.candidates(ids, starts, ends) if len(self.numbers) else [np.empty(0, np.int64)] * 4
        for a in range(0, len(windows[0]), CHUNK):
            self._compare(ids, starts, *(x[a : a + CHUNK] for x in windows), best)
        return [(d, i, s, m, k) for (d, i), (k, s, m) in sorted(best.items())]

    def _compare(self, ids, starts, at, size, n, doc, best) -> None:
        """Update ``best`` by the items that share a key with some of the windows."""
        keys, pairs = _signatures(ids, at, size, n), []
        for t in range(TABLES):
            left, right = np.searchsorted(self.keys[t], keys[t]), np.searchsorted(self.keys[t], keys[t], "right")
            w = np.flatnonzero(right > left)
            times = (right - left)[w]
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            item = self.order[t][np.repeat(left[w], times) + inner]
            pairs.append(np.unique(np.repeat(w, times) * len(self.size) + item))
        pairs = np.unique(np.concatenate(pairs))
        w, item = pairs // len(self.size), pairs % len(self.size)
        same = self.size[item] == n[w]
        w, item = w[same], item[same]
        for m in np.unique(n[w]).tolist():
            own = np.flatnonzero(n[w] == m)
            if m > DENSE:
                self._descend(ids, starts, at[w[own]], size[w[own]], doc[w[own]], item[own], best)
                continue
            for cut in _bounded(np.full(len(own), m), lambda k: 4 * k):
                x, y = w[own[cut]], item[own[cut]]
                distance = self._distances(ids, at[x], size[x], y)
                for i in np.flatnonzero(distance <= self.most[y]).tolist():
                    pair = (int(doc[x[i]]), int(y[i]))
                    found = (int(distance[i]), int(at[x[i]] - starts[pair[0]]), int(size[x[i]]))
                    best[pair] = min(best.get(pair, found), found)

    def _distances(self, ids, at, size, item) -> np.ndarray:
        """Edit distances of windows and items of one size."""
        places = np.arange(int(self.size[item[0]]))
        window = np.where(places < size[:, None], ids[np.minimum(at[:, None] + places, len(ids) - 1)], -1)
        return edit_distances(self.ids[self.at[item][:, None] + places], window)

    def _descend(self, ids, starts, at, size, doc, item, best) -> None:
        """The closest window of each document and item among the given ones, long ones, one distance at a time.

        Windows whose starts are k words apart differ by 2 k edits at most, so a known distance bounds those
        around it; what cannot be the closest, or is beyond the item's edits, need not be worked out."""
        group = doc * len(self.size) + item
        for g in np.unique(group).tolist():
            own = np.flatnonzero(group == g)
            own = own[np.argsort(at[own])]
            pair = (int(doc[own[0]]), int(item[own[0]]))
            most = int(self.most[pair[1]])
            place, bound, done = at[own], np.zeros(len(own), np.int64), np.zeros(len(own), bool)
            while True:
                limit, first = best[pair][:2] if pair in best else (most, 1 << 62)
                open_ = ~done & ((bound < limit) | (bound == limit) & (place - starts[pair[0]] < first))
                if not open_.any():
                    break
                least = np.flatnonzero(open_ & (bound == bound[open_].min()))
                i = int(least[len(least) // 2])
                done[i] = True
                distance = int(self._distances(ids, at[own[i : i + 1]], size[own[i : i + 1]], item[own[i : i + 1]])[0])
                bound = np.maximum(bound, distance - 2 * np.abs(place - place[i]))
                if distance <= most:
                    found = (distance, int(place[i] - starts[pair[0]]), int(size[own[i]]))
                    best[pair] = min(best.get(pair, found), found)


def _batch_hits(index: Index, ids_of: _Ids, texts: list) -> list[tuple[int, int, int, int, int]]:
    """Hits of a batch of texts, taken up in runs of bounded size."""
    out: list[tuple[int, int, int, int, int]] = []
    rows: list[np.ndarray] = []
    first, size = 0, 0
    for i, text in enumerate(texts if len(index.size) else []):
        words = (text or b"").split()
        own = np.fromiter(map(ids_of.__getitem__, words), np.int64, len(words))
        rows.append(own[own >= 0])
        size += len(rows[-1])
        if size and (size >= RUN or i == len(texts) - 1):
            ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
            hits = index.hits(np.concatenate(rows), np.concatenate([[0], ends[:-1]]), ends)
            out += [(first + h[0], *h[1:]) for h in hits]
            rows, first, size = [], i + 1, 0
    return out


def _find(items: list):
    def run(batches):
        index = Index(items)
        ids_of = _Ids(index.vocabulary)
        for batch in batches:
            hits = _batch_hits(index, ids_of, column_bytes(batch.column("text")))
            doc, item, *rest = zip(*hits, strict=True) if hits else [()] * 5
            ids = batch.column("doc_id").take(pa.array(doc, pa.int64())).cast(pa.int64())
            named = pa.array([index.item_ids[i] for i in item], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, named, *(pa.array(c, pa.int32()) for c in rest)], names=[x.split()[0] for x in HITS.split(", ")])

    return run


def _clean(items: list):
    def run(batches):
        index = Index(items)
        ids_of = _Ids(index.vocabulary)
        for batch in portions(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[[h[0] for h in _batch_hits(index, ids_of, column_bytes(batch.column("text")))]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame):
    """The items in blocks of about ``BLOCK`` items and ``BLOCK_BYTES`` bytes at most, as plain rows for the tasks."""
    rows = benchmark.where("text is not null").select("item_id", F.col("text").cast("binary").alias("text"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).head()
    blocks = max(1, -(-sizes["n"] // BLOCK), -(-sizes["bytes"] // BLOCK_BYTES))
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], bytes(r["text"])) for r in block.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that contaminates it: doc_id, item_id, start_word, n_words, distance.

    Words are compared in lower case (A-Z) without punctuation at their ends; what is punctuation only is no
    word. Null and empty texts and items match nothing. Items of fewer than ``SHORT`` words must stand there
    word for word. Of several windows the closest is given, then the first; repeated rows and items give a
    row each; an empty table on either side gives no rows."""
    found = [arrow(docs.select("doc_id", "text"), _find(items), HITS) for items in _blocks(benchmark)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that an item contaminates, with their own columns. What matches is said in
    ``find_contamination``; null texts stay, repeated rows go together, without items all documents stay."""
    for items in _blocks(benchmark):
        docs = arrow(docs, _clean(items), docs.schema)
    return docs
