"""Exact substring deduplication by level-wise doubling.

Repeats are sought at a short length first; only windows repeated at one length are extended to
twice that length (or to the wanted one), until the wanted length is reached or no candidate
survives. A window of one level holds several grams of the level below; the one with the smallest
hash is the same in every copy of the window, so each level asks about these grams only (7 words
for 13: a quarter of all). The next level asks about the windows behind repeated grams.

Each level is one exchange of packed arrays: a task sorts what it has hashed, keeps the first
document of each hash and asks a bucket about it; the bucket answers with what other tasks
have seen. Later documents of the same task need no question. So a hash that stands in a third of all
documents reaches its bucket once per task, and the answers go back by document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow, each_bytes, give_back, grams, mix, shuffle_partitions

#: Questions that a task gathers before it sends them, and buckets for each shuffle partition. A task that
#: answers holds one bucket at a time.
GATHER, BUCKETS = 250_000, 2
#: Starts the second hash of a window.
CHECK_SEED = 0x632BE59BD9B4E019
#: Stands for a null doc_id where rows are dealt out; no answer has it.
NOBODY = -(1 << 63)
#: Packed hashes, further bits of them, and their documents (as differences). A question goes to the bucket of
#: its hash and has a flag for each hash, whether the asker has later documents with it; an answer has none
#: and goes to the bucket of its document.
_ROW = "bucket int, hashes binary, checks binary, docs binary, flags binary"
_NAMES = ["bucket", "hashes", "checks", "docs", "flags"]
_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_BY_DOC = "doc long, hashes binary"


def _batches(rows: list):
    for i in range(0, len(rows), 20_000):
        part = list(zip(*rows[i : i + 20_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, _KINDS, strict=True)], names=_NAMES)


def _packed(bucket: np.ndarray, h: np.ndarray, check: np.ndarray | None, doc: np.ndarray, flag: np.ndarray | None = None) -> list:
    """Rows of the given hashes, one for each bucket."""
    if not len(bucket):
        return []
    order = np.lexsort((doc, bucket))
    bucket, h, doc = bucket[order], h[order], doc[order]
    check, flag = (None if x is None else x[order] for x in (check, flag))
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(cuts[1:], len(bucket))
    some = lambda x, s, e: None if x is None else x[s:e].tobytes()
    return [(int(bucket[s]), h[s:e].tobytes(), some(check, s, e), np.diff(doc[s:e], prepend=0).tobytes(), None if flag is None else np.packbits(flag[s:e]).tobytes()) for s, e in zip(cuts, ends, strict=True)]


def _answers(doc: np.ndarray, h: np.ndarray, buckets: int) -> list:
    with np.errstate(over="ignore"):
        bucket = mix(doc.view(np.uint64)) % np.uint64(buckets)  # however the ids are spaced
    return _packed(bucket.astype(np.int64), h, None, doc)


def _unpacked(rows: list) -> list[np.ndarray]:
    """Hashes, checks (zero where none were sent), documents and flags of packed rows."""
    out = [[np.empty(0, np.uint64)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty(0, bool)]]
    for row in rows:
        h = np.frombuffer(row["hashes"], np.uint64)
        out[0].append(h)
        out[1].append(np.zeros(len(h), np.uint32) if row["checks"] is None else np.frombuffer(row["checks"], np.uint32))
        out[2].append(np.cumsum(np.frombuffer(row["docs"], np.int64)))
        if row["flags"] is not None:
            out[3].append(np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=len(h)).astype(bool))
    return [np.concatenate(x) for x in out]


def _grouped(h: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, check and document; in that order, where a hash begins, and the number of its group."""
    order = np.lexsort((doc, check, h))
    h, check = h[order], check[order]
    start = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
    return order, start, np.cumsum(start) - 1


class Questions:
    """What a task wants to know: does a hash stand in other documents (``earlier``: in a smaller one)?

    At the last level, which decides what is cut, a window has 32 bits besides its 64 and is asked about in
    the bucket of yet another hash."""

    def __init__(self, buckets: int, earlier: bool):
        self.buckets, self.earlier, self.parts, self.size = buckets, earlier, [], 0

    def add(self, doc: int, h: np.ndarray, check: np.ndarray, by: np.ndarray) -> bool:
        """``by`` decides the bucket; another hash than ``h`` makes chance equality rarer still."""
        self.parts.append((h, check, by, np.full(len(h), doc, np.int64)))
        self.size += len(h)
        return self.size >= max(GATHER, 16 * self.buckets)  # rows of some size, however many buckets

    def flush(self):
        """Answers for all but the first document of each hash; questions for the first, flagged where
        the task itself has later ones."""
        if not self.size:
            return
        h, check, by, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order, start, group = _grouped(h, check, doc)
        h, check, by, doc = h[order], check[order], by[order], doc[order]
        later = doc > doc[start][group]
        yield from _batches(_answers(doc[later], h[later], self.buckets))
        several = np.zeros(int(group[-1]) + 1, bool)
        several[group[later]] = True
        bucket = (by[start] % np.uint64(self.buckets)).astype(np.int64)
        yield from _batches(_packed(bucket, h[start], check[start] if self.earlier else None, doc[start], several))


def _by_bucket(batches):
    """The rows of one bucket after another; rows come sorted by bucket."""
    held: list = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != held[-1]["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _reply(buckets: int, earlier: bool):
    """Answers the questions of a partition, bucket by bucket; lets answers through."""

    def answered(rows):
        h, check, doc, flag = _unpacked(rows)
        order, start, group = _grouped(h, check, doc)
        h, doc, flag = h[order], doc[order], flag[order]
        found = doc > doc[start][group]
        if not earlier:
            several = np.zeros(int(group[-1]) + 1, bool)
            several[group[found | flag]] = True
            found = several[group]
        return doc[found], h[found]

    def packed(parts):
        return _batches(_answers(*(np.concatenate(x) for x in zip(*parts, strict=True)), buckets))

    def run(batches):
        held: list = []
        parts: list = []  # answers of several buckets go out together, in rows of some size
        for batch in batches:
            question = batch.column("flags").is_valid()
            yield batch.filter(pc.invert(question))
            for row in batch.filter(question).to_pylist():
                if held and row["bucket"] != held[-1]["bucket"]:
                    parts.append(answered(held))
                    held = []
                    if sum(len(d) for d, _ in parts) >= max(GATHER, 16 * buckets):
                        yield from packed(parts)
                        parts = []
                held.append(row)
        if held:
            parts.append(answered(held))
        if parts:
            yield from packed(parts)
        give_back()

    return run


def _by_document(batches):
    """All hashes of each document, bucket by bucket."""
    for rows in _by_bucket(batches):
        h, _, doc, _ = _unpacked(rows)
        rows.clear()
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        ends = np.append(cuts[1:], len(doc))
        for i in range(0, len(cuts), 10_000):
            some = slice(i, i + 10_000)
            packed = [h[s:e].tobytes() for s, e in zip(cuts[some].tolist(), ends[some].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[cuts[some]]), pa.array(packed, pa.binary())], names=["doc", "hashes"])
    give_back()


def _exchange(questions: DataFrame, earlier: bool, name: str) -> DataFrame:
    """Answers by document: ``d`` and the packed hashes that stand for its repeats."""
    partitions = shuffle_partitions(questions.sparkSession)
    replies = arrow(questions.repartition(partitions, "bucket").sortWithinPartitions("bucket"), _reply(partitions * BUCKETS, earlier), _ROW)
    home = arrow(replies.repartition(partitions, "bucket").sortWithinPartitions("bucket"), _by_document, _BY_DOC)
    return home.select(F.col("doc").alias("d"), F.col("hashes").alias(name))


def _selected(h: np.ndarray, base: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for each window the place of its smallest gram."""
    g = grams(h, base)
    span = window - base + 1
    least = np.lib.stride_tricks.sliding_window_view(g, span).argmin(1)
    return g, least + np.arange(len(least))


def _ask(levels: list[int], i: int, buckets: int):
    """Questions of level ``i``: about its grams that stand for the next level's windows (at the last level
    about all its windows), as far as they hold a repeat of the level before."""
    k, last = levels[i], i == len(levels) - 1

    def candidates(h: np.ndarray, repeats: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes to ask about, their further bits, and the hashes that decide their buckets."""
        g = grams(h, k)
        if last:
            own, places = np.unique(g, return_index=True)
        else:
            places = np.unique(_selected(h, k, levels[i + 1])[1])
            own, first = np.unique(g[places], return_index=True)
            places = places[first]
        more = np.zeros(len(own), np.uint32)
        if repeats is None:
            return own, more, own
        if last:
            more = (grams(h, k, CHECK_SEED)[places] >> np.uint64(32)).astype(np.uint32)
        shorter, at = _selected(h, levels[i - 1], k)
        held = shorter[at[places]]
        keep = np.isin(held, repeats)
        return own[keep], more[keep], held[keep]

    def run(batches):
        hashes, questions = WordHashes(), Questions(buckets, earlier=last)
        for batch in batches:
            given = each_bytes(batch.column("repeats")) if i else (None for _ in range(batch.num_rows))
            for doc, text, repeats in zip(batch.column("doc_id").to_pylist(), each_bytes(batch.column("text")), given, strict=True):
                words = (text or b"").split()
                if doc is None or len(words) < levels[-1]:
                    continue
                own, more, by = candidates(hashes.of(words), np.frombuffer(repeats, np.uint64) if i else None)
                if len(own) and questions.add(doc, own, more, by):
                    yield from questions.flush()
        yield from questions.flush()
        give_back()

    return run


def _cut(window: int, keep_text: bool):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, windows in zip(each_bytes(batch.column("text")), each_bytes(batch.column("windows")), strict=True):
                words = (text or b"").split()
                removed = 0
                if windows and len(words) >= window:
                    starts = np.flatnonzero(np.isin(grams(hashes.of(words), window), np.frombuffer(windows, np.uint64)))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    stays = np.cumsum(edge[:-1]) <= 0
                    removed = int(len(words) - stays.sum())
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                text = b" ".join(words)
                n_words.append(len(words) + removed)
                n_removed.append(removed)
                kept.append(text if keep_text else hashlib.sha256(text).hexdigest())
            arrays = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary() if keep_text else pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])
        give_back()

    return run


def doubling(start: int, window: int) -> list[int]:
    """start, 2 start, 4 start, ... and at last the window."""
    levels = [start]
    while levels[-1] < window:
        levels.append(min(2 * levels[-1], window))
    return levels


def remove_repeats(docs: DataFrame, window: int = 13, start: int | None = None, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept_sha256 (or kept_text).

    A word goes if it stands in a window of ``window`` words that also starts in a document with a
    smaller doc_id; windows are judged on the input. A null text has no words. Rows that share a
    doc_id never cut one another; a null doc_id is neither smaller nor larger than any, so its
    words stay. An empty table gives no rows."""
    levels = doubling(start or (window + 1) // 2, window)
    if not 1 <= levels[0] < window:
        raise ValueError("the first level is shorter than the window")
    buckets = shuffle_partitions(docs.sparkSession) * BUCKETS
    # the same exchange of texts serves all joins: the key is never null, so no filter tells them apart
    texts = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NOBODY)).alias("d"))
    found = _exchange(arrow(texts.select("doc_id", "text"), _ask(levels, 0, buckets), _ROW), False, "repeats")
    for i in range(1, len(levels)):
        back = texts.join(found.hint("shuffle_hash"), "d").select("doc_id", "text", "repeats")
        last = i == len(levels) - 1
        found = _exchange(arrow(back, _ask(levels, i, buckets), _ROW), last, "windows" if last else "repeats")
    judged = texts.join(found.hint("shuffle_hash"), "d", "left")
    kind = "binary" if keep_text else "string"
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    done = arrow(judged.select("doc_id", "text", "windows"), _cut(window, keep_text), f"doc_id {id_kind}, n_words long, n_removed long, kept {kind}")
    return done.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text" if keep_text else "kept_sha256"))
