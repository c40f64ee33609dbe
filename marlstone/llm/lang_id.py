"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1. A letter trigram is
bound from its letters' vectors, each permuted by its place, by multiplication; a text is the
bundle (sum) of its trigrams; a language's prototype is the bundle of its training texts. A
text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, column_bytes, local, mix, portions

#: Length of the vectors and of the n-grams.
DIM, N = 1024, 3
#: Training texts of a language on average, at most; chosen by a hash of doc_id. Bounds the fit.
TRAIN_PER_LANG = 3000
#: Learned languages at most: a label is a language, not free text. Their prototypes (8 KB each) go to the
#: driver and to every task; more labels are an error, nothing is left out.
MOST_LANGS = 10_000
UNKNOWN = "und"
#: A text of at least so many letters whose best cosine is below this is in no learned language: texts in
#: other scripts have 0 with a standard deviation of 0.03, texts in a learned language have 0.3 and more.
LEAST_LETTERS, LEAST_SCORE = 40, 0.2


#: Trigrams whose vectors are widened and summed at once (16 MB).
BLOCK = 4096


@functools.cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.cache
def _vector(code: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seeds = np.arange(DIM // 64, dtype=np.uint64) + np.uint64(code) * np.uint64(1 << 20) + np.uint64(0x51ED270B)
        bits = np.unpackbits(mix(mix(seeds)).view(np.uint8))
    return bits.astype(np.int8) * 2 - 1


class Profiler:
    """Bundles texts; keeps the bound vectors of the trigrams that it has met."""

    most = 60_000

    def __init__(self):
        self.code_of = np.full(0x110000, -1, np.int32)
        self.codes: list[int] = []
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, DIM), np.int8)
        self.letters = 0  # of the last text

    def _ids(self, text: bytes) -> np.ndarray:
        """Own numbers of the letters, each run of other characters as one gap (0), a gap at both ends."""
        points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[points]
        self.letters = int(is_letter.sum())
        if not is_letter.any():
            return np.empty(0, np.int64)
        ids = self.code_of[points]
        if (new := is_letter & (ids < 0)).any():
            for c in np.unique(points[new]).tolist():
                self.codes.append(c)
                self.code_of[c] = len(self.codes)
            ids = self.code_of[points]
        ids = np.where(is_letter, ids, 0)
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] > 0) | (ids[:-1] > 0)
        ids = ids[keep]
        return np.pad(ids.astype(np.int64), (int(ids[0] > 0), int(ids[-1] > 0)))

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(keys) > self.most:
            self.rows.clear()
        get, out = self.rows.get, np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            row = get(key)
            if row is None:
                row = self.rows[key] = len(self.rows)
                while row >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                bound = np.ones(DIM, np.int8)
                for place in range(N):
                    own = key >> (21 * (N - 1 - place)) & 0x1FFFFF
                    bound = bound * np.roll(_vector(self.codes[own - 1] + 1 if own else 0), N - 1 - place)
                self.table[row] = bound
            out[i] = row
        return out

    def bundle(self, text: bytes | None) -> np.ndarray | None:
        """The text's vector, whole numbers; None if it has no letter."""
        ids = self._ids(text) if text else np.empty(0, np.int64)
        if not len(ids):
            return None
        if (k := len(self.codes) + 1) <= 64:
            packed = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
            counts = np.bincount(packed, minlength=1)
            seen = np.flatnonzero(counts)
            keys = ((seen // (k * k)) << 42) | ((seen // k % k) << 21) | (seen % k)
            counts = counts[seen]
        else:
            keys, counts = np.unique((ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:], return_counts=True)
        # sums of whole numbers: exact in float32 up to 2^24, so longer texts are summed in float64
        kind = np.float32 if counts.sum() < 1 << 24 else np.float64
        rows = self._rows(keys)  # may replace the table
        total = np.zeros(DIM, kind)
        for a in range(0, len(rows), BLOCK):
            total += counts[a : a + BLOCK].astype(kind) @ self.table[rows[a : a + BLOCK]].astype(kind)
        return total


def _train(batches):
    profiler, sums = Profiler(), {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), column_bytes(batch.column("text")), strict=True):
            if (v := profiler.bundle(text)) is not None:
                sums[lang] = sums.get(lang, 0) + v.astype(np.int64)
    langs = list(sums)
    yield pa.RecordBatch.from_arrays([pa.array([x for x in langs for _ in range(DIM)], pa.string()), pa.array(list(range(DIM)) * len(langs), pa.int32()), pa.array(np.concatenate([sums[x] for x in langs]) if langs else [], pa.int64())], names=["lang", "dim", "v"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_prototypes(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes as unit rows, from labelled rows that are not held out."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of lang")
    known = local(docs.sparkSession, [(r["lang"], per_lang / r["n"] * (1 << 30)) for r in counts], "known string, below double")
    share = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < F.col("below")
    sample = rows.join(F.broadcast(known), (F.col("lang") == F.col("known")) & share, "left_semi").select("lang", "text")
    sums = arrow(sample, _train, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    vectors: dict[str, np.ndarray] = {}
    for r in sums.collect():  # DIM rows for each language
        vectors.setdefault(r["lang"], np.zeros(DIM))[r["dim"]] = r["v"]
    langs = sorted(vectors)
    matrix = np.array([vectors[x] / (np.linalg.norm(vectors[x]) or 1.0) for x in langs]).reshape(len(langs), DIM)
    return langs, matrix


def _judge(langs: list[str], prototypes: np.ndarray):
    """texts -> (language, score, letters) of each; one profiler for each task, made where it runs."""
    held: list = []

    def judge(texts: list) -> list[tuple[str, float, int]]:
        if not held:
            held.extend((Profiler(), prototypes.T.copy()))
        profiler, columns = held
        out = []
        for text in texts:
            v = profiler.bundle(text) if langs else None
            if v is None:
                out.append((UNKNOWN, 0.0, 0))
                continue
            cosines = v @ columns / (float(np.sqrt(np.dot(v.astype(np.float64), v))) or 1.0)
            best = int(np.argmax(cosines))
            out.append((langs[best], float(np.clip(cosines[best], 0, 1)), profiler.letters))
        return out

    return judge


def _predict(langs: list[str], prototypes: np.ndarray):
    judge = _judge(langs, prototypes)

    def run(batches):
        for batch in batches:
            found = judge(column_bytes(batch.column("text")))
            kept = [batch.column(c) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the cosine, 0 to 1).

    A null text or one without a letter is 'und' with score 0; so is all if nothing can be
    learned. A null doc_id is not held out. Equal cosines go to the first language in code-point order.
    Repeated rows get equal predictions; an empty table gives no rows; other columns are not looked at."""
    langs, prototypes = train_prototypes(docs, per_lang)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(rows, _predict(langs, prototypes), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _reject(langs: list[str], prototypes: np.ndarray):
    judge = _judge(langs, prototypes)

    def run(batches):
        for batch in portions(batches):
            found = judge(column_bytes(batch.column("text")))
            keep = [lang != UNKNOWN and (score >= LEAST_SCORE or letters < LEAST_LETTERS) for lang, score, letters in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are in a learned language, with their own columns.

    The prediction decides: rejected are texts of ``LEAST_LETTERS`` letters and more whose best cosine is
    below ``LEAST_SCORE``, texts without a letter (null and empty ones among them), and all of them if nothing
    can be learned. Shorter texts bear too little evidence and stay. Repeated rows share a verdict; an empty
    table gives no rows."""
    return arrow(docs, _reject(*train_prototypes(docs)), docs.schema)
