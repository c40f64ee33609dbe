"""Quality rules: per-document base rules and cross-document line frequency.

One pass over the texts measures each document and hashes its normalised lines. The rest works
on hashes: distinct documents are counted per host and line, lines above the host's limits are removed,
and a document that loses too large a share of its words is depleted. A second pass over the texts cuts
the lines out where the cleaned text is wanted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WordHashes, arrow, checkpoint, column_bytes, grams, spread_join

#: A line is boilerplate in more documents of a host than both of these, a number and a share of the host's.
LEAST_DOCS, HOST_SHARE = 20, 0.05
#: A document fails the base rules with fewer words, or more than this percentage of them in repeats.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A document is depleted when more than this share of its words stood in removed lines.
MOST_REMOVED = 0.5
SYMBOLS = b"#*$%&|<>"
#: Lines are compared in lower case with every digit as 0.
_FOLD = bytes(ord("0") if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Boilerplate lines (16 bytes each) that are broadcast, at most; beyond it they are joined by a shuffle.
BROADCAST_LINES = 500_000
_MEASURED = "doc_id long, host long, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_keys array<long>, line_words array<int>"


def repeat_words(hashes: np.ndarray, k: int = 8) -> int:
    """Words that stand in a window of ``k`` words found twice or more in the text."""
    g = grams(hashes, k)
    if len(g) < 2:
        return 0
    s = np.sort(g)
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    starts = np.flatnonzero(np.isin(g, s[1:][same]))
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _host(source: bytes | None) -> int:
    return xxhash.xxh64_intdigest(source if source is not None else b"", 1 if source is None else 0)


def _line_key(line: bytes, host: int) -> tuple[int, int]:
    """Hash of a normalised line of a host, and the line's words."""
    own = line.translate(_FOLD).split()
    return _signed(xxhash.xxh64_intdigest(b" ".join(own), host)), len(own)


def _measure(batches):
    hashes = WordHashes()
    for batch in batches:
        rows = [[] for _ in range(9)]
        for text, source in zip(column_bytes(batch.column("text")), column_bytes(batch.column("source")), strict=True):
            text = text or b""
            words = text.split()
            lines = [x for x in text.split(b"\n") if not x.isspace() and x]
            host = _host(source)
            counts: dict[int, int] = {}
            for line in lines:
                key, n = _line_key(line, host)
                counts[key] = counts.get(key, 0) + n
            row = (_signed(host), _signed(xxhash.xxh64_intdigest(text)), len(words), len(b"".join(words).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(hashes.of(words)), list(counts), list(counts.values()))
            for column, value in zip(rows, row, strict=True):
                column.append(value)
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [x.split()[0] for x in _MEASURED.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names=names)


def measure(docs: DataFrame) -> DataFrame:
    """One row per document with its base measures and line hashes, kept by a checkpoint."""
    return checkpoint(arrow(docs.select("doc_id", "text", "source"), _measure, _MEASURED))


def boilerplate_lines(measured: DataFrame) -> DataFrame:
    """(host, line) of the lines that stand in more documents of a host than the limits allow.

    Documents are told apart by doc_id: rows of one doc_id count once, as do all rows without one; copies
    with ids of their own count each."""
    lines = measured.select("host", "doc_id", F.explode("line_keys").alias("line")).distinct()
    frequent = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > LEAST_DOCS)
    hosts = measured.select("host", "doc_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return frequent.join(hosts, "host").where(F.col("docs") > F.col("host_docs") * HOST_SHARE).select("host", "line")


def _removed(measured: DataFrame) -> tuple[DataFrame, int]:
    """Per host and text with boilerplate lines: their hashes, their words, and the rows that have the text;
    and the sum of those rows. Verdicts go by text, as rows of one doc_id may have several."""
    lines = measured.select("host", "text_key", F.explode(F.arrays_zip("line_keys", "line_words")).alias("line"))
    lines = lines.select("host", "text_key", F.col("line.line_keys").alias("line"), F.col("line.line_words").alias("words")).distinct()
    found = checkpoint(boilerplate_lines(measured))
    if found.count() <= BROADCAST_LINES:
        found = F.broadcast(found)
    own = lines.join(found, ["host", "line"], "left_semi").groupBy("host", "text_key").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("gone"))
    copies = measured.groupBy("host", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    own = checkpoint(own.join(copies, ["host", "text_key"]))
    return own, own.agg(F.sum("copies")).head()[0] or 0


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the base measures, base_failed, kept, and the words in removed lines.

    A null text has no words and fails the base rules; a null source is a host of its own; a null doc_id is
    one document, whatever its rows; repeated rows get the same verdict. An empty table gives no rows."""
    measured = measure(docs)
    own, total = _removed(measured)
    rows = measured.drop("line_keys", "line_words")
    judged = spread_join(rows, own.drop("gone"), ["host", "text_key"], "copies", total, "doc_id").fillna(0, ["removed_words"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = F.col("removed_words") > MOST_REMOVED * F.col("n_words")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words")


def _with_keys(batches):
    for batch in batches:
        hosts = [_signed(_host(x)) for x in column_bytes(batch.column("source"))]
        keys = [_signed(xxhash.xxh64_intdigest(x or b"")) for x in column_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.int64()), pa.array(keys, pa.int64())], names=["row", "doc_id", "source", "text", "host", "text_key"])


def _cut_lines(batches):
    """Drops what fails the rules and cuts the removed lines out of the rest."""
    hashes = WordHashes()
    for batch in batches:
        keep, texts = [], []
        rows = zip(column_bytes(batch.column("text")), column_bytes(batch.column("source")), batch.column("gone").to_pylist(), batch.column("removed_words").to_pylist(), strict=True)
        for text, source, gone, removed in rows:
            words = (text or b"").split()
            failed = len(words) < LEAST_WORDS or 100 * repeat_words(hashes.of(words)) > MOST_REPEATED * len(words)
            keep.append(not failed and (removed or 0) <= MOST_REMOVED * len(words))
            if keep[-1] and gone:
                own, host = set(gone), _host(source)
                text = b"\n".join(x for x in text.split(b"\n") if not x or x.isspace() or _line_key(x, host)[0] not in own)
            texts.append(text)
        done = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "text"])
        yield done.filter(pa.array(keep, pa.bool_()))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns, the boilerplate lines cut out of the text.

    Other lines and blank ones stay as they are. Nulls, repeated rows, copies and empty tables as in
    ``quality_rules``. Texts move once, by a hash of host and text, hot texts dealt out by doc_id."""
    own, total = _removed(measure(docs))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", "text")
    keyed = arrow(packed, _with_keys, StructType([*packed.schema.fields, StructField("host", LongType()), StructField("text_key", LongType())]))
    rows = spread_join(keyed, own, ["host", "text_key"], "copies", total, "doc_id").select("row", "source", "text", "removed_words", "gone")
    cut = arrow(rows, _cut_lines, StructType([packed.schema["row"], packed.schema["text"]]))
    return cut.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
