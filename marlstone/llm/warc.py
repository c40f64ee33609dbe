"""WARC archives through a chunked record table.

Pages become rows of record identifier and chunk number, no chunk larger than ``CHUNK`` bytes, before
anything is shuffled: no row that is moved, and no Arrow batch, holds a whole oversized record. On the
other side each row gets the running digest of the payload up to its end and is written as one WARC
record: a payload of several chunks is a segmented record (WARC-Segment-Number, continuation
records), so neither writer nor reader ever holds a whole oversized record. The files are
written and read by Spark's own text source with the WARC record end as line separator, so
they can lie in any store that Spark reaches; gzip makes a file one unsplit stream.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, checkpoint, remove, shared_dir, spread_join

#: Bytes of payload in one chunk, and of the smallest payload that is stored once only.
CHUNK, LEAST_SHARED = 1 << 20, 100
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CHUNKS = "record string, page_id long, uri string, chunk int, n_chunks int, total long, digest string, refers_to long, refers_record string, running string, piece binary"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """The identifier of the first of the records that are equal in all three."""
    return F.concat(F.lit("urn:sha256:"), F.sha2(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), url, digest), 256))


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.octet_length(payload).cast("long").alias("total"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))


def plan_records(pages: DataFrame) -> DataFrame:
    """Per distinct page_id, url and digest: the total, and the page and the record that a revisit refers to
    (null: it is a response). No payload is moved.

    The first of equal payloads is the one with the smallest page_id; rows that share it are all
    responses, and a revisit refers to the one with the smallest url. A null page_id comes after all others
    and refers only where another page has one; a null html is an empty payload, a null url an empty one; no
    pages give no rows."""
    keys = checkpoint(_payloads(pages).select("page_id", "url", "total", "digest").distinct())
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = keys.where(F.col("total") >= LEAST_SHARED).groupBy("digest").agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("n"))
    first = checkpoint(first.where("n > 1"))
    shared = spread_join(keys, first, ["digest"], "n", first.agg(F.sum("n")).head()[0] or 0, "page_id")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    record = _record_id(F.col("first.page_id"), F.col("first.url"), F.col("digest"))
    return shared.select("page_id", "url", "total", "digest", F.when(other, F.col("first.page_id")).alias("refers_to"), F.when(other, record).alias("refers_record"))


def _running(batches):
    """Adds the running digest and numbers records that are equal in page, url and payload; the chunks of a
    record come one after another."""
    state, at, nth = None, None, 0
    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    for batch in batches:
        running, records = [], []
        for record, chunk, piece in zip(batch.column("record").to_pylist(), batch.column("chunk").to_pylist(), batch.column("piece"), strict=True):
            if chunk == 0:
                state = hashlib.sha256()
                at, nth = record, nth + 1 if record == at else 0
            state.update(piece.as_py())
            running.append(state.hexdigest())
            records.append(f"{record}:copy-{nth}" if nth else record)
        columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)} | {"running": pa.array(running, pa.string()), "record": pa.array(records, pa.string())}
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def chunk_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of each record, in order; a revisit has one empty chunk.

    Record identifiers are unique: of rows that are equal in page_id, url and payload the second and further
    ones are numbered. Nulls as in ``plan_records``; no pages give no rows."""
    rows = _payloads(pages).withColumn("row", F.monotonically_increasing_id())
    n_chunks = F.greatest(F.ceil(F.col("total") / chunk), F.lit(1)).cast("int")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
    piece = F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk))
    pieces = rows.select("page_id", "url", "digest", "row", "chunk", piece.alias("piece")).alias("c")
    plan = plan_records(pages).alias("p")
    same = F.col("c.page_id").eqNullSafe(F.col("p.page_id")) & (F.col("c.url") == F.col("p.url")) & (F.col("c.digest") == F.col("p.digest"))
    response = F.col("refers_to").isNull()
    both = pieces.join(plan.hint("shuffle_hash"), same).where(response | (F.col("chunk") == 0))
    uri = F.regexp_replace("c.url", r"[\x00-\x20\x7F]", "%20")
    record = _record_id(F.col("c.page_id"), F.col("c.url"), F.col("c.digest"))
    own = F.when(response, F.greatest(F.ceil(F.col("total") / chunk), F.lit(1))).otherwise(1).cast("int")
    out = both.select(record.alias("record"), "c.page_id", uri.alias("uri"), "row", "chunk", own.alias("n_chunks"), "total", "c.digest", "refers_to", "refers_record", F.when(response, F.col("piece")).otherwise(F.lit(b"")).alias("piece"))
    return arrow(out.sortWithinPartitions("record", "row", "chunk"), _running, _CHUNKS)


def _records(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            first, several = r["chunk"] == 0, r["n_chunks"] > 1
            revisit = r["refers_to"] is not None
            head = [("WARC-Type", "revisit" if revisit else "response" if first else "continuation")]
            head.append(("WARC-Record-ID", f"<{r['record']}>" if first else f"<{r['record']}:{r['chunk']}>"))
            head += [("WARC-Date", DATE), ("WARC-Target-URI", r["uri"])]
            if r["page_id"] is not None:
                head.append(("X-Page-ID", str(r["page_id"])))
            head.append(("X-Running-Digest", f"sha256:{r['running']}"))
            if first:
                head += [("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("X-Payload-Length", str(r["total"]))]
            if revisit:
                head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{r['refers_record']}>"), ("X-Refers-To-Page-ID", str(r["refers_to"]))]
            if several:
                head.append(("WARC-Segment-Number", str(r["chunk"] + 1)))
                if not first:
                    head.append(("WARC-Segment-Origin-ID", f"<{r['record']}>"))
                if r["chunk"] == r["n_chunks"] - 1:
                    head.append(("WARC-Segment-Total-Length", str(r["total"] + len(HTTP))))
            block = HTTP + r["piece"] if first else r["piece"]
            head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
            out.append("WARC/1.1\r\n".encode() + "\r\n".join(f"{k}: {v}" for k, v in head).encode() + END + block)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warc(pages: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Write one record per page into gzip files below ``path``.

    Repeated rows are records of their own with identifiers of their own; nulls as in ``plan_records``; no
    pages give an archive without records; columns other than page_id, url and html are not looked at."""
    records = arrow(chunk_table(pages, chunk), _records, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


class RecordReader:
    """Parses a WARC byte stream piece by piece; gives a row for each whole record."""

    def __init__(self):
        self.buffer, self.need, self.head = b"", None, {}
        self.open = None  # the segmented or plain response being read

    def feed(self, data: bytes) -> list[tuple]:
        self.buffer += data
        done = []
        while True:
            if self.need is None:
                at = self.buffer.find(END)
                if at < 0:
                    return done
                version, *lines = self.buffer[:at].decode().split("\r\n")
                if not version.startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {version[:60]!r}")
                self.head = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
                self.need, self.buffer = int(self.head["content-length"]), self.buffer[at + 4 :]
            if len(self.buffer) < self.need + 4:
                return done
            block, self.buffer, self.need = self.buffer[: self.need], self.buffer[self.need + 4 :], None
            if (row := self._block(block)) is not None:
                done.append(row)

    def _block(self, block: bytes):
        head = self.head
        page = int(head["x-page-id"]) if "x-page-id" in head else None
        if head["warc-type"] == "revisit":
            return page, int(head["x-payload-length"]), head["warc-payload-digest"].partition(":")[2], "revisit", int(head["x-refers-to-page-id"])
        if head["warc-type"] == "response":
            self.open = {"page": page, "digest": head["warc-payload-digest"].partition(":")[2], "sha": hashlib.sha256(), "n": 0}
            block = block[block.index(END) + 4 :]
        own = self.open
        own["sha"].update(block)
        own["n"] += len(block)
        running = own["sha"].hexdigest()
        if head["x-running-digest"] != f"sha256:{running}":
            raise ValueError(f"damaged chunk of page {own['page']}")
        if "warc-segment-number" in head and "warc-segment-total-length" not in head:
            return None
        if running != own["digest"]:
            raise ValueError(f"damaged payload of page {own['page']}")
        return own["page"], own["n"], running, "response", None


def _read(batches):
    reader, at = RecordReader(), None
    for batch in batches:
        rows = []
        for file, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if file != at:
                reader, at = RecordReader(), file
            rows += reader.feed(value + END)
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _RECORDS.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, digests checked (damage is an error); segmented records are put together as a
    stream. A record without a page has a null page_id; an archive without records gives no rows."""
    pieces = spark.read.option("lineSep", END.decode()).text(path)
    return arrow(pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")), _read, _RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and give one row per record: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Nulls, ties, repeated rows and empty tables as in ``plan_records`` and ``write_warc``."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    read = checkpoint(read_warc(spark, path))
    remove(spark, path)
    return read
