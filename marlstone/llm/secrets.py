"""Secret scanning with an incremental blob ledger.

Every historical version of a path is content-addressed by SHA-256. The ledger is a Parquet table
that holds, for each blob and rule version, what the rules found; it is partitioned by rule version.
A run scans only the pairs that the ledger lacks, each blob once, appends them, and joins the findings
that it reads back to every path and version that has the blob.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, checkpoint, column_bytes, exists, remove, shared_dir, spread_join

#: Bump when a rule changes: blobs are then scanned again.
RULE_VERSION = "1"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "jwt")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_PEM = re.compile(rb"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,30}PRIVATE KEY-----")
_JWT = re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Keys (path and digest, about 100 bytes each) that are broadcast to choose the texts to scan, at most.
BROADCAST_KEYS = 200_000
LEDGER = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def find_secrets(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every finding in a UTF-8 text, in code points, sorted.

    Within a kind matches are leftmost and do not overlap; matches that are too short are dropped."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if b"PRIVATE KEY-----" in text:
        found += [(m.start(), 3, m.end()) for m in _PEM.finditer(text)]
    if b"eyJ" in text:
        found += [(m.start(), 4, m.end()) for m in _JWT.finditer(text)]
    if found and not text.isascii():
        at, known, last = {}, 0, 0
        for offset in sorted({x for s, _, e in found for x in (s, e)}):
            known += len(text[last:offset].decode("utf-8", "replace"))
            at[offset], last = known, offset
        found = [(at[s], k, at[e]) for s, k, e in found]
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _scan(rule_version: str):
    def run(batches):
        for batch in batches:
            found = [find_secrets(t) for t in column_bytes(batch.column("text"))]
            counts = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(3)]
            base = pa.array([joined([x for x in f if x[1] < 3]) for f in found], pa.string())
            arrays = [batch.column("blob"), pa.array([rule_version] * len(found), pa.string()), *counts, base, pa.array(list(map(joined, found)), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in LEDGER.split(", ")])

    return run


def blob_id(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, path: str, rule_version: str = RULE_VERSION) -> DataFrame | None:
    """The ledger's rows of one rule version, one per blob; None if the table is not there yet."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema(f"{LEDGER}").parquet(path).where(F.col("rule_version") == rule_version)
    return rows.dropDuplicates(["blob"])  # two runs at once may both have scanned a blob


def _unseen(keys: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """For each blob that the ledger lacks the one version (path) that is to be scanned."""
    first = keys.groupBy("blob").agg(F.min("path").alias("path"))
    return first if ledger is None else first.join(ledger.select("blob"), "blob", "left_anti")


def _picked(versions: DataFrame, keys: DataFrame, unseen: DataFrame) -> DataFrame:
    """The texts of the unseen blobs. A join by (path, blob) chooses the rows; where the rows to scan, or else
    the rows not to scan, are few enough to broadcast, no text moves for it. All ways give the same rows."""
    texts = versions.select("path", F.coalesce("text", F.lit("")).alias("text"), blob_id(F.col("text")).alias("blob")).alias("v")
    same = lambda side: F.col("v.path").eqNullSafe(F.col(f"{side}.path")) & (F.col("v.blob") == F.col(f"{side}.blob"))
    if (n := unseen.count()) == 0:
        return texts.limit(0)
    if n <= BROADCAST_KEYS:
        return texts.join(F.broadcast(unseen.alias("u")), same("u"), "left_semi")
    skipped = keys.alias("k").join(unseen.alias("u"), F.col("k.path").eqNullSafe(F.col("u.path")) & (F.col("k.blob") == F.col("u.blob")), "left_anti").distinct()
    if skipped.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return texts.join(F.broadcast(skipped.alias("s")), same("s"), "left_anti")
    return texts.join(unseen.alias("u").hint("shuffle_hash"), same("u"), "left_semi")


def update_ledger(versions: DataFrame, keys: DataFrame, path: str, rule_version: str = RULE_VERSION) -> None:
    """Scan what ``versions`` (path, text) has and the ledger table below ``path`` lacks, and append it.

    ``keys`` has path and blob of the same rows. A null text is an empty blob; a null path is a path; equal
    rows are scanned once or, where one path repeats a text, are equal findings, of which one is read back.
    Nothing unseen: nothing is written. Files become visible by Spark's commit, so a run that fails midway
    leaves the ledger as it was and the next one scans the same blobs."""
    spark = versions.sparkSession
    unseen = checkpoint(_unseen(keys, read_ledger(spark, path, rule_version)))
    if unseen.isEmpty() and exists(spark, path):
        return
    found = arrow(_picked(versions, keys, unseen), _scan(rule_version), LEDGER)
    found.write.mode("append").partitionBy("rule_version").parquet(path)


def findings(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger's findings joined back to every version (path, blob) of ``keys``."""
    known = checkpoint(ledger.join(keys.groupBy("blob").agg(F.count(F.lit(1)).alias("versions")), "blob"))
    total = known.agg(F.sum("versions")).head()[0] or 0
    return spread_join(keys, known, ["blob"], "versions", total, "path")


def scan_secrets(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings per document through the ledger table below ``path``, which is made or added to: doc_id,
    n_assign, n_access, n_hex, base_sha256, spans.

    A doc_id is a path, each of its texts a version. A null text is an empty blob; repeated rows and
    copies share one scan; an empty table gives no rows; other columns are not looked at."""
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    keys = checkpoint(versions.select("path", blob_id(F.col("text")).alias("blob")))
    update_ledger(versions, keys, path, rule_version)
    found = findings(keys, read_ledger(docs.sparkSession, path, rule_version))
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def scan_twice(docs: DataFrame) -> DataFrame:
    """``scan_secrets`` over a ledger of its own: the first run scans every blob, the second finds nothing
    unseen and answers from the table alone. The ledger is removed; the findings are kept by a checkpoint."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}"
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    keys = checkpoint(versions.select("path", blob_id(F.col("text")).alias("blob")))
    update_ledger(versions, keys, path)
    update_ledger(versions, keys, path)
    found = findings(keys, read_ledger(spark, path))
    done = checkpoint(found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans"))
    remove(spark, path)
    return done
