"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and verified Hamming distances.

Only distinct fingerprints are linked. Each is dealt to tables by the bits of some of its
blocks; fingerprints that share a key in some table are compared. In a group nothing is
paired out: first all are compared with the smallest, which joins most of a group at one
comparison a row. Then those of different components meet; a search from one fingerprint to
all that are not yet reached leaves a spanning forest of their links. Large groups are cut
into parts, of which two that the stars have joined already do not meet.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, checkpoint, column_bytes, mix, portions, shuffle_partitions, spread_join
from .components import components

#: Fingerprints of one part of a large group.
PART = 4096
#: Keys made at once.
KEYS = 100_000
#: Tables, at most, whose groups are joined by stars before all tables are searched.
FIRST = 8
_LANE = np.uint64(0xD1B54A32D192ED03)


def pigeonhole_tables(bits: int, blocks: int, most: int) -> list[np.ndarray]:
    """Bit positions of each table. With ``most`` differing bits, at least blocks - most blocks agree,
    so every choice of that many blocks is a table and no close pair is missed."""
    cut = np.array_split(np.arange(bits), blocks)
    return [np.concatenate(c) for c in combinations(cut, blocks - most)]


def sampled_tables(bits: int, width: int, n_tables: int, seed: int = 17) -> list[np.ndarray]:
    """Blocks of ``width`` bits: the fingerprint cut in order, then cut again under other bit orders."""
    out, order, rng = [], np.arange(bits), np.random.default_rng(seed)
    while len(out) < n_tables:
        out += [order[i : i + width] for i in range(0, bits - width + 1, width)]
        order = rng.permutation(bits)
    return out[:n_tables]


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set; eight byte counters to a word."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of all runs of ``k`` words, A-Z lower-cased, joined by one space; of the whole
    sequence if it is shorter; nothing without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[k - 1 :].tolist() or [len(joined)]
    hash_ = xxhash.xxh64_intdigest
    return np.fromiter((hash_(joined[a:b], 42) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))


def fingerprint(text: bytes | None, k: int = 4, bits: int = 64) -> bytes:
    """Bit i (little-endian) is 1 if over half of the shingle hashes have it. Wider fingerprints take
    further bits from scrambled hashes; the first 64 are the same."""
    h = shingle_hashes(text or b"", k)
    return _print(h, bits) if len(h) else bytes(bits // 8)


def _print(h: np.ndarray, bits: int) -> bytes:
    with np.errstate(over="ignore"):
        lanes = [2 * bit_counts(mix(h ^ (_LANE * np.uint64(i))) if i else h) > len(h) for i in range(bits // 64)]
    return np.packbits(np.concatenate(lanes), bitorder="little").tobytes()


def _fingerprints(k: int, bits: int):
    def run(batches):
        for batch in batches:
            found = [fingerprint(t, k, bits) for t in column_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "fp"])

    return run


def fingerprint_documents(docs: DataFrame, k: int = 4, bits: int = 64) -> DataFrame:
    """(doc_id, fp) of every row. A text without words (null, empty) has fingerprint zero; a null doc_id stays
    null; repeated rows stay; an empty table gives no rows."""
    return arrow(docs.select("doc_id", "text"), _fingerprints(k, bits), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp binary")


def _lanes(column: pa.Array) -> np.ndarray:
    raw = b"".join(column_bytes(column))
    return np.frombuffer(raw, np.uint64).reshape(len(column), -1)


def _keys(tables: list[np.ndarray]):
    step = max(1, KEYS // max(len(tables), 1))

    def run(batches):
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
            bits = np.unpackbits(_lanes(batch.column("fp")).view(np.uint8), axis=1, bitorder="little")
            keys = [bits[:, t].astype(np.int64) @ (1 << np.arange(len(t), dtype=np.int64)) + (i << 40) for i, t in enumerate(tables)]
            names = [x for x in batch.schema.names if x != "fp"]
            kept = [np.tile(batch.column(x).to_numpy(zero_copy_only=False), len(tables)) for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keys), *kept)], names=["key", *names])

    return run


def spanning_edges(fps: np.ndarray, ids: np.ndarray, most: int) -> tuple[list, list]:
    """A spanning forest of the links (at most ``most`` differing bits) among the given fingerprints."""
    a, b, rest = [], [], np.arange(len(ids))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]).sum(1, dtype=np.int64) <= most
            if near.any():
                new, rest = rest[near], rest[~near]
                a += [ids[x]] * len(new)
                b += ids[new].tolist()
                queue += new.tolist()
    return a, b


def _between(a: list, b: list) -> pa.RecordBatch:
    """The distinct links (u, v) between different components."""
    pairs = np.array([a, b], np.int64).T.reshape(-1, 2)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _search(most: int):
    """Links (u, v) of the components c that rows of one group have; rows come sorted by group."""

    def edges(group, names, fps):
        cuts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)])) if len(group) else np.empty(0, np.int64)
        sizes = np.diff(np.append(cuts, len(group)))
        two = cuts[sizes == 2]
        close = np.bitwise_count(fps[two] ^ fps[two + 1]).sum(1, dtype=np.int64) <= most
        a, b = names[two][close].tolist(), names[two + 1][close].tolist()
        for s, n in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = spanning_edges(fps[s : s + n], names[s : s + n], most)
            a += x
            b += y
        return _between(a, b)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "p", "q")], axis=1)
            rows = [group, batch.column("c").to_numpy(zero_copy_only=False), _lanes(batch.column("fp"))]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            last = np.flatnonzero((rows[0] != rows[0][-1]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0
            yield edges(*(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
        if held is not None:
            yield edges(*held)

    return run


def _near(most: int):
    """Links (u, v) of rows (id, fp, hub, hub_fp)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            close = np.bitwise_count(_lanes(batch.column("fp")) ^ _lanes(batch.column("hub_fp"))).sum(1, dtype=np.int64) <= most
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hub")], names=["u", "v"]).filter(pa.array(close))

    return run


def _stars(keys: DataFrame, values: DataFrame, value: str, near) -> DataFrame:
    """(id, c): each id of ``values`` with the component that the links of every key's rows (key, id) to the
    smallest id of that key give. One comparison a row, so a large group costs no more than its rows."""
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = checkpoint(hubs.join(values.select(F.col("id").alias("hub"), F.col(value).alias(f"hub_{value}")), "hub"))
    total = hubs.agg(F.sum("n")).head()[0] or 0
    rows = spread_join(keys, hubs, ["key"], "n", total, "id").where("hub <> id").drop("key")
    # an exchange of its own also where every join is a broadcast: a kernel that feeds another one in its task takes
    # twice the workers, which stay
    rows = rows.repartition(shuffle_partitions(keys.sparkSession), "id").join(values.select("id", value), "id")
    found = components(arrow(rows.select("id", value, "hub", f"hub_{value}"), near, "u long, v long"))
    return checkpoint(values.select("id").distinct().join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("c")))


def _deal(keys: DataFrame, values: DataFrame, part: int) -> DataFrame:
    """Rows (key, p, q, id, c, ...) of all keys (key, id, c) that two or more components c have, with the columns
    of ``values`` by id; of a key's rows every two of different components stand together somewhere, sorted.

    The rows of a large key are cut into parts. Those of its largest component meet the others only."""
    spark, rows = keys.sparkSession, F.count(F.lit(1))
    # one exchange serves the statistics and the rows; the statistics name all columns, so that neither is narrowed;
    # most rows are components of their own, for which a null goes the way
    keys = keys.select("key", "id", F.nullif("c", "id").alias("c")).repartition(shuffle_partitions(spark), "key").withColumn("c", F.coalesce("c", "id"))
    shared = keys.groupBy("key").agg(F.count("id").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    found = checkpoint(keys.join(shared.select("key", "n").hint("shuffle_hash"), "key"))
    sizes = found.where(F.col("n") > part).groupBy("key", "c").agg(rows.alias("m"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("m", "c")).alias("s")).select("key", F.col("s.m").alias("m"), F.col("s.c").alias("main"))
    found = found.join(largest, "key", "left")
    others, mains = (F.coalesce(F.ceil(x / part), F.lit(least)).cast("int") for x, least in ((F.col("n") - F.col("m"), 1), (F.col("m"), 0)))
    is_main = F.coalesce(F.col("c") == F.col("main"), F.lit(False))
    place = F.xxhash64("id", F.lit(5))
    own = F.when(is_main, others + F.pmod(place, mains)).otherwise(F.pmod(place, others)).cast("int")
    last = F.when(is_main, others - 1).otherwise(others + mains - 1)
    dealt = found.select("key", "id", "c", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "id", "c").join(values, "id")
    return dealt.repartition(shuffle_partitions(spark), "key", "p", "q").sortWithinPartitions("key", "p", "q", "id")


def link_fingerprints(fps: DataFrame, tables: list[np.ndarray] | Callable[[int], list[np.ndarray]], most: int, part: int = PART) -> DataFrame:
    """(fp, component_id, rows) of every distinct fingerprint of ``fps`` (doc_id, fp), ``rows`` being how many
    have it.

    Links join fingerprints of at most ``most`` differing bits that share a key in some table; a
    component's id is its smallest doc_id."""
    # not merged into few partitions: each row becomes as many keys as there are tables
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    distinct = checkpoint(distinct.repartition(shuffle_partitions(fps.sparkSession), "fp"))
    tables = tables(distinct.count()) if callable(tables) else tables
    known = distinct.where("id is not null")
    # what a few tables join already is not compared again
    own = _stars(arrow(known.select("id", "fp"), _keys(tables[:FIRST]), "key long, id long"), known, "fp", _near(most))
    keys = arrow(known.select("id", "fp").join(own, "id"), _keys(tables), "key long, id long, c long")
    links = arrow(_deal(keys, known.select("id", "fp"), part), _search(most), "u long, v long")
    labels = components(links.unionByName(own.select(F.col("id").alias("u"), F.col("c").alias("v"))))
    named = distinct.join(labels, F.col("id") == F.col("node"), "left")
    return named.select("fp", F.coalesce("component", "id").alias("component_id"), "rows")


def blocks_for(n: int, most: int = 4, bits: int = 64) -> int:
    """Number of blocks for ``n`` distinct fingerprints: the fewest, but two more than ``most`` at least, whose
    keys have few chance neighbours (a key's bits are at least log2 n - 2). Any number of blocks finds every
    close pair, so this changes the cost only."""
    blocks = most + 2
    while blocks < 2 * most + 4 and (blocks - most) * (bits // blocks) < n.bit_length() - 2:
        blocks += 1
    return blocks


def simhash_components(docs: DataFrame, k: int = 4, most: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    A text without words (null, empty) has fingerprint zero and links like any other. A document
    with a null doc_id gets the smallest doc_id that its fingerprint reaches, null if there is
    none. Repeated rows stay; an empty table gives no rows."""
    fps = checkpoint(fingerprint_documents(docs, k, 64))
    labels = checkpoint(link_fingerprints(fps, lambda n: pigeonhole_tables(64, blocks or blocks_for(n, most), most), most))
    total = labels.agg(F.sum("rows")).head()[0] or 0
    # stored little-endian, shown as a number
    digits = F.lower(F.hex("fp"))
    number = F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2)))
    return spread_join(fps, labels, ["fp"], "rows", total, "doc_id").select("doc_id", number.alias("fingerprint"), "component_id")


#: Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
#: Fingerprints only choose the candidates: for a similarity J the angle is acos(2J / (1 + J)), so
#: 0.8 is 15.1 % of 1,024 differing bits with a standard deviation of 1.1 %; 19 % leaves out one pair
#: in thousands, and 235 blocks of 24 bits are shared by 98.6 % of the pairs at 0.8 or more.
#: ``wide_for`` gives the width and number of blocks for larger corpora.
WIDE = {"k": 5, "bits": 1024, "width": 24, "tables": 235, "share": 0.19}
#: Sets of at most so many shingles are too small for fingerprints and are found by common shingles.
SHORT = 32
#: Document ids (about 24 bytes each) that are broadcast, at most.
BROADCAST_IDS = 2_000_000
#: Texts of one part of a large group whose shingles are compared.
SET_PART = 256
#: Sets of up to so many bytes are compared with one of their group first; of these at most ``HOT`` are broadcast.
STAR_BYTES = 65_536


def wide_for(n: int, recall: float = 0.986) -> dict:
    """Parameters for ``n`` distinct long sets: blocks so wide that a key has at most about 32 chance neighbours,
    24 bits at least, and so many of them that a pair at 0.8 shares one with probability ``recall``. More
    sets need wider blocks and more tables; what is found stays the same in kind."""
    width = max(WIDE["width"], n.bit_length() - 5)
    agree = (1 - 0.1514) ** width
    return WIDE | {"width": width, "tables": max(WIDE["tables"], int(np.ceil(np.log(1 - recall) / np.log1p(-agree))))}


def _set_key(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _sketches(k: int, bits: int):
    """Of each text the key of its set of shingles, and the fingerprint of a long set or the shingles of a
    short one; sets that may match either kind have both."""

    def run(batches):
        for batch in portions(batches):
            ids, fps, sets = [], [], []
            for text in column_bytes(batch.column("text")):
                own = np.unique(shingle_hashes(text, k))
                ids.append(_set_key(own))
                fps.append(_print(own, bits) if len(own) > SHORT else None)
                sets.append(own.tobytes() if 4 * len(own) <= 5 * SHORT else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.int64()), pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "id", "fp", "shingles"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in portions(batches):
            sets = [np.unique(shingle_hashes(t, k)) for t in column_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "shingles"])

    return run


def _join_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by doc_id; texts move only where there are more ids than a task takes."""
    ids = checkpoint(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash"), "doc_id", how)


def _first_shingles(batches):
    """The first fifth (and one more) of each sorted set: two sets at 0.8 or more have one of these in common."""
    for batch in batches:
        own = [np.frombuffer(x, np.int64) for x in column_bytes(batch.column("shingles"))]
        own = [x[: len(x) // 5 + 1] for x in own]
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), [len(x) for x in own])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *own])), pa.array(ids)], names=["key", "id"])


def similar_edges(sets: list[np.ndarray], ids: list) -> tuple[list, list]:
    """A spanning forest of the links (Jaccard similarity of 0.8 or more) among the given sets."""
    a, b, sizes = [], [], np.array([len(x) for x in sets])
    known, values = np.unique(np.concatenate(sets), return_inverse=True)
    owner, ends = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes)
    own, rest, first = values, np.ones(len(sets), bool), 0
    while rest.any():
        first += int(np.argmax(rest[first:]))
        queue = [first]
        rest[first] = False
        while queue and rest.any():
            x = queue.pop()
            mark = np.zeros(len(known), bool)
            mark[own[ends[x] - sizes[x] : ends[x]]] = True
            common = np.bincount(owner[mark[values]], minlength=len(sets))
            near = np.flatnonzero(rest & (9 * common >= 4 * (sizes + sizes[x])))
            if len(near):
                a += [ids[x]] * len(near)
                b += [ids[i] for i in near]
                queue += near.tolist()
                rest[near] = False
                values, owner = values[rest[owner]], owner[rest[owner]]
    return a, b


def _alike(batches):
    """Links (u, v) of rows (id, shingles, hub, hub_shingles)."""
    for batch in batches:
        pairs = zip(column_bytes(batch.column("shingles")), column_bytes(batch.column("hub_shingles")), strict=True)
        pairs = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs)
        close = [9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hub")], names=["u", "v"]).filter(pa.array(close, pa.bool_()))


def _compare(batches):
    """Links (u, v) of the components c that rows of one group (key, p, q) have; rows come sorted by group."""
    held, names, sets = None, [], []
    for batch in batches:
        a, b = [], []
        groups = zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q")), strict=True)
        for group, c, own in zip(groups, batch.column("c").to_pylist(), column_bytes(batch.column("shingles")), strict=True):
            if group != held:
                if len(names) > 1:
                    x, y = similar_edges(sets, names)
                    a, b = a + x, b + y
                held, names, sets = group, [], []
            names.append(c)
            sets.append(np.frombuffer(own, np.uint64))
        yield _between(a, b)
    yield _between(*(similar_edges(sets, names) if len(names) > 1 else ([], [])))


def similar_documents(docs: DataFrame, wide: dict | None = None) -> DataFrame:
    """Rows (doc_id, least) of the documents with words and a doc_id: the smallest doc_id of those that a
    chain of near-duplicates joins.

    Fingerprints give groups of candidates; within a group, and among short sets that have one of their
    first shingles in common, the sets themselves are compared."""
    chosen, wide = wide, wide or WIDE
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = checkpoint(arrow(texts, _sketches(wide["k"], wide["bits"]), f"doc_id {kind}, id long, fp binary, shingles binary"))
    # whole numbers name fingerprints by doc_id, which is shorter on the way than the key of the set
    name = F.col("doc_id").cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.col("id")
    fps = sketches.where("fp is not null").select(name.alias("doc_id"), "fp")
    tables = lambda n: sampled_tables(wide["bits"], (chosen or wide_for(n))["width"], (chosen or wide_for(n))["tables"])
    labels = link_fingerprints(fps, tables, int(wide["share"] * wide["bits"]))
    named = sketches.where("fp is not null").groupBy("id").agg(F.any_value("fp").alias("fp"), F.min("doc_id").alias("doc_id"))
    named = named.join(labels, "fp").select(F.col("component_id").alias("key"), "id", "doc_id")
    several = named.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    groups = checkpoint(named.join(several, "key"))
    # one text of each set of a group; a doc_id may have other texts too
    sets = arrow(_join_ids(texts, groups.select("doc_id").distinct(), "left_semi"), _sets(wide["k"]), "id long, shingles binary")
    sets = sets.join(groups.select("id"), "id", "left_semi").dropDuplicates(["id"])
    sets = checkpoint(sets)
    few = sets.where(F.length("shingles") <= STAR_BYTES)
    stars = _stars(groups.select("key", "id").join(few.select("id"), "id", "left_semi"), few, "shingles", _alike)
    grouped = groups.select("key", "id").join(stars, "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
    long_edges = arrow(_deal(grouped, sets, SET_PART), _compare, "u long, v long")
    long_edges = long_edges.unionByName(stars.select(F.col("id").alias("u"), F.col("c").alias("v")))
    short = sketches.where("shingles is not null").groupBy("id").agg(F.any_value("shingles").alias("shingles"))
    short_edges = arrow(_deal(arrow(short, _first_shingles, "key long, id long").withColumn("c", F.col("id")), short, SET_PART), _compare, "u long, v long")
    joined = components(long_edges.unionByName(short_edges))
    members = sketches.select("doc_id", "id").join(joined, F.col("id") == F.col("node"), "left")
    members = checkpoint(members.select("doc_id", F.coalesce("component", "id").alias("component")))
    return members.join(members.groupBy("component").agg(F.min("doc_id").alias("least")), "component").select("doc_id", "least")


def drop_near_duplicates(docs: DataFrame, wide: dict | None = None) -> DataFrame:
    """The documents without those that have a near-duplicate chain to a smaller doc_id. Texts without
    words are no copies of one another and stay, as do rows with a null doc_id; rows of one doc_id
    stay or go together. Empty tables give no rows; ``wide`` fixes the blocks that ``wide_for`` else chooses."""
    gone = similar_documents(docs, wide).where("doc_id > least").select("doc_id").distinct()
    return _join_ids(docs, gone, "left_anti").select(*docs.columns)
