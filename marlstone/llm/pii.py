"""Personal data (native: SQL functions only on the main path).

Base detectors find e-mail addresses, IP addresses, card numbers and phone numbers. On top of
them works an information-theoretic sanitiser: over all documents of the corpus it counts
how often a term stands together with a protected entity. With IC(e) = -log2 p(e) the
information that an entity carries and PMI(e, t) = log2 p(e, t) / (p(e) p(t)) what a term tells
about it, a term whose PMI reaches the disclosure share of IC reveals the entity, and its
occurrences in texts with that entity become spans too. Every entity is protected, however
few texts have it: for one of a single text these are the terms that hardly any other has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, spread_join

KINDS = ("email", "ip", "card", "phone", "term")
#: The share of IC that a term may not reach.
DISCLOSURE = 0.9
#: Candidate terms that are broadcast to the count over the corpus, at most (a few dozen bytes each).
BROADCAST_TERMS = 200_000
#: Same matches as the plain patterns, in linear time: possessive, and begun only where the last
#: match ended or a run begins.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    backwards = F.reverse(digits)
    values = F.transform(places, lambda i: backwards.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a match stands; those that fail are dropped, nothing else is tried in their place."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 1, match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == 2, F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == 3, n.between(9, 15))
        .otherwise(True)
    )


def located(texts: DataFrame, patterns: dict[int, tuple[str, Column]], keep: list[str]) -> DataFrame:
    """Rows (*keep, kind, start, end, match) of all matches, leftmost and without overlap, offsets in
    code points. ``patterns``: kind -> (pattern, whether a text can match at all).

    SQL gives matches without their places; what stands between them gives the places. Equal
    rows count once."""
    text = F.col("text")
    found = [
        F.when(
            may,
            F.struct(
                F.lit(kind).alias("kind"),
                F.transform(F.split(text, pattern, -1), lambda s: F.length(s)).alias("gaps"),
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
            ),
        )
        for kind, (pattern, may) in patterns.items()
    ]
    each = texts.select(*keep, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull() & (F.size(x["matches"]) > 0))).alias("f"))
    each = each.select(*keep, "f.kind", "f.gaps", F.posexplode("f.matches").alias("i", "match"))
    each = each.select(*keep, "kind", "i", F.element_at("gaps", F.col("i") + 1).alias("gap"), "match").distinct()
    upto = Window.partitionBy(*keep, "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    return each.withColumn("end", end).select(*keep, "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a 128-bit key of the text, and the text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), F.length(text), text).alias("k2"), text.alias("text"))


def _may_match(keyed: DataFrame) -> DataFrame:
    """The few texts in which anything can match at all, so that no other text is moved."""
    return keyed.where(F.col("text").contains("@") | F.col("text").rlike("[0-9]"))


def base_matches(keyed: DataFrame) -> DataFrame:
    """Valid base matches of each distinct text: k1, k2, kind, start, end, match."""
    digit, text = F.col("digit"), F.col("text")
    may = _may_match(keyed).select("k1", "k2", "text", text.contains("@").alias("at"), text.rlike("[0-9]").alias("digit"))
    patterns = {
        0: (PATTERNS["email"], F.col("at")),
        1: (PATTERNS["ip"], digit & text.contains(".")),
        2: (PATTERNS["card"], digit),
        3: (PATTERNS["phone"], digit & text.contains("+")),
    }
    return located(may, patterns, ["k1", "k2"]).where(valid(F.col("kind"), F.col("match")))


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def disclosing_terms(keyed: DataFrame, keys: DataFrame, base: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """Rows (k1, k2, term): the terms that reveal an entity of that text.

    Probabilities are shares of all documents. Entities of the same texts have the same counts with
    every term and are taken as one, so a list of addresses is not paired with its words."""
    n_docs = F.lit(float(max(1, keys.count())))
    entities = base.select("k1", "k2", F.xxhash64("kind", F.lower("match")).alias("e")).distinct()
    alike = entities.groupBy("e").agg(F.xxhash64(F.count(F.lit(1)), F.bit_xor("k1"), F.bit_xor("k2")).alias("same"))
    copies = keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    entities = entities.join(alike, "e").select("k1", "k2", F.col("same").alias("e")).distinct()
    entities = checkpoint(entities.join(copies, ["k1", "k2"]))
    e_docs = entities.groupBy("e").agg(F.sum("copies").alias("e_docs"))
    words = F.array_distinct(F.regexp_extract_all(_lower(F.col("text")), F.lit(TERM), F.lit(0)))
    exposed = _may_match(keyed).join(entities.select("k1", "k2").distinct().hint("shuffle_hash"), ["k1", "k2"], "left_semi")
    near = checkpoint(exposed.select("k1", "k2", F.explode(words).alias("term")).distinct())
    pairs = near.join(entities, ["k1", "k2"]).groupBy("e", "term").agg(F.sum("copies").alias("both"))
    ic = -F.log2(F.col("e_docs") / n_docs)
    reveals = lambda docs: F.log2(F.col("both") * n_docs / (F.col("e_docs") * F.col(docs))) >= disclosure * ic
    # the documents with an entity alone hold many a term too often; only the others are counted in all
    texts = entities.select("k1", "k2", "copies").distinct()
    least = near.join(texts, ["k1", "k2"]).groupBy("term").agg(F.sum("copies").alias("least_docs"))
    pairs = checkpoint(pairs.join(e_docs, "e").where(ic > 0).join(least, "term").where(reveals("least_docs")))
    terms = pairs.select("term").distinct()
    counted = keyed.select(F.explode(words).alias("term"))
    if terms.count() <= BROADCAST_TERMS:  # a bounded table; beyond it all terms are counted
        counted = counted.join(F.broadcast(terms), "term", "left_semi")
    counted = counted.groupBy("term").agg(F.count(F.lit(1)).alias("t_docs"))
    revealing = pairs.join(counted, "term").where(reveals("t_docs")).select("e", "term")
    return near.join(entities.select("k1", "k2", "e"), ["k1", "k2"]).join(revealing, ["e", "term"], "left_semi").select("k1", "k2", "term").distinct()


def _text_spans(keyed: DataFrame, disclosure: float) -> tuple[DataFrame, DataFrame]:
    """Spans (start, kind, end) of each distinct text that has any, with its number of copies: k1, k2, base, all,
    copies; and the keys (doc_id, k1, k2) of all rows."""
    keys = checkpoint(keyed.select("doc_id", "k1", "k2"))
    base = checkpoint(base_matches(keyed))
    terms = checkpoint(disclosing_terms(keyed, keys, base, disclosure))
    texts = _may_match(keyed).join(terms.select("k1", "k2").distinct().hint("shuffle_hash"), ["k1", "k2"], "left_semi").select("k1", "k2", _lower(F.col("text")).alias("text"))
    places = located(texts, {4: (TERM, F.lit(True))}, ["k1", "k2"]).join(terms.withColumnRenamed("term", "match"), ["k1", "k2", "match"], "left_semi")
    span = F.struct("start", "kind", "end")
    base_of = base.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(span)).alias("base"))
    terms_of = places.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(span)).alias("terms"))
    own = base_of.join(terms_of, ["k1", "k2"], "left")
    clear = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    own = own.select("k1", "k2", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", clear))).alias("all"))
    copies = keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    return own.join(copies, ["k1", "k2"]), keys


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and the key k1, k2 of
    the text, by which ``sanitise`` finds the spans.

    A null text is an empty one; copies and repeated rows get equal spans; terms that touch a base span
    add nothing; an empty table gives no rows."""
    own, keys = _text_spans(_keyed(docs), disclosure)
    names = F.array(*(F.lit(k) for k in KINDS))
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count_of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count_of(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    digest = checkpoint(own.select("k1", "k2", "copies", *counts, F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.col("all")).alias("spans")))
    joined = spread_join(keys, digest, ["k1", "k2"], "copies", digest.agg(F.sum("copies")).head()[0] or 0, "doc_id")
    numbers = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS[:4]]
    return joined.select("doc_id", *numbers, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "k1", "k2")


def sanitise(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``texts`` with their own columns and a sanitised text, by the result of
    ``find_personal_data``: base spans are generalised to their kind in brackets, disclosing terms are removed.

    Rows find their spans by the key of their text, so every row stays one row: repeated rows, several texts
    of one doc_id, null doc_ids. A null text becomes an empty one; a text that ``spans`` does not know stays
    as it is; an empty table gives no rows."""
    key = [F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), F.length("text"), "text").alias("k2")]
    packed = texts.select(F.struct(*(F.col(f"`{c}`") for c in texts.columns)).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = checkpoint(spans.where("spans <> ''").groupBy("k1", "k2").agg(F.first("spans").alias("spans"), F.count(F.lit(1)).alias("copies")))
    total = known.agg(F.sum("copies")).head()[0] or 0
    rows = spread_join(packed.select("*", *key), known, ["k1", "k2"], "copies", total, "doc_id")
    cut = F.transform(F.filter(F.split(F.coalesce("spans", F.lit("")), ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    rows, text, n = rows.withColumn("cut", cut), F.col("text"), F.size("cut")
    at = lambda i, k: F.element_at(F.element_at("cut", i), k).cast("int")
    since = lambda i: F.when(i > 1, F.array_max(F.transform(F.slice("cut", 1, i - 1), lambda s: s[2].cast("int")))).otherwise(0)
    mark = lambda i: F.when(F.element_at(F.element_at("cut", i), 1) == "term", "").otherwise(F.concat(F.lit("["), F.upper(F.element_at(F.element_at("cut", i), 1)), F.lit("]")))
    piece = lambda i: F.when(at(i, 2) >= since(i), F.concat(text.substr(since(i) + 1, at(i, 2) - since(i)), mark(i))).otherwise("")
    pieces = F.transform(F.sequence(F.lit(1), n), piece)
    done = F.concat(F.array_join(pieces, ""), text.substr(since(n + 1) + 1, F.length(text)))
    clean = F.when(n == 0, text).otherwise(done)
    return rows.select(*(clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in texts.columns))
