import gzip
import hashlib
import re
from pathlib import Path

import pytest

from marlstone.llm.warc import END, RecordReader, archive_round_trip, chunk_table, read_warc, write_warc

from .conftest import multiset, rows

SCHEMA = "page_id long, url string, html string"


def brute(pages):
    payloads = [(i, (h or "").encode()) for i, _, h in pages]
    first = {}
    for i, p in payloads:
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in payloads:
        again = p in first and i != first[p]
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return multiset(out)


@pytest.fixture(scope="module")
def pages(spark):
    tricky = ["\r\n\r\n", "x" * 99 + "\r", "y" * 120 + "\r\n", "z\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabc" * 5, "\n" * 200, "ä€😀" * 60, "\x00" * 150]
    data = [(i, f"http://a/{i}", t) for i, t in enumerate(tricky)]
    data += [(20, "u", "same " * 30), (19, "v", "same " * 30), (21, "u", "same " * 30), (21, "u", "same " * 30), (19, "v", "same " * 30)]
    data += [(None, None, "same " * 30), (None, None, None), (30, None, ""), (31, "a b\r\nc", None), (32, "", "short"), (33, "", "short"), (-4, "neg", "n" * 300)]
    data += [(40, "long", "0123456789ä" * 3000), (41, "long", "0123456789ä" * 3000)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("chunk", [1, 7, 1000, 1 << 20])
def test_round_trip(spark, pages, tmp_path, chunk):
    some = pages.where("page_id is null or page_id < 40") if chunk < 1000 else pages
    write_warc(some, str(tmp_path / "w"), chunk)
    found = multiset(rows(read_warc(spark, str(tmp_path / "w"))))
    assert sorted(set(found), key=repr) == sorted(set(brute(rows(some))), key=repr)
    assert found == brute(rows(some))


def test_pages(spark, sf, pages):
    given = spark.read.parquet(f"{sf}/pages.parquet")
    assert multiset(rows(archive_round_trip(given))) == brute(rows(given.select("page_id", "url", "html")))
    twice = given.unionByName(given.selectExpr("page_id + 10000 as page_id", "url", "html"))
    assert multiset(rows(archive_round_trip(twice))) == brute(rows(twice.select("page_id", "url", "html")))


def test_empty(spark):
    assert rows(archive_round_trip(spark.createDataFrame([], SCHEMA))) == []


def test_chunks_are_bounded_and_carry_running_digests(pages):
    found = [r for r in chunk_table(pages, 1000).collect() if r["page_id"] == 40]
    payload = ("0123456789ä" * 3000).encode()
    assert [r["chunk"] for r in found] == list(range(len(found))) and all(len(r["piece"]) <= 1000 for r in found)
    for r in found:
        assert r["running"] == hashlib.sha256(payload[: (r["chunk"] + 1) * 1000]).hexdigest()


def test_files_are_plain_warc(spark, pages, tmp_path):
    write_warc(pages, str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path / "w").glob("part-*")))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(END)
    assert data.count(b"WARC-Record-ID") >= 20


def test_records_are_unique_and_revisits_refer_to_records(spark, pages, tmp_path):
    write_warc(pages, str(tmp_path / "w"), 1000)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path / "w").glob("part-*")))
    ids = re.findall(rb"WARC-Record-ID: <(\S+)>", data)
    assert len(ids) == len(set(ids))
    refers = re.findall(rb"WARC-Refers-To: <(\S+)>\r\nX-Refers-To-Page-ID: (-?\d+)", data)
    assert len(refers) == sum(r[3] == "revisit" for r in brute(rows(pages)))
    heads = [dict(x.split(b": ", 1) for x in r.split(END)[0].split(b"\r\n") if b": " in x) for r in data.split(b"WARC/1.1\r\n")]
    page = {h[b"WARC-Record-ID"][1:-1]: h.get(b"X-Page-ID") for h in heads if h.get(b"WARC-Type") == b"response"}
    assert all(page[i] == p for i, p in refers)


def test_no_shuffled_row_holds_a_record(pages):
    """Payloads are cut before the shuffle: what is sent is pieces of a chunk at most."""
    plan = chunk_table(pages, 1000)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :]
    assert "substring" in join and join.index("Join") < join.index("substring")


def test_damage_is_found():
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    good = hashlib.sha256(b"abc").hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 1\r\nX-Running-Digest: sha256:{good}\r\nWARC-Payload-Digest: sha256:{good}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    assert RecordReader().feed(head + block + END) == [(1, 3, good, "response", None)]
    with pytest.raises(ValueError, match="damaged"):
        RecordReader().feed(head + block[:-1] + b"d" + END)
    with pytest.raises(ValueError, match="not a WARC"):
        RecordReader().feed(b"nonsense" + END)
