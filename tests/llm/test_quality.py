from collections import defaultdict

from marlstone.llm.quality import HOST_SHARE, LEAST_DOCS, MOST_REMOVED, clean_documents, quality_rules

from .conftest import multiset, rows, words


def fold(line):
    return " ".join("".join("0" if "0" <= c <= "9" else c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(line))


def brute(docs, cleaned=None):
    gone, host_docs = defaultdict(set), defaultdict(set)
    for i, t, s in docs:
        host_docs[s].add(i)
        for line in (t or "").split("\n"):
            if words(line):
                gone[s, fold(line)].add(i)
    gone = {k for k, x in gone.items() if len(x) > max(LEAST_DOCS, HOST_SHARE * len(host_docs[k[0]]))}
    out = []
    for i, t, s in docs:
        t = t or ""
        w = words(t)
        covered = [False] * len(w)
        seen = defaultdict(list)
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        for ks in seen.values():
            for k in ks if len(ks) > 1 else []:
                covered[k : k + 8] = [True] * 8
        lines = [x for x in t.split("\n") if words(x)]
        removed = sum(len(words(x)) for x in lines if (s, fold(x)) in gone)
        failed = len(w) < 20 or 100 * sum(covered) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(covered), failed, not failed and removed <= MOST_REMOVED * len(w), removed))
        if cleaned is not None and out[-1][7]:
            cleaned.append((i, "\n".join(x for x in t.split("\n") if not words(x) or (s, fold(x)) not in gone), s))
    return multiset(out)


def check(docs):
    given, cleaned = rows(docs.select("doc_id", "text", "source")), []
    assert multiset(rows(quality_rules(docs))) == brute(given, cleaned)
    found = clean_documents(docs)
    assert found.columns == docs.columns
    assert multiset(rows(found.select("doc_id", "text", "source"))) == multiset(cleaned)


def test_odd_documents(odd_clashing):
    check(odd_clashing)


def test_documents(documents):
    check(documents)


def test_depleted_documents_go(spark):
    """A menu shared by many documents is cut out; what has little else goes, as do documents of a host that all
    say the same."""
    own = lambda i, n: " ".join(f"{i:010b}{k:07b}".translate({48: "a", 49: "b"}) for k in range(n))
    menu = " ".join(f"menu{k}" for k in range(20))
    docs = [(i, f"{menu}\n{own(i, 60)}", "h") for i in range(60)]
    docs += [(100 + i, f"{menu.upper()}\n{own(100 + i, 5)}", "h") for i in range(10)]
    docs += [(200 + i, own(200, 40), "h") for i in range(30)]
    docs += [(300, f"{menu}\n{own(300, 60)}", "other")] + [(400, own(400, 40), None)] * 30 + [(None, own(500, 40), None)] * 30
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["kept"] for r in quality_rules(df).collect()}
    assert {i for i, k in found.items() if not k} == {*range(100, 110), *range(200, 230)}
    check(df)
    text = {r["doc_id"]: r["text"] for r in clean_documents(df).collect()}
    assert text[3] == own(3, 60) and text[300] == docs[-61][1]


def test_lines_too_many_to_broadcast(documents, monkeypatch):
    from marlstone.llm import quality

    monkeypatch.setattr(quality, "BROADCAST_LINES", -1)
    check(documents)


def test_empty(empty):
    assert rows(quality_rules(empty)) == [] and rows(clean_documents(empty)) == []
