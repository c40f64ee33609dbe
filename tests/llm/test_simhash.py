import numpy as np
import xxhash

from marlstone.llm import simhash
from marlstone.llm.components import components
from marlstone.llm.simhash import drop_near_duplicates, link_fingerprints, pigeonhole_tables, simhash_components

from .conftest import multiset, rows, words


def brute_print(text, k=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute(docs, most=4):
    prints = [brute_print(t) for _, t in docs]
    distinct = np.array(sorted(set(prints)), np.uint64)
    group = list(range(len(distinct)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    # links hold between fingerprints that a numbered document has
    numbered = {p for p, (i, _) in zip(prints, docs, strict=True) if i is not None}
    for a in range(len(distinct)):
        for b in range(a):
            if bin(int(distinct[a] ^ distinct[b])).count("1") <= most and {int(distinct[a]), int(distinct[b])} <= numbered:
                group[find(a)] = find(b)
    at = {int(p): find(i) for i, p in enumerate(distinct)}
    smallest = {}
    for p, (i, _) in zip(prints, docs, strict=True):
        if i is not None:
            smallest[at[p]] = min(smallest.get(at[p], i), i)
    return multiset((i, f"{p:016x}", smallest.get(at[p])) for p, (i, _) in zip(prints, docs, strict=True))


def test_odd_documents(odd_clashing):
    assert multiset(rows(simhash_components(odd_clashing))) == brute(rows(odd_clashing.select("doc_id", "text")))


def test_documents(documents):
    assert multiset(rows(simhash_components(documents))) == brute(rows(documents.select("doc_id", "text")))


def test_empty(empty):
    assert rows(simhash_components(empty)) == []
    assert rows(drop_near_duplicates(empty)) == []


def test_every_close_pair_shares_a_block():
    rng = np.random.default_rng(1)
    tables = pigeonhole_tables(64, 6, 4)
    assert len(tables) == 15
    for _ in range(300):
        flipped = rng.choice(64, 4, replace=False)
        assert any(not np.isin(flipped, t).any() for t in tables)


def test_large_groups_are_cut_into_parts(spark):
    """A dense group and chains across parts give the same components as one search over all."""
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = []
    for c in centres:
        for _ in range(150):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 7), replace=False).tolist():
                x ^= 1 << b
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    a = np.array(fps, np.uint64)
    group = list(range(len(a)))
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 4).tolist():
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    df = spark.createDataFrame([(i, x.to_bytes(8, "little")) for i, x in enumerate(fps)], "doc_id long, fp binary")
    found = {int.from_bytes(r["fp"], "little"): r["component_id"] for r in link_fingerprints(df, pigeonhole_tables(64, 6, 4), 4, part=16).collect()}
    assert [found[x] for x in fps] == group


def test_rows_of_different_components_meet(spark):
    """Every two rows of a key with different components stand together; a key of one component is dropped,
    and a large component costs its rows once for each part of the others."""
    keys = [(1, i, 0 if i < 80 else i) for i in range(90)] + [(2, i, 0) for i in range(80)] + [(3, 1, 0), (3, 85, 85), (4, 7, 0)]
    values = spark.createDataFrame([(i,) for i in range(90)], "id long")
    dealt = rows(simhash._deal(spark.createDataFrame(keys, "key long, id long, c long"), values, 16).select("key", "p", "q", "id"))
    together = {}
    for key, p, q, i in dealt:
        together.setdefault((key, p, q), set()).add(i)
    for key, wanted in ((1, {(i, j) for i in range(90) for j in range(i) if i >= 80}), (3, {(85, 1)})):
        met = {(i, j) for (k, _, _), ids in together.items() if k == key for i in ids for j in ids if i > j}
        assert wanted <= met
    assert {key for key, *_ in dealt} == {1, 3}
    assert len([r for r in dealt if r[0] == 1]) == 80 + 10 * 6


def test_a_dense_group_becomes_one_star(spark):
    """Copies that differ in a word or two are joined before any two parts meet."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join([*base[: (k := int(rng.integers(200)))], f"x{i}", *base[k + 1 :]])) for i in range(700)]
    docs += [(1000 + i, " ".join(f"y{i}_{j}" for j in range(60))) for i in range(5)]
    kept = {r["doc_id"] for r in drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {0, *range(1000, 1005)}


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5), (5, 4)]
    found = dict(rows(components(spark.createDataFrame(edges, "u long, v long"))))
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in (200, 201, 202)}


def test_components_of_random_graphs(spark, monkeypatch):
    """Whether one task or many take the edges; against a search from every node."""
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(-200, 200, (230, 2))] + [(500, x) for x in range(501, 560)] + [(559, 7), (500, 501)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for x in sorted(near):
        queue = [] if x in expected else [x]
        while queue:
            if (y := queue.pop()) not in expected:
                expected[y] = x
                queue += near[y]
    for most in (100_000, 40):
        monkeypatch.setattr("marlstone.llm.components.TASK_EDGES", most)
        found = rows(components(spark.createDataFrame(edges, "u long, v long").repartition(3)))
        assert len(found) == len(expected) and dict(found) == expected
    assert rows(components(spark.createDataFrame([], "u long, v long"))) == []


def test_near_copies_go_and_others_stay(spark, odd):
    rng = np.random.default_rng(3)
    base = [[f"w{rng.integers(5000)}" for _ in range(300)] for _ in range(40)]
    docs = []
    for i, w in enumerate(base):
        copy = list(w)
        copy[int(rng.integers(300))] = "changed"
        docs += [(i, " ".join(w)), (1000 + i, " ".join(copy)), (2000 + i, " ".join(w))]
    kept = {r["doc_id"] for r in drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == set(range(40))
    left = {r["doc_id"] for r in drop_near_duplicates(odd).collect()}
    everything = {r["doc_id"] for r in odd.collect()}
    assert everything - left == {2, 7, 9, 10, 12} - ({12} & left)
    assert drop_near_duplicates(odd).columns == odd.columns


def test_wide_fingerprint_begins_with_the_narrow_one():
    assert simhash.fingerprint(b"some words to hash and some more", 4, 1024)[:8] == simhash.fingerprint(b"some words to hash and some more", 4, 64)


def test_wider_blocks_for_larger_corpora():
    """The present setting up to half a billion sets; beyond it at most 32 chance neighbours a key."""
    assert simhash.wide_for(0) == simhash.wide_for(200_000) == simhash.wide_for(1 << 28) == simhash.WIDE
    for n in (10**9, 10**10, 10**11):
        large = simhash.wide_for(n)
        assert n / 2 ** large["width"] <= 32 and large["tables"] > simhash.WIDE["tables"]
        assert 1 - (1 - (1 - 0.1514) ** large["width"]) ** large["tables"] >= 0.985


def test_more_blocks_for_more_fingerprints(documents):
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**9, 10**10, 10**14)] == [6, 6, 8, 8, 12]
    expected = multiset(rows(simhash_components(documents)))
    assert multiset(rows(simhash_components(documents, blocks=8))) == expected
    rng = np.random.default_rng(1)
    for blocks in (7, 8):
        tables = pigeonhole_tables(64, blocks, 4)
        for _ in range(100):
            flipped = rng.choice(64, 4, replace=False)
            assert any(not np.isin(flipped, t).any() for t in tables)


def test_sampled_tables():
    tables = simhash.sampled_tables(1024, 24, 150)
    assert len(tables) == 150 and all(len(set(t.tolist())) == 24 for t in tables)


def test_pairs_just_above_the_similarity_are_found(spark):
    """Long pairs at 0.8 and a little more, and short ones; pairs below it stay."""
    docs, far = [], []
    fresh = lambda i, side, n: [f"{side}{i}x{j}" for j in range(n)]
    for i, (common, own) in enumerate([(404, 50)] * 120 + [(8, 1), (9, 1), (20, 2), (36, 4), (40, 4), (36, 3)] * 10):
        base = fresh(i, "c", common)
        docs += [(i, " ".join(base + fresh(i, "a", own))), (1000 + i, " ".join(base + fresh(i, "b", own)))]
    for i in range(60):  # one word more: 4 of 5 shingles and up, exactly found
        docs += [(3000 + i, " ".join(fresh(i, "s", 8 + i % 30))), (4000 + i, " ".join(fresh(i, "s", 9 + i % 30)))]
    for i in range(40):  # 0.75
        far += [(5000 + i, " ".join(fresh(i, "f", 304) + fresh(i, "g", 50))), (6000 + i, " ".join(fresh(i, "f", 304) + fresh(i, "h", 50)))]
    kept = {r["doc_id"] for r in drop_near_duplicates(spark.createDataFrame(docs + far, "doc_id long, text string")).collect()}
    shingles = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in docs + far}
    near = {i for i in shingles if 1000 <= i < 3000 or 4000 <= i < 5000 or i >= 6000}
    near = {i for i in near if len(shingles[i] & shingles[i - 1000]) >= 0.8 * len(shingles[i] | shingles[i - 1000])}
    gone = set(shingles) - kept
    assert gone <= near and len([i for i in near if i < 1120]) == 120
    assert {i for i in near if len(shingles[i]) <= 32} <= gone
    assert len([i for i in near & gone if i < 1120]) >= 114
