"""The pipeline's near-duplicate stage against a comparison of all pairs."""

import numpy as np
from conftest import DATA

from flowloom.llm import near_dedup


def plain(rows):
    """Ids that stay; sets of word tuples, no hashes."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        k = min(5, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i for i in sets if root(i) == i}


def test_near_stage_matches_all_pairs(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.near_stage(spark, docs, DATA)
    assert kept.dtypes == docs.dtypes
    assert {r.doc_id for r in kept.collect()} == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_near_stage_planted(spark):
    """Copies with some words changed, chains of copies, short and empty texts, repeated rows and rows without an id."""
    import corpus_pipeline

    rng, rows = np.random.default_rng(5), []
    for base in range(12):
        words = [f"b{base}w{i}" for i in rng.integers(0, 500, 120)]
        for copy in range(10):
            rows.append((len(rows), " ".join(words)))
            for at in rng.integers(0, len(words), copy % 4):
                words[at] = f"c{base}x{copy}y{at}"
    rows += [(200, ""), (201, None), (202, " Two  words"), (203, "two words"), (204, "two others")]
    want = plain(rows)
    assert 12 <= len(want) < 60
    rows += [rows[0], rows[1], (None, rows[0][1])]
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert {r.doc_id for r in kept} == want | {None}
    assert sum(r.doc_id == 0 for r in kept) == 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_stage(spark, none, DATA).count() == 0


def held(sets):
    """Rows of nodes with the given sets, as the index of fingerprints and that of bitmaps take them."""
    return [(near_dedup.fingerprint(s), i, len(s)) for i, s in enumerate(sets)], [near_dedup.bitmap(s).tolist() for s in sets]


def copies(count, changed=12):
    rng = np.random.default_rng(count)
    base = rng.integers(-(2**62), 2**62, 150)
    out = []
    for _ in range(count):
        some = base.copy()
        some[rng.integers(0, 150, rng.integers(0, changed))] = rng.integers(-(2**62), 2**62)
        out.append(np.unique(np.append(some, rng.integers(-(2**62), 2**62, rng.integers(0, changed)))))
    return out


def test_fingerprint_links_connect_what_all_links_connect():
    for count in (5, 200):
        rows, _ = held(copies(count))
        found = near_dedup.linked(rows)
        root = list(range(count))
        for links in (found, [(i, j) for x, i, m in rows for y, j, n in rows if i < j and ((x ^ y) & 2**64 - 1).bit_count() <= 5 and 5 * min(m, n) >= 4 * max(m, n)]):
            of = root[:]
            for _ in range(count):
                for a, b in links:
                    of[a] = of[b] = min(of[a], of[b])
            if links is found:
                want = of
        assert of == want and count // 3 < len(found) < count


def test_pairs_across_components_are_those_that_fit():
    """One shingle's rows: a large component, small ones and single nodes, with the index and without it, in one part and in two."""
    for count in (20, 200):
        sets = copies(count, 20)
        _, maps = held(sets)
        place, comp = [i % 40 for i in range(count)], [i if i % 5 == 0 else i % 3 for i in range(count)]
        ways = lambda i, j: {(0, 0)} | ({(0, 1)} if i % 2 != j % 2 else set())
        for x, y in ((0, 0), (0, 1)):
            want = set()
            for i in range(count):
                for j in range(i):
                    m, n, differ = len(sets[i]), len(sets[j]), sum(((a ^ b) & 2**64 - 1).bit_count() for a, b in zip(maps[i], maps[j], strict=True))
                    fits = 5 * min(m, n) >= 4 * max(m, n) and differ * 9 <= m + n and 9 * min(m - place[i], n - place[j]) >= 4 * (m + n)
                    if comp[i] != comp[j] and fits and (x, y) in ways(i, j):
                        want.add((j, i))
            got = near_dedup.crossing([(i, len(sets[i]), place[i], comp[i], x, y, i % 2, *maps[i]) for i in range(count)])
            assert got == want and len(want) > 10


def test_near_stage_hot_group(spark, monkeypatch):
    """A group of copies about as similar as the limit: what the index links needn't be paired again, and keys over GROUP lose nothing."""
    import corpus_pipeline

    rng, rows = np.random.default_rng(9), []
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    for i in range(240):
        words = base[:]
        for at in rng.choice(150, rng.integers(1, 5), replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:20] + [f"p{i}q{j}" for j in range(120)])) for i in range(60)]  # one passage in common
    docs, want, seen, old = spark.createDataFrame(rows, "doc_id long, text string"), plain(rows), {}, near_dedup.stored

    def count(df, name, keep=False):
        out = old(df, name, keep)
        if name in ("near-linked", "near-first", "near-across"):
            seen[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "stored", count)
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, DATA).collect()} == want
    assert seen["near-linked"] > 50 and seen["near-across"] < 3000  # 9003 when bitmaps were compared after the join
    monkeypatch.setattr(near_dedup, "GROUP", 7)
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, DATA).collect()} == want
