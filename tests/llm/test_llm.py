"""The corpus operators against plain versions, on the smallest tables and on awkward rows."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import DATA

from flowloom.llm import exact_dedup, language_id, packing, pieces, pii, quality, simhash_dedup, substring_dedup, tool_chat, topk_search

LONG = " ".join(f"w{i % 700}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ODD = [
    (1, "same text here", "en", "src0", 5), (2, "same  text\there", "en", "src0", 5), (3, None, "en", None, None), (4, "", None, "a", 0), (5, "same text here", None, "a", 0),
    (6, LONG, "fr", "a", 1), (7, LONG + " tail", "fr", "a", 1), (None, "same text here", "de", "b", 2), (None, None, None, None, None), (8, f"alpha {PASSAGE} omega", "en", "b", 1),
    (9, f"beta gamma {PASSAGE} delta", "en", "b", 1), (10, "mail x.y@ex-a.org, +1 (743) 555-3824 or 4465758382889437 at 8.196.197.208 1.2.3.400", "en", "b", 1), (10, "mail x.y@ex-a.org, +1 (743) 555-3824 or 4465758382889437 at 8.196.197.208 1.2.3.400", "en", "b", 1),
    (11, "1234 5678!! ... 🙂🙂 ▁ ünïcödé  two  spaces ", "es", "c", 1), (12, "12345 --- 678", "es", "c", 1), (13, "the the " * 90, "en", "c", 1),
]
#: Names that the operators use, or used, for columns of their own.
CLASH = "h digest row fp spans rep _bytes _bytes2 hash low entry bucket owner _bucket _entry _dedup_h _dedup_low key _key found _found gone _gone node n lead at words branches shift chunk block HASH_ held_out score".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns with names that the operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def test_exact_dedup(spark, odd):
    got = exact_dedup.exact_dedup(odd, capacity=64).collect()
    groups = {}
    for i, t, *_ in ODD:
        groups.setdefault(exact_dedup.normalise((t or "").encode()), []).append(i)
    assert len(got) == len(ODD)
    by = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None) and r.kept == (r.doc_id == r.keep_id)
    for capacity in (64, exact_dedup.BUCKET_BYTES):
        kept = exact_dedup.survivors(odd.repartition(3), capacity)
        assert kept.columns == odd.columns
        lowest = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
        assert Counter(r.doc_id for r in kept.collect()) == Counter(lowest)
        whole = Counter(map(str, odd.collect()))
        assert all(whole[str(r)] for r in kept.collect())
    assert exact_dedup.survivors(odd.where("false")).count() == 0
    assert exact_dedup.exact_dedup(odd.where("false")).count() == 0


def test_exact_dedup_oracle(spark, duck, docs):
    want = duck.execute(exact_dedup.ORACLE)
    cols = [c[0] for c in want.description]
    at = [cols.index(c) for c in sorted(cols)]
    assert rows(exact_dedup.query(spark, DATA)) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_exact_dedup_largest_id(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(top, "a"), (None, "a"), (None, "b"), (top, "c"), (top - 1, "c")], "doc_id long, text string")
    got = sorted((r.text_sha256[:1], r.doc_id or 0, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert {(d, k, kept) for _, d, k, kept in got} == {(top, top, True), (0, top, False), (0, None, True), (top, top - 1, False), (top - 1, top - 1, True)}
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.survivors(df).collect()) == [(0, "b"), (top - 1, "c"), (top, "a")]


def test_owners_take_consecutive_buckets():
    assert exact_dedup.owners([3, 1, 2, 5], {3: 5, 1: 5, 2: 1, 5: 30}, 10) == {3: 0, 1: 0, 2: 1, 5: 2}


def test_directory_doubles():
    depth, entries = exact_dedup.directory({0: 100, 1: 1, 7: 5}, 3, 10)
    assert depth == 3 and len(entries) == 8 and len({b for b, _ in entries}) == 4
    assert entries[4:] == [entries[4]] * 4


def brute_substring(texts):
    first, out = {}, []
    for i, t in texts:
        w = (t or "").encode().split()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    for i, t in texts:
        w = (t or "").encode().split()
        mark = [False] * len(w)
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                mark[p : p + 50] = [True] * 50
        kept = b" ".join(x for x, m in zip(w, mark, strict=True) if not m)
        out.append(str((i, hashlib.sha256(kept).hexdigest(), sum(mark), len(w))))
    return sorted(out)


def test_substring_dedup(spark, odd, docs, plain):
    assert rows(substring_dedup.substring_dedup(odd).drop("kept_text")) == brute_substring([r[:2] for r in ODD])
    assert rows(substring_dedup.query(spark, DATA)) == brute_substring(plain)
    assert substring_dedup.substring_dedup(odd.where("false")).count() == 0


def test_substring_thue_morse_words(spark):
    """Words whose polynomial hashes modulo 2^64 are equal for every base; repeated rows; passages in several pieces and orders."""
    texts, common = [], " ".join(f"c{i}" for i in range(49))
    for length in (1024, 4096):
        one = "".join("ab"[i.bit_count() & 1] for i in range(length))
        texts += [(len(texts), f"{common} {one}"), (len(texts) + 1, f"{common} {one.translate(str.maketrans('ab', 'ba'))}")]
    p = [" ".join(f"p{j}x{i}" for i in range(70)) for j in range(4)]
    texts += [(10, f"{p[0]} {p[1]} end"), (11, f"{p[1]} {p[0]} {p[2]}"), (12, f"q {p[2]} {p[0]} {p[1]} {p[3]}"), (13, f"{p[3]} {p[3]} {p[1]}"), (13, f"{p[3]} {p[3]} {p[1]}"), (14, "z " * 120), (15, "z " * 300), (16, f"{common} {texts[0][1]}")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = rows(substring_dedup.substring_dedup(df).drop("kept_text"))
    assert got == brute_substring(texts) and sum(", 0, " in r for r in got) >= 4


def test_substring_unequal_words_stay():
    """Evidence whose words differ removes nothing, whatever the digests said."""
    words = [b"w%d" % i for i in range(60)]
    chunk = lambda w: {"first": 0, "last": 10, "shift": 0, "chunk": 0, "words": b" ".join(w)}
    assert substring_dedup.verified(words, [chunk(words)]) == [(0, 10)]
    assert substring_dedup.verified(words, [chunk([*words[:59], b"x"])]) == substring_dedup.verified(words, [chunk(words[:59])]) == []


def brute_simhash(texts):
    fps = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    own = sorted({f for _, f in fps})
    root = {f: f for f in own}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in own:
        for b in own:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    low = {}
    for i, f in fps:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return sorted(str((low.get(find(f)), i, f"{f:016x}")) for i, f in fps)


def test_simhash(spark, odd, plain):
    assert rows(simhash_dedup.simhash_dedup(odd)) == brute_simhash([r[:2] for r in ODD])
    assert rows(simhash_dedup.query(spark, DATA)) == brute_simhash(plain)
    assert simhash_dedup.simhash_dedup(odd.where("false")).count() == 0


def test_gray_index_and_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40).tolist()
    fps = list({b ^ 1 << int(x) ^ 1 << int(y) for b in base for x, y in rng.integers(0, 64, (12, 2))} | set(base))
    index = simhash_dedup.GrayIndex(fps)
    for x in fps[::7]:
        assert {index.fps[i] for i in index.within(x, 2)} == {f for f in fps if (f ^ x).bit_count() <= 2}
    joined = Counter(r for _, r in simhash_dedup.forest(fps))
    links = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    owner = {f: f for f in fps} | dict(simhash_dedup.forest(fps))
    assert joined and all(owner[a] == owner[b] for a, b in links)


def test_simhash_survivors(spark, odd, docs):
    from pyspark.sql import functions as F

    for table in (odd.withColumn("_gone", F.lit(1)), docs):
        found = {}
        for r in simhash_dedup.simhash_dedup(table).collect():
            found.setdefault(r.doc_id, []).append(r.doc_id == r.component_id)
        stay = {i for i, own in found.items() if i is None or any(own)}
        kept = simhash_dedup.survivors(table)
        assert kept.columns == table.columns
        assert rows(kept) == rows(table.where(F.coalesce("doc_id", F.lit(-1)).isin([-1 if i is None else i for i in stay])))
    assert simhash_dedup.survivors(odd.where("false")).count() == 0


def test_simhash_large_keys(spark, monkeypatch):
    """Keys over GROUP are dealt anew; no link is lost."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash_dedup, "GROUP", 2)
    fps = [1 << i for i in range(40)] + [0, 3, 1 << 50 | 1]
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    comp = simhash_dedup.components(simhash_dedup.links(nodes))
    assert comp.select("comp").distinct().count() == 1 and comp.select(F.countDistinct("node")).first()[0] == len(fps)


def test_packing(spark, odd, docs, plain):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for df, texts, length in ((odd, [r[:2] for r in ODD], 512), (docs, plain, 4096)):
        got = packing.pack(df, length=length).collect()
        assert sum(r.length for r in got) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
        want = Counter()
        for i, t in texts:
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            for s in range(0, len(ids), length):
                part = ids[s : s + length]
                want[i, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)] += 1
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
        seqs = {}
        for r in got:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in seqs.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= length
    assert packing.pack(odd.where("false")).count() == 0


def test_first_fit_decreasing_is_first_fit():
    sizes = np.random.default_rng(2).integers(1, 100, 500).tolist()
    free, want = [], [None] * 500
    for i in sorted(range(500), key=lambda i: -sizes[i]):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_pii(spark, odd):
    got = {r.doc_id: r for r in pii.find(odd).collect()}
    r = got[10]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert got[3].n_email == 0 and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert [tuple(s) for s in r.found][:2] == [(5, 0, 17), (19, 3, 36)]
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.count() == len(ODD)
    text = clean.where("doc_id = 10").first()
    assert "[EMAIL]" in text.text and "3824" not in text.text and text.n_chars == len(text.text)
    assert pii.find(odd.where("false")).count() == 0


def test_pii_base_matches_plain_regex():
    import re

    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    rng = np.random.default_rng(3)
    for _ in range(3000):
        t = "".join(rng.choice(list("a1@..-+ 9x(%"), 40))
        want = [(m.start(), 0, m.end()) for m in re.finditer(email, t)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(ip, t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [x for x in pii.base_spans(t) if x[1] < 2] == sorted(want), t


def test_pii_bootstrap_finds_unseen(spark):
    texts = [(i, f"please call my mobile +1 (743) 555-{1000 + i} today") for i in range(20)] + [(99, "please call my mobile 743.555.77xx8 today"), (98, "route 66 is long")]
    got = {r.doc_id: [tuple(s) for s in r.found] for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[99] == [(22, 3, 35)] and got[98] == []


def test_language(spark, docs):
    got = {r.doc_id: r for r in language_id.query(spark, DATA).collect()}
    held = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert held and np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == r.held_out for i, r in got.items())


def test_language_odd(spark, odd):
    got = {r.doc_id: r for r in language_id.predict(odd, language_id.fit(odd)).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[12].lang_pred == "und" and got[1].lang_pred in {"en", "fr", "de", "es"}
    none = odd.where("false")
    assert language_id.predict(odd, language_id.fit(none)).where("lang_pred != 'und'").count() == 0


def test_language_filters_have_no_false_negatives():
    texts = {"a": "hello world again", "b": "guten morgen welt"}
    f = language_id.Filters([*texts], [np.concatenate(language_id.slots(language_id.grams(t))) for t in texts.values()])
    for i, t in enumerate(texts.values()):
        assert np.all(np.bitwise_and.reduce(f.masks(language_id.grams(t)), axis=0) >> i & 1)
    assert f.predict("guten morgen")[0] == "b"


def test_seventy_languages(spark):
    """Each language has words of its own; all are learned, as a plain version learns them."""
    rng = np.random.default_rng(9)
    words = {f"l{i:02}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for i in range(70)}
    rows = [(n, " ".join(rng.choice(words[x], 15)), x) for n, x in enumerate(x for x in words for _ in range(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.fit(docs)
    assert sorted(filters.langs) == sorted(words) and filters.table.shape[0] == 2
    got = {r.doc_id: r for r in language_id.predict(docs, filters).collect()}
    learned = {x: Counter() for x in words}
    for n, t, x in rows:
        if not got[n].held_out:
            learned[x].update(language_id.grams(t).tolist())
    n_texts = Counter(x for n, _, x in rows if not got[n].held_out)
    full = {x: {g for g, c in learned[x].items() if c >= min(language_id.FLOOR, n_texts[x])} for x in words}
    sets = {x: {tuple(p) for p in zip(*(s.tolist() for s in language_id.slots(np.array(sorted(full[x]), np.uint64))), strict=True)} for x in words}
    bits = {x: set().union(*sets[x]) for x in words}
    for n, t, _ in rows:
        g = list(zip(*(s.tolist() for s in language_id.slots(language_id.grams(t))), strict=True))
        share = {}
        for x in words:
            false = (len(bits[x]) / language_id.SLOTS) ** language_id.HASHES
            share[x] = max(0.0, (sum(all(s in bits[x] for s in p) for p in g) - len(g) * false) / (1 - false))
        want = max(filters.langs, key=lambda x: (share[x], -filters.langs.index(x)))
        assert got[n].lang_pred == want and got[n].score == pytest.approx(share[want] / sum(share.values()))
    assert np.mean([got[n].lang_pred == x for n, _, x in rows]) > 0.95


def test_quality(spark, odd, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality.keep_good(odd, labels.where("false")).columns == odd.columns
    assert quality.score(odd.where("false"), model).count() == 0
    assert quality.fit(docs, labels.where("quality = 1"))[0] is None


def test_quality_one_text_over_the_bound(spark, docs):
    """A labelled text over the byte bound is passed over; the model stands."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    first = labels.where("quality is not null").where(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).first()
    huge = docs.withColumn("text", F.when(F.col("doc_id") == first.doc_id, F.repeat(F.lit("long words "), 40_000)).otherwise(F.col("text")))
    model = quality.fit(huge.unionByName(huge.where(F.col("doc_id") == first.doc_id)), labels, sample_bytes=300_000)
    assert model[0] is not None
    scores = [r.score for r in quality.score(docs, model).collect()]
    assert len(set(scores)) > len(scores) // 2
    assert quality.chosen_ids([(0, 1, 0, 500), (1, 2, 0, 40), (2, 3, 0, 30), (3, 4, 1, 900), (4, 5, 1, 700)], 100) == [2, 5]


def test_quality_score_matches_plain(spark, odd, docs):
    """Whole texts, one at a time, against word-by-word sums over the fixed model."""
    import re

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    vectors, network = quality.fit(docs, labels)
    w1, b1, w2, b2 = network.p

    def plain(text):
        total, n, last = np.zeros(vectors.shape[1]), 0, None
        for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9 \t-\r]+", text):
            slot = int(quality.units(m[0].lower())[0])
            marks = [quality._CAPS_SLOT] if len(m[0]) > 1 and re.fullmatch(rb"[A-Z]+", m[0]) else []
            if re.match(rb"[A-Za-z\x80-\xff]", m[0]):
                marks += [quality._AGAIN_SLOT] if slot == last else []
                last = slot
            for s in [*marks, slot]:
                total, n = total + vectors[s], n + 1
        z = np.clip((total / max(1, n) - network.mean) / network.std, -8, 8)
        return 1 / (1 + np.exp(-np.clip((np.tanh(z @ w1 + b1) @ w2 + b2[0]) / network.temperature, -30, 30)))

    for table in (odd, docs):
        want = sorted(plain((r.text or "").encode()) for r in table.collect())
        assert sorted(r.score for r in quality.score(table, (vectors, network)).collect()) == pytest.approx(want, abs=1e-4)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.query(spark, sf).collect()}
    held = [(r.quality, got[r.doc_id].score) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert np.mean([(g > b) for g in good for b in bad]) > 0.9


def test_pieces(spark, odd):
    own = pieces.Pieces()

    def brute(word):
        best = [(0.0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                p = word[s:e]
                if p in own.scores:
                    v = best[s][0] + own.scores[p]
                    if best[e] is None or v > best[e][0]:
                        best[e] = (v, best[s][1] + [p])
            if best[e] is None:
                best[e] = (best[e - 1][0] + own.low * len(word[e - 1].encode()), best[e - 1][1] + [b for b in word[e - 1].encode()])
        return best[-1]

    for w in ["▁unbelievable", "▁Straße", "▁日本🙂x", "▁▁▁a", "▁", "▁" + "aß🙂" * 9]:
        ids = own.viterbi(w)
        score = sum(own.low if i in set(own.bytes_.values()) else own.scores[own.texts[i].decode()] for i in ids)
        assert score == pytest.approx(brute(w)[0])
        assert b"".join(own.texts[i] for i in ids).decode() == w
    got = {r.doc_id: r for r in pieces.encode(odd).collect()}
    assert all(r.exact == ("▁" not in (t or "")) for i, t, *_ in ODD for r in [got[i]]) and got[3].n_ids == 0 and got[6].n_ids == len(got[6].ids) > 30_000
    assert pieces.encode(odd.where("false")).count() == 0


def test_pieces_query_matches_plain(spark, plain):
    """All texts by a search over all substrings of each word, without the automaton."""
    own, memory = pieces.Pieces(), {}
    raw = {*own.bytes_.values()}
    numbers, longest = {t.decode(): i for i, t in enumerate(own.texts) if i not in raw}, max(map(len, own.scores))

    def encode(word):
        best = [(0.0, ())] + [None] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - longest), e):  # longer pieces first, so that they win ties
                if (piece := word[s:e]) in own.scores:
                    v = best[s][0] + own.scores[piece]
                    if best[e] is None or v > best[e][0]:
                        best[e] = (v, best[s][1] + (numbers[piece],))
            if best[e] is None:
                raw = word[e - 1].encode()
                best[e] = (best[e - 1][0] + own.low * len(raw), best[e - 1][1] + tuple(own.bytes_[b] for b in raw))
        return best[-1][1]

    got = {r.doc_id: r for r in pieces.query(spark, DATA).collect()}
    for i, text in plain:
        ids = []
        for word in text.split(" ") if text else []:
            memory[word] = memory.get(word) or encode("▁" + word)
            ids += memory[word]
        r = got[i]
        if text and "  " not in f" {text} ":  # pieces of several spaces join words
            assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), i
        assert r.exact and r.decoded_crc32 == zlib.crc32((text or "").encode())


def brute_topk(vecs):
    """Each row a query or candidate of its own; Python's integers; scores saturate as longs."""
    ok = [(n, i, [int(np.floor(256 * np.float64(x))) for x in v]) for n, (i, v) in enumerate(vecs) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, q, v in ok:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, x)), i) for m, i, x in ok if m != n)[:5]
            want += [(q, r + 1, i, max(-(2**63) + 1, min(2**63 - 1, -t))) for r, (t, i) in enumerate(s)]
    return sorted(want)


def found_topk(spark, vecs, **sizes):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in vecs], "vec_id long, embedding array<double>, row int, block int, level string")
    return sorted(tuple(r) for r in topk_search.top_k(df, **sizes).select("query_id", "rank", "vec_id", "score").collect())


def test_topk(spark):
    """Repeated ids (query and candidate), ties, a vector that a third of all rows have, zero vectors, other lengths, large components."""
    rng = np.random.default_rng(4)
    vecs = [(i, (rng.normal(size=8) * (1 + i % 5) / 8).tolist()) for i in range(300)] + [(50, [0.5] * 8), (301, None), (302, [None] + [1.0] * 7), (303, [float("nan")] * 8), (304, [1.0]), (None, [9.0] * 8), (305, tie := [0.25] * 8), (306, tie), (350, [0.0] * 8)]
    vecs += [(400 + i % 90, [2.0, -1.0] * 4) for i in range(150)]
    assert found_topk(spark, vecs, block=64, queries=3, opening=(1, 2)) == brute_topk(vecs)
    large = [*vecs[:40], (1000, [1e7] * 8), (1001, [-1e7] * 8), (1002, [1e7] * 7 + [9e6]), (1050, [3e13, -3e13])]
    assert found_topk(spark, large, block=8, queries=4) == brute_topk(large)
    assert found_topk(spark, [(7, [1.0]), (8, [2.0])]) == found_topk(spark, []) == []
    assert found_topk(spark, [(50, [1.0])]) == []


def test_topk_plan_has_no_nested_loops(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    plan = topk_search.top_k(df, block=32, queries=4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_topk_pair_of_blocks():
    """best() with bounds drops nothing that reaches them."""
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, (500, 40)) * rng.integers(1, 9, (500, 1))
    x = x[np.argsort(-(x**2).sum(axis=1))]
    q, ids, full = x[::7], np.arange(500), x[::7] @ x.T
    for share in (0.0, 0.5, 0.99):
        bound = np.sort(full, axis=1)[:, -6].astype(float) * share if share else np.full(len(q), -np.inf)
        got = {}
        for rows_, found, score in topk_search.best(np.arange(1000, 1000 + len(q)), q, ids, ids, x, bound, np.linalg.svd(x.astype(float))[2].T, 5):
            for r, i, s in zip(rows_.tolist(), found.tolist(), score.tolist(), strict=True):
                got.setdefault(r - 1000, []).append((-s, i))
        for r in range(len(q)):
            assert got[r] == sorted((-int(s), i) for i, s in enumerate(full[r]))[:5]


def test_tool_chat(spark):
    call = lambda i, name="search", args='{"query":"x"}', after="": f'<tool_call>{{"id":"{i}","name":"{name}","arguments":{args}{after}}}</tool_call>'
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "ok " + call("b", after=',"after":["a"]') + call("a", args='{"query":"y","limit":3}') + call("c", "search", '{"limit":"no","zz":1}')),
        (1, 2, "tool", '<tool_result>{"id":"a","content":{"z":1,"a":[true,null]}}</tool_result><tool_result>{"id":"nope","content":1}</tool_result>'), (1, 3, "assistant", call("a") + call("q", "unknown", "{}") + "<tool_call>{bad</tool_call>"),
        (2, 0, "assistant", call("x", after=',"after":["y"]') + call("y", after=',"after":["x"]')), (2, 1, None, None), (None, None, "user", "lost"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = tool_chat.format_chat(df).collect()
    assert sum(r.kind == "message" for r in got) == len(turns)
    calls = {(r.conv_id, r.turn, r.call_id): r for r in got if r.kind == "call"}
    assert calls[1, 1, "a"].o_level == 0 and calls[1, 1, "b"].o_level == 1 and calls[1, 1, "a"].linked and calls[1, 1, "a"].error is None
    assert calls[1, 1, "c"].error == "extra:zz,missing:query,type:limit"
    assert calls[1, 3, "a"].error == "duplicate_id" and calls[1, 3, "q"].error == "unknown_tool" and calls[1, 3, None].error == "bad_json"
    assert calls[2, 0, "x"].error == calls[2, 0, "y"].error == "unordered"
    results = {r.call_id: r for r in got if r.kind == "result"}
    assert results["nope"].error == "orphan" and results["a"].linked and results["a"].o_turn == 1
    assert results["a"].json == '{"content":{"a":[true,null],"z":1},"id":"a"}'
    order = sorted((r for r in got if r.conv_id == 1 and r.o_turn == 1 and r.o_level is not None), key=lambda r: (r.o_level, r.o_place, r.o_part))
    assert [(r.kind, r.call_id) for r in order] == [("message", None), ("call", "a"), ("result", "a"), ("call", "c"), ("call", "b")]
    assert tool_chat.format_chat(df.where("false")).count() == 0
