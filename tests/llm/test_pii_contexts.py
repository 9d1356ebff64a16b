"""Contextual spans against a plain version; long unbroken texts; contexts that differ far from the instance."""

import time
from collections import defaultdict

import numpy as np

from flowloom.llm import pii


def plain(texts):
    """Spans of each text, by dictionaries over the whole corpus. Identifiers are whole words here."""
    seen = []  # text, start, end, kind, item, patterns
    for t, text in texts.items():
        words, at = [], 0
        for w in text.split(" "):
            words.append((at, w))
            at += len(w) + 1
        base = {(s, e): k for s, k, e in pii.base_spans(text)}
        for i, (s, w) in enumerate(words):
            kind = base.get((s, s + len(w)), -1)
            if kind >= 0 or (len(w) >= 4 and any(c.isdigit() or c == "@" for c in w)):
                pats = [("ll", words[i - 2][1], words[i - 1][1])] if i > 1 else []
                pats += [("lr", words[i - 1][1], words[i + 1][1])] if i and i + 1 < len(words) else []
                seen.append((t, s, s + len(w), kind, w, pats))
    items, seeds = defaultdict(set), {}
    for *_, kind, item, pats in seen:
        for p in pats:
            items[p].add(item)
            if kind >= 0:
                seeds[p, item] = kind
    trusted, found = {}, {}
    while True:
        base = defaultdict(list)
        for (p, _), k in seeds.items():
            base[p, k].append(1.0)
        for p, own in items.items():
            for i in own:
                if (p, i) not in seeds and i in found:
                    base[p, found[i][0]].append(found[i][1])
        open_ = {p: [i for i in items[p] if (p, i) not in seeds and i not in found] for p, _ in base}
        score = {pk: sum(v) / (len(items[pk[0]]) + pii.PRIOR) for pk, v in base.items()}
        for _ in range(pii.ROUNDS):
            own = defaultdict(float)
            for p, k in base:
                for i in open_[p]:
                    own[i, k] = max(own[i, k], score[p, k])
            score = {(p, k): (sum(v) + sum(own[i, k] for i in open_[p])) / (len(items[p]) + pii.PRIOR) for (p, k), v in base.items()}
        sure = {}
        for (p, k), v in base.items():
            if len(v) >= pii.SEEDS and score[p, k] >= pii.CONFIDENT and p not in trusted:
                sure[p] = max(sure.get(p, (0, 0)), (score[p, k], -k))
        if not sure:
            break
        trusted |= sure
        fresh = {}
        for p, best in sure.items():
            for i in open_[p]:
                fresh[i] = max(fresh.get(i, (0, 0)), best)
        if not fresh:
            break
        found |= {i: (-k, c) for i, (c, k) in fresh.items()}
    out = {t: [tuple(x) for x in pii.base_spans(text)] for t, text in texts.items()}
    for t, s, e, kind, _, pats in seen:
        kinds = [-trusted[p][1] for p in pats if p in trusted]
        if kind < 0 and kinds:
            out[t].append((s, min(kinds), e))
    return {t: sorted(v) for t, v in out.items()}


def test_contextual_spans_match_plain(spark):
    rng, texts = np.random.default_rng(12), {}
    known = [lambda n: f"u{n}x@mail-{n % 5}.org", lambda n: f"10.2.{n % 200}.{n % 250}", lambda n: f"+1-743-555-{1000 + n}"]
    hidden = [f"id{i}77z" for i in range(30)]
    frames = [("write to", "soon"), ("host at", "is"), ("call on", "now"), ("see the", "page"), ("desk of", "here"), ("for ref", "only")]
    for n in range(400):
        words = []
        for _ in range(3):
            f = int(rng.integers(0, 6))
            fill = known[f](int(rng.integers(0, 300))) if f < 3 and rng.random() < 0.9 else hidden[int(rng.integers(0, 30))] if f < 5 else f"nr{rng.integers(0, 5000)}"
            words += [frames[f][0], fill, frames[f][1], str(rng.choice(["and", "or", "then"]))]
        texts[n] = " ".join(words)
    want = plain(texts)
    got = {r.doc_id: [tuple(x) for x in r.found] for r in pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want and sum(len(v) for v in want.values()) > sum(len(pii.base_spans(t)) for t in texts.values()) + 20


def test_long_unbroken_texts_are_linear():
    for unit, n in (("1.1.", 500_000), ("1.1.1.", 350_000), ("a@b.c1", 350_000), ("+1 (2", 400_000), ("x1", 1_000_000)):
        text = unit * n
        begun = time.time()
        got = pii.mentions(text, pii.base_spans(text))
        assert (got or unit == "+1 (2") and time.time() - begun < 30, unit


def test_contexts_are_not_cut():
    tail = "x" * 60
    pats = lambda t: pii.mentions(t, pii.base_spans(t))[0]["pats"]
    assert not set(pats(f"one {'a' + tail} a1@b.org {'b' + tail}")) & set(pats(f"one {'b' + tail} a1@b.org {'b' + tail}"))
    assert not set(pats(f"one {'?' * 20} a1@b.org z")) & set(pats(f"one {'?' * 21} a1@b.org z"))
    assert pats("one two a1@b.org three") == pats("x one Two, c2@b.org (three)")
    assert pats("mail:<a1@b.org> x") == pats("Mail:<c1@b.org> y")


def test_redact_keeps_documents_apart(spark):
    """Ids repeated, with other texts; null ids; columns with names that are used inside."""
    rows = [(1, "a1@b.org x", 1, 2, 3), (1, "x y z a1@b.org", 1, 2, 3), (None, "a2@b.org", 1, 2, 3), (None, "none", 1, 2, 3), (None, None, 1, 2, 3), (1, "a1@b.org x", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_id int, found int, own_sha int")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "-") for r in got.collect()) == [(0, "-"), (0, "[EMAIL]"), (0, "none"), (1, "[EMAIL] x"), (1, "[EMAIL] x"), (1, "x y z [EMAIL]")]
