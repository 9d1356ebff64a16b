"""The whole pipeline against plain steps, on documents with clashing columns, planted copies and personal data."""

import hashlib
import struct
import zlib
from collections import Counter

from conftest import DATA
from test_llm import CLASH, ODD
from test_near import plain as near_plain

from flowloom.llm import common, exact_dedup, packing, pii, quality


def fixture(spark, path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = [r for r in rows if r[1] and len(r[1].split()) > 60][:12]
    for n, (_, text, *rest) in enumerate(good):
        words = text.split()
        words[len(words) // 2] = f"word{n}"
        rows.append((100_000 + n, " ".join(words), *rest))  # a near copy, mostly
        rows.append((200_000 + n, text.replace(" ", "  \t"), *rest))  # an exact copy
        rows.append((300_000 + n, f"{text} Write to first.last{n}@mail-{n}.org or call +1 (743) 555-{1000 + n}.", *rest))
    rows += [(r[0] and r[0] + 900_000, *r[1:]) for r in ODD]
    from pyspark.sql import functions as F

    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    made.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)}).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_matches_plain_steps(spark, tmp_path):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    sf = fixture(spark, tmp_path)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels)).collect()
    accepted = Counter((r.doc_id, r.score) for r in scored if r.score >= 0.7)
    ids = {i for i, _ in accepted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in ids or r.doc_id is None]
    if None not in ids:
        rows = [r for r in rows if r[0] is not None]
    first = {}
    for i, t in rows:
        k = exact_dedup.normalise((t or "").encode())
        if k not in first or (i is not None and (first[k][0] is None or i < first[k][0])):
            first[k] = (i, t)
    kept = [*first.values()]
    stay = near_plain([r for r in kept if r[0] is not None])
    kept = [r for r in kept if r[0] is None or r[0] in stay]
    spans = {(r.doc_id, bytes(r.sha)): r.found for r in pii.find(spark.createDataFrame(kept, "doc_id long, text string")).collect()}
    tok, want = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for i, t in kept:
        text, at = "", 0
        for s, k, e in spans[i, hashlib.sha256((t or "").encode()).digest()]:
            if s >= at:
                text += t[at:s] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, e)
        ids_ = [*tok.encode(text + (t or "")[at:], add_special_tokens=False).ids, 2]
        for s in range(0, len(ids_), 4096):
            part = ids_[s : s + 4096]
            want[i, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids_)] += 1
    got = p.run(spark, sf).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert 30 < len(kept) < len(rows) < len(scored)
    assert any(len(f) for f in spans.values())


def test_stages_keep_columns_and_tables_go(spark, tmp_path):
    import os

    import corpus_pipeline as p

    sf = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes and out.count() > 0, name
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    assert p.STAGES[-1][1](spark, docs.where("false"), sf).count() == 0
    with common.scratch():
        inner = common.stored(spark.range(3), "probe")
        with common.scratch():
            common.stored(spark.range(3), "probe")
            kept = common.stored(spark.range(4), "probe", keep=True)
        assert kept.count() == 4 and inner.count() == 3
    assert not any(os.path.exists(x._stored_path.removeprefix("file://")) for x in (kept, inner))


def test_unused_name(spark):
    df = spark.createDataFrame([(1, 2)], "a int, A_ int")
    assert common.unused(df, "a") == "a__" and common.unused(df, "b") == "b"
