"""Removal of passages that an earlier document has, by a compacted De Bruijn graph of token k-mers.

A window is WINDOW consecutive words. Its minimiser is the smallest hash of the K-word k-mers in it; that depends on the window's
words alone. Consecutive windows of one document with one minimiser form an edge of the graph (a super-k-mer): the k-mer with
the words on both sides that its windows reach. Equal windows have equal minimisers, so they lie in edges of one k-mer, and
nothing is lost although there is one row for some tens of words.

1. Each document is cut into edges: (k-mer, 128-bit digest of all the edge's words, document, first and last window). k-mers in a
   single document go.
2. Edges of one k-mer and one digest are one kind; its head is the occurrence in the smallest document. Joins give each
   occurrence in another document its head's coordinates. A k-mer with one kind doesn't branch, and that is all.
3. Branching k-mers: the windows of the heads are read again from the source text, digested with 128 bits, and matched with each other;
   a repeated window gets the coordinates of its first occurrence.
4. Neighbouring repeated edges and windows of a document that continue each other at the head too compact to one path: a span of
   the document, the head's document and the shift between them.
5. The heads' words are read from the source at their coordinates, in chunks of CHUNK words, and joined to the paths. Each path is
   compared word by word; only words in a path that is equal throughout are removed. So hashes and digests choose what is
   compared, and never remove anything by themselves; a repeat would be missed only where two different spans have one XXH3 digest of 128 bits.

A k-mer or passage that a third of all documents hold is one aggregate row and one row for each chunk; joins on them are plain
equi-joins of two shuffled sides, which Spark splits where a key is hot. Equal rows of one document are joined once.

Null text has no words. Rows with null doc_id are returned untouched (no document is known to be earlier) and don't count as
earlier. Repeated ids: rows with one doc_id never remove each other's windows. Texts of any length are cut whole; a text of fewer than WINDOW
words loses nothing. An empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.common import Roller, as_binary, discard, prepare, sliding_min, stored, table, word_bounds

WINDOW, K = 50, 12
CHUNK = 128  #: words of a head that are read and joined as one row
_EDGES = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("kmer", pa.int64()), ("ea", pa.int64()), ("eb", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_EDGES_SQL = "doc_id long, digest long, kmer long, ea long, eb long, first int, last int"
_R = Roller(0x5EED)


def digests(norm: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of the XXH3 digest of each span of bytes."""
    h = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([h(norm[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def edges_of(text: bytes, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, ...] | None:
    """k-mer hash, both halves of the edge's digest, first and last window of each edge of a text; None if it has no window."""
    words = text.split()
    if len(words) < window:
        return None
    norm = b" ".join(words)
    raw, starts, ends, gaps = word_bounds(norm)
    prefix, at = _R.prefix(_R.words(raw, starts, gaps)), np.arange(len(words) - k + 1)
    kmers = sliding_min(_R.spans(prefix, at, at + k), window - k + 1)
    first = np.flatnonzero(np.concatenate(([True], kmers[1:] != kmers[:-1])))
    last = np.concatenate((first[1:], [len(kmers)])) - 1
    whole = digests(norm, starts[first], ends[last + window - 1])
    return kmers[first].view(np.int64), whole[:, 0], whole[:, 1], first, last


def _cut(batches):
    for batch in batches:
        parts, lengths, ids, marks = [], [], [], []
        for doc_id, digest, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (got := edges_of(text)) is not None:
                parts.append(got)
                lengths.append(len(got[0]))
                ids.append(doc_id)
                marks.append(digest)
        if parts:
            kmer, ea, eb, first, last = (np.concatenate(c) for c in zip(*parts, strict=True))
            cols = [np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(marks, np.int64), lengths), kmer, ea, eb, first.astype(np.int32), last.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_EDGES)


_READ = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("at", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("words", pa.binary())])
_READ_SQL = "doc_id long, digest long, at int, a long, b long, words binary"


def _read(batches):
    """Of the source at given spans: digests of the windows of those that branch (at: the window), and the words of all (at: the chunk)."""
    for batch in batches:
        for doc_id, digest, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            words = text.split()
            norm = b" ".join(words)
            _, starts, ends, _ = word_bounds(norm)
            for kind in (True, False):
                parts = [np.arange(s["first"], s["last"] + 1) if kind else np.arange(s["first"] // CHUNK, (s["last"] + WINDOW - 1) // CHUNK + 1) for s in spans if s["branches"] or not kind]
                at = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                for i in range(0, len(at), 20_000):
                    p = at[i : i + 20_000]
                    none = pa.nulls(len(p), pa.int64())
                    if kind:
                        hashes = digests(norm, starts[p], ends[p + WINDOW - 1])
                        values = [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.nulls(len(p), pa.binary())]
                    else:
                        values = [none, none, pa.array([b" ".join(words[c * CHUNK : (c + 1) * CHUNK]) for c in p.tolist()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), doc_id, np.int64)), pa.array(np.full(len(p), digest, np.int64)), pa.array(p.astype(np.int32)), *values], schema=_READ)


def covered(n: int, spans: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
    """Which of n words lie in a window that starts within one of the spans."""
    delta = np.zeros(n + 1, np.int32)
    for first, last in spans:
        delta[first] += 1
        delta[last + window] -= 1
    return np.cumsum(delta[:n]) > 0


def verified(words: list[bytes], evidence: list[dict]) -> list[tuple[int, int]]:
    """The paths (first, last window) whose words all equal their head's."""
    equal: dict[tuple[int, int, int], int] = {}
    for e in evidence:
        first, last, shift, at = e["first"], e["last"], e["shift"], e["chunk"] * CHUNK
        head = e["words"].split()
        low, high = max(at, first + shift), min(at + len(head), last + shift + WINDOW)
        if low < high and words[low - shift : high - shift] == head[low - at : high - at]:
            equal[first, last, shift] = equal.get((first, last, shift), 0) + high - low
    return [(first, last) for (first, last, _), n in equal.items() if n == last + WINDOW - first]


def _remove(batches):
    for batch in batches:
        out = []
        for doc_id, text, evidence in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            kept, gone = text.split(), 0
            n = len(kept)
            if evidence and (spans := verified(kept, evidence)):
                mark = covered(n, spans)
                gone = int(mark.sum())
                kept = [w for w, m in zip(kept, mark.tolist(), strict=True) if not m]
            kept_text = b" ".join(kept)
            out.append((doc_id, n, gone, hashlib.sha256(kept_text).hexdigest(), kept_text.decode()))
        ids, n, gone, sha, kept = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


_SPAN = ["doc_id", "digest", "first", "last", "hdoc", "hdigest", "shift"]


def _paths(spans: DataFrame) -> DataFrame:
    """doc_id, digest, first, last, hdoc, hdigest, shift: spans that continue each other, here and at the head, as one."""
    w = Window.partitionBy("doc_id", "digest").orderBy("first", "last")
    same = [F.col(c) == F.lag(c).over(w) for c in ("hdoc", "hdigest", "shift")]
    goes_on = F.coalesce((F.col("first") <= F.lag("last").over(w) + 1) & same[0] & same[1] & same[2], F.lit(False))
    numbered = spans.withColumn("starts", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("starts").over(w))
    return numbered.groupBy("doc_id", "digest", "path", "hdoc", "hdigest", "shift").agg(F.min("first").alias("first"), F.max("last").alias("last")).select(*_SPAN)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row for each row of docs."""
    prepare(docs.sparkSession)
    text = as_binary("text")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    edges = stored(source.where("doc_id is not null").mapInArrow(_cut, _EDGES_SQL), "edges")

    ends = [f(c).alias(f"{n}_{c}") for c in ("ea", "eb") for f, n in ((F.min, "min"), (F.max, "max"))]
    kmers = edges.groupBy("kmer").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), *ends).where("low < high")
    kmers = stored(kmers.select("kmer", F.expr("min_ea != max_ea or min_eb != max_eb").alias("branches")), "kmers")
    repeated = stored(edges.join(kmers, "kmer"), "repeated")
    discard(edges, kmers)

    kind = ["kmer", "ea", "eb"]
    kinds = stored(repeated.groupBy(*kind).agg(F.min("doc_id").alias("hdoc")), "kinds")
    judged = stored(repeated.join(kinds, kind), "judged")
    discard(repeated, kinds)
    heads = judged.where("doc_id = hdoc").groupBy(*kind).agg(F.min(F.struct("digest", "first")).alias("head"))
    heads = stored(heads.select(*kind, F.col("head.digest").alias("hdigest"), F.col("head.first").alias("hfirst")), "heads")
    known = judged.where("doc_id > hdoc").join(heads, kind).withColumn("shift", F.col("hfirst") - F.col("first")).select(*_SPAN)

    # Heads to read: those of branching k-mers wherever they stand in their document, else one occurrence.
    wanted = judged.where("doc_id = hdoc").select("doc_id", "digest", F.struct("first", "last", "branches").alias("span")).distinct()
    wanted = wanted.groupBy("doc_id", "digest").agg(F.collect_list("span").alias("spans"))  # a document's spans: bounded by its own length
    asked = source.join(wanted, ["doc_id", "digest"]).select("doc_id", "digest", "text", "spans")
    read = stored(asked.mapInArrow(_read, _READ_SQL), "read")

    windows = read.where("words is null").select("a", "b", "doc_id", "digest", "at")
    seen = stored(windows.groupBy("a", "b").agg(F.min("doc_id").alias("hdoc"), F.max("doc_id").alias("high")).where("hdoc < high").drop("high"), "seen")
    met = stored(windows.join(seen, ["a", "b"]), "met")
    origin = met.where("doc_id = hdoc").groupBy("a", "b").agg(F.min(F.struct("digest", "at")).alias("head"))
    origin = stored(origin.select("a", "b", F.col("head.digest").alias("hdigest"), F.col("head.at").alias("hat")), "origin")
    single = met.where("doc_id > hdoc").join(origin, ["a", "b"]).select("doc_id", "digest", F.col("at").alias("first"), F.col("at").alias("last"), "hdoc", "hdigest", (F.col("hat") - F.col("at")).alias("shift"))

    spans = stored(known.unionByName(single).distinct(), "spans")
    discard(seen, met, origin, judged, heads)
    chunks = stored(read.where("words is not null").groupBy("doc_id", "digest", "at").agg(F.first("words").alias("words")), "chunks")
    discard(read)
    chunks = chunks.select(F.col("doc_id").alias("hdoc"), F.col("digest").alias("hdigest"), F.col("at").alias("chunk"), "words")
    paths = _paths(spans).select("*", F.explode(F.expr(f"sequence((first + shift) div {CHUNK}, (last + shift + {WINDOW - 1}) div {CHUNK})")).alias("chunk"))
    paths = paths.withColumn("chunk", F.col("chunk").cast("int")).join(chunks, ["hdoc", "hdigest", "chunk"])
    evidence = paths.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("first", "last", "shift", "chunk", "words")).alias("evidence"))
    joined = source.join(evidence, ["doc_id", "digest"], "left").select("doc_id", "text", "evidence")
    return joined.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")
