"""Exact deduplication by an extendible-hash index on shared files.

1. Map tasks normalise white space, hash each text and combine equal texts of their own input (compared as bytes), so that a
   group of copies, however large, sends at most one text a task. Representatives (with text) and members (without) go to a
   staging table in the shared folder.
2. The directory: the representatives' bytes are summed by a prefix of the hash. From one bucket, a bucket over capacity is
   split on its next bit; where its local depth passes the global depth, the directory doubles. It has at most 2^MAX_DEPTH
   entries, whatever the corpus, and lies in the shared folder too. Capacity is BUCKET_BYTES at most, and less where that leaves
   few buckets for the session's shuffle partitions.
3. Owner tasks take ranges of the key: consecutive buckets, in hash order, up to a bucket's capacity, one owner a partition. Rows
   of one hash form a chain; each text is compared as bytes with the heads of the chain, so a hash collision can't join different
   texts. The owners' entries (representative, kept id, group size) are the index's pages, files in the shared folder.
4. Members look up their representative's entry; a representative has no more members than one map task had rows. Where only the
   surviving rows are wanted, whole rows are staged and owner tasks return them, with no look-up.

Null text counts as empty. Rows with a null doc_id stay apart in the result, sort last and can't displace a row with an id;
repeated rows with the kept doc_id are all returned and all marked kept (survivors() leaves one). Very long texts are hashed and compared
whole. An empty table gives an empty result. exact_dedup() ignores columns other than doc_id and text; survivors() keeps them,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import as_binary, prepare, stored, table, unused

MAX_DEPTH = 17
BUCKET_BYTES, LEAST_BYTES = 16 << 20, 128 << 10
#: Texts that a map task remembers for combining copies: rows and bytes. Copies beyond meet at their owner instead.
LOCAL_ROWS, LOCAL_BYTES = 50_000, 32 << 20


_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_RUN = re.compile(b"  +")

_STAGED = pa.schema([("rep", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("sha", pa.binary()), ("text", pa.binary()), ("low", pa.int64()), ("n", pa.int64())])
_STAGED_SQL = "rep long, doc_id long, h long, sha binary, text binary, low long, n long"


def normalise(text: bytes) -> bytes:
    """Each run of space, tab, line feed, vertical tab, form feed and carriage return becomes one space."""
    text = text.translate(_SPACES)
    return _RUN.sub(b" ", text) if b"  " in text else text


def _before(a: int | None, b: int | None) -> bool:
    """Whether id a comes before id b; null ids come last."""
    return a is not None and (b is None or a < b)


def _combine(batches):
    """rep is unique: the task's partition number and a running number."""
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 36, 0
    heads: dict[bytes, list] = {}  # digest -> [text, rep, lowest id, rows]
    held = 0

    def flush():
        rows = [(rep, None, int.from_bytes(d[:8], "little", signed=True), d, text, low, n) for d, (text, rep, low, n) in heads.items()]
        heads.clear()
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 1000], strict=True), _STAGED, strict=True)], schema=_STAGED)

    for batch in batches:
        members = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = normalise(text)
            digest = hashlib.sha256(text).digest()
            head = heads.get(digest)
            if head is None or head[0] != text:
                if head is not None or len(heads) >= LOCAL_ROWS or held + len(text) > LOCAL_BYTES:
                    yield from flush()
                    held = 0
                head = heads[digest] = [text, base + made, doc_id, 0]
                made, held = made + 1, held + len(text)
            if _before(doc_id, head[2]):
                head[2] = doc_id
            head[3] += 1
            members.append((head[1], doc_id, None, digest, None, None, None))
        if members:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*members, strict=True), _STAGED, strict=True)], schema=_STAGED)
    yield from flush()


def directory(weights: dict[int, int], depth: int, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """Global depth and, for each of the 2^depth prefixes, the (bucket, local depth) that its directory entry points to."""
    entries, buckets, depth_now = [0], [(0, 0)], 0  # a bucket: its prefix at its local depth, that depth
    totals = {0: sum(weights.values())}
    split = [0]
    while split:
        b = split.pop()
        prefix, local = buckets[b]
        if totals[b] <= capacity or local == depth:
            continue
        if local == depth_now:
            entries, depth_now = [e for e in entries for _ in (0, 1)], depth_now + 1  # doubling
        new = len(buckets)
        buckets[b], shift = (prefix << 1, local + 1), depth_now - local - 1
        buckets.append((prefix << 1 | 1, local + 1))
        for i in range((prefix << 1 | 1) << shift, (prefix << 1 | 1) + 1 << shift):
            entries[i] = new
        low, high = (prefix << 1 | 1) << depth - local - 1, (prefix << 1 | 1) + 1 << depth - local - 1
        totals[new] = sum(weights.get(p, 0) for p in range(low, high))
        totals[b] -= totals[new]
        split += [b, new]
    return depth_now, [(e, buckets[e][1]) for e in entries]


_OWNED = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("first_rep", pa.int64())])


def _own(batches):
    """Chains of equal hashes; the rows come sorted by hash."""
    now, chain = None, []  # a chain's links: [text, lowest id, rows, first rep, reps]

    def emit():
        for _, low, n, first, reps in chain:
            for i in range(0, len(reps), 10_000):
                part = reps[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([low] * len(part), pa.int64()), pa.array([n] * len(part), pa.int64()), pa.array([first] * len(part), pa.int64())], schema=_OWNED)

    for batch in batches:
        for h, rep, text, low, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if h != now:
                yield from emit()
                now, chain = h, []
            link = next((x for x in chain if x[0] == text), None)
            if link is None:
                chain.append([text, low, n, rep, [rep]])
            else:
                if _before(low, link[1]):
                    link[1], link[3] = low, rep
                link[2] += n
                link[4].append(rep)
    yield from emit()


def owners(buckets: list[int], weights: dict[int, int], capacity: int) -> dict[int, int]:
    """An owner for each bucket: consecutive buckets share one up to capacity."""
    out, now, held = {}, 0, 0
    for b in buckets:
        if held and held + weights[b] > capacity:
            now, held = now + 1, 0
        out[b] = now
        held += weights[b]
    return out


def _dealt(rows: DataFrame, h: str, text: str, capacity: int) -> DataFrame:
    """rows with whole buckets of the directory in one partition each, in key ranges, sorted by hash."""
    spark, weight = rows.sparkSession, F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)
    size = rows.agg(F.coalesce(weight, F.lit(0))).first()[0]
    capacity = min(capacity, max(LEAST_BYTES, size // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    depth = min(MAX_DEPTH, max(0, (size // capacity).bit_length() + 2))
    prefix = F.shiftrightunsigned(h, 64 - depth).cast("int") if depth else F.lit(0)
    weights = {r[0]: r[1] for r in rows.groupBy(prefix.alias("p")).agg(weight).collect()}  # at most 2^depth rows
    depth_now, entries = directory(weights, depth, capacity)
    held = dict.fromkeys((b for b, _ in entries), 0)  # in hash order
    for p, w in weights.items():
        held[entries[p >> depth - depth_now][0]] += w
    owner = owners([*held], held, capacity)
    entry, bucket, own = (unused(rows, c) for c in ("entry", "bucket", "owner"))
    pages = spark.createDataFrame([(i, b, owner[b]) for i, (b, _) in enumerate(entries)], f"{entry} int, {bucket} int, {own} int")
    pages = stored(pages, "dedup-directory")  # 2^MAX_DEPTH rows at most
    number = F.shiftrightunsigned(h, 64 - depth_now).cast("int") if depth_now else F.lit(0)
    named = rows.withColumn(entry, number).join(F.broadcast(pages.drop(bucket)), entry)
    return named.repartitionById(max(owner.values(), default=0) + 1, own).drop(entry, own).sortWithinPartitions(h)


def exact_dedup(docs: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    prepare(docs.sparkSession)
    staged = stored(docs.select(F.col("doc_id").cast("long"), as_binary("text")).mapInArrow(_combine, _STAGED_SQL), "dedup-staged")
    reps = staged.where("text is not null").select("h", "rep", "text", "low", "n")
    owned = _dealt(reps, "h", "text", capacity).mapInArrow(_own, "rep long, keep_id long, group_size long, first_rep long")
    index = stored(owned, "dedup-index")
    members = staged.where("text is null").select("rep", "doc_id", "sha").join(index, "rep")
    return members.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _texts(batch) -> list[bytes]:
    return [normalise(t or b"") for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]


def _heads(batches):
    """Whole rows, one for each text of a task's input: that of the smallest id. The id comes as the last column; hash and id go as the last two."""
    heads: dict[bytes, list] = {}  # normalised text -> [id, the rows that hold the row, its place among them]
    held = 0

    def flush():
        h = [int.from_bytes(hashlib.sha256(t).digest()[:8], "little", signed=True) for t in heads]
        for i in range(0, len(h), 1000):
            part = [*heads.values()][i : i + 1000]
            rows = pa.Table.from_batches([b.slice(at, 1) for _, b, at in part]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(h[i : i + 1000], pa.int64()), pa.array([x[0] for x in part], pa.int64())], names=[f"c{c}" for c in range(rows.num_columns + 2)])
        heads.clear()

    for batch in batches:
        width, fresh = batch.num_columns - 1, {}
        for i, (doc_id, text) in enumerate(zip(batch.column(width).to_pylist(), _texts(batch), strict=True)):
            head = heads.get(text)
            if head is None:
                held += len(text)
                heads[text] = fresh[text] = [doc_id, None, i]
            elif _before(doc_id, head[0]):
                head[:] = doc_id, None, i
                fresh[text] = head
        rows = batch.select(range(width)).take(pa.array([x[2] for x in fresh.values()], pa.int64()))  # a copy, so that the batch can go
        for at, head in enumerate(fresh.values()):
            head[1:] = rows, at
        if len(heads) >= LOCAL_ROWS or held > LOCAL_BYTES:  # passed by one batch at most
            yield from flush()
            held = 0
    yield from flush()


def _winners(batches):
    """Of each chain's equal texts the row with the smallest id; the rows come sorted by hash, with hash and id last."""
    now, chain = None, []  # a chain's links: [text, lowest id, row]
    for batch in batches:
        width, done = batch.num_columns - 2, []
        rows = batch.select(range(width))
        for i, (text, h, low) in enumerate(zip(_texts(batch), batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True)):
            if h != now:
                done += [x[2] for x in chain]
                now, chain = h, []
            link = next((x for x in chain if x[0] == text), None)
            if link is None:
                chain.append([text, low, rows.slice(i, 1)])
            elif _before(low, link[1]):
                link[1:] = low, rows.slice(i, 1)
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if chain:
        yield from pa.Table.from_batches([x[2] for x in chain]).combine_chunks().to_batches()


def survivors(docs: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """The rows of docs that stay, one for each group, with the columns of docs.

    Whole rows go through the index, and owner tasks return those that stay; so no text is dealt out a second time to meet its verdict.
    """
    prepare(docs.sparkSession)
    h, low = unused(docs, "hash"), unused(docs, "low")
    marks = T.StructType([*docs.schema.fields, T.StructField(h, T.LongType()), T.StructField(low, T.LongType())])
    staged = stored(docs.select("*", F.col("doc_id").cast("long").alias(low)).mapInArrow(_heads, marks), "dedup-heads")
    return _dealt(staged, h, "text", capacity).mapInArrow(_winners, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
