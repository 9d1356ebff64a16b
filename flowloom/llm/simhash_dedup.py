"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: bit i is 1 if it is set in over half of the XXH64 values of the 3-word shingles (A-Z lower-cased, repeats
counted; fewer words: the whole sequence; no word: fingerprint zero). Equal fingerprints are one node from then on, so a group
of copies costs one node.

Links (2 or fewer differing bits) between distinct fingerprints: the 64 bits are four blocks of 16; two linked fingerprints
agree on two whole blocks at least, so each fingerprint goes to six tables keyed by two blocks. Rows of one key are sorted by
Gray rank, in which neighbours differ in few bits, and form a hierarchical index: a node holds the bits that its fingerprints
share (mask and pattern); a search adds up the differing shared bits on its way down and leaves a whole group once they pass
the limit. A key with more rows than GROUP is dealt anew by two further sub-blocks of the other 32 bits, exactly as above, so
no task gets an unbounded group. Within a group links are reduced to a spanning forest (no connection is lost).

Components: alternating large-star and small-star steps over fingerprint nodes, written to the shared folder each round.

Null text counts as empty. Null doc_id: the row is fingerprinted and linked, but can't name a component unless it is alone
with other null ids (component_id is then null). Repeated rows are all returned; ties between roots go to the smaller fingerprint. Texts of any
length are read whole. An empty table gives an empty result. simhash_dedup() ignores columns other than doc_id and text; survivors()
keeps them, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import as_binary, discard, prepare, scratch, stored, table, unused, word_bounds

SHINGLE, DISTANCE, SEED = 3, 2, 42
GROUP = 4096  #: rows of one key beyond which the key is split
LEAF = 8  #: fingerprints of a leaf of the index


def fingerprint(data: bytes) -> int:
    words = data.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    k = min(SHINGLE, len(words))
    _, starts, ends, _ = word_bounds(norm)
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    while part := [digest(norm[s:e], SEED) for s, e in itertools.islice(spans, 8192)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        out = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), as_binary("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


class GrayIndex:
    """A tree over fingerprints in Gray order. Upper nodes hold the bits shared by all below that no node above holds."""

    def __init__(self, fps: list[int]):
        self.fps = sorted(set(fps), key=gray_rank)
        self.root = self._node(0, len(self.fps), (1 << 64) - 1) if self.fps else None

    def _node(self, low: int, high: int, free: int):
        """(mask, pattern, low, high, children): mask has free bits on which fps[low:high] agree."""
        first, differ = self.fps[low], 0
        for x in self.fps[low + 1 : high]:
            differ |= x ^ first
        mask = free & ~differ
        if high - low <= LEAF:
            return mask, first & mask, low, high, None
        mid = (low + high) // 2
        return mask, first & mask, low, high, (self._node(low, mid, free & ~mask), self._node(mid, high, free & ~mask))

    def within(self, x: int, limit: int, start: int = 0):
        """Positions from start on whose fingerprint differs from x in at most limit bits."""
        stack = [(self.root, 0)] if self.root else []
        while stack:
            (mask, pattern, low, high, kids), spent = stack.pop()
            if high <= start:
                continue
            spent += ((x & mask) ^ pattern).bit_count()
            if spent > limit:
                continue
            if kids:
                stack += [(k, spent) for k in kids]
            else:
                for i in range(max(low, start), high):
                    if (x ^ self.fps[i]).bit_count() <= limit:
                        yield i


def gray_rank(x: int) -> int:
    """The position of x in the reflected binary Gray code."""
    for s in (32, 16, 8, 4, 2, 1):
        x ^= x >> s
    return x


def forest(fps: list[int], limit: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links within one group, as (fingerprint, root)."""
    index = GrayIndex(fps)
    fps, parent = index.fps, list(range(len(index.fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(fps):
        for j in index.within(x, limit, i + 1):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [(fps[i], fps[root(i)]) for i in range(len(fps)) if root(i) != i]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link(batches):
    """Rows come sorted by key."""
    now, fps = None, []

    def emit():
        if len(fps) > 1 and (found := forest(fps)):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*found, strict=True)], schema=_EDGES)

    for batch in batches:
        for key, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64).tolist(), strict=True):
            if key != now:
                yield from emit()
                now, fps = key, []
            fps.append(fp)
    yield from emit()


def _block(i: int) -> F.Column:
    return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))


def links(nodes: DataFrame) -> DataFrame:
    """a, b: edges between distinct fingerprints of nodes (fp) that connect all fingerprints that links connect."""
    pairs = list(itertools.combinations(range(4), 2))
    keyed = nodes.select("fp", F.posexplode(F.array(*(F.shiftleft(_block(i), 16).bitwiseOR(_block(j)) for i, j in pairs))).alias("t", "blocks"))
    keyed = keyed.select("fp", F.shiftleft(F.col("t").cast("long"), 32).bitwiseOR(F.col("blocks")).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1")
    sized = keyed.join(sizes, "key")
    rest = F.lit(None).cast("long")
    for t, (i, j) in reversed(list(enumerate(pairs))):
        k, m = (x for x in range(4) if x not in (i, j))
        rest = F.when(F.shiftrightunsigned("key", 32) == t, F.shiftleft(_block(k), 16).bitwiseOR(_block(m))).otherwise(rest)
    # A key over GROUP: three sub-blocks of the other 32 bits; at most two bits differ, so one sub-block agrees.
    sub = F.array(F.shiftrightunsigned(rest, 21), F.shiftrightunsigned(rest, 10).bitwiseAND(F.lit(0x7FF)), rest.bitwiseAND(F.lit(0x3FF)))
    none = F.array(F.lit(0).cast("long"))
    dealt = sized.select("fp", "key", F.posexplode(F.when(F.col("count") > GROUP, sub).otherwise(none)).alias("s", "part"))
    group = F.concat_ws(":", "key", "s", "part")
    grouped = dealt.select(group.alias("g"), "fp").repartition("g").sortWithinPartitions("g")
    return grouped.mapInArrow(_link, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, comp for every node of edges (a, b); comp is the smallest node of its component.

    Large-star: each node's larger neighbours go to its smallest neighbour (or itself). Small-star: likewise its smaller
    neighbours. They alternate until nothing changes; each step counts as partial aggregates, so a hub's row is one sum.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a != b").distinct(), "links")
    last = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        low = stored(low, "star")
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = stored(large, "links")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = stored(down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "star")
        joined = down.join(low2, F.col("a") == F.col("n"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low2.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        small = stored(small, "links")
        state = small.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        for x in (now, low, large, low2):
            discard(x)
        now = small
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs."""
    prepare(docs.sparkSession)
    with scratch():
        marked = stored(fingerprints(docs), "simhash", keep=True)
        nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
        comp = components(links(nodes))
        owner = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "low", F.coalesce("comp", "fp").alias("comp"))
        lowest = stored(owner.groupBy("comp").agg(F.min("low").alias("component_id")), "simhash-low")
        named = stored(owner.join(lowest, "comp").select("fp", "component_id"), "simhash-named", keep=True)
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names their component, with the columns of docs; rows without an id stay.

    Of one component the document with the smallest doc_id stays; repeated rows of that id all stay. The texts are matched with the ids
    that go, mostly a small part of all: Spark broadcasts these where their stored size allows and shuffles both sides where not.
    """
    name = unused(docs, "gone")
    with scratch():
        found = simhash_dedup(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
        gone = stored(found.where("not stays").select(F.col("doc_id").alias(name)), "simhash-gone", keep=True)
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
