"""Near-duplicates by the similarity of texts: 5-word shingles, Jaccard similarity of SIMILAR or more.

Shingles: all runs of 5 words (A-Z lower-cased; fewer words: the whole sequence; no word: none), as a set of XXH64 values; texts
of one set are one node. Candidate pairs come in three steps, each compared by its whole sets (similar), and are joined to components by star
contraction (simhash_dedup). What one step has connected, the next doesn't look at again.

1. Fingerprints in a Gray-order hierarchical index (GrayIndex of simhash_dedup). A bit of the fingerprint is 1 if set in over half of the shingles. The
64 bits are seven blocks; fingerprints that differ in DISTANCE = 5 bits or fewer agree on two whole blocks at least, so each goes to 21 tables keyed
by two blocks; a key of more than GROUP rows is dealt anew by six sub-blocks of the other bits, of which one agrees
(what is still longer is searched in runs of GROUP rows by fingerprint). Of one key's links as many are taken
as connect it, so a group of copies makes no pairs in number of its square. On the check tables similar texts differ in up to 22 bits (half of them in 8 and
more), so these links are a part of all; the other steps find the rest.
2. Heads. No pair is lost to a fingerprint: with all shingles in one order, two sets of similarity 4/5 share one of their first n - ceil(4n/5) + 1
shingles (prefix filter). The order puts shingles common in a sample last, the rest by value; the sample affects the work only, never the
result. For leading shingles whose nodes lie in several components, each set is paired with up to 8 heads of the shingle.
3. For those that still do, all pairs across components that can be similar, by a Gray-order index of each shingle's bitmaps (the parity of the
set's shingles in each of BITS slots), searched from the nodes outside the shingle's largest component. Shingles of more than GROUP nodes are dealt as pairs of parts.

Pairs whose sizes, shared leading shingles, places of their first shared shingle or bitmaps rule the
similarity out aren't made or compared: in the order, what two similar sets of m and n share lies from their first shared shingle on, so
this stands 4(m+n)/9 shingles from either end at least; and bitmaps differ in (m+n)/9 bits at most. No true pair is lost to any of these.

Null text counts as empty; texts without words are one node. Rows without an id stay and name no component. Repeated rows
count once; those of an id that stays all stay. Texts of any length are read whole. An empty table gives an empty result. Other columns are kept,
whatever their names.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import as_binary, discard, prepare, scratch, stored, unused, word_bounds
from flowloom.llm.simhash_dedup import GrayIndex, components, gray_rank

SHINGLE, SEED = 5, 42
SIMILAR = (4, 5)  #: similarity, as a fraction
BITS = 256
DISTANCE = 5  #: bits in which linked fingerprints differ at most
BLOCKS = [(9 * i, 9 if i < 6 else 10) for i in range(7)]  #: first bit and width
GROUP, FEW = 4096, 32  #: rows of one key beyond which it is split; rows that are compared without an index
HEADS = [(i << 61) - (1 << 63) for i in range(8)]  #: a shingle's heads are the smallest of its nodes, each time with other leading bits
PART, OFTEN, MOST = 8, 4, 1 << 19  #: one text in PART is sampled; shingles of OFTEN or more of those are common, at most so many


def shingles(data: bytes) -> np.ndarray:
    """The sorted distinct shingles."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    norm, k = b" ".join(words), min(SHINGLE, len(words))
    _, starts, ends, _ = word_bounds(norm)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(norm[s:e], SEED) for s, e in spans), np.uint64, len(words) - k + 1).view(np.int64))


def leading(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets share one at least. common is sorted."""
    up, down = SIMILAR
    n = len(found)
    often = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found if len(common) else np.zeros(n, bool)
    return np.concatenate((found[~often], found[often]))[: n - -(-up * n // down) + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Four 64-bit words of parities; two sets' bitmaps differ in no more bits than the sets in shingles."""
    odd = np.bincount((found.view(np.uint64) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fingerprint(found: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the shingles; no shingle: zero."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(found), 8192):
        total += np.unpackbits(found[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(found), bitorder="little").view("<i8")[0])


_MAPS = [f"g{i}" for i in range(BITS // 64)]


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - 2**63


def _common(texts: DataFrame) -> np.ndarray:
    def run(batches):
        for batch in batches:
            for t in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t))], names=["s"])

    counts = texts.where(F.pmod(F.col("key"), F.lit(PART)) == 0).select("key", "text").mapInArrow(run, "s long").groupBy("s").count()
    return np.array(sorted(r.s for r in counts.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "s").limit(MOST).collect()), np.int64)


def _scan(texts: DataFrame) -> DataFrame:
    """doc_id, key, node, n, fp, lead, g0 to g3 (the bitmap): a row for each text."""
    common = _common(texts)

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            lead = pa.array([leading(s, common) for s in sets], pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([fingerprint(s) for s in sets], pa.int64()), lead]
            maps = np.stack([bitmap(s) for s in sets]) if sets else np.zeros((0, len(_MAPS)), np.int64)
            columns += [pa.array(np.ascontiguousarray(maps[:, i]), pa.int64()) for i in range(len(_MAPS))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "node", "n", "fp", "lead", *_MAPS])

    return texts.mapInArrow(run, f"doc_id long, key long, node long, n int, fp long, lead array<long>, {', '.join(f'{g} long' for g in _MAPS)}")


def _sets(batches):
    for batch in batches:
        sets = [shingles(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "held"])


def _verified(batches):
    for batch in batches:
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        yield batch.select([0, 1]).filter(pa.array([similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in pairs], pa.bool_()))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _verify(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sets are similar."""
    keys = stored(nodes.join(_ends(pairs), "node").select("key"), "near-keys")
    sets = stored(texts.join(keys, "key", "left_semi").select("text").mapInArrow(_sets, "node long, held binary").dropDuplicates(["node"]), "near-sets")
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    return stored(two.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "near-pairs")


def _fits(m: str, n: str) -> F.Column:
    return SIMILAR[1] * F.least(m, n) >= SIMILAR[0] * F.greatest(m, n)


def _enough(m: str, n: str, both: str) -> F.Column:
    """Whether sets of m and n shingles can be similar if they share so many leading ones.

    One set has all its shared shingles among these and its others, ceil(4n/5) - 1 at most.
    """
    up, down = SIMILAR
    return (F.col(both) + F.ceil(up * F.greatest(m, n) / down) - 1) * (up + down) >= up * (F.col(m) + F.col(n))


def _close(n: str, m: str, a: str, b: str) -> F.Column:
    """Whether the bitmaps (columns with prefixes a and b) allow the similarity."""
    up, down = SIMILAR
    differ = sum((F.bit_count(F.col(f"{a}{g}").bitwiseXOR(F.col(f"{b}{g}"))) for g in _MAPS), F.lit(0))
    return differ * (up + down) <= (F.col(n) + F.col(m)) * (down - up)


def _far_from_end(n: str, m: str, at: str) -> F.Column:
    """Whether a set of n that shares nothing with one of m before place at can be similar to it."""
    up, down = SIMILAR
    return (F.expr(n) - F.expr(at)) * (up + down) >= (F.expr(n) + F.expr(m)) * up


def _open(live: DataFrame, comp: DataFrame, *old: DataFrame) -> DataFrame:
    """The rows (s, node, ...) of shingles whose nodes lie in several components, with the component; live (old) is deleted."""
    named = stored(live.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near-named")
    discard(*(old or (live,)))
    several = named.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("s")
    out = stored(named.join(several, "s", "left_semi"), "near-live")
    discard(named)
    return out


def _by_key(batches, most: int | None = None):
    """The rows of each key, as tuples without it. Rows come sorted by key. most: longer runs come in parts that share a row."""
    now, rows = None, []
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if len(rows) > 1:
                    yield rows
                now, rows = key, []
            elif len(rows) == most:
                yield rows
                rows = rows[-1:]
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _fit(m: int, n: int) -> bool:
    return SIMILAR[1] * min(m, n) >= SIMILAR[0] * max(m, n)


def linked(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of rows (fp, node, n) of one key: pairs of nodes with linked fingerprints and fitting sizes, as many as connect what such pairs connect."""
    index = GrayIndex([fp & 2**64 - 1 for fp, *_ in rows]) if len(rows) > FEW else None
    at: dict[int, list[int]] = {}
    for i, (fp, *_) in enumerate(rows):
        at.setdefault(fp & 2**64 - 1, []).append(i)
    parent, out = list(range(len(rows))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (fp, node, n) in enumerate(rows):
        x = fp & 2**64 - 1
        close = (index.fps[j] for j in index.within(x, DISTANCE)) if index else (y for y in at if (x ^ y).bit_count() <= DISTANCE)
        for j in (j for y in close for j in at[y] if j > i and _fit(n, rows[j][2])):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((node, rows[j][1]))
    return out


def _pairs(batches, found, most: int | None = None):
    for rows in _by_key(batches, most):
        if pairs := found(rows):
            yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in pairs], pa.int64()) for f in (min, max)], names=["a", "b"])


def _links(batches):
    yield from _pairs(batches, linked, GROUP)


def links(nodes: DataFrame) -> DataFrame:
    """a, b: candidate pairs of nodes (node, fp, n) by the index of fingerprints."""
    block = lambda i, off=0, width=None: F.shiftrightunsigned("fp", BLOCKS[i][0] + off).bitwiseAND(F.lit((1 << (width or BLOCKS[i][1] - off)) - 1))
    tables = list(itertools.combinations(range(7), 2))
    keys = [F.shiftleft(F.lit(t).cast("long"), 32).bitwiseOR(F.shiftleft(block(i), 10)).bitwiseOR(block(j)) for t, (i, j) in enumerate(tables)]
    keyed = nodes.select("fp", "node", "n", F.explode(F.array(*keys)).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.lit(True).alias("large"))
    # A key over GROUP: six sub-blocks of the other bits; at most five bits differ, so one sub-block agrees.
    parts = F.lit(None).cast("array<long>")
    for t, pair in enumerate(tables):
        *whole, cut = (k for k in range(7) if k not in pair)
        parts = F.when(F.shiftrightunsigned("key", 32) == t, F.array(*(block(k) for k in whole), block(cut, 0, 4), block(cut, 4))).otherwise(parts)
    dealt = keyed.join(large, "key", "left").select("fp", "node", "n", "key", F.posexplode(F.when(F.col("large"), parts).otherwise(F.array(F.lit(0).cast("long")))).alias("sub", "part"))
    # Table, blocks, sub-block and its bits lie side by side in 64 bits.
    group = F.shiftleft("key", 14).bitwiseOR(F.shiftleft(F.col("sub").cast("long"), 11)).bitwiseOR(F.col("part"))
    return dealt.select(group.alias("k"), "fp", "node", "n").repartition("k").sortWithinPartitions("k", "fp").mapInArrow(_links, "a long, b long")


class MapIndex(GrayIndex):
    """The same tree over bitmaps of BITS bits, in Gray order word by word."""

    def __init__(self, maps: list[int]):
        self.fps = sorted(set(maps), key=lambda x: [gray_rank(x >> i & 2**64 - 1) for i in range(BITS - 64, -1, -64)])
        self.root = self._node(0, len(self.fps), (1 << BITS) - 1)


def crossing(rows: list[tuple]) -> set[tuple[int, int]]:
    """Of rows (node, n, at, comp, x, y, part, g0 to g3) of one shingle: pairs across components that can be similar. Rows of parts x and y: if these
    differ, pairs of one part belong elsewhere."""
    up, down = SIMILAR
    (most, _), *others = Counter(r[3] for r in rows).most_common()
    out: set[tuple[int, int]] = set()
    if not others:
        return out
    at: dict[int, list[tuple]] = {}
    for node, n, place, comp, x, y, part, *words in rows:
        held = 0
        for i, w in enumerate(words):
            held |= (w & 2**64 - 1) << 64 * i
        at.setdefault(held, []).append((node, n, place, comp, x != y, part))
    index = MapIndex(list(at)) if len(at) > FEW else None
    for held, same in at.items():
        for node, n, place, comp, apart, part in same:
            if comp == most:
                continue
            limit = n * (down - up) // up  # m is n * 5 / 4 at most
            for other in (index.fps[j] for j in index.within(held, limit)) if index else at:
                differ = (held ^ other).bit_count() * (up + down)
                for node2, m, place2, comp2, _, part2 in at[other]:
                    if comp2 == comp or apart and part == part2 or differ > (n + m) * (down - up) or not _fit(n, m):
                        continue
                    if min(n - place, m - place2) * (up + down) >= (n + m) * up:
                        out.add((min(node, node2), max(node, node2)))
    return out


def _crossing(batches):
    yield from _pairs(batches, crossing)


def across(rest: DataFrame) -> DataFrame:
    """a, b: the pairs across components of rows (s, node, n, at, comp, g0 to g3), one time or more."""
    large = rest.groupBy("s").count().where(F.col("count") > GROUP).select("s", F.ceil(F.col("count") / GROUP).cast("int").alias("of"))
    sized = rest.join(large, "s", "left").withColumn("of", F.coalesce("of", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    dealt = sized.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.withColumn("x", F.least("part", "with")).withColumn("y", F.greatest("part", "with"))
    dealt = dealt.select(F.xxhash64("s", "x", "y").alias("k"), "node", "n", "at", "comp", "x", "y", "part", *_MAPS)
    return dealt.repartition("k").sortWithinPartitions("k").mapInArrow(_crossing, "a long, b long")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, node, component_id (the smallest doc_id of the component): one row for each row of docs."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(as_binary("text")).alias("key"), as_binary("text").alias("text"))
    marked = stored(_scan(texts), "near")
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("key").alias("key"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("lead").alias("lead"), *(F.min(g).alias(g) for g in _MAPS)), "near-nodes")
    rows = stored(marked.select("doc_id", "node"), "near-rows")
    discard(marked)
    maps = nodes.select("node", "n", *(F.col(g).alias(f"a{g}") for g in _MAPS))
    other_maps = nodes.select(F.col("node").alias("end"), F.col("n").alias("m"), *(F.col(g).alias(f"b{g}") for g in _MAPS))
    linked = links(nodes).distinct().select(F.col("a").alias("node"), F.col("b").alias("end")).join(maps, "node")
    linked = stored(linked.join(other_maps, "end").where(_close("n", "m", "a", "b")).select(F.col("node").alias("a"), F.col("end").alias("b")), "near-linked")
    edges = _verify(linked, texts, nodes)
    comp = stored(components(edges), "near-comp")

    each = nodes.select("node", "n", F.posexplode("lead").alias("at", "s"))  # texts of one set count once, and a node has a shingle once
    shared = stored(each.groupBy("s").count().where("count > 1").select("s"), "near-shared")
    live = stored(each.join(shared, "s"), "near-live")
    discard(shared)
    live = _open(live, comp)
    heads = [F.min(F.col("node").bitwiseXOR(F.lit(c))).bitwiseXOR(F.lit(c)) for c in HEADS]
    tops = stored(live.groupBy("s").agg(F.array_distinct(F.array(*heads)).alias("heads")), "near-heads")
    ends = live.join(tops, "s").select("node", "n", "comp", F.explode("heads").alias("end")).where("node != end").groupBy("node", "n", "comp", "end").agg(F.count("*").alias("both"))
    named = other_maps.join(comp.select(F.col("node").alias("end"), F.col("comp").alias("comp2")), "end", "left").withColumn("comp2", F.coalesce("comp2", "end"))
    # Sets of two components share no shingle but open ones.
    sized = ends.join(named, "end").where((F.col("comp") != F.col("comp2")) & _fits("m", "n") & _enough("m", "n", "both")).join(maps.drop("n"), "node").where(_close("n", "m", "a", "b"))
    first = stored(sized.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct().join(linked, ["a", "b"], "left_anti"), "near-first")
    discard(tops)
    edges = edges.unionByName(_verify(first, texts, nodes))
    comp = stored(components(edges), "near-comp")

    live = _open(live.drop("comp"), comp, live)
    # A set whose shingle stands too far on for any set that fits can't meet another there.
    rest = live.where(_far_from_end("n", f"ceil({SIMILAR[0]} * n / {SIMILAR[1]})", "at")).join(nodes.select("node", *_MAPS), "node")
    rest = stored(rest.select("s", "node", "n", "at", "comp", *_MAPS), "near-rest")
    discard(live)
    near = stored(across(rest).distinct().join(first.unionByName(linked), ["a", "b"], "left_anti"), "near-across")
    discard(rest)
    # Of the pairs left, long sets above all, the leading shingles are compared before the whole sets.
    held = stored(nodes.join(_ends(near), "node", "left_semi").select("node", "n", "lead"), "near-leads")
    leads = held.select(F.col("node").alias("a"), "n", F.col("lead").alias("x")), held.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("lead").alias("y"))
    shared_leads = near.join(leads[0], "a").join(leads[1], "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    second = stored(shared_leads.where(_enough("m", "n", "both")).select("a", "b"), "near-second")
    discard(near, held)
    if second.take(1):
        more = _verify(second, texts, nodes)
        if more.take(1):
            comp = stored(components(edges.unionByName(more)), "near-comp")

    owner = nodes.select("node", "low").join(comp, "node", "left").select("node", "low", F.coalesce("comp", "node").alias("comp"))
    owner = stored(owner, "near-owner")
    lowest = stored(owner.groupBy("comp").agg(F.min("low").alias("component_id")), "near-low")
    return rows.join(owner.join(lowest, "comp").select("node", "component_id"), "node").select("doc_id", "node", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names their component, with the columns of docs; rows without an id stay.

    Of one component the document with the smallest doc_id stays; repeated rows of that id all stay.
    """
    name = unused(docs, "gone")
    with scratch():
        found = near_components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
        gone = stored(found.where("not stays").select(F.col("doc_id").alias(name)), "near-gone", keep=True)
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
