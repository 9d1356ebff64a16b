"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Components become floor(256 * x), as 64-bit integers (beyond their range: the nearest). Vectors are range-partitioned by length, the longest
first, and packed to blocks of BLOCK at most; queries are packed to blocks of QUERIES. Vector blocks are visited in rounds of
descending length (OPENING blocks, then the rest). After each round a query knows k scores at best; the least of them, its bound, over its length is the
length that a vector needs to get in (Cauchy-Schwarz). A query block visits the vector blocks of a round whose longest
vector has the least length that any of its queries needs: an equi-join on levels of length (LEVELS an octave), so pairs that
can't matter are never made. In a pair of blocks scores are built up along the axes of an SVD (fitted on a sample of the vectors; any rotation
gives right results), and a vector is dropped for a query once its partial sum plus the product of both remaining lengths can't
reach the bound. What remains is scored in integers of any size, so results are exact; float bounds have a margin.

Blocks have a bounded number of rows and bytes, so that memory doesn't depend on the corpus; the work is queries times vectors at worst,
less what the bounds prune. Vectors of one length, however many, are dealt to many blocks by a hash.

Null vectors, and vectors with a null or non-finite component, take no part. Vectors of different lengths are padded with zeros. Rows
with null vec_id take no part. Repeated vec_ids: each row is a candidate of its own, and each row of a query's id is a query of its own with
every other row as a candidate; so such a query_id has several rows of each rank. Ties go to the smaller vec_id. Scores beyond 38 digits
count as 38 nines; a score beyond a long is returned as the nearest long. Empty tables give an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.common import discard, prepare, stored, table

TOP, EVERY = 5, 50
BLOCK, QUERIES, BLOCK_BYTES = 8192, 1024, 32 << 20
SAMPLE, STEP, CHUNK = 4096, 16, 128
OPENING = (1, 8, 64, 512)  #: blocks of the first rounds
LEVELS = 8
ROTATED = 2048  #: vectors of more components keep their axes
SCALE = 256

_SCORE = pa.decimal128(38, 0)
_MOST = 10**38 - 1
_FOUND_SQL = "qrow long, vec_id long, score decimal(38,0)"
_BLOCK_SQL = "block long, hi double, n int, width int, rows binary, ids binary, data binary"
_WIDTHS = {2: np.int16, 4: np.int32, 8: np.int64}


def vectors(rows: DataFrame) -> DataFrame:
    """row (unique), vec_id, v (array of long), norm2 of the rows that take part."""
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    out = rows.where(F.col("vec_id").isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _packer(dim: int, size: int):
    def run(batches):
        """Blocks of at most size rows, in the order of the rows."""
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 36, [], 0

        def emit():
            nonlocal number
            rows, ids, norms, data = (np.concatenate(c) for c in zip(*held, strict=True))
            most = max(int(data.max(initial=0)), -int(data.min(initial=0)))
            width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
            values = [number, float(np.sqrt(norms.max())), len(rows), width, rows.tobytes(), ids.tobytes(), data.astype(_WIDTHS[width]).tobytes()]
            number += 1
            types = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], names=[c.split()[0] for c in _BLOCK_SQL.split(", ")])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                data = np.zeros((part.num_rows, dim), np.int64)
                for i, v in enumerate(part.column(2)):
                    own = v.values.to_numpy(zero_copy_only=False)
                    data[i, : len(own)] = own
                held.append((*(part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3)), data))
                at, n = at + part.num_rows, n + part.num_rows
                if n == size:
                    yield emit()
                    held, n = [], 0
        if n:
            yield emit()

    return run


def blocks(found: DataFrame, dim: int, size: int, by_norm: bool) -> DataFrame:
    """block, hi (greatest length), n, width, rows, ids, data; by_norm: blocks of similar length, the longest vectors first."""
    parts = max(1, -(-found.count() // size))
    lot = F.xxhash64("row")
    if by_norm:
        dealt = found.repartitionByRange(parts, F.desc("norm2"), lot).sortWithinPartitions(F.desc("norm2"), "vec_id")
    else:
        dealt = found.repartition(parts, lot)
    return dealt.select("row", "vec_id", "v", "norm2").mapInArrow(_packer(dim, size), _BLOCK_SQL)


def _lengths(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """For each row the length of what lies from each edge on."""
    parts = np.stack([(x[:, a:b] ** 2).sum(axis=1) for a, b in zip(edges, edges[1:], strict=False)] + [np.zeros(len(x))], axis=1)
    return np.sqrt(np.cumsum(parts[:, ::-1], axis=1)[:, ::-1])


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, most: int):
    """Inner products of pairs: int64 where that holds them, else Python's integers."""
    if most < 1 << 62:
        return np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 50_000]], x[j[a : a + 50_000]]) for a in range(0, len(i), 50_000)] or [np.zeros(0, np.int64)])
    return [sum(int(a) * int(b) for a, b in zip(q[s], x[t], strict=True)) for s, t in zip(i.tolist(), j.tolist(), strict=True)]


def best(q_rows, q, x_rows, x_ids, x, bound, rotation, k):
    """The k best candidates of each query with a score of at least its bound: (query's place, candidate's id, score) lists. x: the longest first."""
    dim = x.shape[1]
    qf, xf = (q.astype(float), x.astype(float)) if rotation is None else (q @ rotation, x @ rotation)
    edges = [*range(0, dim, STEP), dim] if dim else [0]
    q_rest, x_rest = _lengths(qf, edges), _lengths(xf, edges)
    margin = 1e-6 * (1 + q_rest[:, 0] * x_rest[:, 0].max(initial=0.0))
    own = {r: i for i, r in enumerate(x_rows.tolist())}
    most = dim * int(max(q.max(initial=0), -int(q.min(initial=0)))) * int(max(x.max(initial=0), -int(x.min(initial=0))))
    out = []
    for low in range(0, len(q), CHUNK):
        part = slice(low, low + CHUNK)
        limit = (bound[part] - margin[part])[:, None]
        mask = q_rest[part, :1] * x_rest[None, :, 0] >= limit
        for i, r in enumerate(q_rows[part].tolist()):
            if r in own:
                mask[i, own[r]] = False
        partial, pairs = np.zeros(mask.shape), None
        for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            partial += qf[part, a:b] @ xf[:, a:b].T
            mask &= partial + q_rest[part, s + 1, None] * x_rest[None, :, s + 1] >= limit
            if int(mask.sum()) * 16 < mask.size:
                pairs = np.nonzero(mask)
                sums = partial[pairs]
                for t in range(s + 1, len(edges) - 1):
                    i, j = pairs
                    sums = sums + np.einsum("ij,ij->i", qf[low + i, edges[t] : edges[t + 1]], xf[j, edges[t] : edges[t + 1]])
                    stay = sums + q_rest[low + i, t + 1] * x_rest[j, t + 1] >= limit[i, 0]
                    pairs, sums = (i[stay], j[stay]), sums[stay]
                break
        if pairs is None:
            partial[~mask] = -np.inf
            if partial.shape[1] > k:  # candidates below the k-th float score by more than the margin can't be among the best
                mask &= partial >= (np.partition(partial, -k, axis=1)[:, -k] - 2 * margin[part])[:, None]
            pairs = np.nonzero(mask)
        i, j = pairs
        if not len(i):
            continue
        score = _exact(q[part], x, i, j, most)
        ids = x_ids[j]
        if isinstance(score, list):
            order = np.array(sorted(range(len(i)), key=lambda n: (i[n], -score[n], ids[n])))
        else:
            order = np.lexsort((ids, -score, i))
        first = np.searchsorted(i[order], i[order])
        order = order[np.arange(len(order)) - first < k]
        values = [max(-_MOST, min(_MOST, score[n])) for n in order.tolist()] if isinstance(score, list) else score[order]
        out.append((q_rows[low + i[order]], ids[order], values))
    return out


def _meet(rotation: np.ndarray | None, k: int):
    def run(batches):
        from decimal import Context, Decimal

        wide = Context(prec=40)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                sides = []
                for side in "qx":
                    data = np.frombuffer(row[f"{side}_data"], _WIDTHS[row[f"{side}_width"]]).reshape(row[f"{side}_n"], -1).astype(np.int64)
                    sides.append((np.frombuffer(row[f"{side}_rows"], np.int64), np.frombuffer(row[f"{side}_ids"], np.int64), data))
                (q_rows, _, q), (x_rows, x_ids, x) = sides
                limits = {b["qrow"]: b["low"] for b in row["bound"] or ()}
                low = np.array([limits.get(r, -np.inf) for r in q_rows.tolist()])
                for found, ids, score in best(q_rows, q, x_rows, x_ids, x, low, rotation, k):
                    values = pa.array([wide.create_decimal(Decimal(s)) for s in score], _SCORE) if isinstance(score, list) else pa.array(score, pa.int64()).cast(_SCORE)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(ids), values], names=["qrow", "vec_id", "score"])

    return run


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    """qrow, rank, vec_id, score: the k best of each query. Salted rounds keep any one task's share small."""
    order = [F.desc("score"), "vec_id"]
    salted = scores.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    part = salted.withColumn("r", F.row_number().over(Window.partitionBy("qrow", "salt").orderBy(*order))).where(F.col("r") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("qrow").orderBy(*order))).where(F.col("rank") <= k).select("qrow", "rank", "vec_id", "score")


def _level(length) -> F.Column:
    return F.when(length > 0, F.floor(F.log2(length) * LEVELS)).otherwise(-(1 << 20)).cast("int")


def rounds_of(heads: DataFrame, opening: tuple[int, ...]) -> DataFrame:
    """heads (block, hi) with round: the longest blocks in rounds of opening, the rest in one more."""
    longest = heads.orderBy(F.desc("hi"), "block").select("block").limit(sum(opening)).collect()  # sum(opening) numbers
    sizes = [r for r, n in enumerate(opening) for _ in range(n)]
    named = heads.sparkSession.createDataFrame([(x.block, r) for x, r in zip(longest, sizes, strict=False)], "block long, round int")
    return heads.join(F.broadcast(named), "block", "left").withColumn("round", F.coalesce("round", F.lit(len(opening))))


def top_k(rows: DataFrame, k: int = TOP, every: int = EVERY, block: int = BLOCK, queries: int = QUERIES, opening: tuple[int, ...] = OPENING) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = prepare(rows.sparkSession)
    found = stored(vectors(rows), "vectors")
    dim = found.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    asked = found.where(F.col("vec_id") % every == 0)
    if not asked.take(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rotation = None
    if 0 < dim <= ROTATED:
        sample = [list(r.v) + [0] * (dim - len(r.v)) for r in found.orderBy(F.xxhash64("row")).select("v").limit(SAMPLE).collect()]
        rotation = np.linalg.svd(np.array(sample, float), full_matrices=True)[2].T
    room = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    xs = stored(blocks(found, dim, min(block, room), True), "vector-blocks")
    qs = stored(blocks(asked, dim, min(queries, room), False), "query-blocks")
    heads = stored(rounds_of(xs.select("block", "hi"), opening).select(F.col("block").alias("x_block"), "hi", "round", _level(F.col("hi")).alias("level")), "heads")
    spans = {r["round"]: (r["low"], r["high"], r["n"]) for r in heads.groupBy("round").agg(F.min("level").alias("low"), F.max("level").alias("high"), F.count("*").alias("n")).collect()}
    payload = [[F.col("block").alias(f"{s}_block"), *(F.col(c).alias(f"{s}_{c}") for c in ("n", "width", "rows", "ids", "data"))] for s in "qx"]
    names = asked.select(F.col("row").alias("qrow"), F.col("vec_id").alias("query_id"), F.sqrt("norm2").alias("length"))
    members = qs.select(F.col("block").alias("q_block"), "rows").mapInArrow(_members, "q_block long, qrow long")
    members = stored(members.join(names, "qrow"), "query-members")

    known = None
    none = F.expr("cast(null as array<struct<qrow:bigint,low:double>>)")
    for r in sorted(spans):
        low_level, high_level, n = spans[r]
        if known is None:
            bounds = members.select("q_block").distinct().select("q_block", none.alias("bound"), F.lit(float("-inf")).alias("need"))
        else:
            lows = known.groupBy("qrow").agg(F.min("score").alias("low"), F.count("*").alias("c")).where(F.col("c") >= k).select("qrow", F.col("low").cast("double").alias("low"))
            each = members.join(lows, "qrow", "left").withColumn("low", F.coalesce("low", F.lit(float("-inf"))))
            need = F.when(F.col("low") <= 0, float("-inf")).otherwise(F.col("low") / F.col("length") * (1 - 1e-9))
            bounds = each.groupBy("q_block").agg(F.collect_list(F.struct("qrow", "low")).alias("bound"), F.min(need).alias("need"))  # QUERIES at most
        first_level = F.greatest(F.lit(low_level), F.when(F.col("need") > 0, _level(F.col("need"))).otherwise(F.lit(low_level)))
        bounds = stored(bounds, "bounds")
        open_ = bounds.select("q_block", "need", first_level.alias("from")).where(F.col("from") <= high_level).select("q_block", "need", F.explode(F.sequence("from", F.lit(high_level))).alias("level"))
        units = stored(open_.join(heads.where(F.col("round") == r).select("x_block", "hi", "level"), "level").where("hi >= need").select("q_block", "x_block"), "units")
        count = units.count()
        if count:
            parts = min(count, max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 256))
            work = units.repartition(parts, "q_block", "x_block").join(qs.select(*payload[0]), "q_block").join(bounds.select("q_block", "bound"), "q_block").join(xs.select(*payload[1]), "x_block")
            scores = work.mapInArrow(_meet(rotation, k), _FOUND_SQL)
            if known is not None:
                scores = scores.unionByName(known)
            last, known = known, stored(_ranked(scores, k).drop("rank"), "best")
            discard(units, bounds, *([last] if last is not None else []))
    discard(found, xs, qs, heads)
    top = _ranked(known, k).join(members.select("qrow", "query_id"), "qrow")
    limit = F.lit(2**63 - 1).cast("decimal(38,0)")
    return top.select("query_id", "rank", "vec_id", F.least(F.greatest("score", -limit), limit).cast("long").alias("score"))


def _members(batches):
    for batch in batches:
        for number, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(own)], names=["q_block", "qrow"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings),
s AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e x ON q.r <> x.r WHERE q.vec_id % {EVERY} = 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= {TOP}
"""
