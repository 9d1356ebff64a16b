"""Heavy hitters, super spreaders and heavy changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.hashing import mm3
from flowloom.functions.scalars import fold_destination
from flowloom.operators.sketches import ROWS, SH, low_bits
from flowloom.plans.packets import KEYS, flows, key_words

# Seeds of the detectors' own tables.
CM3 = [83233, 135990, 69850]
ARRAY_SEED, STORE_SEED = 83233, 1


def heavy_hitters(df: DataFrame, mode: str, threshold: int, strict: bool = False, per_packet: int = 1) -> DataFrame:
    """epoch, key, cnt: exact stores. A counter that fires when it equals the threshold fires once for each key that reaches it.
    per_packet: increments a packet makes (2 for the double-counting store)."""
    c = F.col("w") * per_packet
    return flows(df, mode).where(c > threshold if strict else c >= threshold).withColumnRenamed("w", "cnt")


def crossing(df: DataFrame, bucket: Column, mode: str, threshold: int, by: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """epoch, seq, key: the packet at which a bucket's counter equals the threshold. row_number with an equality is a
    group limit, so each map task forwards no more than threshold rows of a bucket."""
    w = Window.partitionBy(*by, "bucket").orderBy("seq")
    numbered = df.withColumn("bucket", bucket).withColumn("n", F.row_number().over(w))
    return numbered.where(F.col("n") == threshold).select("epoch", "seq", *KEYS[mode])


def count_array(df: DataFrame, mode: str, size: int, threshold: int) -> DataFrame:
    return crossing(df, low_bits(mm3(key_words(mode), ARRAY_SEED), size), mode, threshold)


def lossy_store(df: DataFrame, mode: str, size: int, threshold: int) -> DataFrame:
    """A direct-mapped table: the key is overwritten, the counter stays."""
    return crossing(df, low_bits(mm3(key_words(mode), STORE_SEED), size), mode, threshold)


def count_min_crossing(df: DataFrame, mode: str, size: int, threshold: int) -> DataFrame:
    """epoch, seq, key: packets at which all three running counters reach the threshold and one equals it.

    Only the place where each counter reaches it is needed, from one window over narrow rows: such a packet is the latest of its three places."""
    out = df
    for i, s in enumerate(CM3):
        out = out.withColumn(f"b{i}", low_bits(mm3(key_words(mode), s), size))
    narrow = out.select("epoch", "seq", F.posexplode(F.array("b0", "b1", "b2")).alias("i", "b"))
    n = F.row_number().over(Window.partitionBy("epoch", "i", "b").orderBy("seq"))
    reached = narrow.withColumn("n", n).where(F.col("n") == threshold)  # 3 * size rows an epoch at most
    for i in range(3):
        out = out.join(reached.where(F.col("i") == i).select("epoch", F.col("b").alias(f"b{i}"), F.col("seq").alias(f"t{i}")), ["epoch", f"b{i}"])
    return out.where(F.col("seq") == F.greatest("t0", "t1", "t2")).select("epoch", "seq", *KEYS[mode])


def report_limit(df: DataFrame, size: int) -> DataFrame:
    """The first size rows of each epoch's report, by arrival."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy("epoch").orderBy("seq"))).where(F.col("n") <= size).drop("n")


def last_payload(df: DataFrame, mode: str) -> DataFrame:
    """epoch, key, cnt, last writer's fields: the value that exact stores keep."""
    last = F.max_by(F.struct("src_port", "dst_port", "proto"), "seq")
    return df.groupBy("epoch", *KEYS[mode]).agg(F.count("*").alias("cnt"), last.alias("p")).select("epoch", *KEYS[mode], "cnt", F.col("p.src_port").alias("last_sport"), F.col("p.dst_port").alias("last_dport"), F.col("p.proto").alias("last_proto"))


def super_spreaders(df: DataFrame, threshold: int) -> DataFrame:
    """epoch, src_ip, n_dst: two partial aggregates, first the distinct pairs."""
    return flows(df, "pair").groupBy("epoch", "src_ip").agg(F.count("*").alias("n_dst")).where(F.col("n_dst") >= threshold)


def bloom_spreaders(df: DataFrame) -> DataFrame:
    """epoch, src_ip, bits: set bits of the 1024-bit filter of each source's destinations (three positions of one hash)."""
    h = mm3([F.col("dst_ip")], 1)
    bits = F.array(h.bitwiseAND(F.lit(1023)), F.shiftright(h, 10).bitwiseAND(F.lit(1023)), F.shiftright(h, 20).bitwiseAND(F.lit(1023)))
    return flows(df, "pair").select("epoch", "src_ip", F.explode(bits).alias("bit")).groupBy("epoch", "src_ip").agg(F.countDistinct("bit").alias("bits"))


def folded_spreaders(df: DataFrame, size: int, most: int = 32) -> DataFrame:
    """epoch, bucket, bits: buckets with over most distinct 6-bit destination folds."""
    pairs = flows(df, "pair").select("epoch", low_bits(mm3([F.col("src_ip")], 1), size).alias("bucket"), fold_destination(F.col("dst_ip")).alias("bit"))
    return pairs.groupBy("epoch", "bucket").agg(F.countDistinct("bit").alias("bits")).where(F.col("bits") > most)


def bucket_counts(df: DataFrame, words: list[Column], seed: int, size: int, times: int = 1, by: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """epoch, bucket, cnt: a plain counter array."""
    return df.groupBy(*by, low_bits(mm3(words, seed), size).alias("bucket")).agg((F.count("*") * times).alias("cnt"))


def last_key_table(df: DataFrame, size: int) -> DataFrame:
    """epoch, bucket, cnt, last key: a direct-mapped table of pairs."""
    last = F.max_by(F.struct("src_ip", "dst_ip"), "seq")
    out = df.groupBy("epoch", low_bits(mm3(key_words("pair"), STORE_SEED), size).alias("bucket")).agg(F.count("*").alias("cnt"), last.alias("k"))
    return out.select("epoch", "bucket", "cnt", "k.src_ip", "k.dst_ip")


def changes(counts: DataFrame, key: list[str], threshold: int, back: int = 1) -> DataFrame:
    """epoch, key, delta: exact change against the epoch so many back; a missing count is zero."""
    now = counts.select("epoch", *key, F.col("w").alias("now"))
    last = counts.select((F.col("epoch") + back).alias("epoch"), *key, F.col("w").alias("last"))
    span = counts.agg(F.max("epoch").alias("top"))
    both = now.join(last, ["epoch", *key], "full").select("epoch", *key, (F.coalesce("now", F.lit(0)) - F.coalesce("last", F.lit(0))).alias("delta"))
    return both.join(F.broadcast(span), F.col("epoch") <= F.col("top")).where(F.abs("delta") > threshold).drop("top")  # one row


def bucket_change(df: DataFrame, size: int, threshold: int) -> DataFrame:
    """epoch, pair: keys whose bucket, at the key's own last packet, differs by over the threshold from the bucket's count in the
    epoch before."""
    b = df.withColumn("bucket", low_bits(mm3(key_words("pair"), SH[0]), size))
    running = b.withColumn("n", F.count("*").over(Window.partitionBy("epoch", "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    final = running.groupBy("epoch", "bucket", "src_ip", "dst_ip").agg(F.max_by("n", "seq").alias("n"))
    last = b.groupBy((F.col("epoch") + 1).alias("epoch"), "bucket").agg(F.count("*").alias("last"))
    both = final.join(last, ["epoch", "bucket"], "left")
    return both.where(F.abs(F.col("n") - F.coalesce("last", F.lit(0))) > threshold).select("epoch", "src_ip", "dst_ip")


def count_min3(df: DataFrame, mode: str, size: int) -> DataFrame:
    """epoch, row, bucket, cnt: the three-row table of the heavy-change detector, fed from flows."""
    from flowloom.operators.sketches import rows_of

    hashed = rows_of(flows(df, mode), *(low_bits(mm3(key_words(mode), s), size) for s in ROWS[:3]))
    return hashed.groupBy("epoch", "row", F.col("h").alias("bucket")).agg(F.sum("w").alias("cnt"))


def count_min3_top(df: DataFrame, mode: str, size: int, k: int) -> DataFrame:
    """epoch, key, est, rank: the k keys of greatest estimate."""
    from flowloom.operators.sketches import rows_of

    hashed = rows_of(flows(df, mode), *(low_bits(mm3(key_words(mode), s), size) for s in ROWS[:3])).withColumnRenamed("h", "bucket")
    est = hashed.join(count_min3(df, mode, size), ["epoch", "row", "bucket"]).groupBy("epoch", *KEYS[mode]).agg(F.min("cnt").alias("est"))
    w = Window.partitionBy("epoch").orderBy(F.desc("est"), *KEYS[mode])
    return est.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(df: DataFrame, mode: str, k: int) -> DataFrame:
    """epoch, key, w, rank: exact top k; ties to the smaller key."""
    w = Window.partitionBy("epoch").orderBy(F.desc("w"), *KEYS[mode])
    return flows(df, mode).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
