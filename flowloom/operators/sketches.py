"""Fixed-memory summaries as mergeable aggregates over (epoch, key, w); sparse long tables, missing cells are zero.

All are sums, bitwise ORs or XORs, so partial aggregation merges them in any order, and a sketch of packets equals the sketch of
pre-aggregated flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.hashing import ctz32, mm3, mm3_py
from flowloom.functions.scalars import median4
from flowloom.plans.packets import KEYS, key_words

# Seeds of the row hashes.
SH = [17093, 30169, 52757, 83233, 104147, 137143, 154823, 174907, 195047, 218447, 233323, 253531, 277829, 296221, 318569, 338573]
ROWS = [SH[0], SH[1] + SH[0], SH[2] + SH[1], SH[3] + SH[2]]
SIGNS = [SH[4], SH[4] + SH[5], SH[4] + SH[6], SH[4] + SH[7]]
CELLS = SIGNS
# Seeds of the digits of the reversible rows.
DIGITS = [ROWS, [104147, 241290, 291966, 329730], [195047, 413494, 451770, 486854], [277829, 574050, 614790, 657142]]


def rows_of(df: DataFrame, *values: Column, name: str = "row") -> DataFrame:
    """One row for each of the values (0, 1, ...), all computed in one projection, where what they share is computed once."""
    return df.withColumn("_values", F.array(*values)).select(*df.columns, F.posexplode("_values").alias(name, "h"))


def low_bits(h: Column, size: int) -> Column:
    return h.bitwiseAND(F.lit(size - 1))


def count_min(df: DataFrame, mode: str, size: int) -> DataFrame:
    """epoch, row, bucket, cnt."""
    hashed = rows_of(df, *(low_bits(mm3(key_words(mode), s), size) for s in ROWS))
    return hashed.groupBy("epoch", "row", F.col("h").alias("bucket")).agg(F.sum("w").alias("cnt"))


def count_min_point(flow_df: DataFrame, counters: DataFrame, mode: str, size: int) -> DataFrame:
    """epoch, key, w, est: the smallest of a flow's counters."""
    hashed = rows_of(flow_df, *(low_bits(mm3(key_words(mode), s), size) for s in ROWS)).withColumnRenamed("h", "bucket")
    return hashed.join(counters, ["epoch", "row", "bucket"]).groupBy("epoch", *KEYS[mode], "w").agg(F.min("cnt").alias("est"))


def fm(df: DataFrame, mode: str) -> DataFrame:
    """epoch, row, bitmap."""
    hashed = rows_of(df, *(ctz32(mm3(key_words(mode), s)) for s in ROWS))
    return hashed.groupBy("epoch", "row").agg(F.bit_or(F.expr("shiftleft(1L, h)")).alias("bitmap"))


def fm_estimate(bitmaps: DataFrame) -> DataFrame:
    """epoch, est: 2^(mean lowest unset bit) / 0.77351 (published estimator)."""
    lowest = ctz32(F.bitwise_not("bitmap").bitwiseAND(F.lit(0xFFFFFFFF)))
    return bitmaps.groupBy("epoch").agg(F.round(F.pow(F.lit(2.0), F.avg(lowest)) / 0.77351, 6).alias("est"))


def linear_counting(df: DataFrame, mode: str, size: int) -> DataFrame:
    """epoch, row, ones: set bits of 32 * size."""
    hashed = rows_of(df, *(low_bits(mm3(key_words(mode), s), 32 * size) for s in ROWS))
    return hashed.groupBy("epoch", "row").agg(F.countDistinct("h").alias("ones"))


def linear_estimate(ones: DataFrame, size: int) -> DataFrame:
    """epoch, row, est: -m ln(1 - ones/m) (published estimator)."""
    m = 32 * size
    return ones.select("epoch", "row", F.round(-F.lit(float(m)) * F.log(1 - F.col("ones") / m), 6).alias("est"))


def mrac(df: DataFrame, mode: str, size: int) -> DataFrame:
    """epoch, arr, bucket, cnt: four counter arrays of halving sampling rates."""
    hv, m = low_bits(mm3(key_words(mode), SH[0]), 8 * size), 8 * size
    arr = F.when(F.col("hv") < m // 2, 1).when(F.col("hv") < m * 3 // 4, 2).when(F.col("hv") < m * 7 // 8, 3).otherwise(4)
    return df.withColumn("hv", hv).groupBy("epoch", arr.alias("arr"), low_bits(F.col("hv"), size).alias("bucket")).agg(F.sum("w").alias("cnt"))


def mrac_histogram(counters: DataFrame) -> DataFrame:
    """epoch, arr, cnt, n: how many counters have a value."""
    return counters.groupBy("epoch", "arr", "cnt").agg(F.count("*").alias("n"))


def flow_radar(flow_df: DataFrame, mode: str, size: int) -> DataFrame:
    """epoch, cell, x_<key columns>, flowc, packetc: XOR of keys, flows and packets of each cell. The new-flow test is exact here
    (flows are distinct rows), as a Bloom filter's is without false positives."""
    hashed = rows_of(flow_df, *(low_bits(mm3(key_words(mode), s), size) for s in CELLS))
    xors = [F.bit_xor(F.col(c).cast("long")).alias(f"x_{c}") for c in KEYS[mode]]
    return hashed.groupBy("epoch", F.col("h").alias("cell")).agg(*xors, F.count("*").alias("flowc"), F.sum("w").alias("packetc"))


def flow_radar_bloom(df: DataFrame, mode: str, size: int) -> DataFrame:
    """epoch, cell, x_<key columns>, flowc, packetc, as the flow filter of 32 * size bits decides which flows are new: one all of whose
    bits earlier flows have set stays out of the XORs and of flowc; its packets count all the same. df: epoch, key, seq, w, as packets or pre-aggregated flows.

    A bit is set at the first packet of the flows that have it; so a flow is new where it sets one of its bits first."""
    first = df.groupBy("epoch", *KEYS[mode]).agg(F.min("seq").alias("first"), F.sum("w").alias("w"))
    bits = rows_of(first, *(low_bits(mm3(key_words(mode), s), 32 * size) for s in ROWS))
    sets = F.col("first") == F.min("first").over(Window.partitionBy("epoch", "h"))
    fresh = bits.withColumn("sets", sets).groupBy("epoch", *KEYS[mode], "w").agg(F.max("sets").alias("fresh"))
    hashed = rows_of(fresh, *(low_bits(mm3(key_words(mode), s), size) for s in CELLS))
    xors = [F.bit_xor(F.when(F.col("fresh"), F.col(c).cast("long")).otherwise(0)).alias(f"x_{c}") for c in KEYS[mode]]
    return hashed.groupBy("epoch", F.col("h").alias("cell")).agg(*xors, F.count_if("fresh").alias("flowc"), F.sum("w").alias("packetc"))


def bloom_bits(flow_df: DataFrame, mode: str, size: int) -> DataFrame:
    """epoch, ones: set bits of the flow filter of 32 * size bits."""
    hashed = rows_of(flow_df, *(low_bits(mm3(key_words(mode), s), 32 * size) for s in ROWS))
    return hashed.groupBy("epoch").agg(F.countDistinct("h").alias("ones"))


def _sign(mode: str, seed: int) -> Column:
    return F.lit(2) * mm3(key_words(mode), seed).bitwiseAND(F.lit(1)) - 1


def signed_rows(df: DataFrame, mode: str, size: int | Column) -> DataFrame:
    """Adds row, bucket, sign."""
    mask = F.lit(size - 1) if isinstance(size, int) else size - 1
    cells = [F.struct(mm3(key_words(mode), r).bitwiseAND(mask).alias("bucket"), _sign(mode, s).cast("long").alias("sign")) for r, s in zip(ROWS, SIGNS, strict=True)]
    return df.select("*", F.posexplode(F.array(*cells)).alias("row", "c")).select("*", "c.bucket", "c.sign").drop("c")


def count_sketch(df: DataFrame, mode: str, size: int) -> DataFrame:
    """epoch, row, bucket, cnt: signed sums."""
    return signed_rows(df, mode, size).groupBy("epoch", "row", "bucket").agg(F.sum(F.col("sign") * F.col("w")).alias("cnt"))


def count_sketch_top(flow_df: DataFrame, counters: DataFrame, mode: str, size: int, k: int) -> DataFrame:
    """epoch, key, est, rank: the k flows of greatest estimate (the median of four signed counters)."""
    cells = signed_rows(flow_df, mode, size).join(counters, ["epoch", "row", "bucket"])
    est = cells.groupBy("epoch", *KEYS[mode]).agg(median4(F.collect_list(F.col("sign") * F.col("cnt"))).alias("est"))  # four values each
    w = Window.partitionBy("epoch").orderBy(F.desc("est"), *KEYS[mode])
    return est.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def univmon(df: DataFrame, mode: str, size: int) -> DataFrame:
    """epoch, level, row, bucket, cnt: level 1 has all; the first hash with its low bit set gives a further level, of half the
    size each."""
    words = key_words(mode)
    extra = F.lit(0)
    for i in (2, 1, 0):
        extra = F.when(mm3(words, ROWS[i]).bitwiseAND(F.lit(1)) == 1, i + 2).otherwise(extra)
    leveled = df.withColumn("x", extra).select("*", F.explode(F.when(F.col("x") > 0, F.array(F.lit(1), "x")).otherwise(F.array(F.lit(1)))).alias("level"))
    sized = leveled.withColumn("size", F.expr(f"{size} div shiftleft(1, level - 1)"))
    return signed_rows(sized, mode, F.col("size")).groupBy("epoch", "level", "row", "bucket").agg(F.sum(F.col("sign") * F.col("w")).alias("cnt"))


def _digits(hashes: list[Column], bits: int) -> Column:
    """Bucket put together from the low bits of each hash, the first highest."""
    out = F.lit(0).cast("long")
    for h in hashes:
        out = F.shiftleft(out, bits).bitwiseOR(low_bits(h, 1 << bits))
    return out


def _byte_buckets(seeds: list[int]) -> list[int]:
    """The bucket of each byte value: a table of 256 is smaller than its expression."""
    return [sum((mm3_py(bytes([b]), s) & 15) << 4 * (len(seeds) - 1 - i) for i, s in enumerate(seeds)) for b in range(256)]


def rev_sketch(df: DataFrame, mode: str, one_byte: bool = False) -> DataFrame:
    """epoch, row, bucket, cnt: buckets of four 4-bit digits. one_byte: hash the address's first byte alone, as the shipped
    configurations come out."""
    if one_byte:
        byte = F.shiftright(key_words(mode)[0], 24).bitwiseAND(F.lit(255))
        values = [F.element_at(F.lit(_byte_buckets(seeds)), (byte + 1).cast("int")) for seeds in DIGITS]
    else:
        values = [_digits([mm3(key_words(mode), s) for s in seeds], 4) for seeds in DIGITS]
    return rows_of(df, *values).groupBy("epoch", "row", F.col("h").alias("bucket")).agg(F.sum("w").alias("cnt"))


def two_level(df: DataFrame, size: int) -> DataFrame:
    """epoch, level, row, cell, bits: distinct-destination bits (of 96) in each cell of both levels, for pair flows."""
    src, bit = [F.col("src_ip")], mm3([F.col("dst_ip")], SH[4]) % 96
    first = [_digits([mm3(src, s) for s in seeds], 3) for seeds in DIGITS]
    second = [low_bits(mm3(src, s), size) for s in ROWS]
    cells = [F.struct(F.lit(lv).alias("level"), F.lit(r).alias("row"), c.alias("cell")) for lv, cs in ((1, first), (2, second)) for r, c in enumerate(cs)]
    each = df.select("epoch", bit.alias("bit"), F.explode(F.array(*cells)).alias("c")).select("epoch", "bit", "c.*")
    return each.groupBy("epoch", "level", "row", "cell").agg(F.countDistinct("bit").alias("bits"))
