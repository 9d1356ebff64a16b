"""Trace text files: scan, parse, number; Zipf traces; replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.hashing import mm3
from flowloom.functions.scalars import radix_number

TRACE_CAP = 14 * (1 << 21) - 1
SKEWS = [i * 3 / 10 for i in range(11)]


def parse_lines(lines: DataFrame) -> DataFrame:
    """part, at, src_ip, dst_ip, src_port, dst_port, proto of valid lines (TCP or UDP); lines: part, at, value.

    Fields are separated by runs of space, comma and tab; numbers are decimal, hexadecimal or octal. Lines with fewer fields go."""
    f = F.split(F.trim(F.regexp_replace("value", "[ ,\t]+", " ")), " ")
    raw = lines.select("part", "at", f.alias("f")).where(F.size("f") >= 5)
    n = [radix_number(F.get("f", F.lit(i))) for i in range(5)]
    rows = raw.select("part", "at", n[0].alias("src_ip"), n[1].alias("dst_ip"), n[2].cast("int").alias("src_port"), n[3].cast("int").alias("dst_port"), n[4].cast("int").alias("proto"))
    return rows.dropna().where(F.col("proto").isin(6, 17))


def numbered(rows: DataFrame, cap: int | None = TRACE_CAP) -> DataFrame:
    """Adds seq = 0, 1, ... in order of (part, at) and keeps cap rows (all without a cap); part bounds a task's rows. The counts of parts
    (one small row each) are added up once; rows are numbered within their part, so no task sees them all."""
    from pyspark.sql import Window

    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    seq = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    out = rows.join(base, "part").withColumn("seq", seq).drop("part", "at", "base")
    return out if cap is None else out.where(F.col("seq") < cap)


def read_trace(spark: SparkSession, path: str, cap: int | None = TRACE_CAP) -> DataFrame:
    """seq, src_ip, dst_ip, src_port, dst_port, proto of a trace file or folder, in order of file names; each file's first line is dropped."""
    place = F.concat_ws("|", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), place.alias("part"), "value", (F.col("_metadata.file_block_start") == 0).alias("begins"))
    first = lines.where("begins").groupBy("part").agg(F.min("at").alias("at"))
    return numbered(parse_lines(lines.join(first, ["part", "at"], "left_anti")), cap)


def write_trace(packets: DataFrame, path: str, header: bool = False) -> None:
    """Trace files, one a partition, in the order of the rows; with a header each begins with a line that readers drop."""
    packets.select("src_ip", "dst_ip", "src_port", "dst_port", "proto").write.option("sep", " ").option("header", header).csv(path)


def profile(packets: DataFrame, key: list[str]) -> DataFrame:
    """packets, flows, most: rows, distinct flows and the greatest frequency."""
    return packets.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("packets"), F.count("*").alias("flows"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def _ranked(packets: DataFrame, key: str) -> DataFrame:
    """rank (from 1, in order of the key), key; keys are numbered in ranges of 2^16."""
    keys = packets.select(key).distinct().select(F.expr(f"`{key}` div 65536").alias("part"), F.col(key).alias("at"), key)
    return numbered(keys, None).withColumn("rank", F.col("seq") + 1).drop("seq")


def _rank(u, skew, n: int):
    """n + 1 - floor((n + 1)^(u^skew)) within 1 to n; skew 0 is uniform."""
    drawn = F.least(F.greatest(n + 1 - F.floor(F.pow(F.lit(float(n + 1)), F.pow(u, skew))), F.lit(1)), F.lit(n))
    return F.when(skew == 0, F.floor(u * n) + 1).otherwise(drawn).cast("long")


def _drawn(seq, seed: int):
    return (mm3([seq], seed) + 0.5) / float(1 << 32)


def zipf(packets: DataFrame, skew: float, key: str = "src_ip", seed: int = 17093) -> DataFrame:
    """seq, key: as many rows over the same flows, ranks n + 1 - floor((n + 1)^(u^skew)); skew 0 is uniform. u comes from a hash
    of seq, so that a trace can be made again and its rows come in no order of the flows. Ranks run over the flows in order of the key."""
    n = packets.agg(F.countDistinct(key)).first()[0]
    return packets.select("seq", _rank(_drawn(F.col("seq"), seed), F.lit(skew), n).alias("rank")).join(_ranked(packets, key), "rank").select("seq", key)


def zipf_counts(packets: DataFrame, skews: list[float], key: str = "src_ip", seed: int = 17093) -> DataFrame:
    """skew, key, packets: how often each flow comes in the Zipf trace of each skew. Ranks are counted before they meet their flows."""
    n = packets.agg(F.countDistinct(key)).first()[0]
    u = packets.select(_drawn(F.col("seq"), seed).alias("u"), F.explode(F.array(*map(F.lit, skews))).alias("skew"))
    counts = u.groupBy("skew", _rank(F.col("u"), F.col("skew"), n).alias("rank")).agg(F.count("*").alias("packets"))
    return counts.join(_ranked(packets, key), "rank").select("skew", key, "packets")


def shuffled(packets: DataFrame, seed: int = 17093) -> DataFrame:
    """The rows in a random order that can be made again: seq is the place in the order of a hash of the old one (ties: the old one)."""
    h = mm3([F.col("seq")], seed)
    names = [c for c in packets.columns if c != "seq"]
    return numbered(packets.select(F.shiftright(h, 20).alias("part"), F.struct(h.alias("h"), "seq").alias("at"), *names), None)


def replay(packets: DataFrame, passes: int) -> DataFrame:
    """The trace so many times over: pass, and seq running on."""
    n = packets.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    return packets.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")).withColumn("seq", F.col("pass") * n + F.col("seq"))


def queues(packets: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Adds queue, 0 to n - 1, by a hash of both addresses: packets of one pair meet in one queue."""
    return packets.withColumn("queue", mm3([F.col("src_ip"), F.col("dst_ip")], seed) % n)


def dealt(packets: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Packets by queue, one queue a partition. A hot pair fills its queue, as on a network card; sums and sketches need no queues."""
    return queues(packets, n, seed).repartitionById(n, F.col("queue").cast("int"))


def bursts(packets: DataFrame, size: int = 32) -> DataFrame:
    """burst, first, packets: the sending schedule."""
    return packets.groupBy(F.expr(f"seq div {size}").alias("burst")).agg(F.min("seq").alias("first"), F.count("*").alias("packets"))
