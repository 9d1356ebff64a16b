"""The packet relation: schema, key modes, epochs, and adapters from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET_SQL = "seq long, src_ip long, dst_ip long, src_port int, dst_port int, proto int, port int"
EPOCH_LEN = 1 << 21
#: Key modes: columns of a flow's key.
KEYS = {"sip": ["src_ip"], "dip": ["dst_ip"], "pair": ["src_ip", "dst_ip"], "four": ["src_ip", "dst_ip", "src_port", "dst_port"], "five": ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]}
EVENT_TYPES = ["view", "signup", "error", "click", "purchase"]
TEST_EPOCH = 2048


def with_epoch(df: DataFrame, length: int = EPOCH_LEN) -> DataFrame:
    """Tumbling count windows: epoch = floor(seq / length)."""
    return df.withColumn("epoch", F.expr(f"seq div {length}"))


def from_events(events: DataFrame, length: int = TEST_EPOCH, valid_only: bool = True) -> DataFrame:
    kind = F.lit(None).cast("int")
    for i, t in enumerate(EVENT_TYPES):
        kind = F.when(F.col("event_type") == t, i).otherwise(kind)
    out = events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("src_ip"), F.get_json_object("props", "$.k").cast("long").alias("dst_ip"), kind.alias("src_port"), F.hour("ts").alias("dst_port"),
        F.when(F.col("event_id") % 10 == 9, 1).when(F.col("event_id") % 2 == 0, 6).otherwise(17).alias("proto"), (F.col("event_id") % 2).cast("int").alias("port"),
    )
    return with_epoch(out.where(F.col("proto").isin(6, 17)) if valid_only else out, length)


def packets(spark: SparkSession, sf_dir: str, length: int = TEST_EPOCH) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), length)


def ports_word(df_prefix: str = "") -> Column:
    """Both ports as one 32-bit word, as they lie in a packet (source first, network order, read little-endian)."""
    swap = lambda c: F.shiftleft(c.bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright(c, 8))
    return swap(F.col("src_port").cast("long")).bitwiseOR(F.shiftleft(swap(F.col("dst_port").cast("long")), 16))


def key_words(mode: str) -> list[Column]:
    """The 32-bit words that a mode's key is hashed as."""
    words = {"src_ip": [F.col("src_ip")], "dst_ip": [F.col("dst_ip")], "src_port": [ports_word()], "dst_port": [], "proto": [F.col("proto").cast("long")]}
    return [w for c in KEYS[mode] for w in words[c]]


def flows(df: DataFrame, mode: str) -> DataFrame:
    """(epoch, key, w): the pre-aggregated relation that sketches are fed from. Map-side partial sums do the combining."""
    return df.groupBy("epoch", *KEYS[mode]).agg(F.count("*").alias("w"))


def weighted(df: DataFrame) -> DataFrame:
    """Packets as flows of weight 1: the plain (not pre-aggregated) feed."""
    return df.withColumn("w", F.lit(1).cast("long"))
