"""Structured Streaming: the batch operators over a packet stream, with epochs as event time.

Epoch e closes at second e + 1, so that epoch 0 lies above the initial watermark. A watermark of zero closes an epoch when a later
one appears; give a delay where input arrives out of order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.plans.packets import KEYS, from_events


def event_stream(spark: SparkSession, path: str, schema, length: int) -> DataFrame:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return from_events(stream, length)


def paced(spark: SparkSession, trace: DataFrame, rate: int, partitions: int = 8) -> DataFrame:
    """pass and the columns of trace (seq from 0 without gaps), rate packets a micro-batch, over and over: a sender held to a rate.

    With a processing-time trigger of a second, rate is packets a second (scalars.send_period for a link's). seq runs on from pass to pass."""
    n = trace.count()
    if n == 0:
        raise ValueError("an empty trace can't be sent")
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rate).option("numPartitions", partitions).load()
    sent = ticks.select(F.col("value").alias("_sent"), F.expr(f"value % {n}").alias("seq"))
    return sent.join(trace, "seq").withColumn("pass", F.expr(f"_sent div {n}")).withColumn("seq", F.col("_sent")).drop("_sent")


def timed(df: DataFrame, delay: str = "0 seconds") -> DataFrame:
    return df.withColumn("closes", F.timestamp_seconds(F.col("epoch") + 1)).withWatermark("closes", delay)


def stream_counts(df: DataFrame, mode: str) -> DataFrame:
    return df.groupBy("closes", "epoch", *KEYS[mode]).agg(F.count("*").alias("cnt")).drop("closes")


def run_once(df: DataFrame, out: str, check: str, then: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process what there is and stop; rows of closed epochs are appended to out as Parquet."""
    q = (then(df) if then else df).writeStream.format("parquet").outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).start(out)
    q.awaitTermination()


def stream_crossing(df: DataFrame, key: str, threshold: int) -> DataFrame:
    """epoch, seq, key: each flow at the packet that brings its epoch's count to the threshold, as soon as that packet is read.

    The state of a flow is its epoch and count, kept from batch to batch; a new epoch starts at zero."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(own, batches, state: GroupState):
        import pandas as pd

        epoch, count = state.get if state.exists else (-1, 0)
        found = []
        pdf = pd.concat(list(batches)).sort_values("seq")  # a flow's packets of one batch
        for e, s in zip(pdf["epoch"].tolist(), pdf["seq"].tolist(), strict=True):
            epoch, count = (epoch, count + 1) if e == epoch else (e, 1)
            if count == threshold:
                found.append((e, s, own[0]))
        state.update((epoch, count))
        yield pd.DataFrame(found, columns=["epoch", "seq", key])

    rows = df.select("epoch", "seq", F.col(key).cast("long").alias(key)).groupBy(key)
    return rows.applyInPandasWithState(step, f"epoch long, seq long, {key} long", "epoch long, count long", "append", GroupStateTimeout.NoTimeout)


def running_totals(df: DataFrame, mode: str, name: str):
    """Totals over the whole stream, in a memory table (for small results)."""
    return df.groupBy(*KEYS[mode]).agg(F.count("*").alias("cnt")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()


def fan_out(df: DataFrame, modules: dict[str, Callable[[DataFrame], DataFrame]], sink: Callable[[str, DataFrame, int], None], check: str):
    """Several modules on one stream: each batch is read once and kept while every module looks at it, in their order."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, build in modules.items():
            sink(name, build(batch), number)
        batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", check).trigger(availableNow=True).start()
