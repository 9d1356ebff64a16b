"""Accuracy, latency histograms, throughput and memory: the evaluation layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = [50.0, 90.0, 95.0, 99.0, 99.9, 99.99, 99.999, 99.9999]
HIST_BUCKETS, BUCKET_CYCLES = 2048, 2


def _cut(x: Column) -> Column:
    """Three decimals, cut."""
    return F.floor(x * 1000 + 1e-9) / 1000


def accuracy(truth: DataFrame, reported: DataFrame, key: list[str]) -> DataFrame:
    """epoch, tp, fp, fn, precision, recall, f1 (per cent, standard names)."""
    t, r = truth.select("epoch", *key).distinct().withColumn("t", F.lit(1)), reported.select("epoch", *key).distinct().withColumn("r", F.lit(1))
    both = t.join(r, ["epoch", *key], "full")
    tp, fp, fn = (F.count(F.when(c, 1)) for c in (F.col("t").isNotNull() & F.col("r").isNotNull(), F.col("t").isNull(), F.col("r").isNull()))
    out = both.groupBy("epoch").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    ratio = lambda a, b: F.when(b > 0, _cut(100.0 * a / b)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("epoch", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def relative_error(estimates: DataFrame) -> DataFrame:
    """epoch, aae, are: mean absolute and relative error of est against w."""
    diff = F.abs(F.col("est") - F.col("w"))
    return estimates.groupBy("epoch").agg(F.round(F.avg(diff), 6).alias("aae"), F.round(F.avg(diff / F.col("w")), 6).alias("are"))


def histogram(batches: DataFrame) -> DataFrame:
    """bucket, packets, from (cycles, len) of processed batches; weighted by packets."""
    bucket = F.least(F.floor(F.col("cycles") / (BUCKET_CYCLES * F.col("len"))), F.lit(HIST_BUCKETS - 1))
    return batches.groupBy(bucket.alias("bucket")).agg(F.sum("len").alias("packets"))


def percentiles(hist: DataFrame) -> DataFrame:
    """p, cycles: twice the first bucket whose running total is over p per cent; 4096 if there is none. At most 2048 rows."""
    run = hist.withColumn("cum", F.sum("packets").over(Window.orderBy("bucket"))).withColumn("total", F.sum("packets").over(Window.partitionBy()))
    p = F.explode(F.array(*map(F.lit, PERCENTILES))).alias("p")
    first = F.min(F.when(F.col("cum") > F.col("total") * F.col("p") / 100, F.col("bucket") * BUCKET_CYCLES))
    return run.select("*", p).groupBy("p").agg(F.coalesce(first, F.lit(HIST_BUCKETS * BUCKET_CYCLES)).cast("long").alias("cycles"))


def mean_latency(hist: DataFrame) -> DataFrame:
    """mean: sum(bucket * 2 * packets) / packets + 1, as BIGINT arithmetic allows."""
    return hist.agg((F.sum(F.col("packets") * F.col("bucket") * BUCKET_CYCLES) / F.sum("packets") + BUCKET_CYCLES // 2).alias("mean"))


def rates(snapshots: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """Change of a running counter between snapshots, per second."""
    w = Window.partitionBy(*by).orderBy(order)
    dt = F.unix_seconds(F.col(order).cast("timestamp")) - F.unix_seconds(F.lag(order).over(w).cast("timestamp"))
    return snapshots.withColumn("delta", F.col(value) - F.lag(value).over(w)).withColumn("seconds", dt)


def steady_mean(samples: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, mean: samples 3 to 10 counted from the end, of 4 digits at least."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return samples.where(F.col(value) >= 1000).withColumn("n", F.row_number().over(w)).where(F.col("n").between(3, 10)).groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"))


def last_panel(panels: DataFrame) -> DataFrame:
    """name, value: the last usable value of each panel line (4096 means none)."""
    return panels.where((F.col("value") != 4096) & ~F.isnan("value")).groupBy("name").agg(F.max_by("value", "line_no").alias("value"))


#: A store's title and the name of its experiment, as published.
TITLES = {
    "Heap": "01-hh-hm-pqueue", "CuckooBucket": "01-hh-hm-cuckoo-bucket", "CuckooPtr": "01-hh-hm-cuckoo-ptr", "Cuckoo": "01-hh-hm-cuckoo-local", "LinearPtr": "01-hh-hm-linear-ptr",
    "Linear": "01-hh-hm-linear", "RTEHash": "01-hh-hm-cuckoo", "Simple": "01-hh-hm-simple", "CountMin": "01-hh-hm-countmin",
}


def name_of(title: Column) -> Column:
    """A title's experiment; other texts stay."""
    out = title
    for t, n in TITLES.items():
        out = F.when(title == t, n).otherwise(out)
    return out


def title_of(name: Column) -> Column:
    """The title of an experiment by the store that its name contains, the longest one; null if none."""
    kinds = sorted(((n.removeprefix("01-hh-hm-"), t) for t, n in TITLES.items()), key=lambda x: -len(x[0]))
    return F.coalesce(*(F.when(name.contains(k), t) for k, t in kinds))


def memory_model(configs: DataFrame) -> DataFrame:
    """name, size, keysize, valsize, bytes: the published bytes of heavy-hitter stores, by (size, keysize, valsize in words)."""
    entry = F.col("keysize") + F.col("valsize") + 1
    each = F.lit(None).cast("long")
    for kind, n in (("linear", 4 * entry), ("simple", 4 * entry), ("countmin", 4 * F.col("valsize") * 3), ("cuckoo", 4 * entry), ("cuckoo-local", 8 * entry), ("cuckoo-ptr", 8 * entry), ("cuckoo-bucket", 8 * entry), ("pqueue", 8 + entry)):
        each = F.when(F.col("name").contains(kind), n).otherwise(each)
    return configs.withColumn("bytes", (each * F.col("size")).cast("long"))


def array_bytes(configs: DataFrame) -> DataFrame:
    """module, size, keysize, bytes: bytes of a sketch, counted from its arrays; words have four bytes."""
    s, k = F.col("size"), F.col("keysize")
    size = (
        F.when(F.col("module").isin("cmsketch", "countheap", "linearcounting", "mrac"), s * 4 * 4)
        .when(F.col("module") == "countarray", s * 4)
        .when(F.col("module") == "fmsketch", F.lit(4 * 4))
        .when(F.col("module") == "flowradar", s * 4 + s * (k + 2) * 4)
        .when(F.col("module") == "spacesaving", s * (k + 1) * 4)
    )
    return configs.withColumn("bytes", size.cast("long"))


def offset_totals(truth: DataFrame, reported: DataFrame, key: list[str], offset: int = 1, epochs: int = 13) -> DataFrame:
    """tp, relevant, selected, of_relevant, of_selected (per cent): over all epochs, reports of an epoch against the truth offset before it.

    Hits count in the first epochs of the truth, the totals in all."""
    t = truth.select("epoch", *key).distinct()
    r = reported.select((F.col("epoch") - offset).alias("epoch"), *key).distinct()
    tp = t.where(F.col("epoch") < epochs).join(r, ["epoch", *key], "left_semi").agg(F.count("*").alias("tp"))
    both = t.agg(F.count("*").alias("relevant")).join(r.agg(F.count("*").alias("selected"))).join(tp)  # one row each
    share = lambda n: F.when(F.col(n) > 0, _cut(100.0 * F.col("tp") / F.col(n))).otherwise(0.0)
    return both.select("tp", "relevant", "selected", share("relevant").alias("of_relevant"), share("selected").alias("of_selected"))


def unlimited(acc: DataFrame) -> DataFrame:
    """The accuracy rows of a run without a rate limit: nothing is lost, so precision and recall are 100."""
    return acc.withColumn("precision", F.lit(100.0)).withColumn("recall", F.lit(100.0))


def sweep(spark, done: DataFrame, **axes: list) -> DataFrame:
    """The product of all parameter lists, without the combinations in done."""
    out = spark.range(1)
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out.drop("id").join(done, list(axes), "left_anti")


def result_rows(acc: DataFrame, exp: str, dist: str, size: int, valsize: int) -> DataFrame:
    """One table line for each epoch, with the group label exp-dist."""
    return acc.select(F.lit(exp).alias("exp"), F.lit(size).cast("long").alias("size"), F.lit(dist).alias("dist"), F.lit(valsize).cast("long").alias("val_size"), "precision", "recall", "epoch", F.concat_ws("-", F.lit(exp), F.lit(dist)).alias("label"))


def occupancy(samples: DataFrame, mask: int) -> DataFrame:
    """total: over the cores in a bit mask, the mean of the first 5 of each core's last 10 samples."""
    w = Window.partitionBy("core").orderBy(F.desc("t"))
    last = samples.where(F.expr(f"({mask} & shiftleft(1, core)) != 0")).withColumn("n", F.row_number().over(w)).where(F.col("n").between(6, 10))
    return last.groupBy("core").agg(F.avg("kb").alias("kb")).agg(F.round(F.sum("kb"), 6).alias("total"))
