"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of masks holds a filter for each language: bit l of a slot's mask (64 languages a word of it, as many words as it takes) belongs to
language l, so the masks at an n-gram's HASHES slots, ANDed, name all languages that contain it. Texts are lower-cased; each run of
characters that aren't letters becomes one space, and n-grams of 3 and 4 characters are taken, edges of words included. A
language contains an n-gram that its training texts have FLOOR times at least (or as often as it has texts, if fewer). A text's
hits are counted per language by popcounts, corrected by that filter's false-positive rate (its fill to the power HASHES), and the largest
share decides; the score is its part of all languages' shares.

Training: rows with a non-null lang whose crc32(doc_id) mod 4 is not 2; about SAMPLE texts a language, by a hash of id and text (a
bound on the fit; predictions read every whole text). n-grams are counted by Spark; only the filters' bits, SLOTS for each language
at most, come to the driver and are broadcast. There is no limit on languages.

Null text, or text without a letter: lang_pred und, score 0. Null doc_id: held_out false. No training rows, or an empty table to learn from:
und for all; an empty table to predict: an empty result. Repeated rows are each predicted. Equal shares: the language that is more
frequent in training, then the smaller name. Texts of any length are read whole. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import held_out, mix64, prepare, table

ORDERS, HASHES, SLOTS = (3, 4), 2, 1 << 19
SAMPLE, FLOOR = 600, 2
STRETCH = 1 << 13  #: slots of a filter that come to the driver as one row
_GAPS = re.compile(r"[\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def grams(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of a text."""
    norm = " " + _GAPS.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * _BASE + points[i : len(points) - n + 1 + i]
            out.append(h)
    return mix64(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(24 * i)) % np.uint64(SLOTS)).astype(np.int64) for i in range(HASHES)]


class Filters:
    def __init__(self, langs: list[str], filters: list[np.ndarray]):
        """langs in order of frequency; filters: the slots that are set for each."""
        self.langs = langs
        self.kind = np.uint8 if len(langs) <= 8 else np.uint64
        width = 8 if len(langs) <= 8 else 64
        self.table = np.zeros((max(1, -(-len(langs) // width)), SLOTS), self.kind)
        for i, own in enumerate(filters):
            self.table[i // width, own] |= self.kind(1 << i % width)
        self.false = np.array([(len(np.unique(own)) / SLOTS) ** HASHES for own in filters])

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For each word of the masks and each n-gram the languages that contain it."""
        where = slots(hashes)
        out = self.table[:, where[0]]
        for s in where[1:]:
            out &= self.table[:, s]
        return out

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """For each language the number of n-grams that it contains."""
        total = np.zeros(len(self.langs), np.int64)
        for at in range(0, len(hashes), 1 << 16):
            masks = self.masks(hashes[at : at + (1 << 16)])
            if self.kind is np.uint8:
                counts = np.bincount(masks[0], minlength=256)
                total += [int(counts[np.arange(256) >> i & 1 == 1].sum()) for i in range(len(self.langs))]
            else:
                for w, row in enumerate(masks):
                    bits = np.unpackbits(np.ascontiguousarray(row).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    total[64 * w : 64 * w + 64] += bits[: len(self.langs) - 64 * w]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0
        hashes = grams(text)
        shares = np.maximum(0.0, (self.hits(hashes) - len(hashes) * self.false) / np.maximum(1e-9, 1 - self.false))
        best, total = int(np.argmax(shares)), float(shares.sum())
        return self.langs[best], min(1.0, float(shares[best]) / total) if total else 0.0


def _counted(batches):
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values, n = np.unique(grams(text), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _placed(batches):
    for batch in batches:
        for h, lang in zip(slots(batch.column(1).to_numpy().view(np.uint64)), [batch.column(0)] * HASHES, strict=True):
            yield pa.RecordBatch.from_arrays([lang, pa.array(h // STRETCH), pa.array(h % STRETCH)], names=["lang", "part", "slot"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    spark = prepare(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    rows = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not rows:
        return Filters([], [])
    rates = spark.createDataFrame([(r["lang"], min(1.0, sample / r["count"]), min(FLOOR, r["count"])) for r in rows], "lang string, rate double, least long")
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), lot.alias("lot")).join(F.broadcast(rates), "lang").where("lot < rate").select("lang", "text")
    counts = picked.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    held = counts.join(F.broadcast(rates), "lang").where("n >= least").select("lang", "gram").mapInArrow(_placed, "lang string, part long, slot long")
    # SLOTS / STRETCH rows a language, of STRETCH numbers each at most
    gathered = held.groupBy("lang", "part").agg(F.collect_set("slot").alias("slots"))
    own: dict[str, list[np.ndarray]] = {r["lang"]: [np.zeros(0, np.int64)] for r in rows}
    for r in gathered.select("lang", "part", "slots").toLocalIterator():
        own[r["lang"]].append(r["part"] * STRETCH + np.array(r["slots"], np.int64))
    langs = [r["lang"] for r in rows]
    return Filters(langs, [np.concatenate(own[x]) for x in langs])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(filters)

    def run(batches):
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    id_ = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(id_, held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
