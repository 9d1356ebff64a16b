"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents are tokenised where they lie. A document over the sequence length is cut into full sequences and a rest. Full
sequences need no packing. Rests are dealt at random (by a hash of doc_id and of the text) to groups of about GROUP_DOCS; each group is packed by
itself: the longest rest first, each into the first bin with room, which a tournament tree of free capacities finds in
logarithmic time. The last bins of a group, at most one in expectation, stay partly empty; at some thousand documents a group that
is a fraction of a per cent.

Token ids come from the tokenizers library; texts are cut at ASCII white space, which no token of this vocabulary spans, and
the ids of each chunk are remembered (up to CACHE chunks), so every chunk of every text is tokenised, but not again and again.

Null and empty texts have the end id alone. Null doc_id: packed like any other, doc_id null in the result. Repeated rows are
packed each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import as_binary, prepare, stored, table

LENGTH, END_ID = 4096, 2
GROUP_DOCS = 4096
CACHE, CHUNK_BYTES = 400_000, 64
# Letters up to U+017F, whose lower case lies there too, without the dotted capital I, whose lower case is two characters.
_SIMPLE = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
_UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+|[0-9]|[^a-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")


class Ids:
    """Little-endian 32-bit ids of texts, with the ids of short chunks and units remembered.

    A chunk of ASCII and Latin letters, digits and signs is cut into the units that the vocabulary's own pattern gives, and the tokenizer's
    model encodes each unit once; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [*range(33, 127), *range(0xC0, 0x250)]}
        self.known: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(unit.translate(self.letters))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= CHUNK_BYTES:
            if len(self.units) >= CACHE:
                self.units.clear()
            self.units[unit] = out
        return out

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if _SIMPLE.fullmatch(text) and "<|" not in text:
            units = self.units
            return b"".join([units.get(u) or self._unit(u) for u in _UNIT.findall(text.lower())])
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: bytes) -> bytes:
        known, out = self.known, []
        for c in text.split():
            ids = known.get(c)
            if ids is None:
                ids = self._chunk(c)
                if len(c) <= CHUNK_BYTES:
                    if len(known) >= CACHE:
                        known.clear()
                    known[c] = ids
            out.append(ids)
        return b"".join(out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("salt", pa.int64()), ("own", pa.int64())])
_PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long, own long"


def _pieces(path: str | None, length: int):
    def run(batches):
        from pyspark import TaskContext

        ids, base, made = Ids(path or default_tokenizer()), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for doc_id, text, salt in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = ids(text) + END_ID.to_bytes(4, "little")
                n = len(data) // 4
                for start in range(0, n, length):
                    piece = data[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, salt, base + made))
                    made += 1
            cols = zip(*rows, strict=True) if rows else ((),) * len(_PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECES, strict=True)], schema=_PIECES)

    return run


class Bins:
    """A tournament tree over bins: each node holds the largest free capacity below it."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and the offset in it."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        offset = self.capacity - tree[i]
        tree[i] -= size
        at = i - self.leaves
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return at, offset


def first_fit_decreasing(sizes: list[int], capacity: int = LENGTH) -> list[tuple[int, int]]:
    """(bin, offset) of each size; ties keep their order."""
    out: list = [None] * len(sizes)
    bins = Bins(capacity, len(sizes))
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.place(sizes[i])
    return out


_PACKED_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(length: int):
    def run(batches):
        """Rows come sorted by group."""
        now, held = None, []

        def emit():
            if held:
                sizes = [r[2] for r in held]
                placed = first_fit_decreasing(sizes, length)
                cols = [*zip(*(r[:5] for r in held), strict=True), [(now << 32 | b) * 2 + 1 for b, _ in placed], [o for _, o in placed]]
                names = [c.rsplit(" ", 1)[0] for c in _PACKED_SQL.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[5] != now:
                    yield from emit()
                    now, held = row[5], []
                held.append(row)
        yield from emit()

    return run


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, group_docs: int = GROUP_DOCS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    prepare(docs.sparkSession)
    text = as_binary("text")
    pieces = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64("doc_id", text).alias("salt")).mapInArrow(_pieces(tokenizer, length), _PIECES_SQL)
    pieces = stored(pieces, "pieces")
    full, rest = pieces.where(F.col("length") == length), pieces.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group_docs))
    # Equal rows have equal salts; the piece's own number within its task spreads them.
    rest = rest.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.pmod(F.xxhash64("salt", "own"), F.lit(groups)).alias("g"))
    packed = rest.repartition(max(1, min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "g").sortWithinPartitions("g", F.desc("length"), "doc_id", "start").mapInArrow(_pack(length), _PACKED_SQL)
    whole = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("own") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
