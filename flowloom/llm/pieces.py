"""SentencePiece-style encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

A text gets a leading space and every space becomes U+2581 (the dummy prefix; no other normalisation). The automaton reads
the text once; at each position its output links list all pieces that end there, and each relaxes the best score of a
segmentation up to that position. The segmentation with the greatest sum of piece scores wins; of equal sums, the one whose
last piece is longer. A character that no piece covers falls back to its UTF-8 bytes, each at BYTE_COST below the lowest score.

No piece has U+2581 after another character (checked on loading), so no piece spans from one word into the next, and words are
segmented apart and remembered (up to CACHE words; longer words than WORD aren't).

Decoding joins the pieces, turns byte pieces back to bytes and U+2581 to spaces, and drops the first space. It gives back every text exactly,
but for U+2581 itself, which becomes a space; the column exact says whether the decoded text equals the text as it came.

Null and empty texts have no ids and decode to the empty text. Null doc_id: encoded like any other. Repeated rows are each
encoded. An empty table gives an empty result. Texts of any length are encoded whole. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import prepare, table

SPACE, BYTE_COST, CACHE, WORD = "▁", 10.0, 600_000, 64
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str | None = None):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        self.bytes_, self.texts, scores = {}, [], {}
        self.automaton = ahocorasick.Automaton()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_[int(piece[3:-1], 16)] = i
                self.texts.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.texts.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} spans words: {piece!r}")
                scores[piece] = sp.get_score(i)
                self.automaton.add_word(piece, (len(piece), i, scores[piece]))
                self.texts.append(piece.encode())
        self.automaton.make_automaton()
        self.low = min(scores.values(), default=0.0) - BYTE_COST
        self.scores = scores
        self.known: dict[str, bytes] = {}

    def viterbi(self, word: str) -> list[int]:
        n = len(word)
        best, back = [0.0] + [None] * n, [None] * (n + 1)

        def fall_back(end: int) -> None:
            raw = word[end - 1].encode("utf-8", "surrogatepass")
            best[end] = best[end - 1] + self.low * len(raw)
            back[end] = (end - 1, tuple(self.bytes_[b] for b in raw))

        done = 0
        for last, (length, i, score) in self.automaton.iter(word):
            end = last + 1
            while done < end - 1:  # positions passed without a piece ending there
                done += 1
                if best[done] is None:
                    fall_back(done)
            value = best[end - length] + score
            if best[end] is None or value > best[end]:
                best[end], back[end] = value, (end - length, (i,))
        for end in range(done + 1, n + 1):
            if best[end] is None:
                fall_back(end)
        out, at = [], n
        while at:
            at, ids = back[at]
            out += ids[::-1]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            words = _WORDS.findall(SPACE + text.replace(" ", SPACE))
        else:
            words = [SPACE + w for w in text.split(" ")]
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                v = self.viterbi(w)
                ids = struct.pack(f"<{len(v)}I", *v)
                if len(w) <= WORD:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        texts = self.texts
        raw = b"".join([texts[i] for i in memoryview(ids).cast("I").tolist()])
        return raw.decode("utf-8", "surrogatepass").replace(SPACE, " ")[1:]


def encode(docs: DataFrame, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (if asked for), n_ids, n_bytes (byte pieces), ids_crc32, decoded_crc32, exact: one row for each row of docs."""
    prepare(docs.sparkSession)

    def run(batches):
        own = Pieces(model)
        low, high = min(own.bytes_.values(), default=-1), max(own.bytes_.values(), default=-1)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                ids = own.encode(text)
                numbers = memoryview(ids).cast("I").tolist()
                back = own.decode(ids)
                values = (doc_id, numbers if with_ids else None, len(numbers), sum(low <= i <= high for i in numbers), zlib.crc32(ids), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == text)
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            names = ["doc_id", "ids", "n_ids", "n_bytes", "ids_crc32", "decoded_crc32", "exact"]
            keep = [i for i in range(7) if with_ids or i != 1]
            yield pa.RecordBatch.from_arrays([arrays[i] for i in keep], names=[names[i] for i in keep])

    ids_sql = "ids array<int>, " if with_ids else ""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {ids_sql}n_ids long, n_bytes long, ids_crc32 long, decoded_crc32 long, exact boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
