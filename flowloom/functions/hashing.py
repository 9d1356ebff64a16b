"""MurmurHash3 (x86, 32 bits) for any seed, as built-in Spark expressions.

Spark's hash() is MurmurHash3 with seed 42, and hash(a, b) seeds b's hash with a's. The 4-byte hash is a bijection for a fixed seed, so for any seed
S there is one integer x with hash(x) = S, and hash(x, key) is the key's hash with seed S: one code-generated expression.
Words are BIGINT columns in [0, 2^32).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF
C1, C2, C3, F1, F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _rotl(x: int, r: int) -> int:
    return (x << r | x >> 32 - r) & M32


def mm3_py(data: bytes, seed: int) -> int:
    """The plain algorithm, for plans and tests."""
    h, n = seed, len(data) // 4 * 4
    for i in range(0, n, 4):
        h ^= _rotl(int.from_bytes(data[i : i + 4], "little") * C1 & M32, 15) * C2 & M32
        h = (_rotl(h, 13) * 5 + C3) & M32
    if tail := int.from_bytes(data[n:], "little"):
        h ^= _rotl(tail * C1 & M32, 15) * C2 & M32
    h ^= len(data)
    h = (h ^ h >> 16) * F1 & M32
    h = (h ^ h >> 13) * F2 & M32
    return h ^ h >> 16


def seed_key(seed: int) -> int:
    """The signed integer whose hash with seed 42 is seed."""
    h = seed & M32
    h ^= h >> 16
    h = h * pow(F2, -1, 1 << 32) & M32
    h ^= h >> 13 ^ h >> 26
    h = h * pow(F1, -1, 1 << 32) & M32
    h ^= h >> 16
    h ^= 4
    k = _rotl((h - C3) * pow(5, -1, 1 << 32) & M32, 19) ^ 42
    x = _rotl(k * pow(C2, -1, 1 << 32) & M32, 17) * pow(C1, -1, 1 << 32) & M32
    return x - (1 << 32) if x >> 31 else x


def as_int(word: Column) -> Column:
    """The INT with the same 32 bits."""
    word = word.cast("long")
    return F.when(word >= 1 << 31, word - (1 << 32)).otherwise(word).cast("int")


def bswap32(word: Column) -> Column:
    w = word.cast("long")
    return F.shiftleft(w.bitwiseAND(F.lit(0xFF)), 24).bitwiseOR(F.shiftleft(w.bitwiseAND(F.lit(0xFF00)), 8)).bitwiseOR(F.shiftright(w, 8).bitwiseAND(F.lit(0xFF00))).bitwiseOR(F.shiftright(w, 24).bitwiseAND(F.lit(0xFF)))


def mm3(words: list[Column], seed: int) -> Column:
    """Hash of 1 to n 32-bit words, a BIGINT in [0, 2^32)."""
    if len(words) == 1:
        key = as_int(words[0])
    elif len(words) == 2:
        key = F.shiftleft(words[1].cast("long"), 32).bitwiseOR(words[0].cast("long"))
    else:
        key = F.unhex(F.concat(*(F.lpad(F.hex(bswap32(w)), 8, "0") for w in words)))
    return F.hash(F.lit(seed_key(seed)), key).cast("long").bitwiseAND(F.lit(M32))


def mul32(a: Column, c: int) -> Column:
    """a * c modulo 2^32 without overflowing BIGINT."""
    low = a * F.lit(c & 0xFFFF)
    high = F.shiftleft((a * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(M32))


def rotl(a: Column, r: int) -> Column:
    return F.shiftleft(a, r).bitwiseAND(F.lit(M32)).bitwiseOR(F.shiftright(a, 32 - r))


def mm3_byte(byte: Column, seed: int) -> Column:
    """Hash of a single byte: the byte-length variant at the width that shipped configurations give it."""
    k = mul32(rotl(mul32(byte.cast("long"), C1), 15), C2)
    h = k.bitwiseXOR(F.lit(seed ^ 1))
    h = mul32(h.bitwiseXOR(F.shiftright(h, 16)), F1)
    h = mul32(h.bitwiseXOR(F.shiftright(h, 13)), F2)
    return h.bitwiseXOR(F.shiftright(h, 16))


def second_hash(h: Column, shift: int, factor: int) -> Column:
    """h ^ ((h >> shift) + 1) * factor, in 32 bits: the alternative positions of the two-table stores."""
    return h.bitwiseXOR(mul32(F.shiftright(h, shift) + 1, factor))


def ctz32(h: Column) -> Column:
    """Trailing zeros; 31 for zero."""
    return F.when(h == 0, 31).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("int")


def pow2_at_least(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()
