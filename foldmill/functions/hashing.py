"""32-bit hashes. Arithmetic ones are column expressions on longs, masked to 32 bits;
block hashes run in Arrow batches, all strings of a batch step by step together.

The constants are those of the published algorithms (fixed values).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foldmill.functions.scalars import by_byte, bytes_of

MASK = 0xFFFFFFFF
U32 = np.uint32


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def _left(c: Column, n: int) -> Column:
    return _low(F.shiftleft(c, n))


def _right(c: Column, n: int) -> Column:
    return F.shiftright(c, n)


#: The constants of the two integer hashes that have some.
AVALANCHE_1 = (0x7ED55D16, 0xC761C23C, 0x165667B1, 0xD3A2646C, 0xFD7046C5, 0xB55A4F09)
AVALANCHE_HALF = (0x479AB41D, 0xE4AA10CE, 0x9942F0A6, 0x5AEDD67D, 0x17BEA992)


def avalanche_1(key: Column) -> Column:
    """Integer hash with six shifts and constants, full avalanche."""
    c = AVALANCHE_1
    a = _low(key.cast("long"))
    a = _low(a + c[0] + _left(a, 12))
    a = a.bitwiseXOR(F.lit(c[1])).bitwiseXOR(_right(a, 19))
    a = _low(a + c[2] + _left(a, 5))
    a = _low(a + c[3]).bitwiseXOR(_left(a, 9))
    a = _low(a + c[4] + _left(a, 3))
    return a.bitwiseXOR(F.lit(c[5])).bitwiseXOR(_right(a, 16))


def avalanche_2(key: Column) -> Column:
    """Integer hash with seven shifts and no constants, full avalanche."""
    a = _low(key.cast("long"))
    a = _low(a - _left(a, 6))
    a = a.bitwiseXOR(_right(a, 17))
    a = _low(a - _left(a, 9))
    a = a.bitwiseXOR(_left(a, 4))
    a = _low(a - _left(a, 3))
    a = a.bitwiseXOR(_left(a, 10))
    return a.bitwiseXOR(_right(a, 15))


def avalanche_half(key: Column) -> Column:
    """Integer hash with half avalanche: use its high bits."""
    c = AVALANCHE_HALF
    a = _low(key.cast("long"))
    a = _low(a + c[0] + _left(a, 8))
    a = a.bitwiseXOR(F.lit(c[1])).bitwiseXOR(_right(a, 5))
    a = _low(_low(a + c[2]) - _left(a, 14))
    a = a.bitwiseXOR(F.lit(c[3])).bitwiseXOR(_right(a, 3))
    return _low(a + c[4] + _left(a, 7))


def fnv1(text: Column) -> Column:
    """FNV-1: multiply by the prime, then xor the byte."""
    return F.aggregate(bytes_of(text), F.lit(0x811C9DC5).cast("long"), lambda h, b: _low(h * 16777619).bitwiseXOR(b))


def null_hash(text: Column, shift: int = 0) -> Column:
    """Four bytes, signed and the first highest, that end ``shift`` bytes before the end; 0 if there are fewer."""
    start = F.octet_length(text) - shift - 3
    part = lambda k: F.ascii(F.substring(by_byte(text), start + k, F.lit(1))).cast("long")
    signed = lambda b: F.when(b > 127, b - 256).otherwise(b)
    total = sum((F.shiftleft(signed(part(k)), 24 - 8 * k) for k in range(1, 4)), F.shiftleft(signed(part(0)), 24))
    return F.when(start >= 1, _low(total)).otherwise(F.lit(0).cast("long"))


def md5_raw(text: Column) -> Column:
    return F.unhex(F.md5(text))


def sha1_raw(text: Column) -> Column:
    return F.unhex(F.sha1(text))


def _matrix(values: list[bytes], block: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of bytes, padded with zeros to whole blocks, and their lengths."""
    n = np.array([len(v) for v in values], np.int64)
    width = max(block, -(-int(n.max(initial=0)) // block) * block)
    flat = np.zeros((len(values), width), np.uint8)
    for size in np.unique(n):
        which = np.flatnonzero(n == size)
        flat[which, :size] = np.frombuffer(b"".join(values[i] for i in which), np.uint8).reshape(len(which), size)
    return flat, n


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U32(k)) | (x >> U32(32 - k))


def lookup3_many(values: list[bytes], seed: int = 0) -> np.ndarray:
    """Bob Jenkins' lookup3 (hashlittle): 12 bytes a step into three words, then a final mix."""
    return lookup3_pairs(values, seed)[0]


def lookup3_pairs(values: list[bytes], seed: int = 0, second: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each value (hashlittle2): the first is that of lookup3 if the second seed is 0."""
    flat, n = _matrix(values, 12)
    words = flat.view("<u4").reshape(len(values), -1)
    a = (np.uint64(0xDEADBEEF) + n.astype(np.uint64) + np.uint64(seed)).astype(U32)
    b, c = a.copy(), a + U32(second)
    steps = np.maximum(1, -(-n // 12))
    for s in range(words.shape[1] // 3):
        live = np.flatnonzero((s < steps) & (n > 0))
        if not len(live):
            break
        got = [state[live] + words[live, 3 * s + k] for k, state in enumerate((a, b, c))]
        last = s == steps[live] - 1
        mixed = [g.copy() for g in got]
        for k, turn in zip((4, 6, 8, 16, 19, 4), (0, 1, 2) * 2, strict=True):
            p, q, r = turn, (turn + 1) % 3, (turn + 2) % 3
            mixed[p] = (mixed[p] - mixed[r]) ^ _rotl(mixed[r], k)
            mixed[r] = mixed[r] + mixed[q]
        for k, turn in zip((14, 11, 25, 16, 4, 14, 24), (2, 0, 1, 2, 0, 1, 2), strict=True):
            other = (turn + 2) % 3
            got[turn] = (got[turn] ^ got[other]) - _rotl(got[other], k)
        for state, m, f in zip((a, b, c), mixed, got, strict=True):
            state[live] = np.where(last, f, m)
    return c, b


def murmur2_many(values: list[bytes], seed: int = 42) -> np.ndarray:
    """MurmurHash2, 32 bits: four bytes a step."""
    flat, n = _matrix(values, 4)
    words = flat.view("<u4").reshape(len(values), -1)
    m = U32(0x5BD1E995)
    h = (np.uint64(seed) ^ n.astype(np.uint64)).astype(U32)
    for s in range(words.shape[1]):
        whole, part = np.flatnonzero(n >= 4 * (s + 1)), np.flatnonzero((n > 4 * s) & (n < 4 * (s + 1)))
        k = words[whole, s] * m
        k = (k ^ (k >> U32(24))) * m
        h[whole] = (h[whole] * m) ^ k
        h[part] = (h[part] ^ words[part, s]) * m
    h = (h ^ (h >> U32(13))) * m
    return h ^ (h >> U32(15))


def superfast_many(values: list[bytes]) -> np.ndarray:
    """Hsieh's SuperFastHash: two 16-bit halves a step; the tail's last byte is signed."""
    flat, n = _matrix(values, 4)
    halves = flat.view("<u2").reshape(len(values), -1).astype(U32)
    signed = flat.view(np.int8)
    h = n.astype(U32)
    for s in range(halves.shape[1] // 2):
        live = np.flatnonzero(n >= 4 * (s + 1))
        x = h[live] + halves[live, 2 * s]
        x = (x << U32(16)) ^ (halves[live, 2 * s + 1] << U32(11)) ^ x
        h[live] = x + (x >> U32(11))
    base = n & ~3
    byte = lambda rows, k: signed[rows, base[rows] + k].astype(np.int32).astype(U32)
    half = lambda rows: halves[rows, base[rows] // 2]
    one, two, three = (np.flatnonzero(n & 3 == k) for k in (1, 2, 3))
    x = h[three] + half(three)
    x ^= x << U32(16)
    x ^= byte(three, 2) << U32(18)
    h[three] = x + (x >> U32(11))
    x = h[two] + half(two)
    x ^= x << U32(11)
    h[two] = x + (x >> U32(17))
    x = h[one] + byte(one, 0)
    x ^= x << U32(10)
    h[one] = x + (x >> U32(1))
    for up, down in ((3, 5), (4, 17), (25, 6)):
        h ^= h << U32(up)
        h += h >> U32(down)
    return np.where(n == 0, U32(0), h)


def _udf(many: Callable[[list[bytes]], np.ndarray]):
    @pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            known = part.notna().to_numpy()
            out = pd.Series([None] * len(part), dtype="Int64")
            values = [v.encode("utf-8", "surrogatepass") for v in part[known]]
            order = np.argsort([len(v) for v in values], kind="stable")
            got = np.empty(len(values), np.int64)
            for k in range(0, len(order), 4096):
                some = order[k : k + 4096]
                got[some] = many([values[i] for i in some])
            out[known] = got
            yield out

    return run


def lookup3(text: Column, seed: int = 0) -> Column:
    return _udf(lambda v: lookup3_many(v, seed))(text)


def murmur2(text: Column, seed: int = 42) -> Column:
    return _udf(lambda v: murmur2_many(v, seed))(text)


def superfast(text: Column) -> Column:
    return _udf(superfast_many)(text)
