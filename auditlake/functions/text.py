"""Text functions as column expressions; all but simhash stay in the JVM."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Arial advance widths in thousandths of the font size, ASCII 32 to 126.
WIDTHS = [int(x) for x in (
    "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 "
    "1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 "
    "333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584").split()]  # fmt: skip
OTHER_WIDTH, TITLE_PX, DESC_PX = 600, 20, 14


#: White space as browsers' scripts know it.
SPACE = re.compile("[\\t\\n\\v\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")


def pixels_of(text: str, font: int) -> int:
    units = sum(WIDTHS[ord(c) - 32] if " " <= c <= "~" else OTHER_WIDTH for c in text)
    return (units * font * 2 + 1000) // 2000


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def pixels(c: Column, font: int) -> Column:
    """Width of a text, rounded half up."""
    table = F.array(*[F.lit(w) for w in WIDTHS])
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    width = lambda x: F.when(F.ascii(x).between(32, 126), F.get(table, F.ascii(x) - 32)).otherwise(OTHER_WIDTH)
    units = F.aggregate(letters, F.lit(0), lambda a, x: a + width(x))
    return F.floor(units * font / 1000 + 0.5).cast("int")


def fnv64(c: Column) -> Column:
    """FNV-1a over UTF-16 units, as struct (hi, lo) of 32-bit halves, so that nothing overflows."""
    hexed = F.hex(F.encode(c, "UTF-16BE"))
    units = F.transform(F.filter(F.split(hexed, "(?<=\\G.{4})"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(s: Column, u: Column) -> Column:
        x = s["lo"].bitwiseXOR(u)
        low = x * 435
        return F.struct((s["hi"] * 435 + F.shiftleft(x, 8) + F.shiftrightunsigned(low, 32)).bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    return F.aggregate(units, start, step)


def shingle_hashes(words: list[str]) -> np.ndarray:
    """FNV-1a of each run of three words (of all, if they are fewer), over UTF-16 units, all runs a step at a time."""
    units = np.frombuffer(" ".join(words).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    size = np.array([len(w.encode("utf-16-le", "surrogatepass")) // 2 for w in words])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    n = max(1, len(words) - 2)
    first, length = start[:n], start[np.minimum(np.arange(n) + 2, len(words) - 1)] + size[np.minimum(np.arange(n) + 2, len(words) - 1)] - start[:n]
    order = np.argsort(-length, kind="stable")
    first, length, h = first[order], length[order], np.full(n, 0xCBF29CE484222325, np.uint64)
    left = n
    with np.errstate(over="ignore"):
        for k in range(int(length[0])):
            while length[left - 1] <= k:
                left -= 1
            h[:left] = (h[:left] ^ units[first[:left] + k]) * np.uint64(0x100000001B3)
    return h


def simhash_of(text: str) -> int:
    words = [w for w in SPACE.split(text.lower()) if w]
    if not words:
        return 0
    bits = np.unpackbits(shingle_hashes(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = 2 * bits.sum(0, dtype=np.int64) - len(bits)
    return int(np.packbits(votes > 0, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _simhash(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else simhash_of(t)).astype("Int64")


def simhash(c: Column) -> Column:
    """64-bit simhash of 3-word shingles as a long; 0 for an empty text.  Arrow batches: 64 votes a shingle are out of reach of column expressions."""
    return _simhash(c)


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64
