"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over word positions of which some are ignored.  Seed
hashes of all items and of all documents are joined; for each document and item
that share one, the words on every diagonal with a shared seed are compared one
by one, so replaced words do not hide an overlap.  Words are compared without
ASCII case and without punctuation around them.

An overlap is a stretch of one diagonal with at least three quarters of its
words equal that has MIN_EQUAL equal words, or as many as MIN_SHARE of the
item's.  The MASKS are chosen so that every such stretch of an item of MIN_ITEM
words or more holds a seed, wherever its replaced words stand (a test walks
through all of them).  Of an item's stretches in a document the one with most
equal words is reported, then the shortest, then the first.  Items of fewer than
MIN_ITEM words are found only where they are a whole document.

Documents pass a gate of at most MAX_GATE bits, filled from the items' seeds,
before anything is shuffled; a larger benchmark lets more seeds through and
changes nothing else.  The items' side of a join is broadcast if it has
BROADCAST_BYTES at most, and dealt over SALTS salts otherwise.

Cases.  Null or empty texts and items match nothing.  Repeated rows and ids are
judged one by one, and the result has the best overlap for each pair of ids.
Null ids stay null.  Other columns are ignored.  An empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import cut, forget
from . import words
from .hot import hot_keys, join_around

#: Fixed masks; 1 marks the positions that must be equal.
MASKS = ("1111", "11101", "11011", "10111", "100111")
MIN_EQUAL, MIN_SHARE, MIN_ITEM = 13, 0.75, 5
GATE_BITS, MIN_GATE, MAX_GATE = 256, 1 << 16, 1 << 27
BROADCAST_BYTES, SALTS = 32 << 20, 16
#: Items that one task compares with one copy of a document's text.
ITEMS_A_ROW = 1000
SCHEMA = "doc_id long, item_id long, start long, length long, n_equal long, item_words long"
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
U64 = words.U64


def plain_hashes(data: np.ndarray, found: words.Words) -> np.ndarray:
    """Hashes of words without case and surrounding punctuation; a word of punctuation alone stays."""
    start, end = found.start.copy(), found.end.copy()
    for at, step in ((end, -1), (start, 1)):
        todo = np.arange(len(at))
        while len(todo):
            todo = todo[(end[todo] - start[todo] > 1) & _PUNCT[data[at[todo] - (step < 0)]]]
            at[todo] += step
    return words.Words(data, start, end, found.first).hashes(seed=9, lower=True)


def seeded(h: np.ndarray, mask: str, seed: int) -> np.ndarray:
    """The mask's hash at every place; borders of texts are ignored."""
    out = np.zeros(max(0, len(h) - len(mask) + 1), U64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(words.constants(len(mask), 100 + seed)):
            if mask[k] == "1":
                out += h[k : k + len(out)] * c
    return words.mix(out + U64(seed))


def whole_seeds(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of fewer than MIN_ITEM words, and the hash of all their words."""
    counts, text, seed = np.diff(first), [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for n in range(1, MIN_ITEM):
        at = np.flatnonzero(counts == n)
        text.append(at)
        seed.append(seeded(h, "1" * n, 50 + n)[first[:-1][at]])
    return np.concatenate(text), np.concatenate(seed)


def mask_seeds(h: np.ndarray, first: np.ndarray, passes=None) -> tuple[np.ndarray, np.ndarray]:
    """Texts, by position in the run, and their seeds that pass the gate."""
    text, seed = [], []
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k, mask in enumerate(MASKS):
        g = seeded(h, mask, k)
        at = np.flatnonzero(passes(g)) if passes else np.arange(len(g))
        at = at[at + len(mask) <= first[doc[at] + 1]]
        text.append(doc[at])
        seed.append(g[at])
    return np.concatenate(text), np.concatenate(seed)


def need(n: int) -> int:
    """Equal words that an overlap with an item of n words must have."""
    return min(MIN_EQUAL, int(np.ceil(MIN_SHARE * n)))


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, length and equal words of the stretch, three quarters equal at least, with most equal words, then the shortest, then the first.

    In sums of +1 for an equal word and -3 for another such a stretch does not
    fall; for each end the most equal words come with the first start that is no
    higher, and with the equal words at both borders the stretch is shortest."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0, 0
    run = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    low = np.minimum.accumulate(run)
    count = np.concatenate([[0], np.cumsum(equal)])
    end = at + 1
    begin = np.searchsorted(-low, -run[end], "left")
    begin = at[np.searchsorted(at, begin)]
    n, length = count[end] - count[begin], end - begin
    k = np.lexsort((begin, length, -n))[0]
    return int(begin[k]), int(length[k]), int(n[k])


def diagonals(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Diagonals with a shared seed, in rising order; memory is that of the document, however often words repeat."""
    hit = np.zeros(len(doc) + len(item), bool)
    for k, mask in enumerate(MASKS):
        d, i = seeded(doc, mask, k), seeded(item, mask, k)
        order = np.argsort(i, kind="stable")
        lo, hi = np.searchsorted(i[order], d, "left"), np.searchsorted(i[order], d, "right")
        at = np.flatnonzero(hi > lo)
        while len(at):
            hit[at - order[lo[at]] + len(item)] = True
            lo[at] += 1
            at = at[hi[at] > lo[at]]
    return np.flatnonzero(hit) - len(item)


def verify(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int] | None:
    """The best overlap of two texts' word hashes: start, length, equal words."""
    if len(item) < MIN_ITEM:
        return (0, len(item), len(item)) if len(item) and np.array_equal(doc, item) else None
    best, least = None, need(len(item))
    for d in diagonals(doc, item).tolist():
        a, z = max(0, -d), min(len(item), len(doc) - d)
        equal = item[a:z] == doc[a + d : z + d]
        if int(equal.sum()) < (best[0] if best else least):
            continue
        start, length, n = best_stretch(equal)
        row = (n, -length, -(a + d + start))
        if n >= least and (best is None or row > best):
            best = row
            if n == len(item):  # later diagonals start later
                break
    return (-best[2], -best[1], best[0]) if best else None


def item_table(benchmark: DataFrame) -> DataFrame:
    """item (a key), item_id, w (hashes of its words) and seeds of every item with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sub, data, offsets in words.runs(batches):
            found = words.find_words(data, offsets)
            h, first = plain_hashes(data, found), found.first
            text, seed = mask_seeds(h, first)
            long = found.counts[text] >= MIN_ITEM
            short_text, short = whole_seeds(h, first)
            text, seed = np.concatenate([text[long], short_text]), np.concatenate([seed[long], short])
            per = [np.unique(seed[text == i]) for i in range(sub.num_rows)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in per])]).astype(np.int32)), pa.array(np.concatenate([*per, np.zeros(0, U64)]).view(np.int64)))
            own = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([sub.column(0), sub.column(1), own, lists], ["item", "item_id", "w", "seeds"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    rows = rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")  # written by the caller, so the numbers stay
    return rows.mapInArrow(run, "item long, item_id long, w array<long>, seeds array<long>").where("size(w) > 0")


def probes(seed, mod, shift) -> list:
    """The gate's places of a seed: three runs of its bits."""
    return [mod(shift(seed, k)) for k in (0, 20, 37)]


def gate_of(seeds: DataFrame, rows: int) -> np.ndarray:
    """The gate's bits, packed: GATE_BITS a seed between MIN_GATE and MAX_GATE; nothing else reaches the driver."""
    bits = min(MAX_GATE, max(MIN_GATE, 1 << int(GATE_BITS * max(1, rows) - 1).bit_length()))
    places = probes(F.col("seed"), lambda x: x.bitwiseAND(F.lit(bits - 1)), lambda x, k: F.shiftrightunsigned(x, k))
    place = seeds.select(F.explode(F.array(*places)).alias("place"))
    got = place.groupBy(F.shiftright("place", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 31 as int))")).alias("v")).toArrow()
    gate = np.zeros(bits // 32, np.uint32)
    gate[got.column(0).to_numpy()] = got.column(1).to_numpy().astype(np.uint32)
    return gate


def seeds_of(docs: DataFrame, gate: np.ndarray) -> DataFrame:
    """key, doc_id, w (hashes of its words) and seeds (the distinct ones that pass the gate) of each document that has any."""
    shared = docs.sparkSession.sparkContext.broadcast(gate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        most = U64(len(bits) * 32 - 1)

        def passes(g: np.ndarray) -> np.ndarray:
            ok = np.arange(len(g))
            for place in probes(g, lambda x: x & most, lambda x, k: x >> U64(k)):
                at = place[ok]
                ok = ok[(bits[(at >> U64(5)).astype(np.int64)] >> (at & U64(31)).astype(np.uint32)) & np.uint32(1) != 0]
            out = np.zeros(len(g), bool)
            out[ok] = True
            return out

        for sub, data, offsets in words.runs(batches):
            found = words.find_words(data, offsets)
            h = plain_hashes(data, found)
            text, seed = mask_seeds(h, found.first, passes)
            short_text, short = whole_seeds(h, found.first)
            ok = passes(short)
            text, seed = np.concatenate([text, short_text[ok]]), np.concatenate([seed, short[ok]])
            order = np.lexsort((seed, text))
            text, seed = text[order], seed[order]
            fresh = np.ones(len(text), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])
            text, seed = text[fresh], seed[fresh]
            at, border = np.unique(text, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(border, len(text)).astype(np.int32)), pa.array(seed.view(np.int64)))
            own = [h[found.first[i] : found.first[i + 1]] for i in at]
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)), pa.array(np.concatenate([*own, np.zeros(0, U64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([sub.column(0).take(pa.array(at)), sub.column(1).take(pa.array(at)), held, lists], ["key", "doc_id", "w", "seeds"])

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, w array<long>, seeds array<long>")


def joined(left: DataFrame, right: DataFrame, on: str, size: int) -> DataFrame:
    """An inner join with the items' side: broadcast if it is known to be small, else salted."""
    if size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on)
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).join(salted, [on, "__salt"]).drop("__salt")


def compared(rows: DataFrame) -> DataFrame:
    """rows (doc_id, w, items) to the overlaps of each document with its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for d, (held, items) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                doc = np.array(held.values).view(U64)
                for row in items:
                    item = np.array(row["w"].values).view(U64)
                    if got := verify(doc, item):
                        out.append((ids[d], row["item_id"].as_py(), *got, len(item)))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(names)})

    return rows.select("doc_id", "w", "items").mapInArrow(run, SCHEMA)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each pair of a document and an item that overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    items = cut(item_table(benchmark), "items")
    seeds = items.select("item", F.explode("seeds").alias("seed"))
    n, total = (x or 0 for x in items.agg(F.sum(F.size("seeds")), F.sum(F.size("w") + 4)).first())
    # documents with a hit are written with the hashes of their words: no other row is shuffled
    hits = cut(seeds_of(docs, gate_of(seeds, n)), "hits")
    pairs = cut(joined(hits.select("key", F.explode("seeds").alias("seed")), seeds, "seed", 16 * n).select("key", "item").distinct(), "pairs")
    parts = pairs.groupBy("key").agg(F.ceil(F.count("*") / ITEMS_A_ROW).alias("parts"))
    dealt = joined(pairs.join(parts, "key"), items.select("item", "item_id", "w"), "item", 8 * total)
    dealt = dealt.groupBy("key", F.pmod(F.xxhash64("item"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("item_id", "w")).alias("items"))
    dealt = cut(dealt.select("key", "items"), "dealt")
    forget(pairs)
    again = hot_keys(hits, "key", F.monotonically_increasing_id())  # one row many times over
    out = compared(join_around(hits.select("key", "doc_id", "w"), dealt, "key", again))
    best = F.max_by(F.struct("start", "length", "n_equal", "item_words"), F.struct("n_equal", -F.col("length"), -F.col("start"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that overlap a benchmark item; rows with a null id stay only if no such row overlaps."""
    bad = cut(overlaps(docs, benchmark).select(F.col("doc_id").alias("__leaked")).distinct(), "leaked")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("__leaked")), "left_anti")
