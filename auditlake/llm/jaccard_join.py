"""N-gram Jaccard join with vertical partitioning.

Texts, with A-Z lowered, become sets of distinct shingles of SHINGLE words; two
link when their Jaccard similarity is at least PERCENT / 100.  The result is
exact but for hash collisions among 64 bits within one pair of linked sets.

1. Equal sets are folded into one class (128 bits of a digest); links are sought
   between classes only, and copies take their class's component.
2. Prefix filter.  Sets of size n that link share at least k shingles among their
   n - ceil(0.75 n) + k smallest by hash.  Only those are shuffled; a class with
   fewer than k of them in other classes is done.  k is n / 20, 1 at least.
3. For the classes left, shingles of one class only are dropped and the others
   ordered globally by class frequency, then hash.  A class with fewer than
   ceil(0.75 n) shared shingles is done.
4. Each class has a sketch, the parity of its shingles in BITS ranges of their
   hashes.  Sketches differ in no more bits than sets in shingles, so a pair whose
   sketches differ in too many is never made: members of one group of near copies
   that do not link mostly go so, before they are a row.
5. Candidates share a shingle in the rarest part of that order.  First every such
   shingle compares its classes with one pivot; where they are still in different
   components, those outside the largest are compared with PIVOTS of it that the
   shingle draws by hashes; those that are outside even then are compared with all
   in other components.  No pair within a component is needed or made, and none
   whose shared shingles from there on are too few for the overlap of a link.
6. Vertical partitioning: the global order is cut into FRAGMENTS ranges of
   hashes, a table each; a pair's overlap is counted in each on its own and summed
   per pair, which goes when the fragments left can't make up for what is missing.

Cases.  Null, empty and blank texts have the empty set and link with nothing.
Texts with fewer words than a shingle have their whole word sequence as the one
shingle.  Repeated rows give a row each; rows with a null id are counted, but
their component is null and they link nothing.  Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from ..store import cut, forget
from .hot import folded, hot_keys, join_around
from .substrings import list_column, repeated

SHINGLE, PERCENT, FRAGMENTS = 5, 75, 4
#: Bits of a class's sketch.
BITS = 1024
#: Pivots that a shingle draws in each round before all that is still apart is compared.
PIVOTS = (4, 16)
U64 = words.U64


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    found = words.find_words(words.ASCII_LOWER[data], offsets)
    h, first = found.hashes(seed=13), found.first
    at = np.flatnonzero(words.inside(first, n, len(h)))
    g, border, counts = words.ngrams(h, n, 60)[at], np.searchsorted(at, first), found.counts
    out = []
    for i in range(len(counts)):
        if 0 < counts[i] < n:
            out.append(words.ngrams(h[first[i] : first[i + 1]], int(counts[i]), 70 + int(counts[i])))
        else:
            out.append(np.unique(g[border[i] : border[i + 1]]))
    return out


def set_key(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def bound(n: np.ndarray) -> np.ndarray:
    """Shingles that two linked sets must share if one has n."""
    return -(-PERCENT * n // 100)


def scan(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, key, k, need and the hash prefix h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sub, data, offsets in words.runs(batches):
            sets = shingles(data, offsets, n)
            size = np.array([len(s) for s in sets])
            need = np.maximum(1, size // 20)
            heads = [s[: max(0, m - bound(m) + k)] for s, m, k in zip(sets, size.tolist(), need.tolist(), strict=True)]
            keys = [set_key(s) for s in sets]
            flat = np.concatenate(heads) if heads else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays(
                [sub.column(0), pa.array(size), pa.array([k.hex() for k in keys]), pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys]), pa.array(need.astype(np.int64)), list_column(flat.view(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in heads])]))],
                ["doc_id", "n_shingles", "key", "k", "need", "h"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, key string, k long, need long, h array<long>")


def sketch(s: np.ndarray) -> list[int]:
    """The parity of a set's hashes in each of BITS ranges, as words of 64 bits."""
    odd = (np.bincount((words.mix(s) >> U64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8").tolist()


def whole_sets(cands: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sub, data, offsets in words.runs(batches):
            sets, keys = shingles(data, offsets, n), sub.column(1).to_pylist()
            ok = np.array([set_key(s).hex() == k for s, k in zip(sets, keys, strict=True)])  # not another text under the same id
            sets = [s for s, o in zip(sets, ok, strict=True) if o]
            flat = np.concatenate(sets) if sets else np.zeros(0, U64)
            ids = sub.column(0).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.array([len(s) for s in sets], np.int64)), pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), list_column(flat.view(np.int64), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64))], ["id", "n", "sketch", "s"])

    return cands.select("id", "key", "text").mapInArrow(run, "id long, n long, sketch array<long>, s array<long>").dropDuplicates(["id"])  # repeated rows; ids are those of sets


def fragment(token):
    return F.shiftrightunsigned(token, 62).cast("int") % FRAGMENTS


def part_of(shared: DataFrame, f: int) -> DataFrame:
    """id, n, s (the shingles in fragment f) and rest, the number of those in later ones."""
    own = F.transform(F.filter("s", lambda x: fragment(x["g"]) == f), lambda x: x["g"])
    return shared.select("id", "n", own.alias("s"), F.size(F.filter("s", lambda x: fragment(x["g"]) > f)).alias("rest"))


def verify(pairs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """pairs (a, b) that link.  parts: for each fragment id, n, s and rest, the number of shingles in later ones.

    Overlaps are counted fragment by fragment and summed per pair; a pair goes as soon as what is left of it can't make up for what is missing."""
    alive = pairs.withColumn("o", F.lit(0))
    for part in parts:
        left = part.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("rest").alias("ra"))
        right = part.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("rest").alias("rb"))
        both = alive.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb", (F.col("o") + F.size(F.array_intersect("sa", "sb"))).alias("o"))
        alive = both.where(may_reach(F.col("o") + F.least("ra", "rb"), "na", "nb")).select("a", "b", "o")
    return alive.select("a", "b")


def may_reach(overlap, n: str, m: str):
    """Whether an overlap is enough for sets of n and m shingles to link."""
    return (100 + PERCENT) * overlap >= PERCENT * (F.col(n) + F.col(m))


def may_link(x: str, y: str, n: str, m: str):
    """Whether sets of n and m shingles can link if a shingle is the first that they share.

    x and y are the shared shingles of each from that one on; the overlap is at
    most the smaller.  At the first shingle that two linked sets share it holds."""
    return may_reach(F.least(x, y), n, m)


def near(x: str, y: str, n: str, m: str):
    """Whether sets of n and m shingles with the sketches x and y can link: by the bits in which these differ."""
    bits = reduce(Column.__add__, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(BITS // 64)])
    return (100 + PERCENT) * bits <= (100 - PERCENT) * (F.col(n) + F.col(m))


def links(classes: DataFrame) -> DataFrame:
    """classes: id, n, s (whole sets) and their sketch, to (node, component) of those that link with another."""
    rows = classes.select("id", "n", F.explode("s").alias("g"))
    freq = rows.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    hot = hot_keys(rows, "g", F.col("id"))
    shared = join_around(rows, freq, "g", hot).groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("s"))
    least = F.ceil(F.col("n") * PERCENT / 100).cast("int")
    shared = cut(shared.where(F.size("s") >= least), "shared")
    head = shared.select("id", "n", F.size("s").alias("l"), F.posexplode(F.slice("s", F.lit(1), F.size("s") - least + 1)).alias("i", "x")).select("id", "n", F.col("x.g").alias("g"), (F.col("l") - F.col("i")).alias("l"))
    parts = [cut(part_of(shared, f), f"fragment{f}") for f in range(FRAGMENTS)]

    pivot = head.groupBy("g").agg(F.min(F.struct(F.xxhash64("id").alias("r"), "id", "n", "l")).alias("p"), F.count("*").alias("c")).where("c > 1").select("g", "p")
    pairs = join_around(head, pivot, "g", hot).where((F.col("id") != F.col("p.id")) & may_link("l", "p.l", "n", "p.n"))
    pairs = pairs.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
    found = cut(verify(pairs, parts), "links")
    first = components(found)

    for pivots in PIVOTS:
        marked = cut(head.join(first, head["id"] == first["node"], "left").select("id", "n", "l", "g", F.coalesce("component", "id").alias("c")), "marked")
        drawn = F.struct(F.xxhash64("id", "g").alias("r"), "id", "n", "l")
        sizes = marked.groupBy("g", "c", F.pmod(F.xxhash64("g", "id"), F.lit(pivots)).alias("slot")).agg(F.count("*").alias("m"), F.min(drawn).alias("p"))
        sizes = sizes.groupBy("g", "c").agg(F.sum("m").alias("m"), F.collect_list("p").alias("ps"))
        sizes = sizes.groupBy("g").agg(F.max(F.struct("m", "c", "ps")).alias("top"), F.count("*").alias("cs")).where("cs > 1")
        few = join_around(marked, sizes.select("g", "top"), "g", hot).where("c != top.c").select("id", "n", "l", F.explode("top.ps").alias("p"))
        found, first = merged(few.where(may_link("l", "p.l", "n", "p.n")).select("id", F.col("p.id").alias("i")), parts, found, first)
        forget(marked)

    marked = cut(head.join(first, head["id"] == first["node"], "left").select("id", "n", "l", "g", F.coalesce("component", "id").alias("c")), "marked")
    top = marked.groupBy("g", "c").agg(F.count("*").alias("m")).groupBy("g").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count("*").alias("cs")).where("cs > 1")
    mixed = join_around(marked, top.select("g", "top"), "g", hot)
    mixed = cut(mixed.join(classes.select("id", "sketch"), "id"), "mixed")
    forget(marked)
    # of two sets that link, the smaller one has at least this share of its shared shingles from the first common one on
    short = mixed.where(f"{100 + PERCENT} * l >= {2 * PERCENT} * n")
    other = lambda df: df.select("g", F.col("id").alias("i"), F.col("n").alias("m"), F.col("l").alias("k"), F.col("c").alias("d"), F.col("sketch").alias("drawn"))
    size, size_other = F.struct("n", "id"), F.struct("m", "i")
    apart = (F.col("c") != F.col("d")) & may_link("l", "k", "n", "m") & near("sketch", "drawn", "n", "m")
    pairs = short.where("c != top").join(other(mixed), "g").where(apart & (size < size_other))
    pairs = pairs.select("id", "i").union(mixed.where("c != top").join(other(short), "g").where(apart & (size > size_other)).select("id", "i"))
    out = merged(pairs, parts, found, first)[1]
    for df in (mixed, *parts, shared):
        forget(df)
    return out


def merged(pairs: DataFrame, parts: DataFrame, found: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links found, with those among the pairs (id, i), and the components of all."""
    pairs = pairs.select(F.least("id", "i").alias("a"), F.greatest("id", "i").alias("b")).distinct()
    more = cut(verify(pairs, parts), "links")
    if more.isEmpty():
        return found, first
    found = found.union(more)
    return found, components(found)


def join(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    scanned = cut(scan(docs, n).withColumn("row", F.monotonically_increasing_id()), "scan")
    slim = scanned.select("doc_id", "n_shingles", "key", "k", "need")
    # a class is known by its set's digest, of which 64 bits go with its shingles; one of its documents stands for it
    classes = slim.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("k").alias("k"), F.min("need").alias("need"))
    rows = folded(scanned.where("doc_id is not null"), "key", "row").select("k", F.explode("h").alias("g"))
    alive = repeated(rows, ["g"], "k").groupBy("k").agg(F.count_distinct("g").alias("c"))
    # written before texts are shuffled, so that the shuffles of prefixes are gone by then
    # and numbered, so that classes whose 64 bits are equal stay two
    left = cut(classes.join(alive, "k").where("c >= need").select("doc_id", F.monotonically_increasing_id().alias("id"), "key"), "left")
    sets = cut(whole_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(left, "doc_id"), n), "sets")
    found = cut(links(sets), "components")
    forget(sets)
    linked = cut(left.join(found, left["id"] == found["node"]).select("key", "doc_id", "component"), "linked")
    forget(left)
    forget(found)
    lowest = linked.groupBy("component").agg(F.min("doc_id").alias("low"))
    linked = join_around(linked, lowest, "component", hot_keys(linked, "component", F.col("key"))).select("key", "low")
    named = classes.select("key", "doc_id").join(linked, "key", "left").select("key", F.coalesce("low", "doc_id").alias("component"))
    out = join_around(slim, named, "key", hot_keys(slim, "key", F.col("doc_id")), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
