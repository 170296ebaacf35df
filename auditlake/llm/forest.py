"""Near duplicates by an LSH forest of sorted MinHash signatures.

Texts, with A-Z lowered, become sets of distinct shingles of SHINGLE words; two
link when their Jaccard similarity is at least PERCENT / 100.  Links are confirmed
on the full sets, so none is wrong; components take the smallest doc_id.

1. Equal sets are folded into one class (128 bits of a digest) with a number of
   its own; copies take their class's component.
2. Each class has TREES labels of DEPTH minima under independent hashes, and a
   sketch of one bit of each.  Classes with the same first LEAST minima in a tree
   are a region; regions of one class are dropped.
3. Every tree is sorted by label, over all its regions at once by ranges, so that a
   region of any size is spread over tasks.  Neighbours in that order have the
   longest common prefix: each class takes the closest of those before it and a
   centre, that is the class that a run's majority of sketch bits is nearest to, of
   all trees' centres the one that most classes meet, or that one's own centre
   among centres.  These links join what is dense: two pairs a class.
4. What is still in different components of a region is compared in full: all
   outside a region's largest component with all in others.  Depth adapts to the
   region: one with more than ROOM classes is cut at the next minimum, and its parts
   again, down to DEPTH.

A pair's size bound and sketch decide whether it is confirmed.  In groups where all
are near one text but few near each other, pairs would be as many as the group's
square; so where the full sets of a class and its centre were compared, what the one
has and the other has not is kept as two bitmaps.  Of two classes with the same
centre they bound the overlap from above, and pairs that can't link by that bound
are not confirmed.  Of two texts with
similarity 0.8, the chance to share no region is (1 - 0.8 ** 4) ** 40 = 7e-10 where
regions are small, (1 - 0.8 ** 5) ** 40 = 1e-7 and (1 - 0.8 ** 6) ** 40 = 5e-6 where
they are cut once and twice; the sketch (of 240 bits, at most FAR may differ where
24 are expected) fails once in 1e7.  Nothing else is left out.

Cases.  Null, empty and blank texts have the empty set and link with nothing.
Texts with fewer words than a shingle have their whole word sequence as the one
shingle.  Repeated rows give a row each; rows of one id with different texts are
judged by their own texts; rows with a null id are counted, but their component is
null and they link nothing.  Other columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from ..store import cut, few_per_batch, forget
from .components import components
from .hot import hot_keys, join_around
from .jaccard_join import set_key, shingles
from .substrings import list_column, repeated

SHINGLE, PERCENT = 2, 80
TREES, DEPTH, LEAST, ROOM = 40, 6, 4, 64
#: Bits of a sketch that may differ, of TREES * DEPTH: 6 deviations above what a similarity of 0.8 lets expect.
FAR = 52
#: Words of a sketch, and rows of a run that choose a centre together.
PARTS, BLOCK, LONE = 4, 2048, 8
#: Bits of a bitmap of differences, in words of 64.
SPREAD = 8
#: Pairs of sets in a batch for Python.
SETS = 500
U32, U64 = np.uint32, np.uint64
LONG_ROWS = 2048


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of 64-bit shingles, taken in pieces of bounded size."""
    low, high = (s & U64(0xFFFFFFFF)).astype(U32), (s >> U64(32)).astype(U32)
    best = np.full(len(a), 0xFFFFFFFF, U32)
    for i in range(0, len(s), LONG_ROWS):
        with np.errstate(over="ignore"):
            np.minimum(best, (low[i : i + LONG_ROWS, None] * a + high[i : i + LONG_ROWS, None] * b).min(axis=0), out=best)
    return best


def labels(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of TREES * DEPTH minima to region keys and deeper values (a column a tree), and PARTS words of sketch."""
    rows = len(m)
    trees = words.mix(m.astype(U64).reshape(rows, TREES, DEPTH))
    key = np.full((rows, TREES), 1, U64) * words.constants(TREES, 500)
    for j in range(LEAST):
        key = words.mix(key ^ trees[:, :, j])
    deep = np.zeros((rows, TREES), U64)
    for j in range(LEAST, DEPTH):
        deep = (deep << U64(16)) | (trees[:, :, j] >> U64(48))
    bits = (trees.reshape(rows, TREES * DEPTH) >> U64(17)).astype(np.uint8) & 1
    packed = np.packbits(np.pad(bits, ((0, 0), (0, PARTS * 64 - bits.shape[1]))), axis=1)
    return key.view(np.int64), deep.astype(np.int32), np.ascontiguousarray(packed).view(np.int64)


def scan(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, key, and for sets with shingles: g (regions), r (deeper values), w (sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = words.mix(np.arange(1, TREES * DEPTH + 1, dtype=U64) * U64(0xD1B54A32D192ED03))
        a, b = (pair & U64(0xFFFFFFFF)).astype(U32) | U32(1), (pair >> U64(32)).astype(U32) | U32(1)
        for sub, data, offsets in words.runs(batches):
            sets = shingles(data, offsets, n)
            g, r, w = labels(np.stack([minima(s, a, b) for s in sets]))
            some = np.array([len(s) > 0 for s in sets])

            def lists(x: np.ndarray, kind: pa.DataType, some: np.ndarray = some) -> pa.Array:
                sizes = np.where(some, x.shape[1], 0)
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(x[some].ravel(), kind))

            yield pa.RecordBatch.from_arrays(
                [sub.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s).hex() for s in sets]), lists(g, pa.int64()), lists(r, pa.int32()), lists(w, pa.int64())],
                ["doc_id", "n_shingles", "key", "g", "r", "w"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, key string, g array<long>, r array<int>, w array<long>")


def whole_sets(cands: DataFrame, n: int) -> DataFrame:
    """Candidate texts (id, key, text) to id, n, s; a class once, whatever the rows of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sub, data, offsets in words.runs(batches):
            sets, keys = shingles(data, offsets, n), sub.column(1).to_pylist()
            ok = np.array([set_key(s).hex() == k for s, k in zip(sets, keys, strict=True)])  # not another text under the same doc_id
            sets = [s for s, o in zip(sets, ok, strict=True) if o]
            flat = np.concatenate(sets) if sets else np.zeros(0, U64)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([sub.column(0).filter(pa.array(ok)), pa.array(sizes), list_column(flat.view(np.int64), np.concatenate([[0], np.cumsum(sizes)]))], ["id", "n", "s"])

    return cands.select("id", "key", "text").mapInArrow(run, "id long, n long, s array<long>").dropDuplicates(["id"])


def may_link(n: str, m: str) -> Column:
    """Whether sets of n and m shingles can link at all."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def apart(left: str, right: str) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.element_at(left, i).bitwiseXOR(F.element_at(right, i))) for i in range(2, PARTS + 1)), F.bit_count(F.element_at(left, 1).bitwiseXOR(F.element_at(right, 1))))


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * SPREAD, np.uint8)
    bits[(words.mix(s) % U64(64 * SPREAD)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def common_at_most(left: str, right: str, which: str) -> Column:
    """A bound on the common elements of two sets by their bitmaps: positions that both use, and what the fuller positions of one may hide."""
    both = [F.bit_count(F.element_at(f"{left}.{which}", i).bitwiseAND(F.element_at(f"{right}.{which}", i))) for i in range(1, SPREAD + 1)]
    return sum(both[1:], both[0]) + F.least(f"{left}.{which}_hidden", f"{right}.{which}_hidden")


def may_overlap(left: str, right: str, n: str, m: str) -> Column:
    """Whether two classes can link, for all that their differences from one centre tell; true if they have not the same centre.

    Of the centre, all is common but what either lacks; of the rest, what both have added."""
    common = F.col(f"{left}.size") - F.col(f"{left}.lacks_n") - F.col(f"{right}.lacks_n") + common_at_most(left, right, "lacks") + common_at_most(left, right, "adds")
    told = (F.col(f"{left}.center") == F.col(f"{right}.center")) & ((100 + PERCENT) * common < PERCENT * (F.col(n) + F.col(m)))
    return ~F.coalesce(told, F.lit(False))


def sorted_runs(members: DataFrame) -> DataFrame:
    """members (g, r, id, n, w) in order of all trees to pairs (id, other, kind, far): of neighbours in a run (kind 0), and of a run's members with its centre (kind 1).

    Runs are cut where ranges or batches end; what that leaves out is compared later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            g, ids, n = (batch.column(i).to_numpy() for i in (0, 2, 3))
            w = np.asarray(batch.column(4).flatten()).view(U64).reshape(-1, PARTS)
            if carry is not None:
                g, ids, n, w = (np.concatenate([c, x]) for c, x in zip(carry, (g, ids, n, w), strict=True))
            if not len(g):
                continue
            carry = g[-1:], ids[-1:], n[-1:], w[-1:]
            at = np.flatnonzero(g[1:] == g[:-1]) + 1
            left, right, kind = [at], [at - 1], [np.zeros(len(at), np.int32)]
            edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for i in range(a, z, BLOCK):
                    j = min(i + BLOCK, z)
                    if j - i < LONE:
                        continue
                    bits = np.unpackbits(w[i:j].view(np.uint8), axis=1)
                    common = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > j - i).view(U64)
                    center = i + int(np.bitwise_count(w[i:j] ^ common).sum(axis=1).argmin())
                    rest = np.setdiff1d(np.arange(i, j), [center])
                    left.append(rest)
                    right.append(np.full(len(rest), center))
                    kind.append(np.ones(len(rest), np.int32))
            x, y, kind = np.concatenate(left), np.concatenate(right), np.concatenate(kind)
            far = np.bitwise_count(w[x] ^ w[y]).sum(axis=1).astype(np.int32)
            ok = (far <= FAR) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])) & (ids[x] != ids[y])
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[ok]]), pa.array(ids[y[ok]]), pa.array(kind[ok]), pa.array(far[ok])], ["id", "other", "kind", "far"])

    order = ["g", "r", "id"]
    found = members.select("g", "r", "id", "n", "w").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "id long, other long, kind int, far int")
    return cut(found, "runs")


def chosen(found: DataFrame) -> DataFrame:
    """id, other: of the centres that a class meets the one that most meet."""
    rows = found.where("kind = 1").select("id", "other")
    votes = rows.groupBy("other").agg(F.count("*").alias("votes"))
    voted = join_around(rows, votes, "other", hot_keys(rows, "other", F.col("id")))
    return voted.groupBy("id").agg(F.max(F.struct("votes", (-F.col("other")).alias("minus"))).alias("best")).select("id", (-F.col("best.minus")).alias("other"))


def neighbours(members: DataFrame) -> DataFrame:
    """Pairs (id, other, kind): per class the closest neighbour before it in any tree (kind 0) and a centre (kind 1).

    A large region has a centre for each piece of it that a task has seen, so the
    centres are sorted among themselves once more and have centres of their own; a
    group's members then name the same one, however many tasks have dealt with them."""
    found = sorted_runs(members)
    near = found.where("kind = 0").groupBy("id").agg(F.min(F.struct("far", "other")).alias("best")).select("id", F.col("best.other").alias("other"), F.lit(0).alias("kind"))
    first = cut(chosen(found), "centers")
    few = members.join(first.select(F.col("other").alias("id")).distinct(), "id", "left_semi").select("g", "r", "id", "n", "w")
    over = chosen(sorted_runs(few)).select(F.col("id").alias("other"), F.col("other").alias("over"))
    centers = join_around(first, over, "other", hot_keys(first, "other", F.col("id")), "left").select("id", F.coalesce("over", "other").alias("other"), F.lit(1).alias("kind"))
    return near.unionByName(centers.where("id != other"))


def adapted(mixed: DataFrame) -> DataFrame:
    """mixed (g, r, ...) with g as deep as its region's size asks for."""
    next_g = F.xxhash64("g", F.shiftright("r", 16))
    first = mixed.groupBy("g").agg(F.count("*").alias("n0")).where(F.col("n0") > ROOM)
    second = mixed.groupBy(next_g.alias("g1")).agg(F.count("*").alias("n1")).where(F.col("n1") > ROOM)
    hot = hot_keys(mixed, "g", F.col("id"))
    cut_once = join_around(mixed, first, "g", hot, "left").withColumn("g1", F.when(F.col("n0").isNotNull(), next_g))
    cut_twice = cut_once.where("g1 is not null").drop("n0")
    deep = join_around(cut_twice, second, "g1", hot_keys(cut_twice, "g1", F.col("id")), "left")
    deep = deep.withColumn("g", F.when(F.col("n1").isNotNull(), F.xxhash64("g1", "r")).otherwise(F.col("g1"))).drop("g1", "n1")
    return cut_once.where("g1 is null").drop("g1", "n0").unionByName(deep)


def across(members: DataFrame, labelled: DataFrame, judged: DataFrame) -> DataFrame:
    """Pairs (id, other) in one region and different components that size, sketch and differences from a centre allow."""
    parts = ["center", "size", "lacks", "lacks_n", "lacks_hidden", "adds", "adds_hidden"]
    near = judged.where("kind = 1").select(F.col("id").alias("__id"), F.struct(F.col("other").alias("center"), *parts[1:]).alias("x"))

    def split(rows: DataFrame) -> DataFrame:
        """Rows of regions with several components, with the largest of them as top."""
        sizes = rows.groupBy("g", "c").agg(F.count("*").alias("m")).groupBy("g").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count("*").alias("cs"))
        return join_around(rows, sizes.where("cs > 1").select("g", "top"), "g", hot_keys(rows, "g", F.col("id")))

    rows = members.join(labelled, members["id"] == labelled["node"], "left").select("g", "r", "id", "n", "w", F.coalesce("component", "id").alias("c"))
    rows = rows.join(near, rows["id"] == near["__id"], "left").drop("__id")
    mixed = cut(split(rows).drop("top"), "mixed")
    cands = cut(split(adapted(mixed)), "regions")
    forget(mixed)
    # a pair is taken where it first meets: in the least of the regions that both are in
    own = cut(cands.groupBy("id").agg(F.collect_list("g").alias("regions")).withColumnRenamed("id", "__id"), "own")
    rows = cands.join(own, cands["id"] == own["__id"]).drop("__id")
    few = rows.where("c != top").select("g", "id", "n", "w", "c", "x", "regions")
    other = rows.select("g", F.col("id").alias("other"), F.col("n").alias("m"), F.col("w").alias("v"), F.col("c").alias("d"), F.col("x").alias("y"), (F.col("c") == F.col("top")).alias("in_top"), F.col("regions").alias("others"))
    # of two outside the largest component, each pair once
    once = F.col("in_top") | (F.col("id") < F.col("other"))
    meets = F.array_min(F.array_intersect("regions", "others")) == F.col("g")
    pairs = few.join(other, "g").where((F.col("c") != F.col("d")) & once & may_link("n", "m") & (apart("w", "v") <= FAR) & may_overlap("x", "y", "n", "m") & meets).select("id", "other")
    out = cut(pairs.distinct(), "pairs")
    for df in (cands, own):
        forget(df)
    return out


JUDGED = "id long, other long, kind int, linked boolean, size int, lacks array<long>, lacks_n int, lacks_hidden int, adds array<long>, adds_hidden int"


def judge(rows: DataFrame) -> DataFrame:
    """Pairs with both sets (id, other, kind, s, t) to JUDGED: whether they link, and what s lacks of t and adds to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, t in zip(batch.column(3), batch.column(4), strict=True):
                s, t = np.asarray(s.values).view(U64), np.asarray(t.values).view(U64)
                lacks, adds = np.setdiff1d(t, s, assume_unique=True), np.setdiff1d(s, t, assume_unique=True)
                common = len(t) - len(lacks)
                a, b = bitmap(lacks), bitmap(adds)
                hidden = [len(x) - int(np.bitwise_count(y.view(U64)).sum()) for x, y in ((lacks, a), (adds, b))]
                out.append((100 * common >= PERCENT * (len(s) + len(t) - common), len(t), a.tolist(), len(lacks), hidden[0], b.tolist(), hidden[1]))
            kinds = [pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32()]
            columns = [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], [c.split(" ")[0] for c in JUDGED.split(", ")])

    return rows.select("id", "other", "kind", "s", "t").mapInArrow(run, JUDGED)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Pairs (id, other, kind) judged by their full sets."""
    pairs = cut(pairs.select("id", "other", "kind"), "pairs")
    named = pairs.select("id").union(pairs.select(F.col("other").alias("id"))).distinct().join(classes.select("id", "doc_id", "key"), "id")
    sets = cut(whole_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(named, "doc_id"), n), "sets")
    # the side with ever new classes first, then the one where a centre stands in many pairs
    one = pairs.join(sets, "id").select("id", "other", "kind", "s")
    two = sets.select(F.col("id").alias("other"), F.col("s").alias("t"))
    with few_per_batch(docs.sparkSession, SETS):
        out = cut(judge(join_around(one, two, "other", hot_keys(pairs, "other", F.col("id")))), "judged")
    for df in (pairs, sets):
        forget(df)
    return out


def dedup(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    scanned = cut(scan(docs, n), "scan")
    folded = scanned.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min(F.struct("g", "r", "w")).alias("x"))
    # numbered once and written, so that the numbers stay
    classes = cut(folded.select(F.monotonically_increasing_id().alias("id"), "key", "doc_id", F.col("n").cast("int").alias("n"), "x.g", "x.r", "x.w"), "classes")
    trees = classes.select("id", F.posexplode("g").alias("t", "g"))
    shared = repeated(trees, ["g"], "id").select("id", "g", "t")
    members = cut(shared.join(classes.select("id", "n", "r", "w"), "id").select("g", F.element_at("r", F.col("t") + 1).alias("r"), "id", "n", "w"), "members")

    first = confirmed(neighbours(members), classes, docs, n)
    links = first.where("linked").select(F.col("id").alias("a"), F.col("other").alias("b"))
    found = components(links)
    rest = across(members, found, first)
    if not rest.isEmpty():
        late = confirmed(rest.withColumn("kind", F.lit(2)), classes, docs, n)
        more = late.where("linked").select(F.col("id").alias("a"), F.col("other").alias("b"))
        if not more.isEmpty():
            found = components(links.union(more))
    forget(members)

    linked = cut(classes.select("id", "key", "doc_id").join(found, classes["id"] == found["node"]).select("key", "doc_id", "component"), "linked")
    lowest = linked.groupBy("component").agg(F.min("doc_id").alias("low"))
    low = join_around(linked, lowest, "component", hot_keys(linked, "component", F.col("key"))).select("key", "low")
    named = classes.select("key", "doc_id").join(low, "key", "left").select("key", F.coalesce("low", "doc_id").alias("component"))
    slim = scanned.select("doc_id", "n_shingles", "key")
    out = join_around(slim, named, "key", hot_keys(slim, "key", F.col("doc_id")), "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
