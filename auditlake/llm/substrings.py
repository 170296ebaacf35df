"""Substring dedup by level-wise doubling.

A word is removed if a window of WINDOW words covers it whose word sequence also
starts in a document with a smaller id.  Short windows are counted first; only
what is repeated at one length is extended to twice that length, up to the
window asked for, or until no candidate survives.

The lengths are START, twice that, and so on, the last one WINDOW.  Below the last length a window of WINDOW words is stood for by its anchor: of
the shorter windows inside it, the one with the smallest hash.  Equal windows
have equal anchors, so a window can only repeat if its anchor does, and a
fraction of all positions is shuffled.  Documents with equal words are folded
into the one with the smallest id before anything is extended; the others lose
all words without being looked at.

Anchors are compared by 64-bit hashes, which can only add candidates; the last
length is compared by 128 bits.

Cases.  Null and empty texts have no words.  A row with a null id loses nothing
and takes nothing from others.  Rows with one id are judged one by one; equal
ids are not smaller.  Other columns are ignored.  Texts shorter than a window
stay whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .hot import folded, hot_keys, join_around
from ..store import cut, forget

WINDOW, START = 13, 4
U64 = words.U64
NOTHING = hashlib.sha256(b"").hexdigest()


def lengths(window: int, start: int) -> list[int]:
    """start, twice start, ... , window."""
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def joined(raw: bytes) -> bytes:
    return b" ".join(raw.split())


def text_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def anchors(h: np.ndarray, first: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, the position of each one's anchor, and the hashes of all runs of ``length`` words."""
    g = words.ngrams(h, length, 40 + length)
    at = np.flatnonzero(words.inside(first, window, len(h)))
    best, where = g[at], at.copy()
    for j in range(1, window - length + 1):
        other = g[at + j]
        less = other < best
        best = np.where(less, other, best)
        where = np.where(less, at + j, where)
    return at, where, g


def list_column(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values.astype(np.int64)))


def scan(docs: DataFrame, window: int, length: int) -> DataFrame:
    """doc_id, n_words, sha (of the words), k (64 bits of it) and the hashes of the first length's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sub, data, offsets in words.runs(batches):
            found, raw = words.find_words(data, offsets), data.tobytes()
            sha = [hashlib.sha256(joined(raw[a:z])) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            _, where, g = anchors(found.hashes(), found.first, length, window)
            where = np.unique(where)
            yield pa.RecordBatch.from_arrays(
                [sub.column(0), pa.array(found.counts), pa.array([s.hexdigest() for s in sha], pa.string()), pa.array([text_key(s.digest()) for s in sha], pa.int64()), list_column(g[where].view(np.int64), np.searchsorted(where, found.first))],
                ["doc_id", "n_words", "sha", "k", "h"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, sha string, k long, h array<long>")


def repeated(rows: DataFrame, by: list[str], who: str) -> DataFrame:
    """Rows whose key ``by`` has more than one ``who``, with the least of these; a key's rows are summed up before they are shuffled, and those of a hot key dealt over many tasks."""
    alive = rows.groupBy(*by).agg(F.min(who).alias("least"), F.max(who).alias("most")).where("least < most").drop("most")
    return join_around(rows, alive, by, hot_keys(rows, by[0], F.col(who)))


def extend(cands: DataFrame, before: int, length: int, window: int) -> DataFrame:
    """Candidate documents (doc_id, k, text, h of the length before) to rows doc_id, k, at, g, g2 of windows of ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sub, data, offsets in words.runs(batches):
            found, raw = words.find_words(data, offsets), data.tobytes()
            h = found.hashes()
            at, where, g = anchors(h, found.first, before, window)
            doc, old = found.doc(), sub.column(sub.schema.get_field_index("h"))
            ids, keys = sub.column(0), np.array(sub.column(1))
            ok = np.zeros(len(at), bool)
            borders = np.searchsorted(at, found.first)
            for i in range(sub.num_rows):
                a, z = borders[i], borders[i + 1]
                if a < z and text_key(hashlib.sha256(joined(raw[offsets[i] : offsets[i + 1]])).digest()) == keys[i]:
                    ok[a:z] = np.isin(g[where[a:z]], np.array(old[i].values).view(U64))
            if length == window:
                keep = at[ok]
            else:
                _, where, _ = anchors(h, found.first, length, window)
                keep = np.unique(where[ok])
            g, g2 = words.ngrams(h, length, 40 + length)[keep], words.ngrams(found.hashes(seed=21), length, 90)[keep] if length == window else np.zeros(len(keep), U64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[keep])), pa.array(keys[doc[keep]]), pa.array((keep - found.first[doc[keep]]).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(g2.view(np.int64))], ["doc_id", "k", "at", "g", "g2"])

    return cands.select("doc_id", "k", "text", "h").mapInArrow(run, "doc_id long, k long, at int, g long, g2 long")


def remove(cands: DataFrame, window: int) -> DataFrame:
    """doc_id, k, n_removed, kept_sha256, kept of documents (doc_id, k, text, at: starts of windows to remove)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sub, data, offsets in words.runs(batches):
            raw, out = data.tobytes(), []
            for i, (k, starts) in enumerate(zip(sub.column(1).to_pylist(), sub.column(3), strict=True)):
                found = raw[offsets[i] : offsets[i + 1]].split()
                if text_key(hashlib.sha256(b" ".join(found)).digest()) != k:
                    continue  # another text under the same id
                cover = np.zeros(len(found) + 1, np.int64)
                starts = np.unique(np.array(starts.values))
                cover[starts] += 1
                cover[starts + window] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                kept = b" ".join([w for w, g in zip(found, gone.tolist(), strict=True) if not g])
                out.append((sub.column(0)[i].as_py(), k, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            names = ["doc_id", "k", "removed", "kept_sha", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names)

    return cands.select("doc_id", "k", "text", "at").mapInArrow(run, "doc_id long, k long, removed long, kept_sha string, kept string")


def dedup(docs: DataFrame, window: int = WINDOW, start: int = START, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with ``texts`` kept (null where nothing was removed)."""
    steps = lengths(window, start)
    scanned = cut(scan(docs, window, steps[0]).withColumn("row", F.monotonically_increasing_id()), "scan")
    slim = scanned.select("doc_id", "n_words", "sha", "k")
    own = slim.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    reps = slim.where(f"n_words >= {window} and doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.min("k").alias("k")).select("doc_id", "k")
    # a text that thousands of documents have puts its anchors down once
    rows = folded(scanned.where("doc_id is not null"), "sha", "row").select("k", F.explode("h").alias("g"))
    # written before texts are shuffled, so that the shuffles of anchors are gone by then
    found = cut(repeated(rows, ["g"], "k").groupBy("k").agg(F.collect_set("g").alias("h")), "anchors")
    cands = cut(docs.select(F.col("doc_id").cast("long"), "text").join(found.join(reps, "k"), "doc_id").select("doc_id", "k", "text", "h"), "candidates")
    forget(found)
    for before, length in zip(steps, steps[1:], strict=False):
        if cands.isEmpty():  # nothing is left to be extended
            length = window
        rows = cut(extend(cands, before, length, window), f"windows{length}")
        if length == window:
            break
        found = cut(repeated(rows, ["g"], "k").groupBy("doc_id", "k").agg(F.collect_set("g").alias("h")), "anchors")
        forget(rows)
        longer = cut(cands.drop("h").join(found, ["doc_id", "k"]).select("doc_id", "k", "text", "h"), "candidates")
        forget(cands)
        forget(found)
        cands = longer
    if len(steps) == 1:  # the window itself was the first length
        rows = cut(extend(cands, window, window, window), "windows")
    # texts are read from docs again, so that no copy of them lies beside the shuffles of windows
    forget(cands)
    late = cut(repeated(rows, ["g", "g2"], "doc_id").where("doc_id > least").groupBy("doc_id", "k").agg(F.collect_set("at").alias("at")), "late")
    forget(rows)
    changed = remove(docs.select(F.col("doc_id").cast("long"), "text").join(late, "doc_id").select("doc_id", "k", "text", "at"), window)
    # repeated rows are one row here, or the join below would multiply them
    changed = cut((changed if texts else changed.drop("kept")).dropDuplicates(["doc_id", "k"]), "removed")
    forget(late)
    copy = F.col("doc_id") > F.col("first_id")
    out = join_around(slim, own, "sha", hot_keys(slim, "sha", F.col("doc_id")), "left").join(changed, ["doc_id", "k"], "left")
    whole = copy & (F.col("n_words") >= window)
    return out.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
