"""Quality rules: hashed word and character n-gram logistic regression.

A model is trained on labelled rows, calibrated on rows held out of training,
and applied in Arrow batches against fixed thresholds, after a few counting
rules (`base`).

Cases.  Null and empty texts have no words: all counts 0, base_failed, not
kept.  Repeated rows and repeated ids give one result row for each input row.
Null ids stay null.  Labels that are null or neither 0 nor 1 are left out, of
several labels of a document the smallest counts, and with fewer than two kinds
of label left the counting rules decide alone.  Columns of the input that have
the name of a result column are replaced by it.  An empty table gives an empty
result with the same columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logistic, words

#: Labelled rows to train on, chosen by a hash of the id: the only sample.
TRAIN_ROWS = 2500
BUCKETS = 1 << 14
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"[#*$%&|<>]"[1:-1], np.uint8))
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.float64 if mask.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray, found: words.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features: buckets, and the border of each document in them.

    Character 3- and 5-grams (of code points) and word 1- and 2-grams.
    """
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(words.U64)
    edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    hashed = found.hashes()
    for base, first, n, seed in ((chars, edges, 3, 31), (chars, edges, 5, 32), (hashed, found.first, 1, 33), (hashed, found.first, 2, 34)):
        grams = words.ngrams(base, n, seed)
        bucket = (grams & words.U64(BUCKETS - 1)).astype(np.int32)
        ends = np.maximum(first[1:] - n + 1, first[:-1])
        yield bucket, np.stack([first[:-1], ends])


def base(data: np.ndarray, offsets: np.ndarray, found: words.Words) -> dict[str, np.ndarray]:
    """The counts of the rules, for each document."""
    n, h, counts = 5, found.hashes(seed=3), found.counts
    lead = (data & 0xC0) != 0x80
    grams, doc = words.ngrams(h, n, 11), found.doc()
    at = np.flatnonzero(words.inside(found.first, n, len(h)))
    with np.errstate(over="ignore"):
        key = grams[at] ^ words.mix(doc[at].astype(words.U64) + words.U64(77))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + n, -1)
    repeated = sums(np.cumsum(cover[:-1]) > 0, found.first)
    raw, dup = data.tobytes(), np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(np.diff(offsets)):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": counts, "word_chars": sums(lead & ~words.IS_SPACE[data], offsets), "n_symbols": sums(SYMBOL[data], offsets),
        "n_dup_lines": dup, "n_repeat_words": repeated, "base_failed": (counts < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * counts),
    }


def sparse(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and values, for training: shares of each kind's n-grams."""
    found = words.find_words(data, offsets)
    rows: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in offsets[1:]]
    for kind, (bucket, (a, z)) in enumerate(features(data, offsets, found)):
        for i in range(len(rows)):
            idx, count = np.unique(bucket[a[i] : z[i]], return_counts=True)
            rows[i].append((idx + kind * BUCKETS, count * (100.0 / max(1, z[i] - a[i]))))
    return [(np.concatenate([i for i, _ in r]), np.concatenate([v for _, v in r])) for r in rows]


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int, which=None) -> DataFrame:
    """At most ``most`` rows (doc_id, text, y), one an id, of the ids with the smallest hashes; of an id's texts that with the least hash.  The ids are few by that bound, so they are broadcast."""
    chosen = labels.select("doc_id", F.col(column).alias("y")).where("y in (0, 1) and doc_id is not null")
    if which is not None:
        chosen = chosen.where(which)
    chosen = chosen.groupBy("doc_id").agg(F.min("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("y").alias("y"))


def vectors(rows: DataFrame, make) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features of labelled rows, made on the executors and sent packed: steps between indices, and values, deflated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sub, data, offsets in words.runs(batches):
            got = make(data, offsets)
            yield pa.RecordBatch.from_arrays([sub.column(0), sub.column(2), pa.array([zlib.compress(np.diff(i.astype("<i4"), prepend=np.int32(0)).astype("<i4").tobytes(), 1) for i, _ in got], pa.binary()), pa.array([zlib.compress(v.astype("<f4").tobytes(), 1) for _, v in got], pa.binary())], ["doc_id", "y", "i", "v"])

    got = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, i binary, v binary").collect()
    got.sort(key=lambda r: (r.doc_id * 0x9E3779B1 % (1 << 32), r.doc_id, r.i))
    return [(np.cumsum(np.frombuffer(zlib.decompress(r.i), "<i4"), dtype=np.int32), np.frombuffer(zlib.decompress(r.v), "<f4")) for r in got], np.array([r.y for r in got])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> logistic.Linear | None:
    x, y = vectors(labelled(docs, labels, "quality", rows), sparse)
    model = logistic.train(x, y, 4 * BUCKETS) if len(set(y)) == 2 else None
    del x, y
    logistic.give_back()
    return model


def judge(docs: DataFrame, model: logistic.Linear | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the columns COLUMNS."""
    keep = [c for c in docs.columns if c not in NAMES]
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sub, data, offsets in words.runs(batches):
            found = words.find_words(data, offsets)
            out = base(data, offsets, found)
            p = np.ones(sub.num_rows)
            if model is not None:
                raw = np.zeros(sub.num_rows)
                for kind, (bucket, (a, z)) in enumerate(features(data, offsets, found)):
                    total = np.concatenate([[0.0], np.cumsum(model.weights[kind * BUCKETS : (kind + 1) * BUCKETS][bucket], dtype=np.float64)])
                    m = len(bucket)
                    raw += 100.0 * (total[np.minimum(z, m)] - total[np.minimum(a, m)]) / np.maximum(1, z - a)
                p = model.probability(raw)
            out |= {"p_good": p, "kept": ~out["base_failed"] & (p >= threshold)}
            yield pa.RecordBatch.from_arrays([*sub.columns, *(pa.array(out[c]) for c in NAMES)], [*sub.schema.names, *NAMES])

    assert at >= 0
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keep).schema) + ", " + COLUMNS
    return docs.select(keep).mapInArrow(run, schema)


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on the labelled documents and judges all documents."""
    return judge(docs, train(docs, labels))
