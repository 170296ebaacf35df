"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. A character language model (trigrams over a fixed alphabet of 64 classes) is
   counted over all documents; its size does not grow with them.
2. Segments that may be disguised (every token with a letter and a look-alike,
   spaced-out letters and look-alikes, letters repeated three times or more)
   become character lattices; Viterbi decoding under the model picks the
   likeliest reading.  A word of plain letters has a lattice of one path and
   passes as it is.  Not part of a token: !, | and ( at its end, three or more
   equal signs there, and an opening bracket before it that is closed later.
   E-mail addresses and host names are no disguise.
3. Word-initial and whole-word features of the restored text, their share and
   whether they are there at all, are scored by a logistic regression, which is
   calibrated by a rising step function of its scores of rows left out in turn:
   a few wrong labels then move no threshold, as they would a fitted curve.

Cases.  Null and empty texts restore to '' and get the score of a text without
features.  Every row gives one row, repeated ids too.  Null labels are left
out; without both labels every score is 0.  A null id is in no held-out fold.  Input columns with the name of a
result column are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logistic, words
from .quality import labelled, sums, vectors

#: Labelled rows to train on, chosen by a hash of the id: the only sample.
TRAIN_ROWS = 6000
BUCKETS = 1 << 18
#: Features kept for the model: those whose presence differs most between the labels, by a two-sample z of at least MIN_Z.
KEPT_FEATURES, MIN_Z = 400, 4.5
CLASSES = 64
#: Characters that stand for letters, with their readings.
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Log costs of the channel: writing a letter as a look-alike, putting a separator inside a word, repeating a letter.
SWAP, SEPARATE, REPEAT, LITERAL = -2.5, -0.3, -0.7, -9.0
#: Characters between two looks for what is settled in a long segment, and the longest segment worth remembering.
SETTLE, REMEMBERED = 1024, 100
#: A letter; signs that may stand for one; what stands alone in a spaced word.
LETTER, SIGN = r"[^\W\d_]", "@$!|+(€"
ALONE = rf"(?:{LETTER}|[{SIGN}013-57-9])"
#: Host names end in one of these; other words with a full stop between them are two words.
DOMAIN = r"(?:(?<=\.(?:co|io|ai|me|tv|eu|us|uk|de|fr|es|it|nl|ch|at|be|pl|se|no|dk|fi|ru|cn|jp|br|in|au|ca))|(?<=\.(?:com|org|net|edu|gov|biz|app|dev|xyz))|(?<=\.info))"
DISGUISED = re.compile(
    rf"(?<![^\W_])(?:(?P<spaced>(?<![{SIGN}]){ALONE}([ .\-_*])(?:{ALONE}\2)+(?:{LETTER}|[@$+€013-57-9])(?![^\W_]|[@$+€]))"  # i d 1 0 t
    rf"|(?P<address>(?<![\w.%+@-])[{SIGN}]*+(?:[\w.%+-]++@[\w-]+(?:\.[\w-]+)+|[\w-]++(?:\.[\w-]++)++{DOMAIN}))"
    rf"|(?P<token>(?<![{SIGN}])(?:(?![0-9])|(?<![0-9][.,]))(?=[{SIGN}0-9]*+{LETTER})(?={LETTER}*+[{SIGN}0-9])(?:{LETTER}++|[{SIGN}0-9]++)++)"  # 1d10t
    rf"|\b{LETTER}*(?P<again>{LETTER})(?P=again)(?P=again){LETTER}*\b)"  # idiiiot
)
REPEATED = re.compile(rf"\b{LETTER}*({LETTER})\1\1{LETTER}*\b")
DISGUISE = re.compile(rf"(?=.*{LETTER}).*[{SIGN}0-9]", re.S)
BRACKET = re.compile(r"[()]")
FOLD = "crc32(cast(doc_id as string)) % 5"


def classes(chars: np.ndarray) -> np.ndarray:
    """Classes of code points: 0 for all but letters, 1-26 a-z, 27-59 U+00DF-U+00FF, 60 other letters from U+0100."""
    table = np.zeros(256, np.int64)
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    table[0xDF:0x100] = np.arange(27, 60)
    table[0xC0:0xDF] = table[0xE0:0xFF]
    return np.where(chars < 256, table[np.minimum(chars, 255)], 60)


class CharModel:
    """log P(c | a, b) from trigram counts, interpolated with bigrams and single characters."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        c = np.zeros(CLASSES**3)
        c[codes] = counts
        c = c.reshape(CLASSES, CLASSES, CLASSES)
        uni = c.sum((0, 1)) + 1
        bi = c.sum(0) + 5 * uni / uni.sum()
        bi /= bi.sum(1, keepdims=True)
        tri = c + 5 * bi[None]
        self.log = np.log(tri / tri.sum(2, keepdims=True)).astype(np.float32)
        self.table: list[float] = []

    def __call__(self, a: int, b: int, c: int) -> float:
        if not self.table:  # made where it is used, so that only the array is sent to tasks
            self.table = self.log.ravel().tolist()
        return self.table[(a * CLASSES + b) * CLASSES + c]


def count_trigrams(docs: DataFrame) -> CharModel:
    """Counts over whole texts of all documents: at most CLASSES ** 3 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for _, data, offsets in words.runs(batches):
            chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            k = classes(chars)
            code = (k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:]
            total += np.bincount(code[(k[1:-1] > 0) | (k[2:] > 0)], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    got = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return CharModel(np.array([r.code for r in got], np.int64), np.array([r.n for r in got], float))


def lattice(segment: str) -> Iterator[list[tuple[str, float]]]:
    """For each character the readings, '' for one that is noise, with their log costs."""
    before, low = "", segment.lower()
    for i, c in enumerate(low):
        if c.isalpha():
            run = c * 3 in low[max(0, i - 2) : i + 3]
            yield [(c, 0.0), ("", REPEAT)] if c == before and run else [(c, 0.0)]
        elif c in LOOKALIKE:
            yield [(x, SWAP) for x in LOOKALIKE[c]] + [(c, LITERAL)]
        else:
            yield [("", SEPARATE), (c, LITERAL)]
        before = c


@lru_cache(1 << 16)
def class_of(char: str) -> int:
    return int(classes(np.array([ord(char)]))[0])


def read_back(trail: list[dict], at: tuple) -> str:
    out = []
    for step in reversed(trail):
        at, x = step[at]
        out.append(x)
    return "".join(reversed(out))


def decode(segment: str, model: CharModel) -> str:
    """The likeliest reading of a segment of any length; states are the last two classes and the last letter.

    After SETTLE characters or more, what all paths have in common is written out, so that long segments need little memory."""
    best = {(0, 0, ""): 0.0}
    trail, out, look = [], [], SETTLE
    for readings in lattice(segment):
        new: dict = {}
        back: dict = {}
        for state, score in best.items():
            for x, cost in readings:
                if x == "":
                    to, s = state, score + cost
                else:
                    k = class_of(x)
                    to, s = (state[1], k, x), score + cost + model(state[0], state[1], k)
                if to not in new or s > new[to]:
                    new[to], back[to] = s, (state, x)
        trail.append(back)
        best = new
        if len(trail) >= look:
            at, n = set(best), len(trail)
            while len(at) > 1 and n:
                n -= 1
                at = {trail[n][t][0] for t in at}
            if n:
                out.append(read_back(trail[:n], at.pop()))
                del trail[:n]
            look = SETTLE + 2 * len(trail)
    at = max(best, key=lambda t: (best[t] + model(t[0], t[1], 0), t))
    return "".join(out) + read_back(trail, at)


def borders(found: re.Match) -> tuple[int, int]:
    """Where in a token the word starts and ends, without the punctuation around it."""
    token = found[0]
    start, end = 0, len(token)
    if token[0] == "(":
        closing = BRACKET.search(found.string, found.end())
        if closing and closing[0] == ")":
            start = end - len(token.lstrip("("))
    while end > start:
        last = token[end - 1]
        run = end - start - len(token[start:end].rstrip(last))
        if last not in "!|(26" and (last not in SIGN or run < 3):
            break
        end -= run
    return start, end


class Restorer:
    """Restores texts; remembers up to ``most`` decoded segments of up to REMEMBERED characters, then starts afresh."""

    def __init__(self, model: CharModel, most: int = 50_000):
        self.model, self.seen, self.most = model, {}, most

    def one(self, found: re.Match) -> str:
        segment, kind = found[0], found.lastgroup
        if kind == "address":
            return REPEATED.sub(self.one, segment)
        if kind == "token":
            start, end = borders(found)
            core = segment[start:end]
            core = self.read(core) if DISGUISE.match(core) else REPEATED.sub(self.one, core)
            return segment[:start] + core + segment[end:]
        return self.read(segment) if kind != "spaced" or any(map(str.isalpha, segment)) else segment

    def read(self, segment: str) -> str:
        if len(segment) > REMEMBERED:
            return decode(segment, self.model)
        if segment not in self.seen:
            if len(self.seen) >= self.most:
                self.seen.clear()
            self.seen[segment] = decode(segment, self.model)
        return self.seen[segment]

    def __call__(self, text: str) -> str:
        return DISGUISED.sub(self.one, text)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, words.Words]:
    """Feature buckets of each distinct word of each document: word starts of 4, 5 and 6 bytes and whole words; and the borders of documents."""
    data = words.ASCII_LOWER[data]
    found = words.find_words(data, offsets)
    start, end = found.start, found.end
    letter = ~np.isin(data, np.frombuffer(bytes(range(33, 48)) + b":;<=>?@[]^_`{|}~\\", np.uint8))
    for _ in range(4):  # punctuation around words
        end = np.where((end - start > 1) & ~letter[np.maximum(end - 1, 0)], end - 1, end) if len(end) else end
        start = np.where((end - start > 1) & ~letter[start], start + 1, start) if len(start) else start
    h = words.Words(data, start, end, found.first).hashes(seed=5)
    doc = found.doc()
    with np.errstate(over="ignore"):
        _, at = np.unique(h ^ words.mix(doc.astype(words.U64) + words.U64(5)), return_index=True)
    at.sort()
    first = np.searchsorted(at, found.first)
    start, end = start[at], end[at]
    out = [(h[at] & words.U64(BUCKETS - 1)).astype(np.int64)]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in (4, 5, 6):
        part = padded[start[:, None] + np.arange(k)].astype(words.U64)
        part[np.arange(k) >= (end - start)[:, None]] = words.U64(0)
        g = words.mix((part << (np.arange(k, dtype=words.U64) * words.U64(8))).sum(1, dtype=words.U64) + words.U64(k << 56))
        out.append((g & words.U64(BUCKETS - 1)).astype(np.int64))
    return out, first, found


def sparse(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each feature twice: its share among the distinct words, and that it is there."""
    kinds, first, _ = features(data, offsets)
    out = []
    for i in range(len(first) - 1):
        a, z = first[i], first[i + 1]
        idx, val = [], []
        for k, b in enumerate(kinds):
            u, c = np.unique(b[a:z], return_counts=True)
            idx += [u + 2 * k * BUCKETS, u + (2 * k + 1) * BUCKETS]
            val += [c * (100.0 / (z - a + 20)), np.ones(len(u))]
        out.append((np.concatenate(idx), np.concatenate(val)))
    return out


def score_runs(model: logistic.Stepped | None, weights: np.ndarray | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if model is None:
        return np.zeros(len(offsets) - 1)
    kinds, first, _ = features(data, offsets)
    n, raw = np.diff(first), np.zeros(len(first) - 1)
    doc = np.repeat(np.arange(len(n)), n)
    for k, b in enumerate(kinds):
        raw += sums(weights[2 * k * BUCKETS :][b].astype(float), first) * (100.0 / (n + 20))
        there = weights[(2 * k + 1) * BUCKETS :][b]
        at = np.flatnonzero(there)  # the model keeps few features
        _, once = np.unique(doc[at] * BUCKETS + b[at], return_index=True)
        raw += np.bincount(doc[at[once]], there[at[once]].astype(float), len(n))
    return model.probability(raw)


def restored_runs(restore: Restorer, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    raw = data.tobytes()
    texts = [restore(raw[a:z].decode("utf-8", "replace")) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
    parts = [t.encode() for t in texts]
    return texts, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def train(docs: DataFrame, labels: DataFrame, chars: CharModel, rows: int = TRAIN_ROWS) -> logistic.Stepped | None:
    """Learns from the labels of ids whose fold is not 0."""

    def make(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return sparse(*restored_runs(Restorer(chars), data, offsets)[1:])

    x, y = vectors(labelled(docs, labels, "toxic", rows, f"{FOLD} != 0"), make)
    if len(set(y)) < 2:
        return None
    seen = np.zeros((2, 8 * BUCKETS), np.float32)
    for (i, _), label in zip(x, y, strict=True):
        seen[label, i] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    p = seen.sum(0) / n.sum()
    z = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n).sum() + 1e-9)
    pick = np.argsort(-np.abs(z), kind="stable")[: 2 * KEPT_FEATURES]
    pick = np.sort(pick[np.abs(z[pick]) >= MIN_Z])
    small = []
    for i, v in x:
        at = np.minimum(np.searchsorted(pick, i), max(0, len(pick) - 1))
        ok = pick[at] == i if len(pick) else np.zeros(len(i), bool)
        small.append((at[ok], v[ok]))
    fitted = logistic.train_in_turn(small, y, max(1, len(pick)), l2=3e-3, steps=400)
    fitted.weights = (pick, fitted.weights)
    return fitted


def dense(weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(8 * BUCKETS, np.float32)
    out[weights[0]] = weights[1][: len(weights[0])]
    return out


def score(docs: DataFrame, model: logistic.Stepped | None, chars: CharModel, texts: bool = False) -> DataFrame:
    """docs with columns score and, if asked for, restored."""
    added = ["score", "restored"][: 1 + texts]
    keep = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, weights = Restorer(chars), dense(model.weights) if model else None
        for sub, data, offsets in words.runs(batches):
            out, d, o = restored_runs(restore, data, offsets)
            yield pa.RecordBatch.from_arrays([*sub.columns, pa.array(score_runs(model, weights, d, o)), *[pa.array(out)] * texts], [*sub.schema.names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keep).schema) + ", score double" + ", restored string" * texts
    return docs.select(keep).mapInArrow(run, schema)
