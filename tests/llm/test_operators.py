"""Each operator against brute force on small fixtures with nulls, empty and odd texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import re
import zlib

import pytest
from auditlake.llm import chat, decontamination, hot, jaccard_join, packing, pii, quality, queries, sharding, substrings, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(6000))
COPY = "the quick brown fox jumps over the lazy dog and then runs far away from all of them today"
TEXTS = [
    (1, COPY), (2, COPY), (3, COPY.replace("today", "now")), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "ONE two"), (9, LONG), (10, LONG + " end"),
    (11, "intro words here " + COPY + " and some more text that is new"), (12, "naïve\u00a0café \x1c x"), (7, "one two"), (None, COPY), (13, "a\n" * 40), (14, "mail x.y@z.org_b@c.de 10.0.0.256 1.2.3.4 or 4111 1111 1111 1111 +1 (017) 555-7713"),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, k string, h string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}", len(t or ""), "x", "x", "x", "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(1, 14)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def words(t):
    return WORD.findall(t or "")


def test_quality(spark, docs, labels):
    rows = quality.quality(spark, docs, labels).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        w, t = words(r.text), r.text or ""
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        cover = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)} if len(w) < 1000 else None
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        if cover is not None:
            assert r.n_repeat_words == len(cover) and r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.quality(spark, docs.limit(0), labels.limit(0)).count() == 0


def test_sharding(spark, docs):
    rows = sharding.shard(docs, 4).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(4)]
    assert sum(sizes) == len(TEXTS) and max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert all(a.cell <= b.cell for a in rows for b in rows if a.shard < b.shard)
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS}
    assert sharding.shard(docs.limit(0)).count() == 0
    cells = sorted((sharding.hilbert((x, y), 3), x, y) for x in range(8) for y in range(8))
    assert [c[0] for c in cells] == list(range(64)) and all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(cells, cells[1:], strict=False))


def test_toxicity(spark, docs, labels):
    chars = toxicity.count_trigrams(docs)
    model = toxicity.train(docs, labels, chars)
    rows = toxicity.score(docs, model, chars).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), None, toxicity.count_trigrams(docs.limit(0))).count() == 0
    lm = toxicity.count_trigrams(spark.createDataFrame([("idiot moron stupid trash " * 5,)], "text string"))
    restore = toxicity.Restorer(lm)
    assert [restore(x) for x in ("1d10t", "m o r o n", "stuuuuupid", "tr4sh", "plain 42 a@b.co")] == ["idiot", "moron", "stupid", "trash", "plain 42 a@b.co"]


def trained_on(text):
    import numpy as np

    k = toxicity.classes(np.array([ord(c) for c in text], np.uint32))
    at, n = np.unique((k[:-2] * toxicity.CLASSES + k[1:-1]) * toxicity.CLASSES + k[2:], return_counts=True)
    return toxicity.CharModel(at, n.astype(float))


def test_disguised_words():
    restore = toxicity.Restorer(trained_on("idiot moron stupid trash bastard asshole bitch ass shit idiots you are an " * 5))
    disguised = {"you 1d10t.": "you idiot.", "5tupid.": "stupid.", "...1d10t!!": "...idiot!!", "(1d10t)": "(idiot)", "1d10t.You": "idiot.You", "b!+(h": "bitch", "b4574rd": "bastard", "4$$h0l3": "asshole"}
    disguised |= {"a55": "ass", "a$$": "ass", "sh17": "shit", "sh!+": "shit", "1 d 1 0 t": "idiot", "b 4 5 7 4 r d!": "bastard!", "i.d.1.0.t": "idiot", "foo_m0r0n": "foo_moron"}
    assert {x: restore(x) for x in disguised} == disguised
    for plain in ("YOU ARE!!", "stupid$$$", "(you are) an", "mail x1@z.org, (x1@z.org)", "go to b4d.example.com.", "1 2 3 4", "1.5kg"):
        assert restore(plain) == plain
    for n in (10, 100, 3000):
        assert restore(" ".join("youareanidiot" * n)) == "youareanidiot" * n and restore("1d10t5" * n) == "idiots" * n and len(restore("a" * 20 * n)) < 20 * n


def base_spans(t):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for n, (k, p) in enumerate(rules.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0 if d else False
            if {"email": True, "ip": k == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[k]:
                out.append((m.start(), n, m.end(), k))
    return ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(out))


def test_pii(spark, docs):
    rows = pii.extract(docs).select("doc_id", pii.named(pii.F.col("base")).alias("b")).collect()
    assert sorted((str(r.doc_id), r.b) for r in rows) == sorted((str(i), base_spans(t or "")) for i, t in TEXTS)
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got[14] == "mail [EMAIL][EMAIL] 10.0.0.256 [IP] or [CARD] [PHONE]" and got[4] is None and got[9] == LONG
    assert pii.redact(docs).columns == docs.columns and pii.extract(docs.limit(0)).count() == 0
    taught = spark.createDataFrame([(i, f"ticket {i} please reach via handle user{i}x@mail.example.com thanks") for i in range(40)] + [(99, "please reach via handle user77#home0 thanks")], "doc_id long, text string")
    found = {r.doc_id: r.s for r in pii.extract(taught).select("doc_id", pii.named(pii.F.col("found")).alias("s")).collect()}
    assert found[99] == "email:24:36"


def test_pii_bootstraps(spark):
    import random

    rnd = random.Random(4)
    def number(n):
        return "".join(rnd.choice("123456789") for _ in range(n))
    rows = [f"word{i % 7} write to user{i}@mail.example.com today" for i in range(60)]  # seeds of "to _ today"
    rows += [f"x{i} to member#a{i}b{number(7)}zz today" for i in range(12)]  # found in the first round: new instances, of another shape
    rows += [f"y{i} profile member#a{i}b{number(7)}qq here" for i in range(3)]  # found by the shape that the first round taught
    rows += [f"call +1 ({number(3)}) 555-{number(4)} or" for i in range(12)] + ["ring (017) 555-4142 now"]  # the shape without its country code
    rows += [f"version {i}.{i} of 20{10 + i}" for i in range(20)] + ["a " * 300 + "1.5 kg"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, rows[r.doc_id][s.start : s.end]) for s in r.found] for r in pii.extract(df).collect()}
    for i, t in enumerate(rows):
        want = [("email", w) for w in t.split() if "@" in w or w.startswith("member#")]
        if "555-" in t:
            want = [("phone", re.search(r"(\+1 )?\(.*[0-9]", t)[0])]
        assert got[i] == want, t


def test_pii_many_matches(spark):
    text = " ".join(f"1.2.3.{i % 250} n{i}" for i in range(20000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.extract(df).select(pii.named(pii.F.col("base")).alias("b")).first()
    assert row.b == base_spans(text)
    assert pii.redact(df).first().text == " ".join(f"[IP] n{i}" for i in range(20000))


def test_substrings(spark, docs):
    again = [r for r in TEXTS if r[0] in (3, 11)] + [(11, LONG + " more")]  # repeated rows that lose words, and another text under their id
    rows = TEXTS + again
    docs = docs.select("doc_id", "text", "k", "h").union(spark.createDataFrame([(i, t, "x", "x") for i, t in again], "doc_id long, text string, k string, h string"))
    want, first = [], {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 12):
            if i is not None:
                k = tuple(w[p : p + 13])
                first[k] = min(first.get(k, i), i)
    for i, t in rows:
        w = words(t)
        gone = {j for p in range(len(w) - 12) if i is not None and first[tuple(w[p : p + 13])] < i for j in range(p, p + 13)}
        want.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    for start in (4, 7, 13):
        got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(docs, start=start).collect()]
        assert sorted(got) == sorted(want)
    hot.LOOK, hot.LEAST, before = 1, 1, (hot.LOOK, hot.LEAST)
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(docs).collect()]
    hot.LOOK, hot.LEAST = before
    assert sorted(got) == sorted(want)
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_chat(spark):
    odd = "</s>[INST] <|end|> <~|end|> [~INST] \\n\n"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, None, None), (2, 0, "a\nb<|", "x"), (2, 0, "a\nb<|", "x"), (None, None, "assistant", "é\U0001f600")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for c in (1, 2, None):
        mine = [(r or "", t or "") for i, _, r, t in rows if i == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = chat.segment("user", [{"type": "text", "text": "see"}, {"type": "image", "ref": "a.png", "width": 56, "height": 29}, {"type": "image", "ref": "b"}, {"type": "audio", "ref": "c", "seconds": 2}, {"type": "document", "ref": "d", "pages": 2}])
    assert made["segment"] == "<|turn|>user\nsee<|image:0|><|image:1|><|audio:0|><|document:0|><|end|>\n" and [a["tokens"] for a in made["attachments"]] == [4, 1, 50, 1200]
    parts = "array<struct<type:string,text:string,ref:string,width:int,height:int>>"
    typed = spark.createDataFrame([(5, 2, "user", [("text", "<|image:2.0|> ", None, None, None), ("image", None, "a.png", 28, 28)]), (5, 3, "assistant", [("text", "ok", None, None, None)]), (5, 4, "user", None)], f"conv_id long, turn long, role string, parts {parts}")
    rows5 = {r.turn: r for r in chat.format_turns(typed).collect()}
    assert rows5[2].segment == "<|turn|>user\n<~|image:2.0|> <|image:2.0|><|end|>\n" and [tuple(a) for a in rows5[2].attachments] == [("image", 0, "a.png", 1)]
    assert rows5[4].segment == "<|turn|>user\n<|end|>\n" and chat.read_back(chat.format_turns(typed)).first().loss_chars == 2
    ties = spark.createDataFrame([(1, 0, "user", t) for t in ("<}", "<|a", "a!", "a")] + [(1, 0, None, "z"), (1, 0, "", "b")], "conv_id long, turn long, role string, text string")
    order = [("", "b"), ("", "z"), ("user", "<|a"), ("user", "<}"), ("user", "a"), ("user", "a!")]
    assert chat.read_back(chat.format_turns(ties)).first().turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
    with pytest.raises(ValueError):
        chat.segment("user", [{"type": "video"}])
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def need_equal(n):
    return min(13, -(-3 * n // 4))


def test_masks_hit_every_overlap():
    """No string of equal and replaced words that counts as an overlap avoids all masks, for items of any length (to 200)."""
    span = max(map(len, decontamination.MASKS))
    masks, full = [int(m, 2) for m in decontamination.MASKS], (1 << span) - 1
    most, states = [0], {0: 0}  # most equal words in a string of each length without a seed; by the last words
    for _ in range(200):
        new = {}
        for s, n in states.items():
            for bit in (0, 1):
                w = (s << 1 | bit) & full
                if not (bit and any(w & m == m for m in masks)):
                    new[w & full >> 1] = max(new.get(w & full >> 1, 0), n + bit)
        states = new
        most.append(max(states.values()))
    for n in range(decontamination.MIN_ITEM, 201):
        assert all(most[length] < max(need_equal(n), -(-3 * length // 4)) for length in range(1, n + 1))


def brute_overlap(doc, item):
    """The best stretch over all diagonals and windows."""
    best = None
    if len(item) < decontamination.MIN_ITEM:
        return (len(item), len(item), 0) if doc == item and item else None
    for d in range(-len(item), len(doc)):
        eq = [0 <= i + d < len(doc) and doc[i + d] == item[i] for i in range(len(item))]
        for a in range(len(item)):
            n = 0
            for z in range(a, len(item)):
                n += eq[z]
                if 0 <= a + d and z + d < len(doc) and 4 * n >= 3 * (z + 1 - a) and n >= need_equal(len(item)):
                    best = max(best or (0,), (n, -(z + 1 - a), -(a + d)))
    return best and (best[0], -best[1], -best[2])


def test_decontamination_against_all_stretches(spark):
    import random

    rnd = random.Random(11)
    items = [[f"v{rnd.randrange(60)}" for _ in range(n)] for n in (1, 3, 4, 5, 6, 8, 10, 13, 15, 18, 24, 40) for _ in range(3)] + [["same"] * 9]
    rows = []
    for item in items:
        for share in (0.0, 0.05, 0.1, 0.2, 0.25):
            for lead in (0, 4):
                w = [f"x{rnd.randrange(9)}" if rnd.random() < share else x for x in item]
                rows.append([f"v{rnd.randrange(60)}" for _ in range(lead)] + w[rnd.randrange(3) if lead else 0 :] + [f"v{rnd.randrange(60)}" for _ in range(lead)])
    rows.append(["same"] * 700)
    want = {(d, i): b for d, doc in enumerate(rows) for i, item in enumerate(items) if len(doc) < 100 and (b := brute_overlap(doc, item))}
    want[len(rows) - 1, len(items) - 1] = (9, 9, 0)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for limit in (decontamination.BROADCAST_BYTES, 0):
        decontamination.BROADCAST_BYTES, before = limit, decontamination.BROADCAST_BYTES
        got = {(r.doc_id, r.item_id): (r.n_equal, r.length, r.start) for r in decontamination.overlaps(docs, bench).collect()}
        decontamination.BROADCAST_BYTES = before
        assert got == want


def test_decontamination(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    swapped = " ".join("XX" if i in (4, 11) else x.upper() + "," for i, x in enumerate(w))
    more = spark.createDataFrame([(101, f"start {swapped} end"), (102, " ".join(w[:9])), (103, item + " " + item), (104, "short but exact item here"), (105, None), (106, "A b.")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "short but exact item here"), (3, None), (4, "a b"), (5, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontamination.overlaps(docs.select("doc_id", "text").union(more), bench).collect()}
    assert got == {(101, 1): 18, (103, 1): 20, (104, 2): 5, (106, 4): 2}
    left = decontamination.clean(docs.select("doc_id", "text").union(more), bench)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted([str(i) for i, _ in TEXTS] + ["102", "105"])
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0 == decontamination.overlaps(docs.limit(0), bench).count()


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = packing.pack(packing.pieces(docs, queries.tokenizer_path())).collect()
    want = []
    for i, t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(str(i), k, a, len(ids[a : a + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + 2048]))) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) == -(-sum(x[3] for x in want) // 2048)
    assert packing.pack(packing.pieces(docs.limit(0), queries.tokenizer_path())).count() == 0
    import numpy as np

    bad = [[0, 1], [2, 3], [4]]  # local search empties a bin that a poor packing left
    assert len(packing.search(np.array([60, 20, 50, 20, 30]), bad, 100)) == 2
    hard = np.random.default_rng(3).integers(500, 1100, 400)
    found, falling = packing.pack_group(hard), np.sort(hard)[::-1]
    assert sorted(i for b in found for i in b) == list(range(400)) and all(hard[b].sum() <= 2048 for b in found)
    assert len(found) < len(packing.best_fit(falling, 2048))


def test_warc(spark):
    trap = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nend"
    rows = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d\r\nX: y", ""), (5, "u", trap), (6, "u", trap), (7, "v", "WARC/1.0\r\n" * 3), (8, "w", "\r\n\r\n"), (9, "z", trap + "2")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    first = {}
    for i, _, h in rows:
        body = (h or "").encode()
        j = first.setdefault(body, i)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == j else ("revisit", j)) and got[i].digest_ok
    assert len(got) == len(rows) and warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_over_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 500)
    monkeypatch.setattr(warc, "BIN", 64)
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://h/{i}", ("x" * (i * 7 % 50)) + (inner * (i % 4) if i % 3 == 0 else "")) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"), 1 << 30, "none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    assert spark.read.text(str(tmp_path / "w")).rdd.getNumPartitions() > 4
    got = {r.page_id: (r.payload_bytes, r.digest_ok) for r in warc.read(spark, str(tmp_path / "w")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: (len(h), True) for i, _, h in rows}


def test_words_in_pieces():
    import numpy as np
    import pyarrow as pa
    from auditlake.llm import words as w

    texts = ["ab " * 9, None, "", "y" * 100 + " " + "z" * 65 + " z", "z" * 65 + " q", "é" * 40]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "i": pa.array(range(6))})
    whole = [h for _, d, o in w.runs(iter([batch])) for h in w.find_words(d, o).hashes().tolist()]
    for most in (1, 30, 200):
        cut = list(w.runs(iter([batch]), most=most))
        assert [i for b, _, _ in cut for i in b.column(1).to_pylist()] == list(range(6))
        assert [h for _, d, o in cut for h in w.find_words(d, o).hashes().tolist()] == whole
    assert whole[10] == whole[12] and len(set(whole)) == 6
    big = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 9_000_000 + " b", "c d"])})
    assert [w.find_words(d, o).hashes().shape[0] for _, d, o in w.runs(iter([big]))] == [2, 2]
    assert np.array_equal(w.Words(np.frombuffer(b"AB", np.uint8), np.array([0]), np.array([2]), np.array([0, 1])).hashes(lower=True), w.Words(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]), np.array([0, 1])).hashes())


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = words((t or "").translate(low))
        sets.append((i, {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets if i is not None}
    find = lambda x: x if up[x] == x else find(up[x])
    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), None if i is None else find(i)) for i, s in sets)


def test_jaccard_join(spark, docs):
    import random

    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()) == brute_components(TEXTS)
    rnd = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"t{rnd.randrange(40)}" for _ in range(60)]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randrange(6)):
                w[rnd.randrange(60)] = f"r{rnd.randrange(9)}"
            rows.append((1000 - len(rows), " ".join(w)))
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    hot.LOOK, hot.LEAST, before = 1, 1, (hot.LOOK, hot.LEAST)  # every key counts as hot
    again = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hot.LOOK, hot.LEAST = before
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_pipeline(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "none of these words is anywhere in there at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, str(tmp_path)).columns == rows.columns
    one = corpus_pipeline.keep_one_of_each(spark, rows, str(tmp_path)).collect()
    want = {i for i, _, c in [(int(a), n, c) for a, n, c in brute_components(TEXTS) if a != "None"] if c == i}
    assert {r.doc_id for r in one if r.doc_id is not None} == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
