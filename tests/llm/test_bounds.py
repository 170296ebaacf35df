"""Bounds, laws and hot groups of the earlier operators."""

import numpy as np
from auditlake.llm import decontamination, hot, jaccard_join, quality, sharding, substrings, warc


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(5000)] + [(1, "text 1")] * 5000 + [(i, f"other {i}") for i in range(2, 40)] + [(2, None), (None, "x")], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(1, 0), (3, None), (None, 1)], "doc_id long, quality int")
    rows = quality.labelled(docs, labels, "quality", 10).collect()
    assert len(rows) <= 10 and len({r.doc_id for r in rows}) == len(rows)
    every = quality.labelled(docs, labels, "quality", 1000).collect()
    assert sorted(r.doc_id for r in every) == list(range(1, 40)) and {tuple(r) for r in rows} <= {tuple(r) for r in every}
    again = quality.labelled(docs.repartition(3), labels, "quality", 1000).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in every}


def test_write_shards_keeps_the_law(spark, tmp_path):
    rows = [(i % 3, "same", "en", "s") for i in range(12)] + [(None, None, None, None)] * 5 + [(i, f"text {i}" * (i % 7), ["de", "en", "es", "fr"][i % 4], f"src{i % 9}") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    for shards in (4, 7):
        path = str(tmp_path / f"s{shards}")
        sharding.write_shards(docs, path, shards)
        back = spark.read.parquet(path)
        sizes = [r["count"] for r in back.groupBy("shard").count().collect()]
        assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1 and len(sizes) == shards
        assert sorted(map(str, back.select("doc_id", "text", "lang", "source").collect())) == sorted(map(str, docs.collect()))


def test_shards_are_pruned_on_every_dimension(spark):
    """Filters on a dimension of few values skip most files, as do those on one of many."""
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(pmod(xxhash64(id, 1), 500) as int)) as text", "element_at(array('de', 'en', 'es', 'fr'), cast(pmod(xxhash64(id, 2), 4) as int) + 1) as lang", "concat('src', pmod(xxhash64(id, 3), 20)) as source")
    plan = sharding.shard(docs, 16).select("doc_id", "shard", "size")
    rows = plan.join(docs.select("doc_id", "lang", "source"), "doc_id").collect()

    def skipped(value):
        seen = {}
        for r in rows:
            seen.setdefault(r.shard, set()).add(value(r))
        values = set().union(*seen.values())
        return 1 - sum(len(v) for v in seen.values()) / (len(values) * len(seen))

    assert skipped(lambda r: r.lang) >= 0.25 and skipped(lambda r: r.source) >= 0.25 and skipped(lambda r: r["size"] // 125) >= 0.25


def test_folded(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot") for i in range(400)] + [(1000 + i, f"v{i % 50}") for i in range(100)], "row long, v string").repartition(5)
    monkeypatch.setattr(hot, "LOOK", 1)
    got = hot.folded(rows, "v", "row").collect()
    assert [r.row for r in got if r.v == "hot"] == [0] and len({r.v for r in got}) == 51
    assert hot.folded(rows.limit(0), "v", "row").count() == 0


def test_copies_put_down_their_keys_once(spark, monkeypatch):
    """Many copies of a text, one near copy and one that shares a passage: the same with and without the fold."""
    base = " ".join(f"w{i}" for i in range(60))
    near, part = base.replace("w59", "z"), "intro " + " ".join(f"w{i}" for i in range(20, 40)) + " end"
    rows = [(i, base) for i in range(100, 500)] + [(7, near), (900, part), (300, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = [sorted(map(str, f(docs).collect())) for f in (jaccard_join.join, substrings.dedup)]
    monkeypatch.setattr(hot, "LOOK", 1)
    seen = []
    fold = hot.folded
    for m in (jaccard_join, substrings):
        monkeypatch.setattr(m, "folded", lambda df, on, row: seen.append(fold(df, on, row).count()) or fold(df, on, row))
    assert [sorted(map(str, f(docs).collect())) for f in (jaccard_join.join, substrings.dedup)] == plain
    assert seen == [3, 3]
    assert {r.component_id for r in jaccard_join.join(docs).collect() if r.doc_id != 900} == {7}


def test_items_with_one_id(spark):
    """Items of one id and different texts are both looked for, repeated rows count once."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    bench = spark.createDataFrame([(1, a), (1, b), (1, a), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(5, "x " + a + " y"), (6, b), (7, "nothing of it")], "doc_id long, text string")
    got = decontamination.overlaps(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(5, 1), (6, 1)]


def test_common_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hot, "LOOK", 1)
    rows = [(i, f"http://a/{i}", "") for i in range(1, 200)] + [(500, "http://b", "x"), (600, "http://c", "x"), (None, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert got[1].record_type == "response" and all(got[i].refers_to == 1 for i in range(2, 200)) and got[600].refers_to == 500
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_driver_gives_back_what_training_took(monkeypatch):
    held = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith(("Pss_Anon", "Pss_Shmem"))) // 1024
    kept = []

    def vectors(*_):
        rng = np.random.default_rng(1)
        rows = []
        for _ in range(2500):
            rows.append((np.sort(rng.choice(4 * quality.BUCKETS, 4000, replace=False)).astype(np.int32), rng.random(4000, np.float32)))
            kept.append(bytes(3000))  # other objects of the process lie between
        return rows, np.arange(2500) % 2

    monkeypatch.setattr(quality, "labelled", lambda *_: None)
    monkeypatch.setattr(quality, "vectors", vectors)
    before = held()
    assert quality.train(None, None) is not None
    assert held() - before < 40
