"""The opN queries and their SQL, and what they share."""

from __future__ import annotations

import hashlib  # noqa: F401
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, forest, jaccard_join, packing, pii, quality, resampling, sharding, substrings, toxicity, warc, whitening

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(spark, docs.select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chars = toxicity.count_trigrams(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), chars)
    scored = toxicity.score(docs, model, chars)
    return scored.select("doc_id", F.expr(f"coalesce({toxicity.FOLD} = 0, false)").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.named(F.col("base")), 256).alias("base_sha256"), pii.named(F.filter("found", lambda s: s["kind"].isin(list(pii.KINDS)))).alias("spans"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(turns.unionByName(chat.control_conversation(spark))))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..store import cut

    return packing.pack(cut(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()), "pieces"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.dedup(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # deviation is exact in the operator; null here where a long can't hold it
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_hilbert_sharding, op3_toxicity, op4_contextual_pii, op5_substring_dedup, op6_chat_format, op7_decontamination, op8_packing, op9_warc, op10_jaccard_join, op11_importance_resampling, op12_minhash_forest, op13_embedding_whitening, pipeline)
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def similarity_sql(shingle: int, percent: int, columns: str) -> str:
    """All pairs of sets by their shared shingles, then reachability; columns: of doc_id, n and low."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({WORDS.format(LOWERED)}, []::VARCHAR[]) AS w FROM documents),
s AS (SELECT doc_id, md5(array_to_string(w[i:i+{shingle - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {shingle - 2})) AS i FROM d WHERE len(w) >= {shingle}) GROUP BY ALL
  UNION ALL SELECT doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND {shingle - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {percent} * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
z AS (SELECT x AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY x)
SELECT {columns} FROM z"""


ORACLE_SQL = {
    "op5_substring_dedup": f"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format("text")}, []::VARCHAR[]) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
hit AS (SELECT g.doc_id, g.i FROM g JOIN m USING (h) WHERE m.low < g.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS r, w, coalesce(ps, []::BIGINT[]) AS ps FROM d LEFT JOIN per USING (doc_id)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM k),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p WHERE gone.p IS NULL GROUP BY x.doc_id)
SELECT k.doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN y USING (doc_id)""",
    "op6_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(~*)(\||/?s>|/?INST\])', '\1~\2\3', 'g')) + length(role) + 17 AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
h AS (SELECT page_id, strlen(b) AS n, sha1(b) AS x FROM p),
q AS (SELECT page_id, n, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(5 * i + 1 AS INT), 5) AS BIGINT) >> s) & 31 AS INT), 1)), '')), '') AS d FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d, n) AS first FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op10_jaccard_join": similarity_sql(5, 75, "*"),
    "op11_importance_resampling": rf"""
WITH byte AS (SELECT list(c ORDER BY k) AS tab FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) AS c FROM range(256) AS t(k))),
d AS (SELECT doc_id, true AS own, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT item_id, false, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT own, doc_id, unnest(w) AS f FROM d UNION ALL SELECT own, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
  lambda a, y: xor(a >> 8, tab[1 + (xor(a, y) & 255)])), 4294967295) % 10000 AS b FROM h, byte),
g AS (SELECT own, doc_id, b FROM f JOIN b USING (f)),
t AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM g GROUP BY b),
a AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM t),
gain AS (SELECT b, floor(1000 * ln((t.t + 1) * (a.s + 10000) / ((t.s + 1) * (a.t + 10000)))) AS gain FROM t, a),
w AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM g JOIN gain USING (b) WHERE own GROUP BY doc_id),
q AS (SELECT doc_id, coalesce(len(d.w), 0) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id) WHERE own),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM q WHERE words >= 20)
SELECT q.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM q LEFT JOIN k USING (doc_id)""",
    "op12_minhash_forest": similarity_sql(2, 80, "*, doc_id = component_id AS kept"),
}
