"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Fixed patterns (`RULES`) find emails, IP addresses, card and phone numbers.
2. Candidates are all tokens with a digit or @, of any length, and all runs of
   digit groups joined by spaces, dots, dashes or brackets.  A candidate that a
   rule matches as a whole is a seed of its kind; long mixed hexadecimal strings
   are seeds of the kind `secret`; short numbers (fewer than PLAIN digits, no
   letters, not four with dots) are known to be none.
3. Each occurrence induces patterns: the word before, the two before, the word
   after, and both sides, each alone and with the candidate's shape (letters and
   digits folded, number of digits), and the shape alone.  A phone seed also has
   the shape that is left without its country code.
4. Patterns and instances form a graph that is scored in rounds.  A pattern's
   confidence in a kind is the sum of its distinct instances' scores in it, over
   that of all whose kind is known, smoothed; patterns without a shape count
   instances that nobody knows against themselves as well.  An instance's score
   is its best pattern's confidence.  From MIN_CONFIDENCE on, with a sum of
   MIN_SEEDS, an instance is accepted, and supports further patterns in the next
   round.  Rounds end when no instance is new.
5. What a confident pattern finds is a span of its kind.

Positions count code points, ends are exclusive.  Only slim rows are shuffled,
texts are not.  Sums are taken before shuffles and joins are salted, so common
words, shapes and values are no hot spots.

Cases.  Null texts are empty and have no spans.  Repeated rows and ids get a row
each; null ids stay null.  Other columns are kept by `redact` and ignored by
`extract`.  Overlapping spans of different kinds all count and are blanked as
one; discovered spans never overlap base ones.  An empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import cut

#: Kinds in order, with their patterns: those of the contract, with possessive
#: repeats and look-behinds that find the same but never try a run twice.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(RULES)
#: Kinds of spans in order: those with rules, then those that are only discovered.
ALL_KINDS = [*KINDS, "secret"]
#: A run of digit groups, else a token with a digit or @.
CANDIDATE = r"(?<!\S)(?:[\p{P}\p{S}]*+[0-9]++(?:(?: ?\(|\)[ -]?|[ .-])[0-9]++)*+(?![\p{L}\p{N}@])|(?=\S*?[0-9@])\S++)"
#: What of a candidate is its value: without punctuation around it, but for + and bracketed digits in front.
CORE = r"(?s)(?:\+(?=[0-9])|\((?=[0-9]+\)))?[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"
SECRET, PLAIN = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$", 7
MIN_SEEDS, MIN_CONFIDENCE, SMOOTH, SALTS = 5.0, 0.8, 2.0, 8
SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, body) -> Column:
    """body of a value that is computed once; a column named inside a lambda function may be computed anew for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def sums(sizes: Column) -> Column:
    """Running sums of an array, by doubling steps: n log n, with no growing copies."""
    shift = lambda k: F.call_function("shiftleft", F.lit(1), k)
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(sizes), F.lit(1)))).cast("int"))
    return F.aggregate(steps, sizes, lambda a, k: F.transform(a, lambda v, i: v + F.when(i >= shift(k), F.get(a, i - shift(k))).otherwise(0)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    places = F.sequence(F.lit(0), F.length(number) - 1)
    return F.aggregate(F.transform(places, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def part_fits(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), part_fits),
    "card": lambda v: F.when(F.length(digits(v)).between(14, 19), luhn(digits(v))).otherwise(False),
    "phone": lambda v: F.length(digits(v)).between(10, 15),
}
#: What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with a column of valid matches for each kind.  Each step has a projection of its own, so that none is computed twice."""
    text, none = F.col("__text"), F.array().cast("array<string>")
    hits = {k: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in RULES.items()}
    docs = docs.withColumns({f"__h_{k}": F.when(F.contains(text, F.lit(NEEDS[k])), h).otherwise(none) for k, h in hits.items()})
    gaps = {k: F.transform(F.split(text, p, -1), F.length) for k, p in RULES.items()}
    docs = docs.withColumns({f"__g_{k}": F.when(F.exists(f"__h_{k}", VALID[k]), g).otherwise(F.array().cast("array<int>")) for k, g in gaps.items()})
    size = lambda k: let(F.col(f"__g_{k}"), lambda g: F.transform(f"__h_{k}", lambda h, i: F.coalesce(F.get(g, i), F.lit(0)) + F.length(h)))
    docs = docs.withColumns({f"__e_{k}": F.when(F.size(f"__g_{k}") > 0, size(k)).otherwise(F.array().cast("array<int>")) for k in RULES})
    docs = docs.withColumns({f"__e_{k}": sums(F.col(f"__e_{k}")) for k in RULES})

    def found(k: str) -> Column:
        at = let(F.col(f"__e_{k}"), lambda ends: F.transform(f"__h_{k}", lambda h, i: F.struct((F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("value"))))
        return F.when(F.size(f"__g_{k}") > 0, F.filter(at, lambda s: VALID[k](s["value"]))).otherwise(F.array().cast(f"array<{SPAN}>"))

    return docs.withColumns({f"__{k}": found(k) for k in RULES}).drop(*[f"__{x}_{k}" for x in "hge" for k in RULES])


def tag(order: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))


def ordered(found: Column) -> Column:
    """Structs with start, order (of the kind), end, kind: sorted."""
    return F.array_sort(found)


def with_base(docs: DataFrame) -> DataFrame:
    """docs with __text, __key (of the text) and __base (sorted spans)."""
    out = with_spans(docs.withColumn("__text", F.coalesce(F.col("text"), F.lit(""))))
    tagged = [F.transform(f"__{k}", tag(n, k)) for n, k in enumerate(KINDS)]
    return out.withColumn("__base", ordered(F.concat(*tagged))).drop(*[f"__{k}" for k in KINDS]).withColumn("__key", F.xxhash64("text"))


def plain_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs (with __text) with __seen: start, end, value, before (up to two words) and after (a word) of each candidate.

    Words next to a candidate are looked for among the four chunks before it and the three behind, however long these are."""
    spaced = lambda g: F.translate(g, "\t\n\u000b\f\r", "     ")
    gap = lambda g: F.struct(F.length(g).alias("n"), F.substring_index(spaced(g), " ", -5).alias("tail"), F.substring_index(F.ltrim(spaced(g)), " ", 3).alias("head"))
    out = docs.withColumn("__h", F.regexp_extract_all("__text", F.lit(CANDIDATE), F.lit(0)))
    kind = "array<struct<n:int,tail:string,head:string>>"
    out = out.withColumn("__g", F.when(F.size("__h") > 0, F.transform(F.split("__text", CANDIDATE, -1), gap)).otherwise(F.array().cast(kind)))
    out = out.withColumn("__e", let(F.col("__g"), lambda g: F.transform("__h", lambda h, i: F.get(g, i)["n"] + F.length(h))))

    def core(ends: Column, gaps: Column) -> Column:
        return F.transform("__h", lambda h, i: F.struct((F.get(ends, i) - F.length(h)).alias("at"), h.alias("h"), F.regexp_extract(h, CORE, 0).alias("value"), plain_words(F.get(gaps, i)["tail"]).alias("tail"), plain_words(F.get(gaps, i + 1)["head"]).alias("head")))

    cores = let(sums(F.col("__e")), lambda ends: let(F.col("__g"), lambda gaps: core(ends, gaps)))
    out = out.withColumn("__c", F.filter(cores, lambda c: c["value"] != ""))
    start = lambda c: c["at"] + F.instr(c["h"], c["value"]) - 1
    seen = F.transform("__c", lambda c: F.struct(start(c).alias("start"), (start(c) + F.length(c["value"])).alias("end"), c["value"].alias("value"), F.substring_index(c["tail"], " ", -2).alias("before"), F.substring_index(c["head"], " ", 1).alias("after")))
    return out.withColumn("__seen", seen).drop("__h", "__g", "__e", "__c")


def label(v: Column) -> Column:
    """The kind of a value that a rule knows, `plain` for what is none, else null."""
    whole = lambda k: v.rlike(f"^(?:{RULES[k]})$") & VALID[k](v)
    out = F.when(F.contains(v, F.lit("@")) & whole("email"), "email")
    for k in KINDS[1:]:
        out = out.when(whole(k), k)
    return out.when(v.rlike(SECRET), "secret").when((F.length(digits(v)) < PLAIN) & ~v.rlike(r"[\p{L}@]|^[0-9]+(\.[0-9]+){3}$"), "plain")


def shape(v: Column) -> Column:
    """Mixed strings as x, letters as a, digits as 9; without letters also the number of digits."""
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"(?=\p{L}*[0-9])(?=[0-9]*\p{L})[\p{L}0-9]{8,}", "x"), r"\p{L}+", "a"), "[0-9]+", "9")
    return F.concat(folded, F.when(v.rlike(r"\p{L}"), "").otherwise(F.concat(F.lit(":"), F.length(digits(v)).cast("string"))))


def patterns(before: Column, after: Column, shapes: Column) -> Column:
    """Names of the patterns of an occurrence; those that begin with 0 have no shape."""
    one = F.substring_index(before, " ", -1)
    sides = F.filter(F.array(
        F.when(one != "", F.concat(F.lit("l "), one)), F.when(F.contains(before, F.lit(" ")), F.concat(F.lit("ll "), before)),
        F.when(after != "", F.concat(F.lit("r "), after)), F.when((one != "") & (after != ""), F.concat(F.lit("m "), one, F.lit(" _ "), after)),
    ), lambda p: p.isNotNull())
    shaped = F.flatten(F.transform(shapes, lambda x: F.concat(F.array(F.concat(F.lit("1 s "), x)), F.transform(sides, lambda p: F.concat(F.lit("1 "), p, F.lit(" "), x)))))
    return F.concat(F.transform(sides, lambda p: F.concat(F.lit("0 "), p)), shaped)


def observations(docs: DataFrame) -> DataFrame:
    """doc_id, __key, start, end, value (folded), label, patterns of every candidate: no texts any more."""
    rows = docs.select("doc_id", "__key", F.explode("__seen").alias("s")).select("doc_id", "__key", "s.*").withColumn("value", F.lower("value"))
    rows = rows.withColumns({"label": label(F.col("value")), "shape": shape(F.col("value"))})
    local = F.when(F.col("value").rlike(r"^\+[0-9]+[ (]"), shape(F.regexp_replace("value", r"^\+[0-9]+ ?", "")))
    shapes = F.filter(F.array("shape", local), lambda x: x.isNotNull())
    return rows.withColumn("patterns", patterns(F.col("before"), F.col("after"), shapes)).drop("before", "after", "shape")


def salted(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """An inner join whose left rows of one key are dealt over SALTS tasks."""
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [on, "__salt"]).drop("__salt")


def confident(seen: DataFrame) -> DataFrame:
    """pattern, kind, confidence of the patterns that extract, from the graph of patterns and instances."""
    edges = cut(seen.select(F.explode("patterns").alias("pattern"), "value", "label").distinct(), "edges")
    unknown = cut(edges.where("label is null").select("pattern", "value"), "unknown")
    known = cut(edges.where("label is not null").groupBy("pattern", F.col("label").alias("kind")).agg(F.count("*").cast("double").alias("n")), "known")
    crowd = cut(unknown.where("startswith(pattern, '0')").groupBy("pattern").agg(F.count("*").cast("double").alias("others")), "others")
    accepted, best = None, None
    while True:
        score, left = known, crowd
        if accepted is not None:
            gained = cut(salted(unknown, accepted, "value", "pattern").groupBy("pattern", "kind").agg(F.sum("score").alias("n"), F.count("*").alias("c")), "gained")
            score = known.unionByName(gained.select("pattern", "kind", "n")).groupBy("pattern", "kind").agg(F.sum("n").alias("n"))
            left = crowd.unionByName(gained.where("startswith(pattern, '0')").select("pattern", (-F.col("c")).cast("double").alias("others"))).groupBy("pattern").agg(F.sum("others").alias("others"))
        total = score.groupBy("pattern").agg(F.sum("n").alias("total"))
        alive = score.where(f"kind != 'plain' and n >= {MIN_SEEDS}").join(total, "pattern").join(left, "pattern", "left")
        confidence = F.col("n") / (F.col("total") + F.coalesce("others", F.lit(0.0)) + SMOOTH)
        best = cut(alive.select("pattern", "kind", confidence.alias("confidence")).where(f"confidence >= {MIN_CONFIDENCE}"), "patterns")
        found = salted(unknown, best, "pattern", "value").groupBy("value").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("value", "b.kind", F.col("b.confidence").alias("score"))
        found = cut(found, "accepted")
        if accepted is None:
            fresh = found
        else:  # what was accepted stays so, with its first kind and score
            fresh = found.join(accepted.select("value"), "value", "left_anti")
        if fresh.isEmpty():
            return best
        accepted = found if accepted is None else cut(accepted.unionByName(fresh), "accepted")


def discovered(seen: DataFrame, best: DataFrame) -> DataFrame:
    """doc_id, __key, more: spans of candidates that a confident pattern extracts, and of secrets."""
    tokens = seen.where("label is null").select("doc_id", "__key", "start", "end", "value", F.explode("patterns").alias("pattern"))
    hits = salted(tokens, best, "pattern", "value")
    spans = hits.groupBy("doc_id", "__key", "start", "end", "value").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("doc_id", "__key", "start", "end", "b.kind", "value")
    spans = spans.unionByName(seen.where("label = 'secret'").select("doc_id", "__key", "start", "end", F.col("label").alias("kind"), "value").distinct())
    order = reduce(lambda a, k: F.when(F.col("kind") == k[1], k[0]).otherwise(a), enumerate(ALL_KINDS), F.lit(9)).cast("int")
    return spans.groupBy("doc_id", "__key").agg(F.collect_set(F.struct("start", order.alias("order"), "end", "kind", "value")).alias("more"))


def study(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, __key, __base of every row, and the discovered spans."""
    rows = cut(with_candidates(with_base(docs.select("doc_id", "text"))).select("doc_id", "__key", "__base", "__seen"), "observations")
    seen = cut(observations(rows), "occurrences")
    more = cut(discovered(seen, confident(seen)).select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), "more"), "discovered")
    return rows.select("doc_id", "__key", "__base"), more


def with_found(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with __found: base spans and the discovered ones apart from them, sorted."""
    same = rows["doc_id"].eqNullSafe(more["__id"]) & rows["__key"].eqNullSafe(more["__k"])
    apart = F.filter("more", lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    both = ordered(F.concat("__base", apart))
    return rows.join(more, same, "left").withColumn("__found", F.when(F.col("more").isNull(), F.col("__base")).otherwise(both)).drop("more", "__id", "__k")


def named(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base and found (arrays of spans, sorted)."""
    return with_found(*study(docs)).select("doc_id", F.col("__base").alias("base"), F.col("__found").alias("found"))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that begin inside an earlier one go with it."""
    top = F.transform(found, lambda s: s["end"])
    shift = lambda k: F.call_function("shiftleft", F.lit(1), k)
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(found), F.lit(1)))).cast("int"))
    # the furthest end up to each span, by doubling steps
    top = F.aggregate(steps, top, lambda a, k: F.transform(a, lambda v, i: F.greatest(v, F.when(i >= shift(k), F.get(a, i - shift(k))).otherwise(0))))

    def pieces(ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        return F.transform(found, lambda s, i: F.when(s["start"] >= before(i), F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))

    whole = lambda ends: F.concat(F.array_join(pieces(ends), ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))
    return let(top, whole)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced, and n_chars, if there, counted anew.

    Base spans are found where the text is read; only the discovered ones, which
    are few, are joined to it."""
    _, more = study(docs)
    both = with_found(with_base(docs), more)
    out = both.withColumn("text", F.when(F.size("__found") > 0, redacted(F.col("text"), F.col("__found"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
