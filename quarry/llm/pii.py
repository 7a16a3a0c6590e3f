"""Personal data by fixed forms and by bootstrapped contexts; DataFrame functions only.

Base entities (e-mail, IPv4, payment card, phone) are found by patterns without
backtracking over long runs. They are the seeds of a bootstrap over the graph of
lexical patterns and strings. Strings are the seeds and every candidate that no
base span overlaps: groups of digits, tokens with a digit, `@` or `_`, and what
follows a label with a colon or an equals sign. Patterns are the word before a
string, the two words before it, the word after it, and the words on both sides.

In every round, a pattern's score for a kind is the weight of its occurrences that
hold entities of that kind, over all its occurrences and DOUBT more; a pattern of
SEEDS different entities or more and a score of CONFIDENT or more passes; strings
of passed patterns become entities with the best of their patterns' scores, and so
help further patterns to pass in the next round, until a round leaves patterns,
entities and scores (to six places) as an earlier one did. Occurrences at patterns
that passed are the added spans.

Defined results: null and empty texts have no spans; repeated rows are scanned
one by one; equal starts order by end; of several kinds an added span takes that of
its best pattern (the last by name on ties); very long texts and strings count in
full, in time that grows with the square of the hits of one text; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.exact_dedup import BROADCAST_ROWS
from quarry.llm.scratch import written

SEEDS, CONFIDENT, DOUBT = 4, 0.7, 2.0
#: Characters beside a match that are kept; more where the next two words before it, or the word after it, are longer.
BESIDE = 80
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The same leftmost matches as the plain forms: possessive runs, tried at run starts and where a match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DIGITS = r"[(+]{0,2}[0-9][0-9().+/-]*+"
#: Groups of digits; tokens with a digit, @ or _; values of labels.
CANDIDATE = rf"(?<!\S)(?:{_DIGITS}(?: {_DIGITS})*+(?=[^\sA-Za-z0-9]*+(?!\S))|[^\s0-9@_]*+[0-9@_]\S*+|(?<=[:=] )\S++)"
_LEAD, _TAIL = r"^[\"'\[<]*+", r"[.,;:!?\"'\]>]++$"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SPAN = "array<struct<start:int,end:int,hit:string,tail:string,head:string>>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """Every match with its start and end in code points, and what stands beside it: BESIDE characters, and whole words where those are longer."""
    tail = lambda p: F.when((F.char_length(p) <= BESIDE) | F.right(p, F.lit(BESIDE)).rlike(r"\s\S+\s+\S+\s*$"), F.right(p, F.lit(BESIDE))).otherwise(p)
    head = lambda q: F.when((F.char_length(q) <= BESIDE) | F.left(q, F.lit(BESIDE)).rlike(r"^[^\s\p{L}]*\s+\S+\s"), F.left(q, F.lit(BESIDE))).otherwise(q)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def beside(parts: Column) -> Column:
        around = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), lambda p, q: F.struct(F.char_length(p).alias("n"), tail(p).alias("tail"), head(F.coalesce(q, F.lit(""))).alias("head")))
        return F.zip_with(around, hits, lambda p, h: F.struct(p["n"].alias("n"), p["tail"].alias("tail"), p["head"].alias("head"), h.alias("h")))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["n"]
        end = start + F.char_length(x["h"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["h"].alias("hit"), x["tail"].alias("tail"), x["head"].alias("head")))).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    pairs = F.filter(_let(F.split(text, pattern, -1), beside), lambda x: x["h"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(pairs, first, step, lambda a: a["out"])).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Valid base entities of all kinds: array of (order, kind, start, end, hit, tail, head), by kind, then start."""
    digits = lambda h: F.regexp_replace(h, "[^0-9]", "")
    valid = {
        "email": lambda h: F.lit(True),
        "ip": lambda h: h.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
        "card": lambda h: F.call_function("luhn_check", digits(h)),
        "phone": lambda h: F.char_length(digits(h)).between(8, 15),
    }
    marks = {"email": "@", "ip": ".", "phone": "+"}

    def of(k: int, kind: str) -> Column:
        spans = located(text, PATTERNS[kind])
        if kind in marks:
            spans = F.when(F.contains(text, F.lit(marks[kind])), spans).otherwise(F.array().cast(_SPAN))
        passed = F.filter(spans, lambda x: valid[kind](x["hit"]))
        return F.transform(passed, lambda x: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), *(x[c].alias(c) for c in ("start", "end", "hit", "tail", "head"))))

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


def candidate_spans(text: Column) -> Column:
    """Candidates without the quotes and marks around them."""

    def bare(x: Column) -> Column:
        lead = F.char_length(F.regexp_extract(x["hit"], _LEAD, 0))
        tail = F.char_length(F.regexp_extract(x["hit"], _TAIL, 0))
        n = F.char_length(x["hit"])
        return F.struct((x["start"] + lead).alias("start"), (x["end"] - tail).alias("end"), F.substring(x["hit"], lead + 1, F.greatest(n - lead - tail, F.lit(0))).alias("hit"), x["tail"].alias("tail"), x["head"].alias("head"))

    return F.filter(F.transform(located(text, CANDIDATE), bare), lambda x: x["hit"] != "")


def contexts(x: Column) -> Column:
    """The lexical patterns of an occurrence: lower-cased words before and after, with letters only."""
    before = F.lower(F.regexp_extract(x["tail"], r"(\S+)\s*$", 1))
    two = F.lower(F.regexp_replace(F.regexp_extract(x["tail"], r"(\S+\s+\S+)\s*$", 1), r"\s+", " "))
    after = F.lower(F.regexp_extract(x["head"], r"^[^\s\p{L}]*\s+(\S+)", 1))
    named = [("1 ", before), ("2 ", two), ("+1 ", after), ("both ", F.when((before != "") & (after != ""), F.concat(before, F.lit(" _ "), after)).otherwise(""))]
    every = F.array(*(F.when(w.rlike(r"\p{L}"), F.concat(F.lit(name), w)) for name, w in named))
    return F.filter(every, lambda p: p.isNotNull())


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _content(rows: DataFrame, name: str) -> tuple:
    """Number and a sum of hashes of (name, kind, score)."""
    return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64(name, "kind", F.round("score", 6)).cast("decimal(38,0)"))).first())


def confident_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, kind, score) that passed in the last round, from edges (pattern, hit, kind or null for no seed)."""
    counted = written(edges.groupBy("pattern", "hit", F.col("kind").alias("own")).agg(F.count("*").alias("n")), "contexts")
    totals = written(counted.groupBy("pattern").agg(F.sum("n").alias("total")).where(f"total >= {SEEDS}"), "totals")
    entities, seen = None, set()
    while True:
        if entities is None:
            valued = counted.where("own is not null").select("pattern", F.col("own").alias("kind"), "n", F.lit(1.0).alias("value"))
        else:
            valued = counted.join(_small(entities), "hit", "left").select("pattern", F.coalesce("own", "kind").alias("kind"), "n", F.when(F.col("own").isNotNull(), 1.0).otherwise(F.col("score")).alias("value")).where("kind is not null")
        # Rows of one pattern and kind are different strings.
        scores = valued.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("value")).alias("mass"), F.count("*").alias("strings")).where(f"strings >= {SEEDS}")
        ranked = scores.join(totals, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("total") + DOUBT)).alias("score"))
        ranked = written(ranked.where(f"score >= {CONFIDENT}"), "patterns")
        entities = counted.where("own is null").join(_small(ranked), "pattern").groupBy("hit").agg(F.max(F.struct("score", "kind")).alias("best")).select("hit", "best.score", "best.kind")
        entities = written(entities, "entities")
        now = (_content(ranked, "pattern"), _content(entities, "hit"))
        if now in seen:
            return ranked
        seen.add(now)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans, found."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("found"))
    free = F.filter("found", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = written(rows.select("doc_id", "base", free.alias("found")).withColumn("row_key", F.monotonically_increasing_id()), "entities")
    seeds = rows.select(F.explode("base").alias("x")).select(F.explode(contexts(F.col("x"))).alias("pattern"), F.col("x.hit").alias("hit"), F.col("x.kind").alias("kind"))
    found = rows.select("row_key", F.explode("found").alias("x")).select("row_key", F.explode(contexts(F.col("x"))).alias("pattern"), F.col("x.hit").alias("hit"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    known = confident_patterns(seeds.unionByName(found.select("pattern", "hit", F.lit(None).cast("string").alias("kind"))))
    # One span gets one kind: that of the best pattern.
    added = found.join(_small(known), "pattern").groupBy("row_key", "start", "end", "hit").agg(F.max(F.struct("score", "kind")).alias("best"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("best.kind")).cast("int") - 1
    none = F.lit("")
    added = added.groupBy("row_key").agg(F.collect_list(F.struct(order.alias("k"), F.col("best.kind").alias("kind"), "start", "end", "hit", none.alias("tail"), none.alias("head"))).alias("added"))
    every = F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_added = F.coalesce(F.size("added"), F.lit(0)).cast("long")
    n_spans = F.size("base") + n_added
    return rows.join(_small(written(added, "added")), "row_key", "left").select(
        "doc_id", *map(count, KINDS), F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(every).alias("spans"), n_added.alias("n_added"), n_spans.alias("n_spans"), (n_spans > 0).alias("found")
    )
