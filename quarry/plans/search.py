"""Search plans: query expressions, keyword, workspace and section search, context assembly."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.columns import chain, words as plain_words
from quarry.operators.chunks import per_group_top
from quarry.operators.dense import cosines
from quarry.operators.lexical import Expression, bm25, expression_scores, ranked, reciprocal_ranks

# Words that a keyword query drops.
STOPWORDS = frozenset("what are the for and in used is to of on with from by as at an a or do does how can could should would which who whom this that these those there their be been being have has had shall may must into under about between out all any".split())
# The sources that mark an origin in a document's metadata, in order of precedence.
ORIGINS = [("note", "origin", "note", "NOTE_"), ("skybrary", "source", "SKYBRARY", "SKYBRARY_"), ("manual", "source", "Manual", "MANUAL_"), ("faa", "source", "FAA XML", "FAA_"), ("easa", "source", "EASA XML", None)]
ALIASES = {"bookshelf": "skybrary", "notes": "note"}


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def parse_query(raw: str, expanded: list[str] | None = None, stopwords=STOPWORDS) -> Expression:
    """Quoted phrases; the whole as a phrase if it has 2-5 words; any word; all words if there are 2-4; expansions as phrases.

    A word with - / or . inside is a phrase of its parts. If no word is left, all words count.
    """
    out = Expression([p for p in map(_tokens, re.findall(r'"([^"]+)"', raw)) if p])
    bare = re.sub(r"[^\w\s\-/.]", " ", re.sub(r'"[^"]+"', " ", raw))
    salient = [t for t in (w.strip(".-/") for w in bare.split()) if _tokens(t) and (t.lower() not in stopwords or re.search("[-/]", t))]
    if 2 <= len(salient) <= 5:
        out.phrases.append(_tokens(" ".join(salient)))
    for parts in map(_tokens, salient):
        if len(parts) == 1:
            out.any_of.append(parts[0])
        else:
            out.phrases.append(parts)
    if 2 <= len(salient) <= 4:
        out.all_of = [t for s in salient for t in _tokens(s)]
    out.phrases += [p for p in map(_tokens, expanded or []) if p]
    if not out.atoms():
        out.any_of = _tokens(bare) or _tokens(raw)
    return out


def origin_of(metadata: Column, doc_id: Column) -> Column:
    """A document's origin by marks in its raw metadata, or by the prefix of its id where it has none."""
    none = F.coalesce(metadata, F.lit("")) == ""
    marked = lambda name, value, prefix: F.when(none, F.startswith(doc_id, F.lit(prefix)) if prefix else F.lit(False)).otherwise(F.contains(metadata, F.lit(f'"{name}": "{value}"')))
    return chain([(marked(name, value, prefix), F.lit(origin)) for origin, name, value, prefix in ORIGINS], F.lit("eu"))


def catalog_origin(source: Column, doc_id: Column, title: Column, metadata: Column) -> Column:
    """A document's origin by the catalogue's rules, whose order differs from a search's; a note in parsable metadata overrides them."""
    low = F.lower(F.concat_ws(" ", doc_id, title))
    begins = lambda p: F.startswith(doc_id, F.lit(p))
    rules = [
        ((source == "SKYBRARY") | begins("SKYBRARY_"), F.lit("skybrary")),
        (begins("NOTE_") | source.isin("Note", "UserNote"), F.lit("note")),
        ((source == "FAA XML") | begins("FAA_") | F.contains(low, F.lit("14 cfr")), F.lit("faa")),
        (source.isin("Manual", "Custom") | begins("MANUAL_"), F.lit("manual")),
        (low.rlike("easy access|cs-|amc"), F.lit("easa")),
    ]
    return F.when(F.get_json_object(metadata, "$.origin") == "note", "note").otherwise(chain(rules, F.lit("eu")))


def in_scope(origin: str = "all", document_id: str | None = None, stakeholder: str | None = None) -> Column:
    """Rows (origin, doc_id, stakeholder) that a search looks at; a document id overrides the origin, ``all`` stands for no limit."""
    kept = F.lit(True)
    if document_id is not None:
        kept = kept & (F.col("doc_id").cast("string") == document_id)
    elif origin != "all":
        kept = kept & (F.col("origin") == ALIASES.get(origin, origin))
    if stakeholder and stakeholder.lower() != "all":
        kept = kept & (F.lower("stakeholder") == stakeholder.lower())
    return kept


def keyword_search(rows: DataFrame, key: str, columns: dict[str, str], query: str, top: int = 5, weights: dict[str, float] | None = None, expander: Callable[[str], list[str]] | None = None, where: Column | None = None, boosted: Column | None = None, scores: DataFrame | None = None, tokenise=plain_words) -> DataFrame:
    """Ranked rows (key, score, rank) for a raw query.

    Scores use the statistics of all rows; ``where`` then picks rows, ``boosted`` multiplies
    the scores of some by 2.5. ``scores`` (key, score) may come from a stored index instead.
    """
    if scores is None:
        parsed = parse_query(query, expander(query) if expander else None)
        if not parsed.atoms():
            return rows.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        scores = expression_scores(rows, key, columns, parsed, weights, tokenise)
    if where is not None or boosted is not None:
        kept = rows.where(where if where is not None else F.lit(True)).select(key, (boosted if boosted is not None else F.lit(False)).alias("_boosted"))
        scores = scores.join(kept, key).withColumn("score", F.col("score") * F.when(F.col("_boosted"), 2.5).otherwise(1.0))
    return ranked(scores.select(key, "score"), top, F.asc(F.round("score", 6)), F.asc(key))


def semantic_search(chunks: DataFrame, vector: list[float], top: int = 5, documents: DataFrame | None = None, stakeholders: DataFrame | None = None, stakeholder: str | None = None, where: Column | None = None, boosted: Column | None = None, pool: int = 25) -> DataFrame:
    """Ranked chunks (chunk_id, score, rank): cosine, lifted by the document's and by the stakeholder's score.

    chunks has chunk_id, doc_id and embedding; documents (doc_id, embedding) gives the
    prior of the ``pool`` nearest documents (0.75 chunk + 0.25 document where positive);
    stakeholders (chunk_id and a column for each stakeholder) adds 0.15 of its score.
    """
    cosine = lambda rows: cosines(rows, [vector]).withColumn("cos", F.get("cosines", F.lit(0))).drop("cosines", "embedding")
    kept = chunks.withColumn("_boosted", boosted if boosted is not None else F.lit(False)).where(where if where is not None else F.lit(True))
    rows = cosine(kept.select("chunk_id", "doc_id", "_boosted", "embedding"))
    score = F.col("cos")
    if documents is not None:
        prior = cosine(documents.select("doc_id", "embedding")).orderBy(F.desc("cos"), "doc_id").limit(pool).select("doc_id", F.col("cos").alias("prior"))
        rows = rows.join(F.broadcast(prior), "doc_id", "left")  # at most ``pool`` rows
        score = F.when(F.col("prior") > 0, 0.75 * score + 0.25 * F.col("prior")).otherwise(score)
    if stakeholders is not None and stakeholder and stakeholder.lower() in stakeholders.columns:
        rows = rows.join(stakeholders.select("chunk_id", F.col(stakeholder.lower()).alias("_stake")), "chunk_id", "left")
        score = score + 0.15 * F.coalesce("_stake", F.lit(0.0))
    final = F.round(score * F.when(F.col("_boosted"), 2.5).otherwise(1.0), 4)
    return ranked(rows.select("chunk_id", final.alias("score")), top, F.desc("score"), F.asc("chunk_id"))


def hybrid_search(semantic: DataFrame, keyword: DataFrame, top: int = 5, k: int = 60) -> DataFrame:
    """The two ranked lists, each of which should hold max(2 * top, 20) rows, fused by reciprocal ranks."""
    return reciprocal_ranks(semantic, keyword, "chunk_id", k, top)


def query_text(query: str, task: str = "", hypothetical: Callable[[str], str] | None = None, least: int = 25) -> str:
    """What is embedded for a query: a hypothetical answer of a certain length, else the query behind its task."""
    answer = hypothetical(query) if hypothetical else None
    return answer if answer and len(answer.strip()) >= least else f"query: {task}: {query}" if task else query


def workspace(rows: DataFrame, wanted: DataFrame, terms: list[str], per_doc: int = 8, total: int = 50) -> DataFrame:
    """BM25 within a set of documents: the best ``total`` chunks, then at most ``per_doc`` of each document.

    The shown score 1 / (1 + |score|) falls as the match improves.
    """
    inside = rows.join(wanted, "doc_id", "left_semi")
    scores = bm25(inside, "chunk_id", {"text": "text"}, terms).join(inside.select("chunk_id", "doc_id"), "chunk_id")
    top = scores.orderBy(F.round("score", 6), "chunk_id").limit(total)
    capped = per_group_top(top, "doc_id", per_doc, F.round("score", 6), "chunk_id")
    return capped.select("chunk_id", "doc_id", F.round(1 / (1 + F.abs("score")), 4).alias("score"), F.col("rank").alias("doc_rank"))


def section_similarity(sections: DataFrame, query: str, least: float = 10.0) -> DataFrame:
    """BM25 of each document's sections with its own statistics: (doc_id, seq, similarity), the best section at 100.

    A query word of four letters or more that is only part of a word (or the reverse)
    counts 0.75; the whole query as a phrase adds 4; the share of words found scales by half.
    """
    terms = [t for t in dict.fromkeys(re.findall(r"[a-z0-9_]+", query.lower())) if len(t) >= 2]
    bag = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: F.length(x) >= 2)
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    fuzzy = lambda t: F.exists("w", lambda x: F.contains(x, F.lit(t)) | F.contains(F.lit(t), x)) if len(t) >= 4 else F.lit(False)
    rows = sections.select("doc_id", "seq", "text", bag.alias("w")).select("doc_id", "seq", "text", F.size("w").alias("l"), *(count(t).alias(f"f{k}") for k, t in enumerate(terms)), *(fuzzy(t).alias(f"z{k}") for k, t in enumerate(terms)))
    stats = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.greatest(F.avg("l"), F.lit(1.0)).alias("m"), *(F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(terms))))
    both = rows.join(stats, "doc_id")

    def part(k: int):
        f = F.when(F.col(f"f{k}") > 0, F.col(f"f{k}").cast("double")).when(F.col(f"z{k}"), 0.75).otherwise(0.0)
        idf = F.greatest(F.lit(0.2), F.log(1 + (F.col("n") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5)))
        return idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("l") / F.col("m")))

    covered = reduce(lambda a, b: a + b, (F.when((F.col(f"f{k}") > 0) | F.col(f"z{k}"), 1.0).otherwise(0.0) for k in range(len(terms)))) / len(terms)
    phrase = F.when(F.contains(F.lower("text"), F.lit(query.lower())), 4.0).otherwise(0.0)
    value = (reduce(lambda a, b: a + b, map(part, range(len(terms)))) + phrase) * (0.5 + 0.5 * covered)
    valued = both.select("doc_id", "seq", value.alias("v"))
    best = valued.groupBy("doc_id").agg(F.max("v").alias("best")).where("best > 0")
    share = 100 * F.col("v") / F.col("best")
    return valued.join(best, "doc_id").where(share >= least).select("doc_id", "seq", F.round(share, 3).alias("similarity"))


def blend(cosines: DataFrame, scores: DataFrame) -> DataFrame:
    """0.3 * lexical (best at 100) + 0.7 * 100 * cosine from 0 up; the cosine alone without a lexical row."""
    top = scores.agg(F.max(F.abs("score")).alias("top"))
    semantic = 100 * F.greatest(F.lit(0.0), F.col("cos"))
    mixed = F.when(F.col("score").isNull(), semantic).otherwise(0.3 * 100 * F.abs("score") / F.col("top") + 0.7 * semantic)
    return cosines.join(scores, "id", "left").join(F.broadcast(top)).select("id", mixed.alias("blend"))
