"""Plans behind a document library's services: catalogue, batches, notes, reading material, context for questions, ingest.

Each is a function of DataFrames; a service only turns its request into arguments and
the result's few rows into its answer.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.functions.columns import chain, dot, norm
from quarry.functions.text import slug
from quarry.operators import catalog as C
from quarry.operators.chunks import per_group_top
from quarry.operators.records import first_count, qualifiers_of
from quarry.plans import packages
from quarry.plans.documents import context_blocks, manual_document
from quarry.plans.search import ALIASES, ORIGINS

# Short common words that say nothing of a reading list's subject, and the words used where none is left.
SMALL_WORDS = frozenset("with from that this have shall what when which where about into their under such than only also".split())
DEFAULT_WORDS = ["safety", "aviation", "operations"]


def origin_options(spark: SparkSession) -> DataFrame:
    """What a search may be limited to: all, the union's own acts, and every marked origin."""
    return spark.createDataFrame([("all",), ("eu",), *((o,) for o, *_ in ORIGINS)], "origin string")


def catalog_page(docs: DataFrame, chunks: DataFrame, qualifiers: DataFrame | None = None, query: str = "", origin: str = "all", stakeholder: str | None = None, sort_by: str = "chunks", descending: bool = True, limit: int = 500, offset: int = 0) -> DataFrame:
    """A page of documents (doc_id, title, origin, stakeholder, date, celex, doc_number) with counts, the total and the filtered number.

    Documents without chunks are left out; ``sort_by`` is chunks, title or date; ids break ties.
    """
    rows = C.counted(docs, chunks)
    if qualifiers is not None:
        keyed = C.two_key_counts(qualifiers, "parent_id", "celex").withColumnRenamed("n", "_n").select("key", F.col("_n").alias("n"))
        rows = first_count(rows.withColumn("_id", F.col("doc_id").cast("string")), keyed, ["_id", "celex", "doc_number"]).withColumnRenamed("n", "qualifier_count").drop("_id")
    conditions = [C.all_terms(F.concat_ws(" ", F.col("doc_id").cast("string"), "title"), query)]
    if origin != "all":
        conditions.append(F.col("origin") == ALIASES.get(origin, origin))
    if stakeholder and stakeholder.lower() != "all":
        conditions.append(F.lower("stakeholder") == stakeholder.lower())
    key = {"chunks": F.col("chunk_count"), "title": F.lower("title"), "date": F.col("date")}[sort_by]
    return C.page(rows, conditions, [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.asc("doc_id")], limit, offset)


def batch(wanted: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of every wanted doc_id, in one table: title and origin or defaults, number of chunks, and the text in order; unknown ids stay with an empty text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n")
    whole = chunks.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), text.alias("text"))
    named = wanted.select("doc_id").distinct().join(docs.select("doc_id", "title", "origin"), "doc_id", "left").join(whole, "doc_id", "left")
    return named.select("doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), F.coalesce("origin", F.lit("eu")).alias("origin"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("text", F.lit("")).alias("text"))


def qualifiers_page(qualifiers: DataFrame, act: dict[str, str | None], chars: int = 300) -> DataFrame:
    """An act's qualifiers with the beginning of their texts."""
    found = qualifiers_of(qualifiers, act)
    return found.withColumn("preview", F.concat(F.substring(F.coalesce("text", F.lit("")), 1, chars), F.when(F.char_length("text") > chars, "...").otherwise("")))


def bookshelf(rows: DataFrame, scores: DataFrame, category: str | None = None, author: str | None = None, by_relevance: bool = True, top: int = 10) -> DataFrame:
    """Scored articles (chunk_id, score; rows: chunk_id, doc_id, metadata as JSON) of a category and an author, the shown score positive."""
    field = lambda name: F.get_json_object("metadata", f"$.{name}")
    kept = rows
    if category:
        kept = kept.where(F.lower(field("category")) == category.lower())
    if author:
        kept = kept.where(F.contains(F.lower(F.coalesce(field("author"), F.lit(""))), F.lit(author.lower())))
    found = scores.join(kept.select("chunk_id", "doc_id", field("category").alias("category"), field("date").alias("date")), "chunk_id")
    shown = C.relevance_or_date(found, by_relevance, "score", "date", "chunk_id").limit(top)
    return shown.select("chunk_id", "doc_id", "category", "date", F.round(F.abs("score"), 4).alias("score"))


def reading_words(query: str, heading: str = "", most: int = 8) -> list[str]:
    """Distinct words of four letters or more of a query and a report's first heading, without small ones; defaults where none is left."""
    words = [w for w in re.findall(r"[a-z]{4,}", f"{query} {heading}".lower()) if w not in SMALL_WORDS]
    return list(dict.fromkeys(words))[:most] or list(DEFAULT_WORDS)


def reading_list(scores: DataFrame, chunks: DataFrame, pool: int = 50, top: int = 12) -> DataFrame:
    """The best chunk of each document among the ``pool`` best, with relevance from 0.65 to 0.99."""
    hits = scores.orderBy(F.round("score", 6), "chunk_id").limit(pool).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    best = per_group_top(hits, "doc_id", 1, F.round("score", 6), "chunk_id")
    return C.affine_scores(best).orderBy(F.round("score", 6), "doc_id").limit(top).select("doc_id", "chunk_id", "relevance")


def section_scores(sections: DataFrame, vector: DataFrame) -> DataFrame:
    """Sections (doc_id, seq, embedding) with the cosine of one vector (embedding), best first; zero and absent vectors score 0."""
    both = sections.join(F.broadcast(vector.select(F.col("embedding").alias("_v")).limit(1)))  # one row
    size = norm(F.col("embedding")) * norm(F.col("_v"))
    score = F.when(size > 0, dot(F.col("embedding"), F.col("_v")) / size).otherwise(0.0)
    return both.select("doc_id", "seq", F.round(F.coalesce(score, F.lit(0.0)), 4).alias("score")).orderBy(F.desc("score"), "doc_id", "seq")


def listed(docs: DataFrame, part: str = "", limit: int = 20) -> DataFrame:
    """Documents whose id or title holds a part, case ignored, by id; % and _ are plain characters."""
    low = F.lower(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "title"))
    return docs.where(F.contains(low, F.lit(part.lower()))).orderBy("doc_id").limit(limit)


def question_context(chunks: DataFrame, hits: DataFrame, turns: DataFrame, sections: DataFrame | None = None, window: int = 1, history: int = 8) -> dict[str, DataFrame]:
    """What a question is answered from: context blocks of hits, the enabled report sections, and the last turns before the newest question in order."""
    newest = turns.where("role = 'user'").agg(F.max("turn").alias("_last"))
    before = turns.join(F.broadcast(newest)).where("turn < _last").orderBy(F.desc("turn")).limit(history).drop("_last")
    out = {"blocks": context_blocks(chunks, hits, window), "history": before.orderBy("turn")}
    if sections is not None:
        out["sections"] = sections.where("enabled").select("title", "text")
    return out


def context_summary(chunks: DataFrame, hits: DataFrame, question: str, summarise: Callable[[str], str] | None = None, window: int = 2) -> DataFrame:
    """(chunk_id, prompt, summary): the neighbourhood of each hit as a prompt; without a model the summary is null. Meant for a few hits."""
    import pandas as pd

    blocks = context_blocks(chunks, hits, window)
    prompts = blocks.select("chunk_id", F.concat(F.lit(f"Question: {question}\n\nContext:\n"), "block").alias("prompt"))
    if summarise is None:
        return prompts.withColumn("summary", F.lit(None).cast("string"))

    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"chunk_id": rows["chunk_id"], "prompt": rows["prompt"], "summary": [summarise(p) for p in rows["prompt"]]})

    kind = prompts.schema["chunk_id"].dataType.simpleString()
    return prompts.mapInPandas(run, f"chunk_id {kind}, prompt string, summary string")


def new_note(spark: SparkSession, title: str, sections: list[dict], project: str = "", tags: tuple[str, ...] = (), **fields: str) -> tuple[DataFrame, DataFrame]:
    """(document, chunks) of a note; its id begins with NOTE_, so that searches know its origin."""
    if len(title) < 2:
        raise ValueError("a title of two characters is needed")
    name = "NOTE_" + re.sub(r"[^A-Za-z0-9_.-]+", "_", title).strip("_")
    doc, chunks = manual_document(spark, title.ljust(3), sections, document_id=name, **({"source": "Note"} | fields))
    marks = F.to_json(F.struct(F.lit("note").alias("origin"), F.lit(project).alias("project"), F.array(*map(F.lit, tags)).cast("array<string>").alias("tags")))
    return doc.withColumn("title", F.lit(title)).withColumn("metadata", marks), chunks


def note_with_text(docs: DataFrame, chunks: DataFrame, note_id: str) -> DataFrame:
    """A note and its text in order; no row if there is no such note."""
    return batch(docs.where(F.col("doc_id") == note_id).select("doc_id"), docs, chunks)


def without_document(docs: DataFrame, chunks: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame]:
    return docs.where(F.col("doc_id") != doc_id), chunks.where(F.col("doc_id") != doc_id)


def with_section(sections: DataFrame, new: DataFrame) -> DataFrame:
    """A chat's sections and new ones; a section that is there already is only enabled."""
    again = new.select("section_id", F.lit(True).alias("_again")).distinct()
    kept = sections.join(again, "section_id", "left").withColumn("enabled", F.coalesce("_again", "enabled")).drop("_again")
    return kept.unionByName(new.join(sections, "section_id", "left_anti"))


def cached_ids(cache: DataFrame, prefix: str) -> DataFrame:
    """Ids of cache keys with a prefix, without it."""
    return cache.where(F.startswith("key", F.lit(prefix))).select(F.substring("key", len(prefix) + 1, 1_000_000).alias("id"))


def cleaned(rows: DataFrame, texts: list[str], objects: list[str], paths: list[str]) -> DataFrame:
    """Texts trimmed and never null, JSON columns null where they do not parse, paths (arrays) without empty parts."""
    fixed = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in texts}
    fixed |= {c: F.when(F.try_parse_json(c).isNotNull(), F.col(c)) for c in objects}
    fixed |= {c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")) for c in paths}
    return rows.select(*(fixed.get(c, F.col(c)).alias(c) for c in rows.columns))


def act_texts(docs: DataFrame, chunks: DataFrame, first: int = 4, chars: int = 1_500) -> DataFrame:
    """(id, text) that acts are embedded by: the title and the first chunks, cut; documents without chunks have their title."""
    head = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))).where(F.col("_n") <= first)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    opening = head.groupBy("doc_id").agg(F.substring(text, 1, chars).alias("_text"))
    return docs.join(opening, "doc_id", "left").select(F.col("doc_id").alias("id"), F.concat_ws("\n", F.nullif(F.coalesce("title", F.lit("")), F.lit("")), "_text").alias("text"))


def parse_report(nodes: DataFrame) -> DataFrame:
    """One row of a batch of parsed files: files, parsed, failed; and the share that parsed."""
    files = nodes.groupBy("path").agg(F.max("error").alias("error"))
    good = F.count_if(F.col("error").isNull())
    return files.agg(F.count("*").alias("files"), good.alias("parsed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.round(good / F.count("*"), 4).alias("rate"))


def nodes_as_json(nodes: DataFrame) -> DataFrame:
    """(path, json): each document's nodes in order as a JSON list without empty fields."""
    fields = ("node_id", "parent_id", "depth", "type", "number", "title", "text")
    return nodes.where("error is null").groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("json"))


def ingested(files: DataFrame, old_docs: DataFrame, keywords: list[str]) -> dict[str, DataFrame]:
    """One ingest of files (path, root, title, text, error): documents after replacing whole packages, qualifiers, and the metrics.

    Packages without a keyword are counted and left out.
    """
    good = files.where("error is null")
    found = packages.packages(good, keywords).withColumn("error", F.lit(None).cast("string"))
    bad = files.where("error is not null").select("error")
    relevant = found.where(F.size("keywords") > 0)
    roles = packages.with_roles(good).join(relevant.select("folder", "class", F.coalesce("celex", slug(F.col("folder"))).alias("doc_id"), F.col("title").alias("act_title")), "folder")
    acts, _ = packages.consolidated(roles)
    named = acts.join(roles.select("folder", "doc_id", "act_title").distinct(), "folder").select("doc_id", F.col("act_title").alias("title"), "text", "annex_count")
    counts = packages.metrics(found).drop("failed").join(F.broadcast(bad.agg(F.count("*").alias("failed"))))  # both are one row
    return {"documents": C.upsert(old_docs, named, "doc_id"), "qualifiers": packages.as_qualifiers(relevant), "metrics": counts}


def job_state(status: Column) -> Column:
    """What a job's state is shown as."""
    return chain([(status.isin("PENDING", "RUNNING"), F.lit("active")), (status == "COMPLETED", F.lit("done"))], F.lit("failed"))
