"""A recursive retrieve, judge, expand loop of DataFrame steps; models are callables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from quarry.operators.chunks import surroundings
from quarry.operators.lexical import reciprocal_ranks
from quarry.plans.search import keyword_search
from quarry.session import kept


@dataclass
class Research:
    """What a run found: validated and negated chunks with scores, and the context of the validated ones."""

    validated: DataFrame
    negated: DataFrame
    context: DataFrame
    queries: list[str]


def first_seen(found: DataFrame) -> DataFrame:
    """Several queries' hits, each chunk at its first query and best rank."""
    w = Window.partitionBy("chunk_id").orderBy("q", "rank")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def gap_research(gaps: list[str], ranked_lists: Callable[[str], tuple[DataFrame, DataFrame]], consulted: DataFrame, top: int = 6) -> DataFrame:
    """consulted (chunk_id) and, for each gap, the fused best of two ranked lists (chunk_id, rank): (chunk_id, gap), each chunk at its first gap, those consulted before at gap null."""
    found = consulted.select("chunk_id", F.lit(-1).alias("q"), F.lit(0).alias("rank"))
    for k, gap in enumerate(gaps):
        found = found.union(reciprocal_ranks(*ranked_lists(gap), "chunk_id", top=top).select("chunk_id", F.lit(k).alias("q"), "rank"))
    names = F.array(*map(F.lit, gaps)) if gaps else F.array().cast("array<string>")
    return first_seen(found).select("chunk_id", F.when(F.col("q") >= 0, F.get(names, F.col("q"))).alias("gap"))


def run(chunks: DataFrame, query: str, scope: Callable[[str], list[str]] | None = None, judge: Callable[[DataFrame], DataFrame] | None = None, follow_up: Callable[[list[str]], list[str]] | None = None, levels: int = 2, top: int = 15, least: float = 6.0, excluded: tuple[str, ...] = ()) -> Research:
    """``levels`` rounds over chunks (chunk_id, doc_id, seq, text).

    The judge gets candidates (chunk_id, text) and returns (chunk_id, valid, score); what it
    leaves out stays valid. A chunk is kept if valid, of score ``least`` or more and outside
    excluded ids. Rounds hold at most five queries and never visit a chunk twice.
    """
    queries, asked = (scope(query) if scope else None) or [query], []
    visited = validated = negated = None
    for level in range(levels):
        found = None
        for k, q in enumerate(queries[:5]):
            hits = keyword_search(chunks, "chunk_id", {"text": "text"}, q, top).select("chunk_id", "rank", F.lit(k).alias("q"))
            found = hits if found is None else found.union(hits)
        asked += queries[:5]
        fresh = first_seen(found)
        for e in excluded:
            fresh = fresh.where(~F.contains(F.lower("chunk_id"), F.lit(e.lower())))
        fresh = fresh if visited is None else fresh.join(visited, "chunk_id", "left_anti")
        rows = chunks.join(fresh, "chunk_id")
        judged = judge(rows.select("chunk_id", "text")) if judge else rows.select("chunk_id", F.lit(True).alias("valid"), F.lit(10.0).alias("score"))
        # A round is written once: later rounds, the context and the caller all read it.
        rows = kept(rows.join(judged, "chunk_id", "left").withColumn("kept", F.coalesce("valid", F.lit(True)) & (F.coalesce("score", F.lit(10.0)) >= least)).withColumn("level", F.lit(level)), "round")
        good, bad = rows.where("kept").drop("kept"), rows.where("not kept").drop("kept")
        validated, negated = (good, bad) if validated is None else (validated.union(good), negated.union(bad))
        visited = rows.select("chunk_id") if visited is None else visited.union(rows.select("chunk_id"))
        queries = follow_up(asked) if follow_up and level + 1 < levels else []
        if not queries:
            break
    return Research(validated, negated, surroundings(chunks, validated, 1), asked)
