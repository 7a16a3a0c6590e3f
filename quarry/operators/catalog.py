"""Catalogue, lookup joins, table maintenance and report aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def counted(docs: DataFrame, chunks: DataFrame, key: str = "doc_id", keep_empty: bool = False) -> DataFrame:
    """Chunks of each document; documents without any vanish unless kept."""
    n = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"))
    out = docs.join(n, key, "left" if keep_empty else "inner")
    return out.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def page(catalog: DataFrame, conditions: list[Column], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Filtered, sorted and paged, with the total and the filtered number of rows on every row."""
    kept = reduce(lambda a, b: a & b, conditions, F.lit(True))
    sizes = catalog.agg(F.count("*").alias("total"), F.count_if(kept).alias("filtered"))
    return catalog.where(kept).orderBy(*order).offset(offset).limit(limit).join(F.broadcast(sizes))


def all_terms(text: Column, query: str) -> Column:
    """Every blank-separated term occurs in the lower-cased text."""
    return reduce(lambda a, b: a & b, (F.contains(F.lower(text), F.lit(t)) for t in query.lower().split()), F.lit(True))


def facet(rows: DataFrame, value: Column, missing: str = "Uncategorized") -> DataFrame:
    return rows.groupBy(F.coalesce(value, F.lit(missing)).alias("facet")).agg(F.count("*").alias("n"))


def predecessor_title(rows: DataFrame, key: str, prefix: Column, title: Column, usable: Column) -> DataFrame:
    """Of each row the title of the greatest usable key at or before it with the same prefix."""
    w = Window.partitionBy("_prefix").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_prefix", prefix).withColumn("parent_title", F.last(F.when(usable, title), ignorenulls=True).over(w)).drop("_prefix")


def first_title(rows: DataFrame, prefix: Column, title: Column, *order: Column) -> DataFrame:
    """Of each row the title of the first row of its prefix in the order."""
    w = Window.partitionBy("_prefix").orderBy(*order)
    named = rows.withColumn("_prefix", prefix)
    heads = named.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("_prefix", title.alias("parent_title"))
    return named.join(heads, "_prefix", "left").drop("_prefix")


def fallback_join(left: DataFrame, right: DataFrame, strategies: list[tuple[str, str]], value: str, last_by: str) -> DataFrame:
    """Try pairs of key columns in order; the first that finds a row gives the value. Of equal keys the last row wins."""
    out, names = left, []
    for k, (a, b) in enumerate(strategies):
        table = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias(f"_k{k}")).agg(F.max_by(value, last_by).alias(f"_v{k}"))
        out = out.join(table, F.col(a) == F.col(f"_k{k}"), "left")
        names.append(f"_v{k}")
    used = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(k + 1)) for k, n in enumerate(names)))
    return out.select(*left.columns, F.coalesce(*names).alias(value), used.alias("strategy"))


def two_key_counts(rows: DataFrame, a: str, b: str, out: str = "key") -> DataFrame:
    """Counts by pair, then summed under either key; a row whose keys are equal counts once."""
    pairs = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    keyed = pairs.select(F.explode(F.array_distinct(F.array(a, b))).alias(out), "n").where(F.col(out).isNotNull())
    return keyed.groupBy(out).agg(F.sum("n").alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Replace whole rows by key; of several new rows the last in the order wins."""
    if order is not None:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return old.join(new, key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti"))


def update_columns(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Upsert by key that sets the named columns only where the new value is not null; other columns stay."""
    fresh = new.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    both = old.join(fresh, key, "full_outer")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Delete all rows of the groups that new has, then insert new."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def overlap(hits: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Of the wanted documents, how many and which share have hits."""
    per = wanted.select(key).distinct().join(hits.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    matched = F.count("n")
    return per.agg(F.count("*").alias("documents"), matched.alias("matched"), F.round(matched / F.count("*"), 3).alias("rate"), (matched == F.count("*")).alias("all_matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"))


def affine_scores(scores: DataFrame, raw: str = "score") -> DataFrame:
    """clamp(0.70 + 0.28 * |raw| / max |raw|) to 0.65 … 0.99, over all rows."""
    top = scores.agg(F.max(F.abs(raw)).alias("_top"))
    value = F.round(0.70 + 0.28 * F.abs(raw) / F.col("_top"), 2)
    return scores.join(F.broadcast(top)).withColumn("relevance", F.least(F.greatest(value, F.lit(0.65)), F.lit(0.99))).drop("_top")


def recent_rate(rows: DataFrame, group: str, flag: Column, *order, last: int = 50) -> DataFrame:
    """The share of flagged rows among the last n up to each row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-(last - 1), 0)
    return rows.withColumn("rate", F.avg(flag.cast("double")).over(w))


def status_roll_up(rows: DataFrame, status: Column, values: list[str]) -> DataFrame:
    """All counts in one pass."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(status == v).alias(f"n_{v}") for v in values))


def hashed_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in the order of a seeded hash: the same on every run."""
    return rows.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def latest(value: str, *order: str) -> Column:
    """Aggregate: the last value that is not null in the order of the columns."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def best_of(rows: DataFrame, group: str, score: str, order: str) -> DataFrame:
    """Of each group the row of the greatest score; of equal scores the first in the order."""
    others = [c for c in rows.columns if c != group]
    best = rows.groupBy(group).agg(F.max_by(F.struct(*others), F.struct(F.coalesce(score, F.lit(float("-inf"))), -F.col(order))).alias("_best"))
    return best.select(group, *(F.col("_best")[c].alias(c) for c in others))


def last_later(rows: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Rows with the last row of equal keys, where that comes later: the greatest of the group decides, so nothing is joined."""
    return rows.withColumn(out, F.max(order).over(Window.partitionBy(*keys))).where(F.col(out) > F.col(order))


def linked_totals(members: DataFrame, links: DataFrame, key: str, groups: list[str], amount: str) -> DataFrame:
    """Of each group its members, their links and the total amount of these; links are added up before they are joined."""
    sums = links.groupBy(key).agg(F.count("*").alias("_n"), F.sum(amount).alias("_total"))
    return members.join(sums, key, "left").groupBy(*groups).agg(F.count("*").alias("members"), F.sum(F.coalesce("_n", F.lit(0))).alias("links"), F.sum(F.coalesce("_total", F.lit(0.0))).alias("total"))


def enriched_title(raw: Column, parent: Column, key: Column) -> Column:
    """A title that is empty or only names an annex stands behind its parent's, or alone; without either the id stands for it."""
    title = F.trim(F.coalesce(raw, F.lit("")))
    weak = (title == "") | F.upper(title).rlike("^(?:ANNEX|APPENDIX)")
    joined = F.when(title == "", parent).otherwise(F.concat(parent, F.lit(" — "), title))
    return F.when(weak & parent.isNotNull(), joined).when(title == "", key).otherwise(title)


def relevance_or_date(rows: DataFrame, by_relevance: bool, score: str, date: str, key: str) -> DataFrame:
    """Best scores first (smaller is better), or the latest first."""
    return rows.orderBy(F.asc(score), F.asc(key)) if by_relevance else rows.orderBy(F.desc_nulls_last(date), F.asc(key))


def by_shown_title(rows: DataFrame, titles: list[str]) -> DataFrame:
    """In the order of the first title that is not empty, case ignored."""
    return rows.orderBy(F.lower(F.coalesce(*(F.nullif(F.col(t), F.lit("")) for t in titles))))


def of_stakeholder(rows: DataFrame, stakeholder: str, column: str = "stakeholder") -> DataFrame:
    """Rows of a stakeholder, case ignored; ``all`` and nothing keep every row."""
    return rows if not stakeholder or stakeholder.lower() == "all" else rows.where(F.lower(column) == stakeholder.lower())
