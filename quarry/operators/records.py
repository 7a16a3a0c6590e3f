"""Queues, jobs, notes and collections kept as tables: every change is a new DataFrame.

Tables are rewritten by the sinks in ``quarry.sources.sinks``; nothing here acts on one
row at a time. Unless a function says otherwise, null flags count as false and null
numbers as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.columns import chain

ERROR_CHARS = 4_000


# Queues: rows (id, status, attempts, priority, last_error, and more).


def pending(queue: DataFrame, most: int = 3) -> DataFrame:
    """Rows to work on: pending, or failed with fewer than ``most`` attempts; by priority, then id."""
    again = (F.col("status") == "error") & (F.coalesce("attempts", F.lit(0)) < most)
    return queue.where((F.col("status") == "pending") | again).orderBy(F.desc(F.coalesce("priority", F.lit(0))), F.asc("id"))


def after_attempts(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue after outcomes (id, error): one attempt more each; complete without an error, else error with its first characters."""
    both = queue.join(outcomes.select("id", F.col("error").alias("_error"), F.lit(True).alias("_tried")), "id", "left")
    tried = F.coalesce("_tried", F.lit(False))
    status = chain([(tried & F.col("_error").isNull(), F.lit("complete")), (tried, F.lit("error"))], F.col("status"))
    attempts = F.coalesce("attempts", F.lit(0)) + tried.cast("int")
    error = F.when(tried, F.substring("_error", 1, ERROR_CHARS)).otherwise(F.col("last_error"))
    return both.withColumn("status", status).withColumn("attempts", attempts).withColumn("last_error", error).drop("_error", "_tried")


def failed(queue: DataFrame) -> DataFrame:
    """Rows with errors, the most tried first."""
    return queue.where("status = 'error'").orderBy(F.desc(F.coalesce("attempts", F.lit(0))), F.asc("id"))


def reset_failed(queue: DataFrame) -> DataFrame:
    """Failed rows wait again, without attempts and error."""
    bad = F.coalesce(F.col("status") == "error", F.lit(False))
    return queue.withColumn("attempts", F.when(bad, 0).otherwise(F.col("attempts"))).withColumn("last_error", F.when(~bad, F.col("last_error"))).withColumn("status", F.when(bad, "pending").otherwise(F.col("status")))


def not_yet_done(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a restart still has to do; null keys count as not done."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


# Jobs: rows (job_id, query, status, created, result, gaps, and more).


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs that a stopped service left waiting or running have failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("PENDING", "RUNNING"), "FAILED").otherwise(F.col("status")))


def with_new_jobs(jobs: DataFrame, new: DataFrame, normalise) -> DataFrame:
    """Add jobs whose normalised query no unfailed job has; of equal new ones the least id."""
    key = lambda rows: rows.withColumn("_query", normalise(F.col("query")))
    first = key(new).withColumn("_n", F.row_number().over(Window.partitionBy("_query").orderBy("job_id"))).where("_n = 1").drop("_n")
    fresh = first.join(key(jobs.where("status != 'FAILED'")).select("_query").distinct(), "_query", "left_anti")
    return jobs.unionByName(fresh.drop("_query"))


def job_list(jobs: DataFrame, most: int = 50) -> DataFrame:
    """The latest jobs, with a flag for completed ones that name gaps."""
    gaps = (F.col("status") == "COMPLETED") & (F.coalesce(F.size("gaps"), F.lit(0)) > 0)
    return jobs.withColumn("has_gaps", F.coalesce(gaps, F.lit(False))).orderBy(F.desc_nulls_last("created"), F.asc("job_id")).limit(most)


def found_jobs(jobs: DataFrame, words: str = "", status: str | None = None) -> DataFrame:
    """Jobs whose query holds the words, case ignored, with a status if one is given (case ignored as well)."""
    kept = jobs.where(F.contains(F.lower(F.coalesce("query", F.lit(""))), F.lit(words.strip().lower())))
    return kept if status is None else kept.where(F.upper("status") == status.upper())


def found_sections(sections: DataFrame, words: str = "") -> DataFrame:
    """Report sections (title, text, and more) that hold the words in title or text, case ignored."""
    low = words.strip().lower()
    return sections.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(low)) | F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(low)))


# Notes and memories: rows (note_id, project, title, text, tags, pinned, created, and more).


def notes_of(notes: DataFrame, chunks: DataFrame, project: str | None = None, most: int = 100) -> DataFrame:
    """The latest notes with their number of chunks; ``project`` is any part of the project's name, case ignored."""
    kept = notes if not project else notes.where(F.contains(F.lower("project"), F.lit(project.lower())))
    n = chunks.groupBy(F.col("doc_id").alias("note_id")).agg(F.count("*").alias("n_chunks"))
    return kept.join(n, "note_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).orderBy(F.desc_nulls_last("created"), F.asc("note_id")).limit(most)


def remembered(rows: DataFrame, words: str = "", kind: str | None = None, only_pinned: bool = False) -> DataFrame:
    """Memories (query, answer, tags, kind, pinned) that hold the words in the query, the answer or any tag; pinned first, then the latest."""
    low = words.lower()
    anywhere = F.contains(F.lower(F.coalesce("query", F.lit(""))), F.lit(low)) | F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lit(low)) | F.coalesce(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(low))), F.lit(False))
    pinned = F.coalesce("pinned", F.lit(False))
    kept = rows.where(anywhere & (pinned if only_pinned else F.lit(True)))
    kept = kept if kind is None else kept.where(F.col("kind") == kind)
    return kept.orderBy(F.desc(pinned), F.desc_nulls_last("created"))


def cleared(rows: DataFrame, keep_pinned: bool = True) -> DataFrame:
    return rows.where(F.coalesce("pinned", F.lit(False)) & F.lit(keep_pinned))


def toggled(rows: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with the flag of some keys turned round."""
    marked = rows.join(ids.select(F.col(key), F.lit(True).alias("_turn")).distinct(), key, "left")
    return marked.withColumn(flag, F.coalesce(flag, F.lit(False)) != F.coalesce("_turn", F.lit(False))).drop("_turn")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of either table whose key the other lacks: pinning what was not pinned and unpinning what was."""
    return a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))


def joined_ids(*frames: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Every id once."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.union(f.select(key))
    return out.distinct()


def as_markdown(rows: DataFrame, columns: list[str], *order: Column, chars: int = 240) -> DataFrame:
    """One row: a markdown table of the columns, texts cut and without line ends."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s*\n\s*", " "), r"\|", "\\\\|")
    cut = lambda c: F.when(F.char_length(cell(c)) > chars, F.concat(F.substring(cell(c), 1, chars), F.lit("…"))).otherwise(cell(c))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cut, columns)), F.lit(" |"))
    numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), line.alias("line"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return numbered.agg(F.array_join(F.concat(F.array(F.lit(head)), lines), "\n").alias("markdown"))


# Further lookups.


def filled(rows: DataFrame, table: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """rows with columns of a table looked up by key, or their defaults."""
    out = rows.join(table.select(key, *(F.col(c).alias(f"_{c}") for c in defaults)), key, "left")
    return out.select(*rows.columns, *(F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in defaults.items()))


def first_count(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with ``n``: the count (key, n) of the first of several key columns that has one above zero, else 0."""
    out = rows
    for k, name in enumerate(keys):
        out = out.join(counts.select(F.col("key").alias(f"_k{k}"), F.nullif("n", F.lit(0)).alias(f"_n{k}")), F.col(name) == F.col(f"_k{k}"), "left")
    return out.select(*rows.columns, F.coalesce(*(F.col(f"_n{k}") for k in range(len(keys))), F.lit(0)).alias("n"))


def excerpts(cited: DataFrame, sources: list[tuple[str, DataFrame]], normalise, default: str = "") -> DataFrame:
    """Each cited id with a text: from the first source (name, rows (id, text)) that has the id, its normalised form, or in the end its last part."""
    tail = lambda c: F.substring_index(c, ":", -1)
    ways = [("exact", lambda c: c), ("normalised", normalise), ("suffix", tail)]
    out, found = cited.select("cited").distinct(), []
    for s, (source, rows) in enumerate(sources):
        for w, (way, form) in enumerate(ways):
            name = f"_t{s}_{w}"
            table = rows.groupBy(form(F.col("id")).alias("_form")).agg(F.min_by("text", "id").alias(name))
            out = out.join(table, form(F.col("cited")) == F.col("_form"), "left").drop("_form")
            found.append((F.col(name), F.concat(F.lit(f"{source}:{way}"))))
    return out.select("cited", F.coalesce(*(t for t, _ in found), F.lit(default)).alias("text"), chain([(t.isNotNull(), how) for t, how in found], F.lit("none")).alias("how"))


def same_document(chunks: DataFrame, hits: DataFrame, top: int = 3) -> DataFrame:
    """Of each hit (chunk_id, rank), the other hits of its document, best first."""
    placed = hits.join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    other = placed.select("doc_id", F.col("chunk_id").alias("related_id"), F.col("rank").alias("related_rank"))
    both = placed.join(other, "doc_id").where("chunk_id != related_id")
    return both.withColumn("n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("related_rank", "related_id"))).where(F.col("n") <= top).select("chunk_id", "related_id", "n")


def qualifiers_of(qualifiers: DataFrame, act: dict[str, str | None]) -> DataFrame:
    """Qualifiers (qualifier_id, parent_id, celex, target_ref) of an act: clauses only for what is known of it (id, celex, number)."""
    clauses = (F.col("parent_id") == act["id"]) | (F.col("qualifier_id") == act["id"])
    if act.get("celex"):
        clauses = clauses | (F.col("parent_id") == act["celex"]) | (F.col("celex") == act["celex"])
    if act.get("number"):
        clauses = clauses | F.contains("target_ref", F.lit(act["number"]))
    return qualifiers.where(clauses)


# Rate of requests: a fold over outcomes in order.


def request_delays(outcomes: DataFrame, start: float = 1.0, least: float = 0.5, most: float = 60.0) -> DataFrame:
    """(host, delay, streak) after the outcomes (host, seq, challenged) of each host in order.

    A challenge multiplies the delay by 2.5, every 25th clean request in a row by 0.92, within bounds.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("challenged", F.lit(False)).alias("challenged"))))
    bound = lambda x: F.least(F.greatest(x, F.lit(least)), F.lit(most))

    def step(state: Column, x: Column) -> Column:
        clean = state["streak"] + 1
        calm = F.when(clean % 25 == 0, bound(state["delay"] * 0.92)).otherwise(state["delay"])
        return F.struct(F.when(x["challenged"], bound(state["delay"] * 2.5)).otherwise(calm).alias("delay"), F.when(x["challenged"], 0).otherwise(clean).alias("streak"))

    first = F.struct(F.lit(start).alias("delay"), F.lit(0).alias("streak"))
    return outcomes.groupBy("host").agg(F.aggregate(ordered, first, step).alias("s")).select("host", "s.delay", "s.streak")
