"""Sequence operators over ordered chunks and turns."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quarry.operators import chunks as K
from quarry.queries.common import PARAGRAPHS, Registry, chunk_table
from quarry.session import table

query = Registry()


@query(f"WITH {PARAGRAPHS} SELECT chunk_id, lag(chunk_id) OVER (PARTITION BY doc_id ORDER BY seq) AS previous_chunk_id, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY seq) AS next_chunk_id FROM p")
def chunk_links(spark, sf_dir):
    return K.linked(chunk_table(spark, sf_dir)).select("chunk_id", "previous_chunk_id", "next_chunk_id")


@query(f"""WITH {PARAGRAPHS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM p), f AS (SELECT doc_id, chunk_id AS target_id, rn AS rn0 FROM r WHERE seq = 3)
    SELECT target_id, chunk_id, CASE WHEN rn < rn0 THEN 'before' WHEN rn > rn0 THEN 'after' ELSE 'target' END AS position FROM r JOIN f USING (doc_id) WHERE rn BETWEEN rn0 - 2 AND rn0 + 2""")
def context_window_pm2(spark, sf_dir):
    rows = chunk_table(spark, sf_dir)
    return K.surroundings(rows, rows.where("seq = 3"), 2).select("target_id", "chunk_id", "position")


@query(f"WITH {PARAGRAPHS} SELECT chunk_id, last_value(CASE WHEN length(text) < 60 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM p")
def carry_forward_heading(spark, sf_dir):
    return K.carried_forward(chunk_table(spark, sf_dir), F.when(F.length("text") < 60, F.col("text"))).select("chunk_id", "heading")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, seq) AS rank FROM p QUALIFY rank <= 3")
def per_doc_topk(spark, sf_dir):
    return K.per_group_top(chunk_table(spark, sf_dir), "doc_id", 3, F.desc(F.length("text")), "seq").select("doc_id", "chunk_id", "rank")


@query("SELECT event_id, event_type FROM events ORDER BY (event_type = 'error') DESC, ts DESC, event_id LIMIT 40")
def pinned_recent_topk(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc(F.col("event_type") == "error"), F.desc("ts"), "event_id").limit(40).select("event_id", "event_type")


@query("""WITH u AS (SELECT conv_id, max(turn) AS last_user FROM conversations WHERE role = 'user' GROUP BY conv_id),
    c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations JOIN u USING (conv_id) WHERE turn < last_user)
    SELECT conv_id, turn, role FROM c WHERE n <= 8""")
def last8_turns(spark, sf_dir):
    """Up to eight turns before the newest user turn."""
    turns = table(spark, sf_dir, "conversations")
    newest = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last_user"))
    before = turns.join(newest, "conv_id").where("turn < last_user")
    return K.per_group_top(before, "conv_id", 8, F.desc("turn")).select("conv_id", "turn", "role")


@query(f"""WITH {PARAGRAPHS}, s AS (SELECT lang, length(text) AS size, row_number() OVER (PARTITION BY lang ORDER BY length(text)) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM p)
    SELECT lang, count(*) AS n_chunks, CAST(floor(sum(size) / count(*)) AS BIGINT) AS mean_size, max(size) FILTER (r = n // 2) AS median_size, max(size) AS max_size FROM s GROUP BY lang""")
def chunk_size_stats(spark, sf_dir):
    return K.size_stats(chunk_table(spark, sf_dir), "lang")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, count(*) AS n_chunks, md5(string_agg(text, chr(10) ORDER BY seq)) AS digest FROM p GROUP BY doc_id")
def document_assembly(spark, sf_dir):
    return K.assembled(chunk_table(spark, sf_dir)).select("doc_id", "n_chunks", F.md5("text").alias("digest"))


@query(f"WITH {PARAGRAPHS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM p) SELECT doc_id, substr(string_agg(text, ' ' ORDER BY seq), 1, 1500) AS opening FROM r WHERE rn <= 4 GROUP BY doc_id")
def doc_snippet_first4(spark, sf_dir):
    return K.opening(chunk_table(spark, sf_dir))


@query(f"WITH {PARAGRAPHS}, g AS (SELECT *, sum(CASE WHEN length(text) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM p) SELECT doc_id, CAST(part AS BIGINT) AS part, count(*) AS n_rows, md5(string_agg(text, chr(10) ORDER BY seq)) AS digest FROM g GROUP BY 1, 2")
def split_at_headings(spark, sf_dir):
    return K.split_at(chunk_table(spark, sf_dir), F.length("text") < 60).select("doc_id", F.col("part").cast("long").alias("part"), "n_rows", F.md5("text").alias("digest"))


@query("SELECT p_partkey, CASE WHEN n = 0 THEN p_name ELSE concat(p_name, '_dup', n) END AS unique_id FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)")
def dedupe_suffixes(spark, sf_dir):
    return K.suffixed(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "unique_id")


@query("SELECT conv_id, count(*) AS turns, CAST(sum(len(string_split_regex(trim(text), '\\s+'))) AS BIGINT) AS words, CAST(round(1.3 * sum(len(string_split_regex(trim(text), '\\s+')))) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def token_estimates(spark, sf_dir):
    n = F.size(F.split(F.trim("text"), r"\s+"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(n).alias("words"), F.round(1.3 * F.sum(n)).cast("long").alias("tokens"))


@query("SELECT conv_id, turn, CAST(count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS round FROM conversations")
def turn_rounds(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).cast("long").alias("round"))


QUERIES, ORACLES = query.queries, query.oracles
