"""Keyed streams, the segmented index, published tables and table grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.lexical import Expression
from quarry.operators.segments import Segments
from quarry.plans import conversion, publishing
from quarry.queries.common import PARAGRAPHS, WORDS, Registry, chunk_table, texts
from quarry.session import new_path, table
from quarry.sources import act_tree
from quarry.sources.snapshots import Snapshots
from quarry.streaming import keyed

query = Registry()
PATIENCE_HOURS = 12


def _streamed(spark, events, parts: int = 3):
    """Events written in parts that follow one another in time, and read as a stream of one part after another."""
    path = new_path(spark, "events")
    low, high = events.agg(F.unix_micros(F.min("ts")).alias("low"), F.unix_micros(F.max("ts")).alias("high")).first()
    at = F.unix_micros("ts")
    for k in range(parts):
        begin, end = (low + (high + 1 - low) * x // parts for x in (k, k + 1)) if low is not None else (0, 0)
        events.where((at >= begin) & (at < end)).write.parquet(f"{path}/part={k}")
    return spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(path)


def _job_events(spark, sf_dir):
    status = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type").isin("click", "view"), "RUNNING").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("FAILED")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("event_type") == "view", F.concat(F.lit("viewed "), "event_id")).alias("progress"), F.when(F.col("event_type") == "error", "broken").alias("error"))


@query(f"""WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN event_type = 'view' THEN 'viewed ' || event_id END AS progress FROM events),
    o AS (SELECT *, lag(status) OVER w AS before, lag(ts) OVER w AS since, lead(ts) OVER w AS next, max(ts) OVER () AS final, last_value(progress IGNORE NULLS) OVER w AS latest FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    late AS (SELECT *, status IN ('PENDING', 'RUNNING') AND coalesce(next, final) - ts > INTERVAL {PATIENCE_HOURS} HOUR AS overdue, coalesce(before IN ('PENDING', 'RUNNING') AND ts - since > INTERVAL {PATIENCE_HOURS} HOUR, false) AS lapsed FROM o),
    counts AS (SELECT user_id, count(*) AS events, count(*) FILTER (overdue) AS overdue, count(*) FILTER (status = 'RUNNING' AND (before IS DISTINCT FROM 'RUNNING' OR lapsed)) AS attempts FROM late GROUP BY 1)
    SELECT CAST(l.user_id AS VARCHAR) AS key, CASE WHEN l.overdue THEN 'FAILED' ELSE l.status END AS status, l.latest AS progress, CASE WHEN l.overdue THEN 'interrupted' WHEN l.status = 'FAILED' THEN 'broken' END AS error, CAST(c.attempts AS BIGINT) AS attempts, CAST(c.overdue AS BIGINT) AS overdue, c.events
    FROM late l JOIN counts c USING (user_id) WHERE next IS NULL""")
def streamed_jobs(spark, sf_dir):
    """Each user's events as the life of a job, from a stream in parts; overdue ones fail by a timer or at their next event."""
    events, out = _job_events(spark, sf_dir), new_path(spark, "jobs")
    keyed.job_states(_streamed(spark, events), out, f"{out}-checkpoint", PATIENCE_HOURS * 3600, "0 seconds").awaitTermination()
    return keyed.latest(spark, out, keyed.JOBS).select("key", "status", "progress", "error", "attempts", "overdue", "events")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type = 'error' AS hit, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    f(user_id, k, n, delay, streak) AS (SELECT user_id, 0, n, CAST(1.0 AS DOUBLE), 0 FROM o WHERE k = 1
        UNION ALL SELECT o.user_id, f.k + 1, f.n, CASE WHEN o.hit THEN least(greatest(delay * 2.5, 0.5), 60.0) WHEN (streak + 1) % 25 = 0 THEN least(greatest(delay * 0.92, 0.5), 60.0) ELSE delay END, CASE WHEN o.hit THEN 0 ELSE streak + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1),
    r AS (SELECT user_id, count(*) FILTER (hit) AS challenges, round(avg(CAST(hit AS DOUBLE)) FILTER (k > n - 50), 4) AS rate FROM o GROUP BY 1)
    SELECT CAST(f.user_id AS VARCHAR) AS key, f.n AS requests, challenges, round(delay, 6) AS delay, CAST(streak AS BIGINT) AS streak, rate FROM f JOIN r USING (user_id) WHERE f.k = f.n""")
def streamed_pacing(spark, sf_dir):
    """Each user's events as outcomes of requests, errors as challenges, from a stream in parts."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("challenged"))
    out = new_path(spark, "paces")
    keyed.paces(_streamed(spark, events), out, f"{out}-checkpoint").awaitTermination()
    return keyed.with_rate(keyed.latest(spark, out, keyed.PACING)).select("key", "requests", "challenges", F.round("delay", 6).alias("delay"), "streak", "rate")


# Paragraphs of documents come in two lots; those whose doc_id ends in 3 are deleted, and the first lot's even ones come again with a word more.
_LIVE = f"""{PARAGRAPHS}, live AS (SELECT chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'onha ' || text ELSE text END AS t FROM p WHERE doc_id % 10 != 3),
    c AS (SELECT chunk_id, len(w) AS len, len(list_filter(w, lambda x: x = 'onha')) AS f0, len(list_filter(w, lambda x: x = 'the')) AS f1 FROM (SELECT chunk_id, {WORDS.format('t')} AS w FROM live)),
    st AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c),
    s AS (SELECT chunk_id, -((CASE WHEN ln((n - d0 + 0.5) / (d0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d0 + 0.5) / (d0 + 0.5)) END) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / mean))
        + (CASE WHEN ln((n - d1 + 0.5) / (d1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d1 + 0.5) / (d1 + 0.5)) END) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM c, st WHERE f0 > 0 OR f1 > 0)"""


def _segmented(spark, sf_dir, merged: bool):
    chunks = chunk_table(spark, sf_dir).select("doc_id", "chunk_id", "text")
    index = Segments(spark, new_path(spark, "segments"), {"text": "text"}, fold=False)
    index.add(chunks.where("doc_id % 2 = 0"), "chunk_id")
    index.add(chunks.where("doc_id % 2 != 0"), "chunk_id")
    index.delete(chunks.where("doc_id % 10 = 3"), "chunk_id")
    if merged:
        index.merge(upto=1)
    index.add(chunks.where("doc_id % 4 = 0").withColumn("text", F.concat(F.lit("onha "), "text")), "chunk_id")
    if merged:
        index.merge()
    return index.search(Expression(any_of=["onha", "the"])).select(F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_LIVE} SELECT chunk_id, round(score, 6) AS score FROM s")
def segmented_search(spark, sf_dir):
    """Search over segments, tombstones and added statistics."""
    return _segmented(spark, sf_dir, merged=False)


@query(f"WITH {_LIVE} SELECT chunk_id, round(score, 6) AS score FROM s")
def segmented_search_merged(spark, sf_dir):
    """The same after merges."""
    return _segmented(spark, sf_dir, merged=True)


@query(f"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS edition FROM documents WHERE doc_id % 5 != 1),
    c AS (SELECT doc_id, count(*) FILTER (doc_id % 3 != 0 OR seq > 1) AS chunks FROM p GROUP BY 1) SELECT d.doc_id, edition, coalesce(chunks, 0) AS chunks FROM d LEFT JOIN c USING (doc_id)""")
def published_documents(spark, sf_dir):
    """Documents and chunks published in three versions: all, a third replaced without their first lines, a fifth deleted; read as the last version."""
    docs, chunks = texts(spark, sf_dir).select("doc_id", F.lit("first").alias("edition")), chunk_table(spark, sf_dir).select("doc_id", "seq", "chunk_id", "text")
    store = Snapshots(spark, new_path(spark, "published"))
    publishing.replace_documents(store, docs, chunks, "doc_id")
    publishing.replace_documents(store, docs.where("doc_id % 3 = 0").withColumn("edition", F.lit("second")), chunks.where("seq > 1"), "doc_id")
    publishing.delete_documents(store, docs.where("doc_id % 5 = 1"), "doc_id")
    counts = store.read("chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return store.read("documents").join(counts, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


@query("""WITH c AS (SELECT l_orderkey AS t, (l_linenumber - 1) // 2 AS r, l_linenumber AS o, 1 + (l_linenumber - 1) % 2 * 2 AS col, 1 + CAST(l_quantity AS BIGINT) % 3 AS cs, 1 + l_suppkey % 2 AS rs, l_returnflag || l_linenumber AS x FROM lineitem),
    s AS (SELECT t, r, o, col, x, unnest(generate_series(r, r + rs - 1)) AS pr, cs FROM c), p AS (SELECT t, r, o, col, x, pr, unnest(generate_series(col, col + cs - 1)) AS pc FROM s)
    SELECT t AS l_orderkey, CAST(pr AS INTEGER) AS row, CAST(pc AS INTEGER) AS col, x AS text, pr != r OR pc != col AS spanned FROM p QUALIFY row_number() OVER (PARTITION BY t, pr, pc ORDER BY r, o, x) = 1""")
def spanned_grid(spark, sf_dir):
    """Lines of orders as cells of a table, two to a row, that span columns by quantity and rows by supplier."""
    n = F.col("l_linenumber")
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor((n - 1) / 2).alias("row"), n.alias("ord"), (1 + (n - 1) % 2 * 2).alias("col"), (1 + F.col("l_quantity").cast("long") % 3).alias("colspan"), (1 + F.col("l_suppkey") % 2).alias("rowspan"), F.concat("l_returnflag", n.cast("string")).alias("text"))
    return act_tree.filled_grid(cells, ["l_orderkey"])


@query()
def pages_converted(spark, sf_dir):
    """Web pages, which are no sound XML, through the parsers in turn to plain text; tested on damaged acts."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    return conversion.converted(files, "text").select(F.col("path").cast("long").alias("page_id"), "engine", "n_nodes", F.char_length("output").alias("n_chars"), "error")


QUERIES, ORACLES = query.queries, query.oracles
