"""Dataset building, research loop and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.operators.packing import page_chunks
from quarry.plans import dataset, research
from quarry.queries.common import PARAGRAPHS, Registry, chunk_table, texts
from quarry.session import table
from quarry.streaming import incremental

query = Registry()
_SPLIT = """h AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42', doc_id)), doc_id) AS place, count(*) OVER () AS n FROM documents),
    s AS (SELECT doc_id, CASE WHEN place <= n - greatest(1, round(n * 0.1)) - greatest(1, round(n * (1 - 0.8 - 0.1))) THEN 'train' WHEN place <= n - greatest(1, round(n * (1 - 0.8 - 0.1))) THEN 'val' ELSE 'test' END AS split FROM h)"""


@query(f"WITH {_SPLIT} SELECT doc_id, split FROM s")
def split_assignment(spark, sf_dir):
    return dataset.split_documents(texts(spark, sf_dir), "doc_id")


@query(f"WITH {_SPLIT} SELECT split, count(*) AS n FROM s GROUP BY split")
def split_assignment_counts(spark, sf_dir):
    return dataset.split_documents(texts(spark, sf_dir), "doc_id").groupBy("split").agg(F.count("*").alias("n"))


@query(f"""WITH {PARAGRAPHS}, {_SPLIT}, e AS (SELECT doc_id, chunk_id, 'quote' AS task, text AS target FROM p UNION ALL SELECT doc_id, chunk_id, 'source', source FROM p UNION ALL SELECT doc_id, chunk_id, 'number', regexp_extract(text, '([0-9]{{4,}})', 1) FROM p)
    SELECT split, task, count(*) AS examples, count(DISTINCT doc_id) AS documents FROM e JOIN s USING (doc_id) WHERE length(trim(target)) > 0 GROUP BY 1, 2""")
def dataset_task_counts(spark, sf_dir):
    templates = {"quote": (F.lit("Quote."), F.col("text")), "source": (F.lit("Source?"), F.col("source")), "number": (F.lit("Number?"), F.regexp_extract("text", "([0-9]{4,})", 1))}
    split = dataset.split_documents(texts(spark, sf_dir), "doc_id")
    return dataset.report(dataset.examples(chunk_table(spark, sf_dir), templates, split, "doc_id"), "doc_id")


@query()
def research_loop(spark, sf_dir):
    """Two levels with a judge that scores by length; tested for its invariants."""
    chunks = chunk_table(spark, sf_dir)
    judge = lambda rows: rows.select("chunk_id", (F.length("text") > 40).alias("valid"), F.least(F.length("text") / 10.0, F.lit(10.0)).alias("score"))
    found = research.run(chunks, "onha ering thnd", judge=judge, follow_up=lambda asked: ["edst thea", "of the"])
    return found.validated.select("chunk_id", "level", "rank", "score")


@query()
def page_packing(spark, sf_dir):
    """Documents as pages, packed by word budget; tested on a fixture and for lost words."""
    docs = texts(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n").alias("text"))
    return page_chunks(docs, 120, 200, 30).select("doc_id", "piece", F.size(F.split("text", r"\s+")).alias("words"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return incremental.event_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return incremental.sessions(table(spark, sf_dir, "events"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_windows(spark, sf_dir):
    """The same windows from a stream over the same files."""
    from quarry.session import shared_folder

    name = f"windows_{uuid.uuid4().hex[:8]}"
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = incremental.drained(spark, source, name, lambda s: incremental.event_windows(s, late="3650 days"), "complete", f"{shared_folder(spark)}/{name}")
    return out.withColumn("total", F.round("total", 4))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def role_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


QUERIES, ORACLES = query.queries, query.oracles
