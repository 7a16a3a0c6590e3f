"""Marked-up text, lookups by several keys, and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import marks as M
from quarry.operators import lexical, lookup
from quarry.plans import documents
from quarry.queries.common import PARAGRAPHS, Registry, chunk_table, texts
from quarry.session import table

query = Registry()


@query(f"WITH {PARAGRAPHS}, c AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN concat(doc_id, ':1') ELSE concat('x', doc_id, ':', doc_id + 100) END AS cited FROM documents), t AS (SELECT split_part(chunk_id, ':', 2) AS tail, min(chunk_id) AS s FROM p GROUP BY 1)"
    " SELECT cited, coalesce(p.chunk_id, s) AS chunk_id, CASE WHEN p.chunk_id IS NOT NULL THEN 'exact' WHEN s IS NOT NULL THEN 'suffix' END AS how FROM c LEFT JOIN p ON p.chunk_id = cited LEFT JOIN t ON tail = split_part(cited, ':', 2) AND length(tail) > 2 AND p.chunk_id IS NULL")
def citation_hydration(spark, sf_dir):
    docs = texts(spark, sf_dir)
    cited = docs.select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("doc_id"), F.lit(":1"))).otherwise(F.concat(F.lit("x"), F.col("doc_id"), F.lit(":"), F.col("doc_id") + 100)).alias("cited"))
    return lookup.by_id_or_suffix(cited, chunk_table(spark, sf_dir))


@query(f"WITH {PARAGRAPHS}, m AS (SELECT doc_id, string_agg(concat('<!-- SECTION_BREAK {{\"id\":', seq, '}} -->', chr(10), text), chr(10) ORDER BY seq) AS t FROM p GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS n_sections, sum(len(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0B]+'))) AS words FROM p GROUP BY doc_id) SELECT doc_id, n_sections, CAST(words AS BIGINT) AS words FROM n JOIN m USING (doc_id)")
def section_break_round_trip(spark, sf_dir):
    """Render chunks with markers, parse them again, count sections and words."""
    rows = chunk_table(spark, sf_dir)
    marked = F.concat_ws("\n", M.section_break(F.struct(F.col("seq").alias("id"))), "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", marked.alias("t")))), lambda x: x["t"]), "\n")
    parsed = rows.groupBy("doc_id").agg(text.alias("t")).select("doc_id", F.explode(M.sections(F.col("t"))).alias("s"))
    return parsed.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum("s.words").alias("words"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '\\bamc') OR regexp_matches(lower(p_name), '\\bacceptable means') THEN 'amc' WHEN regexp_matches(lower(p_name), '\\bgm') OR regexp_matches(lower(p_name), '\\bguidance') THEN 'guidance' WHEN regexp_matches(lower(p_name), '\\barticle') OR regexp_matches(lower(p_name), '\\bannex') THEN 'requirement' ELSE 'section' END AS topic FROM part")
def topic_types(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.topic_type(F.col("p_name")).alias("topic"))


@query(f"WITH {PARAGRAPHS}, k AS (SELECT doc_id, seq, text, CASE WHEN length(text) < 120 THEN 'item' ELSE 'row' END AS kind FROM p), h AS (SELECT *, last_value(CASE WHEN kind != 'item' THEN ends_with(text, ':') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM k),"
    " g AS (SELECT *, sum(CASE WHEN kind != 'item' OR NOT coalesce(open, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM h) SELECT doc_id, min(seq) AS seq, count(*) AS n_rows, md5(string_agg(text, chr(10) ORDER BY seq)) AS digest FROM g GROUP BY doc_id, run")
def list_merge(spark, sf_dir):
    rows = chunk_table(spark, sf_dir).select("doc_id", "seq", F.when(F.length("text") < 120, "item").otherwise("row").alias("kind"), "text")
    return lookup.merged_lists(rows).select("doc_id", "seq", "n_rows", F.md5("text").alias("digest"))


@query("WITH q AS (SELECT s_suppkey AS id, s_name FROM supplier), l AS (SELECT concat('a/', c_custkey, '.pdf') AS path, c_acctbal > 0 AS valid FROM customer), t AS (SELECT id, 0 AS pr, concat('b/', id, '.pdf') AS path FROM q UNION ALL SELECT id, 1, concat('a/', id, '.pdf') FROM q UNION ALL SELECT id, 2, concat('a/', id * 2, '.pdf') FROM q),"
    " f AS (SELECT id, arg_min(path, pr) AS path FROM t JOIN l USING (path) WHERE valid GROUP BY id) SELECT id, path, CASE WHEN path IS NOT NULL THEN 'complete' ELSE 'pending' END AS status FROM q LEFT JOIN f USING (id)")
def queue_reconcile(spark, sf_dir):
    queue = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    listing = table(spark, sf_dir, "customer").select(F.concat(F.lit("a/"), "c_custkey", F.lit(".pdf")).alias("path"), (F.col("c_acctbal") > 0).alias("valid"))
    name = lambda folder, n: F.concat(F.lit(folder), n.cast("string"), F.lit(".pdf"))
    return lookup.reconciled(queue, listing, [name("b/", F.col("id")), name("a/", F.col("id")), name("a/", F.col("id") * 2)])


@query()
def rag_context(spark, sf_dir):
    """Blocks of the five best chunks with a neighbour on each side; tested on a fixture."""
    rows = chunk_table(spark, sf_dir)
    hits = lexical.ranked(lexical.bm25(rows, "chunk_id", {"text": "text"}, ["the", "onha"]), 5, F.asc(F.round("score", 6)), F.asc("chunk_id"))
    return documents.context_blocks(rows, hits.select("chunk_id", "rank"))


@query("SELECT page_id, CASE WHEN contains(lower(html), 'just a moment') OR contains(lower(html), 'verify you are human') THEN true ELSE false END AS blocked, lpad(CAST(page_id AS VARCHAR), 6, '0') AS file_no FROM pages")
def block_page_detector(spark, sf_dir):
    marks = F.array(*map(F.lit, ["just a moment", "verify you are human"]))
    return table(spark, sf_dir, "pages").select("page_id", F.exists(marks, lambda m: F.contains(F.lower("html"), m)).alias("blocked"), F.lpad(F.col("page_id").cast("string"), 6, "0").alias("file_no"))


QUERIES, ORACLES = query.queries, query.oracles
