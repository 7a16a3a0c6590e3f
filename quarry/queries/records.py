"""Queues, jobs, notes, collections, trees and report texts over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import records as R
from quarry.operators import trees
from quarry.plans import library
from quarry.queries.common import Registry, texts
from quarry.session import table
from quarry.sources import sinks

query = Registry()

_QUEUE = "q AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'complete' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 5 AS INT) END AS attempts, CAST(o_custkey % 10 AS INT) AS priority, CASE WHEN o_orderkey % 4 = 1 THEN 'old' END AS last_error FROM orders)"


def _queue(spark, sf_dir):
    key = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ["pending", "error", "complete", "pending"])), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), status.alias("status"), F.when(key % 7 > 0, (key % 5).cast("int")).alias("attempts"), (F.col("o_custkey") % 10).cast("int").alias("priority"), F.when(key % 4 == 1, "old").alias("last_error"))


@query(f"WITH {_QUEUE} SELECT id, status, priority FROM q WHERE status = 'pending' OR (status = 'error' AND coalesce(attempts, 0) < 3)")
def queue_pending(spark, sf_dir):
    return R.pending(_queue(spark, sf_dir)).select("id", "status", "priority")


@query(f"""WITH {_QUEUE} SELECT id, CASE WHEN id % 9 = 0 AND id % 2 = 0 THEN 'complete' WHEN id % 9 = 0 THEN 'error' ELSE status END AS status, coalesce(attempts, 0) + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS attempts,
    CASE WHEN id % 9 = 0 THEN CASE WHEN id % 2 = 1 THEN repeat('e', 4000) END ELSE last_error END AS last_error FROM q""")
def queue_after_attempts(spark, sf_dir):
    queue = _queue(spark, sf_dir)
    outcomes = queue.where("id % 9 = 0").select("id", F.when(F.col("id") % 2 == 1, F.repeat(F.lit("e"), F.lit(5000))).alias("error"))
    return R.after_attempts(queue, outcomes).select("id", "status", "attempts", "last_error")


@query(f"WITH {_QUEUE} SELECT id, CASE WHEN status = 'error' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'error' THEN 0 ELSE attempts END AS attempts, CASE WHEN status != 'error' THEN last_error END AS last_error FROM q")
def queue_reset_failed(spark, sf_dir):
    return R.reset_failed(_queue(spark, sf_dir)).select("id", "status", "attempts", "last_error")


_JOBS = "j AS (SELECT event_id AS job_id, user_id, event_type || ' ' || CAST(user_id AS VARCHAR) AS query, ['PENDING', 'RUNNING', 'FAILED', 'COMPLETED'][event_id % 4 + 1] AS status, ts AS created, event_id % 3 AS n_gaps FROM events)"


def _jobs(spark, sf_dir):
    key = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ["PENDING", "RUNNING", "FAILED", "COMPLETED"])), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(key.alias("job_id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("query"), status.alias("status"), F.col("ts").alias("created"), F.array_repeat(F.lit("gap"), (key % 3).cast("int")).alias("gaps"))


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN status IN ('PENDING', 'RUNNING') THEN 'FAILED' ELSE status END AS status FROM j")
def jobs_interrupted(spark, sf_dir):
    return R.interrupted(_jobs(spark, sf_dir)).select("job_id", "status")


@query(f"""WITH {_JOBS}, old AS (SELECT * FROM j WHERE job_id % 2 = 0), new AS (SELECT min(job_id) AS job_id, query FROM j WHERE job_id % 2 = 1 GROUP BY query)
    SELECT job_id, query FROM old UNION ALL SELECT job_id, query FROM new WHERE query NOT IN (SELECT query FROM old WHERE status != 'FAILED')""")
def jobs_without_repeats(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return R.with_new_jobs(jobs.where("job_id % 2 = 0"), jobs.where("job_id % 2 = 1"), T.normalised_query).select("job_id", "query")


@query(f"WITH {_JOBS} SELECT job_id, status, status = 'COMPLETED' AND n_gaps > 0 AS has_gaps FROM j ORDER BY created DESC, job_id LIMIT 50")
def jobs_latest(spark, sf_dir):
    return R.job_list(_jobs(spark, sf_dir)).select("job_id", "status", "has_gaps")


@query("""WITH n AS (SELECT c_custkey AS note_id, c_mktsegment AS project, c_acctbal AS created FROM customer WHERE contains(lower(c_mktsegment), 'build')), k AS (SELECT o_custkey AS note_id, count(*) AS n_chunks FROM orders GROUP BY 1)
    SELECT note_id, project, coalesce(n_chunks, 0) AS n_chunks FROM n LEFT JOIN k USING (note_id) ORDER BY created DESC, note_id LIMIT 100""")
def notes_of_project(spark, sf_dir):
    notes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note_id"), F.col("c_mktsegment").alias("project"), F.col("c_acctbal").alias("created"))
    return R.notes_of(notes, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")), "Build").select("note_id", "project", "n_chunks")


@query("SELECT event_id, event_type, user_id % 2 = 0 AS pinned FROM events WHERE contains(lower(event_type), 'ic') OR contains(lower(CAST(user_id AS VARCHAR)), 'ic') OR user_id % 5 = 0")
def memories_found(spark, sf_dir):
    """Words in the query, the answer or any tag."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_type").alias("query"), F.col("user_id").cast("string").alias("answer"), F.when(F.col("user_id") % 5 == 0, F.array(F.lit("Topics"), F.lit("x"))).alias("tags"), (F.col("user_id") % 2 == 0).alias("pinned"), F.col("ts").alias("created"))
    return R.remembered(rows, "IC").select("event_id", "event_type", "pinned")


@query("SELECT event_id, (event_id % 3 = 0) != (user_id % 2 = 0) AS pinned FROM events")
def flags_toggled(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3 == 0).alias("pinned"))
    return R.toggled(rows, rows.where("user_id % 2 = 0"), "event_id", "pinned").select("event_id", "pinned")


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey % 2 = 0) != (o_orderkey % 3 = 0)")
def pins_symmetric_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return R.symmetric_difference(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 3 = 0"), "o_orderkey")


@query("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier)")
def ids_union(spark, sf_dir):
    frames = (table(spark, sf_dir, n).select(F.col(c).alias("k")) for n, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")))
    return R.joined_ids(*frames, key="k")


@query("""SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || CAST(r_regionkey AS VARCHAR) || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS markdown FROM region""")
def dossier_markdown(spark, sf_dir):
    rows = R.as_markdown(table(spark, sf_dir, "region"), ["r_regionkey", "r_name"], F.asc("r_regionkey"))
    return rows.select(F.regexp_replace("markdown", r"\n\| --- \| --- \|\n|\n\|( ---) \| --- \|\n", "\n| --- | --- |\n").alias("markdown"))


@query("SELECT o_orderkey, coalesce(c_name, 'unknown') AS title, coalesce(c_mktsegment, 'eu') AS origin FROM orders LEFT JOIN customer ON o_custkey + o_orderkey % 2 * 1000000 = c_custkey")
def looked_up_with_defaults(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 2 * 1000000).alias("k"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("origin"))
    return R.filled(rows, known, "k", {"title": "unknown", "origin": "eu"}).select("o_orderkey", "title", "origin")


@query("""WITH n AS (SELECT o_custkey AS k, count(*) FILTER (o_orderkey % 3 = 0) AS n FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(nullif(a.n, 0), nullif(b.n, 0), nullif(d.n, 0), 0) AS n FROM customer LEFT JOIN n a ON a.k = c_custkey LEFT JOIN n b ON b.k = c_custkey + 1 LEFT JOIN n d ON d.k = c_nationkey""")
def first_nonzero_count(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count_if(F.col("o_orderkey") % 3 == 0).alias("n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") + 1).alias("second"), F.col("c_nationkey").cast("long").alias("third"))
    return R.first_count(rows, counts, ["c_custkey", "second", "third"]).select("c_custkey", "n")


@query("""WITH c AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'a:' || o_custkey WHEN 1 THEN 'A:' || o_custkey ELSE 'zz:' || o_custkey END AS cited, o_custkey AS k, o_orderkey % 3 AS way FROM orders)
    SELECT cited, CASE WHEN way = 2 AND c_custkey IS NOT NULL THEN c_name ELSE coalesce(c_name, 'none given') END AS text, CASE WHEN c_name IS NULL THEN 'none' ELSE ['chunks:exact', 'chunks:normalised', 'chunks:suffix'][way + 1] END AS how FROM c LEFT JOIN customer ON k = c_custkey AND c_custkey % 2 = 0""")
def excerpts_of_citations(spark, sf_dir):
    key = F.col("o_custkey").cast("string")
    cited = table(spark, sf_dir, "orders").select(F.concat(F.element_at(F.array(F.lit("a:"), F.lit("A:"), F.lit("zz:")), (F.col("o_orderkey") % 3 + 1).cast("int")), key).alias("cited"))
    rows = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("a:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("text"))
    return R.excerpts(cited, [("chunks", rows)], F.lower, "none given")


@query("""WITH h AS (SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders),
    b AS (SELECT a.chunk_id, b.chunk_id AS related_id, row_number() OVER (PARTITION BY a.chunk_id ORDER BY b.rank) AS n FROM h a JOIN h b USING (doc_id) WHERE a.chunk_id != b.chunk_id) SELECT * FROM b WHERE n <= 3""")
def related_of_same_document(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    chunks = orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"))
    return R.same_document(chunks, orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("rank")))


@query("SELECT p_partkey FROM part WHERE p_partkey % 50 IN (7, 11) OR p_partkey = 7 OR p_size = 11 OR contains(p_name, '1')")
def qualifiers_of_act(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("qualifier_id"), (F.col("p_partkey") % 50).cast("string").alias("parent_id"), F.col("p_size").cast("string").alias("celex"), F.col("p_name").alias("target_ref"))
    return R.qualifiers_of(rows, {"id": "7", "celex": "11", "number": "1"}).select("p_partkey")


# Trees: every line of a document is a node, at depths 0, 1, 2, 1 in turn.
_NODES = r"""n AS (SELECT doc_id, i AS node_id, [0, 1, 2, 1][(i - 1) % 4 + 1] AS depth, ['section', 'article', 'item', 'paragraph'][(i - 1) % 4 + 1] AS type, CASE WHEN (i - 1) % 4 IN (1, 2) THEN CAST(i AS VARCHAR) END AS number, CASE WHEN (i - 1) % 4 = 0 THEN 'S' || CAST(i AS VARCHAR) END AS title, CASE WHEN (i - 1) % 4 > 0 THEN trim(l) END AS text
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))"""


def _nodes(spark, sf_dir):
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    turn = F.col("i") % 4
    of = lambda *values: F.element_at(F.array(*map(F.lit, values)), turn + 1)
    n = (F.col("i") + 1).cast("string")
    return lines.select("doc_id", (F.col("i") + 1).alias("node_id"), of(0, 1, 2, 1).alias("depth"), of("section", "article", "item", "paragraph").alias("type"), F.when(turn.isin(1, 2), n).alias("number"), F.when(turn == 0, F.concat(F.lit("S"), n)).alias("title"), F.when(turn > 0, F.trim("line")).alias("text"), F.lit("T").alias("doc_title"))


@query(f"""WITH {_NODES}, w AS (SELECT *, last_value(CASE WHEN depth = 0 THEN title END IGNORE NULLS) OVER o AS s, last_value(CASE WHEN type = 'article' THEN number END IGNORE NULLS) OVER o AS a, sum(CASE WHEN type IN ('paragraph', 'item', 'article') AND text != '' THEN 1 ELSE 0 END) OVER o - 1 AS seq, last_value(CASE WHEN type = 'article' THEN node_id END IGNORE NULLS) OVER o AS art FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY node_id))
    SELECT doc_id, CAST(seq AS BIGINT) AS seq, type AS chunk_type, CASE type WHEN 'article' THEN s || '/Article ' || number WHEN 'item' THEN s || '/Article ' || a || '/' || number ELSE s END AS path, CASE type WHEN 'article' THEN number WHEN 'item' THEN a || ':' || number ELSE '0' END AS place, text FROM w WHERE type != 'section' AND text != ''""")
def tree_chunks(spark, sf_dir):
    """Path, numbers and type inherited from the nodes above."""
    chunks = trees.chunks_of(_nodes(spark, sf_dir))
    place = F.element_at(F.split("chunk_id", ":", 2), 2)
    return chunks.select("doc_id", F.col("seq").cast("long").alias("seq"), "chunk_type", F.array_join("path", "/").alias("path"), F.regexp_replace(place, ":[0-9]+$", "").alias("place"), "text")


@query(f"""WITH {_NODES}, e AS (SELECT a.doc_id, a.node_id, count(b.node_id) AS n_below FROM n a LEFT JOIN n b ON a.doc_id = b.doc_id AND b.node_id > a.node_id AND b.node_id < a.node_id + CASE a.depth WHEN 0 THEN 4 WHEN 1 THEN CASE a.type WHEN 'article' THEN 2 ELSE 1 END ELSE 1 END GROUP BY 1, 2)
    SELECT doc_id, node_id, n_below FROM e""")
def tree_descendants(spark, sf_dir):
    return trees.subtree_texts(_nodes(spark, sf_dir)).select("doc_id", F.col("node_id").cast("long").alias("node_id"), "n_below")


# Outlines: the lines of a document in sixes, labelled as a number, letters and romans; in fives, a text that announces four items, two of them below the first.
_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents)"


def _lines(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).withColumn("seq", F.col("i").cast("long"))


@query(f"WITH {_LINES} SELECT doc_id, i AS seq, CASE i % 6 WHEN 0 THEN NULL WHEN 2 THEN i - 1 WHEN 3 THEN i - 2 ELSE i - i % 6 END AS point_parent, [0, 1, 2, 2, 1, 1][i % 6 + 1] AS point_level FROM l")
def tree_nested_points(spark, sf_dir):
    label = F.element_at(F.array(F.concat((F.floor(F.col("i") / 6) + 1).cast("string"), F.lit(".")), *(F.lit(x) for x in ("(a)", "(i)", "(ii)", "(b)", "(c)"))), F.col("i") % 6 + 1)
    rows = _lines(spark, sf_dir).select("doc_id", "seq", F.lit("item").alias("type"), label.alias("number"))
    return trees.nested_points(rows).select("doc_id", "seq", "point_parent", "point_level")


@query(f"""WITH {_LINES}, r AS (SELECT doc_id, i, i % 10 AS k, CASE WHEN i % 10 IN (0, 6) THEN trim(line) || ':' ELSE trim(line) || '.' END AS x FROM l),
    h AS (SELECT *, CASE WHEN k <= 4 THEN i - k WHEN k = 5 THEN i WHEN k IN (6, 7, 8) THEN i - k + 6 ELSE i END AS head, ['', 'a', 'b', 'c', 'd', '', '', 'i', 'ii', ''][k + 1] AS n FROM r)
    SELECT doc_id, head AS seq, CASE WHEN count(*) > 1 THEN 'merged_list' WHEN min(k) IN (0, 5) THEN 'text' ELSE 'item' END AS chunk_type, string_agg(CASE WHEN i = head THEN x ELSE n || ' ' || x END, chr(10) ORDER BY i) AS text, CAST(count(*) AS INTEGER) AS n_rows FROM h GROUP BY doc_id, head""")
def tree_merged_lists(spark, sf_dir):
    """Tens of lines: a text that announces four items, a text that announces none, an item that announces the two below it, and one after them."""
    k = F.col("i") % 10
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), k + 1)
    numbers = F.when(k.isin(0, 5), F.array().cast("array<string>")).when(k <= 4, F.array(of(["", "a", "b", "c", "d", "", "", "", "", ""]))).when(k.isin(7, 8), F.array(F.lit("1"), of([""] * 7 + ["i", "ii", ""]))).otherwise(F.array(of([""] * 6 + ["1", "", "", "2"])))
    rows = _lines(spark, sf_dir).select("doc_id", "seq", F.concat_ws(":", "doc_id", "seq").alias("chunk_id"), F.when(k.isin(0, 5), "text").otherwise("item").alias("chunk_type"), F.concat(F.trim("line"), F.when(k.isin(0, 6), ":").otherwise(".")).alias("text"), numbers.alias("numbers"))
    return trees.merged(rows).select("doc_id", "seq", "chunk_type", "text", "n_rows")


@query(f"""WITH {_NODES}, l AS (SELECT doc_id, node_id, CASE type WHEN 'section' THEN '# ' || title WHEN 'article' THEN '## Article ' || number || CASE WHEN text != '' THEN chr(10) || chr(10) || text ELSE '' END WHEN 'item' THEN '- ' || number || ' ' || text ELSE text END AS line FROM n)
    SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY node_id) AS text FROM l WHERE line != '' GROUP BY 1""")
def tree_markdown(spark, sf_dir):
    return trees.rendered(_nodes(spark, sf_dir))


@query("""WITH p AS (SELECT page_id % 40 AS f, length(coalesce(html, '')) AS n, page_id % 3 = 0 AS r, page_id % 100 AS c FROM pages)
    SELECT CAST(f AS VARCHAR) AS path, count(*) AS pages, sum(n)::BIGINT AS n_chars, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0 END), 4) AS text_share, count(*) FILTER (r) AS recognised_pages, round(avg(c) FILTER (r), 2) AS confidence FROM p GROUP BY 1""")
def page_roll_up(spark, sf_dir):
    key = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select((key % 40).cast("string").alias("path"), F.char_length(F.coalesce("html", F.lit(""))).alias("n_chars"), F.lit(1).alias("n_words"), (key % 3 == 0).alias("recognised"), (key % 100).alias("confidence"))
    return sinks.file_roll_up(rows).drop("n_words")


@query("SELECT CASE WHEN n_chars < 200 THEN 'FAIL' WHEN n_chars < 1000 THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS files FROM documents GROUP BY 1")
def extraction_status(spark, sf_dir):
    status, _ = T.gate([(F.col("n_chars") < 200, "FAIL", "too short"), (F.col("n_chars") < 1000, "WARN", "short")])
    return sinks.status_counts(table(spark, sf_dir, "documents").select(status.alias("status")))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w != '')) AS INT) AS n_words, length(coalesce(text, '')) AS n_chars FROM documents")
def words_and_characters(spark, sf_dir):
    counts = T.words_characters_citations(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", counts["n_words"].alias("n_words"), counts["n_chars"].alias("n_chars"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: NOT regexp_full_match(lower(trim(l)), '(?:(?:page|p\.)\s*)?[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?')), chr(10)) AS text FROM documents")
def furniture_lines(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.without_furniture(F.coalesce("text", F.lit("")), T.FURNITURE[:1]).alias("text"))


@query("SELECT doc_id, nfc_normalize(coalesce(text, '')) AS text FROM documents")
def composed_letters(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.composed(F.coalesce("text", F.lit(""))).alias("text"))


_SHELF = "SELECT c_custkey AS doc_id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN 'note' ELSE 'eu' END AS origin, c_mktsegment AS stakeholder, CAST(c_custkey % 40 AS VARCHAR) AS celex FROM customer"


def _shelf(spark, sf_dir):
    key = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.col("c_name").alias("title"), F.when(key % 3 == 0, "note").otherwise("eu").alias("origin"), F.col("c_mktsegment").alias("stakeholder"), F.lit("2020").alias("date"), (key % 40).cast("string").alias("celex"), F.lit(None).cast("string").alias("doc_number"))
    orders = table(spark, sf_dir, "orders")
    chunks = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("text"))
    marks = orders.select((F.col("o_custkey") % 60).cast("string").alias("parent_id"), (F.col("o_orderkey") % 50).cast("string").alias("celex"))
    return docs, chunks, marks


@query(f"""WITH d AS ({_SHELF}), n AS (SELECT o_custkey AS doc_id, count(*) AS chunk_count FROM orders GROUP BY 1),
    q AS (SELECT key, sum(n) AS n FROM (SELECT CAST(o_custkey % 60 AS VARCHAR) AS key, 1 AS n FROM orders UNION ALL SELECT CAST(o_orderkey % 50 AS VARCHAR), 1 FROM orders WHERE o_orderkey % 50 != o_custkey % 60) GROUP BY 1),
    c AS (SELECT d.doc_id, title, chunk_count, coalesce(nullif(a.n, 0), nullif(b.n, 0), 0)::BIGINT AS qualifier_count, origin = 'note' AND lower(stakeholder) = 'building' AND contains(lower(title), '1') AS kept FROM d JOIN n USING (doc_id) LEFT JOIN q a ON a.key = CAST(d.doc_id AS VARCHAR) LEFT JOIN q b ON b.key = celex)
    SELECT doc_id, title, chunk_count, qualifier_count, (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c WHERE kept) AS filtered FROM c WHERE kept ORDER BY chunk_count DESC, doc_id LIMIT 50""")
def catalog_page_scoped(spark, sf_dir):
    """The catalogue by origin, stakeholder and words, with counts of qualifiers."""
    docs, chunks, marks = _shelf(spark, sf_dir)
    page = library.catalog_page(docs, chunks, marks, "1", "notes", "Building", limit=50)
    return page.select("doc_id", "title", "chunk_count", "qualifier_count", "total", "filtered")


@query(f"""WITH d AS ({_SHELF}), w AS (SELECT DISTINCT o_custkey * 2 AS doc_id FROM orders), t AS (SELECT o_custkey AS doc_id, count(*) AS n_chunks, string_agg(o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY 1)
    SELECT doc_id, coalesce(title, CAST(doc_id AS VARCHAR)) AS title, coalesce(origin, 'eu') AS origin, coalesce(n_chunks, 0) AS n_chunks, coalesce(text, '') AS text FROM w LEFT JOIN d USING (doc_id) LEFT JOIN t USING (doc_id)""")
def batch_of_documents(spark, sf_dir):
    """Titles, origins and whole texts of wanted documents; unknown ones stay."""
    docs, chunks, _ = _shelf(spark, sf_dir)
    return library.batch(chunks.select((F.col("doc_id") * 2).alias("doc_id")), docs, chunks)


@query(f"""WITH d AS ({_SHELF}), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    t AS (SELECT o_custkey AS doc_id, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey)[1:1500] AS text FROM n WHERE i <= 4 GROUP BY 1) SELECT doc_id AS id, concat_ws(chr(10), title, text) AS text FROM d LEFT JOIN t USING (doc_id)""")
def act_embedding_texts(spark, sf_dir):
    docs, chunks, _ = _shelf(spark, sf_dir)
    return library.act_texts(docs, chunks)


QUERIES, ORACLES = query.queries, query.oracles
