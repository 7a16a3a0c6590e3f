"""Catalogue, lookup joins, upserts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.acts import validity
from quarry.functions.columns import chain
from quarry.functions.text import triage
from quarry.operators import catalog as C
from quarry.operators.records import pending
from quarry.plans.search import catalog_origin, origin_of
from quarry.queries.common import PARAGRAPHS, Registry, chunk_table
from quarry.session import table

query = Registry()


@query(f"WITH {PARAGRAPHS}, n AS (SELECT doc_id, count(*) AS chunk_count FROM p GROUP BY doc_id) SELECT doc_id, lang, source, chunk_count FROM documents JOIN n USING (doc_id)")
def catalog_counts(spark, sf_dir):
    return C.counted(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), chunk_table(spark, sf_dir))


@query(f"""WITH {PARAGRAPHS}, n AS (SELECT doc_id, count(*) AS chunk_count FROM p GROUP BY doc_id), c AS (SELECT doc_id, lang, source, chunk_count FROM documents JOIN n USING (doc_id)),
    s AS (SELECT count(*) AS total, count(*) FILTER (lang = 'en' AND contains(lower(concat(source, ' ', lang)), 'src1')) AS filtered FROM c)
    SELECT doc_id, source, chunk_count, total, filtered FROM c, s WHERE lang = 'en' AND contains(lower(concat(source, ' ', lang)), 'src1') ORDER BY chunk_count DESC, doc_id LIMIT 25 OFFSET 5""")
def catalog_search_page(spark, sf_dir):
    rows = C.counted(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), chunk_table(spark, sf_dir))
    conditions = [F.lower("lang") == "en", C.all_terms(F.concat_ws(" ", "source", "lang"), "src1")]
    return C.page(rows, conditions, [F.desc("chunk_count"), F.asc("doc_id")], 25, 5).select("doc_id", "source", "chunk_count", "total", "filtered")


@query("SELECT coalesce(json_extract_string(props, '$.k'), 'Uncategorized') AS facet, count(*) AS n FROM events GROUP BY 1")
def facet_counts_json(spark, sf_dir):
    return C.facet(table(spark, sf_dir, "events"), F.get_json_object("props", "$.k"))


_TYPES = ["click", "view", "purchase", "signup", "error"]


@query("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (event_type = '{v}') AS n_{v}" for v in _TYPES) + " FROM events")
def status_rollup(spark, sf_dir):
    return C.status_roll_up(table(spark, sf_dir, "events"), F.col("event_type"), _TYPES)


@query("WITH k AS (SELECT c_nationkey % 5 AS a, c_nationkey % 7 AS b, count(*) AS n FROM customer GROUP BY 1, 2), u AS (SELECT a AS key, n FROM k UNION ALL SELECT b, n FROM k WHERE a != b) SELECT key, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY key")
def qualifier_counts_two_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("a"), (F.col("c_nationkey") % 7).alias("b"))
    return C.two_key_counts(rows, "a", "b")


@query("SELECT p_partkey, last_value(CASE WHEN p_size > 25 THEN p_name END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent_title FROM part")
def parent_title_asof(spark, sf_dir):
    return C.predecessor_title(table(spark, sf_dir, "part"), "p_partkey", F.col("p_brand"), F.col("p_name"), F.col("p_size") > 25).select("p_partkey", "parent_title")


@query("SELECT p_partkey, first_value(p_name) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS parent_title FROM part")
def parent_title_first(spark, sf_dir):
    return C.first_title(table(spark, sf_dir, "part"), F.col("p_brand"), F.col("p_name"), F.desc("p_retailprice"), F.asc("p_partkey")).select("p_partkey", "parent_title")


@query("""WITH l AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier), a AS (SELECT c_custkey, max(c_name) AS v FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1), b AS (SELECT c_nationkey, arg_max(c_name, c_custkey) AS v FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1)
    SELECT s_suppkey, coalesce(a.v, b.v) AS c_name, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 END AS strategy FROM l LEFT JOIN a ON s_suppkey = c_custkey LEFT JOIN b ON s_nationkey = c_nationkey""")
def multi_key_fallback_join(spark, sf_dir):
    right = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("k1"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("k2"))
    return C.fallback_join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), right, [("s_suppkey", "k1"), ("s_nationkey", "k2")], "c_name", "c_custkey").select("s_suppkey", "c_name", "strategy")


@query("WITH r AS (SELECT o_custkey AS target, max(o_orderkey) AS repealed_by FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, repealed_by, CASE WHEN repealed_by IS NOT NULL THEN 'REPEALED (by ' || CAST(repealed_by AS VARCHAR) || ')' WHEN c_acctbal < 0 THEN 'EXPIRED (1 May 2020)' WHEN c_acctbal < 1000 THEN 'TIME-LIMITED (expires 1 May 2030)' ELSE 'IN FORCE' END AS validity FROM customer LEFT JOIN r ON c_custkey = target")
def validity_status(spark, sf_dir):
    """The last registered repealer of each row; then expiry; else in force."""
    repeals = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("repealed_by"))
    rows = table(spark, sf_dir, "customer").join(repeals, "c_custkey", "left")
    expires = F.when(F.col("c_acctbal") < 0, "1 May 2020").when(F.col("c_acctbal") < 1000, "1 May 2030")
    return rows.select("c_custkey", "repealed_by", validity(F.col("repealed_by").cast("string"), expires, 2026).alias("validity"))


@query("SELECT a.p_partkey, max(b.p_partkey) AS repealed_by FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND b.p_partkey > a.p_partkey GROUP BY 1")
def repeal_selfjoin(spark, sf_dir):
    """The last later row of the same number."""
    return C.last_later(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey", "repealed_by").select("p_partkey", "repealed_by")


@query(f"WITH {PARAGRAPHS}, d AS (SELECT doc_id FROM documents WHERE doc_id % 100 = 0) SELECT chunk_id, min(d.doc_id) AS consulted FROM p JOIN d ON starts_with(chunk_id, concat(d.doc_id, ':')) GROUP BY chunk_id")
def prefix_theta_join(spark, sf_dir):
    """Ids that start with a document's id: the prefix is a key, so this is an equi join."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").cast("string").alias("prefix"), F.col("doc_id").alias("consulted"))
    return chunk_table(spark, sf_dir).select("chunk_id", F.substring_index("chunk_id", ":", 1).alias("prefix")).join(docs, "prefix").select("chunk_id", "consulted")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 != 0 UNION ALL SELECT o_orderkey, 'N', o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -o_orderkey, 'N', 0.0 FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey > 0")
def upsert_replace(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = old.where("o_orderkey % 10 = 0")
    new = changed.select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice")).union(old.where("o_orderkey % 100 = 0 and o_orderkey > 0").select(-F.col("o_orderkey"), F.lit("N"), F.lit(0.0)))
    return C.upsert(old, new, "o_orderkey")


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 AND p_size > 10 THEN 'new' ELSE p_brand END AS p_brand FROM part")
def upsert_partial(spark, sf_dir):
    old = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    new = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select("p_partkey", F.when(F.col("p_size") > 10, F.lit("new")).alias("p_brand"))
    return C.update_columns(old, new, "p_partkey", ["p_brand"])


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT -s_suppkey, s_name FROM supplier WHERE s_suppkey > 0")
def insert_if_absent(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = table(spark, sf_dir, "supplier").where("s_suppkey > 0").select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name")).union(old.limit(0)).union(old.where("c_custkey % 2 = 0").select("c_custkey", F.lit("ignored")))
    return C.insert_absent(old, new, "c_custkey")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, seq, text FROM p WHERE doc_id % 5 != 0 UNION ALL SELECT doc_id, 1, concat('replaced ', lang) FROM documents WHERE doc_id % 5 = 0")
def replace_partition(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id % 5 = 0")
    return C.replace_groups(chunk_table(spark, sf_dir).select("doc_id", "seq", "text"), docs.select("doc_id", F.lit(1).alias("seq"), F.concat(F.lit("replaced "), "lang").alias("text")), "doc_id")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, count(*) AS n FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id")
def delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("quality = 0")
    return C.without(chunk_table(spark, sf_dir), gone, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT user_id, event_type AS status FROM events WHERE event_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, status, max(value) AS value, bool_or(event_type = 'error') AS failed FROM events LEFT JOIN s USING (user_id) GROUP BY user_id, status")
def sparse_update(spark, sf_dir):
    """Job state after all sparse updates: the latest status that is set, the largest value."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(C.latest("event_type", "ts", "event_id").alias("status"), F.max("value").alias("value"), F.bool_or(F.col("event_type") == "error").alias("failed"))


@query("SELECT event_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS rate FROM events")
def recent_challenge_rate(spark, sf_dir):
    rows = C.recent_rate(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error", "ts", "event_id")
    return rows.select("event_id", F.round("rate", 6).alias("rate"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5(concat('s1', doc_id)), doc_id LIMIT 37")
def random_sample_hash(spark, sf_dir):
    return C.hashed_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 37, "s1")


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN 'note' WHEN source IN ('src1', 'src2') THEN 'skybrary' WHEN source = 'src3' THEN 'manual' WHEN source = 'src4' THEN 'faa' WHEN source = 'src5' THEN 'easa' WHEN source = 'src6' THEN 'manual' ELSE 'eu' END AS origin FROM documents")
def origin_classifier(spark, sf_dir):
    """By marks in the metadata, or by the id where there is none."""
    marks = {"src0": '{"origin": "note", "source": "FAA XML"}', "src1": '{"source": "SKYBRARY"}', "src2": '{"source": "SKYBRARY"}', "src3": '{"source": "Manual"}', "src4": '{"source": "FAA XML"}', "src5": '{"source": "EASA XML"}', "src6": ""}
    metadata = chain([(F.col("source") == s, F.lit(m)) for s, m in marks.items()], F.lit("{}"))
    name = F.concat(F.when(F.col("source") == "src6", "MANUAL_").otherwise("NOTE_"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", origin_of(metadata, name).alias("origin"))


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'note' WHEN source IN ('src0', 'src1') THEN 'skybrary' WHEN source = 'src2' THEN 'note' WHEN source = 'src3' THEN 'faa' WHEN source = 'src4' THEN 'manual' WHEN source = 'src5' THEN 'easa' ELSE 'eu' END AS origin FROM documents")
def origin_of_catalog_rows(spark, sf_dir):
    """The catalogue's own order of rules, which a note in the metadata overrides."""
    source = F.when(F.col("source") == "src0", "SKYBRARY").when(F.col("source") == "src4", "Custom").otherwise("x")
    key = F.concat(F.when(F.col("source") == "src1", "SKYBRARY_").when(F.col("source") == "src2", "NOTE_").otherwise("D"), F.col("doc_id").cast("string"))
    title = F.when(F.col("source") == "src3", "14 CFR part 1").when(F.col("source") == "src5", "Easy Access Rules").otherwise("Title")
    metadata = F.when(F.col("lang") == "de", '{"origin": "note"}').otherwise("{broken")
    return table(spark, sf_dir, "documents").select("doc_id", catalog_origin(source, key, title, metadata).alias("origin"))


@query("SELECT p_partkey, CASE WHEN p_size > 30 THEN p_name WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN p_brand || ' — Annex I' ELSE 'Annex I' END WHEN p_size % 2 = 0 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS title FROM part")
def enriched_titles(spark, sf_dir):
    raw = F.when(F.col("p_size") > 30, F.col("p_name")).when(F.col("p_size") % 3 == 0, "Annex I").otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", C.enriched_title(raw, F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_partkey").cast("string")).alias("title"))


@query("SELECT ps AS page, min(k) AS chosen FROM (SELECT l_orderkey AS ps, l_linenumber AS k, l_quantity AS score, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best FROM lineitem) WHERE score = best GROUP BY 1")
def chosen_link(spark, sf_dir):
    """The link of the greatest score on each page; of equal ones the first."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("k"), "l_quantity")
    return C.best_of(rows, "page", "l_quantity", "k").select("page", F.col("k").alias("chosen"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'customer_0000%1%'")
def like_filter(spark, sf_dir):
    """Case-insensitive LIKE in which _ stands for any character."""
    return table(spark, sf_dir, "customer").where(F.col("c_name").ilike("customer_0000%1%")).select("c_custkey", "c_name")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 3 AND 5 AND length(trim(event_type)) >= 5")
def json_band_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").cast("int").between(3, 5) & (F.length(F.trim("event_type")) >= 5)).select("event_id")


@query("SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, round(sum(coalesce(o_totalprice, 0)), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def linked_report(spark, sf_dir):
    """Qualifiers under parents under groups: inner and left joins with counts."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    linked = C.linked_totals(rows, t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["r_name", "n_name"], "o_totalprice")
    return linked.select("r_name", "n_name", F.col("members").alias("customers"), F.col("links").alias("orders"), F.round("total", 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 4) AS avg_disc FROM lineitem GROUP BY 1, 2")
def line_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 4).alias("avg_disc"))


@query("""WITH s AS (SELECT p_partkey, (least(p_size, 10) + p_partkey % 11) / 2.0 AS score FROM part), p AS (SELECT *, CAST(round_even(score * 10, 0) AS INT) AS priority FROM s)
    SELECT p_partkey, round_even(score, 2) AS score, priority, CASE WHEN priority >= 75 THEN 'critical' WHEN priority >= 50 THEN 'medium' WHEN priority >= 25 THEN 'low' ELSE 'ignore' END AS bucket FROM p""")
def triage_priority(spark, sf_dir):
    """Scores of two dimensions, clamped to ten and weighed alike."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 11).cast("double").alias("b"))
    score, priority, bucket = triage({"a": 1.0, "b": 1.0})
    return rows.select("p_partkey", score.alias("score"), priority.alias("priority"), bucket.alias("bucket"))


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id % 3 = 0 OR (user_id % 3 = 1 AND event_id % 5 < 3) GROUP BY 1")
def queue_filters(spark, sf_dir):
    """Pending rows and failed ones that may be tried again, by type."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", F.when(F.col("user_id") % 3 == 0, "pending").when(F.col("user_id") % 3 == 1, "error").otherwise("complete").alias("status"), (F.col("event_id") % 5).alias("attempts"), F.lit(0).alias("priority"))
    return pending(rows).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES, ORACLES = query.queries, query.oracles
