"""Text analytics over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.columns import found
from quarry.operators.catalog import latest
from quarry.operators.furniture import page_furniture as furniture
from quarry.queries.common import PARAGRAPHS, Registry, chunk_table, texts
from quarry.session import table
from quarry.sources import html

query = Registry()

# The corpus holds no English modals, so words it does hold stand for them.
_LENS = {"mandates": "the", "prohibitions": "of", "permissions": "to", "exceptions": "not"}
_MODAL = [("of the", "OF_THE", "COMPOUND"), ("the", "THE", "OBLIGATION"), ("and", "AND", "PERMISSION")]


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '(?i){p}')) AS INT) AS {n}" for n, p in _LENS.items()) + " FROM documents")
def requirement_lens(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", *T.lens(F.col("text"), _LENS))


@query(f"WITH {PARAGRAPHS} SELECT chunk_id, CASE WHEN contains(lower(text), 'of the') THEN 'OF_THE' WHEN contains(lower(text), 'the') THEN 'THE' WHEN contains(lower(text), 'and') THEN 'AND' END AS modality, CASE WHEN contains(lower(text), 'of the') THEN 'COMPOUND' WHEN contains(lower(text), 'the') THEN 'OBLIGATION' WHEN contains(lower(text), 'and') THEN 'PERMISSION' END AS legal_role, nullif(regexp_extract(text, '(?i)the (\\w+) of', 1), '') AS subject FROM p")
def modality_role(spark, sf_dir):
    modality, role = T.modality(F.col("text"), _MODAL)
    return chunk_table(spark, sf_dir).select("chunk_id", modality.alias("modality"), role.alias("legal_role"), found(F.col("text"), r"(?i)the (\w+) of").alias("subject"))


@query(f"WITH {PARAGRAPHS} SELECT chunk_id, CAST(len(regexp_extract_all(text, '[.!?]\\s+[A-Z0-9(]')) + 1 AS INT) AS n_sentences FROM p")
def modal_sentences(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("chunk_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query(f"WITH {PARAGRAPHS} SELECT chunk_id, coalesce(nullif(regexp_extract(text, '(on[a-z]+) the', 1), ''), nullif(regexp_extract(text, '([a-z]+ing) of', 1), ''), nullif(regexp_extract(text, 'to ([a-z]+)', 1), '')) AS party FROM p")
def responsible_party(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("chunk_id", T.responsible(F.col("text"), ["(on[a-z]+) the", "([a-z]+ing) of", "to ([a-z]+)"]).alias("party"))


_SET = "list_distinct(list_filter(list_transform(string_split_regex(lower({0}), '\\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w != ''))"


@query(f"WITH w AS (SELECT doc_id, {_SET.format('text')} AS s FROM documents) SELECT a.doc_id, round(100.0 * len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))) AS percent FROM w a JOIN w b ON b.doc_id = a.doc_id + 1")
def jaccard_word_diff(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", T.word_set(F.col("text")).alias("a"))
    other = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return rows.join(other, "doc_id").select("doc_id", T.jaccard_percent(F.col("a"), F.col("b")).alias("percent"))


@query("WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9/-]+', ' ', 'g'), ' '), lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('tion', 'that')))) AS term FROM documents) SELECT term, count(*) AS docs FROM t GROUP BY term HAVING count(*) >= 2 ORDER BY docs DESC, term LIMIT 14")
def shared_concepts(spark, sf_dir):
    terms = texts(spark, sf_dir).select(F.explode(T.concept_terms(F.col("text"), ["tion", "that"])).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("docs")).where("docs >= 2").orderBy(F.desc("docs"), "term").limit(14)


_Q = r"""SELECT doc_id, CAST(length(text) AS INT) AS n_chars, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]')) AS INT) AS n_alnum, CAST(len(regexp_extract_all(text, '�')) AS INT) AS n_replacement, CAST(len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')) AS INT) AS n_control, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*')) AS INT) AS n_words FROM documents"""


@query(_Q)
def char_quality(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in T.quality_counts(F.col("text")).items()))


@query(f"WITH q AS ({_Q}) SELECT doc_id, CASE WHEN n_words < 20 THEN 'FAIL' WHEN n_alnum < 0.7 * n_chars THEN 'WARN' WHEN n_chars > 6000 THEN 'WARN' ELSE 'PASS' END AS status, concat_ws('; ', CASE WHEN n_words < 20 THEN 'too few words' END, CASE WHEN n_alnum < 0.7 * n_chars THEN 'few letters' END, CASE WHEN n_chars > 6000 THEN 'long' END) AS reasons FROM q")
def quality_gate(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in T.quality_counts(F.col("text")).items()))
    status, reasons = T.gate([(F.col("n_words") < 20, "FAIL", "too few words"), (F.col("n_alnum") < 0.7 * F.col("n_chars"), "WARN", "few letters"), (F.col("n_chars") > 6000, "WARN", "long")])
    return rows.select("doc_id", status.alias("status"), reasons.alias("reasons"))


@query(f"""WITH {PARAGRAPHS}, n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS b FROM p),
    k AS (SELECT source, trim(text) AS line, count(DISTINCT doc_id) AS times FROM r WHERE a <= 2 OR b <= 3 GROUP BY 1, 2)
    SELECT source, line, times FROM k JOIN n USING (source) WHERE times >= greatest(3, floor(0.03 * pages))""")
def page_furniture(spark, sf_dir):
    """Documents stand for pages, sources for their files."""
    return furniture(chunk_table(spark, sf_dir), texts(spark, sf_dir), "source", 0.03)


@query(f"WITH {PARAGRAPHS} SELECT chunk_id, array_to_string(string_split_regex(trim(text), '\\s+')[1:50], ' ') || CASE WHEN len(string_split_regex(trim(text), '\\s+')) > 50 THEN '...' ELSE '' END AS snippet FROM p")
def snippets(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("chunk_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS normal FROM documents")
def query_normalize(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.normalised_query(F.col("text")).alias("normal"))


@query("SELECT user_id, event_id AS reused FROM events WHERE event_type = 'purchase' AND value >= 20 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def query_normalize_reuse(spark, sf_dir):
    """The newest finished job of each key whose level suffices; of equal times the greatest id."""
    done = table(spark, sf_dir, "events").where("event_type = 'purchase' and value >= 20")
    return done.groupBy("user_id").agg(latest("event_id", "ts", "event_id").alias("reused"))


_Y, _N = "1995 + o_orderkey % 30", "1 + o_custkey % 12000"
_TITLE_SQL = f"""CASE o_orderkey % 5 WHEN 0 THEN 'Commission Regulation (EU) ' || CAST({_Y} AS VARCHAR) || '/' || CAST({_N} AS VARCHAR) || ' of 4 July' WHEN 1 THEN 'Council Regulation (EEC) No ' || CAST(1 + o_custkey % 4000 AS VARCHAR) || '/' || CAST(60 + o_orderkey % 40 AS VARCHAR)
    WHEN 2 THEN 'Directive ' || CAST({_Y} AS VARCHAR) || '/' || CAST(1 + o_custkey % 900 AS VARCHAR) || '/EC' WHEN 3 THEN 'Council Directive ' || CAST(60 + o_orderkey % 40 AS VARCHAR) || '/' || CAST(1 + o_custkey % 900 AS VARCHAR) || '/EEC' ELSE 'No number here' END"""
_PARSED = f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'R' WHEN 2 THEN 'L' WHEN 3 THEN 'L' END AS letter, CAST(CASE o_orderkey % 5 WHEN 0 THEN {_Y} WHEN 2 THEN {_Y} WHEN 1 THEN 1960 + o_orderkey % 40 WHEN 3 THEN 1960 + o_orderkey % 40 END AS INT) AS year,
    CAST(CASE o_orderkey % 5 WHEN 0 THEN {_N} WHEN 1 THEN 1 + o_custkey % 4000 WHEN 2 THEN 1 + o_custkey % 900 WHEN 3 THEN 1 + o_custkey % 900 END AS INT) AS number FROM orders"""


def _titles(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TITLE_SQL.replace("VARCHAR", "STRING")).alias("title"))


@query(_PARSED)
def doc_number_parse(spark, sf_dir):
    return _titles(spark, sf_dir).select("o_orderkey", T.act_number(F.col("title")).alias("a")).select("o_orderkey", "a.letter", "a.year", "a.number")


@query(f"SELECT o_orderkey, '3' || CAST(year AS VARCHAR) || letter || CASE WHEN number >= 1000 THEN CAST(number AS VARCHAR) ELSE lpad(CAST(number AS VARCHAR), 4, '0') END AS celex FROM ({_PARSED})")
def celex_build(spark, sf_dir):
    return _titles(spark, sf_dir).select("o_orderkey", T.act_number(F.col("title")).alias("a")).select("o_orderkey", T.celex(F.col("a.letter"), F.col("a.year"), F.col("a.number")).alias("celex"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, 'of ([a-z]+)', 1), regexp_extract_all(text, 'to ([a-z]+)', 1)))), ',') AS refs FROM documents")
def refs_amend_repeal(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.array_join(T.sorted_matches(F.col("text"), ["of ([a-z]+)", "to ([a-z]+)"]), ",").alias("refs"))


@query(f"WITH {PARAGRAPHS} SELECT chunk_id, concat('Title: ', source, CASE WHEN lang != 'en' THEN chr(10) || 'Section: ' || lang ELSE '' END, chr(10), text) AS embedding_text FROM p")
def embedding_text_templates(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("chunk_id", T.embedding_text(F.col("source"), F.when(F.col("lang") != "en", F.col("lang")), F.col("text")).alias("embedding_text"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, md5(url) AS h FROM pages")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), F.md5("url").alias("h"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS INT) AS n_links FROM pages")
def html_link_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(html.hrefs(F.col("html"))).alias("n_links"))


@query()
def html_anchor_extract(spark, sf_dir):
    """Anchors of every page with their texts; tested on a fixture."""
    return html.anchors(table(spark, sf_dir, "pages"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.pdf($|\\?)') THEN 100 ELSE 0 END + CASE WHEN contains(lower(html), 'download') THEN 25 ELSE 0 END + CASE WHEN contains(lower(html), 'license') THEN 10 ELSE 0 END AS score FROM pages")
def url_link_score(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_score(F.col("url"), F.col("html"), "license").alias("score"))


@query(f"WITH {PARAGRAPHS} SELECT chunk_id, regexp_replace(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(onha|the)', '\\1<mark>\\2</mark>', 'g') AS marked FROM p")
def highlights(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("chunk_id", T.highlighted(F.col("text"), ["the", "onha"]).alias("marked"))


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \\t]+\\n', chr(10), 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g') AS text FROM documents")
def conservative_normalise(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.clean(F.regexp_replace("text", "\r", "")).alias("text"))


QUERIES, ORACLES = query.queries, query.oracles
