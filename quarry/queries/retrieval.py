"""Lexical and dense retrieval, fusion and workspace search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.columns import dot, normalised
from quarry.operators import catalog, dense, lexical
from quarry.operators.chunks import per_group_top
from quarry.plans import search
from quarry.queries.common import PARAGRAPHS, WORDS, Registry, chunk_table, texts
from quarry.session import table

query = Registry()
TERMS = ["the", "onha"]
_W = WORDS.format("text")


def _bm25_sql(source: str, key: str, terms: list[str], weights: dict[str, float], top: str, cols: str = "") -> str:
    """BM25 in SQL over a table with the token lists named in weights."""
    n_len = " + ".join(f"len({c})" for c in weights)
    fs = ", ".join("(" + " + ".join(f"{w} * len(list_filter({c}, lambda x: x = '{t}'))" for c, w in weights.items()) + f") AS f{k}" for k, t in enumerate(dict.fromkeys(terms)))
    kinds = list(dict.fromkeys(terms))
    ds = ", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(len(kinds)))
    idf = lambda k: f"CASE WHEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{k} + 0.5) / (d{k} + 0.5)) END"
    score = " + ".join(f"{float(terms.count(t))} * ({idf(k)}) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * l / m))" for k, t in enumerate(kinds))
    some = " OR ".join(f"f{k} > 0" for k in range(len(kinds)))
    matched = " + ".join(f"CAST(f{k} > 0 AS INT)" for k in range(len(kinds)))
    return f"""one AS (SELECT {key}{cols}, {n_len} AS l, {fs} FROM {source}),
        st AS (SELECT count(*) AS n, avg(l) AS m, {ds} FROM one),
        sc AS (SELECT {key}{cols}, {matched} AS matched, -({score}) AS score FROM one, st WHERE {some})
        {top}"""


@query(f"WITH {PARAGRAPHS}, tk AS (SELECT chunk_id, {_W} AS w FROM p), " + _bm25_sql("tk", "chunk_id", TERMS, {"w": 1}, "SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6), chunk_id) AS rank FROM sc ORDER BY round(score, 6), chunk_id LIMIT 10"))
def bm25_top10(spark, sf_dir):
    scores = lexical.bm25(chunk_table(spark, sf_dir), "chunk_id", {"text": "text"}, TERMS)
    return lexical.ranked(scores.select("chunk_id", F.round("score", 6).alias("score")), 10, F.asc("score"), F.asc("chunk_id"))


@query(f"WITH {PARAGRAPHS}, tk AS (SELECT chunk_id, {_W} AS a, {WORDS.format('source')} AS b, {WORDS.format('lang')} AS c FROM p), " + _bm25_sql("tk", "chunk_id", ["the", "en", "src3"], {"a": 1.0, "b": 3.0, "c": 2.0}, "SELECT chunk_id, matched, round(score, 6) AS score FROM sc ORDER BY round(score, 6), chunk_id LIMIT 25"))
def bm25_weighted_columns(spark, sf_dir):
    rows = chunk_table(spark, sf_dir)
    scores = lexical.bm25(rows, "chunk_id", {"text": "text", "source": "source", "lang": "lang"}, ["the", "en", "src3"], {"text": 1.0, "source": 3.0, "lang": 2.0})
    return scores.select("chunk_id", "matched", F.round("score", 6).alias("score")).orderBy("score", "chunk_id").limit(25)


@query(f"WITH {PARAGRAPHS}, tk AS (SELECT chunk_id, {_W} AS w FROM p), " + _bm25_sql("tk", "chunk_id", ["onha", "ering"], {"w": 1}, "SELECT chunk_id, matched, round(score * CASE WHEN matched = 2 THEN 2 ELSE 1 END, 6) AS score FROM sc"))
def bm25_boolean_or_and(spark, sf_dir):
    """(a OR b) OR (a AND b): where both occur each counts twice."""
    scores = lexical.bm25(chunk_table(spark, sf_dir), "chunk_id", {"text": "text"}, ["onha", "ering"])
    return scores.select("chunk_id", "matched", F.round(F.col("score") * F.when(F.col("matched") == 2, 2).otherwise(1), 6).alias("score"))


@query(f"WITH {PARAGRAPHS}, tk AS (SELECT chunk_id, {_W} AS w FROM p) SELECT chunk_id, times FROM (SELECT chunk_id, CAST(len(list_filter(generate_series(1, len(w) - 1), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS BIGINT) AS times FROM tk) WHERE times > 0")
def bm25_phrase(spark, sf_dir):
    return lexical.phrase_hits(chunk_table(spark, sf_dir), "chunk_id", "text", ["of", "the"]).select("chunk_id", F.col("times").cast("long").alias("times"))


@query(f"WITH d AS (SELECT doc_id, {_W} AS w FROM documents) SELECT t AS term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, min(first) AS first_position FROM (SELECT doc_id, t, count(*) AS tf, min(pos) - 1 AS first FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM d) GROUP BY doc_id, t) GROUP BY t")
def term_statistics(spark, sf_dir):
    return lexical.term_totals(texts(spark, sf_dir), "doc_id", "text")


@query(f"WITH {PARAGRAPHS}, tk AS (SELECT chunk_id, source, {_W} AS w FROM p), " + _bm25_sql("tk", "chunk_id", ["the"], {"w": 1}, "SELECT chunk_id, source, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6), chunk_id) AS rank FROM sc WHERE source IN ('src1', 'src2') ORDER BY round(score, 6), chunk_id LIMIT 20", ", source"))
def keyword_origin_filter(spark, sf_dir):
    rows = chunk_table(spark, sf_dir)
    scores = lexical.bm25(rows, "chunk_id", {"text": "text"}, ["the"]).join(rows.where(F.col("source").isin("src1", "src2")).select("chunk_id", "source"), "chunk_id")
    return lexical.ranked(scores.select("chunk_id", "source", F.round("score", 6).alias("score")), 20, F.asc("score"), F.asc("chunk_id"))


_SET = "source IN ('src3', 'src4', 'src5')"
_WS = f"WITH {PARAGRAPHS}, tk AS (SELECT chunk_id, doc_id, {_W} AS w FROM p WHERE {_SET}), " + _bm25_sql("tk", "chunk_id", ["the", "onha"], {"w": 1}, "", ", doc_id").rstrip()
_WS_HITS = ", hits AS (SELECT *, row_number() OVER (ORDER BY round(score, 6), chunk_id) AS r FROM sc QUALIFY r <= 200), capped AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS doc_rank FROM hits QUALIFY doc_rank <= 3)"


def _workspace(spark, sf_dir):
    rows = chunk_table(spark, sf_dir)
    return search.workspace(rows, rows.where(F.expr(_SET)).select("doc_id").distinct(), ["the", "onha"], per_doc=3, total=200)


@query(_WS + _WS_HITS + " SELECT chunk_id, doc_id, round(1 / (1 + abs(score)), 4) AS score, doc_rank FROM capped")
def workspace_search(spark, sf_dir):
    return _workspace(spark, sf_dir).select("chunk_id", "doc_id", "score", "doc_rank")


@query(_WS + _WS_HITS + f", d AS (SELECT DISTINCT doc_id FROM p WHERE {_SET}), o AS (SELECT doc_id, count(*) AS n FROM capped GROUP BY doc_id) SELECT count(*) AS documents, count(n) AS matched, round(count(n) / count(*), 3) AS rate, count(n) = count(*) AS all_matched, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_matches FROM d LEFT JOIN o USING (doc_id)")
def workspace_overlap_summary(spark, sf_dir):
    rows = chunk_table(spark, sf_dir)
    return catalog.overlap(_workspace(spark, sf_dir), rows.where(F.expr(_SET)), "doc_id")


@query(_WS + _WS_HITS + " SELECT doc_id, count(*) AS hits, max(round(1 / (1 + abs(score)), 4)) AS largest, min(round(1 / (1 + abs(score)), 4)) AS best_score FROM capped GROUP BY doc_id")
def workspace_overlap_by_doc(spark, sf_dir):
    return _workspace(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("hits"), F.max("score").alias("largest"), F.min("score").alias("best_score"))


@query("SELECT doc_id, array_to_string(list_filter(['the', 'onha', 'zzz', 'qu-x', 'ering'], lambda t: contains(lower(text), t)), ',') AS shared FROM documents")
def shared_query_terms(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", F.array_join(T.shared_terms("The onha zzz of qu-x the ering", F.col("text")), ",").alias("shared"))


@query(f"WITH {PARAGRAPHS}, tk AS (SELECT chunk_id, doc_id, {_W} AS w FROM p), " + _bm25_sql("tk", "chunk_id", ["thnd", "onha", "edst"], {"w": 1}, ", b AS (SELECT doc_id, chunk_id, score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6), chunk_id) = 1) SELECT doc_id, chunk_id, least(greatest(round(0.70 + 0.28 * abs(score) / (SELECT max(abs(score)) FROM b), 2), 0.65), 0.99) AS relevance FROM b ORDER BY round(score, 6), doc_id LIMIT 12", ", doc_id"))
def reading_list_best_per_doc(spark, sf_dir):
    rows = chunk_table(spark, sf_dir)
    scores = lexical.bm25(rows, "chunk_id", {"text": "text"}, ["thnd", "onha", "edst"]).join(rows.select("chunk_id", "doc_id"), "chunk_id")
    best = per_group_top(scores, "doc_id", 1, F.round("score", 6), "chunk_id")
    return catalog.affine_scores(best).orderBy(F.round("score", 6), "doc_id").limit(12).select("doc_id", "chunk_id", "relevance")


_SIM = rf"""WITH {PARAGRAPHS}, s AS (SELECT doc_id, seq, text, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2) AS w FROM p),
    q AS (SELECT unnest(['the', 'onha', 'ering']) AS t),
    tf AS (SELECT doc_id, seq, t, len(list_filter(w, lambda x: x = t)) AS tf, CASE WHEN length(t) >= 4 THEN len(list_filter(w, lambda x: x != t AND (contains(x, t) OR contains(t, x)))) ELSE 0 END AS fz, len(w) AS l FROM s, q),
    st AS (SELECT doc_id, count(DISTINCT seq) AS n, avg(l) AS m FROM tf GROUP BY doc_id),
    df AS (SELECT doc_id, t, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY doc_id, t),
    sc AS (SELECT doc_id, seq, sum(greatest(0.2, ln(1 + (n - df + 0.5) / (df + 0.5))) * CASE WHEN tf > 0 THEN tf WHEN fz > 0 THEN 0.75 ELSE 0 END * 2.2 / (CASE WHEN tf > 0 THEN tf WHEN fz > 0 THEN 0.75 ELSE 0 END + 1.2 * (0.25 + 0.75 * l / greatest(m, 1)))) AS raw, avg(CASE WHEN tf > 0 OR fz > 0 THEN 1.0 ELSE 0.0 END) AS cover FROM tf JOIN st USING (doc_id) JOIN df USING (doc_id, t) GROUP BY doc_id, seq),
    fin AS (SELECT doc_id, seq, (raw + CASE WHEN contains(lower(text), 'the onha ering') THEN 4.0 ELSE 0 END) * (0.5 + 0.5 * cover) AS v FROM sc JOIN s USING (doc_id, seq))
    SELECT doc_id, seq, round(100 * v / max(v) OVER (PARTITION BY doc_id), 3) AS similarity FROM fin QUALIFY max(v) OVER (PARTITION BY doc_id) > 0 AND 100 * v / max(v) OVER (PARTITION BY doc_id) >= 10"""


@query(_SIM)
def section_similarity(spark, sf_dir):
    return search.section_similarity(chunk_table(spark, sf_dir), "the onha ering")


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[])"


def _vector(spark, sf_dir, vec_id=7):
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


@query(f"SELECT vec_id, round({_COS}, 4) AS score, row_number() OVER (ORDER BY round({_COS}, 6) DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 10")
def cosine_topk(spark, sf_dir):
    return dense.cosine_top(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10).withColumn("score", F.round("score", 4))


@query(f"""WITH s AS (SELECT vec_id, label, {_COS} AS score FROM embeddings), prior AS (SELECT label, avg(score) AS prior FROM s GROUP BY label),
    c AS (SELECT vec_id, round(CASE WHEN prior > 0 THEN 0.75 * score + 0.25 * prior ELSE score END + 0.15 * CASE WHEN label = 3 THEN 1.0 ELSE 0.0 END, 4) AS combined FROM s JOIN prior USING (label))
    SELECT vec_id, combined FROM c ORDER BY combined DESC, vec_id LIMIT 20""")
def two_stage_rerank(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    scores = dense.cosines(vectors, [_vector(spark, sf_dir)]).select("vec_id", "label", F.get("cosines", F.lit(0)).alias("score"))
    prior = scores.groupBy("label").agg(F.avg("score").alias("prior"))
    out = dense.two_stage(scores.join(F.broadcast(prior), "label"), F.col("prior"), F.when(F.col("label") == 3, 1.0).otherwise(0.0))  # one row a label
    return out.select("vec_id", "combined").orderBy(F.desc("combined"), "vec_id").limit(20)


@query(f"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents), """ + _bm25_sql("d", "doc_id", ["the", "onha"], {"w": 1}, ""
    f""", a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round({_COS}, 6) DESC, vec_id) AS r1 FROM embeddings QUALIFY r1 <= 20),
    b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 6), doc_id) AS r2 FROM sc QUALIFY r2 <= 20)
    SELECT id, round(coalesce(1 / (60 + r1), 0) + coalesce(1 / (60 + r2), 0), 6) AS score FROM a FULL JOIN b USING (id) ORDER BY coalesce(1 / (60 + r1), 0) + coalesce(1 / (60 + r2), 0) DESC, r1 NULLS LAST, r2 NULLS LAST, id LIMIT 10"""))
def rrf_hybrid(spark, sf_dir):
    """Vectors stand for the documents of the same number."""
    first = dense.cosine_top(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20).select(F.col("vec_id").alias("id"), "rank")
    scores = lexical.bm25(texts(spark, sf_dir), "doc_id", {"text": "text"}, ["the", "onha"]).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))
    second = lexical.ranked(scores, 20, F.asc("score"), F.asc("id"))
    return lexical.reciprocal_ranks(first, second, "id", 60, 10).select("id", F.round("score", 6).alias("score"))


_ANCHORS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(generate_series(1, len(v))) AS i FROM e) GROUP BY label, i),
    c AS (SELECT label, list(m ORDER BY i) AS a FROM x WHERE label < 6 GROUP BY label),
    s AS (SELECT vec_id, e.label, c.label AS anchor, list_cosine_similarity(v, a) AS score FROM e, c)"""


def _anchored(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    anchors = [(str(r["label"]), r["anchor"]) for r in dense.centroids(vectors.where("label < 6")).orderBy("label").collect()]  # six anchors
    return dense.anchor_scores(vectors, anchors)


@query(f"WITH {_ANCHORS} SELECT vec_id, label, " + ", ".join(f"round(max(score) FILTER (anchor = {k}), 4) AS score_{k}" for k in range(6)) + ", CAST(arg_max(anchor, score) AS VARCHAR) AS best_anchor FROM s GROUP BY vec_id, label")
def anchor_scores(spark, sf_dir):
    return _anchored(spark, sf_dir)


@query(f"WITH {_ANCHORS}, m AS (SELECT label, anchor, round(avg(round(score, 4)), 4) AS m FROM s GROUP BY label, anchor) SELECT label, " + ", ".join(f"max(m) FILTER (anchor = {k}) AS mean_{k}" for k in range(6)) + ", (SELECT CAST(anchor AS VARCHAR) FROM m b WHERE b.label = m.label ORDER BY b.m DESC, anchor LIMIT 1) AS best_anchor FROM m GROUP BY label")
def anchor_means_by_group(spark, sf_dir):
    return dense.group_means(_anchored(spark, sf_dir), [str(k) for k in range(6)], "label")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def not_yet_embedded_anti(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def known_docs_semi(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query(f"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents), """ + _bm25_sql("d", "doc_id", ["the", "onha"], {"w": 1}, f""", m AS (SELECT max(abs(score)) AS top FROM sc)
    SELECT vec_id AS id, round(CASE WHEN score IS NULL THEN 100 * greatest(0, {_COS}) ELSE 0.3 * 100 * abs(score) / top + 0.7 * 100 * greatest(0, {_COS}) END, 3) AS blend FROM embeddings LEFT JOIN sc ON doc_id = vec_id, m"""))
def lexical_semantic_blend(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    cos = dense.cosines(vectors, [_vector(spark, sf_dir)]).select(F.col("vec_id").alias("id"), F.get("cosines", F.lit(0)).alias("cos"))
    scores = lexical.bm25(texts(spark, sf_dir), "doc_id", {"text": "text"}, ["the", "onha"]).select(F.col("doc_id").alias("id"), "score")
    return search.blend(cos, scores).select("id", F.round("blend", 3).alias("blend"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS norm, CASE WHEN list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) = 0 THEN 0.0 ELSE 1.0 END AS unit FROM embeddings")
def vector_norms(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")) ** 0.5, 4).alias("norm"), F.round(dot(normalised(F.col("embedding")), normalised(F.col("embedding"))) ** 0.5, 4).alias("unit"))


QUERIES, ORACLES = query.queries, query.oracles
