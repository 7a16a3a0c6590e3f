"""Search plans over paragraphs and vectors: phrases, expansion, stored index, scopes, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.tokens import tokens
from quarry.operators import index
from quarry.operators.lexical import Expression, expression_scores, ranked
from quarry.plans import search as S
from quarry.queries.common import PARAGRAPHS, Registry, chunk_table
from quarry.session import new_path, table

query = Registry()

_FOLDED = r"regexp_extract_all(lower(strip_accents({0})), '[\p{{L}}\p{{N}}]+')"
_PLAIN = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _scores_sql(e: Expression, rows: str = "SELECT chunk_id, text FROM p", bag: str = _PLAIN) -> str:
    """Common table expressions ``c`` (key, len, f0, …) and ``s`` (chunk_id, score) of an expression."""
    atoms = e.atoms()

    def times(atom):
        test = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(atom))
        return f"len(list_filter(generate_series(1, len(w) - {len(atom) - 1}), lambda i: {test}))"

    def part(atom):
        k = atoms.index(tuple(atom))
        idf = f"ln((n - d{k} + 0.5) / (d{k} + 0.5))"
        return f"(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / mean)))"

    some = " + ".join(part(a) for a in [*[(t,) for t in e.any_of], *e.phrases])
    if e.all_of:
        every = " AND ".join(f"f{atoms.index((t,))} > 0" for t in e.all_of)
        some += f" + CASE WHEN {every} THEN {' + '.join(part((t,)) for t in e.all_of)} ELSE 0 END"
    counts = ", ".join(f"{times(a)} AS f{k}" for k, a in enumerate(atoms))
    seen = ", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(len(atoms)))
    return f"""c AS (SELECT chunk_id, len(w) AS len, {counts} FROM (SELECT chunk_id, {bag.format('text')} AS w FROM ({rows}))),
        st AS (SELECT count(*) AS n, avg(len) AS mean, {seen} FROM c), s AS (SELECT chunk_id, -({some}) AS score FROM c, st WHERE {" OR ".join(f"f{k} > 0" for k in range(len(atoms)))})"""


_RAW = '"of the" re er'
_PARSED = S.parse_query(_RAW, ["tion ing"])


@query(f"WITH {PARAGRAPHS}, {_scores_sql(_PARSED)} SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY round(score, 6), chunk_id LIMIT 20")
def keyword_search_phrases(spark, sf_dir):
    """Quoted phrase, whole-query phrase, any word, all words once more, and an expansion as a phrase."""
    hits = S.keyword_search(chunk_table(spark, sf_dir), "chunk_id", {"text": "text"}, _RAW, 20, expander=lambda q: ["tion ing"])
    return hits.select("chunk_id", F.round("score", 6).alias("score"))


_ACCENTED = S.parse_query("cion leel re")


@query(f"WITH {PARAGRAPHS}, {_scores_sql(_ACCENTED, bag=_FOLDED)} SELECT chunk_id, round(score, 6) AS score FROM s")
def indexed_search_folded(spark, sf_dir):
    """The stored index of folded tokens, read by the query's terms alone."""
    path = new_path(spark, "index")
    index.build(chunk_table(spark, sf_dir), "chunk_id", {"text": "text"}, path)
    hits = index.search(spark, path, _ACCENTED)
    return hits.select(F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"))


@query(f"WITH {PARAGRAPHS}, t AS (SELECT chunk_id, unnest({_FOLDED.format('text')}) AS term FROM p) SELECT term, count(*) AS n FROM t GROUP BY term")
def folded_term_counts(spark, sf_dir):
    rows = chunk_table(spark, sf_dir)
    return rows.select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_ORIGIN = "CASE WHEN source = 'src0' THEN 'note' WHEN source IN ('src1', 'src2') THEN 'easa' ELSE 'eu' END"


def _with_origin(rows):
    """Sources of the test tables stand for origins."""
    return rows.withColumn("metadata", F.when(F.col("source") == "src0", '{"origin": "note"}').when(F.col("source").isin("src1", "src2"), '{"source": "EASA XML"}').otherwise('{"source": "x"}')).withColumn("origin", S.origin_of(F.col("metadata"), F.col("doc_id").cast("string")))


_SCOPED = S.parse_query("re er on")


@query(f"""WITH {PARAGRAPHS}, {_scores_sql(_SCOPED)}, o AS (SELECT chunk_id, {_ORIGIN} AS origin FROM p)
    SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6), chunk_id) AS rank FROM s JOIN o USING (chunk_id) WHERE origin = 'easa' ORDER BY round(score, 6), chunk_id LIMIT 20""")
def keyword_search_by_origin(spark, sf_dir):
    rows = _with_origin(chunk_table(spark, sf_dir))
    return S.keyword_search(rows, "chunk_id", {"text": "text"}, "re er on", 20, where=S.in_scope("easa")).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {PARAGRAPHS}, {_scores_sql(_SCOPED)}, o AS (SELECT chunk_id, {_ORIGIN} AS origin FROM p), b AS (SELECT chunk_id, score * CASE WHEN origin = 'note' THEN 2.5 ELSE 1 END AS score FROM s JOIN o USING (chunk_id))
    SELECT chunk_id, round(score, 6) AS score FROM b ORDER BY round(score, 6), chunk_id LIMIT 20""")
def keyword_search_notes_first(spark, sf_dir):
    """Deep research: own notes count two and a half times."""
    rows = _with_origin(chunk_table(spark, sf_dir))
    return S.keyword_search(rows, "chunk_id", {"text": "text"}, "re er on", 20, boosted=F.col("origin") == "note").select("chunk_id", F.round("score", 6).alias("score"))


_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST(q AS DOUBLE[]))"
_VECTORS = f"""q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    v AS (SELECT vec_id AS chunk_id, label AS doc_id, embedding, vec_id % 7 / 10.0 AS airline FROM embeddings),
    means AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, generate_series(1, len((SELECT q FROM q))) t(i) GROUP BY 1, 2),
    docs AS (SELECT label AS doc_id, list(x ORDER BY i) AS embedding FROM means GROUP BY 1),
    prior AS (SELECT doc_id, {_COS.format('embedding')} AS prior FROM docs, q ORDER BY prior DESC, doc_id LIMIT 25),
    sem AS (SELECT chunk_id, round(CASE WHEN prior > 0 THEN 0.75 * cos + 0.25 * prior ELSE cos END + 0.15 * airline, 4) AS score FROM (SELECT chunk_id, doc_id, airline, {_COS.format('embedding')} AS cos FROM v, q) LEFT JOIN prior USING (doc_id)),
    semantic AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM sem ORDER BY score DESC, chunk_id LIMIT 40)"""


def _semantic(spark, sf_dir):
    from quarry.operators.dense import centroids

    vectors = table(spark, sf_dir, "embeddings")
    vector = vectors.where("vec_id = 0").select("embedding").first()[0]
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), "embedding")
    documents = centroids(vectors).select(F.col("label").alias("doc_id"), F.col("anchor").alias("embedding"))
    stakes = vectors.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 7 / 10.0).alias("airline"))
    return S.semantic_search(chunks, vector, 40, documents, stakes, "Airline")


@query(f"WITH {_VECTORS} SELECT chunk_id, score, rank FROM semantic")
def semantic_search_prior(spark, sf_dir):
    """Cosine, document prior and stakeholder's score."""
    return _semantic(spark, sf_dir)


_LEXICAL = f"""docs2 AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS text FROM documents), {_scores_sql(_SCOPED, "SELECT chunk_id, text FROM docs2")},
    keyword AS (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 6), chunk_id) AS rank FROM s ORDER BY round(score, 6), chunk_id LIMIT 40)"""


@query(f"""WITH {_VECTORS}, {_LEXICAL}, f AS (SELECT chunk_id, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS score, a.rank AS r1, b.rank AS r2 FROM semantic a FULL JOIN keyword b USING (chunk_id))
    SELECT chunk_id, round(score, 8) AS score FROM f ORDER BY f.score DESC, r1 NULLS LAST, r2 NULLS LAST, chunk_id LIMIT 20""")
def hybrid_search_plan(spark, sf_dir):
    """Semantic and keyword search over the same ids, fused."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    keyword = S.keyword_search(docs, "chunk_id", {"text": "text"}, "re er on", 40)
    return S.hybrid_search(_semantic(spark, sf_dir), keyword, 20).select("chunk_id", F.round("score", 8).alias("score"))


QUERIES, ORACLES = query.queries, query.oracles
