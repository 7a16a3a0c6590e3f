"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, suffix_dedup
from quarry.llm.collocations import collocations
from quarry.llm.decontaminate import benchmark_hits
from quarry.llm.exact_dedup import exact_duplicates
from quarry.llm.jaccard_join import similar_documents
from quarry.llm.merkle import attested
from quarry.llm.pii import personal_data
from quarry.llm.ppm import language_scores
from quarry.llm.quality import quality_scores
from quarry.llm.secrets import secret_findings
from quarry.llm.url_filter import url_verdicts
from quarry.llm.warc import round_trip
from quarry.session import table

_WS = r"[\x20\x09-\x0D]"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), passages=True))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attested(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_ppm": op2_ppm,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_pii": op8_pii,
    "op9_secrets": op9_secrets,
    "op10_decontaminate": op10_decontaminate,
    "op11_urls": op11_urls,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op5_exact_dedup": rf"""
        WITH bare AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS b FROM documents),
        ranked AS (SELECT *, count(*) OVER (PARTITION BY b) AS group_size, first_value(doc_id) OVER (PARTITION BY b ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM bare)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(b) AS text_sha256 FROM ranked""",
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        g AS (SELECT *, octet_length(b) AS n, min(page_id) OVER (PARTITION BY b) AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest,
               CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM g""",
    "op10_decontaminate": r"""
        WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (SELECT item_id, n, w[s:s + n - 1] AS x FROM (SELECT *, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM items WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM windows),
        runs AS (SELECT k, s, n, w[s:s + n - 1] AS x FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM docs, lengths WHERE len(w) >= n)),
        found AS (SELECT DISTINCT k, s, n, item_id FROM runs JOIN windows USING (n, x)),
        hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(s, s + n - 1)) AS p FROM found) GROUP BY k),
        named AS (SELECT k, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS t FROM found) GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (k) LEFT JOIN named USING (k)""",
    "op12_merkle": r"""
        WITH RECURSIVE named AS (SELECT row_number() OVER () AS k, doc_id, coalesce('=' || lang, '') AS tree, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: CASE WHEN v IS NULL THEN '-' ELSE octet_length(encode(v)) || ':' || v END), lambda x, y: x || y) AS head,
                list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT),
                    lambda a, b: list_reduce([xor(a, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS crc FROM documents),
        hashed AS (SELECT k, doc_id, tree, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
                sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(low)) || ':' || low END) AS lowered, coalesce(xor(crc, 4294967295::UBIGINT) % 3 = 0, false) AS hit FROM named),
        leaves AS (SELECT *, CASE WHEN hit THEN lowered ELSE leaf END AS start, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
        nodes(tree, h, i, d, n) AS (SELECT tree, 0, i, leaf, n FROM leaves
                UNION ALL SELECT tree, h + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, h, i // 8, n),
        tops(tree, h, i, d, n) AS (SELECT tree, 0, row_number() OVER (ORDER BY tree) - 1, d, count(*) OVER () FROM nodes WHERE n = 1
                UNION ALL SELECT '', h + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY h, i // 8, n),
        places AS (SELECT k, tree, i, (SELECT min(t.i) FROM tops t WHERE t.h = 0 AND t.tree = leaves.tree) AS j FROM leaves),
        sides AS (SELECT a.tree, a.h, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
                FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.h = b.h AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.tree, a.h, a.i),
        top_sides AS (SELECT a.h, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
                FROM tops a JOIN tops b ON a.h = b.h AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.h, a.i),
        steps AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY u, h) AS s, l, r FROM (
                SELECT k, 0 AS u, h, l, r FROM places p JOIN sides s ON s.tree = p.tree AND s.i = p.i // CAST(8 ** s.h AS BIGINT)
                UNION ALL SELECT k, 1, h, l, r FROM places p JOIN top_sides s ON s.i = p.j // CAST(8 ** s.h AS BIGINT))),
        proofs AS (SELECT k, sha256(string_agg(l || r, '' ORDER BY s)) AS proof, max(s) AS m FROM steps GROUP BY k),
        folds(k, s, x) AS (SELECT k, 0, start FROM leaves UNION ALL SELECT f.k, f.s + 1, sha256(t.l || f.x || t.r) FROM folds f JOIN steps t ON t.k = f.k AND t.s = f.s + 1)
        SELECT doc_id, leaf, (SELECT min(d) FROM nodes o WHERE o.tree = v.tree AND o.n = 1) AS subroot, (SELECT min(d) FROM tops WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, x AS folded_root, x = (SELECT min(d) FROM tops WHERE n = 1) AS verified
        FROM leaves v LEFT JOIN proofs USING (k) JOIN folds f ON f.k = v.k AND f.s = coalesce(m, 0)""",
    "op13_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS p FROM documents),
        runs AS (SELECT lang, k, p[i:i + k - 1] AS w FROM (SELECT lang, p, k, unnest(generate_series(1, len(p) - k + 1)) AS i FROM pieces, (VALUES (1), (2), (3)) AS v(k) WHERE len(p) >= k)),
        f AS (SELECT lang, k, w, count(*) AS a FROM runs GROUP BY ALL),
        total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        often AS (SELECT * FROM f WHERE a >= 10),
        cuts AS (SELECT lang, k, w, a, unnest(generate_series(1, k - 1)) AS c FROM often WHERE k > 1),
        scored AS (SELECT c.lang, c.k, c.w, c.a, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score, c
                   FROM cuts c JOIN often x ON x.lang = c.lang AND x.w = c.w[1:c] JOIN often y ON y.lang = c.lang AND y.w = c.w[c + 1:]),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, c) = 1),
        longer AS (SELECT lang, s, max(a) AS most FROM (SELECT lang, unnest([w[1:2], w[2:3]]) AS s, a FROM often WHERE k = 3) GROUP BY lang, s),
        kept AS (SELECT b.*, array_to_string(b.w, ' ') AS phrase FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.s = b.w WHERE g.most IS NULL OR 100 * g.most < 50 * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM kept JOIN total USING (lang) QUALIFY rank <= 2000""",
}
