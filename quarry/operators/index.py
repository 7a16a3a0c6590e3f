"""A stored inverted index: written once, read by term.

Postings are (bucket, term, key, col, tf, positions, len), partitioned by a hash of
the term and sorted by term within files, so a query reads the folders of its terms
and, by Parquet's statistics, the row groups that may hold them. A rebalance step
splits the postings of very frequent words over several tasks and files. One row of
statistics stands beside them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.functions.tokens import stem, tokens
from quarry.operators.lexical import Expression, scored

BUCKETS = 64
#: Bags whose postings are put together at a time.
BAGS = 10_000
#: Tokens whose postings are sorted at a time (about 100 MB in Python), and postings in a batch that leaves Python.
RUN_TOKENS = 1_000_000
HITS = 100_000


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bags_of(rows: DataFrame, key: str, columns: dict[str, str], fold: bool) -> DataFrame:
    """(key, len, and the tokens of each named column) of rows."""
    bags = rows.select(F.col(key).alias("key"), *(tokens(F.col(c), fold).alias(n) for n, c in columns.items()))
    return bags.withColumn("len", reduce(lambda a, b: a + b, (F.size(n) for n in columns)))


def _places(bags: pa.Array, stemmed: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the bags of a column: its terms, sorted; then, by term, row and place, the term, row and place of each token; and where a new pair of term and row begins."""
    words = bags.flatten().dictionary_encode()
    spelt, code = words.dictionary, words.indices.to_numpy()
    if stemmed:
        again = pa.array([stem(t) for t in spelt.to_pylist()], pa.string()).dictionary_encode()
        spelt, code = again.dictionary, again.indices.to_numpy()[code]
    by_name = pc.sort_indices(spelt).to_numpy()
    rank = np.empty(len(by_name), np.int32)
    rank[by_name] = np.arange(len(by_name))
    code = rank[code]
    size = pc.fill_null(pc.list_value_length(bags), 0).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    order = np.argsort(code, kind="stable")
    code, row, place = code[order], row[order], place[order].astype(np.int32)
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return spelt.take(pa.array(by_name)), code, row, place, np.flatnonzero(new)


def _listed(starts: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), values)


def _by_term(columns: list[str], stemmed: bool):
    """Of a batch of bags: one row for each term and column, with arrays of its keys, their lengths and its positions."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BAGS):
                batch = whole.slice(at, BAGS)
                for name in columns:
                    spelt, code, row, place, hit = _places(batch.column(name), stemmed)
                    if not len(hit):
                        continue
                    first = np.flatnonzero(np.diff(code[hit], prepend=-1))
                    some = pa.array(row[hit])
                    lists = [_listed(first, len(hit), x) for x in (batch.column("key").take(some), batch.column("len").take(some), _listed(hit, len(place), pa.array(place)))]
                    yield pa.RecordBatch.from_arrays([spelt.take(pa.array(code[hit[first]])), pa.array([name] * len(first), pa.string()), *lists], names=["term", "col", "keys", "lens", "places"])

    return group


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bags (with ``len``) put together, or cut between bags, into batches that just reach RUN_TOKENS; a bag counts as a token more."""
    held, n = [], 0
    for whole in batches:
        ends = np.cumsum(whole.column("len").to_numpy().astype(np.int64) + 1)
        at = 0
        while at < whole.num_rows:
            before = ends[at - 1] if at else 0
            upto = min(int(np.searchsorted(ends, before + RUN_TOKENS - n)) + 1, whole.num_rows)
            held.append(whole.slice(at, upto - at))
            at, n = upto, n + int(ends[upto - 1] - before)
            if n >= RUN_TOKENS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _in_runs(columns: list[str], stemmed: bool):
    """Postings of bags (key, len, row and tokens), sorted by term within each run and column."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches):
            for name in columns:
                spelt, code, row, place, hit = _places(batch.column(name), stemmed)
                for at in range(0, len(hit), HITS):
                    some = hit[at : at + HITS]
                    end = hit[at + HITS] if at + HITS < len(hit) else len(place)
                    rows = pa.array(row[some])
                    yield pa.RecordBatch.from_arrays(
                        [spelt.take(pa.array(code[some])), *(batch.column(c).take(rows) for c in ("key", "len", "row")), pa.array([name] * len(some), pa.string()), _listed(some - some[0], end - some[0], pa.array(place[some[0] : end]))],
                        names=["term", "key", "len", "row", "col", "positions"],
                    )

    return posted


def runs_of(bags: DataFrame, columns: dict[str, str], stemmed: bool) -> DataFrame:
    """Postings (term, key, len, row, col, positions) of bags (key, len, row and tokens), made and left where the bags lie.

    Nothing is shuffled or sorted by Spark: each task gives runs of RUN_TOKENS tokens, each
    sorted by term, so that the statistics of a file's pages tell where a term may be.
    """
    return bags.select("key", "len", "row", *columns).mapInArrow(_in_runs(list(columns), stemmed), f"term string, key {dict(bags.dtypes)['key']}, len int, row long, col string, positions array<int>")


def postings_of(bags: DataFrame, columns: dict[str, str], stemmed: bool, buckets: int) -> DataFrame:
    """Postings of bags, dealt out by bucket.

    A bag is in one row, so its postings are made where it lies; the one shuffle carries each
    term once for a batch of bags.
    """
    grouped = bags.mapInArrow(_by_term(list(columns), stemmed), f"term string, col string, keys array<{dict(bags.dtypes)['key']}>, lens array<int>, places array<array<int>>")
    dealt = grouped.withColumn("bucket", _bucket(F.col("term"), buckets)).hint("rebalance", "bucket")
    each = dealt.select("term", "col", "bucket", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("lens").alias("len"), F.col("places").alias("positions"))).alias("key", "len", "positions"))
    return each.select("term", "key", "col", "len", F.size("positions").cast("long").alias("tf"), "positions", "bucket").sortWithinPartitions("bucket", "term")


def build(rows: DataFrame, key: str, columns: dict[str, str], path: str, fold: bool = True, stemmed: bool = False, buckets: int = BUCKETS) -> None:
    """Write the index of the named text columns of rows; an index at the path is replaced.

    Null texts count as empty; rows without tokens count in the statistics; keys should be distinct.
    """
    bags = bags_of(rows, key, columns, fold)
    bags.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean"), F.lit(fold).alias("fold"), F.lit(stemmed).alias("stemmed"), F.lit(buckets).alias("buckets"), F.lit(dict(rows.dtypes)[key]).alias("key_type")).write.mode("overwrite").parquet(f"{path}/statistics")
    postings_of(bags, columns, stemmed, buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def wanted_terms(expression: Expression, stemmed: bool) -> dict[str, str]:
    """The expression's words, each with the term that it is looked up by."""
    turn: Callable[[str], str] = stem if stemmed else lambda t: t
    return {t: turn(t) for a in expression.atoms() for t in a}


def of_terms(postings: DataFrame, terms: list[str], buckets: int) -> DataFrame:
    """The postings of some terms; only their buckets' folders are read."""
    found = postings.sparkSession.range(1).select(*(_bucket(F.lit(t), buckets).alias(f"b{k}") for k, t in enumerate(terms))).first()
    return postings.where(F.col("bucket").isin(sorted(set(found))) & F.col("term").isin(terms))


def hit_scores(hits: DataFrame, facts: DataFrame, expression: Expression, spelt: dict[str, str], weights: dict[str, float]) -> DataFrame:
    """(key, matched, score) from the postings of the expression's terms and one row of facts (n, mean)."""
    atoms = expression.atoms()
    at = {t: k for k, t in enumerate(sorted(set(spelt.values())))}
    per = hits.groupBy("key", "col").agg(F.first("len").alias("len"), *(F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{k}") for t, k in at.items()))

    def times(atom: tuple[str, ...]) -> Column:
        moved = lambda t, k: F.transform(F.coalesce(f"p{at[spelt[t]]}", F.array().cast("array<int>")), lambda p: p - k)
        return F.size(reduce(F.array_intersect, (moved(t, k) for k, t in enumerate(atom))))

    weight = reduce(lambda e, w: e.when(F.col("col") == w[0], float(w[1])), weights.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    counts = per.groupBy("key").agg(F.first("len").alias("len"), *(F.sum(times(a) * weight).alias(f"f{k}") for k, a in enumerate(atoms)))
    seen = counts.agg(*(F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(atoms))))
    return scored(counts, "key", facts.select("n", "mean").join(F.broadcast(seen)), expression)  # both are one row


def search(spark: SparkSession, path: str, expression: Expression, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, matched, score) of rows that satisfy the expression; smaller is better. Only its terms' postings are read."""
    facts = spark.read.parquet(f"{path}/statistics")
    settings = facts.first()
    spelt = wanted_terms(expression, settings["stemmed"])
    # The schema is given, since an index of nothing has no file to infer it from.
    schema = f"term string, key {settings['key_type']}, len int, col string, tf long, positions array<int>, bucket int"
    postings = spark.read.schema(schema).parquet(f"{path}/postings")
    hits = of_terms(postings, sorted(set(spelt.values())), settings["buckets"])
    return hit_scores(hits, facts, expression, spelt, weights or {})
