"""Inverted index and BM25 ranking as joins and aggregations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from quarry.functions.columns import words
from quarry.session import kept

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Repeated keys up to which they are broadcast (about 30 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def postings(rows: DataFrame, key: str, columns: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """(term, key, col, tf, positions) of the named text columns; ``keep`` limits the terms."""
    parts = [rows.select(F.col(key), F.lit(name).alias("col"), F.posexplode(words(F.col(column))).alias("pos", "term")) for name, column in columns.items()]
    every = reduce(DataFrame.unionByName, parts)
    if keep is not None:
        every = every.where(F.col("term").isin(keep))
    return every.groupBy("term", key, "col").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_totals(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(term, df, tf, first_position): keys and places with each term, and its least place.

    Counted before the shuffle, so that it carries words and no places; only rows whose key repeats send theirs with the key.
    """
    again = kept(rows.groupBy(F.col(key).alias("_key")).count().where("count > 1"), "repeated")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    bags = rows.select(F.col(key), F.col(column)).join(again, F.col(key).eqNullSafe(F.col("_key")), "left").select(F.col(key), F.col("count").isNotNull().alias("_again"), F.inline(F.array(F.struct(words(F.col(column)).alias("_bag")))))
    row = lambda t, df, tf, pos: F.struct(t.alias("term"), df.cast("long").alias("df"), F.lit(tf).cast("long").alias("tf"), pos.cast("int").alias("pos"))
    places = F.transform("_bag", lambda t, i: row(t, F.lit(0), 1, i))
    kinds = F.transform(F.array_distinct("_bag"), lambda t: row(t, (~F.col("_again")).cast("int"), 0, F.lit(None)))
    every = bags.select(F.inline(F.concat(places, kinds)))
    shared = bags.where("_again").select(F.col(key), F.explode(F.array_distinct("_bag")).alias("term")).distinct()
    every = every.unionByName(shared.select(F.inline(F.array(row(F.col("term"), F.lit(1), 0, F.lit(None))))))
    return every.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.min("pos").cast("long").alias("first_position"))


def lengths(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Tokens of each row over all its columns."""
    total = reduce(lambda a, b: a + b, (F.size(words(F.col(c))) for c in columns.values()))
    return rows.select(F.col(key), total.alias("len"))


def _one_pass(counts: DataFrame, kinds: int) -> tuple[DataFrame, DataFrame]:
    """(hits, one row of statistics) of (key, len, f0, f1, …): hits are written while the corpus size, mean length and document frequencies are observed."""
    seen = Observation()
    hit = [F.col(f"f{k}") > 0 for k in range(kinds)]
    observed = counts.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean"), *(F.count_if(h).alias(f"d{k}") for k, h in enumerate(hit)))
    hits = kept(observed.where(reduce(lambda a, b: a | b, hit)), "hits")
    return hits, counts.sparkSession.range(1).select(*(F.lit(v).alias(name) for name, v in seen.get.items()))


def bm25(rows: DataFrame, key: str, columns: dict[str, str], terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(key, matched, score) of rows with any of the terms; smaller is better. A term given twice counts twice.

    One pass over the rows; no token is ever shuffled.
    """
    weights = weights or {}
    kinds = sorted(set(terms))
    names = {name: f"_bag_{k}" for k, name in enumerate(columns)}
    # As the one row of a generator, the tokens are made once and not again in every expression that uses them.
    bags = rows.select(F.col(key), F.inline(F.array(F.struct(*(words(F.col(c)).alias(names[name]) for name, c in columns.items())))))
    count = lambda t: reduce(lambda a, b: a + b, ((F.size(bag) - F.size(F.array_remove(bag, t))) * float(weights.get(name, 1.0)) for name, bag in names.items()))
    one = bags.select(F.col(key), reduce(lambda a, b: a + b, (F.size(b) for b in names.values())).alias("len"), *(count(t).alias(f"f{k}") for k, t in enumerate(kinds)))
    hits, stats = _one_pass(one, len(kinds))

    def part(k: int, t: str):
        idf = F.log((F.col("n") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5))
        idf = F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf)
        f = F.col(f"f{k}")
        return F.lit(float(terms.count(t))) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))

    score = reduce(lambda a, b: a + b, (part(k, t) for k, t in enumerate(kinds)))
    matched = reduce(lambda a, b: a + b, ((F.col(f"f{k}") > 0).cast("int") for k in range(len(kinds))))
    return hits.join(F.broadcast(stats)).select(key, matched.alias("matched"), (-score).alias("score"))  # stats is one row


@dataclass
class Expression:
    """A keyword query: any of the words, all of the words once more, and phrases; each clause that holds adds its score."""

    phrases: list[list[str]] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    all_of: list[str] = field(default_factory=list)

    def atoms(self) -> list[tuple[str, ...]]:
        """Words and phrases, each once."""
        return list(dict.fromkeys([(t,) for t in [*self.any_of, *self.all_of]] + [tuple(p) for p in self.phrases if p]))


def scored(counts: DataFrame, key: str, stats: DataFrame, expression: Expression) -> DataFrame:
    """(key, matched, score) from (key, len, f0, f1, …) and one row (n, mean, d0, d1, …), by the order of the expression's atoms.

    A phrase is an atom with a document frequency of its own. ``matched`` counts the atoms that occur.
    """
    atoms = expression.atoms()
    number = {a: k for k, a in enumerate(atoms)}

    def part(atom: tuple[str, ...]):
        k = number[atom]
        idf = F.log((F.col("n") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5))
        f = F.col(f"f{k}")
        return F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))

    total = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0.0))
    some = total(part((t,)) for t in expression.any_of) + total(part(tuple(p)) for p in expression.phrases if p)
    if expression.all_of:
        every = reduce(lambda a, b: a & b, (F.col(f"f{number[(t,)]}") > 0 for t in expression.all_of))
        some = some + F.when(every, total(part((t,)) for t in expression.all_of)).otherwise(0.0)
    matched = total((F.col(f"f{k}") > 0).cast("int") for k in range(len(atoms))).cast("int")
    return counts.join(F.broadcast(stats)).select(key, matched.alias("matched"), (-some).alias("score")).where("score < 0")  # stats is one row


def _times(bag: str, atom: tuple[str, ...]) -> Column:
    """How often a word or phrase stands in a column of tokens."""
    if len(atom) == 1:
        return F.size(bag) - F.size(F.array_remove(bag, atom[0]))
    wanted = F.array(*map(F.lit, atom))
    starts = F.sequence(F.lit(1), F.greatest(F.size(bag) - len(atom) + 1, F.lit(1)))
    # Most rows lack a word of the phrase and need no look at positions.
    able = reduce(lambda a, b: a & b, (F.array_contains(bag, t) for t in atom))
    return F.when(able, F.size(F.filter(starts, lambda i: F.slice(bag, i, F.lit(len(atom))) == wanted))).otherwise(0)


def expression_scores(rows: DataFrame, key: str, columns: dict[str, str], expression: Expression, weights: dict[str, float] | None = None, tokenise=words) -> DataFrame:
    """As `scored`, for rows without a stored index: one pass over the rows."""
    weights, atoms = weights or {}, expression.atoms()
    names = {name: f"_bag_{k}" for k, name in enumerate(columns)}
    bags = rows.select(F.col(key), F.inline(F.array(F.struct(*(tokenise(F.col(c)).alias(names[name]) for name, c in columns.items())))))

    count = lambda atom: reduce(lambda a, b: a + b, (_times(bag, atom) * float(weights.get(name, 1.0)) for name, bag in names.items()))
    one = bags.select(F.col(key), reduce(lambda a, b: a + b, (F.size(b) for b in names.values())).alias("len"), *(count(a).alias(f"f{k}") for k, a in enumerate(atoms)))
    hits, stats = _one_pass(one, len(atoms))
    return scored(hits, key, stats, expression)


def phrase_hits(rows: DataFrame, key: str, column: str, phrase: list[str]) -> DataFrame:
    """Rows with the words in a row, and how often."""
    # As the one row of a generator, the tokens are made once and not again at every place.
    bags = rows.select(F.col(key), F.inline(F.array(F.struct(words(F.col(column)).alias("_bag")))))
    return bags.select(F.col(key), _times("_bag", tuple(phrase)).alias("times")).where("times > 0")


def ranked(scores: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows in the order, with ranks from 1."""
    top = scores.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def reciprocal_ranks(first: DataFrame, second: DataFrame, key: str, k: int = 60, top: int = 10) -> DataFrame:
    """Fuse two ranked lists by the sum of 1 / (k + rank); ties keep the first list's order."""
    both = first.select(key, F.col("rank").alias("r1")).join(second.select(key, F.col("rank").alias("r2")), key, "full_outer")
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)), F.lit(0.0))
    fused = both.select(key, "r1", "r2", (part("r1") + part("r2")).alias("score"))
    order = (F.desc("score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"), F.asc(key))
    return ranked(fused, top, *order)
