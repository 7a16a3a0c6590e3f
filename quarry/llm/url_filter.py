"""URL filter: rules on host and path first, gradient-boosted trees for all other URLs.

A rule fits its host and all subdomains of it if the URL's path begins with the rule's
path; of the rules that fit, the longest decides. What no rule decides is judged by
boosted trees over lexical features: lengths, depth, shares of digits and signs,
entropy, parameters, and statistics of suffixes, i.e. how often labelled URLs of the same
top-level name, of the same last two labels, of these with the path's first segment, and of
the same file ending are bad. For a training row these come from the other folds, so that
a URL's own label is no feature of it; half of the training rows lack those of their
host, some but for its top-level name, as URLs of hosts that nobody labelled do, so that
the trees learn to judge without. Both classes weigh the same; a URL is blocked from a score of THRESHOLD on.

Labelled URLs are rows (url, label), label 1 for bad ones. Without any, the URLs that the
rules decide are the labelled ones: the trees then carry the rules' experience over to
hosts that have none. One fifth of the labelled URLs, by crc32 of the URL, is held out and
never learnt from. The fit takes at most about TRAIN_URLS of the distinct others,
chosen by a hash; so the statistics have at most 4 * TRAIN_URLS rows, are a bounded
broadcast, and a suffix that the sample lacks counts as one half.

Defined results: a null URL or one without `://` has an empty host and path and no rule; it
is judged by the trees like any other; repeated rows are judged one by one; of several
labels of one URL the largest counts, null labels are ignored; with labels of one class
every undecided URL gets that class, without labels it is allowed; an empty table gives an
empty result. Only the page's id and URL are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.scratch import written

#: Rules as (host and path, verdict); the path begins at the first slash.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Up to so many rules are one expression in the scan; more are joined.
LITERAL_RULES = 200
#: Rules up to which their table is broadcast (under 200 bytes a row); a larger one is shuffled, its keys salted into SALTS parts.
BROADCAST_RULES, SALTS = 200_000, 16
TRAIN_URLS, ROUNDS, DEPTH, FOLDS = 40_000, 20, 4, 4
THRESHOLD = 0.7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SUFFIXES = ("top", "domain", "section", "ending")
FEATURES = ("length", "host_length", "labels", "longest_label", "hyphens", "host_digits", "depth", "digits", "signs", "escapes", "capitals", "entropy", "parameters", "query_length", "fragment", "secure", *(f"{s}_{k}" for s in _SUFFIXES for k in ("bad", "seen")))


def with_parts(pages: DataFrame) -> DataFrame:
    """pages with host and path, by the first `://`; both are empty without it."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(url, whole, 1), _UPPER, _LOWER)).withColumn("path", F.regexp_extract(url, whole, 2))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule, verdict) of pairs; an operator's caller may read a longer list from anywhere."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def _split(rules: DataFrame) -> DataFrame:
    """(rule, verdict, rule_host, rule_path), one row for each rule; of a rule with two verdicts, block wins."""
    clean = rules.where("rule is not null and verdict is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    host = F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)", 1), _UPPER, _LOWER)
    return clean.select("rule", "verdict", host.alias("rule_host"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("rule_path"))


def _by_expression(pages: DataFrame, rules: list) -> DataFrame:
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r["rule"]), len(r["rule_host"]), r["rule"])):  # a longer one, further out, is asked first
        fits = ((F.col("host") == r["rule_host"]) | F.col("host").endswith("." + r["rule_host"])) & F.col("path").startswith(r["rule_path"])
        best = F.when(fits, F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["verdict"]).alias("verdict"))).otherwise(best)
    return pages.withColumn("decided", best)


def _by_join(pages: DataFrame, rules: DataFrame, few: bool) -> DataFrame:
    """Each URL's keys, its host's suffixes with its path's beginnings of all lengths that rules have, are looked up; keys are salted where the rules are shuffled."""
    rows = written(pages.withColumn("row_key", F.monotonically_increasing_id()), "pages")
    lengths = F.array(*(F.lit(r[0]) for r in rules.select(F.char_length("rule_path")).distinct().collect()))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.left(F.col("path"), n))
    keys = rows.select("row_key", F.explode(hosts).alias("rule_host"), starts.alias("starts")).select("row_key", "rule_host", F.explode("starts").alias("rule_path"))
    on = ["rule_host", "rule_path"]
    if few:
        hits = keys.join(F.broadcast(rules), on)
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = keys.withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"])
    best = hits.groupBy("row_key").agg(F.max(F.struct(F.char_length("rule").alias("n"), F.char_length("rule_host").alias("m"), "rule", "verdict")).alias("x"))
    return rows.join(best, "row_key", "left").withColumn("decided", F.struct("x.rule", "x.verdict")).drop("row_key", "x")


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (with host and path) with the struct decided (rule, verdict), null where no rule fits."""
    rules = _split(rules)
    found = rules.limit(LITERAL_RULES + 1).collect()
    if len(found) <= LITERAL_RULES:
        return _by_expression(pages, found)
    rules = written(rules, "rules")
    return _by_join(pages, rules, rules.count() <= BROADCAST_RULES)


def _entropy(text: Column) -> Column:
    """Bits for each character; characters outside ASCII count as one, so that there are at most 129 kinds."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", "é")
    n = F.char_length(plain)
    return F.aggregate(
        F.filter(F.array_distinct(F.split(plain, "")), lambda c: c != ""), F.lit(0.0), lambda s, c: s - (lambda p: p * F.log2(p))((n - F.char_length(F.replace(plain, c, F.lit("")))) / n)
    )


def described(pages: DataFrame) -> DataFrame:
    """pages (url, host, path, and more) with the lexical features and the suffixes' keys; each row by itself."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1))
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), F.lit(k)), ".")
    double = lambda c: c.cast("double")
    return (
        pages.withColumn("length", double(F.char_length(url)))
        .withColumn("host_length", double(F.char_length("host")))
        .withColumn("labels", double(F.size(labels)))
        .withColumn("longest_label", double(F.array_max(F.transform(labels, F.char_length))))
        .withColumn("hyphens", double(F.regexp_count("host", F.lit("[-_]"))))
        .withColumn("host_digits", double(F.regexp_count("host", F.lit("[0-9]"))))
        .withColumn("depth", double(F.regexp_count("path", F.lit("/[^/]"))))
        .withColumn("digits", F.regexp_count(url, F.lit("[0-9]")) / n)
        .withColumn("signs", F.regexp_count(url, F.lit("[^0-9A-Za-z]")) / n)
        .withColumn("escapes", double(F.regexp_count(url, F.lit("%[0-9A-Fa-f]{2}"))))
        .withColumn("capitals", F.regexp_count(url, F.lit("[A-Z]")) / n)
        .withColumn("entropy", _entropy(url))
        .withColumn("parameters", double(F.regexp_count(query, F.lit("[^&]+"))))
        .withColumn("query_length", double(F.char_length(query)))
        .withColumn("fragment", double(url.contains("#")))
        .withColumn("secure", double(url.startswith("https://")))
        .withColumn("top", last(1))
        .withColumn("domain", last(2))
        .withColumn("section", F.concat(last(2), F.regexp_extract("path", r"(?s)^(/[^/]*)", 1)))
        .withColumn("ending", F.regexp_extract("path", r"(?s)\.([^./]*)$", 1))
    )


def _with_statistics(rows: DataFrame, sums: DataFrame, fold: bool) -> DataFrame:
    """rows with each suffix's share of bad URLs (drawn to one half) and its weight of labelled URLs; with fold, without those of the row's own fold, and of some rows without those of the host's suffixes or the narrow ones."""
    for s in _SUFFIXES:
        own = F.broadcast(sums.where(F.col("kind") == s).select(F.col("key").alias(s), F.col("bad").alias("_bad"), F.col("seen").alias("_seen"), F.col("folds").alias("_folds")))
        rows = rows.join(own, s, "left")
        bad, seen = F.coalesce("_bad", F.lit(0.0)), F.coalesce("_seen", F.lit(0.0))
        if fold:
            mine = F.element_at("_folds", F.col("fold") + 1)
            shown = F.col("shown") >= {"ending": 0, "top": 1}.get(s, 2)
            bad, seen = (F.when(shown, F.greatest(x - F.coalesce(mine[k], F.lit(0.0)), F.lit(0.0))).otherwise(0.0) for k, x in (("bad", bad), ("seen", seen)))
        rows = rows.withColumn(f"{s}_bad", (bad + 2) / (seen + 4)).withColumn(f"{s}_seen", F.log1p(seen)).drop("_bad", "_seen", "_folds")
    return rows


def held_out(url: Column) -> Column:
    """True for the labelled URLs that are never learnt from."""
    return F.crc32(F.coalesce(url.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """Boosted trees with the suffix statistics that they need, or one score for all."""

    def __init__(self, trees=None, sums: DataFrame | None = None, score: float = 0.0):
        self.trees, self.sums, self.score = trees, sums, score

    def scored(self, pages: DataFrame) -> DataFrame:
        """pages (url, host, path, and more) with score, the chance of being bad."""
        if self.trees is None:
            return pages.withColumn("score", F.lit(float(self.score)))
        from pyspark.ml.functions import vector_to_array

        columns = pages.columns
        ready = _vectors(_with_statistics(described(pages), self.sums, fold=False))
        return self.trees.transform(ready).withColumn("score", vector_to_array("probability")[1]).select(*columns, "score")


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)


def train(labelled: DataFrame) -> Model:
    """Fit on labelled URLs (url, label) outside the held-out fifth."""
    from pyspark.ml.classification import GBTClassifier

    known = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("url"))).groupBy("url").agg(F.max(F.col("label").cast("double")).alias("label"))
    known = written(known.withColumn("hash", F.xxhash64("url")), "labelled")
    count, bad = known.agg(F.count("*"), F.sum("label")).first()
    if not count or bad in (0, count):
        return Model(score=float(bool(bad)))
    # In a bounded sample rare classes are taken in full as far as its half allows.
    half = TRAIN_URLS // 2
    share = F.when(F.col("label") == 1, min(1.0, max(half, TRAIN_URLS - (count - bad)) / bad)).otherwise(min(1.0, max(half, TRAIN_URLS - bad) / (count - bad)))
    some = known.where(F.pmod("hash", F.lit(1_000_003)) < share * 1_000_003).withColumn("fold", F.pmod(F.xxhash64("hash"), F.lit(FOLDS)).cast("int"))
    # Of four rows two show all statistics, one of the host those of its top-level name, one none of them.
    some = some.withColumn("shown", F.least(F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(4)), F.lit(2)))
    rows = written(described(with_parts(some)), "described")
    mean = rows.agg(F.avg("label")).first()[0]
    if mean is None or mean in (0.0, 1.0):
        return Model(score=mean or 0.0)
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / mean).otherwise(0.5 / (1 - mean)))
    kinds = F.explode(F.array(*(F.struct(F.lit(s).alias("kind"), F.col(s).alias("key")) for s in _SUFFIXES))).alias("x")
    of = lambda f: F.struct(F.sum(F.when(F.col("fold") == f, F.col("weight") * F.col("label")).otherwise(0.0)).alias("bad"), F.sum(F.when(F.col("fold") == f, F.col("weight")).otherwise(0.0)).alias("seen"))
    sums = written(rows.select("label", "weight", "fold", kinds).groupBy("x.kind", "x.key").agg(F.sum(F.col("weight") * F.col("label")).alias("bad"), F.sum("weight").alias("seen"), F.array(*map(of, range(FOLDS))).alias("folds")), "suffixes")
    training = written(_vectors(_with_statistics(rows, sums, fold=True)).select("label", "weight", "vector"), "training")
    trees = GBTClassifier(labelCol="label", featuresCol="vector", weightCol="weight", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, seed=7).fit(training)
    return Model(trees, sums)


def url_verdicts(pages: DataFrame, rules: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score, held_out (of a fold that is never learnt from)."""
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    judged = with_rules(with_parts(pages.select("page_id", "url")), rules)
    if labelled is None:
        labelled = judged.where("decided.rule is not null").select("url", F.when(F.col("decided.verdict") == "block", 1).otherwise(0).alias("label"))
    scored = train(labelled).scored(judged)
    verdict = F.coalesce("decided.verdict", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("decided.rule").alias("rule"), verdict.alias("verdict"), "score", held_out(F.col("url")).alias("held_out"))
