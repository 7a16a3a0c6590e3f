"""Secrets: candidate strings judged by a random forest; DataFrame functions only.

Candidates are unbroken runs of key characters, of any length: those with a digit, those
that something is assigned to (behind a colon or an equals sign, with or without a
quote), and those of LONG or more letters, which are no word; `=` ends a run except as
padding, so a name before it is no part. A forest of decision trees, trained from labelled findings, removes the false
ones. Features: length; transitions between character classes; shares of digits, of
capitals, of hexadecimal characters and of different characters; coverage by
trigrams of the corpus' own words; slashes, dots and file endings (paths), and words
like `test` in the path that a column may name; and the neighbouring words: names of
credentials before it, an assignment, quotes, and plain words on both sides.

Labelled findings are rows (hit, left, right, label, and path if there is one).
Without any, `planted` makes TRAIN_ROWS of them, whose labels follow from how the
string was made and not from the features: keys of several alphabets and lengths are
findings; numbers, dates, versions, hosts, paths, hashes of commits and files, and
compounds of the corpus' frequent words are none; each kind stands in contexts drawn
from a list, one third of them in neutral ones that both labels share. The trigram
dictionary counts the words of all texts; it has at most 26 ** 3 entries, which stand
in the plan as one literal.

Defined results: null and empty texts have no candidates; repeated rows and several
equal candidates are judged one by one; very long texts are scanned whole, and a
very long run is one candidate; with labels of one class only, every candidate gets
that class; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.pii import located
from quarry.llm.scratch import written

LONG, TRAIN_ROWS, TREES, DEPTH = 20, 8_000, 30, 8
_KEY = "A-Za-z0-9+/_.~-"
CANDIDATE = rf"(?<![{_KEY}])(?:(?=[A-Za-z+/_.~-]*+[0-9])[{_KEY}]++|[{_KEY}]{{{LONG},}}+|(?<=[:=]>?[ \t]{{0,2}}[\"'`]?)[{_KEY}]++)={{0,2}}"
NAMES = r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|private|credential|bearer|auth)"
FEATURES = ("length", "changes", "digits", "capitals", "hexes", "kinds", "covered", "slashes", "dots", "ending", "trial", "named", "assigned", "quoted", "before", "after")
#: Words of the corpus that compounds are made of, and occurrences that a trigram's words need.
FREQUENT, TIMES = 200, 3


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(row_key, doc_id, path, found): the candidates of each row with place and surroundings."""
    around = F.transform(located(F.coalesce("text", F.lit("")), CANDIDATE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), F.right(x["tail"], F.lit(40)).alias("left"), F.left(x["head"], F.lit(20)).alias("right")))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    return docs.select("doc_id", where.alias("path"), around.alias("found")).withColumn("row_key", F.monotonically_increasing_id())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): lower-case words of 3 to 15 letters of all texts, counted map-side first."""
    return docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?<![a-z])[a-z]{3,15}+(?![a-z])"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _trigrams(word: Column) -> Column:
    """Numbers of a word's trigrams of letters; null where another character takes part."""
    code = lambda i: F.ascii(F.substring(word, i, F.lit(1))) - 97
    ok = lambda c: (c >= 0) & (c < 26)
    number = lambda a, b, c: F.when(ok(a) & ok(b) & ok(c), (a * 26 + b) * 26 + c)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word) - 2, F.lit(1))), lambda i: number(code(i), code(i + 1), code(i + 2)))


def dictionary(words: DataFrame) -> Column:
    """A literal array with 1 for every trigram that TIMES words or more of TIMES occurrences or more hold."""
    grams = words.where(f"n >= {TIMES}").select(F.explode(F.array_distinct(_trigrams(F.col("word")))).alias("g")).where("g is not null").groupBy("g").count().where(f"count >= {TIMES}")
    known = {r["g"] for r in grams.collect()}
    return F.split(F.lit(",".join("1" if g in known else "0" for g in range(26**3))), ",").cast("array<int>")


def described(hits: DataFrame, known: Column) -> DataFrame:
    """hits (hit, left, right, path, and more) with the feature columns; each row by itself."""
    hit, n = F.col("hit"), F.char_length("hit")
    share = lambda pattern: F.regexp_count(hit, F.lit(pattern)) / n
    flag = lambda name, pattern: F.col(name).rlike(pattern).cast("double")
    change = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    covered = F.get(F.transform(F.array(known), lambda k: F.aggregate(_trigrams(F.lower(hit)), F.lit(0), lambda a, g: a + F.coalesce(F.get(k, g), F.lit(0)))), F.lit(0))
    return (
        hits.withColumn("length", F.least(n, F.lit(200)).cast("double"))
        .withColumn("changes", F.regexp_count(hit, F.lit(change)) / n)
        .withColumn("digits", share("[0-9]"))
        .withColumn("capitals", share("[A-Z]"))
        .withColumn("hexes", share("[0-9a-fA-F]"))
        .withColumn("kinds", F.size(F.array_distinct(F.split(hit, ""))) / F.least(n, F.lit(64)))
        .withColumn("covered", covered / F.greatest(n - 2, F.lit(1)))
        .withColumn("slashes", share("/"))
        .withColumn("dots", share(r"\."))
        .withColumn("ending", flag("hit", r"\.[A-Za-z][A-Za-z0-9]{0,3}$"))
        .withColumn("trial", flag("path", r"(?i)test|example|sample|mock|fixture"))
        .withColumn("named", F.right("left", F.lit(30)).rlike(NAMES).cast("double"))
        .withColumn("assigned", flag("left", r"[=:]\s*[\"'`]?$"))
        .withColumn("quoted", (F.col("left").rlike(r"[\"'`]$") & F.col("right").rlike(r"^[\"'`]")).cast("double"))
        .withColumn("before", flag("left", r"\p{L}{2,}[.,;]?\s$"))
        .withColumn("after", flag("right", r"^[.,;!?]*\s\p{L}{2,}"))
    )


def planted(spark: SparkSession, words: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(number, hit, left, right, path, label): made findings, half of them true."""
    frequent = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()] or ["word"]
    pick = lambda options, salt: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("number", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    dice = lambda salt, n: F.pmod(F.xxhash64("number", F.lit(salt)), F.lit(n)).cast("int")
    hexes = F.concat(*(F.sha2(F.concat(F.col("number").cast("string"), F.lit(s)), 256) for s in ("a", "b")))
    figures = F.regexp_replace(hexes, "[a-f]", "")
    base64 = F.base64(F.unhex(hexes))
    mixed = F.regexp_replace(base64, "[+/=]", "")
    cut = lambda text, low, span, salt: F.substring(text, F.lit(1), F.lit(low) + dice(salt, span))
    true = [
        F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), F.substring(hexes, 1, 64), cut(hexes, 24, 60, "h"), F.upper(F.substring(hexes, 1, 40)), cut(base64, 24, 44, "b"), cut(mixed, 16, 44, "m"),
        F.concat(F.lit("AK"), F.upper(F.substring(mixed, 1, 18))), F.concat(pick(["ghp_", "sk-", "xoxb-", "glpat-", "pk_live_"], "p"), cut(mixed, 20, 20, "q")), F.concat_ws(".", F.substring(mixed, 1, 30), F.substring(mixed, 31, 30), F.substring(base64, 1, 24)), F.concat(cut(mixed, 8, 7, "s"), dice("t", 100).cast("string")),
        F.concat(pick(frequent, "pw0"), dice("pw1", 1000).cast("string")), F.concat(pick(frequent, "pw0"), pick(frequent, "pw2"), pick(frequent, "pw3")), cut(F.regexp_replace(F.lower(mixed), "[0-9]", ""), 6, 14, "pw4"),
    ]
    word = [pick(frequent, f"w{k}") for k in range(4)]
    number = lambda salt, n: dice(salt, n).cast("string")
    false = [
        F.substring(figures, 1, 16), cut(figures, 8, 14, "f"), F.concat_ws("-", F.concat(F.lit("20"), number("y", 90)), number("o", 12), number("d", 31)), F.concat_ws(".", number("v", 30), number("x", 900), number("z", 90), number("u", 999)), F.concat_ws("-", F.substring(figures, 1, 3), F.substring(figures, 4, 4)),
        F.concat(F.lit("mail"), number("i", 99), F.lit("."), word[0], F.lit(".com")), F.concat(F.lit("/usr/lib/"), word[0], F.lit("/"), word[1], number("j", 99), F.lit(".so")), F.concat(word[0], F.lit("/"), word[1], F.lit("_"), word[2], number("k", 9), F.lit(".py")), F.concat(word[0], F.initcap(word[1]), F.initcap(word[2]), F.initcap(word[3]), number("l", 99)), F.concat(word[0], word[1], word[2], word[3], word[1], word[2]), cut(figures, 1, 6, "sf"), word[0], F.concat(word[0], number("n", 99)), pick(["Bearer", "Basic", "Token", "Digest", "null", "none", "true", "string", "required"], "sc"), F.substring(hexes, 1, 40), F.substring(hexes, 1, 64),
    ]
    passwords = range(len(true) - 3, len(true))  # words are a secret only where their context says so
    scheme = len(false) - 3  # what is assigned to a credential without being one
    hashes = (len(false) - 2, len(false) - 1)  # a hash is no secret where its context says so
    kind = F.when(F.col("label") == 1, dice("kind", len(true))).otherwise(dice("kind", len(false)))
    of = lambda options: F.element_at(F.array(*options), F.col("kind") + 1)
    neutral = ["", "see ", "the value ", "id = ", "with ", '("', "> ", "of the ", "- "]
    secretive = ['token = "', "password: ", "api_key=", "Authorization: Bearer ", "?access_token=", "export SECRET_KEY=", "pwd='", 'private_key: "', "auth_token => '", "the password is "]
    plain = ["version ", "order ", "on ", "file ", "call ", "host: ", "number ", "path = ", "from ", "at "]
    digest = ["commit ", "sha256:", "index ", "checksum: ", "revision ", "md5 = "]
    shared = dice("shared", 3) == 0
    left = F.when(F.col("label") == 1, F.when(shared & ~F.col("kind").isin(*passwords), pick(neutral, "n")).otherwise(pick(secretive, "n"))).when(F.col("kind").isin(*hashes), pick(digest, "n")).when(F.col("kind") == scheme, pick(secretive, "n")).when(shared, pick(neutral, "n")).otherwise(pick(plain, "n"))
    closing = F.regexp_extract("left", r"[\"']$", 0)
    out = spark.range(rows).select(F.col("id").alias("number")).withColumn("label", F.pmod(F.xxhash64("number", F.lit("label")), F.lit(2)).cast("double"))
    out = out.withColumn("kind", kind).withColumn("left", F.concat(word[3], F.lit(" "), left)).withColumn("hit", F.when(F.col("label") == 1, of(true)).otherwise(of(false)))
    right = F.concat(closing, pick([" ", ". ", "\n", ", ", ""], "r"), F.when(dice("follow", 3) > 0, word[2]).otherwise(F.lit("")))
    return out.select("number", "hit", "left", right.alias("right"), F.lit("").alias("path"), "label")


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_candidates, n_secrets, spans (start:end of secrets in code points)."""
    from pyspark.ml.functions import vector_to_array

    rows = written(candidates(docs, path), "candidates")
    words = written(word_counts(docs), "words")
    known = dictionary(words)
    if labelled is None:
        labelled = planted(docs.sparkSession, words)
    elif "path" not in labelled.columns:
        labelled = labelled.withColumn("path", F.lit(""))
    features = described(rows.select("row_key", "path", F.explode("found").alias("x")).select("row_key", "path", "x.*"), known)
    model, only = trained(labelled, known)
    if model:
        judged = model.transform(_vectors(features)).withColumn("secret", vector_to_array("probability")[1] >= 0.5)
    else:
        judged = features.withColumn("secret", F.lit(only == 1.0))
    kept = judged.where("secret").groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = F.coalesce(F.size("spans"), F.lit(0)).cast("long")
    return rows.join(kept, "row_key", "left").select("doc_id", F.size("found").cast("long").alias("n_candidates"), n.alias("n_secrets"), F.coalesce(spans, F.lit("")).alias("spans"), (n > 0).alias("found_secret"))


def _vectors(features: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(features)


def trained(labelled: DataFrame, known: Column):
    """A forest fitted on at most TRAIN_ROWS findings of each label, chosen by a hash; or None and the only label."""
    from pyspark.ml.classification import RandomForestClassifier

    counts = {r["label"]: r["count"] for r in labelled.where("label is not null").groupBy("label").count().collect()}
    if len(counts) < 2:
        return None, next(iter(counts), None)
    share = F.element_at(F.create_map(*(F.lit(x) for k, c in counts.items() for x in (k, min(1.0, TRAIN_ROWS / c)))), F.col("label"))
    some = labelled.where(F.pmod(F.xxhash64("hit", "left", "right"), F.lit(1_000_003)) < share * 1_000_003)
    training = written(described(some, known).select("label", *FEATURES), "training")
    return RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=13).fit(_vectors(training)), None
