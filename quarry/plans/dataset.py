"""Training examples from chunks: document-level split, templates, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.session import kept


def split_documents(docs: DataFrame, key: str, shares: tuple[float, float] = (0.8, 0.1), seed: str = "42") -> DataFrame:
    """train, val or test of each document.

    Documents are ordered by a seeded hash; the counts are the rounded shares, at least
    one each, and the rest is test. Positions come from counts of hash ranges, so no
    single task orders all documents.
    """
    rows = docs.select(key).distinct().withColumn("h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    rows = rows.withColumn("bin", F.substring("h", 1, 3))
    bins = rows.groupBy("bin").agg(F.count("*").alias("c"))  # at most 4,096 rows
    before = bins.select("bin", (F.sum("c").over(Window.orderBy("bin")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    placed = rows.join(F.broadcast(before), "bin").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("h", key)))
    n_val = F.greatest(F.lit(1), F.round(F.col("n") * shares[1]))
    n_test = F.greatest(F.lit(1), F.round(F.col("n") * (1 - shares[0] - shares[1])))
    train = F.col("n") - n_val - n_test
    return placed.select(key, F.when(F.col("place") <= train, "train").when(F.col("place") <= train + n_val, "val").otherwise("test").alias("split"))


def examples(chunks: DataFrame, templates: dict[str, tuple[Column, Column]], split: DataFrame, key: str) -> DataFrame:
    """One row for each template with a target, with a stable id; equal ids once."""
    parts = F.array(*(F.struct(F.lit(task).alias("task"), prompt.alias("prompt"), target.alias("target")) for task, (prompt, target) in templates.items()))
    rows = chunks.select(key, "chunk_id", F.explode(parts).alias("x")).select(key, "chunk_id", "x.*").where(F.length(F.trim("target")) > 0)
    stable = F.substring(F.sha2(F.concat_ws("\x1f", "task", "chunk_id", "prompt", "target"), 256), 1, 20)
    return rows.withColumn("id", stable).dropDuplicates(["id"]).join(split, key)


def provision_templates(language: str = "language", date: str = "date") -> dict[str, tuple[Column, Column]]:
    """The tasks that a provision gives, as (prompt, target) of rows with chunk and document columns; a null or empty target gives no example.

    Rows have text, doc_id, title, chunk_type, node_type, path and numbers (arrays), references
    (array), modals (array of struct text, modality, trigger, party), and doc_metadata (JSON).
    """
    ask = lambda question: F.concat(F.lit(question + "\n\nProvision:\n"), F.col("text"))
    some = lambda array, value: F.when(F.size(array) > 0, value)
    modal = lambda k: F.get("modals", F.lit(k))
    facts = F.struct(*(F.get_json_object("doc_metadata", f"$.{f}").alias(f) for f in ("status", "doc_number", "amends_regs", "repeals_regs", "eea_relevance", "annex_count")))
    known = F.coalesce(*(facts[f] for f in ("status", "doc_number", "amends_regs", "repeals_regs", "eea_relevance", "annex_count")))
    out = {
        "document_identification": (ask("Which document holds this provision?"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("document_id"), "title", language, date))),
        "structural_location": (ask("Where in its document does this provision stand?"), F.to_json(F.struct(F.col("path").alias("section_path"), F.col("numbers").alias("section_numbers"), "chunk_type"))),
        "chunk_classification": (ask("What kind of node is this text?"), F.to_json(F.struct("chunk_type", "node_type"))),
        "reference_extraction": (ask("List the references recorded for this provision, and no others."), some("references", F.to_json("references"))),
        "document_metadata": (ask("What is known of the document that holds this provision?"), F.when(known.isNotNull(), F.to_json(facts))),
        "context_reconstruction": (ask("Put this provision into its context."), some("path", F.concat(F.coalesce("title", F.lit("")), F.lit("\nSection: "), F.array_join("path", " > "), F.lit("\nProvision: "), F.col("text")))),
    }
    for k in range(3):
        out[f"modal_extraction_{k}"] = (ask("Name the explicit obligation in this provision, and infer none."), F.when(modal(k).isNotNull(), F.to_json(modal(k))))
    return out


def asked(rows: DataFrame, ask, retries: int = 2) -> DataFrame:
    """rows (id, text) with ``pairs``, question and answer pairs from a model, and ``error``.

    ``ask`` maps a text to a list of dictionaries; one with other keys than q and a, or an
    exception, counts as a failure and is tried again.
    """
    import pandas as pd

    def one(text: str) -> tuple[list, str | None]:
        error = None
        for _ in range(retries + 1):
            try:
                pairs = ask(text)
                if isinstance(pairs, list) and all(isinstance(p, dict) and set(p) == {"q", "a"} for p in pairs):
                    return [{"q": str(p["q"]), "a": str(p["a"])} for p in pairs], None
                error = "unexpected shape"
            except Exception as e:  # whatever the model raises
                error = str(e)[:4000]
        return [], error

    def run(batches):
        for batch in batches:
            found = [one(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "pairs": [f[0] for f in found], "error": [f[1] for f in found]})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInPandas(run, f"id {kind}, pairs array<struct<q: string, a: string>>, error string")


def with_questions(made: DataFrame, chunks: DataFrame, split: DataFrame, key: str, ask, most: int, seed: str = "42", retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """Examples and, behind them, question-answer examples of at most ``most`` chunks (chunk_id, text, and the key) drawn by a seeded hash; and the failures (chunk_id, error).

    Chunks that have such examples already are not drawn again, so a repeated call goes on;
    pairs with an empty answer are left out. ``made`` must have the columns of `examples`.
    """
    done = made.where("task = 'question'").select("chunk_id").distinct()
    drawn = chunks.where("trim(coalesce(text, '')) != ''").join(done, "chunk_id", "left_anti").orderBy(F.md5(F.concat(F.lit(seed), F.col("chunk_id").cast("string"))), "chunk_id").limit(most)
    answers = kept(asked(drawn.select(F.col("chunk_id").alias("id"), "text"), ask, retries).withColumnRenamed("id", "chunk_id"), "answers")
    pairs = answers.select("chunk_id", F.posexplode("pairs").alias("n", "pair")).where("trim(pair.a) != ''")
    rows = pairs.join(drawn.select("chunk_id", key), "chunk_id").join(split, key).select(
        key, "chunk_id", F.lit("question").alias("task"), F.col("pair.q").alias("prompt"), F.col("pair.a").alias("target"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit("question"), "chunk_id", "pair.q", "pair.a"), 256), 1, 20).alias("id"), "split"
    )
    return made.unionByName(rows.dropDuplicates(["id"])), answers.where("error is not null").select("chunk_id", "error")


def judged(queue: DataFrame, judge, dimensions: dict[str, float], most_attempts: int = 3) -> DataFrame:
    """A queue (id, text, attempts, and more) after one round of a model: score, priority and bucket of judged rows, attempts and error of all that were tried.

    ``judge`` maps a text to a dictionary of the dimensions' numbers; an exception or a
    missing number is the row's error and touches no other row. Rows with a score or with
    ``most_attempts`` attempts are not tried.
    """
    import pandas as pd

    from quarry.functions.text import triage

    names = list(dimensions)

    def one(text: str):
        try:
            found = judge(text)
            return [float(found[n]) for n in names], None
        except KeyError as e:
            return None, f"no number for {e.args[0]}"
        except Exception as e:  # whatever the model raises
            return None, f"{type(e).__name__}: {e}"[:4000]

    def ask(texts):
        return pd.DataFrame([one(t) for t in texts], columns=["scores", "error"])

    ask.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    ask = F.pandas_udf(ask, "scores array<double>, error string")

    held = [c for c in ("score", "priority", "bucket", "error") if c in queue.columns]
    waiting = (F.col("score").isNull() if "score" in held else F.lit(True)) & (F.coalesce("attempts", F.lit(0)) < most_attempts)
    tried = kept(queue.where(waiting).withColumn("_x", ask(F.coalesce("text", F.lit("")))), "judged")
    scored = tried.select("*", *(F.get("_x.scores", F.lit(k)).alias(f"_{n}") for k, n in enumerate(names)))
    score, priority, bucket = triage({f"_{n}": w for n, w in dimensions.items()})
    good = F.col("_x.error").isNull()
    after = scored.drop(*held).withColumns({"score": F.when(good, score), "priority": F.when(good, priority), "bucket": F.when(good, bucket), "error": F.col("_x.error"), "attempts": F.coalesce("attempts", F.lit(0)) + 1}).drop("_x", *(f"_{n}" for n in names))
    return after.unionByName(queue.where(~waiting), allowMissingColumns=True)


def report(made: DataFrame, key: str) -> DataFrame:
    return made.groupBy("split", "task").agg(F.count("*").alias("examples"), F.countDistinct(key).alias("documents"))
