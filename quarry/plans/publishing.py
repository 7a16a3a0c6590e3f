"""Documents and their chunks, changed and published as one version of both tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from quarry.operators.chunks import suffixed
from quarry.sources.snapshots import Conflict, Snapshots

DOCUMENTS, CHUNKS = "documents", "chunks"


def _again(change: Callable[[], int], times: int = 5) -> int:
    """Derive and publish anew while others publish first."""
    for _ in range(times - 1):
        try:
            return change()
        except Conflict:
            continue
    return change()


def replace_documents(store: Snapshots, documents: DataFrame, chunks: DataFrame, key: str = "document_id") -> int:
    """Put documents and all their chunks in the place of what is stored of the same keys; returns the version.

    Rows with a null key are refused, repeated keys are taken once (a whole row of them,
    chosen by a hash of it), and chunks of documents that are not given are left out.
    """
    fields = [F.to_json(F.struct(*documents.columns))]
    first = documents.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*documents.columns), F.xxhash64(*fields)).alias("_row")).select("_row.*")

    def change() -> int:
        base = store.pointer()
        keys = first.select(key)
        mine = chunks.join(keys, key, "left_semi")
        return store.publish({DOCUMENTS: _kept(store, base, DOCUMENTS, keys, key, first), CHUNKS: _kept(store, base, CHUNKS, keys, key, mine)}, base=base)

    return _again(change)


def delete_documents(store: Snapshots, keys: DataFrame, key: str = "document_id") -> int:
    """Delete documents and their chunks; unknown keys change nothing."""

    def change() -> int:
        base = store.pointer()
        gone = keys.select(key).where(F.col(key).isNotNull()).distinct()
        return store.publish({name: _kept(store, base, name, gone, key, None) for name in (DOCUMENTS, CHUNKS) if name in base["tables"]}, base=base)

    return _again(change)


def _kept(store: Snapshots, base: dict, name: str, keys: DataFrame, key: str, added: DataFrame | None) -> DataFrame:
    """A stored table without the rows of some keys and with others; the stored columns stay, new ones come last."""
    if name not in base["tables"]:
        return added
    old = store.frame(base["tables"][name]).join(keys, key, "left_anti")
    return old if added is None else old.unionByName(added, allowMissingColumns=True)


def volume_tables(parts: DataFrame, source: str, authority: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of a volume's part chunks (path, document_id, seq, title, text, chunk_id).

    Sections without text give no chunk but count in their document; chunk ids repeated
    over several volumes are told apart.
    """
    named = parts.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).withColumn("title", F.trim(F.coalesce("title", F.lit(""))))
    documents = named.groupBy("document_id").agg(F.min("path").alias("path"), F.count("*").alias("sections"), F.count_if(F.col("text") != "").alias("n_chunks"), F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("n_words"))
    documents = documents.withColumn("source", F.lit(source)).withColumn("authority", F.lit(authority)).withColumn("title", F.translate("document_id", "_", " "))
    rows = named.where("text != ''").select("document_id", "seq", "chunk_id", "title", "text", F.concat_ws("\n", F.nullif("title", F.lit("")), "text").alias("embedding_text"))
    return documents, suffixed(rows, "chunk_id", "seq", "chunk_id")
