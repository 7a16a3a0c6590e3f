"""Batches of acts to markdown, plain text or JSON, with an error for every file that does not convert."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.operators import trees
from quarry.session import kept
from quarry.sources.act_tree import hoisted, parsed_in_turn, with_notes

OUTPUTS = ("markdown", "text", "json")


def nested(nodes: DataFrame) -> DataFrame:
    """Nodes whose points and items stand below the points that their labels continue; everything below moves with them."""
    # Neighbours below one parent are one outline of their own.
    group = F.concat_ws("\0", "path", F.coalesce(F.col("parent_id").cast("string"), F.lit("")))
    rows = nodes.where("type != 'note'").select(group.alias("doc_id"), F.col("node_id").cast("long").alias("seq"), F.when(F.col("type") == "point", "item").otherwise(F.col("type")).alias("type"), "number")
    places = trees.nested_points(rows).where("point_parent is not null").select(F.substring_index("doc_id", "\0", 1).alias("path"), F.col("seq").cast("int").alias("node_id"), F.col("point_parent").cast("int").alias("point_parent"), "point_level")
    out = nodes.join(places, ["path", "node_id"], "left")
    # How much deeper a node stands: the levels of its ancestors and its own.
    above = F.aggregate(trees.ancestors(F.struct(F.coalesce("point_level", F.lit(0)).alias("n"))), F.lit(0), lambda a, x: a + x["n"])
    deeper = out.withColumn("doc_id", F.col("path")).withColumn("_deeper", above).drop("doc_id")
    return deeper.withColumn("parent_id", F.coalesce("point_parent", "parent_id")).withColumn("depth", F.col("depth") + F.col("_deeper")).drop("_deeper", "point_parent", "point_level")


def converted(files: DataFrame, output: str = "markdown", keep_toc: bool = False, nest_points: bool = True, metadata: bool = True) -> DataFrame:
    """(path, engine, output, n_nodes, n_notes, error) of files (path, content).

    keep_toc keeps tables of contents, nest_points nests points by their labels, metadata
    keeps attributes in JSON. A file that no parser reads has an error and no output; the
    others are not touched by it.
    """
    if output not in OUTPUTS:
        raise ValueError(f"output is one of {', '.join(OUTPUTS)}")
    every = parsed_in_turn(files, keep_toc)
    good = every.where("error is null")
    engine = good.groupBy("path").agg(F.first("engine").alias("engine"))
    # Each step uses its input several times, so it is written.
    nodes = kept(hoisted(good.drop("error", "engine")), "hoisted")
    nodes = kept(with_notes(kept(nested(nodes), "nested") if nest_points else nodes), "nodes")
    counts = nodes.groupBy("path").agg(F.count("*").alias("n_nodes"), F.sum(F.size("notes")).alias("n_notes"))
    if output == "json":
        fields = ["node_id", "parent_id", "depth", "type", "number", "title", "text", "notes", *(["attributes"] if metadata else [])]
        made = nodes.groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["node_id"] - b["node_id"])).alias("output"))
    else:
        # Notes follow the text that they belong to.
        lines = F.when(F.size("notes") > 0, F.concat_ws("\n", "text", F.array_join(F.transform("notes", lambda n: F.concat(F.lit("Note: "), n)), "\n"))).otherwise(F.col("text"))
        shown = nodes.select(F.col("path").alias("doc_id"), "node_id", "depth", F.when(F.col("type") == "point", "item").otherwise(F.col("type")).alias("type"), "number", "title", lines.alias("text"))
        made = trees.rendered(shown, plain=output == "text").select(F.col("doc_id").alias("path"), F.col("text").alias("output"))
    bad = every.where("error is not null").select("path", "error")
    rows = engine.join(made, "path", "left").join(counts, "path", "left").withColumn("error", F.lit(None).cast("string"))
    failed = bad.select("path", F.lit(None).cast("string").alias("engine"), F.lit(None).cast("string").alias("output"), F.lit(0).cast("long").alias("n_nodes"), F.lit(0).cast("long").alias("n_notes"), "error")
    return rows.unionByName(failed)

