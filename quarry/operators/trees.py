"""Trees as node tables: inherited context, flat chunks, nested points, merged lists, rendering.

A node is a row (doc_id, node_id, parent_id, depth, type, number, title, text); node_id
counts in document order, so the ancestors of a node are, level by level, the last
nodes before it of each smaller depth. One window over a document gives them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.columns import chain

#: Levels of a tree at most; deeper nodes inherit from the levels that are known.
LEVELS = 16
# Node types whose text is a chunk, and those that type the text below them.
CHUNKED, TYPING = ("paragraph", "item", "article", "text", "definition_list"), ("paragraph", "item", "article", "section")


def _document() -> Window:
    return Window.partitionBy("doc_id").orderBy("node_id")


def ancestors(value: Column, own: bool = True) -> Column:
    """The values of a node's ancestors from the root down, and its own; nulls are left out."""
    w = _document().rowsBetween(Window.unboundedPreceding, 0)
    # A struct, so that a null value at a level hides older values of that level.
    at = lambda d: F.last(F.when(F.col("depth") == d, F.struct(value.alias("v"))), ignorenulls=True).over(w)
    above = [F.when((F.col("depth") > d) | (F.lit(own) & (F.col("depth") == d)), at(d)["v"]) for d in range(LEVELS)]
    return F.filter(F.array(*above), lambda x: x.isNotNull())


def chunks_of(nodes: DataFrame, title: str = "doc_title") -> DataFrame:
    """Flat chunks of node tables: path, numbers and type inherited, ids by document, numbers and position.

    Rows without text or of other types give no chunk but pass on their context.
    """
    label = chain([((F.col("type") == "article") & F.col("number").isNotNull(), F.concat(F.lit("Article "), F.col("number"))), (F.col("type") == "section", F.col("title")), (F.col("type") == "item", F.col("number"))], F.when(F.col("depth") == 0, F.coalesce("title", F.initcap("type"))))
    number = F.when(F.col("type").isin("article", "section", "item"), F.col("number"))
    typed = F.when(F.col("type").isin(*TYPING), F.col("type"))
    rows = nodes.select("*", ancestors(label).alias("path"), ancestors(number).alias("numbers"), ancestors(typed).alias("_types"))
    effective = F.when((F.col("type") == "text") & F.element_at("_types", -1).isin("item", "paragraph"), F.element_at("_types", -1)).otherwise(F.col("type"))
    is_chunk = F.col("type").isin(*CHUNKED) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    w = _document().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_chunk", is_chunk).withColumn("_n", F.sum(F.col("_chunk").cast("int")).over(w) - 1)
    place = F.coalesce(F.nullif(F.array_join("numbers", ":"), F.lit("")), F.lit("0"))
    rows = rows.withColumn("chunk_id", F.when(F.col("_chunk"), F.concat_ws(":", F.col("doc_id").cast("string"), place, F.col("_n").cast("string"))))
    rows = rows.withColumn("parent_chunk_id", F.try_element_at(ancestors(F.col("chunk_id"), own=False), F.lit(-1)))
    lines = F.concat(F.array(F.concat(F.lit("Document: "), F.coalesce(F.col(title), F.lit("")))), F.when(F.size("path") > 0, F.concat(F.array(F.lit("Context:")), F.transform("path", lambda p: F.concat(F.lit("- "), p)), F.array(F.lit("")))).otherwise(F.array().cast("array<string>")), F.array(F.trim("text")))
    return rows.where("_chunk").select("doc_id", F.col("_n").alias("seq"), "chunk_id", "parent_chunk_id", effective.alias("chunk_type"), "path", "numbers", F.trim("text").alias("text"), F.array_join(lines, "\n").alias("embedding_text"))


def _runs(rows: DataFrame, opens: Column, fields: list[Column]) -> DataFrame:
    """(doc_id, run): stretches of a document's rows in order, each from a row that opens one to the next."""
    run = F.sum(opens.cast("int")).over(Window.partitionBy("doc_id").orderBy("seq"))
    return rows.withColumn("_run", run).groupBy("doc_id", "_run").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("run"))


def merged(chunks: DataFrame) -> DataFrame:
    """(doc_id, seq, chunk_id, chunk_type, text, n_rows): texts that end with a colon with the items after them.

    A text or paragraph takes all items that follow without a break; an item takes only
    those whose numbers extend its own. No list reaches over a row that is no item, so a
    document falls into stretches; each is folded by itself into the heads of its rows.
    """
    item = F.col("chunk_type") == "item"
    takes = F.col("chunk_type").isin("text", "paragraph", "item") & F.trim("text").endswith(":")
    numbers = F.coalesce("numbers", F.array().cast("array<string>"))
    runs = _runs(chunks, ~item, [F.col("seq").cast("long").alias("seq"), F.col("chunk_id"), F.col("chunk_type"), F.col("text"), item.alias("item"), F.coalesce(takes, F.lit(False)).alias("takes"), numbers.alias("numbers")])

    def step(state: Column, x: Column) -> Column:
        now = state["now"]
        below = (F.size(x["numbers"]) > F.size(now["numbers"])) & (F.slice(x["numbers"], F.lit(1), F.size(now["numbers"])) == now["numbers"])
        taken = F.coalesce(now["takes"] & x["item"] & (~now["item"] | below), F.lit(False))
        head = F.when(taken, now).otherwise(F.struct(*(x[c].alias(c) for c in ("seq", "item", "takes", "numbers"))))
        return F.struct(head.alias("now"), F.concat(state["heads"], F.array(head["seq"])).alias("heads"))

    none = F.lit(None).cast("struct<seq:bigint,item:boolean,takes:boolean,numbers:array<string>>")
    heads = F.aggregate("run", F.struct(none.alias("now"), F.array().cast("array<bigint>").alias("heads")), step, lambda state: state["heads"])
    each = runs.select("doc_id", F.inline(F.arrays_zip(F.col("run").alias("x"), heads.alias("head"))))
    line = F.when(F.col("x.seq") == F.col("head"), F.col("x.text")).otherwise(F.concat_ws(" ", F.coalesce(F.try_element_at("x.numbers", F.lit(-1)), F.lit("-")), "x.text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("x.seq", line.alias("line")))), lambda x: x["line"])
    whole = each.groupBy("doc_id", "head").agg(F.min_by("x.chunk_id", "x.seq").alias("chunk_id"), F.min_by("x.chunk_type", "x.seq").alias("first_type"), F.array_join(lines, "\n").alias("text"), F.count("*").cast("int").alias("n_rows"))
    return whole.select("doc_id", F.col("head").alias("seq"), "chunk_id", F.when(F.col("n_rows") > 1, "merged_list").otherwise(F.col("first_type")).alias("chunk_type"), "text", "n_rows")


# The label that begins a list of each style anew.
STARTS = {"num": "1", "alpha": "a", "roman": "i", "ualpha": "A"}


def point_label(number: Column) -> Column:
    """struct<style, wrapper, bare, roman> of a point's label, or null; ``roman`` tells that lower-case letters may be a roman number."""
    given = F.trim(number)
    bare = F.regexp_replace(given, r"^[()\[\].:;\s]+|[()\[\].:;\s]+$", "")
    wrapper = chain([(given.rlike(r"(?s)^\(.*\)[.;:]*$"), F.lit("both")), (given.rlike(r"\)[.;:]*$"), F.lit("right")), (given.endswith("."), F.lit("dot"))], F.lit("none"))
    letters = bare.rlike(r"^\p{L}+$")
    style = chain(
        [(bare.rlike(r"^\d+(\.\d+)+$"), F.concat(F.lit("num"), (F.regexp_count(bare, F.lit(r"\.")) + 1).cast("string"))), (bare.rlike(r"^\d+[a-z]?$"), F.lit("num")), (letters & (F.lower(bare) == bare), F.lit("alpha")), (letters & (F.upper(bare) == bare), F.lit("ualpha"))],
        F.lit(None).cast("string"),
    )
    return F.when(style.isNotNull(), F.struct(style.alias("style"), wrapper.alias("wrapper"), bare.alias("bare"), bare.rlike("^(?=.)x{0,3}(ix|iv|v?i{0,3})$").alias("roman")))


def nested_points(rows: DataFrame) -> DataFrame:
    """rows (doc_id, seq, type, number) with ``point_parent``, the seq of the point each row belongs below, or null, and ``point_level``, the number of points above it.

    A label of a style that is open closes that point and all below it, unless it is the
    first label of its style, which begins a list below the current point. i, v and x are
    letters only where they follow the open letter before them. Lists belong to the
    current point; any other row closes all points, so that a document falls into
    stretches, and the open points of each are folded along its rows.
    """
    labelled = F.when(F.col("type").isin("item", "paragraph"), point_label(F.col("number")))
    known = rows.withColumn("_label", labelled)
    runs = _runs(known, F.col("_label").isNull() & (F.col("type") != "list"), [F.col("seq").cast("long").alias("seq"), F.col("type"), F.col("number"), F.col("_label").alias("label")])

    def step(state: Column, x: Column) -> Column:
        points, label = state["open"], x["label"]
        letter = F.try_element_at(F.filter(points, lambda p: (p["style"] == "alpha") & (p["wrapper"] == label["wrapper"])), F.lit(-1))["bare"]
        follows = F.coalesce((F.char_length(letter) == 1) & (F.char_length(label["bare"]) == 1) & (F.ascii(letter) + 1 == F.ascii(label["bare"])), F.lit(False))
        style = F.when(label["roman"] & ~follows, F.lit("roman")).otherwise(label["style"])
        place = F.array_position(F.transform(points, lambda p: F.concat_ws("|", p["style"], p["wrapper"])), F.concat_ws("|", style, label["wrapper"]))
        anew = reduce(lambda a, b: a | b, ((style == k) & (label["bare"] == v) for k, v in STARTS.items()))
        above = F.when(label.isNotNull() & (place > 0) & ~anew, F.slice(points, F.lit(1), F.greatest(place - 1, F.lit(0)).cast("int"))).otherwise(points)
        entry = F.struct(style.alias("style"), label["wrapper"].alias("wrapper"), label["bare"].alias("bare"), x["seq"].alias("seq"))
        parent = F.struct(F.try_element_at(above, F.lit(-1))["seq"].alias("seq"), F.size(above).alias("level"))
        return F.struct(F.when(label.isNotNull(), F.concat(above, F.array(entry))).otherwise(points).alias("open"), F.concat(state["parents"], F.array(parent)).alias("parents"))

    first = F.struct(F.array().cast("array<struct<style:string,wrapper:string,bare:string,seq:bigint>>").alias("open"), F.array().cast("array<struct<seq:bigint,level:int>>").alias("parents"))
    parents = F.aggregate("run", first, step, lambda state: state["parents"])
    return runs.select("doc_id", F.inline(F.arrays_zip(F.col("run").alias("x"), parents.alias("p")))).select("doc_id", "x.seq", "x.type", "x.number", F.col("p.seq").alias("point_parent"), F.col("p.level").alias("point_level"))


def subtree_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, n_below, text): descendants of each node, and the text of its subtree in reading order."""
    rows = nodes.select("doc_id", "node_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"), ancestors(F.col("node_id")).alias("_above"))
    each = rows.select("doc_id", F.explode("_above").alias("_node"), "node_id", "text")
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), lambda t: t != "")
    return each.groupBy("doc_id", F.col("_node").alias("node_id")).agg((F.count("*") - 1).alias("n_below"), F.array_join(texts, " ").alias("text"))


def rendered(nodes: DataFrame, plain: bool = False) -> DataFrame:
    """(doc_id, text): each document as markdown or plain lines, in order."""
    named = F.trim(F.concat_ws(" ", F.when(F.col("type") == "article", F.concat(F.lit("Article "), F.col("number"))).otherwise(F.col("number")), "title"))
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 1, F.lit(6))), F.lit(" "), named)
    point = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("depth") - 2, F.lit(0))), F.lit("- "), F.concat_ws(" ", "number", "text"))
    head = F.when(named != "", named if plain else heading)
    body = F.when(F.coalesce("text", F.lit("")) != "", F.concat_ws(" ", F.when(F.col("type") == "paragraph", F.col("number")), "text"))
    line = F.when(F.col("type") == "item", F.concat_ws(" ", "number", "text") if plain else point).when(F.col("type").isin("text", "paragraph"), body).otherwise(F.concat_ws("\n\n", head, F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit(""))))
    lines = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("node_id", line.alias("line")))), lambda x: x["line"]), lambda x: x != "")
    return nodes.groupBy("doc_id").agg(F.array_join(lines, "\n" if plain else "\n\n").alias("text"))


def orphans(sources: DataFrame, parsed: DataFrame, least: int = 20) -> DataFrame:
    """Source texts (doc_id, tag, text) whose letters and digits do not occur in what was parsed (doc_id, text) of their document; short ones are not judged."""
    print_of = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    whole = parsed.groupBy("doc_id").agg(print_of(ordered).alias("_whole"))
    return sources.join(whole, "doc_id", "left").where((F.length(print_of(F.col("text"))) >= least) & ~F.contains(F.coalesce("_whole", F.lit("")), print_of(F.col("text")))).drop("_whole")


def orphan_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("tag").agg(F.count("*").alias("n"))


def records(rows: DataFrame, limit: int = 6_000) -> DataFrame:
    """rows (lead, text, and more) cut at blanks into parts of at most ``limit`` characters, each behind the lead again, with ``part`` from 0."""
    room = F.greatest(F.lit(limit) - F.char_length(F.coalesce("lead", F.lit(""))) - 1, F.lit(1))
    n = F.char_length("text")

    def step(state: Column, word: Column) -> Column:
        fits = (F.char_length(state["now"]) + F.char_length(word) + 1 <= room) | (state["now"] == "")
        grown = F.when(state["now"] == "", word).otherwise(F.concat(state["now"], F.lit(" "), word))
        return F.struct(F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["now"]))).alias("done"), F.when(fits, grown).otherwise(word).alias("now"))

    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    parts = F.when(n <= room, F.array("text")).otherwise(F.aggregate(F.split("text", " "), first, step, lambda s: F.concat(s["done"], F.array(s["now"]))))
    return rows.select(*[c for c in rows.columns if c != "text"], F.posexplode(parts).alias("part", "_text")).withColumn("text", F.concat_ws(" ", F.nullif("lead", F.lit("")), "_text")).drop("_text")


def references(text: Column) -> Column:
    """array<struct<kind, target, label>> of markdown links and of acts named in a text, in order of kinds."""
    links = F.transform(F.regexp_extract_all(text, F.lit(r"\[[^\]\n]+\]\([^()\s]+\)"), F.lit(0)), lambda m: F.struct(F.lit("link").alias("kind"), F.regexp_extract(m, r"\(([^()]+)\)$", 1).alias("target"), F.regexp_extract(m, r"^\[([^\]]+)\]", 1).alias("label")))
    named = F.transform(F.regexp_extract_all(text, F.lit(r"(?:Regulation|Directive|Decision)\s*\((?:EU|EC|EEC)\)\s*(?:No\s*)?\d+/\d+"), F.lit(0)), lambda m: F.struct(F.lit("act").alias("kind"), F.regexp_extract(m, r"(\d+/\d+)$", 1).alias("target"), m.alias("label")))
    return F.concat(links, named)


def body_blocks(nodes: DataFrame, kinds: tuple[str, ...] = ("text", "table", "extract", "note", "quote", "formula", "reserved")) -> DataFrame:
    """(doc_id, parent_id, texts): the texts of body blocks below each node, in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"])
    return nodes.where(F.col("type").isin(*kinds) & (F.trim(F.coalesce("text", F.lit(""))) != "")).groupBy("doc_id", "parent_id").agg(texts.alias("texts"))


def with_contents(items: DataFrame, contents: DataFrame) -> DataFrame:
    """Rule items (sdt_id, and more) with the title, number and place that the table of contents (sdt_id, title, number, ord) gives; items it lacks are left out."""
    return items.join(contents.select("sdt_id", F.col("title").alias("contents_title"), F.col("number").alias("contents_number"), F.col("ord").alias("contents_ord")), "sdt_id")
