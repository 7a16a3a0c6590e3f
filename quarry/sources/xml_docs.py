"""XML and ZIP sources as rows: files, archive members, act trees, rule items and regulation parts.

Files are read with Spark's binaryFile source, one row each; a file that does not
parse gives an error row and never stops a job. Trees come out as node tables,
because a recursive type cannot be a column.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as E

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of an unpacked member at most; a larger one gives an error row.
MOST_BYTES = 1 << 28
NODES = "path string, node_id int, parent_id int, depth int, ord int, type string, number string, title string, text string, error string"

# Element names of acts and the block type each becomes.
ACT_BLOCKS = {"PART": "part", "TITLE": "title", "CHAPTER": "chapter", "SECTION": "section", "DIVISION": "division", "ARTICLE": "article", "PARAG": "paragraph", "ALINEA": "text", "P": "text", "NP": "point", "ITEM": "item", "ANNEX": "annex", "CONSID": "recital", "VISA": "visa", "TBL": "table"}
# Element names of regulation parts.
PART_BLOCKS = {"PART": "part", "SUBPART": "subpart", "SUBJGRP": "subject_group", "SECTION": "section", "APPENDIX": "appendix", "P": "text", "FP": "text", "GPOTABLE": "table", "EXTRACT": "extract", "NOTE": "note"}
#: What a parser raises on damaged markup, on unknown or multi-byte encodings, and on values of a wrong type; each becomes an error row.
PARSE_ERRORS = (E.ParseError, LookupError, ValueError, RecursionError, TypeError)
_NUMBER, _TITLE = ("NO.P", "NO.PARAG", "TI.ART", "SECTNO", "EAR"), ("STI.ART", "TI", "SUBJECT", "HD")


def files(spark: SparkSession, path: str, glob: str = "*.xml", ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of the files below a folder, without the ignored names."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.where(~F.lower(F.substring_index("path", "/", -1)).isin(*[i.lower() for i in ignored]) if ignored else F.lit(True)).select("path", "content")


def members(archives: DataFrame) -> DataFrame:
    """(path, content) of the XML members of ZIP rows; the path has the member after an exclamation mark."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = ""
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for member in sorted(z.infolist(), key=lambda m: m.filename):
                            name = f"!{member.filename}"
                            if not name.lower().endswith(".xml"):
                                continue
                            if member.file_size > MOST_BYTES:
                                raise ValueError(f"a member of {member.file_size} bytes")
                            yield pd.DataFrame({"path": [path + name], "content": [z.read(member)], "error": [None]})
                except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, ValueError) as e:  # damaged, cut off, encrypted, or too large
                    yield pd.DataFrame({"path": [path + name], "content": [None], "error": [str(e)]})

    return archives.mapInPandas(unpack, "path string, content binary, error string")


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def flat(element: E.Element) -> str:
    """All text below an element with single blanks."""
    return " ".join("".join(element.itertext()).split())


def table_rows(element: E.Element, row: str = "ROW", cell: str = "ENT", head: str = "CHED") -> list[list[str]]:
    header = [flat(c) for c in element.iter() if local(c.tag) == head]
    rows = [[flat(c) for c in r if local(c.tag) == cell] for r in element.iter() if local(r.tag) == row]
    return ([header] if header else []) + rows


def markdown_table(rows: list[list[str]]) -> str:
    """The first row is the header; short rows are filled up."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join((r + [""] * width)[:width]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def tree(content: bytes, blocks: dict[str, str]) -> list[tuple]:
    """Nodes in document order: (node_id, parent_id, depth, ord, type, number, title, text)."""
    out: list[list] = []

    def child(element: E.Element, names: tuple[str, ...]) -> str | None:
        return next((flat(c) for n in names for c in element if local(c.tag) == n), None)

    root = E.fromstring(content)
    holds: set[int] = set()  # elements with blocks below them
    order: list[tuple[E.Element, E.Element | None]] = []
    todo: list = [(root, None)]
    while todo:
        e, above = todo.pop()
        order.append((e, above))
        todo += [(c, e) for c in e]
    for e, above in reversed(order):
        if above is not None and (local(e.tag) in blocks or id(e) in holds):
            holds.add(id(above))
    # A stack of its own, so that no depth of a tree is too much.
    todo = [(root, None, 0, 0)]
    while todo:
        element, parent, depth, ord_ = todo.pop()
        kind = blocks.get(local(element.tag))
        if kind is None:
            todo += [(c, parent, depth, k) for k, c in reversed(list(enumerate(element)))]
            continue
        node = [len(out), parent, depth, ord_, kind, child(element, _NUMBER), child(element, _TITLE), None]
        out.append(node)
        if kind == "table":
            node[7] = markdown_table(table_rows(element))
        elif id(element) not in holds:
            skip = {id(c) for c in element if local(c.tag) in _NUMBER + _TITLE}
            # Inline elements join their text as written; those without text between them are set apart.
            parts = [element.text or ""]
            for c in element:
                parts += [" " if id(c) in skip else "".join(c.itertext()), c.tail or " "]
            node[7] = " ".join("".join(parts).split())
        else:
            todo += [(c, node[0], depth + 1, k) for k, c in reversed(list(enumerate(element)))]
    return [tuple(n) for n in out]


def nodes(rows: DataFrame, blocks: dict[str, str] | None = None) -> DataFrame:
    """Node table of (path, content) rows; a document that does not parse is one row with its error."""
    blocks = blocks or ACT_BLOCKS

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODES.split(", ")]
        for batch in batches:
            found: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found += [(path, *n, None) for n in tree(content, blocks)]
                except PARSE_ERRORS as e:  # a parser's message names line and column
                    found.append((path, *[None] * 8, str(e)))
            yield pd.DataFrame(found, columns=names).astype(object)

    return rows.select("path", "content").mapInPandas(parse, NODES)


def headers(rows: DataFrame, titles: int = 3) -> DataFrame:
    """Root element, referenced file, sequence number and first titles of each document."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                root = ref = seq = error = None
                found: list[str] = []
                try:
                    for event, e in E.iterparse(io.BytesIO(content), ("start", "end")):
                        name = local(e.tag)
                        root = root or name
                        if event == "end":
                            ref = ref or (e.get("FILE") if e.get("FILE") else None)
                            seq = seq or (flat(e) if name == "NO.SEQ" else None)
                            if name == "TI" and len(found) < titles and flat(e):
                                found.append(flat(e))
                except PARSE_ERRORS as e:
                    error = str(e)
                out.append((path, root, ref, seq, found, error))
            yield pd.DataFrame(out, columns=["path", "root", "file_ref", "seq", "titles", "error"])

    return rows.select("path", "content").mapInPandas(scan, "path string, root string, file_ref string, seq string, titles array<string>, error string")


def part_chunks(tree_rows: DataFrame, document: str = "Part") -> DataFrame:
    """Sections of regulation parts as chunks: doc id, chunk id of the section's number, text of its blocks in order.

    Sections inherit their ancestors' titles as a path; repeats of an id get _dup1, …
    """
    part = tree_rows.where("type = 'part'").select("path", F.concat(F.lit(f"{document}_"), F.regexp_extract("number", r"(\d+)", 1)).alias("document_id"), F.col("node_id").alias("part_id"))
    sections = tree_rows.where("type in ('section', 'appendix')").select("path", "node_id", "number", "title")
    texts = tree_rows.where("type in ('text', 'table', 'extract', 'note')").select("path", F.col("parent_id").alias("node_id"), F.struct("ord", "text").alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n")
    rows = sections.join(texts.groupBy("path", "node_id").agg(body.alias("text")), ["path", "node_id"], "left").join(part, "path").where("node_id > part_id")
    rows = rows.withColumn("_r", F.max("part_id").over(_window("path", "node_id"))).where("part_id = _r")
    slug = F.concat(F.lit("sec_"), F.regexp_replace(F.regexp_replace(F.coalesce("number", "title"), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    from quarry.operators.chunks import suffixed

    keyed = rows.select("path", "document_id", F.col("node_id").alias("seq"), "title", "text", F.concat_ws(":", "document_id", slug).alias("chunk_id"))
    return suffixed(keyed, "chunk_id", "seq", "chunk_id")


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def rule_items(rows: DataFrame, item: str = "item") -> DataFrame:
    """(path, seq, id, title, text, error) of flat rule documents, with amendment marks taken out of the texts; a document that does not parse is one row with its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    for k, e in enumerate(x for x in E.fromstring(content).iter() if local(x.tag) == item):
                        text = re.sub(r"\s*\[(?:applicable|amended|deleted)[^\]]*\]", "", flat(e), flags=re.I)
                        out.append((path, k, e.get("id"), e.get("title"), text, None))
                except PARSE_ERRORS as e:
                    out.append((path, -1, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "seq", "id", "title", "text", "error"]).astype(object)

    return rows.select("path", "content").mapInPandas(parse, "path string, seq int, id string, title string, text string, error string")
