"""Acts as node tables with notes, quotations, formulas, lists and tables, from files in any state.

Three parsers take turns: the strict one, one that repairs markup, and one that keeps the
bare text. A later one sees only the rows that the earlier ones left, and every node names
the one that made it. All text of a file ends up in some node: an element that is no known
block gives a text node, so that nothing is orphaned. Trees are walked with a stack of
their own, whatever their depth.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from xml.etree import ElementTree as E

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quarry.session import kept
from quarry.sources.xml_docs import PARSE_ERRORS, local, markdown_table

NODES = "path string, node_id int, parent_id int, depth int, ord int, type string, number string, title string, text string, attributes map<string,string>, error string"
_COLUMNS = [c.split()[0] for c in NODES.split(", ")]

# Element names of acts and the node type of each.
BLOCKS = {
    "PART": "part", "TITLE.CONTENTS": "title", "CHAPTER": "chapter", "SECTION": "section", "GR.SEQ": "section", "DIVISION": "division", "SUBDIV": "subdivision", "ARTICLE": "article", "PARAG": "paragraph", "ALINEA": "text", "P": "text",
    "LIST": "list", "NP": "point", "NP.ECR": "point", "ITEM": "item", "DLIST": "definition_list", "DLIST.ITEM": "definition", "ANNEX": "annex", "CONSID": "recital", "VISA": "visa", "TBL": "table", "QUOT.S": "quote", "FORMULA": "formula",
    "ANNOTATION": "annotation", "COMMENT": "annotation", "MARGIN": "annotation", "GR.NOTES": "notes", "SIGNATURE": "signature", "TOC": "contents",
}
_NUMBER, _TITLE = ("NO.P", "NO.PARAG", "NO.ITEM", "TI.ART", "NO.CURR"), ("STI.ART", "TI", "STI")
_NAMED = {"ARTICLE", "PARAG", "NP", "NP.ECR", "ITEM", "CONSID", "DIVISION", "SUBDIV", "GR.SEQ", "SECTION", "CHAPTER", "PART", "ANNEX", "TOC"}
#: Nodes that a task gathers before it sends them.
SENT_NODES = 20_000
_QUOTES = {"QUOT.START": "“", "QUOT.END": "”"}
#: What is written before the text of a raised or lowered element.
_SCRIPTS = {"EXPONENT": "^", "IND": "_"}


def strict(content: bytes) -> E.Element:
    return E.fromstring(content)


_TAG = re.compile(r"<(?:!--.*?-->|\?.*?\?>|!\[CDATA\[(?P<data>.*?)\]\]>|![^>]*>|(?P<close>/)?(?P<name>[A-Za-z_][\w.:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>)", re.S)
_ATTRIBUTE = re.compile(r"([\w.:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def lenient(content: bytes) -> str:
    """The characters of a file by its declared encoding, else as UTF-8 with replacement; without those that XML forbids."""
    named = re.search(rb"^[^>]*encoding=[\"']([\w.-]+)", content[:200])
    try:
        text = content.decode(named[1].decode("ascii") if named else "utf-8-sig", "replace")
    except LookupError:
        text = content.decode("utf-8-sig", "replace")
    return _CONTROL.sub("", text)


def repaired(content: bytes) -> E.Element:
    """A tree from damaged markup: stray signs are text, an end tag closes up to its begin tag or nothing, open elements end with the file."""
    text, at = lenient(content), 0
    builder, open_names = E.TreeBuilder(), []
    found = False
    for m in _TAG.finditer(text):
        if open_names and text[at : m.start()]:
            builder.data(unescape(text[at : m.start()]))
        at = m.end()
        if m["data"] and open_names:
            builder.data(m["data"])
        if not m["name"]:
            continue
        if m["close"]:
            if m["name"] in open_names[1:]:
                while True:
                    builder.end(last := open_names.pop())
                    if last == m["name"]:
                        break
            continue
        if found and not open_names:
            break
        builder.start(m["name"], {k: unescape(a or b) for k, a, b in _ATTRIBUTE.findall(m["attributes"])})
        found = True
        open_names.append(m["name"])
        if m["attributes"].rstrip().endswith("/") and len(open_names) > 1:
            builder.end(open_names.pop())
    if not found:
        raise ValueError("no element")
    builder.data(unescape(text[at:]))
    while open_names:
        builder.end(open_names.pop())
    return builder.close()


def bare(content: bytes) -> E.Element:
    """A root with one paragraph for each line of text; ValueError if there is none."""
    root = E.Element("TEXT")
    for line in _TAG.sub("\n", lenient(content)).splitlines():
        if line.strip():
            E.SubElement(root, "P").text = unescape(line.strip())
    if not len(root):
        raise ValueError("no text")
    return root


ENGINES: tuple[tuple[str, Callable[[bytes], E.Element]], ...] = (("strict", strict), ("repaired", repaired), ("bare", bare))


class _Walk:
    """The nodes of one act in document order."""

    def __init__(self, root: E.Element, keep_contents: bool):
        self.keep_contents, self.out, self.unnamed = keep_contents, [], 0
        self.holds = self._holding(root)
        todo = [(root, None, 0, 0)]
        while todo:
            e, parent, depth, ord_ = todo.pop()
            below = self.visit(e, parent, depth, ord_) if isinstance(e, E.Element) else self.loose(e, parent, depth, ord_)
            todo += reversed(below)

    def _holding(self, root: E.Element) -> set[int]:
        """Elements that have blocks below them; what is inside a note does not count."""
        order, parents, todo = [], {}, [root]
        while todo:
            e = todo.pop()
            order.append(e)
            for c in e:
                parents[id(c)] = e
                todo.append(c)
        holds: set[int] = set()
        for e in reversed(order):
            if id(e) in parents and local(e.tag) != "NOTE" and (local(e.tag).upper() in BLOCKS or id(e) in holds):
                holds.add(id(parents[id(e)]))
        return holds

    def add(self, parent, depth, ord_, kind, number=None, title=None, text=None, attributes=None) -> int:
        self.out.append([len(self.out), parent, depth, ord_, kind, number, title, text, attributes or {}])
        return len(self.out) - 1

    def inline(self, e: E.Element, notes: list, whole: bool = False) -> str:
        """Text of an element with note markers, quotation marks and scripts; notes found are added to the list."""
        parts: list[str] = [e.text or ""]
        todo: list = [c for c in reversed(e)]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                parts.append(c)
                continue
            name, after = local(c.tag), c.tail or ""
            if name == "NOTE" and not whole:
                key = c.get("NOTE.ID") or c.get("NOTE.REF")
                if key is None:
                    self.unnamed += 1
                    key = f"n{self.unnamed}"
                if len(c) or (c.text or "").strip():
                    notes.append((key, c))
                parts += [f"[^{key}]", after]
                continue
            if name in _QUOTES:
                try:
                    parts.append(chr(int(c.get("CODE", ""), 16)))
                except ValueError:
                    parts.append(_QUOTES[name])
            elif name in _SCRIPTS:
                parts.append(_SCRIPTS[name])
            elif name == "BR":
                parts.append(" ")
            elif name == "DIVISOR":
                parts.append("/")
            parts.append(c.text or "")
            # Neighbouring elements without text between them are set apart unless they are parts of a formula or marks.
            todo.append(after or ("" if name in _QUOTES or name in _SCRIPTS or name in ("DIVIDEND", "DIVISOR", "HT", "IE") else " "))
            todo += [x for x in reversed(c)]
        return " ".join("".join(parts).split())

    def add_notes(self, notes: list, parent: int, depth: int) -> None:
        for k, (key, e) in enumerate(notes):
            more: list = []
            self.add(parent, depth + 1, 1_000_000 + k, "note", key, None, self.inline(e, more))
            notes += more

    def loose(self, e: tuple, parent, depth, ord_) -> list:
        text, kind = " ".join(e[0].split()), e[1]
        if text:
            self.add(parent, depth, ord_, kind, None, None, text)
        return []

    def children(self, e: E.Element, parent, depth, skipped: set[int]) -> list:
        """What lies below an element, its loose text included, in order."""
        below: list = [((e.text or "", "text"), parent, depth, 0)]
        for k, c in enumerate(e):
            if id(c) not in skipped:
                below.append((c, parent, depth, 2 * k + 1))
            below.append(((c.tail or "", "text"), parent, depth, 2 * k + 2))
        return [b for b in below if isinstance(b[0], E.Element) or b[0][0].strip()]

    def visit(self, e: E.Element, parent, depth, ord_) -> list:
        name = local(e.tag)
        if name == "TOC" and not self.keep_contents:
            return []
        notes: list = []
        if name == "NOTE":
            number = e.get("NOTE.ID") or e.get("NOTE.REF")
            node = self.add(parent, depth, ord_, "note", number, None, self.inline(e, notes))
            self.add_notes(notes, node, depth)
            return []
        kind = BLOCKS.get(name) or BLOCKS.get(name.upper())
        if kind is None:
            if id(e) in self.holds or any(local(c.tag) == "NOTE" for c in e if name == "GR.NOTES"):
                return self.children(e, parent, depth, set())
            text = self.inline(e, notes)
            if text:
                node = self.add(parent, depth, ord_, "text", None, None, text, {"tag": name})
                self.add_notes(notes, node, depth)
            return []
        if name in ("ITEM", "CONSID") and len(e) == 1 and local(e[0].tag) in ("NP", "NP.ECR"):
            e = e[0]  # a point that is the whole item
        used: set[int] = set()
        number = title = None
        if name in _NAMED:
            heads = {n: c for n in (*_NUMBER, *_TITLE) for c in reversed(e) if local(c.tag) == n}
            for n in _NUMBER:
                if number is None and n in heads:
                    number, _ = self.inline(heads[n], notes), used.add(id(heads[n]))
            for n in _TITLE:
                if title is None and n in heads:
                    title, _ = self.inline(heads[n], notes), used.add(id(heads[n]))
        attributes = {local(k): v for k, v in e.attrib.items()}
        if kind == "table":
            cells = table_cells(e, lambda x: self.inline(x, notes))
            head = next((c for c in e if local(c.tag) == "TITLE"), None)
            node = self.add(parent, depth, ord_, kind, None, self.inline(head, notes) if head is not None else None, markdown_table(grid_rows(cells)), attributes)
            self.add_notes(notes, node, depth)
            return [(c, node, depth + 1, k) for k, c in enumerate(e) if local(c.tag) == "GR.NOTES"]
        if kind == "notes" or id(e) in self.holds:
            node = self.add(parent, depth, ord_, kind, number, title, None, attributes)
            self.add_notes(notes, node, depth)
            return self.children(e, node, depth + 1, used)
        rest = E.Element(e.tag)
        rest.text = e.text
        for c in e:
            if id(c) in used:
                gap = E.SubElement(rest, "BR")
                gap.tail = c.tail
            else:
                rest.append(c)
        node = self.add(parent, depth, ord_, kind, number, title, self.inline(rest, notes), attributes)
        self.add_notes(notes, node, depth)
        return []


def table_cells(e: E.Element, text: Callable[[E.Element], str]) -> list[tuple]:
    """(row, ord, col or None, colspan, rowspan, header, text) of a table's cells."""
    count = lambda v: max(1, int(v)) if (v or "").strip().isdigit() else 1
    out, row = [], 0
    for r in e.iter():
        if local(r.tag) == "TI.BLK":
            out.append((row, 0, None, 1, 1, False, text(r)))
            row += 1
        elif local(r.tag) == "ROW":
            header = (r.get("TYPE") or "").upper() == "HEADER"
            for k, c in enumerate(c for c in r if local(c.tag) == "CELL"):
                col = c.get("COL", "")
                out.append((row, k, int(col) if col.isdigit() and int(col) else None, count(c.get("COLSPAN")), count(c.get("ROWSPAN")), header, text(c)))
            row += 1
    return out


def grid_rows(cells: list[tuple]) -> list[list[str]]:
    """The table with every place filled: a cell that spans places stands in each; header rows are joined into the first line."""
    places: dict[tuple[int, int], str] = {}
    for row, _, col, colspan, rowspan, _, text in cells:
        if col is None:
            col = next(c for c in range(1, len(places) + 2) if (row, c) not in places)
        for r in range(row, row + rowspan):
            for c in range(col, col + colspan):
                places.setdefault((r, c), text)
    if not places:
        return []
    width, last = max(c for _, c in places), max(r for r, *_ in cells)
    rows = [[places.get((r, c), "") for c in range(1, width + 1)] for r in range(last + 1)]
    heads = sorted({r for r, *_, header, _ in cells if header})
    n = next((k for k, r in enumerate(heads) if r != k), len(heads))  # only those at the top
    if n > 1:
        merged = [" / ".join(dict.fromkeys(x for x in column if x)) for column in zip(*rows[:n])]
        rows = [merged, *rows[n:]]
    return rows


def _parse(parser: Callable[[bytes], E.Element], keep_contents: bool):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found += [(path, *n, None) for n in _Walk(parser(content), keep_contents).out] or [(path, *[None] * 9, "no content")]
                except PARSE_ERRORS as e:
                    found.append((path, *[None] * 9, f"{type(e).__name__}: {e}"))
                if len(found) >= SENT_NODES:
                    yield pd.DataFrame(found, columns=_COLUMNS).astype(object)
                    found = []
            yield pd.DataFrame(found, columns=_COLUMNS).astype(object)

    return parse


def parsed_in_turn(files: DataFrame, keep_contents: bool = False, engines=ENGINES) -> DataFrame:
    """Node table of (path, content) with ``engine``, the parser that read the file; a file that none reads is one row with the last one's error and engine null.

    Each parser's nodes are written once; the next gets the files that it failed on. Paths must be distinct.
    """
    left, out = files.select("path", "content"), None
    for k, (name, parser) in enumerate(engines):
        made = kept(left.mapInPandas(_parse(parser, keep_contents), NODES), f"nodes-{name}")
        good = made.where("error is null").withColumn("engine", F.lit(name))
        if k == len(engines) - 1:
            good = good.unionByName(made.where("error is not null").withColumn("engine", F.lit(None).cast("string")))
        out = good if out is None else out.unionByName(good)
        left = left.join(made.where("error is not null").select("path"), "path", "left_semi")
    return out


# Joins over node tables.


def hoisted(nodes: DataFrame) -> DataFrame:
    """Articles, paragraphs and items without a text of their own take that of their first child, if it is a text without children; the child goes, its children's notes move up."""
    keys = ["path", "node_id"]
    parents = nodes.where(F.col("type").isin("article", "paragraph", "item") & (F.coalesce("text", F.lit("")) == "")).select("path", F.col("node_id").alias("parent_id"))
    body = nodes.where("type != 'note'")
    inner = body.where("parent_id is not null").select("path", F.col("parent_id").alias("node_id")).distinct()
    first = body.join(parents, ["path", "parent_id"], "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("path", "parent_id").orderBy("node_id"))).where("_n = 1 and type = 'text'").join(inner, keys, "left_anti")
    up = first.select("path", F.col("node_id").alias("child"), F.col("parent_id").alias("into"), F.col("text").alias("up_text"))
    kept_rows = nodes.join(up.select("path", F.col("child").alias("node_id")), keys, "left_anti")
    texts = up.select("path", F.col("into").alias("node_id"), "up_text")
    moved = up.select("path", F.col("child").alias("parent_id"), "into")
    out = kept_rows.join(texts, keys, "left").join(moved, ["path", "parent_id"], "left")
    return out.withColumn("text", F.coalesce("up_text", "text")).withColumn("parent_id", F.coalesce("into", "parent_id")).withColumn("depth", F.when(F.col("into").isNotNull(), F.col("depth") - 1).otherwise(F.col("depth"))).select(nodes.columns)


def note_places(nodes: DataFrame) -> DataFrame:
    """(path, note_id, node_id, place, text, uses, attached): each use of a note marker with the note's text.

    attached is true for one use of each note, the first in document order; text is null
    for a marker without a note. A note defined twice has its first text.
    """
    marks = F.regexp_extract_all("text", F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1))
    uses = nodes.where("type != 'note'").select("path", "node_id", F.posexplode(F.concat(*(F.coalesce(m, F.array().cast("array<string>")) for m in (F.regexp_extract_all("title", F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1)), marks)))).alias("place", "note_id"))
    notes = nodes.where("type = 'note' and number is not null and coalesce(text, '') != ''").groupBy("path", F.col("number").alias("note_id")).agg(F.min_by("text", "node_id").alias("text"))
    w = Window.partitionBy("path", "note_id")
    found = uses.join(notes, ["path", "note_id"], "left")
    return found.withColumn("uses", F.count("*").over(w)).withColumn("attached", F.col("text").isNotNull() & (F.row_number().over(w.orderBy("node_id", "place")) == 1)).select("path", "note_id", "node_id", "place", "text", "uses", "attached")


def with_notes(nodes: DataFrame) -> DataFrame:
    """Nodes that are no notes, with ``notes``: the texts of the notes attached to each, in order; notes without a marker belong to the node they stand below, or to the one that their group of notes stands below."""
    places = note_places(nodes)
    groups = nodes.where("type = 'notes'").select("path", F.col("node_id").alias("parent_id"), F.coalesce("parent_id", F.lit(0)).alias("above"))
    loose = nodes.where("type = 'note' and coalesce(text, '') != ''").join(places.select("path", F.col("note_id").alias("number")).distinct(), ["path", "number"], "left_anti").join(groups, ["path", "parent_id"], "left")
    loose = loose.select("path", F.coalesce("above", "parent_id", F.lit(0)).alias("node_id"), F.lit(1_000_000).alias("place"), F.col("number").alias("note_id"), "text")
    every = places.where("attached").select("path", "node_id", "place", "note_id", "text").unionByName(loose)
    texts = every.groupBy("path", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "note_id", "text"))), lambda x: x["text"]).alias("notes"))
    return nodes.where("type not in ('note', 'notes')").join(texts, ["path", "node_id"], "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def filled_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, text, spanned) of cells (keys, row, ord, col, colspan, rowspan, text): every place that a cell covers; of cells that overlap the first by (row, ord, text) stays.

    A cell without a column takes the first free place of its row, after the places that
    spans from above take; that needs the cells of a table in order, so those tables are folded.
    A second fold, in the order in which cells win, tells from which row on a cell keeps each of
    its columns, so that places are neither grouped nor sorted.
    """
    size = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("int")
    rows = cells.select(*keys, F.col("row").cast("int").alias("row"), F.col("ord").cast("int").alias("ord"), F.col("col").cast("int").alias("col"), size("colspan").alias("colspan"), size("rowspan").alias("rowspan"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("row", "ord", "col", "colspan", "rowspan", "text")))

    def step(state, x):
        """state.free: for each column, the first row that no cell from above covers."""
        free = state["free"]
        open_ = F.filter(F.sequence(F.lit(1), F.size(free)), lambda c: F.get(free, c - 1) <= x["row"])
        col = F.coalesce(x["col"], F.try_element_at(open_, F.lit(1)), F.size(free) + 1)
        width = F.greatest(F.size(free), col + x["colspan"] - 1)
        covers = lambda c: (c >= col) & (c < col + x["colspan"])
        held = lambda c: F.coalesce(F.get(free, c - 1), F.lit(0))
        grown = F.transform(F.sequence(F.lit(1), width), lambda c: F.when(covers(c), F.greatest(held(c), x["row"] + x["rowspan"])).otherwise(held(c)))
        cell = F.struct(x["row"].alias("row"), x["ord"].alias("ord"), x["text"].alias("text"), col.alias("col"), x["colspan"].alias("colspan"), x["rowspan"].alias("rowspan"))
        return F.struct(grown.alias("free"), F.concat(state["cells"], F.array(cell)).alias("cells"))

    def keep(state, x):
        """state.free as above, from the least column on; rows ascend, so what an earlier cell covers ends there."""
        free, at = state["free"], x["col"] - F.col("_least")
        end = at + x["colspan"]
        starts = F.transform(F.sequence(at, end - 1), lambda c: F.greatest(x["row"], F.get(free, c)))
        grown = F.transform(F.sequence(F.lit(0), F.greatest(F.size(free), end) - 1), lambda c: F.when((c >= at) & (c < end), F.greatest(F.get(free, c), x["row"] + x["rowspan"])).otherwise(F.get(free, c)))
        cell = F.struct(x["row"].alias("row"), x["text"].alias("text"), x["col"].alias("col"), (x["row"] + x["rowspan"]).alias("end"), starts.alias("starts"))
        return F.struct(grown.alias("free"), F.concat(state["cells"], F.array(cell)).alias("cells"))

    def folded(cells, step, kind):
        first = F.struct(F.array().cast("array<int>").alias("free"), F.array().cast(f"array<struct<{kind}>>").alias("cells"))
        return F.aggregate(cells, first, step, lambda s: s["cells"])

    placed = rows.groupBy(*keys).agg(ordered.alias("cells")).select(*keys, folded("cells", step, "row:int,ord:int,text:string,col:int,colspan:int,rowspan:int").alias("cells"))
    placed = placed.withColumn("_least", F.array_min(F.transform("cells", lambda x: x["col"])))
    winning = F.array_sort(F.filter("cells", lambda x: x["row"].isNotNull()))
    kept = placed.select(*keys, F.inline(folded(winning, keep, "row:int,text:string,col:int,end:int,starts:array<int>")).alias("_row", "text", "_col", "_end", "_starts"))
    spread = kept.select(*keys, "_row", "text", "_col", "_end", F.posexplode("_starts").alias("_k", "_start")).where("_start < _end")
    spread = spread.select(*keys, "_row", "text", "_col", (F.col("_col") + F.col("_k")).alias("col"), F.explode(F.expr("sequence(_start, _end - 1)")).alias("row"))
    return spread.select(*keys, "row", "col", "text", ((F.col("row") != F.col("_row")) | (F.col("col") != F.col("_col"))).alias("spanned"))
