"""Rule documents from their package: one XML file that holds all parts of an office document.

A task turns each file into rows of four kinds (relationships, contents, controls and
paragraphs); what belongs together is then joined by Spark: the main part by its
relationship, controls with the table of contents by sdt-id, paragraphs with all
controls around them. A file that does not parse is one row with its error.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as E

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.sources.xml_docs import PARSE_ERRORS, local

ROWS = "path string, kind string, part string, ord int, sdt_id string, title string, type string, subject string, rule_id string, text string, around array<int>, error string"
_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
# The main part where no relationship names one, and the relationship's type.
MAIN, OFFICE = "/word/document.xml", "officeDocument"
# Marks of amendments and of decisions in texts.
MARKS = (r"\[Amdt\s+[^\]]+\]", r"ED Decision\s+\d{4}/\d{3}/R")


def without_amendments(text: Column) -> Column:
    """A text without those marks, its lines trimmed and empty ones gone."""
    for mark in MARKS:
        text = F.regexp_replace(text, mark, "")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != ""), "\n")


def _attribute(e: E.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def _rows(root: E.Element) -> list[dict]:
    out: list[dict] = []
    n = 0
    parts = [p for p in root.iter() if local(p.tag) == "part"] or [root]
    for part in parts:
        name = _attribute(part, "name") or ""
        # Begin and end events of the part, with the controls that are open at each.
        open_controls: list[int] = []
        todo: list = [(part, False)]
        while todo:
            e, closing = todo.pop()
            kind = local(e.tag)
            if closing:
                open_controls.pop()
                continue
            n += 1
            if kind == "Relationship":
                out.append({"kind": "relationship", "part": name, "ord": n, "type": e.get("Type"), "title": e.get("Target"), "sdt_id": e.get("Id")})
            elif kind in ("topic", "heading") and e.get("sdt-id"):
                title = e.get("source-title") if kind == "topic" else e.get("title")
                out.append({"kind": "contents", "part": name, "ord": n, "sdt_id": e.get("sdt-id"), "title": title or "", "type": (e.get("TypeOfContent") or "") if kind == "topic" else "heading", "subject": e.get("RegulatorySubject") or "", "rule_id": e.get("ERulesId") or ""})
            elif kind == "sdt":
                head = next((c for c in e if local(c.tag) == "sdtPr"), None)
                mark = next((c for c in head if local(c.tag) == "id"), None) if head is not None else None
                out.append({"kind": "control", "part": name, "ord": n, "sdt_id": _attribute(mark, "val") if mark is not None else None, "around": list(open_controls)})
                open_controls.append(n)
                todo.append((e, True))
            elif kind == "p" and open_controls:
                out.append({"kind": "paragraph", "part": name, "ord": n, "text": "".join(e.itertext()), "around": list(open_controls)})
            if kind != "sdtPr":
                todo += [(c, False) for c in reversed(e) if local(c.tag) != "part"]
    return out


def package_rows(files: DataFrame) -> DataFrame:
    """The rows of packages (path, content), each with its place ``ord`` in the file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found = [{"path": path, **row} for row in _rows(E.fromstring(content))] or [{"path": path, "kind": "empty"}]
                except PARSE_ERRORS as e:
                    found = [{"path": path, "kind": "error", "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(found, columns=_COLUMNS).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "content").mapInPandas(parse, ROWS)


def rule_items(rows: DataFrame) -> DataFrame:
    """(path, seq, sdt_id, rule_id, number, title, type, subject, text): the controls that the contents name, in document order.

    The title is that of the contents (of several entries with one id the last); entries
    without a title and controls without text give no item; amendment marks are taken out
    of texts; paragraphs of a control inside another count for both.
    """
    main = rows.where((F.col("kind") == "relationship") & F.col("type").endswith(OFFICE)).groupBy("path").agg(F.min_by("title", "ord").alias("target"))
    named = rows.where("kind in ('control', 'paragraph')").join(main, "path", "left")
    plain = lambda c: F.regexp_replace(c, "^/+", "")
    body = named.where(plain(F.col("part")) == plain(F.coalesce("target", F.lit(MAIN))))
    contents = rows.where("kind = 'contents'").groupBy("path", "sdt_id").agg(F.max_by(F.struct("title", "type", "subject", "rule_id"), "ord").alias("entry")).where("trim(entry.title) != ''")
    controls = body.where("kind = 'control' and sdt_id is not null").select("path", F.col("ord").alias("control"), "sdt_id").join(contents, ["path", "sdt_id"])
    inside = body.where("kind = 'paragraph' and trim(text) != ''").select("path", "ord", F.trim("text").alias("text"), F.explode("around").alias("control"))
    texts = inside.join(controls.select("path", "control"), ["path", "control"]).groupBy("path", "control").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
    made = controls.join(texts, ["path", "control"]).withColumn("text", without_amendments(F.col("text"))).where("text != ''")
    number = F.nullif(F.regexp_extract("entry.title", r"^(?:(?:AMC|GM)\d*\s+)?((?:[A-Z]{2,}[A-Za-z]*[-. ])?\d[\w.()/-]*)", 1), F.lit(""))
    return made.select("path", F.col("control").alias("seq"), "sdt_id", "entry.rule_id", number.alias("number"), F.trim("entry.title").alias("title"), "entry.type", "entry.subject", "text")


def package_errors(rows: DataFrame) -> DataFrame:
    """(path, error) of files that do not parse or hold nothing."""
    return rows.where("kind in ('error', 'empty')").select("path", F.coalesce("error", F.lit("no parts")).alias("error"))
