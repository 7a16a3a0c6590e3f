"""The beginnings of XML files, and volumes part by part, without loading whole files.

Spark lists files (`listing` reads names and sizes, no content); tasks then open each file
by its path through Arrow's file systems and feed a pull parser piece by piece. Headers
stop where the body begins, so the bytes read do not grow with the file; volumes are
parsed to the end, but only one part is held at a time. Damage gives an error row, with
what was found before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as E

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.sources.xml_docs import PARSE_ERRORS, flat, local

#: Bytes that are read at a time; the most of a header that is read where no body begins.
PIECE, MOST_HEADER = 1 << 14, 1 << 22
# Elements that begin the body, that are titles, and roots of acts.
BODIES, TITLES, ROOTS = ("ENACTING.TERMS", "CONTENTS", "PREAMBLE", "ARTICLE"), ("TITLE", "TITLE.FINAL", "TI"), ("ANNEX", "ACT", "CORR", "DOC", "PUBLICATION", "TOC")
HEADER = "path string, root string, file_ref string, seq string, titles array<string>, corrected string, date string, durability string, bytes_read long, error string"
_HEADER = [c.split()[0] for c in HEADER.split(", ")]


def listing(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(path, length) of the files below a folder that are not empty, each task with about as many bytes as Spark deals to one."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")


def pieces(path: str, size: int = PIECE) -> Iterator[bytes]:
    """The bytes of a file in order, read as they are asked for."""
    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        while piece := f.read(size):
            yield piece


class _Header:
    """What the events of a file's beginning tell."""

    def __init__(self, only_title: bool):
        self.only_title = only_title
        self.root = self.first = self.file_ref = self.seq = self.corrected = self.date = self.durability = None
        self.titles: list[str] = []
        self.outer = 0  # titles before the one that is open

    def see(self, event: str, e: E.Element) -> bool:
        """Take an event; true when nothing more is wanted."""
        name = local(e.tag)
        if event == "start":
            self.first = self.first or name
            if name in ROOTS:
                self.root = self.root or name
            if name in TITLES and name != "TI":
                self.outer = len(self.titles)
            if e.get("FILE"):
                self.file_ref = self.file_ref or e.get("FILE")
            return name in BODIES
        if name == "NO.SEQ":
            self.seq = self.seq or flat(e) or None
        elif name == "DURAB":
            self.durability = self.durability or flat(e) or None
        elif name == "DATE":
            self.date = self.date or e.get("ISO") or flat(e) or None
        elif name == "DOC.CORR":
            part = {local(x.tag): flat(x) for x in e.iter()}
            if part.get("NO.CURRENT") and part.get("YEAR"):
                self.corrected = f"{part['NO.CURRENT']}/{part['YEAR']}" + (f" ({part['COM']})" if part.get("COM") else "")
        elif name in TITLES:
            inner = self.titles[self.outer :] if name != "TI" else []
            text = " ".join(inner) or flat(e)  # lines of one title are one title
            if text:
                del self.titles[len(self.titles) - len(inner) :]
                self.titles.append(text)
            return self.only_title and name != "TI" and bool(text)
        return False


def headers(files: DataFrame, titles: int = 3, only_title: bool = False) -> DataFrame:
    """Root, referenced file, sequence number, titles, corrected act, date and durability of files (path), with the bytes that were read.

    With only_title, reading stops at the first whole title already.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                found, parser, read, error = _Header(only_title), E.XMLPullParser(("start", "end")), 0, None
                try:
                    done = False
                    for piece in pieces(path):
                        read += len(piece)
                        parser.feed(piece)
                        done = any(found.see(*x) for x in parser.read_events())
                        if done or read >= MOST_HEADER:
                            break
                    if not done and read < MOST_HEADER:
                        parser.close()
                        any(found.see(*x) for x in parser.read_events())
                except (*PARSE_ERRORS, OSError) as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((path, found.root or found.first, found.file_ref, found.seq, found.titles[:titles], found.corrected, found.date, found.durability, read, error))
            yield pd.DataFrame(out, columns=_HEADER).astype(object)

    return files.select("path").mapInPandas(scan, HEADER)


def volume_parts(files: DataFrame, part: str = "PART", dates: tuple[str, ...] = ("REVISED", "DATE"), default: str = "") -> DataFrame:
    """(path, ord, revised, content, error): each part of volumes (path) as XML, with the last date before its end.

    A date inside a part counts for it and those after it; parts inside a part belong to it.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                parser, stack, revised, n = E.XMLPullParser(("start", "end")), [], default, 0
                try:
                    for piece in pieces(path, 1 << 20):
                        parser.feed(piece)
                        for event, e in parser.read_events():
                            if event == "start":
                                stack.append(e)
                                continue
                            stack.pop()
                            inside = any(local(x.tag) == part for x in stack)
                            if local(e.tag) in dates and flat(e):
                                revised = flat(e)
                            elif local(e.tag) == part and not inside:
                                e.tail = None
                                yield pd.DataFrame([(path, n, revised, E.tostring(e, "utf-8"), None)], columns=["path", "ord", "revised", "content", "error"]).astype(object)
                                n += 1
                            if not inside and local(e.tag) != part and stack:
                                continue
                            if not inside and stack:
                                stack[-1].remove(e)  # done with: nothing of it is held
                    parser.close()
                except (*PARSE_ERRORS, OSError) as e:
                    yield pd.DataFrame([(path, n, revised, None, f"{type(e).__name__}: {e}")], columns=["path", "ord", "revised", "content", "error"]).astype(object)

    return files.select("path").mapInPandas(scan, "path string, ord int, revised string, content binary, error string")


def relevant(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, title, keywords, bytes_read) of the files whose title names any of the patterns; nothing behind the title is read."""
    from quarry.functions.acts import keywords

    found = headers(files, only_title=True).withColumn("title", F.concat_ws(" ", "titles"))
    return found.withColumn("keywords", keywords(F.col("title"), patterns)).where(F.size("keywords") > 0).select("path", "title", "keywords", "bytes_read")
