"""Marked-up text: sections, citations, JSON in prose, follow-up lists, cross-references, labels of nested points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions.columns import chain, found

_BREAK = r"<!-- SECTION_BREAK (\{[^\n]*?\}) -->"
# Keywords of a topic's title and the type each gives.
TOPICS = [("amc", "amc"), ("acceptable means", "amc"), ("gm", "guidance"), ("guidance", "guidance"), ("article", "requirement"), ("annex", "requirement")]
# Element names and hierarchy levels.
LEVELS = {"ACT": "ACT", "TITLE": "TITLE", "PART": "PART", "CHAPTER": "CHAPTER", "SECTION": "SECTION", "SUBPART": "SUBPART", "ARTICLE": "ARTICLE", "PARAG": "PARAGRAPH", "ALINEA": "SUBPARAGRAPH", "NP": "POINT", "ITEM": "ITEM", "ANNEX": "ANNEX", "APPENDIX": "APPENDIX", "CONSID": "RECITAL", "VISA": "CITATION"}


def section_break(meta: Column) -> Column:
    """The marker of a section: a struct as JSON in a comment."""
    return F.concat(F.lit("<!-- SECTION_BREAK "), F.to_json(meta), F.lit(" -->"))


def sections(text: Column) -> Column:
    """array of (meta, body, words) between the markers of a text; empty sections stay."""
    metas = F.regexp_extract_all(text, F.lit(_BREAK), F.lit(1))
    bodies = F.slice(F.split(text, _BREAK, -1), F.lit(2), F.greatest(F.size(metas), F.lit(0)))
    return F.zip_with(metas, bodies, lambda m, b: F.struct(m.alias("meta"), F.trim(F.regexp_replace(b, r"^\n+|\n+$", "")).alias("body"), F.regexp_count(b, F.lit(r"\S+")).alias("words")))


def cited_ids(text: Column) -> Column:
    """Ids in <chunk:…> marks or (chunk: …) brackets, where one level of inner brackets belongs to the id; each once, in order."""
    pattern = r"<chunk:\s*([^>\n]+)>|\(chunk:\s*((?:[^()\n]|\([^()\n]*\))+)\)"
    marks = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(marks, lambda m: F.trim(F.substring(m, 8, F.length(m) - 8))))


def json_in(text: Column) -> Column:
    """A fenced JSON block, else the outermost brackets or braces; null if it does not parse."""
    raw = F.coalesce(found(text, r"(?s)```(?:json)?\s*(.*?)```"), found(text, r"(?s)([\[{].*[\]}])"))
    return F.when(F.try_parse_json(raw).isNotNull(), F.regexp_replace(raw, r"^\s+|\s+$", ""))


def follow_ups(text: Column, most: int = 5) -> Column:
    """Bulleted lines after a FOLLOWUPS heading, without bullets, of more than five characters."""
    block = F.regexp_extract(text, r"(?si)follow-?ups?:?\s*\n(.*)", 1)
    lines = F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.filter(lines, lambda x: F.length(x) > 5), 1, most)


def cross_references(text: Column) -> Column:
    """Designations such as ``AMC1 CS-23.1`` or ``CS 23.1``, in one form, sorted and distinct."""
    hits = F.regexp_extract_all(text, F.lit(r"\b((?:(?:AMC|GM)\d* )?CS[- ]\d+(?:\.\d+)*(?:\([a-z0-9]+\))*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.regexp_replace(F.upper(h), r"CS[- ]", "CS-"))))


def base_designation(name: Column) -> Column:
    """Upper case, hyphens for blanks, without trailing (a)(1)."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), r"(?:\([A-Z0-9]+\))+$", ""), r"\s+", "-")


def topic_type(title: Column, table=TOPICS) -> Column:
    low = F.lower(title)
    return chain([(low.rlike(rf"\b{k}"), F.lit(t)) for k, t in table], F.lit("section"))


def level(tag: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.upper(tag)), F.lit("OTHER"))


def label_kind(label: Column) -> Column:
    """num, roman, alpha or ualpha of a point's label without its brackets."""
    bare = F.regexp_replace(label, r"[().]", "")
    return chain([(bare.rlike(r"^\d+$"), F.lit("num")), (bare.rlike(r"^[ivx]+$"), F.lit("roman")), (bare.rlike(r"^[a-z]+$"), F.lit("alpha")), (bare.rlike(r"^[A-Z]+$"), F.lit("ualpha"))])


def markdown_rows(rows: Column) -> Column:
    """An array of rows of cells as a markdown table."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)), "\n"))


def gaps(text: Column, most: int = 2) -> Column:
    """Sentences that own up to missing information."""
    pattern = r"([^.\n]*\b(?:not (?:found|covered|specified)|no information|further research)\b[^.\n]*)"
    return F.slice(F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1)), lambda x: F.trim(x)), lambda x: F.length(x) > 8), 1, most)
