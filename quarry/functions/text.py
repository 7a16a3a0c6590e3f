"""Text analytics as column expressions. Word lists and patterns are parameters with fixed defaults."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F

from quarry.functions.columns import chain, first_of, found

# Modality markers in their order of priority, with modality and legal role; those without a role leave it to the senses.
MODALITIES = [
    ("shall not", "SHALL_NOT", "PROHIBITION"),
    ("must not", "MUST_NOT", "PROHIBITION"),
    ("may not", "MAY_NOT", "PROHIBITION"),
    ("should not", "SHOULD_NOT", None),
    ("shall", "SHALL", "REQUIREMENT"),
    ("must", "MUST", "REQUIREMENT"),
    ("may", "MAY", "PERMISSION"),
    ("should", "SHOULD", None),
]
# Phrases that give a role where no modality does, in their order.
SENSES = [("means", "DEFINITION"), ("defined as", "DEFINITION"), ("shall apply to", "SCOPE"), ("scope of this", "SCOPE"), ("by way of derogation", "EXCEPTION"), ("unless", "EXCEPTION")]


def modality(text: Column, table=MODALITIES) -> tuple[Column, Column]:
    """(modality, role) of the first marker in the table that the lower-cased text contains."""
    low = F.lower(text)
    return chain([(F.contains(low, F.lit(m)), F.lit(x)) for m, x, _ in table]), chain([(F.contains(low, F.lit(m)), F.lit(r)) for m, _, r in table])


def legal_semantics(text: Column, table=MODALITIES, senses=SENSES) -> tuple[Column, Column]:
    """(modality, role): the role of the first marker, else that of the first phrase, else INFORMATION; NONE without a marker."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = lambda m: F.contains(low, F.lit(m))
    kind, role = modality(F.coalesce(text, F.lit("")), table)
    return F.coalesce(kind, F.lit("NONE")), F.coalesce(role, chain([(held(m), F.lit(r)) for m, r in senses], F.lit("INFORMATION")))


def instant_filter(title: Column, text: Column, words: str = "", pattern: str | None = None) -> Column:
    """Whether the title or the text holds the words, case ignored, and the text something of a requirement pattern; no words and no pattern hold always."""
    wanted = words.strip().lower()
    held = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(wanted)) for c in (title, text)]
    return (F.lit(True) if not wanted else held[0] | held[1]) & (F.lit(True) if pattern is None else F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}"))


def lens(text: Column, patterns: dict[str, str]) -> list[Column]:
    """How often each pattern occurs, case ignored."""
    return [F.regexp_count(text, F.lit(f"(?i){p}")).alias(name) for name, p in patterns.items()]


def word_set(text: Column) -> Column:
    """Distinct blank-separated words, lower-cased, of letters a-z and digits only."""
    bare = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def jaccard_percent(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.round(100 * F.size(F.array_intersect(a, b)) / both))


def concept_terms(text: Column, stop: list[str], least: int = 4) -> Column:
    """Distinct terms of [a-z0-9-/] with ``least`` characters, not all digits, not stopped."""
    terms = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9/-]+", " "), " ")
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$") & ~t.isin(stop)))


def sentences(text: Column) -> Column:
    """Cut after . ! ? before blanks and a capital, digit or bracket."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9(])")


def normalised_query(text: Column) -> Column:
    """Lower-cased, without punctuation, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " "))


def year_of(two_digits: Column) -> Column:
    """A year of two digits, split at 50."""
    n = two_digits.cast("int")
    return F.when(n >= 100, n).when(n < 50, n + 2000).otherwise(n + 1900)


def act_number(title: Column) -> Column:
    """struct(kind letter, year, number) of an act's title; newer titles put the year first, older ones last."""
    letter = chain([(title.rlike("(?i)directive"), F.lit("L")), (title.rlike("(?i)decision"), F.lit("D")), (title.rlike("(?i)regulation"), F.lit("R"))])
    new = r"(?:\((?:EU|EC|EEC|Euratom)(?:, ?Euratom)?\))\s+(\d{4})/(\d{1,5})"
    old = r"No\.?\s*(\d{1,4})/(\d{2,4})"
    bare = r"(\d{4})/(\d{1,4})/(?:EU|EC|EEC)"
    short = r"(\d{2})/(\d{1,4})/(?:EEC|EC)"
    year = F.coalesce(found(title, new, 1).cast("int"), year_of(found(title, old, 2)), found(title, bare, 1).cast("int"), year_of(found(title, short, 1)))
    number = F.coalesce(found(title, new, 2), found(title, old, 1), found(title, bare, 2), found(title, short, 2)).cast("int")
    return F.when(year.isNotNull(), F.struct(letter.alias("letter"), year.alias("year"), number.alias("number")))


def celex(letter: Column, year: Column, number: Column) -> Column:
    """3, year, letter and the number padded to four digits (longer ones stay whole)."""
    n = number.cast("string")
    return F.concat(F.lit("3"), year.cast("string"), letter, F.when(F.length(n) >= 4, n).otherwise(F.lpad(n, 4, "0")))


def sorted_matches(text: Column, patterns: list[str]) -> Column:
    """Sorted distinct first groups of several patterns."""
    every = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns)))
    return F.array_sort(F.array_distinct(every))


def url_score(url: Column, text: Column, wanted: str) -> Column:
    """How likely a link is the wanted download: file type, then words of its text."""
    return F.when(F.lower(url).rlike(r"\.pdf($|\?)"), 100).otherwise(0) + F.when(F.contains(F.lower(text), F.lit("download")), 25).otherwise(0) + F.when(F.contains(F.lower(text), F.lit(wanted)), 10).otherwise(0)


def triage(dimensions: dict[str, float]) -> tuple[Column, Column, Column]:
    """(weighted 0-10 score, priority 0-100, bucket) of clamped columns and their weights."""
    total = sum(dimensions.values())
    clamp = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(10.0))
    score = sum((clamp(F.col(c)) * w for c, w in dimensions.items()), F.lit(0.0)) / total
    priority = F.bround(score * 10).cast("int")
    return F.bround(score, 2), priority, chain([(priority >= 75, F.lit("critical")), (priority >= 50, F.lit("medium")), (priority >= 25, F.lit("low"))], F.lit("ignore"))


def quality_counts(text: Column) -> dict[str, Column]:
    """Characters, letters and digits, replacement marks, control characters and odd encodings of a text."""
    return {
        "n_chars": F.char_length(text),
        "n_alnum": F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")),
        "n_replacement": F.regexp_count(text, F.lit("�")),
        "n_control": F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")),
        "n_words": F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*")),
    }


def gate(cases: list[tuple[Column, str, str]]) -> tuple[Column, Column]:
    """(status, reasons) from (condition, FAIL or WARN, reason) rules; PASS without any."""
    status = chain([(c, F.lit("FAIL")) for c, s, _ in cases if s == "FAIL"] + [(c, F.lit("WARN")) for c, s, _ in cases if s == "WARN"], F.lit("PASS"))
    return status, F.concat_ws("; ", *(F.when(c, F.lit(r)) for c, _, r in cases))


def clean(text: Column) -> Column:
    """No NULs, composed letters, plain line ends, no blanks at line ends, at most two empty lines in a row."""
    t = F.regexp_replace(F.regexp_replace(composed(text), "\x00", ""), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), "\n{4,}", "\n\n\n")


def composed(text: Column) -> Column:
    """Unicode form NFC. Spark has no function for it; texts of characters below U+0300 only are null in the Arrow batch.

    Those are in this form already, whatever the version of Unicode: none of these characters is a
    mark, changes by itself or joins another. Every other text is normalised, since letters that are
    no marks change as well (Hangul parts, Hebrew and Chinese compatibility letters). A condition
    around the call alone would not spare the rest, as Spark computes such functions for every row.
    """

    @F.arrow_udf("string")
    def nfc(texts: pa.Array) -> pa.Array:
        # A text at a time becomes a Python string; the batch itself stays in Arrow.
        return pa.array((unicodedata.normalize("NFC", t.as_py()) if t.is_valid else None for t in texts), pa.string())

    wanted = F.when(text.rlike(r"[^\x00-\x{2FF}]"), text)
    return F.coalesce(nfc(wanted), text)


# What UTF-8 read as Latin-1 or Windows-1252 leaves behind.
MOJIBAKE = ["Ã©", "Ã¨", "Ã¼", "Ã¶", "Ã¤", "Ã±", "â€™", "â€œ", "â€", "Â "]


def damage_counts(text: Column) -> dict[str, Column]:
    """Unassigned and private characters, suspicious ones (controls but line ends and tabs), and marks of a wrong encoding."""
    import re

    return {
        "n_unassigned": F.regexp_count(text, F.lit(r"\p{Cn}")),
        "n_suspicious": F.regexp_count(text, F.lit(r"[\p{Cc}\p{Co}\p{Cn}&&[^\n\r\t\f]]")),
        "n_mojibake": F.regexp_count(text, F.lit("|".join(map(re.escape, sorted(MOJIBAKE, key=len, reverse=True))))),
    }


# What a semantic slot follows.
SLOTS = {
    "subject": r"(?i)^\s*(?:the|an?|each|every|any)?\s*([A-Za-z][A-Za-z /-]*?)\s+(?:shall|must|may|should)\b",
    "action": r"(?i)\b(?:shall|must|may|should)(?:\s+not)?\s+([^.,;]+)",
    "condition": r"(?i)\b(?:if|when|where|provided that)\s+([^.,;]+)",
    "exception": r"(?i)\b(?:unless|except(?:\s+(?:when|where|for|if))?)\s+([^.,;]+)",
    "deadline": r"(?i)\b(?:within|no later than|not later than|by)\s+(\d+\s+(?:hours?|days?|weeks?|months?|years?)|\d{1,2}\s+[A-Za-z]+\s+\d{4})",
}


def slots(text: Column, patterns: dict[str, str] = SLOTS) -> list[Column]:
    """The trimmed first group of each slot's pattern, null without a match."""
    return [F.nullif(F.trim(F.coalesce(found(text, p), F.lit(""))), F.lit("")).alias(name) for name, p in patterns.items()]


def without_amendment_marks(text: Column) -> Column:
    """Arrows and letters that mark amendments, such as ``►M1`` and ``◄``, and doubled blanks are gone."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[►▼]\s?[A-Z]+\d*|◄", " "), r"[ \t]+", " "))


def raised(text: Column) -> Column:
    """Digits and signs as superscripts."""
    return F.translate(text, "0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ")


def lowered(text: Column) -> Column:
    """Digits and signs as subscripts."""
    return F.translate(text, "0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎")


def fraction(above: Column, below: Column) -> Column:
    """a/b; parts of several terms in brackets."""
    part = lambda x: F.when(x.rlike(r"[\s+\-*/]"), F.concat(F.lit("("), x, F.lit(")"))).otherwise(x)
    return F.concat(part(above), F.lit("/"), part(below))


def definitions(text: Column, least: int = 15) -> Column:
    """array<struct<term, text>> of paragraphs ``Term means …``, if a text has more than ``least`` paragraphs."""
    lines = F.filter(F.split(text, r"\n+"), lambda x: F.trim(x) != "")
    pattern = r"^\s*(\S[^.:]{0,120}?)\s+means[,:]?\s+(.+)$"
    pairs = F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("term"), F.regexp_extract(x, pattern, 2).alias("text")))
    return F.when(F.size(lines) > least, pairs).otherwise(F.filter(pairs, lambda x: F.lit(False)))


def passage_texts(title: Column, path: Column, body: Column, number: Column, source: Column) -> dict[str, Column]:
    """The five forms of text that are embedded: by section path, rule, regulation part, page and note; empty parts are left out."""
    filled = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    named = lambda name, c: F.concat(F.lit(f"{name}: "), filled(c))
    return {
        "section": embedding_text(title, path, body),
        "rule": F.concat_ws("\n", F.concat_ws(" ", filled(number), filled(title)), filled(path), filled(body)),
        "part": F.concat_ws("\n", named("Regulation", title), named("Part", path), F.concat(F.lit("§ "), filled(number)), filled(body)),
        "page": F.concat_ws("\n\n", F.concat_ws(" | ", filled(title), filled(source)), filled(body)),
        "note": F.concat_ws("\n", named("Note", title), named("Project", source), filled(body)),
    }


def words_characters_citations(text: Column) -> dict[str, Column]:
    """Words at blanks, characters, and citation marks of a text."""
    return {"n_words": F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), "n_chars": F.char_length(text), "n_citations": F.regexp_count(text, F.lit(r"<chunk:\s*[^>\n]+>|\(chunk:\s*[^()\n]+\)"))}


# Words of a report section's title and the kind they give.
REPORT_KINDS = [("summary|overview", "summary"), ("gap|missing|limit", "gaps"), ("conclusion", "conclusion"), ("reference|source", "references"), ("requirement|obligation", "requirements")]


def report_sections(text: Column) -> Column:
    """array<struct<title, kind, body>> of a markdown report: cut before headings, typed by words of the title; text before the first heading is an introduction."""
    parts = F.filter(F.split(text, r"(?m)(?=^#{1,3} )"), lambda p: F.trim(p) != "")
    title = lambda p: F.trim(F.regexp_extract(p, r"^#{1,3} ([^\n]*)", 1))
    kind = lambda t: chain([(t == "", F.lit("introduction")), *((F.lower(t).rlike(k), F.lit(v)) for k, v in REPORT_KINDS)], F.lit("section"))
    return F.transform(parts, lambda p: F.struct(title(p).alias("title"), kind(title(p)).alias("kind"), F.trim(F.regexp_replace(p, r"^#{1,3} [^\n]*\n?", ""), F.lit(" \n")).alias("body")))


# Lines that are page furniture whatever the document.
FURNITURE = [r"(?:(?:page|p\.)\s*)?\d+(?:\s*(?:of|/)\s*\d+)?", r".*(?:ELI:\s*http://data\.europa\.eu/eli/|OJ\s+[LC]\s*,\s*\d+\.\d+\.\d+).*", r".*Proprietary document\.\s*Copies are not controlled.*", r".*Original Issue\s+Page\s+\d+\s+of\s+\d+.*"]


def without_furniture(text: Column, patterns: list[str] = FURNITURE) -> Column:
    """Without lines that match a pattern as a whole, case ignored."""
    whole = "(?i)^(?:" + "|".join(patterns) + ")$"
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.trim(line).rlike(whole)), "\n")


def harvested_terms(text: Column, names: list[str]) -> Column:
    """Capitalised phrases of two to five words that hold one of the names: queries for a domain, sorted and distinct."""
    phrase = r"\b([A-Z][\w-]*(?: (?:[A-Z][\w-]*|of|and)){1,4})"
    hits = F.regexp_extract_all(text, F.lit(phrase), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(hits, lambda x: F.lower(x).rlike("|".join(n.lower() for n in names)))))


def safe_file_name(text: Column, most: int = 180) -> Column:
    """URL escapes decoded; characters that file systems refuse become underscores; cut; names that Windows reserves get an underscore."""
    t = F.regexp_replace(F.coalesce(F.try_url_decode(text), text), r'[<>:"/\\|?*\x00-\x1F]+', "_")
    t = F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, most)
    return F.when(F.upper(F.regexp_replace(t, r"\..*$", "")).isin("CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10))), F.concat(F.lit("_"), t)).otherwise(t)


def typography(text: Column) -> Column:
    """Thin blanks, dashes and quotes in plain form; single blanks; no empty lines."""
    t = F.regexp_replace(text, "[     ]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*[—–]\s*", " - "), "[“”]", '"')
    lines = F.filter(F.transform(F.split(F.regexp_replace(t, "[‘’]", "'"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n")


def slug(text: Column) -> Column:
    """Runs of other characters than [A-Za-z0-9_.-] become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")


def embedding_text(title: Column, path: Column, body: Column) -> Column:
    """Title, section path and body on lines of their own, without empty parts."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", part("Title", title), part("Section", path), body)


def shared_terms(query: str, text: Column) -> Column:
    """The query's tokens of three characters or more that occur in the text, case ignored."""
    import re

    tokens = list(dict.fromkeys(t.lower() for t in re.findall(r"[A-Za-z0-9_-]{3,}", query)))
    return F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(text), t))


def highlighted(text: Column, terms: list[str]) -> Column:
    import re

    pattern = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_])({pattern})", "<mark>$1</mark>")


def responsible(text: Column, patterns: list[str]) -> Column:
    return first_of(text, patterns)


def snippet(text: Column, n: int = 50) -> Column:
    """The first n words, with an ellipsis if there are more."""
    every = F.split(F.trim(text), r"\s+")
    return F.concat(F.array_join(F.slice(every, 1, n), " "), F.when(F.size(every) > n, "...").otherwise(""))


def citations(text: Column) -> Column:
    """Ids of ``<chunk:…>`` marks, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<chunk:([^>\s]+)>"), F.lit(1)))
