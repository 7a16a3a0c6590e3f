"""Legal acts as column expressions: numbers and years, identifiers, targets, expiry, validity, classes of packages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions.columns import chain, first_of, found

# Years that a four-digit part may be, the year from which numbers follow it, and letters by class.
FIRST_YEAR, LAST_YEAR, LATER_YEAR, YEAR_FIRST = 1950, 2035, 2030, 2015
LETTERS = {"REGULATION": "R", "DIRECTIVE": "L", "DECISION": "D", "CORRIGENDUM": "R", "AGREEMENT": "A"}
# How titles name an act, its number in the official register, its number after an institution, and its kind at the beginning.
_KIND = r"(?:Regulation|Directive)\s+(?:\([A-Z,\s]+\)\s+)?(?:No\s+)?(\d+/\d+|\d+)"
_CELEX = r"\b([1-9]\d{4}[A-Z]{1,2}\d{4})\b"
_IN_TITLE = [r"(?i)\((?:EU|EC|EEC)\)\s*(?:No\s*)?(\d+/\d+)", r"(?i)No\s*(\d+/\d+)"]
_HEADED = r"(?i)^\s*(?:Commission\s+|Council\s+)?(?:Implementing\s+|Delegated\s+)?"


def year_and_number(pair: Column) -> Column:
    """struct(year, number) of ``2025/24``, ``965/2012`` or ``3922/91``; year 0000 and the whole text where no part is a year."""
    a, b = F.trim(F.get(F.split(pair, "/"), F.lit(0))), F.trim(F.get(F.split(pair, "/"), F.lit(1)))
    four = lambda p: p.rlike(r"^\d{4}$")
    n = lambda p: p.try_cast("int")
    year = lambda p: four(p) & n(p).between(FIRST_YEAR, LAST_YEAR)
    two = F.size(F.split(pair, "/")) == 2
    as_ = lambda y, x: F.struct(y.alias("year"), x.alias("number"))
    century = F.concat(F.when(n(b) > 50, "19").otherwise("20"), F.lpad(b, 2, "0"))
    return chain(
        [
            (two & year(a) & ~year(b), as_(a, b)),
            (two & year(b) & ~year(a), as_(b, a)),
            (two & four(a) & four(b) & (n(b) <= LATER_YEAR) & (n(a) > LATER_YEAR), as_(b, a)),
            (two & four(a) & four(b), as_(a, b)),
            (two & b.rlike(r"^\d{1,2}$"), as_(century, a)),
        ],
        as_(F.lit("0000"), pair),
    )


def display_number(year: Column, number: Column) -> Column:
    """Year first from 2015 on, number first before."""
    return F.when(year.try_cast("int") >= YEAR_FIRST, F.concat_ws("/", year, number)).otherwise(F.concat_ws("/", number, year))


def _padded(number: Column) -> Column:
    return F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0"))


def canonical(kind: Column, title: Column, current: Column, year: Column, file_name: Column) -> Column:
    """struct(name, number, celex) of an act, from its number and year if it states them, else from its title."""
    stated = F.when(current.isNotNull() & year.isNotNull(), display_number(year, current))
    pair = F.coalesce(stated, first_of(title, _IN_TITLE))
    both = year_and_number(pair)
    number = F.when(pair.isNotNull(), display_number(both["year"], both["number"]))
    letters = F.create_map(*(F.lit(x) for item in LETTERS.items() for x in item))
    celex = F.concat(F.lit("3"), both["year"], F.coalesce(F.try_element_at(letters, kind), F.lit("R")), _padded(both["number"]))
    shown = F.when(kind.isin("REGULATION", "DECISION", "DIRECTIVE"), F.concat(F.initcap(kind), F.lit(" (EU) "), number)).otherwise(F.concat(F.initcap(kind), F.lit(" "), number))
    name = F.coalesce(shown, F.concat(kind, F.lit(" ("), file_name, F.lit(")")))
    return F.struct(name.alias("name"), number.alias("number"), F.when(pair.isNotNull(), celex).alias("celex"))


def resolved_celex(elements: list[Column], header: Column, path: Column) -> Column:
    """The identifier in the named elements, else in the first 2,000 characters, else in the path, else made from a journal file's name."""
    name = F.substring_index(path, "/", -1)
    journal = F.when(name.rlike(r"L_[12]\d{3}\d{3}"), F.concat(F.lit("3"), F.regexp_extract(name, r"L_([12]\d{3})\d{3}", 1), F.lit("D0"), F.regexp_extract(name, r"L_[12]\d{3}(\d{3})", 1)))
    return F.coalesce(*(found(e, _CELEX) for e in elements), found(F.substring(header, 1, 2000), _CELEX), found(path, _CELEX), journal)


def decision_target(title: Column) -> Column:
    """The act that a decision rests on: after ``pursuant to`` and the like, else the first regulation named."""
    # Fixed value: phrases behind which a decision names the act it rests on.
    support = rf"(?i)(?:pursuant to|in accordance with|application of|under Article\s+[\d\w().]+\s+of)\s+{_KIND}"
    plain = r"(?i)Regulation\s+(?:\([A-Z,\s]+\)\s+)?(?:No\s+)?(\d+/\d+|\d+)"
    return F.concat(F.lit("Regulation "), first_of(title, [support, plain]))


def corrigendum_target(title: Column) -> Column:
    return found(title, rf"(?i)Corrigendum to\s+.*?{_KIND}")


def expiry(text: Column) -> Column:
    """The date until which an act applies, as written."""
    return found(text, r"(?i)(?:shall\s+expire\s+on|shall\s+apply\s+until|until)\s+(\d{1,2}\s+[A-Za-z]+\s+\d{4})")


def repealed_numbers(text: Column) -> Column:
    """Numbers in what a title says it repeals, in order."""
    parts = F.regexp_extract_all(text, F.lit(r"(?i)repealing\s+(?:Regulations?|Directives?|Decisions?)\s*([^,;]+)"), F.lit(1))
    return F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"(?i)(?:\((?:EU|EC|EEC)\)|(?:EEC|EC|EU))\s*(?:No\s*)?(\d+/\d+)"), F.lit(1))))


def normal_number(pair: Column) -> Column:
    """number/year without leading zeros: one form for both orders."""
    both = year_and_number(pair)
    return F.concat_ws("/", F.regexp_replace(both["number"], "^0+", ""), both["year"])


def validity(repealed_by: Column, expires: Column, this_year: int) -> Column:
    year = F.regexp_extract(expires, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    return chain([(repealed_by.isNotNull(), F.concat(F.lit("REPEALED (by "), repealed_by, F.lit(")"))), (year < this_year, F.concat(F.lit("EXPIRED ("), expires, F.lit(")"))), (year >= this_year, F.concat(F.lit("TIME-LIMITED (expires "), expires, F.lit(")")))], F.lit("IN FORCE"))


def file_role(name: Column, root: Column, title: Column) -> Column:
    """wrapper, annex, corrigendum, act or other of one file of a package."""
    low = F.lower(name)
    return chain(
        [
            (low.rlike(r"\.(?:doc|toc)(?:\.fmx)?\.xml$") | root.isin("DOC", "PUBLICATION", "TOC"), F.lit("wrapper")),
            ((root == "ANNEX") | name.rlike(r"\.010045|\.0004") | F.contains(low, F.lit("annex")), F.lit("annex")),
            ((root == "CORR") | F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit("corrigendum")), F.lit("corrigendum")),
            (root == "ACT", F.lit("act")),
        ],
        F.lit("other"),
    )


def package_class(title: Column, primary_root: Column, has_corrigendum: Column) -> Column:
    """The class of a package by its main title and its primary file's root element (null without one)."""
    low = F.lower(title)
    holds = lambda *words: title.rlike("(?i)" + "|".join(words))
    return chain(
        [
            ((primary_root == "CORR") | (primary_root.isNull() & has_corrigendum), F.lit("CORRIGENDUM")),
            (title.rlike(_HEADED + r"Decision\b") | (F.contains(low, F.lit("decision")) & ~title.rlike(_HEADED + r"Regulation\b")), F.lit("QUALIFIER_DECISION")),
            (holds("directive"), F.lit("DIRECTIVE")),
            (holds("regulation"), F.lit("CORE_REGULATION")),
            (holds("agreement", "protocol"), F.lit("AGREEMENT")),
            (holds("recommendation"), F.lit("RECOMMENDATION")),
            (primary_root == "ACT", F.lit("CORE_REGULATION")),
        ],
        F.lit("OTHER"),
    )


def keywords(text: Column, patterns: list[str]) -> Column:
    """Sorted distinct lower-cased hits of any of the patterns as whole words."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(?:" + "|".join(patterns) + r")\b"), F.lit(0)), lambda x: F.lower(x))))
