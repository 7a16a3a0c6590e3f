"""Packages of files: one act with its annexes, wrappers and corrections, for each folder.

Files are rows (path, root, title, text, and what the header scan gives). A folder's
files are grouped once; every decision on them is an expression over that group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarry.functions import acts
from quarry.functions.columns import chain, first_of
from quarry.functions.text import sorted_matches

# How titles state an act's number.
NUMBERED = [r"(?i)\((?:EU|EC|EEC)\)\s*(?:No\s*)?(\d+/\d+)", r"(?i)No\s*(\d+/\d+)"]
# How titles name the acts that they amend or repeal.
AMENDS = [r"(?i)amending\s+(?:Council\s+|Commission\s+)?(?:Regulation|Directive)\s+(?:\([A-Z]+\)\s+)?(?:No\s+)?(\d+/\d+|\d+)", r"(?i)amends?\s+(?:Regulation|Directive)\s+(?:\([A-Z]+\)\s+)?(?:No\s+)?(\d+/\d+|\d+)"]
REPEALS = [r"(?i)repealing\s+(?:Council\s+|Commission\s+)?(?:Regulation|Directive)\s+(?:\([A-Z]+\)\s+)?(?:No\s+)?(\d+/\d+|\d+)", r"(?i)repeals?\s+(?:Regulation|Directive)\s+(?:\([A-Z]+\)\s+)?(?:No\s+)?(\d+/\d+|\d+)"]


def with_roles(files: DataFrame) -> DataFrame:
    """files with folder, name and role; of acts and other files the first in path order is primary, later acts are annexes, later others wrappers."""
    named = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).withColumn("name", F.substring_index("path", "/", -1))
    role = acts.file_role(F.col("name"), F.col("root"), F.col("title"))
    able = F.col("_role").isin("act", "other")
    w = Window.partitionBy("folder", able).orderBy("path")
    placed = named.withColumn("_role", role).withColumn("_n", F.row_number().over(w))
    final = chain([(able & (F.col("_n") == 1), F.lit("primary")), (F.col("_role") == "act", F.lit("annex")), (F.col("_role") == "other", F.lit("wrapper"))], F.col("_role"))
    return placed.withColumn("role", final).drop("_role", "_n")


def packages(files: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """One row for each folder: class, title, number, celex, relations, target, keywords, and how many files of each role."""
    rows = with_roles(files)
    first = lambda role, column: F.min_by(column, F.when(F.col("role") == role, F.col("path")))  # noqa: E731  rows of other roles have a null order and are passed over
    of = lambda role: F.count_if(F.col("role") == role)
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "title"))), lambda x: x["title"]), " ")
    grouped = rows.groupBy("folder").agg(
        F.count("*").alias("n_files"), of("annex").alias("n_annexes"), of("wrapper").alias("n_wrappers"), of("corrigendum").alias("n_corrections"),
        first("primary", "path").alias("primary_path"), first("primary", "root").alias("primary_root"), first("primary", "title").alias("_primary"), F.min_by("title", "path").alias("_first"), first("wrapper", "title").alias("_wrapper"), titles.alias("titles"),
    )
    some = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    rows = grouped.withColumn("title", F.coalesce(some("_primary"), some("_first"), some("_wrapper"), F.lit(""))).drop("_primary", "_first", "_wrapper")
    rows = rows.withColumn("class", acts.package_class(F.col("title"), F.col("primary_root"), F.col("n_corrections") > 0))
    pair = first_of(F.col("title"), [*NUMBERED, r"(\d+/\d+)"])
    both = acts.year_and_number(pair)
    letter = F.when(F.col("class") == "DIRECTIVE", "L").when(F.col("class") == "QUALIFIER_DECISION", "D").otherwise("R")
    target = F.when(F.col("class") == "QUALIFIER_DECISION", acts.decision_target(F.col("title"))).when(F.col("class") == "CORRIGENDUM", acts.corrigendum_target(F.col("title")))
    known = F.when(pair.isNotNull(), acts.display_number(both["year"], both["number"]))
    celex = F.when(pair.isNotNull(), F.concat(F.lit("3"), both["year"], letter, acts._padded(both["number"])))
    out = rows.withColumn("doc_number", known).withColumn("celex", celex).withColumn("target", target)
    out = out.withColumn("amends", sorted_matches(F.col("titles"), AMENDS)).withColumn("repeals", sorted_matches(F.col("titles"), REPEALS))
    return out.withColumn("keywords", acts.keywords(F.col("titles"), keywords) if keywords else F.array().cast("array<string>")).drop("titles")


def with_validity(acts_: DataFrame, this_year: int) -> DataFrame:
    """acts (act_id, doc_number, repeals, expires, scan_order) with repealed_by and validity; of several repealers the last scanned counts."""
    register = acts_.select(F.explode("repeals").alias("_pair"), F.col("act_id").alias("_by"), "scan_order").select(acts.normal_number(F.col("_pair")).alias("_number"), "_by", "scan_order")
    register = register.groupBy("_number").agg(F.max_by("_by", "scan_order").alias("repealed_by"))
    both = acts_.withColumn("_key", acts.normal_number(F.col("doc_number"))).join(register, F.col("_key") == F.col("_number"), "left").drop("_key", "_number")
    return both.withColumn("validity", acts.validity(F.col("repealed_by"), F.col("expires"), this_year))


def metrics(found: DataFrame) -> DataFrame:
    """One row of an ingest: scanned, core, annexes, qualifiers, wrappers, filtered out (no keyword) and failed."""
    relevant = F.size("keywords") > 0
    core = F.col("class").isin("CORE_REGULATION", "DIRECTIVE") & relevant
    return found.agg(
        F.count("*").alias("scanned"), F.count_if(core).alias("core"), F.coalesce(F.sum(F.when(core, F.col("n_annexes"))), F.lit(0)).alias("annexes"), F.count_if((F.col("class") == "QUALIFIER_DECISION") & relevant).alias("qualifiers"),
        F.coalesce(F.sum("n_wrappers"), F.lit(0)).alias("wrappers"), F.count_if(~relevant).alias("filtered"), F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def report(found: DataFrame) -> DataFrame:
    """Packages and files by class and by the first word of their validity, with totals of all in the null row."""
    state = F.substring_index("validity", " ", 1)
    return found.withColumn("state", state).rollup("class", "state").agg(F.count("*").alias("packages"), F.sum("n_files").alias("files"))


def consolidated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acts, qualifiers) of files with roles, package class and text: an act's text is its own and then its annexes' in path order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("role") != "primary").alias("later"), "path", "text"))), lambda x: x["text"]), "\n\n")
    both = rows.where(F.col("role").isin("primary", "annex"))
    whole = both.groupBy("folder", "class").agg(F.count_if(F.col("role") == "annex").alias("annex_count"), text.alias("text"))
    return whole.where("class != 'QUALIFIER_DECISION'"), whole.where("class = 'QUALIFIER_DECISION'")


def as_qualifiers(found: DataFrame) -> DataFrame:
    """Qualifier rows with defaults for what a package lacks."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return found.where("class = 'QUALIFIER_DECISION'").select(F.coalesce("celex", "folder").alias("qualifier_id"), "title", F.lit("DECISION").alias("qualifier_type"), empty("target").alias("target_ref"), empty("celex").alias("celex"), empty("doc_number").alias("doc_number"), F.lit("{}").alias("metadata_json"))


def archive_names(files: DataFrame) -> DataFrame:
    """files with ``archive_name``: the base name, with a part of the path's SHA-1 where several paths have it."""
    n = F.count("*").over(Window.partitionBy("_name"))
    hashed = F.concat(F.regexp_replace("_name", r"\.[^.]*$", ""), F.lit("__"), F.substring(F.sha1(F.col("path").cast("binary")), 1, 8), F.regexp_extract("_name", r"(\.[^.]*)$", 1))
    named = files.withColumn("_name", F.substring_index("path", "/", -1))
    return named.withColumn("archive_name", F.when(n > 1, hashed).otherwise(F.col("_name"))).drop("_name")


def to_copy(sources: DataFrame, archive: DataFrame) -> DataFrame:
    """Source files that the archive lacks or holds with another size or time (path, size, modified)."""
    held = archive.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    return sources.join(held, "path", "left").where(~(F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified")))).drop("_size", "_modified")


def inspected(headers: DataFrame, keywords: list[str], this_year: int) -> DataFrame:
    """Header rows (path, title, header, error) with what they state: number, expiry, repeals, keywords, state; a file that does not parse is CORRUPTED and has the rest null."""
    text = F.concat_ws(" ", "title", "header")
    good = F.col("error").isNull()
    pair = first_of(F.col("title"), NUMBERED)
    both = acts.year_and_number(pair)
    stated = {"doc_number": F.when(pair.isNotNull(), acts.display_number(both["year"], both["number"])), "expires": acts.expiry(text), "repeals": acts.repealed_numbers(text), "keywords": acts.keywords(text, keywords)}
    out = headers.select("*", *(F.when(good, c).alias(n) for n, c in stated.items()))
    return out.withColumn("state", F.when(~good, "CORRUPTED").otherwise(acts.validity(F.lit(None).cast("string"), F.col("expires"), this_year)))
