"""Beginnings of files, volumes, rule packages, conversion, embedding, and the library's small functions."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import catalog, records
from quarry.plans import conversion, dataset, library, research
from quarry.sources import files, heads, rule_packages, sinks, xml_docs
from quarry.streaming.embedding import VectorStore


def written(folder, contents):
    for name, content in contents.items():
        (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


HEAD = """<ACT><BIB.INSTANCE><DOCUMENT.REF FILE="L_2020.doc.xml"/><DATE ISO="20200102">2.1.2020</DATE><NO.SEQ>0003</NO.SEQ><DURAB>2025</DURAB></BIB.INSTANCE>
<TITLE><TI><P>On aviation</P></TI><TI><P>and rest</P></TI></TITLE><ENACTING.TERMS>"""


def test_headers_read_only_the_beginning(spark, tmp_path):
    body = "<ARTICLE><P>" + "word " * 20_000 + "</P></ARTICLE>"
    path = written(tmp_path, {"small.xml": HEAD + "<P/></ENACTING.TERMS></ACT>", "large.xml": HEAD + body * 20 + "</ENACTING.TERMS></ACT>", "corr.xml": "<CORR><DOC.CORR><NO.CURRENT>965</NO.CURRENT><YEAR>2012</YEAR><COM>EU</COM></DOC.CORR><TI>Fix</TI></CORR>", "cut.xml": "<ACT><TI>Half", "empty.xml": "", "bin.xml": b"\xff\x00", "wide.xml": '<?xml version="1.0" encoding="no-such"?><ACT/>', "other.txt": "x"})
    listed = heads.listing(spark, path)
    assert listed.count() == 6  # but the empty one
    got = {r["path"].rpartition("/")[2]: r for r in heads.headers(listed).collect()}
    for name in ("small.xml", "large.xml"):
        r = got[name]
        assert (r["root"], r["file_ref"], r["seq"], r["titles"], r["date"], r["durability"], r["error"]) == ("ACT", "L_2020.doc.xml", "0003", ["On aviation and rest"], "20200102", "2025", None)
    assert got["large.xml"]["bytes_read"] == heads.PIECE < (tmp_path / "large.xml").stat().st_size / 50
    assert got["corr.xml"]["corrected"] == "965/2012 (EU)" and got["corr.xml"]["titles"] == ["Fix"] and got["corr.xml"]["error"] is None
    assert got["cut.xml"]["root"] == "ACT" and got["cut.xml"]["error"] and got["bin.xml"]["error"] and got["wide.xml"]["error"]
    found = heads.relevant(listed, [r"\baviation\b"]).collect()
    assert sorted(r["path"].rpartition("/")[2] for r in found) == ["large.xml", "small.xml"] and all(r["keywords"] for r in found)


def test_volumes_give_parts_with_the_date_before(spark, tmp_path):
    part = lambda n, more="": f"<PART><EAR>Pt. {n}</EAR>{more}<SECTION><SECTNO>§ {n}.1</SECTNO><SUBJECT>S</SUBJECT><P>Text {n}.</P></SECTION></PART>"
    path = written(tmp_path, {"v1.xml": "<VOL>" + part(1) + "<FM><REVISED>Revised as of <E>May</E></REVISED></FM><CHAPTER>" + part(2) + part(3, "<DATE>June</DATE>") + "</CHAPTER>" + part(4) + "</VOL>", "v2.xml": "<VOL>" + part(5) + "<PART>", "v3.xml": ""})
    rows = heads.volume_parts(heads.listing(spark, path), default="January")
    got = {(r["path"].rpartition("/")[2], r["ord"]): r for r in rows.collect()}
    assert [got["v1.xml", k]["revised"] for k in range(4)] == ["January", "Revised as of May", "June", "June"]
    assert got["v2.xml", 0]["content"] and got["v2.xml", 1]["error"] and len(got) == 6
    good = rows.where("error is null").select(F.concat_ws("#", "path", "ord").alias("path"), "content")
    chunks = xml_docs.part_chunks(xml_docs.nodes(good, xml_docs.PART_BLOCKS)).collect()
    assert sorted(r["text"] for r in chunks) == [f"Text {n}." for n in (1, 2, 3, 4, 5)]


PACKAGE = """<pkg:package xmlns:pkg="http://schemas.microsoft.com/office/2006/xmlPackage" xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:er="http://www.easa.europa.eu/erules-export">
<pkg:part pkg:name="/_rels/.rels"><pkg:xmlData><Relationships><Relationship Id="r1" Type="http://x/officeDocument" Target="word/main.xml"/></Relationships></pkg:xmlData></pkg:part>
<pkg:part pkg:name="/customXml/item1.xml"><pkg:xmlData><er:document><er:heading sdt-id="1" title="Subpart A"/><er:topic sdt-id="2" source-title="CS 25.101 General" TypeOfContent="CS" RegulatorySubject="CS-25" ERulesId="E2"/><er:topic sdt-id="3" source-title="AMC1 CS 25.101(a) Means" TypeOfContent="AMC"/><er:topic sdt-id="4" source-title=" "/><er:topic sdt-id="9" source-title="Nowhere"/></er:document></pkg:xmlData></pkg:part>
<pkg:part pkg:name="/word/main.xml"><pkg:xmlData><w:document><w:body>
<w:sdt><w:sdtPr><w:id w:val="1"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>Subpart</w:t></w:r></w:p><w:sdt><w:sdtPr><w:id w:val="2"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>(a) The </w:t></w:r><w:r><w:t>aeroplane [Amdt 25/12]</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>ED Decision 2013/015/R</w:t></w:r></w:p></w:sdtContent></w:sdt></w:sdtContent></w:sdt>
<w:sdt><w:sdtPr><w:id w:val="3"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>By test.</w:t></w:r></w:p></w:sdtContent></w:sdt><w:sdt><w:sdtPr><w:id w:val="4"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>untitled</w:t></w:r></w:p></w:sdtContent></w:sdt><w:sdt><w:sdtPr><w:id w:val="7"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>unlisted</w:t></w:r></w:p></w:sdtContent></w:sdt><w:p><w:r><w:t>outside</w:t></w:r></w:p>
</w:body></w:document></pkg:xmlData></pkg:part><pkg:part pkg:name="/word/header.xml"><pkg:xmlData><w:sdt><w:sdtPr><w:id w:val="2"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>not the body</w:t></w:r></w:p></w:sdtContent></w:sdt></pkg:xmlData></pkg:part></pkg:package>"""


def test_rule_packages(spark):
    plain = PACKAGE.replace("word/main.xml", "word/document.xml").replace("/_rels/.rels", "/none").replace("officeDocument", "none")
    rows = rule_packages.package_rows(spark.createDataFrame([("a", PACKAGE.encode()), ("b", plain.encode()), ("bad", b"<x"), ("none", None), ("void", b"<x/>")], "path string, content binary"))
    for path in ("a", "b"):  # with and without a relationship
        got = rule_packages.rule_items(rows.where(F.col("path") == path)).orderBy("seq").collect()
        assert [(r["sdt_id"], r["title"], r["number"], r["type"], r["text"]) for r in got] == [("1", "Subpart A", None, "heading", "Subpart\n(a) The aeroplane"), ("2", "CS 25.101 General", "CS 25.101", "CS", "(a) The aeroplane"), ("3", "AMC1 CS 25.101(a) Means", "CS 25.101(a)", "AMC", "By test.")]
        assert got[1]["rule_id"] == "E2" and got[1]["subject"] == "CS-25"
    assert {r["path"] for r in rule_packages.package_errors(rows).collect()} == {"bad", "none", "void"}


def test_conversion(spark):
    act = """<ACT><TOC><P>Contents</P></TOC><ARTICLE><TI.ART>Article 1</TI.ART><STI.ART>Scope</STI.ART><ALINEA>Crews<NOTE NOTE.ID="E1"><P>See annex.</P></NOTE> need:</ALINEA><LIST><ITEM><NP><NO.P>1.</NO.P><P>rest</P></NP></ITEM><ITEM><NP><NO.P>(a)</NO.P><P>daily</P></NP></ITEM><ITEM><NP><NO.P>2.</NO.P><P>food</P></NP></ITEM></LIST></ARTICLE></ACT>"""
    rows = spark.createDataFrame([("a", act.encode()), ("worse", b"<ACT><P>open & loose"), ("none", b"")], "path string, content binary")
    text = {r["path"]: r for r in conversion.converted(rows, "text").collect()}
    assert [line for line in text["a"]["output"].splitlines() if line] == ["Article Article 1 Scope", "Crews[^E1] need:", "Note: See annex.", "1. rest", "(a) daily", "2. food"]
    assert text["a"]["n_notes"] == 1 and text["worse"]["engine"] == "repaired" and text["worse"]["output"] == "open & loose" and text["none"]["error"] and text["none"]["output"] is None
    nodes = {True: None, False: None}
    for nest in nodes:
        made = json.loads(conversion.converted(rows, "json", nest_points=nest).where("path = 'a'").first()["output"])
        nodes[nest] = {n["number"]: n for n in made if n["type"] == "item"}
    assert nodes[True]["(a)"]["parent_id"] == nodes[True]["1."]["node_id"] and nodes[True]["(a)"]["depth"] == nodes[True]["1."]["depth"] + 1
    assert nodes[False]["(a)"]["parent_id"] == nodes[False]["1."]["parent_id"] == nodes[True]["2."]["parent_id"]
    assert "Contents" in conversion.converted(rows, "markdown", keep_toc=True).where("path = 'a'").first()["output"]
    assert "Contents" not in conversion.converted(rows, "markdown").where("path = 'a'").first()["output"]
    with pytest.raises(ValueError):
        conversion.converted(rows, "pdf")


def test_vectors_by_stream_and_in_portions(spark, tmp_path):
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 3.0, 4.0])

    store = VectorStore(spark, str(tmp_path / "store"), lengths, prefix="")
    rows = spark.createDataFrame([(k, "x" * k) for k in range(6)] + [(None, "y"), (3, "xxx"), (7, None)], "id long, text string")
    ids = lambda kind: sorted(r["id"] for r in store.vectors(kind).collect())
    assert ids("act") == []
    store.add(rows, F.col("text"), "act", limit=2)
    assert ids("act") == ["0", "1"]
    store.add(rows, F.col("text"), "act", limit=3)
    store.add(rows, F.col("text"), "act")
    assert ids("act") == ["0", "1", "2", "3", "4", "5", "7"] and ids("note") == []
    vector = store.vectors("act").where("id = '0'").first()["embedding"]
    assert [round(x, 6) for x in vector] == [0.0, 0.6, 0.8]

    # A run that dies in the middle of a batch goes on without a vector twice.
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    rows.where("id < 4").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(source)

    def fails(texts: pd.Series) -> pd.Series:
        raise RuntimeError("model is gone")

    with pytest.raises(Exception, match="model is gone"):
        VectorStore(spark, str(tmp_path / "store"), fails, prefix="").follow(stream(), F.col("text"), "note", checkpoint).awaitTermination()
    assert ids("note") == []
    store.follow(stream(), F.col("text"), "note", checkpoint).awaitTermination()
    rows.where("id > 2").coalesce(1).write.mode("append").parquet(source)
    store.follow(stream(), F.col("text"), "note", checkpoint).awaitTermination()
    assert ids("note") == ["0", "1", "2", "3", "4", "5", "7"]
    version = store.store.versions()[-1]
    assert store.add(rows, F.col("text"), "note", note={"stream": checkpoint, "batch": 0}) == version
    store.drop("note", spark.createDataFrame([(7,), (99,)], "id long"))
    assert "7" not in ids("note") and len(ids("act")) == 7


def test_vectors_of_what_is_absent(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "id string, text string")
    path = str(tmp_path / "v")
    assert sinks.embed_absent(rows.where("id = 'a'"), F.col("text"), sinks.patient(lambda t: [[1.0, 0.0]] * len(t), 2), path, "k").count() == 1
    assert sinks.embed_absent(rows, F.col("text"), sinks.patient(lambda t: [[0.0, 2.0]] * len(t), 2), path, "k").count() == 2
    got = {r["id"]: list(r["embedding"]) for r in sinks.stored_vectors(spark, path, "k").collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 1.0]}


def test_roles_and_filters(spark):
    cases = {"Crews shall rest": ("SHALL", "REQUIREMENT"), "must not fly": ("MUST_NOT", "PROHIBITION"), "may go": ("MAY", "PERMISSION"), "It should means rest": ("SHOULD", "DEFINITION"), "should not, unless": ("SHOULD_NOT", "EXCEPTION"), "Scope of this rule": ("NONE", "SCOPE"), "plain": ("NONE", "INFORMATION"), None: ("NONE", "INFORMATION")}
    kind, role = T.legal_semantics(F.col("t"))
    assert {r["t"]: (r["m"], r["r"]) for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", kind.alias("m"), role.alias("r")).collect()} == cases
    rows = spark.createDataFrame([(1, "Rest", "crews shall"), (2, None, "REST never"), (3, "x", None)], "id int, title string, text string")
    ids = lambda **kw: [r["id"] for r in rows.where(T.instant_filter(F.col("title"), F.col("text"), **kw)).orderBy("id").collect()]
    assert ids() == [1, 2, 3] and ids(words=" rest ") == [1, 2] and ids(words="rest", pattern=r"\bshall\b") == [1] and ids(pattern="SHALL") == [1]
    jobs = spark.createDataFrame([(1, "Rest rules", "FAILED"), (2, "rest", "COMPLETED"), (3, None, None)], "job_id int, query string, status string")
    assert records.found_jobs(jobs, "REST").count() == 2 and records.found_jobs(jobs, "rest", "failed").count() == 1 and records.found_jobs(jobs).count() == 3
    assert records.found_sections(rows.select("title", "text"), "rest").count() == 2


def test_questions_are_drawn_and_appended(spark):
    chunks = spark.createDataFrame([(f"d{k % 3}", f"c{k}", f"text {k}" if k else " ") for k in range(9)], "doc string, chunk_id string, text string")
    split = spark.createDataFrame([("d0", "train"), ("d1", "val"), ("d2", "test")], "doc string, split string")
    made = dataset.examples(chunks, {"quote": (F.lit("Quote."), F.col("text"))}, split, "doc")
    ask = lambda t: [{"q": f"what {t}", "a": t}, {"q": "none", "a": " "}] if "3" not in t else {"q": 1}
    first, bad = dataset.with_questions(made, chunks, split, "doc", ask, 4)
    n = first.where("task = 'question'").count()
    assert n + bad.count() == 4 and first.columns == made.columns
    both, _ = dataset.with_questions(first, chunks, split, "doc", ask, 99)
    assert both.where("task = 'question'").count() == 7 and both.select("id").distinct().count() == both.count()


def test_rows_are_judged_with_attempts_and_errors(spark):
    queue = spark.createDataFrame([(1, "good", 0), (2, "short", None), (3, "boom", 2), (4, "old", 3)], "id int, text string, attempts int")
    judge = lambda t: {"good": {"a": 10, "b": 5}, "short": {"a": 1}}[t] if t != "boom" else 1 / 0
    after = {r["id"]: r for r in dataset.judged(queue, judge, {"a": 1.0, "b": 1.0}).collect()}
    assert (after[1]["score"], after[1]["priority"], after[1]["bucket"], after[1]["attempts"], after[1]["error"]) == (7.5, 75, "critical", 1, None)
    assert after[2]["error"] == "no number for b" and after[2]["attempts"] == 1 and after[3]["error"].startswith("ZeroDivisionError") and after[3]["attempts"] == 3
    assert after[4]["attempts"] == 3 and after[4]["error"] is None
    again = {r["id"]: r for r in dataset.judged(dataset.judged(queue, judge, {"a": 1.0, "b": 1.0}), judge, {"a": 1.0, "b": 1.0}).collect()}
    assert again[1]["attempts"] == 1 and again[2]["attempts"] == 2 and again[3]["attempts"] == 3


def test_small_library_functions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", ""), (2, None, "A"), (3, "", "c")], "doc_id long, title string, alt string")
    assert [r["doc_id"] for r in catalog.by_shown_title(rows, ["title", "alt"]).collect()] == [2, 1, 3]
    assert [r["doc_id"] for r in library.listed(rows, "B").collect()] == [1] and library.listed(rows, "%").count() == 0
    assert {"all", "eu"} <= {r["origin"] for r in library.origin_options(spark).collect()}
    chunks = spark.createDataFrame([("n1", "n1:1", 1, "first"), ("n1", "n1:2", 2, "second"), ("n2", "n2:1", 1, "other")], "doc_id string, chunk_id string, seq int, text string")
    notes = spark.createDataFrame([("n1", "One", "note"), ("n2", "Two", "note")], "doc_id string, title string, origin string")
    whole = library.note_with_text(notes, chunks, "n1").collect()
    assert len(whole) == 1 and "first" in str(whole[0]) and "second" in str(whole[0]) and library.note_with_text(notes, chunks, "zz").count() == 0
    left = library.without_document(notes, chunks, "n1")
    assert [f.count() for f in left] == [1, 1]
    cache = spark.createDataFrame([("doc:1", "x"), ("note:2", "y")], "key string, value string")
    assert [r["id"] for r in library.cached_ids(cache, "doc:").collect()] == ["1"]
    parsed = xml_docs.nodes(spark.createDataFrame([("a", b"<ACT><ARTICLE><P>x</P></ARTICLE></ACT>"), ("b", b"<")], "path string, content binary"))
    assert tuple(library.parse_report(parsed).first()) == (2, 1, 1, 0.5)
    assert json.loads(library.nodes_as_json(parsed).first()["json"])[0]["type"] == "article"
    assert files.hashed(spark.createDataFrame([("a", b"x")], "path string, content binary")).first()["sha256"].startswith("2d711642")
    assert files.relevant_titles(spark.createDataFrame([("On aviation",), ("Fish",)], "title string"), [r"\baviation\b"]).count() == 1
    dated = files.carried_date(spark.createDataFrame([("p", 1, None), ("p", 2, "May"), ("p", 3, None)], "path string, ord int, d string"), F.col("d")).orderBy("ord")
    assert [r["revised"] for r in dated.collect()] == [None, "May", "May"]
    assert records.not_yet_done(rows, rows.where("doc_id = 1"), "doc_id").count() == 2
    sinks.json_documents(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    words = spark.createDataFrame([("The Flight Crew Rest and Flight Time are here. flight",)], "t string").select(T.harvested_terms(F.col("t"), ["flight"]).alias("x")).first()["x"]
    assert words == ["Flight Time", "The Flight Crew Rest and"]
    ranked = lambda ids: spark.createDataFrame([(c, k + 1) for k, c in enumerate(ids)], "chunk_id string, rank int")
    got = research.gap_research(["g1", "g2"], lambda g: (ranked(["a", "b"]), ranked(["b", "c" if g == "g2" else "b2"])), spark.createDataFrame([("a",)], "chunk_id string"), top=2)
    assert {r["chunk_id"]: r["gap"] for r in got.collect()} == {"a": None, "b": "g1"}
