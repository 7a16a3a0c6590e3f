"""Hand-worked cases."""

import math
import unicodedata
import zipfile

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import catalog as C
from quarry.operators import chunks as K
from quarry.operators import index, lexical
from quarry.operators.packing import page_chunks
from quarry.plans import research, search
from quarry.sources import html, xml_docs
from quarry.streaming import incremental


def test_bm25_single_term(spark):
    rows = spark.createDataFrame([(1, "the operator shall rest", "rest rules", "D1"), (2, "flight duty limits for operators", "duty", "D2"), (3, "rest rest period duty", "x y", "D3"), (4, "noise only here", "z", "D4"), (5, "other words again", "q", "D5"), (6, "more filler text", "w", "D6"), (7, "éclair café", "w", "D7")], "id int, a string, b string, d string")
    got = {r["id"]: r["score"] for r in lexical.bm25(rows, "id", {"a": "a", "b": "b", "d": "d"}, ["rest"], {"a": 1.0, "b": 3.0, "d": 2.0}).collect()}
    assert math.isclose(got[1], -1.284298893328196) and math.isclose(got[3], -1.0196068730647434)
    twice = lexical.bm25(rows, "id", {"a": "a", "b": "b", "d": "d"}, ["rest", "rest"], {"a": 1.0, "b": 3.0, "d": 2.0}).where("id = 1").first()["score"]
    assert math.isclose(twice, 2 * got[1])


def test_reciprocal_ranks(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    b = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    got = [(r["id"], r["score"]) for r in lexical.reciprocal_ranks(a, b, "id").orderBy("rank").collect()]
    assert [x for x, _ in got] == ["b", "a", "c"]
    assert math.isclose(got[0][1], 1 / 62 + 1 / 61)


def test_parse_query():
    q = search.parse_query('rest of "flight duty" period')
    assert q.phrases == [["flight", "duty"], ["rest", "period"]] and q.any_of == ["rest", "period"] and q.all_of == ["rest", "period"]
    assert search.parse_query("the of").any_of == ["the", "of"]
    assert search.parse_query('"the of"').phrases == [["the", "of"]]
    assert search.parse_query("CS-25 rest", ["crew duty"]).phrases == [["cs", "25", "rest"], ["cs", "25"], ["crew", "duty"]]


def test_modality_and_lens(spark):
    row = spark.createDataFrame([("The operator shall not fly unless cleared.",)], "t string")
    m, r = T.modality(F.col("t"))
    got = row.select(m.alias("m"), r.alias("r"), *T.lens(F.col("t"), {"mandates": r"\bshall\b", "prohibitions": r"\bshall not\b"})).first()
    assert tuple(got) == ("SHALL_NOT", "PROHIBITION", 1, 1)
    pair = spark.createDataFrame([("a b c", "b c d")], "a string, b string").select(T.jaccard_percent(T.word_set(F.col("a")), T.word_set(F.col("b"))).alias("j")).first()
    assert pair["j"] == 50


def test_typography_and_slug(spark):
    row = spark.createDataFrame([("§ 21.1—Applicability", "a b/c!")], "t string, s string")
    assert tuple(row.select(T.typography(F.col("t")), T.slug(F.col("s"))).first()) == ("§ 21.1 - Applicability", "a_b_c")


def test_size_stats_takes_the_upper_median(spark):
    rows = spark.createDataFrame([("g", "x" * n) for n in (1, 2, 3, 10)], "g string, text string")
    got = K.size_stats(rows, "g").first()
    assert (got["mean_size"], got["median_size"], got["max_size"]) == (4, 3, 10)


def test_triage(spark):
    names = [f"d{k}" for k in range(8)]
    row = spark.createDataFrame([tuple([5.0] * 8)], ", ".join(f"{n} double" for n in names))
    assert tuple(row.select(*T.triage({n: 1.0 for n in names})).first()) == (5.0, 50, "medium")


def test_surroundings(spark):
    rows = spark.createDataFrame([(1, s, f"1:{s}", "t") for s in range(1, 6)], "doc_id int, seq int, chunk_id string, text string")
    got = K.surroundings(rows, rows.where("seq = 1"), 2).orderBy("seq").collect()
    assert [(r["seq"], r["position"]) for r in got] == [(1, "target"), (2, "after"), (3, "after")]
    assert K.linked(rows).orderBy("seq").first()["previous_chunk_id"] is None


def test_pages_and_packing(spark):
    rows = spark.createDataFrame([(1, "x --- PAGE 1 ---\nalpha beta\n\ngamma\n--- PAGE 2 ---\n" + "\n\n".join(["one two three"] * 5))], "doc_id int, text string")
    pages = K.pages(rows)
    assert [r["page"] for r in pages.orderBy("page").collect()] == [1, 2]
    pieces = page_chunks(pages, 6, 8, 3).orderBy("page", "piece").collect()
    assert [len(r["text"].split()) for r in pieces] == [3, 6, 6, 3]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (1, None)], "k int, v string")
    got = {r["k"]: (r["v"], r["w"]) for r in C.update_columns(old, new, "k", ["v"]).collect()}
    assert got == {1: ("a", "x"), 2: ("c", "y"), 3: ("d", None)}
    twice = spark.createDataFrame([(2, "p", "1"), (2, "q", "2")], "k int, v string, w string")
    assert sorted(r["v"] for r in C.upsert(old, twice, "k", "w").collect()) == ["a", "q"]


PART = """<DLP><PART><EAR>Pt. 999</EAR><HD SOURCE="HED">PART 999—TEST</HD><SUBPART><HD>Subpart A</HD>
<SECTION><SECTNO>§ 999.1</SECTNO><SUBJECT>Scope.</SUBJECT><P>This part applies to <E T="03">tests</E>.</P></SECTION>
<SECTION><SECTNO>§ 999.2</SECTNO><SUBJECT>Terms.</SUBJECT><P>A term.</P><GPOTABLE><BOXHD><CHED H="1">CFR Part</CHED><CHED H="1">OMB Control Number</CHED></BOXHD><ROW><ENT>Part 21</ENT><ENT>2120-0018</ENT></ROW></GPOTABLE></SECTION></SUBPART></PART></DLP>"""


def test_regulation_parts(spark):
    rows = spark.createDataFrame([("a.xml", PART.encode()), ("bad.xml", b"<x>")], "path string, content binary")
    tree = xml_docs.nodes(rows, xml_docs.PART_BLOCKS)
    assert tree.where("error is not null").count() == 1
    got = xml_docs.part_chunks(tree.where("error is null"), "CFR_Part").orderBy("seq").collect()
    assert [r["chunk_id"] for r in got] == ["CFR_Part_999:sec_999_1", "CFR_Part_999:sec_999_2"]
    assert got[0]["text"] == "This part applies to tests."
    assert "| Part 21 | 2120-0018 |" in got[1]["text"] and "| --- | --- |" in got[1]["text"]


def test_archive_members_and_headers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.xml", "<ACT><TI>On rest</TI><NO.SEQ>0001</NO.SEQ><DOC FILE='f.xml'/></ACT>")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    rows = xml_docs.members(xml_docs.files(spark, str(tmp_path), "*.zip"))
    assert rows.where("error is not null").count() == 1
    got = xml_docs.headers(rows.where("error is null")).first()
    assert (got["root"], got["seq"], got["file_ref"], got["titles"]) == ("ACT", "0001", "f.xml", ["On rest"])


def test_rule_items(spark):
    content = b"<doc><item id='1' title='A'>Text [amended 2020] on.</item><item id='2' title='B'>More</item></doc>"
    got = xml_docs.rule_items(spark.createDataFrame([("r.xml", content)], "path string, content binary")).orderBy("seq").collect()
    assert [(r["id"], r["text"]) for r in got] == [("1", "Text on."), ("2", "More")]


def test_anchors(spark):
    pages = spark.createDataFrame([(1, '<a href="x">One <b>two</b></a> <a>none</a><a href=\'x\'>three</a>'), (2, None)], "page_id long, html string")
    got = html.anchors(pages).orderBy("position").collect()
    assert [(r["href"], r["text"]) for r in got] == [("x", "One two"), ("x", "three")]
    assert html.last_by_target(html.anchors(pages)).first()["text"] == "three"


def test_research_visits_chunks_once(spark):
    rows = spark.createDataFrame([(1, k, f"1:{k}", t) for k, t in enumerate(["rest duty", "rest again", "duty limits", "none", "flight rest duty"])], "doc_id int, seq int, chunk_id string, text string")
    found = research.run(rows, "rest", follow_up=lambda asked: ["duty"], excluded=("1:1",))
    ids = [r["chunk_id"] for r in found.validated.collect()]
    assert sorted(ids) == ["1:0", "1:2", "1:4"] and found.queries == ["rest", "duty"]
    assert found.context.count() >= 3


def test_stream_index_adds_new_documents_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k} common", "en", "s") for k in range(6)], "doc_id long, text string, lang string, source string")
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    for k, part in enumerate((docs.where("doc_id < 4"), docs.where("doc_id > 1"))):
        part.coalesce(1).write.mode("append").parquet(source)
        incremental.index_new(spark.readStream.schema(docs.schema).parquet(source), index, str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(f"{index}/postings")
    assert got.where("term = 'common'").count() == 6 and got.count() == 12


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_phrase_hits_make_tokens_once(spark):
    rows = spark.createDataFrame([(1, "Of the men of the sea"), (2, "the of"), (3, None), (4, "of"), (5, "of of the")], "k int, t string")
    got = lexical.phrase_hits(rows, "k", "t", ["of", "the"])
    assert sorted(map(tuple, got.collect())) == [(1, 2), (5, 1)]
    assert _plan(got).count("regexp_extract_all") == 1
    assert [tuple(r) for r in lexical.phrase_hits(rows, "k", "t", ["sea"]).collect()] == [(1, 1)]


def test_term_totals_shuffle_no_places(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "b"), (2, "c b"), (None, "c"), (None, "c a"), (3, None), (4, "")], "k int, t string")
    got = lexical.term_totals(rows, "k", "t")
    by_places = lexical.postings(rows, "k", {"t": "t"}).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.min(F.get("positions", F.lit(0))).cast("long").alias("first_position"))
    assert sorted(map(tuple, by_places.collect())) == [("a", 2, 3, 0), ("b", 2, 3, 0), ("c", 2, 3, 0)]
    # Of the two rows of key 2 both hold b, which counts once.
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_places.collect()))
    assert "collect_list" not in _plan(got)


def test_only_texts_with_marks_reach_python(spark):
    rows = spark.createDataFrame([("plain " * 9,), ("e\u0301",), (None,), ("\u212b",), ("",)], "t string")
    assert [r[0] for r in rows.select(T.composed(F.col("t"))).collect()] == ["plain " * 9, "\u00e9", None, "\u00c5", ""]
    plan = _plan(rows.select(T.composed(F.col("t"))))
    assert "nfc(CASE WHEN" in plan or "ArrowEvalPython [nfc(_" in plan, plan


def test_every_text_that_nfc_changes_is_composed(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    changed = [f"a{c}" for c in every if unicodedata.normalize("NFC", c) != c]
    pairs = [unicodedata.normalize("NFD", c) for c in every if unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)) == c != unicodedata.normalize("NFD", c)]
    late = ["q" + c + "\u0323" for c in every if unicodedata.combining(c) > 220]  # put in another order
    given = changed + pairs + late + ["\u1100\u1161\u11a8", "\uac00\u11a8"]
    assert len(changed) > 1000 and len(pairs) > 12000
    got = spark.createDataFrame(list(enumerate(given)), "k int, t string").select("k", T.composed(F.col("t")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in got} == {k: unicodedata.normalize("NFC", t) for k, t in enumerate(given)}
    low = [chr(a) + chr(b) for a in range(0x300) for b in range(0x300)]  # what is left out has nothing to change
    assert all(unicodedata.is_normalized("NFC", x) for x in low)


def test_postings_are_shuffled_once(spark):
    rows = spark.createDataFrame([(1, "a b a", "b"), (2, "", None), (3, None, "c a"), (4, "rested resting", "x")], "k long, t string, u string")
    columns = {"t": "t", "u": "u"}
    bags = index.bags_of(rows, "k", columns, True)
    posted = index.postings_of(bags, columns, False, 8)
    assert sorted((r["term"], r["key"], r["col"], r["len"], r["tf"], r["positions"]) for r in posted.collect()) == [("a", 1, "t", 4, 2, [0, 2]), ("a", 3, "u", 2, 1, [1]), ("b", 1, "t", 4, 1, [1]), ("b", 1, "u", 4, 1, [0]), ("c", 3, "u", 2, 1, [0]), ("rested", 4, "t", 3, 1, [0]), ("resting", 4, "t", 3, 1, [1]), ("x", 4, "u", 3, 1, [0])]
    assert "Aggregate" not in _plan(posted)
    stemmed = index.postings_of(bags, columns, True, 8)
    assert [(r["tf"], r["positions"]) for r in stemmed.where("term = 'rest'").collect()] == [(2, [0, 1])] and "Join" not in _plan(stemmed)
