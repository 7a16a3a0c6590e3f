"""Hand-worked cases of tokens, the stored index, trees, records, packages, files and sinks."""

import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import acts, text as T
from quarry.functions.tokens import folded, stem, stems, tokens
from quarry.operators import index, records, trees
from quarry.operators.lexical import Expression, expression_scores
from quarry.plans import dataset, packages, search
from quarry.sources import files, sinks


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_folding_and_stems(spark):
    assert one(spark, folded(F.col("t")), t="Café ÉÀ ñandú é Straße") == "cafe ea nandu e straße"
    assert one(spark, tokens(F.col("t")), t="L'Été, 2x!") == ["l", "ete", "2x"]
    words = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "operators": "oper", "operator": "oper", "probate": "probat", "controll": "control", "sky": "sky", "as": "as", "été": "été"}
    assert {w: stem(w) for w in words} == words
    assert stems(spark.createDataFrame([("operators",), ("operators",), ("a",)], "term string")).count() == 2


def test_stored_index_finds_what_rows_give(spark, tmp_path):
    rows = [(1, "The café operators rest", "crew"), (2, "rest of the crew", None), (3, None, "operator"), (4, "", ""), (5, "duty rest duty rest duty", "rest")]
    frame = spark.createDataFrame(rows, "id long, body string, title string")
    columns, weights = {"body": "body", "title": "title"}, {"title": 3.0}
    wanted = Expression([["rest", "duty"], ["of", "the"]], ["rest", "crew"], ["rest", "crew"])
    index.build(frame, "id", columns, str(tmp_path / "plain"))
    got = {r["key"]: round(r["score"], 9) for r in index.search(spark, str(tmp_path / "plain"), wanted, weights).collect()}
    slow = {r["id"]: round(r["score"], 9) for r in expression_scores(frame, "id", columns, wanted, weights, tokenise=tokens).collect()}
    assert got == slow and set(got) == {1, 2, 5}
    assert {r["key"] for r in index.search(spark, str(tmp_path / "plain"), Expression(any_of=["cafe"])).collect()} == {1}
    index.build(frame, "id", columns, str(tmp_path / "stems"), stemmed=True)
    assert {r["key"] for r in index.search(spark, str(tmp_path / "stems"), Expression(any_of=["operators"])).collect()} == {1, 3}
    plan = index.search(spark, str(tmp_path / "plain"), wanted)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") or "bucket" in plan
    index.build(frame.where("id = 99"), "id", columns, str(tmp_path / "none"))
    assert index.search(spark, str(tmp_path / "none"), wanted).count() == 0


def test_keyword_search_scores_phrases(spark):
    rows = spark.createDataFrame([(1, "flight duty rest"), (2, "duty flight rest"), (3, "other words")], "id long, text string")
    top = [r["id"] for r in search.keyword_search(rows, "id", {"text": "text"}, '"flight duty"', 5).collect()]
    assert top == [1]
    both = [r["id"] for r in search.keyword_search(rows, "id", {"text": "text"}, "duty", 5, expander=lambda q: ["other words"]).collect()]
    assert set(both) == {1, 2, 3}
    assert search.keyword_search(rows, "id", {"text": "text"}, "!?", 5).count() == 0


def test_scopes():
    assert search.query_text("q", "find") == "query: find: q" and search.query_text("q") == "q"
    assert search.query_text("q", hypothetical=lambda q: "x" * 30) == "x" * 30 and search.query_text("q", hypothetical=lambda q: "x") == "q"


NODES = "doc_id long, node_id int, parent_id int, depth int, type string, number string, title string, text string, doc_title string"


def test_tree_to_chunks(spark):
    rows = [
        (1, 0, None, 0, "section", None, "Body", None, "Act"), (1, 1, 0, 1, "article", "5", "Rest", "Crews rest.", "Act"), (1, 2, 1, 2, "paragraph", "1", None, "They need:", "Act"), (1, 3, 2, 3, "item", "(a)", None, "sleep", "Act"), (1, 4, 3, 4, "text", None, None, "much", "Act"),
        (1, 5, 0, 1, "article", "6", None, None, "Act"), (1, 6, 5, 2, "text", None, None, "last", "Act"), (2, 0, None, 0, "annex", None, None, " ", "B"),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    got = {r["text"]: r for r in trees.chunks_of(nodes).collect()}
    assert got["sleep"]["path"] == ["Body", "Article 5", "(a)"] and got["sleep"]["numbers"] == ["5", "(a)"] and got["sleep"]["chunk_id"] == "1:5:(a):2"
    assert got["much"]["chunk_type"] == "item" and got["much"]["parent_chunk_id"] == "1:5:(a):2" and got["last"]["parent_chunk_id"] is None
    assert got["last"]["path"] == ["Body", "Article 6"] and got["last"]["embedding_text"] == "Document: Act\nContext:\n- Body\n- Article 6\n\nlast"
    below = {(r["doc_id"], r["node_id"]): (r["n_below"], r["text"]) for r in trees.subtree_texts(nodes).collect()}
    assert below[1, 2] == (2, "They need: sleep much") and below[1, 0][0] == 6 and below[2, 0] == (0, "")
    assert trees.rendered(nodes).where("doc_id = 1").first()["text"].startswith("# Body\n\n## Article 5 Rest\n\nCrews rest.\n\n1 They need:\n\n  - (a) sleep")
    assert trees.chunks_of(nodes.where("doc_id = 9")).count() == 0


def test_lists_merge_with_nested_items(spark):
    rows = [("d", k, f"c{k}", t, x, n) for k, (t, x, n) in enumerate([("text", "needs:", []), ("item", "one:", ["1"]), ("item", "two", ["1", "a"]), ("item", "head:", ["2"]), ("text", "stop", []), ("item", "own:", ["3"]), ("item", "in", ["3", "i"]), ("item", "out", ["4"])])]
    got = [(r["chunk_id"], r["chunk_type"], r["text"], r["n_rows"]) for r in trees.merged(spark.createDataFrame(rows, "doc_id string, seq long, chunk_id string, chunk_type string, text string, numbers array<string>")).orderBy("seq").collect()]
    assert got == [("c0", "merged_list", "needs:\n1 one:\na two\n2 head:", 4), ("c4", "text", "stop", 1), ("c5", "merged_list", "own:\ni in", 2), ("c7", "item", "out", 1)]


def test_points_nest_by_their_labels(spark):
    labels = ["1.", "(a)", "(i)", "(ii)", "(b)", "2.", "(h)", "(i)", None, "(A)", "x-"]
    rows = [("d", k, "item" if x else "text", x) for k, x in enumerate(labels)] + [("d", 20, "item", "1."), ("d", 21, "list", None)]
    got = {r["seq"]: r["point_parent"] for r in trees.nested_points(spark.createDataFrame(rows, "doc_id string, seq long, type string, number string")).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 1, 4: 0, 5: None, 6: 5, 7: 5, 8: None, 9: None, 10: None, 20: None, 21: 20}


def test_long_records_and_references(spark):
    rows = spark.createDataFrame([(1, "Lead:", "aa bb cc dd"), (2, None, "short"), (3, "L", "")], "id int, lead string, text string")
    got = [(r["id"], r["part"], r["text"]) for r in trees.records(rows, 11).orderBy("id", "part").collect()]
    assert got == [(1, 0, "Lead: aa bb"), (1, 1, "Lead: cc dd"), (2, 0, "short"), (3, 0, "L ")]
    found = one(spark, trees.references(F.col("t")), t="see [here](http://x/a) and Regulation (EU) No 965/2012")
    assert [(r["kind"], r["target"]) for r in found] == [("link", "http://x/a"), ("act", "965/2012")]
    sources = spark.createDataFrame([(1, "P", "Crews, must rest well."), (1, "NOTE", "Nowhere to be found in it."), (1, "P", "ab")], "doc_id int, tag string, text string")
    lost = trees.orphans(sources, spark.createDataFrame([(1, 0, "crews MUST"), (1, 1, "rest well")], "doc_id int, seq int, text string"), 10)
    assert [tuple(r) for r in trees.orphan_counts(lost).collect()] == [("NOTE", 1)]


def test_request_delays(spark):
    rows = [("a", k, k == 30) for k in range(60)] + [("b", 0, None), ("c", 0, True)]
    got = {r["host"]: (round(r["delay"], 6), r["streak"]) for r in records.request_delays(spark.createDataFrame(rows, "host string, seq int, challenged boolean")).collect()}
    assert got == {"a": (round(0.92 * 2.5 * 0.92, 6), 29), "b": (1.0, 1), "c": (2.5, 0)}


def test_packages(spark):
    rows = [("/p/x/b.xml", "ACT", "Commission Regulation (EU) No 965/2012 amending Regulation (EC) No 1/2008"), ("/p/x/a.toc.xml", "TOC", "list"), ("/p/x/c.xml", "ACT", "Annex text"), ("/p/y/d.xml", "CORR", "Corrigendum to Regulation (EU) No 7/2011"), ("/p/z/e.xml", "ACT", None)]
    found = packages.packages(spark.createDataFrame(rows, "path string, root string, title string"), ["annex", "list"])
    got = {r["folder"]: r for r in found.collect()}
    x = got["/p/x"]
    assert (x["class"], x["doc_number"], x["celex"], x["n_annexes"], x["n_wrappers"], x["amends"], x["keywords"]) == ("CORE_REGULATION", "965/2012", "32012R0965", 1, 1, ["1/2008"], ["annex", "list"])
    assert (got["/p/y"]["class"], got["/p/y"]["target"]) == ("CORRIGENDUM", "7/2011") and got["/p/z"]["class"] == "CORE_REGULATION"
    whole, qualifiers = packages.consolidated(packages.with_roles(spark.createDataFrame(rows, "path string, root string, title string")).withColumn("text", F.col("name")).withColumn("class", F.lit("CORE_REGULATION")))
    assert {r["folder"]: (r["annex_count"], r["text"]) for r in whole.collect()}["/p/x"] == (1, "b.xml\n\nc.xml") and qualifiers.count() == 0
    assert one(spark, acts.year_and_number(F.col("t"))["year"], t="3922/91") == "1991" and one(spark, acts.normal_number(F.col("t")), t="2018/0113") == "113/2018"


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "d.json").write_text("{}")
    (tmp_path / "a" / "good.json").write_text(json.dumps({"document_id": "d", "title": "t", "chunks": [{"text": "x"}, {"text": "y"}]}))
    (tmp_path / "a" / "bad.json").write_text("{nope")
    (tmp_path / "a" / "p.txt").write_bytes("é page".encode())
    (tmp_path / "a" / "_skip.txt").write_text("no")
    assert files.first_found(spark, "d.json", [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 1
    chunks, bad = files.chunk_files(spark, str(tmp_path / "a"), "text string")
    assert [r["text"] for r in chunks.orderBy("seq").collect()] == ["x", "y"] and bad.count() == 1
    assert [(r["doc_id"], r["text"]) for r in files.page_texts(spark, str(tmp_path / "a")).collect()] == [("p", "é page")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.xml", "<A>long</A>")
        z.writestr("b.toc.xml", "<T>much longer text</T>")
    rows = spark.createDataFrame([(1, bytearray(b" <X/>")), (2, bytearray(out.getvalue())), (3, bytearray(b"PK broken")), (4, None)], "id int, content binary")
    assert {r["id"]: bytes(r["xml"]) if r["xml"] else None for r in files.payloads(rows).collect()} == {1: b" <X/>", 2: b"<A>long</A>", 3: None, 4: None}
    feed = spark.createDataFrame([("f", bytearray(b"<rss><channel><item><title> T </title><link>u</link></item><item><title>none</title></item></channel></rss>")), ("g", bytearray(b"<rss>"))], "path string, content binary")
    assert [tuple(r) for r in files.feed_items(feed).collect()] == [("f", "T", "u")]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "vectors")
    assert sinks.stored_vectors(spark, path) is None
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (1, [3.0, 4.0])], "id long, embedding array<double>")
    sinks.append_vectors(rows, path, "chunk")
    sinks.append_vectors(rows, path, "chunk")
    assert sorted((r["id"], [round(x, 3) for x in r["embedding"]]) for r in sinks.stored_vectors(spark, path, "chunk").collect()) == [(1, [0.6, 0.8]), (2, [0.0, 0.0])]

    def fails_on_long(texts):
        if len(texts) > 1 or len(texts[0]) > 20:
            raise ValueError
        return [[float(len(texts[0])), 0.0]]

    embed = sinks.patient(fails_on_long, 2, shorter=12)
    assert embed(pd.Series(["a", "b" * 100])).tolist() == [[1.0, 0.0], [12.0, 0.0]]
    assert sinks.patient(lambda t: 1 / 0, 2)(pd.Series(["a"])).tolist() == [[0.0, 0.0]]
    docs = spark.createDataFrame([("b", "B", 2, 5), ("a", "A", 1, 3)], "doc_id string, title string, n_chunks int, n_words int")
    told = json.loads(sinks.manifest(docs).first()[0])
    assert told["documents"] == 2 and told["words"] == 8 and [d["doc_id"] for d in told["list"]] == ["a", "b"]
    sinks.extraction_reports(spark.createDataFrame([("x", "PASS", ["a"]), ("y", "FAIL", ["b", "c"])], "path string, status string, reasons array<string>"), str(tmp_path / "reports"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "reports" / "follow_up")).collect()] == [("y", "FAIL", "b; c")]
    assert "documents: 2" in sinks.summary([("All", docs.agg(F.count("*").alias("documents")))])
    now = [0.0]
    reads = []
    catalog = sinks.Catalog(lambda: reads.append(1) or spark.range(3), 600, clock=lambda: now[0])
    assert catalog.get().count() == catalog.get().count() == 3 and len(reads) == 1
    now[0] = 601
    catalog.get()
    catalog.flush()
    catalog.get()
    assert len(reads) == 3
    assert sinks.dropped(spark, [path, path]) == [path]


def test_templates_and_questions(spark):
    rows = spark.createDataFrame([("c1", "d", "Crews shall rest.", "Act", "en", "2020", "article", "ACT", ["Part", "Art 1"], ["1"], ["965/2012"], [("Crews shall rest", "SHALL", "shall", "crew")], '{"status": "IN FORCE"}'), ("c2", "d", "Plain.", None, None, None, "text", None, [], [], [], [], None)],
        "chunk_id string, doc_id string, text string, title string, language string, date string, chunk_type string, node_type string, path array<string>, numbers array<string>, references array<string>, modals array<struct<text: string, modality: string, trigger: string, party: string>>, doc_metadata string")
    split = spark.createDataFrame([("d", "train")], "doc_id string, split string")
    made = dataset.examples(rows, dataset.provision_templates(), split, "doc_id")
    tasks = {(r["chunk_id"], r["task"]) for r in made.collect()}
    assert {t for c, t in tasks if c == "c1"} == {"document_identification", "structural_location", "chunk_classification", "reference_extraction", "document_metadata", "context_reconstruction", "modal_extraction_0"}
    assert {t for c, t in tasks if c == "c2"} == {"document_identification", "structural_location", "chunk_classification"}
    asked = {r["id"]: r for r in dataset.asked(rows.select(F.col("chunk_id").alias("id"), "text"), lambda t: [{"q": "?", "a": t}] if "rest" in t else [{"q": 1}], 1).collect()}
    assert asked["c1"]["pairs"][0]["a"] == "Crews shall rest." and asked["c2"]["error"] == "unexpected shape"


def test_text_functions(spark):
    assert one(spark, T.without_amendment_marks(F.col("t")), t="►M1 new text ◄ stays") == "new text stays"
    assert one(spark, T.raised(F.col("t")), t="10n") == "¹⁰ⁿ" and one(spark, T.fraction(F.col("a"), F.col("b")), a="x + 1", b="2") == "(x + 1)/2"
    assert one(spark, T.composed(F.col("t")), t="é a") == "é a"
    text = "\n".join(["Crew means all persons on duty", *[f"line {k}" for k in range(16)]])
    assert [tuple(r) for r in one(spark, T.definitions(F.col("t")), t=text)] == [("Crew", "all persons on duty")] and one(spark, T.definitions(F.col("t")), t="Crew means all") == []
    parts = one(spark, T.report_sections(F.col("t")), t="Before\n# Summary of it\nbody\n## Open gaps\n- a\n")
    assert [(p["title"], p["kind"], p["body"]) for p in parts] == [("", "introduction", "Before"), ("Summary of it", "summary", "body"), ("Open gaps", "gaps", "- a")]
    row = spark.createDataFrame([("The crew shall rest within 12 hours, unless the commander agrees.",)], "t string").select(*T.slots(F.col("t"))).first()
    assert (row["subject"], row["action"], row["exception"], row["deadline"]) == ("crew", "rest within 12 hours", "the commander agrees", "12 hours")
    assert one(spark, T.safe_file_name(F.col("t")), t="a%20b:c?.pdf") == "a b_c_.pdf" and one(spark, T.safe_file_name(F.col("t")), t="con.txt") == "_con.txt"
    counts = spark.createDataFrame([("a͸\u0001é Ã©",)], "t string").select(*(c.alias(n) for n, c in T.damage_counts(F.col("t")).items())).first()
    assert (counts["n_unassigned"], counts["n_suspicious"], counts["n_mojibake"]) == (1, 2, 1)


@pytest.mark.parametrize("module", ["acts", "catalog", "marks", "records", "retrieval", "search", "sequence", "text", "workflow"])
def test_every_module_has_queries(module):
    import importlib

    assert importlib.import_module(f"quarry.queries.{module}").QUERIES


def test_library_plans(spark):
    from quarry.plans import library

    docs = spark.createDataFrame([("a", "Crew rest", "eu", "general", "2020", "32012R0965", None), ("b", "Flight crew", "easa", "ansp", None, None, "1/2"), ("c", "No chunks", "eu", "general", None, None, None)], "doc_id string, title string, origin string, stakeholder string, date string, celex string, doc_number string")
    chunks = spark.createDataFrame([("a", "a:0", 0, "one", None), ("a", "a:1", 1, "two", [1.0, 0.0]), ("b", "b:0", 0, "three", [0.0, 2.0])], "doc_id string, chunk_id string, seq int, text string, embedding array<double>")
    qualifiers = spark.createDataFrame([("q1", "x", "32012R0965", "", "long text"), ("q2", "1/2", None, "", None)], "qualifier_id string, parent_id string, celex string, target_ref string, text string")
    page = library.catalog_page(docs, chunks, qualifiers, "crew", sort_by="title", descending=False).collect()
    assert [(r["doc_id"], r["chunk_count"], r["qualifier_count"], r["total"], r["filtered"]) for r in page] == [("a", 2, 1, 2, 2), ("b", 1, 1, 2, 2)]
    assert [r["doc_id"] for r in library.catalog_page(docs, chunks, origin="easa", stakeholder="ANSP").collect()] == ["b"]
    got = {r["doc_id"]: tuple(r)[1:] for r in library.batch(spark.createDataFrame([("a",), ("z",)], "doc_id string"), docs, chunks).collect()}
    assert got == {"a": ("Crew rest", "eu", 2, "one\n\ntwo"), "z": ("z", "eu", 0, "")}
    assert library.qualifiers_page(qualifiers, {"id": "a", "celex": "32012R0965", "number": None}, 4).first()["preview"] == "long..."
    assert library.reading_words("What about crew rest with rest", "Flight time") == ["crew", "rest", "flight", "time"] and library.reading_words("of") == library.DEFAULT_WORDS
    scores = [(r["doc_id"], r["seq"], r["score"]) for r in library.section_scores(chunks, spark.createDataFrame([([1.0, 0.0],)], "embedding array<double>")).collect()]
    assert scores == [("a", 1, 1.0), ("a", 0, 0.0), ("b", 0, 0.0)]
    shelf = spark.createDataFrame([("a:0", "a", '{"category": "Fatigue", "author": "Ann Lee", "date": "2021"}'), ("b:0", "b", '{"category": "Other"}')], "chunk_id string, doc_id string, metadata string")
    hits = spark.createDataFrame([("a:0", -2.0), ("b:0", -3.0)], "chunk_id string, score double")
    assert [tuple(r) for r in library.bookshelf(shelf, hits, "fatigue", "lee").collect()] == [("a:0", "a", "Fatigue", "2021", 2.0)]
    turns = spark.createDataFrame([(k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(11)], "turn int, role string, text string")
    context = library.question_context(chunks, spark.createDataFrame([("a:0", 1)], "chunk_id string, rank int"), turns)
    assert [r["turn"] for r in context["history"].collect()] == list(range(2, 10)) and context["blocks"].first()["block"] == "[1] a:0\none\ntwo"
    told = library.context_summary(chunks, spark.createDataFrame([("a:1", 1)], "chunk_id string, rank int"), "why?", lambda p: p[-3:]).first()
    assert told["summary"] == "two" and told["prompt"].startswith("Question: why?")
    note, parts = library.new_note(spark, "My note!", [{"title": "A", "text": "x"}], "P", ("t",))
    assert note.first()["document_id"] == "NOTE_My_note" and '"origin":"note"' in note.first()["metadata"] and parts.count() == 1
    sections = spark.createDataFrame([("s1", False), ("s2", True)], "section_id string, enabled boolean")
    both = library.with_section(sections, spark.createDataFrame([("s1", True), ("s3", True)], "section_id string, enabled boolean"))
    assert sorted(tuple(r) for r in both.collect()) == [("s1", True), ("s2", True), ("s3", True)]
    odd = spark.createDataFrame([(" x ", "{bad", ["a ", "", None]), (None, "{}", None)], "t string, j string, p array<string>")
    assert [tuple(r) for r in library.cleaned(odd, ["t"], ["j"], ["p"]).collect()] == [("x", None, ["a"]), ("", "{}", [])]
    assert {r["id"]: r["text"] for r in library.act_texts(docs, chunks, 1).collect()} == {"a": "Crew rest\none", "b": "Flight crew\nthree", "c": "No chunks"}
    made = library.ingested(spark.createDataFrame([("/p/x/b.xml", "ACT", "Regulation (EU) No 965/2012 on crews", "T", None), ("/p/x/c_annex.xml", "ANNEX", "Annex", "A", None), ("/p/y/d.xml", "ACT", "Directive 2004/36/EC on fish", "F", None), ("/p/z/e.xml", None, None, None, "bad")], "path string, root string, title string, text string, error string"), spark.createDataFrame([("32012R0965", "old", "old", 0), ("kept", "k", "k", 0)], "doc_id string, title string, text string, annex_count long"), ["crews?"])
    assert sorted((r["doc_id"], r["text"], r["annex_count"]) for r in made["documents"].collect()) == [("32012R0965", "T\n\nA", 1), ("kept", "k", 0)]
    m = made["metrics"].first()
    assert (m["scanned"], m["core"], m["annexes"], m["filtered"], m["failed"]) == (2, 1, 1, 1, 1)


def test_headers_blocks_and_contents(spark):
    rows = spark.createDataFrame([("a", "Regulation (EU) 2018/1139 repealing Regulations (EC) No 216/2008 and (EU) No 1/2011", "It shall apply until 3 May 2020. Crew", None), ("b", None, None, "bad")], "path string, title string, header string, error string")
    got = {r["path"]: r for r in packages.inspected(rows, ["crew"], 2026).collect()}
    a = got["a"]
    assert (a["doc_number"], a["expires"], a["repeals"], a["keywords"], a["state"]) == ("2018/1139", "3 May 2020", ["216/2008", "1/2011"], ["crew"], "EXPIRED (3 May 2020)")
    assert got["b"]["state"] == "CORRUPTED" and got["b"]["repeals"] is None
    nodes = spark.createDataFrame([("d", 2, 1, "text", "b"), ("d", 1, 0, "section", "x"), ("d", 3, 1, "note", "c"), ("d", 4, 1, "text", " ")], "doc_id string, node_id int, parent_id int, type string, text string")
    assert [tuple(r) for r in trees.body_blocks(nodes).collect()] == [("d", 1, ["b", "c"])]
    items, contents = spark.createDataFrame([("1", "x"), ("2", "y")], "sdt_id string, text string"), spark.createDataFrame([("1", "T", "CS 1", 0)], "sdt_id string, title string, number string, ord int")
    assert [tuple(r) for r in trees.with_contents(items, contents).collect()] == [("1", "x", "T", "CS 1", 0)]
