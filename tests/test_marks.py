"""Hand-worked cases for marked-up text, lookups, documents and datasets."""

from pyspark.sql import functions as F

from quarry.functions import marks as M
from quarry.functions import text as T
from quarry.operators import lookup
from quarry.plans import dataset, documents


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


def test_citations(spark):
    text = "See <chunk:a:1> and (chunk: b (old):2) and <chunk:a:1>, (chunk:c:3)."
    assert one(spark, text, M.cited_ids) == ["a:1", "b (old):2", "c:3"]


def test_json_in_prose(spark):
    assert one(spark, 'so ```json\n{"a": 1}\n``` ok', M.json_in) == '{"a": 1}'
    assert one(spark, 'so [{"a": 1}] ok', M.json_in) == '[{"a": 1}]'
    assert one(spark, "no {json here", M.json_in) is None


def test_sections_keep_empty_ones(spark):
    text = '<!-- SECTION_BREAK {"id":"1"} -->\nOne two\n<!-- SECTION_BREAK {"id":"2"} -->\n'
    assert [(r["meta"], r["body"], r["words"]) for r in one(spark, text, M.sections)] == [('{"id":"1"}', "One two", 2), ('{"id":"2"}', "", 0)]


def test_lists_references_and_topics(spark):
    assert one(spark, "Text\nFollow-ups:\n- What is rest?\n2) no\n* How long is duty?", M.follow_ups) == ["What is rest?", "How long is duty?"]
    assert one(spark, "As AMC1 CS-23.1(a) and CS 25.3 say, CS-25.3 too", M.cross_references) == ["AMC1 CS-23.1(A)", "CS-25.3"]
    assert one(spark, "AMC1 to Article 5", M.topic_type) == "amc" and one(spark, "Annex I", M.topic_type) == "requirement" and one(spark, "Foreword", M.topic_type) == "section"
    assert one(spark, "np", M.level) == "POINT" and one(spark, "zzz", M.level) == "OTHER"
    assert [one(spark, x, M.label_kind) for x in ("(1)", "(iv)", "(b)", "(B)")] == ["num", "roman", "alpha", "ualpha"]
    assert one(spark, "This is not covered by the sources. Fine.", M.gaps) == ["This is not covered by the sources"]


def test_markdown_rows(spark):
    rows = spark.createDataFrame([([["a", "b"], ["1", "2"]],)], "r array<array<string>>").select(M.markdown_rows(F.col("r")).alias("x"))
    assert rows.first()["x"] == "| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_act_numbers(spark):
    got = spark.createDataFrame([("Regulation (EU) 2018/1139",), ("Regulation (EEC) No 3922/91",)], "t string").select(T.act_number(F.col("t")).alias("a")).select("a.*", T.celex(F.col("a.letter"), F.col("a.year"), F.col("a.number")).alias("id")).collect()
    assert [tuple(r) for r in got] == [("R", 2018, 1139, "32018R1139"), ("R", 1991, 3922, "31991R3922")]


def test_designations_fall_back_to_the_base(spark):
    known = spark.createDataFrame([(1, "CS-23.1"), (2, "AMC1 CS 25")], "id int, name string")
    names = spark.createDataFrame([("cs-23.1(a)(1)",), ("AMC1 CS 25",), ("none",)], "name string")
    assert {r["name"]: r["id"] for r in lookup.by_designation(names, known).collect()} == {"cs-23.1(a)(1)": 1, "AMC1 CS 25": 2, "none": None}


def test_manual_document_and_context(spark):
    sections = [{"section_number": "1.1", "title": "Scope", "text": "Rest applies."}, {"section_number": "1.1", "title": "Again", "text": "Duty applies."}]
    doc, chunks = documents.manual_document(spark, "My rules", sections, document_id="My rules!")
    got = chunks.orderBy("seq").collect()
    assert doc.first()["chunk_count"] == 2 and [r["chunk_id"] for r in got] == ["My_rules:sec_1_1", "My_rules:sec_1_1_dup1"]
    assert got[0]["previous_chunk_id"] is None and got[0]["next_chunk_id"] == got[1]["chunk_id"]
    assert got[0]["embedding_text"] == "Title: My rules\nSection: 1.1 Scope\nRest applies."
    hits = spark.createDataFrame([(got[0]["chunk_id"], 1)], "chunk_id string, rank int")
    assert documents.context_blocks(chunks, hits).first()["block"] == "[1] My_rules:sec_1_1\nRest applies.\nDuty applies."


def test_split_sizes_and_stable_ids(spark):
    docs = spark.range(97).withColumnRenamed("id", "doc_id")
    split = dataset.split_documents(docs, "doc_id")
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 77, "val": 10, "test": 10}
    chunks = docs.select("doc_id", F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.lit("t").alias("text"))
    made = dataset.examples(chunks.union(chunks), {"q": (F.lit("p"), F.col("text")), "none": (F.lit("p"), F.lit(" "))}, split, "doc_id")
    assert made.count() == 97


def test_tables_on_disk(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_bucket int, text string")
    documents.replace_documents(rows, path)
    documents.replace_documents(spark.createDataFrame([(2, "c")], "doc_bucket int, text string"), path)
    assert sorted((r["doc_bucket"], r["text"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    documents.compact(spark, path, str(tmp_path / "c"), 1)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
