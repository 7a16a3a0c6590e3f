"""Keyed state, index segments, snapshots and published volumes."""

import math
import random
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import index, records
from quarry.operators.lexical import Expression
from quarry.operators.segments import Segments
from quarry.plans import publishing
from quarry.sources.snapshots import Conflict, Snapshots
from quarry.streaming import incremental, keyed

EVENT = "key string, s long, seq long, status string, progress string, error string"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")


def final(rows, patience, last):
    """Status, progress, error, attempts and overdue times of each job after all rows, at a watermark."""
    out = {}
    for key, s, _, status, progress, error in sorted(rows, key=lambda r: (r[1], r[2])):
        x = out.setdefault(key, [None, None, None, 0, 0, 0])
        if x[0] in keyed.WAITING and s - x[5] > patience:
            x[0], x[2], x[4] = "FAILED", keyed.INTERRUPTED, x[4] + 1
        if status:
            x[3] += status == "RUNNING" and x[0] != "RUNNING"
            x[0], x[2] = status, error if status == "FAILED" else None
        x[1], x[5] = progress or x[1], s
    for x in out.values():
        if x[0] in keyed.WAITING and x[5] + patience < last:
            x[0], x[2], x[4] = "FAILED", keyed.INTERRUPTED, x[4] + 1
    return {k: tuple(x[:5]) for k, x in out.items()}


def test_jobs_by_stream_with_timers_and_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"j{rng.randrange(9)}", s, s, rng.choice(["PENDING", "RUNNING", "RUNNING", "COMPLETED", "FAILED", None]), rng.choice([None, f"p{s}"]), rng.choice([None, "broken"])) for s in range(0, 4000, 40)]
    rows += [("quiet", 100, 9, "RUNNING", None, None)]
    frame = events(spark, rows)
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")

    def go():
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
        keyed.job_states(stream, out, checkpoint, 300, "0 seconds").awaitTermination()
        return {r["key"]: (r["status"], r["progress"], r["error"], r["attempts"], r["overdue"]) for r in keyed.latest(spark, out, keyed.JOBS).collect()}

    for bounds in ((0, 1500), (1500, 2600), (2600, 9999)):  # each run starts anew from the checkpoint
        frame.where((F.col("ts") >= F.timestamp_seconds(F.lit(1_700_000_000 + bounds[0]))) & (F.col("ts") < F.timestamp_seconds(F.lit(1_700_000_000 + bounds[1])))).coalesce(1).write.mode("append").parquet(source)
        got = go()
        so_far = [r for r in rows if r[1] < bounds[1]]
        assert got == final(so_far, 300, max(r[1] for r in so_far))
    assert got["quiet"] == ("FAILED", None, keyed.INTERRUPTED, 1, 1)
    assert go() == got  # nothing new, nothing changes


def test_pacing_by_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"h{rng.randrange(3)}", s, s, rng.choice([False] * 40 + [True, None])) for s in range(600)]
    frame = spark.createDataFrame(rows, "key string, s long, seq long, challenged boolean").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for low in (0, 200, 400):
        frame.where(f"seq >= {low} and seq < {low + 200}").coalesce(1).write.mode("append").parquet(source)
        keyed.paces(spark.readStream.schema(frame.schema).parquet(source), out, checkpoint).awaitTermination()
    got = {r["key"]: r for r in keyed.with_rate(keyed.latest(spark, out, keyed.PACING)).collect()}
    expected = {r["host"]: (r["delay"], r["streak"]) for r in records.request_delays(frame.withColumnRenamed("key", "host")).collect()}
    for key, (delay, streak) in expected.items():
        mine = [bool(c) for k, *_, c in rows if k == key]
        assert math.isclose(got[key]["delay"], delay) and got[key]["streak"] == streak
        assert (got[key]["requests"], got[key]["challenges"]) == (len(mine), sum(mine)) and got[key]["rate"] == round(sum(mine[-50:]) / len(mine[-50:]), 4)


WORDS = "rest duty crew flight limit rested".split()


def made(seed, ids):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))), rng.choice([None, "Crew rest", "duty"])) for i in ids]


def scores(frame):
    return {r["key"]: (r["matched"], round(r["score"], 9)) for r in frame.collect()}


@pytest.mark.parametrize("stemmed", [True])
def test_segments_score_like_a_rebuild(spark, tmp_path, stemmed):
    schema, columns = "id long, text string, title string", {"text": "text", "title": "title"}
    frame = lambda rows: spark.createDataFrame(rows, schema)
    asked = Expression(phrases=[["flight", "duty"]], any_of=["rest", "crew"], all_of=["rest", "crew"])
    weights = {"title": 3.0}
    segments = Segments(spark, str(tmp_path / "segments"), columns, stemmed=stemmed, buckets=4)
    live: dict = {}
    with pytest.raises(ValueError):
        segments.search(asked)

    def same(name):
        index.build(frame([(k, *v) for k, v in live.items()]), "id", columns, str(tmp_path / name), stemmed=stemmed, buckets=4)
        expected = scores(index.search(spark, str(tmp_path / name), asked, weights))
        assert scores(segments.search(asked, weights)) == expected and len(expected) > 3
        assert {r["key"]: 1 for r in segments.live_rows().collect()} == dict.fromkeys(live, 1)

    def add(rows):
        segments.add(frame(rows + [(None, "rest", None)]), "id")
        live.update({i: (t, h) for i, t, h in rows})

    def delete(ids):
        segments.delete(spark.createDataFrame([(i,) for i in ids] + [(None,)], "key long"))
        for i in ids:
            live.pop(i, None)

    add(made(1, range(20)))
    same("a")
    before = segments.store.versions()[-1]
    add(made(2, range(15, 30)))  # five come again with other texts
    delete([0, 3, 29, 77])
    same("b")
    add(made(3, [3, 40]))  # a deleted one comes back
    same("c")
    segments.merge(upto=2)
    same("d")
    delete([40, 5])
    add([(50, None, None)])
    same("e")
    assert Segments(spark, str(tmp_path / "segments")).merge() > 0
    same("f")
    assert len(segments.store.pointer()["tables"]["postings"]["folders"]) == 1
    assert 0 in scores(segments.search(Expression(any_of=WORDS), version=before)) or live  # old versions can still be read


def test_segments_write_postings_where_rows_lie(spark, tmp_path, monkeypatch):
    """No postings are shuffled or sorted, by an addition or a merge, however many rows are hidden; and what was written on the way is gone."""
    plans, publish, shared = [], Snapshots.publish, tmp_path / "shared"

    def seen(self, tables, **how):
        if "postings" in tables:
            plans.append(tables["postings"]._jdf.queryExecution().executedPlan().toString())
        return publish(self, tables, **how)

    monkeypatch.setattr(Snapshots, "publish", seen)
    monkeypatch.setattr("quarry.operators.segments.new_path", lambda spark, name: f"file://{shared}/{name}-{uuid.uuid4().hex}", raising=False)
    segments = Segments(spark, str(tmp_path / "segments"))
    rows = spark.range(70_000).select(F.col("id"), F.concat(F.lit("all n"), F.col("id") % 7).alias("text"))
    segments.add(rows.union(rows.where("id % 1000 = 5")), "id")  # of equal keys one counts
    first = segments.store.versions()[-1]
    assert segments.merge() == first  # one segment, nothing hidden
    segments.add(rows.where("id % 5 = 0").withColumn("text", F.lit("all anew")), "id")
    segments.delete(rows.where("id % 3 = 0"), "id")
    live = [k for k in range(70_000) if k % 3]

    def right():
        assert sorted(r["key"] for r in segments.live_rows().collect()) == live
        assert sorted(r["key"] for r in segments.search(Expression(any_of=["n2"])).collect()) == [k for k in live if k % 7 == 2 and k % 5]

    right()
    with monkeypatch.context() as m:
        m.setattr("quarry.operators.segments.BROADCAST_BITMAPS", -1, raising=False)
        right()
    segments.merge()
    right()
    assert shared.exists() and list(shared.iterdir()) == []
    # What is dealt out or sorted are bitmaps on their way to a broadcast.
    moved = [line for p in plans for line in p.replace("BroadcastExchange", "").splitlines() if "Exchange" in line or "Sort " in line or "SortMerge" in line]
    assert len(plans) == 3 and all("seg#" in line for line in moved), moved


@pytest.mark.parametrize("tokens", [1, 4, 1_000])
def test_runs_hold_every_posting(tokens, monkeypatch):
    monkeypatch.setattr(index, "RUN_TOKENS", tokens)
    monkeypatch.setattr(index, "HITS", 2)
    texts = [["b", "a", "b"], [], ["c"], ["a", "a"], [], ["rests", "b"]]
    batch = lambda at, rows: pa.RecordBatch.from_pydict({"key": [f"k{at + k}" for k in range(len(rows))], "len": pa.array([len(r) for r in rows], pa.int32()), "row": pa.array([at + k for k in range(len(rows))], pa.int64()), "t": pa.array(rows, pa.list_(pa.string()))})
    got = [r for b in index._in_runs(["t"], True)(iter([batch(0, texts[:2]), batch(2, texts[2:2]), batch(2, texts[2:])])) for r in b.to_pylist()]
    want = [(w, k, [p for p, x in enumerate(t) if x == w]) for k, t in enumerate(texts) for w in set(t)]
    assert sorted((r["term"], r["row"], r["positions"]) for r in got) == sorted(("rest" if w == "rests" else w, k, p) for w, k, p in want)
    assert all(r["key"] == f"k{r['row']}" and r["len"] == len(texts[r["row"]]) and r["col"] == "t" for r in got)
    if tokens == 1_000:
        assert [r["term"] for r in got] == sorted(r["term"] for r in got)


def test_stream_adds_segments_once(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string"
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    parts = [[(k, f"word{k} common\nsecond common", "en", "s") for k in range(4)], [(2, "common alone", "en", "s"), (7, "other words", None, None)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.index_segments(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "check")).awaitTermination()
    segments = Segments(spark, path)
    got = scores(segments.search(Expression(any_of=["common"])))
    assert sorted(got) == ["0:1", "0:2", "1:1", "1:2", "2:1", "3:1", "3:2"]
    version = segments.store.versions()[-1]
    again = spark.createDataFrame([("x", "common")], "chunk_id string, text string")
    assert segments.add(again, "chunk_id", note={"stream": str(tmp_path / "check"), "batch": 1}) == version  # a repeated batch


DOCS, CHUNKS = "document_id string, title string", "document_id string, chunk_id string, text string"


def volume(spark, version):
    docs = spark.createDataFrame([("a", f"A{version}"), ("b", f"B{version}"), (None, "x")], DOCS)
    chunks = spark.createDataFrame([("a", f"a{k}", f"v{version}") for k in range(version)] + [("b", "b0", f"v{version}"), ("zz", "z", "not in documents")], CHUNKS)
    return docs, chunks


def test_documents_and_chunks_are_published_as_one(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert store.versions() == [] and publishing.replace_documents(store, *volume(spark, 3)) == 1
    state = lambda v=None: (sorted(r["title"] for r in store.read("documents", v).collect()), sorted(r["chunk_id"] for r in store.read("chunks", v).collect()))
    assert state() == (["A3", "B3"], ["a0", "a1", "a2", "b0"])
    # The second of the two tables fails while it is written: both stay as they were.
    docs, chunks = volume(spark, 2)
    broken = chunks.withColumn("text", F.when(F.col("chunk_id") == "b0", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        publishing.replace_documents(store, docs, broken)
    assert store.versions() == [1] and state() == (["A3", "B3"], ["a0", "a1", "a2", "b0"])
    assert publishing.replace_documents(store, docs.where("document_id = 'a'"), chunks) == 2
    assert state() == (["A2", "B3"], ["a0", "a1", "b0"]) and state(1)[0] == ["A3", "B3"]
    publishing.delete_documents(store, spark.createDataFrame([("b",), ("none",)], "document_id string"))
    assert state() == (["A2"], ["a0", "a1"])
    assert store.vacuum(keep=1) > 0 and state() == (["A2"], ["a0", "a1"]) and store.versions() == [3]


def test_a_second_writer_does_not_overwrite_the_first(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    one = spark.createDataFrame([(1,)], "x int")
    base = store.pointer()
    store.publish({"t": one}, base=base)
    with pytest.raises(Conflict):
        store.publish({"t": one.where("x = 2")}, base=base)
    assert store.read("t").count() == 1 and store.names() == ["t"]
    store.publish({"t": one.where("x = 2")})
    assert store.read("t").count() == 0 and store.read("t").columns == ["x"]
    store.publish({"t": one}, append=("t",), notes={"k": 1})
    assert store.read("t").count() == 1 and store.pointer()["notes"] == {"k": 1}
    with pytest.raises(KeyError):
        store.read("none")


def test_volumes_of_parts(spark):
    rows = [("v1", "Part_1", 1, "Scope", "all of it", "Part_1:s"), ("v1", "Part_1", 2, "Empty", "  ", "Part_1:e"), ("v2", "Part_2", 1, None, "more text here", "Part_1:s")]
    docs, chunks = publishing.volume_tables(spark.createDataFrame(rows, "path string, document_id string, seq int, title string, text string, chunk_id string"), "faa", "us")
    got = {r["document_id"]: (r["sections"], r["n_chunks"], r["n_words"], r["title"]) for r in docs.collect()}
    assert got == {"Part_1": (2, 1, 3, "Part 1"), "Part_2": (1, 1, 3, "Part 2")}
    assert len({r["chunk_id"] for r in chunks.collect()}) == 2 and {r["embedding_text"] for r in chunks.collect()} == {"Scope\nall of it", "more text here"}
