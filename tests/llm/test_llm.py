"""Every operator of the subpackage against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, exact_dedup, jaccard_join, pii, ppm, quality, secrets, suffix_dedup, warc
from quarry.llm.components import connected_components
from quarry.llm.scratch import written

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score double, suspect boolean, n int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def made(seed, n=60, low=1, high=80):
    """Random texts with exact and near copies, nulls, empties, one long text and a repeated row."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))) for _ in range(n)]
    for k in range(0, n - 2, 5):
        words = texts[k].split()
        words[rng.randrange(len(words))] = "changed"
        texts[k + 1] = " ".join(words) if k % 2 else texts[k]
        texts[k + 2] = texts[k] + "  \n" if k % 3 else texts[k + 2]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \t\n"), (903, "x" * 30_000), (904, " ".join(WORDS * 400)), (None, texts[0]), (5, texts[5])]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", 1.0, True, 1) for i, t in rows], SCHEMA).repartition(parts)


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def empty(spark):
    return frame(spark, [(1, "x")]).where("doc_id = 2")


def test_rice_codes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        values = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(values)) == values).all()


def test_exact_duplicates(spark):
    rows = made(1)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    expected = []
    for bare, members in groups.items():
        keep = min(members)[2]
        expected += [(i, keep, len(members), i == keep, hashlib.sha256(bare.encode()).hexdigest()) for _, _, i in members]
    got = [tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_exact_duplicates_by_shuffle_alone(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", -1)
    rows = made(2)
    sizes = collections.Counter(re.sub(r"\s", "", t or "") for _, t in rows)
    got = collections.Counter(r["group_size"] for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect())
    assert got == collections.Counter(sizes[re.sub(r"\s", "", t or "")] for _, t in rows)


def test_benchmark_hits(spark):
    rows = made(3)
    items = [(1, " ".join(rows[4][1].split()[:14])), (2, "Alpha, BETA"), (3, None), (4, ""), (5, rows[904 and 7][1]), (6, "Éa no such words here at all in any of the texts"), (1, "tau")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    expected = []
    for i, t in rows:
        w, hit, named = split(t), set(), set()
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        expected.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.benchmark_hits(frame(spark, rows), bench).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    none = decontaminate.benchmark_hits(frame(spark, rows), bench.where("item_id = 99"))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)
    assert decontaminate.benchmark_hits(empty(spark), bench).count() == 0


def shingled(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def similar(rows):
    """(class, links) of each row by comparing all pairs of distinct sets."""
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(shingled(t), i)
    sets = [s for s in first if s]
    root = {s: s for s in first}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    links = collections.Counter()
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[sets[a]] += 1
                links[sets[b]] += 1
                root[find(sets[a])] = find(sets[b])
    least = {}
    for s, i in first.items():
        k = find(s)
        least[k] = i if k not in least else min(i, least[k])
    return {(i, least[find(shingled(t))], links[shingled(t)]) for i, t in rows}


@pytest.mark.parametrize("block", [1000, 3])
def test_similar_documents(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    rows = [(i, t) for i, t in made(4, low=30) if i is not None]
    base = [random.Random(9).choice(WORDS) for _ in range(300)]
    for k in range(80):  # a group beyond one bucket
        words = base[:]
        words[3 * k] = f"own{k}"
        rows.append((2000 + k, " ".join(words)))
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.similar_documents(frame(spark, rows)).collect()}
    assert got == similar(rows)


def test_no_plan_holds_all_levels_of_pairs(spark, monkeypatch):
    """Pairs of each level are written: what reads them plans no join of a level, however deep the tree."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    rows = frame(spark, [(k, f"{' '.join(WORDS[:12])} {k}") for k in range(60)]).select(F.col("doc_id").alias("rid"), "text")
    reps = rows.mapInArrow(jaccard_join._embedded(jaccard_join.SIZE), "rid long, set_id binary, n long, bytes long, mins binary")
    pairs = jaccard_join.proposed_pairs(reps)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() > 0


@pytest.mark.parametrize("most", [jaccard_join.CLASS_ROWS, 0])
def test_classes_broadcast_or_shuffled(spark, monkeypatch, most):
    """The table of classes is broadcast up to CLASS_ROWS only, with the same result."""
    rows = made(12)
    want = sorted(map(tuple, jaccard_join.similar_documents(frame(spark, rows)).collect()), key=str)
    monkeypatch.setattr(jaccard_join, "CLASS_ROWS", most)
    out = jaccard_join.similar_documents(frame(spark, rows))
    assert ("broadcast" in out._jdf.queryExecution().optimizedPlan().toString()) == (most > 0)
    assert sorted(map(tuple, out.collect()), key=str) == want


@pytest.mark.parametrize("block", [jaccard_join.BUCKET_BLOCK, 20])
def test_pairs_among_texts_of_one_template(spark, monkeypatch, block):
    """Pairs at the threshold meet among 10,000 texts that share half their words, where buckets stay large."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", block)
    shared, texts = " ".join(f"s{k}" for k in range(64)), []
    for k in range(10_100):
        own = [f"o{k}w{j}" for j in range(64)]
        texts.append(shared + " " + " ".join(own))
        if k < 200:
            texts.append(shared + " " + " ".join(own[:-13] + [f"p{k}w{j}" for j in range(13)]))  # 111 of 137 shingles
    rows = frame(spark, list(enumerate(texts))).select("doc_id", "text")
    reps = rows.mapInArrow(jaccard_join._embedded(jaccard_join.SIZE), "rid long, set_id binary, n long, bytes long, mins binary")
    reps = written(reps.select("rid", "mins"), "reps")
    node = {r["node"]: r["component"] for r in connected_components(jaccard_join.proposed_pairs(reps)).collect()}
    met = sum(2 * k in node and node[2 * k] == node.get(2 * k + 1) for k in range(200))
    assert met >= 194


def test_similar_documents_with_repeated_and_absent_ids(spark):
    """Rows that share a doc_id, or have none, are linked by their own texts, in any order."""
    rng = random.Random(12)
    base = [[rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60)] for _ in range(5)]
    near = [[*b[:-1], "changed"] for b in base]
    rows = [(25, " ".join(base[0])), (25, " ".join(base[1])), (26, " ".join(near[1])), (27, " ".join(near[0]))]
    rows += [(None, " ".join(base[k])) for k in (2, 3, 4)] + [(30 + k, " ".join(near[k])) for k in (2, 3)] + [(None, " ".join(near[4]))]
    for order in (rows, rows[::-1]):
        got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.similar_documents(frame(spark, order)).collect()), key=str)
        expected = [(25, 25, 1), (25, 25, 1), (26, 25, 1), (27, 25, 1), (None, 32, 1), (32, 32, 1), (None, 33, 1), (33, 33, 1), (None, None, 1), (None, None, 1)]
        assert got == sorted(expected, key=str)


def test_similar_documents_of_nothing(spark):
    assert jaccard_join.similar_documents(empty(spark)).count() == 0
    one = jaccard_join.similar_documents(frame(spark, [(1, None), (2, ""), (3, "a b c")])).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in one} == {(1, 1, 0, 2), (2, 1, 0, 2), (3, 3, 0, 1)}


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize(("most", "broadcast"), [(2_000, 1 << 28), (1, 0)])
def test_remove_repeats(spark, monkeypatch, most, broadcast):
    monkeypatch.setattr(suffix_dedup, "RUN_SEGMENTS", most)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", broadcast)
    rows = made(5, 30, 20, 300) + [(990, "ab" * 900), (991, "pre " + "ab" * 300 + " post"), (992, "é" * 300 + "z")]
    passage = " ".join(random.Random(1).choice(WORDS) for _ in range(90))
    rows += [(1000 + k, f"own{k} start {passage} own{k} end") for k in range(6)]
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + 400] for _, b in raw for k in range(len(b) - 399))
    expected = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        n = int(gone.sum())
        expected.append((i, len(b), n, runs, hashlib.sha256(kept).hexdigest(), len(b) - n, n / max(1, len(b)), n > 0))
    got = [tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows))).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [2_000, 1])
def test_shared_passages(spark, monkeypatch, most):
    """Runs of 50 words that another document holds are counted, though most have fewer than 400 bytes and stay."""
    monkeypatch.setattr(suffix_dedup, "RUN_SEGMENTS", most)
    rng = random.Random(31)
    words = lambda n: [f"{rng.choice('abcdefg')}{rng.randrange(900)}" for _ in range(n)]
    passages = [words(n) for n in (49, 50, 51, 57, 80)]
    rows = [(k, " ".join(words(rng.randint(0, 90)) + rng.choice(passages) + words(rng.randint(0, 90)) + rng.choice([[], passages[3]]))) for k in range(60)]
    own = words(60)
    rows += [(100, " ".join(own + words(5) + own)), (101, " ".join(words(300))), (102, None), (103, " ".join(words(12))), (None, "\n\t".join(passages[2]) + " ")]
    rows += [(104, " ".join(own[:20])), (105, text := " ".join(words(70))), (106, text), (106, text), (106, " ".join(words(55)))]
    split = [(t or "").split() for _, t in rows]
    holders = collections.defaultdict(set)
    for i, w in enumerate(split):
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    expected = []
    for (doc_id, text), w in zip(rows, split):
        hit = {j for k in range(len(w) - 49) if len(holders[tuple(w[k : k + 50])]) > 1 for j in range(k, k + 50)}
        expected.append((doc_id, len((text or "").encode()), len(hit)))
    out = suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows), passages=True))
    got = [(r["doc_id"], r["n_bytes"], r["n_shared_words"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    short = {r["doc_id"] for r in out.collect() if r["n_shared_words"] and not r["n_removed"]}
    assert len(short) > 20 and 101 not in short


def test_shared_passages_are_not_exploded(spark, monkeypatch):
    """Windows of frequent grams travel packed, not as a row each; a row names each of its grams once."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "RUN_SEGMENTS", 1)
    rng = random.Random(8)
    passage = [f"w{rng.randrange(9_000)}" for _ in range(80)]
    rows = frame(spark, [(k, " ".join([f"own{k}", *passage, f"end{k}"])) for k in range(30)])
    out = suffix_dedup.shared_passages(rows.selectExpr("cast(doc_id as long) doc_id", "text"))
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["doc_id"], r["shared"]) for r in out.collect()} == {(k, 80) for k in range(30)}
    row = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(passage * 20)]})
    grams = [g for b in suffix_dedup._shared_grams([row]) for g in b.column(0).to_pylist()]
    assert grams and len(grams) == len(set(grams))


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(30):
        text = np.frombuffer("".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode(), np.uint8)
        got = suffix_dedup.suffix_order(text, np.ones(len(text), bool), depth=100)
        assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())


def test_warc_round_trip(spark):
    html = "<html>" + "é body " * 30 + "</html>"
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate([html, "short", None, "", html, "short", html + "x", html])] + [(4, "http://again", html), (0, "http://first again", html), (None, "http://null", html)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    expected = []
    for i, _, t in rows:
        b = (t or "").encode()
        revisit = b == html.encode() and i != 0
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", 0 if revisit else None))
    got = [tuple(r) for r in warc.round_trip(spark, pages).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert warc.round_trip(spark, pages.where("page_id = 77")).count() == 0


def test_zip_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("a/b", "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr("c", "second")
    raw = out.getvalue()
    members = warc.zip_members(lambda at, n: raw[at : at + n], len(raw))
    assert {k: raw[a : a + n] for k, (a, n, _) in members.items()} == {"a/b": b"hello", "c": b"second"}
    # A directory whose end record defers to ZIP64.
    end = raw.rfind(b"PK\x05\x06")
    n, size, start = int.from_bytes(raw[end + 10 : end + 12], "little"), int.from_bytes(raw[end + 12 : end + 16], "little"), int.from_bytes(raw[end + 16 : end + 20], "little")
    q = lambda x: x.to_bytes(8, "little")
    big = b"PK\x06\x06" + q(44) + bytes(4) + bytes(8) + q(n) + q(n) + q(size) + q(start)
    raw = raw[:end] + big + b"PK\x06\x07" + bytes(4) + q(end) + (1).to_bytes(4, "little") + b"PK\x05\x06" + bytes(4) + b"\xff" * 12 + bytes(2)
    assert set(warc.zip_members(lambda at, n: raw[at : at + n], len(raw))) == {"a/b", "c"}


@pytest.fixture(scope="module")
def ranks(spark):
    import public_tokenizers

    return bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("most", [bpe.TABLE_WORDS, 40, 0])
def test_bpe_as_the_library(spark, ranks, monkeypatch, most):
    """Ids do not depend on how many words the table holds."""
    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(bpe, "TABLE_WORDS", most)
    monkeypatch.setattr(bpe, "HELD", 30)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "é", "9", "²", "№", "!", "...", " the", "ii", "漢", "\U0001f600", "\r\n", " \n ", " ", "x" * 450, "<|endoftext|>"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(400)] + made(6)
    got = bpe.encode_and_decode(frame(spark, rows), ranks, public_tokenizers.PATTERN).collect()
    expected = sorted(((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got), key=str) == expected
    assert bpe.encode_and_decode(empty(spark), ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_tables_are_not_listed(spark, ranks):
    """No listing of a plan that the driver keeps holds the tables of ranks, and no row carries them."""
    import public_tokenizers

    out = bpe.encode_and_decode(frame(spark, [(1, "alpha beta")]), ranks, public_tokenizers.PATTERN)
    planned = out._jdf.queryExecution().optimizedPlan()
    listed = [planned.apply(k).simpleString(25) for k in range(3)]
    assert sum(map(len, listed)) < 50_000
    assert any("subquery" in x for x in listed) and not any("AS pairs" in x for x in listed)


def test_bpe_of_another_pattern(spark, ranks):
    """Other patterns go through the regex library; what no match covers is dropped, as the library does."""
    import tiktoken

    pattern = r"[a-z]+| [a-z]+|[0-9]{1,3}"
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "alpha beta 12345, é x"), (2, ""), (3, None), (4, "É"), (5, "abc" * 40 + " z")]
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in bpe.encode_and_decode(frame(spark, rows), ranks, pattern).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in rows}


def test_split_of_the_fixed_pattern():
    """Matches cut from bytes are those of the regex library, for any mix of classes, apostrophes and white space."""
    import public_tokenizers
    import regex

    assert public_tokenizers.PATTERN == bpe.PATTERN
    find, rng = regex.compile(bpe.PATTERN).findall, random.Random(3)
    parts = list("ab'sdtmrvel  \n\t\r 12!?.é") + ["\u00a0", "\u3000", "日", "\u0663", "''", "\x1c", "\x85", "\u2028", "\u200b", "\U0001f600"]
    for _ in range(1_000):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 5))]
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        expected = np.cumsum([0] + [len(w.encode()) for t in texts for w in find(t)])[:-1].tolist()
        assert (bpe._starts(data, np.cumsum([0] + [len(r) for r in raw])).tolist() if len(data) else []) == expected


def test_long_words_merge_alike(ranks):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    for _ in range(50):
        word = "".join(rng.choice("abcdehtné'1") for _ in range(rng.randint(1, 700)))
        assert bpe.heap_merge(word.encode(), ranks) == library.encode_ordinary(word)


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_quality_of_odd_rows(spark):
    docs = frame(spark, made(7)).withColumn("quality_score", F.lit("clash"))
    assert quality.scored(docs.drop("quality_score"), None, "score_2").where("score_2 = 0.5").count() == docs.count()
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (8, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.quality_scores(docs, labels.where("doc_id = 77")).collect()} == {0.5}
    assert quality.quality_scores(empty(spark), labels).count() == 0


def test_quality_gradients():
    rng = np.random.default_rng(1)
    model = {"E": rng.normal(size=(quality.FEATURES, 5)) * 0.2, "e": rng.normal(size=5), "V": rng.normal(size=(5, 3)), "U": rng.normal(size=(5, 3)), "w": rng.normal(size=3), "c": rng.normal(size=5), "b": np.array(0.1)}
    bags, y = quality.Bags(rng.normal(size=(7, quality.FEATURES)), np.array([0, 3, 7])), np.array([1.0, 0.0])
    loss = lambda m: float(np.mean(-y * np.log(quality.forward(m, bags)["p"]) - (1 - y) * np.log(1 - quality.forward(m, bags)["p"])) + sum(5e-5 * (v**2).sum() for v in m.values()))
    grad = quality.gradients(model, bags, y)
    for k in model:
        at = tuple(0 for _ in model[k].shape)
        up, down = ({n: v.copy() for n, v in model.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert math.isclose((loss(up) - loss(down)) / 2e-5, grad[k][at], rel_tol=1e-3, abs_tol=1e-6)


def test_language_scores(spark):
    rows = [(i, t) for i, t in made(8)]
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0
    count = collections.Counter()
    for i, t in rows:
        if not held(i):
            count.update([*(t or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    got = sorted(ppm.language_scores(frame(spark, rows)).collect(), key=lambda r: str((r["doc_id"], r["n_tokens"])))
    for (i, t), r in zip(sorted(rows, key=lambda r: str((r[0], len((r[1] or "").split()) + 1))), got):
        words = [*(t or "").encode().lower().split(), None]
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["train_tokens"]) == (i, held(i), len(words), n)
        assert r["n_known"] == sum(count[w] > 0 for w in words)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel_tol=1e-9)
    assert ppm.language_scores(empty(spark)).count() == 0


def test_ppm_chances_add_up():
    """After any context, seen or not, the chances of the 256 symbols add up to one, also by the plain recursion."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd") for _ in range(60)) for _ in range(5)]
    grams, _ = ppm.grams_of(pa.array(texts))
    counts = {k: ppm._tally(grams & ppm._mask(k + 1)) for k in range(ppm.ORDER + 1)}
    trie = ppm.Trie(counts)
    tables = {k: collections.defaultdict(dict) for k in counts}
    for k, (values, times) in counts.items():
        for g, n in zip(values.tolist(), times.tolist()):
            tables[k][g >> 8][g & 255] = n

    def chance(context, symbol):
        p, gone = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            here = {s: n for s, n in tables[k].get(context & ((1 << (8 * k)) - 1), {}).items() if s not in gone}
            if not here:
                continue
            bottom = sum(here.values()) + len(here)
            if symbol in here:
                return p * here[symbol] / bottom
            p, gone = p * len(here) / bottom, gone | set(here)
        return p / (256 - len(gone))

    for context in (int.from_bytes(b"abcda"[: ppm.ORDER], "big"), int.from_bytes(b"zzzza"[: ppm.ORDER], "big"), int.from_bytes(b"zzzzz"[: ppm.ORDER], "big")):
        every = np.array([context << 8 | s for s in range(256)], np.uint64)
        got = trie.score(every)
        assert math.isclose((10.0**got).sum(), 1, rel_tol=1e-5)
        assert np.allclose(got, [math.log10(chance(context, s)) for s in range(256)], atol=1e-5)


@pytest.mark.parametrize("most", [ppm.MODEL_GRAMS, 7, 0])
def test_ppm_scores_do_not_depend_on_the_cache(spark, monkeypatch, most):
    """Scores follow from the counts of all training grams, also of those that the broadcast does not hold."""
    monkeypatch.setattr(ppm, "MODEL_GRAMS", most)
    monkeypatch.setattr(ppm, "PART_GRAMS", 300)
    rows = made(11, 40) + [(2000 + k, f"Zoë {k} wrote über {k * k}") for k in range(40)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    assert any(held(i) for i, _ in rows)
    grams, _ = ppm.grams_of(pa.array([t or "" for i, t in rows if not held(i)]))
    trie = ppm.Trie({k: ppm._tally(grams & ppm._mask(k + 1)) for k in range(ppm.ORDER + 1)})
    expected = [(str(i), float(trie.score(ppm.grams_of(pa.array([t or ""]))[0]).sum())) for i, t in rows]
    got = [(str(r["doc_id"]), r["score"]) for r in ppm.language_scores(frame(spark, rows)).collect()]
    for a, b in zip(sorted(expected), sorted(got), strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9), (a, b)


def test_personal_data(spark):
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in hit.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    rng = random.Random(6)
    parts = ["a@b.com", "_x", "1.2.3.4", ".5", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "-1", " 7", "+1 (017) 555-7713", "+", "é", " ", "  ", "\n", "@", "x.y-z", "4952935900253052", "5", "-", "."]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(400)] + [(900, None), (901, ""), (902, "a" * 50_000), (903, "1" * 50_000), (904, "1 " * 30_000), (5, "x 1.2.3.4")]
    got = pii.personal_data(frame(spark, rows)).collect()
    seen = collections.Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got)
    expected = collections.Counter()
    for i, t in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in forms.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        expected[(i, hashlib.sha256(",".join(spans).encode()).hexdigest(), *(sum(s.startswith(f"{k}:") for s in spans) for k in forms))] += 1
    assert seen == expected
    assert pii.personal_data(empty(spark)).count() == 0


def card(k):
    body = f"{400000000000000 + 7919 * k}"
    total = sum(int(c) if n % 2 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(body[::-1]))
    return body + str(-total % 10)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(k, f"text with account {card(k)} in it") for k in range(12)] + [(50, "text with account 99887766554433 in it"), (51, "text with number 99887766554400 on it")]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got[0]["n_card"] == 1 and got[0]["n_added"] == 0 and got[0]["found"]
    assert (got[50]["n_card"], got[50]["n_added"], got[50]["spans"]) == (0, 1, "card:18:32")
    assert got[51]["spans"] == "" and not got[51]["found"]


def test_bootstrap_goes_on_from_what_it_found(spark):
    """Forms that no seed has are found through contexts; what is found makes further contexts pass; neutral ones stay clean."""
    rng = random.Random(7)
    word = lambda: rng.choice(WORDS)
    rows, planted = [], set()
    for k in range(40):  # seeds, after and before the same words
        rows.append((k, f"{word()} {word()} reachable under +1 (017) 555-{7000 + k} daily {word()}"))
    for k in range(6):  # unseen forms in the context of seeds: groups without a plus, and a handle
        text = f"{word()} {word()} reachable under "
        hit = f"(017) 555 {8000 + k}" if k % 2 else f"jo_{WORDS[k]}"
        rows.append((100 + k, f"{text}{hit}, daily {word()}"))
        planted.add((100 + k, len(text), len(text) + len(hit)))
    for k in range(30):  # the same unseen strings again, after another word that no seed follows
        hit = f"(017) 555 {8001 + 2 * (k % 3)}" if k % 2 else f"jo_{WORDS[2 * (k % 3)]}"
        text = f"{word()} {word()} hotline "
        rows.append((200 + k, f"{text}{hit} {word()}"))
        planted.add((200 + k, len(text), len(text) + len(hit)))
    late = f"{word()} {word()} hotline "  # found in the second round only
    rows.append((300, f"{late}jo_last {word()}"))
    planted.add((300, len(late), len(late) + 7))
    clean = [(400 + k, f"{word()} chapter {k}.{k + 1} {word()} order {10_000_000 + k} {word()}") for k in range(60)]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, rows + clean)).collect()}
    found = {(i, int(x.split(":")[1]), int(x.split(":")[2])) for i, r in got.items() if i >= 100 for x in r["spans"].split(",") if x}
    assert found == planted
    assert all(got[i]["n_added"] == 0 for i, _ in rows[:40])


def test_scores_of_the_pattern_graph(spark):
    """The rounds over the graph as a plain loop."""
    rng = random.Random(8)
    edges = []
    for k in range(400):
        kind = rng.choice(["card", "phone", None, None])
        edges.append((f"p{min(rng.randrange(12), rng.randrange(12))}", f"{'s' if kind else 'u'}{rng.randrange(30)}", kind))
    edges += [("sure", f"s{k}", "card") for k in range(9)] + [("sure", "u1", None)] + [("then", "u1", None)] * 12 + [("then", f"u{k}", None) for k in (40, 41)] + [("and", f"n{k}", "phone") for k in range(8)] + [("and", "u40", None), ("and", "u41", None)]
    counted = collections.Counter(edges)
    entity, seen = {}, []
    while True:
        total, mass, strings = collections.Counter(), collections.Counter(), collections.Counter()
        for (p, hit, own), n in counted.items():
            total[p] += n
            score, kind = (1.0, own) if own else entity.get(hit, (0.0, None))
            if kind:
                mass[p, kind] += n * score
                strings[p, kind] += 1
        passed = {k: m / (total[k[0]] + pii.DOUBT) for k, m in mass.items() if strings[k] >= pii.SEEDS and m / (total[k[0]] + pii.DOUBT) >= pii.CONFIDENT}
        entity = {}
        for (p, kind), score in passed.items():
            for q, hit, own in counted:
                if q == p and own is None:
                    entity[hit] = max(entity.get(hit, (0.0, "")), (score, kind))
        now = ({k: round(v, 6) for k, v in passed.items()}, {k: (round(v, 6), kind) for k, (v, kind) in entity.items()})
        if now in seen:
            break
        seen.append(now)
    got = {(r["pattern"], r["kind"]): r["score"] for r in pii.confident_patterns(spark.createDataFrame(edges, "pattern string, hit string, kind string")).collect()}
    assert got.keys() == passed.keys() and ("sure", "card") in got
    assert all(math.isclose(got[k], passed[k]) for k in got)


def test_contexts_are_whole_words(spark):
    """Words of any length beside a candidate, also where more than BESIDE characters of one word are."""
    long, longer, behind = "a" * 70 + "mark", "b" * 300 + "two", "c" * 200 + "next"
    texts = [f"start {longer} {long} x1 {behind} end", f"{long} x1", f"one two x1 ({behind}", f"{'z ' * 90}near by x1 soon {'q' * 99}"]
    got = [[list(x) for x in r["c"]] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.transform(pii.candidate_spans(F.col("t")), pii.contexts).alias("c")).collect()]
    assert got[0] == [[f"1 {long}", f"2 {longer} {long}", f"+1 {behind}", f"both {long} _ {behind}"]]
    assert got[1] == [[f"1 {long}"]]
    assert got[2][0][:2] == ["1 two", "2 one two"] and got[3] == [["1 by", "2 near by", "+1 soon", "both by _ soon"]]


def test_candidates_of_any_length(spark):
    texts = ["password: hunter2", "password: correcthorsebattery", 'api_key="abcdefghijklmnop"', "pin=7", "plain words of prose, and more", "averyveryverylongcompound", ""]
    rows = secrets.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [[x["hit"] for x in r["found"]] for r in rows] == [["hunter2"], ["correcthorsebattery"], ["abcdefghijklmnop"], ["7"], [], ["averyveryverylongcompound"], []]


def plain_passages(text):
    """The features of one text in plain loops over words and bytes."""
    data = (text or "").encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\t\n\x0b\x0c\r ]+", data)]
    if not words:
        return [[0.0] * quality.FEATURES]
    out, marks = [], b".,;:!?'\"()-"
    for a in range(0, len(words), quality.PASSAGE):
        part = words[a : a + quality.PASSAGE]
        end = words[a + quality.PASSAGE][0] if a + quality.PASSAGE < len(words) else len(data)
        counts = collections.Counter(int(quality._CLASS[b]) for b in data[part[0][0] : end])
        row = [math.sqrt(counts[c] / (end - part[0][0])) for c in range(quality._CLASSES)]
        share = lambda flags: sum(flags) / len(part)
        said = [data[x:y] for x, y in words]
        here = range(a, a + len(part))
        row += [share(i >= k and said[i] == said[i - k] for i in here) for k in range(1, 5)]
        symbol = lambda b: quality._CLASS[b] > 5 and b not in marks
        row += [share(symbol(said[i][0]) and len(said[i]) == 1 for i in here), share(symbol(said[i][-1]) and len(said[i]) > 1 for i in here), share(quality._CLASS[said[i][0]] == 1 for i in here), share(said[i][-1] in b".,;:!?" for i in here), share(len(said[i]) > 14 for i in here), share(min(len(said[i]), 24) for i in here) / 24]
        out.append(row)
    return out


def test_passages_and_attention_in_plain_loops():
    """A text's features and score, whatever stands beside it in the slice."""
    rng = random.Random(21)
    pieces = ["Alpha", "beta.", "beta", "#", "x;", "Éa", "1234", "averyveryverylongword", "(so)", "a"]
    texts = ["", None, "  \n", " \t lead", "tail \n\n"] + ["".join(rng.choice(pieces) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(1, 160))) for _ in range(25)]
    x, bounds = quality.passages(pa.array(texts))
    expected = [plain_passages(t) for t in texts]
    assert np.diff(bounds).tolist() == [len(e) for e in expected]
    assert np.allclose(x, np.array([row for e in expected for row in e]), atol=1e-6)
    model = quality.fit([(x[a:b], k % 2) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))], epochs=2)
    got = quality.forward(model, quality.Bags((x - model["mean"]) / model["scale"], bounds))["p"]
    squash = lambda z: 1 / (1 + math.exp(-z))
    for p, rows in zip(got, expected):
        coded, weights = [], []
        for row in rows:
            z = [(v - m) / s for v, m, s in zip(row, model["mean"], model["scale"])]
            h = [math.tanh(sum(z[i] * model["E"][i, j] for i in range(len(z))) + model["e"][j]) for j in range(quality.HIDDEN)]
            gate = sum(math.tanh(sum(h[j] * model["V"][j, g] for j in range(len(h)))) * squash(sum(h[j] * model["U"][j, g] for j in range(len(h)))) * model["w"][g] for g in range(quality.GATES))
            coded.append(h)
            weights.append(math.exp(gate))
        bag = [sum(w * h[j] for w, h in zip(weights, coded)) / sum(weights) for j in range(quality.HIDDEN)]
        assert math.isclose(p, squash(sum(b * c for b, c in zip(bag, model["c"])) + float(model["b"])), abs_tol=1e-5)


def test_secrets(spark):
    rng = random.Random(3)
    rows = [(900, None), (901, ""), (902, "plain words only"), (903, "x" * 30_000), (904, "7f3Qz" * 4_000), (905, "see docs/guide/setup.html and mail7.example.com or 2024-01-17"), (906, "order 9807915762804490 from 10.20.30.44")]
    for k in range(60):
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        rows.append((k, f'some words token = "{token}" more') if k % 2 else (k, f"some words averyveryverylongcompoundword{'x' * (k % 7)} more"))
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows += [(950, f"API_KEY={token}\nAPI_KEY={token}"), (951, "password: hX7kQ2pz9 next words"), (952, f"curl -H 'Authorization: Bearer {token}' now"), (1, f'token = "{token}"'), (960, "password: hunter2"), (961, "password: correcthorsebattery"), (962, 'api_key="abcdefghijklmnop"'), (963, "the order of some words in plain prose: nothing here")]
    got = {}
    for r in secrets.secret_findings(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert all(got[k][0]["n_secrets"] == k % 2 for k in range(2, 60)) and got[900][0]["n_candidates"] == 0
    assert sorted(r["spans"] for r in got[1]) == ["20:60", "9:49"]
    assert got[950][0]["spans"] == "8:48,57:97" and got[951][0]["spans"] == "10:19" and got[952][0]["n_secrets"] == 1
    assert all(got[k][0]["n_secrets"] == 0 for k in (902, 903, 905, 906, 963)) and all(got[k][0]["n_secrets"] == 1 for k in (960, 961, 962))
    assert secrets.secret_findings(empty(spark)).count() == 0
    labelled = spark.createDataFrame([("0f" * 20, 'token = "', '" ', 1.0), ("averyveryverylongcompoundword", "some words ", " mor", 0.0)] * 10, "hit string, left string, right string, label double")
    again = {r["doc_id"]: r["n_secrets"] for r in secrets.secret_findings(frame(spark, rows), labelled).collect()}
    assert again[3] == 1 and again[2] == 0
    only = secrets.secret_findings(frame(spark, rows), labelled.where("label = 0"))
    assert only.agg(F.sum("n_secrets")).first()[0] == 0


def test_features_of_candidates(spark):
    """Shares, changes and coverage as plain loops over characters."""
    words = [("configuration", 5), ("figure", 3), ("iguana", 9), ("configure", 4), ("rare", 1)]
    known = collections.Counter(g for w, n in words if n >= secrets.TIMES for g in {w[k : k + 3] for k in range(len(w) - 2)})
    known = {g for g, n in known.items() if n >= secrets.TIMES}
    rows = [("Configuration9a", 'token = "', '" and'), ("a1B2c3/d.e", "see ", " of"), ("ÄÖ12345678", "x=", ""), ("ab", "", "")]
    dictionary = secrets.dictionary(spark.createDataFrame(words, "word string, n long"))
    hits = spark.createDataFrame([(*r, "src/test/a.py") for r in rows], "hit string, left string, right string, path string")
    kind = lambda c: "d" if c in "0123456789" else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "o"
    for r in secrets.described(hits, dictionary).collect():
        h, n = r["hit"], len(r["hit"])
        changes = sum(kind(a) != kind(b) and "o" not in (kind(a), kind(b)) for a, b in zip(h, h[1:]))
        grams = [h.lower()[k : k + 3] for k in range(max(1, n - 2))]
        expected = {"changes": changes / n, "digits": sum(kind(c) == "d" for c in h) / n, "capitals": sum(kind(c) == "u" for c in h) / n, "slashes": h.count("/") / n, "dots": h.count(".") / n, "kinds": len(set(h)) / n, "covered": sum(g in known for g in grams) / max(1, n - 2), "trial": 1.0}
        assert all(math.isclose(r[k], v) for k, v in expected.items()), (r, expected)
    first = secrets.described(hits, dictionary).first()
    assert (first["named"], first["assigned"], first["quoted"], first["after"]) == (1, 1, 1, 0)


def test_secrets_on_held_out_findings(spark):
    """Precision and recall on made findings that the forest has not seen; the figures stand in the README."""
    words = secrets.word_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    known = secrets.dictionary(words)
    made_rows = secrets.planted(spark, words, 6_000)
    forest, _ = secrets.trained(made_rows.where("number % 3 != 0"), known)
    judged = forest.transform(secrets._vectors(secrets.described(made_rows.where("number % 3 = 0"), known))).select("label", "prediction").collect()
    true = sum(r["label"] == 1 == r["prediction"] for r in judged)
    precision, recall = true / sum(r["prediction"] for r in judged), true / sum(r["label"] for r in judged)
    print("precision", precision, "recall", recall)
    assert precision > 0.95 and recall > 0.9


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    for name, keep in (("labels", None), ("benchmark", None)):
        table(spark, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = table(spark, "documents").unionByName(table(spark, "documents").limit(1).select(F.lit(-5).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in rows}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    bare = [re.sub(r"\s", "", texts[i]) for i in kept]
    assert len(kept) == len(rows) and len(set(bare)) == len(bare)
    sets = [shingled(texts[i]) for i in kept]
    assert not any(a and b and len(a & b) / len(a | b) >= 0.8 for k, a in enumerate(sets) for b in sets[:k])
    good = {r["doc_id"] for r in table(spark, "labels").where("quality = 1").collect()}
    assert len(good & kept) > 0.6 * len(good)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Rows that repeat ids, have none, or bring columns with the names that stages use."""
    import corpus_pipeline

    text = lambda k: " ".join(random.Random(k).choice(WORDS) + str(random.Random(k * 97 + j).randrange(90)) for j in range(40))
    rows = [(1, text(1)), (1, text(1)), (1, text(2)), (2, text(2) + "  "), (None, text(3)), (None, text(3)), (None, text(4)), (3, None), (4, ""), (5, text(1) + " changed"), (6, text(6)), (7, text(7))]
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id long, text string, _id string, row_name string, quality_score int")
    spark.createDataFrame([(1, " ".join(text(7).split()[3:15]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table(spark, "labels").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    kept, d = [(i, t) for i, t in rows], docs
    stages = dict(corpus_pipeline.STAGES)
    sorted_rows = lambda frame: sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)
    d = written(stages["quality classifier"](spark, d, str(tmp_path)), "a")
    assert sorted_rows(d) == sorted(kept, key=str) and d.columns == docs.columns
    d = written(stages["exact dedup"](spark, d, str(tmp_path)), "b")
    kept = [(1, text(1)), (2, text(2) + "  "), (None, text(3)), (None, text(4)), (3, None), (5, text(1) + " changed"), (6, text(6)), (7, text(7))]
    assert sorted_rows(d) == sorted(kept, key=str) and d.columns == docs.columns
    d = written(stages["n-gram Jaccard join"](spark, d, str(tmp_path)), "c")
    kept.remove((5, text(1) + " changed"))
    assert sorted_rows(d) == sorted(kept, key=str)
    d = written(stages["benchmark decontamination"](spark, d, str(tmp_path)), "d")
    kept.remove((7, text(7)))
    assert sorted_rows(d) == sorted(kept, key=str)
    assert stages["byte-level BPE"](spark, d, str(tmp_path)).count() == len(kept)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
