"""URL filter, Merkle manifest and collocations against brute force, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import collocations as col, merkle, url_filter as uf

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# URLs

ODD = [None, "", "no scheme/com/", "http://", "http://com/", "http://X.COM", "http://x.com/", "HTTP://WWW.Example.com/en/1?q=://b.net/es/", "https://notexample.com/en/", "http://a.example.com/en", "http://a.example.com/en/", "http://example.com/en/?x", "http://x.net/es/1#a", "http://x.net/ES/1", "http://net/fr/", "a://b://c.com/", "http://é.com/ä/\nx", "http://x.com/" + "a/" * 20_000, "http://b.org/p?a=1&b=2&&c#f"]


def parts(url):
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", ""
    host = re.split(r"[/?#]", rest[1])[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[1][len(host) :])[0]


def rule_of(url, rules):
    host, path = parts(url)
    fits = [(len(r), len(r.split("/")[0]), r, v) for r, v in rules for h, p in [(r.split("/")[0], r[len(r.split("/")[0]) :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", 1.0, "block", True) for i, u in enumerate(urls)], "page_id long, url string, html string, score double, rule string, held_out boolean").repartition(3)


def made_urls(n=800, seed=1):
    rng = random.Random(seed)
    hosts = [f"{w}{rng.choice(['', '.example'])}.{t}" for w in ("alpha", "www.beta", "m.gamma", "delta") for t in ("com", "net", "org")]
    return [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'es', 'de'])}/{rng.randrange(9999)}{rng.choice(['', '.html', '?page=2&ref=x', '#top'])}" for _ in range(n)]


def test_url_rules_and_verdicts(spark):
    urls = ODD + made_urls() + ["http://x.net/es/1#a"]
    got = {r["page_id"]: r for r in uf.url_verdicts(pages(spark, urls)).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rule, verdict = rule_of(url, uf.RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (*parts(url), rule), url
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= uf.THRESHOLD else "allow"))
        assert 0 <= got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32((url or "").encode()) % 5 == 0)
    assert uf.url_verdicts(pages(spark, urls).where("page_id < 0")).count() == 0


@pytest.mark.parametrize("broadcast", [10**6, -1])
def test_url_rules_by_join(spark, monkeypatch, broadcast):
    monkeypatch.setattr(uf, "LITERAL_RULES", 2)
    monkeypatch.setattr(uf, "BROADCAST_RULES", broadcast)
    rules = [*uf.RULES, ("org", "block"), ("a.example.com/e", "allow"), ("é.com/ä/\n", "block"), ("com/", "allow")]
    urls = ODD + made_urls(200)
    got = {r["page_id"]: (r["decided"]["rule"], r["decided"]["verdict"]) for r in uf.with_rules(uf.with_parts(pages(spark, urls)), uf.rule_table(spark, rules)).collect()}
    assert got == {i: rule_of(u, rules) for i, u in enumerate(urls)}


def test_url_trees_on_held_out_labels(spark):
    """Bad hosts have hyphens, figures and long queries; none of them is in the training fold by name."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    good = [f"https://{word(7)}.org/{word(5)}/{word(6)}.html" for _ in range(600)]
    bad = [f"http://{word(4)}-{word(5)}-{rng.randrange(99)}.org/{word(3)}?id={rng.randrange(10**9)}&s={rng.randrange(10**9)}" for _ in range(300)]
    labelled = spark.createDataFrame([(u, 0) for u in good] + [(u, 1) for u in bad] + [(bad[0], 0), (None, 1), (good[0], None)], "url string, label int")
    got = uf.url_verdicts(pages(spark, good + bad), uf.rule_table(spark, [("com/", "allow")]), labelled).where("held_out").collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] >= 600) for r in got)
    assert len(got) > 100 and right / len(got) > 0.97
    one = uf.url_verdicts(pages(spark, good[:9]), uf.rule_table(spark, [("com/", "allow")]), labelled.where("label = 1"))
    assert {r["verdict"] for r in one.collect()} == {"block"}
    none = uf.url_verdicts(pages(spark, good[:9]), uf.rule_table(spark, [("com/", "allow")]))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_url_features(spark):
    row = uf.described(uf.with_parts(pages(spark, ["http://a-b.c.org/x/y.html?q=1&r=%20#z"]))).collect()[0]
    url = row["url"]
    entropy = -sum(n / len(url) * np.log2(n / len(url)) for n in collections.Counter(url).values())
    assert (row["length"], row["labels"], row["depth"], row["parameters"], row["escapes"], row["top"], row["domain"], row["section"], row["ending"]) == (len(url), 3, 2, 2, 1, "org", "c.org", "c.org/x", "html")
    assert abs(row["entropy"] - entropy) < 1e-9 and abs(row["digits"] - 3 / len(url)) < 1e-9


# Merkle


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hashed(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 8 * 8
        out.append((nodes[a:i], nodes[i + 1 : a + 8]))
        i //= 8
    return out


def attested(rows):
    """Of (doc_id, source, lang, n_chars, text) rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = collections.defaultdict(list)
    for r in rows:
        low = r[4] if r[4] is None else r[4].translate(LOWER)
        leaf, changed = hashed(*map(field, r)), hashed(*map(field, (*r[:4], low)))
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups[r[2]].append(((r[0] is not None, r[0] or 0), leaf, changed if hit else leaf, r[0]))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([y[1] for y in sorted(groups[x])]) for x in names}
    top = levels_of([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for i, (_, leaf, start, doc) in enumerate(sorted(groups[x])):
            path = siblings(trees[x], i) + siblings(top, k)
            folded = start
            for left, right in path:
                folded = hashed(*left, folded, *right)
            out.append((doc, leaf, trees[x][-1][0], top[-1][0], hashed(*(d for p in path for side in p for d in side)), folded, folded == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int, n int, id long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def test_places_in_the_log():
    for n in (*range(1, 75), 511, 512, 513, 600):
        levels = merkle.height(n)
        log = merkle.completed([f"{i}" for i in range(n)], levels)
        nodes = levels_of([f"{i}" for i in range(n)])
        assert len(nodes) == levels + 1 and len(log) == sum(map(len, nodes))
        for h, level in enumerate(nodes):
            assert [log[p] for p in merkle.position(h, np.arange(len(level)), n, levels)] == level


@pytest.mark.parametrize("builder", [1, 3])
def test_manifest(spark, builder):
    rng = random.Random(builder)
    rows = [(i, f"s{i % 3}", "en" if i % 3 else rng.choice(["de", "é", None, ""]), i, f"Text {i} " * rng.randint(0, 4)) for i in range(700)]
    rows += [(i, None, f"l{i:02}", None, "ABC") for i in range(900, 911)]  # more than eight groups, some of one leaf
    rows += [(None, "s", "en", 1, "X"), (None, None, None, None, None), (5, "s", "en", 1, "Y"), (5, "s", "en", 1, "Y"), (5, "s", "en", 1, None), (6, "s", "en", 1, ""), (7, "s", "en", 1, "Q" * 200_000)]
    got = [tuple(r) for r in merkle.attested(documents(spark, rows), builder).collect()]
    assert sorted(got, key=str) == sorted(attested(rows), key=str)


def test_manifest_of_few_rows(spark):
    for rows in ([(1, "s", "en", 1, "X")], [(3, "s", None, 1, "x"), (4, "s", "en", 1, "Y")]):
        assert sorted(map(tuple, merkle.attested(documents(spark, rows)).collect())) == sorted(attested(rows))
    assert merkle.attested(documents(spark, rows).where("doc_id < 0")).count() == 0


# Collocations


def phrases(rows, low=10, top=2000):
    total, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {key: a for key, a in f.items() if a >= low and len(key[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, w), a in often.items():
        if any(g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= 50 * a for (g, v), b in often.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


def made_phrases(seed=2):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "É", "éA", "x" * 300, "it's", "\x00z", "ab", "a"]
    texts = [(rng.choice(["en", "en", "de", None, "und", "a\tb", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " \t "]) for _ in range(rng.randint(0, 120)))) for _ in range(90)]
    return texts + [("en", None), (None, ""), ("en", " \t.,"), ("de", "a a a a a a a a a a a a a"), ("en", "beta ALPHA beta " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, "k") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, a long, rank int, phrase string").repartition(4)


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    """Also with many small tries, filters that are full, and words that are shuffled."""
    if small:
        for name, value in (("FILTER_BITS", 15), ("SHARD_PHRASES", 40), ("PASS_SHARDS", 2), ("BLOCK", 50), ("BROADCAST_ROWS", -1), ("TOP_PARTS", 2)):
            monkeypatch.setattr(col, name, value)
    rows = made_phrases(3 if small else 2)
    got = col.collocations(frame(spark, rows)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert {tuple(r) for r in got.collect()} == phrases(rows)


def test_collocations_of_nothing(spark):
    assert col.collocations(frame(spark, [("en", "a b c")])).count() == 0
    assert col.collocations(frame(spark, [("en", "a b c")]).where("doc_id < 0")).count() == 0


def test_tries():
    rng = random.Random(5)
    keys = sorted({bytes(rng.choice(b"abcdefgh\xff\x00\n") for _ in range(rng.randint(1, 9))) for _ in range(3000)} | {bytes([b]) + b"q" for b in range(256) if b != col.END})
    trie = col.Trie.build(keys)
    for n, key in enumerate(keys):
        state = trie.walk(key)
        leaf = int(trie.base[state]) + col.END
        assert trie.check[leaf] == state and trie.base[leaf] == -1 - n
    assert trie.walk(b"zzzz") == -1


def test_equal_hashes_are_compared_by_bytes():
    seen, data = col._Seen(), np.frombuffer(b"abcabd", np.uint8)
    one, at, size = np.array([7], np.uint64), np.array([0]), np.array([3])
    assert len(seen.new(one, data, at, size)) == 1 and len(seen.new(one, data, at, size)) == 0
    assert len(seen.new(one, data, np.array([3]), size)) == 1
    assert pa.array(seen.bytes).to_pylist() == list(b"abcabd")


def test_texts_are_read_once_for_any_number_of_candidates(spark, monkeypatch):
    """Counting is one job over the texts, also when the candidates would fill many tries."""
    for name, value in (("SHARD_PHRASES", 5), ("PASS_SHARDS", 1)):
        monkeypatch.setattr(col, name, value)
    docs = frame(spark, made_phrases(4)).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    words = col.word_counts(docs).where("a >= 10").cache()
    col.phrase_counts(docs.mapInArrow(counted, docs.schema), words).write.format("noop").mode("overwrite").save()
    assert read.value == col.LONGEST * docs.count()  # hashes of two lengths, then the counts


def test_a_language_may_hold_any_byte(spark):
    rows = [(lang, "one two three " * 12) for lang in ("a\rb", "a\rc", "a\nb")]
    assert {tuple(r) for r in col.collocations(frame(spark, rows)).collect()} == phrases(rows)
