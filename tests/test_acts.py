"""Acts in any state: notes, quotations, formulas, tables with spans, parsers in turn, and the folds over their trees."""

import random
import re

import pytest

from quarry.operators import trees
from quarry.sources import act_tree, files, xml_docs

ACT = """<ACT><TITLE><TI><P>On rest</P></TI></TITLE>
<ARTICLE IDENTIFIER="001"><TI.ART>Article 1</TI.ART><STI.ART>Scope</STI.ART><ALINEA>Crews<NOTE NOTE.ID="E1"><P>As defined in <HT TYPE="ITALIC">Annex</HT> I.</P></NOTE> must rest<NOTE NOTE.REF="E1"/>, says <QUOT.START CODE="201E"/>the rule<QUOT.END/>.</ALINEA>
<LIST><ITEM><NP><NO.P>(a)</NO.P><P>H<IND>2</IND>O at 10<EXPONENT>3</EXPONENT> and <FRACTION><DIVIDEND>1</DIVIDEND><DIVISOR>2</DIVISOR></FRACTION></P></NP></ITEM></LIST></ARTICLE>
<PARAG><NO.PARAG>2.</NO.PARAG><ALINEA>Stray head <P>inner</P> and tail.</ALINEA></PARAG>
<QUOT.S><P>A quoted rule.</P></QUOT.S><FORMULA>a = b</FORMULA><WRAP>loose <B>words</B> here</WRAP>
<TOC><P>Contents line</P></TOC>
<TBL COLS="3"><TITLE><TI><P>Limits</P></TI></TITLE><CORPUS><ROW TYPE="HEADER"><CELL COL="1" ROWSPAN="2">Crew</CELL><CELL COL="2" COLSPAN="2">Hours</CELL></ROW><ROW TYPE="HEADER"><CELL COL="2">day</CELL><CELL COL="3">night</CELL></ROW><ROW><CELL COL="1">one<NOTE NOTE.ID="T1"><P>Table note.</P></NOTE></CELL><CELL COL="2">9</CELL><CELL COL="3">8</CELL></ROW></CORPUS><GR.NOTES><NOTE NOTE.ID="T2"><P>Alone.</P></NOTE></GR.NOTES></TBL>
</ACT>"""


def acts(spark, contents):
    return spark.createDataFrame([(p, c.encode() if isinstance(c, str) else c) for p, c in contents.items()], "path string, content binary")


def test_notes_quotes_formulas_and_tables(spark):
    nodes = act_tree.parsed_in_turn(acts(spark, {"a.xml": ACT}))
    rows = {r["node_id"]: r for r in nodes.orderBy("node_id").collect()}
    by = lambda kind: [r for r in rows.values() if r["type"] == kind]
    assert {r["engine"] for r in rows.values()} == {"strict"} and not by("contents")
    article = by("article")[0]
    assert (article["number"], article["title"], article["attributes"]) == ("Article 1", "Scope", {"IDENTIFIER": "001"})
    first = next(r for r in by("text") if r["parent_id"] == article["node_id"])
    assert first["text"] == "Crews[^E1] must rest[^E1], says „the rule”."
    assert [r["text"] for r in by("note")] == ["As defined in Annex I.", "Table note.", "Alone."]
    assert by("item")[0]["number"] == "(a)" and not by("point") and any(r["text"] == "H_2O at 10^3 and 1/2" for r in rows.values())
    assert by("formula")[0]["text"] == "a = b" and any(r["text"] == "loose words here" for r in rows.values())
    assert rows[by("quote")[0]["node_id"] + 1]["text"] == "A quoted rule."
    assert [r["text"] for r in by("text") if r["text"] in ("Stray head", "inner", "and tail.")] == ["Stray head", "inner", "and tail."]
    table = by("table")[0]
    assert table["title"] == "Limits" and table["text"].splitlines() == ["| Crew | Hours / day | Hours / night |", "| --- | --- | --- |", "| one[^T1] | 9 | 8 |"]
    kept = act_tree.parsed_in_turn(acts(spark, {"a.xml": ACT}), keep_contents=True)
    assert kept.where("type = 'contents'").count() == 1

    # Every note is attached once: two at their first markers, one without a marker where it stands.
    places = {(r["note_id"], r["place"]): (r["uses"], r["attached"]) for r in act_tree.note_places(nodes).collect()}
    assert places == {("E1", 0): (2, True), ("E1", 1): (2, False), ("T1", 0): (1, True)}
    noted = {r["type"]: r["notes"] for r in act_tree.with_notes(nodes).collect() if r["notes"]}
    assert sorted(n for x in noted.values() for n in x) == ["Alone.", "As defined in Annex I.", "Table note."]

    # The first text of an article and of a paragraph moves up.
    up = act_tree.hoisted(nodes)
    lifted = up.where("type = 'article'").first()
    assert lifted["text"] == first["text"] and up.where(f"node_id = {first['node_id']}").count() == 0
    assert act_tree.note_places(up).where("attached").count() == 2 and up.where("type = 'note' and parent_id = %d" % article["node_id"]).count() == 1

    # Nothing of the source is lost.
    source = nodes.selectExpr("path as doc_id", "type as tag", "text").where("text is not null and type != 'table'")
    parsed = act_tree.hoisted(nodes).selectExpr("path as doc_id", "node_id as seq", "text").where("text is not null")
    assert trees.orphans(source, parsed, 3).count() == 0
    words = set(re.findall(r"\w+", re.sub(r"<TOC>.*?</TOC>|<[^>]*>", " ", ACT, flags=re.S)))
    have = set(re.findall(r"\w+", " ".join(f"{r['number']} {r['title']} {r['text']}" for r in rows.values()).replace("_", " ")))
    assert words - have <= {"H", "2", "O"}


def test_parsers_take_turns(spark):
    damaged = {
        "good": "<ACT><P>fine</P></ACT>", "cut": "<ACT><ARTICLE><STI.ART>Rest</STI.ART><P>One & two < three<P>more", "crossed": "<ACT><P>a <B>bold</P> b</B></ACT>\x01", "encoding": '<?xml version="1.0" encoding="no-such"?><ACT><P>Ünknown</P></ACT>',
        "words": "Just words &amp; lines\n\nnext", "nothing": b"", "noise": b"\xff\xfe\x00", "deep": "<ACT>" + "<P>" * 3000 + "x" + "</P>" * 3000 + "</ACT>",
    }
    got = act_tree.parsed_in_turn(acts(spark, damaged)).collect()
    engine = {r["path"]: r["engine"] for r in got}
    assert engine == {"good": "strict", "cut": "repaired", "crossed": "repaired", "encoding": "repaired", "words": "bare", "nothing": None, "noise": "bare", "deep": "strict"}
    text = lambda p: [r["text"] for r in sorted(got, key=lambda r: r["node_id"] or 0) if r["path"] == p and r["text"]]
    assert text("cut") == ["One & two < three", "more"] and text("crossed") == ["a bold", "b"] and text("encoding") == ["Ünknown"]
    assert text("words") == ["Just words & lines", "next"] and text("deep") == ["x"]
    assert [r["error"] for r in got if r["path"] == "nothing"][0].startswith("ValueError")
    assert act_tree.parsed_in_turn(acts(spark, damaged).where("path = 'x'")).count() == 0


def filled(cells):
    """Brute force: rows in order, cells in order, the first free place, the first of overlapping cells stays."""
    out = {}
    covered = {}
    for row, ord_, col, cs, rs, text in sorted(cells, key=lambda c: (c[0], c[1])):
        cs, rs = max(1, cs or 1), max(1, rs or 1)
        if col is None:
            col = next(c for c in range(1, 999) if covered.get(c, 0) <= row)
        for c in range(col, col + cs):
            covered[c] = max(covered.get(c, 0), row + rs)
            for r in range(row, row + rs):
                if (r, c) not in out or out[r, c][2] > (row, ord_):
                    out[r, c] = (text, (r, c) != (row, col), (row, ord_))
    return {k: v[:2] for k, v in out.items()}


def test_grids_of_cells_with_spans(spark):
    rng = random.Random(8)
    tables = {0: [(0, 0, None, 2, 1, "a"), (0, 1, None, 1, 2, "b"), (1, 0, None, 1, 1, "c"), (1, 1, None, None, 0, None)]}
    for t in range(1, 12):
        tables[t] = [(r, k, rng.choice([None, rng.randint(1, 5)]) if t > 6 else None, rng.randint(1, 3), rng.randint(1, 3), f"{r}.{k}") for r in range(rng.randint(1, 5)) for k in range(rng.randint(0, 4))]
    cells = spark.createDataFrame([(t, *c) for t, cs in tables.items() for c in cs], "t int, row int, ord int, col int, colspan int, rowspan int, text string")
    got = {}
    for r in act_tree.filled_grid(cells, ["t"]).collect():
        got.setdefault(r["t"], {})[r["row"], r["col"]] = (r["text"], r["spanned"])
    assert got == {t: filled(cs) for t, cs in tables.items() if cs}
    assert got[0] == {(0, 1): ("a", False), (0, 2): ("a", True), (0, 3): ("b", False), (1, 3): ("b", True), (1, 1): ("c", False), (1, 2): (None, False)}


def test_places_of_a_grid_are_not_sorted(spark):
    """Equal places in a row, columns below 1 and cells without a row or text; of overlapping cells the first by (row, ord, text) stays."""
    rng = random.Random(18)
    tables = {t: [(rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2]), rng.randint(-2, 5), rng.randint(1, 3), rng.randint(1, 3), rng.choice([None, f"x{k}", f"y{k}"])) for k in range(rng.randint(1, 9))] for t in range(40)}
    least = lambda x: (x is not None, x if x is not None else 0)
    expected = set()
    for t, cells in tables.items():
        taken = {}
        for row, ord_, col, cs, rs, text in cells:
            for r in range(row, row + rs) if row is not None else ():
                for c in range(col, col + cs):
                    taken.setdefault((r, c), []).append((row, least(ord_), least(text and (text[0], text)), text, (r, c) != (row, col)))
        for (r, c), of in taken.items():
            first = min(x[:3] for x in of)
            expected |= {(t, r, c, x[3], x[4]) for x in of if x[:3] == first}
    rows = spark.createDataFrame([(t, *c) for t, cs in tables.items() for c in cs], "t int, row int, ord int, col int, colspan int, rowspan int, text string")
    grid = act_tree.filled_grid(rows, ["t"])
    got = [tuple(r) for r in grid.collect()]
    assert len({x[:3] for x in got}) == len(got) and {x[:3] for x in got} == {x[:3] for x in expected} and set(got) <= expected
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan


def test_sources_give_error_rows_and_never_stop(spark, tmp_path):
    bad = {"deep": "<ACT>" + "<SECTION>" * 3000 + "x" + "</SECTION>" * 3000 + "</ACT>", "unknown": '<?xml version="1.0" encoding="no-such"?><a/>', "wide": b'<?xml version="1.0" encoding="utf-7"?><a/>', "multi": b'<?xml version="1.0" encoding="big5"?><a>\xa4\xa4</a>', "null": None}
    rows = acts(spark, bad)
    parsed = xml_docs.nodes(rows)
    assert {r["path"] for r in parsed.where("error is not null").collect()} >= {"unknown", "wide", "null"}
    assert parsed.where("path = 'deep' and type = 'section'").count() == 3000
    assert xml_docs.headers(rows).where("error is not null").count() >= 3
    items = xml_docs.rule_items(rows)
    assert items.where("error is not null and seq = -1").count() >= 3
    assert files.feed_items(rows).count() == 0
    (tmp_path / "a.txt").write_bytes(b"good \xff bytes")
    (tmp_path / "_b.txt").write_bytes(b"hidden")
    assert [(r["doc_id"], r["text"]) for r in files.page_texts(spark, str(tmp_path)).collect()] == [("a", "good � bytes")]


LABELS = ["1.", "2.", "12a", "(a)", "(b)", "(c)", "(h)", "(i)", "(ii)", "(j)", "(v)", "(x)", "i)", "ii)", "a)", "A.", "(B)", "1.1", "1.2.", "[3]", "Ab", "-", "", " (é) ", None]


def style(label):
    given = (label or "").strip()
    bare = re.sub(r"^[()\[\].:;\s]+|[()\[\].:;\s]+$", "", given)
    wrapper = "both" if re.match(r"\(.*\)[.;:]*$", given) else "right" if re.search(r"\)[.;:]*$", given) else "dot" if given.endswith(".") else "none"
    if re.fullmatch(r"\d+(\.\d+)+", bare):
        return f"num{bare.count('.') + 1}", wrapper, bare
    if re.fullmatch(r"\d+[a-z]?", bare):
        return "num", wrapper, bare
    if bare.isalpha() and bare in (bare.lower(), bare.upper()):
        return "alpha" if bare == bare.lower() else "ualpha", wrapper, bare
    return None


def parents(rows):
    """Brute force: open points by position in the outline, found by looking back over all rows."""
    out, outline = {}, {}  # outline: seq -> (style, wrapper, bare, parent)
    now = None
    for seq, kind, number in rows:
        mine = style(number) if kind in ("item", "paragraph") else None
        if mine is None:
            if kind != "list":
                now = None
            out[seq] = now
            continue
        chain, at = [], now
        while at is not None:
            chain.append(at)
            at = outline[at][3]
        letter = next((outline[c][2] for c in chain if outline[c][:2] == ("alpha", mine[1])), "")
        name = mine[0]
        if re.fullmatch("(?=.)x{0,3}(ix|iv|v?i{0,3})", mine[2]) and not (len(letter) == len(mine[2]) == 1 and ord(letter) + 1 == ord(mine[2])):
            name = "roman"
        same = [c for c in chain if outline[c][:2] == (name, mine[1])]
        begins = trees.STARTS.get(name) == mine[2]
        out[seq] = outline[same[-1]][3] if same and not begins else now
        outline[seq] = (name, mine[1], mine[2], out[seq])
        now = seq
    return out


def test_points_nest_as_by_brute_force(spark):
    rng = random.Random(11)
    docs = {d: [(s, rng.choice(["item", "item", "item", "paragraph", "list", "text"]) if rng.random() < 0.3 else "item", rng.choice(LABELS)) for s in range(rng.randint(1, 60))] for d in range(25)}
    frame = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], "doc_id int, seq long, type string, number string")
    got = {}
    for r in trees.nested_points(frame).collect():
        got.setdefault(r["doc_id"], {})[r["seq"]] = r["point_parent"]
    for d, rows in docs.items():
        assert got[d] == parents(rows), rows
    assert trees.nested_points(frame.where("doc_id < 0")).count() == 0


def lists(rows):
    out, head = [], None
    for seq, kind, text, numbers in rows:
        deeper = head is not None and len(numbers) > len(head["numbers"]) and numbers[: len(head["numbers"])] == head["numbers"]
        if head is not None and head["takes"] and kind == "item" and (head["kind"] != "item" or deeper):
            out[-1][1].append(f"{numbers[-1] if numbers else '-'} {text}")
        else:
            head = {"kind": kind, "numbers": numbers, "takes": kind in ("text", "paragraph", "item") and text.strip().endswith(":")}
            out.append((seq, [text], kind))
    return {seq: ("merged_list" if len(lines) > 1 else kind, "\n".join(lines), len(lines)) for seq, lines, kind in out}


def test_lists_merge_as_by_brute_force(spark):
    rng = random.Random(12)
    docs = {d: [(s, rng.choice(["item", "item", "item", "text", "paragraph", "article"]), rng.choice(["ends:", "plain", "so: "]), [rng.choice("12") for _ in range(rng.randint(0, 3))]) for s in range(rng.randint(1, 40))] for d in range(25)}
    frame = spark.createDataFrame([(d, s, f"c{s}", k, t, n) for d, rows in docs.items() for s, k, t, n in rows], "doc_id int, seq long, chunk_id string, chunk_type string, text string, numbers array<string>")
    got = {}
    for r in trees.merged(frame).collect():
        assert r["chunk_id"] == f"c{r['seq']}"
        got.setdefault(r["doc_id"], {})[r["seq"]] = (r["chunk_type"], r["text"], r["n_rows"])
    assert got == {d: lists(rows) for d, rows in docs.items()}


@pytest.mark.parametrize("label", [x for x in LABELS if x])
def test_labels(spark, label):
    row = spark.createDataFrame([(label,)], "t string").select(trees.point_label(trees.F.col("t")).alias("x")).first()["x"]
    assert (row and (row["style"], row["wrapper"], row["bare"])) == style(label)
