import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectorium.functions import facts as X
from lectorium.functions import segments as G
from lectorium.functions import text as T
from lectorium.operators import citations as C
from lectorium.operators import layout as L
from lectorium.sources import packages as P


def test_hashes():
    assert T.fnv1a("") == "811c9dc5" and T.fnv1a("a") == "e40c292c"
    assert T.djb2("") == 5381 and -(2**31) <= T.djb2("x" * 500) < 2**31


def test_spaces_and_rounding(spark):
    d = spark.createDataFrame([("﻿　 A \n\t b ",), (None,)], "t string")
    assert [r[0] for r in d.select(T.normal_block_text(F.col("t"))).collect()] == ["a b", None]
    assert spark.range(1).select(T.half_up(F.lit(-0.5)), T.half_up(F.lit(2.5)), T.half_up(F.lit(1.005), 2)).first()[:2] == (0, 3)


def test_invariants():
    got = {(k, v) for k, v, _ in X.invariants("BERT reached 93% [1, 2-4] in 2019, p < .05, see Fig. 3a and DeepIV.")}
    assert {("acronym", "BERT"), ("measurement", "93%"), ("citation", "[1, 2-4]"), ("year", "2019"), ("statistic", "p < .05"), ("figure", "Fig. 3a"), ("acronym", "DeepIV")} <= got
    assert X.preservation("n = 5 in 2019", "n = 5, 2019年")[0] == 1.0
    score, missing, extra, critical = X.preservation("in 2019", "in 2018")
    assert (missing, extra, critical) == (1, 1, 1) and score == 0.0
    assert not X.kept("DeBERTa", "acronym", "BERT") and X.kept("日本BERTは", "acronym", "BERT")
    assert X.invariants(None) == [] and X.preservation(None, None)[0] == 1.0


def test_units_keep_citations_whole():
    s = "We follow Lee (Lee et al., 2008; Kim, 2010). It holds, e.g. here (see Fig. 2). Done."
    assert G.units(s)[0].endswith("2010).") and len(G.units(s)) == 2 or len(G.units(s)) == 3
    assert len(G.units("• one item here;\n• another item here;")) == 2
    assert G.units("") == [] and G.units(None) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. ()[]1,;!?。「」\n•-“”X", max_size=300))
def test_units_round_trip(s):
    assert G.round_trip(s, G.units(s))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab [1]2(,.)%=p<Z0Q⟦⟧", max_size=120))
def test_shield_round_trip(s):
    hidden, kept, nonce = G.shielded(s)
    assert G.restored(hidden, kept, nonce) == s or "⟦" in s


def test_failed_units_fall_back(spark):
    def engine(u, a, b):
        if "bad" in u:
            raise RuntimeError("no")
        return u.upper()

    d = spark.createDataFrame([(1, "All is good here today. This one is bad for sure.", "en", "de"), (2, None, "en", "de")], "id int, text string, source_language string, target_language string")
    r = {x.id: x for x in G.translated(d, engine).collect()}
    assert r[1].output == "ALL IS GOOD HERE TODAY. This one is bad for sure." and r[1].status == "partial" and r[2].output == ""


def test_citation_keys(spark):
    d = spark.createDataFrame([("x [1, 3–5] y [5]",), ("[9-40] [7-2]",), ("none",), (None,)], "t string")
    assert [r[0] for r in d.select(C.citation_keys(F.col("t"))).collect()] == [[1, 3, 4, 5], [], [], None]
    keys = [r[0] for r in spark.createDataFrame([("[12] A. B.",), ("3. Lee",), ("3. lee",)], "t string").select(C.reference_key(F.col("t"))).collect()]
    assert keys == ["12", "3", None]


def test_glossary_longest_first():
    g = (("memory", "記憶"), ("working memory", "作業記憶"))
    assert C.with_glossary("Working memory and memory.", g) == "作業記憶 and 記憶."
    assert C.with_glossary("something (memory) else", g) == "記憶（memory） else"
    assert C.with_glossary(None, g) is None


def test_reanchor():
    assert C.reanchored("ab", 9, "", "", "xxabyy") == (2, "active")
    assert C.reanchored("ab", 0, "q", "", "ab qab") == (4, "active")
    assert C.reanchored("ab", 7, "", "", "none") == (7, "orphaned")
    assert C.reanchored("", 7, "", "", None) == (7, "orphaned")


    assert C.reanchored("ab", 7, "", "", "xab", unchanged=True) == (7, "active")
    assert C.reanchored("ab", 0, "z", "q", "zabx yabq abq") == (1, "active")


def test_citation_groups_links_and_roles(spark):
    assert C.citation_groups("a [1, 3–5] b [9-40] [x] [2") == [(2, 10, [1, 3, 4, 5])]
    assert C.links('see <https://a.de/x,y.> and doi: 10.1234/AB-c. or https://doi.org/10.5555/z,') == [
        (5, 21, "https://a.de/x,y"), (28, 45, "https://doi.org/10.1234/AB-c"), (50, 75, "https://doi.org/10.5555/z"),
    ]
    d = spark.createDataFrame([("d", "a", "heading", "1. Intro"), ("d", "b", "reference", "[1] Lee"), ("d", "c", "paragraph", "2. Kim"), ("d", "e", "reference", "[2] Ito"), ("d", "f", "list", None)], "doc string, id string, role string, text string")
    assert [tuple(r) for r in C.unique_references(d, "doc", "id", "role").collect()] == [("d", "1", "b")]
    m = F.create_map(F.lit("1"), F.lit("a$1\\b"))
    assert spark.range(1).select(C.linked(F.lit("x [1], [2], [1](#y)"), m)).first()[0] == "x [1](#a$1\\b), [2], [1](#y)"


def test_facts_with_overlaid_signs_and_sides():
    kinds = lambda t: {(k, v) for k, v, _ in X.invariants(t)}
    assert ("statistic", "n \u0338= 5") in kinds("with n \u0338= 5 here") and X.kept("n ≠ 5", "statistic", "n \u0338= 5")
    assert {("statistic", "F(2, 31) = 4.2"), ("measurement", "5 mm"), ("acronym", "Mann-Whitney"), ("url", "https://a.b/c")} <= kinds("F(2, 31) = 4.2, 5 mm, Mann-Whitney, https://a.b/c 。")
    assert ("year", "2019") in kinds("2019年") and not kinds("part 3x, 5mmx and plain words") - {("number", "5")}
    assert ("figure", "figs. 3(b)") in kinds("see figs. 3(b)") and ("citation", "12") in kinds("said “so”12 (p. 3)")


def test_every_span_is_shielded():
    s = " ".join(f"so [{k}] it was." for k in range(120))
    hidden, kept, nonce = G.shielded(s)
    assert len(kept) == 120 and "[" not in hidden and G.restored(hidden, kept, nonce) == s
    assert G.restored("x 【Ｚ０Ｑ ０】 y。", ["[1]", "[2]"], "Z0Q") == "x [1] y [2]。"
    full = " ".join(f"Z{k}Q" for k in range(G.NONCES)) + " [1]"
    assert G.shielded(full) == (full, [], "") and G.restored(full, [], "") == full


def test_glossary_reads_once():
    g = (("a", "x"), ("working memory", "作業記憶"), ("memory test", "記憶検査"), ("recall", "working memory"))
    assert C.with_glossary("working memory test, recall; (recall", g) == "作業記憶 test, working memory; (recall"
    assert C.with_glossary("", g) == ""


def test_highlight_segments(spark):
    d = spark.createDataFrame([(1, "a", 0, 4, 10), (1, "b", 2, 20, 10), (1, "c", 5, 5, 10)], "k int, id string, start int, stop int, n int")
    got = sorted((r.seg_start, r.seg_end, tuple(r.ids)) for r in C.highlight_segments(d, ["k"], F.col("n")).collect())
    assert got == [(0, 2, ("a",)), (2, 4, ("a", "b")), (4, 10, ("b",))]


def page(n=24, two=True):
    out = []
    for i in range(n):
        x = 54.0 if i % 2 == 0 or not two else 318.0
        out.append(("d", 1, i, f"line {i}", x, 80.0 + 20 * (i // 2 if two else i), 240.0 if two else 480.0, 10.0, 10.0))
    return out


ITEMS = "doc_id string, page int, item_ix int, text string, x double, y double, width double, height double, font_size double"


def test_two_columns_read_left_then_right(spark):
    it = spark.createDataFrame([*page(), ("d", 1, 99, "A title across", 54.0, 60.0, 500.0, 10.0, 10.0)], ITEMS)
    pages = spark.createDataFrame([("d", 1, 612.0, 792.0)], "doc_id string, page int, width double, height double")
    lay = L.page_columns(it, pages)
    assert lay.first().multi_column
    lines = L.line_frame(L.lines_of(L.with_column(it, lay).select(*it.columns, "column")))
    order = [r.text for r in L.in_reading_order(lines).orderBy("place").collect()]
    assert order == ["A title across", *[f"line {i}" for i in range(0, 24, 2)], *[f"line {i}" for i in range(1, 24, 2)]]


def test_few_items_are_one_column(spark):
    it = spark.createDataFrame(page(10), ITEMS)
    pages = spark.createDataFrame([("d", 1, 612.0, 792.0)], "doc_id string, page int, width double, height double")
    assert not L.page_columns(it, pages).first().multi_column


def test_items_join_by_gap(spark):
    it = spark.createDataFrame([("d", 1, 0, "Hel", 0.0, 0.0, 10.0, 8.0, 10.0), ("d", 1, 1, "lo", 10.5, 0.0, 8.0, 8.0, 10.0), ("d", 1, 2, "you", 25.0, 0.0, 8.0, 8.0, 10.0)], ITEMS)
    assert L.joined_text(it, "doc_id").first().text == "Hello you"


def test_markdown_round_trip(spark):
    nodes = spark.createDataFrame(
        [("d", 0, "heading", 2, None, "Methods"), ("d", 1, "paragraph", 0, "b1", "One."), ("d", 2, "math", 0, "b2", "x = 1"), ("d", 3, "image", 0, None, "![f](a.png)")],
        "doc_id string, ord int, kind string, level int, block_id string, text string",
    )
    back = P.parsed_markdown(P.to_markdown(nodes)).orderBy("ord").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in nodes.orderBy("ord").collect()]
    plain = P.to_markdown(nodes).select(P.without_comments(F.col("source"))).first()[0]
    assert "<!--" not in plain


def test_front_matter_fences_and_paths(spark):
    n = P.markdown_nodes('---\ntitle: "T"\n---\n# A\n\n> [!note] x\n\n| a |\n|---|\n')
    assert [x[1] for x in n] == ["front", "heading", "callout", "table"]
    d = spark.createDataFrame([("a/b.md",), ("../x",), ("/etc",), ("a/../b",)], "p string")
    assert [r[0] for r in d.select(P.safe_path(F.col("p"))).collect()] == ["a/b.md", None, None, None]


def test_header_xml(spark):
    x = "<TEI><teiHeader><fileDesc><titleStmt><title> T </title></titleStmt><sourceDesc><author><persName><forename>A</forename><surname>B</surname></persName><affiliation><orgName>U</orgName></affiliation></author></sourceDesc></fileDesc><profileDesc><abstract>Abs</abstract></profileDesc></teiHeader></TEI>"
    r = spark.createDataFrame([(x,)], "x string").select(*P.header_fields(F.col("x"))).first()
    assert tuple(r) == ("T", ["A B"], ["U"], "Abs")


def test_staged_write_replaces(spark, tmp_path):
    p = str(tmp_path / "t")
    P.staged_write(spark.range(3).toDF("a"), p)
    P.staged_write(spark.range(5).toDF("a"), p)
    assert spark.read.parquet(p).count() == 5 and not (tmp_path / "t.bak").exists()


def test_data_url(spark):
    d = spark.createDataFrame([("data:image/png;base64,QUI=",), ("http://x",)], "u string")
    assert [r[0] for r in d.select(P.data_url(F.col("u"))).collect()] == [bytearray(b"AB"), None]


def test_names_fold():
    assert X.folded_name("Éva Müller") == "eva muller" and re.match("x", "x")
