import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectorium.operators import evaluation as E
from lectorium.operators import library as L
from lectorium.operators import merge as M
from lectorium.operators import search as S
from lectorium.operators import tree as T
from lectorium.operators.versions import latest


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_latest_ties_nulls_and_empty(spark):
    d = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, None, "z"), (None, 1, "n"), (None, 2, "m")], "k int, v int, t string")
    assert latest(d, ["k"], ["v"]).orderBy("k").collect() == [(None, 2, "m"), (1, 2, "b")]
    assert latest(d.limit(0), ["k"], ["v"]).count() == 0


def test_upsert_keeps_first_values(spark):
    base = spark.createDataFrame([(1, "a", 1, 10), (2, "b", 1, 20)], "id int, t string, v int, made int")
    delta = spark.createDataFrame([(1, "x", 1, 11), (3, "c", 1, 30), (2, "old", 0, 21)], "id int, t string, v int, made int")
    assert rows(L.upserted(base, delta, ["id"], "v", ["made"]), "id", "t", "made") == [(1, "x", 10), (2, "b", 20), (3, "c", 30)]


def test_blank_needle_keeps_all_and_empty_strings_are_dropped(spark):
    d = spark.createDataFrame([("1", "", "Ab"), ("2", None, None)], "id string, a string, b string")
    assert L.matching(d, "  ", ["a", "b"], []).count() == 2
    assert rows(L.matching(d, "aB", ["a", "b"], []), "id") == [("1",)]


def test_day_label(spark):
    d = spark.createDataFrame([(dt.datetime(2025, 6, 30, 23),), (dt.datetime(2025, 6, 29, 1),), (dt.datetime(2025, 6, 26),), (dt.datetime(2025, 1, 2),)], "t timestamp")
    got = [r[0] for r in d.select(L.day_label(F.col("t"), dt.datetime(2025, 6, 30))).collect()]
    assert got == ["today", "yesterday", "4 days", "2025-01-02"]


NODES = [("a", None, 0, "a"), ("b", "a", 1, "b"), ("c", "b", 0, "c"), ("d", "c", 0, "d"), ("x", "y", 0, "x"), ("y", "x", 0, "y")]


@pytest.fixture()
def nodes(spark):
    return spark.createDataFrame(NODES, "id string, parent string, ord int, name string")


def test_tree_is_safe_with_cycles(spark, nodes):
    assert rows(T.tree(nodes), "id", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    c = {(r.ancestor, r.id) for r in T.descendants(nodes).collect()}
    assert ("a", "d") in c and ("x", "y") in c and ("d", "a") not in c
    moves = spark.createDataFrame([("b", "d"), ("d", "a")], "id string, new_parent string")
    assert rows(T.would_cycle(nodes, moves), "id", "cycle") == [("b", True), ("d", False)]
    assert rows(T.moved(nodes, moves), "id", "parent")[3] == ("d", "a")
    assert T.next_order(nodes, "none").first()[0] == 0


def test_search(spark):
    d = spark.createDataFrame([(1, "Sea ice, sea level"), (2, "ice"), (3, None)], "id int, t string")
    ix = S.inverted_index(d, "id", F.col("t"))
    assert rows(S.match_all(ix, "id", "ICE sea"), "id", "tf") == [(1, 3)]
    assert S.match_all(ix, "id", " ").count() == 0
    assert rows(S.match_like(d, "id", ["t"], "s_a%"), "id") == [(1,)]
    one = spark.createDataFrame([("x" * 40 + "needle" + "y" * 80,), ("needle",), ("none",)], "t string")
    got = [r[0] for r in one.select(S.snippet(F.col("t"), "Needle")).collect()]
    assert got == ["…" + "x" * 30 + "needle" + "y" * 50 + "…", "needle", None]


def test_set_scores_of_empty_sets(spark):
    d = spark.createDataFrame([([], []), (["a"], []), ([], ["a"]), ([" A ", "b"], ["a"])], "p array<string>, g array<string>")
    got = [tuple(r) for r in d.select(*E.set_scores(F.col("p"), F.col("g"))).collect()]
    assert got == [(1, 1, 1), (0, 1, 0), (1, 0, 0), (0.5, 1, pytest.approx(2 / 3))]


def test_title_groups_avoid_hash_groups(spark):
    d = spark.createDataFrame([(1, "h", "T", 1), (2, "h", "u", 2), (3, "i", "t ", 3), (4, "j", "T", 4), (5, None, None, 5)], "id int, h string, t string, at int")
    assert rows(E.duplicate_groups(d, "id", "h", "t", "at"), "kind", "members") == [("hash", [1, 2]), ("title", [3, 4])]


def test_zero_time_rates(spark):
    d = spark.createDataFrame([(10, 0.0), (10, 500.0)], "n int, ms double")
    assert [tuple(r) for r in d.select(E.per_second(F.col("n"), F.col("ms"), 0.0), E.per_second(F.col("n"), F.col("ms"), None)).collect()] == [(0, None), (20, 20)]


def test_merge_prefers_filled_and_keeps_unseen(spark):
    o = spark.createDataFrame([(1, "old", "a"), (2, "only", "b"), (3, None, "c")], "id int, v string, e string")
    n = spark.createDataFrame([(1, "", "A"), (3, "new", "C"), (4, None, "D")], "id int, v string, e string")
    assert rows(M.prefer_filled(o, n, ["id"], "v"), "id", "e") == [(1, "a"), (2, "b"), (3, "C"), (4, "D")]


def test_reconcile_is_greedy_and_one_to_one(spark):
    p = spark.createDataFrame([("d", "a", "x", 9), ("d", "a", "y", 8), ("d", "b", "x", 8), ("d", "b", "y", 5)], "doc string, o_id string, n_id string, score int")
    assert rows(M.reconciled(p, "doc"), "o_id", "n_id") == [("a", "x")]
    back = M.remapped(spark.createDataFrame([("d", "a"), ("d", "q")], "doc string, block string"), M.reconciled(p, "doc"), ["doc"], "block")
    assert rows(back, "block") == [("q",), ("x",)]


def test_validation(spark):
    box = (1, 1.0, 1.0, 5.0, 5.0)
    b = spark.createDataFrame(
        [("p", "b1", 0, "paragraph", "t", 1, 1, box), ("p", "b2", 0, "paragraph", None, 2, 1, (1, -1.0, 1.0, 5.0, 5.0))],
        "paper_id string, block_id string, block_order int, block_role string, text string, page_start int, page_end int, bbox struct<page:int,x_left:double,y_top:double,width:double,height:double>",
    )
    a = spark.createDataFrame([("a", "p", "gone", 3, 2)], "id string, paper_id string, block_id string, start_offset int, end_offset int")
    v = M.violations({"blocks": b, "annotations": a}, M.package_rules())
    assert {r.code for r in v.collect()} == {"DUPLICATE_BLOCK_ORDER", "MISSING_TEXT", "PAGE_RANGE", "BOX", "BOX_PAGE", "ANNOTATION_BLOCK", "OFFSETS"}
    assert M.valid(v).first().ok is False and M.valid(v.limit(0)).first().ok is True
