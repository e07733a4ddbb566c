from pyspark.sql import functions as F

from lectorium.functions import predicates as P
from lectorium.operators import quality as Q
from lectorium.operators import structure as S


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_section_kinds_and_labels(spark):
    d = one(spark, [("2.1 Related Work",), ("はじめに",), ("IV. Results",), ("Odds",), (None,)], "t string")
    assert [r[0] for r in d.select(P.section_kind(F.col("t"))).collect()] == ["related_work", "introduction", "results", "other", None]
    c = one(spark, [("Figure 3. A by B",), ("図4　あ",), ("Text",)], "t string")
    assert [tuple(r) for r in c.select(P.caption_label(F.col("t")), P.caption_body(F.col("t"))).collect()] == [("Figure 3", "A by B"), ("図4", "あ"), (None, "Text")]


def test_equations_are_not_sentences(spark):
    d = one(spark, [("E = mc^2",), ("x + y = z",), ("the mean was = 3 and = 4",), ("p < .05 = t",)], "t string")
    assert [r[0] for r in d.select(P.equation_like(F.col("t"))).collect()] == [True, True, False, False]


def test_fusion(spark):
    v = one(spark, [("k", "a", "X", 0.9, 1), ("k", "b", "Y", 0.5, 0), ("k", "b", "Y", 0.5, 2), ("t", "a", "P", 0.5, 1), ("t", "a", "Q", 0.5, 0)], "key string, source string, value string, confidence double, ord int")
    got = {r.key: r.value for r in S.fused(v, {"a": 1.0, "b": 0.5}, "key").collect()}
    assert got == {"k": "X", "t": "Q"}


def test_topological_order_and_cycles():
    assert S.topological(["c", "a", "b"], [("a", "b")]) == ["c", "a", "b"]
    assert S.topological(["b", "a"], [("a", "b")]) == ["a", "b"]
    assert S.topological(["a", "b"], [("a", "b"), ("b", "a")]) is None


def test_affiliations_by_marker_single_and_place(spark):
    sch = "doc string, id string, ord int, markers array<string>"
    a = one(spark, [("m", "a1", 0, ["1"]), ("m", "a2", 1, ["2"]), ("s", "b1", 0, []), ("s", "b2", 1, []), ("z", "c1", 0, []), ("z", "c2", 1, [])], sch)
    f = one(spark, [("m", "x", 0, ["2"]), ("m", "y", 1, ["1"]), ("s", "u", 0, []), ("z", "v", 0, []), ("z", "w", 1, [])], sch)
    got = {(r.source, r.target) for r in S.affiliated(a, f, "doc").collect()}
    assert got == {("a1", "y"), ("a2", "x"), ("b1", "u"), ("b2", "u"), ("c1", "v"), ("c2", "w")}


def test_affiliations_do_not_pair_whole_documents(spark):
    """Several shared markers give one edge; 40,000 x 4,000 rows of one document used to be 160 million pairs."""
    sch = "doc string, id string, ord int, markers array<string>"
    a = one(spark, [("m", "a1", 0, ["1", "2", None]), ("m", "a2", 1, [None]), ("m", "a3", 1, None), ("k", "d", 0, ["9"]), ("p", "e1", 0, ["1"]), ("p", "e2", 1, ["7"])], sch)
    f = one(spark, [("m", "x", 0, ["2", "1", "2"]), ("m", "y", 1, [None, "3"]), ("m", "z", 1, []), ("k", "u", 3, ["8"]), ("p", "v", 0, ["2", "1"]), ("p", "w", 1, ["1"])], sch)
    got = [(r.source, r.target) for r in S.affiliated(a, f, "doc").collect()]
    assert sorted(got) == [("a1", "x"), ("a2", "y"), ("a2", "z"), ("a3", "y"), ("a3", "z"), ("d", "u"), ("e1", "v"), ("e1", "w"), ("e2", "w")]
    many = lambda n, k: spark.range(n).select(F.lit("d").alias("doc"), F.col("id").cast("string").alias("id"), F.lit(0).alias("ord"), F.array((F.col("id") * k).cast("string")).alias("markers"))
    d = S.affiliated(many(40_000, 1), many(4_000, 10), "doc")
    assert d.count() == 4_000
    assert "Window" not in d._jdf.queryExecution().executedPlan().toString()


def test_lines_join_across_hyphens(spark):
    d = one(spark, [(["A com-", "mon word, pre-", "and post-war"],), (["one"],), ([],)], "t array<string>")
    assert [r[0] for r in d.select(S.hyphen_joined(F.col("t"))).collect()] == ["A common word, pre- and post-war", "one", ""]


def test_copies_and_loops(spark):
    long_ = "This sentence is surely longer than forty characters."
    d = one(spark, [(long_ + " Short.", "訳。" + long_), (long_, "訳"), ("Short.", "Short.")], "s string, o string")
    assert [r[0] for r in d.select(Q.source_copied(F.col("s"), F.col("o"))).collect()] == [True, False, False]
    t = one(spark, [("a b c d e " * 4,), ("a b c d e f",), ("",)], "t string")
    assert [r[0] for r in t.select(Q.five_gram_loop(F.col("t"))).collect()] == [True, False, False]


def test_batches_hold_both_limits(spark):
    j = one(spark, [(i, 100 + i, "b", 0) for i in range(60)], "job_id int, size int, bucket string, shard int")
    g = Q.batch_plan(j, most=10, budget=1300).groupBy("batch").agg(F.count("*").alias("n"), F.max("size").alias("m")).collect()
    assert sum(r.n for r in g) == 60 and all(r.n <= 10 and r.n * r.m <= 1300 for r in g)
