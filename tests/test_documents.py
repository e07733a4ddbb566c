import random

from pyspark.sql import functions as F

from lectorium import session
from lectorium.functions import flags as X
from lectorium.operators import documents as D
from lectorium.operators import merge as M


def test_signs_of_degenerate_text():
    assert X.signs(" \n") == ["empty"] and X.signs("A plain sentence about memory.") == []
    assert X.signs("aaaaaaaa") == ["run"] and X.signs("x <0xE3> y") == ["bytes"] and X.signs("x ⟦Z0Q1⟧") == ["placeholder"]
    assert "script" in X.signs("한국어 text") and "dominant" in X.signs("abababacadaeafagaha")
    assert "phrase" in X.signs("実験の結果は良い。" * 6) and "few_kinds" in X.signs("ab" * 30)
    assert "splinters" in X.signs(" ".join("これ" for _ in range(30)) + " で す が 良い 日 です ね 本当 に そう 思う よ")


def test_foreign_share_and_bare_facts():
    assert X.foreign_share("about BERT", "BERTは良いモデルである") == 0.0 and X.foreign_share(None, None) == 0.0
    assert X.foreign_share("about BERT", "completely untranslated words") == 1.0
    long_ = "The source is long enough to be judged. " * 4
    assert X.bare_facts(long_, "これは文である。[1] 2019 BERT。") and not X.bare_facts(long_, "これは文である。2019年のBERTである。")
    assert not X.bare_facts("short", "これは文である。BERT。") and not X.bare_facts(None, None)


def test_authors_of_a_line():
    assert D.authors_of("A. Lee*, B. Kim2 and Éva Ito; C. Mo") == ["A. Lee", "B. Kim", "Éva Ito", "C. Mo"]
    assert D.authors_of("山田 太郎 鈴木 花子") == ["山田 太郎", "鈴木 花子"] and D.authors_of("山田 太郎、鈴木 花子") == ["山田 太郎", "鈴木 花子"]
    assert D.authors_of(None) == [] and D.authors_of(" ") == []


def test_titles_join_lines_and_hyphens(spark):
    d = spark.createDataFrame([("d", 1, 1, "A study of mem-", 18.0), ("d", 1, 2, "ory and sleep", 18.0), ("d", 1, 3, "Lee", 10.0), ("d", 2, 1, "Big", 30.0), ("e", 1, 1, " ", 9.0), ("f", 1, 1, None, None)], "doc string, page int, line_no int, text string, font_size double")
    assert [tuple(r) for r in D.titles(d, "doc").collect()] == [("d", "A study of memory and sleep")]
    assert D.titles(d.limit(0), "doc").count() == 0


def test_memberships_are_unique(spark):
    m = spark.createDataFrame([("a", "p"), ("b", "p"), ("a", "q")], "node string, item string")
    new = spark.createDataFrame([("a", "p"), ("c", "p"), ("c", "p")], "node string, item string")
    assert sorted(map(tuple, D.added(m, new, ["node", "item"]).collect())) == [("a", "p"), ("a", "q"), ("b", "p"), ("c", "p")]
    moves = spark.createDataFrame([("p", "a", "b"), ("q", "a", "z"), ("x", "a", "z")], "item string, from_node string, to_node string")
    assert sorted(map(tuple, D.moved(m, moves, "node", "item").collect())) == [("b", "p"), ("z", "q")]


def test_first_json_array(spark):
    d = spark.createDataFrame([('x [{"a": 1}, {"a": 2}] [3]',), ("none",), (None,)], "t string")
    assert [r[0] and [x.a for x in r[0]] for r in d.select(D.json_entries(F.col("t"), "array<struct<a:int>>")).collect()] == [[1, 2], None, None]


def test_pair_scores_follow_their_rules(spark):
    cols = "doc string, id string, kind string, page int, text string, section string, box_page int, x double, y double"
    old = spark.createDataFrame([("d", "a", "p", 1, "The  whole Text of it", "s", 1, 10.0, 10.0), ("d", "b", "f", 1, None, None, 1, 50.0, 50.0), ("d", "c", "p", 2, "", "", 2, 0.0, 0.0)], cols)
    new = spark.createDataFrame([("d", "x", "p", 1, "the whole text of it", "s", 1, 21.9, 10.0), ("d", "y", "f", 1, None, None, 1, 50.0, 62.0), ("d", "z", "p", 3, "whole text", None, 3, 0.0, 0.0)], cols)
    got = {(r.o_id, r.n_id): r.score for r in M.pair_scores(old, new, "doc").collect()}
    assert got["a", "x"] == 16 and got["b", "y"] == 4 and got["a", "z"] == 6 and ("c", "z") not in got
    assert M.pair_scores(old.limit(0), new, "doc").count() == 0
    m = M.reconciled(M.pair_scores(old, new, "doc"), "doc").collect()
    assert [(r.o_id, r.n_id) for r in m] == [("a", "x")]


BLOCK = "doc string, id string, kind string, page int, text string, section string, box_page int, x double, y double"


def test_equal_blocks_are_matched_without_rounds(spark):
    """Equal texts of one document tie: each used to take a round of stored tables."""
    n = 120
    p = spark.createDataFrame([("d", f"o{a:03}", f"n{b:03}", 10) for a in range(n) for b in range(n)], "doc string, o_id string, n_id string, score int")
    before = len(session._STORED)
    got = M.reconciled(p, "doc")
    assert sorted((r.o_id, r.n_id) for r in got.collect()) == [(f"o{k:03}", f"n{k:03}") for k in range(n)]
    assert len(session._STORED) == before


def by_hand(old: list, new: list) -> dict:
    """Scores by the rules, pair by pair."""
    norm = lambda t: " ".join((t or "").lower().split())
    out = {}
    for o in old:
        for w in new:
            a, b = norm(o[4]), norm(w[4])
            s = 2 * (o[2] == w[2]) + 2 * (o[3] == w[3]) + (0 if not a or not b else 8 if a == b else 4 if a in b or b in a else 0)
            s += bool(o[5] and o[5] == w[5]) + 3 * (o[6] == w[6] and abs(o[7] - w[7]) < 12 and abs(o[8] - w[8]) < 12)
            if o[0] == w[0] and s >= 6:
                out[o[0], o[1], w[1]] = s
    return out


def some_blocks(seed: int, prefix: str, n: int = 150) -> list:
    r = random.Random(seed)
    words = ["memory", "sleep", "Results", "of", "a", "記憶", "x", "The model of memory and sleep was"]
    return [(f"d{r.randrange(3)}", f"{prefix}{k}", r.choice("ph"), r.randrange(1, 5), r.choice([None, "", *[" ".join(r.choices(words, k=r.randrange(1, 6))) for _ in range(4)]]), r.choice([None, "", "l"]), r.randrange(1, 5), r.uniform(0, 40), r.uniform(0, 40)) for k in range(n)]


def test_pairs_and_matches_agree_with_all_pairs(spark):
    old, new = some_blocks(1, "o"), some_blocks(2, "n")
    new += [(d, "n" + i, *rest) for d, i, *rest in old[::2]]
    want = by_hand(old, new)
    blocks = M.sides(spark.createDataFrame(old, BLOCK), spark.createDataFrame(new, BLOCK), "doc")
    got = M.scored_pairs(blocks, "doc").collect()
    assert len(got) == len(want) and {(r.doc, r.o_id, r.n_id): r.score for r in got} == want
    greedy, used = [], set()
    for (d, o, w), s in sorted(want.items(), key=lambda x: (-x[1], x[0])):
        if not used & {(d, o), (d, w)}:
            used |= {(d, o), (d, w)}
            greedy.append((d, o, w, s))
    assert sorted(map(tuple, M.reconciled_blocks(blocks, "doc").collect())) == sorted(greedy)
    assert M.reconciled_blocks(blocks.limit(0), "doc").count() == 0


def test_remapped_notes_of_unchanged_blocks_move_no_text(spark):
    """Blocks that stay as they are on their page are matched before texts are looked for in each other."""
    same = [("d", f"b{k}", "p", k // 3, f"The text of block {k} stays as it is.", "l", k // 3, 10.0, 100.0 * k) for k in range(60)]
    df = spark.createDataFrame(same, BLOCK)
    seen = []
    try:
        whole, M._all_pairs = M._all_pairs, lambda d, doc: seen.append(d.count()) or whole(d, doc)
        m = M.reconciled_blocks(M.sides(df, df.withColumn("id", F.concat(F.lit("n-"), "id")), "doc"), "doc")
        back = M.remapped(df.select("doc", F.col("id").alias("block")), m, ["doc"], "block")
        assert sorted(r.block for r in back.collect()) == sorted("n-" + r[1] for r in same)
    finally:
        M._all_pairs = whole
    assert seen == [0]
