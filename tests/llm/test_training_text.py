import itertools
import random
import unicodedata
from fractions import Fraction
from math import log

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectorium.llm import lookalike, queries, repetition, scannoise, truncation
from lectorium.llm.sentences import sentence_spans, with_sentences


def cut(t, lang=None):
    return [t[a:b] for a, b in sentence_spans(t, lang)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("We thank T. Halvek, cf. Table 7. Next.", 2),
        ("It rose to 4.5 in 2010, approx. 43.7 times. On 3 May it fell.", 2),
        ("One said, “It is so. Nothing else,” and left. We go.", 2),
        ("Critics call it “a label.” We disagree.", 2),
        ("As Lee et al. (2008) argue. See No. 120. We stop.", 3),
        ("Few asked why... the answer is court.", 1),
        ("Am 3. Mai 2020, z. B. hier, Nr. 5. Es gilt vgl. Tab. 3.", 2),
        ("Apparatus\nTwo coders came.", 2),
        ("explains 58.8%.Two coders", 2),
        ("問題だ。「これだけです。ほかはない」と述べた。次に、U. Xerox氏に感謝する。", 3),
        ("集めた．なぜ続くのか…答えは審理である．", 2),
        ("限られる。(訳注: 単位は原文のまま。)大きい。", 3),
        ("他说：“数据不够。还要再测。”然后离开了。完了。", 2),
        ("डॉ. Feyland ने यही विधि अपनाई थी। क्या यह ठीक है?", 2),
        ("جمع د. Kaldun البيانات في عام 2011. هل يمكن؟ نعم", 3),
        ("การทดลองนี้มีผู้เข้าร่วม 186 คน ข้อสรุปยังต้องตรวจสอบ", 2),
        ("ค่าเฉลี่ยเพิ่มขึ้นจาก 42.6 เป็น 81.1 ข้อสรุปยังต้องตรวจสอบ", 2),
        ("a TOTAL OF 3 RECORDS. wE DISAGREE, E.G. HERE. tHE END", 3),
        ("7. Discussion of it", 1),
        ("", 0),
        (" \n ", 0),
        (None, 0),
    ],
)
def test_sentences(text, want):
    assert len(cut(text)) == want if text else sentence_spans(text) == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_sentences_cover_all_visible_text(t):
    spans = sentence_spans(t)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    kept = "".join(t[a:b] for a, b in spans)
    gone = [c for c in t if not c.isspace() and unicodedata.category(c) != "Cf"]
    assert [c for c in kept if not c.isspace() and unicodedata.category(c) != "Cf"] == gone


def test_sentences_frame(spark, rows):
    d = spark.createDataFrame([(1, "An ox. Cats do.", "en", "x"), (2, None, None, "y"), (3, "", "xx", "z"), (1, "An ox. Cats do.", "en", "x")], "id int, text string, lang string, sentence string")
    assert rows(with_sentences(d, "text", "lang"), "id", "start_at", "sentence") == [(1, 0, "An ox."), (1, 0, "An ox."), (1, 7, "Cats do."), (1, 7, "Cats do.")]
    assert with_sentences(d.limit(0), "text", "lang").count() == 0


def form(*texts):
    return lookalike.fold(pa.array(texts, pa.string())).to_pylist()


def test_forms_that_look_the_same():
    pairs = [("Ｔｅｘｔ　１", "Text 1"), ("üb", "üb"), ("ｶﾞﾗｽ", "ガラス"), ("а​bс", "abc"), ("ベ", "べ"), ("力", "力"), ("a\xa0b c", "a b c"), ("タ", "夕"), ("Α", "A"), ("fol\xadlow", "follow"), ("ọ̈", "ọ̈"), ("a‑b", "a-b")]
    for a, b in pairs:
        x, y = form(a, b)
        assert x == y, (a, b, x, y)
    for a, b in [("2", "²"), ("a", "ä"), ("か", "が"), ("a", "A"), (".", "。"), ("っ", "つ"), ("a\nb", "a b"), ("'", "’")]:
        x, y = form(a, b)
        assert x != y, (a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=6))
def test_fold_is_idempotent_and_keeps_rows(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    once = form(*texts)
    assert len(once) == len(texts) and [x is None for x in once] == [x is None for x in texts]
    assert form(*once) == once


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeoäéがかﾞ゙̣̈́ｶﾊﾟ각", max_size=20))
def test_fold_agrees_on_equivalent_texts(t):
    assert form(unicodedata.normalize("NFC", t)) == form(unicodedata.normalize("NFD", t))


def test_same_look_pairs(spark, rows):
    d = spark.createDataFrame([(1, "k", "ab"), (2, "k", "аb"), (3, "k", "ab"), (4, "k", "ac"), (5, None, "ab"), (6, "k", None), (7, "q", "ab")], "id bigint, key string, t string")
    got = rows(lookalike.same_look_pairs(d, "x", "id", "key", "t"), "id_a", "id_b")
    assert got == [(1, 2), (2, 3)]
    assert lookalike.same_look_pairs(d.limit(0), "x", "id", "key", "t").count() == 0


def test_same_look_classes_agree_with_pairs(spark, rows):
    d = spark.createDataFrame([(1, "k", "ab"), (2, "k", "аb"), (3, "k", "ab"), (4, "k", "ac"), (5, None, "ab"), (6, "k", None), (7, "q", "ab")], "id bigint, key string, t string")
    got = rows(lookalike.same_look_classes(d, "x", "id", "key", "t"), "row_id", "class_id", "n_rows", "n_texts", "n_links")
    assert got == [(1, 1, 3, 2, 1), (2, 1, 3, 2, 2), (3, 1, 3, 2, 1), (4, 4, 1, 1, 0), (7, 7, 1, 1, 0)]
    assert sum(x[4] for x in got) == 2 * lookalike.same_look_pairs(d, "x", "id", "key", "t").count()
    assert lookalike.same_look_classes(d.limit(0), "x", "id", "key", "t").count() == 0


def brute_share(text):
    units, sizes, ja = (*repetition.units_of(text, repetition.is_japanese(text)), repetition.is_japanese(text))
    n = repetition.CHARS if ja else repetition.WORDS
    hit = [False] * len(units)
    for j in range(len(units) - n + 1):
        if any(units[i : i + n] == units[j : j + n] for i in range(j)):
            hit[j : j + n] = [True] * n
    return sum(s for s, h in zip(sizes, hit) if h) / max(1, sum(sizes))


def test_repeat_share_against_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cd ef, gh. ij\n kl".split(" ")) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["要する、" * 20, "", "—!", "o\u0301 é a\u200bb cd ef. " * 3, "短い文。" * 2]
    got = repetition.lines_of(texts).exact
    assert got.tolist() == pytest.approx([brute_share(t) for t in texts])
    assert got[60] > 0.7


def clean_texts(n, kinds=400):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(kinds)]
    return ["\n".join(" ".join(rng.choice(words) for _ in range(9)) + "." for _ in range(6)) for _ in range(n)]


def test_crf_marks_planted_repeats():
    clean = clean_texts(60)
    model = repetition.train(clean)
    loop = clean[0] + "\n" + "\n".join([clean[0].split("\n")[2]] * 8)
    phrase = "The trial began. " + "it was so " * 20 + clean[3]
    got = repetition.shares([loop, clean[1], None, "—!", clean[0] * 200, phrase, ""], model)
    assert got[0, 0] > 0.3 and got[1, 0] == 0 and np.isnan(got[2]).all() and got[3].tolist() == [0, 0] and got[4, 1] > 0.9
    assert 0.3 < got[5, 0] < 0.9 and got[6].tolist() == [0, 0]
    assert got[:2].tolist() == [*repetition.shares([loop], model).tolist(), *repetition.shares([clean[1]], model).tolist()]


def test_labels_are_the_planted_places():
    data = repetition.planted(clean_texts(200, 12))
    x, y = np.concatenate([f for f, _ in data]), np.concatenate([lab for _, lab in data])
    assert 0.05 < y.mean() < 0.9
    assert not any(np.array_equal(x[:, k] >= 0.5, y == 1) for k in range(x.shape[1]))
    model = repetition.train(clean_texts(200, 12))
    held = repetition.planted(clean_texts(260, 12)[200:], seed=3)
    hit = [repetition.viterbi(f, np.zeros(len(f), int), model) == lab for f, lab in held]
    assert np.concatenate(hit).mean() > 0.9


def test_viterbi_of_many_rows_at_once():
    rng = np.random.default_rng(3)
    model = {"emit": rng.normal(size=(4, 2)), "move": rng.normal(size=(2, 2))}
    size = [1, 7, 3, 7, 2]
    f = rng.normal(size=(sum(size), 4))
    row = np.repeat([0, 2, 3, 5, 9], size)
    cuts = np.split(np.arange(len(f)), np.cumsum(size)[:-1])
    alone = [repetition.viterbi(f[c], np.zeros(len(c), int), model) for c in cuts]
    assert np.array_equal(repetition.viterbi(f, row, model), np.concatenate(alone))
    for c, got in zip(cuts, alone):  # against all paths
        e = f[c] @ model["emit"]
        best = max(itertools.product((0, 1), repeat=len(c)), key=lambda z: sum(e[i, k] for i, k in enumerate(z)) + sum(model["move"][a, b] for a, b in zip(z, z[1:])))
        assert tuple(got) == best


def test_shares_frame(spark, rows):
    d = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (3, "one two three four five six. " * 4, 0.2)], "id int, t string, keep double")
    got = {r.id: r for r in repetition.with_shares(d.drop("keep"), "t", repetition.train([])).collect()}
    assert got[1].repeat_share is None and got[1].keep is None and got[2].repeat_share == 0 and got[2].keep and not got[3].keep
    assert repetition.with_shares(d.limit(0).drop("keep"), "t", repetition.train([])).count() == 0


def test_truncation_contexts_are_position_independent():
    a, b = truncation.Hashed(["^xx the end"]), truncation.Hashed(["^other words first", "^and so the end"])
    for order in (0, 1):
        assert a.at(np.array([10]), order)[0] == b.at(np.array([b.ends[1] - 1]), order)[0]
    assert truncation.exempt("2.4 結果: 著作権期間") and truncation.exempt("• a;\n• b") and not truncation.exempt("The model explains")


BASE = "The committee approved the study of sleep. We thank A. Lee for comments on sleep. It remains open whether sleep causes rest or merely follows it."
VALUES = "src_table string, row_key string, lang string, text string, follow string, plain_end boolean, source string"


def test_truncation_end_to_end(spark, rows):
    vals = [("t", str(i), "en", BASE, None, False, "m") for i in range(8)]
    vals += [("t", k, "en", x, y, False, "m") for k, x, y in (("cut", BASE + " The committee appro", None), ("bare", BASE + " We thank A. Lee for comments on sleep", None), ("on", "The committee approved the", "study of sleep. We thank."), ("h", "3.1 Results", None))]
    vals += [("t", k, "en", x, None, True, "m") for k, x in (("head", "Committee of sleep"), ("head cut", "Comments of the commit"), ("list", "• sleep;\n• rest"))]
    d = spark.createDataFrame(vals, VALUES)
    assert rows(truncation.cut_values(d).where("cut"), "row_key") == [("cut",), ("head cut",)]
    assert truncation.cut_values(d.limit(0)).count() == 0


def test_truncation_of_very_many_equal_ends(spark):
    """An end that thousands of texts have, and nothing else: its likelihood is nearer to 1 than a double can tell."""
    one = "Sleep is rest."
    d = spark.range(20_000).select(F.lit("t").alias("src_table"), F.col("id").cast("string").alias("row_key"), F.lit("en").alias("lang"), F.lit(one).alias("text"), F.lit(None).cast("string").alias("follow"), F.lit(False).alias("plain_end"), F.lit("m").alias("source"))
    got = truncation.cut_values(d).groupBy("log_odds", "cut", *[f"{c}{o}" for o in range(5) for c in "ec"]).count().collect()
    q = Fraction(98, 100)
    for o in range(5):
        q = (got[0][f"c{o}"] + 3 * q) / (got[0][f"e{o}"] + got[0][f"c{o}"] + 3)
    assert len(got) == 1 and got[0]["count"] == 20_000 and not got[0].cut and q < 1e-17
    assert got[0].log_odds == pytest.approx(float(-log(q.numerator) + log(q.denominator)))


def test_thresholds_are_fitted_by_column_and_language(spark, monkeypatch):
    """Planted ends far below, own ends far above: the threshold lies between; few values keep the default."""
    per = [("a", "en", 0, 1.0)] * 150 + [("a", "en", 1, -2.6)] * 150 + [("a", "de", 0, -1.6)] * 150 + [("a", "de", 1, -2.9)] * 150 + [("b", "en", 0, 1.0)] * 5
    d = spark.createDataFrame([(*x, x[2] == 0, False, False, False, 0) for x in per], "src_table string, lang string, planted int, o double, marked boolean, debris boolean, plain_end boolean, lower_next boolean, joined int")
    got = truncation.fitted(d, F.col("o"))
    assert set(got) == {("a", "en"), ("a", "de")} and -2.6 < got["a", "en"] <= 1 and -2.9 < got["a", "de"] <= -1.6


def test_thresholds_are_fitted_on_every_value(spark, monkeypatch, tmp_path):
    """Each of 60,000 whole values gives a whole and a planted end to the fit."""
    d = spark.range(60_000).withColumns({"paper_id": F.col("id").cast("string"), "block_id": F.col("id").cast("string"), "block_order": F.lit(0), "text": F.lit("Sleep is rest and nothing more.")})
    d = d.withColumns({"block_role": F.lit("paragraph"), "producer": F.lit("m"), "updated_at": F.current_timestamp()})
    d.write.parquet(str(tmp_path / "layout_blocks.parquet"))
    d.limit(0).select(F.col("id").alias("result_id"), F.col("updated_at").alias("ingested_at"), *[F.col("text").alias(c) for c in ("target_language", "text", "model", "model_version")]).write.parquet(str(tmp_path / "translation_results.parquet"))
    seen, fitted = {}, truncation.fitted

    def spy(per, odds):
        seen.update({r.planted: r["count"] for r in per.groupBy("planted").count().collect()})
        return fitted(per, odds)

    monkeypatch.setattr(truncation, "fitted", spy)
    assert queries.p3_found(spark, str(tmp_path)).count() == 0
    assert seen == {0: 60_000, 1: 60_000}


def test_skeletons_and_units():
    assert scannoise.skeleton("w0rking") == scannoise.skeleton("working") and scannoise.skeleton("cornments") == scannoise.skeleton("comments")
    assert scannoise.skeleton("reaclied") == scannoise.skeleton("reached")
    assert scannoise.units("", False, False) == [] and scannoise.units("12 3.4", False, False) == []


def test_scan_noise(spark, rows):
    good = ["the committee approved the study of memory in this working group", "we thank the committee for comments on working memory"] * 30
    lines, k = [], 0
    for page in range(1, 7):
        body = ["Lee and Kim", *good[page * 5 : page * 5 + 6], f"{page}"]
        for n, t in enumerate(body):
            y = 40.0 if n == 0 else 760.0 if n == 7 else 60.0 + 18 * n
            lines.append((k, "p", page, n, "ocr", t, y))
            k += 1
    lines[10] = (*lines[10][:5], "the cornmittee approved the study of wor-", lines[10][6])
    lines[11] = (*lines[11][:5], "king memory in this w0rking group", lines[11][6])
    d = spark.createDataFrame(lines, "line_id bigint, paper_id string, page int, line_no int, origin string, text string, y_top double")
    b = spark.createDataFrame([("p", "b", 1, 1, None)], "paper_id string, block_id string, page_start int, page_end int, text string")
    got = rows(scannoise.noise(d, b), "row_key", "noise_kind")
    assert got.count(("10", "misread")) == 1 and ("10", "hyphen") in got and ("11", "misread") in got
    assert sum(k == "header" for _, k in got) == 6 and sum(k == "page_number" for _, k in got) == 6
    assert len(got) == 15
    assert scannoise.noise(d.limit(0), b.limit(0)).count() == 0


def test_paragraphs_are_continuous(spark, rows):
    text = ["We thank the committee for com-", "ments on w0rking memory and sleep,", "which is long-", "term work.", "Results", "The committee for comments on working memory met", "in long-term rooms of the committee."]
    lines = [(i, "p", 1, i, "ocr", t, 70.0 + 18 * i) for i, t in enumerate(text)]
    lines += [(100 + i, "q", 1, i, "structure", "comments on working memory in the long-term committee", 70.0 + 18 * i) for i in range(9)]
    lines += [(50, "p", 1, 50, "ocr", "7", 770.0), (60, "p", 2, 0, "ocr", "And on the next page, 日本.", 70.0)]
    d = spark.createDataFrame(lines, "line_id bigint, paper_id string, page int, line_no int, origin string, text string, y_top double")
    b = spark.createDataFrame([("p", "b", 1, 1, "So it was in the com-\n- 1 -\nments on working mem0ry.")], "paper_id string, block_id string, page_start int, page_end int, text string")
    got = [r.text for r in scannoise.paragraphs(d, b).where("paper_id = 'p'").orderBy("src_table", "para").collect()]
    assert got[0] == "So it was in the comments on working memory."
    assert got[1] == "We thank the committee for comments on working memory and sleep, which is long-term work."
    assert got[2] == "Results" and not any("7" in g for g in got)
    assert scannoise.paragraphs(d.limit(0), b.limit(0)).count() == 0
