import string

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectorium.llm import subjects


def test_rare_terms_count_beside_many_frequent_ngrams(spark):
    """Over 60,000 n-grams that are more frequent do not push out the one term that tells a subject."""
    words = [a + b + "o" for a in string.ascii_lowercase for b in string.ascii_lowercase][:250]
    texts = [" ".join(f"{words[i]} {w}" for w in words[i:]) + "." for i in range(250)]
    docs = [(i, t) for i, t in enumerate(texts * 4)]
    docs += [(k, "Zyxer quvarn.") for k in range(5000, 5004)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, "a") for i in range(20)] + [(5000, "b"), (5001, "b"), (5002, "b")], "doc_id bigint, subject_code string")
    got = subjects.subjects_of(*subjects.scored(d, labels)).where("doc_id = 5003").collect()
    assert [r.subject_code for r in got] == ["b"]


def test_texts_of_unknown_words_have_the_usual_subject(spark):
    d = spark.createDataFrame([(i, "The court held the appeal. A statute is a contract.") for i in range(6)] + [(i, "A goal in the league. The coach ran.") for i in range(6, 10)] + [(20, "Съешь ещё этих булок."), (21, "123 456"), (22, "안녕하세요"), (23, ""), (24, None)], "doc_id bigint, text string")
    la = spark.createDataFrame([(0, "sport"), (1, "law"), (2, "law"), (3, "law"), (7, "sport"), (8, "sport"), (1, None), (9, "sport")], "doc_id bigint, subject_code string")
    got = {r.doc_id: r.subject_code for r in subjects.subjects_of(*subjects.scored(d, la)).collect()}
    assert [got[k] for k in (20, 21, 22)] == ["sport"] * 3 and not {23, 24} & set(got) and got[5] == "law"
    assert subjects.subjects_of(*subjects.scored(d, la.limit(0))).count() == 0
    assert subjects.subjects_of(*subjects.scored(d.limit(0), la)).count() == 0


def test_rare_ngrams_are_joined(spark, monkeypatch):
    words = {"law": "court statute verdict contract appeal".split(), "sport": "sprint goal marathon league coach".split()}
    docs = [(i, " ".join(f"The {w} and the {v} of {i % 7} were seen." for w, v in zip(words[c], reversed(words[c])))) for i in range(60) for c in [("law", "sport")[i % 2]]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    la = spark.createDataFrame([(i, ("law", "sport")[i % 2]) for i in range(30)], "doc_id bigint, subject_code string")
    run = lambda: {tuple(r) for r in subjects.subjects_of(*subjects.scored(d, la)).collect()}
    want = run()
    assert want == {(i, ("law", "sport")[i % 2]) for i in range(60)}
    monkeypatch.setattr(subjects, "AT_HAND", 4)
    assert run() == want


def test_posteriors_against_a_plain_sum():
    """Scores of a batch of documents against sums over the longest known n-grams, token by token."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdef"), 8)) + ". " + " ".join(rng.choice(list("abcdef"), 5)) + "." for _ in range(7)] + ["7 8."]
    b = subjects.Batch(next(subjects._tokenised([pd.DataFrame({"doc_id": range(8), "text": texts})])))
    gram, *_ = b.grams()
    some = rng.choice(np.unique(gram), 60, replace=False)
    models = subjects.Models(some, rng.normal(size=(60, 3)), 3)
    at = {g: models.ratio[i] for i, g in enumerate(models.gram.tolist())}
    two, three = dict(zip(b.at2.tolist(), b.two[b.at2].tolist())), dict(zip(b.at3.tolist(), b.three.tolist()))
    want = np.zeros((len(b.sentence_size), 3))
    for i, g in enumerate(b.one.tolist()):
        hit = next((at[x] for x in (three.get(i), two.get(i), g) if x in at), None)
        if hit is not None:
            want[b.sentence[i]] += hit
    assert np.allclose(models.posteriors(b)[0], want, atol=1e-5)


def test_language_is_that_of_the_whole_text():
    english, german = "The court held that the claim was late. ", "Der Richter und die Kammer fanden, dass die Klage nicht zulässig ist. "
    assert subjects.language(english * 60 + german * 200) == "de"
    assert subjects.language(german * 40 + english * 400) == "en"


def test_acceptance_is_calibrated_on_every_labelled_document(spark):
    """45,000 documents: of the 20,000 with the least digests the further subject is wrong at a gain of 0.28, of all others right at 0.12."""
    d = spark.range(45_000).withColumnRenamed("id", "doc_id").withColumn("few", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"))) <= 20_000)
    row = lambda subject, gain, mass: d.select("doc_id", F.lit(subject).alias("subject"), F.lit(6).alias("n_sentences"), F.lit(3).alias("n"), gain.alias("gain"), F.lit(mass).alias("mass"))
    ev = row(0, F.lit(0.6), 0.7).unionByName(row(1, F.when(F.col("few"), 0.28).otherwise(0.12), 0.3))
    labels = d.select("doc_id", F.lit(0).alias("subject")).unionByName(d.where("NOT few").select("doc_id", F.lit(1).alias("subject")))
    assert subjects.calibrated(ev, labels) == (0.11, 2)
