"""Subject areas of documents.

Method: for each subject an interpolated n-gram language model (orders 1 to 3, of words, or of signs in scripts
without blanks) is trained on the labelled documents and smoothed towards a background model of all documents.
Each sentence goes to the subject under which its cross-entropy is least; a subject's gain in a document is the
cross-entropy that its sentences save, token by token, against the mixture of all subjects, as a part of the most
that a text of so many sentences could save.  How great the gain and
how many the sentences of a further subject must be is calibrated on all labelled documents.

Training is repeated once on the sentences that the first models place with confidence, over all
documents, so that wrong labels and mixed documents do not blur the models.

Scale: texts are folded, split and hashed once, into a stored table of token digests; all later passes are numpy
on whole batches.  n-grams are counted per batch, then by digest; those that occur ``LEAST`` times or more form
the models, whose interpolation is a chain of joins.  The ``AT_HAND`` most frequent n-grams travel with the tasks;
all rarer ones are joined to the documents that hold them.

Defined results: null and blank texts have no subject; every other document has at least one, the best
supported one, ties by code; a text without any known token has the most frequent subject of the labels; without
any label there is no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectorium.llm.lookalike import fold
from lectorium.llm.sentences import sentence_spans
from lectorium.session import stored

#: Pull of order 1 to the background, of order 2 to order 1, of order 3 to order 2 (of words, of Japanese signs).
MU = (600.0, 4.0, 100.0, 2.0)
#: Occurrences from which an n-gram has a say, and how many of the most frequent n-grams travel with the tasks.
LEAST, AT_HAND = 3, 300_000
#: Posterior from which a sentence trains the second models, and from which it counts for its subject.
CONFIDENT, WON = 0.8, 0.5
_ALONE = r"\p{Hiragana}\p{Katakana}\p{Han}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー々"
_WORD = regex.compile(rf"[[\p{{L}}\p{{M}}]--[{_ALONE}]]+|[{_ALONE}]\p{{M}}*", regex.V1)
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_HYPHEN = regex.compile(r"(?<=\p{L})[-‐¬­]\s*\n\s*(?=\p{Ll})")
_WRAP = regex.compile(r"(?<![.!?。．！？”」])\s*\n\s*")
_DE = regex.compile(r"\b(?:der|die|das|und|von|wurde|mit|für|ist|bei|nicht)\b", regex.I)
_EN = regex.compile(r"\b(?:the|and|of|to|with|for|by|is|not)\b", regex.I)
_LATIN, _LETTER = regex.compile(r"\p{Latin}+"), regex.compile(r"\p{L}+")


def language(text: str) -> str:
    """By the script and the function words of the whole text: a passage in another language does not decide.
    Languages of other scripts are told apart by their letters, so they share the name ''."""
    if _KANA.search(text):
        return "ja"
    if not text.isascii() and 2 * sum(map(len, _LATIN.findall(text))) < sum(map(len, _LETTER.findall(text))):
        return ""
    german = len(_DE.findall(text))
    return "de" if german * 40 > len(text) / 6 and german > len(_EN.findall(text)) else "en"


def sentences(text: str) -> tuple[str, list[list[str]]]:
    lang = language(text)
    t = _WRAP.sub("" if lang == "ja" else " ", _HYPHEN.sub("", text)) if "\n" in text else text
    return lang, [w for a, b in sentence_spans(t, lang or None) if (w := _WORD.findall(t[a:b].lower()))]


_TOKENS = "doc_id long, lang string, tokens array<long>, lengths array<int>"


def _tokenised(frames):
    """Of each text the digests of its tokens (of language and word), and the tokens in each sentence."""
    known: dict[tuple[str, str], int] = {}
    for f in frames:
        rows = []
        for k, text in zip(f.doc_id, fold(pa.array(f.text, pa.string())).to_pylist()):
            lang, ss = sentences(text)
            out = []
            for s in ss:
                for w in s:
                    d = known.get((lang, w))
                    if d is None:
                        d = known[lang, w] = xxhash.xxh64_intdigest(f"{lang} {w}") - (1 << 63)
                    out.append(d)
            if len(known) > 1_000_000:
                known.clear()
            rows.append((k, lang, out, [len(s) for s in ss]))
        yield pd.DataFrame(rows, columns=["doc_id", "lang", "tokens", "lengths"])


#: Tokens that are worked on at once; a longer text is a part of its own.
PART = 400_000


def _parts(frames):
    """Runs of documents of about ``PART`` tokens, so memory does not depend on the size of Arrow batches."""
    for f in frames:
        at = np.cumsum([len(x) for x in f.tokens]) // PART
        for k in np.unique(at):
            yield f[at == k].reset_index(drop=True)


def _joined(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    """Digests of two digests in order."""
    h = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b.view(np.uint64) ^ np.uint64(order * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h.view(np.int64)


class Batch:
    """Tokens of many documents, flat, with the n-grams that end at each."""

    def __init__(self, f: pd.DataFrame):
        self.docs, self.lang = len(f), f.lang.to_numpy()
        lengths = [np.asarray(x, np.int64) for x in f.lengths]
        self.sentence_size = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.sentence_doc = np.repeat(np.arange(self.docs), [len(x) for x in lengths])
        self.one = np.concatenate([np.asarray(x, np.int64) for x in f.tokens]) if self.docs else np.zeros(0, np.int64)
        self.sentence = np.repeat(np.arange(len(self.sentence_size)), self.sentence_size)
        self.begin = np.cumsum(self.sentence_size) - self.sentence_size
        at = np.arange(len(self.one)) - self.begin[self.sentence] if len(self.one) else np.zeros(0, np.int64)
        self.at2, self.at3 = np.flatnonzero(at >= 1), np.flatnonzero(at >= 2)
        two = np.zeros(len(self.one), np.int64)
        two[self.at2] = _joined(self.one[self.at2 - 1], self.one[self.at2], 2)
        self.two, self.three = two, _joined(two[self.at3 - 1], two[self.at3], 3)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest, order, digest of the head, digest of the tail, token at the end) of every n-gram."""
        a2, a3, none = self.at2, self.at3, np.zeros(len(self.one), np.int64)
        return (
            np.concatenate([self.one, self.two[a2], self.three]),
            np.repeat([1, 2, 3], [len(self.one), len(a2), len(a3)]),
            np.concatenate([none, self.one[a2 - 1], self.two[a3 - 1]]),
            np.concatenate([none, self.one[a2], self.two[a3]]),
            np.concatenate([np.arange(len(self.one)), a2, a3]),
        )


_COUNTS = "lang string, gram long, ord int, head long, tail long, subject int, n double"
BACKGROUND = -1


def _counted(b: Batch, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Counts of n-grams: of each part (tokens, their subjects, their weights)."""
    gram, order, head, tail, end = b.grams()
    u, first, code = np.unique(gram, return_index=True, return_inverse=True)
    out = [pd.DataFrame({"i": np.arange(len(u)), "subject": BACKGROUND, "n": np.bincount(code, minlength=len(u)).astype(float)})]
    by_end = np.argsort(end, kind="stable")
    from_, to = np.searchsorted(end[by_end], np.arange(len(b.one))), np.searchsorted(end[by_end], np.arange(len(b.one)), side="right")
    for token, subject, weight in parts:
        if not len(token):
            continue
        size = to[token] - from_[token]
        at = by_end[np.repeat(from_[token], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        wide = int(subject.max()) + 1
        pair, which = np.unique(code[at] * wide + np.repeat(subject, size), return_inverse=True)
        out.append(pd.DataFrame({"i": pair // wide, "subject": pair % wide, "n": np.bincount(which, np.repeat(weight, size))}))
    d = pd.concat(out, ignore_index=True)
    at = first[d.pop("i").to_numpy()]
    lang = b.lang[b.sentence_doc[b.sentence[end[at]]]] if len(at) else []
    return d.assign(lang=lang, gram=gram[at], ord=order[at], head=head[at], tail=tail[at])[["lang", "gram", "ord", "head", "tail", "subject", "n"]].astype({"ord": "int32", "subject": "int32"})


def _count(frames):
    """n-grams of whole documents, for the background and for each label; a document of several labels counts for
    each by its part."""
    for f in _parts(frames):
        b = Batch(f)
        codes = [np.asarray(c if c is not None else (), np.int64) for c in f.codes]
        n = np.array([len(c) for c in codes])
        doc = b.sentence_doc[b.sentence] if len(b.one) else np.zeros(0, np.int64)
        size = n[doc]
        token = np.repeat(np.arange(len(doc)), size)
        start = np.cumsum(n) - n
        every = np.concatenate(codes) if len(codes) else np.zeros(0, np.int64)
        at = start[doc[token]] + np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        yield _counted(b, [(token, every[at], 1.0 / n[doc[token]])])


class Models:
    """Interpolated log-ratios of all subjects to the background, by n-gram digest."""

    def __init__(self, gram: np.ndarray, ratio: np.ndarray, n_subjects: int):
        order = np.argsort(gram)
        self.gram, self.ratio, self.n = gram[order], ratio[order].reshape(len(gram), n_subjects).astype(np.float32), n_subjects

    def with_rare(self, more: pd.Series | None) -> Models:
        """Also the n-grams that were joined to the documents of a batch."""
        rows = [x for each in more if each is not None for x in each] if more is not None else []
        if not rows:
            return self
        gram, at = np.unique(np.array([x["gram"] for x in rows], np.int64), return_index=True)
        ratio = np.array([rows[i]["ratio"] for i in at], np.float32).reshape(len(at), self.n)
        return Models(np.concatenate([self.gram, gram]), np.concatenate([self.ratio, ratio]), self.n)

    def place(self, gram: np.ndarray) -> np.ndarray:
        """Rows of n-grams, -1 for unknown ones."""
        if not len(self.gram):
            return np.full(len(gram), -1)
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        return np.where(self.gram[at] == gram, at, -1)

    def posteriors(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Per sentence and subject: sum over tokens of the log-ratio to the background, by the longest known
        n-gram; and the posterior, in which an ambiguous sentence is read in the light of its document."""
        row = self.place(b.one)
        for at, gram in ((b.at2, b.two[b.at2]), (b.at3, b.three)):
            longer = self.place(gram)
            row[at] = np.where(longer >= 0, longer, row[at])
        known = np.flatnonzero(row >= 0)
        s = np.zeros((len(b.sentence_size), self.n))
        for i in range(0, len(known), 1_000_000):
            k = known[i : i + 1_000_000]
            first = np.flatnonzero(np.diff(b.sentence[k], prepend=-1))
            s[b.sentence[k][first]] += np.add.reduceat(self.ratio[row[k]].astype(float), first, axis=0)
        e = np.exp(s - s.max(1, keepdims=True)) if len(s) else s
        post = e / e.sum(1, keepdims=True)
        total = np.zeros((b.docs, self.n))
        np.add.at(total, b.sentence_doc, post)
        prior = total / np.maximum(np.bincount(b.sentence_doc, minlength=b.docs), 1)[:, None] + 0.02
        e = e * prior[b.sentence_doc]
        return s, e / e.sum(1, keepdims=True)


def _recount(models: Models):
    def run(frames):
        for f in _parts(frames):
            b = Batch(f)
            _, post = models.with_rare(f.get("more")).posteriors(b)
            best, sure = post.argmax(1) if len(post) else np.zeros(0, int), (post.max(1) if len(post) else np.zeros(0)) >= CONFIDENT
            token = np.flatnonzero(sure[b.sentence]) if len(b.one) else np.zeros(0, int)
            yield _counted(b, [(token, best[b.sentence[token]], np.ones(len(token)))])

    return run


def _interpolated(counts: DataFrame, n_subjects: int) -> DataFrame:
    """gram, bg (count in the background), ratio (log-ratio of each subject to the background).

    The share of an n-gram behind its head is drawn to that of its tail, which is one shorter: three joins by digest.
    """
    by = F.array(*[F.sum(F.when(F.col("subject") == i, F.col("n")).otherwise(0.0)) for i in range(n_subjects)])
    bg = F.sum(F.when(F.col("subject") == BACKGROUND, F.col("n")).otherwise(0.0))
    t = stored(counts.groupBy("lang", "gram", "ord", "head", "tail").agg(bg.alias("bg"), by.alias("by")).where(F.col("bg") >= LEAST))
    one = t.where("ord = 1")
    total = one.groupBy("lang").agg(F.sum("bg").alias("_bg"), F.array(*[F.sum(F.col("by")[i]) for i in range(n_subjects)]).alias("_by"))
    each = lambda f, *c: F.zip_with(*c, f)
    one = one.join(F.broadcast(total), "lang").withColumn("base", F.col("bg") / F.col("_bg"))  # a row for each name that language() gives
    one = one.withColumn("p", each(lambda x, s: (x + MU[0] * F.col("base")) / (s + MU[0]), "by", "_by"))
    one = one.select("gram", "bg", "by", "base", "p")
    out, lower = one, one
    for order in (2, 3):
        mu = F.when(F.col("lang") == "ja", MU[3] if order == 3 else MU[1]).otherwise(MU[order - 1])
        head = lower.select(F.col("gram").alias("head"), F.col("bg").alias("_bg"), F.col("by").alias("_by"))
        tail = lower.select(F.col("gram").alias("tail"), F.col("base").alias("_base"), F.col("p").alias("_p"))
        d = t.where(F.col("ord") == order).join(head, "head").join(tail, "tail")
        d = d.withColumn("base", (F.col("bg") + mu * F.col("_base")) / (F.col("_bg") + mu))
        d = d.withColumn("_mu", mu).withColumn("p", each(lambda x, s: x / (s + F.col("_mu")), each(lambda x, q: x + F.col("_mu") * q, "by", "_p"), "_by"))
        lower = d.select("gram", "bg", "by", "base", "p")
        if order == 2:
            lower = stored(lower)
        out = out.unionByName(lower)
    return stored(out.select("gram", "bg", F.transform("p", lambda x: F.log(x / F.col("base")).cast("float")).alias("ratio")))


def _models(table: DataFrame, docs: DataFrame, n_subjects: int) -> tuple[Models, DataFrame]:
    """The models at hand, and the documents, with the rarer n-grams they hold (``more``) if there are any."""
    steps = table.groupBy("bg").agg(F.count("*").alias("k")).withColumn("up", F.sum("k").over(Window.orderBy(F.desc("bg"))))
    least = steps.where(F.col("up") <= AT_HAND).agg(F.min("bg")).first()[0]
    near = table.where(F.col("bg") >= (float("inf") if least is None else least)).select("gram", "ratio").toPandas()  # at most AT_HAND rows
    models = Models(near["gram"].to_numpy(np.int64), np.array(near["ratio"].tolist(), np.float32), n_subjects)
    rare = table.where(F.col("bg") < (float("inf") if least is None else least)).select("gram", "ratio")
    if not rare.take(1):
        return models, docs

    def unknown(frames):
        for f in _parts(frames):
            b = Batch(f)
            gram, *_, end = b.grams()
            doc = b.sentence_doc[b.sentence[end]]
            far = models.place(gram) < 0
            d = pd.DataFrame({"doc_id": f.doc_id.to_numpy()[doc[far]], "gram": gram[far]})
            yield d.drop_duplicates()

    more = docs.mapInPandas(unknown, "doc_id long, gram long").join(rare, "gram").groupBy("doc_id").agg(F.collect_list(F.struct("gram", "ratio")).alias("more"))
    return models, docs.join(more, "doc_id", "left")


_EVIDENCE = "doc_id long, subject int, n_sentences int, n int, gain double, mass double"


def _score(models: Models, usual: int):
    """Evidence of each document: sentences a subject wins, the cross-entropy they save as a part of the greatest
    saving, its share of the posterior mass."""

    def run(frames):
        for f in _parts(frames):
            b = Batch(f)
            s, post = models.with_rare(f.get("more")).posteriors(b)
            n = models.n
            sents = np.bincount(b.sentence_doc, minlength=b.docs)
            mass = np.zeros((b.docs, n))
            np.add.at(mass, b.sentence_doc, post)
            mass /= np.maximum(sents, 1)[:, None]
            best = post.argmax(1) if len(post) else np.zeros(0, int)
            won = (post.max(1) if len(post) else np.zeros(0)) >= WON
            cell = b.sentence_doc[won] * n + best[won]
            count = np.bincount(cell, minlength=b.docs * n).reshape(b.docs, n)
            top = s.max(1, keepdims=True) if len(s) else s
            saved = (s - top - np.log(np.exp(s - top).mean(1, keepdims=True)))[won, best[won]]
            gain = np.bincount(cell, saved, b.docs * n).reshape(b.docs, n) / (np.maximum(sents, 1) * np.log(max(n, 2)))[:, None]
            blank = np.ones(b.docs, bool)
            blank[b.sentence_doc[np.abs(s).max(1) > 0] if len(s) else np.zeros(0, int)] = False
            mass[blank, usual] += 1e-6  # nothing is known of the text
            top = mass.argmax(1)
            show = (count > 0) | (mass >= 0.15)
            show[np.arange(b.docs), top] = True
            d, i = np.nonzero(show)
            yield pd.DataFrame({"doc_id": f.doc_id.to_numpy()[d], "subject": i.astype("int32"), "n_sentences": sents[d].astype("int32"), "n": count[d, i].astype("int32"), "gain": gain[d, i], "mass": mass[d, i]})

    return run


#: Gains and sentences among which the acceptance is chosen.
GAINS, SENTENCES = tuple(round(0.1 + 0.01 * k, 2) for k in range(21)), (2, 3)
NEAR = 0.002


def calibrated(ev: DataFrame, labels: DataFrame) -> tuple[float, int]:
    """Gain and number of sentences a further subject needs: the middle of the gains that agree (F1) with the labels
    as well as the best one, up to ``NEAR``, as some labels are wrong.  All labelled documents are read, reduced to a
    row per step of gain and number of sentences."""
    gold = labels.select("doc_id", "subject").distinct()
    n_gold = gold.count()
    e = ev.join(gold.select("doc_id").distinct(), "doc_id", "left_semi").join(gold.withColumn("gold", F.lit(1)), ["doc_id", "subject"], "left")
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("mass"), "subject")) == 1
    step = F.array_max(F.array(F.lit(-1), *[F.when(F.col("gain") >= gain, F.lit(k)) for k, gain in enumerate(GAINS)]))
    e = e.select(best.alias("top"), F.col("gold").isNotNull().alias("hit"), step.alias("step"), F.least("n", F.lit(max(SENTENCES))).alias("n"))
    e = e.groupBy("top", "hit", "step", "n").agg(F.count("*").alias("rows")).toPandas()  # a few rows
    top, hit, rows = e["top"].to_numpy(bool), e["hit"].to_numpy(bool), e["rows"].to_numpy()
    f1 = {}
    for n in SENTENCES:
        for k, gain in enumerate(GAINS):
            yes = top | ((e["step"] >= k) & (e["n"] >= n)).to_numpy(bool)
            f1[n, gain] = 2 * rows[yes & hit].sum() / max(1, rows[yes].sum() + n_gold)
    n = max(f1, key=f1.get)[0]
    near = [gain for gain in GAINS if f1[n, gain] >= max(f1.values()) - NEAR]
    return near[len(near) // 2], n


def scored(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[float, int], list[str]]:
    """Evidence rows of every document, the calibrated acceptance, and the subject codes that they number.

    documents: doc_id (unique), text.  labels: doc_id, subject_code; the subjects are a short list, a code each."""
    codes = [(r[0], r[1]) for r in labels.where("subject_code IS NOT NULL").groupBy("subject_code").agg(F.count("*")).orderBy("subject_code").collect()]
    subjects = [c for c, _ in codes]
    if not subjects:
        return documents.sparkSession.createDataFrame([], _EVIDENCE), (0.0, 0), []
    number = F.create_map(*[F.lit(x) for i, c in enumerate(subjects) for x in (c, i)])
    marked = labels.where("subject_code IS NOT NULL").select("doc_id", number[F.col("subject_code")].alias("subject")).distinct()
    d = documents.where("trim(text) <> ''").select("doc_id", "text")
    tokens = stored(d.mapInPandas(_tokenised, _TOKENS))
    of = marked.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("codes"))  # as many as there are subjects
    first = _interpolated(tokens.join(of, "doc_id", "left").mapInPandas(_count, _COUNTS), len(subjects))
    models, docs = _models(first, tokens, len(subjects))
    second = _interpolated(docs.mapInPandas(_recount(models), _COUNTS), len(subjects))
    models, docs = _models(second, tokens, len(subjects))
    usual = min(range(len(codes)), key=lambda i: (-codes[i][1], i))
    ev = stored(docs.mapInPandas(_score(models, usual), _EVIDENCE))
    return ev, calibrated(ev, marked), subjects


def subjects_of(ev: DataFrame, accept: tuple[float, int], subjects: list[str]) -> DataFrame:
    """doc_id, subject_code: the best supported subject and every further one that is accepted."""
    gain, n = accept
    name: Column = F.element_at(F.array(*[F.lit(c) for c in subjects]), F.col("subject") + 1) if subjects else F.lit(None).cast("string")
    best = ev.groupBy("doc_id").agg(F.min(F.struct((-F.col("mass")).alias("m"), "subject")).alias("b")).select("doc_id", F.col("b.subject").alias("subject"))
    more = ev.where((F.col("gain") >= gain) & (F.col("n") >= n)).select("doc_id", "subject")
    return best.unionByName(more).distinct().select("doc_id", name.alias("subject_code"))
