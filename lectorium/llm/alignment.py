"""Sentence alignment of a text and its rough translation.

Method: sentences are first aligned by length (dynamic programming over one-one, one-two, two-one and
empty beads); on the confident pairs word-translation probabilities are trained in both directions with
expectation-maximisation (IBM model 1); then each pair of texts is realigned by dynamic programming over
lexical scores made of those probabilities, and what moved or is said again is linked by the same scores
outside the monotone path.

Scale: texts are split once, into a stored table; a pair of texts is one row, and nothing larger is ever held
together.  Expected counts are summed per task, then by word pair; a word pair keeps a probability of at least
``LEAST``, so a word has at most 1 / ``LEAST`` translations.  The probabilities of the ``WORDS`` most frequent
words travel with the tasks; those of all rarer words are joined to the rows that hold them.  Both programs
run over all pairs of sentences of a text, a row at a time in numpy, and keep one byte (by length) or
three numbers (lexical) for each pair of sentences.

Defined results: a null or blank side gives no pair; equal source sentences pair with the same targets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectorium.llm.lookalike import fold
from lectorium.llm.sentences import sentence_spans
from lectorium.session import spread, stored

#: Words (of all languages and both sides together) whose probabilities travel with the tasks; others are joined.
WORDS = 60_000
LEAST, ROUNDS = 0.01, 4
#: Geometric mean of both probabilities at which a word counts as wholly rendered, and the least score that counts.
SURE, FAINT = 0.05, 0.6
FIGURE, UNKNOWN = 4.0, 3.0  # weights of figures without any pair, and of words that no confident pair holds
#: The key of the weight of a word that occurs once: figures that are not frequent have it.
RARE = ("", "")
_TOKEN = regex.compile(r"\p{N}+(?:[.,]\p{N}+)*|[\p{Latin}\p{M}]+|[\p{Han}々]+|[\p{Katakana}ー]+|[\p{Hiragana}]+")
_HAN = regex.compile(r"[\p{Han}々]")


def tokens(sentence: str) -> list[str]:
    """Numbers and words as they are; kanji as pairs of signs, kana words whole, short hiragana left out."""
    out = []
    for m in _TOKEN.finditer(sentence.lower()):
        w = m.group()
        if _HAN.match(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)] if len(w) > 1 else [w]
        elif "぀" <= w[0] <= "ゟ":
            if len(w) > 2:
                out.append(w[:3])
        elif len(w) > 1 or w.isdigit():
            out.append(w)
    return list(dict.fromkeys(out))


def by_length(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """One-one beads of the best alignment by length.  Costs of a row come from the two rows above at once;
    leaving target sentences out costs the same each, so it is a running minimum along the row."""
    n, m = len(a), len(b)
    x, y = np.array(a, float) * (sum(b) / sum(a)), np.array(b, float)
    y2 = y[1:] + y[:-1]
    along = 4.0 * np.arange(m + 1)
    back = np.full((n + 1, m + 1), 2, np.int8)
    row, up = along.copy(), None
    for i in range(1, n + 1):
        up2, up = up, row
        best, k = up + 4.0, back[i]
        k[:] = 1
        for steps, c in (
            (3, up[:-1] + np.abs(x[i - 1] - y) / np.sqrt((x[i - 1] + y) * 1.5)),
            (4, up[:-2] + 2.2 + np.abs(x[i - 1] - y2) / np.sqrt((x[i - 1] + y2) * 1.5) if m > 1 else None),
            (5, up2[:-1] + 2.2 + np.abs(x[i - 1] + x[i - 2] - y) / np.sqrt((x[i - 1] + x[i - 2] + y) * 1.5) if i > 1 else None),
        ):
            if c is None:
                continue
            at = slice(m + 1 - len(c), None)
            less = c < best[at]
            best[at] = np.where(less, c, best[at])
            k[at][less] = steps
        row = np.minimum.accumulate(best - along) + along
        k[row < best - 1e-9] = 2
    out, i, j = [], n, m
    while i or j:
        di, dj = ((1, 0), (0, 1), (1, 1), (1, 2), (2, 1))[back[i, j] - 1] if i else (0, 1)
        if di == dj == 1:
            out.append((i - 1, j - 1))
        i, j = i - di, j - dj
    return out[::-1]


def confident(sa: list[list[str]], sb: list[list[str]], la: list[int], lb: list[int]) -> list[tuple[int, int]]:
    """Pairs by length of which the figures agree, or all of a text with equal counts and near lengths."""
    pairs = by_length(la, lb)
    ratio = sum(lb) / sum(la)
    equal = len(sa) == len(sb)
    out = []
    for i, j in pairs:
        x, y = {t for t in sa[i] if t[0].isdigit()}, {t for t in sb[j] if t[0].isdigit()}
        near = 0.7 < lb[j] / (la[i] * ratio) < 1.43
        if (x and len(x & y) * 2 >= len(x | y)) or (equal and near and not x and not y):
            out.append((i, j))
    return out


_SPLIT = "row_id long, lang string, a_at array<int>, b_at array<int>, a_len array<int>, b_len array<int>, a_words string, b_words string"


def _packed(sentences: list[list[str]]) -> str:
    return "\n".join(" ".join(s) for s in sentences)


def _opened(words: str) -> list[list[str]]:
    return [s.split(" ") if s else [] for s in words.split("\n")]


def _split_rows(frames):
    """Both texts of each row as starts, lengths and words of their sentences (words by blanks, sentences by lines).

    Sentences are those of the stored text; words are taken from the folded form of each."""
    for f in frames:
        sides = []
        for texts, langs in ((f.source_text, f.source_language), (f.text, f.target_language)):
            spans = [sentence_spans(t, g) for t, g in zip(texts, langs)]
            parts = iter(fold(pa.array([t[a:b] for t, each in zip(texts, spans) for a, b in each], pa.string())).to_pylist())
            sides.append([([a for a, _ in each], [max(1, len(p)) for p in some], _packed([tokens(p) for p in some])) for each in spans for some in [[next(parts) for _ in each]]])
        rows = [(k, f"{la}-{lb}", a0, b0, na, nb, wa, wb) for k, la, lb, (a0, na, wa), (b0, nb, wb) in zip(f.row_id, f.source_language, f.target_language, *sides) if a0 and b0]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SPLIT.split(", ")])


_PAIRS = "lang string, a_words string, b_words string"


def _confident_pairs(frames):
    for f in frames:
        rows = []
        for lang, na, nb, wa, wb in zip(f.lang, f.a_len, f.b_len, f.a_words, f.b_words):
            sa, sb = _opened(wa), _opened(wb)
            rows += [(lang, " ".join(sa[i]), " ".join(sb[j])) for i, j in confident(sa, sb, na.tolist(), nb.tolist()) if sa[i] and sb[j]]
        yield pd.DataFrame(rows, columns=["lang", "a_words", "b_words"])


_MORE = "array<struct<side:string,w:string,weight:double,others:array<struct<o:string,px:double,py:double>>>>"


class Lexicon:
    """Probabilities (p of b given a, p of a given b) of word pairs by language pair, and weights of words."""

    def __init__(self, model: dict, weight: dict):
        self.model, self.weight = model, weight

    def with_rare(self, langs, more) -> Lexicon:
        """Also the rare words of a batch's rows."""
        if more is None or not more.notna().any():
            return self
        model, weight = {k: dict(v) for k, v in self.model.items() if k in set(langs)}, {k: dict(v) for k, v in self.weight.items() if k in set(langs)}
        for lang, entries in zip(langs, more):
            for e in entries if entries is not None else ():
                weight.setdefault(lang, {})[e["side"], e["w"]] = e["weight"]
                for x in e["others"] if e["others"] is not None else ():
                    k = (e["w"], x["o"]) if e["side"] == "a" else (x["o"], e["w"])
                    model.setdefault(lang, {})[k] = (x["px"], x["py"])
        return Lexicon(model, weight)


def _expect(lexicon: Lexicon | None):
    """E-step: expected counts of (lang, source word, target word) in both directions, a batch at a time.  Pairs
    without a probability have no count."""

    def run(frames):
        for f in frames:
            parts = []
            now = None if lexicon is None else lexicon.with_rare(f.lang, f.get("more"))
            for lang, rows in f.groupby("lang"):
                va: dict[str, int] = {}
                vb: dict[str, int] = {}
                la, lb = [], []
                for s, t in zip(rows.a_words, rows.b_words):
                    x = [va.setdefault(w, len(va)) for w in s.split(" ") if not w[0].isdigit()]
                    y = [vb.setdefault(w, len(vb)) for w in t.split(" ") if not w[0].isdigit()]
                    if x and y:
                        la.append(x)
                        lb.append(y)
                if not la:
                    continue
                nx, ny = np.array(list(map(len, la))), np.array(list(map(len, lb)))
                xs, ys = np.concatenate(la), np.concatenate(lb)
                x0, y0, each = np.cumsum(nx) - nx, np.cumsum(ny) - ny, nx * ny
                at = np.repeat(np.arange(len(nx)), each)
                k = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
                a, b = xs[x0[at] + k // ny[at]], ys[y0[at] + k % ny[at]]
                pair, code = np.unique(a * len(vb) + b, return_inverse=True)
                wa, wb = np.array(list(va), object)[pair // len(vb)], np.array(list(vb), object)[pair % len(vb)]
                if now is None:
                    p = np.ones((len(pair), 2))
                else:
                    g, none = now.model.get(lang, {}), (0.0, 0.0)
                    p = np.array([g.get(k, none) for k in zip(wa, wb)])
                out = []
                for side, of, n in ((0, y0[at] + k % ny[at], len(ys)), (1, x0[at] + k // ny[at], len(xs))):
                    v = p[code, side]
                    total = np.bincount(of, v, n) + (1e-6 if now is not None else 0)
                    out.append(np.bincount(code, v / total[of], len(pair)))
                d = pd.DataFrame({"lang": lang, "a": wa, "b": wb, "x": out[0], "y": out[1]})
                parts.append(d[(p > 0).any(1)])
            yield pd.concat(parts) if parts else pd.DataFrame({"lang": [], "a": [], "b": [], "x": [], "y": []})

    return run


def _with_more(rows: DataFrame, key: str, rare: DataFrame | None, frequent: DataFrame) -> DataFrame:
    """Append ``more``: what is known of the rare words of each row.  Frequent words, which could be hot, leave
    by a join with a list of at most ``WORDS`` entries before anything moves."""
    if rare is None:
        return rows
    each = lambda c, side: rows.select(key, "lang", F.lit(side).alias("side"), F.explode(F.array_distinct(F.split(c, "[ \n]"))).alias("w"))
    w = each("a_words", "a").unionByName(each("b_words", "b")).join(F.broadcast(frequent), ["lang", "side", "w"], "left_anti")
    more = w.join(rare, ["lang", "side", "w"]).groupBy(key).agg(F.collect_list(F.struct("side", "w", "weight", "others")).alias("more"))
    return rows.join(more, key, "left")


def train(pairs: DataFrame) -> tuple[Lexicon, DataFrame | None, DataFrame]:
    """Word-translation probabilities and weights: of frequent words at hand, of rare ones as a table (or null)."""
    each = lambda c, side: pairs.select("lang", F.lit(side).alias("side"), F.explode(F.split(c, " ")).alias("w"))
    n = each("a_words", "a").unionByName(each("b_words", "b")).groupBy("lang", "side", "w").agg(F.count("*").alias("n"))
    size = pairs.groupBy("lang").agg(F.count("*").alias("_size"))
    words = stored(n.join(F.broadcast(size), "lang").withColumn("weight", F.log1p(F.col("_size") / F.col("n"))).drop("_size"))
    # the count above which words are frequent: a running sum over the counts that occur, not over words
    steps = words.groupBy("n").agg(F.count("*").alias("k")).withColumn("up", F.sum("k").over(Window.orderBy(F.desc("n"))))
    least = steps.where(F.col("up") <= WORDS).agg(F.min("n")).first()[0] or 1 << 62
    frequent = words.where(F.col("n") >= least)
    names = frequent.select("lang", "side", "w")
    weight = {r.lang: {RARE: math.log1p(r._size)} for r in size.collect()}  # a row per pair of languages
    for r in frequent.toPandas().itertuples():  # at most WORDS rows
        weight[r.lang][r.side, r.w] = r.weight
    far = words.where((F.col("n") < least) & ~F.col("w").rlike(r"^\p{N}")).select("lang", "side", "w", "weight")
    some_rare = bool(far.take(1))
    if some_rare:
        pairs = stored(pairs.withColumn("pair_id", F.monotonically_increasing_id()))
    lexicon, rare = None, None
    for _ in range(ROUNDS):
        rows = _with_more(pairs, "pair_id", rare, names)
        c = rows.mapInPandas(_expect(lexicon), "lang string, a string, b string, x double, y double").groupBy("lang", "a", "b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        c = stored(c)  # three readers
        of_a, of_b = c.groupBy("lang", "a").agg(F.sum("x").alias("sx")), c.groupBy("lang", "b").agg(F.sum("y").alias("sy"))
        c = c.join(of_a, ["lang", "a"]).join(of_b, ["lang", "b"]).select("lang", "a", "b", (F.col("x") / F.col("sx")).alias("px"), (F.col("y") / F.col("sy")).alias("py"))
        c = c.where(f"px > {LEAST} OR py > {LEAST}")
        near = c
        if some_rare:
            mark = lambda side: F.broadcast(names.where(f"side = '{side}'").select("lang", F.col("w").alias(side), F.lit(True).alias(f"_{side}")))
            c = stored(c.join(mark("a"), ["lang", "a"], "left").join(mark("b"), ["lang", "b"], "left"))
            near = c.where("_a AND _b")
            others = lambda o: F.collect_list(F.struct(F.col(o).alias("o"), "px", "py")).alias("others")
            by_a = c.where("_a IS NULL").groupBy("lang", F.lit("a").alias("side"), F.col("a").alias("w")).agg(others("b"))
            by_b = c.where("_a AND _b IS NULL").groupBy("lang", F.lit("b").alias("side"), F.col("b").alias("w")).agg(others("a"))
            rare = stored(far.join(by_a.unionByName(by_b), ["lang", "side", "w"], "left"))
        model: dict = {}
        for r in near.select("lang", "a", "b", "px", "py").toPandas().itertuples():  # at most WORDS / LEAST rows
            model.setdefault(r.lang, {})[r.a, r.b] = (r.px, r.py)
        lexicon = Lexicon(model, weight)
    return lexicon, rare, names


def renderings(model: dict) -> dict:
    """Of each source word the target words that render it, with a score of up to 1."""
    out: dict = {}
    for (a, b), (px, py) in model.items():
        s = min(1.0, math.sqrt(px * py) / SURE)
        if s >= FAINT and min(px, py) > LEAST:
            out.setdefault(a, []).append((b, s))
    return out


def _explains(sa: list[list[str]], known: set, by: dict) -> list[dict[str, float]]:
    """Of each sentence the words of the other side that it renders, with their best score."""
    out = []
    for s in sa:
        d: dict[str, float] = {}
        for x in s:
            if x in known:
                d[x] = 1.0
            for y, v in by.get(x, ()):
                if y in known and v > d.get(y, 0.0):
                    d[y] = v
        out.append(d)
    return out


def _covered(explains: list[dict], sb: list[list[str]], ids: dict, w: np.ndarray) -> np.ndarray:
    """Share of the weight of each sentence of ``sb`` that each sentence of the other side renders."""
    flat = np.array([ids[x] for s in sb for x in s], np.int64)
    size = np.array([len(s) for s in sb])
    filled = np.flatnonzero(size)
    out = np.zeros((len(explains), len(sb)), np.float32)
    if not len(filled):
        return out
    starts = (np.cumsum(size) - size)[filled]
    total = np.add.reduceat(w[flat], starts)
    step = max(1, 2_000_000 // max(len(flat), len(ids)))
    for i in range(0, len(explains), step):
        part = explains[i : i + step]
        e = np.zeros((len(part), len(ids)))
        for k, d in enumerate(part):
            if d:
                e[k, [ids[y] for y in d]] = list(d.values())
        out[i : i + step, filled] = np.add.reduceat((e * w)[:, flat], starts, axis=1) / total
    return out


def align(sa: list[list[str]], sb: list[list[str]], by_a: dict, by_b: dict, w: dict) -> set[tuple[int, int]]:
    """Pairs of sentence numbers."""
    n, m = len(sa), len(sb)
    ia, ib = {x: k for k, x in enumerate({x: 0 for s in sa for x in s})}, {x: k for k, x in enumerate({x: 0 for s in sb for x in s})}
    wa, wb = (np.array([w.get((side, x), w.get(RARE, FIGURE) if x[0].isdigit() else UNKNOWN) for x in ids]) for side, ids in (("a", ia), ("b", ib)))
    ea, eb = _explains(sa, ib.keys(), by_a), _explains(sb, ia.keys(), by_b)
    cov_t, cov_s = _covered(ea, sb, ib, wb), _covered(eb, sa, ia, wa).T
    single = 2 * cov_t * cov_s / (cov_t + cov_s + 1e-9)
    link = np.maximum(cov_s, cov_t) >= 0.3

    def side(explains, words, ids, weight):
        all_ = set().union(*words)
        total = sum(weight[ids[x]] for x in all_)
        return sum(weight[ids[x]] * max(d.get(x, 0.0) for d in explains) for x in all_) / max(total, 1e-9)

    def bead(i0, i1, j0, j1):
        x, y = side(ea[i0:i1], sb[j0:j1], ib, wb), side(eb[j0:j1], sa[i0:i1], ia, wa)
        return 2 * x * y / (x + y + 1e-9)

    best = np.zeros((n + 1, m + 1))
    back = np.zeros((n + 1, m + 1), np.int8)
    shapes = ((1, 0), (0, 1), (1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2))
    back[0] = 1
    for i in range(1, n + 1):
        row, k = best[i - 1].copy(), np.zeros(m + 1, np.int8)
        v = best[i - 1, :-1] + single[i - 1] - 0.3
        more = v > row[1:]
        row[1:][more], k[1:][more] = v[more], 2
        for j in (np.flatnonzero(link[i - 1]) + 1).tolist():  # larger beads only where every sentence has a link
            for shape in range(3, 8):
                di, dj = shapes[shape]
                if i < di or j < dj:
                    continue
                base, half = best[i - di, j - dj] - 0.12 * (di + dj - 2), (di + dj) / 2
                if base + 0.7 * half <= row[j]:  # no score of the bead could win
                    continue
                part = link[i - di : i, j - dj : j]
                if not (part.any(0).all() and part.any(1).all()):
                    continue
                x = base + (bead(i - di, i, j - dj, j) - 0.3) * half
                if x > row[j]:
                    row[j], k[j] = x, shape
        best[i] = np.maximum.accumulate(row)
        k[best[i] > row] = 1
        back[i] = k
    out: set[tuple[int, int]] = set()
    i, j = n, m
    while i or j:
        di, dj = shapes[back[i, j]]
        for p in range(i - di, i):
            for q in range(j - dj, j):
                if di == dj == 1 or cov_s[p, q] >= 0.4 or cov_t[p, q] >= 0.4:
                    out.add((p, q))
        i, j = i - di, j - dj
    # a link of which both sides have a far better one elsewhere is a place holder of the monotone path
    top_p, top_q = single.max(1), single.max(0)
    out = {(p, q) for p, q in out if single[p, q] >= 0.65 * min(top_p[p], top_q[q])}
    score = np.maximum(single, np.where(cov_s > 0.62, 0.5, 0))
    has_p, has_q = {p for p, _ in out}, {q for _, q in out}
    for q in range(m):  # what moved, what is said again, what stands in a joined sentence
        if q not in has_q:
            p = int(np.argmax(np.minimum(cov_t[:, q], 0.95) + 0.3 * cov_s[:, q]))
            if cov_t[p, q] >= 0.5 and (cov_s[p, q] >= 0.25 or cov_t[p, q] >= 0.75):
                out.add((p, q))
                has_p.add(p)
    for p in range(n):
        if p not in has_p:
            q = int(np.argmax(cov_s[p]))
            if cov_s[p, q] >= 0.6 and cov_t[p, q] >= 0.2:
                out.add((p, q))
    for sentences, flip in ((sb, False), (sa, True)):  # the same sentence again pairs again
        said: dict = {}
        for q, s in enumerate(sentences):
            said.setdefault(tuple(s), []).append(q)
        group = {q: qs for s, qs in said.items() if len(qs) > 1 and s for q in qs}
        if group:
            for p, q in list(out):
                if flip:
                    out |= {(x, q) for x in group.get(p, ())}
                elif score[p, q] >= 0.4:
                    out |= {(p, x) for x in group.get(q, ())}
    return out


def aligned(df: DataFrame) -> DataFrame:
    """df: row_id (unique), source_text, text, source_language, target_language.  Gives row_id, src_start, tgt_start."""
    df = df.where("trim(source_text) <> '' AND trim(text) <> ''").select("row_id", "source_text", "text", "source_language", "target_language")
    parts = stored(spread(df).mapInPandas(_split_rows, _SPLIT))
    pairs = stored(spread(parts.select("lang", "a_len", "b_len", "a_words", "b_words")).mapInPandas(_confident_pairs, _PAIRS))
    lexicon, rare, frequent = train(pairs)

    def run(frames):
        made: dict = {}
        for f in frames:
            rows = []
            now = lexicon.with_rare(f.lang, f.get("more"))
            if now is not lexicon:
                made = {}
            for k, lang, a0, b0, wa, wb in zip(f.row_id, f.lang, f.a_at, f.b_at, f.a_words, f.b_words):
                if lang not in made:
                    g = now.model.get(lang, {})
                    made[lang] = renderings(g), renderings({(b, a): v for (a, b), v in g.items()})
                rows += [(k, a0[i], b0[j]) for i, j in align(_opened(wa), _opened(wb), *made[lang], now.weight.get(lang, {}))]
            yield pd.DataFrame(rows, columns=["row_id", "src_start", "tgt_start"])

    d = _with_more(parts.select("row_id", "lang", "a_at", "b_at", "a_words", "b_words"), "row_id", rare, frequent)
    return spread(d).mapInPandas(run, "row_id long, src_start int, tgt_start int")
