"""Text cut off by field limits.

Method: a backward character n-gram model.  Read back from any point of a sentence, the last 4, 8, 16, 24
and 40 characters are contexts; over all texts of both tables it is counted how often each context is
the end of a sentence and how often a sentence goes on behind it.  For the final context of every value
the interpolated likelihood of an end is held against that of a continuation, and the log-odds are
thresholded per language and column.  Thresholds are fitted (``fitted``) on all values that end with a mark: their
own ends are whole, and each is also cut at a place inside its last sentence that a digest of its key names.

Headings, captions, lists, references and figures (``plain_end``) need no end mark, so there only a cut within a
word counts: the letters since the last blank are never a word of their own and ``WORD_LEAST`` times the start
of a longer one.  Their texts take part in all counts.

Scale: contexts are 64-bit digests.  Only contexts that are the final context of some value matter, so a
bitmap (by the number of contexts, ``BITS``: 0.5 to 16 MB) drops nearly all others before the shuffle; a
full bitmap costs time, never a result.  Counts are summed per task, then by digest; values meet their
contexts in one shuffle join on the digest.

Defined results: null and blank texts are no cases; a text in the shape of a heading or list has a plain end
whatever its role; a value's own end is not counted as evidence for itself; a value that ends with a mark behind which a sentence could begin is whole; repeated rows are read once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash

from lectorium.llm.lookalike import fold
from lectorium.llm.sentences import sentence_spans

ORDERS = (4, 8, 16, 24, 40)
JUNCTION = 2  # index of the order that looks across two blocks
BITS = (22, 27)
PRIOR, SMOOTH = 0.02, 3.0
DEBRIS_MALUS = 2.0
#: Log-odds among which thresholds are chosen, and that of a column and language with fewer than ``FIT_LEAST`` values.
THRESHOLDS = tuple(-3.0 + 0.25 * k for k in range(13))
NEAR = 0.005
DEFAULT_THRESHOLD = -1.0
#: The fewest whole and planted ends that a threshold of its own takes.
FIT_LEAST = 100
#: Values whose contexts are counted at once, so memory does not depend on the size of Arrow batches.
AT_ONCE = 2_000
WORD_LEAST = 3
#: A numbered line is a heading if it is shorter; a longer one is judged as prose.
HEADING = 90
WORD = len((4, 8, 16, 24, 40))  # number of the context that starts at the last blank
_HYPHEN = regex.compile(r"(?<=\p{L})[-‐¬­]\s*\n\s*(?=\p{Ll})")
_WRAP = regex.compile(r"(?<=([^\s.!?。．！？।؟)\]）”」\"]))\s*\n\s*(?=(\p{Hiragana}|\p{Katakana}|\p{Han})?)")
_SPACE = regex.compile(r"\s+")
_NUMBER = regex.compile(r"\p{N}+(?:[.,]\p{N}+)*")
_FRACTION_CUT = regex.compile(r"\p{N}+[.,]$")
_DEBRIS = regex.compile(r"(?:\s*(?:\.{2,}|…|�)|\s+[-\[(<=*•])+\s*$")
_CLOSE = regex.compile(r"[\s\"”“’»」』)）\]］]*$")
_MARK = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}][\s\"”“’»」』)）\]］]*$")
_MARKS = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}\s\"”“’»」』)）\]］]+$")
_HEADING = regex.compile(r"^[\s*#>•·-]*(?:\p{N}+(?:[.．]\p{N}+)*[.．]?\s+\S|(?:Figure|Fig\.|Table|Tab\.|Abb\.|Abbildung|Tabelle|図|表)\s*\p{N}+[.:：\s])")
_LIST = regex.compile(r"^\s*[•・*·‣-]\s*\S")
_CJK = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}\p{Thai}]")
KEY_COLUMNS = ["src_table", "row_key", "lang", "source", "planted", "ord", "digest", "debris", "marked", "lower_next", "plain_end", "in_word"]
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))


def exempt(text: str) -> bool:
    """Headings, captions and lists by their shape."""
    t = text.strip()
    if "\n" not in t and len(t) < HEADING and _HEADING.match(t) and not _MARK.search(t):
        return True
    return all(_LIST.match(x) for x in t.split("\n") if x.strip())


def sentences_of(text: str, folded: str) -> tuple[list[str], bool, bool]:
    """Masked sentences (end marks off), whether the end bears debris, whether it bears a mark."""
    t = folded
    if "\n" in t:
        t = _WRAP.sub(lambda m: "" if m[2] or _CJK.match(m[1]) else " ", _HYPHEN.sub("", t))
    bare = _DEBRIS.sub("", t)
    debris = bare != t.rstrip()
    spans = sentence_spans(bare + " Xa.")  # a mark ends the text if a sentence could begin behind it
    marked = bool(_MARK.search(bare)) and spans[-1][0] > len(bare) and not _FRACTION_CUT.search(bare)
    if spans[-1][0] > len(bare):
        spans.pop()
    out = []
    for a, b in spans:
        b = min(b, len(bare))
        s = _NUMBER.sub("0", _SPACE.sub(" ", _MARKS.sub("", bare[a:b]).lower()))
        out.append("^" + s)
    return out, debris, marked


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n + 1, _B, np.uint64), np.full(n + 1, _BINV, np.uint64)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def _mix(h: np.ndarray, order: int) -> np.ndarray:
    h = h + np.uint64((order + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(32)


class Hashed:
    """Context digests at every position of many strings at once."""

    def __init__(self, strings: list[str]):
        self.ends = np.cumsum([len(s) for s in strings])
        self.begins = np.concatenate([[0], self.ends[:-1]])
        cp = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.pow, inv = _powers(len(cp))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((cp + np.uint64(7)) * inv[: len(cp)], dtype=np.uint64)])
        self.first = np.repeat(self.begins, self.ends - self.begins)
        # letters: all but blanks, figures, ASCII signs, general and CJK punctuation
        self.letter = ~((cp < 65) | (cp > 90) & (cp < 97) | (cp > 122) & (cp < 170) | (cp >= 0x2000) & (cp < 0x2070) | (cp >= 0x3000) & (cp < 0x3040))
        place = np.arange(len(cp))
        self.word = np.maximum(np.maximum.accumulate(np.where(self.letter, 0, place + 1)), self.first)  # where the word of each place starts

    def in_word(self, place: np.ndarray) -> np.ndarray:
        """Digest of the letters since the last blank."""
        return _mix((self.sums[place + 1] - self.sums[self.word[place]]) * self.pow[place], WORD)

    def at(self, place: np.ndarray, order: int) -> np.ndarray:
        """Digest of the context that ends with the character at ``place``."""
        lo = np.maximum(self.first[place], place + 1 - ORDERS[order])
        return _mix((self.sums[place + 1] - self.sums[lo]) * self.pow[place], order)


def final_keys(f: pd.DataFrame) -> pd.DataFrame:
    """One row per value and context: order, digest; junction rows have order -1.  Every marked value
    comes again with an end planted inside its last sentence (``planted`` 1)."""
    zs, rows = [], []
    for i, (sents, nxt, debris, marked, plain) in enumerate(zip(f.sents, f.follow, f.debris, f.marked, f.plain_end)):
        z, tail = sents.rpartition("\n")[2], ""
        if nxt:
            tail = ("" if _CJK.search(z[-2:]) else " ") + _NUMBER.sub("0", _SPACE.sub(" ", nxt.lstrip()[:40]).lower())
            tail = tail[:8]
        rows.append((i, 0, debris, marked, len(z), len(tail), bool(nxt) and nxt.lstrip()[:1].islower(), plain, not _CJK.search(z)))
        zs.append(z + tail)
        if marked and not debris and not plain and len(z) > 12:
            key = xxhash.xxh64_intdigest(str(f.row_key.iloc[i]))
            rows.append((i, 1, False, False, 8 + key // 1_000_003 % (len(z) - 9), 0, False, False, False))
            zs.append(z)
    if not zs:
        return pd.DataFrame({c: [] for c in KEY_COLUMNS})
    h = Hashed(zs)
    frames = []
    col = lambda k: np.array([r[k] for r in rows])
    cols = {c: f[c].to_numpy()[col(0)] for c in ("src_table", "row_key", "lang", "source")} | {"planted": col(1), "debris": col(2), "marked": col(3), "lower_next": col(6), "plain_end": col(7)}
    last = h.begins + col(4) - 1
    cols["in_word"] = col(8) & h.letter[last]
    for o in range(len(ORDERS)):
        frames.append(pd.DataFrame(cols | {"ord": o, "digest": h.at(last, o).view(np.int64)}))
    take = lambda has: {c: v[has] for c, v in cols.items()}
    has = np.flatnonzero(col(5) >= 4)
    if len(has):
        frames.append(pd.DataFrame(take(has) | {"ord": -1, "digest": h.at(h.ends[has] - 1, JUNCTION).view(np.int64)}))
    has = np.flatnonzero(cols["in_word"] & cols["plain_end"])
    if len(has):
        frames.append(pd.DataFrame(take(has) | {"ord": WORD, "digest": h.in_word(last[has]).view(np.int64)}))
    return pd.concat(frames, ignore_index=True)[KEY_COLUMNS]


def context_counts(texts: list[str], marks: list[bool], bitmap: np.ndarray, store: list) -> None:
    """Append (digest, ends, goes on) of the contexts that the bitmap holds; texts: masked sentences by lines."""
    zs, open_end = [], []
    for t, marked in zip(texts, marks):
        s = t.split("\n")
        zs += s
        open_end += [False] * (len(s) - 1) + [not marked] * bool(s)
    if not zs:
        return
    h = Hashed(zs)
    every = np.arange(int(h.ends[-1]))
    is_end = np.zeros(len(every), bool)
    is_end[h.ends - 1] = True
    use = np.ones(len(every), bool)  # the end of a text without a mark is evidence of nothing
    use[(h.ends - 1)[np.array(open_end)]] = False
    word_ends = ~np.append(h.letter[1:], False) | is_end
    every, is_end, word_ends = every[use], is_end[use], word_ends[use]
    for o in range(len(ORDERS) + 1):
        d, is_end = (h.at(every, o), is_end) if o < WORD else (h.in_word(every), word_ends)
        bit = d >> np.uint64(65 - (len(bitmap) * 64).bit_length())
        hit = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        u, at = np.unique(d[hit], return_inverse=True)
        e = np.bincount(at, is_end[hit], len(u)).astype(np.int64)
        n = np.bincount(at, minlength=len(u))
        store.append((u.view(np.int64), e, n - e))


def merged(store: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d, e, c = (np.concatenate(x) for x in zip(*store))
    u, at = np.unique(d, return_inverse=True)
    return u, np.bincount(at, e, len(u)).astype(np.int64), np.bincount(at, c, len(u)).astype(np.int64)


def fitted(per, odds):
    """Threshold by column and language: that with the fewest errors on whole and on planted ends, each side
    counted as one; of all that do as well up to ``NEAR`` the middle one.  ``per`` is reduced to
    a row per column, language, side and step of odds."""
    from pyspark.sql import functions as F

    d = per.where("(planted = 1 OR marked) AND NOT debris AND NOT plain_end AND NOT lower_next AND joined = 0")
    step = F.array_max(F.array(F.lit(-1), *[F.when(odds >= t, F.lit(k)) for k, t in enumerate(THRESHOLDS)]))
    h = d.groupBy("src_table", "lang", "planted", step.alias("k")).agg(F.count("*").alias("n")).toPandas()  # a few rows each
    out = {}
    for key, g in h.groupby(["src_table", "lang"]):
        n = np.zeros((2, len(THRESHOLDS) + 1))
        for r in g.itertuples():
            n[r.planted, r.k + 1] += r.n
        if n.sum(1).min() >= FIT_LEAST:
            below = np.cumsum(n, 1)[:, :-1] / n.sum(1, keepdims=True)  # share under each threshold
            wrong = below[0] + 1 - below[1]
            near = np.flatnonzero(wrong <= wrong.min() + NEAR)
            out[key] = THRESHOLDS[int(near[len(near) // 2])]
    return out


def cut_values(values):
    """``values``: src_table, row_key, lang, text, follow (start of the block behind, or null), plain_end,
    source.

    Gives every value: ``log_odds``, ``threshold`` and ``cut``.
    """
    from pyspark.sql import functions as F

    from lectorium.session import spread, stored

    def split(frames):
        for f in frames:
            got = [(*sentences_of(t, x), exempt(x)) for t, x in zip(f.text, fold(pa.array(f.text, pa.string())).to_pylist())]
            f = f.assign(sents=["\n".join(g[0]) for g in got], debris=[g[1] for g in got], marked=[g[2] for g in got], plain_end=[bool(p) or g[3] for p, g in zip(f.plain_end, got)])
            yield f.loc[f.sents != "", [c.split()[0] for c in sentences.split(", ")]]

    # folded and split once, read by both passes
    sentences = "src_table string, row_key string, lang string, source string, follow string, plain_end boolean, debris boolean, marked boolean, sents string"
    values = stored(values.select("src_table", "row_key", "lang", "source", "follow", "plain_end", "text").mapInPandas(split, sentences))

    def keys(frames):
        for f in frames:
            yield final_keys(f)

    at = spread(values).mapInPandas(keys, "src_table string, row_key string, lang string, source string, planted int, ord int, digest long, debris boolean, marked boolean, lower_next boolean, plain_end boolean, in_word boolean")
    at = stored(at)
    bits = min(max((8 * at.count()).bit_length(), BITS[0]), BITS[1])
    bit = F.shiftrightunsigned("digest", 64 - bits)
    words = at.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(digest, {64 - bits}) % 64 as int))").alias("b"))

    def packed(frames):
        for f in frames:
            yield pd.DataFrame({"part": f.part, "w": [np.array([x["w"] for x in r], np.int32).tobytes() for r in f.words], "b": [np.array([x["b"] for x in r], np.int64).tobytes() for r in f.words]})

    parts = words.groupBy("w").agg(F.bit_or("b").alias("b")).groupBy(F.shiftright("w", 13).alias("part")).agg(F.collect_list(F.struct("w", "b")).alias("words"))
    bitmap = np.zeros(1 << bits - 6, np.uint64)
    for r in parts.mapInPandas(packed, "part int, w binary, b binary").toPandas().itertuples():  # at most 256 rows
        bitmap[np.frombuffer(r.w, np.int32)] = np.frombuffer(r.b, np.uint64)

    def pieces(one):
        for i in range(0, len(one[0]), 250_000):
            yield pd.DataFrame({c: x[i : i + 250_000] for c, x in zip(("digest", "e", "c"), one)})

    def count(frames):
        store, held = [], 0
        for f in (f.iloc[i : i + AT_ONCE] for f in frames for i in range(0, len(f), AT_ONCE)):
            before = len(store)
            context_counts(f.sents.tolist(), f.marked.tolist(), bitmap, store)
            held += sum(len(x[0]) for x in store[before:])
            if held > 2_000_000:
                one = merged(store)
                if len(one[0]) > 1_000_000:
                    yield from pieces(one)
                    store, held = [], 0
                else:
                    store, held = [one], len(one[0])
        if store:
            yield from pieces(merged(store))

    counts = spread(values.select("sents", "marked")).mapInPandas(count, "digest long, e long, c long").groupBy("digest").agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
    both = at.join(counts, "digest", "left").fillna(0, ["e", "c"])
    own = ((F.col("ord") >= 0) & F.col("marked")).cast("long")
    on = ((F.col("ord") >= 0) & (F.col("planted") == 1)).cast("long")  # a planted end goes on in its own text
    pick = lambda c, o: F.sum(F.when(F.col("ord") == o, F.col(c)).otherwise(0))
    both = both.withColumns({"e": F.greatest(F.col("e") - own, F.lit(0)), "c": F.greatest(F.col("c") - on, F.lit(0))})
    per = both.groupBy("src_table", "row_key", "lang", "source", "planted").agg(
        *[F.first(c).alias(c) for c in ("debris", "marked", "lower_next", "plain_end", "in_word")],
        F.sum(F.when(F.col("ord") == -1, F.col("e") + F.col("c")).otherwise(0)).alias("joined"),
        *[pick(c, o).alias(f"{c}{o}") for o in range(len(ORDERS) + 1) for c in ("e", "c")],
    )
    per = stored(per)
    p, q = F.lit(PRIOR), F.lit(1 - PRIOR)  # q is 1 - p, which as a difference is 0 where all of very many texts end
    for o in range(len(ORDERS)):
        e, c = F.col(f"e{o}"), F.col(f"c{o}")
        p, q = (e + SMOOTH * p) / (e + c + SMOOTH), (c + SMOOTH * q) / (e + c + SMOOTH)
    odds = F.log(p / q) - F.when(F.col("debris"), DEBRIS_MALUS).otherwise(0.0)
    limit = F.lit(DEFAULT_THRESHOLD)
    for (col, lang), v in sorted(fitted(per, odds).items()):
        limit = F.when((F.col("src_table") == col) & (F.col("lang") == lang), F.lit(v)).otherwise(limit)
    goes_on = ~F.col("debris") & ((F.col("joined") > 0) | F.col("lower_next"))
    parted = F.col("in_word") & (F.col(f"e{WORD}") == 0) & (F.col(f"c{WORD}") >= WORD_LEAST)
    return per.where("planted = 0").select(
        "src_table", "row_key", "lang", "source", odds.alias("log_odds"), limit.alias("threshold"), goes_on.alias("goes_on"), "debris", "marked", "plain_end", "in_word", "joined",
        *[f"{c}{o}" for o in range(len(ORDERS) + 1) for c in ("e", "c")],
    ).withColumn("cut", F.when(F.col("plain_end"), parted).otherwise((F.col("log_odds") < F.col("threshold")) & ~F.col("goes_on")) & ~F.col("marked"))
