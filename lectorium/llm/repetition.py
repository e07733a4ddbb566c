"""Repetition inside one document.

Method: the text is a sequence of lines (its sentences, long ones parted); a linear-chain conditional
random field over observations of each line (how much of it is short phrases heard before, whether the very
line was, whether its neighbours were, variety of its words, length) is decoded with Viterbi and marks each
line as content or boilerplate, here repeat.  The content share decides retention: a text with less than
``KEEP`` of its letters in content lines is not kept.  Of those an exact measure follows: the share of letters
and digits in stretches of ``WORDS`` words (``CHARS`` characters in Japanese) that occurred earlier, letter
case, blanks and punctuation aside.

The field is trained here on a bounded sample of texts (``TRAIN_TEXTS``) into which copies are planted; a
line's label says whether it was planted, and no observation is the exact measure.  Everything else sees all
rows and whole texts.  A batch of texts is measured at once: units become numbers, phrases are numbered
exactly by joining numbers of shorter ones, and Viterbi steps through all texts of the batch together.

Defined results: null text gives null shares; a text without letters or digits has share 0; a text
shorter than one stretch has share 0.
"""

from __future__ import annotations

import random
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex

WORDS, CHARS = 5, 12
TRAIN_TEXTS = 300
#: Content share below which a text is not kept.
KEEP = 0.8
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_CF = regex.compile(r"\p{Cf}+")
_MARK = regex.compile(r"\p{M}")
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_CJK = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}ー]")
_BREAK = regex.compile(r"[\n\r]+|(?<=[.!?。．！？।؟])\s*")
PIECE_WORDS, PIECE_CHARS = 10, 24
N_FEATURES = 12


def is_japanese(text: str) -> bool:
    clean = _CF.sub("", text)
    return bool(_KANA.search(clean)) and 2 * len(_CJK.findall(clean)) > sum(map(len, _WORD.findall(clean)))


def units_of(text: str, japanese: bool) -> tuple[list[str], list[int]]:
    """Units (words, or characters of Japanese) and the letters and digits in each, combining marks aside."""
    words = _WORD.findall(_CF.sub("", text).lower())
    marks = bool(_MARK.search(text))
    if japanese:
        units = [c for w in words for c in w if not (marks and unicodedata.combining(c))]
        return units, [1] * len(units)
    return words, [sum(not unicodedata.combining(c) for c in w) for w in words] if marks else list(map(len, words))


def _numbered(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


def phrases(units: np.ndarray, n: int) -> np.ndarray:
    """A number for the n units from each place on, equal for equal phrases and only for them."""
    got, width = units, 1
    while width < n:
        step = min(width, n - width)
        head, tail = got[: len(units) - width - step + 1], got[step:][: len(units) - width - step + 1]
        got, width = _numbered(head * (int(got.max(initial=0)) + 1) + tail), width + step
    return got


def heard(units: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Which units lie in a stretch of n or more that occurred earlier in the same row."""
    m = len(units)
    if m <= n:
        return np.zeros(m, bool)
    whole = np.flatnonzero(row[: m - n + 1] == row[n - 1 :])
    g = phrases(units, n)[whole]
    _, first, back = np.unique(row[whole] * (int(g.max(initial=0)) + 1) + g, return_index=True, return_inverse=True)
    again = whole[first[back] < np.arange(len(whole))]
    delta = np.bincount(again, minlength=m + 1) - np.bincount(again + n, minlength=m + 1)
    return np.cumsum(delta[:m]) > 0


@dataclass
class Lines:
    """Lines of many texts: of each its text (``row``), letters and observations; of each text the exact share;
    of each unit its line."""

    row: np.ndarray
    letters: np.ndarray
    seen: np.ndarray
    exact: np.ndarray
    unit_line: np.ndarray


def lines_of(texts: list[str]) -> Lines:
    known: dict[str, int] = {}
    ids, sizes, parts, part_row, ja = [], [], [], [], []
    for r, t in enumerate(texts):
        j = is_japanese(t)
        ja.append(j)
        for part in _BREAK.split(t):
            u, s = units_of(part, j) if part else ((), ())
            if u:
                ids += [known.setdefault(x, len(known)) for x in u]
                sizes += s
                parts.append(len(u))
                part_row.append(r)
    units, size, part, part_row = np.array(ids, np.int64), np.array(sizes, float), np.array(parts, np.int64), np.array(part_row, np.int64)
    ja = np.array(ja, bool)
    cap = np.where(ja[part_row], PIECE_CHARS, PIECE_WORDS) if len(part_row) else part
    pieces = -(-part // cap) if len(part) else part
    n = int(pieces.sum())
    at = np.arange(len(units)) - np.repeat(np.cumsum(part) - part, part)
    line = np.repeat(np.cumsum(pieces) - pieces, part) + at // np.repeat(cap, part)
    row_of_line, cap_of_line = np.repeat(part_row, pieces), np.repeat(cap, pieces)
    row = np.repeat(part_row, part)
    big, short = np.zeros(len(units), bool), np.zeros(len(units), bool)
    for signs, long_, few in ((True, CHARS, CHARS // 2), (False, WORDS, 3)):
        of = np.flatnonzero(ja[row] == signs) if len(row) else np.zeros(0, int)
        big[of], short[of] = heard(units[of], row[of], long_), heard(units[of], row[of], few)
    letters = np.bincount(line, size, n)
    count = np.bincount(line, minlength=n)
    b = np.bincount(line, size * short, n) / np.maximum(letters, 1)
    kinds = np.unique(line * max(len(known), 1) + units)
    variety = np.bincount(kinds // max(len(known), 1), minlength=n) / np.maximum(count, 1)
    # the very line before: lines are phrases of differing length, told apart by their digest
    rng = np.random.default_rng(11).integers(1, 1 << 62, (max(len(known), 1),), dtype=np.int64).astype(np.uint64)
    turn = (at % np.maximum(np.repeat(cap, part), 1)).astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
    mixed = (rng[units] + turn * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD) if len(units) else np.zeros(0, np.uint64)
    mixed ^= mixed >> np.uint64(29)
    starts = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, int)
    digest = _numbered(np.add.reduceat(mixed, starts)) if len(starts) else np.zeros(0, int)
    same = np.zeros(n, bool)
    if n:
        _, first, back = np.unique(row_of_line * (int(digest.max()) + 1) + digest, return_index=True, return_inverse=True)
        same = first[back] < np.arange(n)
    before, behind = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        kin = row_of_line[1:] == row_of_line[:-1]
        before[1:], behind[:-1] = same[:-1] & kin, same[1:] & kin
    f = np.zeros((n, N_FEATURES))
    f[:, 0] = 1
    f[:, 1], f[:, 2], f[:, 3], f[:, 4], f[:, 5] = b == 0, (b > 0) & (b < 0.35), (b >= 0.35) & (b < 0.7), (b >= 0.7) & (b < 1), b == 1
    f[:, 6], f[:, 7], f[:, 8] = same, before, behind
    f[:, 9], f[:, 10] = count * 4 <= cap_of_line, variety <= 0.5
    f[:, 11] = b
    total = np.bincount(row, size, len(texts))
    exact = np.bincount(row, size * big, len(texts)) / np.maximum(total, 1)
    return Lines(row_of_line, letters, f, exact, line)


def viterbi(f: np.ndarray, row: np.ndarray, model: dict) -> np.ndarray:
    """Labels of the lines of all rows (lines of a row stand together), one step for all rows at a time."""
    e, t = f @ model["emit"], model["move"]
    if not len(e):
        return np.zeros(0, np.int8)
    start = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(start, len(e)))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    back, best = np.zeros((len(e), 2), np.int8), e[start]
    final = np.zeros((len(start), 2))
    alive = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left")  # rows longer than each step
    for i in range(1, int(size[0]) + 1):
        k = int(alive[i])
        final[k : len(best)] = best[k:]
        if not k:
            break
        s = best[:k, :, None] + t
        back[start[:k] + i] = s.argmax(1)
        best = s.max(1) + e[start[:k] + i]
    out, now = np.zeros(len(e), np.int8), final.argmax(1).astype(np.int8)
    for i in range(int(size[0]) - 1, -1, -1):
        k = int(alive[i])
        at = start[:k] + i
        out[at] = now[:k]
        now[:k] = back[at, now[:k]]
    return out


def planted(texts: list[str], seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences: texts without long repeats, half of them with planted copies; the label of a line is
    whether most of its letters were planted."""
    rng, out = random.Random(seed), []
    for t in texts:
        clean = lines_of([t])
        if not len(clean.row) or clean.exact[0] > 0.05:
            continue
        if rng.random() < 0.5:
            out.append((clean.seen, np.zeros(len(clean.row), int)))
            continue
        parts = [p for p in _BREAK.split(t) if p.strip()]
        i, k, way = rng.randrange(len(parts)), rng.choice([1, 1, 2, 4, 8]), rng.random()
        p = parts[i]
        if rng.random() < 0.3:
            p = p[: p.find(" ", len(p) // 3) + 1 or max(1, len(p) // 3)]
        marked = [(x, False) for x in parts]
        if way < 0.4:  # a line said again right behind itself
            marked[i + 1 : i + 1] = [(p, True)] * k
        elif way < 0.7:  # the text up to here said again at its end
            marked += [(x, True) for x in parts[: i + 1]] * k
        else:  # a phrase in a loop inside one line
            phrase = p[: p.find(" ", len(p) // 4) + 1 or max(1, len(p) // 4)]
            loop = [phrase, *[phrase] * (3 * k)]
            marked[i : i + 1] = [(phrase, False), (" ".join(loop[1:]), True)]
        mixed = "\n".join(x for x, _ in marked)
        got = lines_of([mixed])
        flag = np.concatenate([np.full(len(units_of(x, is_japanese(mixed))[0]), float(y)) for x, y in marked] or [np.zeros(0)])
        if len(got.row) and len(flag) == len(got.unit_line):
            part = np.bincount(got.unit_line, flag, len(got.row)) / np.maximum(np.bincount(got.unit_line, minlength=len(got.row)), 1)
            out.append((got.seen, (part >= 0.5).astype(int)))
    return out


def train(texts: list[str], rounds: int = 60, rate: float = 0.5) -> dict:
    """Gradient ascent on the conditional likelihood, forward-backward over padded sequences."""
    data = planted(texts)
    if not data:
        f = np.zeros(N_FEATURES)
        f[[3, 4, 5, 6]] = 1, 2, 2, 1
        f[0] = -1
        return {"emit": np.stack([-f, f], 1), "move": np.array([[0.5, -0.5], [-0.5, 0.5]])}
    n, most = len(data), max(len(y) for _, y in data)
    x, y, mask = np.zeros((n, most, N_FEATURES)), np.zeros((n, most), int), np.zeros((n, most))
    for i, (f, lab) in enumerate(data):
        x[i, : len(lab)], y[i, : len(lab)], mask[i, : len(lab)] = f, lab, 1
    w, t = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    gold = np.eye(2)[y] * mask[..., None]
    moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    for _ in range(rounds):
        e = x @ w
        al, be = np.zeros_like(e), np.zeros_like(e)
        al[:, 0] = e[:, 0]
        for i in range(1, most):
            step = np.logaddexp(al[:, i - 1, :1] + t[0], al[:, i - 1, 1:] + t[1]) + e[:, i]
            al[:, i] = np.where(mask[:, i, None] > 0, step, al[:, i - 1])
        for i in range(most - 2, -1, -1):
            nx = e[:, i + 1] + be[:, i + 1]
            step = np.logaddexp(nx[:, :1] + t[:, 0], nx[:, 1:] + t[:, 1])
            be[:, i] = np.where(mask[:, i + 1, None] > 0, step, be[:, i + 1])
        z = np.logaddexp(al[:, -1, 0], al[:, -1, 1])
        p = np.exp(al + be - z[:, None, None]) * mask[..., None]
        pair = np.exp(al[:, :-1, :, None] + t + (e + be)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        w += rate * (np.einsum("ntf,nts->fs", x, gold - p) / n - 0.001 * w)
        t += rate * ((moves - pair.sum((0, 1))) / n - 0.001 * t)
    return {"emit": w, "move": t}


def shares(texts: list[str | None], model: dict) -> np.ndarray:
    """Of each text the share of letters in lines marked repeat, and the exact share of repeated letters."""
    out = np.full((len(texts), 2), np.nan)
    some = [i for i, t in enumerate(texts) if t is not None]
    got = lines_of([texts[i] for i in some])
    mark = viterbi(got.seen, got.row, model)
    total = np.bincount(got.row, got.letters, len(some))
    out[some, 0] = np.bincount(got.row, got.letters * mark, len(some)) / np.maximum(total, 1)
    out[some, 1] = got.exact
    return out


def with_shares(df, text: str, model: dict):
    """Append ``marked_share``, ``repeat_share`` and ``keep`` (content share of at least ``KEEP``)."""
    from pyspark.sql import functions as F

    @F.pandas_udf("marked_share double, repeat_share double")
    def measure(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shares([None if x is None else x for x in t], model), columns=["marked_share", "repeat_share"]).astype("Float64")

    d = df.withColumn("_s", measure(text))
    marked = F.nanvl("_s.marked_share", F.lit(None).cast("double"))
    return d.select(*df.columns, marked.alias("marked_share"), F.nanvl("_s.repeat_share", F.lit(None).cast("double")).alias("repeat_share")).withColumn("keep", 1 - F.col("marked_share") >= KEEP)


def fitted(df, text: str) -> dict:
    """Train on a bounded sample of the texts, the same rows in any run."""
    from pyspark.sql import functions as F

    rows = df.where(F.col(text).isNotNull()).select(text).orderBy(F.xxhash64(text), text).limit(TRAIN_TEXTS).collect()
    return train([r[0] for r in rows])
