"""Sentence boundaries for every script.

Method: the standard character-property sentence-break classes (STerm, ATerm,
Sep, Lower, SContinue, Close) from the Unicode ``Sentence_Break`` property, with
language-specific abbreviation suppression and quotation-closing handling.

Defined results
---------------
* null or blank text gives no sentence; a text without any mark is one sentence;
* a line break always ends a sentence, so a heading on its own line is one;
* nothing inside a quotation or bracket that a sentence opened midway is a boundary;
* a bracketed note between two sentences is a sentence of its own;
* Thai has no marks: a blank between two Thai clauses is the boundary, a blank beside
  a figure or a foreign word is not unless a new clause starts behind it;
* offsets are 0-based code points of the stored text; a start is the first visible
  character.  Texts whose letter case is swapped are read with the case put right.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex

# Abbreviations after which a full stop ends nothing, by language.
ABBREVIATIONS = {
    "en": "e.g i.e eg ie cf vs approx dr prof mr mrs ms st al jr sr viz ph.d dept est incl excl resp",
    "de": "bzw ca d.h z.b u.a vgl dr prof hr fr sog evtl ggf inkl exkl z.t u.u s.o s.u anm geb gest al bspw",
    "hi": "डॉ श्री प्रो पं सं कु",
    "ar": "د أ م ص",
    "th": "ดร นพ พญ",
}
# Abbreviations that end nothing only before a figure.
BEFORE_NUMBER = {
    "en": "no nos fig figs tab tabs eq eqs sec secs ch chap vol p pp art par app ref refs ex",
    "de": "nr abb tab s kap bd art abs jg h gl",
}
MONTHS_DE = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner"
# Thai words that carry a clause on behind a figure or a foreign word.
THAI_GOES_ON = (
    "คน เป็น จาก แสดง ถึง และ หรือ ใน ปี เดือน วัน ครั้ง บาท เปอร์เซ็นต์ ต่อ ของ ที่ ซึ่ง โดย แห่ง ตัวอย่าง ราย ชิ้น เท่า หน่วย "
    "กลุ่ม ชั่วโมง นาที วินาที กิโลกรัม กรัม เมตร องศา สัปดาห์ ได้ มี ไม่ พบ"
).split()

OPEN = dict(zip("(（[［【〔「『《〈“„«‘‚", ")）]］】〕」』》〉”“»’‘"))
QUOTE_CLOSE = set(")）]］】〕」』》〉”“»’\"")
CONTINUES = set(",;:،؛、，；：-–—‐%")
_CAND = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}\p{SB=Sep}\n\r“”„«»\"()（）\[\]［］【】〔〕「」『』《》〈〉]")
_STERM = frozenset(regex.findall(r"\p{SB=STerm}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))))
_TERMS = _STERM | frozenset(regex.findall(r"\p{SB=ATerm}", "".join(map(chr, range(0xD800))))) | {"．"}
_ENDED = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}][\s\p{Cf}\p{SB=Close}]*$")
_SEP = set("\n\r  \x85")
_SKIP = regex.compile(r"[\s\x1c-\x1f\p{Cf}]*")
_THAI = regex.compile(r"\p{Thai}")
_THAI_GAP = regex.compile(r"(?<=\S)[^\S\n\r]+(?=\S)")
_THAI_NEXT = regex.compile("|".join(sorted(THAI_GOES_ON, key=len, reverse=True)))
# read backwards from a full stop; a foreign word inside Japanese or Chinese begins behind the last sign
_TOKEN = regex.compile(r"[[\p{L}\p{M}\p{N}\p{Cf}.．]--[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f]]*", regex.V1 | regex.REVERSE)
_UPPER, _LOWER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}")
_BRACKET = regex.compile("[" + regex.escape("".join(OPEN) + "".join(OPEN.values()) + '"') + "]")
_DIGIT = regex.compile(r"\p{N}")
_ORDINAL = regex.compile(r"(?:^|[^\p{N}.])(\p{N}{1,2})$")
_CASE = {}


def _set(names: dict, lang: str | None) -> frozenset:
    key = (id(names), lang)
    if key not in _CASE:
        picked = [names[lang]] if lang in names else list(names.values())
        _CASE[key] = frozenset(w for ws in picked for w in ws.split())
    return _CASE[key]


# Letters of one shape from Cyrillic and Greek, for looking up tokens.
_SHAPE = str.maketrans("аеорсухкіјѕԁАВЕКМНОРСТУХІЈЅοναρικνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxkijsdABEKMHOPCTYXIJSovapiknABEZHIKMNOPTYX")


def _plain(token: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", token).translate(_SHAPE) if unicodedata.category(c) != "Cf")


def _swapped(text: str) -> bool:
    if text[:1].islower() or text[1:3].isupper() or text[2:4].isupper():
        up = len(_UPPER.findall(text))
        return up > 8 and up > 2 * len(_LOWER.findall(text))
    return False


def _is_cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "ｦ" <= c <= "ﾟ"


def _closed(text: str) -> set[int]:
    """Places of opening marks that are closed in their line; a closing mark goes with the nearest open one.

    In a text that is cut short, so ends without a mark, the last open one too counts: its end is what is missing."""
    out: set[int] = set()
    open_: list[tuple[str, int]] = []
    for line in regex.finditer(r"[^\n\r\u2028\u2029\x85]+", text):
        open_ = []
        for m in _BRACKET.finditer(text, line.start(), line.end()):
            c, k = m.group(), m.start()
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == c), None)
            if at is not None:
                out.add(open_[at][1])
                del open_[at:]
            elif c in OPEN or c == '"':
                open_.append((OPEN.get(c, c), k))
    if open_ and not _ENDED.search(text):
        out.add(open_[-1][1])
    return out


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, 0-based code points, end without trailing blanks."""
    if not text:
        return []
    n = len(text)
    cur = _SKIP.match(text).end()
    if cur >= n:
        return []
    if _swapped(text):
        flipped = text.swapcase()
        if len(flipped) == n:
            text = flipped
    always, numbered = _set(ABBREVIATIONS, lang), _set(BEFORE_NUMBER, lang)
    starts = [cur]
    stack: list[tuple[str, bool]] = []
    closed = _closed(text) if _BRACKET.search(text) else ()
    done = 0

    def cut(at: int) -> None:
        nonlocal cur, done
        at = _SKIP.match(text, at).end()
        if cur < at < n:
            starts.append(at)
        cur, done = max(cur, at), max(done, at)

    for m in _CAND.finditer(text):
        k = m.start()
        c = text[k]
        if c in _SEP:
            stack.clear()
            cut(k + 1)
            continue
        if k < done:
            continue
        if stack and c == stack[-1][0]:
            _, at_start = stack.pop()
            if stack:
                continue
            p = k - 1
            while p > 0 and unicodedata.category(text[p]) == "Cf":
                p -= 1
            if text[p] not in _TERMS:
                continue
            q = _SKIP.match(text, k + 1).end()
            if q >= n or any(x in _SEP for x in text[k + 1 : q]):
                continue
            nxt = text[q]
            if nxt in CONTINUES or nxt in QUOTE_CLOSE and nxt not in OPEN or nxt.islower() or nxt in _TERMS:
                continue
            if at_start or nxt.isupper() or nxt in OPEN or (q > k + 1 and not _is_cjk(nxt)):
                cut(k + 1)
            continue
        if c in OPEN or c == '"':
            if k in closed:
                stack.append((OPEN.get(c, c), k == cur))
            continue
        if stack or c not in _TERMS:
            continue
        j = k + 1  # the run of marks, closing signs and invisible characters
        dots, strong = c != "。" and c not in _STERM, c in _STERM
        run = 1
        while j < n and (text[j] in _TERMS or text[j] in "…" or unicodedata.category(text[j]) == "Cf" or text[j] in ")）]］】」』”’"):
            if text[j] in _STERM:
                strong = True
            if text[j] in ".．…":
                run += 1
            j += 1
        q = _SKIP.match(text, j).end()
        if q >= n or any(x in _SEP for x in text[j:q]):
            done = max(done, j)
            continue
        nxt, gap = text[q], any(x.isspace() for x in text[j:q])
        if nxt in CONTINUES or nxt in QUOTE_CLOSE and nxt not in OPEN or nxt.islower():
            continue
        p = k - 1
        while p >= 0 and unicodedata.category(text[p]) == "Cf":
            p -= 1
        prev = text[p] if p >= 0 else " "
        if strong:
            if run > 1 and dots and not nxt.isupper():
                continue
            cut(j)
            continue
        if run > 1 or prev in "…":  # dots inside a clause
            if nxt.isupper() and gap:
                cut(j)
            continue
        if _is_cjk(prev) or _is_cjk(nxt) and c == "．" and not _DIGIT.match(prev):
            cut(j)
            continue
        if not gap and _DIGIT.match(nxt):
            continue
        token = _plain(_TOKEN.match(text, 0, k).group())
        low = token.lower().strip(".")
        last = low.rpartition(".")[2]
        if low in always or last in always:
            continue
        if _DIGIT.match(nxt) and (low in numbered or last in numbered):
            continue
        if last and len(last) == 1 and last.isalpha() and not _is_cjk(last):
            continue
        if last.isdigit():
            if cur == k - len(token) and len(last) < 3:  # the number of a heading
                continue
            if _ORDINAL.search(text[:k][-4:]) and gap and text.startswith(tuple(MONTHS_DE.split()), q):
                continue
        if gap or nxt.isupper() or _is_cjk(nxt) or nxt in OPEN:
            cut(j)
    if _THAI.search(text):
        starts = sorted({*starts, *_thai(text)})
    out = []
    for i, s in enumerate(starts):
        e = starts[i + 1] if i + 1 < len(starts) else n
        while e > s and text[e - 1].isspace():
            e -= 1
        out.append((s, e))
    return out


def _thai(text: str) -> list[int]:
    found = []
    for m in _THAI_GAP.finditer(text):
        before, after = text[m.start() - 1], text[m.end()]
        if not _THAI.match(after):
            continue
        if not _THAI.match(before) and before not in "”\"')]?!":
            if not _DIGIT.match(before) and before != "%":
                continue
            if _THAI_NEXT.match(text, m.end()):
                continue
        found.append(m.end())
    return found


def sentence_starts(text: str | None, lang: str | None = None) -> list[int]:
    return [s for s, _ in sentence_spans(text, lang)]


def with_sentences(df, text: str, lang: str | None = None):
    """One row per sentence: ``start_at``, ``end_at``, ``sentence`` beside the other columns.

    The language picks the abbreviations; where it is null those of all languages hold.
    """
    from pyspark.sql import functions as F

    @F.pandas_udf("array<struct<start_at:int,end_at:int>>")
    def spans(t: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else sentence_spans(x, y) for x, y in zip(t, g)], dtype=object)

    g = F.col(lang) if lang else F.lit(None).cast("string")
    d = df.select(*[c for c in df.columns if c not in ("start_at", "end_at", "sentence")], F.explode(spans(F.col(text), g)).alias("_s"))
    cut = F.substring(F.col(text), F.col("_s.start_at") + 1, F.col("_s.end_at") - F.col("_s.start_at"))
    return d.select(*[c for c in d.columns if c != "_s"], F.col("_s.start_at").alias("start_at"), F.col("_s.end_at").alias("end_at"), cut.alias("sentence"))
