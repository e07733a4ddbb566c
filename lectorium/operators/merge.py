"""Merging snapshots, reconciling ids, validating packages, migrating schemas."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectorium.functions.stretches import bits_of, exact, found
from lectorium.functions.text import SPACES
from lectorium.operators.versions import latest
from lectorium.session import small, spread, stored


def prefer_filled(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer merge: the new row wins, unless only the old one has ``value``; unseen old rows stay."""
    cols = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*cols).alias("_o"))
    n = new.select(*keys, F.struct(*cols).alias("_n"))
    has = lambda s: F.col(s).isNotNull() & (F.coalesce(F.col(f"{s}.{value}"), F.lit("")) != "")
    row = F.when(F.col("_n").isNull() | (has("_o") & ~has("_n")), F.col("_o")).otherwise(F.col("_n"))
    return o.join(n, list(keys), "full_outer").select(*keys, row.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def patched(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Field-wise: a patch value that is not null replaces the stored one; unknown keys are inserted."""
    cols = [c for c in base.columns if c not in keys]
    p = patch.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols if c in patch.columns])
    return base.join(p, list(keys), "full_outer").select(*keys, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in patch.columns else F.col(c) for c in cols])


def coalesced_updates(updates: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last update of each key."""
    return latest(updates, list(keys), [seq])


#: Distance of near boxes, the least score of a match, and the least of pairs that only equal blocks of one page reach.
NEAR = 12
SCORE_LEAST, SCORE_SAME_PAGE = 6, 15
#: Powers of two of the bits in the bitmap of texts.
BITS = (16, 28)
#: Blocks without an equal on their page up to which their keys are broadcast.
FEW = 200_000


def sides(old: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """Blocks of both sides as one frame: the columns of ``pair_scores``, and ``side`` (1 old, 2 new, 3 both)."""
    cols = [doc, "id", "kind", "page", "text", "section", "box_page", "x", "y"]
    return old.select(*cols, F.lit(1).alias("side")).unionByName(new.select(*cols, F.lit(2).alias("side")))


def _normal(blocks: DataFrame, doc: str) -> DataFrame:
    """Blocks with their text in its normal form, which is worked out once, and its digest; none for empty texts."""
    norm = F.lower(F.trim(F.regexp_replace("text", f"{SPACES}+", " ")))  # normal_block_text, whose ends are blanks by then
    d = stored(blocks.select(doc, "id", "side", "kind", "page", "section", "box_page", "x", "y", F.coalesce(norm, F.lit("")).alias("norm")))
    return d.withColumn("t", F.when(F.col("norm") != "", F.unhex(F.md5("norm"))))


#: The groups in which texts are looked for in each other: a type of a document, a page, and the page of a box.
GROUPS = {"g1": (1, "kind"), "g2": (2, "page"), "g3": (2, "box_page")}


def _groups_of(f: pd.DataFrame) -> list[np.ndarray]:
    return [f[g].to_numpy().view(np.uint64) for g in GROUPS]


def _bitmap(d: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of all texts; tasks send the places they set, workers put them together."""

    def places(frames):
        held: list[np.ndarray] = []
        for f in frames:
            for i in range(0, len(f), 4096):
                g = f.iloc[i : i + 4096]
                held.append(bits_of(g.norm.tolist(), _groups_of(g), bits))
        if held:
            at = np.unique(np.concatenate(held))
            cut = np.flatnonzero(np.diff(at >> np.uint64(16), prepend=np.uint64(1 << 50)))
            low = (at & np.uint64(0xFFFF)).astype(np.uint16)
            yield pd.DataFrame({"part": (at[cut] >> np.uint64(16)).astype(np.int32), "low": [x.tobytes() for x in np.split(low, cut[1:])]})

    def packed(frames):
        for f in frames:
            out = []
            for lows in f.lows:
                set_ = np.zeros(1 << 16, np.uint8)
                for x in lows:
                    set_[np.frombuffer(x, np.uint16)] = 1
                out.append(np.packbits(set_, bitorder="little").tobytes())
            yield pd.DataFrame({"part": f.part, "words": out})

    parts = d.select("norm", *GROUPS).mapInPandas(places, "part int, low binary").groupBy("part").agg(F.collect_list("low").alias("lows"))
    bitmap = np.zeros(1 << bits - 6, np.uint64)
    for r in parts.mapInPandas(packed, "part int, words binary").toPandas().itertuples():  # at most 4096 rows of 8 KB
        bitmap[r.part << 10 : r.part + 1 << 10] = np.frombuffer(r.words, np.uint64)
    return bitmap


def _stretches(d: DataFrame, doc: str) -> DataFrame:
    """Blocks with the digests (``t``) of stretches of their text that may be another block's text."""
    d = d.where("norm <> ''").withColumns({g: F.xxhash64(F.lit(k), F.col(doc), F.col(c)) for g, (k, c) in GROUPS.items()}).drop("t")
    bits = min(max((32 * d.count()).bit_length(), BITS[0]), BITS[1])
    bitmap = _bitmap(d, bits)
    cols = [c for c in d.columns if c not in ("norm", *GROUPS)]

    def run(frames):
        for f in frames:
            for i in range(0, len(f), 4096):
                g = f.iloc[i : i + 4096]
                texts = g.norm.tolist()
                hits = {(k, texts[k][p : p + n]) for k, p, n in found(texts, _groups_of(g), bitmap)}
                if hits:
                    rows, parts = zip(*hits)
                    yield g.iloc[list(rows)][cols].assign(t=[exact(x) for x in parts])

    schema = T.StructType([*[d.schema[c] for c in cols], T.StructField("t", T.BinaryType())])
    return spread(d).mapInPandas(run, schema)


def _scored(a: DataFrame, b: DataFrame, on: Column, doc: str, text: int) -> DataFrame:
    """Pairs of rows of ``a`` as old and of ``b`` as new, with their score; near: whether their boxes are."""
    o, n = a.alias("o"), b.alias("n")
    j = o.join(n, (F.col(f"o.{doc}") == F.col(f"n.{doc}")) & on & (F.col("o.side").bitwiseAND(1) * F.col("n.side").bitwiseAND(2) > 0))
    same = lambda c, w: F.when(F.col(f"o.{c}") == F.col(f"n.{c}"), w).otherwise(0)
    section = F.when((F.col("o.section") != "") & (F.col("o.section") == F.col("n.section")), 1).otherwise(0)
    near = F.coalesce(_near(), F.lit(False))
    score = same("kind", 2) + same("page", 2) + F.lit(text) + section + F.when(near, 3).otherwise(0)
    return j.select(F.col(f"o.{doc}").alias(doc), F.col("o.id").alias("o_id"), F.col("n.id").alias("n_id"), score.cast("int").alias("score"), near.alias("near"))


def _near() -> Column:
    return (F.col("o.box_page") == F.col("n.box_page")) & (F.abs(F.col("o.x") - F.col("n.x")) < NEAR) & (F.abs(F.col("o.y") - F.col("n.y")) < NEAR)


def scored_pairs(blocks: DataFrame, doc: str) -> DataFrame:
    """Pairs of old and new blocks (see ``sides``) that reach ``SCORE_LEAST``, once each, with their score.

    Four kinds of pairs that have none in common: equal texts meet on a digest; a text within another meets it on
    the digest of that stretch, which a pass over the texts finds, so no text leaves its task; near boxes meet on
    their page, and those of them that the others hold leave."""
    return _all_pairs(_normal(blocks, doc), doc)


def _all_pairs(d: DataFrame, doc: str) -> DataFrame:
    row = d.drop("norm")
    same_t, group = F.col("o.t") == F.col("n.t"), (F.col("o.kind") == F.col("n.kind")) | (F.col("o.page") == F.col("n.page")) | _near()
    hits = stored(_stretches(d, doc))
    within = _scored(row, hits, same_t & group, doc, 4).unionByName(_scored(hits, row, same_t & group, doc, 4))
    close = _scored(row, row, _near() & ~F.coalesce(same_t, F.lit(False)), doc, 0).where(F.col("score") >= SCORE_LEAST)
    close = close.join(within.where("near").select(doc, "o_id", "n_id"), [doc, "o_id", "n_id"], "left_anti")
    return _scored(row, row, same_t, doc, 8).unionByName(within).unionByName(close.select(doc, "o_id", "n_id", "score", "near")).drop("near")


def pair_scores(old: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """Candidate pairs of old and new blocks of a document and their score.

    type 2, page 2, equal text 8, else one text within the other 4, same section 1, near box on one page 3; texts
    are compared in their normal form, and empty texts and sections are equal to none.  old, new: id, kind, page,
    text, section, box_page, x, y.  Pairs are those that reach ``SCORE_LEAST`` or share a page.
    """
    d = _normal(sides(old, new, doc), doc)
    row = d.drop("norm")
    both = _all_pairs(d, doc).unionByName(_scored(row, row, F.col("o.page") == F.col("n.page"), doc, 0).drop("near"))
    return both.groupBy(doc, "o_id", "n_id").agg(F.max("score").alias("score"))


def reconciled(pairs: DataFrame, doc: str, least: int = SCORE_LEAST) -> DataFrame:
    """Greedy one-to-one matching per document, best score first, ties by (old, new) id.

    The pairs of a document pass in that order through one task, which holds the ids that are taken, not the
    pairs."""
    order = [F.col(doc), F.desc("score"), F.col("o_id"), F.col("n_id")]
    d = pairs.where(F.col("score") >= least).select(doc, "o_id", "n_id", "score")
    return d.repartition(doc).sortWithinPartitions(*order).mapInPandas(partial(_greedy, 1), d.schema)


def _greedy(keys: int, frames):
    """Rows whose old and new id no row before them took; of one (doc, ...) after the other, the first columns."""
    at, old, new = None, set(), set()
    for f in frames:
        keep = []
        for k, (*key, o, n) in enumerate(zip(*[f.iloc[:, c] for c in range(keys)], f.o_id, f.n_id)):
            if key != at:
                at, old, new = key, set(), set()
            if o not in old and n not in new:
                old.add(o)
                new.add(n)
                keep.append(k)
        yield f.iloc[keep]


def reconciled_blocks(blocks: DataFrame, doc: str) -> DataFrame:
    """``reconciled`` over all pairs of blocks (see ``sides``), without listing them.

    From ``SCORE_SAME_PAGE`` on a pair is of one page and type, with equal texts and near boxes.  The greedy order
    takes those first, so they are matched page by page; only blocks that are then left meet each other."""
    blocks = _normal(blocks, doc)
    cell = [doc, "page", "kind", "t"]
    row = blocks.drop("norm").dropna(subset=cell)
    cells = row.groupBy(*cell).agg(F.collect_list(F.struct("id", "side", "section", "box_page", "x", "y")).alias("all"))
    o = cells.select(*cell, F.explode("all").alias("o"), "all").where("o.side IN (1, 3)")
    p = o.select(*cell, "o", F.explode("all").alias("n")).where("n.side IN (2, 3)").where(_near())
    section = F.when((F.col("o.section") != "") & (F.col("o.section") == F.col("n.section")), 1).otherwise(0)
    p = p.select(*cell, F.col("o.id").alias("o_id"), F.col("n.id").alias("n_id"), (F.lit(SCORE_SAME_PAGE) + section).alias("score"))
    p = p.repartition(*cell).sortWithinPartitions(*cell, F.desc("score"), "o_id", "n_id")
    first = stored(p.mapInPandas(partial(_greedy, len(cell)), p.schema).select(doc, "o_id", "n_id", "score"))
    keys = blocks.select(doc, "id", "side")
    left = lambda c, side: keys.where(F.col("side").bitwiseAND(side) > 0).select(doc, "id").join(first.select(doc, F.col(c).alias("id")), [doc, "id"], "left_anti").withColumn("_side", F.lit(side))
    rest = stored(left("o_id", 1).unionByName(left("n_id", 2)).groupBy(doc, "id").agg(F.bit_or("_side").alias("_side")))
    d = blocks.join(small(rest, FEW), [doc, "id"]).withColumn("side", F.col("side").bitwiseAND(F.col("_side"))).where("side > 0").drop("_side")
    return first.unionByName(reconciled(_all_pairs(stored(d), doc), doc))


def remapped(df: DataFrame, matches: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Ids replaced by their match; ids without one stay.  matches: keys, o_id, n_id."""
    m = matches.select(*keys, F.col("o_id").alias(column), F.col("n_id").alias("_new"))
    return df.join(m, [*keys, column], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


#: A rule: code, severity, and a function of the tables that gives the offending ids.
Rule = tuple[str, str, Callable[[dict[str, DataFrame]], DataFrame]]


def violations(tables: dict[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """Union of all rules' findings: code, severity, doc, item."""
    found = [f(tables).select(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.col("doc").cast("string").alias("doc"), F.col("item").cast("string").alias("item")) for c, s, f in rules]
    return reduce(DataFrame.unionByName, found)


def _dup(t: str, doc: str, key: str):
    return lambda ts: ts[t].groupBy(F.col(doc).alias("doc"), F.col(key).alias("item")).count().where("count > 1")


def _missing(child: str, doc: str, ref: str, parent: str, key: str, whole: bool = False):
    """References without a parent row, within their document or (``whole``) anywhere."""
    if whole:
        return lambda ts: ts[child].select(F.col(ref).alias("item")).distinct().join(ts[parent].select(F.col(key).alias("item")), "item", "left_anti").select(F.col("item").alias("doc"), "item")
    return lambda ts: ts[child].where(F.col(ref).isNotNull()).select(F.col(doc).alias("doc"), F.col(ref).alias("item")).distinct().join(ts[parent].select(F.col(doc).alias("doc"), F.col(key).alias("item")).distinct(), ["doc", "item"], "left_anti")


def _where(t: str, doc: str, key: str, bad: Column):
    return lambda ts: ts[t].where(bad).select(F.col(doc).alias("doc"), F.col(key).alias("item"))


def _joined(child: str, doc: str, key: str, parent: str, on: dict[str, str], bad: Column):
    """Rows of a child whose parent row makes ``bad`` true."""
    return lambda ts: ts[child].join(ts[parent].select(*[F.col(c).alias(a) for a, c in on.items()]), list(on)[: len(on) - 1]).where(bad).select(F.col(doc).alias("doc"), F.col(key).alias("item"))


def library_rules() -> list[Rule]:
    """Rules that need the other tables: papers, memberships, tasks, results."""
    size = F.col("_text")
    return [
        ("UNKNOWN_PAPER", "error", _missing("blocks", "paper_id", "paper_id", "papers", "id", whole=True)),
        ("EMPTY_PAPER", "warning", lambda ts: ts["papers"].join(ts["blocks"].select(F.col("paper_id").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("doc"), F.col("id").alias("item"))),
        ("PAGE_COUNT", "error", _joined("blocks", "paper_id", "block_id", "papers", {"paper_id": "id", "_pages": "page_count"}, F.col("page_end") > F.col("_pages"))),
        ("REVISION", "error", _where("papers", "id", "id", F.col("package_revision") < 0)),
        ("TASK_BLOCK", "warning", _missing("tasks", "paper_id", "block_id", "blocks", "block_id")),
        ("RESULT_TASK", "error", lambda ts: ts["results"].join(ts["tasks"].select("task_id"), "task_id", "left_anti").select(F.col("result_id").alias("doc"), F.col("task_id").alias("item"))),
        ("OFFSET_BEYOND", "error", _joined("annotations", "paper_id", "id", "blocks", {"paper_id": "paper_id", "block_id": "block_id", "_text": "text"}, F.col("end_offset") > F.length(size))),
        ("SELECTION", "warning", _joined("annotations", "paper_id", "id", "blocks", {"paper_id": "paper_id", "block_id": "block_id", "_text": "text"}, F.substring(size, F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")) != F.col("selected_text"))),
        ("BLANK_HEADING", "warning", _where("blocks", "paper_id", "block_id", (F.col("block_role") == "heading") & (F.trim("text") == ""))),
    ]


def package_rules() -> list[Rule]:
    """Rules over blocks, annotations, tasks: duplicates, missing targets, page and box sanity, gaps."""
    box = F.col("bbox")
    sane = (box["width"] > 0) & (box["height"] > 0) & ~F.isnan(box["x_left"]) & ~F.isnan(box["y_top"]) & (box["x_left"] >= 0) & (box["y_top"] >= 0)
    return [
        ("DUPLICATE_BLOCK_ORDER", "error", lambda ts: ts["blocks"].groupBy(F.col("paper_id").alias("doc"), F.col("block_order").alias("item")).count().where("count > 1")),
        ("MISSING_TEXT", "warning", _where("blocks", "paper_id", "block_id", F.col("text").isNull() & (F.col("block_role") != "figure"))),
        ("PAGE_RANGE", "error", _where("blocks", "paper_id", "block_id", (F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start")))),
        ("BOX", "error", _where("blocks", "paper_id", "block_id", ~sane)),
        ("BOX_PAGE", "warning", _where("blocks", "paper_id", "block_id", ~box["page"].between(F.col("page_start"), F.col("page_end")))),
        ("ANNOTATION_BLOCK", "error", _missing("annotations", "paper_id", "block_id", "blocks", "block_id")),
        ("OFFSETS", "error", _where("annotations", "paper_id", "id", F.col("end_offset") < F.col("start_offset"))),
    ]


def valid(found: DataFrame) -> DataFrame:
    """One row: ``ok`` when no rule of severity error fired."""
    return found.agg((F.count_if(F.col("severity") == "error") == 0).alias("ok"), F.count("*").alias("n"))


def with_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Migration step: columns that are missing, with their default."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def deduped(df: DataFrame, by: str, key: str) -> DataFrame:
    """Migration step: of rows of one ``by`` the least key stays; rows without it stay all."""
    keep = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(key).alias(key)).select(key)
    return df.join(keep, key, "left_semi").unionByName(df.where(F.col(by).isNull()))


def migrated(df: DataFrame, version: int, steps: dict[int, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply the numbered steps after ``version`` in order."""
    for k in sorted(steps):
        if k > version:
            df = steps[k](df)
    return df


def stale(index: DataFrame, packages: DataFrame, key: str) -> DataFrame:
    """Keys whose indexed revision differs from the package's, or that are not indexed."""
    i = index.select(key, F.col("revision").alias("_r"))
    return packages.join(i, key, "left").where(~F.col("revision").eqNullSafe(F.col("_r"))).select(key)
