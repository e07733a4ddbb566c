"""Document structure: confidence, fusion, formats, sections, affiliations, sampling of evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectorium.operators.ordered import with_carried
from lectorium.session import small, spread

#: Markers of affiliations up to which they are broadcast.
MOST_MARKS = 200_000


def block_confidence(blocks: DataFrame) -> DataFrame:
    """Mean of four part scores (text, box, order, source), rounded to 2 places, and its band.

    A missing source score counts as 1; a block above its predecessor on the same page loses on order.
    """
    blocks = with_carried(blocks, ["paper_id"], ["block_order", "block_id"], F.struct("page_start", F.col("bbox.y_top").alias("y")), "_prev", own=False)
    text = F.when(F.length(F.trim("text")) >= 3, 1.0).when(F.col("block_role") == "figure", 1.0).otherwise(0.3)
    box = F.when((F.col("bbox.width") > 0) & (F.col("bbox.height") > 0), 1.0).otherwise(0.0)
    back = (F.col("_prev.page_start") == F.col("page_start")) & (F.col("_prev.y") > F.col("bbox.y_top") + 400)
    order = F.when(back, 0.6).otherwise(1.0)
    score = F.floor(((text + box + order + F.coalesce("extraction_confidence", F.lit(1.0))) / 4) * 100 + 0.5) / 100
    return blocks.withColumn("confidence", score).drop("_prev").withColumn("band", F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low"))


def fused(votes: DataFrame, weights: dict[str, float], key: str) -> DataFrame:
    """The value with the greatest sum of weight times confidence per key, ties to the first seen.

    votes: key, source, value, confidence, ord.
    """
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    g = votes.groupBy(key, "value").agg(F.sum(F.coalesce(w[F.col("source")], F.lit(0.5)) * F.col("confidence")).alias("score"), F.min("ord").alias("ord"))
    return g.groupBy(key).agg(F.max_by(F.struct("value", F.round("score", 6).alias("score")), F.struct("score", -F.col("ord"))).alias("b")).select(key, "b.value", "b.score")


def fused_label(votes: DataFrame, weights: dict[str, float], key: str) -> DataFrame:
    """Weighted mean of binary labels per key.  votes: key, source, label (0 or 1), confidence."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(0.5)) * F.col("confidence")
    return votes.groupBy(key).agg(F.round(F.try_divide(F.sum(w * F.col("label")), F.sum(w)), 6).alias("p"))


def detected_format(evidence: DataFrame, rules: dict[str, list[tuple[str, float]]], text: str, key: str, least: float = 0.75, margin: float = 0.12) -> DataFrame:
    """Additive scores of pattern evidence per format; applied at ``least`` with a ``margin``, else generic."""
    d = evidence
    for name, patterns in rules.items():
        d = d.withColumn(f"_{name}", sum((F.when(F.col(text).rlike(p), F.lit(v)).otherwise(0.0) for p, v in patterns), F.lit(0.0)))
    scores = F.sort_array(F.array(*[F.struct(F.col(f"_{n}").alias("s"), F.lit(n).alias("n")) for n in rules]), asc=False)
    d = d.withColumn("_b", scores)
    second = F.when(F.size("_b") > 1, F.col("_b")[1]["s"]).otherwise(0.0)
    ok = (F.col("_b")[0]["s"] >= least) & (F.col("_b")[0]["s"] - second >= margin)
    return d.select(key, F.when(ok, F.col("_b")[0]["n"]).otherwise("generic").alias("format"), F.round(F.col("_b")[0]["s"], 6).alias("score"))


def affiliated(authors: DataFrame, affiliations: DataFrame, doc: str) -> DataFrame:
    """AFFILIATED_WITH edges: by shared marker, else the only affiliation, else by place when counts agree.

    authors, affiliations: doc, id, ord, markers (array).
    Rows meet on (doc, marker), and a pair with several shared markers is kept at the least of them; authors without
    a shared marker are found before they are paired, so no document is paired with itself."""
    marks = F.array_distinct(F.filter("markers", lambda m: m.isNotNull()))
    a = spread(authors.select(doc, F.col("id").alias("source"), F.col("ord").alias("ord"), marks.alias("a_marks")))
    b = affiliations.select(doc, F.col("id").alias("target"), F.col("ord").alias("ord"), marks.alias("b_marks"))
    on = b.select(doc, "target", "b_marks", F.explode("b_marks").alias("mark"))
    once = (F.size("a_marks") == 1) | (F.size("b_marks") == 1) | (F.col("mark") == F.array_min(F.array_intersect("a_marks", "b_marks")))
    marked = a.withColumn("mark", F.explode("a_marks"))
    edges = marked.join(small(on, MOST_MARKS), [doc, "mark"]).where(once).select(doc, "source", "target")
    has = marked.join(small(on.select(doc, "mark").distinct(), MOST_MARKS), [doc, "mark"], "left_semi").select(doc, "source").distinct()
    x, y = a.alias("x"), has.alias("y")
    bare = x.join(y, (F.col(f"x.{doc}") == F.col(f"y.{doc}")) & F.col("x.source").eqNullSafe(F.col("y.source")), "left_anti").select(doc, "source", "ord")
    n = affiliations.groupBy(doc).agg(F.count("*").alias("n_aff")).join(authors.groupBy(doc).agg(F.count("*").alias("n_aut")), doc)
    only = bare.join(n.where("n_aff = 1").select(doc), doc).join(b.select(doc, "target"), doc).select(doc, "source", "target")
    placed = bare.join(n.where("n_aff > 1 AND n_aff = n_aut").select(doc), doc).join(b.select(doc, "ord", "target"), [doc, "ord"]).select(doc, "source", "target")
    return edges.unionByName(only).unionByName(placed)


def topological(nodes: list, edges: list[tuple]) -> list | None:
    """Kahn's order, ties in the given order; null on a cycle."""
    at = {n: i for i, n in enumerate(nodes)}
    into = {n: 0 for n in nodes}
    out: dict = {n: [] for n in nodes}
    for a, b in edges:
        if a in at and b in at:
            out[a].append(b)
            into[b] += 1
    import heapq

    ready = [at[n] for n in nodes if not into[n]]
    heapq.heapify(ready)
    done = []
    while ready:
        n = nodes[heapq.heappop(ready)]
        done.append(n)
        for b in out[n]:
            into[b] -= 1
            if not into[b]:
                heapq.heappush(ready, at[b])
    return done if len(done) == len(nodes) else None


def topological_order(edges: DataFrame, doc: str) -> DataFrame:
    """Place of each node in its document's order; documents with a cycle keep the order of first mention."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        nodes = list(dict.fromkeys(x for r in f.sort_values(["source", "target"]).itertuples() for x in (r.source, r.target)))
        order = topological(nodes, list(zip(f.source, f.target)))
        return pd.DataFrame({doc: f[doc].iloc[0], "node": order or nodes, "place": range(len(nodes)), "cyclic": order is None})

    return edges.groupBy(doc).applyInPandas(run, f"{doc} string, node string, place int, cyclic boolean")


def below_captions(captions: DataFrame, blocks: DataFrame, reach: float = 280.0) -> DataFrame:
    """The region a caption belongs to: union of the page's blocks within ``reach`` above it.

    captions, blocks: paper_id, page, id, and a box.
    """
    c = captions.select("paper_id", "page", F.col("id").alias("caption"), F.col("y").alias("cy"))
    d = blocks.join(c, ["paper_id", "page"]).where((F.col("y") + F.col("height") <= F.col("cy") + 1) & (F.col("y") >= F.col("cy") - reach) & (F.col("id") != F.col("caption")))
    return d.groupBy("paper_id", "page", "caption").agg(F.round(F.min("x"), 4).alias("x"), F.round(F.min("y"), 4).alias("y"), F.round(F.max(F.col("x") + F.col("width")), 4).alias("right"), F.round(F.max(F.col("y") + F.col("height")), 4).alias("bottom"), F.count("*").alias("n"))


def grouped_lines(lines: DataFrame, same_gap: float = 1.6) -> DataFrame:
    """Append ``block_no``: lines of a page in order, a new block at a change of role or a wide gap.

    lines: doc_id, page, place, text, line_y, height, role.  A line behind one that ends in a hyphen stays.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("place")
    prev = F.lag("text").over(w)
    gap = F.col("line_y") - F.lag("line_y").over(w)
    new = (F.lag("role").over(w) != F.col("role")) | (gap > F.col("height") * same_gap * 1.5) | (gap < 0) | F.col("role").isin("heading", "figure_caption", "table_caption")
    start = F.when(prev.isNull(), True).when(prev.rlike(r"\p{L}[-‐¬­]\s*$"), False).otherwise(new)
    return lines.withColumn("_s", F.coalesce(start, F.lit(True)).cast("int")).withColumn("block_no", F.sum("_s").over(w)).drop("_s")


def hyphen_joined(texts: Column) -> Column:
    """An array of lines as one text; a break inside a word closes up, a coordinated hyphen stays."""
    return F.aggregate(
        texts, F.lit(""),
        lambda a, t: F.when(a == "", F.trim(t)).when(a.rlike(r"\p{Ll}[-‐¬­]$") & t.rlike(r"^\p{Ll}") & ~t.rlike(r"^(and|or|und|oder)\b"), F.concat(F.regexp_replace(a, r"[-‐¬­]$", ""), F.trim(t))).otherwise(F.concat(a, F.lit(" "), F.trim(t))),
    )


def continued(blocks: DataFrame) -> DataFrame:
    """Append ``continues``: the paragraph before ends inside a sentence and this one starts inside one."""
    blocks = with_carried(blocks, ["paper_id"], ["block_order", "block_id"], F.when(F.col("block_role") == "paragraph", F.col("text")), "_before", own=False)
    before = F.col("_before")
    c = (F.col("block_role") == "paragraph") & ~F.rtrim(before).rlike(r"[.!?。．！？:：][\"”’)\]」』]*$") & F.col("text").rlike(r"^\s*[\p{Ll}(]")
    return blocks.withColumn("continues", F.coalesce(c, F.lit(False))).drop("_before")


def replaced_pages(native: DataFrame, ocr: DataFrame, keys: list[str]) -> DataFrame:
    """Items of pages that were read again come from there, all others stay; ``source`` says which."""
    pages = ocr.select(*keys).distinct()
    kept = native.join(pages, keys, "left_anti").withColumn("source", F.lit("native"))
    return kept.unionByName(ocr.withColumn("source", F.lit("ocr")), allowMissingColumns=True)
