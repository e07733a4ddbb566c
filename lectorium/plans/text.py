"""Text queries: scripts, facts, citations, glossary, anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectorium.functions import facts as X
from lectorium.functions import text as T
from lectorium.operators import citations as C
from lectorium.plans.library import _ANN, _BLK, _RES, blocks, notes, results
from lectorium.plans.registry import query
from lectorium.sources.tables import table


def docs(spark, root, *cols):
    return table(spark, root, "documents", "doc_id", "text", *cols).where("text IS NOT NULL")


@query("fn_normal_text", f"SELECT doc_id, md5(lower(trim(regexp_replace(text, '{T.SPACES}+', ' ', 'g')))) h FROM documents WHERE text IS NOT NULL".replace("\\u000B", "\\x0B"))
def _(spark, root):
    return docs(spark, root).select("doc_id", F.md5(T.normal_block_text(F.col("text"))).alias("h"))


@query("fn_sha256", "SELECT task_id, sha256(text) h FROM translation_tasks WHERE text IS NOT NULL")
def _(spark, root):
    return table(spark, root, "translation_tasks", "task_id", "text").where("text IS NOT NULL").select("task_id", T.sha256(F.col("text")).alias("h"))


@query("fn_block_ids")
def _(spark, root):
    b = blocks(spark, root, "block_role", "page_start", "text", "bbox").where("text IS NOT NULL")
    return b.select("paper_id", "block_id", T.block_id(F.col("block_role"), F.col("page_start"), F.col("text"), F.col("bbox.x_left"), F.col("bbox.y_top"), F.col("bbox.width"), F.col("bbox.height")).alias("stable_id"), T.djb2_column(F.col("text")).alias("anchor"))


_WIDE, _PLAIN = (("".join(map(chr, range(x, x + 94))) + y).replace("'", "''") for x, y in ((0xFF01, "\u3000"), (0x21, " ")))


@query("fn_half_width", f"SELECT cache_id, translate(translated_text, '{_WIDE}', '{_PLAIN}') AS text FROM translation_cache")
def _(spark, root):
    return table(spark, root, "translation_cache", "cache_id", "translated_text").select("cache_id", T.half_width(F.col("translated_text")).alias("text"))


@query("lng_01_script_share", "SELECT doc_id, round(CASE WHEN length(s) > 0 THEN 1 - length(regexp_replace(s, '[ぁ-ヿ一-鿿]', '', 'g')) / length(s) ELSE 0 END, 6)::DOUBLE share FROM (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') s FROM documents WHERE text IS NOT NULL)")
def _(spark, root):
    return docs(spark, root).select("doc_id", F.round(X.script_share(F.col("text"), "[ぁ-ヿ一-鿿]"), 6).alias("share"))


@query(
    "lng_01_japanese_papers",
    _BLK + ", p AS (SELECT paper_id, CASE WHEN length(s) > 0 THEN 1 - length(regexp_replace(s, '[ぁ-ヿ一-鿿]', '', 'g')) / length(s) ELSE 0 END r FROM (SELECT paper_id, regexp_replace(text, '\\s+', '', 'g') s FROM blk WHERE block_role = 'paragraph' AND length(text) >= 40)) "
    "SELECT paper_id, count(*) n, (count(*) FILTER (r >= 0.18) >= 0.45 * count(*)) japanese FROM p GROUP BY 1 HAVING count(*) >= 3",
)
def _(spark, root):
    b = blocks(spark, root, "block_role", "text").where("block_role = 'paragraph' AND length(text) >= 40")
    g = b.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_if(X.script_share(F.col("text"), "[ぁ-ヿ一-鿿]") >= 0.18).alias("k"))
    return g.where("n >= 3").select("paper_id", "n", (F.col("k") >= 0.45 * F.col("n")).alias("japanese"))


@query(
    "qlt_01_counts",
    "SELECT doc_id, len(regexp_extract_all(text, '\\b(?:1[5-9][0-9]{2}|20[0-9]{2})\\b')) AS n_years, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%')) AS n_percents, len(regexp_extract_all(text, '\\bp < \\.?[0-9.]+')) AS p_values FROM documents WHERE text IS NOT NULL",
)
def _(spark, root):
    d = docs(spark, root)
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), 0)).cast("long")
    return d.select("doc_id", n(r"(?<![0-9A-Za-z_])(?:1[5-9][0-9]{2}|20[0-9]{2})(?![0-9A-Za-z_])").alias("n_years"), n(r"[0-9]+(?:\.[0-9]+)?%").alias("n_percents"), n(r"(?<![0-9A-Za-z_])p < \.?[0-9.]+").alias("p_values"))


@query("qlt_01_invariants")
def _(spark, root):
    d = results(spark, root, "text").where("text IS NOT NULL")
    return d.select("result_id", F.explode(X.invariants_column(F.col("text"))).alias("f")).select("result_id", "f.kind", "f.value", "f.at")


@query("qlt_02_preservation")
def _(spark, root):
    r = results(spark, root, "task_id", "text").where("text IS NOT NULL")
    t = table(spark, root, "translation_tasks", "task_id", "text").withColumnRenamed("text", "source_text")
    return r.join(t, "task_id").select("result_id", X.preservation_column(F.col("source_text"), F.col("text")).alias("p")).select("result_id", "p.*")


@query(
    "qlt_03_degenerate",
    _RES + "SELECT result_id, round(len(list_distinct(string_split(text, ''))) / length(text), 6)::DOUBLE unique_share, contains(text, chr(65533)) broken FROM res WHERE text IS NOT NULL AND text <> ''",
)
def _(spark, root):
    r = results(spark, root, "text").where("text IS NOT NULL AND text <> ''")
    return r.select("result_id", F.round(X.unique_share(F.col("text")), 6).alias("unique_share"), X.broken_bytes(F.col("text")).alias("broken"))


@query(
    "cit_01_keys",
    "WITH t AS (SELECT l_orderkey k, 'see [' || (l_linenumber) || '] and [' || l_linenumber || '-' || (l_linenumber + 2) || ', ' || (l_quantity::INT) || ']' AS text, l_linenumber a, l_quantity::INT q FROM lineitem) "
    "SELECT k, a, list_sort(list_distinct([a, a + 1, a + 2, q]))::VARCHAR AS keys FROM t",
)
def _(spark, root):
    d = table(spark, root, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    a = F.col("l_linenumber").cast("string")
    t = F.concat(F.lit("see ["), a, F.lit("] and ["), a, F.lit("-"), (F.col("l_linenumber") + 2).cast("string"), F.lit(", "), F.col("l_quantity").cast("int").cast("string"), F.lit("]"))
    keys = F.array_sort(C.citation_keys(t))
    return d.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("a"), F.concat(F.lit("["), F.array_join(F.transform(keys, lambda x: x.cast("string")), ", "), F.lit("]")).alias("keys"))


@query("cit_03_unique_references", _BLK + ", r AS (SELECT paper_id, block_id, regexp_extract(trim(text), '^(\\[[0-9]+\\]|[0-9]+\\.\\s+[A-Z])') head FROM blk WHERE block_role IN ('reference', 'paragraph')) SELECT paper_id, regexp_extract(head, '[0-9]+') num, min(block_id) target FROM r WHERE head <> '' GROUP BY 1, 2 HAVING count(*) = 1")
def _(spark, root):
    return C.unique_references(blocks(spark, root, "block_role", "text"), "paper_id", "block_id", "block_role")


@query("glo_01_applied")
def _(spark, root):
    g = table(spark, root, "glossary_entries", "term", "translation", "target_language").where("target_language = 'ja'").orderBy("term", "translation").limit(5001).collect()
    if len(g) > 5000:
        raise ValueError("the glossary is a bounded table")
    entries = tuple({r.term: r.translation for r in g}.items())
    t = table(spark, root, "translation_tasks", "task_id", "text")
    return t.select("task_id", C.glossary_column(F.col("text"), entries).alias("text"))


@query(
    "glo_03_merged",
    "WITH a AS (SELECT term, translation, entry_id ord, 0 s FROM glossary_entries WHERE target_language = 'de' UNION ALL SELECT upper(term), translation, entry_id, 1 FROM glossary_entries WHERE target_language = 'ja') "
    "SELECT arg_max(term, (s, ord)) term, arg_max(translation, (s, ord)) AS translation, min(s) side, arg_min(ord, (s, ord)) ord FROM a GROUP BY lower(trim(term))",
)
def _(spark, root):
    g = table(spark, root, "glossary_entries").withColumnRenamed("entry_id", "ord")
    return C.merged_glossaries(g.where("target_language = 'de'").select("term", "translation", "ord"), g.where("target_language = 'ja'").select(F.upper("term").alias("term"), "translation", "ord"))


@query("ann_01_context", _ANN.join(["WITH ", ""]) + "SELECT a.id, substring(text, greatest(start_offset - 60, 0) + 1, start_offset - greatest(start_offset - 60, 0)) prefix, substring(text, end_offset + 1, 60) suffix FROM ann a JOIN (" + _BLK + "SELECT * FROM blk WHERE text IS NOT NULL) b USING (paper_id, block_id)")
def _(spark, root):
    a = notes(spark, root, "paper_id", "block_id", "start_offset", "end_offset")
    d = a.join(blocks(spark, root, "text").where("text IS NOT NULL"), ["paper_id", "block_id"])
    lo = F.greatest(F.col("start_offset") - 60, F.lit(0))
    return d.select("id", F.substring(F.col("text"), lo + 1, F.col("start_offset") - lo).alias("prefix"), F.substring(F.col("text"), F.col("end_offset") + 1, F.lit(60)).alias("suffix"))


def reanchored(spark, root):
    """Annotations with their place in the latest text of their block (``r``); the context, 60 signs on each side,
    and the test whether the text changed come from the block's first delivery."""
    d = table(spark, root, "layout_blocks", "paper_id", "block_id", "text", "updated_at")
    key = F.struct("updated_at", F.coalesce("text", F.lit("")))
    both = d.groupBy("paper_id", "block_id").agg(F.min_by("text", key).alias("first_text"), F.max_by("text", key).alias("text"))
    a = notes(spark, root, "paper_id", "block_id", "start_offset", "end_offset", "selected_text", "status")
    j = a.join(both, ["paper_id", "block_id"], "left")
    lo = F.greatest(F.col("start_offset") - 60, F.lit(0))
    before = F.substring(F.col("first_text"), lo + 1, F.col("start_offset") - lo)
    behind = F.substring(F.col("first_text"), F.col("end_offset") + 1, F.lit(60))
    same = F.sha2("first_text", 256) == F.sha2("text", 256)
    return j.withColumn("r", C.reanchor_column(F.col("selected_text"), F.col("start_offset"), before, behind, F.col("text"), same))


_PLACED = (
    "WITH " + _ANN + ", f AS (SELECT paper_id, block_id, text FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, block_id ORDER BY updated_at, coalesce(text, '')) k FROM layout_blocks) WHERE k = 1), "
    "l AS (SELECT paper_id, block_id, text FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, block_id ORDER BY updated_at DESC, coalesce(text, '') DESC) k FROM layout_blocks) WHERE k = 1), "
    "j AS (SELECT a.id, start_offset s, selected_text sel, a.status old, l.text lt, coalesce(f.text = l.text, false) same, coalesce(substring(f.text, greatest(start_offset - 60, 0) + 1, start_offset - greatest(start_offset - 60, 0)), '') pre, coalesce(substring(f.text, end_offset + 1, 60), '') post "
    "FROM ann a LEFT JOIN f USING (paper_id, block_id) LEFT JOIN l USING (paper_id, block_id)), "
    "h AS (SELECT id, pre, post, lt, sel, unnest(list_filter(range(0, length(lt)), lambda i: substring(lt, i + 1, length(sel)) = sel)) hit FROM j WHERE NOT same AND sel <> ''), "
    "c AS (SELECT *, substring(lt, greatest(hit - length(pre), 0) + 1, hit - greatest(hit - length(pre), 0)) b4, substring(lt, hit + length(sel) + 1, length(post)) af FROM h), "
    "g AS (SELECT id, hit, list_max(list_filter(range(0, 61), lambda k: k <= least(length(pre), length(b4)) AND right(b4, k) = right(pre, k))) + list_max(list_filter(range(0, 61), lambda k: k <= least(length(post), length(af)) AND left(af, k) = left(post, k))) score FROM c), "
    "b AS (SELECT id, arg_max(hit, (score, -hit)) hit FROM g GROUP BY 1), "
    "r AS (SELECT j.id, s, old, CASE WHEN coalesce(lt, '') = '' OR same OR b.hit IS NULL THEN s ELSE b.hit END::INT AS start, CASE WHEN coalesce(lt, '') = '' OR (NOT same AND b.hit IS NULL) THEN 'orphaned' ELSE 'active' END status, length(sel) n FROM j LEFT JOIN b USING (id)) "
)


@query("ann_02_reanchored", _PLACED + "SELECT id, start, status FROM r")
def _(spark, root):
    return reanchored(spark, root).select("id", "r.start", "r.status")


@query("ann_03_offsets", _ANN.join(["WITH ", ""]) + "SELECT a.id, (substring(text, start_offset + 1, end_offset - start_offset) = selected_text) holds FROM ann a JOIN (" + _BLK + "SELECT * FROM blk WHERE text IS NOT NULL) b USING (paper_id, block_id)")
def _(spark, root):
    a = notes(spark, root, "paper_id", "block_id", "start_offset", "end_offset", "selected_text")
    d = a.join(blocks(spark, root, "text").where("text IS NOT NULL"), ["paper_id", "block_id"])
    return d.select("id", C.offsets_hold(F.col("text"), F.col("start_offset"), F.col("end_offset"), F.col("selected_text")).alias("holds"))


@query(
    "ann_05_segments",
    "WITH " + _ANN + ", r AS (SELECT a.paper_id, a.block_id, id, start_offset s, end_offset e, length(text) n FROM ann a JOIN (" + _BLK + "SELECT * FROM blk WHERE text IS NOT NULL) b USING (paper_id, block_id) WHERE end_offset > start_offset), "
    "p AS (SELECT DISTINCT paper_id, block_id, greatest(0, least(n, unnest([0, n, s, e]))) p FROM r), g AS (SELECT paper_id, block_id, p a, lead(p) OVER (PARTITION BY paper_id, block_id ORDER BY p) b FROM p) "
    "SELECT g.paper_id, g.block_id, g.a::INT seg_start, g.b::INT seg_end, coalesce(string_agg(DISTINCT r.id, ',' ORDER BY r.id), '') ids FROM g LEFT JOIN r ON r.paper_id = g.paper_id AND r.block_id = g.block_id AND r.s < g.b AND r.e > g.a WHERE g.b IS NOT NULL GROUP BY 1, 2, 3, 4",
)
def _(spark, root):
    a = notes(spark, root, "paper_id", "block_id", "start_offset", "end_offset")
    d = a.join(blocks(spark, root, "text").where("text IS NOT NULL"), ["paper_id", "block_id"])
    r = d.select("paper_id", "block_id", "id", F.col("start_offset").alias("start"), F.col("end_offset").alias("stop"), F.length("text").alias("n"))
    s = C.highlight_segments(r, ["paper_id", "block_id"], F.col("n"))
    return s.select("paper_id", "block_id", "seg_start", "seg_end", F.concat_ws(",", "ids").alias("ids"))
