"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.operators.ordered import with_next
from lectorium.operators.versions import latest
from lectorium.session import spread, stored
from lectorium.sources.tables import table


def results(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """translation_results, one row per result_id, texts that are not null."""
    d = table(spark, root, "translation_results", "result_id", "ingested_at", *columns)
    return latest(d, ["result_id"], ["ingested_at"]).where(F.col("text").isNotNull()).select("result_id", *columns)


def p4_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.scannoise import paragraphs

    return paragraphs(*p4_lines(spark, root))


def p6_forms(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.lookalike import with_form

    cache = table(spark, root, "translation_cache", "cache_id", "translated_text")
    both = cache.select(F.lit("translation_cache").alias("src_table"), F.col("cache_id").alias("row_id"), F.col("translated_text").alias("text")).unionByName(
        results(spark, root, "text").select(F.lit("translation_results").alias("src_table"), F.col("result_id").alias("row_id"), "text")
    )
    return with_form(both, "text").select("src_table", "row_id", "form")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.lookalike import same_look_pairs

    cache = spread(table(spark, root, "translation_cache", "cache_id", "text_hash", "translated_text"))
    a = same_look_pairs(cache, "translation_cache", "cache_id", "text_hash", "translated_text")
    b = same_look_pairs(results(spark, root, "task_id", "text"), "translation_results", "result_id", "task_id", "text")
    return a.unionByName(b)


def p6_classes(spark: SparkSession, root: str) -> DataFrame:
    """Every text with the class of those that look the same, and the number of its links."""
    from lectorium.llm.lookalike import same_look_classes

    cache = spread(table(spark, root, "translation_cache", "cache_id", "text_hash", "translated_text"))
    a = same_look_classes(cache, "translation_cache", "cache_id", "text_hash", "translated_text")
    return a.unionByName(same_look_classes(results(spark, root, "task_id", "text"), "translation_results", "result_id", "task_id", "text"))


def p1_shares(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.repetition import fitted, with_shares

    model = fitted(table(spark, root, "translation_results", "text"), "text")
    d = results(spark, root, "via", "text")
    return with_shares(d, "text", model).select("result_id", "via", "marked_share", "repeat_share", "keep")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Results that the content share of the field does not keep, of which the exact measure confirms 30 %."""
    return p1_shares(spark, root).where("NOT keep AND repeat_share >= 0.3").select("result_id")


def p2_sentences(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.sentences import with_sentences

    units = spread(latest(table(spark, root, "translation_units", "unit_id", "lang", "text").where("text IS NOT NULL"), ["unit_id"], ["text", "lang"]))
    both = units.select(F.lit("translation_units").alias("src_table"), F.col("unit_id").alias("row_id"), "lang", "text").unionByName(
        results(spark, root, "target_language", "text").select(F.lit("translation_results").alias("src_table"), F.col("result_id").alias("row_id"), F.col("target_language").alias("lang"), "text")
    )
    return with_sentences(both, "text", "lang").select("src_table", "row_id", "start_at", "end_at", "sentence")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_sentences(spark, root).select("src_table", "row_id", "start_at")


def blocks(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """layout_blocks, the latest delivery of each (paper_id, block_id)."""
    d = table(spark, root, "layout_blocks", "paper_id", "block_id", "updated_at", *columns)
    return latest(d, ["paper_id", "block_id"], ["updated_at"])


def p3_values(spark: SparkSession, root: str) -> DataFrame:
    """Every value with its log-odds; blocks carry the start of the paragraph behind them."""
    return _p3(spark, root).drop("source")


def _p3(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.truncation import cut_values

    b = blocks(spark, root, "block_order", "block_role", "producer", "text")
    b = b.withColumn("start", F.when(F.col("block_role").isin("paragraph", "footnote"), F.substring("text", 1, 60)))
    b = with_next(b, ["paper_id"], "block_order", "block_id", ["start"]).withColumnRenamed("next_start", "follow")
    plain_end = F.col("block_role").isin("heading", "caption", "list", "reference", "figure")
    lang = F.when(F.col("text").rlike(r"[\u3040-\u30ff]"), "ja").when(F.col("text").rlike(r"(?i)\b(der|die|das|und|nicht|wurde)\b"), "de").otherwise("en")
    key = F.to_json(F.struct("paper_id", "block_id"))  # a block is known by both
    a = b.select(F.lit("layout_blocks").alias("src_table"), key.alias("row_key"), lang.alias("lang"), "text", F.when(~plain_end, F.col("follow")).alias("follow"), plain_end.alias("plain_end"), F.col("producer").alias("source"))
    r = results(spark, root, "target_language", "text", "model", "model_version")
    r = r.select(F.lit("translation_results").alias("src_table"), F.col("result_id").cast("string").alias("row_key"), F.col("target_language").alias("lang"), "text", F.lit(None).cast("string").alias("follow"), F.lit(False).alias("plain_end"), F.concat_ws(" ", "model", "model_version").alias("source"))
    return cut_values(a.unionByName(r).where("trim(text) <> ''"))


def _p3_block_id(key):
    return F.when(F.col("src_table") == "layout_blocks", F.get_json_object(key, "$.block_id")).otherwise(F.col(key))


def p3_rates(spark: SparkSession, root: str) -> DataFrame:
    """Values, cut values and rate per producer, and per model and version: the values that were judged, each once."""
    v = _p3(spark, root)
    return v.groupBy("src_table", "source").agg(F.count("*").alias("n_rows"), F.count_if("cut").alias("n_cut")).withColumn("rate", F.round(F.col("n_cut") / F.col("n_rows"), 6))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return p3_values(spark, root).where("cut").select("src_table", _p3_block_id("row_key").alias("row_key")).distinct()


def p4_lines(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, root, "page_lines", "line_id", "paper_id", "page", "line_no", "origin", "text", "y_top", "ingested_at")
    lines = latest(lines, ["line_id"], ["ingested_at"])
    b = blocks(spark, root, "producer", "text", "page_start", "page_end").where("producer = 'ocr' AND text IS NOT NULL")
    return lines, b


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.scannoise import noise

    return noise(*p4_lines(spark, root))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.alignment import aligned

    r = results(spark, root, "task_id", "text", "source_language", "target_language")
    t = latest(table(spark, root, "translation_tasks", "task_id", "text").where("text IS NOT NULL"), ["task_id"], ["text"]).withColumnRenamed("text", "source_text")
    d = r.join(t, "task_id").withColumnRenamed("result_id", "row_id")
    return aligned(d).select(F.col("row_id").alias("result_id"), "src_start", "tgt_start")


def sizes(spark: SparkSession, root: str) -> DataFrame:
    """documents with their size in tokens, written once."""
    from lectorium.llm.tokens import with_tokens

    d = spread(table(spark, root, "documents", "doc_id", "source", "text").where("text IS NOT NULL"))
    return stored(with_tokens(d).select("doc_id", "source", "tokens"))


def p8_assignments(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.packing import packed

    return packed(sizes(spark, root).select("doc_id", "tokens"), table(spark, root, "pack_capacities", "capacity_name", "capacity_tokens"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, fill and the least number of containers per capacity."""
    a = p8_assignments(spark, root).groupBy("capacity_name", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("fill"))
    least = F.ceil(F.sum("fill") / F.col("capacity_tokens"))
    return a.groupBy("capacity_name", "capacity_tokens").agg(F.count("*").alias("n_containers"), least.alias("least_containers"), F.round(F.sum("fill") / (F.count("*") * F.col("capacity_tokens")), 6).alias("fill_share"))


def p9_selection(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.mixing import mixed

    return mixed(sizes(spark, root), table(spark, root, "mix_targets"))[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.mixing import mixed

    return mixed(sizes(spark, root), table(spark, root, "mix_targets"))[1]


def _subjects(spark: SparkSession, root: str) -> DataFrame:
    from lectorium.llm.subjects import scored, subjects_of

    d = spread(table(spark, root, "documents", "doc_id", "text"))
    return subjects_of(*scored(d, table(spark, root, "subject_labels", "doc_id", "subject_code")))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return _subjects(spark, root)


def p10_composition(spark: SparkSession, root: str) -> DataFrame:
    """Documents and characters per subject; a document of several subjects counts for each by its part."""
    s = _subjects(spark, root)
    part = s.groupBy("doc_id").agg((1 / F.count("*")).alias("part"))
    d = table(spark, root, "documents", "doc_id", "text").select("doc_id", F.length("text").alias("n_chars"))
    j = s.join(part, "doc_id").join(d, "doc_id")
    return j.groupBy("subject_code").agg(F.count("*").alias("n_docs"), F.round(F.sum("part"), 6).alias("weight"), F.round(F.sum(F.col("part") * F.col("n_chars")), 2).alias("chars"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v) and k not in ("p4_lines",)}


def oracle_sql() -> dict:
    return {}
