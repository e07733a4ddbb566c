"""Source and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectorium.operators import layout as L
from lectorium.plans.library import _BLK, blocks
from lectorium.plans.registry import query
from lectorium.session import shared_folder
from lectorium.sources import packages as P
from lectorium.sources.tables import table


def _blocks(spark, root):
    b = L.under_heading(blocks(spark, root, "block_order", "block_role", "text"))
    return b.select(F.col("paper_id").alias("doc_id"), "block_id", F.col("block_order").alias("ord"), "section", F.col("block_role").alias("kind"), F.col("text").alias("original"), F.lit(None).cast("string").alias("translated"))


@query(
    "snk_04_markdown",
    _BLK + ", s AS (SELECT paper_id, block_id, block_order, block_role, text, last_value(CASE WHEN block_role = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY block_order, block_id ROWS UNBOUNDED PRECEDING) section FROM blk), "
    "h AS (SELECT paper_id, section, min(block_order) o FROM s WHERE section IS NOT NULL GROUP BY 1, 2), n AS (SELECT paper_id, o * 2 pos, '## ' || section t FROM h UNION ALL SELECT paper_id, block_order * 2 + 1, text || chr(10) || '<!-- block: ' || block_id || ' -->' FROM s WHERE block_role <> 'heading' AND text IS NOT NULL) "
    "SELECT paper_id doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY pos) || chr(10)) h FROM n GROUP BY 1",
)
def _(spark, root):
    return P.to_markdown(P.blocks_to_nodes(_blocks(spark, root))).select("doc_id", F.md5("source").alias("h"))


@query("src_14_markdown_nodes")
def _(spark, root):
    return P.parsed_markdown(P.to_markdown(P.blocks_to_nodes(_blocks(spark, root))))


@query("snk_06_failed_policy")
def _(spark, root):
    b = _blocks(spark, root)
    bad = blocks(spark, root, "extraction_confidence", "text").where("extraction_confidence < 0.7").select(F.col("paper_id").alias("doc_id"), "block_id", F.col("text").alias("original"))
    return P.failed_policy(P.blocks_to_nodes(b), bad, "original")


@query("snk_01_staged_write", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, root):
    path = f"{shared_folder(spark)}/package-{uuid.uuid4().hex}"
    d = table(spark, root, "nation", "n_nationkey", "n_name", "n_regionkey")
    P.staged_write(d.limit(1), path)
    P.staged_write(d, path)
    return spark.read.parquet(path)


@query("hlp_03_status_map", "SELECT paper_id, count(*) n FROM translation_tasks GROUP BY 1")
def _(spark, root):
    t = table(spark, root, "translation_tasks", "paper_id", "task_id", "status")
    m = t.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("task_id").cast("string"), "status"))).alias("m"))
    return m.select("paper_id", F.size("m").cast("long").alias("n"))
