"""Queries on references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.operators.orphans import live_parents, orphan_report, orphans, references
from lectorium.operators.versions import latest
from lectorium.plans.registry import query
from lectorium.sources.tables import table


def parents_and_references(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    blocks = table(spark, root, "layout_blocks", "paper_id", "block_id", "created_at", "updated_at", "deleted_at")
    papers = table(spark, root, "papers", "id", "created_at", "updated_at", "deleted_at")
    parents = live_parents(blocks, "block", ["paper_id", "block_id"]).unionByName(live_parents(papers, "paper", ["id"]))
    notes = latest(table(spark, root, "annotations", "id", "paper_id", "block_id", "created_at", "updated_at", "ingested_at"), ["id"], ["ingested_at", "updated_at"])
    tasks = latest(table(spark, root, "translation_tasks", "task_id", "paper_id", "block_id", "queued_at"), ["task_id"], ["queued_at"])
    links = table(spark, root, "workspace_papers", "node_id", "paper_id", "created_at").groupBy("node_id", "paper_id").agg(F.min("created_at").alias("created_at"))
    refs = (
        references(notes, "annotations", "block", ["paper_id", "block_id"], F.col("id"), "created_at")
        .unionByName(references(tasks, "translation_tasks", "block", ["paper_id", "block_id"], F.col("task_id").cast("string"), "queued_at"))
        .unionByName(references(links, "workspace_papers", "paper", ["paper_id"], F.concat_ws("/", "node_id", "paper_id"), "created_at"))
    )
    return parents, refs


_REFS = r"""
WITH b AS (SELECT lower(trim(paper_id)) p, lower(trim(block_id)) k, min(created_at) since, arg_max(deleted_at IS NOT NULL, updated_at) gone FROM layout_blocks GROUP BY 1, 2),
pa AS (SELECT lower(trim(id)) p, min(created_at) since, arg_max(deleted_at IS NOT NULL, updated_at) gone FROM papers GROUP BY 1),
a AS (SELECT id, arg_max(paper_id, ingested_at) paper_id, arg_max(block_id, ingested_at) block_id, arg_max(created_at, ingested_at) created_at FROM annotations GROUP BY 1),
w AS (SELECT node_id, paper_id, min(created_at) created_at FROM workspace_papers GROUP BY 1, 2),
refs AS (
  SELECT 'annotations' ref_table, a.id ref_key, a.created_at made, (b.p IS NULL OR b.gone OR b.since > a.created_at) orphan
  FROM a LEFT JOIN b ON b.p = lower(trim(a.paper_id)) AND b.k = lower(trim(a.block_id)) WHERE trim(a.block_id) <> '' AND trim(a.paper_id) <> ''
  UNION ALL
  SELECT 'translation_tasks', t.task_id::VARCHAR, t.queued_at, (b.p IS NULL OR b.gone OR b.since > t.queued_at)
  FROM translation_tasks t LEFT JOIN b ON b.p = lower(trim(t.paper_id)) AND b.k = lower(trim(t.block_id)) WHERE trim(t.block_id) <> '' AND trim(t.paper_id) <> ''
  UNION ALL
  SELECT 'workspace_papers', w.node_id || '/' || w.paper_id, w.created_at, (pa.p IS NULL OR pa.gone OR pa.since > w.created_at)
  FROM w LEFT JOIN pa ON pa.p = lower(trim(w.paper_id)) WHERE trim(w.paper_id) <> '')
"""


@query("p5_found", _REFS + "SELECT ref_table, ref_key FROM refs WHERE orphan")
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    parents, refs = parents_and_references(spark, root)
    return orphans(refs, parents).select("ref_table", "ref_key")


@query("p5_report", _REFS + "SELECT ref_table, date_trunc('month', made)::DATE period, count(*) n_refs, count(*) FILTER (orphan) n_orphans FROM refs GROUP BY 1, 2")
def p5_report(spark: SparkSession, root: str) -> DataFrame:
    parents, refs = parents_and_references(spark, root)
    return orphan_report(refs, parents)
