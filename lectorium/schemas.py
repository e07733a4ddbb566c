"""Explicit schemas of every entity; nothing is inferred when documents are read."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "text_items": "doc_id string, page int, item_ix int, text string, x double, y double, width double, height double, font_size double, font_name string",
    "pages": "doc_id string, page int, width double, height double",
    "papers": "id string, source_file_hash string, title_original string, title_translated string, authors array<string>, publication string, pub_year int, page_count int, processing_status string, favorite boolean, last_opened_at timestamp, source_file_name string, package_revision int, created_at timestamp, updated_at timestamp, deleted_at timestamp",
    "workspace_nodes": "id string, parent string, ord int, name string, kind string, color string, created_at timestamp, updated_at timestamp",
    "workspace_papers": "node_id string, paper_id string, sort_order int, note string, relevance double, status string, decision string, tags array<string>, created_at timestamp, updated_at timestamp",
    "annotations": "id string, paper_id string, workspace_node_id string, block_id string, start_offset int, end_offset int, selected_text string, prefix string, suffix string, text_hash string, note string, status string, created_at timestamp, updated_at timestamp",
    "reading_positions": "paper_id string, block_id string, offset double, updated_at timestamp",
    "translation_cache": "text_hash string, model string, model_version string, source_language string, target_language string, translated_text string, cached_at timestamp",
    "translation_tasks": "task_id bigint, paper_id string, block_id string, text string, source_language string, target_language string, priority int, status string, error string, queued_at timestamp, started_at timestamp, completed_at timestamp",
    "translation_facts": "id string, paper_id string, model string, input_chars int, output_chars int, input_tokens int, output_tokens int, translation_time_ms double, at timestamp",
    "blocks": "id string, paper_id string, section_id string, type string, ord int, page_start int, page_end int, bounding_boxes array<struct<page:int,x:double,y:double,width:double,height:double>>, original string, translated string, extraction_confidence double, translation_status string, parent_block_id string, metadata map<string,string>",
    "sections": "id string, paper_id string, parent_section_id string, ord int, level int, original_title string, translated_title string, normalized_kind string",
    "relations": "doc_id string, type string, source string, target string, confidence double",
    "md_nodes": "doc_id string, ord int, kind string, level int, block_id string, text string",
    "structure_file": "version int, blocks map<string,struct<type:string,ord:int,page:int,section:string,status:string>>, relations array<struct<type:string,source:string,target:string>>",
    "reviews": "key string, paper_id string, block_id string, disciplines array<string>, format_family string, source_category string, source string, translation string, labels array<string>, severity int, reviewed_at timestamp",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def names() -> list[str]:
    return sorted(_DDL)
