"""Search: one document per paper, an inverted index, conjunctive match, pattern match, hits in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectorium.functions.text import filled

TOKEN = r"[^\p{L}\p{N}]+"


def search_documents(papers: DataFrame, blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """id, title, authors, body, annotations.  Pieces are joined in block and note order."""
    body = blocks.where("text IS NOT NULL").groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "block_id", "text"))), lambda x: x["text"]), " ").alias("body"))
    said = F.concat_ws(" ", filled(F.col("note")), filled(F.col("selected_text")))
    ann = notes.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id"), said.alias("t")))), lambda x: x["t"]), " ").alias("annotations"))
    d = papers.select("id", F.concat_ws(" ", "title_original", "title_translated").alias("title"), F.concat_ws(" ", "authors").alias("authors"))
    d = d.join(body.withColumnRenamed("paper_id", "id"), "id", "left").join(ann.withColumnRenamed("paper_id", "id"), "id", "left")
    return d.fillna("", ["body", "annotations"])


def inverted_index(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """term, key, tf: one row per distinct term of a document."""
    terms = docs.select(key, F.explode(F.split(F.lower(text), TOKEN)).alias("term")).where("term <> ''")
    return terms.groupBy("term", key).agg(F.count("*").alias("tf"))


def match_all(index: DataFrame, key: str, needle: str, limit: int | None = 50) -> DataFrame:
    """Keys of documents that hold every term, most occurrences first; a blank needle finds nothing."""
    terms = [t for t in dict.fromkeys(needle.lower().split()) if t]
    hits = index.where(F.col("term").isin(terms) if terms else F.lit(False))
    found = hits.groupBy(key).agg(F.countDistinct("term").alias("n"), F.sum("tf").alias("tf")).where(F.col("n") == len(terms)).select(key, "tf")
    return found.orderBy(F.desc("tf"), key).limit(limit) if limit else found


def match_like(docs: DataFrame, key: str, columns: list[str], needle: str, limit: int = 50) -> DataFrame:
    """Any column holds the pattern; percent signs of the needle are dropped, an underscore stands for one sign."""
    n = needle.replace("%", "").lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c)).like(f"%{n}%")
    return docs.where(hit if n.strip() else F.lit(False)).select(key).orderBy(key).limit(limit)


def snippet(text: Column, needle: str, before: int = 30, after: int = 50) -> Column:
    """The first hit with its surroundings, an ellipsis at each cut end; null without a hit."""
    at = F.instr(F.lower(text), needle.lower())
    lo = F.greatest(at - before, F.lit(1))
    hi = F.least(at + len(needle) + after, F.length(text) + 1)
    cut = F.concat(F.when(lo > 1, "…").otherwise(""), F.substring(text, lo, hi - lo), F.when(hi <= F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut)


def hits_in_paper(blocks: DataFrame, needle: str, limit: int = 50) -> DataFrame:
    """Blocks that hold the needle (two signs at least), headings and references left out, first in order."""
    n = needle.strip()
    d = blocks.where(~F.col("block_role").isin("heading", "reference")).withColumn("snippet", snippet(F.col("text"), n) if len(n) >= 2 else F.lit(None).cast("string"))
    return d.where("snippet IS NOT NULL").orderBy("paper_id", "block_order", "block_id").limit(limit)


def wrapped(current: Column, n: Column, delta: int) -> Column:
    """Circular index of the hit that is delta further; -1 without hits."""
    return F.when(n > 0, F.pmod(current + delta, n)).otherwise(-1)
