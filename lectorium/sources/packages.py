"""Document packages: one folder per paper with JSON, Markdown and optional gzip JSON.

Readers list and read with the cluster's file system; parsing is per document in Arrow batches.  Writers
stage a whole snapshot and swap it in, so readers never see half of one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectorium.schemas import schema

_PAPER = r".*/([^/]+)/[^/]+$"


def _with_doc(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.regexp_extract(F.input_file_name(), _PAPER, 1))


def read_json(spark: SparkSession, root: str, file: str, name: str) -> DataFrame:
    """``file`` of every package with an explicit schema; gzip is transparent; unreadable files give nulls."""
    d = spark.read.schema(schema(name)).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/{file}")
    return _with_doc(d)


def read_markdown(spark: SparkSession, root: str, file: str) -> DataFrame:
    d = spark.read.text(f"{root}/*/{file}", wholetext=True)
    return _with_doc(d).select("doc_id", F.col("value").alias("source"))


def missing_packages(index: DataFrame, found: DataFrame) -> DataFrame:
    """Indexed documents without a package on disk."""
    return index.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def safe_path(path: Column) -> Column:
    """Null for paths that leave their root."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.when(~p.rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:|\x00"), p)


_COMMENT = re.compile(r"^<!--\s*block:\s*([\w-]+)[^>]*-->\s*$")


def markdown_nodes(source: str) -> list[tuple[int, str, int, str | None, str]]:
    """(ord, kind, level, block id, text) of a Markdown text; an id comment names the node before it."""
    out: list[list] = []
    lines = source.split("\n")
    i = 0
    if lines and lines[0].strip() == "---":
        end = next((k for k in range(1, len(lines)) if lines[k].strip() == "---"), None)
        if end is not None:
            for k in range(1, end):
                m = re.match(r"^([\w-]+):\s*(.*)$", lines[k])
                if m:
                    out.append(["front", 0, m.group(1), m.group(2).strip().strip('"')])
            i = end + 1
    while i < len(lines):
        t = lines[i]
        if not t.strip():
            i += 1
            continue
        m = _COMMENT.match(t.strip())
        if m:
            if out:
                out[-1][2] = m.group(1)
            i += 1
            continue
        m = re.match(r"^(#{1,6})\s+(.*)$", t)
        if m:
            out.append(["heading", len(m.group(1)), None, m.group(2).strip()])
            i += 1
            continue
        if t.strip().startswith(("$$", "```")):
            fence = t.strip()[:2] if t.strip().startswith("$$") else "```"
            j = i + 1
            while j < len(lines) and not lines[j].strip().startswith(fence):
                j += 1
            out.append(["math" if fence == "$$" else "code", 0, None, "\n".join(lines[i + 1 : j])])
            i = j + 1
            continue
        kind, stop = "paragraph", None
        if t.startswith(">"):
            kind = "callout" if re.match(r"^>\s*\[!", t) else "quote"
        elif t.lstrip().startswith("|"):
            kind = "table"
        elif re.match(r"^!\[[^\]]*\]\(", t):
            kind, stop = "image", i + 1
        elif re.match(r"^\s*([-*•]|\d+\.)\s", t):
            kind = "list"
        j = stop or i + 1
        while not stop and j < len(lines) and lines[j].strip() and not _COMMENT.match(lines[j].strip()) and not re.match(r"^#{1,6}\s", lines[j]):
            j += 1
        out.append([kind, 0, None, "\n".join(lines[i:j]).strip()])
        i = j
    return [(n, *x) for n, x in enumerate(out)]


def parsed_markdown(df: DataFrame) -> DataFrame:
    """doc_id, source to one row per node (schema ``md_nodes``)."""

    def run(frames):
        for f in frames:
            rows = [(d, n, k, level, b, t) for d, s in zip(f.doc_id, f.source) if s for n, k, level, b, t in markdown_nodes(s)]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "kind", "level", "block_id", "text"])

    return df.select("doc_id", "source").mapInPandas(run, schema("md_nodes"))


def blocks_to_nodes(blocks: DataFrame, language: str = "original") -> DataFrame:
    """Ordered nodes of a document: a section's heading once, text of the language or the other one.

    blocks: doc_id, block_id, ord, section (title or null), kind, original, translated.
    """
    text = F.coalesce("translated", "original") if language == "translated" else F.coalesce("original", "translated")
    w = Window.partitionBy("doc_id", "section").orderBy("ord", "block_id")
    b = blocks.withColumn("_first", F.row_number().over(w) == 1).withColumn("_t", text)
    heads = b.where(F.col("_first") & F.col("section").isNotNull()).select("doc_id", (F.col("ord") * 2).alias("at"), F.lit("heading").alias("kind"), F.lit(2).alias("level"), F.lit(None).cast("string").alias("block_id"), F.col("section").alias("text"))
    body = b.where("kind <> 'heading' AND _t IS NOT NULL").select("doc_id", (F.col("ord") * 2 + 1).alias("at"), "kind", F.lit(0).alias("level"), "block_id", F.col("_t").alias("text"))
    both = heads.unionByName(body)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", F.col("kind") != "heading")) - 1).select("doc_id", "ord", "kind", "level", "block_id", "text")


def to_markdown(nodes: DataFrame, comments: bool = True) -> DataFrame:
    """doc_id, source: nodes in order, each followed by its id comment."""
    t = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.col("level"), F.lit(1))), F.lit(" "), F.col("text"))).when(F.col("kind") == "math", F.concat(F.lit("$$\n"), F.col("text"), F.lit("\n$$"))).otherwise(F.col("text"))
    if comments:
        t = F.when(F.col("block_id").isNotNull(), F.concat(t, F.lit("\n<!-- block: "), F.col("block_id"), F.lit(" -->"))).otherwise(t)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", t.alias("t")))), lambda x: x["t"]), "\n\n")
    return nodes.where("kind <> 'front'").groupBy("doc_id").agg(F.concat(body, F.lit("\n")).alias("source"))


def without_comments(source: Column) -> Column:
    return F.regexp_replace(source, r"(?m)\n?^<!--\s*block:[^>]*-->[ \t]*$", "")


def failed_policy(nodes: DataFrame, failed: DataFrame, policy: str) -> DataFrame:
    """Nodes of failed blocks dropped (``omit``) or replaced by a warning and the original (``original``).

    failed: doc_id, block_id, original.
    """
    f = failed.select("doc_id", "block_id", F.col("original").alias("_o"), F.lit(True).alias("_f"))
    d = nodes.join(f, ["doc_id", "block_id"], "left")
    if policy == "omit":
        return d.where("_f IS NULL").drop("_o", "_f")
    text = F.when(F.col("_f"), F.concat(F.lit("> [!warning]\n"), F.coalesce("_o", F.lit("")))).otherwise(F.col("text"))
    return d.withColumn("text", text).drop("_o", "_f")


def note_import(source: Column) -> Column:
    """For note apps: no front matter, image links by file name, captions not in italics."""
    t = F.regexp_replace(source, r"(?s)^---\n.*?\n---\n", "")
    t = F.regexp_replace(t, r"!\[([^\]]*)\]\((?:[^)\s]*/)?([^)/\s]+)\)", "![$1]($2)")
    return F.regexp_replace(t, r"(?m)^\*((?:Figure|Table|Fig\.|図|表)[^*]*)\*$", "$1")


def data_url(url: Column) -> Column:
    """Bytes of a base64 data URL; null for others."""
    b = F.regexp_extract(url, r"^data:[^;,]+;base64,([A-Za-z0-9+/=]+)$", 1)
    return F.when(b != "", F.unbase64(b))


def header_fields(xml: Column) -> list[Column]:
    """Title, authors, affiliations and abstract of a TEI header."""
    many = lambda p: F.transform(F.xpath(xml, F.lit(p)), lambda x: F.trim(x))
    one = lambda p: F.trim(F.xpath_string(xml, F.lit(p)))
    names = F.zip_with(many("//sourceDesc//author/persName/forename[1]/text()"), many("//sourceDesc//author/persName/surname/text()"), lambda a, b: F.concat_ws(" ", a, b))
    return [one("//titleStmt/title").alias("title"), names.alias("authors"), many("//sourceDesc//author/affiliation/orgName/text()").alias("affiliations"), one("//profileDesc/abstract").alias("abstract")]


def staged_write(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write beside the target, read back and count, then swap by two renames.

    The old snapshot stands as ``.bak`` until the new one is in place; if a rename fails, it is put back and an
    error is raised, so there always is a whole snapshot under one of both names.  A run that finds a ``.bak`` and
    no target takes the ``.bak`` for the target first.  Between the two renames readers see no table."""
    spark = df.sparkSession
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    p = lambda s: jvm.org.apache.hadoop.fs.Path(path + s)
    if fs.exists(p(".bak")) and not fs.exists(p("")) and not fs.rename(p(".bak"), p("")):
        raise OSError(f"the snapshot {path}.bak could not be put back")
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path + ".tmp")
    spark.read.parquet(path + ".tmp").count()
    fs.delete(p(".bak"), True)
    if fs.exists(p("")) and not fs.rename(p(""), p(".bak")):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(p(".tmp"), p("")):
        if fs.exists(p(".bak")) and not fs.rename(p(".bak"), p("")):
            raise OSError(f"{path} is kept as {path}.bak: neither the new nor the old snapshot could be put in place")
        raise OSError(f"the new snapshot of {path} could not be put in place")
    fs.delete(p(".bak"), True)


def write_json(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)
