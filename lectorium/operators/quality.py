"""Quality of translated text: partial copies of the source, coverage, composite scores, planning of batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the composite score.
WEIGHTS = {"language": 0.35, "facts": 0.40, "repetition": 0.15, "length": 0.10}


def source_copied(source: Column, output: Column, least: int = 40) -> Column:
    """A long sentence of the source stands unchanged in the output."""
    parts = F.filter(F.split(source, r"(?<=[.!?。！？])\s*"), lambda p: F.length(F.trim(p)) >= least)
    return F.exists(parts, lambda p: F.contains(output, F.trim(p)))


def five_gram_loop(c: Column, times: int = 3) -> Column:
    """Some run of five words occurs that often."""
    w = F.split(F.lower(F.trim(c)), r"\s+")
    n = F.size(w)
    grams = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.array_join(F.slice(w, i, 5), " "))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.size(grams) - F.size(F.array_distinct(grams)) >= times - 1, F.lit(False))


def length_score(source: Column, output: Column) -> Column:
    r = F.try_divide(F.length(output), F.length(source))
    return F.when(r.isNull(), 0.0).when(r.between(0.25, 4.0), 1.0).otherwise(0.4)


def composite(language: Column, facts: Column, repetition: Column, length: Column) -> Column:
    s = language * WEIGHTS["language"] + facts * WEIGHTS["facts"] + repetition * WEIGHTS["repetition"] + length * WEIGHTS["length"]
    return F.round(s, 6)


def reasons(**flags: Column) -> Column:
    """Names of the flags that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())


def punctuation_spacing(c: Column) -> Column:
    """No blank before a mark, one behind it in Latin text."""
    c = F.regexp_replace(c, r"\s+([,.;:!?])", "$1")
    return F.regexp_replace(c, r"([,;:!?])(?=[A-Za-z])", "$1 ")


def length_bucket(n: Column) -> Column:
    return F.when(n <= 32, "short").when(n <= 128, "medium").when(n <= 512, "long").otherwise("huge")


def batch_plan(jobs: DataFrame, most: int = 24, budget: int = 4096) -> DataFrame:
    """Append ``batch``: jobs of one bucket packed in order under a size and a padded-size budget.

    jobs: job_id, size, bucket, and a group to keep tasks small.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        batch, n, widest, out = 0, 0, 0, []
        for s in f.sort_values(["size", "job_id"])["size"]:
            if n and (n == most or max(widest, s) * (n + 1) > budget):
                batch, n, widest = batch + 1, 0, 0
            n, widest = n + 1, max(widest, s)
            out.append(batch)
        return f.sort_values(["size", "job_id"]).assign(batch=out)

    from pyspark.sql.types import IntegerType, StructField, StructType

    return jobs.groupBy("bucket", "shard").applyInPandas(run, StructType([*jobs.schema.fields, StructField("batch", IntegerType())]))


def neighbours(blocks: DataFrame, keep: Column) -> DataFrame:
    """Each kept block with the text before and behind it among the kept ones."""
    from pyspark.sql import Window

    w = Window.partitionBy("paper_id").orderBy("block_order", "block_id")
    return blocks.where(keep).withColumns({"text_before": F.lag("text").over(w), "text_behind": F.lead("text").over(w)})
