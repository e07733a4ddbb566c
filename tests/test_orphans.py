import datetime as dt
import random

import numpy as np
import pandas as pd

from lectorium.operators import orphans as O
from pyspark.sql import functions as F

BLOCKS = "paper_id string, block_id string, created_at timestamp, updated_at timestamp, deleted_at timestamp, key string"
REFS = "id string, paper_id string, block_id string, created_at timestamp, key string"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def both(spark, blocks, refs):
    p = O.live_parents(spark.createDataFrame(blocks, BLOCKS), "block", ["paper_id", "block_id"])
    r = O.references(spark.createDataFrame(refs, REFS), "t", "block", ["paper_id", "block_id"], F.col("id"), "created_at")
    return r, p


def test_against_brute_force_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(O, "GROUP_ROWS", 60)  # many ranges, and salts for the hot one
    rng = random.Random(3)
    blocks = [(f"p{i % 7}", f"b{i}", day(rng.randrange(50)), day(60 + v), day(60 + v) if rng.random() < 0.3 else None, "x") for i in range(120) for v in range(rng.choice([1, 1, 2]))]
    refs = []
    for i in range(600):
        b = 5 if rng.random() < 0.34 else rng.randrange(160)
        refs.append((f"r{i}", rng.choice([f"p{b % 7}", f" P{b % 7} "]), rng.choice([f"b{b}", f"B{b} ", "", None]), day(rng.randrange(80)), "y"))
    want = set()
    for i, p, b, at, _ in refs:
        if not b or not b.strip():
            continue
        k = (p.strip().lower(), b.strip().lower())
        rows = [x for x in blocks if (x[0], x[1]) == k]
        last = max(rows, key=lambda x: (x[3], x[4] is not None)) if rows else None
        if not rows or last[4] is not None or min(x[2] for x in rows) > at:
            want.add(i)
    r, p = both(spark, blocks, refs)
    assert {x.ref_key for x in O.orphans(r, p).collect()} == want
    total = O.orphan_report(r, p).agg(F.sum("n_orphans"), F.sum("n_refs")).first()
    assert total[0] == len(want) and total[1] == r.count()


def test_empty_tables_and_nulls(spark):
    one = [("r1", "p", "b", day(1), "k"), ("r2", None, "b", day(1), "k"), ("r3", "p", "  ", day(1), "k")]
    r, p = both(spark, [], one)
    assert [x.ref_key for x in O.orphans(r, p).collect()] == ["r1"]
    r, p = both(spark, [("p", "b", day(0), day(0), None, "k"), (None, None, day(0), day(0), None, "k")], [])
    assert O.orphans(r, p).count() == 0


def test_probe_survives_equal_first_digests():
    parents = pd.DataFrame({"h": [5, 5, 5], "h2": [1, 2, 3], "since": [0.0, np.nan, 10.0]})
    refs = pd.DataFrame({"h": [5, 5, 5, 5, 6], "h2": [1, 2, 3, 4, 1], "made": [1, 1, 1, 1, 1]})
    assert O.probe(refs, parents).tolist() == [True, False, False, False, False]
