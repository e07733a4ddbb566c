import random

from pyspark.sql import functions as F

from lectorium.operators.ordered import with_carried, with_next, with_place


def test_next_row_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(60), f"t{i:03}") for i in range(300)]
    d = spark.createDataFrame(rows, "g string, o int, t string")
    got = {r.t: r.next_t for r in with_next(d, ["g"], "o", "t", ["t"], span=7).collect()}
    for g in {r[0] for r in rows}:
        line = [r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))]
        assert [got[t] for t in line] == [*line[1:], None]
    assert with_next(d.limit(0), ["g"], "o", "t", ["t"]).count() == 0


def test_places_and_carried_values_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(60), f"t{i:03}", rng.choice([None, None, f"v{i}"])) for i in range(300)]
    d = spark.createDataFrame(rows, "g string, o int, t string, v string").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the pieces of a small table apart
    try:
        place = {r.t: (r.place, r.n) for r in with_place(d, ["g"], ["o", "t"], total="n").collect()}
        at = {r.t: r.x for r in with_carried(d, ["g"], ["o", "t"], F.col("v"), "x").collect()}
        past = {r.t: r.x for r in with_carried(d, ["g"], ["o", "t"], F.col("v"), "x", own=False).collect()}
        assert with_place(d.limit(0), ["g"], ["o"]).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for g in {r[0] for r in rows}:
        last = None
        line = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(line):
            assert place[r[2]] == (i + 1, len(line)) and past[r[2]] == last
            last = r[3] or last
            assert at[r[2]] == last
