from lectorium.llm import scannoise


def test_heads_inside_the_line_are_found_by_their_return(spark, rows):
    """Heads that stand below the margin count if they return; section titles and sentences that return do not."""
    lines, k = [], 0
    for page in range(1, 7):
        head = "Glacier melt and sea ice" if page % 2 else f"{page}   Lee and Kim"
        top = 53.0 if page in (3, 4) else 40.0
        body = [f"{'abcdefghijkl'[n + page]} weaker form was seen in some of them here" for n in range(6)]
        if page in (5, 6):
            body[0] = "Discussion"
        for n, (t, y) in enumerate([(head, top), *[(t, 60.0 + 18 * n) for n, t in enumerate(body)], ("Annals of Papers, Vol. 21 (2001)", 740.0 if page == 2 else 760.0)]):
            lines.append((f"{page}-{n}", "p", page, n, "ocr", t, y))
    d = spark.createDataFrame(lines, "line_id string, paper_id string, page int, line_no int, origin string, text string, y_top double")
    b = spark.createDataFrame([], "paper_id string, block_id string, page_start int, page_end int, text string")
    got = rows(scannoise.with_furniture(scannoise._line_frame(d, b)).where("kind IS NOT NULL"), "row_key", "kind")
    assert got == sorted((f"{p}-{n}", "header") for p in range(1, 7) for n in (0, 7))


def test_masked_key(spark):
    from pyspark.sql import functions as F

    t = ["12   Ostrell and Quorin", "Ostrell and Quorin   115", "O s t r e l l   a n d   Q u o r i n   9", "OSTRELL AND QUORIN", "0strell and Quorln"]
    d = spark.createDataFrame([(x,) for x in t], "t string").select(scannoise.masked(F.col("t")).alias("k"))
    assert len({r.k for r in d.collect()}) == 1
    assert spark.createDataFrame([("0.98",), ("41",)], "t string").where(scannoise.masked(F.col("t")) != "").count() == 0
