"""Small functions that queries are made of."""

import math
import random

from pyspark.sql import functions as F

from tidelog.operators import days, hygiene, search, vectors


def test_plans_of_terms():
    df = {"a": 50, "b": 4, "c": 0}
    assert search.plan_terms(df, 100, ["a", "b", "c"]) == (["b", "c"], ["b"])
    assert search.plan_terms(df, 100, ["a"]) == (["a"], [])  # all would go
    assert search.entity_weight(0) == search.entity_weight(1) == 0.55 + 0.40 / math.log2(3)


def test_clock_and_hits(spark):
    one = spark.createDataFrame([(0, {"card": 2, "api": 1}), (287, {})], "slot int, hits map<string,int>")
    got = [tuple(r) for r in one.select(days.slot_clock(F.col("slot")), hygiene.hits_line(F.col("hits"))).collect()]
    assert got == [("00:00", "api×1, card×2"), ("23:55", "")]


def test_best_neighbours(spark):
    draw = random.Random(3)
    points = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(k, [x + draw.gauss(0, 0.05) for x in points[k % 6]]) for k in range(60)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    want = set()
    for i, a in rows:
        near = sorted((-round(cos(a, b), 6), j) for j, b in rows if j != i and round(cos(a, b), 6) >= 0.9)[:3]
        want |= {(min(i, j), max(i, j)) for _, j in near}
    got = {(r["a"], r["b"]) for r in vectors.exact_edges(frame, 0.9, 3, "id", "v").collect()}
    assert got == want


def test_what_is_dropped(spark, tmp_path):
    import zipfile

    from tidelog.sources import files

    (tmp_path / "note.txt").write_text("A dropped note")
    with zipfile.ZipFile(tmp_path / "box.zip", "w") as z:
        for k in range(3):  # an archive of fewer texts is none of notes
            z.writestr(f"inner{k}.txt", "inside of it")
    got = {(r["title"], r["text"]) for r in files.read_dropped(spark, str(tmp_path)).collect()}
    assert any("A dropped note" in (t or "") for _, t in got) and any("inside of it" in (t or "") for _, t in got)
