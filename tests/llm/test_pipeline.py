import hashlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    from tidelog.llm import mixing, quality

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, rows, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == COLUMNS, name
        seen.append((rows, after))
        rows = after
    before, after = seen[0]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in quality.judge(before).where("kept").collect()}
    before, after = seen[1]
    assert after.count() == before.count()
    before, after = seen[2]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    before, after = seen[3]
    assert after.count() == sum(r["copies"] for r in mixing.plan(before).collect())
    before, after = seen[4]
    assert after.count() == before.count()
    whole = pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in rows.collect())


def test_stages_against_brute_force(spark):
    """Each stage on its own input, with nulls, empty texts, ties, repeated rows and a clashing column."""
    import random

    import duckdb
    import sentencepiece
    from test_operators_llm import SCHEMA, brute_components, key, sentence, shingles

    from tidelog.llm import queries

    rng = random.Random(12)
    base = [("the of and to a in is " + sentence(60, rng)) for _ in range(14)]
    texts = [None, "", "short text", *base, base[0], base[0].upper(), base[1] + " the tail of it", *(f"a shared line of the site\n{sentence(40, rng)} the and of" for _ in range(12))]
    rows = [(k, t, "en", rng.choice(("a", "b", "c", None)), 0) for k, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    now = spark.createDataFrame(rows, SCHEMA)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [tuple(r) for r in now.select(*COLUMNS).collect()]
        after = stage(spark, now, SF)
        got = after.collect()
        if name == "quality rules":
            con = duckdb.connect()
            con.register("documents", now.toPandas().drop_duplicates("doc_id"))
            kept = {i for i, ok in con.execute(f"SELECT doc_id, kept FROM ({queries.OP3_SQL})").fetchall() if ok}
            assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in before if r[0] in kept)
        elif name == "line dedup":
            n, first = Counter(), {}
            hashed = {(r["doc_id"], r["text"]): r["h"] for r in now.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
            for i, t, *_ in before:
                n.update({key(x) for x in (t or "").split("\n")} - {""})
                for at, x in enumerate((t or "").split("\n")):
                    here = (i, hashed[i, t], at)
                    first[key(x)] = min(first.get(key(x), here), here)
            want = Counter((i, "\n".join(x for at, x in enumerate(t.split("\n")) if not key(x) or n[key(x)] < 10 or first[key(x)] == (i, hashed[i, t], at))) for i, t, *_ in before)
            assert Counter((r["doc_id"], r["text"]) for r in got) == want and max(n.values()) >= 10
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        elif name == "MinHash near-dedup":
            roots, least = brute_components([shingles(r[1]) for r in before], 80), {}
            for r, root in zip(before, roots, strict=True):
                least[root] = min(least.get(root, r[0]), r[0])
            assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r, root in zip(before, roots, strict=True) if least[root] == r[0])
            assert len(got) < len(before)
        elif name == "source mix":
            con = duckdb.connect()
            con.register("documents", now.toPandas())
            size, taken = Counter(), Counter()
            for _, t, _, s, _ in before:
                size[s] += len((t or "").split())
            for r in got:
                taken[r["source"]] += len(r["text"].split())
            for s, target in {r[0]: r[1] for r in con.execute(f"SELECT DISTINCT source, target FROM ({queries.OP10_SQL}) JOIN documents USING (doc_id)").fetchall()}.items():
                assert abs(taken[s] - target) <= max(len((t or "").split()) for _, t, *_ in before) and taken[s] <= 4 * size[s]
            assert {(r["doc_id"], r["text"]) for r in got} <= {r[:2] for r in before}
            assert max(Counter(r["doc_id"] for r in got).values()) <= 3 * max(Counter(r[0] for r in before).values())
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
            digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want = Counter((i, digest(",".join(map(str, library.encode(t or "")))), digest(library.decode(library.encode(t or "")))) for i, t, *_ in before)
            assert Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
        now = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in got], SCHEMA) if k < len(pipeline.STAGES) - 1 else None


def test_stages_on_an_empty_table(spark):
    from test_operators_llm import SCHEMA

    now = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0
