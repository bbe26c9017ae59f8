import math
import random

from tessera.llm import topk_search as tk


def brute(rows, queries, k):
    v = {}
    use = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    for i, w in use:
        v.setdefault(i, w)
    out = []
    for q in sorted({i for i, _ in use if queries(i)}):
        cand = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v[q], w)))), i) for i, w in use if i != q and len(w) == len(v[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(cand[:k])]
    return sorted(out)


def run(spark, rows, k=10, parts=3, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)
    return sorted(map(tuple, tk.top_k(df, df.where("vec_id % 10 = 0"), k, **more).collect()))


def test_against_brute_force(spark):
    import numpy as np

    r = random.Random(1)
    rows = [(i, [float(np.float32(r.gauss(0, 0.2))) for _ in range(20)], 1) for i in range(300)]
    rows += [(1000 + i, rows[i][1], 2) for i in range(40)] + [(500 + i, [0.5] * 20, None) for i in range(30)]
    want = brute([(a, b) for a, b, _ in rows], lambda i: i % 10 == 0, 10)
    assert run(spark, rows) == want
    assert run(spark, rows, block=9) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        assert run(spark, rows) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark):
    big = [1e17, -1e17, 3.0]
    rows = [(0, [1.0, 2.0, 3.0], 1), (10, None, 1), (20, [1.0, None, 2.0], 1), (30, [float("nan"), 1.0, 1.0], 1), (40, [float("inf"), 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0], 1), (50, [1.0, 1.0], 1), (51, [2.0, 1.0], 1), (60, big, 1), (61, big, 1), (62, [0.1, 0.1, 0.1], 1), (70, [], 1)]
    import numpy as np

    clean = [(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b]) for a, b, _ in rows]
    assert run(spark, rows) == brute(clean, lambda i: i % 10 == 0, 10)
    assert run(spark, [(0, [1.0], 1)]) == []


def test_bounds_leave_most_weights_unread(spark):
    """Over sf0.1: what is read against all weights of all rows for each query, with the result of a plain product."""
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [r for r in rows if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    ids, weights = np.array([r.vec_id for r in rows]), np.floor(1024 * np.array([r.embedding for r in rows], np.float64))
    asked = ids % 100 == 0
    seeds = [(int(i), w) for i, w in zip(ids[::20], weights[::20])]
    queries = tk.Queries(ids[asked], weights[asked], tk.floors(ids[asked], weights[asked], seeds, 10), 10)
    parts = list(tk.shards(ids, weights))
    read = sum(shard.search(queries) for shard in parts)
    share = read / (asked.sum() * weights.size)
    print("read", share, "shards", len(parts))
    assert share < 0.7, share
    for q, w, (scores, found) in zip(queries.ids, queries.weights, queries.best):
        score = weights @ w
        want = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:10]
        assert [(-s, i) for s, i in want] == list(zip(scores, found))


def test_columns_that_clash(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    wide = df.select("*", *(F.lit("x").alias(n) for n in ("rank", "score", "query_id", "label")))
    got = sorted(map(tuple, tk.top_k(wide, wide.where("vec_id % 10 = 0"), 3).collect()))
    assert got == sorted(map(tuple, tk.top_k(df, df.where("vec_id % 10 = 0"), 3).collect())) and len(got) == 9
    assert tk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_sql_agrees(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    assert sorted(con.execute(tk.SQL).fetchall()) == sorted(map(tuple, tk.query(spark, path).collect()))
