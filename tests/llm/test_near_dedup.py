import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup as nd
from tessera.llm._components import components


def brute(rows):
    sets = {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for _ in range(12):
        base.append([r.choice(vocab) for _ in range(r.randint(6, 120))])
    for b in base:
        for _ in range(r.randint(1, 14)):
            c = list(b)
            for _ in range(r.choice([0, 1, 2, 3, 6])):
                c[r.randrange(len(c))] = r.choice(vocab)
            rows.append(r.choice([" ", "\n", "\t "]).join(c).upper() if r.random() < 0.2 else " ".join(c))
    rows += ["", " \n", None, "one two", "one two", "One TWO three", "é É", "É É"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, nd.near_duplicates(df).collect()))
    assert got == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    """A large group whose members mostly link through a few: blocks of any size must agree."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(80):
        c = list(base)
        for _ in range(r.choice([1, 1, 2, 2, 3])):
            c[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(map(tuple, nd.near_duplicates(df).collect())) == want
    monkeypatch.setattr(nd, "BLOCK", 7)
    assert sorted(map(tuple, nd.near_duplicates(df).collect())) == want


def test_shared_counts(monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, n).astype(np.uint64)) for n in (0, 5, 80, 200, 300, 150)]
    left, right = np.array([0, 2, 4]), np.array([1, 3, 5])
    want = [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]
    for span in (8192, 7):
        monkeypatch.setattr(nd, "SPAN", span)
        assert nd.shared_counts(sets, left, right).tolist() == want


def test_fringe_of_a_group(spark):
    """Copies of one text, edited so much that most pairs come close to the threshold without a link."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        c = list(base)
        for _ in range(r.randint(1, 6)):
            c[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(df).collect())) == brute(rows)


def test_long_texts_and_clashing_columns(spark):
    r = random.Random(5)
    long = [f"w{r.randrange(10**7)}" for _ in range(300_000)]
    near = list(long)
    for i in range(0, len(near), 50):
        near[i] = "other"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, "w" * 3_000_000), (4, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("id", "class", "bucket", "bands", "sketch", "label", "size", "n_shingles", "component_id", "kept", "u", "v")
    wide = df.select("*", *(F.lit("x").alias(n) for n in names))
    got = sorted(map(tuple, nd.near_duplicates(wide).collect()))
    assert got == brute(rows)
    assert [x[2] for x in got] == [1, 1, 3, 4]
    staged = nd.stage(spark, wide, "")
    assert staged.columns == wide.columns and sorted(r.doc_id for r in staged.collect()) == [1, 3, 4]


def test_nulls_repeats_and_columns(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t, 1), (3, t, 2), (5, t, 3), (5, "other words here and there", 4), (6, "other words here and there", 5), (7, None, 6)], "doc_id long, text string, kept long")
    got = sorted(nd.near_duplicates(df).collect(), key=str)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (3, 3, True), (5, 3, False), (6, 3, False), (7, 7, True)}
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (200, 199), (None, 3)]
    got = {r.id: r.label for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 103: 100, 105: 100, 199: 199, 200: 199}


def test_sql_agrees(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    assert sorted(con.execute(nd.SQL).fetchall()) == sorted(map(tuple, nd.query(spark, path).collect()))
