import hashlib
import random
import re

import pytest

from tessera.llm import decontaminate as dc


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    pats = []
    for item, text in bench:
        w = split(text)
        k = min(10, len(w))
        pats += [(str(item), w[i : i + k]) for i in range(len(w) - k + 1)] if w and item is not None else []
    out = []
    for doc, text in docs:
        w = split(text)
        hit, items = set(), set()
        for item, p in pats:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    items.add(item)
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def data(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "É1", "x9", "ab", "the"]) if r.random() < 0.7 else f"w{r.randrange(50)}"
    bench = [(i, " ".join(word() for _ in range(r.choice([1, 2, 9, 10, 11, 25])))) for i in range(12)] + [(2, "two one"), (None, "a b"), (77, ""), (78, None), (79, "?!")]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 8)):
            parts.append(r.choice(bench)[1] or "" if r.random() < 0.3 else " ".join(word() for _ in range(r.randint(1, 12))))
        docs.append((i, r.choice([" ", ", ", "\n-- "]).join(parts).upper() if r.random() < 0.3 else " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "...")], bench


@pytest.mark.parametrize(("seed", "most"), [(1, 32 << 20), (2, 300), (3, 32 << 20)])
def test_against_brute_force(spark, seed, most):
    docs, bench = data(seed)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert sorted(map(tuple, dc.digest(dc.contamination(d, b, most_bytes=most)).collect())) == brute(docs, bench)


def test_spans_in_the_original(spark):
    q = "Qué is the ANSWER to the very last question of all"
    text = f"é intro — {q.lower().replace(' ', ',  ')}! end"
    d, b = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_words int"), spark.createDataFrame([(9, q)], "item_id int, text string")
    r = dc.contamination(d, b).first()
    assert [text[s.start : s.end] for s in r.spans] == [q.lower().replace(" ", ",  ")] and r.n_words == 15 and r["items"] == ["9"]
    assert dc.contamination(d.limit(0), b).count() == 0
    assert dc.digest(dc.contamination(d, b.limit(0))).first().n_hit == 0


def test_long_texts_and_clashing_columns(spark):
    import time

    q = "one two three four five six seven eight nine ten eleven"
    text = ("é " + q + " — ") * 40_000
    machine = dc.automaton({p: ["1"] for p in dc.windows(q, 10)})
    began = time.process_time()
    n, runs, items, places = dc.scan(machine, text)
    assert time.process_time() - began < 20 and n == 13 * 40_000 and len(runs) == len(places) == 40_000 and items == {"1"}
    assert {text[a:b] for a, b in places[::5000]} == {q} and dc.scan(machine, text, place=False)[3] == []
    d = spark.createDataFrame([(1, text, "a"), (2, "clean", "b"), (3, None, "c"), (4, "x" * 3_000_000, "d")], "doc_id long, text string, words string").selectExpr("*", "5 as n_words", "6 as items", "7 as spans", "8 as patterns")
    b = spark.createDataFrame([(9, q, 1)], "item_id int, text string, pattern int")
    assert sorted((r.doc_id, r.n_words) for r in dc.contamination(d, b).collect()) == [(1, 520_000), (2, 1), (3, 0), (4, 1)]


def test_stage_keeps_clashing_columns(spark, tmp_path):
    q = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(9, q)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.createDataFrame([(1, q, "a"), (2, "clean", "b")], "doc_id long, text string, words string")
    out = dc.stage(spark, d, str(tmp_path))
    assert out.columns == d.columns and [tuple(r) for r in out.collect()] == [(2, "clean", "b")]


def test_sql_agrees(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    assert sorted(con.execute(dc.SQL).fetchall()) == sorted(map(tuple, dc.query(spark, path).collect()))
