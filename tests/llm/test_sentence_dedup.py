import random
import re

import pytest

from tessera.llm import sentence_dedup as sd


def split(text):
    return re.findall(r"(?s)[ \t\n\r]*[^ \t\n\r].*?(?:[.!?]+[ \t\n\r]+|\n+|\Z)", text or "")


def brute(rows, n):
    places = {}
    for doc, text in rows:
        s = [x.strip(" \t\n\r") for x in split(text)]
        for i in range(max(1, len(s) - n + 1) if s else 0):
            places.setdefault(tuple(s[i : i + n]), []).append((doc, i))
    out = []
    for doc, text in rows:
        parts = split(text)
        s = [x.strip(" \t\n\r") for x in parts]
        gone = set()
        for i in range(max(1, len(s) - n + 1) if s else 0):
            if min(places[tuple(s[i : i + n])]) != (doc, i):
                gone |= set(range(i, min(i + n, len(s))))
        out.append((doc, len(s), sorted(gone), text if not gone else "".join(p for i, p in enumerate(parts) if i not in gone)))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_against_brute_force(spark, n):
    r = random.Random(n)
    some = [f"{r.choice(['The', 'É', 'a b'])} {i} thing{r.choice(['.', '!', '?!', ''])}" for i in range(25)]
    rows = [(i, "".join(r.choice(some) + r.choice([" ", "\n", "  ", "\n\n", "\r\n"]) for _ in range(r.randint(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "one."), (104, "one."), (105, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_sentences, list(x.removed), x.kept) for x in sd.remove_repeated(df, n).collect())
    assert got == brute(rows, n)


def test_sentences_are_those_of_the_pattern():
    r = random.Random(6)
    for _ in range(20_000):
        text = "".join(r.choice(" .\n.!?ab\r\t é\x0b") for _ in range(r.randint(0, 14)))
        assert sd.sentences(text) == split(text), repr(text)


def test_long_runs_take_time_in_proportion(spark):
    import time

    for text in ("." * 2_000_000 + "x", "a\n" + " " * 2_000_000, "a. " * 700_000, " " * 2_000_000, "\n" * 2_000_000 + "x", "x" + "!?" * 1_000_000 + " y"):
        began = time.process_time()
        assert "".join(sd.sentences(text)) == (text if text.strip() and text[-1] != " " or text[-2:] == ". " else text.rstrip(" ") if text.strip() else "")
        assert time.process_time() - began < 10
    df = spark.createDataFrame([(1, "One. Two. Three. " * 100_000), (2, "x" * 2_000_000)], "doc_id long, text string").selectExpr("*", *(f"'y' as `{c}`" for c in ("kept", "removed", "n_sentences", "at", "a", "b", "n", "first", "mark")))
    out = sd.remove_repeated(df)
    assert out.columns == ["doc_id", "text", "at", "a", "b", "n", "first", "mark", *sd.ADDED]
    assert sorted((r.doc_id, r.n_sentences, len(r.removed), r.mark) for r in out.collect()) == [(1, 300_000, 299_997, "y"), (2, 1, 0, "y")]


def test_nulls_repeats_and_columns(spark):
    t = "One is here. Two is here. Three is here."
    df = spark.createDataFrame([(None, t, 1), (4, t, 2), (4, t, 3), (5, t, 4), (5, "Other. Words. Now.", 5)], "doc_id long, text string, kept int").withColumnRenamed("kept", "n")
    got = {r.n: r.kept for r in sd.remove_repeated(df).collect()}
    assert got == {1: t, 2: t, 3: t, 4: "", 5: "Other. Words. Now."}
    assert sd.remove_repeated(df.limit(0)).count() == 0


def test_sql_agrees(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    assert sorted(con.execute(sd.SQL).fetchall()) == sorted(map(tuple, sd.query(spark, path).collect()))


def brute_passages(rows, over):
    places = {}
    split = {doc: re.findall(r"[^ \t\n\r]+", text or "") for doc, text in rows}
    for doc, w in split.items():
        for i in range(len(w) - over):
            places.setdefault(tuple(w[i : i + over + 1]), []).append((doc, i))
    out = []
    for doc, w in split.items():
        gone = {j for i in range(len(w) - over) if min(places[tuple(w[i : i + over + 1])]) != (doc, i) for j in range(i, i + over + 1)}
        out.append((doc, len(w), sorted(gone), [x for i, x in enumerate(w) if i not in gone]))
    return sorted(out)


@pytest.mark.parametrize("over", [1, 4, 50])
def test_passages_against_brute_force(spark, over):
    r = random.Random(over)
    some = [f"{r.choice('aé')}{i}{r.choice(['', '', '.', '!'])}" for i in range(40)]
    rows = [(i, "".join(r.choice(some) + r.choice([" ", "\n", "\r\n ", "\x0b "]) for _ in range(r.randint(0, 90)))) for i in range(40)]
    for i in range(40, 80):  # pieces of others, cut anywhere
        rows.append((i, f" \t{r.choice(some)} {rows[r.randrange(i)][1][r.randint(0, 40) :]}{r.choice(some)}"))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "same " * 130), (104, "a b " * 70), (105, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_words, list(x.removed), re.findall(r"[^ \t\n\r]+", x.kept or "")) for x in sd.remove_passages(df, over).collect())
    assert got == brute_passages(rows, over)
    assert sum(len(g[2]) for g in got) > 500


def test_a_passage_that_ends_inside_sentences_is_caught(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [(1, f"One two {passage} three four."), (2, f"Other words\n {passage} here. The end."), (3, f"Nothing {passage.rsplit(' ', 1)[0]} else."), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kept", "'y' as anchor", "'z' as shared")
    assert not any(r.removed for r in sd.remove_repeated(df).collect())
    out = sd.remove_passages(df)
    assert out.columns == ["doc_id", "text", "anchor", "shared", *sd.PASSAGES]
    assert {r.doc_id: r.kept for r in out.collect()} == {1: rows[0][1], 2: "Other words\n here. The end.", 3: rows[2][1], None: passage}
    assert sd.remove_passages(df.limit(0)).count() == 0
