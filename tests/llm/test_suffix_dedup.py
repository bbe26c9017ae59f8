import hashlib
import random

import pytest

from tessera.llm import suffix_dedup as sd


def brute(rows, width):
    """(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)"""
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < doc:
                gone[i : i + width] = [True] * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["ab", "the", "café", "x", "thonnd", "\n", "of", "ing"]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(8, 30))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(passages) if r.random() < 0.4 else r.choice(words) for _ in range(r.randint(0, 25)))
        rows.append((i, text))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, "a" * 300), (n + 3, "b" + "a" * 200), (n + 4, "ab" * 100), (n + 5, ""), (n + 6, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot", "block"), [(1, 1024, 4 << 20), (2, 2, 4 << 20), (3, 1024, 200), (4, 1, 300)])
def test_against_brute_force(spark, seed, hot, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sd.digest(sd.remove_repeats(df, hot=hot, block=block)).collect()
    assert sorted(map(tuple, found)) == brute(rows, 50)


def test_width_and_gram(spark):
    rows = corpus(5, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, sd.digest(sd.remove_repeats(df, width=12, gram=5)).collect())) == brute(rows, 12)


def test_nulls_repeated_rows_and_other_columns(spark):
    long = "one passage of some words that is long enough to be cut away here " * 2
    df = spark.createDataFrame([(1, long, "x", 1), (1, long, None, 2), (2, long, "y", 3), (None, long, "z", 4)], "doc_id long, text string, removed2 string, n long")
    out = sd.remove_repeats(df).orderBy("n").collect()
    assert [bytes(r.kept).decode() for r in out] == [long, long, "", long]
    assert [r.removed2 for r in out] == ["x", None, "y", "z"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.digest(sd.remove_repeats(empty)).count() == 0


def test_clashing_columns_null_ids_and_long_texts(spark):
    r = random.Random(8)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(150_000))
    rows = [(1, long), (2, "x" * 2_000_000), (3, "start " + long[1000:900_000] + " end"), (4, None), (5, ""), *[(None, long[:60])] * 40, (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'{c}!' as `{c}`" for c in ("n_bytes", "removed", "kept", "__chunk", "chunk", "bucket", "kind", "a", "n_chars")))
    got = sd.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "__chunk", "chunk", "bucket", "kind", "a", "n_chars", *sd.ADDED]
    found = sorted(map(tuple, sd.digest(got.where("doc_id is not null")).collect()))
    assert [f[:3] for f in found] == [(1, len(long), 0), (2, 2_000_000, 0), (3, 900_000 - 1000 + 10, found[2][2]), (4, 0, 0), (5, 0, 0)]
    assert 899_000 <= found[2][2] <= 899_002
    alone = got.where("doc_id is null").collect()
    assert len(alone) == 41 and all(bytes(x.kept).decode() == (x.text or "") and not x.removed and x.bucket == "bucket!" and x["__chunk"] == "__chunk!" for x in alone)
    kept = sd.stage(spark, df, "")
    assert kept.columns == df.columns and kept.where("kept = 'kept!' and removed = 'removed!'").count() == len(rows)


def test_stage_keeps_whole_characters(spark):
    shared = "é" * 30
    df = spark.createDataFrame([(1, shared, "fr", "s", 30), (2, "aé" + shared, "fr", "s", 32)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in sd.stage(spark, df, "").collect()}
    assert out[1].text == shared and out[2].text == "a" and out[2].n_chars == 1


def test_one_row_goes_back_for_each_message():
    """However many texts a bucket is dealt to: rows and time go with what was sent, not with messages times texts."""
    import time

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(4)
    sent, said = [], []
    for chunk in range(3000):
        kind, n = 3 + chunk % 2, int(r.integers(1, 40))
        lengths = (np.full(n, 50) if kind == 4 else r.integers(50, 76, n)).astype(np.int32)
        bits = [[int(b) for b in r.integers(0, 2, x - 49)] for x in lengths]
        # a text's bytes are its own flags
        data = b"".join(bytes([*b, *[1] * 49]) for b in bits)
        sent.append((chunk, kind, 7, lengths.tobytes(), r.integers(0, 9, n).tobytes(), r.integers(0, 1 << 62, n).astype(np.uint64).tobytes(), data))
        said.append((chunk, kind, 7, [sum(x << w for w, x in enumerate(b)) for b in bits]))
    table = sd._messages(sent, ("chunk", "kind", "bucket", "a", "b", "c", "d"))
    began = time.process_time()
    laid = sd._lay_out(7, table, 1 << 14)
    assert laid.num_rows > 200 and sum(map(len, laid.column("text").to_pylist())) == sum(len(s[6]) for s in sent)
    other = sd._lay_out(8, table.slice(0, 5), 1 << 20)
    flagged = pa.concat_tables([laid, other]).rename_columns(["bucket", "share", "flags", "lengths", "owners", "head", "chosen"])
    back = [row for b in sd._sent_back(flagged.to_batches(max_chunksize=3), 50) for row in b.to_pylist()]
    assert time.process_time() - began < 5
    assert [(x["chunk"], x["kind"], x["bucket"], np.frombuffer(x["b"], np.uint64).tolist()) for x in back] == said + [(c, k, 8, b) for c, k, _, b in said[:5]]


def test_suffix_array_itself(spark):
    from tessera.llm._session import register_grouping_sort

    name = register_grouping_sort(spark)
    text = b"banana" * 3
    row = spark.createDataFrame([(bytearray(text + text), bytearray((len(text)).to_bytes(4, "little") * 2), bytearray((7).to_bytes(8, "little") + (9).to_bytes(8, "little")))], "t binary, l binary, o binary")
    flags = list(row.selectExpr(f"{name}(t, l, o, 4) f").first().f)
    assert flags == [0] * len(text) + [1] * (len(text) - 3) + [0] * 3
