import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing as pk

PATH = pk.default_tokenizer()


def ids_of(text):
    return pk.encoder(PATH).slow.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, docs, capacity=2048):
    """Every id in one piece, gapless sequences of at most the capacity; the share of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for d, pieces in by_doc.items():
        ids, at = ids_of(docs[d]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    pad = total = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    return pad / (pad + total)


def test_query_on_documents(spark):
    rows = pk.query(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert check(rows, docs) < 0.03


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_small_cases(spark, capacity):
    docs = {1: None, 2: "", 3: "a", 4: "<|endoftext|> is special", 5: "語 text   and \x1c more", 6: "word " * 5000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(2)
    check(pk.pack(df, PATH, capacity).collect(), docs, capacity)
    assert pk.pack(df.limit(0), PATH).count() == 0
    assert pk.pack(spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string"), PATH).count() >= 2


def test_long_texts_and_clashing_columns(spark):
    docs = {1: "some words and more. " * 60_000, 2: "x" * 300_000, 3: "é" * 100_000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", *(f"'y' as `{c}`" for c in ("start", "length", "offset", "sequence_id", "doc_tokens")))
    check(pk.pack(df, PATH).collect(), docs)


def test_last_bin_is_cut_into_powers_of_two():
    for n in (1, 3, 1000, 1500, 2047, 2048, 5000):
        ids = np.arange(n, dtype=np.uint32)
        packer = pk.Packer(2048, 0)
        rows = packer.add(7, ids) + packer.rest()
        at, used = 0, defaultdict(int)
        for _, start, length, crc, total, seq, offset in sorted(rows, key=lambda r: r[1]):
            assert start == at and total == n and crc == zlib.crc32(ids[at : at + length].astype("<u4").tobytes())
            at += length
            used[seq] += length
        assert at == n and all(u & (u - 1) == 0 for u in used.values()), (n, dict(used))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("\n\r\t  'stdéÉñ<|>0123.,!?\xa0\xad\x85 語😀"), st.characters(max_codepoint=0x24F)), max_size=60))
def test_both_libraries_agree(text):
    e = pk.encoder(PATH)
    assert list(e(text)) == e.slow.encode(text, add_special_tokens=False).ids
