"""Every stage against brute force on the rows that the stage before it kept."""

import hashlib

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_packing import check
from tests.llm.test_suffix_dedup import brute as cuts

from tessera.llm import quality

PATH = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, PATH).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            kept = {r.doc_id: r.text for r in rows}
            assert len(kept) == len(rows)
        if name == "quality":
            labels = spark.read.parquet(f"{PATH}/labels.parquet")
            source = spark.read.parquet(f"{PATH}/documents.parquet")
            found = quality.classify(source, labels, quality.fit(source, labels)).collect()
            assert set(kept) == {r.doc_id for r in found if r.kept} and 0.5 < len(kept) / len(before) < 1
        elif name == "near_dedup":
            assert set(kept) == {r[0] for r in near(list(before.items())) if r[3]}
        elif name == "suffix_dedup":
            want = {r[0]: r for r in cuts(list(before.items()), 50)}
            assert set(kept) == set(before)
            for d, text in kept.items():
                if want[d][2] == 0:
                    assert text == before[d]
                whole = hashlib.sha256(text.encode()).hexdigest() == want[d][4]
                assert whole or len(text.encode()) < want[d][1] - want[d][2]  # a cut character goes whole
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
            assert set(kept) == {r[0] for r in leaks(list(before.items()), bench) if not r[5]}
        else:
            check(rows, before)
        before = kept


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, PATH).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
