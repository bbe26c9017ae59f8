"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words of letters, digits and non-ASCII bytes, A-Z lower-cased, one space between words. Every
window of `size` words of a benchmark item (the whole item where it is shorter) is a pattern; the automaton over all of
them runs once over each normalised document. Matches start and end at word limits; places are given back in the original
text. No shuffle takes place: the benchmark's windows go to every executor. Their size is counted first, and where they
exceed `most_bytes` each share of that size has an automaton of its own, and a document passes one after the other. An
automaton takes about 42 bytes for a byte of windows in each Python worker, so the default of 4 MB is some 170 MB.

Nulls: a null text has no words; an item without words has no window; a null item_id takes no part. Rows that repeat an
item_id are one item, rows that repeat a doc_id each have their own result. Empty tables give an empty result, or one
without hits. A text of any length is scanned once, in time that goes with its length and its hits, and lies whole in a
task's memory. Other columns pass through; those with names of result columns are replaced (the stage keeps them).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import aside, cut, frugal, held, pieces

#: Bytes that no word holds, once A-Z are lower-cased.
OUTSIDE = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
BLANK = bytes.maketrans(OUTSIDE, b" " * len(OUTSIDE))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ADDED = ("n_words", "words", "items", "spans")
FOUND = "n_words long, words array<struct<start: int, end: int>>, items array<string>, spans array<struct<start: long, end: long>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(BLANK).split()


def windows(text: str | None, size: int) -> set[str]:
    """The item's patterns: each window between blanks, one character a byte."""
    w = words(text)
    k = min(size, len(w))
    return {(b" " + b" ".join(w[i : i + k]) + b" ").decode("latin-1") for i in range(len(w) - k + 1)} if w else set()


def automaton(patterns: dict[str, list[str]]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for pattern, items in patterns.items():
        machine.add_word(pattern, (pattern.count(" ") - 1, len(pattern), items))
    machine.make_automaton()
    return machine


def scan(machine: ahocorasick.Automaton, text: str | None, place: bool = True) -> tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]:
    """Number of words; runs of hit words; items; if asked for, the runs' places in the text's characters."""
    w = words(text)
    if not w or not len(machine):
        return len(w), [], set(), []
    line = (b" " + b" ".join(w) + b" ").decode("latin-1")
    runs: list[list[int]] = []
    items: set[str] = set()
    at, seen = 0, 0  # words before seen begin before the character `at`
    for last, (k, length, own) in machine.iter(line):
        items.update(own)
        first = last - length + 1
        if first >= at:
            seen += line.count(" ", at, first)
        else:
            seen -= line.count(" ", first, at)
        at = first
        if runs and seen <= runs[-1][1] and seen >= runs[-1][0]:
            runs[-1][1] = max(runs[-1][1], seen + k)
        else:
            runs.append([seen, seen + k])
    merged: list[list[int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    places = []
    if merged and place:
        raw = text.encode("utf-8", "surrogatepass")
        begin, end = zip(*((m.start(), m.end()) for m in WORD.finditer(raw.lower())), strict=True)
        # every character has one byte that is not 10xxxxxx, its first
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        places = [(int(chars[begin[a]]), int(chars[end[b - 1]])) for a, b in merged]
    return len(w), [(a, b) for a, b in merged], items, places


def _merged(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(runs):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _one_share(docs: DataFrame, patterns: dict[str, list[str]], first: bool, place: bool) -> DataFrame:
    """docs with the result columns added, or with the hits of these patterns added to them."""
    sent = docs.sparkSession.sparkContext.broadcast(patterns)
    own, key = [c for c in docs.columns if c not in ADDED], f"automaton {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held(key, lambda: automaton(sent.value))
        span = lambda kind: pa.list_(pa.struct([("start", kind), ("end", kind)]))
        for batch in batches:
            found = [scan(machine, t.as_py(), place) for t in batch.column("text")]
            hit, items, spans = ([f[k] for f in found] for k in (1, 2, 3))
            if not first:
                before = [[batch.column(c)[i].as_py() for c in ADDED[1:]] for i in range(batch.num_rows)]
                pairs = lambda old: [(x["start"], x["end"]) for x in old]
                hit = [h + pairs(x[0]) for h, x in zip(hit, before, strict=True)]
                items = [i | set(x[1]) for i, x in zip(items, before, strict=True)]
                spans = [h + pairs(x[2]) for h, x in zip(spans, before, strict=True)]
            added = [pa.array([f[0] for f in found], pa.int64()), pa.array(map(_merged, hit), span(pa.int32())), pa.array(map(sorted, items), pa.list_(pa.string())), pa.array(map(_merged, spans), span(pa.int64()))]
            yield pa.record_batch([*(batch.column(c) for c in own), *added], names=[*own, *ADDED])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in own)
    return docs.mapInArrow(frugal(run, key), kinds + FOUND)


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct (pattern, item) of benchmark(item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i.as_py()) for i, t in zip(batch.column(0), batch.column(1), strict=True) for p in windows(t.as_py(), size)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["pattern", "item"])

    return benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), "text").mapInArrow(frugal(run), "pattern string, item string").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_bytes: int = 4 << 20, place: bool = True) -> DataFrame:
    """docs(text, ...) with n_words, words (runs of hit words), items (sorted ids of the items with a window in the text)
    and spans (the runs' places in characters of the text; empty without `place`) added."""
    docs = docs.drop(*ADDED)
    found = cut(item_windows(benchmark, size), pieces(benchmark))
    total = found.agg(F.sum(F.octet_length("pattern") + F.octet_length("item"))).first()[0] or 0
    shares = max(1, -(-total // most_bytes))
    for share in range(shares):
        patterns: dict[str, list[str]] = {}
        for r in (found.where(F.pmod(F.xxhash64("pattern"), F.lit(shares)) == share) if shares > 1 else found).collect():
            patterns.setdefault(r.pattern, []).append(r.item)
        docs = _one_share(docs, patterns, not share, place)
    return docs


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("words") > 0).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return digest(contamination(read("documents"), read("benchmark"), place=False))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a hit go."""
    inner, back = aside(docs, "doc_id", "text")
    found = contamination(inner, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), place=False)
    return back(found.where(F.size("words") == 0)).coalesce(pieces(docs))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, len(v) AS k, array_to_string(v, ' ') AS pattern FROM (
  SELECT item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS v FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT DISTINCT k FROM p),
o AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS pattern FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT doc_id, o.k, i, item FROM o JOIN p USING (k, pattern)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
