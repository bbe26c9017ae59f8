"""Removal of repeated passages by sliding spans of sentences.

A text is cut into sentences, each with the white space around it; a sentence ends behind . ! or ? and white space, or at a
line's end. Every run of `run` sentences (all of them, where a text has fewer) is a span, compared without the white space
around its sentences. A span's first place is the one with the smallest (doc_id, position) in the corpus; sentences that
any other place of a repeated span covers are removed. Spans are judged on the input, not on what is left.

What is not removed: repeated text that holds fewer than `run` whole sentences, however long, and a text of fewer sentences
that stands inside a longer one. The query and its SQL have runs of 3; a smaller `run` removes more. `remove_passages` is
the way for those: it takes words for sentences and removes every word of a passage of over `over` words that has an earlier
place, wherever its sentences end; shorter passages stay. The query does not use it, as its SQL does not say so.

A passage is found by its windows of over + 1 words. Each window has as its anchor the least hash of the shorter grams in it,
so equal windows have equal anchors. Neighbouring windows of one anchor are an item; where all items of an anchor hold the
same words, their places settle all their windows, and only windows of the other repeated anchors become spans. Items are
told by 64 bits beside the anchor's 64, windows by 128.

Spans are grouped by a 128-bit key with a partial count before the shuffle, and only keys that occur twice are joined to
the spans again, by a join that can split a frequent key's rows; what then meets is one document's own positions.

Nulls: a null text has no sentences and stays null. A row with a null doc_id is returned as it came and compared with
nothing. Rows that repeat a doc_id with the same text are the same place; with other texts they are told apart by them.
An empty table gives an empty one. A text of any length is cut in time that goes with its length; it and the places of its
repeated spans lie whole in a task's memory. Other columns pass through; one with the name of a result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import Prefix, sliding_min
from ._session import cut, frugal, pieces

WORD = re.compile(rb"[^ \t\n\r]+")
PLACED = re.compile(r"[^ \t\n\r]+[ \t\n\r]*")
MARK = re.compile(r"[.!?]+([ \t\n\r]+)?|\n+")
SOLID = re.compile(r"[^ \t\n\r]")
BLANK = " \t\n\r"
ADDED = ("n_sentences", "removed", "kept")
PASSAGES = ("n_words", "removed", "kept")
SPANS = "doc_id long, mark long, at int, a long, b long"
SIEVE = 1 << 23


def sentences(text: str | None) -> list[str]:
    """As the SQL's pattern finds them, in one pass that no run of marks or blanks slows down. A sentence's first character
    that is not blank is never its end mark."""
    text, out, begin = text or "", [], 0
    first = SOLID.search(text)
    for m in MARK.finditer(text):
        if first is None:
            break
        end = m.end()
        if m.start() < first.start():
            continue  # lines before it
        if m[0][0] != "\n":
            if m[1] is None:
                continue
            if m.start() == first.start() and m.start(1) == m.start() + 1:
                line = m[1].find("\n")
                if line < 0:
                    continue
                end = m.start(1) + line
                while text[end : end + 1] == "\n":
                    end += 1
        out.append(text[begin:end])
        begin, first = end, SOLID.search(text, end)
    return out if first is None else [*out, text[begin:]]


def keys(parts: list[str], run: int) -> list[bytes]:
    """128 bits for the span that begins at each sentence."""
    bare = [p.strip(BLANK) for p in parts]
    last = max(len(bare) - run + 1, min(1, len(bare)))
    return [xxhash.xxh3_128_digest("\n".join(bare[i : i + run]).encode("utf-8", "surrogatepass")) for i in range(last)]


def spans(docs: DataFrame, run: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [keys(sentences(t.as_py()), run) for t in part.column(2)]
                count = np.array([len(f) for f in found], np.int64)
                row = np.repeat(np.arange(len(found)), count)
                at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                key = np.frombuffer(b"".join(k for f in found for k in f), np.int64).reshape(-1, 2)
                yield pa.record_batch([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(key[:, 0]), pa.array(key[:, 1])], names=["doc_id", "mark", "at", "a", "b"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").mapInArrow(frugal(emit), SPANS)


def words(text: str | None) -> list[str]:
    """Runs of what is not blank, each with the blanks behind it, the first also with those before it."""
    out = PLACED.findall(text or "")
    return [text[: SOLID.search(text).start()] + out[0], *out[1:]] if out else out


class Windows:
    """The runs of n words of one text: two hashes of each, and its anchor."""

    def __init__(self, text: str | None, n: int):
        found = WORD.findall((text or "").encode("utf-8", "surrogatepass"))
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), np.uint64).reshape(-1, 2)
        self.n, self.gram, self.halves = n, n // 3 + 1, [Prefix(hashes[:, i]) for i in (0, 1)]

    def items(self) -> tuple[np.ndarray, ...]:
        """First window, number of windows, anchor, hash of the words, and whether the anchor stands there more than once,
        without which no two windows of the item are equal."""
        grams, more = self.halves[0].grams(self.gram), self.n - self.gram
        anchors = sliding_min(grams, more + 1)
        at = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])[: len(anchors)])
        count = np.diff(at, append=len(anchors))
        name, size = anchors[at], count + more
        begin = np.cumsum(size) - size
        inside = grams[np.arange(size.sum()) - np.repeat(begin - at, size)] == np.repeat(name, size)
        inner = np.add.reduceat(inside.astype(np.int64), begin) > 1 if len(at) else np.zeros(0, bool)
        return at, count, name, self.halves[1].spans(at, at + count - 1 + self.n), inner

    def keys(self, at: np.ndarray) -> list[np.ndarray]:
        return [half.grams(self.n)[at] for half in self.halves]


def cover(starts: pa.ListScalar, run: int, size: int) -> list[int]:
    """Which of `size` words the windows {at, count} of `run` words cover."""
    if starts.values is None:
        return []
    at, count = (starts.values.field(c).to_numpy() for c in ("at", "count"))
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + count - 1 + run, -1)
    return np.flatnonzero(np.cumsum(change[:-1])).tolist()


def later_passages(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, mark, at, count: windows of n words that are not the first places of their words; and a table of few bytes
    whose doc_id and mark include all of these."""
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [Windows(t.as_py(), n).items() for t in part.column(2)]
                row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                at, count, anchor, form, inner = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch([part.column(0).take(row), part.column(1).take(row), pa.array(at, pa.int32()), pa.array(count, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(form.view(np.int64)), pa.array(inner)], names=["doc_id", "mark", "at", "count", "anchor", "form", "inner"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows, at, a, b = [], [], [], []
                for i, (text, open_) in enumerate(zip(part.column("text"), part.column("open"), strict=True)):
                    at.append(np.concatenate([np.arange(x["at"], x["at"] + x["count"]) for x in open_.as_py()]))
                    rows.append(np.full(len(at[-1]), i))
                    for half, key in zip((a, b), Windows(text.as_py(), n).keys(at[-1]), strict=True):
                        half.append(key)
                row = pa.array(np.concatenate(rows))
                keys_ = (pa.array(np.concatenate(half).view(np.int64)) for half in (a, b))
                yield pa.record_batch([part.column("doc_id").take(row), part.column("mark").take(row), pa.array(np.concatenate(at), pa.int32()), *keys_], names=["doc_id", "mark", "at", "a", "b"])

    held = docs.mapInArrow(frugal(items), "doc_id long, mark long, at int, count int, anchor long, form long, inner boolean")
    shared = held.groupBy("anchor").agg(F.count("*").alias("n"), F.expr("min(form) = max(form) and not max(inner)").alias("settled"), F.min(F.struct("doc_id", "at")).alias("first")).where("n > 1 or not settled")
    shared = cut(shared.select("anchor", "settled", F.col("first.doc_id").alias("d"), F.col("first.at").alias("p")), pieces(docs))  # as in _later
    found = cut(held.join(shared, "anchor").where("not settled or doc_id <> d or at <> p").select("doc_id", "mark", "at", "count", "settled"), pieces(docs))
    open_ = found.where("not settled").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "count")).alias("open"))
    likely = _likely(docs, found.where("not settled")).where("__likely").drop("__likely")
    placed = cut(likely.join(open_, ["doc_id", "mark"]).mapInArrow(frugal(windows), SPANS))
    later = _later(placed, pieces(docs)).select("doc_id", "mark", "at", F.lit(1).alias("count"))
    return found.where("settled").drop("settled").unionByName(later), found


def _likely(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs with __likely, true where places(doc_id, mark) has the row's and seldom elsewhere: a bitmap of SIEVE bits, at most
    SIEVE / 64 rows however many places there are, keeps most other texts out of a shuffle."""
    slot = lambda *of: F.pmod(F.xxhash64(*of), F.lit(SIEVE))
    bit = F.col("__slot").bitwiseAND(F.lit(63)).cast("int")
    sieve = places.select(slot("doc_id", "mark").alias("__slot")).groupBy(F.shiftright("__slot", 6).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    docs_ = docs.withColumn("__slot", slot(F.col("doc_id").cast("long"), F.xxhash64("text"))).withColumn("__word", F.shiftright("__slot", 6))
    held = F.call_function("shiftrightunsigned", F.coalesce("__bits", F.lit(0).cast("long")), bit).bitwiseAND(F.lit(1)) == 1
    return docs_.join(F.broadcast(sieve), "__word", "left").select(*docs.columns, held.alias("__likely"))


def remove_passages(docs: DataFrame, over: int = 50) -> DataFrame:
    """docs(doc_id long, text string, ...) with n_words, removed (positions of words from 0, in order) and kept (the text
    without them) added."""
    if over < 1:
        raise ValueError("over must be at least 1")
    docs, run = docs.drop(*PASSAGES), over + 1
    later, places = later_passages(docs, run)
    gone = later.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "count")).alias("__starts"))
    split = _likely(docs, places)
    some, none = (split.where(c).drop("__likely") for c in ("__likely", "not __likely"))
    both = _beside(some, gone).unionByName(none.withColumn("__starts", F.lit(None).cast("array<struct<at: int, count: int>>")))
    return _removed(both, words, lambda starts, size: cover(starts, run, size), PASSAGES)


def remove_repeated(docs: DataFrame, run: int = 3) -> DataFrame:
    """docs(doc_id long, text string, ...) with n_sentences, removed (positions from 0, in order) and kept (the text
    without them) added."""
    if run < 1:
        raise ValueError("run must be at least 1")
    docs = docs.drop(*ADDED)
    gone = _later(spans(docs, run), pieces(docs)).groupBy("doc_id", "mark").agg(F.collect_set("at").alias("__starts"))
    return _removed(_beside(docs, gone), sentences, lambda starts, size: sorted({i for s in starts.as_py() or () for i in range(s, min(s + run, size))}), ADDED)


def _later(placed: DataFrame, files: int) -> DataFrame:
    """The places of spans that are not their first ones."""
    first = placed.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("first")).where("n > 1")
    # kept apart, as a join in the stage of a sum cannot split a frequent key
    first = cut(first.select("a", "b", F.col("first.doc_id").alias("d"), F.col("first.at").alias("p")), files)
    return placed.join(first, ["a", "b"]).where("doc_id <> d or at <> p")


def _beside(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with the __starts that gone has for them."""
    own = docs.columns
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), "__starts")
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64("text") == F.col("__mark")), "left").select(*own, "__starts")


def _removed(both: DataFrame, split: Callable[[str | None], list[str]], covered: Callable[[pa.ListScalar, int], list[int]], names: tuple[str, ...]) -> DataFrame:
    own = both.columns[:-1]

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("__starts"), strict=True):
                text = text.as_py()
                parts = split(text)
                out = covered(starts, len(parts))
                n.append(len(parts))
                removed.append(out)
                kept.append(_without(parts, out) if out else text)
            added = [pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.string())]
            yield pa.record_batch([*(batch.column(c) for c in own), *added], names=[*own, *names])

    fields = [f for f in both.schema.fields if f.name in own]
    added = [T.StructField(c, t) for c, t in zip(names, (T.LongType(), T.ArrayType(T.IntegerType()), T.StringType()), strict=True)]
    return both.mapInArrow(frugal(rest), T.StructType([*fields, *added]))


def _without(parts: list[str], out: list[int]) -> str:
    gone = set(out)
    return "".join(p for i, p in enumerate(parts) if i not in gone)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed, kept_sha256 of the remaining text (null: empty)."""
    found = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[ \t\n\r]*[^ \t\n\r].*?(?:[.!?]+[ \t\n\r]+|\n+|\z)') AS s FROM documents),
b AS (SELECT doc_id, list_transform(s, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))) AS t FROM d WHERE len(s) > 0),
p AS (SELECT doc_id, unnest(range(0, greatest(len(t) - 2, 1))) AS i0, t FROM b),
k AS (SELECT doc_id, i0, array_to_string(t[i0 + 1:i0 + 3], chr(10)) AS span FROM p),
f AS (SELECT span, min(struct_pack(d := doc_id, p := i0)) AS f FROM k GROUP BY span HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i0, i0 + 3)) AS i FROM k JOIN f USING (span) WHERE doc_id <> f.f.d OR i0 <> f.f.p),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
o AS (SELECT doc_id, text, s, coalesce(list_filter(gone, lambda i: i < len(s)), []) AS gone FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(CASE WHEN len(gone) = 0 THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(s)), lambda i: NOT list_contains(gone, i)), lambda i: s[i + 1]), '') END) AS kept_sha256 FROM o
"""
