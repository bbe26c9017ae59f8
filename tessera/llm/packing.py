"""Harmonic packing of token sequences.

A document's ids, with the end id behind them, are cut into pieces of reciprocal capacity: sizes floor(capacity / k) for
the k in CLASSES, largest first, so that a bin of class k takes exactly k pieces and is full but for capacity mod
floor(capacity / k) places. Every task fills the bins of each class on its own, k pieces to a bin, and knows nothing of
other tasks; nothing is shuffled. What is left at a task's end, fewer than k pieces of each class, is laid by first fit,
longest first; the last of these bins, where it is not full, is cut into sequences whose lengths are powers of two.

A sequence's id is the task's partition number times 2**33 plus its place in the task, so ids are unique and a task that
runs again gives the same ones. A null text counts as empty: its document is the end id alone. Rows that repeat a doc_id
are documents of their own; a null doc_id stays null. An empty table gives an empty one. A text of any length is one
document, cut as often as it takes; its ids lie whole in a task's memory. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._session import frugal, held, pieces

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: k of the bins; 2048 holds single ids.
CLASSES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 102, 128, 204, 256, 409, 512, 682, 1024, 2048)

#: Texts of these characters alone are split alike by both libraries; the rest goes to `tokenizers`.
PLAIN = re.compile(r"[\n\r\t -~¡-¬®-ɏ]*")


class Encoder:
    """Ids by a vocabulary file of `tokenizers`. Where the same vocabulary lies beside it as ranks, plain texts are
    encoded with `tiktoken`, which gives the same ids several times faster; a text that holds a special token's string
    or a character outside PLAIN always takes the first way."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        self.special = [t["content"] for t in json.loads(Path(path).read_bytes()).get("added_tokens", [])]
        self.fast = None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import base64

            import public_tokenizers
            import tiktoken

            lines = ranks.read_bytes().splitlines()
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def slow(self):
        """Loaded where it is needed; workers outlive their tasks and would hold it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    return held(f"encoder {path}", lambda: Encoder(path))


class Packer:
    """The bins of one task. add() takes a document and gives the rows of bins that filled; rest() gives the others."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.sizes = sorted({(capacity // k, k) for k in CLASSES if k <= capacity}, reverse=True)
        self.open: dict[int, list[tuple]] = {size: [] for size, _ in self.sizes}

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        rows, at = [], 0
        for p in pieces:
            rows.append((*p[:5], self.next, at))
            at += p[2]
        self.next += 1
        return rows

    def cuts(self, n: int) -> list[int]:
        out = []
        for size, _ in self.sizes:
            out += [size] * (n // size)
            n %= size
        return out

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        rows, start = [], 0
        data, total = np.ascontiguousarray(ids, "<u4"), len(ids)
        per = dict(self.sizes)
        for size in self.cuts(total):
            bin_ = self.open[size]
            part = data[start : start + size]
            bin_.append((doc, start, size, zlib.crc32(part), total, part if per[size] == 1 else part.copy()))
            start += size
            if len(bin_) == per[size]:
                rows += self._close(bin_)
                self.open[size] = []
        return rows

    def rest(self) -> list[tuple]:
        left = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[2])
        self.open = {size: [] for size in self.open}
        bins: list[tuple[list, int]] = []
        for p in left:
            for i, (pieces, used) in enumerate(bins):
                if used + p[2] <= self.capacity:
                    pieces.append(p)
                    bins[i] = (pieces, used + p[2])
                    break
            else:
                bins.append(([p], p[2]))
        last = self._halved(*bins.pop()) if bins and bins[-1][1] < self.capacity else []
        return [row for pieces in [*(p for p, _ in bins), *last] for row in self._close(pieces)]

    def _halved(self, pieces: list[tuple], used: int) -> list[list[tuple]]:
        """The pieces in bins of the powers of two that add up to `used`, largest first; a piece is cut where one ends."""
        out, left = [], pieces[::-1]
        for size in (1 << i for i in reversed(range(used.bit_length())) if used >> i & 1):
            bin_, room = [], size
            while room:
                doc, start, length, crc, total, ids = left.pop()
                if length > room:
                    left.append((doc, start + room, length - room, zlib.crc32(ids[room:]), total, ids[room:]))
                    length, crc, ids = room, zlib.crc32(ids[:room]), ids[:room]
                bin_.append((doc, start, length, crc, total, ids))
                room -= length
            out.append(bin_)
        return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """docs(doc_id, text, ...) -> pieces; `tokenizer` is the path of a vocabulary file that every executor has."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(capacity, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        kinds = [pa.int64()] * 7
        names = [x.split()[0] for x in PIECES.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                rows += packer.add(doc.as_py(), np.append(encode(text.as_py()), np.uint32(end_id)))
            if rows:
                yield batch_of(rows)
        if rows := packer.rest():
            yield batch_of(rows)

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), "text").coalesce(pieces(docs)).mapInArrow(frugal(run, f"encoder {tokenizer}"), PIECES)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_tokenizer())
