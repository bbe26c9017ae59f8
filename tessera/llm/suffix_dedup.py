"""Removal of bytes that an earlier document already has, by suffix arrays.

A byte goes if a string of `width` bytes that covers it also starts in a document with a smaller doc_id. Strings are
judged on the input. How the whole corpus is compared without sorting all of its suffixes in one place:

1. Every window of `width` bytes is named by the least hash of the `gram`-byte strings in it. Equal windows have equal
   names, and neighbouring windows mostly share one: an *item* is a run of windows of one name, at most
   `width - gram + 1` of them. Items partition a document's windows.
2. Chunks of documents ask by name which names occur in two documents; only those items go on.
3. Chunks then ask by (name, hash of the item's bytes) for the smallest document that has just this item. In every later
   document all of the item's windows go. Names with a single form are settled by that.
4. Names with several forms (edges of passages, edited copies) send each form's bytes once, from its smallest document.
   They meet by name, in texts of about `block` bytes; the suffix array of such a text (grouping_sort.java) puts equal
   windows side by side, which tells whose windows a smaller document has. A name with over `hot` forms sends windows
   instead of items and they meet by content, so that no name is tied to one task. Each window is sent with all of its
   bytes, some eleven times those of the items, so `hot` forms are as many as go well into a block.
5. Each chunk marks the windows and writes what is left.

What is sent is one entry for each name, form or window and chunk, so no hot passage or group of copies makes a large
group; the documents themselves are shuffled once, by a hash of doc_id.

Equal names, forms and windows are told by hashes of 64 bits, a name's being part of each of its forms and windows; bytes are
only compared in the suffix arrays. Names with one form in all their documents, and windows that meet by content, never
get there: there is nothing to put in order.

Nulls: a null text counts as empty. A row with a null doc_id is returned as it came and compared with nothing, without a
shuffle. Rows that repeat a doc_id are not earlier than each other. Texts under `width` bytes and empty tables pass
through. A text of any length lies whole in one task's memory, with about 60 bytes for each of its bytes in slices. Other
columns pass through; those named n_bytes, removed or kept are replaced (the stage keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import Prefix, mix, sliding_min
from ._session import aside, give_back, pieces, register_grouping_sort

#: Bytes of text to a chunk of documents, and to a bucket of names.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 48 << 20
SLICE = 1 << 18
MESSAGE = "chunk int, kind int, bucket int, a binary, b binary"
ADDED = ("n_bytes", "removed", "kept")
FOUND = "n_bytes long, removed array<struct<start: long, end: long>>, kept binary"


def bucket_of(name: np.ndarray, buckets: int) -> np.ndarray:
    """By the high half, so that what is in order of name is in order of bucket too."""
    return (((name >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


class Items:
    """The items of a chunk's documents, in order of document and place."""

    def __init__(self, table: pa.Table, width: int, gram: int, buckets: int):
        give_back()
        self.width, self.buckets = width, buckets
        self.ids = table.column("doc_id").to_pylist()
        self.texts = [(t or "").encode("utf-8", "surrogatepass") if isinstance(t, str) or t is None else bytes(t) for t in table.column("text").to_pylist()]
        most = width - gram + 1
        parts, batch, held = [], [], 0
        for row, text in enumerate(self.texts):
            if self.ids[row] is None or len(text) < width:
                continue
            batch.append(row)
            held += len(text)
            if held >= SLICE:
                parts.append(self._slice(batch, gram, most))
                batch, held = [], 0
        if batch:
            parts.append(self._slice(batch, gram, most))
        empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        self.row, self.start, self.stop, self.name, self.form = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty
        ids = np.array([-1 if i is None else i for i in self.ids] or [0], np.int64)
        self.doc = ids[self.row]
        self.bucket = bucket_of(self.name, buckets)

    def _slice(self, rows: list[int], gram: int, most: int) -> tuple[np.ndarray, ...]:
        texts = [self.texts[r] for r in rows]
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        prefix = Prefix(np.frombuffer(b"".join(texts), np.uint8))
        least = sliding_min(prefix.grams(gram), most)
        inside = np.zeros(len(least) + 1, np.int32)
        np.add.at(inside, begins, 1)
        np.add.at(inside, np.minimum(begins + lengths - self.width + 1, len(least)), -1)
        valid = np.cumsum(inside[:-1]) > 0
        head = valid.copy()
        head[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
        tail = valid.copy()
        tail[:-1] &= (least[1:] != least[:-1]) | ~valid[1:]
        start, stop = np.flatnonzero(head), np.flatnonzero(tail) + 1
        owner = np.searchsorted(begins, start, "right") - 1
        pieces = -(-(stop - start) // most)
        first = np.repeat(start, pieces) + most * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        last = np.minimum(first + most, np.repeat(stop, pieces))
        owner = np.repeat(owner, pieces)
        form = prefix.spans(first, last - 1 + self.width)
        return np.array(rows, np.int64)[owner], first - begins[owner], last - begins[owner], mix(least[first]), form

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names in order, whether several documents here have them, and each item's name."""
        order = np.argsort(self.name, kind="stable")
        name, doc = self.name[order], self.doc[order]
        new = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.zeros(0, bool)
        at = np.cumsum(new) - 1
        several = np.zeros(int(new.sum()), bool)
        several[at[doc != doc[new][at]]] = True
        where = np.empty(len(name), np.int64)
        where[order] = at
        return name[new], several, where

    def forms(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (name, form) of the items `of` by bucket, name and form; their smallest documents; each one's index;
        an item of the smallest document."""
        order = of[np.lexsort((self.doc[of], self.form[of], self.name[of]))]
        name, form = self.name[order], self.form[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (form[1:] != form[:-1])]) if len(order) else np.zeros(0, bool)
        where = np.full(len(self.name), -1, np.int64)
        where[order] = np.cumsum(new) - 1
        return name[new], form[new], where, order[new]

    def bytes_of(self, item: int) -> bytes:
        return self.texts[self.row[item]][self.start[item] : self.stop[item] - 1 + self.width]


def _messages(rows: list[tuple], names: tuple[str, ...] = ("chunk", "kind", "bucket", "a", "b")) -> pa.Table:
    kinds = {"a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, kinds.get(n, pa.int32())) for n, c in zip(names, columns, strict=True)], names=list(names))


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """Runs of a sorted array."""
    if not len(bucket):
        return []
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return [(int(bucket[i]), slice(int(i), int(j))) for i, j in zip(at, [*at[1:], len(bucket)], strict=True)]


def _answers(table: pa.Table, kind: int) -> dict[int, tuple[bytes, bytes]]:
    kinds = table.column("kind").to_numpy()
    return {table.column("bucket")[i].as_py(): (table.column("a")[i].as_py(), table.column("b")[i].as_py()) for i in np.flatnonzero(kinds == kind)}


def _repeated(items: Items, replies: pa.Table) -> np.ndarray:
    """The items whose name occurs in several documents of the corpus."""
    name, _, where = items.names()
    answer = _answers(replies, 1)
    flags = [np.unpackbits(np.frombuffer(answer[b][0], np.uint8), count=at.stop - at.start).astype(bool) for b, at in _by_bucket(bucket_of(name, items.buckets))]
    return np.flatnonzero(np.concatenate(flags)[where]) if flags else np.zeros(0, np.int64)


def _settled(items: Items, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items on repeated names, whether a smaller document has the same form, the route of the others' form (0: nothing
    more to ask), and by form: its hash and an item of its smallest document."""
    of = _repeated(items, replies)
    name, form, where, sample = items.forms(of)
    answer = _answers(replies, 2)
    parts = [answer[b] for b, _ in _by_bucket(bucket_of(name, items.buckets))]
    least = np.concatenate([np.frombuffer(a, np.int64) for a, _ in parts]) if parts else np.zeros(0, np.int64)
    route = np.concatenate([np.frombuffer(b, np.uint8) for _, b in parts]) if parts else np.zeros(0, np.uint8)
    at = where[of]
    later = items.doc[of] > least[at]
    route = np.where(items.doc[sample] == least, route, 0)
    return of, later, at, route, sample


def _windows(items: Items, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of the items: row, start, hash."""
    count = items.stop[chosen] - items.start[chosen]
    row = np.repeat(items.row[chosen], count)
    start = np.repeat(items.start[chosen], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    value = np.zeros(len(row), np.uint64)
    order = np.argsort(row, kind="stable")
    for r, at in _by_bucket(row[order]):
        own = order[at]
        value[own] = Prefix(np.frombuffer(items.texts[r], np.uint8)).spans(start[own], start[own] + items.width)
    return row, start, value


def _hot_windows(items: Items, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of items whose name has many forms: row, start, doc, and by distinct window: index, hash, the entry of its
    smallest document here. Distinct ones are ordered by bucket and hash."""
    row, start, value = _windows(items, chosen)
    doc = np.array([-1 if i is None else i for i in items.ids] or [0], np.int64)[row]
    bucket = bucket_of(value, items.buckets)
    order = np.lexsort((doc, value))
    new = np.concatenate([[True], value[order][1:] != value[order][:-1]]) if len(order) else np.zeros(0, bool)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return row, start, doc, where, bucket[order[new]], order[new]


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 25, hot: int = 8192, block: int = 1 << 20) -> DataFrame:
    """docs(doc_id long, text string, ...) with n_bytes, removed (byte ranges of the text, disjoint and in order) and kept
    (the remaining bytes) added. See the module's text."""
    if not 0 < gram <= width:
        raise ValueError("gram must lie between 1 and width")
    spark, every = docs.sparkSession, docs.drop(*ADDED)
    columns, files = every.columns, pieces(docs)
    lone = every.where("doc_id is null")
    docs = every.where("doc_id is not null")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, buckets = (max(parts, -(-total // size)) for size in (CHUNK_BYTES, BUCKET_BYTES))
    sort = register_grouping_sort(spark)
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")
    chunked = docs.withColumnRenamed("__chunk", "__own_chunk").withColumn("__chunk", chunk)
    columns = [c for c in chunked.columns if c != "__chunk"]
    make = lambda table: Items(table, width, gram, buckets)

    def ask_names(key: tuple, table: pa.Table) -> pa.Table:
        items = make(table)
        name, several, _ = items.names()
        return _messages([(key[0].as_py(), 1, b, name[at].tobytes(), np.packbits(several[at]).tobytes()) for b, at in _by_bucket(bucket_of(name, buckets))])

    def answer_names(key: tuple, table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("a")]
        several = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(s)) for x, s in zip(table.column("b"), sent, strict=True)]
        _, at, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        yes = (count > 1) | (np.bincount(at, weights=np.concatenate(several), minlength=len(count)) > 0)
        ends = np.cumsum([len(s) for s in sent])
        return _messages([(c.as_py(), 1, key[0].as_py(), np.packbits(yes[at[e - len(s) : e]]).tobytes(), None) for c, s, e in zip(table.column("chunk"), sent, ends, strict=True)])

    def ask_forms(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages([])
        items = make(table)
        name, form, _, sample = items.forms(_repeated(items, replies))
        least = items.doc[sample]
        known = [(key[0].as_py(), 1, b, flags, None) for b, (flags, _) in _answers(replies, 1).items()]
        return _messages(known + [(key[0].as_py(), 2, b, np.stack([name[at], form[at]]).tobytes(), least[at].tobytes()) for b, at in _by_bucket(bucket_of(name, buckets))])

    def answer_forms(key: tuple, table: pa.Table) -> pa.Table:
        """What the names were answered goes on as it is, so that it is worked out once."""
        known, table = (table.filter(pc.equal(table.column("kind"), k)) for k in (1, 2))
        if not table.num_rows:
            return known
        sent = [np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x in table.column("a")]
        name, form = np.concatenate([s[0] for s in sent]), np.concatenate([s[1] for s in sent])
        doc = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("b")])
        order = np.lexsort((doc, form, name))
        new_name = np.concatenate([[True], name[order][1:] != name[order][:-1]])
        new = new_name | np.concatenate([[True], form[order][1:] != form[order][:-1]])
        at, of = np.cumsum(new) - 1, np.cumsum(new_name) - 1
        number = np.bincount(of[new])[of]
        least, route = np.empty(len(doc), np.int64), np.empty(len(doc), np.uint8)
        least[order] = doc[order][new][at]
        route[order] = np.where(number == 1, 0, np.where(number <= hot, 1, 2))
        ends = np.cumsum([s.shape[1] for s in sent])
        found = _messages([(c.as_py(), 2, key[0].as_py(), least[e - s.shape[1] : e].tobytes(), route[e - s.shape[1] : e].tobytes()) for c, s, e in zip(table.column("chunk"), sent, ends, strict=True)])
        return pa.concat_tables([known.select(found.column_names), found])

    def send_texts(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        """To a bucket: lengths, documents, names and bytes of forms (kind 3) or of windows (kind 4)."""
        names = ("chunk", "kind", "bucket", "a", "b", "c", "d")
        if not table.num_rows:
            return _messages([], names)
        items, out = make(table), []
        of, later, form, route, sample = _settled(items, replies)
        own = sample[route == 1]
        for b, at in _by_bucket(items.bucket[own]):
            texts = [items.bytes_of(i) for i in own[at]]
            out.append((key[0].as_py(), 3, b, np.array([len(t) for t in texts], np.int32).tobytes(), items.doc[own[at]].tobytes(), items.name[own[at]].tobytes(), b"".join(texts)))
        row, start, doc, _, bucket, least = _hot_windows(items, of[~later & (route[form] == 2)])
        for b, at in _by_bucket(bucket):
            texts = [items.texts[row[i]][start[i] : start[i] + width] for i in least[at]]
            out.append((key[0].as_py(), 4, b, np.full(len(texts), width, np.int32).tobytes(), doc[least[at]].tobytes(), _hash_texts(texts).tobytes(), b"".join(texts)))
        return _messages(out, names)

    def finish(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        items = make(table)
        of, later, at, route, sample = _settled(items, replies)
        spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(items.row[of[later]], items.start[of[later]], items.stop[of[later]])]
        marks = _marks(replies, 3, items.bucket[sample[route == 1]])
        form_marks = np.zeros(len(sample), np.uint64)
        form_marks[route == 1] = marks
        mine = ~later & (form_marks[at] != 0)
        bits, row, start = form_marks[at[mine]], items.row[of[mine]], items.start[of[mine]]
        for w in range(width - gram + 1):
            hit = (bits >> np.uint64(w)) & np.uint64(1) == 1
            spans.append((row[hit], start[hit] + w, start[hit] + w + 1))
        w_row, w_start, w_doc, where, bucket, least = _hot_windows(items, of[~later & (route[at] == 2)])
        seen = _marks(replies, 4, bucket) != 0
        gone = seen[where] | (w_doc > w_doc[least][where]) if len(where) else np.zeros(0, bool)
        spans.append((w_row[gone], w_start[gone], w_start[gone] + 1))
        rows, starts, stops = (np.concatenate(x) for x in zip(*spans, strict=True))
        order = np.argsort(rows, kind="stable")
        by_row = {r: order[s] for r, s in _by_bucket(rows[order])}
        n_bytes, removed, kept = [], [], []
        for r, text in enumerate(items.texts):
            cover: list[dict] = []
            left = text
            if r in by_row:
                change = np.zeros(len(text) + 1, np.int32)
                np.add.at(change, starts[by_row[r]], 1)
                np.add.at(change, stops[by_row[r]] - 1 + width, -1)
                gone_ = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone_.view(np.int8), [0]])))
                cover = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                left = np.frombuffer(text, np.uint8)[~gone_].tobytes()
            n_bytes.append(len(text))
            removed.append(cover)
            kept.append(left)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = table.select(columns)
        for name, values, kind in (("n_bytes", n_bytes, pa.int64()), ("removed", removed, span), ("kept", kept, pa.binary())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    out_type = T.StructType([*chunked.select(columns).schema.fields, *T._parse_datatype_string(FOUND).fields])
    by_chunk = chunked.groupBy("__chunk")
    names = by_chunk.applyInArrow(ask_names, MESSAGE).groupBy("bucket").applyInArrow(answer_names, MESSAGE)
    forms = by_chunk.cogroup(names.groupBy("chunk")).applyInArrow(ask_forms, MESSAGE).groupBy("bucket").applyInArrow(answer_forms, MESSAGE)
    sent = by_chunk.cogroup(forms.groupBy("chunk")).applyInArrow(send_texts, MESSAGE + ", c binary, d binary")
    laid = sent.groupBy("bucket").applyInArrow(lambda key, table: _lay_out(key[0].as_py(), table, block), "bucket int, share int, text binary, lengths binary, owners binary, head binary, chosen binary")
    sorted_ = laid.select("bucket", "lengths", "head", "chosen", F.expr(f"{sort}(text, lengths, owners, {width})").alias("flags"))
    marks = sorted_.mapInArrow(lambda batches: _sent_back(batches, width), MESSAGE)
    done = by_chunk.cogroup(forms.unionByName(marks).groupBy("chunk")).applyInArrow(finish, out_type)
    blank = F.array().cast("array<struct<start: bigint, end: bigint>>")
    same = lone.select("*", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), blank.alias("removed"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("kept"))
    return done.withColumnRenamed("__own_chunk", "__chunk").select(*every.columns, *ADDED).unionByName(same).coalesce(files)


def _lay_out(bucket: int, table: pa.Table, block: int) -> pa.Table:
    """One text for the suffix array, or several of about `block` bytes dealt by name. The first has the chunks, kinds
    and numbers of what was sent, all have the places in it of what is theirs."""
    lengths, owners, names, data = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), kind) for c, kind in (("a", np.int32), ("b", np.int64), ("c", np.uint64), ("d", np.uint8)))
    number = np.array([len(x.as_py()) // 4 for x in table.column("a")], np.int32)
    head = np.stack([table.column("chunk").to_numpy(), table.column("kind").to_numpy(), number], 1).astype(np.int32).tobytes()
    begin = np.cumsum(lengths, dtype=np.int64) - lengths
    shares = max(1, -(-len(data) // block))
    share = ((mix(names) >> np.uint64(32)) % np.uint64(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    out = []
    for k, at in _by_bucket(share[order]):
        own = order[at]
        size = lengths[own].astype(np.int64)
        text = data[np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())] if shares > 1 else data
        out.append((bucket, k, text.tobytes(), lengths[own].tobytes(), owners[own].tobytes(), b"" if out else head, own.astype(np.int32).tobytes()))
    columns_ = list(zip(*out, strict=True)) if out else [()] * 7
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.table([pa.array(c, k) for c, k in zip(columns_, kinds, strict=True)], names=["bucket", "share", "text", "lengths", "owners", "head", "chosen"])


def _sent_back(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A bucket's texts come one after the other; a row goes back for each that was sent."""
    bucket, head, marks = -1, np.zeros((0, 3), np.int32), np.zeros(0, np.uint64)

    def answers() -> list[pa.RecordBatch]:
        ends = np.cumsum(head[:, 2])
        return _messages([(chunk, kind, bucket, None, marks[e - n : e].tobytes()) for (chunk, kind, n), e in zip(head.tolist(), ends.tolist(), strict=True)]).to_batches()

    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if r["head"]:
                yield from answers()
                bucket, head = r["bucket"], np.frombuffer(r["head"], np.int32).reshape(-1, 3)
                marks = np.zeros(head[:, 2].sum(), np.uint64)
            lengths, flags, chosen = (np.frombuffer(r[c], kind) for c, kind in (("lengths", np.int32), ("flags", np.uint8), ("chosen", np.int32)))
            begin = np.cumsum(lengths, dtype=np.int64) - lengths
            bits = np.zeros(len(lengths), np.uint64)
            for w in range(int(lengths.max()) - width + 1):
                inside = np.flatnonzero(lengths - w >= width)
                bits[inside] |= flags[begin[inside] + w].astype(np.uint64) << np.uint64(w)
            marks[chosen] = bits
    yield from answers()


def _hash_texts(texts: list[bytes]) -> np.ndarray:
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    return Prefix(np.frombuffer(b"".join(texts), np.uint8)).spans(ends - lengths, ends)


def _marks(replies: pa.Table, kind: int, bucket: np.ndarray) -> np.ndarray:
    """The answers to what send_texts() sent, in the same order."""
    out = np.zeros(len(bucket), np.uint64)
    base = dict(_by_bucket(bucket))
    kinds = replies.column("kind").to_numpy()
    for i in np.flatnonzero(kinds == kind):
        out[base[replies.column("bucket")[i].as_py()]] = np.frombuffer(replies.column("b")[i].as_py(), np.uint64)
    return out


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of remove_repeats()."""
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(F.transform("removed", lambda x: x["end"] - x["start"]), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(remove_repeats(docs))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining bytes become the text; a character that lost some of its bytes goes whole. n_chars follows."""
    inner, back = aside(docs, "doc_id", "text", "n_chars")
    left = remove_repeats(inner)
    # try_validate_utf8 gives null where a cut went through a character
    text = F.when(F.is_valid_utf8(F.col("kept").cast("string")), F.col("kept").cast("string")).otherwise(F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit("")))
    return back(left.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")))
