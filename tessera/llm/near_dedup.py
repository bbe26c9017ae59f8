"""Near-duplicate groups by MinHash.

Documents with equal sets of word shingles form a class, kept by its smallest document. A class has `hashes` minima of
universal hashes; the first `bands * rows` place it in a bucket for each band, four bits of all of them are its sketch. A
bucket's pairs are not listed. First every member is tested against one pivot of its buckets, by sketch and then by the
full sets, and linked ones are joined into components (large-star and small-star). Members that share a component need no
further test. In the buckets that still hold several components, members are compared by sketch within the task that has
them, a large bucket's in blocks, and each names its closest partner in another component, which is confirmed. What then
still has a partner whose size and sketch allow a link sends its full set there, once for each such bucket and pair of blocks; the task
counts all common shingles exactly, by products of matrices, and gives no more links than join the components. What leaves
a task is thus at most one row for each member, never the pairs, and in the end no two members of any bucket that have a
link lie in different components.

With 36 bands of 4 rows a pair at the threshold of 0.75 meets in no bucket with a chance of 1.1e-6; the sketch's limit
lies five standard deviations under the threshold. Links are confirmed on full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import Prefix, mix
from ._components import components
from ._session import cut, frugal, pieces

SIGNED = "doc_id long, n_shingles long, class binary, bands array<long>, sketch binary"
GROUP = ("bucket", "i", "j")
CLOSE = "bucket long, i int, j int, own int, id long, label long, size long, best long"
#: Members of a block, shingles of a block, shingles taken into one product.
BLOCK, HASHES, SPAN = 512, 1 << 21, 8192
SIEVE = 1 << 23
#: Of a byte's two halves, how many are zero.
ZERO_HALVES = np.array([(not x & 15) + (not x >> 4) for x in range(256)], np.uint8)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words, A-Z lower-cased; of all words where there are fewer."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    begin = np.cumsum(sizes + 1) - sizes - 1
    k = min(words, len(split))
    n = len(split) - k + 1
    return np.unique(Prefix(np.frombuffer(b" ".join(split), np.uint8)).spans(begin[:n], begin[k - 1 :] + sizes[k - 1 :]))


def family(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """a, b of the hashes a * x + b modulo 2**32, a odd."""
    a, b = np.random.default_rng(seed).integers(0, 1 << 32, (2, 1, size), np.uint32)
    return a | np.uint32(1), b


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash over the high halves, in slices that fit into a processor's cache."""
    high = (values >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(a.shape[1], np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), 256):
        part = high[at : at + 256] * a
        part += b
        np.minimum(least, part.min(axis=0), out=least)
    return least.astype(np.uint64)


def sketched(least: np.ndarray) -> bytes:
    """Four bits of each minimum."""
    half = (mix(least) >> np.uint64(60)).astype(np.uint8)
    return (half[::2] | half[1::2] << 4).tobytes()


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places sketches agree, along the last axis."""
    return ZERO_HALVES[x ^ y].sum(axis=-1, dtype=np.int32)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signed(docs: DataFrame, words: int, bands: int, rows: int, hashes: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = family(hashes, seed)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in _slices(batches):
            count, key, band, sketch = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py(), words)
                count.append(len(own))
                if not len(own):
                    key.append(None), band.append(None), sketch.append(None)
                    continue
                least = minima(own, a, b)
                value = salt.copy()
                for r in range(rows):
                    value = mix(value ^ least[: bands * rows].reshape(bands, rows)[:, r])
                key.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                band.append(value.view(np.int64))
                sketch.append(sketched(least) + (value >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(count, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "class", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), SIGNED)


def of_members(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Different rows of docs(doc_id, text) with an id in ids(id), which are distinct. A bitmap of SIEVE bits, at most SIEVE / 64 rows however many ids
    there are, goes to the scan and keeps most other texts out of the shuffle; the join behind it is exact."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    word, bit = (lambda c: F.shiftright(place(c), 6)), (lambda c: place(c).bitwiseAND(F.lit(63)).cast("int"))
    sieve = ids.groupBy(word("id").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit("id"))).alias("bits"))
    near = docs.withColumn("word", word("doc_id")).join(F.broadcast(sieve), "word").where(F.call_function("shiftrightunsigned", F.col("bits"), bit("doc_id")).bitwiseAND(F.lit(1)) == 1)
    # inner, as a semi join would be moved to the scan, in front of the bitmap; ids are distinct
    rows = near.select("doc_id", "text").join(ids.select(F.col("id").alias("doc_id")), "doc_id")
    # repeated rows once; this needs no further shuffle
    return rows.groupBy("doc_id", F.xxhash64("text").alias("mark")).agg(F.first("text").alias("text")).select("doc_id", "text")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """docs(doc_id, text) -> id, set (hashes in order), short (their last 16 bits in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            values = [shingles(t.as_py(), words) for t in batch.column(1)]
            short = [np.sort(v.astype(np.uint16)).tobytes() for v in values]
            yield pa.record_batch([batch.column(0), pa.array([v.tobytes() for v in values], pa.binary()), pa.array(short, pa.binary())], names=["id", "set", "short"])

    return docs.mapInArrow(frugal(run), "id long, set binary, short binary")


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted arrays share, repeated ones as often as both have them."""
    v, n = np.unique(x, return_counts=True)
    w, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(v, w, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs(u, v, xu, xv) with short sets those that may have a link: shortening never lowers what is in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint16), np.frombuffer(y.as_py(), np.uint16)
                both = in_common(x, y)
                yes.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return pairs.select("u", "v", "xu", "xv").mapInArrow(frugal(run), "u long, v long")


def close_sketches(pairs: DataFrame, least: int, width: int) -> DataFrame:
    """Of pairs(u, v, su, sv) those whose sketches agree in at least `least` places; u and v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            su, sv = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(agreeing(su[:, :width], sv[:, :width]) >= least))

    return pairs.select("u", "v", "su", "sv").mapInArrow(frugal(run), "u long, v long")


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of sorted batches, one by one."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        key = np.stack([t.column(c).to_numpy() for c in keys])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
        for begin, end in zip(edges, edges[1:], strict=False):
            part = t.slice(begin, end - begin)
            if held and not all(held[0].column(c)[0] == part.column(c)[0] for c in keys):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def open_members(members: DataFrame, sketch: DataFrame, labels: DataFrame, files: int) -> DataFrame:
    """Rows (bucket, i, j, own, id, label, size, sketch) of the buckets whose members have several labels, dealt to pairs of
    blocks (i, j) of at most about BLOCK members and HASHES shingles; own is the member's block."""
    placed = cut(members.select("bucket", "id").join(sketch.select("id", "size"), "id").join(labels, "id", "left").select("bucket", "id", "size", F.coalesce("label", "id").alias("label")), files)
    sums = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("label").alias("a"), F.max("label").alias("z"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / HASHES)).cast("int")
    several = cut(sums.where("a <> z").select("bucket", blocks.alias("blocks")), files)
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"), mine.alias("own")))
    return placed.join(several, "bucket").join(sketch.select("id", "sketch"), "id").select("bucket", "id", "label", "size", "sketch", F.explode(meets).alias("m")).select("bucket", "m.*", "id", "label", "size", "sketch")


def close_members(dealt: DataFrame, percent: int, least: int, width: int) -> DataFrame:
    """Of open_members() those with a partner in their pair of blocks whose label differs and whose size and sketch allow a
    link: at most one row for each row that comes in. best is the partner whose sketch agrees most, null for members with
    the group's most frequent label, as each pair has a member with another one. Behind its `width` bytes a sketch has
    half of the name of each of the member's buckets: a pair counts in the first bucket that both are in."""

    def one(t: pa.Table) -> pa.RecordBatch | None:
        ids, label, size, own = (t.column(c).to_numpy() for c in ("id", "label", "size", "own"))
        kinds, at, count = np.unique(label, return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            return None
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        tags, sketch = np.ascontiguousarray(sketch[:, width:]).view(np.uint32), sketch[:, :width]
        here = np.uint32(t.column("bucket")[0].as_py() >> 32 & 0xFFFFFFFF)
        first, second = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = (np.flatnonzero(own == k) for k in (first, second))
        most, best = np.zeros(len(ids), np.int32), np.full(len(ids), -1, np.int64)
        for x in left:
            y = right if first != second else right[ids[right] > ids[x]]
            y = y[(label[y] != label[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
            alike = agreeing(sketch[x], sketch[y]) if len(y) else np.zeros(0, np.int32)
            y, alike = y[alike >= least], alike[alike >= least]
            if not len(y):
                continue
            same = tags[x][(tags[y] == tags[x]).argmax(axis=1)] == here
            y, alike = y[same], alike[same]
            if len(y):
                more = alike > most[y]
                most[y[more]], best[y[more]] = alike[more], x
                k = alike.argmax()
                if alike[k] > most[x]:
                    most[x], best[x] = alike[k], y[k]
        chosen = np.flatnonzero(best >= 0)
        if not len(chosen):
            return None
        kept = t.select(["bucket", "i", "j", "own", "id", "label", "size"]).take(pa.array(chosen))
        partner = pa.array(ids[best[chosen]], pa.int64(), mask=at[chosen] == count.argmax())
        return kept.append_column("best", partner).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, GROUP):
            if (out := one(group)) is not None:
                yield out

    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(frugal(run), CLOSE)


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """[left, right] number of elements in common, by products of 0/1 matrices over SPAN of the elements at a time."""
    sizes = np.array([len(s) for s in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, kept = np.repeat(np.arange(len(sets)), sizes), count[at] > 1
    row, column = row[kept], (np.cumsum(count > 1) - 1)[at[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.int64)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, SPAN):
        some = slice(*np.searchsorted(column, [begin, begin + SPAN]))
        has = np.zeros((len(sets), SPAN), np.float32)
        has[row[some], column[some] - begin] = 1
        both += (has[left] @ has[right].T).astype(np.int64)
    return both


def exact_links(close: DataFrame, percent: int) -> DataFrame:
    """close(bucket, i, j, own, id, label, size, set) -> u, v: of each group as many links as join what all of its links
    between different labels would join."""

    def one(t: pa.Table) -> tuple[list[int], list[int]]:
        ids, label, size, own = (t.column(c).to_numpy() for c in ("id", "label", "size", "own"))
        first, second = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = (np.flatnonzero(own == k) for k in (first, second))
        us, vs = [], []
        if not len(left) or not len(right):
            return us, vs
        both = shared_counts([np.frombuffer(s.as_py(), np.uint64) for s in t.column("set")], left, right)
        link = (100 * both >= percent * (size[left][:, None] + size[right][None] - both)) & (both > 0)
        part = np.unique(label, return_inverse=True)[1]
        for k in np.flatnonzero((link & (part[left][:, None] != part[right][None])).any(axis=1)):
            x, partners = left[k], right[link[k]]
            for other, y in zip(*np.unique(part[partners], return_index=True), strict=True):
                if other != part[x]:
                    us.append(min(ids[x], ids[partners[y]]))
                    vs.append(max(ids[x], ids[partners[y]]))
                    part[part == other] = part[x]
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, GROUP):
            us, vs = one(group)
            if us:
                yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return close.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(frugal(run), "u long, v long")


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs(u, v, xu, xv) those with 100 * intersection >= percent * union; u and v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    yes.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return pairs.select("u", "v", "xu", "xv").mapInArrow(frugal(run), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 36, rows: int = 4, hashes: int = 512, seed: int = 5) -> DataFrame:
    """docs(doc_id long, text string, ...) -> (doc_id, n_shingles, component_id, kept), one row for each row of docs.

    component_id is the smallest doc_id that links reach, kept whether that is the document itself. A null or blank text
    has no shingles and links with nothing. Rows that repeat a doc_id are one document for the links: what links with
    one of them links with all. A row with a null doc_id has no component and is kept. An empty table gives an empty one.
    A text of any length is one document; its set lies whole in a task's memory (8 bytes a word). Other columns, whatever
    their names, are not read.
    """
    if hashes < bands * rows or hashes % 2:
        raise ValueError("hashes must be even and at least bands * rows")
    p = percent / 100 + (1 - percent / 100) / 16
    limit = int(hashes * (p - 5 * (p * (1 - p) / hashes) ** 0.5))
    files = pieces(docs)
    one = cut(signed(docs, words, bands, rows, hashes, seed), files)
    full = one.where("n_shingles > 0 and doc_id is not null")
    classes = cut(full.groupBy("class").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("size"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch")), files)
    placed = classes.select("id", F.explode("bands").alias("bucket"))
    shared = cut(placed.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("z")).where("pivot <> z").select("bucket", "pivot"), files)
    members = cut(placed.join(shared, "bucket"), files)
    sketch = classes.select("id", "size", "sketch")
    texts = of_members(docs.select(F.col("doc_id").cast("long"), "text"), members.select("id").distinct())
    sets = cut(sets_of(texts, words), files)

    def confirm(close: DataFrame) -> DataFrame:
        """Distinct pairs(u, v) of classes -> the links among them."""
        side = lambda c, name: sets.select(F.col("id").alias(name), F.col(c).alias("x" + name))
        maybe = possible(close.join(side("short", "v"), "v").join(side("short", "u"), "u"), percent)
        return linked(maybe.join(side("set", "v"), "v").join(side("set", "u"), "u"), percent)

    # rows that repeat a doc_id with other words: links of their classes
    repeats = full.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z").select("doc_id")
    same = full.join(repeats, "doc_id").select("doc_id", "class").join(classes.select("class", "id"), "class").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    tested = members.where("id <> pivot").groupBy(F.col("id").alias("v")).agg(F.min("pivot").alias("u"))
    su, sv = (sketch.select(F.col("id").alias(c), F.col("sketch").alias("s" + c)) for c in "uv")
    width = hashes // 2
    links = cut(confirm(close_sketches(tested.join(su, "u").join(sv, "v"), limit, width)).unionByName(same), files)
    labels = cut(components(links), files)
    # each open member's closest partner
    close = close_members(open_members(members, sketch, labels, files), percent, limit, width).where("best is not null")
    links = cut(links.unionByName(confirm(cut(close.select(F.least("id", "best").alias("u"), F.greatest("id", "best").alias("v")).distinct(), files))), files)
    labels = cut(components(links), files)
    # what still has an untested partner, by full sets inside the tasks
    close = cut(close_members(open_members(members, sketch, labels, files), percent, limit, width).drop("best"), files)
    found = cut(exact_links(close.join(sets.select("id", "set"), "id"), percent), files)
    if not found.isEmpty():
        labels = cut(components(links.unionByName(found)), files)
    at = classes.select("class", "id").join(labels, "id", "left").select("class", F.coalesce("label", "id").alias("component_id"))
    out = one.select("doc_id", "n_shingles", "class").join(at, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.coalesce(files).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, stays."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns).coalesce(pieces(docs))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 75 * (a.n + b.n - i)),
g AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, g.v FROM r JOIN g ON r.b = g.u),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN c ON a = doc_id
"""
