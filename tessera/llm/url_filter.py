"""URL filter by a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give a URL's length-normalised
log-likelihood difference; a logistic curve fitted on URLs held out from both turns it into the probability of rejection.
Orders 0 to `order` are interpolated as Witten and Bell do: a context lends the shorter one as much weight as it has
different successors. Host rules take precedence over the models, and the rows that rules decide are what the models learn
from: all of them, each as often as it occurs, whatever its length. Only the curve is fitted on a bounded sample, at most
`sample` URLs of each verdict by hash out of a fifth that the models leave out for it; afterwards they count that fifth too.

A byte's probability depends on its window, the byte and the `order` before it, which is one exact 64-bit number. Windows
are counted by sums that combine before the shuffle, and their suffixes' counts are added up from them. URLs are judged in
blocks: each block asks for its different windows once, which are joined to the counts, so neither the driver nor an
executor holds a table that grows with the input, and a window that stands in every URL is moved once for each block.

Without a rule, a null or empty URL is allowed. Where one of the two verdicts has no example, rules alone decide and every
other URL is allowed. Repeated rows each get their verdict; an empty table gives an empty one. A URL of any length is one
row of a block and lies whole in a task's memory, with some 100 bytes for each of its own. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import mix
from ._session import cut, frugal, pieces

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict) of callers that give none.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "block"), ("org/es/", "allow"))
#: (rule, verdict) of the registered query, as its contract has them.
CONTRACT = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Bits of one place of a window: 0 none, 1 to 256 a byte, 257 what stands before a URL.
PLACE = 9
#: Most rows and, beyond one URL, bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 22


def host_of(url: Column) -> Column:
    """What stands behind the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands behind the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct<rule, verdict> of the longest rule that fits: its host is the URL's or one of its parents, its path begins
    the URL's. Null where none fits. Of two equally long ones the first in order of text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Markov:
    """Interpolated character model of a list in memory, in tables of 2**bits counts for each order. The filter counts
    by joins instead, without a table of a fixed size."""

    def __init__(self, order: int = 5, bits: int = 17):
        self.order, self.mask = order, np.uint64((1 << bits) - 1)
        self.gram = np.zeros((order + 1, 1 << bits), np.float32)
        self.context = np.zeros((order + 1, 1 << bits), np.float32)
        self.kinds = np.zeros((order + 1, 1 << bits), np.float32)

    def _slots(self, data: np.ndarray, begins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By order, the slots of each byte's context and of the context with the byte. A context stops at its URL's
        start, which is marked."""
        n = len(data)
        place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        context, out = np.full(n, 7, np.uint64), []
        for k in range(self.order + 1):
            if k:
                back = np.zeros(n, np.uint64)
                back[k:] = data[:-k].astype(np.uint64) + np.uint64(1)
                back[place < k] = 257
                context = mix(context * np.uint64(1_000_003) + back)
            out.append((context & self.mask, mix(context ^ mix(data.astype(np.uint64) + np.uint64(99))) & self.mask))
        return out

    def learn(self, urls: list[bytes]) -> "Markov":
        data, begins = _joined(urls)
        for k, (context, gram) in enumerate(self._slots(data, begins)):
            size = self.gram.shape[1]
            self.context[k] += np.bincount(context.astype(np.int64), minlength=size)
            self.gram[k] += np.bincount(gram.astype(np.int64), minlength=size)
            pairs = np.unique(np.stack([context, gram], 1), axis=0)
            self.kinds[k] += np.bincount(pairs[:, 0].astype(np.int64), minlength=size)
        return self

    def score(self, urls: list[bytes]) -> np.ndarray:
        """Sum of the log probabilities of each URL's bytes."""
        data, begins = _joined(urls)
        p = np.full(len(data), 1 / 257)
        for k, (context, gram) in enumerate(self._slots(data, begins)):
            total, kinds = self.context[k][context], self.kinds[k][context]
            known = total > 0
            p = np.where(known, (self.gram[k][gram] + kinds * p) / np.where(known, total + kinds, 1), p)
        logs = np.concatenate([[0.0], np.cumsum(np.log(np.minimum(p, 1.0)))])
        return logs[np.append(begins[1:], len(data))] - logs[begins]


def _joined(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all URLs, each closed by a 0, and where each begins."""
    lengths = np.array([len(u) + 1 for u in urls], np.int64)
    return np.frombuffer(b"".join(u + b"\0" for u in urls), np.uint8), np.cumsum(lengths) - lengths


def windows(urls: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and each URL's end the number of its window, its own place lowest, and where each URL begins."""
    data, begins = _joined(urls)
    place = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    out = data.astype(np.int64) + 1
    for k in range(1, order + 1):
        back = np.full(len(data), 257, np.int64)
        back[k:] = data[:-k].astype(np.int64) + 1
        back[place < k] = 257
        out |= back << (PLACE * k)
    return out, begins


def _bytes(column: pa.Array) -> list[bytes | None]:
    return [u.encode("utf-8", "surrogatepass") if isinstance(u, str) else u for u in column.to_pylist()]


def _runs(urls: list[bytes]) -> Iterator[slice]:
    """Slices of at most BLOCK_ROWS URLs and BLOCK_BYTES bytes, or one URL."""
    start, size = 0, 0
    for i, u in enumerate(urls):
        if i > start and (i - start == BLOCK_ROWS or size + len(u or b"") > BLOCK_BYTES):
            yield slice(start, i)
            start, size = i, 0
        size += len(u or b"")
    if urls:
        yield slice(start, len(urls))


def count_windows(known: DataFrame, order: int) -> DataFrame:
    """known(url, block, held) -> window with the rows' counts: allow, block, and of those held out allow_held, block_held."""
    names = ["allow", "block", "allow_held", "block_held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = _bytes(batch.column("url"))
            kind = np.array(batch.column("block").to_pylist(), np.int64) + 2 * np.array(batch.column("held").to_pylist(), np.int64)
            for part in _runs(urls):
                found, begins = windows(urls[part], order)
                which = np.repeat(kind[part], np.diff(np.append(begins, len(found))))
                each, at = np.unique(found, return_inverse=True)
                counts = np.bincount(at * 4 + which, minlength=4 * len(each)).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(each), *(pa.array(counts[:, i].astype(np.int64)) for i in range(4))], ["window", *names])

    counted = known.select("url", "block", "held").mapInArrow(frugal(run), "window long, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("window").agg(*(F.sum(n).alias(n) for n in names))


@dataclass
class Filter:
    """counts(window, allow, block) and the curve."""

    counts: DataFrame
    order: int
    slope: float = 1.0
    shift: float = 0.0

    def _suffixes(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Each window's gram of every order k, and the gram without its last byte."""
        wide = rows.select("window", *columns, F.explode(F.sequence(F.lit(0), F.lit(self.order))).alias("k"))
        gram = wide.withColumn("gram", F.expr(f"window & (shiftleft(1L, {PLACE} * (k + 1)) - 1)"))
        return gram.withColumn("context", F.shiftright("gram", PLACE))

    def differences(self, asked: DataFrame) -> DataFrame:
        """asked(window), distinct -> (window, d): log probability of its byte, rejected less accepted."""
        grams = self._suffixes(self.counts, "allow", "block").groupBy("k", "gram", "context").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        sums = [f(v).alias(f"{n}_{v}") for v in ("allow", "block") for n, f in (("total", F.sum), ("kinds", lambda v: F.count_if(F.col(v) > 0)))]
        contexts = grams.groupBy("k", "context").agg(*sums)
        need, met = self._suffixes(asked), None
        # a context of one byte or none belongs to many windows, but there are at most 259 of them
        for part, few in (("k <= 1", F.broadcast), ("k > 1", lambda d: d)):
            rows = need.where(part).join(grams.drop("context").where(part), ["k", "gram"], "left").join(few(contexts.where(part)), ["k", "context"], "left")
            met = rows if met is None else met.unionByName(rows)
        steps = F.array_sort(F.collect_list(F.struct("k", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for v in ("allow", "block") for c in (v, f"total_{v}", f"kinds_{v}")))))

        def log(v: str) -> Column:
            step = lambda p, s: F.when(s[f"total_{v}"] > 0, (s[v] + s[f"kinds_{v}"] * p) / (s[f"total_{v}"] + s[f"kinds_{v}"])).otherwise(p)
            return F.log(F.aggregate("steps", F.lit(1 / 257), step))

        return met.groupBy("window").agg(steps.alias("steps")).select("window", (log("block") - log("allow")).alias("d"))

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows(url, ...) and p_reject, null where the url is; ratio is the mean of d over the URL's bytes and its end."""
        order, schema = self.order, T.StructType([*rows.schema.fields, T.StructField("part", T.LongType())])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId() << 40
            for batch in batches:
                for run in _runs(_bytes(batch.column("url"))):
                    some = batch.slice(run.start, run.stop - run.start)
                    yield some.append_column("part", pa.array(np.full(some.num_rows, part)))
                    part += 1

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                urls, parts = _bytes(batch.column("url")), np.array(batch.column("part"))
                edges = np.flatnonzero(np.diff(parts, prepend=-1))
                for start, stop in zip(edges, np.append(edges[1:], len(parts)), strict=True):
                    found = np.unique(windows([u for u in urls[start:stop] if u is not None], order)[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), parts[start])), pa.array(found)], ["part", "window"])

        def add(mine: pa.Table, known: pa.Table) -> pa.Table:
            urls, ratio = _bytes(mine.column("url")), np.full(mine.num_rows, np.nan)
            if some := [i for i, u in enumerate(urls) if u is not None]:
                keys, d = known.column("window").to_numpy(), known.column("d").to_numpy()
                sort = np.argsort(keys)
                for run in _runs([urls[i] for i in some]):
                    found, begins = windows([urls[i] for i in some[run]], order)
                    each = d[sort][np.searchsorted(keys[sort], found)]
                    ratio[some[run]] = np.add.reduceat(each, begins) / np.diff(np.append(begins, len(found)))
            return mine.append_column("ratio", pa.array(ratio, mask=np.isnan(ratio)))

        dealt = cut(rows.mapInArrow(frugal(deal), schema), pieces(rows))
        asked = dealt.select("url", "part").mapInArrow(frugal(ask), "part long, window long")
        known = asked.join(self.differences(asked.select("window").distinct()), "window").select("part", "window", "d")
        out = dealt.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(add, T.StructType([*schema.fields, T.StructField("ratio", T.DoubleType())]))
        bent = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), self.slope * F.col("ratio") + self.shift))
        return out.drop("part").withColumn("p_reject", F.when(F.col("ratio").isNotNull(), 1 / (1 + F.exp(-bent))))

    def probability(self, urls: list[bytes]) -> np.ndarray:
        """Of a list that the driver holds."""
        rows = self.counts.sparkSession.createDataFrame(list(enumerate(urls)), "at long, url binary")
        return np.array([r.p_reject for r in self.scored(rows).orderBy("at").select("p_reject").collect()])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-3) -> tuple[float, float]:
    """slope and shift by Newton's method with a slight ridge, classes of equal weight."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    design, b = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (w * (y - p)) - ridge * b
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        b = b + np.linalg.solve(hess, grad)
    return float(b[0]), float(b[1])


def fit(urls: DataFrame, rules=RULES, sample: int = 8192, order: int = 5) -> Filter | None:
    """urls(url) -> the filter, from all rows that a rule decides. A fifth by hash is left out while the curve is fitted on
    at most `sample` of its URLs of each verdict; a verdict without rows in that fifth or outside it is fitted on its own."""
    verdict = rule_for(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    known = urls.select("url", verdict.alias("verdict")).where("verdict is not null")
    known = known.select("url", (F.col("verdict") == "block").alias("block"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held"))
    counts = cut(count_windows(known, order), pieces(urls))
    seen = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns[1:])).first()
    if not (seen.allow + seen.allow_held and seen.block + seen.block_held):
        return None
    split = {v: bool(seen[v] and seen[f"{v}_held"]) for v in ("allow", "block")}
    whole = {v: (F.col(v) + F.col(f"{v}_held")).alias(v) for v in split}
    tried = Filter(counts.select("window", *(F.col(v) if split[v] else whole[v] for v in split)), order)
    picks = None
    for v in split:
        side = known.where(F.col("block") == (v == "block")).where(F.col("held") if split[v] else F.lit(True))
        pick = side.select("url", "block").distinct().orderBy(F.xxhash64("url"), "url").limit(sample)
        picks = pick if picks is None else picks.unionByName(pick)
    rows = tried.scored(picks).select("ratio", "block").collect()
    rows.sort(key=lambda r: (r.block, r.ratio))
    slope, shift = logistic(np.array([r.ratio for r in rows]), np.array([float(r.block) for r in rows]))
    return Filter(counts.select("window", *whole.values()), order, slope, shift)


def judge(pages: DataFrame, rules=RULES, model: Filter | None = None, reject_from: float = 0.5) -> DataFrame:
    """pages(page_id, url, ...) -> page_id, host, path, rule, verdict, p_reject (null where there was no model or URL)."""
    url = F.col("url")
    base = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules)).withColumn("url", F.when(url != "", url))
    scored = base.withColumn("p_reject", F.lit(None).cast("double")) if model is None else model.scored(base)
    by_model = F.when(F.col("p_reject") >= reject_from, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", by_model).alias("verdict"), "p_reject")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, CONTRACT, fit(pages, CONTRACT))
