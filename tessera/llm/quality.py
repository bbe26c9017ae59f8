"""Quality classifier: a document's own evidence, shrunk towards what its site and path show.

Evidence. Two heads, low quality and toxic, are fitted on labelled documents: at most `sample` of them, taken by a hash of
doc_id (the documented bound; the rest of this operator covers all rows). Half of the sample finds the words that speak
for a head, by the smoothed log-odds of a document having them or their beginnings; the other half fits a logistic regression on what the words
sum up to and on shape features (letters, capitals, symbols, repeated lines, word lengths and so on). Every text is scored
whole.

Sites. By grouped sums over all documents, a host (`source`) and a path in it (`source`, `lang`) have expected numbers of
bad documents: a label where there is one, else the evidence. A host's rate is shrunk to the global rate, a path's to its
host's, each with the strength of a beta prior whose moments fit the spread between groups; a group of few documents keeps
its parent's rate. A document's own share is taken out of its group first, so a lone document says nothing about itself.
Its log-odds move by the path's log-odds less the global ones, at most by `most_shift`.

A document is kept if neither head reaches one half. Group sums combine before the shuffle; documents meet their group's
row in a join that can split a frequent site.

Nulls: a blank or null text is rejected, as there is nothing to keep. A null source or lang is a group of its own. Labels
with a null are not used; of several labels of a doc_id the highest toxic and lowest quality count. Rows that repeat a
doc_id are judged each by its text; one with a null doc_id has no label and is judged like the others. Without examples of
both classes a head gives its prior, one half of nothing: 0. Empty tables give an empty result, or one without heads. A
text of any length is scored whole, in a task's memory. Other columns, whatever their names, are not read; the stage
keeps them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import cut, frugal, pieces

HEADS = ("low", "toxic")
LETTERS = bytes.maketrans(bytes(range(128)), bytes(c if chr(c).isalpha() else 32 for c in range(128)))
NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
NOT_LETTER = bytes(c for c in range(128) if not chr(c).isalpha())
NOT_SYMBOL = bytes(c for c in range(256) if chr(c) not in "*#$%&|@^~=+<>\\{}[]_")
NOT_MARK = bytes(c for c in range(256) if chr(c) not in ".,;:!?")
STEMS = (6, 7)


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(LETTERS).split()


def terms(split: list[bytes]) -> set[bytes]:
    """Words; the beginnings of longer ones, as inflected forms share them; and the same with a mark where two, three or
    more different words of the text begin so."""
    own = set(split)
    out = set(own)
    for k in STEMS:
        counts = Counter([w[:k] for w in own if len(w) > k])
        for stem, n in counts.items():
            out.add(stem + b"*")
            for least in range(2, min(n, 4) + 1):
                out.add(b"%b*%d" % (stem, least))
    return out


def shape(text: bytes, split: list[bytes]) -> list[float]:
    """Features of a text's form."""
    n, tokens = max(1, len(text)), text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(split))
    count = lambda drop: len(text.translate(None, drop))
    return [
        math.log1p(len(tokens)),
        count(NOT_LETTER) / n,
        count(NOT_CAPITAL) / n,
        count(NOT_DIGIT) / n,
        math.sqrt(count(NOT_SYMBOL) / n),
        count(NOT_MARK) / n,
        len(set(split)) / m,
        len(set(split)) / math.sqrt(m) / 10,
        sum(map(len, tokens)) / max(1, len(tokens)) / 10,
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        text.count(b"!!") / max(1, len(tokens)),
        text.count(b"|") / max(1, len(tokens)),
        text.count(b"http") / max(1, len(tokens)),
    ]


@dataclass
class Model:
    """For each head: weights of words, and mean, scale and weights of the logistic regression, or None."""

    lexicon: dict[str, dict[bytes, float]] = field(default_factory=dict)
    heads: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray] | None] = field(default_factory=dict)

    @cached_property
    def sought(self) -> dict[str, tuple[dict[bytes, float], list[dict[bytes, list[tuple[int, float]]]]]]:
        """By head the weights of whole words, and for each length those of beginnings with the number of words they ask for."""
        out = {}
        for head in HEADS:
            whole: dict[bytes, float] = {}
            begin: list[dict[bytes, list[tuple[int, float]]]] = [{} for _ in STEMS]
            for term, weight in self.lexicon.get(head, {}).items():
                stem, star, least = term.partition(b"*")
                if star:
                    begin[STEMS.index(len(stem))].setdefault(stem, []).append((int(least or 1), weight))
                else:
                    whole[term] = weight
            out[head] = whole, begin
        return out

    def features(self, text: str | None) -> dict[str, list[float]]:
        """Of each head; what the words sum up to is taken from terms() without listing those that no head asks for."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        split = words(raw)
        own, base = set(split), shape(raw, split)
        counts = [Counter([w[:k] for w in own if len(w) > k]) for k in STEMS]
        size = math.sqrt(max(1, len(own) + sum(min(n, 4) for c in counts for n in c.values())))
        out = {}
        for head in HEADS:
            whole, begin = self.sought[head]
            hits = [whole[w] for w in own & whole.keys()]
            for c, stems in zip(counts, begin, strict=True):
                hits += [weight for stem in c.keys() & stems.keys() for least, weight in stems[stem] if c[stem] >= least]
            hits.sort(reverse=True)
            strong = [h for h in hits if h > 0]
            out[head] = [*base, sum(strong) ** 0.5, len(strong), sum(strong[:4]), sum(hits) / size]
        return out

    def logits(self, text: str | None) -> list[float | None]:
        f, out = self.features(text), []
        for head in HEADS:
            fitted = self.heads.get(head)
            if fitted is None:
                out.append(None)
            else:
                mean, scale, w = fitted
                x = np.clip((np.array(f[head]) - mean) / scale, -6, 6)
                out.append(float(np.clip(w[0] + x @ w[1:], -12, 12)))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Standardised features, Newton's method with a ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    design = np.hstack([np.ones((len(z), 1)), z])
    w = np.zeros(design.shape[1])
    hold = np.full(len(w), ridge)
    hold[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(hold), design.T @ (y - p) - hold * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, w


def labelled(labels: DataFrame) -> DataFrame:
    """One row for each doc_id: low and toxic, 0 or 1."""
    fine = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return fine.groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, surprise: float = 4.0) -> Model:
    """docs(doc_id, text, ...), labels(doc_id, quality, toxic) -> the model. `sample`, the most labelled documents it is
    fitted on, also bounds what comes to the driver: the words of half of them that tell the classes apart, the features of the other half."""
    known = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    of = {r.doc_id: (r.low, r.toxic) for r in known}
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i, rank % 2, *v) for rank, (i, v) in enumerate(of.items())], "doc_id long, fold int, low int, toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each kind by word, added up for a batch."""
        for batch in batches:
            counts: dict[bytes, list[int]] = {}
            low, toxic = batch.column("low").to_pylist(), batch.column("toxic").to_pylist()
            for i, text in enumerate(batch.column("text")):
                for w in terms(words(text.as_py().encode("utf-8", "surrogatepass"))):
                    c = counts.setdefault(w, [0, 0, 0])
                    c[0] += 1
                    c[1] += low[i]
                    c[2] += toxic[i]
            yield pa.record_batch([pa.array(list(counts), pa.binary()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(3))], names=["word", "n", "low", "toxic"])

    half = [v for rank, v in enumerate(of.values()) if rank % 2 == 0]
    model = Model()
    by_word = cut(texts.where("fold = 0").select("text", "low", "toxic").mapInArrow(frugal(split), "word binary, n long, low long, toxic long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "low", "toxic"))), pieces(docs))
    for k, head in enumerate(HEADS):
        bad = sum(v[k] for v in half)
        good = len(half) - bad
        if not bad or not good:
            continue
        p, q = (F.col(head) + 0.5) / (bad + 1.0), (F.col("n") - F.col(head) + 0.5) / (good + 1.0)
        odds = F.log(p / q)
        z = odds / F.sqrt(1 / (F.col(head) + 0.5) + 1 / (F.col("n") - F.col(head) + 0.5))
        rows = by_word.select("word", odds.alias("odds"), z.alias("z")).where(F.abs("z") > surprise).collect()
        model.lexicon[head] = {bytes(r.word): r.odds for r in rows}

    sent = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.features(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("low"), batch.column("toxic"), *(pa.array([f[h] for f in found], pa.list_(pa.float64())) for h in HEADS)], names=["low", "toxic", "x_low", "x_toxic"])

    rows = texts.where("fold = 1").select("text", "low", "toxic").mapInArrow(frugal(features), "low int, toxic int, x_low array<double>, x_toxic array<double>").collect()
    for head in HEADS:
        y = np.array([r[head] for r in rows], np.float64)
        model.heads[head] = fit_logistic(np.array([r[f"x_{head}"] for r in rows]), y) if 0 < y.sum() < len(y) else None
    return model


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, mark (of the text), host, path, blank, e_low, e_toxic (log-odds)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.logits(t.as_py()) for t in batch.column("text")]
            blank = [not (t.as_py() or "").strip() for t in batch.column("text")]
            own = [batch.column(c) for c in ("doc_id", "mark", "host", "path")]
            yield pa.record_batch([*own, pa.array(blank), *(pa.array([f[k] for f in found], pa.float64()) for k in range(2))], names=["doc_id", "mark", "host", "path", "blank", "e_low", "e_toxic"])

    base = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.coalesce(F.col("source"), F.lit("\0")).alias("host"), F.coalesce(F.col("lang"), F.lit("\0")).alias("path"), "text")
    return base.mapInArrow(frugal(run), "doc_id long, mark long, host string, path string, blank boolean, e_low double, e_toxic double")


def _strength(groups: DataFrame, head: str, parent: str) -> float:
    """Prior strength of a beta distribution of the groups' rates around their parents' (method of moments)."""
    n, rate = F.col("n"), F.col(f"k_{head}") / F.col("n")
    mean = F.col(parent)
    got = groups.where("n > 1").agg(F.sum(n * (rate - mean) ** 2).alias("s"), F.sum(n).alias("n"), F.count("*").alias("g"), F.avg(mean * (1 - mean)).alias("v")).first()
    if not got.g or not got.v or not got.n:
        return 1e6
    within = got.v * got.g / got.n  # what rates of such groups vary by chance
    between = got.s / got.n - within
    return float(min(1e6, max(1.0, got.v / between - 1))) if between > 0 else 1e6


def classify(docs: DataFrame, labels: DataFrame, model: Model, most_shift: float = 2.0) -> DataFrame:
    """docs -> doc_id, mark, p_low, p_toxic, site_low, site_toxic (the path's rates), kept."""
    p = lambda e: 1 / (1 + F.exp(-F.col(e)))
    known = labelled(labels).select("doc_id", F.col("low").alias("l_low"), F.col("toxic").alias("l_toxic"))
    own = evidence(docs, model).join(known, "doc_id", "left")
    for h in HEADS:
        own = own.withColumn(f"k_{h}", F.coalesce(F.col(f"l_{h}").cast("double"), p(f"e_{h}"), F.lit(0.0)))
    files = pieces(docs)
    own = cut(own.drop("l_low", "l_toxic"), files)
    sums = [F.count("*").alias("n"), *(F.sum(f"k_{h}").alias(f"k_{h}") for h in HEADS)]
    paths = own.groupBy("host", "path").agg(*sums)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(f"k_{h}").alias(f"k_{h}") for h in HEADS))
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"k_{h}").alias(f"k_{h}") for h in HEADS)).first()
    n = total.n or 1
    rate = {h: min(max((total[f"k_{h}"] or 0.0) / n, 1e-6), 1 - 1e-6) for h in HEADS}
    for h in HEADS:
        hosts = hosts.withColumn(f"g_{h}", F.lit(rate[h]))
    strong = {h: _strength(hosts, h, f"g_{h}") for h in HEADS}
    for h in HEADS:
        hosts = hosts.withColumn(f"r_{h}", (F.col(f"k_{h}") + strong[h] * rate[h]) / (F.col("n") + strong[h]))
    paths = cut(paths.join(hosts.select("host", "r_low", "r_toxic"), "host"), files)
    fine = {h: _strength(paths, h, f"r_{h}") for h in HEADS}
    at = paths.select("host", "path", F.col("n").alias("g_n"), *(F.col(f"k_{h}").alias(f"g_{h}") for h in HEADS), "r_low", "r_toxic")
    out = own.join(at, ["host", "path"])
    logit = lambda c: F.log(c / (1 - c))
    for h in HEADS:
        site = (F.greatest(F.col(f"g_{h}") - F.col(f"k_{h}"), F.lit(0.0)) + fine[h] * F.col(f"r_{h}")) / (F.col("g_n") - 1 + fine[h])
        site = F.least(F.greatest(site, F.lit(1e-6)), F.lit(1 - 1e-6))
        shift = F.least(F.greatest(logit(site) - math.log(rate[h] / (1 - rate[h])), F.lit(-most_shift)), F.lit(most_shift))
        out = out.withColumn(f"site_{h}", site).withColumn(f"p_{h}", F.coalesce(1 / (1 + F.exp(-(F.col(f"e_{h}") + shift))), F.lit(0.0)))
    kept = ~F.col("blank") & (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5)
    return out.select("doc_id", "mark", "p_low", "p_toxic", "site_low", "site_toxic", kept.alias("kept")).coalesce(files)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = classify(docs, labels, fit(docs, labels))
    return found.select("doc_id", "p_low", "p_toxic", "site_low", "site_toxic", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = classify(docs, labels, fit(docs, labels)).where("not kept").select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__mark")), "left_anti").coalesce(pieces(docs))
