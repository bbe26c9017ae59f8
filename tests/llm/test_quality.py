import math
import random

import numpy as np

from tessera.llm import quality as q


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0")
    learn = labels.where("doc_id % 3 <> 0")
    found = q.classify(docs, learn, q.fit(docs, learn))
    rows = found.join(held, "doc_id").collect()
    low = np.array([r.quality == 0 for r in rows])
    toxic = np.array([r.toxic == 1 for r in rows])
    kept = np.array([r.kept for r in rows])
    print("toxic caught", 1 - kept[toxic].mean(), "low caught", 1 - kept[low].mean(), "clean kept", kept[~low & ~toxic].mean(), len(rows))
    assert 1 - kept[toxic].mean() > 0.88 and kept[~low & ~toxic].mean() > 0.97 and 1 - kept[low].mean() > 0.85


def test_sites_are_shrunk(spark):
    model = q.Model({}, {"low": (np.zeros(19), np.ones(19), np.zeros(20)), "toxic": None})
    rows = [(i, f"some text {i}", "en", "bad" if i < 40 else f"good{i % 8}", 5) for i in range(360)] + [(999, "some text", "en", "lone", 5), (1000, None, None, None, None), (1001, "  ", "fr", "lone", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(360)] + [(1, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in q.classify(docs, labels, model).collect()}
    assert got[0].site_low > 0.9 and not got[0].kept and got[300].site_low < 0.05 and got[300].kept
    assert 0.05 < got[999].site_low < 0.5 and not got[1000].kept and not got[1001].kept and got[300].p_toxic == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (1, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = q.fit(docs, labels)
    assert sorted(r.kept for r in q.classify(docs, labels, model).collect()) == [False, True]
    assert q.classify(docs.limit(0), labels, model).count() == 0


def corpus():
    r = random.Random(7)
    letters = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    good, bad = [f"fine{letters(i)}word" for i in range(60)], [f"trashy{letters(i)}" for i in range(12)]
    docs, labels = [], []
    for i in range(400):
        poor = r.random() < 0.3
        text = " ".join(r.choice(bad) if poor and r.random() < 0.3 else r.choice(good) for _ in range(r.randint(3, 40)))
        docs.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "b", "c", None, f"s{i}"]), len(text)))
        if r.random() < 0.6:
            labels.append((i, int(not poor) if r.random() < 0.95 else None, int(poor and r.random() < 0.5)))
    docs += [(5, "another text with this number", "en", "a", 1), (None, "no number fineaaword", "en", "a", 1), (None, None, None, None, None), (900, " \n", "en", "b", 2)]
    labels += [(5, 0, 1), (6, 1, 0), (6, 0, 0), (None, 0, 1), (10_000, 0, 0)]
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def test_features_are_those_of_all_terms(spark):
    docs, labels = (spark.createDataFrame(x, k) for x, k in zip(corpus(), (DOCS, LABELS)))
    model = q.fit(docs, labels, surprise=0.5)
    assert any(b"*" in t for t in model.lexicon["low"]) and any(b"*" not in t for t in model.lexicon["low"])
    for text in [d[1] for d in corpus()[0]][:80] + ["trashy trashyaa trashyer trashyest trashying", None, ""]:
        raw = (text or "").encode()
        own = q.terms(q.words(raw))
        for head in q.HEADS:
            hits = sorted((w for t, w in model.lexicon[head].items() if t in own), reverse=True)
            strong = [h for h in hits if h > 0]
            want = [*q.shape(raw, q.words(raw)), sum(strong) ** 0.5, len(strong), sum(strong[:4]), sum(hits) / max(1, len(own)) ** 0.5]
            assert np.allclose(model.features(text)[head], want)


def test_fit_against_plain_counts(spark):
    """The words of one half and the regression of the other, counted and solved again by plain loops."""
    docs, labels = corpus()
    frames = [spark.createDataFrame(x, k) for x, k in zip((docs, labels), (DOCS, LABELS))]
    model = q.fit(*frames, surprise=1.0)
    known = {}
    for i, good, toxic in labels:
        if i is not None and good is not None:
            a, b = known.get(i, (0, 0))
            known[i] = (max(a, 1 - good), max(b, toxic))
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in known], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").collect()]
    half, other = order[::2], order[1::2]
    for k, head in enumerate(q.HEADS):
        counts, total = {}, [0, 0]
        for i in half:
            total[known[i][k]] += 1
            for text in [d[1] for d in docs if d[0] == i]:
                for t in q.terms(q.words(text.encode())):
                    counts.setdefault(t, [0, 0])[known[i][k]] += 1
        want = {}
        for t, (n, m) in counts.items():
            odds = math.log(((m + 0.5) / (total[1] + 1)) / ((n + 0.5) / (total[0] + 1)))
            if abs(odds / math.sqrt(1 / (m + 0.5) + 1 / (n + 0.5))) > 1.0:
                want[t] = odds
        assert want.keys() == model.lexicon[head].keys() and all(abs(want[t] - model.lexicon[head][t]) < 1e-9 for t in want)
        rows = [(model.features(d[1])[head], known[d[0]][k]) for d in docs if d[0] in set(other)]
        x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        mean, scale, w = model.heads[head]
        assert np.allclose(mean, x.mean(axis=0)) and np.allclose(scale, x.std(axis=0) + 1e-6)
        design = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -6, 6)])
        slope = design.T @ (y - 1 / (1 + np.exp(-design @ w))) - np.array([1e-3] + [1.0] * (len(w) - 1)) * w
        assert np.abs(slope).max() < 1e-3  # the penalised likelihood's gradient is nought there


def test_posteriors_against_plain_sums(spark):
    """All of classify() by plain loops: expected numbers, moments, shrinkage, own share taken out, shift, verdict."""
    docs, labels = corpus()
    frames = [spark.createDataFrame(x, k) for x, k in zip((docs, labels), (DOCS, LABELS))]
    model = q.fit(*frames, surprise=1.0)
    got = sorted(((r.doc_id, r.mark, *(round(x, 7) for x in r[2:6]), r.kept) for r in q.classify(*frames, model, most_shift=1.5).collect()), key=str)
    known = {}
    for i, good, toxic in labels:
        if i is not None and good is not None:
            a, b = known.get(i, (0, 0))
            known[i] = (max(a, 1 - good), max(b, toxic))
    logits = [model.logits(d[1]) for d in docs]
    sigmoid = lambda e: 1 / (1 + math.exp(-e))
    share = [[float(known[d[0]][k]) if d[0] in known else sigmoid(e[k]) for k in range(2)] for d, e in zip(docs, logits)]
    host, path = (lambda d: d[3] or "\0"), (lambda d: (d[3] or "\0", d[2] or "\0"))
    result = [[], []]
    for k in range(2):
        rate = min(max(sum(s[k] for s in share) / len(docs), 1e-6), 1 - 1e-6)

        def groups(key):
            out = {}
            for d, s in zip(docs, share):
                n, total = out.get(key(d), (0, 0.0))
                out[key(d)] = (n + 1, total + s[k])
            return out

        def strength(found, parent):
            some = [(n, t / n, parent(g)) for g, (n, t) in found.items() if n > 1]
            v = sum(m * (1 - m) for _, _, m in some) / len(some)
            number = sum(n for n, _, _ in some)
            between = sum(n * (x - m) ** 2 for n, x, m in some) / number - v * len(some) / number
            return min(1e6, max(1.0, v / between - 1)) if between > 0 else 1e6

        hosts, paths = groups(host), groups(path)
        a = strength(hosts, lambda g: rate)
        of_host = {g: (t + a * rate) / (n + a) for g, (n, t) in hosts.items()}
        b = strength(paths, lambda g: of_host[g[0]])
        for d, s, e in zip(docs, share, logits):
            n, t = paths[path(d)]
            site = min(max((max(t - s[k], 0.0) + b * of_host[host(d)]) / (n - 1 + b), 1e-6), 1 - 1e-6)
            shift = max(-1.5, min(1.5, math.log(site / (1 - site)) - math.log(rate / (1 - rate))))
            result[k].append((sigmoid(e[k] + shift), site))
    marks = {(r.text): r.m for r in frames[0].selectExpr("text", "xxhash64(text) m").collect()}
    want = []
    for d, low, toxic in zip(docs, *result):
        kept = bool((d[1] or "").strip()) and low[0] < 0.5 and toxic[0] < 0.5
        want.append((d[0], marks[d[1]], *(round(x, 7) for x in (low[0], toxic[0], low[1], toxic[1])), kept))
    assert got == sorted(want, key=str) or all(a[:2] == b[:2] and a[6] == b[6] and np.allclose(a[2:6], b[2:6], atol=1e-6) for a, b in zip(got, sorted(want, key=str), strict=True))


def test_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "en", "s", 1), (2, "x" * 2_000_000, "en", "s", 1), (None, "some words here", "en", "s", 1)], DOCS)
    wide = docs.selectExpr("*", *(f"'x' as `{c}`" for c in ("kept", "p_low", "mark", "host", "path", "low", "toxic", "n", "blank")))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABELS)
    assert q.classify(wide, labels, q.fit(wide, labels)).count() == 3
