import itertools
import random

import numpy as np

from tessera.llm import chat as c

SCHEMA = "conv_id long, turn long, role string, text string, rendered int"


def test_roles_hidden_from_the_model_come_back(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    hidden = rows.selectExpr("conv_id", "turn", "case when xxhash64(conv_id, turn) % 10 < 3 then null else role end as role", "text")
    got = {(r.conv_id, r.turn): r.role for r in c.turns(hidden, c.fit(hidden), trust=True).where("part = 0").collect()}
    want = {(r.conv_id, r.turn): r.role for r in rows.collect()}
    lost = [(r.conv_id, r.turn) for r in hidden.where("role is null").collect()]
    assert all(got[k] == v for k, v in want.items() if k not in set(lost))
    right = np.mean([got[k] == want[k] for k in lost])
    assert right > 0.9, right


def test_query_reads_the_text_alone(spark):
    path = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{path}/conversations.parquet")
    got = c.query(spark, path).collect()
    right = np.mean([r.agrees for r in got if r.part == 0 and r.agrees is not None])
    print("agree", right)
    assert right > 0.9, right
    # with another role column to show, but the same model, the same comes out
    hmm, some = c.fit(rows), rows.where("conv_id % 7 = 0")
    bare = lambda d: sorted(tuple(r)[:6] for r in c.turns(d, hmm).collect())
    assert bare(some) == bare(some.drop("role").selectExpr("*", "cast(null as string) as role"))


def plain(rows):
    """Learning, decoding and rendering by plain loops over all conversations; the best of all paths by dynamic programming
    over whole conversations, written apart from the operator."""
    key = lambda r: tuple((x is not None, x if x is not None else 0 if i == 0 else "") for i, x in enumerate((r[1], r[2], r[3])))
    convs = {}
    for r in rows:
        convs.setdefault(r[0] if r[0] is not None else object(), []).append(r)
    counts = {}
    add = lambda *k: counts.__setitem__(k, counts.get(k, 0) + 1)
    for conv, own in convs.items():
        own.sort(key=key)
        if own[0][0] is None:
            continue
        known = [r[2] if r[2] in c.ROLES else None for r in own]
        if known[0]:
            add("start", known[0], "")
        for a, b in zip(known, known[1:]):
            if a and b:
                add("move", a, b)
        for role, r in zip(known, own):
            for marker, shape, _ in c.lines_of(None, r[3]) if role else ():
                add("mark", role, marker)
                add("shape", role, str(shape))
    hmm, out = c.Hmm.of(counts), []
    for own in convs.values():
        lines = [(i, x) for i, r in enumerate(own) for x in c.lines_of(None, r[3])]
        emit = hmm.emit([x for _, x in lines])
        best = [{s: (hmm.start[s] + emit[0, s], (s,)) for s in range(3)}]
        for n in range(1, len(lines)):
            step = hmm.move[lines[n][1][1] & 1]
            best.append({s: max(((best[-1][p][0] + step[p, s] + emit[n, s], (*best[-1][p][1], s)) for p in range(3)), key=lambda x: x[0]) for s in range(3)})
        top = max(v[0] for v in best[-1].values())
        paths = [v[1] for v in best[-1].values() if abs(v[0] - top) < 1e-9]
        out.append((own, lines, paths))
    return hmm, out


def test_end_to_end_against_plain_loops(spark):
    for seed in (11, 12):
        rows = corpus(seed) + [(3, 0, None, "Human: again", 1), (3, None, "user", "tie", 1), (3, None, "user", "tie", 1), (None, 1, "assistant", "alone", 1), (5, 2, "system", None, 1)]
        want, found = plain(rows)
        df = spark.createDataFrame(rows, SCHEMA)
        hmm = c.fit(df, block=3)
        for name in ("start", "move", "mark", "shape"):
            assert np.allclose(getattr(hmm, name), getattr(want, name)), name
        got = {}
        for r in c.turns(df, hmm, block=3).collect():
            got.setdefault(r.conv_id, []).append(r)
        for own, lines, paths in found:
            if own[0][0] is None:
                continue
            accepted = []
            for path in paths:
                turns, n = [], 0
                while n < len(lines):
                    end = n + 1
                    while end < len(lines) and lines[end][0] == lines[n][0] and path[end] == path[n] and lines[end][1][0] == "none":
                        end += 1
                    role = c.ROLES[path[n]]
                    text = "\n".join(x[2] for _, x in lines[n:end]).strip()
                    turns.append((own[lines[n][0]][1], role, end - n, f"<|im_start|>{role}\n{text}<|im_end|>\n"))
                    n = end
                accepted.append(sorted(turns, key=str))
            mine = sorted(((r.turn, r.role, r.n_lines, r.rendered) for r in got[own[0][0]]), key=str)
            assert mine in accepted


def test_long_conversations_and_texts(spark):
    rows = [(1, i, None, "Human: q?" if i % 2 else "AI: an answer", 1) for i in range(3000)] + [(2, 0, None, "User: " + "word " * 400_000 + "\n" * 20_000 + "Bot: y", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"rendered": "entry"}).selectExpr("*", "1 as last", "2 as block", "'x' as given", "'y' as agrees", "3 as c", "4 as b")
    got = c.turns(df, c.fit(df)).collect()
    assert [r.role for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.turn)] == ["assistant", "user"] * 1500
    assert [r.role for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.part)][-1] == "assistant"


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for conv in range(12):
        for turn in range(r.randint(1, 7)):
            text = "\n".join(r.choice(["hello there", "why?", "Human: and then", "### Assistant: a long line of words " * 3, "[bot]: ok", "note: x", ""]) for _ in range(r.randint(1, 3)))
            rows.append((conv, turn, r.choice([*c.ROLES, None, "narrator"]), text, 1))
    return rows


def test_blocks_and_every_path(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, SCHEMA)
    hmm = c.fit(df)
    once = sorted(map(str, c.turns(df, hmm).collect()))
    assert once == sorted(map(str, c.turns(df, hmm, block=2).collect()))
    for conv in range(12):
        lines = [x for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]) for x in c.lines_of(r[2], r[3])][:8]
        emit = hmm.emit(lines)

        def score(path):
            s = hmm.start[path[0]] + emit[0, path[0]]
            for i in range(1, len(path)):
                s += hmm.move[lines[i][1] & 1][path[i - 1], path[i]] + emit[i, path[i]]
            return s

        best = max(score(p) for p in itertools.product(range(3), repeat=len(lines)))
        assert abs(score(hmm.decode(lines, None, None)) - best) < 1e-9


def test_markers_and_rendering(spark):
    df = spark.createDataFrame([(1, 0, None, "System: be kind\nUser: hi\nhow are you?\n**Assistant:** fine", 1), (2, 0, "user", None, 1), (None, None, "assistant", "x", 1), (None, None, "assistant", "x", 1)], SCHEMA)
    got = sorted((tuple(r)[:6] for r in c.turns(df, c.fit(df), trust=True).collect()), key=str)
    assert [g[5] for g in got if g[0] == 1] == ["<|im_start|>system\nbe kind<|im_end|>\n", "<|im_start|>user\nhi\nhow are you?<|im_end|>\n", "<|im_start|>assistant\nfine<|im_end|>\n"]
    assert (2, 0, 0, "user", 1, "<|im_start|>user\n<|im_end|>\n") in got and sum(g[0] is None for g in got) == 2
    assert c.turns(df.limit(0), c.fit(df.limit(0))).count() == 0


def test_fit_counts_moves_between_blocks(spark):
    df = spark.createDataFrame(corpus(3), SCHEMA)
    whole = c.fit(df)
    for block in (1, 2, 3):
        cut = c.fit(df, block=block)
        for name in ("start", "move", "mark", "shape"):
            assert np.allclose(getattr(whole, name), getattr(cut, name)), (block, name)
