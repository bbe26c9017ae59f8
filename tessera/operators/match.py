"""Pairing the symbols of two snapshots in five stages, each on what the stages before left over.

base and head are symbol tables. Every stage gives pairs(base_id, head_id, rationale). Stages keep their order: it is part
of the result. Assignment is one to one under a total order (score, base id, head id): rounds accept the pairs that are
best for both of their ends, which gives what accepting them one after the other in that order would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.fingerprint import ZERO
from ..functions.paths import basename
from .session import cut

PAIRS = "base_id string, head_id string, rationale string"
SAME_LOGIC_NAMES = 0.85
#: The lowest of text.threshold().
LEAST_NEED = 0.85


def unclaimed(symbols: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return symbols.join(pairs.select(F.col(side).alias("id")), "id", "left_anti")


def by_id(base: DataFrame, head: DataFrame) -> DataFrame:
    return base.select(F.col("id").alias("base_id")).join(head.select(F.col("id").alias("head_id")), F.col("base_id") == F.col("head_id")).select("base_id", "head_id", F.lit("id").alias("rationale"))


def by_rename(base: DataFrame, head: DataFrame, renames: DataFrame) -> DataFrame:
    """renames(old_path, new_path): the base id with its new file is the head's id; of several bases the lowest id."""
    moved = base.select("id", F.col("source.file").alias("old_path")).join(renames, "old_path").select(F.col("id").alias("base_id"), ids.with_file(F.col("id"), F.col("old_path"), F.col("new_path")).alias("head_id")).where("head_id is not null")
    return moved.join(head.select(F.col("id").alias("head_id")), "head_id", "left_semi").groupBy("head_id").agg(F.min("base_id").alias("base_id")).select("base_id", "head_id", F.lit("git-rename").alias("rationale"))


def assign(candidates: DataFrame) -> DataFrame:
    """candidates(base_id, head_id, score) -> one-to-one pairs(base_id, head_id), best first."""
    left = cut(candidates.select("base_id", "head_id", "score"))
    done = left.select("base_id", "head_id").limit(0)
    while not left.isEmpty():
        order = [F.desc("score"), "base_id", "head_id"]
        ranked = left.withColumn("b", F.row_number().over(Window.partitionBy("base_id").orderBy(*order))).withColumn("h", F.row_number().over(Window.partitionBy("head_id").orderBy(*order)))
        best = cut(ranked.where("b = 1 and h = 1").select("base_id", "head_id"))
        done = done.unionByName(best)
        left = cut(left.join(best.select("base_id"), "base_id", "left_anti").join(best.select("head_id"), "head_id", "left_anti"))
    return done


def _rare_words(base: DataFrame, head: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides, as base(*keys, base_id, base_words, need, ...), with a row for each of the words that a pair must share:
    two sets of words at a Jaccard index of `need` or more meet among the size - ceil(need * size) + 1 words of each that
    come first in one order of all words, here the rarest. What all names share then makes no pairs. `need` may be lower
    on one side than the pair's own."""
    wide = lambda d, p: d.withColumn("word", F.explode(f"{p}_words"))
    b, h = wide(base, "base"), wide(head, "head")
    often = b.select(*keys, "word").unionByName(h.select(*keys, "word")).groupBy(*keys, "word").agg(F.count("*").alias("often"))

    def first(d: DataFrame, p: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys, f"{p}_id").orderBy("often", "word"))
        enough = F.size(f"{p}_words") - F.ceil(F.col("need") * F.size(f"{p}_words") - 1e-9) + 1
        return d.join(often, [*keys, "word"]).withColumn("place", place).where(F.col("place") <= enough).drop("often", "place", "need")

    return first(b, "base"), first(h, "head")


def _logic(symbols: DataFrame, prefix: str) -> DataFrame:
    fine = symbols.where(f"not dropped and fingerprint.logic <> '{ZERO}'")
    return fine.select(F.col("id").alias(f"{prefix}_id"), F.col("fingerprint.logic").alias("logic"), text.tokens(F.col("name")).alias(f"{prefix}_words"))


def by_logic(base: DataFrame, head: DataFrame) -> DataFrame:
    """Same logic fingerprint. A group's only base takes the head of the closest name; with several, names at
    SAME_LOGIC_NAMES or closer are assigned, and what that leaves is looked at again."""
    b, h = cut(_logic(base, "base")), cut(_logic(head, "head"))
    b, h = cut(b.join(h.select("logic").distinct(), "logic", "left_semi")), cut(h.join(b.select("logic").distinct(), "logic", "left_semi"))
    score = text.jaccard(F.col("base_words"), F.col("head_words"))
    out = None
    open_ = None  # groups that the last round changed
    while True:
        groups = b.groupBy("logic").agg(F.count("*").alias("n"), F.first("base_id").alias("base_id"), F.first("base_words").alias("base_words"))
        groups = groups if open_ is None else groups.join(open_, "logic", "left_semi")
        lone = groups.where("n = 1").join(h, "logic").withColumn("score", score)
        closest = lone.groupBy("base_id").agg(F.min_by("head_id", F.struct(-F.col("score"), F.col("head_id"))).alias("head_id")).withColumn("rationale", F.lit("logic-fingerprint"))
        many = groups.where("n > 1").select("logic")
        words = lambda d, p: d.join(many, "logic", "left_semi").select("logic", f"{p}_id", f"{p}_words", F.lit(SAME_LOGIC_NAMES).alias("need"))
        rare_b, rare_h = _rare_words(words(b, "base"), words(h, "head"), ["logic"])
        shared = rare_b.join(rare_h, ["logic", "word"]).dropDuplicates(["base_id", "head_id"])
        empty = b.where("size(base_words) = 0").join(many, "logic", "left_semi").join(h.where("size(head_words) = 0"), "logic")
        near = shared.select("base_id", "head_id", score.alias("score")).unionByName(empty.select("base_id", "head_id", F.lit(1.0).alias("score"))).where(F.col("score") >= SAME_LOGIC_NAMES)
        named = assign(near).withColumn("rationale", F.lit("logic-fingerprint+name-disambiguation"))
        closest, named = cut(closest.select("base_id", "head_id", "rationale")), cut(named)
        out = closest.unionByName(named) if out is None else out.unionByName(closest).unionByName(named)
        if named.isEmpty():
            return out
        open_ = cut(b.join(named, "base_id", "left_semi").select("logic").distinct())
        used = closest.unionByName(named)
        b, h = cut(b.join(used, "base_id", "left_anti")), cut(h.join(used, "head_id", "left_anti"))


def _named(symbols: DataFrame, prefix: str) -> DataFrame:
    member = text.tokens(text.last_segment(F.col("name")))
    fine = symbols.where(~F.col("dropped") & text.says_enough(F.col("name")))
    return fine.select(F.col("id").alias(f"{prefix}_id"), F.col("name").alias(f"{prefix}_name"), F.col("kind"), F.col("signature").isNull().alias("bare"), F.col("signature").alias(f"{prefix}_sig"), member.alias(f"{prefix}_words"))


def name_candidates(base: DataFrame, head: DataFrame) -> DataFrame:
    """Pairs of one kind, both with a signature or both without, whose members share a word and whose score reaches the
    head's threshold. The cheap member test comes first: below 2 * (threshold - 0.5) nothing else can help."""
    b, h = _named(base, "base"), _named(head, "head")
    need = text.threshold(F.col("head_name"))
    side = lambda d, p, least: d.select("kind", "bare", f"{p}_id", f"{p}_words", least.alias("need"))
    rare_b, rare_h = _rare_words(side(b, "base", F.lit(2 * (LEAST_NEED - 0.5))), side(h, "head", 2 * (need - 0.5)), ["kind", "bare"])
    met = rare_b.join(rare_h, ["kind", "bare", "word"]).select("base_id", "head_id", F.size(F.array_intersect("base_words", "head_words")).alias("both")).distinct()
    full = met.join(b, "base_id").join(h.drop("kind", "bare"), "head_id")
    member = F.col("both") / (F.size("base_words") + F.size("head_words") - F.col("both"))
    near = full.withColumn("member", member).withColumn("need", need).where("member >= 2 * (need - 0.5)")
    near = near.where(text.owners_compatible(F.col("base_name"), F.col("head_name")))
    score = (0.5 * F.col("member") + 0.3 * text.signature_similarity(F.col("base_sig"), F.col("head_sig"))) + 0.2
    return near.withColumn("score", score).where("score >= need").select("base_id", "head_id", "score")


def name_classes(symbols: DataFrame) -> DataFrame:
    """(id, class) of the symbols that stage 4 looks at. Those of one name, kind and signature have the same candidates at
    the same scores; the least id names their class."""
    fine = symbols.where(~F.col("dropped") & text.says_enough(F.col("name"))).select("id", F.to_json(F.struct("name", "kind", "signature")).alias("key"))
    return fine.join(fine.groupBy("key").agg(F.min("id").alias("class")), "key").select("id", "class")


def by_name(base: DataFrame, head: DataFrame) -> DataFrame:
    """Classes are scored once, all their members are assigned."""
    b, h = cut(name_classes(base)), cut(name_classes(head))
    firsts = lambda d, c: d.join(c.select(F.col("class").alias("id")).distinct(), "id", "left_semi")
    return assign_members(name_candidates(firsts(base, b), firsts(head, h)), b, h).withColumn("rationale", F.lit("name-signature"))


def assign_members(pairs: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """pairs(base_id, head_id, score) of classes and both sides' members(id, class) -> what `assign` gives on all pairs of
    members, without listing them. Two classes that are each other's only best ones take each other's members in order
    of id. Where none are, the classes tied at the highest score do so in one task for each connected part."""
    left = cut(pairs.select(F.col("base_id").alias("base_class"), F.col("head_id").alias("head_class"), "score"))
    side = lambda d, p: d.select(F.col("class").alias(f"{p}_class"), F.col("id").alias(f"{p}_id"))
    b, h = (side(d, p).join(left.select(f"{p}_class").distinct(), f"{p}_class", "left_semi") for d, p in ((base, "base"), (head, "head")))
    b, h = cut(b), cut(h)
    if b.count() + h.count() == b.select("base_class").distinct().count() + h.select("head_class").distinct().count():
        return assign(left.select(F.col("base_class").alias("base_id"), F.col("head_class").alias("head_id"), "score"))
    done = left.select(F.col("base_class").alias("base_id"), F.col("head_class").alias("head_id")).limit(0)
    while not left.isEmpty():
        best = left
        for c in ("base_class", "head_class"):
            w = Window.partitionBy(c)
            best = best.withColumn(f"{c}_best", F.max("score").over(w)).withColumn(f"{c}_ties", F.count(F.when(F.col("score") == F.col(f"{c}_best"), 1)).over(w))
        only = cut(best.where("score = base_class_best and score = head_class_best and base_class_ties = 1 and head_class_ties = 1").select("base_class", "head_class"))
        if only.isEmpty():
            top = cut(left.join(left.agg(F.max("score").alias("score")), "score"))
            made = _tied(top, b, h)
        else:
            place = lambda d, p: d.withColumn("place", F.row_number().over(Window.partitionBy(f"{p}_class").orderBy(f"{p}_id")))
            made = only.join(place(b, "base"), "base_class").join(place(h, "head"), ["head_class", "place"]).select("base_id", "head_id")
        made = cut(made)
        done = done.unionByName(made)
        b, h = cut(b.join(made, "base_id", "left_anti")), cut(h.join(made, "head_id", "left_anti"))
        left = cut(left.join(b, "base_class", "left_semi").join(h, "head_class", "left_semi"))
    return done


def _listed(pairs: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """Pairs of classes and members in one table; a pair has no ids, a member only its own."""
    return pairs.unionByName(base, allowMissingColumns=True).unionByName(head, allowMissingColumns=True)


def _tied(top: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """Assignment within pairs of classes of one score."""
    from .graph import components

    u, v = F.concat(F.lit("b:"), "base_class"), F.concat(F.lit("h:"), "head_class")
    label = cut(components(top.select(u.alias("u"), v.alias("v"))))
    of = lambda d, node: d.join(label.select(F.col("id").alias("node"), "label"), node == F.col("node")).drop("node")
    rows = _listed(of(top, u), of(base, u), of(head, v))
    return rows.groupBy("label").applyInPandas(lambda pdf: next(_members_in_order([pdf])), "base_id string, head_id string")


def _members_in_order(batches):
    """Sequential acceptance without a list of the members' pairs: from the highest score down, each base in order of id
    takes the least head that is left in the classes its own is paired with."""
    import pandas as pd

    rows = pd.concat(list(batches))
    waiting, heads, levels, out = {}, {}, {}, []
    for r in rows.itertuples(index=False):
        if isinstance(r.base_id, str):
            waiting.setdefault(r.base_class, []).append(r.base_id)
        elif isinstance(r.head_id, str):
            heads.setdefault(r.head_class, []).append(r.head_id)
        else:
            levels.setdefault(r.score, {}).setdefault(r.base_class, []).append(r.head_class)
    for ids_ in heads.values():
        ids_.sort(reverse=True)
    for score in sorted(levels, reverse=True):
        near = levels[score]
        for base, own in sorted((i, c) for c in near for i in waiting.get(c, ())):
            open_ = [heads[c] for c in near[own] if heads.get(c)]
            if open_:
                out.append((base, min(open_, key=lambda x: x[-1]).pop()))
        used = {b for b, _ in out}
        for c in near:
            waiting[c] = [i for i in waiting.get(c, ()) if i not in used]
    yield pd.DataFrame(out, columns=["base_id", "head_id"])


def sole_candidates(base: DataFrame, head: DataFrame) -> DataFrame:
    """Dropped symbols that alone on their side carry a key, kind with last segment or kind with file name."""
    out = None
    for key in (text.last_segment(F.col("name")), basename(F.col("source.file"))):
        side = lambda d, c: d.where("dropped").groupBy("kind", key.alias("key")).agg(F.count("*").alias("n"), F.min("id").alias(c)).where("n = 1").drop("n")  # noqa: E731, B023
        pairs = side(base, "base_id").join(side(head, "head_id"), ["kind", "key"]).select("base_id", "head_id")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def best_pairing(edges: DataFrame) -> DataFrame:
    """edges(base_id, head_id), at most two at a node, so paths and cycles: a largest one-to-one choice. Each path is
    walked from its smaller end, each cycle from its smallest edge, taking every other edge.

    A component is laid out by its label, found by joins; a component's edges then go to one task. With two keys a
    component is a chain of copies and renames, whose length does not grow with the tables."""
    from .graph import components

    nodes = edges.select(F.concat(F.lit("b:"), "base_id").alias("u"), F.concat(F.lit("h:"), "head_id").alias("v"))
    label = components(nodes)
    full = edges.join(label.select(F.substring("id", 3, 1 << 30).alias("base_id"), "label", F.substring("id", 1, 2).alias("side")).where("side = 'b:'").drop("side"), "base_id")

    def walk(pdf):
        import pandas as pd

        left = sorted(map(tuple, pdf[["base_id", "head_id"]].itertuples(index=False)))
        at: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for e in left:
            at.setdefault(("b", e[0]), []).append(e)
            at.setdefault(("h", e[1]), []).append(e)
        used, out = set(), []
        ends = sorted(n for n, es in at.items() if len(es) == 1)
        for start in [*ends, *(("b", e[0]) for e in left)]:
            node, take = start, True
            while (e := next((x for x in at[node] if x not in used), None)) is not None:
                used.add(e)
                if take:
                    out.append(e)
                take = not take
                node = ("h", e[1]) if node == ("b", e[0]) else ("b", e[0])
        return pd.DataFrame(_whole(out), columns=["base_id", "head_id"])

    def _whole(chosen):
        """A cycle's last edge may meet its first one's node."""
        seen, out = set(), []
        for b, h in chosen:
            if ("b", b) not in seen and ("h", h) not in seen:
                seen |= {("b", b), ("h", h)}
                out.append((b, h))
        return out

    return full.groupBy("label").applyInPandas(walk, "base_id string, head_id string")


def by_sole_key(base: DataFrame, head: DataFrame) -> DataFrame:
    return best_pairing(sole_candidates(base, head)).withColumn("rationale", F.lit("dropped-weak"))


def match(base: DataFrame, head: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """All stages: pairs(base_id, head_id, rationale)."""
    stages = [by_id]
    if renames is not None:
        stages.append(lambda b, h: by_rename(b, h, renames))
    stages += [by_logic, by_name, by_sole_key]
    out = None
    for stage in stages:
        pairs = cut(stage(base, head).select("base_id", "head_id", "rationale"))
        out = pairs if out is None else out.unionByName(pairs)
        base, head = unclaimed(base, pairs, "base_id"), unclaimed(head, pairs, "head_id")
    return out


def status(base: Column, head: Column) -> Column:
    """Of a pair of symbol structs."""
    moved = (base["source"]["file"] != head["source"]["file"]) | (base["id"] != head["id"])
    changed = ~base["fingerprint"].eqNullSafe(head["fingerprint"])
    return F.when(base["dropped"] != head["dropped"], "dropped-toggled").when(moved & changed, "moved+changed").when(moved, "moved").when(changed, "changed").otherwise("unchanged")


def drop_direction(head_dropped: Column) -> Column:
    return F.when(head_dropped, "to-dropped").otherwise("to-kept")
