"""Graph operators on edge tables: weak and strong components, slices, and the spread of effects along calls.

Each loop's round is a few joins and sums by key; its state is kept in the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import label, rank
from .session import cut


def _mark(df: DataFrame, *columns: str) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())


#: Edges for a task to read, at least.
EDGES = 1 << 17


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (id, label): for each node with an edge to another one the least node that it reaches, whatever the
    edges' direction. Every node hands its larger neighbours to its least one, then its smaller ones; rounds end when
    nothing moves. Self-links and null ends count for nothing."""
    now = cut(edges.where("u <> v").select("u", "v").distinct())
    seen = _mark(now, "u", "v")
    while True:
        files = max(1, seen[0] // EDGES)  # few edges do not ask for many tasks
        now = now.coalesce(files)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(files))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(down.withColumnRenamed("m", "v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().coalesce(files))
        if (then := _mark(now, "u", "v")) == seen:
            break
        seen = then
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each of nodes(id) with its weak component in the edges among them; a lone node is its own."""
    ids = nodes.select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi")
    return ids.join(components(inside.select("u", "v")), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def slices(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """changes(id, status), call edges(u, v) of both snapshots -> (id, members): connected changes, but for mere moves."""
    at = labelled(changes.where("status <> 'moved'"), edges)
    return at.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.concat(F.lit("slice:"), "label").alias("id"), "members")


def slice_violations(found: DataFrame) -> DataFrame:
    """Slices that are empty, not strictly ascending, or not named by their first member."""
    bad = (F.size("members") == 0) | (F.col("members") != F.array_sort(F.array_distinct("members"))) | (F.col("id") != F.concat(F.lit("slice:"), F.get("members", F.lit(0))))
    return found.where(bad)


def _ends(arcs: DataFrame) -> DataFrame:
    """(id, out, into) of the nodes of arcs(u, v): whether one begins or ends there. Sums by node combine before the
    shuffle, arcs are not moved."""
    end = lambda c, out: F.struct(F.col(c).alias("id"), F.lit(out).alias("out"), F.lit(not out).alias("into"))
    ends = arcs.select(F.explode(F.array(end("u", True), end("v", False))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.max("out").alias("out"), F.max("into").alias("into"))


def _among(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The arcs whose ends are both among nodes(id)."""
    return arcs.join(nodes.withColumnRenamed("id", "u"), "u", "left_semi").join(nodes.withColumnRenamed("id", "v"), "v", "left_semi")


def strong(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """nodes(id), edges(u, v) -> (id, scc), scc the least member. ends is _ends(edges), where it is known.

    Nodes without a way in or out are settled at once. For the rest, each node takes the least node that reaches it as
    its colour; what reaches a colour's root inside the colour is the root's component. Settled nodes go, and it starts
    again; colours shrink every time."""
    left = cut(nodes.select("id").distinct())
    arcs = edges.select("u", "v").where("u <> v")
    ends = _ends(arcs) if ends is None else ends
    inner = cut(ends.where("out and into").select("id").join(left, "id", "left_semi"))
    if inner.isEmpty():
        return left.withColumn("scc", F.col("id"))
    arcs = cut(_among(arcs, inner).distinct())
    parts = []
    while not arcs.isEmpty():
        while True:
            inner = cut(_among(arcs, _ends(arcs).where("out and into").select("id")))
            done = inner.count() == arcs.count()
            arcs = inner
            if done:
                break
        if arcs.isEmpty():
            break
        colour = arcs.select(F.col("u").alias("id")).distinct().withColumn("c", F.col("id"))
        seen = None
        while True:
            moved = arcs.join(colour, arcs.u == colour.id).select(F.col("v").alias("id"), "c")
            colour = cut(colour.unionByName(moved).groupBy("id").agg(F.min("c").alias("c")))
            if (then := _mark(colour, "id", "c")) == seen:
                break
            seen = then
        at = colour.toDF("u", "cu")
        inside = cut(arcs.join(at, "u").join(colour.toDF("v", "cv"), "v").where("cu = cv").select("u", "v", F.col("cu").alias("c")))
        reach = colour.where("id = c")
        size = None
        while True:
            reach = cut(reach.unionByName(inside.join(reach.select(F.col("id").alias("v")), "v", "left_semi").select(F.col("u").alias("id"), "c")).distinct())
            if (n := reach.count()) == size:
                break
            size = n
        parts.append(reach.select("id", F.col("c").alias("scc")))
        arcs = cut(arcs.join(reach.select(F.col("id").alias("u")), "u", "left_anti").join(reach.select(F.col("id").alias("v")), "v", "left_anti"))
    found = left.withColumn("scc", F.col("id")).limit(0)
    for p in parts:
        found = found.unionByName(p)
    return left.join(found, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def _adjacent(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """adjacency() and its _ends()."""
    out = cut(edges.groupBy("from", "to").agg(label(F.max(rank(F.col("confidence")))).alias("confidence")))
    ends = cut(_ends(out.select(F.col("from").alias("u"), F.col("to").alias("v"))))
    if (row := ends.join(nodes.select("id"), "id", "left_anti").first()) is not None:
        raise ValueError(f"a call edge ends at {row.id}, which is no symbol")
    return out, ends


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges(from, to, confidence) with parallel ones as one of the best confidence; an end that is no node is an error."""
    return _adjacent(nodes, edges)[0]


def _moved(sccs: DataFrame) -> DataFrame:
    """Of sccs the nodes that have another one's name: none where every component is a single node."""
    return cut(sccs.where("id <> scc"))


def _named(df: DataFrame, moved: DataFrame, end: str, name: str) -> DataFrame:
    """df with the component of the node in column `end`."""
    if moved.isEmpty():
        return df.withColumn(name, F.col(end))
    return df.join(moved.select(F.col("id").alias(end), F.col("scc").alias("__scc")), end, "left").withColumn(name, F.coalesce("__scc", end)).drop("__scc")


def condense(adjacent: DataFrame, sccs: DataFrame) -> DataFrame:
    """Edges between components, the best confidence of those that fall together; edges inside one are gone."""
    moved = _moved(sccs)
    if moved.isEmpty():
        return adjacent.where(F.col("from") != F.col("to")).select("from", "to", "confidence")
    both = _named(_named(adjacent, moved, "from", "a"), moved, "to", "b").where("a <> b")
    return both.groupBy(F.col("a").alias("from"), F.col("b").alias("to")).agg(label(F.max(rank(F.col("confidence")))).alias("confidence"))


def propagate(symbols: DataFrame, edges: DataFrame, sccs: DataFrame | None = None) -> DataFrame:
    """symbols(id, effects), edges(from, to, confidence) -> symbols with propagated effects behind their own.

    Along a path the least confidence counts, over paths the best. A component shares its effects; a local effect's plugin
    and derived_by stand against all that comes from below, else the least derived_by does. A symbol lists what it does
    not have itself and what a direct callee's component has, with those callees. Earlier propagated effects are dropped.

    A round hands on only what the last one changed: of all that came from below the best counts, so nothing has to be
    handed on again."""
    nodes = symbols.select("id")
    near, ends = _adjacent(nodes, edges)
    sccs = cut(strong(nodes, near.select(F.col("from").alias("u"), F.col("to").alias("v")), ends) if sccs is None else sccs)
    moved = _moved(sccs)
    over = condense(near, sccs).select(F.col("from").alias("scc"), F.col("to").alias("down"), rank(F.col("confidence")).alias("edge"))
    over = over if moved.isEmpty() else cut(over)
    called = cut(_named(ends.where("into").select("id"), moved, "id", "scc").select(F.col("scc").alias("down")).distinct())
    own = symbols.select("id", F.explode(F.filter("effects", lambda e: ~F.coalesce(e["propagated"], F.lit(False)))).alias("e"))
    key = ["scc", "eid", "target"]
    local = _named(own, moved, "id", "scc").groupBy("scc", F.col("e.id").alias("eid"), F.col("e.target").alias("target")).agg(F.max(rank(F.col("e.confidence"))).alias("r"), F.min(F.struct(F.col("e.derived_by").alias("d"), F.col("e.plugin").alias("p"))).alias("by"))
    all_ = cut(local.select(*key, "r", "by", F.lit(True).alias("mine"), F.lit(True).alias("new")))
    while True:
        new = all_.where("new").select(F.col("scc").alias("down"), "eid", "target", "r", "by")
        if new.select("down").distinct().join(called, "down", "left_semi").isEmpty():
            break
        below = over.join(new, "down").select("scc", "eid", "target", F.least("r", "edge").alias("r"), "by", F.lit(False).alias("mine"), F.lit(False).alias("held"))
        held = all_.select(*key, "r", "by", "mine", F.lit(True).alias("held"))
        best = F.min(F.struct(~F.col("mine"), F.col("by").alias("by")))["by"]
        both = held.unionByName(below).groupBy(*key).agg(F.max("r").alias("r"), best.alias("by"), F.max("mine").alias("mine"), F.max("held").alias("held"), F.max(F.when(F.col("held"), F.col("r"))).alias("old_r"), F.min(F.when(F.col("held"), F.struct("by")))["by"].alias("old_by"))
        same = F.col("held") & F.col("r").eqNullSafe(F.col("old_r")) & F.col("by").eqNullSafe(F.col("old_by"))
        all_ = cut(both.select(*key, "r", "by", "mine", (~same).alias("new")))
    has = _named(near, moved, "to", "scc").join(all_.select(*key), "scc").select(F.col("from").alias("id"), "to", "eid", "target")
    via = has.groupBy("id", "eid", "target").agg(F.array_sort(F.collect_set("to")).alias("via"))
    mine = own.select("id", F.col("e.id").alias("eid"), F.col("e.target").alias("target")).distinct()
    gained = _named(via.join(mine, ["id", "eid", "target"], "left_anti"), moved, "id", "scc").join(all_.drop("mine", "new"), key)
    entry = F.struct(F.col("eid").alias("id"), "target", F.lit(None).cast("int").alias("line"), F.col("by.p").alias("plugin"), label(F.col("r")).alias("confidence"), F.col("by.d").alias("derived_by"), F.lit(True).alias("propagated"), F.col("via").alias("derived_from"))
    added = gained.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("__more"))
    kind = dict(symbols.dtypes)["effects"]
    kept = F.filter("effects", lambda e: ~F.coalesce(e["propagated"], F.lit(False)))
    out = symbols.join(added, "id", "left")
    return out.withColumn("effects", F.when(F.col("__more").isNull(), kept).otherwise(F.concat(F.coalesce(kept, F.array().cast(kind)), F.col("__more").cast(kind)))).select(*symbols.columns)


def propagation_stats(symbols: DataFrame, sccs: DataFrame) -> DataFrame:
    """One row: components, the largest one's size, propagated entries, symbols with any."""
    n = F.size(F.filter("effects", lambda e: F.coalesce(e["propagated"], F.lit(False))))
    a = sccs.groupBy("scc").agg(F.count("*").alias("n")).agg(F.count("*").alias("scc_count"), F.coalesce(F.max("n"), F.lit(0)).alias("max_scc_size"))
    b = symbols.select(F.greatest(n, F.lit(0)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("propagated_effects"), F.count_if(F.col("n") > 0).alias("symbols_with_propagated"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")
