"""Every query of the driver contract by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fingerprint, ids, paths, text
from ..operators import aggregates, classify, delta, diff, gate, graph, integrity, match, resolve
from ..operators.session import cut
from ..sources import components
from . import adapters, pages
from .adapters import RENAMES, SNAPSHOTS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


STATUS = "CASE WHEN b.dropped <> h.dropped THEN 'dropped-toggled' WHEN (b.file <> h.file OR b.id <> h.id) AND (b.api <> h.api OR b.logic <> h.logic OR b.syntax <> h.syntax) THEN 'moved+changed' WHEN b.file <> h.file OR b.id <> h.id THEN 'moved' WHEN b.api <> h.api OR b.logic <> h.logic OR b.syntax <> h.syntax THEN 'changed' ELSE 'unchanged' END"
TWO_STAGES = f"""{SNAPSHOTS}, {RENAMES},
one AS (SELECT b.id AS base_id, h.id AS head_id, 'id' AS rationale FROM base b JOIN head h ON b.id = h.id),
two AS (SELECT min(b.id) AS base_id, h.id AS head_id, 'git-rename' AS rationale FROM base b JOIN renames r ON b.file = r.old_path JOIN head h ON h.id = 'ts:' || r.new_path || '#' || b.name
  WHERE b.id NOT IN (SELECT base_id FROM one) AND h.id NOT IN (SELECT head_id FROM one) GROUP BY h.id),
pairs AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""


def _two_stages(spark, sf_dir):
    base, head = adapters.snapshots(spark, sf_dir)
    one = match.by_id(base.symbols, head.symbols)
    two = match.by_rename(match.unclaimed(base.symbols, one, "base_id"), match.unclaimed(head.symbols, one, "head_id"), adapters.renames(spark, sf_dir))
    return base, head, one.unionByName(two)


@query(f"WITH {SNAPSHOTS} SELECT b.id AS base_id, h.id AS head_id, 'id' AS rationale FROM base b JOIN head h ON b.id = h.id")
def diff_stage1_id(spark, sf_dir):
    base, head = adapters.snapshots(spark, sf_dir)
    return match.by_id(base.symbols, head.symbols)


@query(f"WITH {TWO_STAGES} SELECT * FROM two")
def diff_stage2_rename(spark, sf_dir):
    return _two_stages(spark, sf_dir)[2].where("rationale = 'git-rename'")


@query(f"WITH {TWO_STAGES} SELECT base_id, head_id, {STATUS} AS status FROM pairs JOIN base b ON b.id = base_id JOIN head h ON h.id = head_id")
def diff_status(spark, sf_dir):
    base, head, pairs = _two_stages(spark, sf_dir)
    return diff.paired(base.symbols, head.symbols, pairs).select("base_id", "head_id", "status")


LEFT = f"""{TWO_STAGES},
full_ AS (SELECT b.dropped AS bd, h.dropped AS hd, {STATUS} AS status FROM pairs JOIN base b ON b.id = base_id JOIN head h ON h.id = head_id),
rest AS (SELECT b.id, b.dropped, CASE WHEN k.reason IS NOT NULL AND NOT b.dropped THEN 'unknown' ELSE 'removed' END AS status, CASE WHEN NOT b.dropped AND k.reason IS NOT NULL THEN 'head' END AS absent_from, CASE WHEN NOT b.dropped THEN k.reason END AS reason FROM base b LEFT JOIN hskip k ON k.path = b.file WHERE b.id NOT IN (SELECT base_id FROM pairs)
  UNION ALL SELECT h.id, h.dropped, CASE WHEN k.reason IS NOT NULL AND NOT h.dropped THEN 'unknown' ELSE 'added' END, CASE WHEN NOT h.dropped AND k.reason IS NOT NULL THEN 'base' END, CASE WHEN NOT h.dropped THEN k.reason END FROM head h LEFT JOIN bskip k ON k.path = h.file WHERE h.id NOT IN (SELECT head_id FROM pairs))"""


@query(f"WITH {LEFT} SELECT id, status, dropped, absent_from, reason FROM rest")
def diff_leftovers(spark, sf_dir):
    base, head, pairs = _two_stages(spark, sf_dir)
    return diff.leftovers(base.symbols, head.symbols, pairs, base.skips(), head.skips())


SUMMARY = f"""{LEFT},
s AS (SELECT * FROM (SELECT count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'moved') AS moved, count(*) FILTER (status = 'moved+changed') AS moved_changed, count(*) FILTER (status = 'dropped-toggled') AS dropped_toggled, count(*) FILTER (status = 'dropped-toggled' AND hd) AS to_dropped, count(*) FILTER (status = 'dropped-toggled' AND NOT hd) AS to_kept, count(*) FILTER (status = 'unchanged') AS unchanged FROM full_),
  (SELECT count(*) FILTER (status = 'added' AND NOT dropped) AS added, count(*) FILTER (status = 'removed' AND NOT dropped) AS removed, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status = 'added' AND dropped) AS dropped_added, count(*) FILTER (status = 'removed' AND dropped) AS dropped_removed FROM rest))"""


@query(f"WITH {SUMMARY} SELECT * FROM s")
def diff_summary(spark, sf_dir):
    base, head, pairs = _two_stages(spark, sf_dir)
    return diff.summary(diff.paired(base.symbols, head.symbols, pairs), diff.leftovers(base.symbols, head.symbols, pairs, base.skips(), head.skips()))


@query(f"WITH {SUMMARY} SELECT * FROM (SELECT 0 AS ord, 'unknown:>5' AS clause, unknown AS observed, unknown > 5 AS tripped FROM s UNION ALL SELECT 1, 'moved+changed', moved_changed, moved_changed > 0 FROM s UNION ALL SELECT 2, 'dropped-toggled:to-dropped', to_dropped, to_dropped > 0 FROM s UNION ALL SELECT 3, 'changed:>1000000', changed, changed > 1000000 FROM s)")
def gate_eval(spark, sf_dir):
    return gate.evaluate(gate.parse("unknown:>5,moved+changed,dropped-toggled:to-dropped,changed:>1000000"), diff_summary(spark, sf_dir))


@query(f"WITH {SUMMARY} SELECT 0 AS ord, 'unchanged' AS clause, unchanged AS observed FROM s WHERE FALSE UNION ALL SELECT ord, clause, observed FROM (SELECT 0 AS ord, 'added:>=1' AS clause, added AS observed, added >= 1 AS t FROM s UNION ALL SELECT 1, 'removed:<=3', removed, removed <= 3 FROM s) WHERE t ORDER BY ord LIMIT 1")
def gate_first_tripped(spark, sf_dir):
    return gate.first_tripped(gate.evaluate(gate.parse("added:>=1,removed:<=3", wide=True), diff_summary(spark, sf_dir))).select("ord", "clause", "observed")


@query(f"WITH {TWO_STAGES}, lb AS (SELECT logic, id, count(*) OVER (PARTITION BY logic) AS n FROM base WHERE NOT dropped AND id NOT IN (SELECT base_id FROM pairs)), lh AS (SELECT logic, id FROM head WHERE NOT dropped AND id NOT IN (SELECT head_id FROM pairs)), c AS (SELECT b.id AS base_id, h.id AS head_id, list_distinct(string_split(regexp_replace(split_part(b.id, '#', 2), '([a-z])([0-9])', '\\1.\\2', 'g'), '.')) AS x, list_distinct(string_split(regexp_replace(split_part(h.id, '#', 2), '([a-z])([0-9])', '\\1.\\2', 'g'), '.')) AS y FROM lb b JOIN lh h USING (logic) WHERE n = 1), r AS (SELECT base_id, head_id, row_number() OVER (PARTITION BY base_id ORDER BY len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) DESC, head_id) AS k FROM c) SELECT base_id, head_id, 'logic-fingerprint' AS rationale FROM r WHERE k = 1")
def diff_stage3_lone(spark, sf_dir):
    base, head, pairs = _two_stages(spark, sf_dir)
    b, h = match.unclaimed(base.symbols, pairs, "base_id"), match.unclaimed(head.symbols, pairs, "head_id")
    only = b.where("not dropped").groupBy("fingerprint.logic").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("id")
    return match.by_logic(b.join(only, "id", "left_semi"), h)


@query()
def diff_full(spark, sf_dir):
    base, head = adapters.snapshots(spark, sf_dir)
    return diff.diff(base, head, adapters.renames(spark, sf_dir)).changes


@query("SELECT * FROM (SELECT DISTINCT source || '/' || lang || '.ts' AS path FROM documents WHERE lang = 'en'), (SELECT 'over-size' AS base_reason), (SELECT 'unreadable' AS head_reason)")
def not_compared(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat("source", F.lit("/"), "lang", F.lit(".ts")).alias("path"), "lang").distinct()
    return diff.not_compared(files.where("lang in ('en', 'de')").select("path", F.lit("over-size").alias("reason")), files.where("lang in ('en', 'fr')").select("path", F.lit("unreadable").alias("reason")))


# --- joins before assignment, on the names of parts -------------------------------------------------------------------

def _part_symbols(spark, sf_dir, head):
    """A part is a method of its brand; head renames plural words."""
    p = table(spark, sf_dir, "part")
    member = F.regexp_replace("p_name", " ", "_")
    name = F.concat(F.regexp_replace("p_brand", "[#0-9]", ""), F.lit("s." if head else "."), member)
    kind = F.when(F.col("p_size") <= 25, "method").otherwise("function")
    from ..schema import SYMBOLS, shaped

    return shaped(p.select(F.concat(F.lit("h" if head else "b"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"), name.alias("name"), kind.alias("kind"), F.lit(False).alias("dropped")), SYMBOLS)


def _side_sql(head):
    return f"SELECT '{'h' if head else 'b'}' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, lower(regexp_replace(p_brand, '[#0-9]', '', 'g')) || '{'s' if head else ''}' AS owner, CASE WHEN p_size <= 25 THEN 'method' ELSE 'function' END AS kind, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: w <> '')) AS w FROM part"


@query("SELECT p_partkey, list_filter(w, lambda x, i: x <> '' AND list_position(w, x) = i) AS words FROM (SELECT p_partkey, regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(p_name || '.' || p_type || p_brand, '([a-z])([A-Z])', '\\1.\\2', 'g'), '([A-Za-z])([0-9])', '\\1.\\2', 'g'), '([0-9])([A-Za-z])', '\\1.\\2', 'g')), '[.:_\\-\\s/]+') AS w FROM part)")
def tokenize_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.tokens(F.concat("p_name", F.lit("."), "p_type", "p_brand")).alias("words"))


@query("SELECT s_suppkey, s_name, CASE WHEN strpos(n, '::') > 0 THEN substr(n, strpos(n, '::') + 2) ELSE regexp_extract(n, '[^.]*$') END AS last, CASE WHEN strpos(n, '::') > 0 THEN left(n, strpos(n, '::') - 1) WHEN strpos(n, '.') > 0 THEN regexp_replace(n, '\\.[^.]*$', '') ELSE '' END AS own FROM (SELECT s_suppkey, s_name, CASE WHEN s_nationkey < 8 THEN s_name WHEN s_nationkey < 16 THEN 'a.b.' || s_name ELSE 'a.b::' || s_name || '.c' END AS n FROM supplier)")
def owner_and_last_segment(spark, sf_dir):
    n = F.when(F.col("s_nationkey") < 8, F.col("s_name")).when(F.col("s_nationkey") < 16, F.concat(F.lit("a.b."), "s_name")).otherwise(F.concat(F.lit("a.b::"), "s_name", F.lit(".c")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", text.last_segment(n).alias("last"), text.owner(n).alias("own"))


@query("WITH n AS (SELECT DISTINCT p_name, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part) SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 9) AS similarity FROM n a JOIN n b ON a.p_name <= b.p_name AND len(list_intersect(a.w, b.w)) > 0")
def jaccard_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("w", text.tokens(F.col("p_name")))
    wide = lambda c: n.select(F.col("p_name").alias(c), F.col("w").alias(f"w{c}"), F.explode("w").alias("word"))
    met = wide("a").join(wide("b"), "word").where("a <= b").dropDuplicates(["a", "b"])
    return met.select("a", "b", F.round(text.jaccard(F.col("wa"), F.col("wb")), 9).alias("similarity"))


STAGE4 = f"""b AS ({_side_sql(False)}), h AS ({_side_sql(True)}), bg AS (SELECT owner, kind, w, min(id) AS id FROM b GROUP BY ALL), hg AS (SELECT owner, kind, w, min(id) AS id FROM h GROUP BY ALL),
m AS (SELECT bg.id AS base_id, hg.id AS head_id, len(hg.w) AS k, len(list_intersect(bg.w, hg.w)) / len(list_distinct(list_concat(bg.w, hg.w))) AS member FROM bg JOIN hg ON bg.kind = hg.kind AND hg.owner = bg.owner || 's'),
c AS (SELECT base_id, head_id, round(0.5 * member + 0.3 + 0.2, 9) AS score FROM m WHERE member > 0 AND 0.5 * member + 0.3 + 0.2 >= CASE WHEN k <= 1 THEN 1.0 WHEN k = 2 THEN 0.95 ELSE 0.85 END - 1e-12)"""


def _stage4_sides(spark, sf_dir):
    """The least part of each brand, kind and name, whose candidates are those of all parts of that class."""
    sides = []
    for head in (False, True):
        s = _part_symbols(spark, sf_dir, head)
        first = s.groupBy("name", "kind").agg(F.min("id").alias("id"))
        sides.append(s.join(first.select("id"), "id", "left_semi"))
    return sides


@query(f"WITH {STAGE4} SELECT * FROM c")
def diff_stage4_candidates(spark, sf_dir):
    """Pairs of classes by their least parts, as the SQL has them; diff_stage4_classes has every part's class."""
    b, h = _stage4_sides(spark, sf_dir)
    return match.name_candidates(b, h).select("base_id", "head_id", F.round("score", 9).alias("score"))


@query("SELECT side || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, side || lpad(CAST(min(p_partkey) OVER (PARTITION BY side, regexp_replace(p_brand, '[#0-9]', '', 'g'), p_size <= 25, p_name) AS VARCHAR), 9, '0') AS class FROM part, (VALUES ('b'), ('h')) t(side)")
def diff_stage4_classes(spark, sf_dir):
    """The class of every part on both sides."""
    b, h = (match.name_classes(_part_symbols(spark, sf_dir, head)) for head in (False, True))
    return b.unionByName(h)


@query()
def diff_stage4_matches(spark, sf_dir):
    """All parts, one to one."""
    return match.by_name(_part_symbols(spark, sf_dir, False), _part_symbols(spark, sf_dir, True))


@query(f"WITH {SNAPSHOTS}, bd AS (SELECT regexp_extract(id, '[^.#]*$') AS key, min(id) AS id FROM base WHERE dropped GROUP BY 1 HAVING count(*) = 1), hd AS (SELECT regexp_extract(id, '[^.#]*$') AS key, min(id) AS id FROM head WHERE dropped GROUP BY 1 HAVING count(*) = 1), bf AS (SELECT regexp_extract(file, '[^/]*$') AS key, min(id) AS id FROM base WHERE dropped GROUP BY 1 HAVING count(*) = 1), hf AS (SELECT regexp_extract(file, '[^/]*$') AS key, min(id) AS id FROM head WHERE dropped GROUP BY 1 HAVING count(*) = 1) SELECT bd.id AS base_id, hd.id AS head_id FROM bd JOIN hd USING (key) UNION SELECT bf.id, hf.id FROM bf JOIN hf USING (key)")
def diff_stage45_sole(spark, sf_dir):
    base, head = adapters.snapshots(spark, sf_dir)
    return match.sole_candidates(base.symbols, head.symbols)


@query()
def diff_stage45_pairing(spark, sf_dir):
    base, head = adapters.snapshots(spark, sf_dir)
    return match.by_sole_key(base.symbols, head.symbols)


# --- components and dependencies --------------------------------------------------------------------------------------


@query("WITH b AS (SELECT DISTINCT c_mktsegment AS f, o_orderpriority AS t, max(o_orderstatus) AS e FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2), h AS (SELECT DISTINCT c_mktsegment AS f, o_orderpriority AS t, min(o_orderstatus) AS e FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY 1, 2), j AS (SELECT coalesce(b.f, h.f) AS f, coalesce(b.t, h.t) AS t, b.f IS NOT NULL AS inb, h.f IS NOT NULL AS inh, b.e AS be, h.e AS he FROM b FULL JOIN h ON b.f = h.f AND b.t = h.t) SELECT f AS \"from\", t AS \"to\", 'orders' AS via, 'removed' AS status, 'outbound' AS direction, be AS effect FROM j WHERE inb AND (NOT inh OR be IS DISTINCT FROM he) UNION ALL SELECT f, t, 'orders', 'added', 'outbound', he FROM j WHERE inh AND (NOT inb OR be IS DISTINCT FROM he)")
def dependency_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    edge = lambda d, e: d.groupBy(F.col("c_mktsegment").alias("from"), F.col("o_orderpriority").alias("to")).agg(e("o_orderstatus").alias("effect")).select("from", "to", F.lit("orders").alias("via"), F.lit("outbound").alias("direction"), "effect")
    none = adapters.document_symbols(table(spark, sf_dir, "documents"), False).limit(0)
    return diff.dependency_changes(diff.Snapshot(none, dependencies=edge(o.where("o_orderdate < timestamp '1996-01-01'"), F.max)), diff.Snapshot(none, dependencies=edge(o.where("o_orderdate >= timestamp '1994-01-01'"), F.min))).drop("absent_from", "lost")


@query("WITH n AS (SELECT r_name AS id, list(n_name ORDER BY n_name) AS roots FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1), b AS (SELECT id, roots FROM n WHERE id <> 'ASIA'), h AS (SELECT CASE WHEN id = 'AFRICA' THEN 'NEW' ELSE id END AS id, CASE WHEN id = 'EUROPE' THEN list_reverse(roots) ELSE roots END AS roots FROM n) SELECT coalesce(b.id, h.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' ELSE 'changed' END AS status, CASE WHEN b.id IS NOT NULL AND h.id IS NOT NULL THEN ['roots'] END AS fields FROM b FULL JOIN h ON b.id = h.id WHERE b.id IS NULL OR h.id IS NULL OR b.roots <> h.roots")
def component_diff(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("id")).agg(F.array_sort(F.collect_list("n_name")).alias("roots"))
    none = F.lit(None).cast("array<string>")
    full = n.withColumn("public_api", none).withColumn("frameworks", none)
    head = full.withColumn("roots", F.when(F.col("id") == "EUROPE", F.reverse("roots")).otherwise(F.col("roots"))).withColumn("id", F.when(F.col("id") == "AFRICA", "NEW").otherwise(F.col("id")))
    return diff.component_changes(full.where("id <> 'ASIA'"), head).drop("roots")


# --- graphs -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS label FROM documents")
def wcc_labels(spark, sf_dir):
    """Documents in a chain of equal texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("t"))
    before = F.lag("doc_id").over(Window.partitionBy("t").orderBy("doc_id"))
    edges = d.select(F.col("doc_id").alias("u"), before.alias("v")).where("v is not null")
    return graph.labelled(d.select(F.col("doc_id").alias("id")), edges)


SLICES = f"WITH {SUMMARY}, ch AS (SELECT head_id AS id FROM (SELECT head_id, {STATUS} AS status FROM pairs JOIN base b ON b.id = base_id JOIN head h ON h.id = head_id) WHERE status NOT IN ('unchanged', 'moved')) SELECT 'slice:' || min(id) AS id, list(id ORDER BY id) AS members FROM ch JOIN head USING (id) GROUP BY logic"


@query(SLICES)
def slices(spark, sf_dir):
    """Changes with equal logic call each other in a ring."""
    base, head, pairs = _two_stages(spark, sf_dir)
    return _slices(diff.paired(base.symbols, head.symbols, pairs))


def _slices(full):
    full = full.where("status <> 'unchanged'").select("head_id", "status", "head")
    w = Window.partitionBy("head.fingerprint.logic").orderBy("head_id")
    edges = full.where("status <> 'moved'").select(F.col("head_id").alias("u"), F.lag("head_id").over(w).alias("v")).where("v is not null")
    return graph.slices(full.select(F.col("head_id").alias("id"), "status"), edges)


TRANSITIONS = "t AS (SELECT DISTINCT u, v FROM (SELECT event_type || '/' || (CAST(value AS BIGINT) // 10) AS v, lag(event_type || '/' || (CAST(value AS BIGINT) // 10)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u FROM events) WHERE u IS NOT NULL AND u <> v)"


@query(f"WITH RECURSIVE {TRANSITIONS}, n AS (SELECT u AS id FROM t UNION SELECT v FROM t), r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, t.v FROM r JOIN t ON r.b = t.u) SELECT x.a AS id, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def scc_events(spark, sf_dir):
    """States of users and the steps between them."""
    step = F.concat("event_type", F.lit("/"), F.floor(F.round("value", 0).cast("long") / 10).cast("string"))
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", step.alias("v"))
    t = e.select("v", F.lag("v").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("u")).where("u is not null and u <> v").select("u", "v").distinct()
    return graph.strong(t.select(F.explode(F.array("u", "v")).alias("id")), t)


CALLS = "SELECT 'c' || o_custkey AS f, 'p' || l_partkey AS t, max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'N' THEN 1 ELSE 0 END) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"


def _calls(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    conf = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    return o.select(F.concat(F.lit("c"), "o_custkey").alias("from"), F.concat(F.lit("p"), "l_partkey").alias("to"), conf.alias("confidence"))


def _call_symbols(spark, sf_dir):
    """Customers call parts; a part has one effect by its type."""
    kind = "array<struct<id:string,target:string,line:int,plugin:string,confidence:string,derived_by:string,propagated:boolean,derived_from:array<string>>>"
    null = F.lit(None)
    effect = F.array(F.struct(F.when(F.col("p_size") < 10, "db.read").otherwise("db.write").alias("id"), F.col("p_brand").alias("target"), F.lit(1).alias("line"), F.lit("p").alias("plugin"), F.lit("high").alias("confidence"), F.col("p_type").alias("derived_by"), F.lit(False).alias("propagated"), null.cast("array<string>").alias("derived_from"))).cast(kind)
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), effect.alias("effects"))
    return parts.unionByName(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.array().cast(kind).alias("effects")))


@query(f"WITH e AS ({CALLS}), x AS (SELECT e.f AS id, CASE WHEN p_size < 10 THEN 'db.read' ELSE 'db.write' END AS effect, p_brand AS target, max(r) AS r, min(p_type) AS derived_by, list(DISTINCT t ORDER BY t) AS via FROM e JOIN part ON t = 'p' || p_partkey GROUP BY 1, 2, 3) SELECT id, effect, target, ['low', 'medium', 'high'][r + 1] AS confidence, derived_by, via AS derived_from FROM x")
def propagate_two_level(spark, sf_dir):
    """Effects that customers get from the parts they call: best confidence over parts, least derived_by."""
    out = graph.propagate(_call_symbols(spark, sf_dir), _calls(spark, sf_dir))
    return out.select("id", F.explode("effects").alias("e")).where("e.propagated").select("id", F.col("e.id").alias("effect"), "e.target", "e.confidence", "e.derived_by", "e.derived_from")


@query(f"WITH e AS ({CALLS}) SELECT f AS \"from\", t AS \"to\", ['low', 'medium', 'high'][r + 1] AS confidence FROM e")
def edge_dedupe(spark, sf_dir):
    return graph.adjacency(_call_symbols(spark, sf_dir), _calls(spark, sf_dir))


@query("SELECT DISTINCT 'c' || o_custkey AS \"from\" FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey = (SELECT min(l_partkey) FROM lineitem)")
def callers(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    first = table(spark, sf_dir, "lineitem").agg(F.min("l_partkey")).first()[0]
    return resolve.callers(resolve.dependencies(calls), f"p{first}")


# --- components of a workspace ----------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT DISTINCT p_brand, p_size % 4 AS g FROM part), n AS (SELECT 'libs/g' || g || '/' || p_brand AS root, CASE WHEN g = 0 THEN '@own/Lib_' || p_brand WHEN g = 1 THEN 'same' END AS package, p_brand, g FROM d),
k AS (SELECT *, trim(regexp_replace(lower(coalesce(regexp_replace(package, '^@[^/]*/', ''), p_brand)), '[^a-z0-9]+', '-', 'g'), '-') AS id0 FROM n),
p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY id0) > 1 THEN id0 || '-g' || g ELSE id0 END AS id1 FROM k),
i AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY root) AS r FROM p),
l AS (SELECT p_brand, p_size % 4 AS g, CASE WHEN p_size % 3 = 0 THEN 'py' WHEN p_size % 3 = 1 THEN 'js' ELSE 'ts' END AS lang, count(*) AS c FROM part GROUP BY ALL),
s AS (SELECT *, sum(c) OVER (PARTITION BY p_brand, g) AS t FROM l), f AS (SELECT p_brand, g, string_agg(lang, ',' ORDER BY lang) AS langs FROM s WHERE c >= 10 AND c / t >= 0.05 GROUP BY ALL)
SELECT id1 || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS id, coalesce(package, i.p_brand) AS name, root, coalesce(langs, 'ts') AS languages, CASE WHEN i.g = 0 THEN 'react' END AS frameworks, CASE WHEN i.g = 0 THEN 'index.js' END AS public_api FROM i LEFT JOIN f ON f.p_brand = i.p_brand AND f.g = i.g""")
def component_detection(spark, sf_dir):
    """Parts as files of packages, a folder for each group of sizes and brand; some have a manifest, many the same name."""
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 4).alias("g"), "p_partkey", "p_size")
    root = F.concat(F.lit("libs/g"), "g", F.lit("/"), "p_brand")
    kind = F.when(F.col("p_size") % 3 == 0, "py").when(F.col("p_size") % 3 == 1, "js").otherwise("ts")
    paths = p.select(F.concat(root, F.lit("/src/f"), "p_partkey", F.lit("."), kind).alias("path"))
    own = F.concat(F.lit('{"name": "@own/Lib_'), "p_brand", F.lit('", "dependencies": {"react": "1"}, "exports": {".": "./index.js"}}'))
    manifests = p.where("g < 2").select(root.alias("root"), F.when(F.col("g") == 0, own).otherwise('{"name": "same"}').alias("text")).distinct().select(F.concat("root", F.lit("/package.json")).alias("path"), "text")
    found = components.detect(paths.unionByName(manifests.select("path")), manifests, [{"tool": "pnpm", "patterns": ["libs/*/*"]}, {"tool": "turbo", "patterns": []}], "root")
    return found.select("id", "name", F.col("roots")[0].alias("root"), F.array_join("languages", ",").alias("languages"), F.array_join("frameworks", ",").alias("frameworks"), F.array_join("public_api", ",").alias("public_api"))


# --- call resolution --------------------------------------------------------------------------------------------------


def _named(spark, sf_dir):
    """Documents as symbols `w` of a file for each source and language; w is the text's first word."""
    from ..schema import SYMBOLS, shaped

    d = table(spark, sf_dir, "documents")
    file = F.concat("source", F.lit("/"), "lang", F.lit(".ts"))
    word = F.lower(F.regexp_extract("text", r"([A-Za-z]+)", 1))
    null = F.lit(None)
    s = d.where(word != "").select(F.concat(F.lit("ts:"), file, F.lit("#"), word, F.lit("_"), "doc_id").alias("id"), word.alias("name"), F.lit("ts").alias("language"), F.col("source").alias("component"), (F.col("n_chars") < 300).alias("dropped"), F.struct(file.alias("file"), null.cast("int").alias("start_line"), null.cast("int").alias("end_line"), null.cast("int").alias("start_column"), null.cast("int").alias("end_column")).alias("source"))
    return shaped(s, SYMBOLS)


def _word_calls(spark, sf_dir):
    """Each kept document calls the word its text ends with, plainly or by its component."""
    d = table(spark, sf_dir, "documents")
    file = F.concat("source", F.lit("/"), "lang", F.lit(".ts"))
    word = F.lower(F.regexp_extract("text", r"([A-Za-z]+)", 1))
    last = F.lower(F.regexp_extract("text", r"([A-Za-z]+)[^A-Za-z]*$", 1))
    return d.where((word != "") & (F.col("n_chars") >= 300)).select(F.col("doc_id").alias("call"), F.concat(F.lit("ts:"), file, F.lit("#"), word, F.lit("_"), "doc_id").alias("caller"), last.alias("target"), F.lit(1).alias("line"))


NAMED = "s AS (SELECT doc_id, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS w, lower(regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1)) AS t, source || '/' || lang || '.ts' AS file, n_chars < 300 AS dropped FROM documents), k AS (SELECT *, 'ts:' || file || '#' || w || '_' || doc_id AS id FROM s WHERE w <> '' AND NOT dropped), g AS (SELECT file, w, count(*) AS n, min(id) AS id FROM k GROUP BY ALL), r AS (SELECT k.doc_id AS call, k.id AS caller, k.t AS target, CASE WHEN g.n = 1 THEN g.id END AS resolved, CASE WHEN g.n = 1 THEN 'high' END AS confidence, CASE WHEN k.t = '' OR k.t IN ('this', 'super') THEN 'dynamic' WHEN g.n = 1 THEN NULL WHEN g.n > 1 THEN 'ambiguous' ELSE 'no-match' END AS bucket FROM k LEFT JOIN g ON g.file = k.file AND g.w = k.t AND k.t NOT IN ('', 'this', 'super'))"


@query(f"WITH {NAMED} SELECT call, caller, target, resolved, confidence, bucket FROM r")
def resolve_scopes(spark, sf_dir):
    return resolve.resolve(_named(spark, sf_dir), _word_calls(spark, sf_dir)).select("call", "caller", "target", "resolved", "confidence", "bucket")


@query(f"WITH {NAMED} SELECT count(*) AS total, count(resolved) AS resolved, count(*) FILTER (bucket = 'local-scope') AS local_scope, count(*) FILTER (bucket = 'dynamic') AS dynamic, count(*) FILTER (bucket = 'ambiguous') AS ambiguous, count(*) FILTER (bucket = 'external') AS external, count(*) FILTER (bucket = 'no-match') AS no_match FROM r")
def call_census(spark, sf_dir):
    return resolve.census(resolve.resolve(_named(spark, sf_dir), _word_calls(spark, sf_dir)))


# --- aggregates -------------------------------------------------------------------------------------------------------


@query("SELECT event_type || '.' || (user_id % 7) AS effect, count(*) AS n, list(DISTINCT 'u' || (user_id % 5) ORDER BY 'u' || (user_id % 5)) AS components FROM events GROUP BY 1 ORDER BY n DESC, effect LIMIT 10")
def effect_surface_top10(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("."), (F.col("user_id") % 7).cast("string")).alias("effect"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("component"))
    return aggregates.effect_surface(e)


@query("SELECT r_name AS component, count(n_name) FILTER (n_nationkey > 4) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def per_component_counts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("component"), (F.col("n_nationkey") <= 4).alias("dropped"))
    return aggregates.per_component(n, table(spark, sf_dir, "region").select(F.col("r_name").alias("id")))


REASON = "CASE WHEN n_chars > 4000 THEN 'over-size' WHEN n_chars < 100 THEN 'unreadable' WHEN lang = 'es' THEN 'unroutable' END"
SKIPS = f"k AS (SELECT DISTINCT source || '/' || doc_id || '.' || lang AS path, {REASON} AS reason FROM documents WHERE {REASON} IS NOT NULL)"


def _skips(spark, sf_dir):
    reason = F.when(F.col("n_chars") > 4000, "over-size").when(F.col("n_chars") < 100, "unreadable").when(F.col("lang") == "es", "unroutable")
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), reason.alias("reason")).where("reason is not null").distinct()


@query(f"WITH {SKIPS} SELECT reason, count(*) AS n, list(path ORDER BY path) AS paths FROM k GROUP BY reason")
def skipped_by_reason(spark, sf_dir):
    return aggregates.by_reason(_skips(spark, sf_dir))


@query(f"WITH {SKIPS}, r AS (SELECT *, count(*) OVER (PARTITION BY reason) AS n, row_number() OVER (PARTITION BY reason ORDER BY path) AS i FROM k) SELECT reason, n, list(path ORDER BY path) AS paths FROM r WHERE i <= 10 GROUP BY reason, n")
def skipped_listed(spark, sf_dir):
    return aggregates.by_reason(_skips(spark, sf_dir), aggregates.LISTED)


@query(f"WITH {SKIPS} SELECT reason, count(*) AS n FROM k GROUP BY reason ORDER BY n DESC, reason LIMIT 1")
def dominant_reason(spark, sf_dir):
    return aggregates.dominant_reason(_skips(spark, sf_dir))


@query("SELECT source, CASE WHEN count(*) = 0 THEN 'nothing-discovered' WHEN count(*) FILTER (lang = 'en') = 0 THEN 'nothing-parsed' WHEN count(*) FILTER (lang = 'en') / count(*) < 0.6 THEN 'below-floor' END AS fault FROM documents GROUP BY source")
def coverage_fault(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("t"), F.count_if(F.col("lang") == "en").alias("p"))
    return n.select("source", aggregates.coverage_fault(F.col("t"), F.col("p"), F.lit(0.6)).alias("fault"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS nth FROM events")
def occurrence_counter(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", aggregates.occurrence(["user_id", "event_type"], ["ts", "event_id"]).alias("nth"))


@query("WITH e AS (SELECT *, value < 50 AS bad, sum(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(ts) AS \"begin\", max(ts) AS \"end\" FROM e WHERE bad GROUP BY user_id, run HAVING count(*) >= 3")
def failure_streaks(spark, sf_dir):
    return aggregates.streaks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 50, 3)


@query("WITH f AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share FROM f) SELECT source AS component, lang AS language, n, round(share, 9) AS share FROM s WHERE n >= 3 AND share >= 0.05")
def language_shares(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select(F.col("source").alias("component"), F.col("lang").alias("language"))
    return aggregates.language_shares(f, 3, 0.05).select("component", "language", "n", F.round("share", 9).alias("share"))


@query("WITH c AS (SELECT 'r' || (n_nationkey % 4) || '/p' || (n_nationkey % 3) || '/x' || n_nationkey AS root, 'x' || (n_nationkey % 6) AS id FROM nation), d AS (SELECT root, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN id || '-' || split_part(root, '/', 2) ELSE id END AS id FROM c), e AS (SELECT root, id, row_number() OVER (PARTITION BY id ORDER BY root) AS k FROM d) SELECT root, CASE WHEN k > 1 THEN id || '-' || k ELSE id END AS id FROM e")
def component_id_collisions(spark, sf_dir):
    n = F.col("n_nationkey")
    c = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), (n % 4).cast("string"), F.lit("/p"), (n % 3).cast("string"), F.lit("/x"), n.cast("string")).alias("root"), F.concat(F.lit("x"), (n % 6).cast("string")).alias("id"))
    return aggregates.resolved_ids(c)


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("SELECT doc_id, left(sha256(text), 12) AS syntax FROM documents WHERE trim(text) <> ''")
def fingerprint_syntax(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", fingerprint.syntax(F.col("text")).alias("syntax"))


@query("SELECT p_partkey, left(sha256('{\"effects\":[{\"target\":' || to_json(p_brand) || '}],\"rules\":[{\"condition\":' || to_json(p_name) || ',\"expr\":null,\"loopKind\":null,\"type\":\"guard\",\"what\":' || to_json(p_type) || '}]}'), 12) AS logic FROM part")
def fingerprint_logic(spark, sf_dir):
    null = F.lit(None).cast("string")
    rules = F.array(F.struct(F.lit("guard").alias("type"), F.lit(1).alias("line"), F.col("p_name").alias("condition"), F.col("p_type").alias("what"), null.alias("expr"), null.alias("loop_kind")))
    return table(spark, sf_dir, "part").select("p_partkey", fingerprint.logic(rules, F.array(F.struct(F.col("p_brand").alias("target")))).alias("logic"))


@query("SELECT p_partkey, left(sha256('{\"decorators\":[],\"extKind\":null,\"kind\":\"method\",\"shortName\":' || to_json(p_name) || ',\"signature\":{\"async\":' || (p_size > 25) || ',\"generator\":false,\"inputs\":[' || to_json(p_type) || '],\"outputs\":[],\"throws\":[' || to_json(p_brand) || '],\"typeParameters\":[]},\"visibility\":\"public\"}'), 12) AS api FROM part")
def fingerprint_api(spark, sf_dir):
    strings = lambda *c: F.array(*c).cast("array<string>")
    sig = F.struct(F.array(F.struct(F.lit("ignored").alias("name"), F.col("p_type").alias("type"))).alias("inputs"), strings().alias("outputs"), strings(F.col("p_brand")).alias("throws"), (F.col("p_size") > 25).alias("async"), F.lit(False).alias("generator"), strings().alias("type_parameters"))
    marks = F.array().cast("array<struct<name:string,raw:string,boundary:boolean,line:int>>")
    return table(spark, sf_dir, "part").select("p_partkey", fingerprint.api(F.lit("method"), F.lit(None).cast("string"), F.concat(F.lit("A::b."), "p_name"), F.lit("public"), marks, sig).alias("api"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(p_type || '_' || p_name, '[_\\s]+', '-', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS id FROM part")
def kebab_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.kebab(F.concat("p_type", F.lit("_"), "p_name")).alias("id"))


URL_PATH = "regexp_extract(url, '^[^:]+://[^/?#]*/?([^?#]*)', 1)"


@query(f"WITH p AS (SELECT page_id, {URL_PATH} AS p FROM pages) SELECT page_id, regexp_extract(p, '[^/]*$') AS base, CASE WHEN strpos(p, '/') > 0 THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS dir, lower(regexp_extract(p, '(\\.[^./]*)$', 1)) AS ext, regexp_replace(regexp_replace(regexp_replace(url, '[:/#.]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g') AS file FROM p JOIN pages USING (page_id)")
def path_parts(spark, sf_dir):
    p = F.regexp_extract("url", r"^[^:]+://[^/?#]*/?([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.extension(p).alias("ext"), text.sanitized(F.col("url")).alias("file"))


@query("WITH d AS (SELECT doc_id, source, lang, doc_id % 4 AS k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN source || '/' || lang || '/x' WHEN 1 THEN source || '/x' WHEN 2 THEN 'x' ELSE NULL END AS path FROM d")
def path_join(spark, sf_dir):
    rest = F.element_at(F.array(*map(F.lit, ("./x", "../x", "./../../x", "../../../x"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", paths.join_posix(F.concat("source", F.lit("/"), "lang"), rest).alias("path"))


@query("SELECT page_id, regexp_full_match(id, '[a-z][a-z0-9]*:[^#]+#(?:[A-Za-z_$][A-Za-z0-9_$]*)(?:\\.[A-Za-z_$][A-Za-z0-9_$]*)*') AND strpos(id, '..') = 0 AS valid, regexp_extract(id, '^[^:]+:([^#]+)#', 1) AS file FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'ts:src/a.ts#f' || page_id WHEN page_id % 3 = 1 THEN 'ts:src/a.ts#' || page_id ELSE 'TS:src/../a.ts#f.g' || page_id END AS id FROM pages)")
def id_grammar(spark, sf_dir):
    i, n = F.col("page_id"), F.col("page_id").cast("string")
    v = F.when(i % 3 == 0, F.concat(F.lit("ts:src/a.ts#f"), n)).when(i % 3 == 1, F.concat(F.lit("ts:src/a.ts#"), n)).otherwise(F.concat(F.lit("TS:src/../a.ts#f.g"), n))
    return table(spark, sf_dir, "pages").select("page_id", ids.is_symbol_id(v).alias("valid"), ids.file_of(v).alias("file"))


# --- classifiers ------------------------------------------------------------------------------------------------------

TARGETS = ("db.user.findMany", "db.user.upsert", "db.$transaction", "this.trpc.user.byId.useQuery", "a.b.mutate", "self.eventBus.emit", "db.query.users.findFirst", "db.select.from", "console.log.x", "console.logger")
MODULES = ("@prisma/client", "drizzle-orm/pg-core", "@trpc/react-query", "eventemitter2", "left-pad")
EXPECTED = {
    ("@prisma/client", "db.user.findMany"): ("prisma", "db.read", "prisma:read"),
    ("@prisma/client", "db.user.upsert"): ("prisma", "db.write", "prisma:write"),
    ("@prisma/client", "db.$transaction"): ("prisma", "db.transaction", "prisma:tx"),
    ("@prisma/client", "db.query.users.findFirst"): ("prisma", "db.read", "prisma:read"),
    ("drizzle-orm/pg-core", "db.query.users.findFirst"): ("drizzle", "db.read", "drizzle:read"),
    ("@trpc/react-query", "this.trpc.user.byId.useQuery"): ("trpc", "network.rpc", "trpc:query:user.byId"),
    ("@trpc/react-query", "a.b.mutate"): ("trpc", "network.rpc", "trpc:mutation:b"),
    ("eventemitter2", "self.eventBus.emit"): ("nest", "event.publish", "nest:emit"),
}
_pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_truth = "(VALUES " + ", ".join(f"('{m}', '{t}', '{p}', '{e}', '{d}')" for (m, t), (p, e, d) in EXPECTED.items()) + ") AS x(m, t, plugin, effect, derived_by)"


@query(f"WITH e AS (SELECT event_id, {_list(TARGETS)}[event_id % 10 + 1] AS t, {_list(MODULES)}[user_id % 5 + 1] AS m FROM events) SELECT event_id, t AS target, plugin, effect, derived_by FROM e LEFT JOIN {_truth} USING (m, t)")
def classify_effects(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", _pick(TARGETS, F.col("event_id")).alias("target"), F.array(F.struct(_pick(MODULES, F.col("user_id")).alias("source"))).alias("imports"))
    got = e.withColumn("x", classify.effect(F.col("target"), F.col("imports"), F.lit(1)))
    return got.select("event_id", "target", "x.plugin", F.col("x.effect.id").alias("effect"), "x.effect.derived_by")


@query(f"SELECT event_id, {_list(TARGETS)}[event_id % 10 + 1] LIKE 'console.log.%' AS dropped FROM events")
def drop_tier_c(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", classify.dropped_call(_pick(TARGETS, F.col("event_id"))).alias("dropped"))


@query("SELECT doc_id, CASE WHEN lang = 'es' THEN NULL WHEN source = 'src1' THEN 'interface' WHEN source = 'src2' THEN 'type' WHEN n_chars < 500 THEN 'empty body' END AS reason FROM documents")
def drop_tier_b(spark, sf_dir):
    kind = F.when(F.col("source") == "src1", "interface").when(F.col("source") == "src2", "type").otherwise("function")
    return table(spark, sf_dir, "documents").select("doc_id", classify.drop_reason(kind, F.col("lang") == "es", F.col("n_chars") < 500, F.array().cast("array<string>")).alias("reason"))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '/(?:en|fr)/[^/?#]*\\.html$|^https?://blog\\.[^/]*/es/.*$')")
def drop_tier_a(spark, sf_dir):
    """Files by glob: the URL behind the scheme is the path."""
    p = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").where(~paths.matches_any(p, ["**/{en,fr}/*.html", "blog.*/es/**"]) | F.lit(False)).select("page_id", "url")


@query("WITH f AS (SELECT page_id, ['app/a/page.tsx', 'src/app/route.ts', 'app/Page.tsx', 'lib/page.tsx', 'app/x/not-found.jsx'][page_id % 5 + 1] AS file, ['GET', '<default>', 'helper'][page_id % 3 + 1] AS name FROM pages) SELECT page_id, CASE WHEN file = 'src/app/route.ts' AND name = 'GET' THEN 'framework:next:route' WHEN file = 'app/a/page.tsx' AND name = '<default>' THEN 'framework:next:page' WHEN file = 'app/x/not-found.jsx' AND name = '<default>' THEN 'framework:next:not-found' END AS ext_kind FROM f")
def framework_rules(spark, sf_dir):
    file = _pick(("app/a/page.tsx", "src/app/route.ts", "app/Page.tsx", "lib/page.tsx", "app/x/not-found.jsx"), F.col("page_id"))
    name = _pick(("GET", "<default>", "helper"), F.col("page_id"))
    got = classify.next_symbol(F.lit("function"), name, file, F.array().cast("array<string>"))
    return table(spark, sf_dir, "pages").select("page_id", got["ext_kind"].alias("ext_kind"))


# --- integrity --------------------------------------------------------------------------------------------------------


@query("SELECT '13' AS rule, l_orderkey || ' ' || l_linenumber AS subject, count(*) || ' rows' AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def check_unique(spark, sf_dir):
    return integrity.unique(table(spark, sf_dir, "lineitem"), "13", "l_orderkey", "l_linenumber")


@query("SELECT '03' AS rule, CAST(o_orderkey AS VARCHAR) AS subject, 'no ' || o_custkey AS message FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def check_refs(spark, sf_dir):
    return integrity.references(table(spark, sf_dir, "orders"), "03", "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey", "o_orderkey")


@query("SELECT '06' AS rule, CAST(doc_id AS VARCHAR) AS subject, lang AS message FROM documents WHERE lang NOT IN ('en', 'de')")
def check_enums(spark, sf_dir):
    return integrity.members(table(spark, sf_dir, "documents"), "06", "lang", ("en", "de"), "doc_id")


@query("WITH u AS (SELECT user_id, list(CAST(value AS BIGINT) ORDER BY ts, event_id) AS v FROM events GROUP BY 1) SELECT '11' AS rule, CAST(user_id AS VARCHAR) AS subject, 'not in order' AS message FROM u WHERE v <> list_sort(v)")
def check_sorted(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.round("value", 0).cast("long").alias("v")))).alias("x"))
    return integrity.ordered(e, "11", F.transform("x", lambda s: s["v"]), "user_id")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, (SELECT regexp_extract(min(p_name), '^[^ ]+') FROM part))")
def explain_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    word = part.agg(F.min("p_name")).first()[0].split(" ")[0]
    return part.where(F.contains("p_name", F.lit(word))).select("p_partkey", "p_name")


@query()
def array_delta(spark, sf_dir):
    """Order lines by ship date as rules: those before 1995 against those since, aligned by flag within two lines."""
    old = (F.col("l_shipdate") < "1995-01-01").alias("old")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("content"), "l_partkey", old).alias("x"))
    item = lambda s: F.struct(s["key"].alias("key"), s["line"].alias("line"), s["content"].alias("content"))
    side = lambda flag: F.transform(F.filter("x", lambda s: s["old"] == flag), item)
    lines = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))  # each row is collected once, for either side
    return delta.aligned(lines.select("l_orderkey", side(True).alias("b"), side(False).alias("h")), "b", "h").select("l_orderkey", F.size("added").alias("added"), F.size("removed").alias("removed"), F.size("modified").alias("modified"))


# --- extraction, on sources written from the parts table --------------------------------------------------------------


def _sources(spark, sf_dir):
    """A TypeScript file for each part."""
    p, key, size = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    lines = [
        F.concat(F.lit("import { db as base, E"), size, F.lit(" } from './m"), size, F.lit("'")),
        F.concat(F.lit("export class P"), key, F.lit(" {")),
        F.concat(F.lit("  async run(a: string, b = 2): Promise<number> { // "), "p_name"),
        F.concat(F.lit("    if (a === '"), "p_brand", F.lit("') throw new E"), size, F.lit("(`${a}`)")),
        F.concat(F.lit("    const x = await base.find"), size, F.lit("({ a }, (y) => y.trim())")),
        F.concat(F.lit("    for (const z of x) { send("), size, F.lit(") }")),
        F.concat(F.lit("    return x.length + "), size),
        F.lit("  }\n  #hidden() {}\n}"),
        F.concat(F.when(F.col("p_size") > 25, "export ").otherwise(""), F.lit("const f"), key, F.lit(" = (q: number) => q")),
        F.concat(F.lit("app.get('/"), size, F.lit("/:id', f"), key, F.lit(")")),
        F.concat(F.lit("interface I"), key, F.lit(" { a: string }")),
    ]
    return p.select(F.concat(F.lit("p/"), key, F.lit(".ts")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


def _extracted(spark, sf_dir):
    from ..sources import typescript

    return typescript.extract(_sources(spark, sf_dir))


_FILE = "'ts:p/' || p_partkey || '.ts#'"


@query(f"SELECT {_FILE} || 'P' || p_partkey AS id, 'class' AS kind, 'public' AS visibility, 2 AS start_line, 10 AS end_line FROM part UNION ALL SELECT {_FILE} || 'P' || p_partkey || '.run', 'method', 'public', 3, 8 FROM part UNION ALL SELECT {_FILE} || 'P' || p_partkey || '.#hidden', 'method', 'private', 9, 9 FROM part UNION ALL SELECT {_FILE} || 'f' || p_partkey, 'function', CASE WHEN p_size > 25 THEN 'public' ELSE 'internal' END, 11, 11 FROM part UNION ALL SELECT {_FILE} || 'app__get__$' || p_size || '$Zid__d0', 'call', 'internal', 12, 12 FROM part UNION ALL SELECT {_FILE} || 'I' || p_partkey, 'interface', 'internal', 13, 13 FROM part")
def extract_symbols(spark, sf_dir):
    return _extracted(spark, sf_dir).select(F.explode("symbols").alias("s")).select("s.id", "s.kind", "s.visibility", "s.start_line", "s.end_line")


@query(f"WITH r AS (SELECT p_partkey, unnest([struct_pack(type := 'guard', line := 4, text := 'a === ''' || p_brand || ''''), struct_pack(type := 'throw', line := 4, text := 'E' || p_size), struct_pack(type := 'loop', line := 6, text := 'for'), struct_pack(type := 'return', line := 7, text := 'x.length + ' || p_size)]) AS r FROM part) SELECT {_FILE} || 'P' || p_partkey || '.run' AS id, r.type AS type, r.line AS line, r.text AS text FROM r")
def extract_rules(spark, sf_dir):
    s = _extracted(spark, sf_dir).select(F.explode("symbols").alias("s")).where("s.kind = 'method'").select("s.id", F.explode("s.rules").alias("r"))
    return s.select("id", "r.type", "r.line", F.coalesce("r.condition", "r.what", "r.expr", "r.loop_kind").alias("text"))


@query(f"WITH c AS (SELECT p_partkey, unnest([struct_pack(target := 'E' || p_size, line := 4, n := 1, aw := FALSE, nw := TRUE), struct_pack(target := 'base.find' || p_size, line := 5, n := 2, aw := TRUE, nw := FALSE), struct_pack(target := 'y.trim', line := 5, n := 0, aw := FALSE, nw := FALSE), struct_pack(target := 'send', line := 6, n := 1, aw := FALSE, nw := FALSE)]) AS c FROM part) SELECT {_FILE} || 'P' || p_partkey || '.run' AS id, c.target AS target, c.line AS line, c.n AS argument_count, c.aw AS in_await, c.nw AS in_new FROM c")
def extract_calls(spark, sf_dir):
    s = _extracted(spark, sf_dir).select(F.explode("symbols").alias("s")).where("s.kind = 'method'").select("s.id", F.explode("s.calls").alias("c"))
    return s.select("id", "c.target", "c.line", "c.argument_count", "c.in_await", "c.in_new")


@query("SELECT 'p/' || p_partkey || '.ts' AS file, './m' || p_size AS source, 'db as base|E' || p_size AS symbols, 1 AS line FROM part")
def extract_imports(spark, sf_dir):
    from ..sources import typescript

    return typescript.imports(_extracted(spark, sf_dir)).select("file", "source", F.array_join("symbols", "|").alias("symbols"), "line")


@query(f"SELECT {_FILE} || 'P' || p_partkey || '.run' AS id, 'a: string, b: unknown' AS inputs, 'Promise<number>' AS outputs, 'E' || p_size AS throws, TRUE AS async FROM part")
def extract_signatures(spark, sf_dir):
    s = _extracted(spark, sf_dir).select(F.explode("symbols").alias("s")).where("s.name like '%.run'").select("s.id", "s.signature")
    return s.select("id", F.array_join(F.transform("signature.inputs", lambda i: F.concat(i["name"], F.lit(": "), i["type"])), ", ").alias("inputs"), F.array_join("signature.outputs", ", ").alias("outputs"), F.array_join("signature.throws", ", ").alias("throws"), "signature.async")


@query("SELECT s.reason, count(*) AS n FROM (SELECT CASE WHEN source = 'src4' THEN NULL WHEN length(text) > 3000 THEN 'over-size' ELSE 'read' END AS reason FROM (SELECT *, source || '/' || doc_id || CASE WHEN lang = 'fr' THEN '.md' ELSE '.ts' END AS p FROM documents) WHERE lang <> 'fr') s WHERE reason IS NOT NULL GROUP BY 1")
def discover_files(spark, sf_dir):
    """Documents as files; French ones have no known extension, those of src4 lie in a build folder."""
    from ..sources import files

    folder = F.when(F.col("source") == "src4", "dist/src4").otherwise(F.col("source"))
    name = F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "fr", ".md").otherwise(".ts"))
    docs = table(spark, sf_dir, "documents").select(name.alias("spelling"), F.char_length("text").cast("long").alias("length"), F.lit(None).cast("binary").alias("content"))
    found = files.discover(docs, largest=3000)
    return found.files.select(F.lit("read").alias("reason")).unionByName(found.skipped.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


# --- pages and lines --------------------------------------------------------------------------------------------------


@query(f"WITH {SUMMARY} SELECT '+' || added || ' -' || removed || ' ~' || changed || ' ↔' || moved || ' ⇄' || moved_changed || CASE WHEN unknown > 0 THEN ' · ?' || unknown || ' unknown' ELSE '' END AS line FROM s")
def diff_summary_line(spark, sf_dir):
    from .project import summary_line

    return summary_line(diff_summary(spark, sf_dir))


@query(f"WITH {NAMED}, c AS (SELECT bucket, count(*) AS n FROM r WHERE bucket IS NOT NULL GROUP BY 1), o AS (SELECT bucket, n, list_position(['local-scope', 'dynamic', 'ambiguous', 'external', 'no-match'], bucket) AS k FROM c) SELECT 'calls ' || (SELECT count(*) FROM r) || ' · resolved ' || (SELECT count(resolved) FROM r) || ' · unresolved ' || (SELECT count(*) - count(resolved) FROM r) || coalesce(' (' || string_agg(bucket || ' ' || n, ' · ' ORDER BY k) || ')', '') AS line FROM o")
def call_resolution_line(spark, sf_dir):
    from .project import call_resolution_line as line

    return line(call_census(spark, sf_dir))


@query(f"WITH {TWO_STAGES}, c AS (SELECT h.id, b.id AS was, {STATUS} AS status FROM pairs JOIN base b ON b.id = base_id JOIN head h ON h.id = head_id), e AS (SELECT id, was, unnest(CASE WHEN status = 'moved+changed' THEN ['moved+changed', 'changed'] ELSE [status] END) AS section FROM c WHERE status <> 'unchanged') SELECT section, id, '- `' || id || '`' || CASE WHEN was <> id THEN ' (was `' || was || '`)' ELSE '' END AS line FROM e")
def diff_markdown_lines(spark, sf_dir):
    from .project import lines_of_changes

    base, head, pairs = _two_stages(spark, sf_dir)
    full = diff.paired(base.symbols, head.symbols, pairs).where("status <> 'unchanged'")
    return lines_of_changes(full.select(F.col("head_id").alias("id"), "base_id", "status")).select("section", "id", "line")


@query("WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '[:/#.]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM pages), u AS (SELECT DISTINCT split_part(split_part(url, '?', 1), '#', 1) AS id, base FROM b) SELECT id, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '-' || left(sha256(id), 6) ELSE base END AS filename FROM u")
def symbol_filenames(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select(F.substring_index(F.substring_index("url", "?", 1), "#", 1).alias("id")).distinct()
    return aggregates.filenames(u)


@query("SELECT s_suppkey, replace(replace(replace(replace(replace(s_name || ' <a> & \"b\" ]', '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;'), ']', '&#93;') AS label, replace(s_name || '-x', '-', '_') AS node FROM supplier")
def mermaid_escapes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.mermaid_label(F.concat("s_name", F.lit(' <a> & "b" ]'))).alias("label"), text.mermaid_id(F.concat("s_name", F.lit("-x"))).alias("node"))


@query("SELECT p_partkey, '- guard `' || p_name || '` (line ' || p_size || ')' AS guard, '- db.read `' || p_type || '`' || CASE WHEN p_size > 25 THEN ' _(low)_ from a, b' ELSE '' END AS effect, '- `' || p_brand || '` -> x (line 3)' AS call FROM part")
def inline_rows(spark, sf_dir):
    from . import project

    null = F.lit(None).cast("string")
    far = F.col("p_size") > 25
    r = F.struct(F.lit("guard").alias("type"), F.col("p_size").alias("line"), F.col("p_name").alias("condition"), null.alias("what"), null.alias("expr"), null.alias("loop_kind"))
    e = F.struct(F.lit("db.read").alias("id"), F.col("p_type").alias("target"), F.when(far, "low").otherwise("high").alias("confidence"), far.alias("propagated"), F.array(F.lit("a"), F.lit("b")).alias("derived_from"))
    c = F.struct(F.col("p_brand").alias("target"), F.lit("x").alias("resolved"), F.lit(3).alias("line"))
    return table(spark, sf_dir, "part").select("p_partkey", project.rule_row(r).alias("guard"), project.effect_row(e).alias("effect"), project.call_row(c).alias("call"))


# --- deltas and more aggregates ---------------------------------------------------------------------------------------


@query("WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, list_reverse(string_split(p_name, ' ')) || [p_type] AS b FROM part) SELECT p_partkey, 1 AS outputs_added, 0 AS outputs_removed, CAST(len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) AS INTEGER) AS outputs_modified, CAST(len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS INTEGER) AS throws_added FROM p")
def signature_deltas(spark, sf_dir):
    a, b = F.split("p_name", " "), F.concat(F.reverse(F.split("p_name", " ")), F.array("p_type"))
    side = lambda x: F.struct(x.alias("outputs"), x.alias("throws"), F.lit(False).alias("async"), F.lit(False).alias("generator"), F.array().cast("array<string>").alias("type_parameters"))
    d = table(spark, sf_dir, "part").select("p_partkey", delta.signature_delta(side(a), side(b)).alias("d"))
    return d.select("p_partkey", F.size("d.outputs.added").alias("outputs_added"), F.size("d.outputs.removed").alias("outputs_removed"), F.size("d.outputs.modified").alias("outputs_modified"), F.size("d.throws.added").alias("throws_added"))


@query(f"WITH {TWO_STAGES}, f AS (SELECT b.api <> h.api AS a, b.logic <> h.logic AS l, b.syntax <> h.syntax AS s, {STATUS} AS status FROM pairs JOIN base b ON b.id = base_id JOIN head h ON h.id = head_id) SELECT count(*) FILTER (a) AS api_changed, count(*) FILTER (l) AS logic_changed, count(*) FILTER (s) AS syntax_changed FROM f WHERE status IN ('changed', 'moved+changed')")
def delta_axis_counts(spark, sf_dir):
    base, head, pairs = _two_stages(spark, sf_dir)
    full = diff.paired(base.symbols, head.symbols, pairs).where("status in ('changed', 'moved+changed')")
    return gate.axis_counts(full.select(delta.flags(F.col("base"), F.col("head")).alias("flags")))


@query("SELECT n_regionkey AS root, list(DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN 'pnpm' ELSE 'turbo' END ORDER BY CASE WHEN n_nationkey % 3 = 0 THEN 'pnpm' ELSE 'turbo' END) AS tools, arg_min(n_name, n_nationkey) FILTER (n_nationkey % 2 = 0) AS manifest FROM nation GROUP BY 1")
def merged_candidates(spark, sf_dir):
    n = F.col("n_nationkey")
    c = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("root"), F.when(n % 3 == 0, "pnpm").otherwise("turbo").alias("tool"), F.when(n % 2 == 0, F.col("n_name")).alias("manifest"), n.alias("ord"))
    return aggregates.merged_candidates(c)


@query("SELECT 's' || p_size AS id, list(DISTINCT 'db.read ' || p_type ORDER BY 'db.read ' || p_type) AS effects FROM part WHERE p_size > 25 GROUP BY 1")
def boundary_surface(spark, sf_dir):
    """Sizes over 25 stand at a boundary; their effects are their parts' types."""
    kind = "array<struct<id:string,target:string,line:int,plugin:string,confidence:string,derived_by:string,propagated:boolean,derived_from:array<string>>>"
    e = F.struct(F.lit("db.read").alias("id"), F.col("p_type").alias("target"))
    s = table(spark, sf_dir, "part").groupBy("p_size").agg(F.collect_set(e).alias("e"))
    null = F.lit(None)
    wide = F.transform("e", lambda x: F.struct(x["id"].alias("id"), x["target"].alias("target"), null.cast("int").alias("line"), null.cast("string").alias("plugin"), null.cast("string").alias("confidence"), null.cast("string").alias("derived_by"), null.cast("boolean").alias("propagated"), null.cast("array<string>").alias("derived_from"))).cast(kind)
    marks = F.array(F.struct(F.lit("d").alias("name"), F.lit("@d").alias("raw"), F.array().cast("array<string>").alias("arguments"), (F.col("p_size") > 25).alias("boundary"), F.lit(1).alias("line")))
    found = aggregates.boundary_surface(s.select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("id"), F.lit(False).alias("dropped"), marks.alias("decorators"), null.cast("string").alias("ext_kind"), wide.alias("effects")))
    return found.select("id", F.transform("effects", lambda x: F.concat_ws(" ", x["id"], x["target"])).alias("effects"))


@query("SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM customer) AS scc_count, CAST(1 AS BIGINT) AS max_scc_size")
def propagation_stats(spark, sf_dir):
    s = _call_symbols(spark, sf_dir)
    e = _calls(spark, sf_dir).select(F.col("from").alias("u"), F.col("to").alias("v"))
    return graph.propagation_stats(s, graph.strong(s.select("id"), e)).select("scc_count", "max_scc_size")


@query(f"WITH {SNAPSHOTS} SELECT '01 symbol ids' AS rule, id AS subject, count(*) || ' rows' AS message FROM base GROUP BY id HAVING count(*) > 1 UNION ALL SELECT '18 languages declared', id, 'no ts' FROM base")
def integrity_violations(spark, sf_dir):
    """The base snapshot with no language declared."""
    base, _ = adapters.snapshots(spark, sf_dir)
    s = base.symbols
    for c in ("decorators", "rules", "effects", "calls", "derived_by"):
        s = s.withColumn(c, F.array().cast(dict(s.dtypes)[c]))
    comps = spark.createDataFrame([], "id string, roots array<string>")
    deps = spark.createDataFrame([], "`from` string, `to` string, via string")
    langs = spark.createDataFrame([], "language string")
    skipped = base.skips().limit(0)
    stats = spark.range(1).select(F.lit(0).alias("total_files"), F.lit(0).alias("parsed_files"))
    return integrity.violations(s, comps, deps, langs, skipped, stats)


@query("WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS f, o_orderpriority AS t FROM orders) SELECT f AS \"from\", t AS \"to\", 'call' AS via, 'outbound' AS direction, CAST(NULL AS VARCHAR) AS effect FROM e")
def dependency_projection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from"), F.col("o_orderpriority").alias("to"))
    return resolve.dependencies(o)


@query("WITH s AS (SELECT doc_id, lang, source, text FROM documents) SELECT doc_id, CASE WHEN source = 'src1' THEN 'framework:express:route' WHEN source = 'src2' THEN 'framework:express:middleware' WHEN source = 'src3' THEN 'framework:express:error-middleware' WHEN source = 'src4' THEN 'framework:express:mount' WHEN source = 'src5' THEN 'framework:express:router' END AS express, CASE lang WHEN 'en' THEN 'framework:react:hook' WHEN 'de' THEN 'framework:react:component' WHEN 'fr' THEN 'framework:react:provider' ELSE NULL END AS react FROM s")
def framework_shapes(spark, sf_dir):
    """Express by argument shapes, React by names and what is returned."""
    src, lang = F.col("source"), F.col("lang")
    shape = lambda *xs: F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).cast("int").alias("arity")) for k, a in xs))
    args = F.when(src == "src3", shape(("function", 4))).when(src == "src4", shape(("string", None), ("identifier", None))).otherwise(shape(("function", 3)))
    kind = F.when(src == "src5", "const").when(src.isin("src1", "src2", "src3", "src4"), "call").otherwise("class")
    ex = classify.express_symbol(kind, F.lit("x"), F.when(src == "src1", "get").otherwise("use"), args, F.lit("import e from 'express'"), F.when(src == "src5", "express.Router").otherwise(""))
    name = F.when(lang == "en", "useThing").when(lang == "es", "plain").otherwise("Thing")
    calls = F.array().cast("array<struct<target:string>>")
    re_ = classify.react_symbol(F.lit("function"), name, F.lit(True), F.when(lang == "fr", "Ctx.Provider").otherwise("div"), calls, F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", ex["ext_kind"].alias("express"), re_["ext_kind"].alias("react"))


# --- the page of a difference -----------------------------------------------------------------------------------------


def _difference(spark, sf_dir):
    """The first two stages as a difference; changes with equal logic call each other."""
    base, head, pairs = _two_stages(spark, sf_dir)
    pairs = cut(pairs)
    full = cut(diff.paired(base.symbols, head.symbols, pairs))
    left = diff.leftovers(base.symbols, head.symbols, pairs, base.skips(), head.skips())
    deltas = delta.symbol_deltas(full.where("status in ('changed', 'moved+changed')"))
    return diff.Diff(pairs, full, deltas, diff.summary(full, left), None, diff.dependency_changes(base, head), _slices(full), diff.not_compared(base.skips(), head.skips()), (base, head), full, left)


def _page_rows(entries):
    """Entries with their section's name and their lines as one text."""
    name = F.element_at(F.array(*map(F.lit, pages.NAMES)), F.col("section") + 1)
    return entries.select(name.alias("section"), "part", "key", "at", F.array_join("lines", "\n").alias("lines"))


PAIRED = f"{LEFT}, f AS (SELECT h.id AS key, h.name, h.file, b.file AS was, h.dropped, rationale, b.api <> h.api AS a, b.logic <> h.logic AS l, b.syntax <> h.syntax AS s, {STATUS} AS status FROM pairs JOIN base b ON b.id = base_id JOIN head h ON h.id = head_id)"
TITLE = "'### `' || name || '` _(function)_' || chr(10)"
CHANGED = "'- the ' || CASE WHEN a THEN 'api' WHEN l THEN 'logic' ELSE 'syntax' END || ' fingerprint changed, no field did' || chr(10)"
AXES = "array_to_string(list_filter([CASE WHEN a THEN 'api' END, CASE WHEN l THEN 'logic' END, CASE WHEN s THEN 'syntax' END], lambda x: x IS NOT NULL), ', ')"


@query(f"WITH {PAIRED}, c AS (SELECT * FROM f WHERE status IN ('changed', 'moved+changed')) SELECT CASE WHEN a THEN 'api' WHEN l THEN 'logic' ELSE 'syntax' END AS section, 0 AS part, key, 0 AS \"at\", CASE WHEN a OR l THEN {TITLE} || 'File: `' || file || ':1`' || chr(10) || chr(10) || {CHANGED} ELSE '- `' || name || '` (`' || file || ':1`)' END AS lines FROM c UNION ALL SELECT 'moved+changed', 0, key, 0, {TITLE} || 'Moved: `' || was || '` → `' || file || '` (`' || rationale || '`)' || chr(10) || {CHANGED} FROM c WHERE status = 'moved+changed'")
def page_changes(spark, sf_dir):
    return _page_rows(pages.of_deltas(_difference(spark, sf_dir).deltas))


@query(f"WITH {PAIRED} SELECT status AS section, CASE WHEN status = 'moved' OR dropped THEN 0 ELSE 1 END AS part, key, 0 AS \"at\", CASE WHEN status = 'moved' THEN '- `' || name || '`: `' || was || '` → `' || file || '` (`' || rationale || '`)' ELSE '- `' || key || '`' || CASE WHEN dropped THEN ': empty body' ELSE '' END END AS lines FROM f WHERE status IN ('moved', 'dropped-toggled')")
def page_moves(spark, sf_dir):
    return _page_rows(pages.of_pairs(_difference(spark, sf_dir).full))


SLICE_ROWS = "sl AS (SELECT 'slice:' || min(key) AS id, list(key ORDER BY key) AS members FROM f JOIN head ON head.id = key WHERE status NOT IN ('unchanged', 'moved') GROUP BY logic)"
LIVE = f"{PAIRED}, every AS (SELECT *, 'head' AS side FROM base UNION ALL SELECT *, 'base' FROM head), v AS (SELECT r.id, r.status, r.reason, e.name, e.file, e.api, e.logic, e.syntax, 'the ' || absent_from || ' side did not read `' || e.file || '` (' || reason || '), so it ' || CASE WHEN absent_from = 'head' THEN 'may still exist' ELSE 'may not be new' END AS why FROM rest r JOIN every e ON r.id = e.id AND e.side = CASE WHEN r.status = 'removed' THEN 'head' WHEN r.status = 'added' THEN 'base' ELSE absent_from END WHERE NOT r.dropped)"


@query(f"WITH {LIVE} SELECT status AS section, 0 AS part, id AS key, 0 AS \"at\", {TITLE} || 'File: `' || file || ':1`' || chr(10) || CASE WHEN status = 'unknown' THEN 'Why: ' || why || chr(10) ELSE '' END || 'api `' || api || '` · logic `' || logic || '` · syntax `' || syntax || '`' || chr(10) AS lines FROM v")
def page_unpaired(spark, sf_dir):
    return _page_rows(pages.of_left(pages.unpaired(_difference(spark, sf_dir))))


@query(f"WITH {PAIRED}, {SLICE_ROWS}, m AS (SELECT sl.id, len(members) AS size, unnest(members) AS member, generate_subscripts(members, 1) AS pos FROM sl) SELECT 'slices' AS section, CASE WHEN size = 1 THEN 2 ELSE 1 END AS part, id AS key, CAST(pos AS INTEGER) AS \"at\", CASE WHEN size = 1 THEN '- `' || id || '`: `' || name || '` _(' || status || ')_' ELSE '- `' || name || '` _(' || status || ')_, `' || file || ':1`' || chr(10) || '  ↳ ' || CASE WHEN status = 'dropped-toggled' THEN CASE WHEN dropped THEN 'to-dropped' ELSE 'to-kept' END ELSE {AXES} END END AS lines FROM m JOIN f ON f.key = member UNION ALL SELECT 'slices', 1, id, 0, '### `' || id || '` (' || len(members) || ' members)' || chr(10) FROM sl WHERE len(members) > 1 UNION ALL SELECT 'slices', 1, id, {1 << 30}, '' FROM sl WHERE len(members) > 1")
def page_slices(spark, sf_dir):
    d = _difference(spark, sf_dir)
    d.slices = cut(d.slices)  # the page asks for them several times
    return _page_rows(pages.of_slices(d, pages.unpaired(d)))



@query(f"SELECT 'dependencies' AS section, CASE WHEN status = 'added' THEN 0 ELSE 1 END AS part, \"from\" || chr(9) || \"to\" || chr(9) || via AS key, 0 AS \"at\", '- `' || \"from\" || '` → `' || \"to\" || '` (`' || via || '`)' AS lines FROM ({ORACLES['dependency_diff']}) UNION ALL SELECT 'components', CASE status WHEN 'added' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END, x.id, 0, '- `' || x.id || '`' || CASE status WHEN 'added' THEN ': ' || (SELECT string_agg('`' || n_name || '`', ', ' ORDER BY n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = CASE WHEN x.id = 'NEW' THEN 'AFRICA' ELSE x.id END) WHEN 'changed' THEN ': roots' ELSE '' END FROM ({ORACLES['component_diff']}) x UNION ALL SELECT 'not-compared', 0, path, 0, '- `' || path || '`: over-size in base, unreadable in head' FROM ({ORACLES['not_compared']})")
def page_of_the_rest(spark, sf_dir):
    """Dependencies, components and files that neither side read."""
    edges = dependency_diff(spark, sf_dir).withColumn("absent_from", F.lit(None).cast("string")).withColumn("lost", F.array().cast("array<struct<path:string,reason:string>>"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.when(F.col("r_name") == "AFRICA", "NEW").otherwise(F.col("r_name")).alias("id"), "n_name").groupBy("id").agg(F.array_sort(F.collect_list("n_name")).alias("roots"))
    comps = component_diff(spark, sf_dir).join(n, "id", "left")
    return _page_rows(pages.of_dependencies(edges).unionByName(pages.of_components(comps)).unionByName(pages.of_not_compared(not_compared(spark, sf_dir))))


@query("SELECT p_partkey, '- outputs: `' || p_name || '` → `none`' || chr(10) || '- inputs modified: `a: ' || p_type || '`' || chr(10) || CASE WHEN p_size > 25 THEN '- async: toggled' || chr(10) ELSE '' END || '- decorator added: `@raw ' || p_brand || '`' || chr(10) || '- rules modified:' || chr(10) || '  - guard: `' || p_name || '` (line ' || p_size || ')' || chr(10) || '- effects removed:' || chr(10) || '  - db.read `' || p_type || '` _(low)_' || chr(10) || '- calls added:' || chr(10) || '  - `' || p_brand || '` (line 3)' || CASE WHEN p_size > 40 THEN chr(10) || '- visibility: changed' ELSE '' END AS body, CASE WHEN p_size > 40 THEN 'api, visibility' ELSE 'api' END AS axes FROM part")
def page_delta_bodies(spark, sf_dir):
    """A part's columns as what a change gained, lost and changed."""
    name, kind, brand, size = (F.col(f"p_{c}") for c in ("name", "type", "brand", "size"))
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    three = lambda kind, **given: F.struct(*(given.get(how, F.array().cast(kind)).alias(how) for how in ("added", "removed", "modified")))
    rule = F.struct(F.lit("guard").alias("type"), size.cast("int").alias("line"), name.alias("condition"), null.alias("what"), null.alias("expr"), null.alias("loop_kind"))
    effect = F.struct(F.lit("db.read").alias("id"), kind.alias("target"), F.lit(None).cast("int").alias("line"), F.lit("low").alias("confidence"))
    call = F.struct(brand.alias("target"), F.lit(3).alias("line"), null.alias("resolved"))
    mark = F.struct(F.lit("d").alias("name"), F.concat(F.lit("raw "), brand).alias("raw"))
    sig = F.struct(
        three("array<string>", removed=F.array(name)).alias("outputs"), F.struct(none.alias("added"), none.alias("removed")).alias("throws"),
        (size > 25).alias("async_changed"), F.lit(False).alias("generator_changed"), F.lit(False).alias("type_parameters_changed"),
    )
    flags = F.struct(*(c.alias(f"{n}_changed") for n, c in (("api", F.lit(True)), ("logic", F.lit(False)), ("syntax", F.lit(False)), ("component", F.lit(False)), ("visibility", size > 40))))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", sig.alias("signature_delta"), flags.alias("flags"),
        three("array<struct<name:string,type:string>>", modified=F.array(F.struct(F.lit("a").alias("name"), kind.alias("type")))).alias("inputs_delta"),
        three("array<struct<name:string,raw:string>>", added=F.array(mark)).alias("decorators_delta"),
        three("array<struct<type:string,line:int,condition:string,what:string,expr:string,loop_kind:string>>", modified=F.array(rule)).alias("rules_delta"),
        three("array<struct<id:string,target:string,line:int,confidence:string>>", removed=F.array(effect)).alias("effects_delta"),
        three("array<struct<target:string,line:int,resolved:string>>", added=F.array(call)).alias("calls_delta"),
    )
    return rows.select("p_partkey", F.array_join(pages.delta_body(), "\n").alias("body"), pages.axes(F.col("flags")).alias("axes"))
