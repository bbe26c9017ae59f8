"""Integrity rules of a snapshot as queries. Each gives violations(rule, subject, message); none means the rule holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.paths import violation
from ..functions.text import nfc
from ..schema import CONFIDENCE, KINDS

#: Effects of the core vocabulary; all others begin with x-.
EFFECTS = (
    "db.read", "db.write", "db.transaction", "db.migration", "network.http", "network.ws", "network.rpc", "queue.publish", "queue.consume", "event.publish", "event.subscribe",
    "fs.read", "fs.write", "state.mutate", "collection.mutate", "time.now", "time.timer", "random", "env.read", "env.write", "process.exit", "process.signal",
)


def _found(df: DataFrame, rule: str, subject: Column, message: Column | str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def unique(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    return _found(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), rule, F.concat_ws(" ", *keys), F.concat(F.col("n").cast("string"), F.lit(" rows")))


def references(df: DataFrame, rule: str, column: str, targets: DataFrame, key: str, subject: str) -> DataFrame:
    """Values of `column` that are no key of targets; nulls refer to nothing."""
    lost = df.where(F.col(column).isNotNull()).join(targets.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return _found(lost, rule, F.col(subject), F.concat(F.lit("no "), F.col(column).cast("string")))


def members(df: DataFrame, rule: str, column: str, allowed: tuple[str, ...], subject: str) -> DataFrame:
    return _found(df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))), rule, F.col(subject), F.coalesce(F.col(column), F.lit("null")))


def matches(df: DataFrame, rule: str, fine: Column, subject: str, message: str) -> DataFrame:
    return _found(df.where(~F.coalesce(fine, F.lit(False))), rule, F.col(subject), message)


def ordered(df: DataFrame, rule: str, array: Column, subject: str) -> DataFrame:
    return _found(df.where(array != F.array_sort(array)), rule, F.col(subject), "not in order")


def normal(df: DataFrame, rule: str, columns: list[str], subject: str) -> DataFrame:
    bad = None
    for c in columns:
        one = _found(df.where(F.col(c).isNotNull() & (nfc(F.col(c)) != F.col(c))), rule, F.col(subject), f"{c} is not in normal form")
        bad = one if bad is None else bad.unionByName(one)
    return bad


def shape(symbols: DataFrame) -> DataFrame:
    """Fields that every symbol must have."""
    need = ("id", "kind", "name", "language", "visibility", "confidence", "dropped", "source", "fingerprint", "decorators", "rules", "effects", "calls", "derived_by")
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in need)))
    return _found(symbols.where(F.size(missing) > 0), "20 shape", F.coalesce("id", F.lit("?")), F.concat(F.lit("missing "), F.array_join(missing, ", ")))


def of_rows(symbols: DataFrame) -> DataFrame:
    """The rules that a symbol keeps or breaks by itself, all in one pass."""
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    lines = lambda c: F.transform(F.filter(c, lambda x: x["line"].isNotNull()), lambda x: x["line"])
    unsorted = lambda a: a != F.array_sort(a)
    propagated = lambda e: F.coalesce(e["propagated"], F.lit(False))
    far = F.transform(F.filter("effects", propagated), lambda e: F.struct(e["id"], e["target"]))
    first_far = F.array_position(F.transform("effects", lambda e: propagated(e).cast("int")), 1)
    mixed = F.exists(F.slice("effects", F.greatest(first_far, F.lit(1)).cast("int"), F.size("effects")), lambda e: ~propagated(e)) & (first_far > 0)
    path = violation(F.col("source.file"), True)
    one = lambda rule, message: F.struct(F.lit(rule).alias("rule"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
    checks = [
        ("05 drop reason", F.col("dropped") & F.col("drop_reason").isNull(), "no reason"),
        ("06 confidence", bad(F.col("confidence").isin(*CONFIDENCE)), F.coalesce("confidence", F.lit("null"))),
        ("08 kind", bad(F.col("kind").isin(*KINDS)), F.coalesce("kind", F.lit("null"))),
        ("09 extKind", F.col("ext_kind").isNotNull() & bad(F.col("ext_kind").rlike(ids.EXT_KIND)), "malformed extKind"),
        ("10 paths", path.isNotNull(), path),
        *((f"11 order of {c}", unsorted(lines(c)), "not in order") for c in ("decorators", "rules", "effects", "calls")),
        ("11 order of propagated effects", unsorted(far), "not in order"),
        ("11 local effects first", mixed, "a local effect behind a propagated one"),
        ("16 reserved namespace", F.col("id").startswith("slice:"), "slice: is reserved"),
        ("17 id grammar", bad(ids.is_symbol_id(F.col("id"))), "malformed id"),
        *(("19 normal form", nfc(F.col(c)) != F.col(c), f"{c} is not in normal form") for c in ("id", "name")),
    ]
    effects = F.transform(F.filter("effects", lambda e: bad(e["id"].isin(*EFFECTS) | e["id"].startswith("x-"))), lambda e: one("07 effect vocabulary", "unknown effect"))
    found = F.flatten(F.array_compact(F.array(F.array_compact(F.array(*(F.when(c, one(rule, message)) for rule, c, message in checks))), effects)))
    return symbols.select(F.col("id").alias("subject"), F.explode(found).alias("v")).select("v.rule", "subject", "v.message")


def violations(symbols: DataFrame, components: DataFrame, dependencies: DataFrame, languages: DataFrame, skipped: DataFrame, stats: DataFrame, census: DataFrame | None = None) -> DataFrame:
    """Every rule. Shape comes first and, where it fails, alone. stats: one row with total_files and parsed_files; census:
    one row with total and resolved."""
    first = shape(symbols)
    if not first.isEmpty():
        return first
    kept = symbols.where("not dropped")
    calls = dependencies.where("via = 'call'")
    resolved = kept.select("id", F.explode("calls").alias("c")).where("c.resolved is not null").select(F.col("id").alias("from"), F.col("c.resolved").alias("to")).distinct()
    ends = dependencies.select(F.explode(F.array("from", "to")).alias("end")).distinct().where(ids.looks_like_symbol(F.col("end")))
    paths = components.select("id", F.explode("roots").alias("p")).unionByName(skipped.select(F.col("path").alias("id"), F.col("path").alias("p")))
    why = violation(F.col("p"))
    parts = [
        of_rows(symbols),
        unique(symbols, "01 symbol ids", "id"),
        unique(components, "02 component ids", "id"),
        references(symbols, "03 component exists", "component", components, "id", "id"),
        references(ends, "04 endpoints exist", "end", symbols, "id", "end"),
        _found(paths.where(why.isNotNull()), "10 paths", F.col("id"), why),
        *(_found(calls.join(kept.select(F.col("id").alias(e)), e, "left_anti"), f"12 call {e} kept", F.col(e), "not a kept symbol") for e in ("from", "to")),
        unique(dependencies, "13 dependencies", "from", "to", "via"),
        _found(resolved.join(calls.select("from", "to"), ["from", "to"], "left_anti"), "14 call has edge", F.concat_ws(" ", "from", "to"), "no dependency"),
        _found(calls.join(resolved, ["from", "to"], "left_anti"), "14 edge has call", F.concat_ws(" ", "from", "to"), "no resolved call"),
        references(symbols, "18 languages declared", "language", languages, "language", "id"),
        _census(skipped, stats),
    ]
    if census is not None:
        real = kept.select(F.explode("calls").alias("c")).agg(F.count("*").alias("n"), F.count("c.resolved").alias("r"))
        parts.append(_found(census.join(real).where("total <> n or resolved <> r"), "15 call census", F.lit("stats"), "differs from the calls"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _census(skipped: DataFrame, stats: DataFrame) -> DataFrame:
    s = skipped.agg(F.count("*").alias("n"), F.count_distinct("path").alias("d"))
    both = stats.withColumn("one", F.lit(1)).join(s.withColumn("one", F.lit(1)), "one")
    return _found(both.where("parsed_files > total_files or n <> total_files - parsed_files or n <> d"), "21 skipped census", F.lit("stats"), "counts disagree")
