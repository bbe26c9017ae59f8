"""Rule lookups: effects of calls, frameworks of symbols, what is dropped. Pure column expressions over small fixed tables.

A file's imports stand beside its rows as `imports array<struct<source,symbols,...>>`; every rule is a CASE, so a scan
classifies in one pass without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.paths import basename, extension

EFFECT = "struct<id:string,confidence:string,derived_by:string>"

# Verbs, modules and decorators that the rules look for.
PRISMA_MODULES = ("@prisma/client", "@prisma/client/edge")
PRISMA_READ = ("findUnique", "findUniqueOrThrow", "findFirst", "findFirstOrThrow", "findMany", "count", "aggregate", "groupBy")
PRISMA_WRITE = ("create", "createMany", "createManyAndReturn", "update", "updateMany", "updateManyAndReturn", "upsert", "delete", "deleteMany")
DRIZZLE_ROOT = "drizzle-orm"
DRIZZLE_READ = ("select", "selectDistinct", "selectDistinctOn")
DRIZZLE_WRITE = ("insert", "update", "delete")
DRIZZLE_TRANSACTION = ("transaction", "batch")
DRIZZLE_QUERY = ("findMany", "findFirst")
TRPC_CLIENT = ("@trpc/client", "@trpc/react-query", "@trpc/next")
TRPC_SERVER = ("@trpc/server",)
TRPC_QUERY = ("query", "useQuery", "useInfiniteQuery", "useSuspenseQuery", "useSuspenseInfiniteQuery", "usePrefetchQuery", "usePrefetchInfiniteQuery")
TRPC_MUTATION = ("mutate", "useMutation")
TRPC_SUBSCRIPTION = ("subscribe", "useSubscription")
EMITTER_MODULES = ("@nestjs/event-emitter", "eventemitter2")
EMITTERS = ("eventBus", "EventEmitter2")
NEST_CLASS = {"Module": "module", "Controller": "controller", "Injectable": "provider", "Catch": "filter"}
NEST_HTTP = ("Get", "Post", "Put", "Delete", "Patch", "Options", "Head", "All")
NEST_PATTERN = ("MessagePattern", "EventPattern", "SubscribeMessage")
NEST_HANDLER = ("UseGuards", "UseInterceptors", "UsePipes", "UseFilters")
NEXT_ROLES = ("page", "layout", "template", "loading", "error", "not-found", "route")
NEXT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
NEXT_ROUTE_EXTENSIONS = (".ts", ".js")
NEXT_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD")
EXPRESS_VERBS = ("get", "post", "put", "patch", "delete", "all")
DROPPED_CALLS = ("console.log", "console.info", "console.warn", "console.error", "console.debug", "console.trace", "console.table", "console.dir", "console.group", "console.groupEnd", "process.stdout.write", "process.stderr.write")
EFFECT_IDS = ("db.read", "db.write", "db.transaction", "network.rpc", "event.publish")
FRAMEWORKS = {"@nestjs/core": "nestjs", "next": "nextjs", "react": "react", "vue": "vue", "express": "express", "fastify": "fastify", "koa": "koa", "hono": "hono", "astro": "astro", "svelte": "svelte", "@sveltejs/kit": "svelte", "solid-js": "solid", "@trpc/server": "trpc"}


def imports_from(imports: Column, modules: tuple[str, ...], below: bool = False) -> Column:
    """Whether a source is one of the modules or, with `below`, a path in one."""
    hit = lambda s: F.lit(False) if not modules else s.isin(*modules)
    deep = lambda s: hit(s) | (F.exists(F.array(*map(F.lit, modules)), lambda m: s.startswith(F.concat(m, F.lit("/")))) if below else F.lit(False))
    return F.coalesce(F.exists(imports, lambda i: deep(i["source"])), F.lit(False))


def _effect(id_: str, derived: Column | str) -> Column:
    return F.struct(F.lit(id_).alias("id"), F.lit("high").alias("confidence"), (F.lit(derived) if isinstance(derived, str) else derived).alias("derived_by"))


def prisma(target: Column, imports: Column) -> Column:
    s = F.split(target, r"\.")
    last = F.element_at(s, -1)
    out = F.when((last == "$transaction") & (F.size(s) >= 2), _effect("db.transaction", "prisma:tx"))
    out = out.when((F.size(s) >= 3) & last.isin(*PRISMA_READ), _effect("db.read", "prisma:read")).when((F.size(s) >= 3) & last.isin(*PRISMA_WRITE), _effect("db.write", "prisma:write"))
    return F.when(imports_from(imports, PRISMA_MODULES), out)


def drizzle(target: Column, imports: Column, arguments: Column) -> Column:
    s = F.split(target, r"\.")
    n, last = F.size(s), F.element_at(s, -1)
    roots = (*DRIZZLE_READ, *DRIZZLE_WRITE)
    inside = F.exists(F.slice(s, 2, F.greatest(n - 2, F.lit(0))), lambda x: x.isin(*roots))
    relational = (n >= 4) & (F.get(s, n - 3) == "query") & last.isin(*DRIZZLE_QUERY)
    tx = F.when(arguments < 1, F.raise_error(F.concat(target, F.lit(": a transaction needs an argument"))).cast(EFFECT)).otherwise(_effect("db.transaction", "drizzle:tx"))
    out = F.when(inside | (n < 2), None).when(relational | last.isin(*DRIZZLE_READ), _effect("db.read", "drizzle:read")).when(last.isin(*DRIZZLE_WRITE), _effect("db.write", "drizzle:write")).when(last.isin(*DRIZZLE_TRANSACTION), tx)
    return F.when(imports_from(imports, (DRIZZLE_ROOT,), below=True), out)


def trpc(target: Column, imports: Column) -> Column:
    raw = F.split(target, r"\.")
    s = F.when(F.get(raw, F.lit(0)) == "this", F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0)))).otherwise(raw)
    last = F.element_at(raw, -1)
    family = F.when(last.isin(*TRPC_QUERY), "query").when(last.isin(*TRPC_MUTATION), "mutation").when(last.isin(*TRPC_SUBSCRIPTION), "subscription")
    route = F.array_join(F.slice(s, 2, F.greatest(F.size(s) - 2, F.lit(0))), ".")
    server = (last == "query") & imports_from(imports, TRPC_SERVER, below=True)
    hit = imports_from(imports, TRPC_CLIENT, below=True) & (F.size(s) >= 3) & ~server & family.isNotNull()
    return F.when(hit, _effect("network.rpc", F.concat_ws(":", F.lit("trpc"), family, route)))


def emitter(target: Column, imports: Column) -> Column:
    s = F.split(target, r"\.")
    hit = (F.element_at(s, -1) == "emit") & F.get(s, F.size(s) - 2).isin(*EMITTERS)
    return F.when(imports_from(imports, EMITTER_MODULES) & hit, _effect("event.publish", "nest:emit"))


PLUGINS = {"prisma": prisma, "drizzle": drizzle, "trpc": trpc, "nest": emitter}


def effect(target: Column, imports: Column, arguments: Column, order: tuple[str, ...] = tuple(PLUGINS)) -> Column:
    """The first plugin's answer in the given order: struct<plugin, effect>, or null."""
    answers = []
    for name in order:
        got = PLUGINS[name](target, imports, arguments) if name == "drizzle" else PLUGINS[name](target, imports)
        answers.append(F.when(got.isNotNull(), F.struct(F.lit(name).alias("plugin"), got.alias("effect"))))
    return F.coalesce(*answers) if answers else F.lit(None).cast("struct<plugin:string,effect:struct<id:string,confidence:string,derived_by:string>>")


def dropped_call(target: Column, drop: tuple[str, ...] = DROPPED_CALLS, keep: tuple[str, ...] = ()) -> Column:
    """A target is dropped if it is a prefix or lies below one, unless a kept prefix covers it."""
    under = lambda ps: F.lit(False) if not ps else F.exists(F.array(*map(F.lit, ps)), lambda p: (target == p) | target.startswith(F.concat(p, F.lit("."))))
    return under(drop) & ~under(tuple(k.lstrip("@") for k in keep))


def drop_reason(kind: Column, boundary: Column, empty_body: Column, derived_by: Column, fields_only: Column | None = None, constants_only: Column | None = None) -> Column:
    """Why a symbol is dropped, or null. The core's rules come first, then the language's hints."""
    core = F.when(boundary, None).when(kind == "interface", "interface").when(kind == "type", "type").when(kind.isin("function", "method") & empty_body, "empty body").when(F.array_contains(derived_by, "re-export"), "re-export")
    hint = F.lit(None).cast("string")
    if fields_only is not None:
        pure = F.when(constants_only, "pure constants").otherwise("pure DTO")
        hint = F.when((kind == "class") & fields_only & ~boundary, pure)
    return F.coalesce(core, hint)


def nest_symbol(kind: Column, decorators: Column, imports: Column) -> Column:
    """struct<ext_kind, derived_by, confidence> by the first decorator that counts; a decorator's name is followed through
    aliases; one that comes from elsewhere than @nestjs/ gives medium confidence."""
    scope = lambda s: s.startswith("@nestjs/")
    none = F.array().cast("array<struct<a:struct<imported:string,local:string>,nest:boolean>>")
    names = lambda i: F.coalesce(i["symbols"], F.array().cast("array<string>"))
    bound = F.coalesce(F.flatten(F.transform(imports, lambda i: F.transform(names(i), lambda r: F.struct(text.alias_parts(r).alias("a"), scope(i["source"]).alias("nest"))))), none)
    mine = F.when(kind == "class", F.array(*map(F.lit, NEST_CLASS))).when(kind == "method", F.array(*map(F.lit, (*NEST_HTTP, *NEST_PATTERN, *NEST_HANDLER))))

    def known(d: Column) -> Column:
        of = F.filter(bound, lambda b: b["a"]["local"] == d["name"])
        alias = F.get(of, F.lit(0))
        name = F.when(alias["nest"], alias["a"]["imported"]).otherwise(d["name"])
        return F.struct(name.alias("name"), F.when(alias.isNotNull() & ~alias["nest"], "medium").otherwise("high").alias("confidence"))

    hits = F.filter(F.transform(decorators, known), lambda k: F.array_contains(mine, k["name"]))
    # a route's decorator says more than a guard's
    first = F.coalesce(F.get(F.filter(hits, lambda k: ~k["name"].isin(*NEST_HANDLER)), F.lit(0)), F.get(hits, F.lit(0)))
    role = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NEST_CLASS.items() for x in kv]), first["name"]), F.when(first["name"].isin(*NEST_HTTP, *NEST_PATTERN), "route"))
    ext = F.when(role.isNotNull(), F.concat(F.lit("framework:nestjs:"), role))
    derived = F.concat(F.lit("framework:nestjs:"), F.coalesce(role, F.lit("handler")), F.lit(":"), first["name"])
    return F.when(first.isNotNull(), F.struct(ext.alias("ext_kind"), derived.alias("derived_by"), first["confidence"].alias("confidence")))


def next_symbol(kind: Column, name: Column, file: Column, derived_by: Column) -> Column:
    """An App Router file is a role's name with a fitting extension somewhere below `app`."""
    base = F.regexp_replace(basename(file), r"\.[^.]*$", "")
    parents = F.slice(F.split(file, "/"), 1, F.greatest(F.size(F.split(file, "/")) - 1, F.lit(0)))
    fits = base.isin(*NEXT_ROLES) & F.array_contains(parents, "app") & F.when(base == "route", extension(file).isin(*NEXT_ROUTE_EXTENSIONS)).otherwise(extension(file).isin(*NEXT_EXTENSIONS))
    leaf = text.short_name(name)
    default = (leaf == "<default>") | F.coalesce(F.array_contains(derived_by, "export-default"), F.lit(False))
    route = F.when((base == "route") & leaf.isin(*NEXT_VERBS), F.concat(F.lit("framework:next:route:"), leaf))
    part = F.when((base != "route") & default, F.concat(F.lit("framework:next:"), base))
    derived = F.coalesce(route, part)
    return F.when(fits & (kind == "function") & derived.isNotNull(), F.struct(F.concat(F.lit("framework:next:"), base).alias("ext_kind"), derived.alias("derived_by"), F.lit("high").alias("confidence")))


def module_directive(content: Column) -> Column:
    """`use client` or `use server` among the string statements that begin a file, behind comments. What stands before is
    taken without going back, so no length of blanks or comments is tried twice."""
    lead = r"(?s)^\x{FEFF}?(?:\s++|//[^\n]*+|/\*.*?\*/|(?!['\"]use (?:client|server)['\"])(?:'[^'\n]*+'|\"[^\"\n]*+\")(?:\s*+;|(?=[ \t\r]*(?:\n|$))))*+"
    found = F.regexp_extract(content, lead + r"['\"](use client|use server)['\"]\s*(?:;|\n|$)", 1)
    return F.nullif(found, F.lit(""))


def react_symbol(kind: Column, name: Column, has_jsx: Column, returned: Column, calls: Column, wrapper: Column) -> Column:
    """Hooks, higher-order components, providers and components; constants by what makes them."""
    leaf = text.short_name(name)
    inner = F.exists(calls, lambda c: F.element_at(F.split(c["target"], r"\."), -1).rlike("^use[A-Z]"))
    hook = F.concat(F.lit("framework:react:hook"), F.when(F.coalesce(inner, F.lit(False)), ";hook-call").otherwise(""))
    tag = lambda k: F.struct(F.lit(f"framework:react:{k}").alias("ext_kind"), (hook if k == "hook" else F.lit(f"framework:react:{k}")).alias("derived_by"), F.lit("high").alias("confidence"))
    function = F.when(leaf.rlike("^use[A-Z]"), tag("hook")).when(leaf.rlike("^with[A-Z]"), tag("hoc")).when(leaf.rlike("^[A-Z]") & returned.endswith(".Provider"), tag("provider")).when(leaf.rlike("^[A-Z]") & has_jsx, tag("component"))
    made = F.element_at(F.split(wrapper, r"\."), -1)
    const = F.when(made == "createContext", tag("context")).when(made == "forwardRef", tag("forward-ref")).when(made == "memo", tag("memo"))
    return F.when(kind.isin("function", "method"), function).when(kind == "const", const)


def express_symbol(kind: Column, name: Column, method: Column, arguments: Column, content: Column, initialiser: Column) -> Column:
    """arguments array<struct<kind,arity>>, kind one of string, function, identifier, other."""
    n = F.size(arguments)
    wide = F.exists(arguments, lambda a: (a["kind"] == "function") & (a["arity"] == 4))
    mount = (n == 2) & (F.get(arguments, F.lit(0))["kind"] == "string") & (F.get(arguments, F.lit(1))["kind"] == "identifier")
    ext = F.when((kind == "const") & initialiser.rlike(r"^(?:[\w$]+\.)?Router$"), "router").when(kind == "call", F.when(method.isin(*EXPRESS_VERBS), "route").when(method == "use", F.when(wide, "error-middleware").when(mount, "mount").otherwise("middleware")))
    sure = content.rlike(r"from\s+['\"]express['\"]|require\(\s*['\"]express['\"]\s*\)|import\s+['\"]express['\"]")
    full = F.concat(F.lit("framework:express:"), ext)
    return F.when(ext.isNotNull(), F.struct(full.alias("ext_kind"), full.alias("derived_by"), F.when(sure, "high").otherwise("medium").alias("confidence")))


def merged(symbols: DataFrame, answer: str) -> DataFrame:
    """symbols with a classification column laid in: ext_kind, derived_by parts without repeats, confidence."""
    a = F.col(answer)
    parts = F.array_distinct(F.concat(F.coalesce("derived_by", F.array().cast("array<string>")), F.split(a["derived_by"], ";")))
    hit = a.isNotNull()
    return symbols.withColumn("ext_kind", F.when(hit, a["ext_kind"]).otherwise(F.col("ext_kind"))).withColumn("derived_by", F.when(hit, parts).otherwise(F.col("derived_by"))).withColumn("confidence", F.when(hit, F.coalesce(a["confidence"], F.lit("high"))).otherwise(F.col("confidence"))).drop(answer)
