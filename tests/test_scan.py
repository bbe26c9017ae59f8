"""A small project through scan, diff, explain and the pages."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import gate
from tessera.plans import engine, project
from tessera.sources import config, documents, files, typescript
from tessera.sources.typescript import File

SERVICE = '''import { Injectable } from "@nestjs/common"
import { PrismaClient } from "@prisma/client"
import { log as write } from "./util"

/** Bills. @throws {BillError} */
@Injectable()
export class Billing {
  private total = 0
  constructor(private readonly db: PrismaClient) {}
  async refund(id: string, cents: number): Promise<Bill> {
    const bill = await this.db.bill.findUnique({ where: { id } })
    if (bill === null) throw new BillError(`no ${id}`)
    for (const x of bill.rows) {
      write(x)
    }
    try { await this.db.bill.update({ id }) } catch (e) { write(e) }
    console.log("done")
    return bill.total - cents
  }
  static make() { return new Billing(null) }
}
export const helper = (a: number, b = 2) => a + b
export interface Shape { a: string }
export class Dto { readonly kind = "x"; name: string }
'''
UTIL = '''export function log(x: unknown): void { if (!x) { return } send(x) }
function send(x) { while (x.more()) x.next(); }
export default function () { return log(1) }
app.get("/users/:id", (req, res) => res.send(1))
app.use((err, req, res, next) => next())
'''


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    out = []
    for side in ("base", "head"):
        root = tmp_path_factory.mktemp(side)
        (root / "src").mkdir()
        (root / "node_modules").mkdir()
        (root / ".gitignore").write_text("gen/\n")
        (root / "src/billing.ts").write_text(SERVICE if side == "base" else SERVICE.replace("bill === null", "bill == null"))
        (root / ("src/util.ts" if side == "base" else "src/tool.ts")).write_text(UTIL)
        (root / "src/broken.ts").write_text("function (")
        (root / "src/big.ts").write_text("x" * 5000)
        (root / "node_modules/a.ts").write_text("export const x = 1")
        (root / "notes.md").write_text("no")
        out.append(engine.scan(spark, str(root), config.parse('{"components": [{"id": "app", "roots": ["src"]}], "maxFileSizeBytes": 4000,}')))
    return out


def test_extraction():
    f = File("src/billing.ts", SERVICE)
    by = {s["name"]: s for s in f.symbols}
    assert set(by) == {"Billing", "Billing.constructor", "Billing.refund", "Billing::make", "helper", "Shape", "Dto"}
    r = by["Billing.refund"]
    assert r["signature"]["inputs"] == [{"name": "id", "type": "string"}, {"name": "cents", "type": "number"}] and r["signature"]["outputs"] == ["Promise<Bill>"] and r["signature"]["async"]
    assert [(x["type"], x["condition"] or x["what"] or x["expr"] or x["loop_kind"]) for x in r["rules"]] == [("guard", "bill === null"), ("throw", "BillError"), ("loop", "for"), ("try", None), ("return", "bill.total - cents")]
    assert [c["target"] for c in r["calls"]] == ["this.db.bill.findUnique", "BillError", "write", "this.db.bill.update", "console.log"]
    assert by["Billing"]["decorators"][0]["name"] == "Injectable" and by["Billing::make"]["derived_by"] == ["static-method"] and by["Dto"]["fields_only"] and not by["Dto"]["constants_only"]
    assert by["helper"]["signature"]["inputs"] == [{"name": "a", "type": "number"}, {"name": "b", "type": "unknown"}] and by["helper"]["kind"] == "function"
    u = {s["name"]: s for s in File("src/util.ts", UTIL).symbols}
    assert {"log", "send", "<default>", "app__get__$users$Zid__d0", "app__use__d0"} == set(u) and u["app__use__d0"]["argument_shapes"] == [{"kind": "function", "arity": 4}]
    assert [(i["source"], i["symbols"]) for i in f.imports] == [("@nestjs/common", ["Injectable"]), ("@prisma/client", ["PrismaClient"]), ("./util", ["log as write"])]


def test_scan(scanned):
    t = scanned[0].tables
    rows = {r.name: r for r in t["symbols"].collect()}
    assert rows["Billing"].ext_kind == "framework:nestjs:provider" and rows["Billing"].decorators[0].boundary and rows["Billing"].component == "app"
    refund = rows["Billing.refund"]
    assert [(e.id, e.target) for e in refund.effects if not e.propagated] == [("db.read", "this.db.bill.findUnique"), ("db.write", "this.db.bill.update")]
    assert {c.target: c.resolved for c in refund.calls} == {"BillError": None, "write": "ts:src/util.ts#log"}
    assert rows["Shape"].dropped and rows["Shape"].drop_reason == "interface" and rows["Dto"].drop_reason == "pure DTO" and rows["Shape"].fingerprint.api == "0" * 12
    assert {r.path: r.reason for r in t["skipped"].collect()} == {"src/broken.ts": "parse-failed", "src/big.ts": "over-size"}
    assert {(r["from"], r.to) for r in t["dependencies"].collect()} >= {("ts:src/billing.ts#Billing.refund", "ts:src/util.ts#log"), ("ts:src/util.ts#log", "ts:src/util.ts#send")}
    assert rows["app__use__d0"].ext_kind == "framework:express:error-middleware" and rows["app__get__$users$Zid__d0"].ext_kind == "framework:express:route"


def test_diff_and_pages(spark, scanned):
    base, head = (s.tables for s in scanned)
    renames = documents.renames(spark.createDataFrame([("R100\tsrc/util.ts\tsrc/tool.ts",), ("M\tx",)], "value string"))
    d = engine.compare(base, head, renames)
    got = {(r.status, r.id.split("#")[1]) for r in d.changes.collect()}
    assert ("changed", "Billing.refund") in got and ("moved", "log") in got and not any(s in ("added", "removed") for s, _ in got)
    page = project.diff_markdown(d.changes, d.summary)
    assert "## Changed" in page and "- `ts:src/billing.ts#Billing.refund`" in page and "<details>" in page
    one = next(r for r in d.deltas.collect() if r.head_id.endswith("#Billing.refund"))
    assert [x.condition for x in one.rules_delta.modified] == ["bill == null"] and one.flags.logic_changed and not one.flags.api_changed
    assert gate.first_tripped(gate.evaluate(gate.parse("added,changed"), d.summary)).first().clause == "changed"
    assert "db.read" in project.workspace_markdown(base) and "Called by" in project.symbol_markdown(base, "ts:src/util.ts#log")
    assert "src/billing.ts" in project.component_markdown(base, "app")
    assert engine.explain(base, "refund") == ("single", ["ts:src/billing.ts#Billing.refund"]) and engine.explain(base, "src/big.ts")[0] == "unknown" and engine.explain(base, "nothing")[0] == "not-found"


def test_full_page_and_document_of_a_difference(spark, scanned, tmp_path):
    import json

    from tessera.plans import incidents, pages

    base, head = (s.tables for s in scanned)
    d = engine.compare(base, head)
    pages.save(d, str(tmp_path / "page.md"), "a", "b")
    page = (tmp_path / "page.md").read_text()
    assert page.startswith("# Semantic diff: a..b") and "- rules modified:\n  - guard: `bill == null` (line 12)" in page
    assert page.index("## Logic changes") < page.index("## Slices") < page.index("## Not compared") and "- `src/big.ts`: over-size on both sides" in page
    assert page.count("<details>") == page.count("</details>") and "unresolved call" in page
    pages.write(d, str(tmp_path / "page"), "a", "b")
    written = "".join(p.read_text() for p in sorted((tmp_path / "page").glob("part-*")))
    assert written == page
    text = documents.write_canonical_diff(d, str(tmp_path / "d.json"), "v1", "a", "b")
    doc = json.loads(text)
    assert {s["id"].split("#")[1] for s in doc["symbols"] if s["status"] == "changed"} == {"Billing", "Billing.refund"} and doc["summary"]["changed"] == 2 and {"src/big.ts", "src/broken.ts"} == {f["path"] for f in doc["notCompared"]}
    refund = next(s for s in doc["symbols"] if s["id"].endswith("#Billing.refund"))
    assert refund["delta"]["rules"]["modified"][0]["condition"] == "bill == null" and refund["before"]["id"] == refund["id"]
    assert documents.write_canonical_diff(d, str(tmp_path / "e.json"), "v1", "a", "b") == text
    assert [line.split(":")[0] for line in incidents.of_scan(base, scanned[0].withdrawn, label="base")] == ["base", "base"]
    assert incidents.of_comparison({"base": base, "head": head}, d.not_compared) == ["2 file(s) were read by neither side: src/big.ts, src/broken.ts"]
    assert incidents.doubt(base["stats"], base["skipped"]).first().n == 2 and incidents.doubt(base["stats"], None).first().kind == "unnamed-losses"
    with pytest.raises(engine.Unsound, match="18 languages|03 component"):
        engine.check(engine.Scan({**base, "components": base["components"].limit(0)}, *([None] * 5)))


def test_rendered_configuration():
    text, unmapped = config.rendered([{"id": "a", "name": "A", "roots": ["z", "b"], "languages": ["ts", "go"], "frameworks": None, "public_api": None}])
    assert config.parse(text).components == [{"id": "a", "name": "A", "roots": ["b", "z"]}] and unmapped == {"languages": ["go"], "frameworks": []}


def test_explain_lists_every_match(spark):
    symbols = spark.range(1500).selectExpr("format_string('ts:a.ts#f%04d', id) as id", "concat('f', id) as name", "named_struct('file', 'a.ts') as source")
    tables = {"symbols": symbols, "skipped": spark.createDataFrame([], "path string, reason string")}
    assert engine.explain(tables, "f") == ("ambiguous", [f"ts:a.ts#f{i:04}" for i in range(1500)])


def test_documents(spark, scanned, tmp_path):
    t = scanned[0].tables
    text = documents.write_canonical(t, str(tmp_path / "a.json"), "v1", pretty=True)
    again = documents.read(spark, str(tmp_path / "a.json"), "v1")
    assert sorted(r.id for r in again["symbols"].collect()) == sorted(r.id for r in t["symbols"].collect())
    assert documents.write_canonical(again, str(tmp_path / "b.json"), "v1", pretty=True) == text
    with pytest.raises(documents.BadDocument):
        documents.read(spark, str(tmp_path / "a.json"), "v2")
    documents.write_tables(t, str(tmp_path / "tables"))
    assert documents.read_tables(spark, str(tmp_path / "tables"))["symbols"].count() == t["symbols"].count()


def test_config_and_files(spark, tmp_path):
    assert config.parse('// c\n{"ignore": ["a//b"], /* x */ "lineFuzz": 3,}').line_window == 3
    for bad in ("[", "[]", '{"x": 1}', '{"components": [{"id": "a"}, {"id": "a"}]}', '{"lineFuzz": 11}'):
        with pytest.raises(config.BadConfig):
            config.parse(bad)
    (tmp_path / "pnpm-workspace.yaml").write_text("packages:\n  - 'apps/*'\n  - libs/** # x\nother: 1\n")
    (tmp_path / "package.json").write_text('{"workspaces": ["x/*"]}')
    (tmp_path / "yarn.lock").write_text("")
    (tmp_path / "a/b").mkdir(parents=True)
    assert [(m["tool"], m["patterns"]) for m in config.managers(tmp_path)] == [("pnpm", ["apps/*", "libs/**"]), ("yarn", ["x/*"])]
    assert config.workspace_root(tmp_path / "a/b") == tmp_path and config.find(tmp_path / "a/b") is None
    assert config.public_api({"main": "./dist/a.js", "exports": {".": {"import": "./b.mjs"}}}) == ["b.mjs", "dist/a.js"]
    assert config.frameworks({"dependencies": {"next": "1"}, "devDependencies": {"react": "1", "z": "1"}}) == ["nextjs", "react"]
    r = config.Registry()
    r.register({"name": "a", "provides": {"extKinds": ["framework:x:y"], "extKindsPrefixes": ["framework:x"]}})
    assert r.owner("extKinds", "framework:x:z") == "a"
    for bad in ({"name": "a"}, {"name": "b", "provides": {"extKinds": ["framework:x:q"]}}, {"name": "c", "provides": {"extKindsPrefixes": ["framework:x:y"]}}, {"name": "d", "provides": {"effectsPrefixes": ["db"]}}, {"name": "e", "provides": {"extKinds": ["core:x"]}}):
        with pytest.raises(config.BadConfig):
            r.register(bad)
    assert config.hint_manifest([]) is None
    r.register(config.hint_manifest([{"name": "framework:mine"}]))
    assert r.owner("extKinds", "framework:hint:mine") == config.HINTS
    with pytest.raises(files.Ambiguous):
        files.Router({"a": (".ts",), "b": (".TS",)})
    tree = spark.createDataFrame([("é.ts", 1), ("é.ts", 1), ("ok.ts", 1), (".hidden/x.ts", 1), ("a.d.ts", 1)], "spelling string, length long").selectExpr("*", "cast('' as binary) as content")
    found = files.discover(tree)
    assert [r.path for r in found.files.collect()] == ["ok.ts"] and found.colliding.first().path == "é.ts"


def test_component_detection(spark, tmp_path):
    import json

    from tessera.sources import components

    def detect(files, tools, folder="My Repo"):
        paths = spark.createDataFrame([(p,) for p in files], "path string")
        manifests = spark.createDataFrame([(p, t) for p, t in files.items() if t is not None], "path string, text string")
        return [tuple(r) for r in components.detect(paths, manifests, tools, folder).collect()]

    many = lambda root, e, n=10: {f"{root}/f{i}.{e}": None for i in range(n)}
    files = {
        "package.json": json.dumps({"name": "whole"}),
        "apps/web/package.json": json.dumps({"name": "@x/Web_App", "dependencies": {"next": "1", "react": "1"}, "exports": {".": ["./a.js", {"import": "./b.js"}]}, "main": "./a.js"}),
        "apps/api#1/package.json": "not json",
        "apps/shared/x.txt": None,
        "libs/shared/package.json": json.dumps({"name": "shared"}),
        "libs/one/shared/package.json": json.dumps({"name": "shared"}),
        "apps/web/node_modules/m/package.json": json.dumps({"name": "m"}),
        "apps/.hidden/package.json": json.dumps({"name": "h"}),
        **many("apps/web", "ts", 12), **many("apps/web/a/b", "py"), **many("apps/web/a/b/c", "go"), **many("apps/web/dist", "rs"), **many("libs/shared", "js", 9),
    }
    tools = [{"tool": "pnpm", "patterns": ["./apps/*", "libs/**", "!libs/one"]}, {"tool": "turbo", "patterns": []}]
    got = detect(files, tools)
    assert [(r[0], r[1], r[2]) for r in got] == [("api-1", "api#1", ["apps/api#1"]), ("shared-apps", "shared", ["apps/shared"]), ("shared-libs", "shared", ["libs/shared"]), ("shared-one", "shared", ["libs/one/shared"]), ("web-app", "@x/Web_App", ["apps/web"])]
    assert got[-1][3:6] == (["a.js", "b.js"], ["py", "ts"], ["nextjs", "react"]) and got[2][3:6] == (None, ["ts"], None)
    assert [r[:3] for r in detect(files, [])] == [("whole", "whole", ["."])]
    assert [r[:3] for r in detect({"a.ts": None}, [{"tool": "nx", "patterns": []}])] == [("my-repo", "My Repo", ["."])]
    nx = detect({"p/q/project.json": json.dumps({"name": "Q"}), "p/dist/project.json": "{}"}, [{"tool": "nx", "patterns": []}])
    assert [r[:3] for r in nx] == [("q", "Q", ["p/q"])]
    with pytest.raises(config.BadConfig, match="outside"):
        detect(files, [{"tool": "npm", "patterns": ["../other"]}])
    with pytest.raises(config.BadConfig, match="invalid-component-id"):
        detect({"a.ts": None}, [], "###")


def test_scan_detects_components(spark, tmp_path):
    for path, text in {"package.json": '{"workspaces": ["packages/*"]}', "packages/a/package.json": '{"name": "@o/a"}', "packages/a/src/x.ts": "export function f() { return g(1) }", "packages/b/y.ts": "export function g(x: number) { if (x) throw new E(); }", "z.ts": "export function h() { g() }"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = engine.scan(spark, str(tmp_path))
    assert {(r.source.file, r.component) for r in found.tables["symbols"].collect()} == {("packages/a/src/x.ts", "a"), ("packages/b/y.ts", "b"), ("z.ts", None)}
    assert [(r.id, r.roots) for r in found.tables["components"].collect()] == [("a", ["packages/a"]), ("b", ["packages/b"])] and found.withdrawn.count() == 0


def test_extraction_of_one_small_file_of_texts_uses_all_cores(spark):
    texts = spark.range(600).selectExpr("concat('p/', id, '.ts') as path", "concat('export const f', id, ' = (q: number) => q') as text").coalesce(1)
    found = typescript.extract(texts)
    tasks = {r.path: r.task for r in found.select("path", F.spark_partition_id().alias("task")).collect()}
    assert len(tasks) == 600 and len(set(tasks.values())) >= spark.sparkContext.defaultParallelism
    assert {r.id for r in found.select(F.explode("symbols.id").alias("id")).collect()} == {f"ts:p/{i}.ts#f{i}" for i in range(600)}
