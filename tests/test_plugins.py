"""Plugins of third parties, and configurations that name them."""

import pytest

from tessera import plugins
from tessera.plans import engine
from tessera.sources import config

EFFECT = '''
from pyspark.sql import functions as F

class Redis:
    manifest = {"name": "effects-redis", "version": "1.0.0", "type": "effects", "provides": {"effectsPrefixes": ["x-redis"]}}
    drop_callees = ("noise",)

    def classify(self, target, imports, argument_count):
        verb = F.element_at(F.split(target, "[.]"), -1)
        return F.when(target.startswith("redis."), F.struct(F.concat(F.lit("x-redis:"), verb).alias("id"), F.lit("medium").alias("confidence"), F.lit("redis").alias("derived_by")))

plugin = Redis()
'''
FRAMEWORK = '''
from pyspark.sql import functions as F

class Jobs:
    manifest = """{"name": "framework-jobs", "version": "0.1.0", "type": "framework", /* c */ "provides": {"extKinds": ["framework:jobs:job"]},}"""
    decorator_boundaries = ("Job",)

    def classify_symbol(self, symbol):
        return F.when(F.exists(symbol["decorators"], lambda d: d["name"] == "Job"), F.struct(F.lit("framework:jobs:job").alias("ext_kind"), F.lit("framework:jobs:job").alias("derived_by"), F.lit("high").alias("confidence")))

default = Jobs()
'''
LANGUAGE = '''
from tessera.sources import typescript

class Script:
    manifest = {"name": "lang-script", "version": "1.0.0", "type": "lang", "provides": {}}
    extensions = (".scr",)
    file_drop_patterns = ("**/*.gen.scr",)

    def extract(self, files):
        return typescript.extract(files)

x = Script()
'''


def test_plugins_of_a_configuration(spark, tmp_path):
    for name, text in {"redis.py": EFFECT, "jobs.py": FRAMEWORK, "script.py": LANGUAGE}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "a.ts").write_text("@Job() export class Nightly { run(x: number) { if (x) return redis.set(x); noise(x); console.log(x) } }\n")
    (tmp_path / "b.scr").write_text("export function f(x) { return redis.get(x) }\n")
    (tmp_path / "c.gen.scr").write_text("export function g(x) { return 1 }\n")
    settings = config.parse('{"languages": ["./script.py"], "frameworks": ["./jobs.py"], "effects": ["./redis.py"], "keep": ["console.log"], "components": [{"id": "a", "roots": ["."]}], "lsp": {}}')
    loaded = plugins.load(settings, tmp_path)
    assert [plugins.name_of(p) for p in (*loaded.lang, *loaded.framework, *loaded.effects)] == ["lang-script", "framework-jobs", "effects-redis"]
    found = engine.scan(spark, str(tmp_path), settings, loaded=loaded)
    rows = {r.name: r for r in found.tables["symbols"].collect()}
    assert {r.id for r in rows.values()} == {"ts:a.ts#Nightly", "ts:a.ts#Nightly.run", "script:b.scr#f"}
    assert rows["Nightly"].ext_kind == "framework:jobs:job" and rows["Nightly"].decorators[0].boundary
    assert [(e.id, e.plugin, e.confidence) for e in rows["f"].effects] == [("x-redis:get", "effects-redis", "medium")]
    assert [c.target for c in rows["Nightly.run"].calls] == ["console.log"]
    assert plugins.undeclared(found.tables["symbols"], loaded.registry).count() == 0 and plugins.undeclared(found.tables["symbols"], config.Registry()).count() == 3


def test_bad_plugins(tmp_path):
    (tmp_path / "redis.py").write_text(EFFECT)
    (tmp_path / "none.py").write_text("x = 1\n")
    (tmp_path / "broken.py").write_text("1 / 0\n")
    for text, said in (
        ('{"frameworks": ["./redis.py"]}', "type effects among framework"), ('{"effects": ["./none.py"]}', "nothing in the module"), ('{"effects": ["./broken.py"]}', "ZeroDivisionError"),
        ('{"effects": ["not-there"]}', "tessera_not_there"), ('{"effects": ["./redis.py", "./redis.py"]}', "twice"),
    ):
        with pytest.raises(config.BadConfig, match=said):
            plugins.load(config.parse(text), tmp_path)
    fine = {"name": "a", "version": "1.0.0", "type": "lang", "provides": {}}
    assert plugins.manifest(fine, "x") == fine
    for wrong in ("{", "[]", {**fine, "name": "A"}, {**fine, "version": "1"}, {**fine, "type": "x"}, {**fine, "provides": {"effects": [1]}}):
        with pytest.raises(plugins.BadPlugin, match="manifest-"):
            plugins.manifest(wrong, "x")


def test_imports_are_checked(spark):
    kind = "file string, source string, symbols array<string>, line int"
    fine = spark.createDataFrame([("a", "./b", ["x as y", "z"], 1), ("a", "./c", None, 2)], kind)
    assert plugins.checked_imports(fine, "p").count() == 2 and [r.source for r in plugins.checked_imports(fine, "p").collect()] == ["./b", "./c"]
    for bad in (("a", "", None, 3), ("a", None, None, 3), ("a", "./b", [""], 3)):
        with pytest.raises(Exception, match="line 3"):
            plugins.checked_imports(spark.createDataFrame([bad], kind), "p").collect()
