import pytest
from pyspark.sql import functions as F

from tessera.functions import canonical, fingerprint, ids, paths, text


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def apply(spark, values, f):
    return [r.x for r in col(spark, values).select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    got = apply(spark, ["InvoiceService.createInvoice", "getUser", "HTTPServer", "a1b2", "größeÄnderung", "a::b_c-d e/f", "", None], text.tokens)
    assert got == [["invoice", "service", "create"], ["get", "user"], ["httpserver"], ["a", "1", "b", "2"], ["größeänderung"], ["a", "b", "c", "d", "e", "f"], [], None]


@pytest.mark.parametrize(("a", "b", "want"), [("UserRepo.getUser", "UserRepos.getUser", True), ("EntityStore.findById", "EntitiesStore.findById", True), ("Users.UserRepo.getUser", "Users.UserRepos.getUser", True), ("UserRepo.getUser", "AdminRepo.getUser", False), ("RepoManager.load", "ReportManager.load", False), ("main", "main", True), ("A.f", "f", False), ("BoxRepo.f", "BoxesRepo.f", True)])
def test_owners(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(text.owners_compatible(F.col("a"), F.col("b"))).first()[0] == want


def test_segments(spark):
    names = ["a.b.c", "A::b.c", "f", "A.b::c"]
    assert apply(spark, names, text.last_segment) == ["c", "b.c", "f", "c"]
    assert apply(spark, names, text.owner) == ["a.b", "A", "", "A.b"]
    assert apply(spark, names, text.short_name) == ["c", "c", "f", "c"]


def test_jaccard_and_signatures(spark):
    s = "struct<inputs:array<struct<name:string,type:string>>,outputs:array<string>,throws:array<string>>"
    sig = lambda t, o=(), e=(): ([("x", v) for v in t], list(o), list(e))
    df = spark.createDataFrame([(1, sig(["a", "b"]), sig(["a", "c"])), (2, None, None), (3, sig([]), None), (4, sig(["a"]), sig([])), (5, sig(["a"], ["r"], ["E"]), sig(["a"], ["r"], ["E", "F"]))], f"i int, a {s}, b {s}")
    got = [r[0] for r in df.orderBy("i").select(text.signature_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx((0.5 + 1 + 1) / 3), 1.0, 0.0, pytest.approx(2 / 3), pytest.approx((1 + 1 + 0.5) / 3)]
    sets = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, pytest.approx(1 / 3)]


def test_paths(spark):
    assert apply(spark, ["a/b.ts", "../x", "a/./b", "/a", "a\\b", "", ".", "a:b", "C:/x"], paths.violation) == [None, "parent-segment", "dot-segment", "absolute", "backslash", "empty", None, None, "absolute"]
    assert apply(spark, ["a:b", "a#b"], lambda c: paths.violation(c, True)) == ["separator", "separator"]
    assert apply(spark, ["./x", "../x", "../../x", "b//c/."], lambda c: paths.join_posix(F.lit("a"), c)) == ["a/x", "x", None, "a/b/c"]
    hits = lambda ps: apply(spark, ["src/a.ts", "a.d.ts", "x/node_modules/y/z.js", "dist/a.js", "lib/dist/k"], lambda c: paths.matches_any(c, ps))
    assert hits(["**/node_modules/**", "**/*.d.ts", "**/dist/**"]) == [False, True, True, True, True]
    assert hits(["**/*.{ts,js}", "!src/**"]) == [False, True, True, True, False]
    assert paths.gitignore_patterns("# c\n\nbuild/\n/top\n!keep.ts\n") == ["**/build/**", "top", "!**/keep.ts"]


def test_ids(spark):
    values = ["ts:src/a.ts#A.b", "ts:src/a.ts#A::b", "ts:a#<default>", "slice:a#b", "TS:a#b", "ts:../a#b", "ts:a", "ts:a#1x", "ts:a#A.#p"]
    assert apply(spark, values, ids.is_symbol_id) == [True, True, True, False, False, False, False, False, True]
    assert apply(spark, ["ts:a/b.ts#f", "component"], ids.file_of) == ["a/b.ts", None]
    assert apply(spark, ["ts:a.ts#f", "ts:c.ts#f"], lambda c: ids.with_file(c, F.lit("a.ts"), F.lit("b.ts"))) == ["ts:b.ts#f", None]


def test_fingerprints(spark):
    assert apply(spark, ["{}", '(function_declaration (identifier "foo"))'], fingerprint.syntax) == ["44136fa355b3", "5bae34d2c0a4"]
    with pytest.raises(Exception, match="needs text"):
        apply(spark, [" "], fingerprint.syntax)


def test_canonical():
    assert canonical.serialize({"b": 1, "a": [None, 2.0], "x": canonical.ABSENT, "e\u0301": "e\u0301"}) == '{"a":[null,2],"b":1,"\u00e9":"\u00e9"}'
    assert canonical.serialize({"\U0001f600": 1, "\uffee": 2}) == '{"\U0001f600":1,"\uffee":2}'
    for bad in (float("nan"), {1: 2}, {"\u00e9": 1, "e\u0301": 2}, {1, 2}):
        with pytest.raises(canonical.NotCanonical):
            canonical.serialize(bad)


def test_order_by_code_units(spark):
    df = col(spark, ["\uffee", "\U0001f600"])
    assert [r.v for r in df.orderBy(text.utf16_key(F.col("v"))).collect()] == ["\U0001f600", "\uffee"]


def test_small_text(spark):
    assert apply(spark, ["MyPkg_name two", "@scope/FooBar"], text.id_from_npm_name) == ["my-pkg-name-two", "foo-bar"]
    assert apply(spark, ["ts:src/a.ts#A.b", "--x::"], text.sanitized) == ["ts-src-a-ts-A-b", "x"]
    assert apply(spark, ['a<"b">]&\n'], text.mermaid_label) == ["a&lt;&quot;b&quot;&gt;&#93;&amp; "]
    assert apply(spark, [" a \n b "], text.collapsed) == ["a b"] and apply(spark, ["(a > b)"], text.strip_parens) == ["a > b"]
    assert apply(spark, ["e\u0301"], text.nfc) == ["\u00e9"]
