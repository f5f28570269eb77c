from cairn.llm.vendored import classify_files, file_features

STATEMENTS = ["for _, it := range items {\n\t\tn += len(it)\n\t}", "if n > 7 {\n\t\treturn nil\n\t}", "defer release(x)", "v := load(x)", "total -= n", "switch v {\n\tdefault:\n\t\tn++\n\t}"]
HAND = "package a\n\n" + "\n\n".join(f"func F{i}(x int) error {{\n\t" + "\n\t".join(STATEMENTS[k] for k in range(6) if (i * 37 + 11) >> k & 1) + "\n}" for i in range(6)) + "\n"
LIB = "package lib\n\n" + "\n\n".join(f"func Lib{i}(key string) int {{\n\tsize{i} := parse(key) + {i * 13}\n\t" + "\n\t".join(STATEMENTS[k] for k in range(6) if (i * 29 + 7) >> k & 1) + "\n}" for i in range(6)) + "\n"
SCHEMA = "path string, content string, hash bigint, repo string, node string, blocks string, _salt int"


def run(spark, rows):
    df = spark.createDataFrame([(p, c, 1, None, "x", "y", 2) for p, c in rows], SCHEMA)
    return {r["file"]: {k for k in ("generated", "minified", "vendored", "data") if r[k]} for r in classify_files(df).collect()}


def test_classes(spark):
    stubs = "class A {\n" + "\n".join(f"  call{i}(a, b) {{\n    return this.invoke({i});\n  }}\n" for i in range(8)) + "}\n"
    got = run(spark, [
        ("r1/app/a.go", HAND), ("r1/app/gen.go", "// Code generated by mk; DO NOT EDIT.\n" + HAND.replace("F", "G")), ("r1/app/stub.js", stubs),
        ("r1/app/x.js", "!function(e,t){" + "".join(f"var a{i % 7}=b.c||{{}};try{{d(e)}}catch(f){{g=f}}" for i in range(80)) + "}()"),
        ("r1/app/table.py", "T = [\n" + "\n".join(f"  {i}.125, {i}.5, {i}.75," for i in range(90)) + "\n]\n"),
        ("r2/third_party/z/z.go", "package z\n\nfunc Z() int { return 1 }\n"),
        ("r1/x/lib.go", LIB), ("r3/y/lib.go", "// local copy\n" + LIB.replace("func Lib2", "func Changed2").replace("+ 26", "+ 27")),
        ("r1/app/talk.py", '# Templates for the code generator: output starts with a do-not-edit notice.\nHEADER = "do not edit: mk"\n\ndef f(x):\n    n = 1\n    for it in x:\n        n += it\n    return n\n'),
    ])
    assert got["r1/app/a.go"] == set() and got["r1/app/talk.py"] == set()
    assert got["r1/app/gen.go"] == {"generated"} and got["r1/app/stub.js"] == {"generated"}
    assert got["r1/app/x.js"] == {"minified"} and got["r1/app/table.py"] == {"data"}
    assert got["r2/third_party/z/z.go"] == {"vendored"}
    assert got["r1/x/lib.go"] == {"vendored"} and got["r3/y/lib.go"] == {"vendored"}


def test_shared_folder_of_small_files(spark):
    small = [(f"pkg/u{i}.py", f"VALUE_{i} = compute_{i}(alpha, beta) + {i}\n") for i in range(9)]
    got = run(spark, [(f"{r}/{p}", c) for r in ("r1", "r2") for p, c in small] + [("r1/own.py", small[0][1])])
    assert all(got[f"{r}/{p}"] == {"vendored"} for r in ("r1", "r2") for p, _ in small)
    assert got["r1/own.py"] == set()  # one small equal file alone says nothing


def test_odd_rows(spark):
    got = run(spark, [(None, HAND), ("", HAND), ("r1/null.go", None), ("r1/empty.go", ""), ("noext", "x" * 300), ("r1/a.go", HAND), ("r1/a.go", HAND), ("r1/" + "d/" * 20 + "deep.go", HAND)])
    assert set(got) == {"r1/null.go", "r1/empty.go", "noext", "r1/a.go", "r1/" + "d/" * 20 + "deep.go"}
    assert got["r1/null.go"] == got["r1/empty.go"] == set()
    assert run(spark, []) == {}


def test_features_never_fail():
    for text in ("", "\n", "\x00", "/*", '"""', "}" * 1000, "a" * 200_000, "é" * 10):
        for ext in ("go", "py", "rb", "rs", "kt", "zzz"):
            assert file_features(f"r/a.{ext}", text)["path"]


def test_folders_that_only_suggest():
    for folder in ("contrib", "deps", "external"):
        f = file_features(f"r/{folder}/a.go", HAND)
        assert f["seed"] and not f["foreign"]


def test_seeds_and_families(spark):
    other = LIB.replace("Lib", "Own").replace("parse", "scan")
    got = run(spark, [("r1/contrib/hand.go", HAND), ("r2/contrib/lib.go", LIB), ("r2/src/copy.go", LIB.replace("+ 13", "+ 14")), ("r2/src/own.go", other)])
    assert got["r1/contrib/hand.go"] == set() and got["r2/src/own.go"] == set()
    assert got["r2/contrib/lib.go"] == got["r2/src/copy.go"] == {"vendored"}
    # A fork shares everything with its origin; what both have from elsewhere is still taken over.
    files = [(f"src/u{i}.go", HAND.replace("F", f"U{i}x").replace("it)", f"it) + {i}")) for i in range(14)]
    got = run(spark, [(f"{r}/{p}", c) for r in ("app", "fork") for p, c in files] + [("app/lib.go", LIB), ("other/lib.go", LIB)])
    assert all(got[f"{r}/{p}"] == set() for r in ("app", "fork") for p, _ in files)
    assert got["app/lib.go"] == got["other/lib.go"] == {"vendored"}
