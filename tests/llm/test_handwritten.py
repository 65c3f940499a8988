from ctxspark.llm import handwritten

CHUNK = "repo_id string, path string, start_line int, text string, chars string"
OWN = "import a\n\n\ndef f(x):\n    return a.g(x) + 1\n" * 4


def reasons(spark, files):
    df = spark.createDataFrame([(r, p, s, t, "clash") for r, p, s, t in files], CHUNK)
    return {(r.repo_id, r.path): r.reason for r in handwritten.not_handwritten(df).collect()}


def test_kinds(spark):
    numbers = "T = [\n" + "\n".join(", ".join(str(i * 37 + j) for j in range(12)) + "," for i in range(60)) + "\n]\n"
    files = [
        ("r", "a.py", 1, "# Copyright the x project\n#\n# Code generated by stubforge 1.2. DO NOT EDIT.\n" + OWN), ("r", "b.py", 1, OWN), ("r", "c_pb2.py", 1, OWN), ("r", "app-lock.json", 1, "{}"),
        ("r", "d.py", 1, "# Code generated by hand. DO NOT EDIT.\n" + OWN), ("r", "e.py", 1, 'x = """\n// Code generated by z 1.0. DO NOT EDIT.\n"""\n' + OWN), ("r", "f.js", 1, "/*! pkg 1.2.3 | (c) 2020 pkg.example */\nlet a = 1;\n"),
        ("r", "g.js", 1, "var a=1;function b(c){return c.d?c[1]:void 0}" * 40), ("r", "h.py", 1, numbers), ("r", "i.py", 1, "SIZES = [\n    1, 2, 3,\n    4, 5, 6,\n]\n"), ("r", "third_party/pkg/x.go", 1, "package x\n"),
        ("r", "src/vendors/y.go", 1, "package y\n"), ("r", "n.md", 1, "This text was generated by hand; do not edit generated files."), ("r", None, 1, "x"), (None, "z.py", 1, "x"), ("r", "null.py", 1, None), ("r", "empty.py", 1, ""),
    ]
    got = reasons(spark, files + files[:3])
    assert got == {("r", "a.py"): "generated", ("r", "c_pb2.py"): "generated", ("r", "app-lock.json"): "generated", ("r", "f.js"): "vendored", ("r", "g.js"): "minified", ("r", "h.py"): "data dump", ("r", "third_party/pkg/x.go"): "vendored"}


def test_shared_subtrees(spark):
    lib = [(f"helpers/lib/m{i}.py", f"def f{i}():\n    return {i}\n" * 30) for i in range(3)]
    files = [(r, f"{at}/{p}", 1, t) for r, at in (("a", "src"), ("b", "tools/x")) for p, t in lib]
    files += [(r, "main.py", 1, f"def main():\n    run('{r}')\n" * 20) for r in "ab"]
    got = reasons(spark, files)
    assert set(got) == {(r, f"{at}/{p}") for r, at in (("a", "src"), ("b", "tools/x")) for p, _ in lib} and set(got.values()) == {"copied"}


def test_copies_with_other_headers_names_and_places(spark):
    lib = "".join(f"def helper_{i}(value, table):\n    found = table.get(value, {i})\n    return found * {i + 3}\n\n\n" for i in range(12))
    mine = "".join(f"def own_{i}(row):\n    total_amount = row['t{i}'] + {i}\n    return total_amount / {i + 1}\n\n\n" for i in range(12))
    files = [
        ("a", "x/lib/one.py", 1, "# Copyright a\n" + lib), ("b", "y/two.py", 1, "# some other header\n# of two lines\n" + lib.replace("    found", "\tfound").replace("\n\n\n", "\n\n# note\n\n")),
        ("c", "z.py", 1, lib + mine[:len(mine) // 3]), ("d", "w.py", 1, lib[:len(lib) // 4] + mine.replace("own", "other")), ("a", "app.py", 1, mine.replace("own", "first")), ("b", "app.py", 1, mine.replace("own", "second")),
    ]
    assert reasons(spark, files) == {("a", "x/lib/one.py"): "copied", ("b", "y/two.py"): "copied", ("c", "z.py"): "copied"}
    hot = [(f"r{i}", f"p{i}/h.py", 1, lib) for i in range(60)] + [(f"r{i}", "own.py", 1, mine.replace("own", f"m{i}")) for i in range(60)]
    assert set(reasons(spark, hot)) == {(r, p) for r, p, _, _ in hot[:60]}


def test_headers_of_any_length(spark):
    licence = "".join(f"# clause {i} of the terms\n" for i in range(60))
    assert reasons(spark, [("r", "a.py", 1, licence + "# Code generated by maker 2.1 DO NOT EDIT\n" + OWN)]) == {("r", "a.py"): "generated"}


def test_copies_of_a_repository_are_related(spark):
    files = [(r, "src/m.py", 1, OWN * 5) for r in ("a", "a-fork")]
    assert reasons(spark, files) == {}


def test_empty(spark):
    assert reasons(spark, []) == {}
