import pytest

from ctxspark.llm import splitting
from ctxspark.llm.boundaries import natural_lines

CHUNK = "chunk_id long, path string, start_line int, text string, loaded_at int, piece string"
CASES = {
    "a.py": ("import a\n\n# note\n@deco(\n    1)\ndef f():\n    return 1\n\n\nX = '''\ndef no():\n    pass\n'''\nclass A: pass\nclass B:\n    def m(self):\n        pass\n", [3, 15]),
    "a.ts": ("let a = 1;\n/**\n * doc\n */\nexport const f = (x: A): B => {\n  g();\n};\nconst t = {\n  a: 1,\n};\ntype S = string;\ntype T = {\n  a: string;\n};\n/*\nfunction no() {\n}\n*/\nexport enum E {\n  A,\n}\n", [2, 12, 15]),
    "a.go": ("package x\n\nimport (\n\t\"a\"\n)\n\n// Doc\nfunc F() {\n}\n\ntype S struct {\n\tA int\n}\nvar t = `\nfunc no() {\n`\n", [7, 11]),
    "a.rs": ("use a;\n#[test]\n/// doc\npub fn f<'a>(x: &'a str) -> char {\n    '{'\n}\nimpl S {\n    fn g() {}\n}\nfn one() {}\n", [2, 7]),
    "A.java": ("package a;\n\n@X\npublic final class A {\n    class B {\n    }\n}\ninterface I {\n}\n", [3, 8]),
    "a.md": ("# One\ntext\n\nTwo\n---\n\n```sh\n# no\n```\n\n#### Three\n", [4, 11]),
    "B.java": ("package b;\n\n@X(\n    a = 1)\npublic class B\n        extends C {\n}\n", [3]),
    "b.go": ("package b\n\ntype (\n\tA int\n\tB string\n)\n", [3]),
    "b.py": ("import b\n\n@deco(\n" + "    1,\n" * 60 + ")\ndef f():\n    return 1\n", [3]),
    "a.json": ('{\n"a": 1\n}\n', []),
}


@pytest.mark.parametrize("path", CASES)
def test_natural_lines(path):
    text, want = CASES[path]
    assert natural_lines(text, path) == want and natural_lines(text.replace("\n", "\r\n"), path) == want


def pieces(spark, text, path="a.py", start=1, limit=200, overlap=3):
    df = spark.createDataFrame([(1, path, start, text, 1, "clash"), (1, path, start, text, 2, "x"), (2, path, 1, None, 1, "x"), (3, path, 1, "short", 1, "x")], CHUNK)
    return splitting.pieces(df, limit, overlap).orderBy("chunk_id", "piece").collect()


def test_pieces_cover_the_text(spark):
    text = "".join(f"def f{i}():\n" + "    x = 1\n" * (i % 7 + 1) + "\n\n" for i in range(40))
    got = pieces(spark, text, start=101)
    lines = text.split("\n")
    assert {r.chunk_id for r in got} == {1} and all(len(r.text) <= 200 for r in got)
    covered = set()
    for r in got:
        assert r.text.rstrip("\n").split("\n") == lines[r.start_line - 101:r.end_line - 100][: len(r.text.rstrip("\n").split("\n"))]
        covered |= set(range(r.start_line, r.end_line + 1))
    assert covered == set(range(101, 100 + len(lines)))
    assert all(a.end_line - b.start_line + 1 >= 1 for a, b in zip(got, got[1:]))


def test_long_lines_are_cut_by_characters(spark):
    text = "x" * 1000 + "\n" + "y" * 50
    got = pieces(spark, text)
    assert all(len(r.text) <= 200 for r in got) and got[0].start_line == got[0].end_line == 1
    assert "".join(r.text for r in got).count("x") >= 1000


def test_doubling_gives_the_greedy_cuts(spark):
    text = "\n".join("w" * (i % 37 + 1) for i in range(300))
    table = {p: (n, b) for p, n, b, *_ in splitting.successors(text, "a.txt", 200, 3)}
    at, want = 0, []
    while at < len(text):
        want.append(text[table[at][1]:table[at][0]])
        at = table[at][0]
    assert [r.text for r in pieces(spark, text, "a.txt")] == want


def test_empty(spark):
    assert splitting.pieces(spark.createDataFrame([], CHUNK)).count() == 0
    assert splitting.natural_cuts(splitting.boundary_table(splitting.oversized(spark.createDataFrame([(1, None, None, "x" * 9000, 1, "p")], CHUNK)))).count() == 0
