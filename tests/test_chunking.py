"""Line windows, gaps and syntax chunks at their edges."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loomdex.config import ChunkConfig
from loomdex.functions import paths, text
from loomdex.operators.chunking import ast_chunks, context, gaps, lines

FILE = "project_id string, relative_path string, content string, language_id string"


def as_files(spark, contents):
    return spark.createDataFrame([("p", f"f{i}", c, "text") for i, c in enumerate(contents)], FILE)


def expected_windows(content, size, overlap, least):
    """What a loop over the file gives."""
    parts, out = content.split("\n"), []
    for i in range(0, len(parts), size - overlap):
        body = "\n".join(parts[i : i + size])
        trimmed = body.strip(text.SPACES)
        if len(trimmed) >= least:
            start = sum(len(x) + 1 for x in parts[:i])
            out.append((i + 1, min(i + size, len(parts)), start, start + len(body), sha256(trimmed.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 90, 91, 205])
@pytest.mark.parametrize("end", ["", "\n", "\r\n"])
def test_line_windows(spark, n, end):
    content = "\n".join(f"line {i} of é text" for i in range(n)) + end
    found = lines.line_windows(as_files(spark, [content]), ChunkConfig(min_chunk=5)).orderBy("line_start").collect()
    got = [(r.line_start, r.line_end, r.char_start, r.char_end, r.hash) for r in found]
    assert got == expected_windows(content, 50, 10, 5)


def test_blank_null_and_reading_back(spark):
    files = as_files(spark, ["  \n\n \t\n", None, "  alpha beta gamma  \n"])
    found = lines.line_windows(files, ChunkConfig(min_chunk=3))
    assert [r.relative_path for r in found.collect()] == ["f2"]
    read = lines.read_chunks(found, files).first()
    assert read.code == "  alpha beta gamma  \n" and read.text == "alpha beta gamma" and read.char_count == 16


def test_gaps(spark):
    content = "\n".join(f"line{i:02d}" for i in range(1, 13))
    files = as_files(spark, [content, content, content])
    chunk = [("p", "f0", 3, 4, 0), ("p", "f0", 5, 6, 1), ("p", "f0", 9, 10, 2), ("p", "f1", 1, 12, 0), ("p", "f2", 2, 2, 0), ("p", "f2", 2, 5, 1)]
    intervals = spark.createDataFrame(chunk, "project_id string, relative_path string, line_start int, line_end int, seq int")
    found = gaps.fill_gaps(intervals, files, ChunkConfig(min_chunk=8)).orderBy("relative_path", "line_start").collect()
    assert [(r.relative_path, r.line_start, r.line_end) for r in found] == [("f0", 1, 2), ("f0", 7, 8), ("f0", 11, 12), ("f2", 6, 12)]
    for r in found:
        assert content[r.char_start : r.char_end] == "\n".join(content.split("\n")[r.line_start - 1 : r.line_end])


def test_python_syntax():
    code = "x = 1\n\n@dec\ndef f(a, b=2) -> int:\n    return a\n\n\nclass C:\n    def m(self):\n        return 1\n"
    found = ast_chunks.extract(code, "python", ChunkConfig(min_chunk=10))
    assert [(c["type"], c["name"], c["line_start"], c["line_end"]) for c in found] == [("function", None, 3, 5), ("class", "C", 8, 10)]
    assert found[0]["text"].startswith("@dec")
    # A decorated definition that is too large gives the function below it; a class stays whole, since its methods stand in its body.
    large = ast_chunks.extract(code, "python", ChunkConfig(min_chunk=10, max_chunk=30))
    assert [(c["type"], c["name"], c["line_start"]) for c in large] == [("function", "f", 4), ("class", "C", 8)]
    # One that is too small to be a chunk is searched.
    small = ast_chunks.extract("class C:\n    def m(self): pass\n", "python", ChunkConfig(min_chunk=20, max_chunk=30))
    assert [(c["name"], c["parent"]) for c in small] == [("C", None)]
    assert ast_chunks.extract("def (:", "python") == []


def test_bracket_syntax():
    code = (
        "// const no = 1\nexport async function f(a: string, b: number) {\n  return `{`;\n}\n\nclass K {\n  run(a) {\n    return '}';\n  }\n}\n"
        "interface I { x: string }\ntype T = { a: string };\n"
    )
    found = ast_chunks.extract(code, "typescript", ChunkConfig(min_chunk=10))
    assert [(c["type"], c["name"]) for c in found] == [("block", "f"), ("class", "K"), ("interface", "I"), ("type", "T")]
    assert all(code[c["char_start"] : c["char_end"]] == c["text"] for c in found)
    go = ast_chunks.extract("package x\n\nfunc (p *P) Get(a int) int {\n\treturn p.X\n}\n", "go", ChunkConfig(min_chunk=10))
    assert [(c["type"], c["name"], c["parameters"]) for c in go] == [("method", "Get", ["a int"])]
    rust = ast_chunks.extract("pub fn add(a: i32) -> i32 {\n  a\n}\nimpl P {\n  fn g() {}\n}\n", "rust", ChunkConfig(min_chunk=10))
    assert [(c["type"], c["name"]) for c in rust] == [("block", "add"), ("impl", None)]
    assert ast_chunks.extract("class X {}", "java") == []


def test_signatures_and_arrows():
    """Parameters are cut at commas outside of brackets; return types, arrow functions and nested struct types are seen."""
    one = lambda code, language: ast_chunks.extract(code, language, ChunkConfig(min_chunk=5))[0]
    ts = one("function h(a: Map<string, number>, b: (x: number) => void): string {\n  return 'x)';\n}\n", "typescript")
    assert (ts["parameters"], ts["returns"]) == (["a: Map<string, number>", "b: (x: number) => void"], ": string")
    ts = one("export async function f(a = (1, 2)): Promise<{a: string}> {\n  return {a: `}`};\n}\nfoo();\n", "typescript")
    assert (ts["type"], ts["name"], ts["line_end"]) == ("block", "f", 3)
    arrow = one("app.get('/x', async (req, res) => {\n  res.send(/[{]/.test(1));\n});\n", "javascript")
    assert (arrow["type"], arrow["parameters"], arrow["is_async"], arrow["line_end"]) == ("function", ["req", "res"], True, 3)
    const = ast_chunks.extract("const { a, b } = require('x');\nconst f = (x) => {\n  return x;\n};\n", "javascript", ChunkConfig(min_chunk=5))
    assert [(c["type"], c["name"], c["line_start"], c["line_end"]) for c in const] == [("block", None, 1, 1), ("block", None, 2, 4)]
    go = ast_chunks.extract("var c = struct {\n\tb int\n}{b: 1}\nfunc (p *P) Get(a int, f func(x, y int) int) (int, error) {\n\treturn 1, nil\n}\n", "go", ChunkConfig(min_chunk=5))
    assert [(c["type"], c["name"], c["parameters"]) for c in go] == [("block", None, None), ("method", "Get", ["a int", "f func(x, y int) int"])]
    rust = one("pub fn add<'a, T: Into<i32>>(a: &'a str, b: (i32, T)) -> Result<i32, Error> where T: X {\n  a\n}\n", "rust")
    assert (rust["parameters"], rust["returns"]) == (["a: &'a str", "b: (i32, T)"], "Result<i32, Error>")
    py = one('def f(a, /, b: int = (1, 2), *args, c="x,(", **kw) -> dict[str, int]:\n    return a\n', "python")
    assert (py["parameters"], py["returns"]) == (["a", "/", "b: int = (1, 2)", "*args", 'c="x,("', "**kw"], "dict[str, int]")


def test_source_trees():
    """Small modules as people write them: what their grammar's nodes are, written down by hand from the texts."""
    module = (
        "import { a } from './a';\n\nexport interface User {\n  id: string;\n  name: string;\n}\n\n"
        "export async function login(name: string, password: string): Promise<User | null> {\n  if (!name) {\n    return null;\n  }\n  return { id: '1', name };\n}\n\n"
        "export class Service<T extends { id: string }> {\n  private users: Map<string, User> = new Map();\n\n  constructor(private readonly url: string) {}\n\n"
        "  async get(id: string): Promise<User | undefined> {\n    return this.users.get(id);\n  }\n}\n\nexport const config = {\n  retries: 3,\n};\n\nenum Level {\n  Low,\n  High,\n}\n"
    )
    found = ast_chunks.extract(module, "typescript", ChunkConfig(min_chunk=20))
    assert [(c["type"], c["name"], c["line_start"], c["line_end"]) for c in found] == [
        ("block", "User", 3, 6), ("block", "login", 8, 13), ("block", "Service", 15, 23), ("block", None, 25, 27), ("enum", "Level", 29, 32),
    ]
    split = ast_chunks.extract(module, "typescript", ChunkConfig(min_chunk=20, max_chunk=100))
    login = next(c for c in split if c["name"] == "login")
    assert (login["type"], login["exported"], login["is_async"], login["returns"], login["parent"]) == ("function", True, True, ": Promise<User | null>", "login")


def test_methods_of_classes(spark):
    code = "class A {\n  one(x) {\n    return 1;\n  }\n\n  async two() { return 2; }\n}"
    python = "class B:\n    def m(self):\n        return 1\n"
    schema = "project_id string, relative_path string, language_id string, type string, name string, line_start int, text string"
    rows = [("p", "a.js", "javascript", "class", "A", 10, code), ("p", "b.py", "python", "class", "B", 3, python), ("p", "c.js", "javascript", "function", "f", 1, "function f() {}")]
    found = context.methods_of_classes(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.relative_path, r.name, r.parent, r.line_start, r.line_end) for r in found) == [("a.js", "one", "A", 11, 13), ("a.js", "two", "A", 15, 15), ("b.py", "m", "B", 4, 5)]


def test_long_files_are_cut_in_linear_time(spark):
    """60,000 lines give 1,500 windows; each offset is that of the whole text before."""
    content = "\n".join(f"line {i}" for i in range(60_000))
    found = lines.line_windows(as_files(spark, [content]), ChunkConfig(min_chunk=5)).select("line_start", "char_start", "char_end", "text").collect()
    assert len(found) == 1500
    for r in found[:: 100]:
        assert content[r.char_start : r.char_end] == r.text and content.count("\n", 0, r.char_start) == r.line_start - 1


def test_long_comments_are_skipped():
    """Long comments are passed over in jumps: the end of a declaration isn't looked for character by character."""

    class Counted(str):
        looked = 0

        def __getitem__(self, at):
            Counted.looked += 1
            return str.__getitem__(self, at)

    assert ast_chunks._end_of(Counted("x" * 10_000 + "(" + " " * 10_000 + ");"), 0, {10_000: 20_001}, False) == 20_003 and Counted.looked < 20
    code = "function f(a) {\n  return a;\n}\nconst x = [1,\n// " + "word " * 2000 + "\n2];\nclass K {\n  run(a) {\n  // " + "word " * 2000 + "\n  }\n}\n"
    nodes = ast_chunks.parse(code, "typescript")
    assert [(n.kind, n.name, code[n.end - 1]) for n in nodes] == [("function_declaration", "f", "}"), ("lexical_declaration", None, ";"), ("class_declaration", "K", "}")]


def test_files_fall_back(spark):
    body = "def f():\n    return 'a long enough body of a function'\n\n" + "# a gap that is long enough to be kept\n" * 3
    rows = [("p", "a.py", body, "python"), ("p", "b.py", "not ( python at all, but long enough", "python"), ("p", "c.java", "class X { int a; } // long enough", "java")]
    found = ast_chunks.chunk_files(spark.createDataFrame(rows, FILE), ChunkConfig(min_chunk=20)).collect()
    assert sorted((r.relative_path, r.type, r.gap_fill, r.fallback) for r in found) == [
        ("a.py", "block", True, False), ("a.py", "function", False, False), ("b.py", "block", False, True), ("c.java", "block", False, True),
    ]


def test_globs_and_extensions(spark):
    names = ["node_modules/a.js", "src/node_modules/a.js", "a/dist/b/c.ts", "x.log", "a/x.log", "src/ok.ts", "src/distance.ts", ".env", "A.TSX"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.is_ignored(F.col("p")), paths.extension(F.col("p")), paths.has_extension(F.col("p")))
    found = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert [n for n in names if found[n][0]] == names[:5]
    assert found[".env"][1] == "" and found["A.TSX"][1:] == (".tsx", True)


def test_summary_variants(spark):
    response = "<think>x</think>[2] two\n<a>\n[1]  one \nloose line"
    got = spark.range(1).select(text.parse_summaries(F.lit(response), F.lit(3))).first()[0]
    assert got == ["one", "two", "Code chunk"]
    assert text.parse_summaries_standalone(response, 3) == ["one", "two", "loose line"]
    assert text.parse_summaries_standalone("[1] x", 2) == ["Code chunk"] * 2
    assert spark.range(1).select(text.parse_summaries(F.lit(None).cast("string"), F.lit(1))).first()[0] == ["Code chunk"]
