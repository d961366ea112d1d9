"""Chunks by syntax, for the languages whose node kinds are known; other files fall back to line windows.

Python is parsed by the standard library. JavaScript, TypeScript, Go and Rust are read by a scanner that
knows strings, comments and brackets and recognizes declarations: an approximation of a grammar,
which is stated here plainly. Both give nodes with spans; what becomes a chunk is decided alike for all.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.config import ChunkConfig
from loomdex.functions.paths import CHUNK_TYPES, SEMANTIC_NODES
from loomdex.functions.text import SPACES
from loomdex.operators.chunking.gaps import fill_gaps
from loomdex.operators.chunking.lines import line_windows
from loomdex.operators.tenants import file_key
from loomdex.runtime import materialize, ship

#: Kinds of nodes whose semantic parts stand directly below them; those of a class or module stand in its body.
DIRECT = ("export_statement", "decorated_definition")
#: What is a method within a class, by language.
METHODS = {("javascript", "method_definition"), ("typescript", "method_definition"), ("python", "function_definition")}


@dataclass
class Node:
    """A piece of syntax: its kind, span in characters, name and what lies within it."""

    kind: str
    start: int
    end: int
    name: str | None = None
    parameters: list[str] | None = None
    returns: str | None = None
    children: list[Node] = field(default_factory=list)
    exported: bool = False


def parse_python(code: str) -> list[Node]:
    """Functions, classes and decorated definitions of a module, nested."""
    at = [0]
    for line in code.split("\n"):
        at.append(at[-1] + len(line) + 1)
    text = code.split("\n")

    def offset(line: int, column: int) -> int:
        return at[line - 1] + len(text[line - 1].encode()[:column].decode())

    def start(node) -> int:
        return offset(node.lineno, node.col_offset)

    def end(node) -> int:
        return offset(node.end_lineno, node.end_col_offset)

    def parameters(a: ast.arguments) -> list[str]:
        """As written, with their types and defaults; ``/`` and a bare ``*`` count."""
        plain = [*a.posonlyargs, *a.args]
        default = dict(zip(reversed(plain), reversed(a.defaults))) | {k: d for k, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d}  # noqa: B905
        written = lambda x: code[start(x) : end(default.get(x, x))]
        out = [written(x) for x in a.posonlyargs] + ["/"] * bool(a.posonlyargs) + [written(x) for x in a.args]
        out += ["*" + written(a.vararg)] if a.vararg else ["*"] * bool(a.kwonlyargs)
        return out + [written(x) for x in a.kwonlyargs] + (["**" + written(a.kwarg)] if a.kwarg else [])

    def nodes(body: list[ast.stmt]) -> list[Node]:
        out = []
        for item in body:
            inner = nodes([s for s in ast.iter_child_nodes(item) if isinstance(s, ast.stmt)])
            if not isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out += inner
                continue
            is_class = isinstance(item, ast.ClassDef)
            node = Node("class_definition" if is_class else "function_definition", start(item), end(item), item.name, children=inner)
            if not is_class:
                node.parameters = parameters(item.args)
                node.returns = code[start(item.returns) : end(item.returns)] if item.returns else None
            if item.decorator_list:
                first = item.decorator_list[0]
                node = Node("decorated_definition", start(first) - 1, node.end, None, children=[node])
            out.append(node)
        return out

    return nodes(ast.parse(code).body)


_COMMENT = r"//[^\n]*|/\*.*?\*/"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\""
_REGEX = r"(?:(?<=[(,=:!&|?{};])|(?<=return))[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_TICKED = r"`(?:\\.|[^`\\])*`"
#: What hides brackets, by language: a single quote begins a string in some, a character or a lifetime in others.
_OPAQUE = {
    "javascript": re.compile(rf"{_COMMENT}|{_QUOTED}|'(?:\\.|[^'\\\n])*'|{_TICKED}|{_REGEX}", re.S),
    "go": re.compile(rf"{_COMMENT}|{_QUOTED}|'(?:\\.[^']*|[^'\\\n])'|`[^`]*`", re.S),
    "rust": re.compile(rf"{_COMMENT}|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.S),
}
_OPAQUE["typescript"] = _OPAQUE["javascript"]

_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_RUST = r"(?:\bpub(?:\([^)]*\))?\s+)?"
_NO_METHOD = r"(?!(?:if|for|while|switch|catch|return|function|else|do|new|typeof|await|throw|super)\b)"
_EXPORT = re.compile(r"\bexport\b(?:\s+default\b)?(?:\s+declare\b)?\s*")
_JS = (
    ("function_declaration", rf"(?:\basync\s+)?\bfunction\s+{_NAME}"),
    ("generator_function_declaration", rf"(?:\basync\s+)?\bfunction\s*\*\s*{_NAME}"),
    ("class_declaration", rf"(?<!abstract )\bclass\s+{_NAME}"),
    ("abstract_class_declaration", rf"\babstract\s+class\s+{_NAME}"),
    ("lexical_declaration", r"\b(?:const|let)\s+(?!enum\b)(?=[A-Za-z_$\[{])"),
    ("variable_declaration", r"\bvar\s+(?=[A-Za-z_$\[{])"),
    ("method_definition", rf"^[ \t]+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?{_NO_METHOD}{_NAME}\s*(?=[<(])"),
)
_PATTERNS = {
    "javascript": _JS,
    "typescript": (
        *_JS,
        ("interface_declaration", rf"\binterface\s+{_NAME}"),
        ("type_alias_declaration", rf"(?:^|(?<=export))[ \t]*\btype\s+{_NAME}(?=[^=\n]*=)"),
        ("enum_declaration", rf"\b(?:const\s+)?enum\s+{_NAME}"),
    ),
    "go": (
        ("function_declaration", rf"^func\s+{_NAME}"),
        ("method_declaration", rf"^func\s*\([^)]*\)\s*{_NAME}"),
        ("type_declaration", r"^type\s+(?=[A-Za-z_(])"),
        ("struct_type", r"\bstruct\s*(?=\{)"),
        ("interface_type", r"\binterface\s*(?=\{)"),
    ),
    "rust": (
        ("function_item", rf"{_RUST}(?:\b(?:async|const|unsafe)\s+)*\bfn\s+{_NAME}"),
        ("impl_item", r"^\s*(?:unsafe\s+)?impl\b"),
        ("struct_item", rf"{_RUST}\bstruct\s+{_NAME}"),
        ("enum_item", rf"{_RUST}\benum\s+{_NAME}"),
        ("trait_item", rf"{_RUST}(?:unsafe\s+)?\btrait\s+{_NAME}"),
        ("mod_item", rf"{_RUST}\bmod\s+{_NAME}"),
    ),
}
_CALLABLE = ("function_declaration", "generator_function_declaration", "method_definition", "method_declaration", "function_item")
#: Without one of these a kind can't occur, and its pattern needn't be looked for.
_NEEDS = {
    "function_declaration": ("func",), "generator_function_declaration": ("*",), "class_declaration": ("class",), "abstract_class_declaration": ("abstract",),
    "lexical_declaration": ("const", "let"), "variable_declaration": ("var",), "interface_declaration": ("interface",), "type_alias_declaration": ("type",),
    "enum_declaration": ("enum",),
}
#: Nodes that end with their statement, even after a closing bracket.
_STATEMENTS = ("lexical_declaration", "variable_declaration", "type_alias_declaration")
_ARROW = re.compile(r"\s*(?P<type>:[^={};]+?)?\s*=>")
_BARE_ARROW = re.compile(r"(?<![\w$.])(?:async\s+)?(?P<one>[A-Za-z_$][\w$]*)\s*=>")


def _hidden(code: str, language: str) -> str:
    """The code with strings and comments as blanks, of the same length."""
    return _OPAQUE[language].sub(lambda m: "\n".join(" " * len(line) for line in m[0].split("\n")), code)


def _closings(plain: str) -> dict[int, int]:
    """Where each opening bracket is closed."""
    open_, out = [], {}
    for m in re.finditer(r"[()\[\]{}]", plain):
        if m[0] in "([{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def _goes_on(plain: str, at: int) -> bool:
    """Whether a statement goes on after the line end at ``at``."""
    before = plain[max(0, at - 80) : at].rstrip()
    return bool(re.search(r"(?:[=+\-*/&|?:,<({\[.]|=>)$", before)) or not re.compile(r"\s*(?:\n|$|[A-Za-z@}])").match(plain, at + 1)


#: Characters at which a declaration or an expression may end or a bracket opens; between them nothing is to be decided.
_STOP = re.compile(r"[()\[\]{},;\n]")


def _next_stop(plain: str, at: int) -> int:
    found = _STOP.search(plain, at)
    return found.start() if found else len(plain)


def _end_of(plain: str, at: int, closed: dict[int, int], block: bool) -> int:
    """Where a declaration ends: with ``block`` after its body's closing bracket, else at the end of its statement."""
    i = _next_stop(plain, at)
    while i < len(plain):
        c = plain[i]
        if c in "([{":
            i = closed.get(i, len(plain))
            if c == "{" and block:
                rest = re.compile(r"[ \t]*;").match(plain, i + 1)
                return min(len(plain), rest.end() if rest else i + 1)
        elif c in ")]},":
            if c != "," or not block:
                if c != ",":
                    return i
        elif c == ";":
            return i + 1
        elif c == "\n" and not _goes_on(plain, i):
            return i
        i = _next_stop(plain, i + 1)
    return len(plain)


def _pieces(code: str, plain: str, start: int, end: int) -> list[str]:
    """What commas outside of brackets cut a range into."""
    out, depth, at = [], 0, start
    for i in range(start, end):
        c = plain[i]
        depth += (c in "([{<") - (c in ")]}" or c == ">" and plain[i - 1] not in "=-")
        if c == "," and depth == 0:
            out.append(code[at:i].strip())
            at = i + 1
    return [p for p in (*out, code[at:end].strip()) if p]


def _signature(code: str, plain: str, at: int, closed: dict[int, int], language: str):
    """(parameters, return type, where the body begins) of what is called, from after its name; None without brackets."""
    i = re.compile(r"\s*").match(plain, at).end()
    if i < len(plain) and plain[i] in "<[" :  # type parameters
        depth = 0
        for j in range(i, len(plain)):
            depth += (plain[j] in "<[") - (plain[j] == "]" or plain[j] == ">" and plain[j - 1] not in "=-")
            if depth == 0:
                i = re.compile(r"\s*").match(plain, j + 1).end()
                break
    if i >= len(plain) or plain[i] != "(" or i not in closed:
        return None
    parameters, j = _pieces(code, plain, i + 1, closed[i]), closed[i] + 1
    mark = {"rust": "->", "go": None}.get(language, ":")
    head = re.compile(rf"\s*{mark}").match(plain, j) if mark else None
    if not head:
        return parameters, None, j
    first = head.end() if mark == "->" else head.end() - 1
    k = head.end()
    while k < len(plain):
        c = plain[k]
        told = plain[head.end() : k].strip()
        if c == ";" or c == "\n" and told and not _goes_on(plain, k) or c == "{" and told and told[-1] not in "|&:,<(>" or language == "rust" and re.compile(r"where\b").match(plain, k):
            break
        if c == "{" and told.endswith(">") and not told.endswith("=>"):
            break
        k = closed.get(k, k) + 1 if c in "([{" else k + 1
    return parameters, code[first:k].strip() or None, k


def _arrows(code: str, plain: str, closed: dict[int, int]) -> list[Node]:
    """Arrow functions, from their parameters to the end of their body."""
    if "=>" not in plain:
        return []
    heads = [(i, closed[i] + 1, _pieces(code, plain, i + 1, closed[i])) for i in closed if plain[i] == "("]
    heads = [(i, m, p) for i, z, p in heads if (m := _ARROW.match(plain, z))]
    heads += [(m.start("one"), m, None) for m in _BARE_ARROW.finditer(plain)]
    out = []
    for start, m, parameters in heads:
        before = re.compile(r"\basync\s+$").search(plain[max(0, start - 20) : start])
        start -= len(before[0]) if before else 0
        at = re.compile(r"\s*").match(plain, m.end()).end()
        end = closed.get(at, len(plain)) + 1 if plain[at : at + 1] == "{" else _expression_end(plain, at, closed)
        type_ = m.groupdict().get("type")
        out.append(Node("arrow_function", start, min(end, len(plain)), None, parameters, type_.strip() if type_ else None))
    return out


def _exports(plain: str, closed: dict[int, int], known: dict[int, Node]) -> list[Node]:
    """Exports end with what they declare, else with their statement or the body of a nameless function or class."""
    out = []
    for m in _EXPORT.finditer(plain):
        if m.end() in known:
            end = known[m.end()].end
        else:
            block = bool(re.compile(r"(?:async\s+|abstract\s+)*(?:function|class|namespace|module)\b").match(plain, m.end()))
            end = _end_of(plain, m.end(), closed, block)
        out.append(Node("export_statement", m.start(), end))
    return out


def _after_types(plain: str, at: int) -> int:
    """Where type parameters that begin at ``at`` end; ``at`` itself without any."""
    if plain[at : at + 1] != "<":
        return at
    depth = 0
    for i in range(at, len(plain)):
        depth += (plain[i] == "<") - (plain[i] == ">" and plain[i - 1] not in "=-")
        if depth == 0:
            return i + 1
    return at


def _expression_end(plain: str, at: int, closed: dict[int, int]) -> int:
    i = _next_stop(plain, at)
    while i < len(plain) and plain[i] not in ",;)]}" and not (plain[i] == "\n" and not _goes_on(plain, i)):
        i = _next_stop(plain, closed.get(i, len(plain)) + 1 if plain[i] in "([{" else i + 1)
    return min(i, len(plain))


def parse_brackets(code: str, language: str) -> list[Node]:
    """Declarations that the scanner recognizes, nested by their spans."""
    plain = _hidden(code, language)
    closed, found = _closings(plain), []
    for kind, pattern in _PATTERNS[language]:
        if not any(word in plain for word in _NEEDS.get(kind, ("",))):
            continue
        for m in re.finditer(pattern, plain, re.M):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            node, at = Node(kind, start, start, m.groupdict().get("name")), m.end()
            block = kind not in _STATEMENTS
            if kind in _CALLABLE:
                told = _signature(code, plain, at, closed, language)
                if told is None or kind == "method_definition" and not re.compile(r"\s*\{").match(plain, told[2]):
                    continue
                node.parameters, node.returns, at = told
            node.end = _end_of(plain, _after_types(plain, at), closed, block)
            found.append(node)
    if language in ("javascript", "typescript"):
        found += _arrows(code, plain, closed)
        found += _exports(plain, closed, {n.start: n for n in sorted(found, key=lambda n: n.end)})
    found.sort(key=lambda n: (n.start, -n.end, n.kind != "export_statement"))
    top: list[Node] = []
    stack: list[Node] = []
    for node in found:
        while stack and stack[-1].end < node.end:
            stack.pop()
        if node.kind == "method_definition" and not (stack and stack[-1].kind.endswith("class_declaration")):
            continue
        if stack and stack[-1].kind == "export_statement" and not stack[-1].children:
            node.exported = True
            stack[-1].name = node.name
        (stack[-1].children if stack else top).append(node)
        stack.append(node)
    return top


def parse(code: str, language: str) -> list[Node] | None:
    """Top-level nodes, or None where the language has no parser or the code doesn't parse."""
    try:
        if language == "python":
            return parse_python(code)
        return parse_brackets(code, language) if language in _PATTERNS else None
    except (SyntaxError, ValueError, IndexError, RecursionError, MemoryError):
        return None


def extract(code: str, language: str, config: ChunkConfig = ChunkConfig()) -> list[dict]:
    """Chunks of a file, in order of their starts; none where nothing is big enough.

    A semantic node of fitting size is a chunk. A smaller one is searched for chunks within; a larger one gives the
    semantic nodes directly below it that are big enough, of any size, or itself if it has none: an export and a
    decorated definition have one, while parts of a class stand in its body.
    """
    kinds = SEMANTIC_NODES.get(language, ())
    starts = [0] + [m.end() for m in re.finditer("\n", code)]
    out: list[dict] = []

    def emit(node: Node, parent: str | None) -> None:
        body = code[node.start : node.end]
        out.append({
            "type": CHUNK_TYPES.get(node.kind, "block"), "name": node.name, "parent": parent, "parameters": node.parameters, "returns": node.returns,
            "is_async": True if body.startswith("async ") else None, "exported": True if node.exported else None,
            "line_start": bisect_right(starts, node.start), "line_end": bisect_right(starts, max(node.start, node.end - 1)),
            "char_start": node.start, "char_end": node.end, "text": body,
        })

    def walk(node: Node, parent: str | None) -> None:
        size = node.end - node.start
        if node.kind in kinds and size >= config.min_chunk:
            below = node.children if node.kind in DIRECT else []
            parts = [c for c in below if c.kind in kinds and c.end - c.start >= config.min_chunk]
            if size > config.max_chunk and parts:
                for c in parts:
                    emit(c, node.name or parent)
            else:
                emit(node, parent)
            return
        for c in node.children:
            walk(c, node.name or parent)

    for node in parse(code, language) or []:
        walk(node, None)
    return sorted(out, key=lambda c: c["line_start"])


_COLUMNS = {
    "language_id": "string", "type": "string", "name": "string", "parent": "string", "parameters": "array<string>", "returns": "string", "is_async": "boolean",
    "exported": "boolean", "line_start": "int", "line_end": "int", "char_start": "int", "char_end": "int", "text": "string", "seq": "int",
}


def semantic_chunks(files: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks by syntax alone, with metadata; files without any have no rows."""
    key = file_key(files)
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                own = {k: row[k] for k in (*key, "language_id")}
                out += [{**own, "seq": seq, **c} for seq, c in enumerate(extract(row["content"], row["language_id"], config))]
            yield pd.DataFrame(out, columns=[*key, *_COLUMNS])

    known = files.where(F.col("content").isNotNull() & F.col("language_id").isin(*SEMANTIC_NODES))
    schema = ", ".join([*(f"{k} string" for k in key), *(f"{c} {t}" for c, t in _COLUMNS.items())])
    return known.select(*key, "language_id", "content").mapInPandas(run, schema)


def chunk_files(files: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """All chunks of ``files(project_id, relative_path, content, language_id)``, with ``text``.

    Syntax chunks and blocks for the gaps between them; line windows for files without syntax chunks. With a ``user_id``, files
    are kept apart by it.
    """
    key = file_key(files)
    found = materialize(semantic_chunks(files, config), "semantic")
    plain = files.select(*key, "content", "language_id")
    columns = [*key, "hash", "type", "name", "language_id", "line_start", "line_end", "char_start", "char_end", "char_count", "text"]
    flags = lambda gap, fallback: (F.lit(gap).alias("gap_fill"), F.lit(fallback).alias("fallback"))
    semantic = found.withColumn("hash", F.sha2("text", 256)).withColumn("char_count", F.length("text")).select(*columns, *flags(False, False))
    gaps = fill_gaps(found, plain.where(F.col("language_id").isin(*SEMANTIC_NODES)), config).select(*columns, *flags(True, False))
    # Files of other languages need not meet the chunks that were found.
    of_syntax = F.coalesce(F.col("language_id").isin(*SEMANTIC_NODES), F.lit(False))
    rest = plain.where(of_syntax).join(found.select(*key).distinct(), key, "left_anti").unionByName(plain.where(~of_syntax))
    windows = line_windows(rest, config).select(*columns, *flags(False, True))
    return semantic.unionByName(gaps).unionByName(windows)


def sample_sources(files: DataFrame) -> DataFrame:
    """Files of code made of the words of files of prose: Python and TypeScript by turns, some that don't parse."""
    words = F.transform(F.split(F.translate("content", SPACES, " " * len(SPACES)), " "), lambda w: F.regexp_replace(w, r"[^A-Za-z]", ""))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    prose = F.array_join(words, " ")
    python = F.concat(
        F.lit("import os\n\n# "), prose, F.lit("\n\n@cached\ndef "), name, F.lit("(a, b=1):\n    '''"), prose, F.lit("'''\n    return a\n\n\nclass C"), name,
        F.lit(":\n    def one(self):\n        return '"), prose, F.lit("'\n"),
    )
    script = F.concat(
        F.lit("import x from 'y';\n// "), prose, F.lit("\nexport async function "), name, F.lit("(a: string, b: number): string {\n  // "), prose,
        F.lit("\n  return `${a} {`;\n}\n\nclass K"), name, F.lit(" {\n  run(a) {\n    return \""), prose, F.lit("\";\n  }\n}\n"),
    )
    k = F.col("doc_id") % 5
    code = F.when(k < 2, python).when(k < 4, script).otherwise(F.col("content"))
    language = F.when(k < 2, "python").when(k < 4, "typescript").otherwise("python")
    return files.select("project_id", "relative_path", code.alias("content"), language.alias("language_id"))
