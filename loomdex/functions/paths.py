"""Paths, extensions, languages and ignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of each extension; others are "text".
LANGUAGES = {
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".jsx": "javascript",
    ".py": "python",
    ".rs": "rust",
    ".go": "go",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
}

# Extensions that a tree scan and a watch of trees take, those that a plain watch takes, folders
# that a scan skips, patterns that a watch ignores. The engine's own state is in .loomdex.
SCAN_EXTENSIONS = (".js", ".ts", ".tsx", ".jsx")
WATCH_EXTENSIONS = (".js", ".ts", ".tsx", ".jsx", ".py", ".go", ".rs", ".java")
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", ".loomdex")
IGNORED = ("**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/.loomdex/**", "**/*.log")

# Node kinds that become chunks, by language.
SEMANTIC_NODES = {
    "javascript": (
        "function_declaration", "generator_function_declaration", "class_declaration", "method_definition",
        "arrow_function", "lexical_declaration", "variable_declaration", "export_statement",
    ),
    "typescript": (
        "function_declaration", "generator_function_declaration", "class_declaration", "method_definition",
        "arrow_function", "interface_declaration", "type_alias_declaration", "enum_declaration",
        "lexical_declaration", "variable_declaration", "export_statement",
    ),
    "python": ("function_definition", "class_definition", "decorated_definition"),
    "go": ("function_declaration", "method_declaration", "type_declaration", "struct_type", "interface_type"),
    "rust": ("function_item", "impl_item", "struct_item", "enum_item", "trait_item", "mod_item"),
}

# Chunk type of each node kind; others are "block".
CHUNK_TYPES = {
    "function_declaration": "function",
    "function_definition": "function",
    "generator_function_declaration": "function",
    "arrow_function": "function",
    "method_definition": "method",
    "method_declaration": "method",
    "class_declaration": "class",
    "class_definition": "class",
    "interface_declaration": "interface",
    "type_alias_declaration": "type",
    "enum_declaration": "enum",
    "struct_item": "struct",
    "impl_item": "impl",
    "trait_item": "trait",
    "decorated_definition": "function",
}


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def to_relative(path: Column, root: str) -> Column:
    """A path below ``root``, with forward slashes."""
    return F.regexp_replace(slashed(path), "^" + re.escape(root.rstrip("/")) + "/?", "")


def to_absolute(path: Column, root: str) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), slashed(path))


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty where the name has none or begins with its only dot."""
    return F.lower(F.regexp_extract(path, r"[^./\\](\.[^./\\]+)$", 1))


def language(path: Column) -> Column:
    return _lookup(extension(path), LANGUAGES, "text")


def chunk_type(node_kind: Column) -> Column:
    return _lookup(node_kind, CHUNK_TYPES, "block")


def is_semantic(language_: Column, node_kind: Column) -> Column:
    tests = [(language_ == name) & node_kind.isin(*kinds) for name, kinds in SEMANTIC_NODES.items()]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def has_extension(path: Column, extensions=SCAN_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def in_skipped_folder(path: Column, folders=SKIPPED_FOLDERS) -> Column:
    """One of the path's parts is a folder or file that a scan skips."""
    return F.arrays_overlap(F.split(slashed(path), "/"), F.array(*map(F.lit, folders)))


def glob_regex(glob: str) -> str:
    """What a glob means: ``**/`` is any folders or none, ``**`` anything, ``*`` anything within a part."""
    out, at = "", 0
    while at < len(glob):
        for token, regex in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(token, at):
                out, at = out + regex, at + len(token)
                break
        else:
            out, at = out + re.escape(glob[at]), at + 1
    return f"^{out}$"


def is_ignored(path: Column, globs=IGNORED) -> Column:
    """Any pattern matches the whole relative path."""
    return slashed(path).rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
