"""Syntax facts of source files: calls, functions and assignments. Python by its own parser, other languages by tokens."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import matching as m
from siftstone.schema import ASSIGNS, CALLS, SYMBOLS

#: Language by suffix; fixed values.
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "sh": "bash", "bash": "bash", "ps1": "powershell", "lua": "lua", "dart": "dart",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "groovy": "groovy", "gradle": "groovy",
}
_HASH = {"python", "ruby", "bash", "powershell", "php"}
_WORDS = {"if", "for", "while", "switch", "return", "catch", "function", "func", "fn", "def", "sizeof", "elif", "match", "with", "and", "or", "not", "in", "new", "foreach", "unless", "until", "using", "lock", "await", "yield", "else"}
_NAME = r"[A-Za-z_$@][\w$]*"
_CALLEE = re.compile(rf"({_NAME}(?:(?:\.|::|->|\?\.){_NAME}|-[A-Z]\w*)*)\s*!?\(")
_ASSIGN = re.compile(rf"(?:^|[;{{(\s])(?:(?:const|let|var|val|final|auto|local|my|mut|string|int|char|String)\s+)*(?:mut\s+)?(\$?{_NAME})\s*(?::\s*[\w<>\[\]., ]+)?\s*(?::=|=)(?![=~>])\s*([^;\n]+)")
_IDENT = re.compile(rf"(?<![\w.$:]){_NAME}")


def language(path: Column) -> Column:
    """Language of a file by suffix, or by the name Jenkinsfile; null for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(F.lower(m.leaf(path)) == "jenkinsfile", "groovy").otherwise(F.try_element_at(table, m.extension(path)))


def _blank(text: str, lang: str) -> str:
    """Comments and the insides of strings as spaces, line breaks kept."""
    marks = [r"\"(?:\\.|[^\"\\\n])*\"", r"'(?:\\.|[^'\\\n])*'"]
    if lang in _HASH:
        marks.insert(0, r"#[^\n]*")
    if lang == "lua":
        marks.insert(0, r"--[^\n]*")
    elif lang not in ("python", "ruby", "bash", "powershell"):
        marks[:0] = [r"//[^\n]*", r"/\*.*?\*/", r"`(?:\\.|[^`\\])*`"]
    if lang == "python":
        marks[:0] = [r'"""(?:.|\n)*?"""', r"'''(?:.|\n)*?'''"]
    keep = lambda s: re.sub(r"[^\n]", " ", s)

    def blanked(found):
        s = found.group()
        return s[0] + keep(s[1:-1]) + s[-1] if s[0] in "\"'`" and len(s) > 1 else keep(s)

    return re.sub("|".join(f"(?:{x})" for x in marks), blanked, text, flags=re.S)


def _closing(text: str) -> dict[int, int]:
    """Where each opening bracket is closed; those that aren't, are at the end of the text."""
    out, open_ = {}, []
    for found in re.finditer(r"[()]", text):
        if found.group() == "(":
            open_.append(found.start())
        elif open_:
            out[open_.pop()] = found.start()
    return out | dict.fromkeys(open_, len(text))


def _names(text: str) -> tuple[list[str], list[str]]:
    """Identifiers and callees in a piece of code."""
    calls = [c.replace("::", "::").replace("->", ".").replace("?.", ".") for c in _CALLEE.findall(text)]
    member = [x for x in re.findall(rf"{_NAME}(?:\.{_NAME})+", text)]
    idents = [x for x in _IDENT.findall(text) if x not in _WORDS]
    return list(dict.fromkeys(idents)), list(dict.fromkeys([*calls, *member]))


def by_tokens(text: str, lang: str) -> tuple[list, list, list]:
    """Symbols, calls and assignments, approximately."""
    code = _blank(text, lang)
    starts = [0, *[i + 1 for i, c in enumerate(code) if c == "\n"]]
    import bisect

    line_of = lambda at: bisect.bisect_right(starts, at)
    symbols, calls, assigns, closing = [], [], [], _closing(code)
    for found in _CALLEE.finditer(code):
        callee = found.group(1).replace("->", ".").replace("?.", ".")
        before = code[max(0, found.start() - 12) : found.start()]
        line = line_of(found.start())
        if callee in _WORDS:
            continue
        if re.search(r"\b(?:def|function|func|fn|fun)\s+(?:\([^)]*\)\s*)?$", before):
            symbols.append(("function", callee, line))
            continue
        idents, inner = _names(code[found.end() : closing[found.end() - 1]])
        symbols.append(("call", callee, line))
        calls.append((callee, line, idents, inner))
    if lang == "powershell":
        for found in re.finditer(r"(?m)^\s*(Invoke-Expression|iex)\b([^\n]*)", code, re.I):
            idents, inner = _names(found.group(2))
            symbols.append(("call", found.group(1), line_of(found.start(1))))
            calls.append((found.group(1), line_of(found.start(1)), idents, inner))
    if lang == "bash":
        for found in re.finditer(r"(?m)(?:^|[;&|])\s*(eval|exec)\s+([^\n]*)", code):
            symbols.append(("call", found.group(1), line_of(found.start(1))))
            calls.append((found.group(1), line_of(found.start(1)), *_names(found.group(2))))
    for found in _ASSIGN.finditer(code):
        idents, inner = _names(found.group(2))
        assigns.append((found.group(1), line_of(found.start(1)), idents, inner))
    return symbols, calls, assigns


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    if isinstance(node, ast.Subscript):
        return _dotted(node.value)
    return ""


def _facts(nodes: list[ast.AST]) -> tuple[list[str], list[str]]:
    idents, calls = [], []
    for top in nodes:
        for node in ast.walk(top):
            if isinstance(node, ast.Name):
                idents.append(node.id)
            elif isinstance(node, ast.Call):
                calls.append(_dotted(node.func))
            elif isinstance(node, (ast.Subscript, ast.Attribute)):
                calls.append(_dotted(node))
    return list(dict.fromkeys(idents)), list(dict.fromkeys(c for c in calls if c))


def by_parser(text: str) -> tuple[list, list, list]:
    """The same of Python source; SyntaxError for text that isn't."""
    symbols, calls, assigns = [], [], []

    def visit(node: ast.AST) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            symbols.append(("function", node.name, node.lineno))
        elif isinstance(node, ast.Call):
            callee = _dotted(node.func)
            if callee:
                symbols.append(("call", callee, node.lineno))
                calls.append((callee, node.lineno, *_facts([*node.args, *[k.value for k in node.keywords]])))
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and node.value is not None:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for target in targets:
                for name in ast.walk(target):
                    if isinstance(name, ast.Name):
                        assigns.append((name.id, node.lineno, *_facts([node.value])))
        for child in ast.iter_child_nodes(node):
            visit(child)

    visit(ast.parse(text))
    return symbols, calls, assigns


def _extract(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
    rows = []
    for text, lang in zip(texts, langs, strict=True):
        try:
            found = by_parser(text) if lang == "python" else by_tokens(text, lang)
        except (SyntaxError, ValueError, RecursionError):
            found = by_tokens(text, lang)
        symbols, calls, assigns = found
        rows.append(
            (
                [{"kind": k, "name": n, "line": at} for k, n, at in symbols],
                [{"callee": c, "line": at, "arg_idents": i, "arg_calls": x} for c, at, i, x in calls],
                [{"target": t, "line": at, "rhs_idents": i, "rhs_calls": x} for t, at, i, x in assigns],
            )
        )
    return pd.DataFrame(rows, columns=["symbols", "calls", "assigns"])


def syntax(files: DataFrame) -> DataFrame:
    """(path, lang, symbols, calls, assigns, ...) of source files; other files are left out."""
    rows = files.withColumn("lang", language(F.col("path"))).where("lang is not null and text is not null")
    keep = [c for c in files.columns if c != "text"]
    extract = F.pandas_udf(_extract, f"struct<symbols:{SYMBOLS},calls:{CALLS},assigns:{ASSIGNS}>")
    return rows.withColumn("_x", extract("text", "lang")).select(*keep, "lang", "_x.symbols", "_x.calls", "_x.assigns")
