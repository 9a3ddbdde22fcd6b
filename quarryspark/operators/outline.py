"""Declarations of a source text as line ranges: Python by its own parser, brace languages by a scanner of statements.

A node is a Declaration with its line range (decorators and export keywords included), kind, name and inner declarations.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, field

BRACE = {".js": "script", ".ts": "script", ".tsx": "script", ".java": "java"}


@dataclass
class Declaration:
    start: int
    end: int
    kind: str | None = None
    name: str | None = None
    inner: list["Declaration"] = field(default_factory=list)


def _python(body: list[ast.stmt]) -> list[Declaration]:
    out = []
    for s in body:
        d = Declaration(min([s.lineno, *(x.lineno for x in getattr(s, "decorator_list", []))]), s.end_lineno or s.lineno)
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            d.kind, d.name = ("class" if isinstance(s, ast.ClassDef) else "function"), s.name
            d.inner = _python(s.body)
        out.append(d)
    return out


_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)")
_REGEX = re.compile(r"/(?![/*\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_NAME = r"([A-Za-z_$][\w$]*)"
_SCRIPT = [(re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?{p}"), k) for p, k in ((rf"(?:async\s+)?function\s*\*?\s*{_NAME}", "function"), (rf"(?:abstract\s+)?class\s+{_NAME}", "class"), (rf"interface\s+{_NAME}", "interface"), (rf"type\s+{_NAME}[^=\n]*=", "type"), (rf"(?:const\s+)?enum\s+{_NAME}", "enum"))]
_SCRIPT_MEMBER = re.compile(rf"(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\([^;]*\)[^;]*\{{", re.S)
_MODIFIERS = r"(?:@[\w.]+(?:\([^)]*\))?\s+|(?:public|private|protected|static|final|abstract|synchronized|native|strictfp|default|sealed|non-sealed)\s+)*"
_JAVA = [(re.compile(_MODIFIERS + p), k) for p, k in ((rf"class\s+{_NAME}", "class"), (rf"@interface\s+{_NAME}", "annotation"), (rf"interface\s+{_NAME}", "interface"), (rf"enum\s+{_NAME}", "enum"), (rf"record\s+{_NAME}\s*[(<]", "record"))]
_JAVA_METHOD = re.compile(_MODIFIERS + rf"(?:<[^>{{]*>\s*)?(?:[\w.$<>\[\],? ]+?\s+)?{_NAME}\s*\([^;{{]*\)\s*(?:throws\s[\w.,\s]+)?\{{")
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "synchronized", "function"}


def _statements(text: str, lo: int, hi: int, script: bool) -> list[tuple[int, int, int]]:
    """(start, end, offset of the first brace or -1) of statements of text[lo:hi]."""
    out = []
    at, start, brace, depth = lo, -1, -1, 0
    before = ""
    while at < hi:
        c = text[at]
        if c in "/\"'`":
            m = _SKIP.match(text, at) or (_REGEX.match(text, at) if script and before in "(,=:[!&|?{};>" or not before else None)
            if m:
                comment = text.startswith(("//", "/*"), at)
                if start < 0 and not comment:
                    start = at
                at = min(m.end(), hi)
                if not comment:
                    before = '"'
                continue
        if c.isspace():
            if c == "\n" and script and depth == 0 and start >= 0 and before not in ",=([{&|?:+-*<>.":
                rest = re.compile(r"\s*(\S)").match(text, at)
                if not rest or rest.end() > hi or rest.group(1) not in ".?:&|,=+*<>({[)" and not re.compile(r"\s*(?:extends|implements|else|catch|finally|while)\b").match(text, at):
                    out.append((start, at, brace))
                    start, brace = -1, -1
            at += 1
            continue
        if start < 0:
            start = at
        if c in "([{":
            if c == "{" and depth == 0 and brace < 0:
                brace = at
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
            if c == "}" and depth == 0:
                rest = re.compile(r"\s*(?:(else|catch|finally|while|from)\b|([;,.(=?:&|]))").match(text, at + 1)
                if not rest or rest.end() > hi:
                    out.append((start, at + 1, brace))
                    start, brace = -1, -1
        elif c == ";" and depth == 0:
            out.append((start, at + 1, brace))
            start, brace = -1, -1
        before = c
        at += 1
    if start >= 0:
        out.append((start, hi, brace))
    return out


def _brace(text: str, lo: int, hi: int, script: bool, parent: str | None, feeds: list[int], depth: int = 0) -> list[Declaration]:
    from bisect import bisect_left

    line = lambda pos: bisect_left(feeds, pos) + 1
    out = []
    for start, end, brace in _statements(text, lo, hi, script):
        d = Declaration(line(start), line(max(start, end - 1)))
        for pattern, kind in _SCRIPT if script else _JAVA:
            if m := pattern.match(text, start):
                d.kind, d.name = kind, m.group(1)
                break
        else:
            if parent in ("class", "interface", "enum", "record") and brace >= 0:
                head = text[start : brace + 1]
                m = (_SCRIPT_MEMBER if script else _JAVA_METHOD).match(head)
                if m and m.group(1) not in _CONTROL:
                    d.kind, d.name = "method", m.group(1)
                    if not script and re.fullmatch(_MODIFIERS + r"(?:<[^>]*>\s*)?", head[: m.start(1)]):
                        d.kind = "constructor"
        if d.kind and brace >= 0 and depth < 4:
            d.inner = _brace(text, brace + 1, end - 1, script, d.kind, feeds, depth + 1)
        out.append(d)
    return out


def outline(extension: str, text: str) -> list[Declaration] | None:
    """Top-level nodes in order, None where the language has no parser or the text does not parse."""
    if extension == ".py":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return _python(ast.parse(text).body)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
    if extension in BRACE:
        return _brace(text, 0, len(text), BRACE[extension] == "script", None, [m.start() for m in re.finditer("\n", text)])
    return None
