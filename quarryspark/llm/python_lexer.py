"""Lexer for Python 3.13 with a pushdown stack of delimiters and indents."""

from __future__ import annotations

import ast
import re
import warnings

_TOKEN = re.compile(
    r"""(?P<nl>\n)
|(?P<skip>[ \t\f\r]+|\\\r?\n|\#[^\n]*)
|(?P<text>(?:[uUrRbB]|[bB][rR]|[rR][bB])?(?:\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}|"(?!"")(?:[^"\\\n]|\\[\s\S])*"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'))
|(?P<format>(?:[fF][rR]?|[rR][fF])(?:\"{3}|'{3}|"|'))
|(?P<broken>(?:[uUrRbB]{1,2})?["'])
|(?P<number>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[jJ]?(?!\w))
|(?P<name>[^\W\d]\w*)
|(?P<open>[(\[{])
|(?P<close>[)\]}])
|(?P<op>\.\.\.|\*\*=|//=|>>=|<<=|!=|:=|->|[-+*/%@&|^=<>]=|\*\*|//|<<|>>|[-+*/%@&|^=<>~:;,.])
|(?P<other>[\s\S])""",
    re.X,
)
_PARTNER = {")": "(", "]": "[", "}": "{"}
_HEADER = {"if", "while", "for", "def", "class", "try", "else", "elif", "except", "finally", "with", "async"}
_VALUE = {"None", "True", "False", "pass", "break", "continue"}
_BINARY = {"and", "or", "in", "is", "if", "else", "for", "as", "from", "import"}
_PREFIX = {"return", "del", "assert", "raise", "yield", "await", "lambda", "not", "elif", "while", "with", "global", "nonlocal", "class", "def", "async", "except", "try", "finally"}
_ALONE = {"return", "raise", "yield", "else", "try", "finally", "except", "lambda", "async"}
_GLUED = re.compile(r"\d[\d_.]*(?:and|or|in|is|if|else|for)\b")
_OLD_OCTAL = re.compile(r"0[0-9_]*[1-9][0-9_]*$")
_MARK = re.compile(r"(?:<{7}|>{7}|={7}|\|{7})(?: |\r?$)", re.M)
_LITERAL = {q: re.compile(r"(?:[^\\{}" + ("\n" if len(q) == 1 else "") + q[0] + r"]|\\[\s\S]|\{\{|\}\}" + ("" if len(q) == 1 else "|" + q[0] + "(?!" + q[1:] + ")") + ")*") for q in ('"', "'", '"""', "'''")}
START, OPERAND, OPERATOR = 0, 1, 2


def _format_end(text: str, at: int, quote: str, deep: int = 0) -> int:
    """End of a formatted literal whose text starts at, -1 if it has none. Fields may nest literals, also with the same quotes."""
    n = len(text)
    literal = _LITERAL[quote].match
    while True:
        at = literal(text, at).end()
        if text.startswith(quote, at):
            return at + len(quote)
        if at >= n or text[at] != "{" or deep > 40:
            return -1
        stack = ["{"]
        at += 1
        while stack:
            if at >= n:
                return -1
            c = text[at]
            if c in "([{":
                stack.append(c)
                at += 1
            elif c in ")]}":
                if stack.pop() != _PARTNER[c]:
                    return -1
                at += 1
            elif c in "\"'":
                if text.startswith(quote, at) and len(stack) == 1 and text[at - 1] == ":":
                    return -1
                q = c * 3 if text.startswith(c * 3, at) else c
                start = at
                while start and text[start - 1] in "fFrR":
                    start -= 1
                if text[start:at].lower().find("f") >= 0:
                    end = _format_end(text, at + len(q), q, deep + 1)
                else:
                    m = re.compile(rf"(?:[^\\{'' if len(q) == 3 else chr(10) + c}]|\\[\s\S])*?{q}").match(text, at + len(q))
                    end = m.end() if m else -1
                if end < 0:
                    return -1
                at = end
            elif c == "\n" and len(quote) == 1 and len(stack) == 1:
                # a field may run over lines, its literal may not; a quote left open ends here in practice
                return -1
            else:
                at += 1


_COMPOUND = frozenset("if elif else for while with try except finally def class async match case".split())


def find_error(text: str) -> str | None:
    """The kind of the first syntax error the lexer meets, None if it meets none."""
    if text.startswith("﻿"):
        text = text[1:]
    if "\0" in text:
        return "other"
    stack: list[str] = []
    indents = [0]
    state, line_start, expect_block = START, True, False
    first = last = ""
    colon = imported = negated = decorated = False
    lambdas = [0]
    subscript: list[bool] = []
    tries: list[int] = []
    at, n = 0, len(text)
    match = _TOKEN.match
    while at < n:
        m = match(text, at)
        kind = m.lastgroup
        if line_start and kind != "nl":
            begin = at
            if kind == "skip":
                body = m.group()
                if body[0] in "#\\" or body.startswith("\r"):
                    at = m.end()
                    continue
                column = 0
                for c in body:
                    column = (column // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else column + (c == " ")
                at = m.end()
                if at >= n or text[at] in "#\n":
                    continue
                m = match(text, at)
                kind = m.lastgroup
                if kind == "skip":
                    continue
            else:
                column = 0
            if _MARK.match(text, begin):
                return "conflict"
            line_start = False
            if column > indents[-1]:
                if not expect_block:
                    return "indent"
                indents.append(column)
            else:
                if expect_block:
                    return "indent"
                while column < indents[-1]:
                    indents.pop()
                if column != indents[-1]:
                    return "indent"
            expect_block = False
            state, colon, imported, first, last = START, False, False, m.group(), ""
            lambdas = [0]
            if tries and column <= tries[-1]:
                if column < tries[-1] or first not in ("except", "finally"):
                    return "block"
                tries.pop()
            if first == "try":
                tries.append(column)
        at = m.end()
        if kind == "skip":
            continue
        if negated and m.group() != "in":
            return "adjacent"
        negated = False
        if kind == "name":
            word = m.group()
            if state == START and (last == ":" and word in _COMPOUND or not last and word in ("and", "or", "is", "in", "as")):
                return "header"
            if word in _VALUE:
                if state == OPERAND:
                    return "adjacent"
                state = OPERAND
            elif word in _BINARY:
                if state == OPERATOR and not (word == "import" and last == ".") and not (word == "from" and last in ("yield", "raise")) and not (word in ("in",) and last == "not") and not (last == "async" and word == "for") and not (word == "if" and last == "else"):
                    return "premature"
                imported = imported or word == "import"
                state = OPERATOR
            elif word in _PREFIX:
                if state == OPERAND and not (word == "not") and not (word == "async"):
                    return "adjacent"
                negated = word == "not" and state == OPERAND
                if word == "lambda":
                    lambdas[-1] += 1
                state = OPERATOR
            else:
                if state == OPERAND and not (last in ("match", "case", "type") and first == last):
                    return "adjacent"
                state = OPERAND
            last = word
            continue
        if kind == "op":
            op = m.group()
            if op == "...":
                state = OPERAND
            elif op == ":":
                if not stack and not lambdas[-1]:
                    if state == OPERATOR and last not in _ALONE and last not in ("*",):
                        return "premature"
                    if last == ":":
                        return "premature"
                    colon = True
                    state = START
                else:
                    if lambdas[-1] and last == "=":
                        return "premature"
                    lambdas[-1] -= lambdas[-1] > 0
                    state = OPERATOR
            elif op == ";":
                state = START
            elif op in ("-", "+", "~", "*", "**", "@", ".", "/"):
                # between two operands, not the mark of an argument list
                op = op + op if state == OPERAND and op in "*/" else op
                state = OPERATOR
            else:
                if state != OPERAND and op not in (",", "->") :
                    return "premature"
                if op == "," and (state == START or not stack and first in ("raise", "except", "print")):
                    return "premature"
                if op == "," and state == OPERATOR and last not in ("*", "/", ":", "["):
                    return "premature"
                if op == "=" and not stack and not lambdas[-1] and first in ("if", "elif", "while") and not colon:
                    return "premature"
                state = OPERATOR
            last = op
            continue
        if kind == "nl":
            if stack:
                continue
            if line_start:
                continue
            if state == OPERATOR and last not in _ALONE and last not in (",", "*"):
                return "premature"
            if first in _HEADER and not colon or first == "from" and not imported or lambdas[-1] or last == ":" and first not in _COMPOUND:
                return "header"
            expect_block = last == ":" and colon
            decorated = first == "@"
            line_start = True
            continue
        if kind == "text":
            if state == OPERAND and last != '"' and not (last in ("match", "case") and first == last):
                return "adjacent"
            state, last = OPERAND, '"'
            continue
        if kind == "open":
            c = m.group()
            if c == "{" and state == OPERAND and not (last in ("match", "case") and first == last):
                return "adjacent"
            stack.append(c)
            subscript.append(c == "[" and state == OPERAND)
            lambdas.append(0)
            state, last = OPERATOR, c
            continue
        if kind == "close":
            c = m.group()
            if not stack or stack.pop() != _PARTNER[c]:
                return "delimiter"
            if lambdas.pop() or subscript.pop() and last == "[" or c == "}" and last == ":":
                return "premature"
            if state == OPERATOR and last not in (",", ":", "*", "/", "(", "[", "{", "yield"):
                return "premature"
            state, last = OPERAND, c
            continue
        if kind == "format":
            quote = m.group().lstrip("fFrR")
            if len(quote) == 1 and text.startswith(quote * 2, at - 1) and text.startswith(quote * 3, at - 1):
                quote *= 3
                at += 2
            end = _format_end(text, at, quote)
            if end < 0:
                return "literal"
            if state == OPERAND and last != '"':
                return "adjacent"
            at, state, last = end, OPERAND, '"'
            continue
        if kind == "number":
            if state == OPERAND:
                return "adjacent"
            if _OLD_OCTAL.match(m.group()):
                return "other"
            state, last = OPERAND, "0"
            continue
        if kind == "broken":
            return "literal"
        if kind == "other" and (g := _GLUED.match(text, m.start())):
            at = m.start() + re.compile(r"[\d_.]+").match(text, m.start()).end() - m.start()
            state, last = OPERAND, "0"
            continue
        return "other"
    if stack:
        return "unclosed"
    if not line_start:
        if state == OPERATOR and last not in _ALONE and last not in (",", "*"):
            return "premature"
        if first in _HEADER and not colon or first == "from" and not imported or lambdas[-1] or last == ":" and first not in _COMPOUND:
            return "header"
        expect_block = last == ":" and colon
        decorated = first == "@"
    if decorated:
        return "premature"
    return "premature" if expect_block else "block" if tries else None


def confirmed(text: str) -> bool:
    """Whether the interpreter's own parser rejects the text; asked only about what the lexer found."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError):
        return True
    except (RecursionError, MemoryError):
        return False
    return False
