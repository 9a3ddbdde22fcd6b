"""Lexers for ECMAScript, TypeScript, TSX and Java with one pushdown stack.

The stack holds open delimiters with what they enclose (block, object, group, template field, markup), so that a closing brace
leads back into the right mode: a statement, an expression, a template literal or markup. Between delimiters a two-state
automaton (an operand is due, an operator is due) finds literals, operands and keywords where the language has no place for them.
"""

from __future__ import annotations

import re

_WORD = r"(?:[^\W\d]|[$]|\\u)(?:\w|[$]|\\u)*"
_COMMON = r"""(?P<nl>[^\S\n]*\n\s*)
|(?P<skip>[^\S\n]+|//[^\n]*)
|(?P<comment>/\*)
|(?P<run>(?:-?\d[\d.]*,[ ]?){2,})
|(?P<text>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')
"""
_SCRIPT = re.compile(
    _COMMON
    + rf"""|(?P<name>[#]?{_WORD})
|(?P<number>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$]))
|(?P<tick>`)
|(?P<open>[(\[{{])
|(?P<close>[)\]}}])
|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|\*\*|[-+*%&|^!~<>=?:;,.@/])
|(?P<other>[\s\S])""",
    re.X,
)
_JAVA = re.compile(
    _COMMON.replace("'(?:[^'\\\\\\n]|\\\\[\\s\\S])*'", r"'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))'")
    .replace('(?P<text>"', r'(?P<block>"{3}[ \t\f]*\r?\n(?:[^\\]|\\[\s\S])*?"{3})|(?P<text>"')
    + rf"""|(?P<name>{_WORD})
|(?P<number>(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))
|(?P<open>[(\[{{])
|(?P<close>[)\]}}])
|(?P<op>\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|[-+*%&|^!~<>=?:;,.@/])
|(?P<other>[\s\S])""",
    re.X,
)
_PARTNER = {")": "(", "]": "[", "}": "{"}
_MARK = re.compile(r"(?:<{7}|>{7}|={7}|\|{7})(?: |\r?$)", re.M)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_MARKUP_TEXT = re.compile(r"[^<{}>]*")
_TAG = re.compile(r"[A-Za-z_$][\w$.:-]*")
_ATTRIBUTE = re.compile(r"""\s*(?:([A-Za-z_$][\w$:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|\{))?|(\{)|(/>)|(>))""")
_GENERIC_ARROW = re.compile(r"<\s*[A-Za-z_$][\w$]*(?:\s+extends\b|\s*,)")

_BINARY = {"in", "of", "instanceof", "as", "from", "extends", "implements", "is", "satisfies", "throws", "permits"}
_OPERATOR_WORDS = {"return", "throw", "typeof", "delete", "void", "new", "await", "yield", "case", "else", "do", "extends", "implements", "default", "in", "of", "instanceof", "import", "export", "from", "throws", "try", "finally"}
_JS_LEAD = _OPERATOR_WORDS | {"const", "let", "var", "function", "class", "async", "static", "get", "set", "break", "continue", "if", "for", "while", "switch", "catch", "with"}
_TS_LEAD = _JS_LEAD | {"type", "interface", "enum", "declare", "namespace", "module", "abstract", "public", "private", "protected", "readonly", "override", "keyof", "infer", "unique", "asserts", "accessor", "is", "as", "satisfies", "implements", "out", "global"}
_JAVA_LEAD = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "class", "interface", "enum", "record", "package", "import", "return", "throw", "throws", "new", "case", "else", "do", "try", "finally", "extends", "implements", "instanceof", "assert", "break", "continue", "yield", "sealed", "permits", "goto", "if", "for", "while", "switch", "catch", "non"}
_JAVA_TOP = {"package", "import", "public", "private", "protected", "static", "final", "abstract", "strictfp", "class", "interface", "enum", "record", "sealed", "non", "@", ";"}
_PAREN = {"if", "while", "for", "switch", "catch", "with"}
_MUST_OPEN = {"if", "while", "for", "switch"}
_UNARY = {"!", "~", "+", "-", "++", "--", "...", "@", "typeof"}
_END_OK = {";", "}", ")", "]", ","}
START, OPERAND, OPERATOR, ANY = 0, 1, 2, 3


class _Frame:
    __slots__ = ("char", "kind", "ternaries", "head")

    def __init__(self, char: str, kind: str, head: str = "") -> None:
        self.char, self.kind, self.ternaries, self.head = char, kind, 0, head


def find_error(text: str, language: str) -> str | None:
    """The kind of the first syntax error met in js, ts, tsx or java; None if there is none."""
    java, script, markup = language == "java", language == "js", language == "tsx"
    match = (_JAVA if java else _SCRIPT).match
    lead = _JAVA_LEAD if java else _JS_LEAD if script else _TS_LEAD
    at, n = 0, len(text)
    if text.startswith("﻿"):
        at = 1
    if text.startswith("#!", at) and not java:
        at = text.find("\n") if "\n" in text else n
    known: dict[int, int] = {}
    stack: list[_Frame] = [_Frame("", "block")]
    state, last, last2, fresh = START, "", "", True
    head = declared = ""
    at_line, annotated = True, False
    while at < n:
        m = match(text, at)
        kind = m.lastgroup
        if at_line and kind != "nl" and text[at] in "<>=|" and _MARK.match(text, at):
            return "conflict"
        begin, at = at, m.end()
        if kind == "nl":
            at_line = at == n or text[at - 1] == "\n" or text[begin:at].rsplit("\n", 1)[1] == ""
            fresh = True
            continue
        at_line = False
        if kind == "skip":
            continue
        if kind == "comment":
            end = text.find("*/", at)
            if end < 0:
                return "literal"
            fresh = fresh or "\n" in text[at:end]
            at = end + 2
            continue
        top = stack[-1]
        if kind == "run":
            if state == OPERAND:
                return "adjacent"
            state, last2, last = OPERATOR, last, ","
            fresh = False
            continue
        if kind == "name":
            word = m.group()
            if state == START:
                head, declared = word, ""
                if java and len(stack) == 1 and word not in _JAVA_TOP:
                    return "top"
            if last in (".", "?."):
                state, last2, last = OPERAND, last, "final" if annotated else word
                fresh = False
                continue
            if java and word in ("const", "goto", "function", "export", "let") and state == START:
                return "other"
            if java and last == "@" and word != "interface":
                # an annotation is a modifier of what follows
                state, last2, last = OPERAND, last, "final"
                annotated, fresh = True, False
                continue
            annotated = False
            if java and word == "enum":
                declared = "enum"
            if state == OPERAND:
                same_line = java or not fresh
                if last in _MUST_OPEN and word != "await":
                    return "header"
                if last in lead or word in _BINARY or last == "as" and head in ("import", "export") or word in ("default", "while") and java:
                    pass
                elif java:
                    # a type before a name; two plain names in a row need a modifier, type arguments or an array before them
                    if last == "]" or last == ">":
                        pass
                    elif last in _END_OK or last == '"' or last == "0":
                        if not (last == ")" and (word in ("throws", "default") or stack[-1].kind in ("block", "object"))) and not (last == ")" and stack[-1].head == "@"):
                            return "adjacent"
                        if last == ")" and word != "throws" and top.kind == "block" and head not in ("if", "for", "while", "else", "do", "switch", "try", "catch", "synchronized", "@") and last2 != "@":
                            return "adjacent"
                    elif last2 not in _JAVA_LEAD and last2 not in ("", ";", "{", "}", "(", ",", ".", ">", "]", ":", "->", "&", "@", "|", ")", "?", "<"):
                        return "adjacent"
                elif same_line:
                    if word in ("while",) and last == ")":
                        pass
                    elif last == ")" and head in ("if", "for", "while", "with", "else", "do") and top.kind != "group":
                        pass
                    elif last == ")" and top.kind == "block" and stack[-1].char in ("", "{") and last2 == "@":
                        pass
                    elif not script and (last in ("?", "!", ">", "]", ")") or word in ("is", "as", "satisfies")) and last in (">", ")") and head == "@":
                        pass
                    elif not script and word in ("is",):
                        pass
                    else:
                        return "adjacent"
            elif state == OPERATOR and word in ("in", "of", "instanceof") and last not in lead and top.kind not in ("object", "import") and not (java and word in ("of", "in")) and last not in ("(", ",", "=", "{", ":", "&&", "||"):
                return "premature"
            if word in ("const", "let", "var") and not java and (state in (START, ANY) or last in ("export", "declare", "(")):
                declared = word if last != "declare" else ""
                state = OPERATOR
            elif word == "void" and not java and not script and last in (":", "=>", "|", "<", ",", "&") or word == "new" and last == "::":
                state = OPERAND
            elif word in _OPERATOR_WORDS and (word not in ("default", "from", "of", "in", "import") or word in ("in", "of", "instanceof")) and not (java and word in ("of", "in", "typeof", "delete", "await", "from", "export", "void")):
                state = OPERATOR if word not in ("else", "do", "try", "finally", "return", "yield") else OPERATOR if word in ("return", "yield") else START
            else:
                state = OPERAND
            last2, last = last, word
            fresh = False
            continue
        if kind == "op":
            op = m.group()
            if op == "/":
                if not java and (state in (START, OPERATOR) or state == ANY and fresh and _REGEX.match(text, begin)):
                    r = _REGEX.match(text, begin)
                    if not r:
                        return "literal"
                    at, state, last2, last = r.end(), OPERAND, last, '"'
                    fresh = False
                    continue
                if text.startswith("=", at):
                    at += 1
            if op == "<" and not java and (state in (START, OPERATOR) or state == ANY and fresh):
                if script:
                    return "markup"
                if markup and not _GENERIC_ARROW.match(text, begin):
                    end = _markup(text, begin, stack, known)
                    if end is None:
                        return "markup"
                    at, mode = end
                    if mode == "field":
                        state, last2, last = OPERATOR, last, "{"
                    else:
                        state, last2, last = OPERAND, last, '"'
                    fresh = False
                    continue
                if not markup and (text.startswith("<!", begin) or text.startswith("</", begin) or text.startswith("<>", begin)):
                    return "markup"
                # type parameters or an assertion: an operand is still due
                depth_end = _angle(text, begin, known)
                if depth_end < 0:
                    return "markup"
                at = depth_end
                state, last2, last = (OPERATOR if state == OPERATOR else state), last, ">"
                fresh = False
                continue
            if op == "<" and state == OPERAND and not script and (end := _angle(text, begin, known)) > 0:
                # type arguments stay within the operand before them
                at, last2, last = end, last, ">"
                fresh = False
                continue
            if op in ("@",):
                if state == OPERAND and not fresh and not java or text.startswith("@", at):
                    return "other"
                if state == START:
                    head = "@"
                state, last2, last = OPERATOR, last, "@"
                fresh = False
                continue
            if op == ";":
                if state == OPERATOR and not _ends(last) and top.head != "for" and not (top.kind == "enum" and last == ","):
                    return "premature"
                if top.char in ("(", "[") and top.head != "for" and not (java and top.head == "try"):
                    return "delimiter"
                if declared == "const" and top.char != "(":
                    return "declaration"
                state, last2, last = START, last, ";"
                declared = ""
                fresh = False
                continue
            if op == "=>" or op == "->":
                if java and op == "=>" or state == OPERATOR and last != ")":
                    return "other"
                state = OPERATOR
            elif op in ("++", "--"):
                state = OPERAND if state == OPERAND and not fresh else OPERATOR
            elif op == "...":
                state = OPERATOR
            elif op == "?":
                if state == OPERATOR and not (java and last in ("<", ",")) and not (not script and last in ("-", "+", ")")):
                    return "premature"
                if not script and not java and re.compile(r"\s*[:),\];]").match(text, at):
                    # an optional member or parameter
                    state = OPERAND
                elif java and last in ("<", ","):
                    state = OPERAND
                else:
                    top.ternaries += 1
                    state = OPERATOR
            elif op == ":":
                if top.ternaries:
                    top.ternaries -= 1
                    if state == OPERATOR and last != ")":
                        return "premature"
                    state = OPERATOR
                elif script and (top.char in ("(", "[") or declared and last2 in ("const", "let", "var") or last == ")" and head not in ("case",)):
                    return "annotation"
                elif last == '"' and top.kind == "block" and top.head == "{" and head not in ("case", "default"):
                    return "other"
                elif top.char == "{" and top.kind == "block" and head in ("case", "default"):
                    state = START
                elif top.kind == "block" and last2 in ("", ";", "{", "}") and re.compile(r"\s*(?:for|while|do|\{)").match(text, at) and state == OPERAND:
                    state = START
                else:
                    state = OPERATOR
            elif op == "=":
                if state in (OPERATOR, START) and last not in ("?",):
                    return "premature"
                if declared and top.char != "(":
                    declared = "="
                state = OPERATOR
            elif op == ",":
                if state == OPERATOR and last not in (",", "[", "*", "?", "(") or state == START and last not in ("}",):
                    return "premature"
                if last == "(" or last == "," and top.char == "(":
                    return "premature"
                if declared == "=" and top.kind == "block":
                    declared = "let"
                state = OPERATOR
            elif op in _UNARY:
                state = OPERAND if op == "!" and state == OPERAND and not script and not java and text[at : at + 1] != "=" else OPERATOR
            elif op == "*":
                state = OPERAND if last in ("import", "export") or last == "," and head == "import" else OPERATOR
            elif op in (".", "?.", "::"):
                if state == OPERATOR and last not in ("import", "new") and not (last == "super"):
                    return "premature"
                state = OPERATOR if op != "::" else OPERATOR
            elif op in ("|", "&"):
                # a union or intersection type may begin with its sign
                if state == OPERATOR and script or state == START:
                    return "premature"
                state = OPERATOR
            elif op in ("<", ">"):
                if state == START and not (java and op == "<") or java and op == ">" and last == "=":
                    return "premature"
                if op == ">" and state == OPERATOR and last not in ("?", ",", "<", "=") and script:
                    return "premature"
                state = ANY if op == ">" and not script else OPERATOR
            else:
                if state in (OPERATOR, START) and last not in ("?",):
                    return "premature"
                state = OPERATOR
            last2, last = last, op
            fresh = False
            continue
        if kind == "open":
            c = m.group()
            if c == "(":
                h = last if last in _PAREN or last in ("try",) else head if last == "await" and head == "for" else ""
                if java and annotated:
                    h = "@"
                elif java and not h and state in (OPERATOR, START):
                    h = "cast"
                if state == START:
                    head = "("
                annotated = False
                stack.append(_Frame(c, "group", h))
                state = OPERATOR
            elif c == "[":
                stack.append(_Frame(c, "array"))
                state = OPERATOR
            else:
                if last in ("if", "while", "for", "switch") and not (last2 in (".", "?.")) and state != OPERATOR and top.kind != "object":
                    return "header"
                if not java and (last in ("import", "export") or head in ("import", "export") and last in ("type", ",") and top.kind == "block"):
                    k = "import"
                elif java:
                    k = "enum" if declared == "enum" else "array" if last in ("=", "]", ",", "(") and state != START or last == "{" and top.kind == "array" or last == "]" else "block"
                elif state in (START,) or last in (")", "=>", "else", "do", "try", "finally", ">", "catch", "static") or state == ANY:
                    k = "block"
                elif state == OPERAND:
                    # after a name: a class, interface, enum, namespace or a function's return type
                    if last == '"' and head not in ("declare", "module", "import", "export", "case"):
                        return "adjacent"
                    k = "enum" if head == "enum" or last2 == "enum" else "block"
                else:
                    k = "import" if head in ("import", "export") and last in ("import", "export", ",", "type") and top.kind == "block" else "object"
                if last == "=>":
                    k = "block"
                if k == "block" and state in (START, ANY) and last in ("", ";", "{", "}") and not java:
                    head = "{"
                stack.append(_Frame(c, k, head))
                if java and k == "array":
                    state = OPERATOR
                else:
                    state = OPERATOR if k in ("object", "import", "enum") else START
                if k == "block" or java:
                    head = head if k == "array" else ""
                    declared = ""
            last2, last = last, c
            fresh = False
            continue
        if kind == "close":
            c = m.group()
            if len(stack) == 1 or top.char != _PARTNER[c] or top.kind == "markup":
                return "delimiter"
            if state == OPERATOR and last not in (",", top.char, ";") and not (c == "}" and _ends(last)) and not (last == "*" and c in ")]}") and last not in ("?",):
                return "premature"
            if c == "}" and top.kind == "block" and (state == OPERATOR and last == "," and script or java and last not in (";", "}", "{")):
                return "premature"
            stack.pop()
            if top.kind == "template":
                end = _template(text, at, stack)
                if end < 0:
                    return "literal"
                at = end
                if text[at - 1] == "{":
                    state, last2, last = OPERATOR, last, "{"
                else:
                    state, last2, last = OPERAND, last, '"'
                fresh = False
                continue
            if top.kind == "field":
                # back into markup
                end = _markup(text, at, stack, known, True)
                if end is None:
                    return "markup"
                at, mode = end
                state, last2, last = (OPERATOR, last, "{") if mode == "field" else (OPERAND, last, '"')
                fresh = False
                continue
            if c == "}":
                if top.kind == "block" or java and top.kind == "enum":
                    state = ANY if not java else START
                    if java and stack[-1].char in ("(", "[") or java and stack[-1].kind == "array":
                        state = OPERAND
                    elif not java and (stack[-1].char in ("(", "[") or stack[-1].kind in ("object",)):
                        state = OPERAND
                    head = "}" if state in (START, ANY) else head
                else:
                    state = OPERAND
            else:
                state = OPERAND
                if c == ")" and top.head == "@":
                    state, last2, last, annotated = OPERAND, last, "final", False
                    fresh = False
                    continue
                if c == ")" and top.head == "cast":
                    state = ANY
                if c == ")" and top.head in _PAREN | {"try"}:
                    state = START if top.head != "catch" else OPERAND
                    if top.head in ("switch", "try"):
                        state = OPERAND
            last2, last = last, c
            fresh = False
            continue
        if kind in ("text", "number", "block"):
            if state == OPERAND:
                if (last in lead or last in ("from", "import", "module", "as")) and kind != "block":
                    pass
                elif java or not fresh:
                    return "adjacent"
            state, last2, last = OPERAND, last, '"' if kind != "number" else "0"
            fresh = False
            continue
        if kind == "tick":
            end = _template(text, at, stack)
            if end < 0:
                return "literal"
            at = end
            state, last2, last = (OPERATOR, last, "{") if text[at - 1] == "{" else (OPERAND, last, '"')
            fresh = False
            continue
        return "literal" if m.group() in "\"'" else "other"
    if len(stack) > 1:
        return "unclosed"
    if state == OPERATOR and not _ends(last):
        return "premature"
    if declared == "const":
        return "declaration"
    if java and last not in ("", ";", "}"):
        return "premature"
    return None


def _ends(last: str) -> bool:
    return last in ("return", "break", "continue", "yield", "++", "--", ";", "default", "*")


def _template(text: str, at: int, stack: list[_Frame]) -> int:
    """End of a template's text from at: after its tick, or after the brace of a field, which is pushed."""
    end = _TEMPLATE.match(text, at).end()
    if end >= len(text):
        return -1
    if text[end] == "`":
        return end + 1
    stack.append(_Frame("{", "template"))
    return end + 2


_ASIDE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*[\s\S]*?\*/")


def _angle(text: str, at: int, known: dict[int, int]) -> int:
    """End of a list of type arguments that begins at, -1 if it is none. known has the ends found so far: a scan settles every list it meets."""
    if at in known:
        return known[at]
    n, first = len(text), at
    # of each open list: where it begins, the brackets around it, whether it can still be one
    lists: list[list[int]] = []
    square = 0
    while at < n:
        c = text[at]
        if c == "<":
            lists.append([at, square, 1])
        elif c == ">":
            if text[at - 1] != "=" and text[at - 1] != "-":
                begin, level, open_ = lists.pop()
                known[begin] = at + 1 if open_ and square == level else -1
                if not lists:
                    return known[first]
        elif c in "([{":
            square += 1
        elif c in ")]}":
            square -= 1
            if square < 0:
                break
            for x in reversed(lists):
                if x[1] <= square:
                    break
                x[2] = 0
        elif c in "\"'/" and (m := _ASIDE.match(text, at)):
            at = m.end()
            continue
        elif c == ";":
            if not square:
                break
            for x in reversed(lists):
                if x[1] < square:
                    break
                x[2] = 0
        elif c == "&" and text.startswith("&&", at) or c == "|" and text.startswith("||", at) or c in "+*/%!`^~" or c == "=" and text.startswith("==", at):
            break
        elif c.isdigit() and not (text[at - 1].isalnum() or text[at - 1] in "_$") and text[at - 1] not in " <,|[":
            break
        at += 1
    known.update((x[0], -1) for x in lists)
    return -1


def _markup(text: str, at: int, stack: list[_Frame], known: dict[int, int], inside: bool = False) -> tuple[int, str] | None:
    """Follow markup from at. Returns (position, mode): mode "field" after the brace of a field, "end" after the last closing tag."""
    n = len(text)
    # the frames of open tags are of kind markup; .head is the tag's name, .char "<" in a tag, ">" in its content
    if inside and (stack[-1].kind != "markup"):
        return None
    first = not inside
    while at < n:
        if not first and stack[-1].char == ">":
            at = _MARKUP_TEXT.match(text, at).end()
            if at >= n:
                return None
            c = text[at]
            if c == "{":
                stack.append(_Frame("{", "field"))
                return at + 1, "field"
            if c in "}>":
                return None
        if first or stack[-1].char == ">":
            # text[at] is "<"
            if text.startswith("</", at):
                m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, at)
                if not m or m.group(1) != stack[-1].head:
                    return None
                stack.pop()
                at = m.end()
                if stack[-1].kind != "markup":
                    return at, "end"
                continue
            m = _TAG.match(text, at + 1)
            first = False
            if text.startswith("<>", at):
                stack.append(_Frame(">", "markup"))
                at += 2
                continue
            if not m:
                return None
            stack.append(_Frame("<", "markup", m.group()))
            at = m.end()
            if text.startswith("<", at):
                at = _angle(text, at, known)
                if at < 0:
                    return None
            continue
        m = _ATTRIBUTE.match(text, at)
        if not m:
            return None
        at = m.end()
        if m.group(2) == "{" or m.group(3):
            stack.append(_Frame("{", "field"))
            return at, "field"
        if m.group(4):
            stack.pop()
            if stack[-1].kind != "markup":
                return at, "end"
        elif m.group(5):
            stack[-1].char = ">"
    return None
