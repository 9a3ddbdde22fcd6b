"""Credentials in chunk contents: found by key path and value shape, redacted by splicing.

Two readers give values with a key and their offsets in the original. One parses the configuration formats that code and documents hold
(JSON-like maps and lists, YAML, INI, TOML and property lines, XML elements and attributes; tolerant, as contents are cuts of files) into
key paths, and the whole path is tested: a leaf, its last two keys, or a parent, section or element above it. The other takes the word right
before a value, which is all the path there is in assignments, shell variables and flags, table rows, call arguments and annotated prose.
A value is a credential if its key path names one and its shape can be one; values that carry their own mark (issued token formats, authorization values, connection strings with a password, private key blocks) need no key.
Placeholders, references to the environment, digests, ids, public keys and names of fields are none.

Redactions replace just the bytes of the value, so quotes, prefixes, line count and everything else stay as they were.
Null contents have no credential. Repeated rows of a point count once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import require

REDACTED = "REDACTED"

# fixed values: public formats of issued tokens
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:"
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"
    r"|gh[pousr]_[0-9A-Za-z]{36,}"
    r"|github_pat_[0-9A-Za-z_]{40,}"
    r"|xox[abeoprs]-[0-9A-Za-z-]{10,}"
    r"|(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,}"
    r"|sk-(?:ant-|proj-)?[0-9A-Za-z_-]{32,}"
    r"|glpat-[0-9A-Za-z_-]{20}"
    r"|SG\.[0-9A-Za-z_-]{16,32}\.[0-9A-Za-z_-]{16,64}"
    r"|npm_[0-9A-Za-z]{36}"
    r"|pypi-[0-9A-Za-z_-]{50,}"
    r"|hf_[0-9A-Za-z]{30,}"
    r"|ya29\.[0-9A-Za-z_-]{20,}"
    r"|eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"
    r")"
)
_ISSUED_HINTS = (b"akia", b"asia", b"aiza", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"github_pat", b"xox", b"k_live_", b"k_test_", b"sk-", b"glpat-", b"sg.", b"npm_", b"pypi-", b"hf_", b"ya29.", b"eyj")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# the rest of a block without an end: header lines and runs of base64, each up to where its line or string ends
_KEY_OPEN = re.compile(r"(?:(?:\\[nr]|[\s\"'`+#*\\]|//)*(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*|=?(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2}|(?<==)[A-Za-z0-9+/]{4})(?=[ \t]*(?:[\"'`\\+\r\n]|\Z))))*")
_KEY_HEADERS = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*")
# escapes and header lines are kept, runs of base64 between them are key material
_KEY_RUN = re.compile(r"(\\[nrt]|(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*)|[A-Za-z0-9+/=]+")
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://([^\s:/@\"'`<>]*):([^\s/\"'`]+?)@(?=[\w\[.$<{-])", re.I)
_AUTH = re.compile(r"(?<![\w-])(?:bearer|basic|token)[ \t]+([A-Za-z0-9+/=._~-]{16,})", re.I)
# the last word of a key that may be sensitive, what closes the key, and what leads to a value
_TAIL = re.compile(
    rb"(?:password|passwd|passphrase|passwort|passe|pass|pwd|secrets?|secreta|token|key|bearer|auth|authorization|header|credentials?|parola|parolasi|[s?]ifre|[s?]ifresi|kennwort|anahtari|contrase[n?]a|clave|mdp|identity|wachtwoord|schluessel)"
    rb"(?:_\d+)?[\"'`]?\]?[\"'`]?(?:[ \t]*(?::=|=>|[=:](?![=:>])|\||,(?=[ \t]*[\"'`]))|[ \t]+(?=[\"'`])|[ \t]+(?:is|was|to|ist|war|lautet|est|es|olarak)[ \t:]+|[ \t]+(?=[a-z]+[._-][a-z]+[._-]?\d{3}))"
)
_VALUE = re.compile(
    r"""(?:[ \t]*[A-Za-z_][\w.<>\[\]|]*[ \t]*=(?!=))?[ \t(]*(?:\r?\n[ \t]*(?:(?:value|default)["']?[ \t]*[:=][ \t]*)?)?
(?:(?:[A-Za-z_][\w.]*(?:[ \t]+[A-Za-z]+)?\([ \t]*|[rbfu]{1,2}(?=["']))?
(?P<quote>\"{3}|'{3}|["'`])(?:(?P<text>(?:\\.|(?!(?P=quote))[^\\\n]){4,}+)|(?P<plain>[^"'`\n]{4,}+))(?P=quote)
|(?P<bare>[^\s"'`,;(){}\[\]<>|]{6,}+)(?=[\s,;|]|$))""",
    re.X,
)
_KEY_CHARS = re.compile(r"[\w.\-]*$")

# fixed values: last words of a key path that name a credential
_SENSITIVE = re.compile(
    r"(?:^|[_.])(?:(?:pg|my|db)?(?:password|passwd|passphrase|pwd|passwort|kennwort|parola|parolasi|sifre|sifresi|contrasena|contraseña|wachtwoord)"
    r"|(?:db|smtp|ldap|bind|admin|root|user|keystore|store|key|ftp|mail|mysql|redis|proxy|my|the)_pass|pass|mot_de_passe|mdp"
    r"|secret|secrets|token|bearer|api_?key|(?:secret|signing|sign|service|private|access|encryption|encrypt|tls|ssl|ssh|shared|master|account|storage|session|hmac|crypto|subscription|license|auth|app|consumer|deploy|client|admin|root|webhook|server)_key"
    r"|credential|credentials|authorization|auth|auth_header|auth_token|cookie_secret|erisim_anahtari|gizli_anahtar|anahtari|clave_secreta|clave|cle_secrete|schluessel|identity|ssh_identity)"
    r"(?:_\d+)?$"
)
_NOT_SENSITIVE = re.compile(r"(?:^|[_.])(?:public|verify|verification|sort|primary|foreign|partition|cache|csrf_field|max|min|num|total|count)_(?:key|token|tokens)(?:_\d+)?$")
_PLACEHOLDER = re.compile(
    r"(?:[x*.#_\-•?0]{3,}|<.*>|\[.*\]|\{.*\}|\$.*|%[({\w].*[)}%]s?|.*\$\{.*|.*\{\{.*|.*<[a-z _-]+>.*"
    r"|(?:your|my|the|some|an?|insert|enter|put|add|set|change|replace|fill|paste|use|example|sample|dummy|fake|test|mock|todo|tbd|redacted|removed|hidden|masked|placeholder|secret|password|passwd|token|changeme|none|null|undefined|true|false|default)"
    r"(?:[_\- .]?(?:your|my|the|a|me|it|here|this|api|secret|access|auth|key|token|password|passwd|pass|value|string|name|in|here|placeholder|example|client|private|goes|123)){0,6}[_\- .!]*\d{0,4})",
    re.I,
)
_REFERENCE = re.compile(r"(?:process\.env|os\.environ|getenv|env\.|ENV\[|secrets?\.|vault:|ssm:|arn:|config\.|settings\.|self\.|this\.|file:|https?:)", re.I)
_DIGEST = re.compile(r"(?:sha(?:1|224|256|384|512)|md5)[-:$]", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def key_name(raw: str) -> str:
    """A key as lower-case words joined by underscores."""
    return re.sub(r"[^\w.]+", "_", _CAMEL.sub("_", raw.strip("\"'`$-@{}[]").replace("-", "_"))).lower().strip("_")


def sensitive(path: str) -> bool:
    return bool(_SENSITIVE.search(path)) and not _NOT_SENSITIVE.search(path)


def secret_shape(value: str, quoted: bool = True) -> bool:
    """Whether a value could be a credential rather than a word, a name, a reference or a placeholder."""
    v = value.strip()
    if len(v) < 6 or any(c.isspace() for c in v) or _PLACEHOLDER.fullmatch(v) or _REFERENCE.match(v) or _DIGEST.match(v):
        return False
    digits, lower, upper = (any(f(c) for c in v) for f in (str.isdigit, str.islower, str.isupper))
    signs = sum(not c.isalnum() for c in v)
    strong = any(c in "!@#$%^&*?+/=~" for c in v)
    if not quoted:
        # a bare word in code is a name, a number or an expression
        n = sum(c.isdigit() for c in v)
        if not (lower or upper) or not n:
            return strong and lower and upper and len(v) >= 8 and v.isascii() and not re.search(r"[/=+?*&]\w*$", v)
        dashed = v.count("-") >= 2 and n >= 3
        return lower and upper and n >= 3 or dashed or strong and len(v) >= 8 or len(v) >= 20 and "." not in v and "_" not in v
    if digits and (lower or upper):
        return len(v) >= 8 and not re.fullmatch(r"[a-z]+(?:[_.-][a-z]+)*[_.-]?\d{1,2}", v) and not re.fullmatch(r"[vV]?\d+(?:\.\d+)+\w*", v) and not re.match(r"[\w.-]+\.(?:py|js|ts|tsx|java|md|json|ya?ml|txt|pem|key|example|com|org)\b", v)
    if lower and upper:
        turns = len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", v))
        return strong and signs <= 4 and "/" not in v or len(v) >= 20 and not signs and turns >= 7
    return False


def assignments(text: str, raw: bytes) -> Iterator[tuple[str, int, int, bool]]:
    """(key, start, end, quoted) of every value whose key is sensitive."""
    held = 0
    for m in _TAIL.finditer(raw):
        # what looks like a key within a long credential is part of it
        if m.end() < held:
            continue
        v = _VALUE.match(text, m.end())
        if not v:
            continue
        tail = m.start() + re.match(rb"[\w?]+", m.group()).end()
        head = _KEY_CHARS.search(text[text.rfind("\n", 0, m.start()) + 1 : tail]).group()
        if not sensitive(key_name(head)):
            continue
        group = next(g for g in ("text", "plain", "bare") if v.group(g) is not None)
        lo, hi = v.span(group)
        yield head, lo, hi, group != "bare"
        if hi - lo > 400 and secret_shape(text[lo:hi], group != "bare"):
            held = hi


# fixed values: last words of a key path under which a plain word with digits or a phrase is a password too
_PASSWORD = re.compile(r"(?:password|passwd|passphrase|pwd|passwort|kennwort|parola|parolasi|sifre|sifresi|contrasena|contraseña|wachtwoord|(?:^|_)pass|mot_de_passe)$")
_ASSIGNED = re.compile(r"[=:]>?[ \t]*(?:\"{3}|'{3}|[\"'`])$")
_PLAIN_PASSWORD = re.compile(r"(?=.{6,})(?:[a-z]+\d+|\d+[a-z]+)[a-z\d]*|(?=.{16,})[a-z]{2,}(?:([ -])[a-z]{2,})(?:\1[a-z]{2,}){2,}")


def plain_password(path: str, text: str, lo: int, hi: int) -> bool:
    """Whether a quoted value assigned to a password is a weak one: a lower-case word with digits, or four words and more. Single words are names as a rule, and are left."""
    return bool(_PASSWORD.search(path) and _PLAIN_PASSWORD.fullmatch(text, lo, hi) and _ASSIGNED.search(text[max(0, lo - 60) : lo]) and not _PLACEHOLDER.fullmatch(text, lo, hi))


# words a sensitive path holds, in a place other than a leaf before its value: a map or list below, a section, a dotted name, an element, a leaf "key"
_WORDS = rb"(?:passw|passphrase|pwd|passe?(?![a-z])|secret|token|keys?(?![a-z])|bearer|auth|credential|parola|sifre|\?ifre|kennwort|anahtari|contrase|clave|mdp|identity|wachtwoord|schluessel)"
_NESTED = re.compile(_WORDS + rb"[\w?-]*(?:\.|[\"'`]?\]?[ \t]*(?:(?:=>|:=|[:=])[ \t]*(?:[\[{(|>&!#]|\r?\n|\Z)|\]|\r?\n[ \t]*\{))|(?<![a-z0-9_])key[\"']?[ \t]*[:=]|\[[^\]\n]*" + _WORDS + rb"|<[^<>]*" + _WORDS)
_LINE = re.compile(r"([ \t]*(?:-[ \t]+)*)(.*)")
_SECTION = re.compile(r"\[{1,2}[ \t]*([\w.\-/:\"' ]+?)[ \t]*\]{1,2}[ \t]*(?:[#;].*)?$")
_PAIR = re.compile(r"(?:(?:export|const|let|var|final|static|private|public|String)[ \t]+)*(?P<q>[\"'`]?)(?P<key>[A-Za-z_$@][\w.\-$/]*)(?P=q)\]?\s*(?:=>|:=|[:=](?![=:]))[ \t]*")
_STRING = re.compile(r"[rbfu]{0,2}(?P<quote>\"{3}|'{3}|[\"'`])(?P<text>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote)")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>|]+")
_SKIP = re.compile(r"[\s,;]+|//[^\n]*|(?<![^\s,;{\[(])#[^\n]*|/\*[\s\S]*?(?:\*/|\Z)")
_ELEMENT = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|(?<!\w)<(?P<open>[A-Za-z_][\w.:-]*)(?P<attributes>(?:\s+[\w.:-]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(?P<empty>/?)>|</(?P<close>[A-Za-z_][\w.:-]*)\s*>")
_INNER = re.compile(r"\s*(?:<!\[CDATA\[([^\]\s]+)\]\]>|([^<>\s]+))\s*</([A-Za-z_][\w.:-]*)\s*>")
_ATTRIBUTE = re.compile(r"([\w.:-]+)\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)')")
# fixed values: leaves that describe the credential of their parent and hold none
_DESCRIBES = re.compile(
    r"(?:^|_)(?:name|user|username|login|email|type|kind|class|ids?|uuid|ur[li]|host|hostname|port|path|file|filename|dir|region|endpoint|alg|algorithm|issuer|audience|scopes?|expir\w+|ttl|length|size|format|version|env|enabled|description|label|provider|method|header|prefix|suffix|date|at|"
    r"hash|digest|sha\d*|md5|checksum|fingerprint|public_key|arn|ref|status|pattern|regex|placeholder|example|hint|title|count|min|max|field|tag|domain|realm|namespace|bucket|database|schema|table|mode|charset|encoding|driver|image|repository|branch|commit|import|from|require|version|comment|message|text)$"
)


# fixed values: parents under which a sensitive name is a text about the field, not a credential
_UNLIKE = frozenset("i18n l10n locale locales translation translations label labels message messages placeholder placeholders hint hints tooltip tooltips".split())


def sensitive_path(path: list[str]) -> bool:
    """Whether a key path names a credential: by its leaf, its last two keys read as one, or a parent whose leaf does not just describe it.
    An empty last key is an item of a list."""
    words = [w for k in path if (n := key_name(k)) for w in n.split(".") if w]
    if not words or _NOT_SENSITIVE.search("_".join(words[-2:])) or _UNLIKE.intersection(words[:-1]):
        return False
    if sensitive(words[-1]) or sensitive("_".join(words[-2:])) or not path[-1] and sensitive(words[-1].removesuffix("s")):
        return True
    # a map or list of credentials may have its name in the plural
    return not _DESCRIBES.search(words[-1]) and any(sensitive(w) or sensitive(w.removesuffix("s")) for w in words[:-1])


def _scalar(text: str, at: int, end: int) -> tuple[int, int, int, bool] | None:
    """(after, start, end, quoted) of the quoted or bare value at an offset."""
    if m := _STRING.match(text, at, end):
        return m.end(), m.start("text"), m.end("text"), True
    if m := _BARE.match(text, at, end):
        return m.end(), m.start(), m.end(), False
    return None


def _flow(text: str, at: int, above: list[str], key: str) -> Iterator[tuple[list[str], int, int, bool] | int]:
    """Values of the JSON-like map or list whose bracket is at an offset; last, the offset after it, -1 if it does not end."""
    n = len(text)
    stack: list[str] = []
    while at < n:
        if m := _SKIP.match(text, at):
            if m.group()[0] in ",;" or m.group()[-1] in ",;":
                key = ""
            at = m.end()
        elif text[at] in "{[(":
            stack.append(key)
            key, at = "", at + 1
        elif text[at] in "}])":
            stack.pop()
            key, at = "", at + 1
            if not stack:
                yield at
                return
        elif m := _PAIR.match(text, at):
            key, at = m.group("key"), m.end()
        elif v := _scalar(text, at, n):
            at = v[0]
            yield [*above, *filter(None, stack), key], *v[1:]
            key = ""
        else:
            at += 1
    yield -1


def _lines(text: str) -> Iterator[tuple[list[str], int, int, bool]]:
    """Values of YAML, INI, TOML and properties lines and of the JSON-like maps in them."""
    section: list[str] = []
    parents: list[tuple[int, str]] = []
    at, n = 0, len(text)
    whole = True
    while at < n:
        m = _LINE.match(text, at)
        start, end = m.start(2), m.end()
        body = m.group(2)
        at = end + 1
        if not body.strip() or body.startswith(("#", ";", "//")):
            continue
        lead = m.group(1)
        if not lead and (s := _SECTION.match(body)):
            section, parents = [s.group(1)], []
            continue
        if body.startswith("---") and not lead:
            section, parents = [], []
            continue
        dash = lead.find("-")
        # an item of a list may stand as deep as the key above it
        parents = [p for p in parents if p[0] < (len(lead) if dash < 0 else dash + 1)]
        if dash >= 0:
            parents = [p for p in parents if p[0] <= dash]
        above = [*section, *(k for _, k in parents)]
        key = ""
        if p := _PAIR.match(text, start, end):
            key, start = p.group("key"), p.end()
            while start < end and text[start] in "&!":
                start = min((k for k in (text.find(" ", start, end), end) if k >= 0)) + 1
            rest = text[start:end].strip()
            if not rest or rest[0] in "|>#" or re.fullmatch(r"\\", rest):
                follows = re.compile(r"\s*([{\[])").match(text, end)
                if not rest and follows:
                    start = follows.start(1)
                else:
                    parents.append((len(lead), key))
                    continue
        opened = start if text.startswith(("{", "["), start) else -1 if key and text[start] in "\"'`" else text.find("{", start, end)
        if opened >= 0 and not whole:
            if opened == start and key:
                parents.append((len(lead), key))
        elif opened >= 0:
            for v in _flow(text, opened, above, key if opened == start else ""):
                if isinstance(v, tuple):
                    yield v
                elif v < 0:
                    # a bracket without end: the rest is read again by lines alone
                    whole = False
                    if opened == start and key:
                        parents.append((len(lead), key))
                else:
                    # what follows on the line is no key of its own
                    at = (text.find("\n", v) + 1 or n + 1) if v > end else at
        elif (key or above) and (v := _scalar(text, start, end)) and (v[3] or text[v[0] : end].strip()[:1] in ("", "#", ",", ";")):
            yield [*above, key], *v[1:]


def _elements(text: str) -> Iterator[tuple[list[str], int, int, bool]]:
    """Texts and attributes of XML elements."""
    stack: list[tuple[str, str]] = []
    last: dict[str, int] = {}
    for m in _ELEMENT.finditer(text):
        if name := m.group("close"):
            if any(t == name for t, _ in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if not (name := m.group("open")):
            continue
        given = {a.group(1).lower(): a for a in _ATTRIBUTE.finditer(text, m.start("attributes"), m.end("attributes"))}
        named = next((given[k].group(2) or given[k].group(3) for k in ("name", "key") if k in given), None)
        above = [t for _, t in stack]
        for k, a in given.items():
            g = 2 if a.group(2) is not None else 3
            if k not in ("name", "key"):
                yield [*above, name, *([named] if named and k == "value" else [k])], a.start(g), a.end(g), True
        if m.group("empty"):
            continue
        own = named or name
        if (inner := _INNER.match(text, m.end())) and inner.group(3) == name:
            g = 1 if inner.group(1) else 2
            yield [*above, own], inner.start(g), inner.end(g), True
        # a type argument is no element: those end, or stand alone on their line
        if name not in last:
            last[name] = text.rfind(f"</{name}")
        if last[name] > m.start() or not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip() and text[m.end() : m.end() + 1] in ("\n", "\r"):
            stack.append((name, own))


def parsed(text: str) -> list[tuple[list[str], int, int, bool]]:
    """(key path, start, end, quoted) of all values that the configuration formats in a text hold."""
    return [*_lines(text), *(_elements(text) if "<" in text else ())]


def nested(text: str, raw: bytes) -> list[tuple[str, int, int, bool]]:
    """The parsed values under a sensitive path."""
    if not _NESTED.search(raw) and not _TAIL.search(raw):
        return []
    return [(_joined(path), lo, hi, quoted) for path, lo, hi, quoted in parsed(text) if hi - lo >= 6 and sensitive_path(path)]


def _joined(path: list[str]) -> str:
    return ".".join(filter(None, map(key_name, path)))


def key_values(text: str, raw: bytes) -> list[tuple[str, int, int, bool]]:
    """(key path, start, end, quoted) of the values that a sensitive key leads to, in order of start.

    Where a configuration format holds a value, its whole key path decides. Elsewhere, in code, tables and prose, the key right before the value does.
    """
    loose = list(assignments(text, raw))
    if not loose and not _NESTED.search(raw):
        return []
    at: dict[int, list[str]] = {}
    out = []
    for path, lo, hi, quoted in parsed(text):
        # the shortest path is that of the format the value stands in; a longer one may come from a line read as two formats
        at.setdefault(lo, path)
        if hi - lo >= 6 and sensitive_path(path):
            out.append((_joined(path), lo, hi, quoted))
    for head, lo, hi, quoted in loose:
        if lo not in at or not _UNLIKE.intersection(w for k in at[lo][:-1] for w in key_name(k).split(".")):
            out.append((_joined(at[lo]) if lo in at else key_name(head), lo, hi, quoted))
    return sorted(out, key=lambda v: (v[1], -v[2]))


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of credentials, in order and without overlap; offsets are characters."""
    # one byte for each character, so offsets agree
    raw = text.encode("ascii", "replace").lower()
    spans: list[tuple[int, int, str]] = []
    for m in _KEY_BLOCK.finditer(text) if b"private key" in raw else ():
        end = _KEY_END.search(text, m.end())
        other = _KEY_BLOCK.search(text, m.end())
        if end and other and other.start() < end.start():
            end = None
        stop = end.start() if end else _KEY_OPEN.match(text, m.end(), other.start() if other else len(text)).end()
        body = re.sub(r"\\[nr]|[\s\"'+#*/\\,]|//", "", text[m.end() : end.start() if end else other.start() if other else len(text)])
        if (re.match(r"(?:Proc-Type|DEK-Info|Version|Comment)", body) or re.match(r"[A-Za-z0-9+=]{24,}", body)) and re.sub(REDACTED, "", _KEY_HEADERS.sub("", text[m.end() : stop])).strip("\\nr \t\r\n\"'+`#*/,"):
            spans.append((m.start(), end.end() if end else stop, "private_key"))
    for m in ISSUED.finditer(text) if any(h in raw for h in _ISSUED_HINTS) else ():
        if "EXAMPLE" not in m.group() and not re.search(r"(?i)x{6,}|0{8,}|\*{3,}|12345678|your", m.group()):
            spans.append((m.start(), m.end(), "issued_token"))
    for m in _URL.finditer(text) if b"://" in raw and b"@" in raw else ():
        if not _PLACEHOLDER.fullmatch(m.group(2)) and m.group(2).lower() not in ("pass", "pw", "pwd"):
            spans.append((m.start(2), m.end(2), "connection"))
    for m in _AUTH.finditer(text) if any(h in raw for h in (b"bearer", b"basic ", b"token ")) else ():
        v = m.group(1)
        # the word token leads to a value only where it is the scheme of a header
        scheme = m.group()[:5].lower() != "token" or re.search(r"[\"'`:=][ \t]*$", text[max(0, m.start() - 8) : m.start()])
        if scheme and not _PLACEHOLDER.fullmatch(v) and (secret_shape(v) or len(v) >= 20 and v.endswith("=")):
            spans.append((m.start(1), m.end(1), "authorization"))
    for path, lo, hi, quoted in key_values(text, raw):
        if (secret_shape(text[lo:hi], quoted) or quoted and plain_password(path, text, lo, hi)) and "://" not in text[lo:hi] and "-----BEGIN" not in text[lo:hi]:
            spans.append((lo, hi, "key_value"))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if out and s[0] < out[-1][1]:
            continue
        out.append(s)
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    pieces, last = [], 0
    for lo, hi, kind in spans:
        pieces.append(text[last:lo])
        value = text[lo:hi]
        if kind == "private_key":
            # the markers, header lines and the line structure stay; every run of base64 goes, a short last one too
            begin = value[: value.index("-----", value.index("BEGIN")) + 5]
            end = _KEY_END.search(value)
            body = value[len(begin) : end.start() if end else len(value)]
            pieces.append(begin + _KEY_RUN.sub(lambda m: m.group(1) if m.group(1) is not None else REDACTED if m.group() != REDACTED else m.group(), body) + (value[end.start() :] if end else ""))
        else:
            pieces.append(REDACTED)
        last = hi
    pieces.append(text[last:])
    return "".join(pieces)


def _chunks(chunks: DataFrame) -> DataFrame:
    return require(chunks, "point_id", "content").where("point_id IS NOT NULL AND content IS NOT NULL")


def credential_spans(chunks: DataFrame) -> DataFrame:
    """(point_id, line_no, kind, key_path, byte_start, byte_end); offsets in the UTF-8 bytes of content, key_path of key_value only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for point, text in zip(b.column("point_id").to_pylist(), b.column("content").to_pylist()):
                spans = find(text)
                if spans:
                    feeds = [m.start() for m in re.finditer("\n", text)]
                    paths = {lo: path for path, lo, _, _ in key_values(text, text.encode("ascii", "replace").lower())} if any(k == "key_value" for _, _, k in spans) else {}
                    rows += [(point, bisect_right(feeds, lo) + 1, kind, paths.get(lo) if kind == "key_value" else None, len(text[:lo].encode()), len(text[:hi].encode())) for lo, hi, kind in spans]
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=["point_id", "line_no", "kind", "key_path", "byte_start", "byte_end"])

    return _chunks(chunks).mapInArrow(run, "point_id bigint, line_no int, kind string, key_path string, byte_start bigint, byte_end bigint")


def credential_lines(chunks: DataFrame) -> DataFrame:
    """Distinct (point_id, line_no)."""
    return credential_spans(chunks).select("point_id", "line_no").distinct()


def redacted(chunks: DataFrame) -> DataFrame:
    """(point_id, credentials, content) of the points that hold credentials; content has the redactions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for point, text in zip(b.column("point_id").to_pylist(), b.column("content").to_pylist()):
                spans = find(text)
                if spans:
                    rows.append((point, len(spans), redact(text, spans)))
            types = [pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, types)], names=["point_id", "credentials", "content"])

    return _chunks(chunks).mapInArrow(run, "point_id bigint, credentials int, content string").dropDuplicates(["point_id"])
