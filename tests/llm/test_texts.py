import random

import numpy as np

from quarryspark.llm import credentials as C
from quarryspark.llm import generated as G
from quarryspark.llm import leakage as L
from quarryspark.llm import page_spam as S
from quarryspark.llm import pair_defects as D
from quarryspark.llm import syntax as X

# leakage


def brute(docs, items, k):
    grams = {}
    for i, p in items:
        w = L.words(p or "")
        for j in range(len(w) - k + 1):
            grams.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = set()
    for d, t in docs:
        w = L.words(t or "")
        for j in range(len(w) - k + 1):
            out |= {(d, i) for i in grams.get(tuple(w[j : j + k]), ())}
    return out


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    for alphabet in ("ab", "abcdefghij"):
        items = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))) for i in range(40)]
        docs = [(d, " ".join(rng.choice(alphabet + "z") for _ in range(rng.randint(0, 90)))) for d in range(120)]
        docs += [(500 + i, f"z {p} z") for i, p in items]
        for k in (3, 5, 9):
            sam = L.build(items, k)
            assert {(d, i) for d, t in docs for i, _, _ in L.matches(sam, t, k)} == brute(docs, items, k)


def test_words():
    assert L.words("A_b-C1 İstek, été") == ["a", "b", "c1", "i̇stek", "été"]


def test_leaks_in_spark(spark, monkeypatch):
    passage = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(1, passage), (2, passage.upper()), (3, "short one"), (4, None), (1, passage)], "item_id bigint, passage string")
    docs = spark.createDataFrame([(1, f"Before, {passage.replace(' ', '_ ')} after.", 0), (2, " ".join(passage.split()[:12]), 0), (3, None, 0), (4, "", 0), (5, "x " * 200 + passage, 0), (5, "x " * 200 + passage, 0)], "doc_id bigint, text string, item_id int")
    expected = {(1, 1), (1, 2), (5, 1), (5, 2)}
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == expected
    clean = {r.doc_id: r for r in L.decontaminate(docs, items).collect()}
    assert clean[1].dropped and clean[1].text is None and clean[1].items == [1, 2]
    assert not clean[5].dropped and "word" not in clean[5].text and clean[5].removed_words == 30
    monkeypatch.setattr(L, "BLOCK_WORDS", 31)
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == expected
    assert {r.doc_id: r for r in L.decontaminate(docs, items).collect()} == clean
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0


# credentials: values are put together here so that no text of the repository looks like one
AWS = "AKIA" + "Q7ZP" * 4
HEX = "3df147970841fb2b01e4" + "212f81c828f2"


def lines_of(text):
    return [text.count("\n", 0, lo) + 1 for lo, _, _ in C.find(text)]


def test_credentials():
    yes = [
        f'x = "{AWS}"', f"// old apiKey: {AWS}", f'access_token = "{HEX}"', 'String dbPassword = "Margin.' + 'Large6931";', "passwd: Tide-" + "Sparse1311", "| PAROLA | 84bX1" + "nQ#msqxK |",
        'f({ user: "a", adminPwd: "bl0ck$' + '4810" })', 'call("keystorePass", "Hive!' + 'Mapped3309")', "DATABASE_URL=redis://lever:f8bhi5" + "FX4@h.example/x", 'h = "Basic Y2F0YWxvZzpwdWdm' + 'RGh5"',
        "curl -H 'Authorization: Token vDmITj574T1Rhx" + "jeZWVL'", "password:\n  value: Zx81" + "qq!Pw",
    ]
    for t in yes:
        assert len(C.find(t)) == 1, t
    no = [
        'password = "${DB_PASSWORD}"', 'password = os.environ["X1"]', 'token = "<your-token>"', 'secret = "xxxxxxxx"', 'db = "postgres://u:****@h/x"', f'commit_sha = "{HEX}"', f'file_digest = "{HEX}"', 'token_type = "client_secret"',
        'PASSWORD_FIELD = "passwd"', 'api_key_header = "X-Api-Key"', "token = handle.read(35)", 'KEY_3 = "strict roadmap"', "public_key = '-----BEGIN PUBLIC KEY-----\\nabc'", 'id = "5d960caa-3a3d-d521-85ea-27d930341e20"', "", "password",
    ]
    for t in no:
        assert C.find(t) == [], t


def test_private_keys_and_redaction():
    body = "Qf" * 32
    text = f"a = 1\n-----BEGIN RSA PRIVATE KEY-----\n{body}\n{body}\n-----END RSA PRIVATE KEY-----\npwd = 'é'\nsecret_key = '{HEX}'\n"
    assert lines_of(text) == [2, 7]
    out = C.redact(text, C.find(text))
    assert body not in out and HEX not in out and out.count("\n") == text.count("\n") and "-----END RSA PRIVATE KEY-----" in out and out.startswith("a = 1\n") and out.endswith("secret_key = 'REDACTED'\n")
    assert C.find(out) == []
    assert C.find("if line.startswith('-----BEGIN RSA PRIVATE KEY-----'): pass") == []


def test_credentials_in_spark(spark):
    rows = [(1, f"é\napi:\n  secret_key: '{HEX}'\n"), (1, f"é\napi:\n  secret_key: '{HEX}'\n"), (2, None), (3, ""), (4, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "point_id bigint, content string, line_no int")
    assert [tuple(r) for r in C.credential_lines(df).collect()] == [(1, 3)]
    r = C.credential_spans(df).first()
    assert rows[0][1].encode()[r.byte_start : r.byte_end].decode() == HEX and r.key_path == "api.secret_key"
    assert C.redacted(df).count() == 1 and C.credential_lines(df.limit(0)).count() == 0


def test_credentials_below_a_sensitive_parent():
    v = "Tide!" + "Sparse1311x"
    yes = {
        f"credentials:\n  github: {v}\n": "credentials.github", f"[db.password]\nvalue = {v}\n": "db.password.value", f"secrets.github.value={v}": "secrets.github.value", f"<credentials><github>{v}</github></credentials>": "credentials.github",
        f"<password>{v}</password>": "password", f'<property name="db.password">\n  {v}\n</property>': "db.password", f'<add key="dbPassword" value="{v}"/>': "add.db_password", f'{{"credentials": {{"github": "{v}", "name": "abc1234567"}}}}': "credentials.github",
        f'f({{ secrets: {{ a: 1, github: "{v}" }} }})': "secrets.github", f'"secrets":\n{{\n "a": ["{v}"]\n}}': "secrets.a", f"tokens:\n- {HEX}\n": "tokens", f"secret:\n  a: |\n    {v}\n": "secret.a", f"api:\n  key: {HEX}\n": "api.key", f"api_keys:\n  - name: x\n    value: {v}\n": "api_keys.value",
        f"a: {{\nsecrets:\n  b: '{v}'\n": "secrets.b",
    }
    for t, path in yes.items():
        (lo, hi, kind), = C.find(t)
        assert t[lo:hi] in (v, HEX) and kind == "key_value" and [p for p, at, _, _ in C.nested(t, t.encode().lower()) if at == lo][:1] == [path], t
    no = [f"auth:\n  user_id: {HEX}\n", f"cache:\n  key: {HEX}\n", f"secrets:\n  sha256: {HEX}\nother:\n  c: {v}\n", f"credentials: {{ a: 1 }}\nother: '{v}'\n", f"[secrets]\na = 1\n[other]\nx = {v}\n", f"List<Token> a;\n<b>{v}</b>", f"<token></token><b>{v}</b>"]
    for t in no:
        assert C.find(t) == [], t


def test_long_values_and_open_key_blocks():
    long = (HEX + "Zq") * 30
    for t in (f'access_token = "{long}"', f"SESSION_TOKEN={long}\n", f'keystorePass = "{long}/+=="', f"u = redis://lever:{long}@h.example/x"):
        (lo, hi, _), = C.find(t)
        assert len(t[lo:hi]) >= len(long) and long not in C.redact(t, C.find(t))
    for value in ("bl0ck'$4810xQ", "bl0ck\\\"$4810xQ", "bl0ck`$4810xQ"):
        t = f'dbPassword = "{value}"'
        assert [t[lo:hi] for lo, hi, _ in C.find(t)] == [value]
    body = "Qf" * 32
    for block, after in ((f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n{body[:21]}\n", "some_setting = 5\n"), (f'k = "-----BEGIN PRIVATE KEY-----\\n{body}\\n{body}";\n', "f()\n"), (f"-----BEGIN PRIVATE KEY-----\n{body}\nlongIdentifierName = 5\n", "")):
        t = f"{block}{after}secret_key = '{HEX}'\n"
        (lo, hi, kind), (at, _, _) = C.find(t)
        assert kind == "private_key" and hi < len(block) and t[at:].startswith(HEX)
        out = C.redact(t, C.find(t))
        assert body not in out and HEX not in out and after in out


def test_key_blocks_are_redacted_to_the_last_line():
    body = "Qf7" * 21
    for tail in ("ab12CD34ef5=", "Zz9=", "abc"):
        for line in ("\n", "\\n", '",\n  "'):
            t = f"x = 1\n-----BEGIN PRIVATE KEY-----{line}{body}{line}{body}{line}{tail}{line}-----END PRIVATE KEY-----\nsecret_key = '{HEX}'\n"
            out = C.redact(t, C.find(t))
            assert tail not in out and body not in out and HEX not in out and out.count("\n") == t.count("\n") and out.count(line) == t.count(line)
            assert C.find(out) == [] and C.redact(out, C.find(out)) == out
    t = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n{body}\nabc=\n-----END RSA PRIVATE KEY-----\n"
    out = C.redact(t, C.find(t))
    assert "DEK-Info: AES-128-CBC,0123" in out and body not in out and "abc=" not in out and C.find(out) == []


def test_whole_paths_decide():
    """The word before the value is the same in each pair; the path above it tells them apart."""
    v = "Tide!" + "Sparse1311x"
    pairs = [
        (f"credentials:\n  github: {v}\n", f"commits:\n  github: {v}\n"), (f"db:\n  password: '{v}'\n", f"i18n:\n  password: '{v}'\n"), (f"[secrets]\nvalue = {v}\n", f"[colours]\nvalue = {v}\n"),
        (f'{{"api": {{"key": "{v}"}}}}', f'{{"sort": {{"key": "{v}"}}}}'), (f'{{"smtp": {{"password": "{v}"}}}}', f'{{"labels": {{"password": "{v}"}}}}'), (f"<credentials><value>{v}</value></credentials>", f"<settings><value>{v}</value></settings>"),
    ]
    for yes, no in pairs:
        assert [yes[lo:hi] for lo, hi, _ in C.find(yes)] == [v] and C.find(no) == [], (yes, no)
    deep = "".join("  " * i + f"level{i}:\n" for i in range(30)) + "  " * 30 + f"secrets:\n" + "  " * 31 + f"github: {v}\n"
    (lo, hi, _), = C.find(deep)
    path = next(p for p, at, _, _ in C.key_values(deep, deep.encode().lower()) if at == lo)
    assert deep[lo:hi] == v and path.startswith("level0.level1.") and path.endswith("level29.secrets.github")
    assert len(C.find("a" * 300 + f'_password = "{v}"')) == 1


def test_plain_passwords():
    for value in ("hunter" + "2", "blue42" + "whale", "correct horse " + "battery staple", "tide-sparse-" + "margin-hive"):
        for t in (f'password = "{value}"', f'db:\n  passphrase: "{value}"\n', f'{{"adminPwd": "{value}"}}'):
            assert [t[lo:hi] for lo, hi, _ in C.find(t)] == [value], t
        assert C.find(f'colour = "{value}"') == C.find(f'api_key_name = "{value}"') == []
    assert C.find('raise_for("password", "hunter' + '2")') == []
    for t in ('password = "password1"', 'password = "required"', 'password = "enter your password here"', 'password = "changeme123"', 'password: "xxxxxxxx"'):
        assert C.find(t) == [], t


# syntax


def test_python_syntax():
    good = ["x = 1\n", "def f(a, *, b=1) -> int:\n    return a\n", "print(f'{a!r:>{w}} {d[\"k\"]}')\n", "if x:\n  pass\nelse:\n  y = [i for i in x if i]\n", "class A: pass\n", "lambda: 0\n", "a[1:, ::2]\n", "match x:\n    case 1: pass\n", "try:\n  a\nexcept* E as e:\n  b\n", "async def f():\n    async for x in y: await z\n", '"""<<<<<<< a"""\n', "from . import (a,\n b)\n", "x = not a or -b ** ~c\n", "\ufeffx=1\r\n", "while 1: break", "x: int = 3", "@a.b(1)\ndef f(): ..."]
    bad = ["def f(:\n  pass\n", "x = 'a\n", "if x\n  y\n", "a = (1,\n", "  x = 1\n", "<<<<<<< HEAD\n", "x = \n", "for x in y:\n", "if a:\n    b\n  c\n", "package a.b;\n", "@@ -1,2 +3 @@\n", "x = 012\n", "try:\n  a\nb\n", "f'{a'\n", "raise E, 'x'\n", "a b\n", "x = [1}\n"]
    for t in good:
        assert X.syntax_error("a.py", t) is None, t
    for t in bad:
        assert X.syntax_error("a.py", t), t


def test_brace_syntax():
    good = {
        "js": ["const a = /^[a-z({]+$/.test(b);\n", "let s = `a ${b ? `${c}` : '}'}`;\n", "x = a ? b : c;\nfor (const k of m) { if (k) continue; }\n", "export default class A extends B { static x = 1; get y() { return 2 } }", "label: for (;;) { break label; }", "f(async (x) => ({ a: 1, ...x }))\n", "// it's (\n/* ` */\n", "import { a as b } from './c';\nexport * from 'd'", "a\n++b", "if (a) b\nelse c", "switch (x) { case 'a': y(); break; default: z() }", "var r = a / b / c;", "do { x() } while (y)"],
        "ts": ["export function f<T extends B>(a: T, b?: number[]): Map<string, T> { return a as any; }", "type K =\n  | 'a'\n  | 'b';", "interface A { x?: string; f(a: number): void }", "const m: Record<string, number> = {};", "enum E { A = 'x', B }", "declare const x: number;", "abstract class A { private readonly x: number = 1; }", "let v = a!.b as unknown as C<D>;"],
        "tsx": ["export const A = () => <div className=\"x\">{a > 1 && <b>it's</b>} text <C {...p} /></div>;", "function F(){ return (<><A/></>); }"],
        "java": ["package a.b;\nimport java.util.*;\n@A(x = 1)\npublic final class B<T> extends C implements D {\n  private final int[] x = {1, 2};\n  char c = '{';\n  B() throws E { super(); }\n  <K> List<K> f(Map<String, ? extends T> m, int... n) { for (int i = 0; i < 3; i++) { m.forEach((k, v) -> g(k)); } return List.of(); }\n}\n", "class A { void f() { var x = switch (y) { case 1 -> 2; default -> 3; }; String s = \"\"\"\n  a \"b\" (\n  \"\"\"; } }\n"],
    }
    bad = {
        "js": ["f(a;\n", "const x = 'a\n", "function f() {\n", "<<<<<<< HEAD\n", "@@ -1 +1 @@", "const x = ", "from a.b import c\n", "public class A {}", "const x: number = 1;", "<!DOCTYPE html>", "a = [1, 2;", "let s = `a ${b", "if x { }", "}", '{\n  "a": 1\n}', "const x;\n"],
        "ts": ["f(a: number {", "export function f(): { return 1; }}", "return (<div className='a'>x</div>);"],
        "tsx": ["const a = <div><b></div>;", "const a = <div>"],
        "java": ["class A { void f( { } }", "class A {", "def f(self):\n  pass", "package a.b", "class A { String s = \"x; }", "class A { int x = f(1; }", "export class A {}", "class A { char c = 'ab'; }"],
    }
    for ext, texts in good.items():
        for t in texts:
            assert X.syntax_error(f"a.{ext}", t) is None, (ext, t, X.syntax_error(f"a.{ext}", t))
    for ext, texts in bad.items():
        for t in texts:
            assert X.syntax_error(f"a.{ext}", t), (ext, t)
    assert X.syntax_error("a.md", "(") is None and X.syntax_error("a.js", None) is None and X.syntax_error("a.js", "") is None


def test_long_type_arguments():
    fields = " ".join(f"field{i}: Map<string, number[]>;" for i in range(60))
    assert X.syntax_error("a.ts", f"const f = <T extends {{ {fields} }}>(x: T) => x;\n") is None
    assert X.syntax_error("a.tsx", f"const f = <T extends {{ {fields} }}>(x: T) => x;\nconst m = new Map<{{ {fields} }}, string>();\n") is None
    assert X.syntax_error("a.ts", f"const f = <T extends {{ {fields} }}(x: T) => x;\n")
    assert X.syntax_error("a.ts", "x = a" + " < b" * 100_000 + ";\n") is None


def test_syntax_in_spark(spark):
    df = spark.createDataFrame([(1, "o", "n", "a.py", "x = (", 1), (1, "o", "n", "a.py", "x = (", 1), (2, "o", "n", "b.py", "x = 1", 1), (3, None, None, "c.JS", "}", 1), (4, "o", "n", "d.md", "}", 1), (5, "o", "n", "e.ts", None, 1)], "file_id bigint, owner string, name string, path string, content string, error int")
    assert {r.file_id for r in X.broken_files(df).collect()} == {1, 3}
    rates = {(r.repository, r.language): (r.files, r.broken) for r in X.error_rates(df).collect()}
    assert rates[("o/n", "python")] == (2, 1) and rates[(None, None)] == (4, 2)
    assert X.broken_files(df.limit(0)).count() == 0


# generated files


def test_attributes():
    rules = G.Rules(G.parse_attributes("web/.gitattributes", "# c\n*.js linguist-generated\nlib/*.js -linguist-generated\n/top/** linguist-vendored=true\nx linguist-vendored=false\ny text\n"))
    said = {"web/a.js": True, "web/b/c.js": True, "web/lib/a.js": False, "web/top/q/r.ts": True, "a.js": None, "web/d/x": False, "web/y": None}
    assert {p: rules.declared(p) for p in said} == said
    # attributes are resolved apart: what is not generated may still be vendored; ! takes an attribute back; a deeper file wins over a later line
    lines = G.parse_attributes(".gitattributes", "vendor/** linguist-vendored\nvendor/x.py -linguist-generated\nvendor/own/* !linguist-vendored\nlib/** linguist-generated\n") + G.parse_attributes("lib/.gitattributes", "hand.ts -linguist-generated\n")
    said = {"vendor/x.py": True, "vendor/own/a.py": None, "vendor/b/c.py": True, "lib/a.ts": True, "lib/hand.ts": False}
    assert {p: G.Rules(lines).declared(p) for p in said} == said


def test_evidence():
    assert G.says("// Code generated by wiregen. DO NOT EDIT.\nx") and G.says('"""AUTO-GENERATED FILE - do not modify by hand """\n') and G.says("# Copyright 2020\n# Bu dosya x tarafindan otomatik uretilmistir\n") and G.says("/*! foo-kit 1.2.3 */\nx")
    assert not G.says('banner = "Code generated by {tool}. DO NOT EDIT."\n') and not G.says("import a\n# ids are automatically generated per row\n") and not G.says("// Copyright 2020 the x authors.\n// callers must not edit the deck by hand\n")
    assert G.minified("(()=>{" + "a.b(c);d=e?f:g;" * 80 + "})()") and not G.minified("const a = 1;\n" * 80)
    assert G.data("x = [\n" + "  [1, -2, 3.5, 4],\n" * 120 + "]\n") and not G.data("def f(a):\n    return a + 1\n" * 120)
    assert G.published(G.path_patterns("web/node_modules/a/b.js")) and G.published(G.path_patterns("lib/a_pb2.py")) and G.published(G.path_patterns("deps/a@1.2.3/b.ts"))
    assert not G.published(G.path_patterns("src/vendor_portal/a.py")) and not G.published(G.path_patterns("app/minify/generator.js"))


def test_header_after_a_long_licence():
    licence = "/*\n" + " * Licensed under the terms that follow, without warranties of any kind.\n" * 200 + " */\n"
    assert G.says(licence + "// Code generated by wiregen. DO NOT EDIT.\nlet a = 1\n") and G.says(licence[:-4] + " * This file is a vendored copy of x.\n */\nlet a = 1\n")
    assert not G.says(licence + "let a = 1\n// Code generated by wiregen. DO NOT EDIT.\n")
    assert G.says("/" * 200_000 + "\n" * 200_000 + "// Code generated by wiregen. DO NOT EDIT.\n")


def test_generated_in_spark(spark):
    rows = [(i, "o", f"r{i % 4}", f"codegen_out/f{i}.ts", "// Code generated by x. DO NOT EDIT.\nlet a = 1\n" if i < 8 else "let a = 1\n") for i in range(12)]
    rows += [(100, "o", "r0", ".gitattributes", "hand.ts linguist-generated\nvendor/own.ts -linguist-vendored\n"), (101, "o", "r0", "hand.ts", "let b = 2\n"), (102, "o", "r0", "vendor/own.ts", "let c = 3\n"), (103, "o", "r1", "hand.ts", None), (104, "o", "r1", "vendor/x.ts", None), (105, "o", "r1", "src/a.ts", ""), (101, "o", "r0", "hand.ts", "let b = 2\n")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "file_id bigint, owner string, name string, path string, content string, evidence string")
    got = {r.file_id: r.reason for r in G.not_handwritten(df).collect()}
    assert got == {**{i: "said" for i in range(8)}, **{i: "mined" for i in range(8, 12)}, 101: "declared", 104: "path"}
    assert {r.file_id: r.declared for r in G.declared(G.scan(df), limit=0).collect()} == {r.file_id: r.declared for r in G.declared(G.scan(df)).collect()} == {101: True, 102: False}
    assert G.not_handwritten(df.limit(0)).count() == 0


def test_mined_and_declared_patterns_beat_the_list(spark):
    """Directories and endings no published convention has, learned from files that say what they are, and declarations that overrule path patterns."""
    says = "# This file was generated by rowgen from rows.idl\nx = 1\n"
    rows = []
    for r in range(8):
        rows += [(1000 * r + i, "o", f"r{r}", f"src/wiregen_out/part{i}.py" if i < 8 else f"lib/table{i}_rows.py", says if i % 2 else "x = 1\n") for i in range(16)]
        rows += [(1000 * r + 100 + i, "o", f"r{r}", f"src/hand/part{i}.py", "y = 2\n") for i in range(16)]
    rows += [(9000, "o", "r0", ".gitattributes", "src/wiregen_out/own.py -linguist-generated\nplain/** linguist-vendored\n"), (9001, "o", "r0", "src/wiregen_out/own.py", "z = 3\n"), (9002, "o", "r0", "plain/a.py", "z = 3\n"), (9003, "o", "r1", "plain/a.py", "z = 3\n"), (9004, "o", "r1", "node_modules/a.js", "let z = 3\n")]
    files = spark.createDataFrame(rows, "file_id bigint, owner string, name string, path string, content string")
    listed = {i for i, _, _, p, c in rows if G.found(p, c) or G.published(G.path_patterns(p))}
    true = {i for i, _, _, p, _ in rows if "wiregen_out/part" in p or "_rows" in p} | {9002, 9004}
    got = {r.file_id: r.reason for r in G.not_handwritten(files).collect()}
    assert set(got) == true and len(true - listed) == 65
    assert got[9002] == "declared" and got[9004] == "path" and [v for v in got.values()].count("mined") == 64
    # files the scan alone names are judged by path, and a null content hides nothing
    scanned = spark.createDataFrame([(9005, "o", "r5", "src/wiregen_out/late.py", "py", 5), (9006, "o", "r5", "src/late.py", None, None), (0, "o", "r0", "src/wiregen_out/part0.py", "py", 5)], "file_id bigint, owner string, name string, path string, extension string, size_bytes bigint")
    got = {r.file_id for r in G.not_handwritten(G.all_files(scanned, files)).collect()}
    assert got == true | {9005}


# pairs


def pairs():
    answers = ["The cache keeps at most {} entries, and the oldest goes first. It is read once and then shared.", "Set the limit to {} if your queue is slow. The default was chosen after a week of looking at it.", "When two workers write the same row, the later one wins. See `a/b{}.py` for the part that has to load it."]
    rows = [(f"ok{i}", f"how does the cache {i} read its rows", answers[i % 3].format(i)) for i in range(90)]
    rows += [(f"e{i}", "why is it so", a) for i, a in enumerate([None, "", " \t", "N/A", "(no answer)", "...", "[]", "TODO"])]
    rows += [(f"t{i}", f"how does the cache {i} read", "The cache keeps at most one entry. The oldest row of the") for i in range(8)] + [("t9", "how does it read", "It is done here.\n\n```\ndef f(a):\n    return"), ("t8", "how does it read", "It is done. See `a/b.")]
    rows += [(f"r{i}", "what is the limit for it", a) for i, a in enumerate(["I could not find enough evidence in the indexed code to answer this.", "Sorry, that is outside what the provided sources show. The excerpts only describe the row and the cache.", "Leider kann ich diese Frage mit den vorhandenen Ausschnitten nicht beantworten."] * 4)]
    rows += [("c1", "why would `x` do it twice", "Why would x do it twice?"), ("c2", "why would it do it twice", '"WHY WOULD IT DO IT TWICE"'), ("c3", "why would it do it", "Q: why would it do it")]
    rows += [(f"o{i}", "which file defines how to read the row", "Das Ergebnis wird nach Pfad sortiert und dann gekürzt. Wenn die Abfrage fehlt, wird der Wert verwendet.") for i in range(4)]
    rows += [("ok100", "how does it read the row", 'How does it read the row? The function logs "no relevant entry" in that case. The comment there reads: "Das Ergebnis wird sortiert."'), ("ok101", "who calls it", "It is called once. (a/b.py:1-20)"), ("ok102", None, "The cache keeps one entry.")]
    return rows


def test_pair_defects(spark):
    rows = pairs()
    df = spark.createDataFrame([(*r, True) for r in rows + rows[:5]], "id string, question string, answer string, defect boolean")
    got = {r.id: r.defect for r in D.defective_pairs(df).collect()}
    kinds = {"e": "empty", "t": "truncated", "r": "refusal", "c": "copies_question", "o": "other_language"}
    assert got == {i: kinds[i[0]] for i, _, _ in rows if not i.startswith("ok")}
    assert D.defective_pairs(df.limit(0)).count() == 0


def test_field_learns_transitions():
    rng = np.random.default_rng(0)
    read, tags = [], []
    for _ in range(60):
        first = rng.random() < 0.5
        read.append(([[0, 7] if first else [0], [0], [0]], [[], [], []]))
        tags.append([D.REFUSAL] * 3 if first else [D.ANSWER] * 3)
    field = D.fit(read, tags)
    assert field.decode_all(*D.matrix(read), [3] * len(read)) == tags


def test_field_beats_its_labelling_rules(spark):
    """Wordings no cue knows, languages no other pair has and lists without stops: the rules alone fail on them, the field does not."""
    rng = random.Random(4)
    rows = [(f"ok{i}", f"how does the {rng.choice(['cache', 'queue', 'index'])} {i} read its rows", a, rng.random() < 0.04) for i, (_, _, a) in enumerate([p for p in pairs() if p[0].startswith("ok") and p[2]] * 6)]
    things = ["lock", "queue", "row", "map", "page", "shelf", "tray", "deck"]
    rows += [(f"r{i}", f"what is the limit for the lamp{i}", f"That lies beyond the material handed over for the lamp{i}, better leave it open.", False if i in (8, 24) else None if i % 10 == 0 else True) for i in range(40)]
    rows += [(f"l{i}", f"which parts does the {things[i % 8]} {i} have", f"It has three parts.\n- one {things[i % 8]} for the reader\n- one {things[(i + 3) % 8]} for the writer\n- a {things[(i + 5) % 8]} of its own", False) for i in range(30)]
    rows += [("o1", "what is the limit for the row", "Размер задаётся один раз. Затем строка читается из файла и больше не меняется.", False), ("o2", "how does the cache read", "Il limite viene letto una volta sola, perché la riga non è più nella memoria. Dopo questo il file si chiude.", False), ("ok_it", "come si legge il limite della riga e perché non è nella memoria", "Il limite viene letto una volta sola, perché la riga non è più nella memoria. Dopo questo il file si chiude.", False)]
    rows += [(f"t{i}", "how does the cache read", f"It is read once. The {things[i % 8]} keeps one row for the", False) for i in range(8)]
    kinds = {"r": "refusal", "o": "other_language", "t": "truncated"}
    true = {i: kinds[i[0]] for i, *_ in rows if i[0] in kinds and not i.startswith("ok")}

    def by_rules(q, a):
        parts = D.clauses(a)
        return D.verdict(D.weak_tags(q, a), [max(1, len(t.split())) for _, t in parts], [k for k, _ in parts])

    ruled = {i: v for i, q, a, _ in rows if (v := by_rules(q, a))}
    df = spark.createDataFrame(rows, "id string, question string, answer string, refused boolean")
    got = {r.id: r.defect for r in D.defective_pairs(df).collect()}
    # a pair or two of the forty under a wrong or missing flag may stay with their label
    assert got.items() <= true.items() and len(got) >= len(true) - 2
    assert len(set(ruled.items()) ^ set(true.items())) >= 40
    # without any flag nothing tells these refusals from answers
    assert {r.id: r.defect for r in D.defective_pairs(df.drop("refused")).collect()} == {i: v for i, v in true.items() if i[0] != "r"}


def test_long_answers_and_groups():
    model = D.fit_model([(q, a, None) for _, q, a in pairs()])
    long = "The cache keeps at most one entry, and the oldest goes first. " * 400
    rows = [("how does the cache read its rows", x) for x in (long, long + "The oldest row of the", None, "N/A")]
    assert model.defects(rows) == model.defects(rows, characters=1) == [None, "truncated", "empty", "empty"]
    assert D.fit_model([]).defects([("a", None)]) == ["empty"]


# pages


def spam(i):
    k = ["golden library", "code search", "repo index"][i % 3]
    return [
        " ".join(f"#{'tag' if j % 2 else 'other'}{j % 7}" for j in range(60)), ", ".join(f"{w} {k}" for w in ("cheap", "buy", "free", "new", "top", "fast", "best", "online") * 4), f"{k} cheap {k} online {k} new " * 10,
        "\n".join(f"- [read the row {j}](https://a{j}.example/x/y-{j})" for j in range(25)), f"Looking for {k}? {k} is fast {k}. " * 9, "\n".join(f"small set | SKU AB-{j}123 | {j}.50 | buy, {k}" for j in range(1, 20)),
    ][i % 6]


PROSE = "The cache keeps at most one entry, and the oldest goes first. Nobody should write the row directly. When two workers load it, the later one wins. "


def test_keyword_behind_function_words():
    from collections import Counter

    words = [w for a in ("of", "in", "to", "for") for b in ("the", "a", "an", "and") for w in (a, b) * 6] + ["golden", "library"] * 5
    assert S._keyword(words, Counter(words))[0] == ("golden", "library")
    words = [w for w in sorted(S.STOP)[:20] for _ in range(9)] + ["golden"] * 8
    words = words[:80] + words[-8:]
    assert S._keyword(words, Counter(words)) == (("golden", "golden"), 7)


def _mixed(i, spam_lines, prose_lines):
    k = ["golden library", "code search", "repo index"][i % 3]
    lines = [[f"small set {j} | SKU AB-{i}{j}12 | {j}.50 | buy, {k}", f"#{k.replace(' ', '')} #tag{j} #other{i} #more{j} #free{j}", f"buy {k} ({j}{i})", f"- [read {k} {j}](https://a{j}.example/x/y-{i})"][i % 4] for j in range(1, spam_lines + 1)]
    says = ["The cache keeps at most one entry, and the oldest goes first.", "Nobody should write the row directly while another worker reads it.", "When two workers load it, the later one wins after a while.", "The index is rebuilt every night and then copied to the reader."]
    return "\n".join(lines + [says[(i + j) % 4] for j in range(prose_lines)])


def test_trees_beat_the_labels(spark):
    """Pages on which the labelling functions are silent or wrong get the right verdict from the trees."""
    rows = [(i, "bad.example" if i % 4 else f"s{i % 9}", spam(i), 1) for i in range(120)]
    rows += [(1000 + i, f"s{i % 9}", f"# Title {i}\n\n" + PROSE * (1 + i % 4), 0) for i in range(300)]
    mixed = [(2000 + i, "bad.example", _mixed(i, 16, 2), 1) for i in range(60)] + [(3000 + i, f"s{i % 9}", _mixed(i, 2, 9), 0) for i in range(60)]
    log = lambda i: "\n".join(f"worker {j} took row {j * i} from queue {i} within {j + i} ms" for j in range(1, 14))
    grid = lambda i: "| name | type | meaning |\n|---|---|---|\n" + "\n".join(f"| part{j} | text | number of rows reader {i + j} may hold |" for j in range(12))
    mixed += [(4000 + i, f"s{i % 9}", log(i), 0) for i in range(6)] + [(4100 + i, f"s{i % 9}", grid(i), 0) for i in range(6)] + [(4200 + i, "bad.example", _mixed(i, 14, 4), 1) for i in range(12)]
    labels = {d: S.weak_label(t) for d, _, t, _ in rows + mixed}
    unsure = [(d, v) for d, _, _, v in rows + mixed if labels[d] != v]
    assert len(unsure) >= 10
    df = spark.createDataFrame(rows + mixed, "doc_id bigint, source string, text string, truth int")
    got = {r.doc_id for r in S.spam_pages(df).collect()}
    # the trees put right four of five of them, and lose nothing elsewhere
    assert sum((d in got) != bool(v) for d, v in unsure) <= len(unsure) // 5
    assert all((d in got) == bool(v) for d, _, _, v in rows + mixed if labels[d] == v)


def test_hosts_decide_torn_pages(spark):
    rows = [(i, "bad.example", 0.95) for i in range(60)] + [(100 + i, "clean.example", 0.02) for i in range(300)] + [(500, "bad.example", 0.42), (501, "clean.example", 0.58), (502, None, 0.58), (503, "new.example", 0.42), (504, "bad.example", 0.02), (505, "clean.example", 0.98)]
    pages = spark.createDataFrame(rows, "doc_id bigint, source string, page_score double")
    verdicts = lambda w: {r.doc_id: r.score > S.THRESHOLD for r in S.smoothed(pages, w).where("doc_id >= 500").collect()}
    assert verdicts(0.0) == {500: False, 501: True, 502: True, 503: False, 504: False, 505: True}
    assert verdicts(S.HOST_WEIGHT) == {500: True, 501: False, 502: True, 503: False, 504: False, 505: True}


def test_pages(spark):
    rows = [(i, "bad" if i % 2 else "mixed", spam(i)) for i in range(90)] + [(1000 + i, "good" if i % 2 else "mixed", f"# Title {i}\n\n" + PROSE * (1 + i % 4)) for i in range(200)]
    rows += [(5000, None, PROSE + spam(0)), (5001, "good", PROSE * 12 + "\n\nhttps://a.example/x\n#tag"), (5002, "good", "\n".join(f"- [name {j}](https://a.example/{j}): This page says how the cache of part {j} is read and written." for j in range(20))), (5003, "bad", None), (5004, "bad", ""), (5005, "good", "```\n" + "x = f(a)\n" * 40 + "```\n"), (0, "mixed", spam(0))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, text string, score int")
    got = {r.doc_id for r in S.spam_pages(df).collect()}
    assert got == set(range(90)) | {5000}
    s = S.scores(df)
    assert s.count() == s.select("doc_id").distinct().count() == 294
    assert S.spam_pages(df.limit(0)).count() == 0
    assert S.spam_pages(df.where("doc_id >= 1000 AND doc_id < 1200")).count() == 0
