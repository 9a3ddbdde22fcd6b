"""The lexers against brute force: every single deletion in small sources, with the interpreter's parser as the judge for Python."""

import ast
import warnings

import pytest

from quarryspark.llm import syntax as X

PYTHON = '''import os
from a.b import (c, d as e)


class Reader(Base):
    """Reads rows."""

    limit: int = 3

    @property
    def rows(self):
        return [r for r in self.items if r[0] > {"a": 1}.get(r, 2)]

    async def load(self, path, *, strict=False):
        try:
            with open(path) as f:
                for line in f:
                    if not line.strip() or line[0] == "#":
                        continue
                    elif strict and len(line) >= self.limit:
                        raise ValueError(f"line {line!r} is {len(line):>3} long")
                    yield line.split(",")[1:-1]
        except (OSError, KeyError) as err:
            print("no", err)
        else:
            self.done = lambda x, y=2: x ** y
        finally:
            await self.close()
'''

BRACES = {
    "js": "export async function load(path, limit) {\n  for (const row of rows(path)) {\n    if (row.size > limit && seen[row.id]) {\n      out.push({ id: row.id, parts: [1, 2, f(row)] });\n    } else {\n      while (next(row)) { skip(); }\n    }\n  }\n  return out;\n}\n",
    "ts": "export interface Row { id: number; parts: Map<string, number[]>; }\nexport class Reader<T extends Row> {\n  private rows: T[] = [];\n  load(limit: number): T[] {\n    return this.rows.filter((r) => (r.id > limit && f(r.parts)));\n  }\n}\n",
    "tsx": "export function Page({ rows }: Props) {\n  const [open, setOpen] = useState(false);\n  return (\n    <div onClick={() => setOpen(!open)}>\n      {rows.map((r) => (\n        <Row key={r.id} open={open} />\n      ))}\n    </div>\n  );\n}\n",
    "java": "package a.b;\n\npublic class Reader<T> {\n    private final int[] limits = {1, 2};\n\n    public List<T> load(Path path) throws IOException {\n        for (int i = 0; i < limits[0]; i++) {\n            if (check(path, i)) { add(rows.get(i)); }\n        }\n        return List.of();\n    }\n}\n",
}


def parses(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


def test_python_deletions_against_the_parser():
    assert X.syntax_error("a.py", PYTHON) is None
    cuts = {PYTHON[:i] + PYTHON[i + 1 :] for i in range(len(PYTHON))} | {PYTHON[:i] for i in range(1, len(PYTHON), 3)}
    lines = PYTHON.split("\n")
    cuts |= {"\n".join(lines[:i] + lines[i + 1 :]) for i in range(len(lines))} | {"\n".join([*lines[:i], ln + " " + m, *lines[i + 1 :]]) for i, ln in enumerate(lines) for m in (")", "]", "}", "(", '"', ":")}
    wrong = [c for c in cuts if not parses(c)]
    right = [c for c in cuts if parses(c)]
    assert len(wrong) > 500 and len(right) > 100
    assert not [c for c in right if X.syntax_error("a.py", c)]
    found = sum(X.syntax_error("a.py", c) is not None for c in wrong)
    assert found >= 0.97 * len(wrong), (found, len(wrong))


@pytest.mark.parametrize("language", sorted(BRACES))
def test_every_lost_bracket_is_found(language):
    text = BRACES[language]
    assert X.syntax_error(f"a.{language}", text) is None
    for i, c in enumerate(text):
        if c in "()[]{}":
            assert X.syntax_error(f"a.{language}", text[:i] + text[i + 1 :]), (i, text[max(0, i - 20) : i + 20])
            assert X.syntax_error(f"a.{language}", text[:i] + c + text[i:]), (i, "doubled", text[max(0, i - 20) : i + 20])
    # a cut anywhere inside the outermost block
    first, last = text.index("{"), text.rstrip().rindex("}")
    depth = 0
    for i in range(first, last, 5):
        depth = sum(text[: i + 1].count(o) - text[: i + 1].count(k) for o, k in ("()", "[]", "{}"))
        if depth > 0:
            assert X.syntax_error(f"a.{language}", text[: i + 1]), text[: i + 1][-40:]
    for mark in ("<<<<<<< HEAD", "=======\n>>>>>>> other"):
        assert X.syntax_error(f"a.{language}", text.replace("\n", f"\n{mark}\n", 1))
