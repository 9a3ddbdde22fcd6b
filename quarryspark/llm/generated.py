"""Files not written by hand: generated, minified, vendored, or data kept as source.

Evidence, in the order in which it decides:

1. *Declared*: repository attribute files (``.gitattributes``) are parsed, their globs resolved per directory with the precedence
   the format has (a deeper file over a higher one, in a file a later line over an earlier one), for each attribute on its own; a path
   counts as declared if any of them is set. An attribute turned off (``-name``, ``name=false``) denies what paths suggest; ``!name`` takes back
   what other lines say.
2. *Said* and *form*: the leading comment says that the file is generated or a third party's; machine-made layout (minified code); content that is all but literals (data).
3. *Mined*: path patterns (directory names, versioned directories, name endings) of files with evidence of their own, declared or said or by form, are
   counted over all repositories; patterns that hold for enough of their files in several repositories apply to the rest.
4. *Path*: published conventions, a list in this module, for patterns the collection does not show often enough to be mined.

Null contents are judged by path alone; empty contents too. Files that only the scan table names are judged by path. Repeated rows of a file count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reliable, require

#: A mined pattern needs so many files and repositories, and this share of its files must declare themselves.
MIN_FILES, MIN_REPOSITORIES, MIN_SHARE = 8, 3, 0.4

# fixed values: published conventions for generated, minified and vendored paths, as directory names and name endings
VENDOR_DIRECTORIES = ["node_modules", "bower_components", "jspm_packages", "vendor", "_vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd-party", "external", "externals", "deps", "site-packages", "pods", "carthage", "godeps"]
GENERATED_DIRECTORIES = ["__generated__", "generated", "generated-src", "generated-sources", "autogen", "codegen-out", "gen", "gen-src", "dist", "out-tsc", "__snapshots__", "build"]
NAME_ENDINGS = [".min", "-min", ".bundle", ".chunk", ".generated", "_generated", "-generated", ".gen", "_gen", ".g", ".pb", "_pb", "_pb2", "_pb2_grpc", "_grpc_pb", ".designer"]

_VERSIONED = re.compile(r"^(?:[\w.-]+@v?\d+(?:\.\d+)*|[a-z][\w]*(?:-[a-z]\w*)*-v?\d+(?:\.\d+)+|v?\d+\.\d+\.\d+)$")
_HASHED = re.compile(r"[-.](?=[0-9a-f]*\d)[0-9a-f]{8,20}$")
_ENDING = re.compile(r"([._-][a-z0-9]+(?:_grpc)?)$")
_CAMEL_ENDING = re.compile(r"(?<=[a-z0-9])(Generated)$")

_SAYS = re.compile(
    r"""code\ generated\ by\ \S+.{0,60}do\ not\ edit
|(?:^|[\s*#/])@generated\b
|<auto-?generated
|auto-?generated\ (?:file|code|by|from|source|using|with)
|(?:this|the)\ (?:file|code|module|class|document|page)\ (?:is|was|has\ been)\ (?:auto(?:matically)?[- ]?)?generated
|automatically\ generated\ (?:by|from|file|code)
|generated\ (?:by|from|with|using)\ \S+.{0,80}(?:do\ not|don't|edits?\ (?:are|will|is)|changes|overwritten|rebuilt|by\ hand)
|generated\ (?:by\ the\ protocol\ buffer|by\ \S+\ (?:from|on)\b|from\ \S+\.(?:idl|proto|xml|xsd|wsdl|g4|schema|json|ya?ml|thrift|avsc)\b)
|do\ not\ (?:edit|modify|change)\b.{0,40}\b(?:generated|by\ hand|manually|directly)
|\boutput,\ (?:re)?build\ with\b
|otomatik\ (?:olarak\ )?(?:uretilmi|üretilmi|olusturul|oluşturul)
|automatisch\ (?:aus|von|mit|durch|generiert|erzeugt).{0,60}(?:erzeugt|generiert|erstellt)?
|(?:généré|genere)\ automatiquement|generado\ automaticamente|generado\ automáticamente
|vendored\ (?:from|copy|in\ from)
|(?:third[- ]party|verbatim|vendored|unmodified)\ copy\ of
|copied\ (?:verbatim\ )?from\ \S+\ v?\d
|copied\ verbatim\ from
|report\ bugs\ upstream|keep\ in\ sync\ with\ upstream|local\ changes\ are\ not\ allowed
|\(c\)\ \d{4}[^|\n]{0,60}\|\ ?(?:mit|bsd|apache|isc|mpl|licen[cs]e)
|^[\s/*!]*[\w.@/-]+\ v\d+(?:\.\d+)+\ \|
|^\s*/\*!\ [\w.-]+\ v?\d+\.\d+\.\d+\s*\*/""",
    re.X | re.I | re.M,
)
_LITERALS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?\b\d[\w.]*")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")


def path_patterns(path: str) -> list[str]:
    """The patterns a path is an instance of: dir:<name>, versioned:, hashed:, end:<ending>.<extension>."""
    *directories, name = path.split("/")
    stem, _, extension = name.rpartition(".")
    out = {f"dir:{d.lower()}" for d in directories}
    out |= {"versioned:" for d in directories if _VERSIONED.match(d)}
    low = re.sub(r"(?i)[-_]?base$", "", stem) or stem
    if _HASHED.search(low):
        out.add(f"hashed:.{extension.lower()}")
    elif m := _ENDING.search(low):
        out.add(f"end:{m.group(1).lower()}.{extension.lower()}")
    if _CAMEL_ENDING.search(low):
        out.add(f"end:Generated.{extension.lower()}")
    return sorted(out)


_PUBLISHED_DIRECTORIES = {f"dir:{d}" for d in (*VENDOR_DIRECTORIES, *GENERATED_DIRECTORIES)}
_PUBLISHED_ENDINGS = tuple(f"end:{e}." for e in (*NAME_ENDINGS, "Generated"))


def published(patterns: list[str]) -> bool:
    return any(p in _PUBLISHED_DIRECTORIES or p.startswith(_PUBLISHED_ENDINGS) or p == "versioned:" for p in patterns)


_LEADING = re.compile(r"[\s﻿]+|#[^\n]*|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z)|\"{3}[\s\S]*?(?:\"{3}|\Z)|'{3}[\s\S]*?(?:'{3}|\Z)|--[^\n]*|['\"]use strict['\"];?")

_RULES = re.compile(r"(/){101,}|\n[\s/*!]*\n")


def header(text: str) -> str:
    """The comments before the first code, whole."""
    at = 0
    while m := _LEADING.match(text, at):
        at = m.end()
    return text[:at]


def says(text: str, markdown: bool = False) -> bool:
    head = header(text)
    if markdown:
        head = "".join(m.group() for m in re.finditer(r"<!--[\s\S]*?-->", head))
    # lines and rules of comment marks alone say nothing, and are slow to look through
    return bool(_SAYS.search(_RULES.sub(lambda m: m.group()[:100] if m.group(1) else "\n", head)))


def minified(text: str) -> bool:
    """Code laid out by a program: long dense lines with few blanks."""
    lines = text.split("\n")
    code = [ln for ln in lines if len(ln) > 160]
    dense = sum(len(ln) for ln in code)
    if dense < 500 or dense < 0.6 * len(text):
        return False
    body = "\n".join(code)
    bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "S", body)
    blanks = sum(map(bare.count, " \t"))
    return blanks < 0.09 * len(bare) and sum(map(bare.count, ";{}(),=")) > 0.12 * len(bare)


def data(text: str) -> bool:
    """Content that is all but literals: tables of numbers, encoded blobs, word lists, dumped records."""
    if len(text) < 1200:
        return False
    size = len(text) - text.count(" ") - text.count("\n")
    literal = items = 0
    for m in _LITERALS.finditer(text):
        literal += m.end() - m.start()
        items += 1
    bare = _LITERALS.sub("", text)
    calls = bare.count("(")
    names = sum(len(m) for m in _IDENT.findall(re.sub(r"//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/", "", bare)))
    if names > 0.08 * size or calls > 0.1 * items + 1:
        return False
    return items >= 40 and literal >= 0.4 * size or items >= 12 and literal >= 0.85 * size


def found(path: str, text: str | None) -> str | None:
    """said, minified or data; None without such evidence in the content."""
    if not text:
        return None
    markdown = path.lower().endswith((".md", ".markdown"))
    if says(text, markdown):
        return "said"
    if not markdown:
        if minified(text):
            return "minified"
        if data(text):
            return "data"
    return None


def glob_regex(pattern: str, directory: str) -> str:
    """An attribute file's pattern in a directory as a regular expression over paths from the root."""
    anchored = "/" in pattern.rstrip("/").lstrip("/") or pattern.startswith("/")
    body, i = "", 0
    p = pattern.strip("/")
    while i < len(p):
        if p.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            body, i = body + "/.*", i + 3
        elif p.startswith("**", i):
            body, i = body + ".*", i + 2
        elif p[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif p[i] == "?":
            body, i = body + "[^/]", i + 1
        elif p[i] == "[" and (j := p.find("]", i + 2)) > 0:
            body, i = body + "[" + p[i + 1 : j].replace("!", "^", 1 if p[i + 1] == "!" else 0).replace("\\", "\\\\") + "]", j + 1
        else:
            body, i = body + re.escape(p[i]), i + 1
    return "^" + re.escape(directory) + ("" if anchored else "(?:.*/)?") + body + ("(?:/.*)?$" if pattern.endswith("/") else "$")


#: Attributes that say that a path is not hand-written.
ATTRIBUTES = ["linguist-generated", "linguist-vendored", "gitlab-generated", "export-generated"]
SET, OFF, UNSPECIFIED = 1, 0, -1


def parse_attributes(path: str, text: str) -> list[tuple[int, int, str, str, int]]:
    """(depth, line, attribute, regex, state) of the lines about attributes that tell generated or vendored paths."""
    directory = path.rpartition("/")[0]
    directory = directory + "/" if directory else ""
    out = []
    for n, line in enumerate(text.splitlines()):
        line = line.strip()
        if not line or line[0] == "#":
            continue
        m = re.match(r'"((?:[^"\\]|\\.)*)"\s+(.*)|(\S+)\s+(.*)', line)
        if not m:
            continue
        pattern, attributes = (m.group(1), m.group(2)) if m.group(1) is not None else (m.group(3), m.group(4))
        for a in attributes.split():
            name, _, value = a.lstrip("-!").partition("=")
            if name in ATTRIBUTES:
                state = UNSPECIFIED if a[0] == "!" else OFF if a[0] == "-" or value.lower() in ("false", "0") else SET
                out.append((directory.count("/"), n, name, glob_regex(pattern, directory), state))
    return out


class Rules:
    """The attribute lines of one repository, compiled once; the strongest line of an attribute is tried first."""

    def __init__(self, rules: list[tuple[int, int, str, str, int]]) -> None:
        self.by_name: dict[str, list[tuple[re.Pattern, int]]] = {}
        for _, _, name, regex, state in sorted(set(map(tuple, rules)), key=lambda r: (-r[0], -r[1])):
            self.by_name.setdefault(name, []).append((re.compile(regex), state))

    def declared(self, path: str) -> bool | None:
        """True if an attribute is set for the path, False if one is turned off and none set, None if no line decides."""
        states = {next((state for rx, state in rules if rx.search(path)), UNSPECIFIED) for rules in self.by_name.values()}
        return True if SET in states else False if OFF in states else None


#: Characters of all rules of a collection up to which they are broadcast; beyond, they are joined by repository.
RULES_LIMIT = 16_000_000


def declared(scanned: DataFrame, limit: int = RULES_LIMIT) -> DataFrame:
    """(file_id, declared) of the files that a line of an attribute file of their repository decides.

    Rules are gathered by repository and compiled once in a task. Their total size is measured: up to ``limit`` they are broadcast, so no file moves;
    beyond, files are joined to their repository's rules, and a hot repository is left to the split of skewed joins.
    """
    rules = scanned.where("size(rules) > 0").select("owner", "name", F.explode(F.array_distinct("rules")).alias("r"))
    per = reliable(rules.groupBy("owner", "name").agg(F.collect_set("r").alias("rules"), F.sum(F.length("r.regex") + 40).alias("size")))
    total = per.agg(F.sum("size")).first()[0] or 0
    files = scanned.select("file_id", "owner", "name", "path")
    schema = "file_id bigint, declared boolean"

    def judge(b: pa.RecordBatch, of) -> pa.RecordBatch:
        out = [r.declared(p) if (r := of(i)) else None for i, p in enumerate(b.column("path").to_pylist())]
        return pa.RecordBatch.from_arrays([b.column("file_id"), pa.array(out, pa.bool_())], names=["file_id", "declared"])

    if total <= limit:
        shared = scanned.sparkSession.sparkContext.broadcast({(r.owner, r.name): [tuple(x) for x in r.rules] for r in per.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[tuple, Rules] = {}
            for b in batches:
                where = list(zip(b.column("owner").to_pylist(), b.column("name").to_pylist()))

                def of(i: int) -> Rules | None:
                    if where[i] not in made and where[i] in shared.value:
                        made[where[i]] = Rules(shared.value[where[i]])
                    return made.get(where[i])

                yield judge(b, of)

        found = files.mapInArrow(run, schema) if total else files.limit(0).select("file_id", F.lit(None).cast("boolean").alias("declared"))
    else:

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[tuple, Rules] = {}
            for b in batches:
                where = list(zip(b.column("owner").to_pylist(), b.column("name").to_pylist()))
                rules = b.column("rules")

                def of(i: int) -> Rules:
                    if where[i] not in made:
                        if len(made) > 1000:
                            made.clear()
                        made[where[i]] = Rules([(x["depth"], x["line"], x["attribute"], x["regex"], x["state"]) for x in rules[i].as_py()])
                    return made[where[i]]

                yield judge(b, of)

        found = files.join(per.select("owner", "name", "rules"), ["owner", "name"]).mapInArrow(joined, schema)
    return found.where("declared IS NOT NULL").groupBy("file_id").agg(F.max("declared").alias("declared"))


_RULE = "struct<depth:int,line:int,attribute:string,regex:string,state:int>"
_SCAN = f"file_id bigint, owner string, name string, path string, patterns array<string>, published boolean, evidence string, rules array<{_RULE}>"
_RULES_TYPE = pa.list_(pa.struct([("depth", pa.int32()), ("line", pa.int32()), ("attribute", pa.string()), ("regex", pa.string()), ("state", pa.int32())]))


def scan(files: DataFrame) -> DataFrame:
    """One row per file: its path patterns, the evidence in its content, and the rules it holds if it is an attribute file. Contents are read once and stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, texts = b.column("path").to_pylist(), b.column("content").to_pylist()
            pats = [path_patterns(p) for p in paths]
            ev = [found(p, t) for p, t in zip(paths, texts)]
            rules = [[dict(zip(("depth", "line", "attribute", "regex", "state"), r)) for r in parse_attributes(p, t)] if t and p.rpartition("/")[2] == ".gitattributes" else [] for p, t in zip(paths, texts)]
            columns = [b.column("file_id"), b.column("owner"), b.column("name"), b.column("path"), pa.array(pats, pa.list_(pa.string())), pa.array([published(x) for x in pats]), pa.array(ev, pa.string()), pa.array(rules, _RULES_TYPE)]
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "owner", "name", "path", "patterns", "published", "evidence", "rules"])

    rows = require(files, "file_id", "owner", "name", "path", "content").where("file_id IS NOT NULL AND path IS NOT NULL").mapInArrow(run, _SCAN)
    # of repeated rows the one that says most; max skips nulls
    firsts = [F.min(c).alias(c) for c in ("owner", "name", "path", "patterns", "published")]
    return rows.groupBy("file_id").agg(*firsts, F.max("evidence").alias("evidence"), F.max("rules").alias("rules"))


def mined(scanned: DataFrame, min_files: int = MIN_FILES, min_repositories: int = MIN_REPOSITORIES, min_share: float = MIN_SHARE) -> DataFrame:
    """Patterns over all repositories: pattern, files, repositories, share of files with own evidence."""
    each = scanned.select("file_id", "owner", "name", F.col("evidence").isNotNull().cast("int").alias("own"), F.explode("patterns").alias("pattern"))
    return (
        each.groupBy("pattern", "owner", "name")
        .agg(F.count("*").alias("n"), F.sum("own").alias("k"))
        .groupBy("pattern")
        .agg(F.sum("n").alias("files"), F.count_if(F.col("k") > 0).alias("repositories"), F.round(F.sum("k") / F.sum("n"), 6).alias("share"))
        .where((F.col("files") >= min_files) & (F.col("repositories") >= min_repositories) & (F.col("share") >= min_share))
    )


def all_files(scanned_files: DataFrame, files_raw: DataFrame) -> DataFrame:
    """(file_id, owner, name, path, content) of every row of either table; a row of the scan has no content."""
    bare = require(scanned_files, "file_id", "owner", "name", "path").withColumn("content", F.lit(None).cast("string"))
    return require(files_raw, "file_id", "owner", "name", "path", "content").unionByName(bare)


def not_handwritten(files: DataFrame, min_files: int = MIN_FILES, min_repositories: int = MIN_REPOSITORIES, min_share: float = MIN_SHARE) -> DataFrame:
    """(file_id, reason) of files not written by hand; reason is declared, said, minified, data, mined or path, the first that holds.

    A denial by an attribute overrides what paths suggest, not what a file says or shows itself.
    """
    rows = reliable(scan(files))
    evidence = rows.join(declared(rows), "file_id", "left").select("file_id", "owner", "name", "patterns", "published", "declared", F.when(F.col("declared"), F.lit("declared")).otherwise(F.col("evidence")).alias("evidence"))
    direct = evidence.where("evidence IS NOT NULL").select("file_id", F.col("evidence").alias("reason"), F.lit(1).alias("order"))
    rest = evidence.where("evidence IS NULL AND declared IS NULL")
    by_mining = (
        rest.select("file_id", F.explode("patterns").alias("pattern"))
        .join(mined(evidence, min_files, min_repositories, min_share).select("pattern"), "pattern", "left_semi")
        .select("file_id", F.lit("mined").alias("reason"), F.lit(2).alias("order"))
    )
    by_list = rest.where("published").select("file_id", F.lit("path").alias("reason"), F.lit(3).alias("order"))
    return direct.unionByName(by_mining).unionByName(by_list).groupBy("file_id").agg(F.min_by("reason", "order").alias("reason"))
