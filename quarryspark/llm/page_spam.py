"""Keyword-stuffed and link-list pages: bagged decision trees on content and link features, smoothed by host.

1. Every page becomes a short vector of content and link features read line by line: shares of its words in link lines, tags, short-item
   lists, directory and product lines, runs of keywords, sentences built on one repeated phrase, prose and code, marks and lengths.
2. Weak labels come from another view, page-wide figures that are no features: function words, repetition of one phrase, words in
   addresses, and words in sentences that say something. Each labelling function votes spam, not spam or nothing; a tie gives no label.
3. Trees are grown on bootstrap samples of at most ``SAMPLE`` labelled pages, the ones with the least hash, a quarter of them
   for pages between the extremes; the bound is a parameter. Everything else covers all pages.
4. A page's score is its averaged tree votes, moved towards the spam rate of its host (``source``) on the logit scale.
   The rates are computed over all pages; pages without a host keep their own score.

Null, empty and word-less texts are no spam. Repeated rows of a document count once. Without enough labels of both kinds the
share of words in spam lines decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, reliable, require

SAMPLE, TREES, DEPTH, LEAF, BINS, SEED = 8_000, 15, 6, 5, 32, 11
#: Weight of the host's rate against the page's own score, and pages that a host's rate is shrunk by.
HOST_WEIGHT, HOST_PRIOR = 0.4, 20.0
THRESHOLD = 0.5
#: Least share of either kind in a bag.
RARE = 0.2
#: Shares of words in spam lines between which a page is mixed: rare, and where the trees have to cut.
MIXED = (0.15, 0.8)

_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"(?:https?://|www\.)[^\s)\]>\"']+")
_ANCHOR = re.compile(r"(?:<a\s[^>]*?href=[\"']?|\[url=)([^\"'>\]\s]+)[\"']?[^>\]]*[>\]](.*?)(?:</a>|\[/url\])", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>")
_TAG_LINE = re.compile(r"\s*(?:[-*]\s+)?(?:tags?|keywords?|labels?|category|categories|etiket(?:ler)?|schlagwort(?:e|er)?|étiquettes?|etiquetas?|mots?[- ]cl[ée]s?|palabras? clave|anahtar kelime(?:ler)?)\s*[:=]", re.I)
_TAG = re.compile(r"(?<!\S)[#@][^\W_][\w-]*")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
# a stop within a number or a name ends no sentence
_SAID = re.compile(r"(?:[^.!?\n]|[.!?](?=[^\s.!?]))+[.!?]*")
_PRODUCT = re.compile(r"\b(?:sku|art|item|ref|ean|no)[ .:#-]*[A-Z]*[-]?\d{3,}|\d+[.,]\d{2}\s*(?:€|\$|£|₺|eur|usd|try|tl)?\s*(?:\||$)|(?:€|\$|£|₺)\s?\d+", re.I)
_DIRECTORY = re.compile(r"\S\s*(?:>|»|›|::)\s*\S.*(?:>|»|›|::)|\(\d+\)\s*$")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_SPLIT = re.compile(r"\s*[,;|·•/]\s*|\s+[-–]\s+")
# fixed values: frequent function words of the languages in the corpus
STOP = frozenset(
    "the a an and or of to in is are was be for on with that this it as at by from its not no but so than then when once has have had do does did one two can will would only after before each every both neither nor who what which how i we you they our your their here there out up down more most very "
    "ve bir bu ile için olarak da de her en fazla sonra önce ama veya gibi daha çok ise ki mi ne bunu şu o "
    "der die das den dem des ein eine einen und oder nicht ist sind war wird werden mit für auf von zu im in am an nach noch nur wenn aus bei man dass es sich keine zwischen jede danach zuerst "
    "le la les un une des du de et ou est sont pas pour par dans sur avec que qui ce cette il elle nous ne au aux avant dernière depuis si lorsque puis "
    "el los las una y o es son no por para con se su del al lo que cada antes hay si ".split()
)
#: Shares of words by the kind of their line, spam kinds first.
KINDS = ["links", "tags", "lists", "directory", "products", "runs", "phrases", "prose"]
FEATURES = [*KINDS, "code", "tag_rate", "length", "line_words", "described", "commas"]
SPAM_KINDS = len(KINDS) - 1


def _keyword(words: list[str], counts: Counter) -> tuple[tuple[str, ...], int]:
    """The phrase of content words that covers most of the words, and how often it occurs: one word, two, or two about a function word."""
    best, times, covered = (), 0, 0
    pairs = Counter(zip(words, words[1:]))
    p, n = max(((p, c) for p, c in pairs.items() if c >= 3 and p[0] not in STOP and p[1] not in STOP), key=lambda x: x[1], default=((), 0))
    if p:
        best, times, covered = p, n, 2 * n
    one, n = max(((w, c) for w, c in counts.items() if w not in STOP and not w.isdigit()), key=lambda x: x[1], default=("", 0))
    if n >= 4 and n >= 0.08 * len(words):
        around = Counter(t for t in zip(words, words[1:], words[2:]) if t[1] in STOP and t[0] not in STOP and t[2] not in STOP)
        t, k = max(around.items(), key=lambda x: x[1], default=((), 0))
        if k >= 3 and 3 * k > covered:
            best, times, covered = t, k, 3 * k
        if n > 1.2 * covered:
            best, times = (one,), n
    return best, times


def page(text: str) -> list[float] | None:
    """Features of a page; None without a word."""
    plain: list[str] = []
    code = 0
    fenced = False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif fenced:
            code += len(_WORD.findall(line))
        elif line.strip():
            plain.append(line)
    if "<" in text or "[/" in text:
        plain = [x for x in (_MARKUP.sub(" ", _ANCHOR.sub(r"\2 \1 ", line)) for line in plain) if x.strip()]
    body = "\n".join(plain)
    words = _WORD.findall(_URL.sub(" ", body).lower())
    urls = _URL.findall(body)
    url_words = sum(len(_WORD.findall(u)) for u in urls)
    total = len(words) + url_words + code
    if not total:
        return None
    counts = Counter(words)
    key, times = _keyword(words, counts)
    share = dict.fromkeys(KINDS, 0)
    described = 0
    waiting = ""
    for line in plain:
        found = _URL.findall(line) if "://" in line or "www." in line else ()
        bare = _BULLET.sub("", line)
        rest = _URL.sub(" ", bare) if found else bare
        own = _WORD.findall(rest)
        n = len(own) + sum(len(_WORD.findall(u)) for u in found)
        if not n:
            continue
        stripped = bare.strip()
        if found:
            # what stands after the last link, or before the first if that is a sentence, describes it
            head, tail = _URL.split(bare, maxsplit=1)[0], _URL.split(bare)[-1]
            says = max(len(_WORD.findall(tail)), len(_WORD.findall(head)) if re.search(r"[.!?]", head) else 0)
            if says >= 5 and len(found) <= 2:
                share["prose"] += n
                described += n
            else:
                share["links"] += n + (len(_WORD.findall(waiting)) if waiting else 0)
                if waiting:
                    share["prose"] -= len(_WORD.findall(waiting))
            waiting = ""
            continue
        waiting = ""
        tags = _TAG.findall(line) if "#" in line or "@" in line else ()
        if (":" in line or "=" in line) and stripped[-1] not in ".!?" and _TAG_LINE.match(line):
            share["tags"] += n
        elif len(tags) >= 3 and len(tags) >= 0.6 * len(line.split()):
            share["tags"] += n
        elif stripped[-1] not in ".!?" and len(stripped) < 200 and _PRODUCT.search(stripped):
            share["products"] += n
        elif stripped.startswith("|") or stripped.startswith("#"):
            share["prose"] += n
        elif n <= 14 and stripped[-1] not in ".!?" and "`" not in stripped and _DIRECTORY.search(stripped):
            share["directory"] += n
        else:
            items = [x for x in _SPLIT.split(stripped) if x] if any(c in stripped for c in ",;|·•/-–") else ()
            sentence_end = stripped[-1] in ".!?:" or stripped[-1] in ")`\"'" and re.search(r"[.!?]", stripped)
            if len(items) >= 6 and n <= 4 * len(items) and (not sentence_end or n <= 2.2 * len(items)) and sum(w.lower() in STOP for w in own) <= 0.12 * n:
                share["lists"] += n
                continue
            if n >= 12 and not re.search(r"[.!?:]", stripped):
                low = [w.lower() for w in own]
                if len(set(low)) <= 0.75 * n or sum(w in STOP for w in low) <= 0.05 * n:
                    share["runs"] += n
                    continue
            if key:
                for s in _SENTENCE.findall(stripped):
                    low = [w.lower() for w in _WORD.findall(s)]
                    k = len(low)
                    if not k:
                        continue
                    hits = low.count(key[0]) if len(key) == 1 else " ".join(low).count(" ".join(key))
                    others = len({w for w in low if w not in key})
                    if hits >= 2 and others <= 0.5 * k or hits == 1 and k <= 4 + len(key) and times * len(key) >= 0.15 * len(words):
                        share["phrases"] += k
                    else:
                        share["prose"] += k
                continue
            share["prose"] += n
            if not sentence_end and n <= 8:
                waiting = stripped
    # prose is a share of the words outside code; code alone is as good as prose
    kinds = [share[k] / total for k in KINDS[:SPAM_KINDS]] + [share["prose"] / (total - code) if total > code else 1.0]
    return kinds + [code / total, (body.count("#") + body.count("@")) / total, math.log1p(total), len(words) / (len(plain) or 1), described / total, (body.count(",") + body.count("|")) / total]


def spam_share(features: list[float]) -> float:
    return sum(features[:SPAM_KINDS])


# the label view


def weak_label(text: str) -> int:
    """1 spam, 0 not, -1 no label: votes on page-wide figures, none of which is a feature."""
    parts = re.split(r"^[ \t]*```.*$", text, flags=re.M)
    code = sum(len(_WORD.findall(p)) for p in parts[1::2])
    body = "\n".join(parts[::2])
    prose = _URL.sub(" ", _MARKUP.sub(" ", _ANCHOR.sub(r"\2 \1 ", body)))
    words = _WORD.findall(prose.lower())
    n = len(words)
    urls = sum(len(_WORD.findall(u)) for u in _URL.findall(body))
    if not n + urls + code:
        return -1
    counts = Counter(words)
    key, times = _keyword(words, counts)
    repeated = len(key) * times / max(1, n)
    said = 0
    for s in _SAID.findall(prose):
        w = _WORD.findall(s.lower())
        # function words are rare in some languages, so a stop, a length and words of its own make a sentence
        if len(w) >= 4 and s.rstrip()[-1:] in (".", "!", "?") and len(set(w)) >= 0.6 * len(w) and (repeated < 0.15 or " ".join(key) not in " ".join(w)):
            said += len(w)
    total = n + urls + code
    saying, stops = (said + code) / total, sum(c for w, c in counts.items() if w in STOP) / max(1, n)
    lines = [x for x in body.split("\n") if x.strip()]
    if code <= n and sum(x.lstrip().startswith("|") and "$" not in x or len(re.findall(r"\b\d+\b", x)) >= 3 and not _URL.search(x) for x in lines) > 0.5 * len(lines):
        # tables and logs have no sentences either
        return -1
    votes = 2 * (saying < 0.35) - 2 * (saying > 0.6)
    votes += (stops < 0.06 and saying < 0.5) - (stops > 0.18)
    votes += (urls > 0.35 * total) - (urls < 0.1 * total and saying > 0.5)
    votes += (repeated > 0.2 and n >= 30) - (repeated < 0.06)
    return 1 if votes >= 2 else 0 if votes <= -2 else -1


_SCHEMA = "doc_id bigint, source string, features array<float>, label tinyint"


def page_features(documents: DataFrame, labelled: float = 1.0) -> DataFrame:
    """(doc_id, source, features, label); pages without a word have none and are left out. Labels are read off for this share of the pages and for all mixed ones."""
    limit = int(labelled * 2**32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, rows, labels = [], [], []
            for i, (t, h) in enumerate(zip(b.column("text").to_pylist(), b.column("h").to_pylist())):
                f = page(t) if t else None
                if f:
                    keep.append(i)
                    rows.append(f)
                    labels.append(weak_label(t) if h < limit or MIXED[0] <= spam_share(f) <= MIXED[1] else None)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("source").take(at), pa.array(rows, pa.list_(pa.float32())), pa.array(labels, pa.int8())], names=["doc_id", "source", "features", "label"])

    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 32).alias("h")
    return require(documents, "doc_id", "source", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "source", "text", hashed).mapInArrow(run, _SCHEMA)


class Tree:
    """A binary tree as arrays; leaves hold the share of spam."""

    def __init__(self, leaf: int = LEAF) -> None:
        self.leaf = leaf
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def grow(self, x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], depth: int, rng: np.random.Generator) -> int:
        at = len(self.value)
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, float(y.mean()) if len(y) else 0.0)):
            a.append(v)
        if depth == 0 or len(y) < 2 * self.leaf or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        p = y.mean()
        impurity = p * (1 - p)
        for j in rng.choice(x.shape[1], size=max(1, int(math.sqrt(x.shape[1]) * 1.6)), replace=False):
            bins = np.searchsorted(edges[j], x[:, j], side="left")
            n = np.bincount(bins, minlength=len(edges[j]) + 1)
            k = np.bincount(bins, weights=y, minlength=len(edges[j]) + 1)
            nl, kl = np.cumsum(n)[:-1], np.cumsum(k)[:-1]
            nr, kr = len(y) - nl, y.sum() - kl
            ok = (nl >= self.leaf) & (nr >= self.leaf)
            if not ok.any():
                continue
            pl, pr = kl / np.maximum(nl, 1), kr / np.maximum(nr, 1)
            gain = np.where(ok, impurity - (nl * pl * (1 - pl) + nr * pr * (1 - pr)) / len(y), -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(j), float(edges[j][i]))
        if best[1] < 0:
            return at
        go = x[:, best[1]] <= best[2]
        self.feature[at], self.cut[at] = best[1], best[2]
        self.left[at] = self.grow(x[go], y[go], edges, depth - 1, rng)
        self.right[at] = self.grow(x[~go], y[~go], edges, depth - 1, rng)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = (np.array(a) for a in (self.feature, self.cut, self.left, self.right, self.value))
        node = np.zeros(len(x), np.int64)
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return value[node]
            f = feature[node[inner]]
            node[inner] = np.where(x[inner, f] <= cut[node[inner]], left[node[inner]], right[node[inner]])


def bag(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Tree]:
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # rare values far from the bulk keep edges of their own
    edges = [np.unique(np.concatenate([e, np.linspace(x[:, j].min(), x[:, j].max(), 12)[1:-1]])) for j, e in enumerate(edges)]
    # a class of few pages would vanish in leaves of the usual size
    leaf = LEAF if min(y.sum(), len(y) - y.sum()) >= 8 * LEAF else 1
    out = []
    # spam is rare: a bag holds at least so much of either kind
    kinds = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    share = min(max(float(y.mean()), RARE), 1 - RARE)
    for _ in range(trees):
        pick = np.concatenate([k[rng.integers(0, len(k), round(len(y) * s))] for k, s in zip(kinds, (1 - share, share))])
        t = Tree(leaf)
        t.grow(x[pick], y[pick], edges, depth, rng)
        out.append(t)
    return out


def train(rows: list, trees: int = TREES) -> list[Tree]:
    """Trees from (features, label) rows."""
    rows = [r for r in rows if r.label is not None and r.label >= 0]
    x = np.array([r.features for r in rows], np.float32).reshape(-1, len(FEATURES))
    y = np.array([r.label for r in rows], float)
    if len(y) < 4 * LEAF or y.min() == y.max():
        return []
    return bag(x, y, trees)


def votes(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Share of spam among the trees' leaves; without trees, whether most words are in spam lines."""
    if not trees:
        return (x[:, :SPAM_KINDS].sum(axis=1) > 0.5).astype(float)
    return np.mean([t.predict(x) for t in trees], axis=0)


def scores(documents: DataFrame, sample: int = SAMPLE, trees: int = TREES, host_weight: float = HOST_WEIGHT) -> DataFrame:
    """(doc_id, source, page_score, host_rate, score), one row per document with words."""
    labelled = min(1.0, 1.5 * sample / max(1, documents.count()))
    features = reliable(page_features(documents, labelled))
    spam = sum((F.element_at("features", i + 1) for i in range(SPAM_KINDS)), F.lit(0.0))
    mixed = spam.between(*MIXED)
    ready = features.where("label >= 0").select("doc_id", "features", "label")
    rows = bounded_sample(ready.where(mixed), sample // 4, "doc_id") + bounded_sample(ready.where(~mixed), sample - sample // 4, "doc_id")
    shared = documents.sparkSession.sparkContext.broadcast(train(rows, trees))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            p = votes(shared.value, x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(p, pa.float64())], names=["doc_id", "source", "page_score"])

    pages = features.mapInArrow(vote, "doc_id bigint, source string, page_score double").groupBy("doc_id").agg(F.max_by("source", F.struct("page_score", "source")).alias("source"), F.max("page_score").alias("page_score"))
    return smoothed(pages, host_weight)


def smoothed(pages: DataFrame, host_weight: float = HOST_WEIGHT) -> DataFrame:
    """(doc_id, source, page_score, host_rate, score) of pages(doc_id, source, page_score): scores moved towards the rate of their host."""
    total = pages.agg(F.avg("page_score").alias("overall"))
    hosts = pages.where("source IS NOT NULL").groupBy("source").agg(F.sum("page_score").alias("s"), F.count("*").alias("n"))
    rates = hosts.crossJoin(F.broadcast(total)).select("source", ((F.col("s") + F.col("overall") * HOST_PRIOR) / (F.col("n") + HOST_PRIOR)).alias("host_rate"), "overall")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.01)), F.lit(0.99))
    logit = lambda c: F.log(clip(c) / (1 - clip(c)))
    joined = pages.join(rates, "source", "left")
    z = logit(F.col("page_score")) + F.coalesce(host_weight * (logit(F.col("host_rate")) - logit(F.col("overall"))), F.lit(0.0))
    return joined.select("doc_id", "source", "page_score", "host_rate", (1 / (1 + F.exp(-z))).alias("score"))


def spam_pages(documents: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    return scores(documents, sample).where(F.col("score") > threshold).select("doc_id").distinct()
