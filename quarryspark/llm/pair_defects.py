"""Defective question-answer pairs: clauses tagged by a linear-chain conditional random field, tags aggregated per pair.

An answer is cut into clauses (sentences, list items, headings, code blocks, citations). The field tags each clause answer, refusal,
echo, foreign or unfinished. Labels and features are different views, so the field is not a copy of its labelling rules:

* *Labels* of a bounded sample: cue phrases and the old run's flag (wrong at times) for refusals, function words for language, copies, ends without a stop. Pairs whose flag and
  cues disagree are labelled by a field fitted to the other half of the sample. Sampled answers that are whole are also cut at random places, joined to their question
  or put under a question of another language, which gives unfinished, echo and foreign clauses whose tag is known.
* *Features*: the clause's words and pairs of words, hashed; its last word and the shape of its end; its language by a word and trigram model learned from the sample; its overlap with the question;
  its kind and place. Cues are features too, hidden in half of the training clauses, so that words have to carry a tag without them. Verdicts never read the flag.

The sample holds at most ``SAMPLE`` pairs of at most ``SAMPLE_CHARS`` characters, those with the least hash; the bound is a parameter, everything else covers all pairs and whole answers. The share of words under
each tag decides the defect.

``empty``: a null answer, or one without a word beside stand-ins for a missing answer. A null or empty question has no language and
nothing to copy, so only empty, truncated and refusal can be found. Repeated rows of a pair count once. Without a ``refused`` column the cues alone label refusals.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, require

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
SAMPLE, STEPS, RATE, PENALTY, SEED = 4000, 80, 0.25, 5e-5, 7
#: Hashed word features, and clauses in one training piece: longer answers are fitted in several pieces.
WIDTH, PIECE = 1 << 15, 64
#: By how much a field has to prefer a refusal before a pair under the flag is labelled one, and before a pair without the flag loses its label.
SURE, MARGIN = 1.5, 6.0
#: Corrupted answers are made until there are about so many, or one of each sampled answer.
MADE = 1500
#: Characters of a pair up to which it may be in the sample, so what the driver holds is bounded; verdicts cover pairs of any length.
SAMPLE_CHARS = 20_000

_WORD = re.compile(r"[^\W_]+")
# fixed values: stand-ins for a missing answer
_STAND_IN = re.compile(r"(?:n/?a|n\.a\.?|null|none|nil|nan|undefined|todo|tbd|tba|fixme|empty|blank|no answer|no response|not available|not answered|missing|pending|keine antwort|k\.?a\.?|leer|cevap yok|yanıt yok|yok|boş|sin respuesta|pas de réponse|answer|response|cevap|yanıt|antwort)", re.I)

# fixed values: function words by language; seeds of the learned language model
_LANGUAGE = {
    "en": "the a an of to is are was be been it its that this these those with for and or not but by from on in at as which what when where why how who whom whose does do did can could would should will may might if than then there here you i we they he she each every both neither nor no only until after before while because so once about into over through have has had",
    "tr": "ve veya bir bu şu için ile en olarak gibi daha çok ne neden nasıl hangi kim nerede var yok mı mi mu mü değil ise ki de da her sonra önce göre kadar olan olur çünkü artık böylece aynı ayrı kez",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war wird werden wurde mit für auf von zu zum zur im in am an nach noch nur wenn wann warum wo was wie wer bei man dass es sich keine kein zwischen jede jeder jedes danach damit weil mehr als gibt haben hat ich wir",
    "fr": "le la les un une des du de et ou est sont était pas pour par dans sur avec que qui quoi ce cette il elle nous vous ne au aux avant depuis si lorsque puis chaque où comment pourquoi quand être plus",
    "es": "el los las la un una uno y o es son fue no por para con se su de del al lo que en a cada antes después hay si como cuando donde cuál qué porque desde sin más está según",
    "it": "il lo gli la le un una di del della dello dei delle nel nella e è sono era che non per con come quando perché dove chi cosa anche questo questa ma più si al dal ogni prima dopo",
    "pt": "o os a as um uma de do da dos das em no na e é são foi que não para por com como quando onde porque quem mas mais se ao este esta cada antes depois",
    "nl": "de het een van en is zijn was niet voor met op dat die wordt worden als maar ook naar bij deze dit door om uit waar hoe waarom wanneer wie wat er geen elke voordat nadat",
    "pl": "się nie jest są na w z do że jak to ale przez dla oraz po gdy kiedy gdzie dlaczego kto co każdy przed od czy tylko został",
    "sv": "och att det som en ett är av för med inte den på till om har var när hur varför vem vad varje innan efter eller från inga",
}
_STOPS = {k: frozenset(v.split()) for k, v in _LANGUAGE.items()}
_SHARED = Counter(w for s in _STOPS.values() for w in s)
_LETTERS = {"tr": "ğşıİ", "de": "ßä", "fr": "èêàùœë", "es": "ñ¿¡", "pt": "ãõ", "pl": "łęąśżź"}
# fixed values: first code points of scripts that stand for one language here, in order
_SCRIPTS = [(0x370, ""), (0x400, "el"), (0x530, "ru"), (0x590, ""), (0x600, "he"), (0x700, "ar"), (0x900, ""), (0x980, "hi"), (0xE00, ""), (0xE80, "th"), (0x3040, ""), (0x3100, "ja"), (0x4E00, ""), (0xA000, "zh"), (0xAC00, ""), (0xD7B0, "ko")]

# fixed values: wording of refusals, by what they say
_CUES = {
    "unable": r"\b(?:cannot|can't|can not|could not|couldn't|unable|not able to|won't be able|must decline|have to (?:pass|decline)|decline to|don't have|do not have|don't know|do not know|refuse)\b|kann ich|konnte ich|nicht beantworten|nicht sagen|nicht helfen|möchte ich nicht|weiß ich nicht|veremiyorum|olamam|olamıyorum|yanıtlayamam|yanıtlayamıyorum|cevaplayam|bilmiyorum|söyleyemem|ne peux pas|ne sais pas|no puedo|no sé\b",
    "nothing": r"\b(?:no (?:evidence|mention|information|answer is possible|relevant|reference|trace)|not (?:mention|cover|contain|include|enough|found)|nothing (?:in|about|on|that|was|is)|says nothing|unable to find|not find|outside (?:what|the)|only be guessing|be a guess|enough context|enough evidence)\b|kein(?:e|en)? (?:beleg|angabe|hinweis|information|antwort)|nicht (?:gefunden|enthalten|raten)|bulamadım|bulunamadı|bir şey yok|bilgi yok|kanıt (?:yok|bulam)|aucune (?:information|preuve)|ninguna (?:información|prueba)",
    "sorry": r"\b(?:sorry|afraid|unfortunately|apologi[sz]e|regret|as an (?:ai|assistant))\b|\bleider\b|entschuldigung|tut mir leid|üzgünüm|maalesef|désolé|lo siento",
    "source": r"\b(?:excerpts?|context|sources?|indexed code|code i was given|chunks?|snippets?|provided|retrieved|shown to me)\b|ausschnitt|auszüge|indizierten|parçalar|indekslenen|verilen|extraits|fragmentos",
    "instead": r"\b(?:only (?:describe|mention|cover|show|talk)s?|please (?:index|provide|share|add|rephrase)|ask again|index more)\b|beschreiben nur|bitte (?:weitere|mehr)|yalnızca .* hakkında|lütfen",
}
_CUE = {k: re.compile(v, re.I) for k, v in _CUES.items()}
# fixed values: words of cues that every text is full of; each cue holds another one, and a clause without any of those is not searched
_PLAIN = set("ai an as about be bir can code could do en have in is lo me more ne nicht no not on only pas sz that the to was what".split()) - {"can", "could", "have", "no"}
_CUE_WORDS = re.compile("|".join(w if len(w) > 4 else f"^{w}" for w in sorted({w for v in _CUES.values() for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"\\b|\(\?:", " ", v))} - _PLAIN)))
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»|`[^`\n]*`")
_CITATION = re.compile(r"\(?\[?`?[\w./-]+\.\w+:\d+(?:-\d+)?`?\]?\)?[.;,]?")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")
_MARK = re.compile(r"\d+[.)]|[-*+•]")
_BOUND = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+(?=\S)")
_FINISHED = re.compile(r"[.!?…:;][\"'”»)\]*_]*$")
_FENCE = re.compile(r"^[ \t]*```[^\n]*$\n?", re.M)
_STOPPED = re.compile(r"[.!?…]")
_NAME = re.compile(r"[\w./]+\([^)]*\)|\w+_\w+|[a-z]+[A-Z]\w*")
_TOKEN = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»|`[^`\n]*`|\w[\w./]*\([^()\n]*\)|[^\W_]+(?:[_./]+[^\W_]+)+|[^\W_]+")
_CAMEL = re.compile(r"[a-z][A-Z]")
_ENDS = frozenset(".!?…")
_KEPT = re.compile(r"[.!?…\s]")


def language(text: str) -> str | None:
    """Language by function words and letters alone: the label view."""
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", text)]
    if not words:
        return None
    score = {k: sum(1 / _SHARED[w] for w in words if w in s) for k, s in _STOPS.items()}
    for k, letters in _LETTERS.items():
        score[k] += 1.5 * sum(any(c in letters for c in w) for w in words)
    for w in words:
        if s := _script(w):
            score[s] = score.get(s, 0) + 1
    best = max(score, key=lambda k: score[k])
    rest = max(v for k, v in score.items() if k != best)
    return best if score[best] >= 0.5 and score[best] > rest else None


def _script(word: str) -> str:
    at = ord(word[0])
    if at < 0x370:
        return ""
    return next((k for end, k in _SCRIPTS if at < end), "")


def _bare(text: str) -> str:
    """Prose without quotations and names of code."""
    return _NAME.sub(" ", _QUOTED.sub(" ", text))


def clauses(answer: str) -> list[tuple[str, str]]:
    """(kind, text): prose, item, code, open (a code block without its end) or citation, in order."""
    out: list[tuple[str, str]] = []
    parts = _FENCE.split(answer) if "```" in answer else [answer]
    fences = len(parts) - 1
    for i, part in enumerate(parts):
        if i % 2:
            out.append(("open" if i == fences else "code", part))
            continue
        for line in part.split("\n"):
            body = line.strip()
            if not body:
                continue
            kind = "item" if _ITEM.match(line) else "prose"
            # neither a path nor a quotation ends a sentence
            quoted = '"' in body or "`" in body or "“" in body or "„" in body or "«" in body
            safe = _QUOTED.sub(lambda m: _KEPT.sub("x", m.group()[:-1]) + m.group()[-1], body) if quoted else body
            last = 0
            for m in [*_BOUND.finditer(safe), None]:
                piece = body[last : m.start() if m else len(body)].strip()
                if m:
                    last = m.end()
                if not piece or _MARK.fullmatch(piece):
                    continue
                out.append(("citation" if ":" in piece and _CITATION.fullmatch(piece) else kind, piece))
    return out


def _norm(text: str) -> list[str]:
    if "İ" in text or "I" in text:
        text = text.replace("İ", "i").replace("I", "i")
    return _WORD.findall(text.lower())


def ended(text: str) -> bool:
    """Whether a clause stops as a sentence does, with its quotes and marks closed."""
    return bool(_FINISHED.search(text)) and text.count("`") % 2 == 0 and text.count('"') % 2 == 0 or text.endswith(")") and bool(_CITATION.search(text[-60:]))


# the label view


def weak_tags(question: str | None, answer: str) -> list[int]:
    """Labelling functions: one tag for each clause, from cues, function words, copies and ends."""
    parts = clauses(answer)
    q = _norm((question or "").replace("`", ""))
    q_set, q_language = set(q), language(_QUOTED.sub(" ", question or ""))
    whole = language(" ".join(_bare(t) for k, t in parts if k in ("prose", "item")))
    out: list[int] = []
    for i, (kind, text) in enumerate(parts):
        if kind not in ("prose", "item"):
            out.append(UNFINISHED if kind == "open" else ANSWER)
            continue
        cue = {k: bool(r.search(_QUOTED.sub(" ", text))) for k, r in _CUE.items()}
        words = _norm(text.replace("`", ""))
        body = words[1:] if words and words[0] in ("q", "question", "soru", "frage") else words
        own = language(_bare(text)) or whole
        if q_set and words and (body == q or len(body) >= 0.6 * len(q) > 2 and body == q[: len(body)] or len(q_set & set(words)) >= 0.8 * len(q_set | set(words))):
            tag = ECHO
        elif i == len(parts) - 1 and not ended(text) and not (kind == "item" and len(items := [t for k, t in parts[:i] if k == "item"]) > 1 and not any(map(ended, items))):
            # a list none of whose items has a stop needs none at its end
            tag = UNFINISHED
        elif cue["unable"] and (cue["source"] or cue["sorry"] or cue["nothing"]) or cue["nothing"] and (cue["source"] or cue["sorry"]) or cue["sorry"] and (cue["source"] or i == 0):
            tag = REFUSAL
        elif cue["instead"] and out and out[-1] == REFUSAL:
            tag = REFUSAL
        else:
            tag = FOREIGN if own and q_language and own != q_language else ANSWER
        out.append(tag)
    return out


# the feature view


class Tongue:
    """Languages of words: learned counts where the sample has them, function words and scripts elsewhere."""

    def __init__(self, texts: list[str]) -> None:
        words: dict[str, Counter] = defaultdict(Counter)
        grams: dict[str, Counter] = defaultdict(Counter)
        for t in texts:
            if k := language(t):
                for w in re.findall(r"[^\W\d_]+", t.lower()):
                    words[k][w] += 1
                    if len(w) > 3:
                        grams[k].update(f" {w} "[i : i + 3] for i in range(len(w)))
        learned = {k: c for k, c in words.items() if c.total() >= 300}
        self.lexicon: dict[str, tuple[str, float]] = {w: (k, 1.0 / _SHARED[w]) for k, s in _STOPS.items() for w in s if _SHARED[w] == 1}
        for w in {w for c in learned.values() for w, n in c.items() if n >= 3}:
            rate = sorted(((c[w] + 0.3) / (c.total() + 300), k) for k, c in learned.items())
            if len(rate) == 1 or rate[-1][0] > 6 * rate[-2][0]:
                self.lexicon[w] = (rate[-1][1], 1.0)
            else:
                self.lexicon.pop(w, None)
        self.grams = {k: ({g: math.log(n + 0.5) for g, n in grams[k].items()}, math.log(grams[k].total() + 2000)) for k in learned} if len(learned) > 1 else {}

    def of(self, word: str) -> tuple[str, float]:
        """(language, weight) of a lower-case word; weight 0 if it says nothing."""
        if found := self.lexicon.get(word):
            return found
        if s := _script(word):
            return s, 1.0
        for k, letters in _LETTERS.items():
            if any(c in letters for c in word):
                return k, 0.7
        if len(word) > 3 and self.grams:
            spelled = f" {word} "
            at = [spelled[i : i + 3] for i in range(len(word))]
            score = sorted((sum(c.get(g, -0.7) for g in at) - len(at) * total, k) for k, (c, total) in self.grams.items())
            if score[-1][0] - score[-2][0] > 4:
                return score[-1][1], 0.3
        return "", 0.0


FEATURES = ["bias", "first", "last", "item", "code", "open", "citation", "short", "same", "other", "unknown", "whole_other", "whole_same", "overlap_some", "overlap_most", "overlap_all", "in_order", "begins", "asks", "end_stop", "end_colon", "end_comma", "end_word", "end_sign", "end_open", "end_citation", "last_stop", "last_colon", "last_comma", "last_word", "last_sign", "last_open", "like_item", "unlike_item", "prose_left", "item_left", "cue_unable", "cue_nothing", "cue_sorry", "cue_source", "cue_instead", "cue_two"]
_BASE = len(FEATURES)
_FIRST_CUE = FEATURES.index("cue_unable")


class Reader:
    """Turns pairs into clause features; words are looked up once and remembered."""

    def __init__(self, tongue: Tongue) -> None:
        self.tongue = tongue
        self.known: dict[str, tuple[int, str, float, bool]] = {}

    def _token(self, t: str) -> tuple[int, str, float, bool]:
        """(feature, language, weight, whether the word occurs in a cue)."""
        c = t[0]
        if c in "\"“„«":
            name, tongue = "<quote>", ("", 0.0)
        elif t.isdigit():
            name, tongue = "<number>", ("", 0.0)
        elif c == "`" or "(" in t or "_" in t or "/" in t or "." in t or _CAMEL.search(t):
            name, tongue = "<name>", ("", 0.0)
        else:
            name = t.replace("İ", "i").lower()
            tongue = self.tongue.of(name)
        if len(self.known) > 500_000:
            self.known.clear()
        found = self.known[t] = (xxhash.xxh32_intdigest(name) % WIDTH, *tongue, bool(_CUE_WORDS.search(name)))
        return found

    def _words(self, text: str) -> tuple[list[int], dict[str, float], bool]:
        ids, score, cued = [], {}, False
        known = self.known
        for t in _TOKEN.findall(text):
            f, k, w, c = known.get(t) or self._token(t)
            ids.append(f)
            if w:
                score[k] = score.get(k, 0.0) + w
            cued = cued or c
        return ids, score, cued

    @staticmethod
    def _best(score: dict[str, float], least: float) -> str:
        if not score:
            return ""
        best = max(score, key=score.__getitem__)
        if score[best] < least:
            return ""
        return best if len(score) == 1 or score[best] > 1.5 * max(v for k, v in score.items() if k != best) else ""

    def read(self, question: str | None, answer: str) -> tuple[list[list[int]], list[list[int]], list[int], list[str]]:
        """(dense features, word features, words, kinds) of the clauses."""
        parts = clauses(answer)
        question = question or ""
        q = _norm(question.replace("`", ""))
        q_set, q_n = set(q), len(q)
        # a clause without the longest word of the question is no copy of it
        q_key = max(q, key=len, default="")
        q_language = self._best(self._words(_NAME.sub(" ", question))[1], 0.5)
        read = []
        total: dict[str, float] = {}
        for kind, text in parts:
            ids, score, cued = self._words(text) if kind in ("prose", "item") else ([], {}, False)
            for k, v in score.items():
                total[k] = total.get(k, 0.0) + v
            read.append((ids, score, cued))
        whole = self._best(total, 0.5)
        dense, lexical, sizes = [], [], []
        last, item_stop = len(parts) - 1, None
        for i, ((kind, text), (ids, score, cued)) in enumerate(zip(parts, read)):
            f = [0]
            on = f.append
            if i == 0:
                on(1)
            if i == last:
                on(2)
            if kind not in ("prose", "item"):
                on({"code": 4, "open": 5, "citation": 6}[kind])
                dense.append(f)
                lexical.append([])
                sizes.append(max(1, len(text.split())))
                continue
            if kind == "item":
                on(3)
            if len(ids) <= 3:
                on(7)
            own = self._best(score, 0.9) or whole
            on(10 if not own or not q_language else 8 if own == q_language else 9)
            if whole and q_language:
                on(12 if whole == q_language else 11)
            if q_n and q_key in text.replace("İ", "i").replace("I", "i").lower() and (words := _norm(text.replace("`", ""))):
                seen = set(words)
                share = len(q_set & seen) / len(q_set | seen)
                if share >= 0.4:
                    on(15 if share >= 0.95 else 14 if share >= 0.8 else 13)
                body = words[1:] if words[0] in ("q", "question", "soru", "frage") else words
                if body == q:
                    on(16)
                elif len(body) >= 0.6 * q_n > 2 and body == q[: len(body)]:
                    on(17)
            tail = text.rstrip("\"'”»)]*_ ")
            if tail.endswith("?"):
                on(18)
            if text.count("`") % 2 or text.count('"') % 2 or "(" in text and text.count("(") > text.count(")"):
                shape = 5
            elif text[-1] == ")" and _CITATION.search(text[-60:]):
                shape = 6
            else:
                end = tail[-1:]
                shape = 0 if end in _ENDS else 1 if end and end in ":;" else 2 if end == "," else 3 if end.isalnum() else 4
            on(19 + shape)
            if i == last and shape < 6:
                on(26 + shape)
            if i == last and 2 <= shape <= 5:
                on(34 if kind == "prose" else 35)
            if kind == "item":
                if item_stop is not None:
                    on(32 if item_stop == shape else 33)
                item_stop = shape
            if cued:
                plain = _QUOTED.sub(" ", text)
                cues = [_FIRST_CUE + j for j, r in enumerate(_CUE.values()) if r.search(plain)]
                f += cues if len(cues) < 2 else [*cues, _FIRST_CUE + len(_CUE)]
            dense.append(f)
            lexical.append(ids)
            sizes.append(max(1, len(ids)))
        return dense, lexical, sizes, [k for k, _ in parts]


def matrix(read: list[tuple[list[list[int]], list[list[int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, first of each clause): dense ones, words, pairs of words and the last word, for all clauses of all answers."""
    dense = [c for d, _ in read for c in d]
    words = [c for _, w in read for c in w]
    n = len(dense)
    nd, nw = np.fromiter(map(len, dense), np.int64, n), np.fromiter(map(len, words), np.int64, n)
    d = np.fromiter(chain.from_iterable(dense), np.int64, int(nd.sum()))
    w = np.fromiter(chain.from_iterable(words), np.int64, int(nw.sum()))
    own = np.repeat(np.arange(n), nw)
    pair = np.flatnonzero(own[1:] == own[:-1]) if len(own) else np.zeros(0, np.int64)
    bigram = (w[pair] * 40503 + w[pair + 1] * 7919 + 11) % WIDTH if len(pair) else np.zeros(0, np.int64)
    tail = np.cumsum(nw)[nw > 0] - 1
    last = (w[tail] * 2654435 + 5) % WIDTH
    rows = np.concatenate([np.repeat(np.arange(n), nd), own, own[pair] if len(pair) else pair, np.flatnonzero(nw > 0)])
    ids = np.concatenate([d, _BASE + w, _BASE + WIDTH + bigram, _BASE + 2 * WIDTH + last])
    order = np.argsort(rows, kind="stable")
    return ids[order], np.searchsorted(rows[order], np.arange(n))


class Field:
    """Linear-chain conditional random field: w for clause features, t for neighbouring tags."""

    def __init__(self, w: np.ndarray, t: np.ndarray) -> None:
        self.w, self.t = w, t

    def decode_all(self, ids: np.ndarray, first: np.ndarray, lengths: list[int]) -> list[list[int]]:
        """Best tags of many answers; those of one length are decoded together."""
        e = np.add.reduceat(self.w[ids], first, axis=0).astype(np.float64) if len(first) else np.zeros((0, len(TAGS)))
        starts = np.concatenate(([0], np.cumsum(lengths)))
        out: list[list[int]] = [[] for _ in lengths]
        same: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(lengths):
            same[n].append(i)
        for n, who in same.items():
            if n == 0:
                continue
            x = e[starts[who][:, None] + np.arange(n)]
            score, back = x[:, 0], []
            for s in range(1, n):
                through = score[:, :, None] + self.t
                back.append(through.argmax(1))
                score = through.max(1) + x[:, s]
            tags = [score.argmax(1)]
            for b in reversed(back):
                tags.append(b[np.arange(len(who)), tags[-1]])
            for i, row in zip(who, np.stack(tags[::-1], 1).tolist()):
                out[i] = row
        return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def fit(read: list[tuple[list[list[int]], list[list[int]]]], tags: list[list[int]], steps: int = STEPS) -> Field:
    """Regularised maximum likelihood by Adam over whole batches; answers are padded to powers of two within their length."""
    k = len(TAGS)
    size = _BASE + 3 * WIDTH
    pieces = [(d[s : s + PIECE], w[s : s + PIECE], y[s : s + PIECE]) for (d, w), y in zip(read, tags) for s in range(0, len(y), PIECE)]
    if not pieces:
        return Field(np.zeros((size, k), np.float32), np.zeros((k, k)))
    ids, first = matrix([(d, w) for d, w, _ in pieces])
    n = len(first)
    used, seen = np.unique(ids, return_counts=True)
    # word features of one clause only cannot be told from noise
    used = used[(seen > 1) | (used < _BASE)]
    keep = np.isin(ids, used)
    owner = np.repeat(np.arange(n), np.diff(np.append(first, len(ids))))[keep]
    col = np.searchsorted(used, ids[keep])
    first = np.searchsorted(owner, np.arange(n))
    by_feature = np.argsort(col, kind="stable")
    owner_f, first_f = owner[by_feature], np.searchsorted(col[by_feature], np.arange(len(used)))
    gold = np.zeros((n, k))
    gold[np.arange(n), np.concatenate([y for _, _, y in pieces])] = 1
    at = np.concatenate(([0], np.cumsum([len(y) for _, _, y in pieces])))
    buckets = defaultdict(list)
    for i, (_, _, y) in enumerate(pieces):
        buckets[1 << (len(y) - 1).bit_length()].append(i)
    plans = []
    gold_t = np.zeros((k, k))
    for longest, who in buckets.items():
        lengths = at[1:][who] - at[who]
        mask = np.arange(longest) < lengths[:, None]
        rows = np.where(mask, at[who][:, None] + np.arange(longest), 0)
        plans.append((longest, rows, mask))
        if longest > 1:
            both = (mask[:, 1:] & mask[:, :-1]).astype(float)
            gold_t += np.einsum("nti,ntj,nt->ij", gold[rows[:, :-1]], gold[rows[:, 1:]], both)
    w, t = np.zeros((len(used), k)), np.zeros((k, k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, steps + 1):
        e_all = np.add.reduceat(w[col], first, axis=0)
        rest = gold.copy()
        grad_t = gold_t.copy()
        for longest, rows, mask in plans:
            e = e_all[rows]
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for s in range(1, longest):
                alpha[:, s] = np.where(mask[:, s, None], _lse(alpha[:, s - 1, :, None] + t, 1) + e[:, s], alpha[:, s - 1])
            for s in range(longest - 2, -1, -1):
                beta[:, s] = np.where(mask[:, s + 1, None], _lse(t + (e[:, s + 1] + beta[:, s + 1])[:, None, :], 2), 0)
            z = _lse(alpha[:, -1], 1)
            rest[rows[mask]] -= np.exp(alpha + beta - z[:, None, None])[mask]
            if longest > 1:
                pair = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
                grad_t -= pair[mask[:, 1:]].sum(0)
        grads = [np.add.reduceat(rest[owner_f], first_f, axis=0) / n - PENALTY * w, grad_t / n - PENALTY * t]
        for i, (param, g) in enumerate(((w, grads[0]), (t, grads[1]))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    out = np.zeros((size, k), np.float32)
    out[used] = w
    return Field(out, t)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if not _WORD.search(answer):
        return True
    if len(answer) > 200:
        return False
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", answer)
    return bool(_STAND_IN.fullmatch(bare)) or bool(_STAND_IN.fullmatch(re.sub(r"[\W_]+$", "", answer.strip("([{<\"' \n"))))


def verdict(tags: list[int], sizes: list[int], kinds: list[str]) -> str | None:
    """The defect of a pair from the words under each tag of its clauses."""
    if not tags:
        return "empty"
    cover, prose = [0] * len(TAGS), [0] * len(TAGS)
    for tag, n, kind in zip(tags, sizes, kinds):
        if kind != "citation":
            cover[tag] += n
            if kind in ("prose", "item"):
                prose[tag] += n
    if not sum(cover):
        return None
    if cover[ECHO] == sum(cover):
        return "copies_question"
    if tags[-1] == UNFINISHED:
        return "truncated"
    said = sum(prose) - prose[ECHO]
    if prose[REFUSAL] > 0 and prose[REFUSAL] >= 0.5 * said:
        return "refusal"
    return "other_language" if prose[FOREIGN] > 0.5 * said else None


class Model:
    def __init__(self, tongue: Tongue, field: Field) -> None:
        self.tongue, self.field, self.reader = tongue, field, Reader(tongue)

    def __getstate__(self) -> tuple:
        return self.tongue, self.field

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def defects(self, pairs: list[tuple[str | None, str | None]], characters: int = 4_000_000) -> list[str | None]:
        """One verdict a pair; answers are decoded in groups of so many characters, which bounds the memory of a batch of long ones."""
        out: list[str | None] = ["empty"] * len(pairs)
        who: list[int] = []
        held = 0
        for i, (_, a) in enumerate(pairs):
            if not is_empty(a):
                who.append(i)
                held += len(a)
            if who and (held >= characters or i == len(pairs) - 1):
                read = [self.reader.read(*pairs[j]) for j in who]
                tags = self.field.decode_all(*matrix([(d, w) for d, w, _, _ in read]), [len(d) for d, _, _, _ in read])
                for j, y, (_, _, sizes, kinds) in zip(who, tags, read):
                    out[j] = verdict(y, sizes, kinds)
                who, held = [], 0
        return out


def _corrupted(whole: list[tuple[str, str, str]], rng: np.random.Generator) -> list[tuple[str, str, list[int] | None]]:
    """(question, answer, tags): whole answers cut, under their question, or under a question of another language. Tags None: the last clause is unfinished, the rest answer."""
    out: list[tuple[str, str, list[int] | None]] = []
    asked = defaultdict(list)
    for q, _, k in whole:
        asked[k].append(q)
    # a small sample is used several times
    for q, a, k in whole * -(-MADE // max(1, len(whole))):
        # half of them are cut
        kind = max(0, int(rng.integers(6)) - 2)
        parts = clauses(a)
        if kind == 0:
            # anywhere, or just before the end
            at = int(rng.integers(max(1, len(a) * 2 // 5) if rng.random() < 0.6 else len(a) - 20, len(a))) if len(a) > 20 else 0
            cut = a[:at] if rng.random() < 0.4 else a[:at].rsplit(" ", 1)[0].rstrip()
            if rng.random() < 0.15:
                cut = f"{a}\n\n```\n{cut}"
            left = clauses(cut) if at else []
            if left and left[-1][0] != "citation" and (left[-1][0] == "open" or not ended(left[-1][1])) and (left[-1][0] != "code") and not is_empty(cut):
                out.append((q, cut, None))
        elif kind == 1:
            form = int(rng.integers(5))
            text = [q, q.upper(), f'"{q}"', f"Q: {q}", q[:1].upper() + q[1:].rstrip("?") + "?"][form]
            if rng.random() < 0.5:
                out.append((q, text, [ECHO] * len(clauses(text))))
            elif ended(text) and len(clauses(f"{text} {a}")) == (n := len(clauses(text))) + len(parts):
                out.append((q, f"{text} {a}", [ECHO] * n + [ANSWER] * len(parts)))
        elif kind == 2 and len(asked) > 1:
            others = [x for x in sorted(asked) if x != k]
            pool = asked[others[int(rng.integers(len(others)))]]
            out.append((pool[int(rng.integers(len(pool)))], a, [FOREIGN if x in ("prose", "item") else ANSWER for x, _ in parts]))
        elif kind == 3 and sum(x == "item" for x, _ in parts) > 1:
            bare = "\n".join(line.rstrip(".") if _ITEM.match(line) else line for line in a.split("\n"))
            if len(clauses(bare)) == len(parts):
                out.append((q, bare, [ANSWER] * len(parts)))
    return out


def fit_model(rows: list[tuple[str | None, str | None, bool | None]], steps: int = STEPS, seed: int = SEED) -> Model:
    """Field and language model from sampled (question, answer, flag). A small sample takes more steps."""
    steps = min(4 * steps, int(steps * max(1.0, SAMPLE / max(1, len(rows))) ** 0.5))
    rows = [r for r in rows if not is_empty(r[1])]
    bare = [[_bare(t) for k, t in clauses(a) if k in ("prose", "item")] for _, a, _ in rows]
    tongue = Tongue([x for texts in bare for x in texts] + [_bare(q) for q, _, _ in rows if q])
    reader = Reader(tongue)
    rng = np.random.default_rng(seed)

    def features(q: str | None, a: str) -> tuple[list[list[int]], list[list[int]]]:
        dense, words, _, _ = reader.read(q, a)
        return [c if rng.random() < 0.6 else [f for f in c if f < _FIRST_CUE] for c in dense], words

    read = [features(q, a) for q, a, _ in rows]
    tags = [weak_tags(q, a) for q, a, _ in rows]
    # short prose under the flag that no cue explains may be a refusal in words of its own; where other pairs have a flag, one without says nothing
    short = [i for i, (_, a, _) in enumerate(rows) if 0 < len(tags[i]) <= 4 and set(tags[i]) == {ANSWER} and all(k == "prose" for k, _ in clauses(a))]
    disputed = [i for i in short if rows[i][2]]
    silent = {i for i in short if rows[i][2] is None} if disputed else set()
    made = _corrupted([(q, a, k) for (q, a, flag), y in zip(rows, tags) if q and set(y) == {ANSWER} and flag is not True and (k := language(_QUOTED.sub(" ", q)))], rng)
    extra = [features(q, a) for q, a, _ in made]
    extra_tags = [y if y is not None else [ANSWER] * (len(d) - 1) + [UNFINISHED] for (d, _), (_, _, y) in zip(extra, made)]
    if disputed:
        noisy = list(tags)
        for i in disputed:
            noisy[i] = [REFUSAL] * len(tags[i])
        for half in (0, 1):
            train = [i for i in range(len(rows)) if i % 2 != half and i not in silent]
            there = [i for i in short if i % 2 == half and i not in silent]
            if train and there:
                field = fit([read[i] for i in train], [noisy[i] for i in train], steps // 2)
                for i in there:
                    ids, first = matrix([read[i]])
                    y = field.decode_all(ids, first, [len(first)])[0]
                    ahead = (field.w[ids, REFUSAL] - field.w[ids, ANSWER]).sum()
                    if rows[i][2]:
                        # only what this was asked for, and clearly: another tag stays with the labelling functions
                        tags[i] = [REFUSAL if x == REFUSAL and ahead > SURE else ANSWER for x in y]
                    elif set(y) == {REFUSAL} and ahead > MARGIN:
                        silent.add(i)
    kept = [i for i in range(len(rows)) if i not in silent]
    return Model(tongue, fit([read[i] for i in kept] + extra, [tags[i] for i in kept] + extra_tags, steps))


def _pairs(pairs: DataFrame) -> DataFrame:
    flag = F.col("refused").cast("boolean") if "refused" in pairs.columns else F.lit(None).cast("boolean")
    return pairs.select(F.col("`id`"), F.col("`question`"), F.col("`answer`"), flag.alias("flag")).where("id IS NOT NULL")


def train(pairs: DataFrame, sample: int = SAMPLE) -> Model:
    rows = bounded_sample(_pairs(pairs).where((F.length("answer") + F.length(F.coalesce("question", F.lit("")))) <= SAMPLE_CHARS), sample, "id")
    return fit_model(sorted({(r.question, r.answer, r.flag) for r in rows}, key=lambda r: xxhash.xxh64_intdigest(f"{r[0]}\n{r[1]}")))


def defective_pairs(pairs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, defect), one row per defective pair. Should rows of one id differ, each is judged and the first defect by name is kept.

    Two passes: the sample, and the verdicts; only verdicts of defective rows are shuffled.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(train(pairs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = shared.value.defects(list(zip(b.column("question").to_pylist(), b.column("answer").to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=["id", "defect"])

    rows = require(pairs, "id", "question", "answer").where("id IS NOT NULL")
    return rows.mapInArrow(run, "id string, defect string").where("defect IS NOT NULL").groupBy("id").agg(F.min("defect").alias("defect"))
