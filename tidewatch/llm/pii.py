"""Personal data: fixed patterns, and a conditional random field for what they miss.

Base spans of four kinds come from the patterns and always stay.  The model reads the
text as words with shape features (letters, digits and marks by class, length, the
neighbours' shapes, a few cue words) and labels them ``O``, ``B-kind`` or ``I-kind``;
its spans are added where they touch no base span: ``email`` written out, ``phone``
numbers without a country code, ``card`` numbers grouped otherwise, and ``secret``
(tokens, keys and passwords after a cue).

A word without digits or marks that has no such word within two places is ``O`` by the
definition of the model, in training too.  Such words split the chain: a text is decoded
in runs around loud words with five words on either side, and the labels are those of
decoding it whole.

The labelled table is small and made here from a seed (``training_rows``); fitting
reads at most ``MAX_LABELLED`` rows, a documented bound.

Defined cases: a null or empty text has no spans; offsets are code points, end
exclusive; overlapping spans of different base kinds all stay; repeated rows are
searched each on its own; an empty table gives an empty result; further columns pass
through ``find``, results replace columns of their name.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, table
from tidewatch.llm.crf import LinearChain, train

# Fixed values of the contract: kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LABELS = ["O"] + [f"{p}-{k}" for k in ("email", "card", "phone", "secret") for p in "BI"]
MAX_LABELLED = 2_000
SPAN_KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3, "secret": 4}
# Words whose text is a feature.
CUES = frozenset(
    "tel phone call fax mobile cell telefon card visa mastercard token key apikey api_key secret password passwd pwd".split()
)
_LOUD = re.compile(r"[0-9@+=_]+|[(\[](?:at|dot)[)\]]", re.IGNORECASE)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = frozenset(["(at)", "[at]", "(dot)", "[dot]", "="])
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ``EMAIL``, from each @ outward: no run of letters is read twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        start = at
        while domain and start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ``IP`` whose parts are small: every four numbers of a dotted chain."""
    for m in _CHAIN.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; failing matches are dropped."""
    out = [(start, end, "email") for start, end in _emails(text)]
    if "." in text:
        out += [(start, end, "ip") for start, end in _addresses(text)]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(word: str) -> str:
    """Classes of characters, runs cut at four: ``X`` upper, ``x`` other letter, ``9`` digit."""
    out, last, run = [], "", 0
    for c in word[:40]:
        k = "9" if "0" <= c <= "9" else ("X" if c.isupper() else "x") if c.isalpha() else c if c in "@+-./()_=:" else "~"
        run = run + 1 if k == last else 1
        if run <= 4:
            out.append(k)
        last = k
    return "".join(out)


def loud(word: str) -> bool:
    return _LOUD.search(word) is not None


def features(words: list[str], i: int) -> list[str]:
    word = words[i]
    near = {step: words[i + step] if 0 <= i + step < len(words) else None for step in (-2, -1, 1, 2)}
    if not loud(word) and not any(w and loud(w) for w in near.values()):
        return ["deep"]
    core = word.strip(_EDGE)
    low = core.lower()
    if loud(word):
        digits = sum("0" <= c <= "9" for c in core)
        bare = word.lower().strip(",.;:!*#%&$")
        names = [f"shape={shape(core)}", f"digits={min(digits, 20)}", f"size={min(len(core) // 4, 8)}", f"mark={bare if bare in _MARKS else ''}"]
        if len(core) >= 16 and digits and any(c.isalpha() for c in core) and all(c.isalnum() or c in "-_" for c in core):
            names.append("mixed16")
    else:
        names = ["plain", f"cue={low if low in CUES else ''}"]
    for step, other in near.items():
        if other is None:
            names.append(f"{step}:edge")
            continue
        bare, low = other.lower().strip(",.;:!*#%&$"), other.strip(_EDGE).lower()
        names.append(f"{step}:{bare if bare in _MARKS else low if low in CUES else shape(other.strip(_EDGE)) if loud(other) else 'plain'}")
    return names


def training_rows(seed: int = 5, count: int = 600) -> list[tuple[list[str], list[str]]]:
    """The labelled table: words and their tags, from templates over made-up words."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    syllables = ["an", "er", "on", "the", "in", "re", "und", "que", "os", "la", "mi", "to", "é", "ñ", "ver", "ch"]
    filler = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def marked(word: str) -> str:
        kind = rng.random()
        if kind < 0.12:
            word = word.capitalize()
        elif kind < 0.15:
            word = word.upper()
        return word + rng.choice(["", "", "", "", "", ",", ".", "###", "!!", "***", "%%%"])

    def tagged(kind: str, words: list[str]) -> list[tuple[str, str]]:
        return [(w, ("B-" if i == 0 else "I-") + kind) for i, w in enumerate(words)]

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        cue = [(rng.choice(["call", "tel", "phone", "Tel:", "mobile", "fax"]), "O")]
        form = rng.choice([[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"({a}){b}-{c}"], [a, b, c]])
        needs_cue = len(form) == 3 or rng.random() < 0.5
        return (cue if needs_cue else []) + tagged("phone", form)

    def email():
        cue = rng.choice([["(at)", "(dot)"], ["[at]", "[dot]"]])
        return tagged("email", [filler() + rng.choice(["", digits(2)]), cue[0], filler(), cue[1], rng.choice(["com", "org", "net"])])

    def secret():
        name = rng.choice(["token", "key", "secret", "api_key", "password", "apikey", "TOKEN"])
        value = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([20, 32, 40, 64])))
        value = value.upper() if name == "TOKEN" else value
        return [(name, "O"), ("=", "O"), *tagged("secret", [f'"{value}"'])]

    def card():
        return [(rng.choice(["card", "visa", "mastercard"]), "O"), *tagged("card", [f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}"])]

    def other():
        return [
            (w, "O")
            for w in rng.choice(
                [
                    [digits(rng.randint(1, 6))], [digits(16)], [f"{digits(3)}.{digits(2)}.{digits(2)}.{digits(3)}"], [f"{digits(1)}.{digits(1)}."],
                    [f"{filler()}.{digits(2)}@mail{digits(1)}.example.com"], ["+1", f"({digits(3)})", f"555-{digits(4)}"],
                    [f"{digits(4)}-{digits(2)}-{digits(2)}"], ["version", f"{digits(1)}."], ["(at)", filler()], [filler(), "=", digits(3)], [filler(), "=", filler()], ["key", filler()], ["token", filler()],
                    [f"{digits(2)}:{digits(2)}"], [f"{digits(3)}-{digits(3)}"], [digits(3), digits(3)], ["number", digits(4)], ["card", filler()],
                ]
            )
        ]

    rows = []
    for _ in range(min(count, MAX_LABELLED)):
        row: list[tuple[str, str]] = []
        for _ in range(rng.randint(1, 4)):
            row += [(marked(filler()), "O") for _ in range(rng.randint(0, 5))]
            row += rng.choice([phone, email, secret, card, other, other, other])()
        row += [(marked(filler()), "O") for _ in range(rng.randint(0, 5))]
        rows.append(([w for w, _ in row], [t for _, t in row]))
    return rows


class Tagger:
    def __init__(self, model: LinearChain):
        self.model = model
        self._cache: dict[tuple[str, ...], np.ndarray] = {}

    def tag(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Label numbers of every word of each sequence."""
        if not sequences:
            return []
        lengths = np.array([len(s) for s in sequences])
        rows = []
        for words in sequences:
            for i in range(len(words)):
                names = tuple(features(words, i))
                row = self._cache.get(names)
                if row is None:
                    if len(self._cache) > 200_000:
                        self._cache.clear()
                    row = self._cache[names] = self.model.emit[self.model.numbers(list(names))].sum(axis=0)
                rows.append(row)
        best = self.model.viterbi(np.array(rows), lengths)
        return np.split(best, np.cumsum(lengths)[:-1])


@cache
def tagger() -> Tagger:
    """Trained once, on the driver, from the labelled table; tasks receive it."""
    rows = [([features(words, i) for i in range(len(words))], tags) for words, tags in training_rows()]
    return Tagger(train(rows, LABELS, only_first="deep"))



def _words(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def model_spans(texts: list[str], tag: Tagger, whole: bool = False) -> list[list[tuple[int, int, str]]]:
    """Spans the model finds in each text, by start; ``whole`` decodes texts undivided."""
    runs: list[list[str]] = []
    places: list[tuple[int, list[tuple[int, int]]]] = []
    for number, text in enumerate(texts):
        for spans in [_words(text)] * bool(text.strip()) if whole else _runs(text):
            runs.append([text[a:b] for a, b in spans])
            places.append((number, spans))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for labels, words, (number, spans) in zip(tag.tag(runs), runs, places, strict=True):
        open_: list | None = None
        for label, word, (start, stop) in zip(labels, words, spans, strict=True):
            name = LABELS[label]
            if name == "O":
                open_ = None
                continue
            begin, kind = name.split("-")
            lead = len(word) - len(word.lstrip(_EDGE.replace("(", "").replace("[", "")))
            tail = len(word.rstrip(_EDGE)) if word.rstrip(_EDGE) else len(word)
            if begin == "I" and open_ and open_[2] == kind:
                open_[1] = start + tail
            else:
                open_ = [start + min(lead, tail), start + tail, kind]
                out[number].append(open_)
    return [[(a, b, k) for a, b, k in found if b > a] for found in out]


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Words to decode together: around loud words, five words on either side.

    A word three places from a loud one is ``O`` for certain and ends the run; the two
    beyond it complete the neighbourhoods.  Loud words inside the run move its end too:
    it is counted from the last one, once a match lies beyond the end known so far.
    """
    begin = stop = last = -1
    for m in _LOUD.finditer(text):
        if m.start() >= stop:
            if begin >= 0:
                stop = _around(text, last, REACH)
            if m.start() >= stop:
                left = _around(text, m.start(), -REACH)
                if left > stop:
                    if begin >= 0:
                        yield _shifted(text, begin, stop)
                    begin = left
                stop = m.end()
        last = m.end()
    if begin >= 0:
        yield _shifted(text, begin, _around(text, last, REACH))


REACH = 5


def _shifted(text: str, begin: int, stop: int) -> list[tuple[int, int]]:
    return [(begin + a, begin + b) for a, b in _words(text[begin:stop])]


def _around(text: str, at: int, count: int) -> int:
    """Where the ``|count|``-th whole word before or after the word at a place begins or ends."""
    size = 160
    while True:
        if count < 0:
            low = max(0, at - size)
            spans = _words(text[low:at])
            if low == 0 or len(spans) > -count + 1:
                return low + spans[max(len(spans) + count - 1, 0)][0] if spans else at
        else:
            spans = _words(text[at : at + size])
            if at + size >= len(text) or len(spans) > count + 1:
                return at + spans[min(count, len(spans) - 1)][1] if spans else at
        size *= 4


def merged(base: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Base spans and those of the model that touch none of them, by start, then kind."""
    free = [s for s in more if not any(s[0] < b and a < s[1] for a, b, _ in base)]
    return sorted([*base, *free], key=lambda s: (s[0], SPAN_KINDS[s[2]]))


def find_spans(texts: list[str | None], tag: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    whole = [t or "" for t in texts]
    base = [base_spans(t) for t in whole]
    return [(b, merged(b, m)) for b, m in zip(base, model_spans(whole, tag), strict=True)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SPANS = "array<struct<start:int,end:int,kind:string>>"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row; spans are arrays of (start, end, kind)."""
    tag = tagger()

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for at in range(0, len(batch["doc_id"]), 256):
                ids, texts = batch["doc_id"][at : at + 256], batch["text"][at : at + 256]
                for doc, (base, spans) in zip(ids, find_spans(texts, tag), strict=True):
                    rows.append((doc, *[[dict(zip(("start", "end", "kind"), s, strict=True)) for s in x] for x in (base, spans)]))
            yield rows

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id long, base {SPANS}, spans {SPANS}")


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with each span as its kind in brackets; overlapping spans as the first."""
    if not spans or text is None:
        return text
    parts, at = [], 0
    for start, stop, kind in spans:
        if start < at:
            if stop > at:
                at = stop
            continue
        parts += [text[at:start], f"[{kind}]"]
        at = stop
    return "".join([*parts, text[at:]])


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data replaced by its kind in brackets; n_chars, if there, follows."""
    columns = docs.columns
    tag = tagger()
    place = columns.index("text")
    length = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            all_rows = list(zip(*[batch[c] for c in columns], strict=True))
            for at in range(0, len(all_rows), 256):
                some = all_rows[at : at + 256]
                for row, (_, spans) in zip(some, find_spans([r[place] for r in some], tag), strict=True):
                    if spans:
                        text = mask(row[place], spans)
                        row = [*row]
                        row[place] = text
                        if length is not None:
                            row[length] = len(text)
                    rows.append(tuple(row))
            yield rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_rows(docs, run, schema)


def op1_pii(spark, sf_dir) -> DataFrame:
    spans = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return spans.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans")
    )
