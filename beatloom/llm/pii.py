"""Personal data in texts, in the open and in disguise, with exact source offsets.

Base detectors look at the text as it stands. Then finite-state transducers rewrite it step by step:
look-alike characters become ASCII and invisible ones vanish, runs of spelled digits become digits, and
written-out "at" and "dot" become "@" and ".". Each transducer carries, for every character it puts out, the
source characters that it stands for, so that what the detectors find in the last rewriting maps back to a
span of the source. A text on which no transducer fires is done after the base detectors.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from beatloom.llm.tokens import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT = re.compile("[0-9]")
# A match never starts inside a run of digits: the run's start would have matched.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: from each "@" leftwards to the last match, then the domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[Span]:
    """Base matches by kind, then start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        out += [(kind, *s) for kind, find in (("ip", ips), ("card", cards)) for s in find(text)]
        if "+" in text:
            out += [("phone", *s) for s in phones(text)]
    return out


# Letters of other scripts that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "ε": "e", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ᴏ": "o", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍‎‏⁠﻿"


def _plain_forms() -> dict[str, str]:
    """Characters whose compatibility form is one ASCII character, in the blocks used for disguise."""
    blocks = [range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x2070, 0x209D), range(0x2460, 0x2500), range(0x2100, 0x2150), range(0x0660, 0x066A), range(0x06F0, 0x06FA), range(0xFE50, 0xFE70)]
    out = {}
    for block in blocks:
        for ch in map(chr, block):
            plain = unicodedata.normalize("NFKC", ch)
            if plain == ch and (digit := unicodedata.digit(ch, None)) is not None:
                plain = str(digit)
            if len(plain) == 1 and plain.isascii() and plain.isprintable():
                out[ch] = plain
    return out


GLYPHS = _plain_forms() | LOOKALIKES | dict.fromkeys(INVISIBLE, "")
GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]")
GLYPH_SET = frozenset(GLYPHS)

# The ten digits spelled in four languages.
SPELLED = [
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
]
WORD_DIGIT = {w: str(d) for line in SPELLED for d, w in enumerate(line.split())}
FOLDED = str.maketrans("İſ", "is")  # what re.I takes for i and s, and lower() does not
_NUMBER = "(?:" + "|".join(sorted(WORD_DIGIT, key=len, reverse=True)) + ")"
SPELLED_RUN = re.compile(rf"(?<!\w){_NUMBER}(?:[ ,.\-\n]{{1,3}}{_NUMBER}){{2,}}(?!\w)", re.I)
SPELLED_SIGN = re.compile(rf"{_NUMBER}[ ,.\-\n]{{1,3}}{_NUMBER}[ ,.\-\n]{{1,3}}{_NUMBER}", re.I)
SPELLED_WORD = re.compile(_NUMBER, re.I)
PLUS_WORD = re.compile(r"(?<!\w)plus[ \-]{1,3}(?=[0-9])", re.I)

AT_WORDS, DOT_WORDS = "at|arroba", "dot|punkt|punto"
# Endings that make a written-out address credible.
ENDINGS = "com|org|net|edu|gov|info|biz|io|ai|co|eu|de|fr|es|uk|us|ch|at|it|nl|be|pt|mx|ar|ca|au"
BRACKETED = re.compile(rf"[(\[{{<]\s*(?:({AT_WORDS}|@)|({DOT_WORDS}|\.))\s*[)\]}}>]", re.I)
# A written-out dot may stand before any ending of letters.
WRITTEN = re.compile(
    rf"(?<![\w.%+-])[\w.%+-]+(?:\s+(?:{AT_WORDS})\s+|\s*@\s*)(?!(?:the|a|an|this|that|my|your)\b)[\w-]+(?:(?:\s+(?:{DOT_WORDS})\s+|\.)[\w-]+)*(?:\s+(?:{DOT_WORDS})\s+[a-z]{{2,}}|\.(?:{ENDINGS}))(?![\w-])", re.I
)
# Every match of WRITTEN that is not an address as it stands has a written-out dot, "at" and a dot after one word, or "@" beside a space.
WRITTEN_SIGN = re.compile(rf"\s(?:(?:{DOT_WORDS})\s|(?:{AT_WORDS})\s+[\w-]+\.|@)|@\s", re.I)
WRITTEN_PART = re.compile(rf"\s+({AT_WORDS})\s+|\s+({DOT_WORDS})\s+|\s*(@)\s*", re.I)


class Aligned:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Aligned:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Aligned:
        """Replace disjoint ascending spans; every new character stands for the whole span replaced."""
        if not edits:
            return self
        parts: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        return Aligned("".join(parts), starts, ends)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def fold_glyphs(x: Aligned) -> Aligned:
    return x.rewrite([(m.start(), m.end(), GLYPHS[m[0]]) for m in GLYPH.finditer(x.text)])


def spell_out(x: Aligned) -> Aligned:
    """Runs of three and more spelled digits become digits; a lone separator within a run goes as well."""
    edits = []
    for run in SPELLED_RUN.finditer(x.text):
        words = [(m.start(), m.end(), WORD_DIGIT[m[0].translate(FOLDED).lower()]) for m in SPELLED_WORD.finditer(x.text, *run.span())]
        for (a, b, digit), after in zip(words, [*(w[0] for w in words[1:]), run.end()], strict=True):
            edits.append((a, after if after < run.end() else b, digit))
    x = x.rewrite(edits)
    return x.rewrite([(m.start(), m.end(), "+") for m in PLUS_WORD.finditer(x.text)])


def undisguise(x: Aligned) -> Aligned:
    edits, at = [], 0
    for m in BRACKETED.finditer(x.text):
        a, b = m.span()
        while a > at and x.text[a - 1].isspace():
            a -= 1
        while b < len(x.text) and x.text[b].isspace():
            b += 1
        edits.append((a, b, "@" if m[1] else "."))
        at = b
    x = x.rewrite(edits)
    edits = []
    for m in WRITTEN.finditer(x.text):
        edits += [(p.start(), p.end(), "." if p[2] else "@") for p in WRITTEN_PART.finditer(x.text, *m.span())]
    return x.rewrite(edits)


#: A cheap sign that is there whenever the transducer would change the text, and the transducer.
TRANSDUCERS: list[tuple[Callable[[str], bool], Callable[[Aligned], Aligned]]] = [
    (lambda t: not t.isascii() and not GLYPH_SET.isdisjoint(t), fold_glyphs),
    (lambda t: bool(SPELLED_SIGN.search(t) or PLUS_WORD.search(t)), spell_out),
    (lambda t: bool(BRACKETED.search(t) or WRITTEN_SIGN.search(t)), undisguise),
]
BARE_NUMBER = re.compile(r"(?<![\w+.])[0-9](?:[ -]?[0-9])++(?!\w)")


def find_spans(text: str) -> tuple[list[Span], list[tuple[str, int, int, str]]]:
    """Base spans, and all spans with the identifier as read, by kind and start."""
    base = base_spans(text)
    x = Aligned.of(text)
    for fires, transducer in TRANSDUCERS:
        if fires(x.text):
            x = transducer(x)
    found = {s: text[s[1] : s[2]] for s in base}
    if x.text != text:
        for kind, a, b in base_spans(x.text):
            s = (kind, *x.source(a, b))
            if not any(k == kind and c <= s[1] and s[2] <= d for k, c, d in base):
                found[s] = x.text[a:b]
        for m in BARE_NUMBER.finditer(x.text):  # spelled numbers need no plus sign
            a, b = x.source(*m.span())
            if SPELLED_RUN.search(text, a, b) and 9 <= len(_digits(m[0])) <= 15 and not any(c <= a and b <= d for _, c, d in found):
                found["phone", a, b] = m[0]
    order = {kind: i for i, kind in enumerate(KINDS)}
    return base, [(*s, found[s]) for s in sorted(found, key=lambda s: (order[s[0]], s[1], s[2]))]


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans, found.

    ``found`` lists kind, start and end in code points, and the identifier in clear. Null texts are empty;
    null and repeated doc_ids are kept; an empty table gives no rows. Work is linear in a text's length.
    """

    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                rows = [find_spans(t) for t in texts]
                counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in rows], pa.int64()) for kind in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in rows]), pa.array([told(s) for _, s in rows]),
                     pa.array([[dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in spans] for _, spans in rows], kinds)],
                    names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "found"],
                )

    rows = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind string, start long, end long, value string>>")


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b, _ in sorted(find_spans(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same rows and columns with personal data masked and the length, if there is one, brought in line.
    Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            for part, texts in slices(batch, at, 1 << 21):
                known = part.column(at).is_valid().to_pylist()
                masked = [mask(t) if k else None for t, k in zip(texts, known, strict=True)]
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                columns[text] = pa.array(masked, pa.string())
                if n_chars in columns:
                    was = columns[n_chars].to_pylist()
                    columns[n_chars] = pa.array([w if m is None or w is None else len(m) for m, w in zip(masked, was, strict=True)], part.column(part.schema.names.index(n_chars)).type)
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
