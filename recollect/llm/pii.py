"""Personal data by offset-preserving deobfuscation.

The plain shapes of e-mail and IP addresses, card and phone numbers are found
in the text as it stands. Then a transducer rewrites disguises: lookalike
letters, wide or styled characters and invisible ones, "at" and "dot" in
brackets or spelled between words, and runs of spelled digits. It keeps, for
every character that it writes, the span of source characters it came from.
The same detectors run on what it wrote, and a find that needed a rewritten
character is mapped back to its source span.

Only texts that could hold something are looked at character by character; the
bytes and word hashes of a whole column tell which.

Cases: null and empty texts have no spans; spans are code points, the end
exclusive; finds that overlap a plain one of their kind are dropped; time is
linear in the text, also for very long runs of digits or address characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from recollect.llm import tokens
from recollect.llm.common import annotate, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that starts no address has none starting further right in it either
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(x) for x in digits[::-2]) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(x for x in s if "0" <= x <= "9")


def find(text: str) -> list[Span]:
    """Plain finds, leftmost and non-overlapping per kind."""
    out = [("email", *m) for m in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Lookalikes of Latin letters and of signs, and digits' names in four languages.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝкмтвнпАВЕКМНОРСТУХІЈЅαορνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧıℓ", "aeopcyxijsdhqwkmtbhnABEKMHOPCTYXIJSaopviktuABEZHIKMNOPTYXil", strict=True))
LOOKALIKES |= {"․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
INVISIBLE = frozenset("­​‌‍⁠﻿")
DIGIT_NAMES = {
    name: str(value)
    for names in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for value, name in enumerate(names.split())
} | {"oh": "0", "zwo": "2"}
#: Words are counted with A-Z lowered only.
_LOUD_NAMES = ["".join(c if c < "\u0080" else c.upper() for c in name) for name in DIGIT_NAMES if not name.isascii()]
DOTS = "dot|punto|punkt|point|period"
ATS = "at|arroba|arobase"
#: Spelled digits in a row that count as a number and not as prose.
SPELLED_RUN = 4

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKET_AT = re.compile(rf"\s*{_OPEN}\s*(?:{ATS}|@)\s*{_CLOSE}\s*", re.I)
_BRACKET_DOT = re.compile(rf"\s*{_OPEN}\s*(?:{DOTS}|\.)\s*{_CLOSE}\s*", re.I)
# between bare words "point" and "period" are prose, and so is "at" before an article
_BARE_DOT = r"(?:\s+(?:dot|punto|punkt)\s+|[_-](?:dot|punto|punkt)[_-])"
_SPELLED_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:\s+(?:{ATS}|@)\s+|[_-](?:{ATS})[_-])(?!(?:the|an?|this|that|my|our|your|his|her|their)\b)(?=[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*(?:(?:{_BARE_DOT}|\.)[A-Za-z0-9]+)*{_BARE_DOT}[A-Za-z]{{2,}})", re.I)
_SPELLED_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_BARE_DOT}(?=[A-Za-z]{{2,}}|[0-9])", re.I)
_DIGIT_DOT = re.compile(rf"(?<=[0-9])\s+(?:{DOTS})\s+(?=[0-9])", re.I)
_NAME = "|".join(sorted(DIGIT_NAMES, key=len, reverse=True))
_SPELLED_NUMBER = re.compile(rf"(?<!\w)(?:plus\s+)?(?:{_NAME}|[0-9])(?:[\s,-]+(?:(?:{DOTS})[\s,-]+)?(?:{_NAME}|[0-9]))+(?!\w)", re.I)
_PIECE = re.compile(rf"({_NAME}|[0-9])|(plus)|({DOTS})|([\s,-]+)", re.I)


class Tape:
    """A text and, for each of its characters, its source span and whether it was rewritten."""

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None, changed: bytearray | None = None):
        self.text = text
        self.starts = array("i", range(len(text))) if starts is None else starts
        self.ends = array("i", range(1, len(text) + 1)) if ends is None else ends
        self.changed = bytearray(len(text)) if changed is None else changed

    def edited(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Tape:
        """``edits``: (start, end, what to write for it: characters with the places they stand for), in order."""
        if not edits:
            return self
        text, starts, ends, changed, at = [], array("i"), array("i"), bytearray(), 0
        for start, end, written in [*edits, (len(self.text), len(self.text), [])]:
            text.append(self.text[at:start])
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            changed += self.changed[at:start]
            for c, i, j in written:
                text.append(c)
                starts.append(self.starts[i])
                ends.append(self.ends[j - 1])
                changed.append(1)
            at = end
        return Tape("".join(text), starts, ends, changed)


def _plain(c: str) -> str | None:
    if c < "\u0080":
        return None
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.decomposition(c).split(" ")[0]
    if kind in ("<wide>", "<font>", "<narrow>", "<circle>"):
        n = unicodedata.normalize("NFKC", c)
        return n if len(n) == 1 and n < "\u0080" else None
    d = unicodedata.decimal(c, None)
    return None if d is None else str(d)


def characters(tape: Tape) -> Tape:
    return tape.edited([(i, i + 1, [(p, i, i + 1)] if p else []) for i, c in enumerate(tape.text) if c >= "\u0080" and (p := _plain(c)) is not None])


def _signs(tape: Tape, pattern: re.Pattern, sign: str) -> Tape:
    return tape.edited([(m.start(), m.end(), [(sign, m.start(), m.end())]) for m in pattern.finditer(tape.text)])


def _number(m: re.Match) -> list[tuple[str, int, int]] | None:
    out, names = [], 0
    for p in _PIECE.finditer(m.string, m.start(), m.end()):
        if p[1]:
            value = DIGIT_NAMES.get(p[1].lower(), p[1])
            names += value != p[1]
            out.append((value, p.start(), p.end()))
        elif p[2]:
            out.append(("+", p.start(), p.end()))
        elif p[3]:
            out.append((".", p.start(), p.end()))
    return out if names >= SPELLED_RUN else None


def spelled_numbers(tape: Tape) -> Tape:
    return tape.edited([(m.start(), m.end(), w) for m in _SPELLED_NUMBER.finditer(tape.text) if (w := _number(m))])


def addresses(tape: Tape) -> Tape:
    tape = _signs(tape, _BRACKET_AT, "@")
    tape = _signs(tape, _BRACKET_DOT, ".")
    tape = _signs(tape, _SPELLED_AT, "@")
    tape = _signs(tape, _DIGIT_DOT, ".")
    return _signs(tape, _SPELLED_DOT, ".") if "@" in tape.text else tape


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Finds that only the rewritten text shows, as source spans. Those of a kind come in order, in the text as in ``plain``: one sweep finds overlaps."""
    tape = addresses(spelled_numbers(characters(Tape(text))))
    out: list[Span] = []
    own = {kind: [s for s in plain if s[0] == kind] for kind in KINDS}
    at, last = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
    for kind, i, j in find(tape.text):
        if not any(tape.changed[i:j]):
            continue
        start, end = tape.starts[i], tape.ends[j - 1]
        spans = own[kind]
        while at[kind] < len(spans) and spans[at[kind]][2] <= start:
            at[kind] += 1
        if start >= last[kind] and (at[kind] == len(spans) or spans[at[kind]][1] >= end):
            out.append((kind, start, end))
            last[kind] = end
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [*((f"n_{k}", T.LongType()) for k in KINDS), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("found", _SPANS)]


def _word_set(words: list[str]) -> np.ndarray:
    return np.unique(tokens.tokenise(pa.array(words), tokens.ALNUM_WORDS).hashes)


def suspects(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which texts may hold plain finds, and which disguised ones."""
    data, at = tokens.text_bytes(column)
    per_text = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[at])
    digits = per_text((data >= 48) & (data <= 57))
    plain = (per_text(data == 64) > 0) | (digits >= 4)
    # lead bytes of all characters that _plain rewrites: of other scripts and their digits, of punctuation and of styled characters; soft hyphen and no-break space follow 0xC2
    strange = (data >= 0xCD) & (data <= 0xD4) | (data == 0xE2) | (data == 0xEF) | (data == 0xF0) | (data == 0xC2) | (data == 0xC4) | (data == 0xE3) | ((data >= 0xD9) & (data <= 0xDB)) | (data == 0xE0) | (data == 0xDF) | (data == 0xE1) | (data == 0xEA)
    t = tokens.tokenise(column, tokens.ALNUM_WORDS)
    of_words = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[t.first])
    dots = of_words(np.isin(t.hashes, _word_set(DOTS.split("|"))))
    ats = of_words(np.isin(t.hashes, _word_set(ATS.split("|"))))
    names = of_words(np.isin(t.hashes, _word_set([*DIGIT_NAMES, *_LOUD_NAMES])))
    signs = per_text(data == 64)
    brackets = per_text((data == 91) | (data == 40) | (data == 123) | (data == 60))
    return plain, (per_text(strange) > 0) | (names >= SPELLED_RUN) | ((dots > 0) & (ats + signs > 0)) | ((dots >= 3) & (digits >= 4)) | ((ats > 0) & (brackets > 0)) | ((signs > 0) & (brackets > 0))


def redactable(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with counts per kind, base_sha256, spans (as text) and found (as structs)."""
    empty = hashlib.sha256(b"").hexdigest()

    def make():
        def run(batch: pa.RecordBatch) -> list:
            column = batch.column(text_col)
            n = batch.num_rows
            counts = np.zeros((n, 4), np.int64)
            sha, text, found = [empty] * n, [""] * n, [[] for _ in range(n)]
            plain, odd = suspects(column)
            for i in np.flatnonzero(plain | odd):
                source = column[int(i)].as_py()
                base = find(source) if plain[i] else []
                spans = ordered([*base, *disguised(source, base)]) if odd[i] else base
                if spans:
                    counts[i] = [sum(k == s[0] for s in spans) for k in KINDS]
                    sha[i], text[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)
                    found[i] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            return [*counts.T, sha, text, found]

        return run

    return annotate(docs, text_col, FIELDS, make, keep)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redactable(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("found")
