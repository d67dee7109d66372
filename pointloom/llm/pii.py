"""Operator 3: personal data with offset-preserving deobfuscation.

Base spans are what the plain patterns find, leftmost and without overlap per kind, each in
time linear in the text. A second pass runs over texts that hold any disguise: transducers
rewrite homoglyphs and invisible characters, bracketed or spelled "at" and "dot", and runs of
spelled digits, and note for every output character the source characters it came from. The
same detectors run on the rewritten text; a match that contains rewritten characters is mapped
back to code points of the source and added. Base spans always stay. A long text is rewritten piece by
piece, cut where nothing can go across, so memory does not grow with it.

Null texts count as empty. Repeated rows are reported once each, and other columns are not read. n_* count base spans, n_added the others; spans holds both. Spans
of one start are ordered by kind (email, ip, card, phone).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.common import arrow_map
from pointloom.session import table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Letters and signs of other scripts that look like ASCII, and their ASCII forms.
_LOOKALIKES = dict(zip("аеорсухівԁһјӏԛѕԝАВЕКМНОРСТХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxibdhjlqswABEKMHOPCTXIJSaopvikABEZHIKMNOPTYX"))
_LOOKALIKES |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | {"﹫": "@", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " "}
_LOOKALIKES |= {"\u3000": " "} | {chr(0x1D7CE + k): str(k % 10) for k in range(50)}
_LOOKALIKES |= {chr(0x0660 + k): str(k) for k in range(10)} | {chr(0x06F0 + k): str(k) for k in range(10)}
_INVISIBLE = "­​‌‍⁠﻿"
# Digits as words, in English, German, French and Spanish.
_SPELLED = {
    "0": "zero oh null zéro cero",
    "1": "one eins un uno",
    "2": "two zwei deux dos",
    "3": "three drei trois tres",
    "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco",
    "6": "six sechs seis",
    "7": "seven sieben sept siete",
    "8": "eight acht huit ocho",
    "9": "nine neun neuf nueve",
}
_DIGIT_OF = {word: digit for digit, words in _SPELLED.items() for word in words.split()}
_WORDS = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_SIGNS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-"}
_NUMBER = rf"(?:{_WORDS}|[0-9])"
_RUN = re.compile(rf"(?:\bplus[ ]+)?\b{_NUMBER}\b(?:[ ,-]{{1,3}}(?:(?:dot|point|punkt|punto|dash|hyphen)[ ]+)?{_NUMBER}\b){{3,}}", re.I)
_TOKEN = re.compile(r"[^\W_]+")
_AT = r"(?:at|arroba|@)"
_DOT = r"(?:dot|punkt|point|punto|\.)"
_BRACKET_AT = re.compile(rf"\s{{0,2}}(?:\[\s?{_AT}\s?\]|\(\s?{_AT}\s?\)|\{{\s?{_AT}\s?\}}|<\s?{_AT}\s?>)\s{{0,2}}", re.I)
_BRACKET_DOT = re.compile(rf"\s{{0,2}}(?:\[\s?{_DOT}\s?\]|\(\s?{_DOT}\s?\)|\{{\s?{_DOT}\s?\}}|<\s?{_DOT}\s?>)\s{{0,2}}", re.I)
# Last labels that make a spelled-out address plausible.
_LAST = "com|org|net|edu|gov|info|biz|io|co|me|eu|us|uk|ca|de|fr|es|it|nl|ch|at|be|pt|mx|br|ar|au|in|jp|cn|ru|pl|se|no|dk|fi|ie|nz|za|kr|dev|app|ai|tech|cloud|online|site|store|shop|blog|xyz|mail|email|example|test"
_BARE = re.compile(rf"(?<![\w.%+-])[A-Za-z0-9._%+-]++(?: at | arroba |@)[A-Za-z0-9-]++(?:(?: (?:dot|punkt|punto) |\.)(?!(?:{_LAST})\b)[A-Za-z0-9-]++)*+(?:(?: (?:dot|punkt|punto) |\.)(?:{_LAST})\b)+", re.I)
_BARE_SIGN = re.compile(r" (at|arroba|dot|punkt|punto) ", re.I)
# What _BARE needs besides spelled dots and "arroba": it is sought from each " at ", so it is cheap.
_AT_NAME = re.compile(rf" at (?:[A-Za-z0-9-]+\.)+(?:{_LAST})\b", re.I)
_BARE_SIGN_OR_POINT = re.compile(r" (?:dot|point|punkt|punto) ", re.I)
_UNDER_SIGN = re.compile("_at_|_dot_", re.I)
_BRACKETED = re.compile(r"[\[({<]\s?(?:at|arroba|dot|punkt|point|punto|[.@])\s?[\])}>]", re.I)
_ODD = re.compile("[" + "".join(map(re.escape, sorted({*_LOOKALIKES, *_INVISIBLE}))) + "]")
# Numbers set apart by spelled dots, and addresses spelled with underscores.
_DOTTED = re.compile(r"(?<![\w.])[0-9]{1,3}(?: (?:dot|point|punkt|punto) [0-9]{1,3}){3}(?![\w.])", re.I)
_UNDER = re.compile(r"(?<![\w.%+-])[A-Za-z0-9.%+-]++(?:_(?!at_)[A-Za-z0-9.%+-]++)*+_at_[A-Za-z0-9-]++(?:_dot_[A-Za-z0-9-]++)++(?![\w-])", re.I)
#: Characters after which a long text is cut before it is rewritten, at the next space or newline between words of eight letters
#: or more: no disguise and no identifier goes over such a one, as no word that stands for a sign or digit is that long.
PIECE = 1 << 16
_GAP = re.compile(r"(?<=[^\W\d_]{8})[ \n](?=[^\W\d_]{8})")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of all plain matches, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


class Rewritten:
    """A text with, for each character, the source span it came from and whether it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.new = [False] * len(text)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ordered, separate spans of the present text; each new character stands for the whole span."""
        text, start, end, new, at = [], [], [], [], 0
        for a, b, put in edits:
            text += [self.text[at:a], put]
            start += self.start[at:a] + [self.start[a]] * len(put)
            end += self.end[at:a] + [self.end[b - 1]] * len(put)
            new += self.new[at:a] + [True] * len(put)
            if not put and new:
                new[-1] = True
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end, self.new = start + self.start[at:], end + self.end[at:], new + self.new[at:]


def with_spelled_dots(text: str, start: int, floor: int) -> int:
    """Where the local part that is known from `start` on begins, if spelled dots and words before it belong to it."""
    while True:
        sign = next((x for x in (" dot ", " punkt ", " punto ") if text[max(start - len(x), floor) : start].lower() == x), None)
        if not sign:
            return start
        at = end = start - len(sign)
        while at > floor and text[at - 1] in _LOCAL:
            at -= 1
        if at == end or at > floor and (text[at - 1].isalnum() or text[at - 1] == "_"):
            return start
        start = at


def normalise(text: str) -> Rewritten:
    """The transducers, one after another."""
    out = Rewritten(text)
    out.replace([(m.start(), m.end(), _LOOKALIKES.get(m.group(), "")) for m in _ODD.finditer(out.text)])
    for pattern, sign in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
        out.replace([(m.start(), m.end(), sign) for m in pattern.finditer(out.text)])
    out.replace([(m.start() + w.start(), m.start() + w.end(), ".") for m in _DOTTED.finditer(out.text) for w in _BARE_SIGN_OR_POINT.finditer(m.group())])
    out.replace([(m.start() + w.start(), m.start() + w.end(), "@" if w.group().lower() == "_at_" else ".") for m in _UNDER.finditer(out.text) for w in _UNDER_SIGN.finditer(m.group())])
    bare, floor = [], 0
    for m in _BARE.finditer(out.text):
        at = with_spelled_dots(out.text, m.start(), floor)
        bare.append((at, out.text[at : m.end()]))
        floor = m.end()
    out.replace([(at + m.start(), at + m.end(), "@" if m[1].lower() in ("at", "arroba") else ".") for at, whole in bare for m in _BARE_SIGN.finditer(whole)])
    edits: list[tuple[int, int, str]] = []
    for m in _RUN.finditer(out.text):
        if not any(c.isalpha() for c in m.group()):
            continue
        at = m.start()
        for w in _TOKEN.finditer(m.group()):
            a, b, word = at + w.start(), at + w.end(), w.group().lower()
            put = _DIGIT_OF.get(word) or _SIGNS.get(word) or word
            edits.append((edits[-1][1] if edits and edits[-1][1] > at else a, b, put))
    out.replace(edits)
    return out


def disguised(text: str) -> bool:
    """Whether any transducer could change the text; each test holds wherever its transducer finds something."""
    if not text.isascii() and _ODD.search(text):
        return True
    if _BRACKETED.search(text):
        return True
    low = text.lower()
    if "_at_" in low and "_dot_" in low or " point " in low and _DOTTED.search(text):
        return True
    if any(x in low for x in (" dot ", " punkt ", " punto ", " arroba ")) or " at " in low and _AT_NAME.search(text):
        return True
    return any(any(c.isalpha() for c in m.group()) for m in _RUN.finditer(text))


def cuts(text: str, piece: int) -> Iterator[tuple[int, int]]:
    """Parts of a text that can be rewritten apart."""
    begin = 0
    while len(text) - begin > 2 * piece and (m := _GAP.search(text, begin + piece)):
        yield begin, m.start()
        begin = m.start()
    yield begin, len(text)


def added(text: str, base: list[tuple[int, int, int]], piece: int = PIECE) -> list[tuple[int, int, int]]:
    """Spans that only the rewritten text shows, at their place in the source."""
    known, out = set(base), set()
    for begin, end in cuts(text, piece):
        part = text[begin:end]
        if not disguised(part):
            continue
        own = normalise(part)
        for a, kind, b in detect(own.text):
            if any(own.new[a:b]):
                while a < b - 1 and own.text[a] == " ":
                    a += 1
                span = (begin + own.start[a], kind, begin + own.end[b - 1])
                if span not in known:
                    out.add(span)
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans, more = [[], [], [], []], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = detect(text)
                extra = added(text, base)
                for kind in range(4):
                    counts[kind].append(sum(x[1] == kind for x in base))
                digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + extra))
                more.append(len(extra))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())],
                names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df, [id_col, text_col], run, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
