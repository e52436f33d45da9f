"""Personal data with offset-preserving deobfuscation.

Two transducers rewrite a text and remember where every rewritten piece came from: one per character (look-alike letters,
foreign digits, invisible characters), one per phrase (spelled digits, "at" and "dot" disguises). The detectors run on the
text and on its rewriting; spans found in the rewriting are mapped back to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame

from claimweave.llm.common import Spans, per_row, spans_text

KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "А": "A", "В": "B", "с": "c", "С": "C", "ԁ": "d", "е": "e", "Е": "E", "һ": "h", "Н": "H", "і": "i", "І": "I", "ј": "j",
    "Ј": "J", "К": "K", "к": "k", "ӏ": "l", "М": "M", "о": "o", "О": "O", "р": "p", "Р": "P", "ԛ": "q", "ѕ": "s", "Ѕ": "S", "Т": "T",
    "у": "y", "У": "Y", "х": "x", "Х": "X", "ԝ": "w", "α": "a", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "ι": "i", "Ι": "I", "Κ": "K",
    "κ": "k", "Μ": "M", "Ν": "N", "ν": "v", "ο": "o", "Ο": "O", "ρ": "p", "Ρ": "P", "Τ": "T", "υ": "u", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "ı": "i", "ɡ": "g", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
INVISIBLE = ("\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "\u00ad")  # fixed values: characters without a width
# Digit names in the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_PLUS = r"(?:\bplus[\s,-]{1,3})?"
SPELLED = re.compile(rf"{_PLUS}\b{_DIGIT}\b(?:[\s,.-]{{1,3}}{_DIGIT}\b){{3,}}", re.IGNORECASE)
SPELLED_PART = re.compile(rf"plus|{_DIGIT}", re.IGNORECASE)
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
_SPELLED_AHEAD = rf"(?=[\w-]+\s?{OPEN}?\s?dot\s?{CLOSE}?\s?\w)"
# Each alternative is one way to write the sign: in brackets, as a reference, joined by underscores or hyphens, in capitals
# inside a word, spaced out, and as a bare word before what reads like a domain.
AT = "|".join([
    rf"\s?{OPEN}\s?(?:at|@|arroba)\s?{CLOSE}\s?", r"&#64;|&#x40;|&commat;", r"\s?_at_\s?", r"(?<=\w)-at-(?=[\w-]+-dot-\w)",
    r"(?<=\w)(?-i:AT)(?=(?-i:[a-z0-9-])+(?-i:DOT)\w)", r"(?<=[\w.%+-])\s@\s(?=\w)", rf"(?<=[\w.%+-])\sat\s{_SPELLED_AHEAD}",
])
#: The bare word before a name with plain dots is mostly prose ("look at github.com"): ``reads_as_sign`` decides.
BARE_AT = r"(?<=[\w.%+-])\sat\s(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@]))"
DOT = "|".join([
    rf"(?<=[\w-])\s?{OPEN}\s?(?:dot|\.|point|punkt|punto)\s?{CLOSE}\s?(?=\w)", r"(?<=\w)(?:&#46;|&#x2e;|&period;)(?=\w)", r"(?<=\w)(?:_dot_|-dot-|\sdot\s)(?=\w)",
    r"(?<=(?-i:[a-z0-9]))(?-i:DOT)(?=(?-i:[a-z0-9]))",
])
PHRASES = re.compile(f"(?P<spelled>{SPELLED.pattern})|(?P<at>{AT})|(?P<bare>{BARE_AT})|(?P<dot>{DOT})", re.IGNORECASE)
#: What may follow a bare "at", searched from the letters so that other text costs little.
SPACED_AT = re.compile(r"at(?<=\sat)\s(?=[\w-]+(?:\.[\w-]|\s?[\[({<]?\s?dot))", re.IGNORECASE)
LOCAL_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: Words after which a name before "at" is an address, with small words in between; and words that are no such name.
CUE = re.compile(r"\b(?:e-?mails?|mails?|contact|write|reach|courriel|correo|kontakt|adresse|address)(?:[\s:,;(<\"'-]+(?:me|us|him|her|them|to|is|address|directly|an|à|a|ist|es))*[\s:,;(<\"'-]+\Z", re.IGNORECASE)
NO_NAMES = frozenset("a all an and are available be been both call directly found for from hosted here him her here's is it just live look me now on online only or out read see served stay them there this times to today us visit was we were you".split())
BRACKETED = re.compile(rf"{OPEN}\s?(?:at|@|arroba|dot|\.|point|punkt|punto)\s?{CLOSE}", re.IGNORECASE)
MISLEADING = re.compile("|".join([f"[{''.join(map(re.escape, LOOKALIKES))}{''.join(INVISIBLE)}]", r"[٠-٩۰-۹०-९]", r"[！-～\U0001d400-\U0001d7ff①-⑳²³¹⁰-⁹₀-₉]"]))


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Spans:
    """Leftmost matches of local part, @, domain; found from the @ so that long runs of local characters cost nothing."""
    found: Spans = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end(), "email"))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> Spans:
    """Four dotted numbers at a time along each dotted chain, kept if each is at most 255."""
    found: Spans = []
    for chain in DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        at, parts = chain.start(), chain.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                found.append((at, end, "ip"))
            at = end + 1
    return found


def identifiers(text: str) -> Spans:
    """Spans of the four kinds in the text as it stands."""
    found = emails(text) + addresses(text)
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return found


class Rewriting:
    """A rewritten text with, for each piece, the source characters it stands for."""

    def __init__(self, source: str) -> None:
        self.source, self.parts, self.at, self.size = source, [], 0, 0
        self.new: list[int] = []  # piece starts in the rewriting
        self.old: list[tuple[int, int, bool]] = []  # source start and end, and whether the piece is unchanged

    def _add(self, piece: str, start: int, end: int, same: bool) -> None:
        if piece:
            self.new.append(self.size)
            self.old.append((start, end, same))
            self.parts.append(piece)
            self.size += len(piece)

    def replace(self, start: int, end: int, piece: str) -> None:
        """``source[start:end]`` becomes ``piece``; what lies before stays."""
        if start > self.at:
            self._add(self.source[self.at : start], self.at, start, True)
        self._add(piece, start, end, False)
        self.at = end

    def text(self) -> str:
        if self.at < len(self.source):
            self._add(self.source[self.at :], self.at, len(self.source), True)
            self.at = len(self.source)
        return "".join(self.parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source span of ``[start, end)`` of the rewriting; a changed piece counts whole."""
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        (a, _, same_a), (b, b_end, same_b) = self.old[i], self.old[j]
        return (a + start - self.new[i] if same_a else a), (b + end - self.new[j] if same_b else b_end)


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    return unicodedata.normalize("NFKC", c) if unicodedata.decimal(c, None) is None else str(unicodedata.decimal(c))


def plain_characters(text: str) -> Rewriting:
    out = Rewriting(text)
    for m in MISLEADING.finditer(text):
        out.replace(m.start(), m.end(), _plain(m.group()))
    return out


def reads_as_sign(text: str, start: int) -> bool:
    """Whether a bare "at" at ``start`` before a plain domain stands for the sign: the word before it has the form of an
    address (letters with a digit, dot or underscore) or follows a word such as mail, contact or write to."""
    local = LOCAL_BEFORE.search(text, max(0, start - 64), start)
    if not local or local.group().lower() in NO_NAMES:
        return False
    name = local.group()
    if any(c in "0123456789._" for c in name[1:-1]) and any(c.isalpha() for c in name):
        return True
    return CUE.search(text[max(0, local.start() - 60) : local.start()]) is not None


def plain_phrases(text: str) -> Rewriting:
    out = Rewriting(text)
    for m in PHRASES.finditer(text):
        if m.lastgroup == "at" or m.lastgroup == "bare" and reads_as_sign(text, m.start()):
            out.replace(m.start(), m.end(), "@")
        elif m.lastgroup == "bare":
            continue
        elif m.lastgroup == "dot":
            out.replace(m.start(), m.end(), ".")
        else:
            place = m.start()
            for word in SPELLED_PART.finditer(text, m.start(), m.end()):
                out.replace(place, word.start(), "")
                out.replace(word.start(), word.end(), DIGIT_WORDS.get(word.group().lower(), "+"))
                place = word.end()
    return out


def may_be_disguised(text: str) -> bool:
    """Whether the phrase transducer could change anything; cheap tests that every disguise passes."""
    low = text.lower()
    if "dot" in low or "_at_" in low or "&#" in low or "&commat;" in low or "&period;" in low or "@" in low and re.search(r"\s@\s", low) or BRACKETED.search(low) or SPACED_AT.search(low):
        return True
    if "ſ" in text or "İ" in text:  # letters that match s and i without case and are not lowered to them
        return SPELLED.search(text) is not None
    words = low.replace("-", " ").replace(",", " ").replace(".", " ").split()
    return not DIGIT_WORDS.keys().isdisjoint(words) and SPELLED.search(text) is not None


def scan_text(text: str) -> tuple[Spans, Spans]:
    """(base spans, all spans). A span of the rewriting that a base span of its kind already contains is not repeated."""
    base = identifiers(text)
    first = plain_characters(text) if not text.isascii() and MISLEADING.search(text) else None
    middle = first.text() if first else text
    second = plain_phrases(middle) if may_be_disguised(middle) else None
    if first is None and second is None:
        return base, base
    added: set[tuple[int, int, str]] = set()
    for start, end, kind in identifiers(second.text() if second else middle):
        if second:
            start, end = second.back(start, end)
        if first:
            start, end = first.back(start, end)
        if not any(k == kind and a <= start and end <= b for a, b, k in base):
            added.add((start, end, kind))
    return base, base + sorted(added)


def masked(text: str, spans: Spans) -> str:
    """The text with every span replaced by its kind in brackets; touching or overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS[s[2]], s[1])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_personal(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Personal data of every row: ``keys``, counts of the base spans by kind, base spans, all spans, the text with spans masked.

    A null text is an empty one. Repeated rows are scanned each for itself, other columns are not kept, an empty table
    gives no rows, and texts are scanned whole. Spans are in code points of the source text.
    """

    def scan(value: str) -> tuple:
        base, every = scan_text(value)
        counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
        return (*counts, spans_text(base, KINDS), spans_text(every, KINDS), masked(value, every) if every else value)

    return per_row(df, text, list(keys), scan, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, spans string, masked string")
