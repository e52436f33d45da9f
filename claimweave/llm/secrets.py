"""Secret scan: fixed patterns, and values in credential contexts that would be costly to guess.

The guess cost of a value is the minimum, over all ways to cut it into segments, of the summed log10 guesses of the
segments: known words, dates, repeats, keyboard walks, and brute-force spans. The dynamic program runs left to right over
end positions and is linear in the length of the value: every position has at most a fixed number of shorter segments
ending there, one maximal repeat or walk, and one brute-force step.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import Spans, per_row, spans_text

KINDS = {"assign": 0, "access": 1, "hex": 2, "guess": 3}

# The base patterns. ASCII letters only count as equal in either case.
ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is found whole; a shorter run fails at each of its places

# A wider context than the base pattern: other names, arrows, and quoted values with any characters.
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|"
    r"client[ _-]?id|auth(?:orization)?|bearer)[\"']?[ \t]{0,8}(?::=|=>|[:=])[ \t]{0,8}"
    r"(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|([^\s\"'`,;<>(){}\[\]]+))",
    re.IGNORECASE | re.ASCII,
)

CUES = ("pass", "pwd", "secret", "token", "api", "access", "private", "credential", "client", "auth", "bearer")  # each match holds one

# Passwords and words so common that an attacker tries them first, most common first.
COMMON_WORDS = (
    "password", "admin", "welcome", "login", "letmein", "dragon", "monkey", "master", "secret", "hello", "freedom", "whatever",
    "sunshine", "princess", "football", "baseball", "shadow", "superman", "batman", "trustno", "iloveyou", "starwars", "access",
    "flower", "hottie", "loveme", "passw0rd", "root", "user", "test", "guest", "default", "changeme", "example", "sample", "demo",
    "temp", "pass", "word", "key", "token", "api", "abc", "love", "money", "summer", "winter", "spring", "autumn", "monday",
    "friday", "sunday", "january", "june", "july", "august", "october", "london", "paris", "berlin", "madrid", "orange", "apple",
    "google", "computer", "internet", "server", "system", "office", "company", "family", "michael", "jennifer", "thomas", "jordan",
    "hunter", "killer", "soccer", "hockey", "ranger", "daniel", "robert", "charlie", "andrew", "george", "pepper", "ginger",
    "cookie", "cheese", "banana", "purple", "silver", "golden", "diamond", "tiger", "eagle", "horse", "battery", "staple",
    "correct", "the", "and", "you", "for", "not", "this", "that", "with", "your", "none", "null", "true", "false", "todo",
)
DEFAULT_WORDS = {w: rank for rank, w in enumerate(COMMON_WORDS, 1)}
LEET = str.maketrans("01345@$7!", "oleasasti")  # fixed values: usual letter substitutes
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")  # fixed values: keyboard rows, each half a key further right
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"
    r"|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d|(?:19|20)\d\d"
)
SEGMENT = math.log10(2)  # what every further segment adds: the attacker must also guess the cut
BRUTE = 1.0  # log10 guesses of a character without structure


def _neighbours() -> dict[str, str]:
    near: dict[str, set[str]] = {}
    at = {c: (x + y / 2, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    for c, (x, y) in at.items():
        near[c] = {d for d, (u, v) in at.items() if d != c and abs(v - y) <= 1 and abs(u - x) <= 1}
    return {c: "".join(sorted(n)) for c, n in near.items()}


NEAR = _neighbours()


def _word_cost(value: str, rank: int, plain: str) -> float:
    cost = math.log10(rank)
    if any(c.isupper() for c in value):
        cost += SEGMENT if value[:1].isupper() and not any(c.isupper() for c in value[1:]) else 2 * SEGMENT
    return cost + (SEGMENT if value.lower() != plain else 0.0)


_LONGEST: dict[int, tuple[Mapping[str, int], int]] = {}


def longest_word(words: Mapping[str, int]) -> int:
    """The length of the longest word, looked up once per dictionary."""
    held = _LONGEST.get(id(words))
    if held is None or held[0] is not words:
        _LONGEST.clear()
        held = _LONGEST[id(words)] = (words, max(map(len, words), default=0))
    return held[1]


def segments(value: str, words: Mapping[str, int], max_period: int) -> list[list[tuple[int, float]]]:
    """For every start in ``value`` the (end, log10 guesses) of the words, dates, walks, sequences and repeats from there."""
    n = len(value)
    lower = value.lower()
    plain = lower.translate(LEET)
    if len(plain) != n:  # lower-casing changed the length: compare letter by letter
        lower = plain = value
    longest = longest_word(words)
    starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]  # by start: (end, cost)
    for i in range(n):
        for size in range(2, min(longest, n - i) + 1):
            for form in {lower[i : i + size], plain[i : i + size]}:
                if (rank := words.get(form)) is not None:
                    starts[i].append((i + size, _word_cost(value[i : i + size], rank, form)))
        if value[i] in "0123456789" and (m := DATE.match(value, i)):
            starts[i].append((m.end(), math.log10(100 if m.end() - i == 4 else 36_500)))
    i = 0
    while i < n - 1:  # maximal walks over neighbouring keys
        j, turns, last = i + 1, 0, None
        while j < n and lower[j] in NEAR.get(lower[j - 1], ""):
            move = NEAR[lower[j - 1]].index(lower[j])
            turns, last = turns + (move != last), move
            j += 1
        if j - i >= 3:
            starts[i].append((j, math.log10(len(NEAR)) + math.log10(j - i) + turns * math.log10(4)))
        i = j
    i = 0
    while i < n - 1:  # maximal runs of character codes one apart
        j, step = i + 1, ord(value[i + 1]) - ord(value[i])
        while j < n and abs(step) == 1 and ord(value[j]) - ord(value[j - 1]) == step:
            j += 1
        if j - i >= 3:
            starts[i].append((j, math.log10(10) + math.log10(j - i)))
        i = max(i + 1, j - 1)
    for period in range(1, min(max_period, n // 2) + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and value[j] == value[j + period]:
                j += 1
            times = (j - i) // period + 1
            if times >= 2 and times * period >= 3:
                block = value[i : i + period]
                base = BRUTE * period if period == 1 else guess_cost(block, words, 0)
                starts[i].append((i + times * period, base + math.log10(times)))
            i = j + 1
    return starts


def guess_cost(value: str, words: Mapping[str, int] = DEFAULT_WORDS, max_period: int = 16) -> float:
    """log10 of the guesses needed for ``value`` at its cheapest segmentation; an empty value costs 0.

    ``words`` maps a lower-case word to its rank. ``max_period`` bounds the block length of a repeat; a longer block is
    priced by its other segments.
    """
    n = len(value)
    if n == 0:
        return 0.0
    starts = segments(value, words, max_period)
    best = [math.inf] * (n + 1)  # cheapest cut of the first k characters
    brute = [math.inf] * (n + 1)  # the same with a brute-force span still open
    best[0] = 0.0
    for k in range(n):
        for end, cost in starts[k]:
            best[end] = min(best[end], best[k] + cost + SEGMENT)
        brute[k + 1] = min(brute[k], best[k] + SEGMENT) + BRUTE
        best[k + 1] = min(best[k + 1], brute[k + 1])
    return best[n] - SEGMENT


def scan_text(text: str, words: Mapping[str, int] = DEFAULT_WORDS, least_cost: float = 10.0, least_length: int = 8) -> tuple[Spans, Spans, float]:
    """(base spans, all spans, highest guess cost among credential values) of one text.

    Added spans are values in a credential context that need at least ``10 ** least_cost`` guesses, have at least
    ``least_length`` characters and lie outside every base span.
    """
    low = text.lower()
    named = any(cue in low for cue in CUES)
    base: Spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if named else []
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    added: Spans = []
    highest = 0.0
    for m in CONTEXT.finditer(text) if named else ():
        start, end = m.span(m.lastindex)
        cost = guess_cost(text[start:end], words)
        highest = max(highest, cost)
        if cost >= least_cost and end - start >= least_length and not any(a < end and start < b for a, b, _ in base):
            added.append((start, end, "guess"))
    return base, base + added, highest


WORD = re.compile(r"(?<![^\s\"'(])[a-z]{3,32}(?=[\s.,;:!?)\"']|\Z)")  # whole words of letters: no pieces of longer tokens
MOST_WORDS = 50_000  # words of the dictionary: about half a megabyte, whatever the corpus
LEAST_DOCS = 3  # texts that hold a word of the dictionary


def corpus_words(df: DataFrame, text: str = "text", most: int = MOST_WORDS, least_docs: int = LEAST_DOCS) -> dict[str, int]:
    """A dictionary of word ranks: the built-in words first, then the corpus's own by the number of texts that hold them.

    Words are lower-cased and counted once per text; ties go by the word. Each batch is counted before the shuffle, and
    only the ``most`` words with the highest counts come to the driver. Null texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for value in batch.column(0):
                total.update(set(WORD.findall((value.as_py() or "").lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counts = df.select(F.col(text).cast("string")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= least_docs).orderBy(F.desc("n"), "word").limit(most).select("word").toArrow().column(0).to_pylist()
    ranks = dict(DEFAULT_WORDS)
    for word in top:
        ranks.setdefault(word, len(ranks) + 1)
    return ranks


def scan_secrets(
    df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), words: Mapping[str, int] | None = None, least_cost: float = 10.0
) -> DataFrame:
    """Secrets of every row: ``keys``, counts by kind, spans of the base patterns, all spans, highest guess cost.

    A null text is an empty one. Repeated rows are scanned each for itself, other columns are not kept, an empty table
    gives no rows, and texts are scanned whole whatever their length. ``words`` replaces the built-in word ranks, for
    instance by those of ``corpus_words``; they are broadcast and must be few enough for that.
    """
    known = df.sparkSession.sparkContext.broadcast(dict(DEFAULT_WORDS if words is None else words))

    def scan(value: str) -> tuple:
        base, every, highest = scan_text(value, known.value, least_cost)
        counts = [sum(k == kind for _, _, k in every) for kind in KINDS]
        return (*counts, spans_text(base, KINDS), spans_text(every, KINDS), highest)

    return per_row(df, text, list(keys), scan, "n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_spans string, spans string, max_log10_guesses double")
