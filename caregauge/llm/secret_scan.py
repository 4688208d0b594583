"""Secrets in texts: key patterns, and windows of high entropy in candidate strings."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caregauge.llm.common import slices, texts

# The base patterns, their kinds in order, and the lengths they need.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

#: Candidate strings: runs of the letters that keys are written in.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Window lengths and bits a letter at which a window counts, by the window's letters. These three
#: hold for two digits and more; mixed windows have letters of either case.
WINDOW = 20
HEX_BITS, MIXED_BITS, SINGLE_CASE_BITS = 2.9, 3.7, 3.5
#: With one digit or none a window may be words, and needs more: at least EVEN letters of either
#: case, fewer of one, and of a single case with one digit and without. A window of less than two
#: letters is a number.
EVEN = 5
EVEN_BITS, UNEVEN_BITS, SINGLE_DIGIT_BITS, WORD_BITS = 3.75, 4.0, 3.6, 3.7
#: Strings that look random and are none: identifiers with groups of a known shape, dates, words,
#: alphabets, and a key right beside a word that calls it an example. Each holds for a whole
#: segment of a candidate, so that what stands beside a key in a path takes no key away. A word
#: is shorter than a window; longer ones are for the entropy to tell.
SEGMENT = re.compile(r"[^/=]+")
PART = r"(?:(?:[a-z]{1,19}|[A-Z]{1,19}|[A-Z][a-z]{1,18})[0-9]{0,4}|[0-9]{1,4})"
STAND_IN = r"(?i:example|sample|dummy|placeholder|test)[0-9]{0,4}"
RUNS = "|".join(
    first + "".join(f"(?:{c}" for c in more) + ")?" * len(more)
    for first, more in (("0123456789", ""), ("abcdefghij", "klmnopqrstuvwxyz"), ("ABCDEFGHIJ", "KLMNOPQRSTUVWXYZ"))
)
ALLOWED = re.compile(
    rf"^(?:{PART}[_+-]+)*{STAND_IN}[_+-]+[A-Za-z0-9]+$"
    rf"|^[A-Za-z0-9]+[_+-]+{STAND_IN}$"
    # letters and digits to the end, then a mark among them: each looked for once
    rf"|^(?:{PART}[_+-]+)*(?=[A-Za-z0-9]+$)[A-Za-z0-9]*(?:xxxx|XXXX)"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    rf"|^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:[Tt_-][0-9]{{2}}(?:-?[0-9]{{2}}){{0,2}}[0-9]{{0,9}}[Zz]?)?(?:[_+-]+{PART})*$"
    rf"|^{PART}(?:[_+-]+{PART})*$"
    rf"|^(?:{RUNS})+$"
)
#: Up to one letter more than a window: the next one is added before the first one goes.
N_LOG_N = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 2))]

LOWER, UPPER, DIGIT, OTHER = range(4)
CLASS = {c: (DIGIT if c.isdigit() else LOWER if c.islower() else UPPER if c.isupper() else OTHER) for c in map(chr, range(128))}
HEX_LETTERS = frozenset("0123456789abcdefABCDEF")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and without overlap for each kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LENGTH:
            found.append((m.start(), "assign", m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LENGTH:
                found.append((m.start(), "access", m.end()))
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def random_window(word: str) -> bool:
    """Whether a window of WINDOW letters of the word has the entropy of a key.

    The window moves letter by letter; counts of its letters, of their classes and of letters
    that are no hex digits, and the sum of n * log2(n) over the counts, are kept up to date.
    """
    counts: dict[str, int] = {}
    classes = [0, 0, 0, 0]
    odd = 0  # letters that are no hex digits
    total = 0.0
    for i, c in enumerate(word):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += N_LOG_N[n + 1] - N_LOG_N[n]
        classes[CLASS[c]] += 1
        odd += c not in HEX_LETTERS
        if i >= WINDOW:
            gone = word[i - WINDOW]
            n = counts[gone]
            counts[gone] = n - 1
            total += N_LOG_N[n - 1] - N_LOG_N[n]
            classes[CLASS[gone]] -= 1
            odd -= gone not in HEX_LETTERS
        if i < WINDOW - 1:
            continue
        if classes[LOWER] + classes[UPPER] < 2:
            continue
        lesser = min(classes[LOWER], classes[UPPER])
        if classes[DIGIT] >= 2:
            least = HEX_BITS if not odd else MIXED_BITS if lesser else SINGLE_CASE_BITS
        elif lesser:
            least = EVEN_BITS if lesser >= EVEN else UNEVEN_BITS
        else:
            least = SINGLE_DIGIT_BITS if classes[DIGIT] else WORD_BITS
        if math.log2(WINDOW) - total / WINDOW >= least:
            return True
    return False


def uncovered(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The stretches from ``start`` to ``end`` outside the ordered, disjoint ones that are taken;
    those of a window's length and more."""
    at = bisect.bisect_right(taken, start, key=lambda s: s[1])
    while at < len(taken) and taken[at][0] < end:
        if taken[at][0] - start >= WINDOW:
            yield start, taken[at][0]
        start = taken[at][1]
        at += 1
    if end - start >= WINDOW:
        yield start, end


def random_beside_allowed(word: str, allowed: re.Pattern[str]) -> bool:
    """Whether a random window of the word touches a segment that is not allowed."""
    if not random_window(word):
        return False
    for m in SEGMENT.finditer(word):
        near = word[max(0, m.start() - WINDOW + 1) : m.end() + WINDOW - 1]
        if not allowed.search(m.group().strip("_+-")) and random_window(near):
            return True
    return False


def entropy_spans(
    text: str, taken: list[tuple[int, str, int]], allowed: re.Pattern[str] = ALLOWED
) -> list[tuple[int, str, int]]:
    """What base spans leave uncovered of candidate strings, if it has a random window that touches
    a segment (parted by / and =) which is not allowed."""
    found = []
    merged: list[tuple[int, int]] = []
    for a, _, b in sorted(taken):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    for m in CANDIDATE.finditer(text):
        if m.group().isdigit():
            continue
        for a, b in uncovered(m.start(), m.end(), merged):
            if random_beside_allowed(text[a:b], allowed):
                found.append((a, "entropy", b))
    return found


def spans(text: str, allowed: re.Pattern[str] = ALLOWED) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind as listed."""
    found = base_spans(text)
    found += entropy_spans(text, found, allowed)
    return [(k, a, b) for a, k, b in sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))]


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
)


def find_secrets(docs: DataFrame, allowed: re.Pattern[str] = ALLOWED) -> DataFrame:
    """Rows (doc_id, secrets array<struct<kind, start, stop>>) of whole texts; ``stop`` is
    exclusive; ``allowed`` is searched in the segments of a candidate, and takes
    entropy spans of allowed segments away. A null or empty text has none; repeated rows give repeated results; extra columns
    are left out."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [
                [{"kind": k, "start": a, "stop": b} for k, a, b in spans(t, allowed)] for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, arrow)], names=["doc_id", "secrets"])

    docs = texts(docs)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("secrets", SPANS)])
    return docs.mapInArrow(rows, schema)


def mask(text: str, shown: str = "[{}]") -> str:
    """The text with each secret replaced by its kind in brackets; overlapping ones as one."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in spans(text):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], shown.format(kind.upper())]
        at = b
    return "".join([*out, text[at:]])


def masked(text: Column) -> Column:
    """A text column with its secrets replaced; null stays null."""

    @F.udf(returnType="string", useArrow=True)
    def replaced(value: str | None) -> str | None:
        return None if value is None else mask(value)

    return replaced(text)
