"""Secret scans: fixed patterns, then sliding-window entropy over candidate strings.

A candidate is a maximal run of letters, digits and ``+ / _ = -`` of at least 16
characters. For the first character class that the run's alphabet fits
(hexadecimal, letters without digits, base 64) a window slides over it; counts of
its characters are updated by the one that enters and the one that leaves, and
with them the sum of c * log2(c), from which the window's Shannon entropy follows.
A candidate shorter than ``window`` is one window, whose limit is less by the
bits that it cannot reach. Windows above the class's limit join into spans of kind
``entropy``. Candidates that read as words (plain, camel case, snake case, paths,
with up to four digits at the end), numbers, UUIDs, windows that hold a placeholder,
and places that a fixed pattern has already found add nothing. A run reads as
words if three quarters of its letter pairs are common in words, as fewer than one
in fifty random runs of 16 letters have.

Null texts are empty and have no spans; null ids are kept; repeated rows are
scanned each; spans that begin together stand in the order of their kinds; very long
texts are scanned whole, in a step of their own; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, map_steps

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Allow list: a candidate that matches one whole is not a secret.
ALLOW = (
    r"[0-9]+",  # numbers
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
)
#: A window that holds one of these is not a secret.
PLACEHOLDER = re.compile("EXAMPLE|example|xxxx|XXXX|0000000|1234567|abcdefg")

#: Candidates that are words if their letters are: words, camel case, snake case and paths, with a short number.
WORDY = re.compile(r"[A-Za-z+/_=-]+[0-9]{0,4}")
LETTERS = re.compile("[a-z]+")
#: The 270 most common letter pairs of English, German, French and Spanish words: a letter, then those after it.
PAIRS = frozenset(
    group[0] + x
    for group in (
        "aabcdehilmnoprstuvw bejlou caehilotu dabehilnorstw eabcdefghilmnopqrstuvwxyz faeiortu gaehilnorstu habceghilnoprstuvw "
        "iabcdeghilmnoprstv jae ke laeilostuy maeiop nabcdeghiklmnopqrstuvwz oabcdefilmnoprstuw paeflort qu rabcdeghilmnoprstuw "
        "sabcehilmnoprstu tabcehilnorstuwyz uabcefhilmnoprstx vaeio wahi xacept yaehinopst zu"
    ).split()
    for x in group[1:]
)
COMMON = 0.75

#: Alphabet, and bits a character above which a window of it is suspicious.
CLASSES = (
    ("0123456789abcdefABCDEF", 3.0),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.0),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
)
#: Least length of a candidate.
SHORTEST = 16


def words_like(run: str) -> bool:
    """Whether most letter pairs of the run are common in words."""
    pairs = [part[i : i + 2] for part in LETTERS.findall(run.lower()) for i in range(len(part) - 1)]
    return sum(p in PAIRS for p in pairs) >= COMMON * len(pairs)


class Scanner:
    """Finds spans ``(kind, start, end)`` in code points, end exclusive."""

    def __init__(self, window: int = 20, classes=CLASSES, allow=ALLOW):
        self.window, self.classes = window, [(frozenset(a), limit) for a, limit in classes]
        self.allow = re.compile("|".join(f"(?:{p})" for p in allow))
        self.candidate = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % min(window, SHORTEST))
        self.terms = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]

    def base(self, text: str) -> list[tuple[str, int, int]]:
        low, spans = text.lower(), []
        if any(w in low for w in WORDS):
            spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        return spans + [("hex", *m.span()) for m in HEX.finditer(text)]

    def dense(self, run: str) -> list[tuple[int, int]]:
        """Joined windows of ``run`` above the limit of the first class that its characters fit."""
        limit = next((x for a, x in self.classes if a.issuperset(run)), None)
        if limit is None:
            return []
        w, terms, counts, total, out = min(self.window, len(run)), self.terms, {}, 0.0, []
        bits, limit = math.log2(w), limit - math.log2(self.window / w)
        held = [m.span() for m in PLACEHOLDER.finditer(run)][::-1]
        for i, c in enumerate(run):
            n = counts.get(c, 0)
            total += terms[n + 1] - terms[n]
            counts[c] = n + 1
            if i >= w:
                n = counts[run[i - w]]
                total += terms[n - 1] - terms[n]
                counts[run[i - w]] = n - 1
            while held and held[-1][0] < i - w + 1:
                held.pop()
            if i >= w - 1 and bits - total / w > limit + 1e-9 and not (held and held[-1][1] <= i + 1):
                if out and out[-1][1] >= i - w + 1:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i - w + 1, i + 1))
        return out

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        spans = self.base(text)
        starts, ends = [], []  # what the fixed patterns hold, as ranges that do not overlap
        for s, e in sorted((s, e) for _, s, e in spans):
            if ends and s < ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        for m in self.candidate.finditer(text):
            if self.allow.fullmatch(m[0]) or (WORDY.fullmatch(m[0]) and words_like(m[0])):
                continue
            for s, e in self.dense(m[0]):
                s, e = s + m.start(), e + m.start()
                before = bisect.bisect_left(starts, e)
                if not before or ends[before - 1] <= s:
                    spans.append(("entropy", s, e))
        return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, window: int = 20) -> DataFrame:
    """``(doc_id, spans)`` for each row of ``docs(doc_id, text)``; spans are ``(kind, start, end)`` in order."""

    def step(batch: pa.RecordBatch):
        scanner = Scanner(window)
        yield {
            "doc_id": batch.column("doc_id"),
            "spans": [[dict(zip(("kind", "start", "end"), s)) for s in scanner.scan(t or "")] for t in batch.column("text").to_pylist()],
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_steps(rows, step, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by ``[kind]`` (overlapping spans by one), ``n_chars`` with it.

    Columns and rows stay as they are otherwise; a null text stays null.
    """

    importable(docs.sparkSession)
    @F.pandas_udf("string")
    def cleaned(texts):
        scanner = Scanner(window)

        def one(text):
            if text is None:
                return None
            parts, at = [], 0
            for kind, s, e in scanner.scan(text):
                if s >= at:
                    parts += [text[at:s], f"[{kind}]"]
                at = max(at, e)
            return "".join([*parts, text[at:]]) if parts else text

        return texts.map(one)

    out = docs.withColumn("text", cleaned(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
