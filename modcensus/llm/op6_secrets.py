"""Secret scanning by regular expressions behind a trigram index.

From each rule's pattern a Boolean query over trigrams is derived: what every match must contain.
For a few megabytes of text at a time the task builds the inverted index from those trigrams to
texts (postings are sorted arrays), evaluates each query by intersecting and uniting postings, and
runs the pattern over the candidates alone. Rules whose pattern has no mandatory trigram scan every
text. The query is a necessary condition, so nothing is lost.

Defined cases: null and empty texts have no spans; spans may overlap between kinds, but not within a
kind; repeated rows get equal results; an empty table gives no rows. Memory follows the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache
from re import _constants as ops
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modcensus.llm.common import with_results
from modcensus.llm.vectext import Texts, lower_ascii, texts

SLOT_BITS = 16
MANY = 64  # alternatives kept apart while a pattern is read

# fixed values: the patterns of the base kinds
ASSIGN = r"""(?P<name>password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
# end of fixed values


def _either_case(pattern: str) -> str:
    """ASCII letters of the group ``name`` in either case, and no others."""
    start = pattern.index(">") + 1
    end = pattern.index(")", start)
    name = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", pattern[start:end])
    return "(" + name + pattern[end:]


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    counts: Callable[[re.Match], bool] = field(default=lambda match: True)


BASE = [
    Rule("assign", _either_case(ASSIGN), lambda m: len(m[2]) >= MIN_VALUE),
    Rule("access", ACCESS, lambda m: len(m[0]) >= MIN_ACCESS),
    Rule("hex", HEX, lambda m: len(m[0]) >= MIN_HEX),
]
MORE = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    Rule("github", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,})"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
RULES = BASE + MORE


# --- from a pattern to a Boolean query -------------------------------------------------------
# A query is a set of alternatives; each is a set of trigrams that must all occur.
Query = frozenset  # of frozensets of lower-case trigrams; {frozenset()} asks for nothing
NOTHING_ASKED: Query = frozenset([frozenset()])


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _all(first: Query, second: Query) -> Query:
    if len(first) * len(second) > MANY:  # ask for the narrower one only: still necessary
        return min(first, second, key=len)
    return frozenset(a | b for a in first for b in second)


def _characters(items) -> set[str] | None:
    """The lower-case ASCII characters of a class, None if many or others."""
    found: set[str] = set()
    for op, value in items:
        if op is ops.LITERAL:
            found.add(chr(value).lower())
        elif op is ops.RANGE and value[1] - value[0] < 4:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 and all(c.isascii() for c in found) else None


def _read(tokens) -> Query:
    """The query of a sequence: runs of known characters are spelled out, the rest is conjoined."""
    asked, runs = NOTHING_ASKED, {""}

    def spelled() -> Query:
        return frozenset(_trigrams(run) for run in runs)

    for op, value in tokens:
        options: set[str] | None = None
        if op is ops.LITERAL:
            options = _characters([(op, value)])
        elif op is ops.IN:
            options = _characters(value)
        elif op is ops.SUBPATTERN and not value[1] and not value[2]:
            strings = _strings(value[3])
            if strings is None:
                asked = _all(_all(asked, spelled()), _read(value[3]))
                runs = {""}
                continue
            options = strings
        elif op is ops.MAX_REPEAT and value[0] == 0 and value[1] == 1:
            strings = _strings(value[2])
            options = strings | {""} if strings is not None else None
        elif op is ops.BRANCH:
            query = frozenset().union(*(_read(branch) for branch in value[1]))
            asked = _all(_all(asked, spelled()), query)
            runs = {""}
            continue
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] > 0:
            asked = _all(_all(asked, spelled()), _read(value[2]))
            runs = {""}
            continue
        if options is None or len(runs) * len(options) > MANY:
            asked = _all(asked, spelled())
            runs = {""}
            if options is not None:
                runs = options
        else:
            runs = {run + option for run in runs for option in options}
    return _all(asked, spelled())


def _strings(tokens) -> set[str] | None:
    """All strings of a short pattern part, None if they are many."""
    found = {""}
    for op, value in tokens:
        if op is ops.LITERAL:
            options = _characters([(op, value)])
        elif op is ops.IN:
            options = _characters(value)
        elif op is ops.SUBPATTERN and not value[1] and not value[2]:
            options = _strings(value[3])
        elif op is ops.MAX_REPEAT and value[0] == 0 and value[1] == 1:
            options = _strings(value[2])
            options = options | {""} if options is not None else None
        elif op is ops.BRANCH:
            branches = [_strings(branch) for branch in value[1]]
            options = None if None in branches else set().union(*branches)
        else:
            options = None
        if options is None or len(found) * len(options) > MANY:
            return None
        found = {a + b for a in found for b in options}
    return found


def trigram_query(pattern: str) -> Query | None:
    """Alternatives of mandatory lower-case trigrams; None if a match need not have any."""
    query = _read(parser.parse(pattern))
    if frozenset() in query:
        return None
    # an alternative that asks for more than another adds nothing
    return frozenset(q for q in query if not any(other < q for other in query))


# --- index, candidates, spans ------------------------------------------------------------------
def _slot(codes: np.ndarray) -> np.ndarray:
    """A small hash of three bytes: most that are not asked for are told apart by it."""
    return (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)


@dataclass
class Scanner:
    rules: list[Rule]

    def __post_init__(self):
        self._patterns = [re.compile(rule.pattern) for rule in self.rules]
        self._queries = [trigram_query(rule.pattern) for rule in self.rules]
        asked = sorted({t for query in self._queries if query for part in query for t in part})
        self._number = {trigram: i for i, trigram in enumerate(asked)}
        codes = np.array([int.from_bytes(t.encode(), "big") for t in asked], np.uint32)
        self._codes = codes  # ascending, as the trigrams are
        self._asked_slots = np.zeros(1 << SLOT_BITS, bool)
        self._asked_slots[_slot(codes)] = True

    def postings(self, found: Texts) -> list[np.ndarray]:
        """For each asked trigram the texts that have it, ascending."""
        data = lower_ascii(found).data.astype(np.uint32)
        size = len(self._number)
        if len(data) < 3 or not size:
            return [np.zeros(0, np.int64)] * size
        code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        at = np.flatnonzero(self._asked_slots[_slot(code)])
        number = np.minimum(np.searchsorted(self._codes, code[at]), size - 1)
        is_asked = self._codes[number] == code[at]
        at, number = at[is_asked], number[is_asked]
        doc = np.searchsorted(found.offsets, at, "right") - 1
        inside = at + 3 <= found.offsets[doc + 1]
        cells = np.unique(number[inside] * len(found) + doc[inside])
        edges = np.searchsorted(cells, np.arange(size + 1) * len(found))
        return [cells[a:b] % len(found) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def candidates(self, query: Query | None, postings: list[np.ndarray], size: int) -> np.ndarray:
        if query is None:
            return np.arange(size)
        parts = []
        for alternative in query:
            lists = sorted((postings[self._number[t]] for t in alternative), key=len)
            common = lists[0]
            for other in lists[1:]:
                common = np.intersect1d(common, other, assume_unique=True)
            parts.append(common)
        return np.unique(np.concatenate(parts))

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule's number, end), in order."""
        found = texts(column)
        postings = self.postings(found)
        made: list[list[tuple[int, int, int]]] = [[] for _ in range(len(found))]
        for i, (rule, pattern, query) in enumerate(zip(self.rules, self._patterns, self._queries, strict=True)):
            for doc in self.candidates(query, postings, len(found)).tolist():
                made[doc] += [(m.start(), i, m.end()) for m in pattern.finditer(column[doc].as_py()) if rule.counts(m)]
        return [sorted(spans) for spans in made]


@cache
def scanner() -> Scanner:
    return Scanner(RULES)


def _written(rules: list[Rule], spans) -> str:
    return ",".join(f"{rules[i].kind}:{start}:{end}" for start, i, end in spans)


def _found(column: pa.Array):
    made = scanner().spans(column)
    base = [[s for s in spans if s[1] < len(BASE)] for spans in made]
    counts = [[sum(s[1] == i for s in spans) for spans in base] for i in range(len(BASE))]
    return [*counts, [_written(RULES, spans) for spans in base], [_written(RULES, spans) for spans in made]]


def found_secrets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, counts of the base kinds, base_spans and spans.

    Spans are ``kind:start:end`` in code points, by start and then kind, joined by commas.
    """
    return with_results(docs, _found, "n_assign LONG, n_access LONG, n_hex LONG, base_spans STRING, spans STRING", keep)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = "*") -> str:
    """The text with each character of a span replaced, as long as before."""
    parts, at = [], 0
    for start, _, end in spans:
        if end > at:
            parts += [text[at : max(start, at)], mask * (end - max(start, at))]
            at = end
    return "".join(parts) + text[at:]


def masked_documents(docs: DataFrame) -> DataFrame:
    """All documents and columns; secrets in ``text`` are masked in place, null texts stay null."""

    def compute(column: pa.Array):
        return ([masked(column[i].as_py(), spans) if spans else column[i].as_py() for i, spans in enumerate(scanner().spans(column))],)

    others = [name for name in docs.columns if name != "text"]
    rows = docs.withColumn("_no_text_", F.col("text").isNull())
    rows = with_results(rows, compute, "_masked_ STRING", [*others, "_no_text_"])
    return rows.select(*[F.when(~F.col("_no_text_"), F.col("_masked_")).alias("text") if n == "text" else F.col(n) for n in docs.columns])
