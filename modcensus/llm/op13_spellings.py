"""Spelling variants by a frequency-vector trie.

A word is the vector of how often each group of letters occurs in it. A trie has the words by their
successive counts, one level for each group. One edit changes at most two counts: a letter more, a
letter less. So a depth-first search that may once take a count one higher (surplus) and once one lower
(deficit) reaches all words at one edit; leaf words are verified by comparing letters. A pair is looked for from one
side only: the word whose first different count is the smaller one, so a deficit is spent after a
surplus.

The trie's top is spread: nodes of more than ``SUBTREE`` words are opened level by level, and each word
goes to the subtrees that its budget reaches. A subtree with ``VISITORS`` of its visitors is one task's
work, on arrays: nodes of a level are numbered, blocks of (visitor, node, budget) are taken from a stack.
Subtrees that cannot be opened further (equal vectors) are cut into parts that meet all visitors.

Defined cases: null texts have no words; ties go to the least word in code-point order; repeated rows
count each time; an empty table gives no rows; other columns are not read; words may have any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modcensus.llm.common import land
from modcensus.operators.joins import join_single

#: letters by group; all others are the last group. Common letters come first: they part words most
GROUPS = ["e", "a", "n", "i", "t", "o", "r", "s", "h", "l", "d", "u", "c", "m", "gq", "bvw", "fpy", "jkxz", "é", "óö", "áãç", "èêë"]
SUBTREE = 100_000  # words of a subtree that is not opened
VISITORS = 50_000  # of one task
BLOCK = 200_000  # (visitor, node) entries of a block, and pairs verified at once
FEW = 4  # words of a node that are verified without going down further
SHORT = 64  # letters of words that are compared in arrays
PAIR = "word STRING, n LONG, other STRING, other_n LONG"


def count_of(word: Column, level: int) -> Column:
    if level < len(GROUPS):
        return F.length(word) - F.length(F.translate(word, GROUPS[level], ""))
    return F.length(F.translate(word, "".join(GROUPS), ""))


LEVELS = len(GROUPS) + 1
_GROUP = np.full(256, len(GROUPS), np.int64)
for _i, _letters in enumerate(GROUPS):
    _GROUP[list(_letters.encode("latin-1"))] = _i


def trie_top(words: DataFrame, subtree: int = SUBTREE) -> tuple[DataFrame | None, int]:
    """(node, open) of the trie's top, and the number of its levels.

    A node is named by its counts. Only nodes of more than ``subtree`` words are opened.
    """
    nodes, members = None, words.select("word", F.lit("").alias("node"))
    if not members.limit(subtree + 1).count() > subtree:
        return None, 0
    for level in range(LEVELS):
        members = members.withColumn("node", F.concat("node", count_of(F.col("word"), level).cast("string"), F.lit(",")))
        counts = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        counts = land(counts.select("node", (F.col("n") > subtree).alias("open")), "nodes")
        nodes = counts if nodes is None else nodes.unionAll(counts)
        opened = counts.where("open").select("node")
        if not opened.head(1):
            return nodes, level + 1
        members = join_single(members, opened, ["node"], "inner", spread=["word"])
    return nodes, LEVELS


def visits(words: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(word, n, node, spent) for each subtree that a word's budget reaches.

    spent: 0 nothing (the word's own subtree), 1 a surplus, 2 a deficit too.
    """
    nodes, levels = trie_top(words, subtree)
    rows = words.select("word", "n", F.lit("").alias("node"), F.lit(0).alias("spent"), F.lit(True).alias("open"))
    for level in range(levels):
        count = count_of(F.col("word"), level)

        def move(by: int, spent: Column, count: Column = count) -> Column:
            return F.struct(F.concat("node", (count + by).cast("string"), F.lit(",")).alias("node"), spent.alias("spent"))

        own = move(0, F.col("spent"))
        more = F.when(F.col("spent") == 0, F.array(own, move(1, F.lit(1)))).when((F.col("spent") == 1) & (count > 0), F.array(own, move(-1, F.lit(2))))
        here = F.when(~F.col("open"), F.array(F.struct("node", "spent"))).otherwise(F.coalesce(more, F.array(own)))
        rows = rows.select("word", "n", F.inline(here))
        rows = join_single(rows, nodes, ["node"], "inner", spread=["word"], salts=2)
    return rows.select("word", "n", "node", "spent")


@dataclass
class _Words:
    """Words as Latin-1 bytes one after the other, with their vectors."""

    text: list[str]
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, text: list[str]) -> _Words:
        data = np.frombuffer("".join(text).encode("latin-1"), np.uint8)
        sizes = np.fromiter(map(len, text), np.int64, len(text))
        cells = np.repeat(np.arange(len(text)), sizes) * LEVELS + _GROUP[data]
        vectors = np.bincount(cells, minlength=len(text) * LEVELS).reshape(len(text), LEVELS)
        return cls(text, data, np.cumsum(sizes) - sizes, sizes, vectors)

    def letters(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Their letters in columns, 0 after the end."""
        places = np.arange(width)
        at = np.minimum(self.starts[rows][:, None] + places, max(len(self.data) - 1, 0))
        return np.where(places < self.sizes[rows][:, None], self.data[at], 0)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is replaced, or inserted into ``a``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(b) != len(a) + 1:
        return False
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[at:] == b[at + 1 :]


class Trie:
    """The words of a subtree by their counts; a level's nodes are numbered in order."""

    def __init__(self, text: list[str]):
        found = _Words.of(text)
        order = np.lexsort(found.vectors.T[::-1])
        self.words = _Words.of([text[i] for i in order])
        vectors = self.words.vectors
        self.wide = int(vectors.max(initial=0)) + 1
        node = np.zeros(len(text), np.int64)
        self.keys, self.first = [], []
        for level in range(LEVELS):
            key = node * self.wide + vectors[:, level]
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            self.keys.append(key[new])
            self.first.append(np.append(np.flatnonzero(new), len(text)))
            node = np.cumsum(new) - 1

    def pairs(self, visitors: _Words) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, word) at one edit, each pair from its one side.

        The search starts above the trie's top again: what was spent on the way here is spent once more.
        """
        nothing = np.zeros(len(visitors.text), np.int64)
        stack = [(0, np.arange(len(nothing)), nothing, nothing)] if self.words.text else []
        found = []
        while stack:
            level, who, node, used = stack.pop()
            if level == LEVELS:
                found.append(self._verified(visitors, who, self.first[-1][node], self.first[-1][node + 1]))
                continue
            if len(who) > BLOCK:
                half = len(who) // 2
                stack += [(level, who[:half], node[:half], used[:half]), (level, who[half:], node[half:], used[half:])]
                continue
            count = visitors.vectors[who, level]
            moved = [self._children(level, who, node, count, used)]
            for by, needed in ((1, 0), (-1, 1)):
                able = used == needed
                moved.append(self._children(level, who[able], node[able], count[able] + by, used[able] + 1))
            who, node, used = (np.concatenate(part) for part in zip(*moved, strict=True))
            first = self.first[level]
            small = first[node + 1] - first[node] <= FEW
            if small.any():
                found.append(self._verified(visitors, who[small], first[node[small]], first[node[small] + 1]))
            if not small.all():
                stack.append((level + 1, who[~small], node[~small], used[~small]))
        return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def _children(self, level, who, node, count, used):
        keys = self.keys[level]
        key = node * self.wide + count
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        is_child = (keys[at] == key) & (count >= 0) & (count < self.wide)
        return who[is_child], at[is_child], used[is_child]

    def _verified(self, visitors: _Words, who, low, high) -> tuple[np.ndarray, np.ndarray]:
        """Of the words low to high of each visitor those at one edit, in slices of ``BLOCK`` pairs."""
        ends = np.cumsum(high - low)
        total = int(ends[-1]) if len(ends) else 0
        kept = []
        for start in range(0, total, BLOCK):
            pair = np.arange(start, min(start + BLOCK, total))
            row = np.searchsorted(ends, pair, "right")
            kept.append(self._close(visitors, who[row], pair - (ends - (high - low))[row] + low[row]))
        return tuple(np.concatenate(part) for part in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 2

    def _close(self, visitors: _Words, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        longer = self.words.sizes[b] - visitors.sizes[a]
        keep = (longer == 0) | (longer == 1)
        a, b = a[keep], b[keep]
        apart = self.words.vectors[b] - visitors.vectors[a]
        keep = np.abs(apart).sum(1) <= 2
        a, b, apart = a[keep], b[keep], apart[keep]
        differs = apart != 0
        # from the side with the first smaller count; equal vectors are told apart by the words below
        keep = ~differs.any(1) | (np.take_along_axis(apart, differs.argmax(1)[:, None], 1)[:, 0] > 0)
        a, b, same = a[keep], b[keep], ~differs.any(1)[keep]
        size = visitors.sizes[a]
        near = np.zeros(len(a), bool)
        short = size < SHORT
        if short.any():
            near[short] = self._close_letters(visitors, a[short], b[short])
        for i in np.flatnonzero(~short):
            near[i] = one_edit(visitors.text[a[i]], self.words.text[b[i]])
        for i in np.flatnonzero(near & same):
            near[i] = visitors.text[a[i]] < self.words.text[b[i]]
        return a[near], b[near]

    def _close_letters(self, visitors: _Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        width = int(self.words.sizes[b].max()) + 1
        x, y = visitors.letters(a, width), self.words.letters(b, width)
        unlike = x != y
        replaced = (unlike.sum(1) == 1) & (visitors.sizes[a] == self.words.sizes[b])
        first = unlike.argmax(1)
        # from the first difference on, the longer word is one letter ahead
        ahead = (x[:, :-1] != y[:, 1:]) & (np.arange(width - 1) >= first[:, None])
        inserted = (visitors.sizes[a] < self.words.sizes[b]) & ~ahead.any(1)
        return replaced | inserted


def _search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs of a subtree's part and some of its visitors."""
    is_member = table.column("is_member").to_numpy(zero_copy_only=False)
    members, visitors = table.filter(pa.array(is_member)), table.filter(pa.array(~is_member))
    trie = Trie(members.column("word").to_pylist())
    known = dict(zip(members.column("word").to_pylist(), members.column("n").to_pylist(), strict=True))
    text, times = visitors.column("word").to_pylist(), visitors.column("n").to_pylist()
    a, b = trie.pairs(_Words.of(text))
    others = [trie.words.text[i] for i in b]
    columns = [[text[i] for i in a], [times[i] for i in a], others, [known[other] for other in others]]
    return pa.table([pa.array(column, kind) for column, kind in zip(columns, [pa.string(), pa.int64()] * 2, strict=True)], names=["word", "n", "other", "other_n"])


def near_pairs(words: DataFrame, subtree: int = SUBTREE, visitors: int = VISITORS) -> DataFrame:
    """(word, n, other, other_n), once for each two of the distinct ``words`` at exactly one edit."""
    reached = visits(words, subtree)
    sizes = reached.groupBy("node").agg(F.count(F.lit(1)).alias("visitors"), F.count_if(F.col("spent") == 0).alias("members"))
    sizes = sizes.where("members > 0").select("node", F.ceil(F.col("visitors") / visitors).cast("int").alias("shares"), F.ceil(F.col("members") / subtree).cast("int").alias("parts"))
    sized = join_single(reached, sizes, ["node"], "inner", spread=["word"], salts=2)
    hashed = F.xxhash64("word")

    def all_of(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    columns = ["node", "share", "part", "word", "n"]
    visiting = sized.withColumn("share", F.pmod(hashed, F.col("shares")).cast("int")).withColumn("part", all_of("parts")).select(*columns, F.lit(False).alias("is_member"))
    owned = sized.where("spent = 0").withColumn("part", F.pmod(F.shiftright(hashed, 20), F.col("parts")).cast("int")).withColumn("share", all_of("shares")).select(*columns, F.lit(True).alias("is_member"))
    return visiting.unionAll(owned).groupBy("node", "share", "part").applyInArrow(_search, PAIR)


def spelling_forms(words: DataFrame, times: int = 10) -> DataFrame:
    """word, n, form, form_n, root and n_near of the distinct ``words`` (word, n).

    A word's form is the most frequent near word if that occurs ``times`` times as often; root follows the forms.
    """
    words = land(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = land(near_pairs(words), "near-words")
    both = pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(found, "word", "left")
    frequent = -F.col("best.n") >= times * F.col("n")
    rows = land(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.n")).alias("form_n")), "forms")
    steps = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        # each round doubles the steps taken; counts grow on the way, so there are no circles
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = land(join_single(steps, ahead, ["root"], "left", spread=["word"]), "roots")
        steps = joined.select("word", F.coalesce("next", "root").alias("root"))
        if not joined.where("next IS NOT NULL").head(1):
            break
    rows = rows.join(steps, "word", "left")
    return rows.select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
