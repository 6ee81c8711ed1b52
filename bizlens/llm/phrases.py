"""Phrase mining over truncated suffix subtrees, built group by group.

The text of a language is a sequence of pieces (cut at punctuation and line ends) of words.  Every word
position has a suffix: the words from there on, to the end of the piece and at most ``longest`` of them.
The tree of these suffixes holds every phrase as a node; the number of suffixes below a node is the phrase's count.

1. *Words.*  Exact counts of all words per language (partial counts in tasks, then added up).
2. *Runs.*  Frequent words set bits of a filter of fixed size.  Pairs of words that pass are counted by 64-bit hashes, and
   those that reach the minimum set bits of a second filter; so do, in turn, the longer runs both of whose parts pass, up to
   one word less than a suffix.  A hash counts at least what its run does and a rare run is in no frequent one, so
   the filters never miss one; false positives cost work, not rightness.
3. *Suffixes.*  A position whose first pair passes gives its suffix, cut before the first word that would bring in a run that
   does not (no frequent phrase can hold it).  Equal suffixes are counted inside the task before they move, and move as
   the task's parts of subtrees: a row holds all suffixes whose first words fall into one of ``BINS`` bins, and their
   counts.  A task thus hands on rows by the bin, however many phrases are frequent in the corpus.
4. *Vertical partitioning.*  A bin with more leaves (suffixes in its rows) than the memory budget is split
   into first words, and so are these into prefixes one word longer, down to whole suffixes; bins and prefixes are packed
   into groups of about the budget.
5. *Subtrees.*  Each group is read by one task, sorted, and its subtree is read off the sorted leaves: a node is a
   run of leaves that agree in their first words, its count their total.  Counts of nodes above a split prefix
   come out in parts and are added up.

Texts are handled a stretch at a time as arrays of bytes and of word places; words become Python objects nowhere.
Scores and the containment rule are joins over the counted phrases.  All arithmetic is in integers and decimals.

Defined results: null and empty texts have no words; a null language is ``und`` and joins rows that say so;
repeated rows count each; an empty corpus gives no rows; columns beyond the named ones are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from ..session import use_query_conf
from .common import quoted, ready_python, written_table

#: Bytes of text looked at together; words and phrases that cross a border are whole.
STRETCH = 1 << 20
#: Distinct words or suffixes a task counts before it hands them on (some 50 MB; it may gather twice that before it sums).
HELD = 800_000
#: Run hashes a task sorts at a time (some 100 MB).
HELD_RUNS = 4_000_000
#: Each filter over hashes has 2^FILTER_BITS bits (8 MB), whatever the corpus.
FILTER_BITS = 26
#: Leaves one group of prefixes should not pass.
GROUP_ROWS = 400_000
#: Bins of first words, a language.
BINS = 1024
#: Leaves in one row of a subtree; more go into more rows.
ROW_LEAVES = 4096

TOKEN = re.compile(rb"[^ \n]+|\n+")


def _classes() -> bytes:
    """Byte table: A-Z to a-z, a tab to a blank, the marks and line ends that cut pieces to a newline."""
    cuts = set(b".,;:!?") | set(range(0x0A, 0x0E))
    return bytes(b + 32 if 0x41 <= b <= 0x5A else 0x0A if b in cuts else 0x20 if b == 0x09 else b for b in range(256))


CLASSES = _classes()


def stretches(data: bytes, ahead: int, size: int = STRETCH) -> Iterator[tuple[list[bytes], int]]:
    """Tokens of a text (words, and newlines between pieces) a stretch at a time, with the number of tokens that
    start here: the others, at most ``ahead``, are what their phrases may need and come again first."""
    at, carry = 0, []
    while at < len(data):
        end = _stretch_end(data, at, size)
        tokens = carry + TOKEN.findall(data, at, end)
        at = end
        here = len(tokens) if at >= len(data) else max(0, len(tokens) - ahead)
        yield tokens, here
        carry = tokens[here:]


def _stretch_end(data: bytes, at: int, size: int) -> int:
    """Where the stretch from ``at`` on ends: at the first border of a word after ``size`` bytes."""
    end = at + size
    if end >= len(data):
        return len(data)
    stops = [p for p in (data.find(b" ", end), data.find(b"\n", end)) if p >= 0]
    return min(stops) if stops else len(data)


class Words(NamedTuple):
    """Words as places in a text; neighbours are one byte apart, a newline between pieces and a blank within one."""
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    opens: np.ndarray       # whether the word is the first of its piece

    def each(self) -> pa.Array:
        """The words, each with a blank behind it."""
        text = np.append(self.text, np.uint8(32))
        text[self.end] = 32
        return _binary(text, np.append(self.start, len(text)))

    def runs(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The runs from the words ``first`` to the words ``last`` of the same pieces."""
        return _slices(self.text, self.start[first], self.end[last])


def _binary(text: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))])


def _slices(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    return _binary(text[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)], offsets)


def _places(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a binary array without nulls."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return text, at[:-1], at[1:]


def cut_words(data: bytes) -> Words:
    """The words of a text that has been through ``CLASSES``."""
    text = np.frombuffer(data, np.uint8)
    line = text == 10
    inside = ~(line | (text == 32))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    opens = np.zeros(len(start) + 1, bool)
    opens[np.searchsorted(start, np.flatnonzero(line))] = True
    inside[end[:-1]] = True
    text, size = text[inside], end - start
    end = np.cumsum(size + 1) - 1
    text[end[:-1]] = np.where(opens[1:-1], 10, 32)
    return Words(text, end - size, end, opens[:-1])


def word_stretches(data: bytes, ahead: int, size: int = STRETCH) -> Iterator[tuple[Words, int]]:
    """Words of a text a stretch at a time, with the number of words that start here; see ``stretches``."""
    at, carry = 0, b""
    while at < len(data):
        end = _stretch_end(data, at, size)
        part = carry + data[at:end]
        at, words = end, cut_words(part)
        n = len(words.start)
        here = n if at >= len(data) else max(0, n - ahead)
        yield words, here
        gap = part[len(part.rstrip(b" \n")):]
        carry = (words.text[words.start[here]:].tobytes() if here < n else b"") + (b"\n" if b"\n" in gap else b" ")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language together, about a stretch at a time; pieces of different texts never touch."""
    found: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()

    def out(lang):
        del sizes[lang]
        return lang, b"\n".join(found.pop(lang)).translate(CLASSES)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                found.setdefault(lang, []).append(text)
                sizes[lang] += len(text)
                if sizes[lang] >= STRETCH:
                    yield out(lang)
                elif len(sizes) > 8 and sizes.total() >= 8 * STRETCH:
                    yield out(max(sizes, key=sizes.get))
    for lang in list(found):
        yield out(lang)


def _rows(names: list[str], types: list, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _input(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"),
                       F.col(quoted(text_col)).cast("binary").alias("text"))


class Tally:
    """Counts of byte strings a language, as Arrow tables that are summed when twice ``HELD`` rows have come together."""

    def __init__(self):
        self.parts: dict[str, list[pa.Table]] = {}
        self.sizes: Counter = Counter()

    def add(self, lang: str, values: pa.Array) -> None:
        found = values.value_counts()
        self._put(lang, pa.table({"value": found.field(0), "n": found.field(1)}))

    def _put(self, lang: str, part: pa.Table) -> None:
        self.parts.setdefault(lang, []).append(part)
        self.sizes[lang] += max(len(part), part.nbytes >> 6)      # long strings count for more

    def _sum(self, lang: str) -> pa.Table:
        del self.sizes[lang]
        parts = self.parts.pop(lang)
        if len(parts) > 1:
            return pa.concat_tables(parts).group_by("value", use_threads=False).aggregate([("n", "sum")]) \
                .select(["value", "n_sum"]).rename_columns(["value", "n"])
        return parts[0]

    def over(self) -> Iterator[tuple[str, pa.Table]]:
        """What has to go for the rest to be ``HELD`` rows or fewer."""
        if self.sizes.total() > 2 * HELD:
            for lang in list(self.parts):
                self._put(lang, self._sum(lang))
            while self.sizes.total() > HELD:
                lang = max(self.sizes, key=self.sizes.get)
                yield lang, self._sum(lang)

    def rest(self) -> Iterator[tuple[str, pa.Table]]:
        for lang in list(self.parts):
            yield lang, self._sum(lang)


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """``(lang, word, f)`` of all words found ``least`` times, and one row a language with a null word: all its words."""
    names, types = ["lang", "word", "f"], [pa.string(), pa.binary(), pa.int64()]

    def out(lang, counted):
        words = pc.binary_slice(counted["value"].combine_chunks(), 0, -1).cast(pa.binary())    # without the blank
        return _rows(names, types, [lang] * len(counted), words, counted["n"].combine_chunks())

    def count(batches):
        tally = Tally()
        total: Counter = Counter()
        for lang, data in _texts(batches):
            for words, _ in word_stretches(data, 0):
                total[lang] += len(words.start)
                tally.add(lang, words.each())
            for done in tally.over():
                yield out(*done)
        for done in tally.rest():
            yield out(*done)
        yield _rows(names, types, list(total), [None] * len(total), list(total.values()))

    parts = texts.mapInArrow(count, "lang string, word binary, f bigint")
    return parts.groupBy("lang", "word").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("word").isNull())


#: Bytes of text hashed together; of a longer word, its first ones count.
HASHED = 1 << 16
_FACTOR = 0x9E3779B97F4A7C15
_POWERS, _INVERSES = (np.cumprod(np.array([1] + [x] * HASHED, np.uint64)) for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))


def word_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places, in order; the same on every machine, never 0.  A word is read as a number to
    an odd base: the difference of two prefix sums, shifted to the word's start."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        at = start[i]
        j = max(i + 1, int(np.searchsorted(end, at + HASHED, "right")))
        part = text[at:min(end[j - 1], at + HASHED)].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POWERS[:len(part)], out=sums[1:])
        s = start[i:j] - at
        out[i:j] = (sums[np.minimum(end[i:j] - at, HASHED)] - sums[s]) * _INVERSES[s]
        i = j
    return np.maximum(_stirred(out), np.uint64(1))


def _stirred(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _salt(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode(), np.uint8)
    return word_hashes(data, np.array([0]), np.array([len(data)]))[0]


def _passes(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    at = h & np.uint64((1 << bits) - 1)
    return ((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def run_levels(words: Words, lang: str, passing: np.ndarray, filters: list[np.ndarray], bits: int,
               longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 2 to ``longest`` words: the hash of the run at each word, and whether it may be frequent: both its
    parts may, and it passes the filter of its length, where there is one."""
    run = hashes = word_hashes(words.text, words.start, words.end)
    on, salt = _passes(hashes, passing, bits), _salt(lang)
    joins = ~words.opens[1:]
    for k in range(2, min(longest, len(hashes)) + 1):
        run = _stirred((run[:-1] * np.uint64(_FACTOR)) ^ (hashes[k - 1:] + salt))
        on = on[:-1] & on[1:]
        if k == 2:
            on &= joins
        if k - 2 < len(filters):
            at = np.flatnonzero(on)
            on[at] = _passes(run[at], filters[k - 2], bits)
        yield run, on


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bit array (64-bit words) in which the low ``bits`` bits of every hash ``h`` are set."""
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.groupBy(F.shiftright(place, 6).cast("int").alias("at")) \
        .agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("set")).toPandas()   # at most 2^(bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64)
    return out.view(np.uint64)


def word_filter(words: DataFrame, bits: int) -> np.ndarray:
    """Filter of the counted words, of whatever language."""

    def hashes(batches):
        for batch in batches:
            yield _rows(["h"], [pa.int64()], word_hashes(*_places(batch.column(0))).view(np.int64))

    return bit_filter(words.where(F.col("word").isNotNull()).select(F.col("word").cast("binary"))
                      .mapInArrow(hashes, "h bigint"), bits)


def run_filter(texts: DataFrame, passing, filters: list, least: int, bits: int) -> np.ndarray:
    """Filter of the runs one word longer than those of the last filter (pairs, if there is none) that count
    ``least`` or more.  ``passing`` and ``filters`` are broadcast."""
    names, types = ["h", "n"], [pa.int64(), pa.int64()]
    size = len(filters) + 2

    def count(batches):
        tables = [f.value for f in filters]
        held: list[np.ndarray] = []
        waiting = 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return _rows(names, types, h.view(np.int64), n)

        for lang, data in _texts(batches):
            for words, here in word_stretches(data, size - 1):
                if len(words.start) < size:
                    continue
                *_, (run, on) = run_levels(words, lang, passing.value, tables, bits, size)
                held.append(run[:here][on[:here]])
                waiting += len(held[-1])
                if waiting > HELD_RUNS:
                    yield out()
                    held, waiting = [], 0
        if waiting:
            yield out()

    often = texts.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return bit_filter(often, bits)


def _joined(prefixes: pa.Array, tails: pa.Array) -> pa.Array:
    """Each prefix, a blank and its tail; the prefix alone where the tail is empty, the tail where the prefix is null."""
    tails = pc.if_else(pc.equal(pc.binary_length(tails), 0), pa.scalar(None, tails.type), tails)
    return pc.binary_join_element_wise(prefixes, tails, pa.scalar(b" ", prefixes.type), null_handling="skip")


#: Rows of subtrees: a bin of first words, a prefix of words (null: all of the bin), the rests of the suffixes behind
#: it, and their counts.
TREE = "lang string, bin int, prefix binary, tails array<binary>, counts array<bigint>"


def _first_words(tails: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of these runs of words, and where their first words end."""
    text, start, end = _places(tails)
    cut = pc.find_substring(tails, b" ").to_numpy(zero_copy_only=False).astype(np.int64)
    return text, start, end, np.where(cut < 0, end, start + cut)


def subtree_rows(langs: pa.Array, bins: np.ndarray, prefixes: pa.Array, tails: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """``TREE`` rows of these leaves, at most ``ROW_LEAVES`` a row."""
    codes = [bins, *(a.dictionary_encode().indices.to_numpy(zero_copy_only=False) for a in (langs, prefixes.fill_null(b"")))]
    order = np.lexsort(codes)
    fresh = np.concatenate(([True], np.logical_or.reduce([np.diff(c[order]) != 0 for c in codes])))
    first = np.flatnonzero(fresh)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    first = np.flatnonzero(place % ROW_LEAVES == 0)
    offsets = pa.array(np.append(first, len(order)), pa.int32())
    at = pa.array(order[first])
    return _rows(["lang", "bin", "prefix", "tails", "counts"],
                 [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())],
                 langs.take(at), bins[order[first]], prefixes.take(at).cast(pa.binary()),
                 pa.ListArray.from_arrays(offsets, tails.take(pa.array(order)).cast(pa.binary())),
                 pa.ListArray.from_arrays(offsets, pa.array(counts[order], pa.int64())))


def suffix_counts(texts: DataFrame, passing, filters: list, bits: int, longest: int) -> DataFrame:
    """The suffixes of two words and more that can hold a frequent phrase, counted per task, as subtrees (``TREE``)
    of bins of first words."""

    def out(lang, counted):
        suffixes = counted["value"].combine_chunks()
        text, start, _, cut = _first_words(suffixes)
        bins = (word_hashes(text, start, cut) % np.uint64(BINS)).astype(np.int32)
        return subtree_rows(pa.repeat(lang, len(bins)), bins, pa.nulls(len(bins), pa.large_binary()), suffixes,
                            counted["n"].to_numpy())

    def count(batches):
        tables = [f.value for f in filters]
        tally = Tally()
        for lang, data in _texts(batches):
            for words, here in word_stretches(data, longest - 1):
                more = np.zeros(len(words.start), np.int64)      # words of the suffix behind each word
                for _, on in run_levels(words, lang, passing.value, tables, bits, longest):
                    more[:len(on)] += on
                first = np.flatnonzero(more[:here])
                if len(first):
                    tally.add(lang, words.runs(first, first + more[first]))
            for done in tally.over():
                yield out(*done)
        for done in tally.rest():
            yield out(*done)

    return texts.mapInArrow(count, TREE)


def leaves(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of ``TREE`` rows, the tails one by one: their row, themselves, their counts."""
    tails, counts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                     for c in (table.column("tails"), table.column("counts")))
    row = np.repeat(np.arange(len(tails)), pc.list_value_length(tails).to_numpy(zero_copy_only=False))
    return row, tails.flatten(), counts.flatten().to_numpy()


def deepened(trees: DataFrame) -> DataFrame:
    """The same leaves under prefixes one word longer; suffixes that are a whole prefix stay under it."""

    def split(batches):
        for batch in batches:
            row, tails, counts = leaves(batch)
            if not len(row):
                continue
            text, start, end, cut = _first_words(tails)
            langs, bins, prefix = (batch.column(c).take(pa.array(row)) for c in ("lang", "bin", "prefix"))
            yield subtree_rows(langs, bins.to_numpy(), _joined(prefix.cast(pa.large_binary()), _slices(text, start, cut)),
                               _slices(text, np.minimum(cut + 1, end), end), counts)

    return trees.mapInArrow(split, TREE)


def grouped(trees: DataFrame, longest: int, budget: int) -> DataFrame:
    """Vertical partitioning: splits bins and prefixes with too many leaves, adds ``depth`` (words of a row's prefix) and ``grp``."""
    n_leaves = F.sum(F.size("tails"))
    n_groups = max(1, -(-(trees.agg(n_leaves).first()[0] or 0) // budget))
    light, x, depth = [], trees, 0
    while depth < longest:
        heavy = x.groupBy("lang", "bin", "prefix").agg(n_leaves.alias("_n")).where(F.col("_n") > budget) \
            .select(F.col("lang").alias("_l"), F.col("bin").alias("_b"), F.col("prefix").alias("_p"), F.lit(True).alias("_heavy"))
        heavy = written_table(heavy, "heavy-prefixes")
        if heavy.isEmpty():
            break
        x = x.join(bounded_broadcast(heavy), (F.col("lang") == F.col("_l")) & (F.col("bin") == F.col("_b"))
                   & F.col("prefix").eqNullSafe(F.col("_p")), "left")
        light.append(x.where(F.col("_heavy").isNull()).select(*trees.columns, F.lit(depth).alias("depth")))
        x = written_table(deepened(x.where(F.col("_heavy")).select(*trees.columns)), "phrase-subtrees")
        depth += 1
    x = x.withColumn("depth", F.lit(depth))
    for y in light:
        x = x.unionByName(y)
    return x.withColumn("grp", F.pmod(F.xxhash64("lang", "bin", "prefix"), F.lit(n_groups)).cast("int"))


def leaf_matrix(langs: pa.Array, suffixes: pa.Array, longest: int) -> np.ndarray:
    """One row a suffix: codes of its language and of its words, -1 behind its end."""
    lists = pc.split_pattern(suffixes, " ")
    words = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    leaf = np.full((len(suffixes), 1 + longest), -1, np.int32)
    leaf[:, 0] = langs.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.cumsum(length) - length
    leaf[np.repeat(np.arange(len(length)), length), 1 + np.arange(len(words)) - np.repeat(first, length)] = words
    return leaf


def subtree_counts(leaf: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorts the leaves and reads off each depth from 2 words: (depth, a leaf below each node, the node's total)."""
    order = np.lexsort(leaf.T[::-1])
    leaf, total = leaf[order], counts[order]
    for depth in range(2, leaf.shape[1]):
        deep = np.flatnonzero(leaf[:, depth] >= 0)
        if not len(deep):
            return
        part = leaf[deep, :depth + 1]
        first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]).any(axis=1))))
        yield depth, order[deep[first]], np.add.reduceat(total[deep], first)


def phrase_counts(trees: DataFrame, least: int, longest: int, budget: int) -> DataFrame:
    """``(lang, phrase, size, f)`` of all phrases of 2 to ``longest`` words found ``least`` times."""
    x = grouped(trees, longest, budget)
    names = ["lang", "phrase", "size", "f"]
    types = [pa.string(), pa.binary(), pa.int32(), pa.int64()]

    def build(table: pa.Table) -> pa.Table:
        row, tails, counts = leaves(table)
        langs, prefix = (table.column(c).combine_chunks().take(pa.array(row)) for c in ("lang", "prefix"))
        suffix = _joined(prefix, tails)
        filed = table.column("depth").to_numpy()[row]
        out = []
        for depth, leaf, total in subtree_counts(leaf_matrix(langs, suffix, longest), counts):
            # a node at or below the prefix it is filed under is whole here; one above it is a part
            keep = (total >= least) | (filed[leaf] > depth)
            at = pa.array(leaf[keep])
            phrases = [b" ".join(s.split(b" ", depth)[:depth]) for s in suffix.take(at).to_pylist()]
            out.append(_rows(names, types, langs.take(at), phrases, [depth] * len(phrases), total[keep]))
        return pa.Table.from_batches(out, schema=pa.schema(list(zip(names, types))))

    parts = x.select("grp", *trees.columns, "depth").groupBy("grp") \
        .applyInArrow(build, "lang string, phrase binary, size int, f bigint") \
        .withColumn("phrase", F.col("phrase").cast("string"))
    return parts.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def mine(docs: DataFrame, *, least: int = 30, longest: int = 4, share: tuple[int, int] = (80, 100), scale: int = 2_000_000,
         top: int = 2000, lang_col: str = "lang", text_col: str = "text", budget: int = GROUP_ROWS,
         filter_bits: int = FILTER_BITS) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of 2 to ``longest`` words with at least ``least`` occurrences scores its lowest
    ``floor(scale * a / (l + r))`` over all cuts in two; it goes if a longer candidate around it has at
    least ``share`` of its occurrences.
    """
    if longest < 2 or least < 1 or not 6 <= filter_bits <= 32:
        raise ValueError("longest starts at 2, least at 1; filter_bits lie between 6 and 32")
    spark = docs.sparkSession
    ready_python(spark)
    use_query_conf(spark)
    texts = _input(docs, lang_col, text_col)
    words = written_table(word_counts(texts, least).withColumn("word", F.col("word").cast("string")), "phrase-words")
    passing = spark.sparkContext.broadcast(word_filter(words, filter_bits))
    filters: list = []
    for _ in range(2, longest):
        filters.append(spark.sparkContext.broadcast(run_filter(texts, passing, filters, least, filter_bits)))
    trees = written_table(suffix_counts(texts, passing, filters, filter_bits, longest), "phrase-suffixes")
    found = written_table(phrase_counts(trees, least, longest, budget), "phrases")

    parts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf")) \
        .unionByName(words.where(F.col("word").isNotNull()).select("lang", F.col("word").alias("part"), F.col("f").alias("pf")))
    cut = found.select("lang", "phrase", "size", F.col("f").alias("a"),
                       F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")) \
        .withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    scored = cut.join(parts.select("lang", F.col("part").alias("first"), F.col("pf").alias("l")), ["lang", "first"]) \
        .join(parts.select("lang", F.col("part").alias("rest"), F.col("pf").alias("r")), ["lang", "rest"]) \
        .withColumn("score", F.expr(f"(cast({scale} as decimal(38,0)) * a) div (l + r)").cast("bigint"))
    best = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # a longer candidate holds one that is one word longer, so the next size up decides
    longer = found.where("size > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array(
        F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left") \
        .where(F.col("longer").isNull() | F.expr(
            f"cast({share[1]} as decimal(20,0)) * longer < cast({share[0]} as decimal(20,0)) * a"))
    sizes = words.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))   # one row a language
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score") \
        .withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top) \
        .join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
