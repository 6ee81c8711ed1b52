"""Language identification: spans of mixed-language text by Viterbi over per-word scores.

Script ranges say which languages a word can be in: a language is a candidate for a script
when at least ``SCRIPT_SHARE`` of its training letters are in it (a script no language uses
leaves all of them).  A word's score in a language is the sum of the log probabilities of
its letter trigrams (hashed into a table of ``2**TABLE_BITS`` cells, trained here).  The Viterbi path
through the words of a text pays ``SWITCH`` nats for every change of language; its runs are the
spans, and the language with most letters is the text's.

The path is exact and takes few vector steps whatever the text's length: texts are cut into
segments of ``SEGMENT`` words, all segments move together from every possible language before
them, and the segments of a text are then chained.

Training counts are made by Spark over a sample of at most about ``TRAIN_DOCS`` labelled texts of each
language (drawn by a hash of doc_id; the bound is a parameter); the model's size depends on the number
of languages only.

Defined results: a null text or a text without a letter is ``und`` with score 0 and no span; equal
counts go to the language first in code point order; without any labelled text every result is
``und``; repeated rows stay; extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import pieces, ready_python

TABLE_BITS = 16
TRAIN_DOCS = 4000
SWITCH = 12.0
SCRIPT_SHARE = 0.01
SEGMENT = 48
CHUNK_CHARS = 1_000_000
UNKNOWN = "und"

#: First code points of blocks and the script used there (0: any other).
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB10, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
_LETTER: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """Whether each code point is a letter, made once in each process."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Words:
    """Words (runs of letters) of several texts laid end to end."""

    cells: np.ndarray     # table cell of the trigram around each letter
    first: np.ndarray     # index into ``cells`` of each word's first letter
    script: np.ndarray    # script of each word's first letter
    text: np.ndarray      # text each word is in
    place: np.ndarray     # place of the word's first letter in its (lower-cased) text

    @property
    def letters(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.cells)))


def words_of(texts: list[str]) -> Words:
    parts = [code_points(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    gap = np.zeros(1, np.uint32)
    chars = np.concatenate([gap] + [x for p in parts for x in (p, gap)])    # a gap stands between texts
    starts = np.cumsum(sizes + 1) - sizes                                   # of each text in ``chars``
    letter = is_letter()[chars]
    chars = np.where(letter, chars, np.uint32(0))
    at = np.flatnonzero(letter)
    c = chars.astype(np.uint32)
    mixed = c[at - 1] * np.uint32(0x9E3779B1) + c[at] * np.uint32(0x85EBCA77) + c[at + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    cells = (mixed >> np.uint32(32 - TABLE_BITS)).astype(np.int32)
    first = np.flatnonzero(~letter[at - 1])
    begins = at[first]
    text = np.searchsorted(starts, begins, side="right") - 1
    script = _SCRIPT_OF[np.searchsorted(_STARTS, chars[begins], side="right") - 1]
    return Words(cells, first, script, text, begins - starts[text])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray       # cells x languages, log probabilities
    allowed: np.ndarray     # scripts x languages

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray]) -> Model:
        langs = sorted(counts)
        n = np.stack([counts[x] for x in langs], 1).astype(np.float64) if langs else np.zeros((1 << TABLE_BITS, 0))
        n += 0.5
        s = np.stack([scripts[x] for x in langs], 1).astype(np.float64) if langs else np.zeros((len(SCRIPTS), 0))
        allowed = s >= SCRIPT_SHARE * np.maximum(1, s.sum(0))
        allowed[~allowed.any(1)] = True
        return cls(langs, np.log(n / n.sum(0)).astype(np.float32), allowed)

    def scores(self, w: Words) -> np.ndarray:
        """words x languages; far below the others where the script rules a language out."""
        s = np.add.reduceat(self.table[w.cells], w.first, axis=0) if len(w.first) else np.zeros((0, len(self.langs)))
        s = s - s.max(1, keepdims=True, initial=-np.inf)
        return np.where(self.allowed[w.script], s, s - np.float32(1e4)).astype(np.float32)


def viterbi(scores: np.ndarray, text: np.ndarray, switch: float = SWITCH, segment: int = SEGMENT) -> np.ndarray:
    """Best label of each word; ``text`` (ascending) says which words are one sequence.  Ties
    keep the label of the word before, then the smaller label."""
    n, k = scores.shape
    if n == 0 or k == 0:
        return np.zeros(n, np.int64)
    new = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    length = np.diff(np.append(new, n))
    per = -(-length // segment)                              # segments of each text
    seg_text = np.repeat(np.arange(len(new)), per)
    nth = np.arange(len(seg_text)) - np.repeat(np.cumsum(per) - per, per)
    seg_from = new[seg_text] + nth * segment
    seg_len = np.minimum(segment, length[seg_text] - nth * segment)
    order = np.argsort(-seg_len, kind="stable")
    seg_from, seg_len = seg_from[order], seg_len[order]
    total = len(seg_from)
    # best[s, i, j]: best score in segment s that ends in j when i stood before it
    best = np.full((total, k, k), -switch, np.float32)
    best[:, np.arange(k), np.arange(k)] = 0
    back = np.zeros((min(segment, int(length.max())), total, k, k), np.int8 if k < 128 else np.int16)
    own = np.arange(k)
    for t in range(int(seg_len[0])):
        m = int(np.searchsorted(-seg_len, -t, side="left"))   # segments longer than t
        if t:
            b = best[:m]
            top = b.argmax(2)
            change = np.take_along_axis(b, top[:, :, None], 2) - switch
            stay = b >= change
            back[t, :m] = np.where(stay, own, top[:, :, None])
            best[:m] = np.where(stay, b, change)
        best[:m] += scores[seg_from[:m] + t][:, None, :]
    # chain the segments of each text: state before each segment
    where = np.empty(total, np.int64)
    where[order] = np.arange(total)
    head = np.cumsum(per) - per
    by_length = np.argsort(-per, kind="stable")
    depth = int(per.max())
    state = np.zeros((len(new), k), np.float32)
    came = np.zeros((total, k), np.int64)                     # label at the end of the segment before
    for t in range(depth):
        m = int(np.searchsorted(-per[by_length], -t, side="left"))
        txt = by_length[:m]
        seg = where[head[txt] + t]
        # before the first segment every label is free (state 0)
        through = state[txt][:, :, None] + best[seg]
        came[seg] = through.argmax(1)
        state[txt] = through.max(1)
    label = np.zeros(n, np.int64)
    end = np.zeros(len(new), np.int64)
    before = np.zeros(total, np.int64)                        # label before each segment
    last = np.zeros(total, np.int64)                          # label at its end
    end[:] = state.argmax(1)
    for t in range(depth - 1, -1, -1):
        m = int(np.searchsorted(-per[by_length], -t, side="left"))
        txt = by_length[:m]
        seg = where[head[txt] + t]
        last[seg] = end[txt]
        before[seg] = came[seg, end[txt]]
        end[txt] = before[seg]
    now = last.copy()
    for t in range(int(seg_len[0]) - 1, -1, -1):
        m = int(np.searchsorted(-seg_len, -t, side="left"))
        label[seg_from[:m] + t] = now[:m]
        if t:
            now[:m] = back[t, np.arange(m), before[:m], now[:m]]
    return label


def label_texts(model: Model, texts: list[str], with_spans: bool) -> tuple[list[str], list[float], list[list]]:
    w = words_of(texts)
    k = len(model.langs)
    best = viterbi(model.scores(w), w.text) if k else np.zeros(0, np.int64)
    n = len(texts)
    weight = np.zeros((n, max(1, k)))
    if k:
        np.add.at(weight, (w.text, best), w.letters)
    total = weight.sum(1)
    top = weight.argmax(1)
    share = weight[np.arange(n), top] / np.maximum(total, 1)
    names = [model.langs[t] if s else UNKNOWN for t, s in zip(top, total)]
    spans: list[list] = [[] for _ in range(n)] if with_spans else []
    if with_spans and k and len(best):
        edge = np.flatnonzero(np.append(True, (w.text[1:] != w.text[:-1]) | (best[1:] != best[:-1])))
        stop = np.append(edge[1:], len(best)) - 1
        for i, j in zip(edge, stop):
            spans[w.text[i]].append({"start": int(w.place[i]), "end": int(w.place[j] + w.letters[j]),
                                     "lang": model.langs[best[i]]})
    return names, np.where(total > 0, share, 0.0).tolist(), spans


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = TRAIN_DOCS) -> Model:
    """Trigram and script counts of each language over a sample of about ``per_language`` texts of it."""
    ready_python(labelled.sparkSession)
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()) \
        .select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}   # one row a language
    if not sizes:
        return Model.fit({}, {})
    cut = F.lit(1_000_000)
    for name, n in sizes.items():
        if n > per_language:
            cut = F.when(F.col("l") == name, int(1_000_000 * per_language / n)).otherwise(cut)
    drawn = known.where(F.pmod(F.xxhash64("i", F.lit("langid")), F.lit(1_000_000)) < cut).select("t", "l")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for frame in frames:
            for name, part in frame.groupby("l"):
                texts = part["t"].tolist()
                for a, b in pieces(map(len, texts), CHUNK_CHARS):
                    w = words_of(texts[a:b])
                    cells[name] = cells.get(name, 0) + np.bincount(w.cells, minlength=1 << TABLE_BITS)
                    scripts[name] = scripts.get(name, 0) + np.bincount(w.script, w.letters, len(SCRIPTS)).astype(np.int64)
        for name in cells:
            for kind, v in (("cell", cells[name]), ("script", scripts[name])):
                at = np.flatnonzero(v)
                yield pd.DataFrame({"l": name, "kind": kind, "at": at, "n": v[at]})

    found = drawn.mapInPandas(count, "l string, kind string, at bigint, n bigint") \
        .groupBy("l", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    counts = {x: np.zeros(1 << TABLE_BITS, np.int64) for x in sizes}
    scripts = {x: np.zeros(len(SCRIPTS), np.int64) for x in sizes}
    for (name, kind), part in found.groupby(["l", "kind"]):
        (counts if kind == "cell" else scripts)[name][part["at"].to_numpy()] = part["n"].to_numpy()
    return Model.fit(counts, scripts)


def identify(docs: DataFrame, model: Model, text: str = "text", with_spans: bool = False,
             names: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """Adds the predicted language, the share of letters in its spans and, where asked for, the
    spans (start, end: places in the lower-cased text).  Only the text is read."""
    ready_python(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame[text]]
            for a, b in pieces(map(len, texts), CHUNK_CHARS):
                out = frame.iloc[a:b].copy()
                lang, score, spans = label_texts(shared.value, texts[a:b], with_spans)
                out[names[0]], out[names[1]] = lang, score
                if with_spans:
                    out[names[2]] = pd.Series(spans, index=out.index, dtype=object)
                yield out

    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("lang", StringType())])
    added = [StructField(names[0], StringType()), StructField(names[1], DoubleType()), StructField(names[2], ArrayType(span))]
    return docs.mapInPandas(run, StructType([*docs.schema.fields, *added[:2 + with_spans]]))
