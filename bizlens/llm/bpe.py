"""Byte-level BPE encoding and decoding over a contiguous rank array.

Each distinct word of a batch is held as a row of part ids (the parts between its
boundaries) and a parallel row of the ranks of adjacent parts.  A step scans every
row for its minimum rank, deletes that boundary (the tail moves one place to the
left) and refreshes the two ranks beside it; rows without a mergeable pair are done.
All short words of a batch move together as numpy rows; a word of more than
``SHORT`` bytes goes through a heap over the same ranks, so its cost is n log n.

Defined results: a null or empty text has no ids and decodes to the empty text; the
vocabulary's added tokens (``<|endoftext|>``) written in a text become their ids, as
the tokenizer file says; repeated rows and repeated doc_ids stay one row each; extra
columns are ignored by ``tokenize_documents``'s digest and may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ready_python

SHORT = 64
CHUNK_CHARS = 2_000_000      # characters whose distinct words are encoded together
CACHE_WORDS = 400_000        # words kept encoded between chunks of one task
BLOCK = 4096                 # words moved together: their rows stay in the processor's cache
_NONE = np.int32(2**31 - 1)

#: Fixed pattern of the byte-level pre-tokenizer of the tokenizer file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """Merge ranks, byte parts and added tokens of one tokenizer file."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        of_symbol = {s: b for b, s in enumerate(symbols)}
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.size = size
        self.piece = [b""] * size
        for token, i in vocab.items():
            self.piece[i] = bytes(of_symbol[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.piece[i] = token.encode()
        self.byte_id = np.array([vocab[s] for s in symbols], np.int32)
        keys, ranks, joined = [], [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[a] * size + vocab[b])
            ranks.append(rank)
            joined.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int32)[order]
        self.joined = np.array(joined, np.int32)       # by rank
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") \
            if self.added else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, ``_NONE`` where it has no merge (or a part is absent: -1)."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def encode_short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of 1 to ``SHORT`` bytes, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        for start in range(0, len(order), BLOCK):
            row = order[start:start + BLOCK]
            width = int(lengths[row[-1]])
            inside = np.arange(width) < lengths[row][:, None]
            part = np.full((len(row), width + 1), -1, np.int32)
            part[:, :width][inside] = self.byte_id[np.frombuffer(b"".join([words[i] for i in row]), np.uint8)]
            rank = self.rank(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(len(row), width)
            while len(row):
                at = rank.argmin(1)
                here = np.arange(len(row))
                best = rank[here, at]
                done = best == _NONE
                if done.any():
                    ended = part[done]
                    counts = (ended >= 0).sum(1) * 4
                    packed, stop = ended[ended >= 0].tobytes(), np.cumsum(counts).tolist()
                    for i, a, b in zip(row[done].tolist(), [0, *stop], stop):
                        out[i] = packed[a:b]
                    keep = ~done
                    row, part, rank, at, best = row[keep], part[keep], rank[keep], at[keep], best[keep]
                    if not len(row):
                        break
                    here = np.arange(len(row))
                # delete the boundary after part ``at``: the tails move one place left, rows get shorter
                tail = np.arange(rank.shape[1]) > at[:, None]
                part = np.where(tail, part[:, 1:], part[:, :-1])
                rank = np.where(tail[:, :-1], rank[:, 1:], rank[:, :-1])
                part[here, at] = self.joined[best]
                beside = np.maximum(at - 1, 0)
                new = self.rank(np.concatenate([part[here, at], part[here, beside]]),
                                np.concatenate([part[here, at + 1], part[here, at]]))
                rank[here, at] = new[:len(row)]
                before = at > 0
                rank[here[before], beside[before]] = new[len(row):][before]
        return out

    def encode_long(self, word: bytes) -> bytes:
        """The same merges for a long word: a heap of (rank, place) over linked parts."""
        part = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(np.array(part[:-1]), np.array(part[1:]))
        heap = [(int(r), i, part[i], part[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        alive = [True] * n

        def push(i: int) -> None:
            if i >= 0 and after[i] < n:
                r = int(self.rank(np.array([part[i]]), np.array([part[after[i]]]))[0])
                if r != _NONE:
                    heapq.heappush(heap, (r, i, part[i], part[after[i]]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or part[i] != a or after[i] >= n or part[after[i]] != b:
                continue
            j = after[i]
            part[i], alive[j], after[i] = int(self.joined[r]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            push(before[i])
        return np.array([p for p, a in zip(part, alive) if a], "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; added tokens stand alone."""
        if self.marks is None or not any(m in text for m in self.added):
            return self.split.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.marks.split(text)):
            out += [part] if k % 2 else self.split.findall(part)
        return out

    def encode(self, texts: list[str], cache: dict[str, bytes]) -> list[bytes]:
        """Ids of each text, packed; ``cache`` keeps encoded words between calls."""
        split = [self.words(t) for t in texts]
        fresh = set().union(*split).difference(cache) if split else set()
        short, long = [], []
        for w in fresh:
            if w in self.added:
                cache[w] = np.array([self.added[w]], "<u4").tobytes()
            else:
                (short if len(w.encode()) <= SHORT else long).append(w)
        cache.update(zip(short, self.encode_short([w.encode() for w in short])))
        for w in long:
            cache[w] = self.encode_long(w.encode())
        packed = [b"".join(map(cache.__getitem__, ws)) for ws in split]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        return packed

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.piece.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def tokenize(docs: DataFrame, tokenizer_path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Adds per row ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``ids``, an array,
    where asked for); the text column itself is not returned.  No shuffle: each task encodes its
    rows.  The tokenizer file is read on the driver and broadcast once (about 1.5 MB)."""
    spark = docs.sparkSession
    ready_python(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    others = [c for c in docs.columns if c != text]
    clash = {"n_tokens", "ids_sha256", "decoded_sha256", "ids"} & set(others)
    source = docs.select(*[c for c in others if c not in clash], F.coalesce(F.col(text), F.lit("")).alias(text))
    kept = [f for f in source.schema.fields if f.name != text]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, cache = Codec(definition.value), {}
        for frame in frames:
            texts = frame.pop(text).tolist()
            for a, b in pieces(map(len, texts), CHUNK_CHARS):
                packed = codec.encode(texts[a:b], cache)
                out = frame.iloc[a:b].copy()
                out["n_tokens"] = [len(p) // 4 for p in packed]
                out["ids_sha256"] = [hashlib.sha256(p).hexdigest() for p in packed]
                out["decoded_sha256"] = [hashlib.sha256(codec.decode(p).encode()).hexdigest() for p in packed]
                if with_ids:
                    out["ids"] = [np.frombuffer(p, "<u4").astype(np.int64) for p in packed]
                yield out

    ddl = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept]
    ddl += ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<bigint>"] * with_ids
    return source.mapInPandas(run, ", ".join(ddl))
