"""Importance resampling towards a target distribution, with hashed word runs.

Features of a text are its runs of 1 to ``order`` words.  A run's bucket is the CRC-32 of its UTF-8
bytes (words joined by one blank) modulo ``buckets``.  A CRC goes on from a state, so a run's
checksum is its first words' state taken further over a blank and the last word.

1. *Head.*  A merged heavy-hitter summary over all rows names the most frequent words and pairs (at
   most ``head`` of each, whatever the corpus).  They go to the executors with their exact CRC states:
   a word's or pair's checksum is then one look-up.
2. *Totals.*  Every run of every text counts in one array of ``buckets`` numbers a task, head runs through
   the table and tail runs through a direct CRC; the arrays are added up.  The head decides only the
   speed: totals are exact with any head, an empty one too.
3. *Scores.*  Gains of the buckets (a fixed-size table) give each text its weight, a keyed digest of the id
   its Gumbel noise; the highest scores are drawn.

Ranks come from a histogram of the integer scores (its size is bounded by what a double's logarithm
can give: some 120,000 values) and prefix sums inside a score, so no task sees all drawn rows.

Defined results: null and empty texts have no feature, weight 0; a null id hashes as the empty text
and comes after all other ids in ties; repeated rows count each and get ranks of their own; an empty
corpus or an empty target gives no rows or gains against nothing; columns beyond id and text
are not looked at, whatever their names.  Ids are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import join_null_safe, prefix_sums
from ..session import use_query_conf
from .common import quoted, ready_python, written_table

#: Most frequent words and pairs, each, that get a look-up entry (some 10 MB on an executor).
HEAD = 65_536
#: Bytes of a text looked at together; words and runs that cross a border are whole.
STRETCH = 1 << 20
#: Rows that one row of equal rows becomes at a time when they are written out again.
CHUNK = 10_000
ID_LAST = (1 << 63) - 1


def _classes() -> bytes:
    """Byte table: A-Z to a-z; digits, a-z and bytes from 0x80 stay; all else separates words."""
    keep = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))


CLASSES = _classes()


def stretches(text: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of a text, a bounded stretch at a time."""
    data = text.translate(CLASSES)
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        words = data[at:end].split()
        if words:
            yield words
        at = end


class States(dict):
    """CRC states of head features; a feature that is not among them is computed and not kept."""

    def __missing__(self, feature: bytes) -> int:
        return crc32(feature)


def run_states(words: list[bytes], order: int, head_words: States, head_pairs: dict, fresh: int) -> np.ndarray:
    """CRC states of all runs of 1 to ``order`` words that end at or after word number ``fresh``."""
    last = list(map(head_words.__getitem__, words))
    out = [last[fresh:]]
    for n in range(2, order + 1):
        if n == 2:
            nxt = []
            for state, a, b in zip(last, words, words[1:]):
                known = head_pairs.get((a, b)) if head_pairs else None
                nxt.append(crc32(b" " + b, state) if known is None else known)
        else:
            nxt = [crc32(b" " + b, state) for state, b in zip(last, words[n - 1:])]
        last = nxt
        out.append(last[max(0, fresh - n + 1):])
    return np.fromiter((s for part in out for s in part), np.int64)


def text_buckets(text: bytes | None, order: int, buckets: int, head_words: States,
                 head_pairs: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the runs that end in them) for each stretch of a text."""
    carry: list[bytes] = []
    for words in stretches(text or b""):
        both = carry + words
        yield len(words), run_states(both, order, head_words, head_pairs, len(carry)) % buckets
        carry = both[len(both) - (order - 1):] if order > 1 else []


def _thin(counts: Counter, limit: int) -> None:
    """Misra-Gries step: lower all counts by that of the first feature that has to go."""
    if len(counts) <= 8 * limit:
        return
    kept = nlargest(4 * limit + 1, counts.values())
    cut = kept[-1]
    for k in [k for k, v in counts.items() if v <= cut]:
        del counts[k]
    for k in counts:
        counts[k] -= cut


def head_features(docs: DataFrame, text_col: str, order: int, limit: int) -> tuple[dict, dict]:
    """CRC states of the most frequent words and pairs of all rows, at most ``limit`` of each.  Every
    task keeps a bounded summary; the summaries are added up."""
    if limit <= 0:
        return {}, {}

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counter(), Counter()]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                last: list[bytes] = []
                for words in stretches(text or b""):
                    found[0].update(words)
                    if order > 1:
                        both = last + words
                        found[1].update(map(b" ".join, zip(both, both[1:])))
                        last = both[-1:]
                    for c in found:
                        _thin(c, limit)
        for size, c in enumerate(found, 1):
            top = nlargest(limit, c.items(), key=lambda kv: kv[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * len(top), pa.int32()), pa.array([k for k, _ in top], pa.binary()),
                 pa.array([v for _, v in top], pa.int64())], names=["size", "feature", "n"])

    parts = docs.select(F.col(quoted(text_col)).cast("binary").alias("t")) \
        .mapInArrow(summarise, "size int, feature binary, n bigint")
    merged = parts.groupBy("size", "feature").agg(F.sum("n").alias("n"))
    words: dict = {}
    pairs: dict = {}
    for size in range(1, min(order, 2) + 1):
        rows = merged.where(F.col("size") == size).orderBy(F.desc("n"), "feature").limit(limit).collect()
        for r in rows:
            feature = bytes(r["feature"])
            if size == 1:
                words[feature] = crc32(feature)
            else:
                pairs[tuple(feature.split(b" "))] = crc32(feature)
    return words, pairs


def bucket_totals(docs: DataFrame, text_col: str, order: int, buckets: int, head) -> np.ndarray:
    """Exact count of features in each bucket over all rows: one array a task, added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = head.value
        words = States(words)
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, hit in text_buckets(text, order, buckets, words, pairs):
                    total += np.bincount(hit, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())],
                                         names=["bucket", "n"])

    rows = docs.select(F.col(quoted(text_col)).cast("binary").alias("t")) \
        .mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket, in doubles."""
    b = len(raw)
    s_all, t_all = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * (s_all + b)) / (float(s + 1) * (t_all + b))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, id_col: str, text_col: str, order: int, head, gains: np.ndarray) -> DataFrame:
    """One row a document: its id as ``_id``, words, features and the floored mean gain of its features."""
    gain = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = head.value
        words, table = States(words), gain.value
        for batch in batches:
            n_words, n_features, mean = [], [], []
            for text in batch.column(1).to_pylist():
                n = features = total = 0
                for new, hit in text_buckets(text, order, len(table), words, pairs):
                    n += new
                    features += len(hit)
                    total += int(table[hit].sum())
                n_words.append(n)
                n_features.append(features)
                mean.append(total // features if features else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, mean)]],
                names=["_id", "n_words", "n_features", "weight"])

    schema = T.StructType([T.StructField("_id", T.LongType())]
                          + [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")])
    return docs.select(F.col(quoted(id_col)).cast("bigint").alias("_id"),
                       F.col(quoted(text_col)).cast("binary").alias("_text")).mapInArrow(weigh, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 8 hex digits of sha256("<seed>:<id>")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Ranks the ``floor(share * N)`` best of the N rows with ``eligible``, by score from the highest,
    then by id.  ``scored`` has ``_id, n_words, n_features, weight, score, eligible``; equal rows are kept as one
    row with their number until the end."""
    cols = ["_id", "n_words", "n_features", "weight", "score", "eligible"]
    g = written_table(scored.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
                      .withColumn("_key", F.coalesce("_id", F.lit(ID_LAST))), "importance-scores")
    fit = g.where("eligible")
    sizes = g.agg(F.sum(F.when(F.col("eligible"), F.col("n"))).alias("fit"), F.max("n").alias("most")).first()
    drawn = share[0] * (sizes["fit"] or 0) // share[1]
    # a histogram over integer scores: bounded by the range of the logarithms, not by the rows
    above = prefix_sums(fit.groupBy("score").agg(F.sum("n").alias("n")), "score", ["n"], descending=True) \
        .where(F.col("n_below") < drawn).select("score", F.col("n_below").alias("_above"))
    heads = fit.join(F.broadcast(above), "score")
    ids = prefix_sums(heads.groupBy("score", "_key").agg(F.sum("n").alias("n"), F.max("_above").alias("_above")),
                      "_key", ["n"], ["score"]).select("score", "_key", (F.col("_above") + F.col("n_below")).alias("_first"))
    same_id = Window.partitionBy("score", "_key").orderBy("n_features", "n_words", F.col("_id").isNull()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    inside = fit.select(*cols, "_key", "n", F.coalesce(F.sum("n").over(same_id), F.lit(0)).alias("_inside"))
    ranked = join_null_safe(inside, ids, ["score", "_key"], "left") \
        .select(*cols, "n", (F.col("_first") + F.col("_inside")).alias("_first"))
    both = ranked.unionByName(g.where(~F.col("eligible")).select(*cols, "n", F.lit(None).cast("bigint").alias("_first")))
    if (sizes["most"] or 0) > 1:
        # equal rows again, in two steps so that no array is long and the second step can spread
        step = both.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1,
                                                     F.lit(CHUNK).cast("bigint"))).alias("_from"))
        if sizes["most"] > CHUNK:
            step = step.repartition(*[F.col(c) for c in cols], "_from")
        both = step.select("*", F.explode(F.sequence(
            "_from", F.least(F.col("_from") + (CHUNK - 1), F.col("n") - 1))).alias("_nth"))
    else:
        both = both.withColumn("_nth", F.lit(0).cast("bigint"))
    rank = F.col("_first") + F.col("_nth") + 1
    return both.select(*cols, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, targets: DataFrame, *, order: int = 1, buckets: int = 10_000, min_words: int = 20,
             share: tuple[int, int] = (10, 100), seed: int = 2024, head: int = HEAD, id_col: str = "doc_id",
             text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its features, weight, score and rank (null where it is not drawn):
    columns ``id_col, n_words, n_features, weight, score, rank``, all long."""
    if order < 1 or buckets < 1:
        raise ValueError("order and buckets start at 1")
    spark = docs.sparkSession
    ready_python(spark)
    use_query_conf(spark)
    table = spark.sparkContext.broadcast(head_features(docs, text_col, order, head))
    raw = bucket_totals(docs, text_col, order, buckets, table)
    target = bucket_totals(targets, target_text_col, order, buckets, table)
    weighed = weights(docs, id_col, text_col, order, table, bucket_gains(raw, target))
    scored = weighed.select("*", (F.col("weight") + gumbel(F.col("_id"), seed)).alias("score"),
                            (F.col("n_words") >= min_words).alias("eligible"))
    return draw(scored, share).select(F.col("_id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
