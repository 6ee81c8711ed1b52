"""Mixing sources to target weights by cube-method balanced sampling.

Targets share the total size of all documents among the sources by weight; no target is more
than ``CAP`` times its source's size, and what is over is shared again by weight until none is
above.  A source's rate (target / size) gives each of its documents floor(rate) copies for
certain and one more with the fractional inclusion probability.

Which documents get the extra copy is decided by the flight phase of the cube method: three
documents that are still undecided span a null space of the two balancing constraints (tokens
and documents: columns (1, size)); their probabilities move along it, up or down with
chances that keep every expectation, until one is 0 or 1.  Documents are dealt to blocks inside their source,
each block flies alone and leaves two documents undecided at most; what is left meets in
ever fewer blocks until one block a source is left, whose last two are landed near the token total.

All draws are hashes of the documents' keys, so reruns agree.

Defined results: a null or blank text has size 0 and takes nothing; sources without any word have
target 0; a null source is a source of its own, last in order; documents that agree in
source, doc_id and size (repeated rows, null ids) are decided together and the extra copies go
to the first of them; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ready_python, written_table

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 4096         # documents that fly together in the first round
FAN = 512            # blocks whose undecided documents meet in the next


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size)`` with one row a source -> adds ``target``.

    The level L at which the capped shares min(cap * size, weight * L) add up to the total is read off the
    sources in order of cap * size / weight: before the break all are capped, after it none."""
    n_th = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = reduce(lambda c, i: c.when(n_th % len(weights) == i, weights[i]), range(1, len(weights)),
                    F.when(n_th % len(weights) == 0, weights[0]))
    x = sizes.select("source", "source_size", weight.cast("double").alias("w")) \
        .withColumn("limit", F.col("source_size").cast("double") * cap)
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(every)
    x = x.withColumn("level", (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(from_here))
    # the first source that its level does not fill decides the level of all after it
    decided = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), "level"))) \
        .over(every)["level"]
    return x.select("source", "source_size",
                    F.when(F.col("limit") <= F.col("w") * decided, F.col("limit"))
                    .otherwise(F.col("w") * decided).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase over documents with probabilities ``p`` strictly inside (0, 1): the moved
    probabilities, of which two at most are still inside."""
    p = p.tolist()
    s = size.tolist()
    held: list[int] = []
    for nxt in range(len(p)):
        held.append(nxt)
        if len(held) < 3:
            continue
        i, j, k = held
        # null vector of the rows (1, 1, 1) and (s_i, s_j, s_k)
        u = (s[k] - s[j], s[i] - s[k], s[j] - s[i])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min((1 - p[x]) / c if c > 0 else p[x] / -c for x, c in zip(held, u) if c)
        down = min(p[x] / c if c > 0 else (1 - p[x]) / -c for x, c in zip(held, u) if c)
        step = up if draw[nxt] * (up + down) < down else -down
        rest = []
        for x, c in zip(held, u):
            v = p[x] + step * c
            p[x] = 0.0 if v < 1e-12 else 1.0 if v > 1 - 1e-12 else v
            if 0.0 < p[x] < 1.0:
                rest.append(x)
        if len(rest) == 3:        # rounding left all inside: settle the one nearest an end
            x = min(rest, key=lambda y: min(p[y], 1 - p[y]))
            p[x] = float(round(p[x]))
            rest.remove(x)
        held = rest
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Whole decisions for a source's last block: the documents still inside after the flight are
    rounded to the choice nearest the token total that ``p`` stands for; while that
    leaves a gap, the change of one decision, or the exchange of two, that narrows it most is made."""
    want = float((p * size).sum())
    inside = np.flatnonzero((moved > 0) & (moved < 1))
    best = None
    for choice in itertools.product((0.0, 1.0), repeat=len(inside)):
        x = moved.copy()
        x[inside] = choice
        gap = want - float((x * size).sum())
        if best is None or abs(gap) < abs(best[0]):
            best = (gap, x)
    gap, x = best
    for _ in range(len(p)):
        out, taken = np.flatnonzero(x == 0), np.flatnonzero(x == 1)
        change = np.where(x == 0, size, -size)
        i = int(np.abs(gap - change).argmin())
        options = [(abs(gap - change[i]), [i])]
        if len(out) and len(taken):
            out = out[np.argsort(size[out], kind="stable")]
            for shift in (-1, 0):
                at = np.clip(np.searchsorted(size[out], size[taken] + gap) + shift, 0, len(out) - 1)
                left = np.abs(gap - (size[out[at]] - size[taken]))
                k = int(left.argmin())
                options.append((left[k], [out[at[k]], taken[k]]))
        left, flip = min(options, key=lambda o: (o[0], -len(o[1])))
        if left >= abs(gap) - 0.5:
            break
        gap -= sum(change[f] for f in flip)
        x[flip] = 1 - x[flip]
    return x


def _unit_hash(*columns):
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)).cast("double") / float(1 << 40)


def cube(units: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``units``: source, doc_id, size, j (key of a unit), p (inclusion probability), n (units of the
    source).  Returns the key columns and ``extra`` (0 or 1)."""
    ready_python(units.sparkSession)
    schema = "source string, doc_id bigint, size bigint, j bigint, p double, n bigint"
    state = units.select("source", "doc_id", "size", "j", F.col("p").cast("double"), F.col("n").cast("bigint"))

    def fly(last: bool):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["turn", "doc_id", "size", "j"], kind="stable")
            p, size = frame["p"].to_numpy(np.float64), frame["size"].to_numpy(np.int64)
            moved = flight(p, size, frame["draw"].to_numpy())
            frame = frame.assign(p=landing(p, size, moved) if last else moved)
            return frame[["source", "doc_id", "size", "j", "p", "n"]]
        return run

    largest = state.agg(F.max("n")).first()[0] or 0
    decided, level, blocks = [], 0, max(1, -(-largest // block))
    while True:
        key = ["source", "doc_id", "size", "j"]
        # as many blocks as the source needs in this round
        own = F.greatest(F.lit(1), F.ceil(F.col("n") / float(block * fan ** level)))
        dealt = state.withColumn("block", F.pmod(F.xxhash64(*key, F.lit(level)), own)) \
            .withColumn("turn", _unit_hash(*key, F.lit("turn"), F.lit(level))) \
            .withColumn("draw", _unit_hash(*key, F.lit("draw"), F.lit(level)))
        last = blocks <= 1
        moved = dealt.groupBy("source", "block").applyInPandas(fly(last), schema)
        if last:
            decided.append(moved.select(*key, F.col("p").cast("int").alias("extra")))
            break
        moved = written_table(moved, "cube")
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        decided.append(moved.where(whole).select(*key, F.col("p").cast("int").alias("extra")))
        state = moved.where(~whole)
        blocks, level = -(-blocks // fan), level + 1
    return reduce(DataFrame.unionAll, decided)


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, doc_id, size, j, source_size, target, copies)``: one row a document, ``j`` numbers the
    documents that agree in source, doc_id and size."""
    sized = docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).cast("bigint").alias("doc_id"),
                        word_count(text).alias("size"))
    same = written_table(sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    per_source = same.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"),
                                            F.sum("m").alias("n"))
    aim = written_table(per_source.select("source", "n").alias("a").join(
        targets(per_source.select("source", "source_size")).alias("b"),
        F.col("a.source").eqNullSafe(F.col("b.source"))).select("b.*", "n"), "targets")
    units = same.join(aim.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s") \
        .withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m")))) \
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    # a rate that is a whole number but for rounding leaves nothing to draw
    units = units.withColumn("base", F.floor(F.col("rate") + 1e-9)) \
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("rate") - F.col("base"))).otherwise(F.lit(0.0)))
    units = units.withColumn("p", F.when(F.col("p") < 1e-9, F.lit(0.0)).otherwise(F.col("p")))
    drawn = written_table(cube(units.where("p > 0")), "drawn")
    extra = drawn.where("extra = 1").groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("e")) \
        .select(F.struct("source", "doc_id", "size").alias("k"), "e")
    keyed = units.join(extra, F.struct("source", "doc_id", "size").eqNullSafe(F.col("k")), "left")
    more = F.when(F.col("j") <= F.coalesce("e", F.lit(0)), 1).otherwise(0)
    return keyed.select("source", "doc_id", "size", "j", "source_size", "target",
                        F.when(F.col("size") > 0, F.col("base") + more).otherwise(F.lit(0)).cast("bigint").alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as the mix takes them: each row as often as it is taken, columns unchanged."""
    planned = plan(docs, doc_id, text, source)
    key = [F.col(source).cast("string").alias("s"), F.col(doc_id).cast("bigint").alias("d"), word_count(text).alias("z")]
    rows = docs.select(F.struct("*").alias("_mix_row"), F.struct(*key).alias("_mix_key"))
    # rows that agree in the key are numbered; the key is the document's id, so groups are small
    rows = rows.withColumn("_mix_j", F.row_number().over(
        Window.partitionBy("_mix_key").orderBy(F.xxhash64(F.col("_mix_row").getField(text)))).cast("bigint"))
    wanted = planned.where("copies > 0").select(
        F.struct(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z")).alias("_mix_k"),
        F.col("j").alias("_mix_n"), "copies")
    taken = rows.join(wanted, F.col("_mix_key").eqNullSafe(F.col("_mix_k")) & (F.col("_mix_j") == F.col("_mix_n")))
    return taken.select("_mix_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_mix_copy")) \
        .select("_mix_row.*")
