"""SimHash fingerprints and exact near-duplicate groups through vantage-point trees.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles.  Equal
fingerprints are one point.  The points are split by a vantage-point tree: a node holds a
vantage point and cuts Hamming distances from it into rings; by the triangle inequality a
pair within ``radius`` lies at distances from the vantage point that differ by ``radius`` at
most, so a point is *stored* in the ring it falls in and *asked* in every ring its interval
[d - radius, d + radius] meets.  The tree's upper levels (built on a bounded sample of the
points, which decides balance only, never results) give the shards; inside a shard the same
split goes on, one ring per distance, until few pairs are left, which are compared bit by bit.
A pair is looked for in one direction only (from the later shard to the earlier one).

A shard answers with one link from each point to the smallest point it is connected with in
that shard: as many rows as points, whatever the number of pairs, and no connection is lost.
Shards that hold very many points (a crowd around one text) are cut into blocks of stored and
of asking points, and every block pair is its own task.

Defined results: null or blank texts have no word, their fingerprint is zero and they link
like any other; texts with fewer words than a shingle are one shingle; repeated rows and equal
doc_ids stay one row each; a null doc_id is a row like others but never names a component that
holds another one; an empty table gives an empty result; extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType

from .common import ready_python, written_table
from .components import components

SAMPLE = 8192            # points the upper tree is built on
SHARD_POINTS = 64_000    # points stored in a block of a shard, about
RINGS = 8                # rings of a node of the upper tree at most: no more than it has shards
FEW_PAIRS = 1 << 18      # pairs compared without a further split
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SLICE = 1 << 15


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([hash_of(joined, seed)], np.uint64)
    else:
        ends = list(accumulate(map(len, words), lambda x, y: x + y + 1))
        starts = [0, *[e + 1 for e in ends[:-width]]]
        hashes = np.fromiter((hash_of(joined[a:b], seed) for a, b in zip(starts, ends[width - 1:])),
                             np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        part = hashes[i:i + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """``docs`` without its text column, plus ``_fp`` (bigint)."""
    ready_python(docs.sparkSession)
    source = docs.select(*[c for c in docs.columns if c != text], F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame.pop("_text")
            frame["_fp"] = np.array([fingerprint(t, width) for t in texts], np.int64)
            yield frame

    schema = StructType([*source.drop("_text").schema.fields, StructField("_fp", LongType())])
    return source.mapInPandas(run, schema)


def hamming(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points.view(np.uint64) ^ np.uint64(vantage & (2**64 - 1))).astype(np.int64)


# ---- upper tree -----------------------------------------------------------------

def build_tree(sample: np.ndarray, total: int, target: int) -> tuple[dict, int]:
    """Tree over a sample of ``total`` points whose leaves stand for about ``target`` points;
    leaves are numbered in order.  Returns the tree and the number of leaves."""
    per_point = max(1.0, total / max(1, len(sample)))
    leaves = 0

    def node(points: np.ndarray) -> dict:
        nonlocal leaves
        if len(points) * per_point > target and len(points) >= 4 * RINGS:
            # of a few candidates, the vantage point whose distances spread most
            step = max(1, len(points) // 16)
            vantage = int(max(points[::step][:16], key=lambda v: hamming(points, int(v)).std()))
            d = hamming(points, vantage)
            rings = min(RINGS, max(2, round(len(points) * per_point / target)))
            cuts = np.unique(np.quantile(d, np.arange(1, rings) / rings, method="lower"))
            ring = np.searchsorted(cuts, d, side="right")     # ring k: cuts[k-1] <= d < cuts[k]
            if ring.max() > ring.min():
                return {"vantage": vantage, "cuts": cuts, "rings": [node(points[ring == k]) for k in range(len(cuts) + 1)]}
        leaves += 1
        return {"leaf": leaves - 1}

    return node(np.sort(sample)), leaves


def place(tree: dict, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(home, asked_point, asked_leaf)``: the leaf of each point, and the leaves before or at
    its home that may hold a point within ``radius`` of it."""
    home = np.zeros(len(points), np.int64)
    who, where = [], []

    def down(node: dict, at: np.ndarray, stored: np.ndarray) -> None:
        if not len(at):
            return
        if "leaf" in node:
            home[at[stored]] = node["leaf"]
            who.append(at)
            where.append(np.full(len(at), node["leaf"], np.int64))
            return
        d = hamming(points[at], node["vantage"])
        own = np.searchsorted(node["cuts"], d, side="right")
        first = np.searchsorted(node["cuts"], d - radius, side="right")
        last = np.searchsorted(node["cuts"], d + radius, side="right")
        for k, child in enumerate(node["rings"]):
            meets = (first <= k) & (k <= last)
            down(child, at[meets], stored[meets] & (own[meets] == k))

    down(tree, np.arange(len(points)), np.ones(len(points), bool))
    if not who:
        return home, np.zeros(0, np.int64), np.zeros(0, np.int64)
    point, leaf = np.concatenate(who), np.concatenate(where)
    earlier = leaf <= home[point]
    return home, point[earlier], leaf[earlier]


# ---- inside a shard ---------------------------------------------------------------

def near_pairs(stored: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (stored, asked) within ``radius``, in parts, by a vantage-point descent."""
    todo = [(np.arange(len(stored)), np.arange(len(asked)))]
    while todo:
        s, q = todo.pop()
        if not len(s) or not len(q):
            continue
        if len(s) * len(q) <= FEW_PAIRS or len(s) < 16:
            step = max(1, FEW_PAIRS // len(s))
            for i in range(0, len(q), step):
                part = q[i:i + step]
                x, y = np.nonzero(np.bitwise_count(stored[s][:, None] ^ asked[part][None, :]) <= radius)
                if len(x):
                    yield s[x], part[y]
            continue
        vantage = int(stored[s[len(s) // 2]])
        ds, dq = hamming(stored[s], vantage), hamming(asked[q], vantage)
        if ds.min() == ds.max():      # one ring only (a few points all as far): no split possible
            close = np.abs(dq - ds[0]) <= radius
            half = len(s) // 2
            todo += [(s[:half], q[close]), (s[half:], q[close])]
            continue
        order_s, order_q = np.argsort(ds, kind="stable"), np.argsort(dq, kind="stable")
        s, ds, q, dq = s[order_s], ds[order_s], q[order_q], dq[order_q]
        for k in range(int(ds[0]), int(ds[-1]) + 1):
            a, b = np.searchsorted(ds, [k, k + 1])
            c, d = np.searchsorted(dq, [k - radius, k + radius + 1])
            if b > a and d > c:
                todo.append((s[a:b], q[c:d]))


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; the smallest index stays the root."""
    while len(a):
        a, b = find(parent, a), find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(stored: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A link from every connected point of the block to the smallest one of its group."""
    every = np.unique(np.concatenate([stored, asked]))
    s_at, q_at = np.searchsorted(every, stored), np.searchsorted(every, asked)
    parent = np.arange(len(every))
    for x, y in near_pairs(stored.view(np.uint64), asked.view(np.uint64), radius):
        unite(parent, s_at[x], q_at[y])
    root = find(parent, np.arange(len(every)))
    linked = np.flatnonzero(root != np.arange(len(every)))
    return every[linked], every[root[linked]]


def near_links(points: DataFrame, radius: int = 4, shard_points: int = SHARD_POINTS,
               sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) whose components are exactly those of all pairs of ``_fp`` values within
    ``radius`` bits.  ``points`` holds every distinct ``_fp`` once and is a written table."""
    spark = points.sparkSession
    total = points.count()
    if total < 2:
        return points.select(F.col("_fp").alias("a"), F.col("_fp").alias("b")).where("false")
    drawn = points.orderBy(F.xxhash64(F.col("_fp"), F.lit("tree"))).limit(sample).toPandas()["_fp"].to_numpy(np.int64)
    tree, leaves = build_tree(drawn, total, shard_points)
    shared = spark.sparkContext.broadcast(tree)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["_fp"].to_numpy(np.int64)
            home, who, leaf = place(shared.value, fp, radius)
            yield pd.DataFrame({"leaf": np.concatenate([home, leaf]), "_fp": np.concatenate([fp, fp[who]]),
                                "asks": np.repeat([False, True], [len(fp), len(who)])})

    dealt = written_table(points.mapInPandas(deal, "leaf bigint, _fp bigint, asks boolean"), "shards")
    # as many rows as leaves of the tree, which the sample bounds
    sizes = {(r["leaf"], r["asks"]): r["count"] for r in dealt.groupBy("leaf", "asks").count().collect()}
    blocks = [(i, max(1, round(sizes.get((i, False), 0) / shard_points)),
               max(1, round(sizes.get((i, True), 0) / (16 * shard_points)))) for i in range(leaves)]
    cut = spark.createDataFrame(blocks, "leaf bigint, n_stored int, n_asked int")
    mix = F.xxhash64(F.col("_fp"), F.lit("block"))
    tasks = dealt.join(F.broadcast(cut), "leaf").select(
        "leaf", "_fp", "asks",
        F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("n_stored") - 1))
                  .otherwise(F.array(F.pmod(mix, F.col("n_stored")).cast("int")))).alias("s"), "n_asked") \
        .select("leaf", "_fp", "asks", "s",
                F.explode(F.when(~F.col("asks"), F.sequence(F.lit(0), F.col("n_asked") - 1))
                          .otherwise(F.array(F.pmod(mix, F.col("n_asked")).cast("int")))).alias("q"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        fp, asks = frame["_fp"].to_numpy(np.int64), frame["asks"].to_numpy(bool)
        a, b = shard_links(fp[~asks], fp[asks], radius)
        return pd.DataFrame({"a": a, "b": b})

    return tasks.groupBy("leaf", "s", "q").applyInPandas(solve, "a bigint, b bigint")


def grouped(rows: DataFrame, radius: int = 4, shard_points: int = SHARD_POINTS, sample: int = SAMPLE) -> DataFrame:
    """``(point, component, component_id)`` for every distinct fingerprint of ``rows`` (doc_id, _fp; a
    written table): its group, and the smallest doc_id in the group."""
    points = written_table(rows.groupBy("_fp").agg(F.min("doc_id").alias("least")), "points")
    linked = components(near_links(points.select("_fp"), radius, shard_points, sample))
    named = points.join(linked, points["_fp"] == linked["node"], "left") \
        .select(points["_fp"].alias("point"), "least", F.coalesce("component", points["_fp"]).alias("component"))
    named = written_table(named, "named-points")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(smallest, "component").select("point", "component", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text",
                    **options) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row: the smallest doc_id of all rows
    reachable through fingerprints that differ in ``radius`` bits or fewer."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written_table(fingerprints(slim, "text", width), "fingerprints")
    groups = grouped(rows, radius, **options)
    return rows.join(groups, rows["_fp"] == groups["point"], "left") \
        .select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text",
             **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest doc_id (a null
    one last); where rows share it, the first by (fingerprint, hashes of the row); of equal rows
    one.  Columns are unchanged.

    Only ids, fingerprints and hashes are grouped; the texts meet the decisions in one join."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    hashes = [F.xxhash64(*plain).alias("_row_1"), F.xxhash64(F.lit("second"), *plain).alias("_row_2")]
    rows = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *hashes), "text", width)
    rows = written_table(rows, "fingerprints")
    groups = grouped(rows.select("doc_id", "_fp"), radius, **options)
    best = rows.join(groups, rows["_fp"] == groups["point"]).groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_fp", "_row_1", "_row_2")).alias("m")) \
        .select(F.col("m._row_1").alias("_best_1"), F.col("m._row_2").alias("_best_2"))
    hashed = docs.select("*", *hashes)
    return hashed.join(best, (F.col("_row_1") == F.col("_best_1")) & (F.col("_row_2") == F.col("_best_2")), "left_semi") \
        .dropDuplicates(["_row_1", "_row_2"]).drop("_row_1", "_row_2")
