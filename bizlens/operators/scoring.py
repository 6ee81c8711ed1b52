"""Supervised churn scoring (family F) with ``pyspark.ml``: dedupe, deterministic
stratified split, feature pipeline, boosted trees, held-out AUC, permutation
importance and the scored rows.

Everything is distributed: the split ranks rows inside each class with the
two-level prefix sum (no single-task window), the model is ``GBTClassifier``
(JVM), AUCs use ``rank_auc``, and permutation importance joins the rows' places in two exact
hash orders, one permutation per repeat for all features.

Trees see a number by its bin alone (``maxBins``), so numbers are binned before the fit and rows that are equal then
are one row with a weight: a boosting round takes time by the number of different rows, not of rows.  Reports score
each different row once.
"""

from __future__ import annotations

import math
from decimal import Decimal
from itertools import groupby

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, FeatureHasher, Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import rnd
from ..sources.scratch import written_table
from .checks import leakage_scan, low_cardinality
from .joins import bounded_broadcast
from .ranking import join_null_safe, prefix_sums, rank_auc

TEST_FRACTION = Decimal("0.25")
GBT_PARAMS = {"maxIter": 250, "stepSize": 0.08, "maxDepth": 4, "seed": 42}
PERM_REPEATS = 6
FIT_PARTITION_ROWS = 50_000
SCORE_PARTITION_ROWS = 20_000    # 250 trees a row: seconds a task
MAX_BINS = 32                    # of a number, the learner's default
CUT_POINTS = 10_000              # a column with more values is cut by as many quantiles of all its rows
MAX_TEXT_FEATURE_LEVELS = 1000   # a text column with more levels is hashed: its dictionary would be on the driver
HASHED_FEATURES = 1024           # slots that the levels of all hashed columns share


def split_hash(id_col: str) -> F.Column:
    """60-bit integer from md5(id): the deterministic shuffle order."""
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 15), 16, 10).cast("bigint")


def _order_key(df: DataFrame, id_col: str, first: F.Column) -> F.Column:
    """(first, id) as one ordered number, so that equal hashes are told apart by their ids."""
    integral = isinstance(df.schema[id_col].dataType, T.IntegralType)
    tie = F.col(id_col).cast("bigint") if integral else F.xxhash64(id_col)
    shift = F.lit(Decimal(2 ** 63))
    high = first.cast("decimal(19,0)").cast("decimal(38,0)") * F.lit(Decimal(2 ** 64)).cast("decimal(20,0)")
    return (high.cast("decimal(38,0)") + F.coalesce(tie, F.lit(0)).cast("decimal(20,0)") + shift).cast("decimal(38,0)")


def stratified_split(df: DataFrame, id_col: str, label: str, test_fraction=TEST_FRACTION, keep: bool = False) -> DataFrame:
    """Per class, the first ceil(test_fraction * n_class) rows in (md5(id), id) order are
    the test split (F2).  Exact per-class shares without a global window; with ``keep`` all columns
    go through the ranking, so rows that share an id are split on their own."""
    columns = df.columns if keep else [id_col, label]
    x = df.select(*columns, _order_key(df, id_col, split_hash(id_col)).alias("_h"), F.lit(1).alias("_one"))
    ranked = prefix_sums(x, "_h", ["_one"], [label])
    sizes = x.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    # one row per class: broadcast under a checked size
    j = ranked.join(bounded_broadcast(sizes), label)
    cut = F.ceil(F.col("_nc").cast("decimal(20,0)") * F.lit(Decimal(str(test_fraction))))
    return j.select(*columns, F.when(F.col("_one_below") < cut, "test").otherwise("train").alias("split"))


def feature_columns(df: DataFrame, label: str, id_col: str, exclude: list[str]) -> tuple[list[str], list[str]]:
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in (label, id_col) or f.name in exclude:
            continue
        if isinstance(f.dataType, T.StringType):
            cat.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            num.append(f.name)
    return num, cat


def leak_suspects(df: DataFrame, label: str) -> list[str]:
    """Columns flagged by the leakage scan are dropped before fitting."""
    return [r["column"] for r in leakage_scan(df, label).where("flagged").select("column").collect()]


def _cuts(values: list[tuple[float, float]], bins: int) -> list[float]:
    """Ends of the bins of ascending (value, weight) as the tree learner sets them: halfway between neighbours, all of
    them if they are few, else where the weight so far comes closest to the next share."""
    middle = [(a[0] + b[0]) / 2 for a, b in zip(values, values[1:])]
    if len(values) <= bins:
        return middle
    stride = sum(w for _, w in values) / bins
    cuts, seen, target = [], values[0][1], stride
    for k, (_, w) in enumerate(values[1:]):
        if abs(seen - target) < abs(seen + w - target):
            cuts.append(middle[k])
            target += stride
        seen += w
    return cuts


def bin_ends(df: DataFrame, column: str, bins: int = MAX_BINS) -> list[float]:
    """Bin ends of a column from all its rows: exact up to ``CUT_POINTS`` values, beyond them from that many quantiles."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col(column).isNotNull() & ~F.isnan(column))
    found = counts.orderBy(column).limit(CUT_POINTS + 1).collect()
    if len(found) <= CUT_POINTS:
        return _cuts([(r[0], r["n"]) for r in found], bins)
    points = df.agg(F.percentile_approx(column, [k / CUT_POINTS for k in range(CUT_POINTS + 1)], 10 * CUT_POINTS)).first()[0]
    return _cuts([(v, len(list(g))) for v, g in groupby(sorted(points))], bins)


def build_imputer(num: list[str]) -> Pipeline:
    """Median imputation (GBT has no NaN routing)."""
    return Pipeline(stages=[Imputer(inputCols=num, outputCols=[f"{c}_imp" for c in num], strategy="median")] if num else [])


def build_pipeline(num: list[str], cat: list[str], label: str, wide: list[str] = ()) -> Pipeline:
    """Bins of the imputed numbers and missing indicators, one-hot with a slot for unseen/missing levels, hashed
    slots without a dictionary for ``wide`` text columns, boosted trees over rows of weight ``_n``."""
    stages = []
    idx = [f"{c}_idx" for c in cat]
    ohe = [f"{c}_ohe" for c in cat]
    if cat:
        stages.append(StringIndexer(inputCols=cat, outputCols=idx, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=False, handleInvalid="keep"))
    hashed = ["hashed_levels"] if wide else []
    if wide:
        stages.append(FeatureHasher(inputCols=list(wide), outputCol=hashed[0], numFeatures=HASHED_FEATURES))
    stages.append(VectorAssembler(inputCols=[f"{c}_bin" for c in num] + [f"{c}_missing" for c in num] + ohe + hashed,
                                  outputCol="features"))
    stages.append(GBTClassifier(featuresCol="features", labelCol=label, weightCol="_n", **GBT_PARAMS))
    return Pipeline(stages=stages)


def with_missing_flags(df: DataFrame, num: list[str]) -> DataFrame:
    # 1 and 2: the learner counts zeros as what its sample of the weights lacks, which can be none
    return df.select("*", *[(F.col(c).isNull().cast("double") + 1).alias(f"{c}_missing") for c in num])


class ChurnModel:
    """Fitted scoring model plus the frames its reports are built from."""

    def __init__(self, df: DataFrame, id_col: str = "id", label: str = "churned"):
        self.id_col, self.label = id_col, label
        base = df.dropDuplicates()
        base = base.withColumn(label, F.col(label).cast("double"))
        self.excluded = leak_suspects(base, label)
        self.num, self.cat = feature_columns(base, label, id_col, self.excluded)
        for c in self.num:
            base = base.withColumn(c, F.col(c).cast("double"))
        few = low_cardinality(base, self.cat, MAX_TEXT_FEATURE_LEVELS)
        self.wide = [c for c in self.cat if c not in few]
        self.cat = [c for c in self.cat if c in few]
        # one written table: fitting, scoring and the permutation variants all read
        # the split feature frame instead of recomputing the ranking jobs
        split = stratified_split(base, id_col, label, keep=True)
        self.data = written_table(with_missing_flags(split, self.num), "churn-features")
        train = self.data.where(F.col("split") == "train")
        self.imputer: PipelineModel = build_imputer(self.num).fit(train)
        imputed = self.imputer.transform(train)
        self.ends = {c: bin_ends(imputed, f"{c}_imp") for c in self.num}
        #: what the trees see of a row
        self.seen = [f"{c}_bin" for c in self.num] + [f"{c}_missing" for c in self.num] + self.cat + self.wide
        rows = written_table(self.binned(train).groupBy(*self.seen, label).agg(F.count(F.lit(1)).cast("double").alias("_n")), "churn-rows")
        # a boosting round is several jobs: a small frame in many partitions is mostly scheduling
        rows = rows.coalesce(max(1, -(-rows.count() // FIT_PARTITION_ROWS)))
        self.model: PipelineModel = build_pipeline(self.num, self.cat, label, self.wide).fit(rows)

    def binned(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<c>_bin`` for every number: 1 for the first bin, the median's for a missing number."""
        x = self.imputer.transform(df)
        if not self.num:
            return x
        # negated, because a bucket holds its lower end and the trees' bins hold their upper one
        x = x.select("*", *[(-F.col(f"{c}_imp")).alias(f"{c}_neg") for c in self.num])
        cut = Bucketizer(inputCols=[f"{c}_neg" for c in self.num], outputCols=[f"{c}_at" for c in self.num],
                         splitsArray=[[-math.inf, *[-e for e in reversed(self.ends[c])], math.inf] for c in self.num],
                         handleInvalid="keep")
        bins = [(F.lit(len(self.ends[c]) + 1) - F.col(f"{c}_at")).alias(f"{c}_bin") for c in self.num]
        return cut.transform(x).select(*df.columns, *bins)

    def _transformed(self, binned: DataFrame) -> DataFrame:
        return self.model.transform(binned).withColumn("p", vector_to_array("probability")[1])

    def score(self, df: DataFrame | None = None) -> DataFrame:
        d = self.data if df is None else df
        # a table this small in bytes is read in few tasks, whatever its rows cost
        tasks = max(d.sparkSession.sparkContext.defaultParallelism, -(-d.count() // SCORE_PARTITION_ROWS))
        return self._transformed(self.binned(d.repartition(tasks)))

    def scored_counts(self, binned: DataFrame, by: list[str] = ()) -> DataFrame:
        """``by``, label, p and the number of rows: each different row of ``binned`` is scored once."""
        counts = written_table(binned.groupBy(*by, *self.seen, self.label).agg(F.count(F.lit(1)).alias("_c")), "churn-counts")
        rows = counts.select(*self.seen).distinct()
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SCORE_PARTITION_ROWS))
        p = written_table(self._transformed(rows.repartition(tasks)).select(*self.seen, "p"), "churn-p")
        return written_table(join_null_safe(counts, p, self.seen).groupBy(*by, self.label, "p").agg(F.sum("_c").alias("_c")),
                             "churn-scored")

    def scores(self) -> DataFrame:
        s = self.score()
        return s.select(self.id_col, "split", F.col(self.label).cast("int").alias(self.label),
                        rnd("p", 6).alias("p"))

    def invariants(self) -> DataFrame:
        """What must hold of any fit: every row scored once, probabilities in [0, 1], the test share exact."""
        s = self.score()
        return s.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(self.id_col).alias("n_ids"),
                     F.count_if(F.col("p").between(0, 1)).alias("n_scored"),
                     F.count_if(F.col("split") == "test").alias("n_test"))

    def holdout_auc(self) -> DataFrame:
        a = rank_auc(self.scored_counts(self.binned(self.data.where(F.col("split") == "test"))), "p", self.label, counted="_c")
        return a.select(rnd("auc", 6).alias("auc"), "n_pos", "n_neg", (F.col("auc") > 0.5).alias("beats_baseline"))

    def permutation_importance(self, repeats: int = PERM_REPEATS, top: int = 10) -> DataFrame:
        """Mean held-out AUC drop when one raw feature is shuffled (F6, F7).  A repeat's permutation is one exact
        shuffle of all test rows, the same for every feature: the row at place k of one hash order gives
        its values to the row at place k of another."""
        test = self.binned(self.data.where(F.col("split") == "test")).select(self.id_col, self.label, *self.seen)
        feats = self.num + self.cat + self.wide
        # a missing number is shuffled with its flag
        parts = {c: [f"{c}_bin", f"{c}_missing"] if c in self.num else [c] for c in feats}
        reps = F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("rep")

        def placed(seed: int, columns: list) -> DataFrame:
            x = test.select(*columns, reps)
            h = F.shiftrightunsigned(F.xxhash64(self.id_col, "rep", F.lit(seed)), 4)
            x = x.withColumn("_k", _order_key(x, self.id_col, h)).withColumn("_one", F.lit(1))
            return prefix_sums(x, "_k", ["_one"], ["rep"]).withColumnRenamed("_one_below", "_place").drop("_k", "_one")

        donors = placed(2, [self.id_col, *[F.col(c).alias(f"_d_{c}") for c in self.seen]]).drop(self.id_col)
        j = placed(1, [self.id_col, self.label, *self.seen]).join(donors, ["rep", "_place"])
        variants = j.select("*", F.explode(F.array(*[F.lit(f) for f in feats])).alias("feature"))
        shuffled = variants.select(self.label, "feature", "rep",
                                   *[F.when(F.col("feature") == f, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c)
                                     for f in feats for c in parts[f]])
        aucs = rank_auc(self.scored_counts(shuffled, ["feature", "rep"]), "p", self.label, ["feature", "rep"], counted="_c")
        base = rank_auc(self.scored_counts(test), "p", self.label, counted="_c").select("auc").scalar()
        mean_auc = aucs.groupBy("feature").agg(F.avg("auc").alias("_a"))
        imp = mean_auc.select("feature", (base - F.col("_a")).alias("importance"))
        return imp.orderBy(F.desc("importance"), "feature").limit(top) \
            .select("feature", rnd("importance", 6).alias("importance"))
