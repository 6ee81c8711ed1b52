"""Batch text and scalar jobs over the driver tables: escaping, truncation,
whitespace, JSON recovery, transcript packs, display formatting, rounding,
binning, case clean-up and one-hot encoding.  Whole texts are processed; every
job is a projection except the transcripts: the pack is one value a conversation, so a conversation has to fit one
task there (with ``turns`` a group-limited top-k bounds it); the parts have no such bound."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.metrics import measure_aggs, ratio_col
from ..functions.numeric import half_even, money, rnd
from .ranking import join_null_safe, prefix_sums

# Right-closed bins of the reference (lowest edge included).
BIN_EDGES = [0, 7, 14, 30, 60, 200]
BIN_LABELS = ["0-7", "8-14", "15-30", "31-60", "60+"]


def html_escape(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.html_escape("text").alias("escaped"))


def truncate_middle(docs: DataFrame, limit: int) -> DataFrame:
    """The middle truncation itself (X11), at the limit the caller names."""
    t = X.truncate_middle("text", limit)
    return docs.select("doc_id", t.alias("truncated"), F.length(t).alias("n_chars_out"))


def collapse_ws(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.collapse_ws("text").alias("collapsed"))


def wrapped_props(events: DataFrame) -> DataFrame:
    """Model-style answers derived from ``events.props``: fenced, embedded in prose,
    bare, or without any JSON."""
    e = F.col("event_id")
    raw = (F.when(e % 11 == 0, F.concat(F.lit("error: "), F.col("event_type")))
           .when(e % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
           .when(e % 3 == 1, F.concat(F.lit("Result: "), F.col("props"), F.lit(" (end)")))
           .otherwise(F.col("props")))
    return events.select("event_id", raw.alias("raw"))


def json_recover(events: DataFrame) -> DataFrame:
    w = wrapped_props(events)
    rec = X.json_recover("raw")
    return w.select("event_id", rec.alias("recovered"),
                    F.get_json_object(rec, "$.k").cast("int").alias("k"),
                    rec.isNotNull().alias("ok"))


def top_k_per_group(df: DataFrame, group_cols: list[str], order_col: str, k: int) -> DataFrame:
    """The k rows with the largest ``order_col`` per group.  The ``row_number() <= k``
    filter is planned with a partial WindowGroupLimit before the shuffle (Spark's
    group-limit optimisation, k below its 1000 threshold): each map task keeps at
    most k rows per group, so a group holding a third of the table reaches its
    reducer as k rows per task, never as a third of the table."""
    w = Window.partitionBy(*group_cols).orderBy(F.desc(order_col))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def transcript_pack(conv: DataFrame, turns: int | None = None, chars: int | None = None) -> DataFrame:
    """The turns of each conversation as one text, in turn order (T4): all turns, whole, unless the caller asks for
    the last ``turns`` (N10) or the first ``chars`` characters of each (X12).  One scan; with ``turns`` the partial
    group limit bounds what is shuffled."""
    x = conv if turns is None else top_k_per_group(conv, ["conv_id"], "turn", turns)
    g = x.groupBy("conv_id").agg(_in_turn_order(_piece(chars)), F.count(F.lit(1)).alias("n_turns"))
    return g.select("conv_id", "n_turns", _joined())


def _piece(chars: int | None = None) -> Column:
    body = F.coalesce("text", F.lit(""))
    return F.concat(F.lit("["), F.col("turn").cast("string"), F.lit(" "), F.coalesce("role", F.lit("?")), F.lit("] "),
                    body if chars is None else F.substring(body, 1, chars))


def _in_turn_order(piece: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))).alias("a")


def _joined() -> Column:
    return F.array_join(F.transform("a", lambda s: s["p"]), "\n").alias("pack")


def transcript_parts(conv: DataFrame, part_chars: int) -> DataFrame:
    """Whole transcripts of conversations of any length, one row a part: a turn is in part ``p`` if the turns before it
    have between ``p`` and ``p + 1`` times ``part_chars`` characters, so the packs of a conversation joined by line feeds in
    the order of ``part`` are its transcript, and a part is at most one turn longer than ``part_chars``.  Numbers are
    left out after a turn longer than a part.  Sizes are ranked by ``prefix_sums`` without the texts; texts are
    shuffled by (conv_id, turn) and (conv_id, part), never by conversation.  ``turn`` numbers the turns of a
    conversation: rows that repeat one stay together."""
    x = conv.select("conv_id", "turn", F.coalesce(F.col("turn").cast("bigint"), F.lit(-2 ** 63)).alias("_t"), "role", "text")
    sizes = x.groupBy("conv_id", "_t").agg(F.sum(F.length(F.coalesce(_piece(), F.lit(""))) + 1).alias("_size"))
    below = prefix_sums(sizes, "_t", ["_size"], ["conv_id"])
    part = below.select("conv_id", "_t", F.floor(F.col("_size_below") / F.lit(part_chars)).cast("bigint").alias("part"))
    g = join_null_safe(x, part, ["conv_id", "_t"]).groupBy("conv_id", "part").agg(
        _in_turn_order(_piece()), F.count(F.lit(1)).alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return g.select("conv_id", "part", "n_turns", "first_turn", "last_turn", _joined())


def format_metrics(wk: DataFrame) -> DataFrame:
    a = wk.groupBy("week").agg(*measure_aggs())
    return a.select(
        "week",
        X.pct(ratio_col("fundedRate"), 1).alias("funded_rate"),
        X.pct(ratio_col("takeRate"), 2).alias("take_rate"),
        X.int_commas("don").alias("donations"),
        X.usd2(ratio_col("avgDonation")).alias("avg_donation"),
        X.money_compact("gdv").alias("gdv"),
        X.usd("rev").alias("net_revenue"))


def format_dates(weeks: DataFrame) -> DataFrame:
    return weeks.select("week", X.date_long("week").alias("label"), X.date_axis("week").alias("axis"))


def scalar_rounding(orders: DataFrame) -> DataFrame:
    """Half-even (Python round), half-up (SQL ROUND) and JS Math.round on exact
    decimals that land on ties (price x 1/8)."""
    x = money("o_totalprice") * F.lit(Decimal("0.125"))
    return orders.select(
        "o_orderkey", rnd(x, 5).alias("x"), rnd(half_even(x, 2), 5).alias("half_even"),
        rnd(F.round(x, 2), 5).alias("half_up"), F.floor(x + F.lit(Decimal("0.5"))).cast("bigint").alias("js_round"))


def bin_right_closed(acct: DataFrame) -> DataFrame:
    """Right-closed bins with the lowest edge included; out of range -> NULL."""
    x = F.col("dorm") * F.lit(1.5)
    label = None
    for i, lab in enumerate(BIN_LABELS):
        lo, hi = BIN_EDGES[i], BIN_EDGES[i + 1]
        cond = ((x >= lo) if i == 0 else (x > lo)) & (x <= hi)
        label = F.when(cond, lab) if label is None else label.when(cond, lab)
    return acct.select("id", x.alias("x"), label.alias("bin"))


def clean_category_case(cust: DataFrame) -> DataFrame:
    """Mixed-case region labels (a derived mess: every third customer lower-cased)
    normalised by title case plus the fixed acronym fix-ups (P13, X9)."""
    raw = F.when(F.col("c_custkey") % 3 == 0, F.lower("r_name")).otherwise(F.col("r_name"))
    return cust.select("c_custkey", raw.alias("raw"), X.title_case(raw).alias("cleaned"))


def one_hot_dummy_na(df: DataFrame, id_col: str, levels: dict[str, list[str]]) -> DataFrame:
    """Indicator column per named level plus a missing-value indicator (P14), for levels the caller knows."""
    outs = [F.col(id_col)]
    for c, names in levels.items():
        outs += [F.when(F.col(c) == lv, 1).otherwise(0).alias(f"{c}_{lv}") for lv in names]
        outs.append(F.when(F.col(c).isNull(), 1).otherwise(0).alias(f"{c}_nan"))
    return df.select(*outs)


def one_hot_long(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """The same indicators in sparse form, for any number of levels: one row (id, column, level) per
    indicator that is 1; a missing value has a null level.  No level list is gathered."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    return df.select(id_col, F.explode(cells).alias("c")).select(id_col, "c.column", "c.level")
