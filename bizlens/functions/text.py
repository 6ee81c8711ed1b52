"""Text and formatting column functions (X3-X5, X9-X16, P13).  All are built-in
expressions, so they stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import dbl, js_round, rnd

# HTML escapes of the reference (ampersand first).
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
# Fixed value: the marker of a truncated output.
TRUNCATION_MARKER = "\n\n...[truncated]...\n\n"
# Title-case fix-ups of the reference's region clean-up.
CASE_FIXES = {"Apac": "APAC", "Latam": "LATAM"}
# White space of Unicode, as scripting languages match it.
WS = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def html_escape(x) -> Column:
    out = F.coalesce(_c(x).cast("string"), F.lit(""))
    for a, b in HTML_ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def truncate_middle(x, limit: int) -> Column:
    """Over ``limit`` characters keep the first and last limit/2 with a marker."""
    t = _c(x)
    half = limit // 2
    return F.when(F.length(t) > limit,
                  F.concat(F.substring(t, 1, half), F.lit(TRUNCATION_MARKER), F.substring(t, -half, half))) \
        .otherwise(t)


def collapse_ws(x) -> Column:
    return F.regexp_replace(_c(x), WS + "+", " ")


def strip_ws(x) -> Column:
    return F.regexp_replace(_c(x), f"^{WS}+|{WS}+$", "")


def json_recover(x) -> Column:
    """The JSON text inside a model's answer (X13): the part between code fences if there is
    one, else all of it; where that does not parse, the part from its first opening to its last closing
    bracket; NULL when neither parses.  Positions are searched, no pattern is matched."""
    raw = strip_ws(_c(x))
    open_at = F.instr(raw, "```")
    inside = F.substr(raw, open_at + 3)
    close_at = F.instr(inside, "```")
    body = F.substr(inside, F.lit(1), close_at - 1)
    body = F.when(F.startswith(body, F.lit("json")), F.substr(body, F.lit(5))).otherwise(body)
    text = F.when((open_at > 0) & (close_at > 0), strip_ws(body)).otherwise(raw)
    firsts = [F.nullif(F.instr(text, c), F.lit(0)) for c in "{["]
    lasts = [F.nullif(F.instr(F.reverse(text), c), F.lit(0)) for c in "}]"]
    first, tail = F.least(*firsts), F.least(*lasts)
    span = F.substr(text, first, F.length(text) - tail - first + 2)
    ok_text = F.try_parse_json(text).isNotNull()
    ok_span = (first <= F.length(text) - tail + 1) & F.try_parse_json(span).isNotNull()
    return F.when(ok_text, text).when(ok_span, span)


def title_case(x) -> Column:
    """Title case on whitespace-separated words, then the fixed acronym fix-ups."""
    out = F.initcap(F.lower(_c(x)))
    for a, b in CASE_FIXES.items():
        out = F.when(out == a, F.lit(b)).otherwise(out)
    return out


def pct(x, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", rnd(dbl(x) * 100, digits))


def int_commas(x) -> Column:
    return F.format_number(js_round(x).cast("long"), 0)


def usd(x) -> Column:
    return F.concat(F.lit("$"), int_commas(x))


def usd2(x) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.2f", rnd(x, 2)))


def money_compact(x) -> Column:
    v = dbl(x)
    return (F.when(v >= 1e6, F.concat(F.lit("$"), F.format_string("%.2f", rnd(v / 1e6, 2)), F.lit("M")))
            .when(v >= 1e3, F.concat(F.lit("$"), F.format_string("%.0f", rnd(v / 1e3, 0)), F.lit("K")))
            .otherwise(usd(v)))


def date_long(x) -> Column:
    return F.date_format(_c(x), "MMM d, yyyy")


def date_axis(x) -> Column:
    return F.date_format(_c(x), "MM/dd")
