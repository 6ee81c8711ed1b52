"""Quality rules, line first: lines that fail punctuation, navigation or boilerplate rules go, and
documents that lose too much of their text go with them.  DataFrame functions only; no shuffle.

Line rules (a line without any word is neutral):

* punctuation: more than ``MAX_SYMBOL_SHARE`` of the line's code points in words are ``[#*$%&|<>]``, or
  more than half of its words end in two or more exclamation marks or in a symbol run;
* navigation: at least ``MIN_SEPARATORS`` separators (``|`` ``>`` ``»`` and middle dots) standing alone between
  the words, and at least one for every ``WORDS_PER_SEPARATOR`` words;
* boilerplate: a short line (at most ``BOILERPLATE_WORDS`` words) with a phrase of licences, cookies,
  copyright or sign-up notices.

A document is kept when it passes the base rules (at least 50 words; words in repeated 3-word
windows at most half) and the lines removed hold at most ``MAX_LOST`` of its words.

Defined results: a null, empty or blank text has no words, is not kept and its cleaned text is
empty; repeated rows stay; a single very long line is one line; extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_SHARE = 0.1
MIN_SEPARATORS = 3
WORDS_PER_SEPARATOR = 3
BOILERPLATE_WORDS = 30
MAX_LOST = 0.5
SYMBOLS = r"[#*$%&|<>]"
SEPARATOR_WORD = rf"(?<![^{SPACE_CLASS}])[|>»·•]+(?![^{SPACE_CLASS}])"
SHOUTED_WORD = rf"(?:!!+|[#*$%&]{{2,}})[.,;:]?(?![^{SPACE_CLASS}])"

#: Phrases of boilerplate lines.
BOILERPLATE = (r"(?i)\b(?:all rights reserved|licen[sc]ed under|public license|creative commons|"
               r"cookie policy|privacy policy|terms of (?:use|service)|accept (?:all )?cookies|"
               r"subscribe to our newsletter|sign up for our newsletter|copyright \(c\)|javascript is disabled)\b|©")

#: Stems of which every phrase above has one, in lower case.
STEMS = ("rights reserved", "license", "licence", "creative commons", "cookie", "privacy policy", "terms of",
         "newsletter", "copyright", "javascript", "©")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Number of words that lie in a window of ``width`` words found at least twice in the text.

    Windows are sorted by hash (hash and place in one number) so that equal ones are neighbours;
    equal hashes are compared word by word; the union of the windows' places is then measured."""
    shift = F.call_function

    def solve(w: Column, n: Column, bits: Column, mask: Column) -> Column:
        packed = F.sort_array(F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: shift("shiftleft", shift("shiftright", F.xxhash64(*[F.get(w, i + k) for k in range(width)]), bits), bits)
            .bitwiseOR(i.cast("bigint"))))

        def same(x: Column, y: Column) -> Column:
            """Whether two packed windows (y null past the ends) are the same words."""
            p, q = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
            equal = shift("shiftright", x, bits) == shift("shiftright", y, bits)
            for k in range(width):
                equal = equal & (F.get(w, p + k) == F.get(w, q + k))
            return F.coalesce(equal, F.lit(False))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask).cast("int")))

        def covered(p: Column) -> Column:
            # each place adds the words up to the next place, ``width`` at most
            return F.aggregate(p, F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-width).alias("end")),
                               lambda acc, x: F.struct(
                                   (acc["sum"] + F.least(F.lit(width), x + width - acc["end"])).cast("bigint").alias("sum"),
                                   (x + width).alias("end")))["sum"]

        return let(let(packed, places), covered)

    def sized(w: Column) -> Column:
        # windows, bits that hold a place, mask of a place: evaluated once a text
        return let(F.size(w) - (width - 1), lambda n: F.when(n < 2, F.lit(0).cast("bigint")).otherwise(
            let(F.length(F.bin(n.cast("bigint"))), lambda bits: let(
                shift("shiftleft", F.lit(1).cast("bigint"), bits) - 1, lambda mask: solve(w, n, bits, mask)))))
    return let(words, sized)


def line_fails(line: Column, n_words: Column, signs: Column, phrases: Column) -> Column:
    """Whether a line with ``n_words`` words breaks a rule.  ``signs``, ``phrases``: whether the text has any
    sign, any stem of a phrase, that the rules look for; without, its lines need no look."""
    chars = F.length(F.regexp_replace(line, rf"[{SPACE_CLASS}]+", ""))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    separators = F.regexp_count(line, F.lit(SEPARATOR_WORD))
    shouted = F.regexp_count(line, F.lit(SHOUTED_WORD))
    punctuation = (symbols > chars * MAX_SYMBOL_SHARE) | (shouted * 2 > n_words)
    navigation = let(separators, lambda k: (k >= MIN_SEPARATORS) & (k * WORDS_PER_SEPARATOR >= n_words))
    boilerplate = (n_words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return (signs & (punctuation | navigation)) | (phrases & boilerplate)


def judge(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds (names with ``prefix``) n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, cleaned (the text without the lines removed) and n_words_kept."""
    t = F.coalesce(F.col(text), F.lit(""))
    p = "_quality_"
    x = docs.withColumn(p + "words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0))) \
        .withColumn(p + "lines", F.transform(F.split(t, "\n", -1), lambda s: F.struct(
            s.alias("s"), F.regexp_count(s, F.lit(WORD)).alias("n")))) \
        .withColumn(p + "symbols", F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint"))
    low = F.lower(t)
    x = x.withColumn(p + "n", F.size(p + "words").cast("bigint")) \
        .withColumn(p + "chars", F.length(F.array_join(p + "words", "")).cast("bigint")) \
        .withColumn(p + "repeats", repeated_window_words(F.col(p + "words"))) \
        .withColumn(p + "full", F.filter(p + "lines", lambda s: s["n"] > 0)) \
        .withColumn(p + "distinct", F.array_distinct(F.transform(p + "full", lambda s: s["s"]))) \
        .withColumn(p + "signs", (F.col(p + "symbols") > 0) | reduce(
            lambda a, b: a | b, [F.contains(t, F.lit(sign)) for sign in ("!!", "»", "·", "•")])) \
        .withColumn(p + "phrases", let(low, lambda y: reduce(
            lambda a, b: a | b, [F.contains(y, F.lit(stem)) for stem in STEMS])))
    # bound here: the optimizer would move a column's expression into the lambda, once a line
    good = let(F.struct(F.col(p + "signs").alias("signs"), F.col(p + "phrases").alias("phrases")), lambda g: F.filter(
        p + "lines", lambda s: (s["n"] == 0) | ~line_fails(s["s"], s["n"], g["signs"], g["phrases"])))
    x = x.withColumn(p + "good", good)
    x = x.withColumn(p + "left", F.aggregate(p + "good", F.lit(0).cast("bigint"), lambda a, s: a + s["n"])) \
        .withColumn(p + "failed", (F.col(p + "n") < MIN_WORDS)
                    | (100 * F.col(p + "repeats") > MAX_REPEAT_PERCENT * F.col(p + "n")))
    lost = F.col(p + "n") - F.col(p + "left")
    return x.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(p + "n").alias(prefix + "n_words"), F.col(p + "chars").alias(prefix + "word_chars"),
        F.col(p + "symbols").alias(prefix + "n_symbols"),
        (F.size(p + "full") - F.size(p + "distinct")).cast("bigint").alias(prefix + "n_dup_lines"),
        F.col(p + "repeats").alias(prefix + "n_repeat_words"), F.col(p + "failed").alias(prefix + "base_failed"),
        (~F.col(p + "failed") & (lost <= MAX_LOST * F.col(p + "n"))).alias(prefix + "kept"),
        F.array_join(F.transform(p + "good", lambda s: s["s"]), "\n").alias(prefix + "cleaned"),
        F.col(p + "left").alias(prefix + "n_words_kept"))
