"""Quality rules: a table of thresholds compiled into one projection, without user functions.

The measures are built-in expressions over one split of the text into words, each staged
in its own projection so that it is computed once; ``compile_rules`` turns a threshold
table into one boolean expression and one array of the failed rules' names.

Defined results: a null or empty text has no words, fails the base rule and is not kept;
repeated rows are judged each; extra columns are carried along, and columns named like a
measure are replaced.  8-word windows are told apart by a 64-bit hash within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Frequent words of the four languages, after lower-casing and stripping of punctuation.
STOP_WORDS = (
    "the of and to in a is that for it was on be with by are this from at or an "
    "le la les de des du et un une en que dans est pour qui au aux ce "
    "der die das und den von zu ist ein eine im auf für mit des dem "
    "el los las y del por con se una es al lo no su"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within [low, high]; an open side is None."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", low=20),
    Rule("repeats", "repeat_ratio", high=0.3),
    Rule("word_length", "mean_word_length", low=2.0, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.15),
    Rule("shouting", "upper_ratio", high=0.4),
    Rule("exclamations", "exclamation_ratio", high=0.4),
    Rule("stop_words", "stop_ratio", low=0.03),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)


def compile_rules(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(all rules hold, names of the rules that fail) over the measures' columns."""
    holds, failed = F.lit(True), []
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (F.col(r.measure) >= F.lit(r.low))
        if r.high is not None:
            ok = ok & (F.col(r.measure) <= F.lit(r.high))
        ok = F.coalesce(ok, F.lit(False))
        holds = holds & ok
        failed.append(F.when(~ok, F.lit(r.name)))
    return holds, F.array_compact(F.array(*failed))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ratios."""
    words, lines, n = F.col("_q_words"), F.col("_q_lines"), F.col("n_words")
    none = F.array().cast("array<bigint>")
    df = docs.withColumn("_q_text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    df = df.withColumns({
        "_q_words": F.array_remove(F.split("_q_text", SPACE), ""),
        "_q_lines": F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "_q_hash": F.when(F.size(words) >= 9, F.transform(F.sequence(F.lit(1), F.size(words) - 7), lambda i: F.xxhash64(F.slice(words, i, 8)))).otherwise(none),
        "word_chars": F.length(F.regexp_replace("_q_text", SPACE, "")).cast("long"),
        "n_symbols": (F.length("_q_text") - F.length(F.translate("_q_text", SYMBOLS, ""))).cast("long"),
        "_q_upper": F.length("_q_text") - F.length(F.translate("_q_text", UPPER, "")),
        "_q_excl": F.length("_q_text") - F.length(F.translate("_q_text", "!", "")),
        "_q_n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "_q_stop": F.size(F.filter(words, lambda w: F.lower(F.trim(w, F.lit(".,;:!?"))).isin(STOP_WORDS))),
    }).drop("_q_lines", "_q_words")
    # Few texts repeat a window; only these are sorted.
    df = df.withColumn(
        "_q_sorted",
        F.when(F.size(F.array_distinct("_q_hash")) < F.size("_q_hash"), F.sort_array(F.transform("_q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("_q_hash")
    df = df.withColumn(
        "_q_at",
        F.sort_array(F.transform(F.filter("_q_sorted", lambda s, k: F.coalesce(s["h"] == F.get("_q_sorted", k - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get("_q_sorted", k + 1)["h"], F.lit(False))), lambda s: s["i"])),
    ).drop("_q_sorted")
    df = df.withColumn("n_repeat_words", F.aggregate(F.transform("_q_at", lambda p, k: F.least(F.lit(8), F.coalesce(F.get("_q_at", k + 1) - p, F.lit(8)))), F.lit(0), lambda a, x: a + x).cast("long"))
    per_word = lambda c: F.when(n > 0, F.col(c) / n).otherwise(F.lit(0.0))
    return df.withColumns({
        "repeat_ratio": per_word("n_repeat_words"),
        "mean_word_length": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "stop_ratio": per_word("_q_stop"),
        "exclamation_ratio": per_word("_q_excl"),
        "upper_ratio": F.when(F.col("word_chars") > 0, F.col("_q_upper") / F.col("word_chars")).otherwise(F.lit(0.0)),
        "dup_line_ratio": F.when(F.col("_q_n_lines") > 0, F.col("n_dup_lines") / F.col("_q_n_lines")).otherwise(F.lit(0.0)),
    }).drop("_q_text", "_q_at", "_q_stop", "_q_upper", "_q_excl", "_q_n_lines")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with its measures, base_failed, failed_rules and kept."""
    holds, failed = compile_rules(rules)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = measured(docs, text_col)
    # A generator of one row: a later filter on the verdict stays above it, and isn't
    # pushed down through the staged projections, where each use would repeat them all.
    df = df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).withColumn("base_failed", base_failed)
    return df.withColumns({"failed_rules": failed, "kept": ~F.col("base_failed") & holds})
