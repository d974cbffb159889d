"""Words of Han text: a vocabulary learnt from the corpus, and the likeliest cut of a run by it.

A run of up to ``longest`` characters is a word if it is found often enough and holds together: at each
place where it could be parted it is found ``cohesion`` times as often as its two parts would meet by
chance.  A word's score is the logarithm of its share; a text's runs of Han characters are cut so
that the sum of scores is largest (Viterbi's algorithm), the longer last word winning a tie.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of

HAN_RUN = r"\p{IsHan}+"
RUN = r"[\p{L}\p{N}&&[^\p{IsHan}]]+|\p{IsHan}+"
LONGEST = 4
#: So many words at most are kept, the most frequent; they go to every executor.
MOST_WORDS = 200_000


def grams(texts: DataFrame, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """gram, n: all runs of 1 to ``longest`` Han characters, counted map-side first."""
    runs = texts.select(F.explode(F.regexp_extract_all(text_of(F.col(text)), F.lit(HAN_RUN), F.lit(0))).alias("run"))
    starts = F.sequence(F.lit(1), F.length("run"))
    cut = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - i + 1)), lambda n: F.substring("run", i, n))))
    return runs.select(F.explode(cut).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def learn(texts: DataFrame, text: str = "text", longest: int = LONGEST, least: int = 5, cohesion: float = 20.0, most: int = MOST_WORDS) -> DataFrame:
    """word, n, score (thousandths of a natural logarithm): single characters, and longer runs that
    are found ``least`` times and hold together; the ``most`` frequent, ties by the word."""
    counts = grams(texts, text, longest)
    total = counts.where(F.length("gram") == 1).agg(F.sum("n").alias("total"))  # one row
    long = counts.where((F.length("gram") > 1) & (F.col("n") >= least)).select(F.col("gram").alias("word"), "n")
    parted = long.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    parted = parted.select("word", "n", F.expr("substring(word, 1, k)").alias("a"), F.expr("substring(word, k + 1)").alias("b"))
    left, right = counts.toDF("a", "na"), counts.toDF("b", "nb")
    held = parted.join(left, "a").join(right, "b").crossJoin(F.broadcast(total))
    firm = held.groupBy("word").agg(F.max("n").alias("n"), F.min(F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))).alias("hold")).where(F.col("hold") >= cohesion)
    words = counts.where(F.length("gram") == 1).select(F.col("gram").alias("word"), "n").unionByName(firm.select("word", "n"))
    scored = words.crossJoin(F.broadcast(total)).select("word", "n", F.round(1000 * F.log(F.col("n") / F.col("total"))).cast("int").alias("score"))
    return scored.orderBy(F.col("n").desc(), "word").limit(most)


class Cutter:
    """Cuts runs of Han characters by a vocabulary (word -> score)."""

    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0) - 1000  # a character the vocabulary lacks

    @staticmethod
    def of(words: DataFrame) -> Cutter:
        return Cutter({r["word"]: r["score"] for r in words.select("word", "score").collect()})  # MOST_WORDS at most

    def cut(self, run: str) -> list[str]:
        best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for size in range(min(self.longest, end), 0, -1):
                own = self.scores.get(run[end - size : end], self.unknown if size == 1 else None)
                if own is not None and best[end - size] + own > best[end]:
                    best[end], back[end] = best[end - size] + own, size
        out, end = [], len(run)
        while end:
            out.append(run[end - back[end] : end])
            end -= back[end]
        return out[::-1]

    def split(self, tokens: Sequence[str]) -> list[str]:
        """Tokens with their Han runs cut."""
        return [w for t in tokens for w in (self.cut(t) if "㐀" <= t[:1] <= "鿿" or t[:1] > "\U0001ffff" or t[:1] == "々" else [t])]

    def column(self) -> Callable[[Column], Column]:
        """text -> its tokens in lower case, Han runs cut into words.  Only rows with Han text go to Python."""
        sent = self

        @F.pandas_udf("array<string>")
        def words(tokens: pd.Series) -> pd.Series:
            return tokens.map(lambda x: None if x is None else sent.split(list(x)))

        def tokens(text: Column) -> Column:
            t = F.lower(text_of(text))
            found = F.regexp_extract_all(t, F.lit(RUN), F.lit(0))
            return F.coalesce(words(F.when(t.rlike(r"\p{IsHan}"), found)), found)

        return tokens

    def phrases(self, word: str) -> list[str]:
        """The terms of one word of a query."""
        return self.split(re.findall(r"[㐀-䶿一-鿿]+|[^\W_㐀-䶿一-鿿]+", word.lower()))
