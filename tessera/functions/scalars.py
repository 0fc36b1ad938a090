"""Column functions beside boxes and vocabulary: a learning-rate schedule and word wrapping."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate_factor(step: Column, warmup: int, total: int, floor: float = 0.01) -> Column:
    """Share of the peak rate at a step: a line up to 1 over the warm-up, then half a cosine down to floor, which stays."""
    rising = (step + 1) / float(max(1, warmup))
    done = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, rising).otherwise(floor + (1.0 - floor) / 2 * (1.0 + F.cos(done * math.pi)))


def wrapped(text: Column, width: int) -> Column:
    """The words of a text in lines of at most width characters, as full as they get; a longer word has its own line."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    last = lambda lines: F.length(F.substring_index(lines, "\n", -1))
    step = lambda lines, word: F.when(lines == "", word).otherwise(
        F.concat(lines, F.when(last(lines) + 1 + F.length(word) <= width, F.lit(" ")).otherwise(F.lit("\n")), word)
    )
    return F.split(F.aggregate(words, F.lit(""), step), "\n")
