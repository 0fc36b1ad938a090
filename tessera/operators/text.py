"""Text similarity of pairs (ref, hyp): ROUGE-L, corpus BLEU-4, word-sequence ratio."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V


def words_of(text: Column) -> Column:
    """Lower-cased words; an empty text has none."""
    return F.filter(F.split(F.lower(V.clean(text)), r"\s+"), lambda w: w != "")


def subsequence_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: one machine word (of any length) stands for a row of the table."""
    places: dict[str, int] = {}
    for i, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for word in a:
        hit = row & places.get(word, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([subsequence_length(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def lcs_length(a: Column, b: Column) -> Column:
    """Of two arrays of words, a batch at a time."""
    return F.pandas_udf(_lengths, "long")(a, b)


def rouge_l(pairs: DataFrame) -> DataFrame:
    """Adds lcs and rouge_l: the F1 of the longest common subsequence; 0 if either side is empty."""
    worded = pairs.withColumn("_r", words_of(F.col("ref"))).withColumn("_h", words_of(F.col("hyp")))
    found = worded.withColumn("lcs", lcs_length(F.col("_r"), F.col("_h")))
    score = F.coalesce(F.try_divide(2.0 * F.col("lcs"), F.size("_r") + F.size("_h")), F.lit(0.0))
    return found.withColumn("rouge_l", score).drop("_r", "_h")


def _grams(words: Column, n: int) -> Column:
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def bleu4(pairs: DataFrame) -> DataFrame:
    """One row: clipped matches and totals of 1- to 4-grams over the corpus, and BLEU-4 (0.1 for an absent match).

    Equal pairs count as often as there are; their n-grams are taken once."""
    alike = pairs.groupBy("ref", "hyp").agg(F.count("*").alias("pairs")).withColumn("key", F.sha1(F.concat_ws("\u0000", "ref", "hyp")))
    worded = alike.select("key", "pairs", words_of(F.col("ref")).alias("r"), words_of(F.col("hyp")).alias("h"))
    marked = lambda side, n: F.transform(_grams(F.col(side), n), lambda g: F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), g.alias("gram")))
    listed = [marked(side, n) for side in ("r", "h") for n in range(1, 5)]
    every = worded.select("key", "pairs", F.explode(F.concat(*listed)).alias("e")).select("key", "pairs", "e.*")
    counts = every.groupBy("key", "pairs", "n", "gram").agg(F.count_if(F.col("side") == "r").alias("in_ref"), F.count_if(F.col("side") == "h").alias("in_hyp"))
    sums = counts.groupBy("n").agg(F.sum(F.least("in_ref", "in_hyp") * F.col("pairs")).alias("matches"), F.sum(F.col("in_hyp") * F.col("pairs")).alias("total"))
    lengths = worded.agg(F.sum(F.size("r") * F.col("pairs")).alias("ref_words"), F.sum(F.size("h") * F.col("pairs")).alias("hyp_words"))
    wide = sums.groupBy().pivot("n", [1, 2, 3, 4]).agg(F.max("matches").alias("m"), F.max("total").alias("t"))
    ratio = lambda n: F.greatest(F.col(f"{n}_m").cast("double"), F.lit(0.1)) / F.greatest(F.col(f"{n}_t"), F.lit(1))
    mean = F.pow(ratio(1) * ratio(2) * ratio(3) * ratio(4), F.lit(0.25))
    penalty = F.when(F.col("hyp_words") >= F.col("ref_words"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("ref_words"), F.col("hyp_words"))))
    return wide.crossJoin(lengths).select(*(F.col(f"{n}_{c}").alias(f"{c}{n}") for n in (1, 2, 3, 4) for c in ("m", "t")), "ref_words", "hyp_words", F.floor(F.when(F.col("1_m") > 0, mean * penalty).otherwise(0.0) * 1e6 + 0.5).cast("long").alias("bleu_millionths"))


def similarity(pairs: DataFrame, key: str) -> DataFrame:
    """(key, matched, words, ratio): words in the matching blocks of the two word sequences, words of both, and twice the
    one over the other (1 if both are empty). Equal pairs are compared once a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[tuple, int] = {}
            matched = []
            for r, h in zip(batch["r"], batch["h"], strict=True):
                pair = (tuple(r), tuple(h))
                if pair not in known:
                    known[pair] = sum(m.size for m in SequenceMatcher(None, *pair).get_matching_blocks())
                matched.append(known[pair])
            words = batch["r"].map(len) + batch["h"].map(len)
            found = np.array(matched, dtype=np.int64)
            yield pd.DataFrame({key: batch[key], "matched": found, "words": words, "ratio": np.where(words > 0, 2.0 * found / np.maximum(words, 1), 1.0)})

    kind = dict(pairs.dtypes)[key]
    return pairs.select(key, words_of(F.col("ref")).alias("r"), words_of(F.col("hyp")).alias("h")).mapInPandas(run, f"{key} {kind}, matched long, words long, ratio double")
