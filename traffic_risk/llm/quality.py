"""Quality of documents: base rules, and the likelihood ratio of hashed n-grams.

Xie, Santurkar, Ma and Liang: Data Selection for Language Models via Importance Resampling (2023). Words and
word pairs are hashed into buckets; two multinomials over the buckets, add-one smoothed, are counted over all
documents of the corpus and over all trusted documents. A document's score is the mean log ratio of its
n-grams, so length does not matter; it is kept if the score reaches a fixed quantile of the trusted documents'
scores (counted in bins of fixed width, so exact to a bin and the same in any order).

Built-in functions only. Everything about one document is computed from its own row; the only shuffles are sums
per bucket, per bin and the trusted ids.

Defined cases: a null text has no words; documents without words score 0 and fail the base rules; with no trusted
document at all the method rejects nothing; a score equal to the threshold is kept; repeated rows each get a row; texts of any length are counted
whole; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traffic_risk.llm.common import SPACE, written

# Fixed values.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]"
LEAST_WORDS = 50
MOST_REPEATED = 50
"""Per cent of words in repeated windows."""


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 1 << 13
    quantile: float = 0.002
    """Share of trusted documents that may score below the threshold."""
    bins_per_unit: int = 1000


def words_of(text: Column) -> Column:
    """Words as an array; empty for texts without any."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def base_measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``words`` and the base counts of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def without(chars: str) -> Column:
        return F.length(F.translate(text, chars, ""))

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    first = docs.select(
        F.col(id_col),
        words_of(F.col(text_col)).alias("words"),
        without(BLANKS).cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    measured = first.select(
        id_col,
        "words",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows("words").alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    return measured.withColumn(
        "n_repeat_words", F.when(repeats, _covered("windows")).otherwise(F.lit(0)).cast("long")
    ).drop("windows")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _windows(words: str) -> Column:
    """A 64-bit hash of every window of three words."""
    return F.expr(
        f"CASE WHEN size({words}) < 3 THEN cast(array() AS array<bigint>) ELSE "
        f"transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2])) END"
    )


def _covered(windows: str) -> Column:
    """Words inside windows that occur twice or more.

    Places are sorted by the upper bits of the window's hash, as one number each; a place counts if the whole
    hash of a neighbour equals its own. Then every place, in order, adds the words the last one left uncovered.
    """
    places = f"sort_array(transform({windows}, (h, i) -> shiftleft(shiftright(h, bits), bits) | cast(i AS bigint)))"
    hash_at = f"{windows}[cast({{}} & (shiftleft(1L, bits) - 1) AS int)]"
    same = f"{hash_at.format('x')} = {hash_at.format('p[{}]')}"
    twice = f"filter(p, (x, j) -> (j > 0 AND {same.format('j - 1')}) OR (j + 1 < size(p) AND {same.format('j + 1')}))"
    inside = f"sort_array(transform({twice}, x -> cast(x & (shiftleft(1L, bits) - 1) AS int)))"
    summed = (
        f"aggregate({inside}, struct(-3 AS last, 0 AS n), "
        "(a, x) -> struct(x AS last, a.n + least(3, x - a.last) AS n)).n"
    )
    bits = f"CASE WHEN size({windows}) < 1048576 THEN 20 ELSE 31 END"
    return F.expr(_let("bits", bits, _let("p", places, summed)))


def _buckets(words: str, buckets: int) -> str:
    """Buckets of all words and word pairs."""
    pairs = (
        f"CASE WHEN size({words}) < 2 THEN cast(array() AS array<int>) ELSE transform(sequence(0, size({words}) - 2), "
        f"i -> cast(pmod(xxhash64({words}[i], {words}[i + 1]), {buckets}L) AS int)) END"
    )
    return f"concat(transform({words}, w -> cast(pmod(xxhash64(w), {buckets}L) AS int)), {pairs})"


def fit_ratios(
    docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, params: QualityParams
) -> list[float]:
    """Log ratio of every bucket: trusted documents against all documents, add-one smoothed.

    One number per bucket reaches the driver.
    """
    flagged = docs.select(F.col(id_col), F.col(text_col)).join(
        trusted.select(F.col(id_col), F.lit(1).alias("_trusted"))
        .where(F.col(id_col).isNotNull())
        .distinct()
        .hint("merge"),  # trusted ids grow with the corpus: one plan at every size
        id_col,
        "left",
    )
    words = flagged.select(F.coalesce("_trusted", F.lit(0)).alias("trusted"), words_of(F.col(text_col)).alias("words"))
    each = words.select("trusted", F.explode(F.expr(_buckets("words", params.buckets))).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("trusted").alias("t")).collect()
    raw, target = [1] * params.buckets, [1] * params.buckets
    for row in counts:
        raw[row.bucket] += row.n
        target[row.bucket] += row.t
    if sum(target) == params.buckets:
        return [0.0] * params.buckets
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [round(math.log(t) - math.log(r) + shift, 4) for r, t in zip(raw, target, strict=True)]


def score_words(words: str, ratios: list[float]) -> Column:
    """Mean log ratio of a document's n-grams; 0 without any."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    found = F.expr(_buckets(words, len(ratios)))
    total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1)).otherwise(F.lit(0.0))


def threshold(scored: DataFrame, trusted: DataFrame, id_col: str, params: QualityParams) -> float:
    """The lower edge of the bin that holds the quantile of the trusted scores."""
    ids = trusted.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct()
    bins = (
        scored.where("n_words > 0")
        .join(ids, id_col, "left_semi")
        .groupBy(F.floor(F.col("score") * params.bins_per_unit).alias("bin"))
        .count()
        .orderBy("bin")
        .collect()  # the scores' range in bins
    )
    left = params.quantile * sum(r["count"] for r in bins)
    for r in bins:
        left -= r["count"]
        if left < 0:
            return r["bin"] / params.bins_per_unit
    return -math.inf


def rate_quality(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    params: QualityParams = QualityParams(),
) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``score`` and ``kept``.

    ``trusted`` holds the ids of documents of the kind that is wanted.
    """
    ratios = fit_ratios(docs, trusted, id_col, text_col, params)
    measured = base_measures(docs, id_col, text_col)
    scored = written(measured.withColumn("score", score_words("words", ratios)).drop("words"), "quality")
    least = threshold(scored, trusted, id_col, params)
    few = F.col("n_words") < LEAST_WORDS
    repeated = 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    rated = scored.withColumn("base_failed", few | repeated)
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
