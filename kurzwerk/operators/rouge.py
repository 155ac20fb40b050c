"""ROUGE-1, ROUGE-2 and ROUGE-L of (reference, candidate) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kurzwerk.functions import text as X
from kurzwerk.functions.overlap import overlap_counts


def precision_recall_f(df: DataFrame, name: str) -> DataFrame:
    """Add ``{name}_p, _r, _f`` from the overlap and the two totals."""
    overlap = F.col(f"{name}_overlap")

    def ratio(total: str) -> Column:
        return F.when(F.col(total) > 0, overlap / F.col(total)).otherwise(0.0)

    df = df.withColumn(f"{name}_p", ratio(f"{name}_candidate")).withColumn(
        f"{name}_r", ratio(f"{name}_reference")
    )
    p, r = F.col(f"{name}_p"), F.col(f"{name}_r")
    return df.withColumn(f"{name}_f", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def rouge_scores(
    pairs: DataFrame,
    key: str = "pair_id",
    reference: str = "reference",
    candidate: str = "candidate",
    orders: Sequence[int] = (1, 2),
    longest: bool = True,
    stem: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Counts, precision, recall and F1 of every pair, row by row.

    Nothing is grouped, sorted or shuffled: one Arrow step codes the tokens of a batch
    and intersects the n-grams of each pair as sorted codes. ``orders`` are the lengths
    of the n-grams, ``longest`` adds the longest common subsequence. ``carry`` names
    columns of ``pairs`` to hand through. A null text has no tokens.
    """
    counts = overlap_counts(
        X.rouge_tokens(F.col(reference)), X.rouge_tokens(F.col(candidate)), orders, longest, stem
    )
    scores = pairs.select(key, *carry, counts.alias("_n"))
    names = []
    for n in orders:
        name = f"rouge{n}"
        names.append(name)
        columns = {f"{name}_overlap": F.col(f"_n.shared_{n}")}
        for side in ("reference", "candidate"):
            columns[f"{name}_{side}"] = F.greatest(F.col(f"_n.n_{side}") - (n - 1), F.lit(0))
        scores = scores.withColumns(columns)
    if longest:
        names.append("rougeL")
        columns = {f"rougeL_{side}": F.col(f"_n.n_{side}") for side in ("reference", "candidate")}
        scores = scores.withColumns({"rougeL_overlap": F.col("_n.lcs"), **columns})
    for name in names:
        scores = precision_recall_f(scores, name)
    return scores.select(
        key,
        *carry,
        *[f"{n}_{s}" for n in names for s in ("overlap", "reference", "candidate", "p", "r", "f")],
    )
