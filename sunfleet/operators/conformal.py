"""Conformal intervals stratified by quality score."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunfleet.functions.scalar import clip, digitize
from sunfleet.operators import quantiles


def band(qs: Column | str, n: int = 3) -> Column:
    """0 to n - 1 by equal parts of [0, 1 + 1e-9]; a score on an edge belongs to the band above."""
    edges = [(1.0 + 1e-9) * k / n for k in range(1, n)]
    return digitize(qs, edges)


class BandedConformal:
    """Half-widths by score band: the quantile of absolute errors at c * (n + 1) / n; of all errors where a band has none."""

    def __init__(self, n_bins: int = 3, confidence: float = 0.9):
        self.n_bins, self.confidence, self.bands = n_bins, confidence, None

    def calibrate(self, df: DataFrame, true: str = "true_pv", pred: str = "pred_pv", qs: str = "qs") -> BandedConformal:
        scores = df.select(F.abs(F.col(true) - F.col(pred)).alias("score"), band(qs, self.n_bins).alias("band")).where("score IS NOT NULL AND band IS NOT NULL")
        own = quantiles.by_group(scores, "band", "score", lambda n: [min(self.confidence * (n + 1) / n, 1.0)])
        missing = [b for b in range(self.n_bins) if b not in own]
        overall = quantiles.overall(scores, "score", [self.confidence])[0] if missing else None
        found = {b: (own[b][0], own[b][1][0]) if b in own else (0, overall) for b in range(self.n_bins)}
        rows = [(b, n, q, b / self.n_bins, (b + 1) / self.n_bins) for b, (n, q) in found.items()]
        self.bands = df.sparkSession.createDataFrame(rows, "band int, n_cal long, quantile double, qs_lo double, qs_hi double")
        return self

    def coverage_report(self) -> DataFrame:
        if self.bands is None:
            raise RuntimeError("calibrate() comes first")
        return self.bands

    def predict_interval(self, df: DataFrame, pred: str = "pred_pv", qs: str = "qs") -> DataFrame:
        """df with band, lower and upper; intervals are not clipped."""
        if self.bands is None:
            raise RuntimeError("calibrate() comes first")
        widths = self.bands.select("band", F.col("quantile").alias("__w"))  # n_bins rows
        out = df.withColumn("band", band(qs, self.n_bins)).join(F.broadcast(widths), "band", "left")
        return out.withColumns({"lower": F.col(pred) - F.col("__w"), "upper": F.col(pred) + F.col("__w")}).drop("__w")


class ScoreConformal:
    """Split-conformal intervals of predicted scores, by bins of the true score; textbook order statistics."""

    def __init__(self, alpha: float = 0.1, n_bins: int = 3, least: int = 4):
        self.alpha, self.n_bins, self.least, self.edges, self.widths = alpha, n_bins, least, None, None

    def fit(self, df: DataFrame, pred: str = "pred", true: str = "true") -> ScoreConformal:
        edges = quantiles.overall(df, true, [k / self.n_bins for k in range(self.n_bins + 1)])
        if edges[0] is None:
            raise ValueError("no true scores to fit on")
        self.edges = [edges[0] - 1e-6, *edges[1:]]
        rows = df.select(F.abs(F.col(true) - F.col(pred)).alias("score"), digitize(true, self.edges[1:-1]).alias("bin"))
        # the place'th score of n is the quantile at (place - 1) / (n - 1)
        place = lambda n: min(ceil((n + 1) * (1 - self.alpha)), n)
        share = lambda n: [(place(n) - 1) / max(n - 1, 1)]
        own = quantiles.by_group(rows, "bin", "score", share)
        few = [b for b in range(self.n_bins) if b not in own or own[b][0] < self.least]
        every = quantiles.by_group(rows, F.lit(0), "score", share)[0] if few else None  # too few of its own: all rows
        found = [(b, *(every if b in few else own[b])) for b in range(self.n_bins)]
        self.widths = df.sparkSession.createDataFrame([(b, q[0], n) for b, n, q in found], "bin int, half_width double, n long")
        return self

    def predict(self, df: DataFrame, pred: str = "pred") -> DataFrame:
        """df with bin, lower and upper, within [0, 1]."""
        if self.edges is None:
            raise AssertionError("fit() comes first")
        placed = df.withColumn("bin", digitize(clip(pred, self.edges[0], self.edges[-1]), self.edges[1:-1]))
        out = placed.join(F.broadcast(self.widths.select("bin", "half_width")), "bin", "left")
        return out.withColumns({"lower": clip(F.col(pred) - F.col("half_width"), 0.0, 1.0), "upper": clip(F.col(pred) + F.col("half_width"), 0.0, 1.0)}).drop("half_width")

    def interval_widths(self) -> DataFrame:
        return self.widths.select("bin", (2 * F.col("half_width")).alias("width"))
