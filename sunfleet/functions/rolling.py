"""Rolling statistics over row-count windows, by differences of running sums.

A sliding frame is aggregated anew for each row; here each sum costs one running window and one lag, whatever the window.
Values are centred on the key's mean before they are summed, and variances and correlations that are lost in rounding count as
zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A variance below this share of the mean square, and a correlation below this, is taken as zero.
TINY = 1e-12


class Rolling:
    """Collects running sums over (key, order), so that all statistics share one shuffle and one sort."""

    def __init__(self, key: str, order: str, window: int):
        self.key, self.order, self.window = key, order, window
        self.inputs: dict[str, Column] = {}
        self.shift: dict[str, Column] = {}

    @staticmethod
    def _kept(among: dict[str, Column], prefix: str, x: Column) -> Column:
        """The column for x; what was asked for before is not summed again."""
        for name, other in among.items():
            if str(other) == str(x):
                return F.col(name)
        name = f"{prefix}{len(among)}"
        among[name] = x
        return F.col(name)

    def sum(self, x: Column) -> Column:
        """Sum of x over the last `window` rows; NULL counts as 0."""
        return self._kept(self.inputs, "__s", F.coalesce(x.cast("double"), F.lit(0.0)))

    def count(self, x: Column) -> Column:
        return self._kept(self.inputs, "__s", x.isNotNull().cast("long"))

    def centre(self, x: Column) -> Column:
        """The mean of x over all rows of the key, as a column."""
        return F.coalesce(self._kept(self.shift, "__m", x), F.lit(0.0))

    def mean(self, x: Column, least: int) -> Column:
        m = self.centre(x)
        n = self.count(x)
        return F.when(n >= least, m + self.sum(x - m) / F.nullif(n, F.lit(0)))

    def _moments(self, x: Column) -> tuple[Column, Column, Column]:
        m = self.centre(x)
        return self.count(x), self.sum(x - m), self.sum((x - m) * (x - m))

    def std(self, x: Column, least: int) -> Column:
        """Sample standard deviation."""
        n, s, q = self._moments(x)
        spread = q - s * s / F.nullif(n, F.lit(0))
        return F.when((n >= least) & (n > 1), F.sqrt(F.when(spread > TINY * q, spread).otherwise(0.0) / F.nullif(n - 1, F.lit(0))))

    def corr(self, x: Column, y: Column, least: int) -> Column:
        """Correlation of complete pairs; NULL where either side is constant."""
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        a, b = self.centre(x), self.centre(y)
        n = F.nullif(self.count(x), F.lit(0))
        sx, sy = self.sum(x - a), self.sum(y - b)
        qx, qy, xy = self.sum((x - a) * (x - a)), self.sum((y - b) * (y - b)), self.sum((x - a) * (y - b))
        vx, vy = qx - sx * sx / n, qy - sy * sy / n
        ok = (n >= least) & (vx > TINY * qx) & (vy > TINY * qy)
        r = (xy - sx * sy / n) / F.sqrt(F.nullif(F.when(ok, vx * vy), F.lit(0.0)))
        return F.when(ok, F.when(F.abs(r) > TINY, r).otherwise(0.0))

    def apply(self, df: DataFrame, **results: Column) -> DataFrame:
        """df with the named results. The frame is the row and the window - 1 rows before it."""
        by_key = Window.partitionBy(self.key)
        running = by_key.orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
        ordered = by_key.orderBy(self.order)
        if self.shift:
            df = df.withColumns({n: F.avg(x).over(by_key) for n, x in self.shift.items()})
        df = df.withColumns({n: F.sum(x).over(running) for n, x in self.inputs.items()})
        df = df.withColumn("__before", F.lag(F.struct(*self.inputs), self.window).over(ordered))
        df = df.withColumns({n: F.col(n) - F.coalesce(F.col(f"__before.{n}"), F.lit(0)) for n in self.inputs})
        return df.withColumns(results).drop("__before", *self.inputs, *self.shift)
