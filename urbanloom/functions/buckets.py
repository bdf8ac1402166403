"""Signed logarithmic buckets of a fixed relative width, as column expressions."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least normal size of a double; what is smaller counts as zero.
TINY = sys.float_info.min


class Buckets:
    """The bucket scheme of a relative error `alpha`. The order of buckets is the order of values."""

    def __init__(self, alpha: float) -> None:
        if not 1e-6 <= alpha < 1:
            raise ValueError("alpha must lie between 1e-6 and 1")
        self.alpha = alpha
        self.gamma = (1 + alpha) / (1 - alpha)
        self.log = math.log(self.gamma)
        self.first = math.ceil(math.log(TINY) / self.log)
        self.infinite = math.ceil(math.log(sys.float_info.max) / self.log) - self.first + 3

    def of(self, value: Column) -> Column:
        """The bucket of a value: 0 for zero, else signed and rising with the value; NULL for NULL and NaN."""
        size = F.abs(value)
        level = F.when(size == float("inf"), self.infinite).otherwise(F.ceil(F.ln(size) / self.log) - self.first + 1)
        signed = F.when(size < TINY, 0).otherwise(F.when(value < 0, -level).otherwise(level))
        return F.when(~F.isnan(value), signed.cast("int"))

    def _edge(self, level: Column) -> Column:
        return F.when(level >= self.infinite, float("inf")).otherwise(F.exp((level + (self.first - 1)) * self.log))

    def bounds(self, bucket: Column) -> tuple[Column, Column]:
        """The least and the greatest value that a bucket can hold."""
        level, slack = F.abs(bucket).cast("double"), 1e-9
        inner, outer = self._edge(level - 1) * (1 - slack), self._edge(level) * (1 + slack)
        low = F.when(bucket == 0, -TINY).when(bucket > 0, inner).otherwise(-outer)
        high = F.when(bucket == 0, TINY).when(bucket > 0, outer).otherwise(-inner)
        return low, high

    def estimate(self, bucket: Column) -> Column:
        """The value whose relative distance to all values of the bucket is at most alpha."""
        middle = self._edge(F.abs(bucket).cast("double")) * (2 / (self.gamma + 1))
        return F.when(bucket == 0, 0.0).when(bucket > 0, middle).otherwise(-middle)
