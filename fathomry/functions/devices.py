"""What follows from a kind of device."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomry.functions.paths import as_column

# Least and most files that are read at once, between which the number of processors decides.
READERS = {"ssd": (4, 16), "hdd": (1, 1), "network": (2, 2)}
OTHER_READERS = (2, 8)


def io_concurrency(kind: Column | str, cpus: Column | str) -> Column:
    """How many files to read at once from a device of this kind (ssd, hdd, network; others are unknown)."""
    kind, cpus = as_column(kind), as_column(cpus)
    between = lambda low, high: F.greatest(F.lit(low), F.least(F.lit(high), cpus))
    out = between(*OTHER_READERS)
    for name, bounds in READERS.items():
        out = F.when(kind == name, between(*bounds)).otherwise(out)
    return out.cast("int")
