"""Bounds of what a request may ask for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and most of each parameter: fixed values.
BOUNDS = {"k": (1, 100), "limit": (1, 100), "count_limit": (1, 200), "history_limit": (1, 200), "rating": (1, 5)}
VARIANTS = ("generative", "popularity")


def checked(**values) -> None:
    """Raises for a parameter outside its bounds; None means that it was not given."""
    for name, value in values.items():
        if value is None:
            continue
        if name == "variant":
            if value not in VARIANTS:
                raise ValueError(f"variant must be one of {', '.join(VARIANTS)}")
        elif name == "offset":
            if value < 0:
                raise ValueError("offset must not be negative")
        else:
            least, most = BOUNDS[name]
            if not least <= value <= most:
                raise ValueError(f"{name} must be between {least} and {most}")


def rating_fits(rating: Column) -> Column:
    """Whether a library rating may be kept; a missing one may not."""
    least, most = BOUNDS["rating"]
    return F.coalesce(rating.between(least, most), F.lit(False))
