"""Words of texts for full-text search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anything but letters and digits separates words.
SEPARATOR = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")
