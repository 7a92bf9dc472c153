"""Rule tables as literals where they are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

#: Rows up to which a rule table is put into expressions; a longer one is joined.
LITERALS = 256


def small_rows(rules: DataFrame, most: int | None = None) -> list[Row] | None:
    """The distinct rows of a rule table if there are at most `most` (by default `LITERALS`), else None.

    At most one row more than that comes to the driver.
    """
    most = LITERALS if most is None else most
    rows = rules.distinct().limit(most + 1).collect()
    return rows if len(rows) <= most else None
