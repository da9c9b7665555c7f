"""Names of helper columns that no table already has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """A name for each base that differs, in any case, from all columns of the table."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = f"__{base}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
