"""Row dictionaries to pandas frames for Arrow."""

from __future__ import annotations

import pandas as pd


def frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Missing values stay None; whole numbers that may be missing take a nullable type."""
    kinds = {"long": "Int64", "int": "Int32", "boolean": "boolean", "double": "Float64"}
    types = {c.split()[0]: kinds.get(c.split()[1], object) for c in schema.replace("\n", " ").split(", ")}
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=t) for n, t in types.items()})
