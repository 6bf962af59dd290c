"""Text expressions shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words once case is folded: all but letters and digits (a to z and 0 to 9 are named as they are the quickest to tell).
NOT_WORD = r"[^a-z0-9\p{L}\p{N}]+"

#: Tells whether a text has a word, at its first letter or digit. A filter on the words themselves is pushed under the projection and cuts the text twice.
WORD = r"[a-z0-9\p{L}\p{N}]"


def words_of(column: str) -> Column:
    """The lower-cased letter and digit runs of a text column; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def hash_runs(words: str, n: int) -> str:
    """SQL for the XXH64 of every run of n words in the array column `words` (empty if there are fewer)."""
    rest = "".join(f", get({words}, i + {k})" for k in range(1, n))
    return f"CASE WHEN size({words}) >= {n} THEN transform(slice({words}, 1, greatest(size({words}) - {n - 1}, 0)), (w, i) -> xxhash64(w{rest})) ELSE array() END"


def let(value: str, name: str, body: str) -> str:
    """SQL for body with `name` standing for value, which is evaluated once.

    A filter on columns that are computed in steps is pushed under these steps, and every mention of a column becomes the whole
    expression again; a bound name stays one.
    """
    return f"transform(array({value}), {name} -> {body})[0]"
