"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word in the token estimate (TESTDATA.md): what stands between space, tab, CR, LF, FF.
WORD = r"[^ \t\r\n\f]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null, empty and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def token_estimate(text: Column) -> Column:
    """floor(13 x words / 10) as BIGINT."""
    return F.floor(word_count(text).cast("bigint") * 13 / 10).cast("bigint")
