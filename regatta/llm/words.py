"""Word splitting shared by the operators: words are runs of ``[^\\x20\\x09-\\x0D]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the contracts of the operators.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; a null or empty text has none.

    One regular-expression split in the JVM; a leading and a trailing run of
    white space each add one empty piece, which is taken off again.
    """
    edge = lambda at: F.substring(text, at, 1).rlike(SPACE).cast("long")
    pieces = F.size(F.split(text, f"{SPACE}+")).cast("long")
    return F.when(text.isNull() | (text == ""), F.lit(0).cast("long")).otherwise(pieces - edge(1) - edge(-1))
