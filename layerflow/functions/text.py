"""Text expressions built from JVM-side functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A bracketed field reference inside an expression, and the column names a
# flow always has.
FIELD_TOKEN = r"\[([^\[\]]+)\]"
BUILTIN_COLUMNS = ("Table Names", "Number of Rows")


def title_case(text: Column) -> Column:
    """First letter of every blank-separated word in upper case, the rest in lower case."""
    words = F.split(F.lower(text), " ", -1)
    lifted = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(lifted, " ")


def split_literal(text: Column, sep: str) -> Column:
    """Split at a literal separator, keeping empty parts."""
    return F.split(text, re.escape(sep) if sep else sep, -1)


def field_tokens(expression: Column) -> Column:
    """All field names an expression refers to, in order, repeats included."""
    return F.regexp_extract_all(expression, F.lit(FIELD_TOKEN), F.lit(1))
