"""Words of a text as a column; text written without blanks falls into single code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run without white space that is longer than this is no word: it is taken code point by code point.
LONGEST_WORD = 47


def words(text: Column) -> Column:
    """The words between white space, in order; runs of over ``LONGEST_WORD`` code points are split into code points.

    Scripts without blanks thus give one word a code point, and an edit inside them changes a few words only.
    """
    found = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    split = F.flatten(F.transform(found, lambda w: F.when(F.length(w) > LONGEST_WORD, F.split(w, "")).otherwise(F.array(w))))
    # the pattern costs one pass; only texts with a long run take the second form
    return F.when(text.rlike(rf"\S{{{LONGEST_WORD + 1}}}"), split).otherwise(found)
