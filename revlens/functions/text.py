"""Text standardisation with PostgreSQL semantics, as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a maximal run of letters/digits; every other run is kept verbatim.
_RUNS = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"
# Where Spark's initcap may differ: beyond ASCII, and at a sign (but a space) that a letter or sign follows.
_OTHER = r"[^\p{Alnum} ](?:(?<=[^\x00-\x7F])|(?![\p{Digit} ]|\z))"


def pg_initcap(col: Column | str) -> Column:
    """PostgreSQL INITCAP: upper-case the first letter of every alphanumeric word, lower-case the rest.

    Spark's ``initcap`` only starts a word after a space (``mid-market`` ->
    ``Mid-market``); PostgreSQL starts one after any non-alphanumeric
    character (``Mid-Market``).  NULL stays NULL, '' stays ''.

    Text in which both begin the same words takes Spark's own function, at a fraction of the
    cost of cutting it into runs.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.rlike(_OTHER), _capped_runs(c)).otherwise(F.initcap(c))


def _capped_runs(c: Column) -> Column:
    runs = F.regexp_extract_all(F.lower(c), F.lit(_RUNS), F.lit(1))
    capped = F.transform(runs, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2))))
    return F.array_join(capped, "")


def standardize(col: Column | str) -> Column:
    """INITCAP(TRIM(x)) as used by the cleaned view (TRIM strips spaces only)."""
    c = F.col(col) if isinstance(col, str) else col
    return pg_initcap(F.trim(c))
