"""Column functions: deterministic random numbers, names, and safe ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 2_147_483_648


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def random_int(key, seed: int = 0) -> Column:
    """A number in [0, 2**31) out of an MD5 digest of ``key`` (of any type, as text) and ``seed``; any SQL engine can make it."""
    digest = F.md5(F.concat_ws("#", _column(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(RANGE - 1))


def random_below(n, key, seed: int = 0) -> Column:
    """A number in [0, n)."""
    return F.pmod(random_int(key, seed), F.greatest(_column(n).cast("long"), F.lit(1).cast("long")))


def count_to(n) -> Column:
    """0 .. n - 1, and no elements for n <= 0."""
    n = _column(n).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def chunk_starts(n, chunk: int) -> Column:
    """0, chunk, 2 chunk, … below n; none for n <= 0.

    A case and not a filter before it: Spark would push the filter, and whatever makes the sequence, below joins and aggregates.
    """
    n = _column(n).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(chunk))).otherwise(F.array().cast("array<int>"))


def basename(path) -> Column:
    return F.element_at(F.split(_column(path), "/"), -1)


def dirname(path) -> Column:
    return F.regexp_replace(_column(path), "/[^/]*$", "")


def sanitize(name) -> Column:
    """REN1: runs of anything but letters, digits and ``_`` become one ``_``."""
    return F.regexp_replace(_column(name), "[^A-Za-z0-9_]+", "_")


# Fixed value: a control sequence of ECMA-48, that is its introducer, parameters, intermediates and a final character.
CONTROL_SEQUENCE = "(?:\x1b\\[|\x9b)[0-?]*[ -/]*[@-~]"


def strip_ansi(line) -> Column:
    """Terminal control sequences out, trailing space off."""
    return F.rtrim(F.regexp_replace(_column(line), CONTROL_SEQUENCE, ""))


def null_if_nan(x) -> Column:
    x = _column(x)
    return F.when(~F.isnan(x), x)


def path_part(path, k: int) -> Column:
    """The k-th part of a path; negative numbers count from the end; null if there is none."""
    return F.try_element_at(F.split(_column(path), "/"), F.lit(k))
