"""Scalar expressions on columns: cleaning of dirty fields, labels, recodings. All built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits_id(c: Column | str) -> Column:
    """The first run of digits of an id, as text; null without one."""
    return F.nullif(F.regexp_extract(_c(c), r"(\d+)", 1), F.lit(""))


def leading_number(c: Column | str, missing: float = -999.0) -> Column:
    """The number that a text starts with; ``missing`` and texts that start otherwise are null."""
    got = F.nullif(F.regexp_extract(F.trim(_c(c).cast("string")), r"^(-?[0-9]+\.?[0-9]*)", 1), F.lit("")).try_cast("double")
    return F.nullif(got, F.lit(missing))


def strip_non_numeric(c: Column | str) -> Column:
    """All but digits, points and minus signs dropped, then a number; null where that is none."""
    return F.regexp_replace(_c(c).cast("string"), r"[^0-9.\-]", "").try_cast("double")


def strip_prefix(c: Column | str, n: int) -> Column:
    return F.substr(_c(c), F.lit(n + 1))


def pad_id(c: Column | str, width: int = 3) -> Column:
    """Ids of digits alone filled up with zeros on the left; longer or other ids stay."""
    x = _c(c).cast("string")
    return F.when(x.rlike(r"^\d+$"), F.lpad(x, F.greatest(F.lit(width), F.length(x)), F.lit("0"))).otherwise(x)


def log_power(c: Column | str, floor: float = 1e-20) -> Column:
    return F.log10(_c(c) + F.lit(floor))


def neg_log10_p(c: Column | str, top: float = 10.0) -> Column:
    """-log10 of a p-value; ``top`` where it is 0, 0 where it is missing."""
    p = F.coalesce(_c(c), F.lit(1.0))
    return F.when(p > 0, -F.log10(p) + F.lit(0.0)).otherwise(F.lit(top))


def stars(c: Column | str, trend: bool = False) -> Column:
    """``***`` below 0.001, ``**`` below 0.01, ``*`` below 0.05; with ``trend`` a dagger below 0.1."""
    p = _c(c)
    low = F.when(p < 0.1, "†").otherwise("") if trend else F.lit("")
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(low)


def bins(c: Column | str, cuts: list[tuple[float, str]], other: str) -> Column:
    """The label of the first cut, from high to low, that the value lies above."""
    out = None
    for cut, label in sorted(cuts, reverse=True):
        out = F.when(_c(c) > cut, label) if out is None else out.when(_c(c) > cut, label)
    return out.otherwise(other)


def recode(c: Column | str, groups: dict[str, list]) -> Column:
    """The name of the list that holds the value; null, to be filtered, where none does."""
    out = None
    for name, values in groups.items():
        out = F.when(_c(c).isin(values), name) if out is None else out.when(_c(c).isin(values), name)
    return out if out is not None else F.lit(None).cast("string")
