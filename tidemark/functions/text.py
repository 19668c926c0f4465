"""Measures of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RESTRICTED = ["gpl", "gpl-2.0", "gpl-3.0", "gplv2", "gplv3", "agpl", "agpl-3.0", "agplv3", "lgpl", "lgpl-3.0", "cc-by-nc", "cc-by-nc-nd", "proprietary", "commercial"]
ALLOWED = ["mit", "apache-2.0", "apache", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "cc-by-4.0", "python-2.0", "zlib", "mpl-2.0"]


def entropy(s: Column) -> Column:
    """Shannon entropy in bits a character, three decimals; 0 for the empty string."""
    n = F.length(s)
    chars = F.split(s, "")
    kinds = F.array_distinct(chars)
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    total = F.aggregate(kinds, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(n > 0, F.round(total, 3)).otherwise(F.lit(0.0))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reversed_ = F.split(F.reverse(digits), "")
    values = F.transform(reversed_, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def classes(s: Column) -> Column:
    """How many of upper case, lower case, digits and others occur."""
    return sum((s.rlike(p).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))


def keep_four(s: Column) -> Column:
    """Enough to identify a secret, and no more."""
    return F.when(F.length(s) <= 4, F.lit("[REDACTED]")).otherwise(F.concat(F.substring(s, 1, 4), F.lit("…[REDACTED]")))


def license_status(name: Column) -> Column:
    norm = F.replace(F.replace(F.lower(F.trim(name)), F.lit("-or-later"), F.lit("")), F.lit("-only"), F.lit(""))
    return (
        F.when(name.isNull() | (name == ""), "missing")
        .when(norm.isin(RESTRICTED), "restricted")
        .when(norm.isin(ALLOWED), "allowed")
        .when(norm.contains("gpl") | norm.contains("affero"), "restricted")
        .otherwise("unknown")
    )
