"""Normalised grouping keys shared by several operators, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_key(name: Column) -> Column:
    """A source name without letter case and surplus white space; null stays null."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def country_key(country: Column) -> Column:
    """Upper-cased country code; null and blank become ``UNKNOWN``."""
    bare = F.upper(F.trim(F.regexp_replace(country, r"(?U)^\s+|\s+$", "")))
    return F.coalesce(F.when(bare != "", bare), F.lit("UNKNOWN"))
