"""Numbers, units, bands and distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of similarity bands with the probability of the same stance, the bounds
#: of the labels with the labels, units compared, and the words by which a quote names a unit.
SAME_STANCE = ((0.50, 0.17), (0.55, 0.22), (0.60, 0.27), (0.65, 0.38), (0.70, 0.40), (0.75, 0.42), (0.80, 0.61), (0.85, 0.85), (0.90, 0.95), (1.01, 0.99))
LABEL_BOUNDS = (0.7, 0.6)
LABELS = ("값 일치", "개연성 있음", "판단 보류")
UNITS = ("m", "fl", "count", "minute", "second")
UNIT_WORDS = {
    "km": r"km|킬로미터|キロメートル|公里|千米",
    "m": r"(?<![a-z])m(?![a-z])|(?<!킬로)미터|(?<!キロ)メートル|(?<!千)米",
    "fl": r"FL\s*\d|비행\s*고도|フライトレベル",
    "count": r"개|회|발|건|枚|件|次|count",
    "minute": r"minute|분|分",
    "second": r"second|초|秒",
}
EARTH_KM = 6371.0


def banded(value: Column, bands: tuple[tuple[float, float], ...] = SAME_STANCE) -> Column:
    """The value of the first band whose upper bound exceeds ``value``; the last beyond; null stays."""
    out = F.lit(bands[-1][1])
    for bound, p in reversed(bands):
        out = F.when(value < bound, F.lit(p)).otherwise(out)
    return F.when(value.isNotNull(), out)


def label(score: Column) -> Column:
    """The display label of a score; an unknown score is withheld."""
    return F.when(score >= LABEL_BOUNDS[0], LABELS[0]).when(score >= LABEL_BOUNDS[1], LABELS[1]).otherwise(LABELS[2])


def comparable_value(number: Column, unit: Column) -> Column:
    """``<decimal> <unit>`` with kilometres in metres, equal for equal quantities; null for other units."""
    u = F.lower(F.trim(unit))
    value = F.when(u == "km", number.cast("decimal(38,10)") * 1000).otherwise(number.cast("decimal(38,10)")).cast("decimal(38,10)")
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(u.isin("km", *UNITS), F.concat_ws(" ", plain, F.when(u == "km", "m").otherwise(u)))


def states_number(folded: Column, number: Column) -> Column:
    """Whether a text states a number, thousands commas ignored."""
    bare = F.regexp_replace(folded, r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    found = F.regexp_extract_all(bare, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.exists(found, lambda n: n.try_cast("decimal(38,10)") == number.cast("decimal(38,10)"))


def states_unit(quote: Column, unit: Column) -> Column:
    """Whether a quote names a unit; true for units without known words."""
    out = F.lit(True)
    for u, words in UNIT_WORDS.items():
        out = F.when(unit == u, quote.rlike(f"(?i){words}")).otherwise(out)
    return out


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in whole kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.round(2 * EARTH_KM * F.asin(F.sqrt(a))).cast("bigint")


def unit_vector(v: Column) -> Column:
    """The vector at length one as doubles; null if empty, not finite or of length zero."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    fine = (F.size(d) > 0) & ~F.exists(d, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()) & (norm > 0)
    return F.when(fine, F.transform(d, lambda x: x / norm))


def clipped_cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors clipped to [0, 1], six places; an error if their sizes differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    bad = F.raise_error(F.lit("vectors of different sizes")).cast("double")
    return F.when(F.size(a) != F.size(b), bad).otherwise(F.round(F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0)), 6))
