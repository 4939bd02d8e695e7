"""Column expressions of the region model. Unmeasured is NULL, never NaN; measured-flat is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 4


def finite(x: Column) -> Column:
    """NaN and infinities become NULL; applied wherever numbers enter."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clamp(x: Column, low: float, high: float) -> Column:
    """greatest() and least() skip NULL, so NULL is kept apart."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def score_field(x: Column) -> Column:
    return F.round(clamp(x, 0.0, 1.0), DIGITS)


def direction_field(x: Column) -> Column:
    return F.round(clamp(x, -1.0, 1.0), DIGITS)


def region_key(chrom="chrom", start="start_pos", end="end_pos") -> Column:
    return F.concat(F.col(chrom), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def region_parts(key: Column) -> Column:
    """struct(chrom, start_pos, end_pos) of ``chrom:start-end``; NULL parts where the text has another form."""
    part = lambda i: F.nullif(F.regexp_extract(key, r"^(.+):(\d+)-(\d+)$", i), F.lit(""))
    return F.struct(part(1).alias("chrom"), part(2).cast("long").alias("start_pos"), part(3).cast("long").alias("end_pos"))


def l2_shift(a: Column, b: Column) -> Column:
    """Euclidean distance of two embeddings, in double."""
    double = "array<double>"
    squares = F.zip_with(a.cast(double), b.cast(double), lambda x, y: (y - x) * (y - x))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals: touching is not overlapping."""
    return (a_start < b_end) & (a_end > b_start)


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def is_vocabulary_chrom(chrom: Column) -> Column:
    """Chromosomes 1 to 22, X and Y."""
    return chrom.isin([f"chr{x}" for x in [*range(1, 23), "X", "Y"]])


def mentions(words: list[str], *columns: str) -> Column:
    """Which of the words occur anywhere in the row, in lower case and literally."""
    row = F.lower(F.concat_ws(" ", *columns))
    return F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(row, w))


def sampling_key(seed: int, key: Column | None = None) -> Column:
    """A text whose order is a seeded shuffle of regions, equal in every engine."""
    return F.md5(F.concat(region_key() if key is None else key, F.lit(f"|{seed}")))
