"""Scans of the input tables, with explicit schemas throughout."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from math import prod
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halfstar.sources import schemas
from halfstar.sources.writers import materialise


class Dataset(NamedTuple):
    ratings: DataFrame
    movies: DataFrame
    tags: DataFrame
    links: DataFrame


class DatasetNotFound(FileNotFoundError):
    """One of the four input tables is missing."""


def scan_table(spark: SparkSession, folder: str, name: str, fmt: str = "csv") -> DataFrame:
    """Scan ``<folder>/<name>.<fmt>`` with the table's own schema."""
    reader = spark.read.schema(schemas.TABLES[name])
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(f"{folder.rstrip('/')}/{name}.{fmt}")


class BadLines(ValueError):
    """More lines of a table can't be read than allowed."""


class Checked(NamedTuple):
    rows: DataFrame
    rejects: DataFrame  # (line, reason, file)
    n_rows: int
    n_rejects: int


def scan_checked(spark: SparkSession, folder: str, name: str, max_bad: float = 0.0) -> Checked:
    """Scan ``<folder>/<name>.csv`` and account for every line: the good rows, and the lines that can't be rows.

    A line is rejected if it has too few or too many fields or one that isn't of its
    column's type (``malformed``), or no id, or no rating where the table has one
    (``incomplete``). The file is read once: good rows and rejects are written to one
    table in the scratch folder, in the order they are read, so that no task holds or sorts
    its lines, and counted while they are. If more than a share of ``max_bad`` of the
    lines is rejected, :class:`BadLines` tells how many and shows one.
    """
    schema = schemas.TABLES[name]
    asked = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    path = f"{folder.rstrip('/')}/{name}.csv"
    reader = spark.read.schema(asked).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
    needed = [c for c in ("userId", "movieId", "rating") if c in schema.names]
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in needed])
    reason = F.when(F.col("_line").isNotNull(), "malformed").when(incomplete, "incomplete")
    held = F.when(F.col("_line").isNotNull(), F.col("_line")).otherwise(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in schema.names]))
    lines = reader.csv(path).withColumns({"reason": reason, "file": F.when(reason.isNotNull(), F.input_file_name())})
    lines = lines.withColumns({"_line": F.when(reason.isNotNull(), held), "bad": reason.isNotNull()})
    counts = Observation(f"lines of {name}")
    lines = lines.observe(counts, F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))
    stored = materialise(lines, f"checked-{name}")
    n, bad = counts.get["n"] or 0, counts.get["bad"] or 0
    rejects = stored.where("bad").select(F.col("_line").alias("line"), "reason", "file")
    if bad > max_bad * n:
        example = rejects.first()
        raise BadLines(f"{bad} of {n} lines of {path} can't be read, for example ({example.reason}): {example.line}")
    return Checked(stored.where("not bad").select(*schema.names), rejects, n - bad, bad)


def load_dataset(spark: SparkSession, folder: str, fmt: str = "csv", max_bad: float | None = None) -> Dataset:
    """Load all four tables, or raise one clear error if any is missing.

    With ``max_bad``, CSV lines are checked (:func:`scan_checked`): up to that share of
    a table's lines may be unreadable and is left out, more is an error. Without it,
    fields that can't be read are null.
    """
    try:
        if max_bad is not None and fmt == "csv":
            return Dataset(*(scan_checked(spark, folder, name, max_bad).rows for name in Dataset._fields))
        return Dataset(*(scan_table(spark, folder, name, fmt) for name in Dataset._fields))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise DatasetNotFound(f"incomplete dataset in {folder}: {error.getMessage()}") from error


def typed_ratings(ratings: DataFrame) -> DataFrame:
    """Ratings as the ALS trainer wants them: int ids and a float rating."""
    return ratings.select(
        F.col("userId").cast("int"),
        F.col("movieId").cast("int"),
        F.col("rating").cast("float"),
        F.col("timestamp").cast("long"),
    )


def project_triples(ratings: DataFrame) -> DataFrame:
    return ratings.select("userId", "movieId", "rating")


def latest_ratings(ratings: DataFrame, *recency: str) -> DataFrame:
    """One rating per (user, item): the latest by ``recency``, most significant first.

    An aggregate, not a window, so copies of a hot pair are reduced before the
    shuffle. Structs are compared by sorting; :func:`latest_packed` hashes.
    """
    last = F.max(F.struct(*recency, "rating")).alias("last")
    return ratings.groupBy("userId", "movieId").agg(last).select("userId", "movieId", "last.rating", "last.timestamp")


def _whole(name: str, digits: int) -> Column:
    """The column as a whole number of at most so many digits; anything else is an error, null is null."""
    number = F.col(name).cast("long")
    fits = number.isNull() | number.between(0, min(10**digits, 2**63) - 1)
    return F.when(fits, number).otherwise(F.raise_error(F.concat(F.lit(f"{name} is negative or has over {digits} digits: "), number.cast("string"))))


def _joined_digits(numbers: list[tuple[Column, int]]) -> Column:
    """Whole numbers of so many digits, most significant first, as one decimal of up to 38 digits: joined as longs of 18 digits first."""
    power = lambda digits: F.lit(10**digits).cast("long")
    longs, room = [F.lit(0).cast("long")], 18  # least significant first
    for number, digits in reversed(numbers):
        if digits <= room:
            longs[-1] = longs[-1] + number * power(18 - room)
            room -= digits
        else:
            low = number % power(room) if room else F.lit(0).cast("long")
            longs[-1] = longs[-1] + low * power(18 - room if room else 0)
            longs.append(F.call_function("div", number, power(room)))
            room += 18 - digits
    key = longs[0].cast("decimal(38,0)")
    for place, part in enumerate(longs[1:], 1):
        key = (part.cast("decimal(18,0)") * F.lit(Decimal(10) ** (18 * place)) + key).cast("decimal(38,0)")
    return key


LONG = 2**63 - 1


@dataclass(frozen=True)
class Packing:
    """Whole numbers of known ``spans``, (name, least, size) most significant first, as one long that is ordered like them."""

    spans: tuple[tuple[str, int, int], ...]

    def key(self, numbers: dict[str, Column]) -> Column:
        """The number of a row, null if one of its ``numbers`` is; one outside its span is an error."""
        key = F.lit(0).cast("long")
        for name, least, size in self.spans:
            number = numbers[name].cast("long")
            outside = F.raise_error(F.concat(F.lit(f"{name} is not from {least} to {least + size - 1}: "), number.cast("string")))
            held = F.when(number.isNull() | number.between(least, least + size - 1), number).otherwise(outside)
            key = key * F.lit(size) + (held - F.lit(least))
        return key

    def number(self, name: str, key: Column) -> Column:
        at = [n for n, _, _ in self.spans].index(name)
        _, least, size = self.spans[at]
        below = prod(size for _, _, size in self.spans[at + 1:])
        return F.call_function("div", key, F.lit(below).cast("long")) % F.lit(size) + F.lit(least)


def packing(df: DataFrame, numbers: dict[str, Column], digits: dict[str, int]) -> Packing | None:
    """How ``numbers`` of ``df``, most significant first, fit into one long; None if they don't. One job takes their least and greatest.

    None, too, for a column without any value, and for values that are negative or have more than their ``digits``.
    """
    edges = [f(c.cast("long")).alias(f"{f.__name__}_{n}") for n, c in numbers.items() for f in (F.min, F.max)]
    ends = df.agg(*edges).first()
    spans = [(n, ends[f"min_{n}"], ends[f"max_{n}"]) for n in numbers]
    if any(least is None or least < 0 or most >= 10 ** digits[n] for n, least, most in spans):
        return None
    sized = tuple((n, least, most - least + 1) for n, least, most in spans)
    return Packing(sized) if prod(size for _, _, size in sized) <= LONG else None


def half_stars() -> Column:
    return F.round(F.col("rating") * 2).cast("long")


def latest_packed(ratings: DataFrame, recency: dict[str, int], packed: Packing | None = None) -> DataFrame:
    """One rating per (user, item): the latest by timestamp, then by ``recency``, then the highest.

    ``recency`` names columns of whole numbers, most significant first, with the
    decimal digits each may have. With the timestamp (10 digits) and the rating in
    half stars (2) they make one number of up to 38 digits, so the table is reduced
    by a hash aggregate, before and after its one shuffle, where a struct would be
    sorted. Time and rating go along as one whole number, so that they needn't be
    taken out of the long one. Rows with a null in any of them are left out.

    With ``packed`` that number is a long, the column ``key`` of ``ratings`` (:func:`recency_key`).
    """
    if packed is not None:
        last = ratings.where("key is not null").groupBy("userId", "movieId").agg(F.max("key").alias("key"))
        value = lambda name: packed.number(name, F.col("key"))
        return last.select("userId", "movieId", (value("rating") / F.lit(2.0)).alias("rating"), value("timestamp").alias("timestamp"))
    widths = {"timestamp": 10, **recency}
    if sum(widths.values()) + 2 > 38:
        raise ValueError(f"{sum(widths.values()) + 2} digits don't fit into a number of 38")
    halves = half_stars()
    wholes = {name: _whole(name, digits) for name, digits in widths.items()}
    key = _joined_digits([*[(wholes[name], digits) for name, digits in widths.items()], (halves, 2)])
    held = (wholes["timestamp"] * 100 + halves).alias("held")
    packed = ratings.select("userId", "movieId", held, key.alias("key")).where("key is not null")
    last = packed.groupBy("userId", "movieId").agg(F.max_by("held", "key").alias("held"))
    return last.select(
        "userId", "movieId", (F.col("held") % 100 / F.lit(2.0)).alias("rating"), F.call_function("div", "held", F.lit(100)).alias("timestamp")
    )


def recency_key(ratings: DataFrame, recency: dict[str, int]) -> tuple[Column, Packing] | None:
    """(key, packing) of timestamp, ``recency`` and rating for :func:`latest_packed`, or None if they don't fit into a long."""
    numbers = {"timestamp": F.col("timestamp"), **{name: F.col(name) for name in recency}, "rating": half_stars()}
    packed = packing(ratings, numbers, {"timestamp": 10, **recency, "rating": 2})
    return None if packed is None else (packed.key(numbers), packed)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Re-read a results CSV; its columns depend on the models, so types are inferred."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
