"""Loading address-range tables: autonomous systems (TSV or CSV) and cities (CSV), plain or gzip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlens.functions.ip import ipv4_number

MAX_ASN = 2**32 - 1
_BAD = "_bad_record"


def _not_empty(ranges: DataFrame, what: str) -> DataFrame:
    if ranges.isEmpty():
        raise ValueError(f"{what}: no valid row found, wrong format?")
    return ranges


def _asn_number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def _valid_asn_ranges(rows: DataFrame) -> DataFrame:
    """Rows with two good addresses and a real system number; 0 stands for "not routed" and is dropped."""
    return (
        rows.select(
            ipv4_number(F.col("start")).alias("start"),
            ipv4_number(F.col("end")).alias("end"),
            _asn_number(F.col("asn")).alias("asn"),
            "country",
            "org",
        )
        .where(F.col("start").isNotNull() & F.col("end").isNotNull())
        .where(F.col("asn").between(1, MAX_ASN))
    )


def parse_asn_lines(lines: DataFrame) -> DataFrame:
    """``start, end, asn, country, org`` from tab-separated lines in column ``value``; odd lines are skipped."""
    fields = F.split("value", "\t")
    names = ("start", "end", "asn", "country", "org")
    rows = (
        lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
        .where(F.size(fields) >= 5)
        .select(*[F.get(fields, F.lit(i)).alias(name) for i, name in enumerate(names)])
    )
    return _valid_asn_ranges(rows)


def load_asn_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Five-column TSV of system ranges; raises when nothing in it is usable."""
    return _not_empty(parse_asn_lines(spark.read.text(path)), path)


def _read_quoted(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """Quoted CSV without header as text columns. Rows with too few columns are left out, extra columns ignored."""
    schema = ", ".join(f"`{n}` string" for n in (*names, _BAD))
    reader = spark.read.schema(schema).options(
        quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD, columnPruning="false"
    )
    rows = reader.csv(path)
    whole = F.col(_BAD).isNull() | F.col(names[-1]).isNotNull()
    return rows.where(whole).select(*[F.coalesce(n, F.lit("")).alias(n) for n in names])


def load_asn_csv(spark: SparkSession, path: str) -> DataFrame:
    """Four-column quoted CSV ``start, end, asn, org``. It names no country, and none is made up."""
    rows = _read_quoted(spark, path, ("start", "end", "asn", "org")).withColumn("country", F.lit(""))
    return _not_empty(_valid_asn_ranges(rows), path)


def load_city_csv(spark: SparkSession, path: str) -> DataFrame:
    """Eight-column quoted CSV of city ranges; the unknown country ``ZZ`` is dropped, bad coordinates become 0."""
    names = ("start", "end", "continent", "country", "region", "city", "latitude", "longitude")
    rows = _read_quoted(spark, path, names).where(F.col("country") != "ZZ")
    zero = F.lit(0.0).cast("float")
    ranges = rows.select(
        ipv4_number(F.col("start")).alias("start"),
        ipv4_number(F.col("end")).alias("end"),
        "country",
        "region",
        "city",
        F.coalesce(F.col("latitude").try_cast("float"), zero).alias("latitude"),
        F.coalesce(F.col("longitude").try_cast("float"), zero).alias("longitude"),
    ).where(F.col("start").isNotNull() & F.col("end").isNotNull())
    return _not_empty(ranges, path)
