"""Readers of landed files and of rows that hold pages, payloads or certificates.

Nothing here crawls: what a network would deliver is read where it has landed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType



def json_array(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """A file of one JSON array, or of an object that holds it under ``field``; both at once."""
    if field is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    kind = f"array<struct<{schema}>>"
    plain = F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")), kind)
    rows = F.coalesce(plain, F.from_json("value", f"struct<`{field}`:{kind}>")[field])
    return raw.select(F.inline(rows))


def literal_array(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """An array that a script assigns to ``name``."""
    raw = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf"(?s)\b{re.escape(name)}\s*=\s*(\[.*?\])\s*;", 1)
    return raw.select(F.inline(F.from_json(body, f"array<struct<{schema}>>", {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})))


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", least_rows: int = 0) -> DataFrame:
    """A file with a header line; too few rows stop the job."""
    df = spark.read.schema(schema).csv(path, sep=sep, header=True)
    if least_rows and df.limit(least_rows).count() < least_rows:
        raise ValueError(f"{path} has fewer than {least_rows} rows")
    return df


def named_column(df: DataFrame, *candidates: str) -> Column:
    """The first candidate that the table has, whatever its case and signs; null if none."""
    fold = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    have = {fold(c): c for c in df.columns}
    found = [F.col(have[fold(c)]) for c in candidates if fold(c) in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def snapshot(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """A table of daily snapshots partitioned by ``day``, or one day of it (partition pruning)."""
    df = spark.read.parquet(path)
    return df if day is None else df.where(F.col("day") == F.lit(day).cast("date"))


def or_demo(delivered: DataFrame, demo: DataFrame) -> tuple[DataFrame, bool]:
    """The delivered table, or the demonstration one if nothing was delivered, and which it is."""
    return (demo, True) if delivered.isEmpty() else (delivered, False)


class _Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class PagedReader(DataSourceReader):
    """Pages of a registry: offset and limit; here of landed JSON lines files named by offset."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[_Page]:
        limit, total = int(self.options.get("limit", 1000)), int(self.options["total"])
        return [_Page(k, limit) for k in range(0, total, limit)]

    def read(self, page: _Page) -> Iterator[tuple]:
        with open(f"{self.options['path']}/{page.offset}.json", encoding="utf-8") as f:
            for row in json.load(f)[: page.limit]:
                yield tuple(row.get(field.name) for field in self.schema.fields)


class PagedRegistry(DataSource):
    """``spark.read.format("paged_registry").schema(...).option("path", ...).option("total", n)``"""

    @classmethod
    def name(cls) -> str:
        return "paged_registry"

    def schema(self) -> str:
        return "license_number string, entity_name string, address string, city string, zip string, status string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_text(html: Column) -> Column:
    """Visible text: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def html_links(html: Column) -> Column:
    """All link targets in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def table_rows(html: Column) -> Column:
    """Cells of each table row, as text."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(cells(r), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))))


def page_evidence(pages: DataFrame, html: str = "html") -> DataFrame:
    """What a page gives away: telephone numbers, link counts, menu provider; only what is seen.

    A number is taken where one is linked, else where one is visible, else it stays unknown."""
    linked = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)href=[\"']tel:([^\"']+)"), F.lit(1)))
    seen = F.array_distinct(F.regexp_extract_all(html_text(F.col(html)), F.lit(r"(\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4})"), F.lit(1)))
    low = F.lower(html)
    provider = F.when(low.contains("dutchie"), "dutchie").when(low.contains("iheartjane"), "jane").when(low.contains("leafly"), "leafly").when(low.contains("weedmaps"), "weedmaps")
    return pages.withColumns(
        {
            "phone": F.when(F.size(linked) == 1, linked[0]).when((F.size(linked) == 0) & (F.size(seen) == 1), seen[0]),
            "links": F.size(html_links(F.col(html))), "provider": provider, "delivery": F.when(low.rlike(r"\bdeliver(y|s)\b"), True),
        }
    )


def certificate_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, url, ord): links to certificates, each once a page."""
    wanted = F.filter(F.array_distinct(html_links(F.col(html))), lambda u: u.rlike(r"(?i)\.pdf([?#]|$)|\bcoas?\b|certificate"))
    return pages.select(key, F.posexplode(wanted).alias("ord", "url"))


def lab_rows(text: Column) -> Column:
    """(compound, figure, qualifier) lines of a certificate: ND and <LOQ are unknown with their
    qualifier, a bare 0 is reported zero."""
    lines = F.filter(F.split(text, "\n"), lambda t: t.rlike(r"(?i)^\s*[a-zα-ω][\w\s,()αβγδ-]+?\s+(nd|<\s*loq|<\s*lod|\d+(\.\d+)?)\s*%?\s*$"))
    name = lambda t: F.upper(F.trim(F.regexp_extract(t, r"(?i)^\s*(.+?)\s+(?:nd|<\s*loq|<\s*lod|\d+(?:\.\d+)?)\s*%?\s*$", 1)))
    figure = lambda t: F.nullif(F.regexp_extract(t, r"(\d+(?:\.\d+)?)\s*%?\s*$", 1), F.lit("")).cast("double")
    mark = lambda t: F.when(t.rlike(r"(?i)\snd\s*%?\s*$"), "ND").when(t.rlike(r"(?i)<\s*loq"), "LOQ").when(t.rlike(r"(?i)<\s*lod"), "LOD").when(figure(t) == 0, "reported_zero")
    return F.transform(lines, lambda t: F.struct(name(t).alias("compound"), figure(t).alias("percent"), mark(t).alias("qualifier")))
