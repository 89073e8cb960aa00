"""Delimited text of unknown encoding and separator: found per file by one pass over its lines, then read by group.

A file's encoding is the first of ENCODINGS that all its bytes fit; a stated encoding is
never replaced by another, and text that doesn't fit it is an error. The separator is the
one that gives all lines the same number of fields, the most of them; lines within quoted
text don't count. Files of the same encoding, separator and header are read together by
Spark's reader, all columns as text; a row of more or fewer fields than the header is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Encodings in the order in which they are tried, and bytes that the second has no sign for.
ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")
UNDEFINED_1252 = ("81", "8D", "8F", "90", "9D")
SEPARATORS = (",", "\t", ";", "|")
MARK = "﻿"


class Undecodable(ValueError):
    """Text that doesn't fit its stated encoding."""


class Malformed(ValueError):
    """A file whose lines don't have its header's fields."""


def _fields(line: Column, separator: str) -> Column:
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit(""))) + 1


def sniffed(spark: SparkSession, *paths: str, pattern: str = "*.{csv,tsv,txt}") -> list[Row]:
    """A row a file with a line: file, utf8 and cp1252 (whether its bytes fit), header, and for each separator the least and largest number of fields and the header's (n0 .. n3)."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(list(paths))
    rows = lines.select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("first"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    valid = F.is_valid_utf8("value")
    undefined = F.hex(F.col("value").cast("binary")).rlike(rf"^(?:..)*?(?:{'|'.join(UNDEFINED_1252)})")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    whole = quotes % 2 == 0  # a line of a quoted text over several lines mostly has an odd number
    counts = []
    for i, s in enumerate(SEPARATORS):
        n = F.when(whole, _fields(F.col("value"), s))
        counts += [F.min(n).alias(f"low{i}"), F.max(n).alias(f"high{i}"), F.min_by(_fields(F.col("value"), s), F.when(F.col("first"), F.col("at"))).alias(f"n{i}")]
    found = rows.groupBy("file").agg(F.bool_and(valid).alias("utf8"), F.bool_and(F.when(valid & (F.octet_length("value") == F.length("value")), True).otherwise(~undefined)).alias("cp1252"), F.min_by("value", F.when(F.col("first"), F.col("at"))).alias("header"), *counts)
    return found.select("file", "utf8", "cp1252", F.base64(F.col("header").cast("binary")).alias("header"), *[f"{k}{i}" for i in range(len(SEPARATORS)) for k in ("low", "high", "n")]).orderBy("file").collect()  # a row a file


def _western() -> tuple[str, str]:
    """The signs of windows-1252 that ISO-8859-1 doesn't have, in both readings."""
    codes = [b for b in range(0x80, 0xA0) if f"{b:02X}" not in UNDEFINED_1252]
    return bytes(codes).decode("latin1"), bytes(codes).decode("cp1252")


def _encoding(file: Row, stated: str | None) -> str:
    if stated is None:
        return ENCODINGS[0] if file["utf8"] else ENCODINGS[1] if file["cp1252"] else ENCODINGS[2]
    name = stated.lower().replace("_", "-")
    if name in ("utf-8", "utf8", "utf-8-sig") and not file["utf8"] or name in ("windows-1252", "cp1252") and not file["cp1252"]:
        raise Undecodable(f"{file['file']} isn't {stated}")
    return {"utf8": "UTF-8", "utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin1": "ISO-8859-1"}.get(name, stated)


def _separator(file: Row, stated: str | None) -> str:
    if stated is not None:
        return stated
    if file["file"].endswith(".tsv"):
        return "\t"
    steady = [(-file[f"high{i}"], i) for i in range(len(SEPARATORS)) if file[f"high{i}"] and file[f"low{i}"] == file[f"high{i}"] > 1]
    in_header = [(-file[f"n{i}"], i) for i in range(len(SEPARATORS))]
    return SEPARATORS[min(steady or in_header)[1]]


def read(spark: SparkSession, *paths: str, encoding: str | None = None, separator: str | None = None, pattern: str = "*.{csv,tsv,txt}", source: str | None = None) -> DataFrame:
    """The rows of delimited files by name or below the paths, columns by name, lacking ones null; source names a column for each row's file."""
    files = sniffed(spark, *paths, pattern=pattern)
    if not files:
        raise FileNotFoundError(f"no delimited text below {', '.join(paths)}")
    groups: dict[tuple, list[str]] = {}
    for f in files:
        by = _separator(f, separator)
        i = SEPARATORS.index(by) if by in SEPARATORS else None
        if i is not None and f[f"high{i}"] is not None and f[f"high{i}"] > f[f"n{i}"]:
            raise Malformed(f"{f['file']}: {f[f'high{i}']} fields below a header of {f[f'n{i}']}")
        groups.setdefault((_encoding(f, encoding), by, f["header"]), []).append(f["file"])
    frames = []
    for (coded, by, _), names in groups.items():
        path = [F.col("_metadata.file_path").alias(source)] if source else []
        western = coded == "windows-1252"  # which Spark reads as ISO-8859-1: the signs between 0x80 and 0x9F differ
        df = spark.read.options(header="true", sep=by, encoding="ISO-8859-1" if western else coded, multiLine="true", mode="FAILFAST", escape='"').csv(names)
        signs = _western() if western else ("", "")
        name = {c: c.translate(str.maketrans(*signs)).lstrip(MARK).strip().strip('"') for c in df.columns}
        text = lambda c: F.translate(F.col(f"`{c}`"), *signs) if western else F.col(f"`{c}`")
        frames.append(df.select(*[text(c).alias(n) for c, n in name.items()], *path))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
