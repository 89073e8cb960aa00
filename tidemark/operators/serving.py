"""What a dashboard or an export asks for: scopes, searches, pages, options, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import values as V

# Scopes by their source groups.
SCOPES = {"real": ("marketplace",), "simulation": ("simulation",), "unverified": ("unverified",)}


def in_scope(df: DataFrame, scope: str) -> DataFrame:
    """Rows of a scope ("all": every row); an unknown group is unverified."""
    if scope == "all":
        return df
    return df.where(F.coalesce(F.col("source_group"), F.lit("unverified")).isin(*SCOPES[scope]))


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows in which a column contains the query, whatever case and accents; a blank query keeps all."""
    if not query.strip():
        return df
    wanted = V.folded(F.lit(query.strip()))
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(V.folded(F.col(c).cast("string")), wanted), F.lit(False))
    return df.where(found)


def filter_catalog(df: DataFrame, query: str = "", brands: list[str] | None = None, categories: list[str] | None = None, sources: list[str] | None = None, minimum_rating: float = 0) -> DataFrame:
    out = search(df, query, ["product_name", "brand", "category"])
    for name, wanted in (("brand", brands), ("category", categories), ("source", sources)):
        if wanted:
            out = out.where(F.col(name).isin(*wanted))
    return out.where(F.col("rating") >= minimum_rating) if minimum_rating else out


def find(df: DataFrame, query: str = "", fields: list[str] | None = None, brand: str | None = None, min_rating: float | None = None, filters: dict[str, str] | None = None, limit: int = 20) -> DataFrame:
    """A search with equality filters (whatever case), a rating floor and a limit."""
    texts = fields or [f.name for f in df.schema if f.dataType.typeName() == "string"]
    out = search(df, query, texts)
    for name, wanted in ((filters or {}) | ({"brand": brand} if brand else {})).items():
        out = out.where(F.lower(F.col(name).cast("string")) == wanted.lower())
    if min_rating is not None:
        out = out.where(F.col("rating") >= min_rating)
    return out.limit(limit)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """ORDER BY and LIMIT in one: each task keeps n rows."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page, counted from 1; one below 1 is the first."""
    return df.orderBy(*order).offset(max(number - 1, 0) * size).limit(size)


def options(df: DataFrame, column: str) -> DataFrame:
    return df.where(~V.blank(F.col(column))).select(column).distinct().orderBy(column)


def comparable(df: DataFrame) -> DataFrame:
    """Rows whose price and rating can be compared."""
    p, r = F.col("price").cast("double"), F.col("rating").cast("double")
    return df.where(V.finite(p) & (p > 0) & V.finite(r) & r.between(1, 5))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose key is no parent's."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def csv_safe(df: DataFrame) -> DataFrame:
    """Every text column safe for spreadsheets."""
    return df.select(*[V.formula_safe(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema])


def numbered(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def exposition(measures: DataFrame, prefix: str = "tidemark") -> DataFrame:
    """Numeric columns of a few rows as lines `name{label="..."} value`: text columns are labels."""
    labels = [f.name for f in measures.schema if f.dataType.typeName() == "string"]
    numbers = [f.name for f in measures.schema if f.dataType.typeName() in ("double", "float", "integer", "long")]
    tags = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels])
    lines = F.array(*[F.concat(F.lit(f"{prefix}_{c}{{"), tags, F.lit("} "), F.col(c).cast("string")) for c in numbers])
    return measures.select(F.explode(F.array_compact(lines)).alias("line"))
