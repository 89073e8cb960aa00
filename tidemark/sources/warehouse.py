"""Loading a database: staged by Spark in parallel, then swapped in by one transaction.

Every table of a load is written to a staging table of its own; then one transaction locks
the targets, checks that their rows and the new ones belong together (one source group, one
currency), applies each table's policy and commits. Whatever fails, before or in the
transaction, leaves the targets as they were, and staging tables are dropped either way.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import values as V

#: replace: the rows are the table's whole new content; history: rows of other keys stay.
POLICIES = ("replace", "history")


class Load(NamedTuple):
    """Rows for a table: keys tell them apart; money names the column that a currency belongs to."""

    frame: DataFrame
    keys: list[str]
    policy: str = "replace"
    money: str | None = None


class Refused(ValueError):
    """The rows may not be loaded into this database."""


def _names(columns: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in columns)


def _staged(df: DataFrame, column: str, text_type: str | None) -> str:
    """A staged column as the target holds it."""
    text = text_type and isinstance(df.schema[column].dataType, T.StringType)
    return f'CAST(s."{column}" AS {text_type})' if text else f's."{column}"'


def _checked(name: str, load: Load) -> None:
    if load.policy not in POLICIES:
        raise ValueError(f"unknown policy {load.policy}")
    lacking = F.lit(False)
    for k in load.keys:
        lacking = lacking | F.col(k).isNull()
    repeated = load.frame.groupBy(*load.keys).agg(F.count("*").alias("n"), F.count_if(lacking).alias("nulls")).where((F.col("n") > 1) | (F.col("nulls") > 0))
    if not repeated.isEmpty():
        raise Refused(f"{name}: keys {load.keys} repeat or are null")


def _new(load: Load) -> tuple[set, set]:
    """The source groups and currencies of a load's rows."""
    df = load.frame
    groups = {r[0] for r in df.select(F.coalesce("source_group", F.lit("unverified")).alias("g")).distinct().limit(9).collect()} if "source_group" in df.columns else set()
    money = df.where(F.col(load.money).isNotNull()).select(V.currency(F.col("currency")).alias("c")).distinct().limit(9).collect() if load.money and "currency" in df.columns else []
    return groups, {r[0] for r in money}


class _Connection:
    """A JDBC connection on the driver, for short statements only."""

    def __init__(self, spark: SparkSession, url: str, user: str | None, password: str | None) -> None:
        manager = spark._jvm.java.sql.DriverManager
        self.own = manager.getConnection(url, user, password) if user else manager.getConnection(url)
        self.own.setAutoCommit(False)

    def run(self, sql: str) -> int:
        statement = self.own.createStatement()
        try:
            return statement.executeUpdate(sql)
        finally:
            statement.close()

    def values(self, sql: str) -> set:
        statement = self.own.createStatement()
        try:
            found, out = statement.executeQuery(sql), set()
            while found.next():
                out.add(found.getString(1))
            return out
        finally:
            statement.close()

    def columns(self, table: str) -> set[str] | None:
        """A table's columns, None without such a table."""
        known: set[str] = set()
        for name in (table, table.upper(), table.lower()):
            found = self.own.getMetaData().getColumns(None, None, name, None)
            while found.next():
                known.add(found.getString("COLUMN_NAME"))
        return known or None


def load(spark: SparkSession, url: str, tables: dict[str, Load], user: str | None = None, password: str | None = None, text_type: str | None = None, others: dict[str, str | None] | None = None, **options: str) -> dict[str, int]:
    """Loads tables and returns their rows; lacking ones are made.

    others: tables that aren't loaded but must agree in source group and, by the column
    named, in currency. text_type: the database's type for text where its own choice can't
    be compared (a large object, say).
    """
    for name, one in tables.items():
        _checked(name, one)
    groups, currencies = set(), set()
    for one in tables.values():
        g, c = _new(one)
        groups, currencies = groups | g, currencies | c
    if len(groups) > 1:
        raise Refused(f"mixed source groups: {sorted(groups)}")
    stage = {name: f"{name}_{uuid.uuid4().hex[:12]}" for name in tables}
    access = {"url": url, **({"user": user, "password": password or ""} if user else {}), **options}
    connection = _Connection(spark, url, user, password)
    try:
        for name, one in tables.items():
            kinds = ", ".join(f"`{f.name}` {text_type}" for f in one.frame.schema if isinstance(f.dataType, T.StringType)) if text_type else ""
            writer = {"createTableColumnTypes": kinds} if kinds else {}
            if connection.columns(name) is None:
                one.frame.limit(0).write.format("jdbc").options(dbtable=name, **access, **writer).mode("ignore").save()
            one.frame.write.format("jdbc").options(dbtable=stage[name], batchsize="1000", **access).mode("errorifexists").save()
        connection.own.commit()
        rows = {}
        both = {**{name: one.money for name, one in tables.items()}, **(others or {})}
        for name in sorted(both):  # in one order, so that two loads can't wait for each other
            connection.run(f"LOCK TABLE {name} IN EXCLUSIVE MODE")
        for name, money in both.items():
            if name in tables and tables[name].policy == "replace":
                continue  # its old rows go
            known = connection.columns(name) or set()
            if "source_group" in known:
                groups |= {g or "unverified" for g in connection.values(f'SELECT DISTINCT "source_group" FROM {name}')}
            if money and {"currency", money} <= known:
                currencies |= connection.values(f'SELECT DISTINCT "currency" FROM {name} WHERE "{money}" IS NOT NULL')
        if len(groups) > 1:
            raise Refused(f"the database holds another source group: {sorted(groups)}")
        if len(currencies) > 1:
            raise Refused(f"mixed currencies: {sorted(map(str, currencies))}")
        for name, one in tables.items():
            if one.policy == "replace":
                connection.run(f"DELETE FROM {name}")
            else:
                same = " AND ".join(f'{_staged(one.frame, k, text_type)} = {name}."{k}"' for k in one.keys)
                connection.run(f"DELETE FROM {name} WHERE EXISTS (SELECT 1 FROM {stage[name]} s WHERE {same})")
            staged = ", ".join(_staged(one.frame, c, text_type) for c in one.frame.columns)
            rows[name] = connection.run(f"INSERT INTO {name} ({_names(one.frame.columns)}) SELECT {staged} FROM {stage[name]} s")
        connection.own.commit()
        return rows
    except BaseException:
        connection.own.rollback()
        raise
    finally:
        for s in stage.values():
            if connection.columns(s) is not None:
                connection.run(f"DROP TABLE {s}")
        connection.own.commit()
        connection.own.close()


def read(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
