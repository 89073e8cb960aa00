from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lower(t: str | None) -> str | None:
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def up(nodes: list[str], run: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + run]) for i in range(0, len(levels[-1]), run)])
    return levels


def walk(levels: list[list[str]], i: int, cur: str, run: int) -> tuple[list[str], str]:
    near = []
    for level in levels[:-1]:
        a = i // run * run
        left, right = level[a:i], level[i + 1 : a + run]
        near += left + right
        cur = h(*left, cur, *right)
        i //= run
    return near, cur


def brute(rows: list[tuple], run: int = 16) -> list[tuple]:
    of: dict = {}
    for r in rows:
        doc = r[0]
        bad = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        mine = leaf(r)
        of.setdefault(r[1], []).append((doc, mine, leaf((*r[:4], lower(r[4]))) if bad else mine))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        of[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees.append(up([x[1] for x in of[s]], run))
    top = up([t[-1][0] for t in trees], run)
    out = []
    for j, s in enumerate(names):
        for i, (doc, mine, claimed) in enumerate(of[s]):
            near, cur = walk(trees[j], i, claimed, run)
            more, cur = walk(top, j, cur, run)
            out.append((doc, mine, trees[j][-1][0], top[-1][0], h(*near, *more), cur, cur == top[-1][0]))
    return out


def got(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("run", [16, 2])
def test_against_a_loop(spark, docs, rows, run):
    table = [(d, s, lang, n, t) for d, t, lang, s, n in rows]
    assert got(merkle.manifest(docs, merkle.fifth(), run)) == sorted(brute(table, run), key=repr)


def test_many_sources_nulls_and_repeats(spark):
    table = [(i, f"s{i % 40}", "en", i, f"Text {i}") for i in range(300)]
    table += [(i, "hot", None, None, f"HOT {i % 7}") for i in range(1000, 1600)]
    table += [(5, "hot", None, None, "X"), (5, "hot", None, None, "X"), (5, "hot", None, None, "Y"), (None, "hot", "en", 1, "A"), (None, None, None, None, None), (7, None, None, 0, ""), (8, "", "é", -3, "É\U0001f600 A")]
    df = spark.createDataFrame([(*r, "k", 0) for r in table], f"{SCHEMA}, leaf string, idx int").repartition(5)
    assert got(merkle.manifest(df, merkle.fifth())) == sorted(brute(table), key=repr)


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_one_source(spark, n):
    table = [(i, "s", "en", 1, "A") for i in range(n)]
    out = merkle.manifest(spark.createDataFrame(table, SCHEMA), merkle.fifth())
    assert got(out) == sorted(brute(table), key=repr)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_tampering_shows(spark):
    table = [(i, "s", "en", 1, "Capital" if i % 2 else "small é") for i in range(200)]
    out = merkle.manifest(spark.createDataFrame(table, SCHEMA), merkle.fifth())
    wrong = {r[0] for r in out.where("NOT verified").collect()}
    assert wrong == {i for i in range(1, 200, 2) if zlib.crc32(str(i).encode()) % 5 == 0} and wrong
    assert out.where(F.col("folded_root").isNull()).isEmpty()


def test_sql(spark, tmp_path):
    table = [(i, [None, "b", "a"][i % 3], None if i % 11 == 0 else "en", i, None if i % 13 == 0 else f"Été {i}") for i in range(700)]
    spark.createDataFrame(table, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(merkle.oracle())
    assert [d[0] for d in cursor.description] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(cursor.fetchall(), key=repr) == got(merkle.manifest(spark.read.parquet(str(tmp_path / "documents.parquet")), merkle.fifth())) == sorted(brute(table), key=repr)
