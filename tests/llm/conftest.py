from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(n: int, seed: int = 1) -> list[tuple]:
    """Documents of invented words with near and exact copies, and the cases that must not crash."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts: list[str | None] = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.25 and texts[-1]:
            near = texts[rng.randrange(len(texts))] or "x"
            ws = near.split(" ")
            for _ in range(rng.randint(0, max(1, len(ws) // 20))):
                ws[rng.randrange(len(ws))] = rng.choice(words)
            texts.append(" ".join(ws))
        elif texts and kind < 0.35:
            texts.append(texts[rng.randrange(len(texts))])
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 220))))
    texts += [None, "", "   ", "\n\t", "one", "one", "One two three", "a b c d e", "!!! 123", "日本語 テキスト ﬁ ①", "x\x00y", "é \U0001f600 <|end|>", "word " * 3000, "y" * 50_000]
    rng.shuffle(texts)
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return made(160)


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """Written first, so that a scan's tasks are as on real tables; with columns whose names clash with the operators' own."""
    at = str(tmp_path_factory.mktemp("docs") / "d")
    df = spark.createDataFrame([(*r, "k", 1, 2.0, True) for r in rows], SCHEMA + ", node string, n int, score double, kept boolean")
    df.repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id < 0")
