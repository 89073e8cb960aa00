from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_stands_without_the_optional_subpackage(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') and n[2].isdigit()]"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert {"date", "product_id", "avg_rating", "price_source"} <= set(df.columns) and not df.isEmpty()


def test_methods_that_hotspot_does_not_compile_are_split(spark):
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    entry.queries()["star_distribution"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
