from __future__ import annotations

from findweave.session import ROW_GROUP_BYTES, drop_materialized, materialize, shared_dir


def test_materialized_tables_can_be_dropped(spark):
    df = materialize(spark.range(5), "t")
    assert df.count() == 5
    drop_materialized(spark)
    assert spark.sparkContext._findweave_tables == [] and shared_dir(spark)


def test_row_groups_of_materialized_tables_are_small(spark):
    """A task holds one row group on the heap, whatever it writes in all."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    texts = F.concat(*[F.sha2((F.col("id") * 32 + i).cast("string"), 256) for i in range(32)])
    df = materialize(spark.range(0, 20_000, 1, 1).select("id", texts.alias("text")), "t")
    (file,) = df.inputFiles()
    meta = pq.ParquetFile(file.removeprefix("file://")).metadata
    sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert sum(sizes) > 2 * ROW_GROUP_BYTES and max(sizes) < 1.25 * ROW_GROUP_BYTES and df.count() == 20_000


def test_rest_works_without_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "findweave", tmp_path / "findweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'feedback_assessment' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
