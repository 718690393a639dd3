"""Operators in a session that the library did not make, in a process outside the repository."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pagelift.operators import diff, images, rasters, revision, structure
from pagelift.sources import documents, html

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
pages = spark.createDataFrame([(1, "<p>a<p>b")], "k int, html string")
print(documents.html_blocks(pages, ("k",)).count(), html.nodes(pages, ("k",)).count(), end=" ")
print(diff.word_diff(spark.createDataFrame([(1, "a b", "a c")], "k int, before string, after string"), ("k",)).first().ops[0].text, end=" ")
print(images.dithered(spark.createDataFrame([(1, [9.0, 255.0], 2)], "k int, pixels array<double>, width int"), ("k",)).first().pixels[1], end=" ")
rows = spark.createDataFrame([(1, 0, "some key")], "doc_id int, seq int, text_key string")
print(structure.planned(rows, rows.withColumnRenamed("seq", "plan_seq")).count())
"""


def test_workers_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240, check=False)
    assert done.stdout.split() == ["2", "4", "a", "255", "1"], done.stderr[-2000:]
