"""Chooses the settings of the neighbour vote: ``python -m tidemark.llm.choose_votes FOLDER...``

Only rows that the contract lets a model learn from are read (crc32 of doc_id modulo 3 is not 1).  They are the sample that ``knn.fit`` takes; near
duplicates share a fold.  Printed, best first, for each setting of the grid: error and mean square error, averaged over folders.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
from pyspark.sql import SparkSession, functions as F

from . import dartminhash, knn
from .common import doc_remainder, table

GRID = [
    knn.Settings(rank, k, sharpness, terms)
    for terms in ("chars", "runs", "both") for rank in (12, 24, 48, 96) for k, sharpness in itertools.product((5, 15, 31), (4.0, 8.0))
]


def training(spark: SparkSession, top: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Profiles, labels and groups of near duplicates."""
    rows = knn.sampled(table(spark, top, "documents"), table(spark, top, "labels").where(doc_remainder(3) != 1)).cache()
    classes = dartminhash.classes(rows).select(F.col("id").alias("doc_id"), "class_id").distinct()
    got = rows.join(classes, "doc_id").orderBy("doc_id", "label", "text").collect()
    return knn.profiles_of([r["text"] for r in got]), np.array([int(r["label"] > 0) for r in got]), np.array([r["class_id"] for r in got])


def main(folders: list[str]) -> None:
    spark = SparkSession.builder.config("spark.sql.shuffle.partitions", 8).config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    data = [training(spark, top) for top in folders]
    spark.stop()
    print("rows", [(len(y), int(y.sum())) for _, y, _ in data])
    found = [(*row, s) for row, s in zip(np.mean([knn.cross_validated(*d, GRID) for d in data], axis=0), GRID, strict=True)]
    for error, square, s in sorted(found, key=lambda f: f[:2]):
        print(f"{error:.5f} {square:.5f} {s}")


if __name__ == "__main__":
    main(sys.argv[1:])
