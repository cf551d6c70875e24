"""Sending this package to the Python workers of a session, wherever they run."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: the package, as a zip, by the session's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root, to = Path(__file__).parents[2], Path(tempfile.mkdtemp(prefix="corvane-code-")) / "corvane.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in [*sorted((root / "corvane").rglob("*.py")), *root.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(to))
    _sent.add(sc.applicationId)


def shipping(query: Query) -> Query:
    """The query, which sends the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
