"""Operators for preparing training data (documents, pages, embeddings).

Their tasks run Python that imports this package, so the folder that holds it
is put on the workers' path: through the environment for sessions started
later, through the context for one that runs already.
"""

import os

from pyspark import SparkContext


def _reach_workers() -> None:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if SparkContext._active_spark_context is not None:
        SparkContext._active_spark_context.environment.setdefault("PYTHONPATH", root)


_reach_workers()
