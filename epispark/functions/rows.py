"""Row selection that keeps a materialised column materialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_if(df: DataFrame, cond: Column) -> DataFrame:
    """Rows of ``df`` where ``cond`` is true (NULL counts as false).

    Same result as ``df.where(cond)``, but evaluated by a generator in the
    projection: Catalyst does not push it below the projection that
    computed ``cond``'s inputs.  With ``where``, a condition over a
    materialised column (e.g. lower-cased text tested against 80
    keywords) is pushed to the scan with the column's expression copied
    into every keyword test, which overflows the generated method and
    drops out of whole-stage codegen.
    """
    return df.select("*", F.explode(F.when(cond, F.array(F.lit(True)))).alias("_keep")).drop("_keep")
