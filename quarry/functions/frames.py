"""Small tools for plans: columns computed once, and bounded heads that several stages read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that settled() takes to the driver at most.
SETTLED = 20_000


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column computed once a row. A generator, unlike a projection, is neither copied into the expressions
    that use it nor into the filters that the optimizer infers from them."""
    return df.withColumn(name, F.explode(F.array(value)))


def settled(df: DataFrame, most: int = SETTLED) -> DataFrame:
    """df as a local relation if it has at most `most` rows, so later stages neither compute it again nor shuffle for
    it; df itself, still lazy and distributed, if it has more."""
    rows = df.limit(most + 1).toArrow()
    return df if rows.num_rows > most else df.sparkSession.createDataFrame(rows, df.schema)
