"""Common form of query results: whole numbers as bigint, fractions rounded to six places."""

from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal(df):
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)
