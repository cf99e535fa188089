"""Arrow-batched pandas UDFs (the only per-row Python in the hot path).

No ``from __future__ import annotations`` here: pandas_udf reads the type
hints at definition time.
"""

import pandas as pd
from pyspark.sql.functions import pandas_udf


def recursive_splitter(size: int, overlap: int):
    from quarry.operators.corpus import split_recursive

    @pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive(t, size, overlap))

    return split
