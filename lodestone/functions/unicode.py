"""Unicode folding that SQL has no function for, by Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
