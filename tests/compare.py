"""Row comparison that is blind to order and to int against float."""

import math

import pandas as pd

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1).astype(object)

    def one(x):
        if x is None or pd.isna(x):
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf":
            return repr(float(x)) if math.isfinite(x) else str(x)
        return str(x)

    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))
