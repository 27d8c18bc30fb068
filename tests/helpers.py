"""Shared by the tests."""

DATA = "/root/testdata"


def rows(df):
    """Rows of a pandas frame as sorted tuples of text, columns by name."""
    columns = sorted(df.columns)
    return sorted(tuple("None" if x is None or x != x else str(x) for x in r) for r in df[columns].itertuples(index=False))
