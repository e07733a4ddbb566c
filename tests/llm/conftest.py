import pytest


@pytest.fixture(scope="session")
def rows():
    def run(df, *cols):
        return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())

    return run
