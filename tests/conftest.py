from __future__ import annotations

import math

import pytest

from siltstone.session import session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    where = tmp_path_factory.mktemp("shared")
    s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{where}", "spark.sql.warehouse.dir": str(where / "warehouse")})
    yield s
    s.stop()


def plain(x):
    """Values as both engines' results can be compared: floats to six places, nothing for NaN and null."""
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) if abs(x) < 1e9 else float(f"{x:.10g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(df):
    """A pandas frame as sorted rows with its columns in order of name."""
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted((tuple(plain(v) for v in r) for r in df.where(df.notna(), None).itertuples(index=False)), key=repr)
