import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandline.session import session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
                               "spark.ui.showConsoleProgress": "false", "spark.sql.maxMetadataStringLength": "2000"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def tables(spark):
    from registry.tables import Tables

    return Tables(spark, DATA)


def plane(spark, array, name="v", scene=0):
    """Pixel table of a 2-D array."""
    rows = [(scene, r, c, array[r, c].item()) for r in range(array.shape[0]) for c in range(array.shape[1])]
    kind = "double" if array.dtype.kind == "f" else "int"
    return spark.createDataFrame(rows, f"scene_id int, row int, col int, {name} {kind}")


def to_array(df, name, shape, dtype=float):
    import numpy as np

    out = np.full(shape, np.nan if dtype is float else -1, dtype=dtype)
    for r in df.select("row", "col", name).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out
