import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slantscan.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="slantscan-tests")
    yield s


def texts_df(spark, texts, model=None):
    rows = [(i, t, model if model is not None else 0.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, comment_text string, model_score double")
