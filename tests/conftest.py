import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textlytics.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8, app_name="textlytics-tests")
    yield s
    s.stop()


def docs_df(spark, texts):
    """Corpus fixture: doc ids in list order."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
