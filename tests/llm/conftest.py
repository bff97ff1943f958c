import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def rows():
    from util import corpus

    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from util import frame

    return frame(spark, rows).repartition(3).persist()
