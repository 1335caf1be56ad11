import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from copyhound.session import get_spark
    s = get_spark(cores=8, shuffle_partitions=8, checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    yield s
