import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from datavitals import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false", spark__python__sql__dataFrameDebugging__enabled="false",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def samples(spark, tmp_path_factory):
    from datavitals.sources.readers import read_csv
    from tests import samples as texts

    folder = tmp_path_factory.mktemp("samples")
    out = {}
    for name, text in (("base", texts.BASE), ("new", texts.NEW)):
        path = folder / f"{name}.csv"
        path.write_text(text)
        out[name] = read_csv(spark, str(path))
    return out
