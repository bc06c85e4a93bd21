import pytest

from assay.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("assay-tests", cores=4)
