import pytest

from grapevine.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session()
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
