import pytest

from codefacts.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, partitions=4, app="codefacts-tests", shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


def rows(df, *columns):
    """Sorted tuples of the chosen columns."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
