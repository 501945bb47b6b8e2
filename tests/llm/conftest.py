import pytest

from plumbline.llm.queries import vocabulary_path


@pytest.fixture(scope="session")
def vocab():
    return vocabulary_path()
