import pytest

from sitegrain.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


def page(spark, html, url="https://www.acme.example/x", page_id=1):
    return spark.createDataFrame([(page_id, url, html)], "page_id bigint, url string, html string")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
