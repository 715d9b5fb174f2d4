"""Batches that go to workers are of bounded bytes: what is made of a batch of texts takes many times its size."""

import pyarrow as pa
import pytest

from colweave import storage
from colweave.llm import common

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def session(spark):
    before = spark.conf.get(SETTING)
    spark.conf.unset(SETTING)
    yield spark
    spark.conf.set(SETTING, before)


def sizes(spark, maker):
    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["n", "rows"])

    texts = spark.range(0, 96, 1, 1).selectExpr("repeat('abcdefgh', 12500) AS x")  # 100 KB each, one task
    return [(r.n, r.rows) for r in maker(texts, run, "n long, rows long").collect()]


def test_batches_of_texts_are_of_two_megabytes(session):
    for _ in range(2):  # whatever the other part of the library has set before
        got = sizes(session, common.map_batches)
        assert sum(rows for _, rows in got) == 96 and max(n for n, _ in got) < 3 << 20
        assert max(n for n, _ in sizes(session, storage.map_batches)) > 5 << 20


def test_a_setting_of_the_session_stays(session):
    session.conf.set(SETTING, "400000")
    assert max(n for n, _ in sizes(session, common.map_batches)) < 600_000
    assert session.conf.get(SETTING) == "400000"
