import numpy as np
import pytest

from pageloom.llm import topics
from pageloom.session import table


@pytest.fixture(scope="module")
def fitted(spark):
    d = "/root/testdata/sf0.01"
    return topics.fit(table(spark, d, "documents"), table(spark, d, "subject_item"))


def test_topics_map_to_all_subjects(fitted):
    model, _ = fitted
    assert {s for s in model.subject_of if s} == set(model.subjects) and None in model.subject_of


def test_held_out_examples(spark):
    """Examples that the model was not fitted on (every fourth): the most frequent subject is the label."""
    d = "/root/testdata/sf0.01"
    every = table(spark, d, "subject_item")
    model, _ = topics.fit(table(spark, d, "documents"), every.filter("item_id % 4 <> 0"))
    items = every.filter("item_id % 4 = 0")
    send = spark.sparkContext.broadcast
    numbers = topics.numbered(items, "item_id", "text", send(model.numbers), send(model.stop))
    got = topics.assign(model, numbers).toPandas().sort_values("about").groupby("doc_id").subject.last().to_dict()
    want = {r.item_id: r.subject for r in items.collect()}
    right = sum(got.get(i) == s for i, s in want.items())
    assert right / len(want) > 0.8


def test_inference_prefers_the_topic():
    t = np.array([[0.8, 0.1, 0.1], [0.1, 0.1, 0.8]], np.float32)
    r, theta = topics.infer(t, np.array([0, 0, 1, 2, 2]), np.array([0, 0, 0, 1, 1]), 3)
    assert theta[0, 0] > 2 and theta[1, 1] > 1.5 and r.shape == (5, 2) and np.allclose(theta[2], topics.ALPHA)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "No sentence"), (4, "word " * 50_000 + "end.")], "doc_id bigint, text string")
    items = spark.createDataFrame([("law", "en", "The judge spoke to the court today."), ("law", None, None), (None, "en", "Some text stands here.")], "subject string, lang string, text string")
    assert topics.subjects_of(docs, items).count() >= 0
    assert topics.subjects_of(docs.limit(0), items).count() == 0
    assert topics.subjects_of(docs, items.limit(0)).count() == 0
