"""What workers keep after a task."""

import pyarrow as pa

from rowloom.llm import bpe, common
from rowloom.llm.queries import tokenizer_path
from tests.llm import corpora


def test_workers_forget_words_when_a_task_ends(spark):
    """Workers serve later stages too, whose memory the remembered words would add to."""
    path, docs = tokenizer_path(), corpora.frame(spark, corpora.rows())
    assert bpe.round_trip(docs, "doc_id", "text", path).count() == docs.count()
    assert bpe.encoded(docs, "doc_id", "text", path).count() == docs.count()

    def remembered(batches):
        for _ in batches:
            pass
        held = 0
        if bpe.codec.cache_info().currsize:
            held = len(bpe.codec(path).words) + len(bpe.codec(path).parts)
        yield pa.RecordBatch.from_arrays([pa.array([held])], ["held"])

    assert {r["held"] for r in spark.range(64).repartition(16).mapInArrow(remembered, "held long").collect()} == {0}


def test_a_failed_task_forgets_too():
    path = tokenizer_path()
    try:
        with bpe.task_codec(path) as both:
            assert both.decode(both.encode("some words of a text")) == "some words of a text" and both.words
            raise KeyError
    except KeyError:
        pass
    assert not bpe.codec(path).words and not bpe.codec(path).parts


def test_texts_of_a_batch_come_in_order_and_whole():
    texts = [None, "", "a", "漢字 🙂", None, *map(str, range(1000))]
    column = pa.array(["before", *texts]).slice(1)
    for rows in (1, 3, 256, 5000):
        assert list(common.each_text(column, rows)) == texts
    assert list(common.each_text(column.slice(0, 0))) == []
