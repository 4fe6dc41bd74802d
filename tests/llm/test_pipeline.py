import re

import corpus_pipeline as pipeline
from rowloom.llm.common import Scratch
from tests.llm import corpora


def test_stages_do_what_they_say(spark, folder):
    """Each stage on what the one before kept, against brute force where one row decides."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scratch, kept = Scratch(spark), [docs]
    for name, stage in pipeline.STAGES[:-1]:
        kept.append(scratch.keep(stage(spark, kept[-1], folder), name))
        assert kept[-1].columns == docs.columns
    first, good, whole, apart, mix = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept]
    clean = [k for k, q in labels.items() if q == 1]
    junk = [k for k, q in labels.items() if q == 0]
    assert sum(k in good for k in clean) >= 0.97 * len(clean) and sum(k in good for k in junk) <= 0.1 * len(junk) + 1
    best = {}
    for k, t in good.items():
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[norm] = min(best.get(norm, (1, 0)), (-len(t), k))
    assert set(whole) == {k for _, k in best.values()}
    assert set(apart) == {k for k, (_, c) in corpora.near_groups(whole).items() if k == c}
    assert set(mix) <= set(apart) and kept[-1].count() >= len(mix)
    last = pipeline.STAGES[-1][1](spark, kept[-1], folder)
    assert last.count() == kept[-1].count()
