"""The pipeline's stages, each against a direct version on what its predecessor kept."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from test_plain_operators import direct_targets, lowered, words
from test_simhash import direct_components, direct_fingerprint

from tessella.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
    results, now = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, SF).toArrow()) if stage is not corpus_pipeline.STAGES[-1][1] else stage(spark, now, SF)
        results.append(now)
    rows = [r.collect() for r in results]
    for r in results[1:-1]:
        assert r.columns == docs.columns
    toxic = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    assert sorted(r["doc_id"] for r in rows[1]) == sorted(r["doc_id"] for r in rows[0] if r["doc_id"] not in toxic)
    best = {}
    for r in rows[1]:
        best[lowered(r["text"])] = max(r["doc_id"], best.get(lowered(r["text"]), -1))
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(best.values())
    prints = [(r["doc_id"], direct_fingerprint(r["text"])) for r in rows[2]]
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(set(direct_components(prints)))
    sizes, taken = Counter(), Counter()
    for r in rows[3]:
        sizes[r["source"]] += words(r["text"])
    for r in rows[4]:
        taken[r["source"]] += words(r["text"])
    most = max(words(r["text"]) for r in rows[3])
    assert max(Counter(r["doc_id"] for r in rows[4]).values()) <= 3
    for source, target in direct_targets(sizes).items():
        assert abs(taken[source] - target) <= most
    assert {r["doc_id"]: r["text"] for r in rows[4]}.items() <= {r["doc_id"]: r["text"] for r in rows[3]}.items()
    per_doc, bins = Counter(), defaultdict(list)
    for r in rows[5]:
        per_doc[r["doc_id"]] += r["length"]
        if r["length"]:
            bins[r["bin_id"]].append((r["offset"], r["length"], r["bin_capacity"]))
    want = Counter()
    for r in rows[4]:
        want[r["doc_id"]] += words(r["text"])
    assert per_doc == want
    for own in bins.values():
        at = 0
        for offset, length, size in sorted(own):
            assert offset == at and at + length <= size
            at += length
    assert Counter(corpus_pipeline.run(spark, SF).select("doc_id", "length").collect()) == Counter(results[5].select("doc_id", "length").collect())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_awkward_and_empty_rows(spark, awkward, no_docs, stage):
    assert stage(spark, awkward, SF).count() > 0
    assert stage(spark, no_docs, SF).count() == 0
