"""The corpus pipeline, stage by stage."""

import random

import __spark_entry__ as contract
import corpus_pipeline
from loadspan.llm import boosted, jaccard, packing, quality_rules
from loadspan.llm.common import stage
from loadspan.llm.queries import fold


def test_registered():
    names = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_stages(spark, sf_dir, given, pieces):
    docs = given("documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names, steps = zip(*corpus_pipeline.STAGES)
    assert len(names) == 4

    first = stage(steps[0](spark, docs, sf_dir), "first")
    assert first.columns == docs.columns
    verdicts = {r.doc_id for r in quality_rules.measure(docs, pieces).where("kept").collect()}
    assert {r.doc_id for r in first.collect()} == verdicts

    second = stage(steps[1](spark, first, sf_dir), "second")
    assert second.columns == docs.columns
    scores = boosted.classify(first, given("labels"), fold(5) != 0).collect()
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in scores if r.score >= boosted.THRESHOLD}
    good = {r.doc_id for r in given("labels").where("quality = 1").collect()}
    assert len(good & verdicts - {r.doc_id for r in second.collect()}) <= 0.02 * len(good & verdicts)

    third = stage(steps[2](spark, second, sf_dir), "third")
    assert third.columns == docs.columns
    heads = {r.component_id for r in jaccard.join(second, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT).collect()}
    assert {r.doc_id for r in third.collect()} == heads
    assert all(r.text == texts[r.doc_id] for r in third.collect())

    rows = steps[3](spark, third, sf_dir).collect()
    assert {r.doc_id for r in rows} == heads
    assert all(r.offset + r.length <= packing.CAPACITY for r in rows)


def test_run_gives_the_rows_of_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_duplicates_link_at_five_words_and_four_fifths(spark, docs):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for added in (16, 20, 21, 22, 23, 24, 27, 40):
        body = [word() for _ in range(100)]
        texts += [" ".join(body), " ".join(body + [word() for _ in range(added)])]
    for edits in (1, 2, 3, 4):
        body = [word() for _ in range(200)]
        copy = list(body)
        for k in range(edits):
            copy[20 + 50 * k] = word()
        texts += [" ".join(body), " ".join(copy)]
    sets = [five_words(t) for t in texts]
    similar = lambda a, b: len(a & b) / len(a | b)
    assert sum(0.8 <= similar(sets[i], sets[i + 1]) < 0.85 for i in range(0, len(sets), 2)) >= 5
    # the texts of different pairs share nothing, so a component is a pair
    want = {i for i in range(len(sets)) if not any(similar(sets[i], sets[k]) >= 0.8 for k in range(i))}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(texts), "").collect()} == want
