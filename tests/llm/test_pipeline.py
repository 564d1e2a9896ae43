"""The pipeline: what each stage keeps, against brute force."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from atlaskb.llm.common import stored

from .test_dedup import brute_components, brute_spans, table
from .test_tokens import check_packing


def corpus():
    import random

    rnd = random.Random(4)
    english = "the of and to in that is was for with as on be at by this had not are but from or have an they which one you were".split()
    text = lambda n: " ".join(rnd.choice(english) + rnd.choice(["", "s", "ing", "er"]) for _ in range(n))
    passage = text(90)
    docs = [text(rnd.randint(20, 120)) for _ in range(40)]
    docs += [docs[0], docs[0] + "  ", docs[1].replace(" ", "\n"), docs[2] + " more", docs[3] + " at the end"]
    docs += [f"{text(40)} {passage} {text(40)}" for _ in range(4)] + ["123 456 !!!", "中文文本在这里", None, ""]
    return list(enumerate(docs))


def test_stages(spark):
    texts = corpus()
    docs = table(spark, texts).withColumn("lang", F.when(F.col("text").rlike("[a-z]"), F.col("lang")))
    columns, kept = docs.columns, [docs]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stored(stage(spark, kept[-1], ""), f"test-{name}")
        assert found.columns == columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
        kept.append(found)
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept]

    assert rows[1] == {i: t for i, t in texts if t and re.search("[a-z]", t)}
    norm = {}
    for i, t in rows[1].items():
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    assert rows[2].keys() == {min(g)[1] for g in norm.values()}
    groups = brute_components(list(rows[2].items()), 5, 80)
    assert rows[3].keys() == {i for i, (_, c) in groups.items() if i == c} and len(rows[3]) < len(rows[2])
    order = sorted(rows[3].items())
    want = {}
    for (i, t), flags in zip(order, brute_spans(order, corpus_pipeline.PASSAGE, "first"), strict=True):
        want[i] = bytes(c for c, f in zip(t.encode(), flags, strict=True) if not f).decode()
    assert rows[4] == {i: t for i, t in want.items() if t.strip()} and sum(map(len, rows[4].values())) < sum(map(len, rows[3].values()))
    assert all(r.n_chars == len(r.text) for r in kept[4].collect())
    check_packing(rows[4], corpus_pipeline.STAGES[-1][1](spark, kept[-1], "").collect())


def test_stages_take_empty_tables(spark):
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, ""), f"test-empty-{name}")
        assert out.count() == 0
        docs = out if name != corpus_pipeline.STAGES[-1][0] else docs


def test_run(spark):
    from ..oracle import DATA

    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
