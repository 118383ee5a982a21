"""The registered queries against their SQL, and the pipeline against plain Python."""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quern.llm import bpe, cnn, pii, queries
from tests.llm import cases
from tests.test_catalogue import TABLES, same

pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, name, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # 8: the network comes from the operator; each document is scored by itself.
    net = cnn.fit_from_labels(docs, spark.read.parquet(f"{TABLES}/labels.parquet"))
    score = lambda t: cnn.sigmoid(cnn.logits(net, net.pairs(), np.array([0, len(t)]), np.frombuffer(t, np.uint8)))[0]
    rows = [(i, t) for i, t in rows if score((t or "").encode()) >= 0.3]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, str(TABLES))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows}
    # 10: the smallest doc_id of each component.
    parts = cases.components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if parts[i][1] == i]
    # 6
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    first = {w for _, t in items for w in [" ".join((t or "").split()[:3])]}
    suspects = [(i, t) for i, t in rows if any(f in t for f in first)]
    dirty = {i for i, _ in cases.leaks(suspects, items)}
    rows = [(i, t) for i, t in rows if i not in dirty]
    # 1 and 5
    names = pii.Pseudonyms(pii.DEMO_KEY)
    ranks = bpe.load_ranks(Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes())
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for i, t in rows:
        new = names.replace(t)[0]
        ids = np.array(known.encode_ordinary(new), "<u4").tobytes()
        expected[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(new.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(TABLES)).collect()}
    assert got == expected


def test_stages_take_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns of names used inside, and empty tables, stage by stage."""
    rows = [*cases.odd_rows(), (8, dict(cases.odd_rows())[8]), (None, "no key, but a card 4111111111111111"), (None, None), (300, "mail ann@example.com\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = cases.clashing(docs.repartition(3)).cache()
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, empty = stage(spark, docs, str(TABLES)), stage(spark, docs.limit(0), str(TABLES))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and empty.columns == docs.columns and empty.count() == 0, name
        assert {r.token for r in out.select("token").distinct().collect()} == {"own"}, name
    # One row of each group and of each key stays; rows without a key, and texts without words, are in no group.
    keyed = [r for r in dict.fromkeys(rows) if r[0] is not None]
    parts = cases.components(keyed, 5, 80)
    assert texts(stages["n-gram Jaccard join"](spark, docs, str(TABLES))) == sorted([r for r in keyed if parts[r[0]][1] == r[0]] + [r for r in rows if r[0] is None], key=repr)
    assert texts(stages["benchmark decontamination"](spark, docs, str(TABLES))) == sorted(rows, key=repr)
    names = pii.Pseudonyms(pii.DEMO_KEY)
    hidden = stages["personal data"](spark, docs, str(TABLES))
    assert texts(hidden) == sorted(((i, None if t is None else names.replace(t)[0]) for i, t in rows), key=repr)
    assert {r.n_chars for r in hidden.where("text is null").collect()} == {None}
    coded = stages["byte-level BPE"](spark, docs, str(TABLES))
    assert sorted(r.decoded_sha256 for r in coded.collect()) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
