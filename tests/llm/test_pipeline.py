import os
import re

import pytest

from evidex.llm import _spark as S
from evidex.llm import bpe, lines, quality, tiling

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = S.read(spark, DATA, "documents")
    labels, items = S.read(spark, DATA, "labels"), S.read(spark, DATA, "benchmark")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, labels)
    rows = {d: t for d, t in rows.items() if model.score([t])[0] >= 0.3}
    from test_lines import brute

    rows = {d: t for d, t, _, _ in brute(list(rows.items()))}
    from test_similar import exact_groups

    ids = sorted(rows)
    rows = {d: rows[d] for d, g in zip(ids, exact_groups([rows[d] for d in ids])[0], strict=True) if ids[g] == d}
    block = tiling.Items(*map(list, zip(*((r.item_id, r.text) for r in items.collect()), strict=True)))
    rows = {d: t for d, t in rows.items() if not block.found([t])}
    v = bpe.vocabulary(bpe.default_vocabulary())
    out = corpus_pipeline.run(spark, DATA)
    got = {r.doc_id: r.n_tokens for r in out.collect()}
    folder = out.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file:")
    assert os.listdir(re.sub("^/+", "/", folder)) == ["4-bpe"]
    assert got == {d: len(v.encode([t])[0]) // 4 for d, t in rows.items()}
    assert 0 < len(got) < docs.count()


def test_stages_keep_columns_and_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name != "bpe":
                assert out.schema.simpleString() == docs.schema.simpleString(), name
                assert out.count() <= docs.count()
    assert {r.doc_id for r in corpus_pipeline.dedup_lines(spark, odd_docs, DATA).collect()} == {r.doc_id for r in odd_docs.collect()}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
    assert len(corpus_pipeline.STAGES) == 5
    assert lines.SQL in entry.oracle_sql().values()
