"""The registered queries themselves, over whole tables, beside their SQL."""

import hashlib

import pytest
from compare import assert_same

from evidex.llm import chat, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_over_its_whole_table(spark, name):
    if name in queries.oracle_sql():
        assert_same(spark, queries.queries()[name], queries.oracle_sql()[name], DATA)
        return
    got = queries.queries()[name](spark, DATA)
    if name != "op9_tiling":
        documents = spark.read.parquet(f"{DATA}/documents.parquet")
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    else:
        assert got.count() > 0


def test_the_added_conversation_is_read_back_from_its_format(spark):
    row = queries.queries()["op1_chat"](spark, DATA).where("conv_id = -7").first()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert row.n_turns == 2 and row.loss_chars == len(chat.TRAP) and row.loss_sha256 == digest(chat.TRAP)
    assert row.turns_sha256 == digest("".join(f"{r}\n{chat.TRAP}\n" for r in ("user", "assistant")))
