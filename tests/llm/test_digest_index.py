"""The digest index: every batch goes through the merge anti-join, and a batch that was broken off can be run again."""

import uuid

from lectern.llm.exact_dedup import DigestIndex, resolve

SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def states(df):
    return sorted((r.id, r.keep_id, r.group_size, r.kept) for r in df.collect())


def test_batches(spark):
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", buckets=4)
    first = frame(spark, [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "x")])
    assert states(resolve(first, index, batch="one")) == [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True)]
    second = frame(spark, [(6, "A B"), (7, "new"), (8, "NEW"), (9, "x")])
    want = [(6, None, None, False), (7, 8, 2, False), (8, 8, 2, True), (9, None, None, False)]
    assert states(resolve(second, index, batch="two")) == want
    assert states(resolve(second, index, batch="two")) == want  # run again after it was broken off
    assert index.read().count() == 4
    assert index.compact(f"{index.name}_c").read().count() == 4
    index.drop()
    assert not index.exists()


def test_anti_join_is_in_the_plan(spark):
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", buckets=4)
    groups = spark.range(100).selectExpr("sha2(string(id), 256) AS digest", "id AS keep_id", "1L AS group_size")
    index.create(groups, 100)
    plan = index.unseen(groups)._jdf.queryExecution().sparkPlan().toString() + index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert plan.split("SortMergeJoin")[-1].count("Exchange hashpartitioning") == 1  # the new digests only, not the index
    assert index.unseen(groups).count() == 100
    index.add(groups)
    assert index.unseen(groups).count() == 0
    index.drop()
