import random

import pytest
from pyspark.sql import functions as F

from graphmill.operators import retrieval as R
from graphmill.operators.fulltext import FullText

SCHEMA = "id long, name string, body string, path string"
QUERIES = ["alpha", "Beta  alpha beta", "gämma", "missing"]


def random_docs(rng, ids):
    words = ["alpha", "Beta", "gamma", "Gämma", "delta_1", "x-y"]
    return [(i, rng.choice([None, "", "alpha beta", "delta"]), None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), "p") for i in ids]


def same_scores(spark, index, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for q in QUERIES:
        got = [(r.id, round(r.score, 9)) for r in index.search(q, None).collect()]
        want = [(r.id, round(r.score, 9)) for r in R.bm25(docs, q, ["name", "body"], limit=None).collect()]
        assert sorted(got) == sorted(want), q
    assert [r.id for r in index.search("alpha", 5).collect()] == [r.id for r in R.bm25(docs, "alpha", ["name", "body"], limit=5).collect()]


@pytest.fixture()
def full(spark, tmp_path):
    return FullText(spark, f"file://{tmp_path}/search", ["name", "body"], buckets=4, slices=2)


def test_refreshed_and_merged_indexes_score_like_a_scan(spark, full):
    rng = random.Random(5)
    rows = {r[0]: r for r in random_docs(rng, range(60))}
    full.build(spark.createDataFrame(list(rows.values()), SCHEMA))
    same_scores(spark, full, list(rows.values()))
    for _ in range(2):
        changed = random_docs(rng, rng.sample(range(150), 20))
        gone = [i for i in rng.sample(range(150), 10) if i not in {r[0] for r in changed}]
        full.refresh(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([(i,) for i in gone], "id long"))
        rows |= {r[0]: r for r in changed}
        for i in gone:
            rows.pop(i, None)
    same_scores(spark, full, list(rows.values()))
    full.merge(2)
    assert len(full.state()["parts"]) == 2
    same_scores(spark, full, list(rows.values()))
    full.merge()
    assert len(full.state()["parts"]) == 1 and full.state()["dead"] == 0
    same_scores(spark, full, list(rows.values()))
    assert full.table("documents", full.state()["parts"]).count() == len(rows) == full.state()["documents"]
    full.clean_up()
    assert full.search("!!").collect() == [] and full.search("alpha").count() == 20


def test_a_query_reads_its_terms_buckets_only(spark, full):
    full.build(spark.createDataFrame(random_docs(random.Random(2), range(50)), SCHEMA))
    plan = full.search("alpha beta")._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "PartitionFilters" in line]
    assert scans and all("bucket" in s.split("PartitionFilters:")[1].split("]")[0] and "part" in s.split("PartitionFilters:")[1] and "EqualTo(term," in s for s in scans)
    assert not any("documents/" in s for s in scans)


def test_crashes_and_edges(spark, full, monkeypatch):
    with_null = [(None, "alpha", "alpha", "p"), (1, "alpha", None, "p"), (2, None, None, "p"), (3, "beta " * 20000, "alpha", "p")]
    full.build(spark.createDataFrame(with_null, SCHEMA))
    assert full.state()["documents"] == 3 and [r.id for r in full.search("alpha").collect()] == [1, 3]
    assert [r.id for r in full.search("alpha", None, spark.createDataFrame([(3,), (3,)], "id long")).collect()] == [3]
    before = full.search("alpha", None).collect()
    monkeypatch.setattr(full, "_save", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        full.refresh(spark.createDataFrame([(1, "beta", "x", "p")], SCHEMA))
    monkeypatch.undo()
    assert full.search("alpha", None).collect() == before
    full.refresh(spark.createDataFrame([(1, "beta", "x", "p")], SCHEMA))
    assert [r.id for r in full.search("alpha", None).collect()] == [3]
    full.refresh(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(3,)], "id long"))
    assert full.search("alpha", None).collect() == [] and full.state()["documents"] == 2
    with pytest.raises(ValueError):
        FullText(spark, full.path, ["body"]).state()
    bare = FullText(spark, full.path + "2", ["name", "body"])
    assert bare.search("alpha").collect() == []
    bare.build(spark.createDataFrame([], SCHEMA))
    assert bare.search("alpha").collect() == []


def test_search_through_the_index(spark, full):
    docs = spark.createDataFrame([(1, "read file", "f", "p"), (2, "write file", "f", "p")], SCHEMA)
    full.build(docs)
    found, used = R.search(docs.where("id = 2").select("id"), None, "file", None, index=full)
    assert used == "structural" and [r.id for r in found.collect()] == [2]


def test_a_document_s_words_are_one_row_a_term_before_the_shuffle(spark, full, monkeypatch):
    shuffled = []
    put = full._put_postings
    monkeypatch.setattr(full, "_put_postings", lambda rows, part: (shuffled.append(rows.count()), put(rows, part)))
    full.build(spark.createDataFrame([(i, "alpha beta", "beta " * 500 + "alpha", "p") for i in range(20)] + [(20, "", None, "p")], SCHEMA))
    assert shuffled == [20 * 2 + 21]  # a row a term and a row a document, not one for each of 503 words
    rows = full.table("postings", [1]).where("key = 7").orderBy("term").collect()
    assert [(r.term, len(r.positions), r.len) for r in rows] == [("alpha", 2, 503), ("beta", 501, 503)]
    assert rows[0].positions == [0, 503] and full.table("documents", [1]).where("key = 20").first()["len"] == 0


def test_parts_are_written_without_a_shuffle_and_merges_gather_many_files(spark, full, monkeypatch):
    from graphmill.operators import fulltext as T

    plans, put = [], full._put
    monkeypatch.setattr(full, "_put", lambda df, table, part: (table == "postings" and plans.append(df._jdf.queryExecution().executedPlan().toString()), put(df, table, part)))
    rng, key = random.Random(7), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    rows = {r[0]: r for r in random_docs(rng, range(40))}
    full.build(spark.createDataFrame(list(rows.values()), SCHEMA))
    for ids in (range(5, 15), range(12, 60)):
        changed = random_docs(rng, ids)
        full.refresh(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([(3,), (999,), (3,)], "id long"))
        rows = {k: r for k, r in rows.items() if k != 3} | {r[0]: r for r in changed}
    assert sorted(r.key for r in full.table("dead", [2]).collect()) == [3, *range(5, 15)]  # only what counted before
    full.merge(2)
    assert spark.conf.get(key) == before
    assert len(plans) == 4 and not any("Exchange hashpartitioning(bucket" in p or "Exchange hashpartitioning(key#" in p.split("BroadcastHashJoin")[0] or "RebalancePartitions" in p or "SortMergeJoin" in p for p in plans)
    same_scores(spark, full, list(rows.values()))
    monkeypatch.setattr(T, "MOST_FILES", 0)
    monkeypatch.setattr(T, "BROADCAST_DEAD", 0)
    full.merge()
    assert "REBALANCE" in plans[-1].upper() and full.state()["documents"] == len(rows)
    same_scores(spark, full, list(rows.values()))
