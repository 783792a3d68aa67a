from datetime import datetime as dt

from lamina.operators import references as op

REFS = "table_name string, ref_field string, row_id long, kind string, key string, at timestamp, live_from int, status string"
PARENTS = "kind string, key string, valid_from timestamp, deleted_at timestamp, timed boolean"
T1, T2, T3 = dt(2024, 1, 1), dt(2024, 2, 1), dt(2024, 3, 1)


def test_statuses_nulls_hot_keys_and_clashing_names(spark):
    refs = [("t", "f", 1, "doc", "a", T2), ("t", "f", 2, "doc", "b", T2), ("t", "f", 3, "doc", "c", T2), ("t", "f", 4, "doc", "zz", T2), ("t", "f", 5, "doc", None, T2), ("t", "f", 6, "doc", "", T2), ("t", "f", 7, "name", "x", None), ("t", "f", 8, "doc", "a", None), ("t", "f", 4, "doc", "zz", T2)]
    refs += [("t", "f", 100 + i, "doc", "a", T3) for i in range(50)]
    parents = [("doc", "a", T3, None, True), ("doc", "a", T1, None, True), ("doc", "b", T3, None, True), ("doc", "c", T1, T3, True), ("name", "x", None, None, False), ("doc", None, T1, None, True)]
    r = spark.createDataFrame([(*x, 9, "old") for x in refs], REFS)
    got = {x.row_id: x.status for x in op.resolve_references(r, spark.createDataFrame(parents, PARENTS)).collect()}
    assert {k: v for k, v in got.items() if k < 10} == {1: "found", 2: "late", 3: "deleted", 4: "missing", 7: "found", 8: "late"}
    assert all(got[100 + i] == "found" for i in range(50))
    split = {x.row_id: x.status for x in op.resolve_references(r, spark.createDataFrame(parents, PARENTS), 7).collect()}
    assert split == got  # a key over eight tasks gives what it gives in one
    found = op.orphans(r, spark.createDataFrame(parents, PARENTS)).collect()
    assert sorted(x.row_id for x in found) == [2, 3, 4, 8]
    report = {(x.month, x.status): x.n for x in op.orphan_report(r, spark.createDataFrame(parents, PARENTS)).collect()}
    assert report[("2024-02", "missing")] == 1 and report[("2024-03", "found")] == 50 and report[(None, "late")] == 1


def test_empty_tables(spark):
    assert op.orphans(spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)).count() == 0
