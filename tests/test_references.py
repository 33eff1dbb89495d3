from datetime import datetime as dt

from noteflow.operators.references import latest, orphan_references, orphan_report

REFS = "ref_table string, ref_field string, row_key string, space string, scope string, ref_key string, ref_time timestamp_ntz, key_state string"
PARENTS = "space string, scope string, ref_key string, deleted_at timestamp_ntz, ingested_at timestamp_ntz, extra int"
T = [dt(2024, m, 1) for m in range(1, 7)]


def ref(key, time=T[2], row="r", scope="", table="t"):
    return (table, "f", row, "note", scope, key, time, "clash")


def test_states(spark):
    parents = spark.createDataFrame(
        [("note", "", "ok", None, T[0], 1), ("note", "", "gone", None, T[0], 1), ("note", "", "gone", T[5], T[1], 1), ("note", "", "late", None, T[4], 1),
         ("note", "", "", None, T[0], 1), ("note", "a", "1", None, T[0], 1), ("note", "", None, None, T[0], 1)], PARENTS)
    refs = spark.createDataFrame(
        [ref("ok"), ref("gone"), ref("late"), ref("late", T[5], "r2"), ref("never"), ref("never"), ref(None), ref(""), ref("1", scope="a"), ref("1", scope="b"),
         ref("late", None, "r3"), ref("Ok", None, "r4")], REFS)
    got = {tuple(r) for r in orphan_references(refs, parents).collect()}
    assert got == {
        ("t", "f", "r", "gone", "deleted", "2024-03"), ("t", "f", "r", "late", "late", "2024-03"), ("t", "f", "r", "never", "missing", "2024-03"),
        ("t", "f", "r", "1", "missing", "2024-03"), ("t", "f", "r4", "Ok", "missing", None),
    }


def test_report_counts_references_and_keys(spark):
    refs = spark.createDataFrame([ref("x", row="1"), ref("x", row="2"), ref("y", row="3")], REFS)
    out = orphan_report(orphan_references(refs, spark.createDataFrame([], PARENTS))).collect()
    assert [(r.ref_state, r.n_refs, r.n_keys) for r in out] == [("missing", 3, 2)]


def test_empty_tables(spark):
    assert orphan_references(spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)).count() == 0


def test_hot_key_is_whole(spark):
    n = 60_000
    refs = spark.range(n).selectExpr("'t' ref_table", "'f' ref_field", "cast(id as string) row_key", "'note' space", "'' scope", "if(id % 3 = 0, 'hot', cast(id as string)) ref_key", "timestamp_ntz'2024-01-01' ref_time")
    assert orphan_references(refs, spark.createDataFrame([], PARENTS)).count() == n


def test_latest_takes_the_last_delivery(spark):
    df = spark.createDataFrame([("a", 1, T[0]), ("a", 2, T[1]), ("b", 3, None), (None, 4, T[0])], "k string, v int, ingested_at timestamp_ntz")
    assert {(r.k, r.v) for r in latest(df, ["k"]).collect()} == {("a", 2), ("b", 3), (None, 4)}
