"""Audit rules on a match of a few rows."""

from boutline.operators import audit as A


def test_slack_and_unknown_slots(spark):
    m = spark.createDataFrame([(1, 60, 100)], "match_id long, fps int, duration_frames long")
    p = spark.createDataFrame([(1, 0), (1, 1)], "match_id long, slot int")
    i = spark.createDataFrame([(1, 0, 220, 1, "a"), (1, 0, 221, 2, "a"), (1, None, 5, 3, "a"), (1, 4, 5, 4, "a")], "match_id long, slot int, frame long, seq long, action string")
    k = spark.createDataFrame([(1, None, 210, 9), (1, 1, 400, 8)], "match_id long, slot int, frame long, seq long")
    mo = spark.createDataFrame([], "match_id long, severity int, frame long")
    me = spark.createDataFrame([], "match_id long, key string, value double")
    acts = spark.createDataFrame([("a", 1)], "action string, busy int")
    got = {r["check"]: (r.n, r.failed, r.example) for r in A.audit(m, p, i, k, mo, me, acts).collect()}
    assert got["inputs within duration"] == (4, 1, "2") and got["inputs map to a slot"] == (4, 1, "4")
    assert got["kos within duration"] == (2, 1, "8") and got["kos map to a slot"] == (2, 0, None)


def test_checks_across_facts(spark):
    m = spark.createDataFrame([(i, 60, 3600) for i in (1, 2, 3)], "match_id long, fps int, duration_frames long")
    p = spark.createDataFrame([(1, 0, 5), (1, 1, 99), (2, 0, None), (2, 1, 5), (3, 0, 5)], "match_id long, slot int, character_id int")
    i = spark.createDataFrame([(1, 0, 5, 1), (1, 0, 4, 2), (2, 0, 5, 3), (2, 1, 4, 4), (3, None, 2, 5), (3, None, 2, 6)], "match_id long, slot int, frame long, seq long")
    k = spark.createDataFrame([(1, 0, 9, 1), (1, 1, 8, 2), (1, 0, 10, 3), (2, 1, 4, 4), (2, 0, 9, 5)], "match_id long, slot int, frame long, seq long")
    mo = spark.createDataFrame([(1, "m_1", 3), (1, "m_1", 3), (2, "m_2", 3720), (2, "m_3", 3721)], "match_id long, id string, frame long")
    me = spark.createDataFrame([(1, "minutes", 1.4), (2, "minutes", 1.6)], "match_id long, key string, value double")
    res = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 7, 1)], "match_id long, slot int, place int")
    prov = spark.createDataFrame([(1, "high"), (2, "missing"), (3, None)], "match_id long, kos string")
    chars = spark.createDataFrame([(5,)], "character_id int")
    err = spark.createDataFrame([(1, []), (2, ["x"])], "match_id long, errors array<string>")
    got = {r["check"]: (r.n, r.failed, r.example) for r in A.audit_more(m, p, i, k, mo, me, res, prov, chars, err).collect()}
    assert got == {"hero id in table": (4, 1, "1"), "inputs ordered per slot": (3, 1, "1"), "result keys are slots": (2, 1, "2"), "result ranks distinct": (2, 1, "2"),
                   "winner is not the most KO'd": (2, 1, "1"), "moment ids unique": (2, 1, "1"), "moments within duration": (2, 1, "2"), "metric minutes as duration": (2, 1, "2"),
                   "kos confidence honest": (3, 1, "2"), "schema valid": (2, 1, "2")}
