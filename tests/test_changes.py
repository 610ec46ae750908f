import random

import pytest
from pyspark.sql import functions as F

from proselab.operators import changes as CH

USERS_SCHEMA = "id long, username string, email string, language_preference string, role string"
REG_SCHEMA = "ord long, username string, email string, role string, language_preference string"


def _sequential(batch, existing):
    """The reference's loop: one request at a time."""
    emails = {u[2] for u in existing}
    names = {u[1] for u in existing}
    out = []
    for ord_, user, email, _role, _lang in sorted(batch):
        if not CH_EMAIL(email):
            continue
        if email in emails or user in names:
            continue
        emails.add(email)
        names.add(user)
        out.append(ord_)
    return out


def CH_EMAIL(e):
    import re

    return e is not None and re.match(CH.EMAIL_PATTERN, e) is not None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_register_rounds_equal_sequential(spark, seed):
    rnd = random.Random(seed)
    existing = [(i, f"user{i}", f"user{i}@x.org", "English", "user") for i in range(5)]
    batch = [
        (100 + k, f"user{rnd.randint(0, 12)}", f"user{rnd.randint(0, 12)}@x.org" if rnd.random() > 0.1 else "broken", "admin", None)
        for k in range(60)
    ]
    got = CH.register_batch(spark.createDataFrame(batch, REG_SCHEMA), spark.createDataFrame(existing, USERS_SCHEMA))
    rows = got.collect()
    assert sorted(r["ord"] for r in rows) == _sequential(batch, existing)
    assert {r["role"] for r in rows} <= {"user"}
    assert {r["language_preference"] for r in rows} <= {"English"}


def test_register_conflict_chain(spark):
    # rejected rows must not block later ones
    batch = [(1, "a", "a@x.org", "u", "Hindi"), (2, "b", "a@x.org", "u", "Hindi"), (3, "b", "c@x.org", "u", "Hindi"), (4, "c", "c@x.org", "u", "Hindi")]
    got = CH.register_batch(spark.createDataFrame(batch, REG_SCHEMA), spark.createDataFrame([], USERS_SCHEMA))
    assert sorted(r["ord"] for r in got.collect()) == [1, 3]


def test_upsert_applies_null_and_inserts(spark):
    prof = spark.createDataFrame([(1, "30", "English"), (2, "40", "Hindi")], "user_id long, age_group string, language_preference string")
    ch = spark.createDataFrame([(10, 1, "31", "Hindi"), (11, 1, None, "English"), (12, 3, "50", "Hindi")], "seq long, user_id long, age_group string, language_preference string")
    out = {r["user_id"]: (r["age_group"], r["language_preference"]) for r in CH.upsert_profiles(prof, ch).collect()}
    assert out == {1: (None, "English"), 2: ("40", "Hindi"), 3: ("50", "Hindi")}


def test_update_by_key_and_affected(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content_text string")
    ch = spark.createDataFrame([(2, None), (9, "z")], "id long, content_text string")
    out = sorted((r["id"], r["content_text"], r["changed"]) for r in CH.update_by_key(t, ch, "id", ["content_text"], "changed").collect())
    assert out == [(1, "a", False), (2, None, True)]
    assert CH.affected_count(t, ch, "id").first()["affected"] == 1


def test_cascade_delete_idempotent(spark):
    users = spark.createDataFrame([(1, "a", "a@x", "English", "user"), (2, "b", "b@x", "English", "admin")], USERS_SCHEMA)
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, user_id long")
    prof = spark.createDataFrame([(1, None, "English"), (2, None, "English")], "user_id long, age_group string, language_preference string")
    tables = {"users": users, "profiles": prof, "user_texts": child, "user_feedback": child, "login_history": child}
    keys = users.filter(F.col("role") == "admin").select("id")
    once = CH.delete_users_cascade(tables, keys)
    twice = CH.delete_users_cascade(once, keys)
    for t in tables:
        assert sorted(map(tuple, once[t].collect())) == sorted(map(tuple, twice[t].collect()))
    assert sorted(r["id"] for r in once["login_history"].collect()) == [10, 12]


def test_dedup_append_keeps_earliest(spark):
    from datetime import datetime

    s = "id long, user_id long, content_text string, created_at timestamp_ntz"
    a = spark.createDataFrame([(1, 7, "x", datetime(2024, 1, 1)), (2, 7, "y", datetime(2024, 1, 2))], s)
    b = spark.createDataFrame([(3, 7, "x", datetime(2024, 1, 5)), (4, 8, "x", datetime(2024, 1, 5))], s)
    out = sorted(r["id"] for r in CH.dedup_append(a, b, ["user_id", "content_text"], ["created_at", "id"]).collect())
    assert out == [1, 2, 4]


def test_key_taken_and_reject(spark):
    users = spark.createDataFrame([(1, "ann", "ann@x.org", "English", "user")], USERS_SCHEMA)
    batch = spark.createDataFrame([(1, "ann", "new@x.org", "u", None), (2, "bob", "ann@x.org", "u", None), (3, "cy", "cy@x.org", "u", None)], REG_SCHEMA)
    taken = {r["ord"]: r["taken"] for r in CH.key_taken(batch, users).collect()}
    assert taken == {1: True, 2: True, 3: False}
    assert [r["ord"] for r in CH.reject_existing(batch, users).collect()] == [3]


def test_constraint_audit_counts(spark):
    from datetime import datetime

    users = spark.createDataFrame([(1, "a", "a@x", "English", "user")], USERS_SCHEMA)
    texts = spark.createDataFrame(
        [(1, 1, "i", "c", "summary", "m", datetime(2024, 1, 1)), (1, 2, None, "c", "x" * 21, None, None)],
        "id long, user_id long, input_text string, content_text string, content_type string, model_used string, created_at timestamp_ntz",
    )
    fb = spark.createDataFrame([(1, 1, "like", None, None), (2, 1, "meh", None, None)], "id long, user_id long, feedback_type string, comment string, created_at timestamp_ntz")
    logins = spark.createDataFrame([(1, None, None), (2, 5, None)], "id long, user_id long, login_time timestamp_ntz")
    got = {(r["table_name"], r["rule"]): r["violations"] for r in CH.constraint_audit(users, texts, fb, logins).collect()}
    assert got[("user_texts", "not_null_input_text")] == 1
    assert got[("user_texts", "len_content_type")] == 1
    assert got[("user_texts", "duplicate_pk")] == 1
    assert got[("user_texts", "fk_user_id")] == 1
    assert got[("user_feedback", "enum_feedback_type")] == 1
    assert got[("login_history", "fk_user_id")] == 1


@pytest.mark.parametrize("seed", [5, 6])
def test_delete_and_dedup_are_idempotent(spark, seed):
    from datetime import datetime, timedelta

    rnd = random.Random(seed)
    rows = [(i, rnd.randint(1, 4), rnd.choice("abc"), datetime(2024, 1, 1) + timedelta(minutes=rnd.randint(0, 50))) for i in range(40)]
    s = "id long, user_id long, content_text string, created_at timestamp_ntz"
    t = spark.createDataFrame(rows, s)
    keys = spark.createDataFrame([(k,) for k in rnd.sample(range(40), 10)], "id long")
    once = CH.delete_by_key(t, keys, "id")
    twice = CH.delete_by_key(once, keys, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    batch = spark.createDataFrame([(100 + i, u, c, ts + timedelta(hours=1)) for i, u, c, ts in rows[:15]], s)
    k = ["user_id", "content_text"]
    d1 = CH.dedup_append(t, batch, k, ["created_at", "id"])
    d2 = CH.dedup_append(d1, batch, k, ["created_at", "id"])
    assert sorted(map(tuple, d1.collect())) == sorted(map(tuple, d2.collect()))
    assert d1.count() == t.select(*k).distinct().count()


def test_last_valid_role_change_wins(spark):
    users = spark.createDataFrame([(1, "a", "a@x", "English", "user"), (2, "b", "b@x", "English", "admin")], USERS_SCHEMA)
    ch = spark.createDataFrame([(1, 5, "admin"), (1, 7, "owner"), (1, 6, "user"), (1, 4, "admin"), (2, 1, "owner")], "id long, seq long, role string")
    assert sorted((r["id"], r["role"]) for r in CH.set_role(users, ch).collect()) == [(1, "user"), (2, "admin")]


def test_registered_tables(spark):
    users = spark.createDataFrame([(41, "ann", "ann@x.org", "English", "user")], USERS_SCHEMA)
    prof = spark.createDataFrame([(41, "30", "English")], "user_id long, age_group string, language_preference string")
    batch = spark.createDataFrame([(9, "dee", "d@x.org", "u", None), (3, "bob", "b@x.org", "u", "Hindi"), (5, "bob", "c@x.org", "u", None)], REG_SCHEMA)
    u, p = CH.registered_tables(batch, users, prof)
    assert sorted((r["id"], r["username"], r["role"]) for r in u.collect()) == [(41, "ann", "user"), (42, "bob", "user"), (43, "dee", "user")]
    assert sorted(((r["user_id"], r["age_group"], r["language_preference"]) for r in p.collect())) == [(41, "30", "English"), (42, None, "Hindi"), (43, None, "English")]


def test_append_keeps_one_of_equal_copies(spark):
    from datetime import datetime

    s = "id long, user_id long, content_text string, created_at timestamp_ntz"
    a = spark.createDataFrame([(1, 7, "x", datetime(2024, 1, 1)), (1, 7, "x", datetime(2024, 1, 1)), (2, None, None, None)], s)
    b = spark.createDataFrame([(3, None, None, datetime(2024, 1, 5))], s)
    out = sorted(r["id"] for r in CH.dedup_append(a, b, ["user_id", "content_text"], ["created_at", "id"]).collect())
    assert out == [1, 2]


def _chain(n):
    """Row k shares its e-mail with the row before and its name with the one after."""
    return [(k, f"n{(k + 1) // 2}", f"e{k // 2}@x.org", "u", None) for k in range(1, n + 1)]


@pytest.mark.parametrize("n,at_once", [(10_000, 1_000_000), (3_000, 5_000), (700, 60)])
def test_long_conflict_chains_take_few_rounds(spark, monkeypatch, n, at_once):
    """A chain of n rows, in one step, as one component, and as a component
    that is larger than what a task decides at once."""
    batch = _chain(n) + [(n + 10 * k, f"m{k % 50}", f"f{k % 60}@x.org", "u", None) for k in range(1, 200)]
    random.Random(n).shuffle(batch)
    rounds = []
    real = CH._peel, CH._components
    monkeypatch.setattr(CH, "_peel", lambda rows: rounds.append("peel") or real[0](rows))
    monkeypatch.setattr(CH, "_components", lambda rows: rounds.append("parts") or real[1](rows))
    if at_once == 5_000:  # force the way by components
        at_once = n - 500
    got = CH.register_batch(spark.createDataFrame(batch, REG_SCHEMA), spark.createDataFrame([], USERS_SCHEMA), at_once=at_once)
    assert sorted(r["ord"] for r in got.collect()) == _sequential(batch, [])
    assert len(rounds) < 20


@pytest.mark.parametrize("seed", [5, 6])
def test_components_equal_sequential_under_any_bound(spark, seed):
    rnd = random.Random(seed)
    batch = [(3 * k, f"user{rnd.randint(0, 40)}", f"e{rnd.randint(0, 45)}@x.org", "u", None) for k in range(150)]
    frame = spark.createDataFrame(batch, REG_SCHEMA)
    for at_once in (1, 12):
        got = CH.register_batch(frame, spark.createDataFrame([], USERS_SCHEMA), at_once=at_once)
        assert sorted(r["ord"] for r in got.collect()) == _sequential(batch, [])


def test_a_row_without_a_name_is_rejected(spark):
    batch = [(1, None, "a@x.org", "u", None), (2, "b", "a@x.org", "u", None), (3, "c", None, "u", None)]
    got = CH.register_batch(spark.createDataFrame(batch, REG_SCHEMA), spark.createDataFrame([], USERS_SCHEMA))
    assert [r["ord"] for r in got.collect()] == [2]


def test_keys_clash_in_any_case_only_when_collated(spark):
    from proselab.operators import usage as U

    users = spark.createDataFrame([(1, "Ann", "A@x.org", "English", "user")], USERS_SCHEMA)
    batch = spark.createDataFrame([(1, "bob", "a@X.org", "u", None), (2, "ANN", "n@x.org", "u", None), (3, "Cy", "c@x.org", "u", None), (4, "cY", "d@x.org", "u", None)], REG_SCHEMA)
    ords = lambda df: sorted(r["ord"] for r in df.collect())
    for collation, taken, free, new in ((None, [], [1, 2, 3, 4], [1, 2, 3, 4]), ("UTF8_LCASE", [1, 2], [3, 4], [3])):
        assert ords(CH.key_taken(batch, users, collation).filter("taken")) == taken
        assert ords(CH.reject_existing(batch, users, collation)) == free
        assert ords(CH.register_batch(batch, users, collation)) == new
        assert U.lookup_by_key(users, "email", "a@X.org", collation).count() == len(taken) // 2
        assert U.semi_join_keys(users, "email", batch, "email", collation).count() == len(taken) // 2
        texts = spark.createDataFrame([("T5",), ("t5",), ("7",)], "model_used string")
        got = [tuple(r) for r in U.model_usage(texts, collation).collect()]
        assert got == ([("T5", 2)] if collation else [("T5", 1), ("t5", 1)])


@pytest.mark.parametrize("seed", range(3))
def test_audit_after_equals_the_full_audit(spark, seed):
    """Random tables and change sets: nulls, repeated ids, users that come, go
    and come back, rows deleted once of several."""
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    key = lambda n: pick(None, *range(n), *range(n))
    rows = {
        "users": ("id long, role string", lambda: (key(9), "user")),
        "user_texts": (
            "id long, user_id long, input_text string, content_text string, content_type string, model_used string",
            lambda: (key(12), key(11), pick(None, "i"), pick(None, "c"), pick(None, "summary", "s" * 21), pick(None, "m", "m" * 101)),
        ),
        "user_feedback": ("id long, user_id long, feedback_type string", lambda: (key(12), key(11), pick(None, "like", "meh"))),
        "login_history": ("id long, user_id long", lambda: (key(12), key(11))),
    }
    before, after, changes = {}, {}, {}
    for name, (schema, row) in rows.items():
        old = [row() for _ in range(30 if name != "users" else 8)]
        gone = rng.sample(old, pick(0, 3, 6))
        new = [row() for _ in range(pick(0, 3, 8))] + [x for x in gone if rng.random() < 0.3]
        left = list(old)
        for x in gone:
            left.remove(x)
        before[name] = spark.createDataFrame(old, schema)
        after[name] = spark.createDataFrame(left + new, schema)
        if name != "login_history" or seed:  # a table without a change frame
            changes[name] = spark.createDataFrame([(*x, -1) for x in gone] + [(*x, 1) for x in new], schema + ", change int")
        else:
            after[name] = before[name]
    names = ("users", "user_texts", "user_feedback", "login_history")
    audit = CH.constraint_audit(*(before[n] for n in names))
    got = sorted(map(tuple, CH.audit_after(audit, before, changes).collect()))
    assert got == sorted(map(tuple, CH.constraint_audit(*(after[n] for n in names)).collect()))
    assert sorted(map(tuple, CH.audit_after(audit, before, {}).collect())) == sorted(map(tuple, audit.collect()))
