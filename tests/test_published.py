import pytest
from pyspark.sql import functions as F

from proselab import schemas as S
from proselab.operators import usage as U
from proselab.sources import published as P
from proselab.sources import views as V

from .conftest import SF_SMALL


def app(spark):
    return {t: V.view(spark, SF_SMALL, t) for t in P.APP_TABLES}


@pytest.fixture()
def root(tmp_path):
    return f"{tmp_path}/store"


def small(spark):
    users = spark.createDataFrame([(i, f"u{i}", f"u{i}@x.org", "English", "admin" if i % 3 == 0 else "user") for i in range(1, 8)], S.USERS)
    logins = spark.createDataFrame([(i, i % 7 + 1, None) for i in range(1, 22)], S.LOGIN_HISTORY)
    return {"users": users, "login_history": logins}


def admins(tables):
    return tables["users"].filter("role = 'admin'").select("id")


def state(store):
    return {t: sorted(map(repr, store.read(t).collect())) for t in store.tables}


def test_create_only_if_absent(spark, root):
    store = P.Published(spark, root)
    assert store.version() == 0 and store.create(small(spark))
    before = state(store)
    assert not store.create() and not P.Published(spark, root).create(small(spark))
    assert store.version() == 1 and state(store) == before and len(before["users"]) == 7 and before["user_texts"] == []


@pytest.mark.parametrize("crash", [1, 2, 3, 4, 5, "manifest", "rename"])
def test_a_crash_between_writes_leaves_the_old_version(spark, root, monkeypatch, crash):
    store = P.Published(spark, root)
    store.create(small(spark))
    before = state(store)
    with monkeypatch.context() as m:
        if isinstance(crash, int):
            real, calls = P.Published._write, []

            def write(self, name, rows):
                calls.append(name)
                if len(calls) == crash:
                    raise OSError("lost")
                return real(self, name, rows)

            m.setattr(P.Published, "_write", write)
        elif crash == "manifest":
            m.setattr(P.Published, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        else:
            store._context = type("Broken", (), {"rename": lambda *a: (_ for _ in ()).throw(OSError("lost"))})()
        with pytest.raises(OSError):
            P.delete_users(store, admins)
    store = P.Published(spark, root)
    assert store.version() == 1 and state(store) == before
    assert P.delete_users(store, admins) == 2
    assert {r["id"] for r in store.read("users").collect()} == {1, 2, 4, 5, 7}
    assert not {r["user_id"] for r in store.read("login_history").collect()} & {3, 6}
    assert len(store.vacuum(keep=1, min_age_s=0)) >= 5 and len(store.read("users").collect()) == 5


def test_interleaved_appends_give_unique_ids(spark, root, monkeypatch):
    """The second append commits while the first is between its write and its
    commit; the first is numbered behind it."""
    store, other = P.Published(spark, root), P.Published(spark, root)
    store.create(small(spark))
    mine, theirs = (spark.createDataFrame([(u, None) for u in us], "user_id long, login_time timestamp_ntz") for us in ([101, 102, 103], [201, 202]))
    real, done = P.Published._commit, []

    def commit(self, base, changed):
        if self is store and not done:
            done.append(other.append("login_history", theirs))
        return real(self, base, changed)

    monkeypatch.setattr(P.Published, "_commit", commit)
    assert store.append("login_history", mine) == 3 and done == [2]
    rows = store.read("login_history").collect()
    ids = {r["user_id"]: r["id"] for r in rows if r["user_id"] > 100}
    assert sorted(r["id"] for r in rows) == list(range(1, 27))
    assert [ids[u] for u in (201, 202, 101, 102, 103)] == [22, 23, 24, 25, 26]
    assert store.append("login_history", mine) == 4 and store.read("login_history").agg(F.max("id")).first()[0] == 29


def test_appends_to_other_tables_do_not_renumber(spark, root, monkeypatch):
    store, other = P.Published(spark, root), P.Published(spark, root)
    store.create(small(spark))
    real, done, written = P.Published._commit, [], []
    write = P.Published._write
    monkeypatch.setattr(P.Published, "_write", lambda self, name, rows: written.append(name) or write(self, name, rows))

    def commit(self, base, changed):
        if self is store and not done:
            done.append(other.append("user_feedback", spark.createDataFrame([(1, "like", "x")], "user_id long, feedback_type string, comment string")))
        return real(self, base, changed)

    monkeypatch.setattr(P.Published, "_commit", commit)
    store.append("login_history", spark.createDataFrame([(5, None)], "user_id long, login_time timestamp_ntz"))
    assert written.count("login_history") == 1 and store.version() == 3
    assert store.read("user_feedback").first()["id"] == 1 and store.read("user_feedback").first()["created_at"] is not None


def test_a_change_is_computed_anew_after_a_conflict(spark, root, monkeypatch):
    """Rows of a user appended while the user is being deleted go as well; ids
    of deleted rows are not given again."""
    store, other = P.Published(spark, root), P.Published(spark, root)
    store.create(small(spark))
    real, done = P.Published._commit, []

    def commit(self, base, changed):
        if self is store and not done:
            done.append(other.append("login_history", spark.createDataFrame([(3, None)], "user_id long, login_time timestamp_ntz")))
        return real(self, base, changed)

    monkeypatch.setattr(P.Published, "_commit", commit)
    assert P.delete_users(store, admins) == 3
    assert 3 not in {r["user_id"] for r in store.read("login_history").collect()}
    store.append("login_history", spark.createDataFrame([(1, None)], "user_id long, login_time timestamp_ntz"))
    assert store.read("login_history").agg(F.max("id")).first()[0] == 23
    store.attempts = 1
    done.clear()
    with pytest.raises(P.CommitConflict):
        P.delete_users(store, admins)


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange" in line]


def test_bucketed_tables_join_and_group_without_an_exchange(spark, root):
    store = P.Published(spark, root, layouts=P.user_layouts(8))
    store.create(app(spark))
    plain = app(spark)
    session = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in session}
    for k, v in session.items():
        spark.conf.set(k, v)
    try:
        for fn, tables in ((U.texts_with_users, ("user_texts", "users")), (U.feedback_with_users, ("user_feedback", "users"))):
            out = fn(*(store.read(t, bucketed=True) for t in tables))
            assert [x for x in exchanges(out) if "hashpartitioning" in x] == []  # the order by has a range exchange
            assert sorted(map(repr, out.collect())) == sorted(map(repr, fn(*(plain[t] for t in tables)).collect()))
        unique = U.unique_logins(store.read("login_history", bucketed=True))
        assert all("SinglePartition" in x for x in exchanges(unique))
        assert unique.first() == U.unique_logins(plain["login_history"]).first()
        fresh = P.Published(spark.newSession(), root, layouts=P.user_layouts(8))  # another session attaches the folders
        assert fresh.read("users", bucketed=True).count() == plain["users"].count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_an_uneven_table_is_read_as_plain_files(spark, root):
    store = P.Published(spark, root, layouts=P.user_layouts(16))
    logins = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("user_id"), F.lit(None).cast("timestamp_ntz").alias("login_time"))
    store.create({"login_history": logins})
    assert not store.manifest()["tables"]["login_history"]["parts"][0]["even"]
    assert "Bucketed: true" not in store.read("login_history")._jdf.queryExecution().toString() and store.read("login_history").count() == 4000
