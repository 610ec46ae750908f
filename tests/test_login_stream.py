import os
import random
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from proselab import schemas as S
from proselab.operators import usage as U
from proselab.streaming import login_stream as L

USERS = [(i, f"u{i}") for i in range(40)]


def _rows(seed, first, n):
    r = random.Random(seed)
    out = []
    for i in range(first, first + n):
        user = 1 if r.random() < 0.4 else r.choice([None, 99, *range(40)])  # a hot user, no user, an unknown one
        when = None if r.random() < 0.1 else datetime(2024, 1, 1) + timedelta(hours=r.randrange(72))
        out.append((i, user, when))
    return out


def test_restarts_and_late_files_give_the_batch_answers(spark):
    base = tempfile.mkdtemp(prefix="proselab-logins-")
    path, schema = os.path.join(base, "logins"), S.LOGIN_HISTORY
    users = spark.createDataFrame(USERS, "id long, username string")
    spark.createDataFrame([], schema).write.parquet(path)
    # the newest ids come first, the last file is late
    for k, first in enumerate((400, 200, 600, 0)):
        spark.createDataFrame(_rows(k, first, 150), schema).write.mode("append").parquet(path)
        for name, stream, step in (
            ("latest", lambda s: s, L.latest_logins(lambda _: users)),
            ("unique", L.first_logins, L.count_rows),
            ("days", lambda s: s, L.daily_sketches),
        ):
            L.keep(stream(L.login_stream(spark, path)), f"{base}/{name}", f"{name}{k}", step, f"{base}/ck-{name}").awaitTermination()
        table = spark.read.schema(schema).parquet(path)
        assert [tuple(r) for r in U.recent_logins(table, users).collect()] == [
            tuple(r) for r in L.read_kept(spark, f"{base}/latest").orderBy(F.col("login_time").desc_nulls_last(), F.col("login_id").desc()).collect()
        ]
        assert L.read_kept(spark, f"{base}/unique").first()[0] == U.unique_logins(table).first()[0]
        days = L.read_kept(spark, f"{base}/days")
        dated = table.filter("login_time is not null")
        assert L.users_between(days).first()[0] == U.unique_logins(dated).first()[0]
        one = dated.filter("to_date(login_time) = date'2024-01-02'")
        assert L.users_between(days, "2024-01-02", "2024-01-02").first()[0] == U.unique_logins(one).first()[0]
    assert L.users_between(days, "2030-01-01").first()[0] == 0
    assert len([f for f in os.listdir(f"{base}/latest") if f.startswith("batch-")]) == 2


def test_a_repeated_or_torn_batch_starts_from_its_predecessor(spark):
    out = tempfile.mkdtemp(prefix="proselab-kept-")
    assert L.read_kept(spark, out + "/none") is None
    one = spark.createDataFrame([(3,)], "unique_users long")
    one.write.parquet(L._folder(out, 0))
    spark.createDataFrame([(9,)], "unique_users long").write.parquet(L._folder(out, 1))
    assert L.read_kept(spark, out).first()[0] == 9
    assert L.read_kept(spark, out, before=1).first()[0] == 3  # batch 1 is repeated
    os.makedirs(L._folder(out, 2))  # torn: no _SUCCESS
    assert L.read_kept(spark, out).first()[0] == 9
