"""Batch change sets applied to immutable table snapshots.

The reference issues one OLTP statement per request.  Here a *change frame*
goes in and a new snapshot comes out; every statement becomes a join or an
aggregation over whole tables.  Hot keys are handled by construction:
"latest per key" and "earliest duplicate" are aggregations (partial
aggregation before the shuffle), and anti/semi/outer joins are left to AQE,
whose skew-join handling splits an oversized partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collated
from ..schemas import CONTENT_TYPE_MAX_LEN, FEEDBACK_TYPES, MODEL_USED_MAX_LEN, ROLES
from ..session import cut_lineage

EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
DEFAULT_LANGUAGE = "English"
REGISTERED_ROLE = "user"


# ---------------------------------------------------------------- checks --
def email_ok(c: str | Column) -> Column:
    """Simple e-mail shape (one '@', a dot in the domain, no blanks).
    A documented approximation, not a full RFC 5322 validator."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(EMAIL_PATTERN), F.lit(False))


def required_ok(*cols: str) -> Column:
    """Every field present and non-empty."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in cols])


def key_taken(batch: DataFrame, users: DataFrame, collation: str | None = None) -> DataFrame:
    """B4 per row: (ord, taken) — e-mail OR user name already exists, compared
    under ``collation`` if one is given.

    Two left joins against the *distinct* key sets (no row multiplication),
    instead of one OR-join that would plan as a nested loop."""
    e = users.select(collated("email", collation).alias("_e")).distinct().withColumn("_he", F.lit(True))
    n = users.select(collated("username", collation).alias("_n")).distinct().withColumn("_hn", F.lit(True))
    return (
        batch.join(e, collated(batch["email"], collation) == e["_e"], "left")
        .join(n, collated(batch["username"], collation) == n["_n"], "left")
        .select("ord", (F.coalesce("_he", F.lit(False)) | F.coalesce("_hn", F.lit(False))).alias("taken"))
    )


def reject_existing(batch: DataFrame, users: DataFrame, collation: str | None = None) -> DataFrame:
    """Drop rows whose e-mail or user name already exists (two anti-joins),
    compared under ``collation`` if one is given."""
    e = users.select(collated("email", collation).alias("_e"))
    n = users.select(collated("username", collation).alias("_n"))
    return batch.join(e, collated(batch["email"], collation) == e["_e"], "left_anti").join(
        n, collated(batch["username"], collation) == n["_n"], "left_anti"
    )


def fk_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent."""
    p = parent.select(F.col(pk).alias("_pk"))
    return child.filter(F.col(fk).isNotNull()).join(p, F.col(fk) == p["_pk"], "left_anti")


def _audit_table(
    table: str, df: DataFrame, pk: str, rules: dict[str, Column], fk: str | None, parent: DataFrame | None, parent_pk: str = "id"
) -> DataFrame:
    """All audits of one table from ONE scan: rule predicates are summed per
    primary key, foreign keys are checked with a left join to the parent's
    distinct keys, and a single global aggregate yields (table, rule,
    violations) for every rule, ``duplicate_pk`` and ``fk_<col>``."""
    x = df
    orphan = F.lit(False)
    if fk is not None and parent is not None:
        keys = parent.select(F.col(parent_pk).alias("_pk")).distinct().withColumn("_has", F.lit(True))
        x = x.join(keys, x[fk] == keys["_pk"], "left")
        orphan = F.col(fk).isNotNull() & F.col("_has").isNull()
    per_key = x.groupBy(pk).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(orphan).alias("_orph"),
        *[F.count_if(c).alias(r) for r, c in rules.items()],
    )
    names = list(rules)
    agg = per_key.agg(
        *[F.sum(r).cast("long").alias(r) for r in names],
        F.count_if(F.col("_rows") > 1).cast("long").alias("duplicate_pk"),
        *([F.sum("_orph").cast("long").alias(f"fk_{fk}")] if fk is not None else []),
    )
    out = names + ["duplicate_pk"] + ([f"fk_{fk}"] if fk is not None else [])
    stack = ", ".join(f"'{r}', `{r}`" for r in out)
    return agg.selectExpr(f"'{table}' AS table_name", f"stack({len(out)}, {stack}) AS (rule, violations)")


def _audit_rules() -> dict[str, dict[str, Column]]:
    """The row rules of the three tables with declared DDL; each also has a
    primary key ``id`` and a foreign key ``user_id``."""
    nn = lambda c: F.col(c).isNull()
    return {
        "user_texts": {
            "not_null_user_id": nn("user_id"),
            "not_null_input_text": nn("input_text"),
            "not_null_content_text": nn("content_text"),
            "not_null_content_type": nn("content_type"),
            "len_content_type": F.coalesce(F.length("content_type") > CONTENT_TYPE_MAX_LEN, F.lit(False)),
            "len_model_used": F.coalesce(F.length("model_used") > MODEL_USED_MAX_LEN, F.lit(False)),
        },
        "user_feedback": {
            "not_null_user_id": nn("user_id"),
            "not_null_feedback_type": nn("feedback_type"),
            "enum_feedback_type": F.coalesce(~F.col("feedback_type").isin(*FEEDBACK_TYPES), F.lit(False)),
        },
        "login_history": {},
    }


def constraint_audit(
    users: DataFrame, texts: DataFrame, feedback: DataFrame, logins: DataFrame
) -> DataFrame:
    """NOT NULL, ENUM domain, VARCHAR length, duplicate PK and FK
    orphan counts for the three application tables with declared DDL, one
    scan per table."""
    tables = {"user_texts": texts, "user_feedback": feedback, "login_history": logins}
    return reduce(DataFrame.unionByName, [_audit_table(t, tables[t], "id", r, "user_id", users) for t, r in _audit_rules().items()])


def _key_counts(changed: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key, before, after): how many rows of ``table`` have each key that a
    change frame touches.  The table's rows meet only the touched keys (a
    semi-join on one column), and null is a key like any other."""
    net = changed.groupBy(F.col(key).alias("key")).agg(F.sum("change").alias("_net"))
    touched = net.select(F.col("key").alias("_touched"))
    old = table.select(F.col(key).alias("_key"))
    old = old.join(touched, F.col("_key").eqNullSafe(F.col("_touched")), "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_old"))
    before = F.coalesce("_old", F.lit(0))
    return net.join(old, F.col("key").eqNullSafe(F.col("_key")), "left").select("key", before.alias("before"), (before + F.col("_net")).alias("after"))


def _orphan_delta(child: DataFrame, changed: DataFrame, users: DataFrame, user_counts: DataFrame) -> DataFrame:
    """Change of a child table's orphans, in two parts that add up: changed
    rows against the users as they are afterwards, and the table as it was
    against the users that came or went."""
    net = changed.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.sum("change").alias("_net")).filter("_net <> 0")
    had = users.select(F.col("id").alias("_had")).join(net, F.col("_had") == F.col("user_id"), "left_semi").distinct()
    after = user_counts.select(F.col("key").alias("_user"), (F.col("after") > 0).alias("_has"))
    known = F.coalesce("_has", F.col("_had").isNotNull())
    own = net.join(had, F.col("user_id") == F.col("_had"), "left").join(after, F.col("user_id") == F.col("_user"), "left")
    own = own.filter(~known).select(F.col("_net").alias("violations"))
    moved = user_counts.select(
        F.col("key").alias("_user"), ((F.col("before") > 0).cast("long") - (F.col("after") > 0).cast("long")).alias("violations")
    ).filter("violations <> 0 AND _user IS NOT NULL")
    others = child.select("user_id").join(moved, F.col("user_id") == F.col("_user")).select("violations")
    return own.unionByName(others).agg(F.sum("violations").alias("violations"))


def audit_after(audit: DataFrame, before: dict[str, DataFrame], changes: dict[str, DataFrame]) -> DataFrame:
    """B11 and C6 kept up to date: the audit of the tables after a change set,
    from the ``audit`` before it.

    ``before`` holds the tables as they were (``users`` and the three audited
    ones), ``changes`` for any of them a frame of whole rows with ``change``
    1 for a row that came and -1 for one that went (an update is both).  Rules
    of single rows read the change frame only.  Keys read the old table's key
    column, met with the touched keys alone; nothing else is scanned or
    grouped, so the cost follows the change set.  A deleted row must be in its
    table, repeated rows are deleted once for each -1, and a missing or empty
    frame changes nothing."""
    none = F.lit(None).cast("long")
    parts = [audit.select("table_name", "rule", F.col("violations").cast("long").alias("violations"))]

    def add(table: str, rule: str, delta: DataFrame) -> None:
        parts.append(delta.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col("violations").cast("long").alias("violations")))

    users = before["users"]
    moved = changes.get("users", users.limit(0).withColumn("change", none))
    user_counts = _key_counts(moved, users, "id")
    for table, rules in _audit_rules().items():
        old = before[table]
        changed = changes.get(table)
        if changed is not None:
            if rules:
                sums = changed.agg(*[F.sum(F.when(c, F.col("change"))).alias(r) for r, c in rules.items()])
                stack = ", ".join(f"'{r}', `{r}`" for r in rules)
                parts.append(sums.selectExpr(f"'{table}' AS table_name", f"stack({len(rules)}, {stack}) AS (rule, violations)"))
            twice = (F.col("after") > 1).cast("long") - (F.col("before") > 1).cast("long")
            add(table, "duplicate_pk", _key_counts(changed, old, "id").agg(F.sum(twice).alias("violations")))
        if changed is not None or "users" in changes:
            rows = changed if changed is not None else old.limit(0).withColumn("change", none)
            add(table, "fk_user_id", _orphan_delta(old, rows, users, user_counts))
    total = F.sum(F.coalesce("violations", F.lit(0))).alias("violations")
    return reduce(DataFrame.unionByName, parts).groupBy("table_name", "rule").agg(total)


# --------------------------------------------------------------- updates --
def update_by_key(
    df: DataFrame, changes: DataFrame, key: str, cols: list[str], changed_col: str | None = None
) -> DataFrame:
    """H1/H2/H3: ``UPDATE t SET cols = change.cols WHERE t.key = change.key``.

    ``changes`` holds at most one row per key (use ``latest_per_key`` first).
    A matched row takes the change's values even when they are NULL (presence
    flag, not coalesce).  ``changed_col`` adds the per-row "affected" flag."""
    ch = changes.select(
        F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit")
    )
    j = df.join(ch, df[key] == ch["_k"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = [
        F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ]
    if changed_col:
        out.append(hit.alias(changed_col))
    return j.select(*out)


def affected_count(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows an update would touch (``cursor.rowcount``), as one row."""
    k = changes.select(F.col(key).alias("_k"))
    return df.join(k, df[key] == k["_k"], "left_semi").agg(F.count(F.lit(1)).cast("long").alias("affected"))


def latest_per_key(changes: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """Last change per key by ``seq`` — an aggregation (``max_by``), so a hot
    key is pre-aggregated on the map side instead of sorted in one task."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_v")).select(
        key, *[F.col(f"_v.{c}").alias(c) for c in cols]
    )


def set_role(users: DataFrame, role_changes: DataFrame, seq: str = "seq") -> DataFrame:
    """H2: promote/demote; only roles in {admin, user} are applied, and of
    several changes for one user the last by ``seq``."""
    valid = role_changes.filter(F.col("role").isin(*ROLES))
    return update_by_key(users, latest_per_key(valid, "id", seq, ["role"]), "id", ["role"])


def delete_by_key(df: DataFrame, keys: DataFrame, key: str, keys_col: str | None = None) -> DataFrame:
    """H4: ``DELETE FROM t WHERE key IN keys`` as a left anti join."""
    k = keys.select(F.col(keys_col or key).alias("_k")).filter(F.col("_k").isNotNull())
    return df.join(k, df[key] == k["_k"], "left_anti")


def delete_users_cascade(tables: dict[str, DataFrame], user_keys: DataFrame) -> dict[str, DataFrame]:
    """H5: remove the users and every row that references them, all tables
    from the same key set (all-or-nothing: the result is one consistent set
    of new snapshots, nothing is written until the caller writes them all)."""
    keys = user_keys.select(F.col("id").alias("_uid")).distinct()
    fk = {"login_history": "user_id", "profiles": "user_id", "user_feedback": "user_id", "user_texts": "user_id"}
    out = {t: delete_by_key(tables[t], keys, c, "_uid") for t, c in fk.items()}
    out["users"] = delete_by_key(tables["users"], keys, "id", "_uid")
    return out


def upsert_profiles(profiles: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """H6: update the profile when present, else insert it.  The latest
    change per user wins, including NULL values it carries."""
    cols = ["age_group", "language_preference"]
    last = latest_per_key(changes, "user_id", seq, cols)
    ch = last.select(F.col("user_id").alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = profiles.join(ch, profiles["user_id"] == ch["_k"], "full_outer")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(
        F.coalesce(F.col("user_id"), F.col("_k")).alias("user_id"),
        *[F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
    )


# ----------------------------------------------------------- registration --
#: undecided rows (three numbers each) that one task decides in order
AT_ONCE = 1_000_000
#: parallel rounds before the conflict graph is cut into components
PEELS = 3
_ROW = "ord bigint, e bigint, n bigint"


def _keyed(cand: DataFrame, collation: str | None) -> DataFrame:
    """(ord, e, n): each key by the earliest row that carries it, so that
    equality under any collation is equality of numbers from here on."""
    rows = cand.select("ord", collated("email", collation).alias("_e"), collated("username", collation).alias("_n"))
    e = rows.groupBy(F.col("_e").alias("_ge")).agg(F.min("ord").alias("e"))
    n = rows.groupBy(F.col("_n").alias("_gn")).agg(F.min("ord").alias("n"))
    return rows.join(e, F.col("_e") == F.col("_ge")).join(n, F.col("_n") == F.col("_gn")).select(*(F.col(c).cast("bigint") for c in ("ord", "e", "n")))


def _peel(rows: DataFrame) -> DataFrame:
    """The rows that come first under both of their keys."""
    e = rows.groupBy(F.col("e").alias("_e")).agg(F.min("ord").alias("_oe"))
    n = rows.groupBy(F.col("n").alias("_n")).agg(F.min("ord").alias("_on"))
    first = rows.join(e, F.col("e") == F.col("_e")).join(n, F.col("n") == F.col("_n"))
    return first.filter((F.col("ord") == F.col("_oe")) & (F.col("ord") == F.col("_on"))).select("ord", "e", "n")


def _components(rows: DataFrame) -> DataFrame:
    """``rows`` with ``part``, the least ``ord`` of all rows that hang together
    through shared keys: every step takes the least label under either key,
    then the label of that label, so a chain halves with each step."""
    state = cut_lineage(rows.withColumn("part", F.col("ord")))
    while True:
        e = state.groupBy(F.col("e").alias("_e")).agg(F.min("part").alias("_pe"))
        n = state.groupBy(F.col("n").alias("_n")).agg(F.min("part").alias("_pn"))
        low = state.join(e, F.col("e") == F.col("_e")).join(n, F.col("n") == F.col("_n")).withColumn("_p", F.least("_pe", "_pn"))
        low = cut_lineage(low.select("ord", "e", "n", F.col("part").alias("_old"), F.col("_p").alias("part")))
        label = low.select(F.col("ord").alias("_at"), F.col("part").alias("_up"))
        jumped = low.join(label, F.col("part") == F.col("_at"))
        state = cut_lineage(jumped.select("ord", "e", "n", F.col("_up").alias("part"), (F.col("_up") != F.col("_old")).alias("_moved")))
        if not state.filter("_moved").head(1):
            return state.select("ord", "e", "n", "part")
        state = state.drop("_moved")


def _decide(parts: DataFrame) -> DataFrame:
    """First come, first served inside each ``part``, row by row in order."""

    def run(batches):
        import pyarrow as pa

        part, taken_e, taken_n = None, set(), set()
        for batch in batches:
            won: list[tuple] = []
            for o, e, n, p in zip(*(batch.column(c).to_pylist() for c in ("ord", "e", "n", "part")), strict=True):
                if p != part:
                    part, taken_e, taken_n = p, set(), set()
                if e not in taken_e and n not in taken_n:
                    taken_e.add(e)
                    taken_n.add(n)
                    won.append((o, e, n))
            cols = zip(*won, strict=True) if won else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["ord", "e", "n"])

    return parts.repartition("part").sortWithinPartitions("part", "ord").select("ord", "e", "n", "part").mapInArrow(run, _ROW)


def _accepted(cand: DataFrame, collation: str | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """Exact sequential "first come wins" on two unique keys: a row is accepted
    unless an accepted row before it has its e-mail or its user name.

    A few parallel rounds accept the rows that come first under both of their
    keys and drop those that share a key with one of them.  What is undecided
    then is decided in order: in one task if it is at most ``at_once`` rows of
    three numbers, otherwise component by component of the conflict graph,
    each in one task, and of a component beyond that size its first
    ``at_once`` rows or so, which depend on no later one; then again.  So the
    number of rounds does not follow the length of a chain of conflicts."""
    rows, rounds = cut_lineage(_keyed(cand, collation)), 0
    accepted: list[DataFrame] = []
    while True:
        left = rows.count()
        if left <= at_once:
            accepted.append(_decide(rows.withColumn("part", F.lit(0).cast("bigint"))))
            break
        rounds += 1
        if rounds <= PEELS:
            won, chosen = cut_lineage(_peel(rows)), None
        else:
            parts = _components(rows)
            size = parts.groupBy("part").agg(F.count(F.lit(1)).alias("_size"))
            large = parts.join(size.filter(F.col("_size") > at_once), "part")
            until = _until(large, at_once)
            chosen = cut_lineage(parts.join(until, "part", "left").filter(F.col("_until").isNull() | (F.col("ord") <= F.col("_until"))).select("ord", "e", "n", "part"))
            won = cut_lineage(_decide(chosen))
        accepted.append(won)
        rest = rows if chosen is None else rows.join(chosen.select("ord"), "ord", "left_anti")
        rest = rest.join(won.select("e"), "e", "left_anti").join(won.select("n"), "n", "left_anti")
        rows = cut_lineage(rest.select("ord", "e", "n"))
    ords = reduce(DataFrame.unionByName, accepted).select(F.col("ord").alias("_won"))
    return cand.join(ords, F.col("ord") == F.col("_won"), "left_semi")


def _until(large: DataFrame, at_once: int) -> DataFrame:
    """(part, _until): about the ``at_once``-th ``ord`` of each large part, and
    never before its first row, from counts over ranges of ``ord``; where
    those lie close together no range holds over half of ``at_once`` rows."""
    span = large.groupBy("part").agg(F.min("ord").alias("_a"), F.max("ord").alias("_z"), F.max("_size").alias("_size"))
    step = F.greatest(F.lit(1), F.floor((F.col("_z") - F.col("_a") + 1) * (at_once / 2) / F.col("_size"))).cast("bigint")
    cell = F.floor((F.col("ord") - F.col("_a")) / F.col("_step")).cast("bigint")
    counted = large.drop("_size").join(span.withColumn("_step", step), "part").groupBy("part", "_a", "_step", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("part").orderBy("_cell"))
    fits = counted.withColumn("_upto", before).filter((F.col("_upto") <= at_once) | (F.col("_upto") == F.col("_n")))
    return fits.groupBy("part").agg(F.max(F.col("_a") + (F.col("_cell") + 1) * F.col("_step") - 1).alias("_until"))


def register_batch(batch: DataFrame, users: DataFrame, collation: str | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """H7: validate e-mails, drop rows clashing with existing users, resolve
    in-batch clashes in arrival order (``ord``, unique), and emit the new user
    rows with role 'user' (the requested role is ignored, as in the reference)
    and language defaulting to English.  A row without a user name is
    rejected.  Keys are compared under ``collation`` if one is given."""
    valid = batch.filter(email_ok("email") & F.col("username").isNotNull())
    cand = reject_existing(valid, users, collation).select(
        "ord", "username", "email", F.coalesce("language_preference", F.lit(DEFAULT_LANGUAGE)).alias("language_preference")
    )
    acc = _accepted(cut_lineage(cand), collation, at_once)
    return acc.select("ord", "username", "email", "language_preference", F.lit(REGISTERED_ROLE).alias("role"))


def registered_tables(batch: DataFrame, users: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H7 as new snapshots: ``users`` with the accepted registrations, whose
    ids go on from the largest one in order of arrival, and ``profiles`` with
    one row per new user: NULL age, the user's language, the new id."""
    from ..plans.ranking import numbered_within

    accepted = cut_lineage(register_batch(batch, users))
    last = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    ids = numbered_within(accepted.select("ord"), [], ["ord"], "_n").select(F.col("ord").alias("_o"), (F.col("_n") + last).alias("id"))
    new = accepted.join(ids, F.col("ord") == F.col("_o"))
    new_users = users.unionByName(new.select(*users.columns))
    new_profiles = profiles.unionByName(new.select(F.col("id").alias("user_id"), F.lit(None).cast("string").alias("age_group"), "language_preference"))
    return new_users, new_profiles


# ---------------------------------------------------------------- appends --
def dedup_append(existing: DataFrame, batch: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """H8: append ``batch`` but keep one row per content key — the earliest
    by ``order_cols``.  Whole texts are never grouping or sort keys: a key is
    its SHA-256, the earliest order per digest combines before the shuffle,
    and only the rows that reach it go on."""
    u = existing.unionByName(batch)
    digest = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in key_cols])), 256)
    u = u.withColumn("_d", digest)
    first = u.groupBy(F.col("_d").alias("_fd")).agg(F.min(F.struct(*order_cols)).alias("_o"))
    same = F.col("_d") == F.col("_fd")
    for c in order_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_o.{c}"))
    # rows alike in key and order are copies: the numbering keeps one of them
    nth = F.row_number().over(Window.partitionBy("_d").orderBy(*order_cols))
    out = u.join(first, same, "left_semi").withColumn("_n", nth).filter("_n = 1")
    return out.select(*existing.columns)
