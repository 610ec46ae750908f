"""DuckDB SQL fragments for the oracles (independent formulations of the
same metrics, written in plain SQL over lists)."""

from __future__ import annotations

from ..functions.text import WS_PORTABLE as WS

LEVELS_VALUES = "(VALUES ('conservative', 0), ('balanced', 1), ('creative', 2)) AS lv(level, level_order)"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({e}, ''), '{WS}+'), lambda w: w <> '')"


def rouge_tokens(e: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({e}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


def fallback(g: str, o: str) -> str:
    sg, so = strip(f"coalesce({g}, '')"), strip(f"coalesce({o}, '')")
    return f"CASE WHEN {sg} <> '' THEN {sg} ELSE {so} END"


def ngram_ctes(src: str, keys: list[str], orders: list[int], prefix: str) -> str:
    """CTEs ``{prefix}_ov`` (keys, ov1.., hc1.., rc1.., hyp_len, ref_len)
    from ``src`` having columns keys + h (list) + r (list)."""
    k = ", ".join(keys)
    kq = ", ".join(f"q.{x}" for x in keys)
    parts = []
    for n in orders:
        for s, col in ((0, "h"), (1, "r")):
            parts.append(
                f"SELECT {k}, {n} AS n, {s} AS s, array_to_string({col}[i:i + {n - 1}], ' ') AS g "
                f"FROM (SELECT {k}, {col}, unnest(range(1, len({col}) - {n} + 2)) AS i FROM {src}) z"
            )
    grams = "\nUNION ALL\n".join(parts)
    ov_cols = ", ".join(f"sum(CASE WHEN n = {n} THEN least(ch, cr) ELSE 0 END) AS ov{n}" for n in orders)
    tot = ", ".join(
        [f"CAST(greatest(len(q.h) - {n} + 1, 0) AS BIGINT) AS hc{n}" for n in orders]
        + [f"CAST(greatest(len(q.r) - {n} + 1, 0) AS BIGINT) AS rc{n}" for n in orders]
    )
    ovs = ", ".join(f"CAST(coalesce(o.ov{n}, 0) AS BIGINT) AS ov{n}" for n in orders)
    on = " AND ".join(f"o.{x} = q.{x}" for x in keys)
    return f"""{prefix}_grams AS ({grams}),
{prefix}_cnt AS (SELECT {k}, n, g, count(*) FILTER (WHERE s = 0) AS ch, count(*) FILTER (WHERE s = 1) AS cr
                FROM {prefix}_grams GROUP BY {k}, n, g),
{prefix}_o AS (SELECT {k}, {ov_cols} FROM {prefix}_cnt WHERE ch > 0 AND cr > 0 GROUP BY {k}),
{prefix}_ov AS (SELECT {kq}, {ovs}, {tot}, CAST(len(q.h) AS BIGINT) AS hyp_len, CAST(len(q.r) AS BIGINT) AS ref_len
               FROM {src} q LEFT JOIN {prefix}_o o ON {on})"""


def f_measure(ov: str, hc: str, rc: str) -> str:
    p = f"({ov} / greatest({hc}, 1))"
    r = f"({ov} / greatest({rc}, 1))"
    return f"CASE WHEN {p} + {r} > 0 THEN 2.0 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"


def lcs_ctes(src: str, key: str, prefix: str) -> str:
    """Recursive CTE ``{prefix}_lcs`` (key, lcs) for ``src`` with a single
    key column + h, r lists.  Row i of the DP is a list L with L[j+1] =
    dp[i][j]; dp[i+1][j] = max(dp[i][j], dp[i][k-1] + 1) for the last k <= j
    with h[k] = r[i+1] (rows are non-decreasing)."""
    new_row = (
        "list_concat([0], list_transform(range(1, len(s.h) + 1), lambda j: "
        "greatest(d.row[j + 1], coalesce(d.row[list_max(list_filter(d.p, lambda x: x <= j))] + 1, 0))))"
    )
    return f"""{prefix}_rec AS (
  WITH RECURSIVE dp({key}, i, row) AS (
    SELECT {key}, 0, list_transform(range(0, len(h) + 1), lambda x: 0) FROM {src}
    UNION ALL
    SELECT d.{key}, d.i + 1, {new_row}
    FROM (SELECT dp.{key}, dp.i, dp.row,
                 list_filter(range(1, len(s0.h) + 1), lambda x: s0.h[x] = s0.r[dp.i + 1]) AS p
          FROM dp JOIN {src} s0 ON s0.{key} = dp.{key} WHERE dp.i < len(s0.r)) d
    JOIN {src} s ON s.{key} = d.{key}
  )
  SELECT {key}, max_by(row[len(row)], i) AS lcs FROM dp GROUP BY {key}
)"""


def extractive_ctes(src: str, key: str, text: str, mx: str, mn: str, prefix: str) -> str:
    """CTE ``{prefix}_out(key, generated)``: the extractive stand-in
    generator, for ``src`` with columns key, text, mx, mn."""
    p = prefix
    sent = "regexp_extract_all(coalesce(" + text + ", ''), '[^.!?]+[.!?]*')"
    return f"""{p}_s0 AS (SELECT {key}, {mx} AS mx, {mn} AS mn, {sent} AS ss FROM {src}),
{p}_s1 AS (SELECT {key}, mx, mn, i AS sp, {strip('ss[i]')} AS s
           FROM (SELECT {key}, mx, mn, ss, unnest(range(1, len(ss) + 1)) AS i FROM {p}_s0) z),
{p}_s2 AS (SELECT *, len({words('s')}) AS nw FROM {p}_s1 WHERE s <> ''),
{p}_w AS (SELECT {key}, sp, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS w FROM {p}_s2),
{p}_f AS (SELECT {key}, w, count(*) AS f FROM {p}_w GROUP BY {key}, w),
{p}_sc AS (SELECT a.{key}, a.sp, avg(b.f) AS score FROM {p}_w a JOIN {p}_f b ON b.{key} = a.{key} AND b.w = a.w
           GROUP BY a.{key}, a.sp),
{p}_r AS (SELECT s.*, coalesce(sc.score, 0.0) AS score FROM {p}_s2 s
          LEFT JOIN {p}_sc sc ON sc.{key} = s.{key} AND sc.sp = s.sp),
{p}_k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, sp) AS rk,
                 sum(nw) OVER (PARTITION BY {key} ORDER BY score DESC, sp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
          FROM {p}_r),
{p}_g AS (SELECT {key}, string_agg(s, ' ' ORDER BY sp) AS g FROM {p}_k WHERE rk = 1 OR cum <= mx OR cum - nw < mn GROUP BY {key}),
{p}_out AS (SELECT q.{key}, coalesce(g.g, '') AS generated FROM {src} q LEFT JOIN {p}_g g ON g.{key} = q.{key})"""


def strip_prefixes_ctes(src: str, key: str, col: str, prefixes: list[str], prefix: str) -> str:
    """CTE chain ending in ``{prefix}_p{len(prefixes)}`` (key, s): the
    unwanted-prefix clean-up of ``col``, one step per prefix."""
    ctes = [f"{prefix}_p0 AS (SELECT {key}, {col} AS s FROM {src})"]
    for i, pre in enumerate(prefixes):
        rest = strip(f"substring(s, {len(pre) + 1}, 1073741824)")
        ctes.append(
            f"""{prefix}_p{i + 1} AS (SELECT {key}, CASE WHEN starts_with(lower(s), '{pre}') THEN
      CASE WHEN starts_with(r, ':') OR starts_with(r, '-') THEN {strip('substring(r, 2, 1073741824)')} ELSE r END
    ELSE s END AS s FROM (SELECT {key}, s, {rest} AS r FROM {prefix}_p{i}) z)"""
        )
    return ",\n".join(ctes)


def chunks_sql(src: str, key: str, text: str, size: int) -> str:
    """Chunks of at most ``size`` whitespace tokens: key, chunk_no (0-based),
    chunk_text, n_tokens."""
    w = words(text)
    return f"""SELECT {key}, CAST(i AS BIGINT) AS chunk_no, array_to_string(w[i * {size} + 1:(i + 1) * {size}], ' ') AS chunk_text,
       CAST(len(w[i * {size} + 1:(i + 1) * {size}]) AS BIGINT) AS n_tokens
FROM (SELECT {key}, w, unnest(range(0, CAST(ceil(len(w) / {float(size)}) AS BIGINT))) AS i
      FROM (SELECT {key}, {w} AS w FROM {src}) a) b"""
