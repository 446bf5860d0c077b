"""DuckDB SQL with the result each query must have.

Written from the definition of each analysis over single lines, not from its Spark plan.
"""

from __future__ import annotations

from tiercurve.sources.retail import POLICY_ROWS, RIVAL

_TX = """
tx AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id,
         CAST(o_orderdate AS DATE) AS tran_date,
         CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -l_quantity
                   ELSE l_quantity END AS INTEGER) AS qty,
         CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -l_extendedprice
                   ELSE l_extendedprice END AS DECIMAL(18,2)) AS total_amt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

_NET = """
net AS (
  SELECT t.* FROM tx t
  WHERE NOT EXISTS (SELECT 1 FROM tx r WHERE r.qty < 0 AND r.transaction_id = t.transaction_id)
)"""

_SUMMARY = """
summary AS (
  SELECT customer_id, CAST(count(DISTINCT transaction_id) AS DOUBLE) AS cnt_order,
         CAST(sum(total_amt) AS DECIMAL(28,2)) AS sum_amt
  FROM net GROUP BY customer_id
)"""

_LIFETIME = """
lifetime AS (
  SELECT customer_id, count(DISTINCT transaction_id) AS cnt_ord,
         min(tran_date) AS fst_buy_dt, strftime(min(tran_date), '%Y-%m') AS fst_buy_ym,
         max(tran_date) AS lst_buy_dt, strftime(max(tran_date), '%Y-%m') AS lst_buy_ym,
         CAST(date_diff('day', min(tran_date), max(tran_date)) AS INTEGER) AS diff_days
  FROM net GROUP BY customer_id
)"""

_HIS = """
months AS (
  SELECT CAST(unnest(generate_series(date_trunc('month', min(tran_date))::TIMESTAMP,
                                     date_trunc('month', max(tran_date))::TIMESTAMP + INTERVAL 11 MONTH,
                                     INTERVAL 1 MONTH)) AS DATE) AS m
  FROM net
),
his AS (
  SELECT customer_id, strftime(m, '%Y-%m') AS std_ym,
         count(DISTINCT transaction_id) AS cnt_order,
         CAST(sum(total_amt) AS DECIMAL(28,2)) AS sum_amt
  FROM net JOIN months
    ON tran_date >= m - INTERVAL 11 MONTH AND tran_date < m + INTERVAL 1 MONTH
  GROUP BY customer_id, m
)"""


def _labels(name: str, rows: str) -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT h.*, p.*, CAST(row_number() OVER (
             PARTITION BY h.customer_id, h.std_ym, p.gb ORDER BY p.grd_cd) AS INTEGER) AS rn
    FROM his h JOIN ({rows}) p ON h.cnt_order >= p.std_ord AND h.sum_amt >= p.std_amt
  ) WHERE rn = 1
)"""


_POLICY = f"""
policy AS (
  SELECT gb, CAST(grd_cd AS INTEGER) AS grd_cd, grd_nm, CAST(std_ord AS INTEGER) AS std_ord,
         CAST(std_amt AS DECIMAL(18,2)) AS std_amt
  FROM (VALUES {POLICY_ROWS}) AS t(gb, grd_cd, grd_nm, std_ord, std_amt)
)"""

_LABELS = _labels("labelled", "SELECT * FROM policy")
_BASE = """
base AS (SELECT std_ym, count(*) AS n FROM labelled WHERE gb = 'case1' GROUP BY std_ym)"""
_OLD_BASE = (
    _labels("old_labelled", f"SELECT * FROM policy WHERE gb IN ('case1', '{RIVAL}')")
    + """,
base AS (SELECT std_ym, count(*) AS n FROM old_labelled WHERE gb = 'case1' GROUP BY std_ym)"""
)
_COUNTS = """
counts AS (
  SELECT std_ym, grd_cd, grd_nm, gb, count(*) AS cnt FROM labelled
  GROUP BY std_ym, grd_cd, grd_nm, gb
)"""
_MIX = f"""
mix AS (
  SELECT std_ym, grd_cd, grd_nm,
         max(CASE WHEN gb = 'case1' THEN cnt END) AS "case1",
         max(CASE WHEN gb = 'case2' THEN cnt END) AS "case2",
         max(CASE WHEN gb = '{RIVAL}' THEN cnt END) AS "{RIVAL}",
         n
  FROM counts JOIN base USING (std_ym) GROUP BY std_ym, grd_cd, grd_nm, n
),
shares AS (
  SELECT *, CAST("case1" AS DOUBLE) / n AS case1_prop, CAST("case2" AS DOUBLE) / n AS case2_prop,
         CAST("{RIVAL}" AS DOUBLE) / n AS rival_prop
  FROM mix
)"""
_VIP = """
vip AS (
  SELECT std_ym, grd_cd, grd_nm, gb, cnt, n, CAST(cnt AS DOUBLE) / n AS prop
  FROM counts JOIN base USING (std_ym) WHERE grd_cd = 10
)"""
_PERCENTS = f"""
SELECT std_ym, grd_cd, grd_nm, "case1", "case2", "{RIVAL}", n,
       printf('%.1f%%', round_even(case1_prop * 1000, 0) / 10) AS case1_prop,
       printf('%.1f%%', round_even(case2_prop * 1000, 0) / 10) AS case2_prop,
       printf('%.1f%%', round_even(rival_prop * 1000, 0) / 10) AS rival_prop
FROM shares"""
_RANKED = """
ranked AS (
  SELECT customer_id, std_ym, cnt_order, sum_amt, gb, grd_cd, grd_nm, std_ord, std_amt,
         CAST(row_number() OVER (PARTITION BY std_ym ORDER BY grd_cd NULLS LAST,
              cnt_order DESC NULLS LAST, sum_amt DESC NULLS LAST, customer_id NULLS LAST)
              AS INTEGER) AS rn
  FROM labelled WHERE gb = 'case1'
)"""
_CURVE = """
yearly AS (
  SELECT customer_id, CAST(extract(year FROM tran_date) AS INTEGER) AS yyyy,
         CAST(sum(total_amt) AS DECIMAL(28,2)) AS sum_amt
  FROM tx GROUP BY 1, 2
),
totals AS (
  SELECT yyyy, CAST(count(DISTINCT customer_id) AS DOUBLE) AS tot_cust,
         CAST(sum(sum_amt) AS DOUBLE) AS tot_amt
  FROM yearly GROUP BY yyyy
),
curve AS (
  SELECT yyyy, customer_id, 1 / tot_cust AS cust_prop,
         count(*) OVER w / tot_cust AS acc_cust_prop,
         CAST(sum_amt AS DOUBLE) / tot_amt AS amt_prop,
         CAST(sum(sum_amt) OVER w AS DOUBLE) / tot_amt AS acc_amt_prop
  FROM yearly JOIN totals USING (yyyy)
  WINDOW w AS (PARTITION BY yyyy ORDER BY sum_amt DESC NULLS FIRST)
)"""


def _box(source: str, keys: str, where: str = "TRUE") -> str:
    return f"""
cells AS (SELECT {keys}, CAST(sum_amt AS DOUBLE) AS x FROM {source} WHERE {where}),
boxes AS (
  SELECT {keys}, count(x) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med,
         quantile_cont(x, 0.75) AS q3
  FROM cells GROUP BY {keys}
),
flagged AS (
  SELECT *, x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) AS inside
  FROM cells JOIN boxes USING ({keys})
),
box AS (
  SELECT {keys}, max(n) AS n, max(q1) AS q1, max(med) AS med, max(q3) AS q3,
         least(max(q1), min(x) FILTER (inside)) AS lo,
         greatest(max(q3), max(x) FILTER (inside)) AS hi,
         count(*) FILTER (NOT inside) AS n_out
  FROM flagged GROUP BY {keys}
)"""


def _cycle(group: str) -> str:
    columns = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""
SELECT {columns}count(*) AS n, round(CAST(sum(cnt_ord) AS DOUBLE) / count(*), 6) AS per_ord,
       quantile_cont(CAST(cnt_ord AS DOUBLE), 0.5) AS med_ord,
       round(avg(period), 6) AS avg_period,
       round(quantile_cont(period, 0.5), 6) AS med_period
FROM (SELECT *, CAST(diff_days AS DOUBLE) / (cnt_ord - 1) AS period FROM lifetime WHERE cnt_ord > 1)
{tail}"""


def _headcount(share: float) -> str:
    return f"""
SELECT round(avg(t), 6) AS avg, quantile_cont(t, 0.5) AS med
FROM (SELECT round_even(n * CAST({share} AS DOUBLE), 0) AS t FROM base)"""


def _band_stats(lo: int, hi: int) -> str:
    return f"""
SELECT round(avg(cnt_order), 6) AS avg_cnt_ord,
       round(avg(CAST(sum_amt AS DOUBLE)), 6) AS avg_sum_amt,
       quantile_cont(CAST(cnt_order AS DOUBLE), 0.5) AS med_cnt_ord,
       round(quantile_cont(CAST(sum_amt AS DOUBLE), 0.5), 6) AS med_sum_amt
FROM ranked WHERE rn > {lo} AND rn < {hi}"""


def _violations(table: str, **types: str) -> str:
    """Rows that break a rule; a type in capitals is required."""
    rules = []
    for column, kind in types.items():
        broken = f"{column} IS NOT NULL AND TRY_CAST({column} AS {kind}) IS NULL"
        rules.append((f"{column} is no {kind.lower()}", broken))
        if kind.isupper():
            rules.append((f"{column} is NULL", f"{column} IS NULL"))
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) FILTER ({broken}) AS violations FROM {table}" for rule, broken in rules
    )


def _sql(*parts: str) -> str:
    *ctes, final = parts
    return "WITH " + ",".join(ctes) + "\n" + final.strip()


def oracle_sql() -> dict[str, str]:
    net = (_TX, _NET)
    life = (*net, _LIFETIME)
    his = (*net, _HIS)
    labelled = (*his, _POLICY, _LABELS)
    mix = (*labelled, _BASE, _COUNTS, _MIX)
    vip = (*labelled, _BASE, _COUNTS, _VIP)
    what_if = (*labelled, _OLD_BASE, _COUNTS)
    ranked = (*labelled, _RANKED)
    curve = (_TX, _CURVE)
    average = "SELECT gb, round(avg(prop), 9) AS avg_prop FROM vip GROUP BY gb"
    compare = """SELECT yyyy, acc_cust_prop, acc_amt_prop, acc_cust_prop AS equal_share
FROM curve WHERE yyyy IN (1997, 1998)"""
    rounded = "round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3, round(lo, 4) AS lo, round(hi, 4) AS hi"
    scaled = ", ".join(f"round(round({c}, 4) / 1000, 7) AS {c}" for c in ("q1", "med", "q3", "lo", "hi"))
    return {
        "net_customer_summary": _sql(*net, _SUMMARY, "SELECT * FROM summary"),
        "customer_lifetime": _sql(*life, "SELECT * FROM lifetime"),
        "repeat_purchase_cycle": _sql(*life, _cycle("")),
        "repeat_purchase_cycle_by_orders": _sql(*life, _cycle("cnt_ord")),
        "repeat_purchase_cycle_by_first_month": _sql(*life, _cycle("fst_buy_ym")),
        "purchase_span_histogram": _sql(
            *life,
            """SELECT CAST(50 * greatest(ceil((diff_days - 25.0) / 50.0), 0) AS INTEGER) AS bin_center,
       cnt_ord, count(*) AS n
FROM lifetime GROUP BY 1, 2""",
        ),
        "amount_box_stats": _sql(
            *net, _SUMMARY, _box("summary", "cnt_order"),
            f"SELECT cnt_order, n, {rounded}, n_out FROM box",
        ),
        "median_amount_by_orders": _sql(
            *net,
            _SUMMARY,
            """SELECT cnt_order, med,
       format('{:,}', CAST(round_even(med / 1000, 0) AS BIGINT)) || '천원' AS label
FROM (SELECT cnt_order, quantile_cont(CAST(sum_amt AS DOUBLE), 0.5) AS med
      FROM summary GROUP BY cnt_order)""",
        ),
        "monthly_box_stats": _sql(
            *his, _box("his", "std_ym, cnt_order", "std_ym <> '2000-01'"),
            f"SELECT std_ym, cnt_order, n, {scaled}, n_out FROM box",
        ),
        "customer_period_summary": _sql(*his, "SELECT * FROM his"),
        "grade_label": _sql(*labelled, "SELECT * FROM labelled"),
        "graded_base": _sql(*labelled, _BASE, "SELECT * FROM base"),
        "grade_mix_ratio": _sql(*mix, "SELECT * FROM shares"),
        "grade_mix_percent": _sql(*mix, _PERCENTS),
        "vip_share_by_month": _sql(*vip, "SELECT * FROM vip"),
        "vip_share_average": _sql(*vip, average),
        "target_headcount": _sql(*labelled, _BASE, _headcount(0.01)),
        "target_headcount_gold": _sql(
            *labelled, _BASE, f"SELECT avg FROM ({_headcount(0.2)})"
        ),
        "rank_band": _sql(
            *ranked, "SELECT * FROM ranked WHERE rn > 21 AND rn < 25 ORDER BY std_ym DESC, rn"
        ),
        "rank_band_gold": _sql(
            *ranked, "SELECT * FROM ranked WHERE rn > 450 AND rn < 490 ORDER BY std_ym, rn"
        ),
        "rank_band_stats": _sql(*ranked, _band_stats(21, 25)),
        "rank_band_stats_gold": _sql(*ranked, _band_stats(460, 490)),
        "pareto_curve": _sql(*curve, "SELECT * FROM curve"),
        "pareto_year": _sql(
            *curve, "SELECT customer_id, acc_cust_prop, acc_amt_prop FROM curve WHERE yyyy = 1997"
        ),
        "pareto_compare": _sql(*curve, compare),
        "pareto_compare_zoom": _sql(
            *curve, compare + " AND acc_cust_prop <= 0.3 AND acc_amt_prop <= 0.5"
        ),
        "grade_policy_whatif": _sql(*what_if, _MIX, "SELECT * FROM shares"),
        "grade_policy_whatif_percent": _sql(*what_if, _MIX, _PERCENTS),
        "grade_policy_whatif_vip": _sql(*what_if, _VIP, "SELECT * FROM vip"),
        "grade_policy_whatif_average": _sql(*what_if, _VIP, average),
        "rank_band_wide": _sql(*ranked, "SELECT * FROM ranked WHERE rn > 100 AND rn < 700 ORDER BY std_ym, rn"),
        "rank_band_stats_wide": _sql(*ranked, _band_stats(100, 700)),
        "load_orders": """SELECT o_orderkey, o_custkey, o_orderstatus,
       CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
FROM orders""",
        "order_violations": _violations(
            "orders", o_orderkey="BIGINT", o_custkey="BIGINT", o_orderstatus="string",
            o_totalprice="DECIMAL(18,2)", o_orderdate="DATE",
        ),
        "lineitem_violations": _violations(
            "lineitem", l_orderkey="BIGINT", l_quantity="TINYINT", l_extendedprice="DECIMAL(7,2)"
        ),
        "load_table": "SELECT * FROM nation",
    }
