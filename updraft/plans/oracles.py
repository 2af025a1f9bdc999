"""The queries of ``workload`` as SQL, to check their results by.

Written independently of the DataFrame plans: positions count upwards from the
oldest bar, streaks and baselines are separate subqueries joined by code.
"""

from __future__ import annotations

from updraft.config import ScreenConfig
from updraft.plans import workload as w

_TRADE_ORDER = (
    "(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity)"
)


def _bars(key: str, period: str, source: str = "lineitem") -> str:
    return f"""
    SELECT CAST({key} AS VARCHAR) AS code, CAST({period} AS DATE) AS date,
           arg_min(l_extendedprice / l_quantity, {_TRADE_ORDER}) AS open,
           arg_max(l_extendedprice / l_quantity, {_TRADE_ORDER}) AS close,
           CAST(sum(l_quantity) AS BIGINT) AS volume
    FROM {source} GROUP BY ALL"""


PART_MONTH = _bars("l_partkey", "date_trunc('month', l_shipdate)")
SUPPLIER_WEEK = _bars("l_suppkey", "date_trunc('week', l_shipdate)")
BRAND_DAY = _bars("p_brand", "l_shipdate", "lineitem JOIN part ON l_partkey = p_partkey")

PART_UNIVERSE = """
    SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name,
           CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'スタンダード'
                WHEN p_type IN ('PROMO', 'LARGE') THEN 'プライム'
                WHEN p_type = 'SMALL' THEN 'グロース' END AS market
    FROM part"""

# CTEs shared by the screens: numbered bars, and per code the position of the
# last bar that was not up.
_POSITIONS = """
  numbered AS (
    SELECT *, row_number() OVER by_date AS pos, lag(close) OVER by_date AS before
    FROM bars WINDOW by_date AS (PARTITION BY code ORDER BY date)),
  marked AS (SELECT *, coalesce(close > before AND close > open, false) AS up FROM numbered),
  anchor AS (
    SELECT code, max(pos) AS newest, max(pos) FILTER (WHERE NOT up) AS stop
    FROM marked GROUP BY code)"""


def _measure(cfg: ScreenConfig, of: str = "") -> str:
    return f"{of}close * {of}volume" if cfg.metric == "turnover" else f"{of}volume"


def _mults(cfg: ScreenConfig) -> tuple[float, float]:
    if cfg.metric == "turnover":
        return cfg.turnover_vol_mult, cfg.turnover_vol_mult_short
    return cfg.vol_mult, cfg.vol_mult_short


def _captions(cfg: ScreenConfig) -> str:
    top, short = _mults(cfg)
    return f"""SELECT count(*) AS hits,
    'tier1 ｜ {cfg.streak_top}日以上 × {top}' AS tier1_caption,
    'tier2 ｜ {cfg.streak_min}日~ × {short}' AS tier2_caption,
    CASE WHEN count(*) > 0 THEN ''
      ELSE '条件に合致する銘柄はありませんでした。つまみを緩めて再検索してください。' END AS message
    FROM published"""


def _metrics_ctes(cfg: ScreenConfig) -> str:
    m = _measure(cfg)
    return f"""{_POSITIONS},
  rising AS (
    SELECT code, avg({m}) AS avg_m, min({m}) AS min_m
    FROM marked JOIN anchor USING (code) WHERE pos > stop GROUP BY code),
  quiet AS (
    SELECT code, median({m}) AS base_med, median(volume) AS base_vol_med,
           median(close * volume) AS base_turnover
    FROM marked JOIN anchor USING (code)
    WHERE pos > stop - {cfg.base_window} AND pos <= stop GROUP BY code),
  metrics AS (
    SELECT a.code, a.newest - a.stop AS streak_len, avg_m, min_m, base_med, base_vol_med,
           base_turnover, l.date AS last_date, l.close AS last_close, p.close AS pre_close
    FROM anchor a JOIN rising USING (code) JOIN quiet USING (code)
    JOIN marked l ON l.code = a.code AND l.pos = a.newest
    JOIN marked p ON p.code = a.code AND p.pos = a.stop
    WHERE a.newest - a.stop >= {cfg.streak_min})"""


def _ranked(cfg: ScreenConfig, metrics: str = "metrics", by: str = "") -> str:
    """SELECT ranking the hits among ``metrics``, within ``by`` if given."""
    high, low = _mults(cfg)
    stat = "min_m" if cfg.vol_mode == "all" else "avg_m"
    limits = ""
    if cfg.min_volume > 0:
        limits += f" AND base_vol_med > {cfg.min_volume}"
    if cfg.min_turnover > 0:
        limits += f" AND base_turnover > {cfg.min_turnover}"
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    return f"""
    SELECT {lead}row_number() OVER ({part}ORDER BY tier, points DESC, rise_pct DESC,
             min_ratio DESC, code) AS rank,
           code, streak_len, tier, last_date, last_close, rise_pct,
           CAST(avg_m AS BIGINT) AS avg_vol3, CAST(min_m AS BIGINT) AS min_vol3,
           CAST(base_med AS BIGINT) AS base_med, avg_ratio, min_ratio,
           round(points, 3) AS score
    FROM (
      SELECT *, {cfg.w_vol} * percent_rank() OVER ({part}ORDER BY min_ratio)
              + {cfg.w_rise} * percent_rank() OVER ({part}ORDER BY rise_pct) AS points
      FROM (
        SELECT *, round((last_close - pre_close) / pre_close * 100, 2) AS rise_pct,
               round(avg_m / base_med, 2) AS avg_ratio,
               round(min_m / base_med, 2) AS min_ratio,
               CASE WHEN streak_len < {cfg.streak_top} THEN 2 ELSE 1 END AS tier
        FROM {metrics}
        WHERE base_med > 0 AND pre_close > 0{limits}
          AND {stat} >= base_med
              * CASE WHEN streak_len < {cfg.streak_top} THEN {low} ELSE {high} END))"""


def screen_sql(bars: str, cfg: ScreenConfig, before: str = "", after: str = "") -> str:
    """The whole screen; ``after`` replaces the final SELECT over ``hits``."""
    return f"""WITH {before}bars AS ({bars}), {_metrics_ctes(cfg)},
  hits AS ({_ranked(cfg)})
  {after or "SELECT * FROM hits"}"""


def _published(cfg: ScreenConfig, after: str, bars: str = PART_MONTH) -> str:
    return screen_sql(
        bars, cfg, before=f"universe AS ({PART_UNIVERSE}), ",
        after=f""", published AS (
    SELECT rank, code, coalesce(name, code) AS name, coalesce(market, '') AS market, streak_len,
           tier, last_date, last_close, rise_pct, avg_vol3, min_vol3, base_med, avg_ratio,
           min_ratio, score
    FROM hits LEFT JOIN universe USING (code)) {after}""",
    )


def _number(value: str, turnover: bool) -> str:
    if turnover:
        return f"format('{{:,.1f}}', {value} / 1e6)"
    return f"format('{{:,}}', {value})"


def _report(cfg: ScreenConfig) -> str:
    turnover = cfg.metric == "turnover"
    label, unit = ("売買代金", "百万円") if turnover else ("出来高", "株")
    avg, low, base = (_number(c, turnover) for c in ("avg_vol3", "min_vol3", "base_med"))

    def market(otherwise: str) -> str:
        return f"""CASE market WHEN 'プライム' THEN 'prime' WHEN 'スタンダード' THEN 'standard'
                     WHEN 'グロース' THEN 'growth' ELSE '{otherwise}' END"""

    return _published(cfg, f"""
  SELECT rank, CASE WHEN rank > 3 THEN 'other' ELSE CAST(rank AS VARCHAR) END AS badge,
         code, name, market, {market('')} AS market_class, {market('growth')} AS market_chip,
         streak_len || '日連騰' AS streak,
         CASE tier WHEN 1 THEN 'top' ELSE 'short' END AS streak_class,
         format('{{:,.0f}}', last_close) AS close,
         '▲ ' || printf('%.2f', rise_pct) || '%' AS rise,
         {avg} AS streak_avg, {low} AS streak_min, {base} AS base,
         printf('%.2f', avg_ratio) || 'x' AS avg_times,
         printf('%.2f', min_ratio) || 'x' AS min_times,
         printf('%.3f', score) AS score,
         CASE WHEN score < 0.5 THEN 'low' WHEN score < 0.8 THEN 'mid' ELSE 'high' END
           AS score_band,
         printf('%.0f', score * 100) || '%' AS score_width,
         '連騰中の平均{label} ' || {avg} || '{unit} / 最小 ' || {low} || '{unit} / 基準中央値 '
           || {base} || '{unit}' AS tip
  FROM published""")


_NOTIFY = """
  SELECT rank,
         CASE rank WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '🔹' END
           || ' ' || rank || '位 ' || code || ' ' || name || ' (' || market || ')' AS title,
         CASE tier WHEN 1 THEN '🔥' ELSE '✨' END || ' ' || streak_len || '日連騰' || chr(10)
           || '📈 上昇率: **+' || printf('%.2f', rise_pct) || '%**' || chr(10)
           || '📊 出来高: **' || printf('%.1f', avg_ratio) || '倍** (平均)' AS body
  FROM published WHERE rank <= 20"""

_PAYLOAD = f""", notice AS ({_NOTIFY})
  SELECT '{{"embeds":[{{"title":"📈 連騰・出来高ランキング (上位20銘柄)","description":'
           || '"**抽出日時**: 2001-11-12 22:00\\n**該当銘柄数**: '
           || (SELECT count(*) FROM published) || ' 件","fields":['
           || string_agg('{{"name":"' || title || '","value":"' || replace(body, chr(10), '\\n')
                         || '","inline":false}}', ',' ORDER BY rank)
           || ']}}]}}' AS payload
  FROM notice"""

# Sweep: every bar's own streak start is the latest earlier bar that was not up.
_SWEEP_STARTS = """
  numbered AS (
    SELECT *, row_number() OVER by_date AS pos, lag(close) OVER by_date AS before,
           lead(date) OVER by_date AS next_date
    FROM bars WINDOW by_date AS (PARTITION BY code ORDER BY date)),
  marked AS (SELECT *, coalesce(close > before AND close > open, false) AS up FROM numbered),
  started AS (
    SELECT *, max(pos) FILTER (WHERE NOT up) OVER (PARTITION BY code ORDER BY pos) AS stop
    FROM marked)"""


def _sweep_ctes(cfg: ScreenConfig) -> str:
    m = _measure(cfg, "s.")
    return f"""{_SWEEP_STARTS},
  ends AS (SELECT * FROM started WHERE up AND pos - stop >= {cfg.streak_min}),
  rising AS (
    SELECT e.code, e.pos, avg({m}) AS avg_m,
           min({m}) AS min_m
    FROM ends e JOIN started s ON s.code = e.code AND s.pos > e.stop AND s.pos <= e.pos
    GROUP BY ALL),
  quiet AS (
    SELECT e.code, e.stop, median({m}) AS base_med,
           median(s.volume) AS base_vol_med, median(s.close * s.volume) AS base_turnover
    FROM (SELECT DISTINCT code, stop FROM ends) e
    JOIN started s ON s.code = e.code AND s.pos <= e.stop AND s.pos > e.stop - {cfg.base_window}
    GROUP BY ALL),
  metrics AS (
    SELECT e.code, e.pos - e.stop AS streak_len, avg_m, min_m, base_med, base_vol_med,
           base_turnover, e.date AS last_date, e.close AS last_close, p.close AS pre_close,
           e.next_date
    FROM ends e JOIN rising r ON r.code = e.code AND r.pos = e.pos
    JOIN quiet q ON q.code = e.code AND q.stop = e.stop
    JOIN started p ON p.code = e.code AND p.pos = e.stop)"""


def _sweep(bars: str, cfg: ScreenConfig) -> str:
    return f"""WITH bars AS ({bars}), {_sweep_ctes(cfg)},
  dated AS (SELECT *, last_date AS as_of FROM metrics)
  {_ranked(cfg, 'dated', 'as_of')}"""


def _sweep_carried(bars: str, cfg: ScreenConfig) -> str:
    return f"""WITH bars AS ({bars}), {_sweep_ctes(cfg)},
  dates AS (SELECT DISTINCT date AS as_of FROM bars),
  dated AS (
    SELECT m.*, as_of FROM metrics m
    JOIN dates ON as_of >= last_date AND (next_date IS NULL OR as_of < next_date))
  {_ranked(cfg, 'dated', 'as_of')}"""


def _grid() -> str:
    parts = [
        f"SELECT '{name}' AS config, * FROM ({screen_sql(PART_MONTH, cfg)})"
        for name, cfg in w.GRID.items()
    ]
    return " UNION ALL ".join(parts)


_QUOTES = """
    SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date,
           l_extendedprice / l_quantity AS open,
           l_extendedprice / l_quantity * (1 - l_discount) AS close,
           CAST(l_quantity AS BIGINT) AS volume, l_linestatus,
           l_orderkey * 10 + l_linenumber AS seq
    FROM lineitem"""


def _newest_quotes(first: str, where: str = "true") -> str:
    return f"""
    SELECT code, date, open, close, volume
    FROM (SELECT *, row_number() OVER (PARTITION BY code, date
            ORDER BY {first}seq DESC, open DESC, close DESC, volume DESC) AS n
          FROM ({_QUOTES}) WHERE {where})
    WHERE n = 1"""


_REPORTS = """
    SELECT CAST(row_number() OVER (PARTITION BY report_date ORDER BY confidence DESC, theme)
             AS INTEGER) AS rank, theme,
           CASE WHEN n >= 75 THEN '初動' WHEN n >= 66 THEN '監視中' WHEN n < 58 THEN '失速' END
             AS status,
           CASE WHEN top > 30000 THEN '再点火' END AS ignition,
           CASE WHEN confidence > 5 THEN 'S2 継続' WHEN confidence > 0 THEN 'S1 点火' END AS stage,
           confidence, users AS participants, n AS eligible_members,
           users / n AS participation_rate, top / total AS concentration,
           confidence / 8 AS turnover_anomaly, (top - 25000) / 7000 AS mkt_rel_z,
           (users - 50) / 16 AS breadth_z,
           CASE WHEN users >= 55 THEN true WHEN users < 48 THEN false END AS floor_pass,
           CASE WHEN n < 60 THEN true END AS small_universe,
           CASE WHEN n >= 60 THEN 'max ' || top END AS top_contributors,
           CASE WHEN n >= 70 THEN report_date END AS registered_since, report_date
    FROM (SELECT *, total / n / 100 - 50 AS confidence FROM (
      SELECT strftime(ts, '%Y-%m-%d') AS report_date, event_type AS theme, count(*) AS n,
             count(DISTINCT user_id) AS users,
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total,
             max(CAST(round(value * 100) AS BIGINT)) AS top
      FROM events GROUP BY ALL))"""

# Reports through files, where those of even days know no registrations.
_FILED = f"""
    SELECT * REPLACE (CASE WHEN CAST(substr(report_date, 10) AS INTEGER) % 2 = 1
                           THEN registered_since END AS registered_since)
    FROM ({_REPORTS})"""

_LATEST_REPORT = (
    f"(SELECT * FROM ({_REPORTS}) QUALIFY report_date = max(report_date) OVER ())"
)

_HOLIDAY_LIST = ", ".join(f"DATE '{d}'" for d in w.HOLIDAYS)


def _open_day(now: str) -> str:
    """Newest open day at ``now``: the latest among the fortnight before it."""
    return f"""(
      SELECT max(d) FROM (SELECT unnest(range(1, 20)) AS back) AS t,
        LATERAL (SELECT CAST({now} AS DATE) + 1 - CAST(back AS INTEGER) AS d) AS c
      WHERE isodow(d) <= 5 AND d NOT IN ({_HOLIDAY_LIST})
        AND (d < CAST({now} AS DATE) OR hour({now}) >= 21))"""


def _weekday_target(now: str) -> str:
    base = f"(CAST({now} AS DATE) - CASE WHEN hour({now}) < 21 THEN 1 ELSE 0 END)"
    return f"""CASE isodow({base}) WHEN 6 THEN {base} - 1 WHEN 7 THEN {base} - 2 ELSE {base} END"""


# Every open day from a supplier's first bar on, and whether the supplier has a bar on it.
_BAR_DAYS = f"""
    WITH shipped AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS d FROM lineitem),
    open_days AS (
      SELECT d, row_number() OVER (ORDER BY d) AS n FROM (
        SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM shipped)
      WHERE isodow(d) <= 5 AND d NOT IN ({", ".join(f"DATE '{d}'" for d in w.BAR_HOLIDAYS)})),
    due AS (
      SELECT f.code, o.d, o.n, EXISTS (SELECT 1 FROM shipped s WHERE s.code = f.code AND s.d = o.d) AS held
      FROM (SELECT code, min(d) AS first FROM shipped JOIN open_days USING (d) GROUP BY code) f JOIN open_days o ON o.d >= f.first)"""

_UNIVERSE = """
    SELECT CAST(o_custkey AS VARCHAR) AS code, arg_max(o_orderpriority, o_orderkey) AS name,
           arg_max(o_orderstatus, o_orderkey) AS market
    FROM orders GROUP BY o_custkey"""

_LISTING = """
    SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, n_name AS market
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA')"""

_DATED = """
  SELECT *, 'volume' AS metric, (SELECT max(date) FROM bars) AS data_date FROM published"""

_HITS_NAMED = f"universe AS ({PART_UNIVERSE} WHERE p_type <> 'ECONOMY'), "

ORACLES: dict[str, str] = {
    "bars_part_month": PART_MONTH,
    "bars_supplier_week": SUPPLIER_WEEK,
    "streak_length": f"""WITH bars AS ({PART_MONTH}), {_POSITIONS}
  SELECT code, newest - stop AS streak_len FROM anchor""",
    "streak_metrics": f"""WITH bars AS ({PART_MONTH}), {_metrics_ctes(w.LOOSE)}
  SELECT * FROM metrics""",
    "screen_volume_all": screen_sql(PART_MONTH, w.LOOSE),
    "screen_volume_avg": screen_sql(SUPPLIER_WEEK, w.LOOSE_AVG),
    "screen_turnover_all": screen_sql(PART_MONTH, w.TURNOVER),
    "screen_turnover_avg": screen_sql(SUPPLIER_WEEK, w.TURNOVER_AVG),
    "screen_two_tier": screen_sql(PART_MONTH, w.TWO_TIER),
    "screen_liquidity": screen_sql(PART_MONTH, w.LIQUID),
    "screen_sliced_ranks": screen_sql(PART_MONTH, w.LOOSE),
    "screen_recent_first": screen_sql(PART_MONTH, w.LOOSE),
    "screen_published": _published(w.LOOSE, "SELECT * FROM published"),
    "lookup_missing": screen_sql(
        PART_MONTH, w.LOOSE, before=_HITS_NAMED,
        after="""SELECT code, rank, coalesce(name, code) AS name_or_code, name,
    coalesce(market, '') AS market FROM hits LEFT JOIN universe USING (code)""",
    ),
    "data_period": f"""SELECT min(date) AS "from", max(date) AS "to",
    count(DISTINCT code) AS codes FROM ({PART_MONTH})""",
    "row_count": f"SELECT count(*) AS rows FROM ({PART_MONTH})",
    "tier_counts": screen_sql(
        PART_MONTH, w.LOOSE,
        after="SELECT t.tier, count(code) AS hits FROM (VALUES (1), (2)) t(tier) "
        "LEFT JOIN hits USING (tier) GROUP BY t.tier",
    ),
    "view_search": _published(
        w.LOOSE,
        "SELECT * FROM published WHERE regexp_matches(code, 'ge|^1.*7$') "
        "OR regexp_matches(lower(name), 'ge|^1.*7$')",
    ),
    "view_sort_rise": _published(w.LOOSE, "SELECT * FROM published ORDER BY rise_pct DESC, rank"),
    "report_rows": _report(w.LOOSE),
    "report_rows_turnover": _report(w.TURNOVER),
    "report_header": screen_sql(
        PART_MONTH, w.LOOSE,
        after="""SELECT count(*) AS hits, count(*) FILTER (tier = 1) AS tier1,
    count(*) FILTER (tier = 2) AS tier2,
    coalesce(strftime(arg_min(last_date, rank), '%Y-%m-%d'), 'N/A') AS base_date,
    (SELECT min(date) FROM bars) AS "from", (SELECT max(date) FROM bars) AS "to",
    (SELECT count(DISTINCT code) FROM bars) AS codes, '出来高 ｜ all' AS mode,
    CASE WHEN count(*) = 0 THEN '該当する銘柄はありませんでした' ELSE '' END AS message,
    (SELECT '最新データは ' || strftime(max(date), '%Y-%m-%d')
       || ' 時点です(本日 2001-11-12 分は未反映の可能性)。'
       || 'ランキングはこの基準日のデータで算出しています。' FROM bars) AS stale_note
    FROM hits""",
    ),
    "report_captions": _published(w.LOOSE, _captions(w.LOOSE)),
    "report_captions_no_hits": _published(w.NO_HITS, _captions(w.NO_HITS)),
    "results_csv": _published(w.LOOSE, "SELECT * FROM published"),
    "notify_top20": _published(w.LOOSE, _NOTIFY),
    "notify_payload": _published(w.LOOSE, _PAYLOAD),
    "notify_no_hits": _published(
        w.NO_HITS,
        """SELECT '{"content":"**📈 連騰・出来高スクリーニング (2001-11-12 22:00)**'
      || '\\n今回は条件に合致する銘柄はありませんでした。"}' AS payload
    FROM (SELECT count(*) AS n FROM published) WHERE n = 0""",
    ),
    "results_history": " UNION ALL ".join(
        f"SELECT * FROM ({_published(w.LOOSE, _DATED, bars)})"
        for bars in (f"SELECT * FROM ({PART_MONTH}) WHERE date < DATE '{w.CORRECTED}'", PART_MONTH)
    ),
    "screen_reused": _published(w.LOOSE, "SELECT * FROM published"),
    "nightly_published": _published(w.LOOSE, "SELECT * FROM published"),
    "universe_normalize": _UNIVERSE,
    "universe_csv": _UNIVERSE,
    "listing_normalize": _LISTING,
    "listing_csv": _LISTING,
    "wide_to_long": BRAND_DAY,
    "ingest_guard": """
    SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date,
           l_extendedprice / l_quantity AS open,
           l_extendedprice / l_quantity * (1 - l_discount) AS close,
           CAST(trunc(l_quantity * (1 + l_tax)) AS BIGINT) AS volume
    FROM lineitem WHERE l_returnflag <> 'R' AND l_shipdate < DATE '1998-06-15'""",
    "upsert_latest": _newest_quotes("l_linestatus DESC, "),
    "upsert_touched": """
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, count(*) AS rows
    FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""",
    "stream_upsert": _newest_quotes("", "date < DATE '1998-06-15'"),
    "adjusted_bars": f"""
    SELECT code, date, open * basis AS open,
           close * basis * CASE WHEN CAST(code AS BIGINT) % 10 = 7 AND volume % 2 = 0 AND date >= DATE '{w.LOADS[-1][1]}' THEN 1.25 ELSE 1 END AS close,
           CAST(volume / basis AS BIGINT) AS volume
    FROM (SELECT *, {" * ".join(f"CASE WHEN CAST(code AS BIGINT) % {n} = 0 THEN {part} ELSE 1.0 END" for n, part in w.SPLITS.values())} AS basis
          FROM ({SUPPLIER_WEEK}))""",
    "screen_delta": screen_sql(PART_MONTH, w.LOOSE),
    "stream_late_bars": f"""
    WITH timed AS (
      SELECT *, CAST(ts AS DATE) - (SELECT CAST(min(ts) AS DATE) FROM events) AS day FROM events),
    judged AS (SELECT *, event_id % {w.LATE_EVERY} = 0 AND day < {w.PART_DAYS} AS late FROM timed)
    SELECT event_type AS code, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open,
           arg_max(value, (ts, event_id)) AS close, count(*) AS volume, (SELECT count(*) FROM judged WHERE late) AS late_rows
    FROM judged WHERE NOT late GROUP BY ALL""",
    "bar_gaps": _BAR_DAYS + """
    , missing AS (
      SELECT code, d, n - row_number() OVER (PARTITION BY code ORDER BY d) AS island FROM due WHERE NOT held)
    SELECT code, min(d) AS gap_from, max(d) AS gap_to, count(*) AS missing, max(d) = (SELECT max(d) FROM open_days) AS trailing
    FROM missing GROUP BY code, island""",
    "bar_runs": _BAR_DAYS + """
    , present AS (
      SELECT code, d, n - row_number() OVER (PARTITION BY code ORDER BY d) AS island FROM due WHERE held)
    SELECT code, min(d) AS run_from, max(d) AS run_to, count(*) AS bars FROM present GROUP BY code, island""",
    "asof_bars": f"""
    WITH bars AS (SELECT * FROM ({SUPPLIER_WEEK}) WHERE volume % 3 = 0),
    lines AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS shipped FROM lineitem)
    SELECT l.*, b.date, b.close, b.volume FROM lines l ASOF LEFT JOIN bars b ON l.code = b.code AND l.shipped >= b.date""",
    "notify_ledger": """
    SELECT DISTINCT l_returnflag AS metric, CAST(l_shipdate AS DATE) AS data_date
    FROM lineitem l
    WHERE l_shipdate <> (SELECT max(l_shipdate) FROM lineitem s
      WHERE s.l_linestatus = 'F' AND s.l_returnflag = l.l_returnflag)""",
    "notify_intents": """
    WITH asked AS (SELECT DISTINCT l_returnflag AS metric, CAST(l_shipdate AS DATE) AS data_date FROM lineitem)
    SELECT *, 'third' AS attempt FROM asked
    WHERE metric <> 'N' AND (metric <> 'A' OR data_date <> (SELECT max(data_date) FROM asked WHERE metric = 'A'))
    UNION ALL SELECT *, unnest(['doubted', 'fourth']) FROM asked WHERE metric = 'N'""",
    "codes_by_range": f"""
    WITH bars AS (SELECT DISTINCT l_partkey, CAST(l_shipdate AS DATE) AS date FROM lineitem),
    ranges(since, before) AS (VALUES {", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in w.RANGES)})
    SELECT since, before, min(date) AS "from", max(date) AS "to", count(date) AS rows,
           count(DISTINCT l_partkey) AS codes, true AS within_bound
    FROM ranges LEFT JOIN bars ON date >= since AND date < before GROUP BY since, before""",
    "sketched_ranks": f"""
    SELECT code, date, volume, percent_rank() OVER (PARTITION BY date ORDER BY volume) AS volume_rank,
           true AS within_bound FROM ({PART_MONTH})""",
    "fetch_plan": f"""
    SELECT latest, DATE '2001-11-12' - (latest - 5) >= 180 AS "full",
           CASE WHEN DATE '2001-11-12' - (latest - 5) < 180 THEN latest - 5 END AS "start",
           CASE WHEN DATE '2001-11-12' - (latest - 5) < 180 THEN latest - 5
                ELSE DATE '2001-05-12' END AS read_from
    FROM (SELECT max(date) AS latest FROM ({SUPPLIER_WEEK}))""",
    "fetch_plan_by_code": f"""
    SELECT code, latest, DATE '2001-11-12' - (latest - 5) >= 180 AS "full",
           CASE WHEN DATE '2001-11-12' - (latest - 5) < 180 THEN latest - 5 END AS "start",
           CASE WHEN DATE '2001-11-12' - (latest - 5) < 180 THEN latest - 5
                ELSE DATE '2001-05-12' END AS read_from
    FROM (SELECT code, max(date) AS latest FROM ({PART_MONTH}) GROUP BY code)""",
    "planned_quotes": f"""
    SELECT code, date, close FROM ({PART_MONTH})
    JOIN (SELECT code, CASE WHEN DATE '1998-02-10' - (max(date) - 5) < 180 THEN max(date) - 5
                            ELSE DATE '1997-08-10' END AS read_from
          FROM ({PART_MONTH}) WHERE date < DATE '1998-02-01' GROUP BY code) USING (code)
    WHERE date >= read_from
    UNION ALL
    SELECT code, date, close FROM ({PART_MONTH})
    WHERE date >= DATE '1997-08-10'
      AND code NOT IN (SELECT code FROM ({PART_MONTH}) WHERE date < DATE '1998-02-01')""",
    "latest_trading_day": f"""
    SELECT event_id, {_weekday_target('ts')} AS weekday_target,
           {_open_day('ts')} AS target_day
    FROM events""",
    "trading_calendar": f"""
    WITH days AS (
      SELECT CAST(d AS DATE) AS day,
             isodow(d) <= 5 AND CAST(d AS DATE) NOT IN ({_HOLIDAY_LIST}) AS is_open
      FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE) - 7, CAST(max(ts) AS DATE),
              INTERVAL 1 DAY)) AS d FROM events))
    SELECT day, is_open,
           (SELECT max(b.day) FROM days b WHERE b.is_open AND b.day <= a.day) AS last_open_day,
           (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = a.day) AS events
    FROM days a""",
    "data_freshness": f"""
    SELECT max(date) AS latest, DATE '2001-11-12' AS target_day,
           max(date) >= DATE '2001-11-12' AS is_fresh
    FROM ({SUPPLIER_WEEK})""",
    "freshness_by_code": f"""
    SELECT code, max(date) AS latest, DATE '2001-10-22' AS target_day,
           max(date) >= DATE '2001-10-22' AS is_fresh
    FROM ({SUPPLIER_WEEK}) GROUP BY code""",
    "stale_flags": f"""
    SELECT code, latest, latest <> DATE '2001-10-01' AS is_stale,
           latest = DATE '2001-10-01' AS is_current,
           CASE WHEN latest = DATE '2001-10-01' THEN '' ELSE
             '最新データは ' || strftime(latest, '%Y-%m-%d')
             || ' 時点です(本日 2001-10-01 分は未反映の可能性)。'
             || 'ランキングはこの基準日のデータで算出しています。' END AS stale_note
    FROM (SELECT code, max(date) AS latest FROM ({PART_MONTH}) GROUP BY code)""",
    "theme_dates": "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS report_date FROM events",
    "theme_history": f"""
    SELECT report_date AS date, theme, confidence FROM ({_REPORTS})""",
    "theme_days": "SELECT count(DISTINCT CAST(ts AS DATE)) AS days FROM events",
    "theme_names": "SELECT DISTINCT event_type AS theme FROM events",
    "theme_cards": f"""
    SELECT report_date,
           count(*) FILTER (ignition IS NOT NULL OR coalesce(status, '') = '初動') AS ignitions,
           count(*) FILTER (stage LIKE '%S2%') AS stage2,
           count(*) FILTER (status = '失速') AS stalled,
           count(*) FILTER (floor_pass) AS floor_passes, count(*) AS themes
    FROM ({_REPORTS}) GROUP BY report_date""",
    "theme_filter": f"""
    SELECT report_date, theme, status, floor_pass FROM ({_REPORTS})
    WHERE status = '監視中' AND floor_pass""",
    "theme_scaled": f"""
    SELECT theme, (confidence - min(confidence) OVER ())
      / (max(confidence) OVER () - min(confidence) OVER ()) * 100 AS width
    FROM {_LATEST_REPORT}""",
    "theme_labels": f"""
    SELECT report_date, rank,
           CASE WHEN rank > 3 THEN 'other' ELSE CAST(rank AS VARCHAR) END AS badge, theme,
           CASE WHEN small_universe THEN '⚠小母数' ELSE '' END AS warning,
           CASE WHEN ignition <> '' THEN '⚡ ' || ignition WHEN status = '初動' THEN '⚡ 初動'
                ELSE coalesce(status, '圏外') END AS status,
           coalesce(stage, '—') AS stage,
           CASE substr(stage, 1, 2) WHEN 'S1' THEN 's1' WHEN 'S2' THEN 's2' ELSE 'none' END
             AS stage_class,
           printf('%.0f', (confidence - lo) / (hi - lo) * 100) || '%' AS width,
           confidence < 0 AS negative, printf('%+.2f', confidence) AS confidence,
           participants || '/' || eligible_members || '社' AS participation,
           printf('%+.2f', turnover_anomaly) AS turnover_anomaly,
           printf('%+.2f', mkt_rel_z) AS mkt_rel_z, printf('%+.2f', breadth_z) AS breadth_z,
           CASE WHEN floor_pass THEN '✓' ELSE '—' END AS floor,
           coalesce(top_contributors, '') AS contributors,
           '参加率 ' || printf('%.1f', participation_rate * 100) || '% / 集中度 '
             || printf('%.2f', concentration) || ' / 初動登録 ' || coalesce(registered_since, '—')
             || ' / 直近点火 —' AS tip
    FROM (SELECT *, min(confidence) OVER one AS lo, max(confidence) OVER one AS hi
          FROM ({_REPORTS}) WINDOW one AS (PARTITION BY report_date))""",
    "theme_top5": f"SELECT rank, theme FROM {_LATEST_REPORT} WHERE rank <= 5",
    "theme_pivot": f"""
    SELECT report_date AS date,
           avg(confidence) FILTER (theme = 'click') AS click,
           avg(confidence) FILTER (theme = 'error') AS error,
           avg(confidence) FILTER (theme = 'purchase') AS purchase,
           avg(confidence) FILTER (theme = 'signup') AS signup,
           avg(confidence) FILTER (theme = 'view') AS view
    FROM ({_REPORTS}) GROUP BY report_date""",
    "theme_files_dates": "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS report_date FROM events",
    "theme_files_report": _FILED,
    "theme_files_stored": _FILED,
    "theme_files_history": f"SELECT report_date AS date, theme, confidence FROM ({_REPORTS})",
    "theme_malformed": f"""
    SELECT report_date, 'participants' AS "column", count(*) AS cells, min('about ' || eligible_members) AS example
    FROM ({_REPORTS}) WHERE rank % 2 = 0 GROUP BY report_date
    UNION ALL SELECT report_date, 'floor_pass', count(*), 'perhaps' FROM ({_REPORTS}) WHERE rank % 3 = 0 GROUP BY report_date""",
    "theme_page_notes": f"""
    SELECT report_date, themes, shown,
           CASE WHEN report_date < '2024-01-31' THEN '最新レポートは ' || report_date
             || ' 時点です(直近営業日 2024-01-31 分は未生成)。夜間ジョブ実行後に更新されます。'
             ELSE '' END AS stale_note,
           CASE WHEN shown <> themes THEN '絞り込み: ' || shown || ' / ' || themes || ' テーマ'
             ELSE '' END AS shown_note,
           CASE WHEN shown = 0 THEN '条件に一致するテーマはありません。' ELSE '' END AS message,
           'theme_flow_' || report_date || '.csv' AS file_name
    FROM (SELECT max(report_date) AS report_date, count(*) AS themes,
                 count(*) FILTER (floor_pass) AS shown FROM {_LATEST_REPORT})""",
    "theme_stale": """
    SELECT strftime(max(ts), '%Y-%m-%d') AS newest, DATE '2024-01-31' AS target_day,
           strftime(max(ts), '%Y-%m-%d') < '2024-01-31' AS is_stale
    FROM events""",
    "sweep_metrics": f"""WITH bars AS ({PART_MONTH}), {_sweep_ctes(w.LOOSE)}
  SELECT * EXCLUDE (next_date) FROM metrics""",
    "sweep_screen": _sweep(PART_MONTH, w.TWO_TIER),
    "sweep_screen_turnover": _sweep(SUPPLIER_WEEK, w.TURNOVER_AVG),
    "sweep_carry_forward": _sweep_carried(SUPPLIER_WEEK, w.LOOSE),
    "config_grid": _grid(),
}
