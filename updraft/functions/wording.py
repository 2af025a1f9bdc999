"""The texts users see. Results are compared as text, so these
must stay as they are."""

# Metrics: label and unit
VOLUME_LABEL, VOLUME_UNIT = "出来高", "株"
TURNOVER_LABEL, TURNOVER_UNIT = "売買代金", "百万円"

# Market segments and the classes they map to
MARKET_CLASSES = {"プライム": "prime", "スタンダード": "standard", "グロース": "growth"}
DOMESTIC_SHARES = "内国株式"

# Hits
STREAK_SUFFIX = "日連騰"
RISE_MARK = "▲ "
MEDALS = {1: "🥇", 2: "🥈", 3: "🥉"}
NO_MEDAL = "🔹"
TIER_MARKS = {1: "🔥", 2: "✨"}
TIP_AVERAGE, TIP_LOWEST, TIP_BASE = "連騰中の平均", " / 最小 ", " / 基準中央値 "
NO_HITS = "該当する銘柄はありませんでした"
NO_HITS_PAGE = "条件に合致する銘柄はありませんでした。つまみを緩めて再検索してください。"
TIER1_CAPTION, TIER2_CAPTION = "tier1 ｜ {days}日以上 × {mult}", "tier2 ｜ {days}日~ × {mult}"

MODE = "{label} ｜ {vol_mode}"

# View orders: label to (column, ascending)
VIEW_ORDERS = {
    "総合順位": ("rank", True),
    "上昇率が高い順": ("rise_pct", False),
    "最小倍率が高い順": ("min_ratio", False),
    "平均倍率が高い順": ("avg_ratio", False),
    "連騰日数が長い順": ("streak_len", False),
}

# Stale data: {latest} and {today} are ISO dates
STALE_NOTE = (
    "最新データは {latest} 時点です(本日 {today} 分は未反映の可能性)。"
    "ランキングはこの基準日のデータで算出しています。"
)

# Notification
RANK_SUFFIX = "位"
NOTICE_TITLE = "📈 連騰・{label}ランキング (上位{top}銘柄)"
NOTICE_TIME = "**抽出日時**: {run_time}{note}"
NOTICE_COUNT, NOTICE_COUNT_UNIT = "**該当銘柄数**: ", " 件"
NOTICE_RISE, NOTICE_RISE_END = "📈 上昇率: **+", "%**"
NOTICE_RATIO, NOTICE_RATIO_END = "📊 {label}: **", "倍** (平均)"
NOTICE_NO_HITS_TITLE = "**📈 連騰・出来高スクリーニング ({run_time})**{note}"
NOTICE_NO_HITS = "今回は条件に合致する銘柄はありませんでした。"
NOTE_LINE = "\n⚠️ {note}"

# Themes: {latest} and {due} are ISO dates
STALE_REPORT_NOTE = (
    "最新レポートは {latest} 時点です(直近営業日 {due} 分は未生成)。"
    "夜間ジョブ実行後に更新されます。"
)
SHOWN_THEMES, SHOWN_OF, THEME_UNIT = "絞り込み: ", " / ", " テーマ"
NO_THEMES = "条件に一致するテーマはありません。"
REPORT_FILE = "theme_flow_{date}.csv"
ALL_STATUSES = "すべて"
IGNITED, WATCHED, STALLED, OUT_OF_RANGE = "初動", "監視中", "失速", "圏外"
IGNITION_MARK = "⚡ "
STAGE_CLASSES = {"S1": "s1", "S2": "s2"}
NONE_MARK, PASS_MARK = "—", "✓"
SMALL_UNIVERSE = "⚠小母数"
MEMBER_UNIT = "社"
TIP_PARTICIPATION, TIP_CONCENTRATION = "参加率 ", "% / 集中度 "
TIP_REGISTERED, TIP_IGNITED = " / 初動登録 ", " / 直近点火 "
