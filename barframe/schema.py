"""Column names, fixed values and small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SERIES = ["symbol", "interval"]
PRICES = ["open", "high", "low", "close", "volume"]
BAR = [*SERIES, "ts", *PRICES]

DAILY, WEEKLY, HOURLY = "1d", "1wk", "60m"

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("interval", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        *[T.StructField(c, T.DoubleType(), False) for c in PRICES],
    ]
)

# --- fixed values ---------------------------------------------------------

# bars shown per look-back period
PERIOD_BARS = {"1mo": 30, "3mo": 90, "6mo": 180, "1y": 252, "2y": 504, "5y": 1260}
DEFAULT_PERIOD_BARS = 252

# mode -> (ATR multiple, RSI overbought, RSI oversold)
TRADE_MODES = {
    "trend": (2.5, 80.0, 20.0),
    "short": (1.5, 75.0, 25.0),
    "ultra_short": (1.2, 70.0, 30.0),
    "swing": (2.0, 85.0, 15.0),
}
DEFAULT_MODE = "short"

# view -> (default period, daily weight, weekly weight, hourly weight)
VIEWS = {
    "ultra_short": ("1mo", 0.3, 0.0, 0.7),
    "short": ("3mo", 0.6, 0.0, 0.4),
    "mid_long": ("1y", 0.7, 0.3, 0.0),
}
# intervals a view asks for besides daily
VIEW_INTERVALS = {
    "ultra_short": (HOURLY,),
    "short": (WEEKLY, HOURLY),
    "mid_long": (WEEKLY,),
}

# localised header -> column
HEADER_ALIASES = {
    "日期": "date",
    "时间": "date",
    "开盘": "open",
    "最高": "high",
    "最低": "low",
    "收盘": "close",
    "成交量": "volume",
    "成交量(股)": "volume",
    "成交量(手)": "volume",
}

# statement item -> names it goes by, preferred first
STATEMENT_ITEMS = {
    "revenue": ("Total Revenue", "Revenue"),
    "net_income": ("Net Income", "NetIncome"),
    "equity": ("Total Equity Gross Minority Interest", "Stockholders Equity"),
    "liabilities": ("Total Liabilities Net Minority Interest", "Total Liabilities"),
    "assets": ("Total Assets",),
}

# industry -> code of its leading share
SECTOR_LEADERS = {
    "银行": "600036",
    "证券": "600030",
    "保险": "601318",
    "白酒": "600519",
    "新能源车": "002594",
    "半导体": "688981",
    "光伏": "300274",
    "医药": "600276",
    "医疗": "300760",
    "消费电子": "002475",
    "计算机": "600588",
    "通信": "600050",
    "军工": "600893",
    "有色": "601600",
    "煤炭": "601088",
    "钢铁": "600019",
    "地产": "000002",
    "建材": "600585",
    "家电": "000333",
    "农业": "000998",
    "食品": "603288",
    "旅游": "600138",
    "电力": "600900",
    "化工": "600309",
    "机械设备": "600031",
    "交通运输": "601816",
    "传媒": "300413",
    "环保": "300070",
    "人工智能": "002230",
    "云计算": "000977",
    "5G": "000063",
}

UP_RED, DOWN_GREEN = "#dc2626", "#16a34a"

# --- derived --------------------------------------------------------------


def bars_kept(period: str) -> dict[str, int]:
    """How many bars a look-back period keeps per interval."""
    days = PERIOD_BARS.get(period, DEFAULT_PERIOD_BARS)
    return {DAILY: days + 20, WEEKLY: max(days // 5 + 10, 52), HOURLY: 320}


def trade_modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m, *v) for m, v in TRADE_MODES.items()],
        "mode string, atr_mult double, rsi_ob double, rsi_os double",
    )


def views(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(v, *row) for v, row in VIEWS.items()],
        "view string, period string, w_daily double, w_weekly double, w_hourly double",
    )


def sector_leaders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SECTOR_LEADERS.items()), "sector string, symbol string")
