"""Technical indicators, rule scores and text parsers, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import by_code, div, lag, rnd, roll
from tessera.operators.scans import with_ewm


def indicators(bars: DataFrame) -> DataFrame:
    """Moving averages, RSI(14) on simple means, MACD(12,26,9), KDJ(9,3,3) and the volume ratio; rows before the 20th of a code are left out. ``last`` tells a code's last bar."""
    x = bars.withColumns({
        "ma5": roll(F.avg, "close", 5), "ma20": roll(F.avg, "close", 20), "_d": F.col("close") - lag("close"), "_n": F.row_number().over(by_code()),
        "_lo": roll(F.min, "low", 9), "_hi": roll(F.max, "high", 9), "vol_ratio": div("volume", roll(F.avg, "volume", 5)),
    })
    x = x.withColumns({
        "_gain": roll(F.avg, F.greatest("_d", F.lit(0.0)), 14), "_loss": roll(F.avg, F.greatest(-F.col("_d"), F.lit(0.0)), 14),
        "_rsv": (F.col("close") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9) * 100,
    })
    x = with_ewm(x, {"_e12": ("close", 1 - 2 / 13), "_e26": ("close", 1 - 2 / 27), "k": ("_rsv", 1 - 1 / 3)})
    x = x.withColumns({"rsi": 100 - 100 / (1 + div("_gain", "_loss")), "dif": F.col("_e12") - F.col("_e26")})
    x = with_ewm(x, {"dea": ("dif", 1 - 2 / 10), "d": ("k", 1 - 1 / 3)})
    x = x.withColumns({"hist": (F.col("dif") - F.col("dea")) * 2, "j": 3 * F.col("k") - 2 * F.col("d")})
    x = x.withColumns({
        "ma_bull": F.col("ma5") > F.col("ma20"),
        "macd_cross": (F.col("dif") > F.col("dea")) & (lag("dif") <= lag("dea")), "macd_bull": F.col("dif") > F.col("dea"),
        "kdj_cross": (F.col("k") > F.col("d")) & (lag("k") <= lag("d")), "last": F.lead("date").over(by_code()).isNull(),
        "kdj_state": F.when(F.col("j") > 80, "overbought").when(F.col("j") < 20, "oversold").otherwise("normal"),
        "rsi_state": F.when(F.col("rsi") > 70, "overbought").when(F.col("rsi") < 30, "oversold").otherwise("normal"),
        "vol_state": F.when(F.col("vol_ratio") > 1.5, "heavy").when(F.col("vol_ratio") < 0.7, "light").otherwise("normal"),
    })
    return x.filter("_n >= 20").drop(*[c for c in x.columns if c.startswith("_")])


def _points(*rules: tuple[Column, int]) -> Column:
    """First rule that holds gives the points, else 0."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, points in rules[1:]:
        out = out.when(condition, points)
    return out.otherwise(0)


def rule_score(rsi, hist, ma_bull, close, ma5, ma20, pct, index_pct) -> Column:
    """From -12 to 12: momentum, trend and strength against the index."""
    rsi, ma_bull, yes = F.coalesce(rsi, F.lit(50.0)), F.coalesce(ma_bull, F.lit(False)), F.lit(True)
    return (
        _points((rsi < 30, 3), (rsi > 70, -3), (rsi < 40, 1), (rsi > 60, -1)) + _points((F.coalesce(hist, F.lit(0.0)) > 0, 2), (yes, -2)) + _points((ma_bull, 2), (yes, -2))
        + _points((close > ma5, 1), (yes, -1)) + _points((close > ma20, 1), (yes, -1)) + _points((pct - index_pct > 1.0, 2), (pct - index_pct < -1.0, -2))
        + _points(((pct > 0) & (pct < 2), 1), (pct > 5, -1), (pct < -5, 1))
    )


def rule_decision(score: Column, close: Column) -> Column:
    """Action, confidence, position and stop of a rule score."""
    pick = lambda a, b, c, d, e: F.when(score >= 6, a).when(score >= 3, b).when(score >= -2, c).when(score >= -5, d).otherwise(e)
    return F.struct(
        pick("buy", "buy", "hold", "sell", "sell").alias("action"),
        pick(F.least(F.lit(90), 60 + score * 3), F.least(F.lit(75), 50 + score * 4), F.lit(50), F.lit(70), F.lit(80)).cast("long").alias("confidence"),
        pick(F.lit(0.4), F.lit(0.2), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("position"),
        F.when(score >= 6, close * 0.97).when(score >= 3, close * 0.95).alias("stop_loss"),
    )


def scan_parts(price, pct, vol_ratio, turnover, rsi, macd_cross, macd_bull, kdj_cross, kdj_state, ma_bull, amount, drawdown20, bp) -> dict[str, Column]:
    """The scanner's parts with the research overlays on; their sum is the score, those above 0 its reasons."""
    macd_cross, macd_bull, kdj_cross, ma_bull = (F.coalesce(c, F.lit(False)) for c in (macd_cross, macd_bull, kdj_cross, ma_bull))
    return {
        "volume": _points((vol_ratio >= 2.0, 30), (vol_ratio >= 1.5, 20)), "turnover": _points((turnover >= 3.0, 20), (turnover >= 1.5, 10)),
        "macd": _points((macd_cross, 25), (macd_bull, 8)), "kdj": _points((kdj_cross & (kdj_state != "overbought"), 15), (kdj_cross, 5)), "trend": _points((ma_bull, 10)),
        "rsi": _points(((rsi >= 35) & (rsi <= 60), 10), (rsi < 30, 5)), "change": _points(((pct >= 0) & (pct <= 5), 10), (pct > 5, -5)),
        "amount": _points((amount >= 1e8, 10), (amount >= 5e7, 5)), "price": _points(((price >= 5) & (price <= 200), 5)),
        "low_turnover": _points((turnover < 1.5, 10), (turnover >= 8, -15)), "chase": _points((pct > 7, -10)), "drawdown": _points((drawdown20 > -0.08, 8), (drawdown20 < -0.20, -8)),
        "value": _points((bp >= 0.75, 8), (bp >= 0.40, 3), (bp < 0.25, -5)),
    }


#: The phrases of advice that the parsers look for.
SELL_ADVICE = ["建议卖出", "卖出信号", "建议清仓", "清仓回避", "建议减仓", "止盈离场", "止盈卖出"]
BUY_ADVICE = ["建议买入", "买入信号", "建议加仓", "建议低吸", "轻仓买入", "逢低买入"]
MARK, HOLD_WORDS, SELL_WORDS, BUY_WORDS = "[信号]", "持有|观望|等待", "卖出|清仓|减仓|离场", "买入|加仓|低吸|补仓"
NOT, DO_NOT = "不", "不要"


def advised(text: Column, phrase: str) -> Column:
    """The phrase stands in the text and is nowhere negated."""
    return text.contains(phrase) & ~text.contains(NOT + phrase) & ~text.contains(DO_NOT + phrase)


def parse_action(text: Column, buy_advice: list[str] = BUY_ADVICE) -> Column:
    """The marked signal line decides; without it, advice that is not negated; selling before buying."""
    marked = F.split_part(F.split_part(F.concat(text, F.lit(MARK)), F.lit(MARK), F.lit(2)), F.lit("["), F.lit(1))
    line = F.split_part(F.trim(F.regexp_replace(marked, r"^\s+", "")), F.lit("\n"), F.lit(1))
    any_of = lambda phrases: [advised(text, p) for p in phrases]
    either = lambda cs: F.exists(F.array(*cs), lambda c: c)
    by_mark = F.when(line.rlike(HOLD_WORDS), "hold").when(line.rlike(SELL_WORDS), "sell").when(line.rlike(BUY_WORDS), "buy").otherwise("hold")
    return F.when(text.contains(MARK), by_mark).when(either(any_of(SELL_ADVICE)), "sell").when(either(any_of(buy_advice)), "buy").otherwise("hold")


def parse_direction(text: Column) -> Column:
    """The stated direction of operation, else as ``parse_action`` without a mark."""
    stated = F.regexp_extract(text, r"操作方向\s*[：:]?\s*(买入|卖出|观望|持有|加仓|减仓|清仓)", 1)
    return F.when(stated.isin("卖出", "减仓", "清仓"), "sell").when(stated.isin("买入", "加仓"), "buy").when(stated != "", "hold").otherwise(parse_action(F.replace(text, F.lit(MARK), F.lit("")), BUY_ADVICE[:-1]))


def parse_horizon(text: Column) -> Column:
    low = F.lower(text)
    seg = F.split_part(F.split_part(F.concat(low, F.lit("[周期]")), F.lit("[周期]"), F.lit(2)), F.lit("["), F.lit(1))
    marked = F.when(seg.rlike("short|短线|5"), "short").when(seg.rlike("long|长线|3个月"), "long").otherwise("medium")
    return F.when(text.contains("[周期]"), marked).when(low.rlike("短线|short"), "short").when(low.rlike("长线|long"), "long").otherwise("medium")


def entry_buckets(text: Column) -> dict[str, Column]:
    """Buckets of an entry-indicator text; what is missing takes a default."""
    grab = lambda pattern, default: F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(default))
    t = F.regexp_extract(text, r"换手率=([\d.]+)%", 1).try_cast("double")
    ma, gold, kdj, vol = grab("均线多头=([是否])", "否"), grab("MACD金叉=([是否])", "否"), grab("KDJ金叉=([是否])", "否"), grab(r"成交量状态=(\S+)", "正常")
    return {
        "ma_bull": ma, "rsi_state": grab(r"RSI状态=(\S+)", "正常"), "macd_cross": gold, "kdj_cross": kdj, "vol_state": vol,
        "turnover": F.when(t < 1, "<1%").when(t < 3, "1-3%").when(t < 5, "3-5%").when(t.isNotNull(), ">5%").otherwise("unknown"),
        "strong": ((ma == "是") & (gold == "是")) | ((kdj == "是") & (vol == "放量")),
    }


#: What a missing name is called, and the two classes of an entry.
UNKNOWN, STRONG, WEAK = "未知", "强因子共振", "弱因子/AI主观"


def attribution(closed: DataFrame) -> DataFrame:
    """Ten groupings of closed trades (strategy, reason, month, pnl, indicators): ``kind``, ``bucket``, ``n``, ``wins``, ``win_rate``, ``net_pnl``, ``place``.

    Each trade gives a row a grouping, summed before the shuffle; a missing name is a bucket of its own. Buckets are placed
    by their net, then by name.
    """
    b = entry_buckets(F.coalesce("indicators", F.lit("")))
    named = {
        "strategy": F.coalesce("strategy", F.lit(UNKNOWN)), "reason": F.coalesce("reason", F.lit(UNKNOWN)), "month": F.coalesce("month", F.lit(UNKNOWN)), "factor_signal": F.when(b["strong"], STRONG).otherwise(WEAK),
        "ma": F.concat(F.lit("均线多头="), b["ma_bull"]), "rsi": F.concat(F.lit("RSI="), b["rsi_state"]), "macd": F.concat(F.lit("MACD金叉="), b["macd_cross"]), "kdj": F.concat(F.lit("KDJ金叉="), b["kdj_cross"]),
        "volume": F.concat(F.lit("量="), b["vol_state"]), "turnover": F.concat(F.lit("换手="), b["turnover"]),
    }
    rows = closed.select(F.coalesce("pnl", F.lit(0.0)).alias("pnl"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("bucket")) for k, v in named.items()])).alias("g"))
    out = rows.groupBy("g.kind", "g.bucket").agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), rnd(F.avg((F.col("pnl") > 0).cast("double")), 3).alias("win_rate"), rnd(F.sum("pnl"), 2).alias("net_pnl"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("net_pnl"), "bucket")))


def entry_text(bar: DataFrame) -> Column:
    """The indicators of a bar (as ``indicators`` gives them, with turnover and prices) as the text that ``entry_buckets`` reads; what is missing is 0 or "?"."""
    number = lambda c, d: F.format_string(f"%.{d}f", rnd(F.coalesce(F.col(c), F.lit(0.0)), d))
    yes = lambda c: F.when(F.col(c), "是").when(~F.col(c), "否").otherwise("?")
    named = lambda c, names: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(c)), F.lit("?"))
    extremes = {"overbought": "超买", "oversold": "超卖", "normal": "正常"}
    trend = F.when(F.col("macd_bull"), "多头").when(~F.col("macd_bull"), "空头").otherwise("?")
    parts = [
        [("MA5=", number("ma5", 2)), (" MA20=", number("ma20", 2)), (" 均线多头=", yes("ma_bull"))], [("RSI=", number("rsi", 1)), (" RSI状态=", named("rsi_state", extremes))],
        [("MACD金叉=", yes("macd_cross")), (" MACD状态=", trend)], [("K=", number("k", 1)), (" D=", number("d", 1)), (" J=", number("j", 1)), (" KDJ金叉=", yes("kdj_cross")), (" KDJ状态=", named("kdj_state", extremes))],
        [("量比=", number("vol_ratio", 2)), (" 成交量=", number("volume", 0)), (" 成交量状态=", named("vol_state", {"heavy": "放量", "light": "缩量", "normal": "正常"}))],
        [("换手率=", number("turnover", 2)), ("%", F.lit(""))], [("今开=", number("open", 2)), (" 最高=", number("high", 2)), (" 最低=", number("low", 2))],
    ]
    return F.concat_ws(" | ", *[F.concat(*[x for label, value in part for x in (F.lit(label), value)]) for part in parts])
