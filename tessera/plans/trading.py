"""Queries: indicators, scores, parsers, lots, ledger, risk, ledger aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.columns import rnd
from tessera.operators import joins, ledger, signals
from tessera.operators.scans import running
from tessera.plans import sql as q
from tessera.plans.factors import FULL, SNAP_SPEC, _SNAP, full_bars, snapshot
from tessera.plans.sql import BARS, TRADES, with_
from tessera.registry import query
from tessera.sources import panel as p
from tessera.sources.staging import written

_PNL = q.rnd("(price - 1500) * volume", 2)
_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "price", "volume"]
_O = ", ".join(_ORDER)
_IND = f"""d AS (SELECT *, close - lag(close) OVER w AS chg, row_number() OVER w AS n, {q.roll('avg', 'close', 5)} AS ma5, {q.roll('avg', 'close', 20)} AS ma20, volume / nullif({q.roll('avg', 'volume', 5)}, 0) AS vol_ratio FROM full_bars WINDOW w AS (PARTITION BY code ORDER BY date)),
g AS (SELECT *, greatest(chg, 0.0) AS up, CASE WHEN chg IS NULL THEN 0.0 ELSE greatest(-chg, 0.0) END AS dn FROM (SELECT * REPLACE (coalesce(chg, 0.0) AS chg), chg AS raw FROM d)),
rs AS (SELECT *, 100 - 100 / (1 + ({q.roll('avg', 'up', 14)}) / nullif({q.roll('avg', 'dn', 14)}, 0)) AS rsi FROM g)"""


@query("g1_g2_g5_simple_indicators", with_(BARS, FULL, _IND) + f"SELECT code, date, {q.rnd('ma5', 5)} AS ma5, {q.rnd('ma20', 5)} AS ma20, ma5 > ma20 AS ma_bull, {q.rnd('rsi', 5)} AS rsi, {q.rnd('vol_ratio', 5)} AS vol_ratio, CASE WHEN vol_ratio > 1.5 THEN 'heavy' WHEN vol_ratio < 0.7 THEN 'light' ELSE 'normal' END AS vol_state FROM rs WHERE n >= 20")
def g1(spark, sf_dir):
    """Averages, RSI and volume ratio from the 20th bar on."""
    x = signals.indicators(full_bars(spark, sf_dir))
    return x.select("code", "date", rnd("ma5", 5).alias("ma5"), rnd("ma20", 5).alias("ma20"), "ma_bull", rnd("rsi", 5).alias("rsi"), rnd("vol_ratio", 5).alias("vol_ratio"), "vol_state")


_EWM = f"""seq AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS i,
  (close - ({q.roll('min', 'low', 9)})) / (({q.roll('max', 'high', 9)}) - ({q.roll('min', 'low', 9)}) + 1e-9::DOUBLE) * 100 AS rsv FROM bars),
rec AS (SELECT code, date, i, close AS s12, 1.0::DOUBLE AS w12, close AS s26, 1.0::DOUBLE AS w26, 0.0::DOUBLE AS dif, 0.0::DOUBLE AS s9, 1.0::DOUBLE AS w9, coalesce(rsv, 0) AS sk, (rsv IS NOT NULL)::INT::DOUBLE AS wk, rsv AS k,
    coalesce(rsv, 0) AS sd, (rsv IS NOT NULL)::INT::DOUBLE AS wd FROM seq WHERE i = 1
  UNION ALL SELECT code, date, i, s12, w12, s26, w26, dif, s9 * 0.8::DOUBLE + dif, w9 * 0.8::DOUBLE + 1, sk, wk, k, CASE WHEN k IS NULL THEN sd ELSE sd * (2 / 3.0::DOUBLE) + k END, CASE WHEN k IS NULL THEN wd ELSE wd * (2 / 3.0::DOUBLE) + 1 END
    FROM (SELECT *, s12 / w12 - s26 / w26 AS dif, sk / nullif(wk, 0) AS k FROM (
      SELECT q.code, q.date, q.i, r.s12 * (11 / 13.0::DOUBLE) + q.close AS s12, r.w12 * (11 / 13.0::DOUBLE) + 1 AS w12, r.s26 * (25 / 27.0::DOUBLE) + q.close AS s26, r.w26 * (25 / 27.0::DOUBLE) + 1 AS w26, r.s9, r.w9,
        CASE WHEN rsv IS NULL THEN r.sk ELSE r.sk * (2 / 3.0::DOUBLE) + rsv END AS sk, CASE WHEN rsv IS NULL THEN r.wk ELSE r.wk * (2 / 3.0::DOUBLE) + 1 END AS wk, r.sd, r.wd FROM rec r JOIN seq q ON q.code = r.code AND q.i = r.i + 1))),
osc AS (SELECT *, (dif - dea) * 2 AS hist, 3 * k - 2 * d AS j, coalesce(dif > dea AND lag(dif) OVER w <= lag(dea) OVER w, false) AS macd_cross, coalesce(k > d AND lag(k) OVER w <= lag(d) OVER w, false) AS kdj_cross,
    CASE WHEN 3 * k - 2 * d > 80 THEN 'overbought' WHEN 3 * k - 2 * d < 20 THEN 'oversold' ELSE 'normal' END AS kdj_state
  FROM (SELECT code, date, i, dif, s9 / w9 AS dea, k, sd / nullif(wd, 0) AS d FROM rec) WINDOW w AS (PARTITION BY code ORDER BY date))"""


@query("g3_w8_macd_line", with_(BARS, _EWM) + f"SELECT code, date, {q.rnd('dif', 5)} AS dif FROM osc WHERE i >= 20")
def g3(spark, sf_dir):
    """Difference of the 12- and 26-day exponential means, from each code's 20th bar on."""
    x = signals.indicators(full_bars(spark, sf_dir))
    return x.select("code", "date", rnd("dif", 5).alias("dif"))


@query("g3_g4_macd_kdj", with_(BARS, _EWM) + f"SELECT code, date, {', '.join(f'{q.rnd(c, 4)} AS {c}' for c in ('dif', 'dea', 'hist', 'k', 'd', 'j'))}, macd_cross, kdj_cross, kdj_state FROM osc WHERE i >= 20")
def g4(spark, sf_dir):
    """MACD with signal line and crossings, KDJ with states by J."""
    x = signals.indicators(full_bars(spark, sf_dir))
    crossed = [F.coalesce(c, F.lit(False)).alias(c) for c in ("macd_cross", "kdj_cross")]
    return x.select("code", "date", *[rnd(c, 4).alias(c) for c in ("dif", "dea", "hist", "k", "d", "j")], *crossed, "kdj_state")


def _scored(spark, sf_dir):
    """The last bar of each code with indicators and the drawdown of the last 20 closes."""
    closes = F.collect_list("close").over(Window.partitionBy("code").orderBy("date").rowsBetween(-19, 0))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))
    fall = lambda a, c: F.struct(F.greatest(a["peak"], c).alias("peak"), F.least(a["dd"], c / F.nullif(F.greatest(a["peak"], c), F.lit(0.0)) - 1).alias("dd"))
    end = F.lead("date").over(Window.partitionBy("code").orderBy("date")).isNull()
    return signals.indicators(full_bars(spark, sf_dir).withColumn("dd20", F.when(end, F.aggregate(closes, start, fall)["dd"]))).filter("last")


_LAST = """bar AS (SELECT rs.code, rs.date, close, pct_chg, turnover, amount, rsi, vol_ratio, ma5, ma20, ma5 > ma20 AS ma_bull, hist, dif > dea AS macd_bull, macd_cross, kdj_cross, kdj_state
  FROM rs JOIN osc USING (code, date) WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY rs.code ORDER BY rs.date DESC) = 1)"""
_RULES = """pts AS (SELECT code, close,
  CASE WHEN coalesce(rsi, 50) < 30 THEN 3 WHEN coalesce(rsi, 50) > 70 THEN -3 WHEN coalesce(rsi, 50) < 40 THEN 1 WHEN coalesce(rsi, 50) > 60 THEN -1 ELSE 0 END + CASE WHEN coalesce(hist, 0) > 0 THEN 2 ELSE -2 END + CASE WHEN coalesce(ma_bull, false) THEN 2 ELSE -2 END
  + CASE WHEN close > ma5 THEN 1 ELSE -1 END + CASE WHEN close > ma20 THEN 1 ELSE -1 END + CASE WHEN pct_chg - ix > 1 THEN 2 WHEN pct_chg - ix < -1 THEN -2 ELSE 0 END + CASE WHEN pct_chg > 0 AND pct_chg < 2 THEN 1 WHEN pct_chg > 5 THEN -1 WHEN pct_chg < -5 THEN 1 ELSE 0 END AS score
  FROM bar CROSS JOIN (SELECT avg(pct_chg) AS ix FROM bar))"""


@query("g7_rule_score", with_(BARS, FULL, _IND, _EWM, _LAST, _RULES) + f"""SELECT code, score::BIGINT AS score, CASE WHEN score >= 3 THEN 'buy' WHEN score >= -2 THEN 'hold' ELSE 'sell' END AS action,
  (CASE WHEN score >= 6 THEN least(90, 60 + score * 3) WHEN score >= 3 THEN least(75, 50 + score * 4) WHEN score >= -2 THEN 50 WHEN score >= -5 THEN 70 ELSE 80 END)::BIGINT AS confidence,
  CASE WHEN score >= 6 THEN 0.4::DOUBLE WHEN score >= 3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS position, {q.rnd('CASE WHEN score >= 6 THEN close * 0.97::DOUBLE WHEN score >= 3 THEN close * 0.95::DOUBLE END', 4)} AS stop_loss FROM pts""")
def g7(spark, sf_dir):
    """Score, action, confidence, position and stop at each code's last bar, with the MACD histogram in use."""
    x = _scored(spark, sf_dir).select("code", "close", "pct_chg", "rsi", "hist", "ma_bull", "ma5", "ma20")
    x = written(x, "last_bars")  # one row a code; the mean change and the scores read them
    index_pct = x.agg(F.avg("pct_chg").alias("index_pct"))
    x = x.crossJoin(F.broadcast(index_pct))
    c = F.col
    x = x.withColumn("score", signals.rule_score(c("rsi"), c("hist"), c("ma_bull"), c("close"), c("ma5"), c("ma20"), c("pct_chg"), c("index_pct")))
    d = signals.rule_decision(c("score"), c("close"))
    return x.select("code", c("score").cast("long").alias("score"), d["action"].alias("action"), d["confidence"].alias("confidence"), d["position"].alias("position"), rnd(d["stop_loss"], 4).alias("stop_loss"))


_SCAN = """fall AS (SELECT code, min(close / nullif(peak, 0) - 1) AS dd20 FROM (SELECT code, close, max(close) OVER (PARTITION BY code ORDER BY date) AS peak FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 20)) GROUP BY 1),
ratio AS (SELECT code, 1 / pb AS bp FROM snap WHERE pb > 0),
p AS (SELECT code, CASE WHEN vol_ratio >= 2 THEN 30 WHEN vol_ratio >= 1.5 THEN 20 ELSE 0 END AS volume, CASE WHEN turnover >= 3 THEN 20 WHEN turnover >= 1.5 THEN 10 ELSE 0 END AS turnover_, CASE WHEN macd_cross THEN 25 WHEN macd_bull THEN 8 ELSE 0 END AS macd,
  CASE WHEN kdj_cross AND kdj_state <> 'overbought' THEN 15 WHEN kdj_cross THEN 5 ELSE 0 END AS kdj, CASE WHEN ma_bull THEN 10 ELSE 0 END AS trend, CASE WHEN rsi >= 35 AND rsi <= 60 THEN 10 WHEN rsi < 30 THEN 5 ELSE 0 END AS rsi_,
  CASE WHEN pct_chg >= 0 AND pct_chg <= 5 THEN 10 WHEN pct_chg > 5 THEN -5 ELSE 0 END AS change, CASE WHEN amount >= 1e8 THEN 10 WHEN amount >= 5e7 THEN 5 ELSE 0 END AS amount_, CASE WHEN close >= 5 AND close <= 200 THEN 5 ELSE 0 END AS price,
  CASE WHEN turnover < 1.5 THEN 10 WHEN turnover >= 8 THEN -15 ELSE 0 END AS low_turnover, CASE WHEN pct_chg > 7 THEN -10 ELSE 0 END AS chase, CASE WHEN dd20 > -0.08 THEN 8 WHEN dd20 < -0.20 THEN -8 ELSE 0 END AS drawdown, CASE WHEN bp >= 0.75 THEN 8 WHEN bp >= 0.40 THEN 3 WHEN bp < 0.25 THEN -5 ELSE 0 END AS value
  FROM bar JOIN fall USING (code) LEFT JOIN ratio USING (code) WHERE turnover >= 0.5 AND close >= 2)"""
_PARTS = ["volume", "turnover", "macd", "kdj", "trend", "rsi", "change", "amount", "price", "low_turnover", "chase", "drawdown", "value"]
_COLUMNS = [x + "_" if x in ("turnover", "rsi", "amount") else x for x in _PARTS]


@query("g8_g9_market_scan", with_(BARS, FULL, _SNAP, _IND, _EWM, _LAST, _SCAN) + f"SELECT * FROM (SELECT code, ({' + '.join(_COLUMNS)})::BIGINT AS score, concat_ws('|', {', '.join(f'CASE WHEN {c} > 0 THEN {n!r} END' for c, n in zip(_COLUMNS, _PARTS, strict=True))}) AS reasons FROM p) WHERE score >= 25 ORDER BY score DESC, code LIMIT 10")
def g8(spark, sf_dir):
    """The scanner's score with the research overlays and reasons; price and turnover filters; top ten from 25 points on."""
    ratio = p.ensure_columns(snapshot(spark, sf_dir), SNAP_SPEC).filter("pb > 0").select("code", (1 / F.col("pb")).alias("bp"))
    x = _scored(spark, sf_dir).filter("turnover >= 0.5 and close >= 2").join(ratio, "code", "left")
    c = F.col
    parts = signals.scan_parts(c("close"), c("pct_chg"), c("vol_ratio"), c("turnover"), c("rsi"), c("macd_cross"), c("macd_bull"), c("kdj_cross"), c("kdj_state"), c("ma_bull"), c("amount"), c("dd20"), c("bp"))
    score = sum(parts.values(), F.lit(0))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(v > 0, k) for k, v in parts.items()])), "|")
    return x.select("code", score.cast("long").alias("score"), reasons.alias("reasons")).filter("score >= 25").orderBy(F.desc("score"), "code").limit(10)


_TEXT = """texts AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '[信号] 买入，目标' WHEN 1 THEN '不建议买入' WHEN 2 THEN '建议卖出 短线' WHEN 3 THEN '[信号]：持有' WHEN 4 THEN '逢低买入 [周期] 3个月 [x]'
  WHEN 5 THEN '操作方向：减仓' WHEN 6 THEN '不要建议卖出，轻仓买入' ELSE 'long' END || ' ' || lang AS text FROM documents)"""


def _texts(spark, sf_dir):
    d = p.table(spark, sf_dir, "documents")
    heads = ["[信号] 买入，目标", "不建议买入", "建议卖出 短线", "[信号]：持有", "逢低买入 [周期] 3个月 [x]", "操作方向：减仓", "不要建议卖出，轻仓买入", "long"]
    return d.select("doc_id", F.concat(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 8 + 1).cast("int")), F.lit(" "), F.col("lang")).alias("text"))


@query("g11_g13_text_signals", with_(_TEXT) + "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'buy' WHEN 2 THEN 'sell' WHEN 4 THEN 'buy' WHEN 6 THEN 'buy' ELSE 'hold' END AS action, CASE doc_id % 8 WHEN 2 THEN 'sell' WHEN 5 THEN 'sell' WHEN 6 THEN 'buy' ELSE 'hold' END AS direction, CASE doc_id % 8 WHEN 2 THEN 'short' WHEN 4 THEN 'long' WHEN 7 THEN 'long' ELSE 'medium' END AS horizon FROM texts")
def g11(spark, sf_dir):
    """Action with negation, stated direction, horizon; the twin states the answers."""
    t = _texts(spark, sf_dir)
    return t.select("doc_id", signals.parse_action(F.col("text")).alias("action"), signals.parse_direction(F.col("text")).alias("direction"), signals.parse_horizon(F.col("text")).alias("horizon"))


@query("g14_entry_buckets", "SELECT event_id, CASE WHEN value < 1 THEN '<1%' WHEN value < 3 THEN '1-3%' WHEN value < 5 THEN '3-5%' ELSE '>5%' END AS turnover, CASE WHEN event_id % 2 = 0 THEN '是' ELSE '否' END AS ma_bull, event_id % 2 = 0 AND event_id % 3 = 0 AS strong FROM (SELECT event_id, round(abs(value), 2) AS value FROM events WHERE value IS NOT NULL)")
def g14(spark, sf_dir):
    """Buckets read back from indicator texts."""
    e = p.table(spark, sf_dir, "events").filter("value is not null")
    yes = lambda k: F.when(F.col("event_id") % k == 0, "是").otherwise("否")
    text = F.concat(F.lit("换手率="), F.round(F.abs("value"), 2).cast("decimal(18,2)").cast("string"), F.lit("% 均线多头="), yes(2), F.lit(" MACD金叉="), yes(3))
    b = signals.entry_buckets(text)
    return e.select("event_id", b["turnover"].alias("turnover"), b["ma_bull"].alias("ma_bull"), b["strong"].alias("strong"))


_CUM = f"""t AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {_O}) AS id FROM trades),
cum AS (SELECT code, id, direction, volume, price, sum(volume) OVER (PARTITION BY code, direction ORDER BY id) AS hi FROM t),
bt AS (SELECT code, id AS buy_id, hi - volume AS blo, hi AS bhi FROM cum WHERE direction = 'buy'), st AS (SELECT code, id AS sell_id, hi - volume AS lo, hi FROM cum WHERE direction = 'sell'),
lots AS (SELECT st.code, sell_id, buy_id, least(hi, bhi) - greatest(lo, blo) AS alloc FROM st JOIN bt ON st.code = bt.code AND blo < hi AND lo < bhi
  UNION ALL SELECT st.code, sell_id, NULL, hi - greatest(lo, b) FROM st JOIN (SELECT code, max(bhi) AS b FROM bt GROUP BY 1) USING (code) WHERE hi > b)"""


def _numbered(spark, sf_dir):
    """Trades with ``id``, their place in their code, counted by months."""
    return running(p.trades(spark, sf_dir), ["code"], F.trunc("ts", "MM"), _ORDER, {"id": ("count", F.lit(1))})


@query("j13_fifo_lots", with_(TRADES, _CUM) + "SELECT code, sell_id, buy_id, round(alloc, 4) AS alloc FROM lots WHERE alloc > 0")
def j13(spark, sf_dir):
    """Lots by overlap of running volumes, with the rest of an oversell."""
    lots = joins.fifo_lots(_numbered(spark, sf_dir), "code", ["id"], bucket=F.trunc("ts", "MM"))
    return lots.select("code", "sell_id", "buy_id", F.round("alloc", 4).alias("alloc"))


#: What a code holds after each trade, step by step: a sell is covered by what is held, no more.
_HELD = f"""t AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {_O}) AS id FROM trades),
held AS (SELECT code, id, direction, price, volume, CASE WHEN direction = 'buy' THEN volume ELSE 0.0::DOUBLE END AS held, 0.0::DOUBLE AS covered FROM t WHERE id = 1
  UNION ALL SELECT t.code, t.id, t.direction, t.price, t.volume, CASE WHEN t.direction = 'buy' THEN h.held + t.volume ELSE greatest(h.held - t.volume, 0) END, CASE WHEN t.direction = 'buy' THEN 0 ELSE least(h.held, t.volume) END
  FROM held h JOIN t ON t.code = h.code AND t.id = h.id + 1),
cum AS (SELECT *, sum(covered) OVER w AS shi, sum(CASE WHEN direction = 'buy' THEN volume ELSE 0 END) OVER w AS bhi FROM held WINDOW w AS (PARTITION BY code ORDER BY id)),
lots AS (SELECT s.code, s.id AS sell_id, b.id AS buy_id, least(s.shi, b.bhi) - greatest(s.shi - s.covered, b.bhi - b.volume) AS alloc, s.price - b.price AS gain
  FROM cum s JOIN cum b ON s.code = b.code AND s.direction = 'sell' AND b.direction = 'buy' AND b.bhi - b.volume < s.shi AND s.shi - s.covered < b.bhi WHERE s.covered > 0)"""


@query("j14_timed_fifo", with_(TRADES, _HELD) + f"SELECT s.code, s.id, any_value(s.covered) AS matched, {q.rnd('coalesce(sum(alloc * gain), 0)', 4)} AS pnl FROM cum s LEFT JOIN lots l ON l.code = s.code AND l.sell_id = s.id WHERE s.direction = 'sell' GROUP BY 1, 2")
def j14(spark, sf_dir):
    """Profit of each sell against earlier lots."""
    done = ledger.timed_fifo(_numbered(spark, sf_dir), ["id"], F.trunc("ts", "MM"))
    return done.select("code", "id", "matched", rnd("pnl", 4).alias("pnl"))


@query("j13_strict_lots", with_(TRADES, _HELD) + " SELECT code, sell_id, buy_id, round(alloc, 4) AS alloc FROM lots WHERE alloc > 0 UNION ALL SELECT code, id, NULL, round(volume - covered, 4) FROM cum WHERE direction = 'sell' AND volume > covered")
def j13_strict(spark, sf_dir):
    """J13 as T14 asks: a sell takes earlier buys alone, and its rest is told."""
    lots = joins.fifo_lots(_numbered(spark, sf_dir), "code", ["id"], bucket=F.trunc("ts", "MM"), strict=True)
    return lots.select("code", "sell_id", "buy_id", F.round("alloc", 4).alias("alloc"))


@query("j12_j15_closed_shares", with_(TRADES, _CUM) + f""", told AS (SELECT code, id AS sell_id, volume AS sold, {_PNL} AS pnl FROM t WHERE direction = 'sell'),
kept AS (SELECT code, id AS buy_id, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 'line ' || l_linenumber % 4 END AS strategy FROM t WHERE direction = 'buy' AND l_linenumber <> 7),
parts AS (SELECT k.strategy, l.buy_id IS NULL AS rest, {q.rnd('pnl * alloc / sold', 2)} AS pnl FROM lots l JOIN told USING (code, sell_id) LEFT JOIN kept k ON k.code = l.code AND k.buy_id = l.buy_id WHERE alloc > 0)
SELECT coalesce(strategy, 'none') AS strategy, rest, count(*) AS n, count_if(pnl > 0)::BIGINT AS wins, {q.rnd('sum(pnl)', 2)} AS net_pnl FROM parts GROUP BY 1, 2""")
def j12_j15(spark, sf_dir):
    """Each sell's profit dealt to its lots by volume, the lots joined to what is kept of their buys; count, wins and net by strategy and of the rests."""
    t = _numbered(spark, sf_dir)
    lots = joins.fifo_lots(t, "code", ["id"], bucket=F.trunc("ts", "MM"))
    sells = t.filter("direction = 'sell'").select("code", "id", rnd((F.col("price") - 1500) * F.col("volume"), 2).alias("pnl"), F.lit("sell").alias("reason"))
    line = F.col("l_linenumber") % 4
    kept = t.filter("direction = 'buy' AND l_linenumber <> 7").select("code", F.col("id").alias("buy_id"), F.when(line != 0, F.concat(F.lit("line "), line.cast("string"))).alias("strategy"))
    parts = ledger.closed_shares(lots, sells).join(kept, ["code", "buy_id"], "left").withColumn("pnl", rnd("pnl", 2))
    return parts.groupBy(F.coalesce("strategy", F.lit("none")).alias("strategy"), F.col("buy_id").isNull().alias("rest")).agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), rnd(F.sum("pnl"), 2).alias("net_pnl"))


def _number(column: str, digits: int) -> str:
    return f"printf('%.{digits}f', {q.rnd(f'coalesce({column}, 0)', digits)})"


_STATE = "CASE {} WHEN 'overbought' THEN '超买' WHEN 'oversold' THEN '超卖' ELSE '正常' END"
_YES = "CASE WHEN {} THEN '是' ELSE '否' END"


@query("g6_entry_text", with_(BARS, FULL, _IND, _EWM) + f"""SELECT code, 'MA5=' || {_number('ma5', 2)} || ' MA20=' || {_number('ma20', 2)} || ' 均线多头=' || {_YES.format('ma5 > ma20')} || ' | RSI=' || {_number('rsi', 1)} || ' RSI状态=' || CASE WHEN rsi > 70 THEN '超买' WHEN rsi < 30 THEN '超卖' ELSE '正常' END
  || ' | MACD金叉=' || {_YES.format('macd_cross')} || ' MACD状态=' || CASE WHEN dif > dea THEN '多头' ELSE '空头' END || ' | K=' || {_number('k', 1)} || ' D=' || {_number('d', 1)} || ' J=' || {_number('j', 1)} || ' KDJ金叉=' || {_YES.format('kdj_cross')} || ' KDJ状态=' || {_STATE.format('kdj_state')}
  || ' | 量比=' || {_number('vol_ratio', 2)} || ' 成交量=' || {_number('volume', 0)} || ' 成交量状态=' || CASE WHEN vol_ratio > 1.5 THEN '放量' WHEN vol_ratio < 0.7 THEN '缩量' ELSE '正常' END || ' | 换手率=' || {_number('turnover', 2)} || '% | 今开=' || {_number('open', 2)} || ' 最高=' || {_number('high', 2)} || ' 最低=' || {_number('low', 2)} AS text
FROM rs JOIN (SELECT code, date, dif, dea, k, d, j, macd_cross, kdj_cross, kdj_state FROM osc) USING (code, date) WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1""")
def g6(spark, sf_dir):
    """The indicators of each code's last bar as one text."""
    last = signals.indicators(full_bars(spark, sf_dir)).filter("last")
    return last.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("macd_cross", "kdj_cross", "macd_bull", "ma_bull")}).select("code", signals.entry_text(last).alias("text"))


#: One code's position, cost and profit step by step, without cash.
_REPLAY = f"""t AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY code ORDER BY {_O}) AS id FROM trades),
own AS (SELECT DISTINCT code, 0::BIGINT AS id, 0::DOUBLE AS held, 0::DOUBLE AS cost, 0::DOUBLE AS pnl, 0::DOUBLE AS today, NULL::DATE AS day, 0::BIGINT AS rejected, 0::BIGINT AS filled FROM t
  UNION ALL SELECT code, id, h AS held, CASE WHEN buy THEN (held * cost + volume * price) / (held + volume) WHEN h = 0 THEN 0 ELSE cost END, CASE WHEN sold THEN pnl + (price - cost) * volume ELSE pnl END, CASE WHEN buy THEN tod + volume ELSE tod END, day, rejected + (NOT buy AND NOT sold)::BIGINT, filled + (buy OR sold)::BIGINT
  FROM (SELECT *, CASE WHEN buy THEN held + volume WHEN sold THEN held - volume ELSE held END AS h FROM (SELECT *, NOT buy AND held - tod >= volume AS sold FROM (
    SELECT t.code, t.id, t.day, t.price, t.volume, t.direction = 'buy' AS buy, o.held, o.cost, o.pnl, o.rejected, o.filled, CASE WHEN o.day = t.day THEN o.today ELSE 0 END AS tod FROM own o JOIN t ON t.code = o.code AND t.id = o.id + 1)))),
done AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY code ORDER BY id DESC) = 1)"""


@query("x1_x3_ledger_replay", with_(TRADES, _REPLAY) + f"SELECT code, held, {q.rnd('cost', 5)} AS cost, {q.rnd('pnl', 3)} AS pnl, rejected, filled FROM done")
def x1(spark, sf_dir):
    """Position, average cost, realized profit and rejected sells of each code, without cash."""
    return ledger.replay(_numbered(spark, sf_dir), ["id"]).select("code", "held", rnd("cost", 5).alias("cost"), rnd("pnl", 3).alias("pnl"), "rejected", "filled")


CASH = 100_000.0
_ACCOUNTS = f"""acc AS (SELECT o_custkey AS account, code, direction, price, volume, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY {_O}) AS i FROM trades JOIN orders ON l_orderkey = o_orderkey),
run AS (SELECT DISTINCT account, 0::BIGINT AS i, {CASH}::DOUBLE AS cash, MAP([]::VARCHAR[], []::STRUCT(held DOUBLE, cost DOUBLE, today DOUBLE, day DATE)[]) AS pos, 0::DOUBLE AS pnl, 0::BIGINT AS filled, 0::BIGINT AS no_cash, 0::BIGINT AS no_shares FROM acc
  UNION ALL SELECT account, i, CASE WHEN bought THEN cash - price * volume * 1.0003::DOUBLE WHEN sold THEN cash + price * volume * 0.9987::DOUBLE ELSE cash END,
    CASE WHEN bought THEN map_concat(pos, MAP([code], [{{'held': held + volume, 'cost': (held * cost + price * volume) / (held + volume), 'today': today + volume, 'day': day}}])) WHEN sold THEN map_concat(pos, MAP([code], [{{'held': held - volume, 'cost': cost, 'today': today, 'day': day}}])) ELSE pos END,
    CASE WHEN sold THEN pnl + (price - cost) * volume ELSE pnl END, filled + (bought OR sold)::BIGINT, no_cash + (direction = 'buy' AND NOT bought)::BIGINT, no_shares + (direction = 'sell' AND NOT sold)::BIGINT
  FROM (SELECT *, direction = 'buy' AND cash >= price * volume * 1.0003::DOUBLE AS bought, direction = 'sell' AND held - today >= volume AS sold FROM (
    SELECT a.*, r.cash, r.pos, r.pnl, r.filled, r.no_cash, r.no_shares, coalesce(r.pos[a.code].held, 0) AS held, coalesce(r.pos[a.code].cost, 0) AS cost, CASE WHEN r.pos[a.code].day = a.day THEN r.pos[a.code].today ELSE 0 END AS today
    FROM run r JOIN acc a ON a.account = r.account AND a.i = r.i + 1))),
done AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY account ORDER BY i DESC) = 1)"""


def _accounts(spark, sf_dir):
    owner = p.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account"))
    return ledger.account_ledger(p.trades(spark, sf_dir).join(owner, "l_orderkey"), _ORDER, CASH)


@query("x1_x2_account_ledger", with_(TRADES, _ACCOUNTS) + f"SELECT account, {q.rnd('cash', 3)} AS cash, {q.rnd('pnl', 3)} AS pnl, filled, no_cash, no_shares FROM done")
def x1_cash(spark, sf_dir):
    """Each customer's account from 100,000 on: fees, buys beyond the cash and sells beyond what may be sold."""
    return _accounts(spark, sf_dir).select("account", rnd("cash", 3).alias("cash"), rnd("pnl", 3).alias("pnl"), "filled", "no_cash", "no_shares")


@query("x1_x2_resumed_ledger", with_(TRADES, _ACCOUNTS) + f"SELECT account, {q.rnd('cash', 3)} AS cash, {q.rnd('pnl', 3)} AS pnl, filled, no_cash, no_shares FROM done")
def x1_resumed(spark, sf_dir):
    """The same accounts by snapshots: the ledger is written at two cuts, and only later trades are folded from there."""
    owner = p.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account"))
    trades = p.trades(spark, sf_dir).join(owner, "l_orderkey")
    at, day = None, F.to_date("ts")
    for first, last in (("0001-01-01", "1997-01-01"), ("1997-01-01", "1999-06-01"), ("1999-06-01", "9999-12-31")):
        some = trades.filter((day >= F.lit(first).cast("date")) & (day < F.lit(last).cast("date")))
        at = written(ledger.account_ledger(some, _ORDER, CASH, at), "ledger")
    return at.select("account", rnd("cash", 3).alias("cash"), rnd("pnl", 3).alias("pnl"), "filled", "no_cash", "no_shares")


@query("x3_marked_positions", with_(TRADES, BARS, _ACCOUNTS) + f""", last AS (SELECT code, arg_max(close, date) AS price FROM bars GROUP BY 1),
open AS (SELECT account, UNNEST(map_keys(pos)) AS code, UNNEST(map_values(pos)) AS own FROM done)
SELECT account, code, own.held AS held, {q.rnd('own.cost', 4)} AS cost, {q.rnd('price', 4)} AS price, {q.rnd('(price - own.cost) * own.held', 3)} AS unrealized, {q.rnd('(price / own.cost - 1) * 100', 4)} AS pnl_ratio FROM open JOIN last USING (code) WHERE own.held > 0""")
def x3(spark, sf_dir):
    """Open positions at each code's last close."""
    last = p.last_closes(spark, sf_dir)
    x = ledger.marked_positions(_accounts(spark, sf_dir), last)
    return x.select("account", "code", "held", rnd("cost", 4).alias("cost"), rnd("price", 4).alias("price"), rnd("unrealized", 3).alias("unrealized"), rnd("pnl_ratio", 4).alias("pnl_ratio"))


_MARKED = f"""last AS (SELECT code, arg_max(close, date) AS price FROM bars GROUP BY 1),
open AS (SELECT account, code, own.held AS held, own.cost AS cost, price FROM (SELECT account, UNNEST(map_keys(pos)) AS code, UNNEST(map_values(pos)) AS own FROM done) JOIN last USING (code) WHERE own.held > 0),
balance AS (SELECT *, cash + market_value AS total FROM (SELECT d.account, any_value(d.cash) AS cash, coalesce(sum(o.price * o.held), 0) AS market_value, count(o.code) AS positions_count FROM done d LEFT JOIN open o USING (account) GROUP BY 1))"""


def _balances(spark, sf_dir):
    """The ledger written once, its marked positions and balances."""
    kept = written(_accounts(spark, sf_dir), "ledger")
    last = p.last_closes(spark, sf_dir)
    marked = ledger.marked_positions(kept, last)
    return marked, ledger.balances(kept, marked)


@query("a21_balances", with_(TRADES, BARS, _ACCOUNTS, _MARKED) + f"SELECT account, {q.rnd('cash', 2)} AS cash, {q.rnd('market_value', 2)} AS market_value, {q.rnd('total', 2)} AS total_assets, positions_count, {q.rnd('market_value / nullif(total, 0)', 6)} AS exposure FROM balance")
def a21(spark, sf_dir):
    """Cash, market value, assets, number of positions and exposure of each account."""
    _, b = _balances(spark, sf_dir)
    return b.select("account", *[rnd(c, 2).alias(c) for c in ("cash", "market_value", "total_assets")], "positions_count", rnd("exposure", 6).alias("exposure"))


def _money(x: str) -> str:
    return f"format('{{:,.2f}}', {q.rnd(x, 2)})"


@query("z22_report_lines", with_(TRADES, BARS, _ACCOUNTS, _MARKED) + f"""SELECT account, '' AS code, '总资产 ¥' || {_money('total')} || ' | 现金 ¥' || {_money('cash')} || ' | 持仓 ¥' || {_money('market_value')} AS line FROM balance
UNION ALL SELECT account, code, '  ' || code || ' ' || coalesce(s_name, '') || ' ' || held::BIGINT || '股 成本¥' || {_money('cost')} || ' 现价¥' || {_money('price')} || ' ' || printf('%+.2f%%', {q.rnd('(price / cost - 1) * 100', 2)}) || ' [' || CASE s_suppkey % 4 WHEN 0 THEN '短线' WHEN 1 THEN '中线' WHEN 2 THEN '长线' ELSE '—' END || ']'
FROM open LEFT JOIN supplier ON lpad(CAST(s_suppkey AS VARCHAR), 6, '0') = code""")
def z22_report(spark, sf_dir):
    """The report of each account: a line of its balance, and one for each position with name, cost, price, gain and horizon."""
    marked, b = _balances(spark, sf_dir)
    k = F.col("s_suppkey") % 4
    names = p.table(spark, sf_dir, "supplier").select(p.code6(F.col("s_suppkey")).alias("code"), F.col("s_name").alias("name"), F.when(k == 0, "short").when(k == 1, "medium").when(k == 2, "long").alias("horizon"))
    one = b.select("account", F.lit("").alias("code"), text.balance_line("total_assets", "cash", "market_value").alias("line"))
    return one.unionByName(marked.join(names, "code", "left").select("account", "code", text.position_line("code", "name", "held", "cost", "price", "pnl_ratio", "horizon").alias("line")))


@query("z22_order_lines", f"""SELECT l_orderkey, l_linenumber, '  ' || strftime(l_shipdate, '%H:%M') || ' ' || CASE WHEN l_returnflag = 'R' THEN '卖出' ELSE '买入' END || ' ' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || ' ' || l_quantity::BIGINT || '股 ¥' || {_money('l_extendedprice / l_quantity')} || ' [' || CASE l_linestatus WHEN 'F' THEN 'filled' ELSE 'pending' END || ']' AS line
FROM lineitem WHERE CAST(l_shipdate AS DATE) = (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)""")
def z22_lines(spark, sf_dir):
    """The orders of the last day as lines of a report."""
    li = p.table(spark, sf_dir, "lineitem")
    last = li.agg(F.max(F.to_date("l_shipdate")).alias("day"))
    day = li.join(F.broadcast(last), F.to_date("l_shipdate") == F.col("day"))  # one row
    side, status = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy"), F.when(F.col("l_linestatus") == "F", "filled").otherwise("pending")
    return day.select("l_orderkey", "l_linenumber", text.order_line("l_shipdate", side, p.code6(F.col("l_suppkey")), "l_quantity", F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0)), status).alias("line"))


@query("z21_order_states", """WITH c AS (SELECT user_id * 1000 + event_id % 3 AS order_id, ts, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'fill' WHEN 1 THEN 'cancel' WHEN 2 THEN 'reject' WHEN 3 THEN 'amend' ELSE 'place' END AS kind FROM events),
p AS (SELECT *, min(CASE WHEN kind = 'place' THEN (ts, seq) END) OVER (PARTITION BY order_id) AS placed FROM c),
g AS (SELECT order_id, min(placed) AS placed, arg_min(kind, (ts, seq)) FILTER (kind IN ('fill', 'reject', 'cancel') AND (ts, seq) > placed) AS ended, min(ts) FILTER (kind IN ('fill', 'reject', 'cancel') AND (ts, seq) > placed) AS ended_at, count(*) AS n, min(ts) FILTER (kind = 'place') AS placed_at FROM p WHERE placed IS NOT NULL GROUP BY 1)
SELECT order_id, CASE ended WHEN 'fill' THEN 'filled' WHEN 'reject' THEN 'rejected' WHEN 'cancel' THEN 'cancelled' ELSE 'pending' END AS status, round(epoch(placed_at), 3) AS placed_at, round(epoch(coalesce(ended_at, placed_at)), 3) AS changed_at, n - 1 - (ended IS NOT NULL)::BIGINT AS refused FROM g""")
def z21(spark, sf_dir):
    """Commands to place, fill, reject and cancel orders; cancels work on pending orders only."""
    e, kind = p.ticks(spark, sf_dir), F.col("event_id") % 7
    made = e.select((F.col("code") * 1000 + F.col("event_id") % 3).alias("order_id"), "ts", F.col("event_id").alias("seq"), F.when(kind == 0, "fill").when(kind == 1, "cancel").when(kind == 2, "reject").when(kind == 3, "amend").otherwise("place").alias("kind"))
    seconds = lambda c: F.round(F.unix_micros(c) / 1e6, 3).alias(c)
    return ledger.order_states(made).select("order_id", "status", seconds("placed_at"), seconds("changed_at"), "refused")


@query("a22_sellable", with_(TRADES) + "SELECT code, sum(CASE WHEN direction = 'buy' AND CAST(ts AS DATE) < DATE '2001-06-01' THEN volume WHEN direction = 'sell' THEN -volume ELSE 0 END) AS sellable FROM trades WHERE CAST(ts AS DATE) <= DATE '2001-06-01' GROUP BY code")
def a22(spark, sf_dir):
    """Bought before the day less all sold."""
    t = p.trades(spark, sf_dir).filter(F.to_date("ts") <= F.lit("2001-06-01").cast("date"))
    v = F.when((F.col("direction") == "buy") & (F.to_date("ts") < F.lit("2001-06-01").cast("date")), F.col("volume")).when(F.col("direction") == "sell", -F.col("volume")).otherwise(0.0)
    return t.groupBy("code").agg(F.sum(v).alias("sellable"))


@query("a11_attribution", with_(TRADES) + f""", r AS (SELECT code, direction, strftime(ts, '%Y-%m') AS month, {_PNL} AS pnl FROM trades)
SELECT kind, bucket, count(*) AS n, {q.rnd('avg((pnl > 0)::INT)', 3)} AS win_rate, {q.rnd('sum(pnl)', 2)} AS net_pnl FROM (SELECT 'code' AS kind, code AS bucket, pnl FROM r UNION ALL SELECT 'direction', direction, pnl FROM r UNION ALL SELECT 'month', month, pnl FROM r) GROUP BY 1, 2""")
def a11(spark, sf_dir):
    """Buckets of several groupings in one pass by grouping sets."""
    r = p.trades(spark, sf_dir).select("code", "direction", F.date_format("ts", "yyyy-MM").alias("month"), rnd((F.col("price") - 1500) * F.col("volume"), 2).alias("pnl"))
    g = r.groupingSets([["code"], ["direction"], ["month"]], "code", "direction", "month").agg(F.count("*").alias("n"), rnd(F.avg((F.col("pnl") > 0).cast("double")), 3).alias("win_rate"), rnd(F.sum("pnl"), 2).alias("net_pnl"), F.grouping_id().alias("_id"))
    kind = F.when(F.col("_id") == 3, "code").when(F.col("_id") == 5, "direction").otherwise("month")
    return g.select(kind.alias("kind"), F.coalesce("code", "direction", "month").alias("bucket"), "n", "win_rate", "net_pnl")


_CLOSED = f"closed AS (SELECT {_PNL}" + """ AS pnl, nullif(direction, 'sell') AS reason, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber::VARCHAR END AS strategy, strftime(ts, '%Y-%m') AS month, l_partkey AS k FROM trades),
marked AS (SELECT *, CASE WHEN k % 2 = 0 THEN '是' ELSE '否' END AS ma, CASE WHEN k % 3 = 0 THEN '是' ELSE '否' END AS macd, CASE WHEN k % 5 = 0 THEN '是' ELSE '否' END AS kdj, CASE k % 4 WHEN 0 THEN '超买' WHEN 1 THEN '超卖' ELSE '正常' END AS rsi, CASE WHEN k % 7 < 2 THEN '放量' ELSE '正常' END AS vol, k % 6 AS t FROM closed),
g AS (SELECT pnl, UNNEST([{'kind': 'strategy', 'bucket': coalesce(strategy, '未知')}, {'kind': 'reason', 'bucket': coalesce(reason, '未知')}, {'kind': 'month', 'bucket': month},
  {'kind': 'factor_signal', 'bucket': CASE WHEN (ma = '是' AND macd = '是') OR (kdj = '是' AND vol = '放量') THEN '强因子共振' ELSE '弱因子/AI主观' END}, {'kind': 'ma', 'bucket': '均线多头=' || ma}, {'kind': 'rsi', 'bucket': 'RSI=' || rsi}, {'kind': 'macd', 'bucket': 'MACD金叉=' || macd},
  {'kind': 'kdj', 'bucket': 'KDJ金叉=' || kdj}, {'kind': 'volume', 'bucket': '量=' || vol}, {'kind': 'turnover', 'bucket': '换手=' || CASE WHEN t < 1 THEN '<1%' WHEN t < 3 THEN '1-3%' WHEN t < 5 THEN '3-5%' ELSE '>5%' END}]) AS g FROM marked),
s AS (SELECT g.kind AS kind, g.bucket AS bucket, count(*) AS n, count_if(pnl > 0)::BIGINT AS wins, """ + f"{q.rnd('avg((pnl > 0)::INT)', 3)} AS win_rate, {q.rnd('sum(pnl)', 2)} AS net_pnl FROM g GROUP BY 1, 2)"


@query("a11_a12_attribution_report", with_(TRADES, _CLOSED) + "SELECT *, row_number() OVER (PARTITION BY kind ORDER BY net_pnl DESC, bucket)::INT AS place FROM s")
def a11_report(spark, sf_dir):
    """Count, wins, share won and net (to cents) of closed trades in ten groupings, by net."""
    t = p.trades(spark, sf_dir)
    k, yes = F.col("l_partkey"), lambda n: F.when(F.col("l_partkey") % n == 0, "是").otherwise("否")
    rsi = F.when(k % 4 == 0, "超买").when(k % 4 == 1, "超卖").otherwise("正常")
    text = F.concat(F.lit("均线多头="), yes(2), F.lit(" RSI状态="), rsi, F.lit(" MACD金叉="), yes(3), F.lit(" KDJ金叉="), yes(5), F.lit(" 成交量状态="), F.when(k % 7 < 2, "放量").otherwise("正常"), F.lit(" 换手率="), (k % 6).cast("string"), F.lit("%"))
    strategy = F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("string"))
    closed = t.select(rnd((F.col("price") - 1500) * F.col("volume"), 2).alias("pnl"), F.nullif("direction", F.lit("sell")).alias("reason"), strategy.alias("strategy"), F.date_format("ts", "yyyy-MM").alias("month"), text.alias("indicators"))
    return signals.attribution(closed)


@query("x4_order_sizing", "SELECT s_suppkey, CAST(floor(greatest(least(1e6 * 0.2, s_acctbal * 30, 1e6 * 0.05), 0) / (10 + s_suppkey % 90) / 100) * 100 AS BIGINT) AS volume FROM supplier")
def x4(spark, sf_dir):
    """Lots of 100 within the ratio, the room and the single-name cap."""
    s = p.table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", ledger.order_volume(F.lit(1e6), F.lit(0.2), F.col("s_acctbal") * 30, F.lit(0.05), (10 + F.col("s_suppkey") % 90).cast("double")).alias("volume"))


@query("x5_x6_exits", with_("e AS (SELECT user_id, event_id, ts, value / first_value(value) OVER w - 1 AS gain, CASE user_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS horizon FROM events WHERE value > 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
       "k AS (SELECT *, max(gain) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS peak FROM e)") + """SELECT user_id, event_id, CASE horizon WHEN 'short' THEN CASE WHEN gain <= -0.03 THEN 'stop_loss' WHEN gain >= 0.05 THEN 'take_profit' WHEN peak >= 0.03 AND gain <= peak - 0.02 THEN 'trailing' ELSE 'hold' END
  WHEN 'medium' THEN CASE WHEN gain <= -0.08 THEN 'stop_loss' WHEN gain >= 0.15 THEN 'take_profit' WHEN peak >= 0.08 AND gain <= peak - 0.04 THEN 'trailing' ELSE 'hold' END ELSE CASE WHEN gain <= -0.15 THEN 'stop_loss' WHEN gain >= 0.30 THEN 'take_profit' ELSE 'hold' END END AS reason FROM k""")
def x5(spark, sf_dir):
    """Stops, targets and trailing exits; the peak is a running maximum."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = p.table(spark, sf_dir, "events").filter("value > 0").withColumn("gain", F.col("value") / F.first("value").over(w) - 1)
    e = e.withColumn("peak", F.max("gain").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    horizon = F.when(F.col("user_id") % 3 == 0, "short").when(F.col("user_id") % 3 == 1, "medium").otherwise("long")
    return e.select("user_id", "event_id", ledger.exit_reason(horizon, F.col("gain"), F.col("peak")).alias("reason"))


@query("x7_circuit_breaker", with_(q.INDEX) + "SELECT date, round(close / max(close) OVER (ORDER BY date) - 1, 6) AS drawdown, CASE WHEN close / max(close) OVER (ORDER BY date) - 1 <= -0.30 THEN 90 WHEN close / max(close) OVER (ORDER BY date) - 1 <= -0.20 THEN 30 ELSE 0 END::BIGINT AS pause_days FROM idx")
def x7(spark, sf_dir):
    """Drawdown from the running peak and the pause that it brings."""
    i = p.index_series(spark, sf_dir).withColumn("account", F.lit(1))
    return ledger.circuit_breaker(i, "date", "close", F.trunc("date", "YEAR")).select("date", F.round("drawdown", 6).alias("drawdown"), "pause_days")


@query("x8_a24_sector_cap", with_(TRADES, q.INDUSTRY) + "SELECT industry, round(sum(price * volume), 2) AS value, sum(price * volume) <= 0.3 * (SELECT sum(price * volume) FROM trades WHERE direction = 'buy') AS ok FROM trades JOIN industry USING (code) WHERE direction = 'buy' GROUP BY industry")
def x8(spark, sf_dir):
    """Value by industry against 30 % of all."""
    from tessera.plans.xsection import _industry

    t = p.trades(spark, sf_dir).filter("direction = 'buy'").groupBy("code").agg(F.sum(F.col("price") * F.col("volume")).alias("v"))
    by = t.join(_industry(spark, sf_dir), "code").groupBy("industry").agg(F.sum("v").alias("v"))
    total = by.agg(F.sum("v").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("industry", F.round("v", 2).alias("value"), (F.col("v") <= 0.3 * F.col("total")).alias("ok"))


_WANTED = "((s_suppkey % 11) - 5) / 20.0::DOUBLE"


@query("g18_damped_parameters", f"SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN least(greatest(trunc({_WANTED} * 30 + 65.5::DOUBLE), 60), 70)::DOUBLE WHEN s_suppkey % 2 = 0 THEN CASE WHEN {_WANTED} >= 0 THEN -0.05 ELSE least(greatest({_WANTED}, -0.05::DOUBLE - 0.02::DOUBLE), -0.05::DOUBLE + 0.02::DOUBLE) END ELSE CASE WHEN {_WANTED} <= 0 THEN 0.2 ELSE least(greatest({_WANTED}, 0.2::DOUBLE - 0.04::DOUBLE), 0.2::DOUBLE + 0.04::DOUBLE) END END::DOUBLE AS value FROM supplier")
def g18(spark, sf_dir):
    """A parameter moves by its step at most; the confidence is a whole number within its bounds."""
    s = p.table(spark, sf_dir, "supplier")
    third, even = F.col("s_suppkey") % 3 == 2, F.col("s_suppkey") % 2 == 0
    key = F.when(third, "min_confidence").when(even, "short_stop_loss").otherwise("long_take_profit")
    now = F.when(third, 65.0).when(even, -0.05).otherwise(0.2)
    wanted = ((F.col("s_suppkey") % 11) - 5) / F.lit(20.0)
    return s.select("s_suppkey", ledger.damped(key, now, F.when(third, wanted * 30 + 65.5).otherwise(wanted)).alias("value"))


