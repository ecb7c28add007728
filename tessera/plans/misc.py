"""Queries: sources, cleaning, joins, sets, sorts, ledger reports and the contract."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import rnd
from tessera.operators.factors import price_limit
from tessera.plans import sql as q
from tessera.plans.factors import FULL, SNAP_SPEC, _SNAP, full_bars, snapshot
from tessera.plans.sql import BARS, INDEX, TRADES, with_
from tessera.registry import query
from tessera.sources import panel as p


@query("s13_s14_quote_parse", "SELECT s_suppkey, s_name AS name, s_acctbal AS price, CAST(CASE WHEN s_suppkey % 10 = 0 THEN 'short quote' END AS VARCHAR) AS error FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 0 THEN s_name END AS s_name, CASE WHEN s_suppkey % 10 <> 0 THEN s_acctbal END AS s_acctbal FROM supplier)")
def s13(spark, sf_dir):
    """Delimited quotes by position, safe casts, an error for short ones."""
    s = p.table(spark, sf_dir, "supplier")
    full = F.concat(F.lit("1~"), F.col("s_name"), F.lit("~600000~"), F.col("s_acctbal").cast("string"), F.lit("~" * 40))
    x = p.parse_quote(F.when(F.col("s_suppkey") % 10 == 0, F.lit("a~b")).otherwise(full))
    return s.select("s_suppkey", x["name"].alias("name"), x["price"].alias("price"), x["error"].alias("error"))


@query("s2_s5_prefer_source", "SELECT code, source FROM (SELECT c_custkey % 1000 AS code, 'a' AS source FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1 UNION ALL SELECT c_custkey % 1000, 'b' FROM customer WHERE c_custkey % 1000 NOT IN (SELECT c_custkey % 1000 FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1)")
def s2(spark, sf_dir):
    """A first source and what a second one adds (anti join)."""
    c = p.table(spark, sf_dir, "customer").withColumn("code", F.col("c_custkey") % 1000)
    first = c.filter("c_custkey % 3 = 0").select("code").distinct().withColumn("source", F.lit("a"))
    return p.prefer(first, c.select("code").distinct().withColumn("source", F.lit("b")), ["code"])


@query("s6_universe", "SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer WHERE NOT contains(upper(c_mktsegment), 'ST')")
def s6(spark, sf_dir):
    """Names without the special-treatment mark; six-digit codes."""
    return p.universe(p.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("name")))


@query("o6_hash_sample", "SELECT code FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer WHERE NOT contains(upper(c_mktsegment), 'ST')) ORDER BY md5('42:' || code), code LIMIT 200")
def o6(spark, sf_dir):
    """A sample of 200 by seeded hash, the same on any cluster."""
    return p.universe(p.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("name")), 200)


@query("k4_latest_wins", "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def k4(spark, sf_dir):
    """Append-only upsert, the newest row of each key."""
    o = p.latest(p.table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return o.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("p2_p3_null_guards", "SELECT c_custkey, round(c_acctbal / nullif(c_nationkey, 0), 6) AS ratio, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive FROM customer")
def p2(spark, sf_dir):
    """Zero as null before a division, conditional null."""
    return p.table(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") / F.nullif("c_nationkey", F.lit(0)), 6).alias("ratio"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("positive"))


_CODE = "lpad(CAST(CASE c_custkey % 6 WHEN 0 THEN 600000 WHEN 1 THEN 300000 WHEN 2 THEN 830000 WHEN 3 THEN 510000 WHEN 4 THEN 900000 ELSE 1 END + c_custkey % 1000 AS VARCHAR), 6, '0')"


@query("p9_p12_boards_and_prefixes", f"""SELECT c_custkey, code, CASE WHEN regexp_matches(code, '^(300|301|688)') THEN 0.2 WHEN regexp_matches(code, '^(8|4|92)') THEN 0.3 ELSE 0.1 END::DOUBLE AS price_limit,
  CASE WHEN code[1] IN ('6', '5', '9') THEN 'sh' ELSE 'sz' END || code AS market_symbol, CASE WHEN code[1] IN ('6', '9') THEN 'sh' WHEN code[1] IN ('4', '8') THEN 'bj' ELSE 'sz' END || code AS loader_symbol,
  code || CASE WHEN code[1] IN ('6', '9') THEN '.XSHG' ELSE '.XSHE' END AS exchange_symbol, code AS plain FROM (SELECT c_custkey, {_CODE} AS code FROM customer)""")
def p9(spark, sf_dir):
    """Price limits by board, the symbol rules of the sources, and a symbol back to its code."""
    k = F.col("c_custkey")
    base = F.when(k % 6 == 0, 600000).when(k % 6 == 1, 300000).when(k % 6 == 2, 830000).when(k % 6 == 3, 510000).when(k % 6 == 4, 900000).otherwise(1)
    c = p.table(spark, sf_dir, "customer").select("c_custkey", p.code6(base + k % 1000).alias("code"))
    head = F.substring("code", 1, 1)
    return c.select("c_custkey", "code", price_limit("code").alias("price_limit"), (symbol := F.concat(F.when(head.isin("6", "5", "9"), "sh").otherwise("sz"), "code")).alias("market_symbol"),
                    F.concat(F.when(head.isin("6", "9"), "sh").when(head.isin("4", "8"), "bj").otherwise("sz"), "code").alias("loader_symbol"), F.concat("code", F.when(head.isin("6", "9"), ".XSHG").otherwise(".XSHE")).alias("exchange_symbol"), p.plain_code(F.concat(F.lit(" "), symbol)).alias("plain"))


@query("p13_quality_rules", with_(BARS, FULL) + """, a AS (SELECT code, count(*) AS n, count(close) AS c, count(volume) AS v, count_if(high < low) AS hl, count_if(high < greatest(open, close) OR low > least(open, close)) AS ohlc, quantile_cont(abs(pct_chg), 0.999::DOUBLE) AS p999 FROM full_bars GROUP BY code)
SELECT code, n, CASE WHEN (n - c) / n::DOUBLE > 0.05 THEN 1 ELSE 0 END + CASE WHEN v / n::DOUBLE < 0.95 THEN 1 ELSE 0 END + CASE WHEN hl > 0 THEN 1 ELSE 0 END + CASE WHEN ohlc > 0 THEN 1 ELSE 0 END + CASE WHEN p999 > 20 THEN 1 ELSE 0 END AS n_issues FROM a""")
def p13(spark, sf_dir):
    """Missing closes and volumes, inconsistent prices, jumps; issues as an array."""
    b = full_bars(spark, sf_dir)
    a = b.groupBy("code").agg(F.count("*").alias("n"), F.count("close").alias("c"), F.count("volume").alias("v"), F.count_if(F.col("high") < F.col("low")).alias("hl"),
                              F.count_if((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("ohlc"), F.percentile(F.abs("pct_chg"), 0.999).alias("p999"))
    issues = F.array_compact(F.array(F.when((F.col("n") - F.col("c")) / F.col("n") > 0.05, "missing_close"), F.when(F.col("v") / F.col("n") < 0.95, "missing_volume"), F.when(F.col("hl") > 0, "high_below_low"), F.when(F.col("ohlc") > 0, "inconsistent"), F.when(F.col("p999") > 20, "jumps")))
    return a.select("code", "n", F.size(issues).alias("n_issues"))


@query("j1_j2_m32_snapshot_build", with_(_SNAP, "cache AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity)) AS last_pb FROM lineitem GROUP BY 1)") + "SELECT code, round(coalesce(CASE WHEN pb > 2 THEN pb END, last_pb), 6) AS pb, industry FROM snap LEFT JOIN cache USING (code) LEFT JOIN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey) USING (code)")
def j1(spark, sf_dir):
    """Snapshot with earnings side and the last known ratio where one is missing."""
    s = p.ensure_columns(snapshot(spark, sf_dir), SNAP_SPEC)
    last = p.table(spark, sf_dir, "lineitem").groupBy(p.code6(F.col("l_suppkey")).alias("code")).agg(F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).alias("last_pb"))
    sup, nat = p.table(spark, sf_dir, "supplier"), p.table(spark, sf_dir, "nation")
    names = sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey).select(p.code6(F.col("s_suppkey")).alias("code"), F.col("n_name").alias("industry"))
    return s.join(last, "code", "left").join(names, "code", "left").select("code", F.round(F.coalesce(F.when(F.col("pb") > 2, F.col("pb")), "last_pb"), 6).alias("pb"), "industry")


@query("j18_a31_latest_scan", "SELECT event_id, user_id, value FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) ORDER BY value DESC, event_id LIMIT 10")
def j18(spark, sf_dir):
    """Rows of the latest scan, top ten."""
    e = p.table(spark, sf_dir, "events")
    last = e.agg(F.max(F.to_date("ts")).alias("d"))
    return e.join(F.broadcast(last), F.to_date("ts") == F.col("d")).orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "user_id", "value")


@query("a14_month_coverage", "SELECT o_custkey, count(DISTINCT date_trunc('month', o_orderdate)) AS months, round(count(DISTINCT date_trunc('month', o_orderdate)) / 36.0::DOUBLE, 6) AS share FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01' GROUP BY 1")
def a14(spark, sf_dir):
    """Share of 36 months with a report."""
    o = p.table(spark, sf_dir, "orders").filter("o_orderdate >= '1996-01-01' AND o_orderdate < '1999-01-01'")
    return o.groupBy("o_custkey").agg(F.countDistinct(F.trunc("o_orderdate", "MM")).alias("months")).withColumn("share", F.round(F.col("months") / 36.0, 6))


@query("a25_resampled_bars", with_(BARS) + """SELECT code, kind, CAST(period AS DATE) AS period, """ + ", ".join(f"{q.rnd(e, 4)} AS {n}" for n, e in [("open", "arg_min(open, date)"), ("high", "max(high)"), ("low", "min(low)"), ("close", "arg_max(close, date)")]) + """, sum(volume) AS volume, max(date) AS last_date FROM (SELECT *, 'week' AS kind, date_trunc('week', date) AS period FROM bars UNION ALL SELECT *, 'month', date_trunc('month', date) FROM bars) GROUP BY 1, 2, 3""")
def a25(spark, sf_dir):
    """Weekly (ending on Sunday) and monthly bars."""
    b = p.bars(spark, sf_dir).withColumn("k", F.explode(F.array(F.struct(F.lit("week").alias("kind"), F.trunc("date", "week").alias("period")), F.struct(F.lit("month").alias("kind"), F.trunc("date", "MM").alias("period")))))
    return b.groupBy("code", "k.kind", "k.period").agg(rnd(F.min_by("open", "date"), 4).alias("open"), rnd(F.max("high"), 4).alias("high"), rnd(F.min("low"), 4).alias("low"), rnd(F.max_by("close", "date"), 4).alias("close"), F.sum("volume").alias("volume"), F.max("date").alias("last_date"))


@query("s15_minute_bars", "WITH t AS (SELECT user_id AS code, ts, event_id, value AS price FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL), sizes(minutes, most) AS (VALUES (5, 240), (15, 160), (30, 120), (60, 120)), "
       "b AS (SELECT code, minutes, most, time_bucket(to_minutes(minutes), ts) AS start, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, count(*) AS volume FROM t CROSS JOIN sizes GROUP BY ALL) "
       "SELECT code, minutes, strftime(b.start, '%Y-%m-%d %H:%M') AS start, open, high, low, close, volume FROM b QUALIFY row_number() OVER (PARTITION BY code, minutes ORDER BY b.start DESC) <= most")
def s15(spark, sf_dir):
    """Bars of 5, 15, 30 and 60 minutes of each code, the newest 240, 160, 120 and 120 of them."""
    most = F.element_at(F.create_map(*[F.lit(x) for pair in p.BAR_TAILS.items() for x in pair]), F.col("minutes"))
    return p.tail(p.minute_bars(p.ticks(spark, sf_dir), list(p.BAR_TAILS)), ["code", "minutes"], "start", most, max(p.BAR_TAILS.values())).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("s8_s9_spot_snapshot", """WITH one AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS close, abs(c_acctbal) * 1000 AS total_mv, c_nationkey * 1e6 AS circ_mv, c_acctbal / 50 AS pe, c_acctbal / 500 AS pb FROM customer WHERE c_custkey % 3 <> 0),
two AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_name AS name, c_acctbal AS close, (c_nationkey + 0.5::DOUBLE) * 1e8 AS total_mv, c_nationkey * 1e8 AS circ_mv, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 50 END AS pe, CAST(NULL AS DOUBLE) AS pb FROM customer WHERE c_custkey % 3 = 0),
eps AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_acctbal / 100 AS roe, s_acctbal / 1000 AS eps, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT code, name, """ + ", ".join(f"{q.rnd(c, 4)} AS {c}" for c in ("close", "total_mv", "circ_mv", "pe", "pb", "roe", "eps")) + ", CAST(NULL AS DOUBLE) AS gross_margin, industry FROM (SELECT * FROM one UNION ALL SELECT * FROM two) LEFT JOIN eps USING (code)")
def s8(spark, sf_dir):
    """A spot snapshot whose missing codes come from a second source in other units and symbols, with the earnings table beside it."""
    c = p.table(spark, sf_dir, "customer")
    first = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, "-").otherwise(F.col("c_acctbal").cast("string")).alias("price"),
                                                  (F.abs("c_acctbal") * 1000).alias("market_value"), (F.col("c_nationkey") * 1e6).alias("float_value"), (F.col("c_acctbal") / 50).alias("pe_dynamic"), (F.col("c_acctbal") / 500).alias("pb"))
    second = c.select(F.concat(F.lit("sz"), p.code6(F.col("c_custkey"))).alias("symbol"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("zxj"), (F.col("c_nationkey") + 0.5).alias("zsz"), F.col("c_nationkey").alias("ltsz"),
                      F.when(F.col("c_custkey") % 4 == 0, "").otherwise((F.col("c_acctbal") / 50).cast("string")).alias("pe_ttm"))
    s, n = p.table(spark, sf_dir, "supplier"), p.table(spark, sf_dir, "nation")
    reported = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("short_name"), (F.col("s_acctbal") / 100).alias("roe_weighted"), (F.col("s_acctbal") / 1000).alias("eps"), F.col("n_name").alias("industry"))
    spot = p.spot_snapshot(first, second).join(p.earnings(reported).drop("name", "bps"), "code", "left")
    return spot.select("code", "name", *[rnd(x, 4).alias(x) for x in ("close", "total_mv", "circ_mv", "pe", "pb", "roe", "eps")], "gross_margin", "industry")


@query("a27_index_average", with_(INDEX) + "SELECT round(avg(p), 6) AS avg_pct FROM (SELECT (close / lag(close) OVER (ORDER BY date) - 1) * 100 AS p FROM idx)")
def a27(spark, sf_dir):
    """Mean change of the index."""
    i = p.index_series(spark, sf_dir)
    return i.select(((F.col("close") / F.lag("close").over(Window.orderBy("date")) - 1) * 100).alias("p")).agg(F.round(F.avg("p"), 6).alias("avg_pct"))


@query("a28_pending_counts", with_(TRADES) + "SELECT CAST(count_if(l_orderkey > 1000) AS BIGINT) AS pending, count_if(l_orderkey > 1000) >= 20 AS ready FROM trades WHERE direction = 'sell'")
def a28(spark, sf_dir):
    """Sells after a watermark id."""
    return p.trades(spark, sf_dir).filter("direction = 'sell'").agg(F.count_if(F.col("l_orderkey") > 1000).alias("pending"), (F.count_if(F.col("l_orderkey") > 1000) >= 20).alias("ready"))


@query("o5_tercile_sample", "SELECT c_custkey, tercile FROM (SELECT *, row_number() OVER (PARTITION BY tercile ORDER BY (c_custkey * 7919) % 10007, c_custkey) AS pick FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) // ((SELECT count(*) FROM customer) // 3 + 1) AS tercile FROM customer)) WHERE pick <= 10")
def o5(spark, sf_dir):
    """Ten of each third by size. Places are numbered within a thousand ranges of the size, after the counts of the ranges before."""
    c = p.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    ends = c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.count("*").alias("n"))
    part = F.least(F.floor((F.col("c_acctbal") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 1000), F.lit(999))
    c = c.crossJoin(F.broadcast(ends)).withColumn("part", F.coalesce(part, F.lit(0)))
    before = F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    bases = c.groupBy("part").agg(F.count("*").alias("k")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("c_acctbal", "c_custkey")) - 1
    t = c.withColumn("place", place).join(F.broadcast(bases), "part").withColumn("tercile", F.floor((F.col("base") + F.col("place")) / (F.floor(F.col("n") / 3) + 1)))
    w = Window.partitionBy("tercile").orderBy((F.col("c_custkey") * 7919) % 10007, "c_custkey")
    return t.withColumn("pick", F.row_number().over(w)).filter("pick <= 10").select("c_custkey", "tercile")


@query("u1_u3_set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem) UNION ALL SELECT 'either', count(*) FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem) UNION ALL SELECT 'shipped_only', count(*) FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders)")
def u1(spark, sf_dir):
    """Union, intersection and difference of dates."""
    a = p.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    b = p.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    one = lambda k, df: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return one("both", a.intersect(b)).unionByName(one("either", a.union(b).distinct())).unionByName(one("shipped_only", b.exceptAll(a)))


@query("g19_x11_json_payload", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN 'filled' ELSE 'rejected' END AS status FROM events")
def g19(spark, sf_dir):
    """A JSON block out of text, alias keys, status codes to names."""
    e = p.table(spark, sf_dir, "events")
    text = F.concat(F.lit("reply: "), "props", F.lit(" end"))
    block = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "k bigint, key bigint")
    names = F.create_map(*[F.lit(x) for x in ("0", "filled", "1", "rejected")])
    return e.select("event_id", F.coalesce(block["k"], block["key"]).alias("k"), F.try_element_at(names, (F.col("event_id") % 2).cast("string")).alias("status"))


@query("g16_s19_recent_policies", with_(INDEX) + "SELECT kind, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'rate' WHEN 1 THEN 'plan' ELSE 'tax' END AS kind FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT max(date) - 5 FROM idx)) GROUP BY 1")
def g16(spark, sf_dir):
    """Types of the last five days."""
    o = p.table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    last = o.agg(F.date_sub(F.max("d"), 5).alias("from"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "rate").when(F.col("o_orderkey") % 3 == 1, "plan").otherwise("tax")
    return o.join(F.broadcast(last), F.col("d") >= F.col("from")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("x9_session_calendar", """SELECT event_id, day AS trading_day, day AND inside AS is_open, CASE WHEN day AND inside THEN 0 ELSE greatest(0, floor(epoch(target) - epoch(ts)))::BIGINT END AS seconds_to_open FROM (
  SELECT *, isodow(ts) < 6 AS day, (strftime(ts, '%H%M') BETWEEN '0930' AND '1130' OR strftime(ts, '%H%M') BETWEEN '1300' AND '1500') AS inside, CASE WHEN isodow(ts) >= 6 THEN date_trunc('day', ts) + to_days((8 - isodow(ts))::INT) + INTERVAL '9 hours 30 minutes'
    WHEN strftime(ts, '%H%M') < '0930' THEN date_trunc('day', ts) + INTERVAL '9 hours 30 minutes' WHEN strftime(ts, '%H%M') < '1300' THEN date_trunc('day', ts) + INTERVAL '13 hours' ELSE date_trunc('day', ts) + to_days((CASE isodow(ts) WHEN 5 THEN 3 ELSE 1 END)::INT) + INTERVAL '9 hours 30 minutes' END AS target FROM events)""")
def x9(spark, sf_dir):
    """Week days, the two sessions, and the seconds to the next one (0 within one)."""
    e = p.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    weekday, at = F.weekday("ts"), F.date_format("ts", "HHmm")
    inside = (weekday < 5) & (at.between("0930", "1130") | at.between("1300", "1500"))
    ahead = F.when(weekday >= 5, 7 - weekday).when(at < "1300", 0).when(weekday == 4, 3).otherwise(1)
    opening = F.when((weekday < 5) & (at >= "0930") & (at < "1300"), 13 * 3600).otherwise(9 * 3600 + 1800)
    left = F.unix_seconds(F.date_add(F.to_date("ts"), ahead).cast("timestamp")) + opening - F.unix_micros("ts") / F.lit(1e6)
    return e.select("event_id", (weekday < 5).alias("trading_day"), inside.alias("is_open"), F.when(inside, 0).otherwise(F.greatest(F.lit(0), F.floor(left))).cast("long").alias("seconds_to_open"))


@query("x15_backfill_names", "SELECT user_id, event_id, coalesce(nullif(CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END, ''), first_value(nullif(CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS name FROM events")
def x15(spark, sf_dir):
    """An empty name takes the code's first known one."""
    e = p.table(spark, sf_dir, "events").withColumn("n", F.when(F.col("event_id") % 4 == 0, F.nullif("event_type", F.lit(""))))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return e.select("user_id", "event_id", F.coalesce("n", F.first("n", ignorenulls=True).over(w)).alias("name"))


@query("z15_z19_value_tilt", with_(_SNAP) + "SELECT code, CASE WHEN 1 / nullif(pb, 0) >= 0.75 THEN 'cheap' WHEN 1 / nullif(pb, 0) < 0.25 THEN 'dear' ELSE 'fair' END AS tilt FROM snap")
def z15(spark, sf_dir):
    """Tilt by book to price."""
    bp = 1 / F.nullif("pb", F.lit(0.0))
    return p.ensure_columns(snapshot(spark, sf_dir), SNAP_SPEC).select("code", F.when(bp >= 0.75, "cheap").when(bp < 0.25, "dear").otherwise("fair").alias("tilt"))


@query("z22_day_orders", with_(TRADES) + "SELECT direction, count(*) AS n, round(sum(price * volume), 2) AS amount FROM trades WHERE CAST(ts AS DATE) = DATE '1998-06-01' GROUP BY 1")
def z22(spark, sf_dir):
    """One day's orders."""
    t = p.trades(spark, sf_dir).filter(F.to_date("ts") == F.lit("1998-06-01").cast("date"))
    return t.groupBy("direction").agg(F.count("*").alias("n"), F.round(F.sum(F.col("price") * F.col("volume")), 2).alias("amount"))


@query("extra_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extra_cube(spark, sf_dir):
    return p.table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("extra_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, " + q.rnd("sum(l_extendedprice * (1 - l_discount))", 1) + " AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def extra_pricing(spark, sf_dir):
    x = p.table(spark, sf_dir, "lineitem").filter("l_shipdate <= '1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), rnd(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"), F.count("*").alias("n"))
