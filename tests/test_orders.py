"""Order commands, balances and report lines by hand."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ledger

T0 = dt.datetime(2024, 1, 2, 9, 30)


def commands(spark, rows):
    return spark.createDataFrame([(o, None if m is None else T0 + dt.timedelta(minutes=m), s, k) for o, m, s, k in rows], "order_id string, ts timestamp, seq long, kind string")


def test_order_states(spark):
    rows = [("a", 0, 1, "place"), ("a", 5, 2, "cancel"), ("a", 6, 3, "fill"),  # cancelled, the fill is refused
            ("b", 0, 4, "place"), ("b", 5, 5, "fill"), ("b", 6, 6, "cancel"),  # filled, the cancel is refused
            ("c", 0, 7, "cancel"), ("c", 1, 8, "place"),  # a cancel before the order
            ("d", 0, 9, "cancel"),  # never placed
            ("e", 0, 11, "cancel"), ("e", 0, 10, "place"), ("e", 0, 12, "reject"),  # one time: by seq
            ("f", 0, 13, "place"), ("f", 1, 14, "place"), ("f", 2, 15, "amend"), ("f", 3, 16, None),
            (None, 0, 17, "place"), ("g", None, 18, "place")]
    got = {r.order_id: (r.status, (r.changed_at - T0).seconds // 60, r.refused) for r in ledger.order_states(commands(spark, rows)).collect()}
    assert got == {"a": ("cancelled", 5, 1), "b": ("filled", 5, 1), "c": ("pending", 1, 1), "e": ("cancelled", 0, 1), "f": ("pending", 0, 3)}
    assert ledger.order_states(commands(spark, [])).count() == 0


def test_a_hot_order(spark):
    """A third of all commands are of one order: it is scanned by buckets, reduced in each task, and counted whole."""
    many = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("order_id"), (F.lit(T0) + F.make_dt_interval(mins=(F.col("id") / 1000).cast("int"))).alias("ts"),
                                      F.col("id").alias("seq"), F.when(F.col("id") == 29_997, "cancel").otherwise("place").alias("kind"))
    out = ledger.order_states(many)
    hot = out.filter("order_id = 'hot'").first()
    assert (hot.status, hot.refused, out.count()) == ("cancelled", 9_998, 20_001)


def test_balances(spark):
    accounts = spark.createDataFrame([(1, 100.0), (2, 50.0), (3, 0.0)], "account int, cash double")
    held = spark.createDataFrame([(1, "a", 10.0, 5.0), (1, "b", 20.0, 2.5)], "account int, code string, held double, price double")
    got = {r.account: (r.cash, r.market_value, r.total_assets, r.positions_count, r.exposure) for r in ledger.balances(accounts, held).collect()}
    assert got == {1: (100.0, 100.0, 200.0, 2, 0.5), 2: (50.0, 0.0, 50.0, 0, 0.0), 3: (0.0, 0.0, 0.0, 0, None)}


def test_values_add_up_in_one_order(spark):
    """a market value on half a cent: added from the last place on, whatever the order of the rows."""
    held = [(1, 0, "d", 1.0, 567391.08), (1, 1, "a", 3.0, 13325.266667 / 3), (1, 2, "b", 7.0, 16670.371667 / 7), (1, 3, "c", 6.0, 36692.976667 / 6)]
    accounts = spark.createDataFrame([(1, 0.0)], "account int, cash double")
    want = 0.0
    for row in reversed(held):
        want += row[4] * row[3]
    for rows in (held, held[::-1], [held[i] for i in (2, 0, 3, 1)], [held[i] for i in (1, 3, 0, 2)]):
        frame = spark.createDataFrame(rows, "account int, place int, code string, held double, price double").repartition(1)
        assert ledger.balances(accounts, frame).first().market_value == want


def test_positions_keep_the_order_of_their_first_buys(spark):
    """a later trade of a code leaves its place."""
    rows = spark.createDataFrame([("a", i, dt.datetime(2024, 1, 1 + i, 10), c, k, 10.0, v) for i, (c, k, v) in enumerate([("x", "buy", 5.0), ("y", "buy", 5.0), ("x", "buy", 5.0), ("z", "buy", 1.0), ("y", "sell", 2.0)])],
                                 "account string, id int, ts timestamp, code string, direction string, price double, volume double")
    done = ledger.account_ledger(rows, ["id"], 1000.0)
    prices = spark.createDataFrame([(k, 1.0) for k in "xyz"], "code string, price double")
    assert [(r.code, r.held) for r in ledger.marked_positions(done, prices).orderBy("place").collect()] == [("x", 10.0), ("y", 3.0), ("z", 1.0)]


def test_lines(spark):
    one = spark.range(1).select(text.balance_line(F.lit(1234567.891), F.lit(None).cast("double"), F.lit(-5.0)).alias("a"),
                                text.position_line(F.lit("000001"), F.lit(None).cast("string"), F.lit(300.0), F.lit(9.5), F.lit(10.0), F.lit(5.263), F.lit("medium")).alias("b"),
                                text.position_line(F.lit("000002"), F.lit("x"), F.lit(100.0), F.lit(9.5), F.lit(9.0), F.lit(-5.263), F.lit("")).alias("c"),
                                text.order_line(F.lit(T0), F.lit("sell"), F.lit("000001"), F.lit(200.0), F.lit(1000.0), F.lit("filled")).alias("d"), text.horizon(F.lit("week")).alias("e")).first()
    assert one.a == "总资产 ¥1,234,567.89 | 现金 ¥0.00 | 持仓 ¥-5.00"
    assert one.b == "  000001  300股 成本¥9.50 现价¥10.00 +5.26% [中线]"
    assert one.c == "  000002 x 100股 成本¥9.50 现价¥9.00 -5.26% [—]"
    assert one.d == "  09:30 卖出 000001 200股 ¥1,000.00 [filled]" and one.e == "week"
