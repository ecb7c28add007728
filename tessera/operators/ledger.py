"""Ledger replay and risk limits: what depends on the order of events is one fold a code, the rest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import fifo_lots
from tessera.operators.scans import drawdowns, running

#: The fees of a buy and of a sell, as shares of the turnover.
BUY_COST, SELL_COST = 0.0003, 0.0013


def replay(trades: DataFrame, order: list[str]) -> DataFrame:
    """Average cost and realized profit of each trade of a code in order; a sell beyond the position or bought the same day is rejected.

    The state is three numbers, so a fold over an ordered array stays in the JVM. One code's trades are one value of a row.
    """
    step = F.struct(*order, "direction", "price", "volume", F.to_date("ts").alias("day"))
    zero = F.struct(F.lit(0.0).alias("held"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("pnl"), F.lit(0.0).alias("today"), F.lit(None).cast("date").alias("day"), F.lit(0).cast("long").alias("rejected"), F.lit(0).cast("long").alias("filled"))

    def fold(s, x):
        today = F.when(s["day"].eqNullSafe(x["day"]), s["today"]).otherwise(F.lit(0.0))
        buy = x["direction"] == "buy"
        sellable = s["held"] - today >= x["volume"]
        held = F.when(buy, s["held"] + x["volume"]).when(sellable, s["held"] - x["volume"]).otherwise(s["held"])
        cost = F.when(buy, (s["held"] * s["cost"] + x["volume"] * x["price"]) / F.nullif(s["held"] + x["volume"], F.lit(0.0))).when(held == 0, F.lit(0.0)).otherwise(s["cost"])
        gain = F.when(~buy & sellable, (x["price"] - s["cost"]) * x["volume"]).otherwise(F.lit(0.0))
        bad = (~buy & ~sellable).cast("long")
        return F.struct(held.alias("held"), cost.alias("cost"), (s["pnl"] + gain).alias("pnl"), F.when(buy, today + x["volume"]).otherwise(today).alias("today"), x["day"].alias("day"), (s["rejected"] + bad).alias("rejected"), (s["filled"] + 1 - bad).alias("filled"))

    folded = trades.groupBy("code").agg(F.aggregate(F.array_sort(F.collect_list(step)), zero, fold).alias("s"))
    return folded.select("code", "s.held", "s.cost", "s.pnl", "s.rejected", "s.filled")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's argument is, an expression that a lambda repeats is computed each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_POSITIONS = "map<string, struct<held: double, cost: double, today: double, day: date>>"


def account_ledger(trades: DataFrame, order: list[str], cash: float, start: DataFrame | None = None) -> DataFrame:
    """Accounts after all their trades in order: ``account``, ``cash``, ``pnl``, ``filled``, ``no_cash``, ``no_shares``, ``positions``.

    A buy costs its value and BUY_COST and is rejected when the cash is short; a sell brings its value less SELL_COST and
    is rejected beyond what is held and was not bought the same day. Each step depends on the one before, so an
    account is one fold over its ordered trades; accounts run side by side.

    ``start`` is a ledger as this function gives it, written at an earlier cut: its accounts go on from there with ``trades`` later than the cut, so what an account
    has traded before never comes back. Accounts without new trades stay as they are, new ones begin with ``cash``. Closed positions are dropped as the fold goes: a
    step costs the open positions of the account. Open positions stand in the order of their first buys.
    """
    step = F.struct(F.struct(*order).alias("at"), "code", "direction", "price", "volume", F.to_date("ts").alias("day"))
    none, zero_ = F.lit(0).cast("long"), F.lit(0.0)
    zero = F.struct(F.lit(cash).alias("cash"), F.create_map().cast(_POSITIONS).alias("positions"), F.lit(0.0).alias("pnl"), none.alias("filled"), none.alias("no_cash"), none.alias("no_shares"))

    def fold(s, x):
        return _let(F.try_element_at(s["positions"], x["code"]), lambda own: _let(
            F.struct(F.coalesce(own["held"], zero_).alias("held"), F.coalesce(own["cost"], zero_).alias("cost"), F.when(own["day"].eqNullSafe(x["day"]), own["today"]).otherwise(zero_).alias("today"),
                     (x["price"] * x["volume"]).alias("value"), (x["direction"] == "buy").alias("buy")),
            lambda h: _let(F.when(h["buy"], s["cash"] >= h["value"] * (1 + BUY_COST)).otherwise(h["held"] - h["today"] >= x["volume"]), lambda done: F.when(done, filled(s, x, own, h)).otherwise(rejected(s, h)))))

    def filled(s, x, own, h):
        now = F.when(h["buy"], h["held"] + x["volume"]).otherwise(h["held"] - x["volume"])
        mean = F.when(h["buy"], (h["held"] * h["cost"] + h["value"]) / F.nullif(h["held"] + x["volume"], zero_)).otherwise(h["cost"])
        entry = F.struct(now.alias("held"), mean.alias("cost"), F.when(h["buy"], h["today"] + x["volume"]).otherwise(h["today"]).alias("today"), x["day"].alias("day"))
        kept = F.map_filter(s["positions"], lambda k, v: (k == x["code"]) | (v["held"] > 0))
        positions = F.when(own.isNull(), F.map_concat(kept, F.create_map(x["code"], entry))).otherwise(F.transform_values(kept, lambda k, v: F.when(k == x["code"], entry).otherwise(v)))
        return F.struct(
            F.when(h["buy"], s["cash"] - h["value"] * (1 + BUY_COST)).otherwise(s["cash"] + h["value"] * (1 - SELL_COST)).alias("cash"), positions.alias("positions"),
            F.when(h["buy"], s["pnl"]).otherwise(s["pnl"] + (x["price"] - h["cost"]) * x["volume"]).alias("pnl"), (s["filled"] + 1).alias("filled"), s["no_cash"].alias("no_cash"), s["no_shares"].alias("no_shares"))

    def rejected(s, h):
        buy = h["buy"].cast("long")
        return F.struct(s["cash"].alias("cash"), s["positions"].alias("positions"), s["pnl"].alias("pnl"), s["filled"].alias("filled"), (s["no_cash"] + buy).alias("no_cash"), (s["no_shares"] + 1 - buy).alias("no_shares"))

    steps = trades.groupBy("account").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    if start is None:
        return steps.select("account", F.aggregate("steps", zero, fold).alias("s")).select("account", "s.*")
    kept = start.select("account", F.struct("cash", F.col("positions").cast(_POSITIONS).alias("positions"), "pnl", "filled", "no_cash", "no_shares").alias("kept"))
    both = steps.join(kept, "account", "full").withColumn("steps", F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)))
    return both.select("account", F.aggregate("steps", F.coalesce("kept", zero), fold).alias("s")).select("account", "s.*")


def marked_positions(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """Open positions of ``account_ledger`` at ``prices`` (code, price): value gained and percent on the average cost.

    A code without a price is taken at its cost. ``place`` is the position's place in the account's map.
    """
    open_ = ledger.select("account", F.posexplode("positions").alias("place", "code", "own")).filter("own.held > 0").select("account", "place", "code", "own.held", "own.cost")
    priced = open_.join(prices, "code", "left").withColumn("price", F.coalesce("price", "cost"))
    ratio = F.when(F.col("cost") > 0, (F.col("price") / F.nullif("cost", F.lit(0.0)) - 1) * 100).otherwise(0.0)
    return priced.withColumns({"unrealized": (F.col("price") - F.col("cost")) * F.col("held"), "pnl_ratio": ratio})


def balances(ledger: DataFrame, positions: DataFrame) -> DataFrame:
    """Each account of ``account_ledger`` with its ``marked_positions`` summed: ``account``, ``cash``, ``market_value``, ``total_assets``, ``positions_count``, ``exposure``.

    An account without open positions keeps its cash and has 0 of the rest; ``exposure`` is null where the assets are 0. Values are added from the last ``place`` to
    the first (without one, from the last code), so a sum that ends on half a cent is the same in every run. An account's open positions are one value of a row.
    """
    place = "place" if "place" in positions.columns else "code"
    parts = F.sort_array(F.collect_list(F.struct(F.col(place), (F.col("price") * F.col("held")).alias("v"))), asc=False)
    held = positions.groupBy("account").agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.coalesce(x["v"], F.lit(0.0))).alias("market_value"), F.count("*").alias("positions_count"))
    both = ledger.select("account", "cash").join(held, "account", "left").fillna(0, ["market_value", "positions_count"])
    both = both.withColumn("total_assets", F.col("cash") + F.col("market_value"))
    return both.withColumn("exposure", F.col("market_value") / F.nullif("total_assets", F.lit(0.0)))


#: Commands that end an order, with the status that they leave.
ORDER_ENDS = {"fill": "filled", "reject": "rejected", "cancel": "cancelled"}


def order_states(commands: DataFrame, bucket=None) -> DataFrame:
    """What commands (order_id, ts, seq, kind) leave of each order: ``order_id``, ``status``, ``placed_at``, ``changed_at``, ``refused``.

    An order is pending from its first ``place`` on, until the first of ORDER_ENDS after it; a cancel works on a pending order only. Every other command is refused and
    counted: a second ``place``, an end before the first or after an end, an unknown kind. Commands of one time go by ``seq``. An order that was never placed
    has no row. Commands without order or time count nowhere. The first ``place`` is carried along by buckets of time (hours if none is given), and what
    is left is one aggregate with partial sums: no task holds all commands of an order.
    """
    good = commands.filter("order_id is not null and ts is not null").withColumn("at", F.struct("ts", "seq"))
    told = running(good, ["order_id"], F.date_trunc("HOUR", "ts") if bucket is None else bucket, ["at"], {"placed": ("min", F.when(F.col("kind") == "place", F.col("at")))})
    ends = (F.col("at") > F.col("placed")) & F.col("kind").isin(*ORDER_ENDS)
    names = F.create_map(*[F.lit(x) for pair in ORDER_ENDS.items() for x in pair])
    first = F.min(F.when(ends, F.struct("at", "kind")))
    out = told.groupBy("order_id").agg(F.min("placed").alias("placed"), first.alias("end"), F.count("*").alias("n")).filter("placed is not null")
    return out.select("order_id", F.coalesce(F.element_at(names, F.col("end.kind")), F.lit("pending")).alias("status"), F.col("placed.ts").alias("placed_at"), F.coalesce("end.at.ts", "placed.ts").alias("changed_at"),
                      (F.col("n") - 1 - F.col("end").isNotNull().cast("long")).alias("refused"))


def timed_fifo(trades: DataFrame, order: list[str], bucket=None) -> DataFrame:
    """Realized profit per sell against earlier buys only: ``code``, ``id``, ``matched``, ``pnl``; what no earlier buy covers is dropped (``matched`` tells).

    Lots come from ``fifo_lots`` with reflected running sums, so no code's trades are gathered in one place.
    """
    lots = fifo_lots(trades, "code", order, bucket=bucket, strict=True, keep=("price",))
    covered = F.when(F.col("buy_id").isNotNull(), F.col("alloc")).otherwise(0.0)
    gain = covered * F.coalesce(F.col("sell_price") - F.col("buy_price"), F.lit(0.0))
    return lots.groupBy("code", F.col("sell_id").alias("id")).agg(F.sum(covered).alias("matched"), F.sum(gain).alias("pnl"))


def closed_shares(lots: DataFrame, sells: DataFrame) -> DataFrame:
    """Each lot of ``joins.fifo_lots`` with its share of the sell's ``pnl`` by volume: ``buy_id``, ``sell_id``, ``alloc``, ``pnl``, ``reason``; a rest without a buy takes its share too.

    ``sells`` has the key of the lots, ``id``, ``pnl`` and ``reason``; null profits are 0.
    """
    key = lots.columns[0]
    told = sells.select(key, F.col("id").alias("sell_id"), F.coalesce("pnl", F.lit(0.0)).alias("_pnl"), "reason")
    share = F.coalesce(F.col("alloc") / F.nullif("sold", F.lit(0.0)), F.lit(0.0))
    return lots.join(told, [key, "sell_id"]).select(key, "sell_id", "buy_id", "alloc", (F.col("_pnl") * share).alias("pnl"), "reason")


def order_volume(assets: Column, ratio: Column, room: Column, cap: Column, price: Column) -> Column:
    """Shares in lots of 100 of the least of the wanted value, the room and the single-name cap."""
    value = F.least(assets * ratio, room, assets * cap)
    return (F.floor(F.greatest(value, F.lit(0.0)) / F.nullif(price, F.lit(0.0)) / 100) * 100).cast("long")


#: Stop loss and take profit by horizon, trailing activation and drawdown (long: none).
STOPS = {"short": (-0.03, 0.05, 0.03, 0.02), "medium": (-0.08, 0.15, 0.08, 0.04), "long": (-0.15, 0.30, None, None)}


def exit_reason(horizon: Column, gain: Column, peak: Column) -> Column:
    """stop_loss, take_profit, trailing or hold; ``peak`` is the running maximum of the gain."""
    out = F.lit("hold")
    for name, (stop, take, active, fall) in STOPS.items():
        trailing = (peak >= active) & (gain <= peak - fall) if active is not None else F.lit(False)
        out = F.when(horizon == name, F.when(gain <= stop, "stop_loss").when(gain >= take, "take_profit").when(trailing, "trailing").otherwise("hold")).otherwise(out)
    return out


def circuit_breaker(assets: DataFrame, order: str, value: str, bucket=None) -> DataFrame:
    """Running peak, drawdown and pause in days: 90 from -30 %, 30 from -20 %. Each ``account`` is a series; ``bucket`` as in ``scans.running``."""
    fallen = drawdowns(assets, ["account"], F.lit(0) if bucket is None else bucket, [order], value)
    return fallen.withColumn("pause_days", F.when(F.col("drawdown") <= -0.30, 90).when(F.col("drawdown") <= -0.20, 30).otherwise(0).cast("long"))


#: The most that one review may move a parameter.
DAMP = {"short_stop_loss": 0.02, "short_take_profit": 0.02, "mid_stop_loss": 0.03, "mid_take_profit": 0.03, "long_stop_loss": 0.04, "long_take_profit": 0.04}


#: The step of the confidence and its bounds.
DAMP_CONFIDENCE, CONFIDENCE_BOUNDS = 5, (40, 90)


def damped(key: Column, current: Column, wanted: Column) -> Column:
    """The wanted value within the key's step of the current one; percentages are divided by 100, wrong signs change nothing.

    ``min_confidence`` is a whole number within its own step and bounds.
    """
    limit = F.lit(None).cast("double")
    for name, step in DAMP.items():
        limit = F.when(key == name, step).otherwise(limit)
    value = F.when(F.abs(wanted) > 1, wanted / 100).otherwise(wanted)
    wrong = (key.endswith("_stop_loss") & (value >= 0)) | (key.endswith("_take_profit") & (value <= 0))
    whole = F.when(wanted >= 0, F.floor(wanted)).otherwise(F.ceil(wanted)).cast("double")
    near = F.least(F.greatest(whole, current - DAMP_CONFIDENCE), current + DAMP_CONFIDENCE)
    confidence = F.when(wanted.isNull(), current).otherwise(F.least(F.greatest(near, F.lit(float(CONFIDENCE_BOUNDS[0]))), F.lit(float(CONFIDENCE_BOUNDS[1]))))
    moved = F.when(limit.isNull() | value.isNull() | wrong, current).otherwise(F.least(F.greatest(value, current - limit), current + limit))
    return F.when(key == "min_confidence", confidence).otherwise(moved)
