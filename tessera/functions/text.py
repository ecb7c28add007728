"""Report texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import col, rnd

#: The names of directions and horizons in a report, and the mark of no horizon.
DIRECTIONS = {"buy": "买入", "sell": "卖出"}
HORIZONS = {"short": "短线", "medium": "中线", "long": "长线"}
NO_HORIZON = "—"


def money(x) -> Column:
    """Two digits and commas; null counts as 0."""
    return F.format_number(rnd(F.coalesce(col(x), F.lit(0.0)), 2), 2)


def percent(x) -> Column:
    """Two digits with the sign; null counts as 0."""
    return F.format_string("%+.2f%%", rnd(F.coalesce(col(x), F.lit(0.0)), 2))


def direction(x) -> Column:
    """All but buys are sells."""
    return F.when(col(x) == "buy", DIRECTIONS["buy"]).otherwise(DIRECTIONS["sell"])


def horizon(x) -> Column:
    """The name of a known horizon, another text as it is, a mark for none."""
    known = F.create_map(*[F.lit(v) for pair in HORIZONS.items() for v in pair])
    return F.coalesce(F.try_element_at(known, col(x)), F.nullif(col(x), F.lit("")), F.lit(NO_HORIZON))


def balance_line(total, cash, value) -> Column:
    return F.concat(F.lit("总资产 ¥"), money(total), F.lit(" | 现金 ¥"), money(cash), F.lit(" | 持仓 ¥"), money(value))


def position_line(code, name, volume, cost, price, ratio, held_for) -> Column:
    whole = F.coalesce(col(volume), F.lit(0.0)).cast("long").cast("string")
    return F.concat(F.lit("  "), col(code), F.lit(" "), F.coalesce(col(name), F.lit("")), F.lit(" "), whole, F.lit("股 成本¥"), money(cost), F.lit(" 现价¥"), money(price), F.lit(" "), percent(ratio), F.lit(" ["), horizon(held_for), F.lit("]"))


def order_line(at, side, code, volume, price, status) -> Column:
    whole = F.coalesce(col(volume), F.lit(0.0)).cast("long").cast("string")
    time = F.coalesce(F.date_format(col(at), "HH:mm"), F.lit(""))
    return F.concat(F.lit("  "), time, F.lit(" "), direction(side), F.lit(" "), col(code), F.lit(" "), whole, F.lit("股 ¥"), money(price), F.lit(" ["), F.coalesce(col(status), F.lit("")), F.lit("]"))
