"""The contract between research and trading: regime, factor states, crowding, limits and weights, as rows, and the checks on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of the account by regime, the other limits, and the weights of short, medium and long.
LIMITS, OTHER_LIMIT = {"bull": 1.0, "bear": 0.5, "range": 0.7}, 0.4
SINGLE, LEAST_CASH = 0.05, 0.30
WEIGHTS, BULL_WEIGHTS = (0.5, 0.3, 0.2), (0.6, 0.3, 0.1)
#: Months of regime history, least t of an active factor and its weight, least share of names with a book ratio.
MONTHS, LEAST_T, ACTIVE_WEIGHT, LEAST_COVERAGE = 12, 2.0, 0.05, 0.60
#: The labels that a regime may have.
REGIMES = ["bull", "bull_high_vol", "bear", "range", "transition"]


def position_limit(regime: Column) -> Column:
    limit = F.lit(OTHER_LIMIT)
    for name, value in LIMITS.items():
        limit = F.when(regime.startswith(name), value).otherwise(limit)
    return limit


def _row(section: str, key, text=None, value=None) -> Column:
    col = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(F.lit(section).alias("section"), col(key, "string").alias("key"), col(text, "string").alias("text"), col(value, "double").alias("value"))


def build_contract(regimes: DataFrame, factors: DataFrame, crowding: DataFrame, metrics: list[str]) -> DataFrame:
    """``section``, ``key``, ``text``, ``value``: what holds at the last day of ``regimes``.

    ``regimes`` (date, regime and ``metrics``) gives the state, its figures, the last label of each of the last MONTHS months, limits and
    weights; ``factors`` (factor, mean_ic, t) their states: active with a t of LEAST_T either way, else on watch; ``crowding`` (factor, crowded, sharpe) may
    take an active factor back. A handful of rows; nothing else is gathered.
    """
    last = regimes.groupBy().agg(F.max_by(F.struct("date", "regime", *metrics), "date").alias("x")).filter("x is not null").select("x.*")
    bull, state = F.col("regime").startswith("bull"), F.col("regime")
    weights = [_row("weights", n, None, F.when(bull, b).otherwise(w)) for n, b, w in zip(("short", "medium", "long"), BULL_WEIGHTS, WEIGHTS, strict=True)]
    limit = position_limit(state)
    limits = {"max_position_pct": limit, "max_total_position": limit, "single_stock_pct": F.lit(SINGLE), "max_position_size": F.lit(SINGLE), "min_cash_pct": F.lit(LEAST_CASH)}
    own = [_row("regime", "state", state), _row("regime", "date", F.col("date").cast("string")), *[_row("metrics", m, None, F.col(m)) for m in metrics], *[_row("limits", k, None, v) for k, v in limits.items()], *weights]
    now = last.select(F.inline(F.array(*own)))
    months = regimes.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.max_by("regime", "date").alias("regime"))
    recent = months.withColumn("_place", F.row_number().over(Window.orderBy(F.desc("month")))).filter(F.col("_place") <= MONTHS)  # one row a month
    history = recent.select(F.inline(F.array(_row("history", F.col("month"), F.col("regime")))))
    both = factors.join(crowding, "factor", "left")
    status = F.when(F.coalesce("crowded", F.lit(False)), "crowded").when(F.abs("t") >= LEAST_T, "active").otherwise("watch")
    states = both.withColumn("_status", status).select(F.inline(F.array(
        _row("factors", F.col("factor"), F.col("_status"), F.when(F.col("_status") == "active", ACTIVE_WEIGHT).otherwise(0.0)),
        _row("evidence", F.col("factor"), None, F.col("mean_ic")), _row("crowding", F.col("factor"), F.coalesce("crowded", F.lit(False)), F.col("sharpe")))))
    return reduce(DataFrame.unionByName, [history, states], now)


def policy_overlay(states: DataFrame, recent: DataFrame) -> DataFrame:
    """``states`` (kind, status, weight, mean_car, n_events) with ``text``: the line on a policy factor that has weight and an event among ``recent`` (kind), else null."""
    seen = recent.select("kind").distinct().withColumn("_seen", F.lit(True))
    car = F.format_string("%+.2f", F.floor(F.col("mean_car") * 1e4 + 0.5).cast("double") / 100.0)
    line = F.concat(F.lit("研究层政策因子 policy_"), "kind", F.lit("："), "status", F.lit("，CAR "), car, F.lit("%，样本 "), F.col("n_events").cast("string"), F.lit("，窗口内有 "), "kind", F.lit(" 事件"))
    return states.join(F.broadcast(seen), "kind", "left").withColumn("text", F.when((F.col("weight") > 0) & F.col("_seen"), line)).drop("_seen")


def as_json(contract: DataFrame) -> DataFrame:
    """One row: ``contract``, the sections as a JSON object of objects; a row's text, else its value."""
    entry = F.coalesce("text", F.col("value").cast("string"))
    sections = contract.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", entry)))).alias("entries"))
    return sections.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("section", "entries")))).alias("contract"))


def read_json(text: DataFrame, column: str = "contract") -> DataFrame:
    """``section``, ``key``, ``entry`` of a contract's JSON."""
    parsed = text.select(F.from_json(column, "map<string, map<string, string>>").alias("c"))
    return parsed.select(F.explode("c").alias("section", "entries")).select("section", F.explode("entries").alias("key", "entry"))


def effective_parameters(stored: DataFrame, contract: DataFrame) -> DataFrame:
    """``stored`` (key, value) with the contract's limits laid over it: ``key``, ``value``, ``by_contract``. Limits that are not stored are no parameters."""
    over = contract.filter("section = 'limits'").select("key", F.col("value").alias("_over"))
    return stored.join(F.broadcast(over), "key", "left").select("key", F.coalesce("_over", "value").alias("value"), F.col("_over").isNotNull().alias("by_contract"))


def landing_checks(contract: DataFrame, snapshot: DataFrame, factors: int) -> DataFrame:
    """``check_name``, ``ok``: what has to hold before a contract is used; a missing section fails its check.

    ``snapshot`` (pb) is the table of names that the value factor reads, ``factors`` how many states there should be.
    """
    has = lambda section, key=None: (F.col("section") == section) & (F.lit(True) if key is None else F.col("key") == key)
    one = lambda section, key: F.max(F.when(has(section, key), F.col("value")))
    count = lambda cond: F.count_if(cond)
    total = one("limits", "max_total_position")
    weights = F.sum(F.when(has("weights"), F.col("value")))
    checks = {
        "regime_known": count(has("regime", "state") & F.col("text").isin(REGIMES)) == 1,
        "dated": count(has("regime", "date") & F.col("text").isNotNull()) == 1,
        "history_complete": count(has("history")) == MONTHS,
        "factor_states": count(has("factors")) == factors,
        "a_factor_is_active": count(has("factors") & (F.col("value") > 0)) >= 1,
        "no_weight_when_crowded": count(has("factors") & (F.col("text") == "crowded") & (F.col("value") > 0)) == 0,
        "crowding_told": count(has("crowding")) == factors,
        "limits_present": count(has("limits") & F.col("key").isin("max_position_pct", "min_cash_pct", "single_stock_pct") & F.col("value").isNotNull()) == 3,
        "limits_in_range": (total >= 0) & (total <= 1),
        "single_below_total": one("limits", "single_stock_pct") <= total,
        "cash_leaves_room": 1 - one("limits", "min_cash_pct") >= total,
        "weights_sum_to_one": F.abs(weights - 1) < 1e-9,
    }
    rows = contract.agg(F.array(*[F.struct(F.lit(k).alias("check_name"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()]).alias("c")).select(F.inline("c"))
    covered = snapshot.agg(F.coalesce(F.avg(F.col("pb").isNotNull().cast("double")) >= LEAST_COVERAGE, F.lit(False)).alias("ok"))
    return rows.unionByName(covered.select(F.lit("book_ratio_coverage").alias("check_name"), "ok"))
