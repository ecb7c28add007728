"""Common table expressions that the queries' SQL twins start from."""

_K = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
BARS = f"""bars AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS date,
         first(l_extendedprice / l_quantity ORDER BY {_K}) AS open, last(l_extendedprice / l_quantity ORDER BY {_K}) AS close,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 4) AS amount
  FROM lineitem GROUP BY 1, 2)"""
CAL = "cal AS (SELECT date, row_number() OVER (ORDER BY date) AS cal_idx FROM (SELECT DISTINCT date FROM bars))"
ENDS = "ends AS (SELECT date_trunc('month', date) AS month, max(date) AS date, max(cal_idx) AS cal_idx FROM cal GROUP BY 1)"
INDEX = "idx AS (SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS close FROM orders GROUP BY 1)"
TRADES = f"""trades AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, l_shipdate AS ts,
         CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS direction,
         l_extendedprice / l_quantity AS price, l_quantity AS volume, {_K} FROM lineitem)"""
INDUSTRY = "industry AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, coalesce(r_name, 'none') AS industry FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    over = f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least or n} THEN {f}({x}) {over} END"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY code ORDER BY date)"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def rnd(x: str, digits: int = 6) -> str:
    """The twin of functions.columns.rnd."""
    return f"floor(({x}) * 1e{digits} + 0.5::DOUBLE) / 1e{digits}"
