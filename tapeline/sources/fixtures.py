"""Daily bars, a raw security universe and an order feed, derived from the bundled tables.

The texts run unchanged on other SQL engines, so that checks can start from the same rows. Prices are decimals on purpose:
rounded doubles have ties on which engines differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.apart import number_apart

_SYMBOL = """concat(case cast({key} % 10 as int) when 0 then '000' when 1 then '001' when 2 then '002' when 3 then '601'
                   when 4 then '603' when 5 then '605' when 6 then '300' when 7 then '688' else '600' end,
              lpad(cast({key} as varchar(10)), 3, '0'))"""

BARS = f"""
with d as (
  select l_suppkey, cast(case when l_suppkey % 7 = 3 then 4 else 1 end as int) as m, cast(l_shipdate as date) as trade_date,
         cast(sum(cast(round(l_discount * 100) as bigint)) as double) / count(*) / 100 as disc,
         cast(cast(sum(cast(round(l_tax * 100) as bigint)) as double) / count(*) / 100 as decimal(8,4)) as tax,
         cast(sum(cast(l_quantity as bigint)) as bigint) as qty,
         cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(24,2)) as amt
  from lineitem group by 1, 2, 3
), w as (
  select *, cast(round(20 * exp(sum((disc - cast(0.05 as double)) * cast(0.6 as double) * m) over (
              partition by l_suppkey order by trade_date rows between unbounded preceding and current row)), 4) as decimal(12,4)) as c
  from d
), o as (
  select *, cast(round(coalesce(lag(c) over (partition by l_suppkey order by trade_date), cast(20 as decimal(12,4)))
                 * cast(1 + (tax - 0.04) * 0.2 * m as decimal(10,6)), 4) as decimal(12,4)) as o
  from w
)
select {_SYMBOL.format(key="l_suppkey")} as symbol, trade_date, o as open,
       cast(round(greatest(o, c) * cast(1 + tax * 0.2 * m as decimal(10,6)), 4) as decimal(12,4)) as high,
       cast(round(least(o, c) * cast(1 - tax * 0.2 * m as decimal(10,6)), 4) as decimal(12,4)) as low,
       c as close, qty * 10000 as volume, cast(amt * 1000 as decimal(24,2)) as amount,
       cast(tax * 100 * m as decimal(10,4)) as turnover_rate, 'QFQ' as adjust_type
from o
"""

UNIVERSE = f"""
select {_SYMBOL.format(key="s_suppkey")} as code,
       case when s_acctbal < -900 then concat(s_name, '退') when s_acctbal < 0 then concat('*ST', s_name) else s_name end as name
from supplier
"""

WIDE = f"""
select {_SYMBOL.format(key="c_custkey")} as code, c_name as name
from customer
"""

NAMES = f"select code as symbol, max(name) as name from ({WIDE}) w group by code"

ORDERS = """
select o_orderkey as order_id, cast(o_custkey % 10 as bigint) as account_id,
       concat('600', lpad(cast((o_orderkey * 7 + o_custkey) % 23 as varchar(10)), 3, '0')) as symbol,
       case when o_orderstatus = 'F' or (o_orderstatus = 'P' and o_orderkey % 2 = 1) then 'SELL' else 'BUY' end as side,
       cast(case when o_orderkey % 37 = 0 then 150 else 100 * (1 + o_orderkey % 10) end as int) as quantity,
       cast(round(cast(o_totalprice as decimal(18,2)) * cast(0.0001 as decimal(10,4)), 4) as decimal(18,4)) as price,
       cast(o_orderdate as date) as trade_date
from orders
"""

_EVENT = "cast({order} as bigint) as order_id, cast({plan} as bigint) as plan_id, {symbol} as symbol, {side} as side, cast({quantity} as int) as quantity, cast({price} as decimal(18,4)) as price, cast({latest} as decimal(18,4)) as latest, cast({stop} as decimal(18,4)) as stop_loss, cast({target} as decimal(18,4)) as target_price, cast({weight} as decimal(8,4)) as weight"


def _event(kind: str, stage: int, day: str, where: str, **values: str) -> str:
    none = dict.fromkeys(("order", "plan", "quantity", "price", "latest", "stop", "target", "weight"), "null") | dict.fromkeys(("symbol", "side"), "cast(null as varchar(10))")
    return f"select account_id, {day} as day, {stage} as stage, order_id as k, '{kind}' as kind, {_EVENT.format(**none | values)} from f where {where}"


#: What becomes of the feed's orders: a third come from plans, most are confirmed days later, some cancelled, some plans too.
EVENTS = f"""
with f as ({ORDERS}), e as (
  {" union all ".join([
    _event("PLAN", 1, "trade_date", "order_id % 3 = 0", plan="order_id", symbol="symbol", price="case when order_id % 11 = 0 then 0 else price end", stop="round(price * 0.95, 4)", target="round(price * 1.08, 4)", weight="case when order_id % 13 = 0 then 0 else 0.0001 * (order_id % 2000) end"),
    _event("ORDER", 2, "trade_date", "order_id % 3 <> 0", order="order_id", symbol="symbol", side="side", quantity="quantity", price="case when order_id % 41 = 0 then 0 else price end"),
    _event("PLAN_ORDER", 2, "trade_date + 1", "order_id % 3 = 0 and order_id % 4 <> 1", order="order_id", plan="order_id", quantity="case when order_id % 5 = 1 then quantity end", price="case when order_id % 5 = 2 then price end", latest="price"),
    _event("CONFIRM", 3, "trade_date + cast(1 + order_id % 4 as int)", "order_id % 7 < 5", order="order_id"),
    _event("CANCEL", 4, "trade_date + cast(1 + order_id % 9 as int)", "order_id % 7 >= 4", order="order_id"),
    _event("CANCEL_PLAN", 5, "trade_date + 2", "order_id % 3 = 0 and order_id % 10 >= 7", plan="order_id"),
    _event("MARK", 6, "trade_date + 5", "order_id % 3 = 1", symbol="symbol", price="round(price * 1.02, 4)"),
  ])}
)
select account_id, row_number() over (partition by account_id order by day, stage, k) as seq, day, kind, order_id, plan_id, symbol, side, quantity, price, latest, stop_loss, target_price, weight
from e
"""


def from_table(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    """The rows of a query text over one table of the folder."""
    plain = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(plain.replace(f"from {name}", f"from {{{name}}}"), **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, trade_date, open, high, low, close, volume, amount, turnover_rate, adjust_type."""
    return from_table(spark, sf_dir, BARS, "lineitem")


def raw_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name as a provider gives them."""
    return from_table(spark, sf_dir, UNIVERSE, "supplier")


def wide_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name of a larger universe, most of whose securities have no bars."""
    return from_table(spark, sf_dir, WIDE, "customer")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, name of the larger universe, once each."""
    return wide_universe(spark, sf_dir).groupBy(F.col("code").alias("symbol")).agg(F.max("name").alias("name"))


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, account_id, symbol, side, quantity, price, trade_date."""
    return from_table(spark, sf_dir, ORDERS, "orders")


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of accounts in order, see ``operators.events``; the rows of ``EVENTS``, numbered without a task that sorts an account."""
    head, tail = EVENTS.rsplit("row_number() over (partition by account_id order by day, stage, k) as seq", 1)
    rows = from_table(spark, sf_dir, f"{head}stage, k{tail}", "orders")
    placed = number_apart(rows, ["account_id"], [(F.col("day"), False), (F.col("stage"), False)], [F.col("k")], "_n")
    return placed.select("account_id", (F.col("_n") + 1).cast("int").alias("seq"), *[c for c in rows.columns if c not in ("account_id", "stage", "k")])
