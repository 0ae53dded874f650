"""The registered queries: each takes (spark, sf_dir) and returns a frame; SQL with the same rows stands beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O  # noqa: N812
from .functions.prices import by_value, price_ladder, suggested_weight
from .functions.symbols import exchange_symbol
from .operators import backtest as B  # noqa: N812
from .operators import ledger as L  # noqa: N812
from .operators import market, merge, risk, strategy
from .operators import score as S  # noqa: N812
from .operators.indicators import latest, with_exact_indicators, with_indicators
from .operators.normalize import normalize_universe
from .plans import scan as P  # noqa: N812
from .sources.files import cut
from .sources.fixtures import NAMES, UNIVERSE, WIDE, bars, names, order_feed, raw_universe, wide_universe
from .streaming import incremental

CAPITAL = "100000000"
#: The same with a universe of which most securities have no bars.
WIDE_SCORED = O.SCORED.replace(UNIVERSE, WIDE)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def universe(spark, d):
    return normalize_universe(raw_universe(spark, d))


def scanned(spark, d):
    return P.scan(bars(spark, d), universe(spark, d))


def rounded(*names: str, digits: int = 6):
    return [by_value(F.col(n), digits).alias(n) for n in names]


def sql_rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


def _series(name: str, columns: list[str]):
    """A query of some indicators on every bar of the tail."""

    def f(spark, d):
        return with_indicators(bars(spark, d)).select("symbol", "trade_date", *rounded(*columns))

    f.__name__ = name
    query(f"{O.TAIL} select symbol, trade_date, {sql_rounded(*columns)} from ind")(f)


_series("sma_set", ["ma5", "ma10", "ma20", "ma60"])
_series("returns_set", ["return5", "return20", "return60", "day_return"])
_series("rsi_wilder", ["rsi14"])
_series("true_range", ["true_range"])
_series("atr_wilder", ["atr14", "atr_pct"])
_series("macd_hist", ["ema12", "ema26", "macd", "macd_hist", "prev_hist"])
_series("volume_ratio_prev20", ["volume_ratio20"])
_series("avg_amount20", ["avg_amount20"])
_series("drawdown_range20", ["drawdown20", "range_position20"])
_series("volatility20", ["volatility20"])


@query(f"{O.TAIL} select symbol, trade_date, prev_high20, breakout20 from ind")
def breakout20(spark, d):
    return with_indicators(bars(spark, d)).select("symbol", "trade_date", "prev_high20", "breakout20")


@query(f"{O.TAIL} select symbol, trade_date, limit_ups from ind")
def limit_up_count(spark, d):
    return with_indicators(bars(spark, d)).select("symbol", "trade_date", "limit_ups")


def _exact(name: str, columns: list[str]):
    def f(spark, d):
        return with_exact_indicators(bars(spark, d)).select("symbol", "trade_date", *columns)

    f.__name__ = name
    query(f"{O.EXACT} select symbol, trade_date, {', '.join(columns)} from exact")(f)


_exact("sma_exact", ["sma5", "sma20", "sma60"])
_exact("rsi_simple", ["rsi"])
_exact("atr_simple", ["atr", "atr_share"])
_exact("volume_ratio_incl20", ["avg_volume20", "ratio"])


@query(f"{O.BASE} select symbol, trade_date, case when row_number() over w >= 20 then max(close) over (partition by symbol order by trade_date rows 19 preceding) end as highest from bars window w as (partition by symbol order by trade_date)")
def highest_close(spark, d):
    from .operators.indicators import highest_close as highest
    from .operators.indicators import numbered

    return numbered(bars(spark, d)).select("symbol", "trade_date", highest(20).alias("highest"))


@query(f"{O.SCORED} select * from universe")
def universe_normalized(spark, d):
    return universe(spark, d)


@query(f"{O.SCORED} select symbol, name from universe where is_active and not is_st")
def universe_active(spark, d):
    from .operators.normalize import active_universe

    return active_universe(universe(spark, d)).select("symbol", "name")


@query(f"{O.SCORED} select symbol, case when symbol like '6%' then 'sh' else 'sz' end || symbol as exchange_symbol, exchange from universe")
def exchange_symbols(spark, d):
    return universe(spark, d).select("symbol", exchange_symbol(F.col("symbol")).alias("exchange_symbol"), "exchange")


@query(f"{O.SCORED} select (select count(*) from universe) as securities, (select count(*) from universe where is_active) as active, (select count(*) from universe where is_active and not is_st) as tradable, (select count(*) from bars) as bars, (select count(distinct symbol) from bars) as symbols_with_bars, (select max(trade_date) from bars) as latest_trade_date")
def overview_counts(spark, d):
    return market.overview(universe(spark, d), bars(spark, d))


@query(
    f"{O.SCORED}, m as (select * from universe where is_active and board = 'MAIN' and (symbol like '%60%' or name like '%60%')), p as (select * from m order by symbol limit 20 offset 20) "
    "select p.*, t.total, b.latest_date, b.latest_price from (select count(*) as total from m) t left join p on true left join (select symbol, max(trade_date) as latest_date, max_by(close, trade_date) as latest_price from bars where adjust_type = 'QFQ' group by 1) b using (symbol)"
)
def securities_search_latest_bar(spark, d):
    return market.search_securities(universe(spark, d), bars(spark, d), "60", 2, 20)


@query(f"{O.BASE}, b as (select *, row_number() over (partition by symbol order by trade_date desc) as k from bars) select symbol, trade_date, open, high, low, close, volume, amount, turnover_rate from b where k <= 30")
def bars_tail_n(spark, d):
    return market.bars_tail(bars(spark, d), 30)


@query(f"{O.BASE} select symbol, max(trade_date) as latest_date, max_by(close, trade_date) as latest_price from bars where adjust_type = 'QFQ' and trade_date <= date '1996-06-30' group by 1")
def bars_as_of(spark, d):
    from datetime import date

    return market.bars_as_of(bars(spark, d), date(1996, 6, 30))


POINTS = ["trend", "short", "rsi", "return20", "volume", "breakout", "macd", "atr", "volatility", "turnover"]


@query(f"{O.SCORED} select symbol, trade_date, {', '.join(f'pts_{p}' for p in POINTS)}, score from scored")
def dynamic_score(spark, d):
    df = S.score_latest(latest(with_indicators(bars(spark, d))).where(F.col("n_bars") >= S.MIN_BARS))
    return df.select("symbol", "trade_date", *[f"pts_{p}" for p in POINTS], "score")


@query(f"{O.SCORED} select symbol, score, signal_level, risk_level from scored")
def signal_risk_levels(spark, d):
    return S.dynamic_analysis(bars(spark, d)).select("symbol", "score", "signal_level", "risk_level")


@query(f"{O.SCORED} select symbol, reasons = '' as eligible, reasons from scored")
def filter_reasons(spark, d):
    return S.dynamic_analysis(bars(spark, d)).select("symbol", "eligible", F.array_join("filter_reasons", "|").alias("reasons"))


@query(f"{O.SCORED} select rank_no, symbol, name, trade_date, score, signal_level, risk_level, eligible from scan")
def scan_ranked(spark, d):
    return scanned(spark, d).select("rank_no", "symbol", "name", "trade_date", "score", "signal_level", "risk_level", "eligible")


@query(f"{O.SCORED} select rank_no, symbol, score, eligible, latest_close from scan where rank_no <= 50")
def scan_topk(spark, d):
    return market.task_results(scanned(spark, d), 1, 50).select("rank_no", "symbol", "score", "eligible", "latest_close")


@query(f"{O.SCORED} select 1 as task_id, count(*) as success_symbols, count(*) filter (where eligible) as selected_count, max(trade_date) as trade_date from scan")
def scan_summary(spark, d):
    return P.scan_summary(scanned(spark, d))


@query(f"{WIDE_SCORED}, n as (select symbol, count(*) as k from bars group by 1) select 1 as task_id, u.symbol, u.name, 'only ' || coalesce(k, 0) || ' bars' as error_message, 0 as retry_count, false as resolved from universe u left join n using (symbol) where u.is_active and not u.is_st and coalesce(k, 0) < 80")
def scan_failures(spark, d):
    return P.scan_failures(bars(spark, d), normalize_universe(wide_universe(spark, d)))


@query(f"{O.NOTED} select symbol, trade_date as signal_date, case when score >= 75 then 'BUY' else 'WATCH' end as action, score, latest_close as reference_price, bullish as reasons, bearish as risks, 'DYNAMIC_SCAN' as strategy_code from scan join notes using (symbol) where eligible and rank_no <= 30")
def signals_from_scan(spark, d):
    return P.signals_from_scan(scanned(spark, d), 30).withColumns({c: F.array_join(c, "；") for c in ("reasons", "risks")})


LADDER = ", ".join(f"round({{p}} * {v}, 2)::decimal(18,2) as {k}" for k, v in (("buy_low", "0.99"), ("buy_high", "1.01"), ("stop_loss", "0.95"), ("target1", "1.08"), ("target2", "1.12")))
WEIGHT = "case when risk_level = 'HIGH' then 0.05 when score >= 80 then 0.20 when score >= 70 then 0.15 when score >= 60 then 0.10 else 0.05 end::decimal(8,4)"


@query(f"{O.NOTED} select symbol, name, trade_date as plan_date, score, {LADDER.format(p='latest_close')}, {WEIGHT} as suggested_weight, 2 as valid_days, 'ACTIVE' as status, summary as rationale, 1 as source_task_id from scan join notes using (symbol) where eligible and rank_no <= 30")
def plans_from_scan(spark, d):
    return P.plans_from_scan(scanned(spark, d), 30)


@query(f"{O.BASE} select symbol, trade_date, {LADDER.format(p='round(close, 2)::decimal(18,2)')} from bars")
def price_ladders(spark, d):
    from .functions.prices import half_up

    return bars(spark, d).select("symbol", "trade_date", *[v.alias(k) for k, v in price_ladder(half_up(F.col("close"), 2)).items()])


@query(f"{O.SCORED} select symbol, {WEIGHT} as weight from scored")
def suggested_weights(spark, d):
    return S.dynamic_analysis(bars(spark, d)).select("symbol", suggested_weight(F.col("score"), F.col("risk_level")).alias("weight"))


METRIC_SQL = ", ".join(f"coalesce(round({v}::decimal(28,10), 2), 0)::decimal(24,2) as {k}" for k, v in S.METRICS.items())


@query(f"{O.SCORED} select symbol, {METRIC_SQL}, limit_ups as recent_limit_up_count, breakout20, coalesce(round(macd_hist::decimal(28,10), 4), 0)::decimal(24,4) as macd_histogram from scored")
def analysis_metrics(spark, d):
    return S.dynamic_analysis(bars(spark, d)).select("symbol", "metrics.*")


@query(f"{O.SCORED} select symbol, '截至' || trade_date || printf('，收盘价%s元，近5日%+.2f%%、近20日%+.2f%%。当前价格', latest_close::varchar, return5, return20) || case when c >= ma20 then '高于' else '低于' end || printf('20日均线，RSI14为%.1f，量比约%.2f，动态规则评分为%d分。', rsi14, volume_ratio20, score) as summary from scored")
def analysis_summary(spark, d):
    return S.dynamic_analysis(bars(spark, d)).select("symbol", "summary")


@query(f"{O.NOTED} select symbol, bullish, bearish from notes")
def analysis_notes(spark, d):
    return S.dynamic_analysis(bars(spark, d)).select("symbol", F.array_join("bullish", "；").alias("bullish"), F.array_join("bearish", "；").alias("bearish"))


@query(f"{WIDE_SCORED} select u.symbol, coalesce(score, 0) as score, coalesce(risk_level, 'UNKNOWN') as risk_level, score is null as degraded from universe u left join scored s using (symbol)")
def degraded_analysis(spark, d):
    return S.with_degraded(normalize_universe(wide_universe(spark, d)), S.dynamic_analysis(bars(spark, d))).select("symbol", "score", "risk_level", "degraded")


_TYPED = {"return_5_pct": ("return5", "decimal(18,4)"), "return_20_pct": ("return20", "decimal(18,4)"), "rsi14": ("rsi14", "decimal(18,4)"), "atr14_pct": ("atr_pct", "decimal(18,4)"), "volume_ratio20": ("volume_ratio20", "decimal(18,4)"), "breakout20": ("breakout20", "boolean")}
_SHOWN = {c: f"round({v}::decimal(28,10), 4)::{k}" if k != "boolean" else v for c, (v, k) in _TYPED.items()}
_FILLED = ", ".join(f"case when score % 2 = 0 or (score % 3 = 0 and symbol not like '%3') then {x} end as {c}" for c, x in _SHOWN.items())


@query(f"{O.SCORED} select symbol, {_FILLED} from scored")
def results_json_backfill(spark, d):
    """Six typed columns, empty at odd scores, filled from JSON text; at scores not divisible by 3 the text has none of the fields, and
    for symbols that end in 3 it is cut off."""
    df = S.score_latest(latest(with_indicators(bars(spark, d))).where(F.col("n_bars") >= S.MIN_BARS))
    shown = {c: F.round(F.col(v).cast("decimal(28,10)"), 4).cast(k) if k != "boolean" else F.col(v) for c, (v, k) in _TYPED.items()}
    js = F.to_json(F.struct(*[v.alias(market.METRIC_FIELDS[c]) for c, v in shown.items()]))
    js = F.when(F.col("symbol").like("%3"), F.substring(js, 1, 20)).when(F.col("score") % 3 == 0, js).otherwise('{"other": 1}')
    typed = [F.when(F.col("score") % 2 == 0, v).alias(c) for c, v in shown.items()]
    return market.fill_from_metrics(df.select("symbol", js.alias("metrics"), *typed)).drop("metrics")


@query(f"{O.MULTI} select symbol, signal_date, action, score, reference_price, reasons, risks from signals")
def multifactor_score(spark, d):
    df = strategy.multifactor_signals(bars(spark, d))
    return df.withColumns({c: F.array_join(c, "；") for c in ("reasons", "risks")})


FIXTURE_SYMBOLS = ("000001", "601003", "603004", "600009", "000010", "002002", "605005", "001001", "600008", "999999")
_CHOSEN = ", ".join(f"('{s}', {i})" for i, s in enumerate(FIXTURE_SYMBOLS, 1))
_DAILY_SQL = O.MULTI.replace("with bars as (", "with allbars as (", 1).replace(", raw_universe as", f", picks(symbol, place) as (values {_CHOSEN}), bars as (select * exclude (k) from (select *, row_number() over (partition by symbol order by trade_date desc) as k from allbars where symbol in (select symbol from picks)) where k <= 100), raw_universe as", 1)


@query(f"{_DAILY_SQL} select symbol, signal_date, action, score, reference_price from signals join picks using (symbol) order by score desc, place limit 6")
def daily_signals(spark, d):
    return strategy.daily_signals(bars(spark, d), FIXTURE_SYMBOLS, 6).select("symbol", "signal_date", "action", "score", "reference_price")


@query(f"{_DAILY_SQL}, s as (select * from signals join picks using (symbol) order by score desc, place limit 6) select symbol, signal_date as plan_date, score, {LADDER.format(p='reference_price')}, 0.20::decimal(8,4) as suggested_weight, 2 as valid_days, reasons as rationale from s where action <> 'AVOID'")
def daily_plans(spark, d):
    return strategy.daily_plans(bars(spark, d), FIXTURE_SYMBOLS, 6)


_BT = O.BASE.replace("with bars", "with recursive bars", 1) + O.BACKTEST.replace("{bars}", "bars")


@query(f"{_BT} select * from sig")
def backtest_signals(spark, d):
    return B.backtest_signals(bars(spark, d))


@query(f"{_BT} select * from exits")
def backtest_exits(spark, d):
    return B.backtest_exits(bars(spark, d))


@query(f"{_BT} select symbol, n, entry_date, exit_date, entry, exit_price, reason, quantity, pnl, capital, peak, trade_return, drawdown from trades")
def backtest_trades(spark, d):
    return B.backtest_trades(bars(spark, d))


@query(f"{_BT} select * from summary")
def backtest_summary(spark, d):
    return B.backtest_summary(bars(spark, d))


_VALID = O.SCORED.replace("with bars", "with recursive bars", 1) + (
    ", chosen as (select symbol, rank_no as scan_rank, score as scan_score from (select *, row_number() over (order by rank_no, symbol) as place, max(eligible) over () as any_e from scan) where (eligible or not any_e) and place <= 20), "
    "own as (select * exclude (k) from (select b.*, row_number() over (partition by symbol order by trade_date desc) as k from bars b where symbol in (select symbol from chosen)) where k <= 180)"
) + O.BACKTEST.replace("{bars}", "own") + ", v as (select 1 as task_id, c.*, s.* exclude (symbol), case when s.symbol is null then 'FAILED' else 'SUCCESS' end as status from chosen c left join summary s on s.symbol = c.symbol)"


@query(f"{_VALID} select task_id, symbol, scan_rank, scan_score, total_return, max_drawdown, win_rate, profit_loss_ratio, trade_count, status from v")
def batch_validation(spark, d):
    return P.validate_scan(scanned(spark, d), bars(spark, d)).select("task_id", "symbol", "scan_rank", "scan_score", "total_return", "max_drawdown", "win_rate", "profit_loss_ratio", "trade_count", "status")


@query(f"{_VALID} select task_id, count(*) as total_symbols, count(*) filter (where status = 'SUCCESS') as success_symbols, count(*) filter (where status <> 'SUCCESS') as failed_symbols, round(avg(total_return), 8) as avg_total_return, round(avg(win_rate), 8) as avg_win_rate, round(avg(max_drawdown), 8) as avg_max_drawdown, count(*) filter (where total_return > 0) as positive_strategy_count from v group by 1")
def batch_validation_summary(spark, d):
    return P.validation_summary(P.validate_scan(scanned(spark, d), bars(spark, d)))


@query(f"{O.LEDGER} select order_id, side, gross, commission, stamp_duty, transfer_fee, total_fee, net from ord")
def order_fees(spark, d):
    return L.with_fees(order_feed(spark, d)).select("order_id", "side", "gross", "commission", "stamp_duty", "transfer_fee", "total_fee", "net")


@query(f"{O.LEDGER} select coalesce(reject_reason, 'OK') as reason, count(*) as n from ord group by 1")
def order_validation(spark, d):
    return L.validated(order_feed(spark, d)).groupBy(F.coalesce("reject_reason", F.lit("OK")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{O.LEDGER} select account_id, symbol, order_id, status, net, realized, held, available, average_cost from fills")
def ledger_fills(spark, d):
    return L.replay(order_feed(spark, d)).select("account_id", "symbol", "order_id", "status", "net", "realized", "held", "available", "average_cost")


@query(f"{O.LEDGER} select account_id, symbol, quantity, available_quantity, average_cost, last_buy_date from pos")
def ledger_positions(spark, d):
    return L.positions(L.replay(order_feed(spark, d)))


@query(f"{O.LEDGER} select * from cash")
def ledger_cash(spark, d):
    return L.cash_flow(L.replay(order_feed(spark, d)), CAPITAL)


@query(f"{O.LEDGER} select account_id, symbol, count(*) as sales, sum(realized)::decimal(20,2) as realized from fills where status = 'FILLED' and side = 'SELL' group by 1, 2")
def realized_pnl(spark, d):
    good = L.replay(order_feed(spark, d)).where("status = 'FILLED' and side = 'SELL'")
    return good.groupBy("account_id", "symbol").agg(F.count(F.lit(1)).alias("sales"), F.sum("realized").cast("decimal(20,2)").alias("realized"))


@query(
    f"{O.LEDGER}, late as (select account_id, symbol, sum(quantity) as frozen from order_feed where side = 'SELL' and trade_date >= date '1998-06-01' group by 1, 2) "
    "select p.account_id, p.symbol, case when last_buy_date < date '1998-08-01' then greatest(0, quantity - coalesce(frozen, 0)) else available_quantity end::bigint as available_quantity from pos p left join late using (account_id, symbol)"
)
def tplus1_available(spark, d):
    pending = order_feed(spark, d).where("side = 'SELL' and trade_date >= date '1998-06-01'")
    return L.available_tomorrow(L.positions(L.replay(order_feed(spark, d))), pending, F.lit("1998-08-01").cast("date")).select("account_id", "symbol", "available_quantity")


def traded(spark, d):
    """The feed's fills by day, computed once however often a query looks at them."""
    return cut(L.daily(L.replay(order_feed(spark, d))))


def marked_positions(spark, d, fills=None):
    fills = L.replay(order_feed(spark, d)) if fills is None else fills
    return L.marked(L.positions(fills), market.latest_bars(bars(spark, d)))


@query(f"{O.LEDGER} select account_id, symbol, quantity, average_cost, last_price, market_value, unrealized_pnl, missing, coalesce(round(unrealized_pnl::double / nullif((average_cost * quantity)::double, 0), 8), 0) as pnl_rate from marked")
def positions_view(spark, d):
    return marked_positions(spark, d).select("account_id", "symbol", "quantity", "average_cost", "last_price", "market_value", "unrealized_pnl", "missing", "pnl_rate")


_PENDING = "pending as (select *, case when side = 'BUY' then net else 0 end::decimal(20,2) as frozen_amount, case when side = 'SELL' then quantity else 0 end::bigint as frozen_quantity from ord where trade_date >= date '1998-07-25' and reject_reason is null)"
_FROZEN = f"{_PENDING}, fz as (select account_id, sum(frozen_amount)::decimal(20,2) as frozen_cash from pending group by 1)"


def pending_orders(spark, d):
    """Good orders of the last days, taken as not yet confirmed."""
    late = L.validated(L.with_fees(order_feed(spark, d))).where("trade_date >= date '1998-07-25' and reject_reason is null")
    return L.with_freezes(late.withColumn("status", F.lit("PENDING_CONFIRM")))


@query(f"{O.LEDGER}, {_FROZEN} select order_id, account_id, symbol, frozen_amount, frozen_quantity from pending")
def order_freezes(spark, d):
    return pending_orders(spark, d).select("order_id", "account_id", "symbol", "frozen_amount", "frozen_quantity")


@query(
    f"{O.LEDGER}, {_FROZEN}, v as (select account_id, sum(market_value)::decimal(20,2) as market_value, sum(unrealized_pnl)::decimal(20,2) as unrealized_pnl, count(*) as positions from marked group by 1) "
    "select c.*, coalesce(fz.frozen_cash, 0)::decimal(20,2) as frozen_cash, (c.cash - coalesce(fz.frozen_cash, 0))::decimal(20,2) as available_cash, coalesce(v.market_value, 0)::decimal(20,2) as market_value, coalesce(v.unrealized_pnl, 0)::decimal(20,2) as unrealized_pnl, coalesce(v.positions, 0) as positions, "
    "(c.cash + coalesce(v.market_value, 0))::decimal(20,2) as total_asset, round((c.cash + coalesce(v.market_value, 0))::double / 100000000 - 1, 8) as total_return from cash c left join v using (account_id) left join fz using (account_id)"
)
def account_summary(spark, d):
    fills = traded(spark, d)
    return L.account_summary(L.cash_flow(fills, CAPITAL), marked_positions(spark, d, fills), CAPITAL, pending_orders(spark, d))


@query(
    f"{O.LEDGER}, {_FROZEN}, rq as (select * from ord where side = 'BUY' and reject_reason is null), "
    "sy as (select account_id, count(*) as symbols from (select account_id, symbol from marked union select account_id, symbol from pending where side = 'BUY') group by 1), "
    "mv as (select account_id, sum(market_value) as mvalue from marked group by 1), pd as (select account_id, symbol, sum(gross) as pvalue, count(*) as n from pending where side = 'BUY' group by 1, 2) "
    "select r.order_id, case when c.cash is null or c.cash - coalesce(frozen_cash, 0) < r.net then 'NO_CASH' when pd.n > 0 then 'PENDING' when m.market_value is null and coalesce(symbols, 0) >= 24 then 'MAX_POSITIONS' "
    "when coalesce(m.market_value, 0) + coalesce(pvalue, 0) + r.gross > (c.cash + coalesce(mvalue, 0)) * 0.20 then 'MAX_WEIGHT' end as refused "
    "from rq r left join cash c using (account_id) left join fz using (account_id) left join sy using (account_id) left join mv using (account_id) left join marked m on m.account_id = r.account_id and m.symbol = r.symbol left join pd on pd.account_id = r.account_id and pd.symbol = r.symbol"
)
def purchase_gate(spark, d):
    """The gates of every purchase in the feed against the state after all fills."""
    wanted = L.validated(L.with_fees(order_feed(spark, d))).where("side = 'BUY' and reject_reason is null")
    fills = traded(spark, d)
    return L.gate_purchases(wanted, L.cash_flow(fills, CAPITAL), marked_positions(spark, d, fills), pending_orders(spark, d), max_positions=24).select("order_id", "refused")


_HIGHS = (
    "opened as (select account_id, symbol, max(trade_date) as opened from fills where status = 'FILLED' and side = 'BUY' and held = quantity group by 1, 2), "
    "highs as (select o.account_id, o.symbol, o.opened, greatest((select max(f.price) from fills f where f.account_id = o.account_id and f.symbol = o.symbol and f.status = 'FILLED' and f.side = 'BUY' and f.trade_date >= o.opened), "
    "(select max(b.close) from bars b where b.symbol = o.symbol and b.adjust_type = 'QFQ' and b.trade_date >= o.opened))::decimal(18,4) as highest_price from opened o)"
)


@query(f"{O.LEDGER}, {_HIGHS} select * from highs")
def position_highs(spark, d):
    return L.position_highs(traded(spark, d), bars(spark, d))


_RISK = f"{_HIGHS}, top_ as (select marked.*, highest_price as top, (average_cost * 0.95)::decimal(18,4) as stop_, (average_cost * 1.08)::decimal(18,4) as target_ from marked join highs using (account_id, symbol))"


@query(
    f"{O.LEDGER}, {_RISK}, ev as (select account_id, symbol, last_price, 'STOP_LOSS' as event_type, 'HIGH' as level, stop_ as trigger_price from top_ where not missing and last_price <= stop_ "
    "union all select account_id, symbol, last_price, 'TAKE_PROFIT', 'MEDIUM', target_ from top_ where not missing and last_price >= target_ "
    "union all select account_id, symbol, last_price, 'TRAILING_STOP', 'HIGH', round(top * 0.96, 4)::decimal(18,4) from top_ where not missing and top > average_cost and last_price <= round(top * 0.96, 4) "
    "union all select account_id, symbol, null, 'DATA_MISSING', 'MEDIUM', null from top_ where missing) "
    "select account_id, symbol, event_type, level, trigger_price, account_id || ':' || symbol || ':' || event_type || ':1998-12-01' as event_key from ev"
)
def risk_events(spark, d):
    kind = "decimal(18,4)"
    fills = traded(spark, d)
    highs = L.position_highs(fills, bars(spark, d))
    df = marked_positions(spark, d, fills).join(highs, ["account_id", "symbol"], "left").withColumns(
        {
            "stop_loss": (F.col("average_cost") * F.lit("0.95").cast("decimal(4,2)")).cast(kind),
            "target_price": (F.col("average_cost") * F.lit("1.08").cast("decimal(4,2)")).cast(kind), "trailing_pct": F.lit(None).cast("decimal(8,4)"), "last_price": F.when(~F.col("missing"), F.col("last_price")),
        }
    )
    return risk.check_risk(df, F.lit("1998-12-01")).select("account_id", "symbol", "event_type", "level", "trigger_price", "event_key")


@query(
    f"{O.LEDGER}, dly as (select account_id, trade_date, sum(case when side = 'BUY' then -net else net end) as ch, sum(realized) as gain from fills where status = 'FILLED' group by 1, 2), "
    "cum as (select account_id, trade_date, (100000000 + sum(ch) over w)::decimal(20,2) as cash, (sum(gain) over w)::decimal(20,2) as realized_pnl, row_number() over (partition by account_id order by trade_date desc) as k from dly window w as (partition by account_id order by trade_date)), "
    "st as (select account_id, symbol, trade_date as since, max_by(held, order_id) as quantity, max_by(average_cost, order_id) as cost from fills where status = 'FILLED' group by 1, 2, 3), "
    "sp as (select *, lead(since) over (partition by account_id, symbol order by since) as till from st), "
    "hd as (select c.account_id, c.trade_date, s.symbol, s.quantity, s.cost from cum c join sp s on s.account_id = c.account_id and c.trade_date >= since and (till is null or c.trade_date < till) where c.k <= 90 and s.quantity > 0), "
    "px as (select hd.*, coalesce(b.close, cost)::decimal(18,4) as price from hd asof left join (select symbol as s, trade_date as d, close from bars where adjust_type = 'QFQ') b on b.s = hd.symbol and hd.trade_date >= b.d), "
    "vl as (select account_id, trade_date, sum(round(price * quantity, 2))::decimal(20,2) as market_value, sum(round((price - cost) * quantity, 2))::decimal(20,2) as unrealized_pnl, count(*) as positions from px group by 1, 2) "
    "select account_id, trade_date, cash, realized_pnl, coalesce(market_value, 0)::decimal(20,2) as market_value, coalesce(unrealized_pnl, 0)::decimal(20,2) as unrealized_pnl, coalesce(positions, 0) as positions, "
    "(cash + coalesce(market_value, 0))::decimal(20,2) as total_asset, round((cash + coalesce(market_value, 0))::double / 100000000 - 1, 8) as total_return from cum left join vl using (account_id, trade_date) where k <= 90"
)
def equity_curve(spark, d):
    return L.equity_curve(traded(spark, d), bars(spark, d), CAPITAL, 90)


@query(
    f"{O.LEDGER}, {_HIGHS}, src as (select account_id, symbol, max_by(order_id, k) as plan_id from fills where status = 'FILLED' and side = 'BUY' group by 1, 2), "
    "pl as (select order_id as plan_id, round(price * 0.95, 2)::decimal(18,2) as stop_loss, round(price * 1.08, 2)::decimal(18,2) as target_price, case when order_id % 2 = 0 then 'OPEN' else 'ORDER_CREATED' end as plan_status from order_feed where side = 'BUY' and order_id % 3 > 0) "
    f"select m.account_id, m.symbol, coalesce(u.name, m.symbol) as name, m.quantity, m.market_value, h.highest_price, round(h.highest_price * 0.96, 4)::decimal(18,4) as trailing_stop_price, stop_loss, target_price, plan_status "
    f"from marked m left join highs h using (account_id, symbol) left join src using (account_id, symbol) left join pl using (plan_id) left join ({NAMES}) u on u.symbol = m.symbol"
)
def position_details(spark, d):
    """The view with names, plans and trailing stops; two thirds of the orders have a plan."""
    fills, orders = traded(spark, d), order_feed(spark, d).where("side = 'BUY' and order_id % 3 > 0")
    source = fills.where("bought_id is not null").groupBy("account_id", "symbol").agg(F.max_by("bought_id", "trade_date").alias("source_plan_id"))
    ladder = price_ladder(F.col("price"))
    plans = orders.select(F.col("order_id").alias("plan_id"), ladder["stop_loss"].alias("stop_loss"), ladder["target1"].alias("target1"), F.when(F.col("order_id") % 2 == 0, "OPEN").otherwise("ORDER_CREATED").alias("status"))
    df = L.position_details(marked_positions(spark, d, fills).join(source, ["account_id", "symbol"], "left"), L.position_highs(fills, bars(spark, d)), names(spark, d), plans)
    return df.select("account_id", "symbol", "name", "quantity", "market_value", "highest_price", "trailing_stop_price", "stop_loss", "target_price", "plan_status")


@query(f"{O.LEDGER} select account_id, count(*) as symbols from (select account_id, symbol from pos union select account_id, symbol from order_feed where side = 'BUY' and trade_date >= date '1998-07-01') group by 1")
def held_or_pending_union(spark, d):
    return L.held_or_pending(L.positions(L.replay(order_feed(spark, d))), order_feed(spark, d).where("side = 'BUY' and trade_date >= date '1998-07-01'"))


@query(f"{O.SCORED} select symbol, latest_close, round(latest_close * 1.01, 2)::decimal(18,4) as price, (floor((100000 * {WEIGHT})::double / (round(latest_close * 1.01, 2) * 100)::double) * 100)::bigint as quantity from scan where eligible")
def orders_from_plans(spark, d):
    plans = L.plans_from_results(scanned(spark, d).where("eligible"), raw_universe(spark, d).select(F.col("code").alias("symbol"), F.lit("CLOSED").alias("status")))
    out = L.orders_from_plans(plans, F.lit("100000"))
    return out.join(scanned(spark, d).select("symbol", "latest_close"), "symbol").select("symbol", "latest_close", "price", "quantity")


_DELTA = "select symbol, trade_date, open, high, low, (close + 1)::decimal(18,4) as close, volume, amount, turnover_rate, adjust_type from bars where trade_date >= date '1998-06-01'"


@query(f"{O.BASE}, dl as ({_DELTA}) select b.symbol, b.trade_date, coalesce(dl.close, b.close)::decimal(18,4) as close, b.volume from bars b left join (select * from (select *, row_number() over (partition by symbol order by trade_date desc) as k from dl) where k <= 90) dl using (symbol, trade_date, adjust_type)")
def bars_upsert(spark, d):
    base = bars(spark, d).withColumn("close", F.col("close").cast("decimal(18,4)"))
    delta = base.where("trade_date >= date '1998-06-01'").select(*incremental.KEYS, (F.col("close") + 1).cast("decimal(18,4)").alias("close"))
    return incremental.incremental_update(base, delta).select("symbol", "trade_date", "close", "volume")


@query(f"{O.BASE.replace(UNIVERSE, WIDE)} select symbol from bars union select code from raw_universe")
def securities_insert_absent(spark, d):
    known = bars(spark, d).select("symbol").distinct()
    return merge.insert_absent(known, wide_universe(spark, d).select(F.col("code").alias("symbol")), ["symbol"])


@query(f"{O.BASE}, two as (select symbol, trade_date, close, 1 as priority from bars union all select symbol, trade_date, price, 2 from order_feed) select symbol, min(priority) as priority, count(*) as n from two t where priority = (select min(priority) from two x where x.symbol = t.symbol) group by 1")
def source_priority(spark, d):
    own = bars(spark, d).select("symbol", "trade_date", "close", F.lit(1).alias("priority"))
    both = own.unionByName(order_feed(spark, d).select("symbol", "trade_date", F.col("price").alias("close"), F.lit(2).alias("priority")))
    return merge.resolve_source(both).groupBy("symbol").agg(F.min("priority").alias("priority"), F.count(F.lit(1)).alias("n"))


_TASKS = "select o_orderkey as id, case when o_orderstatus = 'F' then 'COMPLETED' when o_orderstatus = 'O' then 'RUNNING' else 'FAILED' end as status, o_orderkey % 5 = 0 as official from orders"
_FAILS = "select o_orderkey as task_id, l_linenumber, l_quantity < 20 as resolved from lineitem join orders on l_orderkey = o_orderkey"


def _tasks(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderkey") % 5 == 0).alias("official"))


def _failures(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("task_id"), (F.col("l_quantity") < 20).alias("resolved"))


@query(f"select t.*, coalesce(n, 0) as unresolved_failures from ({_TASKS}) t left join (select task_id, count(*) as n from ({_FAILS}) where not resolved group by 1) f on f.task_id = t.id order by id desc limit 50")
def scan_history_failcount(spark, d):
    return market.task_history(_tasks(spark, d), _failures(spark, d), 50)


@query(f"select * from ({_TASKS}) where status = 'COMPLETED' order by official desc, id desc limit 1")
def latest_official_task(spark, d):
    return market.latest_official(_tasks(spark, d))


@query("select user_id, cast(date_trunc('day', ts) as timestamp) as bar_start, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as n from events group by 1, 2")
def ohlc_from_events(spark, d):
    return incremental.ohlc(spark.read.parquet(f"{d}/events.parquet"))


@query(f"{O.SCORED} select signal_level, risk_level, count(*) as n, sum(score)::bigint as total from scored group by cube (signal_level, risk_level)")
def level_cube(spark, d):
    """An extension: how levels are spread."""
    df = S.dynamic_analysis(bars(spark, d)).cube("signal_level", "risk_level")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@query(f"{O.LEDGER}, r as (select account_id, symbol, 1000000::decimal(20,2) as total_capital, (account_id * 20000)::decimal(20,2) as available_cash, (account_id % 7)::int as current_positions, (account_id * 0.02)::decimal(8,4) as account_drawdown, (account_id * 0.005)::decimal(8,4) as daily_loss_pct, average_cost as price, (0.05 * (account_id % 6))::decimal(8,4) as requested_weight from pos), q as (select *, greatest(least(requested_weight, 0.20), 0)::decimal(8,4) as weight from r), s as (select *, (floor(least(total_capital * weight, available_cash)::double / (price * 100)::double) * 100)::bigint as quantity from q) select account_id, symbol, weight, quantity, round(price * quantity, 2)::decimal(20,2) as suggested_amount, (current_positions < 5 and account_drawdown < 0.12 and daily_loss_pct < 0.03 and quantity >= 100) as allowed from s")
def buy_gate(spark, d):
    n = F.col("account_id")
    dec = lambda c, k: c.cast(k)
    requests = L.positions(L.replay(order_feed(spark, d))).select(
        "account_id", "symbol", dec(F.lit(1000000), "decimal(20,2)").alias("total_capital"), dec(n * 20000, "decimal(20,2)").alias("available_cash"), (n % 7).cast("int").alias("current_positions"),
        dec(n * F.lit("0.02").cast("decimal(4,2)"), "decimal(8,4)").alias("account_drawdown"), dec(n * F.lit("0.005").cast("decimal(5,3)"), "decimal(8,4)").alias("daily_loss_pct"),
        F.col("average_cost").alias("price"), dec(F.lit("0.05").cast("decimal(4,2)") * (n % 6), "decimal(8,4)").alias("requested_weight"),
    )
    return risk.validate_buy(requests).select("account_id", "symbol", "weight", "quantity", "suggested_amount", "allowed")


def queries() -> dict:
    from . import record_queries

    return dict(record_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import record_queries

    return {k: SQL[k] for k in record_queries.QUERIES if k in SQL}
