"""SQL with the meaning of the registered queries, for another engine to check them against. Used by checks only."""

from __future__ import annotations

from .operators.score import DEFAULT_BEARISH, DEFAULT_BULLISH
from .sources.fixtures import BARS, ORDERS, UNIVERSE

DAILY = ("600000", "600036", "601318", "601166", "601398", "601088", "600028", "600309", "000001", "000858", "002415", "002594")
A = "0.07142857142857142"


def ewm(x: str, alpha: str, n: str, w: str = "r") -> str:
    return f"sum(case when {n} = 0 then {x} when {n} > 0 then {alpha}::double * {x} end * pow(1.0::double - {alpha}::double, -({n}))) over {w} * pow(1.0::double - {alpha}::double, {n})"


BASE = f"""with bars as ({BARS}), raw_universe as ({UNIVERSE}), order_feed as ({ORDERS})"""
TAIL = f"""{BASE}, t as (
  select *, row_number() over (partition by symbol order by trade_date) - 1 as n, count(*) over (partition by symbol) as n_bars
  from (select *, row_number() over (partition by symbol order by trade_date desc) as rd from bars) where rd <= 260
), i1 as (
  select *, close::double as c,
    {", ".join(f"case when n >= {p - 1} then (sum(close) over (partition by symbol order by trade_date rows {p - 1} preceding))::double / {p} end as ma{p}" for p in (5, 10, 20, 60))},
    {", ".join(f"(close::double / lag(close, {p}) over w::double - 1) * 100 as return{p}".replace("over w::double", "over w") for p in (5, 20, 60))},
    greatest((close - lag(close) over w)::double, 0.0::double) as gain_, greatest((lag(close) over w - close)::double, 0.0::double) as loss_, lag(close) over w is null as first_bar,
    greatest(high::double - low::double, abs(high::double - (lag(close) over w)::double), abs(low::double - (lag(close) over w)::double)) as true_range,
    {ewm("close::double", "(2.0::double/13)", "n")} as ema12, {ewm("close::double", "(2.0::double/27)", "n")} as ema26,
    close::double / (lag(close) over w)::double - 1 as daily_return,
    (sum(volume) over p20)::double / 20 as avg_volume_prev20, (sum(amount) over l20)::double as amount20, (sum(volume * close * 100) over l20)::double as estimate20,
    max(close) over p20 as prev_high20, max(close) over l20 as high20, min(close) over l20 as low20
  from t
  window w as (partition by symbol order by trade_date), r as (partition by symbol order by trade_date rows unbounded preceding),
    l20 as (partition by symbol order by trade_date rows 19 preceding), p20 as (partition by symbol order by trade_date rows between 20 preceding and 1 preceding)
), i2 as (
  select * exclude (gain_, loss_), case when not first_bar then gain_ end as gain, case when not first_bar then loss_ end as loss from i1
), i3 as (
  select *, case when n >= 14 then {ewm("gain", A, "(n - 1)")} end as avg_gain, case when n >= 14 then {ewm("loss", A, "(n - 1)")} end as avg_loss,
    case when n >= 13 then {ewm("true_range", A, "n")} end as atr14, ema12 - ema26 as macd,
    stddev_pop(daily_return) over (partition by symbol order by trade_date rows 19 preceding) * 100 as volatility20,
    count(*) filter (where daily_return >= 0.095) over (partition by symbol order by trade_date rows 4 preceding) as limit_ups
  from i2 window r as (partition by symbol order by trade_date rows unbounded preceding)
), i4 as (
  select *, macd - {ewm("macd", "0.2", "n")} as macd_hist from i3 window r as (partition by symbol order by trade_date rows unbounded preceding)
), ind as (
  select *, lag(macd_hist) over (partition by symbol order by trade_date) as prev_hist, coalesce(100 - 100 / (1 + avg_gain / nullif(avg_loss, 0)), 100.0::double) as rsi14, atr14 / c * 100 as atr_pct,
    coalesce(volume::double / nullif(avg_volume_prev20, 0), 0) as volume_ratio20, case when amount20 > 0 then amount20 else estimate20 end / 20 as avg_amount20,
    close >= prev_high20 as breakout20, (c / high20::double - 1) * 100 as drawdown20,
    case when high20 > low20 then (c - low20::double) / (high20::double - low20::double) * 100 else 50.0::double end as range_position20, daily_return * 100 as day_return
  from i4
)"""
SCORED = f"""{TAIL}, lat as (select * from ind where n = n_bars - 1 and n_bars >= 80), s1 as (
  select *,
    case when c > ma20 and ma20 > ma60 then 15 when c > ma20 then 7 when c < ma20 and ma20 < ma60 then -15 else -5 end as pts_trend,
    case when ma5 > ma10 and ma10 > ma20 then 8 when ma5 < ma10 and ma10 < ma20 then -8 else 0 end as pts_short,
    case when rsi14 between 50 and 70 then 8 when rsi14 > 78 then -8 when rsi14 < 35 then -5 else 0 end as pts_rsi,
    case when return20 > 0 and return20 <= 15 then 7 when return20 > 25 then -7 when return20 < -12 then -8 else 0 end as pts_return20,
    case when volume_ratio20 between 1.2::double and 2.5::double then 8 when volume_ratio20 > 3.5 then -5 when volume_ratio20 < 0.65::double then -3 else 0 end as pts_volume,
    case when breakout20 then 10 when drawdown20 >= -2 then 3 when drawdown20 <= -10 then -6 else 0 end as pts_breakout,
    case when macd_hist > 0 and macd_hist >= prev_hist then 6 when macd_hist < 0 and macd_hist < prev_hist then -6 else 0 end as pts_macd,
    case when atr_pct between 1.2::double and 5.5::double then 3 when atr_pct > 7 then -10 else 0 end as pts_atr,
    case when volatility20 > 4.5 then -7 else 0 end as pts_volatility,
    case when turnover_rate::double between 1 and 10 then 2 when turnover_rate::double > 18 then -4 else 0 end as pts_turnover
  from lat
), s2 as (
  select *, greatest(0, least(100, 50 + pts_trend + pts_short + pts_rsi + pts_return20 + pts_volume + pts_breakout + pts_macd + pts_atr + pts_volatility + pts_turnover))::int as score from s1
), s3 as (
  select *, case when score >= 75 then 'STRONG' when score >= 60 then 'WATCH' when score >= 45 then 'NEUTRAL' else 'WEAK' end as signal_level,
    case when atr_pct >= 7 or volatility20 >= 4.5 or return20 <= -15 then 'HIGH' when atr_pct <= 3.5 and volatility20 <= 2.8 and score >= 65 then 'LOW' else 'MEDIUM' end as risk_level from s2
), scored as (
  select *, concat_ws('|', case when score < 60 then '综合评分低于60' end, case when risk_level = 'HIGH' then '风险等级为HIGH' end, case when avg_amount20 < 50000000 then '近20日平均成交额低于5000万元' end,
    case when atr_pct > 7 then 'ATR波动超过7%' end, case when return20 > 25 then '近20日涨幅超过25%，追高风险较大' end, case when return20 < -10 then '近20日跌幅超过10%' end,
    case when drawdown20 < -12 then '较20日高点回撤超过12%' end, case when volume_ratio20 < 0.65::double then '成交活跃度不足' end,
    case when day_return >= 9.5 then '最新交易日接近涨停，不宜追价' end, case when limit_ups >= 2 then '近5日出现多次涨停，短线波动过大' end) as reasons,
    round(close, 2)::decimal(18,2) as latest_close
  from s3
), universe as (
  select symbol, coalesce(max(name), symbol) as name, case when symbol like '6%' then 'SH' else 'SZ' end as exchange, 'MAIN' as board,
    contains(upper(coalesce(max(name), symbol)), 'ST') or contains(coalesce(max(name), symbol), '退') as is_st, not contains(coalesce(max(name), symbol), '退') as is_active
  from (select lpad(code, greatest(6, length(code))::int, '0') as symbol, nullif(trim(name), '') as name from raw_universe)
  where length(symbol) = 6 and left(symbol, 3) in ('000', '001', '002', '003', '600', '601', '603', '605') group by symbol
), scan as (
  select s.*, u.name, reasons = '' as eligible, (row_number() over (order by reasons = '' desc, score desc, trade_date desc, symbol))::int as rank_no
  from scored s join universe u using (symbol) where u.is_active and not u.is_st
)"""
NOTED = f"""{SCORED}, noted as (
  select *, concat_ws('；',
      case when c > ma20 and ma20 > ma60 then '价格位于20日均线上方，且MA20高于MA60，中期趋势偏强' when c > ma20 then '价格站上20日均线，短线趋势有所改善' end,
      case when ma5 > ma10 and ma10 > ma20 then 'MA5、MA10、MA20形成短期多头排列' end,
      case when rsi14 between 50 and 70 then printf('RSI14为%.1f，动量处于相对健康区间', rsi14) when rsi14 <= 78 and rsi14 >= 35 then printf('RSI14为%.1f，暂未出现极端超买', rsi14) end,
      case when return20 > 0 and return20 <= 15 then printf('近20日收益%+.2f%%，上涨节奏相对温和', return20) end,
      case when volume_ratio20 between 1.2::double and 2.5::double then printf('当日量比约%.2f，成交量温和放大', volume_ratio20) end,
      case when breakout20 then '收盘价突破前20个交易日收盘高点' when drawdown20 >= -2 then '价格接近20日高位，处于突破观察区' end,
      case when macd_hist > 0 and macd_hist >= prev_hist then 'MACD柱线位于零轴上方且继续增强' end,
      case when atr_pct between 1.2::double and 5.5::double then printf('ATR占价格%.2f%%，波动水平适合短线观察', atr_pct) end) as bull,
    concat_ws('；',
      case when c > ma20 then null when c < ma20 and ma20 < ma60 then '价格低于20日均线且MA20低于MA60，趋势结构偏弱' else '价格尚未形成清晰的中期多头排列' end,
      case when ma5 < ma10 and ma10 < ma20 then '短期均线呈空头排列' end,
      case when rsi14 > 78 then printf('RSI14为%.1f，短线存在过热和回撤风险', rsi14) when rsi14 < 35 then printf('RSI14为%.1f，当前动量偏弱', rsi14) end,
      case when return20 > 25 then printf('近20日累计上涨%+.2f%%，短线追高风险增加', return20) when return20 < -12 then printf('近20日收益%+.2f%%，阶段走势明显偏弱', return20) end,
      case when volume_ratio20 > 3.5 then printf('当日量比约%.2f，放量过快需防冲高回落', volume_ratio20) when volume_ratio20 < 0.65::double then printf('当日量比约%.2f，市场参与度偏低', volume_ratio20) end,
      case when not breakout20 and drawdown20 < -2 and drawdown20 <= -10 then printf('较20日高点回撤%.2f%%，修复压力仍在', abs(drawdown20)) end,
      case when macd_hist < 0 and macd_hist < prev_hist then 'MACD柱线为负且继续走弱' end,
      case when atr_pct > 7 then printf('ATR占价格%.2f%%，短线波动风险较高', atr_pct) end,
      case when volatility20 > 4.5 then printf('近20日单日波动率约%.2f%%，价格稳定性较弱', volatility20) end,
      case when turnover_rate::double > 18 then printf('最新换手率%.2f%%，筹码交换较为剧烈', turnover_rate::double) end) as bear
  from scored
), notes as (
  select symbol, coalesce(nullif(bull, ''), '{DEFAULT_BULLISH}') as bullish, coalesce(nullif(bear, ''), '{DEFAULT_BEARISH}') as bearish,
    '截至' || trade_date || printf('，收盘价%s元，近5日%+.2f%%、近20日%+.2f%%。当前价格', latest_close::varchar, return5, return20) || case when c >= ma20 then '高于' else '低于' end || printf('20日均线，RSI14为%.1f，量比约%.2f，动态规则评分为%d分。', rsi14, volume_ratio20, score) as summary
  from noted
)"""
EXACT = f"""{BASE}, e0 as (
  select *, row_number() over w - 1 as n, count(*) over (partition by symbol) as n_bars, greatest(close - lag(close) over w, 0) as up_, greatest(lag(close) over w - close, 0) as down_, lag(close) over w as pc
  from bars window w as (partition by symbol order by trade_date)
), e1 as (
  select *, case when pc is not null then up_ end as up, case when pc is not null then down_ end as down, greatest(high - low, abs(high - pc), abs(low - pc)) as tr from e0
), e2 as (
  select *, {", ".join(f"case when n >= {p - 1} then round((sum(close) over (partition by symbol order by trade_date rows {p - 1} preceding))::double / {p}, 6)::decimal(18,6) end as sma{p}" for p in (5, 20, 60))},
    ((sum(up) over l14) * 10000)::hugeint as ups, ((sum(down) over l14) * 10000)::hugeint as downs, case when n >= 14 then round((sum(tr) over l14)::double / 14, 6)::decimal(18,6) end as atr,
    case when n >= 19 then round((sum(volume) over l20)::double / 20, 6)::decimal(18,6) end as avg_volume20, case when n >= 20 then max(close) over p20 end as prev_high
  from e1 window l14 as (partition by symbol order by trade_date rows 13 preceding), l20 as (partition by symbol order by trade_date rows 19 preceding), p20 as (partition by symbol order by trade_date rows between 20 preceding and 1 preceding)
), exact as (
  select *, case when n >= 14 then case when downs = 0 then 100 else 100 - (((200000000000000::hugeint + q) // (2 * q))::double / 1000000)::decimal(18,6) end end::decimal(18,6) as rsi,
    round(volume::double / avg_volume20::double, 4)::decimal(18,4) as ratio, (((2 * (atr * 1000000)::hugeint * 10000 + (close * 10000)::hugeint) // (2 * (close * 10000)::hugeint))::double / 1000000)::decimal(18,6) as atr_share from (select *, 1000000 + (2 * ups * 1000000 + downs) // (2 * nullif(downs, 0)) as q from e2)
)"""
MULTI = f"""{EXACT}, m1 as (
  select *, close > sma20 and sma20 > sma60 as trend, close > sma5 as over5, rsi between 50 and 72 as calm, ratio between 1.25 and 3 as vol, close >= prev_high as brk, atr_share between 0.015 and 0.06 as band
  from exact where n = n_bars - 1 and n_bars >= 61
), multi as (
  select symbol, trade_date as signal_date, close as reference_price,
    least(100, 25 * trend::int + 8 * over5::int + 18 * calm::int + 15 * vol::int + 20 * brk::int + 9 * band::int)::int as score,
    concat_ws('；', case when trend then '中短期趋势向上' end, case when over5 then '收盘价位于5日均线上方' end, case when calm then 'RSI动量健康' end, case when vol then '成交量温和放大' end, case when brk then '突破近20日收盘高点' end, case when band then '波动率适合短线交易' end) as reasons,
    concat_ws('；', case when not trend then '趋势结构未形成多头排列' end, case when rsi > 78 then '短线指标过热' end, case when ratio > 4 then '成交量异常放大，存在冲高回落风险' end, case when not band then '波动率不处于理想区间' end) as risks
  from m1
), signals as (select *, case when score >= 70 then 'BUY' when score >= 55 then 'WATCH' else 'AVOID' end as action from multi)"""
BACKTEST = """, b0 as (
  select *, (row_number() over w - 1)::int as n, count(*) over (partition by symbol) as n_bars, round((sum(close) over (partition by symbol order by trade_date rows 19 preceding))::double / 20, 6) as avg20,
    lead(open) over w as entry, lead(trade_date) over w as entry_date
  from {bars} window w as (partition by symbol order by trade_date)
), sig as (
  select symbol, n as signal_n, trade_date as signal_date, entry_date, entry::decimal(18,4) as entry from b0
  where n >= 20 and (n - 20) % 10 = 0 and n < n_bars - 2 and n_bars >= 30 and close::double > avg20
), walk as (
  select s.*, b.n, b.trade_date as exit_date, b.low, b.high, b.close, greatest(s.entry, max(b.high) over (partition by s.symbol, s.signal_n order by b.n rows unbounded preceding)) as top
  from sig s join b0 b on b.symbol = s.symbol and b.n > s.signal_n and b.n <= s.signal_n + 11
), hit as (
  select *, case when low <= entry * 0.95 then 'STOP_LOSS' when high >= entry * 1.08 then 'TAKE_PROFIT' when close <= top * 0.96 then 'TRAILING_STOP' end as hit from walk
), fin as (
  select *, row_number() over (partition by symbol, signal_n order by hit is null, case when hit is null then -n else n end) as k from hit
), exits as (
  select symbol, signal_n, signal_date, entry_date, entry, n as exit_n, exit_date, coalesce(hit, 'MAX_HOLD') as reason,
    case coalesce(hit, 'MAX_HOLD') when 'STOP_LOSS' then (entry * 0.95)::decimal(28,8) when 'TAKE_PROFIT' then (entry * 1.08)::decimal(28,8) else close::decimal(28,8) end as exit_price
  from fin where k = 1
), leg as (select *, row_number() over (partition by symbol order by signal_n) as k from exits),
fold as (
  select symbol, 0::bigint as k, 100000::decimal(28,8) as capital, 100000::decimal(28,8) as peak, null::bigint as n, 0::bigint as quantity, null::decimal(28,8) as pnl from (select distinct symbol from leg)
  union all
  select symbol, k, (capital + pnl)::decimal(28,8), greatest(peak, (capital + pnl)::decimal(28,8)), n, quantity, pnl from (
    select *, case when quantity < 100 then 0 else (sell - buy - ((buy + sell) * 0.0003)::decimal(28,8) - (sell * 0.0005)::decimal(28,8)) end::decimal(28,8) as pnl from (
      select f.symbol, l.k, f.capital, f.peak, l.signal_n as n, q as quantity, (l.entry * q)::decimal(28,8) as buy, (l.exit_price * q)::decimal(28,8) as sell
      from (select *, 0 as z from fold) f join leg l on l.symbol = f.symbol and l.k = f.k + 1, lateral (select (floor((f.capital * 0.20)::double / (l.entry * 100)::double) * 100)::bigint as q) x))
), trades as (
  select l.symbol, l.signal_n as n, l.entry_date, l.exit_date, l.entry, l.exit_price, l.reason, f.quantity, f.pnl, f.capital, f.peak,
    round(f.pnl::double / (l.entry * f.quantity)::double, 6) as trade_return, round((f.peak - f.capital)::double / f.peak::double, 6) as drawdown
  from fold f join leg l using (symbol, k) where f.quantity >= 100
), done as (
  select symbol, max_by(capital, n)::double as final_capital, max(drawdown) as max_drawdown, count(*) as trades, count(*) filter (where pnl > 0) as wins,
    coalesce(sum(pnl::double) filter (where pnl > 0), 0) as gross_win, coalesce(-sum(pnl::double) filter (where pnl < 0), 0) as gross_loss
  from trades group by symbol
), summary as (
  select a.symbol, round(coalesce(final_capital, 100000::double), 4) as final_capital, round(coalesce(final_capital / 100000 - 1, 0::double), 6) as total_return, coalesce(max_drawdown, 0::double) as max_drawdown,
    round(coalesce(wins::double / trades, 0), 6) as win_rate, round(coalesce(case when gross_loss = 0 then gross_win else gross_win / gross_loss end, 0), 6) as profit_loss_ratio, coalesce(trades, 0)::bigint as trade_count
  from (select symbol from {bars} group by symbol having count(*) >= 30) a left join done using (symbol)
)"""
LEDGER = f"""{BASE.replace("with bars", "with recursive bars", 1)}, o1 as (
  select *, round(price * quantity, 2)::decimal(20,2) as gross from order_feed
), o2 as (
  select *, greatest(round(gross * 0.0003, 2), 5)::decimal(18,2) as commission, case when side = 'SELL' then round(gross * 0.0005, 2) else 0 end::decimal(18,2) as stamp_duty, round(gross * 0.00001, 2)::decimal(18,2) as transfer_fee from o1
), o3 as (
  select *, (commission + stamp_duty + transfer_fee)::decimal(20,2) as total_fee, case when quantity <= 0 or quantity % 100 <> 0 then 'BAD_LOT' when price <= 0 then 'BAD_PRICE' end as reject_reason from o2
), ord as (
  select *, case when side = 'BUY' then gross + total_fee else gross - total_fee end::decimal(20,2) as net, row_number() over (partition by account_id, symbol order by trade_date, order_id) as k from o3
), led as (
  select account_id, symbol, 0::bigint as k, null::bigint as order_id, 0::bigint as held, 0::bigint as free, 0::decimal(18,4) as cost, null::date as bought, ''::varchar as status, 0::decimal(20,2) as realized from (select distinct account_id, symbol from ord)
  union all
  select account_id, symbol, k, order_id, held2, case when st = 'FILLED' and side = 'SELL' then fr - quantity else fr end,
    case when st = 'FILLED' and side = 'BUY' then (((2 * ((cost * held + net) * 10000)::hugeint + held2) // (2 * held2))::double / 10000)::decimal(18,4) when held2 = 0 then 0 else cost end::decimal(18,4),
    case when st = 'FILLED' and side = 'BUY' then trade_date when held2 = 0 then null else bought end, st,
    case when st = 'FILLED' and side = 'SELL' then round((net - cost * quantity)::decimal(28,4), 2) else 0 end::decimal(20,2)
  from (
    select *, case when st = 'FILLED' and side = 'BUY' then held + quantity when st = 'FILLED' then held - quantity else held end as held2 from (
      select *, coalesce(reject_reason, case when side = 'BUY' or fr >= quantity then 'FILLED' else 'OVERSELL' end) as st from (
        select l.account_id, l.symbol, o.k, o.order_id, l.held, case when l.bought < o.trade_date then l.held else l.free end as fr, l.cost, l.bought, o.side, o.quantity::bigint as quantity, o.net, o.trade_date, o.reject_reason
        from led l join ord o on o.account_id = l.account_id and o.symbol = l.symbol and o.k = l.k + 1)))
), fills as (
  select o.account_id, o.symbol, o.order_id, o.side, o.quantity, o.price, o.trade_date, o.gross, o.total_fee, o.net, l.status, l.realized, l.held, l.free as available, l.cost as average_cost, o.k
  from led l join ord o using (account_id, symbol, k)
), pos as (
  select account_id, symbol, max_by(held, k) as quantity, max_by(available, k) as available_quantity, max_by(average_cost, k) as average_cost, max(trade_date) filter (where status = 'FILLED' and side = 'BUY') as last_buy_date
  from fills group by 1, 2 having max_by(held, k) > 0
), latest as (
  select symbol, max(trade_date) as latest_date, max_by(close, trade_date) as latest_price from bars where adjust_type = 'QFQ' group by 1
), mark as (
  select p.*, l.latest_price is null as missing, coalesce(l.latest_price, average_cost)::decimal(18,4) as last_price from pos p left join latest l using (symbol)
), marked as (
  select *, round(last_price * quantity, 2)::decimal(20,2) as market_value, round((last_price - average_cost) * quantity, 2)::decimal(20,2) as unrealized_pnl from mark
), cash as (
  select account_id, (100000000 + sum(case when side = 'BUY' then -net else net end))::decimal(20,2) as cash, sum(realized)::decimal(20,2) as realized_pnl, sum(total_fee)::decimal(20,2) as total_fees
  from fills where status = 'FILLED' group by 1
)"""
