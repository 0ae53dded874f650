"""SQL of the ledger in event order: a recursion over each account's events, with its live state in lists of structs.

Money is in cents and prices in ten-thousandths, as integers. Written from the rules, not from the operator's steps: first what the event
is about, then why it may not be, then the new state.
"""

from .sources.fixtures import EVENTS


def _half_up(value: str, unit: str) -> str:
    return f"(sign({value}) * ((2 * abs({value}) + {unit}) // (2 * {unit})))::bigint"


_VALUE = "coalesce(list_sum(list_transform(ps, lambda p: (p.price * p.quantity + 50) // 100)), 0)::bigint"
_DONE = "reason is null and kind"
_POSITION = "{{'symbol': {symbol}, 'quantity': ({quantity})::bigint, 'free': ({free})::bigint, 'cost': ({cost})::bigint, 'price': ({price})::bigint, 'bought': {bought}, 'plan': {plan}}}"
_KEEP = {"symbol": "p.symbol", "quantity": "p.quantity", "free": "p.free", "cost": "p.cost", "price": "p.price", "bought": "p.bought", "plan": "p.plan"}


def _changed(**values: str) -> str:
    return _POSITION.format(**_KEEP | values)


_SETTLED = _changed(free="p.quantity - coalesce(list_sum(list_transform(list_filter(orders, lambda o: o.symbol = p.symbol and o.side = 'SELL'), lambda o: o.quantity)), 0)")
_BOUGHT = _POSITION.format(
    symbol="about", quantity="coalesce(own.quantity, 0) + q", free="coalesce(own.free, 0)", price="pr", bought="day", plan="coalesce(ord.plan, own.plan)",
    cost="(2 * (coalesce(own.cost * own.quantity, 0) + 100 * net) + coalesce(own.quantity, 0) + q) // (2 * (coalesce(own.quantity, 0) + q))",
)

LEDGER_EVENTS = f"""
with recursive ev as (
  select account_id, seq, day, kind, order_id, plan_id, symbol, side, quantity::bigint as quantity, (price * 10000)::bigint as price, (latest * 10000)::bigint as latest, (weight * 10000)::bigint as weight
  from ({EVENTS})
), r as (
  select distinct account_id, 0::bigint as seq, 100000000::bigint as cash, 0::bigint as frozen, 0::bigint as realized_pnl, 0::bigint as fees,
    []::struct(id bigint, symbol varchar, status varchar, price bigint, weight bigint)[] as plans,
    []::struct(id bigint, symbol varchar, side varchar, quantity bigint, price bigint, net bigint, gross bigint, plan bigint)[] as orders,
    []::struct(symbol varchar, quantity bigint, free bigint, cost bigint, price bigint, bought date, plan bigint)[] as pos,
    null::date as day, null::varchar as kind, null::bigint as order_id, null::bigint as plan_id, null::varchar as symbol, null::varchar as reason, null::varchar as order_status, null::varchar as plan_status, ''::varchar as also_cancelled,
    null::bigint as quantity, null::bigint as price, 0::bigint as net, 0::bigint as realized, 0::bigint as value
  from ev
  union all
  select account_id, seq, cash, frozen, realized_pnl, fees,
    list_filter(plans, lambda x: not (coalesce(x.id = about_plan, false) and x.status in ('CLOSED', 'CANCELLED') and len(list_filter(orders, lambda o: o.plan = x.id)) = 0 and len(list_filter(ps, lambda p: p.plan = x.id)) = 0)),
    orders, ps, day, kind, order_id, about_plan, about, reason,
    case when reason is null and kind in ('ORDER', 'PLAN_ORDER') or kind = 'CONFIRM' and reason is not null and ord is not null then 'PENDING_CONFIRM' when {_DONE} = 'CONFIRM' then 'FILLED' when {_DONE} = 'CANCEL' then 'CANCELLED' end,
    list_filter(plans, lambda x: x.id = about_plan)[1].status, gone, q, pr, net, gain, {_VALUE}
  from (
    select account_id, seq, day, kind, order_id, about, about_plan, reason, ord, q, pr, out_net as net, gain,
      (cash + case when {_DONE} = 'CONFIRM' then case when side = 'BUY' then -net else net end else 0 end)::bigint as cash,
      greatest(0, frozen + case when {_DONE} in ('ORDER', 'PLAN_ORDER') and side = 'BUY' then net when {_DONE} in ('CONFIRM', 'CANCEL') and side = 'BUY' then -net
        when {_DONE} = 'CANCEL_PLAN' then -coalesce(list_sum(list_transform(list_filter(orders, lambda o: o.plan = plan_id), lambda o: o.net)), 0) else 0 end)::bigint as frozen,
      (realized_pnl + gain)::bigint as realized_pnl, (fees + case when {_DONE} = 'CONFIRM' then abs(net - gross) else 0 end)::bigint as fees,
      case when {_DONE} = 'CANCEL_PLAN' then coalesce(array_to_string(list_sort(list_transform(list_filter(orders, lambda o: o.plan = plan_id), lambda o: o.id)), ','), '') else '' end as gone,
      case when {_DONE} = 'PLAN' then list_append(plans, {{'id': plan_id, 'symbol': symbol, 'status': 'ACTIVE', 'price': price, 'weight': weight}})
        else list_transform(plans, lambda x: {{'id': x.id, 'symbol': x.symbol, 'status': case
          when {_DONE} = 'PLAN_ORDER' and x.id = plan_id then 'ORDER_CREATED' when {_DONE} = 'CONFIRM' and side = 'BUY' and x.id = ord.plan then 'OPEN'
          when {_DONE} = 'CONFIRM' and side = 'SELL' and own.quantity = q and x.id = own.plan then 'CLOSED'
          when {_DONE} = 'CANCEL' and x.id = ord.plan and x.status = 'ORDER_CREATED' then 'ACTIVE' when {_DONE} = 'CANCEL_PLAN' and x.id = plan_id then 'CANCELLED' else x.status end, 'price': x.price, 'weight': x.weight}}) end as plans,
      case when {_DONE} in ('ORDER', 'PLAN_ORDER') then list_append(orders, {{'id': order_id, 'symbol': about, 'side': side, 'quantity': q, 'price': pr, 'net': net, 'gross': gross, 'plan': plan_id}})
        when {_DONE} in ('CONFIRM', 'CANCEL') then list_filter(orders, lambda o: o.id <> order_id) when {_DONE} = 'CANCEL_PLAN' then list_filter(orders, lambda o: o.plan is distinct from plan_id) else orders end as orders,
      case when {_DONE} = 'CONFIRM' and side = 'BUY' then list_append(list_filter(ps, lambda p: p.symbol <> about), {_BOUGHT})
        else list_filter(list_transform(ps, lambda p: case when p.symbol is distinct from about then p
          when {_DONE} = 'CONFIRM' then {_changed(quantity="p.quantity - q", free="least(p.free, p.quantity - q)", price="pr")}
          when {_DONE} = 'ORDER' and side = 'SELL' then {_changed(free="p.free - q")} when {_DONE} = 'CANCEL' and side = 'SELL' then {_changed(free="least(p.quantity, p.free + q)")}
          when {_DONE} = 'MARK' then {_changed(price="pr")} else p end), lambda p: p.quantity > 0) end as ps
    from (
      select *, case when {_DONE} = 'CONFIRM' and side = 'SELL' then {_half_up("(100 * net - own.cost * q)", "100")} else 0 end as gain,
        case when kind = 'CONFIRM' and ord is not null or kind in ('ORDER', 'PLAN_ORDER') and coalesce(reason, '') not in ('NO_PLAN', 'PLAN_STATE', 'NO_PRICE', 'BELOW_LOT', 'BAD_SIDE', 'BAD_LOT', 'BAD_PRICE') then net else 0 end as out_net,
        case when kind = 'PLAN' then coalesce(known, plan_id) when {_DONE} = 'CONFIRM' and side = 'SELL' then own.plan when ord is not null then ord.plan else plan_id end as about_plan
      from (
        select *, case
          when kind = 'PLAN' then case when known is not null then 'KNOWN' end
          when kind = 'PLAN_ORDER' and pl is null then 'NO_PLAN' when kind in ('PLAN_ORDER', 'CANCEL_PLAN') and coalesce(pl.status not in ('ACTIVE', 'ORDER_CREATED'), true) then 'PLAN_STATE'
          when kind = 'PLAN_ORDER' and pr is null then 'NO_PRICE' when kind = 'PLAN_ORDER' and coalesce(quantity, 0) <= 0 and pr > 0 and q < 100 then 'BELOW_LOT'
          when kind in ('ORDER', 'PLAN_ORDER') and side not in ('BUY', 'SELL') then 'BAD_SIDE' when kind in ('ORDER', 'PLAN_ORDER') and (q <= 0 or q % 100 <> 0) then 'BAD_LOT' when kind in ('ORDER', 'PLAN_ORDER') and pr <= 0 then 'BAD_PRICE'
          when kind in ('ORDER', 'PLAN_ORDER') and side = 'BUY' then case
            when cash - frozen < net then 'NO_CASH' when waiting > 0 then 'PENDING' when own is null and crowd >= 5 then 'MAX_POSITIONS'
            when 10000 * (coalesce((own.price * own.quantity + 50) // 100, 0) + gross) > (cash + value_before) * 2000 then 'MAX_WEIGHT' end
          when kind = 'ORDER' then case when own is null then 'NO_POSITION' when own.free < q then 'OVERSELL' end
          when kind in ('CONFIRM', 'CANCEL') and ord is null then 'NOT_PENDING'
          when kind = 'CONFIRM' and side = 'BUY' then case when cash < net then 'NO_CASH' end
          when kind = 'CONFIRM' then case when own is null then 'NO_POSITION' when own.quantity < q then 'OVERSELL' end
          when kind = 'MARK' and own is null then 'NO_POSITION' end as reason
        from (
          select *, case when side = 'BUY' then gross + cost else gross - cost end as net from (
            select *, greatest((gross * 30 + 50000) // 100000, 500) + case when side = 'SELL' then (gross * 50 + 50000) // 100000 else 0 end + (gross + 50000) // 100000 as cost from (
              select *, (pr * q + 50) // 100 as gross from (
                select * exclude (quantity_), quantity_ as quantity, list_filter(ps, lambda p: p.symbol = about)[1] as own,
                  len(list_filter(orders, lambda o: o.symbol = about and o.side = 'BUY')) as waiting,
                  len(list_distinct(list_concat(list_transform(ps, lambda p: p.symbol), list_transform(list_filter(orders, lambda o: o.side = 'BUY'), lambda o: o.symbol)))) as crowd,
                  list_max(list_transform(list_filter(plans, lambda x: kind = 'PLAN' and x.symbol = about and x.status in ('ACTIVE', 'ORDER_CREATED', 'OPEN')), lambda x: x.id)) as known,
                  case when kind = 'PLAN_ORDER' and coalesce(quantity_, 0) <= 0 then case when pr > 0 then (cash + value_before) * case when pl.weight > 0 then pl.weight else 2000 end // (100 * pr) // 100 * 100 else 0 end
                    when ord is not null then ord.quantity else quantity_ end as q
                from (
                  select * exclude (side_), {_VALUE} as value_before,
                    case when kind in ('PLAN_ORDER', 'CANCEL_PLAN') then pl.symbol when kind in ('CONFIRM', 'CANCEL') then ord.symbol else symbol end as about,
                    case when kind = 'PLAN_ORDER' then 'BUY' when ord is not null then ord.side else upper(side_) end as side,
                    case when kind = 'PLAN_ORDER' then coalesce(price, case when pl.price > 0 then pl.price else latest end) when ord is not null then ord.price else price end as pr
                  from (
                    select r.account_id, e.seq, e.day, e.kind, e.order_id, e.plan_id, e.symbol, e.side as side_, e.quantity as quantity_, e.price, e.latest, coalesce(e.weight, 0) as weight, r.cash, r.frozen, r.realized_pnl, r.fees, r.plans, r.orders,
                      list_transform(r.pos, lambda p: case when p.bought < e.day then {_SETTLED} else p end) as ps,
                      case when e.kind in ('CONFIRM', 'CANCEL') then list_filter(r.orders, lambda o: o.id = e.order_id)[1] end as ord,
                      case when e.kind in ('PLAN_ORDER', 'CANCEL_PLAN') then list_filter(r.plans, lambda x: x.id = e.plan_id)[1] end as pl
                    from r join ev e on e.account_id = r.account_id and e.seq = r.seq + 1
                  )
                )
              )
            )
          )
        )
      )
    )
  )
), outcomes as (
  select account_id, seq, day, kind, order_id, plan_id, symbol, reason, order_status, plan_status, also_cancelled, case when reason in ('NO_PLAN', 'PLAN_STATE', 'NO_PRICE', 'BELOW_LOT') then null else quantity end::int as quantity,
    case when reason in ('NO_PLAN', 'PLAN_STATE', 'NO_PRICE', 'BELOW_LOT') then null else (price * 0.0001)::decimal(18,4) end as price,
    (net * 0.01)::decimal(20,2) as net, (realized * 0.01)::decimal(20,2) as realized, (cash * 0.01)::decimal(20,2) as cash, (frozen * 0.01)::decimal(20,2) as frozen_cash, (realized_pnl * 0.01)::decimal(20,2) as realized_pnl,
    (fees * 0.01)::decimal(20,2) as total_fees, (value * 0.01)::decimal(20,2) as market_value, ((cash + value) * 0.01)::decimal(20,2) as total_asset, len(pos)::int as positions
  from r where seq > 0
)"""
