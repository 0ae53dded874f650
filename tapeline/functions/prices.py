"""Column functions on prices, money and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LADDER = {"buy_low": "0.99", "buy_high": "1.01", "stop_loss": "0.95", "target1": "1.08", "target2": "1.12"}
RATES = {"commission": "0.0003", "least_commission": "5", "stamp": "0.0005", "transfer": "0.00001"}


def dec(text: str, scale: int = 6) -> Column:
    return F.lit(text).cast(f"decimal(18,{scale})")


def half_up(value: Column, digits: int, precision: int = 18) -> Column:
    """A decimal rounded half up to this many digits."""
    return F.round(value, digits).cast(f"decimal({precision},{digits})")


def by_value(value: Column, digits: int) -> Column:
    """A double rounded by its own value, as the SQL does; ``F.round`` goes by its shortest digits, which may show a half that the value isn't."""
    return F.round(value * 10.0**digits) / 10.0**digits


def price_ladder(price: Column) -> dict[str, Column]:
    """Entry band, stop and targets around a price, each to two digits."""
    return {k: half_up(price * dec(v, 2), 2) for k, v in LADDER.items()}


def suggested_weight(score: Column, risk_level: Column) -> Column:
    w = F.when(risk_level == "HIGH", 0.05).when(score >= 80, 0.20).when(score >= 70, 0.15).when(score >= 60, 0.10).otherwise(0.05)
    return w.cast("decimal(8,4)")


def lots(amount: Column, price: Column) -> Column:
    """Whole lots of 100 that an amount buys, in shares."""
    return (F.floor(amount / (price * 100)) * 100).cast("long")


def fees(side: Column, gross: Column, rates: dict[str, str] = RATES) -> dict[str, Column]:
    """Commission with its minimum, stamp duty on sales, transfer fee; each rounded to two digits."""
    gross = gross.cast("decimal(20,4)")
    commission = F.greatest(half_up(gross * dec(rates["commission"]), 2), dec(rates["least_commission"], 2))
    stamp = F.when(side == "SELL", half_up(gross * dec(rates["stamp"]), 2)).otherwise(dec("0", 2))
    return {"commission": commission.cast("decimal(18,2)"), "stamp_duty": stamp.cast("decimal(18,2)"), "transfer_fee": half_up(gross * dec(rates["transfer"]), 2)}


def shown(value: Column, digits: int, signed: bool = False) -> Column:
    """A double with this many digits as printf shows it: by its exact value, a tie to the even digit (``format_string`` takes ties up)."""
    plain = "0." + "0" * digits
    return F.call_function("format_number", value, F.lit(f"+{plain};-{plain}" if signed else plain))


def signed_percent(value: Column) -> Column:
    return F.concat(shown(value, 2, signed=True), F.lit("%"))
