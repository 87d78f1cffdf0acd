"""Model calls as column expressions: routing, prices, cost."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaespark import fixed

MONEY = "decimal(24,9)"


def lookup(key: Column, values: dict[str, object], default: object = None) -> Column:
    """Value of a small fixed table."""
    cases = None
    for name, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        cases = F.when(key == name, value) if cases is None else cases.when(key == name, value)
    return cases if default is None else cases.otherwise(default)


def routed_model(task_type: Column, default: str = fixed.DEFAULT_MODEL) -> Column:
    """Model of a task; an unknown default means the lite model."""
    known = [m[0] for m in fixed.MODELS]
    return lookup(task_type, fixed.TASK_ROUTING, default if default in known else fixed.DEFAULT_MODEL)


def price(model: Column, side: int) -> Column:
    prices = {m[0]: F.lit(m[2 + side]).cast("decimal(12,8)") for m in fixed.MODELS}
    return lookup(model, prices, lookup(model, {m[1]: F.lit(m[2 + side]).cast("decimal(12,8)") for m in fixed.MODELS}))


def call_cost(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """U4: cost of a call in USD, exact to nine digits; ``model`` is a name or a model id."""
    tokens = "decimal(15,0)"
    whole = prompt_tokens.cast(tokens) * price(model, 0) + completion_tokens.cast(tokens) * price(model, 1)
    return (whole * F.lit("0.001").cast("decimal(4,3)")).cast(MONEY)


def usd(amount: Column, digits: int = 4) -> Column:
    return F.concat(F.lit("$"), amount.cast(f"decimal(24,{digits})").cast("string"))


def retry_delay(attempt: Column, base: float = fixed.RETRY_BASE_SECONDS) -> Column:
    """Seconds waited after an attempt; grows in a straight line."""
    return attempt * F.lit(base)
