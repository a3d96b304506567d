"""Closed-form models: pricing, queues, capacity, replicated counters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def surge(demand: Column, supply: Column, how: str = "linear", most: float = 3.0, rate: float = 0.5) -> Column:
    """Price multiplier from 1 to most; no supply gives most."""
    ratio = F.try_divide(demand, supply)
    over = F.greatest(ratio - 1, F.lit(0.0))
    form = {"linear": 1 + rate * over, "exponential": F.exp(rate * over), "step": F.when(ratio < 1, 1.0).when(ratio < 1.5, 1.25).when(ratio < 2, 1.5).when(ratio < 3, 2.0).otherwise(most)}[how]
    return F.when(supply <= 0, most).otherwise(F.least(F.greatest(form, F.lit(1.0)), F.lit(most)))


def fare(km: Column, minutes: Column, multiplier: Column, base: float = 2.5, per_km: float = 1.5, per_min: float = 0.3, least: float = 5.0) -> Column:
    return F.round(F.greatest((base + per_km * km + per_min * minutes) * multiplier, F.lit(least)), 2)


def demand_after(demand: Column, price_before: Column, price_after: Column, elasticity: float) -> Column:
    return demand * F.pow(price_after / price_before, elasticity)


def erlang_c(load: Column, servers: int) -> Column:
    """Probability of waiting with a load in erlangs below the number of servers."""
    head = F.lit(0.0)
    for k in range(servers):
        head = head + F.pow(load, k) / math.factorial(k)
    tail = F.pow(load, servers) / math.factorial(servers) * servers / (servers - load)
    return F.when(load >= servers, 1.0).otherwise(tail / (head + tail))


def mm1(arrivals: Column, service: Column) -> Column:
    """struct(utilisation, in_system, time) of one server; null when overloaded."""
    r = arrivals / service
    return F.when(r < 1, F.struct(r.alias("utilisation"), (r / (1 - r)).alias("in_system"), (1 / (service - arrivals)).alias("time")))


def instances(load: Column, capacity: float, headroom: float = 1.3) -> Column:
    return F.ceil(headroom * load / capacity)


def exhausted_after(now: Column, limit: float, growth: float) -> Column:
    """Periods of relative growth until a limit is reached, 0 if it is."""
    return F.when(now >= limit, 0.0).otherwise(F.ln(F.lit(limit) / now) / math.log1p(growth))
