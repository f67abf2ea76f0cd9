"""Surface buoyancy forcing from heat and freshwater fluxes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constants:
    """Specific heat, reference and freshwater density, reference salinity; signs of the two parts."""

    heat_capacity: float = 3990.0
    density: float = 1027.0
    freshwater: float = 1000.0
    salinity: float = 35.0
    sign: float = 1.0


STANDARD = Constants()
CLOUD = Constants(heat_capacity=4090.0, density=1026.0)
SIGNED = Constants(sign=-1.0)
# Constant expansion and contraction of the CESM variant.
CONSTANT_ALPHA = 1.391022569339093e-4
CONSTANT_BETA = 7.600059551595953e-4


def heat_part(alpha: Column, hfds: Column, k: Constants = STANDARD) -> Column:
    return k.sign * (alpha / k.heat_capacity) * hfds


def freshwater_part(beta: Column, wfo: Column, k: Constants = STANDARD) -> Column:
    return k.sign * (k.density / k.freshwater) * beta * k.salinity * wfo


def with_forcing(cells: DataFrame, k: Constants = STANDARD, alpha: Column | None = None, beta: Column | None = None) -> DataFrame:
    """``cells`` with ``heat, fw, fsurf``; NULL in a flux makes its part and the sum NULL."""
    a = F.col("alpha") if alpha is None else alpha
    b = F.col("beta") if beta is None else beta
    heat, fw = heat_part(a, F.col("hfds"), k), freshwater_part(b, F.col("wfo"), k)
    return cells.withColumns({"heat": heat, "fw": fw, "fsurf": heat + fw})
