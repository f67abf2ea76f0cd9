"""Surface density after the 75-term polynomial of Roquet et al. (2015) at zero pressure.

Horner form of ``+ * /`` and ``sqrt`` only, so that the whole thing is generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scales, and coefficients of specific volume; row i holds those of x**i * y**j.
SALINITY_SCALE = 0.0248826675584615
SALINITY_SHIFT = 0.5971840214030754
TEMPERATURE_SCALE = 0.025
VOLUME = [
    [1.0769995862e-3, -1.5649734675e-5, 2.7762106484e-5, -1.6521159259e-5, 6.9111322702e-6, -8.0539615540e-7, 2.0543094268e-7],
    [-3.1038981976e-4, 3.5009599764e-5, -3.7435842344e-5, 2.4141479483e-5, -8.7595873154e-6, -3.3052758900e-7],
    [6.6928067038e-4, -4.3592678561e-5, 3.5907822760e-5, -1.4353633048e-5, 4.3703680598e-6],
    [-8.5047933937e-4, 3.4532461828e-5, -1.8698584187e-5, 2.2863324556e-6],
    [5.8086069943e-4, -1.1959409788e-5, 3.8595339244e-6],
    [-2.1092370507e-4, 1.3864594581e-6],
    [3.1932457305e-5],
]


def horner(terms: list, at):
    """``terms[0] + at * (terms[1] + at * (...))`` for numbers, Columns or anything with ``+`` and ``*``."""
    out = terms[-1]
    for t in reversed(terms[:-1]):
        out = at * out + t
    return out


def _lit(x):
    return F.lit(x) if isinstance(x, float) else x


def volume(x: Column, y: Column) -> Column:
    return horner([horner([*map(_lit, row)], y) for row in VOLUME], x)


def volume_by_x(x: Column, y: Column) -> Column:
    return horner([horner([_lit(i * c) for c in row], y) for i, row in enumerate(VOLUME) if i], x)


def volume_by_y(x: Column, y: Column) -> Column:
    return horner([horner([_lit(j * c) for j, c in enumerate(row) if j], y) for row in VOLUME if len(row) > 1], x)


def scaled(salinity: Column, temperature: Column) -> tuple[Column, Column]:
    return F.sqrt(SALINITY_SCALE * salinity + SALINITY_SHIFT), TEMPERATURE_SCALE * temperature


def density(salinity: Column, temperature: Column) -> Column:
    return 1.0 / volume(*scaled(salinity, temperature))


def expansion(salinity: Column, temperature: Column) -> Column:
    """Thermal expansion, 1/K."""
    x, y = scaled(salinity, temperature)
    return TEMPERATURE_SCALE * volume_by_y(x, y) / volume(x, y)


def contraction(salinity: Column, temperature: Column) -> Column:
    """Haline contraction, kg/g."""
    x, y = scaled(salinity, temperature)
    return -(SALINITY_SCALE * 0.5) * volume_by_x(x, y) / (x * volume(x, y))


def with_density(cells: DataFrame, salinity: str = "sos", temperature: str = "tos") -> DataFrame:
    """``cells`` with ``rho, alpha, beta``; practical salinity and surface temperature are used as they are."""
    s, t = F.col(salinity), F.col(temperature)
    return cells.withColumns({"rho": density(s, t), "alpha": expansion(s, t), "beta": contraction(s, t)})


# Potential enthalpy of sea water at zero pressure (IOC, SCOR and IAPSO 2010); row i holds those of s**i * t**j,
# s the root of scaled absolute salinity, t the scaled potential temperature; heat capacity; ratio of absolute to practical salinity.
ENTHALPY = [
    [61.01362420681071, 168776.46138048015, -2735.2785605119625, 2574.2164453821433, -1536.6644434977543, 545.7340497931629, -50.91091728474331, -18.30489878927802],
    [],
    [268.5520265845071, -12019.028203559312, 3734.858026725145, -2046.7671145057618, 465.28655623826234, -0.6370820302376359, -10.650848542359153],
    [937.2099110620707, 588.1802812170108, 248.39476522971285, -3.871557904936333, -2.6268019854268356],
    [-1687.914374187449, 936.3206544460336, -942.7827304544439, 369.4389437509002, -33.83664947895248, -9.987880382780322],
    [246.9598888781377],
    [123.59576582457964],
    [-48.5891069025409],
]
HEAT_CAPACITY = 3991.86795711963
SALINITY_RATIO = 35.16504 / 35.0


def absolute_salinity(practical: Column) -> Column:
    """From practical salinity, without the regional anomaly, whose atlas is not at hand; within about 0.02 g/kg in the open ocean."""
    return practical * SALINITY_RATIO


def conservative_temperature(salinity: Column, temperature: Column) -> Column:
    """Of absolute salinity and temperature at the surface, where it is the potential temperature."""
    s, t = F.sqrt(SALINITY_SCALE * salinity), TEMPERATURE_SCALE * temperature
    rows = [horner(list(map(F.lit, r)), t) if r else F.lit(0.0) for r in ENTHALPY]
    return horner(rows, s) / HEAT_CAPACITY
