"""Unit factors and force-field parameter conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import col

# One kcal/mol, one angstrom, and Boltzmann's constant per unit.
ENERGY = {"kcal/mol": 1.0, "kJ/mol": 4.184, "eV": 0.0433641, "J": 6.9477e-21, "K": 503.221}
LENGTH = {"A": 1.0, "Angstrom": 1.0, "angstrom": 1.0, "nm": 0.1, "pm": 100.0, "m": 1e-10}
BOLTZMANN = {"kcal/mol": 0.0019872041, "kJ/mol": 0.0083144626, "eV": 8.617333262e-5, "J": 1.380649e-23}


def _factor(table: dict[str, float], unit) -> Column:
    """Factor for a unit column; an unknown unit fails the query."""
    u = col(unit)
    out = F.raise_error(F.concat(F.lit("unknown unit: "), u)).cast("double")
    for name, value in table.items():
        out = F.when(u == name, F.lit(value)).otherwise(out)
    return out


def convert_energy(value, source, target) -> Column:
    return col(value) / _factor(ENERGY, source) * _factor(ENERGY, target)


def convert_length(value, source, target) -> Column:
    return col(value) / _factor(LENGTH, source) * _factor(LENGTH, target)


def thermal_energy(temperature, unit) -> Column:
    return _factor(BOLTZMANN, unit) * col(temperature)


# Distribution axis units in angstrom and in degrees.
DISTANCE_AXIS = {"A": 1.0, "nm": 10.0}
ANGLE_AXIS = {"deg": 1.0, "rad": 57.29577951308232}


def axis_scale(kind, source, target) -> Column:
    is_distance = col(kind).isin("bond", "rdf")
    return F.when(
        is_distance, _factor(DISTANCE_AXIS, source) / _factor(DISTANCE_AXIS, target)
    ).otherwise(_factor(ANGLE_AXIS, source) / _factor(ANGLE_AXIS, target))


def convert_distribution(kind, x, p, source, target) -> list[Column]:
    """Axis and density in the target unit; the integral is kept, g(r) is not scaled."""
    scale = axis_scale(kind, source, target)
    return [
        (col(x) * scale).alias("x"),
        F.when(col(kind) == "rdf", col(p)).otherwise(col(p) / scale).alias("p"),
    ]


def lj_to_c6_c12(sigma_a, epsilon_kcal) -> dict[str, Column]:
    """Angstrom and kcal/mol well to nm, kJ/mol and the dispersion/repulsion pair."""
    sigma = col(sigma_a) * 0.1
    eps = col(epsilon_kcal) * 4.184
    s6 = F.pow(sigma, F.lit(6.0))
    return {"sigma": sigma, "epsilon": eps, "c6": eps * 4.0 * s6, "c12": eps * 4.0 * s6 * s6}


def c6_c12_to_lj(c6, c12) -> dict[str, Column]:
    a, b = col(c6), col(c12)
    bad = (a <= 0) | (b <= 0)
    return {
        "sigma": F.when(bad, F.lit(0.0)).otherwise(F.pow(b / a, F.lit(1.0 / 6.0))),
        "epsilon": F.when(bad, F.lit(0.0)).otherwise(a * a / (b * 4.0)),
    }


def phase_sign(phase, multiplicity) -> Column:
    """+1 for phase 0, -1 for 180; a negative multiplicity flips it once more."""
    base = F.when(F.abs(col(phase) - 180.0) < 1e-6, F.lit(-1)).otherwise(F.lit(1))
    return F.when(col(multiplicity) < 0, -base).otherwise(base)
