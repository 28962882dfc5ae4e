"""Column kernels: geometry under periodic boundaries, bond keys, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


# --- periodic geometry -------------------------------------------------------


def min_image(delta, length) -> Column:
    """Minimum-image displacement on one axis; rint rounds half to even. A box edge of 0 gives the plain difference."""
    d, box = col(delta), col(length)
    if isinstance(length, (int, float)):
        return d - box * F.rint(d / box) if length else d
    return F.when(box > 0, d - box * F.rint(d / box)).otherwise(d)


def image_index(x, lo, length) -> Column:
    return F.floor((col(x) - col(lo)) / col(length))


def wrapped(x, lo, length) -> Column:
    return col(x) - image_index(x, lo, length).cast("double") * col(length)


def unwrapped(x, image, length) -> Column:
    return col(x) + col(image).cast("double") * col(length)


def decode_image(packed, axis: int, bits: int = 10) -> Column:
    """Axis image count out of a packed integer; the last axis keeps the high bits."""
    size = 1 << bits
    shifted = F.shiftright(col(packed), bits * axis)
    if axis < 2:
        shifted = shifted.bitwiseAND(F.lit(size - 1))
    return shifted - F.lit(size // 2)


def norm2(*parts) -> Column:
    total = None
    for part in parts:
        sq = col(part) * col(part)
        total = sq if total is None else total + sq
    return total


def min_image_vector(a: str, b: str, length, axes=("x", "y", "z")) -> list[Column]:
    """b - a on each axis, where a and b are column prefixes (``a_x``)."""
    return [min_image(F.col(f"{b}{ax}") - F.col(f"{a}{ax}"), length) for ax in axes]


def dot(u, v) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u, v) -> list[Column]:
    return [
        u[1] * v[2] - u[2] * v[1],
        u[2] * v[0] - u[0] * v[2],
        u[0] * v[1] - u[1] * v[0],
    ]


def clamp(value, lo=-1.0, hi=1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(value)))


def angle_deg(u, v) -> Column:
    """Angle between two vectors in degrees; null when either has no length."""
    den = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(den > 0, F.degrees(F.acos(clamp(dot(u, v) / den))))


def dihedral_deg(b1, b2, b3) -> Column:
    """Signed torsion: magnitude from the two normals, sign from n1 . b3."""
    n1, n2 = cross(b1, b2), cross(b2, b3)
    magnitude = angle_deg(n1, n2)
    return F.when(dot(n1, b3) < 0, -magnitude).otherwise(magnitude)


# --- bond keys ---------------------------------------------------------------


def lo_hi(a="a1", b="a2") -> list[Column]:
    return [F.least(col(a), col(b)).alias("lo"), F.greatest(col(a), col(b)).alias("hi")]


def bond_code(a, b, n_ids: int) -> Column:
    return F.least(col(a), col(b)) * F.lit(n_ids + 1) + F.greatest(col(a), col(b))


def decode_bond(code, n_ids: int) -> tuple[Column, Column]:
    c = col(code)
    hi = F.pmod(c, F.lit(n_ids + 1))
    return F.call_function("div", c, F.lit(n_ids + 1)), hi


# Reactive type pair -> channel.
CHANNELS = {"11": (3, 5), "12": (3, 6), "21": (4, 5), "22": (4, 6)}
END_TYPES = (3, 4)
MONOMER_TYPES = (5, 6)


def channel(t1, t2) -> Column:
    lo, hi = F.least(col(t1), col(t2)), F.greatest(col(t1), col(t2))
    out = F.lit(None).cast("string")
    for name, (a, b) in CHANNELS.items():
        out = F.when((lo == a) & (hi == b), F.lit(name)).otherwise(out)
    return out


def pair_type(t1, t2) -> Column:
    return F.concat_ws(
        "-",
        F.least(col(t1), col(t2)).cast("string"),
        F.greatest(col(t1), col(t2)).cast("string"),
    )


def canonical_combo(kind: str, types: list) -> Column:
    """Type combination in its canonical order, as an array."""
    cs = [col(t) for t in types]
    if kind == "bond":
        return F.array_sort(F.array(*cs))
    return F.least(F.array(*cs), F.array(*reversed(cs)))


def safe_ratio(num, den) -> Column:
    """num/den, null unless both are positive."""
    n, d = col(num), col(den)
    return F.when((n > 0) & (d > 0), n.cast("double") / d.cast("double"))


def instantaneous_composition(f1, r1, r2) -> Column:
    """Copolymer composition F1 formed at monomer fraction f1."""
    a, p, q = col(f1), col(r1), col(r2)
    b = F.lit(1.0) - a
    return (p * a * a + a * b) / (p * a * a + F.lit(2.0) * a * b + q * b * b)


def log_gamma(n) -> Column:
    """ln Gamma for n > 0: shift the argument by eight, then Stirling's series."""
    z = col(n)
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(z + F.lit(float(k)))
    w = z + F.lit(8.0)
    inv = F.lit(1.0) / w
    series = inv / 12.0 - F.pow(inv, F.lit(3.0)) / 360.0 + F.pow(inv, F.lit(5.0)) / 1260.0
    return (w - 0.5) * F.log(w) - w + F.lit(0.9189385332046727) + series - shift
