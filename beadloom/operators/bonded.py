"""Bonded terms: members with their coordinates per frame, lengths, angles, torsions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import angle_deg, cross, dot, min_image, norm2
from .spatial import box_columns, lengths


def gather_members(terms: DataFrame, members: list[str], points: DataFrame, id_col: str, box=()) -> DataFrame:
    """Terms times frames with columns ``c<k>_x`` ..., one equi join per member.

    ``points`` is (frame, id, x, y, z); the first join brings the frames in, the
    later ones use (frame, id).
    """
    out = terms
    for k, m in enumerate(members):
        coords = points.select(
            "frame", F.col(id_col).alias(m), *[F.col(ax).alias(f"c{k}_{ax}") for ax in "xyz"], *(box if k == 0 else ())
        )
        out = out.join(coords, [m] if k == 0 else ["frame", m])
    return out


def term_values(terms: DataFrame, kind: str, members: list[str], points: DataFrame, id_col: str, box) -> DataFrame:
    """(frame, kind, type_id, members, value): length in box units or angle in degrees."""
    rows = gather_members(terms, members, points, id_col, box_columns(box))

    def step(a, b):
        return [min_image(F.col(f"c{b}_{ax}") - F.col(f"c{a}_{ax}"), edge) for ax, edge in zip("xyz", lengths(box))]

    # Displacements and normals are columns of their own: spelled out inside each other they outgrow compiled code.
    def named(name, vector):
        return {f"_{name}{ax}": v for ax, v in zip("xyz", vector)}

    def vector(name):
        return [F.col(f"_{name}{ax}") for ax in "xyz"]

    pairs = {"bond": {"u": (0, 1)}, "angle": {"u": (1, 0), "v": (1, 2)}}.get(kind, {"u": (0, 1), "v": (1, 2), "w": (2, 3)})
    for name, ends in pairs.items():
        rows = rows.withColumns(named(name, step(*ends)))
    if kind == "bond":
        value = F.sqrt(norm2(*vector("u")))
    elif kind == "angle":
        value = angle_deg(vector("u"), vector("v"))
    else:
        rows = rows.withColumns(named("m", cross(vector("u"), vector("v"))) | named("n", cross(vector("v"), vector("w"))))
        magnitude = angle_deg(vector("m"), vector("n"))
        value = F.when(dot(vector("m"), vector("w")) < 0, -magnitude).otherwise(magnitude)
    return rows.select("frame", F.lit(kind).alias("kind"), "type_id", *members, value.alias("value"))
