"""Counts per reaction frame, from reaction frames and an event-driven trajectory."""

import pytest

from beadloom.operators import event_frames as EF

BOND = "traj long, chunk long, timestep long, bond_type long, a1 long, a2 long"


def counts(spark, reactions, before, after, types, beads, **kw):
    keys = "traj long, chunk long, timestep long"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return EF.event_frame_counts(
        frame(reactions, keys), frame(before, BOND), frame(after, BOND), frame(types, f"{keys}, bead_id long, bead_type long"),
        frame(beads, f"{keys}, type long, x double, y double, z double, l double"), "l", 10.0, **kw)


def run(spark, events, check_step, pre_step):
    """Each event joins beads 1 (type 3) and 2 (type 5); the frame at the event has them retyped."""
    reactions = [(t, c, ts) for t, c, ts in events]
    after = [(*e, 1, 2, 1) for e in events]
    types = [(*e, b, k) for e in events for b, k in ((1, 3), (2, 5))]
    beads = [(t, c, ts - pre_step, k, x, 1.0, 1.0, 50.0) for t, c, ts in events for k, x in ((3, 1.0), (5, 2.0))]
    beads += [(t, c, ts, k, x, 1.0, 1.0, 50.0) for t, c, ts in events for k, x in ((4, 1.0), (6, 2.0))]
    return counts(spark, reactions, [], after, types, beads, check_step=check_step)


def test_counts_are_those_before_the_reaction(spark):
    row = run(spark, [(1, 1, 1000)], 5, 5).collect()[0]
    assert (row["timestep"], row["cycle"], row["N11"], row["N12"], row["n3"], row["n5"], row["n4"], row["n6"], row["E35"], row["E46"]) == (1000, 1, 1, 0, 1, 1, 0, 0, 1, 0)
    assert run(spark, [(2, 1, 6401)], 1, 1).collect()[0]["N11"] == 1


def test_a_reaction_without_its_frame_fails(spark):
    with pytest.raises(Exception, match="no frame at timestep 999"):
        run(spark, [(1, 1, 1000)], 1, 5).collect()


def test_trajectories_go_on_over_chunks_in_numeric_order(spark):
    events = [(7, 10, 50), (7, 9, 4000), (7, 9, 100), (8, 2, 10), (7, 10, 60)]
    got = sorted((r["traj"], r["cycle"], r["chunk"], r["timestep"]) for r in run(spark, events, 1, 1).collect())
    assert got == [(7, 1, 9, 100), (7, 2, 9, 4000), (7, 3, 10, 50), (7, 4, 10, 60), (8, 1, 2, 10)]


def test_only_new_bonds_of_typed_beads_count(spark):
    key = (1, 1, 10)
    before = [(*key, 1, 2, 1)]
    after = [(*key, 1, 1, 2), (*key, 1, 4, 3), (*key, 2, 3, 4), (*key, 1, 1, 9), (*key, 1, 5, 6)]  # kept, new twice, no type, no channel
    types = [(*key, b, k) for b, k in ((1, 3), (2, 5), (3, 4), (4, 6), (5, 5), (6, 6))]
    beads = [(1, 1, 9, 5, 1.0, 1.0, 1.0, 30.0), (1, 1, 9, 6, 9.0, 9.0, 9.0, 30.0)]
    row = counts(spark, [key, key], before, after, types, beads).collect()
    assert len(row) == 1 and [row[0][f"N{c}"] for c in ("11", "12", "21", "22")] == [0, 0, 0, 1] and row[0]["E35"] == 0


def test_reactions_of_no_channel_keep_their_row(spark):
    rows = counts(spark, [(1, 1, 10)], [], [], [(1, 1, 10, 1, 1)], [(1, 1, 9, 1, 0.0, 0.0, 0.0, 5.0)]).collect()
    assert [(r["cycle"], r["N11"], r["n1"], r["E35"]) for r in rows] == [(1, 0, 1, 0)]
    assert counts(spark, [], [], [], [], []).count() == 0
