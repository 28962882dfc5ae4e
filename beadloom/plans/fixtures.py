"""Particle-shaped tables derived from the driver tables, in Spark and in SQL.

Integer arithmetic first, one division last, so that both engines agree bit
for bit. FIXTURES.md describes each table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import channel
from ..operators.ordered import blocked_running_sum, keyed_row_number
from ..session import cut_lineage, shuffled, spread

ID_SPAN = 16777216  # ids of one molecule: mol_id * ID_SPAN + position
BOX = 50.035
FRAME_BOX = ("lx", "ly", "lz")
FRAME_BOX_SQL = {"x": "(50.035::DOUBLE + {f}::DOUBLE * 0.25::DOUBLE)", "y": "(50.035::DOUBLE + {f}::DOUBLE * 0.5::DOUBLE)", "z": "50.035::DOUBLE"}
CURVE_BINS = 54
CURVE_LO, CURVE_HI = 1.0, 109.0
LATTICE = 10007
CYCLE_BEADS = 240
CHUNK_CYCLES = 360
CHECK_STEP = 5
PRIMES = {"x": 7919, "y": 104729, "z": 1299709}
FRAME_SHIFT = {"x": 131, "y": 197, "z": 241}


def _lattice(id_col, axis: str, shift=None):
    value = (id_col % LATTICE) * F.lit(PRIMES[axis])
    if shift is not None:
        value = value + shift
    return (value % LATTICE).cast("double") / F.lit(200.0)


class Inputs:
    """Driver tables and the tables derived from them, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def _numbered_atoms(self) -> DataFrame:
        """Atoms without positions, numbered and stored once: most jobs of a query need them.

        Rows that agree in the four columns of the order give equal atoms, whichever comes first; no other column is shuffled.
        """
        numbered = keyed_row_number(
            self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"),
            "l_orderkey", F.col("l_partkey") % 64, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "pos",
        )
        return cut_lineage(numbered.select(
            (F.col("l_orderkey") * ID_SPAN + F.col("pos")).alias("atom_id"),
            F.col("l_orderkey").alias("mol_id"),
            F.col("pos").cast("bigint").alias("pos"),
            (F.col("l_partkey") % 6 + 1).cast("bigint").alias("type"),
            F.col("l_quantity").alias("mass"),
        ))

    @cached_property
    def atoms(self) -> DataFrame:
        return self._numbered_atoms.select("*", *[_lattice(F.col("atom_id"), ax).alias(ax) for ax in "xyz"])

    @cached_property
    def beads(self) -> DataFrame:
        return shuffled(spread(self.table("part").select("p_partkey"), "p_partkey").select(
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("frame"),
            F.col("p_partkey").alias("bead_id"),
        )).select(
            "frame",
            "bead_id",
            (F.col("bead_id") % 6 + 1).alias("type"),
            *[_lattice(F.col("bead_id"), ax, F.col("frame") * FRAME_SHIFT[ax]).alias(ax) for ax in "xyz"],
        )

    @cached_property
    def boxed_beads(self) -> DataFrame:
        """Beads with the edges of their frame's box, which differ from frame to frame."""
        f = F.col("frame").cast("double")
        return self.beads.select("*", (F.lit(BOX) + f * F.lit(0.25)).alias("lx"), (F.lit(BOX) + f * F.lit(0.5)).alias("ly"), F.lit(BOX).alias("lz"))

    @cached_property
    def bonds(self) -> DataFrame:
        a1 = F.col("atom_id") - 1
        return self.atoms.where("pos >= 2").select(
            (a1 % 3 + 1).alias("bond_type"), a1.alias("a1"), F.col("atom_id").alias("a2"), "mol_id"
        )

    @cached_property
    def _snapshots(self) -> DataFrame:
        k = F.col("frame")
        return self.bonds.select(
            F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("frame"),
            "bond_type", "a1", "a2",
        ).select(
            "*",
            ((F.col("a1") + k) % 7 != 0).alias("in_before"),
            ((F.col("a1") + k + 1) % 7 != 0).alias("in_after"),
        )

    @cached_property
    def before(self) -> DataFrame:
        return self._snapshots.where("in_before").select("frame", "bond_type", "a1", "a2")

    @cached_property
    def after(self) -> DataFrame:
        """Every fifth bond is listed the other way round, every eleventh is retyped."""
        swap = F.col("a1") % 5 == 0
        return self._snapshots.where("in_after").select(
            "frame",
            F.when(F.col("a1") % 11 == 0, F.col("bond_type") % 3 + 1).otherwise(F.col("bond_type")).alias("bond_type"),
            F.when(swap, F.col("a2")).otherwise(F.col("a1")).alias("a1"),
            F.when(swap, F.col("a1")).otherwise(F.col("a2")).alias("a2"),
        )

    @cached_property
    def mapping(self) -> DataFrame:
        c = F.floor((F.col("pos") + 1) / F.lit(2))
        return self.atoms.select(
            "atom_id",
            (F.col("mol_id") * ID_SPAN + c).alias("bead_id"),
            "mol_id",
            ((F.col("mol_id") + c) % 6 + 1).alias("bead_type"),
            "mass",
        )

    @cached_property
    def reactions(self) -> DataFrame:
        """Reaction events: cycle = whole hours since the first day, one-based."""
        start = "timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)"
        return self.table("events").select(
            F.col("event_id"),
            (F.col("user_id") % 4).alias("traj"),
            (F.expr(start) + 1).cast("bigint").alias("cycle"),
            (F.col("user_id") % 3 + 3).alias("t1"),
            (F.col("event_id") % 2 + 5).alias("t2"),
            F.col("value").alias("distance"),
            F.col("event_type").alias("reaction_type"),
        )

    @cached_property
    def cycle_grid(self) -> DataFrame:
        """Every cycle from 1 to the last one of any trajectory, for each trajectory."""
        last = self.reactions.agg(F.max("cycle").alias("last")).scalar()
        return self.reactions.select("traj").distinct().select("traj", F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("cycle"))

    @cached_property
    def counts(self) -> DataFrame:
        """Per (traj, cycle): events per channel, type census and exposures."""
        ch = channel("t1", "t2")
        per = (
            self.reactions.withColumn("ch", ch)
            .where("ch IS NOT NULL")
            .groupBy("traj", "cycle")
            .agg(*[F.count_if(F.col("ch") == c).alias(f"N{c}") for c in ("11", "12", "21", "22")])
        )
        grid = self.cycle_grid
        filled = grid.join(per, ["traj", "cycle"], "left").na.fill(0)
        filled = filled.withColumn("use5", F.col("N11") + F.col("N21")).withColumn("use6", F.col("N12") + F.col("N22"))
        cum = blocked_running_sum(filled, ["traj"], "cycle", ["use5", "use6"])
        totals = per.groupBy("traj").agg(
            F.sum(F.col("N11") + F.col("N21")).alias("tot5"), F.sum(F.col("N12") + F.col("N22")).alias("tot6")
        )
        c, t = F.col("cycle"), F.col("traj")
        return cum.join(totals, "traj").select(
            "traj",
            "cycle",
            (c * 1000).alias("timestep"),
            (c % 5 + 10).alias("n1"),
            (c % 7 + 20).alias("n2"),
            (c % 3 + 50).alias("n3"),
            (F.lit(55) - c % 3).alias("n4"),
            (F.col("tot5") * 2 + 100 - F.col("use5_cum")).alias("n5"),
            (F.col("tot6") * 2 + 150 - F.col("use6_cum")).alias("n6"),
            ((c * 7 + t * 3) % 13 + 200).alias("E35"),
            ((c * 5 + t * 2) % 17 + 210).alias("E36"),
            ((c * 3 + t * 5) % 11 + 220).alias("E45"),
            ((c * 2 + t * 7) % 19 + 230).alias("E46"),
            "N11", "N12", "N21", "N22",
        )

    @cached_property
    def cycle_beads(self) -> DataFrame:
        """A small bead set with its box for every (traj, cycle) of ``cycle_grid``; monomers are used up as cycles pass."""
        last = self.reactions.agg(F.max("cycle").alias("last")).scalar()
        spread = self.cycle_grid.select(
            "traj", "cycle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(CYCLE_BEADS - 1).cast("bigint"))).alias("bead_id"),
            ((F.col("cycle") * 4 + F.col("traj")) % (LATTICE - 1) + 1).alias("_m"), (F.col("cycle") % 3).cast("double").alias("_f"),
        )
        base, rank, turns = F.col("bead_id") % 6 + 1, F.floor(F.col("bead_id") / 6) * 4 * last, (F.col("cycle") - 1) * (CYCLE_BEADS // 6)
        used = ((base == 5) & (rank < turns * 3)) | ((base == 6) & (rank < turns))
        return spread.select(
            "traj", "cycle", "bead_id", F.when(used, base - 4).otherwise(base).alias("type"),
            *[((F.col("bead_id") * F.lit(PRIMES[ax]) * F.col("_m") % LATTICE).cast("double") / F.lit(200.0)).alias(ax) for ax in "xyz"],
            (F.lit(BOX) + F.col("_f") * F.lit(0.25)).alias("lx"), (F.lit(BOX) + F.col("_f") * F.lit(0.5)).alias("ly"), F.lit(BOX).alias("lz"),
        )

    @cached_property
    def event_frames(self) -> DataFrame:
        """(traj, chunk, timestep, cycle): the cycles of each trajectory at which something happened, dealt over chunks from number 9 on."""
        chunk = F.floor((F.col("cycle") - 1) / CHUNK_CYCLES) + 9
        return self.reactions.select("traj", chunk.alias("chunk"), (F.col("cycle") * 1000).alias("timestep"), "cycle").distinct()

    @cached_property
    def event_bonds(self) -> tuple[DataFrame, DataFrame]:
        """Bead bonds before and after each event frame: some stay, turned round, some go, and one is made for each event."""
        k = F.col("k") + F.col("cycle")
        old = self.event_frames.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(CYCLE_BEADS - 2).cast("bigint"))).alias("k")).where(k % 3 == 0)
        keys = ["traj", "chunk", "timestep", F.lit(1).cast("bigint").alias("bond_type")]
        before = old.select(*keys, F.col("k").alias("a1"), (F.col("k") + 1).alias("a2"))
        stay = old.where(k % 9 != 0).select(*keys, (F.col("k") + 1).alias("a1"), F.col("k").alias("a2"))
        e, sites = F.col("event_id"), CYCLE_BEADS // 6
        made = self.reactions.join(self.event_frames, ["traj", "cycle"]).select(
            *keys, (e * 7 % sites * 6 + F.col("t1") - 1).alias("a1"), (e % sites * 6 + F.col("t2") - 1).alias("a2"))
        return before, stay.unionByName(made)

    @cached_property
    def event_beads(self) -> DataFrame:
        """Frames of the event-driven trajectory: all beads CHECK_STEP before each event frame, a few with other types at it."""
        at = self.cycle_beads.join(self.event_frames, ["traj", "cycle"])
        late = at.where("bead_id < 24").withColumn("type", F.col("type") % 6 + 1)
        ahead = at.withColumn("timestep", F.col("timestep") - CHECK_STEP)
        return ahead.unionByName(late)

    @cached_property
    def edges(self) -> DataFrame:
        return (
            self.table("lineitem")
            .select(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 1000000000).alias("v"))
            .distinct()
        )

    @cached_property
    def samples(self) -> DataFrame:
        """Samples of one measure per curve; the sum of three flat ones is bell shaped."""
        v = F.col("l_quantity").cast("bigint") + F.col("l_partkey") % 37 + F.col("l_orderkey") % 23
        return self.table("lineitem").select(F.col("l_suppkey").alias("curve_id"), v.cast("double").alias("v"))

    @cached_property
    def curves(self) -> DataFrame:
        from ..operators.histograms import histogram

        return shuffled(histogram(self.samples, ["curve_id"], "v", CURVE_LO, CURVE_HI, CURVE_BINS)).select(
            "curve_id", "i", "x", "n", F.col("density").alias("p")
        )

    @cached_property
    def potentials(self) -> DataFrame:
        base = spread(self.table("supplier").select("s_suppkey"), "s_suppkey").select(
            F.col("s_suppkey").alias("table_id"),
            (F.lit(0.1) + (F.col("s_suppkey") % 25).cast("double") * F.lit(0.02)).alias("eps"),
            (F.lit(3.0) + (F.col("s_suppkey") % 5).cast("double") * F.lit(0.1)).alias("sigma"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(199).cast("bigint"))).alias("i"),
        ).withColumn("x", F.lit(0.8) * F.col("sigma") + F.col("i").cast("double") * F.lit(0.05))
        s, s6 = F.col("s"), F.col("s6")
        base = base.withColumn("s", F.col("sigma") / F.col("x")).withColumn("s6", s * s * s * s * s * s)
        return shuffled(base).select("table_id", "i", "x", (F.lit(4.0) * F.col("eps") * (s6 * s6 - s6)).alias("u"))

    @cached_property
    def points(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id",
            F.col("label").cast("bigint").alias("label"),
            *[F.col("embedding")[k].cast("double").alias(ax) for k, ax in enumerate("xyz")],
        )


SQL_FIXTURES = {
    "fx_atoms": """
        SELECT atom_id, mol_id, pos, type, mass,
               ((atom_id % 10007) * 7919 % 10007)::DOUBLE / 200.0::DOUBLE AS x,
               ((atom_id % 10007) * 104729 % 10007)::DOUBLE / 200.0::DOUBLE AS y,
               ((atom_id % 10007) * 1299709 % 10007)::DOUBLE / 200.0::DOUBLE AS z
        FROM (SELECT l_orderkey * 16777216 + pos AS atom_id, l_orderkey AS mol_id, pos,
                     l_partkey % 6 + 1 AS type, l_quantity AS mass
              FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 64, l_linenumber,
                      l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
                      l_linestatus, l_shipdate) AS pos FROM lineitem))""",
    "fx_beads": """
        SELECT frame, p_partkey AS bead_id, p_partkey % 6 + 1 AS type,
               (((p_partkey % 10007) * 7919 + frame * 131) % 10007)::DOUBLE / 200.0::DOUBLE AS x,
               (((p_partkey % 10007) * 104729 + frame * 197) % 10007)::DOUBLE / 200.0::DOUBLE AS y,
               (((p_partkey % 10007) * 1299709 + frame * 241) % 10007)::DOUBLE / 200.0::DOUBLE AS z
        FROM part, range(3) t(frame)""",
    "fx_bonds": """
        SELECT (atom_id - 1) % 3 + 1 AS bond_type, atom_id - 1 AS a1, atom_id AS a2, mol_id
        FROM fx_atoms WHERE pos >= 2""",
    "fx_snap": """
        SELECT frame, bond_type, a1, a2, (a1 + frame) % 7 <> 0 AS in_before, (a1 + frame + 1) % 7 <> 0 AS in_after
        FROM fx_bonds, range(1, 4) t(frame)""",
    "fx_before": "SELECT frame, bond_type, a1, a2 FROM fx_snap WHERE in_before",
    "fx_after": """
        SELECT frame, CASE WHEN a1 % 11 = 0 THEN bond_type % 3 + 1 ELSE bond_type END AS bond_type,
               CASE WHEN a1 % 5 = 0 THEN a2 ELSE a1 END AS a1, CASE WHEN a1 % 5 = 0 THEN a1 ELSE a2 END AS a2
        FROM fx_snap WHERE in_after""",
    "fx_map": """
        SELECT atom_id, mol_id * 16777216 + (pos + 1) // 2 AS bead_id, mol_id,
               (mol_id + (pos + 1) // 2) % 6 + 1 AS bead_type, mass
        FROM fx_atoms""",
    "fx_events": """
        SELECT event_id, user_id % 4 AS traj, date_diff('hour', TIMESTAMP '2024-01-01', ts) + 1 AS cycle,
               user_id % 3 + 3 AS t1, event_id % 2 + 5 AS t2, value AS distance, event_type AS reaction_type
        FROM events""",
    "fx_channels": """
        SELECT *, CASE (least(t1, t2), greatest(t1, t2)) WHEN (3, 5) THEN '11' WHEN (3, 6) THEN '12'
               WHEN (4, 5) THEN '21' WHEN (4, 6) THEN '22' END AS ch FROM fx_events""",
    "fx_counts": """
        SELECT g.traj, g.cycle, g.cycle * 1000 AS timestep, g.cycle % 5 + 10 AS n1, g.cycle % 7 + 20 AS n2,
               g.cycle % 3 + 50 AS n3, 55 - g.cycle % 3 AS n4,
               (sum(N11 + N21) OVER (PARTITION BY g.traj) * 2 + 100
                 - sum(N11 + N21) OVER (PARTITION BY g.traj ORDER BY g.cycle))::BIGINT AS n5,
               (sum(N12 + N22) OVER (PARTITION BY g.traj) * 2 + 150
                 - sum(N12 + N22) OVER (PARTITION BY g.traj ORDER BY g.cycle))::BIGINT AS n6,
               (g.cycle * 7 + g.traj * 3) % 13 + 200 AS E35, (g.cycle * 5 + g.traj * 2) % 17 + 210 AS E36,
               (g.cycle * 3 + g.traj * 5) % 11 + 220 AS E45, (g.cycle * 2 + g.traj * 7) % 19 + 230 AS E46,
               N11, N12, N21, N22
        FROM (SELECT traj, cycle, count(e.event_id) FILTER (WHERE ch = '11') AS N11,
                     count(e.event_id) FILTER (WHERE ch = '12') AS N12,
                     count(e.event_id) FILTER (WHERE ch = '21') AS N21,
                     count(e.event_id) FILTER (WHERE ch = '22') AS N22
              FROM (SELECT DISTINCT traj FROM fx_events) CROSS JOIN (SELECT unnest(range(1, (SELECT max(cycle) FROM fx_events) + 1)) AS cycle)
              LEFT JOIN fx_channels e USING (traj, cycle) GROUP BY traj, cycle) g""",
    "fx_cycle_beads": """
        SELECT traj, cycle, bead_id, CASE WHEN (base = 5 AND bead_id // 6 * 4 * last < (cycle - 1) * 40 * 3) OR (base = 6 AND bead_id // 6 * 4 * last < (cycle - 1) * 40) THEN base - 4 ELSE base END AS type,
               (bead_id * 7919 * m % 10007)::DOUBLE / 200.0::DOUBLE AS x, (bead_id * 104729 * m % 10007)::DOUBLE / 200.0::DOUBLE AS y,
               (bead_id * 1299709 * m % 10007)::DOUBLE / 200.0::DOUBLE AS z,
               50.035::DOUBLE + f * 0.25::DOUBLE AS lx, 50.035::DOUBLE + f * 0.5::DOUBLE AS ly, 50.035::DOUBLE AS lz
        FROM (SELECT traj, cycle, last, bead_id, bead_id % 6 + 1 AS base, (cycle * 4 + traj) % 10006 + 1 AS m, (cycle % 3)::DOUBLE AS f
              FROM (SELECT DISTINCT traj FROM fx_events) CROSS JOIN (SELECT max(cycle) AS last FROM fx_events)
              CROSS JOIN (SELECT unnest(range(1, (SELECT max(cycle) FROM fx_events) + 1)) AS cycle) CROSS JOIN range(240) b(bead_id))""",
    "fx_edges": """
        SELECT DISTINCT l_partkey AS u, l_suppkey + 1000000000 AS v FROM lineitem""",
    "fx_samples": """
        SELECT l_suppkey AS curve_id, (l_quantity::BIGINT + l_partkey % 37 + l_orderkey % 23)::DOUBLE AS v
        FROM lineitem""",
    "fx_curves": """
        SELECT c.curve_id, g.i, 2.0::DOUBLE + 2 * g.i AS x, coalesce(h.n, 0) AS n,
               coalesce(h.n, 0)::DOUBLE / (c.total::DOUBLE * 2.0::DOUBLE) AS p
        FROM (SELECT curve_id, count(*) AS total FROM fx_samples GROUP BY 1) c
        CROSS JOIN range(54) g(i)
        LEFT JOIN (SELECT curve_id, least((v - 1)::BIGINT // 2, 53) AS i, count(*) AS n
                   FROM fx_samples GROUP BY 1, 2) h ON h.curve_id = c.curve_id AND h.i = g.i""",
    "fx_potentials": """
        SELECT table_id, i, x, 4.0::DOUBLE * eps * (s6 * s6 - s6) AS u
        FROM (SELECT *, (sigma/x) * (sigma/x) * (sigma/x) * (sigma/x) * (sigma/x) * (sigma/x) AS s6
              FROM (SELECT *, 0.8::DOUBLE * sigma + i::DOUBLE * 0.05::DOUBLE AS x
                    FROM (SELECT s_suppkey AS table_id, 0.1::DOUBLE + (s_suppkey % 25)::DOUBLE * 0.02::DOUBLE AS eps,
                                 3.0::DOUBLE + (s_suppkey % 5)::DOUBLE * 0.1::DOUBLE AS sigma
                          FROM supplier) CROSS JOIN range(200) t(i)))""",
    "fx_points": """
        SELECT vec_id, label::BIGINT AS label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
               embedding[3]::DOUBLE AS z FROM embeddings""",
}
