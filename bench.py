"""Headline queries on the driver tables; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma separated names, default the list below), BENCH_WARM_DIR (tables on which
every query runs once before it is timed, default /root/testdata/sf0.001 where it exists).
``rates`` has, for queries comparable with published figures, thousands of input items per second.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from beadloom.plans import catalogue  # noqa: E402
from beadloom.session import local_session  # noqa: E402

HEADLINE = [
    "jn1_bond_diff",
    "jn5_bead_bonds",
    "jn8_rebuild_events",
    "jn10_dihedrals",
    "jn11_candidate_pairs",
    "jn12_pair_histogram",
    "ag1_centre_of_mass",
    "ag2_periodic_centre_of_mass",
    "ag14_all_distributions",
    "ag17_radial_distribution",
    "ag19_window_estimates",
    "gr1_connected_components",
    "gr3_molecule_unwrap",
    "src1_dump_scan",
    "st1_block_bootstrap",
    "st3_boltzmann_inversion",
]

#: Input of a query: table, items for each of its rows, and what an item is.
INPUTS = {
    "src1_dump_scan": ("part", 3, "atom frames"),
    "jn8_rebuild_events": ("lineitem", 3, "atom frames"),
    "jn12_pair_histogram": ("part", 3, "points"),
    "ag17_radial_distribution": ("part", 3, "points"),
    "ag1_centre_of_mass": ("lineitem", 1, "atoms"),
    "ag2_periodic_centre_of_mass": ("lineitem", 1, "atoms"),
    "gr1_connected_components": ("lineitem", 1, "edges"),
    "gr3_molecule_unwrap": ("lineitem", 1, "edges"),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the engine before the clock
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    times, rates = {}, {}
    for name in names:
        if os.path.isdir(warm):
            catalogue.QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if name in INPUTS:
            table, each, what = INPUTS[name]
            items = spark.read.parquet(f"{sf_dir}/{table}.parquet").count() * each
            rates[name] = f"{items / times[name] / 1000:.1f} thousand {what}/s"
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "rates": rates}))


if __name__ == "__main__":
    main()
