"""Commands: ``python -m framewell COMMAND FOLDER OUT``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from framewell.operators import nets
from framewell.plans import database
from framewell.plans.framework import Framework
from framewell.session import reach
from framewell.sources import structures, tables

COMMANDS = {
    "database": ["sbus_and_linkers", "ligands", "porosity", "topology", "fingerprint", "open_metals"],
    "units": ["sbus_and_linkers", "ligands", "building_units"],
    "porosity": ["porosity"],
    "oms": ["open_metals"],
    "topology": ["all_topologies"],
    "fingerprint": ["fingerprint"],
    "stacking": ["stacking"],
    "curate": [],
    "net": [],
}


def main(argv: list[str] | None = None) -> int:
    """Exit code 0; 1 if a structure couldn't be read."""
    parser = argparse.ArgumentParser("framewell", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--pattern", default="*.cif")
    parser.add_argument("--recursive", action="store_true")
    parser.add_argument("--method", choices=[*nets.METHODS], default="sbus", help="of the net command")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("framewell").getOrCreate()
    reach(spark)
    if args.command == "curate":
        tables.write_json(database.curate(spark, args.folder, args.out, args.pattern), f"{args.out}/general_information")
    elif args.command == "net":
        found, _ = Framework(structures.read(spark, args.folder, args.pattern, args.recursive)).net(args.method)
        structures.write_texts(nets.net_text(found).withColumnRenamed("cgd", "text"), args.out)
    else:
        database.run(spark, args.folder, args.out, COMMANDS[args.command], args.pattern, args.recursive)
        return int(not spark.read.parquet(f"{args.out}/structures").where("error IS NOT NULL").isEmpty())
    failed = structures.structures(structures.read(spark, args.folder, args.pattern, args.recursive)).where("error IS NOT NULL")
    return int(not failed.isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())
