"""From parsed structures to building units, nets and fingerprints: one plan for any number of structures."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.operators import bonds as perception
from framewell.operators import components, edges, fingerprint, groups, nets, porosity, rules, stacking, topology, units
from framewell.session import cut_lineage
from framewell.sources import structures as source


class Cut:
    """A scheme's cuts, and what they leave: components, their images and lattices, regions."""

    def __init__(self, parent: Framework, scheme: str):
        self.parent, self.scheme = parent, scheme

    @cached_property
    def cuts(self) -> DataFrame:
        return cut_lineage(rules.cuts(self.parent.marks, self.parent.bonds, self.scheme))

    @cached_property
    def kept(self) -> DataFrame:
        """Bonds between atoms that no cut separates."""
        return cut_lineage(edges.cut(self.parent.bonds, self.cuts))

    @cached_property
    def members(self) -> DataFrame:
        """(structure_id, atom_id, comp_id, ix, iy, iz, lattice, element, metal) of each atom; metal only outside porphyrins."""
        own = cut_lineage(components.unwrapped(self.parent.atoms, self.kept))
        kinds = self.parent.marks.select("structure_id", "atom_id", "element", (F.col("metal") & rules.free("porphyrin")).alias("metal"))
        return cut_lineage(own.join(kinds, ["structure_id", "atom_id"]))

    @cached_property
    def regions(self) -> DataFrame:
        """(structure_id, comp_id, signature, region_id, is_metal, rank): equal composition is one region; it is a metal's if any member has one."""
        own = groups.regions(self.members.select("structure_id", "comp_id", "element"))
        has = self.members.groupBy("structure_id", "comp_id").agg(F.bool_or("metal").alias("has"), F.any_value(F.size("lattice")).alias("rank"))
        met = own.join(has, ["structure_id", "comp_id"])
        metal = met.groupBy("structure_id", "region_id").agg(F.bool_or("has").alias("is_metal"))
        return cut_lineage(met.join(metal, ["structure_id", "region_id"]).select("structure_id", "comp_id", "signature", "region_id", "is_metal", "has", "rank"))


class Framework:
    """Lazily derived tables of parsed structures; each is written to the checkpoint folder where it is used more than once."""

    def __init__(self, parsed: DataFrame, strip: bool = True, tolerance: float = perception.TOLERANCE):
        self.parsed, self.strip, self.tolerance = parsed, strip, tolerance
        self._cut: dict[str, Cut] = {}

    @cached_property
    def structures(self) -> DataFrame:
        return source.structures(self.parsed)

    @cached_property
    def raw_atoms(self) -> DataFrame:
        return cut_lineage(source.atoms(self.parsed))

    @cached_property
    def raw_bonds(self) -> DataFrame:
        return cut_lineage(perception.perceive(self.raw_atoms, self.tolerance))

    @cached_property
    def atoms(self) -> DataFrame:
        """Atoms without guests."""
        if not self.strip:
            return self.raw_atoms
        kept = units.framework_atoms(self.raw_atoms, components.unwrapped(self.raw_atoms, self.raw_bonds))
        return cut_lineage(self.raw_atoms.join(kept, ["structure_id", "atom_id"], "left_semi"))

    @cached_property
    def bonds(self) -> DataFrame:
        if not self.strip:
            return self.raw_bonds
        own = self.atoms.select("structure_id", "atom_id")
        return cut_lineage(self.raw_bonds.join(own.withColumnRenamed("atom_id", "i"), ["structure_id", "i"], "left_semi").join(own.withColumnRenamed("atom_id", "j"), ["structure_id", "j"], "left_semi"))

    @cached_property
    def marks(self) -> DataFrame:
        return cut_lineage(rules.marked(self.atoms, self.bonds))

    def cut(self, scheme: str) -> Cut:
        return self._cut.setdefault(scheme, Cut(self, scheme))

    def overlaps(self) -> DataFrame:
        return perception.overlapping(self.raw_atoms, self.raw_bonds)

    def building_units(self, scheme: str = "sbu") -> DataFrame:
        """One representative of each region: kind, formula, type, points of extension, members, fragment hash."""
        return units.building_units(self.cut(scheme), self.marks, self.bonds)

    def secondary_units(self) -> DataFrame:
        return self.building_units("sbu")

    def ligands(self) -> DataFrame:
        return self.building_units("ligand_cluster")

    @cached_property
    def incidences(self) -> DataFrame:
        return cut_lineage(nets.incidences(self.cut("ligand_cluster"), self.bonds))

    def net(self, method: str = "all_node") -> tuple[DataFrame, DataFrame]:
        """(edges, nodes) of the underlying net by one of ``nets.METHODS``."""
        return nets.METHODS[method](self)

    def topology(self, method: str = "all_node") -> DataFrame:
        """Name, dimension, TD10, coordination sequences, hash and net text of each structure's net."""
        found, _ = self.net(method)
        return topology.described(found, method)

    def fingerprint(self) -> DataFrame:
        """(structure_id, payload, cluster_units, fingerprint_hash)."""
        cut = self.cut("ligand_cluster")
        own = groups.formula(cut.members, ["structure_id", "comp_id"])
        rank = cut.regions.select("structure_id", "comp_id", "rank", F.when(F.col("has"), "cluster").otherwise("ligand").alias("kind"))
        found = cut_lineage(fingerprint.vertices(self.incidences, own.join(rank, ["structure_id", "comp_id"])))
        return fingerprint.fingerprint(self.incidences, found)

    def open_metals(self) -> DataFrame:
        return units.open_metals(self.marks, self.atoms, self.bonds, self.overlaps())

    def drawing(self, method: str = "all_node") -> tuple[DataFrame, DataFrame]:
        """(positions, edges) of a net's nodes as fractional centres of their atoms, and its edges with shifts between the cells that these lie in."""
        found, nodes = self.net(method)
        return nets.drawn(found, nodes, self.atoms)

    def stacking(self) -> DataFrame:
        """Offsets between the layers of a layered structure."""
        return stacking.layers(components.unwrapped(self.raw_atoms, self.raw_bonds), self.raw_atoms)

    def porosity(self, probe: float = 1.86, samples: int = 10_000) -> DataFrame:
        return porosity.measured(self.atoms, probe, samples)
