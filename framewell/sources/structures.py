"""Crystal structure files as DataFrames, and structures as files' text.

``structures(structure_id, source, cell, pbc, n_atoms, error)`` and ``atoms(structure_id, atom_id, element, fx, fy, fz,
x, y, z, occupancy)``; cell rows are lattice vectors. A file that can't be read becomes a row with an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.functions.text import record_key

ATOM = T.StructType([T.StructField("element", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("fx", "fy", "fz", "occupancy"))])
PARSED = T.StructType(
    [T.StructField("structure_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("cell", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("pbc", T.ArrayType(T.BooleanType())), T.StructField("atoms", T.ArrayType(ATOM)), T.StructField("error", T.StringType())]
)
TOKEN = re.compile(r"'((?:[^']|'(?=\S))*)'|\"((?:[^\"]|\"(?=\S))*)\"|([^\s#]\S*)")


def number(text: str) -> float:
    """A CIF number, its uncertainty in brackets dropped; unknown values are 0."""
    return 0.0 if text in ("?", ".") else float(text.split("(")[0])


def tokens(line: str) -> list[str]:
    return [a or b or c for a, b, c in TOKEN.findall(line)]


def blocks(text: str) -> tuple[dict[str, str], list[tuple[list[str], list[list[str]]]]]:
    """Single values, and loops as (columns, rows), of the first data block."""
    values: dict[str, str] = {}
    loops: list[tuple[list[str], list[list[str]]]] = []
    lines, k, started = text.splitlines(), 0, False
    while k < len(lines):
        line = lines[k].strip()
        low = line.lower()
        if low.startswith("data_"):
            if started:
                break
            started = True
        elif low == "loop_":
            names, flat = [], []
            k += 1
            while k < len(lines) and lines[k].strip().startswith("_"):
                names.append(lines[k].split()[0].lower())
                k += 1
            while k < len(lines):
                own = lines[k].strip()
                if own.startswith("_") or own.lower() == "loop_" or own.lower().startswith("data_"):
                    break
                if own.startswith(";"):
                    part = [own[1:]]
                    k += 1
                    while k < len(lines) and not lines[k].startswith(";"):
                        part.append(lines[k])
                        k += 1
                    flat.append("\n".join(part))
                elif own and not own.startswith("#"):
                    flat += tokens(own)
                k += 1
            if names:
                loops.append((names, [flat[i : i + len(names)] for i in range(0, len(flat) - len(names) + 1, len(names))]))
            continue
        elif line.startswith("_"):
            parts = tokens(line)
            if len(parts) > 1:
                values[parts[0].lower()] = parts[1]
            elif k + 1 < len(lines) and not lines[k + 1].strip().startswith("_"):
                k += 1
                values[parts[0].lower()] = lines[k].strip().strip("'\"")
        k += 1
    return values, loops


def vectors(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    """Lattice vectors as rows: a along x, b in the xy plane."""
    ca, cb, cg = (0.0 if abs(x - 90) < 1e-12 else math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    sg = math.sqrt(1 - cg * cg)
    y = (ca - cb * cg) / sg
    return np.array([[a, 0, 0], [b * cg, b * sg, 0], [c * cb, c * y, c * math.sqrt(max(1 - cb * cb - y * y, 0))]])


def operation(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation of a symmetry operation such as ``-x+1/2, y, z``."""
    turn, move = np.zeros((3, 3)), np.zeros(3)
    for row, part in enumerate(text.lower().replace(" ", "").split(",")):
        for sign, value, axis in re.findall(r"([+-]?)(?:(\d+(?:\.\d+)?(?:/\d+)?)|\*?([xyz]))", part):
            s = -1.0 if sign == "-" else 1.0
            if axis:
                turn[row, "xyz".index(axis)] += s
            else:
                top, _, bottom = value.partition("/")
                move[row] += s * float(top) / float(bottom or 1)
    return turn, move


def element_of(text: str) -> str:
    """The symbol at the beginning of a type or label: ``Zn2+`` and ``ZN1`` are ``Zn``."""
    m = re.match(r"[A-Za-z]{1,2}", text)
    if not m:
        return "X"
    from framewell.functions.elements import MASS

    own = m[0].capitalize()
    return own if own in MASS else own[0]


def parse_cif(text: str) -> tuple[list[list[float]], list[dict]]:
    """Cell and atoms of a CIF; columns are found by name; symmetry operations are applied, coinciding atoms kept once."""
    values, loops = blocks(text)
    cell = vectors(*(number(values[f"_cell_{k}"]) for k in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")))
    operations = []
    for names, rows in loops:
        for name in ("_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz"):
            if name in names:
                operations = [operation(r[names.index(name)]) for r in rows]
    if not operations and "_symmetry_equiv_pos_as_xyz" in values:
        operations = [operation(values["_symmetry_equiv_pos_as_xyz"])]
    names, rows = next((n, r) for n, r in loops if any(x.startswith("_atom_site_fract") or x.startswith("_atom_site_cartn") for x in n))
    at = {n.removeprefix("_atom_site_"): k for k, n in enumerate(names)}
    inverse = np.linalg.inv(cell)
    atoms: list[dict] = []
    for r in rows:
        if "fract_x" in at:
            place = np.array([number(r[at[f"fract_{x}"]]) for x in "xyz"])
        else:
            place = np.array([number(r[at[f"cartn_{x}"]]) for x in "xyz"]) @ inverse
        symbol = element_of(r[at["type_symbol"]] if "type_symbol" in at else r[at["label"]])
        occupancy = number(r[at["occupancy"]]) if "occupancy" in at else 1.0
        found: list[np.ndarray] = []
        for turn, move in operations or [(np.eye(3), np.zeros(3))]:
            p = turn @ place + move
            gap = [np.linalg.norm((p - q - np.rint(p - q)) @ cell) for q in found]
            if not gap or min(gap) > 1e-3:
                found.append(p if not found and np.allclose(turn, np.eye(3)) else p % 1.0)
        atoms += [{"element": symbol, "fx": float(p[0]), "fy": float(p[1]), "fz": float(p[2]), "occupancy": occupancy} for p in found]
    return cell.tolist(), atoms


def parse_poscar(text: str) -> tuple[list[list[float]], list[dict]]:
    """Cell and atoms of a VASP 5 structure."""
    lines = text.splitlines()
    scale = float(lines[1])
    cell = np.array([[float(x) for x in lines[k].split()[:3]] for k in (2, 3, 4)]) * scale
    symbols = [s for s, n in zip(lines[5].split(), lines[6].split(), strict=True) for _ in range(int(n))]
    k = 8 if lines[7].strip()[:1] in "sS" else 7
    direct = lines[k].strip()[:1] not in "cCkK"
    inverse = np.linalg.inv(cell)
    atoms = []
    for s, line in zip(symbols, lines[k + 1 :], strict=False):
        p = np.array([float(x) for x in line.split()[:3]])
        p = p if direct else p * scale @ inverse
        atoms.append({"element": s, "fx": float(p[0]), "fy": float(p[1]), "fz": float(p[2]), "occupancy": 1.0})
    return cell.tolist(), atoms


def parse_xyz(text: str) -> tuple[list[list[float]] | None, list[dict]]:
    """Cell (None without a Lattice) and atoms of (extended) XYZ; without a cell the coordinates stand as they are."""
    lines = text.splitlines()
    m = re.search(r'Lattice="([^"]+)"', lines[1])
    cell = np.array([float(x) for x in m[1].split()]).reshape(3, 3) if m else None
    atoms = []
    for line in lines[2 : 2 + int(lines[0])]:
        s, *xyz = line.split()[:4]
        p = np.array([float(v) for v in xyz])
        p = p @ np.linalg.inv(cell) if cell is not None else p
        atoms.append({"element": s, "fx": float(p[0]), "fy": float(p[1]), "fz": float(p[2]), "occupancy": 1.0})
    return (cell.tolist() if cell is not None else None), atoms


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {f.name: [] for f in PARSED.fields}
        for name, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cell, atoms, error = None, [], None
            try:
                low = (source or "").lower()
                parse = parse_xyz if low.endswith(".xyz") else parse_poscar if low.endswith((".vasp", ".poscar")) or "poscar" in low.rsplit("/", 1)[-1] else parse_cif
                cell, atoms = parse(text or "")
                if not atoms:
                    error = "no atoms"
            except Exception as wrong:  # a broken file is a row with an error, not a lost job
                error = f"{type(wrong).__name__}: {wrong}"
            pbc = [cell is not None] * 3
            for key, value in zip(rows, (name, source, cell or [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]], pbc, atoms, error), strict=True):
                rows[key].append(value)
        atom = pa.struct([("element", pa.string()), *((c, pa.float64()) for c in ("fx", "fy", "fz", "occupancy"))])
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("structure_id", pa.string()), ("source", pa.string()), ("cell", pa.list_(pa.list_(pa.float64()))), ("pbc", pa.list_(pa.bool_())), ("atoms", pa.list_(atom)), ("error", pa.string())]))


def parse(files: DataFrame) -> DataFrame:
    """Parsed structures of (structure_id, source, text) rows; the source's suffix tells the format, CIF otherwise."""
    return files.select("structure_id", "source", "text").mapInArrow(_parsed, PARSED)


def read(spark: SparkSession, path: str, pattern: str = "*.{cif,vasp,poscar,xyz}", recursive: bool = True) -> DataFrame:
    """Parsed structures of all files under a path, each file once."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).format("text").load(path)
    named = files.select("*", F.col("_metadata.file_path").alias("source"))
    return parse(named.select(record_key(F.col("source")).alias("structure_id"), "source", F.col("value").alias("text")))


def cartesian(cell: Column, f: list[Column]) -> list[Column]:
    """Cartesian coordinates of fractional ones."""
    return [sum((f[r] * cell[r][c] for r in range(1, 3)), f[0] * cell[0][c]) for c in range(3)]


def structures(parsed: DataFrame) -> DataFrame:
    return parsed.select("structure_id", "source", "cell", "pbc", F.size("atoms").alias("n_atoms"), "error")


def atoms(parsed: DataFrame) -> DataFrame:
    """A row for each atom, numbered from 0 in file order."""
    rows = parsed.where("error IS NULL").select("structure_id", "cell", "pbc", F.posexplode("atoms").alias("atom_id", "a"))
    place = cartesian(F.col("cell"), [F.col(f"a.f{x}") for x in "xyz"])
    return rows.select("structure_id", "atom_id", "a.element", "a.fx", "a.fy", "a.fz", *(p.alias(x) for p, x in zip(place, "xyz", strict=True)), "a.occupancy", "cell", "pbc")


def listed(atoms: DataFrame, line: Column) -> DataFrame:
    """(structure_id, lines, n, cell) with a line for each atom, in order."""
    rows = atoms.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("atom_id", line.alias("line")))).alias("rows"), F.any_value("cell").alias("cell"))
    return rows.select("structure_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("lines"), F.size("rows").alias("n"), "cell")


def xyz_text(atoms: DataFrame) -> DataFrame:
    """(structure_id, text): XYZ with the lattice in its second line."""
    own = listed(atoms, F.format_string("%s %.8f %.8f %.8f", "element", "x", "y", "z"))
    lattice = F.array_join(F.transform(F.flatten("cell"), lambda v: F.format_number(v, 8)), " ")
    return own.select("structure_id", F.concat(F.col("n").cast("string"), F.lit('\nLattice="'), F.regexp_replace(lattice, ",", ""), F.lit('" Properties=species:S:1:pos:R:3\n'), "lines").alias("text"))


def lengths(cell: Column) -> tuple[list[Column], list[Column]]:
    """Cell lengths and angles in degrees."""
    dot = lambda i, j: sum((cell[i][k] * cell[j][k] for k in (1, 2)), cell[i][0] * cell[j][0])
    size = [F.sqrt(dot(k, k)) for k in range(3)]
    return size, [F.degrees(F.acos(dot(i, j) / (size[i] * size[j]))) for i, j in ((1, 2), (0, 2), (0, 1))]


def cif_text(atoms: DataFrame) -> DataFrame:
    """(structure_id, text): a P 1 CIF."""
    own = listed(atoms, F.format_string("%s %s%d %.8f %.8f %.8f %.4f", "element", "element", "atom_id", "fx", "fy", "fz", "occupancy"))
    size, angle = lengths(F.col("cell"))
    head = F.format_string("data_%s\n_cell_length_a %.8f\n_cell_length_b %.8f\n_cell_length_c %.8f\n_cell_angle_alpha %.8f\n_cell_angle_beta %.8f\n_cell_angle_gamma %.8f\n", "structure_id", *size, *angle)
    columns = "_symmetry_space_group_name_H-M 'P 1'\nloop_\n_atom_site_type_symbol\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\n_atom_site_occupancy\n"
    return own.select("structure_id", F.concat(head, F.lit(columns), "lines", F.lit("\n")).alias("text"))


def cssr_text(atoms: DataFrame) -> DataFrame:
    """(structure_id, text): CSSR with cell and coordinates in reversed axis order, four decimals."""
    own = listed(atoms, F.format_string("%4d %-4s %8.4f %8.4f %8.4f    0   0   0   0   0   0   0   0  0.0000", F.col("atom_id") + 1, "element", "fz", "fy", "fx"))
    size, angle = lengths(F.col("cell"))
    head = F.format_string("%28s%8.4f%8.4f%8.4f\n%21s%8.4f%8.4f%8.4f    SPGR =  1 P 1         OPT = 1\n%4d   0\n0 %s\n", F.lit(""), *size[::-1], F.lit(""), *angle[::-1], "n", "structure_id")
    return own.select("structure_id", F.concat(head, "lines", F.lit("\n")).alias("text"))


def write_texts(texts: DataFrame, path: str) -> None:
    """One folder of a text file for each structure."""
    texts.select("structure_id", "text").write.partitionBy("structure_id").mode("overwrite").text(path)


def json_text(atoms: DataFrame) -> DataFrame:
    """(structure_id, text): JSON with labels, positions, lattice vectors, periodicity and number of atoms."""
    rows = atoms.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("atom_id", "element", F.array("x", "y", "z").alias("p")))).alias("a"), F.any_value("cell").alias("lattice_vectors"), F.any_value("pbc").alias("periodic"))
    fields = F.struct(F.transform("a", lambda a: a["element"]).alias("labels"), "lattice_vectors", F.size("a").alias("n_atoms"), "periodic", F.transform("a", lambda a: a["p"]).alias("positions"))
    return rows.select("structure_id", F.to_json(fields).alias("text"))
