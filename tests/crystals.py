"""Small made-up structures as CIF text."""

from __future__ import annotations


def cif(cell: tuple[float, ...], atoms: list[tuple[str, float, float, float]], order: str = "type") -> str:
    """Text of a P 1 structure; ``order`` puts the columns one way or another. Positions are fractional."""
    names = ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")
    head = "data_made\n" + "".join(f"_cell_{n} {v}\n" for n, v in zip(names, cell, strict=True)) + "loop_\n_symmetry_equiv_pos_as_xyz\n 'x, y, z'\nloop_\n"
    columns = ["type_symbol", "label", "fract_x", "fract_y", "fract_z", "occupancy"]
    if order != "type":
        columns = ["label", "occupancy", "fract_x", "fract_y", "fract_z", "type_symbol"]
    rows = [{"type_symbol": s, "label": f"{s}{k}", "fract_x": f"{x:.6f}(2)", "fract_y": f"{y:.6f}", "fract_z": f"{z:.6f}", "occupancy": "1.0"} for k, (s, x, y, z) in enumerate(atoms)]
    return head + "".join(f"_atom_site_{c}\n" for c in columns) + "".join(" ".join(r[c] for c in columns) + "\n" for r in rows)


def cubic(times: int = 1, guest: bool = False, origin: float = 0.0) -> str:
    """A metal with linkers N-C-C-N along each axis, doubled along c if asked for; with a molecule in the pore if asked for."""
    a = 8.0
    atoms = []
    for k in range(times):
        atoms.append(("Zn", 0.0, 0.0, float(k)))
        for axis in range(3):
            for s, d in (("N", 2.0), ("C", 3.3), ("C", 4.7), ("N", 6.0)):
                place = [0.0, 0.0, float(k)]
                place[axis] += d / a
                atoms.append((s, *place))
    if guest:
        atoms += [("C", 0.5, 0.5, 0.5), ("O", 0.5 + 1.4 / a, 0.5, 0.5)]
    moved = [(s, x + origin, y + origin, (z + origin) / times) for s, x, y, z in atoms]
    return cif((a, a, a * times, 90, 90, 90), moved)


def rod() -> str:
    """A chain of metals and oxygens along c, joined sideways by linkers O-C-C-O that bond one metal at each end."""
    a, c = 9.0, 4.0
    atoms = [("Ti", 0.0, 0.0, 0.0), ("O", 0.0, 0.0, 0.5)]
    for axis in (0, 1):
        for s, d in (("N", 2.1), ("C", 3.5), ("C", 5.5), ("N", 6.9)):
            place = [0.0, 0.0, 0.0]
            place[axis] += d / a
            atoms.append((s, *place))
        place = [0.0, 0.0, 0.0]
        place[axis] += 4.5 / a
        atoms.append(("C", *place))
    return cif((a, a, c, 90, 90, 90), atoms)


def sheets() -> str:
    """Two flat square nets of carbon, 3.5 apart, the second moved sideways by 0.7."""
    a = 1.4
    atoms = [("C", 0.0, 0.0, 0.0), ("C", 0.5, 0.0, 0.5)]
    return cif((a, a, 7.0, 90, 90, 90), atoms, "label")
