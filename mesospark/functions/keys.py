"""Interaction keys: canonical order, labels and their parts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = {"pair": 2, "bond": 2, "angle": 3, "dihedral": 4}


def canonical_key(style: str, *types: Column) -> Column:
    """``style:a:b[:c[:d]]`` with pair and bond types sorted, angles and dihedrals in the lesser direction."""
    if len(types) != STYLES[style]:
        raise ValueError(f"{style} has {STYLES[style]} types")
    back = types[::-1]
    if len(types) == 2:
        swap = types[0] > types[1]
    elif len(types) == 3:
        swap = types[0] > types[2]
    else:
        swap = (types[0] > types[3]) | ((types[0] == types[3]) & (types[1] > types[2]))
    return F.when(swap, F.concat_ws(":", F.lit(style), *back)).otherwise(F.concat_ws(":", F.lit(style), *types))


def key_parts(label: Column) -> tuple[Column, Column]:
    """Style and types of a label; an unknown style is an error."""
    parts = F.split(label, ":")
    known = parts[0].isin(*STYLES)
    return F.when(known, parts[0]).otherwise(F.raise_error(F.concat(F.lit("unknown style in "), label))), F.slice(parts, 2, 4)
