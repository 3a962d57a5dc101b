"""Augmented odor records from profiles: rules in order, with defaults for what a profile does not say.

A profile is a JSON object with a quality of five channels and a category, and perhaps complexity, chirality and a
description of the molecule, either an object of its own, which then counts alone, or keys beside the others.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyweft.functions import codecs as C
from polyweft.functions import scalars as S

_MOLECULE = "molecular_weight:double,vapor_pressure_kpa:double,functional_groups:array<string>"
PROFILE = f"struct<name:string,category:string,quality:array<double>,complexity:double,chirality:string,molecular_descriptors:struct<{_MOLECULE}>,{_MOLECULE}>"
# fixed values: what the strongest channel, and the one after it, say of the way (directions by channel)
BY_FIRST, BY_SECOND = (1, 0, 3, 4, 3), (7, 0, 3, 4, 5)
LEFT, RIGHT, DESCEND, ASCEND = 0, 1, 2, 3


def profile(json: Column) -> Column:
    """struct(name, category, quality, complexity, chirality, molecule): molecule is null if nothing is said of it; null for what is no object.

    A category is known by name or number, see ``scalars.category_code``; chirality by sign or word.
    """
    p = F.from_json(json, PROFILE)
    nested = p["molecular_descriptors"]
    flat = F.struct(*[p[n].alias(n) for n in ("molecular_weight", "vapor_pressure_kpa", "functional_groups")])
    any_flat = p["molecular_weight"].isNotNull() | p["vapor_pressure_kpa"].isNotNull() | p["functional_groups"].isNotNull()
    return F.when(p.isNotNull(), F.struct(
        p["name"].alias("name"), S.category_code(p["category"], tuple(C.ODORS)).alias("category"), p["quality"].alias("quality"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(p["complexity"], F.lit(0.5)))).alias("complexity"),
        S.chirality_code(F.coalesce(p["chirality"], F.lit("0"))).alias("chirality"), F.coalesce(nested, F.when(any_flat, flat)).alias("molecule"),
    ))


def _binned(value: Column, steps: int, most: int) -> Column:
    """The nearest of ``steps`` + 1 bins of 0 to ``most``, halves to even."""
    return F.greatest(F.lit(0), F.least(F.lit(steps), F.rint(value / float(most) * float(steps)).cast("int")))


def trajectory(quality: Column, complexity: Column) -> Column:
    """Four directions: by intensity, by the strongest channel, by complexity, and by how clear and how pleasant the odor is."""
    ranked = F.array_sort(F.transform(quality, lambda v, i: F.struct((-v).alias("less"), i.cast("int").alias("channel"))))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    place = C.odor_place(quality)
    of = lambda table, channel: F.get(F.array(*[F.lit(d) for d in table]), channel)
    by_second = of(BY_SECOND, second["channel"])
    onset = F.when(place["intensity"] >= 5, 2).when(place["intensity"] >= 3, 1).otherwise(0)
    turn = F.when(complexity >= 0.66, 4).when(complexity <= 0.33, 0).otherwise(by_second)
    margin = second["less"] - first["less"]
    decay = F.when(margin < 0.08, by_second).when((place["pleasantness"] >= 5) & (complexity <= 0.45), 7).when(place["pleasantness"] <= 2, 5).otherwise(6)
    return F.array(onset, of(BY_FIRST, first["channel"]), turn, decay)


def record(p: Column, tree_depth: int = 3, complexity_bits: int = 4, resolution: int = 8) -> Column:
    """struct(category, pleasantness, intensity, directions, tree, complexity, chirality) of a ``profile``; see ``codecs.augmented_words``.

    The axes are rounded to ``resolution`` places and the complexity to ``complexity_bits``; ``tree_depth`` operations
    follow from these, the last one repeated or all after the third left out, unless the molecule says them. A profile
    without a quality of five channels or a known category raises.
    """
    if not 1 <= tree_depth <= 4 or not 2 <= complexity_bits <= 4 or resolution not in (4, 6, 8):
        raise ValueError("tree_depth is 1 to 4, complexity_bits 2 to 4, resolution 4, 6 or 8")
    molecule = p["molecule"]
    weight, vapor = F.coalesce(molecule["molecular_weight"], F.lit(0.0)), F.coalesce(molecule["vapor_pressure_kpa"], F.lit(0.0))
    groups = F.coalesce(molecule["functional_groups"], F.array().cast("array<string>"))
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    complexity = F.when(molecule.isNotNull(), unit(0.5 * p["complexity"] + 0.5 * C.complexity_hint(weight, groups))).otherwise(p["complexity"])
    place = C.odor_place(p["quality"])
    bins = {a: _binned(place[a], resolution - 1, 7) for a in ("pleasantness", "intensity")}
    axes = {a: _binned(b, 7, resolution - 1) for a, b in bins.items()}
    levels = (1 << complexity_bits) - 1
    fine = _binned(complexity, levels, 1)
    operations = [
        F.when(bins["pleasantness"] >= 4, RIGHT).otherwise(LEFT), F.when(bins["intensity"] >= 4, DESCEND).otherwise(ASCEND), F.when(fine <= 5, LEFT).when(fine <= 10, RIGHT).otherwise(DESCEND),
        F.when((bins["pleasantness"] + bins["intensity"] + fine) % 2 == 0, ASCEND).otherwise(DESCEND),
    ][:tree_depth]
    own = F.array(*[operations[min(k, len(operations) - 1)] for k in range(3)])
    says = molecule.isNotNull() & ((weight > 0) | (vapor > 0) | (F.size(groups) > 0))
    tree = F.when(says, C.tree_operations(weight, vapor, groups, axes["pleasantness"].cast("double"))).otherwise(own)
    whole = F.struct(
        p["category"].alias("category"), axes["pleasantness"].alias("pleasantness"), axes["intensity"].alias("intensity"), trajectory(p["quality"], complexity).alias("directions"), tree.alias("tree"), _binned(fine, 15, levels).alias("complexity"), p["chirality"].alias("chirality"),
    )
    sound = F.coalesce((F.size(p["quality"]) == 5) & p["category"].isNotNull(), F.lit(False))
    return F.when(sound, whole).otherwise(F.raise_error(F.lit("a profile needs five channels and a known category")).cast(whole_type()))


def whole_type() -> str:
    return "struct<category:int,pleasantness:int,intensity:int,directions:array<int>,tree:array<int>,complexity:int,chirality:int>"
