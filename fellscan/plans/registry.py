"""Detection passes: what one is, how it is declared, and what it returns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATE_COLUMNS = ["survey_id", "region_id", "pass_name", "row", "col", "score", "feature_type", "area_m2", "morphometrics"]


@dataclass
class Found:
    """Candidates of one pass and, when it has outlines, their member cells (survey_id, region_id, row, col)."""

    candidates: DataFrame
    cells: DataFrame | None = None


@dataclass
class Pass:
    name: str
    version: str
    needs: list[str]
    defaults: dict
    run: Callable[..., Found]
    reads: str = "surface"
    experimental: bool = False
    unused: list[str] = field(default_factory=list)

    def __call__(self, table: DataFrame, **params) -> Found:
        missing = [c for c in self.needs if c not in table.columns]
        if missing:
            raise ValueError(f"pass {self.name} needs columns {missing}")
        known = {k: v for k, v in params.items() if k in self.defaults}
        self.unused = sorted(set(params) - set(known))
        return self.run(table, **{**self.defaults, **known})


PASSES: dict[str, Pass] = {}


def register_pass(name: str, needs: list[str], version: str = "1.0", reads: str = "surface", experimental: bool = False, **defaults):
    """Declare ``f(table, **params) -> Found`` as a pass; its needed columns are checked before anything is planned."""
    def keep(fn):
        PASSES[name] = Pass(name, version, needs, defaults, fn, reads, experimental)
        return PASSES[name]

    return keep


def get_pass(name: str) -> Pass:
    if name not in PASSES:
        raise KeyError(f"unknown pass {name!r}; known: {sorted(PASSES)}")
    return PASSES[name]


def measures(**cols: Column) -> Column:
    pairs = [x for k, v in cols.items() for x in (F.lit(k), v.cast("double"))]
    return F.create_map(*pairs)


def as_candidates(df: DataFrame, name: str, score: Column, feature_type: Column | str, area: Column, **morph: Column) -> DataFrame:
    kind = F.lit(feature_type) if isinstance(feature_type, str) else feature_type
    return df.select(
        "survey_id", "region_id", F.lit(name).alias("pass_name"), F.col("centroid_row").alias("row"), F.col("centroid_col").alias("col"),
        score.cast("double").alias("score"), kind.alias("feature_type"), area.cast("double").alias("area_m2"),
        measures(area_m2=area, **morph).alias("morphometrics"))
