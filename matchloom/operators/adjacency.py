"""How near one class is to another, as expressions and as dimension tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions.numeric import round_exact
from matchloom.functions.text import literal_map

# Months are weighted in millionths so that sums over entries are exact integers.
UNIT = 1_000_000


@dataclass
class Adjacency:
    pairs: list[tuple[str, str, float]] = field(default_factory=lambda: list(fv.ADJACENCY_PAIRS))
    classes: list[str] = field(default_factory=lambda: list(fv.FAMILIES))
    identity: float = fv.ADJACENCY_IDENTITY
    default: float = fv.ADJACENCY_DEFAULT
    manager: str | None = fv.MANAGER_FAMILY
    manager_prior: float = fv.ADJACENCY_MANAGER_PRIOR

    def symmetric(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for a, b, score in self.pairs:
            out[f"{a}|{b}"] = score
            out[f"{b}|{a}"] = score
        return out

    def score(self, own: Column, target: Column, priors: Column) -> Column:
        """Identity, else the manager's own history, else the symmetric pair, else default."""
        table = literal_map({k: float(v) for k, v in self.symmetric().items()})
        return (
            F.when(own == target, self.identity)
            .when(own == F.lit(self.manager),
                  F.when(F.array_contains(priors, target), self.manager_prior)
                  .otherwise(self.default))
            .otherwise(F.coalesce(F.try_element_at(table, F.concat(own, F.lit("|"), target)),
                                  F.lit(self.default)))
        )

    def dense(self, spark: SparkSession) -> DataFrame:
        """Every (own, target) class pair with its static score; classes squared rows."""
        table = self.symmetric()
        rows = [(a, b, self.identity if a == b else table.get(f"{a}|{b}", self.default))
                for a in self.classes for b in self.classes]
        return spark.createDataFrame(rows, "own string, target string, static_score double")


def weighted_units(months: Column, weight: Column) -> Column:
    """months x weight as an exact integer number of millionth months."""
    return months.cast("bigint") * F.rint(weight * UNIT).cast("bigint")


def units_to_years(units: Column, digits: int = 2) -> Column:
    return round_exact(units / F.lit(12.0 * UNIT), digits)


def years_towards(months_by: Column, target: Column, priors: Column, adj: Adjacency) -> Column:
    """Years of history counted towards ``target``; ``months_by`` is array<struct<family,months>>."""
    total = F.aggregate(
        months_by, F.lit(0).cast("bigint"),
        lambda acc, m: acc + weighted_units(m["months"], adj.score(m["family"], target, priors)))
    return units_to_years(total)
