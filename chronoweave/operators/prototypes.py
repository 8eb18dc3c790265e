"""K-prototypes clustering of mixed numeric and categorical features.

Rows are first reduced to weighted micro-cells: numeric features are standardised and rounded to a fixed grid, so the
number of cells is bounded by the grid and the categories, not by the rows. Up to `CELLS_ON_DRIVER` cells the Lloyd steps run
over them on the driver; beyond (many categories) they run as aggregations over all cells, and only the centroids reach the
driver. Every row counts, by its cell's weight, either way. A feature that is null in a row takes no part in that row's
distance, so rows with missing fields are assigned by what was observed; the distance is the mean over the row's observed
features. A centroid has a value for every feature: where none of its rows has one, the overall mean or mode, so a
cluster that lacks a field attracts no rows for that. Steps go on until no assignment changes, at most `steps` times.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Cells up to which the Lloyd steps need no Spark job.
CELLS_ON_DRIVER = 20_000


@dataclass(frozen=True)
class Prototypes:
    """Fitted centroids and the scaling of the numeric features."""

    scales: dict[str, tuple[float, float]]
    categories: tuple[str, ...]
    centroids: tuple[dict[str, object], ...]
    gamma: float
    grid: float
    features: dict[str, Column] = field(compare=False, repr=False)

    def cluster(self, seen: dict[str, Column] | None = None) -> Column:
        """The number of the nearest centroid, by observed features only; null features add nothing. `seen`: columns that hold
        the scaled numeric and the categorical features already."""
        if not self.centroids:
            return F.lit(0)
        seen = seen or {n: self._scaled(n) for n in self.scales} | {n: self.features[n] for n in self.categories}
        costs = []
        for i, c in enumerate(self.centroids):
            # a row's observed features are the same for all centroids, so the mean over them orders these as the sum does
            terms = [F.coalesce(F.pow(seen[n] - F.lit(float(c[n])), 2), F.lit(0.0)) for n in self.scales]
            terms += [F.coalesce(F.when(seen[n] != F.lit(c[n]), F.lit(self.gamma)), F.lit(0.0)) for n in self.categories if c[n] is not None]
            cost = terms[0] if terms else F.lit(0.0)
            for t in terms[1:]:
                cost = cost + t
            costs.append(F.named_struct(F.lit("cost"), cost, F.lit("i"), F.lit(i)))
        return F.least(*costs)["i"] if len(costs) > 1 else F.lit(0)

    def assign(self, df: DataFrame, name: str) -> DataFrame:
        """`df` with the cluster as column `name`. Every feature is computed once per row, not once per centroid."""
        held = {n: f"__seen_{i}" for i, n in enumerate((*self.scales, *self.categories))}
        x = df.withColumns({held[n]: self._scaled(n) for n in self.scales} | {held[n]: self.features[n] for n in self.categories})
        return x.withColumn(name, self.cluster({n: F.col(c) for n, c in held.items()})).drop(*held.values())

    def _scaled(self, name: str) -> Column:
        return _on_grid(self.features[name], *self.scales[name], self.grid)


def _on_grid(c: Column, mean: float, spread: float, grid: float) -> Column:
    # least and greatest skip nulls, so a null must be kept apart
    z = F.greatest(F.least((c - F.lit(mean)) / F.lit(spread), F.lit(4.0)), F.lit(-4.0))
    return F.when(c.isNotNull() & ~F.isnan(c), F.round(z / F.lit(grid)) * F.lit(grid))


def fit_prototypes(df: DataFrame, numeric: dict[str, Column], categorical: dict[str, Column], k: int = 8, steps: int = 20, gamma: float = 1.0, grid: float = 0.5, on_driver: int = CELLS_ON_DRIVER) -> Prototypes:
    """Fit on all rows of `df`. k: clusters; steps: most Lloyd steps; gamma: cost of a differing category; grid: cell width in standard deviations.

    Seeds are taken farthest-first among the 32 k heaviest cells, those with every feature first. An empty table gives no centroids (every row is cluster 0).
    """
    features = {**numeric, **categorical}
    scales: dict[str, tuple[float, float]] = {}
    if numeric:
        first = df.agg(*[x for n, c in numeric.items() for x in (F.avg(c).alias(f"m_{n}"), F.stddev_pop(c).alias(f"s_{n}"))]).first()
        scales = {n: (float(first[f"m_{n}"] or 0.0), float(first[f"s_{n}"] or 0.0) or 1.0) for n in numeric if first[f"m_{n}"] is not None}
    names, cats = list(scales), list(categorical)
    keys = [_on_grid(numeric[n], *scales[n], grid).alias(n) for n in names] + [c.cast("string").alias(n) for n, c in categorical.items()]
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        few = [r.asDict() for r in cells.limit(on_driver + 1).collect()]
        order = [*names, *cats]
        if len(few) <= on_driver:
            few.sort(key=lambda r: (sum(r[n] is None for n in order), -r["_n"], *[(r[n] is not None, r[n]) for n in order]))
            usual = _usual(few, cats)
            centroids = _seeds(few[: 32 * k], names, cats, k, gamma, usual)
            for _ in range(steps if centroids else 0):
                last, centroids = centroids, _step(few, centroids, names, cats, gamma, usual)
                if centroids == last:
                    break
            return Prototypes(scales, tuple(cats), tuple(centroids), gamma, grid, features)
        holes = sum((F.col(n).isNull().cast("int") for n in order), F.lit(0))
        heavy = [r.asDict() for r in cells.orderBy(holes, F.desc("_n"), *[F.col(n).asc_nulls_first() for n in order]).limit(32 * k).collect()]
        usual = _usual_of(cells, cats)
        centroids = _seeds(heavy, names, cats, k, gamma, usual)
        on_cells = {n: F.col(n) for n in order}
        for _ in range(steps if centroids else 0):
            # scales of the cells are already applied: identity scaling on the cells' own columns
            local = Prototypes({n: (0.0, 1.0) for n in names}, tuple(cats), tuple(centroids), gamma, grid, on_cells)
            parts = [F.struct(F.lit(n).alias("f"), F.lit(None).cast("string").alias("v"), F.col(n).alias("z")) for n in names]
            parts += [F.struct(F.lit(n).alias("f"), F.col(n).alias("v"), F.lit(None).cast("double").alias("z")) for n in cats]
            long = cells.select(local.cluster().alias("c"), "_n", F.explode(F.array(*parts)).alias("x")).where("x.v is not null or x.z is not null")
            sums = long.groupBy("c", "x.f", "x.v").agg(F.sum("_n").alias("w"), F.sum(F.col("x.z") * F.col("_n")).alias("z"))
            best = sums.groupBy("c", "f").agg(F.max_by("v", F.struct("w", "v")).alias("v"), (F.sum("z") / F.sum("w")).alias("z")).collect()
            centre: dict[int, dict[str, object]] = defaultdict(lambda: {n: 0.0 for n in names} | usual)
            for r in best:
                centre[r["c"]][r["f"]] = r["v"] if r["f"] in cats else r["z"]
            last, centroids = centroids, [centre[c] for c in sorted(centre)] or centroids
            if centroids == last:
                break
        return Prototypes(scales, tuple(cats), tuple(centroids), gamma, grid, features)
    finally:
        cells.unpersist()


def _usual(cells: list[dict], cats: list[str]) -> dict[str, object]:
    """The most frequent value of every category, None for one without values."""
    votes: dict[str, dict[str, int]] = {n: defaultdict(int) for n in cats}
    for r in cells:
        for n in cats:
            if r[n] is not None:
                votes[n][r[n]] += r["_n"]
    return {n: max(v, key=lambda x, v=v: (v[x], x)) if v else None for n, v in votes.items()}


def _usual_of(cells: DataFrame, cats: list[str]) -> dict[str, object]:
    """The same of cells that are not on the driver."""
    out = {}
    for n in cats:
        top = cells.where(F.col(n).isNotNull()).groupBy(n).agg(F.sum("_n").alias("w")).orderBy(F.desc("w"), F.desc(n)).first()
        out[n] = None if top is None else top[n]
    return out


def _step(cells: list[dict], centroids: list[dict], names: list[str], cats: list[str], gamma: float, usual: dict[str, object]) -> list[dict]:
    """One Lloyd step over weighted cells: assign each, then take means and modes."""
    z = np.array([[np.nan if r[n] is None else r[n] for n in names] for r in cells]).reshape(len(cells), len(names))
    weight = np.array([r["_n"] for r in cells], float)
    cost = np.zeros((len(cells), len(centroids)))
    for at, c in enumerate(centroids):
        cost[:, at] = np.nansum((z - np.array([c[n] for n in names], float)) ** 2, axis=1) if names else 0.0
        for n in cats:
            if c[n] is not None:
                cost[:, at] += gamma * np.array([r[n] is not None and r[n] != c[n] for r in cells])
    near = cost.argmin(axis=1)
    out = []
    for i in np.unique(near):
        mine = near == i
        seen = ~np.isnan(z[mine])
        total = (weight[mine][:, None] * seen).sum(axis=0)
        means = np.where(total > 0, np.nansum(weight[mine][:, None] * np.where(seen, z[mine], 0.0), axis=0) / np.where(total > 0, total, 1.0), 0.0)
        modes = _usual([r for r, m in zip(cells, mine, strict=True) if m], cats)
        out.append({n: float(v) for n, v in zip(names, means, strict=True)} | {n: usual[n] if v is None else v for n, v in modes.items()})
    return out


def _seeds(heavy: list[dict], names: list[str], cats: list[str], k: int, gamma: float, usual: dict[str, object]) -> list[dict]:
    def apart(a: dict, b: dict) -> float:
        d = sum((a[n] - b[n]) ** 2 for n in names if a[n] is not None and b[n] is not None)
        return d + gamma * sum(a[n] != b[n] for n in cats if a[n] is not None and b[n] is not None)

    seeds: list[dict] = heavy[:1]
    while heavy and len(seeds) < k:
        far = max(heavy, key=lambda r: (min(apart(r, s) for s in seeds), r["_n"]))
        if min(apart(far, s) for s in seeds) <= 0:
            break
        seeds.append(far)
    return [{n: 0.0 if s[n] is None else s[n] for n in names} | {n: usual[n] if s[n] is None else s[n] for n in cats} for s in seeds]
