"""Permutation importance: how much worse a fitted ensemble gets when a column is shuffled inside a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadspan.operators.models import Ensemble, member_weights
from loadspan.operators.roll import Linear, Trees, flatten, region_place
from loadspan.plans.skew import salted_join

#: Rows of a group that are shuffled among themselves; a larger group is dealt into blocks of about so many.
BLOCK = 20_000

#: Leaves that one number holds as bits.
BITS = 64


class LeafSets:
    """Trees as sets of leaves: for each column and tree, the leaves that a value still allows, whatever the row's other columns.

    A row ends in the one leaf that all its columns allow. So a shuffled column needs its own sets once more, and no walk.
    """

    def __init__(self, trees: Trees, wide: int):
        self.weights = trees.weights
        # a value's place among the cuts of its column tells the result of every test of that column
        self.cuts = [np.unique(trees.threshold[trees.feature == c]) for c in range(wide)]
        self.trees = [self._sets(trees, root, wide) for root in trees.roots]

    @property
    def small(self) -> bool:
        return all(len(values) <= BITS for _, _, values in self.trees)

    def _sets(self, trees: Trees, root: int, wide: int) -> tuple[dict[int, np.ndarray], list[tuple[int, int, int]], np.ndarray]:
        """Sets by column and place among its cuts, those of the region's columns (place, set where it is there, set elsewhere), and values of the leaves."""
        nodes = [int(root)]
        for node in nodes:
            if trees.feature[node] >= 0:
                nodes += [int(trees.left[node]), int(trees.right[node])]
        below, values = {}, []
        for node in reversed(nodes):
            if trees.feature[node] < 0:
                below[node] = 1 << len(values)
                values.append(trees.value[node])
            else:
                below[node] = below[int(trees.left[node])] | below[int(trees.right[node])]
        columns, regions = {}, []
        if len(values) <= BITS:
            for node in nodes:
                feature, threshold = int(trees.feature[node]), trees.threshold[node]
                if feature < 0:
                    continue
                low, high = (below[root] & ~below[int(side[node])] for side in (trees.right, trees.left))
                if feature < wide:
                    sets = columns.setdefault(feature, np.full(len(self.cuts[feature]) + 1, below[root], np.uint64))
                    upto = np.searchsorted(self.cuts[feature], threshold) + 1
                    sets[:upto] &= np.uint64(low)
                    sets[upto:] &= np.uint64(high)
                else:
                    regions.append((feature - wide, *(low if v <= threshold else high for v in (1.0, 0.0))))
        return columns, regions, np.array(values)

    def predict(self, x: np.ndarray, hot: np.ndarray, orders: Sequence[np.ndarray]) -> np.ndarray:
        """Weighted sums of the leaves: of the rows as they are, then with each column in its order."""
        places = [np.searchsorted(cuts, x[:, c]) for c, cuts in enumerate(self.cuts)]
        moved = [p[order] for p, order in zip(places, orders)]
        out = np.zeros((1 + len(orders), len(x)))
        for (columns, regions, values), weight in zip(self.trees, self.weights):
            values = values * weight
            used = sorted(columns)
            sets = [columns[c][places[c]] for c in used]
            # what the columns after each one allow, and the region; those before it are added on the way
            after = np.full(len(x), 2 ** len(values) - 1, np.uint64)
            for place, there, elsewhere in regions:
                after &= np.where(hot == place, np.uint64(there), np.uint64(elsewhere))
            rest = [after]
            for s in sets[:0:-1]:
                rest.append(rest[-1] & s)
            rest.reverse()
            leaf = lambda allowed: values[np.bitwise_count(allowed - np.uint64(1))]  # noqa: B023, E731
            whole = leaf(rest[0] & sets[0]) if used else leaf(after)
            others = dict.fromkeys(range(len(orders)), whole)
            before = None
            for c, s, r in zip(used, sets, rest):
                known = r if before is None else r & before
                others[c] = leaf(known & columns[c][moved[c]])
                before = s if before is None else before & s
            out[0] += whole
            for c, v in others.items():
                out[1 + c] += v
        return out


def walked(member: Trees | Linear, x: np.ndarray, hot: np.ndarray, orders: Sequence[np.ndarray]) -> np.ndarray:
    """As :meth:`LeafSets.predict` for any member, by a prediction for every column."""
    out = [member.predict(x, hot)]
    for c, order in enumerate(orders):
        moved = x.copy()
        moved[:, c] = x[order, c]
        out.append(member.predict(moved, hot))
    return np.stack(out)


def permutation_errors(rows: DataFrame, ensemble: Ensemble, columns: Sequence[str], label: str = "label", keys: Sequence[str] = ("region", "horizon"),
                       weights: Mapping[str, float] | None = None, order: Sequence[str] = ("ts",), block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(keys, feature, rows, base, shuffled): mean squared errors before and after each column is shuffled inside its group.

    All columns are shuffled and scored in one pass: a task gets about ``block`` rows of a group, dealt by a hash of ``order``, and puts the values of
    one column after the other in the order of a hash of the row and the column. The shuffle depends on the rows alone, so
    a repeated run gives the same. Rows with a null label are left out.
    """
    keys, columns = list(keys), list(columns)
    flat = flatten(ensemble, rows)
    ready = region_place(ensemble, rows.filter(F.col(label).isNotNull()))
    sizes = ready.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("_blocks"))
    row = F.xxhash64(*order, F.lit(seed))
    dealt = salted_join(ready, sizes, keys, list(order)).select(
        *keys, *[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("_y"), "hot",
        row.alias("_row"), F.pmod(row, F.col("_blocks")).alias("_block"),
    )
    share = member_weights(list(flat.members), weights)
    sets = {name: LeafSets(m, len(columns)) for name, m in flat.members.items() if isinstance(m, Trees)}
    sets = {name: s for name, s in sets.items() if s.small}
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]

    def run(key, group):
        group = group.sort_by("_row")
        x = np.column_stack([group.column(c).to_numpy() for c in columns])
        y, hot = group.column("_y").to_numpy(), group.column("hot").to_numpy()
        x = (x - flat.mean) * flat.scale
        ids = group.column("_row").to_numpy().view(np.uint64)
        orders = []
        for c in range(len(columns)):
            mixed = (ids + np.uint64((c + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            orders.append(np.argsort(mixed ^ (mixed >> np.uint64(31)), kind="stable"))
        found = sum((sets[name].predict(x, hot, orders) if name in sets else walked(m, x, hot, orders)) * share[name] for name, m in flat.members.items())
        base, *errors = ((found - y) ** 2).sum(axis=1)
        n = len(columns)
        fixed = {k: pa.array([key[i].as_py()] * n, group.schema.field(k).type) for i, k in enumerate(keys)}
        return pa.table({**fixed, "feature": columns, "rows": pa.array([len(y)] * n, pa.int64()), "base": [float(base)] * n, "shuffled": list(map(float, errors))})

    ddl = ", ".join(f"{k} {t}" for k, t in zip(keys, kinds))
    parts = dealt.groupBy(*keys, "_block").applyInArrow(run, f"{ddl}, feature string, rows bigint, base double, shuffled double")
    return parts.groupBy(*keys, "feature").agg(
        F.sum("rows").alias("rows"), (F.sum("base") / F.sum("rows")).alias("base"), (F.sum("shuffled") / F.sum("rows")).alias("shuffled"),
    )


def permutation_importance(rows: DataFrame, ensemble: Ensemble, columns: Sequence[str], label: str = "label", keys: Sequence[str] = ("region", "horizon"),
                           **settings) -> DataFrame:
    """(keys, feature, importance): each feature's share of the errors that shuffling adds, within its group.

    A feature without which nothing gets worse has 0. The shares of a group sum to 1, or are all 0. Windows are over one row for each feature.
    """
    added = permutation_errors(rows, ensemble, columns, label, keys, **settings).withColumn(
        "_added", F.greatest(F.lit(0.0), F.col("shuffled") - F.col("base")))
    share = F.try_divide("_added", F.sum("_added").over(Window.partitionBy(*keys)))
    return added.select(*keys, "feature", F.coalesce(share, F.lit(0.0)).alias("importance"))
