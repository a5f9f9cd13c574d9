"""Optimal pairing of the sites of two orderings of the same structures, by periodic distance.

Sites meet inside groups of equal keys and fingerprint, when both sides have as many. The pairing of a group has the
smallest sum of distances.

* Groups of up to ``whole`` sites a side are one row and are solved exactly by shortest augmenting paths.
* Larger groups never meet all with all. Their candidates are the pairs within a radius, found by a join of periodic
  cells; the candidates' connected components are solved apart: single pairs as they are, components of up to ``most``
  sites exactly in one row, larger ones by an auction in DataFrame rounds. Each solution has dual values u and v with
  u + v <= distance for every candidate. If all sites are paired and no component has max u + max v over the radius, no
  longer pair can improve the sum; else the group's radius grows fourfold and the group is solved anew. So a group
  costs the pairs within the radius that its own answer needs; sites that moved far make it large.

The auction ends within n * ``step`` of the optimum (n: sites of the component). Of several optima one is returned; sites at
equal places are paired first, in the order of sites, where the cell is right-angled or there is none (the distance is then
a metric, so some optimum pairs them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.operators.components import components
from facetry.session import cut, written


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of each row of the cheapest full assignment (-1: there is none), and dual values u (rows), v (columns).

    Rows enter one after another, each by a cheapest augmenting path; inf marks pairs that are not allowed.
    """
    n = len(cost)
    u, v, owner, column = np.zeros(n), np.zeros(n), np.full(n, -1), np.full(n, -1)
    for row in range(n):
        best, via, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        here, length, free = row, 0.0, -1
        while free < 0:
            through = length + cost[here] - u[here] - v
            better = ~done & (through < best)
            best[better], via[better] = through[better], here
            open_best = np.where(done, np.inf, best)
            at = int(open_best.argmin())
            length = open_best[at]
            if not np.isfinite(length):
                return np.full(n, -1), u, v
            done[at] = True
            if owner[at] < 0:
                free = at
            else:
                here = owner[at]
        u[row] += length
        for j in np.flatnonzero(done):
            if j != free:
                u[owner[j]] += length - best[j]
            v[j] -= length - best[j]
        while True:
            i = via[free]
            owner[free] = i
            column[i], free = free, column[i]
            if i == row:
                break
    return column, u, v


def frac_delta(a: Column, b: Column) -> Column:
    return g.nearest_image(g.sub(a, b))


def pair_distance(pos1: Column, pos2: Column, cell: Column) -> Column:
    """Of fractional positions, each component of the difference rounded to the nearest image; without a cell, plain."""
    return F.when(cell.isNull(), g.norm(g.sub(pos1, pos2))).otherwise(g.norm(g.frac_to_cart(cell, frac_delta(pos1, pos2))))


def _whole_groups(rows: DataFrame, group: list[str]) -> DataFrame:
    """rows: group, cell, lefts, rights (arrays of site, pos), each a group -> group, left_site, right_site."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                lefts, rights = (sorted(((x["site"], list(x["pos"])) for x in side), key=lambda x: x[0]) for side in (row.lefts, row.rights))
                p, q = (np.array([x[1] for x in side], float) for side in (lefts, rights))
                delta = p[:, None, :] - q[None, :, :]
                if row.cell is not None:
                    delta = (delta - np.round(delta)) @ np.array(list(row.cell), float).reshape(3, 3)
                columns, _, _ = assignment(np.round(np.sqrt((delta * delta).sum(-1)), 12))
                out += [(*[getattr(row, k) for k in group], lefts[i][0], rights[j][0]) for i, j in enumerate(columns)]
            yield pd.DataFrame(out, columns=[*group, "left_site", "right_site"])

    kinds = dict(rows.dtypes)
    site = rows.schema["lefts"].dataType.elementType["site"].dataType.simpleString()
    return rows.mapInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in group], f"left_site {site}", f"right_site {site}"]))


def candidates(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """group, left_site, right_site, distance of the pairs within the group's ``radius``, by cells of at least the radius.

    Both sides: group, site, pos, cell, radius. With a cell, an axis has as many cells as the radius fits into its
    height, and they close into a ring; without one, space is cut into cubes.
    """
    axis = lambda i: g.vec(*[F.col("cell")[3 * i + j] for j in range(3)])
    height = [F.abs(g.determinant(F.col("cell"))) / g.norm(g.cross(axis((i + 1) % 3), axis((i + 2) % 3))) for i in range(3)]
    fits = [F.when(F.col("cell").isNotNull(), F.greatest(F.lit(1), F.floor(height[i] / F.col("radius"))).cast("long")) for i in range(3)]
    inside = [F.col("pos")[i] - F.floor(F.col("pos")[i]) for i in range(3)]
    cells = [F.when(F.col("cell").isNotNull(), F.least(F.floor(inside[i] * F.col(f"_n{i}")), F.col(f"_n{i}") - 1)).otherwise(F.floor(F.col("pos")[i] / F.col("radius"))) for i in range(3)]
    place = lambda side: side.withColumns({f"_n{i}": fits[i] for i in range(3)}).withColumns({f"_g{i}": cells[i] for i in range(3)})
    a = place(left)
    for i in range(3):
        near = [F.col(f"_g{i}") + s for s in (-1, 0, 1)]
        ring = F.array_distinct(F.array(*[F.pmod(x, F.col(f"_n{i}")) for x in near]))
        a = a.withColumn(f"_g{i}", F.explode(F.when(F.col("cell").isNull(), F.array(*near)).otherwise(ring)))
    b = place(right).select(*group, *[f"_g{i}" for i in range(3)], F.col("site").alias("right_site"), F.col("pos").alias("_pos2"))
    a = a.select(*group, *[f"_g{i}" for i in range(3)], F.col("site").alias("left_site"), F.col("pos").alias("_pos1"), "cell", "radius")
    met = a.join(b, [*group, *[f"_g{i}" for i in range(3)]]).withColumn("distance", F.round(pair_distance(F.col("_pos1"), F.col("_pos2"), F.col("cell")), 12))
    return met.where(F.col("distance") <= F.col("radius")).select(*group, "left_site", "right_site", "distance")


def _component_solutions(edges: DataFrame, group: list[str]) -> DataFrame:
    """edges: group, component, left_site, right_site, distance -> group, left_site, right_site (null: no full pairing), slack (max u + max v)."""

    def solve(e: pd.DataFrame) -> pd.DataFrame:
        lefts, i = np.unique(e["left_site"].to_numpy(), return_inverse=True)
        rights, j = np.unique(e["right_site"].to_numpy(), return_inverse=True)
        out = {k: [e[k].iloc[0]] * len(lefts) for k in group} | {"left_site": lefts, "right_site": [None] * len(lefts), "slack": [None] * len(lefts)}
        if len(lefts) == len(rights):
            cost = np.full((len(lefts), len(lefts)), np.inf)
            cost[i, j] = e["distance"].to_numpy()
            columns, u, v = assignment(cost)
            if (columns >= 0).all():
                out |= {"right_site": rights[columns], "slack": [u.max() + v.max()] * len(lefts)}
        return pd.DataFrame(out)

    schema = edges.select(*group, "left_site", "right_site", F.lit(None).cast("double").alias("slack")).schema
    return edges.groupBy(*group, "component").applyInPandas(solve, schema)


def auction(edges: DataFrame, group: list[str], step: float, most_rounds: int = 10_000) -> DataFrame:
    """Pairs of large components in rounds of bids: group, component, left_site, right_site, slack; null if there is no full pairing.

    In a round every free left site bids for its best right site: the price at which its second best would be as good,
    and ``eps`` more. A right site goes to the highest bid and sets its former owner free. ``eps`` falls by tens from a quarter of
    the longest distance to ``step``, each phase starting from the prices of the one before. A site without a second
    choice bids a fixed amount over all distances; prices beyond what any full pairing allows tell that there is none.
    """
    key, spark = [*group, "component"], edges.sparkSession
    sizes = cut(edges.groupBy(*key).agg(F.countDistinct("left_site").alias("_n"), F.countDistinct("right_site").alias("_m"), F.max("distance").alias("_top")))
    fair = sizes.where("_n = _m")
    edges = written(edges.join(fair.select(*key, (2.0 * (F.col("_n") + 2) * (F.col("_top") + step)).alias("_most"), (F.col("_top") + step).alias("_jump")), key), "bidders")
    longest = fair.agg(F.max("_top")).first()[0]
    if longest is None:
        return sizes.select(*group, F.lit(None).cast(dict(edges.dtypes)["left_site"]).alias("left_site"), F.lit(None).cast(dict(edges.dtypes)["right_site"]).alias("right_site"), F.lit(None).cast("double").alias("slack"))
    prices = written(edges.select(*key, "right_site").distinct().withColumn("price", F.lit(0.0)), "prices")
    lefts = written(edges.select(*key, "left_site").distinct(), "lefts")
    eps, last, rounds = max(longest / 4, step), False, 0
    while not last:
        last = eps <= step
        owned = spark.createDataFrame([], edges.select(*key, "left_site", "right_site").schema)
        while rounds < most_rounds:
            rounds += 1
            free = lefts.join(owned, [*key, "left_site"], "left_anti")
            offers = edges.join(free, [*key, "left_site"]).join(prices, [*key, "right_site"]).where(F.col("price") <= F.col("_most"))
            value = -F.col("distance") - F.col("price")
            top = offers.groupBy(*key, "left_site").agg(
                F.max(F.struct(value.alias("v"), (-F.xxhash64("right_site")).alias("h"), "right_site", "price", "_jump")).alias("b"), F.get(F.sort_array(F.collect_list(value), asc=False), F.lit(1)).alias("second"))
            bids = top.select(*key, "left_site", F.col("b.right_site").alias("right_site"), (F.col("b.price") + F.coalesce(F.col("b.v") - F.col("second"), F.col("b._jump")) + eps).alias("bid"))
            won = written(bids.groupBy(*key, "right_site").agg(F.max(F.struct("bid", "left_site")).alias("w")).select(*key, "right_site", "w.left_site", "w.bid"), "bids")
            if won.isEmpty():
                break
            # Files, not checkpoints: a checkpoint hands on the estimated size of its plan, which joins multiply round by round.
            owned = written(owned.join(won, [*key, "right_site"], "left_anti").unionByName(won.select(*key, "left_site", "right_site")), "owned")
            prices = written(prices.join(won.select(*key, "right_site", "bid"), [*key, "right_site"], "left").select(*key, "right_site", F.coalesce("bid", "price").alias("price")), "prices")
        eps = max(eps / 10, step)
    profit = edges.join(prices, [*key, "right_site"]).groupBy(*key, "left_site").agg(F.max(-F.col("distance") - F.col("price")).alias("_p"))
    duals = profit.groupBy(*key).agg((-F.min("_p")).alias("_u")).join(prices.groupBy(*key).agg((-F.min("price")).alias("_v")), key)
    full = sizes.join(owned.groupBy(*key).agg(F.count(F.lit(1)).alias("_o")), key, "left").join(duals, key, "left").withColumn("_full", F.coalesce((F.col("_o") == F.col("_n")) & (F.col("_n") == F.col("_m")), F.lit(False)))
    met = full.join(owned, key, "left")
    return met.select(*group, "left_site", F.when(F.col("_full"), F.col("right_site")).alias("right_site"), F.when(F.col("_full"), F.col("_u") + F.col("_v")).alias("slack"))


def match_orderings(left: DataFrame, right: DataFrame, keys: list[str], far: float = 0.1, whole: int = 64, most: int = 512, step: float = 1e-7) -> DataFrame:
    """keys, left_site, right_site, distance, far (over ``far``), same_element, status (matched, left_only, right_only).

    Both sides: keys, site, fingerprint, element, pos array<double>[3]; the left side also cell array<double>[9]. With a
    cell, positions are fractions of it and the distance is that of the image with every component rounded; where it is
    null, positions are plain coordinates. Groups of unequal size, sites without a position, and sites whose fingerprint
    the other side lacks stay unmatched; null fingerprints match nothing. Sites must be unique by keys.
    """
    group = [*keys, "fingerprint"]
    n_by = lambda side, n: side.where("pos is not null").groupBy(*group).agg(F.count(F.lit(1)).alias(n))
    cells = left.groupBy(*group).agg(F.first("cell", ignorenulls=True).alias("cell"))
    groups = cut(n_by(left, "n").join(n_by(right, "_m"), group).where("n = _m").join(cells, group).drop("_m"))
    sides = [side.where("pos is not null").select(*group, "site", "pos") for side in (left, right)]
    few = groups.where(F.col("n") <= whole)
    packed = [s.join(few.select(*group), group, "left_semi").groupBy(*group).agg(F.collect_list(F.struct("site", "pos")).alias(name)) for s, name in zip(sides, ("lefts", "rights"))]
    pairs = _whole_groups(few.drop("n").join(packed[0], group).join(packed[1], group).select(*group, "cell", "lefts", "rights"), group)
    many = cut(groups.where(F.col("n") > whole).drop("n").withColumn("radius", F.lit(2.0 * far)))
    while not many.isEmpty():
        got, many = _matched_within(sides[0].join(many, group), sides[1].join(many, group), many, group, most, step)
        pairs = pairs.unionByName(got)
    pairs = cut(pairs)
    one = left.select(*keys, F.col("site").alias("left_site"), F.col("element").alias("_e1"), F.col("pos").alias("_p1"), "cell")
    two = right.select(*keys, F.col("site").alias("right_site"), F.col("element").alias("_e2"), F.col("pos").alias("_p2"))
    done = pairs.drop("fingerprint").join(one, [*keys, "left_site"]).join(two, [*keys, "right_site"]).withColumn("distance", pair_distance(F.col("_p1"), F.col("_p2"), F.col("cell")))
    done = done.select(*keys, "left_site", "right_site", "distance", (F.col("distance") > far).alias("far"), (F.col("_e1") == F.col("_e2")).alias("same_element"), F.lit("matched").alias("status"))
    rest = lambda side, s, status: side.select(*keys, s).join(pairs.select(*keys, s), [*keys, s], "left_anti").withColumn("status", F.lit(status))
    return done.unionByName(rest(one, "left_site", "left_only"), allowMissingColumns=True).unionByName(rest(two, "right_site", "right_only"), allowMissingColumns=True)


def _matched_within(left: DataFrame, right: DataFrame, many: DataFrame, group: list[str], most: int, step: float) -> tuple[DataFrame, DataFrame]:
    """(pairs of the groups that are solved with their radius, the other groups with a greater radius)."""
    cell = F.col("cell")
    edge = lambda i: g.vec(*[cell[3 * i + j] for j in range(3)])
    skew = F.coalesce(F.greatest(*[F.abs(g.dot(edge(i), edge(j))) for i, j in ((0, 1), (0, 2), (1, 2))]) > 1e-9 * g.norm(edge(0)), F.lit(False))
    spot = [F.when(cell.isNull(), F.col("pos")[i]).otherwise(F.col("pos")[i] - F.floor(F.col("pos")[i])) for i in range(3)]
    spots = [(F.round(x, 12) + 0.0).alias(f"_s{i}") for i, x in enumerate(spot)]
    number = F.row_number().over(W.partitionBy(*group, "_s0", "_s1", "_s2").orderBy("site")).alias("_k")
    straight = lambda side, name: side.where(~skew).select(*group, F.col("site").alias(name), *spots, "site").select(*group, name, "_s0", "_s1", "_s2", number)
    equal = cut(straight(left, "left_site").join(straight(right, "right_site"), [*group, "_s0", "_s1", "_s2", "_k"]).select(*group, "left_site", "right_site"))
    rest = [side.join(equal.select(*group, F.col(name).alias("site")), [*group, "site"], "left_anti") for side, name in ((left, "left_site"), (right, "right_site"))]
    edges = cut(candidates(*rest, group))
    ends = edges.select(*group, F.struct(F.lit(0).alias("s"), F.col("left_site").alias("x")).alias("u"), F.struct(F.lit(1).alias("s"), F.col("right_site").alias("x")).alias("v"))
    parts = components(ends, group).where("node.s = 0").select(*group, F.col("node.x").alias("left_site"), "component")
    edges = cut(edges.join(parts, [*group, "left_site"]))
    sizes = cut(edges.groupBy(*group, "component").agg(F.countDistinct("left_site").alias("_n"), F.count(F.lit(1)).alias("_e")))
    of = lambda some: edges.join(some.select(*group, "component"), [*group, "component"], "left_semi")
    columns = [*group, "left_site", "right_site", "slack"]
    found = of(sizes.where("_e = 1")).withColumn("slack", F.col("distance")).select(*columns)
    found = found.unionByName(_component_solutions(of(sizes.where((F.col("_e") > 1) & (F.col("_n") <= most))), group).select(*columns))
    large = sizes.where((F.col("_e") > 1) & (F.col("_n") > most))
    if not large.isEmpty():
        found = found.unionByName(auction(of(large), group, step).select(*columns))
    found = cut(found.unionByName(equal.withColumn("slack", F.lit(0.0)).select(*columns)))
    n = left.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    # No two positions are further apart than this; then all pairs were candidates.
    span = F.when(cell.isNull(), F.lit(None)).otherwise(sum(g.norm(edge(i)) for i in range(3)) / 2)
    low = left.select(*group, "pos").unionByName(right.select(*group, "pos")).groupBy(*group).agg(g.norm(g.vec(*[F.max(F.col("pos")[i]) - F.min(F.col("pos")[i]) for i in range(3)])).alias("_span"))
    judged = many.join(n, group).join(low, group).join(found.groupBy(*group).agg(F.count("right_site").alias("_got"), F.max("slack").alias("_slack")), group, "left")
    sure = (F.col("_slack") <= F.col("radius") + 1e-9) | (F.col("radius") >= F.coalesce(span, F.col("_span")))
    judged = cut(judged.withColumn("_done", F.coalesce((F.col("_got") == F.col("_n")) & sure, F.lit(False))))
    pairs = found.join(judged.where("_done").select(*group), group, "left_semi").select(*group, "left_site", "right_site")
    return cut(pairs), cut(judged.where("not _done").select(*many.columns).withColumn("radius", F.col("radius") * 4))
