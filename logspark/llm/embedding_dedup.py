"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are turned into an orthonormal basis ordered by variance (fitted on a bounded
sample; any such basis keeps cosines, so the sample sets the speed, not the result). Vectors
of a label are dealt into cells along the first axis, as wide as two linked vectors can be
apart, and cells into tiles. Each pair of tiles of the same or neighbouring cells is compared:
products of the leading dimensions first, with the product of the remaining norms as bound on
the rest; a pair goes on only while the bound can reach the threshold, and the cosine of the
given vectors in double precision decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import checkpointed
from logspark.llm.components import components

THRESHOLD, TILE, SAMPLE, CHUNK = 0.98, 1024, 4096, 1 << 15
#: Longer vectors than this are turned into LEADING axes only; the norm that those leave bounds the rest.
WHOLE_BASIS, LEADING = 1024, 256
_SLACK = 1e-9  # far above rounding errors, far below anything that matters


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns, by falling second moment of the unit vectors; of very long vectors the leading ones only."""
    u = unit(vectors)
    if u.shape[1] > WHOLE_BASIS:
        return np.linalg.svd(u[:LEADING], full_matrices=False)[2].T.copy()
    return np.linalg.eigh(u.T @ u)[1][:, ::-1].copy()


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of a, j of b) whose cosine reaches the threshold, in bounded chunks."""
    ua, ub = unit(a), unit(b)
    ra, rb = (ua, ub) if axes is None else (ua @ axes, ub @ axes)
    steps = sorted({min(ra.shape[1], k) for k in (8, 24, ra.shape[1])})
    lead = steps[0]
    beyond = 0.0 if ra.shape[1] == ua.shape[1] else 1.0  # of a leading basis, what the unit length has besides

    def left(r: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt(np.maximum(0, beyond - (r[:, :k] ** 2).sum(axis=1))) if beyond else np.sqrt((r[:, k:] ** 2).sum(axis=1))

    rest = [(left(ra, k), left(rb, k)) for k in steps]
    stripe = max(1, (1 << 20) // max(1, len(b)))
    for top in range(0, len(a), stripe):
        dots = ra[top:top + stripe, :lead] @ rb[:, :lead].T
        may = dots + rest[0][0][top:top + stripe, None] * rest[0][1][None] >= threshold - _SLACK
        ii, jj = np.nonzero(may)
        for at in range(0, len(ii), CHUNK):
            i, j = ii[at:at + CHUNK], jj[at:at + CHUNK]
            so_far, i = dots[i, j], i + top
            for (k0, k1), (na, nb) in zip(zip(steps, steps[1:]), rest[1:]):
                so_far = so_far + np.einsum("ij,ij->i", ra[i, k0:k1], rb[j, k0:k1])
                on = so_far + na[i] * nb[j] >= threshold - _SLACK
                i, j, so_far = i[on], j[on], so_far[on]
            on = np.einsum("ij,ij->i", ua[i], ub[j]) >= threshold
            yield i[on], j[on]


def _forest(i: np.ndarray, j: np.ndarray, root: list[int]) -> list[tuple[int, int]]:
    """Those pairs that join two trees."""
    kept = []
    for x, y in zip(i.tolist(), j.tolist()):
        a, b = x, y
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[a] = b
            kept.append((x, y))
    return kept


def _compared(axes: dict[int, np.ndarray], threshold: float):
    """Arrow function over one pair of tiles: link counts (a, null, n) and joining links (a, b, 0); a vector is
    named by the two halves of its content key."""

    def compare(group: pa.Table) -> pa.Table:
        k1, k2, copies, side = (np.array(group.column(c).to_numpy()) for c in ("k1", "k2", "copies", "side"))
        vectors = np.array(group.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(k1), -1)
        base = axes.get(vectors.shape[1])
        split, links, joins = side != side.min(), np.zeros(len(k1), np.int64), []
        left, right = np.flatnonzero(~split), np.flatnonzero(split)
        root = list(range(len(k1)))
        own = group.column("own")[0].as_py()  # a tile against itself
        right = left if own else right
        if len(left) and len(right):
            for i, j in close_pairs(vectors[left], vectors[right], base, threshold):
                i, j = left[i], right[j]
                if own:
                    i, j = i[i < j], j[i < j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                joins += _forest(i, j, root)
        hit = np.flatnonzero(links)
        a, b = np.r_[hit, [x for x, _ in joins]].astype(np.int64), np.array([y for _, y in joins], np.int64)
        none = [None] * len(hit)
        return pa.table({"a1": pa.array(k1[a]), "a2": pa.array(k2[a]), "b1": pa.array(none + k1[b].tolist(), pa.int64()),
                         "b2": pa.array(none + k2[b].tolist(), pa.int64()), "n": pa.array(np.r_[links[hit], np.zeros(len(joins), np.int64)].astype(np.int64))})

    return compare


def _cells(axes: dict[int, np.ndarray], reach: float):
    @F.arrow_udf("long")
    def cell(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            x = unit(np.array(v.as_py(), float)[None])[0]
            out.append(math.floor(float(x @ axes[len(x)][:, 0] if len(x) in axes else x[0]) / reach))
        return pa.array(out, pa.int64())

    return cell


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(id, n_links, component, kept) for every row.

    Rows link when their labels are equal and not null, their lengths are equal and the cosine
    reaches the threshold. Vectors that are null, empty, zero or hold nulls or non-finite
    numbers link with nothing and are their own component. Copies of a vector under a label
    are compared once and counted as often as they occur. A row stands for its vector, whatever
    its id: rows without an id link like others, are never kept and never name a component
    (one of such rows alone has a null component); rows that repeat an id are told apart by
    their vectors. Other columns don't matter.
    """
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col(label_col).isNotNull() & vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)
    base = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vec.alias("vec"), F.coalesce(sound, F.lit(False)).alias("sound"))
    base = base.withColumn("k1", F.xxhash64("label", "vec")).withColumn("k2", F.xxhash64(F.lit(1), "label", "vec"))
    good = base.where("sound")
    reps = checkpointed(good.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"),
                                                     F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")))
    axes: dict[int, list] = {}
    for r in reps.select("vec", "k1", "k2").orderBy("k1", "k2").limit(SAMPLE).collect():
        axes.setdefault(len(r["vec"]), []).append(r["vec"])
    axes = {d: principal_axes(np.array(v, float)) for d, v in axes.items()}
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    placed = checkpointed(reps.select("k1", "k2", "copies", "label", F.size("vec").alias("dim"), _cells(axes, reach)("vec").alias("cell"), "vec"))
    tiles = checkpointed(placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles")))
    keys = ["label", "dim", "cell"]
    below = tiles.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("under"))
    above = tiles.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("over"))
    around = tiles.join(below, keys, "left").join(above, keys, "left")
    dealt = placed.join(around, keys).withColumn("t", F.pmod(F.xxhash64("k1", "k2"), "tiles"))

    def to(count: Column, place) -> Column:
        numbers = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, place)

    cell, t = F.col("cell"), F.col("t")
    place = lambda c0, t0, c1, t1, side, own: F.struct(c0.alias("c0"), t0.alias("t0"), c1.alias("c1"), t1.alias("t1"), side.cast("int").alias("side"), own.alias("own"))
    never = F.lit(False)
    places = F.concat(
        to(F.col("tiles"), lambda u: place(cell, F.least(t, u), cell, F.greatest(t, u), t > u, t == u)),
        to(F.col("over"), lambda u: place(cell, t, cell + 1, u, F.lit(0), never)),
        to(F.col("under"), lambda u: place(cell - 1, u, cell, t, F.lit(1), never)))
    own = ["label", "dim", "k1", "k2", "copies", "vec"]
    groups = dealt.select(*own, F.explode(places).alias("p")).select(*own, "p.*")
    found = checkpointed(groups.groupBy("label", "dim", "c0", "t0", "c1", "t1").applyInArrow(
        _compared(axes, threshold), "a1 long, a2 long, b1 long, b2 long, n long"))
    counts = found.where("b1 is null").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("n").alias("others"))
    key = lambda x: F.struct(F.col(f"{x}1").alias("k1"), F.col(f"{x}2").alias("k2"))
    joined = components(found.where("b1 is not null").select(key("a").alias("a"), key("b").alias("b")))
    joined = joined.select("node.k1", "node.k2", F.col("component").alias("group"))
    known = checkpointed(reps.select("k1", "k2", "low", "copies").join(counts, ["k1", "k2"], "left").join(joined, ["k1", "k2"], "left").select(
        "k1", "k2", "low", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("group", F.struct("k1", "k2")).alias("group")))
    named = known.join(known.groupBy("group").agg(F.min("low").alias("component")), "group").select("k1", "k2", "n_links", "component")
    linked = good.select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n_links", "component")
    alone = base.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
