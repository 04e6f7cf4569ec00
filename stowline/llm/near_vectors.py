"""Near-duplicate vectors by a robust-pruned flat graph, built in overlapping cluster shards.

1. Equal vectors form classes; one row per class goes on.
2. Each class goes to the shards of its nearest centres, ``COPIES`` at most.
3. Every shard builds a graph: each vector's nearest, thinned by robust pruning,
   plus pruned far ones. A vector's lists from all its shards are united.
4. In each shard vectors search the united graph, from the medoid and from
   themselves: best first, then on through all that lies within the radius.
   A search holds its list of candidates, never a row for every vector. A vector
   represents those within half the radius of it, whose neighbours all lie within
   one and a half: they need no search of their own.
5. What a representative met and those it stands for are compared in double
   precision, and links count for both ends. A pair counts in the first shard that both share, so no pair is
   ever emitted: shards send counts and one edge from each vector to the
   root of its local component.

Shards above ``SHARD_ROWS`` fall into tiles; each pair of tiles is a unit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import checked_broadcast
from stowline.llm.components import components
from stowline.llm.vectors import matrix, unusable, usable
from stowline.sources.staging import most_rows, stage

#: Classes in the sample that centres are fitted on, centres, and classes aimed at in a shard.
SAMPLE, CENTRES, SHARD = 20_000, 4096, 1000
#: Shards above this many rows are tiled.
SHARD_ROWS = 4096
#: A class joins the shards of so many nearest centres, if they are at most so much less similar than the nearest.
COPIES, SLACK = 3, 0.10
#: Near and far edges of a vector, candidates for them, and the slack of pruning.
NEAR, FAR, CANDIDATES, ALPHA = 16, 6, 48, 1.2
#: Candidates of a search, and vectors it goes on from in a step.
BEAM, STEP = 12, 3
#: Vectors searched for at a time, and compared at a time.
BLOCK, COMPARED = 512, 100_000


def near_vectors(rows: DataFrame, at_least: float = 0.95, vec_id: str = "vec_id",
                 embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, by cosine >= ``at_least``.

    Vectors that are null, empty, zero or not finite, and rows without an id,
    link with nothing and form their own component. Rows with equal vectors all
    link with each other, also if they repeat an id. Other columns are ignored.
    Vectors of another length than most stop the job.
    """
    good = stage(usable(rows, vec_id, embedding), "vectors")
    classes = stage(good.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    found = _link_classes(classes, at_least) if most_rows(classes) else None

    alone = unusable(rows, vec_id, embedding).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = alone
    if found is not None:
        members = stage(good.join(classes, "vec").select("vec_id", "rep", "n"), "members")
        out = members.join(checked_broadcast(found), "rep").select(
            "vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _link_classes(classes: DataFrame, at_least: float) -> DataFrame:
    """(rep, links, component_id): rows of other classes linked with each class; staged."""
    units = _units(classes, _fit_centres(classes))
    unit_schema = "rep long, near array<long>"
    built = units.select("unit", "rep", "vec").groupBy("unit").applyInPandas(_build, unit_schema)
    graph = stage(built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")),
                  "graph")
    searched = stage(
        units.join(graph, "rep").groupBy("unit").applyInPandas(
            lambda unit: _search(unit, at_least), "rep long, links long, root long"), "searched")
    roots = components(searched.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return stage(searched.groupBy("rep").agg(F.sum("links").alias("links")).join(
        roots.toDF("rep", "component_id"), "rep"), "linked")


def _fit_centres(classes: DataFrame) -> np.ndarray:
    """Unit centres from a bounded sample, the classes first by the hash of their id."""
    k = int(np.clip(round(most_rows(classes) / SHARD), 1, CENTRES))
    sample = classes.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow()
    points = _unit(matrix(sample.column("vec").combine_chunks()))
    centres = points[:k].copy()
    for _ in range(6):
        own = np.concatenate([(points[i:i + 2048] @ centres.T).argmax(axis=1)
                              for i in range(0, len(points), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        filled = np.linalg.norm(sums, axis=1) > 1e-9
        centres[filled] = _unit(sums[filled])
    return centres


def _unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small numbers
    rows = rows / scale
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _units(classes: DataFrame, centres: np.ndarray) -> DataFrame:
    """(unit, tile, tiles, shards, rep, n, vec): a class once for each unit it is in; staged."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                alike = _unit(matrix(part.column(2))) @ centres.T
                shards = [sorted(order[row[order] >= row[order[0]] - SLACK].tolist()) for row, order in zip(
                    alike, np.argsort(-alike, axis=1, kind="stable")[:, :COPIES], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shards, pa.list_(pa.int32()))],
                                                 ["rep", "n", "vec", "shards"])

    placed = stage(classes.select("rep", "n", "vec").mapInArrow(
        assign, "rep long, n long, vec array<double>, shards array<int>"), "placed")
    # One row per centre.
    sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(
        F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("tiles"))
    spread = placed.withColumn("shard", F.explode("shards")).join(F.broadcast(sizes), "shard").withColumn(
        "tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    unit = F.struct("shard", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    return stage(spread.withColumn("other", other).select(
        unit.alias("unit"), "tile", "shards", "rep", "n", "vec"), "units")


def _build(unit: pd.DataFrame) -> pd.DataFrame:
    """Each vector's pruned neighbours within a unit, edges both ways."""
    unit = unit.sort_values("rep", ignore_index=True)
    points = _unit(np.array(unit["vec"].tolist())).astype(np.float32)
    m = len(points)
    draw = np.random.default_rng(m)
    near: list[set[int]] = [set() for _ in range(m)]
    width = min(CANDIDATES, m - 1)
    for start in range(0, m, 256) if m > 1 else []:
        own = np.arange(start, min(start + 256, m))
        alike = points[own] @ points.T
        alike[np.arange(len(own)), own] = -2
        close = np.argpartition(-alike, width - 1, axis=1)[:, :width]
        far = draw.integers(0, m, (len(own), min(24, m)))
        for candidates, keep in ((close, NEAR), (far, FAR)):
            for at, picked in zip(own, _prune(points, own, candidates, keep), strict=True):
                near[at].update(picked)
                for other in picked:
                    near[other].add(int(at))
    reps = unit["rep"].to_numpy()
    return pd.DataFrame({"rep": reps, "near": [reps[sorted(x)].tolist() for x in near]})


def _prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, keep: int) -> list[list[int]]:
    """Robust pruning: the nearest candidate stays and removes those it covers, until ``keep`` are picked."""
    alike = np.einsum("ncd,nd->nc", points[candidates], points[own])
    order = np.argsort(-alike, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, 1)
    gap = 1 - np.take_along_axis(alike, order, 1)
    among = 1 - np.einsum("ncd,ned->nce", points[candidates], points[candidates])
    alive = candidates != own[:, None]
    picked = np.zeros_like(alive)
    for c in range(candidates.shape[1]):
        take = alive[:, c] & (picked.sum(axis=1) < keep)
        picked[:, c] = take
        # squared distances of unit vectors are twice the gap
        alive &= ~(take[:, None] & (ALPHA ** 2 * among[:, c] <= gap))
    return [row[mask].tolist() for row, mask in zip(candidates, picked, strict=True)]


def _beam(points: np.ndarray, graph: np.ndarray, queries: np.ndarray,
          start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: the ``BEAM`` best vectors met by each (-1: none) and their cosines.

    ``start`` has the vectors each search begins with.
    """
    b = len(queries)
    ids = np.full((b, BEAM), -1, np.int32)
    ids[:, :start.shape[1]] = start
    twice = (start[:, 1:] == start[:, :-1])
    ids[:, 1:start.shape[1]][twice] = -1
    alike = np.where(ids >= 0, np.einsum("bd,bcd->bc", queries, points[ids]), np.float32(-3))
    done = ids < 0
    going = np.arange(b)
    while len(going):
        now, near, seen = ids[going], alike[going], done[going]
        front = np.where(seen, -3, near)
        best = np.argpartition(-front, STEP - 1, axis=1)[:, :STEP]
        open_ = np.take_along_axis(front, best, 1) > -3
        moving = open_.any(axis=1)
        going, now, near, seen, best, open_ = (x[moving] for x in (going, now, near, seen, best, open_))
        if not len(going):
            break
        np.put_along_axis(seen, best, True, 1)
        onward = np.where(open_[:, :, None], graph[np.take_along_axis(now, best, 1)], -1).reshape(len(going), -1)
        onward.sort(axis=1)
        fresh = onward >= 0
        fresh[:, 1:] &= onward[:, 1:] != onward[:, :-1]
        fresh &= ~(onward[:, :, None] == now[:, None, :]).any(axis=2)
        row, column = np.nonzero(fresh)
        found = np.full(onward.shape, -3, np.float32)
        found[row, column] = np.einsum("nd,nd->n", queries[going[row]], points[onward[row, column]])
        ids_, near_ = np.concatenate([now, np.where(fresh, onward, -1)], 1), np.concatenate([near, found], 1)
        seen_ = np.concatenate([seen, ~fresh], 1)
        top = np.argpartition(-near_, BEAM - 1, axis=1)[:, :BEAM]
        ids[going], alike[going], done[going] = (np.take_along_axis(x, top, 1) for x in (ids_, near_, seen_))
    return np.where(alike > -3, ids, -1), alike


def _search(unit: pd.DataFrame, at_least: float) -> pd.DataFrame:
    """Counts of links that this unit owns, and the local root of each vector."""
    unit = unit.sort_values("rep", ignore_index=True)
    reps, weights = unit["rep"].to_numpy(), unit["n"].to_numpy()
    vectors = _unit(np.array(unit["vec"].tolist()))
    points = vectors.astype(np.float32)
    m = len(reps)
    # The united lists' members in this unit.
    near = np.concatenate([np.zeros(0, np.int64), *unit["near"]]).astype(np.int64)
    row, at = np.repeat(np.arange(m), unit["near"].map(len)), np.minimum(np.searchsorted(reps, near), m - 1)
    row, at = row[reps[at] == near], at[reps[at] == near]
    counts = np.bincount(row, minlength=m)
    graph = np.full((m, max(1, counts.max())), -1, np.int32)
    graph[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = at
    medoid = int((points @ points.mean(axis=0)).argmax())
    angle = float(np.arccos(at_least))
    half, beyond = np.cos(angle / 2), np.cos(min(1.5 * angle, np.pi))
    waiting = np.ones(m, bool)
    pairs = [np.zeros(0, np.int64)]
    while waiting.any():
        own = np.flatnonzero(waiting)[:BLOCK]
        # Of vectors that could represent each other the first goes on.
        close = np.tril(points[own] @ points[own].T >= half, -1)
        own = own[~close.any(axis=1)]
        q, v = _within(points, graph, own, medoid, beyond - 0.01)
        cut = np.searchsorted(q, own)
        waiting[own] = False
        for one, met in zip(own, np.split(v, cut[1:]), strict=True):
            if not len(met):
                continue
            alike = vectors[met] @ vectors[one]
            stands_for = met[(alike >= half) & waiting[met]]
            waiting[stands_for] = False
            members, around = np.append(stands_for, one), np.append(met, one)
            for start in range(0, len(members), BLOCK):
                some = members[start:start + BLOCK]
                row, column = np.nonzero(vectors[some] @ vectors[around].T >= at_least)
                a, b = some[row], around[column]
                pairs.append(np.unique((np.minimum(a, b) * m + np.maximum(a, b))[a != b]))
    low, high = np.divmod(np.unique(np.concatenate(pairs)), m)
    owned = _owned(unit, low, high)
    links = np.bincount(low[owned], weights[high[owned]], m) + np.bincount(high[owned], weights[low[owned]], m)
    return pd.DataFrame({"rep": reps, "links": links.astype(np.int64), "root": reps[_label(m, low, high)]})


def _label(m: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest vector of each one's component: labels fall along pairs, then along labels."""
    label = np.arange(m)
    while True:
        before = label.copy()
        np.minimum.at(label, high, label[low])
        np.minimum.at(label, low, label[high])
        label = label[label]
        if (label == before).all():
            return label


def _owned(unit: pd.DataFrame, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether this unit is the one that counts a pair: the first shard that both are in, and their tiles."""
    own = unit["unit"].iloc[0]
    most = max(map(len, unit["shards"]))
    earlier = np.full((len(unit), most), -1)
    for at, shards in enumerate(unit["shards"]):
        mine = [s for s in shards if s < own["shard"]]
        earlier[at, :len(mine)] = mine
    shared = np.zeros(len(low), bool)
    for k in range(most):
        mine = earlier[low, k][:, None]
        shared |= ((earlier[high] == mine) & (mine >= 0)).any(axis=1)
    tile = unit["tile"].to_numpy()
    return ~shared & ((own["i"] == own["j"]) | (tile[low] != tile[high]))


def _within(points: np.ndarray, graph: np.ndarray, own: np.ndarray, medoid: int,
            at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of what searches of ``own`` (ascending) meet within the radius, by query.

    What a best-first search met within the radius spreads along edges until nothing within it is new.
    """
    m = len(points)
    ids, alike = _beam(points, graph, points[own], np.stack([np.full(len(own), medoid), own], axis=1))
    row, column = np.nonzero((alike >= at_least) & (ids >= 0))
    met = np.unique(row * m + ids[row, column])
    front = met
    width = max(1, COMPARED // graph.shape[1])
    while len(front):
        found = []
        for start in range(0, len(front), width):
            row, at = np.divmod(front[start:start + width], m)
            onward = graph[at]
            keys = np.unique((row[:, None] * m + onward)[onward >= 0])
            keys = keys[~np.isin(keys, met, assume_unique=True)]
            row, at = np.divmod(keys, m)
            found.append(keys[np.einsum("nd,nd->n", points[own[row]], points[at]) >= at_least])
        front = np.unique(np.concatenate(found))
        met = np.union1d(met, front)
    row, at = np.divmod(met, m)
    q = own[row]
    return q[q != at].astype(np.int64), at[q != at].astype(np.int64)


def audit_recall(rows: DataFrame, linked: DataFrame, at_least: float = 0.95, queries: int = 200,
                 vec_id: str = "vec_id", embedding: str = "embedding") -> float:
    """Share of true links found, over a sample of vectors held against all rows in one block.

    ``linked`` is a result of :func:`near_vectors`.
    """
    good = usable(rows, vec_id, embedding)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).collect()
    block = _unit(np.array([r["vec"] for r in sample]))
    ids = [r["vec_id"] for r in sample]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                some = _unit(matrix(batch.slice(start, 4096).column(1)))
                total += (block @ some.T >= at_least).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], ["vec_id", "true"])

    true = good.mapInArrow(count, "vec_id long, true long").groupBy("vec_id").agg(
        (F.sum("true") - 1).alias("true"))
    sums = linked.join(F.broadcast(true), "vec_id").agg(
        F.sum(F.least("n_links", "true")), F.sum("true")).first()
    return 1.0 if not sums[1] else sums[0] / sums[1]
