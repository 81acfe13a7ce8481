"""Vectors of one label whose cosine reaches a limit: robust-pruned flat graphs, searched by range.

1. Vectors that lie within half the limit's angle of one middle all link with each other, whatever their number.
   Middles of such tight groups are looked for in a bounded sample of each label; their members are counted, not
   compared. Another vector links with all of a group, with none, or (in the band between) is compared.
2. The others go to shards: clusters of each label, split again while they are large. A vector goes to the nearest
   cluster and to the second where that is almost as near, so shards overlap.
3. In each cell (a shard, or a block of one that does not split) a flat graph is built: vectors are inserted in
   growing batches, each searched for from the medoid, its neighbours chosen by robust pruning and linked back.
4. A vector's adjacency lists from all its cells are joined to one.
5. Each vector is searched for from the medoid of its cells over the joined lists, greedily; then whatever lies in
   range, or little outside, is expanded until nothing new is in range. Links are verified in double precision.
6. ``recall`` compares a bounded, fixed set of vectors with all vectors. Where less than ``LEAST_RECALL`` of their
   links were found, the shards are built anew with more overlap.

A pair that meets in several cells counts in the first of them. Cells give counts and a spanning set of links, not
pairs; the blocks of a shard are compared two by two, so nothing is lost where a shard does not split.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, has no label or no id,
links with nothing; its component is its own id, and without an id it is not kept. Vectors of different lengths are
not compared. Rows that share an id are vectors of their own in ``n_links`` and share a component. An empty table
gives an empty result. Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlens.llm.common import distinct as ordered
from demandlens.llm.jaccard_join import components
from demandlens.session import stage

COSINE = 0.98
#: Rows of a label or shard that middles and clusters are fitted on, about; rows that go to one assigning task.
SAMPLE, SALTED = 10_000, 10_000
#: Rows searched for in a cell by one task; numbers held at once by one step in a cell.
ASKED, HELD = 16_000, 2_000_000
#: Of the sample, what makes a tight group.
TIGHT_SHARE = 0.002
#: Rows that a cell is aimed at and holds at most; clusters of one split; splits after another.
CELL, BLOCK, CLUSTERS, LEVELS = 1_200, 4_000, 256, 4
#: A second cluster is taken where its cosine is at most so much smaller.
OVERLAP = 0.2
DEGREE, BEAM, ALPHA = 24, 48, 1.2
#: Queries that are searched for at once.
ASKING = 256
#: Lists in which a node stands at least, if it has so many neighbours; pruning alone leaves nodes that no list leads to.
BACK = 6
#: What is expanded though it is out of range by so much, and how many of a beam at once.
SLACK, WIDTH = 0.03, 4
AUDIT, LEAST_RECALL = 400, 0.95
#: Angles are trusted up to this.
EPSILON = 1e-7


def unit(vectors: list[bytes]) -> np.ndarray:
    """Rows of length 1 in double precision."""
    found = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
    found = found / np.abs(found).max(axis=1, keepdims=True)
    return found / np.sqrt((found * found).sum(axis=1, keepdims=True))


def clusters(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Middles of at most ``k`` clusters by cosine."""
    rnd = np.random.default_rng(7)
    middles = x[rnd.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ middles.T).argmax(axis=1)
        sums = np.zeros_like(middles)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1)
        middles = sums[size > 1e-9] / size[size > 1e-9, None]
    return middles


def tight_groups(x: np.ndarray, cosine: float, least: int) -> np.ndarray:
    """Middles with at least ``least`` rows within half the limit's angle of them."""
    half = math.cos(math.acos(cosine) / 2)
    left, found = np.ones(len(x), bool), []
    near = np.concatenate([((x[i : i + 500] @ x.T) >= cosine).sum(axis=1) for i in range(0, len(x), 500)])
    for i in np.argsort(-near, kind="stable"):
        if near[i] < least:
            break
        if not left[i]:
            continue
        close = left & (x @ x[i] >= cosine)
        middle = x[close].sum(axis=0)
        middle /= np.linalg.norm(middle)
        inside = left & (x @ middle >= half)
        left &= ~(inside | close)
        if inside.sum() >= least:
            found.append(middle)
    return np.array(found).reshape(-1, x.shape[1])


def angle(x: np.ndarray, middles: np.ndarray) -> np.ndarray:
    """Angles in a form that is exact for small ones too."""
    out = np.empty((len(x), len(middles)))
    for j, m in enumerate(middles):
        out[:, j] = 2 * np.arctan2(np.linalg.norm(x - m, axis=1), np.linalg.norm(x + m, axis=1))
    return out


class Graph:
    """A flat graph over distinct unit vectors."""

    def __init__(self, x: np.ndarray, lists: np.ndarray | None = None):
        self.x = x
        self.medoid = int((x @ x.sum(axis=0)).argmax()) if len(x) else 0
        self.lists = np.full((len(x), DEGREE), -1, np.int64) if lists is None else lists

    def greedy(self, q: np.ndarray, floor: float = np.inf) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """The nodes of each query's beam, what it has seen, and of that rows, nodes and cosines from ``floor`` on."""
        n, width = len(q), self.lists.shape[1]
        seen = np.zeros((n, len(self.x)), bool)
        beam, cosines = np.full((n, BEAM), -1, np.int64), np.full((n, BEAM), -np.inf)
        done = np.ones((n, BEAM), bool)
        beam[:, 0], cosines[:, 0], done[:, 0], seen[:, self.medoid] = self.medoid, q @ self.x[self.medoid], False, True
        active = np.arange(n)
        met = [(active[cosines[:, 0] >= floor], beam[cosines[:, 0] >= floor, 0], cosines[cosines[:, 0] >= floor, 0])]
        while len(active):
            order = np.argsort(done[active], axis=1, kind="stable")[:, :WIDTH]  # beams are sorted, so the best open ones
            open_ = ~np.take_along_axis(done[active], order, 1)
            chosen = np.where(open_, np.take_along_axis(beam[active], order, 1), -1)
            flags = done[active]
            np.put_along_axis(flags, order, True, 1)
            near = self.lists[chosen].reshape(len(active), WIDTH * width)
            near[np.repeat(chosen < 0, width, axis=1)] = -1
            row = np.repeat(np.arange(len(active)), near.shape[1]).reshape(near.shape)
            fresh = (near >= 0) & ~seen[active[row], near]
            # One node may stand in several lists of a row.
            flat = ordered(row[fresh] * len(self.x) + near[fresh])
            r, node = flat // len(self.x), flat % len(self.x)
            seen[active[r], node] = True
            value = np.einsum("ij,ij->i", self.x[node], q[active[r]])
            met.append((active[r[value >= floor]], node[value >= floor], value[value >= floor]))
            place = np.arange(len(r)) - np.searchsorted(r, r)
            most = int(place.max()) + 1 if len(place) else 0
            more, more_cosines = np.full((len(active), most), -1, np.int64), np.full((len(active), most), -np.inf)
            more[r, place], more_cosines[r, place] = node, value
            nodes, values = np.concatenate([beam[active], more], 1), np.concatenate([cosines[active], more_cosines], 1)
            flags = np.concatenate([flags, more < 0], 1)
            best = np.argsort(-values, axis=1, kind="stable")[:, :BEAM]
            beam[active], cosines[active], done[active] = (np.take_along_axis(v, best, 1) for v in (nodes, values, flags))
            active = active[~done[active].all(axis=1)]
        return beam, seen, met

    def prune(self, points: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The lists of ``points`` chosen from the candidates ``near`` (-1: none), a bounded number at a time."""
        step = max(1, HELD // (near.shape[1] * self.x.shape[1]))
        return np.concatenate([self._pruned(points[i : i + step], near[i : i + step]) for i in range(0, len(points), step)] or [np.zeros((0, DEGREE), np.int64)])

    def _pruned(self, points: np.ndarray, near: np.ndarray) -> np.ndarray:
        near = np.where(near == points[:, None], -1, near)
        vectors = self.x[near]
        far = np.where(near < 0, np.inf, 1 - np.einsum("ijk,ik->ij", vectors, self.x[points]))
        order = np.argsort(far, axis=1, kind="stable")
        near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        vectors = np.take_along_axis(vectors, order[:, :, None], 1)
        alive, rows = np.isfinite(far), np.arange(len(points))
        out = np.full((len(points), DEGREE), -1, np.int64)
        for slot in range(DEGREE):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            out[:, slot] = np.where(some, near[rows, first], -1)
            between = 1 - np.einsum("ijk,ik->ij", vectors, vectors[rows, first])
            alive &= ALPHA * between > far
            alive[rows, first] = False
        return out

    def build(self) -> Graph:
        order = np.random.default_rng(11).permutation(len(self.x))
        order = np.concatenate([[self.medoid], order[order != self.medoid]]).astype(np.int64)
        at = 1
        while at < len(order):
            batch = order[at : at + min(at, 256)]
            at += len(batch)
            beam, _, _ = self.greedy(self.x[batch])
            self.lists[batch] = self.prune(batch, beam)
            source = np.repeat(batch, DEGREE)
            target = self.lists[batch].reshape(-1)
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            touched, first, count = np.unique(target, return_index=True, return_counts=True)
            # Many that link to one node are added some at a time.
            for some in range(0, int(count.max(initial=0)), DEGREE):
                rows = np.flatnonzero(count > some)
                wide = np.full((len(rows), DEGREE), -1, np.int64)
                for j in range(DEGREE):
                    has = count[rows] > some + j
                    wide[has, j] = source[first[rows[has]] + some + j]
                own = self.lists[touched[rows]]
                wide = np.where((wide[:, :, None] == own[:, None, :]).any(axis=2), -1, wide)
                both = np.concatenate([own, wide], 1)
                fits = (both >= 0).sum(axis=1) <= DEGREE
                packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :DEGREE]
                packed[~fits] = self.prune(touched[rows[~fits]], both[~fits])
                self.lists[touched[rows]] = packed
        self.link_back()
        return self

    def link_back(self) -> None:
        """Widens the lists so that each node stands in several: those of its neighbours that have the fewest such nodes."""
        size, more = np.zeros(len(self.x), np.int64), [[] for _ in range(len(self.x))]
        for point, own in enumerate(self.lists):
            own = own[own >= 0]
            for node in own[np.argsort(size[own], kind="stable")[:BACK]]:
                more[node].append(point)
                size[node] += 1
        wide = np.full((len(self.x), int(size.max(initial=0))), -1, np.int64)
        for node, some in enumerate(more):
            wide[node, : len(some)] = some
        step = max(1, HELD // (DEGREE * max(1, wide.shape[1])))
        for i in range(0, len(wide), step):
            known = (wide[i : i + step, :, None] == self.lists[i : i + step, None, :]).any(axis=2)
            wide[i : i + step][known] = -1
        self.lists = np.concatenate([self.lists, wide], 1)

    def within(self, q: np.ndarray, cosine: float) -> np.ndarray:
        """Which nodes are found in range of each query."""
        out = np.zeros((len(q), len(self.x)), bool)
        for at, found in self.slices(q, cosine):
            out[at : at + len(found)] = found
        return out

    def slices(self, q: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
        """The same for one slice of the queries after another, with its start: a greedy search, then expansion within the range."""
        step = max(1, HELD // self.lists.shape[1])
        for at in range(0, len(q) if len(self.x) else 0, ASKING):
            some = q[at : at + ASKING]
            _, seen, met = self.greedy(some, cosine - SLACK)
            rows, nodes, value = (np.concatenate(v) for v in zip(*met))
            found = np.zeros((len(some), len(self.x)), bool)
            found[rows, nodes] = value >= cosine
            while len(rows):
                more = []
                for i in range(0, len(rows), step):
                    near = self.lists[nodes[i : i + step]]
                    r = np.repeat(rows[i : i + step], near.shape[1])[near.reshape(-1) >= 0]
                    near = near.reshape(-1)[near.reshape(-1) >= 0]
                    fresh = ~seen[r, near]
                    flat = ordered(r[fresh] * len(self.x) + near[fresh])
                    r, near = flat // len(self.x), flat % len(self.x)
                    seen[r, near] = True
                    part = max(1, HELD // self.x.shape[1])
                    value = np.concatenate([np.einsum("ij,ij->i", self.x[near[j : j + part]], some[r[j : j + part]]) for j in range(0, len(r), part)] or [np.zeros(0)])
                    found[r, near] = value >= cosine
                    more.append((r[value >= cosine - SLACK], near[value >= cosine - SLACK]))
                rows, nodes = (np.concatenate(v) for v in zip(*more))
            yield at, found


def distinct(vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct unit vectors, and which of them each row has."""
    place: dict[bytes, int] = {}
    of = np.array([place.setdefault(v, len(place)) for v in vectors], np.int64)
    return (unit(list(place)) if place else np.zeros((0, 1))), of


def labelled(embeddings: DataFrame) -> DataFrame:
    """``rid, id, key, vec``: a number for each row; ``key`` (label and length) is null where nothing is compared."""
    v = F.col("embedding").cast(T.ArrayType(T.DoubleType()))
    bad = "x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')"
    usable = F.expr(f"size(v) > 0 AND NOT exists(v, {bad}) AND exists(v, x -> x <> 0)") & F.col("id").isNotNull() & F.col("label").isNotNull()
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    keyed = rows.withColumn("key", F.when(usable, F.concat_ws("/", F.size("v"), "label")))
    packed = keyed.select(F.monotonically_increasing_id().alias("rid"), "id", "key", F.when(F.col("key").isNotNull(), F.col("v")).alias("v"))

    def run(batches):
        for batch in batches:
            vec = [None if x is None else np.array(x, "<f8").tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(vec, pa.binary())], names=["rid", "id", "key", "vec"])

    return packed.mapInArrow(run, "rid long, id long, key string, vec binary")


_DEALT = "kind int, rid long, id long, vec binary, shard string, hub string, alpha double"
#: Kinds of dealt rows.
MEMBER, INSIDE, NEAR = 0, 1, 2


def deal(rows: DataFrame, cosine: float, overlap: float, first: bool) -> DataFrame:
    """Rows of ``rid, id, vec, shard`` dealt to clusters of their shard; at ``first`` tight groups are taken out.

    Clusters are fitted in one task for each shard, on a sample of about ``SAMPLE`` of its rows, and joined to
    salted parts of the shard, so no table of clusters is held whole anywhere.
    """
    theta = math.acos(cosine)
    counts = rows.groupBy("shard").agg(F.count("*").alias("rows"))
    sized = rows.join(counts, "shard")
    chance = F.pmod(F.xxhash64("rid"), F.lit(1_000_003)) < F.lit(1_000_003.0 * SAMPLE) / F.col("rows")

    def fit(table: pa.Table) -> pa.Table:
        x = unit(table.column("vec").to_pylist())
        rows = table.column("rows")[0].as_py()
        tight = tight_groups(x, cosine, max(24, int(TIGHT_SHARE * len(x)))) if first else x[:0]
        rest = x[(angle(x, tight) > theta / 2).all(axis=1)] if len(tight) else x
        k = min(CLUSTERS, -(-rows * len(rest) // (CELL * len(x))))
        middles = clusters(rest, k) if k > 1 else rest[:0]
        return pa.table([[table.column("shard")[0].as_py()], [middles.tobytes()], [tight.tobytes()], [rows]], schema=pa.schema([("shard", pa.string()), ("middles", pa.binary()), ("tight", pa.binary()), ("rows", pa.int64())]))

    fitted = sized.filter(chance).select("shard", "vec", "rows").groupBy("shard").applyInArrow(fit, "shard string, middles binary, tight binary, rows long")
    salts = F.greatest(F.lit(1), F.ceil(F.col("rows") / SALTED)).cast("int")
    fitted = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("shard", "salt", "middles", "tight")
    parts = sized.withColumn("salt", F.pmod(F.xxhash64("rid", F.lit("salt")), salts).cast("int")).select("shard", "salt", "rid", "id", "vec")

    def place(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        shard, out = key[0].as_py(), []
        rids, ids, vecs = (table.column(c).to_pylist() for c in ("rid", "id", "vec"))
        for at in range(0, len(vecs), 5_000):
            x = unit(vecs[at : at + 5_000])
            middles, tight = (np.frombuffer(told.column(c)[0].as_py(), "<f8").reshape(-1, x.shape[1]) if told.num_rows else x[:0] for c in ("middles", "tight"))
            far = angle(x, tight)
            own = np.where((far <= theta / 2 - EPSILON).any(axis=1), far.argmin(axis=1), -1) if len(tight) else np.full(len(x), -1)
            near = far <= 1.5 * theta + EPSILON
            cosines = x @ middles.T
            order = np.argsort(-cosines, axis=1, kind="stable")[:, :2]
            for i in range(len(x)):
                about = (rids[at + i], ids[at + i], vecs[at + i])
                hub = f"{shard}!{own[i]}" if own[i] >= 0 else None
                if hub:
                    out.append((INSIDE, *about, None, hub, float(far[i, own[i]])))
                elif not len(middles):
                    out.append((MEMBER, *about, shard, None, None))
                else:
                    out.append((MEMBER, *about, f"{shard}.{order[i, 0]}", None, None))
                    if len(middles) > 1 and cosines[i, order[i, 1]] >= cosines[i, order[i, 0]] - overlap:
                        out.append((MEMBER, *about, f"{shard}.{order[i, 1]}", None, None))
                for j in np.flatnonzero(near[i]):
                    if j != own[i]:
                        out.append((NEAR, *about, hub, f"{shard}!{j}", float(far[i, j])))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.float64())
        names = [f.split()[0] for f in _DEALT.split(", ")]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return parts.groupBy("shard", "salt").cogroup(fitted.groupBy("shard", "salt")).applyInArrow(place, _DEALT)


def shards(rows: DataFrame, cosine: float, overlap: float) -> DataFrame:
    """``rid, id, vec, shard`` after splitting shards above a cell's size again."""
    done = None
    for _ in range(LEVELS - 1):
        sizes = rows.groupBy("shard").agg(F.count("*").alias("rows"))
        large = stage(sizes.filter(F.col("rows") > BLOCK).select("shard"), "large")
        if large.isEmpty():
            break
        small = rows.join(large, "shard", "left_anti").select("rid", "id", "vec", "shard")
        done = small if done is None else done.unionByName(small)
        rows = stage(deal(rows.join(large, "shard", "left_semi"), cosine, overlap, False).select("rid", "id", "vec", "shard"), "split")
    rows = rows.select("rid", "id", "vec", "shard")
    # A vector may come to one shard on two ways only if clusters were split; once is enough.
    return rows if done is None else done.unionByName(rows).dropDuplicates(["rid", "shard"])


def build_lists(own: DataFrame) -> DataFrame:
    """``rid, list``: packed numbers of the neighbours of each vector, joined over its cells."""

    def run(table: pa.Table) -> pa.Table:
        x, of = distinct(table.column("vec").to_pylist())
        rid = table.column("rid").to_numpy()
        speaks = np.zeros(len(x), np.int64)
        speaks[of[::-1]] = rid[::-1]
        graph = Graph(x).build()
        lists = [speaks[near[near >= 0]].tobytes() for near in graph.lists]
        return pa.table([pa.array(speaks), pa.array(lists, pa.binary())], names=["rid", "list"])

    built = own.select("cell", "rid", "vec").groupBy("cell").applyInArrow(run, "rid long, list binary")
    return built.groupBy("rid").agg(F.collect_list("list").alias("lists"))


_FOUND = "rid long, n long, a long, b long"


def search(cells: DataFrame, cosine: float) -> DataFrame:
    """``rid, n`` (links counted in a cell) and ``a, b`` (links that span what is linked there).

    ``cells`` has ``cell, role, rid, rep, vec, shard, shards, lists``. Roles: 0 is in the cell and searched for
    there; 1 is searched for, and counts for both; 2 is searched for and counts for itself; 3 is in the cell only.
    """

    def run(table: pa.Table) -> pa.Table:
        role, rid, rep = (table.column(c).to_numpy() for c in ("role", "rid", "rep"))
        vec, here = table.column("vec").to_pylist(), table.column("shard")[0].as_py()
        inside = np.flatnonzero((role == 0) | (role == 3))
        asking = np.flatnonzero((role == 1) | (role == 2))
        x, of = distinct([vec[i] for i in inside])
        number = {int(r): int(n) for r, n in zip(rid[inside], of)}
        near: list[set[int]] = [set() for _ in range(len(x))]
        for i, node in zip(inside.tolist(), of.tolist()):
            for data in table.column("lists")[i].as_py() or []:
                near[node].update(number[r] for r in np.frombuffer(data, "<i8").tolist() if r in number)
        width = max([1, *map(len, near)])
        lists = np.full((len(x), width), -1, np.int64)
        for node, some in enumerate(near):
            some.discard(node)
            lists[node, : len(some)] = sorted(some)
        graph = Graph(x, lists)
        # Which shards a row is in; a pair counts in the first that both are in.
        sets: dict[tuple, int] = {}
        kind = np.array([sets.setdefault(tuple(s or []), len(sets)) for s in table.column("shards").to_pylist()], np.int64)
        shards = [set(p) for p in sets]
        counts: dict[int, bool] = {}

        def counted(one: np.ndarray, other: np.ndarray) -> np.ndarray:
            codes, at = np.unique(one * len(sets) + other, return_inverse=True)
            for c in codes.tolist():
                if c not in counts:
                    p, q = shards[c // len(sets)], shards[c % len(sets)]
                    counts[c] = not p or not q or min(p & q, default=None) == here
            return np.array([counts[c] for c in codes.tolist()], bool)[at]

        # Rows that are alike: one vector and the same shards. Those of a vector stand together.
        alike, of_row, rows = np.unique(of * len(sets) + kind[inside], return_inverse=True, return_counts=True)
        vector, alike_kind = alike // len(sets), alike % len(sets)
        first, size = np.searchsorted(vector, np.arange(len(x) + 1)), np.bincount(vector, minlength=len(x))
        sums = np.zeros(len(alike), np.int64)
        total = np.zeros(len(rid), np.int64)
        above = np.arange(len(x) + len(asking))

        def rows_of(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For each of some vectors the places of its alike rows, and which of the vectors they are of."""
            which = np.repeat(np.arange(len(nodes)), size[nodes])
            return first[nodes[which]] + np.arange(len(which)) - (np.cumsum(size[nodes]) - size[nodes])[which], which

        def link(one: np.ndarray, other: np.ndarray) -> None:
            """What is linked gets the smallest number; ``above`` holds what was linked before."""
            nonlocal above
            one, other = above[one], above[other]
            low = np.arange(len(above))
            while True:
                was = low.copy()
                np.minimum.at(low, one, was[other])
                np.minimum.at(low, other, was[one])
                low = low[low]
                if (low == was).all():
                    break
            above = low[above]

        if (role == 0).any():
            found = graph.within(x, cosine)
            found |= found.T
            np.fill_diagonal(found, True)
            for at in range(0, len(x), ASKING):
                one, other = np.nonzero(found[at : at + ASKING])
                one += at
                link(one, other)
                mine, pair = rows_of(one)
                theirs, which = rows_of(other[pair])
                mine = mine[which]
                np.add.at(sums, mine, np.where(counted(alike_kind[mine], alike_kind[theirs]), rows[theirs], 0))
            sums -= counted(alike_kind, alike_kind)
        if len(asking):
            asks = kind[asking]
            both = role[asking] == 1
            for at, some in graph.slices(unit([vec[i] for i in asking]), cosine):
                one, other = np.nonzero(some)
                one += at
                link(one + len(x), other)
                theirs, which = rows_of(other)
                one = one[which]
                good = counted(asks[one], alike_kind[theirs])
                np.add.at(total, asking[one], np.where(good, rows[theirs], 0))
                np.add.at(sums, theirs, good & both[one])
        total[inside] = sums[of_row]
        node = np.zeros(len(rid), np.int64)
        node[inside], node[asking] = of, np.arange(len(asking)) + len(x)
        speaks = np.zeros(len(above), np.int64)
        speaks[node[::-1]] = rep[::-1]
        top = speaks[above[node]]
        linked = top != rep
        some = np.flatnonzero((total > 0) | linked)
        none = ~linked[some]
        out = [pa.array(rid[some]), pa.array(total[some]), pa.array(top[some], mask=none), pa.array(rep[some], mask=none)]
        return pa.table(out, names=["rid", "n", "a", "b"])

    return cells.groupBy("cell").applyInArrow(run, _FOUND)


def linked(vectors: DataFrame, cosine: float = COSINE, overlap: float = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """``rid, n_links`` and ``rid, component`` of the rows of a staged ``labelled`` that link with others."""
    theta = math.acos(cosine)
    start = vectors.filter("key IS NOT NULL").select("rid", "id", "vec", F.col("key").alias("shard"))
    dealt = stage(deal(start, cosine, overlap, True), "dealt")
    members = stage(shards(dealt.filter(F.col("kind") == MEMBER), cosine, overlap), "members")
    # Tight groups: size, radius, smallest id.
    inside = dealt.filter(F.col("kind") == INSIDE).select("rid", "id", "vec", "hub", "alpha")
    hubs = stage(inside.groupBy("hub").agg(F.count("*").alias("size"), F.max("alpha").alias("rho"), F.min("id").alias("low")), "hubs")
    near = dealt.filter(F.col("kind") == NEAR).select("rid", "id", "vec", F.col("shard").alias("own"), "hub", "alpha")
    own = hubs.select(F.col("hub").alias("own"), F.col("low").alias("own_low"))
    near = near.join(hubs, "hub").join(own, "own", "left").withColumn("rep", F.coalesce("own_low", "id"))
    whole = F.col("alpha") + F.col("rho") <= theta - EPSILON
    near = stage(near.filter(F.col("alpha") - F.col("rho") <= theta + EPSILON).withColumn("whole", whole), "near-groups")
    band = near.filter(~F.col("whole"))
    # Cells of shards.
    sizes = members.groupBy("shard").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sets = members.groupBy("rid").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    block = F.pmod(F.xxhash64("rid", F.lit("block")), F.col("blocks")).cast("int")
    # What is searched for in a cell goes to parts of bounded size, the cell's own rows to each of them.
    cell = F.concat_ws("#", "shard", "block", "part")
    asking = F.greatest(F.lit(1), F.ceil(F.col("block") * F.col("rows") / F.col("blocks") / ASKED)).cast("int")
    part = F.pmod(F.xxhash64("rid", F.lit("part")), F.col("parts")).cast("int")
    every = F.explode(F.expr("sequence(0, parts - 1)"))
    member = members.join(sizes, "shard").join(sets, "rid").withColumn("block", block).withColumn("rep", F.col("id"))
    columns = ["cell", "part", "role", "rid", "rep", "vec", "shard", "shards"]
    held = member.withColumn("parts", asking).withColumn("part", every)
    held = held.withColumns({"cell": cell, "role": F.when(F.col("part") == 0, 0).otherwise(3)}).select(columns)
    later = member.filter("block < blocks - 1").withColumn("block", F.explode(F.expr("sequence(block + 1, blocks - 1)")))
    asked = later.withColumn("parts", asking).withColumn("part", part).withColumns({"cell": cell, "role": F.lit(1)}).select(columns)
    # Cells of tight groups that something in their band is compared with.
    wanted = band.groupBy("hub").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    groups = hubs.join(wanted, "hub").select("hub", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), "parts", "low")
    no_sets = F.lit(None).cast("array<string>")
    tight = inside.join(groups, "hub").withColumns({"block": block, "shard": F.col("hub"), "shards": no_sets, "rep": F.col("low"), "role": F.lit(3)})
    tight = tight.withColumn("part", every).withColumn("cell", cell).select(columns)
    aside = band.join(groups.select("hub", "blocks", "parts"), "hub").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    aside = aside.withColumns({"part": part, "shard": F.col("hub"), "shards": no_sets, "role": F.when(F.col("own").isNull(), 1).otherwise(2)})
    aside = aside.withColumn("cell", cell).select(columns)
    graph = held.unionByName(tight)
    lists = build_lists(graph.filter("part = 0"))
    table = graph.join(lists, "rid", "left").unionByName(asked.unionByName(aside).withColumn("lists", F.lit(None).cast("array<binary>")))
    found = stage(search(table.drop("part"), cosine), "found")
    # Links with whole groups, and within them.
    per_hub = near.filter("whole AND own IS NULL").groupBy("hub").agg(F.count("*").alias("more"))
    within = inside.select("rid", "hub").join(hubs.join(per_hub, "hub", "left").select("hub", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n")), "hub")
    n = found.select("rid", "n").unionByName(within.select("rid", "n")).unionByName(near.filter("whole").select("rid", F.col("size").alias("n")))
    counts = n.groupBy("rid").agg(F.sum("n").alias("n_links"))
    links = found.filter("a IS NOT NULL").select("a", "b").unionByName(near.filter("whole").select(F.col("low").alias("a"), F.col("rep").alias("b")).filter("a <> b"))
    at = components(links.distinct())
    reps = inside.join(hubs, "hub").select("rid", F.col("low").alias("id"))
    return counts, reps.unionByName(members.select("rid", "id").distinct()).join(at, "id", "left").select("rid", F.coalesce("component", "id").alias("component"))


def recall(vectors: DataFrame, counts: DataFrame, cosine: float = COSINE, audit: int = AUDIT) -> float:
    """Of the links of a fixed set of vectors (those with the smallest hashes), the share that was found."""
    asked = vectors.filter("key IS NOT NULL").orderBy(F.xxhash64("rid"), "rid").limit(audit).select("rid", "key", "vec")
    sent = [(r["rid"], r["key"], bytes(r["vec"])) for r in asked.collect()]
    by: dict[str, list] = {}
    for r, key, vec in sent:
        by.setdefault(key, []).append((r, vec))

    def run(batches):
        queries = {key: (np.array([r for r, _ in some]), unit([v for _, v in some])) for key, some in by.items()}
        sums = {r: 0 for r, _, _ in sent}
        for batch in batches:
            keys = np.array(batch.column(1).to_pylist())
            for key, (rids, q) in queries.items():
                rows = np.flatnonzero(keys == key)
                if len(rows):
                    vec = batch.column(2).take(pa.array(rows)).to_pylist()
                    other = batch.column(0).take(pa.array(rows)).to_numpy()
                    links = (unit(vec) @ q.T >= cosine) & (other[:, None] != rids[None, :])
                    for r, n in zip(rids.tolist(), links.sum(axis=0).tolist()):
                        sums[r] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["rid", "truth"])

    truth = vectors.filter("key IS NOT NULL").select("rid", "key", "vec").mapInArrow(run, "rid long, truth long").groupBy("rid").agg(F.sum("truth").alias("truth"))
    row = truth.join(counts, "rid", "left").select(F.sum("truth"), F.sum(F.least("truth", F.coalesce("n_links", F.lit(0))))).first()
    return row[1] / row[0] if row[0] else 1.0


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    vectors = stage(labelled(embeddings), "vectors")
    overlap = OVERLAP
    while True:
        counts, at = linked(vectors, cosine, overlap)
        counts = stage(counts, "counts")
        # From an overlap of 2 on every vector goes to two clusters of each split; more is not to be had this way.
        if recall(vectors, counts, cosine) >= LEAST_RECALL or overlap > 2:
            break
        overlap *= 4
    first = at.join(vectors.select("rid", "id"), "rid").groupBy("id").agg(F.min("component").alias("component"))
    out = vectors.select("rid", "id").join(counts, "rid", "left").join(first, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
