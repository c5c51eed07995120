"""Similarity clusters: NN-descent graph, modularity communities, clusters as unions of linked communities.

The neighbour graph comes from NN-descent (``nngraph``): inside leaves on arrays, between leaves in rounds of Spark
joins. Its edges within the link distance, weighted by closeness, are grouped into communities by modularity (local moving
and aggregation): first inside leaves, then, for groups of several leaves, over the graph of all their communities in rounds of
joins. Communities joined by an edge of the graph form a cluster. Links that the approximate graph missed are then found
exactly (by cells of points that are all linked) and join clusters further; their number is reported. Leaves follow from
counts, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.leaves import CAP, LEAF, leaves_box, with_leaves
from pointloom.llm.nngraph import LIST, across_leaves, landmarks, leaf_points, nn_descent, valid_points
from pointloom.operators.graph import connected_components
from pointloom.session import materialize, release

DEGREE, TURNS, LEVELS, CHUNK = 10, 16, 8, 1024


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component."""
    lab = np.arange(n)
    while len(i):
        a, b = lab[i], lab[j]
        m = np.minimum(a, b)
        np.minimum.at(lab, a, m)
        np.minimum.at(lab, b, m)
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
        open_ = lab[i] != lab[j]
        i, j = i[open_], j[open_]
    return lab


def _sorted_keys(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of at most ``bits`` bits in order and the stable order itself: one sort of plain numbers where both fit into one."""
    low = len(key).bit_length()
    if bits + low < 64:
        both = np.sort(key << low | np.arange(len(key)))
        return both >> low, both & ((1 << low) - 1)
    order = np.argsort(key, kind="stable")
    return key[order], order


def _starts(values: np.ndarray) -> np.ndarray:
    """Places where a run of equal values begins."""
    begins = np.empty(len(values), bool)
    begins[:1] = True
    np.not_equal(values[1:], values[:-1], out=begins[1:])
    return begins.nonzero()[0]


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1 … of ``count`` each, one after the other."""
    end = count.cumsum()
    return np.arange(end[-1] if len(end) else 0) + (start - end + count).repeat(count)


def communities(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, passes: int = 24, levels: int = 12) -> np.ndarray:
    """Communities of high modularity, until no node or community gains by a move; isolated nodes stay alone."""
    member = np.arange(n)
    loops = np.zeros(n)
    for _ in range(levels):
        size, bits = len(loops), len(loops).bit_length()
        src, dst, ww = np.r_[i, j], np.r_[j, i], np.r_[w, w]
        strength = np.bincount(src, ww, size) + 2 * loops
        total = strength.sum()
        if total <= 0:
            break
        order = _sorted_keys(src, bits)[1]
        dst, ww = dst[order], ww[order]
        degree = np.bincount(src, minlength=size)
        ptr = np.cumsum(degree) - degree
        half = (np.arange(size) * 2654435761 >> 7) % 2
        c = np.arange(size)
        live = np.ones(size, bool)
        for turn in range(passes):
            mass = np.bincount(c, strength, size)
            at = live.nonzero()[0]  # only where a neighbour moved can a node gain something new
            many = degree[at]
            edge = _runs(ptr[at], many)
            if not len(edge):
                break
            key, order = _sorted_keys((at << bits).repeat(many) | c[dst[edge]], 2 * bits)
            start = _starts(key)
            pull = np.add.reduceat(ww[edge[order]], start)
            key = key[start]
            s, cc = key >> bits, key & ((1 << bits) - 1)
            home, own = cc == c[s], strength[s]
            gain = pull - own * (mass[cc] - home * own) / total
            first = _starts(s)
            node, own = s[first], own[first]
            stay = -own * (mass[c[node]] - own) / total
            best = np.maximum.reduceat(gain, first)
            home = home.nonzero()[0]  # at most one place a node
            stay[np.searchsorted(first, home, "right") - 1] = gain[home]
            better = (best > stay + 1e-12).nonzero()[0]
            if not len(better):
                break
            # half of the nodes move at a time, else neighbours swap places for ever
            move = half[node[better]] == turn % 2
            live = np.zeros(size, bool)
            live[node[better[~move]]] = True
            move = better[move]
            went, lo, hi = node[move], first[move], np.append(first, len(s))[move + 1]
            # the smallest of the best communities
            run = _runs(lo, hi - lo)
            run = run[gain[run] == best[move].repeat(hi - lo)]
            c[went] = cc[run[_starts(s[run])]]
            live[dst[_runs(ptr[went], degree[went])]] = True
        _, c = np.unique(c, return_inverse=True)
        if c.max() + 1 == size:
            break
        member = c[member]
        a, b = c[i], c[j]
        inner = a == b
        loops = np.bincount(c, loops, c.max() + 1) + np.bincount(a[inner], w[inner], c.max() + 1)
        lo, hi = np.minimum(a, b)[~inner], np.maximum(a, b)[~inner]
        key, inv = np.unique(lo * len(loops) + hi, return_inverse=True)
        i, j, w = key // len(loops), key % len(loops), np.bincount(inv, w[~inner], len(key)) if len(key) else np.zeros(0)
    return member


def linked_pairs(x: np.ndarray, lab: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points at most ``eps`` apart that join different labels: enough to connect all linked labels.

    Cells are so small that points of one cell are linked; pairs of cells whose labels differ are tested."""
    x = x.astype(np.float64)
    side = _side(eps)
    cell = np.floor((x - x.min(axis=0)) / side).astype(np.int64)
    for c in range(3):  # wide gaps between cells shrink, so that three numbers fit into one
        at, inv = np.unique(cell[:, c], return_inverse=True)
        cell[:, c] = np.r_[0, np.cumsum(np.minimum(np.diff(at), 4))][inv] + 3
    pack = (cell[:, 0] << 42) | (cell[:, 1] << 21) | cell[:, 2]
    order = np.argsort(pack, kind="stable")
    keys, start, count = np.unique(pack[order], return_index=True, return_counts=True)
    i, j = [order[np.repeat(start, count)]], [order]  # each point with its cell's first one
    lab = components(int(lab.max()) + 1, lab[i[0]], lab[j[0]])[lab]
    lo_lab = np.minimum.reduceat(lab[order], start)  # one label a cell from here on
    for dx in range(0, 3):
        for dy in range(-2, 3):
            for dz in range(-2, 3):
                if (dx, dy, dz) <= (0, 0, 0) or max(abs(dx) - 1, 0) ** 2 + max(abs(dy) - 1, 0) ** 2 + max(abs(dz) - 1, 0) ** 2 > 3:
                    continue
                want = keys + ((dx << 42) + (dy << 21) + dz)
                at = np.searchsorted(keys, want)
                at[at == len(keys)] = 0
                a = np.flatnonzero((keys[at] == want) & (lo_lab[at] != lo_lab))
                if not len(a):
                    continue
                b = at[a]
                large = count[a] * count[b] > CHUNK
                for p, q in zip(a[large].tolist(), b[large].tolist(), strict=True):
                    u, v = order[start[p] : start[p] + count[p]], order[start[q] : start[q] + count[q]]
                    hit = _first_link(x, u, v, eps)
                    if hit:
                        i.append(np.array([hit[0]]))
                        j.append(np.array([hit[1]]))
                a, b = a[~large], b[~large]
                for lo in range(0, len(a), CHUNK):  # small cells by the thousand
                    u, v = _first_links(x, order, start[a[lo : lo + CHUNK]], count[a[lo : lo + CHUNK]], start[b[lo : lo + CHUNK]], count[b[lo : lo + CHUNK]], eps)
                    i.append(u)
                    j.append(v)
    return np.concatenate(i), np.concatenate(j)


def _first_link(x: np.ndarray, u: np.ndarray, v: np.ndarray, eps: float) -> tuple[int, int] | None:
    for lo in range(0, len(u), 1024):
        for at in range(0, len(v), 1024):
            d = x[u[lo : lo + 1024], None] - x[None, v[at : at + 1024]]
            k = np.flatnonzero((d * d).sum(axis=2) <= eps * eps)
            if len(k):
                r, c = np.unravel_index(k[0], d.shape[:2])
                return int(u[lo + r]), int(v[at + c])
    return None


def _first_links(x: np.ndarray, order: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, n: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """``_first_link`` of many pairs of cells: ``m`` places of ``order`` from ``p`` on with ``n`` from ``q`` on."""
    u = _runs(p, m)
    wide = np.repeat(n, m)
    u, v = order[np.repeat(u, wide)], order[_runs(np.repeat(q, m), wide)]
    d = x[u] - x[v]
    k = np.flatnonzero((d * d).sum(axis=1) <= eps * eps)
    k = k[_starts(np.repeat(np.arange(len(m)), m * n)[k])]
    return u[k], v[k]


def _side(eps: float) -> float:
    """Side of a cell whose points are all linked."""
    return eps / np.sqrt(3) * 0.9999


_NODES = "array<struct<node:bigint,size:bigint>>"
_LOOSE = "array<struct<a:bigint,b:bigint,ca:bigint,cb:bigint,w:double>>"
_STATS = "array<struct<c:bigint,strength:double>>"
_BORDER = "array<struct<node:bigint,x:double,y:double,z:double>>"
_RIM = f"array<struct<id:bigint,open:boolean,community:bigint,node:bigint,vec:array<float>,nn:{LIST}>>"
_ROW = f"bid bigint, split boolean, repaired bigint, ids binary, part binary, com binary, degree binary, nodes {_NODES}, coms array<bigint>, loose {_LOOSE}, stats {_STATS}, border {_BORDER}, rim {_RIM}, beyond array<struct<id:bigint,vec:array<float>>>"


def _least(ids: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Smallest id of each label 0 … n."""
    out = np.full(int(lab.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, lab, ids)
    return out


def _in_leaf(eps: float) -> Callable[[pa.Table], dict]:
    def build(table: pa.Table) -> dict:
        ids, x, _, lo, hi = leaf_points(table)
        n = len(ids)
        x64 = x.astype(np.float64)
        nbr = nn_descent(x, DEGREE)
        i, j = np.repeat(np.arange(n), nbr.shape[1]), nbr.ravel().astype(np.int64)
        i, j = i[j >= 0], j[j >= 0]
        pair = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
        i, j = pair // n, pair % n
        d2 = ((x64[i] - x64[j]) ** 2).sum(axis=1)
        near = d2 <= eps * eps
        i, j, w = i[near], j[near], np.exp(-4 * d2[near] / (eps * eps))
        _, com = np.unique(communities(n, i, j, w), return_inverse=True)
        inside = com[i] == com[j]
        degree = np.bincount(i[inside], w[inside], n) + np.bincount(j[inside], w[inside], n)
        # clusters are unions of communities that an edge joins; the exact check joins what the graph missed
        lab = components(int(com.max()) + 1, com[i[~inside]], com[j[~inside]])[com]
        a, b = linked_pairs(x, lab, eps)
        parted = lab[a] != lab[b]
        _, first, lab = np.unique(lab, return_index=True, return_inverse=True)
        lab = components(n, np.r_[first[lab], a], np.r_[np.arange(n), b])
        _, part = np.unique(lab, return_inverse=True)
        node, name = _least(ids, part), _least(ids, com)
        split = bool(np.isfinite(lo).any() or not (lo < hi).all())
        row = {
            "bid": int(ids.min()), "split": split, "repaired": int(parted.sum()), "ids": ids.astype("<i8").tobytes(), "part": part.astype("<i4").tobytes(), "com": com.astype("<i4").tobytes(), "degree": degree.astype("<f4").tobytes(),
            "nodes": [{"node": m, "size": s} for m, s in zip(node.tolist(), np.bincount(part).tolist(), strict=True)], "coms": name.tolist(), "loose": [], "stats": [], "border": [], "rim": [], "beyond": [],
        }
        if split:
            strength = np.bincount(com[i], w, len(name)) + np.bincount(com[j], w, len(name))
            row["stats"] = [{"c": c, "strength": s} for c, s in zip(name.tolist(), strength.tolist(), strict=True)]
            out = ~inside
            row["loose"] = [dict(zip(("a", "b", "ca", "cb", "w"), r, strict=True)) for r in zip(ids[i[out]].tolist(), ids[j[out]].tolist(), name[com[i[out]]].tolist(), name[com[j[out]]].tolist(), w[out].tolist(), strict=True)]
            open_ = leaves_box(x64, np.full(n, eps * (1 + 1e-9)), lo, hi)
            rim = open_.copy()
            rim[landmarks(n)] = True
            rim[nbr[rim][nbr[rim] >= 0]] = True
            beyond = np.zeros(n, bool)
            beyond[nbr[rim][nbr[rim] >= 0]] = True
            row["beyond"] = [{"id": i, "vec": v} for i, v in zip(ids[beyond & ~rim].tolist(), x[beyond & ~rim].tolist(), strict=True)]
            row["border"] = [dict(zip(("node", "x", "y", "z"), (node[part[p]].item(), *x64[p].tolist()), strict=True)) for p in np.flatnonzero(open_)]
            for p in np.flatnonzero(rim):
                own = nbr[p][nbr[p] >= 0]
                far = ((x64[own] - x64[p]) ** 2).sum(axis=1)
                row["rim"].append({"id": int(ids[p]), "open": bool(open_[p]), "community": int(name[com[p]]), "node": int(node[part[p]]), "vec": x[p].tolist(), "nn": [{"d2": d, "id": k} for d, k in sorted(zip(far.tolist(), ids[own].tolist(), strict=True))]})
        return row

    return build


def _cross_links(border: DataFrame, eps: float) -> DataFrame:
    """a, b: nodes with points (grp, node, x, y, z) at most ``eps`` apart, enough to connect all that are linked.

    Points of one cell are all linked. Cells that differ in nodes are compared by pieces of at most ``CHUNK`` points, so that
    no task gets a crowded place whole."""
    side, cell = _side(eps), ["cx", "cy", "cz"]
    pts = border.distinct().withColumns({f"c{c}": F.floor(F.col(c) / side) for c in "xyz"})
    cells = materialize(pts.groupBy("grp", *cell).agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")), "cells")
    same = pts.select("grp", *cell, "node").distinct().join(cells, ["grp", *cell]).where("node <> a").select(F.col("node").alias("a"), F.col("a").alias("b"))
    reach = [s for s in product(range(-2, 3), repeat=3) if s > (0, 0, 0) and sum(max(abs(v) - 1, 0) ** 2 for v in s) <= 3]
    moved = F.explode(F.array(*[F.struct(*[(F.col(f"c{c}") + v).alias(f"c{c}") for c, v in zip("xyz", s, strict=True)]) for s in reach]))
    asks = cells.select("grp", F.struct(*cell).alias("p"), "a", "z", moved.alias("q")).select("grp", "p", F.col("a").alias("pa"), F.col("z").alias("pz"), "q.*")
    pairs = asks.join(cells, ["grp", *cell]).where(~((F.col("pa") == F.col("a")) & (F.col("pz") == F.col("z")) & (F.col("a") == F.col("z")))).select("grp", "p", F.struct(*cell).alias("q"), "pa", F.col("a").alias("qa"))
    chunk = F.pmod(F.xxhash64("x", "y", "z", "node"), F.ceil(F.col("n") / F.lit(CHUNK)))
    packed = pts.join(cells.select("grp", *cell, "n"), ["grp", *cell]).groupBy("grp", F.struct(*cell).alias("p"), chunk.alias("k")).agg(F.collect_list(F.array("x", "y", "z")).alias("us"))
    both = pairs.join(packed.drop("k"), ["grp", "p"]).join(packed.select("grp", F.col("p").alias("q"), F.col("us").alias("vs")), ["grp", "q"]).select("pa", "qa", "us", "vs")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for row in range(batch.num_rows):
                u, v = (np.array(batch.column(c)[row].as_py()) for c in ("us", "vs"))
                if any((((u[lo : lo + 256, None] - v[None]) ** 2).sum(axis=2) <= eps * eps).any() for lo in range(0, len(u), 256)):
                    hits.append(row)
            kept = batch.take(pa.array(hits, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("pa"), kept.column("qa")], ["a", "b"])

    return same.unionByName(both.mapInArrow(test, "a bigint, b bigint")).where("a <> b").distinct()


def _moved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """c, g: each node (c, grp, strength) with the community it ends in by local moving; ``edges``: a, b, w, both ways.
    Half of the nodes may move in a turn, by hash, else neighbours swap places for ever."""
    total = nodes.groupBy("grp").agg(F.sum("strength").alias("total"))
    place = nodes.join(total, "grp").select("c", "strength", "total", F.col("c").alias("g"))
    idle = 0
    for turn in range(TURNS):
        mass = place.groupBy("g").agg(F.sum("strength").alias("mass"))
        seen = edges.join(place.select(F.col("c").alias("b"), "g"), "b").select(F.col("a").alias("c"), "g", "w").unionByName(place.select("c", "g", F.lit(0.0).alias("w")))
        pulls = seen.groupBy("c", "g").agg(F.sum("w").alias("pull")).join(mass, "g").join(place.withColumnRenamed("g", "home"), "c")
        at_home = F.col("g") == F.col("home")
        gain = F.col("pull") - F.col("strength") * (F.col("mass") - F.when(at_home, F.col("strength")).otherwise(0.0)) / F.when(F.col("total") > 0, F.col("total"))
        gain = F.round(F.coalesce(gain, F.lit(0.0)), 12)  # sums come in any order
        best = pulls.groupBy("c", "strength", "total", "home").agg(F.max(F.struct(gain.alias("gain"), (-F.col("g")).alias("g"))).alias("m"), F.max(F.when(at_home, gain)).alias("stay"))
        goes = (F.col("m.gain") > F.col("stay") + 1e-11) & (F.pmod(F.xxhash64("c"), F.lit(2)) == turn % 2)
        last, place = place, materialize(best.select("c", "strength", "total", F.when(goes, -F.col("m.g")).otherwise(F.col("home")).alias("g"), goes.alias("went")), "moves")
        idle = idle + 1 if place.where("went").isEmpty() else 0
        place = place.drop("went") if idle < 2 else place
        if idle == 2:
            break
    return place.select("c", "g")


def joined_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """c, community: communities of high modularity over ``nodes`` (c, grp, strength) and ``edges`` (a, b, w; one way), named
    by their smallest node. Levels of local moving and aggregation until nothing merges."""
    nodes = materialize(nodes, "nodes")
    names = nodes.select("c", F.col("c").alias("community"))
    for _ in range(LEVELS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where("a <> b")
        both = materialize(both.groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
        went = _moved(nodes, both)
        named = materialize(went.join(went.groupBy("g").agg(F.min("c").alias("new")), "g").select("c", "new"), "named")
        if named.where("c <> new").isEmpty():
            break
        names = materialize(names.join(named.withColumnRenamed("c", "community"), "community").select("c", F.col("new").alias("community")), "names")
        nodes = materialize(nodes.join(named, "c").groupBy(F.col("new").alias("c"), "grp").agg(F.sum("strength").alias("strength")), "nodes")
        edges = both.where("a < b").join(named.select(F.col("c").alias("a"), F.col("new").alias("na")), "a").join(named.select(F.col("c").alias("b"), F.col("new").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "w")
    return names


class Clusters:
    """Clusters of one table of points; see ``members``, ``points``, ``described`` and ``repaired``.

    Two valid points of a group are linked if at most ``eps`` apart (squared differences in double); a cluster
    is a set connected by links with at least ``least`` points. Invalid points (null, NaN, infinite, all zero)
    belong to none, repeated rows count once, equal coordinates are linked; columns beyond group, id, x, y, z
    are ignored; empty tables give no rows.
    """

    def __init__(self, points: DataFrame, *, group: str, id: str, eps: float = 0.25, least: int = 15, cap: int = CAP):
        self.eps, self.least = eps, least
        self.gtype = gtype = points.schema[group].dataType.simpleString()
        rows = valid_points(points, id, group).select(F.col(group).alias("grp"), F.col(id).cast("bigint").alias("id"), *[F.col(c).cast("float").alias(c) for c in "xyz"])
        build = _in_leaf(eps)

        def leaf(key: tuple, table: pa.Table) -> pa.Table:
            return pa.Table.from_pylist([{"grp": key[0].as_py(), **build(table)}], schema=schema)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(f"grp {gtype}, {_ROW}"))
        self.leaves = materialize(with_leaves(rows, cap).groupBy(*LEAF).applyInArrow(leaf, f"grp {gtype}, {_ROW}"), "clusters")
        self.cut = self.leaves.where("split")
        self.split = not self.cut.isEmpty()
        self.edges = self._edges(cap) if self.split else None
        self.names = materialize(self._names(), "names")

    def _edges(self, cap: int) -> DataFrame:
        """Edges of the graph between leaves: a, b (points), ca, cb (communities), na, nb (nodes), w."""
        rim = self.cut.select("grp", F.explode("rim").alias("r")).select("grp", "r.*")
        beyond = self.cut.select(F.explode("beyond").alias("r")).select("r.*")
        state, _ = across_leaves(rim.drop("community", "node"), beyond, DEGREE, cap)
        near = state.select("id", F.explode("nn").alias("e")).where(F.col("e.d2") <= self.eps * self.eps).select(F.least("id", "e.id").alias("a"), F.greatest("id", "e.id").alias("b"), "e.d2").distinct()
        homes = self.cut.select("bid", F.explode("rim").alias("r")).select("bid", "r.id", "r.community", "r.node")
        side = lambda p: homes.select(F.col("id").alias(p), F.col("bid").alias(f"l{p}"), F.col("community").alias(f"c{p}"), F.col("node").alias(f"n{p}"))
        both = near.join(side("a"), "a").join(side("b"), "b").where("la <> lb")
        return materialize(both.select("a", "b", "ca", "cb", "na", "nb", F.exp(-4 * F.col("d2") / (self.eps * self.eps)).alias("w")), "edges")

    def _nodes(self) -> DataFrame:
        return self.leaves.select("bid", F.posexplode("nodes").alias("at", "n")).select("bid", "at", "n.node", "n.size")

    def _names(self) -> DataFrame:
        """bid, at, node, cluster_id, size for the parts of all clusters that are large enough."""
        parts = self._nodes()
        if not self.split:
            return parts.where(F.col("size") >= self.least).withColumn("cluster_id", F.col("node"))
        border = self.cut.select("grp", F.explode("border").alias("p")).select("grp", "p.*")
        self.cross = materialize(_cross_links(border, self.eps), "cross")
        links = self.edges.select(F.col("na").alias("a"), F.col("nb").alias("b"))
        whole = parts.join(connected_components(links.unionByName(self.cross)), "node", "left").withColumn("cluster_id", F.coalesce("component", "node"))
        sized = whole.groupBy("cluster_id").agg(F.sum("size").alias("n")).where(F.col("n") >= self.least)
        return whole.join(sized, "cluster_id").select("bid", "at", "node", "cluster_id", "size")

    def repaired(self) -> DataFrame:
        """One row: joins of communities that the graph's edges gave not, found by the exact check (joins: inside leaves, and
        links between leaves)."""
        inner = self.leaves.agg(F.coalesce(F.sum("repaired"), F.lit(0)).alias("inside"))
        across = self.cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct() if self.split else None
        if across is None:
            return inner.withColumn("across", F.lit(0).cast("bigint"))
        known = self.edges.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        return inner.crossJoin(across.join(known, ["a", "b"], "left_anti").agg(F.count("*").alias("across")))  # one row each

    def _expanded(self, renamed: DataFrame | None) -> DataFrame:
        names = self.names.groupBy("bid").agg(F.collect_list(F.struct("at", "cluster_id")).alias("names"))
        rows = self.leaves.select("grp", "bid", "ids", "part", "com", "degree", "coms").join(names, "bid")
        rows = rows.join(renamed, "bid", "left") if renamed is not None else rows.withColumn("renamed", F.lit(None).cast("array<struct<at:int,community:bigint>>"))

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    r = {c: batch.column(c)[row].as_py() for c in ("grp", "ids", "part", "com", "degree", "names", "coms", "renamed")}
                    part, com = np.frombuffer(r["part"], "<i4"), np.frombuffer(r["com"], "<i4")
                    table, large = np.zeros(int(part.max()) + 1, np.int64), np.zeros(int(part.max()) + 1, bool)
                    for x in r["names"]:
                        table[x["at"]], large[x["at"]] = x["cluster_id"], True
                    coms = np.array(r["coms"], np.int64)
                    for x in r["renamed"] or ():
                        coms[x["at"]] = x["community"]
                    on = large[part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r["grp"]] * int(on.sum()), batch.schema.field("grp").type),
                            pa.array(table[part][on]),
                            pa.array(np.frombuffer(r["ids"], "<i8")[on]),
                            pa.array(coms[com][on]),
                            pa.array(np.frombuffer(r["degree"], "<f4")[on].astype(np.float64)),
                        ],
                        ["grp", "cluster_id", "point_id", "community", "degree"],
                    )

        return rows.mapInArrow(expand, f"grp {self.gtype}, cluster_id bigint, point_id bigint, community bigint, degree double")

    def members(self) -> DataFrame:
        """cluster_id (smallest id in the cluster), point_id."""
        return self._expanded(None).select("cluster_id", "point_id")

    def points(self) -> DataFrame:
        """grp, cluster_id, point_id, community (smallest id in it), degree (weighted, inside the community)."""
        if not self.split:
            return self._expanded(None)
        loose = self.cut.select(F.explode("loose").alias("e")).select("e.*").unionByName(self.edges.select("a", "b", "ca", "cb", "w"))
        loose = materialize(loose, "loose")
        more = loose.where("ca <> cb").join(self.edges.select("a", "b"), ["a", "b"], "left_semi")
        ends = more.select(F.col("ca").alias("c"), "w").unionByName(more.select(F.col("cb").alias("c"), "w"))
        own = self.cut.select("grp", F.explode("stats").alias("s")).select("grp", "s.*")
        added = ends.groupBy("c").agg(F.sum("w").alias("w"))
        nodes = own.join(added, "c", "left").select("c", "grp", (F.col("strength") + F.coalesce("w", F.lit(0.0))).alias("strength"))
        finals = joined_communities(nodes, loose.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w"))
        place = self.cut.select("bid", F.posexplode("coms").alias("at", "c"))
        renamed = place.join(finals, "c").where(F.col("c") != F.col("community")).groupBy("bid").agg(F.collect_list(F.struct("at", "community")).alias("renamed"))
        inner = loose.join(finals.select(F.col("c").alias("ca"), F.col("community").alias("fa")), "ca").join(finals.select(F.col("c").alias("cb"), F.col("community").alias("fb")), "cb").where("fa = fb")
        gained = inner.select(F.explode(F.array("a", "b")).alias("point_id"), "w").groupBy("point_id").agg(F.sum("w").alias("w"))
        rows = self._expanded(renamed).join(gained, "point_id", "left")
        return rows.select("grp", "cluster_id", "point_id", "community", F.round(F.col("degree") + F.coalesce("w", F.lit(0.0)), 6).alias("degree"))

    def described(self, by: str = "cluster_id", typical: int = 3) -> DataFrame:
        """One row per cluster (or per community with ``by="community"``): size and the most typical points,
        those of highest weighted degree inside their community, of equal degrees the smaller id first."""
        top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "point_id"))), 1, typical)
        rank = Window.partitionBy("cluster_id", "community").orderBy(F.desc("degree"), "point_id")
        points = materialize(self.points(), "points")
        sizes = points.groupBy("grp", "cluster_id", "community").agg(F.count("*").alias("n"))
        # a few of each community only, so that no list grows with a community or cluster
        few = points.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= typical)
        if by == "community":
            lists = few.groupBy("cluster_id", "community").agg(F.transform(top, lambda s: s["point_id"]).alias("typical"))
            return sizes.join(lists, ["cluster_id", "community"]).select("grp", "cluster_id", "community", F.col("n").alias("size"), "typical")
        counts = sizes.groupBy("grp", "cluster_id").agg(F.sum("n").alias("size"), F.count("*").alias("communities"))
        rank = Window.partitionBy("cluster_id").orderBy(F.desc("degree"), "point_id")
        best = few.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= typical)
        lists = best.groupBy("cluster_id").agg(F.transform(top, lambda s: s["point_id"]).alias("typical"))
        return counts.join(lists, "cluster_id").select("grp", "cluster_id", "size", "communities", "typical")
