"""Neighbour graphs by NN-descent and greedy search over them, as rounds of Spark joins.

The graph is a table: a point, its vector and the list of its nearest points so far. A round lets the points of
every list meet at its owner, and those that list a point meet there too (an equi-join, then one shuffle by the
place of meeting); each is told of the others that are nearer than its last neighbour, and lists take in what they are told
(a second shuffle). Entries are new or old, only pairs with a new one are tried, reverse lists are sampled, rounds end when
lists settle. A search is rounds too: the open entries of each query's front are joined with the lists, what they list
with the vectors.

Points in space begin in leaves (``leaves``): lists inside a leaf come from the same steps, done on arrays in the task
that has the leaf. Only a point whose ball of neighbours leaves its leaf can gain anything elsewhere, so the rounds between
leaves carry these points and those they list. Vectors of many dimensions have no such bound: all take part in every round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.leaves import CAP, LEAF, leaf_box, leaves_box, with_leaves
from pointloom.session import materialize, release

DEGREE, BEAM, LANDMARKS = 8, 20, 16
SETTLED, MOST_ROUNDS = 0.001, 12
ROWS = 1024
_IDX = np.uint64(16)
_LOW = np.uint64(0xFFFF)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LIST = "array<struct<d2:double,id:bigint>>"


def _keys(d2: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Distance and index in one sortable number; equal ones are the same candidate."""
    return (np.ascontiguousarray(d2, dtype=np.float32).view(np.uint32).astype(np.uint64) << _IDX) | idx.astype(np.uint64)


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """The k smallest different keys of each row."""
    keys.sort(axis=1)
    same = keys[:, 1:] == keys[:, :-1]
    if same.any():
        _blank(keys[:, 1:], same)
        keys.sort(axis=1)
    return keys[:, :k]


def _blank(keys: np.ndarray, where: np.ndarray) -> None:
    """``keys[where] = _NONE``, without branches: all bits are set."""
    keys |= np.negative(where.astype(np.uint64))


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits of whole numbers three apart."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = (v | (v << shift)) & mask
    return v


def _unit(p: np.ndarray) -> np.ndarray:
    """Coordinates scaled to 0 … 1 by all but the outermost points, which are moved to the edge."""
    lo, hi = np.percentile(p, [1, 99], axis=0)
    width = max(float((hi - lo).max()), float((p.max(axis=0) - p.min(axis=0)).max()) * 1e-6, 1e-30) * 1.2
    return np.clip((p - lo) / width + 0.08, 0, 1)


def near_order(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by Morton key of the first three coordinates, then by id."""
    v = _spread((_unit(x[:, :3].astype(np.float64)) * 1_000_000).astype(np.int64))
    return np.lexsort((ids, sum(v[:, c] << c for c in range(v.shape[1]))))


def _turned_order(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Points in Morton order of a random projection to three axes: another cut of space into near runs."""
    axes = np.linalg.qr(rng.standard_normal((x.shape[1], 3) if x.shape[1] > 3 else (3, 3)))[0][: x.shape[1]]
    p = x @ axes
    v = _spread((_unit(p) * 900_000 + rng.uniform(0, 100_000, 3)).astype(np.int64))
    return np.argsort(v[:, 0] | v[:, 1] << 1 | v[:, 2] << 2, kind="stable")


def nn_descent(x: np.ndarray, k: int = DEGREE, rounds: int = 12, width: int = 6, orders: int = 3) -> np.ndarray:
    """Neighbour lists (n, k) of a block, nearest first, -1 where there are fewer other points. It starts from
    runs of points in ``orders`` turned orders besides their own; each round tries ``width``² points met by two
    steps along the lists, either way."""
    n = len(x)
    if n < 2:
        return np.full((n, k), -1, np.int32)
    x = x.astype(np.float32)
    me, rng = np.arange(n), np.random.default_rng(n)
    columns = np.ascontiguousarray(x.T) if x.shape[1] <= 4 else None

    def lengths(cand: np.ndarray, lo: int) -> np.ndarray:
        hi = lo + len(cand)
        if columns is None:
            d2 = np.zeros(cand.shape, np.float32)
            for at in range(0, len(cand), 256):
                diff = x[cand[at : at + 256]] - x[lo + at : min(lo + at + 256, hi), None]
                d2[at : at + 256] = np.einsum("ijk,ijk->ij", diff, diff)
            return d2
        d2 = None
        for column in columns:
            diff = column.take(cand, mode="clip")  # all are in range; the quicker mode
            diff -= column[lo:hi, None]
            diff *= diff
            d2 = diff if d2 is None else np.add(d2, diff, out=d2)
        return d2

    def best(cand: Callable[[int, int], np.ndarray], lists: np.ndarray | None) -> np.ndarray:
        """The k nearest of the lists and of the candidates of points lo … hi; so many points at once as stay in the cache."""
        parts = []
        for lo in range(0, n, ROWS):
            hi = min(lo + ROWS, n)
            new = cand(lo, hi)
            keys = _keys(lengths(new, lo), new)
            _blank(keys, new == me[lo:hi, None])
            parts.append(_best(keys if lists is None else np.concatenate([lists[lo:hi], keys], axis=1), k))
        return np.concatenate(parts)

    side = max(6, k // 2 + 1)
    reach = [*range(-side, 0), *range(1, side + 1), n // 3, n // 2]
    first = [(me[:, None] + np.array(reach)) % n]
    for _ in range(orders):
        order = _turned_order(x, rng)
        place = np.empty(n, np.int64)
        place[order] = me
        first.append(order[(place[:, None] + np.array([*range(-4, 0), *range(1, 5)])) % n])
    lists = best(lambda lo, hi: np.concatenate([f[lo:hi] for f in first], axis=1), None)
    for _ in range(rounds):
        known = (lists & _LOW).astype(np.int64)
        known[lists == _NONE] = 0
        known = np.where(lists == _NONE, me[:, None], known)
        # lists both ways: of those that have this point at one place of their list, one is taken
        back = np.repeat(me[:, None], k, axis=1)
        for c in range(known.shape[1]):
            back[known[:, c], c] = me
        around = np.concatenate([known, back], axis=1)
        through = np.ascontiguousarray(around[:, rng.permutation(around.shape[1])[:width]])
        onward = np.ascontiguousarray(around[:, rng.permutation(around.shape[1])[:width]])
        met = lambda lo, hi: np.concatenate([onward.take(through[lo:hi], axis=0, mode="clip").reshape(hi - lo, -1), back[lo:hi, :2]], axis=1)  # noqa: E731, B023
        new = best(met, lists)
        changed = (new != lists).sum()
        lists = new
        if changed <= 0.01 * n * k:  # points in order of locality get there in two or three rounds
            break
    out = (lists & _LOW).astype(np.int32)
    out[lists == _NONE] = -1
    if out.shape[1] < k:
        out = np.pad(out, ((0, 0), (0, k - out.shape[1])), constant_values=-1)
    return out


def both_ways(nbr: np.ndarray) -> np.ndarray:
    """Neighbour lists, followed by as many of the points that have this one in their list."""
    n, k = nbr.shape
    src, dst = np.repeat(np.arange(n), k), nbr.ravel().astype(np.int64)
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst, "left")
    out = np.full((n, k), -1, np.int64)
    out[dst[rank < k], rank[rank < k]] = src[rank < k]
    return np.concatenate([nbr.astype(np.int64), out], axis=1)


def greedy_search(x: np.ndarray, nbr: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Positions (len(q), beam) found by walking the graph from ``start`` (len(q), s); -1 where none."""
    n, rows = len(x), np.arange(len(q))
    x32, q32 = x.astype(np.float32), q.astype(np.float32)

    def as_keys(cand: np.ndarray, at: np.ndarray) -> np.ndarray:
        diff = x32[cand] - q32[at][:, None]
        keys = _keys(np.einsum("ijk,ijk->ij", diff, diff), np.maximum(cand, 0))
        keys[cand < 0] = _NONE
        return keys

    front = _best(as_keys(start, rows), beam)
    if front.shape[1] < beam:
        front = np.pad(front, ((0, 0), (0, beam - front.shape[1])), constant_values=_NONE)
    done = np.zeros((len(q), n + 1), bool)
    done[:, n] = True
    active = rows
    while len(active):
        f = front[active]
        idx = np.where(f == _NONE, n, (f & _LOW).astype(np.int64))
        open_ = ~done[active[:, None], idx]
        has = open_.any(axis=1)
        active, idx, open_, f = active[has], idx[has], open_[has], f[has]
        if not len(active):
            break
        chosen = idx[np.arange(len(active)), open_.argmax(axis=1)]
        done[active, chosen] = True
        front[active] = _best(np.concatenate([f, as_keys(nbr[chosen], active)], axis=1), beam)
    out = (front & _LOW).astype(np.int64)
    out[front == _NONE] = -1
    return out


def _ranked(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qid: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and squared distances (double) of the k nearest of the positions ``found``; id -1 where there are fewer."""
    fid = np.where(found < 0, np.iinfo(np.int64).max, ids[np.maximum(found, 0)])
    diff = x.astype(np.float64)[np.maximum(found, 0)] - q.astype(np.float64)[:, None]
    d2 = (diff * diff).sum(axis=2)
    d2[(found < 0) | (fid == qid[:, None])] = np.inf
    take = np.lexsort((fid, d2), axis=1)[:, :k]
    fid, d2 = np.take_along_axis(fid, take, 1), np.take_along_axis(d2, take, 1)
    fid[~np.isfinite(d2)] = -1
    return fid, d2


def corrected(x: np.ndarray, ids: np.ndarray, me: np.ndarray, fid: np.ndarray, d2: np.ndarray) -> int:
    """Exact check of answers (fid, d2, nearest first) for the points ``me``: where a cell grid as wide as the last distance holds
    a nearer point, that answer is put right in place. Returns how many were."""
    x64, k, wrong = x.astype(np.float64), fid.shape[1], 0
    order = np.argsort(d2[:, -1], kind="stable")
    for part in np.array_split(order, max(1, -(-len(order) // 128))):
        last = d2[part, -1]
        wide = np.sqrt(float(last.max())) * (1 + 1e-9) if len(part) and np.isfinite(last.max()) else np.inf
        if not len(part):
            continue
        if wide > 0 and np.isfinite(wide):
            cell = np.floor((x64 - x64.min(axis=0)) / wide).astype(np.int64)
            for c in range(3):  # wide gaps between cells shrink
                at, inv = np.unique(cell[:, c], return_inverse=True)
                cell[:, c] = np.r_[0, np.cumsum(np.minimum(np.diff(at), 2))][inv] + 1
            n1, n2 = int(cell[:, 1].max()) + 2, int(cell[:, 2].max()) + 2
            key = (cell[:, 0] * n1 + cell[:, 1]) * n2 + cell[:, 2]
            by = np.argsort(key, kind="stable")
            moves = [key[me[part]] + (a * n1 + b) * n2 for a in (-1, 0, 1) for b in (-1, 0, 1)]
            runs = [(np.searchsorted(key[by], m - 1, "left"), np.searchsorted(key[by], m + 1, "right")) for m in moves]
        else:  # fewer than k other points, or all at one place
            by = np.arange(len(x))
            runs = [(np.zeros(len(part), np.int64), np.full(len(part), len(x)))]
        rows, cands = [], []
        for lo, hi in runs:
            m = hi - lo
            rows.append(np.repeat(np.arange(len(part)), m))
            cands.append(by[np.repeat(lo - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())])
        row, cand = np.concatenate(rows), np.concatenate(cands)
        diff = x64[cand] - x64[me[part][row]]
        gap = (diff * diff).sum(axis=1)
        on = (gap <= last[row]) & (cand != me[part][row])
        row, cand, gap = row[on], cand[on], gap[on]
        sort = np.lexsort((ids[cand], gap, row))
        row, cand, gap = row[sort], cand[sort], gap[sort]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        row, cand, gap, rank = row[rank < k], cand[rank < k], gap[rank < k], rank[rank < k]
        best, far = np.full((len(part), k), -1, np.int64), np.full((len(part), k), np.inf)
        best[row, rank], far[row, rank] = ids[cand], gap
        bad = (best != fid[part]).any(axis=1)
        wrong += int(bad.sum())
        fid[part[bad]], d2[part[bad]] = best[bad], far[bad]
    return wrong


def _lists(ids: np.ndarray, d2: np.ndarray) -> pa.Array:
    """Rows of (d2, id) without the empty places."""
    on = ids >= 0
    offsets = np.r_[0, np.cumsum(on.sum(axis=1))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(d2[on]), pa.array(ids[on])], ["d2", "id"]))


def _vectors(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x, np.float32).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def leaf_points(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, x, asked and the box of a leaf; every id once, near points near each other."""
    ids, at = np.unique(table.column("id").to_numpy(), return_index=True)
    x = np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)[at].astype(np.float32)
    order = near_order(x, ids)
    asked = table.column("asked").to_numpy()[at][order].astype(bool) if "asked" in table.column_names else np.zeros(len(ids), bool)
    first = {c: table.column(c)[0].as_py() for c in LEAF[1:]}
    lo, hi = leaf_box(first["depth"], (first["lx"], first["ly"], first["lz"]), first["part"])
    return ids[order], x[order], asked, lo, hi


def landmarks(n: int) -> np.ndarray:
    """Some places spread over a leaf, by which far points find into it."""
    return np.unique(np.linspace(0, n - 1, min(n, LANDMARKS)).astype(np.int64))


GRAPH = pa.schema([("id", pa.int64()), ("asked", pa.bool_()), ("open", pa.bool_()), ("vec", pa.list_(pa.float32())), ("nn", pa.list_(pa.struct([("d2", pa.float64()), ("id", pa.int64())])))])


def _in_leaf(k: int, check: bool) -> Callable[[pa.Table], pa.Table]:
    def build(table: pa.Table) -> pa.Table:
        """Answers of the closed points asked (vec null), the lists of open points and of those they list, and the vectors of
        those that these list (nn null)."""
        ids, x, asked, lo, hi = leaf_points(table)
        nbr = nn_descent(x, max(DEGREE, k + 2))
        whole = not np.isfinite(lo).any() and (lo < hi).all()
        if whole:
            rim = open_ = np.zeros(len(ids), bool)
        else:
            last = np.maximum(nbr[:, min(k, DEGREE) - 1], -1)
            reach = np.where(last < 0, np.inf, np.sqrt(((x - x[np.maximum(last, 0)]).astype(np.float64) ** 2).sum(axis=1)))
            open_ = leaves_box(x.astype(np.float64), reach, lo, hi)
            rim = open_.copy()
            rim[landmarks(len(ids))] = True
            rim[nbr[rim][nbr[rim] >= 0]] = True
        parts, walk = [], both_ways(nbr) if asked.any() else None
        done = np.flatnonzero(asked & ~open_)
        for at in np.array_split(done, max(1, -(-len(done) // 512))):
            found = greedy_search(x, walk, x[at], np.concatenate([at[:, None], nbr[at]], axis=1), BEAM) if len(at) else np.zeros((0, BEAM), np.int64)
            got = _ranked(x, ids, x[at], ids[at], found, k)
            if check:
                corrected(x, ids, at, *got)
            none = pa.array([None] * len(at), pa.list_(pa.float32()))
            parts.append(pa.table([pa.array(ids[at]), pa.array(np.ones(len(at), bool)), pa.array(np.zeros(len(at), bool)), none, _lists(*got)], schema=GRAPH))
        at = np.flatnonzero(rim)
        got = _ranked(x, ids, x[at], ids[at], nbr[at].astype(np.int64), nbr.shape[1])
        parts.append(pa.table([pa.array(ids[at]), pa.array(asked[at]), pa.array(open_[at]), _vectors(x[at]), _lists(*got)], schema=GRAPH))
        beyond = np.zeros(len(ids), bool)
        beyond[nbr[rim][nbr[rim] >= 0]] = True
        at = np.flatnonzero(beyond & ~rim)
        no, none = pa.array(np.zeros(len(at), bool)), pa.array([None] * len(at), GRAPH.field("nn").type)
        parts.append(pa.table([pa.array(ids[at]), no, no, _vectors(x[at]), none], schema=GRAPH))
        return pa.concat_tables(parts)

    return build


def _start_lists(k: int) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([GRAPH.field("id"), GRAPH.field("nn")])

    def lists(table: pa.Table) -> pa.Table:
        ids, x, *_ = leaf_points(table)
        at = np.arange(len(ids))
        return pa.table([pa.array(ids), _lists(*_ranked(x, ids, x, ids, nn_descent(x, k)[at].astype(np.int64), k))], schema=schema)

    return lists


# --- rounds between points, wherever they lie ---------------------------------------------------------------


def _taken(old: str, told: str, k: int) -> F.Column:
    """The k nearest of both lists, marked new where the old one had them not."""
    known = F.transform(old, lambda e: e["id"])
    fresh = F.filter(F.coalesce(F.col(told), F.array().cast(LIST)), lambda e: ~F.array_contains(known, e["id"]))
    kept = F.transform(old, lambda e: F.struct(e["d2"].alias("d2"), e["id"].alias("id"), F.lit(False).alias("new")))
    added = F.transform(fresh, lambda e: F.struct(e["d2"].alias("d2"), e["id"].alias("id"), F.lit(True).alias("new")))
    return F.slice(F.array_sort(F.concat(kept, added)), 1, k)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the points that meet at one place, told to either where they beat its last neighbour."""
    for batch in batches:
        lists = batch.column("ms")
        for at in range(0, batch.num_rows, 256):
            part = lists.slice(at, min(256, batch.num_rows - at))
            m = part.flatten()
            n = part.value_lengths().to_numpy(zero_copy_only=False)
            ids, far, new = (m.field(c).to_numpy(zero_copy_only=False) for c in ("id", "far", "new"))
            vec = m.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
            width = int(n.max()) if len(n) else 0
            place = np.arange(width)[None] < n[:, None]
            pos = np.zeros((len(n), width), np.int64)
            pos[place] = np.arange(len(ids))
            i, j = np.triu_indices(width, 1)
            a, b = pos[:, i], pos[:, j]
            ok = place[:, i] & place[:, j]
            ok &= (new[a].astype(bool) | new[b].astype(bool)) & (ids[a] != ids[b])
            a, b = a[ok], b[ok]
            d2 = np.empty(len(a))
            for lo in range(0, len(a), 65_536):
                diff = vec[a[lo : lo + 65_536]] - vec[b[lo : lo + 65_536]]
                d2[lo : lo + 65_536] = (diff * diff).sum(axis=1)
            to_a, to_b = d2 <= far[a], d2 <= far[b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[ids[a[to_a]], ids[b[to_b]]]), pa.array(np.r_[d2[to_a], d2[to_b]]), pa.array(np.r_[ids[b[to_a]], ids[a[to_b]]])], ["to", "d2", "id"]
            )


def _round(state: DataFrame, k: int, turn: int, beyond: DataFrame | None) -> DataFrame:
    """One round of NN-descent over id, vec, nn: array of (d2, id, new). ``beyond``: id, vec of points that are listed but
    take no lists themselves."""
    far = F.when(F.size("nn") >= k, F.element_at("nn", -1)["d2"]).otherwise(float("inf"))
    own = state.select("id", "vec", far.alias("far"), "nn")
    # only places where something new is met count: the two ends of new entries
    fresh = state.select("id", F.explode(F.filter("nn", lambda e: e["new"])).alias("e"))
    hot = fresh.select(F.explode(F.array("id", "e.id")).alias("id")).distinct()
    edges = own.join(hot.withColumn("hot", F.lit(True)), "id", "left").select("id", "vec", "far", "hot", F.explode("nn").alias("e"))
    edges = edges.select("id", "vec", "far", "hot", F.col("e.id").alias("other"), F.col("e.new").alias("new"))
    calm = edges.where("hot IS NULL").join(hot.select(F.col("id").alias("other")), "other", "left_semi")
    others = own.select("id", "vec", "far")
    if beyond is not None:
        others = others.unionByName(beyond.select("id", "vec", F.lit(-1.0).alias("far")))
    ends = edges.where("hot").unionByName(calm).join(others.toDF("other", "ovec", "ofar"), "other")
    member = lambda i, v, f: F.struct(F.col(i).alias("id"), F.col(v).alias("vec"), F.col(f).alias("far"), F.col("new"))
    ahead = F.struct(F.col("id").alias("at"), F.lit(0).alias("back"), member("other", "ovec", "ofar").alias("m"))
    behind = F.struct(F.col("other").alias("at"), F.lit(1).alias("back"), member("id", "vec", "far").alias("m"))
    sides = F.when(F.col("hot"), F.array(ahead, behind)).otherwise(F.array(behind))
    met = ends.select(F.explode(sides).alias("s")).select("s.*")
    # a place takes in its own list and as many of those that list it, new ones first; Spark drops the rest before the shuffle
    w = Window.partitionBy("at").orderBy("back", F.desc("m.new"), F.xxhash64("m.id", F.lit(turn)))
    met = met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * k)
    places = met.groupBy("at").agg(F.collect_list("m").alias("ms")).where(F.exists("ms", lambda m: m["new"]) & (F.size("ms") > 1))
    told = places.select("ms").mapInArrow(_meet, "to bigint, d2 double, id bigint")
    best = told.groupBy(F.col("to").alias("id")).agg(F.slice(F.array_sort(F.collect_set(F.struct("d2", "id"))), 1, k).alias("told"))
    return state.join(best, "id", "left").select("id", "vec", _taken("nn", "told", k).alias("nn"))


def descend(state: DataFrame, k: int, beyond: DataFrame | None = None, most: int = MOST_ROUNDS) -> tuple[DataFrame, list[int]]:
    """Rounds until less than ``SETTLED`` of the entries are new: (state, new entries of each round). Each round is a
    written table and the one before it is removed."""
    changes: list[int] = []
    for turn in range(most):
        last, state = state, materialize(_round(state, k, turn, beyond), "descent")
        release(last)
        seen = state.agg(F.sum(F.size(F.filter("nn", lambda e: e["new"]))).alias("new"), F.sum(F.size("nn")).alias("all")).first()
        changes.append(int(seen["new"] or 0))
        if changes[-1] <= SETTLED * (seen["all"] or 0):
            break
    return state, changes


def _gap(a: str, b: str) -> F.Column:
    """Squared distance of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u.cast("double") - v.cast("double")) * (u.cast("double") - v.cast("double"))), F.lit(0.0), lambda s, e: s + e)


def search(state: DataFrame, fronts: DataFrame, k: int, beyond: DataFrame | None = None, beam: int = BEAM, most: int = MOST_ROUNDS, ahead: int = 3) -> DataFrame:
    """qid, nn: greedy search from ``fronts`` (qid, vec, nn: the entries to begin with). A round opens those of
    the first k + ``ahead`` entries of each front that are not open yet, meets what they list and the nearest that list them, and keeps the ``beam``
    nearest; the search ends when the first k + ``ahead`` of every front are open."""
    links = state.select("id", F.explode("nn").alias("e")).select("id", F.col("e.id").alias("other"), F.col("e.d2").alias("d2"))
    nearest = Window.partitionBy("qid", "at").orderBy("d2", "other")
    vecs = state.select("id", "vec") if beyond is None else state.select("id", "vec").unionByName(beyond.select("id", "vec"))
    vecs = vecs.toDF("other", "ovec")
    entry = lambda e, opened: F.struct(e["d2"].alias("d2"), e["id"].alias("id"), opened.alias("open"))
    front = materialize(fronts.select("qid", "vec", F.slice(F.array_sort(F.transform("nn", lambda e: entry(e, F.lit(False)))), 1, beam).alias("nn")), "front")
    for _ in range(most):
        first = F.slice("nn", 1, k + ahead)
        asks = front.select("qid", F.explode(F.filter(first, lambda e: ~e["open"])).alias("e")).select("qid", F.col("e.id").alias("id"))
        if asks.isEmpty():
            break
        back = asks.withColumnRenamed("id", "at").join(links.select(F.col("other").alias("at"), F.col("id").alias("other"), "d2"), "at")
        back = back.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k).select("qid", "other")
        met = asks.join(links, "id").select("qid", "other").unionByName(back).where("qid <> other").distinct()
        known = front.select("qid", F.col("vec").alias("qvec"), F.transform("nn", lambda e: e["id"]).alias("known"))
        fresh = met.join(known, "qid").where(~F.array_contains("known", F.col("other"))).drop("known").join(vecs, "other")
        best = fresh.select("qid", F.struct(_gap("qvec", "ovec").alias("d2"), F.col("other").alias("id"), F.lit(False).alias("open")).alias("e"))
        best = best.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list("e")), 1, beam).alias("more"))
        opened = F.transform("nn", lambda e, i: entry(e, e["open"] | (i < k + ahead)))
        merged = F.slice(F.array_sort(F.concat(opened, F.coalesce("more", F.array().cast("array<struct<d2:double,id:bigint,open:boolean>>")))), 1, beam)
        last, front = front, materialize(front.join(best, "qid", "left").select("qid", "vec", merged.alias("nn")), "front")
        release(last)
    return front.select("qid", F.slice(F.transform("nn", lambda e: F.struct(e["d2"].alias("d2"), e["id"].alias("id"))), 1, k).alias("nn"))


def valid_points(points: DataFrame, id: str, group: str) -> DataFrame:
    """Rows with id, group and finite x, y, z that are not all zero."""
    ok = F.col(id).isNotNull() & F.col(group).isNotNull()
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return points.where(ok & ((F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0)))


def across_leaves(rim: DataFrame, beyond: DataFrame, k: int, cap: int = CAP) -> tuple[DataFrame, list[int]]:
    """Lists of points whose neighbours may lie in other leaves. ``rim``: grp, id, vec, open, nn (lists inside the leaf);
    ``beyond``: id, vec of the other points they list.
    Open points find first partners in leaves of moved cells, those alone in their leaf some points of other leaves; then rounds
    of NN-descent join lists across all leaves."""
    moved = [F.element_at("vec", i + 1) + F.lit(s) for i, s in enumerate((7.37, 11.13, 3.71))]
    starts = with_leaves(rim.where("open").select("grp", "id", "vec", *[m.alias(c) for m, c in zip(moved, "xyz", strict=True)]), cap)
    starts = starts.withColumns({c: F.element_at("vec", i + 1) for i, c in enumerate("xyz")}).drop("vec")
    told = starts.groupBy(*LEAF).applyInArrow(_start_lists(k), f"id bigint, nn {LIST}")
    some = rim.where("NOT open").withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("id"), "id"))).where(F.col("r") <= 2 * LANDMARKS)
    alone = rim.where(F.col("open") & (F.size("nn") < k)).select("grp", F.col("id").alias("me"), F.col("vec").alias("mine"))
    far = alone.join(some.select("grp", "id", "vec"), "grp").where("me <> id").groupBy(F.col("me").alias("id")).agg(F.collect_list(F.struct(_gap("mine", "vec").alias("d2"), "id")).alias("nn"))
    told = told.unionByName(far).groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("nn")))), 1, k).alias("nn"))
    state = rim.join(told.select("id", F.col("nn").alias("told")), "id", "left").select("id", "vec", _taken("nn", "told", k).alias("nn"))
    return descend(materialize(state, "descent"), k, beyond)


BROADCAST_IDS = 2_000_000


def point_neighbours(points: DataFrame, probes: DataFrame | None, *, group: str, id: str, k: int = 5, cap: int = CAP, check: bool = False) -> DataFrame:
    """qid, nn: the k nearest other valid points of the same group for the points in ``probes`` (``id`` column), or for
    all points if ``probes`` is None, as array of (d2, id) in order of distance, of equal distances the smaller id first.
    A group with fewer than k + 1 points gives shorter lists. The search is approximate (README: recall); with ``check`` the
    answers of points whose neighbours lie in one leaf are checked exactly, and the few that missed one are put right.

    Invalid points (null, NaN, infinite, all zero) are neither found nor answered; repeated rows count once;
    points with equal coordinates are neighbours at distance 0.
    Columns beyond group, id, x, y, z are ignored. Empty inputs give no rows.
    """
    rows = valid_points(points, id, group).select(F.col(group).alias("grp"), F.col(id).cast("bigint").alias("id"), *[F.col(c).cast("float").alias(c) for c in "xyz"])
    if probes is None:
        rows = rows.withColumn("asked", F.lit(True))
    else:
        wanted = probes.select(F.col(id).cast("bigint").alias("id")).dropna().distinct().withColumn("asked", F.lit(True))
        if probes.count() <= BROADCAST_IDS:  # 16 MB of ids; beyond that the join shuffles both sides
            wanted = F.broadcast(wanted)
        rows = rows.join(wanted, "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    gtype = rows.schema["grp"].dataType.simpleString()
    build = _in_leaf(k, check)

    def leaf(key: tuple, table: pa.Table) -> pa.Table:
        out = build(table)
        return out.add_column(0, "grp", pa.array([key[0].as_py()] * len(out), table.schema.field("grp").type))

    graph = with_leaves(rows, cap).groupBy(*LEAF).applyInArrow(leaf, f"grp {gtype}, id bigint, asked boolean, open boolean, vec array<float>, nn {LIST}")
    graph = materialize(graph, "graph")
    done = graph.where("asked AND NOT open AND vec IS NULL").select(F.col("id").alias("qid"), "nn")
    rim, beyond = graph.where("vec IS NOT NULL AND nn IS NOT NULL"), graph.where("nn IS NULL")
    if rim.isEmpty():
        return done
    state, _ = across_leaves(rim, beyond, max(DEGREE, k + 2), cap)
    asked = rim.where("asked AND open").select("id")
    fronts = state.join(asked, "id", "left_semi").select(F.col("id").alias("qid"), "vec", "nn")
    return done.unionByName(search(state, fronts, k, beyond))


# --- vectors of any dimension -------------------------------------------------------------------------------

START, ORDERS = 256, 3


def _first_lists(k: int) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([GRAPH.field("id"), GRAPH.field("nn")])

    def lists(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        parts = []
        for at in np.array_split(np.arange(len(ids)), -(-len(ids) // START)):
            a = x[at].astype(np.float64)
            d2 = np.stack([((a - q) ** 2).sum(axis=1) for q in a])
            np.fill_diagonal(d2, np.inf)
            take = np.lexsort((np.broadcast_to(ids[at], d2.shape), d2), axis=1)[:, :k]
            near = np.take_along_axis(d2, take, 1)
            parts.append(pa.table([pa.array(ids[at]), _lists(np.where(np.isfinite(near), ids[at][take], -1), near)], schema=schema))
        return pa.concat_tables(parts)

    return lists


def vector_graph(vectors: DataFrame, *, id: str, vec: str, k: int, seed: int = 7) -> tuple[DataFrame, list[int]]:
    """(id, vec, nn; new entries by round): NN-descent over all vectors. Lists begin among points that share the signs of
    some random projections, in ``ORDERS`` different sets of them. Rows with a null id, a null vector, null or non-finite parts,
    and those of another length than most have, are left out; of a repeated id one row counts."""
    ok = vectors.where(F.col(id).isNotNull() & F.col(vec).isNotNull() & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    sizes = ok.groupBy(F.size(vec).alias("n")).agg(F.count("*").alias("rows")).where("n > 0").orderBy(F.desc("rows"), "n").take(1)
    dim = sizes[0]["n"] if sizes else 1
    rows = ok.where(F.size(vec) == dim).groupBy(F.col(id).cast("bigint").alias("id")).agg(F.min(F.col(vec).cast("array<float>")).alias("vec"))
    rows = materialize(rows, "vectors")
    n = rows.count()
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / START))))  # signs of so many projections leave about START points together
    rng = np.random.default_rng(seed)
    told = None
    for _ in range(ORDERS if bits else 1):
        planes = rng.standard_normal((dim, bits)).astype(np.float32)

        def project(batches: Iterator[pa.RecordBatch], planes: np.ndarray = planes) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                key = ((x @ planes) > 0) @ (1 << np.arange(planes.shape[1], dtype=np.int64))
                yield b.append_column("key", pa.array(key.astype(np.int64)))

        keyed = rows.mapInArrow(project, "id bigint, vec array<float>, key bigint")
        # crowded keys are shared out, about 16 starts a group
        parts = keyed.groupBy("key").agg(F.ceil(F.count("*") / F.lit(16 * START)).alias("parts"))
        salted = keyed.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
        one = salted.groupBy("key", "part").applyInArrow(_first_lists(k), f"id bigint, nn {LIST}")
        told = one if told is None else told.unionByName(one)
    merged = told.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("nn")))), 1, k).alias("told"))
    none = F.array().cast(LIST)
    state = rows.join(merged, "id", "left").withColumn("nn", none).select("id", "vec", _taken("nn", "told", k).alias("nn"))
    return descend(materialize(state, "descent"), k)


def vector_neighbours(vectors: DataFrame, *, id: str, vec: str, k: int, asked: F.Column, seed: int = 7, beam: int | None = None) -> DataFrame:
    """qid, nn (array of (d2, id)) for the vectors for which ``asked`` holds, against all: greedy search over the graph of
    ``vector_graph``, from a query's own list. Rows left out of the graph are not answered; no rows give none."""
    state, _ = vector_graph(vectors, id=id, vec=vec, k=max(2 * k, 16), seed=seed)
    wanted = vectors.where(asked).select(F.col(id).cast("bigint").alias("id")).distinct()
    fronts = state.join(wanted, "id", "left_semi").select(F.col("id").alias("qid"), "vec", "nn")
    return search(state, fronts, k, beam=beam or 3 * k, ahead=k)
