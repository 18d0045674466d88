"""Exact top-k inner-product search with M-trees.

Vectors are dealt by their nearest pivot, and in crowded groups by the nearest of the group's own pivots, into shards of bounded size.
Each shard is an M-tree, stored as a table of pages: a node has a pivot, a covering radius and its distance from its parent's pivot; a
leaf page holds vectors with their distances from the leaf's pivot. A search goes best-first: nodes wait in a heap by the best score
that they could hold, a node or entry whose stored distances rule it out by the triangle inequality is passed over without computing
its distance, and the search ends when no node can better the k-th score.

Queries are rows. Each goes to its most promising shard first; the k-th score there tells which other shards it still has to see, and
it is dealt to these. A shard that many queries see is searched in several tasks.

An inner product is not a metric. With one more component sqrt(M - |x|^2), for M the greatest squared length, all vectors have one
length, and the nearest in Euclidean distance to a query (with a 0 there) is the one with the greatest product. Distances guide the
search only; scores are exact products of integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.frames import Scratch, shuffle_partitions

#: Pivots of the first dealing, at most; they are a sample, and every vector goes to a shard.
MOST_PIVOTS = 1024
#: Vectors of a shard, about, and of one with long vectors their bytes; more, where the shards' roots would exceed ROOT_BYTES.
SHARD_ROWS = 8192
SHARD_BYTES = 16 << 20
#: What the pivots and the shards' roots take in every task, at most.
ROOT_BYTES = 64 << 20
#: Vectors of a leaf page take about so many bytes; children of a node.
PAGE_BYTES = 64 << 10
FANOUT = 8
#: Queries that a task puts to one shard, about.
TASK_QUERIES = 4096
#: Vectors with a scaled component beyond this, or longer than MOST_DIM, have products that 64 bits may not hold. They are outside the
#: trees: products with them are of Python's integers, one by one.
MOST_COMPONENT = 2**24
MOST_DIM = 2**13
BLOCK_QUERIES = 1024
_LONG = 2**63 - 1

_PAGES = "shard long, node int, parent int, leaf boolean, pivot binary, radius double, parent_distance double, least_id long, ids binary, uids binary, vectors binary, distances binary"
_VECTORS = "uid long, vec_id long, x binary, dim int, norm long"
_FOUND = "query_uid long, query_id long, uid long, vec_id long, score long"


def _integer_batches(scale: int):
    """To scaled vectors as 32-bit integers with their squared length, or, if they are too large for that, as decimals (norm: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, ids, out, dims, norms = [], [], [], [], []
            for u, i, v in zip(batch.column("uid").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                uid.append(u)
                ids.append(i)
                dims.append(len(x))
                small = np.floor(x * scale) if np.abs(x).max(initial=0) * scale <= MOST_COMPONENT else None
                if small is None or len(x) > MOST_DIM:
                    # A product with a power of two is exact; it may exceed the doubles.
                    out.append(" ".join(str(_floor(c, scale)) for c in x.tolist()).encode())
                    norms.append(None)
                else:
                    out.append(small.astype("<i4").tobytes())
                    norms.append(int((small.astype(np.int64) ** 2).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.int64())], names=["uid", "vec_id", "x", "dim", "norm"])

    return run


def _floor(x: float, scale: int) -> int:
    n, d = x.as_integer_ratio()
    return n * scale // d


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), dim).astype(np.int64)


def _lifted(x: np.ndarray, most: int) -> np.ndarray:
    """Vectors with the component that gives all of them the squared length `most`."""
    return np.hstack([x.astype(np.float64), np.sqrt(np.maximum(0, most - (x * x).sum(1)).astype(np.float64))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """Indices of up to n points far from each other, each the farthest from those before it."""
    chosen = [0]
    near = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return np.array(chosen)


def build_pages(shard: int, ids: np.ndarray, uids: np.ndarray, vectors: np.ndarray, most: int) -> list[tuple]:
    """The pages of an M-tree over some vectors, the root first."""
    points = _lifted(vectors, most)
    page = max(8, PAGE_BYTES // (4 * max(1, vectors.shape[1])))
    pages: list[tuple] = []
    stack: list[tuple] = [(np.lexsort((uids, ids)), -1, None)]
    while stack:
        members, parent, parent_pivot = stack.pop()
        pivot = points[members].mean(0)
        pivot = points[members[np.linalg.norm(points[members] - pivot, axis=1).argmin()]]
        far = np.linalg.norm(points[members] - pivot, axis=1)
        up = 0.0 if parent_pivot is None else float(np.linalg.norm(pivot - parent_pivot))
        node = len(pages)
        split = []
        if len(members) > page and far.max() > 0:
            seeds = points[members[_spread(points[members], FANOUT)]]
            nearest = _distances(points[members], seeds).argmin(1)
            split = [members[nearest == s] for s in range(len(seeds))]
            split = [s for s in split if len(s)]
        leaf = len(split) < 2
        blobs = (ids[members].tobytes(), uids[members].tobytes(), vectors[members].astype("<i4").tobytes(), far.tobytes()) if leaf else (None,) * 4
        pages.append((shard, node, parent, leaf, pivot.tobytes(), float(far.max()), up, int(ids[members].min()), *blobs))
        if not leaf:
            stack += [(s, node, pivot) for s in split]
    return pages


class Tree:
    """M-trees of one dimension, read from their pages, and best-first searches in them."""

    def __init__(self, rows: list[dict], dim: int, most: int):
        self.most, self.dim = most, dim
        number = {(r["shard"], r["node"]): k for k, r in enumerate(rows)}
        self.pivots = np.frombuffer(b"".join(r["pivot"] for r in rows), np.float64).reshape(len(rows), dim + 1)
        self.radius = np.array([r["radius"] for r in rows])
        self.up = np.array([r["parent_distance"] for r in rows])
        self.least = np.array([r["least_id"] for r in rows], np.int64)
        below: dict[int, list[int]] = {}
        roots = []
        for k, r in enumerate(rows):
            if r["parent"] < 0:
                roots.append(k)
            else:
                below.setdefault(number[r["shard"], r["parent"]], []).append(k)
        self.roots, self.children = np.array(roots), {k: np.array(v) for k, v in below.items()}
        self.leaves, self.largest = {}, 0.0
        for k, r in enumerate(rows):
            if r["leaf"]:
                n = len(r["ids"]) // 8
                self.leaves[k] = (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["uids"], np.int64), np.frombuffer(r["vectors"], "<i4").reshape(n, dim).astype(np.float64), np.frombuffer(r["distances"], np.float64))
                self.largest = max(self.largest, float(np.abs(self.leaves[k][2]).max(initial=0)))

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> tuple[list[tuple[int, int, int]], int]:
        """The best k (score, vec_id, uid) of a query among these trees; floor: a score that k others are known to reach. The
        second value counts the distances and products computed."""
        q = np.append(query.astype(np.float64), 0.0)
        base = float((query * query).sum()) + self.most
        slack = _slack(base)
        # Doubles hold integers up to 2**53 exactly; beyond, products are of 64-bit integers.
        factor = q[:-1] if self.largest * float(np.abs(q).max()) * self.dim < 2.0**53 else query.astype(np.int64)
        best: list[tuple[int, int, int]] = []  # a heap of (score, -vec_id, -uid): the worst on top
        computed = 0

        def least_score() -> float:
            held = best[0][0] if len(best) == k else -np.inf
            return held if floor is None else max(held, floor)

        def could(distance: np.ndarray) -> np.ndarray:
            """The greatest score at a distance of at least this."""
            return (base - np.maximum(distance, 0) ** 2) / 2 + slack

        def push(nodes: np.ndarray) -> None:
            nonlocal computed
            distance = np.linalg.norm(self.pivots[nodes] - q, axis=1)
            computed += len(nodes)
            score = could(distance - self.radius[nodes])
            for s, n, d in zip(score.tolist(), nodes.tolist(), distance.tolist(), strict=True):
                if s >= least_score():
                    heapq.heappush(heap, (-s, n, d))

        heap: list[tuple[float, int, float]] = []
        if len(self.roots):
            push(self.roots)
        while heap:
            s, node, distance = heapq.heappop(heap)
            if -s < least_score():
                break
            if node in self.leaves:
                ids, uids, vectors, far = self.leaves[node]
                open_ = np.flatnonzero(could(np.abs(distance - far)) >= least_score())
                if not len(open_):
                    continue
                page = vectors if len(open_) == len(ids) else vectors[open_]
                scores = page @ factor if factor.dtype == np.float64 else page.astype(np.int64) @ factor
                computed += len(open_)
                for j in np.flatnonzero(scores >= least_score()):
                    i = open_[j]
                    entry = (int(scores[j]), -int(ids[i]), -int(uids[i]))
                    if uids[i] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            else:
                nodes = self.children[node]
                nodes = nodes[could(np.abs(distance - self.up[nodes]) - self.radius[nodes]) >= least_score()]
                if len(nodes):
                    push(nodes)
        return [(s, -i, -u) for s, i, u in sorted(best, reverse=True)], computed


def _slack(base: float) -> float:
    """More than what rounding can do to a bound."""
    return 1e-9 * base + 1e-3


class _Deal:
    """Numbers the group of each vector: its nearest pivot, and under that the nearest of the pivot's own, if it has any."""

    def __init__(self, pivots: dict[int, np.ndarray], most: dict[int, int]):
        self.pivots, self.most = pivots, most
        self.own: dict[tuple[int, int], np.ndarray] = {}

    def groups(self, dims: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        first, second = np.zeros(len(dims), np.int64), np.zeros(len(dims), np.int64)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            for i in range(0, len(rows), 2048):
                part = rows[i : i + 2048]
                points = _lifted(_matrix([blobs[r] for r in part], dim), self.most[dim])
                first[part] = near = _distances(points, self.pivots[dim]).argmin(1)
                for p in np.unique(near).tolist():
                    if (dim, p) in self.own:
                        of = np.flatnonzero(near == p)
                        second[part[of]] = _distances(points[of], self.own[dim, p]).argmin(1)
        return first, second


def _group_batches(deal: _Deal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = deal.groups(batch.column("dim").to_numpy(), batch.column("x").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(second)], names=[*batch.schema.names, "first", "second"])

    return run


def _build_group(most: dict[int, int]):
    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        vectors = _matrix(table.column("x").to_pylist(), dim)
        pages = build_pages(table.column("shard")[0].as_py(), table.column("vec_id").to_numpy(), table.column("uid").to_numpy(), vectors, most[dim])
        columns = list(zip(*[(dim, *p) for p in pages], strict=True))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), *[pa.binary()] * 4]
        names = ["dim", *(c.split()[0] for c in _PAGES.split(", "))]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return build


def _shard_batches(roots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], most: dict[int, int], home: bool):
    """To queries with a shard. home: the shard where the best score could be, and of several such one by chance; else all the others
    whose best score could reach the query's floor. roots: shards, pivots and radii by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = [None] * batch.num_rows if home else batch.column("floor").to_pylist()
            at, shards = [], []
            for r, (uid, dim, x, floor) in enumerate(zip(batch.column("uid").to_pylist(), batch.column("dim").to_pylist(), batch.column("x").to_pylist(), floors, strict=True)):
                numbers, pivots, radius = roots[dim]
                q = np.append(_matrix([x], dim)[0].astype(np.float64), 0.0)
                base = float(q @ q) + most[dim]
                could = (base - np.maximum(np.linalg.norm(pivots - q, axis=1) - radius, 0) ** 2) / 2 + _slack(base)
                best = np.flatnonzero(could >= could.max())
                own = best[uid % len(best)]
                chosen = np.array([own]) if home else np.flatnonzero(could >= (-np.inf if floor is None else floor))
                chosen = chosen if home else chosen[chosen != own]
                at.append(np.full(len(chosen), r))
                shards.append(numbers[chosen])
            if at:
                out = batch.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(shards))], names=[*out.schema.names, "shard"])

    return run


def _search_batches(most: dict[int, int], k: int):
    """Takes, shard by shard, the pages of a tree and then queries; memory holds a tree and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pages, tree = None, [], None
        for batch in batches:
            found: list[tuple] = []
            for r in batch.to_pylist():
                if (r["shard"], r["salt"]) != here:
                    here, pages, tree = (r["shard"], r["salt"]), [], None
                if r["kind"] == 0:
                    pages.append(r)
                    continue
                if tree is None:
                    tree, pages = Tree(pages, r["dim"], most[r["dim"]]), []
                best, _ = tree.search(_matrix([r["x"]], r["dim"])[0], r["uid"], k, r["floor"])
                found += [(r["uid"], r["vec_id"], u, i, s) for s, i, u in best]
            if found:
                yield _found_batch(found)

    return run


def _found_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_uid", "query_id", "uid", "vec_id", "score"])


def _numbers(blob: bytes, norm: int | None) -> list[int]:
    return [int(c) for c in blob.split()] if norm is None else np.frombuffer(blob, "<i4").tolist()


def _plain_batches(block: list[tuple], k: int):
    """Products of Python's integers with a block of queries (uid, vec_id, components); the best k of each in this task. Scores beyond
    64 bits are the nearest 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for u, i, x, norm in zip(*(batch.column(c).to_pylist() for c in ("uid", "vec_id", "x", "norm")), strict=True):
                v = _numbers(x, norm)
                for uid, _, q in block:
                    if uid != u and len(q) == len(v):
                        s = max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(q, v, strict=True))))
                        held = best.setdefault(uid, [])
                        held.append((-s, i, u))
                        if len(held) >= 4 * k:
                            best[uid] = heapq.nsmallest(k, held)
        name = {uid: i for uid, i, _ in block}
        found = [(uid, name[uid], u, i, -s) for uid, held in best.items() for s, i, u in heapq.nsmallest(k, held)]
        if found:
            yield _found_batch(found)

    return run


class VectorIndex:
    """M-trees over all vectors of a table, written to the shared folder."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024):
        """Rows without an id, null vectors and those with a null or non-finite component take no part; vectors of different
        lengths never meet. Components become floor(scale * x), of any size; scale is a power of two. Rows that share an id are
        different rows. An empty table gives an index that finds nothing; other columns are not looked at."""
        self.spark = vectors.sparkSession
        self.scratch = Scratch(self.spark, "mtree")
        rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        self.all_rows = self.scratch.save(rows.mapInArrow(_integer_batches(scale), _VECTORS), "vectors")
        self.rows = self.all_rows.where("norm IS NOT NULL")
        stats = self.rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()
        self.most = {r.dim: r.most for r in stats}
        self.pages = None
        if not stats:
            return
        size = {}
        for r in stats:
            point = 8 * (r.dim + 1)
            size[r.dim] = max(1, min(SHARD_ROWS, SHARD_BYTES // point), -(-r.n * point * len(stats) // ROOT_BYTES))
        pivots = {}
        for r in stats:
            n = max(1, min(MOST_PIVOTS, 2 * r.n // size[r.dim]))
            some = self.rows.where(F.col("dim") == r.dim).select("x", F.xxhash64("x", "uid").alias("h")).orderBy("h").limit(n).collect()
            pivots[r.dim] = np.unique(_lifted(_matrix([s.x for s in some], r.dim), r.most), axis=0)
        deal = _Deal(pivots, self.most)
        kind = f"{_VECTORS}, first long, second long"
        counted = self.rows.mapInArrow(_group_batches(deal), kind).groupBy("dim", "first").count().collect()
        crowded = [(r.dim, r.first, -(-2 * r["count"] // size[r.dim]) / r["count"]) for r in counted if r["count"] > size[r.dim]]
        if crowded:  # pivots of their own, a sample of their vectors
            share = self.spark.createDataFrame(crowded, "dim int, first long, share double")
            chance = F.xxhash64(F.lit("pivot"), "uid", "x") / F.lit(2.0**64) + 0.5
            own = self.rows.mapInArrow(_group_batches(deal), kind).join(F.broadcast(share), ["dim", "first"]).where(chance < F.col("share")).select("dim", "first", "x").collect()
            held: dict[tuple[int, int], list[bytes]] = {}
            for r in own:
                held.setdefault((r.dim, r.first), []).append(bytes(r.x))
            deal.own = {g: np.unique(_lifted(_matrix(sorted(x), g[0]), self.most[g[0]]), axis=0) for g, x in held.items()}
        grouped = self.scratch.save(self.rows.mapInArrow(_group_batches(deal), kind), "grouped")
        # A group that is still too large has copies of few vectors: it is cut by chance.
        counts = grouped.groupBy("dim", "first", "second").count()
        limit = F.create_map(*[F.lit(x) for d, n in size.items() for x in (d, n)])[F.col("dim")]
        counts = counts.select("dim", "first", "second", F.ceil(F.col("count") / (2 * limit)).cast("long").alias("cuts"))
        counts = counts.withColumn("start", F.sum("cuts").over(W.partitionBy("dim", "first").orderBy("second")) - F.col("cuts"))
        cut = F.pmod(F.xxhash64(F.lit("cut"), "uid"), F.col("cuts"))
        dealt = grouped.join(counts, ["dim", "first", "second"]).withColumn("shard", (F.col("dim").cast("long") * MOST_PIVOTS + F.col("first")) * F.lit(2**31) + F.col("start") + cut)
        self.pages = self.scratch.save(dealt.select("shard", "dim", "uid", "vec_id", "x").groupBy("shard").applyInArrow(_build_group(self.most), f"dim int, {_PAGES}"), "pages")

    def _roots(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held: dict[int, list] = {}
        for r in self.pages.where("parent < 0").select("dim", "shard", "pivot", "radius").orderBy("shard").collect():
            held.setdefault(r.dim, []).append(r)
        return {d: (np.array([r.shard for r in rs]), np.frombuffer(b"".join(bytes(r.pivot) for r in rs), np.float64).reshape(len(rs), d + 1), np.array([r.radius for r in rs])) for d, rs in held.items()}

    def _search(self, queries: DataFrame, roots: dict, k: int, home: bool) -> DataFrame:
        """queries: uid, vec_id, dim, x and floor."""
        dealt = queries.mapInArrow(_shard_batches(roots, self.most, home), "uid long, vec_id long, dim int, x binary, floor long, shard long")
        dealt = self.scratch.save(dealt, "dealt")
        tasks = dealt.groupBy("shard").agg(F.ceil(F.count("*") / TASK_QUERIES).cast("int").alias("tasks"))
        asked = dealt.join(tasks, "shard").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("tasks"))).drop("tasks").withColumn("kind", F.lit(1))
        pages = self.pages.join(tasks, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks").cast("long") - 1))).drop("tasks").withColumn("kind", F.lit(0))
        both = pages.unionByName(asked, allowMissingColumns=True)
        placed = both.repartition(shuffle_partitions(self.spark), "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "node")
        return self.scratch.save(placed.mapInArrow(_search_batches(self.most, k), _FOUND), "found")

    def _plain(self, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame | None:
        """Every query of some with every row of some, queries in blocks."""
        found, block = None, []

        def done() -> None:
            nonlocal found, block
            if block:
                one = self.scratch.save(rows.mapInArrow(_plain_batches(block, k), _FOUND), "found")
                found, block = one if found is None else found.union(one), []

        for r in queries.select("uid", "vec_id", "x", "norm").toLocalIterator():
            block.append((r.uid, r.vec_id, _numbers(bytes(r.x), r.norm)))
            if len(block) == BLOCK_QUERIES:
                done()
        done()
        return found

    def top(self, every: int = 100, k: int = 10) -> DataFrame:
        """For each row whose id is divisible by `every`: query_id, rank (from 1), vec_id and score of the k other rows with the
        highest integer inner products (all, if there are fewer), ties to the smaller id. A score beyond 64 bits is given as the
        nearest 64-bit number, and all such are equal."""
        parts = []
        if self.pages is not None:
            roots = self._roots()
            asked = self.rows.where(F.col("vec_id") % every == 0).select("uid", "vec_id", "dim", "x")
            first = self._search(asked.withColumn("floor", F.lit(None).cast("long")), roots, k, True)
            floors = first.groupBy("query_uid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select(F.col("query_uid").alias("uid"), "floor")
            parts = [first, self._search(asked.join(floors, "uid", "left"), roots, k, False)]
        wide = self.all_rows.where("norm IS NULL")
        if not wide.isEmpty():
            queries = self.all_rows.where(F.col("vec_id") % every == 0)
            parts += [self._plain(queries, wide, k), self._plain(queries.where("norm IS NULL"), self.rows, k)]
        found = self.spark.createDataFrame([], _FOUND)
        for part in parts:
            found = found if part is None else found.union(part)
        order = W.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
