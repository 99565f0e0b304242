"""Embedding near-dedup on a robust-pruned flat graph.

Vectors are dealt to overlapping shards: that of their nearest centroid, and those whose border with it is within a margin
(``shards_of``), so that both ends of a link meet in the shard that holds its middle. Each shard builds a graph: a node's nearest
others, robust-pruned (a candidate is dropped when a kept one is nearer to it by the factor ``alpha`` than the node is),
with links both ways. The adjacency lists of a vector from its shards are united. Then each shard walks the united graph:
a greedy beam search from the shard's medoid finds where a vector lies, and from there the search expands over every node
within a wider range than asked, so that it follows groups of copies to their ends. All found pairs are verified in
double precision, and a sample of the nodes that have links in a shard is audited against all of it: where recall is short,
the range and the lists are widened and the shard searched again, at last by exact blocks.

A sample of all nodes is compared with every node. Its links tell the margin that is wide enough, and after the search
whether enough of them were found; if not, the search is done again at the margin that can lose none, by exact blocks.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors by a hash of the id); every vector is indexed. A shard of more
than ``SHARD`` vectors is dealt to tasks by pairs of its parts, so that a hot group never meets in one task whole and none
of its pairs is lost: within a part the graph is walked, two parts are compared by exact blocks. A pair that several shards hold is counted by the first of them. No pair leaves its task: a
shard returns a count and a local component for each vector.

Vectors that are null, zero or hold null or non-finite components are linked with nothing. Equal vectors are one node with
their number. Rows without an id get 0 links, a null component and a null ``kept``; rows that repeat an id are one vector (the smallest by
value). Vectors are linked with those of their own length; lengths of ``SHARD`` vectors at most, other than the most common
one, are compared by exact blocks. Labels and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.graph import components
from panelspark.llm.shared import bounded, written

COSINE, SAMPLE, PER_CENTROID, MOST_CENTROIDS, SHARD = 0.95, 20_000, 1200, 4096, 3000
#: Share of the margin at which no link can be lost; links point anywhere, so in 64 dimensions this is three deviations.
MARGIN = 0.375
DEGREE, CANDIDATES, ALPHA, BEAM, SLACK, RECALL, AUDIT = 24, 64, 1.2, 8, 0.06, 0.98, 40
FOUND = "node long, links long, root long"
#: Nodes compared with all others; the margins tried, as shares of the widest; links that must share a shard.
PROBES, MARGINS, TOGETHER = 4096, (MARGIN, 0.5, 0.75, 1.0), 0.995


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 2048] @ c.T).argmax(1) for a in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def border_gaps(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """How far each unit vector lies beyond each centroid's border with its nearest centroid; 0 for the nearest."""
    s = x @ centroids.T
    best = s.argmax(1)
    top = centroids[best]
    apart = np.sqrt(np.maximum((top * top).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * (top @ centroids.T), 1e-18))
    gaps = (s[np.arange(len(x)), best][:, None] - s) / apart
    gaps[np.arange(len(x)), best] = 0
    return gaps


def widest(threshold: float) -> float:
    """The margin at which no link is lost: a link's ends are this far from its middle at most, seen along any direction."""
    return float(np.sqrt(max(0.0, (1 - threshold) / 2))) + 1e-9


def shards_of(x: np.ndarray, centroids: np.ndarray, margin: float) -> list[np.ndarray]:
    """Of each unit vector the shards, ascending, whose border it lies within ``margin`` of."""
    out = []
    for a in range(0, len(x), 1024):
        v, c = np.nonzero(border_gaps(x[a : a + 1024], centroids) <= margin)
        out += np.split(c.astype(np.int32), np.searchsorted(v, np.arange(1, len(x[a : a + 1024]))))
    return out


def build(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust-pruned adjacency lists of unit vectors, made symmetric."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    k = min(candidates, n - 1)
    lists: list[list[int]] = [[] for _ in range(n)]
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        far = 2 - 2 * np.take_along_axis(s, near, 1)  # squared distances, ascending
        between = 2 - 2 * np.einsum("bid,bjd->bij", x[near], x[near])
        alive = np.ones(near.shape, bool)
        taken = np.zeros(near.shape, bool)
        for i in range(k):
            take = alive[:, i] & (taken.sum(1) < degree)
            taken[:, i] = take
            alive &= ~(take[:, None] & (alpha * alpha * between[:, i, :] <= far))
        for row in range(len(near)):
            lists[a + row] = near[row, taken[row]].tolist()
    both = [set(m) for m in lists]
    for v, m in enumerate(lists):
        for u in m:
            both[u].add(v)
    return [np.array(sorted(m), np.int64) for m in both]


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum([len(m) for m in lists])]), (np.concatenate(lists) if lists else np.zeros(0, np.int64)).astype(np.int64)


def _neighbours(at: np.ndarray, flat: np.ndarray, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    many = at[node + 1] - at[node]
    first = np.cumsum(many) - many
    return np.repeat(query, many), flat[np.repeat(at[node] - first, many) + np.arange(int(many.sum()))]


def _cosines(x: np.ndarray, q: np.ndarray, v: np.ndarray, step: int = 100_000) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", x[q[a : a + step]], x[v[a : a + step]]) for a in range(0, max(len(q), 1), step)])


def greedy(x: np.ndarray, at: np.ndarray, flat: np.ndarray, queries: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries side by side from one node; the (place of the query, node) pairs left in the beams."""
    m, n = len(queries), len(x)
    seen = np.zeros((m, n), bool)
    seen[:, start] = True
    ids = np.full((m, beam), start)
    sims = np.full((m, beam), -3.0)
    sims[:, 0] = x[queries] @ x[start]
    opened = np.zeros((m, beam), bool)
    opened[:, 1:] = True
    live = np.arange(m)
    while len(live):
        best = np.where(opened[live], -3.0, sims[live]).argmax(1)
        opened[live, best] = True
        q, v = _neighbours(at, flat, live, ids[live, best])
        fresh = ~seen[q, v]
        q, v = q[fresh], v[fresh]
        seen[q, v] = True
        s = _cosines(x, queries[q], v)
        # merge each query's beam with what is new
        rows = np.concatenate([np.repeat(live, beam), q])
        all_ids, all_sims, all_open = np.concatenate([ids[live].ravel(), v]), np.concatenate([sims[live].ravel(), s]), np.concatenate([opened[live].ravel(), np.zeros(len(v), bool)])
        order = np.lexsort((-all_sims, rows))
        rows, all_ids, all_sims, all_open = rows[order], all_ids[order], all_sims[order], all_open[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        keep = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows)))) < beam
        ids[live], sims[live], opened[live] = all_ids[keep].reshape(-1, beam), all_sims[keep].reshape(-1, beam), all_open[keep].reshape(-1, beam)
        live = live[~opened[live].all(1)]
    q, b = np.nonzero(sims > -2.5)
    return q, ids[q, b]


def expand(x: np.ndarray, at: np.ndarray, flat: np.ndarray, queries: np.ndarray, q: np.ndarray, v: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the pairs given, all pairs (place of the query, node) that a walk over nodes of at least ``reach`` cosine finds, with their cosines."""
    seen = np.zeros((len(queries), len(x)), bool)
    lost = np.setdiff1d(np.arange(len(queries)), q[v == queries[q]])  # a search that doesn't find its own query begins again there
    key = np.unique(np.concatenate([q * len(x) + v, lost * len(x) + queries[lost]]))
    q, v = key // len(x), key % len(x)
    found = []
    while len(q):
        seen[q, v] = True
        s = _cosines(x, queries[q], v)
        near = s >= reach
        q, v = q[near], v[near]
        found.append((q, v, s[near]))
        q, v = _neighbours(at, flat, q, v)
        fresh = ~seen[q, v]
        key = np.unique(q[fresh] * len(x) + v[fresh])
        q, v = key // len(x), key % len(x)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def range_search(x: np.ndarray, lists: list[np.ndarray], threshold: float, beam: int = BEAM, slack: float = SLACK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of all nodes the (node, other node) pairs found at ``threshold`` or above."""
    at, flat = _flat(lists)
    medoid = int((x @ x.mean(0)).argmax())
    for a in range(0, len(x), 256):
        queries = np.arange(a, min(a + 256, len(x)))
        q, v = greedy(x, at, flat, queries, medoid, beam)
        q, v, s = expand(x, at, flat, queries, q, v, threshold - slack)
        good = (s >= threshold) & (queries[q] != v)
        yield queries[q[good]], v[good]


def exact_pairs(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different nodes at ``threshold`` or above, both ways."""
    found = []
    for a in range(0, len(x), 512):
        i, j = np.nonzero(x[a : a + 512] @ x.T >= threshold)
        found.append((i[i + a != j] + a, j[i + a != j]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(2)) if found else (np.zeros(0, np.int64),) * 2


def cross_pairs(x: np.ndarray, left: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs at ``threshold`` or above of a node that is ``left`` and one that isn't, both ways."""
    left, right = np.flatnonzero(left), np.flatnonzero(~left)
    i, j = np.nonzero(x[left] @ x[right].T >= threshold)
    return np.concatenate([left[i], right[j]]), np.concatenate([right[j], left[i]])


def linked_probes(x: np.ndarray, lists: list[np.ndarray], threshold: float, many: int = AUDIT) -> np.ndarray:
    """Nodes that have a link, as many as there are up to ``many``, evenly spaced: a node's list holds its nearest other."""
    at, flat = _flat(lists)
    node = np.repeat(np.arange(len(x)), np.diff(at))
    near = np.unique(node[_cosines(x, node, flat) >= threshold]) if len(flat) else flat
    return near[:: max(1, len(near) // many)]


def audited_search(x: np.ndarray, lists: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The found pairs; the search is widened where a sample of the linked nodes misses some, and is exact in the end."""
    probe = linked_probes(x, lists, threshold)
    if not len(probe):
        return probe, probe
    true = x[probe] @ x.T >= threshold
    true[np.arange(len(probe)), probe] = False
    wanted = probe[np.nonzero(true)[0]] * len(x) + np.nonzero(true)[1]
    for slack, beam in ((SLACK, BEAM), (2 * SLACK, 2 * BEAM), (4 * SLACK, 4 * BEAM)):
        if slack > SLACK:
            lists = [np.union1d(m, o) for m, o in zip(lists, build(x, 2 * DEGREE, 2 * CANDIDATES, 1.0))]
        pairs = list(range_search(x, lists, threshold, beam, slack))
        q, v = (np.concatenate([p[k] for p in pairs]) for k in range(2))
        if np.isin(wanted, q * len(x) + v).sum() >= RECALL * len(wanted):
            return q, v
    return exact_pairs(x, threshold)


def probed(nodes: DataFrame, probes: np.ndarray, ids: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each probe the links it has among all ``nodes``, and of a sample of these how many share a shard from each of MARGINS on."""
    wide = np.array(MARGINS) * widest(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true, need = np.zeros(len(probes), np.int64), np.zeros(len(wide) + 1, np.int64)
        for b in batches:
            node, x, copies = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
            for a in range(0, len(x), 1024):
                i, p = np.nonzero(x[a : a + 1024] @ probes.T >= threshold)
                other = node[a + i] != ids[p]
                i, p = i[other] + a, p[other]
                np.add.at(true, p, copies[i])
                some = np.arange(0, len(i), max(1, len(i) // 2000))
                for k in range(0, len(some), 250):
                    few = some[k : k + 250]
                    gap = np.maximum(border_gaps(x[i[few]], centroids), border_gaps(probes[p[few]], centroids)).min(1)
                    need += np.bincount(np.searchsorted(wide, gap), minlength=len(need))
        at = np.flatnonzero(true)
        kind, links = np.append(at, -1 - np.arange(len(need))), np.append(true[at], need)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(links, pa.int64())], names=["kind", "links"])

    true, need = np.zeros(len(probes), np.int64), np.zeros(len(wide) + 1, np.int64)
    for r in bounded(nodes.select("node", "unit", "copies")).mapInArrow(run, "kind long, links long").groupBy("kind").agg(F.sum("links").alias("links")).collect():  # at most PROBES rows and a few
        (true if r["kind"] >= 0 else need)[r["kind"] if r["kind"] >= 0 else -1 - r["kind"]] = r["links"]
    return true, np.cumsum(need)[:-1]


def share_a_lower(shards: list[list[int]], mine: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of nodes are together in a shard before ``mine`` too."""
    node = np.repeat(np.arange(len(shards)), [len(m) for m in shards])
    shard = np.fromiter((c for m in shards for c in m), np.int64, len(node))
    node, shard = node[shard < mine], shard[shard < mine]
    known, place = np.unique(shard, return_inverse=True)
    held = np.zeros((len(shards), max(1, len(known))), bool)
    held[node, place] = True
    held = np.packbits(held, axis=1)
    return np.concatenate([(held[a[k : k + 100_000]] & held[b[k : k + 100_000]]).any(1) for k in range(0, max(1, len(a)), 100_000)])


def _normal(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``unit``, the unit vector's doubles, of the vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.and_(pc.is_valid(b.column(0)), pc.is_valid(b.column(1))))
            sizes = pc.list_value_length(b.column(1)).to_numpy()
            for n in np.unique(sizes[sizes > 0]).tolist():
                t = b.filter(pa.array(sizes == n))
                x = t.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.float64)  # a null component becomes nan
                top = np.abs(x).max(1)
                good = np.flatnonzero(np.isfinite(top) & (top > 0))
                x = x[good] / top[good, None]
                x /= np.linalg.norm(x, axis=1)[:, None]
                yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(good)), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "unit"])

    return bounded(vectors).mapInArrow(run, "vec_id long, unit binary")


def _matrix(column) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1) if parts else np.zeros((0, 1))


def _counted(ids: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray, told: np.ndarray) -> pa.Table:
    """``FOUND`` of the nodes of a task, from its pairs and which of them are counted here."""
    links = np.bincount(a[told], weights=copies[b[told]], minlength=len(ids)).astype(np.int64)
    label = np.arange(len(ids))
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pa.table({"node": pa.array(ids, pa.int64()), "links": pa.array(links), "root": pa.array(ids[label], pa.int64())})


def _searched(nodes: DataFrame, centroids: np.ndarray, margin: float, threshold: float, shard: int, exact: bool = False) -> DataFrame:
    """Of each node in each task that it is in ``node, links, root``: the links counted there and its local component."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            top = shards_of(_matrix(b.column(1)), centroids, margin)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(top, pa.list_(pa.int32()))], names=["node", "unit", "copies", "shards"])

    dealt = written(nodes.select("node", "unit", "copies").mapInArrow(near, "node long, unit binary, copies long, shards array<int>"), "dealt")
    held = dealt.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("c"))
    # a shard beyond the bound is dealt to parts of half the size, two of which meet in a task; at most MOST_CENTROIDS rows
    many = written(held.select("shard", F.when(F.col("c") > shard, 2 * F.ceil(F.col("c") / shard)).otherwise(1).cast("int").alias("parts")), "shard-parts")
    member = dealt.withColumn("shard", F.explode("shards")).join(F.broadcast(many), "shard").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def make(t: pa.Table) -> pa.Table:
        ids = t.column("node").to_numpy()
        lists = build(_matrix(t.column("unit")))
        return pa.table({"node": pa.array(ids, pa.int64()), "near": pa.array([ids[m] for m in lists], pa.list_(pa.int64()))})

    inner = member.withColumn("p", F.col("own")).withColumn("q", F.col("own"))
    cross = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("own <> other").withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    columns = ["shard", "p", "q", "own", "node", "unit", "copies", "shards"]
    if not exact:
        graph = member.groupBy("shard", "own").applyInArrow(make, "node long, near array<long>")
        united = written(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "flat-graph")
        inner = inner.join(united, "node")

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        ids, x, copies, own = t.column("node").to_numpy(), _matrix(t.column("unit")), t.column("copies").to_numpy(), t.column("own").to_numpy()
        mine, p, q = t.column("shard")[0].as_py(), t.column("p")[0].as_py(), t.column("q")[0].as_py()
        if p != q:
            a, b = cross_pairs(x, own == p, threshold)
        elif exact:
            a, b = exact_pairs(x, threshold)
        else:
            lists = []
            for m in t.column("near").to_pylist():
                m = np.array(m, np.int64)
                at = np.minimum(np.searchsorted(ids, m), len(ids) - 1)
                lists.append(at[ids[at] == m])
            a, b = audited_search(x, lists, threshold)
        # the first shard that both are in counts the pair
        lower = share_a_lower(t.column("shards").to_pylist(), mine, a, b)
        return _counted(ids, copies, a, b, ~lower)

    inside = inner.select(*columns, *([] if exact else ["near"])).groupBy("shard", "p", "q").applyInArrow(search, FOUND)
    return written(inside.unionByName(cross.select(*columns).groupBy("shard", "p", "q").applyInArrow(search, FOUND)), "found")


def _found(nodes: DataFrame, width: int, n: int, threshold: float, sample: int, shard: int, per_centroid: int) -> DataFrame:
    """``FOUND`` of the ``n`` nodes, all of one width."""
    taken = nodes.select("node", "unit", F.xxhash64("node").alias("h")).orderBy("h").limit(sample + PROBES).collect()
    x = np.frombuffer(b"".join(bytes(r["unit"]) for r in taken), np.float64).reshape(len(taken), width)
    probes, ids = x[-PROBES:], np.array([r["node"] for r in taken[-PROBES:]], np.int64)  # not of the fitted ones, where there are others
    x = x[:sample]
    centroids = spherical_kmeans(x, max(1, min(MOST_CENTROIDS, -(-n // per_centroid), len(x))))
    true, together = probed(nodes, probes, ids, centroids, threshold)
    enough = np.flatnonzero(together >= TOGETHER * together[-1])
    found = _searched(nodes, centroids, MARGINS[enough[0]] * widest(threshold), threshold, shard)
    if true.any():
        asked = nodes.sparkSession.createDataFrame([(int(i),) for i in ids[true > 0]], "node long")
        got = found.join(F.broadcast(asked), "node").agg(F.sum("links").alias("links")).first()["links"] or 0
        if got < RECALL * true.sum():
            found = _searched(nodes, centroids, widest(threshold), threshold, shard, exact=True)
    return found


def link(vectors: DataFrame, threshold: float = COSINE, sample: int = SAMPLE, shard: int = SHARD, per_centroid: int = PER_CENTROID) -> DataFrame:
    """Each row's ``vec_id, n_links, component_id, kept`` from its ``vec_id`` and ``embedding``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = _normal(rows).groupBy("vec_id").agg(F.min("unit").alias("unit"))
    units = written(units, "units")
    nodes = written(units.groupBy("unit").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
    width = (F.octet_length("unit") / 8).cast("int")
    sizes = {r["w"]: r["n"] for r in nodes.groupBy(width.alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    common = min(sizes, key=lambda w: (-sizes[w], w), default=None)
    large = sorted(w for w, n in sizes.items() if n > shard or w == common)

    def few(t: pa.Table) -> pa.Table:
        a, b = exact_pairs(_matrix(t.column("unit")), threshold)
        return _counted(t.column("node").to_numpy(), t.column("copies").to_numpy(), a, b, np.ones(len(a), bool))

    parts = [_found(nodes.where(width == w), w, sizes[w], threshold, sample, shard, per_centroid) for w in large]
    if len(large) < len(sizes) or not parts:
        small = nodes.where(~width.isin(large)).withColumn("w", width)
        parts.append(written(small.groupBy("w").applyInArrow(lambda t: few(t.sort_by("node")), FOUND), "found-few"))
    found = reduce(DataFrame.unionByName, parts)
    whole = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(counts, "node").join(whole.select("node", "component"), "node", "left").select("unit", (F.col("links") + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    linked = units.join(named, "unit").select("vec_id", "links", "component")
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
