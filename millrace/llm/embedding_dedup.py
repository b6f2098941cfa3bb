"""Near duplicates among embeddings by navigable small-world graphs, one per shard.

Vectors are dealt to shards by a hash. Each shard builds a hierarchical graph: a vector is in
the layers up to a random level, and is joined to its nearest ones in each. Every vector then
queries every shard: from the top layer down, a beam of the best vectors found so far is
expanded until none of it is left to expand. What a query finds is verified by cosine in
double precision, and links are united into components.

A group of near copies has as many links as pairs, so links do not leave the task that found
them. It hands on, for each query, how many rows it linked with and one of them, and where
links joined parts of the shard that were apart, one pair for each time: never more rows than
queries and vectors, with the same components.

The beam is not fixed. After a shard is built it is audited. Copies of some of its vectors,
turned until their cosine is just the threshold, must lead back to them, and the links of these
vectors must be those that a comparison with every vector of the shard gives; the beam doubles
until enough are found. Where a beam as wide as the shard still does not find enough, as parts
of the graph cannot be reached, queries are compared with every vector of that shard instead.
A query whose whole beam is above the threshold is asked again with a beam twice as wide, so
large groups come out whole.

Equal vectors are one from the start, with the number of rows they stand for. A shard has at
most ``SHARD`` vectors and a block at most ``QUERIES`` queries, however many vectors there are;
the work of querying every shard grows with both. Every block meets every shard in a product
of two stored tables, so neither graphs nor queries are copied on disk. Graphs travel in pieces
of ``PIECE`` bytes, and a task holds one graph and one block in arrays; what a step of a search
holds is bounded by ``WIDE`` numbers, however wide the beam and however large the groups are.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; so do vectors of different lengths; rows may share an id and are vectors of their
own; a null id comes after all others as the name of a component; an empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.sortkeys import quoted
from millrace.llm.common import components, discard, mix64, prepare, stored

THRESHOLD = 0.9
#: The least number of shards, the most vectors and numbers of one, the most of a block of queries.
SHARDS = 8
SHARD = 32_768
SHARD_NUMBERS = 1 << 23
QUERIES = 16_384
BLOCK_NUMBERS = 1 << 20
#: Bytes of a graph in one row.
PIECE = 1 << 20
#: Neighbours in upper layers (twice as many in the lowest), beam while building, first beam.
NEIGHBOURS = 16
BUILD_BEAM = 48
FIRST_BEAM = 32
#: The audit: vectors asked for, and the share of turned copies and of links that must be found.
AUDIT = 256
AUDIT_RECALL = 0.99
#: The beam of a shard whose graph fails its audit: every vector is compared.
EVERY = 0
#: Queries and expansions that one step looks at together.
TOGETHER = 256
AT_ONCE = 4
#: Numbers that a step holds of vectors, and of what it has found for its queries.
AT_A_TIME = 1 << 21
WIDE = 1 << 21
#: Bytes that a step holds to know what it has seen.
SEEN = 1 << 25
#: Single precision finds candidates a little below the threshold; double precision decides.
MARGIN = 1e-4


def _layer_beam(
    vectors: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best vectors found for each query from its entry points, -1 where none.

    ``edges`` holds neighbours by row, -1 for none; ``entry`` likewise.
    """
    n, q = len(vectors), len(queries)
    row = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # where -1 points
    found, near = _scored(vectors, queries, entry, seen, row)
    found, near, done = _best(found, near, np.zeros(found.shape, bool), beam)
    active = np.arange(q)
    while len(active):
        open_near = np.where(done[active] | (found[active] < 0), -np.inf, near[active])
        width = min(AT_ONCE, open_near.shape[1])
        pick = np.argpartition(-open_near, width - 1, axis=1)[:, :width]
        at = np.arange(len(active))[:, None]
        usable = np.isfinite(open_near[at, pick])
        going = usable.any(1)
        active, pick, usable = active[going], pick[going], usable[going]
        if not len(active):
            break
        sub = active[:, None]
        done[sub, pick] |= usable
        nodes = np.where(usable, found[sub, pick], -1)
        reach = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(active), -1)
        reach.sort(1)
        reach[:, 1:][reach[:, 1:] == reach[:, :-1]] = -1
        new, new_near = _scored(vectors, queries[active], reach, seen, sub)
        f, s, d = _best(
            np.concatenate([found[active], new], 1),
            np.concatenate([near[active], new_near], 1),
            np.concatenate([done[active], np.zeros(new.shape, bool)], 1),
            beam,
        )
        if f.shape[1] > found.shape[1]:
            pad = f.shape[1] - found.shape[1]
            found = np.pad(found, ((0, 0), (0, pad)), constant_values=-1)
            near = np.pad(near, ((0, 0), (0, pad)), constant_values=-np.inf)
            done = np.pad(done, ((0, 0), (0, pad)))
        found[active], near[active], done[active] = f, s, d
    return found, near


def _scored(vectors, queries, nodes, seen, row) -> tuple[np.ndarray, np.ndarray]:
    """Nodes not seen before with their cosine, -1 where a query has fewer."""
    flat, wide = seen.reshape(-1), seen.shape[1]
    place = row * wide + np.where(nodes < 0, wide - 1, nodes)
    fresh = ~np.take(flat, place)
    flat[place] = True
    # Most places are empty: the filled ones move to the front.
    q, i = np.nonzero(fresh)
    count = np.bincount(q, minlength=len(nodes))
    new = np.full((len(nodes), count.max(initial=1)), -1, nodes.dtype)
    new[q, np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)] = nodes[q, i]
    near = np.matmul(np.take(vectors, new, axis=0, mode="wrap"), queries[:, :, None])[:, :, 0]
    near[new < 0] = -np.inf
    return new, near


def _best(found, near, done, beam):
    if found.shape[1] <= beam:
        return found, near, done
    keep = np.argpartition(-near, beam - 1, axis=1)[:, :beam]
    at = np.arange(len(found))[:, None]
    return found[at, keep], near[at, keep], done[at, keep]


class Graph:
    """Layers of neighbours over unit vectors in single precision."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], beam: int = FIRST_BEAM):
        self.vectors, self.layers, self.beam = vectors, layers, beam

    @classmethod
    def build(cls, vectors: np.ndarray, keys: np.ndarray) -> "Graph":
        """``vectors`` are unit vectors; ``keys`` decide the levels, so a retry builds the same."""
        uniform = (mix64(keys.view(np.uint64) ^ np.uint64(0xC0FFEE)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.floor(-np.log(np.maximum(uniform, 1e-300)) / np.log(NEIGHBOURS)).astype(int)
        order = np.lexsort((keys, -level))
        vectors, level = vectors[order], level[order]
        graph = cls(vectors, [])
        graph.order = order
        # Members of a layer are the first so many rows.
        sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        for k in reversed([s for s in sizes if s]):
            graph._add_layer(k, 2 * NEIGHBOURS if k == len(vectors) else NEIGHBOURS)
        return graph

    def _add_layer(self, size: int, degree: int) -> None:
        """One layer over the first ``size`` vectors, from ever larger batches of insertions."""
        edges = np.full((size, degree), -1, np.int32)
        sims = np.full((size, degree), -np.inf, np.float32)
        have = min(size, 2 * degree)
        self._connect(edges, sims, np.arange(0), np.arange(have), degree)
        while have < size:
            batch = np.arange(have, min(size, 2 * have, have + 1024))
            self._connect(edges, sims, np.arange(have), batch, degree)
            have = int(batch[-1]) + 1
        self.layers.append((np.arange(size), edges))

    def _connect(self, edges, sims, old, batch, degree) -> None:
        vectors, new, step = self.vectors, [], self._together(BUILD_BEAM)
        for start in range(0, len(batch), step):
            part = batch[start : start + step]
            own = vectors[part] @ vectors[batch].T
            own[np.arange(len(part)), part - batch[0]] = -np.inf
            found = np.broadcast_to(batch, own.shape).astype(np.int32)
            near = own
            if len(old):
                entry = self._descend(vectors[part], len(edges))
                if entry is None:
                    entry = np.broadcast_to(np.arange(min(len(old), 2 * degree)), (len(part), min(len(old), 2 * degree)))
                else:
                    entry = np.where(entry < len(old), entry, -1)
                    entry = np.concatenate([entry, np.zeros((len(part), 1), entry.dtype)], 1)
                f, s = _layer_beam(vectors[: len(old)], edges[: len(old)], vectors[part], entry, BUILD_BEAM)
                found, near = np.concatenate([found, f], 1), np.concatenate([near, s], 1)
            near = np.where(found < 0, -np.inf, near)
            width = min(degree // 2, found.shape[1])
            keep = np.argpartition(-near, width - 1, axis=1)[:, :width]
            at = np.arange(len(part))[:, None]
            f, s = found[at, keep], near[at, keep]
            a = np.repeat(part, width).astype(np.int32)
            b, value = f.ravel(), s.ravel()
            good = np.isfinite(value) & (b >= 0)
            new.append((a[good], b[good], value[good]))
        # Joined when the whole batch has been placed among the old ones.
        self._link(edges, sims, *[np.concatenate([part[k] for part in new]) for k in range(3)])

    @staticmethod
    def _link(edges, sims, a, b, value) -> None:
        """Edges both ways; a full row keeps its nearest."""
        source, target, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
        touched, place = np.unique(source, return_inverse=True)
        count = np.bincount(place)
        degree = edges.shape[1]
        by_place = np.argsort(place, kind="stable")
        first = np.cumsum(count) - count
        # Rows that get about as many, a few at a time: one may get an edge from each of a batch.
        size = np.ceil(np.log2(count)).astype(int)
        for k in np.unique(size).tolist():
            rows, step = np.flatnonzero(size == k), max(1, WIDE // (degree + (1 << k)))
            for start in range(0, len(rows), step):
                some = rows[start : start + step]
                many, at = count[some], touched[some]
                wide = np.full((len(some), degree + (1 << k)), -1, np.int32)
                strong = np.full(wide.shape, -np.inf, np.float32)
                wide[:, :degree], strong[:, :degree] = edges[at], sims[at]
                row = np.repeat(np.arange(len(some)), many)
                step_in = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                link = by_place[first[some][row] + step_in]
                wide[row, degree + step_in], strong[row, degree + step_in] = target[link], value[link]
                # An edge may come twice.
                order = np.argsort(wide, axis=1, kind="stable")
                wide, strong = np.take_along_axis(wide, order, 1), np.take_along_axis(strong, order, 1)
                strong[:, 1:][wide[:, 1:] == wide[:, :-1]] = -np.inf
                keep = np.argsort(-strong, axis=1, kind="stable")[:, :degree]
                wide, strong = np.take_along_axis(wide, keep, 1), np.take_along_axis(strong, keep, 1)
                edges[at] = np.where(np.isfinite(strong), wide, -1)
                sims[at] = strong

    def _together(self, beam: int) -> int:
        """How many queries a step looks at: what it holds for them is bounded."""
        n, d = self.vectors.shape
        gathered = 2 * NEIGHBOURS * AT_ONCE * d
        return max(1, min(TOGETHER, WIDE // max(beam, 1), SEEN // max(n, 1), AT_A_TIME // max(gathered, 1)))

    def _descend(self, queries: np.ndarray, below: int) -> np.ndarray | None:
        """Entry points for the layer of ``below`` vectors, through the layers above it."""
        entry = None
        for members, edges in self.layers:
            if len(members) >= below:
                break
            if entry is None:
                entry = np.broadcast_to(np.arange(min(len(members), 64)), (len(queries), min(len(members), 64)))
            entry, _ = _layer_beam(self.vectors[: len(members)], edges, queries, entry, 8)
        return entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = self._descend(queries, len(self.vectors))
        if entry is None:
            first = min(len(self.vectors), 64)
            entry = np.broadcast_to(np.arange(first), (len(queries), first))
        return _layer_beam(self.vectors, self.layers[-1][1], queries, entry, beam)

    def within(self, queries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query, vector)`` of all found above the threshold, a few queries at a time.

        Beams widen while they are full. What a query finds comes together.
        """
        beam, asked = self.beam, np.arange(len(queries))
        if beam == EVERY:
            step = self._together(len(self.vectors))
            for start in range(0, len(asked), step):
                q, v = np.nonzero(queries[start : start + step] @ self.vectors.T >= threshold)
                yield start + q, v
            return
        while len(asked):
            again, step = [], self._together(beam)
            for start in range(0, len(asked), step):
                part = asked[start : start + step]
                found, near = self.search(queries[part], beam)
                above = (near >= threshold) & (found >= 0)
                full = above.sum(1) >= min(beam, len(self.vectors)) - 1
                full &= beam < len(self.vectors)
                again.append(part[full])
                q, i = np.nonzero(above & ~full[:, None])
                yield part[q], found[q, i]
            asked, beam = np.concatenate(again), beam * 2

    def audit(self, threshold: float) -> float:
        """Widen the beam until turned copies lead back and links are found; the recall reached.

        It is the lesser of both shares. Where no beam is wide enough, every vector will be
        compared, which finds all.
        """
        n, d = self.vectors.shape
        if not n:
            return 1.0
        rng = np.random.default_rng(n)
        asked = rng.choice(n, min(AUDIT, n), replace=False)
        noise = rng.standard_normal((len(asked), d))
        own = self.vectors[asked].astype(np.float64)
        noise -= (noise * own).sum(1, keepdims=True) * own
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        noise = np.divide(noise, length, out=np.zeros_like(noise), where=length > 1e-9)
        turned = threshold * own + np.sqrt(1 - threshold**2) * noise
        turned = (turned / np.linalg.norm(turned, axis=1, keepdims=True)).astype(np.float32)
        links = np.zeros((len(asked), n), bool)
        step = self._together(n)
        for start in range(0, len(asked), step):
            links[start : start + step] = self.vectors[asked[start : start + step]] @ self.vectors.T >= threshold
        links[np.arange(len(asked)), asked] = False
        while True:
            back, step = 0, self._together(self.beam)
            for start in range(0, len(asked), step):
                found, _ = self.search(turned[start : start + step], self.beam)
                back += int((found == asked[start : start + step, None]).any(1).sum())
            recall = back / len(asked)
            if links.any():
                met = sum(int(links[q, v].sum()) for q, v in self.within(self.vectors[asked], threshold - MARGIN))
                recall = min(recall, met / int(links.sum()))
            if recall >= AUDIT_RECALL:
                return recall
            if self.beam >= n:
                self.beam = EVERY
                return 1.0
            self.beam *= 2


# -- tasks ----------------------------------------------------------------------------------

_GRAPH = (
    "dims int, shard int, beam int, recall double, n int, double boolean, sizes binary, "
    "total bigint, start bigint, data binary"
)
_QUERIES = "asked int, block bigint, wide boolean, keys binary, vectors binary"


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _units(exact: np.ndarray) -> np.ndarray:
    # Largest component first, so that squares neither overflow nor vanish.
    scaled = exact / np.abs(exact).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _narrow(exact: np.ndarray) -> np.ndarray:
    """In single precision where that is the same."""
    with np.errstate(over="ignore", under="ignore"):
        narrow = exact.astype(np.float32)
    return narrow if np.array_equal(narrow, exact) else exact


def _singles(exact: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    out, step = np.empty(exact.shape, np.float32), max(1, AT_A_TIME // exact.shape[1])
    for start in range(0, len(exact), step):
        out[start : start + step] = _units(exact[start : start + step].astype(np.float64))
    return out


def _build(threshold: float):
    """Rows ``(dims, shard, key, many, vector)``, sorted by shard, to the pieces of a graph a shard."""

    def close(at, keys, many, exact):
        graph = Graph.build(_singles(exact), keys)
        recall, order = graph.audit(threshold), graph.order
        arrays = [keys[order], many[order], exact[order], *(e for _, e in graph.layers)]
        sizes, double = np.array([e.shape for _, e in graph.layers], "<i4").tobytes(), exact.dtype == np.float64
        total, begin = sum(a.nbytes for a in arrays), 0
        for array in arrays:
            data = np.ascontiguousarray(array).reshape(-1).view(np.uint8)
            for start in range(0, len(data), PIECE):
                piece = data[start : start + PIECE].tobytes()
                row = [*at, graph.beam, recall, len(keys), bool(double), sizes, total, begin + start, piece]
                yield _one(row, _GRAPH)
            begin += len(data)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, parts in _grouped(batches, ["dims", "shard"]):
            keys, many, exact = [], [], []
            while parts:
                part = parts.pop(0)
                keys.append(part.column("key").to_numpy())
                many.append(part.column("many").to_numpy())
                exact.append(_narrow(_matrix(part.column("vector"))))
            yield from close(at, np.concatenate(keys), np.concatenate(many), np.concatenate(exact))

    return run


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _one(row: list, schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    values = [pa.array([value], _TYPES[kind]) for value, (_, kind) in zip(row, fields, strict=True)]
    return pa.RecordBatch.from_arrays(values, names=[name for name, _ in fields])


def _pack(queries: int):
    """Rows ``(dims, key, vector)``, sorted so, to blocks of so many queries at most."""

    def close(keys, exact):
        keys, exact = np.concatenate(keys), np.concatenate(exact)
        double = exact.dtype == np.float64
        return _one([exact.shape[1], int(keys[0]), bool(double), keys.tobytes(), exact.tobytes()], _QUERIES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, keys, exact, have = None, [], [], 0
        for batch in batches:
            for at, parts in _grouped([batch], ["dims"]):
                if at != dims and have:
                    yield close(keys, exact)
                    keys, exact, have = [], [], 0
                dims, most = at, max(1, min(queries, BLOCK_NUMBERS // at[0]))
                own, vectors = parts[0].column("key").to_numpy(), _matrix(parts[0].column("vector"))
                while len(own):
                    take = most - have
                    keys.append(own[:take])
                    exact.append(_narrow(vectors[:take]))
                    have += len(keys[-1])
                    own, vectors = own[take:], vectors[take:]
                    if have == most:
                        yield close(keys, exact)
                        keys, exact, have = [], [], 0
        if have:
            yield close(keys, exact)

    return run


def _grouped(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with the same values in ``names``. They come sorted by them."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(n).to_numpy() for n in names], 1)
        cut = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]).any(1)]))
        for start, end in zip(cut, np.append(cut[1:], len(values)), strict=True):
            here = tuple(values[start].tolist())
            if here != at and held:
                yield at, held
                held = []
            at = here
            held.append(batch.slice(start, end - start))
    if held:
        yield at, held


def _load(row: dict, data: np.ndarray) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """A graph, its keys, how many rows these stand for, and its vectors as they were."""
    n, dims, place = row["n"], row["dims"], 0

    def array(kind: str, *shape: int) -> np.ndarray:
        nonlocal place
        out = np.frombuffer(data, kind, int(np.prod(shape)), place).reshape(shape)
        place += out.nbytes
        return out

    keys, counts = array("<i8", n), array("<i8", n)
    exact = array("<f8" if row["double"] else "<f4", n, dims)
    layers = [(np.arange(k), array("<i4", k, degree)) for k, degree in np.frombuffer(row["sizes"], "<i4").reshape(-1, 2).tolist()]
    return Graph(_singles(exact), layers, row["beam"]), keys, counts, exact


class Forest:
    """Which of ``n`` vectors are known to be linked, directly or not."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take links in; pairs that join the same parts, one for each part that was a root."""
        tops, below = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return np.concatenate(tops), np.concatenate(below)
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            parent = np.arange(len(self.root))
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            hung = np.flatnonzero(parent != np.arange(len(parent)))
            tops.append(hung)
            below.append(parent[hung])
            while not np.array_equal(parent, parent[parent]):
                parent = parent[parent]
            self.root = parent[self.root]


def _verified(left: np.ndarray, right: np.ndarray, q: np.ndarray, v: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of the pairs ``(q, v)`` reach the threshold, in double precision."""
    step, good = max(1, AT_A_TIME // left.shape[1]), np.zeros(len(q), bool)
    for start in range(0, len(q), step):
        some = slice(start, start + step)
        rows, at = np.unique(v[some], return_inverse=True)
        units = _units(right[rows].astype(np.float64))
        good[some] = np.einsum("ij,ij->i", left[q[some]], units[at]) >= threshold
    return good


def _ask(threshold: float):
    """The pieces of a shard's graph, with a block of queries beside one, to ``(a, b, others)``.

    A query ``a`` that links with ``others`` rows of the shard, one of them ``b``; or two
    vectors that links join, and ``others`` is 0.
    """

    def answer(row: dict, data: np.ndarray, block: dict) -> Iterator[pa.RecordBatch]:
        graph, keys, counts, exact = _load(row, data)
        forest = Forest(len(keys))
        own = np.frombuffer(block["keys"], "<i8")
        units = np.frombuffer(block["vectors"], "<f8" if block["wide"] else "<f4").reshape(len(own), -1)
        units = _units(units.astype(np.float64))
        for q, v in graph.within(units.astype(np.float32), threshold - MARGIN):
            other = own[q] != keys[v]
            q, v = q[other], v[other]
            good = _verified(units, exact, q, v, threshold)
            q, v = q[good], v[good]
            asked, first, of = np.unique(q, return_index=True, return_inverse=True)
            others = np.zeros(len(asked), np.int64)
            np.add.at(others, of, counts[v])
            top, below = forest.join(v, v[first][of])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own[asked], keys[top]])),
                    pa.array(np.concatenate([keys[v[first]], keys[below]])),
                    pa.array(np.concatenate([others, np.zeros(len(top), np.int64)])),
                ],
                names=["a", "b", "others"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at, piece = (row["dims"], row["shard"], row["block"]), row.pop("data")
                if at not in held:
                    held[at] = [np.empty(row["total"], np.uint8), 0, None]
                held[at][0][row["start"] : row["start"] + len(piece)] = np.frombuffer(piece, np.uint8)
                held[at][1] += len(piece)
                if row["vectors"] is not None:
                    held[at][2] = row
                if held[at][1] == row["total"]:
                    data, _, block = held.pop(at)
                    yield from answer(row, data, block)
        if held:
            raise RuntimeError(f"pieces of {len(held)} graphs are missing")

    return run


def near_duplicates(
    table: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row."""
    prepare(table.sparkSession)
    rows = table.select(
        F.col(quoted(id_column)).cast("bigint").alias("id"),
        F.col(quoted(vector_column)).cast("array<double>").alias("vector"),
    )
    usable = F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0.0),
        F.lit(False),
    )
    rows = rows.withColumn("key", F.when(usable, F.xxhash64("vector")))
    classes = (
        rows.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("vector").alias("vector"))
    )
    classes = stored(classes.withColumn("dims", F.size("vector")), "classes")
    total, numbers = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("dims"), F.lit(0))).first()
    shards = max(SHARDS, -(-total * 5 // (4 * SHARD)), -(-numbers * 5 // (4 * SHARD_NUMBERS)))
    placed = classes.select(
        "dims",
        F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(shards)).cast("int").alias("shard"),
        "key",
        "many",
        "vector",
    )
    graphs = stored(
        placed.repartitionById(shards, "shard")
        .sortWithinPartitions("dims", "shard", "key")
        .mapInArrow(_build(threshold), _GRAPH),
        "graphs",
    )
    queries = stored(
        classes.select("dims", "key", "vector").sortWithinPartitions("dims").mapInArrow(_pack(QUERIES), _QUERIES), "queries"
    )
    # A block meets all pieces of a shard in one task; its queries go with the first.
    with_first = [F.when(F.col("start") == 0, F.col(c)).alias(c) for c in ("keys", "vectors")]
    found = (
        queries.hint("shuffle_replicate_nl")
        .join(graphs.repartitionById(shards, "shard"), F.col("asked") == F.col("dims"))
        .select(*[c.split()[0] for c in _GRAPH.split(", ")], "block", "wide", *with_first)
        .mapInArrow(_ask(threshold), "a long, b long, others long")
    )
    found = stored(found, "found")
    discard(graphs, queries)
    sizes = classes.select("key", "least", "many")
    degree = found.filter("others > 0").groupBy(F.col("a").alias("key")).agg(F.sum("others").alias("others"))
    group = components(found.select("a", "b"), "groups").withColumnsRenamed({"id": "key", "component_id": "root"})
    named = sizes.join(group, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = stored(named, "named")
    roots = named.groupBy(F.struct("root").alias("k")).agg(F.min("least").alias("component_id"))
    roots = roots.select("k.root", "component_id")
    final = (
        named.join(roots, "root")
        .join(degree, "key", "left")
        .select("key", "component_id", (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    )
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (
        rows.select("id", "key")
        .join(final, "key", "left")
        .select(
            "id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            component.alias("component_id"),
            F.col("id").eqNullSafe(component).alias("kept"),
        )
    )
