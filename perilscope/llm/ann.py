"""Nearest neighbours by inner product over balanced posting lists.

Inner products become distances by one more coordinate: rows are lifted to the
largest norm, queries get a zero there and that norm. Centroids are fitted by
k-means with a penalty on large clusters, on a bounded sample (``SAMPLE`` vectors); they
are linked in a graph of near neighbours, which every task holds in memory and searches
by a beam. All vectors go to their nearest list, and those near a boundary to up to
``REPLICAS`` lists. A query searches the graph too and reads the lists of its beam whose
distance is at most a ratio times that of the nearest one, so how many it reads depends on where it lies. Beam and ratio follow the data: ``ASKED``
queries are answered by brute force over all rows, the beam is doubled until it holds lists of their neighbours (up to all lists), and
the ratio is the smallest that gives ``RECALL``. Lists are read in chunks of ``CHUNK`` vectors, so equal vectors or a crowded region
make more chunks and no larger task. A query that found fewer than ``k`` reads all lists.

Scores are computed in double precision from the original vectors, always in the same way.

Defined results: null, zero or non-finite vectors, null ids and vectors of another than the most
frequent length take no part; rows with the query's id are never its results; of repeated ids
the largest score counts; with fewer than ``k`` candidates all are returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.session import materialise

SAMPLE = 20_000
LIST = 400  # vectors per list aimed at
MAX_LISTS = 4096
REPLICAS = 4
REPLICA_RATIO = 1.15
PROBES = 32  # beam that is tried first
ASKED = 256  # queries answered by brute force to find beam and ratio
RECALL = 0.97  # of their neighbours
DEGREE = 16
HOME_BEAM = 12  # lists kept while searching for a vector's own
WORK = 1 << 21  # numbers that a step of the search holds, about
BLOCK = 1024  # rows compared with all centroids at a time
CHUNK = 4096


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    raw = b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist())
    return np.frombuffer(raw, np.float64).reshape(-1, dim)


def _ids(batch: pa.RecordBatch, name: str = "id") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy()


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id``, ``v`` (doubles as bytes) and ``norm`` of the vectors that take part."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for id_, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if id_ is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    rows.append((id_, x.tobytes(), float(np.sqrt((x * x).sum()))))
            ids, raw, norms = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(norms, pa.float64())], names=["id", "v", "norm"]
            )

    return vectors.select(F.col(key).cast("bigint"), vector).mapInArrow(run, "id long, v binary, norm double")


@dataclass
class Index:
    """Centroids of lifted vectors and their neighbour graph."""

    centroids: np.ndarray
    graph: np.ndarray
    entry: np.ndarray
    top: float  # the largest norm

    @property
    def lengths(self) -> np.ndarray:
        return np.square(self.centroids).sum(axis=1)

    @classmethod
    def fit(cls, sample: np.ndarray, top: float, n_lists: int, seed: int = 5, rounds: int = 12) -> Index:
        x = lift(sample, top)
        rng = np.random.default_rng(seed)
        n_lists = min(n_lists, len(x))
        centroids = x[rng.choice(len(x), n_lists, replace=False)].copy()
        size = np.full(n_lists, len(x) / n_lists)
        near = 0.0
        for _ in range(rounds):
            # a list twice as large as the mean looks farther by half the usual distance
            label, near = _labels(x, centroids, 0.5 * near * np.maximum(size * n_lists / len(x) - 1, 0))
            size = np.bincount(label, minlength=n_lists)
            full = np.flatnonzero(size)
            sums = np.add.reduceat(x[np.argsort(label, kind="stable")], (np.cumsum(size) - size)[full], axis=0)
            centroids[full] = sums / size[full, None]
            empty = np.flatnonzero(size == 0)
            if len(empty):
                centroids[empty] = x[rng.choice(len(x), len(empty))] + 1e-9 * rng.standard_normal((len(empty), x.shape[1]))
        # a ring keeps the graph connected
        graph = np.concatenate([_near_centroids(centroids), (np.arange(n_lists)[:, None] + 1) % n_lists], axis=1)
        entry = rng.choice(n_lists, min(16, n_lists), replace=False)
        return cls(centroids, graph, entry, top)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's lists of each lifted vector, nearest first, and their distances."""
        n, k = len(x), len(self.centroids)
        width = min(beam, k)
        ids = np.full((n, width), -1, dtype=np.int64)
        dist = np.full((n, width), np.inf)
        seen = np.zeros((n, k), dtype=bool)
        done = np.zeros((n, k), dtype=bool)
        rows = np.arange(n)
        self._add(x, ids, dist, seen, rows, np.tile(self.entry, (n, 1)))
        some = max(1, width // 8)  # nodes whose neighbours are looked at in one step
        while len(rows):
            open_ = np.where((ids[rows] >= 0) & ~done[rows[:, None], ids[rows]], dist[rows], np.inf)
            best = np.argpartition(open_, some - 1, axis=1)[:, :some] if some < width else np.tile(np.arange(width), (len(rows), 1))
            away = np.take_along_axis(open_, best, 1)
            first = np.take_along_axis(best, away.argmin(axis=1)[:, None], 1)
            more = np.isfinite(away).any(axis=1)
            best = np.where(np.isfinite(away), best, first)[more]
            rows = rows[more]
            if not len(rows):
                break
            node = np.take_along_axis(ids[rows], best, 1)
            done[rows[:, None], node] = True
            self._add(x, ids, dist, seen, rows, self.graph[node].reshape(len(rows), -1))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))

    def _add(self, x, ids, dist, seen, rows, new) -> None:
        own = x[rows]
        d = np.square(own).sum(axis=1)[:, None] + self.lengths[new] - 2 * np.einsum("nd,nmd->nm", own, self.centroids[new])
        d = np.maximum(d, 0)
        d[seen[rows[:, None], new]] = np.inf
        first = np.zeros(new.shape, dtype=bool)  # a node listed twice counts once
        order = np.argsort(new, axis=1, kind="stable")
        ranked = np.take_along_axis(new, order, 1)
        np.put_along_axis(first, order, np.concatenate([np.ones((len(new), 1), bool), ranked[:, 1:] != ranked[:, :-1]], axis=1), 1)
        d[~first] = np.inf
        seen[rows[:, None], new] = True
        all_ids, all_dist = np.concatenate([ids[rows], new], 1), np.concatenate([dist[rows], d], 1)
        keep = np.argsort(all_dist, axis=1, kind="stable")[:, : ids.shape[1]]
        ids[rows] = np.where(np.isfinite(np.take_along_axis(all_dist, keep, 1)), np.take_along_axis(all_ids, keep, 1), -1)
        dist[rows] = np.take_along_axis(all_dist, keep, 1)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their lists: the nearest, and others within the ratio that are not behind one already taken."""
        ids, dist = self.search(lift(x, self.top), HOME_BEAM)
        near = self.centroids[ids]
        length = self.lengths[ids]
        between = np.sqrt(np.maximum(length[:, :, None] + length[:, None, :] - 2 * near @ near.transpose(0, 2, 1), 0))
        taken = np.zeros(ids.shape, dtype=bool)
        taken[:, 0] = True
        for k in range(1, ids.shape[1]):
            free = (between[:, k, :] >= 0.5 * dist[:, k, None]) | ~taken
            near_enough = (ids[:, k] >= 0) & (dist[:, k] <= REPLICA_RATIO * dist[:, 0])
            taken[:, k] = near_enough & free.all(axis=1) & (taken.sum(axis=1) < REPLICAS)
        row, place = np.nonzero(taken)
        return row, ids[row, place]

    def beam(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists in each query's beam (-1: none), and their distances in units of the nearest one's."""
        scaled = q * (self.top / np.sqrt((q * q).sum(axis=1, keepdims=True)))
        ids, dist = self.search(np.concatenate([scaled, np.zeros((len(q), 1))], axis=1), beam)
        return ids, dist / np.maximum(dist[:, :1], 1e-6 * self.top)

    def probes(self, q: np.ndarray, beam: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the lists they read: the nearest, and those of the beam within the ratio."""
        ids, away = self.beam(q, beam)
        read = (ids >= 0) & (away <= ratio)
        read[:, 0] = True
        row, place = np.nonzero(read)
        return row, ids[row, place]


def _labels(x: np.ndarray, centroids: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, float]:
    """Nearest centroid of each row under the penalty, and the mean square distance to the nearest one without it."""
    label, total = np.empty(len(x), dtype=np.int64), 0.0
    for at in range(0, len(x), BLOCK):
        distance = _square_distances(x[at : at + BLOCK], centroids)
        total += distance.min(axis=1).sum()
        label[at : at + BLOCK] = (distance + penalty).argmin(axis=1)
    return label, total / len(x)


def _near_centroids(centroids: np.ndarray) -> np.ndarray:
    """The nearest others of every centroid; itself, if it is the only one."""
    n = len(centroids)
    if n == 1:
        return np.zeros((1, 1), dtype=np.int64)
    degree = min(DEGREE, n - 1)
    out = np.empty((n, degree), dtype=np.int64)
    for at in range(0, n, BLOCK):
        distance = _square_distances(centroids[at : at + BLOCK], centroids)
        distance[np.arange(len(distance)), at + np.arange(len(distance))] = np.inf
        out[at : at + BLOCK] = np.argpartition(distance, degree - 1, axis=1)[:, :degree]
    return out


def _rows_a_step(beam: int, dim: int, most: int) -> int:
    return max(1, min(most, WORK // (beam * dim)))


def lift(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.maximum(top * top - (x * x).sum(axis=1, keepdims=True), 0)
    return np.concatenate([x, np.sqrt(rest)], axis=1)


def _square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest found of every row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    asked = vectors.select(F.col(key), F.col(vector), is_query.alias("q"))
    repeated = usable(asked, key, vector).groupBy("id", "v").agg(F.first("norm").alias("norm"), F.count(F.lit(1)).alias("times"))
    rows = materialise(repeated, "vectors")
    lengths = rows.groupBy((F.octet_length("v") / 8).cast("int").alias("dim")).agg(
        F.sum("times").alias("times"), F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")
    )
    common = lengths.orderBy(F.desc("times"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim, n, top = common["dim"], common["n"], common["top"]
    rows = rows.where(F.octet_length("v") == dim * 8)
    queries = asked.where("q").select(F.col(key).cast("bigint").alias("id")).distinct().join(rows, "id", "left_semi")
    queries = rows.join(queries, "id", "left_semi").select("id", "v")
    share = F.pmod(F.xxhash64(F.lit("sample"), "id", "v"), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30)
    sample = np.frombuffer(b"".join(r["v"] for r in rows.where(share).orderBy("id", "v").limit(2 * SAMPLE).collect()), np.float64).reshape(-1, dim)
    if not len(sample):
        sample = np.frombuffer(rows.first()["v"], np.float64).reshape(1, dim)
    index = spark.sparkContext.broadcast(Index.fit(sample, top, max(1, min(MAX_LISTS, -(-n // LIST)))))

    def post(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _rows_a_step(HOME_BEAM, dim, 2048)
        for batch in stream:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                yield _dealt(part, *index.value.homes(_matrix(part, "v", dim)))

    beam, ratio = _calibrated(rows, queries, index, dim, k)

    def ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _rows_a_step(beam, dim, 512)
        for batch in stream:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                yield _dealt(part, *index.value.probes(_matrix(part, "v", dim), beam, ratio))

    placed = "list int, id long, v binary"
    lists = rows.select("id", "v").mapInArrow(post, placed)
    # at most MAX_LISTS rows
    chunks = F.broadcast(
        materialise(lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "lists")
    )
    postings = lists.join(chunks, "list").select("list", F.pmod(F.xxhash64("id", "v"), F.col("chunks")).cast("int").alias("chunk"), "id", "v")
    found = materialise(_merged(_read(postings, queries.mapInArrow(ask, placed), chunks, dim, k), k), "nearest")
    reach = rows.select("id").distinct().limit(k + 1).count() - 1  # all candidates of a query, if these are fewer than k
    short = queries.join(found.groupBy("query_id").agg(F.max("rank").alias("n")).withColumnRenamed("query_id", "id"), "id", "left").where(
        F.coalesce("n", F.lit(0)) < min(k, reach)
    ).select("id", "v")
    if short.head() is None:
        return found
    every_list = F.sequence(F.lit(0), F.lit(len(index.value.centroids) - 1))
    everywhere = short.select(F.explode(every_list).alias("list"), "id", "v")
    more = _merged(_read(postings, everywhere, chunks, dim, k), k)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)


def _calibrated(rows: DataFrame, queries: DataFrame, index, dim: int, k: int) -> tuple[int, float]:
    """Beam and distance ratio with which ``ASKED`` queries find ``RECALL`` of their true neighbours.

    A task compares its rows with these queries and keeps the best ``k`` ids of each, with their
    lists; the best of all tasks, ``ASKED`` times ``k`` rows, come to the driver.
    """
    n_lists = len(index.value.centroids)
    asked = queries.orderBy(F.xxhash64(F.lit("probes"), "id", "v"), "id", "v").limit(ASKED).collect()
    if n_lists == 1 or not asked:
        return 1, 1.0
    own = np.array([r["id"] for r in asked], dtype=np.int64)
    q = np.frombuffer(b"".join(r["v"] for r in asked), np.float64).reshape(-1, dim)
    shared = rows.sparkSession.sparkContext.broadcast((own, q))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        pair, score, held = np.zeros((0, 2), np.int64), np.zeros(0), np.zeros((0, dim))
        for batch in stream:
            names, matrix = _ids(batch), _matrix(batch, "v", dim)
            for at in range(0, len(batch), CHUNK):
                some = slice(at, at + CHUNK)
                asker, row, new = _nearest_rows(own, q, names[some], matrix[some], k)
                pair = np.concatenate([pair, np.stack([asker, names[some][row]], 1)])
                score, held = np.concatenate([score, new]), np.concatenate([held, matrix[some][row]])
                top, _ = _top(pair, score, k)
                pair, score, held = pair[top], score[top], held[top]
        step = _rows_a_step(HOME_BEAM, dim, 2048)
        for at in range(0, len(pair), step):
            row, lists = index.value.homes(held[at : at + step])
            ends = np.append(np.searchsorted(row, np.arange(len(held[at : at + step]))), len(row)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[at : at + step, 0]), pa.array(pair[at : at + step, 1]), pa.array(score[at : at + step]),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.astype(np.int32)))],
                names=["query_id", "vec_id", "score", "lists"],
            )

    near = materialise(rows.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score double, lists array<int>"), "near")
    best = _merged(near.select("query_id", "vec_id", "score"), k).drop("rank")
    homes = best.join(near, ["query_id", "vec_id", "score"]).groupBy("query_id", "vec_id").agg(F.max("lists").alias("lists")).collect()
    if not homes:
        return 1, 1.0
    beam = min(PROBES, n_lists)
    while True:
        step = _rows_a_step(beam, dim, 512)
        least = np.full((len(q), n_lists), np.inf)
        for at in range(0, len(q), step):
            ids, away = index.value.beam(q[at : at + step], beam)
            row, place = np.nonzero(ids >= 0)
            least[at + row, ids[row, place]] = away[row, place]
        needed = np.sort([least[r["query_id"], r["lists"]].min() for r in homes])
        # more than needed is in the beam, so that the ratio decides
        if beam == n_lists or np.isfinite(needed).mean() >= (1 + RECALL) / 2:
            return beam, float(needed[int(np.ceil(RECALL * len(needed))) - 1]) * (1 + 1e-9)
        beam = min(2 * beam, n_lists)


def _dealt(part: pa.RecordBatch, row: np.ndarray, lists: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(lists.astype(np.int32)), *(part.column(part.schema.get_field_index(c)).take(at) for c in ("id", "v"))],
        names=["list", "id", "v"],
    )


def _read(postings: DataFrame, probes: DataFrame, chunks: DataFrame, dim: int, k: int) -> DataFrame:
    """The best of every chunk that a query reads. A task holds one chunk; queries stream past it."""
    spread = probes.join(chunks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "v")
    both = postings.withColumn("kind", F.lit(0)).unionByName(spread.withColumn("kind", F.lit(1)))
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, held = None, [], []
        matrix = None
        for batch in stream:
            where = np.stack([_ids(batch, c).astype(np.int64) for c in ("list", "chunk", "kind")], 1)
            bounds = np.append(np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(axis=1))), len(where))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = batch.slice(a, b - a)
                if place != tuple(where[a, :2]):
                    place, ids, held, matrix = tuple(where[a, :2]), [], [], None
                if where[a, 2] == 0:
                    ids.append(_ids(part))
                    held.append(_matrix(part, "v", dim))
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix, names = np.concatenate(held), np.concatenate(ids)
                for at in range(0, b - a, 512):
                    block = part.slice(at, 512)
                    yield _best(_ids(block), _matrix(block, "v", dim), names, matrix, k)

    rows = both.repartition(n, "list", "chunk").sortWithinPartitions("list", "chunk", "kind")
    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _best(query: np.ndarray, q: np.ndarray, names: np.ndarray, matrix: np.ndarray, k: int) -> pa.RecordBatch:
    at, row, score = _nearest_rows(query, q, names, matrix, k)
    return pa.RecordBatch.from_arrays([pa.array(query[at]), pa.array(names[row]), pa.array(score)], names=["query_id", "vec_id", "score"])


def _nearest_rows(query: np.ndarray, q: np.ndarray, names: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, row and score of the best ``k`` different ids of each query; of an id its best row."""
    rough = q @ matrix.T
    rough[query[:, None] == names[None, :]] = -np.inf
    order = np.argsort(names, kind="stable")
    opens = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1]))
    by_id = rough if len(opens) == len(names) else np.maximum.reduceat(rough[:, order], opens, axis=1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in range(len(query)):
        row = rough[i]
        least = np.partition(by_id[i], len(opens) - k)[len(opens) - k] if len(opens) > k else -np.inf
        near = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & np.isfinite(row)) if np.isfinite(least) else np.flatnonzero(np.isfinite(row))
        score = (matrix[near] * q[i]).sum(axis=1)
        order = np.lexsort((names[near], -score))
        first = np.sort(np.unique(names[near[order]], return_index=True)[1])[:k]
        taken = order[first]
        out.append((np.full(len(taken), i), near[taken], score[taken]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _top(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the best ``k`` different ids (second column) of each query (first column), by query and score, and their ranks from 0."""
    rows = np.lexsort((-score, ids[:, 1], ids[:, 0]))
    new = np.append(True, (ids[rows][1:] != ids[rows][:-1]).any(axis=1)) if len(ids) else np.zeros(0, bool)
    rows = rows[new]
    rows = rows[np.lexsort((ids[rows, 1], -score[rows], ids[rows, 0]))]
    query = ids[rows, 0]
    begins = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
    return rows[rank < k], rank[rank < k]


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` different ids of each query over all chunks."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, 2), np.int64), np.zeros(0)
        for batch in stream:
            ids = np.concatenate([best[0], np.stack([_ids(batch, c) for c in ("query_id", "vec_id")], 1)])
            score = np.concatenate([best[1], _ids(batch, "score")])
            top, _ = _top(ids, score, k)
            best = ids[top], score[top]
        ids, score = best
        rank = _top(ids, score, k)[1] + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[:, 0]), pa.array(rank.astype(np.int32)), pa.array(ids[:, 1]), pa.array(score)], names=["query_id", "rank", "vec_id", "score"]
        )

    return found.repartition(n, "query_id").mapInArrow(run, "query_id long, rank int, vec_id long, score double")
