"""N-gram Jaccard join of whole texts by grouped prefixes.

A text is the set of its distinct shingles (64-bit hashes). A ``Rule`` gives their words and the least
similarity of a link, by default 3 words and 0.9. All sets are
ordered alike: shingles seen in few texts first, frequent ones last, by hash inside
either class. Two sets of Jaccard similarity t share at least ``COMMON`` of their first
``n - ceil(t * n) + COMMON`` shingles in that order.

1. One scan counts all shingles in 2^26 cells (a cell above the limit is frequent)
   and gives every set a name, so that equal sets are one node, and four short keys.
2. A node that shares a key is compared with three nodes of like size of that key only,
   however large a group of near copies is. What these pairs link is one component.
3. Nodes with the same prefix and size are one group. Group pairs that meet in
   prefix shingles are filtered by size, by position and by the number of common
   prefix shingles; pairs inside one component are left out, as they cannot change it.
4. What is left is expanded to members and verified on the whole sets. Steps 3 and 4 are
   exact: every link between two components is found.

Only bitmaps of fixed size are sent to all tasks. Defined results: a null text or one without
words has no shingles, links with nothing and is its own component; equal rows
and equal texts link; a null key is never a component's id unless all its keys are null; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.llm import counts as C
from perilscope.llm import words as W
from perilscope.llm.components import components
from perilscope.llm.groups import join_groups
from perilscope.session import job_folder, materialise

COMMON = 4  # prefix shingles a pair has in common, or ``Rule.floor`` if that is less
CELL_BITS = 26  # cells of shingles
NODE_BITS = 24  # cells of nodes
PIECE_BITS = 20  # cells counted by one task at a time
FREQUENT = 16  # texts, or four times the mean of a cell if that is more
KEYS = 4
PAIRS = 2_000_000  # pairs a task looks at together
BAND = 0.1  # width of a band of sizes, as a logarithm
STAR = 256  # partners of one node that are verified by one task


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of ``width`` words link at a similarity of ``part / whole`` (below 1)."""

    width: int = 3
    part: int = 9
    whole: int = 10

    def least_size(self, n):
        """The least size of a set, and the least intersection, that links with a set of size ``n``."""
        return -(-self.part * n // self.whole)

    def least_common(self, both_sizes):
        """The least intersection of two linked sets whose sizes have this sum."""
        return -(-self.part * both_sizes // (self.part + self.whole))

    @property
    def floor(self) -> int:
        """The least size of a set that links with another than itself."""
        return int(self.least_size(-(-self.whole // (self.whole - self.part))))

    @property
    def common(self) -> int:
        return min(COMMON, self.floor)


RULE = Rule()


class Sets:
    """Distinct shingles of the rows of a slice, sorted by hash inside each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingle: int = RULE.width):
        data = W.lowered(data)
        starts, ends, first = W.spans(data, offsets, W.NON_SPACE)
        word = W.hashes(data, starts, ends)
        n_words = np.diff(first)
        size = np.maximum(n_words - shingle + 1, np.minimum(n_words, 1))
        owner = np.repeat(np.arange(len(n_words)), size)
        at = W.ragged(size, first[:-1])
        width = np.minimum(n_words, shingle)[owner]
        word = np.concatenate([word, np.zeros(shingle, np.uint64)])
        hash_ = W.mix(word[at] + np.uint64(1))
        with np.errstate(over="ignore"):
            for k in range(1, shingle):
                hash_ = np.where(width > k, W.mix(hash_ * np.uint64(3) + word[at + k]), hash_)
        bounds = np.concatenate([[0], np.cumsum(size)])
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            hash_[a:b].sort()
        new = np.ones(len(hash_), dtype=bool)
        new[1:] = (hash_[1:] != hash_[:-1]) | (owner[1:] != owner[:-1])
        self.hash, self.owner = hash_[new], owner[new]
        self.size = np.bincount(self.owner, minlength=len(n_words))
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sums of 64-bit values by row, modulo 2^64."""
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        with np.errstate(over="ignore"):
            return running[self.first[1:]] - running[self.first[:-1]]

    def nodes(self) -> np.ndarray:
        """A name for each set; equal sets have equal names."""
        with np.errstate(over="ignore"):
            return W.mix(self.total(W.mix(self.hash)) + self.size.astype(np.uint64)).view(np.int64)

    def keys(self) -> np.ndarray:
        """For each row (column) the hash of four neighbouring shingles from each quarter of the hash space on."""
        out = np.zeros((KEYS, len(self.size)), dtype=np.uint64)
        n = np.maximum(self.size, 1)
        for q in range(KEYS):
            below = self.total((self.hash < np.uint64(q << 62)).astype(np.uint64)).astype(np.int64)
            with np.errstate(over="ignore"):
                for k in range(4):
                    at = np.minimum(self.first[:-1] + (below + k) % n, max(len(self.hash) - 1, 0))
                    if len(self.hash):
                        out[q] += W.mix(self.hash[at] + np.uint64(q))
        return W.mix(out)


# --- cells ------------------------------------------------------------------

def _packed(cells: np.ndarray) -> bytes:
    """Sorted cells as gaps of one byte; 255 adds 255 and gives no cell."""
    gaps = np.diff(cells, prepend=0)
    many = gaps // 255
    out = np.full(int((many + 1).sum()), 255, dtype=np.uint8)
    out[np.cumsum(many + 1) - 1] = gaps % 255
    return out.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _cell_rows(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    cells = np.sort((hashes >> np.uint64(64 - bits)).astype(np.int64))
    pieces = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, 1 << PIECE_BITS))
    for p in np.flatnonzero(np.diff(pieces)).tolist():
        yield p, _packed(cells[pieces[p] : pieces[p + 1]] - (p << PIECE_BITS))


def _bitmap(cells: DataFrame, bits: int, least: int, mean_times: int) -> np.ndarray:
    """One bit per cell (2^``bits`` in all, whatever the input) that was seen ``least`` times, and
    ``mean_times`` the mean of its piece."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in stream:
            for k in range(len(batch)):
                piece = C.value(batch, "piece", k)
                if piece not in seen:
                    seen[piece] = np.zeros(1 << PIECE_BITS, dtype=np.int32)
                seen[piece] += np.bincount(_unpacked(C.value(batch, "cells", k)), minlength=1 << PIECE_BITS).astype(np.int32)
        for piece in list(seen):
            n = seen.pop(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.int32()), pa.array([np.packbits(n >= max(least, mean_times * n.mean())).tobytes()], pa.binary())],
                names=["piece", "cells"],
            )
        W.release()

    n = 1 << (bits - PIECE_BITS)
    rows = cells.select("piece", "cells").repartition(n, "piece").mapInArrow(count, "piece int, cells binary").collect()
    found = np.zeros((n, 1 << (PIECE_BITS - 3)), dtype=np.uint8)
    for r in rows:
        found[r["piece"]] = np.frombuffer(r["cells"], np.uint8)
    return found.reshape(-1)


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = (hashes >> np.uint64(61 - (len(bitmap) - 1).bit_length())).astype(np.int64)
    return (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0


def _node_cells(nodes: DataFrame) -> DataFrame:
    """Cells of the distinct values of ``node``."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            values = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            rows = list(_cell_rows(np.unique(W.mix(values)), NODE_BITS))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=["piece", "cells"]
            )

    return nodes.select("node").mapInArrow(run, "piece int, cells binary")


# --- scans of the texts -------------------------------------------------------

def _signatures(docs: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """Key, size, node and short keys of every row; and the packed cells of all shingles."""
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("piece", T.IntegerType()), T.StructField("cells", T.BinaryType()),
    ])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.let_go()
        held: list[np.ndarray] = []

        def flush(like: pa.DataType) -> Iterator[pa.RecordBatch]:
            rows = list(_cell_rows(np.concatenate(held), CELL_BITS))
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, like), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())),
                 pa.array([p for p, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())],
                names=[f.name for f in schema.fields],
            )

        like = None
        for batch, data, offsets in W.batches(stream, text):
            names = batch.column(batch.schema.get_field_index(key))
            like = names.type
            sets = Sets(data, offsets, rule.width)
            nodes, keys, n = sets.nodes(), sets.keys().view(np.int64), len(batch)
            lists = [keys[:, r].tolist() if sets.size[r] >= rule.floor else None for r in range(n)]
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(sets.size.astype(np.int64)), pa.array(nodes), pa.array(lists, pa.list_(pa.int64())),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=[f.name for f in schema.fields],
            )
            _, one = np.unique(nodes, return_index=True)  # equal sets of a slice count once
            once = np.zeros(n, dtype=bool)
            once[one] = True
            held.append(sets.hash[once[sets.owner]])
            if sum(map(len, held)) >= C.FLUSH:
                yield from flush(like)
                held = []
        if held:
            yield from flush(like)

    folder = job_folder(docs.sparkSession, "signatures")
    docs.select(key, text).mapInArrow(run, schema).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _prefixes(docs: DataFrame, text: str, frequent, wanted, rule: Rule) -> DataFrame:
    """Node, size, number of rare shingles, group and prefix of every set that can link, and the whole set of the wanted nodes."""
    schema = "node long, n long, early long, gid long, prefix binary, hashes binary"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.batches(stream, text):
            sets = Sets(data, offsets, rule.width)
            nodes = sets.nodes()
            _, one = np.unique(nodes, return_index=True)
            rows = one[sets.size[one] >= rule.floor]
            late = _marked(frequent.value, sets.hash)
            early = np.cumsum(~late)
            before = np.concatenate([[0], early])[sets.first]
            n_early = np.diff(before)
            place = np.arange(len(late)) - sets.first[sets.owner]
            rank_early = early - 1 - before[sets.owner]
            rank = np.where(late, n_early[sets.owner] + place - (early - before[sets.owner]), rank_early)
            length = np.minimum(sets.size - rule.least_size(sets.size) + rule.common, sets.size)
            ordered = np.empty_like(sets.hash)
            ordered[sets.first[sets.owner] + rank] = sets.hash
            keep = _marked(wanted.value, W.mix(nodes.view(np.uint64)))
            prefix = [ordered[sets.first[r] : sets.first[r] + length[r]] for r in rows.tolist()]
            with np.errstate(over="ignore"):
                gid = [int(W.mix(W.mix(p).sum(dtype=np.uint64, keepdims=True) + np.uint64(sets.size[r])).view(np.int64)[0]) for p, r in zip(prefix, rows.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes[rows]),
                    pa.array(sets.size[rows].astype(np.int64)),
                    pa.array(n_early[rows].astype(np.int64)),
                    pa.array(gid, pa.int64()),
                    pa.array([p.tobytes() for p in prefix], pa.binary()),
                    pa.array([sets.hash[sets.first[r] : sets.first[r + 1]].tobytes() if keep[r] else None for r in rows.tolist()], pa.binary()),
                ],
                names=["node", "n", "early", "gid", "prefix", "hashes"],
            )

    folder = job_folder(docs.sparkSession, "prefixes")
    docs.select(text).mapInArrow(run, schema).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _whole_sets(docs: DataFrame, text: str, wanted, rule: Rule) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.batches(stream, text):
            sets = Sets(data, offsets, rule.width)
            nodes, one = np.unique(sets.nodes(), return_index=True)
            at = np.flatnonzero((sets.size[one] >= rule.floor) & _marked(wanted.value, W.mix(nodes.view(np.uint64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[at]), pa.array([sets.hash[sets.first[r] : sets.first[r + 1]].tobytes() for r in one[at].tolist()], pa.binary())],
                names=["node", "hashes"],
            )

    return docs.select(text).mapInArrow(run, "node long, hashes binary")


# --- pairs ------------------------------------------------------------------

def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (``a``, ``b``) with whole * intersection >= part * union. One set is held at a time:
    the partners of a node are dealt over tasks, ``STAR`` to each."""
    pairs = pairs.select("a", "b").distinct()
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("n_salt"))
    salted = pairs.join(stars, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("n_salt")).cast("int"))
    centres = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "hashes")
    partners = salted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "hashes")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in stream:
            links = []
            for a, kind, b, raw in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "kind", "b", "hashes")]):
                hashes = C.u64(raw)
                if kind == 0:
                    centre = hashes
                    continue
                both = int((W.known(centre, hashes) >= 0).sum())
                if rule.whole * both >= rule.part * (len(centre) + len(hashes) - both):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        W.release()

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = centres.unionByName(partners).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "kind")
    return rows.mapInArrow(run, "a long, b long")


def _key_nodes(nodes: DataFrame) -> DataFrame:
    """``node``, ``n``, ``least``, ``k`` and ``c`` (nodes of the key) of every key that several nodes share."""
    listed = nodes.select("node", "n", "least", F.explode("keys").alias("k"))
    return listed.join(listed.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "k")


def _key_pairs(shared: DataFrame) -> DataFrame:
    """Each node of a shared key with the centre of its size band, and with the two nodes before it in a random order
    of the band: at most three pairs per node and key, however many nodes share it. The centre is the node
    with the fewest rare shingles (``early``): what copies were made from, or is nearest to it."""
    placed = shared.withColumns({
        "band": F.floor(F.ln("n") / BAND).cast("int"),
        # a part of a large band is ordered by itself: no window holds a large key whole
        "part": F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / 10_000)).cast("int"),
        "turn": F.xxhash64("node", "k"),
    })
    inside = Window.partitionBy("k", "band", "part").orderBy("turn", "node")
    names = {"node": "a", "n": "na", "least": "leasta"}
    before = [F.struct(*[F.lag(c, g).over(inside).alias(a) for c, a in names.items()]) for g in (1, 2)]
    chain = placed.withColumn("before", F.array(*before)).select("node", "n", "least", F.explode("before").alias("p"))
    centre = placed.groupBy("k", "band").agg(F.min(F.struct("early", "node", "n", "least")).alias("p"))
    star = placed.join(centre, ["k", "band"]).select("node", "n", "least", F.struct(*[F.col(f"p.{c}").alias(a) for c, a in names.items()]).alias("p"))
    pairs = chain.unionByName(star).where("p.a is not null and p.a <> node and p.na >= least and n >= p.leasta")
    return pairs.select(F.least("p.a", "node").alias("a"), F.greatest("p.a", "node").alias("b")).distinct()


def _group_pairs(groups: DataFrame, n_buckets: int, rule: Rule) -> DataFrame:
    """Pairs of groups (``gid``, ``n``, ``prefix``, ``comp``, null if its members are in several
    components) with enough common prefix shingles, not of one component."""

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            raw = batch.column(batch.schema.get_field_index("prefix")).to_pylist()
            if not raw:
                continue
            token = C.u64(b"".join(raw))
            length = np.array([len(r) // 8 for r in raw])
            place = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            rows = np.empty((len(token), 4), dtype=np.int64)
            comp = batch.column(batch.schema.get_field_index("comp"))
            rows[:, 0] = np.repeat(batch.column(batch.schema.get_field_index("gid")).to_numpy(), length)
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()
            rows[:, 1] = np.repeat(comp.fill_null(0).to_numpy(), length)
            mixed = np.repeat(np.array([not c.is_valid for c in comp]), length)
            rows[:, 2] = np.repeat(n, length)
            rows[:, 3] = place * 2 + mixed
            for bucket, at in C.by_bucket(token, n_buckets):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([token[at].tobytes()], pa.binary()), pa.array([rows[at].tobytes()], pa.binary())],
                    names=["bucket", "tokens", "rows"],
                )

    def meet(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[int, list[np.ndarray]] = {}
        rows: dict[int, list[np.ndarray]] = {}
        for batch in stream:
            for k in range(len(batch)):
                bucket = C.value(batch, "bucket", k)
                tokens.setdefault(bucket, []).append(C.u64(C.value(batch, "tokens", k)))
                rows.setdefault(bucket, []).append(np.frombuffer(C.value(batch, "rows", k), np.int64).reshape(-1, 4))
        for bucket in tokens:
            yield from _meeting(np.concatenate(tokens[bucket]), np.concatenate(rows[bucket]), n_buckets, rule)
        del tokens, rows
        W.release()

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        for batch in stream:
            for k in range(len(batch)):
                pairs.append(np.frombuffer(C.value(batch, "pairs", k), np.int64).reshape(-1, 3))
        if pairs:
            flat = np.concatenate(pairs)
            flat = flat[np.lexsort((flat[:, 1], flat[:, 0]))]
            new = np.append(True, (flat[1:, :2] != flat[:-1, :2]).any(axis=1))
            total = np.add.reduceat(flat[:, 2], np.flatnonzero(new))
            kept = flat[new][total >= rule.common]
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, k]) for k in (0, 1)], names=["g", "h"])
            del pairs, flat, kept
        W.release()

    dealt = groups.mapInArrow(deal, "bucket int, tokens binary, rows binary").repartition(n_buckets, "bucket")
    met = dealt.mapInArrow(meet, "bucket int, pairs binary").repartition(n_buckets, "bucket")
    return met.mapInArrow(add, "g long, h long")


def _meeting(token: np.ndarray, rows: np.ndarray, n_buckets: int, rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs of groups in the lists of a bucket's shingles, with the number of lists they share."""
    order = np.lexsort((rows[:, 2], token))
    token, rows = token[order], rows[order]
    number = np.cumsum(np.append(True, token[1:] != token[:-1])) - 1
    size = np.bincount(number)
    several = size[number] > 1
    token, rows, number = token[several], rows[several], number[several]
    if not len(number):
        return
    opens = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    # a list of one component only has nothing to add
    single = (np.minimum.reduceat(rows[:, 1], opens) == np.maximum.reduceat(rows[:, 1], opens)) & (np.maximum.reduceat(rows[:, 3] & 1, opens) == 0)
    lists = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1
    keep = ~single[lists]
    rows, lists = rows[keep], lists[keep]
    if not len(rows):
        return
    gid, comp, n, place, mixed = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] >> 1, rows[:, 3] & 1
    # pairs inside a list's largest component are never looked at: one end is outside
    large = _in_largest(lists, comp, mixed)
    key = lists * (1 << 32) + n
    outside = np.flatnonzero(~large)
    low = np.searchsorted(key, key[outside] - n[outside] + rule.least_size(n[outside]), side="left")
    count = np.searchsorted(key, key[outside] - n[outside] + n[outside] * rule.whole // rule.part, side="right") - low
    total = np.cumsum(count)
    begin = 0
    while begin < len(count):
        done = total[begin - 1] if begin else 0
        end = max(int(np.searchsorted(total, done + PAIRS, side="right")), begin + 1)
        for a, b in _partners(outside[begin:end], low[begin:end], count[begin:end]):
            alpha = rule.least_common(n[a] + n[b])
            ok = (large[b] | (b > a)) & (gid[a] != gid[b]) & ((comp[a] != comp[b]) | (mixed[a] + mixed[b] > 0))
            ok &= (place[a] <= n[a] - alpha + rule.common - 1) & (place[b] <= n[b] - alpha + rule.common - 1)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            pair = np.stack([np.minimum(gid[a], gid[b]), np.maximum(gid[a], gid[b])], 1)
            pair, seen = np.unique(pair, axis=0, return_counts=True)
            spread = W.mix(pair[:, 0].view(np.uint64) ^ W.mix(pair[:, 1].view(np.uint64)))
            flat = np.concatenate([pair, seen[:, None]], axis=1)
            for bucket, at in C.by_bucket(spread, n_buckets):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([flat[at].tobytes()], pa.binary())], names=["bucket", "pairs"]
                )
        begin = end


def _in_largest(lists: np.ndarray, comp: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Marks of the groups that lie in the component with the most groups of their list."""
    order = np.lexsort((comp, mixed, lists))
    l, c, m = lists[order], comp[order], mixed[order]
    new = np.append(True, (l[1:] != l[:-1]) | (c[1:] != c[:-1]) | (m[1:] != m[:-1]))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(l))) * (m[at] == 0)
    best = np.lexsort((size, l[at]))
    last = np.append(l[at][best][1:] != l[at][best][:-1], True)
    top = np.zeros(len(at), dtype=bool)
    top[best[last]] = True
    top &= size > 0
    out = np.zeros(len(lists), dtype=bool)
    out[order] = top[np.cumsum(new) - 1]
    return out


def _partners(a: np.ndarray, low: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every element with the ``count`` elements from ``low`` on, a bounded number of pairs at a time."""
    if len(a) == 1 and count[0] > PAIRS:
        for at in range(0, int(count[0]), PAIRS):
            b = np.arange(low[0] + at, low[0] + min(at + PAIRS, int(count[0])))
            yield np.full(len(b), a[0]), b
    else:
        yield np.repeat(a, count), W.ragged(count, low)


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = RULE) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` (the smallest key reachable by links) of every row."""
    return _joined(docs, key, text, rule).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _joined(docs: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """``key, n, node, comp, component_id`` of every row; rows of a component share ``comp``."""
    spark = docs.sparkSession
    context = spark.sparkContext
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = _signatures(docs, key, text, rule)
    rows = written.where("piece is null").select("key", "n", "node", "keys")
    frequent = context.broadcast(_bitmap(written.where("piece is not null"), CELL_BITS, FREQUENT, 4))
    nodes = rows.where("keys is not null").groupBy("node", "n").agg(F.any_value("keys").alias("keys"))
    nodes = nodes.withColumn("least", F.ceil(F.lit(rule.part) * F.col("n") / rule.whole))
    shared = materialise(_key_nodes(nodes), "keys")
    wanted = context.broadcast(_bitmap(_node_cells(shared), NODE_BITS, 1, 0))
    prefixes = _prefixes(docs, text, frequent, wanted, rule)
    frequent.destroy()
    wanted.destroy()
    sets = prefixes.where("hashes is not null").groupBy("node").agg(F.any_value("hashes").alias("hashes"))
    early = prefixes.groupBy("node").agg(F.any_value("early").alias("early"))
    shared = materialise(shared.join(early, "node"), "keys")
    links = materialise(_verified(materialise(_key_pairs(shared), "pairs"), sets, rule), "links")
    near = components(links)

    members = materialise(
        prefixes.select("node", "gid").distinct().join(near, "node", "left").select("node", "gid", F.coalesce("comp", "node").alias("comp")), "members"
    )
    comps = members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    groups = (
        prefixes.groupBy("gid").agg(F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix")).join(comps, "gid")
        .select("gid", "n", "prefix", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("comp"))
    )
    pairs = _group_pairs(groups, n_buckets, rule)
    inner = comps.where("lo <> hi").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    left = members.select(F.col("gid").alias("g"), F.col("node").alias("a"), F.col("comp").alias("ca"))
    right = members.select(F.col("gid").alias("h"), F.col("node").alias("b"), F.col("comp").alias("cb"))
    expanded = pairs.unionByName(inner).join(left, "g").join(right, "h").where("ca <> cb")
    crossing = materialise(expanded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    if crossing.head() is not None:
        ends = crossing.select(F.explode(F.array("a", "b")).alias("node"))
        wanted = context.broadcast(_bitmap(_node_cells(ends), NODE_BITS, 1, 0))
        sets = _whole_sets(docs, text, wanted, rule).groupBy("node").agg(F.any_value("hashes").alias("hashes"))
        found = materialise(_verified(crossing, materialise(sets, "sets"), rule), "links")
        wanted.destroy()
        if found.head() is not None:
            near = components(links.unionByName(found))
    placed = rows.join(near, "node", "left").select("key", "n", "node", F.coalesce("comp", "node").alias("comp"))
    placed = materialise(placed, "placed")
    least = placed.groupBy("comp").agg(F.min(F.when(F.col("n") > 0, F.col("key"))).alias("least"), F.count(F.lit(1)).alias("rows"))
    found = join_groups(placed, materialise(least, "components"), "comp", "rows")
    return found.select("key", "n", "node", "comp", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))


def _with_nodes(docs: DataFrame, text: str, name: str, rule: Rule) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.batches(stream, text):
            nodes = pa.array(Sets(data, offsets, rule.width).nodes())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=schema.names)

    return docs.mapInArrow(run, schema)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = RULE) -> DataFrame:
    """One row of each component, the one with the smallest key (then the smallest set's name), with its own columns.

    Rows with a null key stay, and so does a row without words. Rows that share a key are judged by their texts:
    those of one component or without words are one document, of which one row stays.
    """
    joined = materialise(_joined(docs, key, text, rule).where("key is not null"), "components")
    first = joined.where((F.col("n") > 0) & (F.col("key") == F.col("component_id")))
    first = first.groupBy("comp").agg(F.min(F.struct("key", "node")).alias("one")).select("one.*")
    kept = materialise(first.unionByName(joined.where("n = 0").select("key", "node")).distinct(), "kept")
    repeated = materialise(joined.groupBy("key").count().where("count > 1").select("key"), "repeated")
    single = kept.select("key").join(repeated, "key", "left_anti").withColumnRenamed("key", key)
    staying = docs.join(single, key, "left_semi")
    if repeated.head() is not None:
        node = "_node" if "_node" not in docs.columns else "_node_of_row"
        several = _with_nodes(docs.join(repeated.withColumnRenamed("key", key), key, "left_semi"), text, node, rule)
        wanted = kept.select(F.col("key").alias(key), F.col("node").alias(node))
        staying = staying.unionByName(several.join(wanted, [key, node], "left_semi").dropDuplicates([key, node]).drop(node))
    if docs.where(F.col(key).isNull()).head() is not None:
        staying = staying.unionByName(docs.where(F.col(key).isNull()))
    return staying
