"""Packing token sequences into as few bins as possible by bin completion, over a length histogram.

Pieces of one length are interchangeable, so the search runs on the counts of the lengths 1..capacity
(a bounded table, whatever the corpus holds).  Each search node takes the largest remaining piece and
branches over all undominated fillings of the room beside it, the likeliest first, and for each filling
over how often it is used, the most first.  A filling is dominated if some of its pieces, or none, can
be exchanged for one longer piece in stock, or several of them for one as long.  Fillings already tried
beside the same largest piece are not tried again.  Nodes are pruned when the bins used plus a waste
bound reach the incumbent; the first incumbent is the best-fit packing.

The search ends when the incumbent meets the lower bound, when nothing is left to try (then the packing
is optimal), or after NODES nodes or TESTED fillings a node of them; then the incumbent stands.
``nodes=None`` searches to the end.

Defined cases: a null text is an empty document and gets the end id alone; very long texts are read
whole; repeated rows are packed as documents of their own; only documents over the capacity are cut,
into pieces of the capacity with a shorter first piece; a null id is kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices, table
from .tokens import byte_bpe

CAPACITY = 2048
NODES = 4000
TESTED = 16
LIKELY = 4
ROWS_PER_GROUP = 200_000
END_ID = 0


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: pieces over half need bins of their own, and small ones fill them."""
    lengths = np.arange(len(counts))
    mass = counts * lengths
    large = np.append(np.cumsum(counts[::-1])[::-1], 0)  # pieces of at least this length
    weight = np.append(np.cumsum(mass[::-1])[::-1], 0)
    half = capacity // 2 + 1
    k = np.arange(1, capacity // 2 + 1)
    over = np.minimum(capacity - k + 1, len(counts))
    alone = large[over]
    middle = large[half] - alone
    room = middle * capacity - (weight[half] - weight[over])
    small = weight[k] - weight[half]
    extra = np.maximum(-(-(small - room) // capacity), 0)
    return int(max(-(-int(mass.sum()) // capacity), *(alone + middle + extra).tolist(), 0))


def _below(counts: np.ndarray) -> np.ndarray:
    """For each length, the largest length in stock not above it (0: none)."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def _spread(bits: int, far: int) -> int:
    """The bits moved up by 0..far, all together."""
    done = 1
    while done <= far:
        step = min(done, far + 1 - done)
        bits |= bits << step
        done += step
    return bits


def undominated(filling: tuple[int, ...], stock: int, slack: int) -> bool:
    """Whether no pieces of the filling can give way to one of stock (bits of the lengths left over)."""
    one = many = 0
    for x in filling:
        many |= (one | many) << x
        one |= 1 << x
    reach = _spread(many, slack)
    if slack:
        reach |= _spread((one | 1) << 1, slack - 1)
    return not reach & stock


def _likely(counts: np.ndarray, room: int, branches: int) -> Iterator[tuple[int, ...]]:
    """Fillings by best fit, started with the pairs that leave the least room, the least waste first."""
    stock = counts[: room + 1].copy()
    stock[0] = 0
    below = _below(stock)
    first = np.flatnonzero(stock)
    partner = below[room - first]
    twice = (partner == first) & (stock[first] < 2)
    if twice.any():
        partner = np.where(twice, np.minimum(below[np.maximum(first - 1, 0)], partner), partner)
    total = first + partner
    found: dict[tuple[int, ...], int] = {}
    for k in np.lexsort((-np.maximum(first, partner), -total))[: 4 * branches]:
        items = [int(x) for x in (first[k], partner[k]) if x]
        left, own = room - sum(items), stock.copy()
        for x in items:
            own[x] -= 1
        while left > 0:
            nxt = int(_below(own[: left + 1])[-1])
            if not nxt:
                break
            n = min(int(own[nxt]), left // nxt)
            items += [nxt] * n
            own[nxt] -= n
            left -= nxt * n
        found[tuple(sorted(items, reverse=True))] = left
    yield from sorted(found, key=lambda f: (found[f], len(f), tuple(-x for x in f)))


def _every(lengths: list[int], counts: np.ndarray, room: int) -> Iterator[tuple[int, ...]]:
    """All fillings, long pieces first; lengths: those in stock, descending."""

    def walk(at: int, left: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        for k in range(at, len(lengths)):
            x = lengths[k]
            for times in range(min(int(counts[x]), left // x), 0, -1):
                yield from walk(k + 1, left - times * x, chosen + (x,) * times)
        yield chosen

    return walk(0, room, ())


def fillings(counts: np.ndarray, room: int, waste: int, spent: list[int]) -> Iterator[tuple[int, ...] | None]:
    """Undominated fillings of the room that waste no more than waste, None for others; spent[0] counts all."""
    stock = counts[: room + 1].copy()
    stock[0] = 0
    if not stock.any():
        if room <= waste:
            yield ()
        return
    lengths = np.flatnonzero(stock)[::-1].tolist()
    bits = sum(1 << x for x in lengths)
    seen = set()
    for f in chain(_likely(stock, room, LIKELY), _every(lengths, stock, room)):
        spent[0] += 1
        slack = room - sum(f)
        if f in seen or slack > waste:
            yield None
            continue
        seen.add(f)
        held = bits
        for x in set(f):
            if f.count(x) == stock[x]:
                held &= ~(1 << x)
        yield f if undominated(f, held, slack) else None


def _take(counts: np.ndarray, pattern: tuple[int, ...]) -> tuple[np.ndarray, int]:
    lengths, each = np.unique(pattern, return_counts=True)
    times = int((counts[lengths] // each).min())
    rest = counts.copy()
    rest[lengths] -= each * times
    return rest, times


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing length, in bulk: each bin takes the largest piece that still fits."""
    out = []
    while counts.any():
        pattern, left, own = [], capacity, counts.copy()
        while left > 0:
            nxt = int(_below(own[: left + 1])[-1])
            if not nxt:
                break
            n = min(int(own[nxt]), left // nxt)
            pattern += [nxt] * n
            own[nxt] -= n
            left -= n * nxt
        counts, times = _take(counts, tuple(pattern))
        out.append((tuple(pattern), times))
    return out


def pack(counts: np.ndarray, capacity: int = CAPACITY, nodes: int | None = NODES) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one bin, how many such bins)] covering counts[length] pieces of each length."""
    counts = np.asarray(counts, np.int64)
    lengths = np.arange(len(counts))
    best = _best_fit(counts, capacity)
    used = sum(n for _, n in best)
    bound = lower_bound(counts, capacity)
    spent, opened = [0], 0

    def branches(left: np.ndarray, bins: int, banned: frozenset) -> Iterator[tuple[tuple[int, ...], int, frozenset] | None]:
        """(pattern, times, patterns banned after it) of every child; None where a filling is no child."""
        largest = int(np.flatnonzero(left)[-1])
        own = left.copy()
        own[largest] -= 1
        for f in fillings(own, capacity - largest, (used - 1 - bins) * capacity - int((left * lengths).sum()), spent):
            pattern = None if f is None else (largest, *f)
            if pattern is None or pattern in banned:
                yield None
                continue
            banned = banned | {pattern}
            for times in range(_take(left, pattern)[1], 0, -1):
                yield pattern, times, banned

    # One generator of children for each node from the root down: (children, counts left, bins, pattern that led here).
    path = [(branches(counts, 0, frozenset()), counts, 0, None)] if counts.any() else []
    while path and used > bound and (nodes is None or (opened < nodes and spent[0] < TESTED * nodes)):
        children, left, bins, _ = path[-1]
        child = next(children, False)
        if child is False:
            path.pop()
            continue
        if child is None:
            continue
        opened += 1
        pattern, times, banned = child
        each = np.bincount(pattern, minlength=len(left))
        rest, so_far = left - each * times, bins + times
        if not rest.any():
            if so_far < used:
                used, best = so_far, [*(step for *_, step in path if step), (pattern, times)]
            continue
        if so_far + max(-(-int((rest * lengths).sum()) // capacity), lower_bound(rest, capacity)) >= used:
            continue
        same = rest[pattern[0]] > 0
        path.append((branches(rest, so_far, banned if same else frozenset()), rest, so_far, (pattern, times)))
    return best


def slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Which ranks of a length go where: rows (length, first rank) sorted, with the first bin, place in it."""
    seen = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for lengths, times in patterns:
        place = 0
        for x in lengths:
            rows.append((x, seen[x], base, place))
            seen[x] += times
            place += x
        base += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "bin": a[:, 2], "offset": a[:, 3]}


def searched(spark: SparkSession, counts: np.ndarray, capacity: int, nodes: int | None) -> dict[str, np.ndarray]:
    """slots of the packing; the search runs in a task, where its many open nodes do not add to the driver's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(slots(pack(np.array(held, np.int64), capacity, nodes), capacity))], pa.binary())], ["slots"])

    one = spark.createDataFrame([(counts.tolist(),)], "counts array<long>")
    return pickle.loads(one.mapInArrow(run, "slots binary").first()["slots"])


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, key: str, text: str, json_path: str, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token counts and checksums of all pieces; ids exist only inside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(json_path, ranks_path)
        # Small parts: only their texts are Python objects at a time.
        for batch in (part for whole in batches for part in slices(whole, 1)):
            keys, texts = batch.column(0), ["" if t is None else t for t in batch.column(1).to_pylist()]
            flat, offsets = bpe.ids(texts)
            source, piece, start, length, check = [], [], [], [], []
            end = np.array([end_id], "<u4").tobytes()
            for d in range(len(texts)):
                raw = flat[offsets[d] : offsets[d + 1]].astype("<u4").tobytes() + end
                n = len(raw) // 4
                at, k = 0, 0
                while at < n:
                    to = at + (n - at - 1) % capacity + 1 if k == 0 else at + capacity
                    source.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    check.append(zlib.crc32(raw[4 * at : 4 * to]))
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def best_fit_pack(cut_pieces: DataFrame, capacity: int = CAPACITY, nodes: int | None = NODES, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    A piece of the whole capacity is a sequence of its own and needs no rank; such sequences get odd
    numbers.  Others are ranked within their length: each length has groups in proportion to its
    count, and a group's first rank comes from the counts.  The driver sees one row for each length and
    group: at most capacity + 8 * partitions + rows / rows_per_group.
    """
    spark = cut_pieces.sparkSession
    rows = cut(cut_pieces.withColumn("row", F.monotonically_increasing_id()))
    held = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    single = np.zeros(capacity + 1, np.int64)
    for n, k in held.items():
        single[n] = k
    single[capacity] = 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = min(max(int(single.sum()) // (8 * partitions), 256), rows_per_group)
    sizes = [(n, int(-(-c // group))) for n, c in enumerate(single.tolist()) if c]
    parts = spark.createDataFrame(sizes, "length long, parts long")  # capacity rows at most
    short = rows.filter(F.col("length") < capacity).join(F.broadcast(parts), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    groups = np.zeros(capacity + 1, np.int64)
    for n, k in sizes:
        groups[n] = k
    begin = np.concatenate(([0], np.cumsum(groups)))
    counted = short.groupBy("length", "bucket").count().collect()
    grid = np.zeros(begin[-1], np.int64)
    for r in counted:
        grid[begin[r["length"]] + r["bucket"]] = r["count"]
    first = np.cumsum(grid) - grid
    plan = spark.sparkContext.broadcast((begin, first, searched(spark, single, capacity, nodes)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin, first, s = plan.value
        wide = np.int64(1) << 44
        marks = s["length"] * wide + s["rank"]
        for b in batches:
            length = b["length"].to_numpy()
            rank = first[begin[length] + b["bucket"].to_numpy()] - first[begin[length]] + b["place"].to_numpy() - 1
            k = np.searchsorted(marks, length * wide + rank, side="right") - 1
            yield b.drop(columns=["bucket", "place", "row"]).assign(sequence_id=2 * (s["bin"][k] + rank - s["rank"][k]), offset=s["offset"][k])

    schema = PIECES + ", sequence_id long, offset long"
    window = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row")
    placed = short.withColumn("place", F.row_number().over(window)).select("doc_id", "piece", "start", "length", "ids_crc32", "row", "bucket", "place").mapInPandas(place, schema)
    whole = rows.filter(F.col("length") == capacity).withColumn("sequence_id", 2 * F.col("row") + 1).withColumn("offset", F.lit(0).cast("long")).drop("row")
    return placed.unionByName(whole)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return best_fit_pack(pieces(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")))
