"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A text's set is its distinct word shingles (hashes of 64 bits).  Texts with equal sets are one class,
represented by its smallest key.  A signature has SIZE MinHash labels of 16 bits.  Each of TREES
sorted orders reads DEPTH labels of it in an order of its own; the table of (tree, labels) is
range-partitioned and sorted, so a class's neighbours in an order are those with the longest common
prefix.

Candidates: in each order, neighbours that share at least FLOOR labels, and every pair of a region (the
rows that share FLOOR labels) of at most SMALL rows.  A larger region is descended label by label: its
parts of at most SMALL rows are taken whole at the depth where they become that small.  Rows at the
edges of sorted partitions are put in order once more, so no region is seen in part only.

Two texts of Jaccard similarity s share FLOOR labels in one of the orders with probability
1 - (1 - s^FLOOR)^TREES: 0.99999 at 0.85.  Candidates whose sizes rule the link out are dropped; all
others are compared on full sets, in rounds: first each class's most similar candidate, then the
candidates that are still in different components, last the exact way below.  So a group of n near
copies costs about n comparisons, and the components are those of all links.

Rows of regions that had to be descended may have partners that are no candidates.  They get an exact
way: a prefix-filtered join of their full sets.  In one order of all shingles, rare ones first, two
sets that are linked share a shingle among each one's first n - ceil(0.85 n) + 1, at places that leave
enough behind them; of the pairs of different components that do, those whose bitmaps (a bit for each
shingle's hash) differ too much for a link are left out, and the others compared.  The order comes from a
table of hashed counts; its size decides how many pairs are compared, never which links are found.

Defined cases: texts without words (null too) have an empty set, no links, and are their own
component; very long texts are taken whole; repeated rows and rows with equal sets are one component;
rows of one key are one document, so all its texts' links are its own; shorter texts than a shingle have
their whole sequence as the one shingle; rows with a null key take no part and get a null component;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import binary_column, cut, spread, table, utf8
from .textvec import LOWER, digests, distinct, doc_chunks, mix, shingles, span_hashes, words

SIZE = 128
TREES = 24
DEPTH = 8
FLOOR = 6
SMALL = 4
COUNTS = 1 << 18
BLOCK_BYTES = 32 << 20
CELL_PAIRS = 1 << 14
WORDS = 5
SEED = 20_240_229


def _sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    starts, ends, first = words(raw, offsets)
    hashes = span_hashes(raw, starts, ends, LOWER)
    for d in range(len(offsets) - 1):
        yield distinct(shingles(hashes[first[d] : first[d + 1]], size))


class Signer:
    def __init__(self, size: int = SIZE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.orders = np.stack([rng.permutation(size)[:DEPTH] for _ in range(TREES)])

    def sign(self, shingle_set: np.ndarray) -> np.ndarray:
        """16-bit labels: the low bits of the mixed minimum under each multiplication."""
        low = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingle_set), 512):
            np.minimum(low, (shingle_set[at : at + 512, None] * self.factor[None, :]).min(axis=0), out=low)
        return (mix(low) >> np.uint64(48)).astype(np.uint16)

    def keys(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For signatures (rows x SIZE): the labels of each tree as two 64-bit numbers, rows x TREES."""
        wide = labels[:, self.orders].astype(np.uint64)
        place = np.array([48, 32, 16, 0], np.uint64)
        return (wide[:, :, :4] << place).sum(axis=2, dtype=np.uint64).view(np.int64), (wide[:, :, 4:8] << place).sum(axis=2, dtype=np.uint64).view(np.int64)


SIGNED = "doc_id long, n_shingles long, lo long, hi long, labels binary"


def signatures(docs: DataFrame, key: str, text: str, size: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, lo, hi, labels): lo and hi name the set; labels is null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in doc_chunks(offsets):
                n, lo, hi = (np.zeros(b - a, np.int64) for _ in range(3))
                labels = np.zeros((b - a, SIZE), np.uint16)
                for d, own in enumerate(_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)):
                    n[d] = len(own)
                    if len(own):
                        lo[d], hi[d] = digests(own.view(np.uint8), *np.array([[0], [8 * len(own)]]))
                        labels[d] = signer.sign(own)
                signed = pa.compute.if_else(pa.array(n > 0), binary_column(labels), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(lo), pa.array(hi), signed], ["doc_id", "n_shingles", "lo", "hi", "labels"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SIGNED)


def orders(classes: DataFrame) -> DataFrame:
    """One row for each class and tree: (tree, k1, k2, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for at in range(0, len(ids), 4096):
                part = batch.column(1).slice(at, 4096)
                labels = np.frombuffer(b"".join(part.to_pylist()), np.uint16).reshape(-1, SIZE)
                k1, k2 = signer.keys(labels)
                n = len(labels)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(k1.ravel()), pa.array(k2.ravel()), pa.array(np.repeat(ids[at : at + n], TREES))], ["tree", "k1", "k2", "id"]
                )

    return classes.select("id", "labels").mapInArrow(run, "tree int, k1 long, k2 long, id long")


def _pairs_in_order(tree: np.ndarray, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of sorted rows, and which rows lie in a region of more than small rows."""
    n = len(ids)
    if n < 2:
        return ids[:0], ids[:0], np.zeros(n, bool)
    shift = np.array([48, 32, 16, 0], np.uint64)
    labels = np.concatenate([(k.view(np.uint64)[:, None] >> shift) & np.uint64(0xFFFF) for k in (k1, k2)], axis=1)
    depth = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
    left, right = [np.flatnonzero(depth >= FLOOR)], [np.flatnonzero(depth >= FLOOR) + 1]
    settled, dense = np.zeros(n, bool), np.zeros(n, bool)
    for d in range(FLOOR, DEPTH + 1):
        region = np.concatenate(([0], np.cumsum(depth < d)))
        size = np.bincount(region)[region]
        if d == FLOOR:
            dense = size > small
        whole = ~settled & (size <= small)
        settled |= whole
        for step in range(2, small):
            at = np.flatnonzero(whole[:-step] & (region[step:] == region[:-step]))
            left.append(at)
            right.append(at + step)
    left, right = np.concatenate(left), np.concatenate(right)
    return ids[left], ids[right], dense


NEIGHBOURS = "kind int, a long, b long, tree int, k1 long, k2 long"


def neighbours(ordered: DataFrame, partitions: int, small: int = SMALL) -> DataFrame:
    """kind 0: candidate pair (a, b); 1: a row a of a region of more than small rows; 2: a row
    (a, tree, k1, k2) at the edge of a sorted partition, whose neighbours may lie in the next one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first = None, True
        width = small + 1

        def edge(part: pd.DataFrame) -> pd.DataFrame:
            return part.rename(columns={"id": "a"}).assign(kind=2, b=0)

        for frame in frames:
            if first:
                yield edge(frame.head(width))
                first = False
            # The rows held back bring a region that two frames share; pairs met twice are one later.
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            a, b, dense = _pairs_in_order(*(rows[c].to_numpy() for c in ("tree", "k1", "k2", "id")), small)
            yield pd.DataFrame({"kind": 0, "a": np.minimum(a, b), "b": np.maximum(a, b), "tree": 0, "k1": 0, "k2": 0})
            yield pd.DataFrame({"kind": 1, "a": np.unique(rows["id"].to_numpy()[dense]), "b": 0, "tree": 0, "k1": 0, "k2": 0})
            held = rows.tail(width)
        if held is not None:
            yield edge(held)

    by = ("tree", "k1", "k2", "id")
    sorted_rows = (ordered.repartitionByRange(partitions, *by) if partitions > 1 else ordered.coalesce(1)).sortWithinPartitions(*by)
    return sorted_rows.mapInPandas(lambda it: (f[["kind", "a", "b", "tree", "k1", "k2"]].astype({"kind": "int32", "tree": "int32", "a": "int64", "b": "int64", "k1": "int64", "k2": "int64"}) for f in run(it)), NEIGHBOURS)


def candidates(ordered: DataFrame, partitions: int, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs (a, b), distinct ids of rows in dense regions)."""
    found = cut(neighbours(ordered, partitions, small))
    # The rows at the end of a partition and the start of the next, in order again: no more than
    # partitions * 2 * (small + 1), whatever the number of rows.
    edges = found.filter("kind = 2").select("tree", "k1", "k2", F.col("a").alias("id")).distinct()
    every = found.union(cut(neighbours(edges, 1, small)))
    return every.filter("kind = 0 and a < b").select("a", "b").distinct(), every.filter("kind = 1").select(F.col("a").alias("id")).distinct()


def _agreement(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) whose sizes allow a link, with est, the share of equal labels."""
    x = classes.select(F.col("id").alias("a"), F.col("labels").alias("la"), F.col("n_shingles").alias("na"))
    y = classes.select(F.col("id").alias("b"), F.col("labels").alias("lb"), F.col("n_shingles").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                la, lb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SIZE) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((la == lb).mean(axis=1))], ["a", "b", "est"])

    sized = pairs.join(x, "a").join(y, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long, est double")


def _members(ids: DataFrame, docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, members): each full set of each id, as sorted hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in doc_chunks(offsets):
                own = [s.tobytes() for s in _sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own, pa.binary())], ["id", "members"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(ids.distinct(), "id", "left_semi")
    out = rows.mapInArrow(sets, "id long, members binary")
    return cut(out.withColumn("named", F.xxhash64("members")).dropDuplicates(["id", "named", "members"]).select("id", "members"))


def _confirm(pairs: DataFrame, members: DataFrame, percent: int, block: int = BLOCK_BYTES, size: int = CELL_PAIRS) -> DataFrame:
    """Links among the pairs: sets with 100 * intersection >= percent * union.

    Ids are dealt into blocks of about block bytes of sets, and pairs into cells of two blocks and
    about size pairs; a set moves once to each cell that has a pair of it.  Of the links of a cell,
    those that join ends already joined in it are left out.
    """
    total = members.agg(F.sum(F.octet_length("members"))).first()[0] or 0
    blocks = int(total // block) + 1
    parts = int(pairs.count() // (size * max(blocks * (blocks + 1) // 2, 1))) + 1
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    cells = pairs.select("a", "b", F.least(place("a"), place("b")).alias("i"), F.greatest(place("a"), place("b")).alias("j"), F.pmod(F.xxhash64("a", "b"), F.lit(parts)).cast("int").alias("k"))
    sides = cells.select("i", "j", "k", F.col("a").alias("id")).union(cells.select("i", "j", "k", "b")).distinct()
    held = sides.join(members, "id").select(F.col("i").alias("hi"), F.col("j").alias("hj"), F.col("k").alias("hk"), "id", "members")

    def compare(asked: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, list[np.ndarray]] = {}
        for id_, m in zip(sets["id"].tolist(), sets["members"]):
            own.setdefault(id_, []).append(np.frombuffer(m, np.uint64))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for a, b in zip(asked["a"].tolist(), asked["b"].tolist()):
            if root(a) != root(b) and any(_linked(p, q, percent) for p in own.get(a, ()) for q in own.get(b, ())):
                parent[root(a)] = root(b)
                links.append((a, b))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return cells.groupBy("i", "j", "k").cogroup(held.groupBy("hi", "hj", "hk")).applyInPandas(compare, "a long, b long")


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = np.concatenate((p, q))
    both.sort(kind="stable")  # two sorted runs: a merge
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _bits(rows: DataFrame) -> DataFrame:
    """(id, b0 .. b15): one bit of 1024 for each shingle of a set, by its hash."""
    names = [f"b{k}" for k in range(16)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.zeros((batch.num_rows, 1024), bool)
            for k, x in enumerate(batch.column(1)):
                wide[k, (np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(20)) & np.uint64(1023)] = True
            words = np.packbits(wide, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(16))], ["id", *names])

    return rows.select("id", "members").mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def _shingle_counts(members: DataFrame, counts: int) -> np.ndarray:
    """How many sets hold a shingle of each hashed place; counts rows at most come from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counts, np.int64)
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            total += np.bincount((held % np.uint64(counts)).astype(np.int64), minlength=counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    out = np.zeros(counts, np.int64)
    summed = members.select("members").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out[summed.column("place").to_numpy()] = summed.column("n").to_numpy()
    return out


def _prefix_pairs(rows: DataFrame, percent: int, counts: int) -> DataFrame:
    """Pairs (a, b) of different components that a prefix filter can't rule out; rows: (id, component, members)."""
    rarity = rows.sparkSession.sparkContext.broadcast(_shingle_counts(rows, counts))  # counts numbers

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingle, source, place, size = [], [], [], []
            for k, x in enumerate(batch.column(2)):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(own)
                front = n + percent * n // -100 + 1  # n - ceil(percent * n / 100) + 1
                held = rarity.value[(own % np.uint64(counts)).astype(np.int64)]
                shingle.append(own[np.lexsort((own, held))[:front]].view(np.int64))
                source.append(np.full(front, k))
                place.append(np.arange(front))
                size.append(np.full(front, n))
            if source:
                at = pa.array(np.concatenate(source))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shingle)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(size).astype(np.int32))],
                    ["shingle", "id", "component", "place", "n"],
                )

    held = cut(rows.select("id", "component", "members").mapInArrow(prefixes, "shingle long, id long, component long, place int, n int"))
    # Only shingles of several components matter; of those, the rows outside the shingle's largest
    # component meet all rows, so a large component is never joined with itself.
    per = held.groupBy("shingle", "component").count().groupBy("shingle").agg(F.max(F.struct("count", "component")).alias("most"), F.count("*").alias("different"))
    shared = per.filter("different > 1").select("shingle", F.col("most.component").alias("major"))
    near = spread(held, shared, ["shingle"], "id")
    near = cut(near.join(_bits(rows.select("id", "members")), "id"))
    bits = [f"b{k}" for k in range(16)]
    x = near.filter("component != major").select("shingle", *(F.col(c).alias(f"{c}_") for c in ("id", "component", "place", "n", *bits)))
    met = spread(near, x, ["shingle"], "id").filter(F.col("component") != F.col("component_"))
    met = met.filter(100 * F.least("n", "n_") >= percent * F.greatest("n", "n_"))
    # What two sets share is no more than what either has from this shingle on, nor than what is left
    # of it without the bits that the other lacks.
    lacking = lambda here, there: sum((F.bit_count(F.col(f"{b}{here}").bitwiseAND(F.bitwise_not(f"{b}{there}"))) for b in bits), F.lit(0))
    shared = F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_"), F.col("n") - lacking("", "_"), F.col("n_") - lacking("_", ""))
    met = met.filter((100 + percent) * shared >= percent * (F.col("n") + F.col("n_")))
    return met.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str, text: str, size: int = WORDS, percent: int = 85, small: int = SMALL, counts: int = COUNTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row with a key."""
    spark = docs.sparkSession
    signed = cut(signatures(docs, key, text, size))
    named = signed.filter(F.col("labels").isNotNull() & F.col("doc_id").isNotNull())
    # Classes of equal sets; the smallest key stands for all, and brings its own labels.
    classes = cut(named.groupBy("lo", "hi", "n_shingles").agg(F.min(F.struct("doc_id", "labels")).alias("m")).select("lo", "hi", "n_shingles", F.col("m.doc_id").alias("id"), F.col("m.labels").alias("labels")))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    pairs, dense = candidates(orders(classes), partitions, small)
    close = cut(_agreement(pairs, classes, percent))
    dense = cut(dense)
    # Round one: each class's closest candidate.
    sides = close.select("a", "b", "est", F.col("a").alias("id")).union(close.select("a", "b", "est", F.col("b").alias("id")))
    best = sides.groupBy("id").agg(F.max(F.struct("est", F.expr("-a").alias("na"), F.expr("-b").alias("nb"))).alias("m"))
    best = cut(best.select(F.expr("-m.na").alias("a"), F.expr("-m.nb").alias("b")).distinct())
    members = _members(close.select(F.col("a").alias("id")).union(close.select("b")).union(dense), docs, key, text, size)
    links = cut(_confirm(best, members, percent).union(_same_document(named, classes)))
    comp = cut(components(links, "a", "b"))
    # Round two: the other candidates, where the first left them apart.
    rest = cut(_apart(close.select("a", "b").join(best, ["a", "b"], "left_anti"), comp))
    links = cut(links.union(_confirm(rest, members, percent)))
    comp = cut(components(links, "a", "b"))
    # Round three: rows of dense regions that are no candidates, where they are apart still.
    c = comp.select(F.col("node").alias("n"), F.col("component").alias("c"))
    sets = members.join(dense, "id", "left_semi").join(c, F.col("id") == F.col("n"), "left").select("id", F.coalesce("c", "id").alias("component"), "members")
    links = cut(links.union(_confirm(cut(_prefix_pairs(cut(sets), percent, counts)), members, percent)))
    comp = components(links, "a", "b").withColumnRenamed("node", "id")
    final = classes.select("lo", "hi", "id").join(comp, "id", "left").select("lo", "hi", F.coalesce("component", "id").alias("component_id"))
    out = spread(signed.filter("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "lo", "hi"), final, ["lo", "hi"], "doc_id")
    alone = signed.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id").union(alone)


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different components."""
    side = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _same_document(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of one key's texts, where it has several."""
    several = named.groupBy("doc_id").agg(F.min(F.struct("lo", "hi")).alias("x"), F.max(F.struct("lo", "hi")).alias("y")).filter("x != y").select("doc_id")
    own = named.join(several, "doc_id", "left_semi").select("doc_id", "lo", "hi").distinct().join(classes.select("lo", "hi", "id"), ["lo", "hi"])
    return own.filter("doc_id != id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
