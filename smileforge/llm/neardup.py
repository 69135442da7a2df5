"""MinHash near-dedup with min-max hashing.

Each permutation gives two signature values of a document's shingle set, its
minimum and its maximum, so half the hash evaluations fill the bands.  Rows
with equal sets are one class from the start.  Classes that share a band are
candidates; a candidate pair becomes a link only if the full sets reach the
similarity.

Within a bucket no pair is compared whose classes are already in one
component.  In a round every class outside its bucket's largest component picks
one of its buckets and meets a few leaders there, so a round makes a bounded
number of pairs a class, however many buckets a class is in; the links found
join components, and a bucket is finished when its members are in one.  When
rounds find few links any more, the members outside a bucket's largest
component are compared with all its members in blocks of bounded size, whose
shared shingles a matrix product counts; then all pairs across components have
been compared and no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh, hold, table, trimmed
from .wordhash import mix, release, shingle_sets, text_chunks

PERMUTATIONS = 64
#: Values of the signature in one band.
BAND_ROWS = 4
#: Leaders of a bucket, of its largest component and of the others each, in the rounds after the first, which has one.
LEADERS = 2
#: Rounds go on while they find a link for this share of the members still in question.
WORTHWHILE = 0.02
#: Shingles and documents of one side of a block (about), and columns of one matrix product.
BLOCK_SHINGLES, BLOCK_DOCS, BLOCK_COLUMNS = 200_000, 1024, 2048
_RNG = np.random.default_rng(8)
_FACTORS = _RNG.integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
_ORDER_SEED = 88


def signature(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minimum and maximum of the set under each permutation: 2 * ``permutations`` values."""
    low = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(permutations, np.uint64)
    factors = _FACTORS[:permutations, None]
    for lo in range(0, len(shingles), 4096):
        h = shingles[None, lo : lo + 4096] * factors
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands(values: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One hash for every band; a band's number is part of it."""
    order = np.random.default_rng(_ORDER_SEED).permutation(len(values))
    grid = values[order][: len(values) // rows * rows].reshape(-1, rows)
    out = np.arange(len(grid), dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return out.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signed(docs: DataFrame, width: int, permutations: int, rows: int) -> DataFrame:
    """(doc_id, key, n_shingles, set_hash, bands) of every row; the set hash is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", release)
        for batch in batches:
            n, digests, keys = [], [], []
            for _, data, offsets in text_chunks(batch.column("text")):
                for s in shingle_sets(data, offsets, width):
                    n.append(len(s))
                    digests.append(_digest(s))
                    keys.append(bands(signature(s, permutations), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "key", "n_shingles", "set_hash", "bands"])

    return docs.mapInArrow(trimmed(run), "doc_id long, key long, n_shingles long, set_hash binary, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(set_hash, shingles) of every row: the sorted set as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", release)
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column("text")):
                sets = list(shingle_sets(data, offsets, width))
                yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["set_hash", "shingles"])

    return docs.select("text").mapInArrow(trimmed(run), "set_hash binary, shingles binary")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, set_a, set_b), the pairs (a, b) whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", release)
        for batch in batches:
            keep = []
            before, left = None, None
            for a, x, y in zip(batch.column("a").to_numpy(), batch.column("set_a"), batch.column("set_b"), strict=True):
                if before != a:
                    before, left = a, np.frombuffer(x.as_py(), np.uint64)
                right = np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(trimmed(run), "a long, b long")


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of their incidence matrices."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    both = np.intersect1d(*(np.unique(h) for h, _ in sides), assume_unique=True)
    counts = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return counts
    placed = []
    for h, row in sides:
        at = np.minimum(np.searchsorted(both, h), len(both) - 1)
        keep = both[at] == h
        at, row = at[keep], row[keep]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], row[order]))
    for lo in range(0, len(both), BLOCK_COLUMNS):
        m = []
        for (at, row), n in zip(placed, counts.shape, strict=True):
            part = slice(*np.searchsorted(at, [lo, lo + BLOCK_COLUMNS]))
            x = np.zeros((n, min(BLOCK_COLUMNS, len(both) - lo)), np.float32)
            x[row[part], at[part] - lo] = 1
            m.append(x)
        counts += m[0] @ m[1].T
    return counts


def _block_links(odd: DataFrame, all_: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the members outside a bucket's largest component and members of other components.

    Both frames have bucket, oc and mc (block numbers), node, label and
    shingles.  Of the links of one document to one component one is given.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        if left.num_rows and right.num_rows:
            sets = [[np.frombuffer(x.as_py(), np.uint64) for x in t["shingles"]] for t in (left, right)]
            (ids, labels), (others, other_labels) = ((t["node"].to_numpy(), t["label"].to_numpy()) for t in (left, right))
            sizes = [np.array([len(x) for x in s]) for s in sets]
            both = _shared_counts(*sets)
            linked = (100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)) & (labels[:, None] != other_labels[None, :])
            i, j = np.nonzero(linked)
            if len(i):
                _, first = np.unique(np.stack([i, other_labels[j]]), axis=1, return_index=True)
                out = ids[i[first]], others[j[first]]
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    odd = odd.select(*(F.col(c).alias(f"o_{c}") for c in ("bucket", "oc", "mc")), F.col("node").alias("o_node"), F.col("label").alias("o_label"), F.col("shingles").alias("o_shingles"))

    def renamed(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.rename_columns([c.removeprefix("o_") for c in left.column_names]), right)

    grouped = odd.groupBy("o_bucket", "o_oc", "o_mc").cogroup(all_.select("bucket", "oc", "mc", "node", "label", "shingles").groupBy("bucket", "oc", "mc"))
    return grouped.applyInArrow(renamed, "a long, b long").distinct()


def components(space: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Large-star and small-star steps until nothing changes; a node's neighbours
    are never gathered, only their minimum is.
    """
    current = space.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # Large star: neighbours above u go to the smallest neighbour of u (or u itself).
        both = current.union(current.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = space.write(large)
        # Small star: u and its neighbours below go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = space.write(small)
        got = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        space.drop(current, large)
        current = new
        if state == tuple(got):
            break
        state = tuple(got)
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(current.select("v", F.col("v").alias("r")).distinct())


def _links(space: Workspace, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) of the classes that have a link, from ``members`` (bucket, node, n, w) and ``sets`` (node, shingles).

    None if no bucket has several members.
    """
    # A member of many and large buckets is near to many: it leads.
    weights = members.groupBy("node").agg(F.sum("w").alias("weight"))
    left = space.write(members.join(weights, "node").select("bucket", "w", "node", "n", "weight", F.col("node").alias("label")))
    labels, turn, found = None, 0, 0
    while left.head(1):
        # The largest component of each bucket; members outside it are odd.
        groups = left.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
        main = groups.groupBy("bucket").agg(
            F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("s").alias("s_all"), (F.sum("s") - F.max_by("s", F.struct("k", "label"))).alias("s_odd"),
            F.sum("k").alias("k_all"), (F.sum("k") - F.max("k")).alias("k_odd"),
        )
        marked = space.write(left.join(main, "bucket").withColumn("odd", F.col("label") != F.col("main")))
        odd = marked.where("odd")
        last = turn > 0 and found < WORTHWHILE * odd.select("node").distinct().count()
        if not last:
            # The first round has the heaviest member of a bucket as leader, and each class in its fullest bucket.
            seat = F.lit(0) if turn == 0 else F.pmod(F.xxhash64("node", "bucket", F.lit(turn)), F.lit(LEADERS)) + F.when(F.col("odd"), LEADERS).otherwise(0)
            rank = F.col("weight") if turn == 0 else F.xxhash64("node", F.lit(turn))
            chosen = marked.groupBy("bucket", seat.alias("seat")).agg(F.max(F.struct(rank.alias("rank"), "node", "n", "label")).alias("x")).select("bucket", F.col("x.node").alias("leader"), F.col("x.n").alias("leader_n"), F.col("x.label").alias("leader_label"))
            pool = marked if turn == 0 else odd
            first = F.col("w") if turn == 0 else F.xxhash64("bucket", F.lit(turn))
            picked = pool.groupBy("node", "n", "label").agg(F.max(F.struct(first.alias("rank"), "bucket")).alias("x")).select("node", "n", "label", F.col("x.bucket").alias("bucket"))
            pairs = picked.join(chosen, "bucket").where((F.col("label") != F.col("leader_label")) & (F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent))
            pairs = pairs.select(F.greatest("node", "leader").alias("b"), F.least("node", "leader").alias("a")).distinct()
            with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
            with_both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
            links = space.write(_linked(with_both, percent))
        else:
            blocks = lambda side: F.greatest(F.ceil(F.col(f"s_{side}") / BLOCK_SHINGLES), F.ceil(F.col(f"k_{side}") / BLOCK_DOCS)).cast("int")
            with_sets = marked.withColumns({"ocs": blocks("odd"), "mcs": blocks("all")}).join(sets, "node")
            own = lambda n: F.pmod(F.xxhash64("node", "bucket"), F.col(n)).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            o = with_sets.where("odd").withColumn("oc", own("ocs")).withColumn("mc", every("mcs"))
            m = with_sets.where("ocs > 0").withColumn("mc", own("mcs")).withColumn("oc", every("ocs"))
            links = space.write(_block_links(o, m, percent))
        found = links.count()
        # Links join the components that they run between.
        before = labels
        if labels is None:
            labels = space.write(components(space, links))
        elif found:
            known = labels.select("node", "root")
            between = links.join(known.toDF("a", "ra"), "a", "left").join(known.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            merged = space.write(components(space, between))
            moved = labels.join(merged.toDF("root", "new"), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            labels = space.write(moved.union(merged.join(labels, "node", "left_anti")))
            space.drop(merged)
        if before is not None and before is not labels:
            space.drop(before)
        space.drop(links, marked)
        if last:
            break
        rest = left.select("bucket", "w", "node", "n", "weight").join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        open_ = rest.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("bucket")
        after = space.write(rest.join(open_, "bucket", "left_semi"))
        space.drop(left)
        left, turn = after, turn + 1
    space.drop(left)
    return labels


def _resolved(space: Workspace, docs: DataFrame, width: int, percent: int, permutations: int, rows: int) -> DataFrame:
    """(doc_id, key, n_shingles, first_) of every row of ``docs`` (doc_id, key, text).

    ``first_`` is the struct (no id, doc_id, key) that comes first in the row's
    component.  Rows of one ``key`` may be several.
    """
    signed = space.write(_signed(docs, width, permutations, rows))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    real = signed.where("set_hash IS NOT NULL")
    # Numbers of classes, fixed once they are written.
    classes = space.write(real.groupBy("set_hash").agg(F.min(first).alias("first_")).withColumn("node", F.monotonically_increasing_id()))
    named = classes.select("node", F.col("set_hash").alias("of_set"), F.col("first_.key").alias("of_key"))
    # By key and set, so that rows of one set that many share do not meet in one task.
    reps = real.select("key", "set_hash", F.col("n_shingles").alias("n"), "bands").join(named, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("set_hash") == F.col("of_set")))
    spread = space.write(reps.select(F.explode("bands").alias("bucket"), "node", "n").distinct())
    # Buckets of several members; of buckets with the same members one is enough.
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("print"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("print2")).where("size > 1")
    shared = shared.groupBy("size", "print", "print2").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("same"))
    members = space.write(spread.join(shared.select("bucket", (F.col("size") * F.col("same")).alias("w")), "bucket"))
    space.drop(spread)
    needed = space.write(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "set_hash", F.col("first_.key").alias("needed_key")))
    texts = docs.join(needed.select("needed_key").distinct(), F.col("key").eqNullSafe(F.col("needed_key")), "left_semi")
    sets = space.write(_sets(texts, width).join(needed.select("node", "set_hash"), "set_hash").select("node", "shingles").dropDuplicates(["node"]))
    labels = _links(space, members, sets, percent)
    space.drop(members, needed, sets)
    if labels is not None:
        joined = classes.join(labels, "node").select("root", "node", "first_")
        roots = joined.groupBy("root").agg(F.min("first_").alias("of_root"))
        moved = labels.join(roots, "root").select("node", "of_root")
        # No name may mean two things in the final join.
        classes = space.write(classes.join(moved, "node", "left").select("set_hash", F.coalesce("of_root", "first_").alias("first_")))
    return signed.select("doc_id", "key", "n_shingles", "set_hash").join(classes.select("set_hash", "first_"), "set_hash", "left").select("doc_id", "key", "n_shingles", F.coalesce("first_", first).alias("first_"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A row's set holds its distinct shingles of ``width`` words (A-Z
    lower-cased; with fewer words, the whole sequence).  Rows are linked if
    100 * intersection >= ``percent`` * union.  A null text or one without words
    has the empty set and is linked with nothing.  The component is named by
    its smallest id (null: none of its rows has one), and a row of that id is
    kept.  Rows that share an id are judged each by its own text, in any order
    the same; a row without an id is kept if its component has none.  Very long
    texts are taken whole.  An empty table gives an empty result; other columns
    play no part.  A link at exactly 80 % is missed with a chance of 5e-8
    (32 bands of 4 values), a closer one with less.
    """
    space = Workspace(docs.sparkSession, "neardup")
    doc_id = F.col("doc_id").cast("long")
    out = _resolved(space, docs.select(doc_id.alias("doc_id"), doc_id.alias("key"), "text"), width, percent, permutations, rows)
    component = F.col("first_.doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``near_duplicates`` stays, with the columns of ``docs``.

    It is a row of the smallest id; of repeated rows one stays, and a row
    without an id goes if it is a near copy of another.  Rows without a word
    all stay.  The rows are written once with a number of their own.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "neardrop")
    (key,) = fresh(docs, "row_")
    numbered = space.write(docs.withColumn(key, F.monotonically_increasing_id()))
    rows = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("key"), "text")
    gone = space.write(_resolved(space, rows, width, percent, PERMUTATIONS, BAND_ROWS).where("key <> first_.key").select(F.col("key").alias(key)))
    return numbered.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies by four-word shingles, at a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
