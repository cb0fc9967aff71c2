"""Near-duplicates of word shingles by an LSH forest.

A text's set is its distinct shingles of five words. Equal sets are one class from the
start. For the rest, several trees hold each signature as a row of minima, sorted.
Neighbours in a sorted order that share a prefix are candidates, the longest prefixes
nearest; they are confirmed on the full sets and joined to components. Where a prefix
has more rows than that reaches, its region is gone through whole, but only across
components, and at a depth at which it has a bounded number of rows. Documents of regions
that were split for it, or are larger at every depth, meet once more, however the trees
part them: those whose rarest shingles, as many as two alike sets can't do without, have
one in common, whatever number of documents has it. Components of
all confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, Tables, Words, components, mixed, pieces, rolling, text_of

TREES, DEPTH, LEAST_DEPTH, NEIGHBOURS = 24, 8, 2, 4
PERCENT = 75
#: Rows of a region that is gone through whole; a larger one is split at its next depth, and its rows meet by their rarest shingles.
REGION = 1024
#: Buckets of shingles whose documents are counted, a power of two: what the driver and each task hold.
BUCKETS = 1 << 20
#: Shingles, and rows, of a block of a region's rows.
BLOCK, ROWS = 1 << 15, 1 << 10
#: Shingles are hashes of so many bits; beside them fits a text's place in a slice.
BITS = 52


def shingle_sets(array: pa.Array, words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text, sorted within it."""
    _, _, hashes, first = words.of(array)
    n, count = len(array), np.diff(first)
    every = rolling(hashes, size)
    doc = np.repeat(np.arange(n), count)
    whole = np.flatnonzero(np.arange(len(every)) + size <= first[1:][doc[: len(every)]]) if len(every) else np.zeros(0, np.int64)
    keys, owner = every[whole], doc[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = count[short] > j
            value[has] = value[has] * np.uint64(0xD6E8FEB86659FD93) + hashes[first[:-1][short[has]] + j]
        keys = np.concatenate([keys, mixed(value + count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    both = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | (keys >> np.uint64(64 - BITS)))
    owner = (both >> np.uint64(BITS)).astype(np.int64)
    return both & np.uint64((1 << BITS) - 1), np.searchsorted(owner, np.arange(n + 1))


def signatures(docs: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, n_shingles, low, high, labels): set size, two sums that name the set, and a label for each tree."""
    factors = (mixed(np.arange(1, trees * depth + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in pieces(batches):
            keys, offsets = shingle_sets(batch.column("text"), words, size)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            low, high = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            labels = np.zeros((len(n), trees * depth), ">u2")
            if len(full):
                at = offsets[:-1][full]
                wide = mixed(keys)
                low[full], high[full] = np.add.reduceat(wide, at), np.add.reduceat(mixed(wide + np.uint64(7)), at)
                short = (wide >> np.uint64(32)).astype(np.uint32)
                for k, factor in enumerate(factors):
                    labels[full, k] = np.minimum.reduceat(short * factor, at) * np.uint32(0x9E3779B1) >> np.uint32(16)
            flat = labels.reshape(-1).view(np.uint8).tobytes()
            step = trees * depth * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array([flat[i * step : (i + 1) * step] for i in range(len(n))], pa.binary())],
                ["doc_id", "n_shingles", "low", "high", "labels"],
            )

    return text_of(docs).mapInArrow(run, "doc_id long, n_shingles long, low long, high long, labels binary")


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading columns of each row."""
    return np.minimum.accumulate(a == b, axis=1).sum(1)


def neighbours(tables: Tables, forest: DataFrame, depth: int, least_depth: int, percent: int, reach: int) -> DataFrame:
    """(a, b, prefix): pairs near each other in a tree's sorted order, and the prefix that they share.

    A partition holds a stretch of the total order, however dense it is, so a region of
    alike signatures can lie in many of them. Rows of its two ends are kept as edges,
    and paired with those of the next partitions afterwards.
    """

    def paired(doc: np.ndarray, size: np.ndarray, key: np.ndarray, old: int = 0, part: np.ndarray | None = None) -> list[tuple]:
        """Candidates; old: so many rows at the start have been paired with each other already."""
        found = []
        for step in range(1, reach + 1):
            if len(doc) <= step:
                break
            same = shared_prefix(key[:-step], key[step:])
            small, large = np.minimum(size[:-step], size[step:]), np.maximum(size[:-step], size[step:])
            good = (same > least_depth) & (small * 100 >= large * percent) & (doc[:-step] != doc[step:])  # the first column is the tree
            if part is not None:
                good &= part[:-step] != part[step:]
            good[: max(0, old - step)] = False
            at = np.flatnonzero(good)
            found.append((np.minimum(doc[at], doc[at + step]), np.maximum(doc[at], doc[at + step]), same[at] - 1))
        return found

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u2").reshape(-1, depth + 1)
        return batch.column("doc_id").to_numpy(), batch.column("n_shingles").to_numpy(), key

    def out(found: list[tuple], edge: tuple | None = None, part: int = 0, place: int = 0) -> pa.RecordBatch:
        a, b, same = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        n, m = len(a), len(edge[0]) if edge else 0
        none = [None] * n
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*a.tolist(), *(edge[0].tolist() if m else [])], pa.int64()),
                pa.array([*b.tolist(), *(edge[1].tolist() if m else [])], pa.int64()),
                pa.array([*same.tolist(), *[-1] * m], pa.int32()),
                pa.array([*none, *(x.tobytes() for x in edge[2])] if m else none, pa.binary()),
                pa.array([*none, *[part] * m], pa.int32()),
                pa.array([*none, *range(place, place + m)], pa.int64()),
            ],
            ["a", "b", "prefix", "label", "part", "place"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = columns(batch)
            if last is None:
                yield out([], tuple(x[:reach] for x in rows), part, 0)
                both, skip = rows, 0
            else:
                both, skip = tuple(np.concatenate(x) for x in zip(last, rows)), len(last[0])
            yield out(paired(*both, old=skip))
            last, seen = tuple(x[-reach:] for x in both), seen + batch.num_rows
        if last is not None and seen > reach:
            yield out([], tuple(x[-min(reach, seen - reach) :] for x in last), part, seen)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:  # a few rows of each partition, one stretch after another
            if batch.num_rows:
                key = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u2").reshape(-1, depth + 1)
                rows = (batch.column("a").to_numpy(), batch.column("b").to_numpy(), key, batch.column("part").to_numpy())
                both, old = (rows, 0) if last is None else (tuple(np.concatenate(x) for x in zip(last, rows)), len(last[0]))
                yield out(paired(*both[:3], old=old, part=both[3]))
                last = tuple(x[-reach:] for x in both)

    schema = "a long, b long, prefix int, label binary, part int, place long"
    near = tables.saved(forest.mapInArrow(run, schema), "neighbours")
    edges = near.where("prefix = -1").coalesce(1).sortWithinPartitions("label", "a", "part", "place").mapInArrow(across, schema)
    return near.where("prefix >= 0").union(edges).select("a", "b", "prefix")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of (a, b) with 100 * intersection >= percent * union of the full sets."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("keys").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("keys").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20, 500, "x"):
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                together = np.sort(np.concatenate([x, y]))
                same = int((together[1:] == together[:-1]).sum())
                good.append(100 * same >= percent * (len(together) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def overlaps(a_n: np.ndarray, a_keys: np.ndarray, b_n: np.ndarray, b_keys: np.ndarray, width: int = 4096) -> np.ndarray:
    """The size of the intersection of each set of a with each of b; sets lie one after another, with the given sizes."""
    shared = np.intersect1d(a_keys, b_keys)
    sides = []
    for n, keys in ((a_n, a_keys), (b_n, b_keys)):
        place = np.searchsorted(shared, keys)
        hit = place < len(shared)
        hit[hit] = shared[place[hit]] == keys[hit]
        row, place = np.repeat(np.arange(len(n)), n)[hit], place[hit]
        order = np.argsort(place, kind="stable")
        sides.append((len(n), row[order], place[order]))
    both = np.zeros((len(a_n), len(b_n)), np.int64)
    for at in range(0, len(shared), width):  # so many shingles at a time, as 0 and 1
        grids = []
        for n, row, place in sides:
            some = slice(*np.searchsorted(place, [at, at + width]))
            grid = np.zeros((n, width), np.float32)
            grid[row[some], place[some] - at] = 1
            grids.append(grid)
        both += (grids[0] @ grids[1].T).astype(np.int64)
    return both


def regions(tables: Tables, forest: DataFrame, depth: int, least_depth: int, reach: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(region, doc_id, n_shingles): rows that share a prefix with more others than neighbours reach; (doc_id): those of regions that were split, once for each, or None.

    A region is the shortest prefix, from least_depth on, that at most so many rows have.
    It begins with its tree's number. Rows of larger ones at the last depth are in none.
    """
    out, counts, split = None, [], None

    def counted(rows: DataFrame) -> DataFrame:
        counts.append(tables.saved(rows.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > reach + 1), "counts"))
        return counts[-1]

    rows = forest.select("doc_id", "n_shingles", "label", F.substring("label", 1, 2 * (least_depth + 1)).alias("region"))
    count = counted(rows)
    out = rows.join(count.where(F.col("n") <= most), "region").select("region", "doc_id", "n_shingles")
    large = count.where(F.col("n") > most).select("region")
    if not large.isEmpty():
        rest = tables.saved(rows.join(large, "region", "left_semi").select("doc_id", "n_shingles", "label"), "rest")
        counts.append(rest)
        split = tables.saved(rest.select("doc_id"), "split")
        if depth > least_depth:  # all longer prefixes are counted at once
            longer = F.explode(F.expr(f"transform(sequence({least_depth + 2}, {depth + 1}), d -> substring(label, 1, 2 * d))"))
            rows = rest.select("doc_id", "n_shingles", longer.alias("region"))
            count = counted(rows)
            above = large.union(count.where(F.col("n") > most).select("region")).withColumnRenamed("region", "above")
            final = count.where(F.col("n") <= most).withColumn("above", F.expr("substring(region, 1, length(region) - 2)")).join(above, "above", "left_semi").select("region")
            out = out.union(rows.join(final, "region").select("region", "doc_id", "n_shingles"))
    out = out.withColumn("lead", F.lit(True))  # every row meets every other
    return tables.saved(out, "regions", tuple(counts)), split


def rare_members(tables: Tables, split: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(region, doc_id, component, n_shingles, lead): documents by their rarest shingles.

    All shingles have one order, by the number of documents in their bucket (of BUCKETS),
    then by hash. Two alike sets share a shingle among the first n - ceil(n * percent / 100)
    + 1 of each, and of the smaller one, which leads, even among its first
    n - ceil(2 * n * percent / (100 + percent)) + 1, as their sizes bound what they share.
    Shingles whose whole bucket is in one component take their places but link nothing.
    """
    named = found.withColumnRenamed("node", "doc_id")
    docs = sets.join(split, "doc_id", "left_semi").join(named, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"), "keys")
    docs = tables.saved(docs, "split-sets")
    bucket_of = lambda keys: (keys & (BUCKETS - 1)).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20, 4000, "keys"):
            keys = [np.frombuffer(k.as_buffer(), np.int64) for k in batch.column("keys")]
            component = np.repeat(batch.column("component").to_numpy(), [len(k) for k in keys])
            bucket = bucket_of(np.concatenate(keys))
            order = np.argsort(bucket, kind="stable")
            bucket, component = bucket[order], component[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            n = np.diff(np.append(at, len(bucket)))
            columns = [bucket[at], n, *(f.reduceat(component, at) if len(at) else at for f in (np.minimum, np.maximum))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["bucket", "n", "low", "high"])

    sizes = docs.mapInArrow(counted, "bucket long, n long, low long, high long").groupBy("bucket").agg(F.sum("n").alias("n"), (F.min("low") < F.max("high")).alias("several"))
    sizes = sizes.where("n > 1").toPandas()  # BUCKETS rows at most
    count, several = np.ones(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
    count[sizes["bucket"]], several[sizes["bucket"]] = sizes["n"], sizes["several"].astype(bool)
    shared = tables.spark.sparkContext.broadcast((count, several))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, several = shared.value
        for batch in pieces(batches, 2 << 20, 4000, "keys"):
            out = [(np.zeros(0, np.int64),) * 5]
            for doc, component, keys in zip(*(batch.column(c) for c in ("doc_id", "component", "keys"))):
                keys = np.frombuffer(keys.as_buffer(), np.int64)
                n = len(keys)
                first, lead = n - -(-n * percent // 100) + 1, n - -(-2 * n * percent // (100 + percent)) + 1
                bucket = bucket_of(keys)
                at = np.lexsort((keys, count[bucket]))[:first]
                use = several[bucket[at]]
                place = np.flatnonzero(use)
                out.append((keys[at[use]], *(np.full(len(place), x) for x in (doc.as_py(), component.as_py(), n)), place < lead))
            columns = [np.concatenate(x) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4].astype(bool))], ["shingle", "doc_id", "component", "n_shingles", "lead"])

    rows = docs.mapInArrow(taken, "shingle long, doc_id long, component long, n_shingles long, lead boolean")
    return tables.saved(rows.select(F.unhex(F.hex("shingle")).alias("region"), "doc_id", "component", "n_shingles", "lead"), "rare", (docs,))


def across_components(tables: Tables, members: DataFrame, found: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame | None:
    """(a, b): confirmed links between rows of a region that are in different components; None if no region has several.

    Rows of the region's largest component meet the others only, and of two rows one has
    to lead. Rows are in blocks of like sizes, dealt by hash, and a block meets those that
    its sizes can match. Block pairs are dealt evenly, so a region of any size is shared by all tasks.
    """
    if "component" in members.columns:
        at = held = members
    else:
        at = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("region", "doc_id", "n_shingles", "lead", F.coalesce("component", "doc_id").alias("component"))
        at = held = tables.saved(at, "members")
    sizes = at.groupBy("region", "component").agg(F.count("*").alias("n"), F.max("lead").alias("leads"))
    main = sizes.groupBy("region").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("components"), F.max("leads").alias("leads")).where("components > 1 and leads").select("region", "main")
    main = tables.saved(main, "main")
    if main.isEmpty():
        tables.drop(at, main)
        return None
    at = at.join(main, "region").withColumn("side", (F.col("component") == F.col("main")).cast("int")).withColumn("like", F.floor(F.log2(F.col("n_shingles").cast("double")) * 4).cast("int"))
    kind = ["region", "side", "lead", "like"]
    sides = tables.saved(at, "sides")
    blocks = sides.groupBy(kind).agg(F.ceil(F.greatest(F.sum("n_shingles") / block, F.count("*") / ROWS)).alias("blocks"))
    at = sides.join(blocks, kind).withColumn("number", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    rows = at.join(sets, "doc_id").groupBy(*kind, "number").agg(F.collect_list(F.struct("doc_id", "component", "keys")).alias("rows"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    rows = tables.saved(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")
    ends = rows.select("region", "side", "lead", "low", "high", "block")
    left = ends.where("side = 0").select("region", F.col("block").alias("x_block"), F.col("lead").alias("x_lead"), F.col("low").alias("x_low"), F.col("high").alias("x_high"))
    right = ends.select("region", F.col("block").alias("y_block"), "side", F.col("lead").alias("y_lead"), F.col("low").alias("y_low"), F.col("high").alias("y_high"))
    alike = (F.col("x_high") * 100 >= F.col("y_low") * percent) & (F.col("y_high") * 100 >= F.col("x_low") * percent)
    leading = (F.col("x_lead") & (F.col("x_low") <= F.col("y_high"))) | (F.col("y_lead") & (F.col("y_low") <= F.col("x_high")))
    pairs = left.join(right, "region").where(((F.col("side") == 1) | (F.col("x_block") <= F.col("y_block"))) & alike & leading).select("x_block", "y_block")
    numbers = tables.saved(pairs, "block-pairs")
    pairs = numbers.join(rows.select(F.col("block").alias("x_block"), F.col("rows").alias("x")), "x_block").join(rows.select(F.col("block").alias("y_block"), F.col("rows").alias("y")), "y_block").select("x", "y")

    def parts(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = rows.values
        keys = [np.frombuffer(k.as_buffer(), np.uint64) for k in rows.field("keys")]
        n = np.array([len(k) for k in keys])
        return rows.field("doc_id").to_numpy(), rows.field("component").to_numpy(), n, np.concatenate(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                (a, a_in, a_n, a_keys), (b, b_in, b_n, b_keys) = parts(x), parts(y)
                both = overlaps(a_n, a_keys, b_n, b_keys)
                good = (100 * both >= percent * (a_n[:, None] + b_n[None, :] - both)) & (a_in[:, None] != b_in[None, :])
                i, j = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j]))], ["a", "b"])

    return tables.saved(pairs.mapInArrow(run, "a long, b long"), "links", (held, sides, main, rows, numbers))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, least_depth: int = LEAST_DEPTH, reach: int = NEIGHBOURS, region: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document; components link sets of similarity percent / 100 or more.

    A text without words has n_shingles 0 and is linked with nothing; a null text is as
    an empty one. Ties: the smallest doc_id names a component and is kept. Rows that
    repeat a doc_id keep their number; null doc_ids form no links. The result is a table
    in the shared folder; all others of the run are gone when it is returned.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "near-duplicates")
    base = tables.saved(signatures(docs, size, trees, depth), "base")
    classes = base.where("n_shingles > 0").groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("class_id"), F.first("labels").alias("labels"))
    classes = tables.saved(classes, "classes")
    base = tables.saved(base.drop("labels"), "slim", (base,))
    tree = F.posexplode(F.expr(f"transform(sequence(0, {trees - 1}), i -> substring(labels, i * {2 * depth} + 1, {2 * depth}))"))
    forest = classes.where("class_id is not null").select(F.col("class_id").alias("doc_id"), "n_shingles", tree.alias("tree", "key"))
    prefix = F.unhex(F.lpad(F.hex("tree"), 4, "0"))
    forest = forest.select("doc_id", "n_shingles", F.concat(prefix, "key").alias("label"))
    # Ranges of the sorted order hold about a million rows each.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * trees // 1_000_000))
    members, split = regions(tables, forest, depth, least_depth, reach, region)
    pairs = neighbours(tables, forest.repartitionByRange(parts, "label", "doc_id").sortWithinPartitions("label", "doc_id"), depth, least_depth, percent, reach).groupBy("a", "b").agg(F.sum("prefix").alias("weight"))
    pairs = tables.saved(pairs, "pairs")
    classes = tables.saved(classes.drop("labels"), "classes", (classes,))

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(members.select("doc_id")).distinct()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in pieces(batches):
            keys, offsets = shingle_sets(batch.column("text"), words, size)
            flat = keys.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([flat[8 * i : 8 * j] for i, j in zip(offsets, offsets[1:])], pa.binary())], ["doc_id", "keys"])

    # The candidates' ids grow with the corpus, so they are never broadcast.
    once = text_of(docs).join(ids.hint("merge"), "doc_id").dropDuplicates(["doc_id"])
    sets = tables.saved(once.select("doc_id", "text").mapInArrow(sets_of, "doc_id long, keys binary"), "sets")

    # First each document's most promising candidate; then whatever still joins two components.
    ends = F.explode(F.array(*(F.struct(F.lit(low).alias("low"), F.col(x).alias("node"), F.col(y).alias("other"), "weight") for low, x, y in ((True, "a", "b"), (False, "b", "a")))))
    best = pairs.select(ends.alias("end")).select("end.*").groupBy("low", "node").agg(F.max_by("other", F.struct("weight", -F.col("other"))).alias("other"))
    first = tables.saved(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "first")
    found = components(confirmed(first, sets, percent), tables)

    def with_more(found: DataFrame, links: DataFrame) -> DataFrame:
        """Components of those found, as stars, and further links."""
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), tables)

    left = pairs.join(first, ["a", "b"], "left_anti").join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    left = tables.saved(left.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"), "left", (pairs, first))
    links = confirmed(left, sets, percent)
    dense = across_components(tables, members, found, sets, percent, BLOCK)
    found = with_more(found, links if dense is None else links.union(dense))
    tables.drop(left, members)
    if split is not None:
        rare = rare_members(tables, split, found, sets, percent)
        links = across_components(tables, rare, found, sets, percent, BLOCK)
        if links is not None:
            found = with_more(found, links)

    groups = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select("n_shingles", "low", "high", F.coalesce("component", "class_id").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "low", "high").join(groups, ["n_shingles", "low", "high"], "left")
    component = F.coalesce("component_id", "doc_id")
    out = tables.saved(out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")), "found")
    tables.keep_only(out)
    return out
