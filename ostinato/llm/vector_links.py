"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, then exact cosines.

A vector is normalised in double precision and projected on Gaussian directions; floor((projection + shift) / width) of
``per_table`` directions names its bucket in a table. Vectors that share a bucket in some table are compared exactly, in
double precision. A pair that shares buckets in several tables counts in the first of them only, so pairs are counted without
being listed. Bucket names are not sent along: where a close pair is met, those of the tables before are worked out anew, and are the
same everywhere, as projections are sums of whole multiples that a double holds without rounding. For the components a bucket yields at
most one link per vector (a spanning forest of its links).

Equal vectors are one class: a class is compared once and counts as many times as it has members. Buckets larger than
``BLOCK`` classes are cut into blocks, and each pair of blocks is one piece of work, so neither memory nor a task's work
follows the largest bucket; from 4 blocks on, blocks grow with the root of the bucket, and so does the number of copies of its vectors.

The number of directions per table follows the number of classes: so many that a vector shares a bucket with about
``crowd(n)`` unrelated vectors. A vector that is sent costs as much as some thousand comparisons, so fewer tables with larger buckets are
less work. The number of tables follows from that and holds the chance of missing a pair at the threshold at ``MISS``; closer pairs are missed less.

Tables are worked through in turns. A turn has so many tables that what it shuffles is about ``TURN`` bytes or twice the vectors, whichever is
more, and its shuffle files go when it ends: disk follows the vectors, not the vectors times the tables.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths never link; repeated keys are rows of their own that share links; a row with a null key links
with nothing and has a null component_id and kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ostinato.llm.components import connected_components
from ostinato.llm.spread import salted_join
from ostinato.runtime import partitions, persist_table, short_lived_shuffles

WIDTH, SEED, MISS = 2.0, 20240229, 0.03
#: Classes of a block, and those compared at once: the matrix of cosines has TILE x TILE numbers.
BLOCK, TILE = 2048, 1024
#: Bytes that a turn may shuffle at any size.
TURN = 384 << 20


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that two points this far apart share the cell of one direction (Datar et al., 2004)."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def crowd(n: int) -> float:
    """Unrelated vectors that a vector meets in a table, about."""
    return min(1024.0, 64 * max(1.0, math.sqrt(n / 50_000)))


def table_plan(n: int, threshold: float, miss: float = MISS, width: float = WIDTH) -> tuple[int, int]:
    """(tables, directions per table) for n unit vectors, of which unrelated ones are about at right angles."""
    near, far = collision(math.sqrt(max(0.0, 2 - 2 * threshold)), width), collision(math.sqrt(2), width)
    per_table = max(4, math.ceil(math.log(max(n, 2) / crowd(n)) / -math.log(far)))
    found = near**per_table
    return (1 if found >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-found)))), per_table


def turns(tables: int, volume: float) -> list[range]:
    """Tables of each turn; ``volume``: bytes of all vectors with what is sent beside them."""
    most = max(1, int(max(TURN, 2 * volume) // max(volume, 1)))
    return [range(first, min(first + most, tables)) for first in range(0, tables, most)]


@lru_cache(maxsize=4)
def directions(dim: int, tables: int, per_table: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole multiples of 2^-20."""
    rng = np.random.default_rng((seed, dim))
    return tuple(np.rint(np.ldexp(x, 20)) / 2**20 for x in (rng.standard_normal((dim, tables * per_table)), rng.random(tables * per_table)))


def bucket_keys(unit: np.ndarray, tables: int, per_table: int, width: float, seed: int, own: range | None = None) -> np.ndarray:
    """A 64-bit bucket name per vector and table (of those in ``own``, or of all); tables never share names by construction of the hash.

    Components are rounded to multiples of 2^-22, so products and sums have no rounding up to some 100,000 components, and a vector's names
    don't depend on the vectors beside it nor on the order of sums.
    """
    planes, shift = directions(unit.shape[1], tables, per_table, seed)
    own = range(tables) if own is None else own
    part = slice(own.start * per_table, own.stop * per_table)
    cells = np.floor(np.rint(unit * 2**22) / 2**22 @ planes[:, part] / width + shift[part]).astype(np.int64).astype(np.uint64)
    cells = cells.reshape(len(unit), len(own), per_table)
    key = np.broadcast_to(np.arange(own.start, own.stop, dtype=np.uint64), (len(unit), len(own))).copy()
    for k in range(per_table):
        key = (key ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _values(vectors: DataFrame, column: str) -> F.Column:
    """Floats stay floats, which are half as large; all else is doubles."""
    kind = vectors.schema[column].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return F.col(column) if narrow else F.col(column).cast("array<double>")


def classes(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Valid vectors grouped by equality: (vec, rep, size)."""
    values = _values(vectors, column)
    good = F.exists(values, lambda v: v != 0) & F.forall(
        values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    valid = vectors.select(F.col(key).alias("id"), values.alias("vec")).where(good & F.col("id").isNotNull())
    return valid.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("size"))


def _forest(links: np.ndarray, ids: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join two trees, of links[i, j] between ids[i] and other[j]."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        a = int(ids[i])
        for j in np.flatnonzero(links[i]):
            ra, rb = find(a), find(int(other[j]))
            if ra != rb:
                parent[ra] = rb
                yield a, int(other[j])


def _compare(left: tuple, right: tuple | None, table: int, names, threshold: float, add, link) -> None:
    """Pairs of left and right (or of left), each (ids, sizes, unit vectors); names(unit, k): bucket names of table k."""
    ids, sizes, unit = left
    ids2, sizes2, unit2 = right or left
    # single precision errs by less than this; only rows that have a pair here are multiplied in double precision
    near = unit.astype(np.float32) @ unit2.astype(np.float32).T >= threshold - 1e-6 - 2e-7 * unit.shape[1]
    if right is None:
        np.fill_diagonal(near, False)
    one, two = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(one):
        return
    unit, unit2 = unit[one], unit2[two]
    near = (unit @ unit2.T >= threshold) & near[np.ix_(one, two)]
    i, j = np.nonzero(near)
    if table and len(i):  # a pair counts in the first table where it meets
        keys, keys2 = names(unit, table), names(unit2, table)
        for k in range(table):
            new = keys[i, k] != keys2[j, k]
            i, j = i[new], j[new]
        near = np.zeros_like(near)
        near[i, j] = True
    if not len(i):
        return
    ids, ids2 = ids[one], ids2[two]
    add(ids, near @ sizes2[two])
    if right is not None:
        add(ids2, near.T @ sizes[one])
    for a, b in _forest(near, ids, ids2):
        link(a, b)


def vector_links(
    vectors: DataFrame, key: str, column: str, threshold: float = 0.9, miss: float = MISS, width: float = WIDTH, seed: int = SEED
) -> DataFrame:
    """Per row: key, n_links, component_id and kept. A pair at the threshold is missed with a chance of ``miss``."""
    spark = vectors.sparkSession
    with short_lived_shuffles(spark):
        of_class = persist_table(classes(vectors, key, column), "vector-classes")
        item = of_class.schema["vec"].dataType.elementType
        seen = of_class.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("numbers")).first()
        tables, per_table = table_plan(seen["n"], threshold, miss, width)
        volume = 48 * seen["n"] + (4 if isinstance(item, FloatType) else 8) * seen["numbers"]
        found = None
        for own in turns(tables, volume):
            part = persist_table(_met(of_class, seen["n"], own, tables, per_table, threshold, width, seed), "vector-links")
            found = found.unionAll(part) if found else part
        links = found.where("to is not null")
        component = connected_components(links, "rep", "to").withColumnsRenamed({"node": "rep"})
        counted = found.where("to is null").groupBy("rep").agg(F.sum("n").alias("near"))
        told = (
            of_class.join(counted, "rep", "left")
            .join(component, "rep", "left")
            .select(
                "vec",
                "size",
                (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("_n"),
                F.coalesce("component", "rep").alias("_component"),
            )
        )
        told = persist_table(told, "vector-classes")
    rows = vectors.select(F.col(key).alias("_id"), F.when(F.col(key).isNotNull(), _values(vectors, column)).alias("vec"))
    # one vector may be that of a third of all rows
    met = salted_join(rows, told.drop("size"), ["vec"], ["_id"], told.select("vec", F.col("size").alias("n")), "left")
    return met.select(
        F.col("_id").alias(key),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_component", "_id").alias("component_id"),
        (F.col("_id") == F.coalesce("_component", "_id")).alias("kept"),
    )


def _met(of_class: DataFrame, n: int, own: range, tables: int, per_table: int, threshold: float, width: float, seed: int) -> DataFrame:
    """What the tables of ``own`` add: (rep, null, n) numbers of links and (rep, to, 0) links."""
    item = of_class.schema["vec"].dataType.elementType.simpleString()
    dealt = "rep long, size long, vec array<%s>, buckets array<long>" % item

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for dim in np.unique(lengths).tolist():
                rows = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                for k in range(0, rows.num_rows, 1024):
                    part = rows.slice(k, 1024)
                    keys = bucket_keys(_unit(_matrix(part.column(2), dim)), tables, per_table, width, seed, own)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel(), pa.int64()), len(own)).cast(pa.list_(pa.int64()))
                    yield pa.record_batch([*part.columns, lists], names=["rep", "size", "vec", "buckets"])

    named = of_class.select("rep", "size", "vec").mapInArrow(hashed, dealt)
    # vectors of one length only share a table
    names = named.select("rep", "size", "vec", F.posexplode("buckets").alias("t", "bucket")).withColumn("t", F.size("vec").cast("long") * tables + own.start + F.col("t"))
    whole = F.lit(1)
    if n > BLOCK:
        # at most one row per BLOCK rows of a turn
        large = names.groupBy("t", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        names = names.join(F.broadcast(persist_table(large, "crowded-buckets")), ["t", "bucket"], "left")
        parts = F.col("n") / BLOCK
        whole = F.coalesce(F.least(F.ceil(parts), 2 * F.ceil(F.sqrt(parts))), F.lit(1))
    # block of a class in a large bucket by a hash; each pair of blocks is one piece of work
    work = (
        names.withColumn("blocks", whole.cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "rep", "size", "vec")
        .repartition(4 * partitions(of_class.sparkSession), "t", "bucket", "lo", "hi")
        .sortWithinPartitions("t", "bucket", "lo", "hi", "mine")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        links: list[tuple[int, int]] = []

        def add(ids: np.ndarray, found: np.ndarray) -> None:
            for k in np.flatnonzero(found):
                counts[int(ids[k])] = counts.get(int(ids[k]), 0) + int(found[k])

        def link(a: int, b: int) -> None:
            links.append((a, b))

        def names(unit: np.ndarray, table: int) -> np.ndarray:
            return bucket_keys(unit, tables, per_table, width, seed, range(table))

        def solve(dim: int, table: int, ids: np.ndarray, sizes: np.ndarray, unit: np.ndarray, cut: int | None) -> None:
            tile = lambda low, end: tuple(x[low : min(low + TILE, end)] for x in (ids, sizes, unit))
            if cut is None:
                for low in range(0, len(ids), TILE):
                    _compare(tile(low, len(ids)), None, table, names, threshold, add, link)
                    for high in range(low + TILE, len(ids), TILE):
                        _compare(tile(low, len(ids)), tile(high, len(ids)), table, names, threshold, add, link)
            else:
                for low in range(0, cut, TILE):
                    for high in range(cut, len(ids), TILE):
                        _compare(tile(low, cut), tile(high, len(ids)), table, names, threshold, add, link)

        def flush() -> pa.RecordBatch:
            ids = list(counts)
            made = pa.record_batch(
                [
                    pa.array(ids + [a for a, _ in links], pa.int64()),
                    pa.array([None] * len(ids) + [b for _, b in links], pa.int64()),
                    pa.array([counts[k] for k in ids] + [0] * len(links), pa.int64()),
                ],
                names=["rep", "to", "n"],
            )
            counts.clear()
            links.clear()
            return made

        def solved(rows: pa.RecordBatch, last: bool) -> int:
            """Solves the groups of rows, without the last one if it may go on; returns where that starts."""
            t, bucket, lo, hi, mine, rep, size = (rows.column(c).to_numpy() for c in range(7))
            change = np.zeros(rows.num_rows - 1, dtype=bool)
            for c in (t, bucket, lo, hi):
                change |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [rows.num_rows] if last else []]).astype(np.int64)
            vec = rows.column(7)
            values, starts = vec.values.to_numpy(), vec.offsets.to_numpy()
            for k in np.flatnonzero(np.diff(cuts) > 1):
                a, b = cuts[k], cuts[k + 1]
                dim, table = divmod(int(t[a]), tables)
                cut = None if lo[a] == hi[a] else int((mine[a:b] == lo[a]).sum())
                if cut is None or 0 < cut < b - a:
                    unit = _unit(values[starts[a] : starts[b]].reshape(-1, dim).astype(np.float64))
                    solve(dim, table, rep[a:b], size[a:b], unit, cut)
            return int(cuts[-1])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            held = [rows.slice(solved(rows, False))]
            if len(counts) + len(links) > 50_000:
                yield flush()
        if held:
            solved(pa.Table.from_batches(held).combine_chunks().to_batches()[0], True)
        yield flush()

    return work.mapInArrow(compared, "rep long, to long, n long")
