"""Similarity join on word n-grams: which texts have n-gram sets of a Jaccard similarity at or above a percentage.

Prefix filtering with the rarest n-grams first. All n-grams are counted over all texts into ``BUCKETS`` counters (a fixed
size, so it can be broadcast); the order is (counter, hash), so frequent n-grams come last in every text. Two sets
that are similar enough share an n-gram among the first |x| - ceil(p |x|) + 1 of each. Texts with one and the same
set are one class, and a class is compared once.

Candidates of a shared prefix n-gram pass a length, a positional and a suffix filter, and each surviving pair is verified
once, on the words themselves. A crowd of similar texts shares its prefix n-grams and would be all pairs; so pairs
come in rounds. In a list of an n-gram in order of set size, a text is paired with the first one still near enough in size
and with its neighbour, which is linear in the list: first in each text's longest list only, then in all. Verified pairs give
components; lists whose members all are in one component are done. Last, all pairs across components in the lists left are
tested: a link inside a component changes nothing. The result is the exact components of the link relation.

Lists of an n-gram may be as long as the crowd that holds it: they are counted by partial aggregates, cut by range where one pass over
them in order is enough, and salted where they are joined.

Defined results: words are runs without white space (\\x20 and \\x09 to \\x0D), A-Z in lower case; a text with fewer words
than the n-gram size has its whole sequence as its only member; null, empty and blank texts have empty sets and link
with nothing; repeated rows, and rows of equal key but different texts, are rows of their own, each with its own set size and
component; a row with a null key links with nothing and has a null component_id; a text of any length is read whole (its set takes a few
times its size in memory); extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.components import connected_components
from ostinato.llm.key_filter import marked
from ostinato.llm.spread import salted_join
from ostinato.llm.text_arrays import byte_table, mix, set_hashes, shingle_hashes, slices, span_hashes, words
from ostinato.runtime import discard, partitions, persist_table, short_lived_shuffles

#: Counters for n-gram frequencies (16 MB), and the segments they are summed in. What tells a frequent n-gram from the
#: chance load of its counter gets clearer as the input grows, as the load's spread grows with its root only.
BUCKETS, SEGMENTS = 1 << 22, 256
#: Parts that the suffix filter cuts the hashes of a set into; a set is told by the parity of each part's count, 128 bytes.
PARTS = 1024
SIZE, PERCENT = 3, 90


def text_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct n-gram hashes, their rows, row bounds), rows counted from the first."""
    table = byte_table(lower=True)
    for first, end, data, offsets in slices(column):
        starts, ends, of_row = words(data, offsets)
        hashes, rows = shingle_hashes(span_hashes(data, starts, ends, table), of_row, size)
        yield first, end, *set_hashes(hashes, rows, end - first)


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def gram_counts(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Occurrences of n-grams (once per text) by counter, over all texts; BUCKETS numbers reach the driver.

    A task sends each segment of its counters compressed; segments are summed as they stream by.
    """
    width = BUCKETS // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.uint32)
        for batch in batches:
            for _, _, hashes, _, _ in text_sets(batch.column(0), size):
                np.add.at(total, counter_of(hashes), 1)
        yield from packed({k: total[k * width : (k + 1) * width] for k in range(SEGMENTS)})

    def packed(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, own in sums.items():
            if own.any():
                data = zlib.compress(own.astype("<u4").tobytes(), 1)
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["segment", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(data), dtype="<u4")
                sums[k] = own + sums[k] if k in sums else own
        yield from packed(sums)

    schema = "segment int, data binary"
    parts = docs.select(text).mapInArrow(count, schema).repartition(partitions(docs.sparkSession), "segment")
    out = np.zeros(BUCKETS, dtype=np.uint32)
    for row in parts.mapInArrow(add, schema).collect():  # SEGMENTS rows
        out[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(zlib.decompress(row["data"]), dtype="<u4")
    return out


def set_features(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Per row: key, th (hash of the text), n, signature (two hashes of the set), prefix (hashes, rarest first) and parities."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(gram_counts(docs, text, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = counts.value
        for batch in batches:
            for first, end, hashes, rows, bounds in text_sets(batch.column(2), size):
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                order = np.lexsort((hashes, rare[counter_of(hashes)], rows))
                keep = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)  # the prefix length of a set of n
                place = np.arange(len(hashes)) - bounds[:-1][rows]
                prefix = hashes[order][place < keep[rows]]
                sums = np.zeros((2, len(n)), dtype=np.uint64)
                if len(full):
                    for salt in (1, 2):
                        sums[salt - 1, full] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), bounds[full])
                parts = np.zeros((len(n), PARTS), dtype=np.uint8)
                np.add.at(parts, (rows, (hashes & np.uint64(PARTS - 1)).astype(np.int64)), 1)
                parity = np.packbits(parts & 1, axis=1).view(np.int64)
                at = lambda k: pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, end - first),
                        batch.column(1).slice(first, end - first),
                        pa.array(n.astype(np.int64)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(at(keep), pa.array(prefix.view(np.int64))),
                        pa.ListArray.from_arrays(at(np.full(len(n), PARTS // 64)), pa.array(parity.ravel())),
                    ],
                    names=["key", "th", "n", "sig1", "sig2", "prefix", "parity"],
                )

    schema = "key long, th long, n long, sig1 long, sig2 long, prefix array<long>, parity array<long>"
    return identified(docs, key, text).mapInArrow(run, schema)


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, th and text; a key and its text's hash tell a row."""
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))


def needed(n: F.Column, m: F.Column, percent: int) -> F.Column:
    """The least overlap of sets of n and m with the similarity asked for: ceil(p (n + m) / (100 + p))."""
    return F.floor((F.lit(percent) * (n + m) + (99 + percent)) / F.lit(100 + percent))


def near_enough(a: str, b: str, percent: int) -> F.Column:
    """Length and positional filter for two prefix entries (n, pos) of one n-gram."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    # entries before this one: at most the smaller position is shared, too
    most = F.least(F.col(f"{a}.pos"), F.col(f"{b}.pos")) + left
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (most >= needed(n, m, percent))


def few_apart(a: str, b: str, percent: int) -> F.Column:
    """Suffix filter for two sets (n, parity): each member of one set only turns one part's parity, so the sets differ in at
    least as many members as parts."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.aggregate(
        F.zip_with(f"{a}.parity", f"{b}.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    return apart <= n + m - 2 * needed(n, m, percent)


def _shared(every: DataFrame) -> DataFrame:
    """Entries of n-grams that more than one text holds, with ``many``, how many: most n-grams occur once and go no further."""
    counted = every.groupBy("gram").agg(F.count("*").alias("many")).where("many > 1")
    shared = persist_table(counted, "shared-grams")
    told = marked(every, ["gram"], shared, ["gram"]).where("_maybe").drop("_maybe")
    return salted_join(told, shared, ["gram"], ["key"], shared.select("gram", F.col("many").alias("n")))


def _hub_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Linear candidates of each n-gram's list in order of (n, key): neighbours, and each one with the first of its run, a run
    being cut where its first one is too small for the next. One streaming pass over sorted partitions, two rows held; a long list may
    go on in the next partition, with a first one of its own. What that leaves apart is met across components in the end."""
    n_parts = partitions(entries.sparkSession)
    columns = ("gram", "n", "pos", "key", "comp")
    ordered = entries.select(*columns).repartitionByRange(n_parts, "gram", "n", "key").sortWithinPartitions("gram", "n", "key")

    def passes(x: tuple, y: tuple) -> bool:
        """x is the smaller set. Rows are (gram, n, pos, key, comp)."""
        n, m = x[1], y[1]
        if x[4] == y[4] or n * 100 < m * percent:
            return False
        least = -(-percent * (n + m) // (100 + percent))
        most = min(x[2], y[2]) + min(n - x[2], m - y[2])
        return most >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = hub = None
        for batch in batches:
            out: set[tuple[int, int]] = set()
            for now in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if before is None or before[0] != now[0]:
                    before = hub = now
                    continue
                if hub[1] * 100 < now[1] * percent:
                    hub = before
                for other in (hub,) if hub is before else (hub, before):
                    if passes(other, now):
                        out.add((other[3], now[3]) if other[3] < now[3] else (now[3], other[3]))
                before = now
            pairs = np.array(sorted(out), dtype=np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _word_set(text: str, size: int) -> set:
    """The set by the words themselves; bytes.lower and bytes.split know A-Z and the six white-space bytes only."""
    own = text.encode().lower().split()
    if len(own) < size:
        return {tuple(own)} if own else set()
    return set(zip(*(own[k:] for k in range(size)), strict=False))


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes (id, key, th) whose texts (key, th, text) are similar enough, each compared once.

    Pairs are grouped by their first text, which is sent once per group of ``FAN`` pairs, and stream by it.
    """
    spark = pairs.sparkSession
    pairs = persist_table(pairs, "candidates")
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int"))
    # a text with few partners is sent once; one with many is sent to up to 64 parts
    many = pairs.groupBy("a").agg(F.count("*").alias("k"))
    dealt = salted_join(dealt, many, ["a"], ["b"], many.select("a", F.col("k").alias("n")))
    dealt = dealt.withColumn("part", F.pmod(F.col("part"), F.least(F.lit(64), F.ceil(F.col("k") / FAN)).cast("int")))
    dealt = persist_table(dealt.select("a", "b", "part"), "pairs")
    heads = dealt.select(F.col("a").alias("id"), "a", "part", F.lit(None).cast("long").alias("b")).distinct()
    wanted = heads.unionAll(dealt.select(F.col("b").alias("id"), "a", "part", "b"))
    wanted = persist_table(wanted.join(classes.select("id", "key", "th").hint("merge"), "id").drop("id"), "wanted")
    counts = persist_table(wanted.groupBy("key", "th").agg(F.count("*").alias("n")), "wanted-texts")
    near = marked(texts, ["key", "th"], counts, ["key", "th"]).where("_maybe").drop("_maybe")
    # a text that many pairs hold is sent to several tasks
    rows = salted_join(wanted, near, ["key", "th"], ["a", "b"], counts).select("a", "part", "b", "text")
    ordered = rows.repartition(2 * partitions(spark), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: set = set()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = _word_set(text.as_py() or "", size)
                if b is None:
                    head = own
                    continue
                shared = len(head & own)
                if 100 * shared >= percent * (len(head) + len(own) - shared):
                    found.append((a, b))
            yield pa.record_batch(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"]
            )

    return ordered.mapInArrow(run, "a long, b long")


FAN = 64


def shingle_components(docs: DataFrame, key: str, text: str, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row: key, n_shingles, component_id and text_hash (xxhash64 of the text: with the key it tells a row).

    Shuffle files go when their query ends, and tables as soon as the next ones have taken what they hold.
    """
    with short_lived_shuffles(docs.sparkSession):
        return _components(docs, key, text, size, percent)


def _components(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    features = persist_table(set_features(docs, key, text, size, percent), "sets")
    one = F.struct("key", "th")
    of_set = features.where("key is not null and n > 0").groupBy("n", "sig1", "sig2")
    class_of = of_set.agg(F.min(one).alias("one"), F.count("*").alias("rows"), F.min_by("prefix", one).alias("prefix"), F.min_by("parity", one).alias("parity"))
    classes = persist_table(class_of.select("n", "sig1", "sig2", "one.*", "rows", "prefix", "parity").withColumn("id", F.monotonically_increasing_id()), "set-classes")
    rows = persist_table(features.select("key", "th", F.col("n").alias("size"), "sig1", "sig2"), "set-rows")
    discard(features)
    parities = classes.select(F.col("id").alias("key"), "n", "parity")
    every = classes.select(F.col("id").alias("key"), "n", F.posexplode("prefix").alias("pos", "gram"))
    entries = persist_table(_shared(every).withColumn("comp", F.col("key")), "prefixes")
    texts = identified(docs, key, text)

    def tested(pairs: DataFrame) -> DataFrame:
        return verified(pairs, classes, texts, size, percent)

    def filtered(pairs: DataFrame) -> DataFrame:
        one, two = parities.alias("x"), parities.alias("y")
        first = pairs.join(one, F.col("a") == F.col("x.key")).select("a", "b", F.col("x.n"), "parity").alias("p")
        near = first.join(two, (F.col("p.b") == F.col("y.key")) & few_apart("p", "y", percent))
        return near.select("p.a", "p.b")

    def opened(links: DataFrame, last: DataFrame) -> DataFrame:
        """Entries with their components, of n-grams whose lists still hold several components; ``last`` is read no more."""
        component = connected_components(links, "a", "b").withColumnsRenamed({"node": "key", "component": "now"})
        placed = last.join(component, "key", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")
        placed = persist_table(placed, "prefixes")
        held = placed.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
        still = persist_table(held.where("lo < hi").select("gram", "n"), "open-grams")
        kept = persist_table(salted_join(placed, still.select("gram"), ["gram"], ["key"], still), "prefixes")
        discard(last, placed, still)
        return kept

    # each text's n-gram of the longest list: a crowd meets at one hub
    top = entries.groupBy("key").agg(F.max_by(F.struct("gram", "n", "pos", "comp"), F.struct("many", "gram")).alias("t"))
    links = persist_table(tested(filtered(_hub_pairs(top.select("key", "t.*"), percent))), "links")
    left = opened(links, entries)
    links = persist_table(tested(filtered(_hub_pairs(left, percent))).unionAll(links), "links")
    last = opened(links, left)
    left = last.join(parities.drop("n"), "key")
    side = lambda name: left.select("gram", F.struct("key", "n", "pos", "comp", "parity").alias(name))
    lists = last.groupBy("gram").agg(F.count("*").alias("n"))
    close = near_enough("x", "y", percent) & few_apart("x", "y", percent)
    across = (
        salted_join(side("x"), side("y"), ["gram"], ["x.key"], lists)
        .where((F.col("x.comp") < F.col("y.comp")) & close)
        .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
        .distinct()
    )
    all_links = persist_table(tested(across).unionAll(links), "links")
    final = persist_table(connected_components(all_links, "a", "b").withColumnRenamed("node", "id"), "set-components")
    # a component is named by its smallest key
    members = final.join(classes.select("id", "key"), "id")
    first = persist_table(members.groupBy("component").agg(F.min("key").alias("first"), F.count("*").alias("n")), "component-names")
    named = salted_join(final, first.drop("n"), ["component"], ["id"], first.drop("first")).select("id", "first")
    told = classes.select("id", "n", "sig1", "sig2", "key", "rows").join(named, "id", "left")
    told = persist_table(told.select("n", "sig1", "sig2", F.coalesce("first", "key").alias("component_id"), "rows"), "set-components")
    counts = told.select("n", "sig1", "sig2", F.col("rows").alias("_rows")).withColumnRenamed("n", "size")
    # one set may be that of a third of all rows
    met = salted_join(
        rows, told.drop("rows").withColumnRenamed("n", "size"), ["size", "sig1", "sig2"], ["key", "th"], counts.withColumnRenamed("_rows", "n"), "left"
    )
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    met = persist_table(met, "set-components")  # it is read more than once by those who filter by it
    return met.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("th").alias("text_hash"))
