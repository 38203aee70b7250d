"""Packing pieces of token sequences into as few fixed-size sequences as possible, by a grouping genetic algorithm.

The work is spread as islands: pieces are dealt to islands of about ``ISLAND`` pieces by a hash, and each island evolves
its own population of packings. Crossover copies one parent, injects whole well-filled bins of the other, removes every bin
that holds a duplicate of an injected piece, and puts the displaced pieces back by best fit, longest first. After an epoch
the islands' elite bins (as sorted lengths, counted over all islands; the ``ELITE`` most common full ones) migrate: the
next epoch starts from them in every island. The pieces of bins that are not full after the epochs meet in fewer, new
islands, level by level, until one island holds them all, so what a cut into islands costs doesn't add up.

What reaches the driver is the piece count and ELITE elite bins, whatever the input's size.

Defined results: a null or empty text is the end mark alone, a piece of length 1; repeated rows and repeated keys are packed
as often as they occur; a null key stays null; extra columns are ignored, whatever their names; an empty table gives no
pieces. Only texts of more than the capacity are cut; the first piece takes what the others leave.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.runtime import persist_table

CAPACITY = 1024
#: Pieces in an island, about; generations in an epoch; packings in a population; elite bins that migrate.
ISLAND, GENERATIONS, POPULATION, ELITE = 6000, 120, 24, 512


def best_fit(order: np.ndarray, lengths: np.ndarray, bins: np.ndarray, room: list[tuple[int, int]], next_bin: int, capacity: int) -> int:
    """Puts pieces, in the order given, into the fullest bin that takes them; ``room`` holds (free, bin), sorted. Returns
    the next unused bin number."""
    sizes = lengths[order].tolist()
    for item, size in zip(order.tolist(), sizes, strict=True):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, next_bin
            next_bin += 1
        bins[item] = b
        if free > size:
            insort(room, (free - size, b))
    return next_bin


def _descending(items: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return items[np.argsort(-lengths[items], kind="stable")]


def _room(bins: np.ndarray, lengths: np.ndarray, n: int, capacity: int) -> list[tuple[int, int]]:
    fill = np.bincount(bins[bins >= 0], weights=lengths[bins >= 0], minlength=n).astype(int)
    used = np.flatnonzero((fill > 0) & (fill < capacity))
    return sorted(zip((capacity - fill[used]).tolist(), used.tolist(), strict=True))


def _renumber(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then uneven fill, which leaves room in few bins."""
    fill = np.bincount(bins, weights=lengths)
    return -len(fill), float(np.square(fill / capacity).sum())


def crossover(first: np.ndarray, second: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``first`` with whole well-filled bins of ``second``."""
    fill = np.bincount(second, weights=lengths)
    good = np.flatnonzero(fill >= capacity)
    if not len(good):
        good = np.flatnonzero(fill >= np.quantile(fill, 0.9))
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[rng.permutation(good)[: max(1, len(good) // 4)]] = True
    injected = chosen[second]
    child = first.copy()
    n = int(first.max()) + 1
    # bins with a duplicate of an injected piece go, and the worst-filled bins with them
    gone = np.zeros(n, dtype=bool)
    gone[first[injected]] = True
    own = np.bincount(first, weights=lengths)
    gone[np.argsort(own, kind="stable")[: max(2, n // 50)]] = True
    displaced = np.flatnonzero(gone[first] & ~injected)
    child[displaced] = -1
    child[injected] = n + second[injected]
    top = n + len(fill)
    best_fit(_descending(displaced, lengths), lengths, child, _room(child, lengths, top, capacity), top, capacity)
    return _renumber(child)


def inject_migrants(lengths: np.ndarray, elite: list[tuple[int, ...]], capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A packing that starts from elite bins as far as this island has pieces for them; best fit does the rest."""
    by_length: dict[int, list[int]] = {}
    for item in rng.permutation(len(lengths)).tolist():
        by_length.setdefault(int(lengths[item]), []).append(item)
    bins = np.full(len(lengths), -1, dtype=np.int64)
    n = 0
    for pattern in elite:
        need = Counter(pattern)
        while all(len(by_length.get(size, ())) >= k for size, k in need.items()):
            for size, k in need.items():
                for _ in range(k):
                    bins[by_length[size].pop()] = n
            n += 1
    rest = np.flatnonzero(bins < 0)
    best_fit(_descending(rest, lengths), lengths, bins, _room(bins, lengths, n, capacity), n, capacity)
    return _renumber(bins)


def evolve(
    lengths: np.ndarray, elite: list[tuple[int, ...]], seed: int, capacity: int = CAPACITY, start: np.ndarray | None = None
) -> np.ndarray:
    """A bin number per piece: the fittest packing after an epoch. ``elite``: bins that migrate in; ``start``: a packing
    to go on from."""
    rng = np.random.default_rng(seed)
    if not len(lengths):
        return np.zeros(0, dtype=np.int64)
    lower = -(-int(lengths.sum()) // capacity)
    everyone = np.arange(len(lengths))
    people = []
    for k in range(POPULATION):
        if k == 0 and start is not None:
            people.append(start)
            continue
        if k == 1 and elite:
            people.append(inject_migrants(lengths, elite, capacity, rng))
            continue
        # longest first; all but the first packing shuffle neighbours in that order
        key = -lengths + (rng.random(len(lengths)) * 8 * k if k else 0)
        bins = np.full(len(lengths), -1, dtype=np.int64)
        best_fit(everyone[np.argsort(key, kind="stable")], lengths, bins, [], 0, capacity)
        people.append(_renumber(bins))
    scored = sorted(((fitness(p, lengths, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2], reverse=True)
    born = POPULATION
    for _ in range(GENERATIONS):
        if -scored[0][0][0] <= lower:
            break
        a, b = rng.choice(POPULATION, 2, replace=False)
        child = crossover(scored[min(a, b)][2], scored[max(a, b)][2], lengths, capacity, rng)
        scored.append((fitness(child, lengths, capacity), -born, child))
        born += 1
        scored = sorted(scored, key=lambda x: x[:2], reverse=True)[:POPULATION]
    return scored[0][2]


def settled(bins: np.ndarray, lengths: np.ndarray, capacity: int, last: bool) -> np.ndarray:
    """Whether each piece stays where it is: pieces of full bins do; in the last island all. Else the best-filled other bins
    stay too, until at most half of the pieces are left, so that each level has at most half of the last one's pieces."""
    if last:
        return np.ones(len(bins), dtype=bool)
    fill = np.bincount(bins, weights=lengths)
    stays = fill >= capacity
    left = len(bins) - int(stays[bins].sum())
    held = np.bincount(bins)
    for b in np.argsort(-fill, kind="stable"):
        if left <= len(bins) // 2:
            break
        if not stays[b]:
            stays[b] = True
            left -= int(held[b])
    return stays[bins]


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    """A function from a text to the ids of a tokenizers file, without the special tokens that its template would add.

    The vocabulary is loaded into tiktoken: both merge the neighbours of the lowest rank first, and tests hold the two against
    each other. The file's added tokens are found in texts, as the tokenizers library finds them. A file with added tokens
    that take in spaces or need word bounds, or that are searched in normalised text, is left to that library.
    """
    import tiktoken

    with open(path, encoding="utf-8") as source:
        stated = json.load(source)
    added = stated.get("added_tokens", [])
    if any(token.get(flag) for token in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    # the byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the other bytes follow from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    bytes_of = {chr(b): b for b in printable}
    bytes_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {token["content"]: token["id"] for token in added}
    ordinary = {t: i for t, i in stated["model"]["vocab"].items() if t not in special and all(c in bytes_of for c in t)}
    ranks = {bytes(map(bytes_of.__getitem__, token)): i for token, i in ordinary.items()}
    encoding = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return partial(encoding.encode, allowed_special="all")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(k, capacity) for k in range(head, n, capacity)]


def token_pieces(
    docs: DataFrame, key: str, text: str, path: str, pattern: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Pieces of every text's ids, the end id last: uid, key, piece, start, length, ids_crc32, and ids if asked for."""
    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                rows: list[int] = []
                out: list[tuple] = []
                for at, x in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(x or ""), end_id], dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        rows.append(at)
                        out.append((k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32)))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
                columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch([part.column(0).take(pa.array(rows)), *columns], names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    pieces = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return persist_table(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def _epoch(loose: DataFrame, elite: list[tuple[int, ...]], capacity: int, last: bool) -> DataFrame:
    """Each island's packing after one more epoch: uid, length, island, bin, offset, stays."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("uid", kind="stable").reset_index(drop=True)
        lengths = own["length"].to_numpy(dtype=np.int64)
        start = own["bin"].to_numpy()
        bins = evolve(lengths, elite, int(own["island"].iloc[0]), capacity, None if start[0] < 0 else start)
        offset = pd.Series(lengths).groupby(bins).cumsum() - lengths
        return own.assign(bin=bins, offset=offset, stays=settled(bins, lengths, capacity, last))

    return loose.groupBy("island").applyInPandas(run, "uid long, length long, island long, bin long, offset long, stays boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, island: int = ISLAND) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length <= capacity)."""
    whole = pieces.where(F.col("length") == capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = pieces.where(F.col("length") < capacity).select("uid", "length")
    done = [whole]
    for level in range(64):
        count = loose.count()
        islands = max(1, -(-count // island))
        dealt = loose.select(
            "uid", "length", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(islands)).alias("island"), F.lit(-1).cast("long").alias("bin")
        )
        packed = persist_table(_epoch(dealt, [], capacity, islands == 1), "packed")
        if islands > 1:
            full = packed.groupBy("island", "bin").agg(
                F.sum("length").alias("fill"), F.sort_array(F.collect_list("length"), asc=False).alias("pattern")
            )
            common = full.where(F.col("fill") == capacity).groupBy("pattern").agg(F.count("*").alias("n"))
            # the longest lengths first among equally common ones; ELITE rows
            elite = [tuple(r["pattern"]) for r in common.orderBy(F.desc("n"), F.desc("pattern")).limit(ELITE).collect()]
            packed = persist_table(
                _epoch(packed.select("uid", "length", "island", "bin"), elite, capacity, False), "packed"
            )
        number = F.lit(level << 56) + F.shiftleft(F.col("island"), 20) + F.col("bin")
        done.append(packed.where("stays").select("uid", number.alias("sequence_id"), "offset"))
        if islands == 1:
            break
        loose = packed.where("not stays").select("uid", "length")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def pack_documents(docs: DataFrame, key: str, text: str, path: str, pattern: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id and offset (and ids)."""
    pieces = token_pieces(docs, key, text, path, pattern, end_id, capacity, keep_ids)
    out = pieces.join(pack(pieces.select("uid", "length"), capacity), "uid").drop("uid")
    return out.withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids, and the bounds of the pieces in them."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts"))
