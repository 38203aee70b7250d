"""Deduplication of passages: texts that share a rare run of lines are aligned by patience diff, and common blocks leave the later one.

A line ends at a line break, after a sentence mark, before a capitalised word and, in a stretch of more than ``LONG_LINE`` words
without any of these, before words whose hash says so. Each of these cuts depends on the words beside it, so a passage has the
same lines wherever it stands, but for its first and last one. Lines are compared by hashes of their bytes.

Candidates. Single lines are often common and prove nothing, so what ties texts is the 64-bit hash of a run of lines: from each line
on, the fewest lines that hold ``MIN_WORDS`` words together, however short they are. Of each ``BESIDE`` such runs that start one after
the other the one with the smallest hash is kept (winnowing, Schleimer et al., 2003), so two texts that share a block in which BESIDE
runs start always keep one of them both; a text with fewer runs keeps one. How many texts hold each kept run is counted; one that a
single text holds ties nothing, and each other one ties its later texts to its first holder. So ties are linear in the lines however
common a run is: its other holders are never paired with each other. Between two texts the rarest shared run speaks for all of them.

Alignment. A pair's whole line lists are aligned in one order: the longest increasing chain of lines that both hold once, grown over equal
neighbours; between anchors the same again; a stretch without lines that both hold once goes on with its longest common run. A
block is a run of aligned lines, side by side in both texts, of MIN_WORDS words or more. One alignment can't show a passage that
has moved or that the later text holds twice; the lines that it left over are searched for further runs of MIN_WORDS words that stand in
the earlier text in the same order. Lines in another order, or gathered from several texts, are no block. A text loses the blocks that it
shares with each of its partners; blocks of two partners never make one together. The first holder of a run always keeps it.

Earlier and later are by key. Defined results: a null or empty text stays as it is; rows of equal key are one document: they are never
compared with each other, and rows of equal key and text get the same result; a row with a null key stays as it is; a text of fewer
than MIN_WORDS words neither loses nor gives anything; a long text is one row, its lines take about 20 bytes each; other columns
pass through whatever their names, except that the added ones replace columns of their names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.key_filter import marked, without
from ostinato.llm.spread import salted_join
from ostinato.llm.text_arrays import byte_table, mix, powers, slices, span_hashes, words
from ostinato.runtime import persist_table

MIN_WORDS, BESIDE = 24, 4
#: A stretch of more words without a cut is cut before words whose hash is a multiple of CUT.
LONG_LINE, CUT = 8, 4


def _capital_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each word starts with a capital that a small letter (or the word's end) follows; Latin letters."""
    at = lambda k: np.where(starts + k < len(data), data[np.minimum(starts + k, len(data) - 1)], 32)
    one, two, three, four = at(0), at(1), at(2), at(3)
    small = lambda a, b: ((a >= 97) & (a <= 122)) | ((a == 0xC3) & (b >= 0x9F)) | (a <= 32)
    ascii_capital = (one >= 65) & (one <= 90) & small(two, three)
    latin_capital = (one == 0xC3) & (two >= 0x80) & (two <= 0x9E) & small(three, four)
    return ascii_capital | latin_capital


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: hash, words and end (byte offset in its text, where the next line begins) of each line, and each text's
    first line."""
    starts, ends, of_row = words(data, offsets)
    n_rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(n_rows + 1, np.int64)
    rows = np.searchsorted(of_row, np.arange(len(starts)), side="right") - 1
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    cuts = np.ones(len(starts), dtype=bool)
    cuts[1:] = (rows[1:] != rows[:-1]) | (breaks[starts[1:]] != breaks[starts[:-1]])
    cuts |= _capital_starts(data, starts)
    cuts[1:] |= np.isin(data[ends - 1][:-1], (33, 46, 63))
    table = byte_table(lower=False)
    first = np.flatnonzero(cuts)
    long = np.repeat(np.diff(np.append(first, len(starts))) > LONG_LINE, np.diff(np.append(first, len(starts))))
    inside = np.flatnonzero(long)
    if len(inside):
        cuts[inside] |= span_hashes(data, starts[inside], ends[inside], table) % np.uint64(CUT) == 0
        first = np.flatnonzero(cuts)
    past = np.append(first[1:], len(starts))
    hashes = span_hashes(data, starts[first], ends[past - 1], table)
    line_row = rows[first]
    bounds = np.searchsorted(line_row, np.arange(n_rows + 1), side="left")
    # a line ends where the next one of its text begins; the last one with the text
    end = np.where(past < len(starts), starts[np.minimum(past, len(starts) - 1)], offsets[-1])
    end = np.minimum(end, offsets[line_row + 1]) - offsets[line_row]
    return hashes, (past - first).astype(np.int32), end.astype(np.int32), bounds


class Lines:
    """Line hashes of one or more texts with sums that give a hash of any run of them."""

    def __init__(self, hashes: np.ndarray, count: np.ndarray):
        self.hashes = hashes.astype(np.uint64)
        self.total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        up, self.down = powers.get(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(self.hashes) * up[: len(hashes)], out=self.sums[1:])

    def __len__(self) -> int:
        return len(self.hashes)

    def run(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of the n lines from start on."""
        return mix((self.sums[start + n] - self.sums[start]) * self.down[start] + np.asarray(n).astype(np.uint64))

    def passages(self, past: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first line, lines, hash) of the shortest run of MIN_WORDS words or more from each line on, if it ends by ``past``."""
        start = np.arange(len(self))
        end = np.searchsorted(self.total, self.total[:-1] + MIN_WORDS, side="left")
        whole = end <= (len(self) if past is None else past)
        start, n = start[whole], (end - start)[whole]
        return start, n, self.run(start, n)


def kept_runs(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the smallest of each BESIDE runs in a row of one text; ``bounds`` are the texts' first runs."""
    n = np.diff(bounds)
    last = np.repeat(bounds[1:], n)
    place = np.arange(len(runs))
    groups = place[(place + BESIDE <= last) | (place == np.repeat(bounds[:-1], n))]
    if not len(groups):
        return groups
    own = groups[:, None] + np.arange(BESIDE)
    inside = own < last[groups][:, None]
    value = np.where(inside, runs[np.minimum(own, len(runs) - 1)], np.uint64((1 << 64) - 1))
    return np.unique(groups + value.argmin(axis=1))


def line_lists(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document of MIN_WORDS words or more: key, th (hash of the text), its lines' hashes (32 bits, enough within a pair), words
    and bytes, the hashes of its kept runs, and its bytes and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2)):
                hashes, count, ends, bounds = lines(data, offsets)
                last = np.repeat(bounds[1:], np.diff(bounds))
                start, _, passages = Lines(hashes, count).passages(last)
                of_text = np.searchsorted(start, bounds)
                kept = kept_runs(passages, of_text)
                before = np.concatenate([[0], ends[:-1]])
                before[bounds[:-1][np.diff(bounds) > 0]] = 0
                at = pa.array(bounds.astype(np.int32))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, end - first),
                        batch.column(1).slice(first, end - first),
                        pa.ListArray.from_arrays(at, pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32))),
                        pa.ListArray.from_arrays(at, pa.array(count)),
                        pa.ListArray.from_arrays(at, pa.array((ends - before).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, of_text).astype(np.int32)), pa.array(passages[kept].view(np.int64))),
                        pa.array(np.diff(offsets)),
                        pa.array(np.diff(np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[bounds])),
                    ],
                    names=["key", "th", "hashes", "words", "sizes", "passages", "size", "n_words"],
                )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    rows = rows.where("key is not null and text is not null")
    made = rows.mapInArrow(run, "key long, th long, hashes array<int>, words array<int>, sizes array<int>, passages array<long>, size long, n_words long")
    return made.where(F.size("passages") > 0)


class Passages:
    """A text's runs of MIN_WORDS words: (first line, lines, hash) in the order of the text, and their places sorted by hash."""

    def __init__(self, text: Lines):
        self.start, self.n, self.runs = text.passages()
        self.end = self.start + self.n
        self.order = np.argsort(self.runs, kind="stable")
        self.sorted = self.runs[self.order]

    def inside(self, low: int, high: int) -> np.ndarray:
        """Places of the runs in the lines from low to high."""
        first, past = np.searchsorted(self.start, [low, high])
        return first + np.flatnonzero(self.end[first:past] <= high)


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing run."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        p = bisect_left(tails, v)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(v)
            at.append(k)
        else:
            tails[p], at[p] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def _anchors(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(place in b, place in a) of the values that both hold once, in the order of b."""
    once = []
    for x in (a, b):
        value, at, n = np.unique(x, return_index=True, return_counts=True)
        once.append((value[n == 1], at[n == 1]))
    _, p, q = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    return sorted(zip(once[1][1][q].tolist(), once[0][1][p].tolist(), strict=True))


def longest_run(a: Lines, alo: int, ahi: int, b: Lines, blo: int, bhi: int) -> tuple[int, int, int]:
    """(place in a, place in b, lines) of the first of the longest runs that both stretches hold; 0 lines if there is none."""

    def shared(n: int) -> tuple[int, int] | None:
        starts_a, starts_b = np.arange(alo, ahi - n + 1), np.arange(blo, bhi - n + 1)
        runs_a = a.run(starts_a, np.full(len(starts_a), n))
        found = np.flatnonzero(np.isin(b.run(starts_b, np.full(len(starts_b), n)), runs_a))
        if not len(found):
            return None
        j = int(starts_b[found[0]])
        return int(starts_a[np.flatnonzero(runs_a == b.run(np.array([j]), np.array([n]))[0])[0]]), j

    low, best, high = 0, (alo, blo), min(ahi - alo, bhi - blo)
    while low < high:  # a run of n lines holds one of n - 1
        n = (low + high + 1) // 2
        at = shared(n)
        if at is None:
            high = n - 1
        else:
            low, best = n, at
    return *best, low


def patience(a: Lines, b: Lines, of_a: Passages, of_b: Passages) -> list[tuple[int, int, int]]:
    """Aligned runs (place in a, place in b, lines), in the order of both. Stretches of fewer than MIN_WORDS words, in which no
    block has room, are left out."""
    left, right = a.hashes.tolist(), b.hashes.tolist()
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if min(a.total[ahi] - a.total[alo], b.total[bhi] - b.total[blo]) < MIN_WORDS:
            continue
        common = _anchors(a.hashes[alo:ahi], b.hashes[blo:bhi])
        anchors = [(blo + common[k][0], alo + common[k][1]) for k in _increasing([x for _, x in common])]
        if not anchors:
            if not np.isin(of_b.runs[of_b.inside(blo, bhi)], of_a.runs[of_a.inside(alo, ahi)]).any():
                continue
            i, j, n = longest_run(a, alo, ahi, b, blo, bhi)
            if b.total[j + n] - b.total[j] >= MIN_WORDS:
                out.append((i, j, n))
                todo += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
            continue
        i_from, j_from = alo, blo
        for j, i in anchors:
            if i < i_from or j < j_from:
                continue  # an earlier anchor has grown over it
            before, after = 0, 1
            while i - before > i_from and j - before > j_from and left[i - before - 1] == right[j - before - 1]:
                before += 1
            while i + after < ahi and j + after < bhi and left[i + after] == right[j + after]:
                after += 1
            out.append((i - before, j - before, before + after))
            todo.append((i_from, i - before, j_from, j - before))
            i_from, j_from = i + after, j + after
        todo.append((i_from, ahi, j_from, bhi))
    joined: list[tuple[int, int, int]] = []
    for i, j, n in sorted(out):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined


def moved(a: Lines, b: Lines, of_a: Passages, of_b: Passages, low: int, high: int) -> list[tuple[int, int]]:
    """(first, past) of the runs of MIN_WORDS words or more in b's lines from low to high that stand somewhere in a, each as long as it
    can be."""
    own = of_b.inside(low, high)
    start, n, runs = of_b.start[own], of_b.n[own], of_b.runs[own]
    first, past = (np.searchsorted(of_a.sorted, runs, side=side) for side in ("left", "right"))
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(past > first).tolist():
        j = int(start[k])
        if out and j < out[-1][1]:
            continue
        places = of_a.start[of_a.order[first[k] : past[k]]]
        short, long = np.full(len(places), n[k]), np.minimum(len(a) - places, high - j)
        while (short < long).any():
            half = (short + long + 1) // 2
            same = a.run(places, half) == b.run(np.full(len(places), j), half)
            short, long = np.where(same, half, short), np.where(same, long, half - 1)
        out.append((j, j + int(short.max())))
    return out


def common_blocks(a: Lines, b: Lines) -> list[tuple[int, int]]:
    """(first, past) of the blocks of b's lines that an alignment with the earlier text a covers, in order."""
    if len(a) == len(b) and (a.hashes == b.hashes).all():
        return [(0, len(b))] if b.total[-1] >= MIN_WORDS else []
    of_a, of_b = Passages(a), Passages(b)
    out = [(j, j + n) for _, j, n in patience(a, b, of_a, of_b) if b.total[j + n] - b.total[j] >= MIN_WORDS]
    edges = [0, *[x for block in out for x in block], len(b)]
    for low, high in zip(edges[::2], edges[1::2], strict=True):
        if b.total[high] - b.total[low] >= MIN_WORDS:
            out += moved(a, b, of_a, of_b, low, high)
    return sorted(out)


def copies(lists: DataFrame) -> DataFrame:
    """(uid, key, th, first, size, n_words) of the documents whose whole text an earlier key has, with the first such key."""
    thin = lists.select("uid", "key", "th", "size", "n_words")
    counted = lists.groupBy("th").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n")).where("first <> last")
    counted = persist_table(counted.drop("last"), "equal-texts")
    return persist_table(salted_join(thin, counted.select("th", "first"), ["th"], ["uid"], counted.select("th", "n")).where("key <> first"), "copies")


def ties(lists: DataFrame) -> DataFrame:
    """(uid, first, n): a document, the first holder of a run in it, and how many texts hold the rarest such run."""
    held = lists.select("uid", "key", F.explode(F.array_distinct("passages")).alias("passage"))
    counted = held.groupBy("passage").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
    shared = persist_table(counted.where("first <> last").drop("last"), "shared-passages")
    told = marked(held, ["passage"], shared, ["passage"]).where("_maybe").drop("_maybe")
    met = salted_join(told, shared, ["passage"], ["uid"], shared.select("passage", "n"))
    return met.where("key <> first").groupBy("uid", "first").agg(F.min("n").alias("n"))


def block_spans(lists: DataFrame) -> DataFrame:
    """(key, th, copied_from, deleted_words, spans): the texts that lose blocks, and the spans of bytes that stay.

    Equal texts are one text until the end: only the document of the smallest key is compared with others.
    """
    again = copies(lists)
    own = without(lists, ["uid"], again, ["uid"], lists.select("uid"))
    pairs = persist_table(ties(own).drop("n"), "ties")
    counts = pairs.groupBy("first").agg(F.count("*").alias("n"))
    # only the lists of documents in pairs are shuffled
    tied = marked(own, ["uid"], pairs, ["uid"]).where("_maybe").select("uid", "key", "th", "hashes", "words", "sizes")
    mine = pairs.join(tied.hint("merge"), "uid")
    holders = marked(own, ["key"], counts, ["first"]).where("_maybe")
    earlier = holders.select(F.col("key").alias("first"), F.col("hashes").alias("others"), F.col("words").alias("others_words"))
    # one document may be the first holder for a third of all
    both = salted_join(mine, earlier, ["first"], ["uid"], counts)
    both = both.select("uid", "key", "th", "first", "hashes", "words", "sizes", "others", "others_words")
    block = pa.struct([(c, pa.int64()) for c in ("start", "past", "words_start", "words_past")])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = []
            for row in zip(*(batch.column(k) for k in range(4, 9)), strict=True):
                hashes, count, sizes, others, others_count = (x.values.to_numpy() for x in row)
                a, b = Lines(others, others_count), Lines(hashes, count)
                at = np.concatenate([[0], np.cumsum(sizes)])
                edges = [(x, y) for x, y in common_blocks(a, b)]
                found.append([dict(zip(("start", "past", "words_start", "words_past"), (int(at[x]), int(at[y]), int(b.total[x]), int(b.total[y])), strict=True)) for x, y in edges])
            yield pa.record_batch([*(batch.column(k) for k in range(4)), pa.array(found, pa.list_(block))], names=["uid", "key", "th", "first", "blocks"])

    kind = "array<struct<start:long,past:long,words_start:long,words_past:long>>"
    aligned = both.mapInArrow(align, f"uid long, key long, th long, first long, blocks {kind}").where(F.size("blocks") > 0)
    of_text = aligned.groupBy("uid", "key", "th").agg(
        F.array_sort(F.flatten(F.collect_list("blocks"))).alias("blocks"), F.array_sort(F.collect_set("first")).alias("copied_from")
    )
    ended = of_text.join(lists.select("uid", "size").hint("merge"), "uid")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))
        for batch in batches:
            gone, kept = [], []
            for own, size in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                at = done = words_gone = 0
                left = []
                for x in own:
                    if x["start"] > at:
                        left.append({"start": at, "size": x["start"] - at})
                    words_gone += max(0, x["words_past"] - max(done, x["words_start"]))
                    at, done = max(at, x["past"]), max(done, x["words_past"])
                if size > at:
                    left.append({"start": at, "size": size - at})
                gone.append(words_gone)
                kept.append(left)
            columns = [*(batch.column(k) for k in range(3)), pa.array(gone, pa.int64()), pa.array(kept, span)]
            yield pa.record_batch(columns, names=["key", "th", "copied_from", "deleted_words", "spans"])

    schema = "key long, th long, copied_from array<long>, deleted_words long, spans array<struct<start:int,size:int>>"
    cut = ended.select("key", "th", "copied_from", "blocks", "size").mapInArrow(spans, schema)
    nothing = F.array().cast("array<struct<start:int,size:int>>")
    return cut.unionAll(again.select("key", "th", F.array("first"), F.col("n_words"), nothing))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with passages deleted from ``text``, and deleted_words and copied_from (keys of the earlier documents)."""
    added = ("deleted_words", "copied_from")
    names = [c for c in docs.columns if c not in added]
    lists = persist_table(line_lists(docs, key, text).withColumn("uid", F.monotonically_increasing_id()), "lines")
    cuts = persist_table(block_spans(lists), "line-cuts").dropDuplicates(["key", "th"])
    # columns go by number, so that none can clash with those in use here
    rows = docs.select(*names).toDF(*[f"c{k}" for k in range(len(names))])
    its_key, its_text = (f"c{names.index(c)}" for c in (key, text))
    rows = rows.withColumns({"key": F.col(its_key).cast("long"), "th": F.xxhash64(its_text)})
    # most documents have nothing to lose: they go by without a shuffle of their texts
    told = marked(rows, ["key", "th"], cuts, ["key", "th"])
    none = [F.lit(0).cast("long").alias(added[0]), F.array().cast("array<bigint>").alias(added[1])]
    whole = told.where("not _maybe").select(*rows.columns[:-2], *none)
    raw = F.encode(F.col(its_text), "UTF-8")
    left = F.decode(
        F.aggregate("spans", F.lit(b""), lambda out, s: F.concat(out, F.substring(raw, s["start"] + 1, s["size"]))), "UTF-8"
    )
    changed = told.where("_maybe").join(cuts.hint("merge"), ["key", "th"], "left").withColumns(
        {
            its_text: F.when(F.col("spans").isNull(), F.col(its_text)).otherwise(left),
            added[0]: F.coalesce(added[0], F.lit(0)).cast("long"),
            added[1]: F.coalesce(added[1], F.array().cast("array<bigint>")),
        }
    )
    return whole.unionByName(changed.select(*rows.columns[:-2], *added)).toDF(*names, *added)
