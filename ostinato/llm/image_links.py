"""Copies among images by local descriptors: corners at several scales, binary tests, geometric consensus of all pairs.

Images are 8-bit grey planes (``height``, ``width``, ``pixels``). Per image: corners of the structure tensor on a pyramid of
scales, the strongest of each cell of a grid so that a crop keeps some; the patch around each is turned by the angle of its
intensity centroid and compared in 256 fixed pairs of points, which gives 256 bits. A pair of images is compared on all descriptors of
both: each descriptor of one is matched with its nearest in the other within a Hamming bound, and a similarity transform (turn, scale,
shift) must explain at least ``MIN_INLIERS`` of the matches and ``MIN_SHARE`` of the descriptors of the image that has fewer. That must
hold whichever of the two is matched with the other: a link doesn't depend on the order of keys.

Every pair of images is compared, there is no table or tie in front, so the work is the square of the number of different images. Images
with the same descriptors are one class and are compared once. Classes are dealt to chunks of about ``CHUNK``; a turn sends one chunk to all tasks,
which compare it with their own classes of this chunk and later ones; nothing is shuffled. Of pairs inside the chunk each image takes
half, so that none is worked on twice. In a task distances are counts of differing bits, 64 at a time, and an upper bound on what a
transform can explain, worked out for a block of images at once, leaves few pairs to the transform itself.

Defined results: an image without pixels, or one whose pixels don't fit its size, has no descriptors and is its own group;
rows of one key are one image (that of the smallest digest of descriptors, where they differ); null keys link with nothing; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.components import connected_components
from ostinato.llm.spread import salted_join
from ostinato.runtime import partitions, persist_table

SCALES = (1.0, 0.75, 0.5)
CELL, PATCH, BITS = 12, 8, 256
MAX_BITS, MIN_INLIERS, MIN_SHARE, REACH = 48, 7, 0.3, 4.0
#: Classes that a turn sends to all tasks, about, and turns at least; descriptors of a block of them, and numbers that a step of the bound holds.
CHUNK, LEAST_BLOCKS, BLOCK, STEP = 4096, 4, 8192, 1 << 19
_TESTS = np.random.default_rng(7).normal(0, PATCH / 2.5, (BITS, 4)).clip(-PATCH, PATCH)


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear resize."""
    if scale == 1.0:
        return image
    h, w = (max(1, int(round(x * scale))) for x in image.shape)
    y = (np.arange(h) + 0.5) / scale - 0.5
    x = (np.arange(w) + 0.5) / scale - 0.5
    return bilinear(image, *np.meshgrid(y, x, indexing="ij"))


def bilinear(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    y, x = y.clip(0, image.shape[0] - 1.001), x.clip(0, image.shape[1] - 1.001)
    i, j = y.astype(int), x.astype(int)
    a, b = y - i, x - j
    i2, j2 = np.minimum(i + 1, image.shape[0] - 1), np.minimum(j + 1, image.shape[1] - 1)
    return (image[i, j] * (1 - b) + image[i, j2] * b) * (1 - a) + (image[i2, j] * (1 - b) + image[i2, j2] * b) * a


def smoothed(image: np.ndarray) -> np.ndarray:
    """A 1-4-6-4-1 blur in both directions."""
    for axis in (0, 1):
        padded = np.pad(image, [(2, 2) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        n = image.shape[axis]
        part = lambda k, p=padded, ax=axis, m=n: p[k : k + m] if ax == 0 else p[:, k : k + m]
        image = (part(0) + part(4) + 4 * (part(1) + part(3)) + 6 * part(2)) / 16
    return image


def corners(image: np.ndarray) -> np.ndarray:
    """(y, x) of the strongest local maximum of corner strength in each cell, far enough from the border for a patch."""
    gy, gx = np.gradient(image)
    a, b, c = smoothed(gy * gy), smoothed(gx * gx), smoothed(gy * gx)
    strength = a * b - c * c - 0.05 * (a + b) ** 2
    edge = PATCH + 2
    strength[:edge] = strength[-edge:] = 0
    strength[:, :edge] = strength[:, -edge:] = 0
    h, w = strength.shape
    found = []
    peak = strength > 1.0
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        moved = np.roll(strength, (dy, dx), (0, 1))
        back = np.roll(strength, (-dy, -dx), (0, 1))
        peak &= (strength >= moved) & (strength >= back)
    ys, xs = np.nonzero(peak)
    cell = (ys // CELL) * (w // CELL + 1) + xs // CELL
    order = np.lexsort((-strength[ys, xs], cell))
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = cell[order][1:] != cell[order][:-1]
    found = order[keep]
    return np.column_stack([ys[found], xs[found]]).reshape(-1, 2)


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (y, x, scale, angle) in the image's own pixels and descriptors (BITS / 8 bytes each)."""
    places, bits = [], []
    span = np.arange(-PATCH, PATCH + 1)
    dy, dx = np.meshgrid(span, span, indexing="ij")
    disc = dy * dy + dx * dx <= PATCH * PATCH
    for scale in SCALES:
        level = smoothed(resized(image, scale))
        if min(level.shape) < 2 * PATCH + 6:
            continue
        at = corners(level)
        if not len(at):
            continue
        patches = level[at[:, 0, None] + dy[disc], at[:, 1, None] + dx[disc]]
        patches = patches - patches.mean(axis=1, keepdims=True)
        angle = np.arctan2((patches * dy[disc]).sum(axis=1), (patches * dx[disc]).sum(axis=1))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        value = lambda y, x, lv=level, p=at, c=cos, s=sin: bilinear(lv, p[:, :1] + s * x + c * y, p[:, 1:] + c * x - s * y)
        less = value(_TESTS[None, :, 0], _TESTS[None, :, 1]) < value(_TESTS[None, :, 2], _TESTS[None, :, 3])
        bits.append(np.packbits(less, axis=1))
        places.append(np.column_stack([at / scale, np.full(len(at), scale), angle]))
    if not bits:
        return np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(places), np.concatenate(bits)


def bits_apart(bits: np.ndarray, bits2: np.ndarray) -> np.ndarray:
    """Hamming distances of all descriptors of two images, by one product of matrices; whole numbers this small are exact."""
    a, b = (np.unpackbits(x, axis=1).astype(np.float32) for x in (bits, bits2))
    return a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * (a @ b.T)


def consensus(places: np.ndarray, bits: np.ndarray, places2: np.ndarray, bits2: np.ndarray, least: float = MIN_INLIERS) -> int:
    """Most matches that one similarity transform explains, whichever image is matched with the other; 0 as soon as fewer than ``least``
    are sure. Matches of one way alone may send many descriptors to few."""
    there = explained(places, bits, places2, bits2, least)
    return min(there, explained(places2, bits2, places, bits, least)) if there >= least else 0


def explained(places: np.ndarray, bits: np.ndarray, places2: np.ndarray, bits2: np.ndarray, least: float) -> int:
    """Most matches of the first image's descriptors that one similarity transform explains; each match proposes one from its scales and
    angles. 0 as soon as fewer than ``least`` are sure."""
    if not len(bits) or not len(bits2):
        return 0
    apart = bits_apart(bits, bits2)
    near = apart.argmin(axis=1)
    good = np.flatnonzero(apart[np.arange(len(bits)), near] <= MAX_BITS)
    if len(good) < least:
        return 0
    a, b = places[good], places2[near[good]]
    # several scales find one corner: places count once per pixel
    spot = (np.rint(a[:, 0] / 3) * 100_003 + np.rint(a[:, 1] / 3)).astype(np.int64)
    if len(set(spot.tolist())) < least:
        return 0
    turn, grow = b[:, 3] - a[:, 3], a[:, 2] / b[:, 2]
    # places as complex numbers y + x i; row k: all places under the transform that match k proposes, less where they were matched
    p, q, by = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1], grow * np.exp(-1j * turn)
    inside = np.abs(by[:, None] * p[None] + (q - by * p)[:, None] - q[None]) <= REACH
    best = inside[inside.sum(axis=1).argmax()]
    return len(np.unique(spot[best]))


_FEATURES = "key long, places binary, bits binary"


def image_features(images: DataFrame, key: str) -> DataFrame:
    """Per image: its places and bits as raw arrays; both are null where there are no descriptors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out: list[tuple] = []
                for own, h, w, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    places, bits = np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
                    if raw is not None and h and w and len(raw) == h * w:
                        places, bits = describe(np.frombuffer(raw, np.uint8).reshape(h, w).astype(np.float64))
                    out.append((own, places.astype("<f4").tobytes() or None, bits.tobytes() or None))
                kinds = (pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["key", "places", "bits"])

    chosen = images.select(F.col(key).cast("long").alias("key"), "height", "width", "pixels")
    return chosen.mapInArrow(run, _FEATURES)


def least_inliers(n: int, m: int) -> float:
    return max(MIN_INLIERS, MIN_SHARE * min(n, m))


def linked(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two images (places, bits) are copies."""
    least = least_inliers(len(one[1]), len(two[1]))
    return consensus(*one, *two, least) >= least


def _arrays(places: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(places, "<f4").reshape(-1, 4).astype(float), np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8)


class _Block:
    """Images whose descriptors are padded to one number, which matches nothing."""

    def __init__(self, images: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.sizes = np.array([len(bits) for _, bits in images])
        n, self.width = len(images), int(self.sizes.max())
        words = np.zeros((self.width, n, BITS // 8), np.uint8)
        self.spot = np.zeros((n, self.width), complex)
        self.frame = np.zeros((n, self.width), complex)
        for k, (places, bits) in enumerate(images):
            words[: len(bits), k] = bits
            self.spot[k, : len(bits)] = places[:, 0] + 1j * places[:, 1]
            self.frame[k, : len(bits)] = np.exp(-1j * places[:, 3]) / places[:, 2]
        # word by word, all images' first descriptors before their second ones
        self.words = np.ascontiguousarray(words.reshape(self.width * n, -1).view(np.uint64).T)
        # a distance and a descriptor's number in one integer; the padding has further distances than there are
        self.shift = max(6, (self.width - 1).bit_length())
        number = np.arange(self.width)[:, None] + (BITS << self.shift) * (np.arange(self.width)[:, None] >= self.sizes)
        self.number = number.astype(np.uint16 if self.shift == 6 else np.uint32)
        # residuals don't depend on the origin
        self.spot -= (self.spot.real.max() + 1j * self.spot.imag.max()) / 2
        self.reach = np.abs(self.spot).max()

    def matches(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row of ``bits`` and image: the nearest descriptor, the first of equal ones, and whether it is near enough; if not, any."""
        words, size = np.ascontiguousarray(bits).view(np.uint64), self.words.shape[1]
        step = max(1, STEP // size)
        differ, count, apart = (np.empty((min(step, len(bits)), size), t) for t in (np.uint64, np.uint8, np.uint8))
        key = np.empty(apart.shape, self.number.dtype)
        found = np.empty((len(bits), len(self.sizes)), key.dtype)
        for low in range(0, len(bits), step):
            own = words[low : low + step]
            d, c, a, k = (x[: len(own)] for x in (differ, count, apart, key))
            for w, other in enumerate(self.words):
                np.bitwise_xor(own[:, w, None], other, out=d)
                np.bitwise_count(d, out=c if w else a)
                if w:
                    # all bits together would be one more than there is room for
                    np.add(np.minimum(a, 255 - 64, out=a), c, out=a)
            np.left_shift(a, self.shift, out=k, dtype=k.dtype, casting="unsafe")
            k = k.reshape(len(own), self.width, -1)
            found[low : low + step] = np.add(k, self.number, out=k).min(axis=1)
        return (found & ((1 << self.shift) - 1)).astype(np.int64), found >> self.shift <= MAX_BITS

    def may_link(self, places: np.ndarray, at: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Images of this block that one image may link with: with all others ``explained`` is below what is asked.

        Counts what each match's transform explains, places counted as often as they are found: never fewer than ``explained`` returns. Squared
        distances of all matches under all transforms are one product of matrices per pair of images; they have room for rounding.
        """
        n = len(places)
        least = np.maximum(MIN_INLIERS, MIN_SHARE * np.minimum(n, self.sizes))
        maybe = np.flatnonzero(good.sum(axis=0) >= least)
        if n * n > STEP:
            return maybe
        p = places[:, 0] + 1j * places[:, 1]
        p -= (p.real.max() + 1j * p.imag.max()) / 2
        turn = places[:, 2] * np.exp(1j * places[:, 3])
        # no number that is squared below is larger; what is added up is at most six squares of it, each with some twenty roundings
        most = np.abs(p).max() * np.abs(turn).max() * np.abs(self.frame).max() + self.reach + 1
        real, rounded = (np.float32, 2e-5) if most < 300 else (np.float64, 1e-12)
        room = REACH * REACH + 1e-3 + rounded * most * most
        p, turn, spot, frame = (x.astype(np.result_type(real, np.complex64)) for x in (p, turn, self.spot, self.frame))
        square = lambda z: z.real**2 + z.imag**2
        out = []
        for low in range(0, len(maybe), max(1, STEP // (n * n))):
            own = maybe[low : low + max(1, STEP // (n * n))]
            place, far = at[:, own].T, np.where(good[:, own].T, real(0), real(1e30))
            q, by = spot[own[:, None], place], turn * frame[own[:, None], place]
            c = q - by * p
            u, pq = 2 * by * c.conj(), p * q.conj()
            by2, c2 = -2 * by, -2 * c
            # |by p + c - q|^2, a column for each transform (by, c), a row for each match (p, q)
            row = np.empty((len(own), 9, n), real)
            column = np.empty((len(own), 9, n), real)
            for k, (x, y) in enumerate(
                (
                    (square(p), square(by)), (1.0, square(c) + far), (square(q) + far, 1.0), (p.real, u.real), (-p.imag, u.imag),
                    (pq.real, by2.real), (-pq.imag, by2.imag), (q.real, c2.real), (q.imag, c2.imag),
                )
            ):
                row[:, k], column[:, k] = x, y
            inside = row.transpose(0, 2, 1) @ column <= room
            explained = inside.sum(axis=1, dtype=np.uint8 if n < 256 else np.int32).max(axis=1)
            out.append(own[explained >= least[own]])
        return np.concatenate([np.zeros(0, np.int64), *out])


def _takes(rank: int, n: int, low: int, high: int) -> np.ndarray:
    """Which of the ranks from ``low`` on, below ``high``, this rank of n compares itself with: half of all, and each pair is one rank's only."""
    others = np.arange(low, high)
    ahead = (others - rank) % n
    return (ahead > 0) & ((2 * ahead < n) | ((2 * ahead == n) & (rank < others)))


def _compared(classes: DataFrame, chunk: int) -> DataFrame:
    """(a, b): linked classes, one of them of this chunk and the other of it or a later one."""
    spark = classes.sparkSession
    rows = sorted(classes.where(F.col("chunk") == chunk).select("key", "places", "bits").collect(), key=lambda r: (len(r["bits"]), r["key"]))
    sent = spark.sparkContext.broadcast([(r["key"], bytes(r["places"]), bytes(r["bits"])) for r in rows])

    def blocks() -> Iterator[tuple[list[int], list[tuple], _Block]]:
        low = 0
        while low < len(sent.value):
            high = low + 1
            # sorted by size, so the last one is the widest
            while high < len(sent.value) and (high + 1 - low) * len(sent.value[high][2]) * 8 <= BLOCK * BITS:
                high += 1
            images = [_arrays(p, b) for _, p, b in sent.value[low:high]]
            yield [k for k, _, _ in sent.value[low:high]], images, _Block(images)
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {k: at for at, (k, _, _) in enumerate(sent.value)}
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                keys, chunks, places, bits = (c.to_pylist() for c in batch.slice(start, 128).columns)
                own = [_arrays(p, b) for p, b in zip(places, bits, strict=True)]
                found: list[tuple[int, int]] = []
                low = 0
                for others, images, block in blocks():
                    for k, part, one in zip(keys, chunks, own, strict=True):
                        asked = _takes(rank[k], len(rank), low, low + len(others)) if part == chunk else True
                        if not np.any(asked):
                            continue
                        at, good = block.matches(one[1])
                        good &= asked
                        found += [(k, others[x]) for x in block.may_link(one[0], at, good).tolist() if linked(one, images[x])]
                    low += len(others)
                yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    links = persist_table(classes.where(F.col("chunk") >= chunk).select("key", "chunk", "places", "bits").mapInArrow(run, "a long, b long"), "image-links")
    sent.destroy()
    return links


def image_links(classes: DataFrame, n: int) -> DataFrame:
    """(a, b): all pairs of linked classes (key, places, bits), each once; n: their number."""
    spark = classes.sparkSession
    chunks = max(LEAST_BLOCKS, -(-n // CHUNK))
    # tasks of equal work: chunks and partitions are dealt by hashes of their own
    dealt = classes.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))
    parts = max(3 * partitions(spark), -(-n // 512))
    dealt = persist_table(dealt.repartition(parts, F.xxhash64("key", F.lit(1))), "image-chunks")
    links = _compared(dealt, 0)
    for chunk in range(1, chunks):
        links = links.unionAll(_compared(dealt, chunk))
    return links


def _self_linked(classes: DataFrame) -> DataFrame:
    """(cls, alike): whether images of exactly these descriptors are copies of each other; few descriptors aren't enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, bits = (c.to_pylist() for c in batch.columns)
            alike = [linked(one, one) for one in map(_arrays, places, bits)]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(alike, pa.bool_())], names=["cls", "alike"])

    return classes.where("size > 1").select("key", "places", "bits").mapInArrow(run, "cls long, alike boolean")


def image_groups(images: DataFrame, key: str) -> DataFrame:
    """Per image: key, n_descriptors, n_links (all linked images) and component_id (the smallest key reachable by links)."""
    digest = F.sha2(F.concat("places", "bits"), 256)
    every = persist_table(image_features(images, key).withColumn("digest", digest), "image-features")
    features = every.where("key is not null and bits is not null")
    # rows of one key are one image
    members = persist_table(features.groupBy("key").agg(F.min("digest").alias("digest")), "image-members")
    sizes = members.groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("size"))
    held = features.join(sizes.hint("merge"), ["digest", "key"]).dropDuplicates(["key"])
    classes = persist_table(held.select("digest", "key", "size", "places", "bits"), "image-classes")
    links = persist_table(image_links(classes, classes.count()), "image-links")
    size = classes.select("key", "size")
    ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(size.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("size").alias("others"))
    component = connected_components(links, "a", "b").withColumnRenamed("node", "cls")
    of_class = classes.select("digest", F.col("key").alias("cls"), "size")
    of_class = of_class.join(component, "cls", "left").join(degree, "cls", "left").join(_self_linked(classes), "cls", "left")
    copies = F.when(F.col("alike"), F.col("size") - 1).otherwise(0)
    told = of_class.select(
        "digest",
        "size",
        (F.coalesce("others", F.lit(0)) + copies).alias("n_links"),
        # copies that are too small to be told to be copies are groups of their own
        F.coalesce("component", F.when(F.col("alike"), F.col("cls"))).alias("component"),
    )
    told = persist_table(told, "image-classes")
    # one image may be that of a third of all rows
    counts = told.select("digest", F.col("size").alias("n"))
    named = salted_join(members, told.drop("size"), ["digest"], ["key"], counts).drop("digest")
    found = every.select("key", (F.length("bits") / (BITS // 8)).cast("int").alias("n_descriptors"))
    return found.join(named, "key", "left").select(
        F.col("key").alias(key),
        F.coalesce("n_descriptors", F.lit(0)).alias("n_descriptors"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "key").alias("component_id"),
    )


def rendered_media(vectors: DataFrame, key: str, column: str, side: int = 72) -> DataFrame:
    """A media column for a table that has none: a grey image per vector, and for every fifth key an edited copy of the image before.

    The image is drawn from the vector alone: blobs whose places, sizes and shades its components set. A copy is, by the key, a crop, a
    darker one, a turned one, or a smaller one, with a little noise. It is what tests and the query take as known copies: key 5k + 1 is made from
    the vector of 5k.
    """
    source = F.col(key) - F.when(F.pmod(F.col(key), F.lit(5)) == 1, 1).otherwise(0)
    own = vectors.select(F.col(key).alias("_k"), source.alias("_s"))
    drawn = own.join(vectors.select(F.col(key).alias("_s"), F.col(column).cast("array<double>").alias("v")), "_s", "left").select("_k", "_s", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                out = []
                for k, s, v in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if k is None or not v or any(x is None or not np.isfinite(x) for x in v):
                        out.append((k, None, None, None))
                        continue
                    image = draw(np.array(v), side)
                    if k != s:
                        image = edited(image, k)
                    out.append((k, *image.shape, image.tobytes()))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.record_batch(
                    [pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], names=["key", "height", "width", "pixels"]
                )

    made = drawn.mapInArrow(run, "key long, height int, width int, pixels binary")
    return made.withColumnRenamed("key", key)


def draw(vector: np.ndarray, side: int) -> np.ndarray:
    """Rectangles whose places, sizes and shades come from the vector's digits."""
    seed = np.abs(np.rint(vector * 1e4)).astype(np.int64)
    rng = np.random.default_rng(seed.tolist())
    image = np.full((side, side), 128.0)
    for _ in range(26):
        y, x = rng.integers(0, side, 2)
        h, w = rng.integers(6, 22, 2)
        image[y : y + h, x : x + w] = rng.integers(0, 256)
    return smoothed(image).round().astype(np.uint8)


def edited(image: np.ndarray, key: int) -> np.ndarray:
    rng = np.random.default_rng(key)
    out = image.astype(np.float64)
    kind = key // 5 % 4
    if kind == 0:
        cut = int(0.2 * len(out))
        out = out[cut:, : len(out) - cut]
    elif kind == 1:
        out = out * 0.8 + 10
    elif kind == 2:
        out = np.rot90(out)
    else:
        out = resized(out, 0.75)
    return (out + rng.normal(0, 2, out.shape)).clip(0, 255).round().astype(np.uint8)
