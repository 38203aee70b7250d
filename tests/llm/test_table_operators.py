import hashlib
import json
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from ostinato.llm import chat_windows, components, entries, image_links, shard_balance, vector_links, warc_archive
from ostinato.runtime import shared_path
from tests.oracle import connect, rows_of, rows_of_sql

COUNTER = chat_windows.token_counter(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_agrees_with_its_sql(spark, data, name):
    assert rows_of(entries.queries()[name](spark, data)) == rows_of_sql(connect(data), entries.oracle_sql()[name])


# --- components


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 200)] + [(300, k) for k in range(301, 340)] + [(400, 400)] + [(500, 501), (501, 500), (501, 502)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    want = {k: 0 for k in range(201)} | {k: 300 for k in range(300, 340)} | {k: 500 for k in (500, 501, 502)}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


# --- vectors


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = []
    for b in base:
        rows += [(b + rng.standard_normal(16) * s).tolist() for s in (0, 0, 0.02, 0.05, 0.08, 0.3)]
    rows += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e200] * 16, [1e-200] * 16]
    table = spark.createDataFrame([(k, v, 1, "x") for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, rep string")
    x = np.array([v if v is not None and None not in v and np.isfinite(v).all() and any(v) else [0.0] * 16 for v in rows])
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = vector_links.vector_links(table, "vec_id", "embedding", 0.9, miss=1e-5).toPandas().sort_values("vec_id")
    assert got["n_links"].tolist() == near.sum(axis=1).tolist()
    comp = list(range(len(rows)))
    for _ in range(len(rows)):
        comp = [min([comp[i], *[comp[j] for j in np.flatnonzero(near[i])]]) for i in range(len(rows))]
    assert got["component_id"].tolist() == comp and (got["kept"] == (got["vec_id"] == got["component_id"])).all()
    assert vector_links.vector_links(table.where("false"), "vec_id", "embedding").count() == 0


def pairs_at(rng, cosine, n, dim):
    """n pairs of unit vectors with this cosine."""
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def test_recall_near_the_threshold_with_production_parameters(spark):
    rng = np.random.default_rng(8)
    cosines = np.linspace(0.9001, 0.92, 1500)[:, None]
    a, b = pairs_at(rng, cosines, 1500, 48)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))]
    got = vector_links.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 0.9).toPandas()
    linked = got.sort_values("vec_id")["n_links"].to_numpy()
    assert (linked[:1500] == linked[1500:]).all() and linked.max() == 1 and linked[:1500].mean() >= 0.95


def test_share_of_pairs_compared_falls_with_the_number_of_vectors():
    rng = np.random.default_rng(9)
    shares, costs = [], []
    for n in (500, 5000, 50_000):
        tables, per_table = vector_links.table_plan(n, 0.9)
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.standard_normal((6000, 48)), rng.standard_normal((6000, 48))))
        one, two = (vector_links.bucket_keys(x, tables, per_table, vector_links.WIDTH, vector_links.SEED) for x in (a, b))
        shares.append((one == two).sum() / 6000)  # comparisons for a pair
        costs.append(n * n * shares[-1])
    assert shares[0] > 2 * shares[1] > 4 * shares[2]
    assert costs[1] < 40 * costs[0] and costs[2] < 40 * costs[1]  # 100 if it were quadratic


def test_vectors_of_several_lengths_and_null_keys(spark):
    rows = [(9, [1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-5.0]), (4, [3.0]), (None, [1.0, 0.0]), (5, []), (6, None), (None, None), (2, [2.0, 0.0])]
    got = vector_links.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    found = sorted((r["vec_id"] is not None, r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None)
    assert [x[1:] for x in found] == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 0, 5, True), (6, 0, 6, True), (9, 1, 4, False)]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, None)] * 2


def test_components_of_very_large_ids(spark):
    top = 1 << 62
    rows = [(top + k, top + k + 1) for k in range(4)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(rows, "x long, y long"), "x", "y").collect()}
    assert got == {top + k: top for k in range(5)}


def test_blocks_of_a_large_bucket_count_like_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    center = rng.standard_normal(8)
    rows = [(k, (center + rng.standard_normal(8) * 0.01).tolist()) for k in range(150)]
    monkeypatch.setattr(vector_links, "BLOCK", 32)
    got = vector_links.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 0.9).toPandas()
    assert (got["n_links"] == 149).all() and (got["component_id"] == 0).all()


def shuffled_bytes(spark):
    """Bytes of shuffle files that are on disk now."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*") if f.exists())


def test_disk_of_vectors_does_not_grow_with_the_tables(spark, monkeypatch):
    rng = np.random.default_rng(12)
    a, b = pairs_at(rng, 0.97, 1500, 48)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, vector_links.vector_links(vectors, "vec_id", "embedding").collect()))
    monkeypatch.setattr(vector_links, "TURN", 1, raising=False)  # two tables a turn
    before = shuffled_bytes(spark)
    found = vector_links.vector_links(vectors, "vec_id", "embedding")
    for _ in range(50):  # files go in the background
        left = shuffled_bytes(spark) - before
        if left < 1_000_000:
            break
        time.sleep(0.2)
    assert left < 1_000_000  # the vectors have 1.2 MB
    assert sorted(map(tuple, found.collect())) == whole
    for tables, volume in ((1, 0), (24, 16e6), (36, 190e6), (52, 5e9)):
        dealt = vector_links.turns(tables, volume)
        assert [t for own in dealt for t in own] == list(range(tables))
        assert max(map(len, dealt)) * volume <= max(vector_links.TURN, 2 * volume)


def test_bucket_names_are_those_of_the_vector_alone():
    rng = np.random.default_rng(13)
    unit = rng.standard_normal((500, 300))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    whole = vector_links.bucket_keys(unit, 7, 9, 2.0, 1)
    for own in (range(7), range(2, 5), range(6, 7)):
        for k in (0, 7, 499):
            assert (vector_links.bucket_keys(unit[k : k + 1], 7, 9, 2.0, 1, own) == whole[k, own]).all()
    mixed = rng.permutation(300)
    planes, _ = vector_links.directions(300, 7, 9, 1)
    units = np.rint(unit * 2**22) / 2**22
    assert (units @ planes == np.ascontiguousarray(units[:, mixed]) @ np.ascontiguousarray(planes[mixed])).all()


# --- shards


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(2)
    texts = [None, "", "", *[f"group {k}" for k in range(20) for _ in range(rng.randint(2, 9))], *["hot"] * 90, *[f"own {k}" for k in range(150)]]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, shard int")
    rows = rows.unionAll(rows.where("doc_id = 5"))
    got = shard_balance.balanced_shards(rows, "doc_id", "text", 16).toPandas()
    counts = got.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert len(got) == len(texts) + 1 and len(counts) == 16 and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()
    body = [(t or "").encode() for t in texts]
    for r in got.itertuples():
        assert (r.size, r.text_crc32) == (len(body[r.doc_id]) + 1, zlib.crc32(body[r.doc_id]))
    named = got.assign(text=[texts[k] for k in got["doc_id"]])
    whole = named[named["text"].str.startswith("group", na=False)].groupby("text")["shard"].nunique()
    assert (whole == 1).mean() >= 0.9
    assert shard_balance.balanced_shards(rows.where("false"), "doc_id", "text", 16).count() == 0
    assert shard_balance.balanced_shards(rows.limit(3), "doc_id", "text", 16).count() == 3


def test_shards_of_very_long_texts(spark):
    texts = ["é" * 2_000_000, "é" * 2_000_000, "short", None]
    got = {r["doc_id"]: r for r in shard_balance.balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 2).collect()}
    assert got[0]["size"] == 4_000_001 and got[0]["text_crc32"] == got[1]["text_crc32"] == zlib.crc32(texts[0].encode()) and got[0]["shard"] == got[1]["shard"]


def test_propagation_cuts_fewer_links_than_the_start(spark):
    """Links are pairs of equal texts. Shards of 27 rows must cut some groups of up to 12. Null keys are rows like any other."""
    rng = random.Random(6)
    texts = [f"group {g}" for g in range(60) for _ in range(rng.randint(2, 12))] + [None] * 3
    rows = spark.createDataFrame([(k if k % 50 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = shard_balance.balanced_shards(rows.withColumn("uid", F.lit(1)).withColumn("grp", F.lit(2)), "doc_id", "text", 16)
    sizes = got.groupBy("text_crc32").agg(F.count("*").alias("n"))
    together = got.groupBy("text_crc32", "shard").agg(F.count("*").alias("n"))
    pairs = lambda d: d.selectExpr("sum(n * (n - 1) / 2)").first()[0]
    cut = 1 - float(pairs(together)) / float(pairs(sizes))
    assert got.count() == len(texts) and cut < 0.4, cut  # 0.94 of the links are cut when rows are dealt by chance


# --- WARC


def test_archives_give_payloads_back(spark):
    long = "<p>é</p>" * 40
    pages = [(5, "http://a/\r\nX: y", long), (2, "http://b/", long), (9, None, long), (1, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"),
             (7, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n" * 9), (8, "u", "z" * 9_000_000), (10, "", "\r\n\r\n" * 60), (None, "n", long), (None, "n", "own " * 50), (None, None, None)]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, _digest int")
    path = shared_path(spark, "warc-test")
    warc_archive.write_archives(table, path, "page_id", "url", "html")
    index = warc_archive.build_index(spark, path)
    assert index.count() == len(pages)
    report = warc_archive.archive_report(index, "page_id", "bigint").collect()
    got = {r["page_id"]: r for r in report}
    assert sorted((r["payload_bytes"], r["record_type"]) for r in report if r["page_id"] is None) == [(0, "response"), (200, "response"), (len(long.encode()), "response")]
    for k, _, html in [p for p in pages if p[0] is not None]:
        raw = (html or "").encode()
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("revisit", 2) if k in (5, 9) else ("response", None))
    one = warc_archive.read_records(index.where("record_id = '<urn:page:7>'")).collect()
    assert bytes(one[0]["payload"]).decode() == pages[7][2]


def test_archives_of_odd_tables(spark, monkeypatch):
    kind = "page_id long, url string, html string"
    for rows in ([], [(None, None, None)], [(1, "u", "x" * 200)] * 3, [(k, "u", "hot" * 50) for k in range(400)]):
        path = shared_path(spark, "warc-odd")
        warc_archive.write_archives(spark.createDataFrame(rows, kind), path, "page_id", "url", "html")
        want = sorted((k is not None, k, "response" if k in (None, 0, 1) and len(rows) < 9 or k == 0 else "revisit") for k, _, _ in rows)
        for known in (True, False):  # archives that only Spark can open are read the same
            if not known:
                monkeypatch.setattr(warc_archive, "arrow_opens", lambda _: False)
            got = warc_archive.archive_report(warc_archive.build_index(spark, path), "page_id", "bigint").collect()
            assert sorted((r["page_id"] is not None, r["page_id"], r["record_type"]) for r in got) == want
            assert all(r["payload_bytes"] == len(rows[0][2] or "") for r in got)
        monkeypatch.undo()


def test_ranges_coalesce_neighbours_only():
    rows = [("a", 0, 10), ("a", 14, 10), ("a", 24 + warc_archive.GAP + 1, 5), ("b", 0, 5), ("b", 9, warc_archive.RANGE)]
    assert [len(g) for g in warc_archive._ranges(iter(rows))] == [2, 1, 1, 1]


# --- chat


@pytest.mark.parametrize(("stride", "history"), [(2048, 512), (20, 8), (5, 0)])
def test_conversations_come_back_from_windows(spark, stride, history):
    rng = random.Random(stride)
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "[", "<", "<</SYS>>\n", "", None, "\\[INST]", "<<SYS>>x\ny", "é" * 30]
    rows = []
    for c in range(12):
        roles = ["user", "assistant"] * 8 if c % 3 else ["system", *["user", "assistant"] * 7, "to\\ol\n<s>", None]
        rows += [(c, k, r, rng.choice(odd) if rng.random() < 0.6 else "word " * rng.randint(1, 30)) for k, r in enumerate(roles)]
    rows += [(None, 0, "user", "x"), (5, 3, "user", "tie"), (5, 3, "user", "tie"), (5, None, "assistant", "first")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, window int")
    windows = chat_windows.chat_windows(table, COUNTER, stride, history)
    got = {r["conv_id"]: r for r in chat_windows.read_back(windows).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        # ties of turn and role follow the escaped text
        turns = [(r[2] or "", r[3] or "") for r in own]
        target = "".join(t for role, t in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(turns), len(target))
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(target.encode()).hexdigest()
    if stride == 20:
        listed = windows.where("conv_id = 3").orderBy("window").collect()
        assert len(listed) > 1 and all(r["text"].startswith("<<SYS>>system\n") for r in listed)
        assert any(r["n_repeated"] > 1 for r in listed)
    assert chat_windows.read_back(chat_windows.chat_windows(table.where("false"), COUNTER)).count() == 0


def test_a_very_long_turn_comes_back(spark):
    long = "</s>[INST] \\ <<SYS>> é " * 30_000
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", long), (1, 2, "assistant", long + "end"), (1, 3, "user", "and?"), (1, 4, "assistant", "no")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat_windows.read_back(chat_windows.chat_windows(table, COUNTER, 2048, 512)).first()
    assert got["n_turns"] == 5 and got["loss_chars"] == len(long) + 5
    assert got["loss_sha256"] == hashlib.sha256((long + "end" + "no").encode()).hexdigest()


# --- images


def test_copies_are_found_and_others_left_alone(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(40)] + [(40, None)]
    images = image_links.rendered_media(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    images = images.withColumn("bits", F.lit(1))
    got = {r["id"]: r for r in image_links.image_groups(images, "id").collect()}
    assert len(got) == 41 and got[40]["n_descriptors"] == 0 and got[40]["component_id"] == 40
    copies = [k for k in range(40) if k % 5 == 1]
    assert sum(got[k]["component_id"] == k - 1 for k in copies) >= len(copies) - 1
    assert all(got[k]["component_id"] == k for k in range(40) if k % 5 != 1)
    assert image_links.image_groups(images.where("false"), "id").count() == 0


def test_copies_with_few_shared_table_entries_are_verified(spark, monkeypatch):
    monkeypatch.setattr(image_links, "BLOCK", 7, raising=False)  # several blocks
    rng = np.random.default_rng(11)
    rows, few = [], 0
    for k in range(150):
        image = image_links.draw(rng.standard_normal(8), 72)
        noisy = (image[24:, :52].astype(float) + rng.normal(0, 5, (48, 52))).clip(0, 255).round().astype(np.uint8)
        one, two = image_links.describe(image.astype(float)), image_links.describe(noisy.astype(float))
        words = [{(t, v) for row in np.ascontiguousarray(d[1]).view("<u4").tolist() for t, v in enumerate(row)} for d in (one, two)]
        least = max(image_links.MIN_INLIERS, image_links.MIN_SHARE * min(len(one[1]), len(two[1])))
        if 4 <= len(words[0] & words[1]) < 24 and image_links.consensus(*one, *two) >= least:
            few += 1
            rows += [(2 * k, 72, 72, image.tobytes()), (2 * k + 1, 48, 52, noisy.tobytes())]
    assert few >= 3
    got = {r["id"]: r["component_id"] for r in image_links.image_groups(spark.createDataFrame(rows, "id long, height int, width int, pixels binary"), "id").collect()}
    assert sum(got[k] == got[k + 1] for k in got if k % 2 == 0) >= 0.8 * few


def test_a_crowd_of_differing_edits_is_one_group(spark):
    rng = np.random.default_rng(17)
    rows = []
    for group in range(3):
        image = image_links.draw(rng.standard_normal(8), 72)
        for k in range(40):
            cut = rng.integers(0, 14, 4)
            part = image[cut[0] : 72 - cut[1], cut[2] : 72 - cut[3]].astype(float) * rng.uniform(0.8, 1.1)
            part = image_links.resized(part, 0.75) if k % 4 == 3 else np.rot90(part, k % 4)
            own = (part + rng.normal(0, 2, part.shape)).clip(0, 255).round().astype(np.uint8)
            rows.append((100 * group + k, *own.shape, own.tobytes()))
    rng.shuffle(rows)
    images = spark.createDataFrame([(int(a), int(b), int(c), d) for a, b, c, d in rows], "id long, height int, width int, pixels binary")
    got = {r["id"]: r["component_id"] for r in image_links.image_groups(images, "id").collect()}
    assert all(got[k] // 100 == k // 100 for k in got)  # no group takes another's
    assert sum(got[k] == k // 100 * 100 for k in got) >= 0.95 * len(got)


def test_every_pair_of_images_is_compared(spark):
    """Links and groups against all pairs: chance likenesses that share few descriptors, exact copies, and a pair that stands apart in
    every list; keys in another order give the same links."""
    rng = np.random.default_rng(29)
    drawn = [image_links.draw(rng.standard_normal(8), 72) for _ in range(70)]
    for base in list(drawn[:30]):  # noise leaves few equal slices of bits
        cut = rng.integers(0, 22, 2)
        drawn.append((base[cut[0] :, : 72 - cut[1]].astype(float) + rng.normal(0, rng.uniform(3, 9), (72 - cut[0], 72 - cut[1]))).clip(0, 255).round().astype(np.uint8))
    drawn += [drawn[3]] * 5 + [drawn[40]] * 2
    told = [image_links.describe(x.astype(float)) for x in drawn]
    told = [(p.astype("<f4").astype(float), b) for p, b in told]

    def link(one, two):
        least = max(image_links.MIN_INLIERS, image_links.MIN_SHARE * min(len(one[1]), len(two[1])))
        ways = [image_links.consensus(*one, *two) >= least, image_links.consensus(*two, *one) >= least]
        assert ways[0] == ways[1]
        return ways[0]

    pairs = [(i, j) for i in range(len(drawn)) for j in range(i) if link(told[i], told[j])]
    assert len(pairs) > 40
    for keys in (list(range(len(drawn))), rng.permutation(10 * len(drawn))[: len(drawn)].tolist()):
        first = dict(zip(keys, keys, strict=True))
        for _ in keys:
            for i, j in pairs:
                first[keys[i]] = first[keys[j]] = min(first[keys[i]], first[keys[j]])
        rows = [(k, *x.shape, x.tobytes()) for k, x in zip(keys, drawn, strict=True)]
        images = spark.createDataFrame(rows, "id long, height int, width int, pixels binary")
        got = {r["id"]: (r["n_links"], r["component_id"]) for r in image_links.image_groups(images, "id").collect()}
        assert got == {k: (sum(n in pair for pair in pairs), first[k]) for n, k in enumerate(keys)}


def test_no_pair_of_images_is_worked_on_twice():
    """Each image of a chunk takes half of the others, whatever the blocks; both of a pair took it before."""
    for n in (1, 2, 3, 8, 9):
        taken = [np.concatenate([image_links._takes(rank, n, low, min(low + 3, n)) for low in range(0, n, 3)]) for rank in range(n)]
        assert (np.add(taken, np.transpose(taken)) == 1 - np.eye(n)).all()
        assert max(map(sum, taken)) <= n // 2


def test_matches_of_a_block_are_those_of_all_distances():
    """The first nearest descriptor of each image, also with ties, complements (all bits differ) and more descriptors than a byte numbers."""
    rng = np.random.default_rng(31)
    for most in (1, 5, 64, 65, 300):
        images = []
        for k in range(7):
            n = most if k == 3 else int(rng.integers(1, most + 1))
            images.append((rng.normal(0, 20, (n, 4)) ** 2 + 1, rng.integers(0, 256, (n, 32), np.uint8)))
        own = np.concatenate([bits[:9] for _, bits in images])
        flips = rng.random((len(own), 256)) < rng.choice([0, 0.05, 0.18, 0.2], (len(own), 1))
        own = np.concatenate([own ^ np.packbits(flips, axis=1), ~own])
        images[2][1][:] = images[2][1][0]
        at, good = image_links._Block(images).matches(own)
        for k, (_, bits) in enumerate(images):
            apart = np.bitwise_count(own[:, None] ^ bits[None]).sum(axis=2, dtype=int)
            assert (good[:, k] == (apart.min(axis=1) <= image_links.MAX_BITS)).all()
            assert (at[:, k] == apart.argmin(axis=1))[good[:, k]].all()


def test_broken_images_have_no_descriptors(spark):
    rows = [(1, 4, 4, b"\0" * 15), (2, 0, 4, b""), (3, 40, 40, bytes(1600)), (None, 40, 40, bytes(1600)), (4, None, 3, b"x")]
    images = spark.createDataFrame(rows, "id long, height int, width int, pixels binary")
    got = image_links.image_groups(images, "id").collect()
    assert len(got) == 5 and all(r["n_descriptors"] == 0 and r["n_links"] == 0 for r in got)


# --- the pipeline


def test_pipeline_stages_pass_documents_on(spark, data):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert out.select("doc_id").distinct().count() == before
    assert json.dumps(out.columns)


def test_pipeline_stages_agree_with_brute_force_on_odd_rows(spark, data):
    """What each stage after the first keeps of odd rows: nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    import corpus_pipeline

    rng = random.Random(21)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(9)).capitalize() + "."
    one, two, passage = (" ".join(sentence() for _ in range(n)) for n in (12, 12, 7))
    long = " ".join(sentence() for _ in range(6000))
    near = two.replace(two.split()[50], "zzz", 1)
    rows = [(1, one), (2, f"{two} {passage}"), (3, None), (4, ""), (5, one), (6, long), (7, f"{sentence()} {passage} {sentence()}"), (None, one), (None, None), (1, one), (8, "few words"), (9, "few words"), (2, "another text of key two")]
    docs = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "doc_id long, text string, _maybe int, key int, th string")
    cut = corpus_pipeline.line_dedup(spark, docs, data)
    assert cut.columns == docs.columns
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["text"] is not None, r["text"]) for r in cut.collect()), key=repr)
    left = [(k, t) for k, t in rows if k != 5]
    left[[k for k, _ in left].index(7)] = (7, rows[6][1].replace(passage + " ", ""))
    assert got == sorted(((k is not None, k, t is not None, t) for k, t in left), key=repr)
    again = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in [*left, (10, near), (11, f"{near} {sentence()}"), (12, two)]], docs.schema)
    first = corpus_pipeline.ngram_join(spark, again, data)
    assert first.columns == docs.columns

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else set(zip(*(w[k:] for k in range(5)), strict=False))

    own = [(k, grams(t)) for k, t in [*left, (10, near), (11, None), (12, two)]]
    texts = {k: t for k, t in [(r["doc_id"], r["text"]) for r in again.collect()] if k is not None}
    alike = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    named = [(k, grams(texts[k]) if k in (11,) else g) for k, g in own]
    kept = sorted(k for k, g in named if k is not None and not any(alike(g, h) for j, h in named if j is not None and j < k))
    assert sorted(r["doc_id"] for r in first.collect() if r["doc_id"] is not None) == kept and first.where("doc_id is null").count() == 2
    packed = corpus_pipeline.packing(spark, first, data)
    assert packed.where("piece = 0").count() == first.count()
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.where("false"), data).count() == 0


def test_candidates_are_verified_in_many_even_cells(spark):
    """A cell of a pair of blocks is one task, so small tables have several, too; distances by matrices are those of the bits."""
    assert image_links.LEAST_BLOCKS * (image_links.LEAST_BLOCKS + 1) // 2 >= 10
    rng = np.random.default_rng(3)
    one, two = (rng.integers(0, 256, (37, 32), np.uint8) for _ in range(2))
    want = np.bitwise_count(one[:, None, :] ^ two[None, :, :]).sum(axis=2)
    assert (image_links.bits_apart(one, two) == want).all()
