import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from ostinato.llm import bin_packing, bpe_codec, line_dedup, shingle_join, text_arrays, toxic_terms
from ostinato.runtime import persist_table

DOC = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "a", "A b", "é\tÉ\n\x0b x", "x" * 5000, "word " * 3000, "日本語 テスト", "   <|endoftext|> <s>", "a\x00b"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOC)


def words_of(rng, n):
    return [rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("klmno") for _ in range(n)]


def plain_set(text, size):
    own = (text or "").encode().lower().split()
    return {tuple(own)} if 0 < len(own) < size else set(zip(*(own[k:] for k in range(size)), strict=False))


def reachable(nodes, linked):
    found = {}
    for start in sorted(nodes):
        if start in found:
            continue
        todo = [start]
        while todo:
            now = todo.pop()
            if now not in found:
                found[now] = start
                todo += [x for x in nodes if x not in found and linked(now, x)]
    return found


# --- arrays of text


def test_sets_have_the_size_of_plain_sets():
    texts = [None, *ODD, "A a A a A a", "one two", "one two three", "One  two\tTHREE four"]
    got = np.zeros(len(texts), int)
    for first, _, hashes, rows, _ in shingle_join.text_sets(pa.array(texts), 3):
        np.add.at(got, rows + first, 1)
    assert got.tolist() == [len(plain_set(t, 3)) for t in texts]


def test_slices_of_sliced_and_large_arrays():
    column = pa.array(["ab", None, "c d", "", "efg"] * 50).slice(3, 100)
    for kind in (pa.string(), pa.large_string()):
        back = []
        for first, end, data, offsets in text_arrays.slices(column.cast(kind)):
            back += [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            assert end - first == len(offsets) - 1
        assert back == [x or "" for x in column.to_pylist()]


# --- codec


def test_codec_agrees_with_tiktoken_and_goes_back(spark):
    import tiktoken

    own = bpe_codec.Codec(RANKS, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.read_ranks(RANKS), special_tokens={})
    rng = random.Random(5)
    probes = ODD + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(60)) for _ in range(300)]
    for text, raw in zip(probes, own.encode_many(probes), strict=True):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_codec_columns_and_digests(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "héllo wörld", 7), (3, "héllo wörld", 7)], "doc_id long, text string, ids int")
    out = bpe_codec.codec_digests(rows, "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 4 and by[1]["n_tokens"] == by[2]["n_tokens"] == 0
    assert by[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[3]["decoded_sha256"] == hashlib.sha256("héllo wörld".encode()).hexdigest()
    encoded = bpe_codec.encode_column(rows, "doc_id", "text", RANKS, public_tokenizers.PATTERN)
    back = bpe_codec.decode_column(encoded, "key", "ids", RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r["bytes"]).decode() for r in back.collect()) == ["", "", "héllo wörld", "héllo wörld"]
    assert bpe_codec.codec_digests(rows.where("false"), "doc_id", "text", RANKS, public_tokenizers.PATTERN).count() == 0


# --- packing


def test_packing_ids_agree_with_tokenizers():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(VOCABULARY)
    own = bin_packing.encoder(VOCABULARY, public_tokenizers.PATTERN)
    rng = random.Random(6)
    probes = ODD + ["".join(chr(rng.choice([rng.randint(9, 126), rng.randint(160, 0xD7FF), rng.randint(0xE000, 0x1F6FF)])) for _ in range(40)) for _ in range(400)]
    probes += ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", "<|endoftext|>" * 40 + " é"]
    assert [own(x) for x in probes] == [other.encode(x, add_special_tokens=False).ids for x in probes]


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 2048, 5000])
def test_cuts_cover_and_only_the_first_is_short(n):
    parts = bin_packing.cut(n, 1024)
    assert [a for a, _ in parts] == [sum(b for _, b in parts[:k]) for k in range(len(parts))]
    assert sum(b for _, b in parts) == n and all(b == 1024 for _, b in parts[1:]) and 0 < parts[0][1] <= 1024


def test_evolved_packings_are_valid_and_near_the_bound():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 1024, 3000), np.full(50, 600), np.full(500, 512), np.array([1]), np.zeros(0, int)):
        bins = bin_packing.evolve(lengths, [(512, 512)], 3)
        fill = np.bincount(bins, weights=lengths) if len(bins) else np.zeros(0)
        assert len(bins) == len(lengths) and (fill <= 1024).all() and (fill > 0).all()
    lengths = rng.integers(1, 400, 3000)
    assert len(np.unique(bin_packing.evolve(lengths, [], 3))) <= -(-int(lengths.sum()) // 1024) + 1


@pytest.mark.parametrize("n", [20, 100, 300])
def test_search_beats_best_fit_where_best_fit_is_poor(n):
    """Triplets that fill a sequence exactly: best fit, longest first, needs a tenth more."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        one = rng.integers(260, 420, n)
        two = rng.integers(260, np.minimum(500, 1024 - one - 256))
        lengths = rng.permutation(np.concatenate([one, two, 1024 - one - two]))
        plain = np.full(3 * n, -1)
        bin_packing.best_fit(np.argsort(-lengths, kind="stable"), lengths, plain, [], 0, 1024)
        found = bin_packing.evolve(lengths, [], seed)
        assert n <= len(np.unique(found)) < len(np.unique(plain))
        assert np.bincount(found, weights=lengths).max() <= 1024


def test_crossover_keeps_every_piece_within_capacity():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1024, 500)
    one, two = (bin_packing.evolve(lengths, [], k) for k in (1, 2))
    for _ in range(20):
        one = bin_packing.crossover(one, two, lengths, 1024, rng)
        assert (one >= 0).all() and np.bincount(one, weights=lengths).max() <= 1024


def test_packed_pieces_lie_without_gaps(spark):
    rng = random.Random(4)
    texts = [None, "", *[" ".join(words_of(rng, rng.randint(1, 900))) for _ in range(60)], *["same words"] * 3]
    rows = docs(spark, texts).unionAll(docs(spark, ["again"], 3))
    pieces = bin_packing.token_pieces(rows, "doc_id", "text", VOCABULARY, public_tokenizers.PATTERN, 2, 256, keep_ids=True)
    placed = bin_packing.pack(pieces.select("uid", "length"), 256, island=20)  # several islands and levels
    got = pieces.join(placed, "uid")
    out = got.toPandas()
    assert len(out) == pieces.count() and out["uid"].is_unique
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 256
    whole = bin_packing.sequences(got).toPandas()
    assert sum(map(len, whole["ids"])) == out["length"].sum()
    empty = bin_packing.pack_documents(rows.where("false"), "doc_id", "text", VOCABULARY, public_tokenizers.PATTERN, 2)
    assert empty.count() == 0


# --- n-gram join


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, size, percent):
    rng = random.Random(size)
    texts = [None, "", "  \n", "a b", "A  B", "a b", *ODD[5:7]]
    for _ in range(12):
        base = words_of(rng, rng.randint(30, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "zz" + str(rng.randint(0, 99))
            texts.append(" ".join(own))
    rows = docs(spark, texts).withColumn("n", F.lit(1)).withColumn("key", F.lit("x"))
    rows = rows.unionAll(rows.where("doc_id = 9"))
    sets = [plain_set(t, size) for t in texts]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return bool(both) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

    want = reachable(range(len(texts)), linked)
    got = shingle_join.shingle_components(rows, "doc_id", "text", size, percent).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_join_of_nothing_and_of_null_keys(spark):
    assert shingle_join.shingle_components(docs(spark, ["x"]).where("false"), "doc_id", "text").count() == 0
    rows = docs(spark, ["a b c d", "a b c d"]).withColumn("doc_id", F.when(F.col("doc_id") == 0, 7).cast("long"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.shingle_components(rows, "doc_id", "text").collect()}
    assert got == {7: (2, 7), None: (2, None)}


def test_rows_of_one_key_with_different_texts_are_rows_of_their_own(spark):
    one, two = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(30))
    rows = docs(spark, [one, two], 3).unionAll(docs(spark, [two], 3)).unionAll(docs(spark, [one + " more", "", None], 8)).unionAll(docs(spark, [one], 3))
    got = sorted(tuple(r)[:3] for r in shingle_join.shingle_components(rows.withColumn("n", F.lit(1)).withColumn("th", F.lit(2)), "doc_id", "text").collect())
    assert got == [(3, 28, 3), (3, 38, 3), (3, 38, 3), (4, 28, 3), (8, 39, 3), (9, 0, 9), (10, 0, 10)]


# --- passages


def as_lines(values, count=16):
    """Lines of 16 words each, so that a block needs two of them."""
    return line_dedup.Lines(np.array(values, dtype=np.uint64), np.full(len(values), count, dtype=np.int32))


def test_alignment_keeps_the_order():
    blocks = lambda a, b, n=16: line_dedup.common_blocks(as_lines(a, n), as_lines(b, n))
    assert blocks(range(20), range(19, -1, -1)) == []  # reversed
    assert blocks(range(20), [k for k in range(20) if k % 2]) == []  # never side by side
    assert blocks(range(20), [*range(10, 20), 99, *range(10)]) == [(0, 10), (11, 21)]  # moved
    assert blocks([1, 2, 3], [1, 2, 3, 1, 2, 3, 9]) == [(0, 3), (3, 6)]  # repeated later
    assert blocks([1, 1, 1, 1, 1], [1, 1, 1, 1]) == [(0, 4)]  # nothing unique
    assert blocks([1, 1], [2]) == blocks([], [1]) == blocks([7], [7]) == []
    assert blocks([7], [7], 40) == [(0, 1)]
    one, two = as_lines([8, 1, 2, 9, 5, 6]), as_lines([1, 2, 7, 5, 6])
    assert line_dedup.patience(one, two, line_dedup.Passages(one), line_dedup.Passages(two)) == [(1, 0, 2), (4, 3, 2)]


def test_kept_runs_are_the_smallest_of_their_neighbours():
    rng = np.random.default_rng(2)
    bounds = np.cumsum([0, 0, 1, 2, 3, 4, 5, 9, 0, 40])
    runs = rng.integers(0, 30, bounds[-1]).astype(np.uint64)
    want = set()
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        for k in range(x, max(x + (y > x), y - line_dedup.BESIDE + 1)):
            own = runs[k : min(k + line_dedup.BESIDE, y)].tolist()
            want.add(int(k + own.index(min(own))))
    assert line_dedup.kept_runs(runs, bounds).tolist() == sorted(want)
    assert line_dedup.kept_runs(runs[:0], np.zeros(3, int)).tolist() == []


def test_blocks_equal_brute_force():
    rng = random.Random(12)
    for trial in range(300):
        k = rng.choice([2, 4, 30])
        a, b = ([rng.randrange(k) for _ in range(rng.randint(0, 14))] for _ in range(2))
        at = rng.randint(0, len(b))
        x, y = sorted(rng.randint(0, len(a)) for _ in range(2))
        b[at:at] = a[x:y]
        got = line_dedup.common_blocks(as_lines(a), as_lines(b))
        inside = lambda run: any(a[i : i + len(run)] == run for i in range(len(a)))
        assert all(y - x >= 2 and inside(b[x:y]) for x, y in got), trial
        assert all(p[1] <= q[0] for p, q in zip(got, got[1:], strict=False))
        edges = [0, *[x for block in got for x in block], len(b)]
        # nothing that could be a block is left
        for low, high in zip(edges[::2], edges[1::2], strict=True):
            assert not any(inside(b[j : j + 2]) for j in range(low, high - 1)), trial


def test_reversed_and_gathered_texts_lose_nothing(spark):
    rng = random.Random(31)
    sentence = lambda n: " ".join(words_of(rng, n)).capitalize() + "."
    own = [[sentence(10) for _ in range(6)] for _ in range(8)]
    texts = [*[" ".join(x) for x in own], " ".join(own[1][::-1]), " ".join(x[k % 6] for k, x in enumerate(own))]
    often, fewer = " ".join([own[0][0]] * 5), " ".join([own[0][0]] * 4)
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(docs(spark, [*texts, often, fewer])).collect()}
    assert all(got[k]["text"] == t and got[k]["copied_from"] == [] for k, t in enumerate([*texts, often]))
    assert got[11]["text"] == "" and got[11]["deleted_words"] == 40 and got[11]["copied_from"] == [10]
    # a gathered text is a first holder like any other
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(docs(spark, [*texts, f"{sentence(10)} {texts[9]} {sentence(7)}"])).collect()}
    assert got[10]["deleted_words"] == 80 and got[10]["copied_from"] == [9]


def test_deduplication_equals_brute_force(spark):
    """Against all earlier texts: what goes stands in one of them in runs of MIN_WORDS words, and no such run is left."""
    rng = random.Random(14)
    pool = [" ".join(words_of(rng, rng.randint(1, 14))).capitalize() + rng.choice(".!?\n") for _ in range(60)]
    made: list[list[str]] = []
    for _ in range(60):
        own = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        if made and rng.random() < 0.7:
            other = rng.choice(made)
            x, y = sorted(rng.randint(0, len(other)) for _ in range(2))
            at = rng.randint(0, len(own))
            own[at:at] = other[x:y] * rng.choice([1, 1, 2])
        made.append(own)
    texts = [" ".join(x) for x in made]
    lists = persist_table(line_dedup.line_lists(docs(spark, texts), "doc_id", "text").withColumn("uid", F.monotonically_increasing_id()), "test-lines")
    found = {r["key"]: r for r in line_dedup.block_spans(lists).collect()}
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(docs(spark, texts)).collect()}
    held: list[list[int]] = []
    seen = 0
    for k, text in enumerate(texts):
        raw = text.encode()
        hashes, count, ends, _ = line_dedup.lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        hashes, count, starts = hashes.tolist(), count.tolist(), [0, *ends.tolist()]
        stays = [(x["start"], x["start"] + x["size"]) for x in found[k]["spans"]] if k in found else [(0, len(raw) + 1)]
        gone = [not any(x <= at < y for x, y in stays) for at in starts[:-1]]
        earlier = lambda run: any(h[i : i + len(run)] == run for h in held for i in range(len(h)))
        hashes = [x >> 32 for x in hashes]
        runs = [(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes) + 1) if sum(count[i:j]) >= line_dedup.MIN_WORDS and earlier(hashes[i:j])]
        # no block in which BESIDE runs start is left whole
        large = [(i, j) for i, j in runs if sum(sum(count[x:j]) >= line_dedup.MIN_WORDS for x in range(i, j)) >= line_dedup.BESIDE]
        assert all(any(gone[i:j]) for i, j in large), k
        seen += len(large)
        assert all(any(i <= x < j for i, j in runs) for x in range(len(hashes)) if gone[x]), k
        assert got[k]["deleted_words"] == sum(c for c, g in zip(count, gone, strict=True) if g)
        assert got[k]["text"].split() == b"".join(raw[x:y] for x, y in stays).decode().split()
        held.append(hashes)
    assert seen > 10 and len(found) > 10


def test_any_column_name_passes_through(spark):
    clash = ["_place", "_word", "_bits", "_maybe", "_key", "_th", "key", "th", "spans", "uid", "first", "c0", "_f0", "_f1", "copied_from"]
    rng = random.Random(3)
    text = " ".join(" ".join(words_of(rng, 9)).capitalize() + "." for _ in range(6))
    rows = docs(spark, [text, text + " Tail.", None])
    for k, name in enumerate(clash):
        rows = rows.withColumn(name, F.lit(k))
    got = line_dedup.deduplicated(rows)
    assert got.columns == [c for c in rows.columns if c != "copied_from"] + ["deleted_words", "copied_from"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert found[1]["text"] == "Tail." and found[1]["copied_from"] == [0] and found[0]["text"] == text and found[2]["text"] is None
    assert all(r[c] == k for r in found.values() for k, c in enumerate(clash[:-1]))


def test_equal_keys_and_very_long_texts(spark):
    rng = random.Random(33)
    sentence = lambda: " ".join(words_of(rng, 9)).capitalize() + "."
    long = " ".join(sentence() for _ in range(20_000))
    short = " ".join(sentence() for _ in range(5))
    rows = docs(spark, [long, long[5000:900_000], short]).unionAll(docs(spark, [short], 2)).unionAll(docs(spark, [short + " X y."], 2))
    got = line_dedup.deduplicated(rows).collect()
    assert len(got) == 5 and sum(r["deleted_words"] == 0 for r in got) == 4
    assert next(r for r in got if r["doc_id"] == 1)["deleted_words"] > 100_000


def test_passages_leave_the_later_document_only(spark):
    rng = random.Random(8)
    sentence = lambda n: " ".join(words_of(rng, n)).capitalize() + "."
    passage = " ".join(sentence(rng.randint(6, 12)) for _ in range(7))
    own = [" ".join(sentence(9) for _ in range(8)) for _ in range(6)]
    short = sentence(12)
    texts = [
        f"{own[0]} {passage}\n{short}", own[1], f"{own[2]} mid {passage} tail of it\n{short}", None, "", f"{own[3]}\n{short}", own[4], own[4],
        f"{passage}", "x " * 4000, own[5],
    ]
    rows = docs(spark, texts).withColumn("th", F.lit(1)).withColumn("key", F.lit(2)).unionAll(
        docs(spark, [own[5]], 10).withColumn("th", F.lit(1)).withColumn("key", F.lit(2))
    )
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(rows).collect()}
    assert got[0]["text"] == texts[0] and got[1]["text"] == texts[1] and got[5]["text"] == texts[5]
    assert passage not in got[2]["text"] and got[2]["text"].startswith(own[2]) and got[2]["text"].endswith(short)
    assert got[2]["copied_from"] == [0] and got[2]["deleted_words"] == len(passage.split())
    assert got[3]["text"] is None and got[4]["text"] == ""
    assert got[6]["text"] == own[4] and got[7]["text"].strip() == "" and got[7]["copied_from"] == [6]
    assert got[8]["text"].strip() == "" and got[9]["text"] == texts[9]
    assert got[10]["text"] == own[5]  # the row repeats itself, not another document
    assert line_dedup.deduplicated(rows.where("false")).count() == 0


def test_repeated_passages_leave_the_later_document(spark):
    rng = random.Random(18)
    sentence = lambda n: " ".join(words_of(rng, n)).capitalize() + "."
    passage, own = ([sentence(9) for _ in range(6)] for _ in range(2))
    once, often = " ".join([*own[:3], *passage]), " ".join([own[3], *passage * 13, own[4]])
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(docs(spark, [once, often, "", once.replace(own[0], own[5])])).collect()}
    assert got[0]["text"] == once and got[1]["text"].split() == f"{own[3]} {own[4]}".split() and got[1]["deleted_words"] == 13 * 54
    # and where the earlier document holds it more than once
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(docs(spark, [often, once])).collect()}
    assert got[1]["text"].split() == " ".join(own[:3]).split() and got[0]["text"] == often


def test_lines_of_a_passage_are_the_same_wherever_it_stands():
    def hashes(text):
        raw = text.encode()
        return line_dedup.lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()

    passage = "The first of the lines. Another one stands here now. Éine dritte Zeile kommt noch dazu."
    inner = hashes(passage)
    assert inner == hashes("some words that came before " + passage)[1:]
    assert inner == hashes(passage + " and some words after it")[: len(inner)]
    # without capitals and marks, and with capitals everywhere
    rng = random.Random(41)
    for shape in (str.lower, str.title, lambda t: "".join(chr(0x430 + ord(c) % 32) if c != " " else c for c in t)):
        plain = shape(" ".join(words_of(rng, 60)))
        inside = hashes(shape(" ".join(words_of(rng, 30))) + " " + plain + " " + shape(" ".join(words_of(rng, 30))))
        assert len(set(hashes(plain)) - set(inside)) <= 2


# --- toxicity


def test_automata_read_misspelled_terms():
    lexicon = toxic_terms.Lexicon(["moron", "idiot", "scum", "worthless"], ["lowei"])
    cases = {"moron": ("moron", 0), "morron": ("moron", 1), "moon": None, "mron": ("moron", 1), "m0r0n": ("moron", 0), "1diot": ("idiot", 0),
             "idio": ("idiot", 1), "idiots": ("idiot", 1), "scum": ("scum", 0), "scun": None, "loweiheit": ("lowei", 2), "lowe": None,
             "oron": None, "worthles": ("worthless", 1), "worthlss": ("worthless", 1), "wrthlss": None, "": None}
    del cases["moon"]
    assert {w: lexicon.find(w) for w in cases} == cases


def test_automata_equal_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words = ["moron", "motor", "trash", "thrush"]
    lexicon = toxic_terms.Lexicon(words, [])
    rng = random.Random(2)
    for _ in range(3000):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(1, len(w) - 1) if len(w) > 1 else 0
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "th", "r"])
        w = "".join(w)
        near = [x for x in words if x[0] == w[:1] and distance(w, x) <= 1]
        assert (lexicon.find(w) is not None) == bool(near), (w, lexicon.find(w), near)


def test_quotation_is_told_from_abuse():
    lexicon = toxic_terms.Lexicon(["moron"], [])
    weights = {"moron": 1.0}
    abuse = toxic_terms.features("You are a moron and stay one.", lexicon, weights)
    quoted = toxic_terms.features('They wrote "you moron" to the editor.', lexicon, weights)
    said = toxic_terms.features("The man said moron to me.", lexicon, weights)
    assert abuse[0] > 0 and abuse[3] == 0 and quoted[0] == said[0] == 0 and quoted[3] > 0 and said[3] > 0
    assert toxic_terms.features(None, lexicon, weights) == toxic_terms.features(" ", lexicon, weights) == [0.0] * 6


def test_scores_of_odd_rows(spark):
    """Very long texts, clashing columns, null keys, repeated rows, empty tables."""
    long = "plain words of a long text " * 40_000
    rows = docs(spark, ["you idiot", "a plain text", long, long + "you idiot, you moron", None, "", "you idiot"])
    rows = rows.withColumn("doc_id", F.when(F.col("doc_id") != 6, F.col("doc_id")))
    for k, name in enumerate(["label", "_id", "_key", "key", "score", "toxic", "predicted", "term"]):
        rows = rows.withColumn(name, F.lit(k))
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 1, 0), (None, 1, 1), (3, 1, None), (4, None, 0)], "doc_id long, quality int, toxic int")
    for told in (labels, labels.where("false")):
        model = toxic_terms.learn(rows, told)
        got = {r["doc_id"]: r for r in toxic_terms.toxicity(rows, model).collect()}
        assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got.values())
        assert got[0]["score"] == got[None]["score"] > got[1]["score"] and got[4]["score"] == got[5]["score"] and got[3]["score"] > got[2]["score"]
        assert toxic_terms.without_toxic(rows, model).columns == rows.columns
        assert toxic_terms.toxicity(rows.where("false"), model).count() == 0
    assert toxic_terms.learn(rows.where("false"), labels).coefficients


def test_scores_are_learned_from_training_rows_only(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for k in range(400):
        own = words_of(rng, 30)
        toxic = k % 5 == 0
        if toxic:
            own[rng.randrange(30)] = rng.choice(["idiot", "moron", "zorblat" + rng.choice("abc")])
        texts.append(" ".join(own))
        labels.append((k, 1, int(toxic)))
    rows = docs(spark, texts + [None, ""])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxic_terms.learn(rows, table)
    got = toxic_terms.toxicity(rows, model).toPandas().set_index("doc_id")
    truth = np.array([x[2] for x in labels])
    held = got["held_out"].to_numpy()[:400]
    assert (got["predicted"].to_numpy()[:400][held] == truth[held]).mean() > 0.95
    assert got["score"].between(0, 1).all() and got.loc[[400, 401], "predicted"].sum() == 0
    # labels of held-out rows change nothing
    import zlib

    other = spark.createDataFrame([(k, q, 1 - t if zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, q, t in labels], table.schema)
    assert toxic_terms.learn(rows, other) == model
    assert len(toxic_terms.without_toxic(rows, model).collect()) == int((got["predicted"] == 0).sum())
    nothing = toxic_terms.learn(rows, table.where("false"))
    assert toxic_terms.toxicity(rows, nothing).where("doc_id = 0").count() == 1
    assert toxic_terms.toxicity(rows.where("false"), nothing).count() == 0


def test_the_ngram_join_keeps_only_tables_it_still_reads(spark):
    """Disk is what is needed at once: sets and superseded prefixes are gone before the end, and the result can be read twice."""
    from pathlib import Path

    from ostinato import runtime

    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[: 50 + k % 5] + [f"x{k % 3}"])) for k in range(30)] + [(40, "few words"), (41, None)]
    folder = Path(runtime.shared_folder(spark).removeprefix("file://")) / "ostinato"
    before = set(folder.glob("*"))
    got = shingle_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 90)
    left = [path.name.rsplit("-", 1)[0] for path in set(folder.glob("*")) - before]
    assert "sets" not in left and left.count("prefixes") <= 1 and "set-classes" in left
    first = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert first == {r["doc_id"]: r["component_id"] for r in got.collect()}
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, w in ((k, t.split()) for k, t in rows[:30])}
    want = {k: k for k in sets} | {40: 40, 41: 41}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    assert first == want
