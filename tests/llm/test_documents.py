"""Chat formatting, packing, near duplicates, media and the pipeline against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat, components, media, near_dedup, packing, queries

SCHEMA = "doc_id long, text string, node long, component long, block int, shard long, u long, __kept long"
SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA)


# ---- chat


def test_chat_round_trip(spark):
    hard = ["", "<|im_end|>\n", "<|im_start|>assistant\nok", "<\\|im_sep|>", "<\\\\|", "a<", "|b", "$1 \\ % \n", None, "<|im_sep|>"]
    roles = ["user", "assistant", "we<ird\n%3C", None]
    random.seed(2)
    rows = [(c, t, random.choice(roles), random.choice(hard), 7, "x") for c in range(40) for t in random.sample(range(600), 9)]
    rows += [(50, 1, "user", "tie b", 7, "x"), (50, 1, "user", "tie a", 7, "x"), (50, 1, "user", "tie a", 7, "x"), (50, None, "assistant", "first", 7, "x"), (None, 0, "user", "no conversation", 7, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk long, parts string")
    made = chat.format_chats(df).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    want = defaultdict(list)
    for c, t, r, x, *_ in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    assert {r["conv_id"] for r in made} == set(want)
    for r in made:
        turns = [(x, y) for _, x, y in sorted(want[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        merged = sum(a[0] != b[0] for a, b in zip(turns, turns[1:])) + 1
        assert r["formatted"].count(chat.START) == merged == r["formatted"].count(chat.END)
        assert sum(m["length"] for m in r["loss_mask"]) == len(r["formatted"])
        at, loss = 0, []
        for m in r["loss_mask"]:
            loss += [r["formatted"][at : at + m["length"]]] * m["trained"]
            at += m["length"]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in loss] == [y for x, y in turns if x == chat.TRAINED_ROLE]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversation_spans_chunks(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    turns = chat.format_chats(df).select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in turns] == [str(i) for i in range(3000)]


# ---- packing


def test_packing_places_every_token(spark):
    from tokenizers import Tokenizer

    rows = [(1, None), (2, ""), (3, "hello, world"), (3, "hello, world"), (4, "word " * 9000), (5, "x" * 30_000), (6, "İİ Σας ΣΣ. KÅ é, ́."), (None, "no id")] + [(100 + i, "the cat sat " * (i % 97)) for i in range(300)]
    df = documents(spark, rows)
    got = packing.pack_documents(df, shard_docs=100).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    tokenizer.encode_special_tokens = True
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        for k in range(0, len(ids), packing.CAPACITY):
            part = ids[k : k + packing.CAPACITY]
            want[i, k // packing.CAPACITY, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack_documents(df.limit(0)).count() == 0


def least_bins(lengths, capacity):
    best = [len(lengths)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                put(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best[0]


def test_local_search_saves_bins_and_loses_nothing():
    random.seed(4)
    for _ in range(400):
        lengths = [random.randint(1, 20) for _ in range(random.randint(1, 9))]
        first = packing.best_fit(lengths, 20)
        bins = packing.local_search([list(b) for b in first], lengths, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 20 for b in bins)
        assert least_bins(lengths, 20) <= len(bins) <= len(first)
    assert packing.pack([6, 6, 5, 5, 4, 4, 10], 10) and len(packing.pack([4, 4, 4, 6, 6, 6], 10)) == 3
    # best fit takes three bins, and exchanges empty one
    lengths = [26, 17, 26, 44, 61, 19]
    assert len(packing.best_fit(lengths, 100)) == 3 and len(packing.pack(lengths, 100)) == 2


def test_local_search_leaves_no_exchange():
    random.seed(5)
    for low, high, n in ((1400, 3000, 1800), (300, 2600, 300)):
        lengths = [random.randint(low, high) for _ in range(n)]
        bins = packing.pack(lengths, 4096)
        assert sorted(i for b in bins for i in b) == list(range(n))
        if len(bins) > -(-sum(lengths) // 4096):
            made = [packing.Bin(b, lengths, 4096) for b in bins]
            pairs = [(a, b) for a in made for b in made if a is not b and a.room >= b.room > 0]
            assert not any(packing.exchange(a, b) for a, b in pairs)


def test_underfull_sequences_of_all_shards_are_brought_together(spark):
    rows = [(i, "cat " * 20) for i in range(400)]
    got = packing.pack_documents(documents(spark, rows), capacity=100, shard_docs=10).collect()
    sizes = Counter()
    for r in got:
        sizes[r["sequence_id"]] += r["length"]
    assert len(got) == 400 and max(sizes.values()) <= 100 and {r["length"] for r in got} == {21}
    # four to a sequence; ten to a shard on their own would leave one underfull sequence in nearly each of forty
    assert len(sizes) <= 104


# ---- near duplicates


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_classes(rows):
    """doc_id -> least reachable doc_id, by comparing all sets that share a shingle."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, word_set(t)) for i, t in rows]
    seen = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        shared = Counter(j for g in s for j in seen[g])
        for j, n in shared.items():
            if 100 * n >= near_dedup.PERCENT * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                root[max(a, b)] = min(a, b)
        for g in s:
            seen[g].append(k)
    return {i: find(i) for i, _ in rows}


def variants(n, seed=1):
    random.seed(seed)
    base = [f"w{random.randint(0, 3000)}" for _ in range(300)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(random.choice([0, 1, 3, 5, 8, 12])):
            words[random.randrange(300)] = f"v{random.randint(0, 10**6)}"
        rows.append((i * 7 % 1009, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [1024, 40])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = variants(160)
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "few words"), (2004, "Few  WORDS"), (2005, "a " * 50_000), (2006, "x" * 100_000), (2007, "a b c d e"), (2008, "A b c d e"), (2003, "few words")]
    df = documents(spark, rows)
    got = near_dedup.classes(df).collect()
    want = plain_classes([r for r in rows])
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]]
    sizes = {i: len(word_set(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)


def test_near_duplicate_edges(spark):
    assert near_dedup.classes(documents(spark, []).limit(0)).count() == 0
    df = documents(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (4, "a b c d e f g"), (9, "other text"), (9, "quite another text")])
    rows = near_dedup.classes(df).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["component_id"] is None else r["component_id"]) for r in rows)[2:5] == [(4, 4), (5, 5), (5, 5)]
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, -1, 4, 5, 9]


def test_sketches_estimate_similarity():
    random.seed(0)
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.3, 0.85):
        agree = []
        for n in (1, 5, 60, 400):
            common = rng.integers(0, 2**63, max(1, round(2 * n * share / (1 + share))), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n, dtype=np.uint64)[: max(0, n - len(common))]])) for _ in range(2))
            s = near_dedup.sketch_sets([a, b])
            assert (s != np.uint64(2**64 - 1)).all()
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append(abs((s[0] == s[1]).mean() - true))
        assert max(agree) < 0.15
    assert (near_dedup.sketch_sets([np.empty(0, np.uint64)]) == np.uint64(2**64 - 1)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (200, 200)] + [(300, 300 + k) for k in range(1, 30)]
    random.seed(0)
    edges = [e if random.random() < 0.5 else e[::-1] for e in edges]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {101: 100, 102: 100} | {300 + k: 300 for k in range(1, 30)}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- media


@pytest.mark.parametrize("alphabet", [range(256), range(32, 123), (255,), (0, 255, 127, 128)])
@pytest.mark.parametrize("n", [0, 1, 192, 193, 1536, 9000])
def test_media_round_trip(n, alphabet):
    random.seed(n)
    raw = bytes(random.choice(list(alphabet)) for _ in range(n))
    payload = raw + b" " * (192 if not raw else -len(raw) % 192)
    file = media.write_avi(payload)
    frames, _, length = media.read_avi(file)
    values, _ = media.decode_frames(frames)
    assert media.payload_of(values, length) == payload
    if n < 2000:  # bit by bit
        assert media.payload_of([media.Frame(x).coefficients() for x in frames], length) == payload


def test_media_without_index_and_foreign_codes():
    file = media.write_avi(b"ab " * 3000)
    at = file.rindex(b"idx1")
    bare = file[:4] + (at - 8).to_bytes(4, "little") + file[8:at]
    assert media.read_avi(bare)[0] == media.read_avi(file)[0]
    assert media.clips(bare) == media.clips(file)
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF....WAVE")
    # a grey frame of one block with other tables: DC difference 5, then end of block; quantiser 16
    quant = b"\0" + bytes([16] * 64)
    codes = lambda kind, symbols: bytes([kind, 0, len(symbols)] + [0] * 14) + bytes(symbols)
    parts = [(0xDB, quant), (0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])), (0xC4, codes(0, [0, 3])), (0xC4, codes(0x10, [0, 1])), (0xDA, bytes([1, 1, 0, 0, 63, 0]))]
    frame = b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + (len(b) + 2).to_bytes(2, "big") + b for m, b in parts) + bytes([0b01101001, 0xFF]) + b"\0\xff\xd9"
    raw, luma = media.decode_frames([frame])
    assert raw[0][0, 0, 0] == 5 and luma[0][0, 0] == 80 and not raw[0][0, 0, 1:].any()


def test_shots():
    import numpy as np

    flat = lambda level: np.concatenate([[[level * 8.0]], np.zeros((1, 63))], axis=1)
    frames = [flat(-60)] * 10 + [flat(50)] * 12 + [flat(-20)] * 9
    assert media.cuts(frames) == [10, 22]
    assert media.cuts([]) == [] and media.cuts([flat(0)]) == []


def test_media_frames(spark):
    df = documents(spark, [(1, None), (2, ""), (3, "é 😀" * 3000), (3, "é 😀" * 3000), (None, "x" * 50_000)])
    files = media.media_from_text(df)
    rows = media.media_clips(files).collect()
    assert files.count() == 5 and {r["media_id"] for r in rows} == {1, 2, 3, None}
    for k in (3,):
        mine = [(r["clip"], r["first_frame"], r["end_frame"]) for r in rows if r["media_id"] == k]
        assert all(mine.count(x) == 2 for x in mine)  # equal files, equal clips
    assert media.media_clips(files.limit(0)).count() == 0
    assert media.media_clips(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0


def test_media_query(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_media_columns"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


# ---- pipeline


def test_near_duplicates_at_eighty_per_cent(spark, monkeypatch):
    # copies with a word changed in every 25 to 60
    rows, words = [], [f"w{i}" for i in range(300)]
    for k in range(40):
        base = [f"{w}x{k}" for w in words]
        for copy, gap in enumerate([0, 50, 40, 60, 25]):
            rows.append((k * 10 + copy, " ".join(f"v{copy}" if gap and i % gap == gap // 2 else w for i, w in enumerate(base))))
    kept = {r["doc_id"] for r in near_dedup.keep_one(documents(spark, rows), percent=80).collect()}
    tight = {i for i, c in plain_classes(rows).items() if i == c}
    monkeypatch.setattr(near_dedup, "PERCENT", 80)
    want = {i for i, c in plain_classes(rows).items() if i == c}
    assert kept == want and len(want) < len(tight)


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline
    from tesserae.llm import language, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "language ID", "MinHash near-dedup", "best-fit packing"]
    kept = stage["quality rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in docs.filter(quality.verdict(docs["text"], list(quality.RULES))).collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and 0 < len(want) < docs.count()
    told = stage["language ID"](spark, kept, SF)
    assert told.columns == docs.columns and told.count() > 0.98 * len(want)
    one = stage["MinHash near-dedup"](spark, told, SF)
    rows = [(r["doc_id"], r["text"]) for r in told.collect()]
    classes = plain_classes(rows)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, c in classes.items() if i == c)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == {i for i, c in classes.items() if i == c}
    assert language.UNKNOWN == "und" and isinstance(pa.__version__, str)


# ---- what is read back through the loss mask


def mask_rows(spark):
    rows = [(1, 0, "user", "a<"), (1, 1, "assistant", "x<|im_end|>\\"), (1, 2, "assistant", "|y"), (1, 3, "user", None), (2, 0, "user", "no answer"), (3, 0, "assistant", ""), (3, 1, "assistant", "é😀<\\|z")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("runs", [512, 2])
def test_loss_comes_through_the_mask(spark, monkeypatch, runs):
    monkeypatch.setattr(chat, "CHUNK_RUNS", runs)
    made = chat.format_chats(mask_rows(spark))
    want = {1: "x<|im_end|>\\|y", 2: "", 3: "é😀<\\|z"}
    got = {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat.digests(made).collect()}
    assert got == {k: (len(v), hashlib.sha256(v.encode()).hexdigest()) for k, v in want.items()}
    # a wrong mask shows
    moved = made.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.struct(m["length"].alias("length"), (~m["trained"]).alias("trained"))))
    other = {r["conv_id"]: r["loss_sha256"] for r in chat.digests(moved).collect()}
    assert all(other[k] != got[k][1] for k in want)
    assert "trained" in chat.digests(made)._jdf.queryExecution().optimizedPlan().toString()
    assert chat.digests(made.limit(0)).count() == 0


def test_very_long_conversation_is_read_back(spark):
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<|"), "id").alias("text"))
    row = chat.digests(chat.format_chats(df)).first()
    loss = "".join(f"t<|{i}" for i in range(1, 20_000, 2))
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (20_000, len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---- row order, hot keys, whole queries


def packed_as(df, **kw):
    bins = defaultdict(list)
    for r in packing.pack_documents(df, **kw).collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["ids_crc32"]))
    return sorted(sorted(b) for b in bins.values())


def test_packing_does_not_depend_on_row_order(spark):
    random.seed(9)
    rows = [(i % 50, "the cat sat " * (i % 37)) for i in range(500)] + [(7, "same text")] * 60 + [(None, None)] * 9
    pieces = lambda df: Counter(map(tuple, packing.pieces_of(df).collect()))
    one, other = (spark.createDataFrame(random.sample(rows, len(rows)), "doc_id long, text string").coalesce(1) for _ in range(2))
    assert pieces(one) == pieces(other)
    assert packed_as(one, shard_docs=100) == packed_as(other, shard_docs=100)


def test_best_fit_packing_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    tokenizer.encode_special_tokens = True
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[r["doc_id"], k // 4096, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    rows = queries.QUERIES["op8_best_fit_packing"](spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096
    # no fewer sequences can hold so many tokens
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 4096) + 1


@pytest.mark.parametrize("few", [0, 131_072])
def test_hot_keys_are_dealt_out(spark, monkeypatch, few):
    monkeypatch.setattr(components, "LEAST_HOT", 8)
    monkeypatch.setattr(components, "BROADCAST_PAIRS", few)
    random.seed(6)
    edges = [(0, k) for k in range(1, 400)] + [(500 + k, 500 + random.randrange(k)) for k in range(1, 200)] + [(None, 3), (3, None), (900, 900)] + [(0, 1)] * 50
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {k: 0 for k in range(1, 400)} | {k: 500 for k in range(501, 700)}
    pairs = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(99, 5)], "k long, v long"))
    rows = components.with_least(pairs, "k", "v", 1001, 2).collect()
    assert len(rows) == 1000 and all(r["least"] == r["k"] for r in rows)


def test_media_fields(spark):
    """media_bytes and media_sha256 are of a file from which a plain reader gets the payload; equal texts have equal features."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows, seen = queries.QUERIES["op10_media_columns"](spark, SF).collect(), {}
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        file = media.write_avi(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        assert seen.setdefault(raw, r["feature"]) == r["feature"] and r["feature"]


EDGES = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, None), (None, "no id at all " * 30, "en", "s", 1), (3, "x" * 300_000, "en", "s", 2), (4, "word " * 50_000, None, "s", 3), (5, "12 34 " * 40, "fr", "s", 4)]


def test_pipeline_stages_take_what_comes(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, no labels, no rows, and columns that clash."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(EDGES, docs.schema)
    for name, df in {"odd": docs.unionByName(odd).unionByName(docs.limit(20)), "only odd": odd, "none": docs.limit(0), "no labels": docs.withColumn("lang", F.lit(None).cast("string")), "clash": docs.withColumns({c: F.lit(1) for c in ("__kept", "node", "component", "shard", "class")})}.items():
        for k, (stage, step) in enumerate(corpus_pipeline.STAGES):
            out = step(spark, df, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns, (name, stage)
                out.write.parquet(str(tmp_path / f"{name}{k}"))
                before, df = df, spark.read.parquet(str(tmp_path / f"{name}{k}"))
                assert df.exceptAll(before).isEmpty(), (name, stage)  # rows go or stay, and never change
            else:
                assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in df.collect()}
