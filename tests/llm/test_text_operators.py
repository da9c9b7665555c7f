"""Quality rules, license scans, byte-level BPE, token counts, language ID and language-model scores against plain versions."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import byte_bpe, language, licenses, lm, quality, queries, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "x" * 200_000
MANY = "alpha beta gamma delta " * 20_000
TEXTS = [None, "", " \n\t ", "a", "One two.\nOne two.\n\nthree", LONG, MANY, "a b c a b c a b c d", "É ü ß 中文 😀 naïve", "tab\x0bvertical\x0cform", "a\x00b \x1c c", "a b c a b c a b c d"]
SCHEMA = "doc_id long, text string, lang string, __q_words string, words string, node long, block int, shard long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 2 else "en", "x", "y", 1, 2, 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", "fr", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_statistics(text):
    text = text or ""
    words, lines, windows = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)], {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(docs, nothing):
    got = quality.with_statistics(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[1:] == plain_statistics(r["text"])
    assert set(docs.columns) < set(quality.with_statistics(docs).columns)
    assert quality.with_statistics(nothing).count() == 0


def test_quality_cascade_keeps_columns_and_order_does_not_matter(spark, docs, nothing):
    good = " ".join(f"word{i} and" for i in range(60))
    df = docs.unionByName(spark.createDataFrame([(99, good, "en", "x", "y", 1, 2, 3), (98, good + "#" * 200, "en", "x", "y", 1, 2, 3)], SCHEMA))
    kept = quality.cascade(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {99}
    names = list(quality.RULES)
    for order in (names, names[::-1]):
        assert {r["doc_id"] for r in df.filter(quality.verdict(df["text"], order)).collect()} == {99}
    assert quality.cascade(nothing).count() == 0
    planned = quality.plan_cascade(df)
    assert {x["rule"] for x in planned} == set(names)
    rates = [x["rejects"] / max(x["cost_s"], 1e-9) for x in planned]
    assert rates == sorted(rates, reverse=True)


def plain_labels(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
    found, best = set(), 0.0
    last = max(0, -(-(len(words) - licenses.BLOCK_WORDS) // licenses.BLOCK_STEP))
    for k in range(last + 1):
        block = set(words[k * licenses.BLOCK_STEP : k * licenses.BLOCK_STEP + licenses.BLOCK_WORDS])
        for label, template in licenses.TEMPLATES:
            asked = set(template.encode().split())
            if len(asked & block) >= math.ceil(round(licenses.THRESHOLD * len(asked), 9)):
                found.add(label)
                best = max(best, len(asked & block) / len(asked))
    return len(words), sorted(places), found, best


def test_license_matches(spark, docs, nothing):
    random.seed(5)
    pool = " ".join(t for _, t in licenses.TEMPLATES).split() + ["cc", "by", "rights", "all", "reserved", "general", "public", "license"]
    made = [(1000 + i, " ".join(random.choice(pool) for _ in range(random.randint(0, 150)))) for i in range(120)]
    made += [(5000, "x " * 70 + "Licensed under the Apache License, Version 2.0." + " y" * 70), (5001, "cc by cc by cc-by CC BY"), (5002, "é" * 10 + " all rights reserved")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = licenses.license_matches(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        n, places, found, best = plain_labels(texts[r["doc_id"]])
        assert r["n_words"] == n and sorted((p["at"], p["label"]) for p in r["places"]) == places
        assert {b["label"] for b in r["blocks"]} == found
        assert max([0.0, *(b["containment"] for b in r["blocks"])]) == pytest.approx(best)
    assert licenses.license_matches(nothing).count() == 0


@pytest.fixture(scope="module")
def reference_bpe():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_frames(docs, nothing, reference_bpe):
    texts = [r["text"] for r in docs.collect()]
    encoded = byte_bpe.encode_texts(docs, offsets=True)
    rows = encoded.collect()
    assert sorted(r["ids"] for r in rows) == sorted(reference_bpe.encode_ordinary(t or "") for t in texts)
    back = {bytes(r["decoded"]) for r in byte_bpe.decode_ids(encoded).collect()}
    assert back == {(t or "").encode() for t in texts}
    assert byte_bpe.encode_texts(nothing).count() == 0
    table = byte_bpe.byte_table(byte_bpe.vocabulary_paths()[1])
    for r in rows:
        raw, at = b"".join(table[i] for i in r["ids"]), 0
        for i, c in list(zip(r["ids"], r["char_starts"]))[:50]:
            assert len(raw[:at].decode(errors="ignore")) in (c, c + 1)  # a split character counts as begun
            at += len(table[i])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t'stveLl.,!|<>ab01é×÷—ß́\xa0　中😀\x00\x1c", max_size=60))
def test_byte_bpe_text(reference_bpe, text):
    tool = byte_bpe.encoder(*byte_bpe.vocabulary_paths())
    ids, _ = tool.encode(pa.array([text]))
    assert ids.tolist() == reference_bpe.encode_ordinary(text)
    assert "".join(byte_bpe.decode_stream(ids.tolist(), tool.table)) == text


def test_special_strings_are_text(reference_bpe):
    tool = byte_bpe.encoder(*byte_bpe.vocabulary_paths())
    ids, _ = tool.encode(pa.array(["a<|endoftext|>b"]))
    assert ids.tolist() == reference_bpe.encode_ordinary("a<|endoftext|>b") and 50256 not in ids


def greedy(vocabulary, word):
    initial, rest = {p[1:] for p in vocabulary if p.startswith("▁")}, {p for p in vocabulary if not p.startswith("▁")}
    at = n = 0
    known = initial
    while at < len(word):
        to = next((j for j in range(len(word), at, -1) if word[at:j] in known), None)
        if to is None:
            if at == 0 and known is initial and "" in initial:
                n, known = 1, rest
                continue
            return 0
        at, n, known = to, n + 1, rest
    return n


pieces = st.builds(lambda mark, s: mark + s, st.sampled_from(["▁", ""]), st.text("abc", min_size=1, max_size=4))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.one_of(pieces, st.just("▁")), max_size=14), st.lists(st.text("abc", min_size=1, max_size=14), max_size=10))
def test_automaton_counts_like_a_greedy_split(vocabulary, words):
    machine = token_counts.Automaton(vocabulary)
    assert [machine.count(w) for w in words] == [greedy(vocabulary, w) for w in words]


def test_token_counts(docs, nothing):
    vocabulary = set(token_counts.pieces(token_counts.vocabulary_path()))
    texts = [t for t in TEXTS if t != LONG] + [TEXTS[4], "no id"]
    want = sorted((len(ws), sum(max(1, greedy(vocabulary, w)) for w in ws), sum(greedy(vocabulary, w) == 0 for w in ws)) for ws in (WORD.findall(t or "")[:200] for t in texts if t != MANY))
    got = [r for r in token_counts.token_counts(docs.filter("text IS NULL OR length(text) < 1000")).collect()]
    assert sorted((r["n_words"], r["n_tokens"], r["n_unknown"]) for r in got) == want
    assert token_counts.token_counts(docs).count() == docs.count()
    assert token_counts.token_counts(nothing).count() == 0


def test_forward_sums_all_segmentations():
    model = language.fit({"a": {b" ab": 3, b" abc": 1, b" b": 2}, "b": {b" cc": 3}}, language.vocabulary_path())
    place = {k: i for i, k in enumerate(model.keys.tolist())}
    for word in (b" ab", b" abcabc", b" " + b"abcdefgh" * 40, " é".encode()):
        for k in range(2):
            sums = [1.0] + [0.0] * len(word)
            scale = 0.0
            for e in range(1, len(word) + 1):
                for s in range(max(0, e - language.PIECE_BYTES), e):
                    if (key := int.from_bytes(b"\1" + word[s:e], "big")) in place:
                        sums[e] += sums[s] * model.prob[place[key], k]
                if sums[e] < 1e-200:
                    sums, scale = [min(x, 1.0) * 1e200 if k > e - 9 else 0.0 for k, x in enumerate(sums)], scale - math.log(1e200)
            assert model.score_words([word])[0, k] == pytest.approx(math.log(sums[-1]) + scale)


def test_language_edges(docs, nothing):
    model = language.train(docs)
    rows = {r["doc_id"]: r for r in language.predictions(docs, model, ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        lettered = any(c.isalpha() for c in t or "")
        assert (rows[i]["lang_pred"] == language.UNKNOWN) == (not lettered)
        assert 0 <= rows[i]["score"] <= 1 and (lettered or rows[i]["score"] == 0)
    assert language.keep_known(docs).columns == docs.columns
    assert language.keep_known(nothing).count() == 0
    unlabelled = language.train(docs.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in language.predictions(docs, unlabelled, ["doc_id"]).collect()} == {language.UNKNOWN}


def test_language_held_out_accuracy(spark):
    rows = queries.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = rows.filter("held_out").join(truth, "doc_id").collect()
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98


def test_language_sample_goes_by_distinct_texts(spark):
    from pyspark.sql import functions as F

    word = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij").alias("text")
    others = spark.range(4000).select(word, F.lit("en").alias("lang"))
    copies = spark.range(100_000).select(F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    few = spark.range(50).select(word, F.lit("fr").alias("lang"))
    counts = language.sample_counts(others.unionByName(copies).unionByName(few), "text", "lang", 200)
    assert 140 < len(counts["en"]) < 260 and len(counts["fr"]) == 50


def test_mixed_and_unknown_languages_go(spark):
    random.seed(3)
    made = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IN ('en', 'fr', 'de')").select("text", "lang").distinct().collect()
    by = {k: sorted(r["text"] for r in made if r["lang"] == k and 80 <= len(r["text"].split()) <= 400)[:60] for k in ("en", "fr", "de")}
    rows = [(t, k, "clean") for k in ("en", "fr") for t in by[k]]
    rows += [(" ".join(a.split()[:40] + b.split()[:40]), None, "mixed") for a, b in zip(by["en"], by["fr"])]
    rows += [(t, None, "unknown") for t in by["de"]]
    rows += [(" ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(90)), None, "junk") for _ in range(20)]
    df = spark.createDataFrame(rows, "text string, lang string, kind string")
    kept, total = Counter(r["kind"] for r in language.keep_known(df).collect()), Counter(r[2] for r in rows)
    assert all(total[k] >= 10 for k in ("clean", "mixed", "unknown", "junk"))
    assert kept["clean"] >= 0.98 * total["clean"] and kept["unknown"] == kept["junk"] == 0 and kept["mixed"] <= 0.1 * total["mixed"]


def test_lm_scores(docs, nothing):
    texts = [(r["doc_id"], WORD.findall((r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) for r in docs.collect()]
    one, two = Counter(), Counter()
    for _, ws in texts:
        one.update(ws)
        two.update(zip(ws, ws[1:]))
    total, want = sum(one.values()), []
    for i, ws in texts:
        o, t, score = Counter(ws), Counter(zip(ws, ws[1:])), 0.0
        for k, w in enumerate(ws):
            rest, alone = total - len(ws), one[w] - o[w]
            single = alone / rest if alone > 0 else lm.ALPHA / (rest + 1)
            pair = k > 0 and two[ws[k - 1], w] - t[ws[k - 1], w]
            score += math.log(pair / (one[ws[k - 1]] - o[ws[k - 1]]) if pair else lm.ALPHA * single if k else single)
        want.append((-1 if i is None else i, len(ws), score))
    for size in (16_000_000, 3_000):  # one block, and many
        got = lm.score_texts(docs, block_bytes=size).collect()
        rows = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["log_score"]) for r in got)
        for a, b in zip(rows, sorted(want), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])
        assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in got)
    assert lm.score_texts(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import verify

    con = duckdb.connect()
    for t in verify.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    out = con.execute(queries.ORACLES[name])
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(verify.key(r[i]) for i in order) for r in out.fetchall())
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == sorted(names) and verify.rows(df) == want


def test_byte_bpe_query(spark, reference_bpe):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = reference_bpe.encode_ordinary(r["text"] or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        got = rows[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert got["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_whole_notices(spark):
    """Each notice is found wherever it stands, with a tenth of its words changed, in upper case, and not in half."""
    filler = " ".join(f"w{i}" for i in range(500))
    rows = []
    for k, (label, text) in enumerate(licenses.NOTICES):
        words = text.split()
        rows += [(k, f"{filler[: 400 + 37 * k]} {text.upper()} {filler}"), (100 + k, " ".join(words[: len(words) // 2])), (200 + k, f"{text}. {text}")]
    got = {r["doc_id"]: {b["label"] for b in r["blocks"]} for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), templates=[]).collect()}
    for k, (label, text) in enumerate(licenses.NOTICES):
        assert label in got[k] and label in got[200 + k]
        assert label not in got[100 + k] or len(set(text.split()[: len(text.split()) // 2])) >= licenses.THRESHOLD * len(set(text.split()))
    assert max(len(t.split()) for _, t in licenses.NOTICES) <= licenses.NOTICE_WORDS // 2
    assert max(len(t.split()) for _, t in licenses.TEMPLATES) <= licenses.BLOCK_STEP


def test_no_labels_in_texts_without_licenses(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("NOT lower(text) RLIKE 'license|cc by|rights reserved'").select("doc_id", "text")
    rows = licenses.license_matches(df).filter("size(places) > 0 OR size(blocks) > 0")
    assert df.count() > 900 and rows.count() == 0


def bounded_greedy(vocabulary, word, longest=64):
    """`greedy` for long words: no longer slices than the longest piece."""
    at = n = 0
    while at < len(word):
        mark = "▁" if at == n == 0 else ""
        to = next((j for j in range(min(len(word), at + longest), at, -1) if mark + word[at:j] in vocabulary), None)
        if to is None:
            if mark and mark in vocabulary:
                n = 1
                continue
            return 0
        at, n = to, n + 1
    return n


def test_token_counts_query(spark):
    """The query over a whole table against a split word by word, long words and their numbers included."""
    vocabulary = set(token_counts.pieces(token_counts.vocabulary_path()))
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    known = {}
    assert max(map(len, vocabulary)) <= 64
    for r in docs:
        words = WORD.findall(r["text"] or "")
        counts = [known[w] if w in known else known.setdefault(w, bounded_greedy(vocabulary, w)) for w in words]
        got = rows[r["doc_id"]]
        assert (got["n_words"], got["n_tokens"], got["n_unknown"]) == (len(words), sum(max(1, c) for c in counts), counts.count(0))
    assert len(rows) == len(docs)


def test_very_long_words_are_counted_whole(spark):
    vocabulary = set(token_counts.pieces(token_counts.vocabulary_path()))
    texts = ["supercalifragilistic" * 60, "ab" * 700 + "é", "x" * 3001, "a" * 900 + " b"]
    rows = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        counts = [bounded_greedy(vocabulary, w) for w in WORD.findall(texts[r["doc_id"]])]
        assert (r["n_tokens"], r["n_unknown"]) == (sum(max(1, c) for c in counts), counts.count(0))


def segmentations(word, place):
    """Every way to cut a word into known pieces, one by one."""
    if not word:
        yield []
    for n in range(1, min(language.PIECE_BYTES, len(word)) + 1):
        if (key := int.from_bytes(b"\1" + word[:n], "big")) in place:
            for rest in segmentations(word[n:], place):
                yield [place[key], *rest]


def test_scores_and_fit_equal_an_enumeration():
    path = language.vocabulary_path()
    counts = {"a": {b" abca": 3, b" cab": 2}, "b": {b" bb": 5, b" ccab": 1}}
    place = {k: i for i, k in enumerate(language.piece_keys(path).tolist())}
    # one round of expectation maximisation over listed segmentations
    for language_name, words in counts.items():
        used, start = Counter(), 1 / len(place)
        for word, n in words.items():
            ways = [(w, start ** len(w)) for w in segmentations(word, place)]
            whole = sum(p for _, p in ways)
            for w, p in ways:
                for piece in w:
                    used[piece] += n * p / whole
        total = sum(used.values()) + language.SMOOTHING * len(place)
        got = language.fit({language_name: words}, path, rounds=1).prob[:-1, 0]
        want = [(used[i] + language.SMOOTHING) / total for i in range(len(place))]
        assert got == pytest.approx(want)
    model = language.fit(counts, path)
    for word in (b" abca", b" bbcc", b" cabcab", " né".encode(), b" zq"):
        for k in range(2):
            want = math.log(sum(math.prod(model.prob[i, k] for i in w) for w in segmentations(word, place)))
            assert model.score_words([word])[0, k] == pytest.approx(want)


def test_language_query_against_plain_predictions(spark):
    """Predictions of the query, each word's segmentations summed in plain Python with the model that its rows give."""
    import zlib

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = language.train(docs.filter(~language.held_out(docs["doc_id"])))
    place = {k: i for i, k in enumerate(model.keys.tolist())}
    known = {}

    def log(word):
        if word not in known:
            sums = [[1.0] * len(model.languages)]
            for end in range(1, len(word) + 1):
                parts = [(s, place.get(int.from_bytes(b"\1" + word[s:end], "big"))) for s in range(max(0, end - language.PIECE_BYTES), end)]
                sums.append([sum(sums[s][k] * model.prob[i, k] for s, i in parts if i is not None) for k in range(len(model.languages))])
            known[word] = [math.log(x) for x in sums[-1]]
        return known[word]

    rows = {r["doc_id"]: r for r in queries.QUERIES["op5_language_id"](spark, d).collect()}
    asked = docs.filter("length(text) < 3000").limit(60).collect()
    for r in asked:
        words = re.findall(rb"[a-z\x80-\xff]+", (r["text"] or "").lower().encode())
        got = rows[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (got["lang_pred"], got["score"]) == ("und", 0)
            continue
        logs = [sum(x) for x in zip(*(log(b" " + w) for w in words))]
        assert got["lang_pred"] == model.languages[logs.index(max(logs))]
        assert got["score"] == pytest.approx(1 / sum(math.exp(x - max(logs)) for x in logs), abs=1e-6)
    assert len(asked) > 40


def test_unlabelled_texts_stay(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in language.keep_known(df).collect()] == [1]


def test_siblings_are_told_apart(spark):
    """Every whole notice gets its own label and none of its family: alone, in prose, and with a tenth of its words changed."""
    random.seed(4)
    prose = lambda n: " ".join(random.choice("lorem ipsum the of and is to in for this with any you may".split()) for _ in range(n))
    rows = []
    for label, text in licenses.NOTICES:
        words = text.split()
        for k in range(8):
            changed = list(words)
            for i in random.sample(range(len(words)), len(set(words)) // 10 if k > 1 else 0):
                changed[i] = f"zz{i}"
            one = " ".join(changed)
            rows.append((len(rows), label, one if k % 2 else f"{prose(300)} {one} {prose(450)}"))
    df = spark.createDataFrame(rows, "doc_id long, want string, text string")
    confusion = {}
    for r in licenses.license_matches(df).collect():
        want = rows[r["doc_id"]][1]
        for b in {x["label"] for x in r["blocks"]}:
            confusion[want, b] = confusion.get((want, b), 0) + 1
    assert confusion == {(label, label): 8 for label, _ in licenses.NOTICES}
    both = " ".join(t for n, t in licenses.NOTICES if n in ("bsd-2-clause", "bsd-3-clause"))
    found = licenses.license_matches(spark.createDataFrame([(1, both), (2, dict(licenses.NOTICES)["gpl-2.0"] + " " + prose(900) + " " + dict(licenses.NOTICES)["gpl-3.0"])], "doc_id long, text string")).collect()
    assert {r["doc_id"]: {x["label"] for x in r["blocks"]} for r in found} == {1: {"bsd-3-clause"}, 2: {"gpl-2.0", "gpl-3.0"}}


def test_packing_keeps_words_for_the_next_task(monkeypatch):
    from tesserae.llm import packing

    tool, asked = packing.WordEncoder(packing.vocabulary_path()), []
    plainly = tool.memo.make
    monkeypatch.setattr(tool.memo, "make", lambda words: asked.extend(words) or plainly(words))
    texts = pa.array(["one two one", "two  THREE"])
    first = tool.encode(texts)
    tool.rest()
    again = tool.encode(texts)
    assert sorted(asked) == ["", "one", "three", "two"] and all((a == b).all() for a, b in zip(first, again))
    monkeypatch.setattr(packing, "KEPT_CHARS", 10)
    tool.rest()
    assert not tool.memo.place


def test_a_memo_holds_strings_as_one_array_of_bounded_bytes():
    from tesserae.llm import _arrow

    asked = []
    memo = _arrow.Memo(lambda words: asked.append(len(words)) or [[len(w), int(w[:9])] for w in words], 20_000, 200_000)
    for lot in (range(9000), range(5000, 12_000), [7] * 3, range(12_000, 30_000), []):
        words = pa.array([str(n) for n in lot], pa.string())
        flat, ends = memo.get(words)
        assert flat.tolist() == [x for n in lot for x in (len(str(n)), n)] and ends.tolist() == list(range(0, 2 * len(lot) + 1, 2))
        assert isinstance(memo.place, pa.Array) and len(memo.place) <= 20_000 and memo.place.nbytes <= 200_000
    assert max(asked) == _arrow.MAKE_ITEMS and sum(asked) == 30_000
    memo.get(pa.array(["1" * 300_000]))
    assert len(memo.place) == 1  # one slice alone may be larger


def test_packing_encodes_small_slices():
    from tesserae.llm import _arrow

    batch = pa.record_batch([pa.array(range(5)), pa.array(["x" * 40, "", "y" * 70, "z" * 500, "w"])], ["doc_id", "text"])
    assert [part.num_rows for part in _arrow.slices(batch, 1, 100)] == [2, 1, 1, 1]
    assert [part.num_rows for part in _arrow.slices(batch, 1)] == [5]
