"""Conversation tries, filter audits and repeated windows against plain versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import filter_audit, prefix_trie, substring_dedup
from tesserae.llm._running import running
from tesserae.llm.fm_index import FmIndex


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# ---- running sums


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_sums_span_partitions(spark, parts, monkeypatch):
    random.seed(parts)
    rows = [(random.choice([1, 1, 1, 1, 2, 3, 9]), i, random.randint(-(2**62), 2**62)) for i in range(400)]
    df = spark.createDataFrame(random.sample(rows, len(rows)), "g long, i long, v long")
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, *c, f=type(df).repartitionByRange: f(self, parts, *c))
    want, state = [], defaultdict(int)
    for g, i, v in sorted(rows):
        before, state[g] = state[g], (state[g] + v + 2**63) % 2**64 - 2**63
        want.append((g, i, state[g], before))
    assert rows_of(running(df, ["g"], ["i"], {"total": "v"}, {"less": "total"}), "g", "i", "total", "less") == want
    assert running(df.limit(0), ["g"], ["i"], {"total": "v"}).count() == 0


# ---- conversation tries


def plain_trie(turns):
    told = defaultdict(list)
    for c, turn, role, text in sorted(turns, key=lambda r: (r[0] is None, r[0] or 0, -1 if r[1] is None else r[1])):
        if c is not None:
            told[c].append((role or "", text or ""))
    built = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(told.get(c - c % 100, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, who in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(who) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (who[0], len(k), members[k[:-1]][0] if k else None, len(who), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, who in members.items()
    )


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(seed):
    random.seed(seed)
    rows = []
    for c in random.sample(range(420), 160):
        for turn in random.sample(range(9), random.randint(1, 7)):
            rows.append((c, turn, random.choice(["user", "user", "assistant", None]), random.choice(["a", "a", "a", "bb", "", None, "é𝄞"]), c, 1, 2))
    rows += [(500 + 100 * k, t, "user", f"x{t}", 0, 0, 0) for k in range(30) for t in range(3)]
    return rows + [(c, None, "system", "first", 0, 0, 0) for c in (3, 205, 500)] + [(None, 1, "user", "of none", 0, 0, 0)]


CONVERSATIONS = "conv_id long, turn long, role string, text string, k0 long, depth long, place long"


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_a_plain_one(spark, seed):
    rows = conversations(seed)
    found = prefix_trie.nodes_of(spark.createDataFrame(rows, CONVERSATIONS).repartition(5))
    assert rows_of(found.fillna(-1, ["parent_conv_id"]), *TRIE) == sorted(tuple(-1 if x is None else x for x in r) for r in plain_trie([r[:4] for r in rows]))


def test_trie_edges(spark):
    df = spark.createDataFrame(conversations(1), CONVERSATIONS)
    assert prefix_trie.nodes_of(df.limit(0)).count() == 0
    # one conversation of many turns, repeated rows, and one that has no turns left once its first are replaced
    long_one = [(0, t, "user", f"t{t % 7}", 0, 0, 0) for t in range(700)] + [(0, 700, "user", "twice", 0, 0, 0)] * 2
    gone = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = long_one + [(gone, 1, "user", "only", 0, 0, 0)]
    found = prefix_trie.nodes_of(spark.createDataFrame(rows, CONVERSATIONS)).fillna(-1, ["parent_conv_id"])
    want = sorted(tuple(-1 if x is None else x for x in r) for r in plain_trie([r[:4] for r in rows]))
    assert rows_of(found, *TRIE) == want
    assert [r for r in want if r[1] == 0][0][7] == hashlib.sha256(str(gone).encode()).hexdigest()


def test_trie_of_a_deep_comb(spark):
    """A light child at every node of a long path: as many paths as nodes, and few rounds."""
    rows = [(100 * c, t, "user", "s" if t < c else f"e{c}", 0, 0, 0) for c in range(1, 40) for t in range(c + 1)]
    found = prefix_trie.nodes_of(spark.createDataFrame(rows, CONVERSATIONS)).fillna(-1, ["parent_conv_id"])
    assert rows_of(found, *TRIE) == sorted(tuple(-1 if x is None else x for x in r) for r in plain_trie([r[:4] for r in rows]))


# ---- filter audits


def plain_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    failing = []
    for d, text, lang in docs:
        text = text or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text) + "E" * (d is not None and least[text] < d)
        failing.append((lang or "", fails, d in good, d in toxic))
    out = []
    for part in {f[0] for f in failing}:
        own, sums, rows = [f for f in failing if f[0] == part], Counter(), []
        for run in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(run):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                sums[f] += len(gone)
                rows.append((part, run, k + 1, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == f for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        out += [(*r[:-1], sums[r[-1]]) for r in rows]
    return sorted(out)


def test_audit_equals_plain_counts(spark, monkeypatch):
    random.seed(5)
    texts = ["", None, "a b", "A B C " * 90, "word " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(260)) + " $", "\t\n", " ".join(f"Ab{i}" for i in range(300)) + " |", "x" * 9000]
    docs = [(i if i % 17 else None, random.choice(texts), random.choice(["en", "de", "", None]), 1, 2, "x") for i in range(220)] + [(5, "a b", "en", 1, 2, "x")] * 3
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, part long, failures int, digest string").repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ("part", "filter_order", "step", *filter_audit.MEASURES)
    want = plain_audit([d[:3] for d in docs], labels)
    assert rows_of(filter_audit.audit(filter_audit.failures(df, marks)), *names) == want
    monkeypatch.setattr(filter_audit, "MOST_PARTS", 1)
    assert rows_of(filter_audit.audit(filter_audit.failures(df, marks)), *names) == want
    assert filter_audit.audit(filter_audit.failures(df.limit(0), marks.limit(0))).count() == 0


def test_first_failures():
    table = filter_audit.first_failure(5)
    assert table.shape == (32, 120)
    for mask, (k, run) in itertools.product(range(32), enumerate(itertools.permutations(range(5)))):
        assert table[mask, k] == next((s for s, f in enumerate(run) if mask >> f & 1), 5)


# ---- full-text index


def test_matching_statistics_equal_plain_ones():
    rng = np.random.default_rng(1)
    for _ in range(150):
        cap, symbols = int(rng.integers(1, 7)), int(rng.integers(1, 5))
        kept = [rng.integers(0, symbols, rng.integers(0, 14)).astype(np.uint64) for _ in range(rng.integers(0, 6))]
        asked = [rng.integers(0, symbols + 1, rng.integers(0, 14)).astype(np.uint64) for _ in range(4)]
        lengths = np.array([len(x) for x in kept], np.int64)
        index = FmIndex(np.concatenate([np.zeros(0, np.uint64), *kept]), lengths, cap)
        value = rng.integers(0, 50, int((lengths + 1).sum()))
        size, at = index.matches(np.concatenate(asked), np.array([len(x) for x in asked]))
        least, place, owned = index.least_by_class(value), 0, []
        for x in kept:
            owned += [(tuple(x[j:].tolist()), value[len(owned) + j]) for j in range(len(x) + 1)]
        for p in (tuple(x.tolist()) for x in asked):
            for i in range(len(p)):
                shared = [(next((l for l, (a, b) in enumerate(zip(p[i:], s)) if a != b), min(len(p) - i, len(s))), v) for s, v in owned]
                best = min(cap, max((l for l, _ in shared), default=0))
                assert size[place] == best
                if best == cap:
                    assert least[index.classes(at[place : place + 1])[0]] == min(v for l, v in shared if l >= cap)
                place += 1


# ---- repeated windows


def plain_removal(docs, window=50):
    words = [[w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w] for _, t in docs]
    least = {}
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - window + 1) if d is not None and least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


def passages(seed):
    random.seed(seed)
    some = lambda n: [random.choice(["the", "of", "é", "Zwölf", "x1", "y,", "𝄞"]) + str(random.randint(0, 60)) for _ in range(n)]
    shared = [some(n) for n in (49, 50, 51, 60, 120, 400)]
    docs = []
    for i in range(90):
        parts = [some(random.randint(0, 40)) if random.random() < 0.6 else random.choice(shared) for _ in range(random.randint(1, 6))]
        docs.append((i, random.choice([" ", "  ", "\n", "\t "]).join(w for p in parts for w in p)))
    docs += [(200 + i, docs[random.randint(0, 89)][1]) for i in range(30)] + [(300 + i, " ".join(["same"] * n)) for i, n in enumerate((49, 50, 51, 300, 1000))]
    docs += [(7, " ".join(shared[4])), (7, " ".join(shared[4] + ["more"])), (400, None), (401, ""), (402, " \n"), (None, docs[0][1]), (None, " ".join(shared[5])), (3, docs[3][1])]
    edited = docs[5][1].split()
    return docs + [(500 + i, " ".join(edited[:i] + ["edit"] + edited[i:])) for i in range(0, len(edited), 9)]


@pytest.mark.parametrize("seed,hot,block", [(1, 512, 200_000), (2, 3, 300), (3, 0, 100)])
def test_repeated_windows_equal_plain_removal(spark, monkeypatch, seed, hot, block):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    docs = passages(seed)
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, anchors int, low long, hot int").repartition(4)
    found = substring_dedup.remove_repeated(df).fillna(-1, ["doc_id"])
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_removal(docs)
    assert substring_dedup.remove_repeated(df.limit(0)).count() == 0


def test_a_passage_in_all_documents(spark, monkeypatch):
    """Every anchor of the passage is hot; what stands around it differs in each document."""
    monkeypatch.setattr(substring_dedup, "HOT", 20)
    random.seed(8)
    passage = [f"p{i}" for i in range(70)]
    docs = [(i, " ".join([f"a{random.random()}" for _ in range(i % 40)] + passage + [f"b{random.random()}" for _ in range(60 - i % 50)])) for i in range(150)]
    found = substring_dedup.remove_repeated(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_removal(docs)


def test_words_of_texts():
    words = substring_dedup.Words(pa.array(["a  bb", None, "", " c", "d\x0b", "é"]))
    assert [bytes(words.flat[a:b]).decode() for a, b in zip(words.starts, words.ends)] == ["a", "bb", "c", "d", "é"]
    assert words.at.tolist() == [0, 2, 2, 2, 3, 4, 5]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert words.digests(np.ones(5, bool)) == [sha(x) for x in ("a bb", "", "", "c", "d", "é")]
    assert words.digests(np.array([0, 1, 0, 0, 1], bool)) == [sha(x) for x in ("bb", "", "", "", "", "é")]
    assert substring_dedup.Words(pa.array([], pa.string())).digests(np.zeros(0, bool)) == []
