"""Language ID by segmentation-marginalised unigrams.

Pieces are the entries of a fixed public vocabulary of at most `PIECE_BYTES` bytes, and all single bytes. For
every language there is a probability for each piece, and a word's probability is the sum over all its
segmentations into pieces of the product of their probabilities: a forward pass over its bytes. Words are runs
of letters in lower case (ASCII letters and everything beyond ASCII), each with a space before it; no piece spans
words, so a text's log probability is the sum over its words, and equal words are scored once.

Piece probabilities are fitted by expectation maximisation on word counts of a bounded sample of labelled rows:
about `SAMPLE_ROWS` distinct texts for each language, however often each occurs, chosen by a hash of text and
language. Everything else covers all rows.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text when nothing
could be learned; there is a model of every label that occurs, so labels must be few enough for one; of equally probable languages the first by name is predicted; repeated rows are scored one by
one; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import _arrow
from tesserae.session import table

UNKNOWN = "und"
PIECE_BYTES, SAMPLE_ROWS, ROUNDS, SMOOTHING = 5, 200, 3, 0.1
#: Least log probability a byte in the best language, and most that a word gains on average if each takes its own best
#: language, of a text that is kept. On sf0.01, texts of 50 words or more in one learned language have -2.12 or more, and
#: nearly all 0.4 or less; unlearned languages -2.75 and less; half of one language and half of another 3.5 and more.
LEAST_FIT, MOST_MIXED = -2.6, 1.5
#: Word probabilities kept in a worker's memo before it starts afresh.
MEMO_WORDS = 400_000

_BYTE = np.arange(256)
_WORD_BYTE = (_BYTE >= 128) | ((_BYTE >= 97) & (_BYTE <= 122))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def piece_keys(path: str, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
    """Sorted keys of the pieces: their bytes after a leading 1, as one number."""
    words = {bytes([b]) for b in range(256)}
    with open(path, "rb") as f:
        words.update(w for w in (base64.b64decode(line.split()[0]) for line in f if line.strip()) if len(w) <= piece_bytes)
    return np.sort(np.fromiter((int.from_bytes(b"\1" + w, "big") for w in words), np.int64, len(words)))


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (with the space before each), and each text's bounds in that list."""
    flat, offsets = _arrow.text_bytes(pc.utf8_lower(texts))
    letter = _WORD_BYTE[flat]
    inner = offsets[offsets < len(flat)]
    first = np.zeros(len(flat), bool)
    first[inner] = True
    starts = np.flatnonzero(letter & (first | ~np.concatenate([[False], letter[:-1]])))
    ends = np.flatnonzero(letter & np.concatenate([first[1:] | ~letter[1:], [True]])) + 1 if len(flat) else starts
    lengths = ends - starts + 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    index = _arrow.ragged(starts - 1, lengths)
    data = flat[np.maximum(index, 0)] if len(flat) else flat
    data = data.copy()
    data[bounds[:-1]] = 32
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.searchsorted(starts, offsets)


def lattice(block: np.ndarray, keys: np.ndarray, piece_bytes: int) -> np.ndarray:
    """For words of one length, [word, end, size - 1] -> piece that ends there, or len(keys) for none."""
    n, width = block.shape
    found = np.full((n, width, piece_bytes), len(keys), np.int32)
    key = np.ones((n, width), np.int64)
    for size in range(1, min(piece_bytes, width) + 1):
        # key[:, i]: the bytes from i on
        key = key[:, : width - size + 1] * 256 + block[:, size - 1 :]
        at = np.searchsorted(keys, key.ravel())
        hit = keys[np.minimum(at, len(keys) - 1)] == key.ravel()
        found[:, size - 1 :, size - 1] = np.where(hit, at, len(keys)).reshape(key.shape)
    return found


def by_length(words: list[bytes], most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes) of words of one length, in blocks of about `most` bytes."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        width = int(lengths[order[at]])
        to = min(int(np.searchsorted(lengths[order], width, side="right")), at + max(1, most // width))
        places = order[at:to]
        yield places, np.frombuffer(b"".join(words[i] for i in places), np.uint8).reshape(-1, width)
        at = to


def forward(found: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(log sum over segmentations, the scaled sums before each byte, the log of their scale), per word and language.

    Sums are scaled at every byte, so that no word is long enough to underflow.
    """
    n, width, sizes = found.shape
    sums = [np.ones((n, prob.shape[1]))]
    scale = np.zeros((n, prob.shape[1]))
    scales = [scale]
    for end in range(width):
        total = np.zeros_like(scale)
        for size in range(1, min(sizes, end + 1) + 1):
            before = end + 1 - size
            total += sums[before] * np.exp(scales[before] - scales[end]) * prob[found[:, end, size - 1]]
        sums.append(np.ones_like(total))
        scales.append(scales[end] + np.log(total))
    return scales[-1], sums, np.stack(scales)


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray
    prob: np.ndarray  # [piece, language]; the last row, for no piece, is 0
    piece_bytes: int = PIECE_BYTES
    memo: dict = field(default_factory=dict, repr=False)
    known: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "known": None}

    def score_words(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(words), len(self.languages)))
        for places, block in by_length(words):
            found = lattice(block, self.keys, self.piece_bytes)
            n, width, sizes = found.shape
            # sums of the last few ends only, in a ring; rescaled now and then
            ring = np.zeros((sizes, n, len(self.languages)))
            ring[0] = 1
            log = np.zeros((n, len(self.languages)))
            for end in range(width):
                total = np.zeros_like(log)
                for size in range(1, min(sizes, end + 1) + 1):
                    total += ring[(end + 1 - size) % sizes] * self.prob[found[:, end, size - 1]]
                ring[(end + 1) % sizes] = total
                if end % 16 == 15:
                    ring /= total
                    log += np.log(total)
            out[places] = log + np.log(ring[width % sizes])
        return out

    def score_texts(self, texts: pa.Array, freely: bool = False) -> np.ndarray:
        """Log probability of each text in each language; `freely`, one column more where each word takes its best language."""
        words, at = words_in(texts)
        out = np.zeros((len(texts), len(self.languages) + freely))
        if not len(words):
            return out
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo, self.known, new = {}, None, distinct
        if new:
            n = len(self.memo)
            self.memo.update((w, n + i) for i, w in enumerate(new))
            scores = self.score_words(new)
            self.known = scores if self.known is None else np.concatenate([self.known, scores])
        place = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))
        scores = self.known[place]
        if freely:
            scores = np.concatenate([scores, scores.max(axis=1, keepdims=True)], axis=1)
        scores = scores[coded.indices.to_numpy()]
        some = at[1:] > at[:-1]
        out[some] = np.add.reduceat(scores, at[:-1][some])
        return out

    def told(self, texts: pa.Array, least_fit: float, most_mixed: float) -> np.ndarray:
        """Whether each text fits its best language, and has few words that fit another one better; by byte and word, so whatever its length."""
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return lettered
        words, at = words_in(texts)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
        n, size = np.maximum(np.diff(at), 1), np.maximum(np.diff(ends[at]), 1)
        logs = self.score_texts(texts, freely=True)
        best = logs[:, :-1].max(axis=1)
        return lettered & (best / size >= least_fit) & ((logs[:, -1] - best) / n <= most_mixed)

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        logs = self.score_texts(texts)
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if x else UNKNOWN for b, x in zip(best, lettered)], np.where(lettered, share, 0.0).tolist()


def fit(counts: dict[str, dict[bytes, int]], path: str, piece_bytes: int = PIECE_BYTES, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation: expected uses of each piece over all segmentations of the counted words."""
    languages, keys = sorted(counts), piece_keys(path, piece_bytes)
    prob = np.zeros((len(keys) + 1, len(languages)))
    for k, language in enumerate(languages):
        words = list(counts[language])
        weights = np.array([counts[language][w] for w in words], float)
        p = np.append(np.full(len(keys), 1 / len(keys)), 0.0)[:, None]
        blocks = [(places, lattice(block, keys, piece_bytes)) for places, block in by_length(words)]
        for _ in range(rounds):
            used = np.zeros(len(keys) + 1)
            for places, found in blocks:
                n, width, sizes = found.shape
                whole, _, before = forward(found, p)
                # the same from the end: in reversed words, a piece of some size ends where it began
                turned = np.full_like(found, len(keys))
                for size in range(1, min(sizes, width) + 1):
                    turned[:, size - 1 :, size - 1] = found[:, size - 1 :, size - 1][:, ::-1]
                _, _, after = forward(turned, p)
                for size in range(1, min(sizes, width) + 1):
                    at = found[:, size - 1 :, size - 1]
                    logs = before[: width - size + 1, :, 0].T + after[: width - size + 1, :, 0].T[:, ::-1] - whole
                    share = weights[places][:, None] * p[at, 0] * np.exp(logs)
                    used += np.bincount(at.ravel(), share.ravel(), len(keys) + 1)
            used[-1] = 0
            p = np.append((used[:-1] + SMOOTHING) / (used[:-1] + SMOOTHING).sum(), 0.0)[:, None]
        prob[:, k] = p[:, 0]
    return Model(languages, keys, prob, piece_bytes)


def sample_counts(df: DataFrame, text: str, lang: str, rows: int) -> dict[str, dict[bytes, int]]:
    """Word counts by language of about `rows` distinct labelled texts each, chosen by a hash of text and language."""
    code = F.xxhash64(text, lang)
    # copies are drawn or left together, so that the rate goes by distinct texts
    totals = {r[0]: r[1] for r in df.groupBy(lang).agg(F.countDistinct(code)).collect()}
    if not totals:
        return {}
    draw = F.pmod(code, F.lit(2**31)) / 2.0**31
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, rows / n))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in _arrow.slices(batch, 1):
                words, at = words_in(part.column(1))
                owner = np.repeat(np.arange(part.num_rows), np.diff(at))
                langs = part.column(0).to_pylist()
                total.update((langs[o], w) for o, w in zip(owner.tolist(), words.to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total], pa.binary()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "n"])

    # once each is enough, and keeps one large group of copies from being the sample
    drawn = df.filter(draw < F.element_at(share, F.col(lang))).select(lang, text).distinct()
    out: dict[str, dict[bytes, int]] = {k: {} for k in totals}
    for r in drawn.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["lang"]][bytes(r["word"])] = r["n"]
    return out


def train(df: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, path: str | None = None) -> Model:
    labelled = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return fit(sample_counts(labelled.select(text, lang), text, lang, rows), path or vocabulary_path())


def predictions(df: DataFrame, model: Model, keep: list[str], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The kept columns with the predicted language and its score. The model (a few numbers per vocabulary piece) goes along with the function."""
    asked = df.select(*keep) if text in keep else df.select(*keep, text)
    place = asked.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, place):
                found, scores = model.predict(part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*keep, pred, score])
        model.memo, model.known = {}, None
        _arrow.release()

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return asked.mapInArrow(run, f"{kept}, `{pred}` string, `{score}` double")


def keep_known(df: DataFrame, text: str = "text", lang: str = "lang", least_fit: float = LEAST_FIT, most_mixed: float = MOST_MIXED) -> DataFrame:
    """The rows whose text is in one of the languages learned from the labelled rows of `df`, and in one only.

    Letter junk and languages that were not learned fit badly a byte; texts of several languages have words that fit another language far better.
    Where no row is labelled nothing can be told, and all texts with a letter stay.
    """
    model, place = train(df, text, lang), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, place):
                yield part.filter(pa.array(model.told(part.column(place), least_fit, most_mixed)))
        model.memo, model.known = {}, None
        _arrow.release()

    return df.mapInArrow(run, df.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = predictions(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
