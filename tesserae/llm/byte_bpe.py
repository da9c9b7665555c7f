"""Byte-level BPE with the tokenizers library over Arrow batches, and its way back.

Texts are cut where the vocabulary's pattern always ends a match (before a space between two non-blanks, and
before ASCII punctuation after a letter or digit), equal chunks of a slice are encoded once, and a bounded memo
keeps what a worker has encoded. Cuts never change ids: no match spans them, and BPE stays within a match.

An id stands for some bytes, not characters: offsets come from the lengths of the ids' bytes, mapped to characters
by counting bytes that begin one. Decoding looks the bytes up in the inverse byte table; a character split
over ids is whole again once the bytes are joined, and `decode_stream` holds back its first bytes until then.

Defined results: a null or empty text has no ids and decodes to no bytes; special-token strings in a text are
ordinary text; repeated rows are encoded one by one; an empty table gives an empty table; only the id and text
columns are read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import _arrow
from tesserae.session import table

#: The public vocabulary: a file for the tokenizers library, and the same as ranks.
NAME = "byte_bpe_50k"


def vocabulary_paths(name: str = NAME) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


@lru_cache(maxsize=4)
def byte_table(ranks_path: str) -> list[bytes]:
    """The bytes of every id."""
    with open(ranks_path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    made = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for word, rank in pairs:
        made[int(rank)] = base64.b64decode(word)
    return made


class Encoder:
    """Ids and byte lengths of texts; one per worker process and vocabulary."""

    def __init__(self, json_path: str, ranks_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        self.tokenizer.encode_special_tokens = True
        self.table = byte_table(ranks_path)
        self.widths = np.fromiter(map(len, self.table), np.int64, len(self.table))
        self.memo = _arrow.Memo(self._ids)

    def _ids(self, chunks: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each text's bounds within them."""
        flat, offsets = _arrow.text_bytes(texts)
        chunks, at = _arrow.cut(flat, offsets, _arrow.single_spaces(flat) | _arrow.before_punctuation(flat))
        ids, ends = self.memo.get(chunks)
        return ids, ends[at]

    def char_offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The first character of each id: that in which its first byte lies."""
        raw = np.frombuffer(text.encode(), np.uint8)
        begun = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts = np.cumsum(self.widths[ids]) - self.widths[ids]
        return begun[starts] if len(ids) else starts

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def decode_stream(ids: Iterable[int], table: list[bytes]) -> Iterator[str]:
    """Text as ids arrive; the bytes of a character that is not complete yet are held back."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield reader.decode(table[i])
    yield reader.decode(b"", True)


def encode_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", offsets: bool = False, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, ids[, char_starts]) of every text."""
    paths = paths or vocabulary_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(*paths)
        for batch in batches:
            for part in _arrow.slices(batch, 1):
                ids, ends = tool.encode(part.column(1))
                made = [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
                if offsets:
                    texts = part.column(1).to_pylist()
                    starts = [tool.char_offsets(t or "", ids[a:b]) for t, a, b in zip(texts, ends, ends[1:])]
                    made.append(pa.array([s.tolist() for s in starts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "ids", "char_starts"][: len(made)])
        tool.memo.clear()
        _arrow.release()

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", char_starts array<long>" * offsets)


def decode_ids(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, decoded binary) of every list of ids; null lists decode to no bytes."""
    ranks = (paths or vocabulary_paths())[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_table(ranks)
        for batch in batches:
            raw = [b"".join(map(words.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return df.select(doc_id, ids).mapInArrow(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, decoded binary")


def digests(df: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Encode and decode in one pass, keeping digests only."""
    paths = paths or vocabulary_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(*paths)
        for batch in batches:
            for part in _arrow.slices(batch, 1):
                ids, ends = tool.encode(part.column(1))
                lists = [ids[a:b] for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists]),
                        pa.array([hashlib.sha256(tool.decode(x.tolist())).hexdigest() for x in lists]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        tool.memo.clear()
        _arrow.release()

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
