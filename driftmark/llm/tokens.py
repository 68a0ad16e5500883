"""Encoding with a public byte-level BPE vocabulary, run by sentencepiece (problem 6).

A sentencepiece BPE model is serialised directly from the rank file: one piece per token, its bytes
mapped to printable characters, its score the negative rank, so that merging by best score is merging
by lowest rank; identity normalisation, no dummy prefix, blanks untouched. Piece i has id i. One
unknown piece follows as the format demands; no text reaches it, since all 256 bytes are pieces.
Texts are split by the vocabulary's pre-token pattern; each pre-token is encoded on its own, and a
memo holds the ids of those seen by the task. Decoding is the inverse mapping of bytes.

Defined ids: an empty text has an empty list of ids, and so has a null text.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.runtime import ship

#: Entries of a task's memo of pre-tokens; when full it is begun anew, which changes no result.
MEMO_SIZE = 400_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k as ranks; ``DRIFTMARK_TOKENIZERS`` names another folder."""
    folder = os.environ.get("DRIFTMARK_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


#: Splits a text into pre-tokens before any merge; fixed by the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value % (1 << 64))


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _flag(3, kind))


def printable_bytes() -> list[str]:
    """Byte b stands as character [b]: itself if it prints, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks aren't consecutive")
    return [t for _, t in pairs]


def bpe_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece i is token i."""
    shown = printable_bytes()
    out = [_piece("".join(shown[b] for b in t), -float(i), 1) for i, t in enumerate(tokens)]
    out.append(_piece("<unk>", 0.0, 2))
    n = len(tokens)
    out.append(_block(2, _flag(3, 2) + _flag(4, n + 1) + _flag(40, n) + _flag(41, -1) + _flag(42, -1) + _flag(43, -1)))
    out.append(_block(3, _block(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder; one per Python worker and vocabulary."""

    _held: dict[str, ByteBpe] = {}

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self._sp = sentencepiece.SentencePieceProcessor(model_proto=bpe_model(self.tokens))
        self._split = regex.compile(PATTERN).findall
        self._table = dict(enumerate(printable_bytes()))
        self._memo: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self._memo]
        if not new:
            return
        if len(self._memo) + len(new) > MEMO_SIZE:
            self._memo.clear()
            new = list(words)
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._table) for w in new]
        self._memo.update(zip(new, self._sp.encode(mapped, num_threads=1)))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self._split(t) if t else [] for t in texts]
        self._learn({w for ws in split for w in ws})
        memo = self._memo
        return [[i for w in ws for i in memo[w]] for ws in split]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        split = [self._split(t) if t else [] for t in texts]
        self._learn({w for ws in split for w in ws})
        memo = self._memo
        return [sum(len(memo[w]) for w in ws) for ws in split]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


#: Rows a batch is cut into before encoding, so that a batch of long texts stays small.
SLICE = 256


def _slices(batches: Iterator, text_at: int) -> Iterator:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, part.column(text_at).to_pylist()


def with_ids(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """``id_col`` and ``ids``, the token ids of the whole text; no special tokens, whatever the text holds.

    Null and empty texts get an empty list. Repeated rows come out as often as they come in; a null
    id stays null. Very long texts are encoded whole. Other columns aren't read. One narrow pass.
    """
    path = vocabulary or default_vocabulary()
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def encode(batches):
        import pyarrow as pa

        bpe = ByteBpe.of(path)
        for part, texts in _slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.encode_batch(texts), pa.list_(pa.int32()))], ["id", "ids"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def with_text(df: DataFrame, id_col: str, ids_col: str, vocabulary: str | None = None) -> DataFrame:
    """The inverse of ``with_ids``: ``id_col`` and ``text``. A null list decodes to null, an empty one to ''."""
    path = vocabulary or default_vocabulary()
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def decode(batches):
        import pyarrow as pa

        bpe = ByteBpe.of(path)
        for part, lists in _slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else bpe.decode(x) for x in lists], pa.string())], ["id", "text"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)


def with_counts(df: DataFrame, keep: list[str], text_col: str, vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of the text; 0 for null and empty texts."""
    path = vocabulary or default_vocabulary()
    ship(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text"))
    schema = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", n_tokens bigint"
    n = len(keep)

    def count(batches):
        import pyarrow as pa

        bpe = ByteBpe.of(path)
        for part, texts in _slices(batches, n):
            cols = [part.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bpe.count_batch(texts), pa.int64())], [*(f"c{i}" for i in range(n)), "n_tokens"])

    out = rows.mapInArrow(count, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")
