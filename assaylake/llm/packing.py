"""Cost-balanced packing of documents into token sequences.

A document is cut at multiples of the sequence length; its full pieces are sequences of their own. The rests
are dealt by hash and packed window by window: longest first, each into the sequence of least attention cost
(linear plus quadratic in the piece) that still has room for it, or, where none has, cut to fill the cheapest
one. What is left at the end of a window is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm._common import partitions, slices

SEQUENCE_TOKENS = 1024
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Rests that are packed together.
WINDOW_PIECES = 2048
#: Texts that are encoded at a time.
TEXTS = 64
END_ID = 0


#: The pattern of byte-level files takes a step of the stack for each character of white space, so long runs are cut out first.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class TextEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Where the ids of the file follow its merges, as they mostly do, tiktoken merges by the same table, several times as
    fast and without a memory of words that grows, at any length of words and of white space; any other file is left to the library. The file's added tokens, as ``<|endoftext|>``, get
    their own ids wherever they stand in a text.
    """

    _made: dict[str, TextEncoder] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"]: t for t in spec.get("added_tokens", ())}
        self.added = {content: np.array([t["id"]], dtype="<u4") for content, t in added.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.plain = self._merger(spec, added) or self._library(path, any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added.values()))

    def _library(self, path: str, whole: bool) -> Callable[[str], np.ndarray]:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        if whole:  # added tokens that look at what stands beside them
            self.parts = None
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _merger(self, spec: dict, added: dict[str, dict]) -> Callable[[str], np.ndarray] | None:
        import tiktoken
        from public_tokenizers import PATTERN

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        usual = model["type"] == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]] if usual else []
        vocabulary = {word: i for word, i in model["vocab"].items() if word not in added}
        in_order = all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(vocabulary) == 256 + len(merges)
        if not usual or not in_order or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added.values()):
            return None
        byte = {letter: b for b, letter in byte_letters().items()}
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items()}
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        piece = tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            ids: list[int] = []
            at = 0
            for run in _LONG_SPACE.finditer(text):
                # the last one of a run belongs to what follows, if anything does; the others are a piece of their own
                stop = run.end() - (run.end() < len(text))
                ids += encoding.encode_ordinary(text[at : run.start()]) + piece.encode_ordinary(text[run.start() : stop])
                at = stop
            return np.array(ids + encoding.encode_ordinary(text[at:]), dtype="<u4")

        return encode

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __call__(self, text: str) -> np.ndarray:
        """The ids that the library gives a text: added tokens first, then what lies between them."""
        parts = self.parts(text) if self.parts else [text]
        if len(parts) == 1:
            return self.plain(text)
        return np.concatenate([self.added[p] if i % 2 else self.plain(p) for i, p in enumerate(parts)])


def default_tokenizer() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


_RESTS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """The full pieces of each document, without their ids, and its rest with its ids."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextEncoder.of(path)
        end = np.array([END_ID], dtype="<u4")
        for batch in slices(batches, TEXTS):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), end])
                for start in range(0, len(ids), sequence_tokens):
                    piece = ids[start : start + sequence_tokens]
                    data = piece.tobytes()
                    rest = len(piece) < sequence_tokens
                    rows.append((doc, start, len(piece), zlib.crc32(data), len(ids), (piece.astype("<u2").tobytes() if piece.max() < 65_536 else b"\0" + data) if rest else None))
            columns = zip(*rows, strict=True)
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _RESTS)


def _ids(data: bytes) -> np.ndarray:
    """Rests hold 16-bit ids; an odd number of bytes marks 32-bit ids after a zero byte."""
    return np.frombuffer(data[1:], dtype="<u4") if len(data) % 2 else np.frombuffer(data, dtype="<u2").astype("<u4")


def pack_window(lengths: list[int], capacity: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces into as many full sequences as they fill, and the remainder into sequences of powers of two.

    :return: (piece, start in the piece, tokens, sequence, offset), sequences counted from 0.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    full = sum(lengths) // capacity
    cost, room = np.zeros(full), np.full(full, capacity)
    placed, left = [], []

    def put(i: int, start: int, tokens: int, k: int) -> None:
        placed.append((i, start, tokens, k, capacity - int(room[k])))
        room[k] -= tokens
        cost[k] += LINEAR * tokens + QUADRATIC * tokens * tokens

    for i in order:
        start, tokens = 0, lengths[i]
        fits = room >= tokens
        if fits.any():
            put(i, 0, tokens, int(np.argmin(np.where(fits, cost, np.inf))))
            continue
        while tokens and room.any():
            k = int(np.argmin(np.where(room > 0, cost, np.inf)))
            part = min(tokens, int(room[k]))
            put(i, start, part, k)
            start, tokens = start + part, tokens - part
        if tokens:
            left.append((i, start, tokens))
    tail, k = sum(t for _, _, t in left), full
    sizes = [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    offset = 0
    for i, start, tokens in left:
        while tokens:
            part = min(tokens, sizes[k - full] - offset)
            placed.append((i, start, part, k, offset))
            start, tokens, offset = start + part, tokens - part, offset + part
            if offset == sizes[k - full]:
                k, offset = k + 1, 0
    return placed


def _pack_partition(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    sequence = TaskContext.get().partitionId() << 40
    window: list[dict] = []

    def flush() -> list[tuple]:
        nonlocal sequence
        out, most = [], -1
        for i, start, tokens, k, offset in pack_window([r["length"] for r in window], capacity):
            r = window[i]
            crc = r["ids_crc32"] if tokens == r["length"] else zlib.crc32(_ids(r["ids"])[start : start + tokens].tobytes())
            out.append((r["doc_id"], r["start"] + start, tokens, crc, r["doc_tokens"], sequence + k, offset))
            most = max(most, k)
        sequence += most + 1
        window.clear()
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        rows: list[tuple] = []
        for r in batch.to_pylist():
            if r["ids"] is None:
                rows.append((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], sequence, 0))
                sequence += 1
                continue
            window.append(r)
            if len(window) == WINDOW_PIECES:
                rows += flush()
        if rows:
            yield batch_of(rows)
    if window:
        yield batch_of(flush())


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """The pieces of all documents and their places in the sequences.

    :return: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A null or empty text has one token, the end. Repeated rows and null ids are documents of their own. Long
    texts give as many pieces as they need. An empty table gives no piece. A window holds a fixed number of
    rests, so memory does not depend on the size of a partition. Rows are packed in the order of their ids, so
    a task that runs again, or another partitioning of ``docs``, gives the same sequences.
    """
    cut = cut_documents(docs, tokenizer, id_col, text_col, sequence_tokens)
    dealt = cut.repartition(partitions(docs.sparkSession), F.xxhash64("doc_id", "start", "ids_crc32")).sortWithinPartitions("doc_id", "start", "ids_crc32", "doc_tokens")
    return dealt.mapInArrow(lambda batches: _pack_partition(batches, sequence_tokens), _PIECES)
