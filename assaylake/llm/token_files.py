"""Token files: ids of texts by a static range asymmetric numeral system.

One table of frequencies, counted over all ids and scaled to a power of two, serves all blocks. A block is coded by
interleaved lanes: id t goes to lane t mod lanes, every lane has a state of 64 bits, and all lanes move a step at a time in numpy.
The coder goes from the last step to the first and puts out 32-bit words where a state would overflow; at
every checkpoint it notes all states and its place among the words. A decoder starts at any checkpoint without reading what
precedes it, and here decodes all stretches of a block in one sweep, side by side.

A file is a range of documents in the order of their ids, its blocks rows of a Parquet table with their own head, checkpoints, index of documents and
checksums (of the head and of the words). A block is decoded without any other.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.llm._common import partitions, slices, stash

END_ID = 1
#: Frequencies add up to 2 ** SCALE_BITS; a table of more ids than half of that is refused.
SCALE_BITS = 20
#: Lanes of a block, and steps of all lanes between checkpoints; a block holds at most BLOCK_IDS ids.
LANES, CHECKPOINT_STEPS = 512, 128
BLOCK_IDS = 1 << 18
#: Texts that are read together, and characters of them.
TEXTS, TEXT_CHARS = 2048, 1 << 22
_MAGIC = b"ANSB"
_HEAD = struct.Struct("<4sIIIIIII")
_LEAST = np.uint64(1 << 31)
_32 = np.uint64(32)


class FileError(ValueError):
    """A block that is damaged or does not belong to the table of frequencies."""


class Frequencies:
    """Ids with frequencies that add up to 2 ** SCALE_BITS, each at least 1."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids = np.asarray(ids, dtype=np.uint32)[order]
        counts = np.asarray(counts, dtype=np.int64)[order]
        if 2 * len(ids) > 1 << SCALE_BITS:
            raise FileError(f"{len(ids)} different ids are too many for {SCALE_BITS} bits")
        room, total = (1 << SCALE_BITS) - len(ids), int(counts.sum())
        scaled = np.array([1 + int(c) * room // total for c in counts], dtype=np.int64)
        if len(ids):
            scaled[np.argmax(scaled)] += (1 << SCALE_BITS) - scaled.sum()  # what rounding down has left
        self._set(scaled)

    @classmethod
    def scaled(cls, ids: np.ndarray, frequencies: np.ndarray) -> Frequencies:
        """A table as it was written."""
        out = cls.__new__(cls)
        order = np.argsort(ids)
        out.ids = np.asarray(ids, dtype=np.uint32)[order]
        out._set(np.asarray(frequencies, dtype=np.int64)[order])
        return out

    def _set(self, scaled: np.ndarray) -> None:
        self.frequency = scaled.astype(np.uint64)
        self.begin = (np.cumsum(scaled) - scaled).astype(np.uint64)
        self.checksum = zlib.crc32(scaled.astype("<u4").tobytes(), zlib.crc32(self.ids.astype("<u4").tobytes()))
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """For each of the 2 ** SCALE_BITS slots the place of its id."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.frequency.astype(np.int64))
        return self._slots

    def places(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, ids)
        if len(ids) and (not len(self.ids) or at.max() >= len(self.ids) or not np.array_equal(self.ids[at], ids)):
            raise FileError("an id has no frequency")
        return at


def encode_ids(ids: np.ndarray, table: Frequencies, lanes: int = LANES, checkpoint_steps: int = CHECKPOINT_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and for each checkpoint, the first step included, the states of all lanes and the place of its first word."""
    places = table.places(ids)
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LEAST)
    out: list[np.ndarray] = []
    states: list[np.ndarray] = []
    after: list[int] = []  # words that the steps from the checkpoint on have put out
    written = 0
    room, scale = np.uint64(63 - SCALE_BITS), np.uint64(SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        at = places[step * lanes : (step + 1) * lanes]
        frequency, begin = table.frequency[at], table.begin[at]
        x = state[: len(at)]
        full = x >= frequency << room
        if full.any():
            words = x[full].astype(np.uint32)
            out.append(words)
            written += len(words)
            x[full] >>= _32
        quotient = x // frequency
        x[:] = (quotient << scale) + (x - quotient * frequency) + begin
        if step % checkpoint_steps == 0:
            states.append(state.copy())
            after.append(written)
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return words, np.array(states[::-1], dtype=np.uint64).reshape(-1, lanes), np.array([written - a for a in after[::-1]], dtype=np.int64)


def decode_ids(n: int, words: np.ndarray, states: np.ndarray, first_words: np.ndarray, table: Frequencies, checkpoint_steps: int = CHECKPOINT_STEPS) -> np.ndarray:
    """The ids of a block, all stretches between checkpoints side by side."""
    lanes = states.shape[1]
    out = np.zeros((len(states), checkpoint_steps, lanes), dtype=np.uint32)
    state, word = states.copy(), first_words.astype(np.int64).copy()
    slots, frequency, begin, ids = table.slots, table.frequency, table.begin, table.ids
    mask, scale = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    padded = np.concatenate([words.astype(np.uint64), np.zeros(lanes, np.uint64)])
    ids_before = np.arange(len(states))[:, None] * (checkpoint_steps * lanes) + np.arange(lanes)
    for step in range(min(checkpoint_steps, -(-n // lanes))):
        open_ = ids_before + step * lanes < n  # the last stretch may be short
        slot = state & mask
        at = slots[slot.astype(np.int64)]
        out[:, step] = ids[at]
        moved = frequency[at] * (state >> scale) + slot - begin[at]
        state = np.where(open_, moved, state)
        low = open_ & (state < _LEAST)
        rank = np.cumsum(low, axis=1)
        taken = padded[np.minimum(word[:, None] + rank - 1, len(padded) - 1)]
        state = np.where(low, (state << _32) | taken, state)
        word += rank[:, -1]
    if not np.array_equal(word, np.append(first_words[1:], len(words))) or not (state[-1] == _LEAST).all() or not np.array_equal(state[:-1], states[1:]):
        raise FileError("a stretch does not end where the next one begins")
    return out.reshape(-1)[:n]


def write_block(ids: np.ndarray, index: bytes, table: Frequencies) -> bytes:
    """A block: head, index, states, places of words, words."""
    lanes = max(1, min(LANES, len(ids) // 64))
    words, states, first = encode_ids(ids, table, lanes)
    body = states.astype("<u8").tobytes() + first.astype("<u4").tobytes() + words.astype("<u4").tobytes()
    head = _HEAD.pack(_MAGIC, table.checksum, len(ids), lanes, len(states), len(index), len(words), zlib.crc32(body))
    return head + struct.pack("<I", zlib.crc32(index, zlib.crc32(head))) + index + body


def read_block(data: bytes, table: Frequencies) -> tuple[np.ndarray, bytes]:
    """The ids of a block and its index."""
    if len(data) < _HEAD.size + 4 or data[:4] != _MAGIC:
        raise FileError("no block")
    _, checksum, n, lanes, checkpoints, index_bytes, n_words, body_sum = _HEAD.unpack_from(data)
    index = data[_HEAD.size + 4 : _HEAD.size + 4 + index_bytes]
    body = data[_HEAD.size + 4 + index_bytes :]
    if zlib.crc32(index, zlib.crc32(data[: _HEAD.size])) != struct.unpack_from("<I", data, _HEAD.size)[0] or zlib.crc32(body) != body_sum:
        raise FileError("a checksum is wrong")
    if checksum != table.checksum:
        raise FileError("the block has another table of frequencies")
    at = 8 * lanes * checkpoints
    states = np.frombuffer(body, "<u8", lanes * checkpoints).reshape(checkpoints, lanes)
    first = np.frombuffer(body, "<u4", checkpoints, at).astype(np.int64)
    words = np.frombuffer(body, "<u4", n_words, at + 4 * checkpoints)
    return (decode_ids(n, words, states, first, table) if n else np.zeros(0, np.uint32)), index


# A document's crc32 from those of its parts.
def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of crc32, bits reversed."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """The crc32 of two texts laid end to end."""
    power, square, left = 1 << 31, 1 << 23, second_bytes  # x ** (8 * bytes) by squares
    while left:
        if left & 1:
            power = _times(square, power)
        square, left = _times(square, square), left >> 1
    return _times(power, first) ^ second


#: Letters of which it is known how the library lower-cases and splits them: ASCII, Latin-1 and Latin Extended-A but for U+0130 and U+0149.
_PLAIN = re.compile("[\x00\x02-\xffĀ-įı-ňŊ-ſ]*")
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\x09-\x0d\x20\x85\xa0"
#: The pieces of the usual word file, which have its pattern's meaning for these letters.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+|\n")
_END = "\x01"


class WordEncoder:
    """Ids of texts by a file of the tokenizers library, without its special tokens.

    A file of the usual kind of word BPE (ends of words marked, lower case, white space dropped) is merged by tiktoken's engine, each
    different word of a group of texts once: the end mark is a letter of its own there, whose merges with the letter before come first. Texts with
    letters beyond Latin, with ``\\x01``, or with one of the file's added tokens, and any other kind of file, go to the library as they are.
    """

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.fast = self._merger(path)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _merger(self, path: str) -> Callable[[list[str]], list[np.ndarray]] | None:
        import json

        import tiktoken

        from assaylake.llm.packing import byte_letters

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], [t["content"] for t in spec.get("added_tokens", ())]
        kinds = lambda part: [x["type"] for x in (part or {}).get("normalizers", (part or {}).get("pretokenizers", []))]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        usual = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and kinds(spec.get("normalizer")) == ["NFC", "Replace", "Lowercase"] and kinds(spec.get("pre_tokenizer")) == ["Split", "ByteLevel"]
        if not usual or split.get("pattern") != {"Regex": pattern} or not split.get("invert") or split.get("behavior") != "Removed":
            return None
        byte = {letter: bytes([b]) for b, letter in byte_letters().items()}
        plain = lambda word: b"".join(byte[c] for c in word.removesuffix("</w>")) + (b"\x01" if word.endswith("</w>") else b"")
        try:
            vocabulary = {plain(w): i for w, i in model["vocab"].items() if w not in added}
            merged = [plain("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        except KeyError:
            return None
        letters = [bytes([b]) for b in range(256)]
        ends = [x + b"\x01" for x in letters if x != b"\x01"]
        # the library looks merges up by their order; tiktoken by the rank of what they make
        ranked = [*letters, *ends, *(m for m in merged)]
        if len(set(ranked)) != len(ranked) or any(x not in vocabulary for x in ranked if x != b"\x01" and x != b"\x01\x01"):
            return None
        ranks = {x: k for k, x in enumerate(ranked)}
        ids = np.array([vocabulary.get(x, 0) for x in ranked], dtype=np.uint32)
        end = _END.encode()
        engine = tiktoken.Encoding("words", pat_str=f"[^{_END}]*{_END}", mergeable_ranks=ranks, special_tokens={})

        gap = ranks[b"\n" + end]

        def encode(texts: list[str]) -> list[np.ndarray]:
            split = pc.ascii_split_whitespace(pa.array(texts, type=pa.large_string()))
            words, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy()
            places = words.indices.to_numpy()
            # each different word once, with its pieces, then a gap
            tokens = np.array(engine.encode_ordinary(_END.join(_PIECES.findall("\n".join([*words.dictionary.to_pylist(), ""]))) + _END), dtype=np.int32)
            stops = np.flatnonzero(tokens == gap)
            starts = np.concatenate([[0], stops[:-1] + 1])
            lengths, made = stops - starts[: len(stops)], ids[tokens]
            count = lengths[places]
            ends = np.cumsum(count)
            found = made[np.repeat(starts[places] - (ends - count), count) + np.arange(count.sum())]
            return np.split(found, np.concatenate([[0], ends])[bounds[1:-1]])

        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        return encode

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        simple: list[int] = []
        ready: list[str] = []
        if self.fast:
            for k, text in enumerate(texts):
                if self.added(text):
                    continue
                composed = text if text.isascii() else unicodedata.normalize("NFC", text)
                if _PLAIN.fullmatch(composed):
                    simple.append(k)
                    ready.append(composed.lower())
            for k, ids in zip(simple, self.fast(ready) if ready else [], strict=True):
                out[k] = ids
        rest = [k for k in range(len(texts)) if out[k] is None]
        for k in rest:
            out[k] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, dtype=np.uint32)
        return out


def default_tokenizer() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


_TOKENS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("number", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
_BLOCKS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first_doc", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
_PARTS = pa.schema([("shard", pa.int64()), ("doc", pa.int64()), ("block", pa.int64()), ("is_part", pa.bool_()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _short(ids: np.ndarray) -> bytes:
    """16-bit numbers, or 32-bit numbers after a zero byte."""
    return ids.astype("<u2").tobytes() if ids.max(initial=0) < 65_536 else b"\0" + ids.astype("<u4").tobytes()


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], dtype="<u4") if len(data) % 2 else np.frombuffer(data, dtype="<u2").astype(np.uint32)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts with TEXT_CHARS characters, about."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= TEXT_CHARS:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _tokens(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """The ids of each document, numbered, and for each task a row with the counts of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of(path)
        totals, number = np.zeros(1 << 16, dtype=np.int64), TaskContext.get().partitionId() << 40
        for batch in slices(batches, TEXTS):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for begin, stop in _groups(texts):
                ids = [np.append(x, np.uint32(END_ID)) for x in encode(texts[begin:stop])]
                found = np.bincount(np.concatenate(ids), minlength=len(totals))
                totals = np.pad(totals, (0, len(found) - len(totals))) + found
                part = batch.slice(begin, len(ids))
                numbers = pa.array(np.arange(number, number + len(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), numbers, pa.array([_short(x) for x in ids], type=pa.binary()), pa.nulls(len(ids), pa.binary())], schema=_TOKENS)
                number += len(ids)
        seen = np.flatnonzero(totals)
        if len(seen):
            yield pa.RecordBatch.from_pylist([{"counts": np.stack([seen, totals[seen]]).astype("<i8").tobytes()}], schema=_TOKENS)

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(run, _ddl(_TOKENS))


def _counts(tokens: DataFrame) -> DataFrame:
    """``id`` and ``count`` over all documents: a row for each id of the vocabulary that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                seen, counts = np.frombuffer(data, dtype="<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts)], names=["id", "count"])

    return tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def _index(entries: list[tuple[int | None, int]], continues: bool, continued: bool) -> bytes:
    """Ids and token counts of a block's documents; whether the first began before it, and the last goes on after it."""
    names = np.array([d or 0 for d, _ in entries], dtype="<i8").tobytes()
    nulls = np.array([d is None for d, _ in entries], dtype="u1").tobytes()
    return struct.pack("<IBB", len(entries), continues, continued) + names + nulls + np.array([n for _, n in entries], dtype="<u4").tobytes()


def _entries(index: bytes) -> tuple[list[int | None], np.ndarray, bool, bool]:
    n, continues, continued = struct.unpack_from("<IBB", index)
    names, nulls = np.frombuffer(index, "<i8", n, 6), np.frombuffer(index, "u1", n, 6 + 8 * n)
    return [None if gone else int(d) for d, gone in zip(names, nulls, strict=True)], np.frombuffer(index, "<u4", n, 6 + 9 * n), bool(continues), bool(continued)


def _blocks(batches: Iterator[pa.RecordBatch], table: Frequencies) -> Iterator[pa.RecordBatch]:
    """The documents of a file, in their order, as blocks; longer ones than a block go on in the next."""
    shard = TaskContext.get().partitionId()
    entries: list[tuple[int | None, int]] = []
    parts: list[np.ndarray] = []
    size = block = first_doc = first_id = 0
    continues = False

    def flush(continued: bool) -> pa.RecordBatch:
        nonlocal size, block, first_doc, first_id, continues
        data = write_block(np.concatenate(parts), _index(entries, continues, continued), table)
        row = {"shard": shard, "block": block, "first_doc": first_doc, "first_id": first_id, "n_ids": size, "data": data}
        block, first_doc, first_id, size, continues = block + 1, first_doc + len(entries) - continued, first_id + size, 0, continued
        entries.clear()
        parts.clear()
        return pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = _ids(data.as_py())
            while len(ids):
                part, ids = ids[: BLOCK_IDS - size], ids[BLOCK_IDS - size :]
                entries.append((name, len(part)))
                parts.append(part)
                size += len(part)
                if size == BLOCK_IDS:
                    yield flush(len(ids) > 0)
    if entries:
        yield flush(False)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts to a new folder ``path``: ``blocks``, files of blocks, and ``frequencies``, the table they share.

    A document's ids end with ``END_ID``. Documents are in ascending order of their ids, those without one first; of one id the order is that of
    a hash of the text. A null or empty text has one id, the end. Repeated rows are documents of their own, and any number of them
    may share an id: files are ranges of (id, hash, number). A document longer than a block goes on in the next. Other columns are
    ignored. An empty table gives no block.
    """
    spark, file = docs.sparkSession, tokenizer or default_tokenizer()
    tokens = stash(_tokens(docs, file, id_col, text_col))
    counted = _counts(tokens).toPandas()  # at most the vocabulary
    table = Frequencies(counted["id"].to_numpy(np.int64), counted["count"].to_numpy(np.int64))
    shared = pa.Table.from_arrays([pa.array(table.ids.astype(np.int64)), pa.array(table.frequency.astype(np.int64))], names=["id", "frequency"])
    spark.createDataFrame(shared.to_pandas(), "id long, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    keys = ("doc_id", "tie", "number")
    ranges = tokens.where("ids is not null").select(*keys, "ids").repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    ranges.select("doc_id", "ids").mapInArrow(lambda batches: _blocks(batches, table), _ddl(_BLOCKS)).write.option("compression", "none").parquet(f"{path}/blocks")


def _read(batches: Iterator[pa.RecordBatch], table: Frequencies) -> Iterator[pa.RecordBatch]:
    """A row for each document, or part of one, of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, index = read_block(row["data"], table)
            names, lengths, continues, continued = _entries(index)
            stops = np.cumsum(lengths.astype(np.int64))
            data = ids.astype("<u4").tobytes()
            k = len(names)
            part = np.zeros(k, dtype=bool)
            part[0] |= continues
            part[-1] |= continued
            crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
            columns = [np.full(k, row["shard"]), row["first_doc"] + np.arange(k), np.full(k, row["block"]), part, pa.array(names, type=pa.int64()), row["first_id"] + stops - lengths, lengths.astype(np.int64), np.array(crcs)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_PARTS)


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents from the lists of their parts."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            crc = n = 0
            for part in sorted(row["parts"], key=lambda p: p["block"]):
                crc, n = joined_crc(crc, part["ids_crc32"], 4 * part["n_tokens"]), n + part["n_tokens"]
            rows.append({"shard": row["shard"], "doc_id": row["doc_id"], "start": row["start"], "n_tokens": n, "ids_crc32": crc})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([_PARTS.field(n) for n in ("shard", "doc_id", "start", "n_tokens", "ids_crc32")]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder of token files, from its blocks alone.

    :return: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian 32-bit numbers).

    :raises FileError: in the task that reads it, for a damaged block or one with another table.
    """
    shared = spark.read.schema("id long, frequency long").parquet(f"{path}/frequencies").toPandas()  # at most the vocabulary
    table = Frequencies.scaled(shared["id"].to_numpy(np.int64), shared["frequency"].to_numpy(np.int64))
    blocks = spark.read.schema(_ddl(_BLOCKS)).parquet(f"{path}/blocks")
    parts = blocks.mapInArrow(lambda batches: _read(batches, table), _ddl(_PARTS))
    columns = ("shard", "doc_id", "start", "n_tokens", "ids_crc32")
    whole = parts.where("not is_part").select(*columns)
    # a list has a part for each block that the document fills
    lists = parts.where("is_part").groupBy("shard", "doc").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.collect_list(F.struct("block", "n_tokens", "ids_crc32")).alias("parts"))
    joined = lists.select("shard", "doc_id", "start", "parts").mapInArrow(_join_parts, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("shard", before.alias("base"))  # one row for each file
    found = whole.unionByName(joined).join(F.broadcast(bases), "shard")
    return found.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
