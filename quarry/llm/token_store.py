"""Token ids in compressed shards, each a wavelet matrix.

Documents are sorted by id across the cluster, encoded, and written as shards of
bounded size.  A shard keeps its ids as bit planes (the highest bit first; after each
plane the ids are stably parted by that bit), every plane with a directory of
popcounts.  The compressed planes alone give the id at a position, the number of
occurrences of an id before a position, and the position of its k-th occurrence; no
second copy of the ids is kept.

File format: one Parquet row per shard, columns ``part`` and ``seq`` (order of the
shards), ``n_tokens``, ``doc_ids`` and ``lengths`` (tokens of each document with its
end id), ``bits`` (number of planes), ``zeros`` (zero bits of each plane), ``planes``
(zstandard frames of the packed bits, first bit lowest) and ``ranks`` (one bits before every
``BLOCK`` bits, unsigned 32-bit little-endian).  Spark's commit protocol makes a
shard appear once, whatever tasks are lost or repeated.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import id_order, only, remembers, small_side
from quarry.session import scratch_path

#: Tokens in a shard (a longer document is a shard of its own); bits in a directory block.
SHARD_TOKENS, BLOCK = 1 << 21, 4096

#: Appended to every document.
END_ID = 1

#: Bytes of units that a worker remembers at most, and of text that it takes apart at a time;
#: the arrays over a slice take many times its bytes.
MEMORY_BYTES, SLICE_BYTES = 64 << 20, 1 << 20

#: Rows of an Arrow batch whose texts are Python strings at a time.
ROWS = 256

SCHEMA = "part long, seq long, n_tokens long, doc_ids array<long>, lengths array<long>, bits int, zeros array<long>, planes array<binary>, ranks array<binary>"
_ARROW = pa.schema([
    ("part", pa.int64()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("bits", pa.int32()), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
])


class WaveletMatrix:
    """Bit planes of a sequence of integers, with rank and select."""

    def __init__(self, n: int, zeros: Sequence[int], planes: Sequence[np.ndarray], ranks: Sequence[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, list(zeros), list(planes), list(ranks)
        self.bits = len(self.planes)

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (values & values.dtype.type(1 << level)) != 0
            packed = np.packbits(ones, bitorder="little")
            planes.append(packed)
            ranks.append(_directory(packed))
            zeros.append(int(len(values) - np.count_nonzero(ones)))
            parted = np.empty_like(values)
            np.compress(~ones, values, out=parted[: zeros[-1]])
            np.compress(ones, values, out=parted[zeros[-1] :])
            values = parted
        return cls(len(values), zeros, planes, ranks)

    def values(self) -> np.ndarray:
        """The whole sequence: the planes' partings undone from the last to the first."""
        out = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            before = np.empty_like(out)
            before[np.flatnonzero(~ones)], before[np.flatnonzero(ones)] = out[: self.zeros[level]], out[self.zeros[level] :]
            out = before | (ones.astype(out.dtype) << out.dtype.type(self.bits - 1 - level))
        return out

    def _rank1(self, level: int, i: int) -> int:
        """One bits of the plane before position i."""
        block, plane = i // BLOCK, self.planes[level]
        start = block * (BLOCK // 8)
        whole = int(np.bitwise_count(plane[start : i // 8]).sum())
        rest = int(plane[i // 8] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0
        return int(self.ranks[level][block]) + whole + rest

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value in the plane."""
        at = np.arange(len(self.ranks[level]), dtype=np.int64) * BLOCK
        counts = self.ranks[level].astype(np.int64) if bit else at - self.ranks[level]
        block = int(np.searchsorted(counts, k, side="right")) - 1
        start = block * BLOCK
        piece = np.unpackbits(self.planes[level][start // 8 : (start + BLOCK) // 8], count=min(BLOCK, self.n - start), bitorder="little")
        return start + int(np.flatnonzero(piece == bit)[k - int(counts[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][i // 8] >> (i % 8)) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _run(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` start below the last plane, and where those before i end."""
        low = 0
        for level in range(self.bits):
            a, b = self._rank1(level, low), self._rank1(level, i)
            one = value >> (self.bits - 1 - level) & 1
            low, i = (self.zeros[level] + a, self.zeros[level] + b) if one else (low - a, i - b)
        return low, i

    def count(self, value: int, end: int | None = None) -> int:
        """Occurrences of ``value`` before ``end`` (default: in all)."""
        if value >> self.bits:
            return 0
        low, high = self._run(value, self.n if end is None else end)
        return high - low

    def occurrence(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        if not 0 <= k < self.count(value):
            raise IndexError(f"{value} has no occurrence {k}")
        i = self._run(value, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            i = self._select(level, 1, i - self.zeros[level]) if one else self._select(level, 0, i)
        return i


def _directory(packed: np.ndarray) -> np.ndarray:
    """One bits before each block of BLOCK bits."""
    each = np.add.reduceat(np.bitwise_count(packed).astype(np.uint32), np.arange(0, max(1, len(packed)), BLOCK // 8)) if len(packed) else np.zeros(0, np.uint32)
    return np.concatenate([[0], np.cumsum(each)]).astype("<u4")


# The split pattern of the tokenizer file for which words may be encoded one by one.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of bytes: white space, letters (ASCII; Latin-1 ones are found by their two bytes), digits, ASCII signs, any other.
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = _SIGN
#: Units that the normaliser and the split leave alone: the model alone gives their ids.
_BARE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class _Memory:
    """Ids of units in two generations that together stay below ``limit`` bytes: when the newer one
    is half of that, it becomes the older one; what is still asked for comes back from there."""

    #: What an entry takes besides the bytes of its key and value.
    ENTRY = 170

    def __init__(self, limit: int):
        self.limit, self.size = limit, 0
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def put(self, keys: list[bytes], values: list[bytes]) -> None:
        if 2 * self.size > self.limit:
            self.new, self.old, self.size = {}, self.new, 0
        self.new.update(zip(keys, values))
        self.size += sum(map(len, keys)) + sum(map(len, values)) + self.ENTRY * len(keys)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Where the tokenizer drops white space and splits at it anyway (``by_word``), the ids of a text are
    those of its units in turn.  A word of ASCII and Latin-1 letters, digits and ASCII signs falls into
    runs of letters, single digits and runs of signs, as the tokenizer splits it; any other word, and
    one with an apostrophe or the mark of a special token, is a unit as it is.  Units are found for many
    texts at once in their bytes, and each distinct one is encoded once and remembered
    (``MEMORY_BYTES``): plain runs by the library's BPE model, all others by the whole library.  Any
    other tokenizer gets the whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, max(self.tokenizer.get_vocab_size() - 1, END_ID).bit_length())
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = (
            split.get("pattern") == {"Regex": WORD_SPLIT} and split.get("behavior") == "Removed" and bool(split.get("invert"))
            and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) or not t["content"].startswith("<|") for t in spec["added_tokens"])
            and spec.get("post_processor") is None
        )
        self.code = "H" if self.bits <= 16 else "I"
        self.type = np.dtype(self.code)
        self.memory = _Memory(MEMORY_BYTES)
        # a byte stands for itself in the byte alphabet where it is printable Latin-1, else for the next code point from 256
        itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(itself)]
        self.alphabet = {b: b for b in itself} | {b: 256 + i for i, b in enumerate(others)}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; at most a slice of texts is in work at a time."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            raw = text.encode()
            if held and size + len(raw) > SLICE_BYTES:
                yield from self._slice(held)
                held, size = [], 0
            if len(raw) > SLICE_BYTES and self.by_word:  # a very long text goes in parts that end at white space
                yield np.concatenate([ids for part in _parts(raw) for ids in self._slice([part])])
            else:
                held.append(raw)
                size += len(raw) + 1
        if held:
            yield from self._slice(held)

    def _slice(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each text of a slice."""
        if not self.by_word:
            return [np.frombuffer(b, dtype=self.type) for b in self._plain([r.decode() for r in raws])]
        buffer = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        stops = np.cumsum([len(r) + 1 for r in raws])
        units, first = _units(buffer, stops)
        coded = units.dictionary_encode()
        ids, lengths = self._ids(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy(zero_copy_only=False)
        begins = np.cumsum(lengths) - lengths
        each = lengths[which]
        after = np.cumsum(each)
        total = int(after[-1]) if len(after) else 0
        flat = ids[np.repeat(begins[which] - (after - each), each) + np.arange(total)]
        bounds = np.concatenate([[0], after])[first]
        return np.split(flat, bounds[1:-1])

    def _ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units one after the other, and how many each has."""
        memory = self.memory
        found = list(map(memory.new.get, units))
        holes = [i for i, v in enumerate(found) if v is None]
        learn, again = [], []
        for i in holes:
            found[i] = memory.old.get(units[i])
            (learn if found[i] is None else again).append(i)
        bare = [i for i in learn if _BARE.fullmatch(units[i])]
        odd = [i for i in learn if not _BARE.fullmatch(units[i])] if len(bare) < len(learn) else []
        tokenize, code, alphabet = self.tokenizer.model.tokenize, self.code, self.alphabet
        for i in bare:
            unit = units[i]
            spelled = unit.decode() if unit.isascii() else unit.decode("latin-1").translate(alphabet)
            found[i] = array(code, [x.id for x in tokenize(spelled)]).tobytes()
        for i, v in zip(odd, self._plain([units[i].decode() for i in odd])):
            found[i] = v
        memory.put([units[i] for i in again], [found[i] for i in again])
        memory.put([units[i] for i in learn], [found[i] for i in learn])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.type.itemsize
        return np.frombuffer(b"".join(found), self.type), lengths


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text cut before white space into parts of about SLICE_BYTES."""
    at = 0
    space = re.compile(rb"[\x09-\x0d\x20]")
    while at < len(raw):
        m = space.search(raw, at + SLICE_BYTES)
        end = m.start() if m and m.start() > at else len(raw)
        yield raw[at:end]
        at = end


def _units(buffer: np.ndarray, stops: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The units of texts that end at ``stops`` with a line feed each, plain ones in lower case, and the
    number of units before each text and in all."""
    kind = _CLASS[buffer]
    lead = np.flatnonzero(buffer[:-1] == 0xC3)
    then = buffer[lead + 1]
    latin = lead[(then >= 0x80) & (then <= 0xBF) & (then != 0x97) & (then != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    low = buffer.copy()
    low[(buffer >= 0x41) & (buffer <= 0x5A)] += 0x20
    upper = latin[buffer[latin + 1] <= 0x9E] + 1
    low[upper] += 0x20
    space = kind == _SPACE
    starts = np.empty(len(buffer), bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= kind == _DIGIT
    odd = kind == _OTHER
    odd[:-1] |= (buffer[:-1] == 0x3C) & (buffer[1:] == 0x7C)
    if odd.any():
        word = np.empty(len(buffer), bool)
        word[0] = True
        word[1:] = space[:-1] != space[1:]
        number = np.cumsum(word)
        whole = np.zeros(int(number[-1]) + 1, bool)
        whole[number[odd]] = True
        mine = whole[number]
        starts = np.where(mine, word, starts)
        low = np.where(mine, buffer, low)
    seen = ~space
    offsets = np.flatnonzero(starts[seen])
    data = low[seen]
    before = np.concatenate([[0], np.cumsum(seen)[stops - 1]])
    first = np.searchsorted(offsets, before)
    edges = np.concatenate([offsets, [len(data)]]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets), [None, pa.py_buffer(edges), pa.py_buffer(data)]), first


_ENCODERS: dict[str, Encoder] = {}
remembers("encoders", _ENCODERS.clear)


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _texts(column: pa.Array) -> Iterator[str]:
    """The texts of a column (null: empty), ``ROWS`` of them as Python strings at a time."""
    for at in range(0, len(column), ROWS):
        yield from ("" if t is None else t for t in column.slice(at, ROWS).to_pylist())


def _shard(part: int, seq: int, doc_ids: list, ids: list[np.ndarray], bits: int) -> dict:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    matrix = WaveletMatrix.build(flat, bits)
    press = zstandard.ZstdCompressor(level=1)
    return {
        "part": part, "seq": seq, "n_tokens": len(flat), "doc_ids": doc_ids, "lengths": [len(x) for x in ids], "bits": bits, "zeros": matrix.zeros,
        "planes": [press.compress(p.tobytes()) for p in matrix.planes], "ranks": [r.tobytes() for r in matrix.ranks],
    }


def write(docs: DataFrame, folder: str, tokenizer: str, *, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode the whole texts (null counts as empty), append ``END_ID`` to each, and
    write them in ascending doc_id order (null ids last; rows that share an id by
    text).  ``tokenizer`` is a path that executors can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("encoders")
        encoder, part, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        n = 0
        end = np.array([END_ID], dtype=encoder.type)
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(_texts(batch.column(1)))):
                if n and n + len(ids) + 1 > shard_tokens:
                    yield pa.RecordBatch.from_pylist([_shard(part, seq, doc_ids, held, encoder.bits)], schema=_ARROW)
                    doc_ids, held, n, seq = [], [], 0, seq + 1
                doc_ids.append(key)
                held.append(np.concatenate([ids, end]))
                n += len(ids) + 1
        if doc_ids:
            yield pa.RecordBatch.from_pylist([_shard(part, seq, doc_ids, held, encoder.bits)], schema=_ARROW)

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(id_order(), F.col("doc_id").isNull())
        .sortWithinPartitions(id_order(), F.col("doc_id").isNull(), "text")
        .mapInArrow(run, SCHEMA)
        .write.parquet(folder)
    )


def load(shard: pd.Series | dict) -> WaveletMatrix:
    """The wavelet matrix of one row of a shard file."""
    press = zstandard.ZstdDecompressor()
    planes = [np.frombuffer(press.decompress(bytes(p)), dtype=np.uint8) for p in shard["planes"]]
    return WaveletMatrix(int(shard["n_tokens"]), [int(z) for z in shard["zeros"]], planes, [np.frombuffer(bytes(r), dtype="<u4") for r in shard["ranks"]])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files, in no order: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SCHEMA).parquet(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, shard in batch.iterrows():
                ids = load(shard).values().astype("<u4")
                lengths = np.array(shard["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, lengths)]
                yield pd.DataFrame({
                    "part": int(shard["part"]), "seq": int(shard["seq"]), "doc_id": pd.array(list(shard["doc_ids"]), dtype="Int64"),
                    "offset": ends - lengths, "n_tokens": lengths, "ids_crc32": np.array(crcs, dtype=np.int64),
                })

    before = F.sum("n_tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))
    starts = shards.select("part", "seq", "n_tokens").select("part", "seq", F.coalesce(before, F.lit(0)).alias("_q_before"))
    return (
        shards.mapInPandas(run, "part long, seq long, doc_id long, offset long, n_tokens long, ids_crc32 long")
        .join(small_side(starts), ["part", "seq"])
        .select("doc_id", (F.col("_q_before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    )


def occurrences(spark: SparkSession, folder: str, value: int) -> DataFrame:
    """(part, seq, n): how often an id occurs in each shard, from the planes alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, shard in batch.iterrows():
                yield pd.DataFrame({"part": [int(shard["part"])], "seq": [int(shard["seq"])], "n": [load(shard).count(value)]})

    return spark.read.schema(SCHEMA).parquet(folder).mapInPandas(run, "part long, seq long, n long")


def report(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to a new folder beside the checkpoints and read the files back.

    One row per row of ``docs``; a null or empty text is the end id alone; an empty
    table writes no shard and gives no rows.  Columns other than doc_id and text are
    not read."""
    spark = docs.sparkSession
    folder = scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    write(docs, folder, tokenizer, **options)
    return read(spark, folder)
