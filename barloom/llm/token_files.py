"""Token ids in word-aligned binary blocks (Simple-8b).

A 64-bit word has a selector in its upper four bits and up to 60 values in the rest, as many as fit with equal width. Selector 0 is the
escape: the word holds a value's low 60 bits and the next word its upper four, so any 64-bit value can be stored. Values are coded in
blocks of ``BLOCK``; a block starts with a new word and its word offset is stored, so that blocks are encoded and decoded side by
side with array operations.

Documents are dealt by ranges of their id and sorted; each task tokenizes its range and writes segments of whole documents (ids, lengths,
words, offsets) as rows of Parquet files, which Spark commits: a lost task is written again, and any store that Spark knows will do.
Readers get the position of a range from the sums of the ranges before it (one number per range).

Defined results: null or empty text is the end id alone; null ids come first; repeated rows and ids follow each other, ordered by
text; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import text_of
from barloom.session import fresh_path

BLOCK = 256
SEGMENT = 1 << 16  # ids after which a segment is closed
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]  # selector i + 1 packs COUNTS[i] values of 60 // COUNTS[i] bits
WIDTHS = [60 // c for c in COUNTS]
MASK60 = np.uint64((1 << 60) - 1)


BITS = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)  # of every value of 16 bits


def _sliding_max(x: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Largest of the next values, for several window sizes that share their doublings; values behind the end do not count as any."""
    def joined(y: np.ndarray, step: int) -> np.ndarray:
        out = y.copy()
        if step:
            np.maximum(out[:-step], y[step:], out=out[:-step])
        return out

    doubled = {1: x}
    while max(doubled) * 2 <= max(sizes):
        doubled[max(doubled) * 2] = joined(doubled[max(doubled)], max(doubled))
    return {c: joined(doubled[1 << c.bit_length() - 1], c - (1 << c.bit_length() - 1)) for c in sizes}


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value, exactly."""
    if values.max() < len(BITS):
        return BITS[values]
    bits = np.zeros(len(values), np.uint8)
    rest = values.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = rest >> np.uint64(s) > 0
        bits[big] += s
        rest = np.where(big, rest >> np.uint64(s), rest)
    return bits + (rest > 0).astype(np.uint8)


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Values (uint64) to words and the word offset of each block."""
    n = len(values)
    values = np.asarray(values, np.uint64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    room = np.minimum(block - np.arange(n) % block, n - np.arange(n))  # a word ends with its block
    choice = np.zeros(n, np.uint8)
    most = _sliding_max(_bits(values), COUNTS)
    for sel in range(len(COUNTS), 0, -1):
        np.copyto(choice, sel, where=(most[COUNTS[sel - 1]] <= WIDTHS[sel - 1]) & (room >= COUNTS[sel - 1]))
    jump = np.array([1] + COUNTS, np.int64)[choice]
    # follow the words of all blocks side by side
    starts = np.arange(0, n, block)
    ends = np.minimum(starts + block, n)
    at, who, seen_at, seen_block = starts.copy(), np.arange(len(starts)), [], []
    while len(who):
        seen_at.append(at)
        seen_block.append(who)
        at = at + jump[at]
        left = at < ends[who]
        at, who = at[left], who[left]
    pos, of = np.concatenate(seen_at), np.concatenate(seen_block)
    order = np.argsort(pos)
    pos, of = pos[order], of[order]
    sel = choice[pos]
    used = np.where(sel == 0, 2, 1)
    place = np.cumsum(used) - used
    words = np.zeros(int(used.sum()), np.uint64)
    for s in range(1, len(COUNTS) + 1):
        p = pos[sel == s]
        if len(p):
            word = np.full(len(p), s << 60, np.uint64)
            for i in range(COUNTS[s - 1]):
                word |= values[p + i] << np.uint64(i * WIDTHS[s - 1])
            words[place[sel == s]] = word
    big = sel == 0
    words[place[big]] = values[pos[big]] & MASK60
    words[place[big] + 1] = values[pos[big]] >> np.uint64(60)
    return words, place[np.searchsorted(of, np.arange(len(starts)))]


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values. Blocks are walked side by side, so an escape's second word is not taken for a selector."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.array([1] + COUNTS + [0], np.int64)[sel]
    step = np.where(sel == 0, 2, 1)
    if (sel == 0).any():  # find the words that are selectors
        is_word = np.zeros(len(words), bool)
        at, end = offsets.copy(), np.r_[offsets[1:], len(words)]
        while len(at):
            is_word[at] = True
            at = at + step[at]
            left = at < end
            at, end = at[left], end[left]
        where = np.flatnonzero(is_word)
    else:
        where = np.arange(len(words))
    sel, count = sel[where], count[where]
    place = np.cumsum(count) - count
    out = np.zeros(n, np.uint64)
    for s in range(1, len(COUNTS) + 1):
        w, p = words[where[sel == s]], place[sel == s]
        mask = np.uint64((1 << WIDTHS[s - 1]) - 1)
        for i in range(COUNTS[s - 1]):
            out[p + i] = w >> np.uint64(i * WIDTHS[s - 1]) & mask
    big = where[sel == 0]
    out[place[sel == 0]] = words[big] & MASK60 | words[np.minimum(big + 1, len(words) - 1)] << np.uint64(60)
    return out


# Strings that the plain pre-tokenizer treats letter by letter alike: ASCII and the letters of Latin-1, all in composed form
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
ODD, PARTED = re.compile("[\x1c-\x1f]"), re.compile(r"[^ \t-\r]+")
STRINGS = 1_390_000  # strings and pieces a worker remembers; then it starts anew. The table of a dict doubles at 1,398,101


def byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class _Memo(dict):
    """Bounded memo whose missing values are computed."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Texts to ids (little-endian uint32 bytes) with a tokenizer whose pieces never cross white space.

    Each string between white space is encoded once per worker and looked up afterwards. Strings of ``PLAIN`` characters are cut into
    the tokenizer's own pieces first, so that a word is encoded once for all the punctuation and capitals around it (a piece is a string of
    its own, so one memo holds both); any other string goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.strings = _Memo(self._string, STRINGS)

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)  # only PLAIN characters get here
        ids = [t.id for t in self.tokenizer.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _string(self, s: str) -> bytes:
        if (s.isascii() and s.isprintable() or PLAIN.fullmatch(s)) and not self.special.search(s):
            low = s.lower()
            pieces = [low] if s.isalpha() else PIECES.findall(low)  # a string of letters is one piece
            return self._piece(s) if pieces == [s] else b"".join(map(self.strings.__getitem__, pieces))
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        # str.split() also parts at the four separators U+001C to U+001F, which the tokenizer takes for symbols
        parts = text.split() if not ODD.search(text) else PARTED.findall(text)
        return b"".join(map(self.strings.__getitem__, parts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


FILE_SCHEMA = "part int, first long, n_ids long, doc_ids binary, lengths binary, length_offsets binary, words binary, offsets binary, nulls binary"
FILE_ROW = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in FILE_SCHEMA.split(", "))])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Tokenize ``docs`` and write the files. ``tokenizer``: path of the vocabulary, the same on all machines."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(F.col(text)).alias("_b_text"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_b_text").withColumn("part", F.spark_partition_id())
    d = d.select("part", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "_b_text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        ids: list[int] = []
        nulls: list[bool] = []
        parts: list[bytes] = []
        size = first = part = 0

        def segment() -> pa.RecordBatch:
            words, offsets = encode(np.frombuffer(b"".join(parts), "<u4").astype(np.uint64))
            lengths, length_offsets = encode(np.array([len(p) // 4 for p in parts], np.uint64))
            row = {
                "part": part, "first": first, "n_ids": size, "doc_ids": np.array(ids, "<i8").tobytes(), "lengths": lengths.astype("<u8").tobytes(),
                "length_offsets": length_offsets.astype("<i8").tobytes(), "words": words.astype("<u8").tobytes(), "offsets": offsets.astype("<i8").tobytes(), "nulls": bytes(nulls),
            }
            return pa.RecordBatch.from_pylist([row], FILE_ROW)

        for batch in batches:
            for part, i, none, t in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "none", "_b_text")], strict=True):
                coded = enc(t) + end
                ids.append(i)
                nulls.append(none)
                parts.append(coded)
                size += len(coded) // 4
                if size >= SEGMENT:
                    yield segment()
                    first, size, ids, nulls, parts = first + size, 0, [], [], []
        if ids:
            yield segment()

    d.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    sums = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, n = (batch.column(c)[i].as_py() for c in ("part", "first", "n_ids"))
                ids, lengths, at, words, offsets, nulls = (
                    np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                    for c, kind in (("doc_ids", "<i8"), ("lengths", "<u8"), ("length_offsets", "<i8"), ("words", "<u8"), ("offsets", "<i8"), ("nulls", np.bool_)))
                lengths = decode(lengths, at, len(ids)).astype(np.int64)
                tokens = memoryview(decode(words, offsets, n).astype("<u4").tobytes())
                end = np.cumsum(lengths)
                start = end - lengths
                crc = [zlib.crc32(tokens[4 * a:4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(ids, mask=nulls), pa.array(start + first), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = files.mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(sums), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, **options)
    return read(docs.sparkSession, path)
