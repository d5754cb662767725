"""Substring dedup by fixed-block anchors.

A word is removed where a window of ``window`` consecutive words covers it that also starts in a document with a smaller id. Every
document is cut into non-overlapping blocks of half a window, counted from its first word; their hashes are the index. Every rolling
window of a block's length probes it. A shared window of ``window`` words holds a whole block of each document, so both documents have
an anchor in it: a block that other words than its own also hit. Around the anchors hits are extended word by word: the
``window``-word windows with an anchor inside are compared by 96-bit keys, the least id of each is found, and the windows that a
smaller id owns are merged to maximal repeats.

How it runs: texts are packed into shards of some ``shard`` words (words joined by a space, documents by a line feed, zstandard),
written once. A shard gives up each different probe once, some 3 bytes, in blobs by the top bits of the hash; a bucket of hashes meets in one
task as arrays, and so do the keys of windows (96 bits, the ids of a shard counted from its least). A hash or window that a third of all documents
hold is one entry per shard. Only hashes that are anchors and keys that another shard owns come back to their shards; what repeats inside a shard is
seen there. Nothing is compared pair by pair.

Defined results: null or empty text has no words; ids are integers, a null id counts as larger than any other (a null does not
remove from a null); rows with one id do not remove from each other; repeated rows give repeated results; texts shorter than a window
lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import stage

NO_ID = (1 << 63) - 1  # stands for a null id
SHARD = 1 << 18
PER_BUCKET = 1 << 24  # probes that meet in one task
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB53)  # odd, 3 modulo 8: their powers differ in the second lowest bit already
BLOCK_FLAG, TWICE_FLAG = 1, 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shard:
    """Words of some documents one after the other: two 64-bit hashes of every word, and where documents start."""

    def __init__(self, body: bytes):
        from xxhash import xxh3_128_intdigest
        from zstandard import ZstdDecompressor

        self.docs = [d.split(b" ") if d else [] for d in ZstdDecompressor().decompress(body).split(b"\n")]
        number: dict[bytes, int] = {}
        words = [number.setdefault(w, len(number)) for d in self.docs for w in d]
        seen = [xxh3_128_intdigest(w) for w in number]
        at = np.array(words, np.int64)
        low = (1 << 64) - 1
        self.hashes = [np.fromiter((h >> s & low for h in seen), np.uint64, len(seen))[at] if len(seen) else np.zeros(0, np.uint64) for s in (0, 64)]
        self.starts = np.r_[0, np.cumsum([len(d) for d in self.docs])].astype(np.int64)
        self.n = len(at)

    def windows(self, size: int, which: int = 0) -> np.ndarray:
        """Hash of the ``size`` words from each position on (of no meaning where they run out)."""
        w, base = self.hashes[which], np.uint64(BASES[which])
        if self.n < size:
            return np.zeros(0, np.uint64)
        power = np.full(self.n, base)
        power[0] = 1
        back = np.full(self.n, np.uint64(pow(BASES[which], -1, 1 << 64)))
        back[0] = 1
        total = np.r_[np.uint64(0), np.cumsum(w * np.cumprod(power))]
        return _mixed((total[size:] - total[:-size]) * np.cumprod(back)[:self.n - size + 1])

    def complete(self, size: int) -> np.ndarray:
        """Marks the positions from which ``size`` words of one document go on."""
        last = np.repeat(self.starts[1:], np.diff(self.starts))
        return np.arange(self.n - size + 1) + size <= last[:self.n - size + 1] if self.n >= size else np.zeros(0, bool)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs)), np.diff(self.starts))


def pack(docs: DataFrame, doc_id: str, text: str, shard: int) -> DataFrame:
    """(shard, ids, body, n): documents in shards of at least ``shard`` words or one Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        press = ZstdCompressor(level=3)

        def packed(ids: list, bodies: list, n: int) -> pa.RecordBatch:
            body = press.compress(b"\n".join(bodies))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([body], pa.binary()), pa.array([n], pa.int64())], ["ids", "body", "n"])

        for batch in batches:
            ids, bodies, n = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = (t.as_py() or b"").split()
                ids.append(NO_ID if i is None else i)
                bodies.append(b" ".join(words))
                n += len(words)
                if n >= shard:
                    yield packed(ids, bodies, n)
                    ids, bodies, n = [], [], 0
            if ids:
                yield packed(ids, bodies, n)

    if not isinstance(docs.schema[doc_id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{doc_id}: ids must be integers")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = rows.mapInArrow(run, "ids array<long>, body binary, n long")
    return stage(packed.withColumn("shard", F.monotonically_increasing_id()), "shards")


def _packed(x: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: the upper bytes of what is sorted or small cost nothing."""
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes())


def _unpacked(blob: bytes, dtype: type) -> np.ndarray:
    from zstandard import ZstdDecompressor

    raw = np.frombuffer(ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _buckets(first: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes by their top ``bits``."""
    edges = np.searchsorted(first >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits < 20 else None
    if edges is not None:
        for b in np.flatnonzero(np.diff(edges)):
            yield int(b), int(edges[b]), int(edges[b + 1])
        return
    tops = first >> np.uint64(64 - bits)
    cuts = np.r_[np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]]), len(tops)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield int(tops[lo]), int(lo), int(hi)


def probes(shards: DataFrame, block: int, bits: int) -> DataFrame:
    """(bucket, shard, entries): each different rolling window of a shard as 30 bits below the bucket's, marked when it is a block or comes twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Shard(body.as_py())
                ok = s.complete(block)
                if not ok.any():
                    continue
                aligned = (np.arange(len(ok)) - s.starts[s.doc_of()][:len(ok)]) % block == 0
                h, aligned = s.windows(block)[ok], aligned[ok]
                h = (h & ~np.uint64(1)) | aligned.astype(np.uint64)  # a hash keeps its mark while it is sorted
                h.sort()
                word = h >> np.uint64(1)
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                times = np.diff(np.r_[first, len(h)])
                mark = np.bitwise_or.reduceat(h & np.uint64(1), first) * np.uint64(BLOCK_FLAG) + (times > 1).astype(np.uint64) * np.uint64(TWICE_FLAG)
                h = h[first]
                entry, mark = ((h << np.uint64(bits)) >> np.uint64(34)).astype(np.uint32), mark.astype(np.uint32)
                cut = list(_buckets(h, bits))
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _, _ in cut], pa.int32()), pa.array([no] * len(cut), pa.int64()),
                    pa.array([_packed(_steps(entry[lo:hi]) << np.uint32(2) | mark[lo:hi]) for _, lo, hi in cut], pa.binary())], ["bucket", "shard", "entries"])

    return shards.select("shard", "body").mapInArrow(run, "bucket int, shard long, entries binary")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by bucket, one bucket at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held[0]["bucket"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["bucket"], held


def anchors(found: DataFrame) -> DataFrame:
    """(bucket, shard, entries): the probes that hit a block beside the words of that block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            read = [_unpacked(r["entries"], np.uint32) for r in rows]
            parts = [np.cumsum(p >> np.uint32(2), dtype=np.uint32) for p in read]
            word, mark = np.concatenate(parts), np.concatenate(read) & np.uint32(3)
            order = np.argsort(word, kind="stable")
            word, mark = word[order], mark[order]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            marks = np.bitwise_or.reduceat(mark, first)
            times = np.diff(np.r_[first, len(word)])
            live = word[first][(marks & BLOCK_FLAG > 0) & ((times > 1) | (marks & TWICE_FLAG > 0))]
            out = []
            for r, p in zip(rows, parts):
                hit = p[np.isin(p, live, kind="sort")]
                if len(hit):
                    out.append((r["shard"], hit.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array([bucket] * len(out), pa.int32()), pa.array([s for s, _ in out], pa.int64()), pa.array([e for _, e in out], pa.binary())],
                    ["bucket", "shard", "entries"])

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, shard long, entries binary")


def _keys(s: Shard, window: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the windows from ``p`` on."""
    return s.windows(window)[p], (s.windows(window, 1)[p] >> np.uint64(32)).astype(np.uint32)


def _least_ids(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, where each key begins in it, and its least id."""
    order = np.lexsort((b, a))
    first = np.flatnonzero(np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    return order, first, np.minimum.reduceat(ids[order], first)


def keyed_windows(shards: DataFrame, window: int, block: int, bits: int) -> DataFrame:
    """Shards with their anchors to (bucket, shard, a, b, base, ids): every window with an anchor inside, once per shard with its least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["shard", "ids", "body", "hits"]).to_pylist():
                s = Shard(row["body"])
                h = s.windows(block)
                live = np.sort(np.concatenate([np.frombuffer(e["entries"], np.uint32).astype(np.uint64) | np.uint64(e["bucket"] << 30) for e in row["hits"]]))
                probe = ((h & ~np.uint64(1)) << np.uint64(bits)) >> np.uint64(34) | (h >> np.uint64(64 - bits)) << np.uint64(30)
                at = np.isin(probe, live, kind="sort") & s.complete(block)
                # a window from p on holds an anchor when one starts in p .. p + window - block
                seen = np.r_[0, np.cumsum(at)]
                p = np.flatnonzero(s.complete(window))
                p = p[seen[p + window - block + 1] > seen[p]]
                if not len(p):
                    continue
                a, b = _keys(s, window, p)
                order, first, least = _least_ids(a, b, np.array(row["ids"], np.int64)[s.doc_of()[p]])
                a, b, base = a[order[first]], b[order[first]], int(least.min())
                offset = least - base
                ids = offset.astype(np.uint32) if base >= 0 and offset.max() < 1 << 32 else least
                cut = list(_buckets(a, bits))
                yield pa.RecordBatch.from_arrays([
                    pa.array([x for x, _, _ in cut], pa.int32()), pa.array([row["shard"]] * len(cut), pa.int64()),
                    pa.array([_packed(_steps(a[lo:hi])) for _, lo, hi in cut], pa.binary()), pa.array([_packed(b[lo:hi]) for _, lo, hi in cut], pa.binary()),
                    pa.array([base if ids.dtype == np.uint32 else None] * len(cut), pa.int64()), pa.array([_packed(ids[lo:hi]) for _, lo, hi in cut], pa.binary())],
                    ["bucket", "shard", "a", "b", "base", "ids"])

    return shards.mapInArrow(run, "bucket int, shard long, a binary, b binary, base long, ids binary")


def owned(keyed: DataFrame) -> DataFrame:
    """(shard, a, b): the windows of a shard that start in a document of another shard with a smaller id than all of the shard's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            a = [np.cumsum(_unpacked(r["a"], np.uint64), dtype=np.uint64) for r in rows]
            b = [_unpacked(r["b"], np.uint32) for r in rows]
            ids = [_unpacked(r["ids"], np.int64) if r["base"] is None else _unpacked(r["ids"], np.uint32).astype(np.int64) + r["base"] for r in rows]
            order, first, least = _least_ids(np.concatenate(a), np.concatenate(b), np.concatenate(ids))
            of = np.empty(len(order), np.int64)
            of[order] = np.repeat(least, np.diff(np.r_[first, len(order)]))
            out, lo = [], 0
            for r, x, y, own in zip(rows, a, b, ids):
                hit = np.flatnonzero(of[lo:lo + len(x)] < own)
                lo += len(x)
                if len(hit):
                    out.append((r["shard"], _packed(_steps(x[hit])), _packed(y[hit])))
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["shard", "a", "b"])

    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "shard long, a binary, b binary")


def cleaned(shards: DataFrame, window: int) -> DataFrame:
    """Shards with their owned windows to one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["ids", "body", "hits"]).to_pylist():
                s = Shard(row["body"])
                gone = np.zeros(s.n + 1, np.int64)
                p = np.flatnonzero(s.complete(window))
                if len(p):
                    a, b = _keys(s, window, p)
                    ids = np.array(row["ids"], np.int64)[s.doc_of()[p]]
                    order, first, least = _least_ids(a, b, ids)
                    group = np.empty(len(p), np.int64)
                    group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(p)]))
                    hit = ids > least[group]
                    if row["hits"]:
                        x = np.concatenate([np.cumsum(_unpacked(e["a"], np.uint64), dtype=np.uint64) for e in row["hits"]])
                        y = np.concatenate([_unpacked(e["b"], np.uint32) for e in row["hits"]])
                        # owned keys stand among the shard's own: mark their groups
                        mine = np.r_[np.zeros(len(first), bool), np.ones(len(x), bool)]
                        both, start, _ = _least_ids(np.r_[a[order[first]], x], np.r_[b[order[first]], y], np.zeros(len(mine), np.int64))
                        some = np.repeat(np.logical_or.reduceat(mine[both], start), np.diff(np.r_[start, len(both)]))
                        theirs = np.empty(len(both), bool)
                        theirs[both] = some
                        hit |= theirs[:len(first)][group]
                    np.add.at(gone, p[hit], 1)
                    np.add.at(gone, p[hit] + window, -1)
                drop = np.cumsum(gone)[:s.n] > 0
                out: list[tuple] = []
                for i, (own, words) in enumerate(zip(row["ids"], s.docs)):
                    lo, hi = s.starts[i], s.starts[i + 1]
                    d = drop[lo:hi]
                    n = int(d.sum())
                    spans: list[dict] = []
                    kept = words
                    if n:
                        edge = np.flatnonzero(np.diff(np.r_[0, d.view(np.int8), 0]))
                        spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]
                        kept = [w for w, x in zip(words, d) if not x]
                    text = b" ".join(kept)
                    out.append((None if own == NO_ID else own, len(words), n, spans, text, hashlib.sha256(text).hexdigest()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()),
                    pa.array([o[3] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([o[4] for o in out], pa.binary()).cast(pa.string(), safe=False), pa.array([o[5] for o in out], pa.string())],
                    ["doc_id", "n_words", "n_removed", "repeats", "kept", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, repeats array<struct<start: long, end: long>>, kept string, kept_sha256 string"
    return shards.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, shard: int = SHARD, per_bucket: int = PER_BUCKET, least_bits: int = 8) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, repeats (removed word spans, ends exclusive), kept (words joined by a space), kept_sha256."""
    block = window // 2  # a window holds a whole block wherever blocks begin: 2 * block - 1 <= window
    shards = pack(docs, doc_id, text, shard)
    words = shards.agg(F.sum("n")).first()[0] or 0
    bits = max(least_bits, math.ceil(math.log2(max(1, words / per_bucket))))
    hits = anchors(probes(shards, block, bits)).groupBy("shard").agg(F.collect_list(F.struct("bucket", "entries")).alias("hits"))
    keyed = keyed_windows(shards.join(hits, "shard"), window, block, bits)
    gone = owned(keyed).groupBy("shard").agg(F.collect_list(F.struct("a", "b")).alias("hits"))
    return cleaned(shards.join(gone, "shard", "left"), window)


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
