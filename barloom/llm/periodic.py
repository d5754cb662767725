"""Periodic runs of words: stretches with a smallest period q that are at least max(``least``, ``times`` * q) words long.

Periods are dealt with in octaves Q <= q < 2 * Q. In an octave every multiple of Q is a boundary with a tile of the words from 2 * Q
before it to 6 * Q after it, so tiles overlap, and one boundary at least lies in every run. A tile is solved alone: Z-functions of the
words after the boundary and, backward, of those before it say for each period of the octave how far the words go on with that period in both
directions. A stretch of 3 * q words or more inside a tile is a fragment, unless it is the repetition of a shorter period. Fragments are
shuffled by (document, period) and stitched: two that share q words or more belong to one run.

A document of up to ``unit`` words is solved where its text is read. A longer one is exploded into rows of tiles, some ``unit`` words
or one tile each, which are dealt out to all tasks. Before Z-functions are built, eight words are compared for all boundaries and periods at once, and
only tiles with a period left are solved. Neighbouring fragments are joined before the shuffle, and those of a whole document that are too short
are left out, since they cannot grow any more. Texts are kept and met again only where
a fragment was found.

Defined results: null or empty text has no words and no run; ids are carried along, null or repeated; repeated rows give repeated
results; runs at equal exponents are told apart by start, then period; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stage

UNIT = 1 << 14
TOGETHER = 1 << 18  # words whose boundaries are compared at once
BEFORE, AFTER = 2, 6  # tile around a boundary, in Q
FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def z_function(s: list, upto: int) -> list[int]:
    """z[i]: how many of the first words of ``s`` stand again from i on, for i < ``upto``."""
    n = len(s)
    z = [0] * min(n, upto)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def repeated(z: list[int]) -> bytearray:
    """Marks the lengths q below len(z) at which the first q words are the repetition of fewer, from their Z-function."""
    marks = bytearray(len(z))
    for d in range(1, len(z) // 2 + 1):
        if z[d] >= d and not marks[d]:  # few d are no repetition themselves
            for q in range(2 * d, min(len(z) - 1, z[d] + d) + 1, d):
                marks[q] = 1
    return marks


def tile_fragments(s: list, c: int, q0: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) in the words ``s`` of one tile: stretches over the boundary ``c`` of a period q0 <= q < 2 * q0, 3 * q words at least."""
    ahead, back = s[c:], s[:c][::-1]
    fwd = z_function(ahead, 2 * q0)
    wanted = [q for q in range(q0, len(fwd)) if fwd[q] >= q0]
    if not wanted:
        return
    shorter = repeated(fwd)
    # backward: what stands before the boundary against what stands before boundary + q
    last = min(len(s), c + 2 * q0)
    bwd = z_function([*back, None, *s[:last][::-1]], len(back) + 1 + last)
    for q in wanted:
        start, end = c - min(bwd[len(back) + 1 + last - c - q] if c else 0, c), c + q + fwd[q]
        if end - start >= 3 * q and not shorter[q]:
            yield q, start, end


@dataclass(frozen=True)
class Piece:
    """Words ``code`` that stand from ``lo`` on in their document, the octaves to solve in them, and their boundaries ``first`` to ``last``."""

    code: np.ndarray
    lo: int
    octaves: range
    first: int
    last: int


def live_boundaries(pieces: list[Piece]) -> list[dict[int, list[int]]]:
    """Per piece and octave the boundaries (positions in the piece) where some period of the octave goes on for eight words, or for Q if that is less.

    All pieces are looked at together, one comparison of arrays for each period and word.
    """
    size = np.array([len(p.code) for p in pieces])
    base = np.cumsum(size) - size
    out: list[dict[int, list[int]]] = [{} for _ in pieces]
    if not size.sum():
        return out
    widest = max((p.octaves[-1] for p in pieces if len(p.octaves)), default=0)
    code = np.concatenate([*[p.code for p in pieces], np.full((2 << widest) + 8, -1, np.int32)])
    for k in range(widest + 1):
        q0 = 1 << k
        own = np.array([i for i, p in enumerate(pieces) if k in p.octaves], np.int64)
        if not len(own):
            continue
        lo = np.array([pieces[i].lo for i in own])
        at = -(-np.array([pieces[i].first for i in own]) // q0) * q0 - lo  # the first boundary of the piece
        at += np.where(at < 0, -(at // q0) * q0, 0)
        upto = np.minimum(np.array([pieces[i].last for i in own]) - lo, size[own] - q0)
        count = np.maximum(0, -(-(upto - at) // q0))
        n = int(count.sum())
        if not n:
            continue
        nth = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        c = np.repeat(base[own] + at, count) + nth * q0
        end = np.repeat(base[own] + size[own], count)
        depth = min(8, q0)
        live = np.zeros(n, bool)
        here = code[c]
        for q in range(q0, 2 * q0):
            hit = np.flatnonzero((code[c + q] == here) & (c + (q + depth) <= end))
            for d in range(1, depth):
                if not len(hit):
                    break
                x = c[hit] + d
                hit = hit[code[x] == code[x + q]]
            live[hit] = True
        owner = np.repeat(own, count)
        for j in np.flatnonzero(live):
            out[owner[j]].setdefault(k, []).append(int(c[j] - base[owner[j]]))
    return out


def fragments(piece: Piece, live: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) of a piece at its live boundaries, joined where they overlap by a period.

    A tile that lies in a fragment of a shorter period is left out: whatever else repeats there three times is a repetition of that period.
    """
    code, lo, n = piece.code, piece.lo, len(piece.code)
    out: list[tuple[int, int, int]] = []
    wide: list[tuple[int, int]] = []
    for k in sorted(live):
        q0 = 1 << k
        found: dict[int, list[list[int]]] = {}
        for x in live[k]:
            t0, t1 = max(0, x - BEFORE * q0), min(n, x + AFTER * q0)
            if any(s <= t0 + lo and t1 + lo <= e for s, e in wide):
                continue
            for q, s, e in tile_fragments(code[t0:t1].tolist(), x - t0, q0):
                s, e, spans = s + t0 + lo, e + t0 + lo, found.setdefault(q, [])
                if spans and s <= spans[-1][1] - q:  # boundaries go upward
                    spans[-1][0], spans[-1][1] = min(s, spans[-1][0]), max(e, spans[-1][1])
                else:
                    spans.append([s, e])
        out += [(q, s, e) for q, spans in found.items() for s, e in spans]
        wide = [(s, e) for _, s, e in out if e - s >= 4 * q0]
    return out


def solve(pieces: list[Piece]) -> list[list[tuple[int, int, int]]]:
    return [fragments(p, live) for p, live in zip(pieces, live_boundaries(pieces))]


def codes(words: list[bytes]) -> np.ndarray:
    """One number per different word of a document."""
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(w, len(number)) for w in words], np.int32)


def octaves_of(n: int, times: int) -> range:
    """Octaves with a period that ``n`` words can hold ``times`` times."""
    return range((n // times).bit_length())


def _tiles(code: np.ndarray, times: int, unit: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(octave from, to, first boundary, last boundary, offset, words): rows of tiles of a long document; octaves of narrow tiles share their rows."""
    n, every = len(code), octaves_of(len(code), times)
    narrow = [k for k in every if 8 << k <= unit]
    for part in ([narrow] if narrow else []) + [[k] for k in every if 8 << k > unit]:
        widest = 1 << part[-1]
        core = max(widest, unit // widest * widest)
        for a in range(0, n, core):
            lo, hi = max(0, a - BEFORE * widest), min(n, a + core + AFTER * widest)
            yield part[0], part[-1] + 1, a, min(n, a + core), lo, code[lo:hi].tobytes()


TILE = pa.struct([("octave", pa.int32()), ("to", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("lo", pa.int64()), ("codes", pa.binary())])
TILE_SQL = "struct<octave: int, to: int, first: long, last: long, lo: long, codes: binary>"
FRAGMENT_SQL = "struct<period: long, start: long, end: long>"


def solved(docs: DataFrame, doc_id: str, text: str, least: int, times: int, unit: int) -> DataFrame:
    """(row, doc_id, n, sha, body, fragments, tile): a row per document, with its words where a run may be, and rows of tiles of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "n", "sha", "body", "fragments", "tile"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.list_(FRAGMENT), TILE]

        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        def taken(docs: list[tuple]) -> Iterator[pa.RecordBatch]:
            whole = [Piece(code, 0, octaves_of(len(code), times) if len(code) <= unit else range(0), 0, len(code)) for _, _, code, _ in docs]
            rows, held = [], 0
            for (row, own, code, body), found in zip(docs, solve(whole)):
                n, digest = len(code), hashlib.sha256(body).hexdigest()
                found = [(q, s, e) for q, s, e in found if e - s >= max(least, times * q)]  # in a whole document a joined fragment cannot grow any more
                kept = body if found or n > unit else None
                rows.append((row, own, n, digest, kept, [{"period": q, "start": s, "end": e} for q, s, e in found], None))
                for k, to, a, b, lo, part in _tiles(code, times, unit) if n > unit else ():
                    rows.append((row, None, None, None, None, None, {"octave": k, "to": to, "first": a, "last": b, "lo": lo, "codes": part}))
                    held += len(part)
                    if held > 1 << 22:
                        yield given(rows)
                        rows, held = [], 0
            if rows:
                yield given(rows)

        for batch in batches:
            docs, words_held = [], 0
            for row, own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                words = (t.as_py() or b"").split()
                docs.append((row, own, codes(words), b" ".join(words)))
                words_held += len(words)
                if words_held > TOGETHER:
                    yield from taken(docs)
                    docs, words_held = [], 0
            if docs:
                yield from taken(docs)

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stage(d.mapInArrow(run, f"row long, doc_id string, n long, sha string, body binary, fragments array<{FRAGMENT_SQL}>, tile {TILE_SQL}"), "solved")


def tile_rows(found: DataFrame) -> DataFrame:
    """Rows of tiles, dealt out to all tasks, to (row, fragment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tiles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pieces = [Piece(np.frombuffer(t["codes"], np.int32), t["lo"], range(t["octave"], t["to"]), t["first"], t["last"]) for t in tiles]
            lo = 0
            while lo < len(pieces):  # some pieces at a time
                hi, held = lo, 0
                while hi < len(pieces) and held <= TOGETHER:
                    held += len(pieces[hi].code)
                    hi += 1
                for row, out in zip(rows[lo:hi], solve(pieces[lo:hi])):
                    if out:
                        yield pa.RecordBatch.from_arrays([
                            pa.array([row] * len(out), pa.int64()), pa.array([{"period": q, "start": s, "end": e} for q, s, e in out], FRAGMENT)], ["row", "f"])
                lo = hi

    tiles = found.filter("tile is not null").select("row", "tile")
    spread = tiles.repartition("row", "tile.octave", "tile.first")
    return spread.mapInArrow(run, f"row long, f {FRAGMENT_SQL}")


def stitched(parts: DataFrame, least: int, times: int) -> DataFrame:
    """Fragments (row, f) to runs (row, start, period, length): those of a document and period that share a period's words are one."""
    f = parts.select("row", "f.period", "f.start", "f.end").distinct()
    w = Window.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("new", (reach.isNull() | (F.col("start") > reach - F.col("period"))).cast("int"))
    f = f.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = f.groupBy("row", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    return runs.select("row", "start", "period", length.alias("length")).filter(F.col("length") >= F.greatest(F.lit(least), times * F.col("period")))


RESULT = (
    "doc_id string, n_runs long, start long, period long, length long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, period: long, length: long>>, collapsed string"
)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, body, runs) to their result; a run's words after its first period are dropped."""
    for batch in batches:
        for row in batch.to_pylist():
            words = row["body"].split()
            runs = sorted((r["start"], r["period"], r["length"]) for r in row["runs"])
            best = None
            for s, q, n in runs:
                if best is None or n * best[1] > best[2] * q:  # runs come by start, then period
                    best = s, q, n
            gone = np.zeros(len(words) + 1, np.int64)
            for s, q, n in runs:
                gone[s + q] += 1
                gone[s + n] -= 1
            kept = b" ".join([w for w, d in zip(words, np.cumsum(gone[:-1])) if not d])
            listed = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
            s, q, n = best
            yield pa.RecordBatch.from_arrays([
                pa.array([row["doc_id"]], pa.string()), *[pa.array([v], pa.int64()) for v in (len(runs), s, q, n, 1000 * n // q)],
                pa.array([hashlib.sha256(listed.encode()).hexdigest()]), pa.array([hashlib.sha256(kept).hexdigest()]),
                pa.array([[{"start": s, "period": q, "length": n} for s, q, n in runs]], pa.list_(pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())]))),
                pa.array([kept], pa.binary()).cast(pa.string(), safe=False)],
                [c.split(" ", 1)[0] for c in ("doc_id", "n_runs", "start", "period", "length", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 4, unit: int = UNIT) -> DataFrame:
    """Per row: doc_id, n_runs, the run of greatest exponent (start, period, length, exponent_milli), hashes, all runs, collapsed.

    ``collapsed`` (words joined by a space, less the repetitions) is null where nothing is dropped. ``times`` is 4 at least, which is what tiles are wide enough for.
    """
    if times < 4:
        raise ValueError("times: tiles are as wide as runs of four periods need")
    found = solved(docs, doc_id, text, least, times, unit)
    own = found.filter("tile is null")
    parts = own.select("row", F.explode("fragments").alias("f")).unionByName(tile_rows(found))
    runs = stitched(parts, least, times).groupBy("row").agg(F.collect_list(F.struct("start", "period", "length")).alias("runs"))
    runs = stage(runs, "runs")
    with_runs = own.filter("body is not null").select("row", "doc_id", "body").join(runs, "row")
    without = own.join(runs.select("row"), "row", "left_anti")
    plain = {"doc_id": F.col("doc_id"), "n_runs": F.lit(0).cast("long"), "runs_sha256": F.sha2(F.lit(""), 256), "collapsed_sha256": F.col("sha")}
    fields = [c.strip().split(" ", 1) for c in RESULT.replace("start: long, period: long, length: long", "?").split(",")]
    fields = [(n, "array<struct<start: long, period: long, length: long>>" if "?" in t else t) for n, t in fields]
    empty = without.select(*[plain.get(n, F.lit(None).cast(t)).alias(n) for n, t in fields])
    out = with_runs.select("doc_id", "body", "runs").mapInArrow(_described, RESULT).unionByName(empty)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with repetitions planted by id: with h the crc32 of the decimal id and g = h div 10, where h mod 10 is 0 the words from
    a = g mod n on repeat the first 1 + (n - a) div (3 + g mod 8) of them. A null id plants nothing."""
    words = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), h.alias("_b_h"))
    d = d.withColumn("_b_w", F.when(F.col("_b_h") % 10 == 0, words)).withColumn("_b_n", F.size("_b_w"))
    g = F.floor(F.col("_b_h") / 10)
    d = d.withColumn("_b_a", F.when(F.col("_b_n") > 0, g % F.col("_b_n")))
    d = d.withColumn("_b_p", 1 + F.floor((F.col("_b_n") - F.col("_b_a")) / (3 + g % 8)))
    at = F.transform(F.sequence(F.lit(0).cast("long"), (F.col("_b_n") - 1).cast("long")), lambda i: F.when(i < F.col("_b_a"), i).otherwise(F.col("_b_a") + (i - F.col("_b_a")) % F.col("_b_p")))
    again = F.array_join(F.transform(at, lambda i: F.get("_b_w", i.cast("int"))), " ")
    return d.select("doc_id", F.when(F.col("_b_n") > 0, again).otherwise(F.col("text")).alias("text"))


def digest(out: DataFrame) -> DataFrame:
    return out.drop("runs", "collapsed")
