"""Near copies of documents: five-word Jaccard similarity of ``least`` (0.8) or more, found by several fingerprints and confirmed exactly.

Each text is its set of word shingles, with two kinds of fingerprints: ``tables`` bucket keys of ``rows`` minima of the set each (two
texts of similarity s share one with probability 1 - (1 - s^rows)^tables, 0.9998 at 0.8), and a 64-bit SimHash of the set. Texts that
meet in a bucket are compared bit-sliced within ``radius`` bits of SimHash (similarity 0.8 is about 10 bits), and each pair within it
that is not yet connected is confirmed by the Jaccard similarity of the sets. Only confirmed pairs are links. In a large group a set meets
all its open partners at once: the group's hashes are numbered, and one pass over the partners counts what they share.

Only different sets are compared. A bucket of more than ``chunk`` sets is compared chunk by chunk, as in ``simhash.links``; a task returns a
spanning forest of the confirmed links. Sets are made anew only for texts that meet another, and after the first ``early`` tables travel only to
buckets whose texts are not yet all connected, where pairs of one component are not compared again.

Defined results: a text of fewer words than a shingle is one shingle; null texts and texts without words are alike; null ids take
part, the row kept is the one with the smallest id that is not null; repeated rows are one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import row_key, stage
from barloom.llm.graph import components
from barloom.llm.simhash import LOWERED, close_lanes, planes_of

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
HELD = 32 << 20  # bytes of sets that a task holds before it compares them
FEW = 8  # open partners up to which pairs are compared one by one


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted different hashes (XXH64, seed 42) of the word shingles."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
    join = b" ".join
    n = max(1, len(w) - shingle + 1) if w else 0
    return np.unique(np.fromiter((xxh64_intdigest(join(w[i:i + shingle]), 42) for i in range(n)), np.uint64, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def simhash_of(hashes: np.ndarray) -> int:
    half = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        half += np.unpackbits(hashes[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * half > len(hashes), bitorder="little").view(np.uint64)[0])


class MinHash:
    """Bucket keys of a set: one 64-bit word per table, from the minima of ``rows`` orders of the hashes."""

    def __init__(self, tables: int, rows: int):
        rng = np.random.default_rng(11)
        self.tables, self.rows = tables, rows
        self.flip = rng.integers(0, 1 << 64, tables * rows, np.uint64)
        self.by = rng.integers(0, 1 << 64, tables * rows, np.uint64) | np.uint64(1)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        from xxhash import xxh64_intdigest

        if not len(hashes):
            return np.zeros(0, np.int64)
        least = np.full(self.tables * self.rows, FULL)
        for lo in range(0, len(hashes), 1 << 12):
            mixed = (hashes[None, lo:lo + (1 << 12)] ^ self.flip[:, None]) * self.by[:, None]
            mixed ^= mixed >> np.uint64(29)
            np.minimum(least, (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(1), out=least)
        return np.array([xxh64_intdigest(x.tobytes()) for x in least.reshape(self.tables, self.rows)], np.uint64).view(np.int64)


def sketches(keyed: DataFrame, text: str, shingle: int, tables: int, rows: int) -> DataFrame:
    """doc_id, _b_k1, _b_k2, node (64 bits that stand for the set), fp, keys (one per table)."""
    minhash = MinHash(tables, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [shingle_set(t, shingle) for t in part.column("_b_text").to_pylist()]
                node = np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                fp = np.array([simhash_of(s) for s in sets], np.uint64).view(np.int64)
                keys = [minhash.keys(s) for s in sets]
                keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                columns = [part.column(c) for c in ("doc_id", "_b_k1", "_b_k2")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(node), pa.array(fp), keys], ["doc_id", "_b_k1", "_b_k2", "node", "fp", "keys"])

    d = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "_b_k1", "_b_k2", F.col(text).cast("string").alias("_b_text"))
    return d.mapInArrow(run, "doc_id long, _b_k1 long, _b_k2 long, node long, fp long, keys array<long>")


class Shared:
    """How many hashes a set shares with each of others of its group, counted over the numbered hashes of the group."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]
        self.code = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        self.mark = np.zeros(int(self.code.max(initial=-1)) + 1, bool)

    def jaccard(self, x: int, others: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        """As ``jaccard`` of set ``x`` with each of ``others``."""
        own = self.code[self.start[x]:self.start[x + 1]]
        self.mark[own] = True
        size = self.size[others]
        end = np.cumsum(size)
        both = np.zeros(len(others), np.int64)
        lo = 0
        while lo < len(others):
            hi = max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + step, "right")))
            n = size[lo:hi]
            at = np.repeat(self.start[others[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            total = np.r_[0, np.cumsum(self.mark[self.code[at]], dtype=np.int64)]
            both[lo:hi] = np.diff(total[np.r_[0, np.cumsum(n)]])
            lo = hi
        self.mark[own] = False
        every = len(own) + size - both
        return np.where(every > 0, both / np.maximum(every, 1), 1.0)


def confirmed(group: np.ndarray, side: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], radius: int, least: float, root: np.ndarray) -> list[tuple[int, int]]:
    """Row pairs that connect all pairs of similarity ``least`` or more within ``radius`` bits inside each group (rows sorted by group).

    ``side``: as in ``simhash.forest``. Rows of a group with one ``root`` are connected already.
    """
    n = len(fp)
    found: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], n]
    of = np.repeat(np.arange(len(starts)), ends - starts)
    # the least row of each component of a group stands for it
    order = np.lexsort((root, of))
    new = np.r_[True, (of[order][1:] != of[order][:-1]) | (root[order][1:] != root[order][:-1])]
    label = np.zeros(n, np.int64)
    label[order] = order[new][np.cumsum(new) - 1]
    shared: tuple[int, Shared | None] = (-1, None)  # of the last large group

    def similar(x: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others``, rows of the group of ``x``, are similar to it."""
        nonlocal shared
        g = of[x]
        lo, hi = starts[g], ends[g]
        if len(others) > FEW and shared[0] != g:
            shared = (g, Shared(sets[lo:hi]) if 8 * sum(map(len, sets[lo:hi])) <= HELD else None)
        if len(others) > FEW and shared[1]:
            return shared[1].jaccard(x - lo, others - lo) >= least
        return np.array([jaccard(sets[x], sets[y]) >= least for y in others], bool)

    lane_rows, query_rows = np.flatnonzero(side != 1), np.flatnonzero(side != 2)
    g = of[lane_rows]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    at = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else np.zeros(0, int)
    new = first | (at % 64 == 0)
    block_no, lane, blocks = np.cumsum(new) - 1, at % 64, int(new.sum())
    member, used = np.zeros((blocks, 64), np.int64), np.zeros((blocks, 64), np.uint8)
    member[block_no, lane], used[block_no, lane] = lane_rows, 1
    lanes = np.packbits(used, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    planes, block_group = planes_of(fp[member]), g[new]
    lo, hi = np.searchsorted(block_group, of[query_rows], "left"), np.searchsorted(block_group, of[query_rows], "right")
    count = hi - lo
    cum = np.r_[0, np.cumsum(count)]
    i = 0
    while i < len(query_rows):
        j = max(i + 1, int(np.searchsorted(cum, cum[i] + (1 << 14), "right")) - 1)
        c = count[i:j]
        query = np.repeat(query_rows[i:j], c)
        block = np.repeat(lo[i:j], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        q_hit, b_hit, word = close_lanes(query, block, fp, planes, lanes, radius)
        for s in range(0, len(q_hit), 1024):
            near = np.unpackbits(word[s:s + 1024].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, l = np.nonzero(near)
            a, b = q_hit[s:s + 1024][r], member[b_hit[s:s + 1024][r], l]
            # a pair meets twice where a group is compared with itself
            open_pairs = (label[a] != label[b]) & ((a < b) | (side[a] != 0))
            a, b = a[open_pairs], b[open_pairs]
            cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]) if len(a) else []
            for u, v in zip(cuts, cuts[1:]):
                x, others = int(a[u]), b[u:v]
                # the first ones alone, as one link often joins many
                for part in (others[:FEW], others[FEW:]):
                    part = part[label[part] != label[x]]
                    mine = label[starts[of[x]]:ends[of[x]]]
                    for y in part[similar(x, part)]:
                        p, q = label[x], label[y]
                        if p != q:
                            found.append((x, int(y)))
                            mine[mine == max(p, q)] = min(p, q)
        i = j
    return found


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, fp, _b_text) rows to (node, fp, hashes): the set, 8 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                hashes = pa.array([shingle_set(t, shingle).tobytes() for t in part.column("_b_text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("fp"), hashes], ["node", "fp", "hashes"])

    return texts.mapInArrow(run, "node long, fp long, hashes binary")


def meetings(reps: DataFrame, chunk: int) -> DataFrame:
    """Different sets (node, keys) to (node, t, g, s): group ``g`` of table ``t`` compares its rows, side ``s`` as in ``simhash.forest``."""
    rows = stage(reps.select("node", F.posexplode("keys").alias("t", "v")), "buckets")
    size = rows.groupBy("t", "v").agg(F.count("*").alias("n")).filter("n > 1").withColumn("c", F.ceil(F.col("n") / chunk).cast("int"))
    rows = rows.join(size, ["t", "v"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    pair = lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y"), F.when(j == F.col("i"), 0).when(F.col("i") < j, 1).otherwise(2).alias("s"))
    rows = rows.select("node", "t", "v", F.explode(F.transform(F.sequence(F.lit(0), F.col("c") - 1), pair)).alias("p"))
    return stage(rows.select("node", "t", F.xxhash64("t", "v", "p.x", "p.y").alias("g"), F.col("p.s").alias("s")), "meetings")


def links(met: DataFrame, sets: DataFrame, radius: int, least: float) -> DataFrame:
    """Meetings (node, g, s, root) and their sets (node, fp, hashes) to links (a, b) that, with what connects nodes of one root, connect all similar pairs of a group."""
    # groups of the same sets (near copies meet in most tables) are compared once
    same = met.groupBy("g").agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(i), "node", "s").cast("decimal(38,0)")).alias(f"m{i}") for i in (0, 1)])
    once = same.groupBy("n", "m0", "m1").agg(F.min("g").alias("g")).select("g")
    rows = met.join(once, "g", "left_semi").join(sets, "node")
    rows = rows.select("g", "s", "node", "root", "fp", "hashes").repartition("g").sortWithinPartitions("g", "s", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size_held = 0

        def found(pdf: pd.DataFrame) -> pd.DataFrame:
            sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
            pairs = confirmed(pdf["g"].to_numpy(), pdf["s"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), sets, radius, least, pdf["root"].to_numpy())
            node = pdf["node"].to_numpy()
            return pd.DataFrame({"a": node[[x for x, _ in pairs]], "b": node[[y for _, y in pairs]]}, dtype="int64")

        for pdf in batches:
            held.append(pdf)
            size_held += int(pdf["hashes"].map(len).sum()) + 100 * len(pdf)
            if size_held < HELD:
                continue
            both = pd.concat(held)
            g = both["g"].to_numpy()
            cut = int(np.flatnonzero(g == g[-1])[0])  # the last group may go on
            if cut:
                yield found(both.iloc[:cut])
                both = both.iloc[cut:]
                size_held = int(both["hashes"].map(len).sum()) + 100 * len(both)
            held = [both]
        if held and sum(map(len, held)):
            yield found(pd.concat(held))

    return rows.mapInPandas(run, "a long, b long").distinct()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 24, tables: int = 16, rows: int = 4, early: int = 3, chunk: int = 4096) -> DataFrame:
    """The row with the smallest id of each group of near copies, with all its columns."""
    keyed = docs.select("*", *row_key(*[F.col(c) for c in docs.columns]))
    ids = keyed.select(F.col(doc_id).cast("long").alias("doc_id"), "_b_k1", "_b_k2", F.col(text).alias("_b_text"))
    prints = stage(sketches(ids, "_b_text", shingle, tables, rows), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_b_k1", "_b_k2")
    # one row per set: the row that is kept of it, whose sketch stands for all
    least_row = stage(prints.groupBy("node").agg(F.min(order).alias("k")), "least")
    reps = stage(prints.join(least_row.select("node", "k._b_k1", "k._b_k2"), ["node", "_b_k1", "_b_k2"]).dropDuplicates(["node"]), "reps")
    met = meetings(reps, chunk)
    wanted = stage(reps.join(met.select("node").distinct(), "node", "left_semi").select("node", "fp", "_b_k1", "_b_k2"), "wanted")
    texts = keyed.select("_b_k1", "_b_k2", F.col(text).cast("string").alias("_b_text")).join(wanted, ["_b_k1", "_b_k2"])
    sets = stage(sets_of(texts.select("node", "fp", "_b_text"), shingle).dropDuplicates(["node"]), "sets")
    found = stage(links(met.filter(F.col("t") < early).withColumn("root", F.col("node")), sets, radius, least), "links")
    roots = stage(components(found), "roots")
    late = stage(met.filter(F.col("t") >= early).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "late")
    unsettled = late.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("g")
    roots = components(found.union(links(late.join(unsettled, "g", "left_semi").select("node", "g", "s", "root"), sets, radius, least)))
    keep = least_row.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k")).select("k._b_k1", "k._b_k2")
    copy = F.row_number().over(Window.partitionBy("_b_k1", "_b_k2").orderBy(F.lit(1)))
    return keyed.join(keep, ["_b_k1", "_b_k2"]).withColumn("_b_copy", copy).filter("_b_copy = 1").select(*docs.columns)
