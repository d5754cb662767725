"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: bit b of a text is set when over half of its shingle hashes have it. Two fingerprints within ``radius`` bits differ in
at most ``radius`` of ``bands`` bit bands, so they agree in ``bands - radius`` of them: every choice of so many bands is a table of
buckets, and each close pair meets in one at least. Inside a bucket fingerprints are compared bit-sliced: 64 of them form a block of
64 bit planes (one word per bit position); a carry-save counter of words adds the differing bits of 64 pairs at once, and a block is
left as soon as all its lanes exceed the radius.

Only different fingerprints are compared. A bucket of more than ``chunk`` of them is cut into chunks by hash and compared chunk by
chunk in separate groups, so no task holds a whole hot bucket; a task returns a spanning forest of the links it finds, never all pairs.

Defined results: null or empty text has fingerprint 0 and is linked like any other; null ids take part, and a component's id is its
smallest id that is not null; repeated rows have one fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import row_key, stage
from barloom.llm.graph import components

LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of word shingles (XXH64, seed 42), 0 for a text without words."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    join = b" ".join
    half, total = np.zeros(64, np.int64), n
    for lo in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = range(lo, min(n, lo + (1 << 16)))
        h = np.fromiter((xxh64_intdigest(join(w[i:i + shingle]), 42) for i in part), np.uint64, len(part))
        half += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * half > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keys: list[Column], text: str = "text", shingle: int = 4) -> DataFrame:
    """The key columns of each row and its fingerprint ``fp`` as a signed long."""
    d = docs.select(*keys, F.col(text).cast("string").alias("_b_text"))
    names = [c for c in d.columns if c != "_b_text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[names].copy()
            out["fp"] = np.array([fingerprint(t if isinstance(t, str) else None, shingle) for t in pdf["_b_text"]], np.uint64).view(np.int64)
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields if f.name != "_b_text")
    # nullable longs would reach pandas as floats: keys travel as strings
    d = d.select(*[F.col(c).cast("string").alias(c) for c in names], "_b_text")
    text_schema = ", ".join(f"{c} string" for c in names) + ", fp long"
    out = d.mapInPandas(run, text_schema)
    return out.select(*[F.col(f.split(" ", 1)[0]).cast(f.split(" ", 1)[1]) for f in schema.split(", ")], "fp")


def band_masks(bands: int, radius: int) -> list[int]:
    """Bit masks of every choice of ``bands - radius`` bands out of ``bands`` nearly equal ones."""
    edges = [round(i * 64 / bands) for i in range(bands + 1)]
    one = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(one, bands - radius)]


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """(blocks, 64) fingerprints to 64 bit planes of one word per block: bit l of plane b is bit b of lane l."""
    bits = np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), 64, 8), axis=2, bitorder="little")
    planes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(planes).view(np.uint64).reshape(64, len(lanes))  # of a single block, packbits returns them in another order


def close_lanes(query: np.ndarray, block: np.ndarray, q: np.ndarray, planes: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (query fingerprint, block): those with a lane within ``radius`` bits, and these lanes as a word.

    ``lanes``: word of the lanes in use per block. Three planes are added at a time: a carry-save adder makes a sum and a carry
    word of them, which go into a counter of bit words; what runs over it, or over the radius, sets ``over`` for good.
    """
    width = radius.bit_length()
    counter = [np.zeros(len(query), np.uint64) for _ in range(width)]
    over = ~lanes[block]

    def add(word: np.ndarray, place: int) -> None:
        nonlocal over
        for i in range(place, width):
            counter[i], word = counter[i] ^ word, counter[i] & word
        over = over | word

    def more_than_radius() -> np.ndarray:
        above, equal = np.zeros_like(over), np.full_like(over, FULL)
        for i in reversed(range(width)):
            if radius >> i & 1:
                equal = equal & counter[i]
            else:
                above, equal = above | (equal & counter[i]), equal & ~counter[i]
        return above

    for b in range(0, 64, 3):
        x = [planes[i][block] ^ (np.uint64(0) - (q[query] >> np.uint64(i) & np.uint64(1))) for i in range(b, min(64, b + 3))]
        x += [np.zeros_like(over)] * (3 - len(x))
        add(x[0] ^ x[1] ^ x[2], 0)
        add((x[0] & x[1]) | (x[2] & (x[0] ^ x[1])), 1)
        if b % 6 == 3:
            over = over | more_than_radius()
            alive = np.flatnonzero(over != FULL)
            if 4 * len(alive) < 3 * len(over):  # leave the blocks whose lanes all exceed the radius
                query, block, over, counter = query[alive], block[alive], over[alive], [c[alive] for c in counter]
                if not len(alive):
                    break
    near = ~(over | more_than_radius())
    hit = np.flatnonzero(near)
    return query[hit], block[hit], near[hit]


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least index reachable, by hooking and pointer jumping."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        if not (la != lb).any():
            return label
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def forest(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` inside each group (rows sorted by group), as (fingerprint, root) of a spanning forest.

    ``side``: 0 rows are compared among themselves (no 1 or 2 in the group), or 1 rows are compared with 2 rows.
    """
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    lane_rows, query_rows = np.flatnonzero(side != 1), np.flatnonzero(side != 2)
    # blocks of up to 64 lanes of one group
    g = of[lane_rows]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    at = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else np.zeros(0, int)
    new = first | (at % 64 == 0)
    block_no, lane = np.cumsum(new) - 1, at % 64
    blocks = int(new.sum())
    member = np.zeros((blocks, 64), np.int64)
    member[block_no, lane] = lane_rows
    used = np.zeros((blocks, 64), np.uint8)
    used[block_no, lane] = 1
    lanes = np.packbits(used, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    planes = planes_of(fp[member])
    block_group = g[new]
    lo, hi = np.searchsorted(block_group, of[query_rows], "left"), np.searchsorted(block_group, of[query_rows], "right")
    count = hi - lo
    label = np.arange(n)
    cum = np.r_[0, np.cumsum(count)]
    i = 0
    while i < len(query_rows):
        j = max(i + 1, int(np.searchsorted(cum, cum[i] + step, "right")) - 1)
        c = count[i:j]
        query = np.repeat(query_rows[i:j], c)
        block = np.repeat(lo[i:j], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        q_hit, b_hit, word = close_lanes(query, block, fp, planes, lanes, radius)
        for s in range(0, len(q_hit), 8192):
            near = np.unpackbits(word[s:s + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, l = np.nonzero(near)
            label = _roots(n, q_hit[s:s + 8192][r], member[b_hit[s:s + 8192][r], l], label)
        i = j
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def links(fps: DataFrame, radius: int = 4, bands: int = 6, chunk: int = 4096) -> DataFrame:
    """Different fingerprints ``fp`` to links (a, b) that connect all pairs within ``radius`` bits."""
    masks = band_masks(bands, radius)
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("v")) for i, m in enumerate(masks)])).alias("k"))
    rows = stage(rows.select("fp", "k.t", "k.v"), "bands")
    size = rows.groupBy("t", "v").agg(F.count("*").alias("n")).filter("n > 1").withColumn("c", F.ceil(F.col("n") / chunk).cast("int"))
    rows = rows.join(size, ["t", "v"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    pair = lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y"), F.when(j == F.col("i"), 0).when(F.col("i") < j, 1).otherwise(2).alias("s"))
    rows = rows.select("fp", "t", "v", F.explode(F.transform(F.sequence(F.lit(0), F.col("c") - 1), pair)).alias("p"))
    key = F.xxhash64("t", "v", "p.x", "p.y").alias("g")
    rows = rows.select(key, F.col("p.s").alias("s"), "fp").repartition("g").sortWithinPartitions("g", "s", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows_held = 0

        def found(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = forest(pdf["g"].to_numpy(), pdf["s"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), radius)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for pdf in batches:
            held.append(pdf)
            rows_held += len(pdf)
            if rows_held < 50_000:
                continue
            both = pd.concat(held)
            g = both["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1], "left"))  # the last group may go on
            if cut:
                yield found(both.iloc[:cut])
            held, rows_held = [both.iloc[cut:]], len(both) - cut
        if rows_held:
            yield found(pd.concat(held))

    return rows.mapInPandas(run, "a long, b long").distinct()


def clusters(prints: DataFrame, radius: int = 4, bands: int = 6, chunk: int = 4096) -> DataFrame:
    """(fp, doc_id) rows to (fp, component_id): the smallest id of each group of linked fingerprints."""
    reps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    roots = components(links(reps.select("fp"), radius, bands, chunk))
    reps = stage(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "roots")
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    return stage(reps.join(least, "root").select("fp", "component_id", "root"), "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, bands: int = 6, chunk: int = 4096, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row."""
    prints = stage(fingerprints(docs, [F.col(doc_id).alias("doc_id")], text, shingle), "prints")
    groups = clusters(prints, radius, bands, chunk)
    out = prints.join(groups, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates, with all its columns."""
    keyed = docs.select("*", *row_key(*[F.col(c) for c in docs.columns]))
    prints = stage(fingerprints(keyed, [F.col(doc_id).cast("long").alias("doc_id"), F.col("_b_k1"), F.col("_b_k2")], text), "prints")
    groups = clusters(prints.select("fp", "doc_id"), **options)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_b_k1", "_b_k2")
    keep = prints.join(groups, "fp").groupBy("root").agg(F.min(order).alias("k")).select("k._b_k1", "k._b_k2")
    copy = F.row_number().over(Window.partitionBy("_b_k1", "_b_k2").orderBy(F.lit(1)))
    return keyed.join(keep, ["_b_k1", "_b_k2"]).withColumn("_b_copy", copy).filter("_b_copy = 1").select(*docs.columns)
