"""Benchmark decontamination with an FM-index per training shard.

A shard is a few documents of one Arrow batch as one sequence of word codes. Only words that a test phrase holds have codes of their
own; a run of other words is one code that no phrase has. Suffixes are sorted in numpy (codes packed into 64-bit keys, then ties by
ranks twice as deep each round), which gives the Burrows-Wheeler sequence; a wavelet matrix over it answers rank queries. All test
phrases are searched backwards together, occurrences are located by walking to sampled suffix positions, and their spans are
merged per document.

Test phrases are a broadcast of bounded size: ``block_chars`` characters of benchmark text at most. A larger benchmark is
searched in blocks of items, each over all documents, and the spans of the blocks are merged.

Defined results: null or empty text has no words and no hits; null ids stay; repeated rows and repeated items are found each; items
without words match nothing; an empty benchmark gives no hits; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import row_key, stage, text_of

# every ASCII byte but digits and letters parts words; A-Z are lower-cased
TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
END, PART, OTHER = 0, 1, 2  # codes: end of the shard, end of a document, word that no phrase holds
SHARD_WORDS = 1 << 19
SAMPLE = 16
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Phrases:
    """The windows of a benchmark: codes of their words, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window, self.code = window, {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.items)}
        for item, text in items:
            w = [self.code.setdefault(x, len(self.code) + 3) for x in words_of(text)]
            for at in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[at:at + window]), set()).add(number[item])
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.codes = np.zeros((len(found), window), np.int64)  # right-aligned
        for i, k in enumerate(found):
            self.codes[i, window - len(k):] = k
        self.of = [np.array(sorted(v), np.int64) for v in found.values()]


class BitRank:
    """Bits with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        self.words = np.packbits(np.r_[bits, np.zeros(64 - n % 64, bits.dtype)].astype(np.uint8), bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        self.ones = int(self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & (BITS[i & 63] - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


def suffixes(seq: np.ndarray, width: int) -> np.ndarray:
    """Suffix array: suffixes are sorted by as many codes as a 64-bit key takes, then ties alone by twice as many in each round."""
    n, depth = len(seq), 62 // width
    padded = np.r_[seq, np.zeros(depth, np.int64)]
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key = key << width | padded[i:n + i]
    sa = np.argsort(key, kind="stable")
    rank, at, group = np.empty(n, np.int64), np.arange(n), key[sa]
    while True:
        new = np.r_[True, group[1:] != group[:-1]]
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[sa[at]] = first
        tied = ~(new & np.r_[new[1:], True])
        at, first = at[tied], first[tied]
        if not len(at):
            return sa
        p = sa[at]
        key = first << 32 | rank[(p + depth) % n]
        order = np.argsort(key, kind="stable")
        sa[at], group = p[order], key[order]
        depth *= 2


class FMIndex:
    """FM-index of a code sequence. The last code is 0 and occurs once, so that all suffixes differ."""

    def __init__(self, seq: np.ndarray):
        n, top = len(seq), int(seq.max()) + 1
        width = max(1, (top - 1).bit_length())
        sa = suffixes(seq, width)
        self.n, self.width, self.top = n, width, top
        bwt = seq[sa - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(seq, minlength=top + 1))]
        self.levels: list[BitRank] = []
        for b in reversed(range(width)):
            bit = (bwt >> b & 1).astype(np.uint8)
            self.levels.append(BitRank(bit))
            bwt = np.r_[bwt[bit == 0], bwt[bit == 1]]
        marked = sa % SAMPLE == 0
        self.marked, self.sampled = BitRank(marked.astype(np.uint8)), sa[marked]

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``code`` is among the first ``i`` of the Burrows-Wheeler sequence."""
        lo = np.zeros_like(i)
        for b, level in zip(reversed(range(self.width)), self.levels, strict=True):
            one = (code >> b & 1).astype(bool)
            lo_1, i_1 = level.rank1(lo), level.rank1(i)
            zeros = self.n - level.ones
            lo, i = np.where(one, zeros + lo_1, lo - lo_1), np.where(one, zeros + i_1, i - i_1)
        return i - lo

    def back(self, i: np.ndarray) -> np.ndarray:
        """The suffix that begins one code earlier."""
        at, code, lo = i, np.zeros_like(i), np.zeros_like(i)
        for level in self.levels:
            one = level.get(at).astype(bool)
            code = code << 1 | one
            zeros = self.n - level.ones
            lo_1, at_1 = level.rank1(lo), level.rank1(at)
            lo, at = np.where(one, zeros + lo_1, lo - lo_1), np.where(one, zeros + at_1, at - at_1)
        return self.first[code] + at - lo

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, from, to) of phrases that occur, by backward search."""
        alive = np.arange(len(phrases.codes))
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        done = []
        for step in range(phrases.window):
            left = phrases.lengths[alive] > step
            done.append((alive[~left], lo[~left], hi[~left]))
            alive, lo, hi = alive[left], lo[left], hi[left]
            code = phrases.codes[alive, phrases.window - 1 - step]
            here = code < self.top
            alive, lo, hi, code = alive[here], lo[here], hi[here], code[here]
            if not len(alive):
                break
            lo, hi = self.first[code] + self.rank(code, lo), self.first[code] + self.rank(code, hi)
            keep = lo < hi
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
        done.append((alive, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Positions of suffixes: walk back to a sampled one, at most ``SAMPLE`` steps."""
        out, at, who, steps = np.zeros(len(i), np.int64), i, np.arange(len(i)), 0
        while len(who):
            got = self.marked.get(at).astype(bool)
            out[who[got]] = self.sampled[self.marked.rank1(at[got])] + steps
            at, who, steps = self.back(at[~got]), who[~got], steps + 1
        return out


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans that touch or overlap become one; rows of (start, end)."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.r_[True, start[1:] > end[:-1]]
    return np.c_[start[new], end[np.r_[new[1:], True]]]


def shard_hits(texts: list[str | None], phrases: Phrases) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each text of a shard: number of words, merged spans of word positions, numbers of the items found."""
    get = phrases.code.get
    seqs = [np.fromiter((get(w, OTHER) for w in words_of(t)), np.int64) for t in texts]
    sizes = np.array([len(s) for s in seqs], np.int64)
    whole = np.concatenate([x for s in seqs for x in (s, np.full(1, PART))])
    whole[-1] = END
    # one code for a run of other words
    keep = np.r_[True, ~((whole[1:] == OTHER) & (whole[:-1] == OTHER))]
    where, seq = np.flatnonzero(keep), whole[keep]
    starts = np.r_[0, np.cumsum(sizes + 1)]
    spans, items = [np.zeros((0, 2), np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
    if len(phrases.codes) and len(seq) > len(texts):
        index = FMIndex(seq)
        phrase, lo, hi = index.search(phrases)
        count = hi - lo
        if len(phrase):
            rows = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            of = np.repeat(phrase, count)
            at = where[index.locate(rows)]
            doc = np.searchsorted(starts, at, "right") - 1
            at = at - starts[doc]
            for d in np.unique(doc):
                mine = doc == d
                spans[d] = merged(at[mine], at[mine] + phrases.lengths[of[mine]])
                items[d] = np.unique(np.concatenate([phrases.of[p] for p in np.unique(of[mine])]))
    return [(int(n), s, i) for n, s, i in zip(sizes, spans, items, strict=True)]


SCHEMA = "_b_k1 long, _b_k2 long, doc_id long, n_words long, spans array<array<int>>, items array<string>"


def _search(docs: DataFrame, phrases: Phrases) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value

        def shard(pdf: pd.DataFrame) -> pd.DataFrame:
            found = shard_hits([t if isinstance(t, str) else None for t in pdf["_b_text"]], p)
            return pd.DataFrame({
                "_b_k1": pdf["_b_k1"], "_b_k2": pdf["_b_k2"], "doc_id": pdf["doc_id"].astype("Int64"), "n_words": [n for n, _, _ in found],
                "spans": [s.tolist() for _, s, _ in found], "items": [[p.items[i] for i in x] for _, _, x in found],
            })

        for pdf in batches:
            size = (pdf["_b_text"].str.len().fillna(0).to_numpy() // 6 + 2).cumsum()
            for _, part in pdf.groupby(size // SHARD_WORDS, sort=True):
                yield shard(part)

    d = docs.select("_b_k1", "_b_k2", F.col("doc_id").cast("long").alias("doc_id"), "_b_text")
    return d.mapInPandas(run, SCHEMA)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 16_000_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (merged, word positions, end exclusive), items, and the row's keys, for each row of ``docs``."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_of(F.col(text)).alias("_b_text"))
    keyed = keyed.select("*", *row_key(F.col("doc_id"), F.col("_b_text")))
    items = stage(benchmark.select(F.col(item_id).cast("string").alias("i"), text_of(F.col(item_text)).alias("t")).filter("i is not null"), "items")
    chars = items.agg(F.sum(F.length("t") + 16)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    block = lambda b: items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
    parts = [_search(keyed, Phrases([tuple(r) for r in block(b).collect()], window)) for b in range(blocks)]
    if blocks == 1:
        return parts[0]
    # the same row of each block: spans and items together, repeated rows as often as they were
    staged = stage(parts[0].withColumn("b", F.lit(0)), "hits")
    for b in range(1, blocks):
        staged = staged.unionByName(stage(parts[b].withColumn("b", F.lit(b)), "hits"))
    groups = staged.groupBy("_b_k1", "_b_k2", "doc_id", "n_words").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count(F.when(F.col("b") == 0, 1)).cast("int").alias("n"),
    )
    start = F.array_sort("spans")
    join = F.aggregate(
        start, F.expr("cast(array() as array<array<int>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.get(F.get(acc, F.size(acc) - 1), F.lit(1)) >= s[0]),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(F.get(F.get(acc, F.size(acc) - 1), F.lit(0)), F.greatest(F.get(F.get(acc, F.size(acc) - 1), F.lit(1)), s[1]))))
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return groups.select("_b_k1", "_b_k2", "doc_id", "n_words", join.alias("spans"), "items", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_b_n")).drop("_b_n")


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0), lambda s, x: s + x[1] - x[0]).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0], s[1])), ",").alias("hit_spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no test phrase occurs, with all their columns."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    bad = find(docs, benchmark, **options).filter(F.size("spans") > 0).select("_b_k1", "_b_k2").distinct()
    keyed = docs.select("*", *row_key(F.col(doc_id), text_of(F.col(text))))
    return keyed.join(stage(bad, "contaminated"), ["_b_k1", "_b_k2"], "left_anti").select(*docs.columns)
