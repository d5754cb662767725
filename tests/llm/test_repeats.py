"""Substring dedup, conversation repair and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import conversations, periodic, substrings

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def same(got, want):
    got, want = Counter(got), Counter(want)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


# substrings


def plain_repeats(rows, window):
    last = float("inf")
    docs = [(last if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for o, _, w in docs:
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            least[k] = min(o, least.get(k, last))
    for o, i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p:p + window])] < o:
                gone |= set(range(p, p + window))
        yield i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))


def text_rows(window):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["a", "b", "ü", "😀", "the", "end."] + [f"w{rnd.randrange(400)}"] * 6)
    passages = [[word() for _ in range(rnd.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rnd.randrange(5)):
            w += [word() for _ in range(rnd.randrange(2 * window))]
            if rnd.random() < 0.6:
                w += rnd.choice(passages)
        rows.append((rnd.choice([i, i, i, 7, None]), rnd.choice([" ", "\n", " \t\x0b"]).join(w)))
    long = " ".join(word() for _ in range(5000))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "x " * 700), (504, "x " * 90), (505, "x y " * 200), (506, long), (507, long), (None, long), (3, long[:9000]), rows[0], rows[0], (None, None)]


@pytest.mark.parametrize(("window", "shard", "bits"), [(50, 1 << 18, 8), (6, 300, 3), (7, 1, 21)])
def test_substring_dedup(spark, window, shard, bits):
    rows = text_rows(window)
    df = spark.createDataFrame([(i, t, 1, "h", "k") for i, t in rows], "doc_id long, text string, shard int, hits string, keys string").repartition(5)
    out = substrings.remove_repeats(df, window=window, shard=shard, least_bits=bits)
    got = out.collect()
    same([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], plain_repeats(rows, window))
    for r in got:
        assert sha(r["kept"]) == r["kept_sha256"] and sum(s["end"] - s["start"] for s in r["repeats"]) == r["n_removed"]
    assert substrings.digest(substrings.remove_repeats(df.limit(0))).count() == 0


def test_substring_dedup_of_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    out = substrings.digest(substrings.remove_repeats(df))
    same([tuple(r) for r in out.collect()], plain_repeats([(r["doc_id"], r["text"]) for r in df.collect()], 50))
    with pytest.raises(ValueError):
        substrings.remove_repeats(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_passage_in_every_document_is_one_entry_per_shard(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared), F.lit(" own"), "id").alias("text")).repartition(4)
    shards = substrings.pack(df, "doc_id", "text", 1 << 18)
    entries = sum(len(substrings._unpacked(r["entries"], np.uint32)) for r in substrings.probes(shards, 25, 8).collect())
    assert entries < 400 * 1 + 4 * 60 and shards.count() == 4
    out = substrings.remove_repeats(df).collect()
    assert {r["n_removed"] for r in out if r["doc_id"]} == {60} and [r["n_removed"] for r in out if r["doc_id"] == 0] == [0]


# conversations

GO = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """Least (cost, initials) over states by a search in that order."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        nxt = GO[state]
        full = {"u": "user", "a": "assistant"}[nxt]
        heapq.heappush(heap, (cost + 5, audit + "I", i, nxt, (*lines, full + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, nxt, (*lines, f"{full}:{text}")))
                if role[:1] == nxt or (state == "" and role[:1] == "s"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))


def plain_conversations(rows, damage):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = by[conv]
        one = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20 if damage else 19
        role, text = one(role), one(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        kept += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, out, count = set(), [], Counter()
        for _, role, text in kept:
            body = text.rstrip(" \t\n\x0b\x0c\r").lstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            out.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, text = plain_repair(out)
        yield conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha(text)


def conversation_rows():
    rnd = random.Random(9)
    texts = ["Hi.", "Well then!", "no end", "", " \n", None, "Is it?  ", "a\nb.", "Hi.", "日本。", "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "sage"]
    rows = []
    for c in range(150):
        for t in range(rnd.randrange(12)):
            if rnd.random() < 0.9:
                rows.append((c, rnd.choice([t, t, t, t, 3 * t]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"Text {rnd.randrange(6)}."))
    unique = {(c, t, r or " "): (c, t, r, x) for c, t, r, x in rows}  # texts of one turn and role have no stated order
    rows = list(unique.values())
    rows += [(200, None, "user", "null turn."), (200, 1, "assistant", "Yes."), (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (201, None, None, None)]
    rows += [(202, t, "user" if t % 2 else "assistant", f"Long {t}.") for t in range(3000)] + [(203, 5, "user", "Same.")] * 40
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_conversation_repair(spark, damage):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, kind int").repartition(4)
    if damage:
        inner = conversations.damaged(df)
    else:
        blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
        inner = df.select(F.col("conv_id").alias("conv"), "turn", blank("role"), blank("text"))
    out = conversations.repair(inner, df)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    same([tuple(r) for r in out.collect()], plain_conversations(rows, damage))
    assert conversations.repair(conversations.damaged(df.limit(0)), df.limit(0)).count() == 0


def test_conversation_table(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    out = conversations.repair(conversations.damaged(df), df)
    same([tuple(r) for r in out.collect()], plain_conversations([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()], True))


@pytest.mark.parametrize("block", [1, 3, 4])
def test_block_tables(block):
    rnd = random.Random(block)
    tables = conversations.Tables(block)
    assert len(tables.to[0]) == conversations.SYMBOLS ** block
    for _ in range(1500):
        symbols = bytes(rnd.randrange(1, 10) for _ in range(rnd.randrange(14)))
        rows = [("", "", "blank") if x == 1 else ("suao"[(x - 2) % 4], "t", "truncated" if x >= 6 else None) for x in symbols]
        assert tables.solve(symbols) == plain_repair(rows)[:2]


# periodic runs


def plain_runs(w, least=6, times=4):
    found, n = {}, len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, m) for (s, m), q in found.items())


def plain_row(i, w):
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[2] / r[1], r[0], r[1])) if runs else (None, None, None)
    gone = {p for s, q, m in runs for p in range(s + q, s + m)}
    s, q, m = best
    return (i, len(runs), s, q, m, 1000 * m // q if runs else None, sha("".join(f"{s},{m},{q}\n" for s, q, m in runs)), sha(" ".join(x for p, x in enumerate(w) if p not in gone)))


def plain_planted(i, text):
    w = WORD.findall(text or "")
    if i is None or not w:
        return w
    h, n = zlib.crc32(str(i).encode()), len(w)
    g = h // 10
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def run_texts():
    rnd = random.Random(6)
    out = [None, "", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 5, "a a b " * 3 + "a a", "x " * 500, "x y z " * 100 + "q " * 90]
    for _ in range(250):
        n, k = rnd.choice([8, 30, 90, 200]), rnd.choice([1, 2, 3, 9])
        w = [rnd.choice("abcdefghi"[:k]) for _ in range(n)]
        for _ in range(rnd.choice([0, 1, 3])):
            a = rnd.randrange(n)
            p = 1 + rnd.randrange((n - a) // 3 + 1)
            for i in range(a, rnd.randrange(a, n) + 1):
                w[i] = w[a + (i - a) % p]
        out.append(rnd.choice([" ", "\n", " \x0b\t"]).join(w))
    return out


@pytest.mark.parametrize("unit", [periodic.UNIT, 64, 16])
def test_periodic_runs(spark, unit):
    rows = [(rnd_id, t) for rnd_id, t in enumerate(run_texts())]
    rows += [(None, "a b " * 9), (None, None), rows[4], rows[4]]
    df = spark.createDataFrame([(i, t, 1, "b", 2) for i, t in rows], "doc_id long, text string, row int, body string, n int").repartition(3)
    out = periodic.find_runs(df, unit=unit)
    same([tuple(r) for r in periodic.digest(out).collect()], [plain_row(i, WORD.findall(t or "")) for i, t in rows])
    assert periodic.digest(periodic.find_runs(df.limit(0))).count() == 0


def test_periodic_runs_of_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    out = periodic.digest(periodic.find_runs(periodic.planted(df), unit=4096))
    short = [(r["doc_id"], plain_planted(r["doc_id"], r["text"])) for r in df.collect()]
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert len(got) == len(short)
    for i, w in short:
        if len(w) < 3000:
            assert got[i] == plain_row(i, w)
    assert {r["doc_id"]: WORD.findall(r["text"] or "") for r in periodic.planted(df).collect()} == dict(short)


def test_z_functions():
    rnd = random.Random(1)
    for _ in range(300):
        s = [rnd.choice("ab") for _ in range(rnd.randrange(1, 30))]
        z = periodic.z_function(s, len(s))
        assert all(s[:z[i]] == s[i:i + z[i]] and (i + z[i] == len(s) or s[z[i]] != s[i + z[i]]) for i in range(1, len(s)))
        marks = periodic.repeated(z)
        for q in range(1, len(s)):
            assert bool(marks[q]) == any(q % d == 0 and s[:q] == s[:d] * (q // d) for d in range(1, q))
    assert np.array_equal(periodic.codes([b"x", b"y", b"x"]), [0, 1, 0])
