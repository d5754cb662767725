"""Secret scans by dictionary-primed zstandard novelty.

Fixed patterns give the base spans (``assign``, ``access``, ``hex``), which always stay. Beyond them every token-like string near a
sensitive word is a candidate: it is compressed after its surroundings with a zstandard dictionary of identifiers and common code,
and what it adds to the compressed size, in bytes per character, is its novelty. Random strings add most of their own length,
identifiers and words next to nothing; candidates above ``min_novelty`` are reported as kind ``novel``.

Offsets count code points, ends are exclusive. Defined results: null or empty text has no spans; null ids stay; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")  # the whole run: a match starts where a run starts
KINDS = ("assign", "access", "hex", "novel")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"key|token|secret|pass|auth|bearer|credential|private", re.I | re.A)
BEFORE = 48  # code points before a candidate in which a sensitive word must be
AROUND = 256  # code points of surroundings it is compressed after
# Identifiers and code that are no news
PRIMER = (
    "the and of to in is that for with this from public private protected static final class struct interface function return const let var "
    "import export package module require include define undefined null true false none self this super new delete void int long float "
    "double string boolean bytes array list dict map set get put post patch head delete options request response headers content-type "
    "application/json authorization bearer basic username password passwd secret token api_key apikey access_key secret_key client_id "
    "client_secret private_key public_key refresh_token access_token session_id user_id account_id created_at updated_at https://www. "
    "http://localhost:8080/api/v1/ example.com/ index.html config settings environment production development staging test default "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx 0000000000000000 your_api_key_here changeme "
)


@cache
def _compressor(primer: str = PRIMER):
    import zstandard

    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(primer.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)


def novelty(candidate: str, around: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, per character."""
    size = lambda s: len(_compressor().compress(s.encode("utf-8", "surrogatepass")))
    return (size(around + candidate) - size(around)) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def novel_spans(text: str, base: list[tuple[int, int, int]], min_novelty: float) -> list[tuple[int, int, int, float]]:
    """Candidates with digits and letters, near a sensitive word, outside the base spans, that do not compress."""
    out = []
    taken = sorted((s, e) for s, _, e in base)
    at = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        word = m[0]
        if not (re.search("[0-9]", word) and re.search("[A-Za-z]", word)) or not SENSITIVE.search(text, max(0, start - BEFORE), start):
            continue
        value = novelty(word, text[max(0, start - AROUND):start] + "\n" + text[end:end + AROUND] + "\n")
        if value >= min_novelty:
            out.append((start, 3, end, round(value, 3)))
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_novelty: float = 0.6) -> DataFrame:
    """(doc_id, spans): sorted structs of start, kind_no, end, kind, value, novelty (null for base spans)."""
    schema = "doc_id string, spans array<struct<start:int,kind_no:int,end:int,kind:string,value:string,novelty:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["_b_text"]:
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                found = sorted([(s, k, e, None) for s, k, e in base] + novel_spans(text, base, min_novelty), key=lambda x: x[:3])
                rows.append([{"start": s, "kind_no": k, "end": e, "kind": KINDS[k], "value": text[s:e], "novelty": v} for s, k, e, v in found])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": rows})

    d = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("_b_text"))
    return d.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def digest(found: DataFrame) -> DataFrame:
    at = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, at), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(F.filter("spans", lambda s: s["kind_no"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["novelty"])).alias("max_novelty"),
    )
