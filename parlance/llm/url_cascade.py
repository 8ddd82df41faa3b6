"""URL filter: prefix rules, then a Bloom filter cascade that is exact over the corpus's keys.

The cascade's first level encodes the listed keys, the second the unlisted keys
that pass the first, the third the listed keys that pass the second, and so on
until nothing is left.  A key's verdict is the parity of the first level that
does not hold it.  Because every level is built against the complete set of
keys of the corpus, the answer is exact for each of them.

Keys are dealt by hash to segments of some ``SEGMENT_KEYS`` keys; each segment
has a cascade of its own, built in one small group.  Finished cascades take a
few bits a listed key.  They are broadcast in chunks of at most
``max_broadcast_bytes``; a larger list takes more chunks, and each chunk judges
the rows of its segments, so no join moves the pages.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import ascii_lower, mix64
from parlance.session import materialise

SEGMENT_KEYS = 50_000
#: Levels after which the keys still left are stored as they are.
MAX_LEVELS = 40
LEVEL = "array<struct<bits: bigint, hashes: int, data: binary>>"
BLOB = f"segment bigint, levels {LEVEL}, rest array<string>"


def with_parts(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``path`` (both empty without ``://`` or for a null url)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return pages.withColumn("_rest", rest).withColumns({
        "host": ascii_lower(F.regexp_extract("_rest", r"^[^/?#]*", 0)),
        "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1),
    }).drop("_rest")


def rule_column(rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null where none fits.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with its path.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        found = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits & F.col("path").startswith(path), found).otherwise(out)
    return out


def key_columns(segments: int) -> dict[str, Column]:
    key = F.concat("host", "path")
    return {"key": key, "h1": F.xxhash64(key), "h2": F.xxhash64(key, F.lit(1)),
            "segment": F.pmod(F.xxhash64(key, F.lit(2)), F.lit(segments))}


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit positions, one row for each key."""
    a = mix64(h1.view(np.uint64) + np.uint64(level))
    b = mix64(h2.view(np.uint64) + np.uint64(level)) | np.uint64(1)
    k = np.arange(hashes, dtype=np.uint64)
    return (a[:, None] + b[:, None] * k[None, :]) % np.uint64(bits)


def _holds(h1, h2, level: int, bits: int, hashes: int, data: bytes) -> np.ndarray:
    at = _places(h1, h2, level, bits, hashes)
    table = np.frombuffer(data, np.uint8)
    return ((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def build_levels(keys: np.ndarray, h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> tuple[list[dict], list[str]]:
    """The levels of one segment and the listed keys that no level settles (equal hashes only)."""
    levels: list[dict] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    if len(inside) == 0:
        return [], []
    while len(inside) and len(levels) < MAX_LEVELS:
        rate = 0.5 if levels else min(0.5, max(1e-4, len(inside) / max(1, len(outside)) / math.sqrt(2)))
        bits = max(8, math.ceil(1.45 * len(inside) * math.log2(1 / rate)))
        hashes = max(1, round(math.log2(1 / rate)))
        data = np.zeros(bits, np.uint8)
        data[_places(h1[inside], h2[inside], len(levels), bits, hashes).ravel()] = 1
        packed = np.packbits(data, bitorder="little").tobytes()
        passed = outside[_holds(h1[outside], h2[outside], len(levels), bits, hashes, packed)]
        levels.append({"bits": bits, "hashes": hashes, "data": packed})
        inside, outside = passed, inside
    rest = keys[inside if len(levels) % 2 == 0 else outside].tolist() if len(inside) else []
    return levels, rest


def probe_levels(keys, h1, h2, levels, rest) -> np.ndarray:
    """Listed or not, for the keys of one segment."""
    out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for i, x in enumerate(levels):
        if not len(open_):
            break
        held = _holds(h1[open_], h2[open_], i, x["bits"], x["hashes"], x["data"])
        out[open_[~held]] = i % 2 == 1
        open_ = open_[held]
    if len(open_) and levels:
        known = set(rest)
        out[open_] = [k in known for k in keys[open_]] if len(levels) >= MAX_LEVELS else len(levels) % 2 == 1
    return out


def build_cascade(universe: DataFrame) -> tuple[DataFrame, int]:
    """(one row a segment with listed keys, number of segments) from ``universe`` (host, path, listed boolean).

    Every key of the corpus must be in ``universe``; repeated keys are listed if any of their rows is.
    """
    keys = universe.where("host <> ''").groupBy("host", "path").agg(F.max("listed").alias("listed"))
    keys = materialise(keys, "url-keys")
    segments = max(1, math.ceil(keys.count() / SEGMENT_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key"], kind="stable")
        levels, rest = build_levels(pdf.key.to_numpy(object), pdf.h1.to_numpy(np.int64), pdf.h2.to_numpy(np.int64),
                                    pdf.listed.to_numpy(bool))
        return pd.DataFrame({"segment": [pdf.segment.iloc[0]], "levels": [levels], "rest": [rest]})

    made = keys.withColumns(key_columns(segments)).select("segment", "key", "h1", "h2", "listed")
    return materialise(made.groupBy("segment").applyInPandas(build, BLOB).where("size(levels) > 0"), "url-cascade"), segments


def _prober(held):
    """The vectorised probe of the broadcast cascades ``held``: segment -> (levels, rest)."""

    def probe(key: pd.Series, h1: pd.Series, h2: pd.Series, segment: pd.Series) -> pd.Series:
        out = np.zeros(len(key), bool)
        names, a, b = key.to_numpy(object), h1.to_numpy(np.int64), h2.to_numpy(np.int64)
        for s, at in segment.groupby(segment.to_numpy()).indices.items():
            if s in held.value:
                out[at] = probe_levels(names[at], a[at], b[at], *held.value[s])
        return pd.Series(out)

    return F.pandas_udf(probe, T.BooleanType())


def with_membership(df: DataFrame, cascade: DataFrame, segments: int, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Add boolean ``listed`` to rows with ``host`` and ``path``; exact for every key the cascade was built against."""
    size = "aggregate(levels, 0L, (s, x) -> s + length(x.data) + 64) + aggregate(rest, 0L, (s, x) -> s + length(x) + 64)"
    sized = cascade.selectExpr("segment", f"{size} AS bytes")
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    chunks = max(1, math.ceil(2 * total / max_broadcast_bytes)) if total > max_broadcast_bytes else 1
    keyed = df.withColumns({f"_{k}": v for k, v in key_columns(segments).items()})
    parts = []
    for c in range(chunks):
        own = {r.segment: ([x.asDict() for x in r.levels], list(r["rest"]))
               for r in cascade.where(F.pmod("segment", F.lit(chunks)) == c).toLocalIterator()}
        held = df.sparkSession.sparkContext.broadcast(own)

        probe = _prober(held)
        rows = keyed if chunks == 1 else keyed.where(F.pmod("_segment", F.lit(chunks)) == c)
        parts.append(rows.withColumn("listed", probe("_key", "_h1", "_h2", "_segment") & (F.col("host") != "")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_key", "_h1", "_h2", "_segment")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``pages`` (page_id, url, ...) with ``host``, ``path``, ``rule``, ``verdict`` and ``listed``.

    ``listed`` (host, path) holds the keys to block; keys that no page has are of no effect.
    Where a rule fits, its verdict holds; else the page is blocked if its key is listed.
    Null or malformed urls have empty parts, no rule, and are allowed.  Extra columns
    of ``pages`` are kept, but ``host``, ``path``, ``rule``, ``verdict`` and ``listed`` are replaced.
    Repeated rows are judged alike; empty tables give empty results.
    """
    drop = [c for c in ("rule", "verdict", "listed") if c in pages.columns]
    own = with_parts(pages.drop(*drop))
    universe = own.select("host", "path", F.lit(False).alias("listed")).union(
        listed.select("host", "path", F.lit(True)))
    cascade, segments = build_cascade(universe)
    judged = with_membership(own, cascade, segments, max_broadcast_bytes)
    found = rule_column(rules)
    return judged.withColumn("_found", found).withColumns({
        "rule": F.col("_found.rule"),
        "verdict": F.coalesce("_found.verdict", F.when(F.col("listed"), "block").otherwise("allow")),
    }).drop("_found")


#: The rules of the query: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A page is thin with at most this many paragraphs.
THIN_PARAGRAPHS = 2


def thin_pages(pages: DataFrame) -> DataFrame:
    """(host, path) of pages with at most THIN_PARAGRAPHS paragraphs: the block list of the query."""
    html = F.coalesce(F.col("html"), F.lit(""))
    paragraphs = (F.length(html) - F.length(F.replace(html, F.lit("<p>"), F.lit("")))) / 3
    return with_parts(pages).where((paragraphs <= THIN_PARAGRAPHS) & (F.col("host") != "")).select("host", "path")
