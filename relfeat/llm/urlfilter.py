"""URL filters by a cascade of Bloom filters: exact membership without a join.

Listed keys (host and path of a rule) go into the filter of level 0.  The corpus's complete key
universe, which is every (host suffix, path prefix) that a rule could equal, is scanned against
it; what passes without being listed goes into level 1; the listed keys that pass level 1 go into
level 2; and so on with ever smaller sets until a level lets nothing wrong pass.  A key is then a
member exactly if the first level that does not hold it is an odd one, or if all levels hold it
and the last is an even one.  Levels hash with different seeds, so their errors are independent.

Rules are longest-match: a rule (host, path) fits its host and all subdomains where the url's
path starts with the rule's.  Allowed and blocked rules have a cascade each; urls that fit no
rule get ``default``, the method's verdict on what is not listed.

Scale: pages are scanned where they lie, once to build and once to judge; only false positives of
level 0, distinct, are shuffled.  Filters are broadcast; a list whose filter would be larger than
``max_bits`` is dealt out to several cascades, which judge the pages one after another.

Defined results: a null url, or one without ``://``, has empty host and path and fits only a rule
with an empty host; rules with null in host or path are left out; a rule that is both allowed and
blocked blocks; repeated rows are judged alike; an empty list blocks nothing; empty tables give
no rows.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, PROBES = 12, 8
#: Bytes of a page of filter bits: those that Spark's bitmap aggregates join.
PAGE = 4096


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _hashes(keys: list[str], level: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k, level) for k in keys), dtype=np.uint64, count=len(keys))


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(keys, PROBES) bit numbers by double hashing."""
    first, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((first[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)) % np.uint64(bits)


@dataclass
class Cascade:
    levels: list[np.ndarray] = field(default_factory=list)  # packed bits

    def holds(self, keys: list[str], level: int) -> np.ndarray:
        bits = self.levels[level]
        at = _probes(_hashes(keys, level), len(bits) * 8)
        return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def listed(self, keys: list[str]) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        open_ = np.arange(len(keys))
        for level in range(len(self.levels)):
            if not len(open_):
                break
            held = self.holds([keys[i] for i in open_], level)
            out[open_[~held]] = level % 2 == 1
            open_ = open_[held]
        out[open_] = len(self.levels) % 2 == 1
        return out


def candidates(host: str, path: str, lengths: tuple[list[int], list[int]]) -> list[str]:
    """Every (host suffix, path prefix) that a rule whose host and path have one of these lengths
    could equal; suffixes begin a label, so a host of many labels has no more keys than rules have
    lengths."""
    hosts = [host[len(host) - n:] for n in lengths[0] if n == len(host) or n < len(host) and host[len(host) - n - 1] == "."]
    prefixes = [path[:n] for n in lengths[1] if n <= len(path)]
    return [f"{h}\n{p}" for h in hosts for p in prefixes]


def _filter(keys: DataFrame, level: int, n: int) -> np.ndarray:
    """The packed bits of a filter of ``n`` keys: set by the executors and joined there in pages of
    ``PAGE`` bytes, which are put together here; its size is bounded by ``max_bits``."""
    size = -(-max(64, n * BITS_PER_KEY // 8) // PAGE) * PAGE

    def bits(batches):
        own = np.zeros(size, dtype=np.uint8)
        for batch in batches:
            at = _probes(_hashes(batch.column("key").to_pylist(), level), size * 8).ravel()
            np.bitwise_or.at(own, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        pages = own.reshape(-1, PAGE)
        for page in np.flatnonzero(pages.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([pages[page].tobytes()], pa.binary())], names=["page", "bits"])

    got = keys.select("key").mapInArrow(bits, "page long, bits binary").groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits")).toArrow()
    out = np.zeros((size // PAGE, PAGE), dtype=np.uint8)
    for page, value in zip(got["page"].to_pylist(), got["bits"].to_pylist()):
        out[page] = np.frombuffer(value[:PAGE], dtype=np.uint8)  # Spark gives pages of 4096
    return out.reshape(-1)


def build_cascade(listed: DataFrame, parts: DataFrame, lengths: tuple[list[int], list[int]], most_levels: int = 40) -> Cascade:
    """``listed``: distinct (key); ``parts``: the pages' (host, path)."""
    cascade, n = Cascade(), listed.count()
    if not n:
        return cascade
    cascade.levels.append(_filter(listed, 0, n))
    shared = parts.sparkSession.sparkContext.broadcast(cascade)

    def passing(batches):
        for batch in batches:
            keys = list({k for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()) for k in candidates(h, p, lengths)})
            held = shared.value.holds(keys, 0) if keys else []
            yield pa.RecordBatch.from_arrays([pa.array([k for k, x in zip(keys, held) if x], pa.string())], names=["key"])

    # the executors deserialise level 0 only; later levels are built from the two sets below
    wrong = parts.mapInArrow(passing, "key string").distinct().join(listed, "key", "left_anti").checkpoint()
    held_by = [listed, wrong]  # listed keys, and unlisted ones, that all levels so far hold wrongly or rightly
    while (n := held_by[1].count()) and len(cascade.levels) < most_levels:
        level = len(cascade.levels)
        cascade.levels.append(_filter(held_by[1], level, n))
        now = parts.sparkSession.sparkContext.broadcast(Cascade(list(cascade.levels)))

        def still(batches, now=now, level=level):
            for batch in batches:
                keys = batch.column("key").to_pylist()
                held = now.value.holds(keys, level) if keys else []
                yield pa.RecordBatch.from_arrays([pa.array([k for k, x in zip(keys, held) if x], pa.string())], names=["key"])

        held_by = [held_by[1], held_by[0].mapInArrow(still, "key string").checkpoint()]
    if len(cascade.levels) == most_levels:
        raise RuntimeError("the cascade did not end")
    return cascade


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
               max_bits: int = 1 << 29) -> DataFrame:
    """``id, host, path, rule, verdict`` for each page.  ``rules``: (host, path, verdict) with
    verdict ``allow`` or ``block``; ``rule`` is host and path of the longest rule that fits."""
    rules = rules.dropna(subset=["host", "path", "verdict"]).withColumn("key", F.concat("host", F.lit("\n"), "path"))
    lengths = tuple(sorted(r[0] for r in rules.select(F.length(c)).distinct().collect()) for c in ("host", "path"))  # a number for each length, no rows
    out = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    parts = out.select("host", "path")
    out = out.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    for verdict in ("allow", "block"):
        keys = rules.where(F.col("verdict") == verdict).select("key").distinct()
        shards = max(1, math.ceil(keys.count() * BITS_PER_KEY / max_bits))
        for k in range(shards):
            own = keys.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == k) if shards > 1 else keys
            cascade = pages.sparkSession.sparkContext.broadcast(build_cascade(own, parts, lengths))

            def judge(batches, cascade=cascade, verdict=verdict):
                for batch in batches:
                    hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
                    lists = [candidates(h, p, lengths) for h, p in zip(hosts, paths)]
                    flat = list({c for x in lists for c in x})
                    listed = {c for c, x in zip(flat, cascade.value.listed(flat)) if x} if flat else set()
                    found, verdicts = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
                    for i, own in enumerate(lists):
                        best = max((c for c in own if c in listed), key=len, default=None)
                        if best is not None and (found[i] is None or len(best) - 1 >= len(found[i])):
                            cut = best.index("/") if "/" in best else len(best)  # a host has no slash
                            found[i], verdicts[i] = best[:cut - 1] + best[cut:], verdict
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"),
                                                      pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=["id", "host", "path", "rule", "verdict"])

            out = out.mapInArrow(judge, out.schema)
    return out.withColumnRenamed("id", id_col)
