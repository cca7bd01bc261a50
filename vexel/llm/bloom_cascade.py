"""URL filter by a Bloom filter cascade.

Level 0 is a Bloom filter of the listed keys; level 1 of its false positives among all other
keys of the corpus; level 2 of the listed keys that level 1 wrongly holds; and so on until a
level has no false positives. A key's membership is the parity of the first level that
rejects it, exact for every key of the universe the cascade was built over; keys are looked up
in bitmaps, not joined. The cascade is cut into shards by key hash, each built and held by itself.

The list has URLs, domains (which stand for their subdomains, too) and names with any ending (`casino-win.*`). A URL's
keys are what such an entry can be: itself, its host, the host's parent domains, and the first label of each of these with `.*`. The
universe is the set of all keys of all URLs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import columns, cut, drop_cut, free, map_arrow, plus, table

#: Keys of the universe in one shard, about.
SHARD_KEYS = 2_000_000
#: Bytes of all bitmaps together up to which they are sent to every executor; beyond it the keys go to the shards.
BROADCAST_BYTES = 64 << 20
#: Look-ups in one task of a shard, about.
SHARD_ROWS = 2_000_000
#: The list that op9 uses unless it is given another: names of invented sites of the usual kinds, whatever domain they are registered in.
BLOCKLIST = ("spam-farm.*", "casino-win.*", "adult-x.*", "free-bets.*", "cheap-pills.*", "ads-track.*")
TRACKING = r"^(utm_[a-z_]+|ref|ref_src|gclid|fbclid|msclkid|mc_cid|mc_eid|igshid)(=|$)"

_LEVELS = "shard long, level int, bits long, hashes int, bitmap binary"


def _authority(url: Column) -> Column:
    """Host and port of a URL with or without scheme, user name and password."""
    u = F.regexp_replace(F.trim(url.cast("string")), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    return F.regexp_replace(F.regexp_extract(u, r"^[^/?#]*", 0), r"^.*@", "")


def url_host(url: Column) -> Column:
    """The host in lower case, without port, a last dot, and www., m. or blog. where a domain is left."""
    host = F.regexp_replace(F.lower(F.regexp_replace(_authority(url), r":[0-9]*$", "")), r"\.+$", "")
    return F.regexp_replace(host, r"^(?:www|m|blog)\.([^.]+\..+)$", "$1")


def url_key(url: Column) -> Column:
    """The URL without scheme, user, fragment, usual port, tracking parameters and last slash; the host as url_host() has it. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url.cast("string")), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", ""), r"#.*$", "")
    rest = F.regexp_replace(rest, r"^[^/?]*", "")
    port = F.regexp_replace(F.regexp_extract(_authority(url), r":[0-9]*$", 0), r"^:(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    kept = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))
    return F.concat(url_host(url), port, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def url_keys(url: Column) -> Column:
    """All keys by which a URL can be on a list. Null for a null URL."""
    labels = F.split(url_host(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    names = F.transform(F.slice(labels, 1, F.greatest(F.lit(0), n - 1)), lambda x: F.concat(x, F.lit(".*")))
    return F.array_distinct(F.concat(F.array(url_key(url)), domains, names))


def _hashes(keys: Column) -> tuple[Column, Column]:
    return F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(F.lit("second"), k))


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int):
    a, b = tv.mix(h1 ^ tv.U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), tv.mix(h2 + tv.U64(level)) | tv.U64(1)
    for k in range(hashes):
        yield ((a + tv.U64(k) * b) >> tv.U64(11)) % tv.U64(bits)


def _holds(level: int, bits: int, hashes: int, bitmap: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h1), bool)
    for p in _positions(h1, h2, level, bits, hashes):
        ok &= (bitmap[(p >> tv.U64(3)).astype(np.int64)] >> (p & tv.U64(7)).astype(np.uint8)) & 1 == 1
    return ok


def cascade_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """(level, bits, hashes, bitmap) of one shard's keys. The first level's rate of false positives balances its size against the second's; the others' is 1/2."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels = []
    while len(inside):
        n = len(levels)
        rate = min(0.5, max(1e-6, len(inside) / (math.sqrt(2) * len(outside)))) if not n and len(outside) else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(len(inside) * hashes / math.log(2)))
        bitmap = np.zeros((bits + 7) // 8, np.uint8)
        for p in _positions(h1[inside], h2[inside], n, bits, hashes):
            np.bitwise_or.at(bitmap, (p >> tv.U64(3)).astype(np.int64), np.uint8(1) << (p & tv.U64(7)).astype(np.uint8))
        levels.append((n, bits, hashes, bitmap))
        wrong = outside[_holds(n, bits, hashes, bitmap, h1[outside], h2[outside])] if len(outside) else outside
        inside, outside = wrong, inside
    return levels


def member(levels: list[tuple[int, int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed."""
    out = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for n, bits, hashes, bitmap in levels:
        ok = _holds(n, bits, hashes, bitmap, h1[left], h2[left])
        out[left[~ok]] = n % 2 == 1
        left = left[ok]
    out[left] = len(levels) % 2 == 1
    return out


def build_cascade(universe: DataFrame, listed: DataFrame, key: str, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(levels as rows, number of shards) from all keys of the corpus and the listed ones (columns `key`); nulls and repeats are passed over."""
    both = universe.select(F.col(key).alias("k"), F.lit(False).alias("on")).unionByName(listed.select(F.col(key).alias("k"), F.lit(True).alias("on"))).where("k IS NOT NULL")
    keys = cut(both.groupBy(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2")).agg(F.max("on").alias("on")), "keys")
    shards = max(1, -(-keys.count() // shard_keys))

    def run(k, t):
        got = cascade_levels(t["h1"].to_numpy().view(tv.U64), t["h2"].to_numpy().view(tv.U64), t["on"].to_numpy(zero_copy_only=False).astype(bool))
        cols = list(zip(*got)) if got else [[], [], [], []]
        return pa.table([pa.array([k[0].as_py()] * len(got), pa.int64()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array([x.tobytes() for x in cols[3]], pa.binary())], ["shard", "level", "bits", "hashes", "bitmap"])

    levels = cut(keys.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInArrow(run, _LEVELS), "cascade")
    drop_cut(keys)
    return levels, shards


def _levels(rows) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["shard"], r["level"])):
        out.setdefault(r["shard"], []).append((r["level"], r["bits"], r["hashes"], np.frombuffer(r["bitmap"], np.uint8)))
    return out


def _look(levels: dict[int, list], shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    ok, shard = np.zeros(len(h1), bool), h1 % shards  # of signed numbers, as pmod() has it
    for x in np.unique(shard):
        at = np.flatnonzero(shard == x)
        ok[at] = member(levels.get(int(x), []), h1[at].view(tv.U64), h2[at].view(tv.U64))
    return ok


def with_membership(df: DataFrame, keys: Column, cascade: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """df and, last, _vx_listed (or a longer free name): whether one of the strings in the array `keys` is listed. No keys, or null ones: it is not."""
    name, a, b_, row = free(df, "_vx_listed", "_vx_h1", "_vx_h2", "_vx_row")
    out, n = plus(df, name, "boolean"), len(df.columns)
    h1, h2 = _hashes(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.isNotNull()))
    d = df.select(*columns(df), h1.alias(a), h2.alias(b_))
    if (cascade.agg(F.sum(F.length("bitmap"))).first()[0] or 0) <= broadcast_bytes:
        shared = df.sparkSession.sparkContext.broadcast(_levels(r.asDict() for r in cascade.collect()))

        def run(batches):
            for b in batches:
                x, y = b.column(n), b.column(n + 1)
                count = np.diff(x.offsets.to_numpy())
                hit = _look(shared.value, shards, x.flatten().to_numpy(), y.flatten().to_numpy())
                listed = np.bincount(np.repeat(np.arange(b.num_rows), count)[hit], minlength=b.num_rows) > 0
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(listed)], names=out.names)

        return map_arrow(d, run, out)
    # The look-ups go to their shards, so many to a task; a key that many rows have is spread by row.
    d = cut(d.withColumn(row, F.monotonically_increasing_id()), "rows")
    each = d.select(row, F.explode(F.arrays_zip(F.col(a).alias("x"), F.col(b_).alias("y"))).alias("k")).select(F.col(row).alias("row"), F.col("k.x").alias("x"), F.col("k.y").alias("y"))
    each = each.withColumn("shard", F.pmod("x", F.lit(shards)))
    parts = each.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"))
    parts = cut(parts, "parts")
    each = each.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    levels = cascade.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def own(k, left, right):
        hit = _look(_levels(right.to_pylist()), shards, left["x"].to_numpy(), left["y"].to_numpy())
        return pa.table([left["row"].filter(pa.array(hit))], ["row"])

    hits = each.drop("parts").groupBy("shard", "part").cogroup(levels.groupBy("shard", "part")).applyInArrow(own, "row long").distinct().withColumnRenamed("row", "hit_row")
    return d.join(hits, F.col(row) == F.col("hit_row"), "left").select(*columns(df), F.col("hit_row").isNotNull().alias(name))


def flagged(pages: DataFrame, entries: DataFrame, url: str = "url", entry: str = "entry") -> DataFrame:
    """pages and, last two, _vx_key (the normalised URL) and _vx_listed (or longer free names): whether the URL, a domain it is in, or a name in its host is among the entries.

    Entries are normalised like URLs; null and empty ones are passed over. Repeated URLs and entries are one key and flagged alike; a null URL has a null key and is not listed, an
    empty one has an empty key and is not listed. URLs of any length are keys as a whole; entries that tie after normalisation are one. Other columns pass through, whatever their names. Empty in, empty out.
    """
    key, keys = free(pages, "_vx_key", "_vx_keys")
    listed = entries.select(F.when(F.col(entry).endswith(".*"), F.lower(F.trim(F.col(entry)))).otherwise(url_key(F.col(entry))).alias("k")).where("k <> ''")
    universe = pages.select(F.explode(url_keys(F.col(url))).alias("k"))
    cascade, shards = build_cascade(universe, listed, "k")
    d = pages.select(*columns(pages), url_key(F.col(url)).alias(key))
    return with_membership(d, url_keys(F.col(url)), cascade, shards)


def op9_bloom_cascade(spark: SparkSession, sf_dir: str, entries: DataFrame | None = None) -> DataFrame:
    """(page_id, url, key, listed) of every page: its normalised URL and whether it is on the list (`entries`, a table with a column entry; by default BLOCKLIST)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    if entries is None:
        entries = spark.createDataFrame([(e,) for e in BLOCKLIST], "entry string")
    d = flagged(pages, entries)
    return d.select("page_id", "url", F.col(d.columns[-2]).alias("key"), F.col(d.columns[-1]).alias("listed"))


#: The URL is taken apart by one expression, its host split at the dots and looked up label by label in the list.
OP9_SQL = f"""
WITH list(entry) AS (VALUES {", ".join(f"('{e}')" for e in BLOCKLIST)}), parts AS (
  SELECT page_id, url, regexp_extract(trim(url), '^(?:(?:[A-Za-z][-A-Za-z0-9+.]*:)?//)?(?:[^/?#]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)(?:[?]([^#]*))?', ['host', 'port', 'path', 'query']) AS u FROM pages
), hosts AS (
  SELECT page_id, url, u, string_split(lower(rtrim(u.host, '.')), '.') AS labels FROM parts
), cut AS (
  SELECT page_id, url, u, CASE WHEN labels[1] IN ('www', 'm', 'blog') AND len(labels) > 2 THEN labels[2:] ELSE labels END AS labels,
         list_filter(string_split(u.query, '&'), lambda x: x <> '' AND NOT (starts_with(string_split(lower(x), '=')[1], 'utm_') OR string_split(lower(x), '=')[1] IN ('ref', 'ref_src', 'gclid', 'fbclid', 'msclkid', 'mc_cid', 'mc_eid', 'igshid'))) AS args
  FROM hosts
)
SELECT page_id, url,
       array_to_string(labels, '.') || CASE WHEN u.port IN (':', ':80', ':443') THEN '' ELSE u.port END || rtrim(u.path, '/') || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS key,
       coalesce(list_has_any(list_transform(labels[:-2], lambda x: x || '.*'), (SELECT list(entry) FROM list)), false) AS listed
FROM cut
"""
