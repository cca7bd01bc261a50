"""Near-duplicate groups by SimHash and an LSH forest.

A text's signature is the 256-bit SimHash of its set of word pairs. Two texts are near
duplicates if their signatures differ in at most `radius` bits. The forest holds several
tries, each over its own random permutation of the bits; a trie's node at depth d is the set
of signatures that share their first d permuted bits.

Where a trie is cut depends on its density: a node is split until it holds `leaf` signatures
at most or is as deep as the table's mean density asks, and one that still holds more than `block` is split on, as deep as
`max_tries` tries can pay for. How many tries a signature is looked up in depends on its own nodes: it goes from trie to
trie, each found at the shortest prefix that density allows, until together they find a pair at the radius with the target
recall. So what lies in sparse regions has short prefixes and few tries, and what lies in dense ones long prefixes and many. Of two signatures the
one that stops first has reached the recall by itself, so the recall holds for their pair.

All members of a node are then verified on the full signatures, every row being a query. Only a node that
holds more than `block` rows at the greatest depth is cut into pairs of blocks, so that it is compared whole, by many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import columns, components, cut, drop_cut, free, table

SHINGLE = 2
WORDS64 = 4
BITS = 64 * WORDS64
RADIUS = 48
TARGET_RECALL = 0.95
LEAF = 1024
MAX_TRIES = 96
BLOCK = 4096
SEED = 20240229

_SIG = [f"s{i}" for i in range(WORDS64)]


def signatures_of(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(signature words, number of distinct shingles) of each text."""
    buf, off = tv.column_bytes(texts)
    sigs, counts = [np.zeros((0, WORDS64), tv.U64)], [np.zeros(0, np.int64)]
    for i, j in tv.chunks(off):
        h, _, first = tv.words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        s, row, _ = tv.shingles(h, first, shingle)
        s, row = tv.distinct_per_row(s, row)
        sigs.append(tv.simhash(s, row, j - i, WORDS64))
        counts.append(np.bincount(row, minlength=j - i))
    return np.vstack(sigs), np.concatenate(counts)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, s0..s3) of the documents that have an id and at least one word."""

    def run(batches):
        for b in batches:
            sig, n = signatures_of(b.column(2), shingle)
            ok = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), *(pa.array(sig[n > 0, i].view(np.int64)) for i in range(WORDS64))], ["id", "text_hash", *_SIG])

    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where("id is not null and text is not null")
    return d.mapInArrow(run, T.StructType([T.StructField("id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ["text_hash", *_SIG])]))


def hit_rates(depth: int, radius: int = RADIUS) -> np.ndarray:
    """The chance that two signatures at the radius share their first d permuted bits, for d from 0 to depth."""
    i = np.arange(depth)
    return np.concatenate([[1.0], np.cumprod(np.maximum(0, BITS - radius - i) / (BITS - i))])


def tries_for(depth: int, radius: int = RADIUS, recall: float = TARGET_RECALL) -> int:
    """Tries that together find a pair at the radius with the recall, if all are cut at this depth."""
    hit = float(hit_rates(depth, radius)[-1])
    return 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log(1 - hit)) if hit > 0 else 1 << 62


def plan(n: int, radius: int = RADIUS, recall: float = TARGET_RECALL, leaf: int = LEAF, max_tries: int = MAX_TRIES) -> tuple[int, int]:
    """(depth, greatest depth) for n signatures: what the mean density asks, and what max_tries tries can pay for."""
    most = 0
    while most < 20 and tries_for(most + 1, radius, recall) <= max_tries:
        most += 1
    return min(most, max(0, math.ceil(math.log2(max(1, n / leaf))))), most


def _distance_within(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y within the radius; half of the bits rule most pairs out."""
    d = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    d += np.bitwise_count(x[:, None, 1] ^ y[None, :, 1])
    i, j = np.nonzero(d <= radius)
    full = d[i, j].astype(np.int64)
    for w in range(2, WORDS64):
        full += np.bitwise_count(x[i, w] ^ y[j, w])
    ok = full <= radius
    return i[ok], j[ok]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' connected components."""
    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        np.minimum.at(label, before[a], m)
        np.minimum.at(label, before[b], m)
        while not np.array_equal(up := label[label], label):
            label = up
        if np.array_equal(label, before):
            break
    return label


def _verify(ids: np.ndarray, sig: np.ndarray, side: np.ndarray, radius: int, trie: int, names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n): edges (n 0) that join what is within the radius in one node, and for each row (a = b) the number n of its pairs that no earlier trie has.

    side: 0 for rows compared among themselves, else the two blocks compared with each other. names: gives rows' nodes in the earlier tries.
    """
    order = np.argsort(ids, kind="stable")
    ids, sig, side = ids[order], sig[order], side[order]
    label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    known: dict[int, int] = {}
    left, right = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if side.any() else (np.arange(len(ids)), None)
    for s in range(0, len(left), 256):
        if right is None:
            i, j = _distance_within(sig[s : s + 256], sig[s:], radius)
            a, b = (s + i)[i < j], (s + j)[i < j]
        else:
            i, j = _distance_within(sig[left[s : s + 256]], sig[right], radius)
            a, b = left[s + i], right[j]
        if not len(a):
            continue
        if trie:
            rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            fresh = [r for r in rows.tolist() if r not in known]
            if fresh:
                more = names(sig[fresh], trie)
                nodes = np.vstack([nodes, more]) if known else more  # noqa: F821
                known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            at = np.array([known[r] for r in rows.tolist()])[at]
            x, y = at[: len(a)], at[len(a) :]
            new = np.concatenate([~(nodes[x[k : k + 65_536]] == nodes[y[k : k + 65_536]]).any(1) for k in range(0, len(x), 65_536)])
            links += np.bincount(a[new], minlength=len(ids)) + np.bincount(b[new], minlength=len(ids))
        else:
            links += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        x, y = label[a], label[b]
        if (x != y).any():
            label = local_roots(len(ids), x[x != y], y[x != y])[label]
    moved, linked = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(links)
    return np.concatenate([ids[moved], ids[linked]]), np.concatenate([ids[label[moved]], ids[linked]]), np.concatenate([np.zeros(len(moved), np.int64), links[linked]])


def trie_keys(cols: list[np.ndarray], pick: np.ndarray) -> np.ndarray:
    """The picked bits of each signature as one number, the first bit on top."""
    key = np.zeros(len(cols[0]), np.int64)
    for bit in pick:
        key = (key << 1) | ((cols[bit // 64] >> tv.U64(bit % 64)) & tv.U64(1)).astype(np.int64)
    return key


def cut_depths(counts: np.ndarray, leaf: int, usual: int | None = None, block: int | None = None) -> np.ndarray:
    """Where each key's path is cut. counts: the numbers of signatures of the 2**depth nodes of the deepest level.

    The least depth at which its node holds at most `leaf` signatures (`block` from depth `usual` on), else the deepest.
    """
    deepest = len(counts).bit_length() - 1
    usual = deepest if usual is None else usual
    depth, c = np.full(len(counts), deepest, np.int64), counts
    for d in range(deepest - 1, -1, -1):
        c = c.reshape(-1, 2).sum(1)
        depth[np.repeat(c <= (leaf if d < usual else block), 1 << (deepest - d))] = d
    return depth


def _columns(b: pa.RecordBatch, first: int) -> list[np.ndarray]:
    return [b.column(first + w).to_numpy(zero_copy_only=False).view(tv.U64) for w in range(WORDS64)]


class Forest:
    """Where each trie is cut: picked bits per trie, cut depths and numbers of blocks per key of the deepest level."""

    def __init__(self, picks: list[np.ndarray], depth: int, cuts: np.ndarray, blocks: np.ndarray | None, hits: np.ndarray, recall: float):
        self.picks, self.depth, self.cuts, self.blocks, self.hits, self.recall = picks, depth, cuts, blocks, hits, recall

    def names(self, sig: np.ndarray, tries: int) -> np.ndarray:
        """rows x tries: the node of each signature in each of the first tries."""
        out = np.empty((len(sig), tries), np.uint32)
        cols = [np.ascontiguousarray(sig[:, w]) for w in range(WORDS64)]
        for t in range(tries):
            key = trie_keys(cols, self.picks[t])
            d = self.cuts[t][key].astype(np.int64)
            out[:, t] = (key >> (self.depth - d)) << 5 | d
        return out


def _count(sigs: DataFrame, picks: list[np.ndarray], depth: int, dense: np.ndarray | None = None) -> np.ndarray:
    """tries x 2**depth: how many signatures each node of the level `depth` has. dense: only of what lies in one of these nodes (tries x 2**(their depth)).

    Each task sends one number for each node it met, tries * 2**depth at most: 6 million at the greatest depth, however many rows there are.
    """
    shared = sigs.sparkSession.sparkContext.broadcast(dense)

    def run(batches):
        total, few = np.zeros((len(picks), 1 << depth), np.int64), shared.value
        for b in batches:
            cols = _columns(b, 1)
            keys = None
            if few is not None:
                up = depth - (few.shape[1].bit_length() - 1)
                on = np.zeros(b.num_rows, bool)
                for t in range(len(few)):
                    on |= few[t][trie_keys(cols, picks[t][:depth]) >> up]
                cols = [c[on] for c in cols]
            for t, pick in enumerate(picks):
                total[t] += np.bincount(trie_keys(cols, pick[:depth]), minlength=1 << depth)
        for t in range(len(picks)):
            at = np.flatnonzero(total[t])
            yield pa.RecordBatch.from_arrays([pa.array(at + (t << depth)), pa.array(total[t][at])], ["node", "n"])

    got = sigs.mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(picks) << depth, np.int64)
    counts[got["node"].to_numpy()] = got["n"].to_numpy()
    return counts.reshape(len(picks), -1)


def grow(sigs: DataFrame, n: int, radius: int = RADIUS, recall: float = TARGET_RECALL, leaf: int = LEAF, max_tries: int = MAX_TRIES, block: int = BLOCK, seed: int = SEED) -> Forest:
    """The forest over n distinct signatures (node, s0..s3): cut by the counts of all of them, level by level where it is dense."""
    depth, most = plan(n, radius, recall, leaf, max_tries)
    rng = np.random.default_rng(seed)
    bits = [rng.permutation(BITS) for _ in range(max_tries)]

    def picks(d: int) -> list[np.ndarray]:
        return [p[:d] for p in bits[: tries_for(d, radius, recall)]]

    counts = _count(sigs, picks(depth), depth)
    cuts, usual, dense = np.stack([cut_depths(c, leaf) for c in counts]), depth, counts > block
    while dense.any() and depth < most and counts.max() > block:
        depth = min(most, depth + math.ceil(math.log2(counts.max() / block)) + (depth == usual))
        counts = _count(sigs, picks(depth), depth, dense)
    if depth > usual:
        deep = np.stack([cut_depths(c, leaf, usual, block) for c in counts])
        wide = 1 << (depth - usual)
        deep[: len(cuts)] = np.where(np.repeat(dense, wide, 1), deep[: len(cuts)], np.repeat(cuts, wide, 1))
        cuts = deep
    large = (cuts == depth) & (counts > block)
    if depth > usual:
        large[: len(dense)] &= np.repeat(dense, wide, 1)
    blocks = np.where(large, -(-counts // block), 1).astype(np.int32) if large.any() else None
    return Forest(picks(depth), depth, cuts.astype(np.uint8), blocks, hit_rates(depth, radius), recall)


def near_edges(sigs: DataFrame, n: int, radius: int = RADIUS, block: int = BLOCK, **options) -> DataFrame:
    """(a, b, n) among n distinct signatures (node, s0..s3): edges a <> b whose connected components are those of the near-duplicate pairs the forest finds, and for a = b the number of pairs that `a` is in.

    A pair is counted in the first trie that has it, so the counts of one node add up. The tries' node sizes go to the driver and their cuts to the tasks.
    """
    shared = sigs.sparkSession.sparkContext.broadcast(grow(sigs, n, radius, block=block, **options))

    def fan(batches):
        forest = shared.value
        names = ["node", "part", "side", "id", *_SIG]
        for b in batches:
            every, miss = _columns(b, 1), np.ones(b.num_rows)
            for t, pick in enumerate(forest.picks):
                on = np.flatnonzero(1 - miss < forest.recall)
                if not len(on):
                    break
                mine = pa.RecordBatch.from_arrays([c.take(pa.array(on)) for c in b.columns], ["id", *_SIG]) if len(on) < b.num_rows else b
                key = trie_keys([c[on] for c in every] if len(on) < b.num_rows else every, pick)
                d = forest.cuts[t][key].astype(np.int64)
                miss[on] *= 1 - forest.hits[d]
                name = ((key >> (forest.depth - d)).astype(tv.U64) << tv.U64(16)) | (d << 10 | t).astype(tv.U64)
                node = pa.array(tv.mix(name).view(np.int64))
                many = forest.blocks[t][key] if forest.blocks is not None else np.ones(len(on), np.int32)
                one = many == 1
                if one.all():
                    yield pa.RecordBatch.from_arrays([node, pa.array(np.zeros(len(on), np.int32)), pa.array(np.full(len(on), t << 2, np.int32)), *mine.columns], names)
                    continue
                spread = tv.mix(mine.column(0).to_numpy().view(tv.U64))
                rows = np.flatnonzero(one)
                part, side = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                for m in np.unique(many[~one]):  # each row meets every block of its node once
                    at = np.flatnonzero(many == m)
                    own = (spread[at] % tv.U64(m)).astype(np.int64)
                    other = np.tile(np.arange(m), len(at))
                    own = np.repeat(own, m)
                    rows = np.concatenate([rows, np.repeat(at, m)])
                    part = np.concatenate([part, np.minimum(own, other) * m + np.maximum(own, other)])
                    side = np.concatenate([side, np.where(own == other, 0, np.where(own < other, 1, 2))])
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([node.take(at), pa.array(part.astype(np.int32)), pa.array((t << 2 | side).astype(np.int32)), *(c.take(at) for c in mine.columns)], names)

    sig_cols = ", ".join(f"{s} long" for s in _SIG)
    rows = sigs.select("node", *_SIG).mapInArrow(fan, f"node long, part int, side int, id long, {sig_cols}")

    def verify(batches):
        held: list[pa.RecordBatch] = []

        def emit(t: pa.Table):
            ids = t["id"].to_numpy()
            sig = np.stack([t[s].to_numpy() for s in _SIG], 1).view(tv.U64)
            node, part, side = t["node"].to_numpy(), t["part"].to_numpy(), t["side"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (part[1:] != part[:-1])]))
            ends = np.append(new[1:], len(ids))
            found = [_verify(ids[s:e], sig[s:e], side[s:e] & 3, radius, int(side[s]) >> 2, shared.value.names) for s, e in zip(new, ends) if e - s > 1]
            cols = [np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            node, part = b.column("node").to_numpy(), b.column("part").to_numpy()
            other = np.flatnonzero((node != node[-1]) | (part != part[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                held.append(b.slice(0, last))
                yield emit(pa.Table.from_batches(held))
                held = []
            elif held and (held[-1].column("node")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (int(node[0]), int(part[0])):
                yield emit(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(last))
        if held:
            yield emit(pa.Table.from_batches(held))

    pairs = rows.repartition("node", "part").sortWithinPartitions("node", "part").mapInArrow(verify, "a long, b long, n long")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, **options) -> DataFrame:
    """(doc_id, text_hash, kept_id, n_links): every document that repeats another, the one of its group that stays (the least doc_id), and to how many different other texts it is linked itself.

    Groups are the connected components of near-duplicate pairs; the rows of one group share kept_id, and n_links counts signatures, so copies of one text are not
    expanded into pairs. A null doc_id, and a text that is null or has no word, is in no group. A document is an id with a text:
    rows that repeat both are one, rows that share an id only (text_hash tells them apart) are judged each by its own text; of such a pair in one group the lesser text hash stays.
    Ids are compared in their own type. Texts of any length count whole. An empty table gives no rows; other columns are not looked at.
    """
    sigs = cut(signatures(docs, shingle), "sigs")
    own = F.struct("id", "text_hash")
    same = sigs.groupBy(*_SIG).agg(F.min(own).alias("first"), F.max(own).alias("last")).select(F.monotonically_increasing_id().alias("node"), *_SIG, "first", (F.col("first") != F.col("last")).alias("more"))
    same = cut(same, "distinct")
    found = cut(near_edges(same.select("node", *_SIG), same.count(), **options), "found")
    stars = components(found.where("a <> b"), "a", "b")
    groups = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    kept = same.select("node", "first").join(groups, "node").groupBy("root").agg(F.min("first").alias("kept"))
    links = found.where("a = b").select(F.col("a").alias("node"), F.col("n").alias("n_links"))
    groups = groups.join(kept, "root").join(links, "node").select("node", "kept", "n_links")
    known = same.join(groups, "node", "left").where("kept IS NOT NULL OR more").select(*_SIG, F.coalesce("kept", "first").alias("kept"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = sigs.join(known, _SIG).where(own != F.col("kept")).select(F.col("id").alias("doc_id"), "text_hash", F.col("kept.id").alias("kept_id"), "n_links")
    out = cut(out.distinct(), "near")
    for t in (sigs, same, found, stars):
        drop_cut(t)
    return out


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that near_duplicates() finds; all columns stay as they are, whatever their names.

    Rows with a null doc_id, and texts without words, stay. Of rows that repeat both doc_id and text one
    stays, that whose columns have the least hash (rows alike in all columns are alike). Empty in, empty out.
    """
    own, text = free(docs, "_vx_id", "_vx_text")
    found = near_duplicates(docs, **options).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text))
    hashed = F.xxhash64(F.col("text").cast("string"))
    # At every size by hash: its side has 16 bytes for a document that goes, so a partition's part is small against the partition's texts, which needn't be sorted.
    left = docs.join(found.hint("shuffle_hash"), (docs["doc_id"] == found[own]) & (hashed == found[text]), "left_anti")
    twice = docs.select(F.col("doc_id").alias(own), hashed.alias(text)).where(F.col(own).isNotNull()).groupBy(own, text).count().where("count > 1").drop("count")
    twice = cut(twice, "twice")
    if twice.isEmpty():
        drop_cut(twice)
        return left
    on = (left["doc_id"] == twice[own]) & (hashed == twice[text])
    once, again = left.join(twice, on, "left_anti"), left.join(twice, on, "left_semi")
    plain = [c for c, f in zip(columns(docs), docs.schema.fields) if "map<" not in f.dataType.simpleString()]
    again = again.groupBy(F.col("doc_id").alias(own), hashed.alias(text)).agg(F.min_by(F.struct(*columns(docs)), F.xxhash64(*plain)).alias("row")).select("row.*")
    return once.unionByName(again)


def op4_simhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents over the whole documents table: (doc_id, kept_id, n_links), with the class's least id and the number of different texts it is linked to."""
    return near_duplicates(table(spark, sf_dir, "documents")).where("doc_id <> kept_id").select("doc_id", "kept_id", "n_links").distinct()
