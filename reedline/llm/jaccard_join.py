"""Near-duplicate join on word 5-gram sets (Jaccard 0.8 or more) by chosen paths."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.llm.common import WordHashes, bounds, groups_in_order, shingle_set, small_batches, stored, tidy
from reedline.llm.components import components, forest

SIMILARITY = 0.8
TARGET_RECALL = 0.9999
#: Buckets of up to this many sets are compared by brute force, by sketches of 64 bytes; larger ones are split again.
SMALL = 1024
#: Likely links that a task holds at a time.
LIKELY = 1 << 19
#: Members of a large bucket that one task holds against those far from its pivot.
PART = 4096
#: Runs are as many as buckets of this depth need; sets that lie in deeper ones get more runs.
BASE_DEPTH = 4
#: Splits at most. Sets far from a bucket's pivot agree on a coordinate less than six times in ten, so that even 10^9 sets of one bucket need fewer.
MOST_DEPTH = 60
#: Shared tokens are sampled through this many min-hash coordinates of a set.
COORDINATES = 64
#: Sets, and shingles, that one verifying task compares within a block or between two.
BLOCK_SETS = 512
BLOCK_SHINGLES = 2_000_000
#: A group of several blocks is sorted by distance from its first set, in bands of this part of the greatest distance of a link.
BANDS = 10
#: Sets whose bands sum to this or less are surely linked, and not if the bands differ by that or more (one band of each is left for rounding).
SURE, NEVER = BANDS - 3, BANDS + 2
#: The block of a group that has only one.
WHOLE = -1

_RNG = np.random.default_rng(20240611)
_FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of COORDINATES hash functions: equal for two sets with their Jaccard similarity."""
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 8192):
        mixed = shingles[at : at + 8192, None] * _FACTORS + _SHIFTS
        out = np.minimum(out, (mixed >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return out


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Independent runs after which a pair of that similarity shared a last bucket with that probability.

    A node samples one coordinate, and with probability 1/similarity - 1 a second: 1/similarity in the mean.
    """
    second = 1 / similarity - 1
    both = 1.0
    for _ in range(depth):
        step = similarity * both
        both = (1 - second) * step + second * (1 - (1 - step) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - both))


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n, fp_hi, fp_lo, sig) of every row: number of shingles, 128-bit fingerprint of the set, min-hashes (u32 each)."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            n, hi, lo, sig = [], [], [], []
            for value in batch.column("text").to_pylist():
                shingles = shingle_set(value, known)
                n.append(len(shingles))
                digest = xxhash.xxh3_128_digest(shingles.tobytes())
                hi.append(int.from_bytes(digest[:8], "little", signed=True))
                lo.append(int.from_bytes(digest[8:], "little", signed=True))
                sig.append(min_hashes(shingles).tobytes() if len(shingles) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "text_hash", "n", "fp_hi", "fp_lo", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, text_hash long, n int, fp_hi long, fp_lo long, sig binary")


def _taken(coordinate) -> Column:
    return F.substring(F.col("sig"), coordinate * 4 + 1, F.lit(4))


def _first_paths(runs: range, similarity: float) -> Column:
    """The children of each run's root. The root is one for all sets, so its sampled coordinates are constants."""
    rng = np.random.default_rng(7)
    order = [int(c) for c in rng.permutation(COORDINATES)]
    paths, used = [], 0
    for r in range(runs.stop):
        for _ in range(1 + (rng.random() < 1 / similarity - 1)):
            c = order[used % COORDINATES]
            used += 1
            if r in runs:
                paths.append(F.xxhash64(F.lit(r), F.lit(c), _taken(F.lit(c))))
    return F.array(*paths)


def _next_paths(similarity: float) -> Column:
    """The children of a node: one sampled coordinate, or two, by a hash of the node's path, with the set's value there."""
    first = F.pmod(F.xxhash64("path", F.lit("first")), F.lit(COORDINATES))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit("second")), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    more = F.pmod(F.xxhash64("path", F.lit("more")), F.lit(10_000)) < int(10_000 * (1 / similarity - 1))
    child = [F.xxhash64("path", c, _taken(c.cast("int"))) for c in (first, second)]
    return F.when(more, F.array_distinct(F.array(*child))).otherwise(F.array(child[0]))


def _leaf_links(similarity: float):
    """In small buckets, all members are compared by their sketches; a spanning forest of the likely links is kept."""
    least = _least_sketch(similarity)

    def run(batches):
        for table in groups_in_order(batches, "path"):
            path, rep = table.column("path").to_numpy(), table.column("rep").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            links = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for step in range(1, len(path)):
                at = np.flatnonzero(path[:-step] == path[step:])
                if not len(at):
                    break
                at = at[(sketch[at] == sketch[at + step]).mean(axis=1) >= least]
                links[0].append(rep[at])
                links[1].append(rep[at + step])
                if sum(map(len, links[0])) > LIKELY:
                    links = tuple([x] for x in forest(*map(np.concatenate, links)))
            u, v = forest(*map(np.concatenate, links))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _least_sketch(similarity: float) -> float:
    """The part of equal sketch bytes that a pair of that similarity falls below with a chance of 3 in 10 million."""
    return similarity - 5 * math.sqrt(similarity * (1 - similarity) / COORDINATES)


def _like_pivot() -> Column:
    """The part of a sketch's bytes that equal the pivot's. A sketch has the first byte of each coordinate."""
    equal = [(F.substring("sig", 4 * k + 1, 1) == F.substring("pivot_sig", 4 * k + 1, 1)).cast("int") for k in range(COORDINATES)]
    return reduce(Column.__add__, equal) / COORDINATES


def _against_far(similarity: float):
    """Rows of buckets (path, part), the far members first in one row: every member held against each far one. Of near members, which are linked to each other already, one link to each far one is enough."""
    least = _least_sketch(similarity)

    def run(batches):
        at = reps = sketches = None
        for batch in batches:
            u, v = [], []
            path, part, first, rep = (batch.column(c).fill_null(0).to_numpy() for c in ("path", "part", "first", "rep"))
            near = batch.column("near").fill_null(False).to_numpy(zero_copy_only=False)
            edges = bounds(path, part)
            for a, b in zip(edges[:-1], edges[1:]):
                if first[a] == 0:
                    at, far = (path[a], part[a]), batch.column("far")[int(a)].as_py()
                    reps, sketches = np.array([x["rep"] for x in far]), np.frombuffer(b"".join(x["sketch"] for x in far), np.uint8).reshape(-1, COORDINATES)
                    a += 1
                if a == b:
                    continue
                if at != (path[a], part[a]):
                    raise ValueError("a bucket without its far members")
                mine = np.frombuffer(b"".join(batch.column("sketch").slice(int(a), int(b - a)).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                told = np.zeros(len(reps), bool)
                for c in range(0, len(mine), 64):  # times SMALL and COORDINATES: 4 MB
                    like = (mine[c : c + 64, None, :] == sketches[None, :, :]).mean(axis=2) >= least
                    close = near[a + c : a + c + len(like)]
                    one = np.flatnonzero((like & close[:, None]).any(axis=0) & ~told)
                    told[one] = True
                    x, y = np.nonzero(like & ~close[:, None])
                    u += [*rep[a + c + (like & close[:, None])[:, one].argmax(axis=0)], *rep[a + c + x]]
                    v += [*reps[one], *reps[y]]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _few_far(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of the buckets with at most SMALL members far from the pivot: those against all members, in parts of PART. rows: path, rep, near, held (the bucket's members)."""
    rows = rows.withColumn("parts", F.ceil(F.col("held") / PART).cast("long")).join(sets.select("rep", "sketch"), "rep")
    far = rows.where("not near").groupBy("path", "parts").agg(F.collect_list(F.struct("rep", "sketch")).alias("far"))  # at most SMALL
    leads = far.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("first"), "far")
    rows = rows.select("path", F.pmod(F.xxhash64("rep"), "parts").alias("part"), F.lit(1).alias("first"), "rep", "near", "sketch")
    both = leads.unionByName(rows, allowMissingColumns=True).repartition("path", "part").sortWithinPartitions("path", "part", "first")
    return both.mapInArrow(tidy(_against_far(similarity)), "u long, v long")


def _descend(spark: SparkSession, sets: DataFrame, similarity: float, runs: range) -> tuple[dict[str, list[DataFrame]], DataFrame | None, int]:
    """Some chosen-path runs over sets (rep, sig), level by level: what they end with, the sets that lay in buckets too large at BASE_DEPTH (None: none did), and the depth.

    A bucket of at most SMALL sets ends and is compared by brute force, one with a single set is dropped, a larger one is split again by coordinates that its own path samples. First all members of a
    large bucket are held against one of them, the pivot: those near it by sketches are linked to it. Where none is far from it, they are one group for the exact check, and the bucket ends; where at most SMALL
    are, those are held against all members, and it ends too; else the far ones are split again, and the near ones that aren't alike the pivot with them. A set alike
    the pivot has no link to a set far from it, since distances of Jaccard similarity add up. Ends: small (path, rep), links (u, v), large (path, rep, near, held), and few (path) of those that end with few far members, tables of each level.

    The first paths go without their sets' min-hashes; members of large buckets take theirs along from level to level, so a level is one aggregation and one join by path, and a count of the far ones.
    """
    ends: dict[str, list[DataFrame]] = {"small": [], "links": [], "large": [], "few": []}
    paths = sets.select("rep", F.explode(_first_paths(runs, similarity)).alias("path"))
    shared = stored(spark, paths.join(paths.groupBy("path").agg(F.count("*").alias("held")).where("held > 1"), "path"), "paths")
    ends["small"].append(shared.where(F.col("held") <= SMALL).select("path", "rep"))
    large = shared.where(F.col("held") > SMALL).select("path", "rep")
    if large.isEmpty():
        return ends, None, 1
    rows = stored(spark, large.join(sets.select("rep", "sig"), "rep").select("path", "rep", "sig"), "large")
    deep = None
    for depth in range(1, MOST_DEPTH + 1):
        pick = F.min(F.struct(F.col("rep").bitwiseXOR(F.col("path")).alias("place"), "sig"))  # another order in each bucket
        held = rows.groupBy("path").agg(F.count("*").alias("held"), pick.alias("pick")).where("held > 1")
        held = held.select("path", "held", F.col("pick.place").bitwiseXOR(F.col("path")).alias("pivot"), F.col("pick.sig").alias("pivot_sig"))
        both = rows.join(held, "path").withColumn("like", F.when(F.col("held") > SMALL, _like_pivot()))
        near, open_ = F.col("like") >= _least_sketch(similarity), F.col("like") < similarity
        placed = both.select("path", "rep", "held", "pivot", near.alias("near"), open_.alias("open"), F.when(open_, F.col("sig")).alias("sig"))
        placed = stored(spark, placed, f"pivots-{depth}")
        if depth > 1:
            ends["small"].append(placed.where(F.col("held") <= SMALL).select("path", "rep"))
        large = placed.where(F.col("held") > SMALL)
        if depth == MOST_DEPTH:  # the exact check tells them apart
            ends["links"].append(large.select(F.col("rep").alias("u"), F.col("pivot").alias("v")))
            break
        ends["links"].append(large.where("near").select(F.col("rep").alias("u"), F.col("pivot").alias("v")))
        far = large.groupBy("path").agg(F.count_if(~F.col("near")).alias("far")).where("far > 0")
        far = stored(spark, far, f"far-{depth}")  # a row a large bucket
        ends["large"].append(large.select("path", "rep", "near", "held"))
        ends["few"].append(far.where(F.col("far") <= SMALL).select("path"))
        more = far.where(F.col("far") > SMALL).select("path")
        if more.isEmpty():
            break
        split = large.where("open").join(more, "path", "left_semi").select("path", "rep", "sig")
        if depth == BASE_DEPTH:
            deep = split.select("rep").distinct()
        rows = split.select("rep", "sig", F.explode(_next_paths(similarity)).alias("path"))
    return ends, deep, depth


def candidate_links(spark: SparkSession, reps: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Links (u, v) whose components hold every pair that shared a last bucket of some run: chosen-path recursion (see _descend), as deep as buckets are large.

    The runs that buckets of BASE_DEPTH need are made over all sets. A pair of similar sets whose bucket is still too large there shares it in some run (with the target's probability), so both are
    among the sets that have come so far, and those sets alone go through the further runs that the depth reached calls for.
    """
    first = runs_for(recall, similarity, BASE_DEPTH)
    ends, deep, depth = _descend(spark, reps, similarity, range(first))
    if deep is not None:
        again = stored(spark, reps.join(deep, "rep", "left_semi").select("rep", "sig"), "deep-sets")
        more = _descend(spark, again, similarity, range(first, max(first + 1, runs_for(recall, similarity, depth))))[0]
        ends = {name: ends[name] + more[name] for name in ends}
    # buckets of all levels are compared together: paths are hashes, no two levels share one
    every = {name: reduce(DataFrame.unionByName, tables) for name, tables in ends.items() if tables}
    small = every["small"].join(reps.select("rep", "sketch"), "rep").select("path", "rep", "sketch")
    links = small.repartition("path").sortWithinPartitions("path", "rep").mapInArrow(tidy(_leaf_links(similarity)), "u long, v long")
    if "links" in every:
        links = links.unionByName(every["links"])
    if "few" in every:
        links = links.unionByName(_few_far(every["large"].join(every["few"], "path", "left_semi"), reps, similarity))
    return links.where("u <> v")


def _compare(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Whether each set of a is at least that similar to each of b (or of a): exact, through shared-token counts."""
    every = sets_a if sets_b is None else [*sets_a, *sets_b]
    sizes = np.array([len(s) for s in every])
    owner = np.repeat(np.arange(len(every)), sizes)
    tokens, token, held = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    rank = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[token]
    owner, rank = owner[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    owner, rank = owner[order], rank[order]
    na = len(sets_a)
    common = np.zeros((na, len(every) - na if sets_b is not None else na), np.float32)
    width = int(min(4096, max(256, (1 << 23) // max(1, len(every)))))
    for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        a, b = np.searchsorted(rank, [at, at + width])
        block = np.zeros((len(every), width), np.float32)
        block[owner[a:b], rank[a:b] - at] = 1
        common += block[:na] @ (block[na:] if sets_b is not None else block).T
    other = sizes[na:] if sets_b is not None else sizes
    return common >= similarity * (sizes[:na, None] + other[None, :] - common) - 1e-6


def _verify(similarity: float):
    def run(batches):
        known = WordHashes()
        for table in groups_in_order(batches, "comp", "i", "j"):
            comp, i, j, block, rep, copies = (table.column(c).to_numpy() for c in ("comp", "i", "j", "block", "rep", "copies"))
            texts = table.column("text")
            out_rep, out_links, out_root, out_whole = [], [], [], []
            edges = bounds(comp, i, j)
            for a, b in zip(edges[:-1], edges[1:]):
                mine = a + np.flatnonzero(np.append(True, rep[a + 1 : b] != rep[a : b - 1]))  # a repeated row once
                sets = [shingle_set(texts[int(k)].as_py(), known) for k in mine]
                within = i[a] == j[a]
                first = int((block[mine] == i[a]).sum())
                if not within and first in (0, len(mine)):
                    continue
                near = np.zeros((len(mine), len(mine)), bool)
                if within:
                    near[:] = _compare(sets, None, similarity)
                    np.fill_diagonal(near, False)
                else:
                    near[:first, first:] = _compare(sets[:first], sets[first:], similarity)
                    near |= near.T
                links = near.astype(np.float64) @ copies[mine].astype(np.float64)
                root = _roots(near, rep[mine])
                at = np.flatnonzero(links > 0)
                out_rep += rep[mine][at].tolist()
                out_links += links[at].astype(np.int64).tolist()
                out_root += root[at].tolist()
                out_whole += [bool(i[a] == WHOLE)] * len(at)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((out_rep, out_links, out_root, out_whole), types)], ["rep", "links", "root", "whole"])

    return run


def _roots(near: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The least id of each node's component."""
    root = np.full(len(rep), -1, np.int64)
    for start in np.argsort(rep, kind="stable"):
        if root[start] >= 0:
            continue
        stack = [start]
        root[start] = start
        while stack:
            more = np.flatnonzero(near[stack.pop()] & (root < 0))
            root[more] = start
            stack.extend(more.tolist())
    return rep[root]


def _bands(similarity: float):
    """Each set of a large group with its band, and its link to the group's first set if there is one: (rep, comp, copies, n, band, linked)."""

    def run(batches):
        known = WordHashes()
        first = at = None
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("comp", "part", "place", "rep", "copies", "n", "text")))
            for comp, part, place, rep, copies, n, text in rows:
                if (comp, part, place, rep) == at:  # a repeated row
                    continue
                at, found = (comp, part, place, rep), shingle_set(text, known)
                if not place:  # the first set leads each part
                    first = found
                    continue
                common = len(np.intersect1d(first, found, assume_unique=True))
                both = len(first) + len(found) - common
                distance = (both - common) / both
                out.append((rep, comp, copies, n, int(distance * BANDS / (1 - similarity)), common >= similarity * both - 1e-6))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, types)], ["rep", "comp", "copies", "n", "band", "linked"])

    return run


def _large_groups(spark: SparkSession, members: DataFrame, texts: DataFrame, similarity: float, block_sets: int) -> tuple[DataFrame, DataFrame]:
    """For groups of several blocks: (work, known), blocks to compare, and links that need no comparing.

    The distance of Jaccard similarity is a metric: sets that both lie near the first one are linked to each other, sets at very different
    distances from it are not. So the sets are cut into blocks by band; two blocks are counted whole, passed over, or compared. members: comp, rep,
    copies, n, blocks. work: comp, rep, copies, block, tasks (i, j). known: rep, links, root, whole.
    """
    part = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    leads = members.where("rep = comp").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("part"), F.lit(0).alias("place"))
    rows = leads.unionByName(members.select("*", part.alias("part"), F.lit(1).alias("place")))
    rows = rows.hint("merge").join(texts, "rep").select("comp", "part", "place", "rep", "copies", "n", "text")
    rows = rows.repartition("comp", "part").sortWithinPartitions("comp", "part", "place", "rep")
    placed = stored(spark, rows.mapInArrow(tidy(_bands(similarity)), "rep long, comp long, copies long, n int, band long, linked boolean"), "bands")
    sizes = placed.groupBy("comp", "band").agg(F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("subs"))
    sets = stored(
        spark,
        placed.join(sizes, ["comp", "band"]).select("comp", "rep", "copies", "band", "linked", F.expr("shiftleft(band, 32) + pmod(xxhash64(rep), subs)").alias("block")),
        "blocks",
    )
    blocks = stored(spark, sets.groupBy("comp", "block", "band").agg(F.sum("copies").alias("copies")), "block-sizes")
    other = blocks.select("comp", F.col("block").alias("block2"), F.col("band").alias("band2"), F.col("copies").alias("copies2"))
    near = blocks.join(other, "comp").where(F.abs(F.col("band") - F.col("band2")) < NEVER)
    sure = F.col("band") + F.col("band2") <= SURE
    counted = near.where(sure).groupBy("comp", "block", "band").agg(F.sum("copies2").alias("others"))
    mine = F.when(2 * F.col("band") <= SURE, F.col("copies")).otherwise(0)
    known = sets.join(counted, ["comp", "block", "band"], "left").select(
        "rep", F.coalesce(F.col("others") - mine, F.lit(0)).cast("long").alias("links"), F.when(F.col("linked"), F.col("comp")).otherwise(F.col("rep")).alias("root"), F.lit(False).alias("whole")
    )
    pair = F.struct(F.least("block", "block2").alias("i"), F.greatest("block", "block2").alias("j"))
    tasks = near.where(~sure).groupBy("comp", "block").agg(F.collect_list(pair).alias("tasks"))  # at most one a block
    return sets.join(tasks, ["comp", "block"]).select("comp", "rep", "copies", "block", "tasks"), known


def near_duplicates(
    spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, recall: float = TARGET_RECALL, block_sets: int = BLOCK_SETS, text: str = "text"
) -> DataFrame:
    """Every document with the class of its near-duplicates: doc_id, class_id, n_links, n_shingles.

    Texts are sets of lower-cased runs of five words (all words, if fewer); two are linked when their Jaccard similarity is at least
    `similarity`. class_id is the least doc_id that links lead to, n_links the number of other documents linked to it, equal
    sets included. Texts with equal sets are one node throughout. Chosen paths (see candidate_links) give candidate groups, whose sets are then
    compared exactly, in tasks of one block of sets or two, which return counts and a forest, not pairs; in groups of several
    blocks only those blocks meet whose distances from the group's first set leave open whether they are linked (see _large_groups).
    Recall of links at the threshold is meant to be `recall`, of closer pairs higher; no pair below the threshold is linked.

    A null, empty or wordless text has no links and its own id as class. Rows that repeat a doc_id with other texts, and rows without doc_id, are
    documents like others; class_id is null where no document of a class has an id. An empty table gives no rows. Other columns aren't read.
    """
    small_batches(spark)
    signed = stored(spark, signatures(docs, text), "signatures")
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")).alias("pick")
    reps = signed.where("n > 0").groupBy("fp_hi", "fp_lo", "n", "sig").agg(pick, F.count("*").alias("copies"), F.min("doc_id").alias("least_id"))
    sketch = F.concat(*[F.substring(F.col("sig"), F.lit(4 * k + 1), F.lit(1)) for k in range(COORDINATES)])
    number = F.monotonically_increasing_id().alias("rep")  # stored with the sets, so it stays
    reps = stored(spark, reps.select("*", "pick.doc_id", "pick.text_hash", sketch.alias("sketch"), number).drop("pick"), "sets")
    groups = components(spark, candidate_links(spark, reps, similarity, recall))
    groups = stored(spark, groups.join(reps.select(F.col("rep").alias("node"), "copies", "n", "doc_id", "text_hash"), "node"), "groups")
    sizes = groups.groupBy("root").agg(
        F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    members = groups.join(sizes, "root").select(F.col("root").alias("comp"), F.col("node").alias("rep"), "copies", "n", "blocks")
    zero = F.lit(0).cast("long")
    only = F.lit(WHOLE).cast("long")
    one = F.array(F.struct(only.alias("i"), only.alias("j")))
    work = members.where("blocks = 1").select("comp", "rep", "copies", only.alias("block"), one.alias("tasks"))
    # the text of each set, from one row that has it. Always a merge join: the candidates grow with the documents, so they are never sent to all executors
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))
    wanted = groups.select(F.col("node").alias("rep"), "doc_id", "text_hash").hint("merge")
    texts = wanted.join(rows, wanted["doc_id"].eqNullSafe(rows["_id"]) & (wanted["text_hash"] == rows["_hash"])).select("rep", "text")
    several = not members.where("blocks > 1").isEmpty()
    if several:
        texts = stored(spark, texts, "texts")
        more, known = _large_groups(spark, members.where("blocks > 1"), texts, similarity, block_sets)
        work = work.unionByName(more)
    work = work.hint("merge").join(texts, "rep").select("comp", "rep", "copies", "block", "text", F.explode("tasks").alias("task"))
    work = work.select("comp", "task.i", "task.j", "block", "rep", "copies", "text")
    work = work.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "block", "rep")
    found = work.mapInArrow(tidy(_verify(similarity)), "rep long, links long, root long, whole boolean")
    checked = stored(spark, found.unionByName(known) if several else found, "links")
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if several:  # classes that span blocks meet through their shared sets
        met = components(spark, checked.where("not whole").select(F.col("rep").alias("u"), F.col("root").alias("v")))
        links = links.join(met.select(F.col("node").alias("rep"), F.col("root").alias("met")), "rep", "left").where("links > 0")
        links = links.select("rep", "links", F.coalesce("met", "root").alias("root"))
    links = links.join(reps.select("rep", "least_id"), "rep")
    named = links.groupBy("root").agg(F.min("least_id").alias("class_id"))
    links = links.join(named, "root").select("rep", "links", "class_id")
    of_set = reps.join(links, "rep", "left").select("fp_hi", "fp_lo", "copies", "links", F.coalesce("class_id", "least_id").alias("class_id"))
    return signed.join(of_set, ["fp_hi", "fp_lo"], "left").select(
        "doc_id",
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.coalesce("links", zero) + F.col("copies") - 1).otherwise(zero).alias("n_links"),
        F.col("n").alias("n_shingles"),
    )
