"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedline.llm import sstable
from reedline.llm.common import groups_in_order, stored

LENGTHS = (512, 1024, 2048, 4096)
#: What a sequence costs beside its length, in tokens.
BIN_COST = 32
#: Pieces that are packed together; with more, groups are made by a hash of the document.
GROUP_PIECES = 20_000


def _fit(sizes: list[int], lengths: tuple[int, ...], cost) -> tuple[list[int], list[int], list[int]]:
    """Best-fit of sizes (in the order given, largest first) into bins; where none has room, the permitted length of least cost that holds the item is opened.

    Returns each item's bin, each bin's contents and opening length. Open bins are kept by their free space; one big integer
    has a bit for each free space that some bin has, so the tightest bin is its lowest bit from the size up.
    """
    free: dict[int, list[int]] = {}
    mask = 0
    where, used, opened = [], [], []
    for size in sizes:
        above = mask >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            stack = free[space]
            b = stack.pop()
            if not stack:
                mask ^= 1 << space
        else:
            space = min((c for c in lengths if c >= size), key=lambda c: (cost(c), c))  # noqa: B023
            b = len(used)
            used.append(0)
            opened.append(space)
        used[b] += size
        where.append(b)
        left = space - size
        if left:
            stack = free.setdefault(left, [])
            if not stack:
                mask |= 1 << left
            stack.append(b)
    return where, used, opened


def pack_sizes(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST, cost=None) -> tuple[list[int], list[int], list[int]]:
    """Pack sizes (largest first): each item's bin, each bin's contents and final length.

    A bin costs cost(length), or its length and bin_cost. The permitted lengths are optimised jointly: every set of lengths that could be opened (the
    largest always among them; of more than eight lengths, the sets that leave out one after another as long as that is cheaper) is tried, bins are
    downsized to the least costly permitted length that holds their contents, and the set with the least total cost wins (ties: the one with
    fewer lengths, then the smaller lengths).
    """
    cost = cost or (lambda c: c + bin_cost)
    lengths = tuple(sorted(set(lengths)))
    down = [min((c for c in lengths if c >= least), key=lambda c: (cost(c), c)) for least in lengths]

    def tried(some: tuple[int, ...]):
        where, used, _ = _fit(sizes, (*some, lengths[-1]), cost)
        final = [down[i] for i in np.searchsorted(lengths, used)]
        return sum(map(cost, final)), where, used, final

    if len(lengths) <= 8:
        found = [tried(some) for count in range(len(lengths)) for some in combinations(lengths[:-1], count)]
        return min(found, key=lambda f: f[0])[1:]
    some, best = lengths[:-1], tried(lengths[:-1])
    while some:
        fewer = [(some[:k] + some[k + 1 :]) for k in range(len(some))]
        now, less = min(((tried(f), f) for f in fewer), key=lambda f: f[0][0])
        if now[0] > best[0]:
            break
        best, some = now, less
    return best[1:]


def _pack(lengths: tuple[int, ...], bin_cost: int):
    def run(batches):
        for table in groups_in_order(batches, "grp"):
            grp = table.column("grp").to_numpy()
            size = table.column("length").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, grp[1:] != grp[:-1])), len(grp))
            for a, b in zip(edges[:-1], edges[1:]):
                where, used, final = (np.array(x, np.int64) for x in pack_sizes(size[a:b].tolist(), lengths, bin_cost))
                order = np.argsort(where, kind="stable")
                before = np.cumsum(size[a:b][order]) - size[a:b][order]
                first = np.searchsorted(where[order], where[order], side="left")
                offset = np.empty(b - a, np.int64)
                offset[order] = before - before[first]
                part = table.slice(a, b - a).combine_chunks()
                added = [(grp[a:b] << 32) | where, final[where].astype(np.int32), used[where].astype(np.int32), offset.astype(np.int32)]
                names = [n for n in part.column_names if n != "grp"]
                out = pa.table([*(part.column(c) for c in names), *map(pa.array, added)], names=[*names, "bin_id", "bin_length", "bin_used", "bin_offset"])
                yield from out.to_batches()

    return run


def best_fit_pack(
    spark: SparkSession, sizes: DataFrame, lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST, group_pieces: int = GROUP_PIECES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Pack documents of given sizes (doc_id, tokens) into sequences of the permitted lengths: one row a piece.

    doc_id, piece (0 on), start (first token of the piece in its document), length, the columns of carry (numbers, not null), bin_id, bin_length (the
    permitted length the bin was downsized to), bin_used, bin_offset (where the piece starts in its bin; pieces lie without gaps).

    Documents longer than the largest length are cut into pieces of that length and a rest, so no token is lost; one without tokens (or null) has no piece.
    Pieces go to groups of about `group_pieces` by a hash of document and piece, so no source, copy or long document fills a group;
    each group is packed best-fit, largest first (ties: doc_id, piece, carry). Only ids and sizes are shuffled.
    Repeated rows are packed each. An empty table gives no rows. sizes is read twice.
    """
    largest = max(lengths)
    sizes = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("long").alias("tokens"), *carry).where("tokens > 0")
    pieces = sizes.select("doc_id", "tokens", *carry, F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(largest).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("doc_id", "piece", "start", F.least(F.lit(largest), F.col("tokens") - F.col("start")).cast("int").alias("length"), *carry)
    count = sizes.agg(F.sum(F.ceil(F.col("tokens") / largest))).first()[0] or 0
    groups = max(1, -(-int(count) // group_pieces))
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "start", *carry), F.lit(groups)))
    ordered = pieces.repartition("grp").sortWithinPartitions("grp", F.desc("length"), F.col("doc_id").asc_nulls_first(), "piece", *carry)
    carried = "".join(f"{c} {sizes.schema[c].dataType.simpleString()}, " for c in carry)
    return ordered.mapInArrow(
        _pack(tuple(sorted(lengths)), bin_cost), f"doc_id long, piece int, start long, length int, {carried}bin_id long, bin_length int, bin_used int, bin_offset int"
    )


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST, group_pieces: int = GROUP_PIECES, lean: bool = False) -> DataFrame:
    """best_fit_pack of documents (doc_id, text) by the number of their token ids, an end mark included; a null or empty text has the end mark alone.

    Whole texts are encoded where they are read (see sstable.encoded for which tokenizers will do); their sizes are stored, as they are read twice.
    Other columns aren't read. lean: see sstable.encoded.
    """
    sizes = stored(spark, sstable.encoded(docs, tokenizer_path, lean=lean).select("doc_id", "tokens"), "sizes")
    return best_fit_pack(spark, sizes, lengths, bin_cost, group_pieces)


def token_sequences(spark: SparkSession, docs: DataFrame, tokenizer_path: str, lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The training sequences themselves: bin_id, bin_length, ids (array of int, as long as the bin is filled), pieces (doc_id, start, length in order).

    Ids are encoded once and stored with a number for each row, by which pieces find them; a sequence is put together from at most its length of pieces.
    """
    rows = stored(spark, sstable.encoded(docs, tokenizer_path).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    placed = best_fit_pack(spark, rows.select("doc_id", "tokens", "row"), lengths, bin_cost, group_pieces, ("row",))
    width = F.octet_length("ids") / F.col("tokens")
    part = F.substring("ids", (F.col("start") * width + 1).cast("int"), (F.col("length") * width).cast("int"))
    pieces = placed.join(rows.select("row", "ids", "tokens"), "row").select("bin_id", "bin_length", F.struct("bin_offset", "doc_id", "start", "length", F.hex(part).alias("ids"), width.cast("int").alias("width")).alias("p"))
    bins = pieces.groupBy("bin_id", "bin_length").agg(F.sort_array(F.collect_list("p")).alias("p"))
    raw, digits = F.array_join("p.ids", ""), 2 * F.col("p")[0]["width"]
    places = F.sequence(F.lit(0), (F.length(raw) / digits).cast("int") - 1)
    pair = F.transform(places, lambda k: F.substring(raw, k * digits + 1, digits))
    # little-endian: the bytes of a number in reverse
    ids = F.transform(pair, lambda x: F.conv(F.concat(*[F.substring(x, F.lit(2 * b + 1), F.lit(2)) for b in (3, 2, 1, 0)]), 16, 10).cast("int"))
    return bins.select("bin_id", "bin_length", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("pieces"))
