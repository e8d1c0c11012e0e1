"""Token ids of documents as sorted-string-table shards.

A shard file holds documents in key order:

    data blocks   entries: varint shared key bytes, varint other key bytes, varint value bytes, the other key bytes, the value;
                  the first entry of a block shares nothing; after the entries the CRC-32 of the block
    Bloom filter  bits over the keys
    index         one row a block: last key (varint length, bytes), offset, length (u64 each)
    footer        offsets and lengths of filter and index, entries, tokens, number of hashes, bytes of an id (u64 each), magic

All numbers are little-endian. A key is a document id as 8 big-endian bytes with the sign bit turned, so byte order is number
order; a null id is the empty key and comes first. A value is the document's ids, two bytes each if the vocabulary allows, else four.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedline.llm.common import fresh_path, small_batches, tidy

MAGIC = b"RDLSST01"
FOOTER = struct.Struct("<8Q8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS = 10
BLOOM_HASHES = 7
#: A shard has about so many rows or bytes of text at most.
SHARD_ROWS, SHARD_BYTES = 100_000, 32 << 20
END_ID = 1
#: Text that is encoded at once.
SLICE_BYTES = 2 << 20
KNOWN_CHUNKS = 1_000_000
KNOWN_WORDS = 700_000
#: The same for a worker that should stay small; it forgets all when a task ends.
LEAN = 150_000
#: Latin letters, then marks without an apostrophe: the tokenizer lowers the letters and takes both parts as one word each.
_WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-&(-/:-@\[-`{-~]*)")
#: Null ids count as the least number where ranges are sought; in the files they are the empty key.
NULL_ID = -(1 << 63)
#: In each Python worker, for one run of write_shards: the tokenizer and the ids of chunks seen. The tasks of that run share them; another run starts anew.
_SEEN: dict = {}


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 0x7F) << shift
        if byte < 0x80:
            return n, at
        shift += 7


def _places(keys: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """The filter bits of integer keys: double hashing, keys x hashes."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


def _number(key: bytes) -> int:
    return int.from_bytes(key, "big") if key else 0


class ShardWriter:
    """Writes entries in key order to an open file; memory: one block, the index and the keys as numbers."""

    def __init__(self, out, width: int = 4, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at, self.tokens, self.last = 0, 0, b""
        self.block, self.index, self.keys = bytearray(), [], []

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys must come in order")
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(_number(key))
        self.tokens += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._end_block()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _end_block(self) -> None:
        if self.block:
            self.index.append((self.last, self.at, len(self.block) + 4))
            self._put(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        bits = max(64, len(self.keys) * BLOOM_BITS)
        flags = np.zeros(-(-bits // 8) * 8, bool)
        flags[_places(np.array(self.keys, np.uint64), bits, BLOOM_HASHES).ravel()] = True
        bloom_at, bloom = self.at, struct.pack("<Q", bits) + np.packbits(flags, bitorder="little").tobytes()
        self._put(bloom)
        index_at = self.at
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", o, n) for k, o, n in self.index)
        self._put(index)
        self._put(FOOTER.pack(bloom_at, len(bloom), index_at, len(index), len(self.keys), self.tokens, BLOOM_HASHES, self.width, MAGIC))


class ShardReader:
    """Reads a shard: whole, in order, or one key by filter, index and one block."""

    def __init__(self, source, size: int):
        self.source = source
        foot = self._at(size - FOOTER.size, FOOTER.size)
        bloom_at, bloom_n, index_at, index_n, self.entries, self.tokens, self.hashes, self.width, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom_at, self.bloom_n, self.bloom = bloom_at, bloom_n, None
        data, at, self.last_keys, self.blocks = self._at(index_at, index_n), 0, [], []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.last_keys.append(data[at : at + n])
            self.blocks.append(struct.unpack_from("<QQ", data, at + n))
            at += n + 16

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def block(self, k: int):
        """Entries (key, value) of block k."""
        raw = self._at(*self.blocks[k])
        data, check = raw[:-4], struct.unpack("<I", raw[-4:])[0]
        if zlib.crc32(data) != check:
            raise ValueError(f"block {k} is damaged")
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + size]
            at += size

    def __iter__(self):
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            raw = self._at(self.bloom_at, self.bloom_n)
            self.bits = struct.unpack_from("<Q", raw)[0]
            self.bloom = np.frombuffer(raw, np.uint8, offset=8)
        at = _places(np.array([_number(key)], np.uint64), self.bits, self.hashes).ravel()
        return bool(((self.bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all())

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def lookup(self, key: bytes) -> list[bytes]:
        """All values of a key (repeated rows have several); none if it isn't there."""
        found = []
        if self.may_hold(key):
            k = bisect_left(self.last_keys, key)
            while k < len(self.blocks):
                entries = list(self.block(k))
                found += [v for x, v in entries if x == key]
                if entries[-1][0] > key:
                    break
                k += 1
        return found


def _word_ids(tokenizer, words: list[str], width: int, pretokenized: bool) -> list[bytes]:
    """The ids of each word, from one call: word_ids names the word of each token. Words of _WORD need no cutting, others come pretokenized."""
    found = tokenizer.encode(words if pretokenized else " ".join(words), is_pretokenized=pretokenized, add_special_tokens=False)
    counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))
    raw, ends = np.array(found.ids, f"<u{width}").tobytes(), (np.cumsum(counts) * width).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class ChunkIds(dict):
    """chunk between blanks -> its ids as bytes; encodes what is new in one call and forgets all beyond a fixed number."""

    def __init__(self, tokenizer, width: int, lean: bool = False):
        super().__init__({"": b""})
        self.tokenizer, self.width, self.words = tokenizer, width, {"": b""}
        self.most, self.most_words = (LEAN, LEAN) if lean else (KNOWN_CHUNKS, KNOWN_WORDS)

    def bound(self) -> None:
        if len(self) > self.most:
            self.clear()
            self[""] = b""

    def learn(self, new: list[str]) -> None:
        if len(self.words) > self.most_words:
            self.words = {"": b""}
        parts, other = [], []
        for chunk in new:
            if found := _WORD.fullmatch(chunk):
                parts.append((chunk, found[1].lower(), found[2]))
            else:
                other.append(chunk)
        wanted = list({w for _, *two in parts for w in two}.difference(self.words))
        for words, into, cut in ((wanted, self.words, False), (other, self, True)):
            for k in range(0, len(words), 1024):
                into.update(zip(words[k : k + 1024], _word_ids(self.tokenizer, words[k : k + 1024], self.width, cut)))
        known = self.words
        for chunk, word, marks in parts:
            self[chunk] = known[word] + known[marks] if marks else known[word]


#: Texts that show whether a tokenizer drops white space and treats chunks between blanks, and Latin letters and marks, on their own.
_PROBES = ("a b", " a  b\tc\nd ", "It's IT, it's... (so) x-y", "Ab,c d;", "Straße Éa. — 日本 x1", "word" * 30 + " end")


def checked_tokenizer(path: str):
    """The tokenizer of a file, if ids of chunks between blanks may be joined to those of the whole text; else ValueError."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    if any(re.search(r"[\s\u0120\u2581][A-Za-z]{2}", t) for t in found.get_vocab()):
        raise ValueError("the tokenizer has tokens with white space")

    def ids(text: str) -> list[int]:
        return found.encode(text, add_special_tokens=False).ids

    for text in _PROBES:
        parts = list(chain.from_iterable(ids(m) for c in text.split() for m in ((_WORD.fullmatch(c) or (None, c, ""))[k] for k in (1, 2)) if m))
        if ids(text) != parts:
            raise ValueError("the tokenizer's tokens depend on what stands beyond a blank or a mark")
    return found


def _slices(batch: pa.RecordBatch):
    """A batch in slices of about SLICE_BYTES of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    group = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _cut_text(text: str):
    """A very long text in pieces that end at blanks."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = max(text.rfind(c, at, at + SLICE_BYTES) for c in " \t\n\r")
        if cut <= at:
            break  # one chunk without a blank
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _encoded(known: ChunkIds, texts: pa.Array, width: int, end: bytes) -> list[bytes]:
    """The ids of each text with the end mark. Each distinct chunk between blanks is looked up once; ids are then gathered for all places at once."""
    if len(texts) == 1 and texts[0].is_valid and len(text := texts[0].as_py()) > SLICE_BYTES and len(pieces := list(_cut_text(text))) > 1:
        return [b"".join(_encoded(known, pa.array([piece]), width, b"")[0] for piece in pieces) + end]
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    chunks = lists.flatten().dictionary_encode()
    distinct = chunks.dictionary.to_pylist()
    known.bound()
    if new := list(filterfalse(known.__contains__, distinct)):
        known.learn(new)
    found = list(map(known.__getitem__, distinct))
    kind = f"<u{width}"
    flat = np.frombuffer(b"".join(found), kind)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
    starts = np.cumsum(sizes) - sizes
    at = chunks.indices.to_numpy()
    n = sizes[at]
    ends = np.cumsum(n)
    ids = flat[np.repeat(starts[at] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)] if len(flat) else flat
    edges = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
    raw = ids.astype(kind, copy=False).tobytes()
    return [raw[a * width : b * width] + end for a, b in zip(edges[:-1], edges[1:])]


def _tokens(tokenizer_path: str, end_id: int, width: int, name: str, cuts: list[int] = (), shares: list[int] = (), lean: bool = False):
    """Encode texts where they are read, and find each document's shard from the limits of the key ranges.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its chunks between blanks, in order. The library
    encodes a chunk once and its ids are remembered by the worker, up to a fixed number, until the run `name` ends. A chunk of Latin letters
    and marks is put together from the ids of its two parts. The rows of an id that fills several ranges (shares) are dealt over as many shards by a hash.
    """

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        from reedline.llm import sstable

        if name not in sstable._SEEN:
            sstable._SEEN.clear()
            sstable._SEEN[name] = ChunkIds(Tokenizer.from_file(tokenizer_path), width, lean)
        known = sstable._SEEN[name]
        limits, end = np.array(cuts, np.int64), np.array([end_id], f"<u{width}").tobytes()
        share = np.array([*shares, 1], np.int64)
        base = np.cumsum(share) - share
        for batch in batches:
            for rows in _slices(batch):
                doc_id = rows.column("doc_id")
                values = _encoded(known, rows.column("text"), width, end)
                ids = np.array([x if x is not None else NULL_ID for x in doc_id.to_pylist()], np.int64)
                where = np.searchsorted(limits, ids, side="left")
                at_limit = np.append(limits, 0)[where] == ids
                shard = base[where] + np.where(at_limit, rows.column("spread").to_numpy() % share[where], 0)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), doc_id, pa.array(values, pa.binary())], ["shard", "doc_id", "ids"])
        if lean:
            sstable._SEEN.clear()

    return run


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("spread"))


def _width(tokenizer, end_id: int) -> int:
    return 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, lean: bool = False) -> DataFrame:
    """doc_id, ids (binary) and tokens (how many) of every row, the end mark included; encoded where the texts are read.

    With lean, workers remember less and nothing beyond a task: slower, for jobs whose other steps need the memory.
    """
    small_batches(docs.sparkSession)
    width = _width(checked_tokenizer(tokenizer_path), end_id)
    run = _tokens(tokenizer_path, end_id, width, uuid.uuid4().hex, lean=lean)
    rows = _source(docs).mapInArrow(tidy(run) if lean else run, "shard int, doc_id long, ids binary")
    return rows.select("doc_id", "ids", (F.octet_length("ids") / width).cast("long").alias("tokens"))


def _write(folder: str, width: int):
    """Writes each shard under a name of its own, then moves it to its place, so a task that runs again or twice does no harm."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        writer = out = at = part = None

        def end():
            writer.close()
            out.close()
            done = f"{root}/shard-{at:08d}.sst"
            fs.move(part, done)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([len(writer.keys)], pa.int64()), pa.array([writer.tokens], pa.int64())], ["shard", "entries", "tokens"])

        for batch in batches:
            for shard, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids"))):
                if shard != at:
                    if writer:
                        yield end()
                    at, part = shard, f"{root}/.part-{shard:08d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(part)
                    writer = ShardWriter(out, width)
                writer.add(key_of(doc_id), ids)
        if writer:
            yield end()

    return run


def _read(folder: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, before in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist()):
                path = f"{root}/shard-{shard:08d}.sst"
                with fs.open_input_file(path) as source:
                    rows, start = [], before
                    reader = ShardReader(source, fs.get_file_info(path).size)
                    for key, value in reader:
                        ids = reader.ids(value)
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids), shard))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return run


def _rows(rows):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def write_shards(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Encode every whole text and write the shards to `folder`; returns the stored manifest: shard, entries, tokens.

    The tokenizer must be one whose tokens never span or hold white space; another is refused (see checked_tokenizer).

    Texts are encoded where they are read; only the ids are shuffled, each shard's key range to one task, which sorts and streams them
    to its file. The number of ranges follows rows and bytes of text, their limits are quantiles of doc_id from a scan of that column alone. An id,
    or rows without one, that fills several ranges gets as many shards, its rows dealt by a hash of the text.
    """
    width = _width(checked_tokenizer(tokenizer_path), end_id)
    rows = _source(docs)
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    wanted = max(spark.sparkContext.defaultParallelism * 2, -(-count // shard_rows), -(-size // shard_bytes))
    places = [k / wanted for k in range(1, wanted)] or [0.5]
    found = rows.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(NULL_ID)), places, min(100 * wanted, 1 << 20))).first()[0] or []
    cuts = sorted(set(found))
    shares = [found.count(c) for c in cuts] if len(cuts) < len(found) else [1] * len(cuts)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    out = rows.mapInArrow(_tokens(tokenizer_path, end_id, width, uuid.uuid4().hex, cuts, shares), "shard int, doc_id long, ids binary")
    owned = out.repartition(sum(shares) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    owned.mapInArrow(_write(folder, width), "shard int, entries long, tokens long").write.parquet(f"{folder}/manifest")
    return spark.read.schema("shard int, entries long, tokens long").parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard."""
    before = F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("shard", before.cast("long").alias("before"))
    files = files.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, "shard")
    return files.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def lookup(folder: str, shard: int, doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document from one shard file: filter, binary search in the index, one block."""
    fs, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/shard-{shard:08d}.sst"
    with fs.open_input_file(path) as source:
        reader = ShardReader(source, fs.get_file_info(path).size)
        return [reader.ids(v) for v in reader.lookup(key_of(doc_id))]


def token_table(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, str]:
    """Write shards to the shared folder and read them back; returns (rows, folder).

    Rows: doc_id, start, n_tokens (with the end mark), ids_crc32 (of the ids as little-endian u32), shard; documents count in ascending doc_id
    order, null ids first, repeated ids ordered by shard and their token bytes. A null or empty text is the end mark alone. An empty table
    writes no shard. Other columns are not read.
    """
    folder = fresh_path(spark, "token-shards")
    manifest = write_shards(spark, docs, tokenizer_path, folder, end_id, shard_rows)
    return read_shards(manifest, folder), folder
