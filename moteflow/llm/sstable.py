"""Sorted-string-table shards of token ids.

A shard is one file with, in this order, each followed by one newline byte of framing:
data blocks, the sparse index (first key, offset and length of each block), the Bloom filter over all keys, and a footer of
fixed length, which holds the shard's first and last key too: a lookup reads footers, then the index and the filter of the one
shard whose keys reach over its own, then single blocks, all by offset. A block holds entries (shared, unshared, value length as varints; key suffix; value) whose keys are
prefix-compressed against the previous key of the block; it is zstd-compressed and carries a crc32. A value is one byte of
width (2 or 4) and the little-endian ids. Keys are big-endian and order-preserving, so files sort as their ids do.

The blocks leave the tasks as rows of Spark's own file writer: commit, retry and any Hadoop file system come from there.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import IdStore, byte_symbols
from .common import ending, filesystem, own_columns, slices, tokenizer_path

MAGIC = b"SSTABLE2"
FOOTER = struct.Struct(">QQQQQQQ9s9s8s")  # index offset, index length, Bloom offset, Bloom length, entries, ids, shard; first and last key, each after its length; magic
HEAD = struct.Struct("<II")  # of a block: raw length, crc32 of the compressed bytes
CACHE_WORDS, CACHE_IDS = 400_000, 8_000_000
SHARD_BYTES = 64 << 20  # of text, on the average of a write
#: Fixed values of this vocabulary: its normaliser, and the pattern of its pre-tokenizer.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encode_key(key: int | None) -> bytes:
    """Null sorts first, as the empty key; integers as big-endian bytes with the sign bit flipped."""
    return b"" if key is None else struct.pack(">Q", key + (1 << 63))


def decode_key(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


class WordEncoder:
    """Texts to ids by the tokenizers library, each distinct word run through its merges once.

    With this vocabulary's normaliser and pattern, what stands between blanks and newlines is encoded independently of the rest:
    white space becomes blanks and pieces never hold any. Words of letters below U+0180 are normal-form already: they are
    lower-cased and split here, and their pieces go to the library's BPE model; any other word goes through the library's whole
    pipeline. With another file every whole text does. Arrow splits the texts and finds a batch's distinct words; ids are copied
    by numpy. The memory of words is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = [p.get("pattern") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_words = (spec["normalizer"] or {}).get("normalizers") == NORMALIZER and {"Regex": WORD_PATTERN} in split
        self.kind = "<u2" if self.tok.get_vocab_size() <= 0xFFFF else "<u4"
        self.pattern = regex.compile(WORD_PATTERN + "|\n")
        self.simple = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]*").fullmatch
        self.simple_text = re.compile("[\n -~\u00a1-\u012f\u0131-\u017f]*").fullmatch
        self.shown = {b: c for c, b in byte_symbols().items()}
        self.clear_words()
        self.clear_pieces()

    def clear_words(self) -> None:
        self.words, self.known = IdStore(self.kind), {}

    def clear_pieces(self) -> None:
        self.parts, self.pieces = IdStore(self.kind), {"\n": 0}  # what separates words has no ids
        self.parts.append(np.zeros(0, self.kind), np.zeros(1, np.int64))

    def number(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces in the store of pieces; new ones go through the library's model."""
        known, ids, sizes = self.pieces, [], []
        tokenize, shown = self.tok.model.tokenize, self.shown
        for p in pieces:
            if p not in known:
                known[p] = len(known)
                got = [t.id for t in tokenize(p if p.isascii() else "".join([shown[b] for b in p.encode()]))]
                ids += got
                sizes.append(len(got))
        self.parts.append(np.array(ids, self.kind), np.array(sizes, np.int64))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def learn(self, words) -> None:  # noqa: ANN001
        """Adds distinct words (an Arrow array) that aren't known: pieces first, then the words as runs of pieces.

        A word of letters is one piece, one of letters and a last mark is two; the pattern splits the others.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        as_list = words.to_numpy(zero_copy_only=False).tolist()
        self.known.update(zip(as_list, range(len(self.known), len(self.known) + len(as_list)), strict=True))
        if not (self.simple_text("\n".join(as_list)) and "<|" not in "".join(as_list)):
            plain = np.array([bool(self.simple(w)) and "<|" not in w for w in as_list])
        else:
            plain = np.ones(len(as_list), bool)
        words = pc.utf8_lower(words) if plain.all() else pa.array([w.lower() if ok else w for w, ok in zip(as_list, plain.tolist(), strict=True)], pa.large_string())
        head = pc.utf8_slice_codeunits(words, 0, -1)
        whole = plain & pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        mark = pc.is_in(pc.utf8_slice_codeunits(words, -1), pa.array(list(".,;:!?)\"%"), pa.large_string())).to_numpy(zero_copy_only=False)
        marked = plain & ~whole & mark & pc.utf8_is_alpha(head).to_numpy(zero_copy_only=False)
        pieces, owner = [pc.filter(words, whole), pc.filter(head, marked), pc.filter(pc.utf8_slice_codeunits(words, -1), marked)], [np.flatnonzero(whole), np.flatnonzero(marked), np.flatnonzero(marked)]
        rest = np.flatnonzero(plain & ~whole & ~marked)
        if len(rest):
            found = self.pattern.findall("\n".join(words.take(pa.array(rest)).to_pylist()))
            of = np.cumsum(np.fromiter((p == "\n" for p in found), np.int64, len(found)))
            pieces.append(pa.array(found, pa.large_string()))
            owner.append(rest[of])
        coded = pc.dictionary_encode(pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in pieces]))
        number, owner = self.number(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()], np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        flat, n = self.parts.gather(number[order])
        sizes = np.bincount(owner[order], n, len(as_list)).astype(np.int64)
        if not plain.all():
            other = np.flatnonzero(~plain)
            got = {int(i): e.ids for at in range(0, len(other), 1024) for i, e in zip(other[at : at + 1024], self.tok.encode_batch_fast([as_list[i] for i in other[at : at + 1024]], add_special_tokens=False), strict=True)}
            ends = np.cumsum(sizes)
            flat = np.concatenate([x for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)) for x in (flat[a:b], np.array(got.get(i, ()), self.kind))])
            sizes[other] = [len(got[int(i)]) for i in other]
        self.words.append(flat, sizes)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        if len(self.known) > CACHE_WORDS or self.words.used > CACHE_IDS:
            self.clear_words()
        if len(self.pieces) > CACHE_WORDS or self.parts.used > CACHE_IDS:
            self.clear_pieces()
        lower = [t.lower() if self.simple_text(t) and "<|" not in t else t for t in texts]
        split = pc.split_pattern(pa.array([t.replace("\n", " ") for t in lower], pa.large_string()), " ")
        coded = pc.dictionary_encode(split.flatten())
        words, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        new = np.array([w not in known for w in words], bool)
        if new.any():
            self.learn(coded.dictionary.filter(pa.array(new)))
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        flat, sizes = self.words.gather(number[coded.indices.to_numpy()])
        before = np.concatenate([[0], np.cumsum(sizes)])
        bounds = before[split.offsets.to_numpy()].tolist()
        return [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def bloom_hashes(key: bytes) -> tuple[int, int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9)
    return a | (zlib.adler32(key) & 0xFFFF) << 32, b | 1


def bloom_build(keys: list[bytes], bits_per_key: int = 10, hashes: int = 7) -> bytes:
    m = max(64, len(keys) * bits_per_key)
    bits = np.zeros(m, bool)
    for key in keys:
        a, b = bloom_hashes(key)
        for i in range(hashes):
            bits[(a + i * b) % m] = True
    return struct.pack(">QB", m, hashes) + np.packbits(bits).tobytes()


def bloom_may_hold(bloom: bytes, key: bytes) -> bool:
    m, hashes = struct.unpack(">QB", bloom[:9])
    a, b = bloom_hashes(key)
    return all(bloom[9 + (p >> 3)] & (0x80 >> (p & 7)) for p in ((a + i * b) % m for i in range(hashes)))


class ShardWriter:
    """Turns ascending (key, value) into the pieces of one shard; holds one block, the keys and the index."""

    def __init__(self, shard: int, block_bytes: int):
        import zstandard

        self.shard, self.block_bytes, self.pack = shard, block_bytes, zstandard.ZstdCompressor(level=1)
        self.block, self.last, self.first, self.at = bytearray(), b"", None, 0
        self.index, self.keys, self.ids = bytearray(), [], 0

    def framed(self, piece: bytes) -> bytes:
        self.at += len(piece) + 1
        return piece

    def close_block(self) -> bytes:
        body = self.pack.compress(bytes(self.block))
        piece = HEAD.pack(len(self.block), zlib.crc32(body)) + body
        self.index += varint(len(self.first)) + self.first + struct.pack(">QQ", self.at, len(piece))
        self.block, self.last, self.first = bytearray(), b"", None
        return self.framed(piece)

    def add(self, key: bytes, value: bytes, n_ids: int) -> bytes | None:
        if self.first is None:
            self.first, shared = key, 0
        else:
            shared = 0
            for x, y in zip(key, self.last, strict=False):
                if x != y:
                    break
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += n_ids
        return self.close_block() if len(self.block) >= self.block_bytes else None

    def finish(self) -> Iterator[bytes]:
        if self.first is not None:
            yield self.close_block()
        index_at, index = self.at, bytes(self.index)
        yield self.framed(index)
        bloom_at, bloom = self.at, bloom_build(self.keys)
        yield self.framed(bloom)
        ends = [bytes([len(k)]) + k for k in (self.keys[0], self.keys[-1])]
        yield self.framed(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), len(self.keys), self.ids, self.shard, *ends, MAGIC))


class Shard:
    """A shard in an open file or in memory: the footer is read at once, index and filter for lookups, blocks one by one."""

    def __init__(self, file, size: int):  # noqa: ANN001
        self.file, self.bytes_read = file, 0
        footer = self.read(size - 1 - FOOTER.size, FOOTER.size)
        self.index_at, self.index_n, self.bloom_at, self.bloom_n, self.entries, self.ids, self.shard, first, last, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.first, self.last = first[1 : 1 + first[0]], last[1 : 1 + last[0]]
        self.firsts: list[bytes] = []
        self.places: list[tuple[int, int]] = []

    def read(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        self.file.seek(at)
        return self.file.read(n)

    def open_index(self) -> None:
        data, at = self.read(self.index_at, self.index_n), 0
        while at < len(data):
            k, at = read_varint(data, at)
            self.firsts.append(data[at : at + k])
            self.places.append(struct.unpack(">QQ", data[at + k : at + k + 16]))
            at += k + 16

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        piece = self.read(*self.places[i])
        raw, crc = HEAD.unpack(piece[: HEAD.size])
        body = piece[HEAD.size :]
        if zlib.crc32(body) != crc:
            raise ValueError(f"block {i} of shard {self.shard} is damaged")
        block, at, key = zstandard.ZstdDecompressor().decompress(body, max_output_size=raw) if raw else b"", 0, b""
        while at < raw:
            shared, at = read_varint(block, at)
            own, at = read_varint(block, at)
            n, at = read_varint(block, at)
            key = key[:shared] + block[at : at + own]
            at += own
            yield key, block[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        self.open_index()
        for i in range(len(self.places)):
            yield from self.block(i)

    def lookup(self, key: bytes) -> list[bytes]:
        """All values of the key: the key range and the Bloom filter first, then a binary search for the first block that can hold it."""
        if not self.first <= key <= self.last or not bloom_may_hold(self.read(self.bloom_at, self.bloom_n), key):
            return []
        if not self.places:
            self.open_index()
        i, found = bisect_right(self.firsts, key) - 1, []
        while i > 0 and self.firsts[i] == key:  # repeated keys may begin in an earlier block
            i -= 1
        for j in range(max(i, 0), len(self.places)):
            if self.firsts[j] > key:
                break
            found += [v for k, v in self.block(j) if k == key]
        return found


def value_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


def write_token_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text", block_bytes: int = 32 * 1024, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every text, appends end_id and writes shards at path, in ascending key order over all shards.

    Null texts count as empty. Null keys sort first. Repeated keys are all kept; a tie is broken by the row's position in the
    input, and the same key may go on in the next shard, so that a key with very many rows does not fill one task.
    The table's bytes of text over shard_bytes give the number of shards, the number of shuffle partitions at least. A text is
    encoded whole, however long. An empty table writes no shard. Extra columns are not read.
    """
    place = tokenizer or tokenizer_path("word_bpe_49k.json")

    def write(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, out = encoder(place), None
        tail = np.array([end_id], enc.kind).tobytes()
        width = len(tail)
        for batch in batches:
            for part in slices(batch, 1):
                pieces = []
                for k, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    out = out or ShardWriter(TaskContext.get().partitionId(), block_bytes)
                    if (piece := out.add(encode_key(k), bytes([width]) + ids + tail, len(ids) // width + 1)) is not None:
                        pieces.append(piece)
                if pieces:
                    yield pa.record_batch([pa.array(pieces, pa.binary())], ["data"])
        if out:
            for piece in out.finish():
                yield pa.record_batch([pa.array([piece], pa.binary())], ["data"])

    def run(batches: Iterable) -> Iterator:
        yield from ending(write(batches))

    rows = own_columns(docs, key, text).select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("tie"))
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    sorted_rows = rows.repartitionByRange(shards, "k", "tie").sortWithinPartitions("k", "tie").select("k", "t")
    sorted_rows.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.text(path, lineSep="\n")


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of every shard; no content is read."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") > FOOTER.size).select("path", "length")


def opened(place: str):  # noqa: ANN201
    store, at = filesystem(place)
    return store.open_input_file(at)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Every entry: key, shard, position of its first id within the shard, ids as little-endian unsigned 32-bit integers."""

    def read(batches: Iterable) -> Iterator:
        import io

        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py()
                shard = Shard(io.BytesIO(data), len(data))
                shard.open_index()
                at = 0
                for b in range(len(shard.places)):
                    keys, starts, ids = [], [], []
                    for k, v in shard.block(b):
                        x = value_ids(v)
                        keys.append(decode_key(k))
                        starts.append(at)
                        ids.append(x.tobytes())
                        at += len(x)
                    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([shard.shard] * len(keys), pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["key", "shard", "shard_start", "ids"])

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > FOOTER.size)
    return files.select("content").mapInArrow(read, "key long, shard long, shard_start long, ids binary")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """path, length, shard, ids, first and last key (encoded) of every shard, from FOOTER.size bytes of each."""

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for place, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(place) as file:
                    s = Shard(file, n)
                yield pa.record_batch([[place], [n], [s.shard], [s.ids], [s.first], [s.last]], ["path", "length", "shard", "ids", "first", "last"])

    return shard_files(spark, path).mapInArrow(read, "path string, length long, shard long, ids long, first binary, last binary")


def shard_offsets(spark: SparkSession, path: str) -> DataFrame:
    """shard, ids of all shards before it; one row a shard, from the footers alone."""
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    return footers(spark, path).select("shard", F.coalesce(before, F.lit(0)).alias("base"))


def lookup(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """Entries of the given few keys: key, ids, bytes_read (of the shard's file, for all of the keys).

    Only shards whose range of keys holds one of them are opened, and of these only footer, filter, index and single blocks.
    """
    wanted = [encode_key(k) for k in keys]
    reached = F.lit(False)
    for k in wanted:
        reached = reached | ((F.col("first") <= F.lit(bytearray(k))) & (F.lit(bytearray(k)) <= F.col("last")))

    def find(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for place, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(place) as file:
                    shard = Shard(file, n)
                    hits = [(decode_key(k), value_ids(v).tolist()) for k in wanted for v in shard.lookup(k)]
                if hits:
                    yield pa.record_batch([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.list_(pa.int64())), pa.array([shard.bytes_read] * len(hits), pa.int64())], ["key", "ids", "bytes_read"])

    return footers(spark, path).where(reached).select("path", "length").mapInArrow(find, "key long, ids array<long>, bytes_read long")
