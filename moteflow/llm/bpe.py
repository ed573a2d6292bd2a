"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A right context can change the symbols at a place only through a chain of merges, each of which takes its left part from the
right spine of the symbol before it and has a smaller rank. The ranks along such a chain fall, so it is finite, and its
longest byte length is the merge list's sufficient lookahead (Berglund and van der Merwe, "Formalizing BPE Tokenization").
The transducer holds that many bytes back, emits what ends before them, and goes on from there: memory is constant however
long a piece is. Every piece runs through it; the merges of many pieces are carried out together in numpy.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import ending, slices, tokenizer_path

#: Fixed value of this vocabulary: the pattern of its pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = "\x01"  # between words; texts cut by words don't hold it
CACHE_PIECES, CACHE_IDS = 300_000, 8_000_000
CHUNK = 1 << 16
TOGETHER = 1 << 16  # bytes of pieces whose merges are carried out together
NEVER, SLOTS, SHIFT, HASH = 1 << 40, 1 << 20, 40, np.int64(0x5851F42D4C957F2D)


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeList:
    """Ranks, token bytes and the sufficient lookahead of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * n
        for token, i in vocab.items():
            if token not in self.special:
                self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.token_size = np.array(list(map(len, self.token_bytes)), np.int64)
        self.byte_id = [0] * 256
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.lookahead = self.sufficient_lookahead()
        with np.errstate(over="ignore"):
            self.fill()

    def sufficient_lookahead(self) -> int:
        """Longest byte length of a chain of merges through which later bytes can reach back."""
        reach: dict[int, int] = {}  # of a symbol: bytes that merges seen so far can take up to its right
        spine: dict[int, int] = {}  # of a symbol: its right part
        longest = 0
        for (left, right), (_, made) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            far, at = 0, right
            while at is not None:
                far, at = max(far, reach.get(at, 0)), spine.get(at)
            here = len(self.token_bytes[right]) + far
            reach[left] = max(reach.get(left, 0), here)
            spine.setdefault(made, right)
            longest = max(longest, here)
        return longest + max(map(len, self.token_bytes))

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces and how many each has: in each round every piece merges its best pair, leftmost first."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids, row = np.array(self.byte_id, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)], np.repeat(np.arange(n), lengths)
        done_ids, done_row = [], []
        follows = lambda: np.r_[row[1:] == row[:-1], False]
        rank, made = self.lookup(ids, np.where(follows(), np.r_[ids[1:], -1], -1))
        while len(ids):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(ids)])
            live = best < NEVER
            if not live.all():
                at = np.repeat(live, sizes)
                done_ids.append(ids[~at])
                done_row.append(row[~at])
                ids, row, rank, made, best, sizes = ids[at], row[at], rank[at], made[at], best[live], sizes[live]
            if not len(ids):
                break
            here = rank == np.repeat(best, sizes)
            place = np.arange(len(ids))
            here &= ((place - np.maximum.accumulate(np.where(here, -1, place))) & 1) == 1  # of overlapping pairs every other one
            ids[here] = made[here]
            keep = np.r_[True, ~here[:-1]]
            ids, row, rank, made, here = ids[keep], row[keep], rank[keep], made[keep], here[keep]
            new = np.flatnonzero(here | np.r_[here[1:], False])
            right = np.where(follows()[new], np.r_[ids[1:], -1][new], -1)
            rank[new], made[new] = self.lookup(ids[new], right)
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        flat, row = np.concatenate(done_ids), np.concatenate(done_row)
        return flat[np.argsort(row, kind="stable")], np.bincount(row, minlength=n)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made id of each pair; NEVER where it is no merge."""
        pair = left * self.base + right
        slot = (pair * HASH >> SHIFT) & (SLOTS - 1)
        hit = self.slot_pair[slot] == pair
        for _ in range(self.probes):
            miss = ~hit & (self.slot_pair[slot] >= 0) & (right >= 0)
            if not miss.any():
                break
            slot = np.where(miss, (slot + 1) & (SLOTS - 1), slot)
            hit = self.slot_pair[slot] == pair
        hit &= right >= 0
        return np.where(hit, self.slot_rank[slot], NEVER), self.slot_made[slot]

    def fill(self) -> None:
        """The merges as an open hash table in arrays."""
        self.base = len(self.token_bytes)
        self.slot_pair, self.slot_rank, self.slot_made = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.probes = 0
        for (a, b), (rank, made) in self.merges.items():
            pair, n = a * self.base + b, 0
            slot = int((np.int64(pair) * HASH >> SHIFT) & (SLOTS - 1))
            while self.slot_pair[slot] >= 0:
                slot, n = (slot + 1) & (SLOTS - 1), n + 1
            self.slot_pair[slot], self.slot_rank[slot], self.slot_made[slot] = pair, rank, made
            self.probes = max(self.probes, n)


class Transducer:
    """Pieces, each fed in parts: feed() returns the ids that no later byte can change; the last part of a piece ends it.

    At most two lookaheads of bytes of each piece are held, whatever the piece's length.
    """

    def __init__(self, merges: MergeList, n: int = 1):
        self.list, self.held, self.window = merges, [b""] * n, 2 * merges.lookahead

    def feed(self, parts: list[bytes], last: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids that are stable now, piece by piece, and how many of each; parts are at most a window long."""
        self.held = [h + p for h, p in zip(self.held, parts, strict=True)]
        flat, sizes = self.list.merge(self.held)
        bytes_to = np.cumsum(self.list.token_size[flat])
        ends = np.cumsum(sizes)
        before = np.r_[0, bytes_to][ends - sizes]
        stable = np.where(last, np.iinfo(np.int64).max, np.fromiter(map(len, self.held), np.int64, len(parts)) - self.list.lookahead)
        out = bytes_to - np.repeat(before, sizes) <= np.repeat(stable, sizes)
        row = np.repeat(np.arange(len(parts)), sizes)
        emitted = np.bincount(row[out], minlength=len(parts))
        gone = np.bincount(row[out], self.list.token_size[flat[out]], len(parts)).astype(np.int64).tolist()
        self.held = [b"" if end else h[g:] for h, g, end in zip(self.held, gone, last, strict=True)]
        return flat[out], emitted

    def run(self, data: bytes, ends: bool) -> list[np.ndarray]:
        """Of a lone piece: feeds data window by window."""
        cuts = [data[at : at + self.window] for at in range(0, len(data), self.window)] or [b""]
        return [self.feed([c], [ends and i == len(cuts) - 1])[0] for i, c in enumerate(cuts)]


def transduce(merges: MergeList, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole pieces and how many each has: all of them at once through one transducer, window by window."""
    run, n = Transducer(merges, len(pieces)), len(pieces)
    flat, sizes = run.feed([p[: run.window] for p in pieces], [len(p) <= run.window for p in pieces])
    at = run.window
    of = np.repeat(np.arange(n), sizes)
    longer = [i for i, p in enumerate(pieces) if len(p) > at]
    if longer:  # what has not ended goes on, apart from the others
        run.held, runs = [run.held[i] for i in longer], [(flat, of)]
        while longer:
            ids, k = run.feed([pieces[i][at : at + run.window] for i in longer], [len(pieces[i]) <= at + run.window for i in longer])
            runs.append((ids, np.repeat(np.array(longer), k)))
            at += run.window
            run.held = [h for h, i in zip(run.held, longer, strict=True) if len(pieces[i]) > at]
            longer = [i for i in longer if len(pieces[i]) > at]
        flat, of = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
        flat = flat[np.argsort(of, kind="stable")]
        sizes = np.bincount(of, minlength=n)
    return flat, sizes


class IdStore:
    """Runs of ids by number, in one growing array; gather() concatenates the runs of many numbers at once."""

    def __init__(self, kind: str):
        self.flat, self.used = np.zeros(1 << 16, kind), 0
        self.starts, self.sizes, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.used, self.n = self.used + len(ids), self.n + len(sizes)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        return self.flat[at], sizes


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers, as the tokenizers library does with the same file.

    Where no two blanks meet, a blank opens a piece and a newline is one, so that words recur: Arrow cuts such texts and finds
    the distinct words. Other texts are cut by the pattern in chunks. A word's ids are remembered, up to a bound.
    """

    def __init__(self, path: str):
        import re

        import regex

        self.list = MergeList(path)
        self.pattern = regex.compile(PATTERN)
        self.words_pattern = regex.compile(PATTERN.replace(r"[^\s", r"[^\s" + CUT) + "|" + CUT)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.list.special, key=len, reverse=True))) + ")") if self.list.special else None
        self.odd_space = re.compile(r"\s\s|[^\S \n]|" + CUT)
        self.clear()

    def clear(self) -> None:
        self.store, self.known = IdStore("<u4"), {}
        self.pieces: dict[str, int] = {}

    def number(self, pieces: list[str]) -> list[int]:
        """Numbers of pieces in the store; new ones go through the transducer together."""
        known, new, size = self.pieces, [], 0
        for p in dict.fromkeys(pieces):
            if p not in known:
                new.append(p)
        at = 0
        while at < len(new):
            part, size = [], 0
            while at < len(new) and size < TOGETHER:
                part.append(new[at].encode())
                size += len(part[-1])
                at += 1
            known.update(zip(new[at - len(part) : at], range(self.store.n, self.store.n + len(part)), strict=True))
            self.store.append(*transduce(self.list, part))
        return list(map(known.__getitem__, pieces))

    def one(self, ids: list[np.ndarray]) -> int:
        self.store.append(flat := np.concatenate(ids), np.array([len(flat)]))
        return self.store.n - 1

    def section(self, text: str, out: list[str | int]) -> None:
        """Pieces of a text without special tokens, read in chunks; the last match of a chunk waits for what follows.

        A match that fills a whole chunk is fed to a transducer as it comes, its last character held back.
        """
        held, at, n = "", 0, len(text)
        while at < n or held:
            held, at = held + text[at : at + CHUNK], min(n, at + CHUNK)
            ends, last = at >= n, 0
            cut = len(held) if ends else len(held) - 4
            for m in self.pattern.finditer(held):
                if not ends and m.end() > cut:
                    break
                out.append(m[0])
                last = m.end()
            held = held[last:]
            if ends:
                break
            if len(held) > CHUNK:
                held, at = self.long_run(held, text, at, out)

    def long_run(self, held: str, text: str, at: int, out: list[str | int]) -> tuple[str, int]:
        """A match longer than a chunk: its characters go to one transducer until its class ends."""
        m = self.pattern.match(held)
        blank = m[0].isspace()
        first = m[0][1] if m[0][0] == " " and not blank else m[0][0]
        same = {"L": r"\p{L}+", "N": r"\p{N}+"}.get(_kind(first), r"[^\s\p{L}\p{N}]+") if not blank else r"\s+"
        import regex

        more, run, n, found = regex.compile(same), Transducer(self.list), len(text), []
        body, rest = m[0], held[m.end() :]
        while not rest and at < n:
            found += run.run(body[:-1].encode(), False)
            nxt, at = text[at : at + CHUNK], min(n, at + CHUNK)
            k = more.match(nxt)
            body, rest = body[-1] + (k[0] if k else ""), nxt[k.end() if k else 0 :]
        if blank and rest and not rest[0].isspace():  # the last blank of a run belongs to what follows
            body, rest = body[:-1], body[-1] + rest
        out.append(self.one([*found, *run.run(body.encode(), True)]))
        return rest, at

    def learn(self, words: list[str]) -> None:
        """Numbers of distinct words without inner white space, as runs of pieces."""
        found = self.words_pattern.findall(CUT.join(words))
        run = np.array(self.number([p for p in found if p != CUT]), np.int64)
        of = np.cumsum(np.fromiter((p == CUT for p in found), np.int64, len(found)))[np.fromiter((p != CUT for p in found), bool, len(found))]
        flat, sizes = self.store.gather(run)
        first = self.store.n
        self.store.append(flat, np.bincount(of, sizes, len(words)).astype(np.int64))
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def by_words(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the words of texts in which no two blanks meet."""
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.split_pattern(pa.array([t.replace(" ", CUT + " ").replace("\n", CUT + "\n" + CUT) for t in texts], pa.large_string()), CUT)
        coded = pc.dictionary_encode(cut.flatten())
        words, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        if new := [w for w in words if w not in known]:
            self.learn(new)
        numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        return np.split(numbers, cut.offsets.to_numpy()[1:-1])

    def by_pattern(self, text: str) -> np.ndarray:
        out: list[str | int] = []
        for p in self.specials.split(text) if self.specials else [text]:
            if p in self.list.special:
                out.append(self.one([np.array([self.list.special[p]])]))
            elif p:
                self.section(p, out)
        numbers = iter(self.number([p for p in out if isinstance(p, str)]))
        return np.array([next(numbers) if isinstance(p, str) else p for p in out], np.int64)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) + len(self.known) > CACHE_PIECES or self.store.used > CACHE_IDS:
            self.clear()
        plain = [i for i, t in enumerate(texts) if t and not self.odd_space.search(t) and not (self.specials and self.specials.search(t))]
        numbers = dict(zip(plain, self.by_words([texts[i] for i in plain]), strict=True)) if plain else {}
        runs = [numbers[i] if i in numbers else self.by_pattern(t) for i, t in enumerate(texts)]
        if not runs:
            return []
        flat, sizes = self.store.gather(np.concatenate(runs))
        bounds = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, runs)])].tolist()
        return [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _kind(c: str) -> str:
    import unicodedata

    return unicodedata.category(c)[0]


class Decoder:
    """Ids to text: token bytes run through an incremental UTF-8 state machine; invalid bytes become U+FFFD."""

    def __init__(self, merges: MergeList):
        self.table = merges.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_token_ids(docs: DataFrame, tokenizer: str | None = None, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with one more column: the ids of the text, as binary, little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. All other columns, nulls and repeated rows pass unchanged; if docs already has
    a column of that name, it is replaced. An empty table stays empty.
    """
    place = tokenizer or tokenizer_path("byte_bpe_50k.json")
    base = docs.drop(ids)  # in any spelling, as Spark compares names

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        enc = encoder(place)
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text), 512, 2 << 20):
                made = enc.encode_batch([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], [*part.schema.names, ids])

    def whole(batches: Iterable) -> Iterator:
        yield from ending(run(batches), encoder(place).clear)

    return base.mapInArrow(whole, StructType([*base.schema.fields, StructField(ids, BinaryType())]))


def with_decoded(docs: DataFrame, tokenizer: str | None = None, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """docs with one more column: the text that the ids stand for, special tokens included. Null ids give an empty text."""
    place = tokenizer or tokenizer_path("byte_bpe_50k.json")
    base = docs.drop(text)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        merges = encoder(place).list
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = []
                for data in part.column(ids).to_pylist():
                    x, dec = np.frombuffer(data or b"", "<u4"), Decoder(merges)
                    made.append("".join(dec.feed(x[i : i + CHUNK].tolist()) for i in range(0, len(x), CHUNK)) + dec.finish())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], [*part.schema.names, text])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(text, StringType())]))


def digests(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, number of ids, sha256 of the ids and of the decoded text."""
    both = with_decoded(with_token_ids(docs.select("doc_id", "text")).drop("text"))
    return both.select("doc_id", F.expr("cast(length(token_ids) / 4 as long)").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


