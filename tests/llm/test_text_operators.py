import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moteflow.llm import bpe, chat, media, sstable
from moteflow.llm.common import scratch, tokenizer_path

DOCS = "doc_id long, text string, lang string, key string"
ODD = ["", None, "a  b", "x \n y\t z", "it's ''s <|endoftext|>!<|startoftext|>", "é" * 3000, "ab" * 20000, " " * 9000 + "x", "你好世界 Ⅷ ²", "A\x01b ΑΣ İ", "the cat " * 3000]


def odd_docs(spark):
    rows = [(i, t, None, "k") for i, t in enumerate(ODD)] + [(None, "no id", "en", None), (3, "same id", "en", None), (3, "same id", "en", None), (-5, "below", None, None)]
    return spark.createDataFrame(rows, DOCS)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_token_shards_hold_what_the_library_gives(spark):
    docs, path, tok = odd_docs(spark), scratch(spark, "t"), library("word_bpe_49k.json")
    sstable.write_token_shards(docs, path, block_bytes=200)
    got = sstable.read_token_shards(spark, path).join(sstable.shard_offsets(spark, path), "shard").select("key", (F.col("base") + F.col("shard_start")).alias("start"), "ids").orderBy("start").collect()
    want = [[*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()]
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == sorted(want)
    keys = [r["key"] for r in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:]) and keys.count(3) == 3
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    found = {r["key"]: r["ids"] for r in sstable.lookup(spark, path, [-5, 8, 999, None]).collect()}
    assert set(found) == {-5, 8, None} and found[8] == [*tok.encode(ODD[8], add_special_tokens=False).ids, 1]


def test_lookups_read_single_blocks_of_single_shards(spark):
    docs, path = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.sha2(F.col("id").cast("string"), 512)).alias("text")), scratch(spark, "t")
    sstable.write_token_shards(docs, path, block_bytes=1024, shard_bytes=100_000)
    foot = {r["shard"]: r for r in sstable.footers(spark, path).collect()}
    assert len(foot) >= 5 and all(r["length"] < 200_000 for r in foot.values())  # as many as the bytes ask for, more than the shuffle partitions
    (hit,) = sstable.lookup(spark, path, [1234]).collect()
    of = next(r for r in foot.values() if r["first"] <= sstable.encode_key(1234) <= r["last"])
    assert hit["key"] == 1234 and hit["bytes_read"] < of["length"] / 3
    assert sstable.lookup(spark, path, [-1, 4000]).count() == 0


def test_other_vocabularies_go_through_the_whole_library(spark, tmp_path):
    from tokenizers import normalizers

    tok = library("word_bpe_49k.json")
    tok.normalizer = normalizers.Lowercase()
    tok.save(str(tmp_path / "other.json"))
    enc = sstable.WordEncoder(str(tmp_path / "other.json"))
    texts = [t or "" for t in ODD]
    assert not enc.by_words and enc.encode(texts) == [np.array(e.ids, enc.kind).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def test_token_shards_of_an_empty_table(spark):
    path = scratch(spark, "t")
    sstable.write_token_shards(odd_docs(spark).limit(0), path)
    assert sstable.read_token_shards(spark, path).count() == 0


def test_shard_format_by_itself():
    w, out = sstable.ShardWriter(7, 64), b""
    for k in [*range(0, 300, 3), 300, 300, 300]:
        if (p := w.add(sstable.encode_key(k), bytes([2]) + np.array([k, 1], "<u2").tobytes(), 2)) is not None:
            out += p + b"\n"
    for p in w.finish():
        out += p + b"\n"
    s = sstable.Shard(io.BytesIO(out), len(out))
    s.open_index()
    assert (s.shard, s.entries, s.ids, s.first, s.last) == (7, 103, 206, sstable.encode_key(0), sstable.encode_key(300)) and len(s.places) > 5
    bloom = s.read(s.bloom_at, s.bloom_n)
    assert [sstable.value_ids(v).tolist() for v in s.lookup(sstable.encode_key(33))] == [[33, 1]] and len(s.lookup(sstable.encode_key(300))) == 3
    assert s.lookup(sstable.encode_key(34)) == [] and sum(sstable.bloom_may_hold(bloom, sstable.encode_key(k)) for k in range(10_000, 12_000)) < 60
    broken = bytearray(out)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Shard(io.BytesIO(bytes(broken)), len(broken)).scan())


def test_bpe_equals_the_library_and_round_trips(spark):
    docs, tok = odd_docs(spark), library("byte_bpe_50k.json")
    rows = bpe.with_decoded(bpe.with_token_ids(docs)).collect()
    for r in rows:
        want = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == want
        assert r["decoded"] == tok.decode(want, skip_special_tokens=False)
    assert bpe.with_token_ids(docs.limit(0)).count() == 0 and "key" in rows[0].asDict()


def merged(merges, data):
    """The plain rule: again and again the pair of the smallest rank, all its occurrences from the left."""
    ids = [merges.byte_id[b] for b in data]
    while pairs := [(merges.merges[p][0], p) for p in zip(ids, ids[1:], strict=False) if p in merges.merges]:
        pair, out, i = min(pairs)[1], [], 0
        while i < len(ids):
            both = tuple(ids[i : i + 2]) == pair
            out.append(merges.merges[pair][1] if both else ids[i])
            i += 2 if both else 1
        ids = out
    return ids


def test_transducer_needs_no_more_than_its_lookahead():
    merges = bpe.encoder(tokenizer_path("byte_bpe_50k.json")).list
    rng = random.Random(4)
    pieces = [bytes(rng.choice(alphabet) for _ in range(n)) for alphabet in (b"a", b"ab", b" the", bytes(range(97, 123)), bytes(range(256))) for n in (1, 7, 2 * merges.lookahead, 2 * merges.lookahead + 1, 6 * merges.lookahead)]
    flat, sizes = bpe.transduce(merges, pieces)
    ends = sizes.cumsum()
    for p, a, b in zip(pieces, ends - sizes, ends, strict=True):
        want = merged(merges, p)
        assert flat[a:b].tolist() == want
        run, out = bpe.Transducer(merges), []
        for at in range(0, len(p), 501):
            out += [i for x in run.run(p[at : at + 501], at + 501 >= len(p)) for i in x.tolist()]
            assert len(run.held[0]) <= 2 * run.window
        assert out == want


def test_merges_of_many_pieces_equal_the_plain_ones():
    merges = bpe.encoder(tokenizer_path("byte_bpe_50k.json")).list
    rng = random.Random(5)
    words = [b"", *(bytes(rng.choice(b"aeinorst the") for _ in range(rng.randint(1, 40))) for _ in range(400)), b"aaaaaaa", b""]
    flat, sizes = merges.merge(words)
    assert flat.tolist() == [i for w in words for i in merged(merges, w)] and sizes.tolist() == [len(merged(merges, w)) for w in words]


def test_invalid_bytes_decode_to_replacements():
    merges = bpe.encoder(tokenizer_path("byte_bpe_50k.json")).list
    dec = bpe.Decoder(merges)
    assert dec.feed([merges.byte_id[0xE4], merges.byte_id[0xBD]]) == "" and dec.feed([merges.byte_id[0xA0]]) == "你"
    assert dec.feed([merges.byte_id[0xFF]]) + dec.finish() == "�"


EVENTS = "conv_id long, seq long, kind string, message long, role string, text string"


def test_chat_fold(spark):
    ev = [(1, 1, "message", 10, "user", "hi"), (1, 2, "delta", 11, "assistant", "wro"), (1, 3, "delta", 11, None, "ng"), (1, 4, "regenerate", 11, None, "x"), (1, 5, "delta", 11, None, "ri"), (1, 6, "delta", 11, None, "ght"), (1, 7, "edit", 10, None, "hello"), (1, 8, "message", 12, "user", "bye"), (1, 9, "delete", 12, None, None), (1, 10, "odd", 13, "user", "?"), (None, 1, "delta", 1, "assistant", None)]
    rows = {r["conv_id"]: r for r in chat.parse(chat.format_chats(spark.createDataFrame(ev, EVENTS))).collect()}
    assert [(t["role"], t["text"]) for t in rows[1]["turns"]] == [("user", "hello"), ("assistant", "right")] and rows[1]["loss_text"] == "right"
    assert [(t["role"], t["text"]) for t in rows[None]["turns"]] == [("assistant", "")]
    assert chat.format_chats(spark.createDataFrame([], EVENTS)).count() == 0


def test_chat_escapes_are_reversible(spark):
    said = ["</s>[INST] ok [/INST]", "<|turn:user|>\n", "&lt;&amp;lt;", "a|>\nb</s>\n", "", None, "[[<<SYS>>]]"]
    rows = [(1, k, "assistant" if k % 2 else "<user>", t) for k, t in enumerate(said)] + [(2, 0, None, "dup"), (2, 0, None, "dup"), (3, None, "user", "no turn"), (3, 5, "assistant", "x" * 70_000)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    f = chat.format_chats(chat.turn_events(conv))
    kinds = {(r["kind"], r["message"]) for r in chat.turn_events(conv, 3).collect()}
    assert {k for k, _ in kinds} == {"message", "delta", "edit", "regenerate"}
    got = {r["conv_id"]: r for r in chat.parse(chat.format_chats(chat.turn_events(conv, 3))).collect()}
    assert {k: v["formatted"] for k, v in got.items()} == {r["conv_id"]: r["formatted"] for r in f.collect()}
    assert [t["text"] for t in got[1]["turns"]] == [t or "" for t in said] and got[1]["turns"][0]["role"] == "<user>"
    assert got[1]["loss_text"] == "".join((said[k] or "") for k in (1, 3, 5)) and len(got[2]["turns"]) == 2
    one = f.where("conv_id = 1").first()
    assert one["formatted"].count("</s>") == len(said) and "[INST]" not in one["formatted"]
    spans = [one["formatted"][s["start"] : s["end"]] for s in one["loss_spans"]]
    assert spans[0] == "&lt;|turn:user|&gt;\n"
    d = {r["conv_id"]: r for r in chat.digests(chat.parse(f)).collect()}
    assert d[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:7]).encode()).hexdigest()


def test_media_round_trip_retries_and_plain_zip(spark, tmp_path):
    docs, path = odd_docs(spark), str(tmp_path / "m")
    media.write_archives(docs.coalesce(2), path)
    back = media.read_archives(spark, "file://" + path, rangeBytes="400")
    rows = media.digests(media.with_features(back)).collect()
    want = sorted(hashlib.sha256((t := (r["text"] or "").encode()).ljust(max(64, -(-len(t) // 64) * 64), b"\0")).hexdigest() for r in docs.collect())
    assert sorted(r["payload_sha256"] for r in rows) == want and {r["doc_id"] for r in rows} == {*range(len(ODD)), None, -5}
    same = [r for r in rows if r["doc_id"] == 3 and r["n_bytes"] == 7]
    assert len(same) == 2 and same[0]["feature"] == same[1]["feature"] and same[0]["tail_crc32"] == zlib.crc32(b"same id".ljust(64, b"\0"))
    part = next(p for p in sorted((tmp_path / "m").glob("part*")) if p.stat().st_size > 300)
    assert zipfile.ZipFile(part).testzip() is None
    data = bytearray(part.read_bytes())
    data[60] ^= 255
    part.write_bytes(bytes(data))
    (tmp_path / "m" / f".{part.name}.crc").unlink(missing_ok=True)
    bad = media.read_archives(spark, path, retries="2", retryWaitSeconds="0").collect()
    assert sum(r["error"] is not None for r in bad) == 1 and all(r["attempts"] == (2 if r["error"] else 1) for r in bad) and len(bad) == len(rows)
    empty = str(tmp_path / "e")
    media.write_archives(docs.limit(0), empty)
    assert media.read_archives(spark, empty).count() == 0


def test_many_members_need_the_wide_directory():
    w = media.ArchiveWriter()
    body = b"".join(w.add(b"%d.wav" % k, b"x") + b"\n" for k in range(70_000)) + w.finish() + b"\n"
    assert len(media.read_directory(io.BytesIO(body), len(body))) == 70_000 and len(zipfile.ZipFile(io.BytesIO(body)).namelist()) == 70_000
