"""Tar archives against Python's own reader and writer, faults in them, and file name patterns against fnmatch."""

import fnmatch
import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from moteflow.functions.text import excluded, key_token
from moteflow.schema import Box
from moteflow.sources import archives, sinks, trajectories


def tar_bytes(files, mode="w", **kinds):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode, format=tarfile.USTAR_FORMAT) as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data or b"")
            if name in kinds:
                info.type, info.size, info.linkname = kinds[name], 0, "x"
            t.addfile(info, io.BytesIO(data or b"") if info.size else None)
    return out.getvalue()


FILES = [("./a.txt", b"one"), ("sub/b.bin", bytes(range(256)) * 9), ("empty", b""), ("deep/er/c", b"x" * 1024), ("d", b"y" * 512)]


def joined(index, part_bytes):
    out = {}
    for r in sorted(archives.contents(index, part_bytes).collect(), key=lambda r: (r["archive"], r["at"], r["part"])):
        key = (r["archive"].rsplit("/", 1)[1], r["path"])
        assert len(r["data"]) <= part_bytes
        out[key] = out.get(key, b"") + bytes(r["data"])
    return out


def test_members_and_contents(spark, tmp_path):
    (tmp_path / "p.tar").write_bytes(tar_bytes(FILES))
    (tmp_path / "z.tar.gz").write_bytes(tar_bytes(FILES, "w:gz"))
    two = tar_bytes(FILES)
    (tmp_path / "t.tgz").write_bytes(gzip.compress(two[:700]) + gzip.compress(two[700:]))  # a stream of two parts
    (tmp_path / "none.tar").write_bytes(b"")
    (tmp_path / "ends.tar").write_bytes(bytes(1024))
    index = archives.members(spark, str(tmp_path))
    want = {n.removeprefix("./"): d for n, d in FILES}
    assert {(r["path"], r["bytes"]) for r in index.where("NOT gzipped").collect()} == {(n, len(d)) for n, d in want.items()}
    for part_bytes in (100, 1 << 20):
        assert joined(index, part_bytes) == {(a, n): d for a in ("p.tar", "z.tar.gz", "t.tgz") for n, d in want.items()}
    out = tmp_path / "out"
    done = archives.extract(index, str(out)).collect()
    assert {r["path"]: r["bytes"] for r in done} == {n: len(d) for n, d in want.items()}
    assert {r["archive"].rsplit("/", 1)[1] for r in done} == {"z.tar.gz"}  # the last of archives with the same paths
    assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file() and not p.name.startswith(".")} == want


def test_faults_are_rows(spark, tmp_path):
    whole = tar_bytes(FILES, "w:gz")
    (tmp_path / "crc.tar.gz").write_bytes(whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:])
    (tmp_path / "short.tar.gz").write_bytes(whole[:-20])
    (tmp_path / "up.tar").write_bytes(tar_bytes([("../evil", b"1"), ("a/../../evil", b"2"), ("a/../fine", b"3"), ("/root", b"4")]))
    (tmp_path / "link.tar").write_bytes(tar_bytes([("l", b""), ("dir", b""), ("f", b"5")], l=tarfile.SYMTYPE, dir=tarfile.DIRTYPE))
    (tmp_path / "cut.tar").write_bytes(tar_bytes([("g", b"6"), ("h", b"7" * 2000)])[:2500])
    (tmp_path / "text.tar").write_bytes(b"no archive at all " * 100)
    bad = bytearray(tar_bytes([("size", b"8"), ("after", b"9")]))
    bad[124:128] = b"zzzz"
    total = sum(bad[:148]) + 8 * 32 + sum(bad[156:512])
    bad[148:156] = b"%06o\0 " % total
    (tmp_path / "size.tar").write_bytes(bytes(bad))
    index = archives.members(spark, str(tmp_path))
    rows = {}
    for r in index.collect():
        rows.setdefault(r["archive"].rsplit("/", 1)[1], []).append((r["path"], r["kind"], r["error"]))
    assert [r[0] for r in rows["crc.tar.gz"] + rows["short.tar.gz"]] == [None, None]
    assert all(r[2].startswith("gzip: ") for r in rows["crc.tar.gz"] + rows["short.tar.gz"])
    assert [(p, e) for p, _, e in rows["up.tar"]] == [("../evil", "leaves the root"), ("a/../../evil", "leaves the root"), ("a/../fine", None), ("/root", None)]
    assert rows["link.tar"] == [("l", "other", "type '2' is not read"), ("dir/", "directory", None), ("f", "file", None)]
    assert rows["cut.tar"] == [("g", "file", None), ("h", "file", "cut off")]
    assert len(rows["text.tar"]) == 1 and "checksum" in rows["text.tar"][0][2]
    assert rows["size.tar"] == [(None, None, "bad size field of size")]
    out = tmp_path / "deep" / "out"
    archives.extract(index, str(out)).count()
    assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file() and not p.name.startswith(".")} == {"fine": b"3", "root": b"4", "f": b"5", "g": b"6"}
    assert not (tmp_path / "evil").exists() and not (tmp_path / "deep" / "evil").exists()


def test_of_one_path_the_last_stays(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(tar_bytes([("x", b"first"), ("x", b"second"), ("./x", b"third"), ("y", b"only")]))
    out = tmp_path / "out"
    assert archives.extract(archives.members(spark, str(tmp_path / "a.tar")), str(out)).count() == 2
    assert (out / "x").read_bytes() == b"third"


@pytest.mark.parametrize("gzipped", [True, False])
def test_packed_folders_are_read_by_others(spark, tmp_path, gzipped):
    src = tmp_path / "deck"
    want = {"in.txt": b"run", "sub/data 1.bin": b"q" * 3000, "sub/more/x": b"", "Al.restart.5000": b"r", "results/out": b"o", "sub/results/out": b"p", "n.ckpt.1": b"c"}
    for name, data in want.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(data)
    (src / ".hidden").mkdir()
    (src / ".hidden" / "x").write_bytes(b"h")
    kept = {"in.txt", "sub/data 1.bin", "sub/more/x"}
    for at in ("one", "two"):
        done = archives.pack(spark, str(src), str(tmp_path / at), ("*.restart*", "results", "*.ckpt*"), gzipped=gzipped)
        assert [(r["files"], r["bytes"]) for r in done.collect()] == [(3, 3003)]
    name = "part-000000.tar" + (".gz" if gzipped else "")
    data = (tmp_path / "one" / name).read_bytes()
    assert data == (tmp_path / "two" / name).read_bytes()
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        assert [m.name for m in t] == ["./in.txt", "./sub", "./sub/data 1.bin", "./sub/more", "./sub/more/x"]
        assert {m.name[2:]: t.extractfile(m).read() for m in t if m.isfile()} == {n: want[n] for n in kept}
    archives.pack(spark, str(src), str(tmp_path / "parts"), archive_bytes=1000, gzipped=gzipped)
    index = archives.members(spark, str(tmp_path / "parts"))
    assert index.select("archive").distinct().count() > 1
    assert {p: d for (_, p), d in joined(index, 1 << 20).items()} == want
    (tmp_path / "bare").mkdir()
    assert archives.pack(spark, str(tmp_path / "bare"), str(tmp_path / "no")).count() == 0
    (src / ("n" * 120)).write_bytes(b"")
    with pytest.raises(Exception, match="100 bytes"):
        archives.pack(spark, str(src), str(tmp_path / "long"))


def test_trajectories_out_of_archives(spark, tmp_path):
    rows = [(f, i, i + 1, "Fe", float(i), float(f), 0.25, 0.5) for f in range(6) for i in range(4)]
    atoms = spark.createDataFrame(rows, "frame int, atom int, id long, element string, x double, y double, z double, charge double")
    sinks.write_dump(atoms, str(tmp_path / "dump"), Box((0, 0, 0), (9, 9, 9)))
    archives.pack(spark, str(tmp_path / "dump"), str(tmp_path / "tar"), archive_bytes=300)
    key = lambda df: sorted(map(tuple, df.select("frame", "atom", "id", "element", "x", "y", "z", "charge").collect()))
    back, frames = archives.read_archived(spark, str(tmp_path / "tar"))
    assert key(back) == rows and frames.count() == 6
    assert key(archives.read_archived(spark, str(tmp_path / "tar"), "2-3")[0]) == [r for r in rows if r[0] in (2, 3)]
    assert key(trajectories.read_dump(spark, str(tmp_path / "dump"))) == rows


NAMES = ["a", "ab", "a.b", "x/a.b", "results", "x/results/y", "Al.restart.5000", "a+b", "a]b", "a^b", "a-b", "", "a\nb", "é.txt", "x[1]", "a\\b"]
PATTERNS = ["*", "a?", "*.b", "results", "*.restart*", "[ab]*", "[!a]*", "[^a]*", "a[]]b", "a[+-]b", "[", "a[b", "x[[]1]", "?.txt", "[a-c]b", "a.b", "x/*"]


def test_patterns_fit_as_file_names_do(spark):
    df = spark.createDataFrame([(n,) for n in NAMES] + [(None,)], "n string")
    for p in PATTERNS:
        got = {r["n"] for r in df.where(excluded(F.col("n"), (p,))).collect()}
        like = p.replace("[^", "[!")
        assert got == {n for n in NAMES if fnmatch.fnmatchcase(n, like) or any(fnmatch.fnmatchcase(x, like) for x in n.split("/") if x)}, p
    assert df.where(excluded(F.col("n"), ())).count() == 0
    assert [r["n"] for r in df.where(excluded(F.col("n"), ("a\\+b",))).collect()] == ["a+b"]


def test_key_in_a_pasted_text(spark):
    key = "key_" + "0123456789abcdef" * 2
    texts = [key, f"tool login {key}\n", f'"{key}"', key + "0", key.upper(), "key_12", "", None, f"{key} {key[:-1]}f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["k"] for r in df.orderBy("i").select(key_token(F.col("t"), "key_").alias("k")).collect()] == [key, key, key, None, None, None, None, None, key]
