"""Archives read member by member."""

import hashlib
import resource
import zipfile

import pyarrow as pa
import pytest
from conftest import as_dicts

from tierscope.plans import registry
from tierscope.sources import archives, text


def pack(path, members, kind=zipfile.ZIP_DEFLATED):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", kind) as archive:
        archive.mkdir("folder")
        for name, text in members.items():
            archive.writestr(f"folder/{name}", text.encode("latin-1"))
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2])
def test_members_are_partitions(spark, tmp_path, kind):
    pack(tmp_path / "in" / "one.zip", {"a": "NDC|Unit Cost\n1|2.5\n", "b": "UNIT COST|X|NDC\n7|y|é\n"}, kind)
    pack(tmp_path / "in" / "deep" / "two.ZIP", {"c": "NDC\n3\n", "none": "", "header": "NDC\n"}, kind)
    (tmp_path / "in" / "note.txt").write_text("no archive")
    for path in (tmp_path / "in", f"file:{tmp_path}/in/", f"file://{tmp_path}/in"):
        df = archives.read_zip_members(spark, str(path), ["ndc", "unit_cost"], "ISO-8859-1")
        assert df.rdd.getNumPartitions() == 5
        assert rows(df) == [("1", "2.5"), ("3", None), ("é", "7")]
    one = archives.read_zip_members(spark, str(tmp_path / "in" / "one.zip"), encoding="ISO-8859-1")
    assert one.columns == ["ndc", "unit_cost"] and one.count() == 2


def test_only_the_directory_and_a_members_own_bytes_are_read(tmp_path, monkeypatch):
    text = "A|B\n" + "".join(f"{i}|{i * i}\n" for i in range(20_000))
    path = pack(tmp_path / "x.zip", {f"m{i}": text for i in range(30)})
    read = []
    opened = archives._opened

    class Counting:
        def __init__(self, store):
            self.store = store

        def open_input_file(self, place):
            file, self_read = self.store.open_input_file(place), read

            class File:
                def __getattr__(self, name):
                    return getattr(file, name)

                def read(self, n=-1):
                    data = file.read(n) if n is not None and n >= 0 else file.read()
                    self_read.append(len(data))
                    return data

                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    file.close()

            return File()

    monkeypatch.setattr(archives, "_opened", lambda p: (Counting(opened(p)[0]), opened(p)[1]))
    found = archives.members(path)
    assert len(found) == 30 and sum(read) < 10_000
    read.clear()
    with archives.open_member(found[17]) as stream:
        assert stream.read().decode() == text
    assert sum(read) < 1.2 * found[17].info.compress_size + 100


def test_memory_does_not_follow_the_archive(tmp_path):
    lines = "".join(f"{i % 1000:04d}|{i % 7}|some text that packs well\n" for i in range(100_000))

    def read(times):
        with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            with archive.open("big.txt", "w", force_zip64=True) as out:
                out.write(b"A|B|C\n")
                for _ in range(times):  # 3 MB each unpacked
                    out.write(lines.encode())
        (member,) = archives.members(str(tmp_path / "big.zip"))
        reader = archives.MembersReader("", ["a", "c"], "UTF-8")
        assert sum(batch.num_rows for batch in reader.read(member)) == 100_000 * times
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss  # KB

    small = read(40)
    assert read(120) - small < 50_000


def test_written_archives_are_streamed(spark, tmp_path):
    writer, seen = registry._archive_writer(str(tmp_path / "out"), "A|B"), []

    def batches(n):
        for i in range(n):
            seen.append(sum(f.stat().st_size for f in tmp_path.rglob("*.zip")))
            lines = [hashlib.md5(b"%d %d" % (i, k)).hexdigest() + "|x" for k in range(5_000)]
            yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["line"])

    task = type("Task", (), {"partitionId": lambda self: 3})()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(registry.TaskContext, "get", lambda: task)
        assert [b.column(0).to_pylist() for b in writer(batches(20))] == [["3.zip"]]
        assert list(writer(iter([]))) == []
    assert seen[10] > 500_000 and seen[-1] > seen[10]  # what came before is in the file
    df = text.read_pipe_zip(spark, str(tmp_path / "out"))
    assert df.columns == ["a", "b"] and df.distinct().count() == 100_000


def test_small_members_share_a_task(spark, tmp_path):
    big = "".join(f"{i}|{i * 7919 % 10007}\n" for i in range(60_000))
    for name in "xy":
        members = {f"m{i}": f"B|A\n{i}|{name}\n" for i in range(1500)}
        pack(tmp_path / f"{name}.zip", {**members, "big": "A|B\n" + big, "none": ""})
    df = archives.read_zip_members(spark, str(tmp_path), ["a", "b"])
    parts = archives.MembersReader(str(tmp_path), ["a", "b"], "UTF-8").partitions()
    assert 64 <= len(parts) == df.rdd.getNumPartitions() <= 140
    assert sum(len(p.members) for p in parts) == 3004
    alone = [p for p in parts if any(m.info.filename == "folder/big" for m in p.members)]
    assert len(alone) == 2 and all(len(p.members) == 1 for p in alone)
    want = [(name, str(i)) for name in "xy" for i in range(1500)]
    want += 2 * [tuple(line.split("|")) for line in big.split()]
    assert rows(df) == sorted(want)


def test_damage_is_an_error(spark, tmp_path):
    path = tmp_path / "x.zip"
    pack(path, {"a": "A\n" + "12345\n" * 5000})
    data = bytearray(path.read_bytes())
    data[200] ^= 255
    path.write_bytes(bytes(data))
    with pytest.raises(Exception):
        archives.read_zip_members(spark, str(path)).collect()
    with pytest.raises(FileNotFoundError):
        archives.archive_paths(str(tmp_path / "none"))
    assert archives.can_open(str(path)) and not archives.can_open("viewfs://store/in")


def test_header_only_archives(spark, tmp_path):
    path = pack(tmp_path / "x.zip", {"a": "", "b": "A|B\n"})
    df = archives.read_zip_members(spark, path)
    assert df.columns == ["a", "b"] and as_dicts(df) == []
