"""One JSON object read by byte ranges."""

import json
import random

import pytest

from tierscope.sources import dictionaries, text

HARD = ['plain', '', ',', ', ', '", "', '\\', '\\\\', '\\"', '", "7": "no entry', '"1":', ', "5"', "é 日本 😀", ':', '{"8": "x"}']


def drawn(seed, n):
    rng = random.Random(seed)
    return {str(i * 7): "".join(rng.choices(HARD, k=rng.randint(0, 4))) for i in range(n)}


@pytest.mark.parametrize("indent, separators, ascii", [
    (None, None, True), (None, (",", ":"), False), (1, None, False), (None, (" , ", " : "), True),
])
@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_every_entry_comes_once_whatever_the_ranges(tmp_path, monkeypatch, indent, separators, ascii, size):
    monkeypatch.setattr(dictionaries, "READ_BYTES", 50)
    monkeypatch.setattr(dictionaries, "LONGEST_KEY", 32)
    names = drawn(size, 60)
    path = tmp_path / "names.json"
    path.write_text(json.dumps(names, indent=indent, separators=separators, ensure_ascii=ascii), "utf-8")
    parts = dictionaries.ranges(str(path), size)
    assert len(parts) == -(-path.stat().st_size // size)
    found = [pair for part in parts for pair in dictionaries.entries(part).items()]
    assert sorted(found) == sorted(names.items())


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    names = drawn(1, 3000) | {"x": "no number", "9": None, "11": "last"}
    path = tmp_path / "names.json"
    path.write_text(json.dumps(names))
    df = dictionaries.read_drug_dictionary(spark, str(path), 4096)
    assert df.rdd.getNumPartitions() == -(-path.stat().st_size // 4096) > 10
    want = text.read_drug_names(spark, str(path))
    assert df.dtypes == want.dtypes
    assert sorted(map(repr, df.collect())) == sorted(map(repr, want.collect()))


def test_folders_and_empty_objects(spark, tmp_path):
    for i, names in enumerate(({"1": "a"}, {}, {"2": "b", "3": "c"})):
        (tmp_path / f"{i}.json").write_text(json.dumps(names))
    (tmp_path / "_SUCCESS").write_text("")
    df = dictionaries.read_drug_dictionary(spark, f"file:{tmp_path}", 5)
    assert sorted(r["rxcui"] for r in df.collect()) == [1, 2, 3]
    with pytest.raises(FileNotFoundError):
        dictionaries.ranges(str(tmp_path / "none"))
