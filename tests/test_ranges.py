"""Parts of large files: members of archives, runs of elements of JSON."""

import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.sources import ranges, readers


def archive(kind, members):
    buffer = io.BytesIO()
    if kind.startswith("zip"):
        with zipfile.ZipFile(buffer, "w", {"zip": zipfile.ZIP_STORED, "zip-deflate": zipfile.ZIP_DEFLATED, "zip-bz2": zipfile.ZIP_BZIP2}[kind]) as z:
            for name, content in members.items():
                z.writestr(name, content)
    else:
        with tarfile.open(fileobj=buffer, mode=f"w:{kind[4:]}") as t:
            for name, content in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(content)
                t.addfile(info, io.BytesIO(content))
    return buffer.getvalue()


KINDS = ["zip", "zip-deflate", "zip-bz2", "tar-", "tar-gz", "tar-bz2", "tar-xz"]


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    rng = random.Random(1)
    want = {}
    for kind in KINDS:
        members = {f"a/{kind}-{i:02d}-x.png": rng.randbytes(rng.randrange(0, 5000)) for i in range(12)} | {"readme.txt": b"no"}
        (at / f"{kind}.bin").write_bytes(archive(kind, members))
        want |= {(kind, n): c for n, c in members.items() if n.endswith(".png")}
    (at / "bad.bin").write_bytes(b"PK nothing of the kind" * 9)
    (at / "cut.bin").write_bytes((at / "tar-gz.bin").read_bytes()[:900])
    (at / "none.bin").write_bytes(archive("zip", {"b.txt": b"x"}))
    (at / "empty.bin").write_bytes(b"")
    return str(at), want


def test_members_of_all_kinds(spark, archives):
    at, want = archives
    rows = readers.read_archive_members(spark, f"{at}/[ztn]*.bin", ".png").collect()
    assert {(r["archive"].rsplit("/", 1)[1][:-4], r["member"]): bytes(r["content"]) for r in rows} == want and len(rows) == len(want)


def test_archives_that_do_not_open_give_no_row(spark, archives):
    at, _ = archives
    assert readers.read_archive_members(spark, [f"{at}/bad.bin", f"{at}/none.bin", f"{at}/empty.bin"], ".png").count() == 0


def test_keys_choose_members_before_any_is_read(spark, archives, monkeypatch):
    at, want = archives
    keys = spark.createDataFrame([(f"{k}-{i:02d}",) for k in KINDS for i in (3, 7)] + [("zip-99",)], "key string")
    name = lambda member: F.regexp_extract(member, r"([^/]+)-x\.png$", 1)
    got = readers.read_archive_members(spark, f"{at}/[zt]*.bin", ".png", keys, name)
    assert {r["member"] for r in got.collect()} == {n for _, n in want if "-03-" in n or "-07-" in n}
    places = ranges.archive_places(spark, f"{at}/zip.bin", ".png")
    assert "content" not in places.columns and {r["kind"] for r in places.collect()} == {"range"}


def test_a_store_that_is_not_known_is_read_by_spark(spark, archives, monkeypatch):
    at, want = archives
    data = spark.read.format("binaryFile").load(f"{at}/zip.bin").select("path", "content")
    assert {r["member"]: bytes(r["content"]) for r in readers.unpacked(data, ".png").collect()} == {n: c for (k, n), c in want.items() if k == "zip"}
    assert list(ranges._places("viewfs://c/x.zip", ".png"))[0][2] == "whole"


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "ä", "x", " ", "\n"]) for _ in range(rng.randrange(0, 12)))


def odd_value(rng, depth=0):
    kind = rng.randrange(5 if depth < 3 else 2)
    if kind == 0:
        return odd_text(rng)
    if kind == 1:
        return rng.randrange(100)
    if kind == 2:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"{i}{odd_text(rng)}": odd_value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_parts_of_json_hold_every_element_once(seed, block):
    rng = random.Random(seed)
    indent = rng.choice([None, 2])
    for value, level in (([odd_value(rng) for _ in range(30)], 1), ([odd_value(rng) for _ in range(30)], 2), ({str(i): odd_value(rng) for i in range(20)}, 1)):
        data = json.dumps(value, indent=indent, ensure_ascii=rng.random() < 0.5).encode()
        parts = list(ranges.json_parts(lambda a, n: data[a : a + n], len(data), level, 40, block))
        own = [json.loads((b"[" if is_array else b"{") + data[a:z] + (b"]" if is_array else b"}")) for _, is_array, a, z in parts]
        assert len(own) > 1
        assert (sum(own, []) if isinstance(value, list) else {k: v for p in own for k, v in p.items()}) == value
    value = {"info": {"a": 1}, "images": [odd_value(rng) for _ in range(20)], "n": 3, "annotations": [odd_value(rng) for _ in range(20)], "categories": []}
    data = json.dumps(value, indent=indent).encode()
    found = {}
    for field, is_array, a, z in ranges.json_parts(lambda a, n: data[a : a + n], len(data), 2, 60, block):
        if is_array:
            found.setdefault(field, []).extend(json.loads(b"[" + data[a:z] + b"]"))
    assert found == {k: v for k, v in value.items() if isinstance(v, list)}


def test_coco_and_results_in_parts_equal_whole_files(spark, tmp_path):
    images = [{"id": i, "file_name": f'a"{i}\\.png', "height": 5, "width": 7} for i in range(300)]
    anns = [{"id": i, "image_id": i % 300, "category_id": 1, "bbox": [1.0, 2.0, 3.0, float(i)], "text": "x,]}" if i % 2 else None} for i in range(900)]
    for name, n in (("large", 900), ("small", 5)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"info": {"images": [1]}, "images": images[:n], "annotations": anns[:n], "categories": [{"id": 1, "name": "math"}]}))
    whole, parts = readers.read_coco(spark, str(tmp_path)), readers.read_coco(spark, str(tmp_path), 2000)
    assert ranges.json_places(ranges.listed(spark, str(tmp_path)), 2, 2000).where("field = 'annotations'").count() > 20
    for a, b in zip(whole, parts):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    (tmp_path / "lecture").mkdir()
    (tmp_path / "lecture" / "run.json").write_text(json.dumps({f"s{i}": [{"type": "math", "text": f"}}{k}"} for k in range(i % 4)] for i in range(200)}))
    at = str(tmp_path / "lecture" / "*.json")
    a, b = readers.read_run_results(spark, at).collect(), readers.read_run_results(spark, at, 500).collect()
    assert len(a) == 300 and sorted(map(str, a)) == sorted(map(str, b))
