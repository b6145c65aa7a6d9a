import base64
import hashlib
import random

import pytest
from scholia.llm import warc

KIND = "page_id long, url string, html string"


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows, min_bytes=0):
    """(page_id, bytes, digest, type, refers_to) of each row, by a plain reading."""
    out, first = [], {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in rows:
        p, f = (h or "").encode(), first.get(h or "")
        again = f is not None and i != f and len(p) >= min_bytes
        out.append((i, len(p), b32(p), "revisit" if again else "response", f if again else None))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, f"http://a.example/{i % 40}", f"page {rng.randrange(90)} " * rng.randrange(1, 60) + "\r\n\r\nHTTP/1.1 é") for i in range(200)]
    out += [(i, "http://b.example/", "one page of many") for i in range(300, 400)]
    return out + [(500, None, None), (501, "", ""), (None, "http://c.example/", "no id"), (None, "http://c.example/", "one page of many"), (502, "a b\nc", "x" * 3_000_000), (503, "u", "twice"), (503, "u", "twice"), (503, "v", "twice")]


def files(folder):
    import pathlib

    return {p.name: p.read_bytes() for p in pathlib.Path(folder).glob("*.warc.gz")}


def test_report_and_files(spark, rows, tmp_path, monkeypatch):
    df = spark.createDataFrame(rows, KIND)
    assert sorted(repr(tuple(r)) for r in warc.report(df.repartition(5)).collect()) == plain(rows)
    kinds = set()
    for n, parts in enumerate((1, 7)):
        shuffled = random.Random(n).sample(rows, len(rows))
        manifest = warc.write(spark.createDataFrame(shuffled, KIND).repartition(parts), str(tmp_path / str(n)), roll_bytes=4000).collect()
        found = files(tmp_path / str(n))
        assert {r["name"]: (r["bytes"], r["sha256"]) for r in manifest} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in found.items()}
        kinds.add(tuple(sorted((k, hashlib.sha256(v).hexdigest()) for k, v in found.items())))
        assert not (tmp_path / str(n) / "_temporary").exists()
        big = [r for r in manifest if r["bytes"] > 4000]
        assert all(r["records"] == 2 for r in big)  # only a record that is longer than the limit by itself
        assert any(r["name"].endswith("-00001.warc.gz") for r in manifest)
    assert len(kinds) == 1  # the same rows give the same files, however they lie
    got = warc.read(spark, str(tmp_path / "0")).collect()
    assert len({r.record_id for r in got}) == len(rows)
    assert sorted(r.payload for r in got if r.type == "response") == sorted((rows[k][2] or "").encode() for k in range(len(rows)) if is_response(rows, k))
    order = [r.page_id for name in sorted(files(tmp_path / "0")) for r in read_file(tmp_path / "0" / name) if r is not None]
    ids = [i for i in order if i is not None]
    assert ids == sorted(ids) and order[-2:] == [None, None]


def is_response(rows, k):
    i, _, h = rows[k]
    ids = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
    return not ids or i == min(ids)


def read_file(path):
    from types import SimpleNamespace

    with open(path, "rb") as f:
        for raw in warc.members(f):
            row = warc._row(*warc.parse(raw), False)
            yield SimpleNamespace(**row) if row else None


def test_least_bytes(spark, rows, tmp_path):
    warc.write(spark.createDataFrame(rows, KIND), str(tmp_path / "a"), min_bytes=10)
    got = warc.read(spark, str(tmp_path / "a"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "type", "refers_to").collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows, 10)


def test_equal_rows_fill_several_shards(spark, tmp_path):
    data = [(7, "u", "y" * 5000)] * 60 + [(i, "u", f"{i} " * 20) for i in range(20)]
    manifest = warc.write(spark.createDataFrame(data, KIND).repartition(4), str(tmp_path / "a"), shard_bytes=20_000).collect()
    got = warc.read(spark, str(tmp_path / "a"), payloads=False).collect()
    assert len(got) == 80 and len({r.record_id for r in got}) == 80
    assert max(r["records"] for r in manifest) < 30


def test_odd_tables(spark, tmp_path):
    assert warc.report(spark.createDataFrame([], KIND)).count() == 0
    odd = spark.createDataFrame([(1, "u", "a", 1, "x"), (2, "v", "a", 2, "y")], "page_id long, url string, html string, none int, `digest.x` string")
    assert sorted(tuple(r) for r in warc.report(odd).collect()) == [(1, 1, b32(b"a"), "response", None), (2, 1, b32(b"a"), "revisit", 1)]


def test_damage_is_told(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "some text")], KIND), str(tmp_path / "a"))
    name, held = next(iter(files(tmp_path / "a").items()))
    (tmp_path / "a" / name).write_bytes(held[:-30])
    with pytest.raises(Exception, match="size that the manifest says"):
        warc.read(spark, str(tmp_path / "a")).count()
    with pytest.raises(ValueError, match="within a record"):
        list(read_file(tmp_path / "a" / name))


def test_a_commit_may_be_tried_again(spark, tmp_path):
    import pyarrow as pa

    store, path = warc.fs.FileSystem.from_uri(str(tmp_path))
    f = warc._File(store, path, 0, 0, "p", warc.DATE)
    row = f.row()
    assert list(warc._commit_files(iter([row]), str(tmp_path))) and list(warc._commit_files(iter([row]), str(tmp_path)))
    with pytest.raises(FileNotFoundError):
        list(warc._commit_files(iter([pa.RecordBatch.from_pylist([row.to_pylist()[0] | {"name": "gone", "held": "_temporary/gone"}], schema=row.schema)]), str(tmp_path)))
