"""PBF files: blobs, groups and numbers of every kind, and broken files."""

import zlib

import pytest

from shuttleframe.sources import pbf


def number(field, x):
    return pbf._number(field << 3) + pbf._number(x)


def zigzag(x):
    return x << 1 if x >= 0 else (-x << 1) - 1


def packed(xs):
    return b"".join(pbf._number(zigzag(x)) for x in xs)


def test_round_trip_in_many_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pbf, "PART_BYTES", 1)
    monkeypatch.setattr(pbf, "BLOCK", 3)
    ways = [(i, [i * 7 - 50, -i, 2**40 + i], {"highway": "primary", "name": f"Öd {i}"} if i % 3 else {}) for i in range(20)] + [(99, [], {"a": ""}), (2**62, [-(2**62)], {})]
    nodes = [(i - 10, i * 1000 - 9000, -(180_000_000) + i, {"k": "v"} if i % 4 == 1 else {}) for i in range(20)]
    for kind, rows in (("ways", ways), ("nodes", nodes)):
        pbf.write_pbf(spark.createDataFrame(rows, pbf.SCHEMAS[kind]).coalesce(2), str(tmp_path), kind)
    for kind, rows in (("ways", ways), ("nodes", nodes)):
        got = pbf.read_pbf(spark, str(tmp_path), kind)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(rows, key=repr)
    assert len(pbf.PbfReader(str(tmp_path), "ways").partitions()) >= 8


def test_plain_blobs_offsets_and_single_nodes(tmp_path):
    """A block by hand: its own unit and offset, a plain blob, nodes one by one and dense ones without tags."""
    table = pbf._bytes(1, b"".join(pbf._bytes(1, s) for s in (b"", b"ele", b"12")))
    node = pbf._bytes(1, number(1, zigzag(-5)) + number(8, zigzag(-3)) + number(9, zigzag(4)) + pbf._bytes(2, b"\1") + pbf._bytes(3, b"\2"))
    dense = pbf._bytes(2, pbf._bytes(1, packed([10, 1])) + pbf._bytes(8, packed([7, -9])) + pbf._bytes(9, packed([0, 1])))
    block = table + pbf._bytes(2, node) + pbf._bytes(2, dense) + number(17, 1000) + number(19, 500_000) + number(20, (1 << 64) - 2_000)
    blob = pbf._bytes(1, block)
    header = pbf._bytes(1, b"OSMData") + number(3, len(blob))
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(len(header).to_bytes(4, "big") + header + blob)
    reader = pbf.PbfReader(str(path), "nodes")
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert rows == [(-5, 497, 2, {"ele": "12"}), (10, 507, -2, {}), (11, 498, -1, {})]


@pytest.mark.parametrize(("data", "says"), [
    (b"\0\0\0\5ab", "ends within"), (b"\xff\xff\xff\xff", "not a PBF"), (pbf._blob("OSMHeader", pbf._bytes(4, b"HistoricalInformation")), "HistoricalInformation"), (pbf._blob("OSMData", b"")[:-2], "ends within"),
])
def test_broken_files_are_errors(tmp_path, data, says):
    path = tmp_path / "x.pbf"
    path.write_bytes(data)
    with pytest.raises((ValueError, IndexError), match=says):
        pbf.PbfReader(str(path), "ways").partitions()


def test_packed_numbers():
    xs = [0, 1, 127, 128, 2**32, 2**63 - 1]
    assert pbf._packed(b"".join(map(pbf._number, xs))).tolist() == xs
    assert pbf._signed(pbf._packed(packed([0, -1, 1, -(2**40)]))).tolist() == [0, -1, 1, -(2**40)]
    assert pbf._inflated(pbf._bytes(3, zlib.compress(b"abc"))) == b"abc"
