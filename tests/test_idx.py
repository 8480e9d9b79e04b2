"""Labels and images by index; files that are not what they say are refused."""

import gzip
import struct

import pytest

from axonlake.sources.idx import Idx


def labels(values, magic=2049, count=None):
    return struct.pack(">II", magic, len(values) if count is None else count) + bytes(values)


def images(n, rows=3, cols=2, magic=2051):
    return struct.pack(">IIII", magic, n, rows, cols) + bytes((7 * i) % 256 for i in range(n * rows * cols))


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(Idx)


def load(spark, tmp_path, data, packed=True, **options):
    path = tmp_path / "x.idx"
    path.write_bytes(gzip.compress(data) if packed else data)
    return spark.read.format("idx").options(**options).load(str(path))


@pytest.mark.parametrize("packed", [True, False])
def test_labels_and_images_by_index(spark, tmp_path, packed):
    values = [i % 10 for i in range(25)]
    df = load(spark, tmp_path, labels(values), packed, records=10, classes=10, count=25)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect())) == list(enumerate(values))
    got = {r["index"]: r for r in load(spark, tmp_path, images(11), packed, kind="images", records=4, rows=3, cols=2).collect()}
    assert len(got) == 11 and all(bytes(got[i]["pixels"]) == bytes((7 * (6 * i + k)) % 256 for k in range(6)) and got[i]["rows"] == 3 for i in got)


@pytest.mark.parametrize(
    "data,options,said",
    [
        (labels([1, 2], magic=2051), {}, "begin as"),
        (labels([]), {}, "no records"),
        (labels([1, 2, 3], count=4), {}, "ends within"),
        (labels([1, 2, 3], count=2), {"records": 1}, "follow"),
        (labels([1, 12]), {"classes": 10}, "not below"),
        (labels([1, 2]), {"count": 3}, "count is 2"),
        (images(2)[:-1], {"kind": "images"}, "ends within"),
        (images(2), {"kind": "images", "rows": 28}, "rows is 3"),
        (b"\0\0\x08", {}, "ends within"),
    ],
)
def test_files_that_are_refused(spark, tmp_path, data, options, said):
    with pytest.raises(Exception, match=said):
        load(spark, tmp_path, data, **options).collect()
