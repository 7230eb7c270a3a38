"""Runs are whole or passed over, and writers at once lose nothing."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from tensorloom.sources import manifest


def runs(spark, root):
    for k in (1, 2, 3):
        manifest.save(spark, root, {"loops": spark.range(100 * k).repartition(4), "sites": spark.range(k)}, L=6, k=k)


def files(root, n, name="loops"):
    spark_run = sorted(glob.glob(f"{root}/data/*"), key=os.path.getmtime)[n]
    return sorted(glob.glob(f"{spark_run}/{name}/part-*"))


@pytest.fixture
def root(spark, tmp_path):
    runs(spark, str(tmp_path))
    return str(tmp_path)


def test_newest_whole_run(spark, root):
    assert manifest.load_latest(spark, root, "loops").count() == 300
    assert manifest.load_latest(spark, root, "loops", k=2).count() == 200 and manifest.load_latest(spark, root, "sites", L=6).count() == 3
    with pytest.raises(FileNotFoundError):
        manifest.load_latest(spark, root, "loops", L=7)
    with pytest.raises(FileNotFoundError):
        manifest.load_latest(spark, root, "absent")


def test_a_run_without_a_file_is_passed_over(spark, root):
    os.remove(files(root, 2)[1])
    assert manifest.load_latest(spark, root, "loops").count() == 200
    # The other table of that run is whole.
    assert manifest.load_latest(spark, root, "sites").count() == 3


def test_a_broken_file_is_seen(spark, root):
    at = files(root, 2)[0]
    data = bytearray(open(at, "rb").read())
    data[len(data) // 2] ^= 1
    open(at, "wb").write(data)
    assert manifest.load_latest(spark, root, "loops").count() == 200
    # Without the checksum that local files have beside them, the digest alone tells.
    os.remove(f"{os.path.dirname(at)}/.{os.path.basename(at)}.crc")
    assert manifest.load_latest(spark, root, "loops").count() == 200
    at = files(root, 1)[0]
    open(at, "ab").write(b"more")
    assert manifest.load_latest(spark, root, "loops", check=False, k=1).count() == 100 and manifest.load_latest(spark, root, "loops").count() == 100


def test_a_broken_manifest_and_half_a_run(spark, root):
    open(f"{root}/manifest/00000003.json", "w").write('{"body": "{}", "digest": "0"}')
    assert manifest.load_latest(spark, root, "loops").count() == 200
    # Tables without a manifest, as a writer leaves them that ends before its last step.
    spark.range(9999).write.parquet(f"{root}/data/lost/loops")
    assert manifest.load_latest(spark, root, "loops").count() == 200


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: manifest.save(spark, root, {"t": spark.range(k + 1)}, k=k), range(8)))
    assert sorted(numbers) == list(range(1, 9))
    assert all(manifest.load_latest(spark, root, "t", k=k).count() == k + 1 for k in range(8))


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        manifest.load_latest(spark, root, "t")
    manifest.save(spark, root, {"t": spark.range(0)})
    assert manifest.load_latest(spark, root, "t").count() == 0


def test_the_catalogue_passes_over_broken_runs(spark, tmp_path):
    from tensorloom.sources import catalog

    root = str(tmp_path)
    for k in (1, 2):
        catalog.save_run(spark, root, {"loops": spark.range(100 * k).repartition(4)}, L=6, max_weight=4, bc="periodic", run=f"r{k}")
    latest = lambda: catalog.load_latest(spark, root, "loops", L=6).count()
    assert latest() == 200
    at = sorted(glob.glob(f"{root}/loops/L=6/max_weight=4/bc=periodic/run=r2/part-*"))[0]
    data = open(at, "rb").read()
    open(at, "wb").write(data[: len(data) // 2])
    assert latest() == 100
    os.remove(glob.glob(f"{root}/loops/L=6/max_weight=4/bc=periodic/run=r1/part-*")[0])
    with pytest.raises(FileNotFoundError):
        latest()
