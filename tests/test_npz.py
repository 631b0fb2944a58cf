import numpy as np
import pytest

from quillon.sources import fixtures, npz


@pytest.fixture(params=["stored", "compressed"])
def archive(request, tmp_path):
    r = np.random.default_rng(1)
    ids, tokens = np.array([f"d{k}" for k in range(530)]), r.normal(size=(530, 3, 8)).astype(np.float16)
    path = tmp_path / "corpus.npz"
    (np.savez if request.param == "stored" else np.savez_compressed)(path, doc_ids=ids, doc_tokens=tokens, other=np.ones(3))
    return path, {i: t.astype(np.float32).tolist() for i, t in zip(ids.tolist(), tokens)}


@pytest.mark.parametrize("size", [1, 1000, 1 << 20])
def test_equal_to_numpy_at_any_partitioning(spark, archive, monkeypatch, size):
    path, want = archive
    found = npz.matrices(spark, str(path), "doc", partition_bytes=size)
    assert found.rdd.getNumPartitions() == (530 if size == 1 else -(-530 // (1000 // 48)) if size == 1000 else 1)
    assert {r.id: r.fp16 for r in found.collect()} == want
    assert {r.id: r.fp16 for r in fixtures.token_matrices(spark, path.as_uri(), "doc").collect()} == want


def test_blocks_are_bounded(archive, monkeypatch):
    path, want = archive
    monkeypatch.setattr(npz, "BLOCK", 100)
    reader = npz._Reader({"path": str(path), "ids": "doc_ids", "rows": "doc_tokens", "partitionBytes": "5000"})
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    assert dict(rows) == want and len(rows) == 530


def test_wrong_archives(spark, tmp_path):
    ones = np.ones((2, 3, 4))
    for name, arrays, error in [("few", {"doc_ids": np.array(["a"]), "doc_tokens": ones}, "1 ids and 2 rows"), ("flat", {"doc_ids": np.array(["a", "b"]), "doc_tokens": ones[0, :2]}, "three dimensions"), ("fortran", {"doc_ids": np.array(["a", "b"]), "doc_tokens": np.asfortranarray(ones)}, "Fortran"), ("objects", {"doc_ids": np.array([None, "b"]), "doc_tokens": ones}, "objects")]:
        np.savez(tmp_path / f"{name}.npz", **arrays)
        with pytest.raises(Exception, match=error):
            npz._Reader({"path": str(tmp_path / f"{name}.npz"), "ids": "doc_ids", "rows": "doc_tokens"}).partitions()
    np.savez(tmp_path / "none.npz", doc_ids=np.array([], str), doc_tokens=np.ones((0, 3, 4)))
    assert fixtures.token_matrices(spark, str(tmp_path / "none.npz"), "doc").collect() == []
    with pytest.raises(ValueError, match="all machines"):
        npz.matrices(spark, "hdfs://host/x.npz", "doc")
