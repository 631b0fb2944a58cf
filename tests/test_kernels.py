import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import calibrator, kernels


def hamming(q, d):
    return float(sum(48 - min(((a ^ b) & kernels.MASK).bit_count() for b in d) for a in q)) if q and d else 0.0


def cosine(q, d):
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v]
    return sum(max(sum(x * y for x, y in zip(unit(a), unit(b))) for b in d) for a in q) if q and d else 0.0


CASES = [([0, 3], [1, 3], 95.0), ([1], [1], 48.0), ([], [1], 0.0), ([1], [], 0.0), (None, [1], None), ([1], None, None), ([1 << 50], [0], 48.0)]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(i, q, d) for i, (q, d, _) in enumerate(CASES)], "i int, q array<bigint>, d array<bigint>")


def test_hamming_golden_values_in_columns_and_sql(spark, words):
    kernels.register(spark)
    words.createOrReplaceTempView("kernel_words")
    column = [r[0] for r in words.orderBy("i").select(kernels.hamming_maxsim("q", "d")).collect()]
    sql = [r[0] for r in spark.sql("SELECT hamming_maxsim(q, d) FROM kernel_words ORDER BY i").collect()]
    assert column == sql == [want for *_, want in CASES]


def test_hamming_constant_query_matches_brute_force(spark):
    r = random.Random(7)
    for n in (1, 5, 40):
        q = [r.getrandbits(48) for _ in range(n)]
        docs = [[r.getrandbits(48) for _ in range(r.randrange(6))] for _ in range(20)]
        frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(99, None)], "i int, d array<bigint>")
        got = {x.i: x.s for x in frame.select("i", kernels.hamming_maxsim(q, "d").alias("s")).collect()}
        assert got == {**{i: hamming(q, d) for i, d in enumerate(docs)}, 99: None}


def test_words_of_bytes(spark):
    rows = [bytes.fromhex("FFEEDDCCBBAA9988"), *kernels.bytes_of_words([0, 5, kernels.MASK])]
    frame = spark.createDataFrame([([bytearray(x) for x in rows],)], "b array<binary>")
    assert frame.select(kernels.words_of_bytes("b")).first()[0] == [0xAABBCCDDEEFF, 0, 5, kernels.MASK]
    short = spark.createDataFrame([([bytearray(b"abc")],)], "b array<binary>")
    with pytest.raises(Exception, match="8 bytes"):
        short.select(kernels.words_of_bytes("b")).collect()


def test_cosine(spark):
    r = random.Random(8)
    cases = [([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [1.0, 1.0]]), ([[0.0, 0.0]], [[1.0, 2.0]]), ([], [[1.0, 0.0]]), ([[1.0, 0.0]], [])]
    cases += [([[r.gauss(0, 1) for _ in range(4)] for _ in range(3)], [[r.gauss(0, 1) for _ in range(4)] for _ in range(5)]) for _ in range(10)]
    frame = spark.createDataFrame([(i, q, d) for i, (q, d) in enumerate(cases)], "i int, q array<array<double>>, d array<array<double>>")
    got = [x.s for x in frame.orderBy("i").select(kernels.cosine_maxsim("q", "d").alias("s")).collect()]
    assert got == pytest.approx([cosine(q, d) for q, d in cases]) and got[0] == pytest.approx(1 + 2**-0.5)
    q, d = cases[-1]
    assert frame.where(F.col("i") == len(cases) - 1).select(kernels.cosine_to(q, "d")).first()[0] == pytest.approx(cosine(q, d))
    wrong = spark.createDataFrame([([[1.0]], [[1.0, 2.0]])], "q array<array<double>>, d array<array<double>>")
    with pytest.raises(Exception, match="dimensions differ"):
        wrong.select(kernels.cosine_maxsim("q", "d")).collect()


def test_text_tokens(spark):
    frame = spark.createDataFrame([("Ab-c d3 É x_y",), ("",), (None,)], "t string")
    assert [r[0] for r in frame.select(kernels.text_tokens("t")).collect()] == [["ab", "c", "d3", "x", "y"], [], None]


def test_calibration_and_codes(spark):
    r = random.Random(9)
    vectors = [[r.gauss(0, 1) for _ in range(48)] for _ in range(41)]
    frame = spark.createDataFrame([(v,) for v in vectors], "v array<float>")
    fitted = calibrator.fit(frame, "v")
    import numpy as np

    rows = np.array(vectors, np.float32)
    assert fitted.thresholds == pytest.approx(np.median(rows, axis=0).tolist())
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(48, 48)))[0].astype(np.float32)
    for own in (fitted, calibrator.Calibrator(fitted.thresholds, tuple(map(tuple, turn.tolist())))):
        spun = rows if own.rotation is None else rows @ turn
        want = [int(sum(1 << i for i in np.flatnonzero(b).tolist())) for b in spun > np.median(rows, axis=0).astype(np.float32)]
        got = spark.createDataFrame([(vectors,)], "t array<array<float>>").select(own.words("t")).first()[0]
        assert got == want == own.encode(vectors)


def test_padding(spark):
    own = calibrator.Calibrator((0.0,) * 48)
    frame = spark.createDataFrame([([[1.0, -1.0, 2.0]],)], "t array<array<float>>")
    assert frame.select(own.words("t")).first()[0] == [0b101]
    with pytest.raises(Exception, match="at most 48"):
        spark.createDataFrame([([[1.0] * 49],)], "t array<array<float>>").select(own.words("t")).collect()


def test_sidecar(tmp_path):
    own = calibrator.Calibrator(tuple(float(i) for i in range(48)))
    path = tmp_path / "c" / "side.json"
    own.save(path, encoder_id="enc")
    assert calibrator.Calibrator.load(path, encoder_id="enc") == own
    with pytest.raises(ValueError, match="encoder_id mismatch"):
        calibrator.Calibrator.load(path, encoder_id="other")
    path.write_text(path.read_text().replace("47.0", "46.5"))
    with pytest.raises(ValueError, match="checksum mismatch"):
        calibrator.Calibrator.load(path)
    with pytest.raises(ValueError, match="rotation matrix shape"):
        calibrator.Calibrator(own.thresholds, ((1.0,),))
