import random
import time

import numpy as np
import pytest

from lumenflow.functions import apply
from lumenflow.operators import codes as C


def test_check_words_and_mending():
    rng = random.Random(1)
    for field, first in ((C.QR_FIELD, 0), (C.MATRIX_FIELD, 1)):
        for _ in range(60):
            n, size = rng.choice([7, 10, 18, 30]), rng.randint(3, 100)
            data = [rng.randrange(256) for _ in range(size)]
            words = data + field.checks(data, n, first)
            bad = list(words)
            for i in rng.sample(range(len(words)), rng.randint(0, n // 2)):
                bad[i] ^= rng.randrange(1, 256)
            assert field.corrected(bad, n, first) == words


def test_blocks_fill_their_symbols():
    for level in C.BLOCKS:
        for version, (checks, *groups) in enumerate(C.BLOCKS[level], 1):
            _, fixed = C._frame(version)
            assert sum(count * (size + checks) for count, size in groups) == int((~fixed).sum()) // 8
    for side in C.MATRIX_SIZES:
        places = C._matrix_places(side - 2)
        assert sorted(places[places >= 0].tolist()) == list(range(8 * sum(C.MATRIX_SIZES[side])))


def test_a_known_format_word():
    assert C._format_word("L", 4) == 0b110011000101111 and C._format_word("M", 0) == 0b101010000010010


@pytest.mark.parametrize("size", [1, 14, 40, 100, 150, 213])
def test_symbols_round_trip_with_damage(size):
    rng = random.Random(size)
    data = bytes(rng.randrange(32, 127) for _ in range(size))
    on = C.qr_modules(data)
    assert C.qr_text(on)[0] == data
    hurt = on.copy()
    y, x = rng.randrange(9, len(on) - 9), rng.randrange(9, len(on) - 9)
    hurt[y : y + 2, x : x + 2] ^= True
    assert C.qr_text(hurt)[0] == data
    if size <= 44:
        assert C.matrix_text(C.matrix_modules(data)) == data
    assert C.qr_modules(b"x" * 400) is None and C.matrix_modules(b"x" * 60) is None


def test_a_published_linear_code():
    assert "".join("1" if v else "0" for v in C.ean_bars("400638133393"))[:20] == "10100011010100111010"
    assert C.ean_text(np.repeat(C.ean_bars("400638133393"), 3)) == "4006381333931"


def _plain_penalty(on):
    """The rules of the mask's choice, module by module."""
    total = 0
    for line in [*on.tolist(), *on.T.tolist()]:
        text = "".join("01"[v] for v in line)
        runs = [len(r) for r in text.replace("01", "0 1").replace("10", "1 0").split()]
        total += sum(r - 2 for r in runs if r >= 5) + 40 * sum(text[k : k + 11] in ("10111010000", "00001011101") for k in range(len(text) - 10))
    n = len(on)
    total += 3 * sum(len({*on[y, x : x + 2].tolist(), *on[y + 1, x : x + 2].tolist()}) == 1 for y in range(n - 1) for x in range(n - 1))
    return total + 10 * int(abs(on.mean() * 100 - 50) // 5)


def test_many_symbols_together_are_those_of_one_each_and_soon_made():
    rng = np.random.default_rng(5)
    for level in "LH":
        texts = [bytes(rng.integers(0, 256, k, dtype=np.uint8)) for k in (1, 17, 18, 40, 60, 90, 110, 119, 200, 5, 5)]
        found = {i: on for places, many in C.qr_symbols(texts, level) for i, on in zip(places, many, strict=True)}
        for i, text in enumerate(texts):
            alone = C.qr_modules(text, level)
            assert (alone is None) == (i not in found) and (alone is None or np.array_equal(found[i], alone))
            if alone is not None:
                assert C.qr_text(alone)[0] == text
                rows, columns = C._lines(alone[None]), C._lines(alone.T[None])
                assert C._penalties(rows, columns, len(alone)) == [_plain_penalty(alone)]
    began = time.time()
    assert sum(len(places) for places, _ in C.qr_symbols([f"Supplier#{k:09d}".encode() for k in range(3000)])) == 3000
    assert time.time() - began < 15  # one by one they took 22 ms each


def _frames(spark, images):
    rows = [(i, v.shape[1], v.shape[0], 1, "Mono8", 0, "t", v.tobytes()) for i, v in enumerate(images)]
    return spark.createDataFrame([(a, b, c, d, e, f, g, bytearray(h)) for a, b, c, d, e, f, g, h in rows], "frame_id long, width int, height int, channels int, format string, timestamp_us long, source_id string, data binary")


def test_readers(spark):
    data = spark.createDataFrame([(0, "hello"), (1, "ÄÖ 漢字"), (2, ""), (3, None), (4, "x" * 500)], "frame_id long, data string")
    made = apply("QRGenerate", data, size=200).cache()
    assert {r["frame_id"]: r["success"] for r in made.collect()} == {0: True, 1: True, 2: False, 3: False, 4: False}
    got = {r["frame_id"]: r for r in apply("QRCodeDecode", made.drop("success")).collect()}
    assert {i: (r["data"], r["found"]) for i, r in got.items()} == {0: ("hello", True), 1: ("ÄÖ 漢字", True)}

    qr, dm = C.drawn(C.qr_modules(b"turned"), 150), C.drawn(C.matrix_modules(b"MATRIX 42"), 90)
    bars = np.full((60, 400), 255, np.uint8)
    bars[10:50, 20:305] = np.where(np.repeat(C.ean_bars("400638133393"), 3), 0, 255)
    k = np.maximum(*np.abs(np.indices((41, 41)) - 20))
    eye = np.where((k // 4) % 2 == 0, 0, 255).astype(np.uint8)
    eye[k > 18] = 255
    frames = _frames(spark, [np.rot90(qr).copy(), dm, np.rot90(dm, 2).copy(), bars, np.full((30, 30), 200, np.uint8), eye]).cache()
    rows = lambda t, **p: {r["frame_id"]: r for r in apply(t, frames, **p).collect()}
    assert [r["data"] for _, r in sorted(rows("BarcodeDecode").items())][:5] == ["turned", "MATRIX 42", "MATRIX 42", "4006381333931", ""]
    assert rows("QRCodeDecodeEnhanced")[0]["version"] == 1 and not rows("QRCodeDecode", try_rotate=False)[0]["found"]
    assert rows("DataMatrixDecode")[1]["data"] == rows("DataMatrixDecodeEnhanced")[1]["data"] == "MATRIX 42"
    assert rows("IDReader", orientation=90)[0]["barcode_data"] == "turned"
    assert [rows("AztecCodeDecode")[i]["data"] for i in (4, 5)] == ["", "AZTEC_DETECTED"] and rows("MaxiCodeDecode")[5]["found"]
    assert rows("BarcodeVerify", expected_data="turned")[0]["verified"] and not rows("BarcodeVerify", expected_data="tuned")[0]["verified"]
    assert abs(rows("BarcodeVerify", expected_data="turner", strict_mode=False)[0]["match_score"] - 5 / 6) < 1e-9
    grade = rows("BarcodeGrade")
    assert grade[1]["grade_letter"] in "AB" and grade[4]["grade"] == 0 and grade[4]["symbol_contrast"] == 0
    assert rows("BarcodeTrain")[4]["template"].startswith("BARCODE_TEMPLATE_QR_CODE_30x30")
