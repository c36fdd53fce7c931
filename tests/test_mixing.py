"""The context-mixing coder: round trips, damage, gain, and the same bytes whatever is coded beside a string."""

import zlib

import numpy as np
import pytest

from lattica.functions import mixing
from lattica.operators import coding
from lattica.sources import container

RNG = np.random.default_rng(3)
TEXT = b" ".join(RNG.choice([b"spark", b"plans", b"joins", b"and", b"sorts", b"long", b"rows"], 150).tolist())
PARTS = [b"", b"a", b"\0" * 300, bytes(range(256)), RNG.bytes(400), TEXT, b"ab" * 200, TEXT[:100] * 4]


def test_round_trip_and_gain():
    coded = mixing.pack(PARTS)
    assert mixing.unpack(coded, [len(x) for x in PARTS]) == PARTS
    assert coded[0] == b"" and len(coded[4]) < 450 and len(coded[2]) < 20
    assert len(coded[5]) < len(zlib.compress(TEXT, 9))
    assert mixing.pack(PARTS[5:6]) == coded[5:6]


def test_rows_above_help():
    m = (RNG.integers(0, 256, 48) + RNG.integers(0, 2, (12, 48))).astype(np.uint8).tobytes()
    with_rows = mixing.pack([m], 48)
    assert len(with_rows[0]) < len(mixing.pack([m])[0])
    assert mixing.unpack(with_rows, [len(m)], 48) == [m]


@pytest.mark.parametrize("change", [lambda c: c[:-1], lambda c: c + b"\0", lambda c: c[:2], lambda c: b"", lambda c: c[:9] + bytes([c[9] ^ 4]) + c[10:]])
def test_damage_raises_or_differs(change):
    (coded,) = mixing.pack([TEXT])
    try:
        assert mixing.unpack([change(coded)], [len(TEXT)]) != [TEXT]
    except ValueError:
        pass
    with pytest.raises(ValueError):
        mixing.unpack([coded], [0])


def test_blobs_and_back(spark):
    data = {i: bytearray(x) for i, x in enumerate(PARTS)} | {99: None}
    blobs = spark.createDataFrame(list(data.items()), "blob_id int, content binary")
    rows = coding.mixed(blobs, 256)
    got = {r.blob_id: bytes(r.content) for r in container.reassembled(coding.unmixed(rows).select("blob_id", "segment", "content")).collect()}
    assert got == dict(enumerate(PARTS))
    assert {r.blob_id: r.n for r in coding.sizes(rows).collect()} == {i: len(x) for i, x in enumerate(PARTS)}
    assert coding.mixed(blobs.limit(0)).count() == 0
