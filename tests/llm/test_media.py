import hashlib
import zlib

import numpy as np
import pytest

from brightloom.llm import flac, media


def payloads():
    rng = np.random.default_rng(3)
    return [
        b" " * 192,
        bytes(range(192)),
        rng.integers(0, 256, 192 * 31, dtype=np.uint8).tobytes(),
        b"\0" * (192 * 13),
        bytes([0, 255] * 96 * 7),
        (np.sin(np.arange(192 * 20) / 9) * 100 + 128).astype(np.uint8).tobytes(),
        (np.arange(192 * 10) // 3 % 256).astype(np.uint8).tobytes(),
        "é naïve text, ".encode() * 192,
    ]


def test_round_trip_and_seek_points():
    streams = flac.encode(payloads())
    assert [x.tobytes() for x in flac.decode(streams)] == payloads()
    for stream in streams:
        starts = {f[0] for f in flac.find_frames(stream)}
        assert all(offset in starts for _, offset, _ in flac.seek_points(stream))
    assert flac.encode(payloads()[3:4]) == flac.encode(payloads())[3:4]  # whatever else is in the batch


def one_by_one(stream):
    """A plain decoder, bit by bit."""
    bits = "".join(f"{b:08b}" for b in stream)
    out = []
    for at, head, n in flac.find_frames(stream):
        p = (at + head) * 8

        def take(w, signed=False):
            nonlocal p
            v = int(bits[p : p + w], 2) if w else 0
            p += w
            return v - (1 << w) if signed and w and v >> (w - 1) else v

        kind = take(8) >> 1
        if kind == 0:
            out += [take(8, True)] * n
            continue
        if kind == 1:
            out += [take(8, True) for _ in range(n)]
            continue
        order = kind - 8 if kind < 32 else (kind & 31) + 1
        s = [take(8, True) for _ in range(order)]
        coefficients, shift = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}.get(order, []) if kind < 32 else [], 0
        if kind >= 32:
            precision, shift = take(4) + 1, take(5, True)
            coefficients = [take(precision, True) for _ in range(order)]
        assert take(2) == 0
        parts = take(4)
        for j in range(1 << parts):
            k = take(4)
            for _ in range((n >> parts) - (order if j == 0 else 0)):
                q = bits.index("1", p) - p
                p += q + 1
                u = q << k | take(k)
                s.append(((u >> 1) ^ -(u & 1)) + (sum(c * s[-1 - i] for i, c in enumerate(coefficients)) >> shift))
        out += s
    return bytes(x + 128 for x in out)


def test_a_plain_decoder_agrees():
    for payload, stream in zip(payloads(), flac.encode(payloads())):
        assert one_by_one(stream) == payload


def test_damage_is_noticed():
    stream = bytearray(flac.encode(payloads()[7:])[0])
    stream[-9] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def test_query_columns(spark):
    long = "ß long text " * 100_000
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, long, 2), (3, long, 2), (None, "x" * 192, 3)], "doc_id long, text string, media int")
    rows = media.read_media(media.with_media(docs)).collect()
    for row in rows:
        raw = {1: b"", 2: b"", 3: long.encode(), None: b"x" * 192}[row.doc_id]
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (row.n_bytes, row.payload_bytes) == (len(raw), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-16:])
    assert len({r.media_sha256 for r in rows if r.doc_id == 3}) == 1
    blocks = media.pcm_blocks(media.with_media(docs.where("doc_id = 3").limit(1))).orderBy("block_no").collect()
    assert b"".join(b.pcm for b in blocks).rstrip() == long.encode().rstrip()
    assert media.read_media(media.with_media(docs.limit(0))).collect() == []


def test_a_seek_point_that_leads_elsewhere_is_noticed():
    (stream,) = flac.encode([media.padded(b"some text " * 5000)])
    kinds = {k: at for k, at, _ in flac._metadata(stream)}
    points = flac.seek_points(stream)
    assert len(points) > 2 and len(media.stream_blocks([stream])[0]) == len(points)
    at = kinds[3] + 18 + 8  # the second point's offset
    moved = stream[:at] + (int.from_bytes(stream[at : at + 8], "big") + 1).to_bytes(8, "big") + stream[at + 8 :]
    with pytest.raises(ValueError, match="seek point"):
        media.stream_blocks([moved])


def test_query_against_payloads(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in media.op2_media(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    equal = {}
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        x = [b - 128 for b in payload]
        signs = [v < 0 for v in x]
        assert g.feature == f"{len(x)}:{sum(x)}:{sum(v * v for v in x)}:{max(map(abs, x))}:{sum(a != b for a, b in zip(signs, signs[1:]))}"
        assert equal.setdefault(r.text or "", (g.media_bytes, g.media_sha256)) == (g.media_bytes, g.media_sha256)
