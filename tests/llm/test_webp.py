import base64
import hashlib
import zlib

import numpy as np
import pytest

from loomwright.llm import media as M
from loomwright.llm import webp as W

RNG = np.random.default_rng(1)
NOISE = RNG.integers(0, 1 << 32, (13, 17), dtype=np.uint64).astype(np.uint32)
IMAGES = {
    "noise": NOISE,
    "five colours": NOISE.ravel()[RNG.integers(0, 5, NOISE.size)].reshape(NOISE.shape),
    "two colours": NOISE.ravel()[RNG.integers(0, 2, NOISE.size)].reshape(NOISE.shape),
    "ramp": np.add.outer(np.arange(40), np.arange(33)).astype(np.uint32) * np.uint32(0x010203) | np.uint32(0xFF000000),
    "row": NOISE[:1],
    "column": NOISE[:, :1],
    "one": np.array([[5]], dtype=np.uint32),
    "plain": np.full((3, 3), 7, dtype=np.uint32),
}


def ways(image):
    tiles = lambda b: (-(-image.shape[0] >> b), -(-image.shape[1] >> b))
    colours = lambda b: RNG.integers(0, 1 << 32, tiles(b), dtype=np.uint64).astype(np.uint32)
    yield {}
    yield {"cache_bits": 3}
    yield {"references": True}
    yield {"cache_bits": 11, "references": True}
    yield {"transforms": [(W.SUBTRACT_GREEN,)]}
    yield {"transforms": [(W.PREDICTOR, 2, RNG.integers(0, 14, tiles(2)))]}
    yield from ({"transforms": [(W.PREDICTOR, 4, np.full(tiles(4), m))]} for m in range(14))
    yield {"transforms": [(W.CROSS_COLOUR, 3, colours(3))]}
    yield {"transforms": [(W.PREDICTOR, 3, np.full(tiles(3), 2)), (W.CROSS_COLOUR, 2, colours(2)), (W.SUBTRACT_GREEN,)], "references": True, "cache_bits": 5}
    if len(np.unique(image)) <= 256:
        yield {"transforms": [(W.PALETTE,)]}
        yield {"transforms": [(W.PALETTE,)], "references": True}


@pytest.mark.parametrize("name", IMAGES)
def test_round_trips(name):
    for way in ways(IMAGES[name]):
        assert (W.decode(W.encode(IMAGES[name], **way)) == IMAGES[name]).all(), way


def test_several_code_groups():
    """A hand-made image: two tiles of 4 columns, each with its own code group of single symbols."""
    out = W.Out()
    for value, n in ((0x2F, 8), (7, 14), (3, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        out.put(value, n)
    W._write_pixels(out, np.array([[0xFF000000, 0xFF000100]], dtype=np.uint32), False)
    for green in (10, 20):
        for s in (green, 1, 2, 255):
            lengths = np.zeros(280, dtype=np.uint8)
            lengths[s] = 1
            W.write_code(out, lengths)
        W.write_code(out, np.zeros(40, dtype=np.uint8))
    body = out.bytes() + b"\0"
    body += bytes(len(body) & 1)
    image = W.decode(b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body)
    assert (image[:, :4] == 0xFF010A02).all() and (image[:, 4:] == 0xFF011402).all()


def assembled(*fields):
    """A file of bit fields (value, width) put together by hand, without the module's writer."""
    number, at = 0, 0
    for value, width in fields:
        number |= value << at
        at += width
    body = number.to_bytes(-(-at // 8) + 8, "little")
    body += bytes(len(body) & 1)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def head(width, height):
    return [(0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)]


def one(symbol):
    """A simple code of one symbol of eight bits."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def two(a, b):
    return [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


PLAIN = [(0, 1), (0, 1)]  # neither cache nor code groups


@pytest.mark.parametrize(("mode", "corner"), [(0, 5), (1, 19), (2, 19), (3, 19), (4, 10), (5, 19), (6, 14), (7, 19), (8, 14), (9, 19), (10, 16), (11, 19), (12, 28), (13, 23)])
def test_predictors_of_a_hand_made_file(mode, corner):
    """Residues 5, 9 / 9, 5: the corner is predicted from 14 on its left, above and to the upper right, and 5 to the upper left."""
    fields = [*head(2, 2), (1, 1), (0, 2), (0, 3), (0, 1), *one(mode), *one(0), *one(0), *one(0), *one(0), (0, 1), *PLAIN, *two(5, 9), *one(0), *one(0), *one(0), *one(0), (0, 1), (1, 1), (1, 1), (0, 1)]
    assert W.decode(assembled(*fields)).tolist() == [[0xFF000500, 0xFF000E00], [0xFF000E00, 0xFF000000 | corner << 8]]


def test_palette_of_a_hand_made_file():
    """Two colours, the second given by its difference; eight pixels in one green value."""
    fields = [*head(9, 1), (1, 1), (3, 2), (1, 8), (0, 1), *two(0x20, 0x30), *two(0x01, 0x10), *one(0x05), *two(0x00, 0xFF), *one(0)]
    fields += [(0, 1), (0, 1), (1, 1), (1, 1), (1, 1), (0, 1)]  # first colour: green 20, red 01, alpha FF; difference: green 30, red 10, alpha 00
    fields += [(0, 1), *PLAIN, *two(0b01, 0b10110010), *one(0), *one(0), *one(255), *one(0), (1, 1), (0, 1)]
    a, b = 0xFF012005, 0xFF11500A
    assert W.decode(assembled(*fields)).tolist() == [[a, b, a, a, b, b, a, b, b]]


def test_cross_colour_and_green_of_a_hand_made_file():
    """Red-to-blue 32, green-to-blue 224 (-32), green-to-red 16, on residues green 64, red 10, blue 20: red + 32, then blue - 64 + 42."""
    fields = [*head(1, 1), (1, 1), (1, 2), (0, 3), (0, 1), *one(224), *one(32), *one(16), *one(255), *one(0), (0, 1), *PLAIN, *one(64), *one(10), *one(20), *one(255), *one(0)]
    assert W.decode(assembled(*fields)).tolist() == [[0xFF000000 | 42 << 16 | 64 << 8 | (20 - 64 + 42) & 255]]
    fields = [*head(1, 1), (1, 1), (2, 2), (0, 1), *PLAIN, *one(64), *one(250), *one(20), *one(255), *one(0)]
    assert W.decode(assembled(*fields)).tolist() == [[0xFF000000 | 58 << 16 | 64 << 8 | 84]]


def normal(lengths):
    """A code given by the lengths of its symbols' codes, {symbol: 1 or 2}: its own code has 0 (length 1), 1 and 2 (length 2), read in the fixed order of lengths."""
    size = max(lengths) + 1
    fields = [(0, 1), (3, 4), (0, 3), (0, 3), (1, 3), (2, 3), (2, 3), (0, 3), (0, 3), (1, 1)]  # 17, 18, 0, 1, 2, 3, 4
    extra = 4  # the number of tokens less 2, in 10 bits
    fields += [(extra, 3), (size - 2, 10)]
    return fields + [{0: (0, 1), 1: (0b01, 2), 2: (0b11, 2)}[lengths.get(k, 0)] for k in range(size)]


def test_cache_and_references_of_a_hand_made_file():
    """Two literals, a reference of length 3 at the second nearest place to the left, and the first colour from the cache."""
    slot = (0x1E35A7BD * 0xFF000500 & 0xFFFFFFFF) >> 31
    # Green: 5, 9, the reference's prefix 2 (length 3), the cache's slot, two bits each.
    fields = [*head(6, 1), (0, 1), (1, 1), (1, 4), (0, 1), *normal({5: 2, 9: 2, 258: 2, 280 + slot: 2}), *one(0), *one(0), *one(255), *one(4)]
    fields += [(0b00, 2), (0b10, 2), (0b01, 2), (1, 1), (0b11, 2)]  # distance prefix 4, extra bit 1: code 6, two to the left
    a, b = 0xFF000500, 0xFF000900
    # The last pixel before it is a, so its slot holds a, be b's slot another or the same.
    assert W.decode(assembled(*fields)).tolist() == [[a, b, a, b, a, a]]


def test_a_file_of_another_encoder():
    """The picture of one pixel that browsers are asked to show in order to find out whether they can."""
    image = W.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert image.shape == (1, 1)


def test_ways_are_chosen_by_size():
    rng = np.random.default_rng(8)
    words = " ".join(f"w{rng.integers(0, 60)}" for _ in range(4000)).encode()
    ramp = np.add.outer(np.arange(200) * 3, np.arange(64) * 5).astype(np.uint8).tobytes()
    kinds = {"words": words, "noise": rng.bytes(6400), "bits": bytes(rng.integers(0, 2, 6400, dtype=np.uint8)), "ramp": ramp, "zeros": bytes(640)}
    for name, data in kinds.items():
        data += bytes(-len(data) % 64)
        way = M.plan(np.frombuffer(data, dtype=np.uint8).reshape(-1, 64))
        transforms = [t[0] for t in way["transforms"]]
        assert {"words": bool(way.get("references")), "noise": "references" not in way, "bits": W.PALETTE in transforms, "ramp": W.PREDICTOR in transforms, "zeros": True}[name], name
        media = M.store(data)
        assert M.pixels(media).tobytes() == data and (name == "noise" or len(media) < 0.6 * len(data))


def test_a_payload_beyond_a_mebibyte_is_one_file(spark):
    rng = np.random.default_rng(9)
    data = rng.integers(97, 123, 64 * 16384 + 64 * 3, dtype=np.uint8).tobytes()
    media = M.store(data)
    assert 8 + int.from_bytes(media[4:8], "little") == len(media) and W.decode(media).shape == (8194, 128)
    assert M.pixels(media).tobytes() == data


def test_repeats_are_repeats():
    rng = np.random.default_rng(4)
    for n in (0, 5, 9, 64, 3000):
        v = rng.integers(0, 3, n, dtype=np.uint8)
        starts, lengths, back = W.repeats(v)
        end = 0
        for s, length, d in zip(starts.tolist(), lengths.tolist(), back.tolist()):
            assert s >= end and d > 0 and all(v[s + k] == v[s + k - d] for k in range(length))
            end = s + length
        assert end <= n


def test_damage_is_noticed():
    data = W.encode(NOISE)
    for bad in (data[:30], b"RIFX" + data[4:], data[:20] + b"\0" + data[21:]):
        with pytest.raises((W.DamagedImage, ValueError, IndexError)):
            W.decode(bad)


def test_documents(documents, clashing):
    rows = [(1, None), (2, ""), (3, "abc"), (4, "x" * 64), (5, "é" * 700_000), (6, "abc"), (6, "abc"), (None, "z\0")]
    got = M.digests(clashing(documents(*rows))).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, text in rows:
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64) or bytes(64)
        r = by_id[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(padded), zlib.crc32(padded[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
    assert [v for k, v in by_id[3].asDict().items() if k != "doc_id"] == [v for k, v in by_id[6].asDict().items() if k != "doc_id"]
    assert by_id[5]["media_bytes"] < by_id[5]["payload_bytes"]
    assert M.digests(documents((1, "a")).limit(0)).count() == 0


def test_stored_and_read_back(documents):
    stored = M.store_texts(documents((1, "hello"), (2, None)))
    read = {r["doc_id"]: r for r in M.read_media(stored).collect()}
    assert bytes(read[1]["pixels"]) == b"hello" + bytes(59) and read[2]["n_rows"] == 1
