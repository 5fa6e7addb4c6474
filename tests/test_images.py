"""Template images: decoding against an encoder that uses every filter, and a round trip through files."""

import struct
import zlib

import numpy as np
import pytest

from tallyplan.sources import images as I


def filtered(image, kinds):
    """A PNG file whose rows use the given filters in turn."""
    h, w, step = image.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[step]
    flat = image.reshape(h, -1).astype(int)
    lines = b""
    for r in range(h):
        kind = kinds[r % len(kinds)]
        row = []
        for i in range(w * step):
            left = flat[r, i - step] if i >= step else 0
            up = flat[r - 1, i] if r else 0
            corner = flat[r - 1, i - step] if r and i >= step else 0
            p = left + up - corner
            paeth = min((abs(p - v), k, v) for k, v in enumerate((left, up, corner)))[2]
            row.append((flat[r, i] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        lines += bytes([kind, *row])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = zlib.compress(lines)
    return I.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"x") + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("step", [1, 2, 3, 4])
@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
def test_filters(step, kinds):
    rng = np.random.default_rng(step)
    image = rng.integers(0, 256, (9, 11, step)).astype(np.uint8)
    got = I.decode(filtered(image, kinds))
    if step < 3:
        assert all((got[:, :, k] == image[:, :, 0]).all() for k in range(3)) and (got[:, :, 3] == (image[:, :, 1] if step == 2 else 255)).all()
    else:
        assert (got[:, :, :3] == image[:, :, :3]).all() and (got[:, :, 3] == (image[:, :, 3] if step == 4 else 255)).all()


def test_colours():
    image = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 0, 255], [10, 10, 10], [200, 100, 100]]], np.uint8)
    hue, saturation, value = I.colours(image)
    assert hue[0].tolist() == [0, 60, 120, 150, 0, 0] and saturation[0].tolist() == [255, 255, 255, 255, 0, 128] and value[0].tolist() == [255, 255, 255, 255, 10, 200]


def test_folder_of_templates(spark, tmp_path):
    mask = np.zeros((12, 15), dtype=bool)
    mask[3:9, 4:11] = True
    red = np.full((10, 10, 3), 255, np.uint8)
    red[2:8, 2:8] = (200, 20, 20)
    (tmp_path / "07_frame.png").write_bytes(I.encode(mask))
    (tmp_path / "08_red.png").write_bytes(I.encode(red))
    (tmp_path / "09_dot.png").write_bytes(I.encode(np.eye(4, dtype=bool)))
    (tmp_path / "10_cut.png").write_bytes(I.encode(red)[:60])
    (tmp_path / "11_text.png").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("x")
    got = {r.name: r for r in I.read_images(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["07_frame", "08_red", "09_dot", "10_cut", "11_text"]
    assert (got["07_frame"].pixels, got["07_frame"].gray, got["07_frame"].hue, got["07_frame"].prefix) == (42, True, None, 7)
    assert (got["08_red"].pixels, got["08_red"].gray, got["08_red"].hue) == (36, False, 0)
    assert got["10_cut"].pixels is None and got["10_cut"].problem and got["11_text"].problem == "no PNG file" and got["11_text"].mask is None
    usable = I.usable(I.read_images(spark, str(tmp_path)))
    assert sorted(r.name for r in usable.collect()) == ["07_frame", "08_red"]
    png = {r.name: bytes(r.png) for r in usable.withColumn("png", I.as_png(usable["mask"], usable["width"], usable["height"])).collect()}
    assert (I.masks(I.decode(png["07_frame"]))[0] == mask).all()
