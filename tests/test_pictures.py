"""PNG files, decoded by all filters, depths, colour types and passes, against the pixels they were made from."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralens.operators import pixels
from terralens.sources import pictures as P


def paeth(a, b, c):
    return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]


def filtered(lines, step, kinds):
    """Rows of bytes with their filters applied, as the format says it, byte by byte."""
    out, above = b"", bytes(len(lines[0]))
    for y, line in enumerate(lines):
        kind = kinds[y % len(kinds)]
        row = bytearray([kind])
        for k, v in enumerate(line):
            a, b, c = line[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            row.append((v - (0, a, b, (a + b) // 2, paeth(a, b, c))[kind]) % 256)
        out, above = out + bytes(row), line
    return out


def png(samples, depth, colour, kinds, interlaced=False, palette=None, pieces=3):
    """samples: height x width x samples a pixel."""
    h, w, n = samples.shape
    data = b""
    for x0, y0, dx, dy in P.PASSES if interlaced else [(0, 0, 1, 1)]:
        part = samples[y0::dy, x0::dx]
        if part.size:
            lines = []
            for row in part.reshape(part.shape[0], -1):
                bits = "".join(format(int(v), f"0{depth}b") for v in row)
                bits += "0" * (-len(bits) % 8)
                lines.append(bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)))
            data += filtered(lines, max(1, n * depth // 8), kinds)
    packed = zlib.compress(data)
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    cut = [packed[k * len(packed) // pieces : (k + 1) * len(packed) // pieces] for k in range(pieces)]
    return (P.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"tEXt", b"a\0b") + b"".join(chunk(b"IDAT", c) for c in cut)
            + chunk(b"IEND", b""))


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "depth"), [(c, d) for c, ds in P.DEPTHS.items() for d in ds])
def test_all_kinds(colour, depth, interlaced):
    rng = np.random.RandomState(colour * 20 + depth)
    for h, w in ((1, 1), (3, 2), (9, 13)):
        s = rng.randint(0, 1 << depth, (h, w, P.SAMPLES[colour]))
        palette = rng.randint(0, 256, (1 << depth, 3)).astype(np.uint8) if colour == 3 else None
        got = P.decode(png(s, depth, colour, [4, 3, 2, 1, 0], interlaced, palette.tobytes() if colour == 3 else None))
        byte = s >> 8 if depth == 16 else s * 255 // ((1 << depth) - 1)
        want = palette[s[..., 0]] if colour == 3 else np.repeat(byte[..., :1], 3, 2) if colour in (0, 4) else byte[..., :3]
        assert (got == want).all() and got.shape == (h, w, 3)


def test_damaged_files(spark):
    whole = P.encode(np.arange(90, dtype=np.uint8).reshape(5, 6, 3))
    bad = [b"", b"no picture", whole[:-5], whole[:40], whole[:60] + b"x" + whole[61:], P.SIGNATURE, png(np.full((2, 2, 1), 3), 2, 3, [0], palette=b"abc")]
    for x in bad:
        with pytest.raises(P.Damaged):
            P.decode(x)
    df = spark.createDataFrame([(str(k), x) for k, x in enumerate([*bad, whole, None])], "key string, content binary")
    assert [(r.key, r.width, r.height) for r in P.decoded(df).collect()] == [(str(len(bad)), 6, 5)]


def test_files(spark, tmp_path):
    rng = np.random.RandomState(1)
    made = {f"p{k}": rng.randint(0, 256, (20 + k, 30, 3)).astype(np.uint8) for k in range(4)}
    for k, p in made.items():
        (tmp_path / f"{k}.png").write_bytes(P.encode(p))
    (tmp_path / "x.txt").write_bytes(b"text")
    got = P.read_pictures(spark, str(tmp_path))
    for r in got.collect():
        assert (np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) == made[r.key]).all()
    means = {r.key: (r.r, r.g, r.b) for r in pixels.channel_means(got).collect()}
    assert set(means) == set(made) and all(np.allclose(means[k], p.reshape(-1, 3).mean(0)) for k, p in made.items())
    four = got.select(F.lit("all").alias("key"), F.substring("key", 2, 1).cast("int").alias("place"), "width", "height", "rgb")
    grid = P.decoded(P.encoded(pixels.grids(four, 16))).first()
    assert (np.frombuffer(grid.rgb, np.uint8).reshape(32, 32, 3) == pixels.grid([made[f"p{k}"] for k in range(4)], 16)).all()


def test_resampling_keeps_flat_and_mean():
    flat = np.full((37, 53, 3), 200, np.uint8)
    assert (pixels._resized(flat, 16, 9) == 200).all() and (pixels._resized(flat, 80, 90, "lanczos") == 200).all()
    ramp = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 3, 2).repeat(256, 0)
    small = pixels._resized(ramp, 32, 32, "lanczos")
    assert abs(float(small.mean()) - float(ramp.mean())) < 1 and (np.diff(small[0, :, 0].astype(int)) > 0).all()
