import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.llm import media as M


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=M.UNIT, max_size=M.UNIT), st.integers(1, 3))
def test_samples_come_back(data, n):
    frames = M.flat_frames(np.frombuffer(data * n, np.uint8))
    assert len(frames) == n and b"".join(f[0].tobytes() for f in M.decode(frames)) == data * n
    assert np.array_equal(M.decode(frames, scale=1)[0][0][::8, ::8].ravel(), np.frombuffer(data, np.uint8))
    assert M.demux(M.avi(frames, 192, 192)) == (frames, 40.0)


def encode(blocks, quant, factors, width, height, restart=0):
    """A plain baseline encoder: quantised blocks in scan order (component, 64 in zigzag order) with the standard tables."""

    def codes(table):
        out, code, at = {}, 0, 0
        for n, count in enumerate(table[0], 1):
            for s in table[1][at : at + count]:
                out[s] = format(code, f"0{n}b")
                code += 1
            at, code = at + count, code << 1
        return out

    dc, ac = [codes(M.DC_LUMA), codes(M.DC_CHROMA)], [codes(M.AC_LUMA), codes(M.AC_CHROMA)]
    seg = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    number = lambda v: (abs(v).bit_length(), format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else "")
    per = sum(h * v for h, v in factors)
    out, bits, before = b"", "", [0] * len(factors)

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""
        return data

    for i, (c, block) in enumerate(blocks):
        if restart and i and i % (per * restart) == 0:
            out += flush() + b"\xff" + bytes([0xD0 + (i // (per * restart) - 1) % 8])
            before = [0] * len(factors)
        t = min(c, 1)
        n, b = number(int(block[0]) - before[c])
        before[c] = int(block[0])
        bits += dc[t][n] + b
        run = 0
        for v in map(int, block[1:]):
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits += ac[t][0xF0]
                run -= 16
            n, b = number(v)
            bits += ac[t][run << 4 | n] + b
            run = 0
        if run:
            bits += ac[t][0]
    parts = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    scan = b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(len(factors)))
    head = b"\xff\xd8" + seg(0xE0, b"AVI1\0\0\0\0") + seg(0xDB, b"\0" + bytes(quant.tolist())) + seg(0xC0, struct.pack(">BHHB", 8, height, width, len(factors)) + parts)
    head += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + seg(0xDA, bytes([len(factors)]) + scan + bytes([0, 63, 0])) + out + flush() + b"\xff\xd9"


@pytest.mark.parametrize("factors, restart", [([(1, 1)], 0), ([(1, 1)], 2), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 3)])
def test_colour_frames_with_the_standard_tables(factors, restart):
    rng = np.random.default_rng(3)
    width, height = 45, 37
    h, v = factors[0]
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    quant = rng.integers(1, 30, 64)
    c = M._cosines()
    frames, want = [], []
    for _ in range(3):
        planes = [np.zeros((down * fv * 8, across * fh * 8)) for fh, fv in factors]
        blocks = []
        for y in range(down):
            for x in range(across):
                for k, (fh, fv) in enumerate(factors):
                    for b in range(fv):
                        for a in range(fh):
                            block = np.where(rng.random(64) < 0.15, rng.integers(-12, 13, 64), 0)
                            block[0] = rng.integers(-30, 31)
                            blocks.append((k, block))
                            square = np.zeros(64)
                            square[M.ZIGZAG] = block * quant
                            planes[k][(y * fv + b) * 8 : (y * fv + b + 1) * 8, (x * fh + a) * 8 : (x * fh + a + 1) * 8] = c @ square.reshape(8, 8) @ c.T
        frames.append(encode(blocks, quant, factors, width, height, restart))
        want.append([np.clip(np.rint(p) + 128, 0, 255) for p in planes])
    for got, planes in zip(M.decode(frames, scale=1), want, strict=True):
        for k, (image, plane) in enumerate(zip(got, planes, strict=True)):
            rows, cols = (-(-height * factors[k][1] // v), -(-width * factors[k][0] // h))
            assert image.shape == (rows, cols) and np.abs(image - plane[:rows, :cols]).max() <= 1


def test_shots():
    d = np.full(60, 0.02)
    d[[20, 41]] = 0.9
    assert M.shots(d).tolist() == [0, 21, 42]
    assert M.shots(np.zeros(0)).tolist() == [0] and M.shots(np.full(9, 0.5)).tolist() == [0]


def test_clips_of_a_film(spark):
    dark, light = np.full(M.UNIT * 5, 20, np.uint8), np.full(M.UNIT * 8, 220, np.uint8)
    film = M.avi(M.flat_frames(np.concatenate((dark, light))), 192, 192)
    half = film[: len(film) // 2]
    df = spark.createDataFrame([(1, film, 0), (2, None, 0), (3, b"junk", 0), (4, half, 0), (5, M.avi([], 8, 8), 0)], "doc_id long, media binary, n int")
    seen = M.look(df, ("doc_id",))
    assert [(r.doc_id, r["first"], r.frames, r.start_ms, r.end_ms, r.level) for r in M.clips(seen, "doc_id").filter("doc_id = 1").orderBy("first").collect()] == [(1, 0, 5, 0.0, 200.0, 20.0), (1, 5, 8, 200.0, 520.0, 220.0)]
    error = {r.doc_id: r.error for r in seen.collect()}
    assert error[1] is None and error[5] is None and error[2] == "no media" and error[3] == "no RIFF AVI file"


def test_other_indexes():
    frames = M.flat_frames(np.arange(M.UNIT * 3, dtype=np.int64).astype(np.uint8))
    film = bytearray(M.avi(frames, 192, 192))
    at = film.index(b"idx1")
    film[at : at + 4] = b"JUNK"
    assert M.demux(bytes(film))[0] == frames
    film[at : at + 4] = b"idx1"
    base = film.index(b"movi")
    for i in range(3):
        p = at + 8 + 16 * i + 8
        struct.pack_into("<I", film, p, struct.unpack_from("<I", film, p)[0] + base)
    assert M.demux(bytes(film))[0] == frames


def test_table(odd, none):
    df, rows = odd
    got = M.look(M.store(df)).collect()
    want = []
    for i, t in rows:
        b = (t or "").encode()
        want.append((str(i), len(b), hashlib.sha256(b + b"\xff" * (max(M.UNIT, -(-len(b) // M.UNIT) * M.UNIT) - len(b))).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, hashlib.sha256(r.samples).hexdigest()) for r in got) == sorted(want)
    assert M.look(M.store(none)).count() == 0
