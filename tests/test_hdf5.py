import struct
import zlib

import numpy as np
import pytest

from emberline.sources import hdf5


def message(kind, body):
    return bytes([kind]) + struct.pack("<HB", len(body), 0) + body


def header(messages):
    body = b"".join(messages)
    return b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(body)) + body + b"\0" * 4


def datatype(kind):
    d = np.dtype(kind)
    bits = bytes([0x11 if d.kind == "f" else 0x10, 8 if d.kind == "i" else 0, 0, 0]) + struct.pack("<I", d.itemsize)
    return bits + (struct.pack("<HHBBBBI", 0, 8 * d.itemsize, 0, 0, 0, 0, 0) if d.kind == "f" else struct.pack("<HH", 0, 8 * d.itemsize))


def attribute(name, value, kind="<f8"):
    n, t, s = name.encode() + b"\0", datatype(kind), b"\2\0\0\0"
    return message(12, bytes([3, 0]) + struct.pack("<HHHB", len(n), len(t), len(s), 0) + n + t + s + np.array(value, kind).tobytes())


def link(name, at):
    return message(6, bytes([1, 0, len(name)]) + name.encode() + struct.pack("<Q", at))


def build(variables, chunk=(5, 7), shuffle=True, track=None):
    """variables: name -> (array, attributes)."""
    out = bytearray(hdf5.SIGNATURE + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", 0, hdf5.NOWHERE, 0, 0) + b"\0" * 4)
    links = []
    for name, (a, attributes) in variables.items():
        keys = []
        for r in range(0, a.shape[0], chunk[0]):
            for c in range(0, a.shape[1], chunk[1]):
                part = np.zeros(chunk, a.dtype)
                piece = a[r : r + chunk[0], c : c + chunk[1]]
                part[: piece.shape[0], : piece.shape[1]] = piece
                raw = part.tobytes()
                if shuffle:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
                z = zlib.compress(raw)
                keys.append(struct.pack("<IIQQQQ", len(z), 0, r, c, 0, len(out)))
                out += z
        tree = len(out)
        out += b"TREE" + bytes([1, 0]) + struct.pack("<HQQ", len(keys), hdf5.NOWHERE, hdf5.NOWHERE) + b"".join(keys) + b"\0" * 32
        filters = bytes([2, 1 + shuffle]) + (struct.pack("<HHHI", 2, 0, 1, a.dtype.itemsize) if shuffle else b"") + struct.pack("<HHHI", 1, 0, 1, 4)
        layout = bytes([3, 2, 3]) + struct.pack("<QIII", tree, *chunk, a.dtype.itemsize)
        space = bytes([2, 2, 0, 1]) + struct.pack("<QQ", *a.shape)
        first = [message(1, space), message(3, datatype(a.dtype)), message(8, layout)]
        rest = b"".join([message(11, filters), *[attribute(k, v) for k, v in attributes.items()]])
        more = len(out)
        out += b"OCHK" + rest + b"\0" * 4
        links.append(link(name, len(out)))
        out += header([*first, message(16, struct.pack("<QQ", more, len(rest) + 8))])
    root = len(out)
    out += header(links + ([attribute("track_offset", track, "<i4")] if track is not None else []))
    out[36:44] = struct.pack("<Q", root)
    return bytes(out)


@pytest.mark.parametrize("shuffle", [True, False])
@pytest.mark.parametrize("kind", ["<i2", "<u1", "<f4", "<f8", "<i4"])
def test_variables_are_read(kind, shuffle):
    a = (np.arange(13 * 17).reshape(13, 17) % 100).astype(kind)
    f = hdf5.File(build({"lat": (a, {"scale_factor": 0.5, "add_offset": 3.0, "_FillValue": 7.0}), "b": (a + 1, {})}, shuffle=shuffle, track=998))
    want = (a * 0.5 + 3).astype(np.float32)
    want[a == 7] = np.nan
    assert np.array_equal(f.values("lat"), want, equal_nan=True)
    assert np.array_equal(f.raw(f.variable("b"), (3, 11, 6, 16)), (a + 1)[3:11, 6:16])
    assert f.global_attributes()["track_offset"] == 998


def test_refusals():
    a = np.zeros((4, 4), "<i2")
    data = build({"v": (a, {})})
    with pytest.raises(hdf5.Unsupported, match="not found"):
        hdf5.File(data).variable("w")
    with pytest.raises(hdf5.Unsupported, match="no hdf5"):
        hdf5.File(b"x" * 100)
    at = data.index(b"TREE")
    with pytest.raises(hdf5.Unsupported, match="deeper"):
        f = hdf5.File(data[: at + 5] + b"\1" + data[at + 6 :])
        f.raw(f.variable("v"))
    with pytest.raises(hdf5.Unsupported, match="inflate"):
        f = hdf5.File(data[:52] + b"\0\0\0" + data[55:])
        f.raw(f.variable("v"))


def heap(objects, at, order):
    """A fractal heap of one direct block and its index by name, at an address; order: record of an object's id."""
    none, start = hdf5.NOWHERE, at + 142 + 4
    block = b"FHDB\0" + struct.pack("<QI", at, 0)
    ids = []
    for o in objects:
        ids.append(b"\0" + struct.pack("<IH", len(block), len(o)))
        block += o + b"\0" * 3  # a gap, as a deleted object leaves it
    head = b"FRHP\0" + struct.pack("<HHBI", 7, 0, 0, 4096) + struct.pack("<12Q", none, none, 0, none, 4096, 4096, 0, len(objects), 0, 0, 0, 0)
    head += struct.pack("<HQQHHQH", 4, 4096, 65536, 32, 0, start, 0) + b"\0" * 4
    tree = start + len(block)
    records = [order(i) for i in ids]
    size = len(records[0])
    index = b"BTHD\0" + bytes([5]) + struct.pack("<IHHBBQHQ", 512, size, 0, 98, 40, tree + 38, len(records), len(records)) + b"\0" * 4
    index += b"BTLF\0" + bytes([5]) + b"".join(records) + b"\0" * 4
    return head + block + index, tree


def test_links_and_attributes_of_a_heap():
    a = np.arange(20, dtype="<i2").reshape(4, 5)
    data = bytearray(build({"v": (a, {"scale_factor": 2.0})}))
    old = hdf5.File(bytes(data)).names()["v"]
    body = lambda m: m[4:]
    links, link_tree = heap([body(link(n, old)) for n in ("v", "other", "x" * 40)], len(data), lambda i: b"hash" + i)
    at = len(data)
    data += links
    kept, kept_tree = heap([body(attribute("track_offset", 998, "<i4")), body(attribute("b", 0.5))], len(data), lambda i: i + b"\0" * 10)
    kept_at = len(data)
    data += kept
    data[36:44] = struct.pack("<Q", len(data))
    data += header([message(2, bytes([0, 0]) + struct.pack("<QQ", at, link_tree)), message(21, bytes([0, 1, 0, 0]) + struct.pack("<QQ", kept_at, kept_tree))])
    f = hdf5.File(bytes(data))
    assert f.names() == {"v": old, "other": old, "x" * 40: old} and f.global_attributes() == {"track_offset": 998, "b": 0.5}
    assert (f.values("v") == 2.0 * a).all()
    deep = bytearray(data)
    deep[link_tree + 12 : link_tree + 14] = b"\1\0"
    with pytest.raises(hdf5.Unsupported, match="deeper"):
        hdf5.File(bytes(deep)).names()
