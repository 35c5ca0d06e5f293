"""Two-dimensional variables of netCDF-4 (HDF5) files, the part that the night sensor's granules use.

Written from the HDF5 file format specification, version 3.0. An object is read
into its header messages, each parsed by the function that MESSAGES names for its
type; links and attributes that stand in a fractal heap are found through the
version 2 b-tree that indexes them by name. Read are version 2 object headers,
heaps of one direct block, b-trees of one leaf, and chunked variables whose
chunks are shuffled or deflated. Anything else is refused by name.
"""

from __future__ import annotations

import struct
import zlib
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
#: Where the superblock has the root group's address, by its version (sections II.A of the specification).
ROOT_AT = {0: 64, 2: 36, 3: 36}
#: Message types (section IV.A.2).
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, PIPELINE, ATTRIBUTE, CONTINUATION, ATTRIBUTE_INFO = 1, 2, 3, 6, 8, 11, 12, 16, 21
DEFLATE, SHUFFLE = 1, 2

_Heap = namedtuple("_Heap", "signature version id_size filters flags most_managed counts width first_size most_direct bits rows_first root rows")


class Unsupported(ValueError):
    """What a file has that is not read here."""


class Cursor:
    """Little-endian fields, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n] if self.at >= 0 else b""
        if n < 0 or len(part) != n:
            raise Unsupported("the file ends within a field")
        self.at += n
        return part

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def sign(self, expected: bytes, what: str) -> Cursor:
        if self.take(len(expected)) != expected:
            raise Unsupported(f"no {what} where one should be")
        return self


@dataclass
class Variable:
    shape: tuple[int, int] = (0, 0)
    chunk: tuple[int, int] = (0, 0)
    kind: str = ""
    shuffled: bool = False
    index: int = NOWHERE
    attributes: dict[str, float] = field(default_factory=dict)

    @property
    def scale(self) -> float:
        return self.attributes.get("scale_factor", 1.0)

    @property
    def offset(self) -> float:
        return self.attributes.get("add_offset", 0.0)


def dataspace(c: Cursor) -> tuple[int, ...]:
    """The sizes of the dimensions."""
    version, rank, _ = c.uint(1), c.uint(1), c.uint(1)
    c.take({1: 5, 2: 1}.get(version, 0))
    if version not in (1, 2):
        raise Unsupported(f"dataspace of version {version}")
    return tuple(c.uint(8) for _ in range(rank))


def datatype(c: Cursor) -> str:
    """numpy's name of a fixed-point or floating-point number."""
    family, bits, size = c.uint(1) & 15, c.uint(3), c.uint(4)
    signs = {0: "i" if bits & 8 else "u", 1: "f"}
    name = f"<{signs.get(family, '?')}{size}"
    if name not in ("<i1", "<i2", "<i4", "<i8", "<u1", "<u2", "<u4", "<u8", "<f4", "<f8"):
        raise Unsupported(f"datatype of class {family} and {size} bytes")
    return name


def layout(c: Cursor) -> tuple[int, tuple[int, ...]]:
    """Address of the chunk index, and the sizes of a chunk, that of an element last."""
    version, storage = c.uint(1), c.uint(1)
    if (version, storage) != (3, 2):
        raise Unsupported(f"layout of version {version} and class {storage}: only chunks are read")
    rank = c.uint(1)
    return c.uint(8), tuple(c.uint(4) for _ in range(rank))


def pipeline(c: Cursor) -> list[int]:
    """The filters' numbers, in the order they were applied in."""
    version, count = c.uint(1), c.uint(1)
    c.take(6 if version == 1 else 0)
    found = []
    for _ in range(count):
        found.append(c.uint(2))
        letters = c.uint(2) if version == 1 or found[-1] > 255 else 0
        c.take(2)
        values = c.uint(2)
        c.take(letters + (-letters % 8 if version == 1 else 0))
        c.take(4 * (values + (values % 2 if version == 1 else 0)))
    return found


def attribute(c: Cursor) -> tuple[str, float | None]:
    """Name and value; no value unless it is a number."""
    version = c.uint(1)
    if version not in (1, 2, 3):
        raise Unsupported(f"attribute of version {version}")
    c.take(1)
    sizes = [c.uint(2) for _ in range(3)]
    c.take(1 if version == 3 else 0)
    name, kind, _ = (Cursor(c.take(n + (-n % 8 if version == 1 else 0))) for n in sizes)
    label = name.data[: sizes[0]].split(b"\0")[0].decode("utf-8", "replace")
    try:
        number = np.dtype(datatype(kind))
        return label, float(np.frombuffer(c.take(number.itemsize), number)[0])
    except Unsupported:
        return label, None


def link(c: Cursor) -> tuple[str, int]:
    """Name and address; no address unless the link is a hard one."""
    c.take(1)
    flags = c.uint(1)
    soft = c.uint(1) if flags & 8 else 0
    c.take((8 if flags & 4 else 0) + (1 if flags & 16 else 0))
    name = c.take(c.uint(1 << (flags & 3))).decode("utf-8", "replace")
    return name, NOWHERE if soft else c.uint(8)


def index_info(order_bytes: int) -> Callable[[Cursor], tuple[int, int]]:
    """Parser of link info and attribute info: addresses of the heap and of its index by name."""

    def parse(c: Cursor) -> tuple[int, int]:
        c.take(1)
        c.take(order_bytes if c.uint(1) & 1 else 0)
        return c.uint(8), c.uint(8)

    return parse


MESSAGES: dict[int, Callable] = {
    DATASPACE: dataspace, LINK_INFO: index_info(8), DATATYPE: datatype, LINK: link, LAYOUT: layout, PIPELINE: pipeline, ATTRIBUTE: attribute, ATTRIBUTE_INFO: index_info(2),
}


class File:
    def __init__(self, data: bytes):
        self.data = data
        if not data.startswith(SIGNATURE):
            raise Unsupported("no hdf5 file")
        version = Cursor(data, len(SIGNATURE)).uint(1)
        if version not in ROOT_AT:
            raise Unsupported(f"superblock of version {version}")
        self.root = Cursor(data, ROOT_AT[version]).uint(8)

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(type, body) of an object's header messages, in the blocks that continue it too."""
        c = Cursor(self.data, at).sign(b"OHDR", "object header of version 2")
        c.take(1)
        flags = c.uint(1)
        c.take((16 if flags & 32 else 0) + (4 if flags & 16 else 0))
        size = c.uint(1 << (flags & 3))
        todo, seen, order = [(c.at, size)], set(), 2 if flags & 4 else 0
        while todo:
            begin, size = todo.pop(0)
            if begin in seen:
                raise Unsupported("an object header that continues in itself")
            seen.add(begin)
            block = Cursor(Cursor(self.data, begin).take(size))
            while size - block.at >= 4 + order:  # less is a gap
                kind, length = block.uint(1), block.uint(2)
                block.take(1 + order)
                body = block.take(length)
                if kind == CONTINUATION:
                    where, n = struct.unpack("<QQ", body)
                    todo.append((Cursor(self.data, where).sign(b"OCHK", "header continuation").at, n - 8))
                else:
                    yield kind, body

    def parsed(self, at: int) -> dict[int, list]:
        """What an object's messages say, by their type."""
        out: dict[int, list] = {kind: [] for kind in MESSAGES}
        for kind, body in self.messages(at):
            if kind in MESSAGES:
                out[kind].append(MESSAGES[kind](Cursor(body)))
        return out

    def _indexed(self, heap_at: int, tree_at: int, id_from: int) -> Iterator[Cursor]:
        """The heap's objects that an index's records name; id_from is where a record has the object's id."""
        if NOWHERE in (heap_at, tree_at):
            return
        head = Cursor(self.data, heap_at)
        fields = struct.unpack("<4sBHHBI96sHQQHHQH", head.take(142))
        heap = _Heap(*fields)
        if heap.signature != b"FRHP":
            raise Unsupported("no heap where one should be")
        if heap.rows or heap.filters:
            raise Unsupported("a heap of more than one plain block")
        tree = Cursor(self.data, tree_at).sign(b"BTHD", "index by name")
        tree.take(6)
        record, depth = tree.uint(2), tree.uint(2)
        tree.take(2)
        leaf_at, count = tree.uint(8), tree.uint(2)
        if not count:
            return
        if depth:
            raise Unsupported("an index by name that is deeper than a leaf")
        leaf = Cursor(self.data, leaf_at).sign(b"BTLF", "leaf of an index")
        leaf.take(2)
        wide = -(-heap.bits // 8)
        for _ in range(count):
            name = Cursor(leaf.take(record), id_from)
            if name.uint(1) & 0x30:
                raise Unsupported("an object outside of the heap's block")
            begin = name.uint(wide)
            size = name.uint(heap.id_size - 1 - wide)
            yield Cursor(Cursor(self.data, heap.root + begin).take(size))

    def names(self) -> dict[str, int]:
        """Addresses of the root group's objects by name."""
        root = self.parsed(self.root)
        links = [*root[LINK], *(link(c) for at in root[LINK_INFO] for c in self._indexed(*at, 4))]
        return {name: at for name, at in links if at != NOWHERE}

    def attributes(self, parsed: dict[int, list]) -> dict[str, float]:
        """An object's attributes that are numbers."""
        every = [*parsed[ATTRIBUTE], *(attribute(c) for at in parsed[ATTRIBUTE_INFO] for c in self._indexed(*at, 0))]
        return {name: value for name, value in every if value is not None}

    def global_attributes(self) -> dict[str, float]:
        return self.attributes(self.parsed(self.root))

    def variable(self, name: str) -> Variable:
        at = self.names().get(name)
        if at is None:
            raise Unsupported(f"variable {name} not found")
        parsed = self.parsed(at)
        lone = [parsed[kind][-1:] for kind in (DATASPACE, DATATYPE, LAYOUT)]
        if not all(lone):
            raise Unsupported(f"{name} is no variable")
        (shape,), (kind,), ((index, chunk),) = lone
        if len(shape) != 2 or len(chunk) != 3 or 0 in (*shape, *chunk):
            raise Unsupported(f"{name} has other than two dimensions, or an empty one")
        filters = [f for applied in parsed[PIPELINE] for f in applied]
        if filters not in ([DEFLATE], [SHUFFLE, DEFLATE]):
            raise Unsupported(f"filters {filters} of {name}")
        return Variable(shape, chunk[:2], kind, SHUFFLE in filters, index, self.attributes(parsed))

    def chunks(self, v: Variable) -> Iterator[tuple[int, int, int, int]]:
        """(row, column, address, size) of a variable's chunks."""
        if v.index == NOWHERE:  # nothing was ever written
            return
        c = Cursor(self.data, v.index).sign(b"TREE\1", "index of chunks")
        if c.uint(1):
            raise Unsupported("an index of chunks that is deeper than a leaf")
        count = c.uint(2)
        c.take(16)
        for _ in range(count):
            size, skipped, row, column, _, at = struct.unpack("<IIQQQQ", c.take(40))
            if skipped:
                raise Unsupported("a chunk to which a filter was not applied")
            yield row, column, at, size

    def raw(self, v: Variable, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
        """Stored numbers of rows r0 to r1 and columns c0 to c1 (all by default); only chunks that meet them are inflated."""
        r0, r1, c0, c1 = window or (0, v.shape[0], 0, v.shape[1])
        out = np.zeros((r1 - r0, c1 - c0), v.kind)
        (h, w), size = v.chunk, np.dtype(v.kind).itemsize
        for r, c, at, n in self.chunks(v):
            a0, a1, b0, b1 = max(r, r0), min(r + h, r1), max(c, c0), min(c + w, c1)
            if a0 >= a1 or b0 >= b1:
                continue
            try:
                data = zlib.decompress(self.data[at : at + n])
            except zlib.error:
                raise Unsupported("a chunk that does not inflate") from None
            if len(data) != h * w * size:
                raise Unsupported("a chunk of another size")
            if v.shuffled:
                data = np.frombuffer(data, np.uint8).reshape(size, h * w).T.tobytes()
            out[a0 - r0 : a1 - r0, b0 - c0 : b1 - c0] = np.frombuffer(data, v.kind).reshape(h, w)[a0 - r : a1 - r, b0 - c : b1 - c]
        return out

    def values(self, name: str, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
        """Unpacked floats, nan where the fill value stands."""
        v = self.variable(name)
        raw = self.raw(v, window)
        out = (raw * v.scale + v.offset).astype(np.float32)
        fill = v.attributes.get("_FillValue")
        if fill is not None:
            out[raw == fill] = np.nan
        return out
