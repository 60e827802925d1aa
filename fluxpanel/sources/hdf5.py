"""What NetCDF-4 files need of the HDF5 format: groups of datasets, attributes, and
values that are contiguous or chunked, deflated and shuffled.

Only the structure is read when a file is opened; the values of a range of the first
dimension come from the chunks that meet it, which a chunk index finds by their
offsets.  Both generations of the format's groups and headers are read (symbol tables
and links, compact or in a fractal heap).  Layouts of the newest generation other than
a single chunk, filters other than deflate, shuffle and checksums, and types other
than integers, floats and strings are an error where they are met."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: its signature, the kinds of header messages and of filters.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
_SPACE, _LINKS, _TYPE, _FILL, _LINK, _LAYOUT, _FILTERS, _ATTRIBUTE, _MORE, _TABLE, _ATTRIBUTES = 0x01, 0x02, 0x03, 0x05, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11, 0x15
_DEFLATE, _SHUFFLE, _CHECKSUM = 1, 2, 3
_NOWHERE = (1 << 64) - 1


class Bytes:
    """A stretch of a file and a place in it."""

    def __init__(self, raw: bytes, at: int = 0, wide: int = 8):
        self.raw, self.at, self.wide = raw, at, wide

    def take(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the HDF5 file ends early")
        self.at += n
        return out

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def address(self) -> int:
        found = self.number(self.wide)
        return _NOWHERE if found == (1 << 8 * self.wide) - 1 else found

    def aligned(self, start: int, to: int = 8) -> None:
        self.at += -(self.at - start) % to


@dataclass
class Type:
    kind: str  # "number", "string", "text" (of any length), "list" (of any length) or "other"
    size: int
    dtype: np.dtype | None = None
    of: Type | None = None


def _type(b: Bytes) -> Type:
    first, bits = b.number(1), b.number(3)
    size, start = b.number(4), b.at
    which = first & 15
    order = ">" if bits & 1 else "<"
    if which == 0:
        b.take(4)
        return Type("number", size, np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"))
    if which == 1:
        b.take(12)
        return Type("number", size, np.dtype(f"{order}f{size}"))
    if which == 3:
        return Type("string", size)
    if which == 9:
        of = _type(b)
        return Type("text" if bits & 15 == 1 else "list", size, of=of)
    if which == 7:
        return Type("number", size, np.dtype(f"<u{size}"))
    b.at = start
    return Type("other", size)


def _space(b: Bytes) -> tuple[int, ...]:
    version, rank, flags = b.number(1), b.number(1), b.number(1)
    b.take(5 if version == 1 else 1)
    return tuple(b.number(b.wide) for _ in range(rank))


@dataclass
class Dataset:
    name: str
    address: int
    shape: tuple[int, ...] = ()
    type: Type | None = None
    attributes: dict = field(default_factory=dict)
    chunk: tuple[int, ...] | None = None
    place: int = _NOWHERE
    raw: bytes | None = None
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    fill: bytes | None = None
    single: int = 0
    links: list[tuple[str, int]] = field(default_factory=list)


class File:
    """The root group's datasets by name, with `read` for their values.  `read_bytes`
    counts what was read."""

    def __init__(self, path: str):
        self.path, self.read_bytes = path, 0
        self._open = None
        b = Bytes(self._at(0, 96))
        if b.take(8) != SIGNATURE:
            raise ValueError(f"{path} is not an HDF5 file")
        version = b.number(1)
        if version in (0, 1):
            b.take(4)
            self.wide = b.number(1)
            b.take(10 + (4 if version == 1 else 0))
            b.wide = self.wide
            for _ in range(5):
                b.address()
            root = b.address()
        elif version in (2, 3):
            self.wide = b.number(1)
            b.take(2)
            b.wide = self.wide
            for _ in range(3):
                b.address()
            root = b.address()
        else:
            raise ValueError(f"{path}: HDF5 superblock of an unknown version")
        self.datasets, self._heaps = {}, {}
        top = self._object("", root)
        self.attributes = top.attributes
        for name, address in top.links:
            found = self._object(name, address)
            if found.type is not None:
                self.datasets[name] = found

    def _at(self, address: int, n: int) -> bytes:
        if self._open is None:
            self._open = open(self.path, "rb")  # noqa: SIM115
        self._open.seek(address)
        out = self._open.read(n)
        self.read_bytes += len(out)
        return out

    def _bytes(self, address: int, n: int) -> Bytes:
        return Bytes(self._at(address, n), 0, self.wide)

    def close(self) -> None:
        if self._open is not None:
            self._open.close()
            self._open = None

    # Object headers.

    def _messages(self, address: int) -> Iterator[tuple[int, Bytes]]:
        b = self._bytes(address, 64)
        if b.raw[:4] == b"OHDR":
            b.take(5)
            flags = b.number(1)
            b.take((16 if flags & 32 else 0) + (4 if flags & 16 else 0))
            size, head = b.number(1 << (flags & 3)), 4 + (2 if flags & 4 else 0)
            blocks = [(address + b.at, size)]
            for at, n in blocks:
                part = self._bytes(at, n)
                while n - part.at >= head:
                    kind, length = part.number(1), part.number(2)
                    shared = part.number(1) & 2
                    part.take(head - 4)
                    body = Bytes(part.take(length), 0, self.wide)
                    if kind == _MORE:
                        # "OCHK" before the messages and a checksum after them.
                        blocks.append((body.address() + 4, body.number(self.wide) - 8))
                    elif kind and not shared:
                        yield kind, body
            return
        if b.number(1) != 1:
            raise ValueError("an HDF5 object header of an unknown version")
        b.take(1)
        count = b.number(2)
        b.take(4)
        blocks = [(address + 16, b.number(4))]
        for at, n in blocks:
            part = self._bytes(at, n)
            while count and n - part.at >= 8:
                kind, length, shared = part.number(2), part.number(2), part.number(1) & 2
                part.take(3)
                body = Bytes(part.take(length), 0, self.wide)
                count -= 1
                if kind == _MORE:
                    blocks.append((body.address(), body.number(self.wide)))
                elif kind and not shared:
                    yield kind, body

    def _object(self, name: str, address: int) -> Dataset:
        out = Dataset(name, address)
        for kind, b in self._messages(address):
            if kind == _SPACE:
                out.shape = _space(b)
            elif kind == _TYPE:
                out.type = _type(b)
            elif kind == _ATTRIBUTE:
                self._attribute(b, out.attributes)
            elif kind == _ATTRIBUTES:
                b.take(1)
                b.take(2 if b.number(1) & 1 else 0)
                for body in self._heaped(b.address(), b.address()):
                    self._attribute(body, out.attributes)
            elif kind == _LINK:
                self._link(b, out.links)
            elif kind == _LINKS:
                b.take(1)
                b.take(8 if b.number(1) & 1 else 0)
                for body in self._heaped(b.address(), b.address()):
                    self._link(body, out.links)
            elif kind == _TABLE:
                out.links += self._table(b.address(), b.address())
            elif kind == _LAYOUT:
                self._layout(b, out)
            elif kind == _FILTERS:
                out.filters = self._filters(b)
            elif kind == _FILL:
                out.fill = self._fill(b)
        return out

    def _link(self, b: Bytes, links: list) -> None:
        b.take(1)
        flags = b.number(1)
        kind = b.number(1) if flags & 8 else 0
        b.take((8 if flags & 4 else 0) + (1 if flags & 16 else 0))
        name = b.take(b.number(1 << (flags & 3))).decode()
        if kind == 0:
            links.append((name, b.address()))

    def _table(self, tree: int, heap: int) -> list[tuple[str, int]]:
        """Members of a group of the older generation."""
        b = self._bytes(heap, 8 + 3 * self.wide)
        b.take(8)
        size = b.number(self.wide)
        b.take(self.wide)
        names, out = self._at(b.address(), size), []
        nodes = [tree]
        for at in nodes:
            b = self._bytes(at, 8 + 2 * self.wide)
            level, used = b.raw[5], int.from_bytes(b.raw[6:8], "little")
            inner = self._bytes(at + 8 + 2 * self.wide, (2 * used + 1) * self.wide)
            for _ in range(used):
                inner.take(self.wide)
                child = inner.address()
                if level:
                    nodes.append(child)
                    continue
                held = self._bytes(child, 8)
                n = int.from_bytes(held.raw[6:8], "little")
                entries = self._bytes(child + 8, n * (2 * self.wide + 24))
                for _ in range(n):
                    place, header = entries.number(self.wide), entries.address()
                    entries.take(24)
                    out.append((names[place : names.index(b"\0", place)].decode(), header))
        return out

    # Fractal heaps, which hold many links or attributes, through their index.

    def _heaped(self, heap: int, index: int) -> Iterator[Bytes]:
        if heap == _NOWHERE or index == _NOWHERE:
            return
        b = self._bytes(heap, 26 + 12 * self.wide + 32)
        if b.take(4) != b"FRHP":
            raise ValueError("not a fractal heap")
        b.take(1)
        id_size, filtered = b.number(2), b.number(2)
        b.take(1)
        most = b.number(4)
        b.take(10 * self.wide)
        width, start, largest = b.number(2), b.number(self.wide), b.number(self.wide)
        bits = b.number(2)
        b.take(2)
        root, rows = b.address(), b.number(2)
        if filtered:
            raise ValueError("a filtered fractal heap is not read")
        offset_size = -(-bits // 8)
        length_size = min(-(-(largest.bit_length() - 1) // 8), (most.bit_length() - 1) // 8 + 1)
        blocks = sorted(self._blocks(root, rows, width, start, largest, offset_size, 0))
        for record in self._records(index, id_size):
            r = Bytes(record, 1, self.wide)
            kind = record[0] >> 4 & 3
            if kind == 2:  # an object that is its own identifier
                yield Bytes(record[1 : 2 + (record[0] & 15)], 0, self.wide)
                continue
            if kind != 0:
                raise ValueError("a huge object of a fractal heap is not read")
            offset, length = r.number(offset_size), r.number(length_size)
            first, place = next((first, place) for first, place in reversed(blocks) if first <= offset)
            yield self._bytes(place + offset - first, length)

    def _blocks(self, address: int, rows: int, width: int, start: int, largest: int, offset_size: int, first: int) -> Iterator[tuple[int, int]]:
        """(offset in the heap, address) of the direct blocks."""
        if address == _NOWHERE:
            return
        if not rows:
            yield first, address
            return
        direct = (largest // start).bit_length() + 1
        b = self._bytes(address, 5 + self.wide + offset_size + rows * width * self.wide)
        if b.take(4) != b"FHIB":
            raise ValueError("not an indirect block")
        b.take(1 + self.wide + offset_size)
        for row in range(rows):
            size = start << max(row - 1, 0)
            for _ in range(width):
                child = b.address()
                if row < direct:
                    if child != _NOWHERE:
                        yield first, child
                else:
                    inner = (size // (start * width)).bit_length()
                    yield from self._blocks(child, inner, width, start, largest, offset_size, first)
                first += size

    def _records(self, index: int, id_size: int) -> Iterator[bytes]:
        """Heap identifiers of a second-generation tree of names."""
        b = self._bytes(index, 16 + 2 * self.wide + 6)
        if b.take(4) != b"BTHD":
            raise ValueError("not an index of a fractal heap")
        b.take(1)
        kind, node_size, size, depth = b.number(1), b.number(4), b.number(2), b.number(2)
        b.take(2)
        # Records of links begin with a hash, those of attributes with the identifier.
        skip = 4 if kind == 5 else 0
        leaf = (node_size - 10) // size
        counted = (leaf.bit_length() - 1) // 8 + 1
        if depth > 1:
            raise ValueError("an index of more than two levels is not read")
        nodes = [(b.address(), b.number(2), depth)]
        for at, n, level in nodes:
            part = self._bytes(at + 6, n * size + (n + 1) * (self.wide + counted) * bool(level)) if n else Bytes(b"")
            for _ in range(n):
                yield part.take(size)[skip : skip + id_size]
            if level and n:
                nodes += [(part.address(), part.number(counted), 0) for _ in range(n + 1)]

    # Attributes.

    def _attribute(self, b: Bytes, attributes: dict) -> None:
        version, flags = b.number(1), b.number(1)
        sizes = [b.number(2) for _ in range(3)]
        b.take(1 if version == 3 else 0)
        parts = []
        for n in sizes:
            start = b.at
            parts.append(b.take(n))
            if version == 1:
                b.aligned(start)
        name = parts[0].rstrip(b"\0").decode()
        if flags & 3:
            return  # of a type that stands elsewhere
        kind, shape = _type(Bytes(parts[1], 0, self.wide)), _space(Bytes(parts[2], 0, self.wide))
        count = int(np.prod(shape, dtype=np.int64))
        if kind.kind == "string":
            texts = [b.take(kind.size).rstrip(b"\0").decode(errors="replace") for _ in range(count)]
            attributes[name] = texts[0] if count == 1 else texts
        elif kind.kind == "number":
            attributes[name] = np.frombuffer(b.take(count * kind.size), kind.dtype).tolist()
        elif kind.kind in ("text", "list"):
            found = []
            for _ in range(count):
                length, place, item = b.number(4), b.address(), b.number(4)
                raw = self._global(place, item) if length and place not in (0, _NOWHERE) else b""
                found.append(raw[:length].decode(errors="replace") if kind.kind == "text" else np.frombuffer(raw[: length * kind.of.size], kind.of.dtype).tolist() if kind.of.dtype else None)
            attributes[name] = found[0] if kind.kind == "text" and count == 1 else found

    def _global(self, address: int, item: int) -> bytes:
        if address not in self._heaps:
            size = int.from_bytes(self._at(address, 8 + self.wide)[8:], "little")
            b, held = self._bytes(address, size), {}
            b.take(8 + self.wide)
            while len(b.raw) - b.at >= 8 + self.wide:
                index = b.number(2)
                b.take(6)
                n = b.number(self.wide)
                if not index:
                    break
                held[index] = b.take(n)
                b.at += -n % 8
            self._heaps[address] = held
        return self._heaps[address][item]

    # Values.

    def _layout(self, b: Bytes, out: Dataset) -> None:
        version, kind = b.number(1), b.number(1)
        if version not in (3, 4):
            raise ValueError(f"{out.name}: a data layout of version {version} is not read")
        if kind == 0:
            out.raw = b.take(b.number(2))
        elif kind == 1:
            out.place = b.address()
        elif version == 3:
            rank = b.number(1)
            out.place = b.address()
            out.chunk = tuple(b.number(4) for _ in range(rank))[:-1]
        else:
            flags, rank, wide = b.number(1), b.number(1), b.number(1)
            out.chunk = tuple(b.number(wide) for _ in range(rank))[:-1]
            if b.number(1) != 1:
                raise ValueError(f"{out.name}: its chunk index is of the newest generation; write the file for an earlier one")
            out.single = b.number(self.wide) if flags & 2 else -1
            b.take(4 if flags & 2 else 0)
            out.place = b.address()

    def _filters(self, b: Bytes) -> list[tuple[int, list[int]]]:
        version, count, out = b.number(1), b.number(1), []
        b.take(6 if version == 1 else 0)
        for _ in range(count):
            which = b.number(2)
            length = b.number(2) if version == 1 or which >= 256 else 0
            b.take(2)
            n = b.number(2)
            b.take(length + (-length % 8 if version == 1 else 0))
            out.append((which, [b.number(4) for _ in range(n)]))
            b.take(4 if version == 1 and n % 2 else 0)
        return out

    def _fill(self, b: Bytes) -> bytes | None:
        version = b.number(1)
        if version == 3:
            return b.take(b.number(4)) if b.number(1) & 32 else None
        b.take(2)
        return b.take(b.number(4)) if b.number(1) else None

    def _chunks(self, d: Dataset, lo: int, hi: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(offsets, address, bytes, mask of left-out filters) of the chunks that meet rows lo to hi."""
        rank = len(d.shape)
        if d.single:
            size = int(np.prod(d.chunk)) * d.type.size if d.single < 0 else d.single
            yield (0,) * rank, d.place, size, 0
            return
        nodes = [d.place] if d.place != _NOWHERE else []
        key = 8 + 8 * (rank + 1)
        for at in nodes:
            head = self._at(at, 8 + 2 * self.wide)
            if head[:4] != b"TREE":
                raise ValueError(f"{d.name}: not an index of chunks")
            level, used = head[5], int.from_bytes(head[6:8], "little")
            b = self._bytes(at + 8 + 2 * self.wide, used * (key + self.wide) + key)
            keys, children = [], []
            for k in range(used + 1):
                size, mask = b.number(4), b.number(4)
                keys.append((size, mask, tuple(b.number(8) for _ in range(rank + 1))[:-1]))
                if k < used:
                    children.append(b.address())
            for k in range(used):
                size, mask, offsets = keys[k]
                if level:
                    # The next key bounds what is below in the first dimension.
                    if offsets[0] < hi and keys[k + 1][2][0] + d.chunk[0] > lo:
                        nodes.append(children[k])
                elif offsets[0] < hi and offsets[0] + d.chunk[0] > lo:
                    yield offsets, children[k], size, mask

    def _unpacked(self, d: Dataset, raw: bytes, mask: int) -> bytes:
        for k in range(len(d.filters) - 1, -1, -1):
            which, values = d.filters[k]
            if mask >> k & 1:
                continue
            if which == _DEFLATE:
                raw = zlib.decompress(raw)
            elif which == _SHUFFLE:
                size = values[0] if values else d.type.size
                whole = len(raw) // size * size
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(size, -1).T.tobytes() + raw[whole:]
            elif which == _CHECKSUM:
                raw = raw[:-4]
            else:
                raise ValueError(f"{d.name}: filter {which} is not read")
        return raw

    def read(self, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Values of the rows lo to hi of the first dimension."""
        d = self.datasets[name]
        if d.type.kind != "number":
            raise ValueError(f"{name} is not numeric")
        shape = d.shape
        hi = shape[0] if hi is None and shape else hi
        wanted = (hi - lo, *shape[1:]) if shape else ()
        inner = int(np.prod(shape[1:], dtype=np.int64)) * d.type.size
        if d.raw is not None:
            return np.frombuffer(d.raw[lo * inner : hi * inner] if shape else d.raw, d.type.dtype).reshape(wanted)
        if d.chunk is None and d.place != _NOWHERE:
            raw = self._at(d.place + lo * inner, (hi - lo) * inner) if shape else self._at(d.place, d.type.size)
            return np.frombuffer(raw, d.type.dtype).reshape(wanted)
        blank = np.frombuffer(d.fill, d.type.dtype)[0] if d.fill else 0
        out = np.full(wanted, blank, d.type.dtype)
        if d.chunk is None:
            return out
        for offsets, place, size, mask in self._chunks(d, lo, hi):
            block = np.frombuffer(self._unpacked(d, self._at(place, size), mask), d.type.dtype).reshape(d.chunk)
            begin = (max(offsets[0], lo), *offsets[1:])
            end = (min(offsets[0] + d.chunk[0], hi), *[min(o + c, n) for o, c, n in zip(offsets[1:], d.chunk[1:], shape[1:], strict=True)])
            into = tuple(slice(a - (lo if k == 0 else 0), b - (lo if k == 0 else 0)) for k, (a, b) in enumerate(zip(begin, end, strict=True)))
            out[into] = block[tuple(slice(a - o, b - o) for a, b, o in zip(begin, end, offsets, strict=True))]
        return out
