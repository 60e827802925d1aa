"""Small NetCDF-4 files, laid out by hand in both generations of the HDF5 format."""

import struct
import zlib

import numpy as np

NOWHERE = b"\xff" * 8


class Builder:
    def __init__(self, new: bool):
        self.new, self.out = new, bytearray(96)

    def put(self, raw: bytes) -> int:
        self.out += bytes(-len(self.out) % 8)
        at = len(self.out)
        self.out += raw
        return at

    # Messages.

    def space(self, shape) -> bytes:
        dims = b"".join(struct.pack("<Q", n) for n in shape)
        return (struct.pack("<BBBB", 2, len(shape), 0, 1 if shape else 0) if self.new else struct.pack("<BBB5x", 1, len(shape), 0)) + dims

    @staticmethod
    def type(dtype) -> bytes:
        dtype = np.dtype(dtype)
        big = dtype.byteorder == ">"
        if dtype.kind in "iu":
            return struct.pack("<BBBBI", 0x10, big | (8 if dtype.kind == "i" else 0), 0, 0, dtype.itemsize) + struct.pack("<HH", 0, 8 * dtype.itemsize)
        body = (0, 32, 23, 8, 0, 23, 127) if dtype.itemsize == 4 else (0, 64, 52, 11, 0, 52, 1023)
        return struct.pack("<BBBBI", 0x11, 0x20 | big, body[1] - 1, 0, dtype.itemsize) + struct.pack("<HHBBBBI", *body)

    def attribute(self, name: str, value) -> bytes:
        if isinstance(value, bytes):  # addresses of the dimensions, in the global heap
            refs = [struct.pack("<IQI", 1, *struct.unpack("<QI", value[k : k + 12])) for k in range(0, len(value), 12)]
            kind = struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + struct.pack("<BBBBI", 0x17, 0, 0, 0, 8)
            shape, data = (len(refs),), b"".join(refs)
        elif isinstance(value, str):
            data = value.encode() + b"\0"
            kind, shape = struct.pack("<BBBBI", 0x13, 0, 0, 0, len(data)), ()
        else:
            value = np.atleast_1d(value)
            kind, shape, data = self.type(value.dtype), value.shape, value.tobytes()
        label, space = name.encode() + b"\0", self.space(shape)
        if self.new:
            return struct.pack("<BBHHHB", 3, 0, len(label), len(kind), len(space), 0) + label + kind + space + data
        pad = lambda b: b + bytes(-len(b) % 8)
        return struct.pack("<BBHHH", 1, 0, len(label), len(kind), len(space)) + pad(label) + pad(kind) + pad(space) + data

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        if self.new:
            # The second half stands in a continuation block.
            half = max(1, len(messages) // 2)
            pack = lambda part: b"".join(struct.pack("<BHB", k, len(b), 0) + b for k, b in part)
            rest = pack(messages[half:])
            more = self.put(b"OCHK" + rest + bytes(4))
            own = pack([*messages[:half], (0x10, struct.pack("<QQ", more, len(rest) + 8))])
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(own)) + own + bytes(4))
        pad = lambda b: b + bytes(-len(b) % 8)
        half = max(1, len(messages) // 2)
        pack = lambda part: b"".join(struct.pack("<HHB3x", k, len(pad(b)), 0) + pad(b) for k, b in part)
        rest = pack(messages[half:])
        more = self.put(rest)
        own = pack([*messages[:half], (0x10, struct.pack("<QQ", more, len(rest)))])
        return self.put(struct.pack("<BxHII4x", 1, len(messages) + 1, 1, len(own)) + own)

    def heap(self, objects: list[bytes], record_type: int) -> bytes:
        """A fractal heap of direct blocks below an indirect one, and its index of two levels; their addresses."""
        start, width, id_size = 512, 2, 7 if record_type == 5 else 8
        blocks, ids, sizes = [], [], [start, start, start, start, 1024, 1024, 2048, 2048]
        first, body = 0, b""

        def close():
            nonlocal first, body
            raw = b"FHDB" + struct.pack("<BQI", 0, 0, first) + body
            blocks.append(self.put(raw + bytes(sizes[len(blocks)] - len(raw))))
            first, body = first + sizes[len(blocks) - 1], b""

        for o in objects:
            while 17 + len(body) + len(o) > sizes[len(blocks)]:
                close()
            ids.append(struct.pack("<BIH", 0, first + 17 + len(body), len(o)))
            body += o
        close()
        rows = -(-len(blocks) // width)
        children = b"".join(struct.pack("<Q", b) for b in blocks) + NOWHERE * (rows * width - len(blocks))
        root = self.put(b"FHIB" + struct.pack("<BQI", 0, 0, 0) + children + bytes(4))
        head = b"FRHP" + struct.pack("<BHHBI", 0, id_size, 0, 0, 4096) + bytes(80) + struct.pack("<HQQHHQH", width, start, 65536, 32, 1, root, rows) + bytes(4)
        address = self.put(head)
        records = [bytes(4) + i if record_type == 5 else i + bytes(1) + bytes(9) for i in ids]
        size = len(records[0])
        leaf = lambda part: self.put(b"BTLF" + struct.pack("<BB", 0, record_type) + b"".join(part) + bytes(4))
        cut = len(records) // 2
        left, right = leaf(records[:cut]), leaf(records[cut + 1 :])
        top = self.put(b"BTIN" + struct.pack("<BB", 0, record_type) + records[cut] + struct.pack("<QB", left, cut) + struct.pack("<QB", right, len(records) - cut - 1) + bytes(4))
        tree = self.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, record_type, 512, size, 1, 100, 40, top, 1, len(records)) + bytes(4))
        return struct.pack("<QQ", address, tree)

    def dataset(self, values: np.ndarray, attributes: dict, chunk=None, filters=(), fill=None, leave_out=()) -> int:
        messages = [(1, self.space(values.shape)), (3, self.type(values.dtype))]
        if fill is not None:
            raw = np.array(fill, values.dtype).tobytes()
            messages.append((5, struct.pack("<BBI", 3, 0x20, len(raw)) + raw if self.new else struct.pack("<BBBBI", 2, 2, 0, 1, len(raw)) + raw))
        if filters:
            entry = {"shuffle": (2, [values.itemsize]), "deflate": (1, [4]), "fletcher32": (3, [])}
            body = b""
            for f in filters:
                which, given = entry[f]
                body += struct.pack("<HHH", which, 1, len(given)) if self.new else struct.pack("<HHHH", which, 8, 1, len(given)) + f.encode()[:7].ljust(8, b"\0")
                body += b"".join(struct.pack("<I", v) for v in given) + (b"" if self.new or len(given) % 2 == 0 else bytes(4))
            messages.append((0x0B, (struct.pack("<BB", 2, len(filters)) if self.new else struct.pack("<BB6x", 1, len(filters))) + body))
        messages.append((8, self.chunked(values, chunk, filters, leave_out) if chunk else struct.pack("<BBQQ", 3, 1, self.put(values.tobytes()), values.nbytes)))
        listed = [self.attribute(k, v) for k, v in attributes.items()]
        if self.new and len(listed) > 4:
            messages.append((0x15, struct.pack("<BB", 0, 0) + self.heap(listed, 8)))
        else:
            messages += [(0x0C, a) for a in listed]
        return self.header(messages)

    def chunked(self, values, chunk, filters, leave_out) -> bytes:
        entries = []
        for place in np.ndindex(*[-(-n // c) for n, c in zip(values.shape, chunk, strict=True)]):
            at = tuple(p * c for p, c in zip(place, chunk, strict=True))
            if place in leave_out:
                continue
            part = values[tuple(slice(a, a + c) for a, c in zip(at, chunk, strict=True))]
            block = np.zeros(chunk, values.dtype)
            block[tuple(slice(0, n) for n in part.shape)] = part
            raw, mask = block.tobytes(), 0
            for k, f in enumerate(filters):
                if f == "deflate" and place == (0,) * len(chunk):
                    mask |= 1 << k  # a chunk that is not worth it is stored as it is
                elif f == "shuffle":
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, values.itemsize).T.tobytes()
                elif f == "deflate":
                    raw = zlib.compress(raw)
                else:
                    raw += bytes(4)
            entries.append((at, len(raw), mask, self.put(raw)))
        key = lambda at, size, mask: struct.pack("<II", size, mask) + b"".join(struct.pack("<Q", a) for a in (*at, 0))
        past = tuple(-(-n // c) * c for n, c in zip(values.shape, chunk, strict=True))

        def node(level, items, end) -> int:
            body = b"".join(key(at, size, mask) + struct.pack("<Q", child) for at, size, mask, child in items)
            return self.put(b"TREE" + struct.pack("<BBH", 1, level, len(items)) + NOWHERE * 2 + body + key(end, 0, 0))

        leaves = [entries[k : k + 3] for k in range(0, len(entries), 3)]
        ends = [part[0][0] for part in leaves[1:]] + [past]
        tops = [(part[0][0], part[0][1], part[0][2], node(0, part, end)) for part, end in zip(leaves, ends, strict=True)]
        return struct.pack("<BBBQ", 3, 2, len(chunk) + 1, node(1, tops, past)) + b"".join(struct.pack("<I", c) for c in (*chunk, values.itemsize))

    def references(self, addresses: list[int]) -> bytes:
        objects = b"".join(struct.pack("<HH4xQQ", k + 1, 1, 8, a) for k, a in enumerate(addresses))
        heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(objects) + 16) + objects + bytes(16))
        return b"".join(struct.pack("<QI", heap, k + 1) for k in range(len(addresses)))

    def group(self, members: dict[str, int], attributes: dict) -> int:
        messages = [(0x0C, self.attribute(k, v)) for k, v in attributes.items()]
        if not self.new:
            names, places = b"\0" * 8, {}
            for n in sorted(members):
                places[n] = len(names)
                names += n.encode() + b"\0" * (8 - len(n.encode()) % 8)
            data = self.put(names)
            heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 0, data))
            entries = b"".join(struct.pack("<QQII16x", places[n], members[n], 0, 0) for n in sorted(members))
            leaf = self.put(b"SNOD" + struct.pack("<BxH", 1, len(members)) + entries)
            tree = self.put(b"TREE" + struct.pack("<BBH", 0, 0, 1) + NOWHERE * 2 + struct.pack("<QQQ", 0, leaf, 8))
            return self.header([(0x11, struct.pack("<QQ", tree, heap)), *messages])
        links = [struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", a) for n, a in members.items()]
        if len(links) > 4:
            return self.header([(2, struct.pack("<BB", 0, 0) + self.heap(links, 5)), *messages])
        return self.header([(2, struct.pack("<BB", 0, 0) + NOWHERE * 2), *[(6, x) for x in links], *messages])

    def finish(self, path, root: int) -> None:
        head = b"\x89HDF\r\n\x1a\n"
        end = struct.pack("<Q", len(self.out))
        if self.new:
            head += struct.pack("<BBBB", 2, 8, 8, 0) + bytes(8) + NOWHERE + end + struct.pack("<Q", root) + bytes(4)
        else:
            head += struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + bytes(8) + NOWHERE + end + NOWHERE + struct.pack("<QQIIQQ", 0, root, 1, 0, 0, 0)
        self.out[: len(head)] = head
        with open(path, "wb") as f:
            f.write(self.out)


def write(path, axes: dict, variables: dict, new: bool, attributes: dict | None = None, more: int = 0, **how) -> None:
    """`axes` (name: values, attributes) and `variables` (name: values, attributes) over all
    of them; `more` attributes besides on every variable; `how` for the variables' storage."""
    b = Builder(new)
    places = {}
    for n, (values, own) in axes.items():
        places[n] = b.dataset(values, own | {"CLASS": "DIMENSION_SCALE", "NAME": n})
    listed = b.references(list(places.values()))
    for n, (values, own) in variables.items():
        extra = {f"note{k}": "n" * 40 for k in range(more)}
        places[n] = b.dataset(values, own | extra | {"DIMENSION_LIST": listed}, **how)
    b.finish(path, b.group(places, attributes or {}))
