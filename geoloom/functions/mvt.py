"""Vector tiles: the protobuf wire format, written and read."""

from __future__ import annotations

import struct

from geoloom.functions.wkb import Geometry

#: Field numbers and kinds of the vector tile specification, version 2.
VERSION, POINT, LINE, POLYGON = 2, 1, 2, 3
_MOVE, _LINE, _CLOSE = 1, 2, 7
_BYTES = [bytes((v,)) for v in range(128)]


def _varint(v: int) -> bytes:
    if v < 128:
        return _BYTES[v]
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def _zigzag(v: int) -> int:
    return v * 2 if v >= 0 else -v * 2 - 1


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, v: int) -> bytes:
    return _varint(number << 3) + _varint(v)


def _value(v) -> bytes:
    if isinstance(v, bool):
        return _number(7, int(v))
    if isinstance(v, int):
        return _number(6, _zigzag(v) & (1 << 64) - 1) if v < 0 else _number(4, v)
    if isinstance(v, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


def commands(g: Geometry) -> tuple[int, list[int]]:
    """(kind, command integers) of a geometry in whole tile coordinates."""
    kind, c = g
    out: list[int] = []
    x = y = 0

    def move(points, command):
        nonlocal x, y
        out.append(len(points) << 3 | command)
        for px, py in points:
            out.extend((_zigzag(px - x), _zigzag(py - y)))
            x, y = px, py

    if kind in ("Point", "MultiPoint"):
        move([c] if kind == "Point" else c, _MOVE)
        return POINT, out
    if kind in ("LineString", "MultiLineString"):
        for line in [c] if kind == "LineString" else c:
            move(line[:1], _MOVE)
            move(line[1:], _LINE)
        return LINE, out
    for poly in [c] if kind == "Polygon" else c:
        for ring in poly:
            move(ring[:1], _MOVE)
            move(ring[1:-1], _LINE)
            out.append(1 << 3 | _CLOSE)
    return POLYGON, out


class LayerBuilder:
    """Features of one layer, with its dictionary of keys and values."""

    def __init__(self, name: str, extent: int = 4096):
        self.name, self.extent = name, extent
        self.keys: dict[str, int] = {}
        self.values: dict[tuple, int] = {}
        self.features: list[bytes] = []

    def add(self, g: Geometry | None, properties: dict, fid: int | None = None) -> bool:
        """Nulls are left out of the properties, and negative ids; a missing geometry adds nothing."""
        if g is None:
            return False
        kind, cmds = commands(g)
        self.add_packed(kind, b"".join(map(_varint, cmds)), properties, fid)
        return True

    def add_packed(self, kind: int, packed: bytes, properties: dict, fid: int | None = None) -> None:
        """A feature by its packed commands."""
        tags = []
        for k, v in properties.items():
            if v is None:
                continue
            tags.append(self.keys.setdefault(k, len(self.keys)))
            tags.append(self.values.setdefault((type(v), v), len(self.values)))
        out = _number(1, fid) if fid is not None and fid >= 0 else b""
        if tags:
            out += _field(2, b"".join(map(_varint, tags)))
        self.features.append(out + _number(3, kind) + _field(4, packed))

    def add_points(self, xs: list[int], ys: list[int], columns: dict, fids: list) -> None:
        """Points with columns (Arrow arrays) of properties; as ``add`` of each, a dictionary entry at a time."""
        tags: list[list[bytes]] = []
        for name, column in columns.items():
            coded = column.dictionary_encode()
            coded = coded.combine_chunks() if hasattr(coded, "combine_chunks") else coded
            if coded.null_count == len(coded):
                continue
            key = _varint(self.keys.setdefault(name, len(self.keys)))
            entries = [key + _varint(self.values.setdefault((type(v), v), len(self.values))) for v in coded.dictionary.to_pylist()]
            tags.append([b"" if i is None else entries[i] for i in coded.indices.to_pylist()])
        joined = [b"".join(t) for t in zip(*tags, strict=True)] if tags else [b""] * len(xs)
        for x, y, t, fid in zip(xs, ys, joined, fids, strict=True):
            out = _number(1, fid) if fid is not None and fid >= 0 else b""
            if t:
                out += _field(2, t)
            place = b"\x09" + _varint(_zigzag(x)) + _varint(_zigzag(y))
            self.features.append(out + b"\x18\x01\x22" + bytes((len(place),)) + place)

    def encoded(self) -> bytes:
        out = _number(15, VERSION) + _field(1, self.name.encode())
        out += b"".join(_field(2, f) for f in self.features)
        out += b"".join(_field(3, k.encode()) for k in self.keys)
        out += b"".join(_field(4, _value(v)) for _, v in self.values)
        return out + _number(5, self.extent)


def tile(layers: list[LayerBuilder]) -> bytes:
    """A tile of the layers that have features, in order of their names."""
    return b"".join(_field(3, l.encoded()) for l in sorted(layers, key=lambda l: l.name) if l.features)


def merged(layers: list[bytes]) -> bytes:
    """One layer of encoded ones of a name: features in order as they are, but for their tags."""
    name, extent, keys, values, out = b"", 4096, {}, {}, []
    for blob in layers:
        own_keys, own_values, features = [], [], []
        for n, v in _fields(blob):
            if n == 2:
                features.append(v)
            elif n == 3:
                own_keys.append(v)
            elif n == 4:
                own_values.append(v)
            elif n == 1:
                name = v
            elif n == 5:
                extent = v
        if not own_keys:
            out += features
            continue
        read = [(type(v), v) for v in map(_read_value, own_values)]
        # A part's entries are named when a feature first uses them.
        to_key: list = [None] * len(own_keys)
        to_value: list = [None] * len(read)
        for f in features:
            # The id, if any, then the tags.
            at = 0
            if f[0] == 8:
                at = 1
                while f[at] > 127:
                    at += 1
                at += 1
            if f[at] != 18:
                out.append(f)
                continue
            size, shift, body = 0, 0, at + 1
            while True:
                b = f[body]
                body += 1
                size |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            tags = _packed(f[body : body + size])
            named = []
            for k, v in zip(tags[::2], tags[1::2], strict=True):
                if to_key[k] is None:
                    to_key[k] = _varint(keys.setdefault(own_keys[k], len(keys)))
                if to_value[v] is None:
                    to_value[v] = _varint(values.setdefault(read[v], len(values)))
                named += (to_key[k], to_value[v])
            out.append(f[:at] + _field(2, b"".join(named)) + f[body + size :])
    parts = [_number(15, VERSION), _field(1, name)]
    for f in out:
        parts += (b"\x12", _varint(len(f)), f)
    parts += [_field(3, k) for k in keys]
    parts += [_field(4, _value(v)) for _, v in values]
    return b"".join(parts) + _number(5, extent)


# -- reading ------------------------------------------------------------------------------


def _fields(data: bytes):
    at = 0

    def varint():
        nonlocal at
        v = shift = 0
        while True:
            b = data[at]
            at += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        elif key & 7 == 5:
            yield key >> 3, data[at : at + 4]
            at += 4
        else:
            raise ValueError("wire kind")


def _packed(data: bytes) -> list[int]:
    out, v, shift = [], 0, 0
    for b in data:
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(v)
            v = shift = 0
    return out


def _unzigzag(v: int) -> int:
    return v >> 1 ^ -(v & 1)


def _read_value(data: bytes):
    (n, v), *_ = _fields(data)
    if n == 1:
        return v.decode()
    if n == 2:
        return struct.unpack("<f", v)[0]
    if n == 3:
        return struct.unpack("<d", v)[0]
    if n == 4:
        return v - (1 << 64) if v >> 63 else v
    return _unzigzag(v) if n == 6 else bool(v) if n == 7 else v


def _read_geometry(kind: int, cmds: list[int]) -> Geometry:
    parts: list[list] = []
    x = y = at = 0
    while at < len(cmds):
        command, n = cmds[at] & 7, cmds[at] >> 3
        at += 1
        if command == _CLOSE:
            parts[-1].append(parts[-1][0])
            continue
        for _ in range(n):
            x, y = x + _unzigzag(cmds[at]), y + _unzigzag(cmds[at + 1])
            at += 2
            if command == _MOVE and (kind != POINT or not parts):
                parts.append([(x, y)])
            else:
                parts[-1].append((x, y))
    if kind == POINT:
        return "MultiPoint", parts[0]
    if kind == LINE:
        return "MultiLineString", parts
    polys: list = []
    from geoloom.functions.geometry import area

    for r in parts:
        if area(r) > 0 or not polys:
            polys.append([r])
        else:
            polys[-1].append(r)
    return "MultiPolygon", polys


def read(data: bytes) -> dict[str, dict]:
    """Layers by name: version, extent and features (id, properties, geometry)."""
    out = {}
    for n, blob in _fields(data):
        if n != 3:
            continue
        name, extent, version, keys, values, raw = "", 4096, 1, [], [], []
        for k, v in _fields(blob):
            if k == 1:
                name = v.decode()
            elif k == 2:
                raw.append(v)
            elif k == 3:
                keys.append(v.decode())
            elif k == 4:
                values.append(_read_value(v))
            elif k == 5:
                extent = v
            elif k == 15:
                version = v
        features = []
        for f in raw:
            fid, tags, kind, cmds = None, [], 0, []
            for k, v in _fields(f):
                if k == 1:
                    fid = v
                elif k == 2:
                    tags = _packed(v)
                elif k == 3:
                    kind = v
                elif k == 4:
                    cmds = _packed(v)
            features.append({"id": fid, "properties": {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}, "geometry": _read_geometry(kind, cmds)})
        out[name] = {"version": version, "extent": extent, "features": features}
    return out
