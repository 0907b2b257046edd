"""Columnar blobs for shuffles: many small numbers travel as one row.

Integers are delta-coded where they ascend and stored byte plane by byte plane
before a light zstd pass, so ids and positions cost about a byte each.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard

_TYPES = ("<u8", "<i8", "<u4", "<i4", "<u2", "<f4", "<f8")


def _z() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


def dump(cols: dict[str, np.ndarray]) -> bytes:
    """Columns of one length; hashes (key h) stay as they are."""
    n = len(next(iter(cols.values())))
    head, body, raw = [struct.pack("<IB", n, len(cols))], [], []
    for k, v in cols.items():
        code = _TYPES.index(v.dtype.newbyteorder("<").str)
        head.append(struct.pack("<cB", k.encode(), code))
        if k == "h":
            raw.append(np.ascontiguousarray(v).tobytes())
        else:
            d = v.copy()
            d[1:] -= v[:-1]
            body.append(np.ascontiguousarray(d).view(np.uint8).reshape(n, v.dtype.itemsize).T.tobytes())
    z = b"".join(body)
    if len(z) > 64:
        z = b"\1" + _z().compress(z)
    else:
        z = b"\0" + z
    return b"".join(head) + struct.pack("<I", len(z)) + z + b"".join(raw)


def load(b: bytes) -> dict[str, np.ndarray]:
    n, k = struct.unpack_from("<IB", b)
    names = [struct.unpack_from("<cB", b, 5 + 2 * i) for i in range(k)]
    at = 5 + 2 * k
    (size,) = struct.unpack_from("<I", b, at)
    at += 4
    z = b[at + 1 : at + size]
    z = zstandard.ZstdDecompressor().decompress(z) if b[at] else z
    at += size
    out, i = {}, 0
    for name, code in names:
        t = np.dtype(_TYPES[code])
        if name == b"h":
            out["h"] = np.frombuffer(b, t, n, at)
            at += n * t.itemsize
        else:
            d = np.ascontiguousarray(np.frombuffer(z, np.uint8, n * t.itemsize, i).reshape(t.itemsize, n).T).view(t).reshape(n)
            out[name.decode()] = np.cumsum(d, dtype=t)
            i += n * t.itemsize
    return out


def load_all(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts = [load(b) for b in blobs]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def dump_table(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as w:
        w.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def load_table(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()
