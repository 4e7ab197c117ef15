"""A small writer of classic NetCDF files, to have some to read."""

import struct

import numpy as np

CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "i8": 10}


def pad(raw):
    return raw + b"\0" * (-len(raw) % 4)


def write(path, dims, variables, records=None, version=1):
    """dims: name -> length, None for the record one; variables: name -> (dims, attrs, array)."""
    count = ">q" if version == 5 else ">i"
    offset = ">i" if version == 1 else ">q"

    def name(text):
        return struct.pack(count, len(text)) + pad(text.encode())

    def listed(tag, items):
        return struct.pack(">i", tag if items else 0) + struct.pack(count, len(items)) + b"".join(items)

    def attribute(key, value):
        if isinstance(value, str):
            raw, code, n = value.encode(), 2, len(value)
        else:
            value = np.atleast_1d(value)
            code, n = CODES[value.dtype.str[1:]], len(value)
            raw = value.astype(value.dtype.newbyteorder(">")).tobytes()
        return name(key) + struct.pack(">i", code) + struct.pack(count, n) + pad(raw)

    order = list(dims)
    unlimited = [d for d, n in dims.items() if n is None]
    streamed = {v: raw for v, raw in variables.items() if raw[0] and raw[0][0] in unlimited}
    fixed = {v: raw for v, raw in variables.items() if v not in streamed}
    n = len(next(iter(streamed.values()))[2]) if streamed else 0

    def big(array):
        array = np.atleast_1d(array)
        return array.astype(array.dtype.newbyteorder(">"))

    def size(array):
        one = array[0] if len(array) else array
        return one.nbytes + (-one.nbytes % 4 if len(streamed) > 1 else 0)

    def header(begins):
        entries = []
        for v, (vdims, attrs, array) in {**fixed, **streamed}.items():
            vsize = size(array) if v in streamed else len(pad(array.tobytes()))
            where = b"".join(struct.pack(count, order.index(d)) for d in vdims)
            entries.append(name(v) + struct.pack(count, len(vdims)) + where
                           + listed(12, [attribute(k, a) for k, a in attrs.items()])
                           + struct.pack(">i", CODES[array.dtype.str[1:]]) + struct.pack(count, vsize)
                           + struct.pack(offset, begins.get(v, 0)))
        return (b"CDF" + bytes([version]) + struct.pack(count, n if records is None else records)
                + listed(10, [name(d) + struct.pack(count, length or 0) for d, length in dims.items()])
                + listed(12, [attribute("title", "made for a test")]) + listed(11, entries))

    at, begins = len(header({})), {}
    for v, (_, _, array) in fixed.items():
        begins[v], at = at, at + len(pad(array.tobytes()))
    for v, (_, _, array) in streamed.items():
        begins[v], at = at, at + size(array)
    with open(path, "wb") as f:
        f.write(header(begins))
        for _, _, array in fixed.values():
            f.write(pad(big(array).tobytes()))
        for i in range(n):
            for _, _, array in streamed.values():
                raw = big(array[i]).tobytes()
                f.write(pad(raw) if len(streamed) > 1 else raw)
