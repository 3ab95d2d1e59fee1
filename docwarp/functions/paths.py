"""File names as text: a canonical form that every name has, also one whose bytes are no UTF-8, and a form to show.

In the canonical form ``%`` is ``%25`` and a byte that belongs to no character is ``%80`` to ``%FF``; all else stands for itself.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docwarp.functions.text import compose

#: A byte that the canonical form escapes. Fixed value.
_ESCAPE = r"%(25|[89A-F][0-9A-F])"
_BYTE = r"%[89A-F][0-9A-F]"
#: Encodings in which names that are no UTF-8 are shown, in the order tried. Fixed values.
LEGACY = ("cp949", "euc-jp", "gb18030")


def _encoded(names: pa.Array) -> pa.Array:
    escape = lambda c: f"%{ord(c) - 0xDC00:02X}" if "\udc80" <= c <= "\udcff" else "%25" if c == "%" else c
    return pa.array([None if n is None else "".join(map(escape, n.decode("utf-8", "surrogateescape"))) for n in names.to_pylist()], pa.string())


def _bytes_of(path: str) -> bytes:
    return re.sub(_ESCAPE.encode(), lambda m: bytes.fromhex(m[1].decode()), path.encode())


def _decoded(paths: pa.Array) -> pa.Array:
    return pa.array([None if p is None else _bytes_of(p) for p in paths.to_pylist()], pa.binary())


def to_canonical(name: Column) -> Column:
    """A binary name's canonical text; only names that are no UTF-8 go through Python."""
    text = name.cast("string")
    good = F.is_valid_utf8(text)
    return F.when(good, F.replace(text, F.lit("%"), F.lit("%25"))).otherwise(F.arrow_udf(_encoded, "string")(F.when(~good, name)))


def from_canonical(path: Column) -> Column:
    """The binary name of a canonical text."""
    odd = F.regexp_like(path, F.lit(_BYTE))
    return F.when(~odd, F.encode(F.replace(path, F.lit("%25"), F.lit("%")), "UTF-8")).otherwise(F.arrow_udf(_decoded, "binary")(F.when(odd, path)))


def is_canonical(path: Column) -> Column:
    """Whether a text is some name's canonical form: each ``%`` begins an escape."""
    return ~F.contains(F.regexp_replace(path, _ESCAPE, ""), F.lit("%"))


def _reading(raw: bytes, encoding: str) -> str | None:
    try:
        return str(raw, encoding)
    except UnicodeDecodeError:
        return None


def _readings(parts: pa.Array) -> pa.Array:
    """For each list of segments their bytes and what each legacy encoding makes of them (null: nothing); a distinct segment is read once."""
    coded = parts.flatten().dictionary_encode()
    raw = pa.array([_bytes_of(s) for s in coded.dictionary.to_pylist()], pa.binary())
    read = [pa.array([_reading(r, e) for r in raw.to_pylist()], pa.string()) for e in LEGACY]
    columns = pa.StructArray.from_arrays([raw, *read], ["raw", *(f"c{i}" for i in range(len(LEGACY)))])
    sizes = parts.value_lengths().fill_null(0).to_pylist()
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), columns.take(coded.indices))


_READINGS = "array<struct<raw:binary," + ",".join(f"c{i}:string" for i in range(len(LEGACY))) + ">>"


def _shown(s: Column) -> Column:
    """A segment as text: its bytes where they are UTF-8, else the first reading that holds no control characters, else each byte escaped."""
    text = s["raw"].cast("string")
    calm = [F.when(~F.regexp_like(s[f"c{i}"], F.lit(r"\p{Cc}")), s[f"c{i}"]) for i in range(len(LEGACY))]
    return F.when(F.is_valid_utf8(text), text).otherwise(F.coalesce(*calm, F.regexp_replace(F.hex(s["raw"]), "(..)", "%$1")))


def display_name(path: Column) -> Column:
    """A readable form of a canonical path, never stored. Only paths with escaped bytes go through Python, which reads the encodings that
    Spark lacks; which reading is shown is decided by columns."""
    odd = F.regexp_like(path, F.lit(_BYTE))
    read = F.arrow_udf(_readings, _READINGS)(F.when(odd, F.split(path, "/", -1)))
    shown = compose(F.array_join(F.transform(read, _shown), "/"))
    return F.when(~odd, F.replace(path, F.lit("%25"), F.lit("%"))).when(odd, shown)
