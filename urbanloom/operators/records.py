"""Delimited lines into typed records, and a reason for every line that fails.

Structure is judged by pyarrow: a linear-time pattern accepts or rejects the
quoting of a line, pyarrow's CSV reader splits what remains and hands every row
of the wrong width to a callback, and all fields come back as strings. Values
are then judged and cast as whole vectors. There is no shuffle and no state
beyond one Arrow batch.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: The greatest bigint; texts of its length compare as their numbers do.
MOST_KEY = "9223372036854775807"
DIGITS = r"^[0-9]+$"
#: Bytes of text that go through the CSV reader at once.
CHUNK_BYTES = 32 << 20


@dataclass(frozen=True)
class Part:
    """One field of a layout. kind: text, key (digits), number, whole, choice."""

    name: str
    kind: str
    spark: str
    required: bool = True
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Layout:
    name: str
    delimiter: str
    parts: tuple[Part, ...] = field(default_factory=tuple)


POINTS = Layout(
    "points",
    ",",
    (
        Part("cloud_id", "text", "string"),
        Part("point_id", "key", "bigint"),
        Part("x", "number", "double"),
        Part("y", "number", "double"),
        Part("z", "number", "double"),
        Part("classification", "whole", "smallint", False, 0, 255),
        Part("intensity", "whole", "int", False, 0, 65535),
        Part("return_number", "whole", "tinyint", False, 1, 15),
        Part("num_returns", "whole", "tinyint", False, 1, 15),
    ),
)
FIELDS = Layout(
    "fields",
    ";",
    (
        Part("station_id", "key", "string"),
        Part("station_name", "text", "string"),
        Part("lat", "number", "double", True, -90, 90),
        Part("lon", "number", "double", True, -180, 180),
        Part("height", "number", "double", False),
        Part("value", "number", "double", False),
        Part("quality", "choice", "string", False, None, None, ("G", "Y", "O", "R")),
        Part("comment", "free", "string", False),
    ),
)
LAYOUTS = (POINTS, FIELDS)
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "smallint": pa.int16(), "int": pa.int32(), "tinyint": pa.int8()}


def _grammar(delimiter: str) -> str:
    blank, quoted = r"[ \t\r]*", r'"(?:[^"\n]|"")*"'
    one = f'(?:{blank}{quoted}{blank}|[^"{delimiter}]*)'
    return rf"\A{one}(?:{delimiter}{one})*\z"


def _stand_ins(text: pa.Array, wanted: str) -> dict[str, str]:
    """A private-use character for each of `wanted`, none of which occurs in `text`."""
    out, code = {}, 0xE000
    for char in wanted:
        if not pc.any(pc.match_substring(text, char)).as_py():
            continue
        while pc.any(pc.match_substring(text, chr(code))).as_py():
            code += 1
        out[char] = chr(code)
        code += 1
    return out


def _split(lines: pa.Array, layout: Layout) -> tuple[np.ndarray, dict[str, pa.Array], np.ndarray]:
    """Rows of the right width (their places and fields), and the places of the rest."""
    names = [p.name for p in layout.parts]
    lines = pc.replace_substring_regex(lines, r'[ \t\r]*("(?:[^"]|"")*")[ \t\r]*', r"\1")
    stand = _stand_ins(lines, "\r\n\x00")
    for char, other in stand.items():
        lines = pc.replace_substring(lines, char, other)
    numbered = pc.binary_join_element_wise(pc.cast(pa.array(np.arange(len(lines))), pa.string()), lines, layout.delimiter)
    wrong: set[int] = set()

    def reject(row: csv.InvalidRow) -> str:
        wrong.add(int(row.text.split(layout.delimiter, 1)[0]))
        return "skip"

    data = "\n".join(numbered.to_pylist()).encode() + b"\n"
    parsed = csv.read_csv(
        io.BytesIO(data),
        read_options=csv.ReadOptions(column_names=["", *names], use_threads=False, block_size=len(data) + 1),
        parse_options=csv.ParseOptions(delimiter=layout.delimiter, quote_char='"', double_quote=True, escape_char=False, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=reject),
        convert_options=csv.ConvertOptions(column_types={"": pa.int64(), **dict.fromkeys(names, pa.string())}, null_values=[], strings_can_be_null=False, quoted_strings_can_be_null=False),
    )
    parsed = parsed.combine_chunks()
    fields = {}
    for name in names:
        column = parsed.column(name)
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        for char, other in stand.items():
            column = pc.replace_substring(column, other, char)
        fields[name] = pc.utf8_trim(column, BLANKS)
    return parsed.column("").to_numpy(), fields, np.fromiter(sorted(wrong), np.int64, len(wrong))


def _numbers(text: pa.Array, good: np.ndarray) -> np.ndarray:
    """The good texts as doubles, cast as one vector; the others are NaN."""
    held = pc.if_else(pa.array(good), text, pa.scalar(None, pa.string()))
    return pc.fill_null(pc.cast(held, pa.float64()), np.nan).to_numpy(zero_copy_only=False)


def _judge(part: Part, text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which values of the field hold, and the typed vector (NULL where empty or bad)."""
    empty = pc.equal(text, "").to_numpy(zero_copy_only=False)
    kind = _ARROW[part.spark]
    if part.kind in ("text", "free"):
        return (~empty if part.required else np.ones(len(text), bool)), pc.if_else(pa.array(empty), pa.scalar(None, pa.string()), text)
    if part.kind == "choice":
        ok = empty | pc.is_in(text, pa.array(part.choices)).to_numpy(zero_copy_only=False)
        return ok, pc.if_else(pa.array(ok & ~empty), text, pa.scalar(None, pa.string()))
    shape = pc.match_substring_regex(text, NUMBER if part.kind == "number" else DIGITS).to_numpy(zero_copy_only=False)
    if part.kind == "key":
        # digits of any length are a valid key; one beyond 64 bits has no bigint form and is kept as NULL
        if part.spark == "string":
            return shape, pc.if_else(pa.array(shape), text, pa.scalar(None, pa.string()))
        bare = pc.replace_substring_regex(text, "^0+([0-9])", r"\1")
        digits = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
        fits = shape & ((digits < len(MOST_KEY)) | (digits == len(MOST_KEY)) & pc.less_equal(bare, MOST_KEY).to_numpy(zero_copy_only=False))
        return shape, pc.if_else(pa.array(fits), bare, pa.scalar(None, pa.string())).cast(kind)
    values = _numbers(text, shape)
    ok = shape & np.isfinite(values)
    if part.low is not None:
        ok &= ~((values < part.low) | (values > part.high))
    typed = pa.array(np.where(ok, values, 0.0), mask=~ok).cast(kind)
    return (ok if part.required else ok | empty), typed


def _layout_type(layout: Layout) -> pa.StructType:
    return pa.struct([(p.name, _ARROW[p.spark]) for p in layout.parts])


def _parse(keys: pa.Array, layouts: pa.Array, lines: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    size = len(keys)
    reason = np.full(size, "unknown_layout", dtype=object)
    bad_field = np.full(size, None, dtype=object)
    structs = {layout.name: (np.full(size, -1), None) for layout in LAYOUTS}
    lines = pc.fill_null(lines, "")
    for layout in LAYOUTS:
        mine = np.flatnonzero(pc.fill_null(pc.equal(layouts, layout.name), False).to_numpy(zero_copy_only=False))
        if not len(mine):
            continue
        text = lines.take(pa.array(mine))
        quoted = pc.match_substring_regex(text, _grammar(layout.delimiter)).to_numpy(zero_copy_only=False)
        reason[mine] = np.where(quoted, None, "quoting")
        mine, text = mine[quoted], text.filter(pa.array(quoted))
        length = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)) // CHUNK_BYTES if len(text) else np.array([])
        places, columns = [], {p.name: [] for p in layout.parts}
        for chunk in np.unique(length):
            own = np.flatnonzero(length == chunk)
            at, fields, wrong = _split(text.take(pa.array(own)), layout)
            reason[mine[own[wrong]]] = "column_count"
            places.append(mine[own[at]])
            for p in layout.parts:
                columns[p.name].append(fields[p.name])
        at = np.concatenate(places) if places else np.array([], np.int64)
        typed, bad = [], np.zeros(len(at), bool)
        for p in layout.parts:
            ok, vector = _judge(p, pa.concat_arrays(columns[p.name]) if places else pa.array([], pa.string()))
            first = ~ok & ~bad
            bad_field[at[first]] = p.name
            bad |= ~ok
            typed.append(vector)
        reason[at[bad]] = "invalid_value"
        good = np.flatnonzero(~bad)
        where = np.full(size, -1)
        where[at[good]] = good
        structs[layout.name] = (where, pa.StructArray.from_arrays(typed, fields=list(_layout_type(layout))))
    out = [keys, layouts, pa.array(reason, pa.string()), pa.array(bad_field, pa.string())]
    for layout in LAYOUTS:
        where, struct = structs[layout.name]
        if struct is None:
            out.append(pa.nulls(size, _layout_type(layout)))
        else:
            out.append(struct.take(pa.array(where, mask=where < 0)))
    yield pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in out], schema=schema)


def parse_records(lines: DataFrame, key: str = "record_id", layout: str = "layout", line: str = "line") -> DataFrame:
    """Every row of `lines` judged and parsed.

    Columns: `key`, layout, reason (NULL for a valid record, else quoting,
    column_count, invalid_value or unknown_layout, the first that applies),
    bad_field (the first field that fails), and one struct per layout, which is
    filled for valid records of that layout.

    Defined results: a NULL line counts as an empty one, which has one column;
    a NULL or unlisted layout gives unknown_layout; lines of any length are
    read whole; repeated rows each give a row; other columns of the input, of
    whatever name, are left out; an empty table gives an empty result.
    """
    source = lines.select(F.col(key).cast("bigint").alias("record_id"), F.col(layout).cast("string").alias("layout"), F.col(line).cast("string").alias("line"))
    shape = ", ".join(f"{x.name} struct<{', '.join(f'{p.name}: {p.spark}' for p in x.parts)}>" for x in LAYOUTS)
    schema = pa.schema([("record_id", pa.int64()), ("layout", pa.string()), ("reason", pa.string()), ("bad_field", pa.string()), *((x.name, _layout_type(x)) for x in LAYOUTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _parse(batch.column(0), batch.column(1).cast(pa.string()), batch.column(2).cast(pa.string()), schema)

    return source.mapInArrow(run, f"record_id bigint, layout string, reason string, bad_field string, {shape}")


def rejected(parsed: DataFrame) -> DataFrame:
    """The records that fail, with the reason."""
    return parsed.where("reason IS NOT NULL").select("record_id", "reason")


def valid(parsed: DataFrame, layout: str) -> DataFrame:
    """The typed columns of the valid records of a layout."""
    return parsed.where(f"reason IS NULL AND layout = '{layout}'").select("record_id", f"{layout}.*")
