"""Every value of a quantity in the common unit of its field.

The unit is stated by the unit column, else by the description. Where neither
names one, a hidden Markov model per device (station and field) has the unit as
its hidden state: a smooth underlying level makes jumps of the log value costly,
so a unit switch is decoded where only a switch keeps the level smooth. Stated
units are certain evidence. Decoding is Viterbi in max-plus matrix form: chain
products of K x K score matrices, computed by a segmented scan over whole
vectors, in range partitions that may cut a device anywhere. Partitions exchange
a pair of K x K products each, which are combined in two levels of tasks (blocks
of partitions, then the blocks), so the driver sees none of them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.unitnames import coded, phrases, unit_codes
from urbanloom.plans.tables import checkpointed, pinned, written

NEVER = -1e9
#: Log-score of one unit of log-level change, of a switch, and of a unit that isn't the common one.
JUMP, SWITCH, UNCOMMON = 4.0, 4.0, 1.0
ROWS_A_PARTITION = 50_000
#: Score matrices a partition holds at once, as numbers: fields with many units get fewer rows a partition.
MOST_NUMBERS = 4_000_000
#: Rows scanned at once.
BLOCK = 8192


def stated_units(observations: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """The observations with stated_unit and basis (unit, description or NULL). With `units`, the codes of its rows are names too, and come before other names."""
    field = F.col("field")
    held, maps = observations, ()
    if units is not None:
        own = coded(units)
        held, maps = observations.join(F.broadcast(own), field == F.col("_of"), "left").drop("_of"), (F.col("_exact"), F.col("_folded"))
    named = pinned(held, {"_by_unit": F.get(unit_codes(field, F.array("unit"), *maps), F.lit(0))})
    by_text = F.get(F.filter(unit_codes(field, F.filter(phrases(F.col("description")), lambda p: p != ""), *maps), lambda c: c.isNotNull()), F.lit(0))
    named = pinned(named, {"_by_text": F.when(F.col("_by_unit").isNull(), by_text)})
    basis = F.when(F.col("_by_unit").isNotNull(), "unit").when(F.col("_by_text").isNotNull(), "description")
    return named.withColumns({"stated_unit": F.coalesce("_by_unit", "_by_text"), "basis": basis}).drop("_by_unit", "_by_text", "_exact", "_folded")


class UnitTable:
    """The units of every field as dense arrays; the table is small and fixed (at most 10,000 rows)."""

    def __init__(self, units: DataFrame) -> None:
        rows = sorted(map(tuple, units.select("field", "unit_code", "factor", "shift", "is_common").where("field IS NOT NULL AND unit_code IS NOT NULL").limit(10_001).collect()), key=lambda r: (r[0], not r[4], r[1]))
        if len(rows) > 10_000:
            raise ValueError("the unit table has more than 10,000 rows")
        self.fields = sorted({r[0] for r in rows})
        self.codes = {f: [r[1] for r in rows if r[0] == f] for f in self.fields}
        self.width = max([1, *(len(c) for c in self.codes.values())])
        shape = (len(self.fields) + 1, self.width)
        self.factor, self.shift, self.prior = np.ones(shape), np.zeros(shape), np.full(shape, NEVER)
        for k, f in enumerate(self.fields):
            for j, (_, _, factor, shift, common) in enumerate(r for r in rows if r[0] == f):
                self.factor[k, j], self.shift[k, j], self.prior[k, j] = factor, shift, 0.0 if common else -UNCOMMON


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    return (a[:, :, :, None] + b[:, None, :, :]).max(axis=2)


def _scan(m: np.ndarray) -> np.ndarray:
    """All prefix products of a stack of matrices, in order; twice as many products as matrices."""
    n = len(m)
    if n == 1:
        return m
    even = n // 2
    pairs = _scan(_times(m[0 : 2 * even : 2], m[1 : 2 * even : 2]))
    out = np.empty_like(m)
    out[0], out[1 : 2 * even : 2] = m[0], pairs
    inner = np.arange(2, n, 2)
    if len(inner):
        out[inner] = _times(pairs[inner // 2 - 1], m[inner])
    return out


def _steps(series: np.ndarray, level: np.ndarray, score: np.ndarray, before: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """The score matrix of every row (from the state of the row before to its own), and which rows begin a device."""
    k = level.shape[1]
    new = np.ones(len(series), bool)
    new[1:] = series[1:] != series[:-1]
    previous = np.vstack([level[:1], level[:-1]])
    if before is not None and len(series) and before[0] == series[0]:
        new[0], previous[0] = False, before[1]
    jump = np.minimum(np.abs(level[:, None, :] - previous[:, :, None]), 50.0)
    matrix = -JUMP * jump - SWITCH * (1 - np.eye(k)) + score[:, None, :]
    matrix[new] = score[new][:, None, :]
    return np.maximum(matrix, 4 * NEVER), new


class _Rows:
    """One partition as arrays."""

    def __init__(self, table: pa.Table, units: UnitTable) -> None:
        place = {f: i for i, f in enumerate(units.fields)}
        names = table.column("field").combine_chunks().dictionary_encode() if table.num_rows else None
        dictionary = [place.get(x, len(units.fields)) for x in names.dictionary.to_pylist()] if names is not None else []
        codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False) if names is not None else np.array([], int)
        self.field = np.where(codes < 0, len(units.fields), np.append(np.array(dictionary, int), len(units.fields))[codes]) if len(codes) else np.array([], int)
        self.series = table.column("series").to_numpy()
        value = table.column("value").to_numpy(zero_copy_only=False).astype(float)
        self.value = value
        scale = np.maximum(table.column("scale").to_numpy(zero_copy_only=False).astype(float), 1e-12)
        scale = np.where(np.isfinite(scale), scale, 1.0)
        x = value[:, None] * units.factor[self.field] + units.shift[self.field]
        self.common = x
        self.level = np.arcsinh(np.nan_to_num(x, nan=0.0, posinf=1e300, neginf=-1e300) / scale[:, None])
        self.score = units.prior[self.field].copy()
        self.score[self.field == len(units.fields)] = 0.0
        stated = table.column("stated_unit").combine_chunks().dictionary_encode()
        index = np.full((len(units.fields) + 1, len(stated.dictionary) + 1), -1)
        for j, code in enumerate(stated.dictionary.to_pylist()):
            for i, f in enumerate(units.fields):
                if code in units.codes[f]:
                    index[i, j] = units.codes[f].index(code)
        own = index[self.field, stated.indices.fill_null(len(stated.dictionary)).to_numpy(zero_copy_only=False)]
        sure = np.flatnonzero(own >= 0)
        self.score[sure] = NEVER
        self.score[sure, own[sure]] = 0.0


def _read(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def normalise_units(observations: DataFrame, units: DataFrame, rows_a_partition: int = ROWS_A_PARTITION) -> DataFrame:
    """Every observation with a value, in the common unit of its field.

    Columns: obs_id, station_id, field, value, basis (unit, description or
    decoded), unit_code (stated, else decoded by the model), is_common, common
    (the value in the common unit).

    Defined results: rows repeated in all columns count once; NULL and NaN
    values are left out; a field without units keeps unit_code and common NULL;
    a NULL station is a device of its own; NULL ts falls back to received_at,
    then sorts first; rows of one instant go by obs_id; extra columns are left
    out; an empty table gives an empty result. A device may hold any share of
    the rows: its chain is cut where the range partitions cut it.
    """
    spark = observations.sparkSession
    kept = observations.select("obs_id", "station_id", "field", "value", "unit", "description", F.coalesce("ts", "received_at").alias("at")).where("value IS NOT NULL AND NOT isnan(value)").distinct()
    known = UnitTable(units)
    common = units.select(F.col("field").alias("_f"), F.col("unit_code").alias("_u"), "factor", "shift", "is_common")
    # every wording is read once, however many rows share it; both the scales and the chain start from the written table
    words = ["field", "unit", "description"]
    wordings = written(stated_units(observations.where("value IS NOT NULL AND NOT isnan(value)").select(*words).distinct(), units), "wordings")
    told = wordings.select(*(F.col(c).alias(f"_{c}") for c in words), "stated_unit", "basis")
    named = written(kept.join(told, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in words]).drop(*words[1:], *(f"_{c}" for c in words)), "stated")
    # the scale of a field: the median size of its stated values in the common unit
    sized = named.join(common, (named.field == F.col("_f")) & (named.stated_unit == F.col("_u"))).groupBy("_f").agg(F.percentile_approx(F.abs(F.col("value") * F.col("factor") + F.col("shift")), 0.5, 1000).alias("scale"))
    named = named.join(sized, named.field == sized._f, "left").drop("_f")
    named = named.withColumn("series", F.xxhash64("station_id", "field"))
    k = known.width
    rows_a_partition = max(1, min(rows_a_partition, MOST_NUMBERS // (k * k)))
    parts = max(1, math.ceil(observations.count() / rows_a_partition))
    order = ["series", "at", "obs_id", "value"]
    placed = named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    chain = checkpointed(placed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _read(batches)
        if table is None:
            return
        r = _Rows(table, known)
        matrix, new = _steps(r.series, r.level, r.score, None)
        # the first row is kept apart: its matrix depends on the row before it
        starts = np.flatnonzero(new)
        first_end = starts[1] if len(starts) > 1 else len(r.series)
        head = _scan(matrix[1:first_end])[-1] if first_end > 1 else np.where(np.eye(k) > 0, 0.0, 4 * NEVER)
        tail = _scan(matrix[starts[-1] :])[-1]
        end = _End(table.column("part")[0].as_py(), int(r.series[0]), int(r.series[-1]), r.level[0], r.level[-1], r.score[0], head, tail, len(starts) == 1)
        yield _as_batch([end])

    ends = written(chain.mapInArrow(edges, END), "ends").withColumn("block", F.floor(F.col("part") / math.ceil(math.sqrt(parts))).cast("int"))
    messages = _exchanged(ends, k)

    def decode(table: pa.Table, message: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _NOTHING
        table = table.sort_by("place")
        r = _Rows(table, known)
        told = message.to_pylist()[0] if message.num_rows else {}
        before = (r.series[0], np.array(told["level"]), np.array(told["alpha"])) if told.get("alpha") else None
        matrix, new = _steps(r.series, r.level, r.score, before and before[:2])
        if before:
            matrix[0] = (before[2][:, None] + matrix[0]).max(axis=0)[None, :]
        forward = _segmented(matrix, new | (np.arange(len(new)) == 0))
        # backward: the same chains from the other end
        to_next = np.zeros_like(matrix)
        to_next[:-1] = np.where(new[1:, None, None], 0.0, matrix[1:])
        if told.get("beta"):
            to_next[-1] = np.repeat(np.array(told["beta"])[:, None], k, axis=1)
        last = np.append(new[1:], True)
        backward = _segmented(to_next.transpose(0, 2, 1)[::-1], last[::-1])[::-1]
        # rounded, so that equal paths give the first state however the chain was cut
        total = forward + backward
        state = np.round(total - total.max(axis=1, keepdims=True), 5).argmax(axis=1)
        rows = np.arange(len(state))
        covered = (r.field < len(known.fields)) & (known.prior[r.field, state] > NEVER)
        names = pa.array([x for f in known.fields for x in (*known.codes[f], *[None] * (k - len(known.codes[f])))] + [None] * k, pa.string())
        covers = pa.array(covered)
        none = pa.scalar(None, pa.string())
        stated = table.column("stated_unit").combine_chunks()
        code = pa.compute.if_else(covers, names.take(pa.array(r.field * k + state)), none)
        basis = pa.compute.if_else(pa.compute.is_valid(stated), table.column("basis").combine_chunks(), pa.compute.if_else(covers, pa.scalar("decoded"), none))
        return pa.Table.from_arrays(
            [
                *(table.column(c).combine_chunks() for c in ("obs_id", "station_id", "field", "value")),
                basis,
                code,
                pa.array(np.where(covered, r.common[rows, state], 0.0), mask=~covered),
            ],
            schema=_NOTHING.schema,
        )

    decoded = chain.groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(decode, "obs_id bigint, station_id string, field string, value double, basis string, unit_code string, common double")
    flags = spark.createDataFrame([(f, c, bool(known.prior[i, j] == 0.0)) for i, f in enumerate(known.fields) for j, c in enumerate(known.codes[f])], "_f string, _u string, is_common boolean")
    return decoded.join(F.broadcast(flags), (F.col("field") == F.col("_f")) & (F.col("unit_code") == F.col("_u")), "left").select("obs_id", "station_id", "field", "value", "basis", "unit_code", "is_common", "common")


def _segmented(matrix: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best score of every state at every row, of the chain of its segment up to it.

    A row that starts a segment has equal rows in its matrix, which forgets what
    was before. Blocks of rows are scanned one after another, so memory stays
    bounded; scores are taken relative to the best state, so sums don't grow.
    """
    out = np.empty(matrix.shape[:2])
    carry = None
    for begin in range(0, len(matrix), BLOCK):
        block = matrix[begin : begin + BLOCK].copy()
        if carry is not None and not start[begin]:
            block[0] = (carry[:, None] + block[0]).max(axis=0)[None, :]
        marks = np.flatnonzero(start[begin : begin + BLOCK])
        block[marks] = block[marks].max(axis=1, keepdims=True)
        scores = _scan(block).max(axis=1)
        out[begin : begin + BLOCK] = scores - scores.max(axis=1, keepdims=True)
        carry = out[begin + len(block) - 1]
    return out


class _End(NamedTuple):
    """What a run of rows shows to its neighbours: its first and last device and level, the first row's scores, the products of
    its first device's chain after that row (head) and of its last device's (tail), and whether it holds one device only."""

    part: int
    first: int
    last: int
    first_level: np.ndarray
    last_level: np.ndarray
    score: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    whole: bool


_VECTORS = ("first_level", "last_level", "score", "head", "tail")
END = "part int, first bigint, last bigint, first_level array<double>, last_level array<double>, score array<double>, head array<double>, tail array<double>, whole boolean"
_END_SCHEMA = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), *((c, pa.list_(pa.float64())) for c in _VECTORS), ("whole", pa.bool_())])
_NOTHING = pa.schema([("obs_id", pa.int64()), ("station_id", pa.string()), ("field", pa.string()), ("value", pa.float64()), ("basis", pa.string()), ("unit_code", pa.string()), ("common", pa.float64())]).empty_table()
_MESSAGE = pa.schema([("part", pa.int32()), *((c, pa.list_(pa.float64())) for c in ("level", "alpha", "beta"))])


def _as_batch(ends: list[_End]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{**e._asdict(), **{c: getattr(e, c).ravel().tolist() for c in _VECTORS}} for e in ends], schema=_END_SCHEMA)


def _ends(table: pa.Table, k: int) -> list[_End]:
    """The ends of a table in the order of their parts."""
    shaped = lambda r: {c: np.array(r[c]).reshape(k, k) if c in ("head", "tail") else np.array(r[c]) for c in _VECTORS}
    return [_End(**({f: r[f] for f in _End._fields} | shaped(r))) for r in sorted(table.to_pylist(), key=lambda r: r["part"])]


def _joined(a: _End, b: _End) -> _End:
    """Two adjacent runs as one; products are taken relative to their best entry."""
    one = lambda x, y: (x[:, :, None] + y[None, :, :]).max(axis=1)
    level = lambda m: m - m.max()
    head, tail = a.head, b.tail
    if a.last == b.first:
        link = _link(a.last_level, b.first_level, b.score)
        if a.whole:
            head = level(one(one(a.head, link), b.head))
        if b.whole:
            tail = level(one(one(a.tail, link), b.head))
    return _End(a.part, a.first, b.last, a.first_level, b.last_level, a.score, head, tail, a.whole and b.whole and a.last == b.first)


def _exchanged(ends: DataFrame, k: int) -> DataFrame:
    """part, level and alpha (what the part before says), beta (what the part after says) of every part, NULL where its device doesn't go on.

    Blocks of parts are joined to one end each, messages are passed along the
    blocks (one row a block, in one task), then along the parts of each block."""

    def as_one(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        whole = functools.reduce(_joined, _ends(table, k))
        return pa.Table.from_batches([_as_batch([whole._replace(part=block)])])

    def along(table: pa.Table) -> pa.Table:
        return _messages(_ends(table, k), None, None)

    def within(table: pa.Table, message: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _MESSAGE.empty_table()
        held = _ends(table, k)
        told = message.to_pylist()[0] if message.num_rows else {}
        before = (held[0].first, np.array(told["level"]), np.array(told["alpha"])) if told.get("alpha") else None
        return _messages(held, before, np.array(told["beta"]) if told.get("beta") else None)

    shape = "part int, level array<double>, alpha array<double>, beta array<double>"
    blocks = ends.groupBy("block").applyInArrow(as_one, END)
    among = blocks.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(along, shape)  # as many rows as the root of the number of parts
    return ends.groupBy("block").cogroup(among.withColumnRenamed("part", "block").groupBy("block")).applyInArrow(within, shape)


def _messages(ends: list[_End], before: tuple | None, after: np.ndarray | None) -> pa.Table:
    """The messages of a row of runs; `before` (device, level, scores) and `after` (scores at the last row) come from outside."""
    entry, leave = {}, {}
    carry = before
    for e in ends:
        comes = carry if carry is not None and carry[0] == e.first else None
        if comes is not None:
            entry[e.part] = comes
        if e.whole and comes is not None:
            alpha = (comes[2][:, None] + _link(comes[1], e.first_level, e.score)).max(axis=0)
            alpha = (alpha[:, None] + e.head).max(axis=0)
        else:
            alpha = e.tail.max(axis=0)
        carry = (e.last, e.last_level, alpha - alpha.max())
    later, nxt = after, None
    for e in reversed(ends):
        if nxt is not None:
            if nxt.first == e.last:
                beta = (nxt.head + later[None, :]).max(axis=1) if nxt.whole and later is not None else nxt.head.max(axis=1)
                back = (_link(e.last_level, nxt.first_level, nxt.score) + beta[None, :]).max(axis=1)
                later = back - back.max()
            else:
                later = None
        if later is not None:
            leave[e.part] = later
        nxt = e
    rows = [{"part": e.part, "level": entry[e.part][1].tolist() if e.part in entry else None, "alpha": entry[e.part][2].tolist() if e.part in entry else None, "beta": leave[e.part].tolist() if e.part in leave else None} for e in ends]
    return pa.Table.from_pylist(rows, schema=_MESSAGE)


def _link(before: np.ndarray, level: np.ndarray, score: np.ndarray) -> np.ndarray:
    jump = np.minimum(np.abs(level[None, :] - before[:, None]), 50.0)
    return np.maximum(-JUMP * jump - SWITCH * (1 - np.eye(len(level))) + score[None, :], 4 * NEVER)


def converted(normalised: DataFrame) -> DataFrame:
    """The observations stated in another unit than the common one: obs_id, unit_code, milli (thousandths)."""
    stated = normalised.where("basis IN ('unit', 'description') AND NOT is_common")
    return stated.select("obs_id", "unit_code", F.rint(F.col("common") * 1000).cast("bigint").alias("milli"))
