"""Texts over a token limit, cut into pieces at natural boundaries, with an overlap.

A worker turns each long text into one mark per token: how strong a boundary
lies behind it. The cutting itself is one regular expression over the marks,
with bounded quantifiers and alternatives from the strongest boundary down to a
single character; array functions turn the matches into offsets, step back by
the overlap, and take the pieces out of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from urbanloom.llm.tokens import encoder, ranks_path
from urbanloom.plans.tables import pinned

LIMIT, OVERLAP = 1200, 100
#: Tokens kept free: a cut inside a word can change how its rest is tokenized, and a character has up to four bytes.
SPARE = 8
#: Characters of a block; a piece is cut out of the few blocks it lies in, so a text of any length is walked once.
BLOCK = 4096
#: Cuts that are added up in one run; runs are added up in turn.
RUN = 256
#: Marks, strongest first: paragraph, line, sentence, word, character; x: inside a character.
PARAGRAPH = regex.compile(r"\s*\n[^\S\n]*\n\s*")
LINE = regex.compile(r"\s*\n\s*")
SENTENCE = regex.compile(r"[.!?…][\"')\]»”’]*(?=\s)\s*|[。！？]+[」』]?\s*")
BLANK = regex.compile(r"\s+")


def marks(text: str, ends: np.ndarray) -> str:
    """The mark of every place of `ends` (character offsets; -1: inside a character)."""
    size = len(text) + 1
    kind = np.full(size, ord("c"), np.uint8)
    for pattern, letter in ((BLANK, "w"), (SENTENCE, "s"), (LINE, "l"), (PARAGRAPH, "p")):
        for m in pattern.finditer(text):
            start = m.start() if letter != "s" else m.start() + len(m.group().rstrip())
            kind[start : m.end() + 1] = ord(letter)
    out = kind[np.maximum(ends, 0)]
    out[ends < 0] = ord("x")
    return out.tobytes().decode()


def token_ends(text: str, tokens: list[int], lengths: list[int]) -> np.ndarray:
    """The character offset behind every token, -1 where it ends inside a character."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    begins = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(begins)])
    at = np.cumsum(lengths)
    whole = np.append(begins, True)[at]
    return np.where(whole, before[at], -1).astype(np.int32)


def cut_pattern(limit: int, overlap: int) -> str:
    """The expression that eats the marks of one piece: all that is left, or up to the last strong boundary, else a weaker one."""

    def up_to(most: int) -> str:
        half, quarter = max(0, most // 2 - 1), max(0, most // 4 - 1)
        natural = "|".join(f".{{{half},{most - 1}}}{b}" for b in "pls")
        # a boundary in the early part still goes before a cut inside a word
        return f".{{1,{most}}}\\z|{natural}|.{{{quarter},{most - 1}}}w|.{{0,{most - 1}}}[plsw]|.{{0,{most - 1}}}[^x]"

    return f"\\A(?:{up_to(limit - SPARE)})|{up_to(limit - overlap - SPARE)}"


def pieces(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None) -> DataFrame:
    """The pieces of every document of more than `limit` tokens.

    Columns: doc_id, doc_tokens, piece (from 0), first_token, n_tokens, boundary
    (the mark behind the piece: p, l, s, w, c, or end), start (character offset),
    text. Consecutive pieces share the `overlap` tokens before the cut (up to
    three more where that would begin inside a character).

    Defined results: NULL, empty and short texts give no pieces; a text without
    any boundary is cut between characters; every row of a repeated document
    gives its pieces; extra columns are left out; an empty table gives none.
    """
    if not 0 <= overlap < limit - 4 * SPARE:
        raise ValueError("the overlap must be well below the limit")
    file = ranks_path(path)
    kind = documents.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("blocks", pa.list_(pa.string())), ("marks", pa.string()), ("ends", pa.list_(pa.int32()))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(file)
        for batch in batches:
            for k in range(batch.num_rows):  # one document at a time: its marks can be long
                text = batch.column(1)[k].as_py()
                tokens = tokenizer.encode_ordinary(text)
                if len(tokens) > limit:
                    ends = token_ends(text, tokens, [len(b) for b in tokenizer.decode_tokens_bytes(tokens)])
                    blocks = [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([blocks], pa.list_(pa.string())), pa.array([marks(text, ends)]), pa.array([ends], pa.list_(pa.int32()))], schema=schema)

    # a token has at least one byte, so shorter texts can't exceed the limit
    long = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") > limit)
    marked = long.mapInArrow(mark, f"doc_id {kind.simpleString()}, blocks array<string>, marks string, ends array<int>")
    eaten = F.regexp_extract_all("marks", F.lit(cut_pattern(limit, overlap)), F.lit(0))
    cut = pinned(marked, {"eaten": eaten})
    cut = pinned(cut, {"cuts": running_sums(F.transform("eaten", lambda s: F.length(s)))})

    def begun(until: Column, k: Column) -> Column:
        """Until which token a piece goes, and `back`, the tokens before it less the overlap."""
        back = F.when(k == 0, 0).otherwise(F.greatest(F.get("cuts", k - 1) - overlap, F.lit(0)))
        return F.struct(k.alias("piece"), until.alias("until"), back.alias("back"), F.right(F.get("eaten", k), F.lit(1)).alias("mark"))

    def aligned(p: Column) -> Column:
        """Up to three tokens more where the overlap would begin inside a character."""
        x = [F.coalesce(F.get("ends", p.back - 1 - j) < 0, F.lit(False)) for j in range(3)]
        inside = F.when(~x[0], 0).when(~x[1], 1).when(~x[2], 2).otherwise(3)
        return F.struct(p.piece.alias("piece"), p.until.alias("until"), (p.back - inside).alias("first_token"), p.mark.alias("mark"))

    def bounded(p: Column) -> Column:
        start = F.when(p.first_token == 0, 0).otherwise(F.get("ends", p.first_token - 1))
        boundary = F.when(p.until == F.size("ends"), "end").otherwise(p.mark)
        return F.struct(p.piece.alias("piece"), p.first_token.alias("first_token"), (p.until - p.first_token).alias("n_tokens"), boundary.alias("boundary"), start.alias("start"), F.get("ends", p.until - 1).alias("stop"))

    def taken(p: Column) -> Column:
        first = F.floor(p.start / BLOCK).cast("int")
        held = F.array_join(F.slice("blocks", first + 1, F.floor((p.stop - 1) / BLOCK).cast("int") - first + 1), "")
        return F.struct(*(p[c].alias(c) for c in ("piece", "first_token", "n_tokens", "boundary", "start")), F.substring(held, p.start - first * BLOCK + 1, p.stop - p.start).alias("text"))

    made = F.transform(F.transform(F.transform(F.transform("cuts", begun), aligned), bounded), taken)
    return cut.select("doc_id", F.size("ends").alias("doc_tokens"), F.inline(made))


def running_sums(steps: Column) -> Column:
    """The running sums of an array of whole numbers, by runs of RUN, so the work doesn't grow with its square."""
    add = lambda run, start: F.aggregate(run, F.struct(F.array().cast("array<int>").alias("done"), start.alias("at")), lambda a, n: F.struct(F.array_append(a.done, (a.at + n).cast("int")).alias("done"), (a.at + n).cast("int").alias("at")))["done"]
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(steps) / RUN).cast("int") - 1, F.lit(0))), lambda k: F.slice(steps, k * RUN + 1, RUN))
    sums = add(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, n: a + n)), F.lit(0))
    return F.flatten(F.transform(runs, lambda r, k: add(r, F.coalesce(F.get(sums, k - 1), F.lit(0)))))
