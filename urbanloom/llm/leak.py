"""Documents that hold passages of held-out texts, and which.

A document leaks an item if it holds `window` consecutive words of it, or all
words of a shorter item. Both sides become shingles (hashes of five consecutive
words, or of the whole item where that is shorter). Item shingles are ordered
by how rare they are in the whole corpus; a window's prefix is its rarest
shingle, which any document that holds the window must hold. Only prefixes are
joined with the corpus, length and position bounds drop what can't hold a
window, and the rest is verified word by word. A text travels once per item that
it may hold, whatever the number of places.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from urbanloom.plans.tables import written

WINDOW, SHINGLE = 13, 5
#: What a reader doesn't see: format characters, variation selectors, fillers.
UNSEEN = regex.compile(r"[\p{Cf}\p{Variation_Selector}͏ᅟᅠ឴឵ㅤﾠ]")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
PLAIN_WORD = re.compile(r"[a-z0-9]+")
#: Up to so many item shingles (8 bytes each) go to the workers, which then leave out the corpus shingles that no item has; the join that follows does it in any case.
MOST_SENT = 1 << 20
#: Places of an item in a text that are verified together.
PLACES = 1_000


def words(text: str | None) -> list[str]:
    """The words of a text as a reader sees them: case, width, composition, signs and unseen characters make no difference."""
    if not text:
        return []
    if text.isascii():  # nothing to compose, fold or leave out
        return PLAIN_WORD.findall(text.lower())
    folded = unicodedata.normalize("NFKC", UNSEEN.sub("", text)).casefold()
    return WORD.findall(UNSEEN.sub("", unicodedata.normalize("NFKC", folded)))


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.int64)
    mixed = np.full(count, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def shingled(texts: DataFrame, key: str, sizes: list[int] | None, wanted: np.ndarray | None = None) -> DataFrame:
    """key, n_words, at, shingle: every run of words of the given sizes, or of min(SHINGLE, n_words) words where sizes is None; only those of `wanted` (sorted), if given."""
    kind = texts.schema[key].dataType
    schema = pa.schema([("key", to_arrow_type(kind)), ("n_words", pa.int32()), ("at", pa.list_(pa.int32())), ("shingle", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):  # long texts have many shingles
                yield one(batch.slice(begin, 256), known)

    def one(batch: pa.RecordBatch, known: dict[str, int]) -> pa.RecordBatch:
        counts, ats, shingles, sizes_of = [], [], [], []
        if len(known) > 1_000_000:
            known.clear()
        for text in batch.column(1):
            own = words(text.as_py())
            for w in own:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            hashes = np.fromiter((known[w] for w in own), np.uint64, len(own))
            made = [_shingles(hashes, s) for s in (sizes or [min(SHINGLE, len(own))] if own else [])]
            at = np.concatenate([np.arange(len(m), dtype=np.int32) for m in made]) if made else np.empty(0, np.int32)
            all_made = np.concatenate(made) if made else np.empty(0, np.int64)
            if wanted is not None:
                place = np.searchsorted(wanted, all_made)
                kept = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == all_made) if len(wanted) else np.empty(0, int)
                at, all_made = at[kept], all_made[kept]
            counts.append(len(own))
            sizes_of.append(len(at))
            ats.append(at)
            shingles.append(all_made)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes_of)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v) if v else np.empty(0, t))) for v, t in ((ats, np.int32), (shingles, np.int64))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), *lists], schema=schema)

    made = texts.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    arrays = made.mapInArrow(run, f"key {kind.simpleString()}, n_words int, at array<int>, shingle array<bigint>").where("size(at) > 0")
    return arrays.select("key", "n_words", F.inline(F.arrays_zip("at", "shingle")))


def leaks(documents: DataFrame, items: DataFrame, document_key: str = "doc_id", item_key: str = "item_id", window: int = WINDOW) -> DataFrame:
    """document_key and item_key of every document and item of which it holds a passage, once each.

    Defined results: NULL or wordless texts leak nothing and hold nothing; an
    item repeated under several keys is reported under each; documents of any
    length are read whole; keys keep their type, NULL keys are left out; extra
    columns are left out; an empty side gives an empty result.
    """
    item_shingles = shingled(items, item_key, None).withColumn("m", F.col("n_words")).withColumn("size", F.least(F.lit(SHINGLE), "n_words")).withColumn("need", F.least(F.lit(window), "n_words"))
    item_shingles = written(item_shingles, "item-shingles")
    sizes = sorted(r[0] for r in item_shingles.select("size").distinct().collect())  # at most SHINGLE values
    if not sizes:
        sizes = [SHINGLE]
    # the places of the corpus where any item shingle stands; a semi-join, no pairs
    kinds = item_shingles.select("shingle").distinct()
    some = [r[0] for r in kinds.limit(MOST_SENT + 1).collect()]
    wanted = np.sort(np.array(some, np.int64)) if len(some) <= MOST_SENT else None
    hits = shingled(documents, document_key, sizes, wanted).join(kinds, "shingle", "left_semi")
    hits = written(hits.select("key", "n_words", "at", "shingle"), "hits")
    rarity = hits.groupBy("shingle").agg(F.count("*").alias("df"))
    # the rarest shingle of every window of every item
    ranked = item_shingles.join(rarity, "shingle", "left").withColumn("order", F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("shingle"), F.col("at")))
    ahead = Window.partitionBy("key").orderBy("at")
    longest = window - min(SHINGLE, window)
    # windows of a short item hold one shingle only, as it is the whole item or shorter than the window
    best = ranked.withColumn("best", F.array_min(F.slice(F.collect_list("order").over(ahead.rowsBetween(0, longest)), F.lit(1), F.greatest(F.col("need") - F.col("size") + 1, F.lit(1)))))
    prefixes = best.where("at <= m - need").select(F.col("key").alias("item"), "m", "need", "size", F.col("best.at").alias("offset"), F.col("best.shingle").alias("shingle"), F.col("best.df").alias("df")).where("df > 0").distinct()
    prefixes = written(prefixes.drop("df"), "prefixes")
    # length and position: some window over the shingle must fit into both texts
    first = F.greatest(F.col("offset") - F.col("need") + F.col("size"), F.lit(0), F.col("offset") - F.col("at"))
    last = F.least(F.col("offset"), F.col("m") - F.col("need"), F.col("n_words") - F.col("need") + F.col("offset") - F.col("at"))
    candidates = hits.join(prefixes, "shingle").where((first <= last) & (F.col("n_words") >= F.col("need"))).select("key", "item", "need", (F.col("at") - F.col("offset")).alias("shift")).distinct()
    # one row per document and item, its places in bounded lists
    place = F.row_number().over(Window.partitionBy("key", "item").orderBy("shift"))
    grouped = candidates.withColumn("chunk", F.floor(place / PLACES)).groupBy("key", "item", "need", "chunk").agg(F.collect_list("shift").alias("shifts"))
    candidates = written(grouped.drop("chunk"), "candidates")
    texts = documents.select(F.col(document_key).alias("key"), F.col("text").cast("string").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    asked = items.select(F.col(item_key).alias("item"), F.col("text").cast("string").alias("item_text"))
    both = texts.join(candidates, "key").join(asked, "item").select("key", "text", "item", "item_text", "need", "shifts").sortWithinPartitions("key")
    kinds_out = [documents.schema[document_key].dataType, items.schema[item_key].dataType]
    schema = pa.schema([(n, to_arrow_type(k)) for n, k in zip(("key", "item"), kinds_out, strict=True)])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, [])
        seen: dict = {}
        for batch in batches:
            hit = []
            for key, text, item, item_text, need, shifts in zip(*(batch.column(k) for k in range(6)), strict=True):
                key, item = key.as_py(), item.as_py()
                if held[0] != key:
                    held = (key, words(text.as_py()))
                if item not in seen:
                    if len(seen) > 4096:
                        seen.clear()
                    seen[item] = words(item_text.as_py())
                hit.append(any(_longest_run(held[1], seen[item], shift) >= need.as_py() for shift in shifts.as_py()))
            kept = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(2).filter(kept)], schema=schema)

    out = both.mapInArrow(verify, f"key {kinds_out[0].simpleString()}, item {kinds_out[1].simpleString()}").distinct()
    return out.select(F.col("key").alias(document_key), F.col("item").alias(item_key))


def _longest_run(text: list[str], item: list[str], shift: int) -> int:
    """The longest run of equal words with the item laid `shift` words into the text."""
    best = run = 0
    for k in range(max(0, -shift), min(len(item), len(text) - shift)):
        run = run + 1 if item[k] == text[k + shift] else 0
        best = max(best, run)
    return best
