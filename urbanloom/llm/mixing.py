"""A mixture whose sources have given shares by tokens, with capped repeats.

Token totals per source, language and topic are raked (iterative proportional
fitting) to the target shares of the sources and the corpus shares of languages
and topics, within the cap on repeats; sources come last in every round, so
theirs hold exactly. A document of several tags belongs to each of their topics
by an equal part, and is scaled by the geometric mean of their ratios
(generalised iterative scaling). The fitted factor of a document's cell is its
expected number of copies, by which it is sampled with a hash of its key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.llm.tokens import with_tokens
from urbanloom.plans.tables import written

#: Cells (source, language, set of topics) that are fitted as arrays on the driver; more are fitted by the same rounds as tables.
MOST_CELLS = 1_000_000
#: Rounds at most, and the relative change of a factor below which a fit has settled.
ROUNDS, SETTLED = 60, 1e-6
CELL = ["source", "lang", "topics"]


def rake(tokens: np.ndarray, cap: np.ndarray, source: np.ndarray, wanted: np.ndarray, margins: list[tuple], rounds: int = ROUNDS) -> np.ndarray:
    """The factor of every cell: tokens * factor has the source totals `wanted` (less where the cap forbids) and comes near the other margins.

    `margins` are pairs of cell labels and target totals, or, for cells that
    belong to several labels by parts, cell, label, part (as parallel arrays) and
    target totals. Factors stay within 0..cap.
    """
    factor = np.minimum(1.0, cap)
    for _ in range(rounds):
        before = factor
        for margin in margins:
            cell, label, part, target = margin if len(margin) == 4 else (np.arange(len(tokens)), margin[0], np.ones(len(tokens)), margin[1])
            total = np.bincount(label, tokens[cell] * factor[cell] * part, len(target))
            change = np.log(np.divide(target, total, out=np.ones(len(target)), where=(total > 0) & (np.asarray(target) > 0)))
            factor = np.minimum(factor * np.exp(np.bincount(cell, part * change[label], len(tokens))), cap)
        factor = _fill(tokens, cap, source, wanted, factor)
        if len(factor) and np.abs(factor - before).max() <= SETTLED * max(factor.max(), SETTLED):
            break
    return factor


def _fill(tokens: np.ndarray, cap: np.ndarray, source: np.ndarray, wanted: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Scale each source to its total; what the cap cuts off goes to the cells below it."""
    count = len(wanted)
    factor = np.maximum(factor, 1e-12)
    free = (np.bincount(source, tokens * cap, count) > wanted)[source]
    while True:
        fixed, moving = np.bincount(source, tokens * cap * ~free, count), np.bincount(source, tokens * factor * free, count)
        ratio = np.divide(wanted - fixed, moving, out=np.zeros(count), where=moving > 0)
        scaled = factor * ratio[source]
        over = free & (scaled > cap)
        if not over.any():
            return np.where(free, scaled, cap)
        free &= ~over


def rake_table(cells: DataFrame, wanted: DataFrame, reach: float, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """The same as `rake` for cells of any number: source, lang, topics, tokens, cap, expected.

    `cells` has source, lang, topics, tokens and cap, `wanted` source and wanted;
    `reach` is the sum of what the sources can reach. Every round is written.
    """
    parts = lambda df: df.select("*", F.explode("topics").alias("topic"), (1.0 / F.size("topics")).alias("part"))
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    scale = reach / max(whole, 1)
    lang_target = cells.groupBy("lang").agg((F.sum("tokens") * scale).alias("target"))
    topic_target = parts(cells).groupBy("topic").agg((F.sum(F.col("tokens") * F.col("part")) * scale).alias("target"))
    targets = {"lang": written(lang_target, "lang"), "topic": written(topic_target, "topic")}
    change = lambda total: F.when((total > 0) & (F.col("target") > 0), F.ln(F.col("target") / total)).otherwise(0.0)
    now = written(cells.withColumn("expected", F.least(F.lit(1.0), "cap")), "cells")
    for _ in range(rounds):
        before = now
        total = now.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("expected")).alias("t")).join(targets["lang"], "lang").select("lang", change(F.col("t")).alias("c"))
        now = now.join(total, "lang").withColumn("expected", F.least(F.col("expected") * F.exp("c"), "cap")).drop("c")
        spread = parts(now)
        total = spread.groupBy("topic").agg(F.sum(F.col("tokens") * F.col("expected") * F.col("part")).alias("t")).join(targets["topic"], "topic").select("topic", change(F.col("t")).alias("c"))
        moved = spread.join(total, "topic").groupBy(*CELL).agg(F.exp(F.sum(F.col("part") * F.col("c"))).alias("c"))
        now = written(now.join(moved, CELL).withColumn("expected", F.least(F.col("expected") * F.col("c"), "cap")).drop("c"), "cells")
        now = _fill_table(now, wanted)
        moves = now.select(*CELL, F.col("expected").alias("new")).join(before.select(*CELL, "expected"), CELL).agg(F.max(F.abs(F.col("new") - F.col("expected"))).alias("d"), F.max("new").alias("m")).first()
        if moves.d is None or moves.d <= settled * max(moves.m, settled):
            break
    return now


def _fill_table(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """`_fill` of a table; each pass takes at least one more cell out of every source that still has one above its cap."""
    room = cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("cap")).alias("room")).join(wanted, "source")
    now = cells.join(room, "source").withColumns({"expected": F.greatest("expected", F.lit(1e-12)), "free": F.col("room") > F.col("wanted")}).drop("room", "wanted")
    while True:
        sums = now.groupBy("source").agg(F.sum(F.when(~F.col("free"), F.col("tokens") * F.col("cap")).otherwise(0.0)).alias("fixed"), F.sum(F.when(F.col("free"), F.col("tokens") * F.col("expected")).otherwise(0.0)).alias("moving"))
        ratio = sums.join(wanted, "source").select("source", F.when(F.col("moving") > 0, (F.col("wanted") - F.col("fixed")) / F.when(F.col("moving") > 0, F.col("moving"))).otherwise(0.0).alias("ratio"))
        scaled = F.col("expected") * F.col("ratio")
        now = written(now.join(ratio, "source").withColumns({"scaled": scaled, "over": F.col("free") & (scaled > F.col("cap"))}).drop("ratio"), "filled")
        if now.where("over").limit(1).count() == 0:
            return now.select(*CELL, "tokens", "cap", F.when(F.col("free"), F.col("scaled")).otherwise(F.col("cap")).alias("expected"))
        now = now.withColumn("free", F.col("free") & ~F.col("over")).drop("scaled", "over")


class Mixture:
    """The plan of a mixture. `sized` has one row per document without its text; `shares` one per source of the targets.

    Defined results: sources are those of `targets` (NULL sources and sources
    without a target are never taken, but count in the total); a NULL weight is
    0, a NULL max_repeats is 1; NULL or empty texts have no tokens; NULL
    language or no tag is a class of its own; NULL and repeated tags don't count;
    the total is the tokens of all rows; a source that can't reach its share is
    taken max_repeats times whole.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, path: str | None = None, most_cells: int = MOST_CELLS) -> None:
        spark = documents.sparkSession
        tags = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("tags", F.array().cast("array<string>")))))
        topics = F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("(none)")))
        told = documents.select("doc_id", "source", F.coalesce("lang", F.lit("(none)")).alias("lang"), topics.alias("topics"), "text")
        # tokens are counted once; the table without texts is small
        self.sized = written(with_tokens(told, path).drop("text"), "sized")
        goals = targets.groupBy("source").agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats")).where("source IS NOT NULL").orderBy("source").limit(100_001).collect()
        if len(goals) > 100_000:
            raise ValueError("more than 100,000 sources")
        self.total = self.sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        self.goals = spark.createDataFrame([(g.source, float(g.weight), int(g.max_repeats), float(g.weight * self.total)) for g in goals], "source string, weight double, max_repeats int, wanted double")
        cells = self.sized.groupBy(*CELL).agg(F.sum("n_tokens").alias("tokens")).join(self.goals, "source")
        cells = written(cells.select(*CELL, "tokens", F.greatest("max_repeats", F.lit(0)).cast("double").alias("cap")), "cells")
        rooms = cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("cap")).alias("room")).join(self.goals, "source")
        reach = rooms.agg(F.sum(F.least("room", "wanted"))).first()[0] or 0.0
        if cells.count() > most_cells:
            self.cells = rake_table(cells, self.goals.select("source", "wanted"), reach)
        else:
            self.cells = spark.createDataFrame(_fitted(cells.collect(), {g.source: float(g.weight * self.total) for g in goals}, reach), "source string, lang string, topics array<string>, tokens bigint, cap double, expected double")

    def chosen(self) -> DataFrame:
        """doc_id, source, copies, n_tokens: every document taken at least once."""
        chance = (F.xxhash64(F.lit("mixture"), "doc_id").bitwiseAND((1 << 52) - 1)) / float(1 << 52)
        held = self.sized.join(self.cells.select(*CELL, "expected"), CELL)
        copies = (F.floor("expected") + (chance < F.col("expected") - F.floor("expected")).cast("int")).cast("int")
        return held.select("doc_id", "source", copies.alias("copies"), "n_tokens").where("copies > 0")

    def shares(self) -> DataFrame:
        """Per source: weight, max_repeats, available and wanted tokens, falls_short, taken tokens, actual_share of what is taken.

        A source falls short if its fitted tokens, with every cell at its cap where needed, don't reach what is wanted."""
        fitted = self.cells.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum(F.col("tokens") * F.col("expected")).alias("fitted"))
        taken = self.chosen().groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("taken"))
        out = self.goals.join(fitted, "source", "left").join(taken, "source", "left")
        out = out.withColumns({"available": F.coalesce("available", F.lit(0)), "fitted": F.coalesce("fitted", F.lit(0.0)), "taken": F.coalesce("taken", F.lit(0))})
        out = out.withColumn("all_taken", F.sum("taken").over(Window.partitionBy()))  # one row a source
        return out.select("source", "weight", "max_repeats", "available", "wanted", (F.col("fitted") < F.col("wanted") * (1 - 1e-9)).alias("falls_short"), "taken", (F.col("taken") / F.col("all_taken")).alias("actual_share"))

    def margins(self) -> DataFrame:
        """margin (source, lang or topic), label, natural_share (of the tokens of listed sources), fitted_share, taken_share (after sampling).

        A document of several topics counts for each by an equal part."""
        held = self.sized.join(self.cells.select(*CELL, "expected"), CELL).join(self.chosen().select("doc_id", "source", "copies"), ["doc_id", "source"], "left")
        held = held.select("source", "lang", "topics", "n_tokens", (F.col("n_tokens") * F.col("expected")).alias("fitted"), (F.col("n_tokens") * F.coalesce("copies", F.lit(0))).alias("taken"))
        one = lambda m, l, p: F.struct(F.lit(m).alias("margin"), l.alias("label"), p.alias("part"))  # noqa: E731, E741
        each = F.concat(F.array(one("source", F.col("source"), F.lit(1.0)), one("lang", F.col("lang"), F.lit(1.0))), F.transform("topics", lambda t: one("topic", t, 1.0 / F.size("topics"))))
        sums = held.select("*", F.inline(each)).groupBy("margin", "label").agg(*(F.sum(F.col(c) * F.col("part")).alias(c) for c in ("n_tokens", "fitted", "taken")))
        share = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy("margin"))  # noqa: E731  # one row a label
        return sums.select("margin", "label", share("n_tokens").alias("natural_share"), share("fitted").alias("fitted_share"), share("taken").alias("taken_share"))


def _fitted(rows: list, wanted: dict[str, float], reach: float) -> list[tuple]:
    """The cells with their factors, fitted as arrays."""
    if not rows:
        return []
    places = {s: k for k, s in enumerate(wanted)}
    tokens, cap = np.array([r.tokens for r in rows], float), np.array([r.cap for r in rows], float)
    source = np.array([places[r.source] for r in rows], int)
    margins = []
    for labels in ([[r.lang] for r in rows], [r.topics for r in rows]):
        cell = np.repeat(np.arange(len(rows)), [len(x) for x in labels])
        part = 1.0 / np.array([len(x) for x in labels], float)[cell]
        _, label = np.unique([v for x in labels for v in x], return_inverse=True)
        natural = np.bincount(label, tokens[cell] * part)
        margins.append((cell, label, part, natural / max(natural.sum(), 1.0) * reach))
    factor = rake(tokens, cap, source, np.array(list(wanted.values())), margins)
    return [(r.source, r.lang, r.topics, r.tokens, r.cap, float(f)) for r, f in zip(rows, factor, strict=True)]
