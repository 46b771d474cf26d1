"""Filter interaction audit: what each filter removes in every order of the filters.

1. Spark evaluates every filter on every row and counts the rows of each failure mask per part,
   with tallies (such as rows labelled good); a part has 2**filters masks at most.
2. The masks of a part become a decision diagram: one level per filter, a pass and a fail child per
   node, equal sub-diagrams shared, and on each node the counts of all masks below it.
3. Swapping two adjacent levels rewrites the nodes of these two levels only.  All orders are visited
   by adjacent swaps (plain changes), so no diagram is built twice.
4. In each order the path on which all filters pass gives the steps: the fail child's counts are
   removed at that step, the pass child's are kept.

Only masks and counts meet in one task: 2**filters rows per part, whatever the table's size.

Edge cases: null texts are empty; a null part is the empty part; rows without an id are nobody's
copy and nobody is theirs; rows of one id with equal texts aren't copies of a smaller id; several
label rows of an id count once (the larger value); repeated rows are counted each; an empty table
has no part and gives no row; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


class Diagram:
    """Ordered decision diagram over failure masks; every path crosses every level."""

    def __init__(self, size: int, counts: dict[int, tuple[int, ...]], width: int):
        self.order = list(range(size))
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[tuple[int, ...]] = []
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(size)]
        self.leaves: dict[tuple[int, ...], int] = {}
        self.none = (0,) * width
        self.root = self._build(0, counts)

    def _leaf(self, value: tuple[int, ...]) -> int:
        if value not in self.leaves:
            self.leaves[value] = self._new(-1, -1, value)
        return self.leaves[value]

    def _new(self, low: int, high: int, weight: tuple[int, ...]) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.low) - 1

    def _node(self, level: int, low: int, high: int) -> int:
        """The node of this level with these children; there is one of each."""
        found = self.levels[level].get((low, high))
        if found is None:
            weight = tuple(a + b for a, b in zip(self.weight[low], self.weight[high], strict=True))
            found = self.levels[level][low, high] = self._new(low, high, weight)
        return found

    def _build(self, level: int, counts: dict[int, tuple[int, ...]]) -> int:
        if level == len(self.order):
            return self._leaf(next(iter(counts.values()), self.none))
        bit = 1 << self.order[level]
        return self._node(
            level,
            self._build(level + 1, {m: c for m, c in counts.items() if not m & bit}),
            self._build(level + 1, {m: c for m, c in counts.items() if m & bit}),
        )

    def swap(self, level: int) -> None:
        """Exchange this level's filter with the next one's.  A node of the upper level keeps its place
        and its counts (its masks stay the same); the lower level is made anew."""
        upper, self.levels[level], self.levels[level + 1] = self.levels[level], {}, {}
        for (low, high), node in upper.items():
            self.low[node] = self._node(level + 1, self.low[low], self.low[high])
            self.high[node] = self._node(level + 1, self.high[low], self.high[high])
            self.levels[level][self.low[node], self.high[node]] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) along the path on which every filter passes."""
        node = self.root
        for f in self.order:
            yield f, self.weight[self.low[node]], self.weight[self.high[node]]
            node = self.low[node]


def plain_changes(n: int) -> Iterator[int]:
    """Places k whose swaps of k and k + 1 lead through all orders of n things, each once."""
    at, step = list(range(n)), [-1] * n  # the place of each thing; the way it moves
    while True:
        for thing in reversed(range(n)):
            to = at[thing] + step[thing]
            if 0 <= to < n and (other := at.index(to)) < thing:
                break
        else:
            return
        yield min(at[thing], to)
        at[thing], at[other] = to, at[thing]
        for larger in range(thing + 1, n):
            step[larger] = -step[larger]


def _orders(names: Sequence[str], tallies: Sequence[str]):
    def run(key: tuple, masks: pd.DataFrame) -> pd.DataFrame:
        counts = {int(r[0]): tuple(map(int, r[1:])) for r in masks[["mask", *tallies]].itertuples(index=False)}
        diagram = Diagram(len(names), counts, len(tallies))
        rows = []
        swaps = plain_changes(len(names))
        while True:
            order = "".join(names[f] for f in diagram.order)
            rows += [(key[0], order, k, f, kept[0], *removed) for k, (f, kept, removed) in enumerate(diagram.steps(), 1)]
            if (level := next(swaps, None)) is None:
                break
            diagram.swap(level)
        out = pd.DataFrame(rows, columns=["part", "filter_order", "step", "f", "kept", "removed", *[f"{t}_lost" for t in tallies[1:]]])
        # a filter that comes first removes all that fail it, one that comes last those that fail nothing else
        fails = out[out.step == 1].drop_duplicates("f").set_index("f").removed
        alone = out[out.step == len(names)].drop_duplicates("f").set_index("f").removed
        out["redundant"] = out.f.map(fails) - out.removed
        out["unique_fails"] = out.f.map(alone)
        out["shapley"] = out.f.map(out.groupby("f").removed.sum())
        return out.drop(columns="f")

    return run


def interactions(rows: DataFrame, part: Column, fails: dict[str, Column], tallies: dict[str, Column]) -> DataFrame:
    """Per part, order of the filters (named by one letter each in ``fails``) and step: kept, removed,
    redundant, unique_fails, <tally>_lost for each of ``tallies`` (conditions), shapley.  A condition that
    is null counts as not met."""
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(fails.values())), F.lit(0))
    met = [F.count(F.when(c, 1)).alias(t) for t, c in tallies.items()]
    masks = rows.groupBy(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *met)
    lost = "".join(f", {t}_lost bigint" for t in tallies)
    schema = f"part string, filter_order string, step int, kept bigint, removed bigint{lost}, redundant bigint, unique_fails bigint, shapley bigint"
    return masks.groupBy("part").applyInPandas(_orders(list(fails), ["n", *tallies]), schema)


def quality_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per row: id, part and whether it fails filter A (few words), B (few distinct words), C (many capitals),
    D (symbols) or E (a copy of a row with a smaller id)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(part_col).cast("string").alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    flags = rows.select(
        "id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.size("words") < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("B"),
        (100 * capitals > 3 * F.length("text")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    flags = written(flags, "filter-flags")
    ids = flags.groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    copied = written(ids.filter("first_id < last_id").select("digest", "first_id"), "copied-texts")
    return flags.join(copied, "digest", "left").select("id", "part", "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)).alias("E"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id"))
    labels = written(labels.agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "label-values")
    rows = quality_flags(table(spark, sf_dir, "documents")).join(labels, "id", "left")
    return interactions(
        rows, F.col("part"), {f: F.col(f) for f in "ABCDE"}, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    )


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
labelled AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, quality, toxic,
         len(w) < 200 AS fa,
         100 * len(list_distinct(w)) < 50 * len(w) AS fb,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS fc,
         regexp_matches(text, '[#$%&*|]') AS fd,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS fe
  FROM words LEFT JOIN labelled USING (doc_id)),
masks AS (
  SELECT part, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS mask, count(*) AS n,
         count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM flags GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
   AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, s::INT AS step, bits[s] AS own,
         CASE s WHEN 1 THEN 0 WHEN 2 THEN bits[1] WHEN 3 THEN bits[1] + bits[2]
                WHEN 4 THEN bits[1] + bits[2] + bits[3] ELSE 31 - bits[5] END AS earlier
  FROM orders, range(1, 6) r(s)),
counted AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (mask & (earlier | own) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
