"""Filling containers of fixed capacity with documents sized in tokens.

Hierarchical multi-length packing. The sizes that go into containers of capacity C are whole numbers from 1 to C, so
the corpus is packed as a histogram of at most C bins, however many documents there are. Every size is routed to the
shortest of several context sizes (C, C/2, C/4, ...) that holds it. From the longest tier to the shortest, what is left
of a tier is packed with items of this tier alone; the gaps of its containers are then filled from the shorter tiers,
the nearest first, one tier after the other. Equal fillings are one *pattern* with a number of copies.

A document finds its container from its rank among the documents of its size. Ranks come from windows over size
classes; a class of more than CLASS_ROWS documents is salted, so none is ordered in one task. Containers are dealt to
step groups from the costliest to the cheapest, forth and back, where the cost of a container is the sum of the squared
lengths of its parts (attention) and full parts of long documents are the costliest: groups differ by one container at
most and hardly in tokens or cost.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirgate.functions.tokens import token_counts
from weirgate.sources.tables import bounded_rows, domain_name, durable

#: Documents of a size class from which on it is salted, containers of a step group, and context sizes of a profile.
CLASS_ROWS, GROUP, TIERS = 100_000, 8, 5
_SHIFT = 1 << 44


@dataclass
class Pattern:
    tier: int
    items: list[tuple[int, int]]  # size, how often
    copies: int
    gap: int

    @property
    def cost(self) -> int:
        return sum(s * s * n for s, n in self.items)


def tiers_of(capacity: int, number: int = TIERS) -> list[int]:
    """The context sizes of a capacity, shortest first: halves of halves, none below 1."""
    return sorted({max(1, capacity >> k) for k in range(number)})


class _Left:
    """Sizes that are not packed yet, in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.count)

    def filling(self, gap: int, above: int, most: int) -> list[tuple[int, int]]:
        """Sizes over ``above`` up to ``most`` that go into a gap together, largest first."""
        items, k = [], bisect_right(self.sizes, min(gap, most))
        while k and gap > above:
            k = min(k, bisect_right(self.sizes, gap))
            if not k or (s := self.sizes[k - 1]) <= above:
                break
            n = min(self.count[s], gap // s)
            # leave the last place of a size open where an exact complement exists
            if n > 1 and gap - n * s not in self.count and (rest := gap - (n - 1) * s) in self.count and rest != s:
                n -= 1
            items.append((s, n))
            gap -= n * s
            k -= 1
        return items

    def take(self, items: list[tuple[int, int]], copies: int) -> None:
        for s, n in items:
            self.count[s] -= n * copies
            if not self.count[s]:
                del self.count[s]
                self.sizes.pop(bisect_left(self.sizes, s))

    def times(self, items: list[tuple[int, int]]) -> int:
        return min(self.count[s] // n for s, n in items)


def pack_histogram(counts: dict[int, int], capacity: int, tiers: list[int]) -> list[Pattern]:
    """Patterns that hold every item of ``counts`` (size: number) in containers of ``capacity``, costliest first.

    Each new pattern uses up a size or the copies of another, so there are at most twice as many patterns as sizes. Ties
    and order do not matter: the result depends on the histogram alone. Sizes must lie between 1 and ``capacity``, which
    is the last of ``tiers``.
    """
    if any(n and not 0 < s <= capacity for s, n in counts.items()):
        raise ValueError("sizes must lie between 1 and the capacity")
    left, done = _Left(counts), []
    levels = list(zip([0, *tiers], tiers))  # sizes of a tier: over the first, up to the second
    for k in range(len(levels) - 1, -1, -1):
        above, tier = levels[k]
        opened = []
        while items := left.filling(capacity, above, tier):
            copies = left.times(items)
            left.take(items, copies)
            opened.append(Pattern(tier, items, copies, capacity - sum(s * n for s, n in items)))
        for low, high in reversed(levels[:k]):
            # wide gaps first: they have the most ways to be filled
            waiting, opened = sorted(opened, key=lambda p: (p.gap, p.items)), []
            while waiting:
                p = waiting.pop()
                more = left.filling(p.gap, low, high)
                if not more:
                    opened.append(p)
                    continue
                n = min(p.copies, left.times(more))
                left.take(more, n)
                opened.append(Pattern(tier, p.items + more, n, p.gap - sum(a * b for a, b in more)))
                if n < p.copies:
                    waiting.append(Pattern(tier, p.items, p.copies - n, p.gap))
        done += opened
    return sorted(done, key=lambda p: (-p.cost, p.items))


def step_group(place, groups):
    """The group of the container at a place of the order by cost: dealt forth and back."""
    turn, at = place // groups, place % groups
    return np.where(turn % 2 == 0, at, groups - 1 - at)


def sized_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, domain, n_tokens. A null or empty text has 0 tokens."""
    return docs.where("doc_id is not null").select("doc_id", domain_name(F.col("domain")).alias("domain"), token_counts(F.col("text"), vocabulary).alias("n_tokens"))


def salted(sized: DataFrame, most: int = CLASS_ROWS) -> DataFrame:
    """``sized`` with a salt that cuts each class (kind, n_tokens) of more than ``most`` documents into parts of about that many.

    The classes that need salts number at most documents / ``most``, so their table is small by its own definition.
    """
    big = sized.groupBy("kind", "n_tokens").agg(F.count("*").alias("n")).where(F.col("n") > most)
    big = big.select("kind", "n_tokens", F.ceil(F.col("n") / most).alias("salts"))
    return sized.join(F.broadcast(big), ["kind", "n_tokens"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")


def pack(docs: DataFrame, profiles: DataFrame, vocabulary: str) -> DataFrame:
    """Every document in a container of every profile that takes its domain.

    ``docs``: doc_id, text, domain; ``profiles``: profile_id, capacity, domain (null: all), at most 64 rows. One row
    per document part: ``profile_id, container_id, tier, step_group, doc_id, part, part_tokens``. A document larger
    than the capacity is cut: full parts are containers of their own, the rest is packed like an item. A text without
    tokens is part 0 with 0 tokens of some container, whichever its id falls to. Repeated doc_ids are packed as often as
    they occur; no documents give no rows. Documents without an id are left out; other columns are ignored. Capacities
    below 1, null capacities and null profile_ids are errors.
    """
    plans = [(r.profile_id, r.capacity, r.domain) for r in bounded_rows(profiles.select("profile_id", "capacity", domain_name(F.col("domain")).alias("domain")), 64)]
    if any(p is None or not c or c < 1 for p, c, _ in plans):
        raise ValueError("a profile needs an id and a capacity of at least 1")
    own = sorted({d for _, _, d in plans if d != "unknown"})
    sized = durable(sized_documents(docs, vocabulary).select("doc_id", "n_tokens", F.when(F.col("domain").isin(own), F.col("domain")).otherwise("").alias("kind")))
    parted = salted(sized)
    classes = ["kind", "n_tokens", "salt"]
    capacities = F.array(*[F.struct(F.lit(p).alias("profile_id"), F.lit(c).alias("capacity"), F.lit(d).alias("takes")) for p, c, d in plans])
    spread = lambda df: df.withColumn("p", F.explode(capacities)).select(*df.columns, "p.*").where((F.col("takes") == "unknown") | (F.col("takes") == F.col("kind"))).drop("takes").withColumn("size", F.when(F.col("n_tokens") <= F.col("capacity"), F.col("n_tokens")).otherwise(F.col("n_tokens") % F.col("capacity")))

    full = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("int")
    counted = spread(durable(parted.groupBy(*classes).agg(F.count("*").alias("n")))).withColumn("full", full).where("size > 0 or full > 0")
    earlier = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy("profile_id", *keys).orderBy(*classes).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # rank among the documents of a size, and among those of as many full parts (short documents have none to rank)
    starts = counted.select("profile_id", "size", *classes, earlier("size").alias("start"), earlier("full", F.when(F.col("full") == 0, F.col("size"))).alias("full_start"))
    histogram: dict[int, dict[int, int]] = {p: {} for p, _, _ in plans}
    fulls: dict[int, dict[int, int]] = {p: {} for p, _, _ in plans}
    # at most the sum of the capacities, and the longest document by each capacity
    for r in counted.groupBy("profile_id", "size").agg(F.sum("n").alias("n")).where("size > 0").collect():
        histogram[r.profile_id][r.size] = r.n
    for r in counted.where("full > 0").groupBy("profile_id", "full").agg(F.sum("n").alias("n")).collect():
        fulls[r.profile_id][r.full] = r.n

    found = {}
    for p, c, _ in plans:
        used: dict[int, int] = {}
        key, per, base, tier, level = [], [], [], [], []
        at = 0
        for x in pack_histogram(histogram[p], c, tiers_of(c)):
            for s, n in x.items:
                key.append(s * _SHIFT + used.get(s, 0))
                used[s] = used.get(s, 0) + n * x.copies
                per.append(n), base.append(at), tier.append(x.tier)
            level += [(at, x.tier)]
            at += x.copies
        order = np.argsort(np.array(key, dtype=np.int64), kind="stable")
        long, first = sorted(fulls[p]), [0]
        for k in long:
            first.append(first[-1] + k * fulls[p][k])
        found[p] = {
            **{n: np.array(a, dtype=np.int64)[order] for n, a in (("key", key), ("per", per), ("base", base), ("tier", tier))},
            "boxes": at, "level_at": np.array([b for b, _ in level] or [0]), "level": np.array([t for _, t in level] or [c]),
            "long": np.array(long, dtype=np.int64), "first": np.array(first, dtype=np.int64), "groups": max(1, -(-(first[-1] + at) // GROUP)),
        }
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def place(batches):
        for pdf in batches:
            out = []
            for p, g in pdf.groupby("profile_id", sort=False):
                f = shared.value[int(p)]
                size, rank = g["size"].to_numpy(np.int64), g["rank"].to_numpy(np.int64) + g["start"].fillna(0).to_numpy(np.int64)
                full, turn = g["full"].to_numpy(np.int64), np.zeros(len(g), np.int64)
                box = g["any_box"].to_numpy(np.int64) % max(1, f["boxes"])  # texts without tokens
                if (some := size > 0).any():
                    at = size[some] * _SHIFT + rank[some]
                    i = np.searchsorted(f["key"], at, side="right") - 1
                    box[some] = f["base"][i] + (at - f["key"][i]) // f["per"][i]
                tier = f["level"][np.searchsorted(f["level_at"], box, side="right") - 1]
                if (cut := full > 0).any():
                    turn[cut] = f["first"][np.searchsorted(f["long"], full[cut])] + (g["rank"].to_numpy(np.int64) + g["full_start"].fillna(0).to_numpy(np.int64))[cut] * full[cut]
                out.append(pd.DataFrame({"profile_id": g["profile_id"], "capacity": g["capacity"], "doc_id": g["doc_id"], "n_tokens": g["n_tokens"], "size": size, "full": full, "box": box, "turn": turn, "tier": tier, "groups": f["groups"], "after": f["first"][-1]}))
            if out:
                yield pd.concat(out)

    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy(*classes).orderBy("doc_id")) - 1)
    placed = spread(ranked).withColumn("full", full).withColumn("any_box", F.pmod(F.xxhash64("doc_id"), F.lit(_SHIFT)))
    placed = placed.join(starts, ["profile_id", "size", *classes], "left").select("profile_id", "capacity", "doc_id", "n_tokens", "size", "full", "rank", "start", "full_start", "any_box")
    placed = placed.mapInPandas(place, "profile_id int, capacity int, doc_id long, n_tokens int, size int, full int, box long, turn long, tier int, groups long, after long")
    parts = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.when((F.col("size") > 0) | (F.col("n_tokens") == 0), F.col("full")).otherwise(F.col("full") - 1))))
    whole = F.col("part") < F.col("full")
    # full parts are the costliest containers and come first, the others follow in the order of their patterns
    place_ = F.when(whole, F.col("turn") + F.col("part")).otherwise(F.col("after") + F.col("box"))
    turn, at = F.floor(place_ / F.col("groups")), F.pmod(place_, F.col("groups"))
    return parts.select(
        "profile_id",
        F.when(whole, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), F.col("part").cast("string"))).otherwise(F.concat(F.lit("b"), F.col("box").cast("string"))).alias("container_id"),
        F.when(whole, F.col("capacity")).otherwise(F.col("tier")).alias("tier"),
        F.when(turn % 2 == 0, at).otherwise(F.col("groups") - 1 - at).alias("step_group"),
        "doc_id",
        "part",
        F.when(whole, F.col("capacity")).otherwise(F.col("size")).alias("part_tokens"),
    )


def _boxes(packed: DataFrame) -> DataFrame:
    """One row a container. Containers of a document that stands twice under one id have one name: they count by what they hold."""
    whole = F.col("container_id").startswith("d")
    boxes = packed.where(~whole).groupBy("profile_id", "container_id", "tier", "step_group").agg(F.sum("part_tokens").cast("long").alias("tokens"), F.sum(F.col("part_tokens").cast("long") * F.col("part_tokens")).alias("cost"))
    alone = packed.where(whole).select("profile_id", "container_id", "tier", "step_group", F.col("part_tokens").cast("long").alias("tokens"), (F.col("part_tokens").cast("long") * F.col("part_tokens")).alias("cost"))
    return boxes.unionByName(alone)


def fill_rates(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile and tier: containers, tokens, and the share of room that is filled; the tier null stands for all."""
    # profiles are 64 rows at most (``pack``)
    sums = _boxes(packed).groupBy("profile_id", "tier").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    every = sums.groupBy("profile_id").agg(F.lit(None).cast("int").alias("tier"), F.sum("containers").alias("containers"), F.sum("tokens").alias("tokens"))
    return sums.unionByName(every).join(F.broadcast(profiles.select("profile_id", "capacity")), "profile_id").select("profile_id", "tier", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"))


def balance(packed: DataFrame) -> DataFrame:
    """Per profile: step groups, and the most of a group against the mean in containers, tokens and cost (squared lengths)."""
    groups = _boxes(packed).groupBy("profile_id", "step_group").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return groups.groupBy("profile_id").agg(F.count("*").alias("groups"), *[F.round(F.max(c) / F.avg(c), 3).alias(f"most_{c}") for c in ("containers", "tokens", "cost")])
