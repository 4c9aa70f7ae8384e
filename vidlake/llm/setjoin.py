"""Components of an exact set-similarity join over candidate columns.

Sets that share a column (a prefix n-gram, a MinHash band) may be linked. The
incidence of sets and columns is multiplied column by column, never expanded to
all pairs of a group: every column picks a few pivots, all its members are checked
against these, and what a pivot links becomes one component. A pivot then leaves its
column, where all its pairs are decided, and so does a member that is left alone. Members that are
still in different components then meet on prefix elements alone, the rarest ones
of each set, so no link between components is lost. Overlaps are added up over blocks
of columns, and a pair is discarded once it cannot reach the bound.

Every grouping by a column is written before it is joined, so that adaptive
execution can split the join of a hot column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vidlake.llm.graph import connected_components
from vidlake.llm.storage import drop, save

#: Two sets of sizes x <= y can only reach NUM / DEN when DEN * x >= NUM * y.
NUM, DEN = 80, 100
#: Pivots a column in each round.
PIVOTS = (2, 4)
#: Rarest elements of a set that pairs are first compared by.
HEAD = 32


def needed(x: Column, y: Column) -> Column:
    """Elements that sets of these sizes must share to reach the similarity."""
    return F.ceil((x + y) * NUM / (NUM + DEN))


def may_link(x: str, y: str) -> Column:
    """Whether two members can reach the similarity.

    By their sizes n; and, where prefixes are columns, by the place r of the shared
    element in each: of two sets that share enough, the first common element is among
    the first n - needed + 1 of both. And by m: what is left of a set without the prefix
    elements that no other prefix has. Of two sets, the one whose prefix ends first
    (last) has these elements to itself, but for the one at the end; of two that end
    together, both do.
    """
    nx, ny, mx, my, ex, ey, rx, ry = (F.col(f"{side}.{name}") for name in ("n", "m", "last", "r") for side in (x, y))
    least = needed(nx, ny)
    most = F.when(ex < ey, mx + 1).when(ex > ey, my + 1).otherwise(F.least(mx, my) + 1)
    return (F.least(nx, ny) * DEN >= F.greatest(nx, ny) * NUM) & (rx + least <= nx + 1) & (ry + least <= ny + 1) & (most >= least)


def verified(pairs: DataFrame, sets: DataFrame, blocks: int) -> DataFrame:
    """pairs (a, b, ca, cb) of which DEN * |A & B| >= NUM * |A | B|; ca and cb, their components, are carried.

    sets: (id, n, after, p0, p1, ...), the elements by block of columns and how many
    lie in later blocks. The overlap is added up block by block; a pair goes on only
    while it and the rest of the smaller set can come to what is needed.
    """
    out = pairs.withColumn("shared", F.lit(0))
    for k in range(blocks):
        side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.get("after", k).alias(f"more{x}"), F.col(f"p{k}").alias(f"p{x}")).hint("merge")  # noqa: B023, E731
        both = out.join(side("a"), "a").join(side("b"), "b")
        shared = F.col("shared") + F.size(F.array_intersect("pa", "pb"))
        # a generator, so that the overlap is computed once for the bound and the sum
        reach = F.filter(F.array(shared), lambda s: s + F.least("morea", "moreb") >= needed(F.col("na"), F.col("nb")))
        out = both.select("a", "b", "ca", "cb", F.explode(reach).alias("shared"))
    return out.drop("shared")


def _pair(x: str, y: str) -> list[Column]:
    """a and b, the smaller id first, and likewise their components ca and cb."""
    return [f(f"{x}.{c}", f"{y}.{c}").alias(n) for n, f, c in (("a", F.least, "id"), ("b", F.greatest, "id"), ("ca", F.least, "component"), ("cb", F.greatest, "component"))]


def _pivots(members: DataFrame, count: int, salt: int) -> DataFrame:
    """(h, pivots, k) for `count` of the k members of a column, k - 1 at most: the most overlapped one first in round 0, the rest by hash."""
    who = F.struct("id", "n", "m", "last", "r", "component")
    picks = [F.max_by(who, F.struct("score", "id") if salt + k == 0 else F.xxhash64("id", F.lit(salt * 64 + k))) for k in range(count)]
    # the last hash's other end, so that two picks differ wherever there are two
    picks.append(F.min_by(who, F.xxhash64("id", F.lit(salt * 64 + count - 1))))
    picked = members.groupBy("h").agg(F.array_distinct(F.array(*picks)).alias("pivots"), F.count(F.lit(1)).alias("k"))
    return save(picked.withColumn("pivots", F.slice("pivots", F.lit(1), F.least(F.lit(count), F.col("k").cast("int") - 1))), "pivots")


def _undecided(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Members less the pivots of their column, of the columns that have two or more besides; the other pairs of a column have all been looked at."""
    left = chosen.where(F.col("k") > F.size("pivots") + 1).select("h", F.transform("pivots", lambda p: p["id"]).alias("gone"))
    return members.join(left.hint("merge"), "h").where(~F.array_contains("gone", F.col("id"))).drop("gone")


def _open_columns(members: DataFrame) -> DataFrame:
    """Members of the columns that hold more than one component."""
    mixed = save(members.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h"), "mixed")
    out = save(members.join(mixed.hint("merge"), "h", "left_semi"), "members")
    drop(mixed)
    return out


def _relabel(members: DataFrame, hits: DataFrame) -> DataFrame:
    """members with their components joined where hits link them; chains only so far as two passes go."""
    joined = connected_components(hits.select(F.col("ca").alias("a"), F.col("cb").alias("b")), passes=2)
    now = joined.select(F.col("id").alias("component"), F.col("component").alias("now"))
    out = save(members.join(now.hint("merge"), "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now"), "members")
    drop(joined)
    return out


def _by_heads() -> Column:
    """Whether x and y can reach the similarity by the rarest elements of both, and h is the first that they share.

    Up to the smaller of the two heads' ends all that they share is known; beyond it
    no more than what is left of either.
    """
    hx, hy = F.col("x.head"), F.col("y.head")
    end = F.least(F.element_at(hx, -1), F.element_at(hy, -1))
    within = lambda a: F.size(F.filter(a, lambda e: e <= end))
    both = F.array_intersect(hx, hy)
    first = F.coalesce(F.get(both, 0) == F.col("x.rank"), F.lit(True))
    return first & (within(both) + F.least(F.col("x.n") - within(hx), F.col("y.n") - within(hy)) >= needed(F.col("x.n"), F.col("y.n")))


def _prefix_columns(open_ids: DataFrame, sets: DataFrame, blocks: int) -> DataFrame:
    """(h, id, r, n, m, last, component, rank, head): the prefixes of the open sets in order of their elements' rarity among them; head: the ranks of the first HEAD."""
    whole = F.concat(*[F.col(f"p{k}") for k in range(blocks)])
    elements = save(sets.select("id", "n", whole.alias("all")).join(open_ids.hint("merge"), "id").select("id", "n", "component", F.explode("all").alias("h")), "elements")
    counts = save(elements.groupBy("h").agg(F.count(F.lit(1)).alias("c")), "counts")
    # one number to sort by: the count, as far as it matters, and then the element
    rank = F.shiftleft(F.least(F.col("c"), F.lit(32767)), 48).bitwiseOR(F.col("h").bitwiseAND(F.lit((1 << 48) - 1)))
    ranked = elements.join(counts.hint("merge"), "h").groupBy("id").agg(
        F.first("n").alias("n"), F.first("component").alias("component"), F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "c", "h"))).alias("all"), F.count_if(F.col("c") > 1).alias("m")
    )
    least = F.ceil(F.col("n") * NUM / DEN)
    # elements that no other open set has link with nothing: m are left
    ranked = ranked.where(F.col("m") >= least).withColumn("head", F.transform(F.slice("all", 1, HEAD), lambda e: e["rank"]))
    placed = ranked.select("id", "n", "m", "component", "head", F.posexplode(F.slice("all", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("r", "e")).where("e.c > 1")
    # one off, as may_link allows for an element at the end
    out = save(placed.select(F.col("e.h").alias("h"), "id", (F.col("r") + 1).alias("r"), "n", (F.col("m") - 1).alias("m"), F.lit(0).cast("long").alias("last"), "component", "e.rank", "head"), "prefixes")
    drop(elements)
    drop(counts)
    return out


def link_components(members: DataFrame, sets: DataFrame, prefixes: bool, blocks: int = 1) -> DataFrame:
    """(id, component) of the sets that some link joins; component: the smallest id.

    members: distinct (h, id, r) of the columns that two or more sets have (r: place of
    the element in its set, or 0); sets: (id, n, last, after, p0, ...) as verified takes
    them, or (id, n, last, shingles), one row for every id of members. A column of k members costs as many
    checks a round as it has pivots times k. Of columns that decide (prefixes), pivots are
    out after their round, so a column of up to three members is done with after the first;
    bands keep theirs, as sets of open bands are compared whole. Sets that are then still in different
    components of a column are compared by prefix elements: of two linked sets, the
    first element in common is among the first n - ceil(8/9 n) + 1 of the smaller one and
    the first n - ceil(0.8 n) + 1 of the larger. prefixes: columns are already
    these elements in an order of all elements, and last is the place of the last of
    them.
    """
    if "shingles" in sets.columns:
        sets = sets.select("id", "n", "last", F.array(F.lit(0)).alias("after"), F.col("shingles").alias("p0"))
    sizes = sets.select("id", "n", "last")
    weight = save(members.groupBy("h").agg(F.log2(F.count(F.lit(1)).cast("double")).alias("weight")), "weight")
    weighted = members.join(weight.hint("merge"), "h").groupBy("id").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("shared"))
    weighted = weighted.join(sizes.hint("merge"), "id")
    matchable = F.ceil(F.col("n") * NUM / DEN) - 1 + F.col("shared") if prefixes else F.col("n")
    weighted = save(weighted.withColumn("m", matchable), "weighted")
    work = save(members.join(weighted.hint("merge"), "id").withColumn("component", F.col("id")).select("h", "id", "r", "n", "m", "last", "score", "component"), "members")
    drop(weight)
    drop(weighted)
    found, checked, done = [], None, []

    def by_pivots(work: DataFrame, count: int, turn: int, decides: bool) -> tuple[DataFrame, bool]:
        """What is open after all members are checked against `count` pivots a column; whether any joined."""
        nonlocal checked
        chosen = _pivots(work, count, turn)
        pairs = (
            work.alias("x").join(chosen.select("h", F.explode("pivots").alias("pivot")).hint("merge"), "h")
            .where((F.col("pivot.component") != F.col("x.component")) & may_link("x", "pivot"))
            .select(*_pair("x", "pivot"))
            .groupBy("a", "b")
            .agg(F.first("ca").alias("ca"), F.first("cb").alias("cb"))
        )
        pairs = save(pairs if checked is None else pairs.join(checked.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        done.append(pairs)
        hits = save(verified(pairs, sets, blocks), "hits")
        checked = pairs.select("a", "b") if checked is None else checked.unionByName(pairs.select("a", "b"))
        joined = not hits.isEmpty()
        if joined:
            found.append(hits)
        elif not decides:
            drop(chosen)
            return work, False
        rest = _undecided(work, chosen) if decides else work
        moved = _relabel(rest, hits) if joined else save(rest, "members")
        drop(work)
        drop(chosen)
        left = _open_columns(moved)
        drop(moved)
        return left, joined

    for turn, count in enumerate(PIVOTS):
        work, moved = by_pivots(work, count, turn, prefixes)
        if not moved or work.isEmpty():
            break
    if not prefixes and not work.isEmpty():
        open_ids = save(work.select("id", "component").distinct(), "open")
        drop(work)
        work = _prefix_columns(open_ids, sets, blocks)
        drop(open_ids)
        work, _ = by_pivots(work, PIVOTS[-1], len(PIVOTS), True)
    if not work.isEmpty():
        short = work.where(F.col("r") + needed(F.col("n"), F.col("n")) <= F.col("n") + 1)
        x, y = short.alias("x"), work.alias("y")
        smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
        near = (F.col("x.h") == F.col("y.h")) & smaller & (F.col("x.component") != F.col("y.component")) & may_link("x", "y")
        rest = (
            x.join(y.hint("merge"), near if prefixes else near & _by_heads())
            .select(*_pair("x", "y"))
            .distinct()
            .join(checked.hint("merge"), ["a", "b"], "left_anti")
        )
        rest = save(rest, "rest")
        done.append(rest)
        found.append(save(verified(rest, sets, blocks), "hits"))
    every = members.sparkSession.createDataFrame([], "a long, b long")
    for hits in found:
        every = every.unionByName(hits.select("a", "b"))
    out = connected_components(every)
    for t in (work, *found, *done):
        drop(t)
    return out
