"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; each pattern
offers its tokens once, twice and three times at rising (convex) cost, and routes them to the
quotas of its sources. All patterns, also those of one source, go through the flow, which is solved
by the primal-dual method: cost by cost, as large a flow as the paths of that cost allow. Patterns
that share no source, not even by way of others, are networks of their own: so many patterns that
they shouldn't be on the driver at once are solved component by component in the tasks. Then
documents are selected by a seeded hash: all of them for every whole copy, and those whose hash is
lowest for the rest.
"""

from __future__ import annotations

from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, connected_components

WEIGHTS = (5.0, 2.0, 1.0)
COPIES = 3
SEED = 11
#: Bound on the patterns that are solved on the driver; more are solved component by component in the tasks.
MAX_PATTERNS = 100_000
#: The hash is read in two digits of BITS bits.
BITS = 12
#: Names of columns that are added in passing; no table is expected to have them.
KEYED, PLANNED, PATTERN, DRAWN = ("__mix_flow_" + x for x in ("keyed", "planned", "pattern", "drawn"))


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, copies: int = COPIES) -> dict[str | None, float]:
    """Each source's share, by weight, of all sizes.

    Sources in code point order, null last, take the weights in turn. No target exceeds copies
    times its source's size; the excess goes to the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    whole = sum(n for _, n in order)
    level, open_ = 0.0, None
    while True:
        full, caps = [0] * len(weights), 0
        for i, (_, n) in enumerate(order):
            if weights[i % len(weights)] * level > copies * n:
                full[i % len(weights)] += 1
                caps += copies * n
        free = [len(range(k, len(order), len(weights))) - n for k, n in enumerate(full)]
        if not sum(free) or sum(free) == open_:
            break
        level, open_ = water_level(whole - caps, free, weights), sum(free)
    return {s: min(weights[i % len(weights)] * level, float(copies * n)) for i, (s, n) in enumerate(order)}


def water_level(rest: int, free: list[int], weights: tuple[float, ...]) -> float:
    """The tokens for a weight of one if rest is shared out to free[k] sources of each weight."""
    return rest / sum(n * w for n, w in zip(free, weights, strict=True))


def route(patterns: dict[tuple, int], quota: dict, copies: int = COPIES) -> dict[tuple, dict]:
    """Min-cost flow from patterns (tuples of different sources, no two of the same ones, with their tokens) to quotas.

    The c-th copy of a token costs c. Returns the tokens that each pattern gives to each source.
    Patterns that share no source, not even by way of others, are solved apart, and each network in
    the order of its sources; so the flow is the same in whatever order, and with whatever other
    networks, its patterns come.
    """
    place = {s: i for i, s in enumerate(sorted({s for p in patterns for s in p}, key=lambda s: (s is None, 0 if s is None else s)))}
    own = {p: sorted(p, key=place.__getitem__) for p in patterns}
    parent = list(range(len(place)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for p in own.values():
        for s in p:
            parent[root(place[s])] = root(place[p[0]])
    networks: dict[int, list[tuple]] = {}
    for p in sorted(patterns, key=lambda p: [place[s] for s in own[p]]):
        if p:
            networks.setdefault(root(place[own[p][0]]), []).append(p)
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    for names in networks.values():
        flow |= network(names, own, patterns, quota, copies)
    return flow


def network(names: list[tuple], own: dict[tuple, list], size: dict[tuple, int], quota: dict, copies: int) -> dict[tuple, dict]:
    """route() for the connected patterns names, of the sources own[p] and the tokens size[p] each.

    Only the arcs into patterns cost anything, and each copy more than the one before; so the
    shortest paths of cost c are those over the c-th copies and free arcs, and the flow is the
    least costly if each cost in turn gets a largest flow (by layers and blocking flows).
    """
    sources = list(dict.fromkeys(s for p in names for s in own[p]))
    node = {("p", p): i for i, p in enumerate(names)} | {("s", s): len(names) + i for i, s in enumerate(sources)}
    #: arcs[i] are a node's (number of the arc, other end); arc e ^ 1 leads back.
    arcs: list[list[tuple[int, int]]] = [[] for _ in node]
    room: list[float] = []
    at: dict[tuple, int] = {}
    for p in names:
        for s in own[p]:
            a, b = node["p", p], node["s", s]
            at[p, s] = len(room)
            arcs[a].append((len(room), b))
            arcs[b].append((len(room) + 1, a))
            room += [inf, 0.0]
    left = [float(quota.get(s, 0.0)) for s in sources]
    small = 1e-9 * max([1.0, *left])
    first = len(names)
    for _ in range(copies):
        offer = [float(size[p]) for p in names]
        while True:
            # Layers from the patterns that still have something of this copy to the sources with quota left.
            layer = [-1] * len(node)
            front = [i for i, x in enumerate(offer) if x > small]
            for i in front:
                layer[i] = 0
            ends = False
            while front and not ends:
                after = []
                for i in front:
                    for e, j in arcs[i]:
                        if layer[j] < 0 and room[e] > small:
                            layer[j] = layer[i] + 1
                            after.append(j)
                            ends = ends or (j >= first and left[j - first] > small)
                front = after
            if not ends:
                break
            begin = [0] * len(node)
            for start, x in enumerate(offer):
                while offer[start] > small:
                    path, i = [], start
                    while i < first or left[i - first] <= small:
                        while begin[i] < len(arcs[i]):
                            e, j = arcs[i][begin[i]]
                            if layer[j] == layer[i] + 1 and room[e] > small:
                                break
                            begin[i] += 1
                        else:
                            if not path:
                                break
                            i = path.pop()[0]  # a dead end: its arc is passed over from now on
                            begin[i] += 1
                            continue
                        path.append((i, e))
                        i = j
                    if not path:
                        break
                    step = min(offer[start], left[i - first], *(room[e] for _, e in path))
                    offer[start] -= step
                    left[i - first] -= step
                    for _, e in path:
                        room[e] -= step
                        room[e ^ 1] += step
    flow: dict[tuple, dict] = {p: {} for p in names}
    for (p, s), e in at.items():
        flow[p][s] = room[e ^ 1]
    return flow


def size_of(text: str = "text") -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, sources: Column | None, seed: int) -> DataFrame:
    """docs with a struct KEYED: pattern, the sorted distinct sources; size; h, the seeded hash of the id
    (or, for a null id, of the text), and h1 and h2, its first two digits."""
    none = F.array(F.lit(None).cast("string"))
    own = F.array(F.col("source").cast("string")) if sources is None else F.array_sort(F.array_distinct(F.when(F.size(sources) > 0, sources).otherwise(none)))
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    digit = lambda i: F.shiftrightunsigned(h, 64 - BITS * i).bitwiseAND((1 << BITS) - 1).cast("int")
    return docs.withColumn(KEYED, F.struct(own.alias("pattern"), size_of().alias("size"), digit(1).alias("h1"), digit(2).alias("h2"), h.alias("h")))


def cuts(rows: DataFrame, wanted: DataFrame, few) -> DataFrame:
    """For each pattern of wanted(pattern, rest) the documents that are taken once more, so that they
    have about rest tokens: those with a hash below the digits (c1, c2), and one more, the filler h.

    Tokens are summed by pattern and first digit (pre-aggregated, 2^BITS rows a pattern at most),
    then, inside the digit where the running sum passes rest, by the second one; the cut is where
    the second sum is last below rest. The filler is the document above the cut whose size is
    nearest to what is left, if it comes nearer to rest. few() marks tables of a row for each pattern.
    """
    w = Window.partitionBy("pattern").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = rows.groupBy("pattern", F.col("h1").alias("digit")).agg(F.sum("size").alias("n"))
    first = first.withColumn("sum", F.sum("n").over(w)).join(few(wanted), "pattern").where("sum >= rest and sum - n < rest")
    first = few(first.select(F.col("pattern").alias("own"), F.col("digit").alias("c1"), (F.col("rest") - F.col("sum") + F.col("n")).alias("left")))
    inside = rows.join(first, (F.col("pattern") == F.col("own")) & (F.col("h1") == F.col("c1")))
    second = inside.groupBy("pattern", "c1", "left", F.col("h2").alias("digit")).agg(F.sum("size").alias("n"))
    second = second.withColumn("sum", F.sum("n").over(w)).where("sum >= left and sum - n < left")
    cut = checkpoint(second.select("pattern", "c1", F.col("digit").alias("c2"), (F.col("left") - F.col("sum") + F.col("n")).alias("gap")))
    other = few(cut.select(F.col("pattern").alias("own"), "c1", "c2", "gap"))
    above = rows.join(other, (F.col("pattern") == F.col("own")) & ((F.col("h1") > F.col("c1")) | ((F.col("h1") == F.col("c1")) & (F.col("h2") >= F.col("c2")))))
    off = F.abs(F.col("size") - F.col("gap"))
    filler = above.where(off < F.col("gap")).groupBy("pattern").agg(F.min_by("h", F.struct(off, "h")).alias("filler"))
    return cut.join(filler, "pattern", "left").select("pattern", "c1", "c2", "filler")


def allotted(sums: list[tuple[tuple, int]], weights: tuple[float, ...], copies: int) -> list[tuple]:
    """(pattern, source_size, target, taken) for each of the patterns with their sizes, on the driver."""
    patterns = dict(sums)
    size: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            size[s] = size.get(s, 0) + n
    # A token in several sources counts once in the whole that is shared out.
    whole, each = sum(patterns.values()), sum(size.values())
    share = whole / each if each else 0.0
    target = {s: x * share for s, x in targets(list(size.items()), weights, copies).items()}
    flow = route(patterns, target, copies)
    return [(list(p), sum(size[s] for s in p), float(sum(target[s] for s in p)), float(sum(flow[p].values()))) for p in patterns]


def numbered(sources: DataFrame) -> DataFrame:
    """sources(source, size) with each source's place in code point order, null last."""
    own = checkpoint(sources.orderBy(F.col("source").isNull(), "source").withColumn("id", F.monotonically_increasing_id()))
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for r in own.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["count"]
    starts = own.sparkSession.createDataFrame(starts, "part long, start long")
    # starts has a row for each partition.
    return own.withColumn("part", part).join(F.broadcast(starts), "part").select("source", "size", (F.col("start") + place).alias("at"))


def allotted_apart(sums: DataFrame, weights: tuple[float, ...], copies: int) -> DataFrame:
    """What allotted() gives, without patterns or sources on the driver: targets by a few aggregates, flows
    one task for each set of patterns that are connected by shared sources."""
    each = sums.select("pattern", "size", F.explode("pattern").alias("source"))
    sources = numbered(each.groupBy("source").agg(F.sum("size").alias("size")))
    n = len(weights)
    weight = F.get(F.array(*map(F.lit, map(float, weights))), (F.col("at") % n).cast("int"))
    sources = checkpoint(sources.select("source", "size", "at", weight.alias("weight")))
    whole, total = sums.agg(F.sum("size")).first()[0] or 0, sources.agg(F.sum("size")).first()[0] or 0
    level, open_ = 0.0, None
    while True:
        full = F.col("weight") * level > copies * F.col("size")
        caps, *free = sources.agg(F.sum(F.when(full, copies * F.col("size"))), *(F.count_if(~full & (F.col("at") % n == k)) for k in range(n))).first()
        if not sum(free) or sum(free) == open_:
            break
        level, open_ = water_level(total - (caps or 0), free, weights), sum(free)
    share = whole / total if total else 0.0
    sources = sources.select("source", F.col("size").alias("source_size"), "at", (F.least(F.col("weight") * level, (copies * F.col("size")).cast("double")) * share).alias("target"))
    sources = checkpoint(sources)
    each = checkpoint(each.join(sources, each["source"].eqNullSafe(sources["source"])).drop(sources["source"]))
    by = each.groupBy("pattern", "size").agg(F.min("at").alias("low"), F.sum("source_size").alias("source_size"), F.sort_array(F.collect_list(F.struct("at", "target"))).alias("own"))
    # Added up in the order of the sources, as on the driver.
    by = by.withColumn("sum", F.aggregate("own", F.lit(0.0), lambda a, x: a + x["target"]))
    edges = by.select(F.col("low").alias("a"), F.explode("own.at").alias("b"))
    roots = connected_components(edges)
    by = by.join(roots.select(F.col("a").alias("low"), "root"), "low", "left").withColumn("root", F.coalesce("root", "low"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [tuple(int(x["at"]) for x in o) for o in pdf["own"]]
        quota = {int(x["at"]): float(x["target"]) for o in pdf["own"] for x in o}
        flow = route(dict(zip(own, map(int, pdf["size"]), strict=True)), quota, copies)
        return pd.DataFrame({"pattern": pdf["pattern"], "source_size": pdf["source_size"], "target": pdf["sum"], "taken": [float(sum(flow[p].values())) for p in own]})

    return by.groupBy("root").applyInPandas(solve, "pattern array<string>, source_size long, target double, taken double")


def planned(rows: DataFrame, weights: tuple[float, ...], copies: int, max_patterns: int) -> tuple[DataFrame, bool]:
    """(pattern, source_size, target, whole, c1, c2, filler): how often, and up to which hash, each pattern's
    documents are taken; and whether there are at most max_patterns of them."""
    spark = rows.sparkSession
    sums = checkpoint(rows.groupBy("pattern").agg(F.sum("size").alias("size")))
    small = sums.count() <= max_patterns
    if small:
        plan = spark.createDataFrame(allotted([(tuple(r["pattern"]), r["size"]) for r in sums.collect()], weights, copies), "pattern array<string>, source_size long, target double, taken double")
    else:
        plan = checkpoint(allotted_apart(sums, weights, copies))
    n = F.when(F.col("size") > 0, F.col("size"))
    # Rounding of a flow must not make a copy less.
    times = F.floor(F.col("taken") / n + 1e-9)
    plan = plan.join(sums, "pattern").select("pattern", "source_size", "target", F.coalesce(times, F.lit(0)).cast("int").alias("whole"), F.greatest(F.coalesce(F.col("taken") - times * n, F.lit(0.0)), F.lit(0.0)).alias("rest"))
    few = F.broadcast if small else lambda df: df
    plan = checkpoint(plan)
    return plan.join(cuts(rows, plan.where("rest > 0").select("pattern", "rest"), few), "pattern", "left"), small


def drawn(docs: DataFrame, sources: Column | None = None, weights: tuple[float, ...] = WEIGHTS, copies: int = COPIES, seed: int = SEED, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """docs with a struct of (pattern, size, source_size, target, taken) named DRAWN; see mix()."""
    own = keyed(docs, sources, seed)
    plan, small = planned(checkpoint(own.select(f"{KEYED}.*")), weights, copies, max_patterns)
    m, p = F.col(KEYED), F.col(PLANNED)
    extra = (m["h1"] < p["c1"]) | ((m["h1"] == p["c1"]) & (m["h2"] < p["c2"])) | (m["h"].eqNullSafe(p["filler"]))
    taken = m["size"] * (p["whole"] + F.coalesce(extra, F.lit(False)).cast("int"))
    plan = checkpoint(plan).select(F.col("pattern").alias(PATTERN), F.struct("source_size", "target", "whole", "c1", "c2", "filler").alias(PLANNED))
    out = own.join(F.broadcast(plan) if small else plan, m["pattern"] == F.col(PATTERN), "left")
    return out.withColumn(DRAWN, F.struct(m["pattern"], m["size"], p["source_size"], p["target"], taken.cast("long").alias("taken"))).drop(KEYED, PLANNED, PATTERN)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row (doc_id, pattern, size, source_size, target, taken) for each row of docs.

    sources is an array column of the document's sources, by default its one `source`; a null source
    is a source of its own, an empty or null array counts as it. size is the number of words; taken
    is a multiple of it, up to copies. source_size and target are sums over the pattern's sources.
    Each document is drawn by a hash of its doc_id, so reruns agree, and equal ids are drawn alike.
    Up to max_patterns patterns are solved on the driver, more in the tasks, with the same result.
    """
    return drawn(docs, **options).select("doc_id", f"{DRAWN}.*")


def keep_drawn(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs of which the mix takes words, with the columns of docs and size, source_size,
    target and taken (instead of columns of docs with these names)."""
    new = ("size", "source_size", "target", "taken")
    return drawn(docs, **options).where(F.col(DRAWN)["taken"] > 0).select(*(c for c in docs.columns if c not in new), *(f"{DRAWN}.{c}" for c in new))
