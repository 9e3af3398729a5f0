"""Balanced label propagation: linked documents move to common shards under capacity quotas. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import fingerprint, hashed_slot, rank_by_hash, running_sum, slots_for, table, written

GROUP = ["g1", "g2"]
#: Rows of a group that one task numbers.
NUMBERED = 5_000


def _of(values: list[int], at: Column) -> Column:
    """The value at a place in a short list: one number for each shard or pair of shards."""
    return F.lit(values)[at]


def _loads(df: DataFrame, shards: int, n: Column | None = None) -> list[int]:
    """Rows in each shard, or the sum n; the driver gets a number a shard."""
    found = {r["label"]: r["n"] for r in df.groupBy("label").agg((F.count("*") if n is None else n).alias("n")).collect()}
    return [found.get(i, 0) for i in range(shards)]


def quotas(wishes: dict[tuple[int, int], int], loads: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may move between each pair of shards, so that no shard ends above its capacity.

    What leaves a shard makes room for what comes. Beginning with all wishes, the inflow of
    each shard that would be too full is cut in proportion, until none is: flows in circles
    stay, between full shards too."""
    flow = {k: float(n) for k, n in wishes.items()}
    for _ in range(1_000):
        over = False
        for b in range(len(capacity)):
            into = sum(f for (_, t), f in flow.items() if t == b)
            excess = loads[b] + into - sum(f for (a, _), f in flow.items() if a == b) - capacity[b]
            if excess > 1e-6 and into > 0:
                over = True
                keep = max(0.0, 1 - excess / into)
                flow = {(a, t): f * keep if t == b else f for (a, t), f in flow.items()}
        if not over:
            break
    whole = {k: int(f + 1e-6) for k, f in flow.items()}
    over = [loads[b] - capacity[b] + sum(f if t == b else -f for (a, t), f in whole.items() if b in (a, t)) for b in range(len(capacity))]
    changed = True
    while changed:  # rounding down what leaves leaves some shards too full, and room in others
        changed = False
        for (a, b), f in whole.items():
            step = max(-f, min(wishes[a, b] - f, -over[b])) if over[b] else 0
            if step:
                whole[a, b], changed = f + step, True
                over[b], over[a] = over[b] + step, over[a] - step
    return {k: f for k, f in whole.items() if f}


def _votes(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(g1, g2, label, n, votes, others): for each group and each shard where it or a neighbour has documents, its own documents there, its neighbours' ones by weight, and whether groups other than itself are among them."""
    near = cells.select(F.col("g1").alias("b1"), F.col("g2").alias("b2"), "label", "n")
    near = edges.join(near, ["b1", "b2"])
    others = (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))
    near = near.select(F.col("a1").alias("g1"), F.col("a2").alias("g2"), "label", F.lit(0).cast("long").alias("n"), (F.col("w") * F.col("n")).alias("votes"), others.cast("int").alias("others"))
    own = cells.select(*GROUP, "label", "n", F.lit(0).cast("long").alias("votes"), F.lit(0).alias("others"))
    return near.unionByName(own).groupBy(*GROUP, "label").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes"), F.max("others").alias("others"))


def _wishes(votes: DataFrame, capacity: list[int], takes: list[int], turn: int) -> DataFrame:
    """(g1, g2, label, best, n, ready): n documents of a group in shard `label` want to go to shard `best`.

    A group fills the shards in the order of their votes, each up to its capacity: what lies in
    later ones than it needs wants to go to the earlier ones that lack it. A group has a row for
    each shard at most, so its window and arrays are short."""
    group = Window.partitionBy(*GROUP)
    full = F.col("n") >= _of(capacity, F.col("label"))
    free = F.col("label").isin(takes)
    votes = votes.withColumns({"free": free, "others": F.max("others").over(group) > 0, "of": F.sum("n").over(group), "open": F.coalesce(F.sum(F.when(free, F.col("votes"))).over(group), F.lit(0))})
    # a shard that takes nobody comes last, unless the group has neighbours of other texts, and most are there
    first = F.when(full, 2).when(F.col("free") | F.col("others") & (F.col("votes") > F.col("open")), 1).otherwise(0)
    tie = F.xxhash64(F.lit(turn), *GROUP, "label")  # another order of shards for each group and round
    votes = votes.withColumns({"first": first, "tie": tie, "bound": F.when(F.col("free") | full, _of(capacity, F.col("label"))).otherwise(F.col("n"))})
    ranks = group.orderBy(F.desc("first"), F.desc("votes"), F.desc("n"), F.desc("tie")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("bound").over(ranks)
    votes = votes.withColumn("more", F.greatest(F.lit(0), F.least(F.col("bound"), F.col("of") - (upto - F.col("bound")))) - F.col("n"))
    votes = votes.withColumns({"give": F.greatest(F.lit(0), -F.col("more")), "take": F.greatest(F.lit(0), F.col("more"))})
    votes = votes.withColumns({"given": F.sum("give").over(ranks), "taken": F.sum("take").over(ranks)}).where("more <> 0")
    sides = votes.groupBy(*GROUP, "others").agg(F.collect_list(F.struct("label", "give", "given", "take", "taken")).alias("x"))
    flow = lambda a, b: F.struct(a["label"].alias("label"), b["label"].alias("best"), (F.least(a["given"], b["taken"]) - F.greatest(a["given"] - a["give"], b["taken"] - b["take"])).cast("long").alias("n"))
    flows = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: flow(a, b))))
    # two neighbours that change places every round would never meet: one of other texts' neighbours in two waits
    ready = ~F.col("others") | (F.pmod(F.xxhash64(F.lit("ready"), F.lit(turn), *GROUP), F.lit(2)) == 0)
    return sides.select(*GROUP, ready.alias("ready"), F.explode(F.filter(flows, lambda f: f["n"] > 0)).alias("f")).select(*GROUP, "ready", "f.label", "f.best", "f.n")


def propagate(cells: DataFrame, edges: DataFrame, capacity: list[int], rounds: int = 10) -> DataFrame:
    """cells(g1, g2, label, n) after the documents have moved: n of a group's documents are in shard `label`.

    edges(a1, a2, b1, b2, w): a document of group b is a neighbour of those of group a, with
    weight w; both directions are given, and a group of several documents is its own neighbour.
    The documents of a group are alike, so a cell stands for all of its documents. In each
    round the edges are joined with their neighbours' cells, and the sums by shard are the
    votes: documents want to go where most of their neighbours are, among shards that can take
    any: those with room, and those that others wished to leave in the round before. `quotas`
    says how many may go between each pair of shards; a group larger than a shard fills as many
    as it needs. Ends when nothing wants to move any more, or after `rounds`.
    """
    shards = len(capacity)
    loads = _loads(cells, shards, F.sum("n"))
    takes = list(range(shards))
    for turn in range(rounds):
        wishes = written(_wishes(_votes(cells, edges), capacity, takes, turn), "shard-wishes")
        found = wishes.groupBy("label", "best").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ready"), F.col("n"))).alias("ready"), F.sum(F.col("ready").cast("long")).alias("cells")).collect()
        asked = {(r["label"], r["best"]): (r["ready"], r["cells"]) for r in found if r["cells"]}
        may = quotas({k: n for k, (n, _) in asked.items()}, loads, capacity)
        for (a, b), n in may.items():
            loads[a], loads[b] = loads[a] - n, loads[b] + n
        before, takes = takes, [i for i in range(shards) if loads[i] < capacity[i] or any(r["label"] == i for r in found)]
        if not may:
            if before == takes and all(r["ready"] == r["n"] for r in found):
                break
            continue
        slots = slots_for(max(c for _, c in asked.values()), least=1)
        order = ["h", *GROUP]
        movers = wishes.where("ready").drop("ready").withColumn("h", F.xxhash64(F.lit(turn), *GROUP))
        ranked = running_sum(movers, ["label", "best"], order, "n", "upto", hashed_slot(order, slots), slots)
        quota = _of([may.get((a, b), 0) for a in range(shards) for b in range(shards)], F.col("label") * shards + F.col("best"))
        goes = F.greatest(F.lit(0), F.least("n", quota - (F.col("upto") - F.col("n")))).cast("long")
        ends = F.array(F.struct("label", (-goes).alias("n")), F.struct(F.col("best").alias("label"), goes.alias("n")))
        moved = ranked.where(goes > 0).select(*GROUP, F.explode(ends).alias("x")).select(*GROUP, "x.label", "x.n")
        cells = written(cells.unionByName(moved).groupBy(*GROUP, "label").agg(F.sum("n").alias("n")).where("n > 0"), "shard-cells")
    return cells


def _edges(work: DataFrame, groups: DataFrame, links: DataFrame | None) -> DataFrame:
    """(a1, a2, b1, b2, w): groups of several documents with themselves, and links(a, b) between ids as weighted edges between groups, both ways."""
    own = groups.where("n > 1").select(F.col("g1").alias("a1"), F.col("g2").alias("a2"), F.col("g1").alias("b1"), F.col("g2").alias("b2"), F.lit(1).cast("long").alias("w"))
    if links is None:
        return own
    ids = written(work.where("doc_id IS NOT NULL").groupBy("doc_id", *GROUP).agg(F.count("*").alias("same")), "shard-ids")
    end = lambda c: ids.select(F.col("doc_id").alias(c), F.col("g1").alias(f"{c}1"), F.col("g2").alias(f"{c}2"))
    half = written(links.select("a", "b").join(end("a"), "a"), "shard-links")
    pairs = half.join(end("b"), "b").where("a1 <> b1 OR a2 <> b2").select("a1", "a2", "b1", "b2")
    both = pairs.unionByName(pairs.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    return own.unionByName(both.groupBy("a1", "a2", "b1", "b2").agg(F.count("*").alias("w")))


def cut_links(placed: DataFrame, links: DataFrame) -> DataFrame:
    """links, cut: rows of links(a, b) whose ids are both in placed(doc_id, shard), and those whose ends are in different shards."""
    end = lambda c: placed.select(F.col("doc_id").alias(c), F.col("shard").alias(f"{c}_shard"))
    both = links.select("a", "b").join(end("a"), "a").join(end("b"), "b")
    return both.agg(F.count("*").alias("links"), F.count_if(F.col("a_shard") != F.col("b_shard")).alias("cut"))


def cut_edges(placed: DataFrame) -> DataFrame:
    """edges, cut: links between documents of equal texts in placed(g1, g2, shard), and those whose ends are in different shards."""
    cells = placed.groupBy(*GROUP, "shard").agg(F.count("*").cast("double").alias("n"))
    sums = cells.groupBy(*GROUP).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return sums.agg(F.sum((F.col("s") * F.col("s") - F.col("s")) / 2).alias("edges"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("cut"))


def shard(docs: DataFrame, shards: int = 16, rounds: int = 10, links: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, g1, g2, shard, slot for every row of docs(doc_id, text).

    Law `rows`: counts of the shards are at most one apart. Links: rows with equal texts (a
    null text is an empty one), and those of links(a, b), pairs of ids such as doc_id and
    component_id of the near duplicates: one given twice counts twice, one with an id that is
    null or not in docs counts for nothing, one of a repeated id counts for all its rows, and
    equal texts share their links. Linked rows are dealt round robin over the shards, and move by
    `propagate`; the others begin in the shard of a hash and stay as long as there is room, or
    fill what is left. slot numbers each shard's rows from 0 without gaps.

    Repeated rows and null ids are rows like any others, ties go by the row's fingerprint; an empty table gives an empty one.
    Other columns aren't read. Texts, of any length, are hashed whole and never shuffled.
    No step holds a group or a shard in one task: groups are counted by partial sums, ranks are
    running sums in levels, and a large group's join is between two written tables. Only counts by
    shard and pair of shards go to the driver.
    """
    text = F.coalesce("text", F.lit(""))
    g1, g2 = fingerprint(text)
    work = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), g1.alias("g1"), g2.alias("g2"))
    k1, k2 = fingerprint(F.col("doc_id"), F.col("g1"), F.col("g2"))
    work = written(work.withColumns({"k1": k1, "k2": k2, "one": F.lit(1)}), "shard-rows")
    rows = work.count()
    capacity = [rows // shards + (i < rows % shards) for i in range(shards)]
    order = ["k1", "k2"]
    groups = work.groupBy(*GROUP).agg(F.count("*").alias("n"))
    edges = written(_edges(work, groups, links), "shard-edges")
    groups = written(groups.where("n > 1") if links is None else groups.join(edges.select(F.col("a1").alias("g1"), F.col("a2").alias("g2")).distinct(), GROUP, "left_semi"), "shard-groups")
    dealt = running_sum(groups, [], GROUP, "n", "upto", hashed_slot(GROUP, slots_for(rows)), slots_for(rows))
    # of the linked rows number `upto - n` to `upto - 1`, every shards-th begins in the same shard
    upto = lambda x, i: F.floor((x + (shards - 1 - i)) / shards)
    counts = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(i.alias("label"), (upto(F.col("upto"), i) - upto(F.col("upto") - F.col("n"), i)).alias("n")))
    cells = written(dealt.select(*GROUP, F.explode(counts).alias("x")).select(*GROUP, "x.label", "x.n").where("n > 0"), "shard-cells")
    cells = propagate(cells, edges, capacity, rounds)
    ends = Window.partitionBy(*GROUP).orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    ends = cells.withColumn("end", F.sum("n").over(ends)).groupBy(*GROUP).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("end", "label"))).alias("ends"))
    ends = written(ends.select(F.col("g1").alias("b1"), F.col("g2").alias("b2"), F.col("n").alias("of"), "ends"), "shard-ends")
    same = (F.col("g1") == F.col("b1")) & (F.col("g2") == F.col("b2"))
    linked = written(work.join(ends, same).drop("b1", "b2"), "shard-linked")
    alone = written(work.join(ends, same, "left_anti").withColumn("label", F.pmod("k1", F.lit(shards)).cast("int")), "shard-alone")
    columns = [*work.columns, "label"]
    linked = running_sum(linked, GROUP, order, "one", "rank", F.pmod(F.xxhash64(F.lit("slot"), *order), F.ceil(F.col("of") / NUMBERED)), -(-rows // NUMBERED))
    linked = written(linked.withColumn("label", F.filter("ends", lambda e: F.col("rank") <= e["end"])[0]["label"]).select(*columns), "shard-labels")
    left = [c - n for c, n in zip(capacity, _loads(linked, shards), strict=True)]
    ranked = written(rank_by_hash(alone, ["label"], order, rows).withColumn("stays", F.col("rank") <= _of(left, F.col("label"))), "shard-ranks")
    stay, moved = ranked.where("stays").select(*columns), ranked.where("NOT stays").select(*columns)
    gaps = [n - m for n, m in zip(left, _loads(stay, shards), strict=True)]
    moved = rank_by_hash(moved, [], order, rows)
    ends = F.lit([(sum(gaps[: i + 1])) for i in range(shards)])
    moved = moved.withColumn("label", F.size(F.filter(ends, lambda e: e < F.col("rank"))))
    placed = written(reduce(DataFrame.unionByName, [linked, stay, moved.select(*columns)]), "shard-placed")
    out = rank_by_hash(placed, ["label"], order, rows)
    return out.select("doc_id", "size", "text_crc32", "g1", "g2", F.col("label").alias("shard"), (F.col("rank") - 1).cast("long").alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
