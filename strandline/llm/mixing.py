"""Mixing of overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources they belong to). A
pattern can send its tokens to each of its sources, once for each repetition; repetition e costs
2 e + 1 a token, so the cost of repeating is convex and every pattern is used once before any is
repeated. The flow that fills the quotas at least cost is found over patterns and sources, which
are few whatever the number of documents. Each pattern then takes its documents in seeded hash
order, round after round, up to its flow.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.llm.common import ROW, keyed
from strandline.session import settled

WORD = r"[^\x20\x09-\x0D]+"
#: Patterns and sources the flow is solved for; more is an error, nothing is dropped.
MAX_PATTERNS = 100_000
#: Hash buckets per level of the seeded selection.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], total: float, cap: float = 2.0) -> list[float]:
    """Share total by weight; a target stops at cap times its size and the excess is shared anew until none is above."""
    target, capped = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(cap * s for s, c in zip(sizes, capped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        above = False
        for i, (s, w) in enumerate(zip(sizes, weights, strict=True)):
            target[i] = cap * s if capped[i] else (rest * w / weight if weight else 0.0)
            above |= not capped[i] and target[i] > cap * s
        if not above:
            return target
        capped = [c or t > cap * s for c, t, s in zip(capped, target, sizes, strict=True)]


def least_cost_flow(patterns: list[tuple[int, Iterable[int]]], quotas: list[int], repeats: int) -> list[int]:
    """Tokens each pattern sends; patterns are (tokens, indices of its sources).

    Successive shortest paths on the residual graph. Costs fall only on pattern nodes and grow with
    the repetition, so an augmenting path runs from a pattern's next repetition to a source with
    room, possibly through sources and patterns whose flow is moved.
    """
    tokens, members = [p[0] for p in patterns], [list(p[1]) for p in patterns]
    used, room = [0] * len(patterns), list(quotas)
    flow: list[dict[int, int]] = [{} for _ in patterns]
    senders: list[dict[int, None]] = [{} for _ in quotas]
    # Direct shares first, cheapest repetition first; paths through other patterns follow.
    queue = [(1, i) for i, t in enumerate(tokens) if t > 0 and repeats > 0]
    heapq.heapify(queue)
    while queue:
        cost, i = heapq.heappop(queue)
        epoch = cost // 2
        left = tokens[i] * (epoch + 1) - used[i]
        while left > 0:
            # Breadth first from the pattern over its sources and the patterns whose flow can be moved away.
            came, line, end = {("p", i): None}, [("p", i)], None
            for node in line:
                kind, k = node
                for nxt in [("s", s) for s in members[k]] if kind == "p" else [("p", p) for p in senders[k]]:
                    if nxt not in came:
                        came[nxt] = node
                        line.append(nxt)
                        if nxt[0] == "s" and room[nxt[1]] > 0:
                            end = nxt
                            break
                if end:
                    break
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            amount = min(left, room[end[1]], *[flow[b[1]][a[1]] for a, b in zip(path[1:-1:2], path[2::2], strict=True)])
            for a, b in zip(path, path[1:]):
                if a[0] == "p":
                    flow[a[1]][b[1]] = flow[a[1]].get(b[1], 0) + amount
                    senders[b[1]][a[1]] = None
                else:
                    flow[b[1]][a[1]] -= amount
                    if not flow[b[1]][a[1]]:
                        del flow[b[1]][a[1]], senders[a[1]][b[1]]
            used[i] += amount
            room[end[1]] -= amount
            left -= amount
        if left == 0 and epoch + 1 < repeats:
            heapq.heappush(queue, (cost + 2, i))
    return used


def plan(sized: DataFrame, cap: float = 2.0, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1)) -> tuple[list, dict]:
    """([pattern, tokens it sends], source -> (size, target)) for sized (_pattern: array of sources, _size)."""
    totals = sized.groupBy("_pattern").agg(F.sum("_size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    order = lambda s: (s is None, s or "")  # noqa: E731  Python compares text by code point
    sources = sorted({s for r in totals for s in r["_pattern"]}, key=order)
    index = {s: i for i, s in enumerate(sources)}
    sizes = [0] * len(sources)
    for r in totals:
        for s in r["_pattern"]:
            sizes[index[s]] += r["n"]
    target = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], share * sum(r["n"] for r in totals), cap)
    totals.sort(key=lambda r: [order(s) for s in r["_pattern"]])
    sent = least_cost_flow([(r["n"], [index[s] for s in r["_pattern"]]) for r in totals], [round(t) for t in target], int(cap))
    return [(r["_pattern"], r["n"], f) for r, f in zip(totals, sent, strict=True)], {s: (sizes[i], target[i]) for s, i in index.items()}


def mix(docs: DataFrame, *args, prefix: str = "_", **options) -> DataFrame:
    """The columns of docs, and those of mixed() under <prefix>size, <prefix>sources, <prefix>source_size, <prefix>target, <prefix>times.

    A prefix that would give a column of docs its name again is an error.
    """
    names = {f"_{n}": f"{prefix}{n}" for n in ("size", "sources", "source_size", "target", "times")}
    if clash := sorted(set(names.values()) & set(docs.columns)):
        raise ValueError(f"columns {clash} are in the input already: give another prefix")
    return mixed(docs, *args, **options).select("_doc.*", *[F.col(a).alias(b) for a, b in names.items()])


def mixed(docs: DataFrame, text: str = "text", sources: Column | None = None, ident: str = "doc_id", seed: int = 7,
        cap: float = 2.0, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """The columns of docs packed as _doc, with _size, _sources, _source_size, _target (of its first source) and _times: how often the mix takes the document.

    sources is an array of source names (default: the one in column source); a null name is a source
    of its own and comes last, a null or empty array is the null source. A null text has size 0.
    Documents of size 0 are taken as often as their hash says, which moves no tokens. The whole
    documents nearest to the flow are taken, so a source misses its target by half a document per
    pattern and round at most. The order is a hash of id and text, and among rows equal in both a hash
    of their row identity, so a group of repeated rows is split at the cut. Empty table: no rows.
    """
    names = F.array(F.col("source").cast("string")) if sources is None else sources
    pattern = F.when(names.isNull() | (F.size(names) == 0), F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(names)))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(ident).cast("string"), F.lit("")), F.col(ident).isNull(), F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
    whole = keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), pattern.alias("_pattern"), word_count(F.col(text)).alias("_size"), key.alias("_key"))
    packed = whole.withColumn("_copy", F.xxhash64(ROW))
    light = packed.select("_pattern", "_size", "_key", "_copy")
    flows, stats = plan(light, cap, share, weights)
    spark = docs.sparkSession
    rows = []
    for p, n, sent in flows:
        full, part = (sent // n, sent % n) if n else (0, 0)
        size, target = stats[min(p, key=lambda s: (s is None, s or ""))]
        rows.append((p, int(full), int(part), int(size), float(target)))
    kind = "_pattern array<string>, _full long, _part long, _source_size long, _target double"
    flow = settled(spark.createDataFrame(rows, kind), "flow")
    cut = _cuts(light, flow)
    out = packed.join(cut, F.col("_pattern").eqNullSafe(F.col("_cp"))).drop("_cp")
    before = (F.col("_key") < F.col("_cut_key")) | ((F.col("_key") == F.col("_cut_key")) & ((F.col("_copy") < F.col("_cut_from")) | F.coalesce(F.col("_copy") <= F.col("_cut_copy"), F.lit(False))))
    times = F.col("_full") + F.when(F.coalesce(before, F.lit(False)), 1).otherwise(0)
    return out.select("_doc", "_size", F.col("_pattern").alias("_sources"), "_source_size", "_target", times.cast("long").alias("_times"))


def _narrowed(rows: DataFrame, state: DataFrame, column: str, on=None) -> DataFrame:
    """state with _lo, the range of 2^-24 of the hash column in which _need is reached, and the _need that is left there.

    rows of a pattern that meet the condition on are summed by ranges, level by level, each a
    pre-aggregated sum of at most BUCKETS ranges a pattern.
    """
    bits, shift = BUCKETS.bit_length() - 1, 63
    state = state.withColumn("_lo", F.lit(0).cast("long"))
    same = F.col("_pattern").eqNullSafe(F.col("_cp"))
    same = same if on is None else same & on
    for _ in range(2):
        shift -= bits
        near = rows.join(state.where("_need > 0"), same & (F.shiftright(_place(column), shift + bits) == F.col("_lo")))
        sums = near.groupBy("_cp", F.shiftright(_place(column), shift).alias("_b")).agg(F.sum("_size").alias("_s"), F.first("_need").alias("_need"))
        state = settled(_reached(state, sums, "_b", "_lo"), "cuts")
    return state


def _place(column: str):
    """Place of a hash among 2^63, in its order."""
    return F.shiftrightunsigned(F.col(column).bitwiseXOR(F.lit(-(2**63))), 1)


def _reached(state: DataFrame, sums: DataFrame, place: str, to: str) -> DataFrame:
    """state with the first place (in column to) at which the running sum of _s reaches _need, and what is needed of that place."""
    run = F.sum("_s").over(W.partitionBy("_cp").orderBy(place))
    first = sums.withColumn("_run", run).where("_run >= _need").groupBy("_cp").agg(F.min_by(F.struct(place, (F.col("_need") - F.col("_run") + F.col("_s")).alias("_left")), place).alias("_at")).withColumnRenamed("_cp", "_np")
    return (state.join(first, F.col("_cp").eqNullSafe(F.col("_np")), "left")
            .withColumn(to, F.coalesce(f"_at.{place}", to)).withColumn("_need", F.coalesce("_at._left", "_need")).drop("_at", "_np"))


def _cuts(light: DataFrame, flow: DataFrame) -> DataFrame:
    """flow by pattern (_cp) with the key (_cut_key) at which the partial round stops, and the place among its rows:
    those with _copy below _cut_from or up to _cut_copy are taken.

    The place is narrowed down over the keys, then over the rows of one key, so neither many keys nor
    many rows of one key are ordered one by one: only those of a range of 2^-24 are.
    """
    level = 2 * (BUCKETS.bit_length() - 1)
    state = flow.select(F.col("_pattern").alias("_cp"), "_full", "_part", "_source_size", "_target", F.col("_part").alias("_need"))
    state = _narrowed(light, state, "_key").withColumn("_cut_key", F.lit(None).cast("long"))
    same = F.col("_pattern").eqNullSafe(F.col("_cp"))
    near = light.join(state.where("_need > 0"), same & (F.shiftright(_place("_key"), 63 - level) == F.col("_lo")))
    keys = near.groupBy("_cp", "_key").agg(F.sum("_size").alias("_s"), F.first("_need").alias("_need"))
    state = settled(_reached(state, keys, "_key", "_cut_key"), "cuts")
    one = F.col("_key") == F.col("_cut_key")
    state = _narrowed(light, state, "_copy", one)
    last = light.join(state.where("_need > 0"), same & one & (F.shiftright(_place("_copy"), 63 - level) == F.col("_lo")))
    run = F.sum("_size").over(W.partitionBy("_cp").orderBy("_copy").rowsBetween(W.unboundedPreceding, 0))
    taken = last.withColumn("_run", run).where("_run - _size / 2.0 <= _need").groupBy("_cp").agg(F.max("_copy").alias("_last")).withColumnRenamed("_cp", "_np")
    # Where not even the first document of the range fits, all of the ranges before it are taken.
    start = F.shiftleft(F.col("_lo"), 63 - level + 1).bitwiseXOR(F.lit(-(2**63)))
    return state.join(taken, F.col("_cp").eqNullSafe(F.col("_np")), "left").select(
        "_cp", "_full", "_source_size", "_target", F.when(F.col("_part") > 0, F.col("_cut_key")).alias("_cut_key"), start.alias("_cut_from"), F.col("_last").alias("_cut_copy"))
