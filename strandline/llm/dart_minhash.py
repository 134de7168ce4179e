"""Near-duplicates by DartMinHash.

A text is the weighted set of its five-word shingles, weighted by how often they occur. Every unit of
weight of an element is a region into which darts are thrown: their arrival times along the rank axis
form a Poisson process whose steps come from hashes of (element, unit, number), so all texts see the
same darts. A dart belongs to one of K coordinates; the earliest dart of each coordinate is kept, and
two texts agree on a coordinate with a probability equal to their weighted Jaccard similarity. The
time limit is doubled until every coordinate has a dart, so the cost is about the number of shingles
plus K log K.

Signatures are cut into bands. In every bucket the members are compared with a few heads, and a link
counts when the exact similarity of the texts reaches the threshold. Buckets whose members are then
not all in one component are gone through again: members outside the main component of the bucket
become heads too, more of them every round, and meet the members of other components, until each has
been one. So every two texts of a bucket are in one component or were compared. Only buckets that still
hold several components stay in the work.

Comparing is done in two steps. One byte of every coordinate travels with a text; two texts that agree in
fewer than AGREE coordinates are not near. Of the others the texts meet in blocks: the rows of a family
(texts whose buckets have the same main component) are dealt over blocks of bounded bytes, and a pair of blocks gets each
text it needs once, however many pairs it is in. Both steps read sorted partitions as a stream, so a
task holds the heads of one bucket, or the texts of two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import ROW, among, attach, map_arrow
from strandline.llm.exact_dedup import classes, digests
from strandline.operators.components import components
from strandline.session import settled

SHINGLE = 5
THRESHOLD = 0.8
#: Bands and rows: a pair at similarity 0.8 shares no bucket with probability (1 - 0.8^6)^36 = 2e-5.
BANDS, ROWS = 36, 6
#: Heads of a bucket that its members are compared with; members also meet other heads in other bands.
HEADS = 3
#: A head is the row that is least after an exclusive or with the mask of its order (fixed values, one a head).
MASKS = [0, 0x7FFFFFFFFFFFFFFF, 0x2AAAAAAAAAAAAAAA]
#: Further heads a bucket takes in the first round after that, and their growth from round to round.
MORE_HEADS, GROWTH = 8, 4
#: Parts into which a key is split before its rows meet.
SALTS = 16
#: Coordinates in which a pair must agree: one at similarity 0.8 falls below with a probability of 2e-7.
AGREE = 140
#: Members of a bucket that go to one task, and bytes of text in a block.
PART, BLOCK_BYTES = 4096, 2 << 20
#: Texts whose darts are thrown together.
TOGETHER = 32
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, known: dict, k: int = SHINGLE) -> np.ndarray:
    """Sorted element hashes of a text: lower-cased words, k at a time; the n-th occurrence of a shingle is a unit of its own.

    A text of fewer than k words is one shingle; a text without words has none.
    """
    import xxhash

    words = text.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    new = [w for w in set(words) if w not in known]
    known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(known) > 500_000:
        known.clear()
    n = max(len(h) - k + 1, 1)
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for i in range(min(k, len(h))):
            s = _mix(s * MIX + h[i : i + n])
        s.sort()
        if n > 1 and (s[1:] == s[:-1]).any():
            first = np.searchsorted(s, s, "left")
            s = np.sort(_mix(s + (np.arange(n) - first).astype(np.uint64) * MIX))
    return s


def signatures(texts: list[np.ndarray], k: int) -> np.ndarray:
    """Hashes of the earliest dart of each of k coordinates, one row a text; zeros for a text without units.

    The darts of all texts are thrown together: round r throws the r-th dart of every unit whose
    time is not over. Texts that still lack a coordinate are thrown anew up to twice their limit.
    """
    count = np.array([len(u) for u in texts])
    ids, rank = np.zeros(len(texts) * k, np.uint64), np.full(len(texts) * k, np.inf)
    limit = (k * np.log(k) + 2 * k) / np.maximum(count, 1)
    todo = np.flatnonzero(count)
    with np.errstate(over="ignore"):
        while len(todo):
            cell, who = np.concatenate([texts[i] for i in todo]), np.repeat(todo, count[todo])
            at, until, number, thrown = np.zeros(len(cell)), limit[who], np.uint64(1), []
            while len(cell):
                dart = _mix(cell + number * MIX)
                at = at - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                hit = np.flatnonzero(at < until)
                cell, at, who, until = cell[hit], at[hit], who[hit], until[hit]
                name = _mix(dart[hit] ^ MIX)
                thrown.append((who * k + (name % np.uint64(k)).astype(np.int64), at, name))
                number += np.uint64(1)
            place, when, name = (np.concatenate(c) for c in zip(*thrown, strict=True))
            np.minimum.at(rank, place, when)
            first = np.flatnonzero(when == rank[place])
            # Of darts at the same time the one with the largest hash counts.
            ids[todo[:, None] * k + np.arange(k)] = 0
            np.maximum.at(ids, place[first], name[first])
            todo = todo[~np.isfinite(rank.reshape(-1, k)[todo]).all(1)]
            limit[todo] *= 2
    return ids.reshape(-1, k)


def _signatures(batches):
    known: dict = {}
    for batch in batches:
        out, short = [], []
        texts = [shingles(t or "", known) for t in batch.column("text").to_pylist()]
        for i in range(0, len(texts), TOGETHER):
            part = texts[i : i + TOGETHER]
            flat = signatures(part, BANDS * ROWS)
            sig = flat.reshape(len(part), BANDS, ROWS)
            with np.errstate(over="ignore"):
                h = np.tile(np.arange(BANDS, dtype=np.uint64), (len(part), 1))
                for j in range(ROWS):
                    h = _mix(h * MIX + sig[:, :, j])
            out += [x if len(u) else [] for x, u in zip(h.view(np.int64), part, strict=True)]
            # The low bits of a dart name its coordinate, so its high byte is kept.
            short += [x.tobytes() for x in (flat >> np.uint64(56)).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.list_(pa.int64())), pa.array(short, pa.binary())], [ROW, "_bands", "_sig"])


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Signatures of a column, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


def _agreeing(batches):
    """The pairs that agree in enough coordinates, from rows sorted by (blocks, signatures first)."""
    at, held = None, {}
    for batch in batches:
        pairs: list = []
        for u, v, kind, b, many, sig in zip(*(batch.column(c).to_pylist() for c in ("_u", "_v", "_kind", "_b", "_as", "_sig")), strict=True):
            if at != (u, v):
                at, held = (u, v), {}
            if kind == 0:
                held[b] = sig
            else:
                pairs += [(a, b, u, v, held[a], held[b]) for a in many]
        if pairs:
            *names, left, right = zip(*pairs, strict=True)
            left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(len(pairs), -1) for x in (left, right))
            near = np.flatnonzero((left == right).sum(1) >= AGREE)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)[near]) for c in names], ["_a", "_b", "_pa", "_pb"])


def _meet(batches):
    """Pairs of members with heads of their bucket in other components, from rows sorted by (bucket, part, heads first)."""
    at, heads = None, []
    names = ["_bucket", "_part", "_kind", ROW, "_comp", "_place"]
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, part, kind, row, comp, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
        sig = _bytes_of(batch.column("_sig"))
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
        found: list = []
        for i, j in zip([0, *cuts], [*cuts, len(row)], strict=True):
            if at != (bucket[i], part[i]):
                at, heads = (bucket[i], part[i]), []
            if kind[i] == 0:
                heads += zip(row[i:j], comp[i:j], place[i:j], sig[i:j], strict=True)
                continue
            for r, c, p, s in heads:
                hit = i + np.flatnonzero((comp[i:j] != c) & ((sig[i:j] == s).sum(1) >= AGREE))
                found += [(row[hit[place[hit] == q]], r, q, p) for q in np.unique(place[hit])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.list_(pa.int64())] + [pa.int64()] * 3, strict=True)], ["_as", "_b", "_pa", "_pb"])


def _sides(batches):
    """The texts that each pair of blocks needs, each once, from rows sorted by blocks."""
    at, told = None, np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        u, v, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_u", "_v", "_b"))
        many = batch.column("_as")
        a, ends = many.flatten().to_numpy(zero_copy_only=False), np.cumsum(many.value_lengths().to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero((u[1:] != u[:-1]) | (v[1:] != v[:-1])) + 1
        found: list = []
        for i, j in zip([0, *cuts], [*cuts, len(u)], strict=True):
            if at != (u[i], v[i]):
                at, told = (u[i], v[i]), np.empty(0, np.int64)
            new = np.setdiff1d(np.concatenate([b[i:j], a[ends[i - 1] if i else 0 : ends[j - 1]]]), told)
            told = np.union1d(told, new)
            found.append((np.full(len(new), u[i]), np.full(len(new), v[i]), new))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["_u", "_v", ROW])


def _similar(batches):
    """(_a, _b) of a forest over the pairs whose weighted Jaccard similarity reaches the threshold, from rows sorted by (blocks, texts first, _b)."""
    known: dict = {}
    at, sets, root = None, {}, {}
    last, right, met = None, None, set()

    def top(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for batch in batches:
        kept: list = []
        for u, v, kind, b, many, text in zip(*(batch.column(c).to_pylist() for c in ("_u", "_v", "_kind", "_b", "_as", "text")), strict=True):
            if at != (u, v):
                at, sets, root, last = (u, v), {}, {}, None
            if kind == 0:
                sets[b] = shingles(text, known)
                continue
            if b != last:
                last, right, met = b, sets[b], set()
            for a in many:
                # A pair may come from several buckets.
                if a in met or (x := top(a)) == (y := top(b)):
                    continue
                met.add(a)
                left = sets[a]
                if min(len(left), len(right)) < THRESHOLD * max(len(left), len(right)):
                    continue
                places = np.searchsorted(right, left)
                places[places == len(right)] = 0
                common = int((right[places] == left).sum())
                if common >= THRESHOLD * (len(left) + len(right) - common):
                    root[x] = y
                    kept.append((a, b))
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], ["_a", "_b"])


def _placed(members: DataFrame, family: str, sizes: DataFrame) -> DataFrame:
    """(_row, _place): the block of each row; family is the column of members by whose least value rows are put together."""
    rows = members.groupBy(ROW).agg(F.min(family).alias("_family")).join(among(sizes, members), ROW)
    weighed = attach(rows, ["_family"], F.col(ROW), {"_all": (F.sum, F.col("_bytes") + 64)}, SALTS)
    block = F.pmod(F.xxhash64(ROW), F.ceil(F.col("_all") / BLOCK_BYTES))
    return settled(weighed.select(ROW, F.xxhash64("_family", block).alias("_place")), "places")


def _in_blocks(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Rows (_u, _v, _kind, _b, _as, column) sorted by pairs of blocks: of each pair of blocks first the values (column, by _row) that its pairs need, each once, then the pairs."""
    asked = settled(pairs.select(F.least("_pa", "_pb").alias("_u"), F.greatest("_pa", "_pb").alias("_v"), "_b", "_as"), "pairs")
    dealt = asked.repartition("_u", "_v").sortWithinPartitions("_u", "_v")
    rows = settled(map_arrow(dealt, _sides, f"_u long, _v long, {ROW} long"), "sides")
    none = F.array().cast("array<long>")
    # Only the values of pairs that meet move.
    held = rows.join(among(values.select(ROW, column), rows), ROW).select("_u", "_v", F.lit(0).alias("_kind"), F.col(ROW).alias("_b"), none.alias("_as"), column)
    lines = held.union(asked.select("_u", "_v", F.lit(1), "_b", "_as", F.lit(None).cast(values.schema[column].dataType)))
    return lines.repartition("_u", "_v").sortWithinPartitions("_u", "_v", "_kind", "_b")


def _links(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Links (_a, _b) that join the same texts as those pairs whose texts are similar; pairs is _b, its partners _as of one block, their blocks _pb and _pa."""
    return settled(map_arrow(_in_blocks(pairs, whole, "text"), _similar, "_a long, _b long"), "links")


def _grown(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) after links: only the components found so far and what links them are gone through."""
    if found is None:
        return settled(components(links.select(F.col("_a").alias("u"), F.col("_b").alias("v"))), "components")
    part = found.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    edges = links.join(part, F.col("_a") == F.col("_n"), "left").select(F.coalesce("_c", "_a").alias("u"), "_b")
    edges = edges.join(part, F.col("_b") == F.col("_n"), "left").select("u", F.coalesce("_c", "_b").alias("v"))
    merged = settled(components(edges), "merged")
    onto = merged.select(F.col("node").alias("_c"), F.col("component").alias("_to"))
    moved = part.join(onto, "_c", "left").select(F.col("_n").alias("node"), F.coalesce("_to", "_c").alias("component"))
    return settled(moved.union(merged.join(found.select("node"), "node", "left_anti")), "components")


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that lie in several components, with their own (_comp), the bucket's most frequent one (_main) and its members (_count)."""
    placed = members.join(found.select(F.col("node").alias(ROW), "component"), ROW, "left").select(ROW, "_bucket", "_asked", F.coalesce("component", ROW).alias("_comp"))
    # A bucket whose members outside its main component all were heads is settled: they have met everyone in it.
    of_part = placed.groupBy("_bucket", "_comp").agg(F.count("*").alias("_share"), F.count(F.when(~F.col("_asked"), 1)).alias("_left"))
    of_all = of_part.groupBy("_bucket").agg(F.max(F.struct("_share", "_comp", "_left")).alias("_most"), F.sum("_share").alias("_count"), F.sum("_left").alias("_left"))
    open_ones = settled(of_all.where("_left > _most._left").select("_bucket", F.col("_most._comp").alias("_main"), "_count"), "open")
    return settled(placed.join(open_ones, "_bucket").select(ROW, "_bucket", "_asked", "_comp", "_main", "_count"), "mixed")


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row per row of docs: _row (from column row, unique numbers, if given), _id, class_id (least id of the class), class_size, kept (one row of a class).

    Equal texts share a class, also empty and null ones; among different texts only those with words
    can be near. Null ids come last. Repeated rows are in one class. Empty table: no rows.
    """
    whole = docs.select((F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias(ROW), F.col(f"`{ident}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # Rows that come with numbers are written already.
    whole = (whole if row else settled(whole, "texts")).withColumn("_bytes", F.octet_length("text"))
    copies = settled(classes(digests(whole, F.col("text"), F.col("_id"), F.col(ROW))).select(ROW, "_id", "keep_row", "kept"), "copies")
    singles = copies.where("kept").select(ROW)
    # Only one of equal texts is signed, where it stands.
    signed = among(whole.select(ROW, "text"), singles).withColumnRenamed(ROW, "row")
    bands = settled(map_arrow(signed, _signatures, f"{ROW} long, _bands array<long>, _sig binary"), "bands")
    sizes = whole.select(ROW, "_bytes")
    # Members and heads of every bucket with more than one text, in one exchange; each head is the least in an order of its own.
    # Dealt first, so that what the orders are taken of is formed after it and does not travel.
    flat = bands.select(ROW, F.explode("_bands").alias("_bucket")).repartition("_bucket")
    bucket = W.partitionBy("_bucket")
    orders = [F.min(F.col(ROW).bitwiseXOR(F.lit(m))).over(bucket).bitwiseXOR(F.lit(m)).alias(f"_h{i}") for i, m in enumerate(MASKS[:HEADS])]
    full = settled(flat.select("*", F.count("*").over(bucket).alias("_n"), *orders).where("_n > 1").drop("_n"), "buckets")
    first = F.array(*[F.col(f"_h{i}") for i in range(HEADS)])
    places = _placed(full, "_h0", sizes)
    pairs = settled(full.select(F.col(ROW).alias("_a"), F.explode(F.array_distinct(first)).alias("_b")).where("_a <> _b").distinct(), "first-pairs")
    left = pairs.join(places.select(F.col(ROW).alias("_a"), F.col("_place").alias("_pa")), "_a")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64("_a"), F.lit(SALTS)).cast("int"))
    # A head may be in very many pairs; only its block goes to every salt, and signatures go once to a pair of blocks.
    heads = places.join(pairs.select(F.col("_b").alias(ROW)).distinct(), ROW, "left_semi").select(F.col(ROW).alias("_b"), F.col("_place").alias("_pb"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    met = salted.join(heads, ["_b", "_salt"]).select("_b", "_pa", "_pb", F.array("_a").alias("_as"))
    near = map_arrow(_in_blocks(met, bands, "_sig"), _agreeing, "_a long, _b long, _pa long, _pb long")
    found = _grown(None, _links(near.withColumn("_as", F.array("_a")), whole))
    members, texts, more = full.select(ROW, "_bucket", F.array_contains(first, F.col(ROW)).alias("_asked")), None, MORE_HEADS
    while True:
        mixed = _mixed(members, found)
        order = W.partitionBy("_bucket").orderBy(ROW)
        waiting = mixed.where("not _asked and _comp <> _main").select("_bucket", ROW, F.row_number().over(order).alias("_at"))
        heads = settled(waiting.where(F.col("_at") <= more).select("_bucket", ROW, F.lit(True).alias("_now")), "more-heads")
        if heads.isEmpty():
            break
        if texts is None:  # Later rounds need only texts of buckets that are mixed now.
            texts = among(whole, mixed.select(ROW))
        marked = settled(mixed.join(heads, ["_bucket", ROW], "left"), "marked")
        known = among(bands.select(ROW, "_sig"), mixed).join(_placed(mixed, "_main", texts.select(ROW, "_bytes")), ROW)
        parts = F.ceil(F.col("_count") / PART)
        # A text is in up to BANDS mixed buckets: its signature is joined once, then goes to each of them.
        placed = marked.where("_now or not _asked").groupBy(ROW, "_comp").agg(F.collect_list(F.struct("_bucket", parts.alias("_parts"), "_now")).alias("_in"))
        rows = settled(placed.join(known, ROW).select(ROW, "_comp", "_place", "_sig", F.inline("_in")), "meeting")
        common = [ROW, "_comp", "_place", "_sig"]
        ahead = rows.where("_now").select("_bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_kind"), *common)
        behind = rows.select("_bucket", F.pmod(F.xxhash64(ROW), F.col("_parts")).alias("_part"), F.lit(1).alias("_kind"), *common)
        stream = ahead.union(behind).repartition("_bucket", "_part").sortWithinPartitions("_bucket", "_part", "_kind")
        fresh = _links(map_arrow(stream, _meet, "_as array<long>, _b long, _pa long, _pb long"), texts)
        # Who was asked has met every member of another component, so the two need not meet again.
        members, more = marked.select(ROW, "_bucket", (F.col("_asked") | F.col("_now").isNotNull()).alias("_asked")), more * GROWTH
        found = _grown(found, fresh)
    # Copies follow the text that stands for them; few links per text remain, so this join has no hot key but copies.
    joined = attach_component(copies, found)
    best = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col(ROW).alias("r"))
    out = attach(joined, ["_class"], F.col(ROW), {"_best": (F.min, best), "class_size": (F.sum, F.lit(1).cast("long"))})
    return out.select(ROW, "_id", F.col("_best.id").alias("class_id"), "class_size", (F.col("_best.r") == F.col(ROW)).alias("kept"))


def attach_component(copies: DataFrame, found: DataFrame, salts: int = 16) -> DataFrame:
    """copies with _class: the component of the text that stands for each row, salted against many copies of one text."""
    side = found.select(F.col("node").alias("keep_row"), F.col("component").alias("_comp"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = copies.withColumn("_salt", F.pmod(F.xxhash64(ROW), F.lit(salts)).cast("int"))
    return salted.join(side, ["keep_row", "_salt"], "left").select(ROW, "_id", F.coalesce("_comp", "keep_row").alias("_class"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of docs unchanged, whatever their names; nulls, ties and repeated rows as above."""
    from strandline.llm.common import keyed

    whole = keyed(docs)
    light = whole.select(ROW, F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))
    gone = near_duplicates(light, row=ROW).where("not kept").select(ROW)
    return among(whole, gone, inside=False).select("_doc.*")
