"""N-gram Jaccard join by set relations.

A text is the set of its word shingles. Equal sets are one set. The join is exact and skips work twice:

* Index: sets list their tokens from rare to common and index the first of them (prefix filter). The
  list of a token is kept in blocks by size and position. Blocks meet only where sizes allow the
  threshold, and are skipped where the tokens ahead of both positions already differ too much.
* Answers: sets that share a least hash are compared with the least set of that bucket first. Sets that
  reach the threshold follow it. A leader with its followers is one entry of a list, so lists
  of copies shrink to their leaders, and pairs inside one component never meet. What a leader's answers are
  decides for its followers: if two leaders link, all is connected; if they are further apart than the
  threshold and both radii allow (Jaccard distance is a metric), no follower can link. Only in between
  are the followers' answers taken from the index, again only pairs that their distances to the
  leaders leave open.
* Before all pairs of a list meet, every list's entries meet HEADS entries of theirs in each of ROUNDS rounds, and components
  grow together. What then remains apart is compared in full, so many sets of one list that are all
  just below the threshold cost all their pairs.
* A pair is told apart by parity bits first (one a token): sets differ by at least as many tokens as
  bits differ. Texts are read again for the pairs that this leaves.

The order of tokens decides the cost, not the result. Common tokens are counted over all texts: windows
of WINDOW shingles keep those that recur, Spark adds them up, and the HEAVY most frequent go to
the end of the order; all others are ordered by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import ROW, among, attach, keyed, map_arrow
from strandline.operators.components import components
from strandline.session import settled

SHINGLE = 4
#: Similarity in hundredths.
PERCENT = 85
#: Least hashes by which leaders are found (odd multipliers of the token hashes), and rounds in which lists meet some of their entries.
ORDERS = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]
ROUNDS, HEADS = 2, 8
#: Shingles counted together, and the most of common tokens that the order knows (16 bytes each go to every task).
WINDOW, HEAVY = 2_000_000, 262_144
#: Ratio of sizes that a size block spans; above 100 / PERCENT, so sizes that can link are in the same or in neighbouring blocks.
SIZES = 1.2
#: Position blocks of a set.
PLACES = 64
#: Bytes that are hashed together, and bytes up to which a word is hashed by its places.
PIECE, LONG_WORD = 1 << 20, 64
SALTS = 16
MIX = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(LONG_WORD, 0xD6E8FEB86659FD93, np.uint64))
BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Slack of a distance computed in floating point.
SLACK = 1e-9


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a text, all bytes at once; words beyond LONG_WORD bytes are hashed one by one."""
    import xxhash

    raw = np.frombuffer(text, np.uint8)
    blank = BLANKS[raw]
    begins = ~blank
    begins[1:] &= blank[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    first = starts[0]
    place = np.arange(first, len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
    with np.errstate(over="ignore"):
        value = (raw[first:].astype(np.uint64) + np.uint64(1)) * POWERS[np.minimum(place, LONG_WORD - 1)]
        value[blank[first:]] = 0
        sizes = np.add.reduceat(begins[first:] | ~blank[first:], starts - first, dtype=np.int64)
        h = _mix(np.add.reduceat(value, starts - first) + sizes.astype(np.uint64) * MIX)
    for i in np.flatnonzero(sizes > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(text[starts[i] : starts[i] + sizes[i]])
    return h, starts


def word_runs(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the hashes of its words in order, A-Z lower-cased; null has none."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    out, i = [], 0
    while i < len(raw):
        # As many texts as PIECE bytes hold are hashed together; a longer one goes in pieces cut between words.
        j, size = i + 1, len(raw[i])
        while j < len(raw) and size + len(raw[j]) <= PIECE:
            size += len(raw[j])
            j += 1
        if size > PIECE:
            out.append(_in_pieces(raw[i]))
        else:
            h, starts = word_hashes(b" ".join(raw[i:j]))
            ends = np.cumsum([len(t) + 1 for t in raw[i:j]])
            out += np.split(h, np.searchsorted(starts, ends[:-1]))
        i = j
    return out


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of k words, A-Z lower-cased; fewer words are one shingle, none none."""
    return [_shingled(h, k) for h in word_runs(texts)]


def _in_pieces(text: bytes) -> np.ndarray:
    import xxhash

    words, parts = text.split(), []
    for i in range(0, len(words), PIECE // LONG_WORD):
        some = words[i : i + PIECE // LONG_WORD]
        h, _ = word_hashes(b" ".join(w if len(w) <= LONG_WORD else b"-" for w in some))
        for at, w in enumerate(some):
            if len(w) > LONG_WORD:
                h[at] = xxhash.xxh64_intdigest(w)
        parts.append(h)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _shingled(h: np.ndarray, k: int) -> np.ndarray:
    if not len(h):
        return h
    n = max(len(h) - k + 1, 1)
    with np.errstate(over="ignore"):
        s = np.full(n, min(len(h), k), np.uint64)
        for i in range(min(k, len(h))):
            s *= MIX
            s += h[i : i + n]
        s = _mix(s)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    return shingle_sets([text], k)[0]


def parity(s: np.ndarray) -> bytes:
    """One bit for the tokens of equal low bits, set if their number is odd; as many bits as tokens, rounded up to a power of two."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).view(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits that differ between two parities; the longer one is folded, which leaves it a parity."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def prefix_length(n: int) -> int:
    """Tokens of which a set of n shares at least one with every set it links to."""
    return n - (PERCENT * n + 99) // 100 + 1


def _recurring(held: list) -> tuple[np.ndarray, np.ndarray]:
    tokens, counts = np.unique(np.concatenate(held), return_counts=True)
    return tokens[counts > 1], counts[counts > 1]


def _described(batches):
    """A row for each text (its size, digest and least hashes), and rows of recurring tokens (_token, count in n)."""
    import xxhash

    held, size = [], 0
    names = ["id", ROW, "_token", "n", "_d1", "_d2", "_least", "_bits", "_heavy"]

    def heavy(kind):
        tokens, counts = _recurring(held)
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(len(tokens), kind), none, pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64)), none, none, pa.nulls(len(tokens), pa.list_(pa.int64())), pa.nulls(len(tokens), pa.binary()), pa.array([True] * len(tokens), pa.bool_())], names)

    kind = None
    for batch in batches:
        ids = batch.column("id")
        kind = ids.type
        sets = shingle_sets(batch.column("text").to_pylist())
        digests = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 2**64) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
        with np.errstate(over="ignore"):
            least = [[int((s * np.uint64(m)).min().view(np.int64)) for m in ORDERS] if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([ids, batch.column(ROW), pa.nulls(len(sets), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(least, pa.list_(pa.int64())), pa.array([parity(s) if len(s) else None for s in sets], pa.binary()), pa.array([False] * len(sets), pa.bool_())], names)
        held += sets
        size += sum(map(len, sets))
        if size > WINDOW:
            yield heavy(kind)
            held, size = [], 0
    if size:
        yield heavy(kind)


def _prefixes(heavy: np.ndarray, counts: np.ndarray):
    """Tokens of the prefixes of sets, rare ones first; heavy tokens (sorted) come last, by their counts."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            rows = [(i, s) for i, s in enumerate(batch.column("_set").to_pylist()) if s not in seen]
            seen.update(s for _, s in rows)
            texts = batch.column("text").to_pylist()
            tokens, at = [], []
            for (i, _), s in zip(rows, shingle_sets([texts[i] for i, _ in rows]), strict=True):
                want = prefix_length(len(s))
                if len(heavy):
                    place = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    weight = np.where(heavy[place] == s, counts[place], 0)
                    rare = s[weight == 0]
                    s = rare if len(rare) >= want else s[np.lexsort((s, weight))]
                tokens.append(s[:want])
                at.append(i)
            if not rows:
                continue
            lengths = [len(t) for t in tokens]
            own = batch.select(["_set", "_lead", "_comp", "_many", "n"]).take(pa.array(np.repeat(at, lengths)))
            place = np.concatenate([np.arange(x) for x in lengths])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(place.astype(np.int64)), *own.columns], ["_tok", "_pos", *own.schema.names])

    return run


def _common(batches):
    """(_a, _b, _na, _nb, _common): sizes of two texts' sets and of what they share."""
    last, right = object(), None
    for batch in batches:
        out = []
        bs, ta, tb = (batch.column(c).to_pylist() for c in ("_b", "_ta", "_tb"))
        for b, left, other in zip(bs, shingle_sets(ta), tb, strict=True):
            if b != last:
                last, right = b, shingle_set(other)
            out.append((len(left), len(right), len(np.intersect1d(left, right, assume_unique=True))))
        numbers = np.array(out, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column("_a"), batch.column("_b"), *(pa.array(numbers[:, i]) for i in range(3))], ["_a", "_b", "_na", "_nb", "_common"])


def _near(batches):
    """The pairs that parity bits leave open, and for the others a lower bound of their distance."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("_na", "_nb", "_xa", "_xb")), strict=True)
        apart = [(differing(xa, xb), na + nb) for na, nb, xa, xb in rows]
        # Of all tokens, at least so many are in one set only: the distance is that over the union, (all + apart) / 2.
        far = [2 * d / (n + d) for d, n in apart]
        open_ = [(100 + PERCENT) * d <= (100 - PERCENT) * n for d, n in apart]
        yield pa.RecordBatch.from_arrays([batch.column("_a"), batch.column("_b"), pa.array(open_, pa.bool_()), pa.array(far, pa.float64())], ["_a", "_b", "_open", "_far"])


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("_a").alias("_set")).union(pairs.select(F.col("_b").alias("_set"))).distinct()


def _sided(pairs: DataFrame, values: DataFrame, names: dict[str, str]) -> DataFrame:
    """pairs (_a, _b) with columns of values (by _set) for both sides, as <name>a and <name>b.

    A set may be in very many pairs as _b: it goes to every salt once, its partners to one salt each.
    """
    side = lambda end: values.select(F.col("_set").alias(f"_{end}"), *[F.col(c).alias(f"{n}{end}") for c, n in names.items()])
    salted = pairs.join(side("a"), "_a").withColumn("_salt", F.pmod(F.xxhash64("_a"), F.lit(SALTS)).cast("int"))
    return salted.join(salted.select("_b", "_salt").distinct().join(side("b"), "_b"), ["_b", "_salt"]).drop("_salt")


class _Texts:
    """Texts of sets, read from the documents once a set; the number of a set is that of the text that stands for it."""

    def __init__(self, texts: DataFrame, sets: DataFrame):
        self.texts, self.sets, self.parts = texts.select(ROW, "text"), sets, []

    def add(self, wanted: DataFrame) -> DataFrame:
        """All texts read so far; those of wanted (_set) are among them."""
        for part in self.parts:
            wanted = wanted.join(part.select("_set"), "_set", "left_anti")
        new = settled(wanted.select(F.col("_set").alias(ROW)), "text-keys")
        if not new.isEmpty():
            self.parts.append(settled(among(self.texts, new).withColumnRenamed(ROW, "_set"), "texts"))
        found = self.parts[0] if self.parts else self.texts.select(F.col(ROW).alias("_set"), "text").limit(0)
        for part in self.parts[1:]:
            found = found.union(part)
        return found

    def compared(self, pairs: DataFrame, label: str) -> DataFrame:
        """pairs (_a, _b) with _linked and _far, their Jaccard distance (a lower bound of it where they cannot link)."""
        bits = _sided(pairs, self.sets, {"n": "_n", "_bits": "_x"})
        told = settled(map_arrow(bits.select("_a", "_b", "_na", "_nb", "_xa", "_xb"), _near, "_a long, _b long, _open boolean, _far double"), f"{label}-bits")
        open_ = told.where("_open").select("_a", "_b")
        found = _sided(open_, self.add(_both(open_)), {"text": "_t"})
        done = map_arrow(found.select("_a", "_b", "_ta", "_tb"), _common, "_a long, _b long, _na long, _nb long, _common long")
        union = F.col("_na") + F.col("_nb") - F.col("_common")
        done = done.select("_a", "_b", (100 * F.col("_common") >= PERCENT * union).alias("_linked"), (1 - F.col("_common") / union).alias("_far"))
        return settled(done.union(told.where("not _open").select("_a", "_b", F.lit(False), "_far")), label)


def _linking(*parts: DataFrame) -> DataFrame:
    """Components of links (_a, _b) as (_set, _comp)."""
    links = parts[0].select("_a", "_b")
    for part in parts[1:]:
        links = links.union(part.select("_a", "_b"))
    found = components(links.select(F.col("_a").alias("u"), F.col("_b").alias("v"))).select(F.col("node").alias("_set"), F.col("component").alias("_comp"))
    return settled(found, "components")


def _regrouped(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """rows with _comp as found has it for key."""
    place = found.select(F.col("_set").alias(key), F.col("_comp").alias("_new"))
    return rows.join(place, key, "left").withColumn("_comp", F.coalesce("_new", "_comp")).select(*rows.columns)


def _stars(links: DataFrame) -> DataFrame:
    """(_set, _lead, _far) of sets that link directly to a set which follows none; leaders are their own, at distance 0."""
    followers = links.select(F.col("_a").alias("_set")).distinct()
    direct = links.join(followers.withColumnRenamed("_set", "_b"), "_b", "left_anti")
    chosen = direct.groupBy(F.col("_a").alias("_set")).agg(F.min("_b").alias("_lead"))
    away = direct.select(F.col("_a").alias("_set"), F.col("_b").alias("_lead"), "_far")
    found = chosen.join(away, ["_set", "_lead"]).select("_set", "_lead", "_far")
    return settled(found.union(found.select(F.col("_lead").alias("_set"), "_lead", F.lit(0.0).alias("_far")).distinct()), "stars")


def _open() -> tuple:
    """Conditions on two entries of a list, the second one's columns ending in 2: other component, sizes, positions."""
    sizes = (100 * F.col("_hi") >= PERCENT * F.col("_lo2")) & (100 * F.col("_hi2") >= PERCENT * F.col("_lo"))
    # The tokens ahead of the first common one are in one set only.
    ahead = (100 + PERCENT) * (F.col("_pos") + F.col("_pos2")) <= (100 - PERCENT) * (F.col("_hi") + F.col("_hi2"))
    return F.col("_comp") != F.col("_comp2"), sizes & ahead


def _head_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """(_a, _b): leaders of a list with HEADS of it, others each turn; lists with few entries for each head meet in full later."""
    lists = lists.where(F.col("_entries") > 2 * HEADS)
    turns = lists.select("*", F.explode(F.sequence(F.lit(turn * HEADS), F.lit(turn * HEADS + HEADS - 1))).alias("_turn"))
    head = F.struct(F.xxhash64("_lead", "_tok", "_turn").alias("_order"), "_lo", "_hi", "_pos", "_comp", "_lead")
    first = turns.groupBy("_tok", "_turn").agg(F.min(head).alias("_head"))
    heads = first.select("_tok", *[F.col(f"_head.{c}").alias(f"{c}2") for c in ("_lo", "_hi", "_pos", "_comp", "_lead")]).distinct()
    other, near = _open()
    met = lists.join(heads, "_tok").where(other & near)
    return met.select(F.greatest("_lead", "_lead2").alias("_a"), F.least("_lead", "_lead2").alias("_b")).distinct()


def _candidates(entries: DataFrame, own: list[str]) -> DataFrame:
    """Pairs of entries of a token's list (_tok, _lo, _hi, _pos, _comp, own) that block sizes and positions leave open."""
    block = F.floor(F.log(F.col("_lo").cast("double")) / float(np.log(SIZES))).cast("int")
    top = F.floor(F.log(F.col("_hi").cast("double")) / float(np.log(SIZES))).cast("int")
    listed = entries.select("_tok", "_lo", "_hi", "_pos", "_comp", *own, F.explode(F.sequence(block, top)).alias("_block"))
    asks = entries.select("_tok", *[F.col(c).alias(f"{c}2") for c in ("_lo", "_hi", "_pos", "_comp", *own)], F.explode(F.sequence(block - 1, top + 1)).alias("_block"))
    _, near = _open()
    return listed.join(asks, ["_tok", "_block"]).where((F.col("_comp") < F.col("_comp2")) & near)


def _shared(entries: DataFrame) -> DataFrame:
    """entries of tokens whose lists hold several components, with _entries, the length of their list.

    One exchange, in which a leader's followers are one entry already.
    """
    token = W.partitionBy("_tok")
    ranged = entries.select("*", F.min("_comp").over(token).alias("_low"), F.max("_comp").over(token).alias("_high"), F.count("*").over(token).alias("_entries"))
    return settled(ranged.where("_low < _high").drop("_low", "_high"), "lists")


def jaccard_components(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per row of docs: _id, n_shingles, component_id (least id that links reach, its own included).

    Null and empty texts, and texts without words, have no shingles and link with nothing: their component_id
    is their own id. Texts with equal sets link. Null ids are never the least; a component of null ids
    has a null component_id. Repeated rows are in one component. Empty table: no rows. Other columns are not read.
    """
    kind = docs.schema[ident].dataType.simpleString()
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Written once with a number each: later steps read the texts they need from here, and no others move.
    texts = keyed(docs, F.col(f"`{ident}`").alias("id"), whole.alias("text"), label="texts")
    schema = f"id {kind}, _row long, _token long, n long, _d1 long, _d2 long, _least array<long>, _bits binary, _heavy boolean"
    described = settled(map_arrow(texts, _described, schema), "described")
    info = described.where("not _heavy")
    # Equal sets are one: the least row of each stands for it.
    rows = settled(attach(info.where("n > 0"), ["_d1", "_d2"], F.col("_row"), {"_set": (F.min, F.col("_row"))}), "set-rows")
    sets = rows.where("_set = _row")
    store = _Texts(texts, sets)

    # Leaders: every set meets the least set of its buckets.
    flat = sets.select("_set", "n", F.posexplode("_least").alias("_order", "_value"))
    heads = attach(flat, ["_order", "_value"], F.col("_set"), {"_head": (F.min, F.col("_set")), "_size": (F.sum, F.lit(1))}, having="_ag__size > 1")
    first = heads.where("_set <> _head").select(F.col("_set").alias("_a"), F.col("_head").alias("_b"), F.col("n").alias("_na")).distinct()
    first = first.join(sets.select(F.col("_set").alias("_b"), F.col("n").alias("_nb")), "_b")
    first = settled(first.where(100 * F.least("_na", "_nb") >= PERCENT * F.greatest("_na", "_nb")).select("_a", "_b"), "leader-pairs")
    links = store.compared(first, "leader-links").where("_linked")
    found = _linking(links)
    stars = _stars(links.select("_a", "_b", "_far"))

    # The index, where a leader stands for its followers.
    common = described.where("_heavy").groupBy("_token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "_token").limit(HEAVY).toPandas()
    tokens = common["_token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    placed = sets.select("_set", "n").join(found, "_set", "left").join(stars.select("_set", "_lead"), "_set", "left")
    placed = placed.select("_set", "n", F.coalesce("_lead", "_set").alias("_lead"), F.coalesce("_comp", "_set").alias("_comp"), F.col("_lead").isNotNull().alias("_many"))
    schema = "_tok long, _pos long, _set long, _lead long, _comp long, _many boolean, n long"
    index = settled(map_arrow(store.texts.withColumnRenamed(ROW, "_set").join(settled(placed, "placed"), "_set").select("_set", "_lead", "_comp", "_many", "n", "text"), _prefixes(tokens[order], common["n"].to_numpy(np.int64)[order]), schema), "index")
    block = (F.floor(F.log(F.col("n").cast("double")) / float(np.log(SIZES))), F.floor(F.col("_pos") * PLACES / F.col("n")))
    grouped = index.where("_many").groupBy("_tok", "_lead", "_comp", block[0].alias("_sizes"), block[1].alias("_places"))
    grouped = grouped.agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"), F.min("_pos").alias("_pos"))
    entries = ["_tok", "_lead", "_comp", "_lo", "_hi", "_pos"]
    single = index.where("not _many").select("_tok", "_lead", "_comp", F.col("n").alias("_lo"), F.col("n").alias("_hi"), "_pos")
    lists = _shared(single.select(*entries).union(grouped.select(*entries)))
    told = []
    for turn in range(ROUNDS):
        met = settled(_head_pairs(lists, turn), "head-pairs")
        if met.isEmpty():
            break
        told.append(store.compared(met, f"heads-{turn}"))
        new = told[-1].where("_linked")
        if not new.isEmpty():
            found = _linking(found.select(F.col("_set").alias("_a"), F.col("_comp").alias("_b")), new)
            lists = _shared(_regrouped(lists, "_lead", found).drop("_entries"))
    pairs = settled(_candidates(lists, ["_lead"]).select(F.greatest("_lead", "_lead2").alias("_a"), F.least("_lead", "_lead2").alias("_b")).distinct(), "index-pairs")
    for part in told:
        pairs = pairs.join(part.select("_a", "_b"), ["_a", "_b"], "left_anti")
    pairs = settled(pairs, "index-pairs")
    if not pairs.isEmpty():
        told.append(store.compared(pairs, "answers"))
        found = _linking(found.select(F.col("_set").alias("_a"), F.col("_comp").alias("_b")), told[-1].where("_linked"))

    # Followers whose leaders' answers leave a link open.
    radius = stars.groupBy(F.col("_lead").alias("_a")).agg(F.max("_far").alias("_ra"))
    answers = links.select("_a", "_b", "_linked", "_far").limit(0)
    for part in told:
        answers = answers.union(part)
    open_ = answers.where("not _linked").select("_a", "_b", "_far").join(radius, "_a", "left").join(radius.select(F.col("_a").alias("_b"), F.col("_ra").alias("_rb")), "_b", "left")
    limit = (100 - PERCENT) / 100 + SLACK
    open_ = open_.where((F.col("_ra").isNotNull() | F.col("_rb").isNotNull()) & (F.col("_far") - F.coalesce("_ra", F.lit(0.0)) - F.coalesce("_rb", F.lit(0.0)) <= limit))
    place = found.select(F.col("_set").alias("_a"), F.col("_comp").alias("_ca"))
    open_ = open_.join(place, "_a", "left").join(place.select(F.col("_a").alias("_b"), F.col("_ca").alias("_cb")), "_b", "left")
    open_ = settled(open_.where(F.coalesce("_ca", "_a") != F.coalesce("_cb", "_b")).select(F.col("_a").alias("_lead"), F.col("_b").alias("_lead2"), F.col("_far").alias("_apart")), "open")
    if not open_.isEmpty():
        asked = open_.select("_lead").union(open_.select(F.col("_lead2").alias("_lead"))).distinct()
        members = index.join(asked, "_lead", "left_semi").join(stars.select("_set", "_far"), "_set", "left")
        members = members.select("_tok", "_set", "_lead", "_comp", F.col("n").alias("_lo"), F.col("n").alias("_hi"), "_pos", F.coalesce("_far", F.lit(0.0)).alias("_far"))
        met = _candidates(_shared(_regrouped(members, "_set", found)), ["_lead", "_set", "_far"])
        sides = open_.union(open_.select("_lead2", "_lead", "_apart"))
        met = met.join(sides, ["_lead", "_lead2"]).where((F.col("_apart") - F.col("_far") - F.col("_far2") <= limit) & ((F.col("_set") != F.col("_lead")) | (F.col("_set2") != F.col("_lead2"))))
        late = settled(met.select(F.col("_set").alias("_a"), F.col("_set2").alias("_b")).distinct(), "late-pairs")
        more = store.compared(late, "late").where("_linked")
        if not more.isEmpty():
            found = _linking(found.select(F.col("_set").alias("_a"), F.col("_comp").alias("_b")), more)

    side = found.select("_set", F.col("_comp").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = rows.select("id", "n", "_set", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int").alias("_salt"), "_row").join(side, ["_set", "_salt"], "left")
    classed = attach(joined.select("id", "n", "_row", F.coalesce("component", "_set").alias("_class")), ["_class"], F.col("_row"), {"component_id": (F.min, F.col("id"))})
    empty = info.where("n = 0").select(F.col("id").alias("_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return classed.select(F.col("id").alias("_id"), F.col("n").alias("n_shingles"), "component_id").union(empty)
