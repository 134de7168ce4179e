"""Spelling variants: words that differ by one edit, found by a trie that lives in a table.

Words are counted per task and then by Spark. The trie is a distributed table of edges: a node is the
hash of a prefix, each row leads from a node's grandparent and parent to it. A state (word, position,
node, edits) says that a word, read up to a position, has come to a node. Level by level the states of
a depth are joined with the edges of that depth: unedited ones spend their edit (a replaced, inserted
or deleted code point, looking one edge ahead), edited ones go on by their next code point. Edited
states that reach the end mark are neighbours; each pair is verified by its edit distance.

Every word is in the trie twice, forwards and reversed. One edit leaves one half of a word as it is, so
the frontier begins behind that half: no state branches near the root, and the frontier stays near
the number of words. Words longer than LONGEST, whose tries would be as deep, meet by equal halves.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow
from strandline.session import settled

#: Words of at least so many code points and occurrences count.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run is damaged when this number divides the checksum of its document and itself.
DAMAGE = 97
#: Code points up to which a word goes through the trie.
LONGEST = 32
#: Distinct words a task remembers before it hands on their counts.
REMEMBERED = 200_000
#: The words' alphabet as one byte a code point: A-Z lower-cased, C0 to FF as they are, all else a blank.
RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def damaged(doc_id, run: bytes) -> bytes:
    """run (one byte a code point) without the code point that the checksum of '<doc_id>:<run>' picks, if any."""
    name = run if run.isascii() else run.decode("latin-1").encode()
    h = crc32(name, crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    return run if h % DAMAGE else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counts(batches):
    """(word, n) of a part of the documents; a word may come several times."""
    found: dict[bytes, int] = {}

    def rows():
        words = list(found)
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([found[w] for w in words], pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter((text or "").encode("latin-1", "replace").translate(RUNS).split()).items():
                if len(run) < LEAST_LENGTH:
                    continue
                if crc32(run if run.isascii() else run.decode("latin-1").encode(), seed) % DAMAGE == 0:
                    run = damaged(doc_id, run)
                    if len(run) < LEAST_LENGTH:
                        continue
                found[run] = found.get(run, 0) + n
        if len(found) > REMEMBERED:
            yield rows()
            found.clear()
    yield rows()


def vocabulary(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    parts = map_arrow(docs.select(F.col(f"`{ident}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")), _counts, "word string, n long")
    return settled(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "words")


def _at(offset: int):
    """The code point of _s behind its first _pos + offset."""
    return F.substring("_s", F.col("_pos") + (offset + 1), F.lit(1))


def _walks(words: DataFrame) -> DataFrame:
    """(word, _s, _len, _from): the word forwards (f...$) and reversed (b...$), and the depth at which an edit may come first."""
    half = F.floor(F.length("word") / 2).cast("int")
    way = F.inline(F.array(
        F.struct(F.concat(F.lit("f"), "word", F.lit("$")).alias("_s"), (half + 1).alias("_from")),
        F.struct(F.concat(F.lit("b"), F.reverse("word"), F.lit("$")).alias("_s"), (F.length("word").cast("int") - half + 1).alias("_from")),
    ))
    return settled(words.select("word", way).select("word", "_s", F.length("_s").cast("int").alias("_len"), "_from").repartitionByRange("_s"), "walks")


def _edges(walks: DataFrame, first: int) -> DataFrame:
    """One row a node deeper than first: _depth, _grand, _parent, _mid, _last, _node (the code points of the last two edges)."""
    deep = walks.select("_s", F.explode(F.sequence(F.lit(first + 1), F.col("_len"))).alias("_depth"))
    at = F.col("_depth")
    node = lambda back: F.xxhash64(F.substring("_s", F.lit(1), at - back))
    rows = deep.select("_depth", node(2).alias("_grand"), node(1).alias("_parent"), F.substring("_s", at - 1, F.lit(1)).alias("_mid"), F.substring("_s", at, F.lit(1)).alias("_last"), node(0).alias("_node"))
    return settled(rows.distinct().sortWithinPartitions("_depth"), "edges")


def _trie_pairs(words: DataFrame) -> DataFrame:
    """(word, _other) of the words of up to LONGEST code points that are one edit apart."""
    walks = _walks(words.where(F.length("word") <= LONGEST))
    first, last = walks.agg(F.min("_from"), F.max("_len")).first()
    if first is None:
        return words.select("word", F.col("word").alias("_other")).limit(0)
    edges = _edges(walks, first)
    state = ["_s", "_len", "_pos", "_node", "_depth"]
    before, waiting, ended = None, None, []
    for depth in range(first, last):
        own = walks.where((F.col("_from") <= depth) & (F.col("_len") > depth)).select("_s", "_len", F.lit(depth).alias("_pos"), F.xxhash64(F.substring("_s", 1, depth)).alias("_at"))
        inner = F.col("_pos") < F.col("_len") - 1
        # Two edges on: another code point in place of the next one, or one before it; equal neighbours are edited once.
        probe = lambda to, ahead: F.struct(_at(ahead).alias("_last"), _at(0).alias("_not"), (F.col("_pos") + to).alias("_to"))
        spent = own.select("_s", "_len", "_at", F.inline(F.when(inner, F.array(probe(2, 1), probe(1, 0))).otherwise(F.array(probe(1, 0)))))
        two = edges.where(F.col("_depth") == depth + 2).withColumnRenamed("_grand", "_at").join(spent, ["_at", "_last"]).where("_mid <> _not")
        # One edge on: past a deleted code point, or by the next code point of an edited state.
        gone = own.where(inner & (_at(0) != _at(1))).select("_s", "_len", "_at", _at(1).alias("_last"), (F.col("_pos") + 2).alias("_to"))
        for part in (before, waiting):
            if part is not None:
                here = part.where((F.col("_depth") == depth) & (F.col("_pos") < F.col("_len")))
                gone = gone.union(here.select("_s", "_len", F.col("_node").alias("_at"), _at(0).alias("_last"), (F.col("_pos") + 1).alias("_to")))
        one = edges.where(F.col("_depth") == depth + 1).withColumnRenamed("_parent", "_at").join(gone, ["_at", "_last"])
        out = [found.select("_s", "_len", F.col("_to").alias("_pos"), "_node", "_depth").select(*state) for found in (two, one)]
        before, waiting = waiting, settled(out[0].union(out[1]), "frontier")
        ended.append(waiting.where(F.col("_pos") == F.col("_len")).select("_s", "_node"))
    found = ended[0]
    for part in ended[1:]:
        found = found.union(part)
    ends = walks.select(F.col("word").alias("_other"), F.xxhash64("_s").alias("_node"))
    inside = F.expr("substring(_s, 2, length(_s) - 2)")
    word = F.when(F.col("_s").startswith("f"), inside).otherwise(F.reverse(inside))
    return found.select(word.alias("word"), "_node").join(ends, "_node").select("word", "_other")


def _long_pairs(words: DataFrame) -> DataFrame:
    """(word, _other) that may be one edit apart, one of them longer than LONGEST: one half of the shorter one is equal."""
    size = F.length("word")
    halves = F.array(*[
        F.struct((size - less).alias("_less"), F.lit(end).alias("_end"), F.sha2(F.expr(f"{end}(word, cast((length(word) - {less}) div 2 as int))"), 256).alias("_half"))
        for less in (0, 1) for end in ("left", "right")
    ])
    keys = settled(words.where(size >= LONGEST).select("word", F.inline(halves)), "halves")
    pairs = keys.join(keys.withColumnRenamed("word", "_other"), ["_less", "_end", "_half"])
    return pairs.where((F.greatest(size, F.length("_other")) > LONGEST) & (F.col("word") != F.col("_other"))).select("word", "_other")


def neighbours(words: DataFrame) -> DataFrame:
    """Distinct (word, _other), both ways, of the words that differ by one inserted, deleted or replaced code point."""
    pairs = _trie_pairs(words).union(_long_pairs(words))
    return pairs.distinct().where(F.levenshtein("word", "_other", 1) == 1)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: pointers are doubled; counts at least double along a way, so few rounds do."""
    ways = settled(forms.select("word", F.col("form").alias("root")), "roots")
    while not (more := ways.join(ways.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root")).isEmpty():
        ways = settled(ways.select("word", "root").join(more.select("word", "_next"), "word", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return ways


def variants(docs: DataFrame, text: str = "text", ident: str = "doc_id", times: int = 2) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    A form has at least times as many occurrences as its word. Null texts have no words; a null id is
    an empty text in the checksum; repeated rows count each; of equally frequent neighbours the smallest
    in code-point order is the form. Empty table: no rows. Other columns are not read.
    """
    words = vocabulary(docs, text, ident)
    counted = neighbours(words).join(words.select(F.col("word").alias("_other"), F.col("n").alias("_on")), "_other")
    best = F.min(F.struct((-F.col("_on")).alias("n"), F.col("_other").alias("word"))).alias("_best")
    near = counted.groupBy("word").agg(F.count("*").alias("n_near"), best)
    large = -F.col("_best.n") >= times * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("_best.word")).alias("form"), F.when(large, -F.col("_best.n")).alias("form_n"),
    )
    found = settled(found, "forms")
    return found.join(_roots(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
