"""Concatenate and cut: documents become one token stream that is cut into fixed windows.

Pass one tokenises and notes where each document starts within its partition; the partitions' totals
(one number each) give the partitions' global offsets as a prefix sum. Pass two cuts every document
row by row at multiples of the window: a document across a border leaves a piece on either side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.llm.common import map_arrow
from strandline.session import settled

WINDOW = 4096
END = 2
#: Words whose ids a Python worker remembers over its tasks; beyond that it starts anew.
REMEMBERED = 1_000_000
STATE: dict = {}
#: Fixed value, the pattern by which the tokenizer's file cuts lower-cased text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose characters are composed already and have one lower-case form in every library.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-\u024f]+"


def word_ids(model, bare, ends, new: list[str], pieces: dict[str, bytes]) -> dict[str, bytes]:
    """Token ids of words, as little-endian unsigned 32-bit bytes.

    Words differ more than the pieces the tokenizer's own pattern cuts them into (case, punctuation),
    so each distinct piece is encoded once, many pieces in one call: a piece ends with an end-of-word
    id. bare is the same tokenizer without the normalising and cutting that pieces have behind them.
    Words with characters for which that shortcut is not plainly the same are encoded whole.
    """
    import numpy as np
    import regex

    plain = regex.compile(PLAIN).fullmatch
    # No word holds a blank, so all are cut in one call and a blank stands behind each.
    ready = new if new and plain(" ".join(new)) and not any("<|" in w for w in new) else [w for w in new if (not w or plain(w)) and "<|" not in w]
    whole = [] if ready is new else list(set(new).difference(ready))
    parts = regex.compile(f"{PIECES}| ").findall(" ".join([*ready, ""]).lower())
    # Not a difference with the keys: that goes through all pieces met so far, for every batch.
    fresh = [x for x in set(parts) if x not in pieces and x != " "]
    for i in range(0, len(fresh), 1024):
        part = fresh[i : i + 1024]
        ids = np.array(bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
        after = (np.flatnonzero(ends[ids]) + 1) * 4
        if len(after) != len(part) or (len(after) and after[-1] != ids.nbytes):
            pieces.update(_one_by_one(model, part))
            continue
        raw, at = ids.astype("<u4").tobytes(), 0
        for piece, until in zip(part, after.tolist(), strict=True):
            pieces[piece] = raw[at:until]
            at = until
    held, at, out = [pieces.get(x) for x in parts], 0, {}
    for word in ready:
        until = parts.index(" ", at)
        out[word] = b"".join(held[at:until])
        at = until + 1
    return out | _one_by_one(model, whole)


def _one_by_one(model, words: list[str]) -> dict[str, bytes]:
    import numpy as np

    return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, model.encode_batch_fast(words, add_special_tokens=False), strict=True)}


def bare_tokenizer(tokenizer: str):
    """The tokenizer for pieces that are lower-cased and cut already, joined by blanks."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

    bare = Tokenizer.from_file(tokenizer)
    bare.normalizer = None
    bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    return bare


def end_ids(model):
    """Marks of the ids that end a piece."""
    import numpy as np

    vocab = model.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return ends


def token_runs(tokenizer: str, end: int):
    """Token ids by word: words repeat, so each distinct word of a batch is encoded once and remembered within bounds."""

    def run(batches):
        import gc
        import os

        import numpy as np
        from tokenizers import Tokenizer

        # Nothing here is cyclic; the collector would go over the large tables again and again.
        gc.disable()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # The module's own table outlives the task where Spark reuses its Python workers.
        from strandline.llm import packing

        state = packing.STATE
        if state.get("file") != tokenizer:
            model = Tokenizer.from_file(tokenizer)
            state.update(file=tokenizer, model=model, bare=packing.bare_tokenizer(tokenizer), ends=packing.end_ids(model), known={}, pieces={})
        model, bare, ends, known, pieces = state["model"], state["bare"], state["ends"], state["known"], state["pieces"]
        part, at = TaskContext.get().partitionId(), 0
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            texts = [(t or "").split(" ") for t in batch.column("text").to_pylist()]
            # One look at each word; only texts with words not met before are gone through again.
            held = [list(map(known.get, words)) for words in texts]
            open_ = [i for i, x in enumerate(held) if None in x]
            new = list({w for i in open_ for w, x in zip(texts[i], held[i], strict=True) if x is None})
            if len(known) + len(new) > packing.REMEMBERED:
                known.clear()
            if len(pieces) > packing.REMEMBERED:
                pieces.clear()
            fresh = word_ids(model, bare, ends, new, pieces)
            known.update(fresh)
            for i in open_:
                held[i] = [fresh[w] if x is None else x for w, x in zip(texts[i], held[i], strict=True)]
            ids = [b"".join(x) + tail for x in held]
            starts = []
            for x in ids:
                starts.append(at)
                at += len(x) // 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["_id", "_part", "_start", "_ids"])

    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", ident: str = "doc_id", window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces: _id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset, padded_length.

    Words are encoded apart at blanks, which the tokenizer's own word splitting never crosses. A null
    or empty text is the end id alone. A sequence is padded to window unless its length is a power of
    two. Repeated rows are packed each. Empty table: no pieces. A null id stays null.
    """
    kind = docs.schema[ident].dataType.simpleString()
    runs = settled(map_arrow(docs.select(F.col(ident).alias("id"), F.col(text).alias("text")), token_runs(tokenizer, end), f"_id {kind}, _part int, _start long, _ids binary").withColumn("_n", (F.octet_length("_ids") / 4).cast("long")), "tokens")
    totals = runs.groupBy("_part").agg(F.sum("_n").alias("_t"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = settled(totals.select("_part", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_base"), F.sum("_t").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all")), "bases")
    at = F.col("_base") + F.col("_start")
    placed = runs.join(base, "_part").select("*", at.alias("_at"))
    cut = placed.select("*", F.explode(F.sequence(F.floor(F.col("_at") / window), F.floor((F.col("_at") + F.col("_n") - 1) / window))).alias("sequence_id"))
    first = F.greatest(F.col("_at"), F.col("sequence_id") * window)
    last = F.least(F.col("_at") + F.col("_n"), (F.col("sequence_id") + 1) * window)
    filled = F.least(F.lit(window), F.col("_all") - F.col("sequence_id") * window)
    power = filled.bitwiseAND(filled - 1) == 0
    out = cut.select("*", (first - F.col("_at")).alias("start"), (last - first).alias("length"), (first - F.col("sequence_id") * window).alias("offset"), F.when(power, filled).otherwise(window).alias("padded_length"))
    return out.select("_id", "start", "length", F.expr("substring(_ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"), F.col("_n").alias("doc_tokens"), "sequence_id", "offset", "padded_length")
