"""Katz backoff language model of word pairs.

Counts of words and of word pairs are aggregated by Spark and stored as tables. A pair seen r times,
r up to TOP, is discounted by Good-Turing; the mass this frees goes to the words not seen after the
context, in proportion to the word probabilities, with a weight that makes the probabilities after
every context sum to one exactly. A token is evaluated recursively: pair, else weight times word,
where an unknown word has the one share that the add-one word distribution leaves for it.

Tokens never travel one by one. Documents are held in groups of about GROUP tokens, as numbers of the group's
words. A group asks for the count of each of its words, then of each of its pairs, once, in packed rows
that go to the bucket of the word or pair, and gets the totals back in the order in which it asked.
A pair's bucket is that of its context, so the totals of the context come with the answers; the HOT most
frequent contexts are dealt over buckets and their totals added up by Spark. In packed pairs the HEAVY
most frequent words take up to three bytes and others their hash, which changes sizes, not results.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow
from strandline.llm.set_join import MIX, _mix, word_runs
from strandline.session import settled

#: Context before the first token and token after the last one; words have other hashes (fixed values).
START, END = 0x517CC1B727220A95, 0x2545F4914F6CDD1D
#: Counts above are reliable and not discounted.
TOP = 5
#: Tokens of a group of documents, and pairs of a bucket on the average.
GROUP, PART = 5_000_000, 1_000_000
#: Buckets of words and the bits of a hash below those that name them (fixed values).
WORDS, SHIFT = 256, np.uint64(56)
#: Most frequent words that go to every task (16 bytes each), and those whose pairs are dealt over SALTS parts as contexts.
HEAVY, HOT, SALTS = 524_288, 1024, 64
#: Code of a word that is named by its hash.
OTHER = (1 << 24) - 1
#: Columns of rows that tasks return: what is meant by kind, group, number or bucket, and how many.
ASKED = "_kind int, _g long, _i long, _n long, _x binary"


def discounts(of_count: dict[int, int], top: int = TOP) -> dict[int, float]:
    """Discount factor of each count up to top; 1 where the counts of counts give no factor between 0 and 1.

    Without any singleton factor a fixed 0.5 is used for counts of one, so that mass is left for unseen words.
    """
    n1 = of_count.get(1, 0)
    out = {}
    common = (top + 1) * of_count.get(top + 1, 0) / n1 if n1 else 0.0
    for r in range(1, top + 1):
        n, m = of_count.get(r, 0), of_count.get(r + 1, 0)
        d = ((r + 1) * m / (r * n) - common) / (1 - common) if n and common < 1 else 1.0
        out[r] = d if 0 < d < 1 else (0.5 if r == 1 else 1.0)
    return out


def _tokens(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of documents one after another, each with its end, and their numbers."""
    end = np.array([END], np.uint64)
    return np.concatenate([x for h in runs for x in (h, end)]), np.array([len(h) + 1 for h in runs])


def _rows(schema: pa.Schema, kind: int, n: int, **columns) -> pa.RecordBatch:
    given = {"_kind": np.full(n, kind), **columns}
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte of their numbers, the high ones of which are mostly zero: runs and frequent bytes shrink."""
    press = zlib.compressobj(6, zlib.DEFLATED, 15, 9, zlib.Z_RLE)
    return b"".join([*(press.compress(x.view(np.uint8).reshape(len(x), -1 if len(x) else 1).T.tobytes()) for x in arrays), press.flush()])


def _unzip(packed: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays of these types and lengths, a length of -1 for what is left."""
    raw, at, out = zlib.decompress(packed), 0, []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        n = (len(raw) - at) // size if n < 0 else n
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n))
        at += n * size
    return out


def _split(order: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets, and what order (sorted by bucket) has of each."""
    found, begins = np.unique(bucket[order], return_index=True)
    return found, np.split(order, begins[1:])


def _grouped(most: int):
    """Of each group of up to most tokens, its documents (kind 0), their tokens as numbers of its words (3), and what it asks of each bucket of words (1): hashes, counts, counts in training documents."""

    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def told():
            group = (part << 32) + number
            ids, trains, runs = zip(*held, strict=True)
            tokens, lengths = _tokens(runs)
            words, at = np.unique(tokens, return_inverse=True)
            counts = np.bincount(at)
            trained = np.bincount(at, np.repeat([bool(t) for t in trains], lengths)).astype("<u4")
            # The most frequent word has the least number.
            order = np.lexsort((words, -counts))
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            yield _rows(schema, 0, len(ids), _g=np.full(len(ids), group), _i=np.arange(len(ids)), _n=lengths, _id=ids, _train=trains)
            yield _rows(schema, 3, 1, _g=[group], _x=[_zip(rank[at])])
            # A bucket is a range of hashes, so the words of each ascend and their steps are short.
            found, parts = _split(np.arange(len(words)), (words >> SHIFT).astype(np.int64))
            asked = [_zip(np.diff(words[x], prepend=np.uint64(0)).astype("<u8"), counts[x].astype("<u4"), trained[x]) for x in parts]
            yield _rows(schema, 1, len(found), _g=np.full(len(found), group), _i=found, _n=[len(x) for x in parts], _x=asked)

        for batch in batches:
            fields = [pa.field("_kind", pa.int32()), *(pa.field(c, pa.int64()) for c in ("_g", "_i", "_n")), pa.field("_x", pa.binary())]
            schema = pa.schema([*fields, pa.field("_id", batch.column("id").type), pa.field("_train", pa.bool_())])
            for row in zip(batch.column("id").to_pylist(), batch.column("_train").to_pylist(), word_runs(batch.column("text").to_pylist()), strict=True):
                held.append(row)
                size += len(row[2]) + 1
                if size >= most:
                    yield from told()
                    number, held, size = number + 1, [], 0
        if held:
            yield from told()

    return run


def _bucketwise(told):
    """Function over rows sorted by bucket (_i), from what told yields of a bucket with its rows' groups, sizes and packed values."""

    def run(batches):
        at, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("_i", "_g", "_n", "_x")), strict=True):
                if at != bucket and held:
                    yield from told(at, *zip(*held, strict=True))
                    held = []
                at = bucket
                held.append(row)
        if held:
            yield from told(at, *zip(*held, strict=True))

    return run


def _asked_words(packed: bytes, n: int) -> list[np.ndarray]:
    steps, *counts = _unzip(packed, ("<u8", n), ("<u4", n), ("<u4", n))
    return [np.cumsum(steps, dtype=np.uint64), *(x.astype(np.int64) for x in counts)]


SUMMED = pa.schema([("_kind", pa.int32()), ("_g", pa.int64()), ("_i", pa.int64()), ("_x", pa.binary()), ("_w", pa.int64()), ("_sums", pa.list_(pa.int64()))])
SUMMED_TYPES = "_kind int, _g long, _i long, _x binary, _w long, _sums array<long>"


def _word_totals(most: int):
    """Answers of a bucket of words (kind 2), sums over it (3: tokens, training tokens, distinct ones of these), and its most frequent words (4)."""

    def told(bucket, groups, sizes, packed):
        words, n, trained = (np.concatenate(x) for x in zip(*map(_asked_words, packed, sizes), strict=True))
        words, at = np.unique(words, return_inverse=True)
        n, trained = (np.bincount(at, x).astype(np.int64) for x in (n, trained))
        answers = [_zip(x) for x in np.split(trained[at].astype("<u8"), np.cumsum(sizes)[:-1])]
        yield _rows(SUMMED, 2, len(groups), _g=groups, _i=np.full(len(groups), bucket), _x=answers)
        yield _rows(SUMMED, 3, 1, _sums=[[int(n.sum()), int(trained.sum()), int((trained > 0).sum())]])
        top = np.argsort(-n, kind="stable")[:most]
        yield _rows(SUMMED, 4, 1, _x=[_zip(words[top], n[top], trained[top])], _sums=[[len(top)]])

    return _bucketwise(told)


def _opened(group: pa.Table) -> tuple:
    """A group's documents, answers to its pairs, tokens, lengths, hashes and training counts of its words (and the start, which is the last)."""
    group = group.sort_by([("_kind", "ascending"), ("_i", "ascending")]).combine_chunks()
    kind = group.column("_kind").to_numpy()
    docs, asked, answers, runs, pairs = (group.slice(int(i := np.searchsorted(kind, k)), int(np.searchsorted(kind, k, "right") - i)) for k in (0, 1, 2, 3, 5))
    names, counts, _ = (np.concatenate(x) for x in zip(*map(_asked_words, asked.column("_x").to_pylist(), asked.column("_n").to_pylist()), strict=True))
    trained = np.concatenate([_unzip(x, ("<u8", -1))[0] for x in answers.column("_x").to_pylist()]).astype(np.int64)
    order = np.lexsort((names, -counts))
    tokens = _unzip(runs.column("_x")[0].as_py(), ("<u4", -1))[0].astype(np.int64)
    return docs, pairs, tokens, docs.column("_n").to_numpy(), np.append(names[order], np.uint64(START)), np.append(trained[order], 0)


def _pairs(words: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Contexts and words of the distinct pairs of documents whose words are numbers below size - 1 (the start is that), and which of them each token is."""
    before = np.empty(len(words), np.int64)
    before[1:] = words[:-1]
    before[np.cumsum(lengths) - lengths] = size - 1
    pairs, which = np.unique(before * size + words, return_inverse=True)
    return *np.divmod(pairs, size), which


def _named(words: np.ndarray, hashes: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
    """Value of each word that is one of hashes (sorted), else other."""
    place = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    return np.where(hashes[place] == words, values[place], other)


def _buckets(codes: np.ndarray, names: np.ndarray, h: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each pair (h, w) of words with these codes and hashes."""
    with np.errstate(over="ignore"):
        salt = np.where(codes[h] < HOT, _mix(names)[w] % np.uint64(SALTS), np.uint64(0))
        return (_mix(names[h] * MIX + salt) % np.uint64(buckets)).astype(np.int64)


def _asked(hashes: np.ndarray, codes: np.ndarray, buckets: int):
    """What a group asks of each bucket of pairs: codes, hashes of words without code, their training counts, and counts of the pairs."""

    def run(group: pa.Table) -> pa.Table:
        docs, _, at, lengths, names, trained = _opened(group)
        h, w, which = _pairs(at, lengths, len(names))
        counts = np.bincount(which, np.repeat(docs.column("_train").fill_null(False).to_numpy(zero_copy_only=False), lengths)).astype("<u4")
        code = _named(names, hashes, codes, OTHER).astype("<u4")
        # The high byte of a code is zero.
        planes = code.view(np.uint8).reshape(-1, 4)[:, :3]
        bucket = _buckets(code, names, h, w, buckets)
        found, parts = _split(np.argsort(bucket, kind="stable"), bucket)

        def packed(x):
            a, b = h[x], w[x]
            ra, rb = a[code[a] == OTHER], b[code[b] == OTHER]
            return _zip(planes[a], planes[b], names[ra], names[rb], trained[rb].astype("<u8"), counts[x])

        group = group.column("_g")[0].as_py()
        return pa.Table.from_batches([_rows(ASK, 5, len(found), _g=np.full(len(found), group), _i=found, _n=[len(x) for x in parts], _x=[packed(x) for x in parts])])

    return run


ASK = pa.schema([("_kind", pa.int32()), ("_g", pa.int64()), ("_i", pa.int64()), ("_n", pa.int64()), ("_x", pa.binary())])


def _asked_pairs(packed: bytes, n: int, by_code: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts, words, shares of the words (training count and one) and counts of n pairs, and which contexts are hot; by_code and shares are those of frequent words."""
    raw = zlib.decompress(packed)
    planes = np.zeros((2, 4, n), np.uint8)
    planes[:, :3] = np.frombuffer(raw, np.uint8, 6 * n).reshape(2, 3, n)
    code = [p.T.copy().view("<u4").ravel() for p in planes]
    rare = [c == OTHER for c in code]
    m = [int(r.sum()) for r in rare]
    _, h, w, trained, counts = _unzip(packed, ("u1", 6 * n), ("<u8", m[0]), ("<u8", m[1]), ("<u8", m[1]), ("<u4", n))
    out = [by_code[np.where(r, 0, c)] for c, r in zip(code, rare, strict=True)]
    out[0][rare[0]], out[1][rare[1]] = h, w
    share = shares[np.where(rare[1], 0, code[1])]
    share[rare[1]] = trained.astype(np.int64) + 1
    return *out, share, counts.astype(np.int64), code[0] < HOT


def _pair_totals(by_code: np.ndarray, shares: np.ndarray):
    """Answers of a bucket of pairs (kind 5: totals of the pairs, then sums of their contexts), how many pairs occur 1 to TOP + 1 times (6), and sums of hot contexts (7)."""

    def told(bucket, groups, sizes, packed):
        h, w, share, c, hot = (np.concatenate(x) for x in zip(*(_asked_pairs(x, n, by_code, shares) for x, n in zip(packed, sizes, strict=True)), strict=True))
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        begins = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
        total, lengths = np.add.reduceat(c[order], begins), np.diff(begins, append=len(order))
        first = np.append(True, h[begins][1:] != h[begins][:-1])
        context, heads = np.cumsum(first) - 1, np.flatnonzero(first)
        times = [(total == r).astype(np.int64) for r in range(1, TOP + 2)]
        sums = np.stack([np.add.reduceat(x, heads) for x in (total, share[order][begins] * (total > 0), *times)], 1)
        answer, of = np.empty((2, len(order)), np.int64)
        answer[order], of[order] = np.repeat(total, lengths), np.repeat(context, lengths)
        out, until = [], np.cumsum(sizes)
        for i, j in zip(until - sizes, until, strict=True):
            runs = of[i:j][np.append(True, of[i + 1 : j] != of[i : j - 1])]
            out.append(_zip(answer[i:j].astype("<u8"), sums[runs, : TOP + 2].astype("<u8")))
        yield _rows(SUMMED, 5, len(groups), _g=groups, _i=np.full(len(groups), bucket), _x=out)
        yield _rows(SUMMED, 6, 1, _sums=[sums[:, 2:].sum(0).tolist()])
        hot = np.flatnonzero(hot[order][begins][heads])
        yield _rows(SUMMED, 7, len(hot), _w=h[begins][heads][hot].view(np.int64), _sums=sums[hot, : TOP + 2].tolist())

    return _bucketwise(told)


def _scored(hashes: np.ndarray, codes: np.ndarray, buckets: int, total: int, distinct: int, factors: dict[int, float], hot: dict[int, list[int]]):
    """Scores of the documents of a group, from these, its words and the answers; hot are sums of the most frequent contexts by hash."""
    factor = np.array([0.0, *(factors[r] for r in range(1, TOP + 1)), 1.0])

    def run(group: pa.Table) -> pa.Table:
        docs, answers, at, lengths, names, trained = _opened(group)
        h, w, which = _pairs(at, lengths, len(names))
        code = _named(names, hashes, codes, OTHER)
        bucket = _buckets(code, names, h, w, buckets)
        c, sums = np.empty(len(h), np.int64), np.zeros((len(names), TOP + 2), np.int64)
        for x, raw in zip(_split(np.argsort(bucket, kind="stable"), bucket)[1], answers.column("_x").to_pylist(), strict=True):
            runs = h[x][np.append(True, h[x][1:] != h[x][:-1])]
            c[x], numbers = _unzip(raw, ("<u8", len(x)), (f"V{8 * (TOP + 2)}", len(runs)))
            sums[runs] = numbers.view("<u8").reshape(len(runs), -1)
        for i in np.flatnonzero(code < HOT):
            sums[i] = hot.get(int(names[i : i + 1].view(np.int64)[0]), 0)
        share, ch = (trained + 1) / (total + distinct + 1), np.maximum(sums[:, 0], 1)
        freed = sum(r * sums[:, r + 1] * (1 - f) for r, f in factors.items()) / ch
        # Without any discount in a context its mass is all used; a context all of whose words are seen leaves none.
        rest = np.maximum(freed, 1e-9)
        weight = rest / np.maximum(1 - sums[:, 1] / (total + distinct + 1), 1e-12)
        p = np.where(c > 0, c * factor[np.minimum(c, TOP + 1)] / ch[h], weight[h] * share[w]) / (rest + 1 - freed)[h]
        p = np.where(sums[h, 0] == 0, share[w], p)
        begins = np.cumsum(lengths) - lengths
        known, base, score = (np.add.reduceat(x, begins) for x in ((trained > 0).astype(np.int64)[at], np.log10(share)[at], np.log10(p)[which]))
        return pa.table([docs.column("_id"), docs.column("_train"), *map(pa.array, (lengths, known, base, score))], ["_id", "_train", "n_tokens", "n_known", "base_score", "score"])

    return run


def katz_scores(docs: DataFrame, train: Column, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per row of docs: _id, _train, n_tokens, n_known, train_tokens, base_score, score (log10).

    Words are runs of characters other than blanks and \\t to \\r, A-Z lower-cased, known by 64-bit hashes. A null
    text is empty: one end token. Without training rows every token is unknown with probability one.
    Repeated rows each count and are each scored. Empty table: no rows.
    """
    kind = docs.schema[ident].dataType.simpleString()
    texts = docs.select(F.col(ident).alias("id"), train.alias("_train"), F.col(text).alias("text"))
    groups = settled(map_arrow(texts, _grouped(GROUP), f"{ASKED}, _id {kind}, _train boolean"), "katz-groups")
    summed = lambda asked, fn, label: settled(map_arrow(asked.select("_i", "_g", "_n", "_x").repartition("_i").sortWithinPartitions("_i", "_g"), fn, SUMMED_TYPES), label)
    added = lambda rows, n: [r or 0 for r in rows.agg(*[F.sum(F.col("_sums")[i]) for i in range(n)]).first()]
    words = summed(groups.where("_kind = 1"), _word_totals(-(-2 * HEAVY // WORDS)), "katz-words")
    size, total, distinct = added(words.where("_kind = 3"), 3)
    # Bounded: the most frequent words of each bucket, and of these the HEAVY most frequent.
    tops = [_unzip(x, *[("<u8", n)] * 3) for x, n in words.where("_kind = 4").select("_x", F.col("_sums")[0]).collect()]
    names, counts, trained = (np.concatenate(x).astype(t) for x, t in zip(zip(*tops, strict=True) if tops else [[[]]] * 3, (np.uint64, np.int64, np.int64), strict=True))
    top = np.lexsort((names, -counts))[:HEAVY]
    by_code = np.append(np.uint64(START), names[top])
    # The start is never a word, so its share is not asked for.
    shares, codes = np.append(0, trained[top] + 1), np.argsort(by_code)
    hashes, buckets = by_code[codes], -(-size // PART) or 1

    known = groups.unionByName(words.where("_kind = 2").select("_kind", "_g", "_i", "_x"), allowMissingColumns=True)
    asked = known.groupBy("_g").applyInArrow(_asked(hashes, codes, buckets), ASKED)
    pairs = summed(asked, _pair_totals(by_code, shares), "katz-pairs")
    factors = discounts(dict(enumerate(added(pairs.where("_kind = 6"), TOP + 1), 1)))
    hot = pairs.where("_kind = 7").groupBy("_w").agg(*[F.sum(F.col("_sums")[i]) for i in range(TOP + 2)])
    hot = {r[0]: list(r[1:]) for r in hot.collect()}
    known = known.unionByName(pairs.where("_kind = 5").select("_kind", "_g", "_i", "_x"), allowMissingColumns=True)
    scores = known.groupBy("_g").applyInArrow(_scored(hashes, codes, buckets, total, distinct, factors, hot), f"_id {kind}, _train boolean, n_tokens long, n_known long, base_score double, score double")
    return scores.select("_id", "_train", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
