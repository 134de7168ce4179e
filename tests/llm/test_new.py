"""Merkle manifest, spelling variants, set join, and user columns with internal names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import dart_minhash, exact_dedup, merkle, mixing, quality_rules, set_join, spelling

NAMES = "doc_id long, text string, lang string, source string, n_chars long, _row long, _id string, _size long, _best string, _times int, _doc string"
WORDS = " ".join(f"word{i % 90} other{i}" for i in range(60))
LONG = "long text " * 100_000


def rows():
    out = [(i, f"{WORDS} {i} " + " ".join(f"u{i}x{j}" for j in range(200)), "en", "s", 9, 1, "a", 5, "b", 2, "c") for i in range(6)]
    return [*out, out[0], out[0], (20, None, None, None, None, None, None, None, None, None, None), (21, "", "en", "s", 0, 1, "a", 5, "b", 2, "c"), (None, LONG, "de", "t", 3, 1, "a", 5, "b", 2, "c"), (22, LONG, "de", "t", 3, 1, "a", 5, "b", 2, "c")]


@pytest.mark.parametrize("name", ["quality rules", "exact dedup", "near dedup", "mixing"])
def test_stages_return_user_columns_unchanged(spark, name):
    """Columns named as internal ones, nulls, empty and 1 MB texts, repeated rows, and no rows at all."""
    docs = spark.createDataFrame(rows(), NAMES)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, "")
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    given = set(rows())
    kept = [tuple(r) for r in got.collect()]
    assert set(kept) <= given
    if name == "exact dedup":
        assert sorted(Counter(r[1] or "" for r in kept).values()) == [1] * len({r[1] or "" for r in given})
    if name == "near dedup":
        assert len(kept) == len({r[1] or "" for r in given})
    empty = stage(spark, docs.limit(0), "")
    assert empty.columns == docs.columns and empty.count() == 0


def test_unrelated_texts_with_one_row_number_stay_apart(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(50)), 1) for i in range(3)], "doc_id long, text string, _row long")
    assert {r.class_size for r in dart_minhash.near_duplicates(docs).collect()} == {1}
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows(), NAMES))
    assert mixing.mix(spark.createDataFrame(rows(), NAMES), prefix="mix_").where("mix_size is null").isEmpty()


@pytest.mark.parametrize("kind", ["string", "long", "double"])
@pytest.mark.parametrize("largest", [True, False])
def test_exact_dedup_with_ids_of_any_type(spark, kind, largest):
    ids = {"string": ["b", "a", "", None, "c"], "long": [5, -(2**63), 2**63 - 1, None, 0], "double": [1.5, -2.0, 0.0, None, 7.25]}[kind]
    docs = spark.createDataFrame([(i, "x") for i in ids] + [(ids[0], "y")], f"doc_id {kind}, text string").repartition(5)
    got = exact_dedup.exact_duplicates(docs, largest=largest).collect()
    known = [i for i in ids if i is not None]
    assert {r.keep_id for r in got if r.group_size == 5} == {max(known) if largest else min(known)}
    assert sum(r.kept for r in got) == 2


def tree(nodes):
    """Levels of a tree of runs of three, from the leaves to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hashlib.sha256("".join(last[i : i + 3]).encode()).hexdigest() for i in range(0, len(last), 3)])
    return levels


def test_merkle_manifest(spark):
    """More than one superblock, one document alone, null and empty source, null ids and fields, repeated rows."""
    data = [(i, "big", "en" if i % 3 else None, i, f"text\n{i}" if i % 5 else f"text {i}") for i in range(2 * merkle.SPAN + 40)]
    data += [(1, None, "a", 1, None), (None, None, "a", 2, ""), (2, "", "é", None, "x\n"), (3, "one", "", 0, "\n"), (4, "one", "", 0, "ü\nß"), (4, "one", "", 0, "ü\nß"), (5, "ä", None, None, None), (6, "z", "a", -3, "q" * 500_000)]
    random.Random(2).shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    changed = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.manifest(docs, altered={"text": changed}).collect()

    def leaf(r):
        return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r).encode()).hexdigest()

    groups = defaultdict(list)
    for r in data:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([levels[s][-1][0] for s in names])
    want = Counter()
    for n, s in enumerate(names):
        for i, (_, _, digest, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            siblings, place = [], i
            other = leaf((*r[:4], r[4].replace("\n", "")) if r[0] is not None and r[0] % 2 == 0 and r[4] is not None else r)
            for part, place in ((levels[s], i), (top, n)):
                for level in part[:-1]:
                    run = level[place // 3 * 3 : place // 3 * 3 + 3]
                    at = place % 3
                    siblings += run[:at] + run[at + 1 :]
                    other = hashlib.sha256("".join([*run[:at], other, *run[at + 1 :]]).encode()).hexdigest()
                    place //= 3
            want[r[0], s, digest, levels[s][-1][0], top[-1][0], hashlib.sha256("".join(siblings).encode()).hexdigest(), other, other == top[-1][0]] += 1
    # Rows that are repeated as a whole have each a place of their own, so they are compared as a multiset.
    assert Counter((r._id, r._group, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == want
    assert all(merkle.fold(r.leaf, r.proof) == r.root for r in got)
    assert merkle.manifest(docs.limit(0)).count() == 0


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(a) + 1 == len(b) and a[i:] == b[i + 1 :])


def test_spelling_variants(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    giant = "x" * 70 + "".join(rng.choice("abc") for _ in range(3000))
    base += ["q" * 31, "q" * 32, "q" * 33, "q" * 34, "q" * 16 + "z" + "q" * 16, "aaaaa", "aaaaaa", "aaaab", "baaaa", giant, giant[:-1], giant[1:], giant[:99] + "ü" + giant[100:]]
    data = [(i, " ".join(rng.choice([w, w.upper(), w]) + rng.choice([" ", ",", "1"]) for w in rng.choices(base, k=120))) for i in range(60)]
    data += [(None, " ".join(base)), (7, None), (8, ""), (9, "ÀÉÎ ÀÉÎ×÷ ĀĀĀĀĀĀ Straße"), data[0], data[0]]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("word", F.lit("extra")).withColumn("n", F.lit(1))
    count = Counter()
    for i, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {w: f for w, vs in near.items() if vs and words[f := min(vs, key=lambda v: (-words[v], v))] >= 2 * words[w]}
    got = {r.word: r for r in spelling.variants(docs).collect()}
    assert got.keys() == words.keys() and any(len(w) > 1000 and near[w] for w in words)
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        r = got[w]
        assert (r.n, r.n_near, r.form, r.form_n, r.root) == (n, len(near[w]), form.get(w), words.get(form.get(w)), root), w
    assert spelling.variants(docs.limit(0)).count() == 0


def linked_sets(data):
    """(id, size, least id) by comparing all pairs."""
    sets = []
    for _, text in data:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[j : j + 4]) for j in range(max(len(words) - 3, 1))} if words else set())
    group = list(range(len(data)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and group[i] != group[j] and 100 * len(a & b) >= 85 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = defaultdict(list)
    for (i, _), g in zip(data, group, strict=True):
        ids[g] += [i] * (i is not None)
    return Counter((i, len(s), min(ids[g], default=None)) for (i, _), s, g in zip(data, sets, group, strict=True))


def test_set_join(spark):
    """Clusters around the threshold, drifting chains, a shared passage, equal sets of different texts, nulls and repeated rows."""
    rng = random.Random(6)
    texts = []
    for size in (3, 9, 40, 160):
        start = [f"w{rng.randrange(900)}" for _ in range(size)]
        for _ in range(12):
            t = list(start)
            for _ in range(rng.randrange(0, 2 + size // 25)):
                t[rng.randrange(size)] = f"w{rng.randrange(900)}"
            texts.append(t)
    walk = [f"c{i}" for i in range(200)]
    for _ in range(25):
        texts.append(list(walk))
        for _ in range(rng.randrange(2, 7)):
            walk[rng.randrange(200)] = f"c{rng.randrange(9999)}"
    passage = [f"p{i}" for i in range(60)]
    texts += [passage + [f"t{k}x{i}" for i in range(8)] for k in range(10)]
    texts += [["a", "b", "c", "d"] * 9, ["a", "b", "c", "d"] * 20]
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    n = len(data)
    data += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "É one"), (n + 6, "é one"), data[0], data[0], (None, data[1][1]), (None, "alone here among all"), (n + 7, "far " * 50_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").select("*", F.lit(1).alias("_set"), F.lit("x").alias("id"), F.lit(2).alias("n"))
    assert Counter(tuple(r) for r in set_join.jaccard_components(docs).collect()) == linked_sets(data)
    assert set_join.jaccard_components(docs.limit(0)).count() == 0


def test_parity_never_exceeds_the_difference():
    rng = random.Random(8)
    for _ in range(200):
        a = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(4, 700))]
        b = [x if rng.random() < 0.9 else f"w{rng.randrange(300)}" for x in a[: rng.randrange(4, 700)]] or a
        x, y = (set_join.shingle_set(" ".join(t)) for t in (a, b))
        apart = len(set(x.tolist()) ^ set(y.tolist()))
        assert set_join.differing(set_join.parity(x), set_join.parity(y)) <= apart
        assert set_join.differing(set_join.parity(y), set_join.parity(x)) == set_join.differing(set_join.parity(x), set_join.parity(y))


def test_word_hashes_of_long_texts_in_pieces():
    """Texts hashed together, alone or in pieces give the same sets, words of any length included."""
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abü") for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 90]))) for _ in range(rng.randrange(0, 60))) + rng.choice(["", " ", "\n\t"]) for _ in range(50)]
    texts += [None, "", " ", "a\x00 a b c d", "a b c d", "x" * 3_000_000 + " a b c d e", "p q r s " * 400_000]
    together = set_join.shingle_sets(texts)
    for t, s in zip(texts, together, strict=True):
        words = (t or "").split()
        shingles = {tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()
        assert len(s) == len(shingles)
        assert s.tolist() == set_join.shingle_set(t).tolist()
    long = " ".join(x for x in texts[:50])
    h, _ = set_join.word_hashes(long.encode())
    assert h.tolist() == set_join._in_pieces(long.encode()).tolist() and len(set(h.tolist())) == len(set(long.split()))
    assert set_join.shingle_set("p q r s " * 400_000).tolist() == set_join.shingle_set("p q r s p q r s").tolist()


def test_rows_are_found_by_bitmaps(spark):
    """Numbers over several partitions, beyond one bitmap, none and all of them."""
    from strandline.llm.common import ROW, among

    df = spark.range(0, 100_000, 1, 2).select("id", F.monotonically_increasing_id().alias(ROW)).localCheckpoint()
    odd = df.where("id % 7 = 3 or id in (0, 32767, 32768, 99999)")
    assert sorted(r[0] for r in among(df, odd.union(odd)).collect()) == sorted(r[0] for r in odd.collect())
    assert among(df, odd, inside=False).count() == 100_000 - odd.count()
    assert among(df, odd.limit(0)).count() == 0 and among(df, odd.limit(0), inside=False).count() == 100_000


def plan_of(spark, capfd, work):
    """The plan of what work returns, where tables of row numbers are too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        work().explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return capfd.readouterr().out


@pytest.mark.parametrize("module", [dart_minhash.without_near_duplicates, exact_dedup.without_duplicates, quality_rules.passing])
def test_whole_rows_are_not_shuffled(spark, capfd, module):
    """The rows that go are found without moving the documents."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 400).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).alias("n_chars"))
    plan = plan_of(spark, capfd, lambda: module(docs))
    assert "_doc" in plan and not re.search(r"Exchange hashpartitioning\(_row", plan)
