"""The operators against brute force on small tables."""

import hashlib
import time
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import dart_minhash, exact_dedup, html_text, katz, license_scan, mixing, packing, quality_model, quality_rules, warc
from strandline.llm.common import training_row

KIND = "doc_id long, text string, lang string, source string, n_chars long, _row long, _best string"
ROWS = [(1, "a b c", "en", "s", 5, 1, "x"), (2, "a b c", "en", "s", 5, 1, "x"), (2, "a b c", "en", "s", 5, 1, "x"), (3, None, None, None, None, None, None), (4, "", "en", "s", 0, 1, "x"), (None, "all rights reserved cc by", "de", "t", 0, 1, "x"), (7, "w " * 6000, "en", "t", 0, 1, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND)


def test_exact_dedup(spark, docs):
    got = exact_dedup.exact_duplicates(docs, largest=True).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(groups)
    for r in got:
        own = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(groups[own]) and r["keep_id"] == max((i for i in groups[own] if i is not None), default=None)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    assert exact_dedup.without_duplicates(docs).count() == len(groups)


def test_near_duplicates(spark):
    import random

    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [base]
    for at in (10, 100, 190):
        texts.append([*base[:at], "new", *base[at + 1 :]])
    texts += [[f"v{rng.randrange(5000)}" for _ in range(200)] for _ in range(5)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "one"), (93, "one")]
    got = {r["_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, **{i: i for i in range(4, 9)}, 90: 90, 91: 90, 92: 92, 93: 92}


def earliest_darts(units, k):
    """Signature of one text, dart by dart."""
    top, out = 2**64, {}
    mix = lambda x: int(dart_minhash._mix(dart_minhash.np.array([x % top], "uint64"))[0])
    for u in map(int, units):
        at = 0.0
        for number in range(1, 60):
            dart = mix(u + number * int(dart_minhash.MIX))
            at -= math.log(((dart >> 11) + 0.5) * 2.0**-53)
            name = mix(dart ^ int(dart_minhash.MIX))
            out[name % k] = min(out.get(name % k, (math.inf, 0)), (at, name))
    return [out[i][1] for i in range(k)]


def test_signature_agrees_with_brute_force_and_jaccard():
    parts = [dart_minhash.shingles(" ".join(map(str, range(*x))), {}) for x in ((0, 400), (100, 500), (0, 0), (0, 3), (7, 60))]
    got = dart_minhash.signatures(parts, 16)
    assert not got[2].any()
    for i in (0, 3, 4):
        assert got[i].tolist() == earliest_darts(parts[i], 16)
    a, b = parts[:2]
    same = dart_minhash.signatures([a, b], 2000)
    assert abs((same[0] == same[1]).mean() - len(set(a) & set(b)) / len(set(a) | set(b))) < 0.05


def test_mixing(spark, docs):
    assert mixing.capped_targets([10, 100], [5, 2], 150) == [20, 130]
    assert mixing.least_cost_flow([(10, [0, 1]), (10, [0])], [10, 10], 2) == [10, 10]
    assert mixing.least_cost_flow([(10, [0])], [25], 2) == [20]
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["_times"] <= 2 for r in got)


def test_packing(spark, docs):
    got = packing.pack(docs, corpus_pipeline.tokenizer_path()).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"]
    for s, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 4096 or s == max(by)


def test_katz_sums_to_one(spark):
    rows = [(0, "a b a c a b"), (1, "b a a"), (5, "a d"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["_id"]: r for r in katz.katz_scores(df, training_row(F.col("doc_id"), 7) != 2).collect()}
    import zlib

    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*(t or "").split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*(t or "").split(), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["n_tokens"] == len(tokens)
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in tokens) and got[i]["train_tokens"] == n and got[i]["score"] < 0


def test_license_scan(spark, docs):
    got = {r["_id"]: r for r in license_scan.scan_documents(docs).collect()}
    assert (got[None]["n_base"], got[None]["first_word"], got[None]["last_word"], got[None]["base_labels"]) == (2, 0, 3, "cc-by,reserved")
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["labels"]) == (0, 0, "")


def test_quality_rules(spark, docs):
    got = {r["_id"]: r for r in quality_rules.quality_verdicts(docs).collect()}
    assert got[7]["n_repeat_words"] == 6000 and got[7]["base_failed"] and not got[7]["kept"] and got[3]["n_words"] == 0


def test_warc(spark):
    long = "x" * 2000
    rows = [(1, "http://a", long), (2, None, long), (3, "u", "short"), (4, "u", None), (4, "u", None)]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[2]["record_type"] == "response"
    assert got[1]["payload_digest"] == hashlib.sha1(long.encode()).hexdigest() and got[4]["payload_bytes"] == 0
    with pytest.raises(ValueError):
        list(warc.frames(b"not an archive"))


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>Head &amp; tail</h1><p>One\n two<br><p>three<script>x</script></article><footer>f</footer></body></html>"
    rows = [(1, "http://h/1", page), (2, None, None)] + [(10 + i, "http://t/x", f"<div><p>same line</p></div><div><p>own {i}</p></div>") for i in range(8)]
    got = {r["_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head & tail\nOne two\nthree" and got[2]["text"] == "" and got[12]["text"] == "own 2"


def test_warc_records(spark):
    """Repeated long rows have one response; every record carries the mandatory headers; a dictionary may be compressed."""
    import struct

    import zstandard

    long = "y" * 3000
    rows = [(5, "u", long)] * 4 + [(5, "a", long), (None, "u", long), (3, None, long), (7, "u", None)]
    back = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kinds = Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in back)
    assert kinds == {(5, "u", "response", None): 1, (5, "u", "revisit", 5): 3, (5, "a", "revisit", 5): 1, (None, "u", "revisit", 5): 1, (3, None, "revisit", 5): 1, (7, "u", "response", None): 1}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0
    raw = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False, "1", "2020-01-01T00:00:00Z")
    heads, block = warc.parse(raw)
    assert block == b"abc" and heads["WARC-Record-ID"].startswith("<urn:uuid:") and heads["WARC-Date"] == "2020-01-01T00:00:00Z"
    for bad in (raw.replace(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b""), raw.replace(b"abc\r\n\r\n", b"abcd\r\n\r\n"), raw.replace(b"abc", b"abd")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    words = zstandard.ZstdCompressionDict(b"some words of a dictionary " * 9)
    packed = zstandard.ZstdCompressor().compress(words.as_bytes())
    archive = struct.pack("<II", warc.DICTIONARY, len(packed)) + packed + zstandard.ZstdCompressor(dict_data=words).compress(raw)
    assert list(warc.frames(archive)) == [raw]


def test_packed_ids_are_those_of_the_tokenizer(spark):
    """Every id of whole texts against encoding each text at once, joined over the pieces."""
    from tokenizers import Tokenizer

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(80)
    texts = {r[0]: r[1] or "" for r in df.collect()}
    own = [(-1, "  two  blanks "), (-2, "Tabs\tand\nlines"), (-3, ""), (-4, None), (-5, "x" * 70_000), (-6, "caf\u00e9 na\u00efve \u4f60\u597d \u00df")]
    texts |= {i: t or "" for i, t in own}
    got = defaultdict(list)
    for r in packing.pack(df.union(spark.createDataFrame(own, "doc_id long, text string")), corpus_pipeline.tokenizer_path()).collect():
        got[r["_id"]].append(r)
    model = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in sorted(got[i], key=lambda r: r["start"])), "<u4").tolist()
        assert ids == [*model.encode(t, add_special_tokens=False).ids, 2]


def test_html_markup_and_class_words(spark):
    story = "<div class='social-science'><p>Study of people</p></div><p class='newsletter-archive-story'>An old letter</p>"
    dropped = "<div class='cookie-notice'><p>We set cookies</p></div><ul id=site-nav-menu><li>Home</li></ul><div role='navigation'>Ways</div>"
    rows = [("http://a/", f"<article>{story}{dropped}</article>"), ("http://b/", '<p class="x>Broken quote</p><p title="a > b">Next</p>'), ("http://c/", "<p>a < b and <b>c</b></p>"), ("http://d/", "<p>open <!-- never closed <p>gone</p>")]
    assert texts_of(spark, rows) == ["Study of people\nAn old letter", "Broken quote\nNext", "a < b and c", "open"]


def test_html_work_grows_with_the_page():
    """Paragraphs in nested elements leave a run each, not a hash for each block in it; broken tags are read once."""
    n = 2000
    page = "".join(f"<div><p>line {i}</p>" for i in range(n)) + "</div>" * n
    found, trees = html_text.blocks(page)
    assert len(found) == n and len(trees) == 2 * n
    assert len(html_text.subtrees(found, trees)) == 2 * n
    start = time.perf_counter()
    html_text.blocks('<p class="x ' * 20_000)
    html_text.blocks('<p class="x>' * 20_000)
    assert time.perf_counter() - start < 10


def test_equal_subtrees_of_a_page_are_one():
    found, trees = html_text.blocks("<div><p>twice</p></div><p>own</p><div><p>twice</p></div>")
    tree = max(html_text.subtrees(found, trees), key=lambda t: len(t["runs"]))
    assert tree["runs"] == [{"first": 0, "last": 1}, {"first": 2, "last": 3}] and len(tree["rest"]) == 1


def test_near_duplicate_classes_against_all_pairs(spark):
    """Classes of the whole small documents table, by comparing every text with every other one."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    units, group = {}, {i: i for i in texts}
    for i, t in texts.items():
        words, seen, units[i] = t.lower().split(), Counter(), set()
        for j in range(max(len(words) - 4, 1) if words else 0):
            shingle = tuple(words[j : j + 5])
            units[i].add((shingle, seen[shingle]))
            seen[shingle] += 1
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(units[a] & units[b])
            if texts[a] == texts[b] or common and common >= 0.8 * len(units[a] | units[b]):
                old, new = group[b], group[a]
                group = {i: new if g == old else g for i, g in group.items()}
    best = {g: min(i for i in ids if group[i] == g) for g in set(group.values())}
    got = {r["_id"]: r["class_id"] for r in dart_minhash.near_duplicates(df).collect()}
    assert got == {i: best[group[i]] for i in ids}


def test_a_pair_of_blocks_names_each_text_once():
    """Also where its pairs come in several batches."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["_u", "_v", "_b", "_as"])
    batches = [batch((1, 1, 7, [8]), (1, 2, 7, [9, 8])), batch((1, 2, 7, [9]), (1, 2, 8, [5])), batch((1, 2, 5, [9]), (2, 2, 9, []))]
    got = [tuple(r.values()) for b in dart_minhash._sides(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == [(1, 1, 7), (1, 1, 8), (1, 2, 5), (1, 2, 7), (1, 2, 8), (1, 2, 9), (2, 2, 9)]


def test_settled_buckets_leave_the_work(spark):
    """Bucket 1 has only members of its main component left to ask, bucket 2 another one too."""
    members = spark.createDataFrame([(r, 1, r in (3, 4)) for r in range(5)] + [(r, 2, r == 3) for r in range(5)], "_row long, _bucket long, _asked boolean")
    found = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "node long, component long")
    got = dart_minhash._mixed(members, found).collect()
    assert {r["_bucket"] for r in got} == {2} and len(got) == 5 and {r["_main"] for r in got} == {0}


def test_word_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    import corpus_pipeline

    model = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    words = ["it's", "'sun", "don't!'s", "a<|endoftext|>b", "İX", "ΣΑΣ", "é", "é", "x\x0by", "\x1cq", "½²", "", "'", "''s", "IT'LL'", "\xa0z", "日本", "Straße\nFoo", "a,b.C###"]
    bare, pieces = packing.bare_tokenizer(corpus_pipeline.tokenizer_path()), {}
    assert packing.word_ids(model, bare, packing.end_ids(model), words, pieces) == packing._one_by_one(model, words)
    text = " ".join(words)
    ids = packing.word_ids(model, bare, packing.end_ids(model), text.split(" "), pieces)
    whole = model.encode(text, add_special_tokens=False).ids
    assert b"".join(ids[w] for w in text.split(" ")) == b"".join(i.to_bytes(4, "little") for i in whole)


def test_no_link_is_lost_where_heads_are_missed(spark, monkeypatch):
    """All texts in one bucket, heads alike no other text: chains are found all the same."""
    words = [f"w{i}" for i in range(400)]
    alone = [" ".join(f"x{j}y{i}" for i in range(60)) for j in range(4)]
    chains = [" ".join(words[40 * c : 40 * c + 40] + [f"c{c}"] * n) for c in range(8) for n in range(1, 5)]
    rows = list(enumerate(alone + chains))
    import strandline.llm.dart_minhash as module

    def one_bucket(batches):
        import pyarrow as pa

        for batch in batches:
            alike = pa.array([bytes(module.BANDS * module.ROWS)] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([[7]] * batch.num_rows, pa.list_(pa.int64())), alike], ["_row", "_bands", "_sig"])

    monkeypatch.setattr(module, "_signatures", one_bucket)
    monkeypatch.setattr(module, "MORE_HEADS", 2)
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common, either = (sets[i] & sets[j]).total(), (sets[i] | sets[j]).total()
            if common >= 0.8 * either:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert len(set(root)) < len(rows) - 10
    found = module.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["_id"]: r["class_id"] for r in found.collect()} == dict(enumerate(root))


def texts_of(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    got = {r["_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_html_templates_inside_articles(spark):
    box = "<div><p>Read our other stories</p></div>"
    boxed = [("http://a/", f"<h1>Title {i}</h1><main><p>Story number {i} of many</p>{box}</main>") for i in range(8)]
    copies = [("http://b/", f"<div><p>box {i}</p></div><article><p>One and the same long story</p><p>Its end</p></article>") for i in range(8)]
    teaser = [("http://c/", "<div><p>A long story that stands in a plain element of the page</p></div><article><p>Teaser</p></article><article class='comment'><p>Nonsense</p></article>")]
    got = texts_of(spark, boxed + copies + teaser)
    assert got[:8] == [f"Title {i}\nStory number {i} of many" for i in range(8)]
    assert got[8:16] == [f"box {i}\nOne and the same long story\nIts end" for i in range(8)]
    assert got[16] == "A long story that stands in a plain element of the page\nTeaser"


def test_html_templates_do_not_depend_on_the_size_of_the_host(spark):
    box = "<div><p>Only in this section</p></div>"
    section = [("http://d/", f"<div><p>Own text {i} of the section</p></div>{box}") for i in range(6)]
    others = [("http://d/", f"<article><p>Another article {i}</p></article>") for i in range(60)]
    got = texts_of(spark, section + others)
    assert got[:6] == [f"Own text {i} of the section" for i in range(6)]
    assert got[6:] == [f"Another article {i}" for i in range(60)]


def clean_texts(n, seed=1, lines=20):
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    return ["\n".join(" ".join(word() for _ in range(10)) for _ in range(lines)) for _ in range(n)]


def verdicts(spark, rows):
    return {r["_id"]: r for r in quality_rules.quality_verdicts(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")).collect()}


def test_quality_rules_hold_every_row_against_some_rows(spark):
    junk = " ".join(f"#*$%{i}|<>" for i in range(200))
    texts = clean_texts(81)
    rows = [(t, "en", "s") for t in texts[:60]] + [(texts[80], "en", "rare"), (junk, "en", "rare"), (junk, "xx", None), (junk, None, None)]
    got = verdicts(spark, rows)
    assert all(r["distance"] is not None for r in got.values())
    assert got[60]["kept"] and not any(got[i]["kept"] for i in (61, 62, 63))
    few = verdicts(spark, [(t, "en", "s") for t in texts[60:80]] + [(junk, "en", "s")])
    assert not few[20]["kept"] and sum(r["kept"] for r in few.values()) >= 18


def test_quality_rules_reject_a_deviation_in_one_feature(spark):
    texts = clean_texts(70)
    spaced = "\n".join(f"{line}\nread more" for line in texts[60].split("\n"))
    stutter = " ".join(w if i % 2 else f"{w} {w}" for i, w in enumerate(texts[61].split()))
    marked = " ".join(f"{w}#" if i % 5 == 0 else w for i, w in enumerate(texts[62].split()))
    got = verdicts(spark, [(t, "en", "s") for t in texts[:60] + texts[63:]] + [(t, "en", "s") for t in (spaced, stutter, marked)])
    assert [got[i]["kept"] for i in (67, 68, 69)] == [False] * 3 and not any(got[i]["base_failed"] for i in (67, 68, 69))
    assert sum(got[i]["kept"] for i in range(67)) >= 65


def test_license_spans_are_compared_with_the_template(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    rows = [(1, "4.0 4.0 4.0 4.0 4.0 4.0"), (2, "2.0 " * 6), (3, notice + " 2.0" * 12), (4, notice + "\n" + notice), (5, "licensed under the old apache license version 2 0"),
            (6, "license version 2 0 the apache license licensed under the"), (7, "x " * 50 + notice)]
    got = {r["_id"]: r for r in license_scan.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["labels"] for i, r in got.items()} == {1: "", 2: "", 3: "apache-2.0", 4: "apache-2.0", 5: "apache-2.0", 6: "", 7: "apache-2.0"}
    assert license_scan.verified([(i + 8 * k, i) for k in range(2) for i in range(7)], 7, 5.6) == [(7, 0, 8), (7, 8, 16)]


def test_word_vectors_come_from_all_training_rows(spark):
    import numpy as np

    texts = ["good words here here", "education position", None, "x", "unlabelled fraction stands alone"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    index, want = quality_model.index_vectors(), np.zeros((quality_model.BUCKETS, quality_model.DIM))
    for t in texts[:-1]:
        ids = quality_model.pieces(t or "")
        for a, b in zip(ids, ids[1:]):
            want[a] += index[b]
            want[b] += index[a]
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert (quality_model.context_vectors(df.where("doc_id <> 14")) == want).all()
    model = quality_model.train(df, labels, "_id <> 14")
    assert np.allclose(model["vectors"][:, : quality_model.DIM], want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-6), atol=1e-6)
    assert len(set(map(int, quality_model.pieces("education position fraction")))) == 3


def test_mixing_splits_repeated_rows_at_the_cut(spark):
    rows = [(None, "one two three four", "a")] * 700 + [(5, "one two", "b")] * 300 + [(i, "a b c", "b") for i in range(100, 200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert len(got) == len(rows)
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["_size"] * r["_times"] for r in own) - own[0]["_target"]) <= 2.5


def test_katz_pairs_and_groups(spark, monkeypatch):
    """Scores against a dictionary of pairs, over several groups and buckets, with words named by code and by hash, nulls, repeated rows and null ids."""
    import random
    import zlib

    monkeypatch.setattr(katz, "GROUP", 300)
    monkeypatch.setattr(katz, "PART", 400)
    monkeypatch.setattr(katz, "HEAVY", 1100)
    rng = random.Random(3)
    rows = [(i, " ".join(f"W{int(rng.paretovariate(0.4)) % 4000}" for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [rows[3], (None, "w1 w1 w2"), (500, None), (501, "w1\t w2 x")]
    train = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w] + [None]
    one, two, after = Counter(), Counter(), defaultdict(dict)
    for i, t in rows:
        if train(i):
            words = split(t)
            one.update(words)
            two.update(zip([1, *words], words, strict=False))
    n, v = sum(one.values()), len(one)
    factor = katz.discounts(Counter(two.values()))
    for (h, w), c in two.items():
        after[h][w] = c
    p = lambda w: (one[w] + 1) / (n + v + 1)

    def value(h, w):
        seen = after.get(h)
        if not seen:
            return p(w)
        ch, dh = sum(seen.values()), sum(c * factor.get(c, 1) for c in seen.values())
        rest = max(1 - dh / ch, 1e-9)
        norm = rest + dh / ch
        return (seen[w] * factor.get(seen[w], 1) / ch if w in seen else rest / (1 - sum(map(p, seen))) * p(w)) / norm

    wanted = sorted((str(i), train(i), len(x), sum(one[w] > 0 for w in x), round(sum(math.log10(p(w)) for w in x), 6), round(sum(math.log10(value(h, w)) for h, w in zip([1, *x], x, strict=False)), 6)) for i, x in ((i, split(t)) for i, t in rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = katz.katz_scores(df, training_row(F.col("doc_id"), 7) != 2).collect()
    assert sorted((str(r["_id"]), r["_train"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == wanted
    assert {r["train_tokens"] for r in got} == {n}
    assert katz.katz_scores(df.limit(0), training_row(F.col("doc_id"), 7) != 2).count() == 0


def test_katz_moves_pairs_not_tokens(spark):
    """What a group asks of a bucket names a frequent word by a code: pairs take a few bytes each."""

    words = np.arange(1, 2001, dtype=np.uint64) * katz.MIX
    codes = np.arange(2000).astype("<u4")
    planes = codes.view(np.uint8).reshape(-1, 4)[:, :3]
    none = np.empty(0, np.uint64)
    packed = katz._zip(planes, planes[::-1], none, none, none, np.ones(2000, "<u4"))
    h, w, share, c, hot = katz._asked_pairs(packed, 2000, words, np.arange(2000) + 1)
    assert len(packed) < 8 * 2000 and (h == words).all() and (w == words[::-1]).all() and (c == 1).all() and share[0] == 2000 and hot.sum() == katz.HOT


def test_packing_looks_up_pieces_only(spark):
    """New words of a batch are looked up among the pieces met so far; these are not gone through."""
    from tokenizers import Tokenizer

    class Met(dict):
        def keys(self):
            raise AssertionError("all pieces are gone through")

        __iter__ = keys

    path = corpus_pipeline.tokenizer_path()
    model, words = Tokenizer.from_file(path), ["Word,", "word", "", "don't", "a1.", "word"]
    pieces = Met()
    for _ in range(2):
        assert packing.word_ids(model, packing.bare_tokenizer(path), packing.end_ids(model), words, pieces) == packing._one_by_one(model, words)
    assert "word" in pieces and " " not in pieces
