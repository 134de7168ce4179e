"""Quality rules: base rules and robust multivariate outliers.

Every text becomes a vector of transformed statistics. For each language and source the location and
scatter of the vectors are estimated by the minimum covariance determinant: starting from medians,
concentration steps keep the half of the documents with the smallest Mahalanobis distances and
estimate anew. A step is two aggregations over the small table of vectors, whatever the size of a
group. The scatter is made consistent by the median of the distances, and the sampling error of a
text's own statistics is added to it: a short text cannot be told from the others by one event, a
long one can. A document is rejected when its squared distance is beyond a chi-square quantile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import among, keyed, map_arrow
from strandline.session import settled

FEATURES = ["f_symbol", "f_upper", "f_mark", "f_word", "f_repeat", "f_line", "f_stutter"]
#: Variance that keeps matrices invertible.
TINY = 1e-8
#: Rows a group must have for estimates of its own; smaller groups use all rows of their language, then of the table.
LEAST = 50
#: Chi-square quantiles for seven features: 0.5 makes the scatter consistent, beyond 0.999 a document is rejected.
MEDIAN, CUTOFF = 6.346, 24.322
STEPS = 4
SYMBOLS = b"#*$%&|<>"


def _stats(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the feature vector and its error variances of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = sum(map(len, [joined.decode("utf-8", "surrogatepass")])) if joined else 0
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 8:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        w = np.zeros(n - 7, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(8):
                w = w * np.uint64(0x9E3779B97F4A7C15) + h[i : n - 7 + i]
                w ^= w >> np.uint64(29)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        if same.any():
            twice = np.zeros(n - 7, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            reach = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(reach, at, 1)
            np.add.at(reach, at + 8, -1)
            repeat = int((np.cumsum(reach)[:n] > 0).sum())
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(joined) - len(joined.translate(None, b"!?;:=_/\\@~^+0123456789"))
    c = max(chars, 1)
    # Ten characters of prior keep short texts from standing out by a single mark.
    root = lambda k: float(np.sqrt(k / (c + 50)))
    vector = [root(symbols), root(upper), root(marks), float(np.log((chars + 50) / (n + 10))), float(np.sqrt(repeat / max(n, 1))), float(np.sqrt(dup / max(len(lines), 1))), float(np.sqrt(sum(map(bytes.__eq__, words, words[1:])) / max(n, 1)))]
    # The square root of a share of k events has a variance of 1/4 over their number; repeats come in eights.
    error = [0.25 / (c + 50)] * 3 + [0.25 / (n + 10), 2 / max(n, 1), 0.25 / max(len(lines), 1), 0.25 / max(n, 1)]
    return n, chars, symbols, dup, repeat, vector, error


def _map(batches):
    for batch in batches:
        got = [_stats(t or "") for t in batch.column("text").to_pylist()]
        cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(5)] + [pa.array([g[5][i] for g in got], pa.float64()) for i in range(len(FEATURES))] + [pa.array([g[6] for g in got], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), batch.column("source"), *cols], ["_id", "_lang", "_source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES, "_error"])


def _scatter(frames):
    """Mean and covariance of each group from its sums; one row each. It is widened for the few rows it may rest on."""
    p = len(FEATURES)
    for f in frames:
        rows = []
        for n, s, q in zip(f["n"], f["s"], f["q"], strict=True):
            mean = np.asarray(s, float) / n
            second = np.zeros((p, p))
            second[np.triu_indices(p)] = np.asarray(q, float) / n
            cov = second + np.triu(second, 1).T - np.outer(mean, mean)
            rows.append((list(mean), list((cov * (n + p + 1) / n).ravel())))
        yield pd.DataFrame({"group": f["group"], "mean": [r[0] for r in rows], "cov": [r[1] for r in rows]})


def _distances(batches):
    """Squared distances: the difference to the mean in the metric of the scatter plus the errors of the text itself."""
    p = len(FEATURES)
    for batch in batches:
        n = batch.num_rows
        matrix = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        d = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], 1) - matrix("mean")
        whole = matrix("cov").reshape(n, p, p) + (matrix("_error") + TINY)[:, :, None] * np.eye(p)
        got = (d * np.linalg.solve(whole, d[:, :, None])[:, :, 0]).sum(1)
        names = [c for c in batch.schema.names if c not in ("mean", "cov")]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(got)], [*names, "distance"])


def quality_verdicts(docs: DataFrame, text: str = "text", ident: str = "doc_id", lang: str = "lang", source: str = "source",
                     cutoff: float = CUTOFF, least: int = LEAST, steps: int = STEPS) -> DataFrame:
    """One row per row of docs: _id, the base statistics, base_failed, distance (squared; null without estimates), kept.

    Only rows that pass the base rules are estimated from. Null languages and sources are groups like
    any other; a group below least such rows is held against all rows of its language, or of the whole
    table where those are below least too, however few. The distance is null only in a table without any
    row that passes the base rules. A null text has no words and fails. Empty table: no rows.
    """
    kind = docs.schema[ident].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    stats = map_arrow(docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")), _map,
                      f"_id {kind}, _lang string, _source string, {longs}, " + ", ".join(f"{c} double" for c in FEATURES) + ", _error array<double>")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    own = F.to_json(F.struct(F.lit(1).alias("k"), F.col("_lang").alias("l"), F.col("_source").alias("s")))
    lang_key = F.to_json(F.struct(F.lit(2).alias("k"), F.col("_lang").alias("l")))
    stats = settled(stats.select("*", failed.alias("base_failed"), own.alias("_own"), lang_key.alias("_lk")), "stats")
    counts = settled(stats.groupBy("_own", "_lk").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n")), "counts")
    langs = counts.groupBy("_lk").agg(F.sum("n").alias("m"), F.max(F.col("n") < least).alias("_small"))
    table = langs.agg(F.max(F.col("_small") & (F.col("m") < least)).alias("_few"))
    big, middle = F.col("n") >= least, F.col("m") >= least
    group = F.when(big, F.col("_own")).when(middle, F.col("_lk")).otherwise(F.lit("all"))
    # A row is estimated from in its own group and in every pool that some small group is held against.
    pools = F.array_compact(F.array(F.when(big, F.col("_own")), F.when(F.col("_small") & middle, F.col("_lk")), F.when(F.col("_few"), F.lit("all"))))
    names = settled(counts.join(langs, "_lk").crossJoin(table).select("_own", group.alias("group"), pools.alias("_pools")), "groups")
    rows = settled(stats.join(names, "_own").drop("_own", "_lk"), "vectors")
    good = rows.where("not base_failed").select(F.explode("_pools").alias("group"), *FEATURES, "_error")
    x = [F.col(c) for c in FEATURES]
    start = good.groupBy("group").agg(*[F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(f"q{i}") for i, c in enumerate(x)])
    p = len(FEATURES)
    scale = [F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) for i in range(p)]
    params = settled(start.select("group", F.array(*[F.col(f"q{i}")[1] for i in range(p)]).alias("mean"), F.array(*[scale[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("cov")), "centres")

    def distance(rows: DataFrame) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.join(params, "group").select(*rows.columns, "mean", "cov").mapInArrow(_distances, f"{kinds}, distance double")

    for step in range(steps + 2):
        near = settled(distance(good).drop("_error"), "distances")
        limit = settled(near.groupBy("group").agg(F.percentile_approx("distance", F.lit(0.5), 10000).alias("half")), "limits")
        wide = F.greatest(F.col("half") / MEDIAN, F.lit(1.0))
        if step > steps:
            # Consistent: half of the rows within the median of chi-square.
            params = settled(params.join(limit, "group").select("group", "mean", F.transform("cov", lambda c: c * wide).alias("cov")), "centres")
            break
        # Half of the rows in the concentration steps, all within the cutoff in the last, reweighting one.
        inside = near.join(limit, "group").where(F.col("distance") <= (F.col("half") if step < steps else wide * CUTOFF))
        sums = inside.groupBy("group").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p)]).alias("q"))
        params = settled(sums.mapInPandas(_scatter, "group string, mean array<double>, cov array<double>"), "centres")
    base = ["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = distance(rows.select(*base, "group", *FEATURES, "_error")).select(*base, "distance")
    # Without any good row there are no estimates, and every row fails the base rules.
    rest = rows.join(params, "group", "left_anti").select(*base, F.lit(None).cast("double").alias("distance"))
    verdict = found.unionByName(rest)
    return verdict.select(*base, "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(False))).alias("kept"))


def passing(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns unchanged, whatever their names; nulls and repeated rows as above."""
    whole = keyed(docs)
    light = whole.select("_row", *[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c != "_row"])
    gone = quality_verdicts(light, ident="_row", **options).where("not kept").select(F.col("_id").alias("_row"))
    return among(whole, gone, inside=False).select("_doc.*")
