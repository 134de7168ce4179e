"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import dart_minhash, exact_dedup, html_text, katz, license_scan, merkle, mixing, packing, quality_model, quality_rules, set_join, spelling, warc
from strandline.llm.common import training_row


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model.train(docs, _table(spark, sf_dir, "labels"), "crc32(cast(cast(_id as string) as binary)) % 5 <> 0")
    found = quality_model.scores(docs, model)
    return found.select(F.col("_id").alias("doc_id"), (training_row(F.col("_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(_table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"))
    return verdicts.withColumnRenamed("_id", "doc_id")


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = katz.katz_scores(_table(spark, sf_dir, "documents"), training_row(F.col("doc_id"), 7) != 2)
    return found.select(F.col("_id").alias("doc_id"), (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url", "payload")


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dart_minhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "class_id", "class_size", "kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_path())
    return pieces.select(F.col("_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), largest=True)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(_table(spark, sf_dir, "pages"))
    return found.withColumnsRenamed({"_id": "page_id", "_url": "url"})


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    altered = F.when(training_row(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(docs, altered={"text": altered}, proofs=False)
    return found.select(F.col("_id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(_table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_katz": op4_katz,
    "op5_warc": op5_warc,
    "op6_dart_minhash": op6_dart_minhash,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_html_text": op10_html_text,
    "op11_spelling": op11_spelling,
    "op12_merkle": op12_merkle,
    "op13_set_join": op13_set_join,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op12_merkle": """
        with recursive bits as (
          select *, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda c: ascii(c)::bigint)),
                   lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]),
                                            lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)) % 2 = 1 as tampered
          from documents),
        fields as (
          select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                 || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
                 case when tampered then replace(text, chr(10), '') else text end as other from bits),
        leaves as (
          select *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) as changed from fields),
        placed as (
          select doc_id, leaf, changed, dense_rank() over (order by source nulls first) as g,
                 row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from leaves),
        inner_nodes(g, lvl, i, n, d) as (
          select g, 0, i, n, leaf from placed
          union all
          select g, lvl + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' order by i)) from inner_nodes where n > 1 group by g, lvl, i // 3),
        subroots as (select g, d from inner_nodes where n = 1),
        outer_nodes(lvl, i, n, d) as (
          select 0, g - 1, (select count(*) from subroots), d from subroots
          union all
          select lvl + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' order by i)) from outer_nodes where n > 1 group by lvl, i // 3),
        nodes as (
          select g, lvl, i, n, d from inner_nodes union all select -1, lvl, i, n, d from outer_nodes),
        steps as (
          select a.g, a.lvl, a.i, coalesce(string_agg(b.d, '' order by b.i) filter (b.i < a.i), '') as ahead,
                 coalesce(string_agg(b.d, '' order by b.i) filter (b.i > a.i), '') as behind
          from nodes a join nodes b on a.g = b.g and a.lvl = b.lvl and a.i // 3 = b.i // 3 where a.n > 1 group by a.g, a.lvl, a.i),
        folded(leaf_g, leaf_i, g, lvl, i, h, proof) as (
          select g, i, g, 0, i, changed, '' from placed
          union all
          select f.leaf_g, f.leaf_i, case when s.g is null then -1 else f.g end, case when s.g is null then 0 else f.lvl + 1 end,
                 case when s.g is null then f.leaf_g - 1 else f.i // 3 end,
                 case when s.g is null then f.h else sha256(s.ahead || f.h || s.behind) end,
                 case when s.g is null then f.proof else f.proof || s.ahead || s.behind end
          from folded f left join steps s on f.g = s.g and f.lvl = s.lvl and f.i = s.i where f.g >= 0 or s.g is not null),
        ends as (
          select leaf_g, leaf_i, arg_max(h, lvl) as folded_root, sha256(arg_max(proof, lvl)) as proof_sha256 from folded where g = -1 group by all)
        select p.doc_id, p.leaf, r.d as subroot, (select d from outer_nodes where n = 1) as root, e.proof_sha256, e.folded_root,
               e.folded_root = (select d from outer_nodes where n = 1) as verified
        from placed p join subroots r on p.g = r.g join ends e on e.leaf_g = p.g and e.leaf_i = p.i""",
    "op5_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        r as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as last_id,
                     row_number() over (partition by payload_digest, payload_bytes, page_id) as copy from p),
        t as (select *, payload_bytes >= 1000 and not (page_id is not distinct from last_id and copy = 1) as again from r)
        select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type,
               case when again then last_id end as refers_to from t""",
    "op9_exact_dedup": """
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents window g as (partition by coalesce(text, ''))""",
}
