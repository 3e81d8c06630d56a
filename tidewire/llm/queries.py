"""The registered queries of this subpackage, each over the whole ``documents`` table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import bpe, exact_dedup, fingerprints, licenses, near_dedup, packing, periodic_runs, pii, quality, token_files, toxicity, url_filters, vector_codes
from tidewire.shared import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoding_digests(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("expressions")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.file_facts(spark, path)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(documents(spark, sf_dir))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_exact_dedup,
        op3_byte_bpe,
        op4_packing,
        op5_toxicity,
        op6_near_dedup,
        op7_licenses,
        op8_token_files,
        op9_pii,
        op10_quality,
        op11_periodic_runs,
        op12_url_filters,
        op13_vector_codes,
    )
}


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codebooks and codes as common table expressions, one pair per round."""
    assign = lambda k: f"""d{k} as materialized (select r, part, entry, sum((v - c) * (v - c)) as d from x join b{k} using (part, place) group by all),
        a{k} as materialized (select r, part, min(entry) as entry, min(d) as d from (select * from d{k} qualify d = min(d) over (partition by r, part)) group by r, part)"""  # noqa: E731
    again = lambda k: f"""{assign(k)}, m{k} as materialized (select part, entry, place, sum(v)::bigint as s, count(*) as n from x join a{k} using (r, part) group by all),
        b{k + 1} as materialized (select part, entry, place, case when n is null then c else (s - ((s % n) + n) % n) // n end as c from b{k} left join m{k} using (part, entry, place))"""  # noqa: E731
    steps = ",\n        ".join([*map(again, range(rounds)), assign(rounds)])
    return f"""
        with e as materialized (
            select row_number() over (order by vec_id) as r, vec_id, label, embedding from embeddings
            where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
        u as (select r, unnest(embedding) as y, unnest(range(len(embedding))) as k, len(embedding) // {parts} as w from e),
        x as materialized (select r, k // w as part, k % w as place, floor(4096.0 * y::double)::bigint as v from u),
        b0 as materialized (select part, r - 1 as entry, place, v as c from x where r <= {entries}),
        {steps},
        o as materialized (select r, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by r)
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
            (select sha256(string_agg(c::varchar, ',' order by part, entry, place)) from b{rounds}) as codebooks_sha256
        from e join o using (r)"""

#: SQL expresses the whole result of exact deduplication and of vector codes; the others are tested against brute force.
ORACLES = {
    "op2_exact_dedup": """
        with d as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
            from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
        from d join g using (t)""",
    "op13_vector_codes": vector_codes_sql(),
}
