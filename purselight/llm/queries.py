"""Queries over the tables documents, pages, benchmark, labels and conversations, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purselight.llm import bin_completion, chat_schema, compact_windows, decontaminate, license_fuzzy, line_suffix, minhash_hamming, quality_forest, url_bloom, warc_chunks
from purselight.llm.common import table

#: Tokenizer file of the packing query.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_forest.score(docs, quality_forest.fit(docs, table(spark, sf_dir, "labels")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_bloom.judge(pages, url_bloom.labelled_toxic(pages, table(spark, sf_dir, "labels")))


OP2_SQL = r"""
with parts as (
    select page_id, coalesce(url, '') as url,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
        list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref)(=|$)'))) as fields
    from pages),
named as (
    select page_id, host, path,
        regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || case when len(fields) > 0 then '?' || array_to_string(fields, '&') else '' end as canonical,
        try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})(?:\.html|/)?$', 1), '') as bigint) as doc_id
    from parts),
listed as (select distinct canonical as url from named where canonical <> '' and doc_id in (select doc_id from labels where toxic = 1)),
ruled as (
    select *, case
        when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
        when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
        when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
        when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
        when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule
    from named)
select page_id, host, path, rule,
    case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when url is not null then 'block' else 'allow' end as verdict,
    canonical, url is not null as listed
from ruled left join listed on canonical = url
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_hamming.near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, then the transitive closure.
OP3_SQL = r"""
with recursive texts as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') as words
    from documents),
shingles as (
    select distinct doc_id, md5(array_to_string(words[i:i + 4], ' ')) as shingle
    from texts, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as t(i) where len(words) > 0),
sizes as (select texts.doc_id, count(shingle) as n from texts left join shingles using (doc_id) group by 1),
links as (
    select a.doc_id as a, b.doc_id as b from shingles a join shingles b using (shingle) join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
    where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach as (
    select doc_id, doc_id as other from sizes
    union select reach.doc_id, links.b from reach join links on links.a = reach.other)
select sizes.doc_id, any_value(sizes.n)::bigint as n_shingles, min(other) as component_id, sizes.doc_id = min(other) as kept
from sizes join reach using (doc_id) group by sizes.doc_id
"""


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_fuzzy.scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.summary(warc_chunks.read(warc_chunks.archive(table(spark, sf_dir, "pages"))))


OP5_SQL = """
with payloads as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex,
        min(page_id) over (partition by coalesce(html, '')) as first
    from pages),
digests as (
    select *, list_transform(range(0, 8), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::bigint) as groups
    from payloads)
select page_id, payload_bytes::bigint as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((groups[(i // 4) + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') as payload_digest,
    case when page_id = first or first is null then 'response' else 'revisit' end as record_type,
    case when page_id = first or first is null then null else first end as refers_to
from digests
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, deleted_lines, kept_chars and kept_md5 (of the new text; null for null) of every document."""
    new = line_suffix.rewrite(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return new.select("doc_id", "deleted_lines", F.char_length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


#: Windows of up to 8 lines with 8 words or more, all lengths, equal to an earlier one.
OP7_SQL = r"""
with lines as (
    select doc_id, text, k, string_split(text, chr(10))[k] as body
    from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as t(k)),
worded as (
    select *, len(regexp_extract_all(body, '[^ 	-
]+')) as words, row_number() over (partition by doc_id order by k) as i
    from lines where regexp_matches(body, '[^ 	-
]')),
ahead as (
    select doc_id, i, list(body) over w as bodies, list(words) over w as counts
    from worded window w as (partition by doc_id order by i rows between current row and 7 following)),
windows as (
    select doc_id, i, n, bodies[1:n] as run
    from ahead, unnest(range(1, 9)) as t(n) where n <= len(bodies) and list_sum(counts[1:n]) >= 8),
later as (
    select doc_id, i, n, row_number() over (partition by run order by doc_id, i) as copy from windows),
gone as (
    select distinct doc_id, i + j as i from later, unnest(range(0, n)) as t(j) where copy > 1),
cleaned as (
    select lines.doc_id, string_agg(lines.body, chr(10) order by lines.k) as text
    from lines left join worded using (doc_id, k) left join gone on gone.doc_id = worded.doc_id and gone.i = worded.i
    where gone.i is null group by lines.doc_id)
select documents.doc_id, (select count(*) from gone where gone.doc_id = documents.doc_id)::bigint as deleted_lines,
    case when documents.text is not null then length(coalesce(cleaned.text, '')) end::bigint as kept_chars,
    case when documents.text is not null then md5(coalesce(cleaned.text, '')) end as kept_md5
from documents left join cleaned using (doc_id)
"""


#: A conversation whose texts are control strings of another template, in another layout.
CONTROL_CONVERSATION = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-1, 0, CONTROL_CONVERSATION)], "conv_id long, turn long, record string")
    records = chat_schema.turn_records(table(spark, sf_dir, "conversations")).unionByName(more)
    return chat_schema.read_back(chat_schema.format_turns(chat_schema.canonical_turns(records)))


OP8_SQL = r"""
with turns as (
    select conv_id, turn, 0 as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -1, 0, 1, 'assistant', '</s>[INST] ok [/INST]'),
pieces as (
    select *, '<|im_start|>' || replace(replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\'), chr(10), '\n') || chr(10)
        || replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') || '<|im_end|>' || chr(10) as piece
    from turns)
select conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, pos, piece)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, pos, piece) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(length(piece))::bigint as formatted_chars
from pieces group by conv_id
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (op1_quality_rules, op2_url_filters, op3_minhash_near_dedup, op4_license_scans, op5_warc, op6_benchmark_decontamination, op7_line_dedup, op8_chat_formatting, op9_substring_dedup, op10_best_fit_packing, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op3_minhash_near_dedup": OP3_SQL, "op5_warc": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_chat_formatting": OP8_SQL}
