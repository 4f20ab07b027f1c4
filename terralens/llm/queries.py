"""The queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.llm import bpe, conversations, decontam, embeddings, langid, minhash, pii, quality, secrets, suffixdedup, toxicity, vectorcodes, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False, with_digests=True)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")), F.col("present"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_langid": op8_langid,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pii": op10_pii,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_dedup": op13_embedding_dedup,
}
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def _vector_codes_sql(rounds: int = 6) -> str:
    """The rounds as a chain of tables: near{k} has each part's nearest entry of book{k}."""
    steps = []
    for k in range(rounds + 1):
        if k:
            steps.append(f"""mean{k} as (select part, entry, place, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as c from near{k - 1} join c using (rid, part) group by part, entry, place),
book{k} as materialized (select part, entry, place, coalesce(m.c, b.c) as c from book{k - 1} b left join mean{k} m using (part, entry, place))""")
        steps.append(f"""near{k} as materialized (select rid, part, min(d) as d, arg_min(entry, {{'d': d, 'e': entry}}) as entry
 from (select rid, part, entry, cast(sum((x - b.c) * (x - b.c)) as bigint) as d from c join book{k} b using (part, place) group by rid, part, entry) group by rid, part)""")
    chain = ",\n".join(steps)
    return f"""
with v as materialized (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as e from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as materialized (select rid, (i - 1) // (n // 8) as part, (i - 1) % (n // 8) as place, e[i] as x from (select rid, e, len(e) as n, unnest(range(1, len(e) + 1)) as i from v)),
book0 as materialized (select part, entry, place, x as c from c join (select rid, row_number() over (order by vec_id) - 1 as entry from v) using (rid) where entry < 16),
{chain},
coded as (select rid, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from near{rounds} group by rid),
named as (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, place)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from v join coded using (rid) cross join named"""


def _repair_sql() -> str:
    """From each conversation's last row to its first: the least (cost, audit, repaired lines) for each state of the roles so far: none, system, user, assistant."""
    put = ["user", "user", "assistant", "user"]
    then = [3, 3, 4, 3]  # the state after the role put, counted from 1
    add = lambda cost, edit, line, rest: f"{{'c': {cost} + {rest}.c, 'a': '{edit}' || {rest}.a, 'r': {line} || {rest}.r}}"
    base, once, twice = [], [], []
    for s in range(4):
        keep = {0: "case i when 's' then b[2] when 'u' then b[3] end", 1: "case i when 'u' then b[3] end", 2: "case i when 'a' then b[4] end", 3: "case i when 'u' then b[3] end"}[s]
        base.append(f"""list_min(list_filter([{add(4, 'D', '[]', f'b[{s + 1}]')}, case when not gone then {add('3 + late', 'R', f"['{put[s]}:' || text]", f'b[{then[s]}]')} end,
 case when not gone then {add('late', 'K', "[role || ':' || text]", f'({keep})')} end], lambda x: x.c is not null))""")
        for out, name in ((once, "x"), (twice, "y")):
            out.append(f"list_min([x[{s + 1}], {add(3, 'I', f"['{put[s]}:']", f'{name}[{then[s]}]')}])")
    return f"""
with recursive k as (select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda z: ascii(z)::bigint)),
 lambda h, z: list_reduce([xor(h, z), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, j: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)), 4294967295::bigint) % 20 as k from conversations),
d as (select conv_id, turn, case when k = 4 then 'user' else coalesce(role, ' ') end as role, case k when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text,
 unnest(range(case when k = 3 then 2 else 1 end)) as copy from k where k <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as p, substr(role, 1, 1) as i from d),
f as materialized (select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, row_number() over (partition by conv_id, role, text order by p) > 1 as again,
 lag(i) over (partition by conv_id order by p) || i as pair from o),
g as materialized (select *, case when body = '' then 'b' when again then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault from f),
h as materialized (select *, fault in ('b', 'd') as gone, case when fault = 't' then 3 else 0 end as late from g),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
 count(*) filter (fault = 't') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, coalesce(max(p), 0) as rows from (select distinct conv_id from conversations) left join h using (conv_id) group by conv_id),
z as (select conv_id, rows + 1 as p, [{{'c': 0, 'a': '', 'r': []::varchar[]}}, {{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}}, {{'c': 3, 'a': 'I', 'r': ['assistant:']}}, {{'c': 0, 'a': '', 'r': []::varchar[]}}] as b from n
 union all
 select conv_id, p, [{", ".join(twice)}] from (select conv_id, p, x, [{", ".join(once).replace('y[', 'x[')}] as y from
  (select h.conv_id, h.p, [{", ".join(base)}] as x from z join h on h.conv_id = z.conv_id and h.p = z.p - 1)))
select conv_id, cast(gaps as bigint) as gaps, blank, duplicate, truncated, illegal, cast(b[1].c as bigint) as cost, b[1].a as audit, sha256(array_to_string(b[1].r, chr(10))) as repaired_sha256
from z join n using (conv_id) where p = 1"""


#: For the operators that SQL can express; the tests hold the others against brute force, the tokenizer library or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, m, array_to_string(w[s:s + m - 1], ' ') as k
        from (select item_id, w, least(len(w), 13) as m, unnest(range(1, len(w) - least(len(w), 13) + 2)) as s from i where len(w) > 0)),
pos as (select rid, m, s, array_to_string(w[s:s + m - 1], ' ') as k
        from (select rid, w, m, unnest(range(1, len(w) - m + 2)) as s from d, (select distinct m from win) where len(w) >= m)),
hit as (select rid, s, m, item_id from pos join win using (m, k)),
n as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + m)) as p from hit) group by rid),
f as (select rid, count(*) as n_items, string_agg(x, ',' order by x) as names from (select distinct rid, cast(item_id as varchar) as x from hit) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n using (rid) left join f using (rid)""",
    "op3_warc": """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
m as (select *, case when n >= 1000 then max(page_id) over (partition by n, d) else page_id end as last from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when last > page_id then 'revisit' else 'response' end as record_type,
       case when last > page_id then last end as refers_to
from m""",
    "op11_vector_codes": _vector_codes_sql(),
    "op12_conversation_repair": _repair_sql(),
    "op13_embedding_dedup": """
with recursive v as materialized (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e, len(embedding) as n from embeddings
 where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as materialized (select *, sqrt(list_dot_product(e, e)) as norm from v),
link as materialized (select a.rid as x, b.rid as y from u a join u b on a.label = b.label and a.n = b.n and a.rid <> b.rid where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach as (select rid as x, rid as y from v union select r.x, l.y from reach r join link l on l.x = r.y),
low as (select x, min(vec_id) as component_id from reach join v on v.rid = y group by x),
n as (select x, count(*) as n_links from link group by x),
found as (select rid, vec_id, n_links, component_id from v left join low on low.x = rid left join n on n.x = rid)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from found
union all
select vec_id, 0, vec_id, true from embeddings where label is null or embedding is null or len(list_filter(embedding, lambda x: x is null or not isfinite(x))) > 0 or len(list_filter(embedding, lambda x: x <> 0)) = 0""",
}
