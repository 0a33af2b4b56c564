"""Queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseq.llm import bloom_lm, bpe, conversations, language_id, line_dedup, merkle, minhash_dedup, packing, quality_rules, recompression, secret_ledger, token_counts, vp_tree
from tallyseq.llm.common import read


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(read(spark, sf_dir, "documents"))


def op3_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return vp_tree.nearest(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.digest(recompression.without_repeats(read(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.digest(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(bpe.encode_and_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(merkle.manifest(read(spark, sf_dir, "documents"), merkle.lower_cased()))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(read(spark, sf_dir, "conversations")))


QUERIES = {"op1_minhash_dedup": op1_minhash_dedup, "op2_bloom_lm": op2_bloom_lm, "op3_vp_tree": op3_vp_tree, "op4_language_id": op4_language_id, "op5_recompression": op5_recompression, "op6_packing": op6_packing, "op7_line_dedup": op7_line_dedup, "op8_secret_ledger": op8_secret_ledger, "op9_bpe": op9_bpe, "op10_quality_rules": op10_quality_rules, "op11_token_counts": op11_token_counts, "op12_merkle_manifest": op12_merkle_manifest, "op13_conversation_repair": op13_conversation_repair}

WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
with recursive w as materialized (select doc_id, {WORDS.format(text=LOWER)} as w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from w),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
link as materialized (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
edge as materialized (select a, b from link union all select b, a from link),
reach(doc_id, far) as (select doc_id, doc_id from documents union select r.doc_id, e.b from reach r join edge e on e.a = r.far),
label as (select doc_id, min(far) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, l.component_id, d.doc_id = l.component_id as kept from documents d join label l on l.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
"""

OP3_SQL = """
with v as (select vec_id, cast(embedding as double[]) as v from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (select q.vec_id as query_id, c.vec_id, list_distance(q.v, c.v) as score from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as int) as rank, vec_id, score from d qualify rank <= 10
"""

OP5_SQL = f"""
with w as materialized (select doc_id, {WORDS.format(text="text")} as w from documents),
p as materialized (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
gone as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) as first from p) where first < doc_id),
dead as (select distinct doc_id, i + k as i from gone, (select unnest(range(0, 50)) as k)),
dead_list as (select doc_id, list(i) as dead from dead group by doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(dead), 0) as bigint) as n_removed,
  sha256(array_to_string(case when dead is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(dead, x[2])), lambda x: x[1]) end, ' ')) as kept_sha256
from w left join dead_list d on d.doc_id = w.doc_id
"""


def _op8_sql() -> str:
    rows = []
    for i, r in enumerate(secret_ledger.RULES):
        p = r.pattern.replace("'", "''")
        rows.append(f"select doc_id, {i} as rank, '{r.kind}' as kind, {r.least} as least, regexp_extract_all(t, '{p}') as hit, regexp_extract_all(t, '{p}', {r.group}) as val, string_split_regex(t, '{p}') as gap from d")
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), m as ({" union all ".join(rows)}),
e as (select *, unnest(range(1, len(hit) + 1)) as i from m),
span as (select doc_id, rank, kind, len(val[i]) >= least as good, coalesce(list_sum(list_transform(gap[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: len(x))), 0) as s, len(hit[i]) as n from e),
g as (select doc_id, rank, s, concat(kind, ':', cast(s as bigint), ':', cast(s + n as bigint)) as x from span where good)
select d.doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  sha256(coalesce(string_agg(x, ',' order by s, rank) filter (rank < 3), '')) as base_sha256, coalesce(string_agg(x, ',' order by s, rank), '') as spans
from d left join g on g.doc_id = d.doc_id group by d.doc_id
"""


ELEMENT = "coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"


def _op12_sql() -> str:
    leaf = lambda text: f"sha256(concat({', '.join(ELEMENT.format(c=c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"
    tree = lambda name, first: f"""{name}(k, g, i, n, h) as ({first} union all select k + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from {name} where n > 1 group by k, g, i // 8, n)"""
    return f"""
with recursive d as materialized (select *, case when crc32_(doc_id) % 3 = 0 then {LOWER} else text end as other from documents),
l as materialized (select doc_id, coalesce('=' || lang, '') as g, {leaf('text')} as leaf, {leaf('other')} as touched from d),
o as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from l),
{tree('low', 'select 0, g, i, n, leaf from o')}, subroots as materialized (select g, h from low where n = 1),
{tree('top', "select 0, '', row_number() over (order by g) - 1, count(*) over (), h from subroots")},
names as (select g, h as subroot, row_number() over (order by g) - 1 as t from subroots), root as (select h as root from top where n = 1),
runs as materialized (select 0 as z, k, g, i // 8 as j, string_agg(h, '' order by i) as run from low where n > 1 group by all union all select 1, k, g, i // 8, string_agg(h, '' order by i) from top where n > 1 group by all),
step as (select o.g, o.i, z, k, cast(floor(case when z = 0 then o.i else t end / pow(8, k)) as bigint) % 8 as p, run from o join names on names.g = o.g
  join runs r on (z = 0 and r.g = o.g and r.j = cast(floor(o.i / pow(8, k + 1)) as bigint)) or (z = 1 and r.j = cast(floor(t / pow(8, k + 1)) as bigint))),
proof as (select g, i, list(p || substr(run, 1, cast(64 * p as int)) || substr(run, cast(64 * p + 65 as int)) order by z, k) as steps from step group by g, i),
a as (select o.doc_id, o.leaf, o.touched, names.subroot, root.root, coalesce(steps, []) as steps from o join names on names.g = o.g cross join root left join proof on proof.g = o.g and proof.i = o.i),
f as (select *, sha256(array_to_string(list_transform(steps, lambda x: substr(x, 2)), '')) as proof_sha256,
  list_reduce(list_prepend(touched, steps), lambda h, x: sha256(concat(substr(x, 2, 64 * cast(x[1] as int)), h, substr(x, 2 + 64 * cast(x[1] as int))))) as folded_root from a)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from f
""".replace("crc32_(doc_id)", CRC.format(x="cast(doc_id as varchar)"))


# crc32 of an ASCII string, bit by bit
CRC = "xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, cast(length({x}) as bigint) + 1), lambda i: cast(ascii(substr({x}, cast(i as int), 1)) as bigint))), lambda c, b: list_reduce(list_prepend(xor(c, b), cast(range(0, 8) as bigint[])), lambda v, z: xor(v >> 1, case when v & 1 = 1 then 3988292384 else 0 end))))"


def _op13_sql() -> str:
    """Least (cost, audit, repaired lines) to the end of the pattern from each of its four places, row by row from the last one."""
    best = lambda *ways: f"list_min([{', '.join(ways)}])"
    way = lambda cost, edit, to, line="[]": f"{{'c': {cost} + ({to}).c, 'a': '{edit}' || ({to}).a, 'l': list_concat({line}, ({to}).l)}}"
    line = lambda role, text: f"[concat({role}, ':', {text})]"
    keep = {0: "case x.r when 's' then p1 when 'u' then p2 end", 1: "case when x.r = 'u' then p2 end", 2: "case when x.r = 'a' then p3 end", 3: "case when x.r = 'u' then p2 end"}
    add, to = {0: "'user'", 1: "'user'", 2: "'assistant'", 3: "'user'"}, {0: 2, 1: 2, 2: 3, 3: 2}
    rows = []
    for q in range(4):
        kept = f"case when x.fault in (0, 3) and {keep[q]} is not null then {way('if(x.fault = 3, 3, 0)', 'K', keep[q], line('x.role', 'x.text'))} end"
        rerole = f"case when x.fault in (0, 3) then {way('if(x.fault = 3, 6, 3)', 'R', f'p{to[q]}', line(add[q], 'x.text'))} end"
        rows.append(f"{best(way('4', 'D', f'p{q}'), kept, rerole)} as b{q}")
    insert = lambda q, then: way("3", "I", then, line(add[q], "''"))
    closed = [best(f"b{q}", insert(q, f"b{to[q]}"), insert(q, insert(to[q], f"b{to[to[q]]}"))) + f" as p{q}" for q in range(4)]
    none = "{'c': 0, 'a': '', 'l': []::varchar[]}"
    ends = [f"{none} as b0", f"{{'c': 1000000000000, 'a': '', 'l': []::varchar[]}} as b1", f"{{'c': 1000000000000, 'a': '', 'l': []::varchar[]}} as b2", f"{none} as b3"]
    key = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
    return f"""
with recursive g as materialized (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC.format(x='key')} % 20 as kind from (select *, {key} as key from conversations)),
r as materialized (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as copy from g where kind <> 0),
o as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last, case when substr(role, 1, 1) in ('s', 'u', 'a') then substr(role, 1, 1) else '-' end as r from r),
x as materialized (select *, case when last = '' then 1 when again > 1 then 2 when last in ('.', '!', '?') then 0 else 3 end as fault, lag(r) over (partition by conv_id order by k) as before from o),
n as (select conv_id, max(k) as k from x group by conv_id),
dp(conv_id, k, p0, p1, p2, p3) as (select conv_id, k, {', '.join(closed)} from (select conv_id, k, {', '.join(ends)} from n) e
  union all select conv_id, k, {', '.join(closed)} from (select x.conv_id, x.k - 1 as k, {', '.join(rows)} from dp join x on x.conv_id is not distinct from dp.conv_id and x.k = dp.k) e),
s as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (before is not null and before || r not in ('su', 'ua', 'au')) as illegal from x group by conv_id)
select c.conv_id, coalesce(s.gaps, 0) as gaps, coalesce(s.blank, 0) as blank, coalesce(s.duplicate, 0) as duplicate, coalesce(s.truncated, 0) as truncated, coalesce(s.illegal, 0) as illegal,
  cast(coalesce(dp.p0.c, 0) as bigint) as cost, coalesce(dp.p0.a, '') as audit, sha256(coalesce(array_to_string(dp.p0.l, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join s on s.conv_id is not distinct from c.conv_id left join dp on dp.conv_id is not distinct from c.conv_id and dp.k = 0
"""


ORACLE_SQL: dict[str, str] = {"op1_minhash_dedup": OP1_SQL, "op3_vp_tree": OP3_SQL, "op5_recompression": OP5_SQL, "op8_secret_ledger": _op8_sql(), "op12_merkle_manifest": _op12_sql(), "op13_conversation_repair": _op13_sql()}
