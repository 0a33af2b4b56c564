"""Views that read the star-schema tables as sequencing data, in SQL that Spark and DuckDB both run.

Placeholders such as {events} stand for the tables. Codes are XORed as (a | b) - (a & b), which both engines know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

def enc(code: str, n: int) -> str:
    """SQL for the ``n`` bases of a packed code."""
    return "concat(" + ", ".join(f"substr('ACGT', cast((({code}) >> {2 * (n - 1 - k)}) & 3 as int) + 1, 1)" for k in range(n)) + ")"


def mutated(s: str, p: str) -> str:
    """SQL for ``s`` with the base at 0-based ``p`` changed."""
    return f"concat(substr({s}, 1, cast({p} as int)), translate(substr({s}, cast({p} as int) + 1, 1), 'ACGT', 'CGTA'), substr({s}, cast({p} as int) + 2))"


# A guide of 20 bases for each nation, at least 12 bases apart; the last three have another anchor.
FEATURES = f"select feature_index, concat('guide', cast(feature_index as varchar(3))) as name, sequence, concat(repeat('N', pattern_offset), '(BC)') as pattern, pattern_offset from (select cast(n_nationkey + 1 as int) as feature_index, {enc('(cast(n_nationkey + 1 as bigint) * 136778135883 + 95943707480) & 1099511627775', 20)} as sequence, cast(case when n_nationkey < 22 then 4 else 5 end as int) as pattern_offset from {{nation}}) f"

WHITELIST = f"select cast(row_number() over (order by code) as bigint) as wl_idx, {enc('code', 8)} as barcode, code from (select distinct (c_custkey * 2654435) & 65535 as code from {{customer}}) w"

_RAW = f"""
select event_id, user_id, event_type, lane, feature_no, code,
  {enc('case when event_id % 7 = 0 then (code | x) - (code & x) else code end', 8)} as whole,
  {enc('cast(round(value * 100) as bigint) & 1023', 5)} as umi0,
  {enc('event_id & 255', 4)} as head, {enc('(event_id * 13) & 4095', 6)} as tail, {enc('(event_id * 2654435761) & 1099511627775', 20)} as noise
from (select *, ((user_id + 1) * 2654435) & 65535 as code, (event_id % 3 + 1) << cast(2 * (event_id % 8) as int) as x, (event_id + user_id) % 26 + 1 as feature_no, event_id % 4 as lane from {{events}}) e
"""

READS = f"""
select event_id as read_id, concat('L', cast(lane as varchar(2))) as lane, event_type,
  case when event_id % 101 = 0 then null when event_id % 11 = 0 then concat(substr(whole, 1, cast(event_id % 8 as int)), 'N', substr(whole, cast(event_id % 8 as int) + 2)) else whole end as barcode,
  case when event_id % 97 = 0 then concat('N', substr(umi0, 2)) else umi0 end as umi,
  repeat(concat(chr(cast(40 + event_id % 33 as int)), chr(cast(40 + event_id * 5 % 31 as int))), 4) as barcode_qual,
  concat(head, case when event_id % 13 = 0 then 'A' when event_id % 17 = 0 then 'ACGTA' else '' end, case when event_id % 19 = 0 then concat(substr(body, 1, cast(event_id * 5 % 20 as int)), 'N', substr(body, cast(event_id * 5 % 20 as int) + 2)) else body end, tail) as seq
from (select *, case when event_id % 15 = 0 then {mutated('body1', '(event_id * 3 + 7) % 20')} else body1 end as body
  from (select *, case when event_id % 5 = 0 then {mutated('body0', 'event_id * 3 % 20')} else body0 end as body1
    from (select r.*, coalesce(f.sequence, noise) as body0 from ({_RAW}) r left join ({FEATURES}) f on f.feature_index = r.feature_no) a) b) c
"""

MOLECULES = f"""
select barcode, umi, feature_index, count(*) as reads from (
  select {enc('(user_id * 2654435) & 65535', 8)} as barcode, {enc('cast(round(value * 100) as bigint) & 4095', 6)} as umi,
    cast(case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 else 4 + length(event_type) % 3 end as int) as feature_index
  from {{events}}) m group by barcode, umi, feature_index
"""

# One alignment for each line item; the probe sits at offset 2 of the read as sequenced, or up to two bases beside it. Line items that agree in
# all four numbers are told apart by their order among themselves.
ALIGNMENTS = f"""
select ((l_orderkey * 8 + l_linenumber) * 68719476736 + l_partkey * 65536 + l_suppkey) * 4 + again - 1 as rec_no,
  concat('q', cast(l_orderkey as varchar(20))) as qname,
  cast((case when l_returnflag = 'R' then 16 else 0 end) + (case when l_partkey % 23 = 0 then 256 else 0 end) + (case when l_suppkey % 19 = 0 then 1024 else 0 end) as int) as flag,
  cast(l_quantity as int) as mapq,
  case when l_returnflag = 'R' then reverse(translate(forward, 'ACGT', 'TGCA')) else forward end as seq,
  case when l_suppkey % 17 = 0 then '-' else {enc('(l_suppkey * 2654435) & 65535', 8)} end as cb,
  case when l_partkey % 29 = 0 then '-' else {enc('l_orderkey & 4095', 6)} end as ub,
  case when l_linenumber = 7 then null when l_linenumber = 6 then concat('-', p_brand) else p_brand end as gene,
  cast(l_linenumber as int) as nh
from (select l.*, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey order by l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as again, p.p_brand, concat(substr('GATTACA', 1, cast(2 + l_linenumber % 3 - (case when l_linenumber = 4 then 2 else 0 end) as int)), {enc('(l_partkey % 40 * 1031) & 65535', 8)}, 'TTTTTT') as forward
  from {{lineitem}} l join {{part}} p on l.l_partkey = p.p_partkey) a
"""

PROBES = f"select variant, min(probe_index) as probe_index, min(probe_name) as probe_name from (select {enc('(k * 1031) & 65535', 8)} as variant, cast(k % 16 + 1 as int) as probe_index, concat('BC', lpad(cast(k % 16 + 1 as varchar(4)), 3, '0')) as probe_name from (select distinct p_partkey % 32 as k from {{part}}) p) q group by variant"

SAMPLE_MAP = "select concat('SC', cast(n_nationkey as varchar(4))) as library_id, concat('BC', lpad(cast(n_nationkey % 12 + 1 as varchar(4)), 3, '0')) as probe_name, n_name as sample from {nation}"

# Reads of libraries for routing: the library is the supplier's nation, the probe is at offset 2.
LIBRARY_READS = f"""
select (l_orderkey * 8 + l_linenumber) * 68719476736 + l_partkey * 65536 + l_suppkey as read_id, concat('SC', cast(s_nationkey as varchar(4))) as library_id,
  concat('GA', {enc('((case when l_linenumber < 5 then s_nationkey % 12 else l_partkey % 40 end) * 1031) & 65535', 8)}, 'TT') as seq
from {{lineitem}} l join {{supplier}} s on l.l_suppkey = s.s_suppkey
"""

VIEWS = {"features": FEATURES, "whitelist": WHITELIST, "reads": READS, "molecules": MOLECULES, "alignments": ALIGNMENTS, "probes": PROBES, "sample_map": SAMPLE_MAP, "library_reads": LIBRARY_READS}


PACKED, WIDE = "(l_orderkey * 8", "(cast(l_orderkey as decimal(20, 0)) * 8"
NUMBERED = {"alignments": 4, "library_reads": 1}  # views with numbers made of the keys of line items, and what these are multiplied by


def fits(lines: DataFrame, times: int) -> bool:
    """Whether the numbers that PACKED begins stay within 64 bits for all line items."""
    most = lambda c: F.coalesce(F.max(F.abs(c)), F.lit(0)).alias(c)
    m = lines.agg(*map(most, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.count("*").alias("n")).first()
    return (((m["l_orderkey"] * 8 + m["l_linenumber"]) << 36) + (m["l_partkey"] << 16) + m["l_suppkey"]) * times + m["n"] < 1 << 63


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables.

    Record and read numbers made of line items are long as in the SQL where 64 bits hold them; for larger order keys the same numbers are decimals.
    """
    text = VIEWS[view]
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    if view in NUMBERED and not fits(read["lineitem"], NUMBERED[view]):
        text = text.replace(PACKED, WIDE)
    return spark.sql(text, **read)


def with_views(sql: str, *views: str) -> str:
    """DuckDB text with the views as common table expressions v_<name>."""
    heads = [f"v_{v} as ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in views]
    rest = sql.strip()
    recursive = rest.lower().startswith("with recursive")
    if rest.lower().startswith("with"):
        rest = rest[len("with recursive") if recursive else len("with") :].strip()
        return f"with {'recursive ' if recursive else ''}{', '.join(heads)}, {rest}" if heads else sql
    return f"with {', '.join(heads)} {rest}" if heads else sql
