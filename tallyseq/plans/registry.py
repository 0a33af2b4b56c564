"""All queries of the library outside the optional subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseq.functions import dna
from tallyseq.operators import barcode, demux, match, molecules, qc
from tallyseq.plans.views import frame, with_views

FLAGSHIP = "feature_per_cell"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Col = F.col


def query(name: str, sql: str | None, *views: str) -> Callable:
    """Registers a function of the named views' DataFrames, with its SQL over v_<view>."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[frame(spark, sf_dir, v) for v in views])
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, *views)
        return f

    return register


def digits(code: str, n: int) -> str:
    return " + ".join(f"cast(greatest(instr('ACGT', substr({code}, {i + 1}, 1)) - 1, 0) as bigint) * {4 ** (n - 1 - i)}" for i in range(n))


# --- scalar functions -----------------------------------------------------------------------------------------------


@query("encode_roundtrip", f"select wl_idx, barcode, {digits('barcode', 8)} as code, barcode as decoded from v_whitelist", "whitelist")
def encode_roundtrip(w: DataFrame) -> DataFrame:
    code = dna.encode(Col("barcode"))
    return w.select("wl_idx", "barcode", code.alias("code"), dna.decode(code, 8).alias("decoded"))


@query("revcomp", "select read_id, translate(seq, 'ACGT', 'TGCA') as comp, reverse(translate(seq, 'ACGT', 'TGCA')) as revcomp, reverse(seq) as rev from v_reads", "reads")
def revcomp(r: DataFrame) -> DataFrame:
    return r.select("read_id", dna.complement(Col("seq")).alias("comp"), dna.reverse_complement(Col("seq")).alias("revcomp"), F.reverse("seq").alias("rev"))


@query("nxt_translate", "select read_id, concat(substr(seq, 1, 7), translate(substr(seq, 8, 2), 'ACGT', 'TGCA'), substr(seq, 10)) as translated from v_reads", "reads")
def nxt_translate(r: DataFrame) -> DataFrame:
    return r.select("read_id", dna.translate_nxt(Col("seq")).alias("translated"))


@query("hamming_packed", "select a.feature_index as a, b.feature_index as b, cast(hamming(a.sequence, b.sequence) as bigint) as packed, cast(hamming(a.sequence, b.sequence) as bigint) as plain from v_features a join v_features b on a.feature_index < b.feature_index", "features")
def hamming_packed(f: DataFrame) -> DataFrame:
    a, b = f.select(Col("feature_index").alias("a"), Col("sequence").alias("x")), f.select(Col("feature_index").alias("b"), Col("sequence").alias("y"))
    return a.join(F.broadcast(b), Col("a") < Col("b")).select("a", "b", dna.hamming_packed(dna.encode(Col("x")), dna.encode(Col("y"))).cast("long").alias("packed"), dna.hamming(Col("x"), Col("y")).cast("long").alias("plain"))


@query("phred_prob", "select read_id, round(pow(10.0, (ascii(substr(barcode_qual, 1, 1)) - 33) * -0.1), 9) as p from v_reads", "reads")
def phred_prob(r: DataFrame) -> DataFrame:
    return r.select("read_id", F.round(dna.error_probability(F.substring("barcode_qual", 1, 1)), 9).alias("p"))


@query("n_budget", "select read_id, cast(length(seq) - length(replace(seq, 'N', '')) as bigint) as n, regexp_matches(seq, '^[ACGTN]+$') and length(seq) - length(replace(seq, 'N', '')) < 1 as none_allowed, regexp_matches(seq, '^[ACGT]+$') as is_dna from v_reads", "reads")
def n_budget(r: DataFrame) -> DataFrame:
    return r.select("read_id", dna.n_count(Col("seq")).cast("long").alias("n"), dna.within_n_budget(Col("seq"), 1).alias("none_allowed"), dna.is_dna(Col("seq")).alias("is_dna"))


@query("n_expand", "select read_id, case when contains(seq, 'N') then concat(split_part(seq, 'N', 1), b.b, substr(seq, length(split_part(seq, 'N', 1)) + 2)) else seq end as spelled from v_reads, (values ('A'), ('C'), ('G'), ('T')) b(b) where contains(seq, 'N') or b.b = 'A'", "reads")
def n_expand(r: DataFrame) -> DataFrame:
    return r.select("read_id", F.explode(dna.expand_n(Col("seq"), 2)).alias("spelled"))


@query("pattern_offset", "select feature_index, cast(instr(pattern, '(BC)') - 1 as bigint) as pattern_offset, cast(instr('5PNNNN', '(BC)') - 1 as bigint) as absent from v_features", "features")
def pattern_offset(f: DataFrame) -> DataFrame:
    return f.select("feature_index", dna.pattern_offset(Col("pattern")).cast("long").alias("pattern_offset"), dna.pattern_offset(F.lit("5PNNNN")).cast("long").alias("absent"))


@query("mark_diffs", "select read_id, array_to_string(list_transform(range(1, 21), lambda i: case when substr(sequence, i, 1) = substr(w, i, 1) then substr(w, i, 1) else lower(substr(w, i, 1)) end), '') as marked from (select read_id, substr(seq, 5, 20) as w, 'ACGTTGCAATCGGATCCTAG' as sequence from v_reads) r where length(w) = 20", "reads")
def mark_diffs(r: DataFrame) -> DataFrame:
    window = F.substring("seq", 5, 20)
    return r.where(F.length(window) == 20).select("read_id", dna.mark_differences(F.lit("ACGTTGCAATCGGATCCTAG"), window).alias("marked"))


@query("slices", "select read_id, substr(seq, 1, 8) as head, substr(seq, 9, 5) as umi, case when length(seq) >= 19 and regexp_matches(upper(substr(seq, 12, 8)), '^[ACGT]+$') then upper(substr(seq, 12, 8)) end as kmer from v_reads", "reads")
def slices(r: DataFrame) -> DataFrame:
    split = barcode.split_read(r.select("read_id", Col("seq").alias("r1_seq"), Col("seq").alias("r1_qual")), 8, 5)
    return split.select("read_id", Col("barcode").alias("head"), "umi", dna.kmer(Col("r1_seq"), 11).alias("kmer"))


# --- barcodes -------------------------------------------------------------------------------------------------------

NEIGHBOURS = """
pos as (select unnest(range(0, 8)) as pos), sub as (select * from (values ('CGTA'), ('GTAC'), ('TACG')) s(t)),
unknown as (select distinct barcode from v_reads where barcode is not null and barcode not in (select barcode from v_whitelist)),
tried as materialized (select u.barcode, p.pos, concat(substr(u.barcode, 1, p.pos), translate(substr(u.barcode, p.pos + 1, 1), 'ACGT', s.t), substr(u.barcode, p.pos + 2)) as candidate
  from unknown u, pos p, sub s where regexp_matches(u.barcode, '^[ACGT]+$')),
near as (select t.barcode, t.candidate, t.pos from tried t join v_whitelist w on w.barcode = t.candidate),
ncand as (select u.barcode, min(w.barcode) as candidate, count(*) as n from unknown u, (values ('A'), ('C'), ('G'), ('T')) b(b), v_whitelist w
  where length(u.barcode) - length(replace(u.barcode, 'N', '')) = 1 and w.barcode = replace(u.barcode, 'N', b.b) group by u.barcode having count(*) = 1),
classed as (select r.*, k.k, case when r.barcode is null then 'short' when not regexp_matches(r.umi, '^[ACGT]+$') then 'bad_umi' when w.barcode is not null then 'valid'
    when n.candidate is not null then 'n_corrected' when k.k = 1 then 'corrected' when k.k between 2 and 3 then 'pending' when k.k > 3 then 'ambiguous' else 'no_match' end as status,
    coalesce(w.barcode, n.candidate, case when k.k = 1 then k.c end) as target
  from v_reads r left join v_whitelist w on r.barcode = w.barcode left join (select barcode, count(*) as k, min(candidate) as c from near group by barcode) k on k.barcode = r.barcode left join ncand n on n.barcode = r.barcode),
settled as (select *, case when status in ('valid', 'n_corrected', 'corrected') then target end as corrected from classed),
totals as (select corrected as barcode, count(*) as n from settled where corrected is not null group by corrected),
ev as (select s.read_id, e.candidate, (1 + coalesce(t.n, 0)) * pow(10.0, (ascii(substr(s.barcode_qual, cast(e.pos + 1 as int), 1)) - 33) * -0.1) as w
  from settled s join near e on e.barcode = s.barcode left join totals t on t.barcode = e.candidate where s.status = 'pending'),
post as (select read_id, candidate, w / sum(w) over (partition by read_id) as posterior from ev)
"""


@query("whitelist_exact", "select read_id, barcode from v_reads where barcode in (select barcode from v_whitelist)", "reads", "whitelist")
def whitelist_exact(r: DataFrame, w: DataFrame) -> DataFrame:
    return barcode.exact(r, w).select("read_id", "barcode")


@query("whitelist_neighbor1", f"with {NEIGHBOURS} select barcode, candidate, cast(pos as bigint) as pos from near", "reads", "whitelist")
def whitelist_neighbor1(r: DataFrame, w: DataFrame) -> DataFrame:
    unknown = r.where("barcode is not null").join(w, "barcode", "left_anti")
    return barcode.one_mismatch(unknown, w, 8).select("barcode", "candidate", Col("pos").cast("long").alias("pos"))


@query("whitelist_n_rescue", f"with {NEIGHBOURS} select barcode, candidate from ncand", "reads", "whitelist")
def whitelist_n_rescue(r: DataFrame, w: DataFrame) -> DataFrame:
    return barcode.n_rescue(r.where("barcode is not null"), w, max_n=2)


@query("read_status", f"with {NEIGHBOURS} select read_id, status, corrected from settled", "reads", "whitelist")
def read_status(r: DataFrame, w: DataFrame) -> DataFrame:
    return barcode.classify(r, w, 8, max_n=2).select("read_id", "status", "corrected")


@query("posterior_evidence", f"with {NEIGHBOURS} select read_id, candidate, round(posterior, 9) as posterior from post", "reads", "whitelist")
def posterior_evidence(r: DataFrame, w: DataFrame) -> DataFrame:
    classed = barcode.classify(r, w, 8, max_n=2)
    totals = classed.where("corrected is not null").groupBy(Col("corrected").alias("barcode")).agg(F.count("*").alias("n"))
    return barcode.evidence(classed.where("status = 'pending'"), totals).withColumn("posterior", F.round("posterior", 9))


@query("posterior_rescue", f"with {NEIGHBOURS} select read_id, candidate as barcode from post where posterior > 0.975", "reads", "whitelist")
def posterior_rescue(r: DataFrame, w: DataFrame) -> DataFrame:
    return barcode.correct(r, w, 8, max_n=2).where("status = 'rescued'").select("read_id", Col("corrected").alias("barcode"))


@query("read_status_counts", f"with {NEIGHBOURS} select case when status <> 'pending' then status when read_id in (select read_id from post where posterior > 0.975) then 'rescued' else 'rejected' end as status, count(*) as n from settled group by 1", "reads", "whitelist")
def read_status_counts(r: DataFrame, w: DataFrame) -> DataFrame:
    return qc.status_counts(barcode.correct(r, w, 8, max_n=2))


# --- feature search -------------------------------------------------------------------------------------------------

SPELLED = "whole as (select read_id, case when contains(seq, 'N') then replace(seq, 'N', b.b) else seq end as seq from v_reads, (values ('A'), ('C'), ('G'), ('T')) b(b) where contains(seq, 'N') or b.b = 'A')"


def best_of(hits: str, ties: str = "count(distinct feature_index) = 1") -> str:
    return f"select read_id, min(feature_index) as feature_index, min(h) as hamming, arg_min(pos, (prio, pos, w)) as match_position, arg_min(w, (prio, pos, w)) as matched_sequence from (select *, min(h) over (partition by read_id) as low from {hits}) where h = low group by read_id having {ties}"


def anchored(name: str, at: str, m: int, source: str = "whole") -> str:
    return f"{name} as (select distinct r.read_id, f.feature_index, hamming(substr(r.seq, {at} + 1, 20), f.sequence) as h, {at} as pos, 0 as prio, substr(r.seq, {at} + 1, 20) as w from {source} r, v_features f where length(r.seq) >= {at} + 20 and hamming(substr(r.seq, {at} + 1, 20), f.sequence) <= {m})"


OUT = "read_id, cast(feature_index as int) as feature_index, cast(hamming as bigint) as hamming, cast(match_position as bigint) as match_position, matched_sequence"
EVERYWHERE = "every as (select distinct r.read_id, f.feature_index, hamming(substr(r.seq, cast(o.o as int) + 1, 20), f.sequence) as h, o.o as pos, 0 as prio, substr(r.seq, cast(o.o as int) + 1, 20) as w from whole r, (select unnest(range(0, 40)) as o) o, v_features f where length(r.seq) >= o.o + 20 and hamming(substr(r.seq, cast(o.o as int) + 1, 20), f.sequence) <= 1), exact as (select read_id, arg_min(feature_index, (pos % 4, feature_index, pos, w)) as feature_index, 0 as hamming, arg_min(pos, (pos % 4, feature_index, pos, w)) as match_position, arg_min(w, (pos % 4, feature_index, pos, w)) as matched_sequence from every where h = 0 group by read_id)"
EXHAUSTIVE = f"{EVERYWHERE}, wide as (select * from exact union all {best_of('every where read_id not in (select read_id from exact)', 'count(*) = 1')})"


def typed(hits: DataFrame) -> DataFrame:
    return hits.select("read_id", Col("feature_index").cast("int").alias("feature_index"), Col("hamming").cast("long").alias("hamming"), Col("match_position").cast("long").alias("match_position"), "matched_sequence")


@query("feature_exact", f"with {anchored('hit', '4', 0, 'v_reads')} select {OUT} from ({best_of('hit')})", "reads", "features")
def feature_exact(r: DataFrame, f: DataFrame) -> DataFrame:
    return typed(match.exact_at(r, f, 4))


@query("feature_fuzzy_anchor", f"with {SPELLED}, {anchored('hit', '4', 1)} select {OUT} from ({best_of('hit')})", "reads", "features")
def feature_fuzzy_anchor(r: DataFrame, f: DataFrame) -> DataFrame:
    return typed(match.fuzzy_at(r, f, 4, 1))


@query("feature_window_search", f"""with {SPELLED}, places as (select * from (values (0, 4), (1, 5), (2, 3), (3, 6), (4, 2)) p(prio, pos)),
hit as (select distinct r.read_id, f.feature_index, hamming(substr(r.seq, p.pos + 1, 20), f.sequence) as h, p.pos, p.prio, substr(r.seq, p.pos + 1, 20) as w from whole r, places p, v_features f where length(r.seq) >= p.pos + 20 and hamming(substr(r.seq, p.pos + 1, 20), f.sequence) <= 1),
exact as (select read_id, arg_min(feature_index, (prio, feature_index)) as feature_index, 0 as hamming, arg_min(pos, (prio, feature_index)) as match_position, arg_min(w, (prio, feature_index)) as matched_sequence from hit where h = 0 group by read_id)
select {OUT} from (select * from exact union all {best_of('hit where read_id not in (select read_id from exact)')})""", "reads", "features")
def feature_window_search(r: DataFrame, f: DataFrame) -> DataFrame:
    return typed(match.in_window(r, f, 4, 2, 1))


@query("feature_exhaustive", f"with {SPELLED}, {EXHAUSTIVE} select {OUT} from wide", "reads", "features")
def feature_exhaustive(r: DataFrame, f: DataFrame) -> DataFrame:
    return typed(match.exhaustive(r, f, 1))


def cascade_sql(at: Callable[[str, int, int], str]) -> str:
    """``at(name, shift, m)``: hits at the anchor and a shift."""
    return f"""{SPELLED}, {at('h0', 0, 0)}, e0 as ({best_of('h0')}),
{at('h1', -1, 0)}, e1 as ({best_of('h1 where read_id not in (select read_id from e0)')}),
{at('h2', 1, 0)}, e2 as ({best_of('h2 where read_id not in (select read_id from e0) and read_id not in (select read_id from e1)')}),
first as (select * from e0 union all select * from e1 union all select * from e2),
{at('a1', 0, 1)}, near as ({best_of('a1 where read_id not in (select read_id from first)')}), {EXHAUSTIVE},
rest as (select *, 0 as rank from near union all select *, 1 as rank from wide where read_id not in (select read_id from first)),
found as (select read_id, feature_index, hamming, match_position, matched_sequence from first union all select read_id, feature_index, hamming, match_position, matched_sequence from (select *, row_number() over (partition by read_id order by hamming, rank) as k from rest) where k = 1)"""


CASCADE = cascade_sql(lambda name, shift, m: anchored(name, str(4 + shift), m))
OWN = cascade_sql(lambda name, shift, m: anchored(name, f"(f.pattern_offset + {shift})", m))


@query("feature_cascade", f"with {CASCADE} select {OUT} from found", "reads", "features")
def feature_cascade(r: DataFrame, f: DataFrame) -> DataFrame:
    return typed(match.cascade(r, f, 4, 1))


@query("feature_own_anchors", f"with {OWN} select {OUT} from found", "reads", "features")
def feature_own_anchors(r: DataFrame, f: DataFrame) -> DataFrame:
    """Each feature at the anchor of its pattern, two of them in this list."""
    return typed(match.cascade(r, f, match.OWN, 1))


@query("multi_read_combine", f"""with {SPELLED}, {anchored('a', '4', 1)}, {anchored('b', '5', 1)}, x as ({best_of('a')}), y as ({best_of('b')}),
hit as (select read_id, feature_index, hamming as h, match_position as pos, 0 as prio, matched_sequence as w from x union all select read_id, feature_index, hamming, match_position, 1, matched_sequence from y) select {OUT} from ({best_of('hit')})""", "reads", "features")
def multi_read_combine(r: DataFrame, f: DataFrame) -> DataFrame:
    both = match.fuzzy_at(r, f, 4, 1).withColumn("source", F.lit(0)).unionByName(match.fuzzy_at(r, f, 5, 1).withColumn("source", F.lit(1)))
    return typed(match.combine(both))


@query("topk_sequences", f"with {SPELLED}, {anchored('hit', '4', 1)}, best as ({best_of('hit')}) select matched_sequence, count(*) as n, cast(arg_min(feature_index, read_id) as int) as feature_index, cast(arg_min(hamming, read_id) as bigint) as hamming, cast(arg_min(match_position, read_id) as bigint) as match_position from best group by matched_sequence", "reads", "features")
def topk_sequences(r: DataFrame, f: DataFrame) -> DataFrame:
    return match.feature_sequences(typed(match.fuzzy_at(r, f, 4, 1)))


@query("offset_mode", "select pattern_offset, n, runner_up, runner_up > 0.05 * n as mixed from (select pattern_offset, n, coalesce(lead(n) over (order by n desc, pattern_offset), 0) as runner_up, row_number() over (order by n desc, pattern_offset) as k from (select pattern_offset, count(*) as n from v_features group by pattern_offset)) where k = 1", "features")
def offset_mode(f: DataFrame) -> DataFrame:
    return match.anchor_offset(f)


@query("modal_length", "select cast(length(sequence) as int) as length, count(*) as n from v_features group by 1 order by n desc, 1 limit 1", "features")
def modal_length(f: DataFrame) -> DataFrame:
    return match.modal_length(f)


@query("offset_sweep", "select cast(o.o as int) as offset, count(p.variant) as hits, count(*) as total from v_library_reads r cross join (select unnest(range(0, 6)) as o) o left join (select distinct variant from v_probes) p on p.variant = substr(r.seq, cast(o.o as int) + 1, 8) group by 1", "library_reads", "probes")
def offset_sweep(r: DataFrame, p: DataFrame) -> DataFrame:
    return match.offset_sweep(r, p, 2, 3)


# --- molecules ------------------------------------------------------------------------------------------------------


@query("raw_counts", "select barcode, feature_index, cast(sum(reads) as bigint) as n from v_molecules group by barcode, feature_index", "molecules")
def raw_counts(m: DataFrame) -> DataFrame:
    return molecules.raw_counts(m.withColumn("read", F.explode(F.sequence(F.lit(1), Col("reads")))))


@query("barcode_totals_rollup", "select barcode, feature_index, cast(sum(reads) as bigint) as n from v_molecules group by rollup (barcode, feature_index)", "molecules")
def barcode_totals_rollup(m: DataFrame) -> DataFrame:
    return molecules.barcode_totals(m.withColumn("read", F.explode(F.sequence(F.lit(1), Col("reads")))))


@query("molecule_counts", "select barcode, umi, feature_index, reads from v_molecules", "molecules")
def molecule_counts(m: DataFrame) -> DataFrame:
    return molecules.molecule_counts(m.withColumn("read", F.explode(F.sequence(F.lit(1), Col("reads")))))


@query("distinct_cols", "select count(distinct concat(barcode, umi)) as barcode_umis, count(distinct barcode) as barcodes from v_molecules", "molecules")
def distinct_cols(m: DataFrame) -> DataFrame:
    return molecules.distinct_counts(m)


def clique_sql(strict: bool = False) -> str:
    apart = " and pos.pos % 4 <> 0" if strict else ""
    return f"""umis as materialized (select distinct barcode, umi from v_molecules), edge as materialized (select a.barcode, a.umi, b.umi as other from umis a, (select unnest(range(0, 6)) as pos) pos, (values ('CGTA'), ('GTAC'), ('TACG')) s(t), umis b
  where b.barcode = a.barcode{apart} and b.umi = concat(substr(a.umi, 1, pos.pos), translate(substr(a.umi, pos.pos + 1, 1), 'ACGT', s.t), substr(a.umi, pos.pos + 2))),
reach(barcode, umi, far) as (select barcode, umi, umi from umis union select r.barcode, r.umi, e.other from reach r join edge e on e.barcode = r.barcode and e.umi = r.far),
label as (select barcode, umi, min(far) as clique_id from reach group by barcode, umi),
clique as (select m.barcode, l.clique_id, m.feature_index, cast(sum(m.reads) as bigint) as reads from v_molecules m join label l on l.barcode = m.barcode and l.umi = m.umi group by m.barcode, l.clique_id, m.feature_index)"""


@query("umi_edges", f"with recursive {clique_sql()} select barcode, umi, other from edge", "molecules")
def umi_edges(m: DataFrame) -> DataFrame:
    return molecules.umi_edges(m, 6)


@query("umi_cliques", f"with recursive {clique_sql()} select * from clique", "molecules")
def umi_cliques(m: DataFrame) -> DataFrame:
    return molecules.cliques(m, 6)


@query("umi_cliques_strict", f"with recursive {clique_sql(True)} select * from clique", "molecules")
def umi_cliques_strict(m: DataFrame) -> DataFrame:
    return molecules.cliques(m, 6, strict=True)


TOP = "select barcode, feature_index from (select *, sum(reads) over w as total, max(reads) over w as top from clique window w as (partition by barcode, clique_id)) where reads = top and total > 0 and reads > total * {s} / 1000.0 qualify count(*) over (partition by barcode, clique_id) = 1"
ONLY = "select barcode, feature_index from (select *, count(*) over (partition by barcode, clique_id) as k from clique) where k = 1 and reads > 0"
LOWEST = "select barcode, feature_index from (select *, row_number() over (partition by barcode, clique_id order by feature_index) as k from clique) where k = 1 and reads > 0"
VOTES = {"dedup_stringency0": (0, False, "select barcode, feature_index from clique where reads > 0"), "dedup_stringency_mid": (500, False, TOP.format(s=500)), "dedup_stringency1": (1, False, TOP.format(s=1)), "dedup_stringency1000": (1000, False, ONLY), "dedup_stringency1000_strict": (1000, True, LOWEST)}
DEDUP = f"{clique_sql()}, dedup as (select barcode, feature_index, count(*) as umis from ({TOP.format(s=1)}) group by barcode, feature_index)"


def _votes(name: str, stringency: int, strict: bool, sql: str) -> None:
    @query(name, f"with recursive {clique_sql()} select barcode, feature_index, count(*) as umis from ({sql}) group by barcode, feature_index", "molecules")
    def run(m: DataFrame) -> DataFrame:
        return molecules.clique_votes(molecules.cliques(m, 6), stringency, 0, strict)


for _name, _args in VOTES.items():
    _votes(_name, *_args)


def dedup(m: DataFrame) -> DataFrame:
    return molecules.dedup_counts(m, 6, 1, 0)


def on_dedup(name: str, sql: str) -> Callable:
    return query(name, f"with recursive {DEDUP} {sql}", "molecules")


@on_dedup("feature_per_cell", "select barcode, count(*) as num_features, cast(case when count(*) filter (umis = top) = 1 then max(feature_index) filter (umis = top) else 0 end as int) as top_feature_index, cast(sum(umis) as bigint) as total_deduped_umi from (select *, max(umis) over (partition by barcode) as top from dedup) group by barcode")
def feature_per_cell(m: DataFrame) -> DataFrame:
    return qc.feature_per_cell(dedup(m))


@on_dedup("count_histogram", "select coalesce(feature_index, 0) as feature_index, umis, count(*) as frequency from dedup group by grouping sets ((feature_index, umis), (umis))")
def count_histogram(m: DataFrame) -> DataFrame:
    return qc.count_histogram(dedup(m))


@on_dedup("richness_histogram", "select richness, count(*) as barcodes from (select barcode, count(*) as richness from dedup group by barcode) group by richness")
def richness_histogram(m: DataFrame) -> DataFrame:
    return qc.richness_histogram(dedup(m))


RICH = "select feature_index, richness, count(*) as barcodes from (select *, count(*) over (partition by barcode) as richness from dedup) group by feature_index, richness"


@on_dedup("feature_richness_matrix", f"select *, max(barcodes) over (partition by feature_index) as row_max from ({RICH})")
def feature_richness_matrix(m: DataFrame) -> DataFrame:
    return qc.feature_richness(dedup(m))


@on_dedup("column_sums", f"select richness, cast(sum(barcodes) // richness as bigint) as total from ({RICH}) group by richness")
def column_sums(m: DataFrame) -> DataFrame:
    return qc.column_sums(qc.feature_richness(dedup(m)))


@on_dedup("feature_count_matrix", "select feature_index, " + ", ".join(f"count(*) filter (least(umis, 12) = {i}) as c{i}" for i in range(1, 13)) + " from dedup group by feature_index")
def feature_count_matrix(m: DataFrame) -> DataFrame:
    return qc.feature_count_matrix(dedup(m), 12)


@on_dedup("heatmap_filter", "select feature_index, cast(sum(umis) as bigint) as total from dedup group by feature_index having sum(umis) > 1")
def heatmap_filter(m: DataFrame) -> DataFrame:
    return qc.heatmap_rows(dedup(m))


@on_dedup("matrix_coo", "select feature_index, dense_rank() over (order by barcode) as \"column\", umis from dedup")
def matrix_coo(m: DataFrame) -> DataFrame:
    return qc.matrix_coo(dedup(m))


ALLOWED = "(select distinct barcode from v_molecules where barcode < 'M')"


@on_dedup("filter_semi", f"select * from dedup where barcode in {ALLOWED}")
def filter_semi(m: DataFrame) -> DataFrame:
    return qc.semi(dedup(m), m.where("barcode < 'M'").select("barcode").distinct())


@on_dedup("filter_anti", f"select count(distinct barcode) as barcodes, cast(coalesce(sum(umis), 0) as bigint) as umis from dedup where barcode not in {ALLOWED}")
def filter_anti(m: DataFrame) -> DataFrame:
    return qc.excluded(dedup(m), m.where("barcode < 'M'").select("barcode").distinct())


@on_dedup("raw_vs_dedup", "select r.barcode, cast(r.n as bigint) as reads, cast(d.umis as bigint) as umis from (select barcode, sum(reads) as n from v_molecules group by barcode) r join (select barcode, sum(umis) as umis from dedup group by barcode) d on d.barcode = r.barcode")
def raw_vs_dedup(m: DataFrame) -> DataFrame:
    return m.groupBy("barcode").agg(F.sum("reads").alias("reads")).join(dedup(m).groupBy("barcode").agg(F.sum("umis").alias("umis")), "barcode")


@on_dedup("signal_ratio", "select cast(sum(umis) filter (feature_index in (1, 2)) as bigint) as signal, cast(sum(umis) as bigint) as total, sum(umis) filter (feature_index in (1, 2)) / sum(umis) as ratio from dedup")
def signal_ratio(m: DataFrame) -> DataFrame:
    return qc.signal_ratio(dedup(m).select(Col("feature_index").cast("string").alias("key"), Col("umis").alias("value")), ["1", "2"])


@query("union_lanes", "select lane, count(*) as n, count(distinct barcode) as barcodes from v_reads group by lane", "reads")
def union_lanes(r: DataFrame) -> DataFrame:
    lanes = [r.where(Col("lane") == f"L{i}") for i in range(4)]
    return lanes[0].unionByName(lanes[1]).unionByName(lanes[2]).unionByName(lanes[3]).groupBy("lane").agg(F.count("*").alias("n"), F.count_distinct("barcode").alias("barcodes"))


@query("conservation", "select library_id, count(*) as given, count(*) as made, true as equal from v_library_reads group by library_id", "library_reads", "probes", "sample_map")
def conservation(r: DataFrame, p: DataFrame, s: DataFrame) -> DataFrame:
    """Routing neither loses nor repeats a read of a library."""
    return qc.conservation(r, demux.route(demux.probe_of(r, p, 2), s), "library_id")


def run_sql(neighbours: str) -> str:
    return f"""{neighbours.replace("from v_reads r left join", "from v_reads r join hits on hits.read_id = r.read_id left join").replace("unknown as (select distinct barcode from v_reads", "unknown as (select distinct barcode from v_reads semi join hits using (read_id)").strip()},
done as (select s.read_id, s.umi, coalesce(s.corrected, p.candidate) as barcode, h.feature_index from settled s join hits h on h.read_id = s.read_id left join (select * from post where posterior > 0.975) p on p.read_id = s.read_id)"""


RUN = run_sql(NEIGHBOURS)
# the same within each event type, the sample of the program's query
RUN_BY_SAMPLE = run_sql(NEIGHBOURS.replace("select corrected as barcode, count(*) as n from settled where corrected is not null group by corrected", "select event_type, corrected as barcode, count(*) as n from settled where corrected is not null group by event_type, corrected").replace("t.barcode = e.candidate", "t.barcode = e.candidate and t.event_type = s.event_type"))


@query("assigned_counts", f"with {SPELLED}, {anchored('hit', '4', 1)}, hits as ({best_of('hit')}), {RUN} select barcode, cast(feature_index as int) as feature_index, count(*) as n from done where barcode is not null group by barcode, feature_index", "reads", "whitelist", "features")
def assigned_counts(r: DataFrame, w: DataFrame, f: DataFrame) -> DataFrame:
    """Feature first, barcodes only of reads with a feature, correction and rescue, counts."""
    from tallyseq.plans import assign

    return molecules.raw_counts(assign.assigned(r, w, f, 8, offset=4, anchored_only=True, max_n_barcode=2)).withColumn("feature_index", Col("feature_index").cast("int"))


# --- demultiplexing and alignments ----------------------------------------------------------------------------------

PROBED = "probed as (select r.*, p.probe_name from v_library_reads r left join v_probes p on p.variant = substr(r.seq, 3, 8))"
ROUTED = f"{PROBED}, routed as (select p.read_id, p.seq, p.probe_name, case when p.probe_name is null then 'undetermined' when s.sample is null then 'unspecified' else 'matched' end as route, case when p.probe_name is null then concat('undetermined/', p.library_id, '_unk') when s.sample is null then concat('unspecified/', p.library_id, '_', p.probe_name) else s.sample end as sample_group from probed p left join v_sample_map s on s.library_id = p.library_id and s.probe_name = p.probe_name)"


@query("demux_probe", f"with {PROBED} select read_id, probe_name from probed", "library_reads", "probes")
def demux_probe(r: DataFrame, p: DataFrame) -> DataFrame:
    return demux.probe_of(r, p, 2).select("read_id", "probe_name")


@query("demux_route", f"with {ROUTED} select read_id, route, sample_group from routed", "library_reads", "probes", "sample_map")
def demux_route(r: DataFrame, p: DataFrame, s: DataFrame) -> DataFrame:
    return demux.route(demux.probe_of(r, p, 2), s).select("read_id", "route", "sample_group")


@query("demux_totals", f"with {ROUTED} select count(*) filter (route = 'matched') as matched, count(*) filter (route = 'unspecified') as unspecified, count(*) filter (route = 'undetermined') as undetermined, count(*) as total from routed", "library_reads", "probes", "sample_map")
def demux_totals(r: DataFrame, p: DataFrame, s: DataFrame) -> DataFrame:
    return demux.totals(demux.route(demux.probe_of(r, p, 2), s))


@query("library_id", "select read_id, concat('SC', substr(library_id, 3)) as library_id from v_library_reads", "library_reads")
def library_id(r: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/run/x/"), "library_id", F.lit("_S1_L001_R1_001.fastq.gz"))
    return r.select("read_id", demux.library_id(path).alias("library_id"))


def tags_of(a: DataFrame) -> DataFrame:
    return a.withColumn("tags", F.map_filter(F.create_map(F.lit("CB"), "cb", F.lit("UB"), "ub", F.lit("GE"), "gene"), lambda k, v: v.isNotNull())).drop("cb", "ub", "gene")


USABLE = "usable as (select *, cb <> '-' and ub <> '-' and not starts_with(gene, '-') as countable, case when (flag & 16) <> 0 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as oriented from v_alignments where (flag & 2304) = 0 and (flag & 1024) = 0 and mapq >= 5 and gene is not null)"
DESCRIBED = "passing as (select *, case when (flag & 16) <> 0 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as oriented from v_alignments where (flag & 2304) = 0 and (flag & 1024) = 0 and mapq >= 5), described as (select a.*, a.gene is not null as complete, case when a.gene is not null then p.probe_index end as probe, a.gene is not null and p.probe_index is not null and cb <> '-' and ub <> '-' and not starts_with(gene, '-') as counted from passing a left join v_probes p on p.variant = substr(a.oriented, 3, 8))"
AT2 = "hit as (select u.*, p.probe_index from usable u join v_probes p on p.variant = substr(u.oriented, 3, 8) where countable)"
NEAR = "hit as (select u.*, coalesce(a.probe_index, b.probe_index, c.probe_index, d.probe_index, e.probe_index) as probe_index from usable u left join v_probes a on a.variant = substr(u.oriented, 3, 8) left join v_probes b on b.variant = substr(u.oriented, 4, 8) left join v_probes c on c.variant = substr(u.oriented, 5, 8) left join v_probes d on d.variant = substr(u.oriented, 2, 8) left join v_probes e on e.variant = substr(u.oriented, 1, 8) where countable)"


def usable(a: DataFrame) -> DataFrame:
    return demux.tagged(demux.usable(tags_of(a), 5))


@query("aln_filters", f"with {USABLE} select rec_no, qname, gene, countable from usable", "alignments")
def aln_filters(a: DataFrame) -> DataFrame:
    return usable(a).select("rec_no", "qname", "gene", "countable")


@query("aln_probe_counts", f"with {USABLE}, {AT2} select cb, probe_index, count(*) as n from hit group by cb, probe_index", "alignments", "probes")
def aln_probe_counts(a: DataFrame, p: DataFrame) -> DataFrame:
    return demux.probe_counts(usable(a), p, 2)


@query("aln_probe_umis", f"with {USABLE}, {AT2} select cb, probe_index, count(distinct concat(ub, gene)) as n from hit group by cb, probe_index", "alignments", "probes")
def aln_probe_umis(a: DataFrame, p: DataFrame) -> DataFrame:
    return demux.probe_counts(usable(a), p, 2, count="umis")


@query("aln_nearby", f"with {USABLE}, {NEAR} select cb, probe_index, count(*) as n from hit where probe_index is not null group by cb, probe_index", "alignments", "probes")
def aln_nearby(a: DataFrame, p: DataFrame) -> DataFrame:
    return demux.probe_counts(usable(a), p, 2, nearby=True)


@query("aln_probe_totals", f"with {USABLE}, {AT2} select probe_index, count(*) as n, count(distinct cb) as cells from hit group by probe_index", "alignments", "probes")
def aln_probe_totals(a: DataFrame, p: DataFrame) -> DataFrame:
    return demux.probe_counts(usable(a), p, 2).groupBy("probe_index").agg(F.sum("n").alias("n"), F.count("*").alias("cells"))


@query("aln_stats", f"with {USABLE}, {AT2} select (select count(*) from usable) as total_reads, (select count(*) from usable where countable) as countable_reads, (select count(*) from hit) as counted, (select count(distinct cb) from hit) as cells, (select count(*) from (select distinct cb, probe_index from hit)) as entries", "alignments", "probes")
def aln_stats(a: DataFrame, p: DataFrame) -> DataFrame:
    return demux.alignment_stats(usable(a), demux.probe_counts(usable(a), p, 2))


@query("aln_last_per_qname", f"with {DESCRIBED} select qname, arg_max(cb, rec_no) as cb, arg_max(ub, rec_no) as ub, arg_max(gene, rec_no) as gene from described where counted group by qname", "alignments", "probes")
def aln_last_per_qname(a: DataFrame, p: DataFrame) -> DataFrame:
    return demux.last_counted(demux.described(demux.usable(tags_of(a), 5), p, 2))


@query("aln_described", f"with {DESCRIBED} select rec_no, complete, cast(coalesce(probe, 0) as int) as probe, counted from described", "alignments", "probes")
def aln_described(a: DataFrame, p: DataFrame) -> DataFrame:
    return demux.described(demux.usable(tags_of(a), 5), p, 2).select("rec_no", "complete", F.coalesce("probe_index", F.lit(0)).cast("int").alias("probe"), "counted")


@query("aln_cbub_join", "select a.rec_no, w.barcode as cb, substr(a.seq, 1, 6) as ub, w.barcode is not null as in_range from v_alignments a left join v_whitelist w on w.wl_idx = a.rec_no % 2003 + 1 where a.mapq % 4 <> 0", "alignments", "whitelist")
def aln_cbub_join(a: DataFrame, w: DataFrame) -> DataFrame:
    cbub = a.select("rec_no", (Col("mapq") % 4 != 0).alias("has_tags"), (Col("rec_no") % 2003 + 1).cast("long").alias("cb_idx"), F.substring("seq", 1, 6).alias("umi"))
    return demux.with_cbub(a.select("rec_no"), cbub, w).select("rec_no", "cb", "ub", "in_range")


@query("aln_nh", "select rec_no, greatest(coalesce(nh, 1), 1) as nh, coalesce(gene, 'none') as gene from v_alignments", "alignments")
def aln_nh(a: DataFrame) -> DataFrame:
    return tags_of(a).select("rec_no", dna.hits_of(Col("nh")).alias("nh"), F.coalesce(dna.gene_of(Col("tags")), F.lit("none")).alias("gene"))


from tallyseq.plans import roundtrips  # noqa: E402, F401 (registers its queries)
