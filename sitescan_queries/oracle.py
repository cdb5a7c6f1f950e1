"""Checking SQL (DuckDB) for the registered queries: plain definitions, no binning and no chunk table."""

from __future__ import annotations

from sitescan.defaults import CORE_WORDS
from sitescan_queries.views import (
    BASES, DIST, DIST_ORIGIN, DIST_SITES, LETTERS, LONG_CHR, LONG_INI, LONG_SIZE, MANY_BASE, MULT, NOT_LETTERS, OTHER,
)

CTE: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, needs: list[str], sql: str) -> None:
    CTE[name] = (needs, sql)


def _with(needs: list[str], body: str) -> str:
    done: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        for d in CTE[n][0]:
            add(d)
        done.append(n)

    for n in needs:
        add(n)
    # A CTE read more than once is worth keeping.
    return "with " + ",\n".join(f"{n} as materialized ({CTE[n][1]})" for n in done) + "\n" + body


_CHR = """case when event_id % 3 = 0 then 'chr0' when event_id % 50 = 1 then 'chrE' || (event_id % 25)
 else 'chr' || (event_id // 9) end"""
_INI = "((user_id * 37 + event_id) % 1500 - 5)"

_cte("seqs", [], f"""
select 'chr' || doc_id as chr_n,
       translate(regexp_replace(
           regexp_replace(text, '{NOT_LETTERS}', '', 'g'), '{OTHER}', 'N', 'g'), '{LETTERS}', '{BASES}') as seq
from documents
union all select 'chrE' || n_nationkey, '' from nation""")
_cte("contigs", ["seqs"], "select chr_n, length(seq) as n from seqs")
_cte("peaks", [], f"""
select cast(event_id as bigint) as peak_id, {_CHR} as chr_n, cast({_INI} as bigint) as pos_ini,
       cast({_INI} + 50 + event_id % 150 as bigint) as pos_end
from events""")
_cte("sites", [], f"""
select cast(event_id as bigint) as site_id,
       case when event_id % 97 = 0 then '' when event_id % 89 = 0 then null else {_CHR} end as chr_n,
       cast({_INI} as bigint) as pos_ini, cast({_INI} + 50 + event_id % 150 as bigint) as pos_end,
       'S' || event_type as seq, event_type as source, cast(value as double) as score_pssm
from events""")
_cte("genes", [], """
select 'G' || p_partkey as gene_id, 'N' || (p_partkey // 3) as gene_name,
       cast(p_partkey // 2 as varchar) as contig, cast(1 + (p_partkey * 131) % 1500 as bigint) as g_start,
       cast(1 + (p_partkey * 131) % 1500 + p_size * 10 as bigint) as g_end,
       case when p_partkey % 2 = 0 then '+' else '-' end as strand,
       case when p_type = 'ECONOMY' then 'pseudogene' else 'protein_coding' end as biotype
from part""")
_cte("raw_expression", [], """
select cast(o_orderkey as bigint) as row_ord,
       case when o_orderkey % 3 = 0 then 'G6' else 'G' || (2 * (o_orderkey // 7)) end
         || ' | G' || (3 * (o_orderkey // 5)) || '|' as raw_id,
       case when o_orderkey % 3 = 1 then 'N7' else 'N' || (o_orderkey // 20) end as gene_name,
       case when o_orderkey % 11 = 0 then 'bad' when o_orderkey % 13 = 0 then 'NA'
            else cast((o_custkey % 9 - 4) * 0.5 as varchar) end as raw_value
from orders""")
_cte("parsed", ["raw_expression"], """
select *, case when raw_value = 'NA' then cast('nan' as double) else try_cast(raw_value as double) end as lfc
from raw_expression""")
_cte("expr_rows", ["parsed"], """
select row_ord, gene_name, trim(part) as gene_id,
       case when isnan(lfc) then lfc else sign(lfc) * pow(2.0, abs(lfc)) end as fold_change
from (select *, unnest(string_split(raw_id, '|')) as part from parsed where lfc is not null)
where trim(part) <> ''""")
_cte("expr", ["expr_rows"], """
select gene_id, arg_min(fold_change, row_ord) as fold_change from expr_rows group by gene_id""")
_cte("translated", ["expr_rows", "genes"], """
select e.row_ord, g.gene_id, e.fold_change from expr_rows e join genes g using (gene_name)""")
_cte("genes_fc", ["genes", "expr"], """
select g.*, case when strand = '+' then g_start else g_end end as pos0, e.fold_change
from genes g left join expr e using (gene_id)""")
_cte("gene_table", ["genes_fc"], """
select gene_id, 'chr' || contig as chr_n, pos0, biotype, fold_change,
       cast(substr(gene_id, 2) as bigint) as gene_ord,
       case when fold_change < 0 then 'upreg' else 'downreg' end as updown
from genes_fc""")
_cte("located", ["peaks", "contigs"], """
select p.*, n,
       case when pos_ini - 1 < 0 then greatest(n + pos_ini - 1, 0) else pos_ini - 1 end as s0,
       case when pos_end < 0 then greatest(n + pos_end, 0) else least(pos_end, n) end as s1
from peaks p join contigs using (chr_n)""")
_cte("wide", ["peaks", "contigs"], f"""
select p.*, pos_ini - {DIST_SITES} as ini, n,
       case when pos_ini - {DIST_SITES} - 1 < 0 then greatest(n + pos_ini - {DIST_SITES} - 1, 0)
            else pos_ini - {DIST_SITES} - 1 end as s0,
       least(pos_end + {DIST_SITES}, n) as s1
from peaks p join contigs using (chr_n)""")
_cte("wide_sites", ["sites", "contigs"], CTE["wide"][1].replace("peaks p", "sites p"))
_cte("near", ["peaks", "genes_fc"], f"""
select p.peak_id, p.chr_n, g.gene_id, g.pos0, g.biotype, g.fold_change
from peaks p join genes_fc g on g.contig = substr(p.chr_n, 4)
 and g.g_start <= p.pos_end + {DIST} and g.g_end >= p.pos_ini - {DIST}
where g.biotype = 'protein_coding'""")
_cte("near_located", ["near", "contigs"], "select near.* from near join contigs using (chr_n)")
_STATS = """
count(gene_id) as n_genes, count(fold_change) as n_updown_total,
count(*) filter (where fold_change > 0 and not isnan(fold_change)) as n_upreg,
count(*) filter (where fold_change < 0) as n_downreg"""
_cte("peak_stats", ["peaks", "near"], f"""
select p.*, n_genes, n_updown_total, n_upreg, n_downreg
from peaks p join (select peaks.peak_id, {_STATS} from peaks left join near using (peak_id) group by 1)
using (peak_id)""")

# Motifs
_PLACE = "((l_linenumber - 1) % (7 - l_suppkey % 3))"
_OFFSET = "case when l_quantity <= 35 then 0 when l_quantity <= 42 then 1 when l_quantity <= 46 then 2 else 3 end"
_cte("counts", [], f"""
select 'M' || (l_suppkey % 3) as motif, cast({_PLACE} as bigint) as pos,
       substr('ACGT', cast(1 + ({_OFFSET} + {_PLACE} * (1 + l_suppkey % 3) + l_suppkey % 3) % 4 as bigint), 1) as base,
       cast(count(*) as double) as count
from lineitem group by all""")
_cte("motifs", ["counts"], """
select motif, pos, base, coalesce(c.count, 0.0) as count,
       log2(((coalesce(c.count, 0.0) + 0.5)
             / (sum(coalesce(c.count, 0.0)) over (partition by motif, pos) + 2.0)) / 0.25) as log_odds
from (select distinct motif, pos, unnest(['A', 'C', 'G', 'T']) as base from counts)
left join counts c using (motif, pos, base)""")
_cte("best", ["motifs"], """
select motif, sum(b) as max_score, count(*) as len
from (select motif, pos, max(log_odds) as b from motifs group by all) group by motif""")
_cte("stranded", ["motifs", "best"], """
select motif, len, '+' as strand, pos, base, log_odds from motifs join best using (motif)
union all
select motif, len, '-', len - 1 - pos, translate(base, 'ACGT', 'TGCA'), log_odds from motifs join best using (motif)""")


def _windows(lengths: str) -> str:
    """Windows of the given lengths, cut from 256-base pieces so that no substring walks a long text."""
    return f"""
select chr_n, c * 256 + i as start, len, substr(piece, i + 1, len) as w
from (select chr_n, c, len, substr(seq, c * 256 + 1, 255 + len) as piece
      from (select chr_n, seq, unnest(range(0, (length(seq) + 255) // 256)) as c from seqs), ({lengths}) l),
     unnest(range(0, least(256, length(piece) - len + 1))) u(i)"""


_cte("motif_windows", ["seqs", "best"], _windows("select distinct len from best"))
_cte("scored", ["motif_windows", "stranded", "best"], f"""
select motif, strand, w, score
from (select motif, strand, w, any_value(x.len) as len, sum(log_odds) as score, count(*) as k
      from (select distinct upper(w) as w, len from motif_windows) x
      join stranded s on s.len = x.len and s.base = substr(x.w, s.pos + 1, 1)
      group by motif, strand, w)
join best using (motif)
where k = best.len and score >= {MULT} * max_score""")
_cte("motif_hits", ["motif_windows", "scored"], """
select chr_n, cast(start as bigint) as start, len, m.w as seq, strand, motif as tf_name, score as score_pssm
from motif_windows m join scored on upper(m.w) = scored.w""")


def _revcomp(w: str) -> str:
    return w[::-1].translate(str.maketrans("ACGT", "TGCA"))


_FORMS = ", ".join(f"({i}, '{w}', '+'), ({i}, '{_revcomp(w)}', '-')" for i, w in enumerate(CORE_WORDS))
_cte("word_windows", ["seqs"], _windows("select 7 as len"))
_cte("word_hits", ["word_windows"], f"""
select chr_n, cast(start as bigint) as start, 7 as len, upper(w) as seq, strand, cast(word_ord as bigint) as word_ord
from word_windows join (values {_FORMS}) f(word_ord, form, strand) on upper(w) = form""")
_cte("hits", ["word_hits", "motif_hits"], """
select chr_n, start, len, seq, strand, 'list' as source, word_ord as hit_ord, null as score_pssm, null as tf_name
from word_hits
union all
select chr_n, start, len, seq, strand, 'pssm', cast(substr(tf_name, 2) as bigint), score_pssm, tf_name
from motif_hits""")
_IN_PEAK = "h.chr_n = p.chr_n and h.start >= p.s0 and h.start + h.len <= p.s1"
_POS = "h.start - p.s0 + p.pos_ini - 1 + case when h.source = 'list' then 1 else 0 end"
_cte("peak_hits", ["located", "hits"], f"""
select p.peak_id, p.chr_n, {_POS} as pos_ini, {_POS} + h.len - 1 as pos_end, h.seq, h.source, h.score_pssm,
       h.strand, h.hit_ord, h.tf_name
from located p join hits h on {_IN_PEAK}""")
_cte("generated_sites", ["peak_hits", "peak_stats"], """
select h.*, s.n_genes as n_genes_near, s.n_updown_total, s.n_upreg, s.n_downreg
from peak_hits h join peak_stats s using (peak_id)""")
_cte("gene_strings", ["sites", "contigs", "gene_table"], f"""
select s.site_id, coalesce(string_agg(g.gene_id || '_' || g.updown, ',' order by g.gene_ord), '') as str_genes_rnaseq_near
from sites s join contigs using (chr_n)
left join gene_table g on g.chr_n = s.chr_n and g.pos0 > s.pos_ini - {DIST_ORIGIN} and g.pos0 < s.pos_end + {DIST_ORIGIN}
group by 1""")
_WPOS = "h.start - p.s0 + p.ini - 1"
_cte("site_motif_hits", ["wide_sites", "motif_hits"], f"""
select p.site_id, {_WPOS} as hit_pos_ini, {_WPOS} + h.len - 1 as hit_pos_end, h.seq as hit_seq,
       h.score_pssm as hit_score, h.tf_name
from wide_sites p join motif_hits h on {_IN_PEAK}""")
_cte("site_flags", ["wide_sites", "gene_strings", "site_motif_hits"], """
select s.site_id, s.chr_n, s.pos_ini, s.pos_end, s.seq, s.source, s.score_pssm, g.str_genes_rnaseq_near,
       coalesce(f.M0, 0) as M0, coalesce(f.M1, 0) as M1, coalesce(f.M2, 0) as M2
from wide_sites s join gene_strings g using (site_id)
left join (select site_id, cast(max(cast(tf_name = 'M0' as int)) as bigint) as M0,
                  cast(max(cast(tf_name = 'M1' as int)) as bigint) as M1,
                  cast(max(cast(tf_name = 'M2' as int)) as bigint) as M2
           from site_motif_hits group by 1) f using (site_id)""")



def _counted_words(length: int, order: str, which: str) -> str:
    """Hits of the given words, counted; the words are the first bases of the sequences."""
    return f"""
, given as (select distinct upper(substr(seq, 1, {length})) as w from seqs
            where regexp_matches(upper(substr(seq, 1, {length})), '^[ACGT]{{{length}}}$')),
words as (select w, {order} as word_ord from given where {which}),
forms as (select w as form, '+' as strand, word_ord from words union all
          select translate(reverse(w), 'ACGT', 'TGCA'), '-', word_ord from words
          where translate(reverse(w), 'ACGT', 'TGCA') <> w),
places as ({_windows(f"select {length} as len")})
select word_ord, form as seq, strand, count(*) as n, cast(sum(start) as bigint) as sum_start
from places join forms on upper(places.w) = form group by all"""


def _many_motifs() -> str:
    """The scoring of all motifs, for a motif of each supplier."""
    counts = f"""select 'S' || l_suppkey as motif, cast((l_linenumber - 1) % 7 as bigint) as pos,
       substr('ACGT', cast({MANY_BASE} as bigint), 1) as base, cast(count(*) as double) as count
from lineitem group by all"""
    names = ["counts", "motifs", "best", "stranded"]
    made = [f"many_{n} as materialized ({counts if n == 'counts' else CTE[n][1]})" for n in names]
    text = ",\n".join(made)
    for n in names:
        text = text.replace(f"from {n} ", f"from many_{n} ").replace(f"from {n})", f"from many_{n})").replace(f"join {n} ", f"join many_{n} ")
    return text


_SLICE = "case when s1 > s0 then substr(seq, s0 + 1, s1 - s0) else '' end"
_RULE = "(coalesce(source = 'click', false) or coalesce(chr_n = 'chr0', false))"
_RESIZE = """
case when {t} - (pos_end - pos_ini) > 0 then pos_ini - (({t} - (pos_end - pos_ini)) + 1) // 2
     else pos_ini + ((pos_end - pos_ini) - {t}) // 2 end as pos_ini,
case when {t} - (pos_end - pos_ini) > 0 then pos_end + ({t} - (pos_end - pos_ini)) // 2
     else pos_end - (((pos_end - pos_ini) - {t}) + 1) // 2 end as pos_end"""

ORACLE_SQL: dict[str, str] = {
    "s1_bed_scan": _with(["peaks"], "select chr_n, pos_ini, pos_end, cast(peak_id as varchar) as col_3 from peaks"),
    "s2_table_scan": _with(["sites"], """
select site_id, nullif(chr_n, '') as chr_n, pos_ini, pos_end, seq, source, score_pssm from sites"""),
    "s3_genes_scan": _with(["gene_table"], """
select gene_id, chr_n, pos0, biotype, round(fold_change, 6) as fold_change from gene_table"""),
    "s4_expression_scan": _with(["expr"], "select gene_id, round(fold_change, 6) as fold_change from expr"),
    "s5_fasta_scan": _with(["seqs"], "select chr_n, seq from seqs"),
    "s5_fasta_chunks": _with(["seqs"], """
select chr_n, cast(c as bigint) as chunk_id, cast(c * 1000 as bigint) as chunk_start,
       cast(least(1000, length(seq) - c * 1000) as bigint) as chunk_len, substr(seq, c * 1000 + 1, 1015) as bases
from (select chr_n, seq, unnest(range(0, greatest((length(seq) + 999) // 1000, 1))) as c from seqs)"""),
    "s6_chromosome_pruning": _with(["seqs", "peaks"], """
select chr_n, length(seq) as n from seqs where chr_n in (select chr_n from peaks)"""),
    "s7_motif_log_odds": _with(["motifs"], """
select motif, pos, base, count, round(log_odds, 6) as log_odds from motifs"""),
    "s7_without_pseudocount": _with(["counts"], """
, fewer as (select * from counts where not (base = 'A' and pos % 2 = 0)),
cells as (select motif, pos, base, coalesce(c.count, 0.0) as n,
                 sum(coalesce(c.count, 0.0)) over (partition by motif, pos) as total
          from (select distinct motif, pos, unnest(['A', 'C', 'G', 'T']) as base from fewer)
          left join fewer c using (motif, pos, base))
select motif, pos, base, case when n > 0 then round(log2(n / total / 0.25), 6) end as log_odds, n = 0 as impossible
from cells"""),
    "s8_motif_files": _with(["motifs"], "select motif, pos, base, count from motifs"),
    "s9_annotation_scan": _with(["genes"], "select * from genes"),
    "k1_table_sink": _with(["peaks"], """
select concat_ws(';', peak_id, chr_n, pos_ini, pos_end) as value, count(*) as n from peaks group by 1
union all select 'peak_id;chr_n;pos_ini;pos_end', 1"""),
    "k2_fasta_sink": _with(["located", "seqs"], f"""
select cast(peak_id as varchar) as id, {_SLICE} as seq, 3 as n_lines from located join seqs using (chr_n)"""),
    "f1_rule_filter_exclude": _with(["sites"], f"select site_id, chr_n, source from sites where not {_RULE}"),
    "f1_rule_filter_include": _with(["sites"], f"select site_id, chr_n, source from sites where {_RULE}"),
    "f2_project_sites": _with(["sites"], "select chr_n, pos_ini, pos_end, site_id from sites where chr_n <> '' or chr_n is null"),
    "f3_blank_chromosome": _with(["sites"], """
select count(*) as n_rows, count(chr_n) as n_named, count(*) filter (where chr_n = '') as n_blank
from sites where chr_n <> '' or chr_n is null"""),
    "f4_coding_genes": _with(["peaks", "genes"], """
select g.gene_id, g.biotype, count(*) as n from peaks p join genes g on g.contig = substr(p.chr_n, 4)
 and g.g_start <= p.pos_end and g.g_end >= p.pos_ini group by all"""),
    "f5_sites_with_sequence": _with(["peaks", "seqs"], "select * from peaks where chr_n in (select chr_n from seqs)"),
    "f5_sites_without_sequence": _with(["peaks", "seqs"], """
select * from peaks where chr_n not in (select chr_n from seqs)"""),
    "f6_skipped_count": _with(["peaks", "seqs"], """
select count(*) as n_skipped from peaks where chr_n not in (select chr_n from seqs)"""),
    "f7_usable_expression_rows": _with(["expr_rows"], """
select row_ord, gene_id, round(fold_change, 6) as fold_change from expr_rows"""),
    "f8_genes_with_fold_change": _with(["peaks", "gene_table"], f"""
select g.gene_id, case when fold_change > 0 then 'upreg' else 'downreg' end as updown, count(*) as n
from peaks p join gene_table g on g.chr_n = p.chr_n and g.pos0 > p.pos_ini - {DIST_ORIGIN} and g.pos0 < p.pos_end + {DIST_ORIGIN}
where fold_change is not null and not isnan(fold_change) and fold_change <> 0 group by all"""),
    "j1_nearby_genes": _with(["near"], "select peak_id, chr_n, gene_id, pos0, biotype from near"),
    "j1_mixed_lengths": f"""
with peaks as (select cast(o_orderkey as bigint) as peak_id, {LONG_CHR.format(k='o_orderkey')} as chr_n,
                      {LONG_INI.format(k='o_orderkey')} as pos_ini,
                      {LONG_INI.format(k='o_orderkey')} + {LONG_SIZE.format(k='o_orderkey')} as pos_end from orders),
genes as (select 'G' || p_partkey as gene_id, substr({LONG_CHR.format(k='p_partkey')}, 4) as contig,
                 {LONG_INI.format(k='p_partkey * 3')} as g_start,
                 {LONG_INI.format(k='p_partkey * 3')} + {LONG_SIZE.format(k='(p_partkey + 5)')} as g_end from part)
select gene_id, count(*) as n, cast(sum(peak_id) as bigint) as sum_id
from peaks p join genes g on g.contig = substr(p.chr_n, 4) and g.g_start <= p.pos_end + 1000 and g.g_end >= p.pos_ini - 1000
group by all""",
    "j2_genes_with_expression": _with(["genes_fc"], """
select gene_id, contig, round(fold_change, 6) as fold_change from genes_fc"""),
    "j3_translated_expression": _with(["translated"], """
select gene_id, round(arg_min(fold_change, row_ord), 6) as fold_change from translated group by 1"""),
    "j4_genes_around": _with(["peaks", "gene_table"], f"""
select p.peak_id, g.gene_id, g.updown, g.pos0 as gene_pos0
from peaks p join gene_table g on g.chr_n = p.chr_n and g.pos0 > p.pos_ini - {DIST_ORIGIN} and g.pos0 < p.pos_end + {DIST_ORIGIN}"""),
    "j5_sequence_fetch": _with(["peaks", "contigs", "seqs"], """
select peak_id, case when least(pos_end, n) > greatest(pos_ini - 1, 0)
    then substr(seq, greatest(pos_ini, 1), least(pos_end, n) - greatest(pos_ini - 1, 0)) else '' end as seq
from peaks join contigs using (chr_n) join seqs using (chr_n)"""),
    "j6_all_motifs_per_site": _with(["peak_hits"], """
select peak_id, tf_name, count(*) as n from peak_hits where source = 'pssm' group by all"""),
    "j7_all_words_per_site": _with(["peak_hits"], """
select peak_id, hit_ord as word_ord, count(*) as n from peak_hits where source = 'list' group by all"""),
    "j8_peak_context_on_hits": _with(["generated_sites"], """
select peak_id, n_genes_near, n_updown_total, n_upreg, n_downreg, count(*) as n from generated_sites group by all"""),
    "j9_hits_overlaid_by_site": _with(["sites", "site_motif_hits"], """
select site_id, chr_n, pos_ini, pos_end, seq, source, score_pssm, hit_pos_ini, hit_pos_end, hit_seq
from site_motif_hits join sites using (site_id)"""),
    "a1_peak_gene_stats": _with(["peak_stats"], "select * from peak_stats"),
    "a2_peak_site_stats": _with(["located", "peak_hits"], """
select p.peak_id, p.chr_n, p.pos_ini, p.pos_end, count(h.source) as n_su,
       count(*) filter (where h.source = 'list') as n_su_list, count(*) filter (where h.source = 'pssm') as n_su_pssm
from located p left join peak_hits h using (peak_id) group by all"""),
    "a3_distinct_genes": _with(["near"], """
select gene_id, arg_min(chr_n, peak_id) as chr_n, any_value(pos0) as pos0, any_value(biotype) as biotype,
       round(any_value(fold_change), 6) as fold_change from near group by 1"""),
    "a4_distinct_chromosomes": _with(["peaks"], "select distinct chr_n from peaks"),
    "a5_first_fold_change": _with(["expr"], "select gene_id, round(fold_change, 6) as fold_change from expr"),
    "a6_expression_conflicts": _with(["expr_rows", "expr"], """
select gene_id, round(any_value(e.fold_change), 6) as fold_change,
       case when isnan(any_value(e.fold_change)) then count(*) - 1
            else count(*) filter (where r.fold_change <> e.fold_change) end as n_conflicts
from expr_rows r join expr e using (gene_id) group by 1 having n_conflicts > 0"""),
    "a6_translated_conflicts": _with(["translated"], """
, first as (select gene_id, arg_min(fold_change, row_ord) as fold_change from translated group by 1)
select gene_id, round(any_value(f.fold_change), 6) as fold_change,
       case when isnan(any_value(f.fold_change)) then count(*) - 1
            else count(*) filter (where t.fold_change <> f.fold_change) end as n_conflicts
from translated t join first f using (gene_id) group by 1 having n_conflicts > 0"""),
    "a7_gene_string": _with(["peaks", "gene_table"], f"""
select p.peak_id, coalesce(string_agg(g.gene_id || '_' || g.updown, ',' order by g.gene_ord), '') as str_genes_rnaseq_near
from peaks p left join gene_table g
  on g.chr_n = p.chr_n and g.pos0 > p.pos_ini - {DIST_ORIGIN} and g.pos0 < p.pos_end + {DIST_ORIGIN}
group by 1"""),
    "a8_cooccupancy_flags": _with(["located", "peak_hits"], """
select p.peak_id, coalesce(max(case when tf_name = 'M0' then 1 end), 0) as M0,
       coalesce(max(case when tf_name = 'M1' then 1 end), 0) as M1,
       coalesce(max(case when tf_name = 'M2' then 1 end), 0) as M2, 0 as absent
from located p left join peak_hits h using (peak_id) group by 1"""),
    "a9_expression_summary": _with(["parsed", "expr_rows"], """
select (select count(*) from parsed where lfc is not null) as n_rows, count(*) as n_ids,
       count(distinct gene_id) as n_genes from expr_rows"""),
    "a9_translated_summary": _with(["parsed", "translated"], """
select (select count(*) from parsed where lfc is not null) as n_rows, count(*) as n_ids,
       count(distinct gene_id) as n_genes from translated"""),
    "a10_motif_cutoffs": _with(["best"], """
select motif, round(max_score, 6) as max_score, round(0.9 * max_score, 6) as cutoff from best"""),
    "a11_score_report": _with(["best"], f"""
select motif, round(max_score, 4) as max_score, round({MULT} * max_score, 4) as cutoff from best"""),
    "w1_row_ordinal": _with(["sites"], """
select site_id, row_number() over (order by site_id * 7919 % 1000003 * 1000000 + site_id) - 1 as ordinal from sites"""),
    "w2_kmer_windows": _with(["seqs"], f"""
select w as kmer, count(*) as n, cast(sum(start) as bigint) as sum_start from ({_windows('select 6 as len')}) group by 1"""),
    "w2_long_windows": _with(["seqs"], f"""
select n, count(*) as n_windows, cast(sum(sum_start) as bigint) as sum_start
from (select w, count(*) as n, sum(start) as sum_start from ({_windows('select 31 as len')}) group by w) group by n"""),
    "w3_first_row_per_key": _with(["peaks"], """
select * from peaks qualify row_number() over (partition by chr_n order by peak_id) = 1"""),
    "o1_sample_peaks": _with(["peaks"], """
select * from peaks order by md5(concat_ws('|', '7', peak_id, chr_n, pos_ini, pos_end)) limit 100"""),
    "o2_hit_order": _with(["peak_hits"], """
select peak_id, source, pos_ini, seq, row_number() over (partition by peak_id order by source, hit_ord,
         case when source = 'pssm' and strand = '+' then 1 else 0 end, pos_ini) as place
from peak_hits"""),
    "o3_union_of_hits": _with(["hits"], """
select chr_n, source, count(*) as n, cast(sum(start) as bigint) as sum_start from hits group by all"""),
    "x1_extract_sequences": _with(["located", "seqs"], f"""
select peak_id, {_SLICE} as seq from located join seqs using (chr_n)"""),
    "x2_resize_sites": _with(["peaks"], f"select peak_id, chr_n, {_RESIZE.format(t=125)} from peaks"),
    "x3_expand_sites": _with(["peaks"], f"""
select *, pos_ini - {DIST_SITES} as search_ini, pos_end + {DIST_SITES} as search_end from peaks"""),
    "x4_reverse_complement": _with(["seqs"], """
select chr_n, translate(reverse(upper(seq)), 'ACGT', 'TGCA') as seq from seqs"""),
    "x5_word_scan": _with(["word_hits"], "select chr_n, start, seq, strand, word_ord from word_hits"),
    "x5_many_words": _with(["seqs"], _counted_words(8, "row_number() over (order by w) - 1", "true")),
    "x5_long_word": _with(["seqs"], _counted_words(80, "0", "w = (select max(w) from given)")),
    "x5_mixed_words": _with(["seqs"], f"""
, given as (select distinct upper(substr(seq, 1, 5 + length(seq) % 4)) as w from seqs
            where regexp_matches(upper(substr(seq, 1, 5 + length(seq) % 4)), '^[ACGT]{{5,}}$')),
words as (select w, row_number() over (order by w) - 1 as word_ord from given),
forms as (select w as form, '+' as strand, word_ord from words union all
          select translate(reverse(w), 'ACGT', 'TGCA'), '-', word_ord from words
          where translate(reverse(w), 'ACGT', 'TGCA') <> w),
places as ({_windows("select distinct length(w) as len from words")})
select word_ord, form as seq, strand, count(*) as n, cast(sum(start) as bigint) as sum_start
from places join forms on upper(places.w) = form group by all"""),
    "x6_many_motifs": _with(["seqs"], f"""
, {_many_motifs()},
places as (select w, count(*) as n, cast(sum(start) as bigint) as sum_start
           from (select upper(w) as w, start from ({_windows("select distinct len from many_best")})) group by 1),
scored as (select motif, strand, w, any_value(x.n) as n, any_value(x.sum_start) as sum_start, sum(log_odds) as score
           from places x join many_stranded s on s.len = length(x.w) and s.base = substr(x.w, s.pos + 1, 1)
           group by motif, strand, w having count(*) = any_value(len))
select motif as tf_name, strand, cast(sum(n) as bigint) as n, cast(sum(sum_start) as bigint) as sum_start
from scored join many_best using (motif) where score >= 0.9 * max_score group by all"""),
    "x6_motif_scan": _with(["motif_hits"], """
select chr_n, start, seq, strand, tf_name, round(score_pssm, 6) as score_pssm from motif_hits"""),
    "x7_panel_scan_around_sites": _with(["wide", "motif_hits"], f"""
select p.peak_id, {_WPOS} as hit_pos_ini, {_WPOS} + h.len - 1 as hit_pos_end, h.seq as hit_seq,
       h.tf_name as hit_tf_name, round(h.score_pssm, 6) as hit_score
from wide p join motif_hits h on {_IN_PEAK}"""),
    "x8_length_guard": _with(["contigs"], """
select chr_n, n - 1999 as n_windows from contigs where n >= 2000"""),
    "t1_signed_fold_change": _with(["parsed"], """
select row_ord, round(case when isnan(lfc) then lfc else sign(lfc) * pow(2.0, abs(lfc)) end, 6) as fold_change
from parsed where lfc is not null"""),
    "t2_split_ids": _with(["raw_expression"], """
select row_ord, trim(part) as gene_id
from (select row_ord, unnest(string_split(raw_id, '|')) as part from raw_expression) where trim(part) <> ''"""),
    "t3_contig_name": _with(["peaks"], "select peak_id, substr(chr_n, 4) as contig from peaks"),
    "t4_gene_origin": _with(["genes_fc"], "select gene_id, pos0 from genes_fc"),
    "t5_direction_label": _with(["gene_table"], "select gene_id, updown from gene_table"),
    "t6_fasta_id": _with(["peaks"], """
select (peak_id + 1) || '_' || chr_n || '_' || pos_ini || '_' || pos_end as id from peaks"""),
    "t7_forward_coordinates": _with(["peak_hits"], """
select peak_id, strand as hit_strand, pos_ini as hit_pos_ini, pos_end as hit_pos_end, tf_name as hit_tf_name
from peak_hits where source = 'pssm'"""),
    "p1_generate_peaks": _with(["located", "peak_stats", "peak_hits"], """
select s.peak_id, s.chr_n, s.pos_ini, s.pos_end, s.n_genes, count(h.source) as n_su,
       count(*) filter (where h.source = 'list') as n_su_list, count(*) filter (where h.source = 'pssm') as n_su_pssm,
       s.n_updown_total, s.n_upreg, s.n_downreg
from located join peak_stats s using (peak_id) left join peak_hits h using (peak_id) group by all"""),
    "p1_generate_sites": _with(["generated_sites"], """
select peak_id, chr_n, pos_ini, pos_end, seq, source, round(score_pssm, 6) as score_pssm, n_genes_near,
       n_updown_total, n_upreg, n_downreg from generated_sites"""),
    "p1_generate_genes": _with(["near_located"], """
select gene_id, arg_min(chr_n, peak_id) as chr_n, any_value(pos0) as pos0, any_value(biotype) as biotype,
       round(any_value(fold_change), 6) as fold_change from near_located group by 1"""),
    "p1_gene_order": _with(["near_located", "genes", "peaks"], f"""
, written as (select n.gene_id, arg_min(n.chr_n, n.peak_id) as chr_n, any_value(n.pos0) as pos0,
                     any_value(n.fold_change) as fold_change, min(n.peak_id) as first_peak, min(g.g_start) as g_start
              from near_located n join genes g using (gene_id) group by 1)
select p.peak_id, coalesce(string_agg(
         w.gene_id || '_' || case when w.fold_change < 0 then 'upreg' else 'downreg' end, ','
         order by w.first_peak, w.g_start, w.gene_id), '') as str_genes_rnaseq_near
from peaks p left join written w
  on w.chr_n = p.chr_n and w.pos0 > p.pos_ini - {DIST_ORIGIN} and w.pos0 < p.pos_end + {DIST_ORIGIN}
group by 1"""),
    "p1_skipped_peaks": _with(["peaks", "contigs"], """
select count(*) as n_sites, count(*) filter (where chr_n not in (select chr_n from contigs)) as n_skipped from peaks"""),
    "p2_skipped_sites": _with(["sites", "contigs"], """
select count(*) as n_sites, count(*) filter (where chr_n is null or chr_n not in (select chr_n from contigs)) as n_skipped
from sites where coalesce(source <> 'click', true) and (chr_n <> '' or chr_n is null)"""),
    "p2_fasta_export": _with(["sites", "contigs", "seqs"], f"""
, kept as (select chr_n, {_RESIZE.format(t=120)}, row_number() over (order by site_id) as ordinal
           from sites where coalesce(source <> 'click', true) and (chr_n <> '' or chr_n is null)),
placed as (select k.*, case when pos_ini - 1 < 0 then greatest(n + pos_ini - 1, 0) else pos_ini - 1 end as s0,
                  case when pos_end < 0 then greatest(n + pos_end, 0) else least(pos_end, n) end as s1
           from kept k join contigs using (chr_n))
select ordinal || '_' || chr_n || '_' || pos_ini || '_' || pos_end as id, {_SLICE} as seq
from placed join seqs using (chr_n)"""),
    "p3_cooccupancy_sites": _with(["site_flags"], "select * from site_flags"),
    "p3_skipped_sites": _with(["sites", "contigs"], """
select count(*) as n_skipped from sites where chr_n is null or chr_n not in (select chr_n from contigs)"""),
    "p3_cooccupancy_hits": _with(["site_flags", "site_motif_hits"], """
select site_id, chr_n, pos_ini, seq, source, score_pssm, tf_name, str_genes_rnaseq_near, M0, M1, M2,
       hit_pos_ini, hit_pos_end, hit_seq, round(hit_score, 6) as hit_score
from site_flags join site_motif_hits using (site_id)"""),
}
