"""One registered query for each operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescan.llm.bpe import encode_texts
from sitescan.llm.byte_bpe import encode_bytes
from sitescan.llm.class_lm import fit, score
from sitescan.llm.common import remainder, table
from sitescan.llm.compression import quality_rules
from sitescan.llm.credentials import scan_credentials
from sitescan.llm.decontamination import find_contamination
from sitescan.llm.fp_ranking import rank_documents
from sitescan.llm.merkle import verify_rows
from sitescan.llm.near_duplicates import near_duplicate_classes
from sitescan.llm.personal_data import KINDS, find_personal_data
from sitescan.llm.quality_model import fit_quality, score_quality
from sitescan.llm.toxicity import fit_toxicity, score_toxicity
from sitescan.llm.url_filter import RULES, SOFT, SOFT_LIMIT, STRICT, judge_urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 7) == 2
    model = fit(docs.where(~held_out))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


def op3_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("findings")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    return scan_credentials(docs).select(
        "doc_id", *[count_kind(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode_texts(docs, TOKENIZER).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    chain = fit_toxicity(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, chain).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_simhash_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicate_classes(docs, keep=["doc_id"])


def op7_quality_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 3) == 1
    machine = fit_quality(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return score_quality(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = F.array(*map(F.lit, KINDS))
    named = F.transform("findings", lambda s: F.struct(F.get(kinds, s["k"]).alias("kind"), s["start"], s["end"]))
    found = find_personal_data(docs, keep=["doc_id"]).select("doc_id", named.alias("found"))
    base = F.filter("found", lambda s: s["kind"] != KINDS[-1])
    return found.select(
        "doc_id", *[count_kind(F.col("found"), k).alias(f"n_{k}") for k in KINDS[:-1]],
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).drop("text")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = encode_bytes(docs, BYTE_RANKS, public_tokenizers.PATTERN, keep=["doc_id"], packed=True)
    return made.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return verify_rows(docs, altered={"text": F.translate("text", "\n", "")}, where=tampered, keep=["doc_id"])


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("item_id", "rank", "doc_id", "score")


QUERIES = {
    f.__name__: f for f in (
        op1_benchmark_decontamination, op2_brown_class_lm, op3_credential_linking, op4_bpe, op5_toxicity_crf,
        op6_simhash_vantage_point, op7_quality_factorisation, op8_personal_data,
        op9_url_filter, op10_quality_rules, op11_byte_bpe, op12_merkle_manifest, op13_ranked_search,
    )
}


def _terms(terms: tuple[str, ...]) -> str:
    return " + ".join(
        f"cast(regexp_matches(u, '(^|[^A-Za-z0-9]){t}([^A-Za-z0-9]|$)') as int)" for t in terms
    )


def _rules(column: int) -> str:
    cases = " ".join(
        f"when (host = '{text[:(cut := text.index('/'))]}' or ends_with(host, '.{text[:cut]}')) "
        f"and starts_with(path, '{text[cut:]}') then '{(kind, text)[column]}'"
        for kind, text in sorted(RULES, key=lambda r: -len(r[1]))
    )
    return f"case {cases} end"


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)


def _leaf(text: str) -> str:
    fields = ["cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text]
    return " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)


#: crc32 of the decimal id: bit by bit over its characters.
_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(cast(doc_id as varchar)) + 1), "
    "lambda i: cast(ascii(substr(cast(doc_id as varchar), i, 1)) as bigint))), lambda c, b: "
    "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), "
    "lambda x, y: xor(x >> 1, case when x % 2 = 1 then 3988292384 else 0 end))))"
)

ORACLE_SQL = {
    "op1_benchmark_decontamination": f"""
        with d as (select doc_id, row_number() over () as rid, {_WORDS} as w from documents),
        b as (select item_id, {_WORDS} as w from benchmark),
        win as (
            select distinct item_id, least(len(w), 10) as n, w[i : i + least(len(w), 10) - 1] as g
            from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)
        ),
        pos as (
            select rid, i, n, w[i : i + n - 1] as g from (
                select rid, w, n, unnest(range(1, len(w) - n + 2)) as i
                from d, (select distinct n from win) where len(w) >= n
            )
        ),
        hit as (select rid, i, pos.n, item_id from pos join win on pos.n = win.n and pos.g = win.g),
        per as (
            select rid, count(distinct p) as n_hit
            from (select rid, unnest(range(i, i + n)) as p from hit) group by rid
        ),
        items as (
            select rid, count(*) as n_items, string_agg(item, ',' order by item) as ids
            from (select distinct rid, cast(item_id as varchar) as item from hit where item_id is not null) group by rid
        )
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
               coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 as contaminated
        from d left join per using (rid) left join items using (rid)""",
    "op9_url_filter": f"""
        with r as (
            select page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as u,
                   case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
        ),
        p as (
            select page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r
        )
        select page_id, host, path, {_rules(1)} as rule,
               coalesce({_rules(0)}, case when {_terms(STRICT)} > 0 or {_terms(SOFT)} >= {SOFT_LIMIT}
                        then 'block' else 'allow' end) as verdict
        from p""",
    "op12_merkle_manifest": f"""
        with recursive d as (
            select row_number() over () as rid, doc_id, source, sha256({_leaf("text")}) as leaf,
                   case when crc32_of % 2 = 0 then sha256({_leaf("replace(text, chr(10), '')")}) end as changed
            from documents, lateral (select {_CRC32} as crc32_of)
        ),
        placed as (
            select *, row_number() over (partition by source order by doc_id nulls first, leaf, rid) - 1 as pos,
                   count(*) over (partition by source) as n
            from d
        ),
        nodes as (
            select source, 0 as lvl, pos, n, leaf as h from placed
            union all
            select source, lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by pos))
            from nodes where n > 1 group by source, lvl, pos // 3
        ),
        subroots as (
            select source, h, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n
            from nodes where n = 1
        ),
        tops as (
            select 0 as lvl, pos, n, h from subroots
            union all
            select lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by pos))
            from tops where n > 1 group by lvl, pos // 3
        ),
        inner_walk as (
            select rid, source, 0 as lvl, pos, n, coalesce(changed, leaf) as h, '' as proof from placed
            union all
            select w.rid, any_value(w.source), w.lvl + 1, any_value(w.pos) // 3, (any_value(w.n) + 2) // 3,
                   sha256(string_agg(case when t.pos = w.pos then w.h else t.h end, '' order by t.pos)),
                   any_value(w.proof) || coalesce(string_agg(t.h, '' order by t.pos) filter (where t.pos <> w.pos), '')
            from inner_walk w join nodes t
              on w.source is not distinct from t.source and w.lvl = t.lvl and w.pos // 3 = t.pos // 3
            where w.n > 1 group by w.rid, w.lvl
        ),
        outer_walk as (
            select w.rid, 0 as lvl, s.pos, s.n, w.h, w.proof
            from inner_walk w join subroots s on w.source is not distinct from s.source where w.n = 1
            union all
            select w.rid, w.lvl + 1, any_value(w.pos) // 3, (any_value(w.n) + 2) // 3,
                   sha256(string_agg(case when t.pos = w.pos then w.h else t.h end, '' order by t.pos)),
                   any_value(w.proof) || coalesce(string_agg(t.h, '' order by t.pos) filter (where t.pos <> w.pos), '')
            from outer_walk w join tops t on w.lvl = t.lvl and w.pos // 3 = t.pos // 3
            where w.n > 1 group by w.rid, w.lvl
        )
        select doc_id, leaf, s.h as subroot, r.h as root, sha256(w.proof) as proof_sha256, w.h as folded_root,
               w.h = r.h as verified
        from d join subroots s on d.source is not distinct from s.source
        join (select rid, proof, h from outer_walk where n = 1) w using (rid)
        cross join (select h from tops where n = 1) r""",
    "op13_ranked_search": f"""
        with dt as (select row_number() over () as did, doc_id, {_TERMS} as ts from documents),
        bt as (select row_number() over () as iid, item_id, {_TERMS} as ts from benchmark),
        asked as (select iid, t, count(*) as times from (select iid, unnest(ts) as t from bt) group by all),
        held as (
            select did, t, count(*) as tf from (select did, unnest(ts) as t from dt)
            where t in (select t from asked) group by all
        ),
        total as (select count(*) as n, sum(len(ts)) as l from dt where len(ts) > 0),
        weight as (
            select t, cast(floor(1000 * ln((2 * any_value(total.n) + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w
            from held, total group by t
        ),
        factor as (select did, doc_id, 100 - 75 + cast(75 * len(ts) * total.n // total.l as bigint) as m from dt, total where len(ts) > 0),
        scored as (
            select iid, did, any_value(doc_id) as doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
            from asked join held using (t) join weight using (t) join factor using (did) group by iid, did
        ),
        ranked as (
            select *, row_number() over (partition by iid order by score desc, doc_id nulls last) as rank
            from scored where score > 0
        )
        select item_id, cast(rank as integer) as rank, doc_id, score from ranked join bt using (iid) where rank <= 10""",
}
