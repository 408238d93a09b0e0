"""The corpus operators' queries, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm import decontaminate, exact_dedup, html_text, language, minmax, ngram_model, packing, product_codes, secrets, simhash, spelling, toxicity, warc
from linework.llm.common import id_bucket


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_bucket("doc_id", 10) == 0
    rows = ngram_model.score(_table(spark, sf_dir, "documents"), ~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), *rows.columns[1:])


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["rank"] < 3)
    counts = [F.expr(f"cast(size(filter(found, x -> x.rank = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(["assign", "access", "hex"])]
    return rows.select("doc_id", *counts, F.sha2(secrets.listing(base), 256).alias("base_sha256"), secrets.listing(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"))


def op3_text_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url", "payload")


def op6_string_kernel_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 4) == 2
    return language.identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), id_bucket("_id", 5) != 0)
    spans = F.array_join(F.transform("sentences", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return rows.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("sentences"))


def op10_suffix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), nameless=True)
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest", "longest_at",
    )


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_elias_fano_lm": op1_elias_fano_lm,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_text_tag_ratio": op3_text_tag_ratio,
    "op4_tree_dedup": op4_tree_dedup,
    "op5_warc_zstd": op5_warc_zstd,
    "op6_string_kernel_lang": op6_string_kernel_lang,
    "op7_nnls_packing": op7_nnls_packing,
    "op8_simhash_vptree": op8_simhash_vptree,
    "op9_toxicity_mil": op9_toxicity_mil,
    "op10_suffix_decontam": op10_suffix_decontam,
    "op11_product_codes": op11_product_codes,
    "op12_minmax_dedup": op12_minmax_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

def _secrets_sql() -> str:
    """Matches of each kind with their positions, ownership of values, and the listing."""
    one = """select doc_id, source, {k} as rank, unnest(regexp_extract_all(t, '{p}')) as hit,
                    unnest(string_split_regex(t, '{p}')[:-2]) as gap, unnest(range(len(regexp_extract_all(t, '{p}')))) as i from d"""
    kinds = " union all ".join(one.format(k=k, p=p.replace("'", "''")) for k, p in enumerate(secrets.KINDS.values()))
    assign = secrets.ASSIGN.replace("'", "''")
    return f"""
        with d as (select doc_id, source, coalesce(text, '') as t from documents), m as materialized ({kinds}),
        p as (select doc_id, source, rank, hit, sum(length(gap) + length(hit)) over (partition by doc_id, rank order by i) as stop,
                     case when rank = 0 then regexp_extract(hit, '{assign}', 2) else hit end as value from m),
        v as materialized (select doc_id, source, rank, (stop - length(hit))::bigint as a, stop::bigint as b, value from p
              where (rank = 0 and length(value) >= {secrets.LEAST_ASSIGNED}) or rank in (1, 2)
                 or (rank = 3 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and len(list_distinct(string_split(value, ''))) >= {secrets.LEAST_DISTINCT})),
        s as materialized (select * from v where rank < 3 or not exists (select 1 from v w where w.doc_id = v.doc_id and w.rank < 3 and w.a < v.b and v.a < w.b)),
        o as (select value, count(distinct source) as owners from s group by value),
        f as (select doc_id, rank, a, ['assign', 'access', 'hex', 'owner'][rank + 1] || ':' || a || ':' || b as name, owners <= {secrets.MOST_OWNERS} as live
              from s join o using (value) where rank < 3 or owners <= {secrets.MOST_OWNERS}),
        g as (select doc_id, count(*) filter (rank = 0) as n0, count(*) filter (rank = 1) as n1, count(*) filter (rank = 2) as n2, count(*) filter (live) as n_live,
                     coalesce(string_agg(name, ',' order by a, rank) filter (rank < 3), '') as base, string_agg(name, ',' order by a, rank) as spans from f group by doc_id)
        select d.doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
        from d left join g using (doc_id)"""


def _codes_sql(entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Assignments and moves of the codebooks one after the other, in integers."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} as materialized (
            select id, part, entry, away from (
                select v.id, v.part, c.entry, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) as away,
                       row_number() over (partition by v.id, v.part order by away, c.entry) as place
                from v join c{k} c using (part)) where place = 1)""")
        if k < rounds:
            steps.append(f"""c{k + 1} as materialized (
                select c.part, c.entry, coalesce(m.x, c.x) as x from c{k} c left join (
                    select part, entry, list(cast(floor(total / n) as bigint) order by i) as x from (
                        select part, entry, i, sum(y) as total, count(*) as n from (select part, entry, unnest(v.x) as y, unnest(range(len(v.x))) as i from a{k} join v using (id, part)) group by part, entry, i)
                    group by part, entry) m using (part, entry))""")
    return f"""
        with e as materialized (select row_number() over (order by vec_id nulls last, embedding) as id, vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * x::double) as bigint)) as q from embeddings
              where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        v as materialized (select id, part, q[1 + part * len(q) // 16:(part + 1) * len(q) // 16] as x from e, (select unnest(range(16)) as part)),
        c0 as materialized (select part, id - 1 as entry, x from v where id <= {entries}), {", ".join(steps)},
        b as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from c{rounds}),
        r as (select id, string_agg(format('{{:02x}}', entry), '' order by part) as code, sum(away)::bigint as error from a{rounds} group by id)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from e join r using (id), b"""


def _variants_sql(least_length: int = 7, slip: int = 31, times: int = 10) -> str:
    """CRC-32 bytewise over its table of 256 remainders; words one edit apart agree with one code point left out of either or both."""
    return f"""
        with recursive t as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) as t),
        d as (select coalesce(cast(doc_id as varchar), '') as doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run from documents),
        r as (select doc, run, count(*) as n from d where length(run) >= {least_length} group by doc, run),
        o as (select doc, run, n, flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] end)) as bytes from r),
        h as (select run, n, xor(list_reduce(bytes, lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295) as h from (select run, n, bytes::bigint[] as bytes, t from o, t)),
        k as (select case when h % {slip} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
        w as materialized (select word, sum(n)::bigint as n from k where length(word) >= {least_length} group by word having sum(n) >= 2),
        x as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
        p as materialized (select a.word as u, b.word as v from x a join x b on a.cut = b.cut and a.i = b.i and a.word <> b.word
              union select x.word, w.word from x join w on w.word = x.cut union select w.word, x.word from x join w on w.word = x.cut),
        g as (select u as word, count(*) as n_near, max(w.n) as most, arg_min(v, (-w.n, v)) as best from p join w on w.word = v group by u),
        f as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= {times} * w.n then best end as form, case when most >= {times} * w.n then most end as form_n from w left join g using (word)),
        step(word, root) as (select word, word from f union all select step.word, f.form from step join f on f.word = step.root where f.form is not null)
        select f.word, f.form, step.root, f.n, f.n_near, f.form_n from f join step on step.word = f.word join f last on last.word = step.root and last.form is null"""


SQL: dict[str, str] = {
    "op2_secret_ownership": _secrets_sql(),
    "op5_warc_zstd": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, strlen(html) as payload_bytes, sha1(html) as h, max(page_id) over w as head, row_number() over w = 1 as leads from p window w as (partition by html order by page_id desc nulls last))
        select page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31), 1)), '') as payload_digest,
               case when leads then 'response' else 'revisit' end as record_type, case when not leads then head end as refers_to
        from d""",
    "op10_suffix_decontam": r"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select row_number() over () as b, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as v from benchmark),
        s as (select b, item_id, v, least(13, len(v)) as k, unnest(range(1, len(v) - least(13, len(v)) + 2)) as i from b where len(v) > 0),
        win as (select distinct item_id, k, array_to_string(v[i:i + k - 1], ' ') as g from s),
        pos as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from win))),
        hit as materialized (select doc_id, i, k, item_id from pos join win using (k, g)),
        n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
        r as (select doc_id, b, p.i, k, p.i - s.i as shift from pos p join (select b, k, i, array_to_string(v[i:i + k - 1], ' ') as g from s) s using (k, g)),
        t as (select *, i - row_number() over (partition by doc_id, b, shift order by i) as run from r),
        l as (select doc_id, min(i) as spot, max(i) - min(i) + max(k) as len from t group by doc_id, b, shift, run),
        o as (select doc_id, max(len) as longest, arg_min(spot, spot - len * 1000000000) as spot from l group by doc_id),
        m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated, coalesce(longest, 0) as longest, coalesce(spot - 1, -1) as longest_at
        from d left join n using (doc_id) left join m using (doc_id) left join o using (doc_id)""",
    "op11_product_codes": _codes_sql(),
    "op12_minmax_dedup": r"""
        with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        p as (select r, w, least(5, len(w)) as k, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from d where len(w) > 0),
        s as materialized (select distinct r, array_to_string(w[i:i + k - 1], ' ') as g from p),
        n as materialized (select r, count(*) as n, md5(string_agg(g, chr(1) order by g)) as whole from s group by r),
        h as materialized (select r, n, min(r) over (partition by n, whole) as head from n),
        o as (select x.r as a, y.r as b, count(*) as c from s x join h hx on hx.r = x.r and hx.head = x.r join s y on x.g = y.g and x.r < y.r join h hy on hy.r = y.r and hy.head = y.r group by x.r, y.r),
        l as materialized (select a, b from o join h x on x.r = a join h y on y.r = b where 100 * c >= 85 * (x.n + y.n - c)),
        e as materialized (select a, b from l union all select b, a from l union all select head, r from h where head <> r union all select r, head from h where head <> r),
        reach(r, t) as (select r, r from d union select reach.r, e.b from reach join e on e.a = reach.t),
        c as (select reach.r, min(d.doc_id) as component_id from reach join d on d.r = reach.t group by reach.r)
        select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id is not distinct from component_id as kept from d join c using (r) left join h using (r)""",
    "op13_spelling_variants": _variants_sql(),
    "op4_tree_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
}
