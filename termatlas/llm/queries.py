"""The registered queries of the training-data operators: thin wrappers with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import captures_of_pages

    return captures_of_pages(table(spark, sf_dir, "pages")).drop("payload")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import score_quality

    return score_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import pack_round_trip

    return pack_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), gram=48, passage_span=240).drop("kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3's columns that SQL can express: what the base patterns find, without the model's spans."""
    return op3_pii(spark, sf_dir).drop("spans", "n_pii")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 7's columns that SQL can express: the counts and the base rule, without the model's verdict."""
    return op7_quality_rules(spark, sf_dir).drop("kept", "p_good")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_embedding_dedup, op2_bpe, op3_pii, op4_html_extract, op5_packing, op6_warc, op7_quality_rules, op8_token_files, op9_suffix_dedup, op10_simhash,
    pipeline, pii_base, quality_counts,
)


def queries():
    return {f.__name__: f for f in QUERIES}


LINKS = """with recursive e as (select a.vec_id as u, b.vec_id as v from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id
 where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.93),
r as (select vec_id as id, vec_id as c from embeddings union select e.v, r.c from r join e on e.u = r.id)
select x.vec_id, (select count(*) from e where e.u = x.vec_id) as n_links, min(r.c) as component_id, min(r.c) = x.vec_id as kept
 from embeddings x join r on r.id = x.vec_id group by x.vec_id"""

MAIN_TEXT = r"""with o as (select page_id, string_split(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1),
  '</?(?:h1|p)>', chr(1), 'g'), chr(1)) as xs from pages where html like '%<article>%'),
b as (select page_id, unnest(xs) as x, unnest(range(1, len(xs) + 1)) as n from o),
c as (select page_id, n, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'),
  '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as line from b),
t as (select page_id, string_agg(line, chr(10) order by n) as text from c where line <> '' group by 1)
select p.page_id, p.url, coalesce(t.text, '') as text, length(coalesce(t.text, '')) as n_chars from pages p left join t using (page_id)"""

CAPTURES = """with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
q as (select *, min(page_id) over (partition by h) as first,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * i::int, 5))::bigint >> s) & 31)::int + 1, 1)), '')), '') as payload_digest from p)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type,
 case when first <> page_id then first end as refers_to from q"""


QUALITY_COUNTS = r"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
i as (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8),
g as (select doc_id, i, array_to_string(w[i : i + 7], chr(10)) as g from i),
t as (select doc_id, unnest(list_transform(range(0, 8), lambda k: i + k)) as p from g qualify count(*) over (partition by doc_id, g) > 1),
r as (select doc_id, count(distinct p) as n from t group by 1),
c as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
 from d join l using (doc_id) left join r using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c"""

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) > 3 or ('0' || ltrim(p, '0'))::bigint > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(x.d) between 13 and 19 and list_sum(list_transform(range(1, length(x.d) + 1), lambda i: case when i % 2 = 1 then"
     " x.d[-i]::int when x.d[-i]::int > 4 then x.d[-i]::int * 2 - 9 else x.d[-i]::int * 2 end)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(x.d) between 9 and 15"),
)


def _pii_base() -> str:
    parts = []
    for kind, pattern, valid in _KINDS:
        parts.append(f"""{kind}_m as (select doc_id, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as g from d),
{kind}_x as (select doc_id, list_transform(range(1, len(m) + 1), lambda i: struct_pack(m := m[i], d := regexp_replace(m[i], '[^0-9]', '', 'g'),
 s := list_sum(list_transform(g[1:i], lambda y: length(y)))::bigint + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)::bigint)) as xs from {kind}_m),
{kind} as (select doc_id, list_transform(list_filter(xs, lambda x: {valid}), lambda x: '{kind}:' || x.s || ':' || (x.s + length(x.m))) as {kind} from {kind}_x)""")
    names = [k for k, _, _ in _KINDS]
    counts = ", ".join(f"len({k}) as n_{k}" for k in names)
    joined = " || ".join(names)
    return "with d as (select doc_id, coalesce(text, '') as text from documents),\n" + ",\n".join(parts) + f"\nselect doc_id, {counts}, sha256(array_to_string({joined}, ',')) as base_sha256 from email" + "".join(f" join {k} using (doc_id)" for k in names[1:])


def _runs(span: int) -> str:
    """CTEs that end in z<span>: maximal runs [a, b) covered by strings of span bytes that start elsewhere too."""
    return f"""w{span} as (select doc_id, unnest(range(0, n - {span - 1})) as i, h from t where n >= {span}),
k{span} as (select doc_id, i, hash(substr(h, 2 * i + 1, {2 * span})) as g from w{span}),
d{span} as (select g from k{span} group by g having count(*) > 1),
s{span} as (select doc_id, i from k{span} k semi join d{span} d on k.g = d.g),
m{span} as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + {span} then 0 else 1 end as fresh from s{span}),
r{span} as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from m{span}),
z{span} as (select doc_id, run, min(i) as a, max(i) + {span} as b from r{span} group by 1, 2)"""


#: White space in hexadecimal.
SPACES = "('20', '09', '0A', '0B', '0C', '0D')"


def _repeats() -> str:
    return f"""with t as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
{_runs(400)},
e as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as was from z400),
p as (select doc_id, sum(b - a) as gone, count(*) as runs, max(b) as last, list(struct_pack(a := was, b := a) order by a) as gaps from e group by 1),
{_runs(240)},
u as (select z.doc_id, array_to_string(list_transform(regexp_extract_all(substr(h, 2 * a + 1, 2 * (b - a)), '..'), lambda y: case when y in {SPACES} then ' ' else 'x' end), '') as mask,
 a > 0 and substr(h, 2 * a - 1, 2) not in {SPACES} as joined, b < n and substr(h, 2 * b + 1, 2) not in {SPACES} as goes_on from z240 z join t on z.doc_id = t.doc_id),
x as (select doc_id, len(regexp_extract_all(mask, 'x+')) - (joined and mask[1] = 'x')::int - (goes_on and mask[-1] = 'x')::int as words from u),
y as (select doc_id, count(*) as n_passages from x where words >= 51 group by 1)
select t.doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(runs, 0) as n_spans,
 sha256(unhex(case when runs is null then h else array_to_string(list_transform(gaps, lambda x: substr(h, 2 * x.a + 1, 2 * (x.b - x.a))), '')
  || substr(h, 2 * last + 1) end)) as kept_sha256, coalesce(n_passages, 0) as n_passages
from t left join p using (doc_id) left join y using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose whole result it can express; the others are tested by brute force."""
    return {
        "op1_embedding_dedup": LINKS, "op4_html_extract": MAIN_TEXT, "op6_warc": CAPTURES, "op9_suffix_dedup": _repeats(),
        "pii_base": _pii_base(), "quality_counts": QUALITY_COUNTS,
    }
