"""Registered queries of the operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from perilscope.llm import decontaminate as decon
from perilscope.llm import ann, ballkmeans, bpe, hmm, jaccard, langid, licenses, merkle, shards, tokencounts, tokenfile, urls


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside a 10-word window of a benchmark item."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decon.find_contamination(docs, read(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, h: total + h["end"] - h["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
with lowered as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as win
  from (select item_id, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i
        from items where len(w) > 0)),
sizes as (select distinct size from windows),
places as (
  select doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i
        from lowered, sizes where len(w) >= size)),
found as (select doc_id, item_id, size, i from places join windows using (size, win)),
hit as (
  select doc_id, count(distinct j) as n_hit
  from (select doc_id, unnest(range(i, i + size)) as j from (select distinct doc_id, size, i from found))
  group by doc_id),
ids as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select lowered.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from lowered left join hit using (doc_id) left join ids using (doc_id)
"""


#: The tokenizer file of the queries, as installed on every machine.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every text and of the text they decode to."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, TOKENIZER, add=("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)


RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
#: Host name parts that put a host of the crawl on the list.
LISTED = ["ads", "adult", "bets", "casino", "pills", "spam"]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four rules before a list of all crawled hosts with a listed name part."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    host = F.translate(F.regexp_extract("url", r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = (
        pages.select(host.alias("key")).where(F.col("key").rlike(rf"(^|[.-])({'|'.join(LISTED)})([.-]|\z)"))
        .distinct().select("key", F.lit("block").alias("verdict"), F.lit(True).alias("listed"))
    )
    rules = spark.createDataFrame([(*r, False) for r in RULES], "key string, verdict string, listed boolean")
    judged = urls.filter_urls(pages, rules.unionByName(listed))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_HOST_SQL = "translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = rf"""
with parts as (
  select page_id, {_HOST_SQL} as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1) as path from pages),
ruled as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from parts)
select page_id, host, path, rule, case
  when rule in ('net/', 'example.com/de/') then 'block'
  when rule is not null then 'allow'
  when regexp_matches(host, '(^|[.-])({'|'.join(LISTED)})([.-]|$)') then 'block'
  else 'allow' end as verdict
from ruled
"""


N_SHARDS = 24


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the two-pass shuffle: counts differ by one at most."""
    shuffled = shards.external_shuffle(read(spark, sf_dir, "documents"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + shards.ROW_BYTES
    return shuffled.shards(N_SHARDS).select(
        "doc_id",
        size.cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of every document and the component of its links at a Jaccard similarity of 0.9."""
    return jaccard.jaccard_join(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
with lowered as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) end as s
  from lowered),
named as (select r, doc_id, s, len(s) as n, row_number() over (order by r) as k from sets),
tokens as (select r, n, unnest(s) as t from named),
counted as (
  select a.r as a, b.r as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as n_common
  from tokens a join tokens b on a.t = b.t and a.r < b.r and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) group by a.r, b.r),
links as (select a, b from counted where 100 * n_common >= 90 * (na + nb - n_common)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  with recursive walk(r, o) as (
    select r, r from named union select walk.r, both_ways.b from walk join both_ways on walk.o = both_ways.a)
  select r, o from walk)
select named.doc_id, cast(any_value(named.n) as bigint) as n_shingles, min(other.doc_id) as component_id
from named join reach using (r) join named other on other.r = reach.o
group by named.r, named.doc_id
"""


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents in compressed blocks and read them back."""
    folder = tokenfile.write_token_files(read(spark, sf_dir, "documents"), TOKENIZER)
    return tokenfile.read_token_files(spark, folder, with_ids=False)


def _fold(divisor: int) -> Column:
    """The remainder of the crc32 of doc_id as text; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every text by a hidden Markov model and by single words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (_fold(5) != 1).alias("train"))
    return hmm.score_texts(docs).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, against all others."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from two thirds of the labelled documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_fold(3) == 1).alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    judged = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document, and labels of the templates its word windows contain."""
    scanned = licenses.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["word"])
    base = F.transform("places", lambda p: p["label"])
    ours = F.transform("blocks", lambda b: b["label"])
    best = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, ours)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


_WORDS_SQL = (
    "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_TEMPLATE_ROWS = ", ".join(
    f"({k}, '{label}', {licenses.window(t)}, {licenses.least(t)}, [{', '.join(repr(w) for w in sorted(set(licenses._words(t))))}])"
    for k, (label, t) in enumerate(licenses.TEMPLATES)
)
OP10_SQL = rf"""
with lowered as (select row_number() over () as r, doc_id, text, {_WORDS_SQL.format("coalesce(text, '')")} as w from documents),
numbered as (select r, unnest(w) as word, unnest(range(len(w))) as i from lowered),
places as (
  select a.r, a.i, 'mit' as label from numbered a join numbered b on a.r = b.r and b.i = a.i + 1
    where a.word = 'mit' and b.word = 'license'
  union all
  select a.r, a.i, 'apache' from numbered a join numbered b on a.r = b.r and b.i = a.i + 1
    where a.word = 'apache' and b.word = 'license'
  union all
  select a.r, a.i, 'gpl' from numbered a join numbered b on a.r = b.r and b.i = a.i + 1
    join numbered c on a.r = c.r and c.i = a.i + 2
    where a.word = 'general' and b.word = 'public' and c.word = 'license'),
templates(k, label, size, need, words) as (values {_TEMPLATE_ROWS}),
hits as (
  select r, k, size, i, i // size as part, word
  from numbered join (select k, size, unnest(words) as word from templates) using (word)),
windows as (
  select a.r, a.k, a.i, count(distinct b.word) as held
  from hits a join (select *, part as near from hits union all select *, part - 1 from hits) b
    on a.r = b.r and a.k = b.k and a.part = b.near and b.i >= a.i and b.i < a.i + a.size
  group by all),
blocks as (select r, label, held / len(words) as share from windows join templates using (k) where held >= need),
based as (select r, count(*) as n, min(i) as a, max(i) as b, string_agg(distinct label, ',' order by label) as labels
  from places group by r),
every as (select r, string_agg(distinct label, ',' order by label) as labels
  from (select r, label from places union all select r, label from blocks) group by r),
best as (select r, max(share) as share from blocks group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_base, a as first_word, b as last_word,
  coalesce(based.labels, '') as base_labels, coalesce(every.labels, '') as labels,
  case when n > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from lowered left join based using (r) left join every using (r) left join best using (r)
"""

def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; where the crc32 of the id is even, the claimed text has lost its line ends."""
    docs = read(spark, sf_dir, "documents")
    claimed = F.when(_fold(2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(docs, claims={"text": claimed})


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


_CRC_SQL = (
    "list_reduce(list_concat([4294967295::bigint], list_transform(string_split(coalesce(cast(doc_id as varchar), ''), ''), "
    "lambda c: ascii(c)::bigint)), lambda x, c: case when c = 0 then x else list_reduce([xor(x, c), 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda y, z: xor(y >> 1, 3988292384 * (y & 1))) end)"
)
_LEAF_SQL = "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
OP11_SQL = rf"""
with recursive docs as (
  select doc_id, case when source is null then '0' else '1' || source end as g,
    {_LEAF_SQL.format(_field_sql("text"))} as leaf,
    case when {_CRC_SQL} % 2 = 1 then {_LEAF_SQL.format(_field_sql("replace(text, chr(10), '')"))}
      else {_LEAF_SQL.format(_field_sql("text"))} end as claim
  from documents),
leaves as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n
  from docs),
nodes as (
  select g, 0 as step, i as p, n, leaf as h from leaves
  union all
  select g, step + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' order by p)) from nodes where n > 1 group by g, step, p // 3, n),
subroots as (
  select g, h, row_number() over (order by g) - 1 as k, count(*) over () as n, max(step) over () as height from nodes where n = 1),
upper as (
  select 0 as step, k as p, n, h from subroots
  union all
  select step + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' order by p)) from upper where n > 1 group by step, p // 3, n),
places as (
  select row_number() over () as r, leaves.doc_id, leaf, claim, leaves.g, i, k, height, subroots.h as subroot
  from leaves join subroots using (g)),
siblings as (
  select r, step, p, p < i // pow(3, step)::bigint as before, h from places join nodes using (g)
    where nodes.n > 1 and p // 3 = i // pow(3, step + 1)::bigint and p <> i // pow(3, step)::bigint
  union all
  select r, height + 1 + step, p, p < k // pow(3, step)::bigint, h from places, upper
    where upper.n > 1 and p // 3 = k // pow(3, step + 1)::bigint and p <> k // pow(3, step)::bigint),
steps as (
  select r, step from places join (select distinct g, step from nodes where n > 1) using (g)
  union all select r, height + 1 + step from places, (select distinct step from upper where n > 1)),
sides as (
  select r, step, coalesce(string_agg(h, '' order by p) filter (before), '') as a,
    coalesce(string_agg(h, '' order by p) filter (not before), '') as b
  from steps left join siblings using (r, step) group by r, step),
ordered as (select r, row_number() over (partition by r order by step) as o, a, b from sides),
fold as (
  select r, 1 as o, claim as h from places
  union all
  select r, fold.o + 1, sha256(a || h || b) from fold join ordered using (r, o)),
folded as (select r, arg_max(h, o) as h from fold group by r),
proofs as (select r, sha256(coalesce(string_agg(a || b, '' order by o), '')) as h from places left join ordered using (r) group by r),
root as (select h from upper where n = 1)
select doc_id, leaf, subroot, root.h as root, proofs.h as proof_sha256, folded.h as folded_root, folded.h = root.h as verified
from places join proofs using (r) join folded using (r), root
"""


#: The tokenizer file whose tokens are counted, and the length of a model's context.
COUNTED, CONTEXT = public_tokenizers.path("byte_bpe_50k.json"), 1024


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text. The cache is a new one, so all distinct texts are misses."""
    counted = tokencounts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), COUNTED)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors and how far they are from the vectors."""
    done = ballkmeans.compress(read(spark, sf_dir, "embeddings"))
    out = ballkmeans.with_label_error(done.codes(), "label")
    books = done.codebooks.digest() if done.codebooks else None
    return out.select("vec_id", "code", "error", "label_error", F.lit(books).cast("string").alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment to the codebook ``book{k}``, and the codebook after it."""
    return f"""
near{k} as (
  select r, parts.p, min(list_sum(list_transform(range(1, width + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint * 64 + e) as best
  from parts join book{k} using (p), size group by r, parts.p),
sums{k} as (
  select p, e, i, floor(sum(v) / count(*)::double)::bigint as v
  from (select near{k}.p, best % 64 as e, unnest(range(1, width + 1)) as i, unnest(x) as v from near{k} join parts using (r, p), size)
  group by p, e, i),
book{k + 1} as (
  select book{k}.p, book{k}.e, coalesce(new.c, book{k}.c) as c
  from book{k} left join (select p, e, list(v order by i) as c from sums{k} group by p, e) new on new.p = book{k}.p and new.e = book{k}.e),"""


OP13_SQL = rf"""
with kept as (
  select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
size as (select any_value(len(v)) // 16 as width from kept),
parts as (select r, p, list_slice(v, p * width + 1, p * width + width) as x from kept, range(16) positions(p), size),
book0 as (select p, r - 1 as e, x as c from parts where r <= 64),{_round_sql(0)}{_round_sql(1)}
final as (
  select r, parts.p, min(list_sum(list_transform(range(1, width + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint * 64 + e) as best
  from parts join book2 using (p), size group by r, parts.p),
coded as (
  select r, string_agg(printf('%02x', best % 64), '' order by p) as code, sum(best // 64)::bigint as error from final group by r),
books as (
  select sha256(string_agg(v::varchar, ',' order by p, e, i)) as h
  from (select p, e, unnest(range(1, width + 1)) as i, unnest(c) as v from book2, size))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, books.h as codebooks_sha256
from kept join coded using (r), books
"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe": op2_bpe,
    "op3_url_filters": op3_url_filters,
    "op4_sharding": op4_sharding,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_files": op6_token_files,
    "op7_hmm": op7_hmm,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_language_id": op9_language_id,
    "op10_license_scans": op10_license_scans,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op1_decontamination": OP1_SQL,
    "op3_url_filters": OP3_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op10_license_scans": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
