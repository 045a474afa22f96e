"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.llm import decontaminate, divergence, frames, language_id, media, neardup, packing, quality, secrets, sharding, toxicity, urlfilter, warc
from spotloom.llm.frames import crc_mod, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = crc_mod(F.col("doc_id"), 4)
    model = language_id.fit(docs.where(rest != 2))
    out = language_id.predict(docs, model)
    return out.select("doc_id", (rest == 2).alias("held_out"), "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    scratch = frames.Scratch(spark)
    archives = scratch.keep(warc.write_archives(warc.plan_records(pages, "page_id", "url", "html")), "archives")
    read = warc.read_archives(archives, payloads=False)
    kind = next(f.dataType for f in pages.schema if f.name == "page_id")
    return read.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, d.payload_digest,
  case when first is not null and page_id <> first then 'revisit' else 'response' end as record_type,
  case when page_id <> first then first end as refers_to
from d left join f on d.payload_digest = f.payload_digest and payload_bytes >= 100
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = crc_mod(F.col("doc_id"), 4)
    model = toxicity.fit(docs, labels.where(rest != 2))
    return toxicity.score(docs, model).select("doc_id", (rest == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path())


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5_SQL = rf"""
with i as (select item_id, regexp_extract_all({_FOLD.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
iw as (select distinct cast(item_id as varchar) as item_id, least(10, len(w)) as n, w[s : s + least(10, len(w)) - 1] as g
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from i where len(w) > 0)),
ns as (select distinct n from iw),
d as (select doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
dw as (select doc_id, n, s, w[s : s + n - 1] as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, ns)),
m as (select doc_id, item_id, s, iw.n as n from dw join iw on dw.n = iw.n and dw.g = iw.g),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from (select distinct doc_id, s, n from m)) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from m) group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("redacted")
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", kind("assign").alias("n_assign"), kind("access").alias("n_access"), kind("hex").alias("n_hex"),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )


#: Arrivals that the documents are dealt into, and the size of file that compaction aims at.
ARRIVALS, TARGET_BYTES = 8, 128 << 20


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight parts, are compacted and read back by the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, frames.Scratch(spark).path("store"), target_bytes=TARGET_BYTES, keep_versions=1)
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact()
    store.compact(everything=True)
    store.vacuum(older_than_s=0)  # nobody else reads this store
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "lang", "source", F.octet_length(text).cast("bigint").alias("text_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


OP7_SQL = "select doc_id, lang, source, cast(strlen(coalesce(text, '')) as bigint) as text_bytes, sha256(coalesce(text, '')) as text_sha256 from documents"


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = crc_mod(F.col("doc_id"), 5)
    stats = frames.Scratch(spark).keep(quality.measure(docs), "stats")
    model = quality.fit(stats, labels.where(rest != 0))
    return quality.score(stats, model).select("doc_id", (rest == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


_WORDS = rf"""
w as (select doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
"""
OP9_SQL = rf"""
with recursive {_WORDS.strip()}
s as (select distinct doc_id, w[p : p + least(4, len(w)) - 1] as g from (select doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) as p from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)),
e as (select x, y from l union all select y, x from l),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select w.doc_id, coalesce(n, 0) as n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) as component_id, least(w.doc_id, coalesce(m, w.doc_id)) = w.doc_id as kept
from w left join n using (doc_id) left join (select x as doc_id, min(y) as m from r group by 1) using (doc_id)
"""


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    kind = stored.schema["doc_id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, sha, tail, feature, msize, msha = [], [], [], [], [], []
        for content in batch.column(2):
            data = content.as_buffer()
            payload, said = media.features(data)
            size.append(len(payload))
            sha.append(hashlib.sha256(payload).hexdigest())
            tail.append(zlib.crc32(payload[-64:]))
            feature.append(said)
            msize.append(data.size)
            msha.append(hashlib.sha256(data).hexdigest())
        i64 = pa.int64()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size, i64), pa.array(sha), pa.array(tail, i64), pa.array(msize, i64), pa.array(msha), pa.array(feature)],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return frames.map_batches(stored, one, schema)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.diverge(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all({_FOLD.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct r) as docs from w group by 1, 2, 3),
k as (select lang, term, sum(n) as lang_n from c group by 1, 2 having sum(docs) >= 3),
v as (select lang, count(*) as v, sum(lang_n) as lang_size from k group by 1),
g as (select distinct lang, source from d),
s as (select lang, source, sum(n) as size from c join k using (lang, term) group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(size, 0) + v) as p,
  1 + (1000000000::hugeint * (lang_n + 1)) // (lang_size + v) as q
  from g join k using (lang) join v using (lang) left join s on s.lang = g.lang and s.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200
"""


#: The rules on urls: host, path, verdict.
URL_RULES = "('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"


def op12_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), spark.sql(f"select * from values {URL_RULES} as rules(host, path, verdict)"))


OP12_SQL = rf"""
with rules(rhost, rpath, rverdict) as (values {URL_RULES}),
u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, {_FOLD.format("regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1)")} as host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) as path from u),
f as (select page_id, rhost || rpath as rule, rverdict from h join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  qualify row_number() over (partition by page_id order by length(rhost || rpath) desc, length(rhost) desc) = 1)
select h.page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from h left join f on h.page_id = f.page_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_warc, op3_toxicity, op4_packing, op5_decontaminate, op6_secrets, op7_sharding, op8_quality, op9_neardup, op10_media, op11_divergence, op12_urlfilter)
}
SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op5_decontaminate": OP5_SQL, "op7_sharding": OP7_SQL, "op9_neardup": OP9_SQL, "op11_divergence": OP11_SQL, "op12_urlfilter": OP12_SQL}
