"""Queries of single functions over the tables' texts and names, and of probes and renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import matching as M
from siltstone.functions import report as P
from siltstone.functions import text as T
from siltstone.plans.registry import Registry
from siltstone.session import table
from siltstone.sources import media, sinks

R = Registry()


def passages(spark, d):
    return table(spark, d, "benchmark")


def customers(spark, d):
    return table(spark, d, "customer")


@R(f"""with x as (select doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '{T.EMAIL}', '[address removed]', 'g'), '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')) as t from documents) select doc_id, case when length(t) <= 160 then t else rtrim(left(t, 159)) || '…' end as said from x""")
def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt("text").alias("said"))


@R("select page_id, 'see ' || url || '/personal/[owner removed]/x and /personal/' as shown from pages")
def owner_paths_masked(spark, d):
    t = F.concat(F.lit("see "), "url", F.lit("/Personal/u"), "page_id", F.lit("/x and /personal/"))
    return table(spark, d, "pages").select("page_id", T.strip_owner_paths(t).alias("shown"))


@R("select c_custkey, case c_custkey % 3 when 0 then 'write a' || c_custkey || '@b.example.com now' when 1 then 'write a' || c_custkey || '@b.example.com now' else 'meet at noon' end as said from customer")
def spoken_signs(spark, d):
    k = F.col("c_custkey")
    t = F.when(k % 3 == 0, F.concat(F.lit("write  a"), k, F.lit(" [at]\tb dot example dot com now"))).when(k % 3 == 1, F.concat(F.lit("write a"), k, F.lit("&#64;b.example (dot) com now"))).otherwise("meet at noon")
    return customers(spark, d).select("c_custkey", T.spoken_at(t).alias("said"))


@R("select item_id, md5(replace(replace(text, 'the ', '***'), 'an', '***')) as digest, repeat('•', 8) || case when length(left(text, 9)) > 4 then right(left(text, 9), 4) else '' end as masked from benchmark")
def secrets_scrubbed(spark, d):
    return passages(spark, d).select("item_id", F.md5(T.scrub("text", ["an", "", "the "])).alias("digest"), T.mask_tail(F.substring("text", 1, 9)).alias("masked"))


@R("""with x as (select item_id, upper(left(md5(text), 6)) as ref, text from benchmark) select item_id, ref || case when ref <> 'ABCDEF' then ',ABCDEF' else '' end as refs, 'say "' || left(text, 20) || '" and [held ABCDEF] and "' || left(text, 20) || '"' as said from x""")
def markers_restored(spark, d):
    ref = F.upper(F.substring(F.md5("text"), 1, 6))
    t = F.concat(F.lit('say "[held '), ref, F.lit(']" and [held ABCDEF] and "[held '), ref, F.lit(']"'))
    return passages(spark, d).select("item_id", F.array_join(T.refs_in(t), ",").alias("refs"), T.restore(t, F.create_map(ref, F.substring("text", 1, 20))).alias("said"))


@R("""with x as (select event_id, case when event_id % 5 <> 0 then ts + to_hours(cast(event_id % 60 as int)) end as t, event_id % 2 = 0 as rec, ts from events) select event_id, strftime(case when t is null then ts when rec and date_diff('second', ts, t) > 86400 then ts else t end, '%Y%m%d-%H%M%S') || '-call' || case when event_id % 4 = 0 then '-copy2' else '' end || '-' || left(sha256(cast(event_id as varchar)), 8) as stem from x""")
def output_stems(spark, d):
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    at = F.when(k % 5 != 0, F.timestamp_micros(F.unix_micros(ts) + k % 60 * 3600000000))
    moment = T.resolved_moment(at, k % 2 == 0, ts)
    return table(spark, d, "events").select("event_id", T.output_stem(moment, F.lit("call"), F.when(k % 4 == 0, F.lit(2)), "event_id").alias("stem"))


@R("""select p_partkey, regexp_replace(lower(regexp_replace(p_name || ' ' || p_brand || '!', '[^\\p{L}\\p{N}]+', '-', 'g')), '^-+|-+$', '', 'g') as slug, regexp_full_match(p_name, '[a-z0-9][a-z0-9-]*') as whole, regexp_full_match(lower(replace(p_brand, '#', '-')), '[a-z0-9][a-z0-9-]*') as brand from part""")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" "), "p_brand", F.lit("!"))).alias("slug"), T.is_slug("p_name").alias("whole"), T.is_slug(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("brand"))


@R("select c_custkey, case when c_custkey % 2 = 0 then 'ann k' || c_custkey else 'Ann.K' end as shown, c_custkey % 2 = 0 as address from customer")
def display_names(spark, d):
    k = F.col("c_custkey")
    who = F.when(k % 2 == 0, F.concat(F.lit("ann_k"), k, F.lit("@b.example"))).otherwise("Ann.K")
    return customers(spark, d).select("c_custkey", T.display_name(who).alias("shown"), P.looks_like_address(who).alias("address"))


@R("select page_id, md5('<transcript>' || chr(10) || replace(replace(html, '<', '‹'), '>', '›') || chr(10) || '</transcript>') as digest from pages")
def fenced_texts(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.fenced("html")).alias("digest"))


@R("select event_id, strftime(ts, '%Y-%m-%d') as day, case when event_id % 4 <> 3 then cast(floor(epoch(ts)) as bigint) end as seconds, strftime(ts + interval 2 hour, '%A %-d %B %Y, %H:%M') as friendly from events")
def stamps_parsed(spark, d):
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    said = F.when(k % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 2, F.date_format(F.timestamp_seconds(F.unix_timestamp(ts) + 7200), "yyyy-MM-dd'T'HH:mm:ss.'123456789+02:00'")).otherwise("no date")
    day = T.day_of(F.concat(F.lit("on "), F.date_format(ts, "yyyy-MM-dd"), F.lit(" or 2030-01-01")))
    return table(spark, d, "events").select("event_id", day.alias("day"), T.parse_stamp(said).alias("seconds"), P.friendly(ts, "Africa/Johannesburg").alias("friendly"))


@R("select event_id, case event_id % 3 when 0 then cast(event_id % 90 as double) when 1 then greatest(0.0, cast(event_id % 200 - 100 as double)) else 0.0 end as wait from events")
def waits_asked(spark, d):
    k = F.col("event_id")
    now = F.lit("2024-03-05 10:00:00").cast("timestamp")
    http = F.date_format(F.timestamp_seconds(F.unix_timestamp(now) + k % 200 - 100), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return table(spark, d, "events").select("event_id", T.retry_after(F.when(k % 3 == 0, (k % 90).cast("string")).when(k % 3 == 1, http).otherwise("later"), now).alias("wait"))


@R("select doc_id, lang, case lang when 'en' then 'eng' when 'de' then 'deu' when 'fr' then 'fra' when 'es' then 'spa' when 'af' then 'afr' when 'zu' then 'zul' when 'xh' then 'xho' when 'pt' then 'por' when 'nl' then 'nld' end as three from documents")
def languages(spark, d):
    locale = F.concat(F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "-ZA").otherwise(""))
    return table(spark, d, "documents").select("doc_id", T.language(locale).alias("lang"), T.language3(locale).alias("three"))


@R("select event_id, cast(json_extract(props, '$.k') as int) as old, 'new' as kind, event_id as id, 3 as keys from events")
def meta_merged(spark, d):
    old = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.lit("old").alias("kind")))
    m = T.merge_meta(old, F.to_json(F.struct(F.lit("new").alias("kind"), F.col("event_id").alias("id"))))
    return table(spark, d, "events").select("event_id", m["k"].cast("int").alias("old"), m["kind"].alias("kind"), m["id"].cast("long").alias("id"), F.size(m).alias("keys"))


@R("""select event_id, case event_id % 7 when 0 then 'no reason recorded' when 1 then 'it took too long to answer' when 2 then 'the key was refused' when 3 then 'too many requests' when 4 then 'the other side failed' when 5 then 'the file is not whole' else 'something else went wrong' end as said from events""")
def reasons_said(spark, d):
    said = F.array(*map(F.lit, ("", "Read timed out", "HTTP 403 for x", "status 429", "got 503 back", "Truncated at 9", "disk on fire")))
    return table(spark, d, "events").select("event_id", T.plain_reason(F.get(said, (F.col("event_id") % 7).cast("int"))).alias("said"))


@R("""select item_id, case when regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])of\\s+the([^\\p{L}\\p{N}_]|$)') then 'yes' else 'no' end as there, 'a-' || item_id || ',b' as routes from benchmark""")
def phrases_and_routes(spark, d):
    said = F.concat(F.lit("route 'a-"), "item_id", F.lit("' and then route 'b', not route 'c'"))
    return passages(spark, d).select("item_id", F.when(P.phrase_at(F.col("text"), "of the") > 0, "yes").otherwise("no").alias("there"), F.array_join(P.routes_said(said), ",").alias("routes"))


@R("select page_id, sha1(html) as sha1, sha256(html) as sha256 from pages")
def content_digests(spark, d):
    x = P.digests(F.encode("html", "UTF-8"))
    return table(spark, d, "pages").select("page_id", x["sha1"].alias("sha1"), x["sha256"].alias("sha256"))


@R()
def quick_xor_hashes(spark, d):
    return table(spark, d, "pages").select("page_id", M.quick_xor_hash(F.encode("html", "UTF-8")).alias("hash"))


@R("select conv_id, min(turn) * 10.0 + 0.5 as first, max(turn) * 10.0 + 5.5 as last, count(*) as n from conversations group by 1")
def segments_shifted(spark, d):
    seg = F.collect_list(F.struct((F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 5).alias("end"), F.col("role").alias("text")))
    df = table(spark, d, "conversations").groupBy("conv_id").agg(seg.alias("s")).withColumn("s", P.shifted(F.col("s"), F.lit(0.5)))
    return df.select("conv_id", F.array_min(F.transform("s", lambda x: x["start"])).alias("first"), F.array_max(F.transform("s", lambda x: x["end"])).alias("last"), F.size("s").cast("long").alias("n"))


# --- probes and renderings --------------------------------------------------------------------------------------------


def le(n, size):
    """A number as little-endian bytes in hexadecimal."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)))


@R("""with x as (select o_orderkey as k, 2 * (o_orderkey % 4000) as have, 2 * (o_orderkey % 4000) + case when o_orderkey % 3 = 0 then 500 else 0 end as told, 16000 * (1 + o_orderkey % 2) as rate from orders where o_orderkey % 4000 > 0)
    select k as path, 'wav' as container, cast(have as double) / rate as duration_s, told > have as truncated, case when told > have then 'audio data is cut' else '' end as reason, have + 44 as size_bytes from x""")
def wav_probes(spark, d):
    """A sound file an order, some cut short; its bytes are built by expressions and read by the probe."""
    k = F.col("o_orderkey")
    have, rate = (2 * (k % 4000)).cast("int"), (16000 * (1 + k % 2)).cast("int")
    told = have + F.when(k % 3 == 0, 500).otherwise(0)
    head = F.concat(F.lit("52494646"), le(told + 36, 4), F.lit("57415645666d742010000000"), F.lit("01000100"), le(F.shiftright(rate, 1), 4), le(rate, 4), F.lit("02001000"), F.lit("64617461"), le(told, 4))
    files = table(spark, d, "orders").where(k % 4000 > 0).select(k.cast("string").alias("path"), F.unhex(F.concat(head, F.repeat(F.lit("00"), have))).alias("content"))
    return media.probed(files).select(F.col("path").cast("long").alias("path"), "container", "duration_s", "truncated", "reason", F.col("size_bytes").cast("long").alias("size_bytes"))


@R("""with h as (select item_id, 's' || item_id as stem, 'subject: about ' || item_id || chr(10) || 'date: 2024-03-05 10:00:00 +00:00' as head, text from benchmark)
    select item_id, stem || '.md' as name, md5(head || chr(10) || chr(10) || text) as digest from h union all select item_id, '_' || stem || '-summary.md', md5(head || chr(10) || chr(10) || '- ' || left(text, 10) || chr(10) || '- second') from h
    union all select item_id, '_' || stem || '-actions.md', md5(head || chr(10) || chr(10) || '- Ann is reported as saying they would ' || left(text, 5)) from h""")
def files_rendered(spark, d):
    k = F.col("item_id")
    df = passages(spark, d).select("item_id", F.concat(F.lit("s"), k).alias("stem"), F.concat(F.lit("about "), k).alias("subject"), F.lit("2024-03-05 10:00:00").cast("timestamp").alias("at"), F.col("text").alias("body"), F.array(F.substring("text", 1, 10), F.lit("second")).alias("summary"), F.array(F.struct(F.lit("Ann").alias("owner"), F.substring("text", 1, 5).alias("what"))).alias("actions"))
    return sinks.rendered(df).select("item_id", "name", F.md5("data").alias("digest"))


@R("""select json_object('item_id', item_id, 'kind', 'note', 'title', 't' || item_id, 'body', left(text, 30), 'occurred_at', '2024-03-05', 'author', 'a', 'site', 's', 'route', 'r', 'source_name', 'n', 'version', 1) as value from benchmark""")
def item_envelopes(spark, d):
    one = lambda v, c: F.lit(v).alias(c)
    df = passages(spark, d).select("item_id", one("note", "kind"), F.concat(F.lit("t"), "item_id").alias("title"), F.substring("text", 1, 30).alias("body"), one("2024-03-05", "occurred_at"), one("a", "author"), one("s", "site"), one("r", "route"), one("n", "source_name"), one(1, "version"))
    return sinks.envelopes(df)
