"""Queries over the ledger's upkeep: patches, moves, clearing, erasure's reach, deliveries, selections, expiry, rates, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import answers as A
from siltstone.operators import upkeep as U
from siltstone.plans.registry import Registry
from siltstone.session import table
from siltstone.sources.adapter import HOLDS, ITEMS, LOG, holds, items, log

R = Registry()
OPEN = "state not in ('DONE', 'QUARANTINED', 'SKIPPED_EMPTY', 'ERASED')"

PATCHES = "patches as (select user_id * 32 as item_id, event_id as id, case when event_id % 3 <> 0 then 'n' || event_id end as name, case when event_id % 2 = 0 then cast(floor(value) as bigint) end as size_bytes from events)"


@R(f"""with {ITEMS}, {PATCHES}, p as (select item_id, arg_max(name, id) filter (name is not null) as n, arg_max(size_bytes, id) filter (size_bytes is not null) as s from patches group by 1)
    select item_id, case when state = 'ERASED' then name else coalesce(n, name) end as name, route, state, discovered_at, created_at, case when state = 'ERASED' then size_bytes else coalesce(s, size_bytes) end as size_bytes, owner from items left join p using (item_id)""")
def patched_items(spark, d):
    k = F.col("event_id")
    patches = table(spark, d, "events").select((F.col("user_id") * 32).alias("item_id"), k.alias("id"), F.when(k % 3 != 0, F.concat(F.lit("n"), k)).alias("name"), F.when(k % 2 == 0, F.floor("value").cast("long")).alias("size_bytes"))
    return U.patched(items(spark, d), patches, ["name", "size_bytes"])


@R(f"""with {ITEMS}, {LOG}, m as (select item_id * 32 as item_id, arg_max(route_to, id) as r from log where kind = 'requeued' and id % 4 <> 0 group by 1) select items.* replace (case when state = 'ERASED' then route else coalesce(r, route) end as route) from items left join m using (item_id)""")
def rerouted_items(spark, d):
    moves = log(spark, d).where("kind = 'requeued'").select((F.col("item_id") * 32).alias("item_id"), "id", F.col("route_to").alias("route"), F.when(F.col("id") % 4 != 0, "asked for").otherwise(" ").alias("reason"))
    return U.rerouted(items(spark, d), moves)


@R(f"""with {ITEMS}, s as (select l_orderkey as item_id, l_linenumber as path, cast(l_quantity as bigint) as bytes, cast(epoch(l_shipdate) as bigint) as modified from lineitem), r as (select distinct l_orderkey as item_id from lineitem where l_suppkey % 13 = 0)
    select * from s where 883612800 - modified > 172800 and item_id not in (select item_id from items where {OPEN}) and item_id not in (select item_id from r)""")
def scratch_to_clear(spark, d):
    line = table(spark, d, "lineitem")
    scratch = line.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("path"), F.col("l_quantity").cast("long").alias("bytes"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("modified"))
    return U.clearable(scratch, items(spark, d), line.where("l_suppkey % 13 = 0").select(F.col("l_orderkey").alias("item_id")), F.lit(883612800))


@R(f"""with {ITEMS}, {HOLDS}, o as (select l_orderkey as item_id, string_agg(distinct 'f' || l_linenumber, ',' order by 'f' || l_linenumber) as outputs from lineitem where l_linenumber <= 3 group by 1), h as (select item_id, count(*) as held from holds where decision <> 'REFUSED' group by 1)
    select item_id, name, route, state, coalesce(created_at, discovered_at) as recorded_at, coalesce(outputs, '') as outputs, coalesce(held, 0) as held from items left join o using (item_id) left join h using (item_id) where state <> 'ERASED'""")
def erasure_reach(spark, d):
    outputs = table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("item_id"), F.concat(F.lit("f"), "l_linenumber").alias("name"))
    return U.reach(items(spark, d), outputs, holds(spark, d).where("decision <> 'REFUSED'")).withColumn("outputs", F.array_join("outputs", ","))


@R(f"""with {HOLDS}, t as (select o_orderkey as item_id, 'call-' || o_orderkey as stem from orders where o_orderkey % 9 <> 0), x as (select hold_id, item_id, upper(left(hold_id, 6)) as ref, stem, case when mode = 'shadow' then 'nothing was withheld' when decision = 'REFUSED' then 'refused' when decision <> 'RELEASED' then 'not answered'
      when n % 5 = 0 then 'already there' when stem is null then 'no transcript' else 'to write' end as what from holds left join t using (item_id))
    select hold_id, item_id, ref, what, case when what in ('to write', 'already there') then stem || '-released-' || ref || '.md' end as file from x""")
def release_deliveries(spark, d):
    k = F.col("o_orderkey")
    transcripts = table(spark, d, "orders").where(k % 9 != 0).select(k.alias("item_id"), F.concat(F.lit("call-"), k, F.lit(".md")).alias("transcript"))
    h = holds(spark, d)
    return U.deliveries(h, transcripts, h.where("n % 5 = 0"))


@R(f"with {HOLDS}, first as (select upper(left(min(hold_id), 6)) as ref from holds) select holds.* from holds join first on upper(left(hold_id, 6)) = ref")
def holds_by_ref(spark, d):
    """The passages whose reference is that of the smallest key."""
    h = holds(spark, d)
    return U.by_ref(h, h.agg(F.min("hold_id")).first()[0][:6])


@R(f"with {LOG} select * from log where item_id = 11 order by id limit 5")
def first_events_of_item(spark, d):
    return U.history(log(spark, d), "item_id", 11, 5)


ROUTES = "routes as (select distinct c_mktsegment as route, c_mktsegment <> 'BUILDING' as enabled from customer), asked as (select distinct case when c_nationkey % 3 = 0 then c_mktsegment else ' ' || lower(c_mktsegment) end as route from customer)"


@R(f"""with {ROUTES}, a as (select distinct trim(route) as route from asked) select a.route, case when r.route is null then 'unknown' when not enabled then 'switched off' else 'chosen' end as outcome from a left join routes r using (route)""")
def routes_asked_for(spark, d):
    c = table(spark, d, "customer")
    routes = c.select(F.col("c_mktsegment").alias("route"), (F.col("c_mktsegment") != "BUILDING").alias("enabled")).distinct()
    asked = c.select(F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"))).alias("route"))
    chosen, problems = U.selected_routes(routes, asked)
    return chosen.select("route", F.lit("chosen").alias("outcome")).unionByName(problems.withColumnRenamed("problem", "outcome"))


@R(f"""with {HOLDS}, known as (select distinct reviewer || case when n % 2 = 0 then '@one.example' else '@two.example' end as reviewer from holds where decision = 'PENDING' and reviewer is not null and (reviewer <> 'rev1' or n % 2 = 0)),
      typed as (select unnest(['rev1', 'REV2', ' rev3@one.example', 'rev4@two.example', 'nobody']) as who), e as (select who, trim(who) as reviewer, null as candidates from typed where trim(who) in (select reviewer from known)),
      m as (select who, list_sort(list(reviewer) filter (reviewer is not null)) as c from typed left join known on lower(trim(split_part(trim(who), '@', 1))) = lower(split_part(reviewer, '@', 1)) where who not in (select who from e) group by 1)
    select * from e union all select who, case when c is null then trim(who) when len(c) = 1 then c[1] end, case when len(c) > 1 then array_to_string(c, ', ') end from m""")
def reviewers_meant(spark, d):
    h = holds(spark, d).where("reviewer <> 'rev1' or n % 2 = 0").withColumn("reviewer", F.concat("reviewer", F.when(F.col("n") % 2 == 0, "@one.example").otherwise("@two.example")))
    return U.reviewers_meant(spark.createDataFrame([(x,) for x in ("rev1", "REV2", " rev3@one.example", "rev4@two.example", "nobody")], "who string"), h)


@R("""select o_orderkey as item_id, 'n' || o_orderkey as source_name, o_orderpriority as route, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as done_at, 'call ' || o_custkey as named, case when o_orderkey % 2 = 0 then 'said so' end as reason from orders where strftime(o_orderdate, '%Y-%m') = '1996-03' and o_orderkey % 5 > 1""")
def names_decided(spark, d):
    """Of the items that finished in a month; some have no decision, some an undecided one, some no JSON."""
    k = F.col("o_orderkey")
    naming = F.to_json(F.struct(F.struct((k % 5 != 1).alias("decided"), F.concat(F.lit("call "), F.col("o_custkey")).alias("name"), F.when(k % 2 == 0, "said so").alias("reason")).alias("naming"), F.lit(1).alias("other")))
    df = table(spark, d, "orders").select(k.alias("item_id"), F.concat(F.lit("n"), k).alias("name"), F.col("o_orderpriority").alias("route"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("done_at"), F.when(k % 10 == 0, "none").when(k % 5 == 0, "{}").otherwise(naming).alias("meta"))
    return U.named_on(df, "1996-03")


@R("""with x as (select 'key ' || c_custkey as what, case when c_custkey % 10 = 0 then 'soon' when c_custkey % 10 = 1 then ' ' else strftime(date '2024-01-01' + cast(c_custkey % 400 as int), '%Y-%m-%dT00:00') end as until from customer), y as (select *, try_strptime(left(trim(until), 10), '%Y-%m-%d') as day from x where trim(until) <> ''),
      z as (select what, coalesce(date_diff('day', date '2024-06-01', cast(day as date)), 0) as days, day from y) select what, days, case when day is null then 'unreadable' when days < 0 then 'expired' else 'expires' end as said from z where day is null or days <= 45""")
def credentials_expiring(spark, d):
    k = F.col("c_custkey")
    until = F.when(k % 10 == 0, "soon").when(k % 10 == 1, " ").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")), "yyyy-MM-dd'T00:00'"))
    return U.expiries(table(spark, d, "customer").select(F.concat(F.lit("key "), k).alias("what"), until.alias("until")), "2024-06-01").withColumn("days", F.col("days").cast("long"))


@R(f"""with {ITEMS}, q as (select count(*) as queued, count(*) filter (state <> 'DISCOVERED') as started, cast(epoch(min(cast(discovered_at as timestamp))) as bigint) as o from items where {OPEN}), m as (select left(discovered_at, 10) as day, count(*) as queued from items where {OPEN} group by 1),
      t as (select queued, row_number() over (order by day desc) as r from m where day < '1998-07-01'), p as (select max(queued) filter (r = 1) as previous, max(queued) filter (r = 2) as e from t), x as (select queued, started, previous, 901065600 - o as oldest_age_s, queued > 0 and 901065600 - o > 86400 as stale, queued > 0 and queued > previous as growing, queued > previous and previous > e as growing_across_days from q, p)
    select *, queued > 0 and (stale or growing_across_days) as short_of_throughput from x""")
def queue_state(spark, d):
    mornings = items(spark, d).where(OPEN).groupBy(F.substring("discovered_at", 1, 10).alias("day")).agg(F.count("*").alias("queued"))
    return U.queue_state(items(spark, d), mornings, "1998-07-01", "1998-07-22T00:00:00Z")


@R("""with p as (select case when s_suppkey % 7 <> 0 then s_suppkey % 60 end as hours_old, s_suppkey % 5 as arrived, s_suppkey % 4 as done, s_suppkey % 3 as failed, cast(s_suppkey % 100 as double) as month_usd, cast(s_suppkey % 10 as double) as day_usd, s_suppkey % 50 = 3 as unpriced from supplier)
    select count(*) as peers, count(*) filter (hours_old is null or hours_old > 36) as silent, cast(sum(arrived) as bigint) as arrived, cast(sum(done) as bigint) as done, cast(sum(failed) as bigint) as failed, sum(month_usd) as month_usd, sum(day_usd) as day_usd, bool_or(unpriced) as any_unpriced from p""")
def group_totals(spark, d):
    k = F.col("s_suppkey")
    mod = lambda n, c: (k % n).alias(c)
    peers = table(spark, d, "supplier").select(F.when(k % 7 != 0, k % 60).alias("hours_old"), mod(5, "arrived"), mod(4, "done"), mod(3, "failed"), (k % 100).cast("double").alias("month_usd"), (k % 10).cast("double").alias("day_usd"), (k % 50 == 3).alias("unpriced"))
    return U.group_totals(peers)


@R("""with recursive c as (select user_id as k, event_id as id, epoch_us(ts) / 1000000 as t, row_number() over (partition by user_id order by ts, event_id) as i from events), b as (select k, id, t, i, cast(t as double) as starts, cast(t as double) + 600 as tat from c where i = 1
      union all select c.k, c.id, c.t, c.i, greatest(c.t, b.tat - 1200), greatest(c.t, b.tat) + 600 from b join c on c.k = b.k and c.i = b.i + 1) select k, id, round(starts, 3) as starts from b""")
def calls_paced(spark, d):
    """Each user's events as calls under a bucket of three with a token every ten minutes; the SQL steps from call to call."""
    at = F.expr("unix_micros(cast(ts as timestamp)) / 1000000")
    calls = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), at.alias("at"))
    return U.paced(calls, ["k"], 0.1, 3).select("k", "id", F.round("starts", 3).alias("starts"))


# --- answers ----------------------------------------------------------------------------------------------------------


def answers_of(spark, d):
    """An answer about each turn: an exact quote, one that is not in the text, an entry without words, a commitment, a broken body."""
    df = table(spark, d, "conversations").withColumn("item_id", F.concat_ws("-", "conv_id", "turn"))
    quote, k = F.substring("text", 11, 50), F.col("turn")
    item = lambda s, q: F.struct(s.alias("summary"), q.alias("quote"), F.col("role").alias("speaker"), F.lit("").alias("site"), F.lit(0.5).alias("confidence"))
    promise = F.struct(F.when(k % 2 == 0, F.col("role")).otherwise("").alias("owner"), F.lit("send it.").alias("what"), F.lit("Friday").alias("by_when"), quote.alias("quote"), F.lit(None).cast("string").alias("speaker"), F.lit("yard").alias("site"), F.lit(7.0).alias("confidence"))
    body = F.to_json(F.struct(F.lit("s").alias("summary_en"), F.struct(F.when(k % 3 == 0, "depot").otherwise("").alias("name"), F.lit("zq xv qk").alias("quote")).alias("site"), F.array(item(F.lit("first"), quote), item(F.lit("absent"), F.lit("zq xv qk wj"))).alias("decisions"), F.array(promise).alias("commitments"), F.array(item(F.lit(" "), quote)).alias("money")))
    return df.select("item_id", "text", F.when(k % 7 == 6, "not json").otherwise(body).alias("body"))


@R("""with t as (select conv_id || '-' || turn as item_id, role, turn, trim(substring(text, 11, 50)) as q from conversations where turn % 7 <> 6 and regexp_matches(substring(text, 11, 50), '[A-Za-z0-9]')), n as (select *, case when turn % 3 = 0 then 'depot' end as site, case when turn % 3 = 0 then 1 else 0 end as s from t)
    select item_id, 0 as place, 'site' as category, 'depot' as summary, 'review' as kind, site from n where s = 1 union all select item_id, s, 'decisions', 'first', 'proposal', site from n union all select item_id, s + 1, 'decisions', 'absent', 'review', site from n
    union all select item_id, s + 2, 'commitments', case when turn % 2 = 0 then role || ' is reported as undertaking: send it' else 'undertaken by someone unnamed: send it' end, 'proposal', 'yard' from n union all select item_id, s + 3, 'money', '', 'review', site from n""")
def answers_assembled(spark, d):
    df = answers_of(spark, d).where(F.substring("text", 11, 50).rlike("[A-Za-z0-9]"))
    out = A.assembled(df, A.read_answers(df))
    return out.select("item_id", "place", "category", "summary", "kind", "site")


@R("""select conv_id || '-' || turn as item_id, case when turn % 7 = 6 then 'summary_en,languages,participants,site,decisions,commitments,money,materials,defects,safety,programme,open_questions,follow_ups,unclear_passages' else 'languages,participants,materials,defects,safety,programme,open_questions,follow_ups,unclear_passages' end as lacking from conversations""")
def answers_lacking(spark, d):
    return A.read_answers(answers_of(spark, d)).select("item_id", F.array_join("lacking", ",").alias("lacking"))


@R()
def proposals_masked(spark, d):
    """Proposals of the answers where the first words of the third of the turns are held."""
    df = answers_of(spark, d)
    words = F.when(F.startswith("item_id", F.lit("1")), F.substring("text", 1, 80)).otherwise(F.substring("text", 21, 30))
    spans = df.select("item_id", F.array(F.struct(F.lit(0).alias("start"), words.alias("words"), F.upper(F.substring(F.sha2(words, 256), 1, 6)).alias("ref"))).alias("spans"))
    kept, held = A.without_held(A.assembled(df, A.read_answers(df)).where("kind = 'proposal'"), spans)
    return kept.select("item_id", "place", "quote").unionByName(held.select("item_id", "place", F.concat(F.lit("held "), "ref").alias("quote")))


@R(r"""with x as (select item_id, upper(left(md5(text), 6)) as ref, case item_id % 3 when 0 then 'Was it said, may it be released into the record?' when 1 then 'Is that so?' else 'No question here.' end as q from benchmark)
    select item_id, case when item_id % 3 = 0 then 'Was it said, may it be released into the record?' else '' end as question from x""")
def questions_harvested(spark, d):
    k = F.col("item_id") % 3
    q = F.when(k == 0, "Was it said, may it be released into the record?").when(k == 1, "Is that so?").otherwise("No question here.")
    line = A.held_line(F.upper(F.substring(F.md5("text"), 1, 6)), F.lit("a rate"), F.lit("2 Mar 2024"), q)
    return table(spark, d, "benchmark").select("item_id", A.harvestable(line).alias("question"))


@R("""with t as (select item_id, list_filter(string_split(text, ' '), lambda x: trim(x) <> '') as w, case when item_id % 2 = 0 then 'Nina Kok' else upper(string_split(text, ' ')[1]) end as party from benchmark), f as (select item_id, party, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i)[1:20] as v from t)
    select item_id, array_to_string(case when list_contains(list_transform(v, lambda y: lower(y)), lower(party)) then v else list_concat([party], v) end, ' ') as sent from f""")
def vocabulary_sent(spark, d):
    words = F.split("text", " ")
    party = F.when(F.col("item_id") % 2 == 0, "Nina Kok").otherwise(F.upper(F.get(words, F.lit(0))))
    return table(spark, d, "benchmark").select("item_id", F.array_join(A.vocabulary_sent(words, party, 20), " ").alias("sent"))


@R("""with x as (select c_custkey, list_filter(list_transform(string_split(lower(c_mktsegment) || ', r' || (c_custkey % 9) || ',Not One, r' || (c_custkey % 2), ','), lambda y: trim(y)), lambda y: y <> '') as n from customer), g as (select c_custkey, list_filter(n, lambda y: regexp_full_match(y, '[a-z0-9][a-z0-9-]*')) as g from x)
    select c_custkey, case when g[2] = g[3] then array_to_string(g[1:2], ',') else array_to_string(g, ',') end as routes, 'not a slug: Not One' || case when g[2] = g[3] then ';declared twice: ' || g[2] else '' end as problems from g""")
def routes_declared(spark, d):
    k = F.col("c_custkey")
    r = A.declared_routes(F.concat(F.lower("c_mktsegment"), F.lit(", r"), k % 9, F.lit(",Not One, r"), k % 2))
    return table(spark, d, "customer").select("c_custkey", F.array_join(r["routes"], ",").alias("routes"), F.array_join(r["problems"], ";").alias("problems"))
