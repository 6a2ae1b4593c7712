"""Queries over the ledger: items, log and held passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import ledger as L
from siltstone.plans.registry import Registry
from siltstone.session import table
from siltstone.sources.adapter import HOLDS, ITEMS, LOG, holds, items, log

R = Registry()
OPEN = "state not in ('DONE', 'QUARANTINED', 'SKIPPED_EMPTY', 'ERASED')"
ACTIVE = "state in ('DISCOVERED', 'CLAIMED', 'FETCHED', 'TRANSCRIBED', 'ANALYSED')"
CUT = "1999-01-01"


@R(f"with {ITEMS} select state, route, count(*) as n from items group by grouping sets ((state), (route, state))")
def state_route_grouping_sets(spark, d):
    return L.state_counts(items(spark, d))


@R(f"""with {ITEMS} select left(discovered_at, 10) as day, route, count(*) as discovered, count(*) filter (state = 'DONE') as done, count(*) filter (state = 'QUARANTINED') as quarantined,
    count(*) filter (state = 'SKIPPED_EMPTY') as skipped, count(*) filter ({OPEN}) as in_flight from items group by 1, 2""")
def cohort_counts_by_route(spark, d):
    return L.cohort(items(spark, d))


@R(f"with {ITEMS} select left(discovered_at, 10) as day, count(*) as discovered, count(*) filter (state = 'DONE') as done, count(*) filter (state = 'QUARANTINED') as quarantined, count(*) filter (state = 'SKIPPED_EMPTY') as skipped, count(*) filter ({OPEN}) as in_flight from items group by 1")
def cohort_counts_whole_service(spark, d):
    return L.cohort(items(spark, d), ["day"])


@R(f"with {ITEMS} select * from items where route = '1-URGENT'")
def rows_in_route(spark, d):
    return L.in_route(items(spark, d), "1-URGENT")


@R(f"with {ITEMS} select * from items where state = 'QUARANTINED'")
def rows_in_state(spark, d):
    return items(spark, d).where("state = 'QUARANTINED'")


@R(f"with {ITEMS} select * from items where contains(lower(name), 'call +27000000012')")
def find_by_name(spark, d):
    return L.by_name(items(spark, d), "CALL +27000000012")


@R(f"with {ITEMS} select * from items where {OPEN}")
def unfinished_items(spark, d):
    return L.unfinished(items(spark, d))


LEASES = "leases as (select o_orderkey as item_id, case when o_orderkey % 4 = 0 then '1999-06-01T00:00:00Z' when o_orderkey % 4 = 1 then '2001-06-01T00:00:00Z' end as lease_until, case when o_orderkey % 6 = 5 then '2001-01-01T00:00:00Z' end as retry_at from orders)"


def leases_of(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("item_id"), F.when(k % 4 == 0, "1999-06-01T00:00:00Z").when(k % 4 == 1, "2001-06-01T00:00:00Z").alias("lease_until"), F.when(k % 6 == 5, "2001-01-01T00:00:00Z").alias("retry_at"))


@R(f"""with {ITEMS}, {LEASES} select i.* from items i left join leases l using (item_id) where {ACTIVE} and (lease_until is null or lease_until < '2000-01-01T00:00:00Z')
    and (retry_at is null or retry_at <= '2000-01-01T00:00:00Z') order by discovered_at, item_id limit 200""")
def claimable_items(spark, d):
    return L.claimable(items(spark, d), leases_of(spark, d), "2000-01-01T00:00:00Z", 200)


@R(f"with {ITEMS} select * from items where state = 'DONE' and coalesce(created_at, discovered_at) < '{CUT}'")
def due_for_archive(spark, d):
    return L.due_for_archive(items(spark, d), CUT)


DISPUTED = "select distinct item_id from log where route_from <> route_to and kind = 'attempt-failed'"


@R(f"""with {ITEMS}, {LOG}, disputed as ({DISPUTED}) select item_id, route, case when state = 'ERASED' then 'erased' when state <> 'DONE' then 'not done' when route is null then 'no route'
    when item_id in (select item_id from disputed) then 'routes disagree' when coalesce(created_at, discovered_at) is null then 'no date' when coalesce(created_at, discovered_at) >= '{CUT}' then 'too young' when size_bytes <= 0 then 'no size' end as reason from items""")
def archive_eligibility(spark, d):
    return L.archive_verdict(items(spark, d), CUT, log(spark, d).where("route_from <> route_to and kind = 'attempt-failed'"))


@R(f"with {ITEMS} select * from items where route in ('1-URGENT', '5-LOW') and {ACTIVE} and coalesce(created_at, discovered_at) < '{CUT}'")
def backfill_queue(spark, d):
    return L.backfill_queue(items(spark, d), CUT, ["1-URGENT", "5-LOW"])


@R(f"with {ITEMS} select coalesce(bool_or({ACTIVE} and coalesce(created_at, discovered_at) >= '{CUT}'), false) as waiting from items")
def live_work_waiting(spark, d):
    return L.is_waiting(items(spark, d), CUT)


@R(f"with {ITEMS} select * from items where route = '2-HIGH' and left(discovered_at, 10) >= '1996-01-01' and left(discovered_at, 10) <= '1996-12-31'")
def forget_selection(spark, d):
    return L.selection(items(spark, d), route="2-HIGH", first="1996-01-01", last="1996-12-31")


@R(f"with {HOLDS} select * from holds where left(held_at, 10) between '1997-03-01' and '1997-03-31'")
def held_in_days(spark, d):
    return L.in_days(holds(spark, d), "held_at", "1997-03-01", "1997-03-31")


@R(f"with {HOLDS} select * from holds where reviewer = 'rev3' and decision = 'PENDING' and mode = 'on'")
def review_queue(spark, d):
    return L.review_queue(holds(spark, d), "rev3")


@R(f"with {HOLDS} select hold_id, item_id, '' as reviewer, category, decision, mode, site, held_at, '' as answered_at, start_offset, end_offset, n from holds")
def holds_without_words(spark, d):
    return L.without_words(holds(spark, d), ["reviewer", "answered_at"])


LISTING = """listing as (select l_orderkey * 8 + l_linenumber as item_id, 'f' || (l_suppkey % 50) as parent_id, l_linenumber = 7 as is_folder, l_returnflag = 'R' and l_linenumber = 1 as deleted,
  case l_linenumber % 4 when 0 then 'audio/mp4' when 1 then 'text/markdown' when 2 then 'video/mp4' end as mime from lineitem),
  outputs as (select 'f' || r as parent_id from range(5) t(r)), own as (select distinct l_orderkey * 8 + l_linenumber as item_id from lineitem where l_partkey % 9 = 0)"""


@R(f"""with {LISTING} select item_id, case when is_folder or deleted then 'STRUCTURE' when item_id in (select item_id from own) then 'OUR_OUTPUT'
    when parent_id in (select parent_id from outputs) and not coalesce(mime like 'audio/%' or mime like 'video/%', false) then 'OUR_OUTPUT' when mime like 'audio/%' or mime like 'video/%' then 'RECORDING' else 'UNRECOGNISED' end as kind from listing""")
def classify_listing(spark, d):
    df = table(spark, d, "lineitem")
    m = F.col("l_linenumber") % 4
    listing = df.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"), F.concat(F.lit("f"), F.col("l_suppkey") % 50).alias("parent_id"), (F.col("l_linenumber") == 7).alias("is_folder"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("deleted"), F.when(m == 0, "audio/mp4").when(m == 1, "text/markdown").when(m == 2, "video/mp4").alias("mime"))
    own = df.where("l_partkey % 9 = 0").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"))
    outputs = spark.range(5).select(F.concat(F.lit("f"), "id").alias("parent_id"))
    return L.classify_source(listing, outputs, own).select("item_id", "kind")


@R("""with o as (select user_id as item_id, event_id, epoch_us(ts) / 1000000 as moment, floor(value) as size, event_type as ctag, case when value > 2 then event_type end as hash, event_type = 'error' as gone from events),
    w as (select *, lag(moment) over x as at0, lag(size) over x as size0, lag(ctag) over x as ctag0 from o window x as (partition by item_id order by moment)),
    r as (select item_id, event_id, case when gone then 'deleted' when coalesce(size, 0) <= 0 then 'empty' when hash is null then 'no hash' when at0 is null then 'first look' when size0 <> size then 'size changed' when ctag0 is distinct from ctag then 'content changed' when moment - at0 < 60 then 'too soon' end as reason from w)
    select *, reason is null as ready from r""")
def upload_completeness(spark, d):
    df = table(spark, d, "events")
    t = F.expr("unix_micros(cast(ts as timestamp)) / 1000000")
    looks = df.select(F.col("user_id").alias("item_id"), "event_id", t.alias("moment"), F.floor("value").alias("size"), F.col("event_type").alias("ctag"), F.when(F.col("value") > 2, F.col("event_type")).alias("hash"), (F.col("event_type") == "error").alias("gone"))
    return L.upload_complete(looks).select("item_id", "event_id", "reason", "ready")


@R(f"with {ITEMS} select item_id, case state when 'DISCOVERED' then 0 when 'CLAIMED' then 1 when 'FETCHED' then 2 when 'TRANSCRIBED' then 3 when 'ANALYSED' then 4 when 'DONE' then 5 else -1 end as rank from items")
def state_ranks(spark, d):
    return items(spark, d).select("item_id", L.state_rank().alias("rank"))


@R(f"with {LOG} select item_id, arg_max(kind, (moment, id)) as kind, min(moment) as first_at, max(moment) as last_at, count(*) as seen_count from log group by item_id")
def latest_state_fold(spark, d):
    return L.latest_state(log(spark, d))


@R(f"""with {LOG}, o as (select item_id, id, moment, case when value > 20 then route_from end as hash, route_to as name from log)
    select item_id, arg_min(hash, (moment, id)) filter (hash is not null) as hash, arg_max(name, (moment, id)) filter (name is not null) as name, count(*) as seen_count from o group by item_id""")
def upsert_fold(spark, d):
    o = log(spark, d).select("item_id", "id", "moment", F.when(F.col("value") > 20, F.col("route_from")).alias("hash"), F.col("route_to").alias("name"))
    return L.upsert_fold(o, "item_id", ["moment", "id"], ["hash"], ["name"])


@R()
def state_transitions(spark, d):
    to = F.when(F.col("kind") == "discovered", "DISCOVERED").when(F.col("kind") == "claimed", "CLAIMED").when(F.col("kind") == "advanced", "DONE").when(F.col("kind") == "requeued", "DISCOVERED")
    return L.transitions(log(spark, d).select("item_id", "id", to.alias("to_state"), "kind"))


@R(f"with {LOG}, r as (select item_id, max(id) as reset_id from log where kind = 'requeued' group by 1) select item_id, count(*) as attempts from log left join r using (item_id) where kind = 'attempt-failed' and id > coalesce(reset_id, -1) group by 1")
def failed_attempts(spark, d):
    return L.attempts(log(spark, d))


@R(f"with {LOG}, {ITEMS} select log.*, items.route, items.state from log left join items using (item_id) where route_from <> route_to and moment >= '2024-01-15'")
def route_disagreements(spark, d):
    return L.disagreements(log(spark, d), items(spark, d), "2024-01-15")


@R(f"with {LOG}, a as (select item_id, max(id) as acted from log where kind = 'requeued' group by 1) select item_id, max(id) as dispute_id from log left join a using (item_id) where kind = 'attempt-failed' and id > coalesce(acted, 0) group by 1")
def newest_dispute_after_action(spark, d):
    return L.dispute_after_action(log(spark, d))


@R(f"""with {ITEMS}, {LOG}, seen as (select distinct l_orderkey as item_id from lineitem where l_quantity > 20), m as (select item_id, max(moment) as last_at, count(*) filter (kind = 'attempt-failed') as attempts from log group by 1)
    select i.item_id, i.route, case when s.item_id is null then 'vanished' when coalesce(last_at, discovered_at) >= '2000-01-01' then 'left alone' when coalesce(attempts, 0) >= 15 then 'quarantine' else 'requeue' end as disposition
    from items i left join seen s using (item_id) left join m using (item_id) where {OPEN}""")
def nightly_reconcile(spark, d):
    moved = log(spark, d).groupBy("item_id").agg(F.max("moment").alias("last_at"), F.count_if(F.col("kind") == "attempt-failed").alias("attempts"))
    seen = table(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("item_id"))
    return L.reconcile(items(spark, d), seen, moved, "2002-01-01", "2000-01-01", 15)


@R(f"""with {ITEMS}, o as (select distinct l_orderkey as item_id, ['actions', 'summary', 'transcript'][l_linenumber % 3 + 1] as kind from lineitem), k as (select unnest(['transcript', 'summary', 'actions']) as kind, unnest([1, 2, 3]) as p),
    m as (select i.item_id, k.kind, k.p from items i cross join k left join o on o.item_id = i.item_id and o.kind = k.kind where i.state = 'DONE' and o.item_id is null)
    select item_id, string_agg(kind, ',' order by p) as missing from m group by 1""")
def missing_outputs(spark, d):
    kind = F.element_at(F.array(F.lit("actions"), F.lit("summary"), F.lit("transcript")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    have = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), kind.alias("kind"))
    return L.missing_outputs(items(spark, d), have, ["transcript", "summary", "actions"])


@R(f"""with {ITEMS}, w as (select route, count(*) as waiting from items where {OPEN} group by 1) select route, waiting, case when route in ('5-LOW', '1-URGENT') then 'paused' else 'unwatched' end as kind from w where route not in ('1-URGENT', '2-HIGH')""")
def unswept_routes(spark, d):
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "route string")
    return L.unswept_routes(items(spark, d), names("1-URGENT", "2-HIGH"), names("5-LOW", "1-URGENT"))


@R(f"with {HOLDS} select hold_id, item_id, held_at, answered_at from holds where decision = 'RELEASED' and hold_id not in (select hold_id from holds where n % 3 = 0)")
def outstanding_releases(spark, d):
    h = holds(spark, d)
    return L.outstanding_releases(h, h.where("n % 3 = 0")).select("hold_id", "item_id", "held_at", "answered_at")


@R(f"with {ITEMS} select left(name, 22) as name, count(*) as n, min(item_id) as first_item from items group by 1 having count(*) > 1")
def output_name_owners(spark, d):
    """Names cut at the day: how many items of one party and day there are."""
    return L.name_owners(items(spark, d).withColumn("name", F.substring("name", 1, 22)))


def routes_of(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.col("c_name").alias("route"), F.concat(F.lit("in"), k % 211).alias("source"), F.when(k % 13 == 0, F.concat(F.lit("in"), (k + 5) % 211)).otherwise(F.concat(F.lit("out"), k % 97)).alias("output"))


ROUTES = "routes as (select c_name as route, 'in' || (c_custkey % 211) as source, case when c_custkey % 13 = 0 then 'in' || ((c_custkey + 5) % 211) else 'out' || (c_custkey % 97) end as output from customer)"


@R(f"with {ROUTES} select output, string_agg(distinct route, ',' order by route) as routes, count(distinct route) as n from routes group by 1 having count(distinct route) > 1")
def pooled_outputs(spark, d):
    return L.pooled_outputs(routes_of(spark, d))


@R(f"with {ROUTES} select a.route as writer, b.route as reader, a.output from routes a join routes b on a.output = b.source")
def route_loops(spark, d):
    return L.route_loops(routes_of(spark, d))


@R(f"""with {ROUTES}, anc as (select distinct 'in' || (c_custkey % 211) as folder, 'in' || ((c_custkey % 211) // 2) as ancestor from customer where c_custkey % 211 > 1)
    select i.route as inner_route, o.route as outer_route from routes i join anc on i.source = anc.folder join routes o on o.source = anc.ancestor where i.route <> o.route""")
def nested_folders(spark, d):
    k = F.col("c_custkey") % 211
    up = table(spark, d, "customer").where("c_custkey % 211 > 1").select(F.concat(F.lit("in"), k).alias("folder"), F.concat(F.lit("in"), F.floor(k / 2)).alias("ancestor")).distinct()
    return L.nested_folders(routes_of(spark, d), up)


@R("""with recursive e as (select c_custkey as folder, c_custkey // 3 as parent from customer where c_custkey > 0), w as (select folder, parent as ancestor, 1 as depth from e union all select w.folder, e.parent, w.depth + 1 from w join e on w.ancestor = e.folder where w.depth < 32)
    select folder, ancestor, depth from w""")
def folder_ancestors(spark, d):
    from siltstone.sources.feed import ancestors

    folders = table(spark, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("folder"), F.floor(F.col("c_custkey") / 3).alias("parent"))
    return ancestors(folders)


@R(f"with {ITEMS} select route, arg_min(item_id, (discovered_at, item_id)) as item_id, min(discovered_at) as oldest, count(*) as queued, count(*) filter (state <> 'DISCOVERED') as started from items where {OPEN} group by 1")
def oldest_unfinished_per_route(spark, d):
    return L.oldest_unfinished(items(spark, d))


@R(f"with {LOG} select item_id, max(moment) as last_at from log where kind = 'advanced' group by 1")
def last_advanced(spark, d):
    return L.last_advanced(log(spark, d))


@R(f"with {LOG} select route, count(*) as n from (select unnest([route_from, route_to]) as route from log where route_from <> route_to) group by 1")
def explode_route_disagreements(spark, d):
    return L.disagreement_counts(log(spark, d))


@R("""with p as (select p_partkey as model, cast(cast(p_retailprice as decimal(18, 2)) as decimal(18, 4)) as price from part where p_partkey % 11 <> 3), c as (select l_partkey as model, cast(l_quantity as bigint) as tokens, strftime(l_shipdate, '%Y-%m') as month from lineitem)
    select month, count(*) as calls, cast(sum(tokens) as bigint) as tokens, cast(sum(tokens * price) as double) as cost, count(*) filter (price is null) as unpriced_calls, count(distinct case when price is null then c.model end) as unpriced_models from c left join p using (model) group by 1""")
def spend_left_join_unpriced(spark, d):
    prices = table(spark, d, "part").where("p_partkey % 11 <> 3").select(F.col("p_partkey").alias("model"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    calls = table(spark, d, "lineitem").select(F.col("l_partkey").alias("model"), F.col("l_quantity").cast("long").alias("tokens"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return L.spend(calls, prices, ["month"]).withColumn("cost", F.col("cost").cast("double"))


@R(f"""with {HOLDS} select reviewer, site, category, decision, count(*) as n, count(distinct item_id) as recordings, min(held_at) as oldest, cast(grouping(reviewer, site, category, decision) as int) as level
    from holds group by grouping sets ((reviewer), (site), (category), (decision), ())""")
def overview_grouping_sets(spark, d):
    return L.overview(holds(spark, d))


@R(f"""with {HOLDS} select left(held_at, 10) as day, count(*) as held, count(*) filter (decision = 'RELEASED') as released, count(*) filter (decision = 'REFUSED') as refused, count(*) filter (decision = 'PENDING') as pending, count(distinct item_id) as recordings from holds group by 1""")
def day_prefix_distinct(spark, d):
    return L.decisions_by_day(holds(spark, d))


PASSES = "passes as (select o_orderkey as item_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as moment, cast(floor(o_totalprice) as bigint) as chars from orders)"


@R(f"""with {HOLDS}, {PASSES}, r as (select count(*) as read, sum(chars) as chars, count(distinct left(moment, 10)) as days from passes), t as (select count(distinct item_id) as touched, count(*) as spans, sum(end_offset - start_offset) as held_chars from holds)
    select read, touched, spans, round(touched / read, 4) as touched_share, round(spans / days, 2) as spans_per_day, round(cast(held_chars as double) / chars, 6) as text_share, case when days < 5 then 'too few days' when read < 50 then 'too few recordings' else 'enough to judge' end as readiness from r, t""")
def gate_measurement(spark, d):
    passes = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("moment"), F.floor("o_totalprice").cast("long").alias("chars"))
    return L.measurement(holds(spark, d), passes)


@R(f"with {HOLDS} select item_id, string_agg(hold_id, ',' order by start_offset, hold_id) as refs, count(*) as n from holds where decision = 'PENDING' group by 1")
def grouped_queue(spark, d):
    return L.grouped_queue(holds(spark, d))


@R(f"with {HOLDS} select site, count(*) as n, count(distinct item_id) as recordings, max(greatest(0, date_diff('day', cast(left(held_at, 10) as date), date '2002-01-01'))) as oldest_days from holds where decision = 'PENDING' and mode = 'on' group by 1")
def held_sites(spark, d):
    return L.held_sites(holds(spark, d), "2002-01-01").withColumn("oldest_days", F.col("oldest_days").cast("long"))


@R(f"""with {ITEMS}, q as (select left(discovered_at, 10) as day, count(*) as queued from items where {OPEN} group by 1 order by 1 desc limit 14), w as (select *, lag(queued, 1) over (order by day) as a, lag(queued, 2) over (order by day) as b from q)
    select day, queued, coalesce(queued > a, false) as growing, coalesce(queued > a and a > b, false) as growing_three_days from w""")
def growing_three_days(spark, d):
    return L.queue_depth(items(spark, d))


@R(f"with {ITEMS}, x as (select route, state = 'QUARANTINED' or discovered_at is null or discovered_at < '{CUT}' as s from items where state not in ('DONE', 'SKIPPED_EMPTY', 'ERASED')) select route, count(*) filter (s) as stopped, count(*) filter (not s) as queued from x group by 1")
def stopped_or_queued(spark, d):
    return L.stopped_or_queued(items(spark, d), CUT)


@R(f"""with {ITEMS}, h as (select route, count(*) as n, count(*) filter ({OPEN}) as open from items group by 1), c as (select unnest(['1-URGENT', 'quiet']) as route)
    select coalesce(c.route, h.route) as route, c.route is not null as configured, coalesce(n, 0) as n, coalesce(open, 0) as open from c full join h on c.route = h.route""")
def route_digest(spark, d):
    return L.route_digest(spark.createDataFrame([("1-URGENT",), ("quiet",)], "route string"), items(spark, d))


@R(f"""with {ITEMS}, q as (select *, row_number() over (partition by route order by discovered_at, item_id) as rn from items where {ACTIVE}), i as (select route, row_number() over (order by route) - 1 as i, count(*) over () as n from (select distinct route from q))
    select q.* exclude (rn) from q join i using (route) order by (rn - 1) // 3, (i.i - 2 % n + n) % n, rn limit 50""")
def fair_interleave(spark, d):
    from siltstone.sources.adapter import ACTIVE as STATES

    return L.interleave(items(spark, d).where(F.col("state").isin(*STATES)), 50, 3, 2)


@R(f"with {LOG} select * from log order by id desc limit 25")
def recent_events(spark, d):
    return log(spark, d).orderBy(F.col("id").desc()).limit(25)


@R(f"with {LOG} select * from log where item_id = 7")
def item_history(spark, d):
    return log(spark, d).where("item_id = 7")


@R("select 'out' || (c_custkey % 97) as folder from customer union select 'in' || (c_custkey % 211) from customer")
def output_folders_union(spark, d):
    df = table(spark, d, "customer")
    return df.select(F.concat(F.lit("out"), F.col("c_custkey") % 97).alias("folder")).union(df.select(F.concat(F.lit("in"), F.col("c_custkey") % 211))).distinct()


@R("""select strftime(o_orderdate, '%Y-%m') as month, round(sum(cast(o_totalprice as decimal(18, 2)))::double / max(day(o_orderdate)) * 30, 2) as projected from orders group by 1""")
def projected_month(spark, d):
    g = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"), F.max(F.dayofmonth("o_orderdate")).alias("days"))
    return g.select("month", F.round(L.projected_month(F.col("s").cast("double"), F.col("days")), 2).alias("projected"))


@R("select event_id, cast(json_extract(props, '$.k') as int) as k, cast(json_extract(props, '$.k') as int) > 50 as late from events")
def json_meta_field(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k"), (k > 50).alias("late"))


@R("select count(distinct user_id) as items, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as attention, count(*) filter (value > 50) as large, min(strftime(ts, '%Y-%m-%d')) as day from events")
def attention_totals(spark, d):
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("items"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("attention"), F.count_if(F.col("value") > 50).alias("large"), F.min(F.date_format("ts", "yyyy-MM-dd")).alias("day"))
