"""Sections by content over the note projection, and runs of event types per user."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.skew import absorbed, islands
from ..knowledge.lines import LINE_PATTERNS, OTHER
from ..functions import text as tx
from ..knowledge.blocks import BLOCK_FAMILIES
from ..operators import blocks as bk
from ..operators import lines as ln
from ..operators import markers as mk
from .projection import notes, table
from .registry import query
from .sections import CONTENT, MERGED
from .sqltext import q, strip

_ORDER = sorted(range(len(LINE_PATTERNS)), key=lambda x: (-LINE_PATTERNS[x][1], x))
_CASE = lambda value, other: "case " + " ".join(f"when regexp_matches(s, {q(LINE_PATTERNS[x][2])}) then {value(x)}" for x in _ORDER) + f" else {other} end"

#: Every line, classified lines, islands, absorption, merged islands with their text.
CLASSES = f"""
    al as (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as line from notes),
    ds as (select distinct {strip('l')} as s from al where {strip('l')} <> ''),
    dc as (select s, {_CASE(lambda x: q(LINE_PATTERNS[x][0]), q(OTHER))} as section, cast({_CASE(lambda x: LINE_PATTERNS[x][1], 0)} as double) as confidence from ds),
    cl as (select doc_id, line, s, section, confidence from al join dc on s = {strip('l')})"""
ISLANDS = f"""{CLASSES},
    ch as (select *, case when section = lag(section) over (partition by doc_id order by line) then 0 else 1 end as c from cl),
    nb as (select *, sum(c) over (partition by doc_id order by line) as k from ch),
    isl as (select doc_id, k, any_value(section) as section, min(line) as start_line, max(line) as end_line, avg(confidence) as confidence from nb group by doc_id, k)"""
INHERITED = f"""{ISLANDS},
    sd as (select *, section = '{OTHER}' and coalesce(lag(section) over w = lead(section) over w, false) as gone, lag(section) over w as prev from isl window w as (partition by doc_id order by k)),
    rl as (select *, case when gone then prev else section end as label from sd),
    rc as (select *, case when label = lag(label) over (partition by doc_id order by k) then 0 else 1 end as c from rl),
    rn as (select *, sum(c) over (partition by doc_id order by k) as g from rc),
    body as (select rn.doc_id, g, string_agg(l, chr(10) order by line) as text, arg_min(l, line) as first_line from rn join al on al.doc_id = rn.doc_id and line between start_line and end_line group by rn.doc_id, g),
    mi as (select doc_id, g, any_value(label) as section, min(start_line) as start_line, max(end_line) as end_line, max(confidence) filter (not gone) as confidence from rn group by doc_id, g)"""
BUILT = f"""{INHERITED},
    ct as (select mi.doc_id, g, section, {strip('b.text')} as text, greatest(strpos(n.text, {strip('first_line')}) - 1, 0) as start
        from mi join body b using (doc_id, g) join notes n using (doc_id) where section <> '{OTHER}'),
    cn as (select *, start + length(text) as fin, row_number() over (partition by doc_id, section order by g) as n from ct where length(text) >= 10),
    bf as (select doc_id, section, n, text, start, fin, g from cn where n = 1
        union all select f.doc_id, f.section, c.n, case when contains(f.text, c.text) then f.text else f.text || chr(10) || chr(10) || c.text end, f.start,
            case when contains(f.text, c.text) then f.fin else greatest(f.fin, c.fin) end, f.g
        from bf f join cn c on c.doc_id = f.doc_id and c.section = f.section and c.n = f.n + 1),
    sec as (select doc_id, section, max_by(text, n) as text, min(start) as start, max_by(fin, n) as fin, min(g) as g from bf group by doc_id, section)"""


@query("line_classifier", f"with {CLASSES} select doc_id, line, section, confidence from cl")
def line_classifier(spark, sf):
    return ln.line_classifier(notes(spark, sf)).select("doc_id", F.col("line").cast("bigint"), "section", "confidence")


@query("cluster_lines", f"with {ISLANDS} select doc_id, section, start_line, end_line, round(confidence, 6) as confidence from isl")
def cluster_lines(spark, sf):
    return ln.cluster_lines(notes(spark, sf)).select(
        "doc_id", "section", F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint"), F.round("confidence", 6).alias("confidence"))


@query("inherit_context", f"""
    with {INHERITED} select doc_id, section, start_line, end_line, round(confidence, 6) as confidence, text from mi join body using (doc_id, g)""")
def inherit_context(spark, sf):
    return ln.inherit_context(notes(spark, sf)).select(
        "doc_id", "section", F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint"), F.round("confidence", 6).alias("confidence"),
        F.array_join("lines", "\n").alias("text"))


@query("build_sections", f"""
    with recursive {BUILT}, oc as (select doc_id, round_even(least(list_reduce(list_prepend(0::double, list(confidence order by line) filter (section <> '{OTHER}')), lambda a, x: a + x) / count(*) filter (section <> '{OTHER}') * (0.5 + 0.5 * count(*) filter (section <> '{OTHER}') / count(*)), 1), 2) as confidence from cl group by 1)
    select doc_id, confidence, section, text, start as start_at, fin as end_at from sec join oc using (doc_id)""")
def build_sections(spark, sf):
    return ln.build_sections(notes(spark, sf)).select(
        "doc_id", "confidence", "section", "text", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"))


@query("enrich_sections", f"""
    with recursive {MERGED}, {BUILT},
    fs as (select doc_id, arg_min(key, ord) as key, section, arg_min(text, ord) as text, min(ord) as ord from (select doc_id, ord, section, key, {CONTENT} as text from sl)
        where text = 'N/A' or length(text) >= 10 group by doc_id, section),
    fp as (select fs.*, n.text as body, strpos(lower(n.text), lower(key)) as at1 from fs join notes n using (doc_id)),
    fe as (select *, strpos(substr(body, at1), chr(10)) as eol from fp),
    ft as (select doc_id, section, ord, length(text) as size, case when at1 = 0 then strpos(body, substr(text, 1, 60)) - 1 when eol > 0 then at1 + eol - 1 else at1 - 1 + length(key) end as b from fe),
    hs as (select doc_id, section, greatest(b, 0) as start, case when b >= 0 then b + size else 0 end as fin from ft),
    hl as (select doc_id, list(struct_pack(s := section, a := start, z := fin)) as have from hs group by doc_id),
    ex as (select *, row_number() over (partition by doc_id order by g) as n from sec),
    fo as (select n.doc_id, cast(0 as bigint) as n, coalesce(have, []) as have from (select distinct doc_id from ex) n left join hl using (doc_id)
        union all select fo.doc_id, ex.n, case when len(list_filter(have, lambda x: x.s = ex.section or (ex.start < x.z and ex.fin > x.a))) > 0 then have
            else list_append(have, struct_pack(s := ex.section, a := ex.start, z := ex.fin)) end from fo join ex on ex.doc_id = fo.doc_id and ex.n = fo.n + 1),
    fin as (select doc_id, arg_max(have, n) as have from fo group by doc_id)
    select doc_id, section, m.text, start as start_at, fin as end_at, 'header' as source from hs join merged m using (doc_id, section)
    union all select doc_id, section, text, start, fin, 'content' from ex join fin using (doc_id)
        where len(list_filter(have, lambda x: x.s = section and x.a = start and x.z = fin)) > 0 and not exists (select 1 from hs where hs.doc_id = ex.doc_id and hs.section = ex.section)""")
def enrich_sections(spark, sf):
    return ln.enrich_sections(notes(spark, sf)).select(
        "doc_id", "section", "text", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"), "source")


# --- the same over rows: runs of one event type per user --------------------------------
EVENT_RUNS = """
    ec as (select *, case when event_type = lag(event_type) over w then 0 else 1 end as c from events window w as (partition by user_id order by ts, event_id)),
    ek as (select *, sum(c) over (partition by user_id order by ts, event_id) - 1 as k from ec),
    er as (select user_id, k, any_value(event_type) as event_type, count(*) as n, min(event_id) as first_event, max(event_id) as last_event from ek group by user_id, k)"""


def runs_of_events(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    numbered = islands(events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type", "k")
    return numbered.groupBy("user_id", "k").agg(
        F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("event_runs", f"with {EVENT_RUNS} select user_id, cast(k as bigint) as k, event_type, n, first_event, last_event from er")
def event_runs(spark, sf):
    return runs_of_events(spark, sf)


@query("event_runs_absorbed", f"""
    with {EVENT_RUNS},
    sd as (select *, event_type = 'error' and coalesce(lag(event_type) over w = lead(event_type) over w, false) as gone, lag(event_type) over w as prev from er window w as (partition by user_id order by k)),
    rl as (select *, case when gone then prev else event_type end as label from sd),
    rc as (select *, case when label = lag(label) over (partition by user_id order by k) then 0 else 1 end as c from rl),
    rn as (select *, sum(c) over (partition by user_id order by k) - 1 as run from rc)
    select user_id, cast(run as bigint) as run, any_value(label) as event_type, cast(sum(n) as bigint) as n, cast(sum(case when gone then n else 0 end) as bigint) as n_absorbed, min(first_event) as first_event, max(last_event) as last_event
    from rn group by user_id, run""")
def event_runs_absorbed(spark, sf):
    """Errors between two runs of one type count as part of them."""
    rows = absorbed(runs_of_events(spark, sf), ["user_id"], "event_type", "error", "k")
    return rows.groupBy("user_id", F.col("_run").alias("run")).agg(
        F.first("event_type").alias("event_type"), F.sum("n").alias("n"), F.sum(F.when(F.col("_absorbed"), F.col("n")).otherwise(0)).alias("n_absorbed"),
        F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"))


# --- blocks of a family, headers found again ---------------------------------------------
def _family(name: str, gap: int, least: int, pattern: str) -> str:
    return f"select doc_id, '{name}' as section, {gap} as gap, {least} as least, line from al where regexp_matches(l, {q(pattern)})"


BLOCKS = f"""
    al as (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as line from notes),
    fh as ({' union all '.join(_family(*f) for f in BLOCK_FAMILIES)}),
    fc as (select *, case when line - lag(line) over (partition by doc_id, section order by line) <= gap then 0 else 1 end as c from fh),
    fk as (select *, sum(c) over (partition by doc_id, section order by line) as k from fc),
    bl as (select doc_id, section, k, count(*) as line_count, min(line) as start_line, max(line) as end_line from fk group by doc_id, section, k having count(*) >= any_value(least)),
    br as (select *, row_number() over (partition by doc_id, section order by line_count desc, start_line) as rn from bl),
    off as (select doc_id, line, sum(length(l) + 1) over (partition by doc_id order by line) - length(l) - 1 as position from al)"""


@query("content_blocks", f"""
    with {BLOCKS}
    select br.doc_id, cast(position as bigint) as position, section, line_count, start_line, end_line,
        round_even(least(0.50::double + line_count / (end_line - start_line + 1) * 0.30::double + line_count * 0.03::double, 0.88::double), 3) as confidence
    from br join off on off.doc_id = br.doc_id and off.line = start_line where rn = 1""")
def content_blocks(spark, sf):
    long = lambda c: F.col(c).cast("bigint")
    return bk.content_blocks(notes(spark, sf)).select(
        "doc_id", long("position"), "section", long("line_count"), long("start_line"), long("end_line"), "confidence")


# seconds that may pass inside one burst, by type of event, and least events of a burst
BURST_GAPS, BURST_LEAST = {"view": 86400, "click": 129600, "error": 259200}, 2
_GAP = "case event_type " + " ".join(f"when '{k}' then {v}" for k, v in BURST_GAPS.items()) + " else 172800 end"


@query("event_bursts", f"""
    with ec as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w <= cast({_GAP} as bigint) * 1000000 then 0 else 1 end as c from events window w as (partition by user_id, event_type order by ts, event_id)),
    ek as (select *, sum(c) over (partition by user_id, event_type order by ts, event_id) as k from ec),
    er as (select user_id, event_type, count(*) as n, min(event_id) as first_event, max(event_id) as last_event, min(epoch_us(ts)) as t from ek group by user_id, event_type, k having count(*) >= {BURST_LEAST}),
    rn as (select *, row_number() over (partition by user_id, event_type order by n desc, t, first_event) as r from er)
    select user_id, event_type, n, first_event, last_event from rn where r = 1""")
def event_bursts(spark, sf):
    """The longest burst of each type of event per user; each type has its own longest pause."""
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    events = events.withColumn("mark", F.struct("t", F.expr(f"cast({_GAP} as bigint) * 1000000").alias("gap")))
    numbered = islands(events, ["user_id", "event_type"], [F.col("t"), F.col("event_id")], "mark", "k", lambda a, b: b["t"] - a["t"] <= b["gap"])
    bursts = numbered.groupBy("user_id", "event_type", "k").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.min("t").alias("t")).where(F.col("n") >= BURST_LEAST)
    best = F.min(F.struct((-F.col("n")).alias("n"), "t", "first_event", "last_event")).alias("b")
    return bursts.groupBy("user_id", "event_type").agg(best).select("user_id", "event_type", (-F.col("b.n")).alias("n"), "b.first_event", "b.last_event")


TITLES = ["Chief Complaint", "History of  Present Illness", "Past Medical History", "Current Medications", "Social History", "[Assessment and Plan]", "Follow up"]


@query("locate_headers")
def locate_headers(spark, sf):
    """Usual titles found in the notes, in order; fuzzy scores are checked in ``tests/test_blocks.py``."""
    return bk.locate_headers(notes(spark, sf).withColumn("headers", tx.literal_array(TITLES)))


@query("marker_merge")
def marker_merge(spark, sf):
    """Section markers of the notes; spacing and insertion are checked in ``tests/test_markers.py``."""
    from ..functions.arrays import explode_rows

    docs = mk.with_markers(notes(spark, sf)).withColumn("marked_sha256", F.sha2("marked", 256))
    return explode_rows(docs, F.col("markers"), "doc_id", "marked_sha256")
