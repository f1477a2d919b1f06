"""The queries of this folder and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import STOP_WORDS
from .shared import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    body = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir).select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    out = shard_rows(rows, shards=8, seed=1)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_quality_rules", r"""
    with t as (select doc_id, coalesce(text, '') as text from documents),
    w as (select doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
    m as (select doc_id, text, w, len(w) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
        cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines,
        len(list_filter(w, lambda x: list_contains(string_split('STOP', ' '), lower(x)))) as stops,
        length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as uppers, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters from w),
    g as (select doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g, i from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from m)),
    r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1),
    c as (select doc_id, count(distinct i + k) as n from r, range(3) x(k) group by 1),
    a as (select m.*, coalesce(c.n, 0) as n_repeat_words, n_words < 50 or 100 * coalesce(c.n, 0) > 50 * n_words as base_failed from m left join c using (doc_id))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and word_chars / n_words between 2 and 15 and n_symbols / n_words <= 0.3 and stops / n_words >= 0.02
        and coalesce(n_dup_lines / n_lines, 0) <= 0.5 and coalesce(uppers / nullif(letters, 0), 0) <= 0.5 as kept from a""".replace(
    "STOP", " ".join(STOP_WORDS)))
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(read(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encoded

    return encoded(read(spark, sf_dir).select("doc_id", "text"))


@query("op2_suffix_array")
def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_array import deduplicated

    return deduplicated(read(spark, sf_dir)).withColumnRenamed("n_tokens", "n_bytes")


@query("op8_suffix_tree")
def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import deduplicated

    return deduplicated(read(spark, sf_dir)).withColumnRenamed("n_tokens", "n_words")


@query("op1_minhash")
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir), words=2, percent=80).drop("row_key")


@query("op3_line_dedup", r"""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as s, unnest(range(len(string_split(text, chr(10))))) as line from documents),
    m as (select *, case when regexp_matches(s, '[0-9]') and trim(translate(regexp_replace(regexp_replace(s, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '<\*>', '', 'g'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) <> ''
        then regexp_replace(s, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') else s end as t from l),
    w as (select doc_id, line, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from m),
    t as (select doc_id, line, len(w) as n, w[1:2] as path, unnest(range(len(w))) as place, unnest(w) as tok from w where len(w) > 0),
    c as (select n, path, place, tok, count(*) as c from t where not regexp_matches(tok, '[0-9]') and tok <> '<*>' group by all having count(*) >= 10),
    x as (select doc_id, line, n, path, place, tok, c from t join c using (n, path, place, tok)),
    v as (select v.doc_id, v.line, n, path, list({'p': place, 't': tok} order by place) as fixed
        from (select distinct doc_id, line, c as least from x) v join x on x.doc_id = v.doc_id and x.line = v.line and x.c >= least
        group by v.doc_id, v.line, n, path, least having 2 * count(*) >= n),
    f as (select doc_id, line, 'own ' || array_to_string(w, ' ') as form from w where len(w) > 0
        union all select doc_id, line, n || ' ' || array_to_string(path, ' ') || ' ' || cast(fixed as varchar) from v),
    o as (select form, min(struct_pack(d := doc_id, l := line)) as first from f group by form having count(distinct doc_id) >= 10),
    g as (select distinct f.doc_id, line from f join o using (form) where struct_pack(d := doc_id, l := line) <> first),
    k as (select l.doc_id, count(*) as n_lines, count(g.line) as n_dropped, coalesce(string_agg(l.s, chr(10) order by l.line) filter (g.line is null), '') as kept
        from l left join g on g.doc_id = l.doc_id and g.line = l.line group by l.doc_id)
    select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from k""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import without_recurring_lines

    out = without_recurring_lines(read(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op4_decontamination", r"""
    with w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
    b as (select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
    dg as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w)),
    bg as (select item_id, array_to_string(w[i:i + 4], ' ') as g, len(w) - 4 as n from (select item_id, w, unnest(range(1, len(w) - 3)) as i from b)),
    bc as (select item_id, g, n, count(*) as c from bg group by all),
    h as (select doc_id, item_id, n, g, c, i from dg join bc using (g)),
    s as (select doc_id, item_id, n, g, c, unnest(range(greatest(1, i - n + 1), i + 1)) as start from h),
    a as (select doc_id, item_id, n, start, g, least(count(*), any_value(c)) as k from s group by doc_id, item_id, n, start, g),
    m as (select doc_id, item_id from a join w using (doc_id) where start + n - 1 <= len(w) - 4 or (start = 1 and len(w) - 4 < n)
        group by doc_id, item_id, n, start having 5 * sum(k) >= 4 * (least(n, any_value(len(w)) - 4) + n - sum(k))),
    r as (select doc_id, count(distinct item_id) as n_items, min(item_id) as first_item from m group by 1)
    select d.doc_id, coalesce(n_items, 0) as n_items, first_item, n_items is not null as contaminated from documents d left join r using (doc_id)""")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contamination import checked

    return checked(read(spark, sf_dir), read(spark, sf_dir, "benchmark")).select("doc_id", "n_items", "first_item", "contaminated")


@query("op9_pseudonyms")
def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a secret of the user's; a fixed one serves the check."""
    from .pseudonyms import pseudonymised

    return pseudonymised(read(spark, sf_dir).select("doc_id", "text"), key="check")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fitted, scored

    docs = read(spark, sf_dir)
    return scored(docs.select("doc_id", "text"), fitted(docs, read(spark, sf_dir, "labels")))


@query("op12_search", r"""
    with t as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
    b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark),
    q as (select item_id, term, count(*) as q from (select item_id, unnest(w) as term from b) group by all),
    c as (select count(*) as docs, sum(len(w))::bigint as length from t where len(w) > 0),
    p as (select doc_id, n, term, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as term from t) where term in (select term from q) group by all),
    d as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, c group by term),
    s as (select item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::bigint as score
        from q join p using (term) join d using (term), c group by item_id, doc_id),
    r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0)
    select * from r where rank <= 10""")
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import ranked

    return ranked(read(spark, sf_dir), read(spark, sf_dir, "benchmark"), k=10)


def _license_sql() -> str:
    """Phrases by place and templates by window, without order, prefix or index."""
    from .licenses import ENOUGH, LEAST_CLASS, PHRASES, TEMPLATES

    quoted = [", ".join("('" + label + "', '" + text.replace("'", "''") + "')" for label, text in rows) for rows in ([(y, x) for x, y in PHRASES], TEMPLATES)]
    cut = ("regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    return f"""
    with d as (select doc_id, coalesce({cut.format('text')}, []) as w from documents),
    p as (select label, {cut.format('t')} as p from (values {quoted[0]}) v(label, t)),
    b as (select doc_id, label, x - 1 as spot from (select doc_id, w, label, p, unnest(range(1, len(w) - len(p) + 2)) as x from d, p) where w[x:x + len(p) - 1] = p),
    bs as (select doc_id, count(*) as n_base, min(spot) as first_word, max(spot) as last_word, list_sort(list(distinct label)) as base from b group by 1),
    t as (select row_number() over () as t, label, list_distinct({cut.format('t')}) as p, greatest({LEAST_CLASS},
        cast(pow(2, ceil(log2(len({cut.format('t')})))) as bigint)) as size from (values {quoted[1]}) v(label, t)),
    tw as (select t, size, unnest(p) as word from t),
    i as (select doc_id, unnest(w) as word, unnest(range(len(w))) as x from d),
    h as (select distinct doc_id, t, x // size - k as block, word from i join tw using (word), range(2) r(k) where x // size >= k),
    m as (select doc_id, t, block, count(*) as held from h group by all),
    e as (select doc_id, m.t, label, size, block, p, held / len(p) as containment from m join t using (t) where {ENOUGH[1]} * held >= {ENOUGH[0]} * len(p)),
    s as (select e.* from e where not exists (select 1 from e f where f.doc_id = e.doc_id and f.size = e.size and f.block = e.block
        and len(f.p) > len(e.p) and list_has_all(f.p, e.p))),
    ms as (select doc_id, list(distinct label) as labels, max(containment) as best from s group by 1)
    select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') as base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ',') as labels,
        case when n_base > 0 then 1.0::double else coalesce(best, 0)::double end as score
    from d left join bs using (doc_id) left join ms using (doc_id)"""


@query("op11_licenses", _license_sql())
def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scanned

    return scanned(read(spark, sf_dir).select("doc_id", "text")).drop("spans")


@query("op13_spelling", r"""
    with recursive d as (select coalesce(cast(doc_id as varchar), '') as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\x{C0}-\x{FF}]+') as w from documents),
    r as (select id, run, count(*) as n from (select id, unnest(w) as run from d) group by all),
    c as (select list(list_reduce([x, 1, 1, 1, 1, 1, 1, 1, 1], lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end) order by x) as t
        from (select unnest(range(256)) as x)),
    b as (select id, run, n, list_transform(range(cast(length(hex(encode(id || ':' || run))) / 2 as bigint)),
        lambda k: cast('0x' || substr(hex(encode(id || ':' || run)), cast(2 * k + 1 as bigint), 2) as bigint)) as bytes from r),
    h as (select run, n, xor(list_reduce(list_concat([4294967295], bytes), lambda v, k: xor(v >> 8, t[xor(v & 255, k) + 1])), 4294967295) as h from b, c),
    m as (select case when h % 97 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) + 2 as bigint)) else run end as word, n from h),
    w as (select word, cast(sum(n) as bigint) as n from m where length(word) >= 5 group by 1 having sum(n) >= 3),
    x as (select word, n, length(word) as l, k, substr(word, 1, k - 1) || substr(word, k + 1) as cut from (select word, n, unnest(range(1, length(word) + 1)) as k from w)),
    p as (select a.word as a, a.n as an, b.word as b, b.n as bn from x a join x b on a.cut = b.cut and a.k = b.k and a.word <> b.word and a.l = b.l
        union select a.word, a.n, x.word, x.n from w a join x on x.cut = a.word union select x.word, x.n, a.word, a.n from w a join x on x.cut = a.word),
    f as (select a as word, count(*) as n_near, max(bn) as bn, min(struct_pack(n := -bn, w := b)).w as best from p group by 1),
    g as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when bn >= 2 * w.n then best end as form, case when bn >= 2 * w.n then bn end as form_n
        from w left join f using (word)),
    walk(word, root, step) as (select word, word, 0 from g union all select walk.word, g.form, step + 1 from walk join g on g.word = walk.root where g.form is not null),
    last as (select word, arg_max(root, step) as root from walk group by 1)
    select word, form, root, n, n_near, form_n from g join last using (word)""")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import grouped

    return grouped(read(spark, sf_dir))
