"""Personal data: keyed Feistel pseudonyms that keep the format, by DataFrame functions only.

Numbers and dates are first validated, then taken as a pair (a, b) of residues and permuted by
rounds that add a keyed digest of one to the other. That is a bijection on the format's own
values, so equal values have equal pseudonyms in all documents and different ones stay
different. Cards keep their length and get a new check digit; telephone numbers keep their
country code; dates stay dates of 1800 to 2199. Addresses of mail and secrets are no numbers:
they become keyed digests, also equal for equal values.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let

ROUNDS = 8
KINDS = ("email", "phone", "card", "ip", "ssn", "date", "secret")

#: No number begins or ends inside another number or word.
_FROM, _TO = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"
_IP = "\\d{1,3}(?:\\.\\d{1,3}){3}"
_PHONE = "\\+\\d{1,3} ?\\(\\d{2,4}\\) ?\\d{3,4}[ -]?\\d{3,4}|\\+\\d{1,3}(?:[ .-]\\d{2,4}){2,4}|\\+\\d{8,15}|\\(\\d{3}\\) ?\\d{3}-\\d{4}|\\d{3}-\\d{3}-\\d{4}"
_SSN = "\\d{3}-\\d{2}-\\d{4}"
_DATE = "\\d{4}-\\d{2}-\\d{2}|\\d{1,2}([./-])\\d{1,2}\\1\\d{4}"
_CARD = "\\d(?:[ -]?\\d){12,18}"
_EMAIL = "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]++@[\\p{L}\\p{N}-]++(?:\\.[\\p{L}\\p{N}-]++)+"
_SECRET = "(?i:(?<![\\p{L}\\p{N}])(?:token|secret|password|passwd|api[_-]?key)[\"']?\\s{0,3}[:=]\\s{0,3}[\"']?)[A-Za-z0-9+/_-]{12,}+"
#: A run of digit groups in which cards are looked for; it ends where a value of another kind begins.
_OTHER = f"(?:{_IP})(?!\\.?\\d){_TO}|\\d{{3}}-\\d{{3}}-\\d{{4}}{_TO}|(?:{_SSN}|\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{1,2}}(?:\\.\\d{{1,2}}\\.|/\\d{{1,2}}/|-\\d{{1,2}}-)\\d{{4}})(?!-?\\d){_TO}|[\\p{{L}}\\p{{N}}._%+-]++@"
_NEXT = f"[ -](?!{_OTHER})"
_RUN = f"(?=\\d(?:(?:{_NEXT})?\\d){{12}})\\d++{_TO}(?:{_NEXT}\\d++{_TO})*+"
#: A quick test that spares most texts and places the alternatives.
PATTERN = f"(?:{_EMAIL})|(?<!\\d\\.){_FROM}(?:{_IP})(?!\\.?\\d){_TO}|(?<![\\p{{L}}\\p{{N}}_+])(?:{_PHONE}){_TO}|{_FROM}(?:{_SSN}|{_DATE})(?!-?\\d){_TO}|{_FROM}(?:{_RUN}|{_CARD}){_TO}|{_SECRET}"


def _residue(text: Column) -> Column:
    """48 bits of a digest as a whole number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def permuted(a: Column, size_a: Column, b: Column, size_b: Column, key: str, kind: str) -> Column:
    """The pair (a, b) of residues, permuted; a struct of both."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    part = lambda i, x: _residue(F.concat_ws("|", F.lit(key), F.lit(kind), size_a.cast("string"), size_b.cast("string"), i.cast("string"), x.cast("string")))
    step = lambda s, i: F.when(i % 2 == 0, F.struct(F.pmod(s["a"] + part(i, s["b"]), size_a.cast("long")).alias("a"), s["b"].alias("b"))).otherwise(
        F.struct(s["a"].alias("a"), F.pmod(s["b"] + part(i, s["a"]), size_b.cast("long")).alias("b")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _number(digits: Column) -> Column:
    return F.coalesce(F.when(digits != "", digits), F.lit("0")).cast("long")


def _padded(n: Column, width: Column) -> Column:
    s = n.cast("string")
    return F.concat(F.repeat(F.lit("0"), width - F.length(s)), s)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted among all of its length."""
    def halves(d: Column) -> Column:
        left = F.floor(F.length(d) / 2).cast("int")
        right = F.length(d) - left
        size = lambda n: F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")
        p = permuted(_number(F.substr(d, F.lit(1), left)), size(left), _number(F.substr(d, left + 1, right)), size(right), key, kind)
        return let(p, lambda x: F.concat(_padded(x["a"], left), _padded(x["b"], right)))

    return let(digits, halves)


def _luhn(digits: Column) -> Column:
    """Check sum of digits of which the last is the check digit; 0 for a valid number."""
    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


def _filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by the given ones, in order."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["t"], F.substr(digits, s["n"] + 1, F.lit(1))).alias("t"), (s["n"] + 1).alias("n"))).otherwise(
        F.struct(F.concat(s["t"], c).alias("t"), s["n"].alias("n")))
    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), step, lambda s: s["t"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _cards(groups: Column) -> Column:
    """Valid cards in a run of digit groups: ``a`` and ``b``, the first and last group, and the digits ``d``.

    Every stretch of whole groups with 13 to 19 digits is tested. Of those that overlap, a single
    group comes before several, then the longest, then the first.
    """
    digits = lambda i, j: F.array_join(F.slice(groups, i + 1, j - i + 1), "")
    stretch = lambda i, j: let(digits(i, j), lambda d: F.struct((i != j).alias("several"), (-F.length(d)).alias("short"), i.alias("a"), j.alias("b"), d.alias("d")))
    stretches = lambda g, i: F.transform(F.sequence(i, F.least(i + 18, F.size(groups) - 1)), lambda j: stretch(i, j))
    valid = F.filter(F.flatten(F.transform(groups, stretches)), lambda x: x["short"].between(-19, -13) & F.when(x["short"].between(-19, -13), _luhn(x["d"]) == 0))
    none = F.array().cast("array<struct<several:boolean,short:int,a:int,b:int,d:string>>")
    free = lambda taken, x: ~F.exists(taken, lambda y: (y["a"] <= x["b"]) & (x["a"] <= y["b"]))
    return F.aggregate(F.array_sort(valid), none, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))


def _card(hit: Column, key: str) -> Column:
    """How many cards a run of digit groups holds and the run with them replaced; what is beside them stays."""
    def new(d: Column) -> Column:
        body = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        with_check = lambda x: F.concat(x, F.pmod(10 - _luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))
        return let(body, with_check)

    def rewrite(groups: Column) -> Column:
        def filled(cards: Column) -> Column:
            own = lambda g, i: let(F.get(F.filter(cards, lambda x: (x["a"] <= i) & (i <= x["b"])), F.lit(0)), lambda x: F.when(x.isNull(), g).when(x["a"] == i, new(x["d"])).otherwise(F.lit("")))
            return F.when(F.size(cards) > 0, F.struct(F.size(cards).alias("n"), _filled(hit, F.array_join(F.transform(groups, own), "")).alias("text")))

        return let(_cards(groups), filled)

    return let(F.split(hit, "[ -]"), rewrite)


def _phone(hit: Column, key: str) -> Column:
    """The country code stays; the rest of 8 to 15 digits is permuted."""
    code = F.regexp_extract(hit, "^\\+\\d{1,3}(?=[ .(-])", 0)
    rest = F.substr(hit, F.length(code) + 1, F.length(hit))
    return F.when(F.length(_digits(hit)).between(8, 15), F.concat(code, _filled(rest, permuted_digits(_digits(rest), key, "phone"))))


def _ip(hit: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        n = lambda i: F.get(o, F.lit(i)).cast("int")
        p = permuted(n(0) * 256 + n(1), F.lit(65536), n(2) * 256 + n(3), F.lit(65536), key, "ip")
        low = lambda x: [F.floor(x / 256).cast("long").cast("string"), (x % 256).cast("string")]
        return F.when((n(0) < 256) & (n(1) < 256) & (n(2) < 256) & (n(3) < 256), let(p, lambda x: F.concat_ws(".", *low(x["a"]), *low(x["b"]))))

    return let(F.split(hit, "\\."), new)


def _ssn(hit: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    def new(d: Column) -> Column:
        area, group, serial = (F.substr(d, F.lit(at), F.lit(n)).cast("int") for at, n in ((1, 3), (4, 2), (6, 4)))
        a = area - F.when(area > 666, 2).otherwise(1)
        p = permuted(a, F.lit(898), (group - 1) * 9999 + serial - 1, F.lit(99 * 9999), key, "ssn")
        back = lambda x: F.concat_ws("-", _padded(x["a"] + F.when(x["a"] >= 665, 2).otherwise(1), F.lit(3)),
                                     _padded(F.floor(x["b"] / 9999).cast("long") + 1, F.lit(2)), _padded(x["b"] % 9999 + 1, F.lit(4)))
        return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), let(p, back))

    return let(_digits(hit), new)


def _date(hit: Column, key: str) -> Column:
    """A calendar's 400 years have 146,097 = 189 * 773 days; the same day in another notation stays the same day."""
    def new(f: Column) -> Column:
        n = lambda i: F.get(f, F.lit(i)).cast("int")
        iso, slash = F.length(F.get(f, F.lit(0))) == 4, hit.contains("/")
        # month first with slashes unless that is no date
        us = slash & (n(0) <= 12)
        y, m, d = F.when(iso, n(0)).otherwise(n(2)), F.when(iso | ~us, n(1)).otherwise(n(0)), F.when(iso, n(2)).when(us, n(1)).otherwise(n(0))
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        length = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        day = F.datediff(F.make_date(y, m, d), F.lit("1800-01-01").cast("date"))
        p = permuted(F.floor(day / 773), F.lit(189), day % 773, F.lit(773), key, "date")
        made = F.date_add(F.lit("1800-01-01").cast("date"), let(p, lambda x: (x["a"] * 773 + x["b"]).cast("int")))
        sep = F.regexp_extract(hit, "[./-]", 0)
        two = lambda x, i: F.when(F.length(F.get(f, F.lit(i))) == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))

        def shown(x: Column) -> Column:
            first, second = F.when(us, F.month(x)).otherwise(F.dayofmonth(x)), F.when(us, F.dayofmonth(x)).otherwise(F.month(x))
            return F.when(iso, F.date_format(x, "yyyy-MM-dd")).otherwise(F.concat(two(first, 0), sep, two(second, 1), sep, F.year(x).cast("string")))

        return F.when(y.between(1800, 2199) & m.between(1, 12) & (d >= 1) & (d <= length), let(made, shown))

    return let(F.split(hit, "[./-]"), new)


def _email(hit: Column, key: str) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(hit)), 256), 1, 16), F.lit("@pseudonym.invalid"))


def _secret(hit: Column, key: str) -> Column:
    value = F.regexp_extract(hit, "[A-Za-z0-9+/_-]{12,}$", 0)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256)
    long_ = F.repeat(digest, F.ceil(F.length(value) / 64).cast("int"))
    return F.concat(F.substr(hit, F.lit(1), F.length(hit) - F.length(value)), F.substr(long_, F.lit(1), F.length(value)))


def _replaced(hit: Column, key: str) -> Column:
    """Kind and pseudonym of a match and how many values it holds; a null kind where it isn't valid."""
    whole = lambda p: hit.rlike(f"^(?:{p})$")
    option = lambda kind, new: let(new, lambda x: F.when(x.isNotNull(), F.struct(F.lit(kind).alias("kind"), x.alias("text"), F.lit(1).alias("n"))))
    cards = let(_card(hit, key), lambda x: F.when(x.isNotNull(), F.struct(F.lit("card").alias("kind"), x["text"].alias("text"), x["n"].alias("n"))))
    none = F.lit(None).cast("struct<kind:string,text:string,n:int>")
    found = (F.when(hit.rlike("(?i)^(?:token|secret|pass|api)[^@]*[:=]"), option("secret", _secret(hit, key)))
             .when(hit.contains("@"), option("email", _email(hit, key))).when(whole(_IP), option("ip", _ip(hit, key)))
             .when(whole(_DATE), option("date", _date(hit, key))).when(whole(_SSN), option("ssn", _ssn(hit, key)))
             .when(whole(_PHONE), option("phone", _phone(hit, key))).otherwise(cards))
    return F.coalesce(found, F.struct(none["kind"].alias("kind"), hit.alias("text"), F.lit(0).alias("n")))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, ``n_<kind>`` counts and ``n_replaced``.

    No shuffle and no user function. Texts without a match, null and empty ones stay as they
    are with zero counts; repeated rows are treated each; columns named like the new ones are
    replaced. What doesn't pass its validation (check digit, octets, calendar) is left alone.
    """
    new = [*(f"n_{k}" for k in KINDS), "n_replaced"]
    keep = [c for c in docs.columns if c.lower() not in new]
    cut = F.struct(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("hits"), F.split("text", PATTERN, -1).alias("gaps"))

    def rewrite(c: Column) -> Column:
        def join(r: Column) -> Column:
            text = F.concat(F.array_join(F.transform(r, lambda x, i: F.concat(F.get(c["gaps"], i), x["text"])), ""), F.element_at(c["gaps"], -1))
            return F.struct(text.alias("text"), F.flatten(F.transform(r, lambda x: F.array_repeat(x["kind"], x["n"]))).alias("kinds"))

        return let(F.transform(c["hits"], lambda h: _replaced(h, key)), join)

    done = F.when(F.col("text").rlike(PATTERN), let(cut, rewrite)).otherwise(F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("kinds")))
    out = docs.select(F.struct(*keep).alias("_row"), done.alias("_d"))
    count = lambda kind: F.size(F.filter("_d.kinds", lambda x: x == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return out.select(*[(F.col("_d.text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in keep], *counts, F.size("_d.kinds").cast("long").alias("n_replaced"))
