"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

Candidates are found by pattern and validated (Luhn check digit, octets below 256, real calendar dates, ISO 13616
check digits). A valid value is permuted by a keyed Feistel network within its own format: the same digits, length,
separators and validity, so equal values get equal pseudonyms in every document and distinct values stay distinct,
and whoever has the key can undo it (``inverse=True``). What fails validation is left as it is and hides nothing: the
text goes on to the later kinds, and within a kind every place where a value may begin is tried.

Kinds, in the order in which they claim text:
  email   local part: each letter and digit moved within its class (case and punctuation kept), one half keyed by the other
  iban    the digits after the country code and check digits (of more than 18 the last 18), letters stay; check digits recomputed
  date    YYYY-MM-DD, DD.MM.YYYY or DD/MM/YYYY from 1900 to 2099: permuted among those days
  ssn     NNN-NN-NNNN with valid groups: permuted among the valid numbers
  card    13 to 19 digits with a valid Luhn digit: all but the first and the last permuted, the last recomputed. Whole
          groups of digits joined by single spaces or hyphens, at least three digits a group on average (so that
          tables of small numbers stay); of a run of groups the leftmost, then shortest valid stretch
  ip      four octets: permuted as a number below 2**32
  phone   + and 8 to 15 digits with up to two separators between: all digits after the first two permuted

The network alternates over two halves with the first digits of SHA-256(key, kind, length, round, other half) as round
function; values outside the format are walked through the network again until they fall inside (cycle walking).

Undoing is exact for values. In a text it needs the same stretches to be found again, which groups of digits directly
before a card can prevent, as a stretch that begins with them may have a valid Luhn digit by chance.

Edge cases: a null text stays null and counts 0; texts without a candidate pass through untouched; repeated rows and
other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
# Characters of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_pattern() -> str:
    """Countries of one length together, then as many letters and digits as that length asks."""
    sizes = sorted(set(IBAN_LENGTHS.values()))
    parts = [f"(?:{'|'.join(c for c, n in IBAN_LENGTHS.items() if n == size)})[0-9]{{2}}(?: ?[A-Z0-9]){{{size - 4}}}" for size in sizes]
    return f"(?<![A-Za-z0-9])(?:{'|'.join(parts)})(?![A-Za-z0-9])"


# The pattern of each kind; of a card, where one may begin.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}",  # a domain has 127 labels at most, and an open group would recurse label by label
    "iban": _iban_pattern(),
    "card": r"(?<![0-9])(?<![0-9]\.)(?<!\+)(?=[0-9](?:[ -]?[0-9]){12})",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[/.-][0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9](?:[ ().-]{0,2}[0-9]){7,14}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
CARD_DIGITS = range(13, 20)
CARD_REACH = 20  # pieces that a card can span: each but the last has a digit and a separator
DATE_FROM, DATE_DAYS = "1900-01-01", 73049


def _round(key: str, kind: str, width: Column, i: Column, half: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), width.cast("string"), i.cast("string"), half.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), modulus)


def _network(x: Column, left: Column, right: Column, width: Column, key: str, kind: str, inverse: bool) -> Column:
    """Permutation of [0, left * right): x = a * right + b; even rounds add to a, odd rounds to b, each modulo its size."""
    sign = -1 if inverse else 1

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        a = F.when(even, F.pmod(s["a"] + sign * _round(key, kind, width, i, s["b"], left), left)).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + sign * _round(key, kind, width, i, s["a"], right), right))
        return F.struct(a.alias("a"), b.alias("b"))

    begin = F.struct(F.floor(x / right).cast("bigint").alias("a"), F.pmod(x, right).alias("b"))
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, begin, step, lambda s: s["a"] * right + s["b"])


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _power10(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("bigint")


def _digits(d: Column, key: str, kind: str, inverse: bool) -> Column:
    """Permutation of the strings of as many digits; halves of at most 9 digits stay within 64 bits."""
    n = F.length(d)
    m = (n / 2).cast("int")
    sign = -1 if inverse else 1

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        left, right = _power10(m), _power10(n - m)
        a = F.when(even, F.pmod(s["a"] + sign * _round(key, kind, n, i, s["b"], left), left)).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + sign * _round(key, kind, n, i, s["a"], right), right))
        return F.struct(a.alias("a"), b.alias("b"))

    zero = F.lit("0")
    begin = F.struct(F.concat(zero, F.substring(d, F.lit(1), m)).cast("bigint").alias("a"), F.concat(zero, F.substring(d, m + 1, n)).cast("bigint").alias("b"))
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    out = F.aggregate(rounds, begin, step, lambda s: F.concat(F.lpad(s["a"].cast("string"), m, "0"), F.lpad(s["b"].cast("string"), n - m, "0")))
    return F.when(n < 2, F.when(n == 1, F.pmod(d.cast("bigint") + sign * _round(key, kind, n, F.lit(0), F.lit("x"), F.lit(10)), F.lit(10)).cast("string")).otherwise(d)).otherwise(out)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn_sum(d: Column, from_right: int) -> Column:
    """Luhn sum of a digit string whose last digit is at place ``from_right`` from the right."""
    place = F.sequence(F.lit(1), F.length(d))
    value = F.transform(place, lambda i: F.when(F.pmod(F.length(d) - i + from_right, F.lit(2)) == 0, 1).otherwise(2) * F.substring(d, i, F.lit(1)).cast("int"))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""
    state = F.aggregate(
        _chars(shape), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")),
        lambda s, c: F.struct(F.concat(s["out"], F.when(c.rlike("^[0-9]$"), F.substring(digits, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["i"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("i")),
        lambda s: s["out"],
    )
    return state


def _bare(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _is_card(m: Column) -> Column:
    def ok(d: Column) -> Column:
        groups = F.length(m) - F.length(d) + 1
        return (F.length(d) >= 3 * groups) & ~d.rlike("^0*$") & (F.pmod(_luhn_sum(d, 0), F.lit(10)) == 0)

    return _let(_bare(m), ok)


def _card(m: Column, key: str, inverse: bool) -> Column:
    """The pseudonym of a valid card."""
    def of(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card", inverse))
        closed = _let(body, lambda x: F.concat(x, F.pmod(-_luhn_sum(x, 1), F.lit(10)).cast("string")))
        return _let(closed, lambda x: _refill(m, x))

    return _let(_bare(m), of)


def _ip(m: Column, key: str, inverse: bool) -> Column:
    def of(octet: Column) -> Column:
        x = F.aggregate(octet, F.lit(0).cast("bigint"), lambda a, o: a * 256 + o)
        shown = _let(_let(x, lambda v: _network(v, F.lit(65536), F.lit(65536), F.lit(32), key, "ip", inverse)), lambda y: F.concat_ws(".", *[F.pmod(F.shiftright(y, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)]))
        return F.when(F.forall(octet, lambda o: o < 256) & ~m.rlike(r"(^|\.)0[0-9]"), shown)

    return _let(F.transform(F.split(m, r"\."), lambda o: o.cast("bigint")), of)


def _walk(x: Column, once, inside) -> Column:
    """Cycle walking: through the permutation once, and on (64 times at most, then the last value) until inside."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(x), lambda v, _: F.when(inside(v), v).otherwise(once(v)))


def _date(m: Column, key: str, inverse: bool) -> Column:
    day = F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "dd.MM.yyyy"), F.try_to_date(m, "dd/MM/yyyy"))
    origin = F.lit(DATE_FROM).cast("date")

    def shown(y: Column) -> Column:
        return F.when(m.rlike("^[0-9]{4}-"), F.date_format(y, "yyyy-MM-dd")).when(m.rlike(r"\."), F.date_format(y, "dd.MM.yyyy")).otherwise(F.date_format(y, "dd/MM/yyyy"))

    once = lambda v: _network(v, F.lit(272), F.lit(272), F.lit(5), key, "date", inverse)
    moved = lambda x: F.when((x >= 0) & (x < DATE_DAYS), _let(F.date_add(origin, _walk(x, once, lambda v: v < DATE_DAYS).cast("int")), shown))
    return _let(F.datediff(day, origin).cast("bigint"), moved)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    def of(d: Column) -> Column:
        new = F.concat(F.substring(d, 1, 2), _digits(F.substring(d, F.lit(3), F.length(d)), key, "phone", inverse))
        return F.when(F.length(d).between(8, 15), _let(new, lambda x: _refill(m, x)))

    return _let(_bare(m), of)


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    def ok(v: Column) -> Column:
        return ~F.lpad(v.cast("string"), 9, "0").rlike("^(000|666|9)|^[0-9]{3}00|0000$")

    once = lambda v: _network(v, F.lit(31250), F.lit(32000), F.lit(9), key, "ssn", inverse)
    moved = lambda x: _let(F.lpad(_walk(x, once, ok).cast("string"), 9, "0"), lambda y: _refill(m, y))
    return _let(_bare(m).cast("bigint"), lambda x: F.when(ok(x), moved(x)))


def _mod97(x: Column) -> Column:
    """Remainder of digits and letters, A counting as 10 and so on."""
    def step(a: Column, c: Column) -> Column:
        return F.pmod(F.when(c.rlike("[0-9]"), a * 10 + c.try_cast("int")).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97))

    return F.aggregate(_chars(x), F.lit(0), step)


def _iban(m: Column, key: str, inverse: bool) -> Column:
    flat = F.regexp_replace(m, " ", "")
    country = F.substring(flat, 1, 2)

    def of(account: Column) -> Column:
        digits = _bare(account)
        # of a long account the last 18 digits are permuted, so that halves stay within 64 bits
        n = F.greatest(F.length(digits) - 18, F.lit(0))
        moved = F.concat(F.substring(digits, F.lit(1), n), _let(F.substring(digits, n + 1, F.length(digits)), lambda d: _digits(d, key, "iban", inverse)))

        def closed(new: Column) -> Column:
            check = 98 - _mod97(F.concat(_refill(account, new), country, F.lit("00")))
            return F.concat(F.lpad(check.cast("string"), 2, "0"), new)

        shown = _let(_let(moved, closed), lambda x: F.concat(F.substring(m, 1, 2), _refill(F.substring(m, F.lit(3), F.length(m)), x)))
        return F.when(_mod97(F.concat(account, country, F.substring(flat, 3, 2))) == 1, shown)

    return _let(F.substring(flat, F.lit(5), F.length(flat)), of)


def _email(m: Column, key: str, inverse: bool) -> Column:
    """Letters and digits of the local part, each moved within its class by a stream that the other half of the local part keys."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    n = F.length(local)
    half = (n / 2).cast("int")
    sign = -1 if inverse else 1

    def moved(part: Column, other: Column, i: Column) -> Column:
        stream = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.length(part).cast("string"), i.cast("string"), F.lit(str(j)), other, domain).cast("binary"), 256) for j in range(2)])
        return F.array_join(F.transform(_chars(part), lambda c, j: _shift(c, sign * F.conv(F.substring(stream, 1 + F.pmod(j, F.lit(16)) * 8, F.lit(7)), 16, 10).cast("bigint"))), "")

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, moved(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(moved(s["b"], s["a"], i)).alias("b"))

    begin = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, n).alias("b"))
    rounds = F.sequence(F.lit(3), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(3))
    return F.aggregate(rounds, begin, step, lambda s: F.concat(s["a"], s["b"], F.lit("@"), domain))


def _shift(c: Column, by: Column) -> Column:
    def within(first: int, size: int) -> Column:
        return F.char(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(size)))

    return F.when(c.rlike("^[a-z]$"), within(97, 26)).when(c.rlike("^[A-Z]$"), within(65, 26)).when(c.rlike("^[0-9]$"), within(48, 10)).otherwise(c)


KINDS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "card": _card, "ip": _ip, "phone": _phone}


def pseudonymize(docs: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = tuple(KINDS), inverse: bool = False) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_<kind>`` (bigint), the values replaced of each kind.

    Every kind is one pass over the pieces that earlier kinds left: a piece is cut at the kind's matches, valid matches
    are replaced and belong to the kind, and what fails validation goes back into the text that later kinds see. Texts
    without ``@`` and digits are not cut at all.
    """
    combined = "|".join(f"(?:{PATTERNS[k]})" for k in kinds)
    counts = [f"n_{k}" for k in kinds]
    bare = F.lit(None).cast("string")

    def piece(kind: Column, value: Column) -> Column:
        return F.struct(kind.alias("kind"), value.alias("new"))

    def cut(p: Column, k: str) -> Column:
        """The pieces of one unclaimed piece: texts and, between them, what ``k`` claims."""
        news = F.transform(F.regexp_extract_all(p["new"], F.lit(PATTERNS[k]), F.lit(0)), lambda m: F.struct(m.alias("old"), KINDS[k](m, key, inverse).alias("new")))
        texts = F.transform(F.split(p["new"], PATTERNS[k], -1), lambda t: piece(bare, t))
        between = F.transform(news, lambda r: piece(F.when(r["new"].isNotNull(), F.lit(k)), F.coalesce(r["new"], r["old"])))
        none = piece(bare, F.lit(""))
        return joined(F.flatten(F.zip_with(texts, between, lambda t, r: F.array(t, F.coalesce(r, none)))))

    def cut_cards(p: Column) -> Column:
        """As ``cut``; the text is cut wherever a card may begin, and what is taken covers as many of these pieces as it is long."""
        pieces = F.split(p["new"], PATTERNS["card"], -1)

        def card(rest: Column) -> Column:
            tries = F.array(*[F.regexp_extract(rest, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9]|\.[0-9])", 0) for n in CARD_DIGITS])
            first = F.get(F.filter(tries, lambda x: (x != "") & _is_card(x)), F.lit(0))
            return _let(first, lambda x: F.when(x.isNotNull(), F.struct(x.alias("old"), _card(x, key, inverse).alias("new"))))

        found = F.transform(pieces, lambda t, i: F.struct(t.alias("text"), _let(F.array_join(F.slice(pieces, i + 1, F.lit(CARD_REACH)), ""), card).alias("card")))

        def step(s: Column, x: Column) -> Column:
            size, taken = F.length(x["text"]), F.length(x["card"]["old"])
            own = (s["skip"] == 0) & x["card"].isNotNull()
            rest = F.substring(x["text"], F.when(own, taken).otherwise(s["skip"]) + 1, size)
            more = F.concat(F.when(own, F.array(piece(F.lit("card"), x["card"]["new"]))).otherwise(F.array().cast("array<struct<kind:string,new:string>>")), F.array(piece(bare, rest)))
            return F.struct(F.greatest(F.when(own, taken).otherwise(s["skip"]) - size, F.lit(0)).alias("skip"), F.concat(s["out"], more).alias("out"))

        begin = F.struct(F.lit(0).alias("skip"), F.array(piece(bare, F.lit(""))).alias("out"))
        return joined(F.aggregate(found, begin, step, lambda s: s["out"]))

    def joined(pieces: Column) -> Column:
        """Unclaimed pieces in a row become one."""
        def add(done: Column, p: Column) -> Column:
            last = F.element_at(done, -1)
            one = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(piece(bare, F.concat(last["new"], p["new"]))))
            return F.when(last["kind"].isNull() & p["kind"].isNull(), one).otherwise(F.concat(done, F.array(p)))

        start = F.array(piece(bare, F.lit("")))
        return F.aggregate(pieces, start, add)

    out = docs.drop(*counts).withColumn("_r", F.when(F.col(text).rlike("[0-9]|@") & F.col(text).rlike(combined), F.array(piece(bare, F.col(text)))))
    def claimed(pieces: Column, k: str) -> Column:
        open_ = lambda p: p["kind"].isNull() & p["new"].rlike(PATTERNS[k])
        return F.when(F.exists(pieces, open_), F.flatten(F.transform(pieces, lambda p: F.when(open_(p), cut_cards(p) if k == "card" else cut(p, k)).otherwise(F.array(p))))).otherwise(pieces)

    for k in kinds:
        out = out.withColumn("_r", claimed(F.col("_r"), k))
    out = out.withColumn(text, F.when(F.size("_r") > 0, F.array_join(F.transform("_r", lambda p: p["new"]), "")).otherwise(F.col(text)))

    def of_kind(k: str) -> Column:
        return F.coalesce(F.size(F.filter("_r", lambda r: r["kind"] == k)), F.lit(0)).cast("bigint").alias(f"n_{k}")

    return out.select(*[c for c in docs.columns if c not in counts], *[of_kind(k) for k in kinds])
