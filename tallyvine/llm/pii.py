"""Personal data: keyed, format-preserving pseudonyms by Feistel networks. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Give your own; whoever has the key can undo the pseudonyms.
KEY = "change-me"
ROUNDS = 8

_EDGE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
ADDRESS = rf"(?<![0-9.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?!\.?[0-9])"
#: Lengths of the accounts of the IBAN registry's countries, by length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_SIZED = "|".join(
    rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()
)
#: As long as the country's accounts are, so that a word or number after it is not taken for its end.
IBAN = rf"{_EDGE}(?=[A-Z]{{2}}[0-9]{{2}})(?:{_SIZED}){_END}"
SECRET = rf"{_EDGE}(?=[a-fA-F]{{0,63}}[0-9])[0-9a-fA-F]{{32,128}}{_END}"
CARD = rf"{_EDGE}(?:[0-9]{{13,19}}|[0-9]{{4}}([ -])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{1,7}}){_END}"
DATE = rf"{_EDGE}(?:[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}){_END}"
SOCIAL = rf"{_EDGE}(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}{_END}"
PHONE = rf"(?<![A-Za-z0-9+])(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:[ .-]?[0-9]{{2,4}}){{2,4}}|\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}){_END}"
#: In this order; an earlier kind wins where two begin at the same place.
KINDS = [("email", EMAIL), ("address", ADDRESS), ("iban", IBAN), ("secret", SECRET), ("card", CARD), ("date", DATE), ("social", SOCIAL), ("phone", PHONE)]
ANY = "|".join(p.replace(r"\1", r"\k<sep>").replace("([ -])", "(?<sep>[ -])") for _, p in KINDS)

#: Days from 1900-01-01 to 2100-01-01, both included: 487 * 150. They stay among themselves, and so do all others.
DATE_MODULI = (487, 150)
FIRST_DAY, DAYS = "1900-01-01", 487 * 150
#: Days from 0001-01-01 to FIRST_DAY, and to the end of 9999; a permutation of somewhat more numbers than the other days are.
DAYS_BEFORE, ALL_DAYS = 693_595, 3_652_059
FAR_MODULI, FAR_WALK = (1892, 1892), 8
#: Steps in which a day that can be written in a narrower form is found; over a fifth of all days can, so none is missed but by 1 in 10^24.
WALK = 256
#: Areas 001-665 and 667-899; groups 01-99 with serials 0001-9999.
SOCIAL_MODULI = (898, 99 * 9999)


def _digest(key: str, kind: str, i: Column, value: Column) -> Column:
    """128 hex digits that depend on the key, the kind, the round and the other half."""
    made = F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), value)
    return F.concat(F.sha2(made.cast("binary"), 256), F.sha2(F.concat(made, F.lit("|more")).cast("binary"), 256))


def _number(digest: Column, at: int | Column = 1, digits: int = 12) -> Column:
    return F.conv(F.substr(digest, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("long")


def _turned(text: Column, digest: Column, letters: int) -> Column:
    """Every digit and ASCII letter moved on inside its own class by a part of the digest; the rest stays."""

    def move(c: Column, i: Column) -> Column:
        by = _number(digest, i % 32 * 4 + 1, 4)
        code = F.ascii(c)
        to = lambda first, size: F.char(F.lit(first) + (code - first + by) % size)
        return (
            F.when(code.between(48, 57), to(48, 10)).when(code.between(97, 96 + letters), to(97, letters))
            .when(code.between(65, 64 + letters), to(65, letters)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), move), "")


def permuted_text(text: Column, key: str, kind: str, letters: int = 26) -> Column:
    """A keyed permutation of the strings with the same classes of characters at the same places."""
    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), cut).alias("l"), F.substr(text, cut + 1, F.length(text)).alias("r"))

    def step(s: Column, i: Column) -> Column:
        # An array of one binds the digest, which is else computed for every character.
        turned = F.element_at(F.transform(F.array(_digest(key, kind, i, s["r"])), lambda d: _turned(s["l"], d, letters)), 1)
        return F.struct(s["r"].alias("l"), F.when(s["l"] == "", "").otherwise(turned).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(value: Column, moduli: tuple[int, int], key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1: two residues take turns at being moved by a hash of the other."""
    a, b = moduli
    start = F.struct((value % a).cast("long").alias("l"), F.floor(value / a).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _number(_digest(key, kind, i, s["r"].cast("string"))), F.lit(a))
        right = F.pmod(s["r"] + _number(_digest(key, kind, i, s["l"].cast("string"))), F.lit(b))
        return F.when(i % 2 == 1, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right.alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] + s["r"] * a)


def _bound(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _filled(shape: Column, digits: Column) -> Column:
    """The digits put back, in order, at the places of ``shape``'s digits and letters."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        taken = c.rlike("^[0-9A-Za-z]$")
        return F.struct(F.concat(s["out"], F.when(taken, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + taken.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn(digits: Column) -> Column:
    """The Luhn sum mod 10; 0 for a valid number."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda s, v: (s + v) % 10)


def mod97(text: Column) -> Column:
    """ISO 7064 remainder; letters count as 10 to 35."""
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _card(x: Column, key: str) -> Column:
    """All digits but the last are permuted; the last keeps the Luhn remainder, so valid numbers stay valid and others do not become so."""

    def make(d: Column) -> Column:
        body = permuted_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        return _bound(body, lambda p: F.concat(p, F.pmod(luhn(d) - luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))

    return _filled(x, _bound(F.regexp_replace(x, "[^0-9]", ""), make))


def _iban(x: Column, key: str) -> Column:
    """Country kept, account permuted, check digits computed anew. With wrong check digits only a card number inside it is replaced."""

    def make(d: Column) -> Column:
        country, account = F.substr(d, F.lit(1), F.lit(2)), F.substr(d, F.lit(5), F.length(d))
        return _bound(permuted_text(account, key, "iban"), lambda p: F.concat(
            country, F.lpad((98 - mod97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0"), p
        ))

    plain = F.replace(x, F.lit(" "), F.lit(""))
    valid = mod97(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))) == 1
    card = F.regexp_extract(x, CARD, 0)
    return F.when(valid, _filled(x, _bound(plain, make))).when(card != "", F.replace(x, card, _card(card, key))).otherwise(x)


def _address(x: Column, key: str) -> Column:
    """Octets of 0 to 255; left alone if one is larger or has a leading zero."""
    o = lambda i: F.element_at(F.split(x, r"\."), i).cast("long")
    valid = F.forall(F.split(x, r"\."), lambda p: (p.cast("int") <= 255) & ((p == "0") | ~p.startswith("0")))
    value = o(1) * (1 << 24) + o(2) * (1 << 16) + o(3) * (1 << 8) + o(4)
    dotted = lambda n: F.concat_ws(".", *[(F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])
    return F.when(valid, _bound(permuted_number(value, (1 << 16, 1 << 16), key, "address"), dotted)).otherwise(x)


def _date(x: Column, key: str) -> Column:
    """Another day, written alike; left alone if there is no such day.

    Days of 1900-01-01 to 2100-01-01 stay in that range, other days of the years 1 to 9999 outside it. Slash dates are read month first, and day first where the first number is no month.
    Those, and dates with numbers of one digit, are permuted among the days that can be
    written so: the permutation of all days is repeated until it meets one.
    """
    part = lambda i: F.element_at(F.split(x, "[-/.]"), i)
    iso, slash = x.contains("-"), x.contains("/")
    swapped = slash & (part(1).cast("int") > 12)
    day_first = x.contains(".") | swapped
    m, d = F.when(iso | day_first, part(2)).otherwise(part(1)), F.when(iso, part(3)).when(day_first, part(1)).otherwise(part(2))
    first = F.lit(FIRST_DAY).cast("date")
    # Read from its parts; a day that does not exist is null.
    day = F.datediff(F.concat_ws("-", F.when(iso, part(1)).otherwise(part(3)), m, d).try_cast("date"), first).cast("long")
    read = F.struct(
        day.alias("day"), (F.length(m) == 1).alias("short_month"), (F.length(d) == 1).alias("short_day"),
        iso.alias("iso"), slash.alias("slash"), day_first.alias("day_first"), swapped.alias("swapped"),
    )
    others = ALL_DAYS - DAYS

    def far(n: Column) -> Column:
        rank = n + F.when(n < 0, DAYS_BEFORE).otherwise(DAYS_BEFORE - DAYS)
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(FAR_WALK)), rank.cast("long"), lambda k, i: F.when((i == 1) | (k >= others), permuted_number(k, FAR_MODULI, key, "far")).otherwise(k))
        return _bound(walk, lambda k: (k - F.when(k < DAYS_BEFORE, DAYS_BEFORE).otherwise(DAYS_BEFORE - DAYS)).cast("long"))

    permuted = lambda n: F.when(n.between(0, DAYS - 1), permuted_number(n, DATE_MODULI, key, "date")).otherwise(far(n))
    at = lambda n: F.date_add(first, n.cast("int"))

    def moved(r: Column) -> Column:
        fits = lambda n: (
            (~r["short_month"] | (F.month(at(n)) <= 9)) & (~r["short_day"] | (F.dayofmonth(at(n)) <= 9)) & (~r["swapped"] | (F.dayofmonth(at(n)) > 12))
        )
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), r["day"], lambda n, i: F.when((i == 1) | ~fits(n), permuted(n)).otherwise(n))
        return F.when(r["short_month"] | r["short_day"] | r["swapped"], walk).otherwise(permuted(r["day"]))

    def written(r: Column, n: Column) -> Column:
        pad = lambda v, short: F.when(short, v.cast("string")).otherwise(F.lpad(v.cast("string"), 2, "0"))
        year, month, date = F.lpad(F.year(at(n)).cast("string"), 4, "0"), pad(F.month(at(n)), r["short_month"]), pad(F.dayofmonth(at(n)), r["short_day"])
        sep = F.when(r["slash"], "/").otherwise(".")
        return F.when(r["iso"], F.concat_ws("-", year, month, date)).when(r["day_first"], F.concat(date, sep, month, sep, year)).otherwise(F.concat(month, sep, date, sep, year))

    new = _bound(read, lambda r: F.when(r["day"].between(-DAYS_BEFORE, ALL_DAYS - DAYS_BEFORE - 1), _bound(moved(r), lambda n: written(r, n))))
    return F.coalesce(new, x)


def _social(x: Column, key: str) -> Column:
    area, group, serial = F.substr(x, F.lit(1), F.lit(3)).cast("int"), F.substr(x, F.lit(5), F.lit(2)).cast("int"), F.substr(x, F.lit(8), F.lit(4)).cast("int")
    rank = F.when(area > 666, area - 2).otherwise(area - 1) + SOCIAL_MODULI[0] * ((group - 1) * 9999 + serial - 1).cast("long")

    def written(n: Column) -> Column:
        a, rest = n % SOCIAL_MODULI[0], F.floor(n / SOCIAL_MODULI[0])
        pad = lambda v, w: F.lpad(v.cast("string"), w, "0")
        return F.concat_ws("-", pad(F.when(a > 664, a + 2).otherwise(a + 1), 3), pad(F.floor(rest / 9999) + 1, 2), pad(rest % 9999 + 1, 4))

    return _bound(permuted_number(rank, SOCIAL_MODULI, key, "social"), written)


def _phone(x: Column, key: str) -> Column:
    """The country code stays, all other digits are permuted."""
    code = F.regexp_extract(x, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 1)
    rest = F.substr(x, F.length(code) + 1, F.length(x))
    return F.concat(code, _filled(rest, permuted_text(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")))


def _email(x: Column, key: str) -> Column:
    """Letters and digits permuted each in its class; the last two labels of the domain stay."""
    kept = F.regexp_extract(x, r"[@.][A-Za-z0-9-]+\.[A-Za-z0-9-]+$", 0)
    return F.concat(permuted_text(F.substr(x, F.lit(1), F.length(x) - F.length(kept)), key, "email"), kept)


def _secret(x: Column, key: str) -> Column:
    return permuted_text(x, key, "secret", 6)


_MAKERS = {"email": _email, "address": _address, "iban": _iban, "secret": _secret, "card": _card, "date": _date, "social": _social, "phone": _phone}


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one found value; the same for the same value in any document."""
    out = value
    for kind, pattern in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{pattern})$"), _MAKERS[kind](value, key)).otherwise(out)
    return out


def _marked(text: Column) -> Column:
    """Texts cut at what is found: the text before, then for each find the value, U+0002 and the text after it."""
    return F.split(F.regexp_replace(text, ANY, "\x01$0\x02"), "\x01")


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``doc_id, text, lang, source, n_chars, n_private``: texts with personal data replaced, and how many values were replaced.

    E-mail and IP addresses, IBANs, payment card and other 13-19 digit numbers, social
    security and phone numbers, dates, and hexadecimal secrets get a pseudonym of the same
    form: letters and digits in the same places, valid check digits, real days. Values
    that fail their own check stay. Equal values get equal pseudonyms, different ones
    different ones. Texts without any stay as they are. Null stays null, with 0 found;
    repeated rows and null ids do not matter; other columns are not looked at. Rows stay
    where they are: no shuffle.
    """
    # Marks that a text itself holds are written differently meanwhile.
    held = F.col("text").rlike("[\x01-\x03]")
    safe = F.when(held, F.replace(F.replace(F.replace(F.col("text"), F.lit("\x03"), F.lit("\x033")), F.lit("\x01"), F.lit("\x031")), F.lit("\x02"), F.lit("\x032"))).otherwise(F.col("text"))
    parts = F.when(F.col("text").rlike("[0-9@]"), _marked(safe)).otherwise(F.array(safe))
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", held.alias("held"), parts.alias("parts"))

    def put(p: Column) -> Column:
        value = F.substring_index(p, "\x02", 1)
        rest = F.substr(p, F.instr(p, "\x02") + 1, F.length(p))
        return _bound(pseudonym(value, key), lambda new: F.struct(F.concat(new, rest).alias("text"), (new != value).alias("hidden")))

    found = F.transform("parts", lambda p, i: F.when(i == 0, F.struct(p.alias("text"), F.lit(False).alias("hidden"))).otherwise(put(p)))
    rows = rows.withColumn("found", found)
    joined = F.array_join(F.transform("found", lambda f: f["text"]), "")
    back = F.replace(F.replace(F.replace(joined, F.lit("\x031"), F.lit("\x01")), F.lit("\x032"), F.lit("\x02")), F.lit("\x033"), F.lit("\x03"))
    n = F.size(F.filter("found", lambda f: f["hidden"])).cast("long")
    text = F.when(F.col("text").isNull() | (n == 0), F.col("text")).when(F.col("held"), back).otherwise(joined)
    return rows.select("doc_id", text.alias("text"), "lang", "source", "n_chars", F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_private"))
