"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One pass of a combined pattern cuts a text into the pieces between candidates and the
candidates themselves.  Candidates are validated by kind; those that fail stay as they are.
Card numbers and IBANs are looked for in whole runs of groups of digits and capitals, at every
group, so that other numbers or capitals beside a valid one do not hide it; a run takes time in proportion to its groups.
The others are replaced by a keyed permutation of their own format, so that equal values get
equal pseudonyms in every document, different values different ones, and a pseudonym is
valid again:

* payment card numbers (an issuer's prefix and one of its lengths, Luhn): the digits before the check digit are
  permuted by a Feistel network over decimal halves, the check digit is computed anew;
* IBANs (mod 97): digits of the account part, check digits anew;
* social security numbers and dates: permuted, walking on until the value is a valid one again
  (dates between 1900-01-01 and 2099-12-31);
* telephone numbers: all digits after the country code, which is read from the list of codes, so that one number has one
  pseudonym however it is spaced; IPv4 addresses: their 32 bits;
* e-mail addresses and secret tokens have no number format; they get a keyed digest in the shape of an
  address and of a hexadecimal token.

Separators and brackets stay where they are.  A round's function is SHA-256 over the key, the
kind, the length, the round and the other half.

Defined results: a null text stays null, an empty one empty; texts without personal data are returned
unchanged; repeated rows stay; extra columns may have any name; the case of hexadecimal tokens is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, unused

#: Key of the pseudonyms; production passes its own secret.
DEFAULT_KEY = "bizlens-pseudonyms"
ROUNDS = 8

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
IPV4 = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])(?![\p{L}])"
SECRET = r"(?<![\p{L}\p{N}])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}+(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
DATE = r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?!(?![Tt][0-9]{2}:?[0-9]{2})[\p{L}\p{N}]|[./-][0-9])"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])"
CARD = r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])"
NATIONAL = r"(?<![\p{L}\p{N}])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}])"
#: Countries whose numbers have one length: a number that follows is not part of the telephone number.
FIXED = r"(?<![\p{L}\p{N}])\+(?:" + "|".join(rf"(?:{codes})(?:[ .()-]{{0,2}}[0-9]){{{digits}}}" for digits, codes in (
    (10, "1|7|44|91"), (9, r"32(?=[ .()-]{0,2}4[5-9])|31|33|34|41|48|61|351|420|421"), (8, "32|45|47|65|852"))) + r")(?![\p{L}\p{N}])"
PHONE = FIXED + r"|(?<![\p{L}\p{N}])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![\p{L}\p{N}])|" + NATIONAL
#: Groups of digits and capitals from a digit or the start of an IBAN on, up to a value of another kind.
_GROUP = rf"(?!{'|'.join([EMAIL, SECRET, IPV4, DATE, SSN, NATIONAL])})[A-Z0-9]++(?![\p{{L}}\p{{N}}])"
RUN = rf"(?<![\p{{L}}\p{{N}}])(?=[0-9]|[A-Z]{{2}}[0-9]{{2}})(?=(?:[ -]?[A-Z0-9]){{12}}){_GROUP}(?:[ -]{_GROUP})*+"
ANY = "|".join([EMAIL, SECRET, IPV4, DATE, SSN, PHONE, RUN])

#: Country codes of telephone numbers (others have three digits).
COUNTRY_CODE = r"\A\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Prefixes and lengths of the card issuers.
ISSUERS = {"4": "13|16|19", "5[1-5]": "16", "222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720": "16", "3[47]": "15",
           "30[0-5]|3095|36|3[89]": "14|16|17|18|19", "6011|64[4-9]|65": "16|17|18|19", "35(?:2[89]|[3-8][0-9])": "16|17|18|19",
           "62|81": "16|17|18|19", "50(?:18|20|38)|5893|6304|6759|676[1-3]": "13|14|15|16|17|18|19", "220[0-4]": "16|17|18|19"}
CARD_PREFIX = r"\A(?:" + "|".join(ISSUERS) + ")"
CARD_NUMBER = r"\A(?:" + "|".join(rf"(?=(?:{prefix}))(?:{'|'.join(f'[0-9]{{{n}}}' for n in lengths.split('|'))})\z"
                                  for prefix, lengths in ISSUERS.items()) + ")"
#: How cards are written, and the length of IBANs by country.
CARD_SHAPE = r"\A(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})\z"
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
                22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
                25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
                29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
IBAN_SHAPE = r"\A(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}[A-Z0-9]{{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")\z"
_IBAN_GROUPS, _CARD_GROUPS = 34, 19      # most groups a value can have

_DAYS = 73049                      # days of 1900 to 2099
_DAY_HALVES = (271, 270)           # 271 * 270 = 73170, little over the days
_WALK = 40                         # steps of a cycle walk; a walk that long has probability below 1e-30


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _prf(key: str, kind: str, length: Column, turn: Column, value: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), length.cast("string"), turn.cast("string"),
                                value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), modulus)


def feistel(key: str, kind: str, length: Column, left: Column, right: Column, m_left: Column, m_right: Column) -> Column:
    """Permutation of pairs (left below m_left, right below m_right): rounds add a keyed function
    of one half to the other in turn.  Returns struct(l, r)."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(
            F.pmod(s["l"] + _prf(key, kind, length, i, s["r"], m_left), m_left).alias("l"), s["r"].alias("r"))) \
            .otherwise(F.struct(
                s["l"].alias("l"), F.pmod(s["r"] + _prf(key, kind, length, i, s["l"], m_right), m_right).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """Keyed permutation of the decimal strings of each length from 2 on."""
    def halves(x: Column) -> Column:
        n = F.length(x)
        a = (n / 2).cast("int")
        b = n - a
        return let(feistel(key, kind, n, F.substr(x, F.lit(1), a), F.substr(x, a + 1), _power(a), _power(b)),
                   lambda s: F.concat(F.lpad(s["l"].cast("string"), a, "0"), F.lpad(s["r"].cast("string"), b, "0")))
    return let(digits, halves)


def walk(value: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """Apply a permutation until the value is valid again: a permutation of the valid values."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))

    def go(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(step(s["v"]), lambda y: F.struct(y.alias("v"), valid(y).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), start, go)["v"]


def luhn(payload: Column) -> Column:
    """Check digit of a string of digits (as a bigint)."""
    def add(s: Column, i: Column) -> Column:
        d = F.substr(payload, F.length(payload) - i, F.lit(1)).cast("bigint")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == 0, twice).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(0), F.length(payload) - 1), F.lit(0).cast("bigint"), add)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def put_digits(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    def at(i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        nth = F.length(digits_of(F.substr(m, F.lit(1), i)))
        return F.when(c.between("0", "9"), F.substr(digits, nth, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), at), "")


def mod97(account: Column) -> Column:
    """Remainder by 97 of letters (A = 10 ... Z = 35) and digits read as one number."""
    def add(s: Column, i: Column) -> Column:
        c = F.substr(account, i, F.lit(1))
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), F.pmod(s * 10 + c.cast("bigint"), F.lit(97))) \
            .otherwise(F.pmod(s * 100 + letter, F.lit(97))).cast("bigint")
    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0).cast("bigint"), add)


# ---- kinds: whether a candidate is valid, and its pseudonym -------------------------

def _is(pattern: str) -> Callable[[Column], Column]:
    return lambda m: m.rlike(rf"\A(?:{pattern})\z")


def _card_ok(m: Column) -> Column:
    return F.coalesce(let(digits_of(m), lambda d: d.rlike(CARD_NUMBER) & (
        F.substr(d, F.length(d), F.lit(1)).cast("bigint") == luhn(F.substr(d, F.lit(1), F.length(d) - 1)))), F.lit(False))


def _card(key: str, m: Column) -> Column:
    payload = let(digits_of(m), lambda d: F.substr(d, F.lit(1), F.length(d) - 1))
    return let(permute_digits(key, "card", payload),
               lambda p: put_digits(m, F.concat(p, luhn(p).cast("string"))))


def _iban_ok(m: Column) -> Column:
    return let(F.replace(m, F.lit(" "), F.lit("")),
               lambda x: mod97(F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))) == 1)


def _iban_shaped(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit("")).rlike(IBAN_SHAPE)


def _iban(key: str, m: Column) -> Column:
    def permuted(x: Column) -> Column:
        account = F.substr(x, F.lit(5))
        # all digits at once: of the 30 an account part may have, each Feistel half holds 15
        moved = F.when(F.length(digits_of(account)) >= 2, let(digits_of(account), lambda d: put_digits(
            account, permute_digits(key, "iban", d)))).otherwise(account)
        return let(moved, lambda a: F.concat(
            F.substr(x, F.lit(1), F.lit(2)),
            F.lpad((98 - mod97(F.concat(a, F.substr(x, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), a))

    def spaced(y: Column) -> Column:
        def at(i: Column) -> Column:
            c = F.substr(m, i, F.lit(1))
            nth = F.length(F.replace(F.substr(m, F.lit(1), i), F.lit(" "), F.lit("")))
            return F.when(c == " ", c).otherwise(F.substr(y, nth, F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), at), "")

    return let(let(F.replace(m, F.lit(" "), F.lit("")), permuted), spaced)


def _ssn_ok(m: Column) -> Column:
    return digits_of(m).rlike(r"\A(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}\z")


def _ssn(key: str, m: Column) -> Column:
    return let(walk(digits_of(m), lambda d: permute_digits(key, "ssn", d), _ssn_ok), lambda d: put_digits(m, d))


def _date_parts(m: Column) -> Column:
    """Struct of year, month, day (strings), and whether day and month stand the other way round than is usual: day.month.year,
    month/day/year, unless the month would be over 12."""
    at = [F.get(F.split(m, "[./-]"), F.lit(i)) for i in range(3)]
    a, b, c = at

    def read(y: Column, mo: Column, d: Column, turned: bool) -> Column:
        return F.struct(y.alias("y"), mo.alias("m"), d.alias("d"), F.lit(turned).alias("turned"))

    dotted = F.contains(m, F.lit("."))
    return F.when(F.length(a) == 4, read(a, b, c, False)) \
        .when(dotted & (b.cast("int") > 12), read(c, a, b, True)).when(dotted, read(c, b, a, False)) \
        .when(a.cast("int") > 12, read(c, b, a, True)).otherwise(read(c, a, b, False))


def _date_of(m: Column) -> Column:
    return let(_date_parts(m), lambda p: F.try_to_date(F.concat_ws("-", p["y"], F.lpad(p["m"], 2, "0"), F.lpad(p["d"], 2, "0")), "yyyy-MM-dd"))


def _date_ok(m: Column) -> Column:
    return F.coalesce(_date_of(m).between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), F.lit(False))


def _date(key: str, m: Column) -> Column:
    a, b = (F.lit(x).cast("bigint") for x in _DAY_HALVES)
    first = F.lit("1900-01-01").cast("date")

    def step(n: Column) -> Column:
        halves = feistel(key, "date", F.lit(0), F.floor(n / _DAY_HALVES[1]), F.pmod(n, b), a, b)
        return let(halves, lambda s: s["l"] * b + s["r"])

    day = let(walk(F.datediff(_date_of(m), first).cast("bigint"), step, lambda n: n < _DAYS),
              lambda n: F.date_add(first, n.cast("int")))
    # 1-digit months and days stay without zeros; the other way round only where it can be read no other way
    short = m.rlike(r"(?<![0-9])[0-9](?![0-9])")

    def written(d: Column) -> Column:
        turned = _date_parts(m)["turned"] & (F.dayofmonth(d) > 12)

        def form(padded: str, plain: str) -> Column:
            return F.when(short, F.date_format(d, plain)).otherwise(F.date_format(d, padded))

        dotted = F.contains(m, F.lit("."))
        return F.when(m.rlike(r"\A[0-9]{4}"), form("yyyy-MM-dd", "yyyy-M-d")) \
            .when(dotted & turned, form("MM.dd.yyyy", "M.d.yyyy")).when(dotted, form("dd.MM.yyyy", "d.M.yyyy")) \
            .when(turned, form("dd/MM/yyyy", "d/M/yyyy")).otherwise(form("MM/dd/yyyy", "M/d/yyyy"))

    return let(day, written)


def _phone_ok(m: Column) -> Column:
    return F.length(digits_of(m)).between(8, 15)


def _phone(key: str, m: Column) -> Column:
    code = F.regexp_extract(m, COUNTRY_CODE, 0)
    rest = F.substr(m, F.length(code) + 1)
    return F.concat(code, let(rest, lambda r: put_digits(r, permute_digits(key, "phone", digits_of(r)))))


def _ip(key: str, m: Column) -> Column:
    half = F.lit(65536).cast("bigint")
    parts = F.split(m, r"\.")
    moved = feistel(key, "ip", F.lit(0), F.get(parts, F.lit(0)).cast("bigint") * 256 + F.get(parts, F.lit(1)).cast("bigint"),
                    F.get(parts, F.lit(2)).cast("bigint") * 256 + F.get(parts, F.lit(3)).cast("bigint"), half, half)
    return let(moved, lambda s: F.concat_ws(".", *[x.cast("string") for x in (
        F.floor(s["l"] / 256), F.pmod(s["l"], F.lit(256)), F.floor(s["r"] / 256), F.pmod(s["r"], F.lit(256)))]))


def _digest(key: str, kind: str, m: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), m), 256)


def _email(key: str, m: Column) -> Column:
    return let(_digest(key, "email", F.lower(m)), lambda d: F.concat(
        F.lit("u"), F.substring(d, 1, 16), F.lit("@"), F.lit("h"), F.substring(d, 17, 8), F.lit(".example")))


def _secret(key: str, m: Column) -> Column:
    # one digest for each 64 digits, the first without a number
    digests = F.transform(F.sequence(F.lit(0), F.floor((F.length(m) - 1) / 64)), lambda i: _digest(
        key, "secret", F.when(i == 0, F.lower(m)).otherwise(F.concat_ws("|", i.cast("string"), F.lower(m)))))
    token = F.substr(F.array_join(digests, ""), F.lit(1), F.length(m))
    return F.when(F.upper(m) == m, F.upper(token)).otherwise(token)


#: kind -> (pattern or validity, pseudonym), in order of precedence.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[str, Column], Column]]] = {
    "email": (lambda m: F.contains(m, F.lit("@")), _email),
    "secret": (_is(SECRET), _secret),
    "iban": (lambda m: m.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9 ]*\z") & (m.rlike(rf"\A(?:{IBAN})\z") | _iban_shaped(m)) & _iban_ok(m), _iban),
    "ip": (_is(IPV4), _ip),
    "date": (lambda m: _is(DATE)(m) & _date_ok(m), _date),
    "ssn": (lambda m: _is(SSN)(m) & _ssn_ok(m), _ssn),
    "phone": (lambda m: _is(PHONE)(m) & _phone_ok(m), _phone),
    "card": (lambda m: _is(CARD)(m) & _card_ok(m), _card),
}


#: Kinds found at the groups of a run.
IN_RUNS = ("iban", "card")


def run_pieces(m: Column) -> Column:
    """A candidate cut into structs (m, k): valid IBANs and cards with their kind, what is between them without.
    Where valid values overlap, IBANs of their country's length go first, other IBANs next, then cards as they
    are usually written, then other cards, the longer and earlier before the others."""
    none = F.lit(None).cast("string")

    def judged(s: Column, i: Column, j: Column) -> Column:
        iban, card = (KINDS[k][0](s) for k in IN_RUNS)
        usual = F.when(s.rlike(CARD_SHAPE), 2).otherwise(3)
        rank = F.when(iban, F.when(_iban_shaped(s), 0).otherwise(1)).when(card, usual)
        return let(rank, lambda r: F.struct(r.alias("r"), (-F.length(s)).alias("n"), i.alias("i"), j.alias("j"),
                                            F.when(r < 2, F.lit("iban")).otherwise(F.lit("card")).alias("k"), s.alias("m")))

    def numbers(a: Column, b: Column, step: int = 1) -> Column:
        return F.when(a <= b, F.sequence(a, b, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def of(tokens: Column) -> Column:
        # groups are at even places, what stands between them at odd ones; single look-ups only, a slice copies the whole array
        last = F.size(tokens) - 1

        def text(i: Column, j: Column) -> Column:
            return F.array_join(F.transform(F.sequence(i, j), lambda k: F.get(tokens, k)), "")

        def spans(i: Column) -> Column:
            first = F.get(tokens, i)
            start = F.regexp_replace(text(i, F.least(i + 6, last)), "[ -]", "")
            reach = F.when(first.rlike(r"\A[A-Z]{2}[0-9]{2}"), 2 * _IBAN_GROUPS - 2) \
                .when(first.rlike(r"\A[2-8][0-9]{0,18}\z") & start.rlike(CARD_PREFIX), 2 * _CARD_GROUPS - 2)
            return let(reach, lambda r: F.filter(F.transform(
                F.when(r.isNull(), F.array().cast("array<int>")).otherwise(numbers(i, F.least(i + r, last), 2)),
                lambda j: let(text(i, j), lambda s: judged(s, i, j))), lambda x: x["r"].isNotNull()))

        def cut(at: Column, s: Column, e: Column) -> Column:
            """Pieces of the tokens s to e; no value reaches across their ends."""
            found = F.flatten(F.transform(numbers(s + F.pmod(s, F.lit(2)), e, 2), lambda k: F.get(at, (k / 2).cast("int"))))

            def placed(kept: Column) -> Column:
                def piece(i: Column) -> Column:
                    over = F.get(F.filter(kept, lambda x: (x["i"] <= i) & (i <= x["j"])), F.lit(0))
                    return let(over, lambda x: F.when(x.isNull(), F.struct(F.get(tokens, i).alias("m"), none.alias("k")))
                               .when(x["i"] == i, F.struct(x["m"].alias("m"), x["k"].alias("k"))))
                return F.filter(F.transform(F.sequence(s, e), piece), lambda p: p.isNotNull())

            return let(found, lambda x: F.when(F.size(x) == 0, F.array(F.struct(text(s, e).alias("m"), none.alias("k"))))
                       .otherwise(let(choose(x), placed)))

        def resolve(at: Column) -> Column:
            # where no value found reaches across, the run falls apart into stretches that decide for themselves
            inside = F.flatten(F.transform(F.flatten(at), lambda x: numbers(x["i"] + 1, x["j"])))
            starts = F.concat(F.array(F.lit(0)), F.array_except(numbers(F.lit(1), last), inside))
            return let(starts, lambda a: F.flatten(F.transform(
                a, lambda s, n: cut(at, s, F.coalesce(F.get(a, n + 1) - 1, last)))))

        return let(F.transform(F.sequence(F.lit(0), last, F.lit(2)), spans), lambda at: F.when(
            F.forall(at, lambda x: F.size(x) == 0), F.array(F.struct(m.alias("m"), none.alias("k")))).otherwise(resolve(at)))

    def choose(found: Column) -> Column:
        return F.aggregate(F.array_sort(found), F.slice(found, 1, 0), lambda kept, x: F.when(
            F.exists(kept, lambda y: (y["i"] <= x["j"]) & (x["i"] <= y["j"])), kept).otherwise(F.concat(kept, F.array(x))))

    tokens = F.regexp_extract_all(m, F.lit("([A-Z0-9]+|[^A-Z0-9]+)"), F.lit(0))
    return let(F.when(m.rlike("\\A[A-Z0-9]"), tokens).otherwise(F.concat(F.array(F.lit("")), tokens)), of)


def pseudonymise(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY,
                 names: tuple[str, str] = ("_pii_text", "_pii_kinds")) -> DataFrame:
    """Adds the text with pseudonyms and the array of the kinds found, one entry a value replaced."""
    text = quoted(text)
    candidate = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(f"({ANY})"), F.lit(0)))
    inner = unused(docs, "_pii_found", "_pii_known")
    found = docs.withColumn(inner[0], F.coalesce(candidate, F.array().cast("array<string>")))

    def kind(m: Column) -> Column:
        c = None
        for name, (valid, _) in KINDS.items():
            if name not in IN_RUNS:
                c = F.when(valid(m), name) if c is None else c.when(valid(m), name)
        return c

    def pseudonym(x: Column) -> Column:
        c = None
        for name, (_, make) in KINDS.items():
            hit = x["k"] == name
            c = F.when(hit, make(key, x["m"])) if c is None else c.when(hit, make(key, x["m"]))
        return c.otherwise(x["m"])

    def pieces(m: Column) -> Column:
        return let(kind(m), lambda k: F.when(k.isNotNull(), F.array(F.struct(m.alias("m"), k.alias("k")))).otherwise(run_pieces(m)))

    known = F.transform(inner[0], pieces)
    found = found.withColumn(inner[1], known)
    done = F.transform(inner[1], lambda p: F.array_join(F.transform(p, pseudonym), ""))
    between = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(between, F.concat(done, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = found.withColumn(names[0], F.when(F.size(inner[0]) == 0, F.col(text)).otherwise(joined)) \
        .withColumn(names[1], F.filter(F.transform(F.flatten(inner[1]), lambda x: x["k"]), lambda k: k.isNotNull()))
    return out.drop(inner[0], inner[1])
