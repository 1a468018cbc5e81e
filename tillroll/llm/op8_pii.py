"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Candidates are found by one pattern, validated by kind (card numbers and IBANs by check digit,
addresses by range, dates by calendar) and replaced by a keyed Feistel permutation of their own
format: the symbols of a value - digits, letters, octets, or a date's day - are cut in two halves,
and each round adds to one half, symbol by symbol modulo its alphabet, a hash of the key, the kind,
the round and the other half.  The permutation is a bijection that depends on nothing but the key,
so equal values stay linked across documents and the holder of the key can undo it
(``restore=True``).  Separators, country and network digits stay; check digits are made anew.
Separators of cards, IBANs and phone numbers are taken out first and put back afterwards, so one
number has one pseudonym in all its spellings.  The key comes from the caller; there is none by default.

A date with slashes is day/month, or month/day where only that is a date.  The pseudonym of the
latter is permuted on until its day is above 12 too, so that it reads alike; in other spellings the
same day is linked to it only where once was enough.  Days from 1900-01-01 to 2099-11-13 are permuted.

A card or IBAN candidate that fails validation is read again from and to each of its separators, the
leftmost and then the longest valid reading first, and once more behind that.  Its pseudonyms are
permuted on until the candidate reads in the same places (at most ``WALK`` times), so that the key
still undoes them; the few that are permuted more than once are not linked to equal values.

Everything is one projection: no shuffle, no state, no Python.

Defined cases: a null text stays null and has no values; an empty text stays empty; repeated rows
give repeated results; candidates that fail validation are left as they are; an empty table gives
an empty result; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROUNDS = 6
#: Session setting with the key of the query, and the published key it takes where that is unset: good for tests alone.
KEY_CONF, TEST_KEY = "tillroll.pii.key", "tillroll"
#: Days from 1900-01-01 that are permuted: EPOCHS x EPOCH_DAYS.
FIRST_DAY, EPOCHS, EPOCH_DAYS = "1900-01-01", 250, 292

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.)++[A-Za-z]{2,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![\d.,-])\d(?:[ -]?\d){12,18}(?![\d]|[.,-]\d)"
PHONE = r"(?<![\d.])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d){5,9}(?!\d)|(?<![\d.+(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
# fixed values: country calling codes of one and two digits; the others have three, if not written otherwise
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|\d{1,2}(?=[ .(-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DAY = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)"
SECRET = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
ANY = "|".join((EMAIL, SECRET, IBAN, DAY, ADDRESS, SSN, PHONE, CARD))
#: A text without these holds none of the above.
HINT = r"\d\d|@|AKIA|\d\.|\d[ -]\d"
#: Permutations of a candidate with shorter readings; each keeps its places but for about one in ten.
WALK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(symbols: Column, sizes: Column, tweak: Column, restore: bool = False) -> Column:
    """Permutes an array of symbols, the i-th below ``sizes[i]``; undone by ``restore``."""
    half = F.floor(F.size(symbols) / 2).cast("int")

    def add(side: Column, base: Column, other: Column, number: int) -> Column:
        seed = F.concat_ws("|", tweak, F.lit(str(number)), F.concat_ws(",", F.transform(other, lambda x: x.cast("string"))))

        def shifted(mask: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                # five hexadecimal digits for each symbol, from as many hashes as there are symbols to shift
                by = F.conv(F.substring(F.sha2(F.concat_ws("|", mask, (i / 12).cast("int").cast("string")), 256), (i % 12 * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("long")
                return F.pmod(x - by if restore else x + by, F.element_at(base, i + 1)).cast("int")
            return F.transform(side, one)

        return let(F.sha2(seed, 256), shifted)

    def step(number: int) -> Callable[[Column], Column]:
        def run(state: Column) -> Column:
            left, right = state["l"], state["r"]
            if number % 2 == 0:
                left = add(left, state["a"], right, number)
            else:
                right = add(right, state["b"], left, number)
            return F.struct(left.alias("l"), right.alias("r"), state["a"].alias("a"), state["b"].alias("b"))
        return run

    rest = F.size(symbols) - half
    state = F.struct(F.slice(symbols, 1, half).alias("l"), F.slice(symbols, half + 1, rest).alias("r"),
                     F.slice(sizes, 1, half).alias("a"), F.slice(sizes, half + 1, rest).alias("b"))
    for number in (reversed(range(ROUNDS)) if restore else range(ROUNDS)):
        state = let(state, step(number))
    return let(state, lambda s: F.concat(s["l"], s["r"]))


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def permute_text(value: Column, tweak: Column, restore: bool) -> Column:
    """Digits, small and capital letters permuted in place; other characters stay."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    code = lambda c: (F.when(c.rlike("^[0-9]$"), F.position(c, F.lit(_DIGITS))).when(c.rlike("^[a-z]$"), F.position(c, F.lit(_LOWER)))
                      .when(c.rlike("^[A-Z]$"), F.position(c, F.lit(_UPPER))).otherwise(1) - 1).cast("int")
    base = lambda c: F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1)

    def back(c: Column, n: Column) -> Column:
        pick = lambda alphabet: F.substring(F.lit(alphabet), n + 1, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), pick(_DIGITS)).when(c.rlike("^[a-z]$"), pick(_LOWER)).when(c.rlike("^[A-Z]$"), pick(_UPPER)).otherwise(c)

    return let(chars, lambda cs: F.array_join(F.zip_with(cs, feistel(F.transform(cs, code), F.transform(cs, base), tweak, restore), back), ""))


def permute_spelled(value: Column, tweak: Column, restore: bool) -> Column:
    """``permute_text`` of the letters and digits alone; what is between them is put back in its place."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def spelled(new: Column) -> Column:
        def add(state: Column, c: Column) -> Column:
            own = c.rlike("^[0-9A-Za-z]$")
            return F.struct(F.concat(state["done"], F.when(own, F.substring(new, state["at"], F.lit(1))).otherwise(c)).alias("done"),
                            (state["at"] + own.cast("int")).alias("at"))
        return F.aggregate(chars, F.struct(F.lit("").alias("done"), F.lit(1).alias("at")), add, lambda state: state["done"])

    return let(permute_text(F.regexp_replace(value, "[^0-9A-Za-z]", ""), tweak, restore), spelled)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, tweak: Column, restore: bool) -> Column:
    """The network digit stays, the check digit is made anew, separators stay where they are."""
    body = permute_spelled(F.substring(value, F.lit(2), F.length(value) - 2), tweak, restore)

    def checked(kept: Column) -> Column:
        good = F.filter(F.split(F.lit("0,1,2,3,4,5,6,7,8,9"), ","), lambda d: F.call_function("luhn_check", F.concat(_digits(kept), d)))
        return F.concat(kept, F.element_at(good, 1))

    return let(F.concat(F.substring(value, 1, 1), body), checked)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits read as an IBAN does (A is 10)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda total, c: F.when(
        c.rlike("^[0-9]$"), total * 10 + F.position(c, F.lit(_DIGITS)) - 1).otherwise(total * 100 + F.position(c, F.lit(_UPPER)) + 9) % 97)


def _compact(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def _iban(value: Column, tweak: Column, restore: bool) -> Column:
    """The country stays, check digits are made anew, spaces stay where they are."""
    body = permute_spelled(F.substring(value, F.lit(5), F.length(value)), tweak, restore)
    return let(body, lambda b: F.concat(F.substring(value, 1, 2), F.lpad(
        (98 - _mod97(F.concat(_compact(b), F.substring(value, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda x: x.cast("int"))


def _address(value: Column, tweak: Column, restore: bool) -> Column:
    moved = feistel(_octets(value), F.array(*[F.lit(256)] * 4), tweak, restore)
    return F.concat_ws(".", F.transform(moved, lambda x: x.cast("string")))


_FORMATS = (("-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), (".", "dd.MM.yyyy"), ("/", "MM/dd/yyyy"))


def _read(value: Column) -> list[Column]:
    """The date by each format, null where it is none."""
    return [F.when(F.contains(value, F.lit(mark)), F.try_to_timestamp(value, F.lit(form)).cast("date")) for mark, form in _FORMATS]


def _date(value: Column) -> Column:
    return F.coalesce(*_read(value))


def _day(value: Column, tweak: Column, restore: bool) -> Column:
    first = F.lit(FIRST_DAY).cast("date")

    def moved(day: Column) -> Column:
        two = feistel(F.array(F.floor(day / EPOCH_DAYS).cast("int"), (day % EPOCH_DAYS).cast("int")), F.array(F.lit(EPOCHS), F.lit(EPOCH_DAYS)), tweak, restore)
        return let(two, lambda t: t[0] * EPOCH_DAYS + t[1])

    def month_first(day: Column) -> Column:
        """Permuted until the day of the month is no month's number."""
        again = lambda x, i: F.when((i > 1) & (F.dayofmonth(F.date_add(first, x)) > 12), x).otherwise(moved(x))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), day, again)

    day, known = F.datediff(_date(value), first), [d.isNotNull() for d in _read(value)]
    new = let(day, lambda d: F.date_add(first, F.when(known[0] | known[1] | known[2], moved(d)).otherwise(month_first(d))))
    return let(new, lambda d: F.coalesce(*[F.when(k, F.date_format(d, form)) for k, (_, form) in zip(known, _FORMATS, strict=True)]))


def _is_iban(value: Column) -> Column:
    return value.rlike(f"^(?:{IBAN})$") & (_mod97(F.concat(F.substring(_compact(value), F.lit(5), F.length(value)), F.substring(value, 1, 4))) == 1)


def _is_card(value: Column) -> Column:
    return value.rlike(f"^(?:{CARD})$") & F.call_function("luhn_check", _digits(value))


def kind_of(value: Column) -> Column:
    """The kind of a validated candidate, else null."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    days = F.datediff(_date(value), F.lit(FIRST_DAY).cast("date"))
    return (F.when(F.contains(value, F.lit("@")), "email")
            .when(whole(SECRET), "secret")
            .when(_is_iban(value), "iban")
            .when(whole(DAY), F.when((days >= 0) & (days < EPOCHS * EPOCH_DAYS), "date"))
            .when(whole(ADDRESS), F.when(F.forall(_octets(value), lambda x: x < 256), "address"))
            .when(whole(SSN), F.when(~value.rlike("^(000|666|9)|-00-|-0000$"), "ssn"))
            .when(_is_card(value), "card")
            .when(whole(PHONE), "phone"))


def readings(value: Column) -> Column:
    """(s, e, k) of the valid cards and IBANs between separators of a candidate: the first, and the first behind it."""
    size = F.length(value)

    def first(behind: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), size), lambda i: (i > behind) & ((i == 1) | F.substring(value, i - 1, F.lit(1)).isin(" ", "-")) & ~F.substring(value, i, F.lit(1)).isin(" ", "-"))
        ends = F.reverse(F.filter(F.sequence(F.lit(1), size), lambda j: (j == size) | F.substring(value, j + 1, F.lit(1)).isin(" ", "-")))
        pairs = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: e - s >= 12), lambda e: F.struct(s.alias("s"), e.alias("e")))))

        def told(p: Column) -> Column:
            part = F.substring(value, p["s"], p["e"] - p["s"] + 1)
            return F.struct(p["s"].alias("s"), p["e"].alias("e"), F.when(_is_card(part), "card").when(_is_iban(part), "iban").alias("k"))

        return F.slice(F.filter(F.transform(pairs, told), lambda p: p["k"].isNotNull()), 1, 1)

    return let(first(F.lit(0)), lambda one: F.when(F.size(one) == 0, one).otherwise(F.concat(one, first(one[0]["e"]))))


def _walked(value: Column, cuts: Column, key: str, restore: bool) -> Column:
    """A candidate with pseudonyms in its readings ``cuts``, permuted until it has the same readings."""
    def replaced(text: Column) -> Column:
        def add(done: Column, c: Column) -> Column:
            part, tweak = F.substring(text, c["s"], c["e"] - c["s"] + 1), F.concat_ws("|", F.lit(key), c["k"])
            new = F.when(c["k"] == "card", _card(part, tweak, restore)).otherwise(_iban(part, tweak, restore))
            return F.concat(F.substring(done, F.lit(1), c["s"] - 1), new, F.substring(text, c["e"] + 1, F.length(text)))
        return F.aggregate(cuts, text, add)

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), value, lambda x, i: F.when((i > 1) & (readings(x) == cuts), x).otherwise(replaced(x)))


def pseudonym(value: Column, kind: Column, key: str, restore: bool = False) -> Column:
    tweak = F.concat_ws("|", F.lit(key), kind)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    national = F.regexp_extract(value, rf"^(\+(?:{COUNTRY})[ .-]?)?(.*)$", 2)
    return (F.when(kind == "email", F.concat(permute_text(local, tweak, restore), F.lit("@"), domain))
            .when(kind == "secret", F.concat(F.lit("AKIA"), permute_text(F.substring(value, F.lit(5), F.length(value)), tweak, restore)))
            .when(kind == "iban", _iban(value, tweak, restore))
            .when(kind == "date", _day(value, tweak, restore))
            .when(kind == "address", _address(value, tweak, restore))
            .when(kind == "card", _card(value, tweak, restore))
            .when(kind == "phone", F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(national)), permute_spelled(national, tweak, restore)))
            .when(kind == "ssn", permute_text(value, tweak, restore)))


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None, restore: bool = False) -> DataFrame:
    """(id, text, found): the text with pseudonyms, and the kind of every value that was replaced, in order."""
    if not key:
        raise ValueError("a key is needed: whoever knows it can undo the pseudonyms")
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("values", F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    retry = lambda v: v.rlike("[ -]") & v.rlike(f"^(?:{CARD}|{IBAN})$")
    rows = rows.withColumn("read", F.when(F.size("values") > 0, F.transform("values", lambda v: let(
        kind_of(v), lambda k: F.struct(k.alias("k"), F.when(k.isNull() & retry(v), readings(v)).alias("cuts"))))))
    rows = rows.withColumn("kinds", F.flatten(F.transform("read", lambda r: F.when(r["k"].isNotNull(), F.array(r["k"])).otherwise(
        F.coalesce(F.transform(r["cuts"], lambda c: c["k"]), F.array().cast("array<string>"))))))
    has = F.size("kinds") > 0
    new = F.zip_with("values", "read", lambda v, r: F.when(r["k"].isNotNull(), pseudonym(v, r["k"], key, restore))
                     .when(F.size(r["cuts"]) > 0, _walked(v, r["cuts"], key, restore)).otherwise(v))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, ANY, -1), new, lambda part, v: F.array(part, F.coalesce(v, F.lit(""))))), "")
    return rows.select(F.col("doc_id").alias(id_col), F.when(has, joined).otherwise(text).alias(text_col),
                       F.when(has, F.col("kinds")).otherwise(F.array().cast("array<string>")).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_CONF, TEST_KEY)
    out = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), key=key)
    return out.select("doc_id", F.size("found").alias("n_found"), F.concat_ws(",", F.array_sort(F.array_distinct("found"))).alias("kinds"), "text")
