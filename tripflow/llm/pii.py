"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations; DataFrame functions only.

Found and validated: payment card numbers of 13 to 19 digits with a correct Luhn digit, US social security numbers
with an area, group and serial that are issued, phone numbers +1 (aaa) eee-nnnn and alike, the same without +1, IPv4 addresses, calendar
dates (yyyy-mm-dd, mm/dd/yyyy, dd.mm.yyyy, years 1800 to 2199) and e-mail addresses. What looks alike but fails its
check is left alone. In a row of numbers parted by single blanks or hyphens, a card may begin and end at any of them: the
leftmost valid one is taken, of several that begin there the longest, so one row of numbers in ten or more that are none
passes for a card.

Each value is an element of a finite set of two digits in mixed radix (high, low). A Feistel network of ROUNDS
rounds, whose round function is SHA-256 over key, kind, size, round and the other half, adds to one half modulo its
radix, so it permutes that set: equal values get equal pseudonyms in every document, different values different
ones, and a pseudonym is valid in the same format: card numbers get a new Luhn digit, dates stay calendar dates (the
400 years from 1800 are 146097 = 189 * 773 days, a set by itself), phone numbers whose area and exchange may exist keep such,
separators and lengths stay. Of e-mail addresses the
letters and digits of the local part are permuted in groups of eight and the domain stays.

The key comes from the caller, who takes it from the session's settings or the environment; there is no default. The
plan holds keys derived from it, by which pseudonyms could be undone as well: keep plans and event logs as close as the key.

Null texts stay null, empty ones empty. Texts are rewritten whole, in place; repeated rows alike; rows with a null
id like any other; all columns but the text stay as they are, whatever their names; empty tables stay empty.
"""

import hashlib
import hmac
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
# Where a key is looked for. The sample key is for invented tables only: whoever knows a key can undo the pseudonyms.
KEY_SETTING, KEY_VARIABLE = "spark.tripflow.pii.key", "TRIPFLOW_PII_KEY"
SAMPLE_KEY = "not-a-secret"

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
ISO_DATE, US_DATE, DOT_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}/[0-9]{2}/[0-9]{4}", r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
# Without a country code: (aaa) eee-nnnn, aaa-eee-nnnn and aaa.eee.nnnn.
_LOCAL = r"[2-9][0-9]{2}%s[2-9][0-9]{2}%s[0-9]{4}"
LOCAL_HYPHEN, LOCAL_POINT = _LOCAL % ("-", "-"), _LOCAL % (r"\.", r"\.")
LOCAL_PAREN = r"\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
# A value must not be part of a longer one of its own kind: numbers with points end before no further `.digit`, hyphenated ones
# before no further `-digit`, dates with slashes before no further `/digit`. Anything else may stand beside them, such as the
# commas of CSV, the prefix length of an IPv4 network, the slash of a range, or the time after an ISO date.
_WORD, _END = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
_TIME = r"(?:(?=[Tt][0-9]{2})|(?![0-9A-Za-z]))"
POINTED = rf"{_WORD}(?<![0-9]\.)(?:{DOT_DATE}|{IPV4}|{LOCAL_POINT}){_END}(?!\.[0-9])"
SLASHED = rf"{_WORD}(?<![0-9]/){US_DATE}{_END}(?!/[0-9])"
HYPHENATED = rf"{_WORD}(?<![0-9]-)(?:{ISO_DATE}{_TIME}|{SSN}{_END}|{LOCAL_HYPHEN}{_END})(?!-[0-9])"
NUMBER = rf"{_WORD}(?<![0-9][.-]){CARD}{_END}(?!\.[0-9])(?!-[0-9])"
PHONES = rf"{_WORD}(?:{PHONE}(?![0-9])|{LOCAL_PAREN}{_END}(?!-[0-9]))"
CANDIDATE = rf"{EMAIL}|{PHONES}|{SLASHED}|{POINTED}|{HYPHENATED}|{NUMBER}"
# Numbers in a row with 13 digits or more, up to where something else begins: cards, SSNs and ISO dates are sought in it at
# every place, see _run. It never gives back, so that long rows need no stack.
_PART = rf"(?!{EMAIL}|{SLASHED}|{POINTED})[0-9]++(?:(?=[Tt][0-9]{{2}})|(?![0-9A-Za-z]))(?!\.[0-9])"
RUN = rf"{_WORD}(?<![0-9][.-])(?=(?:[0-9][ -]?){{13}}){_PART}(?:[ -]{_PART})*+"
FOUND = rf"{EMAIL}|{PHONES}|{RUN}|{CANDIDATE}"
# Numbers that a card or a date can be made of.
MOST_PARTS = 19
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
FIRST_DAY = "1800-01-01"
DAYS = (189, 773)


def pii_key(spark: SparkSession, sample: str | None = None) -> str:
    """The key from the session's setting or the environment; without either `sample`, or an error where there is none."""
    key = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE) or sample
    if not key:
        raise RuntimeError(f"pseudonyms need a secret key: set {KEY_SETTING} or {KEY_VARIABLE}")
    return key


def _own_key(key: str, kind: str) -> str:
    """A key for one kind of value, from which the given one cannot be told: only this one stands in the plan."""
    return hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()


def _feistel(kind: str, size: Column, high: Column, low: Column, radix: tuple[Column, Column], key: str) -> Column:
    """The pair (high, low) after the permutation of the pairs below `radix`, as a struct; one for each key, kind, size."""
    start = F.struct(high.cast("long").alias("h"), low.cast("long").alias("l"))

    def draw(n: Column, other: Column, below: Column) -> Column:
        text = F.concat_ws("|", F.lit(_own_key(key, kind)), F.lit(kind), size.cast("string"), n.cast("string"), other.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), below)

    def turn(pair: Column, n: Column) -> Column:
        even = n % 2 == 0
        return F.struct(
            F.when(even, F.pmod(pair["h"] + draw(n, pair["l"], radix[0]), radix[0])).otherwise(pair["h"]).alias("h"),
            F.when(even, pair["l"]).otherwise(F.pmod(pair["l"] + draw(n, pair["h"], radix[1]), radix[1])).alias("l"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(base: int, n: Column) -> Column:
    return F.round(F.pow(F.lit(float(base)), n)).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _put_back(shape: Column, digits: Column, kept: str = "0-9") -> Column:
    """`shape` with its characters of the class `kept` replaced by those of `digits`, one after the other."""

    def character(i: Column) -> Column:
        own = F.substr(shape, i, F.lit(1))
        place = F.length(F.regexp_replace(F.substr(shape, F.lit(1), i), f"[^{kept}]", ""))
        return F.when(own.rlike(f"[{kept}]"), F.substr(digits, place, F.lit(1))).otherwise(own)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), character), "")


def _permute_digits(kind: str, digits: Column, key: str) -> Column:
    """Digits of the same number, from 2 to 36, leading zeros kept."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        first = F.floor(n / 2).cast("int")
        pair = _feistel(
            kind,
            n,
            F.substr(d, F.lit(1), first),
            F.substr(d, first + 1, n - first),
            (_power(10, first), _power(10, n - first)),
            key,
        )
        return _let(
            pair, lambda p: F.concat(F.lpad(p["h"].cast("string"), first, F.lit("0")), F.lpad(p["l"].cast("string"), n - first, F.lit("0")))
        )

    return _let(digits, halves)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum of digits; the last is doubled if `doubled` is 0, the one before it if it is 1."""

    def worth(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == doubled, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d + 1)).otherwise(d)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b)


def _card(text: Column, key: str) -> Column:
    def renumber(d: Column) -> Column:
        payload = _permute_digits("card", F.substr(d, F.lit(1), F.length(d) - 1), key)
        return _let(payload, lambda p: F.concat(p, F.pmod(10 - _luhn_sum(p, 0) % 10, F.lit(10)).cast("string")))

    return _put_back(text, _let(_digits(text), renumber))


def _phone(text: Column, key: str) -> Column:
    """Area and exchange from 200 on stay so; of other numbers the digit that is not stays, and the others are permuted."""

    def renumber(d: Column) -> Column:
        area, exchange, line = (F.substr(d, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (4, 3), (7, 4)))
        whole = _feistel("phone", F.lit(10), area - 200, (exchange - 200) * 10_000 + line, (F.lit(800), F.lit(8_000_000)), key)
        rest = F.substr(d, F.lit(5), F.lit(6)).cast("int")
        part = _feistel("phone exchange", F.lit(10), area - 200, rest, (F.lit(800), F.lit(1_000_000)), key)
        return (
            F.when(area < 200, F.concat(F.left(d, F.lit(1)), _permute_digits("phone area", F.substr(d, F.lit(2), F.lit(9)), key)))
            .when(
                exchange < 200,
                _let(part, lambda p: F.concat((p["h"] + 200).cast("string"), F.substr(d, F.lit(4), F.lit(1)), F.lpad(p["l"].cast("string"), 6, "0"))),
            )
            .otherwise(_let(whole, lambda p: F.concat((p["h"] + 200).cast("string"), (p["l"] + 2_000_000).cast("string"))))
        )

    bare = F.regexp_replace(text, r"^\+1", "")
    return F.concat(F.when(text.startswith("+1"), "+1").otherwise(""), _put_back(bare, _let(_digits(bare), renumber)))


def _ssn(text: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substr(text, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    high = area - 1 - F.when(area > 666, 1).otherwise(0)
    low = (group - 1) * 9999 + serial - 1
    pair = _feistel("ssn", F.lit(9), high, low, (F.lit(898), F.lit(99 * 9999)), key)

    def write(p: Column) -> Column:
        number = p["h"] + 1 + F.when(p["h"] + 1 >= 666, 1).otherwise(0)
        parts = (number, 3), (F.floor(p["l"] / 9999) + 1, 2), (p["l"] % 9999 + 1, 4)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return _let(pair, write)


def _ipv4(text: Column, key: str) -> Column:
    def permute(o: Column) -> Column:
        at = [o[i].cast("long") for i in range(4)]
        pair = _feistel("ipv4", F.lit(32), at[0] * 256 + at[1], at[2] * 256 + at[3], (F.lit(65536), F.lit(65536)), key)
        return _let(
            pair,
            lambda p: F.concat_ws(
                ".", *[x.cast("string") for x in (F.floor(p["h"] / 256), p["h"] % 256, F.floor(p["l"] / 256), p["l"] % 256)]
            ),
        )

    return _let(F.split(text, r"\."), permute)


def _date(text: Column, pattern: str, key: str) -> Column:
    def permute(day: Column) -> Column:
        since = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        high, low = F.floor(since / DAYS[1]), since % DAYS[1]
        pair = _feistel("date", F.lit(DAYS[0] * DAYS[1]), high, low, (F.lit(DAYS[0]), F.lit(DAYS[1])), key)
        new = _let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["h"] * DAYS[1] + p["l"]).cast("int")))
        return F.date_format(new, pattern)

    return _let(F.to_date(text, pattern), permute)


def _number(text: Column) -> Column:
    """The value of letters and digits read in base 36."""
    each = F.transform(F.split(text, ""), lambda c: (F.instr(F.lit(LETTERS), c) - 1).cast("long"))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, d: a * 36 + d)


def _in_letters(value: Column, n: Column) -> Column:
    """A number below 36^n as n letters and digits."""
    digit = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.substr(F.lit(LETTERS), (F.floor(value / _power(36, n - i)) % 36 + 1).cast("int"), F.lit(1))
    )
    return F.when(n > 0, F.array_join(digit, "")).otherwise("")


def _email(text: Column, key: str) -> Column:
    local = F.lower(F.substring_index(text, "@", 1))

    def group(g: Column) -> Column:
        n = F.length(g)
        # One letter is a pair whose high half has a single value.
        first = F.floor(n / 2).cast("int")
        high = F.when(first > 0, _number(F.substr(g, F.lit(1), first))).otherwise(F.lit(0).cast("long"))
        pair = _feistel("email", n, high, _number(F.substr(g, first + 1, n - first)), (_power(36, first), _power(36, n - first)), key)
        return _let(pair, lambda p: F.concat(_in_letters(p["h"], first), _in_letters(p["l"], n - first)))

    groups = F.regexp_extract_all(F.regexp_replace(local, "[^a-z0-9]", ""), F.lit("(.{1,8})"), F.lit(1))
    new = F.array_join(F.transform(groups, group), "")
    return F.concat(_put_back(local, new, "a-z0-9"), F.lit("@"), F.substring_index(text, "@", -1))


def _valid_date(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date").between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date"))


def _value_ahead(parts: Column, i: Column) -> Column:
    """The SSN, ISO date or card that begins at part i of a run, each part with the separator before it, or null."""
    window = F.slice(parts, i + 1, MOST_PARTS + 1)

    def within(w: Column) -> Column:
        rest = F.regexp_replace(F.array_join(w, ""), "^[ -]", "")
        hyphenated = F.regexp_extract(rest, rf"^(?:{ISO_DATE}|{SSN}|{LOCAL_HYPHEN})(?![0-9])(?!-)", 0)
        alone = (~F.element_at(w, 1).startswith("-")) & (hyphenated != "")
        ends = F.sequence(F.least(F.size(w), F.lit(MOST_PARTS)), F.lit(1), F.lit(-1))
        cards = F.transform(ends, lambda n: F.regexp_replace(F.array_join(F.slice(w, F.lit(1), n), ""), "^[ -]", ""))
        valid = F.filter(cards, lambda c: c.rlike(f"^{CARD}$") & (_luhn_sum(_digits(c), 1) % 10 == 0))
        return F.when(alone, hyphenated).otherwise(F.get(valid, F.lit(0)))

    return _let(window, within)


def _run(text: Column, key: str) -> Column:
    """A run of numbers with its cards, SSNs and ISO dates replaced: at each place the longest card that is valid."""

    def rewritten(parts: Column) -> Column:
        # `at` is the place in the text, `done` up to where it has been taken apart: gap, value, gap, value, ...
        start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("done"), F.array().cast("array<string>").alias("pieces"))

        def step(state: Column, i: Column) -> Column:
            part = F.element_at(parts, i + 1)
            skipped = F.when(part.rlike("^[ -]"), 1).otherwise(0)
            after = state["at"] + F.length(part)

            def take(value: Column) -> Column:
                begin = state["at"] + skipped
                gap = F.substr(text, state["done"], begin - state["done"])
                return F.struct(
                    after.alias("at"),
                    F.when(value.isNull(), state["done"]).otherwise(begin + F.length(value)).alias("done"),
                    F.when(value.isNull(), state["pieces"])
                    .otherwise(F.concat(state["pieces"], F.array(gap, value)))
                    .alias("pieces"),
                )

            return _let(F.when(state["at"] >= state["done"], _value_ahead(parts, i)), take)

        def finish(state: Column) -> Column:
            def piece(p: Column, k: Column) -> Column:
                return F.when(k % 2 == 1, _pseudonym(p, key)).otherwise(p)

            rest = F.substr(text, state["done"], F.length(text) - state["done"] + 1)
            return F.concat(F.array_join(F.transform(state["pieces"], piece), ""), rest)

        return F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), start, step, finish)

    return _let(F.regexp_extract_all(text, F.lit("[ -]?[0-9]+"), F.lit(0)), rewritten)


def _replaced(text: Column, key: str) -> Column:
    """What a match becomes: a run, or one value."""
    run = text.rlike("^(?=(?:[0-9][ -]?){13})[0-9]+(?:[ -][0-9]+)*+$")
    return F.when(run, _run(text, key)).otherwise(_pseudonym(text, key))


def _pseudonym(text: Column, key: str) -> Column:
    """What a candidate becomes, or the candidate itself if it fails its check."""
    digits = _digits(text)
    octets = F.transform(F.split(text, r"\."), lambda o: (F.length(o) == 1) | (~o.startswith("0") & (o.cast("int") <= 255)))
    cases = [
        (text.contains("@"), _email(text, key)),
        (text.rlike(rf"^(?:\+1|{LOCAL_PAREN}$|{LOCAL_HYPHEN}$|{LOCAL_POINT}$)"), _phone(text, key)),
        (text.rlike(f"^{ISO_DATE}$"), F.when(_valid_date(text, "yyyy-MM-dd"), _date(text, "yyyy-MM-dd", key))),
        (text.rlike(f"^{US_DATE}$"), F.when(_valid_date(text, "MM/dd/yyyy"), _date(text, "MM/dd/yyyy", key))),
        (text.rlike(f"^{DOT_DATE}$"), F.when(_valid_date(text, "dd.MM.yyyy"), _date(text, "dd.MM.yyyy", key))),
        (text.rlike(f"^{SSN}$"), F.when(text.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), _ssn(text, key))),
        (text.rlike(f"^{IPV4}$"), F.when(F.forall(octets, lambda o: o), _ipv4(text, key))),
        (text.rlike(f"^{CARD}$"), F.when(_luhn_sum(digits, 1) % 10 == 0, _card(text, key))),
    ]
    new = F.lit(None).cast("string")
    for condition, value in reversed(cases):
        new = F.when(condition, value).otherwise(new)
    return F.coalesce(new, text)


def pseudonymised(text: Column, key: str) -> Column:
    """The text with all personal data in it replaced."""
    gaps = F.split(text, FOUND, -1)
    values = F.transform(F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)), lambda m: _replaced(m, key))
    pieces = F.zip_with(gaps, values, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
    # All but texts without a digit or an at sign go unread.
    return F.when(text.rlike("[0-9@]"), F.array_join(pieces, "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with the text rewritten and all other columns as they are."""
    return docs.withColumn(text_col, pseudonymised(F.col(text_col).cast("string"), key))


def pii(docs: DataFrame, key: str) -> DataFrame:
    """`doc_id` and the rewritten `text`: a row for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pseudonymise(rows, key)
