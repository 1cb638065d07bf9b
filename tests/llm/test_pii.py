import datetime
import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from tripflow.llm import pii as module
from tripflow.llm.pii import SAMPLE_KEY as KEY
from tripflow.llm.pii import pii, pii_key, pseudonymise

LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"


def feistel(kind, size, high, low, radix):
    for n in range(10):
        other, own = (low, high) if n % 2 == 0 else (high, low)
        own_key = hmac.new(KEY.encode(), kind.encode(), "sha256").hexdigest()
        text = "|".join(map(str, (own_key, kind, size, n, other)))
        below = radix[n % 2]
        moved = (own + int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % below) % below
        high, low = (moved, low) if n % 2 == 0 else (high, moved)
    return high, low


def digits_of(kind, d):
    a = len(d) // 2
    h, x = feistel(kind, len(d), int(d[:a]), int(d[a:]), (10**a, 10 ** (len(d) - a)))
    return f"{h:0{a}d}{x:0{len(d) - a}d}"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10


def put_back(shape, new, kept="0123456789"):
    new = iter(new)
    return "".join(next(new) if c in kept else c for c in shape)


def one(m):
    if "@" in m:
        local, domain = m.lower().split("@")[0], m.split("@")[1]
        flat, out = re.sub("[^a-z0-9]", "", local), ""
        for g in (flat[i : i + 8] for i in range(0, len(flat), 8)):
            a = len(g) // 2
            halves = feistel("email", len(g), int(g[:a] or "0", 36), int(g[a:], 36), (36**a, 36 ** (len(g) - a)))
            for value, n in zip(halves, (a, len(g) - a), strict=True):
                out += "".join(LETTERS[value // 36 ** (n - i) % 36] for i in range(1, n + 1))
        return put_back(local, out, LETTERS) + "@" + domain
    if m.startswith(("+1", "(")) or re.fullmatch(r"\d{3}([.-])\d{3}\1\d{4}", m):
        prefix, bare = ("+1", m[2:]) if m.startswith("+1") else ("", m)
        d = re.sub("[^0-9]", "", bare)
        if d[0] in "01":
            d = d[0] + digits_of("phone area", d[1:])
        elif d[3] in "01":
            h, x = feistel("phone exchange", 10, int(d[:3]) - 200, int(d[4:]), (800, 10**6))
            d = f"{h + 200}{d[3]}{x:06d}"
        else:
            h, x = feistel("phone", 10, int(d[:3]) - 200, (int(d[3:6]) - 200) * 10_000 + int(d[6:]), (800, 8 * 10**6))
            d = f"{h + 200}{x + 2_000_000}"
        return prefix + put_back(bare, d)
    for shape, form in ((r"\d{4}-\d\d-\d\d", "%Y-%m-%d"), (r"\d\d/\d\d/\d{4}", "%m/%d/%Y"), (r"\d\d\.\d\d\.\d{4}", "%d.%m.%Y")):
        if re.fullmatch(shape, m):
            try:
                day = datetime.datetime.strptime(m, form).date()
            except ValueError:
                return m
            if not 1800 <= day.year <= 2199:
                return m
            first = datetime.date(1800, 1, 1)
            h, x = feistel("date", 146097, *divmod((day - first).days, 773), (189, 773))
            return (first + datetime.timedelta(h * 773 + x)).strftime(form)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return m
        h, x = feistel("ssn", 9, area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, (898, 99 * 9999))
        h += 1 + (h + 1 >= 666)
        return f"{h:03d}-{x // 9999 + 1:02d}-{x % 9999 + 1:04d}"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = m.split(".")
        if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in o):
            return m
        a, b, c, d = map(int, o)
        h, x = feistel("ipv4", 32, a * 256 + b, c * 256 + d, (65536, 65536))
        return f"{h // 256}.{h % 256}.{x // 256}.{x % 256}"
    d = re.sub("[^0-9]", "", m)
    if luhn(d):
        return m
    payload = digits_of("card", d[:-1])
    return put_back(m, payload + str(-luhn(payload + "0") % 10))


def plain(text):
    return text and re.sub(module.CANDIDATE, lambda m: one(m[0]), text, flags=re.ASCII)


def card(draw, n=16):
    body = "".join(draw.choices("0123456789", k=n - 1))
    return body + str(-luhn(body + "0") % 10)


def texts():
    draw = random.Random(2)
    found = []
    for _ in range(60):
        c = card(draw, draw.randrange(13, 20))
        found += [f"pay {c}.", f"({' '.join(c[i : i + 4] for i in range(0, len(c), 4))})", f"no {c[:-1]}{(int(c[-1]) + 1) % 10}!"]
        found.append(f"ring +1 ({draw.randrange(1000):03d}) 555-{draw.randrange(10_000):04d}%%%")
        found.append(f"{draw.randrange(1000):03d}-{draw.randrange(100):02d}-{draw.randrange(10_000):04d}, é")
        found.append(".".join(str(draw.randrange(300)) for _ in range(4)) + " | x")
        found.append(f"{draw.randrange(1790, 2210)}-{draw.randrange(14):02d}-{draw.randrange(33):02d}")
        found.append(f"born {draw.randrange(14):02d}/{draw.randrange(33):02d}/{draw.randrange(1700, 2300)}.")
        found.append(f"am {draw.randrange(33):02d}.{draw.randrange(14):02d}.{draw.randrange(1700, 2300)}")
        found.append(f"to {''.join(draw.choices(LETTERS, k=draw.randrange(1, 20)))}.{draw.randrange(99)}@mail{draw.randrange(9)}.example.com, or")
    found += ["A.b_C+9@x.org", "x@y", "@", "9", "a1@b.co 1@b.co", "1.2.3.4.5", "x4111111111111111", "41111111111111111111111"]
    found += ["4111111111111111", "4111-1111-1111-1111", "ünï 4111111111111111é", "1990-02-29 2000-02-29", "", None, "no numbers here"]
    found += ["+1 212 555 0100 +1-212-555-0100 +12125550100", "v 10.0.0.1-beta 01.2.3.4", "007-01-0001 900-01-0001 666-01-0001"]
    return found + [" ".join(t for t in found if t) * 20]


def test_against_plain(docs):
    rows = list(enumerate(texts())) + [(None, "4111111111111111"), (3, "4111111111111111"), (3, "4111111111111111")]
    table = docs(rows).withColumns({"h": F.lit(1), "l": F.lit("x")})
    got = sorted((str(r.doc_id), str(r.text)) for r in pii(table, KEY).collect())
    assert got == sorted((str(i), str(plain(t))) for i, t in rows)


def test_other_columns_stay(docs):
    table = docs(["4111111111111111"]).withColumn("pair", F.lit("x"))
    assert pseudonymise(table, KEY).columns == table.columns
    assert pseudonymise(table, KEY).drop("text").collect() == table.drop("text").collect()
    assert pseudonymise(table, "other").first().text != pseudonymise(table, KEY).first().text
    assert pii(docs([]), KEY).collect() == []


def test_key_from_outside(spark, docs, monkeypatch):
    monkeypatch.delenv(module.KEY_VARIABLE, raising=False)
    with pytest.raises(RuntimeError, match="secret key"):
        pii_key(spark)
    assert pii_key(spark, "sample") == "sample"
    monkeypatch.setenv(module.KEY_VARIABLE, "from the environment")
    assert pii_key(spark, "sample") == "from the environment"
    spark.conf.set(module.KEY_SETTING, "from the session")
    try:
        assert pii_key(spark) == "from the session"
    finally:
        spark.conf.unset(module.KEY_SETTING)
    plan = pii(docs(["x"]), "top-secret-key")._jdf.queryExecution().toString()
    assert "top-secret-key" not in plan


def test_phones(docs):
    texts = ["+1 (415) 555-0100", "(415) 555-0100", "415-555-0100", "415.555.0100", "call 415-555-0100, 4111111111111111", "415-555-0100 4111111111111111"]
    got = rewritten(docs, texts)
    digits = [re.sub("[^0-9]", "", t) for t in got]
    # One number in every form, linked.
    assert digits[0][1:] == digits[1] == digits[2] == digits[3] == digits[4][:10] == digits[5][:10] != "4155550100"
    assert got[1][0] == "(" and got[3].count(".") == 2 and "4111111111111111" not in got[4] + got[5]
    draw = random.Random(3)
    valid = [f"+1 {draw.randrange(200, 1000)} {draw.randrange(200, 1000)} {draw.randrange(10_000):04d}" for _ in range(300)]
    assert all(re.fullmatch(r"\+1 [2-9]\d\d [2-9]\d\d \d{4}", t) for t in rewritten(docs, valid))
    odd = ["+1 (017) 555-7713", "+1 415 155 0100"]
    assert all(a != b for a, b in zip(rewritten(docs, odd), odd, strict=True))
    stay = ["1415-555-0100", "415-555-0100-1", "415.555.0100.1", "115-555-0100", "x(415) 555-0100"]
    assert rewritten(docs, stay) == stay


@pytest.mark.parametrize("kind, size, radix", [("a", 5, (7, 11)), ("b", 9, (10, 100)), ("date", 1, (189, 773)), ("c", 1, (1, 36))])
def test_permutes(spark, kind, size, radix):
    pairs = spark.range(radix[0] * radix[1]).selectExpr(f"floor(id / {radix[1]}) AS h", f"id % {radix[1]} AS l")
    new = module._feistel(kind, F.lit(size), F.col("h"), F.col("l"), (F.lit(radix[0]), F.lit(radix[1])), KEY)
    found = pairs.select("h", "l", new.alias("n")).collect()
    assert len({tuple(r.n) for r in found}) == radix[0] * radix[1]
    assert all(0 <= r.n.h < radix[0] and 0 <= r.n.l < radix[1] for r in found)
    assert all(tuple(r.n) == feistel(kind, size, r.h, r.l, radix) for r in found[:200])


def test_no_python_in_the_plan(docs):
    plan = pii(docs(["x"]), KEY)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def rewritten(docs, texts):
    """The pseudonymised texts, in order."""
    return [r.text for r in sorted(pii(docs(texts), KEY).collect(), key=lambda r: r.doc_id)]


def test_cards_beside_numbers(docs):
    a, b, ssn, day = "4111 1111 1111 1111", "5500000000000004", "123-45-6789", "2024-01-05"
    new = {v: one(v) for v in (a, b, ssn, day, "4111111111111111", "4111-1111-1111-1111", "10.0.0.1", "01/05/2024", "x@y.org")}
    shapes = [
        "{0} 123", "{0} 12 34", "7 {0}", "12 35 {0} 567", "2 {1} 3", "{0} {1}", "{1} {0} {1} 9", "{0}-77", "5 {5}-123",
        "{0} {2}", "55 {3} {2}", "{2} {0} {3}", "{3} {2} {3}", "{0} 6.5", "{0} {6} {1}", "{0} {7}", "{1} {8}", "{1} 12ab",
        "12 {1} {3}T10:00:00Z",
    ]
    values = [a, b, ssn, day, "4111111111111111", "4111-1111-1111-1111", "10.0.0.1", "01/05/2024", "x@y.org"]
    got = rewritten(docs, [s.format(*values) for s in shapes])
    assert got == [s.format(*[new[v] for v in values]) for s in shapes]
    assert not any(a in t or b in t for t in got)


def test_long_rows_of_numbers(docs):
    text = " ".join(["0001"] * 3_000 + ["4111111111111111"] + ["x"])
    got = rewritten(docs, [text, "1-" * 3_000 + "1"])
    assert "4111111111111111" not in got[0] and len(got[0]) == len(text)


def test_values_between_separators(docs):
    card, ssn, day, ip, us, dot = "4111111111111111", "123-45-6789", "1980-02-03", "10.0.0.1", "02/03/1980", "03.02.1980"
    values = [card, ssn, day, ip, us, dot]
    shapes = [
        "{1},{2},{3}", "1,{0},{0},2", "{0},{1},{2},{3},{4},{5},9", "{2}T10:00:00Z {2}t10:00", "{3}/24", "{2}/{2}", "{3}-{3}",
        "{4}-{4}", "{5}-{5}", "7/{2},{0}/{0}", "{2}.5", "{5}/{5},1",
    ]
    got = rewritten(docs, [s.format(*values) for s in shapes])
    assert got == [s.format(*[one(v) for v in values]) for s in shapes]
    # Parts of longer values of their own kind stay.
    whole = [f"{ip}.5", f"5.{ip}", f"{ssn}-1", f"1-{ssn}", f"{day}-1", f"{us}/1", f"{dot}.1", f"{card}.5", f"0.{card}", f"{day}x"]
    assert rewritten(docs, whole) == whole
