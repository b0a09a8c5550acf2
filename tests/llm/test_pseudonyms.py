import datetime
import hashlib
import re

from pyspark.sql import functions as F

from routestats.llm import pseudonyms as ps

KEY = "a key"


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def with_check(payload):
    return next(payload + str(c) for c in range(10) if luhn(payload + str(c)))


def mapped(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return dict(df.select("v", ps.pseudonymised(F.col("v"), KEY)).collect())


def test_every_kind_keeps_its_format(spark):
    card = with_check("411111111111111")
    cards = [card, f"{card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}", with_check("37828224631000")]
    values = [*cards, "+1 (415) 555-2671", "+1-415-555-2671", "+14155552671", "123-45-6789", "12.34.56.78", "2021-02-28", "2020-12-31", "2021/02/28", "28.02.2021",
              "jo.doe+x9@mail.example.com", "a@b.org"]
    new = mapped(spark, values)
    for old, made in new.items():
        assert made != old, old
        if "." not in old or "@" in old:
            assert re.sub("[A-Za-z]", "a", re.sub(r"\d", "0", old)).lower() == re.sub("[A-Za-z]", "a", re.sub(r"\d", "0", made)).lower()
    assert all(luhn(new[c]) and new[c][0] == c[0] for c in cards)
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(new[cards[0]]) == digits(new[cards[1]])
    assert len({digits(new[p]) for p in values if p.startswith("+")}) == 1
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", new["+1 (415) 555-2671"])
    assert new["a@b.org"].endswith("@b.org")
    assert new["12.34.56.78"].count(".") == 3 and all(0 <= int(p) <= 255 for p in new["12.34.56.78"].split("."))
    moved = datetime.date.fromisoformat(new["2021-02-28"])
    assert new["2021/02/28"] == moved.strftime("%Y/%m/%d") and new["28.02.2021"] == moved.strftime("%d.%m.%Y")
    assert new["2020-12-31"].endswith("12-31")


def test_invalid_values_and_other_text_stay(spark):
    card = with_check("411111111111111")
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    stay = [wrong, "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "300.1.2.3", "1.2.3.4.5", "2021-02-30",
            "2021-13-01", "2021-01/02", "02/28/2021", "30.02.2021", "1.2.3", "12345", "x" + card, card + "7" * 8, "no@host", "@a.b", "", "plain"]
    new = mapped(spark, stay)
    assert {v: m for v, m in new.items() if v != m} == {}
    text = f"call +1 (415) 555-2671, or {card}; from 10.20.30.40. Mail: x1@y.zz!\n{card}"
    made = mapped(spark, [text])[text]
    assert made.startswith("call +1 (") and "; from " in made and made.endswith("\n" + made.split("or ")[1].split(";")[0])
    for value in ("415) 555-2671", card, "10.20.30.40", "x1@"):
        assert value not in made


def test_low_phones_high_addresses_and_other_card_groups(spark):
    card = with_check("37828224631000")
    cards = [f"{card[:4]}{sign}{card[4:10]}{sign}{card[10:]}" for sign in " -"]
    phones = ["+1 (017) 555-7713", "+1-017-555-7713", "+1 (415) 155-2671", "+1 (415) 055-2671", "+1 (000) 000-0000", "+1 (115) 555-0000", "+1 199.555.0000"]
    quads = ["233.254.104.120", "224.0.0.1", "255.255.255.255", "240.1.2.3"]
    new = mapped(spark, [*cards, *phones, *quads, card])
    assert not {v for v, m in new.items() if v == m}
    digits = lambda s: re.sub(r"\D", "", s)
    assert {digits(new[c]) for c in cards} == {new[card]} and luhn(new[card])
    assert all(re.sub(r"\d", "0", p) == re.sub(r"\d", "0", new[p]) for p in [*phones, *cards])
    assert digits(new[phones[0]]) == digits(new[phones[1]])
    assert all(224 <= int(new[q].split(".")[0]) <= 255 and max(map(int, new[q].split("."))) <= 255 for q in quads)
    many = [f"+1 ({a}) {e}-{n}" for a in ("000", "099", "100", "199", "200", "999") for e in ("000", "199", "200", "999") for n in ("0000", "1234", "9999")]
    many += [f"{a}.{b}.0.{c}" for a in (0, 1, 223, 224, 255) for b in (0, 9, 255) for c in range(0, 256, 51)]
    made = mapped(spark, many)
    assert len(set(made.values())) == len(many) and not {v for v, m in made.items() if v == m}


def test_permutations_are_one_to_one(spark):
    dates = [str(datetime.date(1900, 1, 1) + datetime.timedelta(d)) for d in range(0, 73_049, 23)]
    dates += [f"{y}-12-31" for y in range(1904, 2100, 4)]
    serials = ["%03d-%02d-%04d" % (a, g, s) for a in (1, 665, 667, 899) for g in (1, 50, 99) for s in range(1, 9999, 1111)]
    mails = [f"{a}{b}@x.yy" for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"]
    for values in (sorted(set(dates)), serials, mails):
        new = mapped(spark, values)
        assert len(new) == len(values) and len(set(new.values())) == len(values)
    assert set(mapped(spark, [f"{a}@x.yy" for a in "abcdefghijklmnopqrstuvwxyz"]).values()) == {f"{a}@x.yy" for a in "abcdefghijklmnopqrstuvwxyz"}
    leap = [f"{y}-12-31" for y in range(1904, 2100, 4)]
    assert set(mapped(spark, leap).values()) == set(leap)


def test_rounds_can_be_undone(spark):
    """The same network in plain Python, run backwards."""
    import hashlib

    key, sizes = "k", [10, 26, 10, 7, 256]

    def turn(state, r, sign):
        half, left = len(state) // 2, r % 2 == 0
        said = ",".join(map(str, state[half:] if left else state[:half]))
        out = list(state)
        for i in range(len(state)):
            if (i < half) == left:
                drawn = int(hashlib.sha256(f"{key}|{r}|{i}|{said}".encode()).hexdigest()[:15], 16)
                out[i] = (state[i] + sign * drawn) % sizes[i]
        return out

    rows = [([1, 2, 3, 4, 5],), ([9, 25, 9, 6, 255],), ([0, 0, 0, 0, 0],)]
    column = ps.permuted(F.col("s"), F.array(*[F.lit(n).cast("long") for n in sizes]), key)
    for old, new in spark.createDataFrame(rows, "s array<long>").select("s", column).collect():
        state = list(old)
        for r in range(ps.ROUNDS):
            state = turn(state, r, 1)
        assert state == new
        for r in reversed(range(ps.ROUNDS)):
            state = turn(state, r, -1)
        assert state == old


def test_rows_columns_and_keys(spark, docs_of, mixed_texts, clashing):
    df = clashing(docs_of(mixed_texts))
    out = ps.pseudonymise(df, KEY)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted(df.collect(), key=str)  # nothing personal in these
    assert ps.pseudonymise(df.limit(0), KEY).count() == 0
    two = docs_of(["id 123-45-6789", "also 123-45-6789", None])
    made = {r.doc_id: r.text for r in ps.pseudonymise(two, KEY).collect()}
    assert made[0][3:] == made[1][5:] and made[2] is None
    assert ps.pseudonymise(two, "other").where("doc_id = 0").first().text != made[0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan



def plain_network(symbols, sizes, key):
    symbols, half = list(symbols), len(sizes) // 2
    for turn in range(ps.ROUNDS):
        left = turn % 2 == 0
        said = ",".join(map(str, symbols[half:] if left else symbols[:half]))
        for i, size in enumerate(sizes):
            if (i < half) == left:
                drawn = int(hashlib.sha256(f"{key}|{turn}|{i}|{said}".encode()).hexdigest()[:15], 16)
                symbols[i] = (symbols[i] + drawn % size) % size
    return symbols


def plain_pseudonym(value, key):
    def refilled(text, symbols, wanted):
        symbols = iter(symbols)
        return "".join(str(next(symbols)) if re.fullmatch(wanted, c) else c for c in text)

    kind = next(k for k, p in ps.PATTERNS.items() if re.fullmatch(p, value))
    digits = [int(c) for c in re.sub("[^0-9]", "", value)]
    if kind == "email":
        name, domain = value[: value.index("@")].lower(), value[value.rindex("@") + 1 :]
        chars = re.findall("[0-9a-z]", name)
        base = [48 if c.isdigit() else 97 for c in chars]
        moved = plain_network([ord(c) - b for c, b in zip(chars, base)] + [0], [10 if c.isdigit() else 26 for c in chars] + [1], f"{key}|email|")
        return refilled(name, [chr(m + b) for m, b in zip(moved, base)], "[0-9a-z]") + "@" + domain
    if kind == "card":
        if not luhn(value):
            return value
        head = [digits[0], *plain_network(digits[1:-1], [10] * (len(digits) - 2), f"{key}|card")]
        return refilled(value, with_check("".join(map(str, head))), "[0-9]")
    if kind == "phone":
        rest = digits[1:]
        low = [0] * 10 if rest[0] < 2 else [2, 0, 0, 2 if rest[3] >= 2 else 0, *[0] * 6]
        sizes = [2, *[10] * 9] if rest[0] < 2 else [8, 10, 10, 8 if rest[3] >= 2 else 2, *[10] * 6]
        moved = plain_network([d - b for d, b in zip(rest, low)], sizes, f"{key}|phone")
        return "+1" + refilled(value[2:], [d + b for d, b in zip(moved, low)], "[0-9]")
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return value
        new = plain_network([area - 2 if area > 666 else area - 1, group - 1, serial - 1], [898, 99, 9999], f"{key}|ssn")
        return f"{new[0] + 2 if new[0] >= 665 else new[0] + 1:03}-{new[1] + 1:02}-{new[2] + 1:04}"
    if kind == "address":
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return value
        low = 0 if parts[0] < 224 else 224
        new = plain_network([parts[0] - low, *parts[1:]], [224 if low == 0 else 32, 256, 256, 256], f"{key}|address")
        return ".".join(map(str, [new[0] + low, *new[1:]]))
    form = "%Y-%m-%d" if "-" in value else "%Y/%m/%d" if "/" in value else "%d.%m.%Y"
    try:
        day = datetime.datetime.strptime(value, form).date()
    except ValueError:
        return value
    of_year = day.timetuple().tm_yday
    if of_year < 366:
        year, moved = plain_network([day.year - 1900, of_year - 1], [200, 365], f"{key}|date")
        new = datetime.date(1900 + year, 1, 1) + datetime.timedelta(moved)
    else:
        new = plain_network([(day.year - 1904) // 28, (day.year - 1904) // 4 % 7], [7, 7], f"{key}|leap")
        new = datetime.date(1904 + 4 * (7 * new[0] + new[1]), 12, 31)
    return new.strftime(form)


def test_whole_documents_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    made = {r.doc_id: r.text for r in ps.pseudonymise(docs, KEY).collect()}
    changed = 0
    for row in docs.collect():
        want = row.text and re.sub(ps.ANY, lambda m: plain_pseudonym(m[0], KEY), row.text)
        assert made[row.doc_id] == want, row.doc_id
        changed += want != row.text
    assert changed > 20
