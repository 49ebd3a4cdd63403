import ipaddress
import random

import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import pii

from .samples import SCHEMA, awkward, frame

TEXTS = [
    "call +1 (974) 555-3436 or 1-974-555-3436 now, mail Bob.55@mail9.example.com and BOB.55@MAIL9.EXAMPLE.COM!!",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ip 97.51.17.173, 192.168.3.4 card 4111 1111 1111 1111 4111111111111111 4845168114407329',
    "Mr. Smith met Mary Smith and Frau Müller; John Smith. Госпожа Анна Петрова и Иван Петров. SSN 123-45-6789 DE89370400440532013000",
    "nothing 12 here 2024-01-02 999.999.1.1 v1.2.3.4.5 +1 2 a@b", "again bob.55@mail9.example.com", "(974) 555-3436 (974) 555-3437",
    "MRS 4111-1111-1111-1111### 10.1.2.3!! password: hunter2hunter", "10.1.2.3" * 3, "x1@y.de x2@y.de x1@y.de",
]
PYTHON = regex.compile(pii.ANY.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))


def rows():
    return awkward() + [(600 + n, t) for n, t in enumerate(TEXTS)] + [(700 + n, f"hot one hot@mail.example.org number {n}") for n in range(300)]


@pytest.fixture(scope="module")
def replaced(spark):
    return pii.replace_pii(frame(spark, rows()), "key").collect()


def pairs(replaced):
    """(original, surrogate) of every occurrence, found by the unchanged text around them."""
    before = {}
    for i, t in rows():
        before.setdefault(i, []).append(t)
    out = []
    for r in replaced:
        options = []
        for t in before[r.doc_id]:
            if t is None:
                options.append([] if r.text is None else None)
                continue
            found = [m.group() for m in PYTHON.finditer(t)]
            gaps, last = [], 0
            for m in PYTHON.finditer(t):
                gaps.append(t[last:m.start()])
                last = m.end()
            gaps.append(t[last:])
            slots = [r"([^ ]+?(?: [^ ]+?){%d})" % f.count(" ") for f in found] + [""]  # surrogates have as many words
            whole = regex.fullmatch("".join(regex.escape(g) + s for g, s in zip(gaps, slots)), r.text or "", regex.S)
            options.append(list(zip(found, whole.groups())) if whole and len(found) == r.n_entities else None)
        good = [o for o in options if o is not None]
        assert good, r
        out += good[0]
    return out


def test_only_entities_change(replaced):
    assert len(replaced) == len(rows()) and len(pairs(replaced)) > 320


def test_kinds_formats_and_coreference(replaced):
    shown = dict(pairs(replaced))
    shape = lambda s: regex.sub(r"[a-z]", "a", regex.sub(r"[A-Z]", "A", regex.sub(r"\d", "9", s)))
    for old, new in shown.items():
        assert old != new
        if regex.fullmatch(r"[\d.]+", old):
            assert ipaddress.ip_address(new).is_private == ipaddress.ip_address(old).is_private if "." in old else len(new) == len(old)
        elif regex.search(r"@|\d", old) and "token" not in old:
            assert shape(new) == shape(old) or regex.fullmatch("[0-9a-f]+", new)
    digits = lambda s: regex.sub(r"\D", "", s)
    assert digits(shown["+1 (974) 555-3436"]) == digits(shown["1-974-555-3436"])
    assert shown["Bob.55@mail9.example.com"].lower() == shown["bob.55@mail9.example.com"] == shown["BOB.55@MAIL9.EXAMPLE.COM"].lower()
    card = shown["4111111111111111"]
    assert digits(shown["4111 1111 1111 1111"]) == card == digits(shown["4111-1111-1111-1111"])
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert shown["192.168.3.4"].startswith("192.168.")
    surname = shown["Mr. Smith"].split()[1]
    assert shown["Mr. Smith"].startswith("Mr. ") and shown["Mary Smith"].split()[1] == surname == shown["John Smith"].split()[1]
    assert shown["Mary Smith"].split()[0] in pii.GIVEN["f", "latin"] and shown["John Smith"].split()[0] in pii.GIVEN["m", "latin"]
    assert shown["Госпожа Анна Петрова"].startswith("Госпожа ") and regex.fullmatch(r"[\p{Cyrillic} ]+", shown["Иван Петров"])


def test_same_key_same_result_other_key_other(spark, replaced):
    again = {(r.doc_id, r.text) for r in pii.replace_pii(frame(spark, rows()), "key").collect()}
    assert again == {(r.doc_id, r.text) for r in replaced}
    other = {(r.doc_id, r.text) for r in pii.replace_pii(frame(spark, rows()), "other").collect()}
    assert other != again


def test_surrogates_are_distinct_and_new(spark):
    rng = random.Random(3)
    real = {f"172.16.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(3000)}  # dense: many first draws collide
    names = {a + b for a in "abcdefghijklmnopqrst" for b in ("lo", "mi", "ra", "ken")}
    rows = [("ip", x) for x in real] + [("given_f_latin", x) for x in names] + [("surname_latin", x) for x in names]
    entities = spark.createDataFrame(rows, "kind string, norm string")
    got = pii.surrogates(entities, "key").collect()
    assert {(r.kind, r.norm) for r in got} == set(rows) and len(got) == len(rows)
    assert len({(r.kind, r.new) for r in got}) == len(rows)
    assert not {(r.kind, r.new) for r in got} & set(rows)


@pytest.fixture
def bounded(monkeypatch):
    """Fails where surrogates are drawn again without end."""
    rounds, written = iter(range(12)), pii.written

    def counted(*args):
        assert next(rounds, None) is not None, "no end"
        return written(*args)
    monkeypatch.setattr(pii, "written", counted)


def test_blank_secret_fields_stay(spark, bounded):
    blanks = ["Password: ________", "token: --------", "secret = ////////", "api_key: +-/_+-/_+-"]
    real = [f"Password: ________{n}" for n in range(10)]  # all values of their shape
    out = [r.text for r in pii.replace_pii(frame(spark, list(enumerate(blanks + real))), "key").orderBy("doc_id").collect()]
    assert out[:4] == blanks
    assert len(set(out[4:])) == 10 and not set(out[4:]) & set(real) and all(regex.fullmatch("Password: ________[0-9][a-z]+", t) for t in out[4:])


@pytest.mark.parametrize("kind, real", [
    ("ip", [f"192.168.{a}.{b}" for a in range(256) for b in range(256)]),
    ("email", [f"{a}@{b}.de" for a in "0123456789" for b in "0123456789"]),
    ("secret", ["________"]),
])
def test_full_shapes_widen(spark, bounded, kind, real):
    got = {r.norm: r.new for r in pii.surrogates(spark.createDataFrame([(kind, x) for x in real], "kind string, norm string"), "key").collect()}
    assert set(got) == set(real) and len(set(got.values())) == len(real) and not set(got.values()) & set(real)
    if kind == "ip":
        assert all(ipaddress.ip_address(x).is_private for x in got.values())
    if kind == "email":
        assert all(regex.fullmatch(pii.PATTERNS["email"], x) for x in got.values())


@pytest.mark.parametrize("kind, norm, shown", [
    ("email", "bob@x.de", "Bob@x.de"), ("secret", "hunter2hunter", "Hunter2Hunter"), ("phone", "9745553436", "(974) 555-3436"), ("ssn", "123456789", "123-45-6789"),
    ("card", "4111111111111111", "4111 1111 1111 1111"), ("iban", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"), ("ip", "10.1.2.3", "10.1.2.3"),
    ("ip", "8.8.8.8", "8.8.8.8"),
])
def test_widened_surrogates_are_shown_whole(spark, kind, norm, shown):
    rows = spark.createDataFrame([(kind, norm, n) for n in range(3, 9)], "kind string, norm string, attempt int")
    drawn = pii.draw(rows, "key").withColumn("shown", F.lit(shown)).withColumn("out", F.expr(pii._shown("kind", "new", "shown"))).collect()
    bare = lambda x: regex.sub("[^0-9a-z]", "", x.lower())
    for r in drawn:
        assert bare(r.out) == bare(r.new) and (kind == "ip" or len(r.new) == len(norm) + r.attempt - 2)
        if kind == "ip":
            assert ipaddress.ip_address(r.out).version == (6 if r.attempt >= 6 else 4)
        if kind == "card":
            assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(r.new))) % 10 == 0


PHONES = ["+49 30 1234567", "+33 1 23 45 67 89", "+44 20 7946 0958", "+34 912 34 56 78", "+34 612 345 678", "030 12345678", "01 23 45 67 89",
          "+44 (0)20 7946 0958", "0049 30 1234567", "030/1234567", "(020) 7946 0958", "0161 496 0000", "01.23.45.67.89", "912 34 56 78", "+49 (30) 1234567"]
PERSONS = ["Emily Clark", "Jürgen Vogel", "Émile Zola", "Élodie Dupont", "Álvaro Ruiz", "Борис Годунов"]
KEPT = ["on 01-02-2024 12:30", "2024-01-02 03.04.05", "1 234 567", "612 345 678", "in 030 cases", "version 01.02.03", "0.1234 5678", "Open Source", "nothing here"]


def test_phones_of_other_countries_and_more_names(spark):
    out = [r.text for r in pii.replace_pii(frame(spark, list(enumerate([f"x {p} y" for p in PHONES] + PERSONS + KEPT))), "key").orderBy("doc_id").collect()]
    for old, new in zip(PHONES, out):
        assert regex.sub(r"\d", "9", new) == regex.sub(r"\d", "9", f"x {old} y") and new != f"x {old} y"
        assert regex.match(r"\+..|0?", old).group() == regex.match(r"\+..|0?", new[2:].lstrip("(") if old[0] != "(" else new[2:]).group()
    digits = [regex.sub(r"\D", "", t) for t in out]
    assert digits[PHONES.index("0049 30 1234567")] == "00" + digits[0] == "00" + digits[PHONES.index("+49 (30) 1234567")]
    assert digits[PHONES.index("+44 (0)20 7946 0958")] == "440" + digits[2][2:]
    assert digits[PHONES.index("01.23.45.67.89")] == digits[6]
    n = len(PHONES)
    for old, new in zip(PERSONS, out[n:]):
        assert len(new.split()) == 2 and not set(old.split()) & set(new.split())
    assert out[n + len(PERSONS):] == KEPT


def test_native_and_columns_kept(spark):
    docs = frame(spark, rows()).withColumn("n_entities_before", F.lit(1)).withColumnRenamed("k", "matches").withColumnRenamed("bucket", "kind")
    out = pii.replace_pii(docs, "key")
    assert out.columns == [*docs.columns, "n_entities"]
    clash = docs.withColumn("n_entities", F.lit("mine"))
    out = pii.replace_pii(clash, "k")
    assert out.columns == [*clash.columns, "n_entities_"] and {r.n_entities for r in out.select("n_entities").distinct().collect()} == {"mine"}
    assert pii.replace_pii(clash, "k", count=None).columns == clash.columns
    assert not any(w in out._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))
    keep = [c for c in docs.columns if c != "text"]
    assert sorted(map(str, out.select(*keep).collect())) == sorted(map(str, docs.select(*keep).collect()))


def test_empty_table(spark):
    assert pii.replace_pii(spark.createDataFrame([], SCHEMA), "key").count() == 0
