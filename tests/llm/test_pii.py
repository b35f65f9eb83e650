import datetime as dt
import random
import re

from pyspark.sql import functions as F

from lodestone.llm.pii import DAYS, FIRST_DAY, KINDS, Feistel, Pseudonyms, iban_rest, luhn, pseudonymised, replaced, scan


def out(text, key=b"k"):
    return replaced(text, Pseudonyms(key).find(text))


def test_feistel_permutes():
    f = Feistel(b"key")
    assert sorted(f.number(x, 10, 3, "t") for x in range(1000)) == list(range(1000))
    assert sorted(f.below(x, 777, "t") for x in range(777)) == list(range(777))
    assert all(f.number(f.number(x, 10, 5, "t"), 10, 5, "t", back=True) == x for x in range(0, 100_000, 997))
    assert f.word(f.word("ab9", "t"), "t", back=True) == "ab9" and len(f.digits("7", "t")) == 1
    assert [Feistel(b"a").digits("12345678", "t"), Feistel(b"b").digits("12345678", "t")] != [Feistel(b"a").digits("12345678", "t")] * 2
    assert all(0 <= f.below(d, DAYS, "date") < DAYS for d in (0, DAYS - 1)) and dt.date.fromordinal(FIRST_DAY) == dt.date(1900, 1, 1)


def test_formats_and_validity():
    r = random.Random(3)
    for _ in range(200):
        body = "".join(r.choice("0123456789") for _ in range(15))
        card = body + str(-luhn(body + "0") % 10)
        new = out(f"pay {card}.")[4:-1]
        assert re.fullmatch(r"\d{16}", new) and luhn(new) % 10 == 0 and new != card
        spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
        assert out(spaced).replace(" ", "") == new
        wrong = body + str((int(card[-1]) + 1) % 10)
        assert out(wrong) == wrong
        d = dt.date.fromordinal(FIRST_DAY + r.randrange(DAYS))
        for form in ("%Y-%m-%d", "%d.%m.%Y", "%Y/%m/%d"):
            assert dt.datetime.strptime(out(d.strftime(form)), form)
        assert dt.datetime.strptime(out(d.strftime("%Y-%m-%d")), "%Y-%m-%d") == dt.datetime.strptime(out(d.strftime("%d.%m.%Y")), "%d.%m.%Y") or d.day <= 12
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out("+1 (706) 555-3138")) and out("+1 (706) 555-3138") != "+1 (706) 555-3138"
    ip = out("at 97.51.17.173, ")
    assert re.fullmatch(r"at (\d{1,3}\.){3}\d{1,3}, ", ip) and max(map(int, re.findall(r"\d+", ip))) < 256
    iban = out("GB82 WEST 1234 5698 7654 32").replace(" ", "")
    assert iban.startswith("GB") and iban_rest(iban) == 1 and "WEST" in iban and iban != "GB82WEST12345698765432"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", out("123-45-6789")) and out("123-45-6789") != "123-45-6789"
    mail = out("to und.34@mail7.example.com geiev")
    assert re.fullmatch(r"to [a-z0-9]{3}\.[a-z0-9]{2}@mail7\.example\.com geiev", mail) and "und.34" not in mail


def test_what_is_not_valid_stays():
    for t in ["version 4.0.", "300.1.1.1", "2024-13-45", "1111111111111111", "12345", "3.14159", "id 000-12-3456", "a@b", "GB00WEST12345698765432", "1.2.3.4.5", "x1234567890123456", ""]:
        assert out(t) == t, t


def test_equal_values_stay_linked():
    a, b = out("a 97.51.17.173 b"), out("other\n97.51.17.173!")
    assert a.split()[1] == b.split()[1][:-1]
    assert out("97.51.17.173", b"k2") != out("97.51.17.173", b"k1")


def test_query_and_stage(spark, sf):
    rows = [(1, "mail und.34@mail7.example.com and 97.51.17.173", 10), (2, None, None), (3, "", 0), (None, "4111 1111 1111 1111 " * 2000, 1), (1, "mail und.34@mail7.example.com and 97.51.17.173", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("_rest", F.lit("clash")).withColumn("_found_", F.lit("x"))
    got = pseudonymised(docs)
    assert got.columns == [*docs.columns, "_found"] and got.count() == 5
    assert got.filter("doc_id = 1").distinct().count() == 1 and got.filter("doc_id = 2").first()["text"] is None
    assert got.filter("doc_id IS NULL").first()["_found"].count("card:") == 2000
    assert pseudonymised(docs.limit(0)).count() == 0
    own = spark.read.parquet(f"{sf}/documents.parquet")
    old = {r["doc_id"]: r["text"] for r in own.collect()}
    hits = 0
    for r in scan(own).collect():
        found = [s.split(":") for s in r["spans"].split(",") if s]
        assert [sum(k == f[0] for f in found) for k in KINDS] == [r[f"n_{k}"] for k in KINDS]
        assert r["text"] == replaced(old[r["doc_id"]], Pseudonyms(b"example key, replace it").find(old[r["doc_id"]]))
        for k, a, b in found:
            hits += 1
            assert old[r["doc_id"]][int(a) : int(b)] not in r["text"] or k == "date"
        if not found:
            assert r["text"] == old[r["doc_id"]]
    assert hits > 0


def test_mails_equal_the_pattern_and_stay_linear():
    import time

    from lodestone.llm.pii import _MAIL, mails

    r = random.Random(14)
    for _ in range(3000):
        t = "".join(r.choice("ab1é_.%+- @@.c") for _ in range(r.randint(0, 40)))
        assert [m.span() for m in mails(t)] == [m.span() for m in _MAIL.finditer(t)]
    began = time.time()
    assert len(list(mails("a" * 1_000_000 + " me@host.org " + "a.b" * 300_000 + "@" + "c." * 300_000))) == 1
    assert Pseudonyms(b"k").find("x" * 1_000_000) == [] and time.time() - began < 5


def test_finder_against_plain_rules():
    """Values set into plain words are found where they were put, of their kind, and nothing else is."""
    r = random.Random(15)
    made = {
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "ssn": lambda: f"{r.randint(100, 600):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
        "date": lambda: f"{r.randint(1950, 2020)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        "email": lambda: f"u{r.randint(1, 999)}.x@host{r.randint(1, 9)}.org",
    }
    for _ in range(400):
        text, want = "", []
        for _ in range(r.randint(0, 6)):
            text += r.choice(["words ", "and, more; ", "\n", "é "])
            kind = r.choice(sorted(made))
            value = made[kind]()
            want.append((len(text), len(text) + len(value), kind))
            text += value + " "
        assert [x[:3] for x in Pseudonyms(b"k").find(text)] == want


def test_phones_are_linked_however_they_are_written():
    import re

    from lodestone.llm.pii import Pseudonyms, country_code, replaced

    names = Pseudonyms(b"k")
    for code, spellings in {
        "44": ["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+44 (20) 7946 0958", "+44.20.7946.0958"],
        "1": ["+1 212 555 0143", "+12125550143", "+1-212-555-0143"],
        "353": ["+353 1 555 0143", "+35315550143"],
    }.items():
        new = [re.sub(r"\D", "", replaced(t, names.find(t))) for t in spellings]
        assert len(set(new)) == 1 and new[0].startswith(code) and len(new[0]) == len(re.sub(r"\D", "", spellings[0])), new
        assert new[0] != re.sub(r"\D", "", spellings[0])
    assert [country_code(x) for x in ("4420", "12125", "79161", "35315", "8613")] == ["44", "1", "7", "353", "86"]
