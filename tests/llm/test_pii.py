import hashlib
import random
import re

from runeflow.llm import pii, queries

RX = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for kind, rx in RX.items():
        for m in rx.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            )
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_plain_patterns():
    rnd = random.Random(4)
    for alphabet, n in (("a1.@+- ", 4000), ("0123456789 -", 1500), ("+1 ().-9", 2000), ("12.", 2000), ("a@.b", 3000)):
        for _ in range(n):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40)))
            assert pii.base_spans(t) == brute(t), t


def test_query_on_whole_table(spark):
    rows = {r.doc_id: r for r in queries.op4_pii(spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        want = brute(d.text or "")
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == w[0] for w in want) for k in RX)


def found(text):
    return {(k, text[a:b]) for k, a, b in pii.added_spans(text)}


def test_disguises_are_found_in_source_characters():
    assert ("email", "john [at] mail [dot] com") in found("write to john [at] mail [dot] com today")
    assert ("email", "john.doe (at) mail.example.org") in found("or john.doe (at) mail.example.org, please")
    assert ("email", "jane at example dot com") in found("I am jane at example dot com since May")
    assert ("email", "аnnа@mail.com") in found("my аnnа@mail.com box")
    assert ("email", "bob＠mail．com") in found("bob＠mail．com")
    assert ("phone", "plus one five five five two three four nine eight seven six") in found("call plus one five five five two three four nine eight seven six now")
    assert ("ip", "١٩٢.168.0.1") in found("host ١٩٢.168.0.1 down")
    digits = "four one one one " * 4
    assert any(k == "card" for k, _ in found("my card four one one one " + "one " * 12 + "end"))
    assert digits
    assert ("email", "sam@mail dot org") in found("sam@mail dot org")


def test_clean_prose_has_no_added_spans():
    for t in ("We met at noon. The dot is red.", "look at the map dot by dot", "one two buckle my shoe", "at [at] dot", "Straße über façade, naïve élan", "the price is one hundred two"):
        assert pii.added_spans(t) == [], t


def test_redaction_and_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "x a@b.co y +1 (509) 555-6973", "b"), (2, "", None)], "doc_id long, text string, spans string")
    out = {(r.doc_id, r.text) for r in pii.redact_pii(df).collect()}
    assert out == {(1, None), (2, "x [EMAIL] y [PHONE]"), (2, "")}
    assert pii.find_pii(df).columns.count("spans") == 1
    assert pii.find_pii(df.limit(0)).count() == 0


def test_long_digit_runs_are_linear():
    assert pii.base_spans("1" * 200_000 + "." + "2" * 100_000) == []
    assert pii.base_spans("a" * 300_000 + "@") == []


def test_the_trigger_is_never_narrower_than_the_patterns():
    for t in ("maria@correo(punto)es", "anna@firma[punkt]de", "joe <@> example.com", "joe [ @ ] example.com", "joe { at } example.com", "joe [  at   ] example.com", "joe (ARROBA) x.com", "a (  dot  ) b@c[ . ]de"):
        assert any(k == "email" for k, _, _ in pii.added_spans(t)), t
    assert any(k == "phone" for k, _, _ in pii.added_spans("+1 five 5 five 2 three 4 nine 8 seven 6"))
    rnd = random.Random(6)
    some = lambda *x: rnd.choice(x)
    gap = lambda: " " * some(0, 0, 1, 2, 5)
    mark = lambda *x: gap() + some("[({<", "[({<")[rnd.randrange(4)] + gap() + some(*x) + gap() + "])}>"[rnd.randrange(4)] + gap()
    dot = lambda: some(".", ".", mark("dot", ".", "Punto", "punkt"), gap() + some("dot", "punto") + gap())
    found = 0
    for _ in range(6_000):
        at = some("@", mark("at", "@", "ARROBA"), gap() + "at" + gap())
        t = some("", "joe" + dot()) + "ann" + at + "mail" + dot() + "com" + some("", " and ", dot() + "uk")
        if rnd.random() < 0.3:
            t = some("", "+1 ", "plus ") + "".join(some("one", "Two", "double", "nine", "5", "07") + some(" ", "", "-", ", ") for _ in range(16))
        want = pii.added_spans(t, [(0, len(t))])
        found += bool(want)
        assert pii.added_spans(t) == want, t
    assert found > 1000


def test_long_identifiers_are_not_cut():
    for n in (600, 5_000):
        t = "write to " + "a" * n + "[at]example.com now and then"
        assert ("email", 9, 9 + n + 15) in pii.added_spans(t)
        t = "x" * 50 + " " + "b" * n + ".c@mail" + "[dot]mail" * 300 + " dot com"
        assert ("email", 51, len(t)) in pii.added_spans(t)


def test_disguises_of_four_languages():
    assert ("email", "marie arobase exemple point fr") in found("Écrivez vite: marie arobase exemple point fr")
    assert ("email", "jose (arroba) correo punto es") in found("a jose (arroba) correo punto es hoy")
    assert ("email", "anna[klammeraffe]firma Punkt de") in found("an anna[klammeraffe]firma Punkt de schreiben")
    assert any(k == "phone" for k, _ in found("Tel. plus vier neun null drei null eins zwei drei vier fünf sechs"))
    assert any(k == "phone" for k, _ in found("tél plus trois trois un deux trois quatre cinq six sept huit neuf zéro"))
    assert any(k == "phone" for k, _ in found("tel más tres cuatro seis cero cero uno dos tres cuatro cinco seis"))


def test_windows_change_nothing(spark):
    """Around triggers in the tables' own texts, and between planted disguises, windows show what the whole text shows."""
    rnd = random.Random(12)
    plant = ["joe at mail dot com", "plus one two three four five six seven eight nine", "x[at]y.de", "four one one one " * 4, "a.b (at) c [dot] d", "١٩٢.168.0.1", "tel +1 five 5 five 2 three 4 nine", "dot", "at", "point"]
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect():
        w = (d.text or "")[:6000].split(" ")
        for _ in range(6):
            w.insert(rnd.randrange(len(w) + 1), rnd.choice(plant))
        t = " ".join(w)
        assert pii.added_spans(t) == pii.added_spans(t, [(0, len(t))])


def test_odd_texts_take_linear_time():
    for t in ("a." * 60_000 + "[at", "a dot " * 20_000, "[at] " * 20_000, "one, " * 30_000 + "x", "@" * 100_000 + " dot ", "(" * 50_000 + "at)", "é" * 100_000 + " dot com"):
        pii.added_spans(t)


def test_redaction_keeps_a_column_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "a@b.co", "keep me")], "doc_id long, text string, __redacted string")
    assert [tuple(r) for r in pii.redact_pii(df).collect()] == [(1, "[EMAIL]", "keep me")]
