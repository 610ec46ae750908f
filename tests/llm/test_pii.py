import hashlib
import random
import re

from proselab.llm import pii as P

from .helpers import awkward_rows, frame

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I4 = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
H = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def base(t):
    return {
        "email": [m.span() for m in E.finditer(t)],
        "ip": [m.span() for m in I4.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in C.finditer(t) if 16 <= len(digits(m.group())) <= 19 and P.luhn(digits(m.group()))],
        "phone": [m.span() for m in H.finditer(t) if 8 <= len(digits(m.group())) <= 15],
    }


def test_fixed_detectors_equal_the_patterns():
    rng = random.Random(4)
    for letters in (" ab@.-1+", "0123456789.- +()", "@a.@b", "01."):
        for _ in range(4000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 45)))
            assert P.detect(t) == base(t)


def found(t):
    return {k: [t[a:b] for a, b in v] for k, v in P.find_all(t)[1].items() if v}


def test_disguises_map_back_to_the_source():
    assert found("mail john.doe [at] example [dot] com now") == {"email": ["john.doe [at] example [dot] com"]}
    assert found("to john at example dot com, please") == {"email": ["john at example dot com"]}
    assert found("x jоhn@exаmple.com y") == {"email": ["jоhn@exаmple.com"]}
    assert found("call plus one five five five one two three four") == {"phone": ["plus one five five five one two three four"]}
    assert found("at one nine two dot one six eight dot one dot one ok") == {"ip": ["one nine two dot one six eight dot one dot one"]}
    assert found("４" + "１" * 15) == {"card": ["４" + "１" * 15]}
    # base spans stay, and nothing overlaps them
    t = "a@b.co and +1 555 123 4567"
    assert P.find_all(t)[0] == P.find_all(t)[1] == base(t)


def test_fragments_do_not_hide_the_whole():
    # (text, the undisguised part that the fixed detectors find, the whole)
    cases = [
        ("jоhn@example.com", "hn@example.com", "email"),
        ("john@example.cоm", "john@example.c", "email"),
        ("jo\u200bhn@example.com", "hn@example.com", "email"),
        ("+1 555 123 45６6 78", "+1 555 123 45", "phone"),
        ("+1 555 123 45 six seven", "+1 555 123 45", "phone"),
        ("192.168.1.1０", "192.168.1.1", "ip"),
    ]
    for whole, part, kind in cases:
        t = f"x {whole} y"
        base, every = P.find_all(t)
        assert [t[a:b] for a, b in base[kind]] == [part]
        assert sorted(t[a:b] for a, b in every[kind]) == sorted([part, whole])
        assert P.mask_text(t) == f"x <{kind.upper()}> y"
    # punctuation and number words of the prose are no part of a plain span
    for t in ("です。john@example.com", "+1 555 123 4567, one of us", "1.2.3.4, two of three", "at 1.2.3.4 one sees", "one 1.2.3.4 dot"):
        base, every = P.find_all(t)
        assert base == every


def test_disguised_dots_and_ats_anywhere_in_an_address():
    for t in (
        "john dot doe at example dot com", "john [dot] doe [at] example [dot] com", "j (dot) m (dot) doe (at) example.com", "john @ example dot com",
        "john [@] example [dot] com", "x (at) y [.] com", "a [.] b {at} c [.] d", "john[.]doe@example.com", "john [ dot ] doe@example.com", "john[.]doe at example.com",
        "john   (   dot   )   doe@example.com",
    ):
        assert P.find_all(f"to {t}, then")[1]["email"][-1] == (3, 3 + len(t)), t
        assert P.mask_text(f"to {t}, then") == "to <EMAIL>, then"
    # one address begins where another ends
    assert P.mask_text("a at b dot c at d dot e") == "<EMAIL> at d dot e"
    for t in ("lunch @ noon.today is fine", "the dot is at example.com", "thanks @user and @other.", "see [.] and (@) here", "meet at noon . dot", "we are @ home (at last)"):
        assert P.mask_text(t) == t
    for t in ("a dot " * 40_000 + "b at c dot d", "a[.]" * 50_000 + "b[at]c.d", "a[.]b at " * 20_000, " @ " * 60_000, "[@]" * 60_000 + "[.]" * 60_000, "a at b dot " * 20_000, "a@b.c dot " * 20_000):
        P.find_all(t)


def test_prose_is_left_alone():
    for t in ("look at that dot", "one or two of three", "we met at noon. dot", "seven eight nine", "It was at the end (at last)", "Ответ на вопрос"):
        assert found(t) == {}
        assert P.mask_text(t) == t


def test_long_texts_end_quickly():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 200_000, "+1" + "(" * 200_000, " " * 200_000, "one " * 20_000, "a@" * 60_000, "[at]" * 60_000):
        P.find_all(t)


def test_awkward_rows(spark):
    rows = awkward_rows() + [(800, "a@b.co a@b.co 1.2.3.4, 4111 1111 1111 1111, +1 (555) 123-4567"), (801, "me [at] x [dot] org")]
    out = P.find(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    want = []
    for i, t in rows:
        b = base(t or "")
        s = ",".join(f"{k}:{x}:{y}" for k in P.KINDS for x, y in b[k])
        want.append((i, *(len(b[k]) for k in P.KINDS), hashlib.sha256(s.encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in out], key=repr) == sorted(want, key=repr)
    spans = {r["doc_id"]: r["spans"] for r in out}
    assert spans[800] == "email:0:6,email:7:13,ip:14:21,card:23:42,phone:44:61"
    assert spans[801] == "email:0:19"
    masked = {r["doc_id"]: r for r in P.mask(frame(spark, rows)).collect()}
    assert masked[800]["text"] == "<EMAIL> <EMAIL> <IP>, <CARD>, <PHONE>" and masked[800]["score"] == "x"
    assert masked[0]["text"] is None
    assert P.find(frame(spark, [])).collect() == [] and P.mask(frame(spark, [])).collect() == []


def test_disguised_dots_in_numbers():
    for t in ("192[.]168[.]1[.]10", "192 dot 168 dot 1 dot 10", "10(dot)0(dot)0(dot)1", "192.168[.]1.10", "10 punto 0 punto 0 punto 1", "10 { point } 0.0.1"):
        assert found(f"host {t} is up") == {"ip": [t]}, t
        assert P.mask_text(f"host {t} is up") == "host <IP> is up"
    for t in ("version 1[.]2[.]3", "1 point 5 point 2", "300[.]1[.]1[.]1", "1 dot 2 dot 3", "1[.]2[.]3[.]4000"):
        assert found(t) == {}, t


def test_words_of_other_languages():
    for t in ("ana arroba correo punto es", "jean point dupont arobase mail point fr", "max [klammeraffe] web [punkt] de", "ana (arroba) correo.es", "a.b [at] web [punkt] de"):
        assert found(f"an: {t}, ok") == {"email": [t]}, t
    for t in (
        "plus four four double zero seven seven one two three four five", "plus vier neun drei null eins zwei drei vier fünf",
        "plus trois trois un deux trois quatre cinq six sept", "más tres cuatro seis cero cero uno dos tres cuatro", "+4 triple zero 1234 zwo",
    ):
        assert found(f"({t})") == {"phone": [t]}, t
    for t in (
        "he arrived at this point and left", "at that point com", "una arroba de trigo", "un punto y aparte", "dos o tres casas, cuatro o cinco perros",
        "un deux trois quatre cinq six sept huit", "der Punkt ist klar", "double or triple", "double six seven",
    ):
        assert found(t) == {}, t
    for t in ("a punto " * 40_000 + "b arroba c punto d", "arroba " * 60_000, "1 dot " * 60_000, "double " * 60_000, "double one " * 30_000, "a[punkt]" * 40_000 + "b[arroba]c.d"):
        P.find_all(t)


def test_mask_keeps_columns_of_any_name(spark):
    row = ("m", "n", "t", "o", 7, "a.b@c.de", "d")
    df = spark.createDataFrame([row, (*row[:5], None, "d")], "masked string, `__null` string, `__text` string, aside string, others int, text string, `a.b` string")
    out = P.mask(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(*row[:5], "<EMAIL>", "d"), (*row[:5], None, "d")], key=repr)
    assert [tuple(r) for r in P.mask(df.select("text")).collect()] == [("<EMAIL>",), (None,)]
