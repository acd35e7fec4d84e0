import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from wayline.llm import pii


def brute(text):
    out = {}
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    spans = lambda p, ok: [m.span() for m in re.finditer(p, text) if ok(m[0])]
    out["email"] = spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)
    out["ip"] = spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split(".")))
    out["card"] = spans(r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)))
    out["phone"] = spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("ab@.-+1250 ()_%é", max_size=60))
def test_detectors_are_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_disguises_map_back():
    for text, kind, part in [
        ("write to jane (at) example (dot) org now", "email", "jane (at) example (dot) org"),
        ("it is jane.d at mail dot example dot com, yes", "email", "jane.d at mail dot example dot com"),
        ("mail jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("ip 10 dot 0 dot 0 dot 17!", "ip", "10 dot 0 dot 0 dot 17"),
        ("card ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
        ("call +1 five five five 0 one two three four five now", "phone", "+1 five five five 0 one two three four five"),
        ("call plus four nine drei null fünf five 55 1234 ok", "phone", "plus four nine drei null fünf five 55 1234"),
        ("é é ann​@example.org é", "email", "ann​@example.org"),
    ]:
        base = pii.base_spans(text)
        more = pii.added_spans(text, base)
        assert [text[a:b] for a, b in more[kind] if (a, b) not in base[kind]] == [part], (text, more)
    for clean in ("we looked at example.com dot", "meet at one point two", "the dot at the end"):
        assert not any(pii.added_spans(clean, pii.base_spans(clean)).values())


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "é a@b.co 1.2.3.4 " * 3), (3, "x (at) y.org"), (4, "9" * 200_000 + "a" * 200_000 + "@"), (None, "+1 (624) 555-2408")]
    out = pii.find_pii(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")).collect()
    assert [r.n_email for r in out] == [0, 0, 3, 0, 0, 0] and out[3].spans == "email:0:12" and out[5].n_phone == 1
    assert out[0].base_sha256 == hashlib.sha256(b"").hexdigest()


DISGUISES = [
    ("call plus 49 170 1234567 now", "phone", "plus 49 170 1234567"),
    ("call +1 555 one two three 4567 now", "phone", "+1 555 one two three 4567"),
    ("call +1 555 12 three 4567 now", "phone", "+1 555 12 three 4567"),
    ("card 4111 1111 1111 111 one.", "card", "4111 1111 1111 111 one"),
    ("ip one.two.three.four", "ip", "one.two.three.four"),
    ("call +๑๒ ๓๔๕ ๖๗๘๙ now", "phone", "+๑๒ ๓๔๕ ๖๗๘๙"),
    ("call +১২ ৩৪৫ ৬৭৮৯ now", "phone", "+১২ ৩৪৫ ৬৭৮৯"),
    ("call +𝟏𝟐 𝟑𝟒𝟓 𝟔𝟕𝟖𝟗 now", "phone", "+𝟏𝟐 𝟑𝟒𝟓 𝟔𝟕𝟖𝟗"),
    ("ip 10.0.0.ſix", "ip", "10.0.0.ſix"),
    ("jane@mail\u2003dot\u2003org", "email", "jane@mail\u2003dot\u2003org"),
    ("jane(\tat\t)mail.org", "email", "jane(\tat\t)mail.org"),
]


def test_disguises_are_found_in_texts_with_nothing_else(spark):
    rows = [(k, t) for k, (t, _, _) in enumerate(DISGUISES)]
    got = {x.doc_id: x for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (t, kind, part) in enumerate(DISGUISES):
        a = t.index(part)
        assert f"{kind}:{a}:{a + len(part)}" in got[k].spans.split(",") and got[k].n_added, (t, got[k])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("plus|one|TWO|ſix|sİx|zéro|un|12| |\t|\u2003|(|)|at|dot|.|@|+|a|–|๑|é|-|,|​".split("|")), max_size=14).map("".join))
def test_trigger_and_rewritten_agree_with_normalise(text):
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = pii.normalise(text)[0]
    assert pii.rewritten(text) == plain
    assert plain == text or pc.match_substring_regex(pa.array([text]), pii.TRIGGER)[0].as_py()
