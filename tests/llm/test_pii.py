import random
import re

import pytest

from pointloom.llm import pii

PATTERNS = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_is_the_plain_patterns():
    pick = random.Random(1)
    for _ in range(15000):
        text = "".join(pick.choice("aB0123456789..@@ -_%+()é12") for _ in range(pick.randint(0, 50)))
        assert pii.detect(text) == brute(text)


@pytest.mark.parametrize(
    "text,found,kind",
    [
        ("mail john.doe [at] example [dot] com now", "john.doe [at] example [dot] com", "email"),
        ("john at example dot com", "john at example dot com", "email"),
        ("é jоhn@exаmple.com ok", "jоhn@exаmple.com", "email"),
        ("x＠ｙ.com", "x＠ｙ.com", "email"),
        ("call plus one two one two five five five zero one nine nine please", "plus one two one two five five five zero one nine nine", "phone"),
        ("ip one nine two dot one six eight dot one dot one zero", "one nine two dot one six eight dot one dot one zero", "ip"),
        ("no 4111​1111 1111 1111.", "4111​1111 1111 1111", "card"),
    ],
)
def test_disguises_map_back_to_the_source(text, found, kind):
    base = pii.detect(text)
    extra = pii.added(text, base)
    assert [(text[a:b], pii.KINDS[k]) for a, k, b in extra] == [(found, kind)]


@pytest.mark.parametrize("text", ["my at the dot of ere", "the one at two dot three", "at the dot", "un deux trois soleil", "one two three"])
def test_plain_prose_is_left_alone(text):
    assert pii.added(text, pii.detect(text)) == []


def test_rows_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a@b.co 10.0.0.1"), (2, None), (None, ""), (3, "1" * 200_000 + "a." * 50_000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert got[1].spans == "email:0:6,ip:7:15" and (got[1].n_email, got[1].n_ip) == (1, 1)
    assert got[2].spans == "" and got[None].n_card == 0 and got[3].n_card == 0
    assert pii.find_personal_data(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,found",
    [
        ("write to john at example.com today", "john at example.com"),
        ("call +49 30 1234567 now", "+49 30 1234567"),
        ("no 4111–1111–1111–1111.", "4111–1111–1111–1111"),
        ("plus 5 5 5 5 5 5 5 5 five", "plus 5 5 5 5 5 5 5 5 five"),
        ("ip 1 point 2 point 3 point 4 ok", "1 point 2 point 3 point 4"),
        ("ask jane dot doe at mail dot com", "jane dot doe at mail dot com"),
        ("ask jane DOT m dot doe at mail.com", "jane DOT m dot doe at mail.com"),
    ],
)
def test_disguises_that_stand_alone(text, found):
    assert found in [text[a:b] for a, _, b in pii.added(text, pii.detect(text))]


def test_gate_loses_nothing(monkeypatch):
    pick = random.Random(7)
    parts = ["john", "a.b", "_at_", "_dot_", "192", "mail", "example", " at ", " AT ", " arroba ", " dot ", " Punkt ", ".", "com", "de", "@", "[at]", "(dot)", " ", "–", "​", "5", "five", "plus", " ", " ", "-", " point ", " dash ", "4111", "+49", "é", "а"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(1, 14))) for _ in range(20000)]
    own = [pii.added(x, pii.detect(x)) for x in texts]
    monkeypatch.setattr(pii, "disguised", lambda _: True)
    assert own == [pii.added(x, pii.detect(x)) for x in texts] and sum(map(bool, own)) > 100


def test_chains_of_spelled_dots_end():
    text = "a dot " * 50_000 + "a at b dot com"
    assert [text[a:b] == text for a, _, b in pii.added(text, [])] == [True] and pii.added("a at b " * 50_000, []) == []


def test_pieces_find_what_the_whole_text_holds():
    pick = random.Random(11)
    parts = ["something", "different", "contains", "Различные", "john at mail dot com", "jane [at]\nmail (dot) org", "plus four nine 1 2 3 4 5 6 7 8", "а@b.сom", "4111　1111　1111　1111", "192 dot 168 dot 1 dot 1", "it", "at", "dot", ".\n", "\n", "five"]
    for _ in range(60):
        text = " ".join(pick.choice(parts) for _ in range(300))
        base = pii.detect(text)
        whole = pii.added(text, base)
        assert len(whole) > 10 and pii.added(text, base, 40) == whole and len(list(pii.cuts(text, 40))) > 5


def test_memory_does_not_grow_with_a_disguised_text():
    import tracemalloc

    line = "something different contains john (at) mail (dot) com and а@b.сom here, something different again\n"
    peaks = []
    for times in (4_000, 40_000):
        text = line * times
        tracemalloc.start()
        spans = pii.added(text, [])
        peaks.append(tracemalloc.get_traced_memory()[1] - 200 * len(spans))
        tracemalloc.stop()
        assert len(spans) == 2 * times
    assert peaks[1] < 3 * peaks[0] + (20 << 20)


@pytest.mark.parametrize(
    "text,found,kind",
    [
        ("host 192 dot 168 dot 1 dot 1 up", "192 dot 168 dot 1 dot 1", "ip"),
        ("john at example dot dev", "john at example dot dev", "email"),
        ("write john_at_example_dot_com now", "john_at_example_dot_com", "email"),
        ("no ４１１１　１１１１　１１１１　１１１１.", "４１１１　１１１１　１１１１　１１１１", "card"),
        ("ip \U0001d7cf.\U0001d7d0.\U0001d7d1.\U0001d7d2 ok", "\U0001d7cf.\U0001d7d0.\U0001d7d1.\U0001d7d2", "ip"),
    ],
)
def test_further_disguises(text, found, kind):
    assert (found, kind) in [(text[a:b], pii.KINDS[k]) for a, k, b in pii.added(text, pii.detect(text))]


def test_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co", "x", 5), (1, "a@b.co", "y", 6)], "doc_id bigint, text string, spans string, n_email int")
    assert [(r.doc_id, r.spans, r.n_email) for r in pii.find_personal_data(df).collect()] == [(1, "email:0:6", 1)] * 2
