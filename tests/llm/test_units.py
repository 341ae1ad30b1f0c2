"""Fast checks of the operators' parts, without Spark where they need none."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recollect.llm import exchange, hnsw, html, jaccard, katz, pii, sharding, tokens
from recollect.llm.logistic import Logistic

TEXT = st.text(alphabet="aAbé \n\t.@1ñ漢", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_tokens_are_the_words(texts):
    column = pa.array(texts, pa.string())
    for table, pattern in ((tokens.WHITESPACE_WORDS, r"[^\x20\x09-\x0d]+"), (tokens.ALNUM_WORDS, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        t = tokens.tokenise(column, table)
        for i, text in enumerate(texts):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            want = [w.encode() for w in re.findall(pattern, low)]
            assert [t.word(j) for j in range(t.first[i], t.first[i + 1])] == want
        words = [t.word(j) for j in range(len(t.starts))]
        assert len(set(words)) == len(set(t.hashes.tolist()))
        assert all((a == b) == (t.hashes[i] == t.hashes[j]) for i, a in enumerate(words) for j, b in enumerate(words))


def test_long_words_and_blocks():
    word = "x" * (3 * tokens.BLOCK)
    t = tokens.tokenise(pa.array([word + " a", "a " + word]), tokens.WHITESPACE_WORDS)
    assert t.hashes[0] == t.hashes[3] and t.hashes[1] == t.hashes[2]


def test_chunks_keep_rows():
    texts = ["a" * n for n in (5, 0, 30, 1, 1, 100, 3)] + [None]
    batches = pa.table({"t": texts, "i": range(8)}).to_batches(max_chunksize=3)
    out = list(tokens.chunks(iter(batches), "t", 32))
    assert [x for b in out for x in b.column("i").to_pylist()] == list(range(8)) and len(out) > 2


@given(st.lists(st.integers(0, 2**62), max_size=30))
def test_packing(values):
    assert exchange.unpack(exchange.pack(np.array(values, np.int64))).tolist() == values
    doubles = np.array(values, float) / 7
    assert exchange.unpack_doubles(exchange.pack_doubles(doubles)).tolist() == doubles.tolist()


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_sketches_miss_no_similar_pair(percent):
    rng = np.random.default_rng(1)

    class Two:
        pass

    for n in (1, 2, 3, 4, 5, 7, 11, 12, 13, 40, 130, 350, 900):
        for _ in range(12):
            base = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
            drop, add = rng.integers(0, max(1, n // 6) + 1, 2)
            other = np.concatenate([base[drop:], rng.integers(0, 2**63, add, dtype=np.int64).astype(np.uint64)])
            a, b = np.unique(base), np.unique(other)
            common = len(np.intersect1d(a, b))
            if not len(b) or 100 * common < percent * (len(a) + len(b) - common):
                continue
            s = Two()
            s.items, s.n, s.at = np.concatenate([a, b]), np.array([len(a), len(b)]), np.array([0, len(a), len(a) + len(b)])
            for level in (1, 2) if n > 12 else (1,):
                keys, owner = jaccard.sketch_keys(s, np.array([0, 1]), percent, level=level)
                assert len(np.intersect1d(keys[owner == 0], keys[owner == 1])) >= (level if common < len(a) or len(a) != len(b) else 1)
            x, y = (np.frombuffer(p, np.uint64) for p in jaccard.parities(s))
            assert jaccard.within(x, y, len(a) + len(b), percent)


def test_discounts_leave_what_is_seldom():
    d = katz.Discount.of(np.array([0, 100, 40, 20, 12, 8, 5]))
    assert (d.factor[1:] > 0).all() and (d.factor[1:] < 1).all() and d(np.array([9]))[0] == 1
    assert katz.Discount.of(np.zeros(7)).factor.tolist() == [0, 0.5]
    w = katz.Words.of(100, 10, np.array([0, 3, 2, 0, 0, 0, 0]), 4)
    assert 0 < w.unknown < 1


def test_ring_moves_little_and_fills_evenly():
    points = sharding.ring(8, 64)
    more = sharding.ring(9, 64)
    assert set(points) < set(more)
    counts = {i: (i * 37) % 11 for i in range(len(points))}
    total = sum(counts.values())
    pieces = sharding.fill(points, 8, counts)
    sizes = [0] * 8
    slots = [set() for _ in range(8)]
    for arc, n in counts.items():
        at = 0
        for last, s, base in pieces[arc]:
            for rank in range(at, last + 1):
                slots[s].add(rank + base)
            sizes[s] += last + 1 - at
            at = last + 1
        assert at == n
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == total
    assert all(x == set(range(n)) for x, n in zip(slots, sizes, strict=True))
    stay = sum(n for arc, n in counts.items() for p in pieces[arc][:1] if p[1] == points[arc][1])
    assert stay > 0.7 * total


def test_graph_finds_neighbours():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    x[:300] = x[0] + 0.05 * rng.normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.build(x, tokens.mix(np.arange(1500, dtype=np.uint64)))
    ids, cos = g.search(x[::10].astype(np.float32), 48)
    true = np.argsort(-(x[::10] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) > 0.9
    assert [len(hnsw.build(x[:n], tokens.mix(np.arange(n, dtype=np.uint64))).search(x[:n].astype(np.float32), max(1, n))[0]) for n in (1, 2, 5)] == [1, 2, 5]


PAGES = {
    "": "",
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b<br>c</div>": "a\nb\nc",
    "<ul><li>x<li>y<ul><li>z</ul></ul>": "- x\n- y\n  - z",
    "<ol start=4><li>a<li>b</ol>": "4. a\n5. b",
    "<table><tr><th>n<th>value<tr><td>long one<td>2</table>": "n        | value\nlong one | 2",
    "<p hidden>a</p><p style='display:none'>b</p><script>c</script><style>d</style><!-- e --><title>f</title>g": "g",
    "a <b>b</b>\n c &amp; 1 < 2": "a b c & 1 < 2",
    "<pre>a\n  b</pre>c": "a\n  b\n\nc",
    "<details><summary>s</summary>t</details>": "s",
    "<table><tr><td>a<table><tr><td>b</table>c</table>d": "a\n\nb\n\nc\n\nd",
    "</p></div>x</b>": "x",
    "<a href='x>y'>z</a>": "z",
}


@pytest.mark.parametrize("page", PAGES)
def test_rendering(page):
    assert html.render(page) == PAGES[page]


VISIBLE = {
    "a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> b": "a x=1 b",
    "<svg><title>t</title><desc>d</desc><defs><text>e</text></defs><path/><g><text>one</text><text>two <tspan>x</tspan></text></g>z</svg>f": "one\ntwo x\nf",
    "<svg><foreignObject><p>in</p></foreignObject></svg><svg hidden><text>no</text></svg>out": "in\n\nout",
    "<select><option>red<option selected>green</select>c<datalist><option>no</datalist>": "red\ngreen\nc",
    "<textarea>\na &amp; <b>\n  c</textarea>d": "a & <b>\n  c\nd",
    "<div HIDDEN>a</div><p STYLE='DISPLAY:NONE'>b</p><p Style='VISIBILITY: Hidden'>c</p><i ARIA-HIDDEN=TRUE>d</i>e": "e",
}


@pytest.mark.parametrize("page", VISIBLE)
def test_rendering_of_visible_and_hidden_elements(page):
    assert html.render(page) == VISIBLE[page]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<details>", "<pre>", "</pre>", "<div hidden>", "</div>", "w", "<", ">", "<!--", "-->", "<br>", "<dd>", "</td>", "</tr>", "<script>", "</script>"]), max_size=30))
def test_rendering_never_fails(parts):
    html.render("".join(parts))


def test_rendering_time_does_not_explode():
    began = time.time()
    for page in ("<div>" * 20000, "<" * 50000, "<a b='" * 3000, "<!--" * 20000, "<p>" * 5000 + "<table>" * 500):
        html.render(page)
    assert time.time() - began < 30


def test_rendering_time_is_linear_in_open_elements():
    def seconds(n):
        began = time.process_time()
        assert html.render("<b>" * n + "<td>x" * n + "</i>" * n).count("x") == n
        return time.process_time() - began

    assert seconds(16000) < 8 * max(seconds(4000), 0.05)


def stack_events(page):
    """The tree builder's rules, by looking through the open elements one by one."""
    stack, out = [], []

    def close(n):
        for _ in range(n):
            out.append(("close", stack.pop(), ""))

    def reach(tags, stops):
        found = 0
        for i, t in enumerate(reversed(stack), 1):
            if t in tags:
                found = i
            elif t in stops:
                break
        return found

    for kind, tag, more in html._tokens(page):
        if kind == "text":
            out.append((kind, tag, more))
        elif kind == "open":
            close(max(reach({"p"}, html.SCOPE) if tag in html.CLOSES_P else 0, reach(*html.IMPLIED.get(tag, ((), ())))))
            for parents, implied in ((("table",), "tbody"), (("tbody", "thead", "tfoot"), "tr")):
                around = [t for t in stack if t in "table tbody thead tfoot tr td th caption".split()]
                if around and around[-1] in parents and tag in (("tr", "td", "th") if implied == "tbody" else ("td", "th")):
                    stack.append(implied)
                    out.append(("open", implied, ""))
            out.append((kind, tag, more))
            stack.append(tag)
            close(tag in html.VOID)
        elif tag == "br":
            out.extend([("open", "br", ""), ("close", "br", "")])
        elif tag not in html.VOID and tag in stack:
            n = stack[::-1].index(tag) + 1
            inner = stack[len(stack) - n + 1 :]
            across = tag in "table tr tbody thead tfoot td th body html".split()
            close(n if across or not {"td", "th", "table"} & set(inner) else 0)
    close(len(stack))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <table> <tbody> <thead> <tr> <td> <th> <caption> </caption> </table> </tr> </td> </tbody> <ul> <li> </ul> </li> <b> </b> <div> </div> <dl> <dt> <dd> <br> </br> <select> <option> w".split()), max_size=40))
def test_tree_is_that_of_the_rules(parts):
    page = "".join(parts)
    assert list(html.events(page)) == stack_events(page)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return pii.ordered(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@-+ 0(%é٣", max_size=40))
def test_plain_finds(text):
    assert pii.find(text) == plain(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("to john.doe (at) example (dot) com now", [("email", "john.doe (at) example (dot) com")]),
        ("bob at example dot org", [("email", "bob at example dot org")]),
        ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
        ("ｊｏｅ＠ａ．ｃｏｍ", [("email", "ｊｏｅ＠ａ．ｃｏｍ")]),
        ("plus one four one five five five five two six seven one", [("phone", "plus one four one five five five five two six seven one")]),
        ("ten dot two", []),
        ("meet me at the point of no return", []),
        ("we met at noon. dot com was a boom", []),
        ("one two three", []),
    ],
)
def test_disguises(text, want):
    assert [(k, text[s:e]) for k, s, e in pii.disguised(text, pii.find(text))] == want


def test_all_disguises_are_suspect():
    rewritten = [c for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and pii._plain(c := chr(i)) is not None]
    assert all(pii.suspects(pa.array(rewritten))[1])
    digits = "".join(chr(0x1040 + int(d)) for d in "14155550199")
    texts = [f"call +{digits} now", "ring +49 FÜNF FÜNF ZÉRO FÜNF FÜNF FÜNF ZÉRO FÜNF FÜNF"]
    for t, odd in zip(texts, pii.suspects(pa.array(texts))[1], strict=True):
        assert odd and pii.disguised(t, pii.find(t))


def test_pii_time_is_linear():
    began = time.time()
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@" * 100_000, "+1 " * 50_000, "one " * 20_000):
        pii.find(text)
    assert time.time() - began < 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.cc", "a (at) b (dot) cc", " ", "x", "bob at ex dot org", "10.0.0.1", "10 dot 0 dot 0 dot 1", "+1 415 555 0199", "one two three four five", "\u0430@b.cc", "٣", "+1", "555"]), max_size=12))
def test_disguised_finds_overlap_none_of_their_kind(parts):
    text = " ".join(parts)
    base = pii.find(text)
    got = pii.disguised(text, base)
    tape = pii.addresses(pii.spelled_numbers(pii.characters(pii.Tape(text))))
    want = []
    for k, i, j in pii.find(tape.text):
        s, e = tape.starts[i], tape.ends[j - 1]
        if any(tape.changed[i:j]) and not any(x == k and a < e and s < b for x, a, b in [*base, *want]):
            want.append((k, s, e))
    assert got == want


def test_time_of_disguises_is_linear():
    def seconds(n):
        text = "jo (at) ex (dot) org, " * n
        began = time.process_time()
        assert len(pii.disguised(text, [])) == n
        return time.process_time() - began

    assert seconds(8000) < 8 * max(seconds(2000), 0.05)


def test_logistic():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    m = Logistic.fit(x, np.array([0, 0, 1, 1]))
    assert m.probability(x)[0] < 0.5 < m.probability(x)[3]
    assert np.isfinite(Logistic.fit(np.zeros((0, 2)), np.zeros(0)).probability(np.ones((3, 2)))).all()
    assert 0.5 < Logistic.fit(x, np.ones(4)).probability(x)[0] < 1
