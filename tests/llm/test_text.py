import hashlib
import random
import re
from collections import Counter

import pytest
from conftest import ODD, prose

from tokenloom.llm import bpe, html_text, pii, quality_rules, warc


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


AWKWARD = [t or "" for _, t in ODD] + ["  x \n\n y\t", "'ll I'VE don't 123½ Ⅷ", "ab" * 50 + " " * 70, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "ẞ\x85\x1c x᠎"]


def test_bpe_is_the_librarys(library):
    merger = bpe.Merger(bpe.default_vocabulary())
    coder = bpe.Coder(merger, None)
    for text in AWKWARD:
        expected = library.encode(text, add_special_tokens=False).ids
        ids = coder.encode(text)
        assert ids.tolist() == expected and coder.said(ids).decode() == ",".join(map(str, expected))
        assert merger.decode(ids.tolist()) == library.decode(expected, skip_special_tokens=False)


def test_automaton_is_minimal_and_exact(tmp_path):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))).encode() for _ in range(800)} | {b"xing", b"ying"})
    ids = [[i, i + 1] for i in range(len(words))]
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.build_automaton(words, ids))
    lexicon = bpe.Lexicon(str(path))
    assert [lexicon.get(w) for w in words] == ids
    known = set(words)
    assert all(lexicon.get(w) is None for w in (b"", b"zz", b"abcabcabcabc", b"xin") if w not in known)
    # as many states as there are distinct sets of endings
    endings = {w[:i]: frozenset(x[i:] for x in words if x.startswith(w[:i])) for w in words for i in range(len(w) + 1)}
    assert len(lexicon.finals) == len(set(endings.values()))


def test_bpe_query(spark, folder, library):
    rows = {(r.doc_id, r.ids_sha256): r for r in bpe.op2(spark, folder(ODD)).collect()}
    for i, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = rows[i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_empty(spark, folder):
    path = folder([])
    assert bpe.op2(spark, path).count() == quality_rules.op9(spark, path).count() == pii.op5(spark, path).count() == 0
    assert warc.op3(spark, path).count() == html_text.op6(spark, path).count() == 0


PAGES = [(1, "http://a/ü", "x" * 200), (2, None, "x" * 200), (3, "http://c", "x" * 99), (4, "d", "x" * 99), (None, "e", None), (5, "f", ""), (6, "g", "é\r\n\r\nWARC/1.1\r\n" * 30), (7, "h", "é\r\n\r\nWARC/1.1\r\n" * 30), (8, "i", "y" * 3_000_000), (None, "j", "x" * 200)]


def test_warc(spark, folder):
    found = {(r.page_id, r.payload_digest): r for r in warc.op3(spark, folder([], pages=PAGES)).collect()}
    assert len(found) == len(PAGES)
    for i, _, html in PAGES:
        data = (html or "").encode()
        r = found[i, hashlib.sha256(data).hexdigest()]
        same = [j for j, _, h in PAGES if (h or "").encode() == data]
        first = None if None in same else min(same)
        again = len(data) >= 100 and i != first
        assert r.payload_bytes == len(data) and r.record_type == ("revisit" if again else "response") and r.refers_to == (first if again else None)


def test_warc_chunks(spark, folder, tmp_path):
    path = folder([], pages=PAGES)
    index = warc.write_warc(spark.read.parquet(f"{path}/pages.parquet"), str(tmp_path / "out"))
    rows = warc.read_warc(index, chunk_bytes=1000).where("warc_type = 'response'").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.chunk_no):
        assert len(r.data) <= 1000
        by.setdefault((r.record_id, r.stated_digest), []).append(r)
    for chunks in by.values():
        data = b"".join(r.data for r in chunks)
        assert [r.chunk_no for r in chunks] == list(range(len(chunks))) and [r.is_last for r in chunks] == [False] * (len(chunks) - 1) + [True]
        assert chunks[-1].digest == hashlib.sha256(data).hexdigest() == chunks[-1].stated_digest and chunks[-1].bytes_so_far == len(data)
    kept = {r.target_uri for r in rows if r.record_id not in ("1", "2", "null")}
    assert kept == {u for i, u, _ in PAGES if i not in (None, 1, 2, 7)} and any(r.target_uri == "j" for r in rows)


def plain(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(["0123456789", "a.@-", "+ ()1.", "é\n.@+%", "4929 1"])) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain(text), text


def test_pii_query(spark, folder):
    names = "amber basil cedar delta ember fjord grove heath islet jetty knoll ledge".split()
    rng = random.Random(4)
    rows = [(1000 + i, f"{' '.join(rng.sample(names, 5))} quixby wrote to jo.quixby@mail.example.org from {' '.join(rng.sample(names, 4))}") for i in range(8)]
    rows += [(100 + i, " ".join(rng.sample(names, 9)) + " wrote to from") for i in range(60)] + ODD
    found = pii.op5(spark, folder(rows)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        if r.doc_id is not None and r.doc_id != 5:
            base = plain(texts[r.doc_id] or "")
            said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
            spans = [x.split(":") for x in r.spans.split(",") if x]
            assert [x for x in spans if x[0] != "term"] == [[k, str(a), str(b)] for k, a, b in base]
            if r.doc_id >= 1000:
                assert r.n_email == 1 and {texts[r.doc_id][int(a) : int(b)] for k, a, b in spans if k == "term"} >= {"quixby"}
            elif r.doc_id >= 100:
                assert r.spans == ""


def test_a_far_word_of_a_rare_entity_is_a_term(spark, folder):
    names = "amber basil cedar delta ember fjord grove heath islet jetty knoll ledge".split()
    rng = random.Random(5)
    filler = " ".join(rng.choice(names) for _ in range(60))
    rows = [(1, f"quixby {filler} mail jo@mail.example.org {filler} zorbane")]
    rows += [(100 + i, f"{i} " + " ".join(rng.choice(names) for _ in range(60)) + " mail") for i in range(60)]
    (spans,) = [r.spans for r in pii.op5(spark, folder(rows)).collect() if r.doc_id == 1]
    terms = {rows[0][1][int(a) : int(b)] for k, a, b in (x.split(":") for x in spans.split(",")) if k == "term"}
    assert terms == {"quixby", "zorbane"}


def test_copies_change_no_term(spark, table_of):
    rng = random.Random(7)
    names = "amber basil cedar delta ember fjord grove heath islet jetty knoll ledge".split()
    base = [(i, f"{' '.join(rng.choice(names) for _ in range(20))} quixby {'mail jo@mail.example.org' if i < 3 else 'x' * i}".replace("quixby", "quixby" if i < 3 else "")) for i in range(80)]
    copies = [(1000 + 3 * k + i, base[i][1]) for k in range(40) for i in range(3)]
    terms = [{(r.key, t.start, t.end, t.general) for r in pii.find_spans(table_of(rows)).collect() if r.key < 1000 for t in r.terms or ()} for rows in (base, base + copies)]
    assert terms[0] == terms[1] and len(terms[0]) >= 3


def test_sanitise(spark, table_of):
    out = pii.sanitise(table_of([(1, "mail a.b@c.de now"), (2, None)])).collect()
    assert {r.doc_id: r.text for r in out} == {1: "mail [EMAIL] now", 2: ""}
    rows = [(None, "to a.b@c.de"), (None, "plain"), (None, "plain"), (3, "+1 202 555 0143"), (3, None)]
    out = pii.sanitise(table_of(rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "plain"), (0, "plain"), (0, "to [EMAIL]"), (3, ""), (3, "[PHONE]")]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><p>Site header</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First&nbsp;paragraph <b>bold</b>
 text &#169; &lt;tag&gt;.<p>Short.</p><div class="share-buttons">Share</div><p>Last one, with 1 < 2.</p><section id="comments"><p>A reader comment that is long enough to look like text.</p></section></article>
<aside>Side</aside><form><input value="x"><p>Form</p></form><footer>Foot</footer></body></html>"""


def test_html(spark, folder):
    assert html_text.main_text(PAGE).split("\n\n") == ["Title & more", "First paragraph bold text © <tag>.", "Short.", "Last one, with 1 < 2."]
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<body><div class='menu'>M</div><div><p>one</p><p>two</p></div><div id='footer'>F</div>") == "one\n\ntwo"
    assert html_text.main_text("plain text") == "plain text"
    rows = html_text.op6(spark, folder([], pages=[(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "<p>" + "long word " * 100_000)])).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)


def unmarked_page(rng):
    """A page without an article element or telling names, and the lines of its text."""
    said = lambda n: prose(rng, n).capitalize() + "."
    body = [said(rng.randrange(4, 9))] + [said(rng.choice([1, 3, 30, 60, 90])) for _ in range(rng.randrange(4, 12))] + [said(70)]
    rng.shuffle(body)
    menu = "".join(f"<li><a href='/{k}'>{said(rng.randrange(1, 4))}</a></li>" for k in range(rng.randrange(3, 12)))
    side = "".join(f"<div><div><p>{said(rng.randrange(2, 6))} <a href='#'>more of it</a></p></div></div>" for _ in range(rng.randrange(3)))
    article = "".join(f"<p>{x}</p>" if rng.random() < 0.8 else f"<div>{x}</div>" for x in body)
    return f"<html><body><div><ul>{menu}</ul></div><div><div>{article}</div></div>{side}<div><div>{said(5)}</div><div><a href='/'>{said(3)}</a></div></div></body></html>", body


def test_windows_find_the_text_of_unmarked_pages():
    """Precision and recall of characters where nothing but the lengths tells; another window gives another text."""
    rng, right, found, wanted, other = random.Random(12), 0, 0, 0, 0
    for _ in range(300):
        page, body = unmarked_page(rng)
        lines = html_text.main_text(page).split("\n\n")
        both = Counter(lines) & Counter(body)
        right += sum(len(x) * n for x, n in both.items())
        found += sum(map(len, lines))
        wanted += sum(map(len, body))
        other += html_text.main_text(page, block=1) != html_text.main_text(page) != html_text.main_text(page, block=8)
    assert right >= 0.95 * found and right >= 0.95 * wanted and other > 100


def test_stretches_are_those_of_the_definition():
    rng = random.Random(13)
    for _ in range(500):
        sizes = [rng.choice([0, 0, 0, 5, 40, 300]) for _ in range(rng.randrange(1, 40))]
        block = rng.randrange(1, 6)
        if not any(sizes):
            continue
        sums = [sum(sizes[i : i + block]) for i in range(len(sizes))]
        surges = [i for i, x in enumerate(sums) if x and (i == 0 or not sums[i - 1])]
        dives = [next((k for k in range(i, len(sums)) if not sums[k]), len(sums)) for i in surges]
        plain = [(a, z) for a, z in zip(surges, dives, strict=True) if max(sums[a:z]) >= html_text.SURGE * max(sums)]
        assert html_text.stretches(html_text.np.array(sizes), block) == plain


def test_a_small_article_is_no_gate():
    rng = random.Random(14)
    body = [prose(rng, 60) for _ in range(6)]
    page = f"<body><div><div>{''.join(f'<p>{x}</p>' for x in body)}</div></div><div><div><div><article><p>A short teaser.</p></article></div></div></div></body>"
    assert html_text.main_text(page).split("\n\n") == body


def test_deep_and_unclosed_markup_takes_linear_time():
    text = html_text.main_text("<div><b>" * 60_000 + "deep words" + "</i></div>" * 60_000)
    assert text == "deep words"


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        dup += line in lines and bool(re.search(r"[^\x20\x09-\x0D]", line))
        lines.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_quality_rules(spark, folder):
    rng = random.Random(6)
    rows = ODD + [(1000 + i, "".join(rng.choice(["a ", "b ", "c\n", "#|", "\x1c", " ", "\x0b"]) for _ in range(rng.randrange(200)))) for i in range(100)]
    found = quality_rules.op9(spark, folder(rows)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((tuple(r[:7]) for r in found), key=key) == sorted(((i, *brute_rules(t)) for i, t in rows), key=key)
    assert not any(r.kept and r.base_failed for r in found)


def test_lines_that_fail(spark, table_of):
    good = prose(random.Random(1), 90) + "."
    rows = [(1, good + "\nHome | News | Sport | Weather | Shop | About"), (2, "\n".join("one | two | three | four | five" for _ in range(20))), (3, good), (4, "WIN!! BIG!! MONEY!! NOW!! " * 20)]
    out = {r.doc_id: r for r in quality_rules.stage(spark, table_of(rows), "").collect()}
    assert set(out) == {1, 3} and out[1].text == good and out[1].n_chars == len(good) and out[3].text == good
