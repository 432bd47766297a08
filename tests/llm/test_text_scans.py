import random
import re
from functools import lru_cache
from itertools import pairwise

from pyspark.sql import functions as F

from loomwright.llm import html_main as H
from loomwright.llm import license_scan as S

PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav>a<ul><li>m</ul></nav><div class="cookie-notice">We use</div>
<main><article><header><h1>Big &amp; title</h1></header><p>One<b> two<br>three<p>Four &lt;x&gt; &nbsp; five<ul><li>i1<li>i2</ul><div class="ad"><div>buy</div></div>
<table><tr><td>a</td><td>b</td></tr></table><form><input>q</form><script>"</p>"</script>tail</article>
<section class="comments"><p>reader says</p></section></main><aside>side</aside><footer>f</footer>"""
TEXT = "Big & title\nOne two three\nFour <x> five\ni1\ni2\na b\ntail"


def pages(spark, *rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_structure_and_edges(spark, clashing):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "not a url", ""), (4, "http://a.example/y", "a < b &amp;&amp; c"), (4, "http://a.example/y", "a < b &amp;&amp; c"), (None, "http://b.example", "<p hidden>no<p>yes"), (5, "http://c.example/", "<article>" + "<p>long</p>" * 20_000)]
    got = {r["page_id"]: r for r in H.main_text(clashing(pages(spark, *rows))).collect()}
    assert got[1]["text"] == TEXT and got[1]["n_chars"] == len(TEXT)
    assert got[2]["text"] == got[3]["text"] == "" and got[None]["text"] == "yes" and got[5]["text"].count("\n") == 19_999
    assert H.main_text(pages(spark, *rows)).count() == len(rows) and H.main_text(pages(spark, *rows).limit(0)).count() == 0


def test_neighbours_lose_what_they_share_but_not_marked_main_content(spark):
    page = lambda own, mark="div": f"<body><div>Home of things</div><{mark}><p>{own}<p>shared words</{mark}><div>All rights</div>"
    rows = [(1, "http://a.example/n/1", page("first")), (2, "http://a.example/n/2", page("second")), (3, "http://a.example/n/3", page("third", "article")), (4, "http://z.example/", page("alone"))]
    got = {r["page_id"]: r["text"] for r in H.main_text(pages(spark, *rows)).collect()}
    assert got == {1: "first", 2: "second", 3: "third\nshared words", 4: "Home of things\nalone\nshared words\nAll rights"}


def test_longest_common_subsequence():
    def length(a, b):
        @lru_cache(None)
        def f(i, j):
            return 0 if i == len(a) or j == len(b) else 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

        return f(0, 0)

    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        found = sorted(H.common_lines(a, b))
        assert len(found) == length(tuple(a), tuple(b))
        at = iter(b)
        assert all(a[i] in at for i in found)


FORMS = [(name, S.bigrams(S.normalise(f))) for name, many in S.TEMPLATES.items() for f in many]


def brute(text, t=0.8):
    """All runs of pieces of lines against all templates; the best first, none overlapping another."""
    cut = S.Scanner(S.TEMPLATES, t).pieces
    of, lines = zip(*[(i, w) for i, x in enumerate((text or "").split("\n")) for w in cut(S.normalise(x)) or [[]]])
    found = []
    for a in range(len(lines)):
        for b in range(a + 1, len(lines) + 1):
            if lines[a] and lines[b - 1]:
                grams = S.bigrams([w for x in lines[a:b] for w in x])
                top = min(((-2 * len(grams & f) / (len(grams) + len(f)), name) for name, f in FORMS))
                if -top[0] >= t - 1e-12:
                    found.append((top[0], a, b, top[1]))
    chosen = []
    for dice, a, b, name in sorted(found):
        if all(b <= x or y <= a for x, y, _, _ in chosen):
            chosen.append((a, b, name, -dice))
    return [(of[a], of[b - 1] + 1, name, dice) for a, b, name, dice in sorted(chosen)]


def broken_licences():
    """Licences with words changed, cut into lines, lines repeated and mixed with others and with blanks."""
    rng = random.Random(6)
    forms = [f for many in S.TEMPLATES.values() for f in many]
    out = []
    for _ in range(50):
        lines = []
        for _ in range(rng.choice([1, 1, 2])):
            words = rng.choice(forms).split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(["software", "zebra", "the", "license"])
            cut = max(rng.choice([5, 9, 1000]), len(words) // 12)
            lines += [" ".join(words[i : i + cut]) for i in range(0, len(words), cut)]
            if rng.random() < 0.4:
                k = rng.randrange(len(lines))
                lines[k:k] = [lines[k]] * rng.choice([1, 3])
            lines += rng.choice([["and some words of the text"], [""], [], ["License"], ["Version 2.0."]])
        out.append("\n".join(lines[:34]))
    return out


def test_licences_like_brute_force(documents):
    """Names, spans and Dice, through Spark."""
    texts = broken_licences()
    got = {r["doc_id"]: r for r in S.scan_documents(documents(*enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        assert [(m["first_line"], m["end_line"], m["license"], round(m["dice"], 9)) for m in got[i]["matches"]] == [(a, b, n, round(d, 9)) for a, b, n, d in want], text
        assert got[i]["n_matches"] == len(want) and got[i]["license"] == max(want, key=lambda m: m[3], default=(0, 0, None))[2]


def test_siblings_are_told_apart():
    """Each template is found as itself, also in one line, also with each of its lines ten times."""
    scanner = S.Scanner(S.TEMPLATES, 0.8)
    for name, many in S.TEMPLATES.items():
        for form in many:
            assert scanner.scan("x y z\n" + " ".join(form.split()))[0][2:] == (name, 1.0)
            lines = [x for x in form.split("\n") for _ in range(10)]
            (found,) = scanner.scan("\n".join(lines))[:1]
            assert found[2] == name, (name, found)


def test_a_licence_within_a_very_long_line():
    rng = random.Random(2)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    found = S.Scanner(S.TEMPLATES, 0.8).scan("one\n" + noise(3000) + " " + " ".join(S.TEMPLATES["MIT"][2].split()) + " " + noise(3000) + "\nend")
    assert [(a, b, name) for a, b, name, _ in found] == [(1, 2, "MIT")] and found[0][3] > 0.9


def test_a_licence_is_found_in_lines_of_every_length():
    """At the end, in the middle and at the start of one line of other words, whatever its length."""
    scanner = S.Scanner(S.TEMPLATES, 0.8)
    mit = " ".join(S.TEMPLATES["MIT"][2].split())
    for size in (100, 281, 361, 461, 1500):
        noise = " ".join(f"noise{i}" for i in range(size))
        for line in (noise + " " + mit, mit + " " + noise, noise + " " + mit + " " + noise):
            assert scanner.scan("one\n" + line + "\nend") == [(1, 2, "MIT", 1.0)], size
    both = mit + " " + noise + " " + " ".join(S.TEMPLATES["MPL-2.0"][0].split())
    assert scanner.scan(both) == [(0, 1, "MIT", 1.0), (0, 1, "MPL-2.0", 1.0)]


def test_spans_of_several_licences(documents, clashing):
    text = "hello\n" + S.TEMPLATES["MIT"][2] + "\nfoo\nLicensed under CC BY-NC 4.0.\n"
    rows = [(1, text), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0.\n" * 2000), (4, "x " * 100_000), (None, "released under the MIT license")]
    got = {(r["doc_id"], r["license"]): r for r in S.scan_documents(clashing(documents(*rows))).collect()}
    assert [m["license"] for m in got[1, "MIT"]["matches"]] == ["MIT", "CC-BY-NC-4.0"] and got[1, "MIT"]["dice"] == 1.0
    assert got[2, None]["dice"] == got[3, None]["dice"] == 0 and got[4, "Apache-2.0"]["n_matches"] == 2000 and (4, None) in got
    assert got[None, "MIT"]["dice"] == 1.0
    assert S.scan_documents(documents((1, "a")).limit(0)).count() == 0


def test_size_bounds_lose_no_match():
    for a in range(1, 40):
        for b in range(1, 40):
            for c in range(min(a, b) + 1):
                if 2 * c >= 0.8 * (a + b):
                    assert b * 0.8 / 1.2 - 1e-9 <= a <= b * 1.2 / 0.8 + 1e-9
    assert set(pairwise("ab")) == {("a", "b")}


def plain_main_text(rows):
    """Distinct contents of each host in the order of their first URLs, each against its nearest, in plain Python."""
    hosts = {}
    for row in rows:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", row[1] or "")
        hosts.setdefault(m[1].lower() if m else "", []).append((m[2] if m else row[1] or "", row[1] or "", row[0], row))
    out = []
    for host, pages_ in hosts.items():
        first, of = {}, []
        for path, url, page_id, row in pages_:
            lines, main = H.blocks(row[2])
            of.append((page_id, row[1], (tuple(lines), tuple(main))))
            first[of[-1][2]] = min(first.get(of[-1][2], (path, url)), (path, url))
        ordered = sorted(first, key=lambda c: (*first[c], H.content(host, *c)))
        texts = {}
        for i, (lines, main) in enumerate(ordered):
            near = [ordered[j][0] for j in (i + 1, i - 1, i + 2, i - 2) if 0 <= j < len(ordered)]
            near = [x for x in near if x != lines]
            shared = set.intersection(*(H.common_lines(lines, x) for x in near[:2])) if near else set()
            if near and sum(len(lines[k]) for k in shared) * 2 > sum(map(len, lines)):
                shared &= set.intersection(*(H.common_lines(lines, x) for x in near))
            texts[lines, main] = "\n".join(x for k, x in enumerate(lines) if main[k] or k not in shared)
        out += [(page_id, url, texts[c], len(texts[c])) for page_id, url, c in of]
    return sorted(out)


def site():
    section = lambda i: f"template of section {i // 4}"
    rows = [(i, f"http://{'hot' if i < 120 else f'h{i % 3}'}.org/s{i // 4:03d}/p{i:03d}", f"<p>site<p>{section(i)}<p>own text {i}<p>end of {i // 3}" + "<article><p>site<p>kept</article>" * (i % 5 == 0)) for i in range(150)]
    rows += [(200 + i, "http://hot.org/same", f"<p>same<p>{i % 2}") for i in range(6)] + [(300, "HTTP://one.org", "<p>alone"), (301, "http://two.org/a", "<p>x<p>menu one"), (302, "http://two.org/b", "<p>y<p>menu one")]
    return rows


def test_like_plain_differencing_at_every_number_of_ranges(spark):
    want = plain_main_text(site())
    assert {t for _, _, t, _ in want} > {"own text 5\nend of 1\nsite\nkept", "x", "y", "alone"}
    try:
        for n in ("1", "4", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert sorted(map(tuple, H.main_text(pages(spark, *site()).repartition(3)).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_cuts_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(H, "SMALL", 0)
    assert sorted(map(tuple, H.main_text(pages(spark, *site())).collect())) == plain_main_text(site())


def test_pages_without_marks_give_the_same_texts(spark):
    """On the smallest test table: differencing keeps what the marks protect, copies of articles next to each other included."""
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    bare = table.withColumn("html", F.regexp_replace("html", "(?i)<(/?)(article|main)", "<$1div"))
    want = {r["page_id"]: r["text"] for r in H.main_text(table).collect()}
    assert len(want) == table.count() and {r["page_id"]: r["text"] for r in H.main_text(bare).collect()} == want and all(want.values())


def test_containers_are_named_by_whole_words(spark):
    html = "".join(f"<div {a}><p>{k}</p></div>" for k, a in enumerate(['class="responses"', 'id="reader-feedback"', 'class="newsletter-signup"', 'class="ad-slot_2 x"', 'id="search-theory"', 'class="notice-period"', 'class="comment-on-law"', 'role="complementary"', 'class="header"', 'id="header-of-text"']))
    assert H.blocks(html)[0] == ["4", "5", "6", "9"]


def test_names_count_on_containers_and_not_on_headings_or_anchors():
    html = "<article><h2 id='cookies'>1</h2><section id='feedback'><p class='ad'>2</p></section><div class='notice'>3</div><article data-ref='nocomment'>4</article><article class='comment'>5</article><section id='comments'>6</section></article>"
    assert H.blocks(html)[0] == ["1", "2", "4"]


def test_copies_of_pages_are_one_page(spark):
    """A page between two sections keeps the same text once, five times, and among copies at other URLs on either side."""
    page = lambda menu, own: "".join(f"<p>{x}" for x in [*menu, own])
    side = lambda name, menu: [(i, f"http://s.org/{name}{i}", page(menu, f"own {name}{i}")) for i in range(3)]
    rows = side("a", ["site", "menu L"]) + side("c", ["site", "menu R"])
    middle = page(["site", "menu L", "menu R"], "between")
    many = [(9, "http://s.org/b5", middle)] * 5
    around = [(20 + i, f"http://s.org/b{i}", middle) for i in (6, 7, 8)]
    results = [{r["text"] for r in H.main_text(pages(spark, *rows, *more).repartition(n)).where("url = 'http://s.org/b5'").collect()} for more, n in ((many[:1], 1), (many, 1), (many, 5), (many + around, 3))]
    assert all(r == results[0] and len(r) == 1 for r in results) and results[0] == {"menu L\nmenu R\nbetween"}
