import gzip
import math
import os
import random
import re
import time

import pytest

from binloom.llm import chat, html_text, revisit

P = "The quick brown fox jumps over the lazy dog and runs away from the wolf that lives here."


def test_main_text_of_furnished_pages():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
    <div class="cookie-notice">{P * 3}</div><main><article><h1>Title &amp; more</h1><p>{P}<p>{P}  <b>bold</b><br>x<aside>{P}</aside>
    <form><input>{P}</form><script>var a = "<p>no</p>";</script></article></main>
    <section id="comments"><h2>Comments</h2><div class="comment">{P * 6}</div></section><footer>&copy; all</footer></body></html>"""
    assert html_text.main_text(page).split("\n") == ["Title & more", P, f"{P} bold x"]


def test_main_text_by_density_alone():
    page = f"<body><div><a href=a>one</a> <a href=b>two</a></div><div><div><h2>T</h2><p>{P}</p><p>{P * 2}</p></div></div><div><a href=q>x</a> more</div></body>"
    assert html_text.main_text(page).split("\n") == ["T", P, P * 2]


def test_main_text_of_odd_pages():
    assert html_text.main_text("") == "" and html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("just text & more <b>bold</b> a < b &#x41;&eacute;&nbsp;z") == "just text & more bold a < b Aé z"
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html_text.main_text(f"<article><p>{P}<div class=ad>advert</article><footer>f") == P
    long = " ".join(["word"] * 100000)
    assert html_text.main_text(f"<article><p>{long}</p></article>") == long


def test_main_text_where_the_body_does_not_win():
    for body in ("text", "<h1>404 Not Found</h1>", "<nav>n</nav><div>text</div>", "<a href=x>lone link</a>", "<p></p>"):
        got = html_text.main_text(f"<html><head><title>t</title></head><body>{body}</body></html>")
        assert got == {"<h1>404 Not Found</h1>": "404 Not Found", "<a href=x>lone link</a>": "lone link", "<p></p>": ""}.get(body, "text")
    assert html_text.main_text(f"<body><p>short</p></body><div><p>{P}</p><p>{P * 2}</p></div>").split("\n")[-2:] == [P, P * 2]
    assert html_text.main_text(f"<div><p>{P}</p><p>{P * 2}</p></div><body><script>x</script></body>").split("\n") == [P, P * 2]
    assert P in html_text.main_text(f"<b>b<body><p>{P}</p></body>")


def test_main_text_in_several_parts():
    links = "<div>" + "".join(f"<a href={i}>link {i}</a> " for i in range(9)) + "</div>"
    for one, two in (("<article>", "</article>"), ("<div>", "</div>"), ("<section><div>", "</div></section>")):
        page = f"<body>{links}{one}{f"<p>{P * 3}</p>" * 9}{two}{links}{one}<p>{P * 4}</p><p>{P}</p>{two}{links}{one}<p>{P}</p>{two}<div><a href=q>x</a> more</div>{links}</body>"
        assert html_text.main_text(page).split("\n") == [P * 3] * 9 + [P * 4, P, P]
    page = f"<body>{links}{P} <b>bold</b><br>{P}<div>{f"<p>{P * 3}</p>" * 9}</div>| <a href=q>x</a>{links}<h1>{P}</h1>{links}</body>"
    assert html_text.main_text(page).split("\n") == [f"{P} bold {P}", *[P * 3] * 9, P]
    deep = "<div>" * 3000 + f"<p>{P}</p>" + "</div>" * 3000
    assert html_text.main_text(f"<body>{deep}{links}{deep}</body>").split("\n")[0] == P


def test_main_text_in_parts_named_like_furniture():
    text = f"<h1>Title</h1><p>{P}</p><p>{P * 2}</p>"
    want = ["Title", P, P * 2]
    for name in ("has-sidebar", "no-sidebar", "header-fixed", "share-enabled", "post-related", "comments-open"):
        assert html_text.main_text(f"<body><nav>n</nav><div class='{name}'><article>{text}</article></div></body>").split("\n") == want
        if name != "comments-open":
            assert html_text.main_text(f"<body><div id=x class='{name}'>{text}</div><div class=ad>advert</div></body>").split("\n") == want
    assert html_text.main_text(f"<body><form id=aspnetForm><fieldset>{text}</fieldset><div class=ad>advert</div></form></body>").split("\n") == want
    assert html_text.main_text(f"<body><article><div class='article-header'><h1>Title</h1></div><p>{P}</p><p>{P * 2}</p></article></body>").split("\n") == want
    assert html_text.main_text(f"<body style='visibility:hidden'><article hidden>{text}</article><div hidden>{P}</div></body>").split("\n") == want
    # what is furniture beside an article, or within a wrapper, stays out
    more = f"<div class='comments'><article class='comment'><p>{P * 9}</p></article></div><div class='related-posts'><article><p>{P * 9}</p></article></div>"
    assert html_text.main_text(f"<body><main><article>{text}</article>{more}</main></body>").split("\n") == want
    assert html_text.main_text(f"<body><div class='has-sidebar'><article>{text}</article>{more}</div></body>").split("\n") == want
    assert html_text.main_text(f"<body><div class='content'>{text}</div><div class='comments'><p>{P * 9}</p></div></body>").split("\n") == want


def _counts(node):
    """(characters, tags, link characters, link tags) below a node, by plain recursion."""
    if isinstance(node, str):
        return len("".join(node.split())), 0, 0, 0
    if node.furniture or node.tag in html_text.INVISIBLE:
        return 0, 0, 0, 0
    chars = tags = links = link_tags = 0
    for c in node.children:
        if not isinstance(c, str) and (c.furniture or c.tag in html_text.INVISIBLE):
            continue
        n = _counts(c)
        chars, tags = chars + n[0], tags + n[1] + (not isinstance(c, str))
        links, link_tags = links + n[2], link_tags + n[3] + (not isinstance(c, str) and c.tag == "a")
    return chars, tags, chars if node.tag == "a" else links, link_tags


def _plain_density(counts, ratio):
    chars, tags, links, link_tags = counts
    if not chars:
        return 0.0
    inner = math.log(chars / max(chars - links, 1) * max(links, 1) + ratio * chars + math.e)
    return max(0.0, chars / max(tags, 1) * math.log(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1), inner))


def _random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["p", "div", "section", "ul", "a", "b", "nav", "h2", "text", "text"])
        words = " ".join(rng.choice(["lorem", "ipsum", "dolor,", "sit", "amet"]) for _ in range(rng.choice([1, 3, 30])))
        out.append(words if tag == "text" else f"<{tag}>{words if depth > 3 or tag in 'pabh2' else _random_page(rng, depth + 1)}</{tag}>")
    return " ".join(out)


def test_densities_equal_brute_force():
    rng, chosen = random.Random(11), 0
    for _ in range(150):
        nodes = html_text._ordered(html_text.parse(f"<body>{_random_page(rng)}</body>"))
        html_text.measure(nodes)
        whole = _counts(nodes[0])
        ratio = whole[2] / whole[0] if whole[0] else 0.0
        for n in nodes:
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == _counts(n)
            assert math.isclose(n.density, _plain_density(_counts(n), ratio), abs_tol=1e-9)
            total, run = 0.0, [0, 0, 0, 0]
            for c in [*n.children, None]:
                inline = isinstance(c, str) or c is not None and c.tag in html_text.INLINE | html_text.VOID
                if c is not None and not isinstance(c, str) and (c.furniture or c.tag in html_text.INVISIBLE):
                    continue
                if inline:
                    k = _counts(c)
                    run = [run[0] + k[0], run[1] + k[1] + (not isinstance(c, str)), run[2] + k[2], run[3] + k[3] + (not isinstance(c, str) and c.tag == "a")]
                    continue
                total, run = total + _plain_density(run, ratio), [0, 0, 0, 0]
                total += _plain_density(_counts(c), ratio) if c is not None else 0.0
            assert math.isclose(n.total, total, abs_tol=1e-9)
        tops, threshold = html_text._mark(nodes)
        if tops:
            body = next((n for n in nodes if n.tag == "body" and n.chars == nodes[0].chars), nodes[0])
            blocks = [n for n in nodes if n.chars and (n is body or n.tag not in html_text.INLINE) and any(u is body for u in html_text._path(n))]
            best = max(blocks, key=lambda n: n.total)
            above = list(html_text._path(best))
            assert math.isclose(threshold, min(n.density for n in above[: above.index(body) + 1]))
            # the subtree of the largest sum is kept, in one of the chosen parts or cut up into several
            assert any(top in above or best in html_text._path(top) or math.isclose(top.total, best.total) for top in tops)
            chosen += 1
    assert chosen > 100


def test_text_does_not_hang_on_element_names():
    """The density alone gives the article: renamed containers change nothing."""
    folder = "/root/testdata/sf0.01/pages.parquet"
    if os.path.exists(folder):
        import pyarrow.parquet as pq

        for r in pq.read_table(folder).to_pylist():
            assert html_text.main_text(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r["html"])) == html_text.main_text(r["html"])
    for tag in ("article", "div", "main", "section"):
        for body in (f"<h1>A short one</h1><p>{P}</p>", f"<h1>T</h1><p><b>{P}</b><br>{P}</p>", f"<h1>T</h1><p>{P}</p><p>Short.</p>"):
            want = [x for x in re.sub(r"<br>", " ", re.sub(r"</?b>", "", body)).replace("</h1>", "").replace("</p>", "").replace("<h1>", "<p>").split("<p>") if x]
            assert html_text.main_text(f"<body><nav><a href=x>n</a></nav><div class=ad>{P}</div><{tag}>{body}</{tag}><footer>f</footer></body>").split("\n") == want


def test_lists_of_links_inside_the_article_go():
    links = "".join(f"<a href={i}>link number {i}</a> " for i in range(20))
    items = "".join(f"<li><a href={i}>link number {i}</a></li>" for i in range(20))
    for tag in ("article", "div", "main"):
        for menu in (f"<div>{links}</div>", f"<ul>{items}</ul>"):
            page = f"<body><nav>n</nav><{tag}><h1>Title</h1><p>{P}</p>{menu}<p>{P * 2} <a href=x>one</a> <a href=y>two</a></p></{tag}><footer>f</footer></body>"
            assert html_text.main_text(page).split("\n") == ["Title", P, f"{P * 2} one two"]
        talk = "<div id=kommentare>" + "".join(f"<div><b>user{i}</b><p>{P}</p></div>" for i in range(8)) + "</div>"
        page = f"<body><{tag}><h1>T</h1><p>{P * 3}</p><p>{P * 2}</p><p>{P * 4}</p></{tag}>{talk}</body>"
        assert html_text.main_text(page).split("\n") == ["T", P * 3, P * 2, P * 4]


def test_extract_rows(spark):
    made = spark.createDataFrame([(1, "u", f"<article><p>{P}</p></article>", "x"), (1, "u", f"<article><p>{P}</p></article>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted(tuple(r) for r in html_text.extract(made).fillna({"page_id": -1, "url": ""}).collect())
    assert got == [(-1, "", "", 0), (1, "u", P, len(P)), (1, "u", P, len(P))]
    assert html_text.extract(made.limit(0)).count() == 0


CAPTURES = "record_id long, url string, ts long, status_code int, headers map<string,string>, payload_digest string, status string"


def resolved(spark, *rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], CAPTURES)
    return {r["record_id"]: r for r in revisit.resolve(df, **options).collect()}


def test_revisits(spark):
    full = {"etag": '"a"', "content-type": "text/html", "x": "1", "last-modified": "d1"}
    got = resolved(
        spark,
        (1, "http://www.Site.org:80/p/", 10, 200, full, "sha:1"),
        (2, "https://site.org/p#top", 20, 304, {"etag": 'W/"a"', "x": "2", "content-length": "0", "connection": "close"}, None),
        (3, "https://site.org/p", 30, 200, {"etag": '"b"'}, "sha:3"),
        (4, "https://site.org/p", 30, 304, {"etag": '"a"'}, None),
        (5, "https://site.org/p", 31, 304, {"etag": '"a"'}, None),
        (6, "https://site.org/p", 32, 304, None, None),
        (7, "https://site.org/q", 99, 304, {"etag": '"a"'}, None),
        (8, "https://site.org/p", 25, 304, {"last-modified": "d1"}, None),
        (9, None, None, 304, {}, None),
        (10, "https://site.org/p", 24, 404, {}, "sha:x"),
        segment_seconds=7,
    )
    assert {i: (r["status"], r["source_id"]) for i, r in got.items()} == {
        2: ("resolved", 1), 4: ("resolved", 1), 5: ("mismatch", 3), 6: ("unverified", 3), 7: ("missing", None), 8: ("resolved", 1), 9: ("missing", None),
    }
    assert got[2]["headers"] == {"etag": 'W/"a"', "content-type": "text/html", "x": "2", "last-modified": "d1"}
    assert got[2]["payload_digest"] == "sha:1" and got[5]["payload_digest"] is None and got[2]["url_key"] == "site.org/p"


def test_revisits_equal_brute_force(spark):
    rows = [(i, f"http://h/{i * 5 % 3}", i * 37 % 50, 200 if i % 3 else 304, {"etag": str(i % 2)}, str(i)) for i in range(200)]
    got = resolved(spark, *rows, segment_seconds=8)
    for i, url, ts, code, _, _ in rows:
        if code == 304:
            before = [(r[2], r[0]) for r in rows if r[1] == url and r[3] == 200 and r[2] < ts]
            assert got[i]["source_id"] == (max(before)[1] if before else None)
    assert resolved(spark) == {}


def warc(kind, name, date, block, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{name}>", "WARC-Date": date, "WARC-Target-URI": "https://site.org/p", "Content-Length": str(len(block)), **{k.replace("_", "-"): v for k, v in fields.items()}}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_revisits_of_warc_files(spark, tmp_path):
    full = b'HTTP/1.1 200 OK\r\nETag: "a"\r\nContent-Type: text/html\r\nX: 1\r\nX: 2\r\nLong: one\r\n two\r\n\r\n<p>WARC/1.1 inside a body</p>'
    same = b'HTTP/1.1 304 Not Modified\r\nETag: W/"a"\r\nAge: 5\r\n\r\n'
    profile = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    records = [
        warc("warcinfo", "0", "2024-01-01T00:00:00Z", b"software: x\r\n"), warc("response", "1", "2024-01-01T00:00:01Z", full, WARC_Payload_Digest="sha1:X"),
        warc("request", "2", "2024-01-01T00:00:01Z", b"GET / HTTP/1.1\r\n\r\n"), warc("revisit", "3", "2024-01-02T00:00:00Z", same, WARC_Profile=profile),
        warc("revisit", "4", "2024-01-03T00:00:00Z", full, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        warc("revisit", "5", "2024-01-01T00:00:00Z", same, WARC_Profile=profile),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(warc("revisit", "6", "2024-01-01T00:00:09Z", same.replace(b'"a"', b'"b"'), WARC_Profile=profile))
    (tmp_path / "c.warc").write_bytes(b"")
    captures = revisit.read_warc(spark, str(tmp_path))
    assert sorted((r["ts"], r["status_code"]) for r in captures.collect()) == [(1704067200, 304), (1704067201, 200), (1704067209, 304), (1704153600, 304)]
    got = sorted((r["ts"], r["status"], r["payload_digest"]) for r in revisit.resolve(captures).collect())
    assert got == [(1704067200, "missing", None), (1704067209, "mismatch", None), (1704153600, "resolved", "sha1:X")]
    merged = revisit.resolve(captures).filter("status = 'resolved'").first()["headers"]
    assert merged == {"etag": 'W/"a"', "content-type": "text/html", "x": "1, 2", "long": "one two", "age": "5"}


TURNS = "conv_id long, turn long, role string, text string, name string"


def rotated(spark, *rows):
    return chat.rotate(spark.createDataFrame([(*r, "clash") for r in rows], TURNS)).collect()


def test_rotation(spark):
    got = rotated(spark, (1, 0, "system", "be kind"), (1, 1, "Ann B", "hi"), (1, 2, "bob", "ho <|im_end|>"), (1, 3, "Ann B", None))
    views = {}
    for r in sorted(got, key=lambda r: r["seq"]):
        views.setdefault(r["perspective"], []).append(r)
    assert set(views) == {"Ann_B", "bob"}
    text = "".join(r["rendered"] for r in views["bob"])
    assert text == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=Ann_B\nhi<|im_end|>\n"
        "<|im_start|>assistant\nho <| im_end|><|im_end|>\n<|im_start|>user name=Ann_B\n<|im_end|>\n"
    )
    for rows in views.values():
        assert [r["seq"] for r in rows] == [0, 1, 2, 3] and rows[0]["start"] == 0
        assert all(a["stop"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert [r["mask"] for r in views["bob"]] == [False, False, True, False] and [r["mask"] for r in views["Ann_B"]] == [False, True, False, True]


def test_speakers_are_told_apart_by_their_roles(spark):
    for roles, names in ((("李", "王"), ("_", "_.2")), (("Ann Lee", "Ann_Lee"), ("Ann_Lee", "Ann_Lee.2")), (("unknown", None), ("unknown.2", "unknown"))):
        got = rotated(spark, (1, 0, "system", "s"), *[(1, i + 1, roles[i % 2], f"t{i}") for i in range(4)])
        assert {r["perspective"] for r in got} == set(names)
        for i, name in enumerate(names):
            own = sorted((r for r in got if r["perspective"] == name), key=lambda r: r["seq"])
            assert [r["mask"] for r in own] == [False] + [j % 2 == i for j in range(4)]
            assert {r["name"] for r in own} == {None, names[1 - i]}
    both = rotated(spark, (None, 0, "a", "x"), (None, 1, "b", "y"))
    assert len(both) == 4
    strings = spark.createDataFrame([(None, 0, "a", "x"), ("", 0, "a", "x")], "conv_id string, turn long, role string, text string")
    assert [r["start"] for r in chat.rotate(strings).collect()] == [0, 0]


def test_rotation_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(0, 900, 7)]), rng.choice(["system", "a b", "a_b", "é", "", None, "c"]), rng.choice([None, "x", "long " * 900, "<|im_start|>"])) for _ in range(400)]
    got = {}
    for r in rotated(spark, *rows):
        got.setdefault((r["conv_id"], r["perspective"]), []).append((r["seq"], r["turn"], r["role"], r["name"], r["rendered"], r["mask"], r["start"], r["stop"]))
    for conv in (1, 2, None):
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0] is None, t[0] or 0, t[1].encode(), t[2].replace("<|im_start|>", "<| im_start|>")))
        names, seen = {}, {}
        for raw in sorted({t[1] for t in turns} - {"system"}, key=str.encode):
            base = "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in raw) or "unknown"
            seen[base] = seen.get(base, 0) + 1
            names[raw] = base if seen[base] == 1 else f"{base}.{seen[base]}"
        for viewer, perspective in names.items():
            at, want = 0, []
            for seq, (turn, raw, text) in enumerate(turns):
                role = "system" if raw == "system" else "assistant" if raw == viewer else "user"
                name = names[raw] if role == "user" else None
                body = f"<|im_start|>{role}{f' name={name}' if name else ''}\n{text.replace('<|im_start|>', '<| im_start|>')}<|im_end|>\n"
                want.append((seq, turn, role, name, body, role == "assistant", at, at + len(body)))
                at += len(body)
            assert sorted(got.pop((conv, perspective))) == want
    assert not got


def test_rotation_of_odd_rows(spark):
    assert rotated(spark) == []
    only = rotated(spark, (1, 0, "system", "x"))
    assert [(r["perspective"], r["mask"]) for r in only] == [(None, False)]
    odd = rotated(spark, (None, None, None, None), (2, 0, "a", "same"), (2, 0, "a", "same"), *[(3, i, "ab"[i % 2], "t" * 500) for i in range(600)])
    assert sorted((r["conv_id"] or 0, r["perspective"]) for r in odd if r["conv_id"] != 3) == [(0, "unknown"), (2, "a"), (2, "a")]
    long = sorted((r["seq"], r["start"], r["stop"]) for r in odd if r["conv_id"] == 3 and r["perspective"] == "a")
    assert len(long) == 600 and all(a[2] == b[1] for a, b in zip(long, long[1:], strict=False))


SENTENCE = "A paragraph of the article that says something of some length, so that it counts as text here. "


def test_headline_in_the_articles_own_header():
    page = f"<html><body><header><h1>Site</h1></header><article><header class='top'><h1>Headline</h1><p>By Someone</p></header>{f'<p>{SENTENCE * 3}</p>' * 4}</article></body></html>"
    assert html_text.main_text(page) == "\n".join(["Headline", "By Someone", *[(SENTENCE * 3).strip()] * 4])


@pytest.mark.parametrize("n", [2, 4, 8, 20])
def test_headed_article_beside_a_longer_part(n):
    page = f"<html><body><div class='artikel'><h1>Title</h1>{f'<p>{SENTENCE}</p>' * n}</div><div class='x1'>{f'<p>{SENTENCE}</p>' * (n + 1)}</div></body></html>"
    assert html_text.main_text(page) == "\n".join(["Title", *[SENTENCE.strip()] * (2 * n + 1)])


def test_reference_list_of_an_article_stays_and_a_menu_goes():
    links = "".join(f"<li><a href='#{k}'>Reference {k}</a></li>" for k in range(5))
    body = f"<h1>T</h1>{f'<p>{SENTENCE * 2}</p>' * 4}<ul>{links}</ul>"
    wanted = ["T", *[(SENTENCE * 2).strip()] * 4]
    assert html_text.main_text(f"<body><ul>{links}</ul><article>{body}</article></body>") == "\n".join([*wanted, *[f"Reference {k}" for k in range(5)]])
    assert html_text.main_text(f"<body><ul>{links}</ul><div>{body}</div></body>") == "\n".join(wanted)


@pytest.mark.parametrize("unit", ["<div>", "<ul><li>", "<b>", "<table><tr><td>", "<section><p>"])
def test_time_is_in_proportion_to_the_page(unit):
    """A page ten times as deep takes about ten times as long, not a hundred times."""

    def took(n):
        began = time.process_time()
        html_text.main_text(unit * n + "x" + "</i>" * n)
        return time.process_time() - began

    took(100)
    assert took(20_000) < 40 * max(took(2_000), 0.02)


def walked(source):
    """Tags of open elements after each tag, by walking the whole path; the parser's stacks must agree."""
    path = ["html"]
    for end, tag in re.findall(r"<(/?)([a-z0-9]+)>", source):
        if end:
            at = max((i for i, t in enumerate(path) if t == tag and i), default=0)
            if at and not (tag in html_text.INLINE and any(t in html_text.SCOPES for t in path[at + 1 :])):
                del path[at:]
            continue
        if tag in html_text.CLOSES_PARAGRAPH:
            edge = max((i for i, t in enumerate(path) if t in html_text.KEEPS_PARAGRAPH and i), default=0)
            at = max((i for i, t in enumerate(path) if t == "p"), default=0)
            if at > edge:
                del path[at:]
            if tag[0] == "h" and tag[1:].isdigit() and path[-1][0] == "h" and path[-1][1:].isdigit():
                path.pop()
        elif tag in html_text.CLOSED_BY:
            tags, stop = html_text.CLOSED_BY[tag]
            edge = max((i for i, t in enumerate(path) if t in stop and i), default=0)
            at = min((i for i, t in enumerate(path) if t in tags and i > edge), default=0)
            if at:
                del path[at:]
        path.append(tag)
    return path


@pytest.mark.parametrize("seed", range(5))
def test_open_elements_equal_a_walk(seed):
    rng = random.Random(seed)
    for _ in range(200):
        source = "".join(f"<{rng.choice(['', '', '/'])}{rng.choice(['p', 'div', 'li', 'ul', 'table', 'tr', 'td', 'b', 'i', 'article', 'h1', 'h2', 'dl', 'dt', 'dd'])}>" for _ in range(rng.randrange(40)))
        root = html_text.parse(source + "<u>here</u>")
        node = next(n for n in reversed(html_text._ordered(root)) if n.tag == "u")
        assert [n.tag for n in html_text._path(node.parent)][::-1] == walked(source)
