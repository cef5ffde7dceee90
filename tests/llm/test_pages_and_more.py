"""Operators on pages, conversations and vectors against plain versions, with odd rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusloom.llm import chat_format, exact_topk, html_wrapper, url_filter  # noqa: E402
from corpusloom.llm.queries import TRICKY, TRICKY_TEXT, URL_RULES  # noqa: E402

CASES = [
    ("<article><h1>T &amp; x</h1><p><b>one\n two<br>three<p>four</article><footer>no</footer>", "T & x\none two three\nfour"),
    ("<body><nav>menu</nav><main><p>a</p><aside>side</aside><div class='ad'>buy</div><p>b</p></main></body>", "a\nb"),
    ("<article><p>a</p><form><p>mail</p><input><button>go</button></form><ul><li>x<li>y &lt;3</ul></article>", "a\nx\ny <3"),
    ("<article>a<script>var t='</p>';</script><style>p{}</style> b<!-- c --> d</article>", "a b d"),
    ("<article><p>a</p></article><section id=comments><article><p>hi</p></article></section>", "a"),
    ("<article><div class='cookie-notice'>ok?</div><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
    ("<article><p>never closed <i>a", "never closed a"),
    ("plain text &eacute;&#233;&#xe9; &unknown; &", "plain text ééé &unknown; &"),
    ("<article><a href=\"x>y\">link</a> <img alt='>'> tail < 3 </article>", "link tail < 3"),
    ("<div><div><p>long main text of the page, much of it</p><p>more</p></div></div>", "long main text of the page, much of it\nmore"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "deep"),
    ("<title>only a title</title>", ""),
    ("", ""),
    (None, ""),
    ("<article><h1>A</h1><hr>b</article>", "A\nb"),
    ("<article><p title='a hidden gem'>yes</p><p data-x='display: none'>too</p><p data-role=search>also</p></article>", "yes\ntoo\nalso"),
    ("<article>a <math><mi>x</mi></math> <object>o</object><noscript>n</noscript> b</article>", "a x on b"),
    ("<article><p>a</p></article> tail <!-- never closed <p>b", "a"),
    ("<article><p>a < b</p><p>c <a href='x", "a < b\nc <a href='x"),
]


def test_unclosed_tags_are_scanned_once():
    import time

    start = time.perf_counter()
    for page in ("<a " * 350_000, "<article>x " + "<a href=" * 120_000, "<!-- " * 200_000):
        list(html_wrapper.events(page))
    assert time.perf_counter() - start < 5


def test_main_text_of_single_pages(spark):
    rows = [(i, f"http://h{i}.example/x", html, "clash") for i, (html, _) in enumerate(CASES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    host, _ = url_filter.host_and_path(F.col("url"))
    got = html_wrapper.extract_main_text(pages, host, F.col("html"), {"page_id": F.col("page_id")}).collect()
    found = {r.page_id: r.text for r in got}
    for i, (html, wanted) in enumerate(CASES):
        assert found[i] == wanted, (html or "")[:100]
    assert all(r.n_chars == len(r.text) for r in got)


def test_pages_of_one_host(spark):
    """Wrappers of many pages in many parts; pages unlike the others keep their text; repeats and null hosts."""
    rng = random.Random(1)
    rows, wanted = [], {}
    for i in range(400):
        blocks = [f"block {rng.random()}" for _ in range(rng.randrange(0, 30))]
        if i % 50 == 7:
            html = f"<body><div>{''.join(f'<p>{b}</p>' for b in blocks)}</div></body>"
        else:
            menu = "".join(f"<li><a href='/{k}'>{k}</a>" for k in range(rng.randrange(1, 9)))
            body = "".join(f"<p>{'<b>' if rng.random() < 0.3 else ''}{b}" for b in blocks)
            notice = "<div class=notice>stop</div>" if rng.random() < 0.2 else ""
            html = f"<body><nav><ul>{menu}</ul></nav>{notice}<article><h1>t{i}</h1>{body}</article><footer>f{i}</footer></body>"
            blocks = [f"t{i}", *blocks]
        rows.append((i, f"http://{'h' if i % 3 else 'g'}.example/{i}" if i % 10 else None, html))
        wanted[i] = "\n".join(blocks)
    rows += [rows[3]] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    host, _ = url_filter.host_and_path(F.col("url"))
    got = html_wrapper.extract_main_text(pages, host, F.col("html"), {"page_id": F.col("page_id")}).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == wanted
    wrappers = html_wrapper.infer_wrappers(pages, host, F.col("html")).collect()
    assert sorted(r.host for r in wrappers) == ["", "g.example", "h.example"]
    assert all("(<p>" in r.expression for r in wrappers)
    assert html_wrapper.extract_main_text(pages.limit(0), host, F.col("html"), {}).count() == 0


@pytest.mark.parametrize(
    "before, after",
    [
        ("<div class='content has-sidebar'><article>", "</article></div>"),
        ("<div class='no-sidebar'><article>", "</article></div>"),
        ("<div id=page-header-fixed><article>", "</article></div>"),
        ("<div class=widget><article>", "</article></div>"),
        ("<div class=widget>", "</div>"),
        ("<article><section class=related>", "</section></article>"),
    ],
)
def test_layout_words_keep_the_article(before, after):
    html = f"<body><div class=sidebar>side</div>{before}<p>the whole article</p>{after}</body>"
    text, met = html_wrapper.main_text(html, html_wrapper.main_paths(html_wrapper.page_stream(html)))
    assert text == "the whole article" and met


def test_text_that_pages_share_is_the_template(spark):
    """Menus, notices and adverts in plain elements; a notice on some pages; a host of one page has no template."""
    rows, wanted = [], {}
    for i in range(12):
        menu = "<div><ul><li>Home<li>News<li>About us</ul></div>"
        notice = "<div><b>We are closed on Monday</b></div>" if i % 3 == 0 else ""
        own = [f"Headline {i}", f"First part of page {i}", f"Second part of page {i}"]
        html = f"<body>{menu}{notice}<div><h2>{own[0]}</h2><p>{own[1]}<p>{own[2]}</div><div><p>Buy now</p></div></body>"
        rows += [(i, "http://h.example/", html)] * (1 + i % 2)
        wanted[i] = "\n".join(own)
    rows += [(20, "http://one.example/", "<div><p>alone</p></div>")] * 3
    rows += [(30 + i, "http://art.example/", f"<article><h2>Summary</h2><p>text {i}</p></article>") for i in range(3)]
    wanted |= {20: "alone"} | {30 + i: f"Summary\ntext {i}" for i in range(3)}
    for parts in (1, 5):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        host, _ = url_filter.host_and_path(F.col("url"))
        got = html_wrapper.extract_main_text(pages, host, F.col("html"), {"page_id": F.col("page_id")}).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == wanted


def test_unperiodic_rows_stay_bounded():
    rng = random.Random(2)
    page = lambda: html_wrapper.page_stream("".join(f"<{t}>x</{t}>" for t in rng.choices(["h2", "p", "ul", "pre", "h3"], k=900)))
    wrapper = page()
    for _ in range(5):
        wrapper = html_wrapper.align(wrapper, page())
    assert len(wrapper.inside) <= 2000


def plain_verdict(url: str | None):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([k for k in map(rest.find, "/?#") if k >= 0] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0] if rest[end : end + 1] == "/" else ""
    best = None
    for rule, verdict in URL_RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/1?x#y", "https://www.example.com/en/", "http://www.example.com/de/",
    "http://a.example.com/en", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/fr", "http://net/fr/2", "ftp://com/",
    "http://com?x/en/", "http://a.com#/en/", "http://é.org/É/?q", "http://cheappills.org/", "https://best-casinobonus.org/win",
    "http://dailynews.org/science", "http://" + "a" * 5000 + ".org/" + "b" * 5000, "http://a.org/x://y.com/en/", "http://123.45/6",
]


def test_verdicts(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(4, URLS[4], "clash"), (None, URLS[5], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    got = url_filter.judge(pages, F.col("url"), {"page_id": F.col("page_id")}, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[r.page_id] if r.page_id is not None else URLS[5]
        host, path, rule = plain_verdict(url)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]), url
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
    by_host = {r.host: r for r in got}
    assert by_host["cheappills.org"].verdict == "block" and by_host["cheappills.org"].host_words == "cheap pills"
    assert by_host["best-casinobonus.org"].verdict == "block" and by_host["dailynews.org"].verdict == "allow"
    assert url_filter.judge(pages.limit(0), F.col("url"), {}, URL_RULES).count() == 0


def test_odds_are_those_of_plain_counts(spark):
    """Dictionary, hits and odds counted one by one, with runs of letters around the size of a window and far longer."""
    rng = random.Random(12)
    names = ["cheappills", "dailynews", "casinobonus", "sciencenews", "zebra", "bigwin", "newszebra", "qqq", "éclair"]
    sizes = (url_filter.WINDOW - 1, url_filter.WINDOW, url_filter.WINDOW + url_filter.LONGEST, 700, 60_000)
    longs = ["".join(rng.choices(["casino", "zebra", "news", "x"], k=n))[:n] for n in sizes]
    urls = [f"http://{rng.choice(names)}{k % 4}.org/{rng.choice(names)}-{rng.choice(names)}" for k in range(60)]
    urls += [f"http://h{k}.org/zebra/{x}" for k, x in enumerate(longs)] + ["http://12/3", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_filter.judge(pages, F.col("url"), {"page_id": F.col("page_id")}, []).collect()}

    letters = lambda x: [w for w in re.split(r"[\W\d_]+", x.lower()) if w]
    parts = [(letters(h.rpartition(".")[0]), letters(p), h) for h, p, _ in map(plain_verdict, urls)]
    dictionary = Counter(w for words, _ in url_filter.EXAMPLES for w in words.split() for _ in range(url_filter.EXAMPLE_WEIGHT))
    hosts = defaultdict(set)
    for host_words, path_words, host in parts:
        for w in host_words + path_words:
            hosts[w].add(host)
    for w, found in hosts.items():
        if len(found) > 1:
            dictionary[w] += len(found)
    seen = {v: Counter(w for words, x in url_filter.EXAMPLES if x == v for w in words.split()) for v in ("allow", "block")}
    known = set(seen["allow"]) | set(seen["block"])

    def odds(word):
        if word not in known:
            return 0.0
        smooth = url_filter.SMOOTHING
        share = {v: (c[word] + smooth) / (c.total() + smooth * len(known)) for v, c in seen.items()}
        return math.log(share["block"] / share["allow"])

    def cut(piece):
        reach = url_filter.LONGEST
        found = [(i, n, dictionary[piece[i : i + n]]) for i in range(len(piece)) for n in range(1, min(reach, len(piece) - i) + 1)]
        return url_filter.segment(piece, [h for h in found if h[2]], dictionary.total())

    labels = Counter(v for _, v in url_filter.EXAMPLES)
    prior = math.log((labels["block"] + 1) / (labels["allow"] + 1))
    for i, (host_words, path_words, _) in enumerate(parts):
        expected = prior + sum(odds(w) for piece in host_words + path_words for w in cut(piece))
        assert abs(got[i].log_odds - expected) < 1e-6 * max(1, abs(expected))
        assert got[i].verdict == ("block" if expected > 0 else "allow")
        assert got[i].host_words == " ".join(w for piece in host_words for w in cut(piece))


def test_segmentation_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(200):
        piece = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        dictionary = {"a": 5, "ab": 9, "bba": 4, "abab": 2}
        total = 100
        hits = [(i, len(w), n) for w, n in dictionary.items() for i in range(len(piece)) if piece.startswith(w, i)]

        def cost(words):
            # neighbouring unknown words count as one
            known = [math.log(dictionary[w] / total) if w in dictionary else None for w in words]
            return sum(math.log(1 / total) + len(w) * math.log(1 / 12) if k is None else max(k, math.log(1 / total) + len(w) * math.log(1 / 12)) for w, k in zip(words, known))

        best = max(
            cost([piece[a:b] for a, b in zip((0, *cuts), (*cuts, len(piece)))])
            for mask in range(1 << (len(piece) - 1))
            for cuts in [tuple(k + 1 for k in range(len(piece) - 1) if mask >> k & 1)]
        )
        words = url_filter.segment(piece, hits, total)
        assert "".join(words) == piece and abs(cost(words) - best) < 1e-9


def digests(turns):
    texts = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in texts if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in texts)
    return len(texts), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_windows_read_back(spark):
    rng = random.Random(4)
    odd = ["", None, "\\", "###", "####", "</turn>", "\\</turn>\n### assistant: ", TRICKY_TEXT, "a: b", "\\:", " \n", "<", "</tur", "é" * 50]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 30)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "to: ol", None, "as\\sist"])
            text = rng.choice(odd) if rng.random() < 0.5 else " ".join("w" * rng.randrange(1, 6) for _ in range(rng.randrange(200)))
            rows.append((conv if conv else None, turn, role, text, "clash"))
    rows.append((99, 0, "assistant", "word " * 200_000, "clash"))
    rows += [(98, None, "user", "null turn", ""), (98, 1, "user", "tie", ""), (98, 1, "assistant", "tie", ""), (98, 1, "user", "tie", "")]
    rows += [(*x, "") for x in TRICKY]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string").repartition(4)
    windows = chat_format.chat_windows(table).cache()
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    conversations: dict = {}
    for conv, turn, role, text, _ in rows:
        conversations.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == conversations.keys()
    for conv, turns in conversations.items():
        wanted = digests([t[2:] for t in sorted(turns)])
        assert tuple(got[conv])[1:5] == wanted, conv
    size = lambda text: len(text.split()) + 1
    for w in windows.collect():
        turns = list(chat_format.parse(w.text))
        own, repeated = turns[w.repeated :], turns[: w.repeated]
        assert own and all(t[:2] for t in turns)
        assert len(own) == 1 or sum(size(t[1]) for t in turns) <= chat_format.BUDGET + 5 * len(turns)
        history = [t for t in repeated if t[0] != "system"]
        assert sum(size(t[1]) for t in history) <= chat_format.HISTORY + 5 * len(history)
        assert [(s.start, s.end) for s in w.loss] == [t[2:] for t in own if t[0] == "assistant"]
    assert chat_format.read_back(chat_format.chat_windows(table.limit(0))).count() == 0
    windows.unpersist()


def test_a_system_turn_above_the_budget_is_written_once(spark):
    rows = [(1, 0, "system", "s " * 5000)] + [(1, k, ("user", "assistant")[k % 2], "w " * 300) for k in range(1, 200)]
    rows += [(2, *x[1:]) if x[1] else (2, 0, "system", "s " * 500) for x in rows]
    windows = chat_format.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = windows.collect()
    heads = {c: [next(chat_format.parse(w.text))[0] for w in found if w.conv_id == c].count("system") for c in (1, 2)}
    assert heads[1] == 1 and heads[2] == sum(w.conv_id == 2 for w in found) > 1
    for r in chat_format.read_back(windows).collect():
        wanted = digests([x[2:] for x in rows if x[0] == r.conv_id])
        assert tuple(r)[1:5] == wanted and r.formatted_chars < 400_000


def plain_top(rows, k=5):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.setdefault((i, tuple(math.floor(256 * x) for x in v)), None)
    out = []
    for q in sorted({i for i, _ in vectors if i % 50 == 0}):
        found = [
            (-sum(a * b for a, b in zip(x, y)), i)
            for j, x in vectors if j == q
            for i, y in vectors if i != q and len(x) == len(y)
        ]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def test_top_k_matches_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(60)] + [rows[50], rows[51]]
    rows += [(1000, None), (1050, [1.0, None] * 4), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, rows[0][1])]
    rows += [(1200, []), (1201, []), (1250, [0.5, 0.25]), (1251, [1.0, 1.0]), (1300, [0.0] * 8), (1301, [3e4] * 8), (1350, [-3e4] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = exact_topk.top_k(table.repartition(4), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(plain_top(rows))
    assert dict(got.dtypes)["rank"] == "int"
    assert exact_topk.top_k(table.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 20, 1 << 29, 1 << 40])
def test_products_are_exact(scale):
    rng = np.random.default_rng(scale % 97)
    a, b = (rng.integers(-scale, scale, (5, 7)) for _ in range(2))
    exact = a.astype(object) @ b.T.astype(object)
    limit = (1 << 63) - 1
    assert exact_topk.products(a, b).tolist() == [[max(-limit - 1, min(limit, x)) for x in row] for row in exact.tolist()]


def test_elimination_skips_vectors():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-300, 300, (2000, 4))
    query = vectors[0] * 3
    bounds = (vectors @ query).astype(float) + 1
    found, ids = exact_topk.best_of_block(query, bounds, np.arange(2000), np.arange(2000), vectors, 5)
    order = np.lexsort((np.arange(2000), -(vectors @ query)))[:5]
    assert ids.tolist() == order.tolist() and found.tolist() == (vectors @ query)[order].tolist()
