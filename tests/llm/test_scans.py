import base64
import gzip
import html
import json
import random
import re
import urllib.parse
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import html_extract, license_scan, quality_rules, secret_scan, url_filter

SCHEMA = "doc_id long, text string, n_words long, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, -1, "x") for i, t in rows], SCHEMA)


def ascii_lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


# --- licenses


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    hits = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))


def test_licenses(spark):
    mit = license_scan.NOTICES["mit-notice"][0].split()
    broken = " ".join([*mit[:10], "extra", *mit[10:18], *mit[19:]])
    rows = [
        (1, "Under the GNU General Public License; gnu general. Public-License GNU GENERAL PUBLIC"), (2, None), (3, ""), (4, "CC BY cc-by Éapache license apache LICENSE"), (5, "x " * 500 + broken),
        (6, "cc"), (7, "mit license"), (7, "mit license"), (None, "apache license"), (8, "Licensed under the GNU General Public License, version 3."), (9, "word " * 30_000 + "cc by"),
    ]
    got = license_scan.scan_licenses(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((i, *plain_licenses(t)) for i, t in rows)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["labels"] == "mit-notice" and 0.6 <= by[5]["score"] < 1
    assert by[8]["labels"] == "gpl,gpl-3.0" and by[8]["score"] == 1.0
    assert by[2]["score"] == 0.0 and by[2]["labels"] == ""
    assert [s["label"] for s in by[7]["spans"]] == ["mit"]
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


# --- quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def quality_rows():
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("ab cd\n e# ü |").strip(" ") + r.choice(["", "x", "\n"]) for _ in range(r.randrange(0, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one " * 9), (103, "a b c d e f g h " * 2), (104, "a b c d e f g h i " * 3), (105, "clean words of some length here " * 2 + " ".join(f"w{i}" for i in range(200)))]
    return rows + [(106, " ".join(f"word{i}" for i in range(60_000))), (None, "same row"), (None, "same row"), (107, "\u00a0 x\u2003y " * 12), (108, " ".join(f"BIG{i}!!" for i in range(50)))]


def test_quality_counts(spark):
    rows = quality_rows()
    got = quality_rules.quality_counts(docs(spark, rows)).collect()
    want = Counter((i, *plain_counts(t)) for i, t in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    by = {r["doc_id"]: r for r in got}
    assert by[105]["kept"] and by[106]["kept"] and not by[108]["kept"]
    assert quality_rules.quality_counts(docs(spark, [])).count() == 0


def test_cascade_agrees_with_the_verdicts(spark):
    rows = docs(spark, quality_rows())
    kept = Counter((r["doc_id"]) for r in quality_rules.quality_counts(rows).where("kept").collect())
    out = quality_rules.quality_filter(rows)
    assert out.columns == rows.columns
    assert Counter(r["doc_id"] for r in out.collect()) == kept


def test_rules_are_ordered_by_rejection_per_cost(spark):
    rules = (quality_rules.Rule("never", lambda t, w, n: F.length(t) < 0), quality_rules.Rule("always", lambda t, w, n: F.length(t) >= 0))
    assert [r.name for r in quality_rules.order_rules(docs(spark, [(1, "x")]), rules)] == ["always", "never"]


# --- URLs


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = ascii_lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_url_filter(spark):
    r = random.Random(4)
    rows = [(i, f"http{r.choice(['', 's'])}://{r.choice(['a', 'WWW.b', 'm.casino-win'])}.example.{r.choice(['org', 'com', 'net'])}/{r.choice(['en', 'fr', 'de', 'es'])}/{r.randrange(300)}{r.choice(['', '?x=1', '#t'])}") for i in range(400)]
    rows += [(500, None), (501, "no scheme"), (502, ""), (503, "x://"), (504, "http://com"), (505, "http://com/fr/?"), (506, "http://fakeorg/"), (507, "http://org/"), (None, "http://a.example.org/en/1"), (508, "http://q.net/" + "long" * 5000), (508, "http://q.net/" + "long" * 5000)]
    table = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, verdict string")
    got = url_filter.filter_urls(table, rules=url_filter.RULES).collect()
    want = Counter((i, *plain_rule(u)[:3]) for i, u in rows)
    assert Counter((x["page_id"], x["host"], x["path"], x["rule"]) for x in got) == want
    urls = dict(rows)
    for x in got:
        told = plain_rule(urls[x["page_id"]])[3]
        assert x["verdict"] == told if told else x["verdict"] in ("allow", "block")
    assert {x["verdict"] for x in got if x["host"] == ""} == {"allow"}
    assert url_filter.filter_urls(table.limit(0)).count() == 0


def test_url_models_tell_held_out_urls_apart(spark):
    words = {True: "casino bets pills jackpot poker".split(), False: "museum library garden science".split()}
    r = random.Random(5)
    make = lambda bad, n: [(f"{r.choice(words[bad])}-{r.choice(words[bad])}{r.randrange(99)}.net", f"/{r.choice('abc')}/{r.randrange(999)}", "r", "block" if bad else "allow") for _ in range(n)]
    schema = "host string, path string, rule string, verdict string"
    model, cut = url_filter.fit_url_filter(spark.createDataFrame(make(True, 300) + make(False, 300), schema))
    test = make(True, 100) + make(False, 100)
    strings = spark.createDataFrame([(h + p, v) for h, p, _, v in test], "k string, v string").distinct()
    scores = url_filter.score_strings(strings.select(F.col("k").alias("__key"), url_filter._characters(F.col("k")).alias("__s")), model)
    rows = strings.join(scores, strings.k == scores["__key"]).collect()
    assert sum((x["score"] > cut) == (x["v"] == "block") for x in rows) >= 0.95 * len(rows)


# --- secrets


def spans(text):
    return [(text[a:b], kind) for a, b, kind in secret_scan.find_secrets(text)]


def test_base_spans_match_the_plain_patterns():
    r = random.Random(6)
    bits = ["password", "Token", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "a" * 24, "é", "x.y/z", "\n", "ab"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(12)))
        want = []
        for kind, pattern, least in (("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
            want += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[2] if kind == "assign" else m[0]) >= least]
        assert sorted(secret_scan.base_spans(text)) == sorted(want)
        assert set(want) <= set(secret_scan.find_secrets(text))


def test_layers():
    inner = "secret=abcdefgh123"
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    assert spans(f"see {packed} end") == [(packed, "assign")]
    twice = urllib.parse.quote(urllib.parse.quote(packed, safe=""), safe="")
    assert [k for _, k in spans(f"u {twice} z")] == ["assign"]
    quoted = urllib.parse.quote("token: abcdef123", safe="")
    assert spans(f"u {quoted} z") == [(quoted, "assign")]
    assert spans("k \\u0074oken = abcdef123 ok") == [("\\u0074oken = abcdef123", "assign")]
    assert ("&#116;oken=abcdef1", "assign") in spans("&#116;oken=abcdef1")
    deep = inner
    for _ in range(6):
        deep = base64.b64encode(deep.encode()).decode()
    assert spans(deep) == [(deep, "assign")]
    assert spans("%2525252525") == [] and spans("") == [] and secret_scan.find_secrets(None) == []
    assert spans(base64.b64encode(b"nothing to see here at all").decode()) == []


def test_repeated_regions_all_count():
    plain = base64.b64encode(b"password=hunter2x").decode()
    packed = base64.b64encode(zlib.compress(b"token: abcdef123")).decode()
    text = f"a {plain} b {packed} c {plain} d {packed} e"
    assert spans(text) == [(plain, "assign"), (packed, "assign")] * 2
    assert secret_scan.redact(text) == "a [SECRET] b [SECRET] c [SECRET] d [SECRET] e"
    outer = base64.b64encode(f"x {plain} y {plain}".encode()).decode()
    assert spans(f"{plain} {outer} {outer}") == [(plain, "assign"), (outer, "assign"), (outer, "assign")]


def test_base64_is_found_wherever_it_starts():
    inner = b"password=hunter2secret"
    for encode in (base64.b64encode, base64.urlsafe_b64encode):
        plain, packed = encode(inner).decode().rstrip("="), encode(zlib.compress(inner)).decode().rstrip("=")
        for code in (plain, packed):
            for glue in ("/", "/a/", "/to/", "abc", "x-", "long_name_"):
                assert spans(f"see {glue}{code} end") == [(glue + code, "assign")]
    r = random.Random(3)
    for _ in range(200):  # - and _ at any place
        code = base64.urlsafe_b64encode(zlib.compress(inner + b" " + r.randbytes(r.randrange(200)))).decode()
        assert spans(f"k {code} z") == [(code, "assign")]
    code = base64.b64encode(inner + b" \xff\xfe\x00" + bytes(200)).decode()
    assert spans(f"k {code} z") == [(code, "assign")]


def test_base64_wrapped_at_line_ends():
    r = random.Random(4)
    noise = " ".join(str(r.random()) for _ in range(30)).encode()
    for end in ("\n", "\r\n", "\n    "):
        for raw in (b"z" * 50 + b" password=hunter2secret", zlib.compress(noise + b" token=abcdef123 " + noise), gzip.compress(noise + b" token=abcdef123")):
            code = base64.encodebytes(raw).decode().strip().replace("\n", end)
            assert spans(f"see: {code}\nend") == [(code, "assign")]
            assert "[SECRET]" in secret_scan.redact(f"see: {code}\nend")
    rows = [base64.b64encode(f" token={w * 3}; ".encode()).decode() for w in ("abc", "def", "ghi")]  # one by one, not wrapped
    assert spans("\n".join(rows)) == [(row, "assign") for row in rows]
    assert spans("a internationalization\nresponsibility of\nothers") == []


def test_inflating_is_bounded(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_INFLATED", 1000)
    bomb = base64.b64encode(gzip.compress(b"password=hunter2x " + b"a " * 100_000)).decode()
    assert {k for _, k in spans(bomb)} == {"assign", "bomb"}


def test_inflating_goes_on(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_INFLATED", 1000)
    secret = b" password=hunter2x "
    for size in (900, 990, 1000, 1010, 5000, 100_000):
        code = base64.b64encode(gzip.compress(b"z " * (size // 2) + secret + b"z " * 3000)).decode()
        assert spans(f"a {code} b") == [(code, "assign"), (code, "bomb")]
    members = base64.b64encode(gzip.compress(b"first") + gzip.compress(b"token: abcdef123")).decode()
    assert spans(members) == [(members, "assign")]
    twice = base64.b64encode(gzip.compress(gzip.compress(random.Random(1).randbytes(3000) + secret))).decode()
    assert (twice, "assign") in spans(twice)
    for data in (bytes(5000), "é".encode() * 3000, b"z" + "é".encode() * 3000):  # no text, and characters at the border
        code = base64.b64encode(zlib.compress(data)).decode()
        assert spans(code) == [(code, "bomb")]


def test_secret_tables(spark):
    rows = [(1, "token=abcdef1 clean"), (2, None), (3, ""), (4, "clean text"), (4, "clean text"), (None, "AKIA" + "A" * 20), (5, "w " * 60_000 + "f" * 30)]
    got = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base"]) for r in secret_scan.scan_secrets(docs(spark, rows)).collect()}
    assert got == {(1, 1, 0, 0, "assign:0:13"), (2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (4, 0, 0, 0, ""), (None, 0, 1, 0, "access:0:24"), (5, 0, 0, 1, "hex:120000:120030")}
    out = secret_scan.redact_secrets(docs(spark, rows), chars_col="n_words")
    assert out.schema == docs(spark, rows).schema
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[1]["text"] == "[SECRET] clean" and by[1]["n_words"] == 14 and by[4]["text"] == "clean text" and by[4]["n_words"] == -1 and by[2]["text"] is None
    assert secret_scan.scan_secrets(docs(spark, [])).count() == 0


# --- HTML


def test_template_of_a_part_of_a_large_host(spark):
    """A notice on few of a host's many pages goes; what copies of one page share stays."""
    notice = "<div><span>This section moves next month</span></div>"
    rows = [(i, f"http://big.example/{i}", f"<body>{notice if i < 8 else ''}<div>own words {i}</div></body>") for i in range(300)]
    rows += [(300 + i, "http://big.example/copy", "<body><div>one and the same page</div></body>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    assert got == {i: f"own words {i}" if i < 300 else "one and the same page" for i in range(309)}


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a\n b<p>c<br>d", "a b\nc d"), ("<p>a < b &lt; c</p>", "a < b < c"),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", "x\ny\n1\n2\n3"), ('<div title="a>b">x</div><script>if (a<b) {}</script>y', "x\ny"),
        ("<nav>n</nav><article><header><h1>T</h1><p>by</p></header><p>b<b>old</b></p><div class='comments'><p>c</p></div></article><footer>f</footer>", "T\nbold"),
        ("<article>small</article><article>the larger one</article>", "the larger one"), ("<div id=main><p>m</div><aside>s</aside>", "m"),
        ("<body><div class='cookie-notice'>c</div><div role=navigation>n</div><p style='display: none'>h</p><p hidden>h</p><form>f</form>t", "t"), ("<p>a</b></i>c<!-- d --><!doctype x>e", "ace"),
    ],
)
def test_extract_text(page, text):
    assert html_extract.extract_text(page) == text


def test_deep_and_long_pages():
    assert html_extract.extract_text("<div>" * 20_000 + "x") == "x"
    assert html_extract.extract_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()


def test_site_templates_go(spark):
    body = lambda i: f"<div><span>Site of things</span></div><section><p>Story number {i} is told here.</p></section><div><p>All rights kept, nothing given</p></div>"
    rows = [(i, f"http://a.example.com/{i}", body(i)) for i in range(20)] + [(99, "http://b.example.com/", body(99)), (100, None, None), (99, "http://b.example.com/", body(99))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = Counter((r["page_id"], r["text"]) for r in html_extract.extract_pages(pages).collect())
    assert all(got[(i, f"Story number {i} is told here.")] == 1 for i in range(20))
    assert got[(99, "Site of things\nStory number 99 is told here.\nAll rights kept, nothing given")] == 2 and got[(100, "")] == 1
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_repeated_prose_of_articles_stays(spark):
    rows = [(i, "http://a.com/", f"<article><p>The same words on every page.</p><p>{i}</p></article>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"The same words on every page.\n{i}" for i in range(12)}


def test_character_references():
    assert html_extract.extract_text("<p>" + html.escape(json.dumps({"a": "<b>"})) + "&eacute;&#233;&nbsp;x</p>") == '{"a": "<b>"}éé x'


# --- against plain versions


def plain_labels(text):
    """Labels and score by comparing every place of a text with every place of every template."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    labels, score = set(), 0.0
    for _, label, is_base, template, k in license_scan.templates():
        need = len(template) - k + 1
        hits = {}
        for p in range(len(words) - k + 1):
            for t in range(need):
                if words[p : p + k] == template[t : t + k]:
                    hits.setdefault(p - t, set()).add(t)
        groups, last = [], None
        for d in sorted(hits):
            if last is None or is_base or d - last > license_scan.NEIGHBOURS:
                groups.append(set())
            groups[-1] |= hits[d]
            last = d
        least = 1.0 if is_base or need <= license_scan.FEW_GRAMS else license_scan.LEAST_SHARE
        for group in groups:
            if len(group) / need >= least:
                labels.add(label)
                score = max(score, len(group) / need)
    return ",".join(sorted(labels)), round(score, 9)


def test_license_labels_equal_the_plain_version(spark):
    r = random.Random(8)
    notices = [t.split() for texts in license_scan.NOTICES.values() for t in texts]
    rows = [(0, "licensed under cc by licensed under cc by 4"), (1, "Licensed under CC BY 4.0"), (1, "Licensed under CC BY 4.0"), (2, "the software " * 40)]
    for i in range(3, 60):
        words = []
        for _ in range(r.randrange(4)):
            part = list(r.choice(notices))
            for _ in range(r.randrange(4)):
                at = r.randrange(len(part))
                part[at : at + r.randrange(3)] = r.choice([[], ["extra"], part[at : at + 3] * 2])
                part = part or ["x"]
            words += part + ["and"] * r.randrange(3)
        rows.append((i, " ".join(words)))
    got = Counter((x["doc_id"], x["labels"], round(x["score"], 9)) for x in license_scan.scan_licenses(docs(spark, rows)).collect())
    assert got == Counter((i, *plain_labels(t)) for i, t in rows)
    assert plain_labels(rows[0][1])[0] == "cc-by"


def plain_kinds(text, seen=()):
    """Kinds of secrets in a text and in all that it decodes to, one way after the other, without a worklist."""
    if text in seen or len(seen) > 12:
        return set()
    seen = (*seen, text)
    kinds = {kind for _, _, kind in secret_scan._scan(text)}
    opened = re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)
    opened = re.sub(r"(?:\\u[0-9A-Fa-f]{4})+", lambda m: bytes.fromhex(m[0].replace("\\u", "")).decode("utf-16-be", "replace"), opened)
    opened = re.sub(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|quot|amp|lt|gt|apos|equals|colon);", lambda m: html.unescape(m[0]), opened)
    if opened != text:
        kinds |= plain_kinds(opened, seen)
    for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", text):
        bare = m[0].rstrip("=")
        bare = bare[: len(bare) - (len(bare) % 4 == 1)]
        raw = base64.b64decode(bare + "=" * (-len(bare) % 4))
        for unpack in (lambda b: b, gzip.decompress, zlib.decompress):
            try:
                kinds |= plain_kinds(unpack(raw).decode(), seen)
            except (ValueError, OSError, zlib.error, EOFError):
                pass
    return kinds


def test_layers_equal_the_plain_version():
    r = random.Random(12)
    secrets = {"assign": "password=hunter2secret", "access": "AKIA" + "Q7" * 10, "hex": "0a1b2c3d" * 4, "forge": "ghp_" + "Ab1" * 12}
    b64 = lambda raw: base64.b64encode(raw).decode()
    ways = [
        lambda t: urllib.parse.quote(t, safe=""), lambda t: "".join(f"%{b:02x}" for b in t.encode()), lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: "".join(f"&#{ord(c)};" for c in t),
        lambda t: b64(t.encode()), lambda t: b64(gzip.compress(t.encode())), lambda t: b64(zlib.compress(t.encode())),
    ]
    for _ in range(150):
        kind = r.choice(list(secrets))
        code = f"say {secrets[kind]} now"
        for _ in range(r.randrange(1, 4)):
            code = r.choice(ways)(code)
        text = f"before {code} after"
        found = secret_scan.find_secrets(text)
        assert kind in {k for _, _, k in found} and {k for _, _, k in found} >= plain_kinds(text)
        assert all(7 <= a < b <= 7 + len(code) for a, b, _ in found), text
        assert secret_scan.redact(text).startswith("before ") and secret_scan.redact(text).endswith(" after")
        assert kind not in plain_kinds(secret_scan.redact(text))
    quiet = " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randrange(1, 24))) for _ in range(2000))
    assert secret_scan.find_secrets(quiet) == []


def test_bad_bytes_do_not_hide_escapes():
    assert spans("%ff%73%65%63%72%65%74=abcdef12") == [("%73%65%63%72%65%74=abcdef12", "assign")]
    assert spans("x %80%ff%3Dpassword%3dhunter2x%fe y")[0][1] == "assign"
    assert [kind for _, kind in spans("\\ud800\\u0074oken = abcdef123")] == ["assign"]


def test_urls_with_a_path_alone_are_judged(spark):
    rows = [(1, "file:///x/casino"), (2, "x://"), (3, "no scheme"), (4, None)] + [(10 + i, "http://example.com/de/casino-jackpot") for i in range(30)]
    got = {x["page_id"]: x for x in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1]["host"] == "" and got[1]["path"] == "/x/casino" and got[1]["score"] is not None
    assert all(got[i]["score"] is None and got[i]["verdict"] == "allow" for i in (2, 3, 4))
    assert url_filter.filter_urls(spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")).first()["verdict"] in ("allow", "block")


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p title='x>y'>z</p>", "z"), ("<p title=it's>z</p><p>a='b</p>", "z\na='b"), ("<a href=\"x>y\" title='\">'>z</a>", "z"), ("<p title='open>z</p>", "z"),
        ("<article><p class='related-work'>a</p><section id='search-methods'><p>b</p></section><div class='comment-list'><p>c</p></div><div id=comments>d</div><div class=ad>e</div><ul class='share buttons'><li>f</ul></article>", "a\nb"),
        ("<article><h2 id=related>R</h2><p id=search>s</p><div role=navigation>n</div></article>", "R\ns"),
    ],
)
def test_parts_of_articles_stay(page, text):
    assert html_extract.extract_text(page) == text


def test_articles_under_several_urls_stay(spark):
    article = "<article><div class='body'><p>Told once, found under many names.</p><ol><li>one</li><li>two</li></ol></div></article>"
    rows = [(i, f"http://a.com/{i}", f"<body><div>page {i}</div>{article}</body>") for i in range(12)] + [(i, "http://b.com/", f"{article}") for i in range(20, 26)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"Told once, found under many names.\none\ntwo"} and len(got) == 18


def test_pages_equal_what_they_were_made_from(spark):
    """Random pages of several hosts, whose text is known from how they are made; some are there more than once."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7)))
    line = lambda: " ".join(word() for _ in range(r.randrange(1, 9)))
    rows, want = [], Counter()
    for h in range(4):
        menu = "<ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(4)) + "</ul>"
        notice = f"<div><span>{line()}</span><em title='a>b'>{line()}</em></div>"
        shared = f"<p>{line()}</p>"  # the same words in many articles
        for i in range(r.choice([3, 30])):
            blocks, lines = [], []
            for _ in range(r.randrange(1, 6)):
                text = line()
                tag = r.choice(["p", "h2", "blockquote", "li", "section"])
                body = html.escape(text).replace(" ", r.choice([" ", "  ", "\n", "&#32;"]))
                blocks.append(f"<{tag} class='{r.choice(['x', 'related-work', 'intro'])}'>{r.choice(['', '<b>'])}{body}</{tag}>")
                lines.append(text)
            if r.random() < 0.5:
                blocks.append(shared)
                lines.append(shared[3:-4])
            if r.random() < 0.5:
                blocks.insert(r.randrange(len(blocks)), "<div class='ad'>buy</div><script>var a='<p>';</script><!-- <p>no</p> -->")
            page = f"<html><body><nav>{menu}</nav><div class='cookie-note cookie'>yes</div>{notice}<article>{''.join(blocks)}</article>{menu}<footer>{line()}</footer></body></html>"
            for _ in range(r.choice([1, 1, 1, 6])):
                rows.append((len(rows), f"http://h{h}.example/{i}", page))
                want[(rows[-1][0], "\n".join(lines))] += 1
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert Counter((x["page_id"], x["text"]) for x in html_extract.extract_pages(pages).collect()) == want


def test_large_templates_are_dealt_to_their_pages(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    test_site_templates_go(spark)


def test_secret_tables_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "token=abcdef1", "b", "s", "t"), (2, None, None, None, None)], "doc_id long, text string, base string, spans string, __text string")
    assert {(r["doc_id"], r["n_assign"], r["base"]) for r in secret_scan.scan_secrets(rows).collect()} == {(1, 1, "assign:0:13"), (2, 0, "")}
    assert {(r["doc_id"], r["text"], r["base"], r["__text"]) for r in secret_scan.redact_secrets(rows).collect()} == {(1, "[SECRET]", "b", "t"), (2, None, None, None)}
