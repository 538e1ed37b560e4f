"""The other operators against brute force, round trips or held-out accuracy, with nulls, repeats and clashing columns."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import catalog, html_main, mixing, ordinal, packing, pii, quality_llr, tiff, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, score double, kept string, size int, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(texts, source="a"):
    return [(i, t, source if i % 3 else None, 0.0, "x", 1, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b c " * 40, "naïve 日本語 é " * 30, "word " * 9000, "same line\nsame line\n\nother # line"]
    texts += [" ".join(f"w{rng.randrange(200)}" for _ in range(rng.choice([3, 60, 300]))) for _ in range(30)]
    rows = rows_of(texts)
    return spark.createDataFrame(rows + [rows[7], rows[7], (None, "no id", "b", 0.0, "x", 1, 5)], DOCS).repartition(3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_quality_base_counts(spark, docs):
    def brute(text):
        words = WORD.findall(text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        held = [line for line in (text or "").split("\n") if WORD.search(line)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(held) - len(set(held)), len(covered), failed

    some = docs.filter("text is null or length(text) < 9000")
    trusted = spark.createDataFrame([(20,), (21,)], "doc_id long")
    got = quality_llr.quality_rules(some, trusted).collect()
    want = [(r["doc_id"], *brute(r["text"])) for r in some.collect()]
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, want))
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_llr.quality_rules(some.limit(0), trusted).count() == 0


def test_pii_base_spans():
    text = "mail a.b@x.org and x@y, ip 10.0.0.255 or 1.2.3.256, card 4111 1111 1111 1111, call +49 (30) 123-4567 now"
    found = [(k, text[s:e]) for k, s, e in pii.base_spans(text)]
    assert found == [("email", "a.b@x.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123-4567")]
    assert pii.redact("to a@b.org!", "email:3:10") == "to <email>!"


IBANS = "DE89370400440532013000 GB29NWBK60161331926819 FR1420041010050500013M02606 IT60X0542811101000000123456 NO9386011117947 BE68539007547034 ES9121000418450200051332 CH9300762011623852957 NL91ABNA0417164300".split()


@pytest.mark.parametrize("iban", IBANS)
def test_pii_ibans_of_all_lengths(iban):
    spaced = " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))
    for written in (iban, spaced):
        for text in (f"iban {written}.", f"RE12 {written} EUR PAID now", f"{written} {IBANS[0]}"):
            base = pii.base_spans(text)
            found = [(text[s:e], pii.votes(text, k, s, e)[0]) for k, s, e in pii.candidates(text, base) if k == "iban"]
            assert base or found[0] == (written, 1)
            assert not text.endswith(IBANS[0]) or (IBANS[0], 1) in found


def test_pii_ibans_are_found_and_redacted(spark):
    rows = [(i, f"Please pay to my account: IBAN {x} today") for i, x in enumerate(IBANS)] + [(20 + i, f"order no AB12 XYZ9 {i}000 ABCD in 2020") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs, ["doc_id"]).collect()}
    assert all(IBANS[i] not in pii.redact(rows[i][1], got[i]) and got[i] for i in range(len(IBANS)))


@pytest.mark.parametrize("text", ["MT84MALT01 1", "VG96VPVG00A1B2C3D4E5F6G7", "\u00e9Mr. Smith", "a [at] b.org", "(212) 555-0123", "token = abcdefgh", "AKIA" + "0A1B" * 4])
def test_pii_gate_accepts_what_patterns_match(text):
    patterns = [*pii.CANDIDATES.values(), pii.SHOWN, pii.ASSIGNED]
    assert not any(p.search(text) for p in patterns) or pii.candidates(text, [])


def brute_estimate(kinds, patterns, counts):
    """The same model by plain loops over single spans."""
    p = [1.0 if k in pii.BASE else 1 / (1 + np.exp(-1.5 * sum(v))) for k, v in zip(kinds, patterns, strict=True)]
    clip = lambda x, low, high: min(max(x, low), high)
    for _ in range(pii.EM_STEPS):
        right = {}
        for j in range(len(pii.LABELERS)):
            for c in (1, -1):
                of_class = [n * (q if c == 1 else 1 - q) for n, q in zip(counts, p, strict=True)]
                spoken = sum(w for w, v in zip(of_class, patterns, strict=True) if v[j])
                agreed = sum(w for w, v in zip(of_class, patterns, strict=True) if v[j] == c)
                right[j, c] = clip((agreed + 8) / (spoken + 10), 0.55, 0.98)
        new = []
        for k, v in zip(kinds, patterns, strict=True):
            own = [(n, q) for kk, n, q in zip(kinds, counts, p, strict=True) if kk == k]
            prior = clip((sum(n * q for n, q in own) + 2) / (sum(n for n, _ in own) + 4), 0.1, 0.9)
            yes, no = prior, 1 - prior
            for j, vote in enumerate(v):
                if vote:
                    yes *= right[j, 1] if vote == 1 else 1 - right[j, 1]
                    no *= right[j, -1] if vote == -1 else 1 - right[j, -1]
            new.append(1.0 if k in pii.BASE else yes / (yes + no))
        p = new
    return p


MIXES = {
    "mostly base": {"email,0,1,0,0,0": 9000, "phone,1,0,1,0,0": 40, "card,1,0,0,0,0": 900, "person,0,-1,0,0,0": 5, "iban,1,0,1,0,0": 3, "iban,-1,0,-1,0,0": 4},
    "mostly added": {"email,0,1,0,0,0": 2, "person,0,1,1,0,0": 300, "person,0,-1,0,0,0": 500, "iban,1,0,1,0,0": 90, "iban,-1,0,-1,-1,0": 70, "secret,1,0,1,0,0": 200, "secret,1,0,-1,0,0": 50},
}


@pytest.mark.parametrize("mix", MIXES)
def test_pii_reliabilities_do_not_depend_on_the_mix(mix):
    kinds, patterns = [s.split(",")[0] for s in MIXES[mix]], np.array([[*map(float, s.split(",")[1:])] for s in MIXES[mix]])
    counts = np.array([*MIXES[mix].values()], float)
    got = dict(zip(MIXES[mix], pii.estimate(kinds, patterns, counts), strict=True))
    assert np.allclose([*got.values()], brute_estimate(kinds, patterns.tolist(), counts))
    assert got["email,0,1,0,0,0"] > 0.9 and got["iban,1,0,1,0,0"] > 0.9
    assert all(v < 0.5 for s, v in got.items() if s.startswith(("iban,-1", "person,0,-1")))


def test_pii_planted_spans_are_added_and_clean_texts_left_alone(spark):
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choice("over the river and into small towns they walk".split()) for _ in range(30))
    planted, clean = [], []
    for i in range(60):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        digest = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        value = [f'token = "{secret}"', f"call me at ({rng.randrange(212, 989)}) 555-{rng.randrange(1000, 9999)}", f"write to ana.{i} [at] mail{i}.org", f"signed Dr. Maria {rng.choice(['Holm', 'Keller'])}"]
        planted.append((i, f"{filler()} {value[i % 4]} {filler()}", value[i % 4].split(" ", 3)[-1].strip('"')))
        clean.append((100 + i, f"{filler()} " + [f"commit {digest}", f"page no {rng.randrange(100, 999)}", "token rings and password habits", f"version {i}.2"][i % 4] + f" {filler()}"))
    docs = spark.createDataFrame([r[:2] for r in planted] + clean + [(999, "a@b.org and c@d.com")], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs, ["doc_id"]).collect()}
    assert sum(bool(got[i]) for i, *_ in planted) >= 0.95 * len(planted)
    assert sum(bool(got[i]) for i, _ in clean) <= 0.05 * len(clean)
    assert all(v[-6:] not in pii.redact(t, got[i]) for i, t, v in planted if i % 4 == 0)


def test_pii_every_row(docs):
    got = pii.find_pii(docs, ["doc_id"]).collect()
    assert len(got) == docs.count()
    assert {r["base_sha256"] for r in got if r["doc_id"] in (0, 1)} == {hashlib.sha256(b"").hexdigest()}


def test_mix_meets_targets_and_rows_follow(docs):
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == docs.count()
    for key in {(r["source_size"], r["target"]) for r in mixed}:
        own = [r for r in mixed if (r["source_size"], r["target"]) == key]
        assert sum(r["taken"] for r in own) == int(key[1]) and all(r["taken"] <= 2 * r["size"] for r in own)
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in rows.collect()) == sum(r["taken"] for r in mixed)
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.mixed_rows(docs.limit(0)).count()


def test_a_long_text_is_cut_at_a_word(spark):
    """The source's target ends inside a text of 60,000 words; white space stays as it is."""
    text = "  " + "ab \n c\t" * 30_000
    got = mixing.mixed_rows(spark.createDataFrame([(1, text, "a"), (2, "x y z " * 30_000, "b")], "doc_id long, text string, source string")).collect()
    assert all((text if r["doc_id"] == 1 else "x y z " * 30_000).startswith(r["text"]) for r in got)


def test_url_rules(spark):
    urls = ["http://example.org/es/a", "http://A.Example.ORG/en/12?x", "https://myexample.org/es/", "http://x.com/de/1", "http://com/fr/", "org/", None, "://", "http://a.net/"]
    rows = [(i, u, "h") for i, u in enumerate(urls * 2)]
    rules = spark.createDataFrame([*url_filter.RULES, (None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        return (host.lower(), path, *(max(fits)[1:] if fits else (None, "allow")))

    assert sorted(map(tuple, url_filter.judge_urls(pages, rules).collect())) == [(i, *brute(u)) for i, u, _ in rows]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_models_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    toxic = catalog.op7_toxicity(spark, folder).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    yes, no = ([r["score"] for r in toxic if r["toxic"] == x] for x in (1, 0))
    assert np.mean([a > b for a in yes for b in no]) + 0.5 * np.mean([a == b for a in yes for b in no]) > 0.85
    graded = catalog.op3_ordinal_quality(spark, folder).join(labels, "doc_id").groupBy("quality").agg(F.avg("expected_grade").alias("g")).filter("quality is not null").collect()
    grade = {r["quality"]: r["g"] for r in graded}
    assert grade[1] > grade[0]


def test_models_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity_scores(docs, none).collect()} == {(0.0, 0)}
    graded = spark.createDataFrame([], "doc_id long, grade int")
    assert ordinal.grade_documents(docs, graded, 3).count() == docs.count()


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_round_trip(how, tiled):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4, (h, w, s), np.uint8) for h, w, s in ((1, 1, 1), (70, 65, 3), (200, 64, 1))]
    for predictor, order in ((1, "<"), (2, ">")):
        got = tiff.decode(tiff.encode(pages, how, predictor, tiled, order))
        assert [r[7] for r in got] == [p.tobytes() for p in pages] and not any(r[8] for r in got)


def test_texts_as_tiff(docs):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = tiff.text_images(docs).collect()
    assert len(got) == docs.count() and tiff.decode(None)[0][8] and tiff.decode(b"II*\0junk")[0][8]
    for r in got:
        data = tiff.payload(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))


def test_main_text(spark):
    page = "<html><body><div>Home of all</div><p>{}</p><div class='comments'>nice</div><script>x</script><p>Copyright line</p></body></html>"
    rows = [(i, f"http://a.org/x/{i}", page.format(f"Story {i} &amp; more\n text"), "t") for i in range(3)]
    rows += [(9, None, None, "t"), (10, "http://b.org/", "", "t"), (11, "http://c.org/", "<article><h1>T</h1><p>Body</p></article><footer>f</footer>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_main.main_text(pages).collect()}
    assert got == {**{i: (f"Story {i} & more text", 19) for i in range(3)}, 9: ("", 0), 10: ("", 0), 11: ("T\nBody", 6)}
    assert html_main.main_text(pages.limit(0)).count() == 0


def test_differencing_decides_article_lines_and_cards_do_not_hide_the_body(spark):
    page = "<article><h1>Head {0}</h1><p>All our readers get this offer.</p><p>The long story number {0} of the day.</p><p>Follow us everywhere.</p><p>All rights are ours.</p></article><div>Else {0}</div>"
    card = "<article><p>Read on</p></article><p>The body of this page lies outside, and is longer than its card.</p>"
    rows = [(i, f"http://a.org/x/{i}", page.format(i)) for i in range(3)] + [(7, "http://d.org/", card)]
    got = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Head {i}\nThe long story number {i} of the day." for i in range(3)}, 7: "Read on\nThe body of this page lies outside, and is longer than its card."}


def test_copies_are_passed_over_and_short_pages_lose_their_menus(spark):
    menu = "<div>Menu of all our pages</div><p>Notice to each and every reader here</p>"
    story = "".join(f"<p>Paragraph {i} of the copied story on the host, word for word.</p>" for i in range(9))
    rows = [(i, f"http://a.org/a/{i:03}", menu + story + f"<p>Note {i}</p>") for i in range(40)]  # a group of near copies
    rows += [(i, f"http://a.org/b/{i}", menu + f"<p>Only {i}</p>") for i in (50, 51, 52)]  # short pages, mostly menus
    half = "".join(f"<p>Paragraph {i} that two pages of this host really share.</p>" for i in range(7))
    rows += [(i, f"http://c.org/{i}", menu + half + "".join(f"<p>Own line {j} of the page that has number {i}</p>" for j in range(4))) for i in (60, 61)]
    rows += [(62, "http://c.org/7", menu + "<p>Quite another page</p>")]
    for parts in (1, 7):  # ranges that cut the group are connected
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in html_main.main_text(pages).collect()}
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert all(got[i].endswith(f"Paragraph 8 of the copied story on the host, word for word.\nNote {i}") and got[i].startswith("Paragraph 0") for i in range(40))
        assert [got[i] for i in (50, 51, 52)] == ["Only 50", "Only 51", "Only 52"]
        assert all(got[i].startswith("Paragraph 0 that two") and "Menu" not in got[i] for i in (60, 61)) and got[62] == "Quite another page"


@pytest.mark.parametrize("wrapper", ["div class='content-sidebar-wrap'", "div class='layout has-sidebar'", "div class='sidebar'", "form id=search", "div class='a' role=navigation"])
def test_marks_do_not_swallow_the_article(wrapper):
    page = f"<body><{wrapper}><article><h1>T</h1><section id='related-work'><h2 id='search'>R</h2><p>Body</p></section><div class='share-price'>9</div><div class='share-buttons social'>Post</div><div class='cookie-notice'>C</div></article><div class=ad>Buy</div></{wrapper.split()[0]}></body>"
    found = html_main.lines(page)
    assert [x for zone, x in found if zone == "main"] == ["T", "R", "Body", "9"]
    assert [x for zone, x in found if zone == "dropped"] == ["Post", "C", "Buy"]


def test_a_mark_without_its_end_drops_nothing():
    assert html_main.lines("<div class=ad>a<div>b</div><p>c") == [("free", "a"), ("free", "b"), ("free", "c")]
    assert html_main.lines("<p>a<nav>b<nav>c</nav></nav>d<footer>e") == [("free", "a"), ("dropped", "b"), ("dropped", "c"), ("free", "d"), ("dropped", "e")]
    assert html_main.lines("<article class=comment>a</article><article>b</article>") == [("dropped", "a"), ("main", "b")]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(html_main.shared_lines(a, b)) == best[-1][-1]


def test_packing_is_whole_and_tight(docs):
    got = packing.pack(docs).collect()
    cut = packing.cut_pieces(docs).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, map(tuple, cut)))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = [o + n for o, n in sorted(places)]
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= 1.1 * total / 1024 + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_fast_and_plain_tokenizers_agree():
    exact, _ = packing._encoders(packing.VOCABULARY)
    plain = [chr(c) for c in range(0x180) if packing._PLAIN.fullmatch(chr(c))]
    rng = random.Random(2)
    for text in [*plain, *("".join(rng.choices(plain, k=40)) for _ in range(300)), "it's  we'LL\n\n x\t", "<|endoftext|>"]:
        assert packing.token_ids(text) == exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("how", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_directories_that_claim_too_much_give_an_error_row(how, tiled):
    """Every size field of a good file is set to hostile values; nothing large is allocated and nothing raises."""
    page = np.arange(40 * 64, dtype=np.uint8).reshape(40, 64, 1)
    good = tiff.encode([page], compression=how, tiled=tiled, band=16)
    assert [r[7] for r in tiff.decode(good)] == [page.tobytes()]
    (at,) = np.frombuffer(good[4:8], "<u4")
    (n,) = np.frombuffer(good[at : at + 2], "<u2")
    for i in range(n):
        entry = at + 2 + 12 * i
        if np.frombuffer(good[entry + 4 : entry + 8], "<u4")[0] == 1 and np.frombuffer(good[entry + 2 : entry + 4], "<u2")[0] == 4:
            for value in (0, 1, 4194304, 2**32 - 1):
                bad = good[: entry + 8] + np.uint32(value).tobytes() + good[entry + 12 :]
                assert all((r[7] is None) == (r[8] is not None) for r in tiff.decode(bad))
    huge = bytearray(good)
    for i in range(n):
        entry = at + 2 + 12 * i
        if np.frombuffer(good[entry : entry + 2], "<u2")[0] in (256, 257):
            huge[entry + 8 : entry + 12] = np.uint32(4194304).tobytes()
    assert tiff.decode(bytes(huge))[0][8]


def test_long_alignments_are_subsequences_of_both():
    rng = random.Random(8)
    cases = [tuple([rng.randrange(4) for _ in range(rng.randrange(40))] for _ in range(2)) for _ in range(100)]
    for a, b in cases:
        got, places = html_main.shared_lines(a, b), iter(b)
        assert len(got) == len(html_main.shared_lines(b, a)) and all(a[i] in places for i in sorted(got))
    many = [rng.randrange(2) for _ in range(20_000)]
    assert len(html_main.shared_lines([7] * 20_000, [7] * 60_000)) == 20_000
    assert len(html_main.shared_lines([2, *many, 3], [4, *many[1:], 5])) >= 19_999


def test_pages_with_one_headline_are_versions_and_lose_nothing():
    def page(title, *paragraphs):
        return f"<article><h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs) + "</article>"

    def kept(html, *others):
        return html_main.main_lines(html, *([html_main._hash(line) for _, line in html_main.lines(o)] for o in others))

    end = ("Follow us on all channels.", "Rate this page.", "All rights are ours.")
    mine = page("Storm over town", "It began at noon.", "Trees fell.", *end)
    versions = [page("Storm over town", "It began at noon.", "Roads are closed.", *end), page("Storm over town", "It began at noon.", "Calm again.")]
    assert kept(mine, *versions) == ["Storm over town", "It began at noon.", "Trees fell.", *end]
    strangers = [page("New mayor", "Votes are in.", "Trees fell.", "More soon.", *end), page("Old bridge", "It stands.", *end)]
    assert kept(mine, *strangers) == ["Storm over town", "It began at noon.", "Trees fell."]  # the end two others share goes, one shared line within stays
    assert kept(mine, strangers[0]) == kept(mine, versions[0], strangers[1]) == ["Storm over town", "It began at noon.", "Trees fell.", *end]
    once = [o.replace("<p>Rate this page.</p>", "") for o in strangers]
    assert kept(mine, *once) == ["Storm over town", "It began at noon.", "Trees fell.", *end]  # a single line may be chance


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_articles_of_the_table_keep_all_their_lines(spark):
    """These pages' articles hold no template: differencing must take nothing from them."""
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in catalog.QUERIES["op9_html_main"](spark, SF).collect():
        article = [line for zone, line in html_main.lines(pages[r["page_id"]]) if zone == "main"]
        assert not article or r["text"] == "\n".join(article)


@pytest.mark.parametrize("n", [40, 320, 10_000])
def test_pii_secrets_and_masked_addresses_of_any_length(n):
    rng = random.Random(n)
    key = "".join(rng.choice("abcdefghijkmnopqrstuvwxyzABCDEFGH0123456789") for _ in range(n))
    digits = "".join(rng.choice("0123456789abcdef") for _ in range(n))
    name = "name." * (n // 5)
    for text, held in [(f"token = {key} end", key), (f"sum {digits} end", digits), (f"eyJ{key}.{key}.{key} end", f"eyJ{key}.{key}.{key}"), (f"to {name}x [at] mail.example.org end", f"{name}x [at] mail.example.org")]:
        spans = pii.candidates(text, pii.base_spans(text))
        assert [text[s:e] for _, s, e in spans] == [held]
        assert pii.redact(text, ",".join(f"{k}:{s}:{e}" for k, s, e in spans)) == text.replace(held, f"<{spans[0][0]}>")


@pytest.mark.parametrize("piece", ["eyJ-", "a.b", "token ", "0123456789abcdef" * 4 + "g", "x [at] y ", "AAAA1111 ", "Mr. "])
def test_pii_candidates_take_linear_time(piece):
    text = piece * (400_000 // len(piece))
    began = __import__("time").process_time()
    pii.candidates(text, [])
    assert __import__("time").process_time() - began < 20
