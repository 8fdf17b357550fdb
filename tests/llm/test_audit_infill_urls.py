"""Source divergence, fill-in-the-middle and URL verdicts against plain Python, with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import divergence, infill, urls

# Source divergence


def plain_audit(rows, top, least):
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", find((text or "").translate(lower))
        groups.add((lang, source))
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in seen[lang].items() if n >= least), key=lambda t: t.encode())
        own = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in own}, shares(whole)
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def audited(docs, **options):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, **options).collect())


@pytest.mark.parametrize("sources, terms", [(64, 4096), (2, 3)])
def test_audit_equals_plain_python(spark, sources, terms):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdeäß語😀" for b in "xyZé"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "S3", None])) for _ in range(150)]
    rows += [("zz " * 5000, "en", "s1"), ("", "en", "empty"), (None, "xx", "alone"), ("a1b2", None, "s9"), (None, None, None)] + [("same tie words", "en", "s2")] * 4
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    docs = docs.withColumns({c: F.lit(7) for c in ("term", "n", "p", "value", "rank", "docs", "total")})
    assert audited(docs, top=4, least=3, sources=sources, terms=terms) == plain_audit(rows, 4, 3)


def test_audit_ties_are_expanded_in_utf8_order(spark):
    # Every term of source "a" has equal counts: one step of the ranking holds them all.
    words = ["b", "ａ", "😀", "z", "ä", "a", "y"]
    rows = [(" ".join(words), "en", "a")] * 3 + [("other other", "en", "b")] * 3
    got = audited(spark.createDataFrame(rows, "text string, lang string, source string"), top=3, least=3)
    assert got == plain_audit(rows, 3, 3)
    assert [r[3] for r in got if r[:3] == ("en", "a", "term")] == ["a", "b", "y"]


def test_audit_sends_terms_on_in_bounded_runs(spark, monkeypatch):
    rows = [(" ".join(f"{chr(97 + i % 26)}{chr(97 + j)}" for j in range(26)), "en", f"s{i % 2}") for i in range(80)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    monkeypatch.setattr(divergence, "HELD", 30)
    batches = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).toArrow().to_batches()
    parts = list(divergence._count(iter(batches)))
    assert len(parts) > 5 and max(p.num_rows for p in parts) < 60
    assert sum(sum(p.column("n").to_pylist()) for p in parts) == 80 * 26


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert audited(empty) == []
    few = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y")], "text string, lang string, source string")
    assert audited(few) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_are_exact_for_huge_counts(spark):
    n, total, terms = 3 * 10**12 + 1, 7 * 10**15 + 3, 10**6
    got = spark.range(1).select(divergence._share(*[F.lit(x).cast("long") for x in (n, total, terms)])).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)


# Fill-in-the-middle


def plain_infill(doc_id, text, rate=100, spm=50, unit="line"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), "spm" if h[3] % 100 < spm else "psm", len(prefix), len(middle), out


TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "ä\nöö\n語語語\n😀😀\nend", "no <P> here\nb", "<S>", "<M>\n", "<\nP\n>", "x<S\n>y",
         "é" * 3000 + "\n" + "a" * 3000, "\r\n\t\n \n", "😀\n" * 500, "nul\x00\nb\n"] + ["\n".join("wörd" * (i % 7) for i in range(n)) for n in range(1, 40)]


@pytest.mark.parametrize("unit, rate, spm", [("line", 100, 50), ("char", 100, 50), ("line", 40, 0), ("char", 60, 100)])
def test_infill_equals_plain_python(spark, unit, rate, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (3, "a\nb"), (3, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "h1", "n", "form", "output")})
    got = [tuple(r) for r in infill.fill_in_middle(docs, unit=unit, rate=rate, spm=spm, piece=500).collect()]
    assert sorted(got, key=repr) == sorted((plain_infill(i, t, rate, spm, unit) for i, t in rows), key=repr)


def test_infill_restores_every_text(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in infill.digests(docs).collect()}
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    assert {i: (r.output_sha256, r.restored_sha256) for i, r in got.items()} == {i: (sha(plain_infill(i, t)[5]), sha(t)) for i, t in enumerate(TEXTS)}
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}
    assert infill.digests(docs.limit(0)).collect() == []


def test_char_index_goes_both_ways():
    text = "aé語😀b" * 50 + "plain" * 20 + "ß"
    data = np.frombuffer(text.encode(), np.uint8)
    index = infill.CharIndex.of(data)
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:i].encode()) for i in chars])
    assert (index.places(chars) == places).all() and (index.chars(places) == chars).all()
    assert len(infill.CharIndex.of(np.frombuffer(b"only ascii", np.uint8)).starts) == 0
    with pytest.raises(ValueError):
        infill.cut_places(data, np.array([len(data)]), (np.array([1]), np.array([1])), "word")


# URL verdicts


def plain_verdict(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    below = lambda d: host == d or host.endswith("." + d)
    fits = sorted((r for r in rules if below(r[1]) and path.startswith(r[2])), key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    if fits:
        return host, path, fits[0][1] + fits[0][2], fits[0][0]
    return host, path, None, "block" if any(below(d) for d in listed if d) else "allow"


ODD = [None, "", "no scheme", "http://", "://", "HTTP://EXAMPLE.org/es/1", "http://example.org/en/12?x#y", "http://notexample.org/es/", "http://a.b.com/fr/x",
       "http://a.b.com/fr", "http://com/de/", "http://x.com?/fr/", "http://x.com#/fr/", "http://a..b./p", "http://.org/", "ftp://u@H:80/p://q", "http://ÄÖ.net/é",
       "http://bad.net/", "http://x.bad.net:8080/", "http://x.bad.net", "http://bad.net.x", "http://" + "a." * 3000 + "bad.net/p", "http://" + "b" * 5000 + "bad.net/p"]


def test_verdicts_equal_plain_python(spark):
    rng = random.Random(2)
    names = [f"h{i}" for i in range(300)]
    pages = [(i, u) for i, u in enumerate(ODD)] + [(1000 + i, f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(names)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en/1', 'fr/2', 'de/3', 'es/4'])}") for i in range(2000)]
    pages += [(None, "http://bad.net/"), (1, None), (1, None)]
    listed = ["bad.net", None, "", "bad.net", *(f"{n}.example.net" for n in names[::3]), "www.h7.example.net", "never.seen"]
    table = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "key", "rule", "verdict", "listed")})
    got = [tuple(r) for r in urls.judge(table, spark.createDataFrame([(d,) for d in listed], "name string")).collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain_verdict(u, urls.RULES, listed)) for i, u in pages), key=repr)


@pytest.mark.parametrize("share", [0.001, 0.3, 1.0])
def test_cascade_is_exact_over_its_universe(spark, share):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.rand(3) < share).alias("listed"))
    universe = spark.createDataFrame(universe.collect(), "key string, listed boolean")
    cascade = urls.build_cascade(universe)
    assert universe.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    n = universe.where("listed").count()
    if 0 < n < 10_000:
        assert cascade.bits <= n * 1.4427 * (np.log2(20_000 / n) + 6) + 64 * len(cascade.levels)


def test_cascade_limits(spark):
    one = spark.createDataFrame([("a", True), ("b", False)], "key string, listed boolean")
    with pytest.raises(ValueError):
        urls.build_cascade(one, max_bits=0)
    assert urls.build_cascade(one.where("NOT listed")).levels == ()
    assert len(urls.build_cascade(one.where("listed")).levels) == 1


def test_verdicts_without_rules_list_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/fr/1"), (2, "http://bad.net/")], "page_id long, url string")
    names = spark.createDataFrame([("bad.net",)], "d string")
    assert {tuple(r) for r in urls.judge(pages, names, rules=()).collect()} == {(1, "a.com", "/fr/1", None, "allow"), (2, "bad.net", "/", None, "block")}
    assert {r.verdict for r in urls.judge(pages, names.limit(0)).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), names).collect() == []
    assert "Python" not in urls.judge(pages, names)._jdf.queryExecution().executedPlan().toString()
