"""The Spark operators against brute force on small tables with nulls, ties, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meterline.llm import components, dialogues, language_model, lattice, licences, minhash, neighbours, quality, substrings

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def groups(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    expected = groups({x for p in real for x in p}, real)
    assert got == expected
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_copies():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["Ärger", "THE"]
    rows, key = [], 0
    for size in (30, 60, 200):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(5):
                own = list(base)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    own[rng.randrange(size)] = rng.choice(words)
                rows.append((key, " ".join(own)))
                key += 1
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a"), (906, rows[0][1]), (907, rows[0][1].upper())]


@pytest.mark.parametrize("block", [256, 3])
def test_minhash_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component int, bucket string")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    sets = {}
    for key, text in rows:
        w = WORD.findall(lowered(text))
        sets[key] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = []
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= 85 * len(sets[a] | sets[b]):
                links.append((a, b))
    expected = groups(sets, links)
    assert len(links) > 40
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {
        k: (len(sets[k]), expected[k], expected[k] == k) for k in sets}
    if block == 3:
        assert minhash.near_duplicates(docs.limit(0)).count() == 0


def removal(rows, length):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for n, b in enumerate(data):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s:s + length], []).append((n, s))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for n, s in places:
                gone[n][s:s + length] = b"\1" * length
    return sorted(((key, len(b), sum(g), len(re.findall(b"\1+", bytes(g))),
                   hashlib.sha256(bytes(x for x, f in zip(b, g) if not f)).hexdigest()) for (key, _), b, g in zip(rows, data, gone)), key=repr)


def removed(docs, length):
    """Rows of the operator; the kept text is held against the digest where no character is cut in two."""
    rows = substrings.removal_digests(docs, length).collect()
    for r in rows:
        assert r.n_bytes - r.n_removed >= len(r.kept_text.encode())
        if r.n_bytes - r.n_removed == len(r.kept_text.encode()):
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    return sorted((tuple(r)[:5] for r in rows), key=repr)


@pytest.mark.parametrize("length, hot", [(40, 50_000), (17, 50_000), (40, 1), (61, 2)])
def test_substrings_equal_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(9)
    words = ["the", "of", "än", "é", "xy", "zz9", " "]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    shared, rows = [text(60) for _ in range(6)], []
    for i in range(50):
        own = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(shared)
            a = rng.randrange(len(part))
            own = own[:len(own) // 2] + part[a:rng.randint(a, len(part))] + own[len(own) // 2:]
        rows.append((i, own))
    rows += [(100, "a" * 300), (101, "a" * 170), (102, ""), (103, None), (104, "ab" * 100), (105, rows[3][1]), (105, rows[3][1]), (105, "zz"), (None, rows[4][1])]
    docs = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, version string, spans int")
    assert removed(docs, length) == removal(rows, length)


def test_substrings_never_sort_a_hot_bucket(spark, monkeypatch):
    """A passage of all documents with different text on either side of it: one class a document at each edge."""
    plain = substrings.repeated_windows

    def bounded(bucket, *rest):
        assert np.unique(bucket, return_counts=True)[1].max() <= 20
        return plain(bucket, *rest)
    monkeypatch.setattr(substrings, "HOT", 20)
    monkeypatch.setattr(substrings, "repeated_windows", bounded)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(160)
    rows = [(i, text(rng.randint(0, 90)) + passage + text(rng.randint(0, 90))) for i in range(80)] + [(200, None), (201, text(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(docs, 60) == removal(rows, 60)


def test_rows_that_repeat_a_text_have_its_spans_once(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(None, text)] * 120 + [(-1, text), (7, text[:100])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substrings.repeated_spans(substrings.keyed(docs), 60).collect()
    assert max(len(r.spans) for r in spans) <= 2 * len(text) and sum(len(r.spans) for r in spans) == len({(r.id, r.version, tuple(s)) for r in spans for s in r.spans})
    assert removed(docs, 60) == removal(rows, 60)


@pytest.mark.parametrize("pieces_of", [300, 1_000_000])
def test_planted_passages_are_removed_from_400_bytes_on(spark, monkeypatch, pieces_of):
    """Passages of over 50 words in otherwise different documents, by length; what the texts are read with changes nothing."""
    monkeypatch.setattr(substrings, "PLACES", pieces_of)
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(a, b)))
    planted, rows = {}, []
    for i, (low, high) in enumerate([(3, 6), (4, 7), (6, 9), (7, 9), (8, 10)] * 4):
        planted[i] = " ".join(word(low, high) for _ in range(52))
        rows += [(10 * i + k, " ".join(word(2, 8) for _ in range(60)) + " " + planted[i] + " " + " ".join(word(2, 8) for _ in range(40))) for k in range(2)]
    got = {r.doc_id: r for r in substrings.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(len(p) >= 400 for p in planted.values()) >= 8 and sum(len(p) < 398 for p in planted.values()) >= 6
    for i, p in planted.items():
        for k in range(2):
            r = got[10 * i + k]
            # Blanks and chance letters on either side may be shared as well, so a passage of 398 or 399 bytes may go.
            assert (p not in r.kept_text and r.n_removed >= len(p)) if len(p) >= 400 else (len(p) >= 396 or p in r.kept_text)


def test_texts_without_repeats(spark):
    passage = "Überall steht derselbe Absatz, lang genug, um aufzufallen. " * 2
    rows = [(1, "ä1-" + passage + " é", "u"), (2, passage, "v"), (3, "short", "w"), (4, None, "x")]
    got = {r.doc_id: (r.text, r.id) for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, id string"), 60).collect()}
    assert got == {1: ("ä1- é", "u"), 2: ("", "v"), 3: ("short", "w"), 4: (None, "x")}


def lm_oracle(learned, text, weight=0.15):
    """(tokens, known, base, score) of a text by plain counting over the *learned* texts, pairs by the step they reach."""
    counts, pairs = Counter(), Counter()
    for other in learned:
        t = [*WORD.findall(lowered(other)), None]
        counts.update(t)
        pairs.update(zip([None, *t], t))
    n, v = sum(counts.values()), len(counts)
    t = [*WORD.findall(lowered(text)), None]
    step = lambda c: max([s for s in language_model.STEPS.tolist() if s <= c], default=0)
    share = [weight * step(pairs[p]) / max(1, counts[p[0]]) for p in zip([None, *t], t)]
    frequency = [(counts[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
    return (len(t), sum(counts[w] > 0 for w in t), sum(map(math.log10, frequency)),
            sum(math.log10(s + (1 - weight) * f) for s, f in zip(share, frequency)))


def lm_rows():
    rng = random.Random(6)
    vocabulary = ["the", "Of", "naïve", "x1", *[f"w{i}" for i in range(30)]]
    return [*[(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(120)],
            (500, None), (501, ""), (502, "only here"), (503, "the of " * 3000), (None, "the of"), (7, "an id twice")]


def is_held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 10 == 0


# With 200 bits an entry one probe in six million is a false hit: scores are those of plain counting.
@pytest.mark.parametrize("per_segment", [2_000_000, 500])
def test_language_model_equals_plain_counting(spark, monkeypatch, per_segment):
    monkeypatch.setattr(language_model, "PER_SEGMENT", per_segment)
    rows = lm_rows()
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, token string, chunk int")
    got = language_model.train_and_score(docs, bits=200).collect()
    learned = [t for k, t in rows if not is_held(k)]
    wanted = sorted((str(k), is_held(k), *lm_oracle(learned, t)) for k, t in rows)
    found = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    assert [f[:4] for f in found] == [w[:4] for w in wanted]
    assert {r.train_tokens for r in got} == {sum(len(WORD.findall(lowered(t))) + 1 for t in learned)}
    for f, w in zip(found, wanted):
        assert f[4] == pytest.approx(w[4], rel=1e-12) and f[5] == pytest.approx(w[5], rel=1e-12)
    assert language_model.train_and_score(docs.limit(0)).count() == 0


def test_language_model_scores_texts_it_has_not_seen(spark):
    rows = lm_rows()
    model = language_model.learn(spark.createDataFrame(rows, "doc_id long, text string"), bits=200)
    # The stored rows are all that the model is: filter segments without keys, words with counts.
    assert {r.kind: r.bytes for r in model.rows.groupBy("kind").agg({"keys": "max"}).selectExpr("kind", "length(`max(keys)`) AS bytes").collect()}[1] == 0
    new = ["the of w1 w2", "never a word", "", None, "w1 " * 50]
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(new):
        n, known, base, full = lm_oracle([x for _, x in rows], t)
        assert (got[i].n_tokens, got[i].n_known) == (n, known)
        assert got[i].base_score == pytest.approx(base, rel=1e-12) and got[i].score == pytest.approx(full, rel=1e-12)
    empty = language_model.learn(spark.createDataFrame([], "doc_id long, text string"))
    unknown = language_model.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty).first()
    assert (empty.train_tokens, empty.vocabulary, unknown.n_known) == (0, 0, 0)
    assert unknown.base_score == pytest.approx(0) and unknown.score == pytest.approx(3 * math.log10(0.85))


def test_sorted_keys_are_packed_without_loss():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (language_model._plain_sorted(language_model._packed_sorted(keys), len(keys)) == keys).all()
    keys = np.array([0, 0, 1, 2**64 - 1], np.uint64)
    assert (language_model._plain_sorted(language_model._packed_sorted(keys), 4) == keys).all()
    assert 4 * 3000 > len(language_model._packed_sorted(np.sort(rng.integers(0, 1 << 34, 3000, dtype=np.uint64))))


def near_score(spark, rows, **options):
    """(score, expected score) of each row: pairs by their step, contexts and words by their counts."""
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    learned = [t for k, t in rows.items() if not is_held(k)]
    for r in language_model.train_and_score(docs, **options).collect():
        yield r.score, lm_oracle(learned, rows[r.doc_id])[3]


def test_language_model_keeps_pairs_seen_once(spark):
    found = list(near_score(spark, {i: " ".join(f"w{i}x{j}" for j in range(30)) + " the of" * (i % 3) for i in range(100)}))
    # A false hit of the filter can only raise a probability.
    assert all(got >= least - 1e-9 for got, least in found)
    assert sum(got <= least + 0.5 for got, least in found) >= 90


def test_language_model_counts_rare_contexts_exactly(spark):
    """Each word is followed by the same one: a share of one, however rare it is."""
    rows = {i: " ".join(f"w{i % 20}x{j}" for j in range(40)) + " the of to and" * 30 for i in range(100)}
    assert all(got == pytest.approx(least, rel=1e-12) for got, least in near_score(spark, rows, bits=200))


def test_language_model_sends_a_hot_pair_once_a_chunk(spark):
    docs = spark.createDataFrame([(i, False, "again and " * 5000) for i in range(40)], "id long, held_out boolean, text string")
    chunks = language_model.chunks(docs).cache()
    n = chunks.count()
    for learning in (True, False):
        sent = language_model.keys_of(chunks, 8, learning).cache()
        # END, "again", "and"; the end and first word, the two ways round, and the last word and end.
        assert {r.kind: r.n for r in sent.groupBy("kind").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()} == {0: 3 * n, 1: 4 * n}
        assert sent.where("counts IS NOT NULL").count() == (sent.count() if learning else 0)
    learned = {r.kind: r for r in language_model.segment_rows(language_model.keys_of(chunks, 1, True)).collect()}
    counts = np.frombuffer(pa.decompress(learned[0].data, 24, "zstd", asbytes=True), "<i8")
    assert sorted(counts.tolist()) == [40, 200000, 200000] and (learned[0].n, learned[1].n) == (3, 4)


def test_filter_never_understates_and_seldom_overstates():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    counts = language_model.STEPS[rng.integers(0, 6, len(keys))]
    data = language_model.filled_segment(keys, counts)
    found = np.concatenate([[0], language_model.STEPS])[language_model.probed_segment(data, keys)]
    assert (found >= counts).all() and (found > counts).mean() < 0.05
    assert (language_model.probed_segment(data, rng.integers(0, 1 << 40, 5000, dtype=np.uint64)) > 0).mean() < 0.05
    assert language_model.filled_segment(keys[:0], counts[:0]) == b"" and not language_model.probed_segment(b"", keys).any()


def clustered(rng, size=16):
    rows = []
    for _ in range(60):
        v = rng.normal(size=size)
        u = v / np.linalg.norm(v)
        rows.append(v)
        for c in (0.93, 0.95, 0.85, 0.9999):
            z = rng.normal(size=size)
            z -= (z @ u) * u
            rows.append((c * u + math.sqrt(1 - c * c) * z / np.linalg.norm(z)) * rng.uniform(0.1, 9))
    return [r.tolist() for r in [*rows, *[rows[7]] * 20]]


@pytest.mark.parametrize("block", [2048, 16])
def test_lattice_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    values = clustered(np.random.default_rng(1))
    n = len(values)
    rows = list(enumerate([*values, None, [0.0] * 16, [math.nan] + [1.0] * 15, [None] + [1.0] * 15, [math.inf] * 16, [1.0]]))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicate_vectors(docs).collect()}
    x = np.array(values)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    found = groups(range(len(rows)), zip(*np.nonzero(close)))
    expected = {k: (int(close[k].sum()) if k < n else 0, found[k], found[k] == k) for k, _ in rows}
    right = sum(got[k] == expected[k] for k in expected)
    assert all(got[k][0] <= expected[k][0] for k in expected) and right >= 0.98 * len(rows)
    assert all(got[k] == expected[k] for k in range(n, len(rows)))
    assert lattice.near_duplicate_vectors(docs.limit(0)).count() == 0


def test_lattice_decodes_to_the_nearest_point():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(200, 8)) * 2
    found = lattice.decode(points)
    twice = np.rint(2 * found).astype(int)
    assert (np.abs(2 * found - twice) < 1e-9).all() and (twice.sum(1) % 4 == 0).all() and ((twice % 2 == twice[:, :1] % 2).all())
    best = ((points - found)**2).sum(1)
    for step in lattice.neighbours():
        assert (best <= ((points - found - step)**2).sum(1) + 1e-9).all()
    assert len(lattice.neighbours()) == 240


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = [*rng.normal(size=(1500, 12)).tolist(), *[[1.0] * 12] * 9, None, [0.0] * 12]
    rows = list(enumerate(values))
    docs = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, rank int")
    monkeypatch.setattr(neighbours, "ROWS", 200)
    monkeypatch.setattr(neighbours, "QUERIES", 11)
    got = {}
    for r in neighbours.nearest_neighbours(docs, leaf=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = np.array(values[:1509])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1509, 50):
        near = x @ x[q]
        near[q] = -2
        best = np.lexsort((np.arange(1509), -np.round(near, 12)))[:5]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s - near[v]) < 1e-12 for _, v, s in own)
        hits += len(set(best.tolist()) & {v for _, v, _ in own})
    assert sorted(got) == list(range(0, 1509, 50)) and hits >= 0.9 * 5 * len(got)
    assert [v for _, v, _ in sorted(got[1500])] == [1501, 1502, 1503, 1504, 1505]
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 4.0]), (50, None)], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest_neighbours(few).collect()] == [(0, 1)]
    assert neighbours.nearest_neighbours(few.limit(0)).count() == 0


def test_quality_learns_and_scores(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(400):
        good = i % 4 != 0
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words) + "." if good else "!! ".join(words).upper()))
        marks.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "x")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, y string")
    labels = spark.createDataFrame([*marks, (3, None), (None, 1), (5, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = dict(marks)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {r.doc_id for r in got if r.predicted}
    blank = quality.score(docs, quality.learn(docs, labels.limit(0))).select("score").distinct().collect()
    assert [r.score for r in blank] == [0.5]
    assert quality.score(docs.limit(0), model).count() == 0


def plain_features(text):
    """The features of a text, counted one byte and one word at a time."""
    if not text:
        return [0.0] * len(quality.FEATURES)
    data, words, lines = text.encode(), text.split(), text.splitlines()
    n, m = len(data), max(1, len(text.split()))
    share = lambda keep: sum(1 for b in data if keep(chr(b))) / n
    upper, lower = sum("A" <= chr(b) <= "Z" for b in data), sum("a" <= chr(b) <= "z" for b in data)
    marks = sum(a == b and 32 < b < 65 and not 48 <= b <= 57 for a, b in zip(data, data[1:]))
    return [math.log1p(n), upper / n, lower / n, share(lambda c: "0" <= c <= "9"), share(lambda c: c == " "), share(lambda c: c == "\n"),
            share(lambda c: ord(c) > 127), share(lambda c: c == "!"), share(lambda c: c == "|"), share(lambda c: c in "#$%&*@~^=+<>\\_{}[]"),
            share(lambda c: c == "."), share(lambda c: c == ","), marks / n, math.log1p(len(words)), sum(len(w) for w in words) / m,
            len(set(words)) / m, len(set(lines)) / max(1, len(lines)), sum(len(w) < 4 for w in words) / m,
            len(words) / max(1, len(lines)), upper / max(1, upper + lower)]


def plain_score(model, text):
    """The logistic of the base, a value of each feature's table and one of each pair's grid, bins found one edge at a time."""
    x = plain_features(text)
    at = lambda edges, v: sum(1 for e in edges if e <= v)
    total = model.base + sum(values[at(edges, v)] for edges, values, v in zip(model.edges, model.tables, x))
    total += sum(grid[at(model.coarse[a], x[a]), at(model.coarse[b], x[b])] for (a, b), grid in model.pairs.items())
    return 1 / (1 + math.exp(-total))


def quality_rows():
    rng = random.Random(12)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice("abcdefghijäß9") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 60))]
        rows.append((i, rng.choice([" ", "\n", ", "]).join(words) + "." if i % 3 else "!! ## ".join(words).upper()))
    return [*rows, (400, None), (401, ""), (402, " \n"), (403, "Ω| 1..2 " * 40_000), (404, "!!"), (None, rows[0][1]), (0, rows[0][1])]


def test_quality_scores_equal_plain_addition(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, id string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k, _ in rows[:300]], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    assert len(model.pairs) == 6
    got = sorted((str(r.doc_id), r.score) for r in quality.score(docs, model).collect())
    wanted = sorted((str(k), plain_score(model, t)) for k, t in rows)
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in wanted], abs=1e-12)


def test_quality_learns_from_no_held_out_label(spark):
    rows = [r for r in quality_rows() if r[0] is not None and r[0] < 300]
    docs = spark.createDataFrame(rows, "doc_id long, text string").dropDuplicates(["doc_id"])
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    models = [quality.learn(docs, spark.createDataFrame([(k, int(k % 3 != 0) ^ int(flip and held(k))) for k in range(300)], "doc_id long, quality int"))
              for flip in (False, True)]
    assert models[0].base == models[1].base and all((a == b).all() for a, b in zip(models[0].tables, models[1].tables))
    assert all((models[0].pairs[k] == models[1].pairs[k]).all() for k in models[0].pairs)


def test_interactions_are_learned():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature says anything
    model = quality.fit(x, y)
    assert (1, 0) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Yo\nyo"), (1, 3, "ann", None), (1, 2000, "ann", "late"), (2, None, None, "ä"),
            (2, 1, "cy", "b"), (2, 1, "cy", "b"), (3, 1, "system", "alone"), (None, 1, "dan", "x")]
    turns = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, speaker string, c int")
    got = dialogues.perspectives(turns).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (str(r.conv_id), r.speaker, r.position)):
        text = whole.get((r.conv_id, r.speaker), "")
        assert r.start_char == len(text) and r.end_char == len(text) + len(r.rendered)
        whole[r.conv_id, r.speaker] = text + r.rendered
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "unknown"), (2, "cy"), (None, "dan")}
    assert whole[1, "bob"] == ("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHi<|im_end|>\n<|im_start|>assistant\nYo\nyo<|im_end|>\n"
                               "<|im_start|>user name=ann\n<|im_end|>\n<|im_start|>user name=ann\nlate<|im_end|>\n")
    masked = [whole[r.conv_id, r.speaker][r.mask_start:r.mask_end] for r in got if r.mask_start is not None and r.speaker == "bob"]
    assert masked == ["Yo\nyo<|im_end|>"] and all((r.mask_start is None) == (r.role != "assistant") for r in got)
    assert dialogues.perspectives(turns.limit(0)).count() == 0


def test_licences(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "nothing"), (3, "a/b/COPYING", "licensed under the APACHE license, version 2.0"),
            (4, "a/b/c/y.txt", "code\nLicensed under CC BY-NC 4.0.\nmore"), (5, "a/b/c/z.txt", None), (6, "q/r.txt", ""), (7, None, "plain"),
            (8, "LICENSE", "no licence here at all"), (9, "a/b", "dir or file"), (2, "a/b/x.txt", "nothing")]
    files = spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, path string, text string, line string")
    got = sorted({(r.doc_id, r.own_licence, r.licence, r.licence_from) for r in licences.scan(files).collect()})
    assert got == [(1, "MIT", "MIT", "a/LICENSE"), (2, None, "Apache-2.0", "a/b/COPYING"), (3, "Apache-2.0", "Apache-2.0", "a/b/COPYING"),
                   (4, "CC-BY-NC-4.0", "CC-BY-NC-4.0", "a/b/c/y.txt"), (5, None, "Apache-2.0", "a/b/COPYING"), (6, None, None, None),
                   (7, None, None, None), (8, None, None, None), (9, None, "MIT", "a/LICENSE")]
    assert licences.scan(files).count() == len(rows)
    assert licences.scan(files.limit(0)).count() == 0


def test_licences_whole(spark):
    """Wrapped headers, whole licence files, titles, declared identifiers, ties, repeats and a very long text; plain code has none."""
    grant, rest = licences._MIT_GRANT, licences._MIT_REST
    wrap = lambda text, lead: "\n".join(lead + " ".join(text.split()[i:i + 9]) for i in range(0, len(text.split()), 9))
    mit = f"MIT License\n\nCopyright (c) 2024 Jane Doe\n\n{wrap(grant, '')}\n\n{wrap(rest, '')}\n"
    gpl = wrap(licences._GNU_NOTICE.format(kind="General", version=3), "# ")
    old = wrap(licences._GNU_NOTICE.format(kind="General", version=2), " * ")
    rows = [(1, "m/LICENSE", mit), (2, "m/src/a.py", "import os\n"), (3, "g/b.py", f"#!/usr/bin/env python\n#\n{gpl}\n#\nimport os\nx = 1\n"),
            (4, "g/c.c", f"/*\n{old}\n */\nint main;\n"), (5, "s/d.rs", "// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}\n"),
            (6, "p/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"),
            (7, "p/q/e.txt", "word " * 400_000 + "\nno header here\n" * 1000), (8, "z/f.c", gpl.replace("# ", "// ") + "\n\n" + "x = y;\n" * 50_000),
            (9, "z/g.txt", "The software is licensed to nobody in particular, and the license does not matter."), (10, None, old), (10, None, old)]
    got = {r.doc_id: (r.own_licence, r.licence, r.licence_from) for r in
           licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "MIT", "m/LICENSE"), 2: (None, "MIT", "m/LICENSE"), 3: ("GPL-3.0", "GPL-3.0", "g/b.py"), 4: ("GPL-2.0", "GPL-2.0", "g/c.c"),
        5: ("MIT OR Apache-2.0", "MIT OR Apache-2.0", "s/d.rs"), 6: ("GPL-3.0", "GPL-3.0", "p/COPYING"), 7: (None, "GPL-3.0", "p/COPYING"),
        8: ("GPL-3.0", "GPL-3.0", "z/f.c"), 9: (None, None, None), 10: ("GPL-2.0", "GPL-2.0", None)}
    tie = licences.scan(spark.createDataFrame([(1, "a", "one two three")], "doc_id long, path string, text string"),
                        templates={"B": ["one two three"], "A": ["three two one"]}).first()
    assert (tie.own_licence, tie.own_score) == ("A", 1.0)


def test_vectors_of_every_dimension_take_part(spark):
    """Three dimensions, the rarest with two vectors: links and neighbours against all pairs of one dimension."""
    rng = np.random.default_rng(5)
    base = {3: rng.normal(size=(6, 3)), 8: rng.normal(size=(9, 8)), 2: np.array([[1.0, 0.0]])}
    rows, key = [], 0
    for size, many in ((3, 40), (8, 60), (2, 2)):
        for i in range(many):
            v = base[size][i % len(base[size])] + (rng.normal(size=size) * 0.05 if size != 2 else np.array([0.0, 0.01 * i]))
            rows.append((key, v.tolist()))
            key += 1
    rows += [(200, None), (201, [0.0, 0.0]), (202, [1.0, float("nan")]), (203, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows[:key]}
    cosine = lambda a, b: float(unit[a] @ unit[b]) if len(unit[a]) == len(unit[b]) else None
    links = [(a, b) for a in unit for b in unit if a < b and cosine(a, b) is not None and cosine(a, b) >= 0.9]
    degree = Counter(x for p in links for x in p)
    component = groups([k for k, _ in rows], links)
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicate_vectors(table).collect()}
    assert got == {k: (degree[k], component[k]) for k, _ in rows}
    assert got[100] == (1, 100) and got[101] == (1, 100)
    near = {}
    for r in neighbours.nearest_neighbours(table, every=10, recall=1.0).collect():
        near.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in [k for k in unit if k % 10 == 0]:
        best = sorted((k for k in unit if k != q and cosine(q, k) is not None), key=lambda k: (-cosine(q, k), k))[:5]
        assert [v for _, v in sorted(near[q])] == best
    assert near[100] == [(1, 101)]
