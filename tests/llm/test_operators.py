"""The ten operators against brute-force versions, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import ipaddress  # noqa: F401
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from graphloom.llm import common, decontaminate, exchange, lm, packing, quality, simhash, substrings, topk, toxicity, urlrules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, grp string"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def corpus(n=120, seed=3):
    """Texts with copies, near copies, shared passages, nulls, empties, one word, odd white space, other scripts and a long one."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "日本", "a,b", "X!"]
    passage = " ".join(rng.choice(vocabulary, 40))
    rows = []
    for i in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 90))))
        if i % 7 == 3:
            words = words[:10] + passage.split() + words[10:]
        t = " ".join(words)
        if i % 10 == 5:
            t = rows[i // 2][1]
        if i % 10 == 6 and rows[i // 3][1]:
            w = rows[i // 3][1].split()
            t = " ".join(w[:-1] + ["changed"])
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "one"), (n + 4, "two words"), (n + 5, "a\u00a0b c\u2003d " * 20), (n + 6, " ".join(f"w{i % 50}" for i in range(5000))), (n + 7, "\x00 nul \x1c fs"), (n + 8, rows[0][1].upper())]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns have names that the operators use inside.
    return spark.createDataFrame([(i, t, "en", "x") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(common.group_count, "__defaults__", (3000,))


# -- shared helpers --


def test_word_spans_are_those_of_the_expression(rows):
    import pyarrow as pa

    ids, n = common.words_of(pa.chunked_array([pa.array([t for _, t in rows])]), lower=True)
    want = [WORD.findall(lower(t)) for _, t in rows]
    assert n.tolist() == [len(w) for w in want]
    by = {}
    for h, w in zip(ids.tolist(), [w for ws in want for w in ws], strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_exchange_round_trip(spark):
    rng = np.random.default_rng(0)
    buckets = [3, 1, 2]
    for kind in ("wide", "short"):
        parts = [np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) >> np.uint64(0 if kind == "wide" else 18)) for _ in range(3)]
        parts[1] = np.unique(np.concatenate((parts[1], parts[0][:200])))
        counts = [rng.integers(0, 700, len(p)) for p in parts]
        want = collections.Counter()
        batches = []
        for g, (p, c) in enumerate(zip(parts, counts, strict=True)):
            for k, x in zip(p.tolist(), c.tolist(), strict=True):
                want[k] += x
            batches += list(exchange.ask(g, kind, p, c, buckets))
        import pyarrow as pa

        got = exchange.answers(spark.createDataFrame(pa.Table.from_batches(batches).to_pandas(), exchange.ASK), 3).toArrow()
        for g, p in enumerate(parts):
            own = got.filter(pa.compute.equal(got["grp"], g))
            assert exchange.totals(own, kind, buckets).tolist() == [want[k] for k in p.tolist()]


def test_group_keys_fill_each_partition(spark):
    for n in (1, 5, 64):
        keys = common.group_keys(n)
        got = spark.createDataFrame([(k,) for k in keys], "k int").selectExpr("pmod(hash(k), %d) AS p" % n).collect()
        assert [r.p for r in got] == list(range(n))


def test_scratch_tables_are_deleted(spark):
    df = common.materialize(spark.range(5))
    files = df.inputFiles()
    common.discard(df)
    common.discard(spark.range(1))
    assert files and not any(__import__("os").path.exists(f.removeprefix("file://")) for f in files)


# -- 1 --


def brute_fingerprint(t, n=3):
    w = WORD.findall(lower(t))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, linked):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 2])
def test_simhash(docs, rows, block):
    fps = [brute_fingerprint(t) for _, t in rows]
    want = closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, block=block).withColumn("hex", simhash.hexed(simhash.F.col("fp"))).collect()}
    assert [got[i].hex for i in range(len(rows))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(rows))] == want


def test_simhash_chain_of_fingerprints(spark):
    """Fingerprints that differ from the next in three bits are one component, over any half."""
    fps = [0]
    for k in range(20):
        fps.append(fps[-1] ^ (0b111 << (3 * k)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "rep long, fp long")
    for block in (4096, 2):
        part = simhash.components(simhash.links(simhash.halves(df), block=block))
        assert {r.component for r in part.collect()} == {0} and part.count() == 21


def test_simhash_empty_and_repeated(spark, none):
    assert simhash.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (0, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(twice).collect()) == [(0, 0), (1, 1), (1, 1)]


def test_sketches_of_slices(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 20_000, n)) for n in rng.integers(0, 3000, 430)] + [None, "", "one two", "x " * 600_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    none, rank = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    common.powers(1 << 20)

    def sketched(b):
        tracemalloc.start()
        rows, most = [], []
        for part in simhash.slices([b]):
            tracemalloc.reset_peak()
            rows += simhash._sketch(part, 5, 0.8, none, rank).to_pylist()
            most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return rows, max(most)

    few = batch.slice(0, len(texts) - 1)
    assert max(sum(len(t or "") for t in s.column("text").to_pylist()) for s in simhash.slices([few])) <= simhash.SLICE_BYTES
    small, by_slices = sketched(few)
    assert len(list(simhash.slices([batch]))) == len(list(simhash.slices([few]))) + 1
    monkeypatch.setattr(simhash, "SLICE_BYTES", 1 << 40)
    whole, at_once = sketched(few)
    assert small == whole and by_slices < 30e6 < at_once


def test_similar_groups(docs, rows, none):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = closure(len(rows), links)
    got = {r.doc_id: r.group_id for r in simhash.similar_groups(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert simhash.similar_groups(none).count() == 0


def test_similar_groups_finds_appended_cut_and_replaced_copies(spark):
    """Pairs just over the threshold, which word-set SimHashes mostly miss."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("bcdfghklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(5))
    data, sets = [], []
    for i in range(90):
        n = (60, 200, 600)[i % 3]
        a, goal = [word() for _ in range(n)], (0.79, 0.8, 0.82, 0.85, 0.88)[i % 5]
        k = math.ceil((n - 4) / goal) - (n - 4)
        b = a + [word() for _ in range(k)] if i % 2 else a[: math.ceil((n - 4) * goal) + 4] if i % 4 else a[: n // 2] + [word() for _ in range(n // 20)] + a[n // 2 + n // 20 :]
        for w in (a, b):
            data.append((len(data), " ".join(w)))
            sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    want = [i - 1 if i % 2 and len(sets[i] & sets[i - 1]) >= 0.8 * len(sets[i] | sets[i - 1]) else i for i in range(len(data))]
    assert 90 < sum(w == i for i, w in enumerate(want)) < 130
    got = {r.doc_id: r.group_id for r in simhash.similar_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(data))] == want


# -- 2 --


def test_grammar_reads_clauses_not_words():
    m = toxicity.Model({"idiot": 4.0, "moron": 4.0})
    plain, aimed, negated, told = (sum(m.clauses(t)) for t in ("the idiot came", "you idiot", "you are not an idiot", "he said idiot"))
    assert aimed > plain > negated > 0 and plain > told > 0
    assert sum(m.clauses("i will kill you")) > sum(m.clauses("to kill time")) > 0
    assert m.clauses("not here. an idiot") == m.clauses("an idiot")
    assert m.clauses("nothing to see") == [] and m.clauses(None) == [] and m.clauses("") == []
    assert m.clauses("kidiotic") == []


def test_grammar_like_brute_force():
    """The composed transducers against one pass with plain variables, over random clauses."""
    rng = np.random.default_rng(13)
    t = toxicity
    for _ in range(400):
        tagged = [(int(rng.integers(6)), float(rng.integers(1, 5))) for _ in range(int(rng.integers(1, 12)))]
        insults = threats = 0.0
        under = many = 0
        told = aim = 0  # aim: 1 a target came first, 2 an insult or threat did, 3 a target after it
        idle = 0  # 1 after a threat, 2 once a target followed
        for tag, w in tagged:
            f = 0.35 if under and tag in (t.INSULT, t.THREAT) else 1.0
            f *= 0.5 if told and tag in (t.INSULT, t.THREAT) else 1.0
            if tag == t.INSULT:
                f *= (1.0, 0.8, 0.64)[many] * (1.3 if aim == 1 else 1.0)
                many = min(2, many + 1)
                insults += w * f
            if tag == t.THREAT:
                f *= {0: 0.2, 1: 1.0, 2: 1.5}[idle]
                idle = idle or 1
                threats += w * f
            under = 3 if tag == t.NEGATION else max(0, under - 1)
            told = told or tag == t.REPORT
            if tag == t.TARGET:
                aim = {0: 1, 2: 3}.get(aim, aim)
                idle = 2 if idle == 1 else idle
            elif aim == 0 and tag in (t.INSULT, t.THREAT):
                aim = 2
        after = 1.2 if aim == 3 else 1.0
        want = insults * after + threats * after * (7.5 if idle == 2 else 1.0)
        assert t.Grammar().score(tagged) == pytest.approx(want), tagged


def test_toxicity_fit_is_one_for_equal_texts(spark):
    """Equal texts with other labels: the smallest doc_id counts, in whatever order rows come."""
    data = [(i, f"text {i % 40} zorgal" if i % 2 else f"text {i % 40}") for i in range(400)]
    labels = [(i, int(i % 2 == 1) if i < 40 else 1) for i in range(400)]
    fits = []
    for k in (1, 5):
        m = toxicity.fit(spark.createDataFrame(data, "doc_id long, text string").repartition(k), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(k))
        fits.append((m.stems, tuple(round(w, 9) for w in m.weights)))
    assert fits[0] == fits[1]


def test_stems_are_chosen_long():
    assert toxicity.chosen_stems([("idi", 3.0, 100), ("idio", 3.0, 99), ("idiot", 3.0, 98), ("mor", 2.5, 50)]) == {"mor": 2.5, "idiot": 3.0}


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(1)
    data, labels = [], []
    for i in range(800):
        bad = i % 4 == 0
        words = [f"n{rng.integers(500)}" for _ in range(60)]
        if bad:
            for p in rng.integers(0, 60, 3):
                words[p] = f"zorgal{rng.integers(20)}"
        data.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(800) if i % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    assert toxicity.fit(docs, lab.where("false")).stems


def test_toxicity_keeps_given_and_rare_stems(spark):
    """Given stems hold when others are learned; many or rare learned stems all stay."""
    assert len(toxicity.chosen_stems([(f"s{i:03d}", 3.0, 9) for i in range(700)])) == 700
    rng = np.random.default_rng(4)
    plain = lambda: " ".join(f"n{chr(97 + x // 26)}{chr(97 + x % 26)}o" for x in rng.integers(0, 600, 40))
    data = [(i, plain() + (" zorgal you" if i % 2 else "") + (" quibbex you" if i % 2 and i < 80 else "")) for i in range(4400)]
    labels = [(i, i % 2) for i in range(4400)]
    model = toxicity.fit(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    bias = model.score("")
    assert model.stem("zorgal") and all(model.score(f"you {w}") > bias for w in (*toxicity.GIVEN, "zorgal", "quibbex"))
    assert toxicity.with_given({"idiot": 3.0, "scum": 3.0}, {"idi": 5.0}) == {"idi": 5.0, "scum": 3.0}


def test_toxicity_null_and_empty(spark, none):
    m = toxicity.Model({"idiot": 4.0})
    got = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "idiot " * 50000)], "doc_id long, text string"), m).collect()
    assert len(got) == 4 and got[0].score == got[1].score == got[2].score < 0.5
    assert toxicity.score(none, m).count() == 0


# -- 3 --


def test_lm(docs, rows, none, small_groups):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    from graphloom.llm.queries import held_out

    got = {r.doc_id: r for r in lm.score(docs, held_out(10, 0)).collect()}
    tokens = {i: WORD.findall(lower(t)) + ["</s>"] for i, t in rows}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score(none, held_out(10, 0)).count() == 0


def test_lm_scores_like_brute_force(docs, rows, small_groups, monkeypatch):
    """Scores are the interpolation with the learned weights; what EM reads is each training token once; rounding costs it little."""
    from graphloom.llm.queries import held_out

    seen = []
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda hist, n, v: seen.append((hist, learn(hist, n, v))) or seen[-1][1])
    got = {r.doc_id: r.score for r in lm.score(docs, held_out(10, 0)).collect()}
    hist, weights = seen[0]
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10}
    tokens = {i: WORD.findall(lower(t)) + ["</s>"] for i, t in rows}
    word, pair = collections.Counter(), collections.Counter()
    for i in train:
        word.update(tokens[i])
        pair.update(zip(["<s>"] + tokens[i], tokens[i], strict=False))
    total, kinds, before = sum(word.values()), len(word), collections.Counter(word)
    before["<s>"] = len(train)
    bucket = lambda c: c.bit_length()
    parts = lambda u, w, less: (bucket(before[u] - less), (pair[u, w] - less) / max(before[u] - less, 1), (word[w] - less) / (total - less), 1 / (kinds + 1))
    for i, ws in tokens.items():
        want = 0.0
        for u, w in zip(["<s>"] + ws, ws, strict=False):
            b, *p = parts(u, w, 0)
            want += math.log10(sum(x * y for x, y in zip(weights[b], p, strict=True)))
        assert got[i] == pytest.approx(want, rel=1e-9)
    held = [parts(u, w, 1) for i in train for u, w in zip(["<s>"] + tokens[i], tokens[i], strict=False)]
    assert hist[:, 3].sum() == len(held) == total
    assert collections.Counter(b for b, *_ in held) == {b: hist[hist[:, 0] == b, 3].sum() for b in set(hist[:, 0].tolist())}
    exact = np.tile((0.3, 0.6, 0.1), (lm.BUCKETS, 1))
    exact[0] = (0.0, 0.9, 0.1)
    b, p = np.array([x[0] for x in held]), np.array([x[1:] for x in held])
    for _ in range(60):
        share = exact[b] * p
        share /= share.sum(axis=1, keepdims=True)
        for k in set(b.tolist()):
            new = share[b == k].sum(axis=0) + 1e-3
            new[0] *= k > 0
            exact[k] = new / new.sum()
    quality = lambda w: np.log10((w[b] * p).sum(axis=1)).mean()
    assert abs(quality(exact) - quality(weights)) < 0.005


def test_lm_is_a_distribution():
    """The mixture sums to one over the vocabulary and one unknown word, whatever the weights."""
    weights = lm.learn_weights(np.array([[3, -4, 10, 50], [3, -255, 4, 20], [0, -255, -255, 5]]), 1000, 99)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and weights[0, 0] == 0


# -- 4 --

PAGES = [(1, "http://a", "<p>" + "x" * 200), (2, "http://b", "<p>" + "x" * 200), (3, None, None), (4, "http://c\r\nX: y", "WARC/1.1\r\n\r\n\r\n"), (5, "u", "ü" * 99), (6, "u", "short"), (7, "u", "short"), (0, "z", "<p>" + "x" * 200), (8, "u", "q" * 3_000_000)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, size int")
    first = {}
    for i, _, h in sorted(PAGES):
        b = (h or "").encode()
        if len(b) >= 100:
            first.setdefault(b, i)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        f = first.get(b, i)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if f == i else "revisit", None if f == i else f))
    assert sorted(map(tuple, warc.round_trip(df).collect())) == sorted(want)
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_long_urls(spark):
    """Headers have no greatest length; a url that ends like a version line ends no header."""
    urls = ["http://a/" + "x" * 70_000, "http://b/" + "ü" * 3_000_000, "http://c/WARC/1.1", "u"]
    df = spark.createDataFrame([(i, u, f"<p>{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = warc.read(spark, warc.write(df)).collect()
    assert sorted((r.kind, r.record_id, r.url) for r in got) == [("record", f"urn:page:{i}", u) for i, u in enumerate(urls)]
    broken = record(0, "x")[:-50].partition(b"\r\n\r\n")[0] + b"\r\n" + record(1, "y")
    assert [x[0] for x in warc.salvage(broken)] == ["gap", "record"]


def test_warc_repeated_pages(spark):
    """Of rows with one page_id and payload, one is the response; null page_ids come last."""
    a, b, c = "<p>" + "x" * 200, "<p>" + "y" * 200, "<p>" + "z" * 200
    rows = [(1, "u", a), (1, "u", a), (1, "v", a), (2, "u", a), (3, "w", b), (3, "w", c), (None, "n", b), (None, "n", c), (None, None, None), (None, "q", "<p>" + "q" * 300), (None, "q", "<p>" + "q" * 300), (5, "s", "s"), (5, "s", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == {(1, 203, "response", None): 1, (1, 203, "revisit", 1): 2, (2, 203, "revisit", 1): 1, (3, 203, "response", None): 2, (None, 203, "revisit", 3): 2, (None, 0, "response", None): 1, (None, 303, "response", None): 1, (None, 303, "revisit", None): 1, (5, 1, "response", None): 2}


def test_warc_archives_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 60_000)
    monkeypatch.setattr(warc, "CLASSES", (2_000, 20_000, 1 << 40))
    df = spark.createDataFrame([(i, "u", "x" * (100 if i % 10 else 15_000) + str(i)) for i in range(300)] + [(300, "u", "y" * 200_000)], "page_id long, url string, html string")
    path = f"{tmp_path}/w"
    warc.write(df, path)
    sizes = [p.stat().st_size for p in __import__("pathlib").Path(path).glob("part-*")]
    assert len(sizes) > 8 and [x for x in sizes if x > 60_000] == [max(sizes)]
    assert warc.read(spark, path).where("kind = 'record'").count() == 301


def test_warc_gaps_are_logged(spark, tmp_path):
    """A damaged archive in a folder of sound ones: later records come back, lost bytes are in the log."""
    whole = [record(i, f"payload {i} " * 30) for i in range(6)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(whole[:3]) + b"torn" + whole[3][40:] + whole[4])
    (tmp_path / "w" / "b.warc").write_bytes(whole[5])
    got = warc.read(spark, str(tmp_path / "w"))
    assert sorted(r.record_id for r in got.where("kind = 'record'").collect()) == [f"urn:x:{i}" for i in (0, 1, 2, 4, 5)]
    start = len(b"".join(whole[:3]))
    assert [(r.file[-6:], r["at"], r.until) for r in warc.gaps(got).collect()] == [("a.warc", start, start + 4 + len(whole[3]) - 40)]


def test_salvage_members_in_linear_time():
    import time

    member = warc.gzip_member(record(0, "payload " * 150))
    took = []
    for n in (1000, 8000):
        start = time.time()
        assert sum(x[0] == "record" for x in warc.salvage(member * n)) == n
        took.append(time.time() - start)
    assert took[1] < 24 * took[0]


def record(i, payload):
    body = payload.encode()
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    whole = [record(i, f"payload {i} " * 30) for i in range(6)]
    parts = [warc.gzip_member(r) for r in whole] if packed else whole
    sound = list(warc.salvage(b"".join(parts)))
    assert [x[2]["warc-record-id"] for x in sound] == [f"<urn:x:{i}>" for i in range(6)]
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 0x5A
    data = b"".join(parts[:2]) + bytes(hurt) + b"noise" + b"".join(parts[3:5]) + parts[5][:-9]
    got = list(warc.salvage(data))
    assert [x[2]["warc-record-id"] for x in got if x[0] == "record"] == [f"<urn:x:{i}>" for i in (0, 1, 3, 4)]
    gaps = [(x[1], x[2]) for x in got if x[0] == "gap"]
    start = len(b"".join(parts[:2]))
    assert gaps == [(start, start + len(hurt) + 5), (len(data) - len(parts[5]) + 9, len(data))]
    assert all(x[3] for x in got if x[0] == "gap")


def test_salvage_covers_every_byte():
    rng = np.random.default_rng(2)
    base = b"".join(record(i, "z" * int(rng.integers(0, 300))) for i in range(8))
    for _ in range(40):
        data = bytearray(base)
        for p in rng.integers(0, len(data), 3):
            data[p] = int(rng.integers(256))
        last = 0
        for x in warc.salvage(bytes(data)):
            assert x[1] == last
            last = x[2] if x[0] == "gap" else warc._parse(bytes(data), x[1])[2] + 4
        assert last == len(data)


# -- 5 --


def test_quality(spark, none):
    rng = np.random.default_rng(4)
    data, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = [f"w{rng.integers(400)}" for _ in range(50)]
        data.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good)))
    data += [(1000, None), (1001, ""), (1001, ""), (1002, "long " * 100000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score(docs, lab.where("doc_id % 4 <> 1")).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    y = dict(labels)
    assert np.mean([r.predicted == y[r.doc_id] for r in got if r.doc_id % 4 == 1 and r.doc_id in y]) > 0.97
    assert quality.score(none, lab).count() == 0
    assert {r.score for r in quality.score(docs, lab.where("quality = 1")).collect()} == {1.0}


def test_context_vectors_are_sums_of_neighbours(spark):
    import pyarrow as pa

    texts = ["a b c d", "c b a", "x x x"]
    place, sign = quality.index_vectors()
    want = np.zeros((quality.ROWS, quality.DIMS + 1), np.int64)
    for t in texts:
        row, _ = quality.units(*next(common.text_buffers(pa.array([t]))))
        for i, r in enumerate(row):
            want[r, quality.DIMS] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(row):
                    np.add.at(want[r], place[row[j]], sign[row[j]])
    got = np.zeros_like(want)
    for b in quality._context_sums([pa.RecordBatch.from_pydict({"text": texts})]):
        k = b.column("block")[0].as_py() * quality.BLOCK
        got[k : k + quality.BLOCK] = np.frombuffer(b.column("sums")[0].as_py(), "<i8").reshape(-1, quality.DIMS + 1)
    assert (got == want).all()


def test_quality_scores_like_brute_force(spark, monkeypatch):
    """Each score is the network's probability of the mean of the text's unit vectors and its length."""
    import pyarrow as pa

    rng = np.random.default_rng(14)
    data = [(i, " ".join(f"{'ab'[i % 2]}{rng.integers(60)}" for _ in range(int(rng.integers(0, 40))))) for i in range(120)] + [(120, None)]
    seen = {}
    monkeypatch.setattr(quality, "word_vectors", lambda docs, f=quality.word_vectors: seen.setdefault("vectors", f(docs)))
    monkeypatch.setattr(quality, "fit", lambda *a, f=quality.fit: seen.setdefault("net", f(*a)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 120, 3)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(data, "doc_id long, text string"), labels).collect()}
    (w1, b1, w2, b2), net = seen["net"].p, seen["net"]
    for i, t in data:
        row, n = quality.units(*next(common.text_buffers(pa.array([t or ""]))))
        x = np.append(np.mean([seen["vectors"][r] for r in row], axis=0) if len(row) else np.zeros(quality.DIMS), math.log1p(len(row)) / 10)
        z = sum(math.tanh(sum((x[d] - net.mean[d]) / net.scale[d] * w1[d, h] for d in range(len(x))) + b1[h]) * w2[h] for h in range(len(w2))) + b2[0]
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z / net.temperature)), abs=1e-4) and got[i].predicted == int(got[i].score >= 0.5)


# -- 6 --

ITEMS = [(1, "A train leaves the station at 60 km per hour and meets Alice after 3 hours of travel on the long northern line"), (2, "short item of six words only"), (3, None), (4, "12 34 56"), (5, "he gave 5 apples to the old man and then 5 apples to the young man in the park")]
LEAKS = [
    (1, "Before. A train leaves the station at 60 km per hour and meets Alice after 3 hours of travel on the long northern line, after.", [1]),
    (2, "So a train leaves the station at 85 km per hour and meets Bob after 12 hours of travel on the long northern line", [1]),
    (3, "This is a short item of six words only!", [2]),
    (4, "he gave 7 apples to the old man and then 7 apples to the young man in the park", [5]),
    (5, "he gave 7 apples to the old man and then 8 apples to the young man in the park", []),
    (6, None, []), (7, "", []), (8, "nothing of the kind stands here at all and nobody minds it", []), (9, "78 90 12 34 56 78", []), (10, "word " * 30000, []),
]


def test_decontaminate(spark, none):
    bench = spark.createDataFrame([(*i, 7) for i in ITEMS], "item_id long, text string, doc_id int").select("item_id", "text")
    docs = spark.createDataFrame([(i, t, "q") for i, t, _ in LEAKS], "doc_id long, text string, item string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert {i: got[i]["items"] for i, _, _ in LEAKS} == {i: x for i, _, x in LEAKS}
    assert all(r.contaminated == bool(r["items"]) for r in got.values())
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


def leaks(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.decontaminate(docs, bench).collect()}
    return [got[i] for i in range(len(texts))]


def test_decontaminate_numbers_verbatim(spark):
    """Items of mostly numbers: verbatim copies are found, other numbers alone are not enough."""
    items = ["What is 12 + 7 * 3 - 5 / 2 ?", "Compute 12 + 7 * 3 - 5 / 2 and give 4 digits", "The sequence is 2, 4, 8, 16, 32, 64. What comes next?", "Find the mean of 3, 7, 9, 12, 15 and 20."]
    texts = [f"Some words stand before. {t} Some words stand after." for t in items] + ["Some 99 + 98 * 97 - 96 / 95 and no more", "nothing here"]
    assert leaks(spark, items, texts) == [[0], [1], [2], [3], [], []]


def test_decontaminate_other_names_and_case(spark):
    items = ["On the way home Alice gave Tom half of the apples that she had bought at the small market near the bridge over the river", "Alice has 5 apples. Tom gives her 7 more apples. How many apples does Alice have in all now?"]
    texts = [
        items[0].replace("Alice", "Bob").replace("Tom", "Ann"), items[0].replace("Alice", "Mary Jane").replace("Tom", "Uncle Sam"), items[0].lower(), items[0].upper(),
        items[1].replace("Alice", "Maria").replace("Tom", "Peter"), items[1].replace("Alice", "Maria Luz").replace("Tom", "Peter").replace("5", "11"),
        items[0].replace("Alice", "Bob").replace("she had", "just yesterday she had"),
    ]
    assert leaks(spark, items, texts) == [[0], [0], [0], [0], [1], [1], [0]]


def test_decontaminate_edit_between_windows(spark):
    """An edited stretch with a name that occurs elsewhere does not clear the windows around it."""
    first, middle, last = "early that day Anna took the old road along the river to the far mill and rested", "then Anna slept beside the wall", "because rain had come over the hills and nobody would cross the wide ford before dawn with 3 carts"
    item = f"{first} {middle} {last}"
    doc = f"{first} then Boris slept beside his wall {last}".replace("3 carts", "4 carts").replace("took the old road", "took some old road")
    other = item.replace("3 carts", "4 carts").replace("then Anna", "then Boris")
    assert leaks(spark, [item], [item, doc, other]) == [[0], [0], [0]]


def test_decontaminate_like_brute_force(spark, rows):
    """Plain passages: an item leaks if enough of its windows stand in a row in a text."""
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"k{x}" for x in rng.integers(0, 10**6, 20)).replace("k", "kay")) for i in range(6)]
    items = [(i, re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t)) for i, t in items]
    docs = [(100 + k, f"{rows[k][1] or ''} {' '.join(items[k % 6][1].split()[: 8 + k])} end") for k in range(12)]
    got = {r.doc_id: r["items"] for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k in range(12):
        windows = min(8 + k, 20) - 7
        assert got[100 + k] == ([k % 6] if windows >= min(6, math.ceil(0.6 * 13)) else [])


def brute_decontaminate(texts, items):
    """The rules once more, text by text: words and placeholders by small state machines over tokens, alignments by loops."""
    import regex

    starters, units = set(decontaminate.STARTERS.split("|")), set(decontaminate.UNITS.split("|"))

    def template(t):
        out, values = [], []
        tokens = regex.findall(r"\d+(?:[.,:/]\d+)*|\p{L}+|[^\p{L}\d]+", t)
        k = 0
        while k < len(tokens):
            x = tokens[k]
            before = tokens[k - 1] if k else ""
            capital = lambda y: bool(regex.fullmatch(r"\p{Lu}\p{L}*\p{Ll}\p{L}*", y)) and y.lower() not in starters
            if regex.match(r"\d", x):
                out.append("<n>")
                values.append(x)
                if k + 2 < len(tokens) and tokens[k + 1].strip(" ") == "" and tokens[k + 2].lower() in units and not (k + 3 < len(tokens) and regex.match(r"\d", tokens[k + 3])):
                    out.append("<u>")
                    values.append(tokens[k + 2].lower())
                    k += 2
            elif capital(x) and (k == 0 or before.endswith((" ", "\n")) and (len(before) > 1 and before[-2] in ",.!?;:" or before == " " and regex.fullmatch(r"[\p{Ll}\d]", tokens[k - 2][-1]) or before.endswith("\n"))):
                name = [x.lower()]
                while k + 2 < len(tokens) and tokens[k + 1].strip(" ") == "" and capital(tokens[k + 2]):
                    k += 2
                    name.append(tokens[k].lower())
                out.append("<p>")
                values.append(" ".join(name))
            elif regex.match(r"\p{L}", x):
                out.append(x.lower())
                values.append(x.lower())
            k += 1
        return out, values

    plain = lambda t: regex.findall(r"[\p{L}\p{N}]+", t.lower())
    answers = []
    for t in texts:
        hit = []
        for k, item in enumerate(items):
            words = template(item)[0]
            if all(w[0] == "<" for w in words):
                continue
            whole = len(plain(item)) < 5
            for exact in (True, False):
                a, b = (plain(item), plain(t)) if exact else (words, template(t)[0])
                n = min(8, len(a))
                if whole:
                    if exact and a == b:
                        hit.append(k)
                    continue
                kept = [i for i in range(len(a) - n + 1) if exact or 2 * sum(w[0] != "<" for w in a[i : i + n]) >= n]
                need = min(6, math.ceil(0.6 * len(kept)))
                pairs = [(j - i, i) for i in kept for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]]
                for low in {8 * ((s + off) // 8) - off for s, _ in pairs for off in (0, 4)}:
                    line = [(s, i) for s, i in pairs if low <= s < low + 8]
                    if len({i for _, i in line}) < max(need, 1):
                        continue
                    if not exact:
                        ats = collections.defaultdict(set)
                        for s, i in line:
                            ats[s].add(i)
                        order = sorted(ats, key=lambda s: (-len(ats[s]), -s))
                        placed = []
                        for i, w in enumerate(a):
                            if w[0] == "<":
                                s = next((s for s in order if any(x <= i < x + n for x in ats[s])), None)
                                if s is not None:
                                    placed.append((template(item)[1][i], template(t)[1][i + s]))
                        if len(set(placed)) != len({x for x, _ in placed}) and 2 * sum(x == y for x, y in placed) <= len(placed):
                            continue
                    hit.append(k)
        answers.append(sorted(set(hit)))
    return answers


def test_decontaminate_like_brute_force_over_templates(spark):
    """Generated questions with numbers, units and names, asked again with other values, cut, shifted, in other case, or inconsistently."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("bdfgklmnprstv")) + rng.choice(list("aeiou")) for _ in range(int(rng.integers(2, 4))))
    names, units = ["Alice", "Tom", "Maria", "Uncle Sam", "Bob", "Anna"], ["km", "hours", "kg", "apples"]

    def fill(shape, same=True):
        number = {i: int(rng.integers(2, 99)) for i in range(3)}
        who = {i: names[int(x)] for i, x in enumerate(rng.permutation(6)[:3])}
        out = []
        for kind, v in shape:
            if kind == "n":
                out.append(f"{number[v] if same else int(rng.integers(100, 999))} {units[v]}")
            elif kind == "p":
                out.append(who[v] if same else names[int(rng.integers(6))])
            else:
                out.append(v)
        return " ".join(out)

    shapes = []
    for _ in range(24):
        shape = [("w", word()) for _ in range(int(rng.integers(4, 26)))]
        for p in sorted(rng.integers(1, len(shape), len(shape) // 5).tolist(), reverse=True):
            shape.insert(p, (("n", "p")[int(rng.integers(2))], int(rng.integers(3))))
        shapes.append(shape)
    items = [fill(s) for s in shapes] + ["yes", "one two", "Solve 3 now", "7 8 9 10 11 12", ""]
    texts = []
    for s, item in zip(shapes, items, strict=False):
        pad = " ".join(word() for _ in range(6))
        for t in (item, fill(s), fill(s, False), item.lower(), " ".join(item.split()[: len(item.split()) // 2]), item.replace(" ", "  ", 2)):
            texts.append(f"{pad} {t} and {pad}.")
    texts += ["well yes indeed", "Yes!", "one two", "one two three", "solve 3 now", "solve 4 now", "", "7 8 9 10 11 12"]
    want = brute_decontaminate(texts, items)
    assert leaks(spark, items, texts) == want
    assert sum(map(bool, want)) > 60 and sum(not w for w in want) > 20


def test_decontaminate_rows_and_twins(spark):
    """Rows of one doc_id are judged by their texts, null doc_ids too; items with the same words are all named."""
    item = "the old mill stood by the river for years before the flood carried its wheel to the sea"
    bench = spark.createDataFrame([(1, item), (2, item), (3, "yes")], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (1, "well yes indeed"), (None, f"so {item}"), (None, "clean"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r["items"]) for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == [(0, []), (0, [1, 2]), (1, []), (1, [1, 2]), (2, [])]


def test_decontaminate_common_windows(spark):
    """What many items share names none of them; what is their own does."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("bdfgklmnprstv")) + rng.choice(list("aeiou")) for _ in range(3))
    head = "choose the right answer from the four options that are given below this line of text"
    items = [f"{head} {' '.join(word() for _ in range(12))}" for _ in range(30)]
    assert leaks(spark, items, [f"{head} and nothing else at all", f"so {items[7]}", items[7][len(head) :]]) == [[], [7], [7]]


def test_decontaminate_plan_is_native(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t, _ in LEAKS], "doc_id long, text string")
    plan = decontaminate.matches(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- 7 --


def brute_repeats(rows, window=13):
    texts = sorted((i, WORD.findall(t or "")) for i, t in rows)
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("heavy", [64, 1])
def test_substrings(docs, rows, small_groups, heavy):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, heavy=heavy, texts=False).collect()}
    assert got == brute_repeats(rows)


def test_deep_nodes_are_those_of_the_suffix_tree():
    """Suffixes below one internal node of the depth, in the order of their words; against a dictionary."""
    rng = np.random.default_rng(12)
    for kinds, depth in ((3, 4), (3, 13), (40, 2), (70_000, 3)):
        ids = rng.integers(0, kinds, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ids[2000:2400] = ids[100:500]
        start = np.sort(rng.choice(3000 - depth, 1500, replace=False))
        by = collections.defaultdict(list)
        for k, s in enumerate(start.tolist()):
            by[tuple(ids[s : s + depth].tolist())].append(k)
        live, node = substrings.deep_nodes(ids, start, depth)
        assert (np.diff(node) >= 0).all()
        got = collections.defaultdict(list)
        for k, x in zip(live.tolist(), node.tolist(), strict=True):
            got[x].append(k)
        want = [sorted(by[k]) for k in sorted(by) if len(by[k]) > 1]
        assert [sorted(x) for x in got.values()] == want
    assert len(substrings.deep_nodes(np.zeros(0, np.uint64), np.zeros(0, np.int64), 13)[0]) == 0


def test_substrings_repeats_inside_a_document(spark, small_groups):
    p = " ".join(f"w{i}" for i in range(15))
    data = [(1, p), (2, f"{p} x {p} y {p}"), (3, "of " * 400), (4, "of " * 300), (4, "of " * 20), (5, p), (6, None)]
    got = sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == [(1, 0), (2, 45), (3, 0), (4, 20), (4, 300), (5, 15), (6, 0)]


def test_substrings_keeps_columns(spark, none):
    assert substrings.remove_repeats(none).count() == 0
    df = spark.createDataFrame([(1, "a  b\n c", "en", 5)], "doc_id long, text string, lang string, n_chars long")
    r = substrings.remove_repeats(df, keep=("lang", "n_chars"), original=True).first()
    assert (r.lang, r.n_chars, r.kept_text) == ("en", 5, "a  b\n c")


def test_null_numbers(spark):
    p = " ".join(f"w{i}" for i in range(15))
    df = spark.createDataFrame([(None, p), (5, p), (None, p), (None, "z"), (7, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substrings.remove_repeats(df).collect()) == [(-1, 0), (-1, 15), (-1, 15), (5, 0), (7, 0)]
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect()) == [(-1, -1), (-1, 5), (-1, 5), (5, 5), (7, 7)]
    assert simhash.similar_groups(df).count() == 5
    assert lm.score(df, simhash.F.col("doc_id") == 5).count() == 5
    bench = spark.createDataFrame([(1, p)], "item_id long, text string")
    assert sorted((r.doc_id or -1, r.contaminated) for r in decontaminate.decontaminate(df, bench).collect() if r.doc_id) == [(5, True), (7, False)]


# -- 8 --


def test_top_k(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-900, 900, (700, 12))
    x[10] = x[20]
    x[300:320] = x[0]
    rows = [(i, [int(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9001, []), (9002, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("rank", topk.F.lit(0))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, topk.F.col("vec_id") % 100 == 0, vector_block=200, query_block=3).collect()}
    want = {}
    for q in range(0, 700, 100):
        s = sorted((-int(x[q] @ x[i]), i) for i in range(700) if i != q)[:10]
        want.update({(q, k + 1): (i, -v) for k, (v, i) in enumerate(s)})
    assert got == want
    assert topk.top_k(df.where("false"), topk.F.lit(True)).count() == 0
    twice = spark_of(df).createDataFrame([(0, [1, 2]), (0, [3, 1]), (1, [1, 1]), (1, [1, 1])], "vec_id long, vector array<long>")
    assert [tuple(r) for r in topk.top_k(twice, topk.F.col("vec_id") == 0).collect()] == [(0, 1, 1, 3), (0, 2, 1, 3)]


def test_top_k_few_candidates_and_bad_values(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.25, -0.1]), (2, [float("nan"), 1.0]), (3, [float("inf"), 0.0]), (4, [None, 1.0]), (5, None)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in topk.top_k(v, topk.F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 1024 * 256 + 512 * -103)]


def test_search_stops_only_on_proof():
    """Whatever the data, the block's search agrees with a full scan."""
    rng = np.random.default_rng(6)
    for scale in (3, 1000):
        x = (rng.normal(size=(900, 10)) ** 3 * scale).astype(np.int64)
        b = topk.Block(x)
        for q in range(12):
            rows, scores = b.search(x[q], 5, np.array([q]))
            full = x @ x[q]
            full[q] = -(1 << 60)
            least = np.sort(full)[-5]
            assert sorted(rows.tolist()) == np.flatnonzero(full >= least).tolist() and sorted(scores) == sorted(full[full >= least])


# -- 9 --


def brute_rule(url, rules=urlrules.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest)[0]) if rest else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = ["http://a.example.com/en/7x", "https://EXAMPLE.com/en/6", "http://com/en/", "x://telecom/en/", "http://b.net/de/8", "http://q.example.net/de/89?x", "http://q.example.net/de/", "http://x.org", "http://x.org/es/#y", "http://x.org/es", None, "", "no scheme", "http://", "http://a.com?en/", "http://a.com/EN/", "http://a.b.c.d.com/en/é", "a://b://c.com/en/"]


def test_url_rules(spark):
    rows = [(i, u, 1) for i, u in enumerate(URLS)] + [(0, URLS[0], 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, level int")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrules.match(df, salts=4).collect())
    assert got == sorted((i, *brute_rule(u)) for i, u, _ in rows)
    assert urlrules.match(df.where("false")).count() == 0


def test_nested_rules(spark):
    rules = [("block", "com", "/"), ("allow", "com", "/a"), ("block", "com", "/ab/"), ("allow", "com", "/ab/c"), ("block", "x.com", "/a"), ("allow", "com", "/b"), ("block", "y.x.com", "")]
    urls = [f"http://{h}{p}" for h in ("com", "x.com", "y.x.com", "z.com", "net") for p in ("", "/", "/a", "/ab", "/ab/", "/ab/cd", "/b", "/c", "/ab0")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.match(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, salts=3).collect()}
    assert [got[i] for i in range(len(urls))] == [brute_rule(u, rules) for u in urls]


def test_url_rules_plan_is_native(spark):
    plan = urlrules.match(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), salts=2)._jdf.queryExecution().toString()
    assert not re.search("MapInArrow|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)


# -- 10 --


def brute_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if size - bins[b] >= n]
        if fits:
            b = min(fits, key=lambda b: size - bins[b])
            bins[b] += n
        else:
            bins.append(n)
    return sorted(bins)


def test_best_fit_is_one_by_one():
    rng = np.random.default_rng(7)
    for size in (10, 33, 100):
        for n in (1, 50, 400):
            lengths = rng.integers(1, size + 1, n).tolist()
            moves, bins = packing.best_fit(dict(collections.Counter(lengths)), size)
            fill = [0] * bins
            for length, _, first, each, offset in moves:
                pass
            want = brute_best_fit(lengths, size)
            assert bins == len(want)
            total = collections.Counter(lengths)
            spans = collections.defaultdict(list)
            ordered = sorted(moves)
            for k, (length, rank, first, each, offset) in enumerate(ordered):
                until = ordered[k + 1][1] if k + 1 < len(ordered) and ordered[k + 1][0] == length else total[length]
                for r in range(until - rank):
                    spans[first + r // each].append((offset + r % each * length, length))
            for b in range(bins):
                at = 0
                for s, length in sorted(spans[b]):
                    assert s == at
                    at += length
                assert at <= size
                fill[b] = at
            assert sorted(fill) == want


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, size=64).collect()
    by = collections.defaultdict(dict)
    seqs = collections.defaultdict(list)
    for r in got:
        by[r.doc_id][r.piece] = r
        seqs[r.sequence_id].append((r.offset, r.length))
    lengths = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = packing.cut(len(ids), 64)
        assert [(by[i][k].start, by[i][k].length) for k in sorted(by[i])] == pieces
        assert [by[i][k].ids_crc32 for k in sorted(by[i])] == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in pieces]
        lengths += [n for _, n in pieces]
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert len(seqs) == len(brute_best_fit(lengths, 64))
    assert packing.pack(none, path).count() == 0
    # Repeated rows and null doc_ids are packed each on its own.
    again = packing.pack(spark_of(docs).createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string"), path, size=64).collect()
    assert len(again) == 4 and len({(r.sequence_id, r.offset) for r in again}) == 4 and sum(r.doc_id is None for r in again) == 2


def spark_of(df):
    return df.sparkSession


def test_encoder_splits_like_the_tokenizer():
    import public_tokenizers

    e = packing.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["a's it's", "x  y\n\n z", "été 123abc", "\t\tq", "日本語 text", "<|endoftext|> a", "", " lead", "end  ", "ÀÈ!!??", "a\u00a0b", "I'll we've", "x" * 9000, "\x1c\x1d a\x85b", "½ ² a_b __"]
    assert e.encode(texts) == e.whole(texts)
