"""Fingerprints, scores, languages, quality rules and personal data against brute force."""

import hashlib
import random
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import fingerprint, language, ngrams, pii, quality, scoring
from tallyframe.llm.common import documents, numbered, ordered_cells

GENERATED = "/root/testdata/sf0.01"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Shared helpers


def test_numbers_are_gapless_in_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("g"), "id")
    got = defaultdict(list)
    for r in numbered(df, ["g"], ["id"], "n", 5000).collect():
        got[r.g].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got[0]) == 4501


def test_cells_follow_the_order(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 3000, F.col("id")).otherwise(F.col("id") * 1_000_003).alias("k"))
    cell, n = ordered_cells(df.union(spark.sql("SELECT CAST(NULL AS BIGINT)")), "k")
    rows = df.union(spark.sql("SELECT CAST(NULL AS BIGINT)")).select("k", cell.alias("c")).collect()
    rows = sorted(((r.k is not None, r.k, r.c) for r in rows))
    cells = [c for _, _, c in rows]
    assert cells == sorted(cells) and 0 <= cells[0] and cells[-1] < n and max(Counter(cells).values()) < 2000


# Fingerprints


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, folder, docs):
    rows = fingerprint.op3_document_fingerprints(spark, folder).collect()
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    edited = defaultdict(Counter)
    exact = {}
    for (d, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        cut = len(t) // 3
        new = t[:len(t) - cut] + following[:cut]
        edited[d][len(t), hashlib.sha256(new.encode()).hexdigest()] += 1
        exact[d] = (shingles(t), shingles(new), shingles(following))
    single = {d for d, n in Counter(d for d, _ in docs).items() if n == 1}
    ids = [r.doc_id for r in rows]
    assert Counter(ids) == Counter(d for d, _ in docs)
    errors = []
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in single:
            assert (r.n_chars, r.edited_sha256) in edited[r.doc_id]
            own, new, following = exact[r.doc_id]
            if max(len(own), len(new), len(following)) < fingerprint.LEAST:
                assert r.near_edited == pytest.approx(likeness(own, new))
                assert r.near_next == pytest.approx(likeness(own, following))
            errors.append(r.near_edited - likeness(own, new))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.12
    # Equal texts have equal fingerprints, rows of one id follow each other.
    by_text, text_of = defaultdict(set), {d: t for d, t in docs if d in single}
    for r in rows:
        if r.doc_id in single:
            by_text[text_of[r.doc_id]].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_sketches_merge_and_contain(spark):
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(6000))
    part, other = " ".join(long.split()[1000:2000]), " ".join(f"v{i}" for i in range(3000))
    df = spark.createDataFrame([(long, part, other)], "a string, b string, c string").withColumn("ac", F.concat_ws(" ", "a", "c"))
    for c in df.columns:
        df = fingerprint.with_sketch(df, c, f"s_{c}")
    a, b, c, ac = (F.col(f"s_{x}") for x in ("a", "b", "c", "ac"))
    r = df.select(fingerprint.containment(b, a).alias("inside"), fingerprint.containment(a, b).alias("around"),
                  fingerprint.likeness(fingerprint.merged(a, c), ac).alias("merged"), F.size(a).alias("n")).first()
    assert r.inside == 1 and r.around == pytest.approx(1 / 6, abs=0.04) and r.merged > 0.99
    assert r.n == pytest.approx(6000 / 8, rel=0.15)


# Scores


def test_monotone_sequences():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (1000, 1000), (5000, 10**9), (30, 40)):
        values = np.sort(rng.choice(top, n, replace=False)).astype(np.int64)
        code = ngrams.Monotone(ngrams.Monotone.arrays(values))
        x = rng.integers(0, top + 5, 2000)
        assert (code.value(np.arange(n)) == values).all() and (code.successor(x) == np.searchsorted(values, x)).all()


def test_trie_from_a_mapped_file(tmp_path):
    words_ = np.array([50, 40, 30])
    single = np.log10(words_ / 130)
    blob = ngrams.Trie.build(single, words_, np.array([[0, 1, 20], [1, 2, 9], [0, 2, 4]]), np.array([[0, 1, 2, 7]]), 0.5)
    (tmp_path / "trie").write_bytes(blob)
    trie = ngrams.Trie.open(str(tmp_path / "trie"))
    ids = np.array([0, 1, 2, -1, 0, 2])
    gain = trie.gains(ids, np.array([0]))
    rest0, rest1, rest01 = 1 - (19.5 + 3.5) / 50, 1 - 8.5 / 40, 1 - 6.5 / 20
    p12 = 8.5 / 40 + rest1 * 30 / 130
    score = [0, math.log10(19.5 / 50 + rest0 * 40 / 130) - single[1], math.log10(6.5 / 20 + rest01 * p12) - single[2], 0.0, 0.0,
             math.log10(3.5 / 50 + rest0 * 30 / 130) - single[2]]
    assert gain == pytest.approx(score, abs=3e-4)


def test_scores(spark, folder, docs):
    rows = {r.doc_id: r for r in scoring.op4_lm_scoring(spark, folder).collect()}
    tokens = [(d, [w.lower() if w.isascii() else lowered(w) for w in words(t)] + [None]) for d, t in docs]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    one, two, three = Counter(), Counter(), Counter()
    for d, w in tokens:
        if not held(d):
            one.update(w), two.update(zip(w, w[1:])), three.update(zip(w, w[1:], w[2:]))
    n, v = sum(one.values()), len(one)
    least = max(2, math.ceil(scoring.SHARE * n))
    two = {k: c for k, c in two.items() if c >= least}
    three = {k: c for k, c in three.items() if c >= least}
    rest1, rest2 = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    for (u, _), c in two.items():
        rest1[u] -= (c - scoring.DISCOUNT) / one[u]
    for (u, x, _), c in three.items():
        rest2[u, x] -= (c - scoring.DISCOUNT) / two[u, x]
    p1 = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))

    def p2(u, w):
        return (two[u, w] - scoring.DISCOUNT) / one[u] * ((u, w) in two) + rest1[u] * p1(w) if (u, w) in two else rest1[u] * p1(w)

    def p3(u, x, w):
        return ((three[u, x, w] - scoring.DISCOUNT) / two[u, x] if (u, x, w) in three else 0) + rest2[u, x] * p2(x, w)

    assert len(rows) == len({d for d, _ in docs})
    unique = {d for d, k in Counter(d for d, _ in docs).items() if k == 1}
    for d, w in tokens:
        r = rows[d]
        assert r.held_out == held(d) and r.train_tokens == n
        if d in unique:
            base = sum(math.log10(p1(x)) for x in w)
            full = sum(math.log10(p1(x) if i == 0 else p2(w[i - 1], x) if i == 1 else p3(w[i - 2], w[i - 1], x))
                       for i, x in enumerate(w))
            assert (r.n_tokens, r.n_known) == (len(w), sum(one[x] > 0 for x in w))
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(full, abs=3e-4 * len(w))


def test_the_model_beats_single_words_on_held_out_texts(spark):
    rows = scoring.op4_lm_scoring(spark, GENERATED).where("held_out").toPandas()
    assert rows["score"].sum() > 0.96 * rows["base_score"].sum()


def test_rare_pairs_stay_in_the_model_of_a_large_input(spark):
    """Two standings are kept, however many other tokens there are."""
    rows = [(i, "x y " * 250_000, False) for i in range(4)] + [(i, "seldom pair", False) for i in (4, 5)] + [(6, "seldom pair", True)]
    df = spark.createDataFrame(rows, "k long, t string, h boolean")
    r = scoring.score_texts(df, "k", "t", F.col("h")).where("k = 6").first()
    n, v, d = 2_000_010, 5, scoring.DISCOUNT
    p1 = lambda c: (c + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda c: (2 - d) / 2 + d / 2 * p1(c)
    full = math.log10(p1(2)) + math.log10(p2(2)) + math.log10((2 - d) / 2 + d / 2 * p2(6))
    assert r.train_tokens == n and r.score == pytest.approx(full, abs=1e-3) and r.score > r.base_score + 5


def test_shards_of_the_model_agree_with_one(spark, folder):
    docs_ = documents(spark, folder).select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    one, many = (sorted((r.doc_id or 0, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in scoring.score_texts(
        docs_, "doc_id", "text", held, shard_tokens=size).collect()) for size in (1 << 21, 4000))
    assert len(one) == docs_.count() and one == many


def test_chunks_of_very_many_words_ask_the_same():
    rng = np.random.default_rng(1)
    tokens, starts, heads = rng.integers(-1, 30, 3000).astype(np.int32), np.array([0, 1, 2, 700, 701]), np.arange(30) * 7
    for level in (2, 3):
        short, long = (scoring._Asked(level, tokens, starts, np.arange(3000) % 3 > 0, heads, np.array([14, 21]), 5, bits)
                       for bits in (63, 8))
        assert all(np.array_equal(getattr(short, name), getattr(long, name)) for name in vars(short)) and short.n.sum() > 1500


# Languages


def test_languages(spark):
    rows = language.op5_language_id(spark, GENERATED).join(documents(spark, GENERATED), "doc_id").toPandas()
    assert len(rows) == 1000 and (rows.language == rows.lang).mean() > 0.99 and rows.kept.mean() > 0.99


def test_every_declared_language_is_a_class(spark):
    """Eighty languages of eight rows, and one of two rows."""
    rng = np.random.default_rng(3)
    names = [a + b for a in "abcdefghij" for b in "klmnopqr"] + ["zz"]
    vocabulary = {n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(30)] for n in names}
    rows = [(n, " ".join(rng.choice(vocabulary[n], 40))) for n in names for _ in range(2 if n == "zz" else 8)]
    df = spark.createDataFrame(rows, "declared string, text string")
    found = language.identify(df, F.col("text"), F.col("declared")).toPandas()
    told = found["_language"].map(lambda r: r["language"])
    assert (told == found.declared).all() and found["_language"].map(lambda r: r["accepted"]).all()


def test_sparse_text_model_agrees_with_the_table():
    rng = np.random.default_rng(2)
    bucket, place = np.unique(rng.integers(0, [language.BUCKETS, 9], (20_000, 2)), axis=0).T
    n = rng.integers(1, 50, len(place))
    table, sparse = (language.TextModel(list("abcdefghi"), place, bucket, n, most) for most in (10, 9))
    assert sparse.table is None
    for text in (b"one two three", b"x" * 3000, "Straße und Weg".encode()):
        assert sparse.scores(text) == pytest.approx(table.scores(text), rel=1e-5)
    assert sparse.scores(b" 1 ") is None


def test_held_out_texts_without_a_declaration(spark):
    """Rows that declare nothing, on an unknown host, are told by their text alone."""
    docs = documents(spark, GENERATED).withColumn("declared", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    found = language.identify(docs, F.col("text"), F.col("declared")).where("declared IS NULL").toPandas()
    right = [r["language"] == lang for r, lang in zip(found["_language"], found.lang)]
    assert np.mean(right) > 0.98


def test_evidence_beside_the_text(spark):
    rows = [(i, t, lang, host) for i, (t, lang, host) in enumerate(
        [("the cat and the dog", "en", "a.example.com")] * 200 + [("der hund und die katze", "de", "www.b.de")] * 200)]
    rows += [(1000, "q", None, "new.b.de"), (1001, "q", None, "x.example.com"), (1002, "q", "DE-at", None),
             (1003, "1234 !!", "de", "www.b.de"), (1004, None, "de", "www.b.de"), (1005, "der hund und die katze", "en", "a.example.com")]
    df = spark.createDataFrame(rows, "id long, text string, d string, host string")
    got = {r.id: r._language for r in language.identify(df, F.col("text"), F.col("d"), F.col("host")).where("id >= 1000").collect()}
    assert [got[i].language for i in range(1000, 1006)] == ["de", "en", "de", "und", "und", "de"]
    assert not got[1003].accepted and not got[1004].accepted and got[1005].accepted


def test_languages_of_edge_rows(spark, folder, empty):
    df = documents(spark, folder)
    kept = language.keep_identified(df, "text", "lang", "source")
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    assert all(t and any(c.isalpha() for c in t) for t in texts) and len(texts) >= df.count() - 4
    assert language.keep_identified(documents(spark, empty), "text", "lang", "source").count() == 0
    assert language.identify(df, F.col("text")).where("_language.accepted").count() == 0


def test_languages_of_pages(spark):
    rows = language.language_id_pages(spark, GENERATED).toPandas()
    pages = spark.read.parquet(f"{GENERATED}/pages.parquet").select(
        "page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang")).toPandas().merge(rows, on="page_id")
    assert len(rows) == 250 and (pages.lang == pages.language).mean() > 0.9


# Quality


def measures(text):
    text = text or ""
    w, lines = words(text), [line for line in text.split("\n") if words(line)]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen, repeated = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            repeated.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_quality(spark, folder, docs):
    expected = Counter()
    for d, t in docs:
        n, chars, symbols, lines, repeated = m = measures(t)
        failed = n < 10 or 100 * repeated > 20 * n
        letters, capitals = sum(c.isalpha() for c in t or ""), sum(c.isupper() for c in t or "")
        n_lines = sum(bool(words(x)) for x in (t or "").split("\n"))
        good = (10 * symbols <= n and 2 * n <= chars <= 20 * n and 2 * lines <= n_lines and 2 * letters >= chars
                and 2 * capitals <= letters)
        expected[(d, *m, failed, good and not failed)] += 1
    assert Counter(map(tuple, quality.op6_quality_rules(spark, folder).collect())) == expected


def test_the_cascade_runs_what_rejects_most_for_its_cost_first():
    calls = []

    def rule(name, cost, rejects):
        def run(t):
            calls.append(name)
            for _ in range(cost):
                hash(t.text)
            return rejects(t.text)
        return run

    rules = {"never": rule("never", 1, lambda t: False), "dear": rule("dear", 30_000, lambda t: t > "b"),
             "cheap": rule("cheap", 1, lambda t: t > "b")}
    order = quality.order_rules(["a", "c", "d"] * 5, rules)
    assert order == ["cheap", "dear", "never"]
    calls.clear()
    assert quality.first_rejection(quality.Text("z"), order, rules) == "cheap" and calls == ["cheap"]
    assert quality.first_rejection(quality.Text("a"), order, rules) is None


def test_quality_keeps_clean_documents(spark, folder, empty):
    rows = quality.op6_quality_rules(spark, GENERATED).join(spark.read.parquet(f"{GENERATED}/labels.parquet"), "doc_id").toPandas()
    assert rows[(rows.quality == 1) & ~rows.base_failed].kept.all() and not rows[rows.quality == 0].kept.mean() > 0.05
    df = documents(spark, folder)
    kept = quality.keep_good(df, "text")
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    assert quality.op6_quality_rules(spark, empty).count() == quality.keep_good(documents(spark, empty), "text").count() == 0


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out[kind].append((m.start(), m.end()))
    return out


def test_base_spans_of_random_strings(spark):
    rnd = random.Random(3)
    parts = list("ab19. -+()@%") + ["4111 1111 1111 1111", "10.0.0.1", "a.b@c.de", "+1 (415) 555-1234", "1.2.3.4.5.6.7.8", "中é",
                                    "😀", "\n", "  ", "--", "256.1.1.1", "000000000000000000000000000001.2.3.4"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(1200)]
    texts += ["1" * 30_000, "1 " * 20_000, "a" * 50_000 + "@b.c", "a@" + "b." * 500 + "c", "+1" + " " * 20_000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in pii.with_base(df, "text").drop("_text").collect():
        assert {k: [(h.start, h.end) for h in r[f"_base_{k}"]] for k in pii.BASE_KINDS} == base_spans(texts[r.i])


def test_personal_data_query(spark, folder, docs):
    expected = Counter()
    for d, t in docs:
        spans = base_spans(t)
        line = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in spans[k])
        expected[(d, *[len(spans[k]) for k in pii.BASE_KINDS], hashlib.sha256(line.encode()).hexdigest())] += 1
    rows = pii.op7_pii(spark, folder).collect()
    assert Counter(tuple(r)[:6] for r in rows) == expected
    for r in rows:
        spans = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert r.n_spans == len(spans) and r.n_secret == sum(k == 4 for k, _, _ in spans)
        assert spans == sorted(spans) and len(spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_votes_add_spans_and_leave_prose_alone(spark):
    prose = "At ten the old lady met us at the gate. See rows 12 to 14, or page 7. The year 1998-1999 was wet."
    texts = [f"{prose} Mail bob{i}@mail.example.com, call +49 30 1234 56{i:02d}, card 4111 1111 1111 1111." for i in range(60)]
    texts += [f"{prose} Please mail jim{i} [at] example [dot] org." for i in range(20)] + [prose] * 40
    texts += ["pay by card 3782 822463 10005 now", "call 415-555-2671 today"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = {r.i: r for r in pii.find(df, "text").select("i", *[f"_spans_{k}" for k in pii.KINDS]).collect()}
    assert all(len(rows[i]._spans_email) == 1 for i in range(80))
    assert all(not any(len(rows[i][f"_spans_{k}"]) for k in pii.KINDS) for i in range(80, 120))
    assert [h.s for h in rows[120]._spans_card] == ["3782 822463 10005"]


def planted_and_alike():
    """(text, kind, string, whether it is personal) of invented spans outside the base patterns and of strings that look like them."""
    rnd = random.Random(11)
    drawn = lambda chars, n: "".join(rnd.choices(chars, k=n))
    hexes, letters, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"

    def card(right):
        head = "4" + drawn(digits, 14)
        last = next(d for d in digits if luhn(head + d) == right)
        return head + last

    rows = []
    for i in range(40):
        address = f"{drawn('abcdefgh', 6)} [at] example [dot] org"
        place = f"{rnd.randint(11, 250)}[.]{rnd.randint(0, 250)}[.]{rnd.randint(0, 250)}[.]{rnd.randint(1, 250)}"
        phone = f"({rnd.randint(201, 989)}) 555-{rnd.randint(1000, 9999)}"
        amex = "37" + drawn(digits, 12)
        amex += next(d for d in digits if luhn(amex + d))
        token, key = drawn(hexes, 40), f"sk_live_{drawn(letters, 24)}"
        part = f"{rnd.randint(201, 989)}-{rnd.randint(100, 999)}-{rnd.randint(1000, 9999)}"
        wrong, commit, name = card(False), drawn(hexes, 40), f"the-year-{rnd.randint(1900, 2020)}-in-long-words"
        rows += [(f"Contact me by mail: {address} or so.", "email", address, True), (f"The host at {place} was down.", "ip", place, True),
                 (f"Please call {phone} after ten.", "phone", phone, True), (f"Paid by card {amex} again.", "card", amex, True),
                 (f'Set token = "{token}" first.', "secret", token, True), (f"Use API_KEY={key} for it.", "secret", key, True),
                 (f"Your order number {wrong} was sent.", "card", wrong, False), (f"Fixed in commit {commit} by us.", "secret", commit, False),
                 (f"See {name} for more of it.", "secret", name, False), (f"The serial number {part}-x is on the back.", "phone", part, False)]
    return rows


def test_spans_beyond_base_are_found_and_alike_strings_are_not(spark):
    rows = planted_and_alike()
    base = [f"Mail bob{i}@mail.example.com or +49 30 1234 56{i:02d}, host 10.0.0.{i}, card 4111 1111 1111 1111." for i in range(40)]
    texts = [r[0] for r in rows] + base
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r.i: r for r in pii.find(df, "text").select("i", *[f"_spans_{k}" for k in pii.KINDS]).collect()}
    right, wrong = Counter(), Counter()
    for i, (_, kind, string, personal) in enumerate(rows):
        for k in pii.KINDS:
            for h in found[i][f"_spans_{k}"]:
                good = personal and h.s == string and k == kind
                (right if good else wrong)[k] += 1
    planted = Counter(kind for _, kind, _, personal in rows if personal)
    assert all(right[k] >= 0.9 * planted[k] for k in pii.KINDS), (right, wrong)
    assert sum(wrong.values()) <= 0.05 * sum(right.values()), (right, wrong)
    votes = pii.vote_table(pii.with_candidates(pii.with_base(df, "text"))).collect()
    assert {r.kind for r in votes if r.shape * r.context < 0 or r.shape * r.gazetteer < 0} >= {2, 4}  # labelers disagree


def test_long_runs_are_no_secrets(spark):
    texts = ["x1" * 300_000, "x" * 500_000, "ab12" * 100, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [len(r[0]) for r in pii.find(df, "text").orderBy("i").select("_spans_secret").collect()] == [0] * 5


def test_em_learns_which_labelers_to_trust():
    """A labeler that is right most of the time, one that guesses, on candidates of which a third are true."""
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.35
    votes = Counter()
    for t in truth:
        good = [1 if (rng.random() < 0.9) == t else -1 for _ in range(3)]
        votes[(4, (*good, 1 if rng.random() < 0.5 else -1, 0))] += 1
    post = pii.reliabilities([(k, v, float(n)) for (k, v), n in votes.items()])
    assert post[4, (1, 1, 1, -1, 0)] > 0.95 and post[4, (-1, -1, -1, 1, 0)] < 0.05 and post[4, (1, 1, -1, -1, 0)] > 0.6


def test_redaction(spark, folder, empty):
    df = documents(spark, folder)
    out = pii.redact(df, "text")
    assert out.columns == df.columns and out.count() == df.count()
    before = {r.doc_id: r.text for r in df.where("doc_id < 9007").collect()}
    for r in out.where("doc_id < 9007").collect():
        if not any(base_spans(before[r.doc_id]).values()):
            assert r.text == before[r.doc_id] or re.search("<(EMAIL|IP|CARD|PHONE|SECRET)>", r.text)
    text = out.where("doc_id = 9008").first().text
    assert text.startswith("Write to <EMAIL> or call <PHONE> about the garden")
    assert not any(any(base_spans(r.text).values()) for r in out.collect())
    assert pii.redact(documents(spark, empty), "text").count() == pii.op7_pii(spark, empty).count() == 0


def test_empty(spark, empty):
    for q in (fingerprint.op3_document_fingerprints, scoring.op4_lm_scoring, language.op5_language_id):
        assert q(spark, empty).count() == 0
