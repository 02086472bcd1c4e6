"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing column names, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n long, _row string, word string"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi ome".split()


def rows():
    rng = random.Random(4)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(3, 90))) for _ in range(60)]
    out = []
    for i, t in enumerate(base):
        out.append((i, t))
        if i % 5 == 0:
            out += [(1000 + i, t), (2000 + i, t.upper())]
        if i % 4 == 0:
            w = t.split()
            w[len(w) // 2] = "changed"
            out.append((3000 + i, " ".join(w)))
    out += [(5000, None), (5001, ""), (5002, " \n "), (None, "alpha beta"), (None, "alpha BETA"), (5003, "x " * 30_000), (5004, "y" * 50_000), (7, base[7]), (5005, "été Éte ÉTE 日本 🎉 é")]
    return [(d, t, ["en", "de", "fr", None][i % 4], ["a", "a", "b", None][i % 4], 1, 2, "clash", "w") for i, (d, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return (t or "").encode().lower()


def test_dedup(spark, docs, empty):
    from starlattice.llm import dedup

    groups = {}
    for d, t, *_ in rows():
        groups.setdefault(low(t), []).append(d)
    got = dedup.assignments(docs).collect()
    assert len(got) == len(rows())
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    want = Counter((d, best(groups[low(t)]), len(groups[low(t)]), hashlib.sha256(low(t)).hexdigest()) for d, t, *_ in rows())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    stay = dedup.deduplicate(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert dedup.assignments(empty).count() == 0 and dedup.deduplicate(empty).count() == 0


def grams(t, n=5):
    w = low(t).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_ngram_join(spark, docs, empty):
    from starlattice.llm import ngram_join

    data = [(d, grams(t)) for d, t, *_ in rows() if d is not None]
    want = Counter()
    for (a, x), (b, y) in combinations(data, 2):
        if x and y and len(x & y) >= 0.8 * len(x | y):
            want[a] += 1
            want[b] += 1
    got = [r for r in ngram_join.ngram_join(docs).collect()]
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is not None and r.doc_id != 7:
            assert r.n_links == want[r.doc_id], r
    one = ngram_join.one_per_class(docs)
    assert one.columns == docs.columns
    assert one.count() == len({r.class_id for r in got}) + 1  # the two rows of id 7 stand together
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_large_group(spark):
    """A group of near copies larger than a block: every link is counted, over several blocks."""
    from starlattice.llm import ngram_join

    rng = random.Random(9)
    base = rng.choices([f"w{i}" for i in range(900)], k=200)
    texts = []
    for i in range(1000):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(200)] = f"z{rng.randrange(50)}"
        texts.append((i, " ".join(w)))
    got = {r.doc_id: r for r in ngram_join.ngram_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = [grams(t) for _, t in texts]
    vocab = {g: k for k, g in enumerate(set().union(*sets))}
    x = np.zeros((1000, len(vocab)), np.float32)
    for i, s in enumerate(sets):
        x[i, [vocab[g] for g in s]] = 1
    size, common = x.sum(1), x @ x.T
    linked = common >= 0.8 * (size[:, None] + size[None] - common) - 1e-6
    np.fill_diagonal(linked, False)
    assert [got[i].n_links for i in range(1000)] == linked.sum(1).tolist()


def test_components(spark):
    """Paths, stars, cliques and random graphs against union-find; no edges, no rows."""
    from starlattice.llm.components import connected_components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + j) for i in range(9) for j in range(i)] + [(5, 5)]
    names = rng.sample(range(3000, 9000), 400)
    edges += [(rng.choice(names), rng.choice(names)) for _ in range(300)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_depth():
    from starlattice.llm.ngram_join import depth_for, found_at, shortened

    d = depth_for(20, 0.8, 0.9999)
    assert 1 - (1 - 0.8**d) ** 20 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 20
    meet = lambda pairs, depth: {s: n * 20 * s**depth for s, n in pairs.items()}
    assert shortened({}, 6, 20, 0.8, 0.9999) <= d  # nothing seen proves nothing
    assert shortened(meet({0.97: 1e6}, 6), 6, 20, 0.8, 0.9999) == 6  # all pairs are very near: no need to shorten
    assert shortened(meet({0.8: 1e6}, 6), 6, 20, 0.8, 0.9999) == d
    for mix in ({0.8: 40.0, 0.95: 1e4}, {0.85: 1e3, 0.99: 1e3}):
        got = shortened(meet(mix, 6), 6, 20, 0.8, 0.9999)
        share = lambda depth: (sum(n * found_at(depth, 20, s) for s, n in mix.items()) + found_at(depth, 20, 0.8)) / (sum(mix.values()) + 1)  # noqa: E731, B023
        assert got == max((depth for depth in range(1, 7) if share(depth) >= 0.9999), default=1)


def test_ngram_recall(spark):
    """Isolated pairs at just over the threshold, and a crowd of texts that share most of a passage: no link is lost."""
    from starlattice.llm import ngram_join

    rng = random.Random(12)
    texts, base = [], rng.choices([f"p{i}" for i in range(500)], k=80)
    for k in range(400):  # pairs that share about 0.8 of their shingles
        w = [f"w{rng.randrange(10**6)}" for _ in range(94)]
        texts += [w, w[:84] + [f"v{rng.randrange(10**6)}" for _ in range(9)]]
    for k in range(300):
        texts.append(base + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(4, 30))])
    sets = [grams(" ".join(t)) for t in texts]
    want = Counter()
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for a, b in {(a, b) for own in where.values() for a, b in combinations(own, 2)}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            want[a] += 1
            want[b] += 1
    assert sum(want[i] for i in range(800)) > 400 and sum(want[i] for i in range(800, 1100)) > 1000
    got = {r.doc_id: r.n_links for r in ngram_join.ngram_join(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert sum(got.values()) == sum(want.values()) and got == {i: want[i] for i in range(len(texts))}


def test_ngram_slices(spark, monkeypatch):
    """Subtries that are dealt into cells give the same links as whole ones."""
    from starlattice.llm import ngram_join

    rng = random.Random(2)
    base = [f"p{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(base + [f"u{rng.randrange(10**6)}" for _ in range(i % 9)])) for i in range(120)], "doc_id long, text string")
    whole = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect())
    monkeypatch.setattr(ngram_join, "CROWD", 16)
    monkeypatch.setattr(ngram_join, "BROADCAST_MEMBERS", 0)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect()) == whole


def test_bpe(spark, docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from starlattice.llm import bpe

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = ["Hello  WORLD's I'LL", "ΑΣ ΣΑΣ İstanbul ẞ", "a\x1cb c\x85d\xa0e", "x<|startoftext|>y <|endoftext|>", "日本語 123 4½", "a" * 3000, "'ſ 'S ﬁ Å"]
    more = spark.createDataFrame([(9000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    texts = {9000 + i: t for i, t in enumerate(odd)} | {r[0]: r[1] for r in rows()}
    for r in bpe.encode_documents(more).collect():
        if r.doc_id is not None:
            ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(empty, digests=True).count() == 0


def test_merge_all():
    """Merging many words together gives what merging each alone gives."""
    from starlattice.llm import bpe

    codec, rng = bpe.Codec(bpe._spec(None)), random.Random(3)
    words = [codec._letters_of("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 14)))) for _ in range(4000)] + [codec._letters_of("x" * n) for n in (1, 2, 70, 300)] + [[]]
    assert codec.merge_all(words) == [codec.merged(w) for w in words]


def test_language(spark, empty):
    from starlattice.llm import language

    rng = random.Random(1)
    parts = {"en": "the and ing tion er th wh", "de": "der ung keit sch ein ich ü", "fr": "les eau que é è oi ou", "es": "los ción ñ que ó ar do"}
    make = lambda g: " ".join("".join(rng.choices(parts[g].split(), k=3)) for _ in range(30))
    data = [(i, make(g), g, "extra") for i, g in enumerate(list(parts) * 40)] + [(900, None, "en", "x"), (901, "123 !!", "en", "x"), (902, "", None, "x"), (None, make("de"), None, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    model = language.fit(docs.filter("doc_id < 80"), per_lang=30)
    got = language.predict(docs, model, keep=["doc_id", "lang", "score"]).collect()
    held = [r for r in got if r.doc_id is not None and 80 <= r.doc_id < 900]
    assert np.mean([r._lang == r.lang for r in held]) > 0.97
    assert {r._lang for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert all(0 <= r._score <= 1 for r in got) and len(got) == len(data)
    long = spark.createDataFrame([(1, make("de") + " x" * 700_000), (2, make("fr"))], "doc_id long, text string")
    assert {r.doc_id: r._lang for r in language.predict(long, model, keep=["doc_id"]).collect()}[2] == "fr"
    assert language.predict(empty, model).count() == 0
    few = language.fit(docs.filter("doc_id < 80"), max_langs=3, max_rows=9)
    assert sum(len(m) for m in few.members.values()) == 3
    nothing = language.fit(empty)
    assert {r._lang for r in language.predict(docs, nothing).collect()} == {"und"}


def test_mixing(spark, docs, empty):
    from starlattice.llm import mixing

    got = mixing.mix(docs, weights={"a": 1.0, "b": 3.0}, total_factor=4.0).collect()
    assert {r._row.source for r in got} == {"a", "b"} and all(1 <= r._copy <= r._copies for r in got)
    again = mixing.mix(docs.repartition(5), weights={"a": 1.0, "b": 3.0}, total_factor=4.0).collect()
    key = lambda rs: Counter((r._row.doc_id, r._row.text, r._copy) for r in rs)
    assert key(got) == key(again)
    from pyspark.sql import functions as F

    for rate in (0.3, 1.0, 7.5, 40.0):
        n = [r.c for r in spark.range(3000).select(mixing.copies(3, F.col("id"), F.lit(rate)).alias("c")).collect()]
        assert abs(np.mean(n) - rate) < 5 * math.sqrt(rate / 3000) and abs(np.var(n) - rate) < 0.2 * rate + 0.05
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs).select("_row.*").columns == docs.columns


def test_sharding(spark, docs, empty, tmp_path):
    from starlattice.llm import sharding

    rows_df, slot_map = sharding.shard(docs, 4)
    got = rows_df.collect()
    assert len(got) == len(rows())
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    sizes = {i: s for i, s in enumerate(random.Random(2).choices(range(1, 4000), k=3000))}
    even = sharding.SlotMap.first(16).rebalanced(sizes.items())
    load = Counter()
    for s, b in sizes.items():
        load[even.shard_of[s]] += b
    assert max(load.values()) - min(load.values()) <= 3 and even.version == 2
    grown = even.rebalanced(sizes.items(), 17)
    assert grown.moved(even) < 3000 / 17 * 3 and set(grown.shard_of) == set(range(17))
    sharding.save_map(spark, slot_map, str(tmp_path / "map"))
    sharding.save_map(spark, slot_map.rebalanced([(0, 5)]), str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map"), 2) == slot_map and sharding.load_map(spark, str(tmp_path / "map")).version == 3
    assert sharding.shard(empty, 4)[0].count() == 0
    # by brute force: whole contract of the rows, and near-equal bytes with one row repeated for most of the table
    import zlib

    many = spark.createDataFrame([*[(7, "same text")] * 3000, *[(100 + i, "t" * (i % 50)) for i in range(1000)], (None, None)], "doc_id long, text string").repartition(5)
    home = str(tmp_path / "stored")
    first = sharding.shard(many, 16, map_path=home)[1]
    out, now = sharding.shard(many, 16, map_path=home)
    got = out.collect()
    want = Counter([(7, 10, zlib.crc32(b"same text"))] * 3000 + [(100 + i, i % 50 + 1, zlib.crc32(b"t" * (i % 50))) for i in range(1000)] + [(None, 1, 0)])
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    load = Counter()
    for r in got:
        load[r.shard] += r.size
        assert now.shard_of[r.vslot] == r.shard and r.map_version == now.version
    assert set(load) == set(range(16)) and max(load.values()) - min(load.values()) <= 20
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert (first.version, now.version) == (2, 3) and sharding.load_map(spark, home, 2) == first and sharding.load_map(spark, home) == now


def test_lattice_word():
    """All segmentations by enumeration."""
    from starlattice.llm.lattice import Pieces

    names = [b" ", b"a", b"b", b"c", b"ab", b" a", b"bc", b" ab", b"abc", b"cab"]
    weights = np.arange(1.0, 11.0)
    pieces = Pieces(names, weights)
    p = dict(zip(names, weights / weights.sum()))

    def total(t):
        return 1.0 if not t else sum(p[n] * total(t[len(n) :]) for n in names if t.startswith(n))

    words = [b"a", b"abc", b"cabcab", b"bbbca", b"abcabcabc"]
    assert np.allclose(pieces.log10(words), [math.log10(total(b" " + w)) for w in words])
    assert np.isclose(pieces._long(np.frombuffer(b" abcabc", np.uint8)) / math.log(10), math.log10(total(b" abcabc")))


def test_lattice_documents(spark, docs, empty):
    import zlib

    from starlattice.llm import lattice

    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c, ends = Counter(), 0
    for d, t, *_ in rows():
        if not held(d):
            c.update(low(t).split())
            ends += 1
    total, distinct = sum(c.values()) + ends, len(c) + 1
    score = lambda k: math.log10((k + 0.5) / (total + 0.5 * (distinct + 1)))
    want = Counter()
    for d, t, *_ in rows():
        w = low(t).split()
        want[d, held(d), len(w) + 1, sum(c[x] > 0 for x in w) + 1, total, round(sum(score(c[x]) for x in w) + score(ends), 6)] += 1
    got = lattice.score_documents(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    # the model by brute force: all cuts of each word, and the counts with their discount
    pieces = lattice.Pieces(*lattice.vocabulary())
    p = dict(zip(pieces.names, np.exp(pieces.logp)))
    once, twice, n = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()), sum(c.values())
    d = once / (once + 2 * twice) if once and twice else 0.5

    def cuts(t):
        a = [1.0]
        for j in range(1, len(t) + 1):
            a.append(sum(a[i] * p[t[i:j]] for i in range(max(0, j - pieces.longest), j) if t[i:j] in p))
        return a[-1]

    word = {w: math.log10((n + 0.5) / (total + 1) * (max(c[w] - d, 0) + (d * len(c) + 0.5) * cuts(b" " + w)) / (n + 0.5)) for w in {w for _, t, *_ in rows() for w in low(t).split()} if len(w) < 60}
    for r in got:
        own = [low(t).split() for i, t, *_ in rows() if i == r.doc_id]
        if len(own) == 1 and all(w in word for w in own[0]):
            assert math.isclose(r.score, sum(word[w] for w in own[0]) + math.log10((ends + 0.5) / (total + 1)), rel_tol=1e-9), r
    assert lattice.score_documents(empty).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    from starlattice.llm.pii_model import luhn

    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = [("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", CARD, lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15)]
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(tests) for m in p.finditer(t or "") if ok(m.group())]
    return sorted(found)


def test_pii(spark, empty):
    from starlattice.llm import pii

    rng = random.Random(6)
    bits = ["a.b@c.de", "x@y", "@q.r", "a@b.c_d@e.f-g.h", "é", "🎉", "1.2.3.4", "256.1.1.1", "001.002.003.004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0100", "+1", "++49 30 1234567", "12345678901234567890123", " ", "-", ".", "(", ")", "7", "user [at] host [dot] org", "call (555) 123-4567", "\n", "_", "%a", "4111111111111111", "card "]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(1500)] + [None, "", "1 " * 20_000, "1" * 30_000, *("a@b" + ".c" * n for n in (1500, 1999, 20_000, 200_000)), "a@b.c@d.e@f.g x@y@a.b u@v..w@x.y", "p@q.r " * 3000, "." * 9000 + "@x.y", "+1 " * 5000, "write user [at] host [dot] org now"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, _base string")
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        line = ",".join(f"{n}:{s}:{e}" for s, _, e, n in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (t[:200], line[:200], got[i].spans[:200])
        assert set(line.split(",")) - {""} <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w[3] == k for w in want) for k in ("email", "ip", "card", "phone")]
    assert got[len(texts) - 1].spans == "email:6:30"
    assert pii.find_personal_data(empty).count() == 0
    names = ["row", "base", "added", "text", "rest", "judged", "_base", "f"]
    clash = spark.createDataFrame([(1, "mail a.b@c.de, or 1.2.3.4.", *["z"] * 7), (2, None, *["z"] * 7)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names if n != "text"))
    done = {r.doc_id: r for r in pii.redact(clash).collect()}
    assert done[1].text == "mail [email], or [ip]." and done[2].text is None and all(r[n] == "z" for r in done.values() for n in names if n != "text")


def test_pii_added(spark):
    """SQL scores equal the model's, overlaps fall to the better score, and fresh sentences are judged well."""
    from starlattice.llm import pii, pii_model

    model = pii._model()
    for kind, (precision, recall) in pii_model.measured(model).items():
        assert precision >= 0.9 and recall >= 0.5, kind
    texts = [t for k, t, *_ in pii_model.sentences(400, 5)] + ['then token = "2d36530ff989cdbaf29243955fc930be3d922f7b" x', "commit 2d36530ff989cdbaf29243955fc930be3d922f7b", "call 555-123-4567 now", "login from 10[.]2[.]3[.]4 ok"]
    got = {r.i: r for r in pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).selectExpr("row.i i", "base", "added").collect()}
    for i, (kind, text, s, e, _) in enumerate(pii_model.sentences(400, 5)):
        spans = [(x.s, x.e, pii.KINDS[x.k]) for x in got[i].added]
        for a, b, k in spans:
            assert model.score(pii_model.describe(k, text, a, b)) >= model.thresholds[k], (text, spans)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(spans, spans[1:]))
        assert not any(b.s < y and x < b.e for x, y, _ in spans for b in got[i].base)
    at = lambda i: [(pii.KINDS[x.k], texts[400 + i][x.s : x.e]) for x in got[400 + i].added]
    assert at(0) == [("secret", "2d36530ff989cdbaf29243955fc930be3d922f7b")] and at(1) == [] and at(2) == [("phone", "555-123-4567")] and at(3) == [("ip", "10[.]2[.]3[.]4")]


def test_forest(spark):
    from starlattice.llm import forest

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    data += [(2000 + i, x[5].tolist(), 1) for i in range(40)] + [(3000, None, 1), (3100, [0.0] * 16, 1), (3200, [float("nan")] * 16, 1), (3300, [], 1), (None, x[0].tolist(), 1), (3400, [1.0, None] * 8, 1)]
    data += [(4000 + i, [float(i), 1.0, 2.0], 1) for i in range(0, 300, 50)] + [(4000, [0.0, 1.0, 2.0], 1), (5000, [1e38] * 5, 1), (5001, [-1e38] * 5, 1)]  # other lengths, a repeated row, huge numbers
    got = forest.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>, score int"), block=600).collect()
    ok = [(i, np.array(v, float)) for i, v, _ in data if i is not None and i < 3000]
    ids, m = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        want = sorted((round(float(a), 9), int(b)) for a, b in zip(d, ids) if b != q)[:10]
        own = sorted((r.rank, round(r.score, 9), r.vec_id) for r in got if r.query_id == q)
        assert [o[0] for o in own] == list(range(1, 11)) and own == sorted(own, key=lambda o: o[1:])
        hits += len({w[1] for w in want} & {o[2] for o in own})
        total += 10
    assert hits / total >= 0.9
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 4100] == [(4050, 50.0), (4150, 50.0), (4000, 100.0), (4200, 100.0), (4250, 150.0)]
    assert [r.vec_id for r in got if r.query_id == 5000] == [5001]
    assert forest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_repair(roles):
    """Cheapest repair by relaxing single steps, apart from the operator: 0 keep, 3 relabel, 2 insert, 1 or 5 merge."""
    names = {"system": "s", "developer": "s", "user": "u", "human": "u", "assistant": "a", "gpt": "a"}
    after = {"-": "su", "s": "u", "u": "a", "a": "u"}
    best = {"-": 0}

    def insert(costs):
        for _ in range(3):
            for state, cost in list(costs.items()):
                for to in after[state]:
                    if to != "s" and cost + 2 < costs.get(to, 10**9):
                        costs[to] = cost + 2
        return costs

    for role in roles:
        own, new = names.get((role or "").lower()), {}
        for state, cost in insert(dict(best)).items():
            for to in after[state]:
                new[to] = min(new.get(to, 10**9), cost + (0 if to == own else 3))
        for state, cost in best.items():
            if state != "-":
                new[state] = min(new.get(state, 10**9), cost + (1 if state == own else 5))
        best = new
    return insert(best)["a"]


def test_chat_cost():
    from starlattice.llm import chat

    rng = random.Random(8)
    for _ in range(300):
        roles = rng.choices(["system", "user", "assistant", "Human", "tool", None], k=rng.randint(0, 9))
        codes = [chat.code_of(r) for r in roles]
        steps, cost = chat.repair(roles)
        assert cost == brute_repair(roles)
        cut = rng.randint(0, len(codes))
        assert (chat.product(chat.matrix(codes[:cut]), chat.matrix(codes[cut:])) == chat.matrix(codes)).all()
        state = chat.START
        for action, role, before in steps:
            for r in [*before, *([] if action == "merge" else [role])]:
                assert r in chat.LEGAL[state]
                state = r


def test_chat(spark):
    from starlattice.llm import chat

    rng = random.Random(5)
    data = [(1, t, rng.choice(["user", "assistant", "user", "system", None]), f"m{t}", "x") for t in range(700)]
    data += [(2, 0, "user", "hi", "x"), (2, 1, "assistant", "yo", "x"), (3, 0, "assistant", None, "x"), (None, 0, "user", "q", "x"), (None, 0, "user", "q", "x"), (4, None, "gpt", "z", "x")]
    got = chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, piece string")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.piece_no)):
        by.setdefault(r.conv_id, []).append(r)
    assert "".join(r.piece for r in by[2]) == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"
    assert "".join(r.piece for r in by[3]) == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert "".join(r.piece for r in by[None]) == "<|user|>\nq\n\nq<|end|>\n<|assistant|>\n<|end|>\n"
    for conv, rs in by.items():
        text = "".join(r.piece for r in rs)
        roles = re.findall(r"<\|(user|assistant|system)\|>", text)
        state = chat.START
        for r in roles:
            assert chat.ROLES[r] in chat.LEGAL[state]
            state = chat.ROLES[r]
        assert state == chat.ASSISTANT and text.count("<|end|>") == len(roles)
        assert [r.turn_no for r in rs if r.action in ("keep", "relabel", "insert")] == list(range(len(roles)))
    # over several partitions the repair costs what it costs in one piece
    order = sorted((d for d in data if d[0] == 1), key=lambda d: d[1])
    steps, cost = chat.repair([d[2] for d in order])
    codes = {d[1]: chat.code_of(d[2]) for d in order}
    spent = 0
    for r in by[1]:
        if r.action == "insert":
            spent += chat.INSERT
        elif r.action == "relabel":
            spent += chat.RELABEL
        elif r.action == "merge":
            spent += chat.MERGE if codes[r.source_turn] == chat.ROLES[r.role] else chat.MERGE_OTHER
    assert spent == cost
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark, docs, empty, tmp_path):
    """Against a brute-force run of the five stages over the same rows."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    data = {(r[0], low(r[1])): r for r in rows()}  # of rows alike in id and text either may stay
    spark.createDataFrame(list(data.values()), SCHEMA).repartition(3).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "poisson_mix", "bpe_tokens"]
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in p.run(spark, str(tmp_path)).collect())

    rows_ = [(i, t, s) for i, t, _, s, *_ in data.values() if t is not None and any(ch.isalpha() for ch in t)]
    best = {}
    for i, t, s in rows_:  # of equal texts the largest id, and any id before none
        held = best.get(low(t))
        if held is None or (i is not None and (held[0] is None or i > held[0])):
            best[low(t)] = (i, t, s)
    left = list(best.values())
    sets = [grams(t) for _, t, _ in left]
    up = list(range(len(left)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(left)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    groups = {}
    for k in range(len(left)):
        groups.setdefault(root(k), []).append(left[k])
    kept = [min(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]
    size = Counter()
    for _, t, s in kept:
        size[s] += len(t.encode()) + 1
    weights = {s: b**0.7 for s, b in size.items()}
    rate = {s: round(weights[s] / sum(weights.values()) * sum(size.values()) / size[s], 9) for s in size}
    lib, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for i, t, s in kept:
        if i is None:
            continue  # its draw hangs on a hash of the text that only Spark computes
        draws, copies = max(1, math.ceil(rate[s] / 8)), 0
        for j in range(1, draws + 1):
            u = (int(hashlib.sha256(f"42:{i}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            mean, n = rate[s] / draws, 0
            cdf = term = math.exp(-mean)
            while cdf < u and n < 48:
                n += 1
                term *= mean / n
                cdf += term
            copies += n
        ids = lib.encode(t, add_special_tokens=False).ids
        if copies:
            want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += copies
    assert Counter({k: n for k, n in got.items() if k[0] is not None}) == want

    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def test_chat_long(spark):
    """Very long texts go through whole, and extra columns with the names of results do not matter."""
    from starlattice.llm import chat

    long = "x" * 3_000_000
    got = chat.format_chats(spark.createDataFrame([(1, 0, "user", long, "k"), (1, 1, "assistant", "ok", "k")], "conv_id long, turn long, role string, text string, piece_no string")).orderBy("piece_no").collect()
    assert "".join(r.piece for r in got) == f"<|user|>\n{long}<|end|>\n<|assistant|>\nok<|end|>\n"
